"""Folders and lineage: what loops need to survive a lost executor."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; where that is unset a new temporary one, set on the context, if all runs in one process."""
    sc = spark.sparkContext
    jsc = sc._jsc.sc()
    told = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not told and jsc.getCheckpointDir().isEmpty() and not sc.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    if jsc.getCheckpointDir().isEmpty():
        sc.setCheckpointDir(told or "file://" + tempfile.mkdtemp(prefix="skein-"))
    return told or jsc.getCheckpointDir().get()


def new_folder(spark: SparkSession, kind: str) -> str:
    """A path in the shared folder that no other run uses; it goes when the driver's JVM ends."""
    path = f"{shared_dir(spark).rstrip('/')}/{kind}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(p)
    return path


def cut(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read again: no lineage, and the size of the files instead of an estimate.

    (A checkpoint keeps its plan's estimated size. Joins multiply estimates, so
    in a loop they grow to numbers of millions of digits.)
    """
    folder = new_folder(df.sparkSession, "cut")
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def drop_cut(df: DataFrame) -> None:
    """Delete what :func:`cut` wrote for ``df``, which a loop needs no more; other frames stay as they are."""
    spark = df.sparkSession
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for f in {f.rpartition("/")[0] for f in df.inputFiles()}:
        if f.rpartition("/")[2].startswith("cut-"):
            p = jvm.org.apache.hadoop.fs.Path(f)
            p.getFileSystem(conf).delete(p, True)
