"""Shared plumbing of the training-data operators: folders, partition counts, key ranges.

Nothing here collects rows that grow with the input: what reaches the driver
is bounded by a parameter (slots of a histogram, one row for each shard).
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import cut, new_folder  # noqa: F401

#: White space of the contracts' words: space and \x09 to \x0D.
WHITE = " \t\n\x0b\x0c\r"
#: The same as a Java regular expression.
WHITE_RE = r"[\x20\x09-\x0D]+"


def input_bytes(df: DataFrame) -> int:
    """The optimizer's estimate of the rows' size: what the scan would read."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def parts_for(df: DataFrame, mb: int = 32, most: int = 20_000) -> int:
    """How many partitions to cut ``df`` into: as many as the session shuffles to, or one for each ``mb`` MB if that is more."""
    spark = df.sparkSession
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return max(1, min(most, max(least, input_bytes(df) // (mb << 20))))


def fresh(df: DataFrame, name: str) -> str:
    """``name`` with as many underscores in front as it takes to be no column of ``df``."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def const_array(values: Sequence, kind: str) -> Column:
    """An array of constants that the optimizer folds to one literal (and not to an expression for each element)."""
    if not len(values):
        return F.array().cast(f"array<{kind}>")
    return F.split(F.lit(",".join(map(str, values))), ",").cast(f"array<{kind}>")


def held(value: Column) -> Column:
    """The value, computed where it stands: a filter on it isn't pushed below.

    Else the optimizer would put the expressions of all steps into one, where
    a step's array is made again for each element of the next.
    """
    return F.when(F.spark_partition_id() >= 0, value)


@dataclass(frozen=True)
class Ranges:
    """Ranges of a long key, cut by a histogram of all its values; equal for equal data, whatever the partitioning.

    low, width: of a histogram slot; bucket: of each slot; parts: number of buckets.
    """

    low: int
    width: int
    bucket: tuple[int, ...]
    parts: int

    def of(self, key: Column) -> Column:
        """The bucket of a key; null keys belong to the first."""
        if self.parts == 1:
            return F.lit(0)
        slot = F.expr("0L") if not self.bucket else ((key.cast("decimal(20,0)") - F.lit(self.low)) / F.lit(self.width)).cast("int")
        slot = F.least(F.greatest(F.coalesce(slot, F.lit(0)), F.lit(0)), F.lit(len(self.bucket) - 1))
        return F.get(const_array(self.bucket, "int"), slot)


def ranges(df: DataFrame, key: str, parts: int) -> Ranges:
    """Cut the values of a long key into at most ``parts`` ranges of about equal row counts.

    Reads the key column only. The driver gets one row for each slot that has
    rows, 16 slots for each range and 4,096 at least.
    """
    keys = df.select(F.col(key).cast("long").alias("k"))
    low, high = keys.agg(F.min("k"), F.max("k")).first()
    if low is None or parts <= 1 or low == high:
        return Ranges(0, 1, (0,), 1)
    slots = max(4096, 16 * parts)
    width = max(1, -(-(high - low + 1) // slots))
    slot = ((F.col("k").cast("decimal(20,0)") - F.lit(low)) / F.lit(width)).cast("int")
    counts = dict(keys.where(F.col("k").isNotNull()).groupBy(slot.alias("s")).count().collect())
    total, seen, bucket = sum(counts.values()), 0, []
    for s in range((high - low) // width + 1):
        bucket.append(min(parts - 1, seen * parts // total))
        seen += counts.get(s, 0)
    names = {b: i for i, b in enumerate(sorted({bucket[s] for s in counts}))}
    last, dense = 0, []
    for s, b in enumerate(bucket):
        last = names.get(b, last)
        dense.append(last)
    return Ranges(low, width, tuple(dense), len(names))


def store_of(uri: str):
    """(file system, path) of a URI that driver and executors share, by pyarrow: local folders, HDFS, object stores."""
    from pyarrow.fs import FileSystem

    return FileSystem.from_uri(uri if "://" in uri else f"file://{uri.removeprefix('file:')}")


def commit(folder: str, files: list[dict]) -> None:
    """Give the files that the successful tasks report (``temp``, ``name``) their names, and write the manifest last.

    A task writes under a name of its own attempt, so a lost or repeated task
    leaves nothing but temporary files, which go here. A folder is whole if it
    has a manifest.
    """
    import json

    store, root = store_of(folder)
    for f in files:
        store.move(f"{root}/{f['temp']}", f"{root}/{f['name']}")
    with store.open_output_stream(f"{root}/manifest.tmp") as out:
        out.write(json.dumps([{k: v for k, v in f.items() if k != "temp"} for f in files]).encode())
    store.move(f"{root}/manifest.tmp", f"{root}/manifest.json")
    store.delete_dir(f"{root}/_temporary")


def one_each(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A few rows (one for each file), each in a partition of its own."""
    from pyspark.sql.types import StructType

    n = max(1, len(rows))
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], StructType.fromDDL(f"_i int, {schema}"))
    return df.repartitionById(n, "_i").drop("_i")


def arrow_map(df: DataFrame, run, schema) -> DataFrame:
    """``df.mapInArrow``, with this package's folder on the Python workers' path."""
    from pathlib import Path

    root, env = str(Path(__file__).resolve().parents[2]), df.sparkSession.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(":"):
        env["PYTHONPATH"] = f"{root}:{env['PYTHONPATH']}" if env.get("PYTHONPATH") else root
    return df.mapInArrow(run, schema)
