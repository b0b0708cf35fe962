"""Writers of published artifacts and backups: JSON documents, dumps, dated snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def json_document(df: DataFrame, path: str) -> None:
    """Rows as JSON lines, nested columns and all; a retried task rewrites its own part only."""
    df.select(F.to_json(F.struct("*")).alias("value")).write.mode("overwrite").text(path)


def dump(tables: dict[str, DataFrame], path: str) -> None:
    """A full backup, a gzip JSON folder for each table."""
    for name, df in tables.items():
        df.write.mode("overwrite").option("compression", "gzip").json(f"{path}/{name}")


def restore(spark: SparkSession, path: str, schemas: dict) -> dict[str, DataFrame]:
    """The tables of a backup as they were dumped."""
    return {name: spark.read.schema(schema).json(f"{path}/{name}") for name, schema in schemas.items()}


def snapshot(df: DataFrame, path: str, as_of: str) -> None:
    """Adds or replaces the partition of one day."""
    df.withColumn("as_of_day", F.lit(as_of[:10])).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("as_of_day").parquet(path)


def reload(spark: SparkSession, backup: str, target: str, schemas: dict, allowed: bool = False) -> dict[str, int]:
    """Wipe the tables below ``target`` and load the backup's: rows of each. Refuses unless ``allowed`` says so.

    Every table of the backup is read and counted before the first one is wiped.
    """
    if not allowed:
        raise PermissionError(f"{target} would be wiped; say allowed=True")
    tables = restore(spark, backup, schemas)
    counts = {name: df.count() for name, df in tables.items()}
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{target}/{name}")
    return counts
