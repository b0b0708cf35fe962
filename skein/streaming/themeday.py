"""Incremental ingest: deduplication within the watermark, and per-day theme buckets upserted by micro-batch."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import themes
from ..runtime import cut


def landed(spark: SparkSession, path: str, schema, event_time: str = "event_time", watermark: str = "120 days") -> DataFrame:
    """Documents of a folder as a stream, each id once within the watermark (retention's 120 days)."""
    s = spark.readStream.schema(schema).json(path).withColumn("ts", F.to_timestamp(event_time))
    return s.withWatermark("ts", watermark).dropDuplicatesWithinWatermark(["doc_id"])


def daily(tagged: DataFrame, watermark: str = "120 days") -> DataFrame:
    """Counts of each theme and day (tumbling windows) of a stream of (ts, theme)."""
    w = tagged if not tagged.isStreaming else tagged.withWatermark("ts", watermark)
    return w.groupBy(F.window("ts", "1 day").alias("w"), "theme").agg(F.count("*").alias("count")).select("theme", F.col("w.start").cast("date").alias("day"), "count")


def upsert_days(stream: DataFrame, path: str, checkpoint: str, tags: dict[str, list[str]]):
    """Run what has landed (availableNow): tag, count, and add to the partitions of the days touched. The checkpoint is the cursor.

    A day's partition holds the counts of each batch that touched it. A batch
    rewrites the partitions of its own days only, and replaces its own rows in
    them, so one that is run again changes nothing.
    """

    def batch(df: DataFrame, batch_id: int) -> None:
        spark = df.sparkSession
        tagged = themes.tag(df, tags, carry=("ts",))
        new = daily(tagged).withColumnRenamed("count", "n").withColumn("batch", F.lit(batch_id).cast("long"))
        new = cut(new.select("theme", "n", "batch", "day"))
        try:
            held = spark.read.schema(new.schema).parquet(path)
            others = held.where(F.col("batch") != batch_id).join(F.broadcast(new.select("day").distinct()), "day", "left_semi")
            whole = cut(others.select("theme", "n", "batch", "day").unionByName(new))
        except AnalysisException:
            # nothing is there yet
            whole = new
        whole.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(path)

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_days(spark: SparkSession, path: str) -> DataFrame:
    """``theme, day, count`` of what has been written."""
    return spark.read.schema("theme string, n long, batch long, day date").parquet(path).groupBy("theme", "day").agg(F.sum("n").alias("count"))
