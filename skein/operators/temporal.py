"""Point-in-time reads: knowledge filters, half-open validity, aliases at an instant."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def as_of(df: DataFrame, instant, known: str = "knowledge_time") -> DataFrame:
    """Rows known at the instant (inclusive). ISO texts compare as texts, timestamps as such; both reach the scan as pushed filters."""
    return df.where(F.col(known) <= F.lit(instant))


def valid(instant: Column, start: str = "valid_from", end: str = "valid_to") -> Column:
    """``start <= instant < end``; a null end is open."""
    return (F.col(start) <= instant) & (F.col(end).isNull() | (F.col(end) > instant))


def active_universe(df: DataFrame, instant, known: str | None = "knowledge_time", start: str = "status_valid_from", end: str = "status_valid_to") -> DataFrame:
    """What was known and valid at the instant."""
    return (as_of(df, instant, known) if known else df).where(valid(F.lit(instant), start, end))


def alias_at(aliases: DataFrame, surface: str, instant) -> DataFrame:
    """The aliases of one surface form at one instant."""
    return aliases.where(F.col("surface_form") == surface).where(valid(F.lit(instant)))


def alias_join(probes: DataFrame, aliases: DataFrame, surface: str = "surface_form", at: str = "at") -> DataFrame:
    """Every probe (surface, instant) with the aliases valid then: an equi-join on the surface with the interval as residual."""
    a = aliases.select(F.col("surface_form").alias("_s"), "target_id", "valid_from", "valid_to")
    return probes.join(a, (F.col(surface) == F.col("_s")) & valid(F.col(at))).drop("_s")


def scd2(df: DataFrame, key: str, order: list[str], start: str) -> DataFrame:
    """Successive versions of a key as half-open intervals: each ends where the next begins."""
    from pyspark.sql import Window

    return df.withColumn("valid_from", F.col(start)).withColumn("valid_to", F.lead(start).over(Window.partitionBy(key).orderBy(*order)))


def survivorship(df: DataFrame, past, now, key: str, **of_universe) -> DataFrame:
    """Keys in the universe of the past that aren't in today's."""
    return active_universe(df, past, **of_universe).select(key).subtract(active_universe(df, now, **of_universe).select(key))
