"""Write semantics on plain tables: patch upserts, guarded edges, retention, uniqueness, partition overwrite."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import cut


def upsert_patch(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """``old`` with the non-null fields of ``new``; rows and columns of either side stay. One full outer join on the keys."""
    fields = list(dict.fromkeys(c for c in [*old.columns, *new.columns] if c not in keys))
    o, n = old.alias("o"), new.alias("n")
    on = [F.col(f"o.{k}") == F.col(f"n.{k}") for k in keys]
    pick = lambda c: F.coalesce(*[F.col(f"{side}.{c}") for side, df in (("n", new), ("o", old)) if c in df.columns]).alias(c)
    return o.join(n, on, "full_outer").select(*[pick(c) for c in [*keys, *fields]])


def upsert_edges(old: DataFrame, new: DataFrame, nodes: DataFrame, keys: tuple[str, str] = ("src", "dst"), node: str = "node") -> DataFrame:
    """Upsert only edges whose ends both exist."""
    for k in keys:
        new = new.join(nodes.select(F.col(node).alias(k)).distinct(), k, "left_semi")
    return upsert_patch(old, new, list(keys))


def link_if_there(rows: DataFrame, nodes: DataFrame, target: str, node: str = "node") -> DataFrame:
    """Every row, with a flag whether its target exists (the edge is written only then)."""
    there = nodes.select(F.col(node).alias(target)).distinct().withColumn("linked", F.lit(True))
    return rows.join(there, target, "left").withColumn("linked", F.coalesce("linked", F.lit(False)))


def keep_lowest(df: DataFrame, content: list[str], key: str) -> DataFrame:
    """Of rows with equal content the one with the smallest key."""
    first = df.groupBy(*content).agg(F.min(key).alias(key))
    return df.join(first.select(key).distinct(), key, "left_semi")


def prune_older(df: DataFrame, day: str, as_of: str, days: int, only=None) -> DataFrame:
    """What retention keeps: rows no older than ``days``, and all that ``only`` (a condition) doesn't cover. Undated rows stay."""
    old = F.coalesce(F.datediff(F.lit(as_of).cast("date"), F.col(day).cast("date")) > days, F.lit(False))
    return df.where(~(old & (F.lit(True) if only is None else only)))


def prune_universe(df: DataFrame, members: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Rows in and rows out of the universe."""
    return df.join(members, key, "left_semi"), df.join(members, key, "left_anti")


def assert_unique(df: DataFrame, keys: list[str]) -> DataFrame:
    """``df``, or an error that names a repeated key."""
    twice = df.groupBy(*keys).count().where("count > 1").take(1)
    if twice:
        raise ValueError(f"{keys} repeat: {twice[0]}")
    return df


def append_new(df: DataFrame, existing: DataFrame, key: str) -> DataFrame:
    """Rows to append to a write-once table: ids that it doesn't have, one row for each, without private columns (``_`` first)."""
    public = df.select(*[c for c in df.columns if not c.startswith("_")])
    return public.join(existing.select(key), key, "left_anti").dropDuplicates([key])


def stamp(nodes: DataFrame, values: DataFrame, key: str, path: list[tuple[DataFrame, str, str]] = ()) -> DataFrame:
    """``nodes`` with the attributes of ``values`` on the rows that match; others keep theirs.

    path: links (table, from, to) that lead from the key of ``values`` to that
    of the nodes, such as listing to security to issuer.
    """
    for link, start, end in path:
        values = values.join(link.select(F.col(start).alias(key), F.col(end).alias("_to")), key).drop(key).withColumnRenamed("_to", key)
    return upsert_patch(nodes, values.dropDuplicates([key]).join(nodes.select(key), key, "left_semi"), [key])


def replace(df: DataFrame, path: str) -> DataFrame:
    """Write ``df`` in place of all that is at ``path``, and read it. ``df`` may itself come from there: it is written beside it first."""
    held = cut(df)
    held.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def would_prune(df: DataFrame, kept: DataFrame) -> DataFrame:
    """A dry run: ``before, kept, pruned`` of a retention, nothing is written."""
    n = lambda x, name: x.agg(F.count("*").alias(name))
    return n(df, "before").join(n(kept, "kept")).withColumn("pruned", F.col("before") - F.col("kept"))


def gate_universe(members: DataFrame | None, issuers: DataFrame, securities: DataFrame, listings: DataFrame, aliases: DataFrame) -> dict[str, DataFrame]:
    """The four tables restricted to members (``issuer_id``); without a list all of them, as they are."""
    tables = {"issuers": issuers, "securities": securities, "listings": listings, "aliases": aliases}
    if members is None:
        return tables
    ids = members.select("issuer_id").distinct()
    kept = securities.join(ids, "issuer_id", "left_semi")
    return {
        "issuers": issuers.join(ids, "issuer_id", "left_semi"),
        "securities": kept,
        "listings": listings.join(kept.select("security_id").distinct(), "security_id", "left_semi"),
        "aliases": aliases.join(ids.withColumnRenamed("issuer_id", "target_id"), "target_id", "left_semi"),
    }


def long_enough(bars: DataFrame, least: int = 200, key: str = "series") -> DataFrame:
    """Only series of at least ``least`` bars: what a backfill writes."""
    return bars.join(bars.groupBy(key).agg(F.count("*").alias("_n")).where(F.col("_n") >= least).select(key), key, "left_semi")


def first_by(df: DataFrame, key: str, *order) -> DataFrame:
    """The first row of each key in the given order."""
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("_r = 1").drop("_r")


def write_days(df: DataFrame, path: str, day: str) -> None:
    """Overwrite only the partitions of the days in ``df``; a rerun of a day replaces it."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(day).parquet(path)
