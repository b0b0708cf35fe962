"""Joins that put reports together: sources, prices, peers, paths, display names, reserved places."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .themes import top_by
from .upsert import first_by


def with_source(claims: DataFrame, sources: DataFrame, fields: Sequence[str], key: str = "source_id") -> DataFrame:
    """Claims with fields of their source; null where it isn't known."""
    return claims.join(sources.select(key, *fields).dropDuplicates([key]), key, "left")


def with_entity(claims: DataFrame, sources: DataFrame, issuers: DataFrame, macros: DataFrame) -> DataFrame:
    """Claims whose source is known, with ``source_name`` and the name of the issuer or macro series they are about (``ent``), if there is one.

    issuers: (issuer_id, name); macros: (indicator_id, name). A series without a name goes by its id.
    """
    named = issuers.select(F.col("issuer_id").alias("subject_id"), F.col("name").alias("ent")).unionByName(macros.select(F.col("indicator_id").alias("subject_id"), F.coalesce("name", "indicator_id").alias("ent")))
    return claims.join(sources.select("source_id", F.col("name").alias("source_name")), "source_id").join(named, "subject_id", "left")


def priced(issuers: DataFrame, prices: DataFrame, sectors: DataFrame, key: str = "issuer_id", none: str = "(none)") -> DataFrame:
    """Issuers that have prices, with their sector if there is one."""
    return issuers.join(prices, key).join(sectors.select(key, "sector"), key, "left").withColumn("sector", F.coalesce("sector", F.lit(none)))


def chain(start: DataFrame, *links: tuple[DataFrame, str, str]) -> DataFrame:
    """Equi-joins along a path: (table, column so far, its column)."""
    for table, here, there in links:
        start = start.join(table, F.col(here) == F.col(there))
    return start


def ids_by_name(rows: DataFrame, names: DataFrame, name: str, key: str = "id") -> DataFrame:
    """Rows whose display name is known, with its id; names: (name, id), the largest id of equal names."""
    ids = first_by(names.select(F.col(names.columns[0]).alias("_name"), F.col(names.columns[1]).alias(key)), "_name", F.desc(key))
    return rows.join(ids, F.col(name) == F.col("_name")).drop("_name")


def ranked_issuers(results: DataFrame, issuers: DataFrame, sectors: DataFrame, claims: DataFrame) -> DataFrame:
    """Results met with issuers by name, with sector and number of claims (0 kept)."""
    n = claims.groupBy("subject_id").agg(F.count("*").alias("n_claims"))
    got = results.join(issuers.select("issuer_id", "name"), results["entity"] == F.col("name")).drop("name")
    return got.join(sectors.select("issuer_id", "sector"), "issuer_id", "left").join(n, F.col("issuer_id") == F.col("subject_id"), "left").drop("subject_id").withColumn("n_claims", F.coalesce("n_claims", F.lit(0)))


def peers(rows: DataFrame, key: str, group: str, top: int = 6) -> DataFrame:
    """``key, peers``: the first ``top`` others of the same group, from each group's ``top + 1`` smallest keys; no self-join."""
    few = top_by(rows.select(key, group).distinct(), [group], [F.asc(key)], top + 1).groupBy(group).agg(F.array_sort(F.collect_list(key)).alias("_few"))
    others = F.slice(F.filter("_few", lambda k: k != F.col(key)), 1, top)
    return rows.select(key, group).join(few, group).select(key, others.alias("peers")).where(F.size("peers") > 0)


def with_ends(top: DataFrame, rows: DataFrame, ends: DataFrame, key: str) -> DataFrame:
    """A top list, and those rows of ``ends`` (keys) that it misses."""
    more = rows.join(ends.select(key).distinct(), key, "left_semi").join(top.select(key), key, "left_anti")
    return top.unionByName(more.select(*top.columns))


def top_tags(tags: DataFrame, key: str, tag: str, weight: str, top: int = 3) -> DataFrame:
    """``key, tags``: the ``top`` tags of each key by weight, then by falling name."""
    best = top_by(tags, [key], [F.desc(weight), F.desc(tag)], top, "_k")
    return best.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("_k", tag))), lambda x: x[tag]).alias("tags"))


def attach(rows: DataFrame, values: DataFrame, name: str, fields: Sequence[str]) -> DataFrame:
    """Rows with the fields of the value of their name; null without one."""
    return rows.join(values.select(name, *fields).dropDuplicates([name]), name, "left")


def optional_count(hubs: DataFrame, rows: DataFrame, key: str, at: str, out: str = "n") -> DataFrame:
    """Hubs with how many rows point at them, zeros kept."""
    n = rows.groupBy(F.col(at).alias("_at")).agg(F.count("*").alias(out))
    return hubs.join(n, F.col(key) == F.col("_at"), "left").drop("_at").withColumn(out, F.coalesce(out, F.lit(0)))


def hub_counts(links: DataFrame, hub: str, key: str) -> DataFrame:
    """How many different keys each hub has."""
    return links.groupBy(hub).agg(F.count_distinct(key).alias("n"))


def reserved(rows: DataFrame, key: str, places: Sequence[tuple[str, Column, int, Sequence[Column]]]) -> DataFrame:
    """``key, market``: for each market (name, condition, places, order) its first rows; a bag of all."""
    out = None
    for name, cond, n, order in places:
        own = rows.where(cond).orderBy(*order).limit(n).select(key, F.lit(name).alias("market"))
        out = own if out is None else out.unionByName(own)
    return out


def among_top(rows: DataFrame, ranked: DataFrame, key: str, order: Sequence[Column], top: int) -> DataFrame:
    """Rows whose key is among the first ``top`` of the ranking."""
    return rows.join(F.broadcast(ranked.orderBy(*order).limit(top).select(key)), key, "left_semi")


def by_market_cap(corps: DataFrame, listing: DataFrame, top: int) -> DataFrame:
    """The ``top`` listed companies by market value, with venue: master (stock_code) met with the market's table (code, cap, market) on six digits."""
    cap = listing.where(F.col("cap").isNotNull() & ~F.isnan(F.col("cap").cast("double")) & (F.col("cap") != 0))
    venue = F.when(F.contains(F.upper("market"), F.lit("KOSDAQ")), "KQ").otherwise("KS")
    cap = cap.select(F.lpad(F.col("code").cast("string"), 6, "0").alias("stock_code"), F.col("cap").cast("double").alias("market_cap"), venue.alias("venue")).dropDuplicates(["stock_code"])
    return corps.join(cap, "stock_code").orderBy(F.desc("market_cap"), "stock_code").limit(top)


def strongest(pairs: DataFrame, value: str = "corr", top: int = 12) -> DataFrame:
    """The pairs with the largest absolute value."""
    return pairs.orderBy(F.desc(F.abs(value)), *[F.asc(c) for c in pairs.columns if c != value]).limit(top)


def node_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """``label, n`` of each table."""
    out = None
    for name, df in tables.items():
        own = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("label"), "n")
        out = own if out is None else out.unionByName(own)
    return out


def details(claims: DataFrame) -> DataFrame:
    """Per subject its sources, how many, its relations and the claims that name an object, as ordered lists."""
    related = F.collect_list(F.when(F.coalesce("object_id", F.lit("")) != "", F.col("claim_id")))
    return claims.groupBy("subject_id").agg(F.array_sort(F.collect_set("source_id")).alias("sources"), F.count_distinct("source_id").alias("n_sources"), F.count_if(F.col("relation") == "supplies").alias("n_relations"), F.array_sort(related).alias("citations"))


def flags(claims: DataFrame, top: int = 3) -> DataFrame:
    """Per subject the first bearish claims that aren't mere sentiment."""
    bad = claims.where("stance = 'bearish' and relation <> 'sentiment'")
    return top_by(bad, ["subject_id"], [F.asc("claim_id")], top).groupBy("subject_id").agg(F.array_sort(F.collect_list("claim_id")).alias("flags"))


def stance_shares(claims: DataFrame, stances: Sequence[str] = ("neutral", "bullish")) -> DataFrame:
    """How many claims there are, and the share of each stance."""
    share = lambda s: F.round(F.avg(F.when(F.col("stance") == s, 1.0).otherwise(0.0)), 6).alias(f"{s}_share")
    return claims.agg(F.count("*").alias("claims"), *map(share, stances))


def least_trusted(shares: DataFrame, counts: DataFrame, least: int = 3, top: int = 5) -> DataFrame:
    """Covered subjects (``m_raw`` at least ``least``) with the smallest trusted share."""
    got = shares.join(counts, "subject_id").where(F.col("m_raw") >= least)
    return got.orderBy("trusted_share", "subject_id").limit(top)


def most_demoted(ranks: DataFrame) -> DataFrame:
    """The entity that the credible rank moves down most, if there is one."""
    return ranks.where("shift > 0").orderBy(F.desc("shift"), "node").limit(1)
