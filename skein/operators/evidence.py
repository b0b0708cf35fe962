"""Claims as evidence: effective counts, trust shares, endorsement graphs, importance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..settings import DEFAULTS

PROVISIONAL = "provisional::"


def is_entity(node: Column) -> Column:
    """Neither null, nor empty, nor provisional."""
    return (F.coalesce(node, F.lit("")) != "") & ~F.coalesce(node, F.lit("")).startswith(PROVISIONAL)


def settled(claims: DataFrame) -> DataFrame:
    """Claims whose subject and object aren't provisional."""
    return claims.where(~F.coalesce("subject_id", F.lit("")).startswith(PROVISIONAL) & ~F.coalesce("object_id", F.lit("")).startswith(PROVISIONAL))


def story() -> Column:
    """What copies of one claim share: their group, or the claim itself."""
    return F.coalesce("dup_group", F.concat(F.lit("solo_"), "claim_id"))


def effective_counts(claims: DataFrame, group: Column | None = None) -> DataFrame:
    """``subject_id, m_raw, k_eff``: claims, and claims after a group of copies counts once."""
    return claims.groupBy("subject_id").agg(F.count("*").alias("m_raw"), F.count_distinct(story() if group is None else group).alias("k_eff"))


def k_of_m(claims: DataFrame) -> DataFrame:
    """Subjects with more than one claim, and how many of them are independent."""
    label = F.concat(F.lit("K="), "k_eff", F.lit(" of M="), "m_raw")
    return effective_counts(claims).where("m_raw > 1").withColumn("label", label)


def trusted_share(claims: DataFrame, threshold: float = DEFAULTS.trusted) -> DataFrame:
    """Share of a subject's credibility that trusted sources bring; 0 if there is none at all."""
    c = F.col("credibility")
    share = F.coalesce(F.try_divide(F.sum(F.when(c >= threshold, c).otherwise(0.0)), F.sum(c)), F.lit(0.0))
    return claims.groupBy("subject_id").agg(share.alias("trusted_share"))


def endorsements(claims: DataFrame) -> DataFrame:
    """Credible edges ``src, dst, weight``.

    A source's copies of one story add its best credibility once to a subject
    (two levels: the maximum in each group of copies, then the sum); a subject
    endorses its object by the sum of credibilities.
    """
    return edges(claims, story()).select("src", "dst", "weight")


def edges(claims: DataFrame, group: Column) -> DataFrame:
    """``src, dst, weight, n``: edges of :func:`endorsements`, with the number of their claims, which :func:`mentions` weigh by."""
    best = claims.groupBy("source_id", "subject_id", group.alias("g")).agg(F.max("credibility").alias("w"), F.count("*").alias("n"))
    best = best.select(F.col("source_id").alias("src"), F.col("subject_id").alias("dst"), "w", "n")
    related = claims.where(is_entity(F.col("object_id"))).select(F.col("subject_id").alias("src"), F.col("object_id").alias("dst"), F.col("credibility").alias("w"), F.lit(1).cast("long").alias("n"))
    return best.unionByName(related).groupBy("src", "dst").agg(F.sum("w").alias("weight"), F.sum("n").cast("double").alias("n"))


def named(ends: DataFrame) -> DataFrame:
    return ends.where((F.coalesce("src", F.lit("")) != "") & (F.coalesce("dst", F.lit("")) != ""))


def mentions(claims: DataFrame) -> DataFrame:
    """Naive edges: one unit for every claim, source to subject and subject to object."""
    a = claims.select(F.col("source_id").alias("src"), F.col("subject_id").alias("dst"))
    b = claims.select(F.col("subject_id").alias("src"), F.col("object_id").alias("dst"))
    return named(a.unionByName(b)).groupBy("src", "dst").agg(F.count("*").cast("double").alias("weight"))


def ranked(scores: DataFrame, score: str, key: str, out: str) -> DataFrame:
    """Ranks 1..N by falling score, then key.

    The order over all rows is a range partitioning with positions added up
    from the partitions' counts, and not one task's window.
    """
    parts = scores.repartitionByRange(F.col(score).desc(), F.col(key)).sortWithinPartitions(F.col(score).desc(), F.col(key))
    parts = parts.withColumn("_i", F.monotonically_increasing_id())
    from ..runtime import cut

    parts = cut(parts)
    within = Window.partitionBy("_p").orderBy("_i")
    parts = parts.withColumn("_p", F.shiftright("_i", 33))
    before = parts.groupBy("_p").count().withColumn("_before", F.coalesce(F.sum("count").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("count")
    return parts.withColumn("_r", F.row_number().over(within)).join(F.broadcast(before), "_p").withColumn(out, (F.col("_r") + F.col("_before")).cast("int")).drop("_i", "_p", "_r", "_before")


def importance(claims: DataFrame, seeds: DataFrame, top: int | None = None, **of_rank) -> DataFrame:
    """Naive and credible PageRank of the same claims side by side, restricted to entities and ranked anew, with evidence counts.

    ``top``: only the entities of the first credible ranks; the ranks are those
    among all, and evidence is counted for these. What all of it needs of the
    claims is written once; a group of copies is a 64-bit hash there, which
    only has to differ within a subject.
    """
    known, group = _slim(claims), F.col("g")
    both = _ranks(known, group, seeds, **of_rank)
    if top is not None:
        both = both.where(F.col("rank_credible") <= top)
        known = known.join(both.select(F.col("node").alias("subject_id")), "subject_id", "left_semi")
    extra = effective_counts(known, group).join(trusted_share(known), "subject_id")
    return both.join(extra, F.col("node") == F.col("subject_id"), "left").drop("subject_id")


def shifts(claims: DataFrame, seeds: DataFrame, **of_rank) -> DataFrame:
    """:func:`importance` of all entities without evidence counts."""
    return _ranks(_of_claims(claims), F.col("g"), seeds, **of_rank)


def _of_claims(claims: DataFrame) -> DataFrame:
    return settled(claims).select("source_id", "subject_id", "object_id", "credibility", F.xxhash64(story()).alias("g"))


def _slim(claims: DataFrame) -> DataFrame:
    from ..runtime import cut

    return cut(_of_claims(claims))


def links(claims: DataFrame, group: Column) -> DataFrame:
    """``src, dst, g, w``: each claim's link of its source to its subject, of a group of copies, and of that to its object."""
    told = lambda src, dst, g: F.struct(F.col(src).alias("src"), F.col(dst).alias("dst"), g.alias("g"), F.col("credibility").cast("double").alias("w"))
    of = told("source_id", "subject_id", group)
    return claims.select(F.inline(F.when(is_entity(F.col("object_id")), F.array(of, told("subject_id", "object_id", F.lit(None).cast("long")))).otherwise(F.array(of))))


def _ranks(known: DataFrame, group: Column, seeds: DataFrame, **of_rank) -> DataFrame:
    from . import claimgraph

    # each entity is the end of a link
    both = claimgraph.ranks(links(known, group), seeds, **of_rank)
    if both is None:
        both = _ranks_by_joins(known, group, seeds, **of_rank)
    both = ranked(ranked(both, "ppr_naive", "node", "rank_naive"), "ppr_credible", "node", "rank_credible")
    return both.withColumn("shift", F.col("rank_credible") - F.col("rank_naive"))


def _ranks_by_joins(known: DataFrame, group: Column, seeds: DataFrame, **of_rank) -> DataFrame:
    """Both scores of graphs of more nodes than the driver holds."""
    from ..runtime import cut
    from .ranking import pagerank

    known = cut(known)
    # of settled claims both graphs have the same edges, but for ends without a name
    both = cut(edges(known, group))
    naive = pagerank(named(both).select("src", "dst", F.col("n").alias("weight")), written=True, **of_rank)
    credible = pagerank(both.select("src", "dst", "weight"), seeds=seeds, written=True, **of_rank)
    entities = known.select(F.col("subject_id").alias("node")).unionByName(known.where(is_entity(F.col("object_id"))).select(F.col("object_id").alias("node"))).distinct()
    return entities.join(naive.withColumnRenamed("score", "ppr_naive"), "node").join(credible.withColumnRenamed("score", "ppr_credible"), "node")
