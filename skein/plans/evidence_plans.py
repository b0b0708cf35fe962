"""Temporal, evidence and importance plans over orders, line items and suppliers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import assemble, evidence, ranking, temporal, upsert
from . import adapter as A
from .registry import plan


@plan(f"WITH {A.CLAIMS} SELECT claim_id, source_id, subject_id, stance, CAST(knowledge_time AS DATE) AS known FROM claims WHERE knowledge_time <= TIMESTAMP '1997-06-30'")
def asof_claims(spark, d):
    return temporal.as_of(A.claims(spark, d), F.lit("1997-06-30").cast("timestamp_ntz")).select("claim_id", "source_id", "subject_id", "stance", F.col("knowledge_time").cast("date").alias("known"))


@plan(f"WITH {A.INTERVALS} SELECT surface_form, target_id FROM iv WHERE valid_from <= TIMESTAMP '1998-01-01' AND (valid_to IS NULL OR valid_to > TIMESTAMP '1998-01-01')")
def active_universe(spark, d):
    at = F.lit("1998-01-01").cast("timestamp_ntz")
    return temporal.active_universe(A.intervals(spark, d), at, None, "valid_from", "valid_to").select("surface_form", "target_id")


_PROBES = "pr AS (SELECT 'C' || c_custkey AS surface_form, unnest([TIMESTAMP '1996-01-01', TIMESTAMP '1998-07-01', TIMESTAMP '2000-12-31']) AS tm FROM customer)"


@plan(f"WITH {A.INTERVALS}, {_PROBES} SELECT pr.surface_form, CAST(tm AS DATE) AS at_day, target_id FROM pr JOIN iv ON pr.surface_form = iv.surface_form AND valid_from <= tm AND (valid_to IS NULL OR valid_to > tm)")
def alias_at(spark, d):
    at = F.explode(F.array(*[F.lit(t).cast("timestamp_ntz") for t in ("1996-01-01", "1998-07-01", "2000-12-31")]))
    probes = A.table(spark, d, "customer").select(F.concat(F.lit("C"), "c_custkey").alias("surface_form"), at.alias("at"))
    return temporal.alias_join(probes, A.intervals(spark, d)).select("surface_form", F.col("at").cast("date").alias("at_day"), "target_id")


_AT = "valid_from <= TIMESTAMP '{0}' AND (valid_to IS NULL OR valid_to > TIMESTAMP '{0}')"


@plan(f"WITH {A.INTERVALS} SELECT target_id FROM iv WHERE {_AT.format('1996-06-01')} EXCEPT SELECT target_id FROM iv WHERE {_AT.format('1999-06-01')}")
def survivorship_diff(spark, d):
    past, now = (F.lit(t).cast("timestamp_ntz") for t in ("1996-06-01", "1999-06-01"))
    return temporal.survivorship(A.intervals(spark, d), past, now, "target_id", known=None, start="valid_from", end="valid_to")


@plan(f"""WITH {A.INTERVALS}, p AS (SELECT surface_form, valid_from AS at FROM iv UNION SELECT surface_form, valid_to FROM iv WHERE valid_to IS NOT NULL)
SELECT p.surface_form, CAST(p.at AS DATE) AS at_day, count(*) AS n_active FROM p JOIN iv ON p.surface_form = iv.surface_form AND valid_from <= p.at AND (valid_to IS NULL OR valid_to > p.at) GROUP BY ALL""")
def boundary_probe(spark, d):
    """Probes exactly on the ends of intervals: starts count, ends don't."""
    iv = A.intervals(spark, d)
    probes = iv.select("surface_form", F.col("valid_from").alias("at")).unionByName(iv.where("valid_to is not null").select("surface_form", F.col("valid_to").alias("at"))).distinct()
    return temporal.alias_join(probes, iv).groupBy("surface_form", F.col("at").cast("date").alias("at_day")).agg(F.count("*").alias("n_active"))


@plan(f"WITH {A.INTERVALS} SELECT a.surface_form, a.target_id AS was, b.target_id AS became FROM iv a JOIN iv b ON a.surface_form = b.surface_form AND a.target_id <> b.target_id WHERE {_AT.format('1996-06-01').replace('valid', 'a.valid')} AND {_AT.format('2000-06-01').replace('valid', 'b.valid')}")
def surface_reuse(spark, d):
    """Surfaces that meant something else at two instants."""
    was, became = (temporal.active_universe(A.intervals(spark, d), F.lit(t).cast("timestamp_ntz"), None, "valid_from", "valid_to") for t in ("1996-06-01", "2000-06-01"))
    return was.select("surface_form", F.col("target_id").alias("was")).join(became.select("surface_form", F.col("target_id").alias("became")), "surface_form").where("was <> became")


_EFF = "count(*) AS m_raw, count(DISTINCT coalesce(dup_group, 'solo_' || claim_id)) AS k_eff"


@plan(f"WITH {A.CLAIMS} SELECT subject_id, m_raw, k_eff, 'K=' || k_eff || ' of M=' || m_raw AS label FROM (SELECT subject_id, {_EFF} FROM claims GROUP BY 1) WHERE m_raw > 1")
def k_of_m(spark, d):
    return evidence.k_of_m(A.claims(spark, d))


_SHARE = "round(coalesce(sum(CASE WHEN credibility >= 0.5 THEN credibility ELSE 0 END) / nullif(sum(credibility), 0), 0), 9)"


@plan(f"WITH {A.CLAIMS} SELECT subject_id, {_SHARE} AS trusted_share FROM claims GROUP BY 1")
def trusted_share(spark, d):
    return evidence.trusted_share(A.claims(spark, d)).select("subject_id", F.round("trusted_share", 9).alias("trusted_share"))


@plan(f"WITH {A.CLAIMS} SELECT subject_id, {_SHARE} AS trusted_share, count(*) AS m_raw FROM claims GROUP BY 1 HAVING count(*) >= 3 ORDER BY trusted_share, subject_id LIMIT 5")
def least_trusted(spark, d):
    c = A.claims(spark, d)
    shares = evidence.trusted_share(c).withColumn("trusted_share", F.round("trusted_share", 9))
    return assemble.least_trusted(shares, evidence.effective_counts(c)).select("subject_id", "trusted_share", "m_raw")


_SETTLED = "settled AS (SELECT * FROM claims WHERE NOT starts_with(subject_id, 'provisional::') AND NOT starts_with(object_id, 'provisional::'))"
_ENDORSE = """ce AS (SELECT src, dst, sum(w) AS weight FROM (
    SELECT source_id AS src, subject_id AS dst, max(credibility) AS w FROM settled GROUP BY source_id, subject_id, coalesce(dup_group, 'solo_' || claim_id)
    UNION ALL SELECT subject_id, object_id, credibility FROM settled WHERE object_id <> '') GROUP BY 1, 2)"""
_NAIVE = """ne AS (SELECT src, dst, CAST(count(*) AS DOUBLE) AS weight FROM (SELECT source_id AS src, subject_id AS dst FROM settled
    UNION ALL SELECT subject_id, object_id FROM settled WHERE object_id <> '') GROUP BY 1, 2)"""


@plan(f"WITH {A.CLAIMS}, {_SETTLED}, {_ENDORSE} SELECT src, dst, round(weight, 6) AS weight FROM ce")
def endorse_edges(spark, d):
    return evidence.endorsements(evidence.settled(A.claims(spark, d))).select("src", "dst", F.round("weight", 6).alias("weight"))


@plan(f"WITH {A.CLAIMS}, {_SETTLED}, {_NAIVE} SELECT * FROM ne")
def naive_edges(spark, d):
    return evidence.mentions(evidence.settled(A.claims(spark, d)))


#: Rounds that the SQL unrolls; it takes the first that the stopping rule accepts.
ROUNDS = 130


def _rank_sql(edges: str, seeded: bool, p: str) -> str:
    """Unrolled power iteration as CTEs; ``{p}r`` is the round at which the change is below N * 1e-10."""
    seed = "CASE WHEN node IN (SELECT source_id FROM src WHERE credibility >= 0.92) THEN 1.0 ELSE 0.0 END" if seeded else "1.0"
    out = f"""{p}n0 AS MATERIALIZED (SELECT node, {seed} AS t FROM (SELECT src AS node FROM {edges} UNION SELECT dst FROM {edges})),
{p}n AS MATERIALIZED (SELECT node, row_number() OVER (ORDER BY node) AS k, t / (SELECT sum(t) FROM {p}n0) AS t, node IN (SELECT src FROM {edges}) AS sends FROM {p}n0),
{p}g AS MATERIALIZED (SELECT x.k AS a, y.k AS b, weight / sum(weight) OVER (PARTITION BY src) AS p FROM {edges} JOIN {p}n x ON x.node = src JOIN {p}n y ON y.node = dst),
{p}r0 AS MATERIALIZED (SELECT k, sends, t, 1.0::DOUBLE / (SELECT count(*) FROM {p}n) AS score, 1.0::DOUBLE AS old FROM {p}n)"""
    for i in range(1, ROUNDS + 1):
        out += f""",
{p}r{i} AS MATERIALIZED (SELECT n.k, sends, t, 0.85 * (coalesce(s.got, 0) + (SELECT coalesce(sum(score), 0) FROM {p}r{i - 1} WHERE NOT sends) * t) + 0.15 * t AS score, n.score AS old
  FROM {p}r{i - 1} n LEFT JOIN (SELECT b, sum(score * p) AS got FROM {p}g JOIN {p}r{i - 1} ON k = a GROUP BY b) s ON n.k = s.b)"""
    change = " UNION ALL ".join(f"SELECT {i} AS i, sum(abs(score - old)) AS c FROM {p}r{i}" for i in range(1, ROUNDS + 1))
    taken = " UNION ALL ".join(f"SELECT k, score FROM {p}r{i} WHERE (SELECT i FROM {p}stop) = {i}" for i in range(1, ROUNDS + 1))
    return out + f""",
{p}stop AS MATERIALIZED (SELECT min(i) AS i FROM ({change}) WHERE c < (SELECT count(*) FROM {p}n) * 1e-10),
{p}r AS MATERIALIZED (SELECT node, x.score FROM ({taken}) x JOIN {p}n USING (k))"""


@plan(f"WITH {A.CLAIMS}, {_SETTLED}, {_NAIVE}, {_rank_sql('ne', False, 'a')} SELECT node, round(score, 9) AS score FROM ar")
def naive_pagerank(spark, d):
    return ranking.pagerank(evidence.mentions(evidence.settled(A.claims(spark, d)))).select("node", F.round("score", 9).alias("score"))


def _seeds(spark, d):
    return A.sources(spark, d).where("is_trust_seed").select(F.col("source_id").alias("node"))


@plan(f"WITH {A.CLAIMS}, {_SETTLED}, {_ENDORSE}, {_rank_sql('ce', True, 'b')} SELECT node, round(score, 9) AS score FROM br")
def credible_pagerank(spark, d):
    return ranking.pagerank(evidence.endorsements(evidence.settled(A.claims(spark, d))), seeds=_seeds(spark, d)).select("node", F.round("score", 9).alias("score"))


def importance_report(spark, d):
    """The flagship: the twenty most credible entities, with naive rank, evidence counts and trust."""
    cols = ["node", F.round("ppr_naive", 7).alias("ppr_naive"), F.round("ppr_credible", 7).alias("ppr_credible"), "m_raw", "k_eff", F.round("trusted_share", 6).alias("trusted_share"), "rank_credible"]
    return evidence.importance(A.claims(spark, d), _seeds(spark, d), top=20).select(*cols)


_IMP = f"""WITH {A.CLAIMS}, {_SETTLED}, {_NAIVE}, {_ENDORSE}, {_rank_sql("ne", False, "a")}, {_rank_sql("ce", True, "b")},
ents AS (SELECT DISTINCT subject_id AS node FROM settled UNION SELECT DISTINCT object_id FROM settled WHERE object_id <> ''),
rk AS (SELECT node, a.score AS ppr_naive, b.score AS ppr_credible, CAST(row_number() OVER (ORDER BY a.score DESC, node) AS INTEGER) AS rank_naive,
  CAST(row_number() OVER (ORDER BY b.score DESC, node) AS INTEGER) AS rank_credible FROM ents JOIN ar a USING (node) JOIN br b USING (node)),
ev AS (SELECT subject_id, {_EFF}, {_SHARE} AS trusted_share FROM settled GROUP BY 1)"""
plan(f"{_IMP} SELECT node, round(ppr_naive, 7) AS ppr_naive, round(ppr_credible, 7) AS ppr_credible, m_raw, k_eff, round(trusted_share, 6) AS trusted_share, rank_credible FROM rk LEFT JOIN ev ON node = subject_id WHERE rank_credible <= 20")(importance_report)


@plan(f"{_IMP} SELECT node, rank_credible - rank_naive AS shift FROM rk WHERE rank_credible > rank_naive ORDER BY shift DESC, node LIMIT 1")
def most_demoted(spark, d):
    return assemble.most_demoted(evidence.shifts(A.claims(spark, d), _seeds(spark, d))).select("node", "shift")


@plan(f"""WITH {A.CLAIMS} SELECT subject_id, string_agg(DISTINCT source_id, '|' ORDER BY source_id) AS sources, count(DISTINCT source_id) AS n_sources,
  count(*) FILTER (relation = 'supplies') AS n_relations, string_agg(claim_id, '|' ORDER BY claim_id) FILTER (object_id <> '') AS citations FROM claims GROUP BY 1""")
def entity_detail(spark, d):
    joined = lambda c: F.when(F.size(c) > 0, F.array_join(c, "|"))
    return assemble.details(A.claims(spark, d)).withColumn("sources", joined("sources")).withColumn("citations", joined("citations"))


@plan(f"""WITH {A.CLAIMS}, r AS (SELECT *, row_number() OVER (PARTITION BY subject_id ORDER BY claim_id) AS k FROM claims WHERE stance = 'bearish' AND relation <> 'sentiment')
SELECT subject_id, string_agg(claim_id, '|' ORDER BY claim_id) AS flags FROM r WHERE k <= 3 GROUP BY 1""")
def flags_by_entity(spark, d):
    return assemble.flags(A.claims(spark, d)).withColumn("flags", F.array_join("flags", "|"))


@plan(f"WITH {A.CLAIMS} SELECT source_id, min(claim_id) AS first_claim FROM claims GROUP BY 1")
def first_register(spark, d):
    return upsert.first_by(A.claims(spark, d), "source_id", "claim_id").select("source_id", F.col("claim_id").alias("first_claim"))


@plan(f"WITH {A.CLAIMS} SELECT credibility_class, stance, count(*) AS n, count(DISTINCT subject_id) AS subjects, max(CAST(knowledge_time AS DATE)) AS latest FROM claims JOIN src USING (source_id) GROUP BY ALL")
def claims_by_class(spark, d):
    j = assemble.with_source(A.claims(spark, d), A.sources(spark, d), ["credibility_class"])
    return j.groupBy("credibility_class", "stance").agg(F.count("*").alias("n"), F.count_distinct("subject_id").alias("subjects"), F.max(F.col("knowledge_time").cast("date")).alias("latest"))


@plan(f"WITH {A.CLAIMS} SELECT count(*) AS claims, round(avg(CASE WHEN stance = 'neutral' THEN 1.0 ELSE 0.0 END), 6) AS neutral_share, round(avg(CASE WHEN stance = 'bullish' THEN 1.0 ELSE 0.0 END), 6) AS bullish_share FROM claims")
def soft_metrics(spark, d):
    return assemble.stance_shares(A.claims(spark, d))


@plan(f"WITH {A.CLAIMS} SELECT count(DISTINCT lower(trim(subject_id))) AS n_entities FROM claims")
def naive_resolve(spark, d):
    from ..operators import resolve

    return resolve.naive_resolve(A.claims(spark, d).select(F.col("subject_id").alias("surface")))


@plan(f"""WITH {A.CLAIMS} SELECT s_name AS source_name, coalesce(c_name, p_name) AS ent, count(*) AS n
FROM claims JOIN supplier ON source_id = 'S' || s_suppkey LEFT JOIN part ON subject_id = 'P' || p_partkey AND p_partkey % 2 = 0 LEFT JOIN customer ON subject_id = 'P' || c_custkey AND c_custkey % 2 = 1 GROUP BY ALL""")
def claims_with_entity(spark, d):
    """Claims with their source's name, and the name of the issuer or macro series that they are about."""
    issuers = A.table(spark, d, "part").where("p_partkey % 2 = 0").select(F.concat(F.lit("P"), "p_partkey").alias("issuer_id"), F.col("p_name").alias("name"))
    macros = A.table(spark, d, "customer").where("c_custkey % 2 = 1").select(F.concat(F.lit("P"), "c_custkey").alias("indicator_id"), F.col("c_name").alias("name"))
    return assemble.with_entity(A.claims(spark, d), A.sources(spark, d), issuers, macros).groupBy("source_name", "ent").agg(F.count("*").alias("n"))
