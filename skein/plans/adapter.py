"""The engine's entities as views of the benchmark tables, for Spark and, told independently, for DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import temporal
from ..settings import CREDIBILITY

CLASSES = ("regulator", "filing", "whistleblower", "major_news", "analyst", "community", "anon")
#: Sources that are broadcast at most (some 60 MB); line items up to which Spark chooses how they are joined.
MOST_SOURCES, MOST_JOINED = 500_000, 5_000_000


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def sources(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers as sources; their class cycles through the priors."""
    kind = F.get(F.array(*[F.lit(c) for c in CLASSES]), (F.col("s_suppkey") % 7).cast("int"))
    prior = F.get(F.array(*[F.lit(CREDIBILITY[c]) for c in CLASSES]), (F.col("s_suppkey") % 7).cast("int"))
    return table(spark, d, "supplier").select(F.concat(F.lit("S"), "s_suppkey").alias("source_id"), F.col("s_name").alias("name"), kind.alias("credibility_class"), prior.alias("credibility"), (prior >= 0.92).alias("is_trust_seed"))


def claims(spark: SparkSession, d: str) -> DataFrame:
    """Line items as claims of their supplier about their part, some of them about a customer too."""
    li, o = table(spark, d, "lineitem"), table(spark, d, "orders")
    # an order comes once, so no task of the hashed side is larger than others; nothing is sorted
    o = o.hint("shuffle_hash") if li.count() > MOST_JOINED else o
    j = li.join(o, F.col("l_orderkey") == F.col("o_orderkey"))
    part = F.concat(F.when(F.col("l_partkey") % 50 == 0, "provisional::P").otherwise("P"), "l_partkey")
    stance = F.when(F.col("l_returnflag") == "R", "bearish").when(F.col("l_returnflag") == "A", "bullish").otherwise("neutral")
    c = j.select(
        F.concat_ws("#", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("claim_id"),
        F.concat(F.lit("S"), "l_suppkey").alias("source_id"),
        part.alias("subject_id"),
        F.when(F.col("o_custkey") % 3 == 0, F.concat(F.lit("C"), "o_custkey")).otherwise("").alias("object_id"),
        F.when(F.col("o_custkey") % 3 == 0, "supplies").otherwise("sentiment").alias("relation"),
        stance.alias("stance"),
        F.when(F.col("l_returnflag") == "R", F.concat(F.lit("dup_"), "l_orderkey")).alias("dup_group"),
        F.col("o_orderdate").alias("knowledge_time"),
        F.col("l_shipdate").alias("event_time"),
    )
    priors = sources(spark, d).select("source_id", "credibility")
    return c.join(F.broadcast(priors) if priors.count() <= MOST_SOURCES else priors, "source_id")


def intervals(spark: SparkSession, d: str) -> DataFrame:
    """Orders as versions of their customer: valid from one order to the next."""
    v = temporal.scd2(table(spark, d, "orders"), "o_custkey", ["o_orderdate", "o_orderkey"], "o_orderdate")
    return v.select(F.concat(F.lit("C"), "o_custkey").alias("surface_form"), F.concat(F.lit("O"), "o_orderkey").alias("target_id"), "valid_from", "valid_to")


#: Small themes over the invented prose, and word lists of its words (parameters of the plans).
THEMES = {"ai": ["tion", "ther"], "fx": ["with"], "oil": ["was"], "rates": ["from", "this"], "trade": ["que", "los"], "ma": ["der", "und"]}
BULL, BEAR = ("that", "with"), ("this", "from")
MONTHS = "2024-01-30"


def docs(spark: SparkSession, d: str) -> DataFrame:
    """Documents with a day of January 2024 and a stance."""
    from ..functions import text

    x = table(spark, d, "documents").select("doc_id", "text", "lang", "source")
    return x.withColumn("day", F.date_add(F.lit("2024-01-01").cast("date"), (F.col("doc_id") % 30).cast("int"))).withColumn("stance", text.stance(F.col("text"), BULL, BEAR)).withColumn("ent", F.concat(F.lit("E"), F.col("doc_id") % 40))


def bars(spark: SparkSession, d: str) -> DataFrame:
    """Mean value (of whole hundredths, so that no order of summing matters) and number of events by type and day."""
    e = table(spark, d, "events")
    return e.groupBy(F.col("event_type").alias("series"), F.to_date("ts").alias("day")).agg((F.sum(F.round(F.col("value") * 100).cast("long")) / F.count("*") / 100).alias("close"), F.count("*").cast("double").alias("volume"))


def monthly(spark: SparkSession, d: str) -> DataFrame:
    """Revenue by the supplier's nation and month, sector = region: the long series."""
    li, s = table(spark, d, "lineitem"), table(spark, d, "supplier")
    n = table(spark, d, "nation")
    j = li.join(s, F.col("l_suppkey") == F.col("s_suppkey")).join(n, F.col("s_nationkey") == F.col("n_nationkey"))
    return j.groupBy(F.col("n_name").alias("series"), F.col("n_regionkey").cast("string").alias("sector"), F.to_date(F.date_trunc("month", "l_shipdate")).alias("day")).agg(F.round(F.sum("l_extendedprice"), 2).alias("close"), F.count("*").cast("double").alias("volume"))


_CLASS = "['regulator','filing','whistleblower','major_news','analyst','community','anon'][1 + s_suppkey % 7]"
_PRIOR = "CAST([1.0,0.92,0.7,0.6,0.5,0.2,0.1][1 + s_suppkey % 7] AS DOUBLE)"
SOURCES = f"src AS (SELECT 'S' || s_suppkey AS source_id, {_CLASS} AS credibility_class, {_PRIOR} AS credibility FROM supplier)"
CLAIMS = f"""{SOURCES}, claims AS (
  SELECT l_orderkey || '#' || l_linenumber || '#' || l_partkey || '#' || l_suppkey AS claim_id, source_id,
    CASE WHEN l_partkey % 50 = 0 THEN 'provisional::P' ELSE 'P' END || l_partkey AS subject_id,
    CASE WHEN o_custkey % 3 = 0 THEN 'C' || o_custkey ELSE '' END AS object_id,
    CASE WHEN o_custkey % 3 = 0 THEN 'supplies' ELSE 'sentiment' END AS relation,
    CASE l_returnflag WHEN 'R' THEN 'bearish' WHEN 'A' THEN 'bullish' ELSE 'neutral' END AS stance,
    CASE WHEN l_returnflag = 'R' THEN 'dup_' || l_orderkey END AS dup_group,
    o_orderdate AS knowledge_time, l_shipdate AS event_time, credibility
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN src ON source_id = 'S' || l_suppkey)"""
INTERVALS = """iv AS (SELECT 'C' || o_custkey AS surface_form, 'O' || o_orderkey AS target_id, o_orderdate AS valid_from,
  lead(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS valid_to FROM orders)"""


def _count(words) -> str:
    return " + ".join(f"(length(lower(text)) - length(replace(lower(text), '{w}', ''))) // {len(w)}" for w in words)


def stance_sql(bull=BULL, bear=BEAR) -> str:
    a, b = _count(bull), _count(bear)
    return f"CASE WHEN {a} > {b} THEN 'bullish' WHEN {b} > {a} THEN 'bearish' ELSE 'neutral' END"


DOCS = f"docs AS (SELECT doc_id, text, lang, source, DATE '2024-01-01' + CAST(doc_id % 30 AS INTEGER) AS day, {stance_sql()} AS stance, 'E' || (doc_id % 40) AS ent FROM documents)"
_HITS = " UNION ALL ".join(f"SELECT doc_id, '{t}' AS theme, day, stance, ent FROM docs WHERE " + " OR ".join(f"regexp_matches(lower(text), '(^|[^a-z0-9]){k}([^a-z0-9]|$)')" for k in ks) for t, ks in THEMES.items())
TAGS = f"{DOCS}, tags AS ({_HITS})"
BUCKETS = f"""{TAGS}, b AS (SELECT theme, day, count(*) AS count, count(*) FILTER (stance = 'bullish') AS w_bull,
  count(*) FILTER (stance = 'bearish') AS w_bear, count(*) FILTER (stance = 'neutral') AS w_neut FROM tags GROUP BY ALL)"""
BARS = "bars AS (SELECT event_type AS series, CAST(ts AS DATE) AS day, CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) / count(*) / 100 AS close, CAST(count(*) AS DOUBLE) AS volume FROM events GROUP BY ALL)"
MONTHLY = """mb AS (SELECT n_name AS series, CAST(n_regionkey AS VARCHAR) AS sector, CAST(date_trunc('month', l_shipdate) AS DATE) AS day,
  round(sum(l_extendedprice), 2) AS close, CAST(count(*) AS DOUBLE) AS volume
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey GROUP BY ALL)"""
#: Single words of the prose for DuckDB: tokens of [a-z]{3,}, distinct in a document.
TERMS = "terms AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(lower(text), '[a-z]{3,}')) AS term FROM documents)"
