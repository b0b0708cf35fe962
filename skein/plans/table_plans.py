"""Joins, writes, gates and report plans over the star tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import lookup, numbers
from ..operators import assemble, gate, resolve, upsert
from ..sources import landed
from . import adapter as A
from .registry import plan


@plan("""WITH n AS (SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN c_acctbal + 1 END AS c_acctbal, CASE WHEN c_custkey % 4 = 0 THEN 'NEW' END AS c_mktsegment FROM customer WHERE c_custkey % 2 = 0 UNION ALL SELECT -1, 5.0, 'NEW')
SELECT c_custkey, coalesce(n.c_acctbal, o.c_acctbal) AS c_acctbal, coalesce(n.c_mktsegment, o.c_mktsegment) AS c_mktsegment, o.c_name FROM customer o FULL JOIN n USING (c_custkey)""")
def upsert_patch(spark, d):
    old = A.table(spark, d, "customer").select("c_custkey", "c_acctbal", "c_mktsegment", "c_name")
    k = F.col("c_custkey")
    new = old.where(k % 2 == 0).select("c_custkey", F.when(k % 3 == 0, F.col("c_acctbal") + 1).alias("c_acctbal"), F.when(k % 4 == 0, "NEW").alias("c_mktsegment"))
    one = spark.range(1).select(F.lit(-1).cast("long").alias("c_custkey"), F.lit(5.0).alias("c_acctbal"), F.lit("NEW").alias("c_mktsegment"))
    return upsert.upsert_patch(old, new.unionByName(one), ["c_custkey"])


@plan("SELECT o_custkey AS src, o_orderkey AS dst, o_totalprice AS w FROM orders WHERE o_orderkey % 2 = 0 AND o_custkey IN (SELECT c_custkey FROM customer WHERE c_nationkey < 10) AND o_orderkey IN (SELECT c_custkey FROM customer WHERE c_nationkey < 10)")
def upsert_edges(spark, d):
    """Only edges whose ends exist are written."""
    nodes = A.table(spark, d, "customer").where("c_nationkey < 10").select(F.col("c_custkey").alias("node"))
    new = A.table(spark, d, "orders").where("o_orderkey % 2 = 0").select(F.col("o_custkey").alias("src"), F.col("o_orderkey").alias("dst"), F.col("o_totalprice").alias("w"))
    return upsert.upsert_edges(new.limit(0), new, nodes)


@plan("SELECT o_orderkey, o_custkey, o_custkey IN (SELECT c_custkey FROM customer WHERE c_nationkey < 10) AS linked FROM orders")
def link_if_there(spark, d):
    nodes = A.table(spark, d, "customer").where("c_nationkey < 10").select(F.col("c_custkey").alias("node"))
    return upsert.link_if_there(A.table(spark, d, "orders").select("o_orderkey", "o_custkey"), nodes, "o_custkey").select("o_orderkey", "o_custkey", "linked")


@plan("SELECT event_id FROM events WHERE NOT (event_type = 'click' AND DATE '2024-01-30' - CAST(ts AS DATE) > 10)")
def retention_prune(spark, d):
    e = A.table(spark, d, "events")
    return upsert.prune_older(e, "ts", "2024-01-30", 10, F.col("event_type") == "click").select("event_id")


@plan("SELECT c_mktsegment, count(*) FILTER (c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1)) AS kept, count(*) FILTER (c_nationkey NOT IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1)) AS pruned FROM customer GROUP BY 1")
def universe_prune(spark, d):
    members = A.table(spark, d, "nation").where("n_regionkey = 1").select(F.col("n_nationkey").alias("c_nationkey"))
    kept, gone = upsert.prune_universe(A.table(spark, d, "customer").select("c_mktsegment", "c_nationkey"), members, "c_nationkey")
    n = lambda df, c: df.groupBy("c_mktsegment").agg(F.count("*").alias(c))
    return n(kept, "kept").join(n(gone, "pruned"), "c_mktsegment", "full_outer").select("c_mktsegment", F.coalesce("kept", F.lit(0)).alias("kept"), F.coalesce("pruned", F.lit(0)).alias("pruned"))


@plan("SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderkey % 7 = 0)")
def append_new(spark, d):
    """Rows that the write-once table doesn't have, once each and without private columns."""
    have = A.table(spark, d, "orders").where("o_orderkey % 7 = 0").select(F.col("o_custkey").alias("c_custkey"))
    rows = A.table(spark, d, "customer").select("c_custkey", "c_name", F.lit("x").alias("_private"))
    return upsert.append_new(rows.unionByName(rows), have, "c_custkey")


@plan("SELECT count(*) AS n, count(*) FILTER (c_custkey IN (SELECT o_custkey FROM orders)) AS with_orders, count(*) FILTER (c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderdate >= TIMESTAMP '2000-01-01')) AS with_recent FROM customer")
def coverage_exists(spark, d):
    o = A.table(spark, d, "orders").withColumnRenamed("o_custkey", "c_custkey")
    return gate.coverage(A.table(spark, d, "customer"), "c_custkey", orders=o, recent=o.where(F.col("o_orderdate") >= F.lit("2000-01-01").cast("timestamp_ntz")))


@plan("SELECT n_name, count(s_suppkey) AS n FROM nation LEFT JOIN supplier ON n_nationkey = s_nationkey AND s_acctbal < 0 GROUP BY 1")
def macro_optional_count(spark, d):
    """Hubs with their counts, zeros kept."""
    s = A.table(spark, d, "supplier").where("s_acctbal < 0")
    return assemble.optional_count(A.table(spark, d, "nation"), s, "n_nationkey", "s_nationkey").select("n_name", "n")


@plan("SELECT count(*) AS claims, count(DISTINCT text) AS texts, round(count(*) / greatest(count(DISTINCT text), 1), 6) AS ratio FROM documents")
def dup_ratio(spark, d):
    """Duplication by the texts' hashes, so that no text is shuffled."""
    return gate.duplication(A.table(spark, d, "documents").select(F.sha2("text", 256).alias("h")), "h")


_AGE = "coalesce(DATE '2001-08-01' - TRY_CAST(day[1:10] AS DATE), 9999)"
_LAST = "lo AS (SELECT o_custkey, CASE WHEN o_custkey % 17 = 0 THEN 'unknown' ELSE CAST(CAST(max(o_orderdate) AS DATE) AS VARCHAR) END AS day FROM orders GROUP BY 1)"


def _last_orders(spark, d):
    last = A.table(spark, d, "orders").groupBy("o_custkey").agg(F.max("o_orderdate").cast("date").cast("string").alias("day"))
    return last.withColumn("day", F.when(F.col("o_custkey") % 17 == 0, "unknown").otherwise(F.col("day")))


@plan(f"WITH {_LAST} SELECT round(avg(CASE WHEN {_AGE} <= 200 THEN 1.0 ELSE 0.0 END) * 100, 1) AS fresh_pct, count(*) FILTER ({_AGE} > 200 AND {_AGE} < 9999) AS stale, count(*) FILTER ({_AGE} >= 9999) AS undated, count(*) AS n FROM lo")
def freshness(spark, d):
    return gate.freshness(_last_orders(spark, d), "day", "2001-08-01", 200)


@plan(f"""WITH {_LAST}, f AS (SELECT count(*) FILTER ({_AGE} > 200 AND {_AGE} < 9999) AS stale FROM lo)
SELECT 'stale' AS code, stale || ' stale' AS msg FROM f WHERE stale >= 3 UNION ALL SELECT 'few-parts', count(*) || ' parts' FROM part HAVING count(*) < 1000000 UNION ALL SELECT 'no-region', count(*) || ' regions' FROM region HAVING count(*) < 5""")
def gate_failures(spark, d):
    fresh = gate.macro_gate(gate.freshness(_last_orders(spark, d), "day", "2001-08-01", 200))
    n = lambda t: A.table(spark, d, t).agg(F.count("*").alias("n"))
    return gate.failures(spark, [("stale", fresh, F.col("blocked"), F.concat("stale", F.lit(" stale"))), ("few-parts", n("part"), F.col("n") < 1000000, F.concat("n", F.lit(" parts"))), ("no-region", n("region"), F.col("n") < 5, F.concat("n", F.lit(" regions")))])


_METRICS = "m AS (SELECT 'dup_ratio' AS metric, round(count(*) / count(DISTINCT text), 6) AS value FROM documents UNION ALL SELECT 'docs', CAST(count(*) AS DOUBLE) FROM documents UNION ALL SELECT 'open_share', round(avg(CASE WHEN o_orderstatus = 'O' THEN 1.0 ELSE 0.0 END), 6) FROM orders)"


@plan(f"""WITH {_METRICS} SELECT metric, value, CASE metric WHEN 'dup_ratio' THEN CASE WHEN value <= 1.05 THEN 'PASS' ELSE 'WARN' END WHEN 'open_share' THEN CASE WHEN value >= 0.6 THEN 'PASS' ELSE 'WARN' END END AS verdict,
  round(value - CASE metric WHEN 'docs' THEN 100.0 WHEN 'dup_ratio' THEN 1.0 END, 6) AS delta FROM m""")
def quality_report(spark, d):
    docs = A.table(spark, d, "documents")
    row = lambda name, df, v: df.agg(v.cast("double").alias("value")).select(F.lit(name).alias("metric"), "value")
    m = row("dup_ratio", docs, F.round(F.count("*") / F.count_distinct(F.sha2("text", 256)), 6)).unionByName(row("docs", docs, F.count("*")))
    m = m.unionByName(row("open_share", A.table(spark, d, "orders"), F.round(F.avg(F.when(F.col("o_orderstatus") == "O", 1.0).otherwise(0.0)), 6)))
    before = spark.createDataFrame([("docs", 100.0), ("dup_ratio", 1.0)], "metric string, value double")
    return gate.verdicts(m, {"dup_ratio": ("<=", 1.05), "open_share": (">=", 0.6)}).join(gate.against_baseline(m, before).select("metric", "delta"), "metric", "left")


@plan("SELECT s.s_suppkey, string_agg(CAST(p.s_suppkey AS VARCHAR), '|' ORDER BY p.s_suppkey) AS peers FROM supplier s JOIN (SELECT x.s_suppkey AS k, y.s_suppkey, row_number() OVER (PARTITION BY x.s_suppkey ORDER BY y.s_suppkey) AS i FROM supplier x JOIN supplier y ON x.s_nationkey = y.s_nationkey AND x.s_suppkey <> y.s_suppkey) p ON p.k = s.s_suppkey AND i <= 6 GROUP BY 1")
def sector_peers(spark, d):
    got = assemble.peers(A.table(spark, d, "supplier"), "s_suppkey", "s_nationkey")
    return got.select("s_suppkey", F.array_join(F.col("peers").cast("array<string>"), "|").alias("peers"))


@plan("SELECT c_custkey, r_name, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE c_acctbal > 0")
def path_3hop(spark, d):
    c, n, r = (A.table(spark, d, t) for t in ("customer", "nation", "region"))
    return assemble.chain(c.where("c_acctbal > 0"), (n, "c_nationkey", "n_nationkey"), (r, "n_regionkey", "r_regionkey")).select("c_custkey", "r_name", "n_name")


@plan("WITH i AS (SELECT c_mktsegment AS name, max(c_custkey) AS id FROM customer GROUP BY 1) SELECT o_orderkey, id FROM orders JOIN customer ON o_custkey = c_custkey JOIN i ON i.name = c_mktsegment")
def name_join(spark, d):
    """Display names to ids; of equal names the last row's."""
    c = A.table(spark, d, "customer")
    rows = A.table(spark, d, "orders").join(c.select("c_custkey", "c_mktsegment"), F.col("o_custkey") == F.col("c_custkey"))
    return assemble.ids_by_name(rows, c.select("c_mktsegment", "c_custkey"), "c_mktsegment").select("o_orderkey", "id")


@plan("SELECT n_name, round(p, 4) AS price FROM nation LEFT JOIN (SELECT s_nationkey, avg(s_acctbal) AS p FROM supplier WHERE s_acctbal > 5000 GROUP BY 1) ON s_nationkey = n_nationkey")
def price_attach(spark, d):
    s = A.table(spark, d, "supplier").where("s_acctbal > 5000").groupBy("s_nationkey").agg(F.avg("s_acctbal").alias("p"))
    nations = A.table(spark, d, "nation").withColumnRenamed("n_nationkey", "s_nationkey")
    return assemble.attach(nations, s, "s_nationkey", ["p"]).select("n_name", F.round("p", 4).alias("price"))


_TOP = "t AS (SELECT c_custkey FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 20)"


@plan(f"WITH {_TOP} SELECT c_custkey FROM t UNION SELECT c_custkey FROM customer WHERE c_custkey IN (1, 2, 3) AND c_custkey NOT IN (SELECT c_custkey FROM t)")
def endpoint_backfill(spark, d):
    """Ends of verified pairs that missed the top list are added to it."""
    c = A.table(spark, d, "customer")
    top = c.orderBy(F.desc("c_acctbal"), "c_custkey").limit(20).select("c_custkey")
    return assemble.with_ends(top, c, spark.createDataFrame([(1,), (2,), (3,)], "c_custkey long"), "c_custkey")


@plan("SELECT * FROM (SELECT c_custkey, 'A' AS market FROM customer WHERE c_nationkey < 12 ORDER BY c_acctbal DESC, c_custkey LIMIT 15) UNION ALL SELECT * FROM (SELECT c_custkey, 'B' FROM customer WHERE c_nationkey >= 12 ORDER BY c_acctbal DESC, c_custkey LIMIT 10)")
def reserved_slots(spark, d):
    order = [F.desc("c_acctbal"), F.asc("c_custkey")]
    return assemble.reserved(A.table(spark, d, "customer"), "c_custkey", [("A", F.col("c_nationkey") < 12, 15, order), ("B", F.col("c_nationkey") >= 12, 10, order)])


@plan("SELECT s_suppkey, CASE WHEN v IN ('KS', 'KQ') THEN s_name || '.' || v ELSE s_name END AS symbol FROM (SELECT *, ['KS','KQ','US'][1 + s_suppkey % 3] AS v FROM supplier)")
def symbol_derive(spark, d):
    venue = F.get(F.array(F.lit("KS"), F.lit("KQ"), F.lit("US")), (F.col("s_suppkey") % 3).cast("int"))
    return A.table(spark, d, "supplier").select("s_suppkey", lookup.symbol(venue, F.col("s_name")).alias("symbol"))


@plan("SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN p_name || ' (preferred)' ELSE p_name END AS display FROM part")
def display_name(spark, d):
    return A.table(spark, d, "part").select("p_partkey", lookup.display_name(F.col("p_name"), F.when(F.col("p_size") % 2 == 0, "preferred").otherwise("common")).alias("display"))


@plan("SELECT p_partkey, coalesce(CASE WHEN p_size < 5 THEN 7.0 END, CASE WHEN p_size - 10 > 0 AND p_retailprice > 0 THEN round((p_size - 10) * p_retailprice) END, p_retailprice) AS cap FROM part")
def market_cap(spark, d):
    p = A.table(spark, d, "part")
    return p.select("p_partkey", lookup.market_cap(F.when(F.col("p_size") < 5, 7.0), F.col("p_size") - 10, F.col("p_retailprice"), F.col("p_retailprice")).alias("cap"))


@plan("SELECT doc_id, array_to_string(list_filter(['buy','sell','thing'], lambda w: contains(lower(text), w)), '|') AS found FROM documents WHERE contains(lower(text), 'buy') OR contains(lower(text), 'sell') OR contains(lower(text), 'thing')")
def guardrail_scan(spark, d):
    return A.table(spark, d, "documents").select("doc_id", F.array_join(lookup.forbidden(F.col("text"), ("buy", "sell", "thing")), "|").alias("found")).where("found <> ''")


_FAMILY = "CASE WHEN regexp_matches(lower({0}), 'united|rom') THEN 'U' WHEN regexp_matches(lower({0}), 'ir') THEN 'I' END"


@plan(f"""SELECT a.n_name AS a, b.n_name AS b, coalesce({_FAMILY.format("a.n_name")} = {_FAMILY.format("b.n_name")}, false) OR (length(a.n_name) >= 2 AND starts_with(b.n_name, replace(a.n_name, ' ', ''))) OR (length(b.n_name) >= 2 AND starts_with(a.n_name, replace(b.n_name, ' ', ''))) AS same
FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_name < b.n_name""")
def same_group_pairs(spark, d):
    n = A.table(spark, d, "nation")
    pairs = n.select("n_regionkey", F.col("n_name").alias("a")).join(n.select("n_regionkey", F.col("n_name").alias("b")), "n_regionkey").where("a < b")
    return pairs.select("a", "b", lookup.same_group(F.col("a"), F.col("b"), {"U": ("united", "rom"), "I": ("ir",)}).alias("same"))


@plan("SELECT c_custkey, c_custkey % 3 = 0 OR c_mktsegment = 'BUILDING' AS member FROM customer")
def universe_predicate(spark, d):
    k = F.col("c_custkey")
    who = F.concat(F.when(k % 3 == 0, "DART").when(k % 3 == 1, "CIK").otherwise("X"), k.cast("string"))
    return A.table(spark, d, "customer").select("c_custkey", lookup.in_universe(who, F.when(F.col("c_mktsegment") == "BUILDING", "IDX")).alias("member"))


@plan("SELECT n_regionkey, string_agg(n_name, ',' ORDER BY n_name) AS labels FROM nation GROUP BY 1")
def index_labels(spark, d):
    return A.table(spark, d, "nation").groupBy("n_regionkey").agg(F.array_join(F.array_sort(F.collect_list("n_name")), ",").alias("labels"))


@plan("SELECT cik, doc_id, filed FROM (SELECT CAST(o_custkey AS VARCHAR) AS cik, 'edgar_' || lpad(CAST(o_custkey AS VARCHAR), 10, '0') || '_' || o_orderkey AS doc_id, CAST(o_orderdate AS DATE) || 'T00:00:00' AS filed, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS k FROM orders WHERE o_orderstatus = 'F') WHERE k <= 3")
def submission_zip(spark, d):
    """Parallel arrays of each company zipped to rows, one form, the first three."""
    o = A.table(spark, d, "orders").groupBy("o_custkey").agg(F.array_sort(F.collect_list(F.struct(F.col("o_orderkey").alias("k"), F.col("o_orderstatus").alias("s"), F.col("o_orderdate").cast("date").cast("string").alias("t")))).alias("f"))
    arrays = o.select(F.col("o_custkey").cast("string").alias("cik"), *[F.col(f"f.{c}").alias(n) for c, n in (("k", "accessionNumber"), ("s", "form"), ("t", "filingDate"))])
    rows = arrays.select("cik", F.posexplode(F.arrays_zip("accessionNumber", "form", "filingDate")).alias("i", "x")).select("cik", "i", F.col("x.accessionNumber").cast("string").alias("accessionNumber"), "x.form", "x.filingDate", F.lit(None).cast("string").alias("acceptanceDateTime"))
    return landed.zipped(rows, "F", 3).select("cik", "doc_id", F.col("event_time").alias("filed"))


@plan("SELECT c_custkey, c_mktsegment FROM customer ORDER BY c_custkey LIMIT 25 OFFSET 50")
def offset_slice(spark, d):
    return landed.pages(A.table(spark, d, "customer").select("c_custkey", "c_mktsegment"), "c_custkey", 50, 25)


@plan("SELECT conv_id, arg_min(role, turn) AS opener, count(*) AS n_turns, count(*) FILTER (role = 'assistant') AS replies FROM conversations GROUP BY 1")
def conversation_opener(spark, d):
    return A.table(spark, d, "conversations").groupBy("conv_id").agg(F.min_by("role", "turn").alias("opener"), F.count("*").alias("n_turns"), F.count_if(F.col("role") == "assistant").alias("replies"))


@plan("""WITH v AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS u, generate_subscripts(embedding, 1) AS i FROM embeddings), c AS (SELECT label, i, avg(u) AS m FROM v GROUP BY 1, 2)
SELECT vec_id, label, round(corr(u, m), 5) AS loading FROM v JOIN c USING (label, i) GROUP BY 1, 2""")
def cluster_loading(spark, d):
    """Correlation of each vector with its cluster's mean vector."""
    v = A.table(spark, d, "embeddings").select("vec_id", "label", F.posexplode("embedding").alias("i", "x")).withColumn("x", F.col("x").cast("double"))
    c = v.groupBy("label", "i").agg(F.avg("x").alias("m"))
    return v.join(c, ["label", "i"]).groupBy("vec_id", "label").agg(F.round(numbers.pearson(F.col("x"), F.col("m")), 5).alias("loading"))


@plan()
def resolve_surfaces(spark, d):
    """Surfaces of aliases, and nations under changed names, resolved at an instant; the candidates are tested against all pairs."""
    s = A.table(spark, d, "supplier")
    aliases = s.where("s_suppkey % 3 = 0").select(F.concat(F.lit("alias "), "s_suppkey").alias("surface_form"), F.concat(F.lit("S"), "s_suppkey").alias("target_id"), F.lit("1995-01-01T00:00:00").alias("valid_from"), F.lit(None).cast("string").alias("valid_to"))
    surfaces = aliases.select(F.col("surface_form").alias("surface")).unionByName(A.table(spark, d, "nation").select(F.concat(F.lit("Nation of "), "n_name").alias("surface")))
    nations = A.table(spark, d, "nation").select(F.concat(F.lit("N"), "n_nationkey").alias("issuer_id"), F.concat(F.lit("nation  of "), F.lower("n_name")).alias("name"))
    issuers = nations.select("*", F.lit("1990-01-01T00:00:00").alias("status_valid_from"), F.lit(None).cast("string").alias("status_valid_to"), F.lit("1990-01-01T00:00:00").alias("knowledge_time"))
    return resolve.resolve(surfaces, aliases, issuers, "2000-01-01T00:00:00")


@plan("""WITH m AS (SELECT c_custkey FROM customer WHERE c_nationkey < 5), s AS (SELECT * FROM orders WHERE o_custkey IN (SELECT c_custkey FROM m))
SELECT 'issuers' AS label, (SELECT count(*) FROM m) AS n UNION ALL SELECT 'securities', (SELECT count(*) FROM s) UNION ALL SELECT 'listings', (SELECT count(*) FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM s)) UNION ALL SELECT 'aliases', (SELECT count(*) FROM m)""")
def universe_gate(spark, d):
    """Four related tables restricted to members, counted."""
    c = A.table(spark, d, "customer")
    members = c.where("c_nationkey < 5").select(F.col("c_custkey").alias("issuer_id"))
    issuers, aliases = c.select(F.col("c_custkey").alias("issuer_id")), c.select(F.col("c_custkey").alias("target_id"))
    securities = A.table(spark, d, "orders").select(F.col("o_orderkey").alias("security_id"), F.col("o_custkey").alias("issuer_id"))
    return assemble.node_counts(upsert.gate_universe(members, issuers, securities, A.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("security_id")), aliases))


@plan("""SELECT c_custkey, s_acctbal AS market_cap, CASE WHEN s_suppkey % 3 = 1 THEN 'KS' ELSE 'KQ' END AS venue FROM customer JOIN supplier ON c_custkey = s_suppkey WHERE s_acctbal > 0 ORDER BY s_acctbal DESC, lpad(CAST(s_suppkey AS VARCHAR), 6, '0') LIMIT 20""")
def market_cap_rank(spark, d):
    """Listed companies met with the market's table on padded codes, the largest first."""
    corps = A.table(spark, d, "customer").select("c_custkey", F.lpad(F.col("c_custkey").cast("string"), 6, "0").alias("stock_code"))
    market = F.when(F.col("s_suppkey") % 3 == 1, "KOSPI").when(F.col("s_suppkey") % 3 == 2, "kosdaq").otherwise("KOSDAQ GLOBAL")
    listing = A.table(spark, d, "supplier").select(F.col("s_suppkey").alias("code"), F.when(F.col("s_acctbal") > 0, F.col("s_acctbal")).alias("cap"), market.alias("market"))
    return assemble.by_market_cap(corps, listing, 20).select("c_custkey", "market_cap", "venue")


@plan("SELECT c_nationkey, count(DISTINCT c_custkey) AS n FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1")
def hub_counts(spark, d):
    links = A.table(spark, d, "orders").join(A.table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return assemble.hub_counts(links, "c_nationkey", "c_custkey")


@plan("SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 30)")
def among_top(spark, d):
    """Rows of the thirty first in a ranking."""
    ranked = A.table(spark, d, "customer").withColumnRenamed("c_custkey", "o_custkey")
    return assemble.among_top(A.table(spark, d, "orders"), ranked, "o_custkey", [F.desc("c_acctbal"), F.asc("o_custkey")], 30).select("o_orderkey")


@plan("SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN 2 END AS buy FROM customer")
def json_fallback(spark, d):
    """Broken, empty and missing JSON is null and stops nothing."""
    k = F.col("c_custkey") % 4
    raw = F.when(k == 0, '{"strong_buy": 1, "buy": 2}').when(k == 1, "broken{").when(k == 2, " ")
    return A.table(spark, d, "customer").select("c_custkey", lookup.parsed(raw, "strong_buy int, buy int")["buy"].alias("buy"))


@plan("SELECT c_custkey, c_name, CASE WHEN c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000) THEN true END AS large FROM customer")
def stamp_path(spark, d):
    """An attribute of orders stamped on the customers that they lead to."""
    values = A.table(spark, d, "orders").where("o_totalprice > 300000").select(F.col("o_orderkey").alias("c_custkey"), F.lit(True).alias("large"))
    return upsert.stamp(A.table(spark, d, "customer").select("c_custkey", "c_name"), values, "c_custkey", [(A.table(spark, d, "orders"), "o_orderkey", "o_custkey")])


@plan("SELECT 'ATLANTIS,MU' AS missing")
def missing_themes(spark, d):
    return gate.missing(A.table(spark, d, "region"), "r_name", ("MU", "AFRICA", "ASIA", "ATLANTIS")).select(F.array_join("missing", ",").alias("missing"))


@plan("SELECT count(*) AS before, count(*) FILTER (NOT (event_type = 'click' AND DATE '2024-01-30' - CAST(ts AS DATE) > 10)) AS kept, count(*) FILTER (event_type = 'click' AND DATE '2024-01-30' - CAST(ts AS DATE) > 10) AS pruned FROM events")
def retention_dry_run(spark, d):
    e = A.table(spark, d, "events")
    return upsert.would_prune(e, upsert.prune_older(e, "ts", "2024-01-30", 10, F.col("event_type") == "click"))


@plan("""SELECT 'floor-themes' AS code, '25 < 70' AS msg UNION ALL SELECT 'empty-list', 'cold' UNION ALL SELECT 'retention-themes', 'atlantis' UNION ALL SELECT 'label', '2001-08-03T00:00:00 <> 2001-08-02T00:00:00'
UNION ALL SELECT 'label-future', count(*) || ' after, last 2002-01-01' FROM customer WHERE c_custkey % 50 = 0 HAVING count(*) > 0 UNION ALL SELECT 'fresh-macro', '4 stale, 1 undated of 25' UNION ALL SELECT 'fresh-price', '55.0 < 60.0'
UNION ALL SELECT 'mdd', '6 < 8' UNION ALL SELECT 'turnover', m || ' ' || n FROM (SELECT 'kr' AS m, count(*) FILTER (s_suppkey % 50 = 0) AS n FROM supplier UNION ALL SELECT 'us', count(*) FILTER (s_suppkey % 50 > 0) FROM supplier) WHERE n < 5
UNION ALL SELECT 'rising', 'not made' UNION ALL SELECT 'edge-summary', '1 without' UNION ALL SELECT 'repeated-heads', count(*) || ' lists' FROM customer WHERE c_custkey % 60 = 0 HAVING count(*) > 0
UNION ALL SELECT 'raw-sector', count(*) || ' issuers' FROM customer WHERE c_custkey % 40 = 0 HAVING count(*) > 0""")
def artifact_gate(spark, d):
    """The published tables' invariants over stand-ins of which many fail."""
    c, n, k = A.table(spark, d, "customer"), A.table(spark, d, "nation"), F.col("c_custkey")
    head = lambda at, t: F.struct(at.alias("d"), t.alias("t"))
    heads = F.array(head(F.when(k % 50 == 0, "2002-01-01").otherwise("1998-01-01"), F.lit("a")), head(F.lit("1998-01-02"), F.when(k % 60 == 0, "a").otherwise("b")))
    graph = c.select(F.col("c_name").alias("name"), F.when(k % 40 == 0, "KSIC 26").otherwise(F.col("c_mktsegment")).alias("sector"), F.col("c_acctbal").alias("mktcap"), heads.alias("heads"))
    themes = n.select(F.lower("n_name").alias("id"), F.array(head(F.lit("1998-01-01"), F.col("n_name"))).alias("heads"))
    edges = A.table(spark, d, "region").select(F.col("r_name").alias("a"), F.col("r_name").alias("b"), F.when(F.col("r_regionkey") != 2, F.col("r_name")).alias("summary"))
    i = F.col("n_nationkey")
    macros = n.select(F.col("n_name").alias("name"), F.when(i < 4, "2001-07-01").when(i == 4, "unknown").otherwise("2001-08-01").alias("end"), F.when(i < 6, -0.1).alias("mdd"))
    lists = c.select(F.when(F.col("c_nationkey") % 3 == 0, "us").when(F.col("c_nationkey") % 3 == 1, "kr").otherwise("hot").alias("list"))
    turnover = A.table(spark, d, "supplier").select(F.when(F.col("s_suppkey") % 50 == 0, "kr").otherwise("us").alias("market"))
    meta = spark.createDataFrame([("2001-08-03T00:00:00", 55.0)], "as_of string, price_fresh_pct double")
    board = spark.createDataFrame([("2001-08-02T00:00:00",)], "as_of string")
    return gate.artifact_gate(meta, board, lists, graph, themes, edges, A.table(spark, d, "part"), macros, turnover, None, {"graph": 10, "terms": 1}, "Customer#", ("nation_0", "atlantis"))
