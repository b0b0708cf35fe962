"""Text, detector, near-duplicate and filing plans over documents, conversations and pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import lookup, text
from ..operators import detect, neardup, upsert
from . import adapter as A
from .registry import plan


@plan(f"WITH {A.DOCS} SELECT stance, lang, count(*) AS n FROM docs GROUP BY ALL")
def stance_count(spark, d):
    return A.docs(spark, d).groupBy("stance", "lang").agg(F.count("*").alias("n"))


HEDGES, NEGATIONS, ATTRIBUTIONS = ("onth", "erth"), ("ndou",), ("stion",)


def _any(col: str, words) -> str:
    return "(" + " OR ".join(f"contains(lower({col}), '{w}')" for w in words) + ")"


_FIRST = "split_part(text, chr(10), 1)"


@plan(f"WITH {A.DOCS} SELECT doc_id, {_any('text', HEDGES)} AS hedged, {_any('text', NEGATIONS)} AS negated, regexp_matches(lower(text), '(^|[^a-z0-9])(no|not)([^a-z0-9]|$)') AS whole FROM docs")
def has_any_flags(spark, d):
    t = F.col("text")
    return A.docs(spark, d).select("doc_id", text.has_any(t, HEDGES).alias("hedged"), text.has_any(t, NEGATIONS).alias("negated"), text.has_any(t, ("no", "not"), whole_words=True).alias("whole"))


def _claims(spark, d):
    """A claim for each document: its first line as the span."""
    return A.docs(spark, d).select("doc_id", "stance", F.split_part("text", F.lit("\n"), F.lit(1)).alias("source_span"), F.when(F.col("doc_id") % 4 == 0, "supplies").otherwise("sentiment").alias("relation"))


@plan(f"""WITH {A.DOCS}, c AS (SELECT doc_id, stance, {_FIRST} AS s, doc_id % 4 = 0 AS rel FROM docs)
SELECT doc_id, CASE WHEN {_any("s", NEGATIONS)} THEN 'polarity-inverted' ELSE 'hedge/attribution-dropped' END AS issue FROM c
WHERE ({_any("s", NEGATIONS + HEDGES + ATTRIBUTIONS)}) AND (stance <> 'neutral' OR rel)""")
def grounding_flags(spark, d):
    return detect.grounding(_claims(spark, d), negation=NEGATIONS, hedge=HEDGES, attribution=ATTRIBUTIONS).select("doc_id", "issue")


_PART = lambda p, q: f"CASE WHEN {p} > 0 THEN {p} * log2(2 * {p} / ({p} + {q})) ELSE 0 END"
_JSD = "(" + " + ".join(_PART(f"{a}{i}", f"{b}{i}") for i in range(3) for a, b in (("p", "q"), ("q", "p"))) + ") / 2"
_SHARES = lambda p: ", ".join(f"avg(CASE WHEN k = '{s}' THEN 1.0 ELSE 0.0 END) AS {p}{i}" for i, s in enumerate(("bullish", "bearish", "neutral")))
_SENT = "unnest(list_filter(regexp_split_to_array(text, '[.!?。\\n]'), lambda x: trim(x) <> ''))"


@plan(f"""WITH sent AS (SELECT doc_id, {_SENT} AS text FROM documents), sk AS (SELECT doc_id, {A.stance_sql()} AS k FROM sent),
w AS (SELECT doc_id, count(*) AS n_sentences, {_SHARES("p")} FROM sk GROUP BY 1 HAVING count(*) >= 2),
ck AS (SELECT doc_id, {A.stance_sql()} AS k FROM (SELECT doc_id, {_FIRST} AS text FROM documents)), r AS (SELECT doc_id, {_SHARES("q")} FROM ck GROUP BY 1)
SELECT doc_id, n_sentences, round({_JSD}, 3) AS jsd FROM w JOIN r USING (doc_id) WHERE round({_JSD}, 3) >= 0.2""")
def stance_jsd(spark, d):
    return detect.stance_dispersion(A.docs(spark, d), _claims(spark, d), A.BULL, A.BEAR)


GAZETTEER, TRIGGERS = ("thing", "ther", "tion"), ("recall", "ndea", "stwh")


@plan(f"""WITH f AS (SELECT doc_id, list_filter(['thing','ther','tion'], lambda w: contains(text, w)) AS names, list_filter(['recall','ndea','stwh'], lambda w: contains(lower(text), w)) AS trig,
  list_filter(['ther','ndea'], lambda w: contains(lower(text[1:200]), w)) AS e FROM documents),
x AS (SELECT *, list_concat(names, trig) AS u, list_filter(trig, lambda w: NOT list_contains(e, w)) AS dr FROM f),
y AS (SELECT *, len(list_filter(u, lambda w: list_contains(e, w))) AS m, len(list_filter(e, lambda w: NOT list_contains(u, w))) + len(u) AS un, greatest(len(e), 1) AS n1, len(u) AS n2 FROM x WHERE len(u) > 0 AND len(dr) > 0)
SELECT doc_id, array_to_string(list_sort(dr), '|') AS dropped, round(m / n2, 6) AS recall, round(greatest((n1 + 1) * (n2 + 1) / (m + 1) - 1 - un, 0), 1) AS hidden FROM y""")
def omission_chapman(spark, d):
    docs = A.docs(spark, d)
    raised = F.filter(F.array(*[F.when(F.contains(F.lower(F.substring("text", 1, 200)), F.lit(w)), F.lit(w)) for w in ("ther", "ndea")]), lambda w: w.isNotNull())
    got = detect.omission(docs.select("doc_id", "text"), docs.select("doc_id", raised.alias("elevated")), GAZETTEER, TRIGGERS)
    return got.select("doc_id", F.array_join("dropped", "|").alias("dropped"), F.round("recall", 6).alias("recall"), "hidden")


_HIT = "CASE " + " ".join(f"WHEN contains(lower(text), '{t}') THEN '{t}'" for t in TRIGGERS) + " END"


@plan(f"""WITH {A.DOCS}, h AS (SELECT doc_id, text, stance, 'E' || (doc_id % 7) AS subject, {_HIT} AS hit FROM docs)
SELECT doc_id, doc_id || '#c0' AS claim_id, 'sentiment' AS relation, stance, 'news_sentiment:' || subject AS claim_key, 0 AS span_start, CAST(length(text) AS INTEGER) AS span_end FROM h
UNION ALL SELECT doc_id, doc_id || '#c1', 'risk_flag', 'bearish', 'news_risk:' || subject || ':' || hit, CAST(strpos(lower(text), hit) - 1 AS INTEGER), CAST(strpos(lower(text), hit) - 1 + length(hit) AS INTEGER) FROM h WHERE hit IS NOT NULL""")
def trigger_extract(spark, d):
    got = detect.news_claims(A.docs(spark, d), F.concat(F.lit("E"), F.col("doc_id") % 7), A.BULL, A.BEAR, TRIGGERS)
    return got.select("doc_id", "claim_id", "relation", "stance", "claim_key", "span_start", "span_end")


@plan(f"SELECT doc_id, count(*) AS n, max(length(s)) AS longest FROM (SELECT doc_id, {_SENT} AS s FROM documents) GROUP BY 1")
def sentence_split(spark, d):
    return A.table(spark, d, "documents").select("doc_id", F.explode(text.sentences(F.col("text"))).alias("s")).groupBy("doc_id").agg(F.count("*").alias("n"), F.max(F.length("s")).cast("long").alias("longest"))


@plan("SELECT page_id, 'news_' || substr(sha1(url), 1, 12) AS doc_id FROM pages")
def sha1_doc_id(spark, d):
    return A.table(spark, d, "pages").select("page_id", text.doc_id(F.col("url")).alias("doc_id"))


DOMAINS = {"example.com": "Com Daily", "example.net": "Net Post"}


@plan("""WITH h AS (SELECT page_id, lower(split_part(regexp_replace(coalesce(url, ''), 'https?://(www\\.)?', '', 'g'), '/', 1)) AS host FROM pages)
SELECT page_id, CASE WHEN ends_with(host, 'example.com') THEN 'Com Daily' WHEN ends_with(host, 'example.net') THEN 'Net Post' WHEN host = '' THEN 'unknown' ELSE host END AS publisher FROM h""")
def publisher_host(spark, d):
    return A.table(spark, d, "pages").select("page_id", text.publisher(F.col("url"), DOMAINS).alias("publisher"))


@plan("SELECT page_id, trim(regexp_replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '\\s+', ' ', 'g')) AS plain FROM pages")
def html_strip(spark, d):
    return A.table(spark, d, "pages").select("page_id", text.strip_html(F.col("html")).alias("plain"))


@plan("SELECT s_suppkey, CASE WHEN contains(lower(s_name), '7') OR contains(lower(s_name), '#0000001') THEN 'major_news' ELSE 'community' END AS class, CAST(CASE WHEN contains(lower(s_name), '7') OR contains(lower(s_name), '#0000001') THEN 0.6 ELSE 0.2 END AS DOUBLE) AS credibility FROM supplier")
def outlet_class(spark, d):
    kind, c = text.outlet_class(F.col("s_name"), ("7", "#0000001"))
    return A.table(spark, d, "supplier").select("s_suppkey", kind.alias("class"), c.alias("credibility"))


@plan("SELECT p_partkey, upper(regexp_replace(p_brand, '[.-]', '', 'g')) AS ticker FROM part")
def ticker_normal(spark, d):
    return A.table(spark, d, "part").select("p_partkey", text.ticker(F.col("p_brand")).alias("ticker"))


@plan("""WITH s AS MATERIALIZED (SELECT item_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS span FROM benchmark),
n AS MATERIALIZED (SELECT doc_id, ' ' || trim(regexp_replace(text, '\\s+', ' ', 'g')) || ' ' AS t FROM documents)
SELECT doc_id, item_id FROM n JOIN s ON contains(t, ' ' || span || ' ') WHERE span <> ''""")
def span_exists(spark, d):
    """Whole items that occur in documents."""
    return detect.spans_within(A.table(spark, d, "benchmark").select("item_id", "text"), A.table(spark, d, "documents").select("doc_id", "text"), "item_id", "doc_id")


_ITEMS = "['1.03','2.02','4.01','5.02','8.01']"


def _filings(spark, d):
    """Composed filing texts of orders."""
    codes = F.array(*[F.lit(c) for c in ("1.03", "2.02", "4.01", "5.02", "8.01")])
    items = F.concat_ws(",", F.get(codes, (F.col("o_orderkey") % 5).cast("int")), F.get(codes, (F.col("o_custkey") % 5).cast("int")))
    o = A.table(spark, d, "orders").select("o_orderkey", "o_custkey", items.alias("items"))
    return o.withColumn("text", F.concat(F.lit("Company (CIK "), "o_custkey", F.lit(") reported items: "), lookup.item_text(F.col("items"))))


_NAMES = "CASE {0} WHEN '1.03' THEN 'Bankruptcy or Receivership' WHEN '2.02' THEN 'Results of Operations and Financial Condition' WHEN '4.01' THEN 'Changes in Registrant''s Certifying Accountant' WHEN '5.02' THEN 'Departure of Directors or Certain Officers; Election of Directors' ELSE 'Other Events' END"


@plan(f"SELECT o_orderkey, a || ' ' || {_NAMES.format('a')} || '; ' || b || ' ' || {_NAMES.format('b')} AS items_text FROM (SELECT o_orderkey, {_ITEMS}[1 + o_orderkey % 5] AS a, {_ITEMS}[1 + o_custkey % 5] AS b FROM orders)")
def filing_text(spark, d):
    return _filings(spark, d).select("o_orderkey", lookup.item_text(F.col("items")).alias("items_text"))


@plan(f"""WITH c AS (SELECT o_orderkey, o_custkey, unnest([{_ITEMS}[1 + o_orderkey % 5], {_ITEMS}[1 + o_custkey % 5]]) AS code FROM orders)
SELECT o_orderkey AS doc_id, CAST(o_custkey AS VARCHAR) AS cik, o_custkey || ':' || code AS claim_key, CASE code WHEN '2.02' THEN 'sentiment' ELSE 'risk_flag' END AS relation,
  CASE code WHEN '1.03' THEN 'bearish' WHEN '2.02' THEN 'neutral' ELSE 'cautious' END AS stance FROM c WHERE code <> '8.01'""")
def filing_claims(spark, d):
    return detect.filing_claims(_filings(spark, d), "o_orderkey").select(F.col("o_orderkey").alias("doc_id"), "cik", "claim_key", "relation", "stance")


@plan("SELECT doc_id FROM documents WHERE doc_id IN (SELECT min(doc_id) FROM documents GROUP BY text, lang)")
def exact_dup_keep_lowest(spark, d):
    docs = A.table(spark, d, "documents").select("doc_id", "lang", F.xxhash64("text").alias("h1"), F.sha2("text", 256).alias("h2"))
    return upsert.keep_lowest(docs, ["h2", "lang"], "doc_id").select("doc_id")


_TOK = "tok AS (SELECT doc_id AS id, list_sort(list_distinct(regexp_extract_all(lower(text), '[0-9a-z가-힣]+'))) AS t FROM documents)"


@plan(f"""WITH {_TOK}, cls AS MATERIALIZED (SELECT min(id) AS id, t FROM tok WHERE len(t) > 0 GROUP BY t), w AS MATERIALIZED (SELECT id, unnest(t) AS w FROM cls),
sh AS (SELECT x.id AS a, y.id AS b, count(*) AS n FROM w x JOIN w y ON x.w = y.w AND x.id < y.id GROUP BY 1, 2),
jp AS (SELECT a, b, n / (len(x.t) + len(y.t) - n) AS j FROM sh JOIN cls x ON x.id = a JOIN cls y ON y.id = b)
SELECT a, b, round(j, 6) AS jaccard FROM jp WHERE j >= 0.8""")
def jaccard_pairs(spark, d):
    return neardup.jaccard_pairs(A.table(spark, d, "documents")).select("a", "b", F.round("jaccard", 6).alias("jaccard"))


@plan()
def leader_groups(spark, d):
    """Leader clustering and who came first; its greedy order is tested against a plain version."""
    docs = A.table(spark, d, "documents").select("doc_id", "text", (F.col("doc_id") * 7919 % 1000).alias("ingest_time"))
    return neardup.amplifiers(docs, neardup.leaders(docs))


def _heads(spark, d):
    """Every turn as a headline of one of thirty days, some about an entity."""
    c = A.table(spark, d, "conversations")
    key = (F.col("conv_id") * 10_000 + F.col("turn")).cast("long")
    return c.select(key.alias("id"), F.date_add(F.lit("2024-01-01").cast("date"), (F.col("conv_id") % 30).cast("int")).cast("string").alias("day"), "text", F.when(F.col("conv_id") % 5 > 0, F.concat(F.lit("E"), F.col("conv_id") % 5)).alias("ent"))


@plan("""WITH g AS (SELECT conv_id * 10000 + turn AS id, conv_id % 30 AS day, conv_id % 5 AS ent, list_distinct(list_transform(range(1, length(s)), lambda i: s[i:i+1])) AS g
  FROM (SELECT conv_id, turn, regexp_replace(replace(lower(text), 'ß', 'ss'), '[^0-9a-z가-힣]', '', 'g') AS s FROM conversations) WHERE length(s) >= 2),
p AS (SELECT x.id AS a, y.id AS b, len(list_intersect(x.g, y.g)) AS n_shared, least(len(x.g), len(y.g)) AS m FROM g x JOIN g y ON x.day = y.day AND x.id < y.id AND (x.ent = 0 OR y.ent = 0 OR x.ent = y.ent))
SELECT CAST(a AS BIGINT) AS a, CAST(b AS BIGINT) AS b, CAST(n_shared AS INTEGER) AS n_shared FROM p WHERE n_shared >= 8 AND n_shared >= 0.4 * m""")
def story_pairs(spark, d):
    return neardup.story_pairs(_heads(spark, d))


@plan()
def story_collapse(spark, d):
    """Stories over days; tested against their definition."""
    got = neardup.collapse_stories(_heads(spark, d))
    return got.select("text", "day", F.array_join("ents", "|").alias("ents"), "n_src")


@plan()
def diverse_heads(spark, d):
    """Up to eight headlines a day that don't overlap; tested on listed heads."""
    return neardup.diverse(_heads(spark, d), "day", ["id"], "text").select("id", "day")


_OUT = "CASE doc_id % 3 WHEN 0 THEN 'Com Daily' WHEN 1 THEN 'A+B (x)' ELSE '' END"
_TITLE = "trim(regexp_replace(text[1:40], '[^a-zA-Z ]', '', 'g'))"


@plan(f"""WITH x AS (SELECT doc_id, {_OUT} AS o, {_TITLE} AS t, trim(regexp_replace(text[41:90], '[^a-zA-Z ]', '', 'g')) AS b FROM documents),
y AS (SELECT doc_id, t, CASE doc_id % 4 WHEN 0 THEN b WHEN 1 THEN t || ' ' || b WHEN 2 THEN b || ' seen by Some Press' ELSE '' END AS b FROM x),
z AS (SELECT doc_id, t, CASE WHEN t <> '' AND starts_with(lower(trim(b)), lower(t)) THEN ltrim(trim(b)[length(t) + 1:], ' .') ELSE b END AS b FROM y)
SELECT doc_id, trim(regexp_replace(t || CASE WHEN b <> '' THEN '. ' || b ELSE '' END, '\\s+', ' ', 'g'), ' .') AS head FROM z""")
def clean_headlines(spark, d):
    """Headlines made of documents, with credits and repeated titles to take off."""
    letters = lambda a, n: F.trim(F.regexp_replace(F.substring("text", a, n), "[^a-zA-Z ]", ""))
    k = F.col("doc_id")
    outlet = F.when(k % 3 == 0, "Com Daily").when(k % 3 == 1, "A+B (x)").otherwise("")
    x = A.table(spark, d, "documents").select("doc_id", outlet.alias("o"), letters(1, 40).alias("t"), letters(41, 50).alias("b"))
    # the own outlet as credit and at the end; a repeated title; a credit that comes again; a listed one
    credit = F.when(F.col("o") != "", F.concat(F.lit(" - "), "o")).otherwise("")
    body = F.when(k % 4 == 0, F.concat("b", F.lit(" "), "o")).when(k % 4 == 1, F.concat("t", F.lit(" "), "b")).when(k % 4 == 2, F.concat("b", F.lit(" seen by Some Press"))).otherwise("")
    title = F.concat("t", F.when(k % 4 == 2, " - Some Press").when(k % 4 == 3, " - REUTERS").otherwise(credit))
    whole = F.concat(title, F.when(body != "", F.concat(F.lit(". "), body)).otherwise(""))
    return x.select("doc_id", text.clean_headlines(whole, F.col("o"), ("reuters",)).alias("head"))


@plan("SELECT s_suppkey, s_suppkey % 8 IN (0, 1, 3, 4, 6) AS vetted FROM supplier")
def quality_outlets(spark, d):
    names = F.array(*[F.lit(x) for x in ("Reuters", "The Wall Street Journal", "Seeking Alpha", "KBS World", "한국경제TV", "", "FT.com", "Zacks")])
    return A.table(spark, d, "supplier").select("s_suppkey", text.is_quality_outlet(F.get(names, (F.col("s_suppkey") % 8).cast("int"))).alias("vetted"))


@plan("SELECT n_nationkey, lower(trim(n_name)) AS name FROM nation")
def norm_names(spark, d):
    return A.table(spark, d, "nation").select("n_nationkey", text.norm_nfkc("n_name").alias("name"))
