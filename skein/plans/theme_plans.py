"""Theme, term and bridge plans over documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import comove, composites, terms, themes
from . import adapter as A
from .registry import plan

AS_OF = "2024-01-30"


def _tags(spark, d):
    return themes.tag(A.docs(spark, d), A.THEMES, carry=("day", "stance", "ent"))


def _buckets(spark, d):
    return themes.day_buckets(_tags(spark, d))


@plan(f"WITH {A.TAGS} SELECT doc_id, theme FROM tags")
def theme_tag(spark, d):
    return themes.tag(A.docs(spark, d), A.THEMES)


_EDGES = "e AS (SELECT x.theme AS a, y.theme AS b, count(*) AS w FROM tags x JOIN tags y ON x.doc_id = y.doc_id AND x.theme < y.theme GROUP BY 1, 2)"
_FREQ = "fr AS (SELECT theme, count(*) AS freq FROM tags GROUP BY 1)"


@plan(f"WITH {A.TAGS}, {_EDGES} SELECT * FROM e WHERE w >= 4")
def theme_cooccurrence(spark, d):
    return themes.cooccurrence(_tags(spark, d), 4)


@plan(f"WITH {A.TAGS}, {_FREQ} SELECT theme, freq FROM fr")
def theme_frequency(spark, d):
    return _tags(spark, d).groupBy("theme").agg(F.count("*").alias("freq"))


@plan(f"""WITH {A.TAGS}, {_EDGES}, {_FREQ}, l AS (SELECT a, b, w, round(w / (x.freq * y.freq / CAST((SELECT count(*) FROM documents) AS DOUBLE)), 6) AS lift FROM e JOIN fr x ON x.theme = a JOIN fr y ON y.theme = b)
SELECT *, lift < 1.5 AS volume_only FROM l""")
def theme_lift(spark, d):
    tags = _tags(spark, d)
    n = A.table(spark, d, "documents").count()
    return themes.lift(themes.cooccurrence(tags), tags.groupBy("theme").agg(F.count("*").alias("freq")), F.lit(float(n))).select("a", "b", "w", "lift", "volume_only")


@plan(f"WITH {A.TAGS}, {_EDGES} SELECT * FROM e ORDER BY w DESC, a, b LIMIT 5")
def edge_cap(spark, d):
    return themes.cooccurrence(_tags(spark, d)).orderBy(F.desc("w"), "a", "b").limit(5)


@plan(f"""WITH {A.TAGS}, te AS (SELECT theme, ent, count(*) AS c FROM tags GROUP BY 1, 2),
ne AS (SELECT ent, count(*) AS ne FROM docs GROUP BY 1), s AS (SELECT theme, ent, c, round(c / ne * ln(1 + c), 6) AS score FROM te JOIN ne USING (ent) WHERE c >= 3)
SELECT theme, ent, c, score FROM (SELECT *, row_number() OVER (PARTITION BY theme ORDER BY score DESC, c DESC, ent DESC) AS k FROM s) WHERE k <= 8""")
def theme_entities(spark, d):
    docs = A.docs(spark, d)
    return themes.anchors(themes.tag(docs, A.THEMES), docs.select("doc_id", "ent"))


@plan(f"WITH {A.BUCKETS} SELECT * FROM b")
def theme_day(spark, d):
    return _buckets(spark, d)


_W = f"CASE WHEN day >= DATE '{AS_OF}' THEN 1.0 ELSE pow(0.5, (DATE '{AS_OF}' - day) / 10.0) END"


@plan(f"WITH {A.TAGS} SELECT theme, round(sum({_W}), 6) AS heat, round(sum({_W} * CASE stance WHEN 'bullish' THEN 1 WHEN 'bearish' THEN -1 ELSE 0 END), 6) AS balance FROM tags GROUP BY 1")
def heat_decay(spark, d):
    return themes.heat(_tags(spark, d), AS_OF)


_SURGE = f"""{A.BUCKETS}, an AS (SELECT max(day) AS anchor FROM b WHERE day <= DATE '{AS_OF}'),
sg AS (SELECT theme, CAST(coalesce(sum(count) FILTER (anchor - day < 7), 0) AS BIGINT) AS recent_n, CAST(coalesce(sum(count) FILTER (anchor - day >= 7 AND anchor - day < 35), 0) AS BIGINT) AS base_n FROM b, an WHERE day <= DATE '{AS_OF}' GROUP BY 1),
su AS (SELECT *, CASE WHEN recent_n >= 5 THEN round((recent_n / 7 + 0.5) / (base_n / 28 + 0.5), 2) END AS surge FROM sg)"""


@plan(f"WITH {_SURGE} SELECT * FROM su")
def surge_7_28(spark, d):
    return themes.surge(_buckets(spark, d), AS_OF)


@plan(f"""WITH {_SURGE} SELECT su.theme, surge, recent_n, arg_max(text, (t.day, text)) AS why FROM (SELECT * FROM su WHERE surge >= 1.0 ORDER BY surge DESC, recent_n DESC, theme LIMIT 3) su
JOIN (SELECT theme, tags.day, text[1:60] AS text FROM tags JOIN documents USING (doc_id)) t ON t.theme = su.theme GROUP BY ALL""")
def rising(spark, d):
    heads = themes.tag(A.docs(spark, d), A.THEMES, carry=("day", "text")).withColumn("text", F.substring("text", 1, 60))
    return themes.rising(themes.surge(_buckets(spark, d), AS_OF), heads, least=1.0, top=3).select("theme", "surge", "recent_n", "why")


_TREND = f"""{A.BUCKETS}, g AS (SELECT DISTINCT theme, unnest(range(0, 21)) AS i FROM b),
tr AS (SELECT g.theme, i, coalesce(count, 0) AS n FROM g LEFT JOIN b ON b.theme = g.theme AND b.day = (SELECT max(day) FROM b WHERE day <= DATE '{AS_OF}') - CAST(20 - i AS INTEGER))"""


@plan(f"WITH {_TREND} SELECT theme, string_agg(CAST(n AS VARCHAR), ',' ORDER BY i) AS series FROM tr GROUP BY 1")
def trend_21d(spark, d):
    return themes.trend(_buckets(spark, d), AS_OF).select("theme", F.array_join(F.col("series").cast("array<string>"), ",").alias("series"))


@plan(f"WITH {_TREND}, m AS (SELECT *, max(n) OVER (PARTITION BY theme) AS top FROM tr) SELECT theme, string_agg('▁▂▃▄▅▆▇█'[1 + CASE WHEN top > 0 THEN CAST(floor(n * 7 / top) AS INTEGER) ELSE 0 END], '' ORDER BY i) AS spark FROM m GROUP BY 1")
def sparkline(spark, d):
    return themes.trend(_buckets(spark, d), AS_OF).select("theme", themes.sparkline(F.col("series")).alias("spark"))


@plan(f"WITH {A.TAGS} SELECT theme, doc_id, k AS place FROM (SELECT theme, doc_id, CAST(row_number() OVER (PARTITION BY theme ORDER BY stance = 'neutral', day DESC, doc_id) AS INTEGER) AS k FROM tags) WHERE k <= 8")
def theme_heads(spark, d):
    return themes.top_by(_tags(spark, d), ["theme"], [F.col("stance") == "neutral", F.desc("day"), F.asc("doc_id")], 8, "place").select("theme", "doc_id", "place")


@plan(f"WITH {A.TAGS}, c AS (SELECT ent, theme, count(*) AS n FROM tags GROUP BY ALL) SELECT ent, theme, n FROM (SELECT *, row_number() OVER (PARTITION BY ent ORDER BY n DESC, theme) AS k FROM c) WHERE k <= 3")
def entity_themes(spark, d):
    return themes.top_by(_tags(spark, d).groupBy("ent", "theme").agg(F.count("*").alias("n")), ["ent"], [F.desc("n"), F.asc("theme")], 3)


@plan(f"WITH {A.DOCS} SELECT ent, count(*) AS n, count(*) FILTER (stance = 'bullish') AS bull, count(*) FILTER (stance = 'bearish') AS bear FROM docs GROUP BY 1")
def entity_stances(spark, d):
    return A.docs(spark, d).groupBy("ent").agg(F.count("*").alias("n"), F.count_if(F.col("stance") == "bullish").alias("bull"), F.count_if(F.col("stance") == "bearish").alias("bear"))


@plan()
def weak_edge_rescue(spark, d):
    """Weak edges of themes that have no strong one; sequential, tested against its description."""
    edges = themes.cooccurrence(_tags(spark, d))
    added, alone = themes.rescue(edges.where("w >= 100000"), edges, list(A.THEMES))
    return spark.createDataFrame([(a, b, int(w), True) for a, b, w in added] + [(x, None, 0, False) for x in alone], "a string, b string, w long, rescued boolean")


_DF = f"{A.TERMS}, df AS (SELECT term, count(*) AS df FROM terms GROUP BY 1)"


@plan(f"WITH {_DF} SELECT term, df FROM df WHERE df BETWEEN 20 AND 0.1 * (SELECT count(*) FROM documents)")
def df_filter(spark, d):
    docs = A.table(spark, d, "documents")
    return terms.doc_frequency(terms.topical(docs)).where((F.col("df") >= 20) & (F.col("df") <= 0.1 * docs.count()))


_KEPT = f"""{_DF}, kt AS (SELECT term, df FROM df WHERE df BETWEEN 10 AND 0.02 * (SELECT count(*) FROM documents)), kd AS (SELECT doc_id, term FROM terms JOIN kt USING (term)),
pr AS (SELECT x.term AS a, y.term AS b, count(*) AS w FROM kd x JOIN kd y ON x.doc_id = y.doc_id AND x.term < y.term GROUP BY 1, 2),
dg AS (SELECT term, count(*) AS partners FROM (SELECT a AS term FROM pr UNION ALL SELECT b FROM pr) GROUP BY 1),
top AS (SELECT term, df FROM kt LEFT JOIN dg USING (term) ORDER BY coalesce(partners, 0) DESC, df DESC, term LIMIT 120),
pt AS (SELECT * FROM pr WHERE a IN (SELECT term FROM top) AND b IN (SELECT term FROM top))"""


def _emergent(spark, d):
    docs = A.table(spark, d, "documents")
    return terms.emergent(terms.topical(docs), docs.count())


@plan(f"WITH {_KEPT} SELECT term, df, (SELECT count(*) FROM pt WHERE a = term OR b = term) AS degree FROM top")
def emergent_terms(spark, d):
    return _emergent(spark, d)[0].select("term", "df", "degree")


@plan(f"WITH {_KEPT} SELECT a, b, w FROM pt WHERE w >= 5")
def emergent_edges(spark, d):
    return _emergent(spark, d)[1].select("a", "b", "w")


@plan()
def term_communities(spark, d):
    """Communities of the emergent network; greedy, tested on a planted partition."""
    return comove.communities(_emergent(spark, d)[1])


_PH = f"""{A.TAGS}, wd AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z]{{3,}}') AS w FROM documents),
gr AS (SELECT DISTINCT doc_id, unnest(list_concat(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]), list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))) AS phrase FROM wd),
tn AS (SELECT theme, count(*) AS n FROM tags GROUP BY 1 HAVING count(*) >= 8), gd AS (SELECT phrase, count(*) AS df FROM gr GROUP BY 1),
hc AS (SELECT theme, phrase, count(*) AS c FROM gr JOIN tags USING (doc_id) GROUP BY 1, 2 HAVING count(*) >= 4),
sc AS (SELECT theme, phrase, c, df, round((c / n) / (df / (SELECT count(*) FROM documents)), 6) AS lift FROM hc JOIN tn USING (theme) JOIN gd USING (phrase))
SELECT theme, phrase, c, df, lift FROM (SELECT *, row_number() OVER (PARTITION BY theme ORDER BY round(lift * ln(1 + c), 6) DESC, phrase) AS k FROM sc) WHERE k <= 30"""


@plan(f"WITH {_PH}")
def phrase_lift(spark, d):
    return terms.phrase_lift(themes.tagged(A.docs(spark, d), A.THEMES), list(A.THEMES)).select("theme", "phrase", "c", "df", "lift")


@plan("""WITH r AS (SELECT source, count(*) AS n, round(avg(CASE WHEN regexp_matches(lower(text), 'license|rights reserved') THEN 1.0 ELSE 0.0 END), 6) AS ratio FROM documents GROUP BY 1) SELECT * FROM r WHERE n >= 10 AND ratio >= 0.01""")
def noise_outlets(spark, d):
    return terms.noise_outlets(A.table(spark, d, "documents"), "license|rights reserved", ratio=0.01)


_MEN = "men AS (SELECT DISTINCT 'P' || (doc_id % 400) AS ent, term FROM terms), rw AS (SELECT DISTINCT doc_id // 4 AS row, 'P' || (doc_id % 400) AS ent FROM documents)"
_BR = f"""{A.TERMS}, {_MEN}, few AS (SELECT term FROM men GROUP BY 1 HAVING count(*) BETWEEN 2 AND 8), sp AS (SELECT ent, term FROM men JOIN few USING (term)),
sh AS (SELECT x.ent AS a, y.ent AS b, count(*) AS n_terms FROM sp x JOIN sp y ON x.term = y.term AND x.ent < y.ent GROUP BY 1, 2),
dr AS (SELECT DISTINCT x.ent AS a, y.ent AS b FROM rw x JOIN rw y ON x.row = y.row AND x.ent < y.ent)"""


def _mentions(spark, d):
    docs = A.table(spark, d, "documents")
    ent = F.concat(F.lit("P"), F.col("doc_id") % 400)
    held = terms.topical(docs).select(F.concat(F.lit("P"), F.col("doc_id") % 400).alias("ent"), "term")
    return held, docs.select(F.floor(F.col("doc_id") / 4).alias("row"), ent.alias("ent")).distinct()


@plan(f"WITH {_BR} SELECT a, b, n_terms FROM sh WHERE n_terms >= 3 AND NOT EXISTS (SELECT 1 FROM dr WHERE dr.a = sh.a AND dr.b = sh.b)")
def bridge_pairs(spark, d):
    return terms.bridges(*_mentions(spark, d)).where("n_terms >= 3")


@plan("""WITH pf AS (SELECT 'L' || lang || (doc_id % 10) AS ent, term, count(*) AS c FROM (SELECT doc_id, lang, unnest(regexp_extract_all(lower(text), '[a-z]{3,}')) AS term FROM documents) GROUP BY ALL),
nm AS (SELECT ent, sqrt(sum(c * c)) AS n FROM pf GROUP BY 1)
SELECT x.ent AS a, y.ent AS b, round(sum(x.c * y.c) / (any_value(u.n) * any_value(v.n)), 6) AS cosine FROM pf x JOIN pf y ON x.term = y.term AND x.ent < y.ent JOIN nm u ON u.ent = x.ent JOIN nm v ON v.ent = y.ent GROUP BY 1, 2""")
def profile_cosine(spark, d):
    from ..functions import text

    words = A.table(spark, d, "documents").select(F.concat(F.lit("L"), "lang", F.col("doc_id") % 10).alias("ent"), F.explode(text.topical_tokens(F.col("text"), distinct=False)).alias("term"))
    prof = words.groupBy("ent", "term").agg(F.count("*").alias("c"))
    e = prof.select("ent").distinct()
    pairs = e.select(F.col("ent").alias("a"), F.lit(1).alias("k")).join(e.select(F.col("ent").alias("b"), F.lit(1).alias("k")), "k").where("a < b")
    return terms.profile_cosine(prof, pairs.select("a", "b"))


#: One theme hangs below another.
CHILD = "ma"
_VIEW = f"""{_SURGE}, par AS (SELECT * FROM tags WHERE theme <> '{CHILD}'),
pw AS (SELECT x.theme AS a, y.theme AS b, count(*) AS w, count(*) FILTER (x.stance = 'bullish') AS bull, count(*) FILTER (x.stance = 'bearish') AS bear, count(*) FILTER (x.stance = 'neutral') AS neut
  FROM par x JOIN par y ON x.doc_id = y.doc_id AND x.theme < y.theme GROUP BY 1, 2),
top AS (SELECT * FROM pw WHERE w >= 4 ORDER BY w DESC, a, b LIMIT 60), {_FREQ}"""


def _view(spark, d):
    found = A.docs(spark, d).select(F.col("doc_id").alias("id"), "text", "day", F.array("ent").alias("ents"))
    spine = {t: k for t, k in A.THEMES.items() if t != CHILD}
    return composites.theme_view(found, spine, AS_OF, {CHILD: ("ai", A.THEMES[CHILD])}, A.BULL, A.BEAR, with_heads=False)


@plan(f"""WITH {_VIEW}, {_TREND.removeprefix(A.BUCKETS + ", ")}, ts AS (SELECT theme, string_agg(CAST(n AS VARCHAR), ',' ORDER BY i) AS series FROM tr GROUP BY 1),
he AS (SELECT theme, count(*) AS freq, round(sum({_W}), 1) AS heat, round(coalesce(sum({_W}) FILTER (stance = 'bullish'), 0), 1) AS bull, round(coalesce(sum({_W}) FILTER (stance = 'bearish'), 0), 1) AS bear,
  round(coalesce(sum({_W}) FILTER (stance = 'neutral'), 0), 1) AS neut FROM tags GROUP BY 1),
re AS (SELECT theme, string_agg(o, ',' ORDER BY w DESC, o DESC) AS related FROM (SELECT *, row_number() OVER (PARTITION BY theme ORDER BY w DESC, o DESC) AS k FROM (SELECT a AS theme, b AS o, w FROM pw WHERE w >= 4 UNION ALL SELECT b, a, w FROM pw WHERE w >= 4)) WHERE k <= 6 GROUP BY 1)
SELECT theme, freq, heat, bull, bear, neut, surge, coalesce(recent_n, 0) AS recent_n, CASE WHEN theme = '{CHILD}' THEN 1 ELSE 0 END AS level, CASE WHEN theme = '{CHILD}' THEN 'ai' END AS parent,
  CASE WHEN theme = 'ai' AND '{CHILD}' IN (SELECT theme FROM he) THEN '{CHILD}' ELSE '' END AS children, coalesce(related, '') AS related, series,
  theme <> '{CHILD}' AND theme NOT IN (SELECT a FROM pw WHERE w >= 2 UNION ALL SELECT b FROM pw WHERE w >= 2) AS isolated
FROM he LEFT JOIN su USING (theme) LEFT JOIN re USING (theme) LEFT JOIN ts USING (theme)""")
def theme_view_nodes(spark, d):
    joined = lambda c: F.array_join(F.col(c).cast("array<string>"), ",").alias(c)
    return _view(spark, d)["nodes"].select("theme", "freq", "heat", "bull", "bear", "neut", "surge", "recent_n", "level", "parent", joined("children"), joined("related"), joined("series"), "isolated")


@plan(f"""WITH {_VIEW} SELECT a, b, w, round(w / (x.freq * y.freq / CAST((SELECT count(*) FROM documents) AS DOUBLE)), 1) AS lift, round(w / (x.freq * y.freq / CAST((SELECT count(*) FROM documents) AS DOUBLE)), 1) < 1.5 AS volume_only, bull, bear, neut
FROM top JOIN fr x ON x.theme = a JOIN fr y ON y.theme = b""")
def theme_view_edges(spark, d):
    return _view(spark, d)["edges"].where("not weak").drop("weak")


BRIDGE, CONTEXT = ("que", "der", "los", "und"), ("with", "was", "from", "this")
_HIT = lambda words: "list_filter([" + ",".join(f"'{w}'" for w in words) + "], lambda w: regexp_matches(lower(text), '(^|[^a-z0-9])' || w || '([^a-z0-9]|$)'))"


@plan(f"""WITH r AS MATERIALIZED (SELECT doc_id AS id, trim(text) AS text, list_sort(list_distinct(['P' || doc_id % 23, 'P' || doc_id % 29])) AS ents, {_HIT(BRIDGE)} AS hit, {_HIT(CONTEXT)} AS seen FROM documents WHERE trim(coalesce(text, '')) <> ''),
df AS (SELECT unnest(hit) AS term, count(*) AS df FROM r GROUP BY 1),
held AS MATERIALIZED (SELECT term, ent, arg_min(text, id) AS ev FROM (SELECT id, text, term, unnest(ents) AS ent FROM (SELECT id, text, ents, unnest(hit) AS term FROM r)) GROUP BY 1, 2),
direct AS (SELECT DISTINCT ents[1] AS a, ents[2] AS b FROM r WHERE len(ents) = 2),
sh AS (SELECT x.ent AS a, y.ent AS b, list_sort(list(term)) AS terms, min(df) AS rarity FROM held x JOIN held y USING (term) JOIN df USING (term) WHERE x.ent < y.ent GROUP BY 1, 2),
ok AS (SELECT * FROM sh WHERE NOT EXISTS (SELECT 1 FROM direct WHERE direct.a = sh.a AND direct.b = sh.b) AND NOT starts_with(b, a) AND NOT starts_with(a, b)),
pf AS (SELECT ent, term, count(*) AS c FROM (SELECT unnest(ents) AS ent, term FROM (SELECT ents, unnest(seen) AS term FROM r)) GROUP BY 1, 2), nm AS (SELECT ent, sqrt(sum(c * c)) AS n, sum(c) AS m FROM pf GROUP BY 1),
co AS (SELECT x.ent AS a, y.ent AS b, sum(x.c * y.c) AS dot FROM pf x JOIN pf y USING (term) GROUP BY 1, 2),
f AS (SELECT ok.*, coalesce(round(dot / (u.n * v.n), 6), 0) AS cosine, coalesce(u.m, 0) AS ma, coalesce(v.m, 0) AS mb FROM ok LEFT JOIN co USING (a, b) LEFT JOIN nm u ON u.ent = ok.a LEFT JOIN nm v ON v.ent = ok.b)
SELECT f.a, f.b, array_to_string(terms, ',') AS terms, CAST(len(terms) AS INTEGER) AS n_terms, round(cosine, 2) AS cosine, rarity, CASE WHEN ma < 3 OR mb < 3 THEN 'thin' WHEN cosine >= 0.35 THEN 'alike' ELSE 'apart' END AS flag, x.ev[1:20] AS evidence_a, y.ev[1:20] AS evidence_b
FROM f JOIN held x ON x.ent = f.a AND x.term = terms[1] JOIN held y ON y.ent = f.b AND y.term = terms[1]""")
def bridge_candidates(spark, d):
    """Entities that share a word, were never named together and aren't of one group."""
    k = F.col("doc_id")
    heads = A.table(spark, d, "documents").select(k.alias("id"), "text", F.array(F.concat(F.lit("P"), k % 23), F.concat(F.lit("P"), k % 29)).alias("ents"))
    got = composites.mine_bridges(heads, BRIDGE, CONTEXT)
    for c in ("evidence_a", "evidence_b"):
        got = got.withColumn(c, F.substring(c, 1, 20))
    return composites.ranked_bridges(got.withColumn("terms", F.array_join("terms", ",")))
