"""The opN queries: each applies its operator to whole tables and derives the contract's columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import arrow_tokens, chat, fingerprints, packing, quality, secret_scan, sentencepiece_bpe, simhash, url_filter, warc
from .common import parts_for, ranges


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _vocabulary(name: str) -> str:
    from public_tokenizers import path

    return path(name)


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of all conversations and of the planted conversation -7, read back from the formatted texts."""
    planted = "\\### Assistant: </turn> ok"
    more = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(planted).alias("text"))
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(more)
    out = chat.format_chats(turns).withColumn("turns", chat.read_turns(F.col("formatted"))).withColumn("loss", F.array_join(chat.loss_texts(F.col("formatted"), F.col("loss_spans")), ""))
    listed = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return out.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(listed, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


#: The template's escapes and marks, told in SQL.
_ESC = r"replace(replace(replace({}, '\', '\b'), '<', '\l'), '>', '\g')"
OP1_SQL = rf"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
runs AS (SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text) IS DISTINCT FROM role AS opens FROM turns)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length({_ESC.format("text")}) + CASE WHEN opens THEN length('<turn ' || {_ESC.format("role")} || '></turn>') + 1 ELSE length('<+>') END) AS BIGINT) AS formatted_chars
FROM runs GROUP BY conv_id
"""


def op2_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and near-duplicate group of every document."""
    got = simhash.near_duplicates(_table(spark, sf_dir, "documents"))
    return got.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts and verdict of every document."""
    return quality.quality_rules(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every document's ids, and of the text decoded from them."""
    model = _vocabulary("piece_bpe_32k.model")
    got = sentencepiece_bpe.decode_pieces(sentencepiece_bpe.encode_pieces(_table(spark, sf_dir, "documents"), model), model)
    ids = F.array_join(F.col("ids").cast("array<string>"), ",")
    return got.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op5_arrow_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's place and checksum, read back from the token files."""
    folder = arrow_tokens.write_tokens(_table(spark, sf_dir, "documents"), _vocabulary("word_bpe_49k.json"), end_id=2)
    return arrow_tokens.read_tokens(spark, folder).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and spans of every document's secrets; a live value's span is told again as ``live``, a copied one's isn't."""
    got = secret_scan.scan(_table(spark, sf_dir, "documents"))
    kinds = [k for k, *_ in secret_scan.KINDS]
    names, live = F.array(*[F.lit(k) for k in kinds]), len(kinds)
    told = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.coalesce(F.get(names, s["kind"]), F.lit("live")), s["start"], s["end"])), ",")
    cut_to = lambda s, kind: F.struct(s["start"].alias("start"), kind.alias("kind"), s["end"].alias("end"))
    base = F.filter("spans", lambda s: s["kind"] < live)
    added = F.transform(F.filter("spans", lambda s: s["live"]), lambda s: cut_to(s, F.lit(live)))
    both = F.sort_array(F.concat(F.transform(base, lambda s: cut_to(s, s["kind"])), added))
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long")
    counts = [count(k).alias(f"n_{kind}") for k, kind in enumerate(kinds)]
    n = lambda holds: F.size(F.filter("spans", holds)).cast("long")
    counts += [n(lambda s: s["live"]).alias("n_live"), n(lambda s: ~s["live"]).alias("n_copied")]
    owners = F.array_join(F.transform("spans", lambda s: F.concat_ws(":", s["start"], s["end"], s["n_owners"], s["n_repos"])), ",")
    return got.select("doc_id", *counts, F.sha2(told(base), 256).alias("base_sha256"), told(both).alias("spans"), owners.alias("ownership"))


def _op6_part(k: int, pattern: str, group: int, least: int) -> str:
    """Matches of one pattern (w), the value (v) and their positions: pieces and matches alternate."""
    return f"""SELECT r, doc_id, owner, repo, {k} AS k, CAST(coalesce(list_sum(list_transform(s[1:i], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(w[1:i - 1], lambda x: length(x))), 0) AS BIGINT) AS a, w[i] AS w, p[i] AS v
FROM (SELECT *, unnest(range(1, len(w) + 1)) AS i FROM (SELECT r, doc_id, owner, repo, regexp_extract_all(t, '{pattern}') AS w, regexp_extract_all(t, '{pattern}', {group}) AS p, regexp_split_to_array(t, '{pattern}') AS s FROM d)) WHERE length(p[i]) >= {least}"""


#: The patterns for DuckDB: letters in either case written out, since its (?i) folds more than ASCII.
_ANY_CASE = lambda words: "|".join("".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in w) for w in words)
_ASSIGN = "(" + _ANY_CASE(("password", "passwd", "secret", "token", "api_?key")) + r""")["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)"""
OP6_SQL = f"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t, coalesce(source, chr(1)) AS owner, coalesce(source, chr(1)) || '/' || coalesce(lang, chr(1)) AS repo FROM documents),
base AS MATERIALIZED ({_op6_part(0, _ASSIGN, 2, 12)} UNION ALL {_op6_part(1, "AKIA[A-Z0-9]+", 0, 18)} UNION ALL {_op6_part(2, "[0-9a-f]+", 0, 16)}),
mixed AS (SELECT * FROM ({_op6_part(3, "[A-Za-z0-9+/_=-]{20,}", 0, 20)}) c
  WHERE regexp_matches(w, '[0-9].*[0-9]') AND regexp_matches(w, '[A-Za-z]') AND len(list_distinct(string_split(w, ''))) >= 8
    AND NOT EXISTS (SELECT 1 FROM base b WHERE b.r = c.r AND b.a < c.a + length(c.w) AND c.a < b.a + length(b.w))),
cand AS MATERIALIZED (SELECT * FROM base UNION ALL SELECT * FROM mixed),
held AS (SELECT v, count(DISTINCT owner) AS n_owners, count(DISTINCT repo) AS n_repos FROM cand GROUP BY v),
judged AS MATERIALIZED (SELECT cand.*, n_owners, n_repos, n_owners <= 1 AND n_repos <= 3 AS live FROM cand JOIN held USING (v)),
told AS (SELECT r, k, a, ['assign', 'access', 'hex', 'live'][k + 1] || ':' || a || ':' || (a + length(w)) AS s
  FROM (SELECT r, k, a, w FROM judged WHERE k < 3 UNION ALL SELECT r, 3, a, w FROM judged WHERE live)),
spans AS (SELECT r, sha256(coalesce(string_agg(s, ',' ORDER BY a, k) FILTER (k < 3), '')) AS base_sha256, string_agg(s, ',' ORDER BY a, k, s) AS spans FROM told GROUP BY r),
counts AS (SELECT r, count(*) FILTER (k = 0) AS n_assign, count(*) FILTER (k = 1) AS n_access, count(*) FILTER (k = 2) AS n_hex, count(*) FILTER (live) AS n_live, count(*) FILTER (NOT live) AS n_copied,
  string_agg(a || ':' || (a + length(w)) || ':' || n_owners || ':' || n_repos, ',' ORDER BY a, k) AS ownership FROM judged GROUP BY r)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, coalesce(n_live, 0) AS n_live, coalesce(n_copied, 0) AS n_copied,
  coalesce(base_sha256, sha256('')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(ownership, '') AS ownership
FROM d LEFT JOIN counts USING (r) LEFT JOIN spans USING (r)
"""


def op7_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and its edited text, and how like they are to each other and to the next document's."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    docs = fingerprints.sketch(docs, "text", "fp")
    # ranges of doc_id; each range's first rows are dealt to the range before it too (the very first to the last)
    cuts = ranges(docs, "doc_id", parts_for(_table(spark, sf_dir, "documents"), mb=8))
    docs = docs.withColumn("part", cuts.of(F.col("doc_id")))
    firsts = {r[0]: r[1] for r in docs.groupBy("part").agg(F.min("doc_id")).collect()}
    is_first = F.lit(False)
    for chunk in range(0, len(firsts), 500):
        is_first = is_first | F.col("doc_id").isin([v for v in list(firsts.values())[chunk : chunk + 500] if v is not None])
    before = F.pmod(F.col("part") - 1, F.lit(cuts.parts))
    ends = F.when(is_first, F.array(F.struct(F.lit(0).alias("guest"), F.col("part").alias("at")), F.struct(F.lit(1).alias("guest"), before.alias("at")))).otherwise(F.array(F.struct(F.lit(0).alias("guest"), F.col("part").alias("at"))))
    dealt = docs.withColumn("to", F.explode(ends)).select("doc_id", "text", "fp", F.col("to.guest").alias("guest"), F.col("to.at").alias("at"))
    w = Window.partitionBy("at").orderBy("guest", "doc_id", "text")
    got = dealt.withColumn("next_text", F.lead("text").over(w)).withColumn("next_fp", F.lead("fp").over(w)).where("guest = 0")
    n = F.length("text")
    moved = F.floor(n / 4).cast("int")
    got = got.withColumn("edited", F.concat(F.substring(F.col("text"), F.lit(1), n - moved), F.substring(F.coalesce("next_text", F.lit("")), F.lit(1), moved)))
    got = fingerprints.sketch(got, "edited", "edited_fp")
    return got.select(
        "doc_id",
        n.cast("long").alias("n_chars"),
        F.sha2("edited", 256).alias("edited_sha256"),
        fingerprints.as_text(F.col("fp")).alias("fingerprint"),
        fingerprints.as_text(F.col("edited_fp")).alias("edited_fingerprint"),
        fingerprints.likeness(F.col("fp"), F.col("edited_fp")).alias("near_edited"),
        fingerprints.likeness(F.col("fp"), F.col("next_fp")).alias("near_next"),
    )


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's record, read back from the archives."""
    folder = warc.write_warc(_table(spark, sf_dir, "pages"))
    return warc.read_warc(spark, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP8_SQL = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha256(coalesce(html, '')) AS d FROM pages),
f AS (SELECT d, min(page_id) AS first FROM p WHERE n >= 100 GROUP BY d)
SELECT p.page_id, CAST(p.n AS BIGINT) AS payload_bytes, p.d AS payload_digest,
  CASE WHEN p.n >= 100 AND p.page_id <> f.first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN p.n >= 100 AND p.page_id <> f.first THEN f.first END AS refers_to
FROM p LEFT JOIN f ON p.d = f.d AND p.n >= 100
"""


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of every document."""
    from public_tokenizers import PATTERN

    got = packing.pack(_table(spark, sf_dir, "documents"), _vocabulary("byte_bpe_50k.tiktoken"), PATTERN, end_id=1)
    return got.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


#: The contract's rules (fixed values).
RULES = tuple(url_filter.Rule(t, v) for t, v in (("com/en/", "block"), ("example.com/en/7", "allow"), ("net/de/", "block"), ("example.net/de/8", "block"), ("org/es/", "block")))
#: Words that a domain is listed for, if its label is one or has one between hyphens.
LISTED = ("adult", "spam", "pills", "ads", "casino", "bets")


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host, path, rule and verdict of every page; listed are the pages' domains whose first label has a listed word."""
    pages = _table(spark, sf_dir, "pages")
    host, _ = url_filter.url_parts(F.col("url"))
    names = pages.select(host.alias("host")).distinct().select(F.explode(url_filter.domains(F.col("host"))).alias("key")).distinct()
    listed = names.where(F.split_part("key", F.lit("."), F.lit(1)).rlike(r"(^|-)(" + "|".join(LISTED) + r")(-|$)"))
    return url_filter.filter_urls(pages, RULES, listed)


OP10_SQL = r"""
WITH u AS (SELECT page_id,
  translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path FROM pages),
rules(rule, suffix, start, verdict) AS (VALUES ('com/en/', 'com', '/en/', 'block'), ('example.com/en/7', 'example.com', '/en/7', 'allow'), ('net/de/', 'net', '/de/', 'block'),
  ('example.net/de/8', 'example.net', '/de/8', 'block'), ('org/es/', 'org', '/es/', 'block')),
fit AS (SELECT host, path, arg_max(rule, length(rule)) AS rule, arg_max(verdict, length(rule)) AS verdict FROM (SELECT DISTINCT host, path FROM u) JOIN rules
  ON (host = suffix OR ends_with(host, '.' || suffix)) AND starts_with(path, start) GROUP BY 1, 2),
bad AS (SELECT DISTINCT host FROM (SELECT host, unnest(string_split(host, '.')) AS label FROM (SELECT DISTINCT host FROM u))
  WHERE list_has_any(string_split(label, '-'), ['adult', 'spam', 'pills', 'ads', 'casino', 'bets']))
SELECT page_id, u.host, u.path, rule, coalesce(verdict, CASE WHEN bad.host IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict
FROM u LEFT JOIN fit ON fit.host = u.host AND fit.path = u.path LEFT JOIN bad ON bad.host = u.host
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_chat_format, op2_simhash_dedup, op3_quality_rules, op4_sentencepiece, op5_arrow_tokens, op6_secret_scan, op7_fingerprints, op8_warc, op9_packing, op10_url_filter)}


def oracle_sql() -> dict[str, str]:
    return {"op1_chat_format": OP1_SQL, "op6_secret_scan": OP6_SQL, "op8_warc": OP8_SQL, "op10_url_filter": OP10_SQL}
