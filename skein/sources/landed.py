"""Readers of landed files. Fetching is left to a landing job; every reader has an explicit schema."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas as S
from ..functions import lexicons as L
from ..functions import lookup, text
from ..operators.themes import top_by


def _json(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", True).json(path)


def corpus(spark: SparkSession, path: str) -> DataFrame:
    """Documents of a folder of JSON files (an object or a list each), language ``ko`` and ingest time by default."""
    d = _json(spark, path, S.DOCUMENT)
    return d.withColumn("lang", F.coalesce("lang", F.lit("ko"))).withColumn("ingest_time", F.coalesce("ingest_time", "event_time"))


def master(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The four dimension tables and the pairs that must not be linked, of one JSON document."""
    m = _json(spark, path, S.MASTER)
    out = {k: m.select(F.explode(k).alias("x")).select("x.*") for k in ("issuers", "securities", "listings", "aliases")}
    return out | {"must_not_link": m.select(F.explode("must_not_link").alias("p")).select(F.col("p")[0].alias("a"), F.col("p")[1].alias("b"))}


def sources(spark: SparkSession, path: str) -> DataFrame:
    return _json(spark, path, S.SOURCE)


def extractions(spark: SparkSession, path: str, docs: DataFrame) -> DataFrame:
    """Each document's extraction by file name; documents without a file have an empty one. Missing fields get their defaults."""
    e = _json(spark, path, S.EXTRACTION).select(F.regexp_extract(F.col("_metadata.file_name"), r"^(.*)\.json$", 1).alias("doc_id"), "claims", "elevated_entities")
    blank = lambda c, f, d: F.coalesce(c[f], F.lit(d)).alias(f)
    filled = F.transform("claims", lambda c: F.struct(c["subject_surface"].alias("subject_surface"), c["relation"].alias("relation"), blank(c, "object_text", ""), blank(c, "claim_key", ""), blank(c, "stance", "neutral"), blank(c, "source_span", ""), blank(c, "span_start", -1), blank(c, "span_end", -1)))
    none = lambda t: F.expr(f"cast(array() as {t})")
    e = e.withColumn("claims", filled)
    return docs.select("doc_id").join(e, "doc_id", "left").select("doc_id", F.coalesce("claims", none(e.schema["claims"].dataType.simpleString())).alias("claims"), F.coalesce("elevated_entities", none("array<string>")).alias("elevated_entities"))


def submissions(spark: SparkSession, path: str, form: str = "8-K", most: int = 40) -> DataFrame:
    """Filings of landed submissions: parallel arrays zipped to rows, one form, the latest ``most`` of each company."""
    s = _json(spark, path, S.SUBMISSIONS)
    rows = s.select("cik", "name", F.posexplode(F.arrays_zip(*[F.col(f"filings.recent.{c}").alias(c) for c in ("accessionNumber", "form", "filingDate", "acceptanceDateTime", "items")])).alias("i", "f"))
    return zipped(rows.select("cik", "name", "i", "f.*"), form, most)


def zipped(rows: DataFrame, form: str, most: int) -> DataFrame:
    """Filter one form and keep the first ``most`` rows of each company in their order; adds document id and normal time."""
    got = top_by(rows.where(F.col("form") == form), ["cik"], [F.asc("i")], most)
    at = F.split_part(F.regexp_replace("acceptanceDateTime", "Z$", ""), F.lit("."), F.lit(1))
    return got.withColumn("doc_id", F.concat(F.lit("edgar_"), F.lpad("cik", 10, "0"), F.lit("_"), "accessionNumber")).withColumn("event_time", F.coalesce(at, F.concat("filingDate", F.lit("T00:00:00"))))


def former_names(spark: SparkSession, path: str) -> DataFrame:
    """Aliases with their time of validity from companies' former names (:func:`sectors` has the sector rows)."""
    s = _json(spark, path, S.SUBMISSIONS)
    f = s.select("cik", F.explode("formerNames").alias("f"))
    return f.select(F.col("f.name").alias("surface_form"), F.concat(F.lit("CIK"), F.lpad("cik", 10, "0")).alias("target_id"), F.substring("f.from", 1, 19).alias("valid_from"), F.substring("f.to", 1, 19).alias("valid_to"))


def sectors(spark: SparkSession, path: str) -> DataFrame:
    """``issuer_id, sic, description, division`` of landed submissions; companies without a code have no row."""
    s = _json(spark, path, S.SUBMISSIONS).where(F.coalesce("sic", F.lit("")) != "")
    return s.select(F.concat(F.lit("CIK"), F.lpad("cik", 10, "0")).alias("issuer_id"), "sic", F.col("sicDescription").alias("description"), lookup.division(F.col("sic")).alias("division"))


def _plain(html) -> Column:
    """Tags to spaces, entities to characters, white space collapsed."""
    return F.trim(F.regexp_replace(text.unescape_html(text.strip_html(F.coalesce(html, F.lit("")))), r"\s+", " "))


def _composed(title: Column, summary: Column) -> Column:
    """``title. summary``, or the title where the summary is empty or begins like it."""
    return F.when((summary == "") | (F.substring(title, 1, 30) == F.substring(summary, 1, 30)), title).otherwise(F.concat_ws(". ", title, summary))


def rss(spark: SparkSession, path: str, tag: str = "item", max_items: int | None = 8) -> DataFrame:
    """News items of landed RSS files, the first ``max_items`` of each, tags and entities resolved, with ids from their links.

    Items without a title or link are left out after the first ones were taken; an item without a source is of outlet "unknown".
    """
    r = spark.read.format("xml").schema(S.RSS_ITEM).option("rowTag", tag).load(path)
    r = r.select("*", F.input_file_name().alias("file"), F.monotonically_increasing_id().alias("i"))
    if max_items is not None:
        r = top_by(r, ["file"], [F.asc("i")], max_items)
    r = r.where((F.trim(F.coalesce("title", F.lit(""))) != "") & (F.trim(F.coalesce("link", F.lit(""))) != "")).withColumn("link", F.trim("link"))
    r = r.select("link", "pubDate", F.coalesce(F.nullif(F.col("source._VALUE"), F.lit("")), F.lit("unknown")).alias("outlet"), F.trim("title").alias("t"), _plain(F.col("description")).alias("s"))
    body = _composed(F.col("t"), F.col("s"))
    return r.select(text.doc_id(F.col("link")).alias("doc_id"), body.alias("text"), "outlet", F.col("link").alias("url"), rss_time(F.col("pubDate")).alias("event_time"))


def rss_time(value) -> object:
    """``Mon, 02 Jan 2006 15:04:05 GMT`` to ISO text, without regard to locale."""
    months = F.create_map(*[F.lit(x) for i, m in enumerate("Jan Feb Mar Apr May Jun Jul Aug Sep Oct Nov Dec".split(), 1) for x in (m, f"{i:02d}")])
    part = lambda i: F.regexp_extract(value, r"(\d{1,2}) ([A-Z][a-z]{2}) (\d{4}) (\d{2}:\d{2}:\d{2})", i)
    return F.when(part(1) != "", F.concat(part(3), F.lit("-"), F.try_element_at(months, part(2)), F.lit("-"), F.lpad(part(1), 2, "0"), F.lit("T"), part(4)))


def corps(spark: SparkSession, path: str) -> DataFrame:
    """Listed companies of the landed corporate master (XML)."""
    return spark.read.format("xml").schema(S.CORP).option("rowTag", "list").load(path).where(F.trim(F.coalesce("stock_code", F.lit(""))) != "")


def news_json(spark: SparkSession, path: str, domains: dict[str, str]) -> DataFrame:
    """News items of landed JSON search results, tags and entities resolved, publishers by domain."""
    n = _json(spark, path, S.NEWS_ITEMS).select(F.explode("items").alias("i")).select("i.*")
    url = F.coalesce("originallink", "link")
    return n.select(text.doc_id(url).alias("doc_id"), _composed(_plain(F.col("title")), _plain(F.col("description"))).alias("text"), text.publisher(url, domains).alias("outlet"), url.alias("url"), rss_time(F.col("pubDate")).alias("event_time"))


def emitted(items: DataFrame, knowledge_time: str, subject: Column, kind: str, surface: Column, lang: str = "en") -> DataFrame:
    """Documents of one track, ``issuer`` or ``macro``, whose subject is known from the query: with source, credibility and the carried subject (private, ``_`` first)."""
    name, prior = text.outlet_class(F.col("outlet"), L.TIER1_OUTLETS)
    at = F.coalesce("event_time", F.lit(knowledge_time))
    # (of a source id only words of Latin letters, digits and Hangul stay, joined by hyphens)
    slug = F.trim(F.regexp_replace(F.lower("outlet"), "[^a-z0-9가-힣]+", "-"), F.lit("-"))
    source = F.concat(F.lit("news::"), F.coalesce(F.nullif(slug, F.lit("")), F.lit("unknown")))
    private = [F.col("outlet").alias("_outlet"), name.alias("_cred_class"), prior.alias("_cred"), F.col("url").alias("_link"), subject.alias("_subject_id"), F.lit(kind).alias("_subject_kind"), surface.alias("_subject_surface")]
    return items.select("doc_id", source.alias("source_id"), F.lit(lang).alias("lang"), "text", at.alias("event_time"), F.lit(knowledge_time).alias("ingest_time"), *private)


def constituents(spark: SparkSession, paths: dict[str, str], tickers: str, symbol: str = "Symbol") -> DataFrame:
    """``issuer_id, memberships`` of landed index lists (CSV, one for each index) met with the landed ticker list (JSON lines ``ticker, cik_str``).

    Tickers meet without dots and hyphens, in upper case. Memberships in the order of ``paths``.
    """
    ids = spark.read.schema("ticker string, cik_str long").json(tickers).select(text.ticker(F.col("ticker")).alias("t"), F.concat(F.lit("CIK"), F.lpad(F.col("cik_str").cast("string"), 10, "0")).alias("issuer_id")).dropDuplicates(["t"])
    out = None
    for i, (name, path) in enumerate(paths.items()):
        own = spark.read.option("header", True).csv(path).select(text.ticker(F.col(symbol)).alias("t"), F.struct(F.lit(i).alias("i"), F.lit(name).alias("name")).alias("m")).where("t <> ''").distinct()
        out = own if out is None else out.unionByName(own)
    return out.join(ids, "t").groupBy("issuer_id").agg(F.transform(F.array_sort(F.collect_set("m")), lambda m: m["name"]).alias("memberships"))


def subthemes(spark: SparkSession, path: str, spine: Sequence[str]) -> DataFrame:
    """``theme_id, label, parent_id, keywords`` of landed child themes (a JSON object: parent to list); children of unknown parents, and keys that start with ``_``, are left out."""
    raw = spark.read.option("wholetext", True).text(path).select(F.from_json("value", "map<string,string>").alias("m")).select(F.explode("m").alias("parent_id", "v"))
    raw = raw.where(F.col("parent_id").isin(*spine) & ~F.col("parent_id").startswith("_"))
    one = F.explode(F.from_json("v", "array<struct<id:string,label:string,keywords:array<string>>>")).alias("c")
    return raw.select("parent_id", one).select(F.col("c.id").alias("theme_id"), F.col("c.label").alias("label"), "parent_id", F.col("c.keywords").alias("keywords"))


def bars(spark: SparkSession, path: str) -> DataFrame:
    """Daily bars: rows without a close go, a missing volume is 0."""
    b = spark.read.schema("series string, day date, close double, volume double").parquet(path)
    return b.where("close is not null").withColumn("volume", F.coalesce("volume", F.lit(0.0)))


def snapshot(df: DataFrame, aliases: dict[str, tuple[str, ...]]) -> DataFrame:
    """A market snapshot under its known column names: codes padded to six digits, percent to fractions."""
    pick = {k: F.coalesce(*[F.col(c) for c in names if c in df.columns]) for k, names in aliases.items() if any(c in df.columns for c in names)}
    out = df.select(*[v.alias(k) for k, v in pick.items()])
    if "code" in pick:
        out = out.withColumn("code", F.lpad(F.col("code").cast("string"), 6, "0"))
    return out.withColumn("chg", F.col("chg") / 100) if "chg" in pick else out


def history(spark: SparkSession, path: str) -> DataFrame:
    """Bars of a landed (gzip) history document."""
    h = _json(spark, path, S.HISTORY).select(F.explode("tickers").alias("series", "t"))
    return h.select("series", F.col("t.sector").alias("sector"), F.explode(F.arrays_zip(F.col("t.dates").alias("day"), F.col("t.closes").alias("close"))).alias("x")).select("series", "sector", F.col("x.day").cast("date").alias("day"), F.col("x.close").alias("close"))


def ratings(spark: SparkSession, path: str, most: int = 6) -> DataFrame:
    """Consensus and the latest changes, newest first; issuers without any analyst go."""
    r = _json(spark, path, S.RATINGS)
    total = sum((F.coalesce(f"consensus.{c}", F.lit(0)) for c in ("strong_buy", "buy", "hold", "sell", "strong_sell")), F.lit(0))
    latest = F.slice(F.reverse(F.array_sort("changes")), 1, most)
    return r.where(total > 0).select("issuer_id", "consensus", latest.alias("changes"))


def pages(df: DataFrame, order: str, offset: int, limit: int) -> DataFrame:
    """A slice of an ordered list."""
    return df.orderBy(order).offset(offset).limit(limit)
