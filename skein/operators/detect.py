"""Bias detectors over claims and documents: grounding, omission, stance dispersion; rule extraction."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import lexicons as L
from ..functions import lookup, numbers, text
from ..settings import DEFAULTS


def grounding(claims: DataFrame, span: str = "source_span", negation: Sequence[str] = L.NEGATION, attribution: Sequence[str] = L.ATTRIBUTION, hedge: Sequence[str] = L.HEDGE) -> DataFrame:
    """Claims that state as fact what their span denies, attributes or hedges; ``issue`` says which."""
    s = F.col(span)
    neg, soft = text.has_any(s, negation), text.has_any(s, attribution) | text.has_any(s, hedge)
    firm = F.col("stance").isin("bullish", "bearish") | (F.col("relation") != "sentiment")
    return claims.where((neg | soft) & firm).withColumn("issue", F.when(neg, "polarity-inverted").otherwise("hedge/attribution-dropped"))


def omission(docs: DataFrame, elevated: DataFrame, gazetteer: Sequence[str], triggers: Sequence[str] = L.MATERIAL, aliases: dict[str, str] | None = None, doc: str = "doc_id", body: str = "text") -> DataFrame:
    """Documents whose extraction leaves a material trigger out; documents without an extraction aren't judged.

    Found in the NFKC text: gazetteer names as written, triggers in any case;
    elevated: (doc_id, names). ``aliases`` brings names of both to one form.
    Returns recall, everything left out, the triggers left out, how many facts
    stay hidden by the Chapman estimate, and that as a percentage.
    """
    canon = lambda names: F.array_distinct(F.transform(names, lambda w: F.coalesce(F.try_element_at(same, w), w))) if aliases else names
    same = F.create_map(*[F.lit(x) for kv in (aliases or {}).items() for x in kv])
    listed = lambda t, words: F.filter(F.array(*[F.when(F.contains(t, F.lit(w)), F.lit(w)) for w in words]), lambda w: w.isNotNull())
    held = F.filter(F.array(*[F.when(F.contains(F.lower("_nfkc"), F.lit(w.casefold())), F.lit(w)) for w in triggers]), lambda w: w.isNotNull())
    got = docs.join(elevated.select(doc, "elevated"), doc).withColumn("_nfkc", text.nfkc(F.coalesce(F.col(body), F.lit(""))))
    got = got.withColumn("names", canon(listed(F.col("_nfkc"), [w for w in gazetteer if w]))).withColumn("triggers", held)
    got = got.withColumn("elevated", canon(F.array_distinct("elevated"))).withColumn("full", F.array_union("names", "triggers"))
    got = got.where((F.size("full") > 0) & (F.size(F.array_except("triggers", "elevated")) > 0))
    m, n1, n2 = F.size(F.array_intersect("full", "elevated")), F.greatest(F.size("elevated"), F.lit(1)), F.size("full")
    total = numbers.chapman(n1, n2, m)
    hidden = F.greatest(total - F.size(F.array_union("full", "elevated")), F.lit(0.0))
    missed = lambda a: F.array_sort(F.array_except(a, "elevated"))
    pct = F.round(F.when(total > 0, 100 * hidden / total).otherwise(0.0), 1)
    return got.select(doc, missed("triggers").alias("dropped"), (m / n2).alias("recall"), F.round(hidden, 1).alias("hidden"), missed("full").alias("omissions"), pct.alias("hidden_pct"))


def stance_dispersion(docs: DataFrame, claims: DataFrame, bull: Sequence[str] = L.BULLISH, bear: Sequence[str] = L.BEARISH, threshold: float = DEFAULTS.stance_skew, doc: str = "doc_id", body: str = "text") -> DataFrame:
    """Documents of two sentences or more whose claims' stances spread otherwise than their sentences': divergence at the threshold or above."""
    shares = lambda prefix: [F.avg(F.when(F.col(prefix) == k, 1.0).otherwise(0.0)) for k in ("bullish", "bearish", "neutral")]
    parts = docs.select(doc, F.explode(text.sentences(F.col(body))).alias("s")).withColumn("k", text.stance(F.col("s"), bull, bear))
    whole = parts.groupBy(doc).agg(F.count("*").alias("n_sentences"), F.array(*shares("k")).alias("p")).where("n_sentences >= 2")
    raised = claims.withColumn("k", text.stance(F.col("source_span"), bull, bear)).groupBy(doc).agg(F.array(*shares("k")).alias("q"))
    return whole.join(raised, doc).select(doc, "n_sentences", F.round(numbers.jsd(F.col("p"), F.col("q")), 3).alias("jsd")).where(F.col("jsd") >= threshold)


def news_claims(docs: DataFrame, subject: Column, bull: Sequence[str] = L.BULLISH, bear: Sequence[str] = L.BEARISH, triggers: Sequence[str] = L.MATERIAL, doc: str = "doc_id", body: str = "text") -> DataFrame:
    """Claims of headlines: always one of sentiment, and a bearish risk flag for the first trigger, in the list's order, that occurs."""
    t = F.col(body)
    first = F.coalesce(*[F.when(F.contains(F.lower(t), F.lit(w.lower())), F.lit(w)) for w in triggers])
    rows = docs.select(doc, t.alias("text"), subject.alias("subject"), text.stance(t, bull, bear).alias("s"), first.alias("hit")).withColumn("at", F.expr("locate(lower(hit), lower(text)) - 1"))
    one = lambda relation, key, s, a, b: F.struct(F.lit(relation).alias("relation"), key.alias("claim_key"), s.alias("stance"), a.alias("span_start"), b.alias("span_end"))
    mood = one("sentiment", F.concat(F.lit("news_sentiment:"), "subject"), F.col("s"), F.lit(0), F.length("text"))
    risk = one("risk_flag", F.concat_ws(":", F.lit("news_risk"), "subject", "hit"), F.lit("bearish"), F.col("at"), F.col("at") + F.length("hit"))
    both = F.when(F.col("hit").isNull(), F.array(mood)).otherwise(F.array(mood, risk))
    return rows.select(doc, "subject", F.posexplode(both).alias("i", "c")).select(doc, "subject", F.concat(F.col(doc).cast("string"), F.lit("#c"), "i").alias("claim_id"), "c.*")


def filing_claims(docs: DataFrame, doc: str = "doc_id", body: str = "text") -> DataFrame:
    """Claims of composed filing texts ("Company (CIK n) ... items: 1.03, 5.02"): one for each item that has a rule."""
    rules = docs.sparkSession.createDataFrame([(k, r, s, lookup.ITEMS[k]) for k, (r, s) in lookup.ITEM_CLAIMS.items()], "code string, relation string, stance string, description string")
    codes = docs.select(doc, F.col(body).alias("text"), F.regexp_extract(body, r"CIK\s*(\d+)", 1).alias("cik"), F.posexplode(F.regexp_extract_all(F.col(body), F.lit(r"\b(\d\.\d{2})\b"), F.lit(1))).alias("i", "code"))
    got = codes.join(F.broadcast(rules), "code").withColumn("source_span", F.concat_ws(" ", "code", "description")).withColumn("at", F.expr("locate(source_span, text) - 1"))
    return got.select(doc, "cik", "relation", "stance", "source_span", F.concat_ws(":", "cik", "code").alias("claim_key"), F.col("at").alias("span_start"), F.when(F.col("at") >= 0, F.col("at") + F.length("source_span")).otherwise(-1).alias("span_end"))


def layered(sessions: DataFrame, rules: DataFrame, doc: str = "doc_id") -> DataFrame:
    """A document's curated extraction if there is one, else the rules' claims."""
    return sessions.unionByName(rules.join(sessions.select(doc).distinct(), doc, "left_anti"), allowMissingColumns=True)


def span_grounded(claims: DataFrame, docs: DataFrame, doc: str = "doc_id") -> DataFrame:
    """Adds whether a claim's span occurs in its document."""
    return claims.join(docs.select(doc, F.col("text").alias("_t")), doc, "left").withColumn("span_grounded", F.coalesce(F.contains("_t", "source_span"), F.lit(False))).drop("_t")


def spans_within(spans: DataFrame, docs: DataFrame, span_id: str, doc: str, body: str = "text", words: int = 5) -> DataFrame:
    """``doc, span_id`` of the spans that occur whole, word by word, in a document; empty spans occur nowhere.

    The first ``words`` words of a span (all, if it has fewer) meet the
    documents' runs of as many words; what meets is compared whole.
    """
    split = lambda c: F.filter(F.split(c, r"\s+"), lambda w: w != "")
    s = spans.select(F.col(span_id), split(F.col(body)).alias("_w")).where(F.size("_w") > 0).withColumn("_n", F.least(F.size("_w"), F.lit(words)))
    lengths = sorted(r[0] for r in s.select("_n").distinct().collect())
    own = docs.select(doc, split(F.col(body)).alias("_w"))
    runs = F.array_distinct(F.concat(*[text.ngrams(F.col("_w"), n) for n in lengths])) if lengths else F.expr("cast(array() as array<string>)")
    met = own.select(doc, F.explode(runs).alias("_k")).join(s.select(span_id, F.array_join(F.slice("_w", F.lit(1), F.col("_n")), " ").alias("_k")), "_k").select(doc, span_id).distinct()
    padded = lambda df, key, name: df.select(key, F.concat(F.lit(" "), F.array_join("_w", " "), F.lit(" ")).alias(name))
    both = met.join(padded(s, span_id, "_s"), span_id).join(padded(own, doc, "_d"), doc)
    return both.where(F.contains("_d", F.col("_s"))).select(doc, span_id).distinct()
