"""Quality rules: base counts of each text and a hashed n-gram log-likelihood ratio.

Two multinomials over hashed word 1- and 2-grams are counted: one of the texts
that labels call good (the trusted target), one of the whole corpus. A text's
score is the mean over its n-grams of ``ln p_target - ln p_corpus``; it is kept
if the score reaches a fixed threshold. Everything is a DataFrame expression.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WHITE, WHITE_RE, const_array, held

#: Least hash buckets of the multinomials; the prior's weight (n-grams for each bucket); labelled rows used at most.
BUCKETS, SMOOTH, MOST_LABELS = 16_384, 8.0, 200_000
#: Least mean log ratio of a kept text.
THRESHOLD = -0.075
#: Symbols that n_symbols counts (fixed values).
SYMBOLS = "#*$%&|<>"


def _words(docs: DataFrame, doc_id: str, text: str, *more: str) -> DataFrame:
    """doc_id, text, other columns, and h: the hash of each word in order."""
    found = F.filter(F.split(F.col("text"), WHITE_RE), lambda w: w != "")
    return docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"), *more).withColumn("h", F.transform(found, lambda w: F.xxhash64(w)))


def _window(n: int) -> Column:
    """The hash of each run of n words, from column h."""
    return F.when(F.size("h") >= n, F.transform(F.sequence(F.lit(0), F.size("h") - n), lambda i: F.xxhash64(*[F.get("h", i + k) for k in range(n)]))).otherwise(F.expr("cast(array() as array<bigint>)"))


def _grams(buckets: int) -> Column:
    """The bucket of each word and each pair of words, from column h."""
    return F.transform(F.concat("h", _window(2)), lambda x: F.pmod(x, F.lit(buckets)).cast("int"))


def buckets_for(docs: DataFrame, text: str = "text") -> int:
    """How many buckets the multinomials have: the square root of the texts' bytes, ``BUCKETS`` at least.

    Different n-grams grow slower than the texts, and the ratios are constants
    of the plan: 30 GB have 173,000 buckets, 100 TB ten million (80 MB).
    """
    size = docs.agg(F.sum(F.octet_length(F.col(text)).cast("long"))).first()[0]
    return max(BUCKETS, math.isqrt(size or 0))


def log_ratios(docs: DataFrame, labels: DataFrame, buckets: int, doc_id: str = "doc_id", text: str = "text", label_id: str = "doc_id", good: str = "quality", smooth: float = SMOOTH, most_labels: int = MOST_LABELS) -> list[float]:
    """``ln p_target - ln p_corpus`` of each bucket; ``buckets`` numbers reach the driver.

    The corpus multinomial counts all documents, and a uniform 1 for each
    bucket. The target's counts those with label 1, at most ``most_labels`` of
    them (by a hash of the id), so the broadcast ids are bounded; its prior is the
    corpus, ``smooth`` n-grams for each bucket, so that what few trusted texts
    haven't shown counts little against a text. Without any trusted text all
    ratios are 0.
    """
    trusted = labels.where(F.col(good) == 1).select(F.col(label_id).cast("long").alias("_id")).dropna().distinct().orderBy(F.xxhash64("_id"), "_id").limit(most_labels)
    rows = _words(docs, doc_id, text).join(F.broadcast(trusted.withColumn("_t", F.lit(1))), F.col("doc_id") == F.col("_id"), "left")
    counted = rows.select("_t", F.explode(_grams(buckets)).alias("b")).groupBy("b").agg(F.count("*").alias("n"), F.count("_t").alias("t")).collect()
    n, t = [1.0] * buckets, [0.0] * buckets
    for b, all_of, trusted_of in counted:
        n[b] += all_of
        t[b] += trusted_of
    sum_n, sum_t, prior = math.fsum(n), math.fsum(t), smooth * buckets
    if not sum_t:
        return [0.0] * buckets
    return [math.log((y + prior * x / sum_n) / (sum_t + prior)) - math.log(x / sum_n) for x, y in zip(n, t, strict=True)]


def _judged(rows: DataFrame, ratios: list[float], threshold: float, buckets: int) -> DataFrame:
    """Rows of :func:`_words` with the base counts, score and verdict; other columns stay."""
    weights = const_array([repr(round(x, 12)) for x in ratios], "double")
    lines = F.filter(F.split("text", "\n"), lambda x: F.translate(x, WHITE, "") != "")
    got = rows.withColumn("w3", _window(3)).withColumn("grams", _grams(buckets)).withColumn("lines", lines)
    repeats = F.size(F.array_distinct("w3")) < F.size("w3")
    got = got.select(
        *rows.columns[:-1],
        F.size("h").cast("long").alias("n_words"),
        F.length(F.translate("text", WHITE, "")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.translate("text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        # windows by hash, so that equal ones are neighbours
        F.when(repeats, F.sort_array(F.transform("w3", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))).alias("by_hash"),
        (F.aggregate("grams", F.lit(0.0), lambda a, b: a + F.get(weights, b)) / F.greatest(F.size("grams"), F.lit(1))).alias("score"),
    )
    got = got.withColumn("score", held(F.col("score"))).withColumn("by_hash", held(F.col("by_hash")))
    same = lambda x, k: F.coalesce(F.get("by_hash", k)["h"] == x["h"], F.lit(False))
    twice = F.filter("by_hash", lambda x, k: same(x, k - 1) | same(x, k + 1))
    got = got.withColumn("at", F.sort_array(F.transform(twice, lambda x: x["i"])))
    # a window covers three words, or as many as there are before the next one begins
    covered = F.aggregate(F.transform("at", lambda p, k: F.least(F.lit(3), F.coalesce(F.get("at", k + 1) - p, F.lit(3)))), F.lit(0), lambda a, b: a + b)
    got = got.withColumn("n_repeat_words", held(F.coalesce(covered, F.lit(0)).cast("long")))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return got.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & (F.col("score") >= threshold))


def quality_rules(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD, buckets: int | None = None, **of_labels) -> DataFrame:
    """Base counts, score and verdict of every row.

    Returns doc_id, n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words, base_failed, score, kept. A null text counts as empty: no
    words, base_failed, score 0. buckets: see :func:`buckets_for`. Repeated rows and null ids stay. Empty tables
    give no rows. Other columns are ignored, whatever their names.
    """
    buckets = buckets or buckets_for(docs, text)
    ratios = log_ratios(docs, labels, buckets, doc_id, text, **of_labels)
    got = _judged(_words(docs, doc_id, text), ratios, threshold, buckets)
    return got.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "score", "kept")


def keep_good(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD, buckets: int | None = None, **of_labels) -> DataFrame:
    """The rows of ``docs`` that :func:`quality_rules` keeps, with all their columns; no shuffle besides the counts'."""
    buckets = buckets or buckets_for(docs, text)
    ratios = log_ratios(docs, labels, buckets, doc_id, text, **of_labels)
    held = docs.select(F.struct("*").alias("row"), F.col(text).alias("text"))
    rows = _words(held.withColumn("doc_id", F.lit(None)), "doc_id", "text", "row")
    return _judged(rows, ratios, threshold, buckets).where("kept").select("row.*")
