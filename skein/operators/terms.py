"""Emergent terms, phrases, noise outlets and bridges between entities."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..runtime import cut, drop_cut
from .evidence import ranked
from .themes import cooccurrence


def doc_frequency(tokens: DataFrame, key: str = "doc_id", item: str = "term") -> DataFrame:
    """``term, df`` of rows (doc, term) that are distinct."""
    return tokens.groupBy(item).agg(F.count(key).alias("df"))


def topical(docs: DataFrame, stop: tuple[str, ...] = (), key: str = "doc_id", body: str = "text") -> DataFrame:
    return docs.select(F.col(key).alias("doc_id"), F.explode(text.topical_tokens(F.col(body), stop)).alias("term"))


#: Members of sets that a task of :func:`partners` holds (about), and terms whose partners are counted before the bound is known, as a multiple of ``top``.
HELD, FIRST = 12_000_000, 8
#: Partners of a term at the bound that :func:`likeliest` looks at (about), and by how many standard deviations fewer a term may show there.
SEEN, DEVIATIONS = 8_192, 8
#: Kept terms whose numbers are broadcast at most (some 32 MB).
MOST_KEPT = 2_000_000


def kept_sets(tokens: DataFrame, kept: DataFrame, key: str = "doc_id", item: str = "term") -> DataFrame:
    """``s``: the different sets of two or more kept terms (``h``, the term's 64-bit hash, and ``code``, its number) in the rows, written."""
    codes = kept.select("h", "code")
    h = tokens.select(key, F.xxhash64(item).alias("h")).join(F.broadcast(codes) if codes.count() <= MOST_KEPT else codes, "h")
    sets = h.groupBy(key).agg(F.array_sort(F.collect_set("code")).alias("s")).where(F.size("s") > 1)
    return cut(sets.groupBy(F.xxhash64("s").alias("h"), F.hash("s").alias("g")).agg(F.first("s").alias("s")).select("s"))


def most_partners(sets: DataFrame, sizes: list[int]) -> DataFrame:
    """``code, most, guess, rows``: a bound of each term's different partners, about how many they are, and its sets.

    Terms are numbered by falling frequency, in groups of ``sizes``. A term has
    no more partners of a group than the group has terms, nor than its sets
    have members of it, all added up.
    """
    ends = np.cumsum(sizes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got, rows = np.zeros((len(ends), ends[-1] + 1), np.int32), np.zeros(ends[-1] + 1, np.int64)
        for x in batches:
            s = x.column("s")
            row = np.repeat(np.arange(len(s)), pc.list_value_length(s).to_numpy(zero_copy_only=False))
            code = s.flatten().to_numpy()
            group = np.searchsorted(ends, code)
            rows += np.bincount(code, minlength=len(rows))
            for g in range(len(ends)):
                n = np.bincount(row[group == g], minlength=len(s))
                # beyond any number of terms it doesn't matter how many
                got[g] = np.minimum(got[g] + np.bincount(code, n[row] - (group == g), len(rows)), 1 << 30).astype(np.int32)
        met = np.flatnonzero(rows)
        yield pa.RecordBatch.from_arrays([pa.array(met.astype(np.int32)), pa.array(rows[met]), *[pa.array(x[met]) for x in got]], ["code", "rows", *[f"u{g}" for g in range(len(ends))]])

    seen = sets.mapInArrow(run, "code int, rows long, " + ", ".join(f"u{g} int" for g in range(len(ends))))
    seen = seen.groupBy("code").agg(F.sum("rows").alias("rows"), *[F.sum(f"u{g}").alias(f"u{g}") for g in range(len(ends))])
    most = [F.least(F.lit(int(n)), F.col(f"u{g}")) for g, n in enumerate(sizes)]
    guess = [F.lit(float(n)) * (1 - F.exp(-F.col(f"u{g}") / F.lit(float(n)))) for g, n in enumerate(sizes) if n]
    return seen.select("code", sum(most[1:], most[0]).alias("most"), sum(guess[1:], guess[0]).alias("guess"), "rows")


def _mixed(code: np.ndarray) -> np.ndarray:
    """Numbers of terms as even 32-bit hashes."""
    x = code.astype(np.uint32)
    for k in (0x7FEB352D, 0x846CA68B):
        x = (x ^ (x >> np.uint32(16))) * np.uint32(k)
    return x ^ (x >> np.uint32(16))


def grid(own: int, other: int) -> tuple[int, int]:
    """Shares of terms and of partners for which a task holds about ``HELD`` members and the least is moved.

    Each share of partners gets all the terms' members ``own``, each share of
    terms all the partners' members ``other``.
    """
    tasks = max(8, -(-(own + other) // HELD))
    of_terms = max(1, round(math.sqrt(tasks * own / max(other, 1))), -(-2 * own // HELD))
    return of_terms, max(1, -(-8 // of_terms), -(-other // (HELD - own // of_terms)))


def partners(sets: DataFrame, of: np.ndarray, shares: tuple[int, int], part_of: int = 1) -> DataFrame:
    """``code, n``: with how many different terms each of the terms ``of`` (sorted numbers) is in a set.

    The terms and their partners are dealt out by number into ``shares`` (of
    terms, of partners); a task holds what the sets have of its two shares and
    marks each term's partners in a flat array. No pair is ever a row, and a
    term's counts of the shares add up. With ``part_of`` only partners whose
    hash is a multiple of it count.
    """
    of_terms, ranges = shares
    # a key for each task, so that the shares are spread evenly
    n_keys = of_terms * ranges
    slot = sets.sparkSession.range(40 * n_keys).select(F.col("id").cast("int").alias("k"), F.pmod(F.hash(F.col("id").cast("int")), F.lit(n_keys)).alias("p"))
    keys = np.array([r["k"] for r in slot.groupBy("p").agg(F.min("k").alias("k")).orderBy("p").collect()], np.int32)
    n_tasks = len(keys)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lists = lambda values, first: pa.ListArray.from_arrays(pa.array(np.r_[first, len(values)].astype(np.int32)), pa.array(values.astype(np.int32)))
        for x in batches:
            s = x.column("s")
            all_rows = np.repeat(np.arange(len(s)), pc.list_value_length(s).to_numpy(zero_copy_only=False))
            codes = s.flatten().to_numpy()
            at = np.minimum(np.searchsorted(of, codes), len(of) - 1)
            mine = of[at] == codes
            own_row, own_at = all_rows[mine], at[mine]
            if part_of > 1:
                some = _mixed(codes) % part_of == 0
                all_rows, codes = all_rows[some], codes[some]
            for k in range(of_terms):
                here = own_at % of_terms == k
                n_of, at = np.bincount(own_row[here], minlength=len(s)), own_at[here]
                begin = np.cumsum(n_of) - n_of
                # rows without a term of this share have nothing to tell
                told = n_of[all_rows] > 0
                row, code = all_rows[told], codes[told]
                part = code % ranges
                order = np.lexsort((row, part))
                part, row, code = part[order], row[order], code[order]
                first = np.flatnonzero(np.diff(part, prepend=-1) | np.diff(row, prepend=-1))
                times = n_of[row[first]]
                gave = np.cumsum(times) - times
                own = at[np.arange(times.sum()) + np.repeat(begin[row[first]] - gave, times)]
                yield pa.RecordBatch.from_arrays([pa.array(keys[(part[first] * of_terms + k) % n_tasks]), lists(own, gave), lists(code, first)], ["part", "own", "other"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [(x.column(name).flatten().to_numpy(), pc.list_value_length(x.column(name)).to_numpy(zero_copy_only=False)) for x in batches for name in ("own", "other")]
        if not held:
            return
        own, n_own, other, n_other = (np.concatenate([x[k] for x in held[i::2]]) for i in (0, 1) for k in (0, 1))
        begin = np.cumsum(n_other, dtype=np.int64) - n_other
        cell = np.repeat(np.arange(len(n_own), dtype=np.int32), n_own)
        order = np.argsort(own, kind="stable")
        own, cell = own[order], cell[order]
        first = np.flatnonzero(np.diff(own, prepend=-1))
        n, seen = np.zeros(len(first), np.int64), np.zeros(other.max() + 1, bool)
        for k, (lo, hi) in enumerate(zip(first.tolist(), np.r_[first[1:], len(own)].tolist(), strict=True)):
            seen[:] = False
            for i in range(lo, hi, 4096):
                c = cell[i : min(i + 4096, hi)]
                m = n_other[c]
                seen[other[np.arange(m.sum()) + np.repeat(begin[c] - np.cumsum(m) + m, m)]] = True
            # a term isn't its own partner
            me = of[own[lo]]
            n[k] = np.count_nonzero(seen) - int(me < len(seen) and seen[me])
        yield pa.RecordBatch.from_arrays([pa.array(of[own[first]]), pa.array(n)], ["code", "n"])

    dealt = sets.mapInArrow(deal, "part int, own array<int>, other array<int>").repartition(n_tasks, "part")
    return dealt.mapInArrow(count, "code int, n long").groupBy("code").agg(F.sum("n").alias("n"))


def likeliest(sets: DataFrame, of: np.ndarray, bound: int, own: int, other: int) -> np.ndarray:
    """Of the terms ``of`` those that can have ``bound`` partners, by the partners in an even share of all terms.

    A term of so many partners shows fewer than ``DEVIATIONS`` standard
    deviations below the mean with a chance of 10^-14 (and all terms stay where the share would be too small to tell).
    """
    part_of = bound // SEEN
    if part_of < 2:
        return of
    mean = bound / part_of
    seen = partners(sets, of, grid(own, other // part_of), part_of).where(F.col("n") >= mean - DEVIATIONS * math.sqrt(mean))
    return np.sort(np.array([r["code"] for r in seen.select("code").collect()], np.int32))


def emergent(tokens: DataFrame, n_docs: int, df_low: int = 10, df_high: float = 0.02, least: int = 5, top: int = 120) -> tuple[DataFrame, DataFrame]:
    """(terms, edges): terms of middling frequency with most partners, and the edges among the best ``top``.

    Terms are ranked by their partners among all kept terms; of the ``top``
    that stay, ``degree`` counts the partners among themselves, and edges need
    ``least`` documents. Partners are counted for those terms only that can be
    among the best: first for the likeliest ones, then for all whose
    bound reaches the ``top``-th count found and, if these are many, that an
    even share of the partners doesn't rule out (:func:`likeliest`). The driver
    gets the numbers of these. Edges come from the few rows of the best terms.
    """
    df = doc_frequency(tokens).where((F.col("df") >= df_low) & (F.col("df") <= df_high * n_docs)).withColumn("h", F.xxhash64("term"))
    df = cut(ranked(df, "df", "term", "code"))
    sets = kept_sets(tokens, df)
    sizes = [r["count"] for r in df.groupBy(F.floor(F.log2("df")).alias("g")).count().orderBy(F.desc("g")).collect()]
    best = df.withColumn("n", F.lit(0).cast("long"))
    if sizes:
        most = cut(most_partners(sets, sizes))
        members = most.agg(F.coalesce(F.sum("rows"), F.lit(0))).first()[0]
        codes = lambda x: np.sort(np.array([r["code"] for r in x.select("code").collect()], np.int32))
        rows = lambda of: int(most.join(F.broadcast(most.sparkSession.createDataFrame(pa.table({"code": of}))), "code").agg(F.sum("rows")).first()[0])
        likely = codes(most.orderBy(F.desc("guess"), "code").limit(FIRST * top))
        counted = cut(partners(sets, likely, grid(rows(likely), members))) if len(likely) else most.select("code", F.col("most").alias("n"))
        bound, n = counted.orderBy(F.desc("n")).limit(top).agg(F.min("n"), F.count("*")).first()
        more = np.setdiff1d(codes(most.where(F.col("most") >= (bound if n >= top else 0))), likely)
        if len(more) > FIRST * top and n >= top:
            more = likeliest(sets, more, bound, rows(more), members)
        if len(more):
            counted = counted.unionByName(cut(partners(sets, more, grid(rows(more), members))))
        # terms in a set that aren't counted have fewer partners than the best; terms in none have no partners
        met = df.join(most.select("code", F.lit(True).alias("met")), "code", "left").join(counted, "code", "left")
        best = met.where("n is not null or met is null").withColumn("n", F.coalesce("n", F.lit(0)))
    drop_cut(sets)
    best = cut(best.orderBy(F.desc("n"), F.desc("df"), "term").limit(top).select("term", "df"))
    pairs = cut(cooccurrence(tokens.join(F.broadcast(best.select("term")), "term", "left_semi"), 1, item="term"))
    inside = pairs.select(F.explode(F.array("a", "b")).alias("term")).groupBy("term").agg(F.count("*").alias("degree"))
    terms = best.join(inside, "term", "left").select("term", "df", F.coalesce("degree", F.lit(0)).alias("degree"))
    return terms, pairs.where(F.col("w") >= least)


def phrase_lift(docs: DataFrame, themes: Sequence[str], least: int = 4, top: int = 30, least_bucket: int = 8, stop: tuple[str, ...] = (), body: str = "text", tags: str = "themes") -> DataFrame:
    """Phrases of 2 and 3 words that a theme has more often than the corpus: lift times log1p of the count.

    docs: with an array of each document's themes (``themes.tagged``). Each
    phrase is made once, and its documents, all and by theme, are counted in
    one grouped sum. The driver gets the themes' sizes.
    """
    from .themes import top_by

    held = [F.array_contains(tags, t) for t in themes]
    total, *sizes = docs.agg(F.count("*"), *[F.count_if(h) for h in held]).first()
    words = docs.select(text.topical_tokens(F.col(body), stop, distinct=False).alias("w"), *[h.alias(f"t{i}") for i, h in enumerate(held)])
    grams = words.select(F.explode(F.array_distinct(F.concat(text.ngrams(F.col("w"), 2), text.ngrams(F.col("w"), 3)))).alias("phrase"), *words.columns[1:])
    counts = grams.groupBy("phrase").agg(F.count("*").alias("df"), *[F.count_if(F.col(f"t{i}")).alias(f"c{i}") for i in range(len(held))]).where(F.col("df") >= least)
    one = lambda i, t: F.struct(F.lit(t).alias("theme"), F.col(f"c{i}").alias("c"), F.lit(sizes[i]).cast("long").alias("n"))
    large = [one(i, t) for i, t in enumerate(themes) if sizes[i] >= least_bucket]
    each = F.array(*large) if large else F.expr("cast(array() as array<struct<theme:string,c:bigint,n:bigint>>)")
    got = counts.select("phrase", "df", F.explode(F.filter(each, lambda x: x["c"] >= least)).alias("x")).select("phrase", "df", "x.*")
    got = got.withColumn("lift", F.round((F.col("c") / F.col("n")) / (F.col("df") / F.lit(total)), 6))
    got = got.withColumn("score", F.round(F.col("lift") * F.log1p("c"), 6))
    return top_by(got, ["theme"], [F.desc("score"), F.asc("phrase")], top).select("theme", "phrase", "c", "df", "lift", "score")


def noise_outlets(docs: DataFrame, pattern: str, least: int = 10, ratio: float = 0.55, outlet: str = "source", body: str = "text") -> DataFrame:
    """Outlets with at least ``least`` documents of which ``ratio`` or more match the boilerplate pattern."""
    hit = F.avg(F.when(F.lower(body).rlike(pattern), 1.0).otherwise(0.0))
    return docs.groupBy(outlet).agg(F.count("*").alias("n"), F.round(hit, 6).alias("ratio")).where((F.col("n") >= least) & (F.col("ratio") >= ratio))


def bridges(mentions: DataFrame, rows: DataFrame, low: int = 2, high: int = 8) -> DataFrame:
    """``a, b, n_terms``: entities that share specific terms (held by ``low`` to ``high`` entities) but never a row.

    mentions: (ent, term); rows: (row, ent). Terms of many entities are left
    out by the definition, so no term's pairs are more than high * (high - 1) / 2.
    """
    held = mentions.distinct()
    few = held.groupBy("term").agg(F.count("*").alias("n")).where(F.col("n").between(low, high)).select("term")
    specific = held.join(few, "term", "left_semi")
    shared = cooccurrence(specific, 1, key="term", item="ent").withColumnRenamed("w", "n_terms")
    direct = cooccurrence(rows, 1, key="row", item="ent").select("a", "b")
    return shared.join(direct, ["a", "b"], "left_anti")


def profile_cosine(profiles: DataFrame, pairs: DataFrame) -> DataFrame:
    """Cosine of the term-count vectors (ent, term, c) of each pair (a, b)."""
    norm = profiles.groupBy("ent").agg(F.sqrt(F.sum(F.col("c") * F.col("c"))).alias("n"))
    x = profiles.select(F.col("ent").alias("a"), "term", F.col("c").alias("ca"))
    y = profiles.select(F.col("ent").alias("b"), "term", F.col("c").alias("cb"))
    dot = pairs.select("a", "b").join(x, "a").join(y, ["b", "term"]).groupBy("a", "b").agg(F.sum(F.col("ca") * F.col("cb")).alias("dot"))
    na, nb = norm.select(F.col("ent").alias("a"), F.col("n").alias("na")), norm.select(F.col("ent").alias("b"), F.col("n").alias("nb"))
    return dot.join(na, "a").join(nb, "b").select("a", "b", F.round(F.col("dot") / (F.col("na") * F.col("nb")), 6).alias("cosine"))
