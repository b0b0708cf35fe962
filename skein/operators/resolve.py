"""Entity resolution that abstains: alias at the instant, else a clear best fuzzy match, else provisional."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.types import DoubleType

from ..functions import text
from ..runtime import cut
from ..settings import DEFAULTS, Settings
from . import temporal


def _lcs(a: str, b: str) -> int:
    """Length of the longest common subsequence, by bit-parallel rows."""
    at: dict[str, int] = {}
    for i, c in enumerate(a):
        at[c] = at.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    s = full
    for c in b:
        u = s & at.get(c, 0)
        s = ((s + u) | (s - u)) & full
    return len(a) - s.bit_count()


def ratio(a: str, b: str) -> float:
    """Normalised insert-delete similarity, 0 to 100."""
    return 200.0 * _lcs(a, b) / (len(a) + len(b)) if a or b else 100.0


def partial_ratio(a: str, b: str) -> float:
    """Best :func:`ratio` of the shorter text with a window of the longer, windows at the ends may be shorter."""
    if len(a) > len(b):
        a, b = b, a
    if not a:
        return 0.0 if b else 100.0
    spans = {b[max(0, i) : i + len(a)] for i in range(1 - len(a), len(b))}
    return max(ratio(a, s) for s in spans if s)


def token_ratio(a: str, b: str, score=ratio) -> float:
    """The better of sorted tokens against each other and shared tokens against either side's whole."""
    x, y = sorted(a.split()), sorted(b.split())
    sx, sy = set(x), set(y)
    both = " ".join(sorted(sx & sy))
    ra, rb = " ".join(sorted(sx - sy)), " ".join(sorted(sy - sx))
    if score is partial_ratio and both:
        return 100.0
    ab, bb = f"{both} {ra}".strip(), f"{both} {rb}".strip()
    found = [score(" ".join(x), " ".join(y)), score(ab, bb)]
    if both:
        found += [score(both, ab), score(both, bb)]
    return max(found)


def _plain(t: str | None) -> str:
    """Letters and digits of any script in lower case, single spaces between words."""
    return " ".join("".join(c if c.isalnum() else " " for c in (t or "")).lower().split())


def weighted_ratio(a: str | None, b: str | None) -> float:
    """The weighted blend of the publicly documented WRatio: whole, token and, for unlike lengths, partial similarity; 0 for empty texts."""
    a, b = _plain(a), _plain(b)
    if not a or not b:
        return 0.0
    longer = max(len(a), len(b)) / min(len(a), len(b))
    if longer < 1.5:
        return max(ratio(a, b), 0.95 * token_ratio(a, b))
    scale = 0.9 if longer <= 8 else 0.6
    return max(ratio(a, b), scale * partial_ratio(a, b), 0.95 * scale * token_ratio(a, b, partial_ratio))


@F.pandas_udf(DoubleType())
def wratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """:func:`weighted_ratio` over Arrow batches."""
    return pd.Series([weighted_ratio(x, y) for x, y in zip(a, b, strict=True)], dtype=float)


_BAG = T.ArrayType(T.StructType([T.StructField("kind", T.IntegerType()), T.StructField("bag", T.ArrayType(T.StringType())), T.StructField("words", T.ArrayType(T.StringType())), T.StructField("n", T.IntegerType())]))


@F.pandas_udf(_BAG)
def _bags(s: pd.Series) -> pd.Series:
    """What :func:`weighted_ratio` sees of a text: its characters (each with its number), once as it is and once with each word once, and its words."""

    def of(t: str | None) -> list[dict]:
        words = _plain(t).split()
        out = []
        for kind, held in enumerate((words, sorted(set(words)))):
            seen: dict[str, int] = {}
            bag = []
            for c in " ".join(held):
                seen[c] = seen.get(c, 0) + 1
                bag.append(f"{c}{seen[c]}")
            out.append({"kind": kind, "bag": bag, "words": held if kind else [], "n": len(bag)})
        return out if words else []

    return s.map(of)


def candidates(surfaces: DataFrame, issuers: DataFrame, floor: float = DEFAULTS.block_min, top: int = 5) -> DataFrame:
    """``surface, target, score`` (0 to 1) of the best fuzzy matches by name at the floor or above, in any script; none is lost.

    A blend that reaches the floor comes from two texts (each word once or as
    they are) of which the shorter one has a share of its characters in the
    other, or from a shared word. So the texts meet at shared words, and at
    the rarest characters of the shorter one: more than it can do without.
    The bags are compared whole before anything is scored.
    """
    from .themes import top_by

    part = floor / 0.9
    share = min(floor / 100, part / (200 - part)) if part < 200 else 1.0
    side = lambda df, key, name: cut(df.select(F.col(key).alias("key"), F.col(name).alias("name")).distinct().withColumn("x", F.explode(_bags("name"))).select("key", "name", "x.*"))
    s, t = side(surfaces, "surface", "surface"), side(issuers, "issuer_id", "name")
    chars = lambda df: df.select("key", "name", "kind", "n", F.explode("bag").alias("c"))
    df = chars(s).unionByName(chars(t)).groupBy("kind", "c").agg(F.count("*").alias("df"))
    # fewer different characters than an alphabet has, times how often one occurs in a name
    rare = chars(s).withColumn("of", F.lit("s")).unionByName(chars(t).withColumn("of", F.lit("t"))).join(df, ["kind", "c"])
    rare = rare.groupBy("of", "key", "name", "kind", "n").agg(F.sort_array(F.collect_list(F.struct("df", "c"))).alias("r"))
    rare = rare.select("of", "key", "name", "kind", "n", F.explode(F.slice("r", 1, (F.col("n") - F.ceil(F.lit(share) * F.col("n") - 1e-9) + 1).cast("int"))).alias("r")).select("of", "key", "name", "kind", "n", F.col("r.c").alias("c"))
    named = lambda d, p: d.select("kind", "c", *[F.col(c).alias(f"{p}_{c}") for c in ("key", "name", "n")])
    by_char = lambda x, y, shorter: x.join(y, ["kind", "c"]).where(shorter).select("s_key", "s_name", "t_key", "t_name", "kind")
    short_s = by_char(named(rare.where("of = 's'"), "s"), named(chars(t), "t"), F.col("s_n") <= F.col("t_n"))
    short_t = by_char(named(chars(s), "s"), named(rare.where("of = 't'"), "t"), F.col("t_n") < F.col("s_n"))
    met = short_s.unionByName(short_t).distinct()
    bag = lambda d, p: d.select("kind", F.col("key").alias(f"{p}_key"), F.col("name").alias(f"{p}_name"), F.col("bag").alias(f"{p}_bag"))
    met = met.join(bag(s, "s"), ["kind", "s_key", "s_name"]).join(bag(t, "t"), ["kind", "t_key", "t_name"])
    near = F.size(F.array_intersect("s_bag", "t_bag")) >= F.lit(share) * F.least(F.size("s_bag"), F.size("t_bag")) - 1e-9
    word = lambda d, p: d.where("kind = 1").select(F.col("key").alias(f"{p}_key"), F.col("name").alias(f"{p}_name"), F.explode("words").alias("w"))
    by_word = word(s, "s").join(word(t, "t"), "w").select("s_name", "t_key", "t_name")
    both = met.where(near).select("s_name", "t_key", "t_name").unionByName(by_word).distinct()
    scored = both.select(F.col("s_name").alias("surface"), F.col("t_key").alias("target"), wratio("s_name", "t_name").alias("score")).where(F.col("score") >= floor)
    best = scored.groupBy("surface", "target").agg((F.max("score") / 100).alias("score"))
    return top_by(best, ["surface"], [F.desc("score"), F.asc("target")], top)


def resolve(surfaces: DataFrame, aliases: DataFrame, issuers: DataFrame, instant: str, must_not_link: DataFrame | None = None, s: Settings = DEFAULTS) -> DataFrame:
    """``surface, status, target_id, score`` of each different surface.

    One alias at the instant resolves. None or several: the best fuzzy match
    resolves if it reaches the threshold with the margin over the second; else
    it stays provisional, and so does a pair that must not be linked without
    the margin.
    """
    each = surfaces.select("surface").distinct()
    hits = temporal.alias_join(each.select(F.col("surface").alias("surface_form"), F.lit(instant).alias("at")), aliases)
    one = hits.groupBy(F.col("surface_form").alias("surface")).agg(F.count("*").alias("n"), F.min("target_id").alias("alias_id")).where("n = 1").drop("n")
    rest = each.join(one, "surface", "left_anti")
    c = candidates(rest, temporal.active_universe(issuers, instant), s.block_min)
    ranked = c.groupBy("surface").agg(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("neg"), "target"))).alias("c"))
    first, second = F.get("c", F.lit(0)), F.get("c", F.lit(1))
    got = ranked.select("surface", first["target"].alias("t1"), (-first["neg"]).alias("s1"), second["target"].alias("t2"), F.coalesce(-second["neg"], F.lit(0.0)).alias("s2"))
    if must_not_link is not None:
        no = must_not_link.select(F.least("a", "b").alias("x"), F.greatest("a", "b").alias("y"), F.lit(True).alias("no")).distinct()
        got = got.join(no, (F.least("t1", "t2") == F.col("x")) & (F.greatest("t1", "t2") == F.col("y")), "left").drop("x", "y")
    else:
        got = got.withColumn("no", F.lit(None).cast("boolean"))
    clear = (F.col("s1") >= s.accept) & (F.col("s1") - F.col("s2") >= s.margin) & ~(F.coalesce("no", F.lit(False)) & (F.col("s1") - F.col("s2") < s.margin))
    fuzzy = rest.join(got, "surface", "left").select("surface", F.when(clear, "resolved").otherwise("provisional").alias("status"), F.when(clear, F.col("t1")).alias("target_id"), F.coalesce("s1", F.lit(0.0)).alias("score"))
    return one.select("surface", F.lit("resolved").alias("status"), F.col("alias_id").alias("target_id"), F.lit(1.0).alias("score")).unionByName(fuzzy)


def naive_resolve(surfaces: DataFrame) -> DataFrame:
    """How many entities there would be if every normalised surface (NFKC, case folded, trimmed) were one."""
    return surfaces.select(text.norm_nfkc("surface").alias("s")).agg(F.count_distinct("s").alias("n_entities"))


def build_claims(extractions: DataFrame, docs: DataFrame, sources: DataFrame, resolution: DataFrame) -> DataFrame:
    """Claims of exploded extractions: subjects and objects resolved alike, ids from document and place, provisional surfaces kept as such.

    A claim whose document, or whose document's source, isn't there is an error.
    """
    each = extractions.select("doc_id", F.posexplode("claims").alias("i", "c")).select("doc_id", "i", "c.*")
    of = lambda k: resolution.select(F.col("surface").alias(f"_{k}"), F.col("target_id").alias(f"_{k}_id"))
    got = each.join(of("s"), F.col("subject_surface") == F.col("_s"), "left").join(of("o"), F.col("object_text") == F.col("_o"), "left")
    name = lambda known, surface: F.when(F.coalesce(surface, F.lit("")) == "", F.lit("")).otherwise(F.coalesce(known, F.concat(F.lit("provisional::"), surface)))
    got = got.withColumn("subject_id", name(F.col("_s_id"), F.col("subject_surface"))).withColumn("object_id", name(F.col("_o_id"), F.col("object_text")))
    there = F.lit(True)
    d = docs.select("doc_id", "source_id", "event_time", "ingest_time", F.col("ingest_time").alias("knowledge_time"), there.alias("_d"))
    got = got.withColumn("claim_id", F.concat("doc_id", F.lit("#c"), "i")).drop("_s", "_s_id", "_o", "_o_id", "i")
    got = got.join(d, "doc_id", "left").join(sources.select("source_id", "credibility", there.alias("_k")), "source_id", "left")
    lost = F.when(F.col("_d").isNull(), F.raise_error(F.concat(F.lit("no document "), "doc_id"))).when(F.col("_k").isNull(), F.raise_error(F.concat(F.lit("no source "), "source_id")))
    return got.withColumn("credibility", F.coalesce(lost.cast("double"), F.col("credibility"))).drop("_d", "_k")
