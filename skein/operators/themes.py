"""Themes: tagging, co-occurrence, lift, per-day buckets, decay heat, surge, trend, display lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import numbers, text
from ..settings import DEFAULTS

#: Fixed value: blocks of a sparkline, low to high.
BLOCKS = "▁▂▃▄▅▆▇█"


def tagged(docs: DataFrame, themes: dict[str, list[str]], body: str = "text", out: str = "themes") -> DataFrame:
    """``docs`` with an array of every theme of which a keyword occurs: one pass over the texts, one pattern for each theme."""
    hit = [F.when(text.any_keyword(F.col(body), kws), F.lit(t)) for t, kws in themes.items()]
    return docs.withColumn(out, F.filter(F.array(*hit), lambda x: x.isNotNull()))


def tag(docs: DataFrame, themes: dict[str, list[str]], key: str = "doc_id", body: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """``doc_id, theme``, a row for each theme of a document, and the columns to ``carry`` along, so that no join brings them back."""
    got = tagged(docs.select(F.col(key).alias("doc_id"), *{body: None, **dict.fromkeys(carry)}), themes, body)
    return got.select("doc_id", F.explode("themes").alias("theme"), *carry)


def cooccurrence(tags: DataFrame, least: int = 1, key: str = "doc_id", item: str = "theme") -> DataFrame:
    """``a, b, w``: in how many rows both occur, a < b. Pairs are made within a row's sorted set, without a self-join."""
    sets = tags.groupBy(key).agg(F.array_sort(F.collect_set(item)).alias("s")).where(F.size("s") > 1)
    pairs = sets.select(F.posexplode("s").alias("i", "a"), "s").select("a", F.explode(F.slice("s", F.col("i") + 2, F.size("s"))).alias("b"))
    return pairs.groupBy("a", "b").agg(F.count("*").alias("w")).where(F.col("w") >= least)


def lift(edges: DataFrame, frequency: DataFrame, total: Column, weak: float = 1.5, item: str = "theme", freq: str = "freq") -> DataFrame:
    """Edges with ``lift = w / (fa * fb / N)`` and whether mere volume explains them (below ``weak``)."""
    fa, fb = frequency.select(F.col(item).alias("a"), F.col(freq).alias("fa")), frequency.select(F.col(item).alias("b"), F.col(freq).alias("fb"))
    got = edges.join(fa, "a").join(fb, "b").withColumn("lift", F.round(F.col("w") / (F.col("fa") * F.col("fb") / total), 6))
    return got.withColumn("volume_only", F.col("lift") < weak)


def anchors(tags: DataFrame, entities: DataFrame, least: int = 3, top: int = 8, key: str = "doc_id") -> DataFrame:
    """Per theme the entities that stand out: ``score``, the theme's part of an entity's rows times log1p of the count.

    Counts are ``least`` or more, the best ``top`` stay (equal scores: by
    count, then by falling name); macro series and empty names don't count.
    """
    named = entities.where((F.coalesce("ent", F.lit("")) != "") & ~F.col("ent").startswith("MACRO:"))
    both = tags.join(named, key).groupBy("theme", "ent").agg(F.count("*").alias("c"))
    n_ent = named.groupBy("ent").agg(F.count("*").alias("n_ent"))
    got = both.where(F.col("c") >= least).join(n_ent, "ent").withColumn("score", F.round(F.col("c") / F.col("n_ent") * F.log1p("c"), 6))
    return top_by(got, ["theme"], [F.desc("score"), F.desc("c"), F.desc("ent")], top).select("theme", "ent", "c", "score")


def top_by(df: DataFrame, group: list[str], order: list, k: int, rank: str | None = None) -> DataFrame:
    """The first k rows of each group; Spark keeps k rows in each task before it shuffles."""
    got = df.withColumn(rank or "_r", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col(rank or "_r") <= k)
    return got if rank else got.drop("_r")


def day_buckets(rows: DataFrame) -> DataFrame:
    """``theme, day, count, w_bull, w_bear, w_neut`` of rows (theme, day, stance)."""
    of = lambda s: F.count_if(F.col("stance") == s)
    return rows.groupBy("theme", "day").agg(F.count("*").alias("count"), of("bullish").alias("w_bull"), of("bearish").alias("w_bear"), of("neutral").alias("w_neut"))


def heat(rows: DataFrame, as_of: str, half_life: float = DEFAULTS.half_life_days, undated: float = DEFAULTS.undated_weight) -> DataFrame:
    """Decay-weighted mentions of each theme, and the decay-weighted balance of their stances."""
    w = numbers.decay(F.col("day"), as_of, half_life, undated)
    sign = F.when(F.col("stance") == "bullish", 1.0).when(F.col("stance") == "bearish", -1.0).otherwise(0.0)
    return rows.groupBy("theme").agg(F.round(F.sum(w), 6).alias("heat"), F.round(F.sum(w * sign), 6).alias("balance"))


def surge(buckets: DataFrame, as_of: str, recent: int = 7, base: int = 28, least: int = 5) -> DataFrame:
    """Daily rate of the last ``recent`` days over that of the ``base`` days before, each rate plus 0.5; null below ``least`` recent ones.

    Days count back from the latest day with a story up to ``as_of``.
    """
    past = buckets.where(F.col("day") <= F.lit(as_of).cast("date"))
    age = F.datediff("anchor", "day")
    got = past.join(F.broadcast(past.agg(F.max("day").alias("anchor")))).groupBy("theme").agg(
        F.coalesce(F.sum(F.when(age < recent, F.col("count"))), F.lit(0)).alias("recent_n"),
        F.coalesce(F.sum(F.when((age >= recent) & (age < recent + base), F.col("count"))), F.lit(0)).alias("base_n"),
    )
    ratio = (F.col("recent_n") / recent + 0.5) / (F.col("base_n") / base + 0.5)
    return got.withColumn("surge", F.when(F.col("recent_n") >= least, F.round(ratio, 2)))


def trend(buckets: DataFrame, as_of: str, days: int = 21) -> DataFrame:
    """``theme, series``: counts of each of ``days`` calendar days up to the latest day with a story by ``as_of``, zeros filled in, oldest first."""
    last = buckets.where(F.col("day") <= F.lit(as_of).cast("date")).agg(F.coalesce(F.max("day"), F.lit(as_of).cast("date")).alias("last"))
    span = buckets.select("theme").distinct().join(F.broadcast(last)).select("theme", F.explode(F.sequence(F.date_sub("last", days - 1), F.col("last"))).alias("day"))
    full = span.join(buckets.select("theme", "day", "count"), ["theme", "day"], "left")
    row = F.struct("day", F.coalesce("count", F.lit(0)).alias("n"))
    return full.groupBy("theme").agg(F.transform(F.sort_array(F.collect_list(row)), lambda x: x["n"]).alias("series"))


def sparkline(series: Column) -> Column:
    """Blocks scaled to the largest value; all lowest if there is none above zero."""
    top = F.array_max(series)
    place = lambda v: F.when(top > 0, F.floor(v * (len(BLOCKS) - 1) / top)).otherwise(0).cast("int")
    return F.array_join(F.transform(series, lambda v: F.substring(F.lit(BLOCKS), place(v) + 1, F.lit(1))), "")


def rising(surges: DataFrame, heads: DataFrame, least: float = 1.2, top: int = 8) -> DataFrame:
    """Themes whose surge is at least ``least``, best first, with their latest headline."""
    why = heads.groupBy("theme").agg(F.max_by("text", F.struct("day", "text")).alias("why"))
    best = surges.where(F.col("surge") >= least).orderBy(F.desc("surge"), F.desc("recent_n"), "theme").limit(top)
    return best.join(why, "theme", "left")


def rescue(edges: DataFrame, weak: DataFrame, nodes: list[str]) -> tuple[list[tuple], list[str]]:
    """For each node without an edge, in order, its strongest weak edge; nodes linked on the way need none.

    Sequential by nature and bounded by the number of spine themes, so it runs
    on the driver over those few rows. Returns added edges and isolated nodes.
    """
    linked = {x for r in edges.select("a", "b").collect() for x in r}
    ranked = [tuple(r) for r in weak.where("w >= 2").orderBy(F.desc("w"), F.desc("a"), F.desc("b")).select("a", "b", "w").collect()]
    added, alone = [], []
    for node in sorted(nodes):
        if node in linked:
            continue
        best = next((e for e in ranked if node in e[:2]), None)
        if best:
            added.append(best)
            linked |= set(best[:2])
        else:
            alone.append(node)
    return added, alone
