"""Composed views: the theme view, and bridges between entities with their evidence."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import lexicons as L
from ..functions import lookup, text
from ..runtime import cut
from . import neardup, themes
from .terms import profile_cosine
from .themes import top_by


def stories(claims: DataFrame, known: tuple[str, ...] = L.QUALITY_OUTLETS, **of_collapse) -> DataFrame:
    """Stories (``id, text, day, ents, n_src``) of headline claims (id, text, day, ent, outlet): vetted outlets' only, cleaned, rewrites collapsed."""
    vetted = claims.where(text.is_quality_outlet(F.col("outlet"), known) & (F.coalesce("text", F.lit("")) != ""))
    clean = vetted.select("id", "day", "ent", text.clean_headlines(F.col("text"), F.col("outlet"), known).alias("text"))
    got = neardup.collapse_stories(clean, **of_collapse)
    return got.select(F.col("root").alias("id"), "text", F.col("day").cast("date").alias("day"), "ents", "n_src")


def theme_view(found: DataFrame, spine: dict[str, list[str]], as_of: str, children: dict[str, tuple[str, list[str]]] | None = None, bull=L.BULLISH, bear=L.BEARISH, least: int = 4, most_edges: int = 60, prices: DataFrame | None = None, with_heads: bool = True) -> dict[str, DataFrame]:
    """nodes, edges, rising, days, entities and heads of stories (id, text, day, ents).

    spine: parent theme to keywords; children: child theme to (parent,
    keywords). nodes: frequency, decay-weighted heat and stances, surge, trend,
    children, related parents, and whether no edge reaches it. edges: of
    parents only, the ``most_edges`` heaviest with ``least`` stories, and for a
    parent without any its strongest one of two stories (``weak``); lift to
    one digit, ``volume_only`` below 1.5. entities: those that stand out in a
    theme, with the fields of ``prices`` (ent, ...) where they are known.
    heads (up to eight a theme, no near repeats) and rising take several
    passes over the headlines and are left out on request.
    """
    children = children or {}
    words = spine | {c: kws for c, (_, kws) in children.items()}
    tagged = themes.tagged(found.select("id", "text", "day", F.coalesce("ents", F.expr("cast(array() as array<string>)")).alias("ents")), words)
    tagged = cut(tagged.withColumn("stance", text.stance(F.col("text"), bull, bear)).withColumn("head", F.substring(F.regexp_replace(F.trim("text"), r"\\s+", " "), 1, 120)).drop("text"))
    n = tagged.count()
    tags = tagged.select("id", "day", "stance", "head", F.explode("themes").alias("theme"))
    w = themes.numbers.decay(F.col("day"), as_of, themes.DEFAULTS.half_life_days, themes.DEFAULTS.undated_weight)
    part = lambda s: F.round(F.sum(F.when(F.col("stance") == s, w).otherwise(0.0)), 1)
    nodes = cut(tags.groupBy("theme").agg(F.count("*").alias("freq"), F.round(F.sum(w), 1).alias("heat"), part("bullish").alias("bull"), part("bearish").alias("bear"), part("neutral").alias("neut")))
    days = cut(themes.day_buckets(tags.where("day is not null")))
    surges = themes.surge(days, as_of).select("theme", "surge", "recent_n")

    parents = F.array_sort(F.filter("themes", lambda t: t.isin(*spine)))
    rows = tagged.select(parents.alias("p"), "stance").where(F.size("p") > 1).select(F.posexplode("p").alias("i", "a"), "p", "stance")
    rows = rows.select("a", F.explode(F.slice("p", F.col("i") + 2, F.size("p"))).alias("b"), "stance")
    of = lambda s: F.count_if(F.col("stance") == s)
    pairs = cut(rows.groupBy("a", "b").agg(F.count("*").alias("w"), of("bullish").alias("bull"), of("bearish").alias("bear"), of("neutral").alias("neut")))
    strong = pairs.where(F.col("w") >= least).orderBy(F.desc("w"), "a", "b").limit(most_edges)
    present = sorted(r[0] for r in nodes.where(F.col("theme").isin(*spine)).select("theme").collect())
    added, alone = themes.rescue(strong, pairs, present)
    spark = found.sparkSession
    weak = pairs.join(spark.createDataFrame([x[:2] for x in added], "a string, b string"), ["a", "b"], "left_semi")
    edges = strong.withColumn("weak", F.lit(False)).unionByName(weak.withColumn("weak", F.lit(True)))
    freq = lambda k: nodes.select(F.col("theme").alias(k), F.col("freq").alias(f"f{k}"))
    edges = edges.join(freq("a"), "a").join(freq("b"), "b").withColumn("lift", F.round(F.col("w") / (F.col("fa") * F.col("fb") / F.lit(float(max(1, n)))), 1))
    edges = edges.withColumn("volume_only", ~F.col("weak") & (F.col("lift") < 1.5)).select("a", "b", "w", "lift", "volume_only", "weak", "bull", "bear", "neut")

    both = pairs.where(F.col("w") >= least).select("a", "b", "w").unionByName(pairs.where(F.col("w") >= least).select(F.col("b").alias("a"), F.col("a").alias("b"), "w"))
    related = top_by(both, ["a"], [F.desc("w"), F.desc("b")], 6, "k").groupBy(F.col("a").alias("theme")).agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "b"))), lambda x: x["b"]).alias("related"))
    kin = spark.createDataFrame([(c, p) for c, (p, _) in children.items()], "theme string, parent string")
    kids = nodes.join(kin, "theme").groupBy(F.col("parent").alias("theme")).agg(F.array_sort(F.collect_list("theme")).alias("children"))
    none = F.expr("cast(array() as array<string>)")
    nodes = nodes.join(kin, "theme", "left").join(surges, "theme", "left").join(themes.trend(days, as_of), "theme", "left").join(related, "theme", "left").join(kids, "theme", "left")
    nodes = nodes.withColumn("level", F.when(F.col("parent").isNull(), 0).otherwise(1)).withColumn("related", F.coalesce("related", none)).withColumn("children", F.coalesce("children", none))
    nodes = nodes.withColumn("isolated", F.col("theme").isin(*alone) if alone else F.lit(False)).withColumn("recent_n", F.coalesce("recent_n", F.lit(0)))

    entities = themes.anchors(tags.select("id", "theme"), tagged.select("id", F.explode("ents").alias("ent")), key="id")
    if prices is not None:
        entities = entities.join(prices, "ent", "left")
    out = {"nodes": nodes, "edges": edges, "days": days, "entities": entities}
    if not with_heads:
        return out
    order = tags.select("theme", "day", "head", "stance", "id").withColumn("late", F.datediff(F.lit("9999-12-31"), F.coalesce("day", F.lit("1970-01-01").cast("date")))).withColumn("mild", F.col("stance") == "neutral")
    heads = neardup.diverse(order, "theme", ["mild", "late", "head", "id"], "head").select("theme", "day", "head", "stance")
    rising = themes.rising(nodes.select("theme", "parent", "surge", "recent_n"), heads.select("theme", "day", F.col("head").alias("text")))
    return out | {"rising": rising, "heads": heads}


def mine_bridges(heads: DataFrame, terms: tuple[str, ...], context: tuple[str, ...], families: dict[str, tuple[str, ...]] = lookup.FAMILIES, low: int = 2, high: int = 8, rich: int = 3, near: float = 0.35) -> DataFrame:
    """Pairs of entities that share a specific term, were never named together, and aren't of one group.

    heads: (id, text, ents). ``a, b, terms, n_terms, cosine, rarity, flag,
    evidence_a, evidence_b``: cosine is that of the pair's context
    counts, to two digits; flag is ``thin`` if either has fewer than ``rich``,
    else ``alike`` from ``near`` on, else ``apart`` (one word, two meanings);
    rarity: documents of the rarest shared term; evidence: the entity's first
    headline with the pair's first term. Named together: in a headline of ``low`` to ``high`` entities.
    """
    hits = lambda words: F.filter(F.array(*[F.when(text.bridge_hit(F.col("text"), t), F.lit(t)) for t in words]), lambda x: x.isNotNull())
    rows = heads.where(F.trim(F.coalesce("text", F.lit(""))) != "").select("id", F.trim("text").alias("text"), F.array_sort(F.array_distinct("ents")).alias("ents"))
    rows = cut(rows.withColumn("hit", hits(terms)).withColumn("seen", hits(context)))
    df = rows.select(F.explode("hit").alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    held = cut(rows.select("id", "text", "ents", F.explode("hit").alias("term")).select("term", F.explode("ents").alias("ent"), "id", "text").groupBy("term", "ent").agg(F.min_by("text", "id").alias("evidence")))
    few = rows.where(F.size("ents").between(low, high)).select(F.posexplode("ents").alias("i", "a"), "ents")
    direct = few.select("a", F.explode(F.slice("ents", F.col("i") + 2, F.size("ents"))).alias("b")).distinct()
    x, y = held.select("term", F.col("ent").alias("a")), held.select("term", F.col("ent").alias("b"))
    shared = x.join(y, "term").where("a < b").join(df, "term").groupBy("a", "b").agg(F.array_sort(F.collect_list("term")).alias("terms"), F.min("df").alias("rarity"))
    shared = cut(shared.join(direct, ["a", "b"], "left_anti").where(~lookup.same_group(F.col("a"), F.col("b"), families)))
    profiles = cut(rows.select("ents", F.explode("seen").alias("term")).select(F.explode("ents").alias("ent"), "term").groupBy("ent", "term").agg(F.count("*").alias("c")))
    cosine = profile_cosine(profiles, shared.select("a", "b"))
    mass = profiles.groupBy("ent").agg(F.sum("c").alias("m"))
    got = shared.join(cosine, ["a", "b"], "left").withColumn("cosine", F.coalesce("cosine", F.lit(0.0)))
    for k in ("a", "b"):
        got = got.join(mass.select(F.col("ent").alias(k), F.col("m").alias(f"m{k}")), k, "left")
        first = held.select(F.col("ent").alias(k), F.col("term").alias("_t"), F.col("evidence").alias(f"evidence_{k}"))
        got = got.withColumn("_t", F.get("terms", F.lit(0))).join(first, [k, "_t"], "left").drop("_t")
    thin = (F.coalesce("ma", F.lit(0)) < rich) | (F.coalesce("mb", F.lit(0)) < rich)
    got = got.withColumn("flag", F.when(thin, "thin").when(F.col("cosine") >= near, "alike").otherwise("apart")).withColumn("cosine", F.round("cosine", 2))
    return got.select("a", "b", "terms", F.size("terms").alias("n_terms"), "cosine", "rarity", "flag", "evidence_a", "evidence_b")


def ranked_bridges(pairs: DataFrame) -> DataFrame:
    """Bridges in order: more terms, higher cosine, rarer terms first, then by falling names."""
    return pairs.orderBy(F.desc("n_terms"), F.desc("cosine"), F.asc("rarity"), F.desc("a"), F.desc("b"))
