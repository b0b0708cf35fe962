"""Residual co-movement of series: market factor, betas, pair correlations, stability gates, clusters."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import numbers
from ..runtime import cut
from .market import simple_returns
from .themes import top_by


def cohort(bars: DataFrame, length: int) -> DataFrame:
    """Series of full length that end on the day on which most series end (the latest of equals)."""
    ends = bars.groupBy("series").agg(F.max("day").alias("end"), F.count("*").alias("n"))
    day = ends.groupBy("end").agg(F.count("*").alias("c")).agg(F.max_by("end", F.struct("c", "end")).alias("end"))
    keep = ends.where(F.col("n") >= length).join(F.broadcast(day), "end").select("series")
    r = F.row_number().over(Window.partitionBy("series").orderBy(F.desc("day")))
    return bars.join(keep, "series", "left_semi").withColumn("_r", r).where(F.col("_r") <= length).drop("_r")


def residuals(rets: DataFrame, group: tuple[str, ...] = ()) -> DataFrame:
    """``series, day, resid``: each return less beta times the cross-sectional mean of its day; beta by least squares, 0 for a flat market.

    Means and betas are two grouped aggregates; ``group`` columns (windows,
    halves) are handled apart from each other.
    """
    r = rets.where("ret is not null")
    market = r.groupBy(*group, "day").agg(F.avg("ret").alias("m"))
    both = r.join(market, [*group, "day"])
    beta = both.groupBy(*group, "series").agg(F.coalesce(F.regr_slope("ret", "m"), F.lit(0.0)).alias("beta"))
    return both.join(beta, [*group, "series"]).withColumn("resid", F.col("ret") - F.col("beta") * F.col("m"))


def pair_correlations(res: DataFrame, value: str = "resid", least: int = 2, group: tuple[str, ...] = ()) -> DataFrame:
    """``a, b, r, n`` of the pairs of series, joined on their days; pairs with fewer than ``least`` days or a flat side have no r and go."""
    x = res.select(*group, "day", F.col("series").alias("a"), F.col(value).alias("x"))
    y = res.select(*group, "day", F.col("series").alias("b"), F.col(value).alias("y"))
    got = x.join(y, [*group, "day"]).where("a < b").groupBy(*group, "a", "b").agg(numbers.pearson(F.col("x"), F.col("y"), least).alias("r"), F.count("*").alias("n"))
    return got.where("r is not null")


def by_sector(pairs: DataFrame, sectors: DataFrame) -> DataFrame:
    """Adds whether both series are of one sector ("(none)" is nobody's)."""
    a, b = sectors.select(F.col("series").alias("a"), F.col("sector").alias("sa")), sectors.select(F.col("series").alias("b"), F.col("sector").alias("sb"))
    return pairs.join(a, "a").join(b, "b").withColumn("same", (F.col("sa") == F.col("sb")) & (F.col("sa") != "(none)")).drop("sa", "sb")


def distribution(pairs: DataFrame, group: tuple[str, ...] = ()) -> DataFrame:
    """Mean, population deviation and number of correlations, same-sector and cross-sector."""
    return pairs.groupBy(*group, "same").agg(F.round(F.avg("r"), 6).alias("mu"), F.round(F.stddev_pop("r"), 6).alias("sigma"), F.count("*").alias("n"))


def gap(pairs: DataFrame, group: tuple[str, ...] = ()) -> DataFrame:
    """How much higher same-sector correlations are on average."""
    same, cross = F.avg(F.when(F.col("same"), F.col("r"))), F.avg(F.when(~F.col("same"), F.col("r")))
    return pairs.groupBy(*group).agg(F.round(same - cross, 6).alias("gap"))


def halves(rets: DataFrame) -> DataFrame:
    """Adds ``half`` 0 or 1 by a bar's place among its series' bars."""
    w = Window.partitionBy("series")
    i, n = F.row_number().over(w.orderBy("day")) - 1, F.count("*").over(w)
    return rets.withColumn("half", F.when(i < F.floor(n / 2), 0).otherwise(1))


def stable(full_gap: float, half_gaps: list[float], retain: float = 0.35) -> bool:
    """All gaps above zero, and both halves hold ``retain`` of the whole."""
    return full_gap > 0 and all(g > 0 and g >= retain * full_gap for g in half_gaps)


def rolling(rets: DataFrame, length: int = 90, stride: int = 21) -> DataFrame:
    """Rows of every window of ``length`` bars, one each ``stride`` bars (column ``win``: the end's place, exclusive)."""
    w = Window.partitionBy("series")
    r = rets.withColumn("i", F.row_number().over(w.orderBy("day")) - 1).withColumn("n", F.count("*").over(w))
    # a bar lies in the windows that end after it and begin at it or before: an expression, not a range join
    ends = F.when(F.col("n") > length, F.filter(F.sequence(F.lit(length), F.col("n") - 1, F.lit(stride)), lambda e: (e > F.col("i")) & (e - length <= F.col("i"))))
    return r.withColumn("win", F.explode(ends)).drop("i", "n")


def percentile_rank(history: DataFrame, value: str, now: float) -> DataFrame:
    """Share of history at or below ``now``, in percent with one digit."""
    return history.agg(F.round(F.avg(F.when(F.col(value) <= now, 1.0).otherwise(0.0)) * 100, 1).alias("pct"))


def verify(candidates: DataFrame, pairs: DataFrame, least_z: float = 3.0) -> DataFrame:
    """Candidate pairs with z against the same- and cross-sector baselines; verified: cross-sector and z at ``least_z`` or above."""
    base = pairs.agg(*[f(F.when(c, F.col("r"))).alias(f"{n}_{k}") for n, f in (("mu", F.avg), ("sd", F.stddev_pop)) for k, c in (("same", F.col("same")), ("cross", ~F.col("same")))])
    got = pairs.join(candidates.select("a", "b"), ["a", "b"], "left_semi").join(F.broadcast(base))
    z = F.when(F.col("same"), F.try_divide(F.col("r") - F.col("mu_same"), F.col("sd_same"))).otherwise(F.try_divide(F.col("r") - F.col("mu_cross"), F.col("sd_cross")))
    got = got.withColumn("z", F.round(z, 4))
    return got.select("a", "b", F.round("r", 6).alias("r"), "same", "z", (~F.col("same") & F.coalesce(F.col("z") >= least_z, F.lit(False))).alias("verified"), numbers.grade(F.col("z"), F.col("same")).alias("grade"))


def macro_links(prices: DataFrame, macros: DataFrame, least: int = 60, floor: float = 0.5) -> DataFrame:
    """Observed correlations of each series with each macro series over their common tail: positions from the end are matched.

    An equi-join on the position, so no product of whole series is formed.
    """
    back = lambda df, name: df.where("log_ret is not null").withColumn("k", F.row_number().over(Window.partitionBy("series").orderBy(F.desc("day")))).select("k", F.col("series").alias(name), "day", "log_ret")
    p, m = back(prices, "series"), back(macros, "macro")
    both = p.withColumnRenamed("log_ret", "x").withColumnRenamed("day", "dx").join(m.withColumnRenamed("log_ret", "y").withColumnRenamed("day", "dy"), "k")
    got = both.groupBy("series", "macro").agg(numbers.pearson(F.col("x"), F.col("y"), least).alias("r"), F.count("*").alias("n_obs"), F.greatest(F.min("dx"), F.min("dy")).alias("start"), F.least(F.max("dx"), F.max("dy")).alias("end"))
    return got.where(F.abs("r") >= floor).withColumn("corr", F.round("r", 3)).drop("r")


def rand_index(labels: DataFrame, x: str = "x", y: str = "y") -> DataFrame:
    """Adjusted Rand index of two labelings, to four digits; 0 if both are trivial."""
    c2 = lambda n: n * (n - 1) / 2
    pairs = labels.groupBy(x, y).agg(F.count("*").alias("n"))
    of = lambda df: df.agg(F.sum(c2(F.col("n"))).alias("s"))
    a, b = labels.groupBy(x).agg(F.count("*").alias("n")), labels.groupBy(y).agg(F.count("*").alias("n"))
    got = of(pairs).withColumnRenamed("s", "both").join(of(a).withColumnRenamed("s", "sa")).join(of(b).withColumnRenamed("s", "sb")).join(labels.agg(c2(F.count("*")).alias("all")))
    expected = F.try_divide(F.col("sa") * F.col("sb"), F.col("all"))
    top = (F.col("sa") + F.col("sb")) / 2
    return got.select(F.round(F.coalesce(F.try_divide(F.col("both") - expected, top - expected), F.lit(0.0)), 4).alias("ari"))


def purity(members: DataFrame, cross_below: float = 0.6) -> DataFrame:
    """Per cluster its commonest sector (the first of equals), that sector's share, and whether it is too small to call the cluster a sector's."""
    n = members.groupBy("cluster", "sector").agg(F.count("*").alias("c"))
    got = n.groupBy("cluster").agg(F.sum("c").alias("n"), F.min(F.struct((-F.col("c")).alias("c"), "sector")).alias("top"))
    share = -F.col("top.c") / F.col("n")
    return got.select("cluster", "n", F.col("top.sector").alias("top_sector"), F.round(share, 6).alias("purity"), (share < cross_below).alias("cross_sector"))


def average_linkage(dist: np.ndarray, cut_at: float) -> np.ndarray:
    """Labels of average-linkage clusters whose distance stays at ``cut_at`` or below."""
    n = len(dist)
    d, size, label, alive = dist.astype(float).copy(), np.ones(n), np.arange(n), np.ones(n, bool)
    np.fill_diagonal(d, np.inf)
    while alive.sum() > 1:
        i, j = np.unravel_index(np.argmin(d), d.shape)
        if d[i, j] > cut_at:
            break
        i, j = min(i, j), max(i, j)
        d[i] = d[:, i] = (size[i] * d[i] + size[j] * d[j]) / (size[i] + size[j])
        d[i, i], size[i], alive[j] = np.inf, size[i] + size[j], False
        d[j] = d[:, j] = np.inf
        label[label == j] = i
    return np.unique(label, return_inverse=True)[1]


def silhouette(dist: np.ndarray, labels: np.ndarray) -> float:
    """Mean silhouette on given distances of the points that share a cluster, to four digits; 0 if there is none, or one cluster only."""
    kinds, own, count = np.unique(labels, return_inverse=True, return_counts=True)
    some = count[own] > 1
    if len(kinds) < 2 or not some.any():
        return 0.0
    total = dist @ (own[:, None] == np.arange(len(kinds)))
    rows = np.arange(len(labels))
    inside = (total[rows, own] - dist[rows, rows]) / np.maximum(count[own] - 1, 1)
    other = total / count
    other[rows, own] = np.inf
    outside = other.min(axis=1)
    top = np.maximum(inside, outside)
    score = np.divide(outside - inside, top, out=np.zeros(len(top)), where=top != 0)
    return round(float(score[some].mean()), 4)


#: Cuts that are tried (fixed values).
CUTS = (0.55, 0.60, 0.65, 0.70, 0.75, 0.80, 0.85)


def _distances(rows: pd.DataFrame, names: np.ndarray) -> np.ndarray:
    d = np.ones((len(names), len(names)))
    i, j = np.searchsorted(names, rows["a"].to_numpy(str)), np.searchsorted(names, rows["b"].to_numpy(str))
    d[i, j] = d[j, i] = np.clip(1 - rows["r"].to_numpy(float), 0, 2)
    np.fill_diagonal(d, 0)
    return d


def _best_cut(d: np.ndarray, cuts: tuple[float, ...], least: int) -> tuple[float, float, np.ndarray] | None:
    """(cut, silhouette, labels) of the best silhouette, the smaller cut of equals; None if no cut has two clusters of ``least``."""
    best = None
    for c in sorted(cuts):
        label = average_linkage(d, c)
        if (np.bincount(label) >= least).sum() >= 2 and (best is None or silhouette(d, label) > best[1]):
            best = c, silhouette(d, label), label
    return best


def flow_clusters(pairs: DataFrame, most: int = 2000, cuts: tuple[float, ...] = CUTS, least: int = 3) -> DataFrame:
    """``series, cluster, cut, silhouette, ari`` of the cut with the best silhouette (the smaller of equals); -1 for clusters below ``least``.

    pairs: (a, b, r), and a column ``win`` if there is more than the whole
    window (``full``): the halves ``h1`` and ``h2`` are clustered apart at the
    same cut, and ``ari`` says how far they agree (else null). A pair without a
    correlation has none (0). No cut with two clusters gives no rows.

    Clustering needs the whole distance matrix of one cohort. It runs in one
    task over at most ``most`` series (32 MB a matrix) and refuses more.
    """
    names = pairs.select(F.col("a").alias("s")).union(pairs.select("b")).distinct()
    if (n := names.count()) > most:
        raise ValueError(f"{n} series are more than the {most} that average linkage is offered for")

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        s = np.unique(np.r_[rows["a"].to_numpy(str), rows["b"].to_numpy(str)])
        got = _best_cut(_distances(rows[rows["win"] == "full"], s), cuts, least)
        if got is None:
            return pd.DataFrame({"series": np.array([], object), "cluster": np.array([], np.int32)} | {k: np.array([], float) for k in ("cut", "silhouette", "ari")})
        cut_at, score, label = got
        halves = [average_linkage(_distances(rows[rows["win"] == h], s), cut_at) for h in ("h1", "h2") if (rows["win"] == h).any()]
        ari = adjusted_rand(*halves) if len(halves) == 2 else None
        size = np.bincount(label)
        return pd.DataFrame({"series": s.astype(object), "cluster": np.where(size[label] >= least, label, -1), "cut": cut_at, "silhouette": score, "ari": ari})

    win = F.col("win") if "win" in pairs.columns else F.lit("full").alias("win")
    return pairs.select("a", "b", "r", win, F.lit(0).alias("one")).groupBy("one").applyInPandas(run, "series string, cluster int, cut double, silhouette double, ari double")


def adjusted_rand(x: np.ndarray, y: np.ndarray) -> float:
    """:func:`rand_index` of two arrays of labels."""
    c2 = lambda n: (n * (n - 1) / 2).sum()
    both = np.unique(np.stack([x, y]), axis=1, return_counts=True)[1].astype(float)
    a, b, total = c2(np.bincount(x).astype(float)), c2(np.bincount(y).astype(float)), len(x) * (len(x) - 1) / 2
    expected, top = a * b / total if total else 0.0, (a + b) / 2
    return round((c2(both) - expected) / (top - expected), 4) if top != expected else 0.0


def windows(rets: DataFrame) -> DataFrame:
    """Each return once in ``full`` and once in its half, ``h1`` or ``h2`` (column ``win``)."""
    own = F.when(F.col("half") == 0, "h1").otherwise("h2")
    return halves(rets).withColumn("win", F.explode(F.array(F.lit("full"), own))).drop("half")


def flow_report(rets: DataFrame, sectors: DataFrame, tags: DataFrame | None = None, least_names: int = 40, least: int = 3, floor: float = 0.25, least_full: int = 50, least_half: int = 40) -> tuple[DataFrame, DataFrame]:
    """(members, clusters) of an aligned cohort's returns (series, day, ret).

    members: series, cluster, sector, loading (correlation with the cluster's
    mean residual). clusters: size, purity, top sector, whether it crosses
    sectors, its three commonest themes (tags: series, theme), cut, silhouette,
    the agreement of the halves and whether it reaches ``floor``. Fewer than
    ``least_names`` series, or no cut with two clusters, give no rows.
    """
    enough = rets.agg(F.count_distinct("series").alias("_n")).where(F.col("_n") >= least_names).select(F.lit(1).alias("_ok"))
    rets = rets.join(F.broadcast(enough)).drop("_ok")
    res = residuals(windows(rets), ("win",))
    pairs = pair_correlations(res, group=("win",)).where(F.col("n") >= F.when(F.col("win") == "full", least_full).otherwise(least_half))
    found = cut(flow_clusters(pairs, least=least).where("cluster >= 0"))
    whole = res.where("win = 'full'").select("series", "day", "resid").join(found.select("series", "cluster"), "series")
    centre = whole.groupBy("cluster", "day").agg(F.avg("resid").alias("centre"))
    loading = whole.join(centre, ["cluster", "day"]).groupBy("series", "cluster").agg(F.coalesce(F.round(numbers.pearson(F.col("resid"), F.col("centre")), 2), F.lit(0.0)).alias("loading"))
    members = loading.join(sectors.select("series", "sector"), "series", "left")
    named = found.groupBy("cluster").agg(*[F.first(c).alias(c) for c in ("cut", "silhouette", "ari")])
    clusters = purity(members).join(named, "cluster").withColumn("stable", F.coalesce(F.col("ari") >= floor, F.lit(False)))
    if tags is not None:
        n = members.join(tags, "series").groupBy("cluster", "theme").agg(F.count("*").alias("c"))
        best = top_by(n, ["cluster"], [F.desc("c"), F.asc("theme")], 3, "_k").groupBy("cluster").agg(F.transform(F.array_sort(F.collect_list(F.struct("_k", "theme"))), lambda x: x["theme"]).alias("themes"))
        clusters = clusters.join(best, "cluster", "left")
    return members, clusters


def yardstick(bars: DataFrame, sectors: DataFrame, length: int = 90, least_names: int = 40, least_full: int = 50, least_half: int = 40, retain: float = 0.35, history: DataFrame | None = None) -> DataFrame:
    """One row: how much closer same-sector pairs move, in the whole window and both halves, and whether that is stable.

    issuers, mu_same and mu_cross, gap_full, gap_h1, gap_h2 (four digits);
    stable: all gaps above zero, the halves keeping ``retain`` of the whole.
    skipped: fewer than ``least_names`` series; then all is null and not
    stable. history: (gap, cross_mu) of earlier windows; the row then has the
    percentiles gap_pct and cross_mu_pct. Residuals are made in each window.
    """
    rets = simple_returns(cohort(bars, length)).where("ret is not null")
    pairs = pair_correlations(residuals(windows(rets), ("win",)), group=("win",)).where(F.col("n") >= F.when(F.col("win") == "full", least_full).otherwise(least_half))
    both = by_sector(pairs, sectors)
    mu = lambda w, s: F.round(F.avg(F.when((F.col("win") == w) & (F.col("same") == F.lit(s)), F.col("r"))), 4)
    got = both.agg(*[mu(w, s).alias(f"{w}_{s}") for w in ("full", "h1", "h2") for s in (True, False)])
    gaps = got.select(F.col("full_True").alias("mu_same"), F.col("full_False").alias("mu_cross"), *[F.round(F.col(f"{w}_True") - F.col(f"{w}_False"), 4).alias(f"gap_{w}") for w in ("full", "h1", "h2")])
    row = rets.agg(F.count_distinct("series").alias("issuers"), F.max("day").alias("end_day")).join(gaps)
    row = row.withColumn("skipped", F.col("issuers") < least_names)
    for c in ("mu_same", "mu_cross", "gap_full", "gap_h1", "gap_h2"):
        row = row.withColumn(c, F.when(~F.col("skipped"), F.col(c)))
    g, h1, h2 = F.col("gap_full"), F.col("gap_h1"), F.col("gap_h2")
    row = row.withColumn("stable", F.coalesce((g > 0) & (h1 > 0) & (h2 > 0) & (h1 >= retain * g) & (h2 >= retain * g), F.lit(False)))
    if history is None:
        return row
    share = lambda c, now: F.round(100 * F.avg(F.when(F.col(c) <= F.col(now), 1.0).otherwise(0.0)), 1)
    placed = history.join(row.select("gap_full", "mu_cross")).agg(share("gap", "gap_full").alias("gap_pct"), share("cross_mu", "mu_cross").alias("cross_mu_pct"))
    return row.join(placed)


def communities(edges: DataFrame, most: int = 500) -> DataFrame:
    """``node, community`` by greedy modularity merges on a small weighted graph (display networks of at most ``most`` nodes)."""
    nodes = edges.select(F.col("a").alias("s")).union(edges.select("b")).distinct()
    if (n := nodes.count()) > most:
        raise ValueError(f"{n} nodes are more than the {most} that greedy modularity is offered for")

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        s = np.unique(np.r_[rows["a"].to_numpy(str), rows["b"].to_numpy(str)])
        w = np.zeros((len(s), len(s)))
        i, j = np.searchsorted(s, rows["a"].to_numpy(str)), np.searchsorted(s, rows["b"].to_numpy(str))
        np.add.at(w, (i, j), rows["w"].to_numpy(float))
        w += w.T
        e = w / w.sum()
        a, label = e.sum(1), np.arange(len(s))
        while True:
            gain = np.where(e > 0, 2 * (e - np.outer(a, a)), -np.inf)
            np.fill_diagonal(gain, -np.inf)
            x, y = np.unravel_index(np.argmax(gain), gain.shape)
            if gain[x, y] <= 1e-15:
                break
            x, y = min(x, y), max(x, y)
            e[x] += e[y]
            e[:, x] += e[:, y]
            e[y] = 0
            e[:, y] = 0
            a[x] += a[y]
            a[y] = 0
            label[label == y] = x
        kinds, size = np.unique(label, return_counts=True)
        order = {k: r for r, k in enumerate(kinds[np.lexsort((kinds, -size))])}
        return pd.DataFrame({"node": s, "community": [order[k] for k in label]})

    return edges.select("a", "b", "w", F.lit(0).alias("one")).groupBy("one").applyInPandas(run, "node string, community int")
