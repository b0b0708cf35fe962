"""Market-state, co-movement and rollup plans over events, line items and parts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import lookup
from ..operators import assemble, comove, market, upsert
from . import adapter as A
from .registry import plan

LAG = "lag(close) OVER (PARTITION BY series ORDER BY day)"


@plan(f"WITH {A.BARS} SELECT series, day, round((close - p) / p, 9) AS ret FROM (SELECT *, {LAG} AS p FROM bars)")
def simple_returns(spark, d):
    return market.simple_returns(A.bars(spark, d)).select("series", "day", F.round("ret", 9).alias("ret"))


@plan(f"WITH {A.BARS} SELECT series, day, CASE WHEN p > 0 AND close > 0 THEN round(ln(close / p), 6) END AS log_ret FROM (SELECT *, {LAG} AS p FROM bars)")
def log_returns(spark, d):
    return market.log_returns(A.bars(spark, d)).select("series", "day", "log_ret")


_DD = f"{A.BARS}, dd AS (SELECT *, round(close / max(close) OVER (PARTITION BY series ORDER BY day) - 1, 4) AS dd FROM bars)"


@plan(f"WITH {_DD} SELECT series, min(dd) AS mdd, arg_max(dd, day) AS curr_dd FROM dd GROUP BY 1")
def drawdown_mdd(spark, d):
    return market.drawdown_summary(A.bars(spark, d))


@plan(f"WITH {_DD}, i AS (SELECT series, dd, row_number() OVER (PARTITION BY series ORDER BY day) - 1 AS i, count(*) OVER (PARTITION BY series) AS n FROM dd) SELECT series, count(*) AS kept, round(sum(dd), 4) AS total FROM i WHERE i % ceil(n / 7.0) = 0 OR i = n - 1 GROUP BY 1")
def drawdown_downsample(spark, d):
    series = market.drawdowns(A.bars(spark, d)).groupBy("series").agg(F.transform(F.array_sort(F.collect_list(F.struct("day", "dd"))), lambda x: x["dd"]).alias("v"))
    kept = series.withColumn("v", market.downsample(F.col("v"), 7))
    return kept.select("series", F.size("v").cast("long").alias("kept"), F.round(F.aggregate("v", F.lit(0.0), lambda a, b: a + b), 4).alias("total"))


_TAIL = "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY series ORDER BY day DESC) AS k FROM {0}) WHERE k <= {1}"


@plan(f"""WITH {A.BARS}, t AS ({_TAIL.format("bars", 20)}), r AS (SELECT *, CASE WHEN p > 0 THEN round(ln(close / p), 6) END AS lr FROM (SELECT *, {LAG} AS p FROM t))
SELECT series, round(arg_max(close, day) / arg_min(close, day) - 1, 4) AS pct_change, round(coalesce(stddev_samp(lr), 0) * sqrt(252), 6) AS vol, count(*) AS n FROM r GROUP BY 1""")
def vol_window(spark, d):
    return market.window_stats(A.bars(spark, d), 20)


@plan(f"WITH {A.BARS}, t AS ({_TAIL.format('bars', 5)}) SELECT series, round(avg(close * volume) FILTER (volume > 0), 4) AS turnover FROM t GROUP BY 1")
def turnover_5d(spark, d):
    return market.turnover(A.bars(spark, d))


_POS = f"""{A.MONTHLY}, ps AS (SELECT series, sector, round((arg_max(close, day) - min(close)) / (max(close) - min(close)) * 100, 1) AS pos FROM mb GROUP BY 1, 2 HAVING count(*) >= 50 AND max(close) > min(close))"""


def _positions(spark, d):
    m = A.monthly(spark, d)
    return market.range_position(m).join(m.select("series", "sector").distinct(), "series").select("series", "sector", "pos")


@plan(f"WITH {_POS} SELECT * FROM ps")
def range_position(spark, d):
    return _positions(spark, d)


_BREADTH = "count(*) AS n, round(avg(CASE WHEN pos >= 80 THEN 1.0 ELSE 0.0 END) * 100, 1) AS near_high, round(avg(CASE WHEN pos <= 20 THEN 1.0 ELSE 0.0 END) * 100, 1) AS near_low, list_sort(list(pos))[count(*) // 2 + 1] AS median_pos"


@plan(f"WITH {_POS} SELECT sector AS market, {_BREADTH} FROM ps GROUP BY ROLLUP (sector)")
def breadth(spark, d):
    return market.breadth(_positions(spark, d).withColumnRenamed("sector", "market"))


_HEAT = "SELECT sector, round(avg(pos), 4) AS heat, count(*) AS n FROM ps GROUP BY 1 HAVING count(*) >= 4"


@plan(f"WITH {_POS}, h AS ({_HEAT}) SELECT * FROM (SELECT *, 'hot' AS side FROM h ORDER BY heat DESC, sector LIMIT 2) UNION ALL SELECT * FROM (SELECT *, 'cold' AS side FROM h ORDER BY heat, sector LIMIT 2)")
def sector_heat(spark, d):
    hot, cold = market.sector_heat(_positions(spark, d), top=2)
    return hot.withColumn("side", F.lit("hot")).unionByName(cold.withColumn("side", F.lit("cold")))


@plan(f"WITH {A.MONTHLY}, t AS (SELECT series, sector, round(sum(close * volume), 2) AS turnover FROM mb GROUP BY 1, 2) SELECT series, sector FROM (SELECT *, row_number() OVER (PARTITION BY sector ORDER BY turnover DESC, series) AS k FROM t) WHERE k <= 3")
def turnover_topk(spark, d):
    from ..operators.themes import top_by

    t = A.monthly(spark, d).groupBy("series", "sector").agg(F.round(F.sum(F.col("close") * F.col("volume")), 2).alias("turnover"))
    return top_by(t, ["sector"], [F.desc("turnover"), F.asc("series")], 3).select("series", "sector")


@plan(f"WITH {A.BARS}, l AS (SELECT series, max(day) AS e, arg_max(close, day) AS last, arg_max(p, day) AS prev FROM (SELECT *, {LAG} AS p FROM bars) GROUP BY 1) SELECT series, CASE WHEN DATE '2024-02-01' - e BETWEEN 0 AND 4 THEN round(last / prev - 1, 4) END AS chg FROM l")
def day_change(spark, d):
    return market.day_change(A.bars(spark, d), "2024-02-01")


_RET = f"{A.MONTHLY}, rt AS (SELECT series, sector, day, (close - p) / p AS ret FROM (SELECT *, {LAG} AS p FROM mb) WHERE p <> 0)"


def _res_sql(src: str, group: str = "") -> str:
    g = f"{group}, " if group else ""
    on = f"x.{group} = y.{group} AND " if group else ""
    return f"""mk AS (SELECT {g}day, avg(ret) AS m FROM {src} GROUP BY {g}day), bo AS (SELECT x.*, y.m FROM {src} x JOIN mk y ON {on}x.day = y.day),
be AS (SELECT {g}series, coalesce(CASE WHEN var_pop(m) > 0 THEN covar_pop(ret, m) / var_pop(m) END, 0) AS beta FROM bo GROUP BY {g}series),
rs AS (SELECT x.*, ret - beta * m AS resid FROM bo x JOIN be y ON {on}x.series = y.series),
pc AS (SELECT {f"x.{group}, " if group else ""}x.series AS a, y.series AS b, x.sector = y.sector AS same, corr(x.resid, y.resid) AS r, count(*) AS n FROM rs x JOIN rs y ON {on}x.day = y.day AND x.series < y.series GROUP BY ALL)"""


def _rets(spark, d):
    return market.simple_returns(A.monthly(spark, d)).where("ret is not null")


def _sectors(spark, d):
    return A.monthly(spark, d).select("series", "sector").distinct()


def _pairs(spark, d):
    return comove.by_sector(comove.pair_correlations(comove.residuals(_rets(spark, d)), least=50), _sectors(spark, d))


@plan(f"WITH {_RET} SELECT day, round(avg(ret), 6) AS m FROM rt GROUP BY 1")
def market_index(spark, d):
    return _rets(spark, d).groupBy("day").agg(F.round(F.avg("ret"), 6).alias("m"))


@plan(f"WITH {_RET}, {_res_sql('rt')} SELECT series, round(beta, 6) AS beta FROM be")
def residual_beta(spark, d):
    return comove.residuals(_rets(spark, d)).groupBy("series").agg(F.round(F.first("beta"), 6).alias("beta"))


@plan(f"WITH {_RET}, {_res_sql('rt')} SELECT a, b, same, round(r, 6) AS r, n FROM pc WHERE n >= 50 AND isfinite(r)")
def resid_corr_pairs(spark, d):
    return _pairs(spark, d).select("a", "b", "same", F.round("r", 6).alias("r"), "n")


@plan(f"WITH {A.MONTHLY}, e AS (SELECT series, max(day) AS e, count(*) AS n FROM mb GROUP BY 1), dm AS (SELECT e FROM e GROUP BY 1 ORDER BY count(*) DESC, e DESC LIMIT 1) SELECT series, count(*) AS bars FROM (SELECT mb.*, row_number() OVER (PARTITION BY series ORDER BY day DESC) AS k FROM mb JOIN e USING (series) WHERE n >= 60 AND e.e = (SELECT e FROM dm)) WHERE k <= 60 GROUP BY 1")
def cohort(spark, d):
    return comove.cohort(A.monthly(spark, d), 60).groupBy("series").agg(F.count("*").alias("bars"))


@plan(f"WITH {_RET}, {_res_sql('rt')} SELECT same, round(avg(r), 6) AS mu, round(stddev_pop(r), 6) AS sigma, count(*) AS n FROM pc WHERE n >= 50 AND isfinite(r) GROUP BY 1")
def regime_gap(spark, d):
    return comove.distribution(_pairs(spark, d))


_HALF = f"{_RET}, hv AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY series ORDER BY day) - 1 < count(*) OVER (PARTITION BY series) // 2 THEN 0 ELSE 1 END AS half FROM rt)"


@plan(f"WITH {_HALF}, {_res_sql('hv', 'half')} SELECT half, round(avg(r) FILTER (same) - avg(r) FILTER (NOT same), 6) AS gap FROM pc WHERE n >= 20 AND isfinite(r) GROUP BY 1")
def split_half(spark, d):
    r = comove.residuals(comove.halves(_rets(spark, d)), ("half",))
    return comove.gap(comove.by_sector(comove.pair_correlations(r, least=20, group=("half",)), _sectors(spark, d)), ("half",))


_ROLL = f"{_RET}, ix AS (SELECT *, row_number() OVER (PARTITION BY series ORDER BY day) - 1 AS i, count(*) OVER (PARTITION BY series) AS n0 FROM rt), wn AS (SELECT series, sector, day, ret, w AS win FROM (SELECT *, unnest(range(40, n0, 12)) AS w FROM ix) WHERE w > i AND w - 40 <= i)"


@plan(f"WITH {_ROLL}, {_res_sql('wn', 'win')} SELECT CAST(win AS BIGINT) AS win, round(avg(r) FILTER (same) - avg(r) FILTER (NOT same), 6) AS gap FROM pc WHERE isfinite(r) AND n >= 20 GROUP BY 1")
def rolling_windows(spark, d):
    r = comove.residuals(comove.rolling(_rets(spark, d), 40, 12), ("win",))
    got = comove.gap(comove.by_sector(comove.pair_correlations(r, least=20, group=("win",)), _sectors(spark, d)), ("win",))
    return got.select(F.col("win").cast("long").alias("win"), "gap")


@plan(f"WITH {_POS} SELECT round(avg(CASE WHEN pos <= 50 THEN 1.0 ELSE 0.0 END) * 100, 1) AS pct FROM ps")
def percentile_rank(spark, d):
    return comove.percentile_rank(_positions(spark, d), "pos", 50.0)


@plan(f"""WITH {_RET}, {_res_sql("rt")}, q AS (SELECT * FROM pc WHERE n >= 50 AND isfinite(r)),
bs AS (SELECT avg(r) FILTER (same) AS ms, stddev_pop(r) FILTER (same) AS ss, avg(r) FILTER (NOT same) AS mc, stddev_pop(r) FILTER (NOT same) AS sc FROM q),
z AS (SELECT a, b, same, round(CASE WHEN same THEN (r - ms) / ss ELSE (r - mc) / sc END, 4) AS z FROM q, bs)
SELECT a, b, z, NOT same AND z >= 3 AS verified, CASE WHEN z >= 3 THEN 'strong' WHEN z >= 1.5 THEN 'moderate' WHEN same THEN 'same-sector' ELSE 'none' END AS grade FROM z""")
def zscore_grade(spark, d):
    pairs = _pairs(spark, d)
    return comove.verify(pairs.select("a", "b"), pairs).select("a", "b", "z", "verified", "grade")


_LOG = "(SELECT *, row_number() OVER (PARTITION BY series ORDER BY day DESC) AS k FROM (SELECT *, CASE WHEN p > 0 AND close > 0 THEN round(ln(close / p), 6) END AS lr FROM (SELECT *, " + LAG + " AS p FROM {0})) WHERE lr IS NOT NULL)"


@plan(f"""WITH {A.MONTHLY}, mac AS (SELECT 'R' || sector AS series, day, round(sum(close), 2) AS close FROM mb GROUP BY 1, 2), x AS {_LOG.format("mb")}, y AS {_LOG.format("mac")},
c AS (SELECT x.series, y.series AS macro, corr(x.lr, y.lr) AS r, count(*) AS n_obs, greatest(min(x.day), min(y.day)) AS start, least(max(x.day), max(y.day)) AS "end" FROM x JOIN y USING (k) GROUP BY 1, 2)
SELECT series, macro, n_obs, start, "end", round(r, 3) AS corr FROM c WHERE n_obs >= 60 AND abs(r) >= 0.5""")
def macro_comove(spark, d):
    m = A.monthly(spark, d)
    macro = m.groupBy(F.concat(F.lit("R"), "sector").alias("series"), "day").agg(F.round(F.sum("close"), 2).alias("close"))
    return comove.macro_links(market.log_returns(m), market.log_returns(macro))


_C2 = "sum(n * (n - 1) / 2)"


@plan(f"""WITH l AS (SELECT label AS x, vec_id % 7 % 3 AS y FROM embeddings), p AS (SELECT {_C2} AS s FROM (SELECT count(*) AS n FROM l GROUP BY x, y)), a AS (SELECT {_C2} AS s FROM (SELECT count(*) AS n FROM l GROUP BY x)), b AS (SELECT {_C2} AS s FROM (SELECT count(*) AS n FROM l GROUP BY y)), t AS (SELECT count(*) * (count(*) - 1) / 2 AS s FROM l)
SELECT round((p.s - a.s * b.s / t.s) / ((a.s + b.s) / 2 - a.s * b.s / t.s), 4) AS ari FROM p, a, b, t""")
def label_ari(spark, d):
    return comove.rand_index(A.table(spark, d, "embeddings").select(F.col("label").alias("x"), (F.col("vec_id") % 7 % 3).alias("y")))


@plan("""WITH c AS (SELECT label AS cluster, 's' || (vec_id % 5 % 3) AS sector, count(*) AS c FROM embeddings GROUP BY ALL), t AS (SELECT *, sum(c) OVER (PARTITION BY cluster) AS n, row_number() OVER (PARTITION BY cluster ORDER BY c DESC, sector) AS k FROM c)
SELECT cluster, CAST(n AS BIGINT) AS n, sector AS top_sector, round(c / n, 6) AS purity, c / n < 0.6 AS cross_sector FROM t WHERE k = 1""")
def cluster_purity(spark, d):
    return comove.purity(A.table(spark, d, "embeddings").select(F.col("label").alias("cluster"), F.concat(F.lit("s"), F.col("vec_id") % 5 % 3).alias("sector")))


@plan()
def flow_clusters(spark, d):
    """Clusters of nations by residual co-movement; linkage is tested on planted blocks."""
    return comove.flow_clusters(_pairs(spark, d)).select("series", "cluster")


@plan()
def flow_report(spark, d):
    """Clusters of nations with loadings, purity and the agreement of the halves; its parts are tested apart."""
    members, clusters = comove.flow_report(_rets(spark, d), _sectors(spark, d), least_names=20, least_full=50, least_half=20)
    return members.join(clusters.select("cluster", "cut", "silhouette", "ari", "stable", "purity"), "cluster")


_COH = f"""{A.MONTHLY}, e AS (SELECT series, max(day) AS e, count(*) AS n FROM mb GROUP BY 1), dm AS (SELECT e FROM e GROUP BY 1 ORDER BY count(*) DESC, e DESC LIMIT 1),
ch AS (SELECT * FROM (SELECT mb.*, row_number() OVER (PARTITION BY series ORDER BY day DESC) AS k FROM mb JOIN e USING (series) WHERE n >= 60 AND e.e = (SELECT e FROM dm)) WHERE k <= 60),
rt AS (SELECT series, sector, day, (close - p) / p AS ret FROM (SELECT *, {LAG} AS p FROM ch) WHERE p <> 0),
ix AS (SELECT *, row_number() OVER (PARTITION BY series ORDER BY day) - 1 AS i, count(*) OVER (PARTITION BY series) AS n0 FROM rt),
wn AS (SELECT series, sector, day, ret, 'full' AS win FROM ix UNION ALL SELECT series, sector, day, ret, CASE WHEN i < n0 // 2 THEN 'h1' ELSE 'h2' END FROM ix)"""
_MU = lambda w, s: f"round(avg(r) FILTER (win = '{w}' AND {s}), 4)"
_GAP = lambda w: f"round({_MU(w, 'same')} - {_MU(w, 'NOT same')}, 4)"


@plan(f"""WITH {_COH}, {_res_sql("wn", "win")}, q AS (SELECT * FROM pc WHERE isfinite(r) AND n >= CASE WHEN win = 'full' THEN 50 ELSE 20 END),
i AS (SELECT count(DISTINCT series) AS issuers, max(day) AS end_day FROM rt),
g AS (SELECT {_MU("full", "same")} AS mu_same, {_MU("full", "NOT same")} AS mu_cross, {_GAP("full")} AS gap_full, {_GAP("h1")} AS gap_h1, {_GAP("h2")} AS gap_h2 FROM q WHERE (SELECT issuers FROM i) >= 20)
SELECT issuers, end_day, g.*, issuers < 20 AS skipped,
  coalesce(gap_full > 0 AND gap_h1 > 0 AND gap_h2 > 0 AND gap_h1 >= 0.35 * gap_full AND gap_h2 >= 0.35 * gap_full, false) AS stable FROM i, g""")
def regime_yardstick(spark, d):
    """How much closer nations of one region move, whole and by halves."""
    return comove.yardstick(A.monthly(spark, d).select("series", "day", "close"), _sectors(spark, d), 60, 20, 50, 20)


@plan(f"WITH {_RET}, {_res_sql('rt')} SELECT a, b, round(r, 6) AS corr FROM pc WHERE n >= 50 AND isfinite(r) ORDER BY abs(round(r, 6)) DESC, a, b LIMIT 12")
def strongest_pairs(spark, d):
    return assemble.strongest(_pairs(spark, d).select("a", "b", F.round("r", 6).alias("corr")))


@plan(f"WITH {A.MONTHLY} SELECT series, count(*) AS bars FROM mb GROUP BY 1 HAVING count(*) >= 75")
def backfill_series(spark, d):
    """Only series that are long enough are written."""
    return upsert.long_enough(A.monthly(spark, d), 75).groupBy("series").agg(F.count("*").alias("bars"))


_CELLS = "cells AS (SELECT p_partkey, split_part(p_brand, '#', 1) AS sector, p_brand AS industry, CASE WHEN p_size % 9 > 0 THEN p_retailprice END AS cap, CASE WHEN p_partkey % 11 > 0 THEN round((p_partkey % 41 - 20) / 100.0, 4) END AS chg FROM part)"


def _cells(spark, d):
    p = A.table(spark, d, "part")
    return p.select("p_partkey", F.split_part("p_brand", F.lit("#"), F.lit(1)).alias("sector"), F.col("p_brand").alias("industry"), F.when(F.col("p_size") % 9 > 0, F.col("p_retailprice")).alias("cap"), F.when(F.col("p_partkey") % 11 > 0, F.round((F.col("p_partkey") % 41 - 20) / 100, 4)).alias("chg"))


@plan(f"WITH {_CELLS}, w AS (SELECT *, coalesce(cap, (SELECT min(cap) FROM cells)) AS w FROM cells) SELECT sector, industry, count(*) AS n, round(sum(w), 4) AS cap, round(sum(w * chg) / nullif(sum(w) FILTER (chg IS NOT NULL), 0), 6) AS chg FROM w GROUP BY ROLLUP (sector, industry)")
def treemap_rollup(spark, d):
    return market.treemap(_cells(spark, d))


@plan(f"WITH {_CELLS} SELECT * FROM (SELECT p_partkey, CAST(chg AS DOUBLE) AS chg, 'up' AS side FROM cells WHERE chg IS NOT NULL ORDER BY chg DESC, p_partkey LIMIT 5) UNION ALL SELECT * FROM (SELECT p_partkey, CAST(chg AS DOUBLE), 'down' FROM cells WHERE chg IS NOT NULL ORDER BY chg, p_partkey LIMIT 5)")
def movers(spark, d):
    return market.movers(_cells(spark, d).select("p_partkey", F.col("chg").cast("double").alias("chg")), "p_partkey")


@plan("""SELECT division, count(*) AS n FROM (SELECT CASE WHEN mg = 0 THEN 'Other' WHEN mg < 10 THEN 'Agriculture' WHEN mg < 15 THEN 'Mining' WHEN mg < 18 THEN 'Construction' WHEN mg < 20 THEN 'Other' WHEN mg < 40 THEN 'Manufacturing'
  WHEN mg < 50 THEN 'Transport & Utilities' WHEN mg < 52 THEN 'Wholesale' WHEN mg < 60 THEN 'Retail' WHEN mg < 68 THEN 'Finance' WHEN mg < 70 THEN 'Other' WHEN mg < 90 THEN 'Services' ELSE 'Public' END AS division
  FROM (SELECT p_partkey * 37 % 10000 // 100 AS mg FROM part)) GROUP BY 1""")
def sic_division(spark, d):
    return A.table(spark, d, "part").select(lookup.division(F.col("p_partkey") * 37 % 10000).alias("division")).groupBy("division").agg(F.count("*").alias("n"))


_CODES = ("3571", "3674", "6021", "2834", "1311", "4911", "7372", "6798", "5812", "0100", "9999", "1799", "3999", "62", "x")


@plan("""SELECT p_partkey, ['기술','기술','금융','헬스케어','에너지','유틸리티','기술','부동산','경기소비재','필수소비재','기타','산업재','경기소비재','기타','기타'][1 + p_partkey % 15] AS sector_ko,
  ['Consumer Electronics','Semiconductors','Banks','Drug Manufacturers - General','Oil & Gas','Utilities-Regulated Electric','Software','REIT','Restaurants','Farm Products','Other','Industrials','Consumer Cyclical','Other','Other'][1 + p_partkey % 15] AS industry,
  ['Technology','Technology','Financial','Healthcare','Energy','Utilities','Technology','Real Estate','Consumer Cyclical','Consumer Defensive','Other','Industrials','Consumer Cyclical','Other','Other'][1 + p_partkey % 15] AS sector FROM part""")
def sic_sectors(spark, d):
    """Listed codes, codes of which only the major group is known, and others."""
    code = F.get(F.array(*[F.lit(c) for c in _CODES]), (F.col("p_partkey") % 15).cast("int"))
    return A.table(spark, d, "part").select("p_partkey", lookup.sic_sector(code).alias("s")).select("p_partkey", "s.*")


@plan("""SELECT p_partkey, ['식료품','전자부품·반도체','금융','교육','기타(99)','기타()'][1 + p_partkey % 6] AS industry, ['필수소비재','기술','금융','기타','기타','기타'][1 + p_partkey % 6] AS sector_ko,
  ['Consumer Defensive','Technology','Financial','Other','Other','Other'][1 + p_partkey % 6] AS sector FROM part""")
def ksic_sectors(spark, d):
    code = F.get(F.array(*[F.lit(c) for c in ("10", "2612", "64", "85", "99", "")]), (F.col("p_partkey") % 6).cast("int"))
    return A.table(spark, d, "part").select("p_partkey", lookup.ksic_sector(lookup.ksic_name(code)).alias("s")).select("p_partkey", "s.*")


@plan("""WITH c AS (SELECT p_partkey, lpad(CAST(p_partkey * 37 % 10000 AS VARCHAR), 4, '0') AS code FROM part)
SELECT p_partkey, CASE WHEN n1.n_name IS NOT NULL THEN n1.n_name WHEN n2.r_name IS NOT NULL THEN n2.r_name ELSE 'Other' END AS sector FROM c LEFT JOIN nation n1 ON code = lpad(CAST(n_nationkey * 111 AS VARCHAR), 4, '0') LEFT JOIN region n2 ON substr(code, 1, 2) = lpad(CAST(r_regionkey * 7 AS VARCHAR), 2, '0')""")
def taxonomy_fallback(spark, d):
    parts = A.table(spark, d, "part").select("p_partkey", F.lpad((F.col("p_partkey") * 37 % 10000).cast("string"), 4, "0").alias("code"))
    exact = A.table(spark, d, "nation").select(F.lpad((F.col("n_nationkey") * 111).cast("string"), 4, "0").alias("code"), F.col("n_name").alias("label"))
    prefix = A.table(spark, d, "region").select(F.lpad((F.col("r_regionkey") * 7).cast("string"), 2, "0").alias("code"), F.col("r_name").alias("label"))
    return lookup.classify(parts, "code", exact, prefix).select("p_partkey", "sector")
