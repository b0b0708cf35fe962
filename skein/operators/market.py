"""Descriptive market state over bars (series, day, close, volume): returns, drawdowns, ranges, breadth, turnover, rollups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import numbers


def _w(series: str = "series") -> object:
    return Window.partitionBy(series).orderBy("day")


def simple_returns(bars: DataFrame) -> DataFrame:
    """Adds ``ret``; null for the first bar and after a close of zero."""
    prev = F.lag("close").over(_w())
    return bars.withColumn("ret", F.when(prev != 0, (F.col("close") - prev) / F.when(prev != 0, prev)))


def log_returns(bars: DataFrame) -> DataFrame:
    """Adds ``log_ret``, rounded to 6 digits; null unless both closes are above zero."""
    prev = F.lag("close").over(_w())
    ok = (prev > 0) & (F.col("close") > 0)
    return bars.withColumn("log_ret", F.when(ok, F.round(F.ln(F.col("close") / F.when(prev > 0, prev)), 6)))


def drawdowns(bars: DataFrame) -> DataFrame:
    """Adds ``dd``: the close over its running peak, less one."""
    peak = F.max("close").over(_w().rowsBetween(Window.unboundedPreceding, 0))
    return bars.withColumn("dd", F.round(F.coalesce(F.try_divide(F.col("close"), peak) - 1, F.lit(0.0)), 4))


def drawdown_summary(bars: DataFrame) -> DataFrame:
    return drawdowns(bars).groupBy("series").agg(F.min("dd").alias("mdd"), F.max_by("dd", "day").alias("curr_dd"))


def tail(bars: DataFrame, n: int) -> DataFrame:
    """The last n bars of each series."""
    r = F.row_number().over(Window.partitionBy("series").orderBy(F.desc("day")))
    return bars.withColumn("_r", r).where(F.col("_r") <= n).drop("_r")


def window_stats(bars: DataFrame, n: int = 90) -> DataFrame:
    """Change over the last n bars, and annualised volatility of their log returns (sample deviation; 0 for fewer than two)."""
    w = log_returns(tail(bars, n))
    return w.groupBy("series").agg(
        F.round(F.try_divide(F.max_by("close", "day"), F.min_by("close", "day")) - 1, 4).alias("pct_change"),
        F.round(numbers.sample_stdev(F.col("log_ret")) * F.sqrt(F.lit(252.0)), 6).alias("vol"),
        F.count("*").alias("n"),
    )


def turnover(bars: DataFrame, n: int = 5) -> DataFrame:
    """Mean of close times volume over those of the last n bars that have volume."""
    return tail(bars, n).groupBy("series").agg(F.round(F.avg(F.when(F.col("volume") > 0, F.col("close") * F.col("volume"))), 4).alias("turnover"))


def range_position(bars: DataFrame, least: int = 50) -> DataFrame:
    """Where the last close lies between the lowest (0) and highest (100), given ``least`` bars and a range."""
    got = bars.groupBy("series").agg(F.count("*").alias("n"), F.min("close").alias("lo"), F.max("close").alias("hi"), F.max_by("close", "day").alias("cur"))
    return got.where((F.col("n") >= least) & (F.col("hi") > F.col("lo"))).withColumn("pos", F.round((F.col("cur") - F.col("lo")) / (F.col("hi") - F.col("lo")) * 100, 1))


def breadth(positions: DataFrame, market: str = "market") -> DataFrame:
    """Share of series near their high (80 and above) and low (20 and below) and the upper median, by market and in all (market null)."""
    pct = lambda c: F.round(F.avg(F.when(c, 1.0).otherwise(0.0)) * 100, 1)
    return positions.rollup(market).agg(F.count("*").alias("n"), pct(F.col("pos") >= 80).alias("near_high"), pct(F.col("pos") <= 20).alias("near_low"), numbers.upper_median("pos").alias("median_pos"))


def sector_heat(positions: DataFrame, least: int = 4, top: int = 8) -> tuple[DataFrame, DataFrame]:
    """The hottest and coldest sectors by mean position, of those with ``least`` members."""
    avg = positions.groupBy("sector").agg(F.round(F.avg("pos"), 4).alias("heat"), F.count("*").alias("n")).where(F.col("n") >= least)
    return avg.orderBy(F.desc("heat"), "sector").limit(top), avg.orderBy("heat", "sector").limit(top)


def day_change(bars: DataFrame, as_of: str, most_age: int = 4) -> DataFrame:
    """The last bar's change, if that bar is at most ``most_age`` days old (and not in the future)."""
    last = bars.withColumn("prev", F.lag("close").over(_w())).groupBy("series").agg(F.max("day").alias("end"), F.max_by("close", "day").alias("last"), F.max_by("prev", "day").alias("prev"))
    age = F.datediff(F.lit(as_of).cast("date"), F.col("end").cast("date"))
    return last.select("series", F.when(age.between(0, most_age), F.round(F.try_divide(F.col("last"), F.col("prev")) - 1, 4)).alias("chg"))


def downsample(values: Column, most: int = 120) -> Column:
    """Every k-th value so that at most ``most`` stay, the last always among them."""
    step = F.greatest(F.lit(1), F.ceil(F.size(values) / most)).cast("int")
    return F.filter(values, lambda x, i: (i % step == 0) | (i == F.size(values) - 1))


def treemap(cells: DataFrame) -> DataFrame:
    """Capital and capital-weighted change of sectors, industries and all. A missing capital is the smallest; missing changes don't weigh in."""
    floor = cells.agg(F.min("cap").alias("least"))
    c = cells.join(F.broadcast(floor)).withColumn("w", F.coalesce("cap", "least"))
    weighed = F.try_divide(F.sum(F.when(F.col("chg").isNotNull(), F.col("w") * F.col("chg"))), F.sum(F.when(F.col("chg").isNotNull(), F.col("w"))))
    return c.rollup("sector", "industry").agg(F.count("*").alias("n"), F.round(F.sum("w"), 4).alias("cap"), F.round(weighed, 6).alias("chg"))


def movers(cells: DataFrame, key: str, k: int = 5) -> DataFrame:
    """The k largest rises and falls."""
    up = cells.where("chg is not null").orderBy(F.desc("chg"), key).limit(k).withColumn("side", F.lit("up"))
    return up.unionByName(cells.where("chg is not null").orderBy("chg", key).limit(k).withColumn("side", F.lit("down")))
