"""Numeric expressions that stay null-safe under ANSI division."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def age_days(day: Column, as_of: str, missing: int = 9999) -> Column:
    """Days from an ISO text's first ten characters to ``as_of``; malformed or null: ``missing``."""
    return F.coalesce(F.datediff(F.lit(as_of[:10]).cast("date"), F.try_to_date(F.substring(day.cast("string"), 1, 10), "yyyy-MM-dd")), F.lit(missing))


def decay(day: Column, as_of: str, half_life: float, undated: float) -> Column:
    """``0.5 ** (age / half_life)``; 1 for today and later, ``undated`` where there is no date."""
    d = F.try_to_date(F.substring(day.cast("string"), 1, 10), "yyyy-MM-dd")
    age = F.datediff(F.lit(as_of[:10]).cast("date"), d)
    return F.when(d.isNull(), undated).when(age <= 0, 1.0).otherwise(F.pow(F.lit(0.5), age / half_life))


def pearson(x: Column, y: Column, least: int = 2) -> Column:
    """Aggregate correlation of pairs; null for fewer than ``least`` pairs or a flat side."""
    both = x.isNotNull() & y.isNotNull()
    a, b = F.when(both, x), F.when(both, y)
    n = F.count(a)
    sxy = F.sum(a * b) - F.try_divide(F.sum(a) * F.sum(b), n)
    sxx, syy = F.sum(a * a) - F.try_divide(F.sum(a) * F.sum(a), n), F.sum(b * b) - F.try_divide(F.sum(b) * F.sum(b), n)
    return F.when((n >= least) & (sxx > 1e-18) & (syy > 1e-18), sxy / (F.sqrt(F.when(sxx > 0, sxx)) * F.sqrt(F.when(syy > 0, syy))))


def sample_stdev(x: Column) -> Column:
    return F.coalesce(F.stddev_samp(x), F.lit(0.0))


def jsd(p: Column, q: Column) -> Column:
    """Jensen-Shannon divergence, base 2, of two arrays of shares."""
    half = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: F.when(x > 0, x * F.log2(F.when(x + y > 0, 2 * x / (x + y)))).otherwise(0.0)), F.lit(0.0), lambda s, v: s + v)
    return (half(p, q) + half(q, p)) / 2


def chapman(n1: Column, n2: Column, m: Column) -> Column:
    """Capture-recapture estimate of a total from two lists that share m."""
    return (n1 + 1) * (n2 + 1) / (m + 1) - 1


def upper_median(column: str) -> Column:
    """Aggregate: the element at place n // 2 of the sorted values (the upper of two). Counts of different values are combined, no list is made."""
    return F.expr(f"percentile_disc(0.5) WITHIN GROUP (ORDER BY {column} DESC)")


def grade(z: Column, same_sector: Column) -> Column:
    return F.when(z >= 3, "strong").when(z >= 1.5, "moderate").when(same_sector, "same-sector").otherwise("none")
