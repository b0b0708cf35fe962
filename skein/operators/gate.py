"""Quality and freshness: small aggregates joined into lists of failures and verdicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import numbers


def failures(spark, checks: list[tuple[str, DataFrame, Column, Column]]) -> DataFrame:
    """``code, msg``: of each check (code, one-row frame, condition that fails, message) that fails."""
    out = spark.createDataFrame([], "code string, msg string")
    for code, df, bad, msg in checks:
        out = out.unionByName(df.where(bad).select(F.lit(code).alias("code"), msg.alias("msg")))
    return out


def freshness(rows: DataFrame, day: str, as_of: str, most_age: int = 7) -> DataFrame:
    """Share of rows no older than ``most_age`` days in percent, how many are older, how many have no date, and how many there are."""
    age = numbers.age_days(F.col(day), as_of, 9999)
    return rows.agg(
        F.round(F.avg(F.when(age <= most_age, 1.0).otherwise(0.0)) * 100, 1).alias("fresh_pct"),
        F.count_if((age > most_age) & (age < 9999)).alias("stale"),
        F.count_if(age >= 9999).alias("undated"),
        F.count("*").alias("n"),
    )


def macro_gate(fresh: DataFrame, most_stale: int = 3) -> DataFrame:
    """Blocks with ``most_stale`` stale series or more, without any series, or if none has a date."""
    bad = (F.col("n") == 0) | (F.col("stale") >= most_stale) | ((F.col("undated") == F.col("n")) & (F.col("n") > 0))
    return fresh.withColumn("blocked", bad)


def duplication(claims: DataFrame, body: str) -> DataFrame:
    """Claims for each different text."""
    return claims.agg(F.count("*").alias("claims"), F.count_distinct(body).alias("texts")).withColumn("ratio", F.round(F.col("claims") / F.greatest("texts", F.lit(1)), 6))


def coverage(entities: DataFrame, key: str, **parts: DataFrame) -> DataFrame:
    """How many entities there are, and how many have a row in each part: semi-joins against distinct keys, one pass."""
    got = entities.select(key)
    for name, df in parts.items():
        got = got.join(df.select(F.col(key)).distinct().withColumn(name, F.lit(1)), key, "left")
    return got.agg(F.count("*").alias("n"), *[F.count(name).alias(f"with_{name}") for name in parts])


def verdicts(metrics: DataFrame, limits: dict[str, tuple[str, float]]) -> DataFrame:
    """``metric, value, verdict`` of long metrics: PASS or WARN by limits such as ("<=", 1.05); others have none."""
    out = F.lit(None).cast("string")
    for name, (op, limit) in limits.items():
        ok = F.col("value") <= limit if op == "<=" else F.col("value") >= limit
        out = F.when(F.col("metric") == name, F.when(ok, "PASS").otherwise("WARN")).otherwise(out)
    return metrics.withColumn("verdict", out)


def against_baseline(now: DataFrame, before: DataFrame) -> DataFrame:
    """Metrics that changed, appeared or went."""
    a, b = now.select("metric", F.col("value").alias("now")), before.select("metric", F.col("value").alias("before"))
    return a.join(b, "metric", "full_outer").where(~F.col("now").eqNullSafe(F.col("before"))).withColumn("delta", F.round(F.col("now") - F.col("before"), 6))


#: What a published set must reach (parameters): rows of graph, themes and terms; macro series with a drawdown; turnover rows of a market; percent with a value; percent of fresh prices; stale macro series.
FLOORS = {"graph": 380, "themes": 70, "terms": 100, "mdd": 8, "turnover": 5, "cap_pct": 25.0, "fresh_pct": 60.0, "stale": 3, "fresh_days": 7}
#: The issuer and the themes that must survive.
MUST_ISSUER, MUST_THEMES = "하이닉스", ("ai", "datacenter", "ev_battery", "semiconductor")


def missing(rows: DataFrame, key: str, wanted) -> DataFrame:
    """``missing``: the wanted keys that no row has, ordered, in one row."""
    return rows.agg(F.array_sort(F.array_except(F.array(*[F.lit(w) for w in sorted(wanted)]), F.collect_set(F.when(F.col(key).isin(*wanted), F.col(key))))).alias("missing"))


def artifact_gate(meta: DataFrame, dashboard: DataFrame, lists: DataFrame, graph: DataFrame, themes: DataFrame, edges: DataFrame, terms: DataFrame, macros: DataFrame, turnover: DataFrame, rising: DataFrame | None, floors: dict | None = None, issuer: str = MUST_ISSUER, must: tuple[str, ...] = MUST_THEMES, markets: tuple[str, ...] = ("kr", "us"), ranked: tuple[str, ...] = ("us", "kr", "hot", "cold")) -> DataFrame:
    """``code, msg``: which of the published tables' invariants fail; no row lets them go out.

    meta: (as_of, price_fresh_pct), one row; dashboard: (as_of), one row; lists:
    (list, ...) the dashboard's rows; graph: (name, sector, mktcap, heads);
    themes: (id, heads); heads: array of (d, t); edges: (a, b, summary); terms;
    macros: (name, end, mdd); turnover: (market, ...); rising: None where it
    was never made. Each check is a small aggregate; the union is one job.
    """
    f = FLOORS | (floors or {})
    spark, n = meta.sparkSession, F.count("*").alias("n")
    count = lambda df, *more: df.agg(n, *more)
    say = lambda *parts: F.concat(*[p if isinstance(p, Column) else F.lit(str(p)) for p in parts])
    checks = [(f"floor-{name}", count(df), F.col("n") < f[name], say(F.col("n"), " < ", f[name])) for name, df in (("graph", graph), ("themes", themes), ("terms", terms))]
    checks.append(("empty-graph", count(graph), F.col("n") == 0, F.lit("no issuers at this as_of")))
    named = spark.createDataFrame([(x,) for x in ranked], "list string").join(lists.groupBy("list").agg(n), "list", "left")
    checks.append(("empty-list", named, F.coalesce("n", F.lit(0)) == 0, F.col("list")))
    checks.append(("retention-issuer", count(graph.where(F.contains("name", F.lit(issuer)))), F.col("n") == 0, F.lit(issuer)))
    checks.append(("retention-themes", missing(themes, "id", must), F.size("missing") > 0, F.array_join("missing", ",")))
    label = meta.select(F.col("as_of").alias("m")).join(dashboard.select(F.col("as_of").alias("d")))
    checks.append(("label", label, ~F.col("m").eqNullSafe(F.col("d")), say(F.coalesce("m", F.lit("-")), " <> ", F.coalesce("d", F.lit("-")))))
    heads = themes.select("heads").unionByName(graph.select("heads"))
    day = lambda c: F.substring(c, 1, 10)
    late = heads.select(F.explode("heads").alias("h")).join(meta.select(day("as_of").alias("at"))).where((day("h.d") != "") & (day("h.d") > F.col("at")))
    checks.append(("label-future", late.agg(n, F.max(day("h.d")).alias("last")), F.col("n") > 0, say(F.col("n"), " after, last ", F.col("last"))))
    # an age needs the label's day, which is a row and not a parameter
    aged = macros.join(meta.select(F.try_to_date(day("as_of"), "yyyy-MM-dd").alias("at"))).withColumn("age", F.datediff("at", F.try_to_date(day("end"), "yyyy-MM-dd")))
    fresh = macro_gate(aged.agg(n, F.count_if(F.col("age") > f["fresh_days"]).alias("stale"), F.count_if(F.col("age").isNull()).alias("undated")), f["stale"])
    checks.append(("fresh-macro", fresh, "blocked", say(F.col("stale"), " stale, ", F.col("undated"), " undated of ", F.col("n"))))
    pct = F.col("price_fresh_pct")
    checks.append(("fresh-price", meta, pct.isNull() | (pct < f["fresh_pct"]), say(F.coalesce(pct.cast("string"), F.lit("none")), " < ", f["fresh_pct"])))
    checks.append(("mdd", count(macros.where("mdd is not null")), F.col("n") < f["mdd"], say(F.col("n"), " < ", f["mdd"])))
    traded = spark.createDataFrame([(m,) for m in markets], "market string").join(turnover.groupBy("market").agg(n), "market", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    checks.append(("turnover", traded, F.col("n") < f["turnover"], say(F.col("market"), " ", F.col("n"))))
    if rising is None:
        checks.append(("rising", count(meta), F.lit(True), F.lit("not made")))
    checks.append(("edge-summary", count(edges.where(F.coalesce("summary", F.lit("")) == "")), F.col("n") > 0, say(F.col("n"), " without")))
    twice = heads.where(F.size(F.array_distinct(F.transform("heads", lambda h: h["t"]))) < F.size("heads"))
    checks.append(("repeated-heads", count(twice), F.col("n") > 0, say(F.col("n"), " lists")))
    checks.append(("raw-sector", count(graph.where(F.col("sector").rlike("^KSIC \\d"))), F.col("n") > 0, say(F.col("n"), " issuers")))
    cap = graph.agg(F.round(100 * F.count_if(F.col("mktcap") > 0) / F.greatest(F.count("*"), F.lit(1)), 1).alias("pct"))
    checks.append(("cap-coverage", cap, F.col("pct") < f["cap_pct"], say(F.col("pct"), " < ", f["cap_pct"])))
    return failures(spark, [(c, df, F.col(bad) if isinstance(bad, str) else bad, msg) for c, df, bad, msg in checks])
