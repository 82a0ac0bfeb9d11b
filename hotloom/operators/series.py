"""Dense monthly series of units, and what is read from them: activity, recent change, trend."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hotloom.operators.ranking import average_ranks, with_rank
from hotloom.session import stage

#: Months and levels that the statistics need.
MIN_MONTHS_PERSISTENCE, MIN_MONTHS_TREND, MIN_REPORTS_TREND = 24, 12, 10
RECENT_MONTHS, MIN_HISTORY = 3, 12
ALPHA_ACTIVE, ALPHA_PERSISTENT, ALPHA_TREND = 0.05, 0.01, 0.05
INSUFFICIENT = "Insufficient data"


def month_spine(df: DataFrame, month: str) -> DataFrame:
    """(month): every YYYY-MM from the least to the greatest of a column; nulls don't count, none give no rows."""
    ends = df.agg(F.to_date(F.concat(F.min(month), F.lit("-01"))).alias("a"), F.to_date(F.concat(F.max(month), F.lit("-01"))).alias("b")).where("a is not null")
    return ends.select(F.explode(F.sequence("a", "b", F.expr("interval 1 month"))).alias("d")).select(F.substring(F.col("d").cast("string"), 1, 7).alias("month"))


def dense_unit_month(rows: DataFrame, unit: str, months: DataFrame, units: DataFrame, target: Column) -> DataFrame:
    """(unit, month, target_reports, all_reports, share) for every unit and month, silent ones included.

    ``units`` and ``months`` have the columns unit and month and are small dimensions: the months are spread out within
    each unit row, no row of ``rows`` is multiplied. share is null where there are no reports. Rows with another unit or
    month don't count.
    """
    counts = rows.groupBy(F.col(unit).alias("__unit"), F.col("month").alias("__month")).agg(F.count_if(target).alias("t"), F.count(F.lit(1)).alias("n"))
    every = months.agg(F.array_sort(F.collect_set("month")).alias("m"))
    months_of = every.first()["m"] or []  # bounded by the calendar
    spine = units.select(F.col("unit"), F.explode(F.array(*[F.lit(m) for m in months_of]).cast("array<string>")).alias("month"))
    dense = spine.join(counts, (spine["unit"] == counts["__unit"]) & (spine["month"] == counts["__month"]), "left")
    return dense.select("unit", "month", F.coalesce("t", F.lit(0)).alias("target_reports"), F.coalesce("n", F.lit(0)).alias("all_reports"), (F.col("t") / F.nullif("n", F.lit(0))).alias("share"))


def _poisson_start(rate: Column) -> Column:
    return F.struct((-rate).alias("log"), (F.lit(1.0) - F.exp(-rate)).alias("tail"))


def _poisson_step(acc: Column, rate: Column, t: Column) -> tuple[Column, Column]:
    """The logarithm of P(X = t), from that of t - 1, and P(X > t); a mean of 0 has no terms but the first."""
    log = acc["log"] + F.ln(rate) - F.ln(t)
    return log, acc["tail"] - F.when(rate == 0, 0.0).otherwise(F.exp(log))


def active_threshold(rate: Column, alpha: float = ALPHA_ACTIVE, most: int = 1000) -> Column:
    """The smallest whole number T of at least 1 that a Poisson count of mean ``rate`` reaches with probability alpha at
    most; ``most`` if none below does. The tail is summed from logarithms, so large means don't underflow."""
    start = _poisson_start(rate).withField("found", F.lit(0))

    def step(acc: Column, t: Column) -> Column:
        log, tail = _poisson_step(acc, rate, t)
        done = (acc["found"] == 0) & (acc["tail"] <= alpha)
        return F.struct(log.alias("log"), tail.alias("tail"), F.when(done, t).otherwise(acc["found"]).alias("found"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(most)), start, step, lambda acc: F.when(acc["found"] == 0, F.lit(most)).otherwise(acc["found"]))


def tail_from(rate: Column, threshold: Column) -> Column:
    """P(a Poisson count of mean ``rate`` is at least ``threshold``)."""

    def step(acc: Column, t: Column) -> Column:
        log, tail = _poisson_step(acc, rate, t)
        return F.struct(log.alias("log"), tail.alias("tail"))

    return F.when(threshold <= 1, 1 - F.exp(-rate)).otherwise(F.aggregate(F.sequence(F.lit(1), F.greatest(threshold - 1, F.lit(1))), _poisson_start(rate), step, lambda acc: acc["tail"]))


def persistence_threshold(n: Column, p: Column, alpha: float = ALPHA_PERSISTENT) -> Column:
    """The smallest k with P(a binomial count of n and p is at least k) of alpha at most; n + 1 if none is."""
    start = F.struct(F.pow(1 - p, n).alias("term"), F.lit(1.0).alias("tail"), F.lit(-1).alias("found"))

    def step(acc: Column, k: Column) -> Column:
        """tail is P(X >= k), term P(X = k)."""
        return F.struct(
            (acc["term"] * (n - k) / (k + 1) * p / F.nullif(1 - p, F.lit(0.0))).alias("term"), (acc["tail"] - acc["term"]).alias("tail"),
            F.when((acc["found"] < 0) & (acc["tail"] <= alpha), k).otherwise(acc["found"]).alias("found"),
        )

    return F.aggregate(F.sequence(F.lit(0), n), start, step, lambda acc: F.when(acc["found"] < 0, n + 1).otherwise(acc["found"]))


def recent_activity(series: DataFrame, unit: str, value: str) -> DataFrame:
    """(unit, recent_count, historical_average, change, status) of dense monthly series.

    Recent are the last 3 months; change compares their monthly mean with that of all earlier ones. Fewer than 15 months
    give nulls and the status Insufficient data; no earlier reports a null change and No historical activity.
    """
    late = Window.partitionBy(unit).orderBy(F.desc("month"))
    s = series.withColumn("__r", F.row_number().over(late))
    g = s.groupBy(unit).agg(F.count(F.lit(1)).alias("n"), F.sum(F.when(F.col("__r") <= RECENT_MONTHS, F.col(value))).alias("recent"), F.sum(F.when(F.col("__r") > RECENT_MONTHS, F.col(value))).alias("older"))
    enough = F.col("n") >= RECENT_MONTHS + MIN_HISTORY
    mean = F.col("older") / F.nullif(F.col("n") - RECENT_MONTHS, F.lit(0))
    return g.select(
        unit, F.when(enough, F.col("recent")).alias("recent_count"), F.when(enough, mean).alias("historical_average"),
        F.when(enough & (F.col("older") > 0), (F.col("recent") / RECENT_MONTHS - mean) / F.nullif(mean, F.lit(0.0))).alias("change"),
        F.when(~enough, INSUFFICIENT).when(F.col("older") == 0, "No historical activity").otherwise("ok").alias("status"),
    )


def trend_stats(series: DataFrame, unit: str, value: str) -> DataFrame:
    """(unit, months, reports, valid, tau, slope, s, var): Kendall's tau-b against time and the Theil-Sen slope.

    Pairs are formed within a unit's series, so their number is set by the months. A series of fewer than 12 months or
    10 reports is invalid and has nulls; a constant one has tau and slope 0. s and var are the score and its variance
    with ties, from which trend_p takes the p-value.
    """
    order = Window.partitionBy(unit).orderBy("month")
    t = series.select(unit, F.col(value).cast("double").alias("y"), (F.row_number().over(order) - 1).alias("i"))
    lists = t.groupBy(unit).agg(F.array_sort(F.collect_list(F.struct("i", "y"))).alias("v"), F.count(F.lit(1)).alias("months"), F.sum("y").alias("reports"), (F.min("y") == F.max("y")).alias("flat"))
    ties = t.groupBy(unit, "y").agg(F.count(F.lit(1)).alias("c")).groupBy(F.col(unit).alias("__u")).agg(F.sum(F.col("c") * (F.col("c") - 1)).alias("t2"), F.sum(F.col("c") * (F.col("c") - 1) * (2 * F.col("c") + 5)).alias("t5"))
    valid = (F.col("months") >= MIN_MONTHS_TREND) & (F.col("reports") >= MIN_REPORTS_TREND)
    pairs = F.flatten(F.transform("v", lambda a: F.transform(F.filter("v", lambda b: b["i"] > a["i"]), lambda b: F.struct(F.signum(b["y"] - a["y"]).alias("s"), ((b["y"] - a["y"]) / (b["i"] - a["i"])).alias("m")))))
    p = lists.withColumn("p", F.explode_outer(pairs)).groupBy(unit, "months", "reports", "flat").agg(F.sum("p.s").alias("s"), F.percentile("p.m", F.lit(0.5)).alias("slope"))
    p = p.join(ties, p[unit].eqNullSafe(ties["__u"]))
    n = F.col("months")
    n0 = n * (n - 1)
    tau = F.col("s") * 2 / F.sqrt(n0 * (n0 - F.col("t2")))
    ok = lambda c, flat: F.when(valid & F.col("flat"), F.lit(flat)).when(valid, c)
    return p.select(unit, "months", "reports", valid.alias("valid"), ok(tau, 0.0).alias("tau"), ok(F.col("slope"), 0.0).alias("slope"), ok(F.col("s"), 0.0).alias("s"), ok((n0 * (2 * n + 5) - F.col("t5")) / 18, 0.0).alias("var"))


def exact_tau_p(n: int, score: int) -> float:
    """Two-sided p-value of Kendall's score of n untied pairs, by counting permutations (inversions)."""
    counts = [1]
    for k in range(2, n + 1):
        wide = [0] * (len(counts) + k - 1)
        for i, c in enumerate(counts):
            for j in range(k):
                wide[i + j] += c
        counts = wide
    most = n * (n - 1) // 2
    least = (most - abs(score)) // 2
    return min(1.0, 2 * sum(counts[: least + 1]) / math.factorial(n))


@F.pandas_udf(T.DoubleType())
def trend_p(s: pd.Series, var: pd.Series, months: pd.Series, ties: pd.Series) -> pd.Series:
    """Two-sided p-value: exact for series without ties of at most 33 values or nearly sorted, else normal."""
    def one(s: float, v: float, n: int, tied: bool) -> float | None:
        if s is None or math.isnan(s):
            return None
        if v == 0 or n < 2:
            return 1.0
        if not tied and (n <= 33 or min(n * (n - 1) / 2 - abs(s), n * (n - 1) / 2 + abs(s)) / 2 <= 1):
            return exact_tau_p(int(n), int(s))
        return math.erfc(abs(s) / math.sqrt(v) / math.sqrt(2))

    return pd.Series([one(*x) for x in zip(s, var, months, ties, strict=True)], dtype="float64")


def bh_adjust(df: DataFrame, p: str, into: str = "q_value") -> DataFrame:
    """df with Benjamini-Hochberg adjusted values over its non-null p; null where p is. Ties keep any order.

    Ranks and running minima are taken in ranges, so no task sees all values.
    """
    ranked = with_rank(df.where(F.col(p).isNotNull()), [p], "__rank", "__n")
    ranked = stage(ranked.withColumn("__part", F.floor((F.col("__rank") - 1) * 200 / F.col("__n"))).withColumn("__x", F.col(p) * F.col("__n") / F.col("__rank")), "bh")
    # smallest value of all later parts, of which there are 200 at most, then of the later rows of a row's own part
    least = ranked.groupBy("__part").agg(F.min("__x").alias("__least"))
    after = least.select("__part", F.min("__least").over(Window.orderBy("__part").rowsBetween(1, Window.unboundedFollowing)).alias("__after"))
    own = F.min("__x").over(Window.partitionBy("__part").orderBy("__rank").rowsBetween(0, Window.unboundedFollowing))
    out = ranked.join(F.broadcast(after), "__part").withColumn(into, F.least(F.lit(1.0), own, "__after")).select(*df.columns, into)
    return out.unionByName(df.where(F.col(p).isNull()).withColumn(into, F.lit(None).cast("double")))


def label_trends(stats: DataFrame) -> DataFrame:
    """stats with p_value, q_value and trend: Increasing, Decreasing or Stable at 5 % after adjustment over the valid
    units, Insufficient data for the others."""
    tied = F.col("var") * 18 != F.col("months") * (F.col("months") - 1) * (2 * F.col("months") + 5)
    s = bh_adjust(stats.withColumn("p_value", F.when(F.col("valid"), trend_p("s", "var", "months", F.coalesce(tied, F.lit(True))))), "p_value")
    sure = F.coalesce(F.col("q_value") < ALPHA_TREND, F.lit(False))
    return s.withColumn("trend", F.when(~F.col("valid"), INSUFFICIENT).when(sure & (F.col("tau") > 0), "Increasing").when(sure & (F.col("tau") < 0), "Decreasing").otherwise("Stable"))


def unit_metrics(series: DataFrame, units: DataFrame, rate: Column, test: bool = True) -> DataFrame:
    """Per unit of a dense series: area, expected reports a month, active threshold and months, persistence and its test.

    ``units`` has unit and area_km2, ``rate`` is the null rate per km2 and month. Under 24 months persistence is null;
    with ``test`` False (units chosen for being dense) only the share is given.
    """
    u = units.withColumn("expected", rate * F.col("area_km2"))
    u = u.withColumn("active_threshold", active_threshold(F.col("expected"))).withColumn("p0", tail_from(F.col("expected"), F.col("active_threshold")))
    m = series.join(u.select("unit", "area_km2", "expected", "active_threshold", "p0"), "unit").groupBy("unit", "area_km2", "expected", "active_threshold", "p0").agg(F.count_if(F.col("target_reports") >= F.col("active_threshold")).alias("active_months"), F.count(F.lit(1)).alias("months"), F.sum("target_reports").alias("total_reports"))
    enough = F.col("months") >= MIN_MONTHS_PERSISTENCE
    need = F.when(enough & F.lit(test), persistence_threshold(F.col("months").cast("int"), F.col("p0")))
    m = m.withColumn("needed_months", need)
    return m.withColumns({"persistence": F.when(enough, F.col("active_months") / F.col("months")), "persistent": F.col("active_months") >= F.col("needed_months")}).drop("p0")


def spearman(df: DataFrame, x: str, y: str) -> DataFrame:
    """(n, rho): rank correlation with average ranks for ties; rows with a null are left out, fewer than 10 give null, and
    so does a column of one value."""
    d = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    d = d.join(average_ranks(d, x, "__a"), x).join(average_ranks(d, y, "__b"), y)
    return d.agg(F.count(F.lit(1)).alias("n"), (F.covar_pop("__a", "__b") / F.nullif(F.stddev_pop("__a") * F.stddev_pop("__b"), F.lit(0.0))).alias("r")).select("n", F.when(F.col("n") >= 10, F.col("r")).alias("rho"))
