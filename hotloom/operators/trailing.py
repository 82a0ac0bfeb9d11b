"""Totals over trailing periods by event contributions.

Each daily amount adds at its day and subtracts when it leaves the window; the running sum of these deltas is the total
from that day until the next change. Silent days cost nothing: they lie inside the intervals.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hotloom.operators.timestamps import normalise_stamps
from hotloom.session import stage


def trailing_intervals(daily: DataFrame, unit: list[str], step: str, amount: str, windows: list[int]) -> DataFrame:
    """(unit, start, until, t<w>...): for each unit, the spans [start, until) of steps in which no total changes.

    ``daily`` has one row or more per unit and integer step; rows with a null step or amount count nothing. t<w> is the
    sum over the step and the w - 1 before it. until is null after the last change, when all totals are 0. Steps before
    a unit's first row are in no span.
    """
    events = daily.where(F.col(step).isNotNull() & F.col(amount).isNotNull()).groupBy(*unit, step).agg(F.sum(amount).alias("__x"))
    deltas = F.array(
        F.struct(F.col(step).alias("at"), *[F.col("__x").alias(f"t{w}") for w in windows]),
        *[F.struct((F.col(step) + w).alias("at"), *[(-F.col("__x") if v == w else F.lit(0).cast("long")).alias(f"t{v}") for v in windows]) for w in windows],
    )
    changes = events.select(*unit, F.explode(deltas).alias("d")).groupBy(*unit, F.col("d.at").alias("start")).agg(*[F.sum(f"d.t{w}").alias(f"t{w}") for w in windows])
    run = Window.partitionBy(*unit).orderBy("start")
    return changes.select(*unit, "start", F.lead("start").over(run).alias("until"), *[F.sum(f"t{w}").over(run.rowsBetween(Window.unboundedPreceding, 0)).alias(f"t{w}") for w in windows])


def trailing_daily(intervals: DataFrame, unit: list[str], last: Column, since: Column | None = None) -> DataFrame:
    """One row per unit and step of the intervals up to ``last`` (inclusive), silent steps included: step and totals."""
    low = F.greatest(F.col("start"), since) if since is not None else F.col("start")
    high = F.least(F.coalesce(F.col("until") - 1, last), last)
    rows = intervals.withColumns({"__low": low, "__high": high}).where(F.col("__low") <= F.col("__high"))
    return rows.withColumn("step", F.explode(F.sequence("__low", "__high"))).drop("start", "until", "__low", "__high")


def ward_days(complaints: DataFrame, dictionary: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(daily, last): distinct requests per run, ward (stored, 1 or more) and local day number; and each run's last day.

    A complaint without an instant counts nowhere, one without a ward only for the last day. Null request ids count as
    no request. ``dictionary`` is where the dictionary of stamps is kept, with the run as their source.
    """
    dated = normalise_stamps(complaints.select("run_id", "request_id", "ward_id", "created_at"), "created_at", path=dictionary, source="run_id")
    dated = dated.select("run_id", "request_id", "ward_id", F.unix_date("local_day").alias("day"))
    # one shuffle serves both: a run's requests by ward and day, of which a hot ward has no few large ones
    seen = dated.groupBy("run_id", "ward_id", "day", "request_id").agg(F.lit(1).alias("__one"))
    per_day = seen.groupBy("run_id", "ward_id", "day").agg(F.count("request_id").alias("requests"))
    return per_day, per_day.groupBy("run_id").agg(F.max("day").alias("last"))


def busy_wards(complaints: DataFrame, dictionary: str | None = None) -> DataFrame:
    """('ward', run_id, unit_id, day): days on which a ward's last 7 days hold at least 6 requests and 7 tenths of those
    of the last 30; from 29 days after its first counted day to the run's last."""
    per_day, _ = ward_days(complaints, dictionary)
    per_day = stage(per_day, "ward_days")
    last = per_day.groupBy("run_id").agg(F.max("day").alias("__last"))
    wards = per_day.where((F.col("ward_id") >= 1) & (F.col("requests") > 0))
    unit = ["run_id", "ward_id"]
    spans = trailing_intervals(wards, unit, "day", "requests", [7, 30])
    spans = spans.withColumn("__first", F.min("start").over(Window.partitionBy(*unit)))
    hit = spans.where((F.col("t7") >= 6) & (F.col("t7") * 10 >= F.col("t30") * 7))
    runs = last.withColumnRenamed("run_id", "__run")
    hit = hit.join(runs, hit["run_id"].eqNullSafe(runs["__run"]))
    days = trailing_daily(hit, unit, F.col("__last"), F.col("__first") + 29)
    return days.select(F.lit("ward").alias("kind"), "run_id", F.col("ward_id").alias("unit_id"), F.date_from_unix_date("step").cast("string").alias("period"))


def month_number(month: Column) -> Column:
    """Months since year 0 of a text YYYY-MM; null if it is none."""
    ok = month.rlike(r"^\d{4}-(0[1-9]|1[0-2])$")
    return F.when(ok, F.substring(month, 1, 4).cast("int") * 12 + F.substring(month, 6, 2).cast("int") - 1)


def cluster_months(monthly: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(spans, last): three-month totals of each cluster's pothole reports, and each run's greatest month over all units.

    Exactly repeated rows count once; null reports count 0.
    """
    once = monthly.distinct()
    last = once.groupBy("run_id").agg(F.max("month").alias("month")).withColumn("last", month_number(F.col("month")))
    clusters = once.where(F.col("unit_type") == "cluster").withColumn("m", month_number(F.col("month")))
    return trailing_intervals(clusters, ["run_id", "unit_id"], "m", "pothole_reports", [3]), last


def stale_clusters(summary: DataFrame, monthly: DataFrame) -> DataFrame:
    """('cluster', run_id, cluster_id, month): clusters whose recent_3_month_count is a number other than their reports
    of the run's last three months. Texts that are no number and nulls are never listed; a run without months has none."""
    spans, last = cluster_months(monthly)
    runs = last.select(F.col("run_id").alias("__run"), "month", "last")
    stated = summary.select("run_id", "cluster_id", F.trim("recent_3_month_count").try_cast("double").alias("stated")).where(F.col("stated").isNotNull() & ~F.isnan("stated"))
    stated = stated.join(runs, stated["run_id"].eqNullSafe(runs["__run"]))
    # grows with the clusters, so it is never broadcast
    at = spans.select(F.col("run_id").alias("__r"), "unit_id", "start", "until", "t3").hint("merge")
    on = stated["run_id"].eqNullSafe(at["__r"]) & (stated["cluster_id"] == at["unit_id"]) & (at["start"] <= stated["last"]) & (at["until"].isNull() | (at["until"] > stated["last"]))
    wrong = stated.join(at, on, "left").where(F.col("stated") != F.coalesce("t3", F.lit(0)))
    return wrong.select(F.lit("cluster").alias("kind"), "run_id", F.col("cluster_id").alias("unit_id"), F.col("month").alias("period"))
