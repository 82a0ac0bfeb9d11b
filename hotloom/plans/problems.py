"""Queries of the general problems: p1 time notations, p2 hot keys, p3 nearness, p5 trailing totals."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hotloom.plans import problem_sql
from hotloom.operators import frequency, pins, proximity, regions, timestamps, trailing
from hotloom.session import stage
from hotloom.sources.tables import table


def _dated(spark: SparkSession, folder: str, *columns: str) -> DataFrame:
    """Complaints with their instants, by the dictionary that is kept for this folder's loads; a load is a source."""
    rows = table(spark, folder, "complaints").select("run_id", "created_at", *columns)
    return timestamps.normalise_stamps(rows, "created_at", path=timestamps.kept_dictionary(spark, folder), source="run_id")


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return _dated(spark, folder, "rowid_").select("rowid_", "utc_micros", "local_month")


def p1_month_conflicts(spark: SparkSession, folder: str) -> DataFrame:
    """How often each stored month stands for another local month of the instant, null for none."""
    wrong = _dated(spark, folder, "month").where(~F.col("month").eqNullSafe(F.col("local_month")))
    return wrong.groupBy("month", "local_month").agg(F.count(F.lit(1)).alias("complaints"))


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    return pins.wrong_counts(table(spark, folder, "complaints"), table(spark, folder, "duplicate_coordinate_analysis"))


def p2_profile(spark: SparkSession, folder: str) -> DataFrame:
    """Per run and coordinate: complaints, distinct and most frequent category, and the median stored ward."""
    rows = pins.placed(table(spark, folder, "complaints"))
    return frequency.profile(rows, pins.PLACE, modes=["sub_issue_type", "month"], percentiles={"ward_id": [0.5]})


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "complaints").select("rowid_", "run_id", "latitude", "longitude", "ward_id")
    near = proximity.near_rows(rows, ["run_id"], "rowid_", "latitude", "longitude", 25.0)
    near = near.select(F.lit("near").alias("kind"), F.col("id_lo").cast("long").alias("id_lo"), F.col("id_hi").cast("long").alias("id_hi"))
    placed = rows.where(F.col("latitude").isNotNull() & F.col("longitude").isNotNull())
    ward = regions.containing_region(placed, table(spark, folder, "wards"), "latitude", "longitude", "__in")
    ward = ward.where(F.coalesce("ward_id", F.lit(-1)) != F.col("__in"))
    return near.unionByName(ward.select(F.lit("ward").alias("kind"), F.col("__in").cast("long").alias("id_lo"), F.col("rowid_").cast("long").alias("id_hi")))


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    wards = trailing.busy_wards(table(spark, folder, "complaints"), timestamps.kept_dictionary(spark, folder))
    return wards.unionByName(trailing.stale_clusters(table(spark, folder, "cluster_summary"), table(spark, folder, "spatial_unit_monthly")))


def p5_ward_days(spark: SparkSession, folder: str) -> DataFrame:
    """Totals and daily averages of the last 7 and 30 days for every ward and day from its first to the run's last."""
    per_day = stage(trailing.ward_days(table(spark, folder, "complaints"), timestamps.kept_dictionary(spark, folder))[0], "ward_days")
    last = per_day.groupBy(F.col("run_id").alias("__run")).agg(F.max("day").alias("__last"))
    spans = trailing.trailing_intervals(per_day.where((F.col("ward_id") >= 1) & (F.col("requests") > 0)), ["run_id", "ward_id"], "day", "requests", [7, 30])
    days = trailing.trailing_daily(spans.join(last, spans["run_id"].eqNullSafe(last["__run"])), ["run_id", "ward_id"], F.col("__last"))
    return days.select("run_id", "ward_id", F.date_from_unix_date("step").cast("string").alias("day"), "t7", "t30", (F.col("t7") / 7).alias("avg7"), (F.col("t30") / 30).alias("avg30"))


QUERIES = {f.__name__: f for f in (p1_found, p1_month_conflicts, p2_found, p2_profile, p3_found, p5_found, p5_ward_days)}
ORACLE = problem_sql.ORACLE
