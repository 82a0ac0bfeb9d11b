"""The read side: lookups over stored results, each a DataFrame that Catalyst can push filters into."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hotloom.operators.ranking import with_rank
from hotloom.operators.shapes import simplify_regions
from hotloom.sources.artifacts import get_artifact


class NotFound(LookupError):
    """Nothing is stored under that name or id."""


class BadQuery(ValueError):
    """A parameter that the surface doesn't know."""


def _number_first(column: str, kind: str) -> tuple[Column, Column]:
    """(is text or null, number): text and nulls tie with each other and come after all numbers."""
    number = F.col(column).try_cast("double") if kind == "string" else F.col(column).cast("double")
    return number.isNull(), F.coalesce(number, F.lit(0.0))


def hotspots(rows: DataFrame, sort: str = "rank", order: str = "asc", min_reports: int = 0, trend: str | None = None, limit: int = 200) -> DataFrame:
    """The stored hotspots that fulfil the filters, at most ``limit`` in the order asked for.

    Text and nulls come last in ascending and first in descending order; ties are settled by run and cluster id. An
    unknown sort field or order, a negative min_reports or a limit outside 1 to 500 is a BadQuery. The column matched
    has the number of rows before the limit.
    """
    if sort not in rows.columns or order not in ("asc", "desc") or min_reports < 0 or not 1 <= limit <= 500:
        raise BadQuery(f"sort={sort} order={order} min_reports={min_reports} limit={limit}")
    kept = rows.where(F.col("report_count") >= min_reports)
    if trend is not None:
        kept = kept.where(F.col("observed_trend") == trend)
    text, number = _number_first(sort, dict(rows.dtypes)[sort])
    keys = [text.asc(), number.asc()] if order == "asc" else [text.desc(), number.desc()]
    matched = kept.agg(F.count(F.lit(1)).alias("matched")).withColumn("__k", F.lit(1))
    first = kept.orderBy(*keys, "run_id", "cluster_id").limit(limit).withColumn("__k", F.lit(1))
    return first.join(F.broadcast(matched), "__k").drop("__k").orderBy(*keys, "run_id", "cluster_id")


def hotspot(rows: DataFrame, monthly: DataFrame, run_id: int, cluster_id: int) -> tuple[DataFrame, DataFrame]:
    """One hotspot, with its boundary where the table has it, and its months in order; NotFound if there is none."""
    one = rows.where((F.col("run_id") == run_id) & (F.col("cluster_id") == cluster_id))
    if one.isEmpty():
        raise NotFound(f"cluster {cluster_id} of run {run_id}")
    return one, timeline(monthly, "cluster", cluster_id, run_id)


def timeline(monthly: DataFrame, unit_type: str, unit_id: int | None = None, run_id: int | None = None) -> DataFrame:
    """Months of one ward or cluster, or of the city as the sum of its wards, in order. Repeated rows count once."""
    once = monthly.distinct()
    if run_id is not None:
        once = once.where(F.col("run_id") == run_id)
    if unit_type == "city":
        g = once.where(F.col("unit_type") == "ward").groupBy("run_id", "month").agg(F.sum("pothole_reports").alias("pothole_reports"), F.sum("all_complaints").alias("all_complaints"))
        return g.orderBy("run_id", "month")
    if unit_type not in ("ward", "cluster") or unit_id is None:
        raise BadQuery(f"unit_type={unit_type} unit_id={unit_id}")
    return once.where((F.col("unit_type") == unit_type) & (F.col("unit_id") == unit_id)).select("run_id", "month", "pothole_reports", "all_complaints").orderBy("run_id", "month")


def summary(issues: DataFrame, clusters: DataFrame) -> DataFrame:
    """Headline counters of each run; a run without clusters has zeros."""
    a = issues.groupBy("run_id").agg(F.count(F.lit(1)).alias("complaints"), F.count_if("is_target").alias("targets"), F.count_if(F.col("is_target") & F.col("usable") & ~F.col("pin")).alias("analysed"), F.min("month").alias("first_month"), F.max("month").alias("last_month"))
    b = clusters.groupBy(F.col("run_id").alias("__run")).agg(F.count(F.lit(1)).alias("hotspots"), F.max("report_count").alias("largest"))
    d = a.join(b, F.col("run_id").eqNullSafe(F.col("__run")), "left").drop("__run")
    return d.withColumns({"hotspots": F.coalesce("hotspots", F.lit(0)), "largest": F.coalesce("largest", F.lit(0))})


def ward_search(wards: DataFrame, text: str, persistent: bool = False) -> DataFrame:
    """Wards whose name contains the text, whatever the case; with ``persistent`` only those so marked."""
    found = wards.where(F.lower("name").contains(text.lower()))
    return found.where("persistent") if persistent else found


def spatial_units(metrics: DataFrame, wards: DataFrame, geometry: bool = False) -> DataFrame:
    """Metrics of wards (unit) with name and zone, and with their simplified rings if asked for."""
    w = simplify_regions(wards) if geometry else wards.drop("rings")
    return metrics.join(w, metrics["unit"] == w["ward_id"], "left").drop("ward_id")


def parameters(sweep: DataFrame, eps: float, least: int) -> DataFrame:
    """The swept grid in order, the chosen configuration marked."""
    return sweep.withColumn("chosen", (F.col("eps") == eps) & (F.col("least") == least)).orderBy("least", "eps")


def data_status(sources: DataFrame, gate: DataFrame) -> DataFrame:
    """Each source's record beside the data gate's verdict."""
    g = gate.select(F.col("passed").alias("gate_passed"), "usable_targets", F.col("months").alias("months_covered"), F.lit(1).alias("__k"))
    return sources.withColumn("__k", F.lit(1)).join(F.broadcast(g), "__k", "left").drop("__k")


def quality(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """The stored quality reports: gate, monthly, categories, coordinate_quality and status_distribution; NotFound names
    those that aren't stored. The gate's record has no names of the raw file's columns."""
    names = {"gate": "gate", "monthly": "monthly_quality", "categories": "category_distribution", "coordinate_quality": "coordinate_quality", "status_distribution": "status_counts"}
    found = {part: get_artifact(spark, folder, name) for part, name in names.items()}
    missing = [part for part, df in found.items() if df is None]
    if missing:
        raise NotFound(", ".join(missing))
    return found


def health(spark: SparkSession, folder: str, names: list[str]) -> dict[str, bool]:
    """Which named artifacts are there."""
    return {name: get_artifact(spark, folder, name) is not None for name in names}


def map_metric(rows: DataFrame, metric: str) -> DataFrame:
    """rows with value: density per km2, share of all complaints, or total. Another metric is a BadQuery."""
    values = {"density": F.col("density_reports_per_km2"), "share": F.col("complaint_share"), "total": F.col("report_count").cast("double")}
    if metric not in values:
        raise BadQuery(metric)
    return rows.withColumn("value", values[metric])


def breaks(rows: DataFrame, value: str, levels: tuple[float, ...] = (0.2, 0.4, 0.6, 0.8, 0.95)) -> DataFrame:
    """(level, value): the values at these shares of the sorted list (index floor(level x n)), for a map's classes."""
    at = with_rank(rows.where(F.col(value).isNotNull()).select(F.col(value).alias("value")), ["value"], "i", "n").withColumn("i", F.col("i") - 1)
    picks = F.array(*[F.struct(F.lit(x).alias("level"), F.least(F.floor(F.lit(x) * F.col("n")), F.col("n") - 1).alias("pick")) for x in levels])
    return at.withColumn("p", F.explode(picks)).where(F.col("p.pick") == F.col("i")).select("p.level", "value")
