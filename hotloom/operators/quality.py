"""Distributions and quality figures of complaint rows.

Rows have the columns that plans.reports.issues gives: month (YYYY-MM or null), category, sub_category, is_target,
usable, in_boundary, pin (booleans), reported (a date), run_id, lat, lon and so on.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hotloom.operators.cleaning import coarsened, coordinate_flags
from hotloom.operators.series import month_spine

MIN_POINTS, MIN_MONTHS = 500, 24


def distribution(df: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, complaints, pct) of every combination, nulls kept. The total is taken from the grouped rows."""
    g = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("complaints"))
    total = F.sum("complaints").over(Window.partitionBy(F.lit(1)))
    return g.withColumn("pct", F.lit(100.0) * F.col("complaints") / total)


def monthly_quality(df: DataFrame) -> DataFrame:
    """(month, complaints, targets, usable_targets, target_share) for every month of the range, silent ones included."""
    counts = df.where(F.col("month").isNotNull()).groupBy(F.col("month").alias("__m")).agg(F.count(F.lit(1)).alias("a"), F.count_if("is_target").alias("b"), F.count_if(F.col("is_target") & F.col("usable") & ~F.col("pin")).alias("c"))
    spine = month_spine(df, "month")
    d = spine.join(counts, spine["month"] == counts["__m"], "left")
    z = lambda c: F.coalesce(c, F.lit(0))
    return d.select("month", z("a").alias("complaints"), z("b").alias("targets"), z("c").alias("usable_targets"), (F.col("b") / F.nullif("a", F.lit(0))).alias("target_share"))


def month_gaps(df: DataFrame) -> DataFrame:
    """(month) of the range without any complaint."""
    return monthly_quality(df).where("complaints = 0").select("month")


def _checks() -> dict[str, Column]:
    flags = coordinate_flags(F.col("lat"), F.col("lon"))
    return {
        "null_coordinates": flags["null_coord"], "out_of_global_range": flags["out_of_range"], "zero_zero": flags["zero_zero"],
        "swapped_lat_lon": flags["swapped"], "coarse_rounded": flags["coarse"], "outside_boundary": ~F.col("in_boundary"),
        "suspect_fallback_pin": F.col("pin"), "ward_disagrees": ~F.col("source_ward_id").eqNullSafe(F.col("ward_id")) & F.col("in_boundary"), "usable": F.col("usable"),
    }


def coordinate_quality(df: DataFrame) -> DataFrame:
    """(scope, check, complaints, pct): nine checks over all complaints and over targets, in one pass; pct 0 if empty."""
    checks = _checks()
    scopes = {"all": F.lit(True), "target": F.col("is_target")}
    sums = [F.count_if(mask & inside).alias(f"{scope}:{name}") for scope, inside in scopes.items() for name, mask in checks.items()]
    one = df.agg(*sums, *[F.count_if(inside).alias(f"n:{scope}") for scope, inside in scopes.items()])
    rows = F.array(*[F.struct(F.lit(scope).alias("scope"), F.lit(name).alias("check"), F.col(f"`{scope}:{name}`").alias("complaints"), F.coalesce(F.lit(100.0) * F.col(f"`{scope}:{name}`") / F.nullif(F.col(f"`n:{scope}`"), F.lit(0)), F.lit(0.0)).alias("pct")) for scope in scopes for name in checks])
    return one.select(F.inline(rows))


def duplicate_stats(df: DataFrame) -> DataFrame:
    """One row of counts: repeated request ids and shared coordinates, over all complaints and over targets.

    Each figure comes from rows grouped by the key, so no key's rows are gathered.
    """
    ids = df.groupBy("request_id").agg(F.count(F.lit(1)).alias("n"), F.count_if("is_target").alias("t"))
    a = ids.agg(F.sum(F.col("n") - 1).alias("repeated_all"), F.sum(F.greatest(F.col("t") - 1, F.lit(0))).alias("repeated_target"))
    at = df.where(F.col("lat").isNotNull() & F.col("lon").isNotNull()).groupBy("lat", "lon").agg(F.count(F.lit(1)).alias("n"), F.count_if("is_target").alias("t"))
    b = at.agg(
        F.count(F.lit(1)).alias("places_all"), F.count_if(F.col("t") > 0).alias("places_target"), F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("n"))), F.lit(0)).alias("sharing_all"),
        F.coalesce(F.sum(F.when(F.col("t") > 1, F.col("t"))), F.lit(0)).alias("sharing_target"), F.max("n").alias("most_all"), F.max("t").alias("most_target"),
        *[F.coalesce(F.sum(F.when(F.col("n") >= k, F.col("t"))), F.lit(0)).alias(f"target_at_{k}") for k in (3, 5, 8, 15, 30)],
    )
    return a.withColumn("__k", F.lit(1)).join(b.withColumn("__k", F.lit(1)), "__k").drop("__k")


def multiplicity_histogram(df: DataFrame, most: int = 12) -> DataFrame:
    """(multiplicity, places) of the ``most`` smallest multiplicities of exact coordinates."""
    at = df.where(F.col("lat").isNotNull() & F.col("lon").isNotNull()).groupBy("lat", "lon").agg(F.count(F.lit(1)).alias("multiplicity"))
    return at.groupBy("multiplicity").agg(F.count(F.lit(1)).alias("places")).orderBy("multiplicity").limit(most)


def duplicate_coordinates(df: DataFrame) -> DataFrame:
    """Coordinates with two or more complaints and a target: counts, distinct kinds and months, first and last day of
    report, whether all complaints suspect a default pin. One row per exact coordinate of a run, of which only 3 places
    come out, so no report's place does."""
    g = df.where(F.col("lat").isNotNull() & F.col("lon").isNotNull()).groupBy("run_id", "lat", "lon")
    g = g.agg(F.count(F.lit(1)).alias("complaints"), F.count_if("is_target").alias("targets"), F.countDistinct("sub_category").alias("kinds"), F.countDistinct("month").alias("months"), F.min("reported").alias("first_report"), F.max("reported").alias("last_report"), F.min("pin").alias("pin"))
    return g.where((F.col("complaints") >= 2) & (F.col("targets") >= 1)).withColumns({"lat": coarsened(F.col("lat")), "lon": coarsened(F.col("lon"))})


def exact_copies(df: DataFrame) -> DataFrame:
    """(copies): rows beyond the first of exactly equal ones, over all columns."""
    return df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("__n")).agg(F.coalesce(F.sum(F.col("__n") - 1), F.lit(0)).alias("copies"))


def data_gate(df: DataFrame) -> DataFrame:
    """One row: the gate's verdict and what it rests on.

    usable_targets are usable targets without suspected default pins, months the distinct months of those; both decide.
    The rest is context: rows, undated rows, months with any complaint and their ends, rows inside the boundary, the range
    of coordinates as they are stored, missing and valid coordinates, and the targets' own figures. An empty table fails.
    """
    flags = coordinate_flags(F.col("lat"), F.col("lon"))
    valid = ~(flags["null_coord"] | flags["out_of_range"] | flags["zero_zero"] | flags["swapped"])
    analysed = F.col("is_target") & F.col("usable") & ~F.col("pin")
    share = lambda c: F.lit(100.0) * F.count_if(c) / F.nullif(F.count(F.lit(1)), F.lit(0))
    of = lambda mask, c: F.when(mask, F.col(c))
    d = df.agg(
        F.count(F.lit(1)).alias("complaints"), F.count_if(analysed).alias("usable_targets"), F.countDistinct(of(analysed, "month")).alias("months"), F.count_if(F.col("month").isNull()).alias("undated"),
        F.countDistinct("month").alias("months_with_data"), F.min("month").alias("first_month"), F.max("month").alias("last_month"), F.count_if("in_boundary").alias("inside_boundary"), share(F.col("in_boundary")).alias("inside_boundary_pct"),
        F.min("lat").alias("lat_min"), F.max("lat").alias("lat_max"), F.min("lon").alias("lon_min"), F.max("lon").alias("lon_max"), F.count_if(flags["null_coord"]).alias("missing_coordinates"), share(flags["null_coord"]).alias("missing_coordinates_pct"),
        F.count_if(valid).alias("valid_coordinates"), F.count_if("is_target").alias("targets"), F.count_if(F.col("is_target") & valid).alias("valid_targets"), F.count_if(F.col("is_target") & F.col("usable")).alias("targets_inside"),
        F.count_if(F.col("is_target") & F.col("usable") & F.col("pin")).alias("target_pins_inside"), F.min(of(F.col("is_target"), "month")).alias("first_target_month"), F.max(of(F.col("is_target"), "month")).alias("last_target_month"),
    )
    return d.withColumn("passed", (F.col("usable_targets") >= MIN_POINTS) & (F.col("months") >= MIN_MONTHS))
