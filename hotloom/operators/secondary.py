"""A second source beside the complaints: counts per region compared, never merged."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hotloom.operators.regions import containing_region
from hotloom.operators.series import spearman

#: The months of the complaints that are compared, and how many regions are needed.
MONTHS, TOP = ("2022-05", "2022-06"), 20


def student_tail(t: float, df: float) -> float:
    """Two-sided tail of Student's distribution, by the continued fraction of the incomplete beta function."""
    if math.isinf(t):
        return 0.0
    x = df / (df + t * t)
    a, b = df / 2, 0.5

    def fraction(a: float, b: float, x: float) -> float:
        c, d = 1.0, 1 - (a + b) * x / (a + 1)
        d = 1 / (d or 1e-300)
        f = d
        for m in range(1, 400):
            for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
                d = 1 / ((1 + num * d) or 1e-300)
                c = (1 + num / c) or 1e-300
                f *= d * c
            if abs(d * c - 1) < 1e-15:
                break
        return f

    if x in (0.0, 1.0):
        return x
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log(1 - x))
    return front * fraction(a, b, x) / a if x < (a + 1) / (a + b + 2) else 1 - front * fraction(b, a, 1 - x) / b


def ward_counts(records: DataFrame, wards: DataFrame, primary: DataFrame, months: tuple[str, ...] | None = MONTHS) -> DataFrame:
    """(ward_id, second, first): records inside each ward and usable target complaints of the months there, of wards
    that have either. ``primary`` has ward_id, month, is_target, usable; months None takes all."""
    inside = containing_region(records.where(F.col("latitude").isNotNull() & F.col("longitude").isNotNull()).select("latitude", "longitude"), wards, "latitude", "longitude", "ward_id").where("ward_id >= 0")
    p = primary.where(F.col("is_target") & F.col("usable") & (F.col("ward_id") >= 0))
    p = p if months is None else p.where(F.col("month").isin(*months))
    both = inside.groupBy("ward_id").agg(F.count(F.lit(1)).alias("second")).join(p.groupBy("ward_id").agg(F.count(F.lit(1)).alias("first")), "ward_id", "full")
    return both.fillna(0, ["second", "first"])


def comparison(counts: DataFrame) -> DataFrame:
    """One row of figures of ward_counts (a row per ward): wards, second_inside, first, ratio, rho and its two-sided
    p_value by Student's distribution, top_overlap, the wards among both sources' 20 first (of equal counts the smaller
    ward_id). Under 10 wards rho, p_value and top_overlap are null."""
    one = F.lit(1)
    n = counts.agg(F.count(one).alias("wards"), F.coalesce(F.sum("second"), F.lit(0)).alias("second_inside"), F.coalesce(F.sum("first"), F.lit(0)).alias("first"))
    tail = F.udf(lambda r, n: None if r is None else 0.0 if abs(r) >= 1 else student_tail(r * math.sqrt((n - 2) / (1 - r * r)), n - 2), "double")  # one row
    rho = spearman(counts, "second", "first").select("rho")
    top = lambda c: counts.orderBy(F.desc(c), "ward_id").limit(TOP).select("ward_id")
    both = top("second").intersect(top("first")).agg(F.count(one).alias("top_overlap"))
    out = n.withColumn("__k", one).join(rho.withColumn("__k", one), "__k").join(both.withColumn("__k", one), "__k")
    ratio = F.rint(F.col("second_inside") / F.greatest("first", one) * 10) / 10
    return out.select("wards", "second_inside", "first", ratio.alias("ratio"), "rho", tail("rho", "wards").alias("p_value"), F.when(F.col("wards") >= 10, F.col("top_overlap")).alias("top_overlap"))


def density(counts: DataFrame, footprint: DataFrame, city: DataFrame) -> DataFrame:
    """One row: records inside and elsewhere (counts), area_km2 of the outlines dissolved, city_km2, both densities and
    their ratio; null where an area or the density elsewhere is 0."""
    k = F.lit(1)
    d = counts.withColumn("__k", k).join(footprint.withColumn("__k", k), "__k").join(city.withColumn("__k", k), "__k").drop("__k")
    d = d.withColumns({"density_inside": F.col("inside") / F.nullif("area_km2", F.lit(0.0)), "density_elsewhere": F.col("elsewhere") / F.greatest(F.col("city_km2") - F.col("area_km2"), F.lit(1e-9))})
    return d.withColumn("ratio", F.col("density_inside") / F.nullif("density_elsewhere", F.lit(0.0)))
