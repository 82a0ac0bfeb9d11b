"""Counts per exact coordinate, and the stored counts that disagree with them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hotloom.operators.frequency import compress, totals
from hotloom.operators.skew import split_join
from hotloom.session import stage

PIN_LIMIT = 8
PLACE = ["run_id", "latitude", "longitude"]


def coordinate_counts(complaints: DataFrame) -> DataFrame:
    """(run_id, latitude, longitude, total) over all rows with both coordinates, run_id null being a run of its own."""
    return totals(compress(placed(complaints), PLACE, []), PLACE)


def placed(complaints: DataFrame) -> DataFrame:
    return complaints.where(F.col("latitude").isNotNull() & F.col("longitude").isNotNull())


def wrong_counts(complaints: DataFrame, pins: DataFrame) -> DataFrame:
    """(kind, key_id): complaints whose coord_multiplicity or suspect_fallback_pin and pins whose
    reports_all_categories aren't what the exact coordinate's number of complaints in the run gives.

    Rows are compressed to (coordinate, stored values), of which a hot coordinate has few; totals and the verdict are
    made there, and only wrong combinations are joined back. Stored nulls are wrong. Complaints with a null coordinate
    are never listed; a pin with one has no complaints, so 0 is right for it. 0.0 and -0.0 are one coordinate.
    """
    stored = ["coord_multiplicity", "suspect_fallback_pin"]
    rows = placed(complaints).select("rowid_", *PLACE, *stored)
    weighted = stage(compress(rows, PLACE, stored), "pin_values")
    total = totals(weighted, PLACE).select(*[F.col(c).alias(f"__{c}") for c in PLACE], F.col("total").alias("__total"))
    total = stage(total, "pin_totals")
    w = split_join(weighted, total, {c: f"__{c}" for c in PLACE}, "__total", nulls_match=True)
    right = (F.col("coord_multiplicity").eqNullSafe(F.col("__total"))) & F.col("suspect_fallback_pin").eqNullSafe(F.when(F.col("__total") >= PIN_LIMIT, 1).otherwise(0))
    wrong = stage(w.where(~right).select(*[F.col(c).alias(f"__{c}") for c in PLACE + stored], F.col("weight").alias("__weight")), "pin_wrong")
    found = split_join(rows, wrong, {c: f"__{c}" for c in PLACE + stored}, "__weight", nulls_match=True)
    at = total.withColumnRenamed("__total", "__n")
    on = pins["run_id"].eqNullSafe(at["__run_id"]) & (pins["latitude"] == at["__latitude"]) & (pins["longitude"] == at["__longitude"])
    listed = pins.select("pin_id", *PLACE, "reports_all_categories")
    checked = listed.join(at, on, "left").where(~F.col("reports_all_categories").eqNullSafe(F.coalesce("__n", F.lit(0))))
    out = found.select(F.lit("complaint").alias("kind"), F.col("rowid_").cast("long").alias("key_id"))
    return out.unionByName(checked.select(F.lit("pin").alias("kind"), F.col("pin_id").cast("long").alias("key_id"))).distinct()
