"""Checks and column rules that turn raw complaint rows into flagged ones."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hotloom.operators.regions import containing_region
from hotloom.operators.skew import split_join
from hotloom.session import stage

#: Columns a raw complaint file must have, and those that are never kept.
REQUIRED = [
    "created_at", "ward_id", "title", "description", "sub_category_id", "civic_agency_id", "location", "address", "latitude", "longitude",
    "ward_title", "category_id", "category_title", "sub_category_title", "civic_agency_title", "complaint_status_title", "comment_count",
]
SENSITIVE = ["title", "description", "location", "address"]
#: All that is stored of a normalised complaint; anything else a file may hold, free text included, is not.
STORED = [
    "rowid_", "run_id", "request_id", "local_time", "month", "issue_type", "sub_issue_type", "status", "ward_id", "ward_name", "source_ward_id", "latitude", "longitude",
    "is_target", "in_boundary", "usable", "suspect_fallback_pin", "coord_multiplicity",
]
#: Coordinates so often repeated are suspected to be a default pin; swapped pairs lie in these ranges.
PIN_LIMIT, SWAPPED_LAT, SWAPPED_LON, COARSE_DECIMALS = 8, (77.0, 78.0), (12.0, 14.0), 3


class SchemaError(ValueError):
    """The input lacks what the operators need, or its categories have drifted."""


def check_columns(df: DataFrame, required: list[str] = REQUIRED) -> DataFrame:
    """df itself; SchemaError names missing columns. Further columns are allowed."""
    missing = sorted(set(required) - set(df.columns))
    if missing:
        raise SchemaError(f"missing columns: {', '.join(missing)}")
    return df


def month_first(text: Column) -> Column:
    """Local clock time of M-D-YYYY H:MM or M/D/YYYY H:MM; null for anything else."""
    plain = F.regexp_replace(F.trim(text), "/", "-")
    return F.when(plain.rlike(r"^\d{1,2}-\d{1,2}-\d{4} \d{1,2}:\d{2}$"), F.try_to_timestamp(plain, F.lit("M-d-yyyy H:mm")).cast("timestamp_ntz"))


def check_taxonomy(df: DataFrame, id_col: str, sub_col: str, category_col: str, expected: dict[int, tuple[str, str]]) -> None:
    """SchemaError unless each id that occurs has exactly its (category, sub-category) titles.

    Null sub-titles are ignored if another row has the title; an id with only null sub-titles fails, one with only null
    category titles passes. One small aggregate is collected: a row per expected id.
    """
    found = df.where(F.col(id_col).isin(*expected)).groupBy(id_col).agg(F.slice(F.collect_set(sub_col), 1, 5).alias("subs"), F.slice(F.collect_set(category_col), 1, 5).alias("categories"))
    for row in found.collect():
        category, sub = expected[row[id_col]]
        if set(row["subs"]) != {sub} or not set(row["categories"]) <= {category}:
            raise SchemaError(f"category {row[id_col]} is now {row['categories']} / {row['subs']}")


def surrogate_key(columns: list[str], prefix: str = "rec-") -> Column:
    """prefix and 12 hex digits of the SHA-1 of the columns' texts joined by |, a null as nan."""
    return F.concat(F.lit(prefix), F.substring(F.sha1(F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("nan")) for c in columns])), 1, 12))


def decimals(value: Column) -> Column:
    """Decimal places in the shortest text of a number without closing zeros; 0 for null and NaN."""
    text = value.cast("string")
    return F.coalesce(F.length(F.rtrim(F.try_element_at(F.split(F.substring_index(text, "E", 1), r"\."), F.lit(2)), F.lit("0"))), F.lit(0))


def coordinate_flags(lat: Column, lon: Column) -> dict[str, Column]:
    """Six flags, never null: a null or NaN coordinate is null_coord and out_of_range, and none of the others but coarse."""
    bad = lambda c: c.isNull() | F.isnan(c)
    null = bad(lat) | bad(lon)
    no = lambda c: ~null & F.coalesce(c, F.lit(False))
    return {
        "null_coord": null,
        "out_of_range": null | ~F.coalesce(lat.between(-90, 90) & lon.between(-180, 180), F.lit(False)),
        "zero_zero": no((lat == 0) & (lon == 0)),
        "swapped": no(lat.between(*SWAPPED_LAT) & lon.between(*SWAPPED_LON)),
        "decimals": F.least(F.when(bad(lat), 0).otherwise(decimals(lat)), F.when(bad(lon), 0).otherwise(decimals(lon))),
        "coarse": F.least(F.when(bad(lat), 0).otherwise(decimals(lat)), F.when(bad(lon), 0).otherwise(decimals(lon))) <= COARSE_DECIMALS,
    }


def multiplicity(df: DataFrame, keys: list[str], into: str = "coord_multiplicity") -> DataFrame:
    """df with the number of rows at the same keys, null where a key is null.

    Counts are aggregated before they are joined back, so a hot coordinate's rows aren't gathered in one window.
    """
    there = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])
    counts = stage(df.where(there).groupBy(*[F.col(k).alias(f"__{k}") for k in keys]).agg(F.count(F.lit(1)).alias(into)), "multiplicity")
    found = split_join(df.where(there), counts, {k: f"__{k}" for k in keys}, into).drop(*[f"__{k}" for k in keys])
    return found.unionByName(df.where(~there).withColumn(into, F.lit(None).cast("long")))


def normalise(raw: DataFrame, wards: DataFrame, targets: list[int], key: list[str]) -> DataFrame:
    """Raw complaints as the stored form: time, categories, flags, ward and multiplicity; sensitive columns are gone.

    A missing title is Unknown. valid_coord: in range and neither zero, swapped nor null; usable: valid, inside some ward
    and dated.
    """
    check_columns(raw)
    df = raw.withColumns({
        "request_id": surrogate_key(key), "local_time": month_first(F.col("created_at")),
        "issue_type": F.coalesce("category_title", F.lit("Unknown")), "sub_issue_type": F.coalesce("sub_category_title", F.lit("Unknown")),
        "source_ward_id": F.col("ward_id"), "is_target": F.coalesce(F.col("sub_category_id").isin(*targets), F.lit(False)),
    }).drop("ward_id", "created_at", *SENSITIVE)
    df = df.withColumns(coordinate_flags(F.col("latitude"), F.col("longitude")))
    df = containing_region(df, wards, "latitude", "longitude", "ward_id")
    df = df.withColumn("in_boundary", F.col("ward_id") != -1)
    df = multiplicity(df, ["latitude", "longitude"])
    df = df.withColumn("suspect_fallback_pin", F.coalesce(F.col("coord_multiplicity") >= PIN_LIMIT, F.lit(False)))
    df = df.withColumn("valid_coord", ~(F.col("null_coord") | F.col("out_of_range") | F.col("zero_zero") | F.col("swapped")))
    return df.withColumn("usable", F.col("valid_coord") & F.col("in_boundary") & F.col("local_time").isNotNull())


def coarsened(value: Column, places: int = 3) -> Column:
    """Rounded as numpy does: scaled, to the even neighbour at halves, scaled back."""
    return F.rint(value * F.lit(float(10**places))) / F.lit(float(10**places))


def finite_or_null(df: DataFrame) -> DataFrame:
    """NaN and infinities of all double and float columns as null."""
    return df.withColumns({c: F.when(~F.isnan(c) & (F.abs(F.col(c)) != F.lit(float("inf"))), F.col(c)) for c, kind in df.dtypes if kind in ("double", "float")})


def null_counts(df: DataFrame) -> DataFrame:
    """(column, nulls): one pass over all columns."""
    counts = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns])
    return counts.unpivot([], df.columns, "column", "nulls")


def first_of_copies(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """df with is_repeat (not the first of its keys in order) and has_copy (keys occur more than once)."""
    by = Window.partitionBy(*keys)
    return df.withColumns({"is_repeat": F.row_number().over(by.orderBy(*order)) > 1, "has_copy": F.count(F.lit(1)).over(by) > 1})
