"""Pairs of points within a distance, by a grid of cells sized by the radius.

The earth is cut into latitude bands of the radius's height and each band into cells at least as wide as the radius
reaches there, so partners lie in the same or a neighbouring cell, across the 180th meridian and at the poles too.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hotloom.functions.sphere import band_height, cells_round, degrees_north, haversine, reach
from hotloom.operators.skew import BLOCK, crowded, in_every_block, in_own_block, same, split_join, with_blocks
from hotloom.session import stage


def with_cell(df: DataFrame, radius_m: float) -> DataFrame:
    """Add the point's own cell (__band, __cell) and __half, the degrees of longitude that the radius spans there."""
    df = df.withColumn("__band", F.floor(F.col("lat") / F.lit(band_height(radius_m))).cast("long"))
    df = df.withColumns({"__half": reach(F.col("__band"), radius_m), "__count": cells_round(F.col("__band"), radius_m)})
    return df.withColumn("__cell", F.pmod(F.floor((F.col("lon") + 180.0) * F.col("__count") / 360.0).cast("long"), F.col("__count"))).drop("__count")


def northern_cells(df: DataFrame, radius_m: float) -> DataFrame:
    """Each row of with_cell() once for every cell (__ab, __ac) that may hold partners not south of it."""
    top = F.floor((F.col("lat") + F.lit(degrees_north(radius_m))) / F.lit(band_height(radius_m))).cast("long")
    df = df.withColumn("__ab", F.explode(F.sequence("__band", top)))
    df = df.withColumn("__count", cells_round(F.col("__ab"), radius_m))
    first, last = (F.floor((x + 180.0) * F.col("__count") / 360.0).cast("long") for x in (F.col("lon") - F.col("__half"), F.col("lon") + F.col("__half")))
    df = df.withColumns({"__from": first, "__till": last})
    df = df.withColumn("__ac", F.explode(F.sequence("__from", F.least(F.col("__till"), F.col("__from") + F.col("__count") - 1))))
    return df.withColumn("__ac", F.pmod("__ac", "__count")).drop("__count", "__from", "__till")


def near_pairs(points: DataFrame, keys: list[str], radius_m: float, block: int = BLOCK) -> DataFrame:
    """(keys, lat_a, lon_a, lat_b, lon_b, metres) of all pairs of distinct coordinates of a key at most radius_m apart.

    ``points`` has the keys, lat and lon, each coordinate of a key once; pairs come out once, a before b by latitude,
    then longitude. Points with null, NaN or out-of-range coordinates have no partners. A cell with more points than
    ``block``, whatever its share of all, is cut into blocks, and so are those that look into it: each two blocks meet in
    a key of their own, so no task compares more than the pairs of two blocks. The limit is inclusive.
    """
    inside = points.where(F.col("lat").between(-90, 90) & F.col("lon").between(-180, 180)).select(*keys, "lat", "lon")
    targets = with_cell(inside, radius_m)
    cell = [*keys, "__band", "__cell"]
    crowd = crowded(targets.groupBy(*cell).agg(F.count(F.lit(1)).alias("__n")), "__n", cell, block)
    b = targets.select(*cell, F.col("lat").alias("lat_b"), F.col("lon").alias("lon_b"))
    a = northern_cells(targets, radius_m).select(*keys, F.col("lat").alias("lat_a"), F.col("lon").alias("lon_a"), "__ab", "__ac")
    to = {**{k: k for k in keys}, "__ab": "__band", "__ac": "__cell"}
    if crowd[1]:
        lookers = crowded(a.groupBy(*keys, "__ab", "__ac").agg(F.count(F.lit(1)).alias("__n")), "__n", [*keys, "__ab", "__ac"], block)
        mine = {k: k for k in [*keys, "__ab", "__ac"]}
        a = in_own_block(with_blocks(a, lookers, mine, "__na"), "__na", F.struct("lat_a", "lon_a"), "__row")
        a = in_every_block(with_blocks(a, crowd, to, "__nb"), "__nb", "__column")
        b = in_own_block(with_blocks(b, crowd, {k: k for k in cell}, "__nb"), "__nb", F.struct("lat_b", "lon_b"), "__block")
        b = in_every_block(with_blocks(b, lookers, {**{k: k for k in keys}, "__band": "__ab", "__cell": "__ac"}, "__na"), "__na", "__rows")
    b = b.withColumnsRenamed({k: f"__b_{k}" for k in keys})
    on = same(a, b, {**{k: f"__b_{k}" for k in keys}, "__ab": "__band", "__ac": "__cell"}, nulls_match=True)
    if crowd[1]:
        on = on & (a["__column"] == b["__block"]) & (a["__row"] == b["__rows"])
    later = (a["lat_a"] < b["lat_b"]) | ((a["lat_a"] == b["lat_b"]) & (a["lon_a"] < b["lon_b"]))
    pairs = a.join(b, on & later).select(*keys, "lat_a", "lon_a", "lat_b", "lon_b", haversine(F.col("lat_a"), F.col("lon_a"), F.col("lat_b"), F.col("lon_b")).alias("metres"))
    return pairs.where(F.col("metres") <= radius_m)


def _rows_and_places(rows: DataFrame, keys: list[str], row_id: str, lat: str, lon: str, radius_m: float, block: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    rows = rows.where(F.col(lat).between(-90, 90) & F.col(lon).between(-180, 180))
    rows = rows.select(*keys, F.col(row_id).alias("__id"), (F.col(lat) + 0.0).alias("lat"), (F.col(lon) + 0.0).alias("lon"))
    places = stage(rows.groupBy(*keys, "lat", "lon").agg(F.count(F.lit(1)).alias("__n")), "places")
    return rows, places, stage(near_pairs(places, keys, radius_m, block), "near_places")


def near_classes(rows: DataFrame, keys: list[str], row_id: str, lat: str, lon: str, radius_m: float, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """(pairs, members): what near_rows lists, in a form that stays small at any size. pairs (keys, lat_a, lon_a, lat_b,
    lon_b, metres) are between places, each a class of rows at exactly one coordinate; members (keys, lat, lon, row id,
    copies, links) has each row once with the number of rows at its place, itself counted, and of rows near it elsewhere.

    Rows with null, NaN or out-of-range coordinates are in neither.
    """
    found, places, pairs = _rows_and_places(rows, keys, row_id, lat, lon, radius_m, block)
    both = pairs.select(*keys, F.col("lat_a").alias("lat"), F.col("lon_a").alias("lon"), F.col("lat_b").alias("__olat"), F.col("lon_b").alias("__olon"))
    both = both.unionByName(pairs.select(*keys, F.col("lat_b").alias("lat"), F.col("lon_b").alias("lon"), F.col("lat_a").alias("__olat"), F.col("lon_a").alias("__olon")))
    other = places.select(*keys, F.col("lat").alias("__olat"), F.col("lon").alias("__olon"), F.col("__n").alias("__on"))
    links = _natural(both, other, [*keys, "__olat", "__olon"]).groupBy(*keys, "lat", "lon").agg(F.sum("__on").alias("__links"))
    counts = _natural(places, links, [*keys, "lat", "lon"], "left").select(*[F.col(k).alias(f"__c_{k}") for k in keys], F.col("lat").alias("__lat"), F.col("lon").alias("__lon"), "__n", F.coalesce("__links", F.lit(0)).alias("__links"))
    members = split_join(found, stage(counts, "near_counts"), {**{k: f"__c_{k}" for k in keys}, "lat": "__lat", "lon": "__lon"}, "__n", nulls_match=True)
    return pairs, members.select(*keys, "lat", "lon", F.col("__id").alias(row_id), F.col("__n").alias("copies"), F.col("__links").alias("links"))


def near_rows(rows: DataFrame, keys: list[str], row_id: str, lat: str, lon: str, radius_m: float, block: int = BLOCK) -> DataFrame:
    """(keys, id_lo, id_hi, metres): pairs of rows at most radius_m apart but not at the same coordinate.

    The search runs over distinct coordinates; the pairs found are then expanded to rows. A coordinate with more rows
    than ``block``, whatever its share of all, is cut into blocks, and a pair into units of a block on either side, so
    hot coordinates on one side or both make no large task. Rows with null, NaN or out-of-range coordinates never come
    out. The result grows with the square of the copies; near_classes() gives the same links without that.
    """
    rows, places, pairs = _rows_and_places(rows, keys, row_id, lat, lon, radius_m, block)
    at = [*keys, "lat", "lon"]
    ends = [{**{k: k for k in keys}, f"lat_{s}": "lat", f"lon_{s}": "lon"} for s in "ab"]
    paired = pairs.select(*keys, F.col("lat_a").alias("lat"), F.col("lon_a").alias("lon")).unionByName(pairs.select(*keys, F.col("lat_b").alias("lat"), F.col("lon_b").alias("lon"))).distinct()
    paired = stage(_natural(paired, places, at).select(*[F.col(k).alias(f"__r_{k}") for k in keys], F.col("lat").alias("__lat"), F.col("lon").alias("__lon"), "__n"), "paired_places")
    crowd = crowded(paired.select(*[F.col(f"__r_{k}").alias(k) for k in keys], F.col("__lat").alias("lat"), F.col("__lon").alias("lon"), "__n"), "__n", at, block)
    known = split_join(rows, paired, {**{k: f"__r_{k}" for k in keys}, "lat": "__lat", "lon": "__lon"}, "__n", nulls_match=True).select(*at, "__id")
    known = in_own_block(with_blocks(known, crowd, {c: c for c in at}, "__nb"), "__nb", F.col("__id"), "__salt")
    # a unit is a block of the one side and a block of the other: few rows of each, however hot the coordinates
    units = pairs
    for s, end in zip("ab", ends, strict=True):
        units = in_every_block(with_blocks(units, crowd, end, "__nb"), "__nb", f"block_{s}")
    units = stage(units.withColumn("unit", F.monotonically_increasing_id()), "units")

    def side(s: str) -> DataFrame:
        k = known.select(*[F.col(x).alias(f"__k_{x}") for x in keys], F.col("lat").alias("__klat"), F.col("lon").alias("__klon"), F.col("__id").alias(f"id_{s}"), F.col("__salt"))
        on = (units[f"lat_{s}"] == k["__klat"]) & (units[f"lon_{s}"] == k["__klon"]) & (units[f"block_{s}"] == k["__salt"])
        for x in keys:
            on = on & units[x].eqNullSafe(k[f"__k_{x}"])
        return units.join(k, on).select("unit", f"id_{s}", *[c for c in (*keys, "metres") if s == "a"])

    both = side("a").join(side("b"), "unit")
    return both.select(*keys, F.least("id_a", "id_b").alias("id_lo"), F.greatest("id_a", "id_b").alias("id_hi"), "metres")


def _natural(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """Join in which null keys match; the columns of ``on`` stay once."""
    r = right.select(*[F.col(c).alias(f"__m_{c}") for c in on], *[c for c in right.columns if c not in on])
    cond = F.lit(True)
    for c in on:
        cond = cond & left[c].eqNullSafe(r[f"__m_{c}"])
    return left.join(r, cond, how).drop(*[f"__m_{c}" for c in on])
