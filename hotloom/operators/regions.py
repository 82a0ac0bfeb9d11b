"""The region that contains a point: grid cells as an index, then an exact ray cast over the edges a cell can meet."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hotloom.operators.skew import crowded, in_every_block, in_own_block, with_blocks
from hotloom.session import stage

#: Degrees; and how many edges the index may have to be broadcast, about 20 MB (the regions' own size decides).
CELL_DEG, BROADCAST_EDGES = 0.01, 400_000
#: Points of one cell that a task gets where the index is too large to be broadcast.
POINT_BLOCK = 100_000


def _edges(rings: Column) -> Column:
    """All edges of closed rings as one array of (x1, y1, x2, y2); null rings have none."""
    of = lambda r: F.transform(F.sequence(F.lit(1), F.greatest(F.size(r) - 1, F.lit(1))), lambda i: F.struct(F.try_element_at(r, i)["lon"].alias("x1"), F.try_element_at(r, i)["lat"].alias("y1"), F.try_element_at(r, i + 1)["lon"].alias("x2"), F.try_element_at(r, i + 1)["lat"].alias("y2")))
    return F.filter(F.flatten(F.transform(F.filter(rings, lambda r: F.size(r) > 1), of)), lambda e: e["y1"] != e["y2"])


def region_index(regions: DataFrame, cell_deg: float = CELL_DEG) -> DataFrame:
    """(__gy, __gx, __near): per grid cell the regions whose box meets it, each with those edges that a ray going east
    from a point of the cell can cross. Regions without an id or rings are left out."""
    e = regions.where(F.col("ward_id").isNotNull() & F.col("rings").isNotNull()).select("ward_id", _edges(F.col("rings")).alias("e")).where(F.size("e") > 0)
    ends = lambda a, b: F.concat(F.transform("e", lambda x: x[a]), F.transform("e", lambda x: x[b]))
    grid = lambda c: F.floor(c / F.lit(cell_deg)).cast("long")
    e = e.withColumns({"xs": ends("x1", "x2"), "ys": ends("y1", "y2")})
    e = e.withColumn("__gy", F.explode(F.sequence(grid(F.array_min("ys")), grid(F.array_max("ys")))))
    slack = cell_deg * 1e-6
    low, high = F.col("__gy") * F.lit(cell_deg) - slack, (F.col("__gy") + 1) * F.lit(cell_deg) + slack
    e = e.withColumn("e", F.filter("e", lambda x: (F.least(x["y1"], x["y2"]) <= high) & (F.greatest(x["y1"], x["y2"]) >= low)))
    e = e.withColumn("__gx", F.explode(F.sequence(grid(F.array_min("xs")), grid(F.array_max("xs")))))
    e = e.withColumn("e", F.filter("e", lambda x: F.greatest(x["x1"], x["x2"]) >= F.col("__gx") * F.lit(cell_deg) - slack)).where(F.size("e") > 0)
    return e.groupBy("__gy", "__gx").agg(F.collect_list(F.struct("ward_id", "e")).alias("__near"))


def containing_regions(points: DataFrame, regions: DataFrame, lat: str, lon: str, into: str, cell_deg: float = CELL_DEG) -> DataFrame:
    """``points`` with an array of the ids of all regions that contain them: a ray from the point crosses the edges of
    all rings of a region together an odd number of times. Empty: in none, or a null or NaN coordinate.

    An edge's lower end belongs to it and the upper doesn't, and a point on an edge's line isn't west of it, so adjoining
    regions share no point. Points aren't shuffled while the index is small enough to broadcast; beyond that a cell's points are
    joined in blocks.
    """
    index = stage(region_index(regions, cell_deg), "region_cells")
    edges = index.agg(F.sum(F.aggregate("__near", F.lit(0), lambda n, w: n + F.size(w["e"])))).first()[0] or 0
    x, y = F.col(lon), F.col(lat)
    ok = y.between(-1e6, 1e6) & x.between(-1e6, 1e6)
    grid = lambda c: F.when(ok, F.floor(c / F.lit(cell_deg)).cast("long"))
    crossed = lambda e: ((e["y1"] > y) != (e["y2"] > y)) & (x < (e["x2"] - e["x1"]) * (y - e["y1"]) / (e["y2"] - e["y1"]) + e["x1"])
    inside = F.filter("__near", lambda w: F.size(F.filter(w["e"], crossed)) % 2 == 1)
    df = points.withColumns({"__py": grid(y), "__px": grid(x)})
    if edges <= BROADCAST_EDGES:
        df = df.join(F.broadcast(index), (df["__py"] == index["__gy"]) & (df["__px"] == index["__gx"]), "left")
    else:
        # a crowded cell's points are spread over blocks, and its edges go to each
        counts = df.where(ok).groupBy(F.col("__py").alias("__gy"), F.col("__px").alias("__gx")).agg(F.count(F.lit(1)).alias("__n"))
        crowd = crowded(counts, "__n", ["__gy", "__gx"], POINT_BLOCK)
        index = in_every_block(with_blocks(index, crowd, {"__gy": "__gy", "__gx": "__gx"}, "__nb"), "__nb", "__ib")
        df = in_own_block(with_blocks(df, crowd, {"__py": "__gy", "__px": "__gx"}, "__nb"), "__nb", F.monotonically_increasing_id(), "__pb")
        df = df.join(index, (df["__py"] == index["__gy"]) & (df["__px"] == index["__gx"]) & (df["__pb"] == index["__ib"]), "left").drop("__pb", "__ib")
    return df.withColumn(into, F.coalesce(F.transform(inside, lambda w: w["ward_id"]), F.array())).drop("__py", "__px", "__gy", "__gx", "__near")


def containing_region(points: DataFrame, regions: DataFrame, lat: str, lon: str, into: str, cell_deg: float = CELL_DEG) -> DataFrame:
    """``points`` with the id of the region that contains them; -1: in none, or a null or NaN coordinate. In several: the
    greatest id, see containing_regions for all."""
    df = containing_regions(points, regions, lat, lon, into, cell_deg)
    return df.withColumn(into, F.coalesce(F.array_max(into), F.lit(-1)))
