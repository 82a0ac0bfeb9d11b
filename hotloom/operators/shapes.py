"""Centres, areas and outlines of groups of points and of polygons."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hotloom.functions.planar import to_latlon, to_utm
from hotloom.functions.sphere import haversine
from hotloom.operators.components import components
from hotloom.operators.ranking import with_rank
from hotloom.session import stage


def centres(df: DataFrame, by: list[str], lat: str = "lat", lon: str = "lon") -> DataFrame:
    """(by, centre_lat, centre_lon): the mean in projected metres, projected back. Points with nulls don't count."""
    x, y = to_utm(lat, lon)
    g = df.where(F.col(lat).isNotNull() & F.col(lon).isNotNull()).withColumns({"__x": x, "__y": y}).groupBy(*by).agg(F.avg("__x").alias("__x"), F.avg("__y").alias("__y"))
    a, b = to_latlon("__x", "__y")
    return g.select(*by, a.alias("centre_lat"), b.alias("centre_lon"))


def radii(df: DataFrame, centre: DataFrame, by: list[str], lat: str = "lat", lon: str = "lon") -> DataFrame:
    """(by, radius_m): the greatest distance of a group's points from its centre."""
    return df.join(centre, by).groupBy(*by).agg(F.max(haversine(F.col(lat), F.col(lon), F.col("centre_lat"), F.col("centre_lon"))).alias("radius_m"))


def polygon_areas(regions: DataFrame) -> DataFrame:
    """(ward_id, area_km2): planar area in projected metres by the shoelace formula.

    The rings of a region are combined by parity, as containment is: a ring that lies in an odd number of others of the
    region is a hole and its area is taken off. Null rings give null.
    """
    ring = regions.select("ward_id", F.posexplode_outer("rings").alias("r", "ring"))
    points = ring.select("ward_id", "r", "ring", F.posexplode_outer("ring").alias("i", "p")).select("ward_id", "r", "ring", "i", F.col("p.lat").alias("lat"), F.col("p.lon").alias("lon"))
    x, y = to_utm("lat", "lon")
    flat = points.select("ward_id", "r", "i", x.alias("x"), y.alias("y")).groupBy("ward_id", "r").agg(F.array_sort(F.collect_list(F.struct("i", "x", "y"))).alias("v"))
    terms = F.transform(F.sequence(F.lit(1), F.size("v") - 1), lambda k: F.element_at("v", k)["x"] * F.element_at("v", k + 1)["y"] - F.element_at("v", k + 1)["x"] * F.element_at("v", k)["y"])
    area = F.when(F.size("v") > 2, F.abs(F.aggregate(terms, F.lit(0.0), lambda a, t: a + t)) / 2e6)
    sized = flat.select("ward_id", "r", area.alias("a"))
    other = ring.select(F.col("ward_id").alias("__w"), F.col("r").alias("__r"), F.col("ring").alias("__ring"))
    pairs = ring.select("ward_id", "r", F.col("ring")[0].alias("p")).join(other, (F.col("ward_id") == F.col("__w")) & (F.col("r") != F.col("__r")), "left")
    crossed = lambda k: ((F.element_at("__ring", k)["lat"] > F.col("p.lat")) != (F.element_at("__ring", k + 1)["lat"] > F.col("p.lat"))) & (F.col("p.lon") < (F.element_at("__ring", k + 1)["lon"] - F.element_at("__ring", k)["lon"]) * (F.col("p.lat") - F.element_at("__ring", k)["lat"]) / F.nullif(F.element_at("__ring", k + 1)["lat"] - F.element_at("__ring", k)["lat"], F.lit(0.0)) + F.element_at("__ring", k)["lon"])
    inside = F.size(F.filter(F.sequence(F.lit(1), F.size("__ring") - 1), lambda k: F.coalesce(crossed(k), F.lit(False)))) % 2
    depth = pairs.groupBy("ward_id", "r").agg(F.sum(F.when(F.col("__r").isNotNull(), inside).otherwise(0)).alias("d"))
    return sized.join(depth, ["ward_id", "r"]).groupBy("ward_id").agg(F.sum(F.when(F.col("d") % 2 == 1, -F.col("a")).otherwise(F.col("a"))).alias("area_km2"))


def grid_cells(df: DataFrame, metres: float = 250.0, lat: str = "lat", lon: str = "lon") -> DataFrame:
    """(gx, gy, points, clustered, noise, cell_lat, cell_lon): counts per square cell of projected metres, its middle
    coarsened to 4 places. ``df`` has a boolean column clustered, null as false."""
    x, y = to_utm(lat, lon)
    step = F.lit(metres)
    g = df.where(F.col(lat).isNotNull() & F.col(lon).isNotNull()).withColumns({"gx": F.floor(x / step).cast("long"), "gy": F.floor(y / step).cast("long")})
    hit = F.coalesce("clustered", F.lit(False))
    g = g.groupBy("gx", "gy").agg(F.count(F.lit(1)).alias("points"), F.count_if(hit).alias("clustered"), F.count_if(~hit).alias("noise"))
    g = g.withColumns({"__x": (F.col("gx") + 0.5) * step, "__y": (F.col("gy") + 0.5) * step})
    a, b = to_latlon("__x", "__y")
    return g.withColumns({"cell_lat": F.rint(a * 10000) / 10000, "cell_lon": F.rint(b * 10000) / 10000}).drop("__x", "__y")


def hull(points: np.ndarray) -> np.ndarray:
    """Corners of the convex hull counter-clockwise (Andrew's monotone chain); one or two points stay as they are."""
    p = np.unique(points, axis=0)
    if len(p) < 3:
        return p

    def half(seq: np.ndarray) -> list[np.ndarray]:
        out: list[np.ndarray] = []
        for q in seq:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (q[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (q[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(q)
        return out[:-1]

    return np.array(half(p) + half(p[::-1]))


def area(corners: np.ndarray) -> float:
    if len(corners) < 3:
        return 0.0
    x, y = corners[:, 0], corners[:, 1]
    return float(abs(np.dot(x, np.roll(y, -1)) - np.dot(y, np.roll(x, -1))) / 2)


def buffered(corners: np.ndarray, metres: float, arc: int = 16) -> np.ndarray:
    """Outline of all points within ``metres`` of a convex polygon, line or point; ``arc`` steps a quarter turn, closed."""
    turn = np.linspace(0, 2 * math.pi, 4 * arc, endpoint=False)
    disc = np.stack([np.cos(turn), np.sin(turn)], axis=1) * metres
    ring = hull((corners[:, None, :] + disc[None, :, :]).reshape(-1, 2))
    return np.vstack([ring, ring[:1]])


def hulls(df: DataFrame, by: str) -> DataFrame:
    """(by, outer, points): the corners of each group's convex hull as structs x, y in projected metres, and its number
    of rows. Points with nulls don't count.

    Each batch gives the hull of each group in it, and the hull of those hulls is the group's: a corner of the whole is
    one of its part, too. A task gets a group's partial corners, not its rows.
    """
    x, y = to_utm("lat", "lon")
    kind = df.schema[by].dataType.simpleString()
    xy = df.where(F.col("lat").isNotNull() & F.col("lon").isNotNull()).select(F.col(by).alias("__by"), x.alias("x"), y.alias("y"))
    corners = "array<struct<x double, y double>>"

    def parts(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            rows = [(key, [(float(a), float(b)) for a, b in hull(g[["x", "y"]].to_numpy())], len(g)) for key, g in pdf.groupby("__by", dropna=False)]
            yield pd.DataFrame(rows, columns=["__by", "part", "n"])

    @F.pandas_udf(corners)
    def whole(outer: pd.Series) -> pd.Series:
        return pd.Series([[{"x": float(a), "y": float(b)} for a, b in hull(np.array([[p["x"], p["y"]] for p in points], dtype=float))] for points in outer])

    got = xy.mapInPandas(parts, f"__by {kind}, part {corners}, n long")
    g = got.groupBy("__by").agg(F.flatten(F.collect_list("part")).alias("outer"), F.sum("n").alias("points"))
    return g.select(F.col("__by").alias(by), whole("outer").alias("outer"), "points")


def outlines(df: DataFrame, by: str, buffer_m: float = 50.0) -> DataFrame:
    """(by, points, hull_km2, buffered_km2, outline): hull area and the closed outline buffer_m around it in projected
    metres, as arrays [x, y]. Groups of one place or of places on a line have hull area 0."""

    @F.pandas_udf("struct<hull_km2 double, buffered_km2 double, outline array<array<double>>>")
    def outline(outer: pd.Series) -> pd.DataFrame:
        rows = []
        for points in outer:
            corners = np.array([[p["x"], p["y"]] for p in points], dtype=float)
            ring = buffered(corners, buffer_m)
            rows.append((area(corners) / 1e6, area(ring[:-1]) / 1e6, ring.tolist()))
        return pd.DataFrame(rows, columns=["hull_km2", "buffered_km2", "outline"])

    return hulls(df, by).withColumn("o", outline("outer")).select(by, "points", "o.hull_km2", "o.buffered_km2", "o.outline")


def union_area(polygons: list[np.ndarray]) -> float:
    """Exact area of the union of convex polygons: between neighbouring corners and crossings of edges each polygon is one
    interval with straight ends, so a strip's area is its width times the intervals' joint length in its middle."""
    edges = [(np.column_stack([p, np.roll(p, -1, axis=0)])) for p in polygons]
    xs = [p[:, 0] for p in polygons]
    for i in range(len(polygons)):
        for j in range(i + 1, len(polygons)):
            a, b = edges[i][:, None, :], edges[j][None, :, :]
            dx, dy, ex, ey = a[..., 2] - a[..., 0], a[..., 3] - a[..., 1], b[..., 2] - b[..., 0], b[..., 3] - b[..., 1]
            turn = dx * ey - dy * ex
            with np.errstate(divide="ignore", invalid="ignore"):
                t = ((b[..., 0] - a[..., 0]) * ey - (b[..., 1] - a[..., 1]) * ex) / turn
                u = ((b[..., 0] - a[..., 0]) * dy - (b[..., 1] - a[..., 1]) * dx) / turn
                hit = (t >= 0) & (t <= 1) & (u >= 0) & (u <= 1)
                xs.append((a[..., 0] + t * dx)[hit])
    cuts = np.unique(np.concatenate(xs))
    total = 0.0
    for left, right in zip(cuts[:-1], cuts[1:], strict=True):
        mid, spans = (left + right) / 2, []
        for e in edges:
            at = e[(np.minimum(e[:, 0], e[:, 2]) < mid) & (np.maximum(e[:, 0], e[:, 2]) > mid)]
            if len(at) >= 2:
                y = at[:, 1] + (mid - at[:, 0]) / (at[:, 2] - at[:, 0]) * (at[:, 3] - at[:, 1])
                spans.append((y.min(), y.max()))
        upto = -math.inf
        for low, high in sorted(spans):
            total += (right - left) * max(0.0, high - max(low, upto))
            upto = max(upto, high)
    return total


def dissolved_area(outlines: DataFrame, by: str, cell_m: float = 1_000.0) -> DataFrame:
    """(area_km2): the area that outlines (closed convex rings of [x, y] in metres) cover together, 0 for none.

    Outlines whose boxes meet are found by cells and joined to groups, and each group is dissolved by itself.
    """
    o = stage(with_rank(outlines.select(by, "outline"), [by], "node").select(F.col("node").cast("long").alias("node"), "outline"), "dissolve")
    ends = {"x0": F.array_min(F.transform("outline", lambda p: p[0])), "x1": F.array_max(F.transform("outline", lambda p: p[0])), "y0": F.array_min(F.transform("outline", lambda p: p[1])), "y1": F.array_max(F.transform("outline", lambda p: p[1]))}
    box = o.select("node", *[v.alias(k) for k, v in ends.items()])
    cell = lambda c: F.floor(F.col(c) / F.lit(cell_m)).cast("long")
    at = box.withColumn("gx", F.explode(F.sequence(cell("x0"), cell("x1")))).withColumn("gy", F.explode(F.sequence(cell("y0"), cell("y1"))))
    other = at.select("gx", "gy", F.col("node").alias("b"), *[F.col(c).alias(f"b{c}") for c in ends])
    meet = (F.col("x0") <= F.col("bx1")) & (F.col("bx0") <= F.col("x1")) & (F.col("y0") <= F.col("by1")) & (F.col("by0") <= F.col("y1"))
    links = at.join(other, ["gx", "gy"]).where(meet & (F.col("node") < F.col("b"))).select(F.col("node").alias("a"), "b").distinct()
    roots = components(o.select("node"), links)

    def dissolve(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"area_km2": [union_area([np.array([list(p) for p in ring], dtype=float)[:-1] for ring in pdf["outline"]]) / 1e6]})

    each = o.join(roots, "node").groupBy("root").applyInPandas(dissolve, "area_km2 double")
    return each.agg(F.coalesce(F.sum("area_km2"), F.lit(0.0)).alias("area_km2"))


def simplified(ring: np.ndarray, tolerance: float) -> np.ndarray:
    """A closed ring with fewer points, none further than ``tolerance`` from the old outline (Douglas and Peucker 1973).
    At least a triangle stays."""
    keep = np.zeros(len(ring), bool)
    far = int(np.argmax(np.hypot(*(ring - ring[0]).T)))
    keep[[0, far, len(ring) - 1]] = True
    todo = [(0, far), (far, len(ring) - 1)]
    while todo:
        a, b = todo.pop()
        if b - a < 2:
            continue
        d, rel = ring[b] - ring[a], ring[a + 1 : b] - ring[a]
        length = math.hypot(*d)
        off = np.abs(d[0] * rel[:, 1] - d[1] * rel[:, 0]) / length if length else np.hypot(*rel.T)
        k = int(np.argmax(off))
        if off[k] > tolerance:
            keep[a + 1 + k] = True
            todo += [(a, a + 1 + k), (a + 1 + k, b)]
    out = ring[keep]
    return out if len(out) >= 4 else ring


def simplify_regions(regions: DataFrame, tolerance: float = 0.0003) -> DataFrame:
    """regions, unique in ward_id, with each ring simplified; null rings stay null."""

    @F.pandas_udf("array<struct<lon double, lat double>>")
    def simplify(ring: pd.Series) -> pd.Series:
        flat = [simplified(np.array([[p["lon"], p["lat"]] for p in r], dtype=float), tolerance) for r in ring]
        return pd.Series([[{"lon": float(x), "lat": float(y)} for x, y in r] for r in flat])

    each = regions.select(F.col("ward_id").alias("__id"), F.posexplode("rings").alias("i", "ring")).where(F.size("ring") > 0).withColumn("ring", simplify("ring"))
    rings = each.groupBy("__id").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "ring"))), lambda r: r["ring"]).alias("rings"))
    return regions.drop("rings").join(rings, F.col("ward_id") == F.col("__id"), "left").drop("__id")
