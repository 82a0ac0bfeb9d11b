"""Density clusters of points (DBSCAN), for several radii and least numbers in one go.

Places, the distinct coordinates of a group, are put into cells whose diagonal is the group's radius, so all places of a
cell are mutually near and a crowded cell costs one node instead of a quadratic number of pairs. How dense a place is
and how dense a link between two cells is doesn't depend on the least number asked for, so one search serves all.

Places have a group (a run, a radius), lat, lon, the number of points w, their smallest id rid (unique over all groups,
from 0 to 2^59) and the group's radius eps in metres.
"""

from __future__ import annotations

import math
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hotloom.functions.sphere import EARTH_M, haversine
from hotloom.operators.components import components
from hotloom.operators.gathered import gathered
from hotloom.operators.ranking import with_rank
from hotloom.operators.skew import block_join, crowded, split_join
from hotloom.session import stage

GROUP = "grp"
CELL = [GROUP, "band", "cell"]


def _cells_round(band: Column, height: Column) -> Column:
    """Cells of a band, each no wider than the band's height even at the edge next to the equator."""
    edge = F.greatest(band, -band - 1, F.lit(0)) * height
    return F.greatest(F.ceil(F.lit(360.0) / height * F.cos(F.radians(F.least(edge, F.lit(90.0))))), F.lit(1)).cast("long")


def celled(places: DataFrame) -> DataFrame:
    """Add band, cell: any two places of a group with the same are at most eps apart. Also height, a band's in degrees,
    and half, the degrees of longitude that eps can span there or in the two bands on either side."""
    places = places.withColumn("height", F.degrees(F.col("eps") / F.lit(math.sqrt(2) * EARTH_M)) * F.lit(1 - 1e-6))
    places = places.withColumn("band", F.floor(F.col("lat") / F.col("height")).cast("long"))
    far = F.least(F.greatest(F.abs(F.col("band") - 2), F.abs(F.col("band") + 3)) * F.col("height"), F.lit(90.0))
    ratio = F.sin(F.col("eps") / F.lit(2 * EARTH_M)) * F.lit(1 + 1e-9) / F.greatest(F.cos(F.radians(far)), F.lit(1e-12))
    places = places.withColumn("half", F.when(ratio >= 1, F.lit(180.0)).otherwise(F.degrees(F.asin(F.least(ratio, F.lit(1.0)))) * 2))
    count = _cells_round(F.col("band"), F.col("height"))
    return places.withColumn("cell", F.pmod(F.floor((F.col("lon") + 180.0) * count / 360.0).cast("long"), count))


def to_cells(df: DataFrame, low: str, high: str, steps: range) -> DataFrame:
    """Each row once for every cell (to_band, to_cell) of bands at ``steps`` that can hold points within eps of its
    longitudes low to high."""
    df = df.withColumn("to_band", F.explode(F.array(*[F.col("band") + s for s in steps])))
    df = df.withColumn("__count", _cells_round(F.col("to_band"), F.col("height")))
    first, last = (F.floor((x + 180.0) * F.col("__count") / 360.0).cast("long") for x in (F.col(low) - F.col("half"), F.col(high) + F.col("half")))
    df = df.withColumns({"__first": first, "__last": last})
    df = df.withColumn("__at", F.explode(F.sequence("__first", F.least(F.col("__last"), F.col("__first") + F.col("__count") - 1))))
    return df.withColumn("to_cell", F.pmod("__at", "__count")).drop("__count", "__first", "__last", "__at")


def natural_join(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """Join on columns of the same names, null groups matching each other; the keys stay once."""
    named = {c: f"__j_{c}" for c in on}
    r = right.withColumnsRenamed(named)
    cond = F.lit(True)
    for c, d in named.items():
        cond = cond & (left[c].eqNullSafe(r[d]) if c == GROUP else left[c] == r[d])
    return left.join(r, cond, how).drop(*named.values())


def unit_vector(lat: Column, lon: Column) -> list[Column]:
    a, b = F.radians(lat), F.radians(lon)
    return [F.cos(a) * F.cos(b), F.cos(a) * F.sin(b), F.sin(a)]


def looking(lookers: DataFrame, places: DataFrame, crowd: tuple[DataFrame, int], carry: list[str]) -> DataFrame:
    """places within eps of a looker, with the looker's id ``by``, its columns ``carry`` and the metres between.

    ``crowd`` is crowded() of the places' cells: of such a cell each task gets a block.
    """
    look = to_cells(lookers, "lon", "lon", range(-2, 3))
    look = look.select(F.col(GROUP).alias("__grp"), F.col("rid").alias("by"), F.col("lat").alias("__lat"), F.col("lon").alias("__lon"), *carry, F.col("to_band").alias("__to_band"), F.col("to_cell").alias("__to_cell"))
    places = places.drop(*carry)
    met = block_join(look, places, {"__grp": GROUP, "__to_band": "band", "__to_cell": "cell"}, crowd, {c: c for c in CELL}, F.col("rid"))
    met = met.withColumn("metres", haversine(F.col("__lat"), F.col("__lon"), F.col("lat"), F.col("lon")))
    return met.where(F.col("metres") <= F.col("eps")).drop("__grp", "__lat", "__lon", "__to_band", "__to_cell")


def graded_places(places: DataFrame, levels: list[int]) -> tuple[DataFrame, DataFrame]:
    """(graded, cells), staged: places with band, cell and level, the greatest of ``levels`` that the points within eps
    (their own counted) reach, 0 for none; and each cell's number of places __n.

    ``places`` has each coordinate of a group once. In a cell with as many points as the greatest level all places have
    that; only those of other cells, which are few in each, look around.
    """
    levels = sorted(levels)
    places = stage(celled(places), "places")
    cells = stage(places.groupBy(*[F.col(k).alias(f"__{k}") for k in CELL]).agg(F.sum("w").alias("cw"), F.count(F.lit(1)).alias("__n")), "cells")
    crowd = crowded(cells.select(*[F.col(f"__{k}").alias(k) for k in CELL], "__n"), "__n", CELL)
    known = split_join(places, cells, {k: f"__{k}" for k in CELL}, "__n", nulls_match=True).select(*places.columns, "cw")
    known = stage(known, "weighed")
    sparse = known.where(F.col("cw") < levels[-1])
    near = looking(sparse, places, crowd, []).groupBy("by").agg(F.sum("w").alias("nw"))
    level = F.lit(0)
    for k in levels:
        level = F.when(F.col("nw") >= k, F.lit(k)).otherwise(level)
    seen = sparse.join(near, F.col("rid") == F.col("by")).select(*places.columns, level.alias("level"))
    graded = known.where(F.col("cw") >= levels[-1]).select(*places.columns, F.lit(levels[-1]).alias("level")).unionByName(seen)
    return stage(graded, "graded"), cells


def cell_nodes(dense: DataFrame) -> DataFrame:
    """One node per cell with dense places: node (its smallest id), w, places, its greatest level, and its four outermost
    places with their levels."""
    at = F.struct("lat", "lon", "level")
    outer = [F.min_by(at, "lat").alias("p0"), F.max_by(at, "lat").alias("p1"), F.min_by(at, "lon").alias("p2"), F.max_by(at, "lon").alias("p3")]
    return dense.groupBy(GROUP, "eps", "height", "half", "band", "cell").agg(F.min("rid").cast("long").alias("node"), F.sum("w").alias("w"), F.count(F.lit(1)).alias("places"), F.max("level").alias("top"), *outer)


def cell_links(dense: DataFrame, nodes: DataFrame) -> DataFrame:
    """(a, b, level) with a < b: nodes of which some two dense places are at most eps apart, and the greatest level that
    two such places have both.

    Most are settled by the nodes' outermost places; for the rest, only places that are dense enough to raise the level
    and that the other node's box lets be near are compared, a block of the one cell with one of the other.
    """
    a = to_cells(nodes.withColumns({"__west": F.col("p2.lon"), "__east": F.col("p3.lon")}), "__west", "__east", range(3))
    a = a.select(GROUP, "eps", F.col("node").alias("a"), F.col("band").alias("ab"), F.col("cell").alias("ac"), F.col("top").alias("ta"), *[F.col(f"p{i}").alias(f"a{i}") for i in range(4)], F.col("to_band").alias("band"), F.col("to_cell").alias("cell"))
    pairs = natural_join(a, nodes.select(GROUP, "band", "cell", F.col("node").alias("b"), F.col("top").alias("tb"), *[F.col(f"p{i}").alias(f"b{i}") for i in range(4)]), CELL)
    pairs = pairs.where((F.col("ab") < F.col("band")) | (F.col("ac") != F.col("cell"))).where(F.col("a") != F.col("b"))
    limit = F.pow(2 * F.sin(F.col("eps") / F.lit(2 * EARTH_M)), 2) * (1 - 1e-6)
    vec = {}
    for s, i in product("ab", range(4)):
        for k, v in enumerate(unit_vector(F.col(f"{s}{i}.lat"), F.col(f"{s}{i}.lon"))):
            vec[f"{s}{i}{'xyz'[k]}"] = v
    pairs = pairs.withColumns(vec)
    gap = lambda i, j: sum(((F.col(f"a{i}{c}") - F.col(f"b{j}{c}")) * (F.col(f"a{i}{c}") - F.col(f"b{j}{c}")) for c in "xyz"), F.lit(0.0))
    sure = F.array_max(F.array(*[F.when(gap(i, j) <= limit, F.least(F.col(f"a{i}.level"), F.col(f"b{j}.level"))).otherwise(0) for i, j in product(range(4), range(4))]))
    pairs = pairs.withColumn("__sure", sure).drop(*vec).withColumn("__most", F.least("ta", "tb"))
    pairs = stage(pairs.withColumn("__pair", F.monotonically_increasing_id()), "cell_pairs")
    known = pairs.where("__sure > 0").select("a", "b", F.col("__sure").alias("level"))
    open_ = pairs.where(F.col("__sure") < F.col("__most"))
    crowd = crowded(nodes.select(*CELL, F.col("places").alias("__n")), "__n", CELL)
    p = dense.select(F.col(GROUP).alias("__run"), F.col("band").alias("__b"), F.col("cell").alias("__c"), F.col("lat").alias("__plat"), F.col("lon").alias("__plon"), F.col("level").alias("__level"), F.col("rid").alias("__rid"))

    def near(s: str, o: str) -> DataFrame:
        """Places of side s from which the other side's box may be in reach."""
        band, cell = ("ab", "ac") if s == "a" else ("band", "cell")
        q = block_join(open_, p, {GROUP: "__run", band: "__b", cell: "__c"}, crowd, {"__run": GROUP, "__b": "band", "__c": "cell"}, F.col("__rid"))
        lat = F.least(F.greatest(F.col("__plat"), F.col(f"{o}0.lat")), F.col(f"{o}1.lat"))
        # the nearest longitude of the box; across the 180th meridian the box is taken as it is, which only keeps more
        lon = F.least(F.greatest(F.col("__plon"), F.col(f"{o}2.lon")), F.col(f"{o}3.lon"))
        wraps = F.abs(F.col("__plon") - lon) > 180
        reach = haversine(F.col("__plat"), F.col("__plon"), lat, lon) <= F.col("eps") * 1.01
        q = q.where((wraps | reach) & (F.col("__level") > F.col("__sure")))
        return q.select(F.col("__pair").alias(f"pair_{s}"), *["a", "b", "eps"] * (s == "a"), F.col("__plat").alias(f"lat_{s}"), F.col("__plon").alias(f"lon_{s}"), F.col("__level").alias(f"level_{s}"))

    left, right = near("a", "b"), near("b", "a")
    if crowd[1]:
        # two crowded cells: a block of places of the one meets a block of the other
        left, right = stage(left, "near_a"), stage(right, "near_b")
        many = crowded(right.groupBy("pair_b").agg(F.count(F.lit(1)).alias("__n")), "__n", ["pair_b"])
        both = block_join(left, right, {"pair_a": "pair_b"}, many, {"pair_b": "pair_b"}, F.struct("lat_b", "lon_b"))
    else:
        both = left.join(right, left["pair_a"] == right["pair_b"])
    found = both.where(haversine(F.col("lat_a"), F.col("lon_a"), F.col("lat_b"), F.col("lon_b")) <= F.col("eps")).select("a", "b", F.least("level_a", "level_b").alias("level"))
    return known.unionByName(found).groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.max("level").alias("level"))


def clusters_by_level(places: DataFrame, levels: list[int]) -> DataFrame:
    """(rid, label_<k> for each k of ``levels``) of the places (unique coordinates of their groups, in range): clusters of
    a group and level are numbered from 0 by their smallest dense id; a place that isn't dense takes the smallest number
    among dense places within eps, or -1. Each place comes once."""
    levels = sorted(levels)
    graded, cells = graded_places(places, levels)
    dense = graded.where("level > 0")
    nodes = stage(cell_nodes(dense), "nodes")
    links = stage(cell_links(dense, nodes), "cell_links")
    # a node or link stands for itself at each level it reaches
    number = {k: i for i, k in enumerate(levels)}
    at_level = lambda top: F.explode(F.filter(F.array(*[F.lit(k) for k in levels]), lambda k: k <= F.col(top)))
    slot = F.create_map(*[x for k, i in number.items() for x in (F.lit(k), F.lit(i))])
    coded = lambda c: F.col(c) * F.lit(len(levels)) + slot[F.col("k")]
    graph = nodes.select("node", at_level("top").alias("k")).select(coded("node").alias("node"))
    edges = links.select("a", "b", at_level("level").alias("k")).select(coded("a").alias("a"), coded("b").alias("b"))
    roots = components(graph, edges)
    first = dense.groupBy(*CELL).agg(*[F.min(F.when(F.col("level") >= k, F.col("rid"))).alias(f"first_{k}") for k in levels])
    firsts = natural_join(nodes.select(*CELL, "node"), first, CELL)
    firsts = firsts.select(GROUP, F.col("node").alias("cell_node"), F.inline(F.filter(F.array(*[F.struct(F.lit(k).alias("k"), F.col(f"first_{k}").alias("first")) for k in levels]), lambda x: x["first"].isNotNull())))
    named = stage(firsts.withColumn("__code", coded("cell_node")).join(roots, F.col("__code") == F.col("node")).select(GROUP, "cell_node", "k", "first", "root"), "level_nodes")
    heads = named.groupBy(GROUP, "k", "root").agg(F.min("first").alias("first"))
    ranked = with_rank(heads, [GROUP, "k", "first"], "at")
    start = ranked.groupBy(F.col(GROUP).alias("__g"), F.col("k").alias("__k")).agg(F.min("at").alias("__at"))
    ranked = ranked.join(start, ranked[GROUP].eqNullSafe(start["__g"]) & (F.col("k") == F.col("__k"))).select(F.col("root").alias("__root"), (F.col("at") - F.col("__at")).cast("int").alias("label"))
    labels = named.join(ranked, F.col("root") == F.col("__root")).select("cell_node", *[F.when(F.col("k") == k, F.col("label")).alias(f"l{k}") for k in levels])
    labels = stage(labels.groupBy("cell_node").agg(*[F.max(f"l{k}").alias(f"l{k}") for k in levels]), "node_labels")
    of_cell = stage(nodes.select(*[F.col(c).alias(f"__{c}") for c in CELL], "node", "places").join(labels, F.col("node") == F.col("cell_node")).drop("cell_node"), "cell_labels")
    marked = stage(split_join(dense, of_cell, {c: f"__{c}" for c in CELL}, "places", nulls_match=True).select(*dense.columns, *[F.when(F.col("level") >= k, F.col(f"l{k}")).alias(f"l{k}") for k in levels]), "marked")
    crowd = crowded(cells.select(*[F.col(f"__{k}").alias(k) for k in CELL], "__n"), "__n", CELL)
    edge_of = looking(graded.where(F.col("level") < levels[-1]).withColumnRenamed("level", "own"), marked, crowd, ["own"])
    border = edge_of.where(F.col("level") > F.col("own")).groupBy("by").agg(*[F.min(F.when(F.col("own") < k, F.col(f"l{k}"))).alias(f"e{k}") for k in levels])
    core = marked.select(F.col("rid").alias("__rid"), *[f"l{k}" for k in levels])
    out = graded.select("rid").join(core, F.col("rid") == F.col("__rid"), "left").join(border, F.col("rid") == F.col("by"), "left")
    return out.select("rid", *[F.coalesce(f"l{k}", f"e{k}", F.lit(-1)).alias(f"label_{k}") for k in levels])


def in_range(points: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Points with coordinates that a place can have, -0.0 as 0.0, and the others."""
    ok = F.col("lat").between(-90, 90) & F.col("lon").between(-180, 180)
    return points.where(ok).withColumns({"lat": F.col("lat") + 0.0, "lon": F.col("lon") + 0.0}), points.where(~F.coalesce(ok, F.lit(False)))


def by_configuration(wide: DataFrame, eps: list[float], levels: list[int]) -> DataFrame:
    """A row of gathered() as one for each radius and least number, with its label."""
    each = [(float(e), k) for e in sorted(eps) for k in sorted(levels)]
    keys = [F.array(*[F.lit(c[i]) for c in each])[F.col("__i")] for i in (0, 1)]
    rows = wide.select(*[c for c in wide.columns if c != "labels"], F.posexplode("labels").alias("__i", "label"))
    return rows.withColumns({"eps": keys[0], "least": keys[1]}).drop("__i")


def dbscan(points: DataFrame, eps: list[float], levels: list[int]) -> DataFrame:
    """(grp, eps, least, pid, label): density clusters as the sequential algorithm labels them, for every radius of
    ``eps`` and every least number of ``levels``.

    ``points`` has grp, pid (a whole number from 0 to 2^40, unique in its group), lat and lon. Clusters of a group are
    numbered from 0 by their smallest dense pid; a point that isn't dense takes the smallest number among dense points
    within eps, or -1. Points with null, NaN or out-of-range coordinates are noise; eps is inclusive; copies of a point
    count each. Groups times radii are few. Groups that fit a task are labelled by one each, others are distributed.
    """
    radii = F.explode(F.array(*[F.lit(float(e)) for e in eps]))
    there, bad = in_range(points)
    noise = bad.select(GROUP, radii.alias("eps"), "pid").select("*", F.explode(F.array(*[F.lit(k) for k in levels])).alias("least"), F.lit(-1).alias("label"))
    wide = gathered(there, eps, levels)
    if wide is not None:
        return by_configuration(wide.select(GROUP, "pid", "labels"), eps, levels).select(GROUP, "eps", "least", "pid", "label").unionByName(noise.select(GROUP, "eps", "least", "pid", "label"))
    at = there.groupBy(GROUP, "lat", "lon").agg(F.count(F.lit(1)).alias("w"), F.min("pid").cast("long").alias("first"))
    at = stage(at.withColumn("eps", radii), "spots")
    # ids that are unique over groups and radii and keep the order of pid within each
    groups = with_rank(at.select(F.col(GROUP).alias("__g"), F.col("eps").alias("__e")).distinct(), ["__g", "__e"], "__number")
    at = at.join(F.broadcast(groups), at[GROUP].eqNullSafe(groups["__g"]) & (at["eps"] == groups["__e"]))
    at = stage(at.select(F.col(GROUP).alias("__own"), F.col("__number").cast("long").alias(GROUP), "lat", "lon", "w", "eps", (F.col("__number") * F.lit(1 << 40) + F.col("first")).alias("rid")), "spots")
    found = clusters_by_level(at.drop("__own"), levels)
    named = at.select(F.col("rid").alias("__rid"), "__own", F.col("lat").alias("__lat"), F.col("lon").alias("__lon"), F.col("eps").alias("__eps"), "w").join(found, F.col("__rid") == F.col("rid"))
    named = named.groupBy("__own", "__lat", "__lon").agg(F.max("w").alias("__w"), F.collect_list(F.struct("__eps", *[f"label_{k}" for k in levels])).alias("__labels"))
    rows = split_join(there, stage(named, "spot_labels"), {GROUP: "__own", "lat": "__lat", "lon": "__lon"}, "__w", nulls_match=True)
    each = rows.select(GROUP, "pid", F.inline("__labels"))
    out = each.select(GROUP, F.col("__eps").alias("eps"), "pid", F.inline(F.array(*[F.struct(F.lit(k).alias("least"), F.col(f"label_{k}").alias("label")) for k in levels])))
    return out.select(GROUP, "eps", "least", "pid", "label").unionByName(noise.select(GROUP, "eps", "least", "pid", "label"))
