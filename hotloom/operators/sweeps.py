"""DBSCAN over a grid of parameters, its quality figures, baselines and the choice of a configuration."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hotloom.functions.planar import to_latlon
from hotloom.functions.sphere import EARTH_M, haversine
from hotloom.operators.density import CELL, GROUP, by_configuration, celled, dbscan, in_range, looking, to_cells
from hotloom.operators.gathered import by_radius, fits_task, gathered, labelling
from hotloom.operators.measured import measured
from hotloom.operators.ranking import with_rank
from hotloom.operators.shapes import centres, outlines, radii
from hotloom.operators.silhouettes import silhouettes
from hotloom.operators.skew import block_join, crowded, split_join
from hotloom.session import stage, stage_counted

#: The swept grid, and what a configuration must fulfil to be chosen.
EPS_METRES = [75, 100, 150, 200, 250, 300, 400, 500, 750, 1000]
MIN_SAMPLES = [3, 4, 5, 6, 8, 10]
SELECTION = {"noise": 75.0, "radius": 1000.0, "ari": 0.6, "clusters": 20, "ratio": 1.5}
#: Rows up to which the draws of random baselines are written.
FEW_DRAWN = 2_000_000
KNN_KS = [4, 5, 6, 8]
KDIST_LEVELS = [0.10, 0.25, 0.50, 0.75, 0.90, 0.95]


def check_parameters(eps: float, least: int) -> None:
    if not eps > 0 or least < 1:
        raise ValueError("eps must be positive and min_samples at least 1")


def labelled(points: DataFrame, eps: list[float], least: list[int]) -> DataFrame:
    """(eps, least, pid, lat, lon, label), staged: the clusters of points (pid, lat, lon) in every configuration."""
    for e in eps:
        for m in least:
            check_parameters(e, m)
    rows = points.select(F.lit(0).alias(GROUP), "pid", "lat", "lon")
    there, bad = in_range(rows)
    wide = gathered(there, eps, least)
    if wide is not None:
        # a row for each point, as long as nobody needs one for each label
        noise = bad.withColumn("labels", F.array_repeat(F.lit(-1), len(eps) * len(least)))
        wide = stage(wide.unionByName(noise).drop(GROUP), "labelled")
        return by_configuration(wide, eps, least).select("eps", "least", "pid", "lat", "lon", "label")
    labels = dbscan(rows, eps, least).drop(GROUP)
    return stage(labels.join(points.select("pid", "lat", "lon"), "pid"), "labelled")


def cluster_sizes(labels: DataFrame, by: list[str]) -> DataFrame:
    """(by, label, reports, places, most, radius_m) of each cluster: its size, distinct coordinates, the most reports at
    one coordinate and the greatest distance from its centre."""
    c = labels.where("label >= 0")
    at = c.groupBy(*by, "label", "lat", "lon").agg(F.count(F.lit(1)).alias("n"))
    g = at.groupBy(*by, "label").agg(F.sum("n").alias("reports"), F.count(F.lit(1)).alias("places"), F.max("n").alias("most"))
    return g.join(radii(c, centres(c, [*by, "label"]), [*by, "label"]), [*by, "label"])


def sweep_metrics(labels: DataFrame, by: list[str]) -> DataFrame:
    """Per configuration: points, clusters, noise and its percentage, largest size and share, median size, greatest
    radius, and the share of clusters of which nine tenths lie at one coordinate. No clusters: zeros."""
    n = labels.groupBy(*by).agg(F.count(F.lit(1)).alias("points"), F.count_if(F.col("label") < 0).alias("noise_count"))
    c = cluster_sizes(labels, by).groupBy(*by).agg(
        F.count(F.lit(1)).alias("k"), F.max("reports").alias("big"), F.sum("reports").alias("s"), F.percentile("reports", F.lit(0.5)).alias("mid"), F.max("radius_m").alias("rad"), F.count_if(F.col("most") >= F.col("reports") * 0.9).alias("single"),
    )
    d = n.join(c, by, "left")
    z = lambda e, zero: F.coalesce(e, F.lit(zero))
    return d.select(
        *by, "points", z("k", 0).alias("cluster_count"), "noise_count", (F.lit(100.0) * F.col("noise_count") / F.col("points")).alias("noise_percentage"), z("big", 0).alias("largest_cluster"),
        z(F.col("big") / F.col("s"), 0.0).alias("largest_cluster_share"), z("mid", 0.0).alias("median_cluster"), z("rad", 0.0).alias("max_cluster_radius_m"), z(F.col("single") / F.col("k"), 0.0).alias("single_coordinate_cluster_share"),
    )


def sanity_warnings() -> Column:
    """Names of the rules a row of sweep_metrics breaks, joined by ' | '; empty if none."""
    some = F.col("cluster_count") > 0
    rules = {
        "almost everything is noise": ~some | (F.col("noise_percentage") > 85),
        "one cluster holds most reports": some & (F.col("largest_cluster_share") > 0.5),
        "almost everything is merged": some & (F.col("cluster_count") <= 2) & (F.col("noise_percentage") < 10),
        "geographically huge": F.col("max_cluster_radius_m") > 4000,
        "mostly repeated coordinates": F.col("single_coordinate_cluster_share") > 0.25,
    }
    return F.concat_ws(" | ", *[F.when(rule, name) for name, rule in rules.items()])


def adjusted_rand(pairs: DataFrame, by: list[str], a: str, b: str) -> DataFrame:
    """(by, ari) of two labelings of the same points; noise is a label like others. 1 if both are trivial and equal."""
    two = lambda c: F.col(c) * (F.col(c) - 1) / 2
    cells = pairs.groupBy(*by, a, b).agg(F.count(F.lit(1)).alias("n"))
    inner = cells.groupBy(*by).agg(F.sum(two("n")).alias("i"), F.sum("n").alias("n"))
    side = lambda c, name: cells.groupBy(*by, c).agg(F.sum("n").alias("m")).groupBy(*by).agg(F.sum(two("m")).alias(name))
    d = inner.join(side(a, "x"), by).join(side(b, "y"), by)
    expected = F.col("x") * F.col("y") / F.nullif(two("n"), F.lit(0.0))
    most = (F.col("x") + F.col("y")) / 2
    return d.select(*by, F.coalesce((F.col("i") - expected) / F.nullif(most - expected, F.lit(0.0)), F.lit(1.0)).alias("ari"))


def stability(labels: DataFrame) -> DataFrame:
    """(eps, least, stability_ari): mean index of agreement with the next smaller and larger eps of the same least."""
    order = Window.partitionBy("least").orderBy("eps")
    grid = labels.select("eps", "least").distinct().withColumn("next", F.lead("eps").over(order)).where("next is not null")
    a = labels.join(F.broadcast(grid), ["eps", "least"]).select("eps", "least", "next", "pid", F.col("label").alias("la"))
    b = labels.select(F.col("eps").alias("next"), "least", "pid", F.col("label").alias("lb"))
    ari = adjusted_rand(a.join(b, ["next", "least", "pid"]), ["eps", "least", "next"], "la", "lb")
    both = ari.select("eps", "least", "ari").unionByName(ari.select(F.col("next").alias("eps"), "least", "ari"))
    return both.groupBy("eps", "least").agg(F.avg("ari").alias("stability_ari"))


def baselines(pool: DataFrame, size: int, eps: list[float], least: list[int], reps: int = 20, seed: int = 7) -> DataFrame:
    """(eps, least, baseline_clusters, baseline_sd, baseline_noise): what random subsets of the pool give.

    Each repetition takes the ``size`` rows of the smallest hash of row and repetition, so draws are the same on every
    run; all repetitions and configurations are clustered in one go. sd is the population's. Draws of more than FEW_DRAWN
    rows aren't written: the task of a repetition reads the pool and takes its rows. pid must be unique.
    """
    if size * reps > FEW_DRAWN:
        pool = stage(pool.select("pid", "lat", "lon"), "pool")
    drawn_from = pool
    hashed = F.xxhash64("pid", "rep", F.lit(seed))
    pool = pool.select("pid", "lat", "lon", F.explode(F.sequence(F.lit(0), F.lit(reps - 1))).alias("rep")).withColumn("h", hashed)
    # the part of the hashes' range in which each repetition reaches its size: only that part is ranked
    pool = pool.withColumn("part", F.shiftright("h", 64 - 12))
    upto = Window.partitionBy("rep").orderBy("part").rowsBetween(Window.unboundedPreceding, 0)
    ends = pool.groupBy("rep", "part").agg(F.count(F.lit(1)).alias("n")).withColumn("upto", F.sum("n").over(upto))
    ends = ends.where(F.col("upto") >= size).groupBy(F.col("rep").alias("__rep")).agg(F.min_by(F.struct("part", (F.col("upto") - F.col("n")).alias("before")), "part").alias("end"))
    ends = stage(ends.select("__rep", "end.*").withColumnRenamed("part", "__end"), "draw_ends")
    pool = pool.join(F.broadcast(ends), F.col("rep") == F.col("__rep"), "left")
    last = pool.where(F.col("part") == F.col("__end")).withColumn("r", F.row_number().over(Window.partitionBy("rep").orderBy("h", "pid"))).where(F.col("before") + F.col("r") <= size)
    names = [F.col("rep").alias(GROUP), "pid", "lat", "lon"]
    each = None
    if size * reps > FEW_DRAWN:
        each = counted_draws(drawn_from, size, last.where(F.col("before") + F.col("r") == size).select("rep", "h", "pid"), eps, least, reps, seed)
    if each is None:
        drawn = stage(pool.where(F.col("__end").isNull() | (F.col("part") < F.col("__end"))).select(names).unionByName(last.select(names)), "draws")
        each = counted(drawn, eps, least)
    return each.groupBy("eps", "least").agg(F.avg("clusters").alias("baseline_clusters"), F.stddev_pop("clusters").alias("baseline_sd"), F.avg(F.lit(100.0) * F.col("noise") / F.col("points")).alias("baseline_noise"))


def counted_draws(pool: DataFrame, size: int, ends: DataFrame, eps: list[float], least: list[int], reps: int, seed: int) -> DataFrame | None:
    """counted() of draws from a staged pool, each of which goes from the pool to a task without being written: it has the
    rows up to its end (rep, h, pid), and the whole pool without one. None if a draw doesn't fit a task."""
    there, _ = in_range(pool)
    seen = pool.count()
    box = there.agg(*[f(c).alias(f"{c}_{f.__name__}") for c in ("lat", "lon") for f in (F.min, F.max)]).first()
    if not fits_task(min(size, seen), [abs(box[c] or 0) for c in ("lat_min", "lat_max")], [abs(box[c] or 0) for c in ("lon_min", "lon_max")], eps):
        return None
    upto = {r["rep"]: (r["h"], r["pid"]) for r in ends.collect()}
    # a union of nothing but single partitions would be a single one; with two empty ones it keeps a partition for each draw
    draws = [pool.sparkSession.range(0, 0, 1, 2).select(F.lit(0).alias(GROUP), F.col("id").alias("pid"), *[F.lit(0.0).alias(c) for c in ("lat", "lon")])]
    for rep in range(reps):
        h = F.xxhash64("pid", F.lit(rep), F.lit(seed))
        mine = there if rep not in upto else there.where((h < upto[rep][0]) | ((h == upto[rep][0]) & (F.col("pid") <= upto[rep][1])))
        draws.append(mine.select(F.lit(rep).alias(GROUP), F.col("pid").cast("long").alias("pid"), "lat", "lon").coalesce(1))
    found = labelling(reduce(DataFrame.unionByName, draws), eps, least, counts=True)
    every = pool.sparkSession.range(reps).select(F.col("id").cast("int").alias(GROUP), F.lit(min(size, seen)).cast("long").alias("points")) if seen else pool.sparkSession.createDataFrame([], f"{GROUP} int, points long")
    return with_noise(every, found, eps, least)


def counted(points: DataFrame, eps: list[float], least: list[int]) -> DataFrame:
    """(grp, eps, least, points, clusters, noise) of every group of points in every configuration."""
    there, _ = in_range(points)
    found = gathered(there, eps, least, counts=True)
    if found is None:
        labels = dbscan(points, eps, least).groupBy("eps", "least", GROUP)
        each = labels.agg(F.count(F.lit(1)).alias("points"), (F.max("label") + 1).alias("clusters"), F.count_if(F.col("label") < 0).alias("noise"))
        return each.select(GROUP, "eps", "least", "points", "clusters", "noise")
    return with_noise(points.groupBy(GROUP).agg(F.count(F.lit(1)).alias("points")), found, eps, least)


def with_noise(every: DataFrame, found: DataFrame, eps: list[float], least: list[int]) -> DataFrame:
    """Rows (grp, eps, least, points, clusters, noise) from all groups (grp, points) and what gathered() counted in them."""
    grid = F.inline(F.array(*[F.struct(F.lit(float(e)).alias("eps"), F.lit(k).alias("least")) for e in eps for k in least]))
    every = every.select(F.col(GROUP).alias("__g"), "points", grid)
    found = found.withColumnsRenamed({"eps": "__e", "least": "__k"})
    both = every.join(found, F.col("__g").eqNullSafe(F.col(GROUP)) & (F.col("eps") == F.col("__e")) & (F.col("least") == F.col("__k")), "left")
    return both.select(F.col("__g").alias(GROUP), "eps", "least", "points", F.coalesce("clusters", F.lit(0)).alias("clusters"), (F.col("points") - F.coalesce("held", F.lit(0))).alias("noise"))


def from_measured(rows: DataFrame) -> DataFrame:
    """The columns of a sweep from rows of measured()."""
    before = F.lag("ari").over(Window.partitionBy("least").orderBy("eps"))
    share = lambda a, b: F.coalesce(F.col(a) / F.nullif(F.col(b), F.lit(0)), F.lit(0.0))
    d = rows.select(
        "eps", "least", "points", F.col("k").alias("cluster_count"), (F.col("points") - F.col("s")).alias("noise_count"), (F.lit(100.0) * (F.col("points") - F.col("s")) / F.col("points")).alias("noise_percentage"), F.col("big").alias("largest_cluster"),
        share("big", "s").alias("largest_cluster_share"), F.col("mid").alias("median_cluster"), F.col("rad").alias("max_cluster_radius_m"), share("single", "k").alias("single_coordinate_cluster_share"),
        F.coalesce((before + F.col("ari")) / 2, "ari", before).alias("stability_ari"), "silhouette",
    )
    return d.withColumn("warnings", sanity_warnings()).select(*[c for c in d.columns if c != "silhouette"], "warnings", "silhouette")


def sweep(points: DataFrame, pool: DataFrame | None = None, eps: list[float] = EPS_METRES, least: list[int] = MIN_SAMPLES, reps: int = 20) -> DataFrame:
    """One row per configuration: metrics, stability, mean silhouette (a supplement that no rule reads, null where it isn't
    defined), warnings, and with a pool the ratio to random subsets."""
    for e in eps:
        for m in least:
            check_parameters(e, m)
    there, bad = in_range(points.select(F.lit(0).alias(GROUP), "pid", "lat", "lon"))
    packed = by_radius(there, eps, least)
    if packed is not None:
        # measured radius by radius; labels are written for a radius and the next, and only of what is clustered at either
        out = from_measured(stage(measured(packed, bad, eps, least), "measured"))
    else:
        labels = labelled(points, eps, least)
        out = sweep_metrics(labels, ["eps", "least"]).join(stability(labels), ["eps", "least"], "left").withColumn("warnings", sanity_warnings())
        out = out.join(stage(silhouettes(labels, ["eps", "least"]), "silhouettes").select("eps", "least", F.col("score").alias("silhouette")), ["eps", "least"], "left")
    if pool is None:
        return out
    base = baselines(pool, points.count(), eps, least, reps)
    return out.join(base, ["eps", "least"]).withColumn("cluster_ratio", F.col("cluster_count") / F.nullif(F.rint(F.col("baseline_clusters") * 10) / 10, F.lit(0.0)))


def passing(rows: DataFrame) -> DataFrame:
    """Rows of a sweep that fulfil all criteria; a null figure fulfils none."""
    s = SELECTION
    return rows.where((F.col("warnings") == "") & (F.col("noise_percentage") <= s["noise"]) & (F.col("max_cluster_radius_m") <= s["radius"]) & (F.col("stability_ari") >= s["ari"]) & (F.col("cluster_count") >= s["clusters"]) & (F.col("cluster_ratio") >= s["ratio"]))


def best(rows: DataFrame) -> DataFrame:
    """The most stable row, of equals that of the least noise, then of the smallest eps and least; none of none."""
    return rows.orderBy(F.desc("stability_ari"), "noise_percentage", "eps", "least").limit(1)


def select_config(rows: DataFrame, eps: float | None = None, least: int | None = None) -> DataFrame:
    """The chosen row: the most stable of those passing, then the least noise, then smallest eps and least.

    With eps and least given, that row. One of them alone, a pair outside the grid, or no passing row is a ValueError.
    """
    if (eps is None) != (least is None):
        raise ValueError("eps and min_samples must be given together")
    chosen = rows.where((F.col("eps") == eps) & (F.col("least") == least)) if eps is not None else passing(rows)
    chosen = best(chosen)
    if chosen.isEmpty():
        raise ValueError("no configuration fulfils the criteria" if eps is None else f"({eps}, {least}) isn't in the grid")
    return chosen


def cluster_records(labels: DataFrame, dates: DataFrame, eps: float) -> DataFrame:
    """One record per cluster: size, distinct coordinates, whether nine tenths lie at one, centre, radius, first and last
    date, box, area, density and outline.

    ``labels`` has pid, label, lat, lon; ``dates`` pid and date, null where unknown. The area is the hull's, at least a
    circle of diameter eps; the outline runs 50 m around the hull, in degrees of 5 places.
    """
    c = labels.where("label >= 0").select("pid", "label", "lat", "lon").join(dates.select("pid", "date"), "pid", "left")
    middle = centres(c, ["label"])
    sizes = cluster_sizes(labels, []).select("label", "places", "most")
    g = c.groupBy("label").agg(F.count(F.lit(1)).alias("report_count"), F.min("date").alias("date_min"), F.max("date").alias("date_max"), F.min("lat").alias("bbox_min_lat"), F.min("lon").alias("bbox_min_lon"), F.max("lat").alias("bbox_max_lat"), F.max("lon").alias("bbox_max_lon"))
    shape = outlines(c, "label").select("label", "hull_km2", "outline")
    corner = shape.select("label", F.posexplode("outline").alias("i", "p")).select("label", "i", F.col("p")[0].alias("x"), F.col("p")[1].alias("y"))
    a, b = to_latlon("x", "y")
    r5 = lambda v: F.rint(v * 1e5) / 1e5
    ring = corner.select("label", F.struct("i", r5(b).alias("lon"), r5(a).alias("lat")).alias("p")).groupBy("label").agg(F.transform(F.array_sort(F.collect_list("p")), lambda p: F.array(p["lon"], p["lat"])).alias("boundary"))
    out = g.join(sizes, "label").join(middle, "label").join(radii(c, middle, ["label"]), "label").join(shape.select("label", "hull_km2"), "label").join(ring, "label")
    area = F.greatest(F.col("hull_km2"), F.lit(math.pi * (eps / 2) ** 2 / 1e6))
    return out.select(
        "label", "report_count", F.col("places").alias("distinct_coordinates"), (F.col("most") >= F.col("report_count") * 0.9).alias("single_coordinate_cluster"), F.col("centre_lat").alias("centroid_latitude"), F.col("centre_lon").alias("centroid_longitude"),
        F.col("radius_m").alias("approx_radius_meters"), "date_min", "date_max", "bbox_min_lat", "bbox_min_lon", "bbox_max_lat", "bbox_max_lon", area.alias("boundary_area_km2"), (F.col("report_count") / area).alias("density_reports_per_km2"), "boundary",
    )


def k_distances(points: DataFrame, ks: list[int], start_m: float = 50.0, factor: float = 4.0) -> DataFrame:
    """(pid, k, metres): distance to the k-th nearest point, itself counted as the first; by cells that grow.

    A place gets the first radius, each ``factor`` times the one before, whose cell around it, any two points of which
    are within the radius, holds the greatest k: so the radius surely reaches that many, and crowded places look no
    further than they must. Rounds only count cells; then all look at once, each with its own radius. All distances are
    exact. With fewer points than k there is no row; points with null or impossible coordinates have none and count for
    none.
    """
    most = max(ks)
    n = points.where(F.col("lat").between(-90, 90) & F.col("lon").between(-180, 180)).select("pid", (F.col("lat") + 0.0).alias("lat"), (F.col("lon") + 0.0).alias("lon"))
    places, left = stage_counted(n.groupBy("lat", "lon").agg(F.count(F.lit(1)).alias("w"), F.min("pid").alias("rid")), "knn_places")
    waiting, settled, radii = places, [], []
    while left:
        radii.append(start_m * factor ** len(radii))
        at = lambda d: celled(d.withColumns({GROUP: F.lit(len(radii) - 1), "eps": F.lit(radii[-1])}))  # noqa: E731, B023
        full = F.lit(True) if radii[-1] > EARTH_M * np.pi else F.col("cw") >= most
        cells = at(places).groupBy(F.col("band").alias("__band"), F.col("cell").alias("__cell")).agg(F.sum("w").alias("cw")).where(full)
        here = at(waiting).join(cells, (F.col("band") == F.col("__band")) & (F.col("cell") == F.col("__cell")), "left").select("lat", "lon", "w", "rid", F.when(F.col("cw").isNotNull(), F.lit(len(radii) - 1)).alias("number"))
        here = stage(here, "knn_round")
        settled.append(here.where("number is not null"))
        waiting = here.where("number is null").drop("number")
        left = waiting.count()
    rows = F.array(*[F.struct(F.lit(k).alias("k"), F.col(f"k{k}").alias("metres")) for k in ks])
    if not settled:
        return n.withColumns({f"k{k}": F.lit(0.0) for k in ks}).select("pid", F.inline(rows))
    sized = F.create_map(*[F.lit(x) for pair in enumerate(radii) for x in pair])
    look = celled(reduce(DataFrame.unionByName, settled).withColumnRenamed("number", GROUP).withColumn("eps", sized[F.col(GROUP)]))
    seen = celled(places.withColumn(GROUP, F.explode(F.sequence(F.lit(0), F.lit(len(radii) - 1)))).withColumn("eps", sized[F.col(GROUP)]))
    crowd = crowded(seen.groupBy(*CELL).agg(F.count(F.lit(1)).alias("__n")), "__n", CELL)
    # a place with copies is one looker; its own copies are at distance 0
    met = looking(look, seen, crowd, []).groupBy("by", "metres").agg(F.sum("w").alias("w"))
    run = Window.partitionBy("by").orderBy("metres")
    met = met.withColumn("upto", F.sum("w").over(run.rowsBetween(Window.unboundedPreceding, 0)))
    each = met.groupBy("by").agg(*[F.min(F.when(F.col("upto") >= k, F.col("metres"))).alias(f"k{k}") for k in ks])
    named = places.join(each, F.col("rid") == F.col("by")).select(F.col("lat").alias("__lat"), F.col("lon").alias("__lon"), "w", *[f"k{k}" for k in ks])
    return split_join(n, stage(named, "knn"), {"lat": "__lat", "lon": "__lon"}, "w").select("pid", F.inline(rows)).where("metres is not null")


def knee(distances: DataFrame, value: str) -> DataFrame:
    """(n, metres): the value of sorted distances that lies furthest below the straight line from first to last, the
    first of equals. Distances are sorted by a range shuffle; only counts are gathered."""
    d = with_rank(distances.select(value), [value], "i", "n").withColumn("i", F.col("i") - 1)
    ends = d.agg(F.min(value).alias("a"), F.max(value).alias("b")).withColumn("__k", F.lit(1))
    d = d.withColumn("__k", F.lit(1)).join(F.broadcast(ends), "__k")
    gap = F.col("i") / F.greatest(F.col("n") - 1, F.lit(1)) - (F.col(value) - F.col("a")) / F.greatest(F.col("b") - F.col("a"), F.lit(1e-12))
    return d.orderBy(F.desc(gap), "i").limit(1).select("n", F.col(value).alias("metres"))


def spanning_forest(a: np.ndarray, b: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(kept, nodes, roots): places in the arrays of the edges of a minimum spanning forest, and each node's tree, named
    by one of its nodes. Boruvka's rounds; equal weights are ordered by their ends, so the edges have one order."""
    nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    order = np.lexsort((np.maximum(a, b), np.minimum(a, b), w))
    u, v = ends[: len(a)][order], ends[len(a) :][order]
    every = np.arange(len(nodes))
    top, live, kept = every.copy(), np.arange(len(order)), [np.zeros(0, int)]
    while True:
        live = live[top[u[live]] != top[v[live]]]
        if not len(live):
            return order[np.concatenate(kept)], nodes, nodes[top]
        best = np.full(len(nodes), len(order))
        np.minimum.at(best, top[u[live]], live)
        np.minimum.at(best, top[v[live]], live)
        own = np.flatnonzero(best < len(order))
        edge = best[own]
        kept.append(np.unique(edge))
        to = every.copy()
        to[own] = np.where(top[u[edge]] == own, top[v[edge]], top[u[edge]])
        # two trees that take the same edge point at each other; the smaller stays
        to = np.where((to[to] == every) & (every < to), every, to)
        while (to[to] != to).any():
            to = to[to]
        top = to[top]


def tree_labels(weight: np.ndarray, a: np.ndarray, b: np.ndarray, height: np.ndarray, least: int) -> np.ndarray:
    """Labels by excess of mass from the edges a, b of a spanning tree over places of ``weight`` points; -1 is noise.

    Edges of equal height part at the same time, as Campello, Moulavi and Sander (2013) say, so the labels don't depend
    on which of several minimum spanning trees is given. Clusters are numbered by their first place. A place of several
    points can stay whole: below the height of its edges it is smaller than ``least`` or all at distance 0.
    """
    n = len(weight)
    order = np.argsort(height, kind="stable")
    head, node_of = list(range(n)), list(range(n))
    size, kids, high = weight.tolist(), {}, [0.0] * n

    def find(i: int) -> int:
        while head[i] != i:
            head[i] = head[head[i]]
            i = head[i]
        return i

    for i, j, d in zip(a[order].tolist(), b[order].tolist(), height[order].tolist(), strict=True):
        p, q = find(i), find(j)
        few, parts = sorted((kids.pop(k) if k >= n and high[k] == d else [k] for k in (node_of[p], node_of[q])), key=len)
        parts += few
        kids[len(size)] = parts
        size.append(size[node_of[p]] + size[node_of[q]])
        high.append(d)
        head[q] = p
        node_of[p] = len(size) - 1
    members: list[list[int]] = [[]]
    mass, birth, children, todo = [0.0], [0.0], [[]], [(len(size) - 1, 0)]
    cap = lambda lam: min(lam, 1e12)
    while todo:
        node, cluster = todo.pop()
        if node < n:
            members[cluster].append(node)
            mass[cluster] += (1e12 - cap(birth[cluster])) * size[node]
            continue
        lam = 1 / high[node] if high[node] > 0 else np.inf
        big = [k for k in kids[node] if size[k] >= least]
        gain = cap(lam) - cap(birth[cluster])
        for k in kids[node]:
            if size[k] >= least and len(big) > 1:
                children[cluster].append(len(birth))
                todo.append((k, len(birth)))
                birth.append(lam)
                mass.append(0.0)
                members.append([])
                children.append([])
            elif size[k] >= least:
                todo.append((k, cluster))
                continue
            else:
                stack = [k]
                while stack:
                    x = stack.pop()
                    if x < n:
                        members[cluster].append(x)
                    else:
                        stack += kids[x]
            mass[cluster] += gain * size[k]
    chosen = [False] * len(birth)
    for c in range(len(birth) - 1, 0, -1):
        below = sum(mass[k] for k in children[c])
        if children[c] and below > mass[c]:
            mass[c] = below
        else:
            chosen[c] = True
    labels, down = np.full(n, -1), [(0, -1)]
    while down:
        c, of = down.pop()
        of = c if of < 0 and chosen[c] else of  # the topmost chosen holds all below it
        if of >= 0:
            labels[members[c]] = of
        down += [(k, of) for k in children[c]]
    names, first = np.unique(labels, return_index=True)
    rank = {c: i for i, c in enumerate(c for _, c in sorted(zip(first.tolist(), names.tolist(), strict=True)) if c >= 0)}
    return np.array([rank.get(c, -1) for c in labels.tolist()], int)


def hdbscan_labels(lat: np.ndarray, lon: np.ndarray, least: int) -> np.ndarray:
    """Labels of hierarchical density clustering (Campello, Moulavi, Sander 2013) with excess of mass; -1 is noise.

    Prim's tree over mutual reachability distances in O(n^2) time and O(n) memory, in one process: what the tests compare
    hdbscan with.
    """
    n = len(lat)
    if n < max(2, least):
        return np.full(n, -1)
    a, b = np.radians(lat), np.radians(lon)

    def dist(i: int) -> np.ndarray:
        h = np.sin((a - a[i]) / 2) ** 2 + np.cos(a[i]) * np.cos(a) * np.sin((b - b[i]) / 2) ** 2
        return 2 * EARTH_M * np.arcsin(np.sqrt(np.minimum(h, 1)))

    core = np.array([np.partition(dist(i), least - 1)[least - 1] for i in range(n)])
    best, parent, done, at = np.full(n, np.inf), np.zeros(n, int), np.zeros(n, bool), 0
    edges = []
    for _ in range(n - 1):
        done[at] = True
        reach = np.maximum(np.maximum(dist(at), core), core[at])
        nearer = ~done & (reach < best)
        best[nearer], parent[nearer] = reach[nearer], at
        at = int(np.argmin(np.where(done, np.inf, best)))
        edges.append((best[at], parent[at], at))
    w, i, j = (np.array(x) for x in zip(*edges, strict=True))
    return tree_labels(np.ones(n, int), i, j, w, least)


def _forests(final: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Per partition, the minimum spanning forest of edges (ca, cb, a, b, w) between components ca, cb; and with
    ``final`` rows (component, its tree) with null in a. Edges are reduced as they come, a partition never holds all."""
    names = ["ca", "cb", "a", "b", "w"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows, limit = [], 0, 1_000_000

        def reduced() -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
            cols = [np.concatenate([h[i] for h in held]) for i in range(5)]
            kept, nodes, roots = spanning_forest(cols[0], cols[1], cols[4])
            return [c[kept] for c in cols], nodes, roots

        for batch in batches:
            if batch.num_rows:
                held.append([batch.column(c).to_numpy(zero_copy_only=False) for c in names])
                rows += batch.num_rows
            if rows > limit:
                held = [reduced()[0]]
                rows = len(held[0][0])
                limit = max(limit, 2 * rows)
        if not held:
            return
        cols, nodes, roots = reduced()
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=names)
        if final:
            none = pa.nulls(len(nodes), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(roots), none, none, pa.nulls(len(nodes), pa.float64())], names=names)

    return run


def reach_edges(places: DataFrame, radius: float) -> DataFrame:
    """(ca, cb, a, b, w): pairs of places of different components whose mutual reachability distance w, the greatest of
    their distance and both core distances, is at most ``radius``.

    ``places`` has rid, lat, lon, core and comp. Points of the largest component don't look, the others find them; and
    only into cells with points of another component.
    """
    at = celled(places.where(F.col("core") <= radius).withColumns({GROUP: F.lit(0), "eps": F.lit(radius)}))
    at = stage(at, "reach_places")
    largest = at.groupBy("comp").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "comp").first()
    if largest is None or largest["n"] == at.count():
        return at.select(F.col("comp").alias("ca"), F.col("comp").alias("cb"), F.col("rid").alias("a"), F.col("rid").alias("b"), F.col("core").alias("w")).limit(0)
    held = at.groupBy(F.col("band").alias("__b"), F.col("cell").alias("__c")).agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"))
    mine = at.where(F.col("comp") != largest["comp"])
    groups = mine.groupBy("band", "cell", "comp", "height", "half").agg(F.min("lon").alias("west"), F.max("lon").alias("east"))
    groups = groups.select("*", F.col("band").alias("__band"), F.col("cell").alias("__cell"))
    to = to_cells(groups, "west", "east", range(-2, 3)).join(held, (F.col("to_band") == F.col("__b")) & (F.col("to_cell") == F.col("__c")))
    to = to.where((F.col("lo") != F.col("comp")) | (F.col("hi") != F.col("comp"))).select(F.col("__band").alias("band"), F.col("__cell").alias("cell"), "comp", "to_band", "to_cell").distinct()
    look = mine.join(to, ["band", "cell", "comp"]).select(F.col("comp").alias("ca"), F.col("rid").alias("a"), F.col("lat").alias("__lat"), F.col("lon").alias("__lon"), F.col("core").alias("__core"), F.col("to_band").alias("__to_band"), F.col("to_cell").alias("__to_cell"))
    crowd = crowded(at.groupBy("band", "cell").agg(F.count(F.lit(1)).alias("__n")), "__n", ["band", "cell"])
    other = at.select(F.col("comp").alias("cb"), F.col("rid").alias("b"), "lat", "lon", "core", "band", "cell")
    w = F.greatest(haversine(F.col("__lat"), F.col("__lon"), F.col("lat"), F.col("lon")), "core", "__core")
    # each pair once, but points of the largest component are never the lookers
    once = (F.col("ca") < F.col("cb")) | (F.col("cb") == largest["comp"])
    met = block_join(look, other, {"__to_band": "band", "__to_cell": "cell"}, crowd, {"band": "band", "cell": "cell"}, F.col("b"))
    return met.where((F.col("ca") != F.col("cb")) & once).select("ca", "cb", "a", "b", w.alias("w")).where(F.col("w") <= radius)


EDGES = "ca long, cb long, a long, b long, w double"


def reach_tree(places: DataFrame) -> DataFrame:
    """(a, b, w): a minimum spanning tree of places (rid, lat, lon, core) under mutual reachability distance.

    The radius doubles: a minimum spanning forest of the pairs within it is part of the tree, and its components are
    contracted before the next. Partitions reduce their pairs to forests, and one task joins these, so that it gets no
    more than some edges for each component.
    """
    places = stage(places.withColumn("comp", F.col("rid")), "reach_start")
    radius = max(places.agg(F.percentile_approx("core", 0.5)).first()[0] or 0.0, 1.0)
    found = []
    while True:
        kept = stage(reach_edges(places, radius).mapInArrow(_forests(False), EDGES).repartition(1).mapInArrow(_forests(True), EDGES), "forest")
        found.append(kept.where("a is not null").select("a", "b", "w"))
        move = kept.where("a is null").select(F.col("ca").alias("comp"), F.col("cb").alias("__to"))
        places = stage(places.join(move, "comp", "left").select("rid", "lat", "lon", "core", F.coalesce("__to", "comp").alias("comp")), "reach_places")
        ends = places.agg(F.min("comp").alias("a"), F.max("comp").alias("b")).first()
        if ends["a"] == ends["b"] or radius > EARTH_M * np.pi:
            break
        radius *= 2
    every = found[0]
    for f in found[1:]:
        every = every.unionByName(f)
    return every


def hdbscan(points: DataFrame, least: int) -> DataFrame:
    """(pid, label): the hierarchical comparison of one configuration, for any number of points; -1 is noise, as are
    points with null or impossible coordinates, and all of fewer than ``least`` or 2 points.

    Core distances and the spanning tree are distributed; the hierarchy is read from the tree in one task, which holds
    one edge for each distinct place. pid must be unique.
    """
    ok = F.col("lat").between(-90, 90) & F.col("lon").between(-180, 180)
    there = points.where(ok).select("pid", (F.col("lat") + 0.0).alias("lat"), (F.col("lon") + 0.0).alias("lon"))
    core = k_distances(there, [least], 100.0).select("pid", F.col("metres").alias("core"))
    at = there.join(core, "pid").groupBy("lat", "lon").agg(F.count(F.lit(1)).alias("n"), F.min("pid").cast("long").alias("rid"), F.min("core").alias("core"))
    at = stage(at, "reach_all")
    if at.isEmpty():
        return points.select("pid", F.lit(-1).alias("label"))
    tree = reach_tree(at.select("rid", "lat", "lon", "core"))
    rows = tree.unionByName(at.select(F.col("rid").alias("a"), F.lit(None).cast("long").alias("b"), F.col("n").cast("double").alias("w")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [b for b in batches if b.num_rows]
        if not got:
            return
        t = pa.Table.from_batches(got)
        edge = t.filter(t["b"].is_valid())
        place = t.filter(t["b"].is_null()).sort_by("a")
        rid = place["a"].to_numpy()
        i, j = (np.searchsorted(rid, edge[c].to_numpy()) for c in "ab")
        labels = tree_labels(place["w"].to_numpy().astype(int), i, j, edge["w"].to_numpy(), least)
        yield pa.RecordBatch.from_arrays([pa.array(rid), pa.array(labels.astype("int32"))], names=["rid", "label"])

    named = rows.repartition(1).mapInArrow(run, "rid long, label int")
    placed = stage(at.select("lat", "lon", "rid").join(named, "rid").select(F.col("lat").alias("__lat"), F.col("lon").alias("__lon"), "label"), "hdbscan")
    found = points.join(placed, (F.col("lat") + 0.0 == F.col("__lat")) & (F.col("lon") + 0.0 == F.col("__lon")), "left")
    return found.select("pid", F.coalesce("label", F.lit(-1)).alias("label"))
