"""Similarity clusters of points by parallel pivot clustering, with their sizes and most typical members.

Places are put into cells whose diagonal is the radius, so all places of a cell are mutually similar and a crowded place
costs one node instead of a quadratic number of pairs. The nodes are clustered by pivots: in each round, every node whose
hash is below those of all its unassigned neighbours becomes a pivot and absorbs the unassigned neighbours.
Density-connected groups are the pivot clusters contracted, and pivoted again, until no links are left.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hotloom.operators.components import both_ways, hash_order, moved
from hotloom.operators.density import CELL, GROUP, cell_links, cell_nodes, graded_places, natural_join, unit_vector
from hotloom.operators.skew import hot_part, split_join
from hotloom.session import stage, stage_counted, unstage


@dataclass
class Groups:
    """rows: (rowid_, grp, lat, lon, cluster_rowid) of every dense complaint; places: the dense coordinates with node,
    pivot and cluster_rowid; clusters: (node, pivot); links: (a, b) between nodes."""

    rows: DataFrame
    places: DataFrame
    clusters: DataFrame
    links: DataFrame


def pivot_round(links: DataFrame, seed: int) -> DataFrame:
    """(node, pivot) of one round: local minima of the hash order, and the neighbours they absorb.

    ``links`` holds both directions. A node next to several pivots goes to the first of them in the hash order.
    """
    first = links.groupBy("a").agg(F.min(hash_order(F.col("b"), seed)).alias("__m"))
    pivots = first.where(hash_order(F.col("a"), seed) < F.col("__m")).select(F.col("a").alias("pivot"))
    taken = links.join(pivots, links["b"] == pivots["pivot"]).groupBy(F.col("a").alias("node")).agg(F.min_by("pivot", hash_order(F.col("pivot"), seed)).alias("pivot"))
    return taken.unionByName(pivots.select(F.col("pivot").alias("node"), "pivot"))


def pivot_clusters(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(node, pivot): pivot correlation clustering; every node ends as a pivot or absorbed by a neighbouring one.

    ``links`` holds each pair once. Rounds go on until no two unassigned nodes are linked; what is left are pivots of
    their own. An empty table of nodes gives no rows; links that name unknown nodes are ignored by the last join.
    """
    left, rows = stage_counted(both_ways(links), "links")
    done, seed = [], 0
    while rows:
        got = stage(pivot_round(left, seed), "round")
        done.append(got)
        gone = got.select(F.col("node").alias("__gone"))
        rest = left.join(gone, left["a"] == gone["__gone"], "left_anti")
        now, rows = stage_counted(rest.join(gone, rest["b"] == gone["__gone"], "left_anti"), "links")
        unstage(left)
        left, seed = now, seed + 1
    if not done:
        return nodes.select("node", F.col("node").alias("pivot"))
    found = done[0]
    for got in done[1:]:
        found = found.unionByName(got)
    return nodes.select("node").join(found, "node", "left").select("node", F.coalesce("pivot", "node").alias("pivot"))


def connected(clusters: DataFrame, links: DataFrame) -> DataFrame:
    """(node, root), staged: nodes joined by any chain of links share a root; from pivot clusters, by contraction.

    Each level takes the clusters as nodes, lets pivots absorb their neighbours once, and drops links within a cluster.
    The number of levels grows with the logarithm of the largest group.
    """
    member, seed = stage(clusters.select("node", F.col("pivot").alias("root")), "member"), 100
    links, left = stage_counted(moved(links, member), "contracted")
    while left:
        got = stage(pivot_round(both_ways(links), seed).withColumnRenamed("pivot", "root"), "level")
        step = got.select(F.col("node").alias("__from"), F.col("root").alias("__to"))
        now = stage(member.join(step, member["root"] == step["__from"], "left").select("node", F.coalesce("__to", "root").alias("root")), "member")
        rest, left = stage_counted(moved(links, got), "contracted")
        for old in (member, links, got):
            unstage(old)
        member, links, seed = now, rest, seed + 1
    return member


def pothole_places(complaints: DataFrame, pin_limit: int = 8, box: tuple[float, ...] = (12.5, 13.5, 77.0, 78.2)) -> tuple[DataFrame, DataFrame]:
    """(places, counts): the coordinates of a run in the box with fewer than pin_limit complaints of any kind and some
    pothole complaint; and all coordinates in the box with their counts."""
    inside = complaints.where(F.col("latitude").between(*box[:2]) & F.col("longitude").between(*box[2:]))
    hole = F.coalesce(F.col("is_pothole") == 1, F.lit(False))
    counts = inside.groupBy(F.col("run_id").alias(GROUP), (F.col("latitude") + 0.0).alias("lat"), (F.col("longitude") + 0.0).alias("lon")).agg(F.count(F.lit(1)).alias("n"), F.count_if(hole).alias("w"), F.min(F.when(hole, F.col("rowid_"))).alias("rid"))
    counts = stage(counts, "coordinates")
    return counts.where((F.col("n") < pin_limit) & (F.col("w") > 0)).drop("n"), counts


def density_groups(places: DataFrame, least: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(at, clusters, links): the dense places with node, pivot and cluster_rowid, the smallest id of those that a chain
    of dense places with steps of at most eps joins; the pivot clusters and links of the nodes."""
    dense = graded_places(places, [least])[0].where("level > 0")
    nodes = stage(cell_nodes(dense), "nodes")
    links = stage(cell_links(dense, nodes), "cell_links")
    clusters = stage(pivot_clusters(nodes, links), "pivots")
    roots = connected(clusters, links)
    named = nodes.select(*[F.col(k).alias(f"__{k}") for k in CELL], "node", "places").join(clusters, "node").join(roots, "node")
    named = stage(named.join(named.groupBy("root").agg(F.min("node").alias("cluster_rowid")), "root"), "named_nodes")
    at = split_join(dense, named, {k: f"__{k}" for k in CELL}, "places", nulls_match=True)
    return stage(at.select(*dense.columns, "node", "pivot", "root", "cluster_rowid"), "dense_places"), clusters, links


def dense_groups(complaints: DataFrame, radius_m: float = 250.0, least: int = 5) -> Groups:
    """The dense groups of pothole complaints.

    Two dense complaints share a cluster if a chain of dense ones with steps of at most radius_m joins them; it is named
    after its smallest rowid_. Complaints with a null in run, coordinate or is_pothole: a null run is a run of its own,
    the others aren't taken. Repeated rows count each.
    """
    places, counts = pothole_places(complaints)
    at, clusters, links = density_groups(places.withColumn("eps", F.lit(radius_m)), least)
    hot, _ = hot_part(counts, "n")
    hot = hot.select(GROUP, "lat", "lon")
    rows = complaints.where(F.col("is_pothole") == 1).select(F.col("run_id").alias(GROUP), "rowid_", (F.col("latitude") + 0.0).alias("lat"), (F.col("longitude") + 0.0).alias("lon"))
    rows = rows.where(F.col("lat").isNotNull() & F.col("lon").isNotNull())
    # hot coordinates, at most a thousand, may not be dense places unless the whole table is small
    shared = hot.select(F.col(GROUP).alias("__run"), F.col("lat").alias("__lat"), F.col("lon").alias("__lon"))
    on = rows[GROUP].eqNullSafe(shared["__run"]) & (rows["lat"] == shared["__lat"]) & (rows["lon"] == shared["__lon"])
    cold_rows = rows.join(F.broadcast(shared), on, "left_anti")
    place = at.select(GROUP, "lat", "lon", "cluster_rowid")
    hot_places = stage(natural_join(hot, place, [GROUP, "lat", "lon"]), "hot_places")
    found = natural_join(cold_rows, place, [GROUP, "lat", "lon"]).unionByName(natural_join(rows, F.broadcast(hot_places), [GROUP, "lat", "lon"]))
    return Groups(found, at, clusters, links)


def describe(groups: Groups, typical: int = 3) -> DataFrame:
    """(run_id, cluster_rowid, report_count, pivots, typical): each group's size, its number of pivot clusters, and its
    most typical complaints: the medoids of its largest pivot clusters, smallest id first among equals.

    Places are reassigned to the closest medoid among the pivot clusters of their own and linked cells, and medoids are
    recomputed. The member with the least sum of squared chord distances is the one closest to the members' mean, so no
    pairs are compared. No groups give no rows.
    """
    x, y, z = unit_vector(F.col("lat"), F.col("lon"))
    places = groups.places.withColumns({"x": x, "y": y, "z": z})
    gap = sum(((F.col(c) - F.col(f"c{c}")) * (F.col(c) - F.col(f"c{c}")) for c in "xyz"), F.lit(0.0))

    def medoids(p: DataFrame) -> DataFrame:
        mean = p.groupBy(F.col("pivot").alias("__pivot")).agg(*[(F.sum(F.col(c) * F.col("w")) / F.sum("w")).alias(f"c{c}") for c in "xyz"], F.sum("w").alias("size"), F.count(F.lit(1)).alias("__n"))
        return split_join(p, stage(mean, "means"), {"pivot": "__pivot"}, "__n").groupBy("pivot").agg(F.min(F.struct(gap.alias("gap"), "rid", "x", "y", "z")).alias("m"), F.first("size").alias("size"))

    start = medoids(places).select("pivot", *[F.col(f"m.{c}").alias(f"c{c}") for c in "xyz"])
    pivot_of = groups.clusters.select(F.col("node").alias("b"), "pivot")
    near = both_ways(groups.links).join(pivot_of, "b").select(F.col("a").alias("node"), "pivot").unionByName(groups.clusters).distinct()
    near = stage(near.join(start, "pivot"), "candidates")
    closest = places.drop("pivot").join(near, "node").groupBy("rid").agg(F.min_by("pivot", F.struct(gap, "pivot")).alias("pivot"))
    again = medoids(stage(places.drop("pivot").join(closest, "rid"), "reassigned"))
    whole = places.groupBy(GROUP, "cluster_rowid").agg(F.sum("w").alias("report_count"))
    part = again.join(places.select(F.col("rid").alias("__rid"), GROUP, "cluster_rowid"), F.col("m.rid") == F.col("__rid")).select(GROUP, "cluster_rowid", "size", F.col("m.rid").alias("rid"))
    part = stage(part, "medoids")
    # the limit on the rank is taken before the shuffle, too, so no task gets all pivots of a large cluster
    ranked = part.withColumn("r", F.row_number().over(Window.partitionBy(GROUP, "cluster_rowid").orderBy(F.desc("size"), "rid"))).where(F.col("r") <= typical)
    first = ranked.groupBy(GROUP, "cluster_rowid").agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "rid"))), lambda t: t["rid"]).alias("typical"))
    count = part.groupBy(GROUP, "cluster_rowid").agg(F.count(F.lit(1)).alias("pivots"))
    out = natural_join(natural_join(whole, count, [GROUP, "cluster_rowid"]), first, [GROUP, "cluster_rowid"])
    return out.withColumnRenamed(GROUP, "run_id")
