"""Mean silhouettes (Rousseeuw 1987) of many clusterings at once, exact, in blocks.

A point's mean distance to a cluster is at least the distance to the cluster's centre and at most that plus the mean
distance of its members from the centre. So only clusters whose centre is no further than the least such upper bound can
be the nearest other one; for these and the own cluster the mean distances are taken in full, block by block.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hotloom.functions.planar import to_utm
from hotloom.operators.skew import blocks
from hotloom.session import stage

#: Places, and clusters, that one block holds.
BLOCK = 1_000
_Batches = Iterator[pa.RecordBatch]


def _lists(batch: pa.RecordBatch, row: int, names: list[str]) -> list[np.ndarray]:
    return [batch.column(n)[row].values.to_numpy(zero_copy_only=False) for n in names]


def _apart(x: np.ndarray, y: np.ndarray, ox: np.ndarray, oy: np.ndarray) -> np.ndarray:
    """Distances of each of the first points to each of the others."""
    dx, dy = x[:, None] - ox, y[:, None] - oy
    dx *= dx
    dy *= dy
    dx += dy
    return np.sqrt(dx, out=dx)


def _bounds(batches: _Batches) -> _Batches:
    """Per block of places and block of clusters: each place's least upper bound of the mean distance to another cluster."""
    for batch in batches:
        for i in range(batch.num_rows):
            x, y, own, label, cx, cy, spread = _lists(batch, i, ["x", "y", "own", "label", "cx", "cy", "spread"])
            upper = _apart(x, y, cx, cy) + spread
            upper[own[:, None] == label] = np.inf
            least = pa.array([upper.min(axis=1).tolist()], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([batch.column("conf").slice(i, 1), batch.column("blk").slice(i, 1), least], names=["conf", "blk", "least"])


def _candidates(batches: _Batches) -> _Batches:
    """(conf, blk, at, x, y, w, mine, cluster, n): each place with the clusters of a block that it must be measured against."""
    for batch in batches:
        for i in range(batch.num_rows):
            x, y, w, own, label, cx, cy, n = _lists(batch, i, ["x", "y", "w", "own", "label", "cx", "cy", "n"])
            bound = np.min([np.asarray(b) for b in batch.column("bounds")[i].as_py()], axis=0)
            lower = _apart(x, y, cx, cy)
            mine = own[:, None] == label
            row, col = np.nonzero(mine | (lower <= bound[:, None] * (1 + 1e-9) + 1e-9))
            conf, blk = (pa.array([batch.column(c)[i].as_py()] * len(row), batch.schema.field(c).type) for c in ("conf", "blk"))
            out = [pa.array(row.astype(np.int32)), pa.array(x[row]), pa.array(y[row]), pa.array(w[row]), pa.array(mine[row, col]), pa.array(label[col]), pa.array(n[col])]
            yield pa.RecordBatch.from_arrays([conf, blk, *out], names=["conf", "blk", "at", "x", "y", "w", "mine", "cluster", "n"])


def _sums(batches: _Batches) -> _Batches:
    """(conf, blk, at, w, mine, cluster, n, far): the sum of distances to a block of the cluster's members."""
    for batch in batches:
        for i in range(batch.num_rows):
            x, y, w, mine, n, blk, at, mx, my, mw = _lists(batch, i, ["x", "y", "w", "mine", "n", "blk", "at", "mx", "my", "mw"])
            # a few rows at once, which stay in the processor's cache
            far = np.concatenate([_apart(x[k : k + 64], y[k : k + 64], mx, my) @ mw for k in range(0, len(x), 64)])
            conf, cluster = (pa.array([batch.column(c)[i].as_py()] * len(x), batch.schema.field(c).type) for c in ("conf", "cluster"))
            yield pa.RecordBatch.from_arrays([conf, pa.array(blk), pa.array(at), pa.array(w), pa.array(mine), cluster, pa.array(n), pa.array(far)], names=["conf", "blk", "at", "w", "mine", "cluster", "n", "far"])


def _packed(df: DataFrame, by: list[str], names: dict[str, str]) -> DataFrame:
    """One row per key of ``by`` with a list for each column; keys are cut so that lists stay short."""
    got = df.groupBy(*by).agg(F.collect_list(F.struct(*names)).alias("__l"))
    return got.select(*by, *[F.col(f"__l.{c}").alias(to) for c, to in names.items()])


def _arrow(df: DataFrame, f: Callable[[_Batches], _Batches], schema: str) -> DataFrame:
    return df.mapInArrow(f, schema)


def silhouettes(labels: DataFrame, by: list[str]) -> DataFrame:
    """(by, n, score): per clustering the clustered points and their mean silhouette in projected metres; null unless there
    are 2 clusters or more and more points than clusters. Clusterings without clusters have no row.

    ``labels`` has by, lat, lon and label, negative for noise, which doesn't count. Points of one place and cluster are
    measured once; a point alone in its cluster scores 0. The work grows with the square of the largest cluster, in
    blocks of BLOCK places on either side, each a task's unit.
    """
    x, y = to_utm("lat", "lon")
    conf: Column = F.to_json(F.struct(*by)) if by else F.lit("{}")
    c = labels.where("label >= 0").withColumns({"x": x, "y": y}).groupBy(conf.alias("conf"), *by, F.col("label").cast("long").alias("own"), "x", "y").agg(F.count(F.lit(1)).cast("double").alias("w"))
    c = stage(c, "silhouette_places")
    k = c.groupBy("conf", F.col("own").alias("label")).agg(F.sum("w").alias("n"), F.count(F.lit(1)).alias("places"), (F.sum(F.col("x") * F.col("w")) / F.sum("w")).alias("cx"), (F.sum(F.col("y") * F.col("w")) / F.sum("w")).alias("cy"))
    k = stage(k, "silhouette_centres")
    centre = k.select(F.col("conf").alias("__c"), "label", "cx", "cy")
    spread = c.join(centre, (F.col("conf") == F.col("__c")) & (F.col("own") == F.col("label"))).groupBy("conf", "label").agg((F.sum(F.hypot(F.col("x") - F.col("cx"), F.col("y") - F.col("cy")) * F.col("w")) / F.sum("w")).alias("spread"))
    k = stage(k.join(spread, ["conf", "label"]), "silhouette_clusters")
    sizes = stage(k.groupBy("conf").agg(F.count(F.lit(1)).alias("k"), F.sum("n").alias("points"), F.sum("places").alias("places")), "silhouette_sizes")
    good = sizes.where((F.col("k") >= 2) & (F.col("points") > F.col("k"))).select("conf", F.col("k").alias("__k"), F.col("places").alias("__p"))
    block = lambda count, *on: F.pmod(F.xxhash64(*on), blocks(F.col(count), BLOCK)).cast("int")
    places = _packed(c.join(F.broadcast(good), "conf").withColumn("blk", block("__p", "x", "y", "own")), ["conf", "blk"], {n: n for n in ("x", "y", "w", "own")})
    places = stage(places, "silhouette_blocks")
    clusters = stage(_packed(k.join(F.broadcast(good), "conf").withColumn("part", block("__k", "label")), ["conf", "part"], {n: n for n in ("label", "cx", "cy", "n", "spread")}), "silhouette_parts")
    met = places.join(clusters, "conf")
    bounds = _arrow(met.select("conf", "blk", "x", "y", "own", "label", "cx", "cy", "spread"), _bounds, "conf string, blk int, least array<double>")
    bounds = bounds.groupBy("conf", "blk").agg(F.collect_list("least").alias("bounds"))
    look = _arrow(met.join(bounds, ["conf", "blk"]).select("conf", "blk", "x", "y", "w", "own", "label", "cx", "cy", "n", "bounds"), _candidates, "conf string, blk int, at int, x double, y double, w double, mine boolean, cluster long, n double")
    look = stage(look, "silhouette_lookers")
    many = look.groupBy(F.col("conf").alias("__c"), F.col("cluster").alias("__u")).agg(F.count(F.lit(1)).alias("__l"))
    own = k.select(F.col("conf").alias("__kc"), F.col("label").alias("__ku"), F.col("places").alias("__m"))
    look = look.join(many, (F.col("conf") == F.col("__c")) & (F.col("cluster") == F.col("__u"))).join(own, (F.col("conf") == F.col("__kc")) & (F.col("cluster") == F.col("__ku")))
    look = look.withColumns({"part": block("__l", "blk", "at"), "parts": blocks(F.col("__m"), BLOCK)})
    left = _packed(look, ["conf", "cluster", "part", "parts"], {n: n for n in ("x", "y", "w", "mine", "n", "blk", "at")}).withColumn("side", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
    members = c.join(own, (F.col("conf") == F.col("__kc")) & (F.col("own") == F.col("__ku"))).withColumn("side", block("__m", "x", "y"))
    right = _packed(members.select("conf", F.col("own").alias("cluster"), "side", "x", "y", "w"), ["conf", "cluster", "side"], {"x": "mx", "y": "my", "w": "mw"})
    parts = _arrow(left.join(right, ["conf", "cluster", "side"]).drop("side", "part"), _sums, "conf string, blk int, at int, w double, mine boolean, cluster long, n double, far double")
    far = parts.groupBy("conf", "blk", "at", "w", "mine", "cluster", "n").agg(F.sum("far").alias("far"))
    mine, other = F.col("mine"), ~F.col("mine")
    each = far.groupBy("conf", "blk", "at", "w").agg(F.max(F.when(mine, F.col("n"))).alias("size"), F.max(F.when(mine, F.col("far") / F.nullif(F.col("n") - 1, F.lit(0.0)))).alias("a"), F.min(F.when(other, F.col("far") / F.col("n"))).alias("b"))
    one = F.when(F.col("size") == 1, 0.0).otherwise((F.col("b") - F.col("a")) / F.nullif(F.greatest("a", "b"), F.lit(0.0)))
    score = each.groupBy("conf").agg((F.sum(F.coalesce(one, F.lit(0.0)) * F.col("w")) / F.sum("w")).alias("score"))
    found = sizes.join(score, "conf", "left").select("conf", F.col("points").cast("long").alias("n"), "score")
    if not by:
        return found.drop("conf")
    return c.select("conf", *by).distinct().join(found, "conf").drop("conf")
