"""Connected components of a table of links, by contraction."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hotloom.session import stage, stage_counted, unstage


#: Links, counted when they are staged, that one task finishes in memory (about 10 MB); more are contracted in rounds.
FEW_LINKS = 200_000


def hash_order(node: Column, seed: int) -> Column:
    """An order of nodes that is another for each seed; the node itself settles equal hashes."""
    return F.struct(F.xxhash64(node, F.lit(seed)).alias("hash"), node.alias("node"))


def both_ways(links: DataFrame) -> DataFrame:
    return links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))


def moved(links: DataFrame, move: DataFrame) -> DataFrame:
    """(a, b) with a < b, distinct: links whose ends are replaced as ``move`` (node, root) says; those that close up go."""
    step = move.select(F.col("node").alias("__from"), F.col("root").alias("__to"))
    x = links.join(step, links["a"] == step["__from"], "left").select(F.coalesce("__to", "a").alias("a"), "b")
    x = x.join(step, x["b"] == step["__from"], "left").select("a", F.coalesce("__to", "b").alias("b")).where("a != b")
    return x.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _renamed(member: DataFrame, move: DataFrame) -> DataFrame:
    step = move.select(F.col("node").alias("__from"), F.col("root").alias("__to"))
    return member.join(step, member["root"] == step["__from"], "left").select("node", F.coalesce("__to", "root").alias("root"))


def least_of_component(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, roots) of links in memory; a root is the component's least node."""
    nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    return nodes, nodes[least_numbers(ends[: len(a)], ends[len(a) :], len(nodes))]


def least_numbers(u: np.ndarray, v: np.ndarray, n: int) -> np.ndarray:
    """For each of the numbers below n the least that links u, v join it with."""
    top = np.arange(n)
    while True:
        u, v = top[u], top[v]
        apart = u != v
        if not apart.any():
            return top
        u, v = u[apart], v[apart]
        np.minimum.at(top, np.maximum(u, v), np.minimum(u, v))
        while (top[top] != top).any():
            top = top[top]


def _finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = [b for b in batches if b.num_rows]
    if held:
        t = pa.Table.from_batches(held)
        nodes, roots = least_of_component(t["a"].to_numpy(), t["b"].to_numpy())
        yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(roots)], names=["node", "root"])


def components(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(node, root), staged: nodes (long) joined by any chain of links (a, b) share a root, one of them.

    In each round every node moves to its neighbour that is first in that round's hash order, unless it is first itself,
    and links are rewritten; so hubs close up at once, and the number of rounds grows with the logarithm of the largest
    component. Once no more than FEW_LINKS are left, one task joins what they link. Links between other nodes are ignored. No nodes give no rows.
    """
    member = stage(nodes.select("node", F.col("node").alias("root")), "member")
    left, rows = stage_counted(links.where("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
    seed = 0
    while rows:
        if rows <= FEW_LINKS:
            goes = left.repartition(1).mapInArrow(_finish, "node long, root long")
            return stage(_renamed(member, goes), "member")
        first = both_ways(left).groupBy(F.col("a").alias("node")).agg(F.min(hash_order(F.col("b"), seed)).alias("__m"))
        goes = first.where(F.col("__m") < hash_order(F.col("node"), seed)).select("node", F.col("__m.node").alias("root"))
        goes = stage(goes, "moves")
        now = stage(_renamed(member, goes), "member")
        rest, rows = stage_counted(moved(left, goes), "links")
        for old in (member, left, goes):
            unstage(old)
        member, left, seed = now, rest, seed + 1
    return member
