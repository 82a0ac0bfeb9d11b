"""Problem 4 against brute force: groups, pivots and medoids."""

import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from hotloom.llm import clusters
from hotloom.operators import skew

R = 6371008.8


def metres(a, b):
    p, q = math.radians(a[0]), math.radians(b[0])
    h = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(b[1] - a[1]) / 2) ** 2
    return 2 * R * math.asin(math.sqrt(min(1, h)))


def complaints(spark, n, seed, spread):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        lat, lon = (12.97, 77.59) if rng.random() < 0.3 else (round(12.97 + rng.gauss(0, spread), 3 + 3 * (i % 2)), round(77.59 + rng.gauss(0, spread), 3 + 3 * (i % 2)))
        if rng.random() < 0.05:
            lat, lon = rng.choice([(None, lon), (lat, None), (None, None), (0.0, 0.0), (-0.0, 0.0), (95.0, lon), (float("nan"), lon), (77.6, 12.9)])
        rows.append((i, rng.choice([1, 1, 2, None]), lat, lon, rng.choice([1, 1, 0, None]), "x", "y"))
    return spark.createDataFrame(rows, "rowid_ int, run_id int, latitude double, longitude double, is_pothole int, __n string, lat string"), rows


@pytest.mark.parametrize("block", [5, 2000])
def test_dense_groups_and_description(spark, monkeypatch, block):
    monkeypatch.setattr(skew.crowded, "__defaults__", (block,))
    df, rows = complaints(spark, 900, 7, 0.004)
    per = Counter((r[1], r[2] + 0.0, r[3] + 0.0) for r in rows if r[2] is not None and r[3] is not None and r[2] == r[2])
    want = {}
    for run in (1, 2, None):
        mine = [r for r in rows if r[1] == run and r[4] == 1 and r[2] is not None and r[3] is not None and 12.5 <= r[2] <= 13.5 and 77 <= r[3] <= 78.2 and per[run, r[2] + 0.0, r[3] + 0.0] < 8]
        near = {a[0]: [b[0] for b in mine if metres(a[2:4], b[2:4]) <= 250] for a in mine}
        core = {k for k, v in near.items() if len(v) >= 5}
        for start in sorted(core):
            if start in want:
                continue
            todo = [start]
            want[start] = start
            while todo:
                for j in near[todo.pop()]:
                    if j in core and j not in want:
                        want[j] = start
                        todo.append(j)
    groups = clusters.dense_groups(df)
    got = {r.rowid_: r.cluster_rowid for r in groups.rows.collect()}
    assert got == want and want
    sizes = Counter(want.values())
    described = {r.cluster_rowid: r for r in clusters.describe(groups).collect()}
    assert {k: r.report_count for k, r in described.items()} == sizes
    for r in described.values():
        assert 1 <= len(r.typical) <= 3 and all(want[t] == r.cluster_rowid for t in r.typical)
    assert clusters.dense_groups(df.limit(0)).rows.count() == 0


def test_pivots_are_local_minima(spark):
    rng = random.Random(4)
    links = sorted({tuple(sorted(rng.sample(range(60), 2))) for _ in range(110)})
    nodes = spark.createDataFrame([(i,) for i in range(62)], "node long")
    got = {r.node: r.pivot for r in clusters.pivot_clusters(nodes, spark.createDataFrame(links, "a long, b long")).collect()}
    near = defaultdict(set)
    for a, b in links:
        near[a].add(b)
        near[b].add(a)
    pivots = set(got.values())
    assert set(got) == set(range(62)) and all(got[p] == p for p in pivots)
    assert all(p == n or p in near[n] for n, p in got.items())
    assert clusters.pivot_clusters(nodes.limit(0), spark.createDataFrame(links, "a long, b long").limit(0)).count() == 0


def test_medoids(spark):
    """Sizes and medoids from all pairs of each pivot cluster, after one reassignment to the closest medoid."""
    df, _ = complaints(spark, 900, 8, 0.004)
    groups = clusters.dense_groups(df)
    places = [r.asDict() for r in groups.places.collect()]
    pivot_of = {r.node: r.pivot for r in groups.clusters.collect()}
    near = defaultdict(set)
    for r in groups.links.collect():
        near[r.a].add(pivot_of[r.b])
        near[r.b].add(pivot_of[r.a])
    xyz = lambda p: np.array([math.cos(math.radians(p["lat"])) * math.cos(math.radians(p["lon"])), math.cos(math.radians(p["lat"])) * math.sin(math.radians(p["lon"])), math.sin(math.radians(p["lat"]))])

    def medoids(of):
        out = {}
        for pivot in set(of.values()):
            mine = [p for p in places if of[p["rid"]] == pivot]
            cost = {p["rid"]: sum(q["w"] * float(np.sum((xyz(p) - xyz(q)) ** 2)) for q in mine) for p in mine}
            out[pivot] = (sum(p["w"] for p in mine), cost, min(mine, key=lambda p: (cost[p["rid"]], p["rid"])))
        return out

    start = medoids({p["rid"]: p["pivot"] for p in places})
    moved = {}
    for p in places:
        own = near[p["node"]] | {pivot_of[p["node"]]}
        moved[p["rid"]] = min(own, key=lambda c: (float(np.sum((xyz(p) - xyz(start[c][2])) ** 2)), c))
    again = medoids(moved)
    cluster_of = {p["rid"]: p["cluster_rowid"] for p in places}
    want = defaultdict(list)
    for size, cost, best in again.values():
        want[cluster_of[best["rid"]]].append((size, cost))
    described = {r.cluster_rowid: r for r in clusters.describe(groups).collect()}
    assert set(described) == set(want)
    for key, r in described.items():
        assert r.pivots == len(want[key]) and len(r.typical) == min(3, r.pivots)
        sizes = sorted((size for size, _ in want[key]), reverse=True)
        for rank, rid in enumerate(r.typical):
            size, cost = next((s, c) for s, c in want[key] if rid in c)
            assert size == sizes[rank] and cost[rid] == pytest.approx(min(cost.values()), rel=1e-6, abs=1e-18)
