"""Problems 2, 3 and 5 and the joins below them against brute force on small tables with nulls, ties, repeats and clashing names."""

import math
import random
from collections import Counter, defaultdict
from datetime import date, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from hotloom.operators import density, frequency, pins, proximity, regions, skew, trailing
from hotloom.operators import components as component_operator
from hotloom.operators.components import components
from hotloom.operators.skew import split_join
from hotloom.session import stage

R = 6371008.8


def metres(a, b):
    p, q = math.radians(a[0]), math.radians(b[0])
    h = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(b[1] - a[1]) / 2) ** 2
    return 2 * R * math.asin(math.sqrt(min(1, h)))


COMPLAINT = "rowid_ int, run_id int, request_id string, created_at string, ward_id int, latitude double, longitude double, is_pothole int, coord_multiplicity int, suspect_fallback_pin int, __n string, lat string"


def complaints(spark, n=600, seed=1, spread=0.01):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        lat, lon = (12.97, 77.59) if rng.random() < 0.3 else (round(12.97 + rng.gauss(0, spread), 3 + 3 * (i % 2)), round(77.59 + rng.gauss(0, spread), 3 + 3 * (i % 2)))
        if rng.random() < 0.05:
            lat, lon = rng.choice([(None, lon), (lat, None), (None, None), (0.0, 0.0), (-0.0, 0.0), (95.0, lon), (float("nan"), lon), (77.6, 12.9)])
        day = date(2021, 1, 1) + timedelta(days=int(rng.expovariate(1 / 30)))
        rows.append((i, rng.choice([1, 1, 2, None]), rng.choice([f"r{i}", f"r{i - i % 3}", None]), rng.choice([day.isoformat() + " 10:00:00"] * 9 + [None, "", "x"]), rng.choice([1, 1, 1, 2, -1, None]), lat, lon, rng.choice([1, 1, 0, None]), rng.choice([1, 2, None]), rng.choice([0, 1, None]), "x", "y"))
    return spark.createDataFrame(rows, COMPLAINT), rows


def test_split_join_hot_cold_and_nulls(spark):
    rows = spark.createDataFrame([("a", i) for i in range(500)] + [(f"k{i}", i) for i in range(400)] + [(None, 1)], "k string, v int")
    counts = stage(rows.groupBy(F.col("k").alias("key")).agg(F.count(F.lit(1)).alias("n")), "t")
    assert split_join(rows, counts, {"k": "key"}, "n", share=0.1).count() == 900
    assert split_join(rows, counts, {"k": "key"}, "n", share=0.1, nulls_match=True).count() == 901
    assert split_join(rows, counts.limit(0), {"k": "key"}, "n").count() == 0


def test_profile(spark):
    rows = [("a", 1.0), ("a", 1.0), ("a", 3.0), ("a", None), ("b", None), (None, 2.0), (None, 5.0), ("c", 7.0)]
    df = spark.createDataFrame(rows, "k string, v double")
    got = {r.k: r for r in frequency.profile(df, ["k"], modes=["v"], percentiles={"v": [0.5, 0.9]}).collect()}
    assert (got["a"].total, got["a"].v_distinct, got["a"].v_mode, got["a"].v_p50) == (4, 2, 1.0, 1.0)
    assert got["a"].v_p90 == pytest.approx(np.percentile([1, 1, 3], 90))
    assert (got["b"].total, got["b"].v_distinct, got["b"].v_mode, got["b"].v_p50) == (1, 0, None, None)
    assert (got[None].v_mode, got[None].v_p50) == (2.0, 3.5)
    assert frequency.profile(df.limit(0), ["k"], modes=["v"]).count() == 0


def test_wrong_counts(spark):
    df, rows = complaints(spark)
    key = lambda r: (r[1], r[5] + 0.0, r[6] + 0.0) if r[5] is not None and r[6] is not None else None
    n = Counter(str(key(r)) for r in rows if key(r))
    pin_rows = [(1, 1, 12.97, 77.59, n[str((1, 12.97, 77.59))]), (2, 1, 12.97, 77.59, 3), (3, 1, 50.0, 50.0, 0), (4, 1, 50.0, 50.0, None), (5, 2, 12.97, None, 0), (6, None, 12.97, 77.59, n[str((None, 12.97, 77.59))])]
    got = {tuple(r) for r in pins.wrong_counts(df, spark.createDataFrame(pin_rows, "pin_id long, run_id int, latitude double, longitude double, reports_all_categories int")).collect()}
    want = {("complaint", r[0]) for r in rows if key(r) and (r[8] != n[str(key(r))] or r[9] != int(n[str(key(r))] >= 8))}
    assert got == want | {("pin", 2), ("pin", 4)}
    assert pins.wrong_counts(df.limit(0), spark.createDataFrame(pin_rows[2:4], "pin_id long, run_id int, latitude double, longitude double, reports_all_categories int")).collect()[0].key_id == 4


@pytest.mark.parametrize(("spread", "radius", "block"), [(0.001, 25.0, 5), (0.01, 250.0, 40)])
def test_near_rows(spark, spread, radius, block):
    df, rows = complaints(spark, 500, 3, spread)
    ok = [r for r in rows if r[5] is not None and r[6] is not None and -90 <= r[5] <= 90 and -180 <= r[6] <= 180]
    want = {(a[0], b[0]) for i, a in enumerate(ok) for b in ok[i + 1 :] if a[1] == b[1] and a[5:7] != b[5:7] and metres(a[5:7], b[5:7]) <= radius}
    got = [(r.id_lo, r.id_hi) for r in proximity.near_rows(df, ["run_id"], "rowid_", "latitude", "longitude", radius, block).collect()]
    assert len(got) == len(set(got))
    assert set(got) == want
    assert proximity.near_rows(df.limit(0), ["run_id"], "rowid_", "latitude", "longitude", radius).count() == 0


def test_near_classes(spark):
    df, rows = complaints(spark, 400, 4, 0.002)
    ok = [r for r in rows if r[5] is not None and r[6] is not None and -90 <= r[5] <= 90 and -180 <= r[6] <= 180]
    pairs, members = proximity.near_classes(df, ["run_id"], "rowid_", "latitude", "longitude", 25.0, 6)
    got = {r.rowid_: (r.copies, r.links) for r in members.collect()}
    assert got == {a[0]: (sum(a[1] == b[1] and a[5:7] == b[5:7] for b in ok), sum(a[1] == b[1] and a[5:7] != b[5:7] and metres(a[5:7], b[5:7]) <= 25 for b in ok)) for a in ok}
    assert pairs.count() == pairs.select("run_id", "lat_a", "lon_a", "lat_b", "lon_b").distinct().count()


def test_no_task_gets_more_than_blocks(spark):
    """Two neighbouring places that hold little of the table are cut all the same: no key of rows is larger than a block."""
    rows = [(i, 1, 12.97, 77.59) for i in range(40)] + [(100 + i, 1, 12.9701, 77.59) for i in range(30)] + [(1000 + i, 1, 10.0 + i * 0.01, 70.0) for i in range(900)]
    df = spark.createDataFrame(rows, "id int, run int, la double, lo double")
    assert proximity.near_rows(df, ["run"], "id", "la", "lo", 25.0, 10).count() == 40 * 30
    crowd = skew.crowded(df.groupBy("la", "lo").agg(F.count(F.lit(1)).alias("n")), "n", ["la", "lo"], 10)
    cut = skew.in_own_block(skew.with_blocks(df, crowd, {"la": "la", "lo": "lo"}, "nb"), "nb", F.col("id"), "blk")
    assert crowd[1] == 2 and cut.groupBy("la", "lo", "blk").count().agg(F.max("count")).first()[0] < 25


def test_near_pairs_at_poles_and_meridian(spark):
    rng = random.Random(5)
    points = {(rng.choice([89.9999, -89.9999, 0.0, 60.0]) + rng.uniform(-1e-4, 1e-4) * 0.5, rng.choice([179.9999, -179.9999, rng.uniform(-180, 180)])) for _ in range(250)}
    points = [p for p in points if -90 <= p[0] <= 90]
    df = spark.createDataFrame(points, "lat double, lon double")
    got = {frozenset([(r.lat_a, r.lon_a), (r.lat_b, r.lon_b)]) for r in proximity.near_pairs(df, [], 30.0).collect()}
    want = {frozenset([a, b]) for i, a in enumerate(points) for b in points[i + 1 :] if metres(a, b) <= 30}
    assert got == want and want


RINGS = "ward_id int, rings array<array<struct<lon:double,lat:double>>>"


def square(x, y, s):
    return [(x, y), (x + s, y), (x + s, y + s), (x, y + s), (x, y)]


def test_regions(spark):
    wards = spark.createDataFrame([(1, [square(77.0, 12.0, 0.1), square(77.03, 12.03, 0.02)]), (2, [square(77.1, 12.0, 0.1)]), (3, [square(77.03, 12.03, 0.01)]), (4, None), (None, [square(0.0, 0.0, 1.0)])], RINGS)
    points = spark.createDataFrame([(1, 12.01, 77.01), (2, 12.045, 77.045), (3, 12.035, 77.035), (4, 12.05, 77.15), (5, 12.05, 77.25), (6, None, 77.05), (7, float("nan"), 77.05), (8, 12.05, 77.1)], "id int, latitude double, longitude double")
    got = {r.id: r.w for r in regions.containing_region(points, wards, "latitude", "longitude", "w").collect()}
    assert got == {1: 1, 2: -1, 3: 3, 4: 2, 5: -1, 6: -1, 7: -1, 8: 2}
    assert regions.containing_region(points, wards.limit(0), "latitude", "longitude", "w").where("w = -1").count() == 8


def test_regions_too_many_to_broadcast(spark, monkeypatch):
    monkeypatch.setattr(regions, "BROADCAST_EDGES", 0)
    monkeypatch.setattr(regions, "POINT_BLOCK", 4)
    wards = spark.createDataFrame([(1, [square(77.0, 12.0, 0.1)]), (2, [square(77.05, 12.05, 0.1)])], RINGS)
    points = spark.createDataFrame([(i, 12.07, 77.07) for i in range(30)] + [(100, 12.01, 77.01), (101, None, 1.0), (102, 50.0, 50.0)], "id int, latitude double, longitude double")
    got = {r.id: sorted(r.held) for r in regions.containing_regions(points, wards, "latitude", "longitude", "held").collect()}
    assert got == {**{i: [1, 2] for i in range(30)}, 100: [1], 101: [], 102: []}


def brute_dbscan(points, eps, least):
    near = [[j for j, q in enumerate(points) if metres(p, q) <= eps] for p in points]
    core = [len(x) >= least for x in near]
    label, k = [-1] * len(points), 0
    for i in range(len(points)):
        if not core[i] or label[i] != -1:
            continue
        todo = [i]
        label[i] = k
        while todo:
            for j in near[todo.pop()]:
                if core[j] and label[j] == -1:
                    label[j] = k
                    todo.append(j)
        k += 1
    for i in range(len(points)):
        if not core[i]:
            label[i] = min((label[j] for j in near[i] if core[j]), default=-1)
    return label


@pytest.mark.parametrize(("eps", "least", "spread"), [(250.0, 5, 0.01), (250.0, 5, 0.002), (75.0, 3, 0.003), (1000.0, 10, 0.02), (250.0, 1, 0.02)])
def test_dbscan(spark, eps, least, spread):
    rng = np.random.default_rng(int(eps) + least)
    points = [tuple(map(float, p)) for p in np.round(np.concatenate([rng.normal([12.97, 77.59], spread, (250, 2)), rng.normal([13.0, 77.62], spread / 4, (100, 2)), [[12.97, 77.59]] * 6]), 5)]
    df = spark.createDataFrame([(0, i, *p) for i, p in enumerate(points)] + [(0, 9999, None, 77.0)], "grp int, pid long, lat double, lon double")
    got = {r.pid: r.label for r in density.dbscan(df, [eps], [least]).collect()}
    assert got.pop(9999) == -1
    assert [got[i] for i in range(len(points))] == brute_dbscan(points, eps, least)


def test_dbscan_of_many_configurations(spark, monkeypatch):
    """Several groups, radii and least numbers at once, with crowded cells cut into blocks."""
    monkeypatch.setattr(skew.crowded, "__defaults__", (7,))
    rng = np.random.default_rng(11)
    groups = {g: [tuple(map(float, p)) for p in np.round(np.concatenate([rng.normal([12.97, 77.59], s, (180, 2)), rng.normal([12.99, 77.6], s / 5, (60, 2)), [[12.97, 77.59]] * 6]), 4)] for g, s in ((0, 0.004), (3, 0.01))}
    df = spark.createDataFrame([(g, i, *p) for g, points in groups.items() for i, p in enumerate(points)], "grp int, pid long, lat double, lon double")
    eps, least = [100.0, 250.0, 600.0], [3, 5, 10]
    got = {(r.grp, r.eps, r.least, r.pid): r.label for r in density.dbscan(df, eps, least).collect()}
    assert len(got) == 9 * df.count()
    for g, points in groups.items():
        for e in eps:
            for m in least:
                assert [got[g, e, m, i] for i in range(len(points))] == brute_dbscan(points, e, m), (g, e, m)
    assert density.dbscan(df.limit(0), eps, least).count() == 0


@pytest.mark.parametrize("few", [0, 50, 200_000])
def test_components(spark, monkeypatch, few):
    monkeypatch.setattr(component_operator, "FEW_LINKS", few)
    links = [(i, i + 1) for i in range(0, 40)] + [(100, k) for k in range(101, 160)] + [(7, 7), (200, 201), (201, 200)]
    nodes = spark.createDataFrame([(i,) for i in [*range(41), *range(100, 160), 200, 201, 300]], "node long")
    got = {r.node: r.root for r in components(nodes, spark.createDataFrame(links, "a long, b long")).collect()}
    groups = [set(range(41)), set(range(100, 160)), {200, 201}, {300}]
    assert len(got) == 104 and all(len({got[i] for i in g}) == 1 and got[min(g)] in g for g in groups)
    assert components(nodes.limit(0), spark.createDataFrame(links, "a long, b long").limit(0)).count() == 0


def test_pairs_within_blocks(spark):
    rows = [("a", i) for i in range(25)] + [("b", 1), ("c", 5), ("c", 9), (None, 1), (None, 2)]
    members = stage(spark.createDataFrame(rows, "k string, m int"), "members")
    got = sorted((r.k, r.x, r.y) for r in skew.pairs_within(members, ["k"], "m", 4).collect())
    assert got == sorted([("a", i, j) for i in range(25) for j in range(i + 1, 25)] + [("c", 5, 9)])


def test_trailing_totals(spark):
    rng = random.Random(2)
    daily = [(u, rng.randrange(0, 200), rng.randrange(0, 9)) for u in (1, 2, None) for _ in range(40)] + [(3, None, 5), (3, 4, None), (4, 10, 1)]
    df = spark.createDataFrame(daily, "unit int, day int, x long")
    spans = trailing.trailing_intervals(df, ["unit"], "day", "x", [7, 30])
    got = {(r.unit, r.step): (r.t7, r.t30) for r in trailing.trailing_daily(spans, ["unit"], F.lit(220)).collect()}
    by = defaultdict(lambda: defaultdict(int))
    for u, d, x in daily:
        if d is not None and x is not None:
            by[u][d] += x
    for u, days in by.items():
        for d in range(min(days), 221):
            assert got.pop((u, d)) == tuple(sum(days.get(d - k, 0) for k in range(w)) for w in (7, 30)), (u, d)
    assert not got


def test_busy_wards_and_stale_clusters(spark):
    df, _ = complaints(spark, 500, 9)
    assert {r.kind for r in trailing.busy_wards(df).collect()} <= {"ward"}
    assert trailing.busy_wards(df.limit(0)).count() == 0
    summary = spark.createDataFrame([(1, 1, "3"), (1, 2, " 3 "), (1, 3, "Insufficient data"), (1, 4, None), (1, 5, "0"), (9, 1, "1"), (1, 6, "2.0")], "run_id int, cluster_id int, recent_3_month_count string")
    months = [(1, "cluster", 1, "2021-12", 1), (1, "cluster", 1, "2021-12", 1), (1, "cluster", 1, "2021-11", 2), (1, "cluster", 1, "2021-09", 5), (1, "cluster", 2, "2021-10", 4), (1, "cluster", 5, "2021-09", 4), (1, "cluster", 6, "2021-10", 2), (1, "ward", 1, "2021-12", 7)]
    monthly = spark.createDataFrame(months, "run_id int, unit_type string, unit_id int, month string, pothole_reports int")
    assert [(r.unit_id, r.period) for r in trailing.stale_clusters(summary, monthly).collect()] == [(2, "2021-12")]
    assert trailing.stale_clusters(summary, monthly.limit(0)).count() == 0
