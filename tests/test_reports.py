"""Report operators: the values of published examples, and small cases."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from hotloom.functions.planar import to_latlon, to_utm
from hotloom.functions.sphere import haversine
from hotloom.operators import cleaning, quality, series, shapes, sweeps
from hotloom.operators import silhouettes as silhouette_operator
from hotloom.plans import reports, surface
from hotloom.sources import artifacts, raw

#: The monthly target reports of a published city series, January 2019 to July 2022.
COUNTS_SUM = 1982


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_schema_and_taxonomy(spark):
    df = spark.createDataFrame([(66, "Pothole", "Roads"), (66, None, None), (7, "x", "y")], "id int, sub string, cat string")
    with pytest.raises(cleaning.SchemaError, match="address"):
        cleaning.check_columns(df)
    cleaning.check_taxonomy(df, "id", "sub", "cat", {66: ("Roads", "Pothole")})
    with pytest.raises(cleaning.SchemaError):
        cleaning.check_taxonomy(df, "id", "sub", "cat", {66: ("Roads", "Hole")})
    with pytest.raises(cleaning.SchemaError):
        cleaning.check_taxonomy(df.where("sub is null"), "id", "sub", "cat", {66: ("Roads", "Pothole")})


def test_month_first(spark):
    got = spark.createDataFrame([("1-2-2019 06:33",), ("7/31/2022 14:03",), ("garbage",), (None,), ("13-1-2019 1:00",)], "t string").select(F.date_format(cleaning.month_first(F.col("t")), "yyyy-MM-dd HH:mm").alias("x"))
    assert [r.x for r in got.collect()] == ["2019-01-02 06:33", "2022-07-31 14:03", None, None, None]


def test_coordinate_flags(spark):
    df = spark.createDataFrame([(12.97, 77.59), (0.0, 0.0), (77.6, 12.9), (None, 77.5), (95.0, 77.5), (12.9, 77.5), (float("nan"), 77.5)], "lat double, lon double")
    rows = df.select(*[v.alias(k) for k, v in cleaning.coordinate_flags(F.col("lat"), F.col("lon")).items()]).collect()
    assert [r.null_coord for r in rows] == [False, False, False, True, False, False, True]
    assert [r.out_of_range for r in rows] == [False, False, False, True, True, False, True]
    assert [r.zero_zero for r in rows] == [False, True, False, False, False, False, False]
    assert [r.swapped for r in rows] == [False, False, True, False, False, False, False]
    assert [r.decimals for r in rows] == [2, 0, 1, 0, 0, 1, 0]


def test_surrogate_keys(spark):
    keys = [r.k for r in spark.createDataFrame([("a", 1), ("a", 1), ("b", None)], "x string, y int").select(cleaning.surrogate_key(["x", "y"]).alias("k")).collect()]
    assert keys[0] == keys[1] != keys[2] and len(keys[0]) == 16


def test_distance_and_projection(spark):
    assert one(spark, haversine(F.lit(12.97), F.lit(77.59), F.lit(12.98), F.lit(77.59))) == pytest.approx(1111.95, abs=2)
    df = spark.createDataFrame([(12.97, 77.59), (13.05, 77.65), (-33.0, 75.5), (60.0, 74.0)], "lat double, lon double")
    x, y = to_utm("lat", "lon")
    a, b = to_latlon("x", "y")
    for r in df.withColumns({"x": x, "y": y}).withColumns({"a": a, "b": b}).collect():
        assert r.a == pytest.approx(r.lat, abs=1e-8) and r.b == pytest.approx(r.lon, abs=1e-8)
    four = spark.createDataFrame([(1, la, lo) for la in (12.97, 12.971) for lo in (77.59, 77.591)], "g int, lat double, lon double")
    c = shapes.centres(four, ["g"])
    assert c.first().centre_lat == pytest.approx(12.9705, abs=1e-6) and c.first().centre_lon == pytest.approx(77.5905, abs=1e-6)
    assert 50 < shapes.radii(four, c, ["g"]).first().radius_m < 100


def test_hull_buffer_simplify():
    square = np.array([[0, 0], [10, 0], [10, 10], [0, 10], [5, 5], [5, 0]], float)
    assert shapes.area(shapes.hull(square)) == 100
    assert shapes.area(shapes.buffered(shapes.hull(square), 2.0)[:-1]) == pytest.approx(100 + 4 * 10 * 2 + math.pi * 4, rel=0.01)
    assert shapes.area(shapes.hull(np.array([[1.0, 1.0]] * 3))) == 0
    assert shapes.area(shapes.buffered(np.array([[1.0, 1.0]]), 50.0)[:-1]) == pytest.approx(math.pi * 2500, rel=0.01)
    ring = np.array([[0, 0], [5, 0.001], [10, 0], [10, 10], [0, 10], [0, 0]], float)
    assert len(shapes.simplified(ring, 0.01)) == 5


def test_simplified_regions(spark):
    """No point of the old ring is further than the tolerance from the new one, whose points are some of the old."""
    rng = np.random.default_rng(7)
    turn = np.sort(rng.uniform(0, 2 * math.pi, 400))
    ring = np.stack([77.5 + 0.05 * np.cos(turn) + rng.normal(0, 0.0001, 400), 12.9 + 0.05 * np.sin(turn) + rng.normal(0, 0.0001, 400)], axis=1)
    ring = np.vstack([ring, ring[:1]])
    tiny = [(77.0, 12.0), (77.0001, 12.0), (77.0, 12.0001), (77.0, 12.0)]
    rows = [(1, [[tuple(map(float, p)) for p in ring], tiny]), (2, None), (3, [])]
    got = {r.ward_id: r.rings for r in shapes.simplify_regions(spark.createDataFrame(rows, "ward_id int, rings array<array<struct<lon:double,lat:double>>>")).collect()}
    assert got[2] is None and not got[3] and [tuple(p) for p in got[1][1]] == tiny
    new = np.array([tuple(p) for p in got[1][0]])
    assert len(new) < 200 and (new[0] == new[-1]).all() and {tuple(p) for p in new} <= {tuple(p) for p in ring}
    a, d = new[:-1], np.diff(new, axis=0)
    for p in ring:
        t = np.clip(((p - a) * d).sum(axis=1) / np.maximum((d * d).sum(axis=1), 1e-30), 0, 1)
        assert np.hypot(*(a + t[:, None] * d - p).T).min() <= 0.0003 + 1e-12


def test_baselines(spark):
    """Each draw is the rows of the smallest hashes, clustered like any points; mean and deviation over the draws."""
    rng = np.random.default_rng(12)
    pool = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(np.round(rng.normal([12.97, 77.59], 0.004, (160, 2)), 4))], "pid long, lat double, lon double")
    got = {(r.eps, r.least): r for r in sweeps.baselines(pool, 100, [150.0, 300.0], [3, 5], reps=3).collect()}
    assert set(got) == {(e, m) for e in (150.0, 300.0) for m in (3, 5)}
    clusters, noise = {k: [] for k in got}, {k: [] for k in got}
    for rep in range(3):
        drawn = pool.withColumn("h", F.xxhash64("pid", F.lit(rep), F.lit(7))).orderBy("h", "pid").limit(100).drop("h")
        for r in sweeps.labelled(drawn, [150.0, 300.0], [3, 5]).groupBy("eps", "least").agg((F.max("label") + 1).alias("k"), F.count_if(F.col("label") < 0).alias("n")).collect():
            clusters[r.eps, r.least].append(r.k)
            noise[r.eps, r.least].append(r.n)
    for k, r in got.items():
        assert r.baseline_clusters == pytest.approx(np.mean(clusters[k])) and r.baseline_sd == pytest.approx(np.std(clusters[k])) and r.baseline_noise == pytest.approx(np.mean(noise[k]))


def test_hulls_keep_every_corner(spark):
    rng = np.random.default_rng(2)
    lat, lon = to_latlon("x", "y")
    t = 0.3
    along = rng.uniform([0, 0], [1000, 30], (200, 2)) @ np.array([[math.cos(t), math.sin(t)], [-math.sin(t), math.cos(t)]]) + [780000, 1430000]
    round_ = np.array([[781000 + 300 * math.cos(k * math.pi / 500), 1431000 + 300 * math.sin(k * math.pi / 500)] for k in range(1000)])
    rows = [(g, float(x), float(y)) for g, pts in enumerate((along, round_, [[780500, 1430500]] * 2)) for x, y in pts]
    df = spark.createDataFrame(rows, "label int, x double, y double").repartition(5).select("label", lat.alias("lat"), lon.alias("lon"))
    got = {r.label: r for r in shapes.outlines(df, "label").collect()}
    for g, pts in enumerate((along, round_)):
        assert got[g].hull_km2 == pytest.approx(shapes.area(shapes.hull(np.array(pts))) / 1e6, rel=1e-4) and got[g].points == len(pts)
    assert got[2].hull_km2 == 0 and got[2].points == 2


def test_overlapping_outlines_count_each(spark, monkeypatch):
    # two clusters 60 m apart, so the outlines of 50 m overlap; the complaint between them is in both
    lat, lon = to_latlon("x", "y")
    spots = [(0, 780000.0), (0, 780005.0), (1, 780065.0), (1, 780070.0), (None, 780035.0), (None, 780500.0)]
    df = spark.createDataFrame([(k, label, x, 1430000.0) for k, (label, x) in enumerate(spots)], "rowid_ long, label int, x double, y double")
    df = df.select("rowid_", "label", lat.alias("lat"), lon.alias("lon"), F.lit(True).alias("usable"), F.lit(False).alias("pin"), F.col("label").isNotNull().alias("is_target"))
    monkeypatch.setattr(reports, "labels", lambda *_: df.where("label is not null"))
    monkeypatch.setattr(reports, "issues", lambda *_: df)
    got = {r.label: (r.complaints, r.targets) for r in reports.cluster_denominators(spark, "").collect()}
    assert got == {0: (3, 2), 1: (3, 2)}


def test_dense_series_and_share(spark):
    rows = spark.createDataFrame([(1, "2020-01", True), (1, "2020-01", False), (1, "2020-03", True), (2, "2020-02", True), (9, "2020-02", True), (1, None, True)], "w int, month string, t boolean")
    months = series.month_spine(rows, "month")
    got = {(r.unit, r.month): r for r in series.dense_unit_month(rows, "w", months, spark.createDataFrame([(1,), (2,)], "unit int"), F.col("t")).collect()}
    assert len(got) == 6 and got[1, "2020-01"].share == 0.5 and got[2, "2020-01"].share is None and got[2, "2020-02"].target_reports == 1
    assert series.month_spine(rows.limit(0), "month").count() == 0


def test_thresholds(spark):
    assert [one(spark, series.active_threshold(F.lit(x))) for x in (0.05, 0.35, 0.36, 2.0)] == [1, 2, 3, 6]
    assert one(spark, series.persistence_threshold(F.lit(43), F.lit(0.03))) == 5
    assert one(spark, series.persistence_threshold(F.lit(3), F.lit(0.9))) == 4


def test_thresholds_of_large_means(spark):
    for mean in (750.0, 900.0):
        terms = [math.exp(t * math.log(mean) - mean - math.lgamma(t + 1)) for t in range(1001)]
        want = next(t for t in range(1, 1001) if 1 - sum(terms[:t]) <= 0.05)
        assert one(spark, series.active_threshold(F.lit(mean))) == want < 1000
        assert one(spark, series.tail_from(F.lit(mean), F.lit(want))) == pytest.approx(1 - sum(terms[:want]), abs=1e-9)
    assert one(spark, series.active_threshold(F.lit(0.0))) == 1


def test_unions_of_outlines(spark):
    square = lambda x, y, s: np.array([[x, y], [x + s, y], [x + s, y + s], [x, y + s]], float)
    assert shapes.union_area([square(0, 0, 2), square(1, 1, 2)]) == pytest.approx(7)
    assert shapes.union_area([square(0, 0, 4), square(1, 1, 2)]) == pytest.approx(16)
    rng = np.random.default_rng(1)
    rings = [shapes.buffered(shapes.hull(rng.uniform(0, 400, (rng.integers(1, 6), 2)) + rng.uniform(0, 1500, 2)), 50.0) for _ in range(12)]
    at = np.stack(np.meshgrid(np.arange(-100, 2100, 2.0), np.arange(-100, 2100, 2.0)), -1).reshape(-1, 2)
    inside = np.zeros(len(at), bool)
    for r in rings:
        d, rel = np.diff(r, axis=0), at[:, None, :] - r[None, :-1, :]
        inside |= (d[None, :, 0] * rel[..., 1] - d[None, :, 1] * rel[..., 0] >= 0).all(axis=1)
    df = spark.createDataFrame([(k, r.tolist()) for k, r in enumerate(rings)], "label int, outline array<array<double>>")
    assert shapes.dissolved_area(df, "label").first().area_km2 == pytest.approx(inside.sum() * 4 / 1e6, rel=2e-3)
    assert shapes.dissolved_area(df.limit(0), "label").first().area_km2 == 0


def test_cluster_records(spark):
    """Every figure of a cluster's record from its points."""
    rng = np.random.default_rng(9)
    pts = {0: rng.normal([12.97, 77.59], 0.0012, (30, 2)), 1: np.array([[12.9, 77.5]] * 9 + [[12.9001, 77.5001]])}
    rows = [(100 * c + k, float(a), float(b), c) for c, ps in pts.items() for k, (a, b) in enumerate(ps)] + [(999, 12.8, 77.4, -1)]
    labels = spark.createDataFrame(rows, "pid long, lat double, lon double, label int")
    dates = spark.createDataFrame([(r[0], f"2020-01-{r[0] % 28 + 1:02d}") for r in rows if r[0] != 5], "pid long, date string")
    x, y = to_utm("lat", "lon")
    flat = {r.pid: (r.x, r.y) for r in labels.select("pid", x.alias("x"), y.alias("y")).collect()}
    got = {r.label: r for r in sweeps.cluster_records(labels, dates, 250.0).collect()}
    assert set(got) == {0, 1} and got[0].report_count == 30 and got[1].single_coordinate_cluster and not got[0].single_coordinate_cluster
    assert (got[1].distinct_coordinates, got[0].distinct_coordinates) == (2, 30)
    for c, ps in pts.items():
        r, xy = got[c], np.array([flat[p] for p, _, _, label in rows if label == c])
        assert r.bbox_min_lat == ps[:, 0].min() and r.bbox_max_lon == ps[:, 1].max()
        hull = shapes.area(shapes.hull(xy)) / 1e6
        area = max(hull, math.pi * 125**2 / 1e6)
        assert r.boundary_area_km2 == pytest.approx(area) and r.density_reports_per_km2 == pytest.approx(len(ps) / area)
        a, b = to_latlon("x", "y")
        centre = spark.createDataFrame([tuple(map(float, xy.mean(axis=0)))], "x double, y double").select(a.alias("a"), b.alias("b")).first()
        assert (r.centroid_latitude, r.centroid_longitude) == pytest.approx((centre.a, centre.b), abs=1e-9)
        far = max(2 * 6371008.8 * math.asin(math.sqrt(math.sin(math.radians(p - centre.a) / 2) ** 2 + math.cos(math.radians(p)) * math.cos(math.radians(centre.a)) * math.sin(math.radians(q - centre.b) / 2) ** 2)) for p, q in ps)
        assert r.approx_radius_meters == pytest.approx(far, abs=1e-3)
        assert r.boundary[0] == r.boundary[-1] and all(round(v, 5) == v for p in r.boundary for v in p)
    assert got[0].date_min == "2020-01-01" and got[0].date_max == "2020-01-28"


def months(n):
    return [f"{2019 + k // 12}-{k % 12 + 1:02d}" for k in range(n)]


def table_of(spark, units):
    return spark.createDataFrame([(u, m, float(v)) for u, values in units.items() for m, v in zip(months(len(values)), values, strict=True)], "unit string, month string, v double")


def test_recent_activity(spark):
    got = {r.unit: r for r in series.recent_activity(table_of(spark, {"a": [2] * 40 + [4, 4, 4], "b": [1] * 10, "c": [0] * 15 + [1]}), "unit", "v").collect()}
    assert (got["a"].recent_count, got["a"].historical_average, got["a"].change) == (12, 2.0, 1.0)
    assert got["b"].status == series.INSUFFICIENT and got["b"].change is None


def test_trends(spark):
    rng = np.random.default_rng(1)
    units = {"up": [k + 1 for k in range(36)], "noise": rng.poisson(5, 36).tolist(), "tiny": [1] + [0] * 11, "flat": [3] * 20, "spike": [1] * 18 + [60] + [1] * 17}
    got = {r.unit: r for r in series.label_trends(series.trend_stats(table_of(spark, units), "unit", "v")).collect()}
    assert {k: r.trend for k, r in got.items()} == {"up": "Increasing", "noise": "Stable", "tiny": series.INSUFFICIENT, "flat": "Stable", "spike": "Stable"}
    assert got["up"].tau == 1 and got["up"].slope == 1 and got["flat"].p_value == 1
    assert series.exact_tau_p(4, 6) == pytest.approx(2 / 24)


def test_bh(spark):
    got = {r.p: r.q for r in series.bh_adjust(spark.createDataFrame([(0.01,), (0.04,), (0.03,), (None,)], "p double"), "p", "q").collect()}
    assert got[0.01] == pytest.approx(0.03) and got[0.03] == pytest.approx(0.04) and got[0.04] == pytest.approx(0.04) and got[None] is None


def test_sweep_choice_and_warnings(spark):
    cols = "eps double, least int, cluster_count int, noise_percentage double, largest_cluster_share double, max_cluster_radius_m double, single_coordinate_cluster_share double, stability_ari double, cluster_ratio double"
    rows = spark.createDataFrame([(250.0, 5, 76, 70.4, 0.04, 326.0, 0.0, 0.73, 1.6), (200.0, 4, 60, 72.0, 0.04, 326.0, 0.0, 0.70, 1.6), (100.0, 3, 60, 95.0, 0.04, 326.0, 0.0, 0.9, 1.6), (900.0, 3, 2, 5.0, 0.63, 5000.0, 0.5, 0.9, 1.6)], cols).withColumn("warnings", sweeps.sanity_warnings())
    assert sweeps.select_config(rows).first().eps == 250
    assert sweeps.passing(rows).count() == 2
    assert rows.where("eps = 900").first().warnings.count("|") == 3
    assert sweeps.select_config(rows, 100.0, 3).first().eps == 100
    for bad in ((250.0, None), (1.0, 1)):
        with pytest.raises(ValueError):
            sweeps.select_config(rows, *bad)
    with pytest.raises(ValueError):
        sweeps.check_parameters(0, 5)


def test_silhouettes(spark, monkeypatch):
    """Against all pairs; with blocks of a few places, several clusterings, copies, single points and noise."""
    monkeypatch.setattr(silhouette_operator, "BLOCK", 7)
    rng = np.random.default_rng(2)
    pts = np.concatenate([rng.normal([12.97 + 0.01 * k, 77.59], 0.001 * (k + 1), (25, 2)) for k in range(4)] + [[[12.9, 77.5]], [[12.97, 77.59]] * 4])
    kinds = {1: [k // 25 for k in range(100)] + [4] + [0] * 4, 2: [k % 3 - 1 for k in range(105)], 3: [0] * 105, 4: [-1] * 105, 5: list(range(105))}
    df = spark.createDataFrame([(g, i, float(a), float(b), kinds[g][i]) for g in kinds for i, (a, b) in enumerate(pts)], "g int, pid int, lat double, lon double, label int")
    x, y = to_utm("lat", "lon")
    xy = np.array([tuple(r) for r in df.where("g = 1").orderBy("pid").select(x, y).collect()])
    d = np.hypot(xy[:, None, 0] - xy[None, :, 0], xy[:, None, 1] - xy[None, :, 1])

    def brute(labels):
        at = [i for i, c in enumerate(labels) if c >= 0]
        names = {c: [i for i in at if labels[i] == c] for c in {labels[i] for i in at}}
        if len(names) < 2 or len(at) <= len(names):
            return None
        total = 0.0
        for i in at:
            mine = names[labels[i]]
            if len(mine) > 1:
                a = d[i, mine].sum() / (len(mine) - 1)
                b = min(d[i, o].mean() for c, o in names.items() if c != labels[i])
                total += (b - a) / max(a, b)
        return total / len(at)

    got = {r.g: (r.n, r.score) for r in silhouette_operator.silhouettes(df, ["g"]).collect()}
    assert set(got) == {1, 2, 3, 5}
    for g, (n, score) in got.items():
        assert n == sum(c >= 0 for c in kinds[g]) and (score is None if brute(kinds[g]) is None else score == pytest.approx(brute(kinds[g]), abs=1e-9))
    assert silhouette_operator.silhouettes(df.limit(0), ["g"]).count() == 0


def test_sweep_select_takes_the_whole_grid(spark, monkeypatch):
    rng = np.random.default_rng(4)
    df = spark.createDataFrame([(k, float(a), float(b), k < 20) for k, (a, b) in enumerate(rng.normal([12.97, 77.59], 0.002, (50, 2)))], "rowid_ long, lat double, lon double, is_target boolean")
    df = df.withColumns({"usable": F.lit(True), "pin": F.lit(False)})
    drawn, baselines = [], sweeps.baselines

    def recorded(pool, size, eps, least, reps=20):
        drawn.append((len(eps) * len(least), reps))
        return baselines(pool, size, eps, least, 1)

    monkeypatch.setattr(reports, "issues", lambda *_: df)
    monkeypatch.setattr(sweeps, "baselines", recorded)
    rows = reports.sweep_select(spark, "")
    assert {(r.eps, r.least) for r in rows.collect()} == {(float(e), m) for e in sweeps.EPS_METRES for m in sweeps.MIN_SAMPLES}
    reports.baseline(spark, "")
    assert drawn == [(60, 20), (60, 20)]


def test_k_distance_and_hdbscan(spark):
    rng = np.random.default_rng(3)
    pts = np.concatenate([rng.normal([12.97, 77.59], 0.0005, (40, 2)), rng.normal([13.05, 77.65], 0.0005, (40, 2)), [[12.80, 77.40]], [[12.97, 77.59]] * 3])
    df = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(pts)], "pid long, lat double, lon double")
    got = {(r.pid, r.k): r.metres for r in sweeps.k_distances(df, [4, 5]).collect()}
    a, b = np.radians(pts).T
    for i in range(len(pts)):
        h = np.sin((a - a[i]) / 2) ** 2 + np.cos(a[i]) * np.cos(a) * np.sin((b - b[i]) / 2) ** 2
        d = np.sort(2 * 6371008.8 * np.arcsin(np.sqrt(h)))
        assert got[i, 4] == pytest.approx(d[3], abs=1e-6) and got[i, 5] == pytest.approx(d[4], abs=1e-6)
    labels = sweeps.hdbscan_labels(pts[:81, 0], pts[:81, 1], 5)
    assert labels[80] == -1 and len(set(labels[:40]) - {-1}) == 1 and set(labels[:40]) & set(labels[40:80]) <= {-1}


def test_hdbscan_distributed(spark):
    rng = np.random.default_rng(5)
    blobs = [rng.normal([12.97 + 0.02 * k, 77.59], 0.0004 * (k + 1), (60, 2)) for k in range(3)]
    pts = np.concatenate([*blobs, rng.uniform([12.8, 77.4], [13.1, 77.8], (60, 2)), [[12.9, 77.5]] * 6, [[12.91, 77.5]] * 3])
    df = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(pts)] + [(len(pts), None, 77.5)], "pid long, lat double, lon double")
    for least in (3, 5):
        got = {r.pid: r.label for r in sweeps.hdbscan(df, least).collect()}
        want = sweeps.hdbscan_labels(pts[:, 0], pts[:, 1], least)
        assert len(got) == len(pts) + 1 and got[len(pts)] == -1
        assert [got[i] for i in range(len(pts))] == want.tolist() and want.max() >= 2
    assert {r.label for r in sweeps.hdbscan(df.limit(2), 5).collect()} == {-1}


def test_hdbscan_has_no_limit(spark):
    rng = np.random.default_rng(6)
    pts = np.round(np.concatenate([rng.normal([12.9 + 0.05 * k, 77.59], 0.0005, (5200, 2)) for k in range(4)]), 4)
    df = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(pts)], "pid long, lat double, lon double")
    got = {r.pid: r.label for r in sweeps.hdbscan(df, 60).collect()}
    assert len(got) == 20_800
    # no cluster reaches over two of the four places
    assert all(len({p // 5200 for p, x in got.items() if x == label}) == 1 for label in set(got.values()) - {-1}) and len(set(got.values()) - {-1}) >= 4


def test_surface(spark):
    h = spark.createDataFrame([(1, 1, 10, "3", "Stable"), (1, 2, 20, "Insufficient data", "Stable"), (1, 3, 5, None, "Increasing"), (1, 4, 7, "12", "Stable")], "run_id int, cluster_id int, report_count int, recent_3_month_count string, observed_trend string")
    ids = lambda **k: [r.cluster_id for r in surface.hotspots(h, **k).collect()]
    assert ids(sort="recent_3_month_count") == [1, 4, 2, 3]
    assert ids(sort="recent_3_month_count", order="desc") == [2, 3, 4, 1]
    assert ids(sort="report_count", min_reports=7, trend="Stable", limit=2) == [4, 1]
    assert surface.hotspots(h, "report_count", limit=1).first().matched == 4
    for bad in ({"sort": "nope"}, {"order": "up"}, {"limit": 0}, {"min_reports": -1}):
        with pytest.raises(surface.BadQuery):
            surface.hotspots(h, **bad)
    with pytest.raises(surface.NotFound):
        surface.hotspot(h, h, 1, 99)


def test_artifacts_and_nulls(spark, tmp_path):
    df = spark.createDataFrame([(1, float("nan")), (2, float("inf")), (3, 1.5)], "id int, v double")
    artifacts.put_artifact(df, str(tmp_path), "a")
    assert [r.v for r in artifacts.get_artifact(spark, str(tmp_path), "a").orderBy("id").collect()] == [None, None, 1.5]
    assert artifacts.get_artifact(spark, str(tmp_path), "missing") is None
    assert '"v":null' in artifacts.as_json(df).where("payload like '%\"id\":1%'").first().payload


def test_raw_csv_and_kml(spark, tmp_path):
    header = ",".join(cleaning.REQUIRED)
    row = "1-1-2019 06:33,5,caf\xe9 \x96 x,d,66,1,l,a,12.97,77.59,w,1,Roads,Pothole,agency,Open,0"
    (tmp_path / "c.csv").write_bytes(f"{header}\n{row}\n".encode("latin-1"))
    df, encoding = raw.read_raw(spark, str(tmp_path / "c.csv"))
    assert encoding == "windows-1252" and df.first().title == "café – x" and df.first().latitude == 12.97
    (tmp_path / "bad.csv").write_text("a,b\n1,2\n")
    with pytest.raises(cleaning.SchemaError):
        raw.read_raw(spark, str(tmp_path / "bad.csv"))
    kml = """<?xml version="1.0"?><kml xmlns="http://www.opengis.net/kml/2.2"><Document><Placemark><name>Ward 7</name><ExtendedData><SchemaData><SimpleData name="KGISWardName">Seven</SimpleData>
<SimpleData name="Open_Date">31/05/2022</SimpleData><SimpleData name="Latitude">12.9</SimpleData><SimpleData name="Longitude">x</SimpleData></SchemaData></ExtendedData><Polygon><outerBoundaryIs><LinearRing><coordinates>77,12,0 78,12,0 78,13,0 77,12,0</coordinates></LinearRing></outerBoundaryIs>
<innerBoundaryIs><LinearRing><coordinates>77.5,12.1 77.6,12.1 77.6,12.2 77.5,12.1</coordinates></LinearRing></innerBoundaryIs></Polygon></Placemark></Document></kml>"""
    (tmp_path / "w.kml").write_text(kml)
    ward = raw.read_wards(spark, str(tmp_path / "w.kml")).first()
    assert ward.ward_id == 7 and ward.name == "Seven" and [len(r) for r in ward.rings] == [4, 4]
    record = raw.read_records(spark, str(tmp_path / "w.kml")).first()
    assert str(record.open_date) == "2022-05-31" and record.latitude == 12.9 and record.longitude is None
    assert raw.checksums(spark, str(tmp_path / "w.kml")).first().sha256 == raw.sha256_of(tmp_path / "w.kml")


def test_quality_on_empty_and_nulls(spark):
    empty = spark.createDataFrame([], "rowid_ int, run_id int, request_id string, month string, category string, sub_category string, status string, ward_id int, source_ward_id int, lat double, lon double, is_target boolean, in_boundary boolean, usable boolean, pin boolean, mult int, reported string")
    assert quality.monthly_quality(empty).count() == 0
    assert {r.pct for r in quality.coordinate_quality(empty).collect()} == {0.0}
    assert quality.data_gate(empty).first().passed is False
    assert quality.exact_copies(empty).first().copies == 0
