import numpy as np
import pytest
from pyspark.sql import functions as F

from hotloom.functions import planar
from hotloom.operators import density, measured, silhouettes, sweeps


def brute(x, y, w, label):
    at = np.flatnonzero(label >= 0)
    names = np.unique(label[at])
    if len(names) < 2 or w[at].sum() <= len(names):
        return None
    d = np.hypot(x[:, None] - x, y[:, None] - y)
    far = {c: d[:, label == c] @ w[label == c] for c in names}
    size = {c: w[label == c].sum() for c in names}
    total = 0.0
    for i in at:
        if size[label[i]] > 1:
            a = far[label[i]][i] / (size[label[i]] - 1)
            b = min(far[c][i] / size[c] for c in names if c != label[i])
            total += w[i] * (b - a) / max(a, b) if max(a, b) else 0
    return total / w[at].sum()


@pytest.mark.parametrize("large", [5, 10_000])
def test_mean_silhouettes(monkeypatch, large):
    """Against all pairs, with sums of large clusters from the tree and without; crowds, lines, copies, single points."""
    monkeypatch.setattr(measured, "LARGE", large)
    monkeypatch.setattr(measured, "LEAF", 20)
    monkeypatch.setattr(measured, "AT_ONCE", 3)
    rng = np.random.default_rng(6)
    xy = np.concatenate([rng.normal(0, 20, (400, 2)), rng.normal(5000, 900, (500, 2)), np.stack([np.arange(100.0) * 30, np.full(100, 700.0)], 1), rng.uniform(-20000, 20000, (300, 2))])
    xy = xy[rng.permutation(len(xy))] + [780_000, 1_430_000]
    x, y, w = xy[:, 0], xy[:, 1], rng.integers(1, 40, len(xy))
    near = (np.hypot(x - 780_000, y - 1_430_000) < 9000).astype(int)
    kinds = [near, near * 2 - 1, rng.integers(-1, 3, len(x)), np.digitize(x, np.quantile(x, np.linspace(0, 1, 90)[1:-1])), np.full(len(x), -1), np.zeros(len(x), int), np.arange(len(x)), np.where(np.arange(len(x)) < 5, np.arange(len(x)), -1)]
    kinds[1] = np.where(kinds[1] > 0, rng.integers(0, 2, len(x)), -1)
    for weight in (w, np.ones(len(x), int)):
        got = measured.mean_silhouettes(x, y, weight, kinds)
        for score, label in zip(got, kinds, strict=True):
            want = brute(x, y, weight, label)
            assert score is None if want is None else score == pytest.approx(want, abs=1e-8)
    assert measured.mean_silhouettes(x, y, w, [kinds[4]] * 2) == [None, None]


def test_sums_of_distances():
    """The tree's sums against all pairs, within the promised error, over crowds and wide ground at once."""
    rng = np.random.default_rng(8)
    x, y = np.concatenate([rng.normal(0, 50, (2000, 2)), rng.normal(4000, 5, (1000, 2)), rng.uniform(-20000, 20000, (3000, 2))]).T
    tree = measured._Tree(x, y)
    w = rng.integers(0, 5, (len(x), 2)).astype(float)
    want = np.hypot(tree.x[:, None] - tree.x, tree.y[:, None] - tree.y) @ w
    assert np.abs(tree.sums(w) / want - 1).max() < 4e-9


def test_projection_of_arrays(spark):
    lat, lon = np.array([12.97, -33.1, 0.0, 60.2]), np.array([77.59, 78.0, 74.9, 70.1])
    df = spark.createDataFrame(zip(lat.tolist(), lon.tolist(), strict=True), "lat double, lon double")
    x, y = planar.utm_of(lat, lon)
    assert np.array([tuple(r) for r in df.select(*planar.to_utm("lat", "lon")).collect()]).T == pytest.approx(np.array([x, y]), abs=1e-6)
    assert np.array(planar.latlon_of(x, y)) == pytest.approx(np.array([lat, lon]), abs=1e-9)


def test_sweep_of_few_points_writes_no_row_for_each_point(spark, monkeypatch):
    """The figures of the distributed operators, but only rows of configurations are written."""
    rng = np.random.default_rng(5)
    pts = np.concatenate([rng.normal([12.97, 77.59], 0.001, (80, 2)), rng.normal([12.99, 77.60], 0.002, (80, 2)), rng.uniform([12.9, 77.5], [13.0, 77.7], (60, 2)), [[12.97, 77.59]] * 9, [[95.0, 77.0]] * 2]).tolist()
    points = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate([*pts, (None, 77.0)])], "pid long, lat double, lon double")
    eps, least = [100.0, 250.0, 2000.0], [3, 8]
    labels = sweeps.labelled(points, eps, least)
    want = sweeps.sweep_metrics(labels, ["eps", "least"]).join(sweeps.stability(labels), ["eps", "least"], "left").withColumn("warnings", sweeps.sanity_warnings())
    want = want.join(silhouettes.silhouettes(labels, ["eps", "least"]).select("eps", "least", F.col("score").alias("silhouette")), ["eps", "least"], "left")
    order = lambda df: [tuple(r) for r in df.orderBy("eps", "least").collect()]
    want, columns = order(want), want.dtypes
    staged = []
    for module in (sweeps, silhouettes, density):
        whole = module.stage
        monkeypatch.setattr(module, "stage", lambda df, name, *a, whole=whole: staged.append(whole(df, name, *a)) or staged[-1])
    rows = sweeps.sweep(points, None, eps, least)
    assert rows.dtypes == columns
    for got, old in zip(order(rows), want, strict=True):
        assert got == tuple(pytest.approx(v, abs=1e-6) if isinstance(v, float) else v for v in old)
    assert sum(df.count() for df in staged) <= len(eps) * len(least)
    assert sweeps.sweep(points.limit(0), None, eps, least).count() == 0
    assert {r.stability_ari for r in sweeps.sweep(points, None, [250.0], [5]).collect()} == {None}
