import numpy as np
import pytest
from pyspark.sql import functions as F

from hotloom.operators import gathered, sweeps
from hotloom.operators.density import GROUP, dbscan


@pytest.mark.parametrize("pairs", [50_000, 40])
def test_labels_are_those_of_the_distributed_search(spark, monkeypatch, pairs):
    """Copies, single points, chains, noise, a null and a bad coordinate, several groups; also in small pieces."""
    rng = np.random.default_rng(5)
    spots = np.concatenate([np.round(rng.normal([12.97, 77.59], 0.006, (400, 2)), 4), rng.normal([12.99, 77.62], 0.0004, (150, 2)), [[12.9, 77.5]] * 6, [[60.1, 10.0]], [[13.1 + 0.0006 * k, 77.5] for k in range(12)]])
    pids = rng.permutation(len(spots))
    rows = [(g, int(i), float(a), float(b)) for g in (0, 1) for i, (a, b) in zip(pids, spots, strict=True) if g == 0 or i % 3]
    rows += [(1, 5000, None, 77.5), (1, 5001, 95.0, 77.5), (2, 0, None, None)]
    df = spark.createDataFrame(rows, f"{GROUP} int, pid long, lat double, lon double").repartition(3)
    eps, least = [75.0, 250.0, 30.0, 1000.0], [3, 5, 10]
    monkeypatch.setattr(gathered, "FEW_POINTS", 0)
    want = {tuple(r) for r in dbscan(df, eps, least).collect()}
    counts = {tuple(r) for r in sweeps.counted(df, eps, least).collect()}
    monkeypatch.undo()
    assert len(want) == len(rows) * len(eps) * len(least)
    found = list(gathered._labeller(eps, least, False)(df.where("lat between -90 and 90").orderBy(GROUP).toArrow().to_batches())) if pairs < 100 else None
    if found is not None:
        monkeypatch.setattr(gathered, "PAIRS", pairs)
        again = list(gathered._labeller(eps, least, False)(df.where("lat between -90 and 90").orderBy(GROUP).toArrow().to_batches()))
        key = lambda bs: sorted((r["grp"], r["pid"], tuple(r["labels"])) for b in bs for r in b.to_pylist())
        assert key(found) == key(again)
    else:
        assert {tuple(r) for r in dbscan(df, eps, least).collect()} == want
        assert {tuple(r) for r in sweeps.counted(df, eps, least).collect()} == counts


def test_baselines_stage_no_more_than_the_draws(spark, monkeypatch):
    """Of a pool drawn from many times only what is drawn is written, not the pool for each repetition."""
    staged = []
    whole = sweeps.stage
    monkeypatch.setattr(sweeps, "stage", lambda df, name, *a: staged.append(whole(df, name, *a)) or staged[-1])
    pool = spark.range(2000).select(F.col("id").alias("pid"), (12.9 + F.rand(1) / 10).alias("lat"), (77.5 + F.rand(2) / 10).alias("lon"))
    rows = sweeps.baselines(pool, 100, [500.0], [3], reps=4).collect()
    assert len(rows) == 1 and sum(d.count() for d in staged if GROUP in d.columns or "rep" in d.columns) == 400


def test_labels_of_a_grid_are_one_row_a_point(spark, monkeypatch):
    """A grid's labels are written once for each point, not for each configuration, and come out for each."""
    staged = []
    whole = sweeps.stage
    monkeypatch.setattr(sweeps, "stage", lambda df, name, *a: staged.append(whole(df, name, *a)) or staged[-1])
    points = spark.createDataFrame([(1, 12.9, 77.5), (2, 12.9, 77.5), (3, 12.9001, 77.5), (4, 13.0, 77.5), (5, None, 77.5)], "pid long, lat double, lon double")
    got = {(r.eps, r.least, r.pid): r.label for r in sweeps.labelled(points, [5.0, 50.0], [2, 3]).collect()}
    assert [d.count() for d in staged] == [5]
    near = {(e, k): (0 if (e, k) != (5.0, 3) else -1) for e in (5.0, 50.0) for k in (2, 3)}
    assert got == {(e, k, p): (near[e, k] if p in (1, 2) or (p == 3 and e == 50.0) else -1) for e, k in near for p in range(1, 6)}


def test_large_draws_are_not_written(spark, monkeypatch):
    """Draws read from the pool give the figures of those that are written, each in a task of its own; the pool is written once."""
    rng = np.random.default_rng(3)
    at = [(i, float(a), float(b)) for i, (a, b) in enumerate(np.round(rng.uniform([12.9, 77.5], [13.0, 77.6], (2000, 2)), 2))]
    pool = spark.createDataFrame([*at, (5000, None, 77.5), (5001, 95.0, 77.5)], "pid long, lat double, lon double")
    order = lambda d: sorted(tuple(r) for r in d.collect())
    for size in (900, 2002, 9000):
        want = order(sweeps.baselines(pool, size, [100.0, 500.0], [3, 9], reps=4))
        staged, tasks = [], []
        with monkeypatch.context() as m:
            whole, labelling = sweeps.stage, sweeps.labelling
            m.setattr(sweeps, "FEW_DRAWN", 0)
            m.setattr(sweeps, "stage", lambda df, name, *a: staged.append(whole(df, name, *a)) or staged[-1])
            m.setattr(sweeps, "labelling", lambda rows, *a, **k: tasks.extend(rows.groupBy(F.spark_partition_id()).agg(F.count_distinct(GROUP)).toPandas().iloc[:, 1]) or labelling(rows, *a, **k))
            assert order(sweeps.baselines(pool, size, [100.0, 500.0], [3, 9], reps=4)) == [tuple(pytest.approx(v) for v in r) for r in want]
        assert tasks == [1] * 4 and sum(d.count() for d in staged if "lat" in d.columns) == 2002
    assert sweeps.baselines(pool.limit(0), 5, [100.0], [3]).count() == 0


def test_rows_by_radius_hold_no_noise(spark, monkeypatch):
    """Places of a radius that are clustered at it or the next come in lists, in small pieces too; the others are counted."""
    rows = [(0, i, 12.9 + 0.0001 * i, 77.5) for i in range(5)] + [(0, 9, 12.9, 77.5), (0, 10, 13.0, 77.5), (0, 11, 13.001, 77.5), (0, 12, 13.2, 77.5)]
    df = spark.createDataFrame(rows, f"{GROUP} int, pid long, lat double, lon double")
    got = gathered.by_radius(df, [200.0, 5.0, 20.0], [2, 3]).collect()
    size = {e: (sum(sum(r.w) for r in got if r.eps == e), sum(r.noise for r in got if r.eps == e)) for e in (5.0, 20.0, 200.0)}
    assert size == {5.0: (6, 3), 20.0: (8, 1), 200.0: (8, 1)}
    assert all(len(r.labels) == len(r.lat) * (2 if r.eps == 200.0 else 4) for r in got)
    monkeypatch.setattr(gathered, "PACKED", 2)
    at = np.arange(6.0)
    parts = [b.to_pylist()[0] for b in gathered._rows(5.0, at, at + 70, np.full(6, 3), [np.array([-1, 0, 1, -1, 1, 0]), np.array([-1, -1, 2, -1, 0, -1])])]
    assert [(p["lat"], p["w"], p["labels"], p["noise"]) for p in parts] == [([1.0, 2.0], [3, 3], [0, 1, -1, 2], 6), ([4.0, 5.0], [3, 3], [1, 0, 0, -1], 0)]
    monkeypatch.setattr(gathered, "FEW_POINTS", 8)
    assert gathered.by_radius(df, [5.0], [2]) is None


def test_links_of_two_cells_come_once(monkeypatch):
    """Crowded neighbouring cells join their clusters by one link for each least number, not by one for each pair of places."""
    seen = []
    whole = gathered._links
    monkeypatch.setattr(gathered, "_links", lambda *a: (seen.append(len(x[1])) or x for x in whole(*a)))
    lat, lon = np.concatenate([np.full(40, 12.9) + np.arange(40) * 1e-7, np.full(40, 12.9007) + np.arange(40) * 1e-7]), np.full(80, 77.5)
    found = list(gathered.count_group(lat, lon, np.ones(80, np.int64), [100.0], [3, 5]))
    assert found == [(100.0, 3, 1, 80), (100.0, 5, 1, 80)] and seen == [1, 1]
