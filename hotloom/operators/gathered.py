"""Density clusters of groups that fit a task: one task takes a group and labels it in all configurations.

Radii are gone through in ascending order. A place that has reached the greatest least number looks no further, and what
is linked at a radius stays linked at greater ones, so only cells of different clusters are compared again. Labels are
those of density.dbscan.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hotloom.functions.sphere import EARTH_M
from hotloom.operators.components import least_numbers

#: Column of the group.
GROUP = "grp"
#: Places of a row of by_radius().
PACKED = 5_000
#: Points that a group may have to be labelled by one task (300 MB there for 700,000); larger ones are distributed.
FEW_POINTS = 1_500_000
#: Labels that a task may hold at once, where all of a group come out together.
FEW_LABELS = 18_000_000
#: Links that are kept before clusters are joined.
MOST_JOINS = 300_000
#: Pairs of places that are measured at once; they stay in the processor's cache.
PAIRS = 50_000


def _spans(first: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, value): for each row the whole numbers from first to stop - 1."""
    n = stop - first
    row = np.repeat(np.arange(len(n)), n)
    return row, np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n) + first[row]


def _heads(values: np.ndarray) -> np.ndarray:
    """Where each run of equal values begins."""
    return np.flatnonzero(np.append(True, values[1:] != values[:-1])) if len(values) else np.zeros(0, np.int64)


def _chunks(sizes: np.ndarray) -> Iterator[slice]:
    """Slices of rows that have about PAIRS together, one row at least."""
    ends, at = np.cumsum(sizes), 0
    while at < len(ends):
        stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PAIRS, side="right")))
        yield slice(at, stop)
        at = stop


class _Places:
    """Places (radians, distinct) and which of them are near, with the great-circle distance of functions.sphere."""

    def __init__(self, lat: np.ndarray, lon: np.ndarray) -> None:
        self.lat, self.lon = lat, lon
        self.a, self.b = np.radians(lat), np.radians(lon)
        self.v = [np.cos(self.a) * np.cos(self.b), np.cos(self.a) * np.sin(self.b), np.sin(self.a)]

    def near(self, p: np.ndarray, q: np.ndarray, eps: float) -> np.ndarray:
        chord = np.zeros(len(p))
        for v in self.v:
            apart = v[p]
            apart -= v[q]
            apart *= apart
            chord += apart
        limit = (2 * math.sin(min(eps / (2 * EARTH_M), math.pi / 2))) ** 2
        doubt = 1e-9 + 1e-14 / math.sqrt(limit) + 1e-9 * (limit > 3.9)
        inside = chord <= limit
        close = np.flatnonzero(np.abs(chord - limit) <= limit * doubt) if limit < 3.9 else np.arange(len(p))
        if len(close):
            i, j = p[close], q[close]
            h = np.sin((self.a[j] - self.a[i]) / 2) ** 2 + np.cos(self.a[i]) * np.cos(self.a[j]) * np.sin((self.b[j] - self.b[i]) / 2) ** 2
            inside[close] = 2 * EARTH_M * np.arcsin(np.sqrt(np.minimum(h, 1))) <= eps
        return inside

    def cells(self, eps: float) -> tuple[np.ndarray, int, int]:
        """(cell of each place, cells of a band, cells to either side that eps reaches): places of a cell are within eps,
        and eps reaches two bands."""
        height = math.degrees(eps / (math.sqrt(2) * EARTH_M)) * (1 - 1e-6)
        edge = np.abs(self.lat)
        width = height / math.cos(math.radians(edge.min()))
        ratio = math.sin(min(eps / (2 * EARTH_M), math.pi / 2)) * (1 + 1e-9) / math.cos(math.radians(edge.max()))
        reach = math.ceil((math.degrees(math.asin(ratio)) * 2 if ratio < 1 else 360.0) / width + 1e-6)
        band, cell = (np.floor((x - x.min()) / d).astype(np.int64) for x, d in ((self.lat, height), (self.lon, width)))
        stride = int(cell.max()) + 2 * reach + 1
        return band * stride + cell + reach, stride, reach


def sweep_group(lat: np.ndarray, lon: np.ndarray, w: np.ndarray, eps: list[float], levels: list[int]) -> Iterator[tuple[float, int, np.ndarray]]:
    """(radius, least number, label of each place) in ascending order; -1 is noise.

    Places are distinct and in the order of their smallest id, which numbers the clusters.
    """
    every, n = np.arange(len(lat), dtype=np.int32), len(lat)
    for e, k, c, border_p, border_q in _grown(lat, lon, w, eps, levels):
        rank = np.cumsum(c == every, dtype=np.int32) - 1
        label = np.where(c >= 0, rank[c], n)
        edge = (c[border_p] < 0) & (c[border_q] >= 0)
        np.minimum.at(label, border_p[edge], rank[c[border_q[edge]]])
        label[label == n] = -1
        yield e, k, label


def count_group(lat: np.ndarray, lon: np.ndarray, w: np.ndarray, eps: list[float], levels: list[int]) -> Iterator[tuple[float, int, int, int]]:
    """(radius, least number, clusters, points that aren't noise) as of sweep_group()."""
    every = np.arange(len(lat), dtype=np.int32)
    for e, k, c, border_p, border_q in _grown(lat, lon, w, eps, levels):
        held = c >= 0
        held[border_p[held[border_q]]] = True
        yield e, k, np.count_nonzero(c == every), int(w @ held)


def _grown(lat: np.ndarray, lon: np.ndarray, w: np.ndarray, eps: list[float], levels: list[int]) -> Iterator[tuple[float, int, np.ndarray, np.ndarray, np.ndarray]]:
    """(radius, least number, first place of each dense place's cluster or -1, p, q) in ascending order; places p that
    aren't dense at the greatest number have q, dense at the least, within the radius. Arrays change when the next is taken."""
    # places are numbered in 32 bits, what is held for each of them fills most of a task's memory
    n, most, at = len(lat), max(levels), _Places(lat, lon)
    comp = {k: np.full(n, -1, np.int32) for k in sorted(levels)}
    weight = np.zeros(n, np.int64)
    low = min(levels)
    for e in sorted(eps):
        key, stride, reach = at.cells(e)
        order = np.argsort(key).astype(np.int32)
        start = _heads(key[order])
        cell, stop = key[order[start]], np.append(start[1:], n)
        full = np.add.reduceat(w[order], start) >= most
        of = np.repeat(np.arange(len(cell), dtype=np.int32), stop - start)
        weight[order[full[of]]] = most
        # those that don't have the greatest number yet count around them
        rows = np.flatnonzero(weight[order] < most).astype(np.int32)
        look, mine = order[rows], of[rows]
        head = _heads(mine)
        used, back = mine[head], np.repeat(np.arange(len(head)), np.diff(np.append(head, len(mine))))
        ranges = []
        for band in range(-2, 3):
            a, b = np.searchsorted(cell, cell[used] + band * stride - reach), np.searchsorted(cell, cell[used] + band * stride + reach, side="right")
            ends = np.append(start, n)
            ranges.append((ends[a], ends[b]))
        first, last = (np.stack([r[i] for r in ranges], axis=1) for i in (0, 1))
        edges_p, edges_q = [], []
        for part in _chunks((last - first).sum(axis=1)[back]):
            row, value = _spans(first[back[part]].ravel(), last[back[part]].ravel())
            row //= 5
            p, q = look[part][row], order[value]
            ok = at.near(p, q, e)
            row, p, q = row[ok], p[ok], q[ok]
            got = np.bincount(row, weights=w[q], minlength=len(look[part])).astype(np.int64)
            weight[look[part]] = np.minimum(got, most)
            few = got[row] < most
            edges_p.append(p[few])
            edges_q.append(q[few])
        dense = [weight[q] >= low for q in edges_q]
        border_p, border_q = (np.concatenate([x[d] for x, d in zip(xs, dense, strict=True)]) if xs else np.zeros(0, np.int32) for xs in (edges_p, edges_q))
        edges_p, edges_q, dense = [], [], []
        for k, c in comp.items():
            new = (weight >= k) & (c < 0)
            c[new] = np.flatnonzero(new)
        # dense places of a cell belong together
        for c in comp.values():
            held = c[order]
            dense = np.flatnonzero(held >= 0)
            if len(dense):
                held, begin = held[dense], _heads(of[dense])
                _unite(c, held, np.repeat(np.minimum.reduceat(held, begin), np.diff(np.append(begin, len(held)))))
        dense = order[weight[order] >= low]
        begin = _heads(key[dense])
        cells = key[dense[begin]]
        end = np.append(begin[1:], len(dense))
        held: dict[int, np.ndarray] = {}
        moved, joined = set(comp), {k: [] for k in comp}
        for band in range(3):
            for k in moved:
                held[k] = np.maximum.reduceat(comp[k][dense], begin) if len(dense) else np.zeros(0, np.int64)
            moved = set()
            a = np.searchsorted(cells, cells + band * stride - (reach if band else -1))
            b = np.searchsorted(cells, cells + band * stride + reach, side="right")
            for part in _chunks(b - a):
                one, two = _spans(a[part], b[part])
                one += part.start
                open_ = np.zeros(len(one), bool)
                for h in held.values():
                    open_ |= (h[one] >= 0) & (h[two] >= 0) & (h[one] != h[two])
                one, two = one[open_], two[open_]
                size = (end - begin)[one] * (end - begin)[two]
                for some in _chunks(size):
                    for k, x, y in _links(at, e, comp, weight, dense, begin, end, one[some], two[some]):
                        joined[k].append((x, y))
                if sum(len(x) for x, _ in joined[low]) > MOST_JOINS:
                    moved |= _flush(comp, joined)
            moved |= _flush(comp, joined)
        for k, c in comp.items():
            yield e, k, c, border_p, border_q


def _unite(comp: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Join clusters a and b, named by their first places."""
    apart = a != b
    if apart.any():
        a, b = a[apart], b[apart]
        # numbered by marks instead of by sorting, as there are many links of the same clusters
        mark = np.zeros(len(comp), bool)
        mark[a] = mark[b] = True
        nodes = np.flatnonzero(mark)
        number = np.empty(len(comp), np.int32)
        number[nodes] = np.arange(len(nodes))
        roots = nodes[least_numbers(number[a], number[b], len(nodes))]
        to = np.append(np.arange(len(comp), dtype=np.int32), np.int32(-1))  # noise, -1, stays
        to[nodes] = roots
        comp[:] = to[comp]


def _flush(comp: dict[int, np.ndarray], joined: dict[int, list]) -> set[int]:
    """Join what is linked; the least numbers that had links."""
    some = {k for k, pairs in joined.items() if pairs}
    for k in some:
        _unite(comp[k], *(np.concatenate([x[i] for x in joined[k]]) for i in (0, 1)))
        joined[k].clear()
    return some


def _links(at: _Places, eps: float, comp: dict[int, np.ndarray], weight: np.ndarray, dense: np.ndarray, begin: np.ndarray, end: np.ndarray, one: np.ndarray, two: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(least number, a, b): clusters with dense places within eps in the pairs of cells one, two. A large pair of cells
    comes alone and is measured in pieces."""
    pieces = [(begin[one], end[one])]
    if len(one) == 1 and (width := int(end[two[0]] - begin[two[0]])) * int(end[one[0]] - begin[one[0]]) > PAIRS:
        cut = np.append(np.arange(int(begin[one[0]]), int(end[one[0]]), max(1, PAIRS // width)), int(end[one[0]]))
        pieces = [(cut[i : i + 1], cut[i + 1 : i + 2]) for i in range(len(cut) - 1)]
    known = set()
    for first, last in pieces:
        row, x = _spans(first, last)
        inner, y = _spans(begin[two][row], end[two][row])
        p, q = dense[x[inner]], dense[y]
        ok = at.near(p, q, eps)
        p, q = p[ok], q[ok]
        level = np.minimum(weight[p], weight[q])
        for k, c in comp.items():
            a, b = c[p[level >= k]], c[q[level >= k]]
            apart = a != b
            if len(pieces) > 1 and apart.any():
                # places of a cell are of one cluster, so one link settles the pair
                known.add(k)
                yield k, a[apart][:1], b[apart][:1]
            elif apart.any():
                # links of the same two cells join the same clusters and follow each other
                a, b = a[apart], b[apart]
                first = np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1]))
                yield k, a[first], b[first]
        if len(known) == len(comp):
            return


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Scalar, pa.Table]]:
    """Each run of rows of the same first column."""
    held: list[pa.RecordBatch] = []

    def taken() -> tuple[pa.Scalar, pa.Table]:
        group, t = held[0].column(0)[0], pa.Table.from_batches(held)
        held.clear()
        return group, t

    for batch in batches:
        if not batch.num_rows:
            continue
        codes = batch.column(0).dictionary_encode(null_encoding="encode").indices.to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(codes)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if held and held[0].column(0)[0].as_py() != batch.column(0)[a].as_py():
                yield taken()
            held.append(batch.slice(a, b - a))
    if held:
        yield taken()


def _labeller(eps: list[float], levels: list[int], counts: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group, t in _groups(batches):
            pid, lat, lon = (t.column(c).to_numpy() for c in (1, 2, 3))
            order = np.lexsort((lon, lat) if counts else (pid, lon, lat))
            y, x = lat[order], lon[order]
            if counts:
                kind = t.schema.field(0).type
                del t, pid, lat, lon, order
            head = np.flatnonzero(np.append(True, (y[1:] != y[:-1]) | (x[1:] != x[:-1])))
            if counts:
                # neighbours stay together, as nothing is numbered
                rows = count_group(y[head], x[head], np.diff(np.append(head, len(y))), eps, levels)
                cols = [pa.array(c, kind) for c, kind in zip(zip(*rows, strict=True), (pa.float64(), pa.int32(), pa.int64(), pa.int64()), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array([group.as_py()] * len(cols[0]), kind), *cols], names=["grp", "eps", "least", "clusters", "held"])
                continue
            by_id = np.argsort(pid[order][head], kind="stable")
            place = np.empty(len(pid), np.int64)
            to = np.empty(len(head), np.int64)
            to[by_id] = np.arange(len(head))
            place[order] = np.repeat(to, np.diff(np.append(head, len(y))))
            found = sweep_group(y[head][by_id], x[head][by_id], np.bincount(place), eps, levels)
            table = np.stack([label.astype(np.int32) for _, _, label in found], axis=1)
            for a in range(0, len(pid), 10_000):
                part = table[place[a : a + 10_000]]
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(part) + 1, dtype=np.int32) * table.shape[1]), pa.array(part.ravel()))
                some = t.slice(a, len(part)).combine_chunks()
                yield pa.RecordBatch.from_arrays([*[c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in some.columns[:4]], lists], names=["grp", "pid", "lat", "lon", "labels"])

    return run


def _packer(eps: list[float], levels: list[int]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, t in _groups(batches):
            pid, lat, lon = (t.column(c).to_numpy() for c in (1, 2, 3))
            del t
            order = np.lexsort((pid, lon, lat))
            lat, lon, pid = lat[order], lon[order], pid[order]
            head = np.flatnonzero(np.append(True, (lat[1:] != lat[:-1]) | (lon[1:] != lon[:-1])))
            w = np.diff(np.append(head, len(lat))).astype(np.int32)
            lat, lon, pid = lat[head], lon[head], pid[head]
            by_id = np.argsort(pid, kind="stable").astype(np.int32)
            # labels of places in the order of their coordinates, where neighbours' labels are alike
            place = np.empty(len(by_id), np.int32)
            place[by_id] = np.arange(len(by_id))
            del pid, order, head
            last: tuple[float, list[np.ndarray]] | None = None
            now: list[np.ndarray] = []
            for e, _, label in sweep_group(lat[by_id], lon[by_id], w[by_id], eps, levels):
                now.append(label.astype(np.int32)[place])
                if len(now) == len(levels):
                    if last:
                        yield from _rows(last[0], lat, lon, w, last[1] + now)
                    last, now = (e, now), []
            if last:
                yield from _rows(last[0], lat, lon, w, last[1])

    return run


def _rows(e: float, lat: np.ndarray, lon: np.ndarray, w: np.ndarray, labels: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    """Rows of PACKED places each that aren't noise in all labels; the first has the points of those that are."""
    used = np.flatnonzero(reduce(np.maximum, labels) >= 0)
    noise = int(w.sum(dtype=np.int64) - w[used].sum(dtype=np.int64))
    one = lambda v, kind: pa.ListArray.from_arrays(pa.array([0, len(v)], pa.int32()), pa.array(v, kind))
    for a in range(0, max(1, len(used)), PACKED):
        some = used[a : a + PACKED]
        table = np.concatenate([label[some] for label in labels])
        yield pa.RecordBatch.from_arrays([pa.array([e]), one(lat[some], pa.float64()), one(lon[some], pa.float64()), one(w[some], pa.int32()), one(table, pa.int32()), pa.array([0 if a else noise], pa.int64())], names=["eps", "lat", "lon", "w", "labels", "noise"])


def fits_task(n: int, lat: list[float], lon: list[float], eps: list[float]) -> bool:
    """Whether a task can take n points with latitudes and longitudes up to these: no more than FEW_POINTS, not near a pole or
    around the earth."""
    return n <= FEW_POINTS and max(lat) <= 80 and max(lon) <= 175 and max(eps) <= 200_000


def fits(points: DataFrame, eps: list[float], labels: int = 0) -> int | None:
    """The number of groups of points (grp, lat, lon), in range, if a task can take each, with ``labels`` for each point if
    all come out together; None if one doesn't fit."""
    stats = points.groupBy(GROUP).agg(F.count(F.lit(1)).alias("n"), F.max(F.abs("lat")).alias("y"), F.max(F.abs("lon")).alias("x"))
    seen = stats.agg(F.count(F.lit(1)).alias("groups"), F.max("n").alias("n"), F.max("y").alias("y"), F.max("x").alias("x")).first()
    if seen["groups"] and (seen["n"] * labels > FEW_LABELS or not fits_task(seen["n"], [seen["y"]], [seen["x"]], eps)):
        return None
    return seen["groups"]


def by_radius(points: DataFrame, eps: list[float], levels: list[int]) -> DataFrame | None:
    """(eps, lat, lon, w, labels, noise) of points (grp, pid, lat, lon) of one group, in range: for each radius, rows with some
    thousand places that are clustered at it or at the next radius, lists of their coordinates, their points and their labels,
    for each least number and again for each of the next radius, in ascending order; and how many points aren't. None if
    the group doesn't fit a task."""
    if fits(points, eps) is None:
        return None
    rows = points.select(GROUP, F.col("pid").cast("long").alias("pid"), "lat", "lon").repartition(1)
    return rows.mapInArrow(_packer([float(e) for e in eps], sorted(levels)), "eps double, lat array<double>, lon array<double>, w array<int>, labels array<int>, noise long")


def gathered(points: DataFrame, eps: list[float], levels: list[int], counts: bool = False) -> DataFrame | None:
    """(grp, pid, lat, lon, labels) of points (grp, pid, lat, lon), in range: a label for each radius and, within it, each
    least number in ascending order; with ``counts`` (grp, eps, least, clusters, held), held being the points that aren't
    noise. None if a group doesn't fit a task; groups are few."""
    groups = fits(points, eps, 0 if counts else len(eps) * len(levels))
    if groups is None:
        return None
    rows = points.select(GROUP, F.col("pid").cast("long").alias("pid"), "lat", "lon").repartition(max(1, groups), GROUP).sortWithinPartitions(GROUP)
    return labelling(rows, eps, levels, counts)


def labelling(rows: DataFrame, eps: list[float], levels: list[int], counts: bool) -> DataFrame:
    """gathered() of rows of which each partition has whole groups, one after the other."""
    kind = rows.schema[GROUP].dataType.simpleString()
    schema = f"grp {kind}, eps double, least int, clusters long, held long" if counts else f"grp {kind}, pid long, lat double, lon double, labels array<int>"
    return rows.mapInArrow(_labeller([float(e) for e in eps], sorted(levels), counts), schema)
