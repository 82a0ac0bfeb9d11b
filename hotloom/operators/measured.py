"""Figures of a sweep over points that fit a task: one task takes a radius with all its least numbers.

Figures are those of sweeps.sweep_metrics, sweeps.stability and silhouettes. For silhouettes, a point's mean distance to a
cluster is at least its distance d to the cluster's centre, and at most the square root of d^2 and the members' mean square
distance from it; other clusters than those that may be nearest by that are left out. Sums of distances to clusters of up
to LARGE places are taken pair by pair. Those to larger ones come from a tree of boxes: near boxes pair by pair, distant
ones by polynomials of NODES nodes in each direction; a test holds such a sum to an error of a few billionths.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hotloom.functions.planar import latlon_of, utm_of
from hotloom.functions.sphere import EARTH_M
from hotloom.operators.gathered import GROUP, _chunks, _heads, _spans
from hotloom.operators.silhouettes import _apart

#: Places of a cluster up to which its distances are added pair by pair.
LARGE = 4_000
#: Places of a leaf, nodes of a box in each direction, and how far, in halves of its longer side, a distant box is from its
#: middle: by each node the error falls to a sixth, as the polynomials' ellipse of convergence has 3 + sqrt(8) of axes.
LEAF, NODES, APART = 192, 10, 3.0
#: Clusters that are summed at once, and how many numbers their columns may have together.
AT_ONCE, COLUMNS = 12, 6_000_000
#: Places of a cluster or lookers at it from which they are a table of their own.
TABLE = 32

_ANGLES = (2 * np.arange(NODES) + 1) * np.pi / (2 * NODES)
_GRID = np.cos(_ANGLES)
_SERIES = np.cos(np.arange(NODES)[:, None] * _ANGLES) * np.where(np.arange(NODES), 2, 1)[:, None] / NODES


def _shares(u: np.ndarray) -> np.ndarray:
    """What each node of a box's side has of a value at u, -1 to 1."""
    return np.cos(np.arccos(np.clip(u, -1, 1))[..., None] * np.arange(NODES)) @ _SERIES


class _Tree:
    """Places halved again and again along the longer side, down to leaves of LEAF or fewer; ``order`` has them by leaf."""

    def __init__(self, x: np.ndarray, y: np.ndarray) -> None:
        n = len(x)
        self.depth = max(0, math.ceil(math.log2(n / LEAF)))
        self.cut = n * np.arange(2**self.depth + 1) // 2**self.depth
        self.order, self.mid, self.half = np.arange(n), [], []
        for level in range(self.depth + 1):
            cut = self.cut[:: 2 ** (self.depth - level)]
            p = np.stack([x[self.order], y[self.order]])
            lo, hi = (f.reduceat(p, cut[:-1], axis=1) for f in (np.minimum, np.maximum))
            self.mid.append((lo + hi) / 2)
            self.half.append(np.maximum((hi - lo) / 2, 1e-3))
            if level < self.depth:
                node = np.repeat(np.arange(len(cut) - 1), np.diff(cut))
                side = np.where((hi[0] - lo[0] >= hi[1] - lo[1])[node], *p)
                self.order = self.order[np.lexsort((side, node))]
        self.x, self.y = x[self.order], y[self.order]

    def sums(self, w: np.ndarray) -> np.ndarray:
        """For each place the sum of distances to all, times each column of weights; rows are in ``order``."""
        last, each = self.depth, w.shape[1]
        at = lambda i, r: [_shares((v[r] - m[i]) / h[i]) for v, m, h in zip((self.x, self.y), self.mid[last], self.half[last], strict=True)]
        rows = [slice(a, b) for a, b in zip(self.cut[:-1], self.cut[1:], strict=True)]
        up = [np.zeros((2**k, each, NODES, NODES)) for k in range(last + 1)]
        down = [np.zeros_like(m) for m in up]
        for i, r in enumerate(rows):
            sx, sy = at(i, r)
            up[last][i] = ((w[r][:, :, None] * sx[:, None]).reshape(-1, each * NODES).T @ sy).reshape(each, NODES, NODES)
        for k in range(last, 0, -1):
            tx, ty = self._to_parent(k)
            both = tx.swapaxes(-1, -2) @ up[k] @ ty
            up[k - 1] += both[::2] + both[1::2]
        far, near = self._pairs()
        for k, (t, s) in enumerate(far):
            self._distant(k, t, s, up[k], down[k])
        up.clear()
        for k in range(1, last + 1):
            tx, ty = self._to_parent(k)
            down[k] += tx @ np.repeat(down[k - 1], 2, axis=0) @ ty.swapaxes(-1, -2)
        out = np.zeros((len(self.x), each))
        for i, r in enumerate(rows):
            sx, sy = at(i, r)
            out[r] = ((sx @ down[last][i]) * sy).sum(axis=-1).T
        for t, s in zip(*(x.tolist() for x in near), strict=True):
            a, b = rows[t], rows[s]
            d = _apart(self.x[a], self.y[a], self.x[b], self.y[b])
            out[a] += d @ w[b]
            if t != s:
                out[b] += d.T @ w[a]
        return out

    def _to_parent(self, k: int) -> list[np.ndarray]:
        """Shares that the parent's nodes have of those of each box of a level, for x and y."""
        mid, half = self.mid[k], self.half[k]
        above = [np.repeat(v[k - 1], 2, axis=1) for v in (self.mid, self.half)]
        return [_shares((mid[i][:, None] + half[i][:, None] * _GRID - above[0][i][:, None]) / above[1][i][:, None])[:, None] for i in (0, 1)]

    def _pairs(self) -> tuple[list[tuple[np.ndarray, np.ndarray]], tuple[np.ndarray, np.ndarray]]:
        """(pairs of distant boxes by level, pairs of near leaves), each pair once; together they hold all pairs of places."""
        t = s = np.zeros(1, np.int64)
        found = []
        for k in range(self.depth + 1):
            mid, half = self.mid[k], self.half[k]
            off = np.abs(mid[:, t] - mid[:, s])
            distant = np.ones(len(t), bool)
            for a, b in ((t, s), (s, t)):
                # from the middle of one to the nearest point of the other
                distant &= np.hypot(*np.maximum(off - half[:, b], 0)) >= APART * half[:, a].max(axis=0)
            found.append((t[distant], s[distant]))
            t, s = t[~distant], s[~distant]
            if k < self.depth:
                t, s = (np.concatenate([2 * v + i for i in kids]) for v, kids in ((t, (0, 0, 1, 1)), (s, (0, 1, 0, 1))))
                once = t <= s
                t, s = t[once], s[once]
        return found, (t, s)

    def _distant(self, k: int, t: np.ndarray, s: np.ndarray, up: np.ndarray, down: np.ndarray) -> None:
        each, size = up.shape[1], NODES * NODES
        grid = self.mid[k][:, :, None] + self.half[k][:, :, None] * _GRID
        for a in range(0, len(t), 8):
            p, q = t[a : a + 8], s[a : a + 8]
            dx, dy = ((grid[i][p][:, :, None] - grid[i][q][:, None]) ** 2 for i in (0, 1))
            d = dx[:, :, None, :, None] + dy[:, None, :, None, :]
            d = np.sqrt(d, out=d).reshape(len(p), size, size)
            to, back = (up[v].reshape(-1, each, size) for v in (p, q))
            np.add.at(down, p, (back @ d.swapaxes(-1, -2)).reshape(-1, each, NODES, NODES))
            np.add.at(down, q, (to @ d).reshape(-1, each, NODES, NODES))


class _Clusters:
    """Clusters of one configuration over places in a tree's order; label is -1 for noise."""

    def __init__(self, x: np.ndarray, y: np.ndarray, w: np.ndarray, label: np.ndarray) -> None:
        self.x, self.y, self.w, self.label = x, y, w, label
        self.k = int(label.max(initial=-1)) + 1
        self.rows = np.flatnonzero(label >= 0).astype(np.int32)
        self.members = self.rows[np.argsort(label[self.rows], kind="stable")]
        self.places = np.bincount(label[self.rows], minlength=self.k)
        self.start = np.cumsum(self.places) - self.places
        of, v = label[self.rows], w[self.rows]
        mean = lambda c: np.bincount(of, c * v, self.k) / self.n
        self.n = np.bincount(of, v, self.k)
        self.cx, self.cy = mean(x[self.rows]), mean(y[self.rows])
        self.square = mean((x[self.rows] - self.cx[of]) ** 2 + (y[self.rows] - self.cy[of]) ** 2)

    def candidates(self) -> tuple[np.ndarray, np.ndarray]:
        """(row, cluster): for each clustered place the other clusters that may be the nearest by their mean distance."""
        found = [(np.zeros(0, np.int32),) * 2]
        for a in range(0, len(self.rows), 1024):
            rows = self.rows[a : a + 1024]
            _, some = self._near(rows, np.zeros(1, np.int64), np.arange(self.k))
            first = np.arange(0, len(rows), 64)
            held = np.diff(np.append(first, len(rows)))
            block, clusters = self._near(rows, first, some)
            for part in _chunks(held[block]):
                i, at = _spans(first[block[part]], (first + held)[block[part]])
                c, p = clusters[part][i], rows[at]
                other = c != self.label[p]
                c, p, at = c[other], p[other], at[other]
                d = (self.x[p] - self.cx[c]) ** 2 + (self.y[p] - self.cy[c]) ** 2
                bound = np.full(len(rows), np.inf)
                np.minimum.at(bound, at, d + self.square[c])
                near = np.sqrt(d) <= np.sqrt(bound[at]) * (1 + 1e-9) + 1e-6
                found.append((p[near], c[near].astype(np.int32)))
        return tuple(np.concatenate(v) for v in zip(*found, strict=True))

    def _near(self, rows: np.ndarray, first: np.ndarray, clusters: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(block, cluster): those of the clusters that may be the nearest other one of a place in blocks of rows, that begin
        at ``first``."""
        held = np.diff(np.append(first, len(rows)))
        x, y = self.x[rows], self.y[rows]
        mx, my = ((np.minimum.reduceat(v, first) + np.maximum.reduceat(v, first)) / 2 for v in (x, y))
        around = np.maximum.reduceat(np.hypot(x - np.repeat(mx, held), y - np.repeat(my, held)), first)
        dx, dy = mx[:, None] - self.cx[clusters], my[:, None] - self.cy[clusters]
        dx *= dx
        dy *= dy
        dx += dy
        # a place's own cluster is none of the others, so the second smallest bound holds for all places of a block
        most = np.add(dx, self.square[clusters], out=dy)
        most[np.arange(len(first)), most.argmin(axis=1)] = np.inf
        reach = (np.sqrt(most.min(axis=1)) + 2 * around) * (1 + 1e-9) + 1e-6
        block, c = np.nonzero(dx <= (reach * reach)[:, None])
        return block, clusters[c]

    def sums(self, row: np.ndarray, cluster: np.ndarray) -> np.ndarray:
        """Sum of the distances of each place to the points of a cluster, pair by pair."""
        out = np.zeros(len(row))
        order = np.argsort(cluster, kind="stable")
        c = cluster[order]
        first = _heads(c)
        lookers = np.diff(np.append(first, len(c)))
        tabled = (lookers >= TABLE) & (self.places[c[first]] >= TABLE)
        for a, n in zip(first[tabled].tolist(), lookers[tabled].tolist(), strict=True):
            m = self.members[self.start[c[a]] : self.start[c[a]] + self.places[c[a]]]
            mx, my, mw = self.x[m], self.y[m], self.w[m]
            step = max(1, 50_000 // len(m))
            for b in range(a, a + n, step):
                some = order[b : min(b + step, a + n)]
                out[some] = _apart(self.x[row[some]], self.y[row[some]], mx, my) @ mw
        rest = order[~np.repeat(tabled, lookers)]
        begin, size = self.start[cluster[rest]], self.places[cluster[rest]]
        for part in _chunks(size):
            i, m = _spans(begin[part], begin[part] + size[part])
            p, m = row[rest[part]][i], self.members[m]
            dx, dy = self.x[p] - self.x[m], self.y[p] - self.y[m]
            out[rest[part]] = np.bincount(i, np.sqrt(dx * dx + dy * dy) * self.w[m], len(rest[part]))
        return out


def mean_silhouettes(x: np.ndarray, y: np.ndarray, w: np.ndarray, labels: list[np.ndarray]) -> list[float | None]:
    """Mean silhouette of each of several clusterings of distinct places of w points; None where it isn't defined."""
    used = np.flatnonzero(np.max(labels, axis=0) >= 0)
    if not len(used):
        return [None] * len(labels)
    # numbers near the middle have more digits to spare
    tree = _Tree(x[used] - x[used].mean(), y[used] - y[used].mean())
    weight = w[used][tree.order].astype(float)
    every = [_Clusters(tree.x, tree.y, weight, label[used][tree.order]) for label in labels]
    large = [(j, k) for j, c in enumerate(every) if c.k >= 2 and c.n.sum() > c.k for k in np.flatnonzero(c.places > LARGE).tolist()]
    # of each clustering, the mean distance to the own cluster and the least to another, and who asks for which large cluster
    own: list[np.ndarray] = []
    other: list[np.ndarray] = []
    asked: list[tuple[np.ndarray, np.ndarray]] = []
    defined = [c.k >= 2 and c.n.sum() > c.k for c in every]
    for c, some in zip(every, defined, strict=True):
        own.append(np.zeros(len(weight) if some else 0))
        other.append(np.full(len(own[-1]), np.inf))
        row, cluster = c.candidates() if some else (np.zeros(0, np.int32),) * 2
        few = c.places[cluster] <= LARGE
        asked.append((row[~few], cluster[~few]))
        if some:
            row, cluster = row[few], cluster[few]
            mine = c.rows[c.places[c.label[c.rows]] <= LARGE]
            far = c.sums(np.append(mine, row), np.append(c.label[mine], cluster))
            own[-1][mine] = far[: len(mine)] / np.maximum(c.n[c.label[mine]] - 1, 1)
            np.minimum.at(other[-1], row, far[len(mine) :] / c.n[cluster])
    step = max(2, min(AT_ONCE, COLUMNS // len(weight)))
    for a in range(0, len(large), step):
        some = large[a : a + step]
        ask = [asked[j][0][asked[j][1] == k] for j, k in some]
        held = [np.flatnonzero(every[j].label == k).astype(np.int32) for j, k in some]
        need = np.zeros(len(weight), bool)
        for rows in ask + held:
            need[rows] = True
        need = np.flatnonzero(need)
        part = _Tree(tree.x[need], tree.y[need])
        need = need[part.order]
        at = np.empty(len(weight), np.int32)
        at[need] = np.arange(len(need))
        got = part.sums(np.stack([np.where(every[j].label[need] == k, weight[need], 0) for j, k in some], axis=1))
        for i, (j, k) in enumerate(some):
            own[j][held[i]] = got[at[held[i]], i] / max(every[j].n[k] - 1, 1)
            other[j][ask[i]] = np.minimum(other[j][ask[i]], got[at[ask[i]], i] / every[j].n[k])
    out: list[float | None] = []
    for c, some, a, b in zip(every, defined, own, other, strict=True):
        if not some:
            out.append(None)
            continue
        size, a, b = c.n[c.label[c.rows]], a[c.rows], b[c.rows]
        most = np.maximum(a, b)
        one = np.where((size > 1) & (most > 0), (b - a) / np.where(most > 0, most, 1), 0)
        out.append(float((one * weight[c.rows]).sum() / weight[c.rows].sum()))
    return out


def _agreement(a: np.ndarray, b: np.ndarray, w: np.ndarray) -> float:
    """The adjusted index of agreement as in sweeps.adjusted_rand."""
    two = lambda n: float((n * (n - 1) / 2).sum())
    x, y = (two(np.bincount(c + 1, w)) for c in (a, b))
    both = (a.astype(np.int64) + 1) * (int(b.max(initial=-1)) + 2) + b + 1
    order = np.argsort(both)
    inner, n = two(np.add.reduceat(w[order], _heads(both[order]))) if len(w) else 0.0, float(w.sum())
    if n < 2:
        return 1.0
    expected, most = x * y / (n * (n - 1) / 2), (x + y) / 2
    return (inner - expected) / (most - expected) if most != expected else 1.0


def _sizes(lat: np.ndarray, lon: np.ndarray, x: np.ndarray, y: np.ndarray, w: np.ndarray, label: np.ndarray) -> list:
    """Clusters, points in them, greatest and median size, greatest radius, clusters of which nine tenths lie at one place."""
    at = np.flatnonzero(label >= 0)
    if not len(at):
        return [0, 0, 0, 0.0, 0.0, 0]
    of, v = label[at], w[at]
    n = np.bincount(of, v)
    mx, my = (np.bincount(of, c[at] * v) / n for c in (x, y))
    la, lo = (np.radians(c)[of] for c in latlon_of(mx, my))
    a, b = np.radians(lat[at]), np.radians(lon[at])
    h = np.sin((la - a) / 2) ** 2 + np.cos(a) * np.cos(la) * np.sin((lo - b) / 2) ** 2
    most = np.zeros(len(n), np.int64)
    np.maximum.at(most, of, v)
    return [len(n), int(n.sum()), int(n.max()), float(np.median(n)), float(2 * EARTH_M * np.arcsin(np.sqrt(min(h.max(), 1)))), int((most >= n * 0.9).sum())]


_KINDS = {"eps": pa.float64(), "least": pa.int32(), "points": pa.int64(), "k": pa.int64(), "s": pa.int64(), "big": pa.int64(), "mid": pa.float64(), "rad": pa.float64(), "single": pa.int64(), "ari": pa.float64(), "silhouette": pa.float64()}


def _measurer(levels: list[int]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def figures(e: float, t: pa.Table) -> pa.RecordBatch:
        flat = lambda c: np.concatenate([p.flatten().to_numpy() for p in t[c].chunks])
        lat, lon, w = (flat(c) for c in ("lat", "lon", "w"))
        sizes = t["w"].combine_chunks().value_lengths().to_numpy()
        # labels come one list after the other, each for all places of its row
        lists = np.split(flat("labels"), np.cumsum(sizes)[:-1] * (last := len(flat("labels")) // max(1, len(w)))) if len(w) else []
        table = [np.concatenate([part.reshape(last, -1)[i] for part in lists]) for i in range(last)] if len(w) else [np.zeros(0, np.int32)] * (2 * len(levels))
        order = np.lexsort((lon, lat))
        lat, lon, w, table = lat[order], lon[order], w[order], [c[order] for c in table]
        noise = int(t["noise"].to_numpy().sum())
        with np.errstate(all="ignore"):
            x, y = utm_of(lat, lon)
        score = mean_silhouettes(x, y, w, table[: len(levels)])
        # what is noise everywhere is one place nowhere
        every = np.append(w, noise)
        rows = []
        for i, k in enumerate(levels):
            nxt = i + len(levels)
            ari = _agreement(np.append(table[i], -1), np.append(table[nxt], -1), every) if nxt < len(table) else None
            rows.append([e, k, int(every.sum()), *_sizes(lat, lon, x, y, w, table[i]), ari, score[i]])
        return pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*rows, strict=True), _KINDS.values(), strict=True)], names=list(_KINDS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        every = pa.Table.from_batches(held)
        held.clear()
        radii = every["eps"].to_numpy()
        for e in np.unique(radii):
            yield figures(e, every.filter(pa.array(radii == e)))

    return run


def measured(packed: DataFrame, bad: DataFrame, eps: list[float], levels: list[int]) -> DataFrame:
    """(eps, least, points, k, s, big, mid, rad, single, ari, silhouette) of the places of gathered.by_radius() and points
    that are noise everywhere: per configuration the clusters and the points in them, greatest and median size, greatest
    radius, clusters of which nine tenths lie at one place, agreement with the next radius, null at the last, and the mean
    silhouette."""
    radii = sorted(float(e) for e in eps)
    empty = {"lat": "array<double>", "lon": "array<double>", "w": "array<int>", "labels": "array<int>"}
    outside = bad.groupBy(GROUP).agg(F.count(F.lit(1)).alias("noise")).select(F.explode(F.array(*[F.lit(e) for e in radii])).alias("eps"), *[F.array().cast(kind).alias(c) for c, kind in empty.items()], "noise")
    rows = packed.unionByName(outside).repartition(len(radii), "eps")
    return rows.mapInArrow(_measurer(sorted(levels)), "eps double, least int, points long, k long, s long, big long, mid double, rad double, single long, ari double, silhouette double")
