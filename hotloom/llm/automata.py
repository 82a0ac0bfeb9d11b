"""Long spans shared with a reference, by suffix automata: the named method for shared spans, for bounded references.

The reference is cut into shards of whole texts, each becomes one suffix automaton, built once in a task of its own and
broadcast as flat arrays, and every document is streamed through it for the longest match that ends at each character;
stretches none of whose blocks of half a span's length the reference holds are passed over, as no span can lie there.
One pass over all documents is needed per shard, so the work is documents times reference; see README for figures and
for what answers the whole corpus instead.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Characters of reference texts in one automaton (its arrays take about 50 bytes a character, a streaming process some
#: 400), and of all of them.
SHARD_CHARS, MOST_CHARS = 1_000_000, 5_000_000
_CODE_BITS = 21  # a character's code


class SuffixAutomaton:
    """Suffix automaton of several texts (Blumer and others 1985; generalised as Mohri and others 2009), which knows for
    each state whether texts of one owner only hold it."""

    MANY = object()

    def __init__(self) -> None:
        self.next: list[dict[str, int]] = [{}]
        self.link, self.length, self.owner = [-1], [0], [self.MANY]

    def _state(self, length: int, link: int, owner: object, edges: dict[str, int]) -> int:
        self.next.append(edges)
        self.length.append(length)
        self.link.append(link)
        self.owner.append(owner)
        return len(self.next) - 1

    def add(self, text: str, owner: object) -> None:
        last = 0
        for c in text:
            last = self._extend(last, c, owner)
            p = last
            while p > 0 and self.owner[p] is not self.MANY and self.owner[p] != owner:
                self.owner[p] = self.MANY
                p = self.link[p]

    def _clone(self, p: int, c: str, q: int) -> int:
        new = self._state(self.length[p] + 1, self.link[q], self.owner[q], dict(self.next[q]))
        while p != -1 and self.next[p].get(c) == q:
            self.next[p][c] = new
            p = self.link[p]
        self.link[q] = new
        return new

    def _extend(self, last: int, c: str, owner: object) -> int:
        if c in self.next[last]:
            q = self.next[last][c]
            return q if self.length[q] == self.length[last] + 1 else self._clone(last, c, q)
        new = self._state(self.length[last] + 1, 0, owner, {})
        p = last
        while p != -1 and c not in self.next[p]:
            self.next[p][c] = new
            p = self.link[p]
        if p != -1:
            q = self.next[p][c]
            self.link[new] = q if self.length[p] + 1 == self.length[q] else self._clone(p, c, q)
            k = self.link[new]
            while k > 0 and self.owner[k] is not self.MANY and self.owner[k] != owner:
                self.owner[k] = self.MANY
                k = self.link[k]
        return new

    def arrays(self) -> dict[str, np.ndarray]:
        """The automaton as flat arrays: link, length, owner and many per state; key (state and character) and target per
        edge, in the order of the keys."""
        size = np.fromiter((len(e) for e in self.next), np.int64, len(self.next))
        codes = np.fromiter((ord(c) for e in self.next for c in e), np.int64, int(size.sum()))
        target = np.fromiter((t for e in self.next for t in e.values()), np.int32, len(codes))
        key = (np.repeat(np.arange(len(size)), size) << _CODE_BITS) | codes
        order = np.argsort(key)
        many = np.fromiter((o is self.MANY for o in self.owner), bool, len(self.owner))
        owner = np.fromiter((0 if o is self.MANY else o for o in self.owner), np.int64, len(self.owner))
        return {"link": np.array(self.link, np.int32), "length": np.array(self.length, np.int32), "owner": owner, "many": many, "key": key[order], "target": target[order]}


class Stream:
    """Matching statistics from an automaton's flat arrays."""

    def __init__(self, arrays: dict[str, np.ndarray]) -> None:
        self.edges = dict(zip(arrays["key"].tolist(), arrays["target"].tolist(), strict=True))
        self.link, self.length = arrays["link"].tolist(), arrays["length"].tolist()
        self.owner = [None if m else o for o, m in zip(arrays["owner"].tolist(), arrays["many"].tolist(), strict=True)]

    def statistics(self, text: str, owner: int | None = None) -> np.ndarray:
        """Length of the longest match with texts of other owners that ends at each character; with None, of any."""
        edges, link, length, owners = self.edges, self.link, self.length, self.owner
        state, n, out = 0, 0, np.zeros(len(text), np.int64)
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).tolist()
        for k, c in enumerate(codes):
            to = edges.get(state << _CODE_BITS | c)
            while to is None and state:
                state = link[state]
                n = length[state]
                to = edges.get(state << _CODE_BITS | c)
            if to is not None:
                state, n = to, n + 1
            m = n
            if owner is not None:
                p = state
                while p and owners[p] == owner:
                    p = link[p]
                    m = length[p]
            out[k] = m
        return out


def maximal_spans(statistics: np.ndarray, length: int) -> list[tuple[int, int]]:
    """[start, stop) of the matches of at least ``length`` characters that no other match contains."""
    ends = np.flatnonzero(statistics >= length)
    starts = ends - statistics[ends] + 1
    last = np.ones(len(ends), bool)
    last[:-1] = (ends[1:] != ends[:-1] + 1) | (starts[1:] != starts[:-1])
    return list(zip(starts[last].tolist(), (ends[last] + 1).tolist(), strict=True))


def likely_regions(text: str, grams: set[str], width: int) -> list[tuple[int, int]]:
    """[start, stop) of the stretches of a text that can hold spans of 2 * width - 1 characters or more with the
    reference, whose substrings of ``width`` characters are ``grams``.

    Such a span holds a whole block text[k * width : (k + 1) * width] and no block that isn't in grams, so it lies
    between the blocks before and after a run of those that are.
    """
    out: list[tuple[int, int]] = []
    first = last = -2
    for k in range(len(text) // width):
        if text[k * width : (k + 1) * width] in grams:
            if k == last + 1:
                out.pop()
            else:
                first = k
            last = k
            out.append((max(0, (first - 1) * width + 1), min(len(text), (last + 2) * width - 1)))
    return out


_STATE = "shard int, name string, data binary"


def _build(table: pa.Table) -> pa.Table:
    """One shard's automaton as rows (shard, array's name, its bytes)."""
    automaton = SuffixAutomaton()
    for owner, text in zip(table["i"].to_pylist(), table["t"].to_pylist(), strict=True):
        automaton.add(text, owner)
    parts = {name: a.tobytes() for name, a in automaton.arrays().items()} | {"texts": pickle.dumps(table["t"].to_pylist())}
    shard = table["shard"][0].as_py()
    return pa.table({"shard": pa.array([shard] * len(parts), pa.int32()), "name": pa.array(list(parts)), "data": pa.array(list(parts.values()), pa.binary())})


KINDS = {"link": np.int32, "length": np.int32, "owner": np.int64, "many": bool, "key": np.int64, "target": np.int32}


def _streamer(state: Broadcast, length: int, same_ids: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    width = (length + 1) // 2

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = None
        for batch in batches:
            if automaton is None:
                automaton = Stream({name: np.frombuffer(state.value[name], kind) for name, kind in KINDS.items()})
                grams = {t[i : i + width] for t in pickle.loads(state.value["texts"]) for i in range(len(t) - width + 1)}  # noqa: S301 - written by _build
            rows = []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if text is None or len(text) < length:
                    continue
                for low, high in likely_regions(text, grams, width):
                    rows += [(key, low + a, low + b) for a, b in maximal_spans(automaton.statistics(text[low:high], key if same_ids else None), length)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=["doc_id", "start", "stop"])

    return stream


def reference_spans(docs: DataFrame, reference: DataFrame, doc_id: str, text: str, length: int, shard_chars: int = SHARD_CHARS, most: int = MOST_CHARS, same_ids: bool = True) -> DataFrame:
    """(doc_id, start, stop): maximal spans of at least ``length`` characters that a document shares verbatim with
    another text of some shard of the reference.

    Both tables have the id in ``doc_id`` and the text in ``text``. With ``same_ids`` a document isn't compared with the
    reference's text of its own id; else the reference is another collection and all of it counts. The reference's size
    is measured first; more than ``most`` characters are a ValueError, as each shard costs a pass over all documents.
    Null and short texts have no spans; an empty reference gives none. A span that two shards hold comes once.
    """
    spark = docs.sparkSession
    held = reference.where(F.length(text) >= length).select(F.col(doc_id).cast("long").alias("i"), F.col(text).alias("t"))
    chars = held.agg(F.coalesce(F.sum(F.length("t")), F.lit(0))).first()[0]
    if chars > most:
        raise ValueError(f"the reference has {chars} characters, more than {most}")
    # no more rows than characters were counted, so one task may number them
    before = F.coalesce(F.sum(F.length("t")).over(Window.orderBy("i", "t").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shards: dict[int, dict[str, bytes]] = {}
    for row in held.withColumn("shard", F.floor(before / F.lit(shard_chars)).cast("int")).groupBy("shard").applyInArrow(_build, _STATE).collect():
        shards.setdefault(row.shard, {})[row.name] = bytes(row.data)
    texts = docs.select(F.col(doc_id).cast("long"), F.col(text))
    found = spark.createDataFrame([], "doc_id long, start long, stop long")
    for shard in sorted(shards):
        found = found.unionByName(texts.mapInArrow(_streamer(spark.sparkContext.broadcast(shards[shard]), length, same_ids), "doc_id long, start long, stop long"))
    return found.distinct() if len(shards) > 1 else found
