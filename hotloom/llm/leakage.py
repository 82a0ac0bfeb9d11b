"""Test items found in training texts by one Aho-Corasick automaton.

All runs of a given number of words of the items, normalised, are the automaton's patterns; every text is normalised
and scanned once. Positions map back to the original text.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Words in a row that make a match, and how many characters of items one automaton takes; more items take more scans.
RUN_WORDS, AUTOMATON_CHARS = 12, 4_000_000
#: Lower-case a-z and digits stay, A-Z become lower case, every other byte separates words.
_FOLD = bytes(c if chr(c) in "abcdefghijklmnopqrstuvwxyz0123456789" else c + 32 if 65 <= c <= 90 else 32 for c in range(256))


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_FOLD).split()


def windows(items: list[tuple[int, bytes]], run: int) -> dict[str, list[tuple[int, int]]]:
    """Pattern to the (item, number of its first word) that have it; items of fewer words have none."""
    found: dict[str, list[tuple[int, int]]] = defaultdict(list)
    for item, text in items:
        w = [x.decode("ascii") for x in words_of(text)]
        for i in range(len(w) - run + 1):
            found[f" {' '.join(w[i : i + run])} "].append((item, i))
    return dict(found)


def _automaton(patterns: dict[str, list[tuple[int, int]]]):
    import ahocorasick

    a = ahocorasick.Automaton()
    for pattern, at in patterns.items():
        a.add_word(pattern, (len(pattern), at))
    a.make_automaton()
    return a


def _spans(text: bytes, plain: str, hits: list[tuple[int, list[tuple[int, int]]]], run: int) -> list[tuple[int, int, int, int]]:
    """Maximal matches (item, first character, character after the last, words) in characters of the original text."""
    starts: dict[int, int] = {}  # place in plain of the blank before a word -> the word's number
    for number, m in enumerate(re.finditer(" (?=[^ ])", plain)):
        starts[m.start()] = number
    chains: dict[tuple[int, int], list[int]] = defaultdict(list)
    for start, at in hits:
        for item, i in at:
            chains[item, starts[start] - i].append(starts[start])
    bounds = [(m.start(), m.end()) for m in re.finditer(rb"[a-z0-9]+", text.translate(_FOLD))]
    out = []
    for (item, _), firsts in chains.items():
        firsts = sorted(set(firsts))
        k = 0
        while k < len(firsts):
            e = k
            while e + 1 < len(firsts) and firsts[e + 1] == firsts[e] + 1:
                e += 1
            b, c = bounds[firsts[k]][0], bounds[firsts[e] + run - 1][1]
            out.append((item, len(text[:b].decode()), len(text[:c].decode()), firsts[e] - firsts[k] + run))
            k = e + 1
    return out


def _scanner(items: Broadcast, run: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        patterns = windows(items.value, run)
        automaton = _automaton(patterns) if patterns else None
        for batch in batches:
            rows = []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if text is None or automaton is None:
                    continue
                plain = f" {b' '.join(words_of(text)).decode('ascii')} "
                hits = [(end - length + 1, at) for end, (length, at) in automaton.iter(plain)]
                if hits:
                    rows += [(item, key, b, e, n) for item, b, e, n in _spans(text, plain, hits, run)]
            if rows:
                kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["item_id", "doc_id", "start", "stop", "words"])

    return scan


def leaked_spans(docs: DataFrame, doc_id: str, text: str, items: DataFrame, item_id: str, item_text: str, run: int = RUN_WORDS, most: int = AUTOMATON_CHARS) -> DataFrame:
    """(item_id, doc_id, start, stop, words): the maximal runs of at least ``run`` words of an item in a text, with the
    characters [start, stop) of the original.

    The items' size is measured first: up to ``most`` characters they make one automaton, beyond that as many as
    needed, each scanning the texts once. Null texts and items, and items of fewer words, match nothing; a run that
    occurs twice comes out twice; of items that resemble each other each comes out. No items give no rows.
    """
    held = items.select(F.col(item_id).cast("long").alias("i"), F.encode(F.col(item_text), "UTF-8").alias("t")).where(F.col("i").isNotNull() & F.col("t").isNotNull()).distinct()
    chars = held.agg(F.coalesce(F.sum(F.length("t")), F.lit(0))).first()[0]
    parts = max(1, -(-chars // most))
    texts = docs.where(F.col(text).isNotNull()).select(F.col(doc_id).cast("long"), F.encode(F.col(text), "UTF-8"))
    found = None
    for part in range(parts):
        own = held.where(F.pmod(F.xxhash64("i"), F.lit(parts)) == part) if parts > 1 else held
        # the tasks make the patterns; the driver only passes on a part's texts, of about ``most`` characters
        part_items = docs.sparkSession.sparkContext.broadcast([(r.i, bytes(r.t)) for r in own.orderBy("i").toLocalIterator()])
        one = texts.mapInArrow(_scanner(part_items, run), "item_id long, doc_id long, start int, stop int, words int")
        found = one if found is None else found.unionByName(one)
    return found
