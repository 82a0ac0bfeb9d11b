"""Shared spans against a suffix automaton of each other text, which gives the matching statistics exactly."""

import random

import numpy as np
import pytest

from hotloom.llm import queries, spans

L, G = 30, 10


class Automaton:
    """Suffix automaton of one text (Blumer and others 1985)."""

    def __init__(self, text):
        self.next, self.link, self.length, last = [{}], [-1], [0], 0
        for c in text:
            cur = len(self.next)
            self.next.append({})
            self.length.append(self.length[last] + 1)
            self.link.append(0)
            p = last
            while p != -1 and c not in self.next[p]:
                self.next[p][c] = cur
                p = self.link[p]
            if p != -1:
                q = self.next[p][c]
                if self.length[p] + 1 == self.length[q]:
                    self.link[cur] = q
                else:
                    clone = len(self.next)
                    self.next.append(dict(self.next[q]))
                    self.length.append(self.length[p] + 1)
                    self.link.append(self.link[q])
                    while p != -1 and self.next[p].get(c) == q:
                        self.next[p][c] = clone
                        p = self.link[p]
                    self.link[q] = self.link[cur] = clone
            last = cur

    def statistics(self, text):
        """Length of the longest match that ends at each character."""
        state, n, out = 0, 0, []
        for c in text:
            while state and c not in self.next[state]:
                state = self.link[state]
                n = self.length[state]
            if c in self.next[state]:
                state, n = self.next[state][c], n + 1
            out.append(n)
        return out


def truth(docs, length):
    docs = [(d, t) for d, t in docs if t is not None]
    pairs, covered = set(), {}
    for d, t in docs:
        hit = np.zeros(len(t), bool)
        for e, u in docs:
            if e == d:
                continue
            stats = Automaton(u).statistics(t)
            for k, n in enumerate(stats):
                if n >= length:
                    pairs.add((min(d, e), max(d, e)))
                    hit[k - n + 1 : k + 1] = True
        if hit.any():
            edges = np.flatnonzero(np.diff(np.concatenate([[0], hit.astype(int), [0]])) == 1)
            covered[d] = (len(edges), int(hit.sum()))
    return pairs, covered


def corpus(seed, alphabet):
    rng = random.Random(seed)
    text = lambda n: "".join(rng.choice(alphabet) for _ in range(n))
    phrases = [text(rng.choice([29, 30, 31, 45, 90])) for _ in range(8)]
    docs = [(0, None), (1, ""), (2, "x" * 29), (3, "x" * 30), (4, "y" + "x" * 60), (5, phrases[0] * 3), (6, " \n" * 40), (7, "ab" * 60), (8, "b" + "ab" * 20)]
    for d in range(9, 60):
        docs.append((d, "".join(rng.choice([text(rng.randrange(50)), rng.choice(phrases)]) for _ in range(rng.randrange(6)))))
    docs += [(60 + k, docs[20][1]) for k in range(3)] + [(70, phrases[1]), (71, phrases[1]), (72, "é😀" * 20), (73, "z" + "é😀" * 20)]
    return docs


@pytest.mark.parametrize(("seed", "alphabet", "crowd"), [(1, "abcdefghijk ", 5000), (2, "ab", 5000), (3, "abcdefghijk ", 3), (4, "aé😀", 2)])
def test_pairs_and_coverage(spark, seed, alphabet, crowd):
    docs = corpus(seed, alphabet)
    df = spark.createDataFrame([(d, t, "clash", 1) for d, t in docs], "doc_id long, text string, anchor string, n int")
    pairs, covered = truth(docs, L)
    got = [tuple(r) for r in spans.sharing_pairs(df, "doc_id", "text", L, G, crowd).collect()]
    assert len(got) == len(set(got)) and set(got) == pairs
    found = {r.doc_id: (r.passages, r.shared_chars) for r in spans.coverage(df, "doc_id", "text", L, G, crowd).collect()}
    assert found == covered


def test_equal_hashes_dont_make_pairs(spark, monkeypatch):
    """With hashes of a single bit nearly all windows collide; the texts themselves decide on the pairs, above the limit
    of crowded anchors, too."""
    docs = corpus(3, "abcdefghijk ")
    df = spark.createDataFrame(docs, "doc_id long, text string")
    pairs, _ = truth(docs, L)
    real = spans.window_table
    spread = spans._spreader(L, G)

    def dull(batches):
        import numpy as np
        import pyarrow as pa

        for b in spread(batches):
            one = pa.array(np.zeros(b.num_rows, np.int64))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), one, one, b.column(4), b.column(5), pa.nulls(b.num_rows, pa.int64())], names=["anchor", "shift", "h", "g", "doc", "start", "was"])

    monkeypatch.setattr(spans, "_spreader", lambda *_: dull)
    got = {tuple(r) for r in spans.sharing_pairs(df, "doc_id", "text", L, G, 2).collect()}
    assert got == pairs and spans.window_table is real


def test_many_copies_and_classes(spark):
    base = "".join(random.Random(5).choice("abcdefgh ") for _ in range(80))
    docs = [(k, base) for k in range(25)] + [(100 + k, base[:40] + "!" * 9) for k in range(12)] + [(200, base[:35] + "?"), (201, "other"), (202, None)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    want = {(a, b) for a, t in docs for b, u in docs if a < b and t and u and (t == u or (t[:30] == u[:30])) and len(t) >= 30 and len(u) >= 30}
    got = [tuple(r) for r in spans.sharing_pairs(df, "doc_id", "text", L, G, block=4).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    pairs, members = spans.sharing_classes(df, "doc_id", "text", L, G)
    assert {tuple(r) for r in pairs.collect()} == {(0, 100), (0, 200), (100, 200)}
    assert {(r.doc_id, r["class"], r.copies, r.links) for r in members.collect()} == {(k, 0, 25, 13) for k in range(25)} | {(100 + k, 100, 12, 26) for k in range(12)} | {(200, 200, 1, 37)}


def test_coverage_of_every_document(spark, monkeypatch):
    same = "".join(random.Random(3).choice("abcdefgh ") for _ in range(400))
    df = spark.createDataFrame([(1, same), (2, same + "x"), (3, "short"), (4, None), (5, "")], "doc_id long, text string")
    monkeypatch.setattr(queries, "table", lambda *_: df)
    got = {r.doc_id: (r.passages, r.shared_chars, r.share) for r in queries.p8_coverage(spark, "").collect()}
    assert got == {1: (1, 400, 1.0), 2: (1, 400, 400 / 401), 3: (0, 0, 0.0), 4: (0, 0, 0.0), 5: (0, 0, 0.0)}


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert spans.sharing_pairs(df, "doc_id", "text").count() == 0
    assert spans.coverage(df, "doc_id", "text").count() == 0


def test_anchors_of_long_texts_dont_depend_on_pieces():
    rng = random.Random(1)
    texts = ["".join(rng.choice("abc") for _ in range(n)) for n in (29, 30, 500, 2000)] + [None]
    collect = lambda chunk: sorted({(int(r), int(p), int(h)) for rows, at, hs in spans.anchor_arrays(texts, L, G, chunk) for r, p, h in zip(rows, at, hs, strict=True)})
    whole = collect(1 << 16)
    assert {r for r, _, _ in whole} == {1, 2, 3}
    # every span of the length holds an anchor, whichever pieces the text was cut into
    for chunk in (64, 100, 1 << 16):
        at = {}
        for r, p, _ in collect(chunk):
            at.setdefault(r, set()).add(p)
        for r in (1, 2, 3):
            assert all(any(q in at[r] for q in range(s, s + L - G + 1)) for s in range(len(texts[r]) - L + 1))
        assert set(whole) == set(collect(chunk)) or chunk < 1 << 16
