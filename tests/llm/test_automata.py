import random

import pytest

from hotloom.llm.automata import Stream, SuffixAutomaton, maximal_spans, reference_spans


def brute(text, others):
    return [max((n for n in range(k + 1, 0, -1) if any(text[k + 1 - n : k + 1] in o for o in others)), default=0) for k in range(len(text))]


def test_statistics_with_other_owners():
    rng = random.Random(1)
    for size in (2, 3, 20):
        texts = ["".join(rng.choice("abcdefghijklmnopqrst"[:size]) for _ in range(rng.randrange(0, 60))) for _ in range(8)]
        texts.append(texts[0])
        automaton = SuffixAutomaton()
        for owner, text in enumerate(texts):
            automaton.add(text, owner)
        for owner, text in enumerate(texts):
            assert Stream(automaton.arrays()).statistics(text, owner).tolist() == brute(text, [t for o, t in enumerate(texts) if o != owner]), (size, owner)


def test_reference_spans(spark):
    rng = random.Random(2)
    phrase = "".join(rng.choice("abcdef ") for _ in range(50))
    docs = [(k, "".join(rng.choice("abcdef ") for _ in range(40)) + (phrase[: rng.randrange(20, 51)] if k % 2 else "") + "x" * (k % 3)) for k in range(20)] + [(50, None), (51, "")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {(r.doc_id, r.start, r.stop) for r in reference_spans(df, df, "doc_id", "text", 25, shard_chars=10**6).collect()}
    want = set()
    for k, text in docs:
        others = [t for j, t in docs if j != k and t]
        for a in range(len(text or "")):
            for b in range(a + 25, len(text) + 1):
                hit = lambda x, y: x >= 0 and y <= len(text) and any(text[x:y] in o for o in others)  # noqa: E731, B023
                if hit(a, b) and not hit(a - 1, b) and not hit(a, b + 1):
                    want.add((k, a, b))
    assert got == want and want


def test_reference_of_other_texts(spark):
    docs = spark.createDataFrame([(1, "abc" + "q" * 30 + "xyz"), (2, None), (3, ""), (4, "😀" * 12)], "doc_id long, text string")
    items = spark.createDataFrame([(1, "q" * 12), (4, "😀" * 10), (5, None), (6, "short")], "doc_id long, text string")
    for chars in (5, 10**6):  # a shard for each text, and one for all
        got = sorted(tuple(r) for r in reference_spans(docs, items, "doc_id", "text", 10, shard_chars=chars, same_ids=False).collect())
        assert got == [(1, k, k + 12) for k in range(3, 22)] + [(4, k, k + 10) for k in range(3)]
    assert reference_spans(docs, items.limit(0), "doc_id", "text", 10, same_ids=False).count() == 0
    with pytest.raises(ValueError, match="characters"):
        reference_spans(docs, items, "doc_id", "text", 10, most=5)


def test_maximal_spans_of_nothing():
    import numpy as np

    assert maximal_spans(np.zeros(0, np.int64), 5) == [] and maximal_spans(np.array([1, 2, 3]), 5) == []
