"""Round trips and invariants on generated texts."""

import pytest

hypothesis = pytest.importorskip("hypothesis")
from hypothesis import HealthCheck, given, settings  # noqa: E402
from hypothesis import strategies as st  # noqa: E402

from hotloom.llm.leakage import windows, words_of  # noqa: E402
from hotloom.llm.spans import anchor_arrays  # noqa: E402
from hotloom.llm.tokens import decode, encode  # noqa: E402

TEXT = st.text(st.characters(exclude_categories=["Cs"]), max_size=80)


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.one_of(st.none(), TEXT), min_size=40, max_size=120))
def test_encoding_round_trip(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    back = {r.doc_id: r.text for r in decode(encode(df, "doc_id", "text"), "doc_id", "ids").collect()}
    assert back == {i: t or "" for i, t in enumerate(texts)}


@settings(max_examples=200, deadline=None)
@given(TEXT, TEXT, st.text("ab", min_size=30, max_size=60), TEXT, TEXT)
def test_a_shared_span_has_a_shared_anchor(a, b, span, c, d):
    found = list(anchor_arrays([a + span + b, c + span + d], 30, 10))
    held = [{int(h) for rows, _, hs in found for r, h in zip(rows, hs, strict=True) if r == k} for k in (0, 1)]
    assert held[0] & held[1]


@settings(max_examples=200, deadline=None)
@given(TEXT, st.integers(1, 5))
def test_windows_of_words(text, run):
    import re

    words = re.findall("[a-z0-9]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text))
    assert [w.decode() for w in words_of(text.encode())] == words
    assert sum(len(v) for v in windows([(1, text.encode())], run).values()) == max(0, len(words) - run + 1)
