import random

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from hotloom.llm.positional import distinct_items, from_blocks, to_blocks
from hotloom.llm.tokens import VOCABULARY, decode, encode, read_vocabulary

tiktoken = pytest.importorskip("tiktoken")

TEXTS = [
    None, "", " ", "  ", "\n", "a", " a", "a ", "don't we'll I'M they'RE 's", "x  y   z\t\tw \n\n v", "<|endoftext|> and <|endoftext|>", "naïve café déjà ﬁ ½ Ⅷ ٣٤", "a b c　d\u0085e", "日本語のテキスト 한국어",
    "é ​ ﻿", "😀👩‍👩‍👧 🇮🇳", "\x00\x1c\x1d\x1e\x1f\x7f", "''s''t 's's", "1234567890 3.14 1,000", "--- *** ///", "word " * 3000, "long" * 5000, " " * 5000 + "x",
]


@pytest.fixture(scope="module")
def plain():
    import public_tokenizers as public

    return tiktoken.Encoding("plain", pat_str=public.PATTERN, mergeable_ranks=read_vocabulary(VOCABULARY), special_tokens={})


def random_texts(n):
    rng = random.Random(4)
    alphabet = "abc XYZ 012 .,'\"\n\t\r éß   ष्ट्र 漢字 😀 'll 's"
    return ["".join(rng.choice(alphabet) for _ in range(rng.randrange(60))) for _ in range(n)]


def test_ids_are_the_tokenizers(spark, plain):
    texts = TEXTS + random_texts(400)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.ids for r in encode(df, "doc_id", "text").collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        assert got[i] == (plain.encode_ordinary(t) if t else []), repr(t)


def test_same_ids_as_the_other_library(spark):
    tokenizers = pytest.importorskip("tokenizers")
    import public_tokenizers as public

    other = tokenizers.Tokenizer.from_file(public.path("byte_bpe_50k.json"))
    other.encode_special_tokens = True
    texts = [t for t in TEXTS if t]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.ids for r in encode(df, "doc_id", "text").collect()}
    assert [got[i] for i in range(len(texts))] == [e.ids for e in other.encode_batch(texts, add_special_tokens=False)]


def test_round_trip_repeated_keys_and_empty_table(spark):
    texts = TEXTS[1:] + random_texts(100)
    df = spark.createDataFrame([(i // 2, t, "extra") for i, t in enumerate(texts)], "doc_id long, text string, ids string")
    back = decode(encode(df, "doc_id", "text"), "doc_id", "ids")
    assert sorted((r.doc_id, r.text) for r in back.collect()) == sorted((i // 2, t) for i, t in enumerate(texts))
    assert encode(df.limit(0), "doc_id", "text").count() == 0
    assert decode(spark.createDataFrame([(1, None), (2, [])], "doc_id long, ids array<int>"), "doc_id", "ids").where("text = ''").count() == 2


def test_blocks_of_any_size(spark):
    rng = random.Random(1)
    rows = [(i, [rng.choice("abcdefg") for _ in range(rng.randrange(12))] if i % 5 else None) for i in range(60)]
    df = spark.createDataFrame(rows, "k long, items array<string>")
    for most in (1, 7, 1000):
        blocks, number = to_blocks(df, "k", "items", pa.string(), "string", most)
        table = distinct_items(blocks).selectExpr("item", "array(ascii(item), 0) as value")
        got = {r.key: r.joined for r in from_blocks(blocks, number, table, "array<int>").collect()}
        assert got == {k: [x for w in v or [] for x in (ord(w), 0)] for k, v in rows}


def test_few_blocks_are_read_at_once(spark, monkeypatch):
    """The reader decodes a whole row group of blocks, so a file of many must be in several; batches don't cut blocks."""
    df = spark.range(0, 600, 1, 1).selectExpr("id as k", "array('a', 'b', string(id % 7)) as items")
    blocks, number = to_blocks(df, "k", "items", pa.string(), "string", 30)
    groups = [g.num_rows for f in blocks.inputFiles() for m in [pq.read_metadata(f.removeprefix("file:"))] for g in map(m.row_group, range(m.num_row_groups))]
    assert sum(groups) == number == 60 and max(groups) <= 8
    assert {len(r.keys) for r in blocks.select("keys").collect()} == {10}
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000"
