"""Encoding of texts with a public byte-level BPE vocabulary, and back.

Texts are split into words by Spark, each distinct word is encoded once, and ids are joined back by position; decoding
joins ids to their pieces in the same way. The vocabulary file's path is a parameter.
"""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hotloom.llm.positional import distinct_items, from_blocks, to_blocks
from hotloom.session import stage

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: how byte_bpe_50k cuts a text into words. The words together are the text.
WORD = r"(?U)'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def read_vocabulary(path: str) -> dict[bytes, int]:
    with open(path, "rb") as file:
        return {base64.b64decode(piece): int(rank) for piece, rank in (line.split() for line in file if line.strip())}


def _encoder(path: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import tiktoken

        coder = tiktoken.Encoding("words", pat_str=WORD.removeprefix("(?U)"), mergeable_ranks=read_vocabulary(path), special_tokens={})
        for batch in batches:
            words = batch.column(0)
            ids = [coder._encode_single_piece(w) for w in words.to_pylist()]
            yield pa.RecordBatch.from_arrays([words, pa.array(ids, pa.list_(pa.int32()))], names=["item", "value"])

    return encode


def encode(df: DataFrame, key: str, text: str, vocabulary: str = VOCABULARY) -> DataFrame:
    """(key, ids array<int>) of every row. Null and empty texts give an empty list; nothing is trimmed or normalised, and
    strings of special tokens are ordinary text. Rows with repeated keys come out each."""
    words = df.select(key, F.regexp_extract_all(F.col(text), F.lit(WORD), F.lit(0)).alias("words"))
    blocks, number = to_blocks(words, key, "words", pa.string(), "string")
    table = stage(distinct_items(blocks).mapInArrow(_encoder(vocabulary), "item string, value array<int>"), "words")
    return from_blocks(blocks, number, table, "array<int>").select(F.col("key").alias(key), F.col("joined").alias("ids"))


def pieces(spark: SparkSession, vocabulary: str = VOCABULARY) -> DataFrame:
    """(item, value): the vocabulary as a table of id and bytes; its size is the file's, whatever the corpus."""
    rows = [(rank, bytearray(piece)) for piece, rank in read_vocabulary(vocabulary).items()]
    return spark.createDataFrame(rows, "item int, value binary")


def decode(df: DataFrame, key: str, ids: str, vocabulary: str = VOCABULARY) -> DataFrame:
    """(key, text) of every row's ids; an empty or null list gives an empty text. Rows with an unknown id are an error."""
    blocks, number = to_blocks(df, key, ids, pa.int32(), "int")
    table = F.broadcast(pieces(df.sparkSession, vocabulary))
    return from_blocks(blocks, number, table, "binary").select(F.col("key").alias(key), F.decode("joined", "UTF-8").alias("text"))
