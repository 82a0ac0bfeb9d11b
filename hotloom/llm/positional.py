"""Replace each item of long lists by its entry in a table, through an equi-join on distinct items.

Lists are packed into blocks that hold every distinct item once and a code per position, so the join moves one row per
block and distinct item instead of one per position, and values are put back by position.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hotloom.session import arrow_rows, stage_counted

#: Positions in a block at most, a single longer list excepted; its distinct items and their values fit a task.
BLOCK_ITEMS = 250_000
#: Blocks that one task puts together again, about 0.5 MB each; so tasks grow in number with the corpus, not in size.
BLOCKS_A_TASK = 8
#: Lists that go to Python at once, and blocks that are read at once: either is held decoded, so it is kept to some MB
#: whatever the size of files and partitions.
BATCH_LISTS = 500
GROUP_BLOCKS = 8
#: Lists in a block at most, however short they are.
MOST_LISTS = 10_000


def _values(a: pa.Array) -> pa.Array:
    return a.combine_chunks() if isinstance(a, pa.ChunkedArray) else a


def _packer(item: pa.DataType, most: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    schema = pa.schema([("block", pa.int64()), ("keys", pa.list_(pa.int64())), ("counts", pa.list_(pa.int32())), ("codes", pa.list_(pa.int32())), ("items", pa.list_(item))])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        held, waiting = [], 0
        for batch in chain(batches, [None]):
            if batch is not None:
                held.append((batch.column(0), batch.column(1)))
                waiting += len(batch.column(1).flatten())
                if waiting < most and sum(len(k) for k, _ in held) < MOST_LISTS:
                    continue
            if not held:
                return
            keys, lists = (pa.concat_arrays(list(c)) for c in zip(*held, strict=True))
            counts = np.asarray(lists.value_lengths().fill_null(0), dtype=np.int64)
            start = 0
            ends = np.cumsum(counts)
            # what doesn't fill a block waits for the next batch
            every = batch is None or len(keys) >= MOST_LISTS
            while start < len(keys) and (every or ends[-1] - (ends[start - 1] if start else 0) >= most):
                before = ends[start - 1] if start else 0
                stop = max(start + 1, int(np.searchsorted(ends, before + most, side="right")))
                coded = lists.slice(start, stop - start).flatten().dictionary_encode()
                row = [pa.array([number], pa.int64())]
                for values, kind in ((keys.slice(start, stop - start), pa.int64()), (pa.array(counts[start:stop], pa.int32()), pa.int32()), (coded.indices, pa.int32()), (coded.dictionary, item)):
                    row.append(pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values.cast(kind)))
                yield pa.RecordBatch.from_arrays(row, schema=schema)
                number += 1
                start = stop
            held = [(keys.slice(start), lists.slice(start))] if start < len(keys) else []
            waiting = len(lists.slice(start).flatten()) if held else 0

    return pack


def to_blocks(df: DataFrame, key: str, items: str, item: pa.DataType, item_sql: str, most: int = BLOCK_ITEMS) -> tuple[DataFrame, int]:
    """(block, keys, counts, codes, items), staged, and their number: consecutive rows' lists packed together. A null list
    is an empty one."""
    kept = df.select(F.col(key).cast("long"), F.coalesce(F.col(items), F.array().cast(f"array<{item_sql}>")))
    packed = kept.mapInArrow(_packer(item, most), f"block long, keys array<long>, counts array<int>, codes array<int>, items array<{item_sql}>")
    with arrow_rows(df.sparkSession, BATCH_LISTS):
        return stage_counted(packed, "blocks", GROUP_BLOCKS)


def distinct_items(blocks: DataFrame) -> DataFrame:
    return blocks.select(F.explode("items").alias("item")).distinct()


def _unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(batch.num_rows):
            keys, counts, codes, order, values = (batch.column(c)[i].values for c in range(5))
            at = np.empty(len(order), dtype=np.int64)
            at[np.asarray(order)] = np.arange(len(order))
            taken = _values(values.take(pa.array(at[np.asarray(codes)])))
            offsets = np.frombuffer(taken.buffers()[1], np.int32)[taken.offset : taken.offset + len(taken) + 1]
            bounds = pa.array(offsets[np.concatenate([[0], np.cumsum(np.asarray(counts), dtype=np.int64)])])
            if pa.types.is_list(taken.type):
                out = pa.ListArray.from_arrays(bounds, taken.values)
            else:
                out = pa.Array.from_buffers(taken.type, len(keys), [None, bounds.buffers()[1], taken.buffers()[2]])
            yield pa.RecordBatch.from_arrays([keys, out], names=["key", "joined"])


def from_blocks(blocks: DataFrame, number: int, table: DataFrame, value_sql: str) -> DataFrame:
    """(key, joined): each list with its items replaced by table's value (item, value) and the values run together.

    ``value_sql`` is an array or binary type, ``number`` that of the blocks. Every item must have an entry. The table may
    be of any size; an item of all blocks is one row per block there.
    """
    tasks = max(1, -(-number // BLOCKS_A_TASK))
    rows = blocks.select("block", F.posexplode("items").alias("code", "item"))
    found = rows.join(table, "item").repartition(tasks, "block").groupBy("block").agg(F.collect_list("code").alias("codes_"), F.collect_list("value").alias("values_"))
    both = blocks.select("block", "keys", "counts", "codes").repartition(tasks, "block").join(found, "block", "left")
    empty = F.array()
    both = both.select("keys", "counts", "codes", F.coalesce("codes_", empty.cast("array<int>")), F.coalesce("values_", empty.cast(f"array<{value_sql}>")))
    return both.mapInArrow(_unpack, f"key long, joined {value_sql}")
