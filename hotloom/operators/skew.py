"""Joins and groupings in which one key may hold a third of all rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hotloom.session import stage_counted

#: A key is hot above this share of the rows, so there are at most 1 / HOT_SHARE hot keys whatever the size.
HOT_SHARE = 1 / 1000
#: Where work within a key is quadratic, its rows are cut into blocks of about this many, however large the table is.
BLOCK = 2_000
#: A table of keys is broadcast up to this many rows (about 10 MB), counted when it is staged; beyond it is shuffled.
BROADCAST_KEYS = 100_000


def hot_part(counts: DataFrame, count: str, share: float = HOT_SHARE) -> tuple[DataFrame, DataFrame]:
    """Split a table of keys with their row counts into (hot, cold).

    ``counts`` is read twice, so it should be staged. An empty table gives two empty parts. Null counts are cold.
    """
    total = counts.agg(F.sum(count)).first()[0] or 0
    hot = F.coalesce(F.col(count) > F.lit(float(total) * share), F.lit(False))
    return counts.where(hot), counts.where(~hot)


def same(left: DataFrame, right: DataFrame, keys: dict[str, str], nulls_match: bool = False) -> Column:
    """The condition that left[k] equals right[v] for all pairs of ``keys``."""
    pairs = [left[a].eqNullSafe(right[b]) if nulls_match else left[a] == right[b] for a, b in keys.items()]
    return reduce(lambda x, y: x & y, pairs)


def split_join(rows: DataFrame, counts: DataFrame, keys: dict[str, str], count: str, share: float = HOT_SHARE, nulls_match: bool = False) -> DataFrame:
    """Inner join of rows with a table unique in its keys that knows each key's number of rows.

    Hot keys, at most 1 / share of them, are broadcast and joined where the rows lie; the rest is shuffled by key, and
    no key there has more than ``share`` of the rows. ``keys`` maps columns of rows to those of counts, whose names
    must not clash. A null key matches nothing unless ``nulls_match``.
    """
    hot, cold = hot_part(counts, count, share)
    names = list(keys.values())
    near = rows.join(F.broadcast(hot), same(rows, hot, keys, nulls_match))
    hot_keys = hot.select(names)
    rest = rows.join(F.broadcast(hot_keys), same(rows, hot_keys, keys, nulls_match), "left_anti")
    return near.unionByName(rest.join(cold, same(rest, cold, keys, nulls_match)))


def blocks(count: Column, size: int) -> Column:
    """The number of blocks of about ``size`` rows that a group of ``count`` rows is cut into, at least 1."""
    return F.greatest(F.lit(1), F.ceil(count / F.lit(size))).cast("int")


def crowded(counts: DataFrame, count: str, keys: list[str], size: int = BLOCK) -> tuple[DataFrame, int]:
    """(keys as __k_<key> and __blocks, its number of rows), staged: the keys with more than ``size`` rows and into how
    many blocks theirs are cut. The share of all rows plays no part, as work within a key grows with its square."""
    few = counts.where(F.col(count) > size).select(*[F.col(k).alias(f"__k_{k}") for k in keys], blocks(F.col(count), size).alias("__blocks"))
    return stage_counted(few, "crowded")


def with_blocks(df: DataFrame, crowd: tuple[DataFrame, int], keys: dict[str, str], into: str) -> DataFrame:
    """df with the number of blocks of its key, 1 for a key that isn't crowded. ``keys`` maps columns of df to the names
    that crowded() got; null keys match."""
    table, rows = crowd
    if not rows:
        return df.withColumn(into, F.lit(1))
    table = table.withColumnRenamed("__blocks", into)
    names = {c: f"__k_{k}" for c, k in keys.items()}
    found = df.join(F.broadcast(table) if rows <= BROADCAST_KEYS else table, same(df, table, names, nulls_match=True), "left")
    return found.withColumn(into, F.coalesce(into, F.lit(1))).drop(*names.values())


def in_own_block(df: DataFrame, count: str, salt: Column, into: str) -> DataFrame:
    """df with the block its row belongs to, by the hash of ``salt``; the number of blocks is dropped."""
    return df.withColumn(into, F.pmod(F.xxhash64(salt), F.col(count)).cast("int")).drop(count)


def in_every_block(df: DataFrame, count: str, into: str) -> DataFrame:
    """Each row once for every block; the number of blocks is dropped."""
    return df.withColumn(into, F.explode(F.sequence(F.lit(0), F.col(count) - 1))).drop(count)


def block_join(left: DataFrame, right: DataFrame, keys: dict[str, str], crowd: tuple[DataFrame, int], names: dict[str, str], salt: Column) -> DataFrame:
    """Inner join by ``keys`` (columns of left to those of right, null keys match) in which a crowded key's rows of right
    are spread over blocks and those of left go to each, so no task meets a whole crowded key.

    ``crowd`` is what crowded() gives for right, ``names`` maps right's key columns to the names it got. Columns of the
    two sides must not clash.
    """
    if not crowd[1]:
        return left.join(right, same(left, right, keys, nulls_match=True))
    back = {a: names[b] for a, b in keys.items()}
    a = in_every_block(with_blocks(left, crowd, back, "__na"), "__na", "__block_a")
    b = in_own_block(with_blocks(right, crowd, names, "__nb"), "__nb", salt, "__block_b")
    return a.join(b, same(a, b, keys, nulls_match=True) & (a["__block_a"] == b["__block_b"])).drop("__block_a", "__block_b")


def pairs_within(members: DataFrame, keys: list[str], member: str, size: int = BLOCK) -> DataFrame:
    """(keys, x, y) with x < y: the pairs of distinct members of each key, for results that are defined as such pairs.

    ``members`` has each member of a key once and should be staged. A group is cut into blocks and each two blocks meet
    in a key of their own, so no task forms more than the pairs of two blocks. Null keys form no group.
    """
    counts = members.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") > 1)
    crowd = crowded(counts, "__n", keys, size)
    m = with_blocks(members.select(*keys, member), crowd, {k: k for k in keys}, "__nb").withColumn("__own", F.pmod(F.xxhash64(member), F.col("__nb")).cast("int"))
    # a block meets itself and those after it from the one side, and those before it from the other
    a = m.select(*keys, F.col(member).alias("x"), F.col("__own").alias("__p"), F.explode(F.sequence(F.col("__own"), F.col("__nb") - 1)).alias("__q"))
    b = m.select(*[F.col(k).alias(f"__b_{k}") for k in keys], F.col(member).alias("y"), F.explode(F.sequence(F.lit(0), F.col("__own"))).alias("__bp"), F.col("__own").alias("__bq"))
    on = same(a, b, {k: f"__b_{k}" for k in keys}) & (a["__p"] == b["__bp"]) & (a["__q"] == b["__bq"])
    found = a.join(b, on).where((F.col("__p") != F.col("__q")) | (F.col("x") < F.col("y")))
    return found.select(*keys, F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y"))
