"""Per-key results where a few keys hold most rows, by value-frequency compression.

Rows are first grouped by key and value, which Spark combines before the shuffle, so a key of any number of rows costs
as many records as it has distinct values. Counts, distinct counts, modes and percentiles are then taken exactly from
the weighted values.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def compress(df: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """(keys, values, weight): the distinct combinations and how many rows have each. Nulls are values like others."""
    return df.groupBy(*keys, *values).agg(F.count(F.lit(1)).alias("weight"))


def totals(weighted: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, total): rows of each key."""
    return weighted.groupBy(*keys).agg(F.sum("weight").alias("total"))


def profile(df: DataFrame, keys: list[str], modes: list[str] = (), percentiles: dict[str, list[float]] | None = None) -> DataFrame:
    """Per key: total, and exactly for each column v of ``modes`` v_distinct and v_mode, for each of ``percentiles``
    v_p<q> by linear interpolation.

    Nulls in a value column count towards total only; a key with nothing but nulls has 0 distinct values and null for
    mode and percentiles. Of equally frequent values the smallest is the mode. Null keys form a group of their own.
    An empty table gives no rows.
    """
    out = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("total"))
    for v in modes:
        weighted = compress(df.where(F.col(v).isNotNull()), keys, [v])
        most = weighted.groupBy(*keys).agg(F.count(F.lit(1)).alias(f"{v}_distinct"), F.min_by(v, F.struct(-F.col("weight"), F.col(v))).alias(f"{v}_mode"))
        out = _beside(out, most, keys)
        out = out.withColumn(f"{v}_distinct", F.coalesce(f"{v}_distinct", F.lit(0).cast("long")))
    for v, levels in (percentiles or {}).items():
        out = _beside(out, weighted_percentiles(compress(df.where(F.col(v).isNotNull()), keys, [v]), keys, v, levels), keys)
    return out


def _beside(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    right = right.select(*[F.col(k).alias(f"__{k}") for k in keys], *[c for c in right.columns if c not in keys])
    on: Column = F.lit(True)
    for k in keys:
        on = on & left[k].eqNullSafe(right[f"__{k}"])
    return left.join(right, on, "left").drop(*[f"__{k}" for k in keys])


def weighted_percentiles(weighted: DataFrame, keys: list[str], value: str, levels: list[float]) -> DataFrame:
    """Exact percentiles (linear interpolation between ranks) of weighted non-null values.

    A running sum of weights gives each value the ranks it fills, so a level's two neighbours are found by rank. The
    window runs over distinct values, not rows; a key whose values are nearly all distinct sorts as many.
    """
    run = Window.partitionBy(*keys).orderBy(value)
    w = weighted.withColumns({"__to": F.sum("weight").over(run.rowsBetween(Window.unboundedPreceding, 0)), "__n": F.sum("weight").over(Window.partitionBy(*keys))})
    found = []
    for level in levels:
        rank = F.lit(level) * (F.col("__n") - 1)
        at = lambda r: F.max(F.when((F.col("__to") - F.col("weight") <= r) & (r < F.col("__to")), F.col(value).cast("double")))
        low, high, part = at(F.floor(rank)), at(F.ceil(rank)), F.max(rank - F.floor(rank))
        found.append((low + (high - low) * part).alias(f"{value}_p{level * 100:g}".replace(".", "_")))
    return w.groupBy(*keys).agg(*found)
