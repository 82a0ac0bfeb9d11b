"""Ranks over a whole table without gathering it: ranges are sorted apart, and their sizes give each its first rank."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hotloom.session import stage


def with_rank(df: DataFrame, order: list[str], into: str = "rank", total: str | None = None) -> DataFrame:
    """df with its row number from 1 in ascending ``order`` (nulls first) and, if named, the number of all rows.

    Rows are range-partitioned and written; only the partitions' sizes, as many as there are partitions, meet in one
    task. Equal rows get numbers in any order. An empty table stays empty.
    """
    parts = stage(df.repartitionByRange(*[F.col(c).asc_nulls_first() for c in order]).withColumn("__part", F.spark_partition_id()), "ranges")
    sizes = parts.groupBy("__part").agg(F.count(F.lit(1)).alias("__size"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    firsts = sizes.select("__part", F.coalesce(F.sum("__size").over(before), F.lit(0)).alias("__before"), F.sum("__size").over(Window.partitionBy(F.lit(1))).alias("__total"))
    own = F.row_number().over(Window.partitionBy("__part").orderBy(*[F.col(c).asc_nulls_first() for c in order]))
    ranked = parts.join(F.broadcast(firsts), "__part").withColumn(into, F.col("__before") + own)
    if total:
        ranked = ranked.withColumn(total, F.col("__total"))
    return ranked.drop("__part", "__before", "__total")


def average_ranks(df: DataFrame, value: str, into: str) -> DataFrame:
    """(value, into): each distinct non-null value with the mean rank of its rows.

    Ranks are run over distinct values and their weights, so ties cost nothing.
    """
    w = df.where(F.col(value).isNotNull()).groupBy(F.col(value).alias("__v")).agg(F.count(F.lit(1)).alias("__w"))
    parts = stage(w.repartitionByRange("__v").withColumn("__part", F.spark_partition_id()), "ranges")
    sizes = parts.groupBy("__part").agg(F.sum("__w").alias("__size"))
    firsts = sizes.select("__part", F.coalesce(F.sum("__size").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    upto = F.sum("__w").over(Window.partitionBy("__part").orderBy("__v").rowsBetween(Window.unboundedPreceding, 0))
    ranked = parts.join(F.broadcast(firsts), "__part").withColumn("__upto", F.col("__before") + upto)
    return ranked.select(F.col("__v").alias(value), (F.col("__upto") - (F.col("__w") - 1) / 2).alias(into))
