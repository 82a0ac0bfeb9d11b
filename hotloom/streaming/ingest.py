"""Loads that arrive one after the other: new complaint files join the stamp dictionary and monthly counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from hotloom.operators.timestamps import normalise_stamps


def follow(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """A stream of the Parquet files of a folder."""
    return spark.readStream.schema(schema).parquet(folder)


def normalise_stream(rows: DataFrame, text: str, dictionary: str, out: str, checkpoint: str, source: str | None = None) -> StreamingQuery:
    """Write rows with their instants as they arrive; each batch adds only unknown texts to the dictionary, and texts that
    are frequent in it are joined as such, whichever load brought them.

    A batch that is run again overwrites its own output, so each row comes out once.
    """
    def one(batch: DataFrame, number: int) -> None:
        normalise_stamps(batch, text, path=dictionary, source=source).drop("local_day").write.mode("overwrite").parquet(f"{out}/batch={number}")

    return rows.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def period_counts(rows: DataFrame, stamp: str, period: str = "30 days", lateness: str = "31 days") -> DataFrame:
    """Complaints per period of a stream of instants; a period is closed once the stream is ``lateness`` past it."""
    return rows.withWatermark(stamp, lateness).groupBy(F.window(stamp, period).alias("period")).agg(F.count(F.lit(1)).alias("complaints"))
