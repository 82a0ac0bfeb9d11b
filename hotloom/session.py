"""Sessions, and tables kept in the folder that all executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def build_session(app: str = "hotloom", master: str = "local[*]", **conf: str) -> SparkSession:
    """A session with the settings that the operators assume; each can be overridden."""
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
    } | conf
    builder = SparkSession.builder.appName(app).master(master)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir. Where that is unset a temporary one, but only for a local master: on a
    cluster each executor would write to a disk of its own, so that is a RuntimeError."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="hotloom-")
        spark.conf.set("spark.checkpoint.dir", named)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(named)
    return named


_written: list[str] = []


def _path(spark: SparkSession, where: str):
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(where)
    return path, path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def stage_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, removed when the driver ends."""
    where = f"{shared_folder(spark).rstrip('/')}/hotloom/{name}-{uuid.uuid4().hex}"
    if not _written:
        atexit.register(drop_stages)
    _written.append(where)
    return where


def named_stage(spark: SparkSession, name: str) -> str:
    """The path of that name in the shared folder, the same at each call, removed when the driver ends."""
    where = f"{shared_folder(spark).rstrip('/')}/hotloom/{name}"
    if where not in _written:
        if not _written:
            atexit.register(drop_stages)
        _written.append(where)
    return where


def stage(df: DataFrame, name: str, group_rows: int | None = None) -> DataFrame:
    """Write a table to the shared folder and read it back: cuts lineage, survives lost executors.

    ``group_rows`` bounds the rows of a Parquet row group. The reader decodes up to 4,096 rows of a group at once, so
    tables with rows of a megabyte need it.
    """
    where = stage_path(df.sparkSession, name)
    (df.write.option("parquet.block.row.count.limit", group_rows) if group_rows else df.write).parquet(where)
    return df.sparkSession.read.schema(df.schema).parquet(where)


def stage_counted(df: DataFrame, name: str, group_rows: int | None = None) -> tuple[DataFrame, int]:
    """stage() and the number of rows, counted while they are written."""
    seen = Observation()
    staged = stage(df.observe(seen, F.count(F.lit(1)).alias("rows")), name, group_rows)
    return staged, seen.get["rows"]


@contextmanager
def arrow_rows(spark: SparkSession, most: int) -> Iterator[None]:
    """Batches of at most ``most`` rows to and from Python for what is executed inside."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, most if int(before) <= 0 else min(int(before), most))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def unstage(df: DataFrame) -> None:
    """Remove a staged table that no plan reads any more; other tables stay."""
    for where in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if "/hotloom/" in where:
            path, fs = _path(df.sparkSession, where)
            fs.delete(path, True)
            kept = [w for w in _written if w.rsplit("/", 1)[1] != where.rsplit("/", 1)[1]]
            _written[:] = kept


def drop_stages() -> None:
    """Remove what stage() wrote; does nothing once the session has ended."""
    spark = SparkSession.getActiveSession()
    while _written:
        where = _written.pop()
        try:
            if spark is not None:
                path, fs = _path(spark, where)
                fs.delete(path, True)
        except Exception:  # noqa: BLE001 - the JVM may be gone at exit
            return
