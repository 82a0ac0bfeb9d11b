"""Sinks: named artifacts, CSV reports, GeoJSON and Markdown."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hotloom.operators.cleaning import finite_or_null
from hotloom.operators.ranking import with_rank


def put_artifact(df: DataFrame, folder: str, name: str) -> None:
    """Write or replace a named table. The new one is written aside and then takes the old one's place, so a failed write
    leaves the old one, and df may read it."""
    target, aside = f"{folder}/{name}", f"{folder}/.{name}-{uuid.uuid4().hex}"
    finite_or_null(df).write.parquet(aside)
    spark = df.sparkSession
    new, old = (spark.sparkContext._jvm.org.apache.hadoop.fs.Path(p) for p in (aside, target))
    fs = new.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.delete(old, True)
    if not fs.rename(new, old):
        raise OSError(f"{aside} couldn't be moved to {target}")
    spark.catalog.refreshByPath(target)


def get_artifact(spark: SparkSession, folder: str, name: str) -> DataFrame | None:
    """The named table, or None if there is none."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}")
    there = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)
    return spark.read.parquet(f"{folder}/{name}") if there else None


def as_json(df: DataFrame) -> DataFrame:
    """(payload): each row as JSON; nulls, NaN and infinities as null."""
    return finite_or_null(df).select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("payload"))


def write_csv(df: DataFrame, path: str, order: list[str] = ()) -> None:
    """A report as one CSV file with a header, sorted if asked for; for results of few rows."""
    one = df.coalesce(1)
    (one.sortWithinPartitions(*order) if order else one).write.mode("overwrite").option("header", True).csv(path)


def feature(geometry: Column, kind: str, properties: list[str | Column]) -> Column:
    """A GeoJSON feature as text; ``geometry`` is the coordinates."""
    return F.to_json(F.struct(F.lit("Feature").alias("type"), F.struct(F.lit(kind).alias("type"), geometry.alias("coordinates")).alias("geometry"), F.struct(*properties).alias("properties")), {"ignoreNullFields": "false"})


def cluster_features(clusters: DataFrame, properties: list[str]) -> DataFrame:
    """(run_id, cluster_id, kind, feature): a polygon for each cluster and a point for its centre, coarsened to 4 places
    and marked as centroid. The polygon is the column boundary, a closed ring of [lon, lat], or, of tables without one,
    the box at 3 places. Clusters without a centre have no features."""
    c = clusters.where(F.col("centroid_latitude").isNotNull() & F.col("centroid_longitude").isNotNull())
    r = lambda col, k: F.rint(F.col(col) * 10**k) / 10**k
    if "boundary" in clusters.columns:
        ring = F.array(F.col("boundary"))
    else:
        w, e, s, n = r("bbox_min_lon", 3), r("bbox_max_lon", 3), r("bbox_min_lat", 3), r("bbox_max_lat", 3)
        ring = F.array(F.array(F.array(w, s), F.array(e, s), F.array(e, n), F.array(w, n), F.array(w, s)))
    middle = feature(F.array(r("centroid_longitude", 4), r("centroid_latitude", 4)), "Point", [*properties, F.lit("centroid").alias("feature")])
    both = F.array(F.struct(F.lit("polygon").alias("kind"), feature(ring, "Polygon", properties).alias("feature")), F.struct(F.lit("centroid").alias("kind"), middle.alias("feature")))
    return c.select("run_id", "cluster_id", F.inline(both))


def write_geojson(features: DataFrame, path: str, metadata: dict | None = None) -> None:
    """Feature texts as one GeoJSON FeatureCollection in one file, polygons and centres in the order of clusters; for
    results of few features."""
    ranked = with_rank(features.select("run_id", "cluster_id", "kind", "feature"), ["run_id", "cluster_id", "kind"], "i")
    head = f'{{"type":"FeatureCollection","metadata":{json.dumps(metadata or {})},"features":['
    lines = ranked.select("i", F.concat(F.when(F.col("i") > 1, F.lit(",")).otherwise(F.lit("")), "feature").alias("value"))
    ends = features.sparkSession.createDataFrame([(0, head), (2**62, "]}")], "i long, value string")
    lines.unionByName(ends).coalesce(1).sortWithinPartitions("i").select("value").write.mode("overwrite").text(path)


def cluster_csv(hotspots: DataFrame, path: str) -> None:
    """Records of clusters as one CSV file in the order of their rank, without the outline, places coarsened to 4 (centre)
    and 3 (box) digits."""
    digits = {"centroid_latitude": 4, "centroid_longitude": 4, **{f"bbox_{e}_{c}": 3 for e in ("min", "max") for c in ("lat", "lon")}}
    rows = hotspots.drop("boundary").withColumns({c: F.rint(F.col(c) * 10**k) / 10**k for c, k in digits.items() if c in hotspots.columns})
    write_csv(rows, path, ["rank"])


def markdown_table(df: DataFrame, most: int | None = None) -> str:
    """A small report as a Markdown table, whole unless ``most`` rows are asked for; then a line says how many are left
    out."""
    rows = (df if most is None else df.limit(most)).collect()
    lines = ["| " + " | ".join(df.columns) + " |", "|" + "-|" * len(df.columns)]
    lines += ["| " + " | ".join("" if v is None else str(v) for v in row) + " |" for row in rows]
    if most is not None and (left := df.count() - len(rows)) > 0:
        lines.append(f"\n{left} further rows are left out.")
    return "\n".join(lines)


def write_report(spark: SparkSession, sections: dict[str, DataFrame | str], path: str) -> None:
    """A Markdown file of small tables and paragraphs under their titles, in a folder of storage that executors share."""
    parts = [f"## {title}\n\n{body if isinstance(body, str) else markdown_table(body)}\n" for title, body in sections.items()]
    spark.createDataFrame([("\n".join(parts),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def read_report(spark: SparkSession, path: str) -> dict:
    """A JSON report as a dictionary; an absent one is empty."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
        return {}
    return json.loads("".join(r.value for r in spark.read.text(path, wholetext=True).collect()))


def read_csv_report(spark: SparkSession, path: str) -> DataFrame:
    """A CSV report with a header, as text; empty cells and NaN are null."""
    df = spark.read.option("header", True).csv(path)
    return df.select(*[F.when(~F.col(c).isin("NaN", "nan"), F.col(c)).alias(c) for c in df.columns])
