"""Readers of the raw files: complaint CSV, ward and record KML, JSON metadata; checksums and downloads."""

from __future__ import annotations

import hashlib
import json
import urllib.request
from datetime import UTC, datetime
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hotloom.operators.cleaning import REQUIRED, SchemaError

_TEXT, _INT, _NUM = T.StringType(), T.LongType(), T.DoubleType()
RAW_TYPES = {"ward_id": _INT, "sub_category_id": _INT, "civic_agency_id": _NUM, "latitude": _NUM, "longitude": _NUM, "category_id": _NUM, "comment_count": _INT}
_RING = "outerBoundaryIs struct<LinearRing: struct<coordinates: string>>, innerBoundaryIs array<struct<LinearRing: struct<coordinates: string>>>"
_DATA = "ExtendedData struct<SchemaData: struct<SimpleData: array<struct<_name: string, _VALUE: string>>>, Data: array<struct<_name: string, value: string>>>"


#: Bytes that windows-1252 leaves undefined.
UNDEFINED = "\x81\x8d\x8f\x90\x9d"


def encoding_of(spark: SparkSession, path: str) -> str:
    """UTF-8 if all lines are, else windows-1252; a SchemaError if they are neither. The lines are read as bytes and
    checked where they lie; no character of UTF-8 spans two lines."""
    lines = spark.read.schema("value string").option("encoding", "ISO-8859-1").option("sep", "\x01").option("quote", "").option("escape", "").csv(path)
    found = lines.agg(F.count_if(~F.is_valid_utf8(F.encode("value", "ISO-8859-1").cast("string"))).alias("broken"), F.count_if(F.col("value").rlike(f"[{UNDEFINED}]")).alias("undefined")).first()
    if not found["broken"]:
        return "UTF-8"
    if found["undefined"]:
        raise SchemaError("the file is neither UTF-8 nor windows-1252")
    return "windows-1252"


def read_raw(spark: SparkSession, path: str) -> tuple[DataFrame, str]:
    """(rows, encoding) of a complaint CSV with a header: known columns by name and type, others as text.

    A cell that isn't of its column's type is null. A missing required column is a SchemaError. A windows-1252 file is
    read as ISO-8859-1 and its 27 other characters are put right, so the session needs no legacy setting. Quoted line
    breaks make a file one task; many files are read side by side.
    """
    encoding = encoding_of(spark, path)
    reader = spark.read.option("header", True).option("multiLine", True).option("escape", '"')
    rows = reader.option("encoding", "UTF-8" if encoding == "UTF-8" else "ISO-8859-1").csv(path)
    missing = sorted(set(REQUIRED) - set(rows.columns))
    if missing:
        raise SchemaError(f"missing columns: {', '.join(missing)}")
    if encoding != "UTF-8":
        pairs = [(chr(b), bytes([b]).decode("windows-1252", "replace")) for b in range(0x80, 0xA0)]
        kept = [(a, b) for a, b in pairs if b != "�"]
        old, new = ("".join(x) for x in zip(*kept, strict=True))
        rows = rows.withColumns({c: F.translate(c, old, new) for c in rows.columns})
    return rows.withColumns({c: F.col(c).try_cast(kind) for c, kind in RAW_TYPES.items() if c in rows.columns}), encoding


def _ring(text):
    """Points of a KML coordinate list."""
    return F.transform(F.filter(F.split(F.trim(text), r"\s+"), lambda p: p != ""), lambda p: F.struct(F.split(p, ",")[0].cast("double").alias("lon"), F.split(p, ",")[1].cast("double").alias("lat")))


def read_wards(spark: SparkSession, path: str, name_field: str = "KGISWardName", zone_field: str = "Zone") -> DataFrame:
    """(ward_id, name, zone, rings) of a KML of Placemarks: the number is the first in the name; outer and inner rings of
    all polygons together, which containment reads by parity. Placemarks without a number are left out."""
    polygon = f"struct<{_RING}>"
    schema = f"name string, {_DATA}, Polygon {polygon}, MultiGeometry struct<Polygon: array<{polygon}>>"
    marks = spark.read.format("xml").option("rowTag", "Placemark").schema(schema).load(path)
    parts = F.concat(F.coalesce("MultiGeometry.Polygon", F.array().cast(f"array<{polygon}>")), F.when(F.col("Polygon").isNotNull(), F.array("Polygon")).otherwise(F.array().cast(f"array<{polygon}>")))
    texts = F.flatten(F.transform(parts, lambda p: F.concat(F.array(p["outerBoundaryIs"]["LinearRing"]["coordinates"]), F.coalesce(F.transform(p["innerBoundaryIs"], lambda r: r["LinearRing"]["coordinates"]), F.array().cast("array<string>")))))
    return marks.select(
        F.nullif(F.regexp_extract("name", r"(\d+)", 1), F.lit("")).cast("int").alias("ward_id"), _field(name_field).alias("name"), _field(zone_field).alias("zone"),
        F.transform(F.filter(texts, lambda t: t.isNotNull()), _ring).alias("rings"),
    ).where("ward_id is not null")


def _field(name: str):
    """A value of a Placemark's extended data by name, in either notation."""
    simple = F.element_at(F.filter("ExtendedData.SchemaData.SimpleData", lambda d: d["_name"] == name), 1)["_VALUE"]
    plain = F.element_at(F.filter("ExtendedData.Data", lambda d: d["_name"] == name), 1)["value"]
    first = lambda field, value: F.when(F.size(F.filter(field, lambda d: d["_name"] == name)) > 0, value)
    return F.coalesce(first("ExtendedData.SchemaData.SimpleData", simple), first("ExtendedData.Data", plain))


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """(open_date, latitude, longitude, status) of a KML of second-source records: only these four fields are read.
    Numbers and day-first dates that can't be read are null."""
    marks = spark.read.format("xml").option("rowTag", "Placemark").schema(f"name string, {_DATA}").load(path)
    return marks.select(
        F.try_to_timestamp(_field("Open_Date"), F.lit("dd/MM/yyyy")).cast("date").alias("open_date"), _field("Latitude").try_cast("double").alias("latitude"),
        _field("Longitude").try_cast("double").alias("longitude"), _field("Status").alias("status"),
    )


def read_metadata(spark: SparkSession, paths: str) -> DataFrame:
    """One row per JSON file with the fields of a source's record; absent ones are null."""
    fields = ["source_key", "source_identifier", "title", "url", "license", "retrieved_at", "file_size", "sha256", "status"]
    schema = ", ".join(f"{f} {'long' if f == 'file_size' else 'string'}" for f in fields)
    return spark.read.schema(schema).option("multiLine", True).json(paths)


def checksums(spark: SparkSession, path: str) -> DataFrame:
    """(path, file_size, sha256) of files."""
    return spark.read.format("binaryFile").load(path).select("path", F.col("length").alias("file_size"), F.sha2("content", 256).alias("sha256"))


def sha256_of(path: str | Path) -> str:
    """Digest of one file on the driver, read in blocks."""
    digest = hashlib.sha256()
    with open(path, "rb") as file:
        while block := file.read(1 << 20):
            digest.update(block)
    return digest.hexdigest()


def fetch(url: str, path: str | Path, meta: str | Path, license_: str = "", force: bool = False) -> dict:
    """Download a file unless it is there with the checksum its metadata states; writes and returns the metadata."""
    path, meta = Path(path), Path(meta)
    if not force and path.exists() and meta.exists():
        known = json.loads(meta.read_text())
        if known.get("sha256") == sha256_of(path):
            return known | {"cached": True}
    with urllib.request.urlopen(url) as answer, open(path, "wb") as out:  # noqa: S310
        while block := answer.read(1 << 20):
            out.write(block)
    known = {"source_identifier": url, "license": license_, "retrieved_at": datetime.now(UTC).isoformat(), "file_size": path.stat().st_size, "sha256": sha256_of(path)}
    meta.write_text(json.dumps(known, indent=1))
    return known | {"cached": False}


def fetch_all(sources: dict[str, dict], folder: str | Path) -> dict[str, dict]:
    """fetch() for each source (url, optional license and required); an optional one that fails is recorded as such."""
    out = {}
    for key, source in sources.items():
        try:
            out[key] = fetch(source["url"], Path(folder) / key, Path(folder) / f"{key}.json", source.get("license", "")) | {"status": "ok"}
        except OSError as error:
            if source.get("required", True):
                raise
            out[key] = {"status": "unavailable", "reason": type(error).__name__}
    return out
