"""Readers, sinks and the read side over small files."""

import json

import pytest
from pyspark.sql import functions as F

from hotloom.operators import cleaning
from hotloom.plans import surface
from hotloom.sources import artifacts, raw

HOTSPOTS = "run_id int, cluster_id int, rank int, report_count int, centroid_latitude double, centroid_longitude double, bbox_min_lat double, bbox_min_lon double, bbox_max_lat double, bbox_max_lon double, boundary array<array<double>>"
RING = [[77.5, 12.9], [77.6, 12.9], [77.6, 13.0], [77.5, 12.9]]


def hotspots(spark):
    rows = [(1, 7, 2, 10, 12.123456, 77.123456, 12.12345, 77.0, 12.2, 77.23456, RING), (1, 3, 1, 20, 12.5, 77.5, 12.4, 77.4, 12.6, 77.6, RING), (1, 9, 3, 5, None, 77.5, None, None, None, None, None)]
    return spark.createDataFrame(rows, HOTSPOTS)


def text_of(folder):
    return "\n".join(p.read_text() for p in sorted(folder.glob("part-*")))


def test_geojson_is_one_collection_with_outlines(spark, tmp_path):
    artifacts.write_geojson(artifacts.cluster_features(hotspots(spark), ["cluster_id", "rank"]), str(tmp_path / "g"), {"eps_meters": 250})
    got = json.loads(text_of(tmp_path / "g"))
    assert got["type"] == "FeatureCollection" and got["metadata"] == {"eps_meters": 250}
    assert [(f["properties"]["cluster_id"], f["geometry"]["type"]) for f in got["features"]] == [(3, "Point"), (3, "Polygon"), (7, "Point"), (7, "Polygon")]
    assert got["features"][1]["geometry"]["coordinates"] == [RING] and got["features"][2]["geometry"]["coordinates"] == [77.1235, 12.1235]
    assert got["features"][2]["properties"] == {"cluster_id": 7, "rank": 2, "feature": "centroid"}
    artifacts.write_geojson(artifacts.cluster_features(hotspots(spark).limit(0), ["rank"]), str(tmp_path / "e"))
    assert json.loads(text_of(tmp_path / "e"))["features"] == []


def test_boxes_where_there_is_no_outline(spark):
    got = {r.kind: json.loads(r.feature) for r in artifacts.cluster_features(hotspots(spark).drop("boundary").where("cluster_id = 7"), ["rank"]).collect()}
    assert got["polygon"]["geometry"]["coordinates"][0][0] == [77.0, 12.123] and len(got["polygon"]["geometry"]["coordinates"][0]) == 5


def test_csv_by_rank(spark, tmp_path):
    artifacts.cluster_csv(hotspots(spark), str(tmp_path / "c"))
    rows = artifacts.read_csv_report(spark, str(tmp_path / "c")).collect()
    assert [r["rank"] for r in rows] == ["1", "2", "3"] and "boundary" not in rows[0].asDict()
    assert rows[1].centroid_latitude == "12.1235" and rows[1].bbox_max_lon == "77.235" and rows[2].centroid_latitude is None


def test_reports_are_whole(spark, tmp_path):
    df = spark.range(250)
    assert artifacts.markdown_table(df).count("\n") == 251
    assert artifacts.markdown_table(df, 10).endswith("240 further rows are left out.")
    artifacts.write_report(spark, {"Ids": df, "Note": "text"}, str(tmp_path / "r"))
    text = text_of(tmp_path / "r")
    assert text.startswith("## Ids") and "| 249 |" in text and "## Note\n\ntext" in text


def test_json_and_csv_reports(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"source_key": "a", "file_size": 5, "status": "ok"}))
    (tmp_path / "b.json").write_text(json.dumps({"source_key": "b", "url": "u"}))
    got = {r.source_key: r for r in raw.read_metadata(spark, str(tmp_path / "*.json")).collect()}
    assert got["a"].file_size == 5 and got["a"].url is None and got["b"].url == "u"
    assert artifacts.read_report(spark, str(tmp_path / "a.json"))["file_size"] == 5 and artifacts.read_report(spark, str(tmp_path / "none.json")) == {}
    (tmp_path / "t.csv").write_text("x,y\n1,NaN\n,2\n")
    assert [tuple(r) for r in artifacts.read_csv_report(spark, str(tmp_path / "t.csv")).collect()] == [("1", None), (None, "2")]


def test_replaced_artifacts(spark, tmp_path):
    artifacts.put_artifact(spark.range(3), str(tmp_path), "a")
    old = artifacts.get_artifact(spark, str(tmp_path), "a")
    artifacts.put_artifact(old.where("id > 0"), str(tmp_path), "a")  # reads what it replaces
    assert artifacts.get_artifact(spark, str(tmp_path), "a").count() == 2
    with pytest.raises(Exception, match="DIVIDE|raise|USER"):
        artifacts.put_artifact(spark.range(3).select(F.raise_error(F.lit("broken")).cast("int").alias("id")), str(tmp_path), "a")
    assert artifacts.get_artifact(spark, str(tmp_path), "a").count() == 2


def test_downloads(tmp_path):
    source = tmp_path / "s.bin"
    source.write_bytes(b"abc")
    path, meta = tmp_path / "d.bin", tmp_path / "d.json"
    first = raw.fetch(source.as_uri(), path, meta, "CC0")
    assert not first["cached"] and first["file_size"] == 3 and raw.fetch(source.as_uri(), path, meta)["cached"]
    path.write_bytes(b"changed")
    assert not raw.fetch(source.as_uri(), path, meta)["cached"] and path.read_bytes() == b"abc"
    all_ = raw.fetch_all({"a": {"url": source.as_uri()}, "b": {"url": (tmp_path / "none").as_uri(), "required": False}}, tmp_path)
    assert all_["a"]["status"] == "ok" and all_["b"]["status"] == "unavailable"
    with pytest.raises(OSError):
        raw.fetch_all({"b": {"url": (tmp_path / "none").as_uri()}}, tmp_path)


def test_encodings(spark, tmp_path):
    header = ",".join(cleaning.REQUIRED)
    row = "1-1-2019 06:33,5,{},d,66,1,l,a,12.97,77.59,w,1,Roads,Pothole,agency,Open,0"
    for name, body, want in (("u", "café".encode(), "UTF-8"), ("w", b"caf\xe9", "windows-1252"), ("p", b"plain", "UTF-8"), ("n", '"two\nlinés"'.encode(), "UTF-8")):
        (tmp_path / name).write_bytes(header.encode() + b"\n" + row.encode().replace(b"{}", body) + b"\n")
        df, encoding = raw.read_raw(spark, str(tmp_path / name))
        assert encoding == want and df.count() == 1 and df.first().title in ("café", "plain", "two\nlinés")
    (tmp_path / "x").write_bytes(header.encode() + b"\n" + row.encode().replace(b"{}", b"caf\xe9 \x81") + b"\n")
    with pytest.raises(cleaning.SchemaError, match="neither"):
        raw.read_raw(spark, str(tmp_path / "x"))


def test_lookups(spark, tmp_path):
    monthly = spark.createDataFrame([(1, "cluster", 3, "2020-02", 4, 5), (1, "cluster", 3, "2020-01", 1, 2), (1, "cluster", 3, "2020-01", 1, 2), (1, "ward", 3, "2020-01", 9, 9)], "run_id int, unit_type string, unit_id int, month string, pothole_reports int, all_complaints int")
    one, months = surface.hotspot(hotspots(spark), monthly, 1, 3)
    assert one.first().boundary == RING and [tuple(r) for r in months.collect()] == [(1, "2020-01", 1, 2), (1, "2020-02", 4, 5)]
    grid = spark.createDataFrame([(250.0, 5), (100.0, 3), (250.0, 3)], "eps double, least int")
    assert [(r.eps, r.least, r.chosen) for r in surface.parameters(grid, 250.0, 5).collect()] == [(100.0, 3, False), (250.0, 3, False), (250.0, 5, True)]
    gate = spark.createDataFrame([(True, 600, 30)], "passed boolean, usable_targets long, months long")
    status = surface.data_status(spark.createDataFrame([("a",)], "source_key string"), gate).first()
    assert status.gate_passed and status.months_covered == 30
    with pytest.raises(surface.NotFound, match="gate, monthly"):
        surface.quality(spark, str(tmp_path))
