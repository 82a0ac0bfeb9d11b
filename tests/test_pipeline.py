import json

import numpy as np
import pytest

from hotloom.operators import cleaning, secondary
from hotloom.plans import pipeline, surface
from hotloom.sources import artifacts, raw


def write_inputs(folder, n):
    rng = np.random.default_rng(1)
    lines = [",".join(cleaning.REQUIRED)]
    for k in range(n):
        lat, lon = (rng.normal(12.95 + 0.01 * (k % 4), 0.0006), rng.normal(77.55 + 0.01 * (k % 4), 0.0006)) if k % 2 else (rng.uniform(12.9, 13.0), rng.uniform(77.5, 77.6))
        target = k % 3 != 0
        lines.append(f"{k % 12 + 1}-{k % 28 + 1}-{2019 + k // 12 % 3} 10:00,1,t{k},d,{66 if target else 1},1,l,a,{lat:.6f},{lon:.6f},w,1,Roads,{'Pothole' if target else 'Light'},x,Open,0")
    (folder / "c.csv").write_text("\n".join(lines) + "\n")
    ring = lambda x: f"{x},12.8 {x + 0.1},12.8 {x + 0.1},13.1 {x},13.1 {x},12.8"
    marks = "".join(f"<Placemark><name>{k} ward</name><Polygon><outerBoundaryIs><LinearRing><coordinates>{ring(77.45 + 0.1 * k)}</coordinates></LinearRing></outerBoundaryIs></Polygon></Placemark>" for k in range(2))
    (folder / "w.kml").write_text(f'<kml xmlns="http://www.opengis.net/kml/2.2"><Document>{marks}</Document></kml>')


RECORDS = '<kml xmlns="http://www.opengis.net/kml/2.2"><Document>{}</Document></kml>'
RECORD = '<Placemark><name>r</name><ExtendedData><SchemaData><SimpleData name="Open_Date">31/05/2022</SimpleData><SimpleData name="Latitude">{}</SimpleData><SimpleData name="Longitude">{}</SimpleData><SimpleData name="Status">Open</SimpleData></SchemaData></ExtendedData></Placemark>'


@pytest.fixture(scope="module")
def whole(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("whole")
    write_inputs(folder, 1200)
    rng = np.random.default_rng(3)
    (folder / "r.kml").write_text(RECORDS.format("".join(RECORD.format(a, b) for a, b in [*rng.normal([12.96, 77.56], 0.001, (40, 2)), *rng.uniform([12.85, 77.46], [13.05, 77.64], (60, 2))])))
    (folder / "c.json").write_text(json.dumps({"source_key": "c", "url": "u", "license": "CC0"}))
    s = pipeline.Settings(str(folder / "c.csv"), str(folder / "w.kml"), str(folder / "out"), [66], 250.0, 5, [200.0, 250.0], [5], 2, {66: ("Roads", "Pothole")}, str(folder / "r.kml"), str(folder / "*.json"))
    return s, pipeline.run(spark, s), lambda name: artifacts.get_artifact(spark, s.out, name), folder / "out"


def test_whole_run(spark, whole):
    s, got, get, _ = whole
    assert got == {"gate_passed": True, "eps": 250.0, "least": 5}
    stored = get("complaints")
    assert stored.columns == cleaning.STORED and stored.count() == 1200
    labels = get("membership")
    assert labels.count() == 800 and labels.where("label >= 0").count() > 300
    hotspots = get("hotspots")
    assert surface.hotspots(hotspots, "report_count", "desc", limit=1).first()["rank"] == 1
    assert get("monthly").where("unit_type = 'ward'").count() == 2 * 36
    assert get("ward_metrics").count() == 2 and set(surface.health(spark, s.out, ["sweep", "nothing"]).values()) == {True, False}
    assert surface.spatial_units(get("ward_metrics"), get("wards"), True).count() == 2
    first = get("clusters").first()
    assert first.boundary[0] == first.boundary[-1] and first.boundary_area_km2 >= 0.049
    run = get("analysis_runs").first()
    assert (run.eps, run.least, run.dataset_size) == (250.0, 5, 800) and run.noise_count == labels.where("label < 0").count()
    assert {(r.source_key, r.sha256) for r in get("ingestion_runs").collect()} == {(None, raw.sha256_of(s.csv)), ("c", None)}
    assert [(r.eps, r.least, r.selected, r.passing) for r in get("sweep_marked").orderBy("eps").collect()] == [(200.0, 5, False, False), (250.0, 5, True, False)]


def test_clusters_count_all_complaints(whole):
    _, _, get, _ = whole
    sums = get("monthly").where("unit_type = 'cluster'").groupBy("unit").agg({"all_reports": "sum", "target_reports": "sum"}).collect()
    assert sums and all(r["sum(all_reports)"] > r["sum(target_reports)"] > 0 for r in sums)
    assert all(0 < r.complaint_share < 1 and r.all_complaints_in_footprint > r.report_count for r in get("hotspots").collect())
    assert get("monthly_active").count() == get("monthly").count() and {r.active_month for r in get("monthly_active").collect()} == {0, 1}
    assert {r.unit for r in get("city_trend").collect()} == {"count", "share"} and get("k_distance").count() == 4
    assert get("with_pins").first().points >= 800 and get("hdbscan").first().clusters > 0
    assert get("grid").groupBy().sum("points").first()[0] == 800
    # the area is the drawn outline's, which is larger than the hull
    areas = get("cluster_metrics").select("unit", "area_km2").join(get("clusters").selectExpr("label as unit", "boundary_area_km2"), "unit").collect()
    assert areas and all(r.area_km2 >= r.boundary_area_km2 for r in areas)


def test_reports_and_second_source(spark, whole):
    s, _, get, out = whole
    quality_parts = surface.quality(spark, s.out)
    assert quality_parts["gate"].first().encoding == "UTF-8" and quality_parts["status_distribution"].first().complaints == 1200
    features = json.loads("\n".join(p.read_text() for p in (out / "clusters_geojson").glob("part-*")))
    assert features["metadata"]["eps_meters"] == 250.0 and len(features["features"]) == 2 * get("hotspots").count()
    ranks = [int(r["rank"]) for r in artifacts.read_csv_report(spark, str(out / "cluster_summary_csv")).collect()]
    assert ranks == sorted(ranks) and len(ranks) == get("hotspots").count()
    assert "## Second source" in "\n".join(p.read_text() for p in (out / "analysis_md").glob("part-*"))
    second = get("secondary").first()
    assert second.wards == 2 and second.second_inside == 100 and second.rho is None
    d = get("secondary_density").first()
    assert d.inside + d.elsewhere == 100 and d.ratio > 1 and 0 < d.area_km2 < d.city_km2


def test_changed_titles_stop_the_run(spark, tmp_path):
    write_inputs(tmp_path, 60)
    s = pipeline.Settings(str(tmp_path / "c.csv"), str(tmp_path / "w.kml"), str(tmp_path / "out"), [66], taxonomy={66: ("Roads", "Hole")})
    with pytest.raises(cleaning.SchemaError):
        pipeline.run(spark, s)


def test_gate_stops_the_run(spark, tmp_path):
    write_inputs(tmp_path, 60)
    s = pipeline.Settings(str(tmp_path / "c.csv"), str(tmp_path / "w.kml"), str(tmp_path / "out"), [66])
    assert pipeline.run(spark, s) == {"gate_passed": False}
    assert artifacts.get_artifact(spark, s.out, "clusters") is None


def test_second_source(spark):
    counts = spark.createDataFrame([(k, k * 3, k + (5 if k == 3 else 0)) for k in range(12)], "ward_id int, second long, first long")
    got = secondary.comparison(counts).first()
    assert got.wards == 12 and got.top_overlap == 12 and 0.9 < got.rho < 1 and 0 < got.p_value < 1e-4 and got.ratio == 2.8
    assert secondary.student_tail(2.228, 10) == pytest.approx(0.05, abs=1e-4) and secondary.student_tail(0.0, 5) == 1
    few = secondary.comparison(counts.limit(5)).first()
    assert few.rho is None and few.p_value is None and few.top_overlap is None and secondary.comparison(counts.limit(0)).first().wards == 0
