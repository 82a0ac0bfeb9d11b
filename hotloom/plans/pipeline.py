"""The whole run over raw files: read, clean, check, cluster, describe, store. Each stage writes artifacts that the next
one and the read side take."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hotloom.functions.planar import to_utm
from hotloom.operators import cleaning, quality, regions, secondary, series, shapes, sweeps
from hotloom.operators.ranking import with_rank
from hotloom.sources import artifacts, raw


@dataclass
class Settings:
    """Paths, which sub-categories are targets, and the swept grid. eps and min_samples override the choice together."""

    csv: str
    wards: str
    out: str
    targets: list[int]
    eps: float | None = None
    least: int | None = None
    eps_list: list[float] = field(default_factory=lambda: list(sweeps.EPS_METRES))
    least_list: list[int] = field(default_factory=lambda: list(sweeps.MIN_SAMPLES))
    reps: int = 20
    #: Titles (category, sub-category) that the targets' ids must have; a run over a file whose titles differ is refused.
    taxonomy: dict[int, tuple[str, str]] | None = None
    #: KML of a second source, compared but never merged.
    records: str | None = None
    #: JSON records of the sources, as fetch() writes them (a path, may hold wildcards).
    metadata: str | None = None


KEY = ["created_at", "latitude", "longitude", "sub_category_id", "title", "description"]


def reported(d: DataFrame) -> DataFrame:
    """Stored complaints with the columns that the quality reports read."""
    return d.withColumns({"lat": F.col("latitude"), "lon": F.col("longitude"), "category": F.col("issue_type"), "sub_category": F.col("sub_issue_type"), "pin": F.col("suspect_fallback_pin"), "reported": F.col("local_time").cast("date").cast("string")})


def preprocess(spark: SparkSession, s: Settings) -> bool:
    """Store clean complaints, wards and quality reports; whether the data gate is passed. Only the columns of
    cleaning.STORED are kept."""
    rows, encoding = raw.read_raw(spark, s.csv)
    if s.taxonomy:
        cleaning.check_taxonomy(rows, "sub_category_id", "sub_category_title", "category_title", s.taxonomy)
    files = raw.checksums(spark, s.csv).select(F.col("path").alias("source_identifier"), "file_size", "sha256")
    if s.metadata:
        files = files.unionByName(raw.read_metadata(spark, s.metadata), allowMissingColumns=True)
    artifacts.put_artifact(files.withColumn("recorded_at", F.current_timestamp()), s.out, "ingestion_runs")
    artifacts.put_artifact(raw.read_wards(spark, s.wards), s.out, "wards")
    wards = artifacts.get_artifact(spark, s.out, "wards")
    key = [k for k in KEY if k in rows.columns]
    clean = cleaning.normalise(rows.withColumn("rowid_", F.monotonically_increasing_id()), wards, s.targets, key)
    clean = clean.withColumns({"run_id": F.lit(1), "month": F.date_format("local_time", "yyyy-MM"), "status": F.col("complaint_status_title")})
    names = wards.select(F.col("ward_id").alias("__w"), F.col("name").alias("ward_name"))
    clean = clean.join(F.broadcast(names), F.col("ward_id") == F.col("__w"), "left").select(*cleaning.STORED)
    artifacts.put_artifact(clean, s.out, "complaints")
    d = reported(artifacts.get_artifact(spark, s.out, "complaints"))
    for name, report in {
        "category_distribution": quality.distribution(d, ["category", "sub_category", "is_target"]), "monthly_quality": quality.monthly_quality(d), "coordinate_quality": quality.coordinate_quality(d),
        "duplicate_stats": quality.duplicate_stats(d), "duplicate_coordinates": quality.duplicate_coordinates(d), "multiplicities": quality.multiplicity_histogram(d),
        "status_counts": d.groupBy("status").agg(F.count(F.lit(1)).alias("complaints")), "missing_values": cleaning.null_counts(rows.drop(*cleaning.SENSITIVE)), "exact_copies": quality.exact_copies(rows),
        "gate": quality.data_gate(d).withColumn("encoding", F.lit(encoding)), "yearly": d.where("month is not null").groupBy(F.substring("month", 1, 4).alias("year")).agg(F.count(F.lit(1)).alias("complaints"), F.count_if("is_target").alias("targets")),
    }.items():
        artifacts.put_artifact(report, s.out, name)
    return bool(artifacts.get_artifact(spark, s.out, "gate").first()["passed"])


def points(d: DataFrame) -> DataFrame:
    return d.where("usable and is_target and not suspect_fallback_pin").select(F.col("rowid_").alias("pid"), F.col("latitude").alias("lat"), F.col("longitude").alias("lon"))


def cluster(spark: SparkSession, s: Settings) -> tuple[float, int]:
    """Sweep, choose a configuration, and store sweep, membership and cluster records."""
    d = reported(artifacts.get_artifact(spark, s.out, "complaints"))
    # row numbers of the reader are wide; ranks are what the clustering takes
    ranked = with_rank(d.where("usable and not pin").select("rowid_", "lat", "lon", "is_target"), ["rowid_"], "pid")
    artifacts.put_artifact(ranked, s.out, "points")
    ranked = artifacts.get_artifact(spark, s.out, "points")
    mine, pool = ranked.where("is_target").select("pid", "lat", "lon"), ranked.where("not is_target").select("pid", "lat", "lon")
    artifacts.put_artifact(sweeps.sweep(mine, pool, s.eps_list, s.least_list, s.reps), s.out, "sweep")
    grid = artifacts.get_artifact(spark, s.out, "sweep")
    chosen = sweeps.select_config(grid, s.eps, s.least).first()
    # the swept grid once more, with what passed and what was chosen; nothing passes beside an override
    good = sweeps.passing(grid if s.eps is None else grid.limit(0)).select("eps", "least", F.lit(True).alias("passing"))
    marked = grid.join(good, ["eps", "least"], "left").fillna(False, ["passing"]).withColumn("selected", (F.col("eps") == chosen["eps"]) & (F.col("least") == chosen["least"]))
    artifacts.put_artifact(marked, s.out, "sweep_marked")
    run = marked.where("selected").select(F.lit(1).alias("run_id"), F.current_timestamp().alias("created_at"), "eps", "least", F.col("points").alias("dataset_size"), "cluster_count", "noise_count", "noise_percentage")
    artifacts.put_artifact(run, s.out, "analysis_runs")
    labels = sweeps.labelled(mine, [chosen["eps"]], [chosen["least"]]).join(ranked.select("pid", "rowid_"), "pid")
    artifacts.put_artifact(labels, s.out, "membership")
    labels = artifacts.get_artifact(spark, s.out, "membership")
    dates = d.join(ranked.select("rowid_", "pid"), "rowid_").select("pid", F.col("local_time").cast("date").alias("date"))
    artifacts.put_artifact(sweeps.cluster_records(labels, dates, chosen["eps"]), s.out, "clusters")
    compare(spark, s, chosen["eps"], chosen["least"])
    return chosen["eps"], chosen["least"]


def compare(spark: SparkSession, s: Settings, eps: float, least: int) -> None:
    """Store what stands beside the choice: k-distances with their knees, the same configuration with suspected pins, the
    hierarchical comparison, and counts per 250 m cell."""
    d, ranked, labels = (artifacts.get_artifact(spark, s.out, n) for n in ("complaints", "points", "membership"))
    d = reported(d)
    mine = ranked.where("is_target").select("pid", "lat", "lon")
    artifacts.put_artifact(sweeps.k_distances(mine, sweeps.KNN_KS), s.out, "k_distances")
    far = artifacts.get_artifact(spark, s.out, "k_distances")
    levels = far.groupBy("k").agg(*[F.percentile("metres", F.lit(p)).alias(f"p{p * 100:g}") for p in sweeps.KDIST_LEVELS])
    knees = [sweeps.knee(far.where(F.col("k") == k), "metres").select(F.lit(k).alias("k"), F.col("metres").alias("knee_m")) for k in sweeps.KNN_KS]
    bends = knees[0]
    for k in knees[1:]:
        bends = bends.unionByName(k)
    artifacts.put_artifact(levels.join(bends, "k"), s.out, "k_distance")
    every = with_rank(d.where("usable and is_target").select("rowid_", "lat", "lon", "pin"), ["rowid_"], "pid")
    artifacts.put_artifact(every, s.out, "points_with_pins")
    every = artifacts.get_artifact(spark, s.out, "points_with_pins")
    pins = every.where("pin").groupBy("lat", "lon").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n").alias("largest_pin"))
    again = sweeps.sweep_metrics(sweeps.labelled(every.select("pid", "lat", "lon"), [eps], [least]), ["eps", "least"])
    again = again.withColumn("__k", F.lit(1)).join(pins.withColumn("__k", F.lit(1)), "__k").drop("__k")
    artifacts.put_artifact(again.withColumn("warnings", sweeps.sanity_warnings()), s.out, "with_pins")
    both = labels.select("pid", F.col("label").alias("la")).join(sweeps.hdbscan(mine, least).withColumnRenamed("label", "lb"), "pid").withColumn("least", F.lit(least))
    artifacts.put_artifact(both, s.out, "hdbscan_membership")
    both = artifacts.get_artifact(spark, s.out, "hdbscan_membership")
    figures = both.groupBy("least").agg((F.max("lb") + 1).alias("clusters"), (F.lit(100.0) * F.count_if(F.col("lb") < 0) / F.count(F.lit(1))).alias("noise_percentage"))
    artifacts.put_artifact(figures.join(sweeps.adjusted_rand(both, ["least"], "la", "lb"), "least"), s.out, "hdbscan")
    artifacts.put_artifact(shapes.grid_cells(labels.withColumn("clustered", F.col("label") >= 0)), s.out, "grid")


def footprint_months(d: DataFrame, clusters: DataFrame, months: DataFrame) -> DataFrame:
    """(unit, month, all_reports): usable complaints without suspected pins inside each cluster's outline, of any
    category; where outlines overlap, a complaint counts for each."""
    ring = F.transform("boundary", lambda p: F.struct(p[0].alias("lon"), p[1].alias("lat")))
    rings = clusters.select(F.col("label").cast("int").alias("ward_id"), F.array(ring).alias("rings"))
    inside = regions.containing_regions(d.where("usable and not pin").select("lat", "lon", "month"), rings, "lat", "lon", "held").select("month", F.explode("held").alias("label"))
    return series.dense_unit_month(inside, "label", months, clusters.select(F.col("label").alias("unit")), F.lit(False)).select("unit", "month", "all_reports")


def outline_areas(clusters: DataFrame) -> DataFrame:
    """(unit, area_km2) of clusters: that of the stored outline, if the stored area isn't larger."""
    ring = F.transform("boundary", lambda p: F.struct(p[0].alias("lon"), p[1].alias("lat")))
    drawn = shapes.polygon_areas(clusters.select(F.col("label").cast("int").alias("ward_id"), F.array(ring).alias("rings")))
    both = clusters.select("label", "boundary_area_km2").join(drawn, F.col("label") == F.col("ward_id"))
    return both.select(F.col("label").alias("unit"), F.greatest("boundary_area_km2", "area_km2").alias("area_km2"))


def second_source(spark: SparkSession, s: Settings) -> None:
    """Store how a second source's records compare: counts per ward, their figures, and the density inside and outside the
    clusters' outlines."""
    d, wards, clusters = (artifacts.get_artifact(spark, s.out, n) for n in ("complaints", "wards", "clusters"))
    artifacts.put_artifact(raw.read_records(spark, s.records), s.out, "records")
    records = artifacts.get_artifact(spark, s.out, "records")
    artifacts.put_artifact(secondary.ward_counts(records, wards, d), s.out, "secondary_counts")
    artifacts.put_artifact(secondary.comparison(artifacts.get_artifact(spark, s.out, "secondary_counts")), s.out, "secondary")
    x, y = to_utm("lat", "lon")
    corner = clusters.select("label", F.posexplode("boundary").alias("i", "p")).select("label", "i", F.col("p")[1].alias("lat"), F.col("p")[0].alias("lon"))
    rings = corner.select("label", "i", x.alias("x"), y.alias("y")).groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x", "y"))), lambda p: F.array(p["x"], p["y"])).alias("outline"))
    inner = regions.containing_region(records.where("latitude is not null and longitude is not null"), wards, "latitude", "longitude", "ward").where("ward >= 0")
    as_region = clusters.select(F.col("label").cast("int").alias("ward_id"), F.array(F.transform("boundary", lambda p: F.struct(p[0].alias("lon"), p[1].alias("lat")))).alias("rings"))
    held = regions.containing_region(inner, as_region, "latitude", "longitude", "label")
    n = held.agg(F.count_if(F.expr("label >= 0")).alias("inside"), F.count_if(F.expr("label < 0")).alias("elsewhere"))
    city = shapes.polygon_areas(wards).agg(F.sum("area_km2").alias("city_km2"))
    artifacts.put_artifact(secondary.density(n, shapes.dissolved_area(rings, "label"), city), s.out, "secondary_density")


def city_trends(wards: DataFrame) -> DataFrame:
    """Trend of the city's target counts and of its share in thousandths, from the wards' series; each by itself."""
    c = wards.groupBy("month").agg(F.sum("target_reports").alias("t"), F.sum("all_reports").alias("n"))
    share = F.rint(F.rint(F.coalesce(F.col("t") / F.nullif("n", F.lit(0)), F.lit(0.0)) * 10000) / 10)
    one = lambda name, v: series.label_trends(series.trend_stats(c.select(F.lit(name).alias("unit"), "month", v.cast("double").alias("v")), "unit", "v"))
    return one("count", F.col("t")).unionByName(one("share", share))


def temporal(spark: SparkSession, s: Settings) -> None:
    """Store dense monthly series of wards and clusters, their metrics and trends, and ranked hotspots."""
    d, wards, labels = (artifacts.get_artifact(spark, s.out, n) for n in ("complaints", "wards", "membership"))
    d = reported(d)
    months = series.month_spine(d, "month")
    w = series.dense_unit_month(d.where("usable and not pin"), "ward_id", months, wards.select(F.col("ward_id").alias("unit")), F.col("is_target"))
    member = d.join(labels.where("label >= 0").select("rowid_", "label"), "rowid_")
    clusters = artifacts.get_artifact(spark, s.out, "clusters")
    c = series.dense_unit_month(member, "label", months, labels.where("label >= 0").select(F.col("label").alias("unit")).distinct(), F.col("is_target"))
    c = c.select("unit", "month", "target_reports").join(footprint_months(d, clusters, months), ["unit", "month"]).withColumn("share", F.col("target_reports") / F.nullif("all_reports", F.lit(0)))
    artifacts.put_artifact(w.withColumn("unit_type", F.lit("ward")).unionByName(c.withColumn("unit_type", F.lit("cluster"))), s.out, "monthly")
    m = artifacts.get_artifact(spark, s.out, "monthly")
    areas = shapes.polygon_areas(wards).select(F.col("ward_id").alias("unit"), "area_km2")
    total = points(d).count() / max(areas.agg(F.sum("area_km2")).first()[0] * months.count(), 1e-9)
    artifacts.put_artifact(city_trends(m.where("unit_type = 'ward'")), s.out, "city_trend")
    for kind, units in (("ward", areas), ("cluster", outline_areas(clusters))):
        own = m.where(F.col("unit_type") == kind)
        metrics = series.unit_metrics(own, units, F.lit(total), test=kind == "ward")
        trend = series.label_trends(series.trend_stats(own, "unit", "target_reports")).drop("months", "reports", "s", "var", "valid")
        if kind == "cluster":
            all_of = F.sum("all_reports")
            metrics = metrics.join(own.groupBy("unit").agg(all_of.alias("all_complaints_in_footprint"), (F.sum("target_reports") / F.nullif(all_of, F.lit(0))).alias("complaint_share")), "unit")
        artifacts.put_artifact(metrics.join(series.recent_activity(own, "unit", "target_reports"), "unit").join(trend, "unit"), s.out, f"{kind}_metrics")
    thresholds = [artifacts.get_artifact(spark, s.out, f"{kind}_metrics").select(F.lit(kind).alias("unit_type"), "unit", "active_threshold") for kind in ("ward", "cluster")]
    flagged = m.join(thresholds[0].unionByName(thresholds[1]), ["unit_type", "unit"]).withColumn("active_month", (F.col("target_reports") >= F.col("active_threshold")).cast("int"))
    artifacts.put_artifact(flagged.drop("active_threshold"), s.out, "monthly_active")
    ranked = clusters.join(artifacts.get_artifact(spark, s.out, "cluster_metrics").withColumnRenamed("unit", "label").drop("area_km2"), "label")
    ranked = with_rank(ranked.withColumns({"__n": -F.col("report_count"), "__d": -F.col("density_reports_per_km2")}), ["__n", "__d", "label"], "rank").drop("__n", "__d")
    artifacts.put_artifact(ranked.withColumns({"run_id": F.lit(1), "cluster_id": F.col("label")}), s.out, "hotspots")


def write_reports(spark: SparkSession, s: Settings) -> None:
    """Store CSV, GeoJSON and Markdown reports of what the stages stored."""
    get = lambda name: artifacts.get_artifact(spark, s.out, name)
    chosen = get("sweep_marked").where("selected")
    hotspots = get("hotspots")
    row = chosen.first()
    properties = ["cluster_id", "rank", "report_count", "approx_radius_meters", "density_reports_per_km2", "date_min", "date_max", "persistence", "active_months", "trend", "complaint_share", "single_coordinate_cluster"]
    artifacts.write_geojson(artifacts.cluster_features(hotspots, properties), f"{s.out}/clusters_geojson", {"eps_meters": row["eps"], "min_samples": row["least"], "dataset_size": row["points"]})
    artifacts.cluster_csv(hotspots, f"{s.out}/cluster_summary_csv")
    for name in ("category_distribution", "monthly_quality", "coordinate_quality", "duplicate_coordinates", "sweep_marked"):
        artifacts.write_csv(get(name), f"{s.out}/{name}_csv")
    artifacts.write_csv(get("monthly_active").where("unit_type = 'ward'"), f"{s.out}/spatial_unit_monthly_csv", ["unit", "month"])
    dataset = {"Gate": get("gate"), "Months": get("monthly_quality").orderBy("month"), "Years": get("yearly").orderBy("year"), "Categories": get("category_distribution").orderBy(F.desc("complaints")), "Coordinates": get("coordinate_quality"), "Repeats": get("duplicate_stats"), "Status": get("status_counts").orderBy(F.desc("complaints"))}
    artifacts.write_report(spark, dataset, f"{s.out}/dataset_md")
    sizes = hotspots.agg(F.min("report_count").alias("least"), F.percentile("report_count", F.lit(0.5)).alias("median"), F.max("report_count").alias("largest"), F.min("approx_radius_meters").alias("radius_min"), F.percentile("approx_radius_meters", F.lit(0.5)).alias("radius_median"), F.max("approx_radius_meters").alias("radius_max"))
    analysis = {"Selected configuration": chosen, "All configurations": get("sweep_marked").orderBy("least", "eps"), "k-distances": get("k_distance").orderBy("k"), "Sizes and radii": sizes, "With suspected pins": get("with_pins"), "Hierarchical comparison": get("hdbscan"), "City trend": get("city_trend")}
    if s.records:
        analysis |= {"Second source": get("secondary"), "Second source inside and outside of clusters": get("secondary_density")}
    artifacts.write_report(spark, analysis, f"{s.out}/analysis_md")


def run(spark: SparkSession, s: Settings) -> dict:
    """All stages; with a data gate that isn't passed only the first, and no clusters."""
    if not preprocess(spark, s):
        return {"gate_passed": False}
    eps, least = cluster(spark, s)
    temporal(spark, s)
    if s.records:
        second_source(spark, s)
    write_reports(spark, s)
    return {"gate_passed": True, "eps": eps, "least": least}
