"""Queries of the report operators, over the stored tables. The SQL beside each is in report_sql."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hotloom.functions.planar import to_latlon, to_utm
from hotloom.functions.sphere import haversine
from hotloom.operators import cleaning, proximity, quality, regions, secondary, series, shapes, sweeps
from hotloom.operators.ranking import with_rank
from hotloom.operators.silhouettes import silhouettes
from hotloom.plans import report_sql, surface
from hotloom.session import stage, stage_path
from hotloom.sources import artifacts
from hotloom.sources.tables import table

CENTRE = (12.9716, 77.5946)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def issues(spark: SparkSession, folder: str) -> DataFrame:
    """Complaints with clean categories, booleans that are never null, month only where it is YYYY-MM, and the day of
    stamps in the raw file's notation as reported."""
    c = table(spark, folder, "complaints")
    clean = lambda name: F.coalesce(F.lower(F.trim(name)), F.lit("unknown"))
    yes = lambda name: F.coalesce(F.col(name) == 1, F.lit(False))
    return c.select(
        "rowid_", "run_id", "request_id", F.when(F.col("month").rlike(r"^\d{4}-\d{2}$"), F.col("month")).alias("month"), clean("issue_type").alias("category"), clean("sub_issue_type").alias("sub_category"),
        clean("status").alias("status"), "ward_id", "source_ward_id", F.col("latitude").alias("lat"), F.col("longitude").alias("lon"), yes("is_pothole").alias("is_target"), yes("in_boundary").alias("in_boundary"),
        yes("usable").alias("usable"), yes("suspect_fallback_pin").alias("pin"), F.col("coord_multiplicity").alias("mult"),
        cleaning.month_first(F.col("created_at")).cast("date").cast("string").alias("reported"),
    )


def analysed(spark: SparkSession, folder: str, pins: bool = False) -> DataFrame:
    """(pid, lat, lon): usable targets, without suspected default pins unless ``pins``."""
    d = issues(spark, folder).where(F.col("usable") & F.col("is_target"))
    d = d if pins else d.where(~F.col("pin"))
    return d.select(F.col("rowid_").cast("long").alias("pid"), "lat", "lon")


def labels(spark: SparkSession, folder: str, eps: float = 250.0, least: int = 5, pins: bool = False) -> DataFrame:
    return sweeps.labelled(analysed(spark, folder, pins), [eps], [least])


def ward_series(spark: SparkSession, folder: str) -> DataFrame:
    """Dense monthly series of all wards over the range of all complaints; as in the clustering, suspected pins are out."""
    d = issues(spark, folder)
    units = table(spark, folder, "wards").select(F.col("ward_id").alias("unit"))
    return series.dense_unit_month(d.where("usable and not pin"), "ward_id", series.month_spine(d, "month"), units, F.col("is_target"))


# ---- sources, sinks, scans


@query
def scan_project(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "complaints").select("rowid_", "request_id", "issue_type", "status", "latitude", "longitude")


@query
def load_where(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "complaints").where((F.col("run_id") == 1) & (F.col("usable") == 1) & (F.col("latitude") > 13.0)).select("rowid_", "latitude", "longitude")


@query
def roundtrip_parquet(spark: SparkSession, folder: str) -> DataFrame:
    where = stage_path(spark, "stored")
    artifacts.put_artifact(table(spark, folder, "complaints").select("rowid_", "status", "ward_id", "latitude"), where, "complaints")
    return artifacts.get_artifact(spark, where, "complaints")


@query
def artifact_json(spark: SparkSession, folder: str) -> DataFrame:
    return artifacts.as_json(table(spark, folder, "cluster_summary").select("run_id", "cluster_id", "report_count", "observed_trend"))


@query
def nan_to_null(spark: SparkSession, folder: str) -> DataFrame:
    e = table(spark, folder, "events").select("event_id", F.when(F.col("event_id") % 7 == 0, float("nan")).when(F.col("event_id") % 11 == 0, float("-inf")).otherwise(F.col("value")).alias("value"))
    return cleaning.finite_or_null(e)


@query
def geojson_features(spark: SparkSession, folder: str) -> DataFrame:
    return artifacts.cluster_features(table(spark, folder, "cluster_summary"), ["cluster_id", "report_count", "rank"])


@query
def simplified_wards(spark: SparkSession, folder: str) -> DataFrame:
    return shapes.simplify_regions(table(spark, folder, "wards")).select("ward_id", F.size("rings").alias("rings"), F.size(F.flatten("rings")).alias("points"))


@query
def json_extract(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "events").select("event_id", F.from_json("props", "k int")["k"].alias("k"))


# ---- expressions and filters


@query
def parse_ts(spark: SparkSession, folder: str) -> DataFrame:
    t = cleaning.month_first(F.col("created_at"))
    return table(spark, folder, "complaints").select("rowid_", F.date_format(t, "yyyy-MM-dd HH:mm").alias("local_time"))


@query
def taxonomy_filter(spark: SparkSession, folder: str) -> DataFrame:
    d = issues(spark, folder).where(F.col("sub_category").isin("pothole on carriageway", "pothole patch requested"))
    return d.groupBy("category", "sub_category").agg(F.count(F.lit(1)).alias("complaints"), F.count_if(~F.col("is_target")).alias("not_target"))


@query
def surrogate_key(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "complaints").select("rowid_", cleaning.surrogate_key(["created_at", "ward_id", "issue_type", "sub_issue_type"]).alias("key"))


@query
def coord_flags(spark: SparkSession, folder: str) -> DataFrame:
    c = table(spark, folder, "complaints")
    return c.select("rowid_", *[v.alias(k) for k, v in cleaning.coordinate_flags(F.col("latitude"), F.col("longitude")).items()])


@query
def normalise(spark: SparkSession, folder: str) -> DataFrame:
    """The stored complaints brought back to the raw form's columns and normalised as a raw file is."""
    c = table(spark, folder, "complaints")
    text = lambda name: F.lit(None).cast("string").alias(name)
    raw = c.select(
        "rowid_", "created_at", F.col("source_ward_id").alias("ward_id"), text("title"), text("description"), F.when(F.col("is_pothole") == 1, 66).otherwise(1).alias("sub_category_id"), F.lit(1.0).alias("civic_agency_id"), text("location"), text("address"),
        "latitude", "longitude", F.col("ward_name").alias("ward_title"), F.lit(1.0).alias("category_id"), F.col("issue_type").alias("category_title"), F.col("sub_issue_type").alias("sub_category_title"), text("civic_agency_title"), F.col("status").alias("complaint_status_title"), F.lit(0).alias("comment_count"),
    )
    n = cleaning.normalise(raw, table(spark, folder, "wards"), [66], ["created_at", "category_title", "sub_category_title"])
    return n.select("rowid_", "request_id", "issue_type", "ward_id", "source_ward_id", "is_target", "null_coord", "coarse", "in_boundary", "coord_multiplicity", "suspect_fallback_pin", "valid_coord", "usable")


@query
def coord_multiplicity(spark: SparkSession, folder: str) -> DataFrame:
    return cleaning.multiplicity(table(spark, folder, "complaints").select("rowid_", "latitude", "longitude"), ["latitude", "longitude"], "n")


@query
def coarsen(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "complaints").select("rowid_", cleaning.coarsened(F.col("latitude")).alias("lat3"), cleaning.coarsened(F.col("longitude")).alias("lon3"))


@query
def analysis_set(spark: SparkSession, folder: str) -> DataFrame:
    return analysed(spark, folder)


@query
def null_counts(spark: SparkSession, folder: str) -> DataFrame:
    return cleaning.null_counts(table(spark, folder, "complaints"))


@query
def dim_lookup(spark: SparkSession, folder: str) -> DataFrame:
    """Each complaint with its ward's name and zone, null for none."""
    w = table(spark, folder, "wards").select("ward_id", F.col("name").alias("official_name"), "zone")
    return issues(spark, folder).select("rowid_", "ward_id").join(w, "ward_id", "left")


@query
def string_date_ops(spark: SparkSession, folder: str) -> DataFrame:
    o = table(spark, folder, "orders")
    return o.select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM").alias("month"), F.substring("o_orderpriority", 1, 1).alias("level"), F.replace(F.trim("o_orderpriority"), F.lit("-"), F.lit(" ")).alias("priority"), F.col("o_orderpriority").startswith("1").alias("urgent"))


@query
def tz_month(spark: SparkSession, folder: str) -> DataFrame:
    """Events per local day of a zone east of UTC."""
    e = table(spark, folder, "events").select(F.from_utc_timestamp(F.col("ts").cast("timestamp"), "Asia/Kolkata").alias("t"))
    return e.groupBy(F.date_format("t", "yyyy-MM-dd").alias("day")).agg(F.count(F.lit(1)).alias("events"))


# ---- joins and dense series


@query
def month_spine(spark: SparkSession, folder: str) -> DataFrame:
    return series.month_spine(issues(spark, folder), "month")


@query
def dense_unit_month(spark: SparkSession, folder: str) -> DataFrame:
    return ward_series(spark, folder)


@query
def monthly_quality(spark: SparkSession, folder: str) -> DataFrame:
    return quality.monthly_quality(issues(spark, folder))


@query
def month_gaps(spark: SparkSession, folder: str) -> DataFrame:
    return quality.month_gaps(issues(spark, folder))


@query
def membership_inner(spark: SparkSession, folder: str) -> DataFrame:
    m = labels(spark, folder).where("label >= 0").select("pid", "label")
    d = issues(spark, folder).join(m, F.col("rowid_") == F.col("pid"))
    return d.groupBy("label", "status").agg(F.count(F.lit(1)).alias("reports"))


@query
def membership_left(spark: SparkSession, folder: str) -> DataFrame:
    m = labels(spark, folder).select("pid", "label")
    d = issues(spark, folder).where("is_target").join(m, F.col("rowid_") == F.col("pid"), "left")
    return d.select("rowid_", F.coalesce(F.col("label") != -1, F.lit(False)).alias("clustered"))


@query
def full_outer_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Targets per ward in the one run and the other, wards of either."""
    d = issues(spark, folder).where(F.col("is_target") & (F.col("ward_id") >= 1))
    side = lambda run, name: d.where(F.col("run_id") == run).groupBy("ward_id").agg(F.count(F.lit(1)).alias(name))
    return side(1, "main").join(side(2, "later"), "ward_id", "full").fillna(0, ["main", "later"])


@query
def spearman(spark: SparkSession, folder: str) -> DataFrame:
    return series.spearman(full_outer_counts(spark, folder), "main", "later")


@query
def top20_overlap(spark: SparkSession, folder: str) -> DataFrame:
    both = full_outer_counts(spark, folder)
    top = lambda name: both.orderBy(F.desc(name), "ward_id").limit(20).select("ward_id")
    return top("main").intersect(top("later"))


@query
def semi_join(spark: SparkSession, folder: str) -> DataFrame:
    """Complaints of wards with a stored increasing cluster's month of ten targets or more."""
    busy = table(spark, folder, "spatial_unit_monthly").where((F.col("unit_type") == "ward") & (F.col("pothole_reports") >= 10)).select(F.col("unit_id").alias("ward_id"))
    return issues(spark, folder).select("rowid_", "ward_id").join(busy, "ward_id", "left_semi")


@query
def union_units(spark: SparkSession, folder: str) -> DataFrame:
    """Monthly rows of wards and of clusters as one table, from the stamped labels."""
    d = issues(spark, folder).where(F.col("is_target") & F.col("month").isNotNull())
    w = d.where("ward_id >= 1").groupBy(F.lit("ward").alias("unit_type"), F.col("ward_id").cast("long").alias("unit_id"), "month").agg(F.count(F.lit(1)).alias("reports"))
    m = labels(spark, folder).where("label >= 0").select("pid", "label")
    c = d.join(m, F.col("rowid_") == F.col("pid")).groupBy(F.lit("cluster").alias("unit_type"), F.col("label").cast("long").alias("unit_id"), "month").agg(F.count(F.lit(1)).alias("reports"))
    return w.unionByName(c)


# ---- places


@query
def haversine_centre(spark: SparkSession, folder: str) -> DataFrame:
    return analysed(spark, folder).select("pid", haversine(F.col("lat"), F.col("lon"), F.lit(CENTRE[0]), F.lit(CENTRE[1])).alias("metres"))


@query
def near_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    """Targets of a valid coordinate, inside the wards or not, with another one within 10 m, at the same coordinate or not."""
    flags = cleaning.coordinate_flags(F.col("lat"), F.col("lon"))
    p = issues(spark, folder).where(F.col("is_target") & ~(flags["null_coord"] | flags["out_of_range"] | flags["zero_zero"] | flags["swapped"]))
    at = stage(p.groupBy("lat", "lon").agg(F.count(F.lit(1)).alias("w")), "spots")
    pairs = proximity.near_pairs(at, [], 10.0)
    near = pairs.select(F.col("lat_a").alias("lat"), F.col("lon_a").alias("lon")).union(pairs.select("lat_b", "lon_b")).distinct().withColumn("near", F.lit(True))
    counted = at.join(near, ["lat", "lon"], "left").where((F.col("w") > 1) | F.col("near"))
    return counted.agg(F.coalesce(F.sum("w"), F.lit(0)).alias("reports"), F.count(F.lit(1)).alias("places"))


@query
def utm_project(spark: SparkSession, folder: str) -> DataFrame:
    x, y = to_utm("lat", "lon")
    return analysed(spark, folder).select("pid", (F.floor(x * 100 + 0.5) / 100).alias("x"), (F.floor(y * 100 + 0.5) / 100).alias("y"))


@query
def utm_roundtrip(spark: SparkSession, folder: str) -> DataFrame:
    """Points whose projection, taken back, is off by a ten-millionth of a degree or more: none."""
    x, y = to_utm("lat", "lon")
    a, b = to_latlon("x", "y")
    d = analysed(spark, folder).select("pid", "lat", "lon", x.alias("x"), y.alias("y")).withColumns({"a": a, "b": b})
    return d.agg(F.count(F.lit(1)).alias("points"), F.count_if((F.abs(F.col("a") - F.col("lat")) >= 1e-7) | (F.abs(F.col("b") - F.col("lon")) >= 1e-7)).alias("off"))


@query
def centroid(spark: SparkSession, folder: str) -> DataFrame:
    d = issues(spark, folder).where(F.col("usable") & (F.col("ward_id") >= 1))
    c = shapes.centres(d, ["ward_id"])
    return c.select("ward_id", F.rint(F.col("centre_lat") * 1e6).alias("lat_e6"), F.rint(F.col("centre_lon") * 1e6).alias("lon_e6"))


@query
def cluster_radius(spark: SparkSession, folder: str) -> DataFrame:
    m = labels(spark, folder).where("label >= 0")
    return shapes.radii(m, shapes.centres(m, ["label"]), ["label"]).select("label", F.rint(F.col("radius_m") * 10).alias("radius_dm"))


@query
def point_in_polygon(spark: SparkSession, folder: str) -> DataFrame:
    c = table(spark, folder, "complaints").select("rowid_", "latitude", "longitude")
    return regions.containing_region(c, table(spark, folder, "wards"), "latitude", "longitude", "ward").select("rowid_", "ward")


@query
def polygon_area(spark: SparkSession, folder: str) -> DataFrame:
    return shapes.polygon_areas(table(spark, folder, "wards")).select("ward_id", F.rint(F.col("area_km2") * 1e6).alias("area_m2"))


@query
def grid_250m(spark: SparkSession, folder: str) -> DataFrame:
    m = labels(spark, folder).withColumn("clustered", F.col("label") >= 0)
    return shapes.grid_cells(m)


@query
def hull_area(spark: SparkSession, folder: str) -> DataFrame:
    """Each cluster's hull and the area of its outline 50 m around."""
    return shapes.outlines(labels(spark, folder).where("label >= 0"), "label").drop("outline")


def footprints(outlines: DataFrame) -> DataFrame:
    """(ward_id, rings): the outlines of the clusters as regions, named by label."""
    p = outlines.select("label", F.posexplode("outline").alias("i", "p")).select("label", "i", F.col("p")[0].alias("x"), F.col("p")[1].alias("y"))
    a, b = to_latlon("x", "y")
    ring = p.select("label", "i", a.alias("lat"), b.alias("lon")).groupBy("label").agg(F.array_sort(F.collect_list(F.struct("i", "lon", "lat"))).alias("r"))
    return ring.select(F.col("label").cast("int").alias("ward_id"), F.array(F.transform("r", lambda q: F.struct(q["lon"].alias("lon"), q["lat"].alias("lat")))).alias("rings"))


def footprint_rows(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """(members, inside): clustered points, and usable complaints without suspected pins, of any category, once for each
    cluster in whose outline they lie."""
    members = labels(spark, folder).where("label >= 0")
    rings = footprints(shapes.outlines(members, "label"))
    inside = regions.containing_regions(issues(spark, folder).where("usable and not pin"), rings, "lat", "lon", "held")
    return members, inside.withColumn("label", F.explode("held")).drop("held")


@query
def cluster_denominators(spark: SparkSession, folder: str) -> DataFrame:
    """All complaints inside each cluster's outline, the denominators of the clusters' shares; where outlines overlap, a
    complaint counts for each of them."""
    inside = footprint_rows(spark, folder)[1]
    return inside.groupBy("label").agg(F.count(F.lit(1)).alias("complaints"), F.count_if("is_target").alias("targets"))


@query
def footprint_density(spark: SparkSession, folder: str) -> DataFrame:
    """The later load taken as a second source: its records per km2 inside the clusters' outlines together, elsewhere in
    the wards, and the ratio of both. The outlines are dissolved."""
    d = issues(spark, folder)
    o = stage(shapes.outlines(labels(spark, folder).where("label >= 0"), "label"), "outlines")
    wards = table(spark, folder, "wards")
    second = regions.containing_region(d.where("run_id = 2").select("lat", "lon"), wards, "lat", "lon", "ward").where("ward >= 0")
    held = regions.containing_region(second, stage(footprints(o), "footprints"), "lat", "lon", "label")
    n = held.agg(F.count_if(F.expr("label >= 0")).alias("inside"), F.count_if(F.expr("label < 0")).alias("elsewhere"))
    return secondary.density(n, shapes.dissolved_area(o, "label"), shapes.polygon_areas(wards).agg(F.sum("area_km2").alias("city_km2")))


# ---- clustering


@query
def k_distance(spark: SparkSession, folder: str) -> DataFrame:
    return sweeps.k_distances(analysed(spark, folder), [5])


@query
def kdist_percentiles(spark: SparkSession, folder: str) -> DataFrame:
    d = sweeps.k_distances(analysed(spark, folder), sweeps.KNN_KS)
    return d.groupBy("k").agg(*[F.percentile("metres", F.lit(p)).alias(f"p{p * 100:g}") for p in sweeps.KDIST_LEVELS])


@query
def knee(spark: SparkSession, folder: str) -> DataFrame:
    return sweeps.knee(stage(sweeps.k_distances(analysed(spark, folder), [5]), "kdist"), "metres")


@query
def dbscan_labels(spark: SparkSession, folder: str) -> DataFrame:
    return labels(spark, folder).select("pid", "label")


@query
def sweep_metrics(spark: SparkSession, folder: str) -> DataFrame:
    m = sweeps.sweep_metrics(labels(spark, folder), ["eps", "least"])
    return m.withColumn("max_cluster_radius_m", F.rint(F.col("max_cluster_radius_m") * 10)).withColumn("warnings", sweeps.sanity_warnings())


@query
def sanity_warnings(spark: SparkSession, folder: str) -> DataFrame:
    """Which rules the stored runs' hotspots break, taken as one configuration each; noise is what of the run's analysed
    points the hotspots don't hold."""
    c = table(spark, folder, "cluster_summary")
    n = issues(spark, folder).where("usable and is_target and not pin").groupBy(F.col("run_id").alias("__run")).agg(F.count(F.lit(1)).alias("points"))
    m = c.groupBy("run_id").agg(F.count(F.lit(1)).alias("cluster_count"), F.sum("report_count").alias("held"), (F.max("report_count") / F.sum("report_count")).alias("largest_cluster_share"), F.max("approx_radius_meters").alias("max_cluster_radius_m"), F.avg(F.col("single_coordinate_cluster").cast("int")).alias("single_coordinate_cluster_share"))
    m = m.join(n, m["run_id"].eqNullSafe(n["__run"])).withColumn("noise_percentage", F.lit(100.0) * (F.col("points") - F.col("held")) / F.col("points"))
    return m.select("run_id", sweeps.sanity_warnings().alias("warnings"))


@query
def silhouette(spark: SparkSession, folder: str) -> DataFrame:
    return silhouettes(labels(spark, folder), []).select("n", F.rint(F.col("score") * 1e6).alias("score_e6"))


@query
def ari(spark: SparkSession, folder: str) -> DataFrame:
    """Agreement of the clusterings at 250 and 300 m."""
    m = sweeps.labelled(analysed(spark, folder), [250.0, 300.0], [5])
    a = m.where("eps = 250").select("pid", F.col("label").alias("la"))
    b = m.where("eps = 300").select("pid", F.col("label").alias("lb"))
    return sweeps.adjusted_rand(a.join(b, "pid").withColumn("least", F.lit(5)), ["least"], "la", "lb")


@query
def sweep(spark: SparkSession, folder: str) -> DataFrame:
    """The whole grid of 60 configurations with stability, silhouettes (in millionths) and warnings; radii in decimetres."""
    rows = sweeps.sweep(analysed(spark, folder))
    return rows.withColumns({"max_cluster_radius_m": F.rint(F.col("max_cluster_radius_m") * 10), "silhouette": F.rint(F.col("silhouette") * 1e6)})


@query
def baseline(spark: SparkSession, folder: str) -> DataFrame:
    """Random subsets of other usable complaints, as many as there are analysed points: 20 draws for each of 60 configurations."""
    pool = issues(spark, folder).where(F.col("usable") & ~F.col("is_target") & ~F.col("pin")).select(F.col("rowid_").cast("long").alias("pid"), "lat", "lon")
    return sweeps.baselines(pool, analysed(spark, folder).count(), sweeps.EPS_METRES, sweeps.MIN_SAMPLES)


@query
def sweep_select(spark: SparkSession, folder: str) -> DataFrame:
    """The rows of the whole grid with their ratio to the baselines of 20 draws, which fulfil the criteria, and which of
    those is selected; none is if none does."""
    pool = issues(spark, folder).where(F.col("usable") & ~F.col("is_target") & ~F.col("pin")).select(F.col("rowid_").cast("long").alias("pid"), "lat", "lon")
    rows = stage(sweeps.sweep(analysed(spark, folder), pool), "sweep")
    good = sweeps.passing(rows)
    marks = good.select("eps", "least", F.lit(True).alias("passing")).join(sweeps.best(good).select("eps", "least", F.lit(True).alias("selected")), ["eps", "least"], "left")
    return rows.join(F.broadcast(marks), ["eps", "least"], "left").fillna(False, ["passing", "selected"])  # at most a row per configuration


@query
def cluster_table(spark: SparkSession, folder: str) -> DataFrame:
    m = labels(spark, folder).where("label >= 0")
    d = m.join(issues(spark, folder).select("rowid_", "month"), F.col("pid") == F.col("rowid_"))
    at = d.groupBy("label", "lat", "lon").agg(F.count(F.lit(1)).alias("n"), F.min("month").alias("a"), F.max("month").alias("b"))
    return at.groupBy("label").agg(F.sum("n").alias("report_count"), F.count(F.lit(1)).alias("distinct_coordinates"), (F.max("n") >= F.sum("n") * 0.9).alias("single_coordinate"), F.min("a").alias("first_month"), F.max("b").alias("last_month"), F.min("lat").alias("bbox_min_lat"), F.min("lon").alias("bbox_min_lon"), F.max("lat").alias("bbox_max_lat"), F.max("lon").alias("bbox_max_lon"))


@query
def cluster_records(spark: SparkSession, folder: str) -> DataFrame:
    """Full records of the clusters, with area, density and outline."""
    dates = issues(spark, folder).select(F.col("rowid_").cast("long").alias("pid"), F.col("month").alias("date"))
    return sweeps.cluster_records(labels(spark, folder), dates, 250.0)


@query
def pin_sensitivity(spark: SparkSession, folder: str) -> DataFrame:
    """The same configuration with suspected pins, and the most targets at one of them; null if there are none."""
    m = labels(spark, folder, pins=True)
    pins = issues(spark, folder).where("usable and is_target and pin").groupBy("lat", "lon").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n").alias("largest_pin")).withColumn("k", F.lit(1))
    g = m.agg((F.max("label") + 1).alias("clusters"), F.count_if(F.col("label") < 0).alias("noise"), F.count(F.lit(1)).alias("points")).withColumn("k", F.lit(1))
    return g.join(pins, "k").drop("k")


@query
def size_summary(spark: SparkSession, folder: str) -> DataFrame:
    """The clusters' sizes and radii; radii in decimetres."""
    s = sweeps.cluster_sizes(labels(spark, folder), []).withColumn("r", F.rint(F.col("radius_m") * 10))
    return s.agg(
        F.min("reports").alias("least"), F.percentile("reports", F.lit(0.5)).alias("median"), F.count_if(F.expr("reports <= 7")).alias("small"), F.count_if(F.col("most") >= F.col("reports") * 0.9).alias("single_coordinate"),
        (F.max("reports") / F.sum("reports")).alias("largest_share"), F.min("r").alias("radius_min"), F.max("r").alias("radius_max"), F.percentile("r", F.lit(0.5)).alias("radius_median"),
    )


@query
def hotspot_rank(spark: SparkSession, folder: str) -> DataFrame:
    c = table(spark, folder, "cluster_summary")
    order = Window.partitionBy("run_id").orderBy(F.desc("report_count"), F.desc("density_reports_per_km2"), "cluster_id")
    return c.select("run_id", "cluster_id", F.row_number().over(order).alias("position"))


@query
def hdbscan(spark: SparkSession, folder: str) -> DataFrame:
    """The hierarchical comparison: clusters and noise of all analysed points, and its agreement with DBSCAN at 250 m."""
    points = stage(analysed(spark, folder), "points")
    h = sweeps.hdbscan(points, 5).select("pid", F.col("label").alias("lb"))
    both = stage(sweeps.labelled(points, [250.0], [5]).select("pid", "least", F.col("label").alias("la")).join(h, "pid"), "both")
    figures = both.groupBy("least").agg((F.max("lb") + 1).alias("clusters"), F.count_if(F.col("lb") < 0).alias("noise"), F.count(F.lit(1)).alias("points"))
    return figures.join(sweeps.adjusted_rand(both, ["least"], "la", "lb"), "least").drop("least")


# ---- distributions


@query
def category_distribution(spark: SparkSession, folder: str) -> DataFrame:
    return quality.distribution(issues(spark, folder), ["category", "sub_category", "is_target"])


@query
def top_categories(spark: SparkSession, folder: str) -> DataFrame:
    return quality.distribution(issues(spark, folder), ["category"]).orderBy(F.desc("complaints"), "category").limit(5)


@query
def status_counts(spark: SparkSession, folder: str) -> DataFrame:
    return issues(spark, folder).where("is_target").groupBy("status").agg(F.count(F.lit(1)).alias("complaints"))


@query
def coordinate_quality(spark: SparkSession, folder: str) -> DataFrame:
    return quality.coordinate_quality(issues(spark, folder))


@query
def dup_stats(spark: SparkSession, folder: str) -> DataFrame:
    return quality.duplicate_stats(issues(spark, folder))


@query
def dup_coordinates(spark: SparkSession, folder: str) -> DataFrame:
    return quality.duplicate_coordinates(issues(spark, folder))


@query
def multiplicity_hist(spark: SparkSession, folder: str) -> DataFrame:
    return quality.multiplicity_histogram(issues(spark, folder))


@query
def exact_dups(spark: SparkSession, folder: str) -> DataFrame:
    return quality.exact_copies(table(spark, folder, "lineitem")).union(quality.exact_copies(table(spark, folder, "spatial_unit_monthly")))


@query
def repeat_marks(spark: SparkSession, folder: str) -> DataFrame:
    """Which rows repeat a request, and which requests occur more than once."""
    d = cleaning.first_of_copies(issues(spark, folder), ["request_id"], ["run_id", "rowid_"])
    return d.select("rowid_", "is_repeat", "has_copy")


@query
def data_gate(spark: SparkSession, folder: str) -> DataFrame:
    return quality.data_gate(issues(spark, folder))


@query
def yearly_totals(spark: SparkSession, folder: str) -> DataFrame:
    return issues(spark, folder).where("month is not null").groupBy(F.substring("month", 1, 4).alias("year")).agg(F.count(F.lit(1)).alias("complaints"), F.count_if("is_target").alias("targets"))


@query
def distance_bands(spark: SparkSession, folder: str) -> DataFrame:
    """Noise share by distance from the centre in right-closed bands of 5, 10, 15 and 100 km; 0 and beyond drop out."""
    m = labels(spark, folder).withColumn("km", haversine(F.col("lat"), F.col("lon"), F.lit(CENTRE[0]), F.lit(CENTRE[1])) / 1000)
    band = F.when(F.col("km") <= 0, None).when(F.col("km") <= 5, "0-5").when(F.col("km") <= 10, "5-10").when(F.col("km") <= 15, "10-15").when(F.col("km") <= 100, "15-100")
    return m.withColumn("band", band).where("band is not null").groupBy("band").agg(F.count(F.lit(1)).alias("points"), F.count_if(F.expr("label < 0")).alias("noise"))


@query
def density_terciles(spark: SparkSession, folder: str) -> DataFrame:
    """Noise by thirds of the k-distance's rank; the cuts are where quantiles of the ranks fall."""
    d = stage(sweeps.k_distances(analysed(spark, folder), [5]), "kdist")
    r = with_rank(d, ["metres", "pid"], "r", "n")
    third = F.when(F.col("r") <= 1 + (F.col("n") - 1) / 3, 1).when(F.col("r") <= 1 + (F.col("n") - 1) * 2 / 3, 2).otherwise(3)
    m = r.withColumn("third", third).join(labels(spark, folder).select("pid", "label"), "pid")
    return m.groupBy("third").agg(F.count(F.lit(1)).alias("points"), F.count_if(F.expr("label < 0")).alias("noise"))


@query
def zone_rollup(spark: SparkSession, folder: str) -> DataFrame:
    m = labels(spark, folder).select("pid", "label")
    w = table(spark, folder, "wards").select("ward_id", "zone")
    d = issues(spark, folder).join(m, F.col("rowid_") == F.col("pid")).join(w, "ward_id")
    return d.groupBy("zone").agg(F.count(F.lit(1)).alias("points"), F.count_if(F.expr("label >= 0")).alias("clustered")).orderBy(F.desc("points"), "zone").limit(5)


@query
def summary(spark: SparkSession, folder: str) -> DataFrame:
    return surface.summary(issues(spark, folder), table(spark, folder, "cluster_summary"))


@query
def city_timeline(spark: SparkSession, folder: str) -> DataFrame:
    return ward_series(spark, folder).groupBy("month").agg(F.sum("target_reports").alias("target_reports"), F.sum("all_reports").alias("all_reports"))


# ---- statistics of series


def null_rate_of(spark: SparkSession, folder: str) -> DataFrame:
    """(rate): usable targets without suspected pins per km2 of all wards and month of the whole range."""
    d = issues(spark, folder)
    n = d.agg(F.count_if(F.col("is_target") & F.col("usable") & ~F.col("pin")).alias("n")).withColumn("k", F.lit(1))
    a = shapes.polygon_areas(table(spark, folder, "wards")).agg(F.sum("area_km2").alias("area")).withColumn("k", F.lit(1))
    m = series.month_spine(d, "month").agg(F.count(F.lit(1)).alias("months")).withColumn("k", F.lit(1))
    return n.join(a, "k").join(m, "k").select((F.col("n") / F.nullif(F.col("area") * F.col("months"), F.lit(0.0))).alias("rate"))


def rated_wards(spark: SparkSession, folder: str) -> DataFrame:
    """(unit, area_km2, rate): all wards with their area and the city's null rate, the same for each."""
    areas = shapes.polygon_areas(table(spark, folder, "wards")).select(F.col("ward_id").alias("unit"), "area_km2", F.lit(1).alias("k"))
    return areas.join(F.broadcast(null_rate_of(spark, folder).withColumn("k", F.lit(1))), "k").drop("k")


@query
def null_rate(spark: SparkSession, folder: str) -> DataFrame:
    return null_rate_of(spark, folder).select(F.rint(F.col("rate") * 1e9).alias("rate_e9"))


def thresholds(spark: SparkSession, folder: str) -> DataFrame:
    """(unit, active_threshold) of all wards, from the null rate and their area."""
    w = rated_wards(spark, folder)
    return w.select("unit", series.active_threshold(F.col("rate") * F.col("area_km2")).alias("active_threshold"))


@query
def poisson_threshold(spark: SparkSession, folder: str) -> DataFrame:
    return thresholds(spark, folder)


@query
def threshold_hist(spark: SparkSession, folder: str) -> DataFrame:
    return thresholds(spark, folder).groupBy("active_threshold").agg(F.count(F.lit(1)).alias("wards"))


@query
def binomial_threshold(spark: SparkSession, folder: str) -> DataFrame:
    """Months that each ward must be active by chance at most once in a hundred, of its own months and chance."""
    return unit_metrics(spark, folder).select(F.col("unit").alias("ward_id"), F.col("needed_months").alias("months"))


@query
def active_flag(spark: SparkSession, folder: str) -> DataFrame:
    t = thresholds(spark, folder).select("unit", "active_threshold")
    return ward_series(spark, folder).join(t, "unit").select("unit", "month", (F.col("target_reports") >= F.col("active_threshold")).cast("int").alias("active"))


@query
def unit_metrics(spark: SparkSession, folder: str) -> DataFrame:
    """Activity and persistence of wards under the city's null rate."""
    units = rated_wards(spark, folder)
    m = series.unit_metrics(ward_series(spark, folder), units, F.col("rate"))
    return m.select("unit", "active_threshold", "active_months", "months", "total_reports", "needed_months", "persistence", "persistent")


@query
def persistent_count(spark: SparkSession, folder: str) -> DataFrame:
    m = unit_metrics(spark, folder)
    return m.agg(F.when(F.count("persistent") > 0, F.count_if("persistent")).alias("persistent"))


@query
def early_share(spark: SparkSession, folder: str) -> DataFrame:
    """Share of the persistent wards' target reports that came before 2021."""
    keep = unit_metrics(spark, folder).where("persistent").select("unit")
    s = ward_series(spark, folder).join(keep, "unit", "left_semi")
    return s.agg((F.coalesce(F.sum(F.when(F.col("month") < "2021-01", F.col("target_reports"))), F.lit(0)) / F.greatest(F.coalesce(F.sum("target_reports"), F.lit(0)), F.lit(1))).alias("share"))


@query
def recent_activity(spark: SparkSession, folder: str) -> DataFrame:
    return series.recent_activity(ward_series(spark, folder), "unit", "target_reports")


@query
def unit_share(spark: SparkSession, folder: str) -> DataFrame:
    return ward_series(spark, folder).groupBy("unit").agg((F.sum("target_reports") / F.nullif(F.sum("all_reports"), F.lit(0))).alias("share"))


@query
def kendall_tau(spark: SparkSession, folder: str) -> DataFrame:
    return series.trend_stats(ward_series(spark, folder), "unit", "target_reports").select("unit", "valid", "tau", "s")


@query
def theil_sen(spark: SparkSession, folder: str) -> DataFrame:
    return series.trend_stats(ward_series(spark, folder), "unit", "target_reports").select("unit", "slope")


@query
def trend_labels(spark: SparkSession, folder: str) -> DataFrame:
    t = series.label_trends(series.trend_stats(ward_series(spark, folder), "unit", "target_reports"))
    return t.select("unit", "tau", (F.rint(F.col("p_value") * 1e6) / 1e6).alias("p_value"), (F.rint(F.col("q_value") * 1e6) / 1e6).alias("q_value"), "trend")


@query
def city_trend(spark: SparkSession, folder: str) -> DataFrame:
    """Trend of the city's target counts and of its share in thousandths."""
    c = city_timeline(spark, folder)
    share = F.rint(F.coalesce(F.col("target_reports") / F.nullif("all_reports", F.lit(0)), F.lit(0.0)) * 1000)
    both = c.select(F.lit("count").alias("unit"), "month", F.col("target_reports").cast("double").alias("v")).unionByName(c.select(F.lit("share").alias("unit"), "month", share.alias("v")))
    t = series.label_trends(series.trend_stats(both, "unit", "v"))
    return t.select("unit", "tau", "slope", (F.rint(F.col("p_value") * 1e6) / 1e6).alias("p_value"), "trend")


@query
def bh_adjust(spark: SparkSession, folder: str) -> DataFrame:
    """Adjusted values of the hotspots' shares, taken as p-values."""
    c = table(spark, folder, "cluster_summary").select("run_id", "cluster_id", F.col("complaint_share").alias("p"))
    return series.bh_adjust(c, "p", "q")


@query
def cluster_monthly(spark: SparkSession, folder: str) -> DataFrame:
    """Dense months of clusters: their members, all complaints inside their outline in the month, and the share."""
    members, inside = footprint_rows(spark, folder)
    d = issues(spark, folder)
    months, units = series.month_spine(d, "month"), stage(members.select(F.col("label").alias("unit")).distinct(), "units")
    own = d.join(members.select("pid", "label"), F.col("rowid_") == F.col("pid"))
    t = series.dense_unit_month(own, "label", months, units, F.col("is_target")).select("unit", "month", "target_reports")
    n = series.dense_unit_month(inside, "label", months, units, F.col("is_target")).select("unit", "month", "all_reports")
    return t.join(n, ["unit", "month"]).withColumn("share", F.col("target_reports") / F.nullif("all_reports", F.lit(0)))


# ---- read side


@query
def hotspots_query(spark: SparkSession, folder: str) -> DataFrame:
    h = surface.hotspots(table(spark, folder, "cluster_summary"), sort="recent_3_month_count", order="desc", min_reports=10, trend="Stable", limit=50)
    return h.select("run_id", "cluster_id", "recent_3_month_count", "report_count", "matched")


@query
def unit_timeline(spark: SparkSession, folder: str) -> DataFrame:
    return surface.timeline(table(spark, folder, "spatial_unit_monthly"), "ward", 68)


@query
def stored_city_timeline(spark: SparkSession, folder: str) -> DataFrame:
    return surface.timeline(table(spark, folder, "spatial_unit_monthly"), "city")


@query
def top15_share(spark: SparkSession, folder: str) -> DataFrame:
    """The 15 wards of the greatest target share among those with 50 complaints or more."""
    g = issues(spark, folder).where("ward_id >= 1").groupBy("ward_id").agg(F.count(F.lit(1)).alias("complaints"), F.count_if("is_target").alias("targets"))
    return g.where("complaints >= 50").withColumn("share", F.col("targets") / F.col("complaints")).orderBy(F.desc("share"), "ward_id").limit(15)


@query
def top15_count(spark: SparkSession, folder: str) -> DataFrame:
    g = issues(spark, folder).where("is_target and ward_id >= 1").groupBy("ward_id").agg(F.count(F.lit(1)).alias("targets"))
    return g.orderBy(F.desc("targets"), "ward_id").limit(15)


@query
def secondary_counts(spark: SparkSession, folder: str) -> DataFrame:
    """The later load taken as a second source: its complaints inside each ward beside the main load's targets."""
    d = issues(spark, folder)
    second = d.where("run_id = 2").select(F.col("lat").alias("latitude"), F.col("lon").alias("longitude"))
    return secondary.ward_counts(second, table(spark, folder, "wards"), d.where("run_id = 1"), None)


@query
def secondary_comparison(spark: SparkSession, folder: str) -> DataFrame:
    """The comparison of secondary_counts: records, ratio, rank correlation with its p-value, wards shared by both top 20."""
    c = secondary.comparison(stage(secondary_counts(spark, folder), "second"))
    return c.withColumns({"rho": F.rint(F.col("rho") * 1e9) / 1e9, "p_value": F.rint(F.col("p_value") * 1e6) / 1e6})


@query
def choropleth_breaks(spark: SparkSession, folder: str) -> DataFrame:
    return surface.breaks(table(spark, folder, "cluster_summary"), "density_reports_per_km2")


@query
def map_metric(spark: SparkSession, folder: str) -> DataFrame:
    return surface.map_metric(table(spark, folder, "cluster_summary"), "share").select("run_id", "cluster_id", "value")


@query
def ward_search(spark: SparkSession, folder: str) -> DataFrame:
    return surface.ward_search(table(spark, folder, "wards"), "NAGAR").select("ward_id", "name")


ORACLE = report_sql.ORACLE
