"""Queries of the problems for training data: p4 similarity clusters, p6 encoding, p7 leaked test items, p8 shared spans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hotloom.llm import automata, clusters, leakage, spans, tokens
from hotloom.sources.tables import table


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    rows = clusters.dense_groups(table(spark, folder, "complaints")).rows
    return rows.select(F.col("cluster_rowid").cast("long").alias("cluster_rowid"), F.col("rowid_").cast("long").alias("rowid_"))


def p4_groups(spark: SparkSession, folder: str) -> DataFrame:
    """Each group's size, number of pivot clusters and most typical complaints."""
    return clusters.describe(clusters.dense_groups(table(spark, folder, "complaints")))


def p6_ids(spark: SparkSession, folder: str) -> DataFrame:
    return tokens.encode(table(spark, folder, "documents"), "doc_id", "text")


def p6_roundtrip(spark: SparkSession, folder: str) -> DataFrame:
    """The texts, encoded and decoded again."""
    return tokens.decode(p6_ids(spark, folder), "doc_id", "ids")


def _leaks(spark: SparkSession, folder: str) -> DataFrame:
    return leakage.leaked_spans(table(spark, folder, "documents"), "doc_id", "text", table(spark, folder, "eval_items"), "item_id", "text")


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    return _leaks(spark, folder).select("item_id", "doc_id").distinct()


def p7_spans(spark: SparkSession, folder: str) -> DataFrame:
    """Where each leaked run of words lies in the original text."""
    return _leaks(spark, folder)


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    return spans.sharing_pairs(table(spark, folder, "documents"), "doc_id", "text")


def p8_coverage(spark: SparkSession, folder: str) -> DataFrame:
    """How much of each text lies in spans that other texts hold too; 0 for texts that share nothing."""
    return spans.coverage(table(spark, folder, "documents"), "doc_id", "text", every=True)


#: Characters that a document and a test item must share; the items are shorter than p8_found's 300.
ITEM_SPAN = 60


def p8_reference(spark: SparkSession, folder: str) -> DataFrame:
    """The maximal spans of at least ITEM_SPAN characters of every document that some test item holds verbatim: all
    documents streamed through the suffix automaton of the items."""
    items = table(spark, folder, "eval_items").select(F.col("item_id").alias("doc_id"), "text")
    return automata.reference_spans(table(spark, folder, "documents"), items, "doc_id", "text", ITEM_SPAN, same_ids=False)


QUERIES = {f.__name__: f for f in (p4_found, p4_groups, p6_ids, p6_roundtrip, p7_found, p7_spans, p8_found, p8_coverage, p8_reference)}
_R = "6371008.8"
_METRES = f"2*{_R}*asin(sqrt(least(1.0, pow(sin((radians(q.lat)-radians(p.lat))/2),2) + cos(radians(p.lat))*cos(radians(q.lat))*pow(sin((radians(q.lon)-radians(p.lon))/2),2))))"
ORACLE = {
    "p4_found": f"""
with recursive n as (select run_id, latitude, longitude, count(*) n from complaints where latitude is not null and longitude is not null group by all),
p as (select rowid_, run_id, latitude lat, longitude lon, floor(latitude/0.0025)::bigint g from complaints join n using (run_id, latitude, longitude)
  where is_pothole=1 and latitude between 12.5 and 13.5 and longitude between 77.0 and 78.2 and n<8),
q as (select *, unnest([g-1,g,g+1]) h from p),
near as (select p.rowid_ a, q.rowid_ b from p join q on p.run_id=q.run_id and p.g=q.h where abs(p.lon-q.lon)<0.003 and {_METRES} <= 250),
dense as (select a from near group by a having count(*)>=5),
link as (select a, b from near where a in (select a from dense) and b in (select a from dense)),
walk as (select a, a root from dense union select l.a, w.root from walk w join link l on l.b=w.a where w.root<l.a)
select min(root)::bigint cluster_rowid, a::bigint rowid_ from walk group by a""",
    "p6_roundtrip": "select doc_id, coalesce(text, '') as text from documents",
    "p7_found": """
with w as (select item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z0-9]+') w from eval_items),
p as (select item_id, unnest(list_transform(range(1, len(w) - 10), lambda i: array_to_string(w[i:i+11], ' '))) g from w where len(w) >= 12),
d as (select doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z0-9]+') w from documents where text is not null),
q as (select doc_id, unnest(list_transform(range(1, len(w) - 10), lambda i: array_to_string(w[i:i+11], ' '))) g from d where len(w) >= 12)
select distinct item_id, doc_id from p join q using (g)""",
    "p8_reference": f"""
with e as (select text t from eval_items where length(text) >= {ITEM_SPAN}),
g as (select distinct substr(t, i, {ITEM_SPAN}) g from (select t, unnest(range(1, length(t) - {ITEM_SPAN - 2})) i from e)),
d as (select doc_id, text, unnest(range(1, length(text) - {ITEM_SPAN - 2})) i from documents where length(text) >= {ITEM_SPAN}),
h as (select doc_id, text, i from d where substr(text, i, {ITEM_SPAN}) in (select g from g)),
x as (select doc_id, i, max(n) n from (select doc_id, i, text, unnest(range({ITEM_SPAN}, 1 + least(length(text) - i + 1, (select max(length(t)) from e)))) n from h) s
  where exists (select 1 from e where contains(t, substr(s.text, i, n))) group by all)
select doc_id, (i - 1)::bigint as start, (i - 1 + n)::bigint as stop from x where not exists (select 1 from x y where y.doc_id = x.doc_id and y.i = x.i - 1 and y.i + y.n >= x.i + x.n)""",
    "p8_found": """
with d as (select doc_id, text from documents where length(text) >= 300),
g as (select distinct doc_id, hash(substr(text, i, 300)) h from (select doc_id, text, unnest(range(1, length(text) - 298)) i from d)),
m as (select h, list(doc_id) l from g group by h having count(*) > 1)
select distinct x doc_id_a, y doc_id_b from (select l, unnest(l) x from m) s, unnest(s.l) t(y) where x < y""",
}
