"""Queries that keep a snapshot of a graph made from the driver's tables, each with SQL that tells what a run must rewrite.

Every supplier is a module with one function, all of them belong to one application. In the second run some suppliers have
changed and others are gone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from callweave.plans.driver_queries import query, table
from callweave.sources import snapshot
from callweave.sources.storage import fresh_path

APP = "suppliers"
CHANGED, GONE = "s_suppkey % 50 = 1", "s_suppkey % 50 = 2"


def graph(suppliers: DataFrame, content: str) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of an application whose modules are ``suppliers`` with a content hash."""
    module, text = F.concat(F.lit("s"), F.col("s_suppkey").cast("string"), F.lit(".ts")), lambda c: F.lit(c).cast("string")
    rows = suppliers.select(module.alias("m"), F.expr(content).alias("hash"))
    own = lambda labels, key, value, props: rows.select(F.lit(APP).alias("app_name"), F.array(F.lit(labels)).alias("labels"), F.lit(key).alias("key_prop"), value.alias("value"), props.alias("props"), F.col("m").alias("_module"))
    nodes = own("Module", "file_key", F.col("m"), F.to_json(F.struct(F.col("hash").alias("content_hash")))).unionByName(own("Callable", "signature", F.concat("m", F.lit(".run")), F.lit("{}")))
    top = suppliers.sparkSession.range(1).select(F.lit(APP).alias("app_name"), F.array(F.lit("Application")).alias("labels"), F.lit("name").alias("key_prop"), F.lit(APP).alias("value"), F.lit("{}").alias("props"), text(None).alias("_module"))
    edge = lambda kind, a, a_key, b, b_key, owner: rows.select(F.lit(APP).alias("app_name"), F.lit(kind).alias("type"), F.lit(a).alias("from_label"), a_key.alias("from_key"), F.lit(b).alias("to_label"), b_key.alias("to_key"), F.lit("{}").alias("props"), owner.alias("owner_module"))
    edges = edge("HAS_MODULE", "Application", F.lit(APP), "Module", F.col("m"), text(None)).unionByName(edge("DECLARES", "Module", F.col("m"), "Callable", F.concat("m", F.lit(".run")), F.col("m")))
    return nodes.unionByName(top), edges


def bucket_sql(key: str) -> str:
    return f"('0x' || substr(md5('{APP}|' || {key}), 1, 8))::BIGINT % {snapshot.BUCKETS}"


@query(f"""
WITH s AS (SELECT 's' || s_suppkey || '.ts' AS m, {CHANGED} AS changed, {GONE} AS gone FROM supplier),
  b AS (SELECT *, {bucket_sql("m")} AS own, {bucket_sql(f"'{APP}>' || m")} AS linked FROM s)
SELECT 'nodes' AS kind, false AS shared, count(DISTINCT own) AS buckets, count(DISTINCT own) FILTER (own IN (SELECT own FROM b WHERE changed OR gone)) AS rewritten FROM b WHERE NOT gone
UNION ALL SELECT 'edges', false, count(DISTINCT own), count(DISTINCT own) FILTER (own IN (SELECT own FROM b WHERE changed OR gone)) FROM b WHERE NOT gone
UNION ALL SELECT 'edges', true, count(DISTINCT linked), count(DISTINCT linked) FILTER (linked IN (SELECT linked FROM b WHERE gone)) FROM b WHERE NOT gone
UNION ALL SELECT 'nodes', true, 1, 0
""")
def snapshot_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many buckets a version has, and how many of them its run wrote: those of changed and vanished modules."""
    path, suppliers = fresh_path(spark, "snapshot"), table(spark, sf_dir, "supplier")
    snapshot.apply_incremental(spark, path, *graph(suppliers, "md5(s_name)"))
    snapshot.apply_incremental(spark, path, *graph(suppliers.where(f"NOT ({GONE})"), f"CASE WHEN {CHANGED} THEN 'new' ELSE md5(s_name) END"))
    shared = (F.col("bucket") >= snapshot.BUCKETS).alias("shared")
    return snapshot.rewritten(spark, path).groupBy("kind", shared).agg(F.count("*").alias("buckets"), F.count_if("is_new").alias("rewritten"))


@query(f"""
WITH s AS (SELECT 's' || s_suppkey || '.ts' AS m, CASE WHEN {CHANGED} THEN 'new' ELSE md5(s_name) END AS hash FROM supplier WHERE NOT ({GONE}))
SELECT 'Application' AS kind, '{APP}' AS key, NULL AS hash UNION ALL SELECT 'Module', m, hash FROM s UNION ALL SELECT 'Callable', m || '.run', NULL FROM s
UNION ALL SELECT 'HAS_MODULE', '{APP}>' || m, NULL FROM s UNION ALL SELECT 'DECLARES', m || '>' || m || '.run', NULL FROM s
""")
def snapshot_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every node and edge, by its key, after two runs."""
    path, suppliers = fresh_path(spark, "snapshot"), table(spark, sf_dir, "supplier")
    snapshot.apply_incremental(spark, path, *graph(suppliers, "md5(s_name)"))
    snapshot.apply_incremental(spark, path, *graph(suppliers.where(f"NOT ({GONE})"), f"CASE WHEN {CHANGED} THEN 'new' ELSE md5(s_name) END"))
    nodes, edges = snapshot.load_snapshot(spark, path)
    nodes = nodes.select(F.element_at("labels", -1).alias("kind"), F.col("value").alias("key"), F.get_json_object("props", "$.content_hash").alias("hash"))
    return nodes.unionByName(edges.select(F.col("type").alias("kind"), F.concat_ws(">", "from_key", "to_key").alias("key"), F.lit(None).cast("string").alias("hash")))
