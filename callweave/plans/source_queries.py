"""Queries that run the engine over a program made from the driver's tables, each with SQL over the same tables.

Every region is an abstract class, every nation a class that extends its region's, every supplier a function that makes its
nation's class and calls it. The program is parsed, resolved and projected once for a session and folder; the SQL says what
declarations, calls, edges and nodes such a program has.
"""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from callweave.plans.driver_queries import query, table
from callweave.plans.engine import Analysis, Options, analyze_files
from callweave.sources import sinks
from callweave.sources.scan import sources_from_table
from callweave.sources.storage import fresh_path

REGION = """export abstract class R{r} {
  constructor(public name: string) {}
  abstract price(n: number): number;
  total(n: number): number { return this.price(n) + 1; }
}
"""
NATION = """import { R{r} } from "./r{r}";

export class N{n} extends R{r} {
  price(n: number): number { return n > {n} ? n : {n}; }
}
"""
SUPPLIER = """import { N{n} } from "./n{n}";
import * as zlib from "node:zlib";

/** Runs supplier {s}. */
export function run{s}(n: number): number {
  const one = new N{n}("s");
  if (n > 1 && n < 9) { zlib.crc32("x"); }
  return one.total(n) + one.price({s}){more};
}
"""


def filled(template: str, **columns: str) -> str:
    """A SQL expression, the same for both engines: the template with columns in its places."""
    text = f"'{template}'"
    for name, column in columns.items():
        text = f"replace({text}, '{{{name}}}', CAST({column} AS STRING))"
    return text


REGION_TEXT = filled(REGION, r="r_regionkey")
NATION_TEXT = filled(NATION, r="n_regionkey", n="n_nationkey")
MORE = "CASE WHEN s_suppkey % 3 = 0 THEN ' + one.price(1)' ELSE '' END"
SUPPLIER_TEXT = f"CASE WHEN s_suppkey % 4 = 0 THEN '// fourth' || chr(10) ELSE '' END || {filled(SUPPLIER, n='s_nationkey', s='s_suppkey', more=MORE)}"
#: The program as SQL, and names that the queries share.
PROGRAM = f"""files AS (
  SELECT 'r' || r_regionkey AS module, {REGION_TEXT} AS text, 0 AS comments FROM region
  UNION ALL SELECT 'n' || n_nationkey, {NATION_TEXT}, 0 FROM nation
  UNION ALL SELECT 's' || s_suppkey, {SUPPLIER_TEXT}, CASE WHEN s_suppkey % 4 = 0 THEN 2 ELSE 1 END FROM supplier),
r AS (SELECT 'r' || r_regionkey || '.R' || r_regionkey AS rsig, 'R' || r_regionkey AS rname, r_regionkey AS rk FROM region),
n AS (SELECT 'n' || n_nationkey || '.N' || n_nationkey AS nsig, 'N' || n_nationkey AS nname, n_nationkey AS nk, rsig, rname, rk FROM nation JOIN r ON n_regionkey = rk),
s AS (SELECT 's' || s_suppkey || '.run' || s_suppkey AS ssig, s_suppkey AS sk, CASE WHEN s_suppkey % 3 = 0 THEN 2 ELSE 1 END AS prices, CASE WHEN s_suppkey % 4 = 0 THEN 1 ELSE 0 END AS lines, nsig, nname, nk, rsig FROM supplier JOIN n ON s_nationkey = nk)"""
SITES = """sites AS (
  SELECT rsig || '.total' AS caller, 'price' AS method_name, rsig || '.price' AS callee, rname AS receiver_type, 'number' AS return_type, false AS is_external, 1 AS sites FROM r
  UNION ALL SELECT ssig, nname, nsig || '.constructor', NULL, nname, false, 1 FROM s
  UNION ALL SELECT ssig, 'crc32', 'node:zlib.crc32', NULL, NULL, true, 1 FROM s
  UNION ALL SELECT ssig, 'total', rsig || '.total', nname, 'number', false, 1 FROM s
  UNION ALL SELECT ssig, 'price', nsig || '.price', nname, 'number', false, prices FROM s)"""
EDGES = """calls AS (
  SELECT caller AS source, callee AS target, CAST(sites AS BIGINT) AS weight, false AS virtual, is_external FROM sites
  UNION ALL SELECT DISTINCT rsig || '.total', nsig || '.price', CAST(1 AS BIGINT), true, false FROM s)"""
LABELS = """labels AS (
  SELECT 'Application' AS label, 1 AS n UNION ALL SELECT 'Module', count(*) FROM files UNION ALL SELECT 'Class', (SELECT count(*) FROM r) + (SELECT count(*) FROM n)
  UNION ALL SELECT 'Callable', 3 * (SELECT count(*) FROM r) + 2 * (SELECT count(*) FROM n) + (SELECT count(*) FROM s)
  UNION ALL SELECT 'External', 1 UNION ALL SELECT 'Package', 1 UNION ALL SELECT 'CallSite', sum(sites) FROM sites
  UNION ALL SELECT 'Attribute', count(*) FROM r UNION ALL SELECT 'Variable', count(*) FROM s)"""
TYPES = """types AS (
  SELECT 'HAS_MODULE' AS type, count(*) AS n FROM files
  UNION ALL SELECT 'DECLARES', (SELECT count(*) FROM r) + (SELECT count(*) FROM n) + (SELECT count(*) FROM s)
  UNION ALL SELECT 'HAS_METHOD', 3 * (SELECT count(*) FROM r) + 2 * (SELECT count(*) FROM n)
  UNION ALL SELECT 'HAS_ATTRIBUTE', count(*) FROM r UNION ALL SELECT 'DECLARES_VAR', count(*) FROM s
  UNION ALL SELECT 'HAS_CALLSITE', sum(sites) FROM sites UNION ALL SELECT 'RESOLVES_TO', sum(sites) FROM sites
  UNION ALL SELECT 'CALLS', count(*) FROM calls UNION ALL SELECT 'EXTENDS', count(*) FROM n
  UNION ALL SELECT 'IMPORTS', (SELECT count(*) FROM n) + 2 * (SELECT count(*) FROM s) UNION ALL SELECT 'MEMBER_OF', 1)"""


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, text) of the program's files."""
    part = lambda name, key, text: table(spark, sf_dir, name).select(F.expr(f"'{name[0]}' || CAST({key} AS STRING) || '.ts'").alias("path"), F.expr(text).alias("text"))
    return part("region", "r_regionkey", REGION_TEXT).unionByName(part("nation", "n_nationkey", NATION_TEXT)).unionByName(part("supplier", "s_suppkey", SUPPLIER_TEXT))


@lru_cache(maxsize=4)
def analysis(spark: SparkSession, sf_dir: str) -> Analysis:
    files = sources_from_table(sources(spark, sf_dir), "path", "text")
    return analyze_files(spark, files, Options("suppliers", provider="tsc", emit="neo4j"))


@query(f"WITH {PROGRAM} SELECT module || '.ts' AS file_key, module AS module_name, sha256(text) AS content_hash, CAST(strlen(text) AS BIGINT) AS file_size, CAST(comments AS BIGINT) AS comments FROM files")
def ts_modules(spark, sf_dir):
    return analysis(spark, sf_dir).tables["module"].select("file_key", "module_name", "content_hash", "file_size", F.size("comments").cast("long").alias("comments"))


@query(f"""WITH {PROGRAM}
SELECT rsig AS signature, 'class' AS kind, rname AS name, '' AS bases, true AS is_abstract, true AS is_exported, CAST(1 AS BIGINT) AS start_line, CAST(5 AS BIGINT) AS end_line FROM r
UNION ALL SELECT nsig, 'class', nname, rname, false, true, 3, 5 FROM n""")
def ts_declarations(spark, sf_dir):
    rows = analysis(spark, sf_dir).tables["declaration"]
    return rows.select("signature", "kind", "name", F.array_join("base_classes", ",").alias("bases"), "is_abstract", "is_exported", F.col("start_line").cast("long").alias("start_line"), F.col("end_line").cast("long").alias("end_line"))


@query(f"""WITH {PROGRAM}, c AS (
SELECT rsig || '.constructor' AS signature, 'constructor' AS kind, 1 AS complexity, 1 AS parameters, NULL AS return_type, false AS is_abstract, 2 AS start_line FROM r
UNION ALL SELECT rsig || '.price', 'method', 0, 1, 'number', true, 3 FROM r UNION ALL SELECT rsig || '.total', 'method', 1, 1, 'number', false, 4 FROM r
UNION ALL SELECT nsig || '.price', 'method', 2, 1, 'number', false, 4 FROM n UNION ALL SELECT nsig || '.constructor', 'constructor', 0, 0, NULL, false, -1 FROM n
UNION ALL SELECT ssig, 'function', 3, 1, 'number', false, 5 + lines FROM s)
SELECT signature, kind, CAST(complexity AS BIGINT) AS complexity, CAST(parameters AS BIGINT) AS parameters, return_type, is_abstract, CAST(start_line AS BIGINT) AS start_line FROM c""")
def ts_callables(spark, sf_dir):
    rows = analysis(spark, sf_dir).tables["callable"]
    long = lambda column, name: column.cast("long").alias(name)
    return rows.select("signature", "kind", long(F.col("cyclomatic_complexity"), "complexity"), long(F.size("parameters"), "parameters"), "return_type", "is_abstract", long(F.col("start_line"), "start_line"))


@query(f"""WITH {PROGRAM}
SELECT 'n' || nk || '.ts' AS file_key, './r' || rk AS module, rname AS name, 'named' AS import_kind, 'r' || rk AS target FROM n
UNION ALL SELECT 's' || sk || '.ts', './n' || nk, nname, 'named', 'n' || nk FROM s
UNION ALL SELECT 's' || sk || '.ts', 'node:zlib', '*', 'namespace', NULL FROM s""")
def ts_imports(spark, sf_dir):
    return analysis(spark, sf_dir).tables["import"].select("file_key", "module", "name", "import_kind", "target")


@query(f"WITH {PROGRAM}, {SITES} SELECT caller, method_name, callee, receiver_type, return_type, is_external, CAST(sites AS BIGINT) AS sites FROM sites")
def ts_call_sites(spark, sf_dir):
    rows = analysis(spark, sf_dir).graph.resolved.call_sites.withColumnRenamed("callee_signature", "callee")
    return rows.groupBy("caller", "method_name", "callee", "receiver_type", "return_type", "is_external").agg(F.count("*").alias("sites"))


@query(f"WITH {PROGRAM}, {SITES}, {EDGES} SELECT source, target, sum(weight)::BIGINT AS weight, bool_or(virtual) AS virtual, bool_or(is_external) AS external FROM calls GROUP BY ALL")
def ts_call_graph(spark, sf_dir):
    tag = lambda k: F.coalesce(F.col("tags")[k], F.lit(""))
    return analysis(spark, sf_dir).graph.edges.select("source", "target", "weight", (tag("ts.dispatch") == "rta").alias("virtual"), (tag("ts.external") == "true").alias("external"))


@query(f"WITH {PROGRAM}, {SITES}, {EDGES} SELECT (SELECT sum(sites) FROM sites WHERE NOT is_external)::BIGINT AS resolved, (SELECT sum(sites) FROM sites WHERE is_external)::BIGINT AS phantom, 0::BIGINT AS unresolved, (SELECT count(*) FROM calls WHERE virtual) AS rta, count(*) AS unique_edges, sum(weight)::BIGINT AS weight FROM calls")
def ts_statistics(spark, sf_dir):
    return analysis(spark, sf_dir).graph.resolved.stats.select("resolved", "phantom", "unresolved", "rta", "unique_edges", "weight")


@query(f"WITH {PROGRAM}, {SITES}, {LABELS} SELECT label, n::BIGINT AS n FROM labels")
def ts_nodes(spark, sf_dir):
    return analysis(spark, sf_dir).nodes.groupBy(F.element_at("labels", -1).alias("label")).agg(F.count("*").alias("n"))


@query(f"WITH {PROGRAM}, {SITES}, {EDGES}, {TYPES} SELECT type, n::BIGINT AS n FROM types")
def ts_relationships(spark, sf_dir):
    return analysis(spark, sf_dir).edges.groupBy("type").agg(F.count("*").alias("n"))


@query(f"""WITH {PROGRAM}
SELECT 'Application' AS label, 'suppliers' AS key UNION ALL SELECT 'Module', module || '.ts' FROM files
UNION ALL SELECT 'Class', rsig FROM r UNION ALL SELECT 'Class', nsig FROM n
UNION ALL SELECT 'Callable', rsig || unnest(['.constructor', '.price', '.total']) FROM r
UNION ALL SELECT 'Callable', nsig || unnest(['.constructor', '.price']) FROM n UNION ALL SELECT 'Callable', ssig FROM s
UNION ALL SELECT 'External', 'node:zlib.crc32' UNION ALL SELECT 'Package', 'node:zlib'
UNION ALL SELECT 'Attribute', rsig || '#attr:name' FROM r UNION ALL SELECT 'Variable', ssig || '#var:one' FROM s""")
def ts_node_keys(spark, sf_dir):
    """Every node but call sites, by its key; of variables without their places."""
    nodes = analysis(spark, sf_dir).nodes.select(F.element_at("labels", -1).alias("label"), F.regexp_replace("value", "@.*$", "").alias("key"))
    return nodes.where("label <> 'CallSite'")


@query(f"""WITH {PROGRAM}, {SITES}, {EDGES}
SELECT 'HAS_MODULE' AS type, 'suppliers' AS from_key, module || '.ts' AS to_key FROM files
UNION ALL SELECT 'DECLARES', 'r' || rk || '.ts', rsig FROM r UNION ALL SELECT 'DECLARES', 'n' || nk || '.ts', nsig FROM n UNION ALL SELECT 'DECLARES', 's' || sk || '.ts', ssig FROM s
UNION ALL SELECT 'HAS_METHOD', rsig, rsig || unnest(['.constructor', '.price', '.total']) FROM r
UNION ALL SELECT 'HAS_METHOD', nsig, nsig || unnest(['.constructor', '.price']) FROM n
UNION ALL SELECT 'HAS_ATTRIBUTE', rsig, rsig || '#attr:name' FROM r UNION ALL SELECT 'DECLARES_VAR', ssig, ssig || '#var:one' FROM s
UNION ALL SELECT DISTINCT 'CALLS', source, target FROM calls UNION ALL SELECT 'EXTENDS', nsig, rsig FROM n
UNION ALL SELECT 'IMPORTS', 'n' || nk || '.ts', 'r' || rk || '.ts' FROM n
UNION ALL SELECT 'IMPORTS', 's' || sk || '.ts', unnest(['n' || nk || '.ts', 'node:zlib']) FROM s
UNION ALL SELECT 'MEMBER_OF', 'node:zlib.crc32', 'node:zlib'""")
def ts_edge_keys(spark, sf_dir):
    """Every relationship that does not end or start at a call site, by the keys of its ends."""
    edges = analysis(spark, sf_dir).edges.where("type not in ('HAS_CALLSITE', 'RESOLVES_TO')")
    bare = lambda c: F.regexp_replace(c, "@.*$", "").alias(c)
    return edges.select("type", bare("from_key"), bare("to_key"))


@query(f"""WITH {PROGRAM}, {SITES}, {EDGES}, {LABELS}, {TYPES}, shapes AS (
  SELECT label AS shape, n FROM labels
  UNION ALL SELECT type, n FROM types WHERE type NOT IN ('HAS_MODULE', 'DECLARES_VAR', 'IMPORTS')
  UNION ALL SELECT 'HAS_MODULE', count(*) FROM files UNION ALL SELECT 'DECLARES_VAR', count(*) FROM s
  UNION ALL SELECT 'IMPORTS', (SELECT count(*) FROM n) + (SELECT count(*) FROM s) UNION ALL SELECT 'IMPORTS', count(*) FROM s)
SELECT CASE WHEN shape = upper(shape) THEN 3 ELSE 2 END::BIGINT AS part, sum(ceil(n / 100.0))::BIGINT AS statements, sum(n)::BIGINT AS entries FROM shapes GROUP BY 1""")
def ts_statements(spark, sf_dir):
    """Statements of 100 rows for each shape of nodes and relationships, and the rows in them."""
    a = analysis(spark, sf_dir)
    rows = sinks.cypher_statements(a.nodes, a.edges, "suppliers", size=100).where("part > 1")
    entries = F.regexp_count("statement", F.lit(r"\{[ka]: ")).cast("long")
    return rows.groupBy(F.col("part").cast("long").alias("part")).agg(F.count("*").alias("statements"), F.sum(entries).alias("entries"))


@query(f"""WITH {PROGRAM}, m AS (SELECT CASE WHEN k % 10 = 1 THEN 'removed' WHEN k % 7 = 0 THEN 'changed' ELSE 'unchanged' END AS state FROM (SELECT sk AS k FROM s UNION ALL SELECT 0.5 FROM r UNION ALL SELECT 0.5 FROM n))
SELECT state, count(*) AS n, (SELECT count(*) FROM m WHERE state <> 'removed') AS kept FROM m GROUP BY 1""")
def ts_incremental(spark, sf_dir):
    """The states of modules in a second run, from which some suppliers are gone and others changed, and the modules after it."""
    a = analysis(spark, sf_dir)
    path = fresh_path(spark, "snapshot")
    sinks.apply_incremental(spark, path, a.nodes, a.edges)
    number = lambda c: F.regexp_extract(c, r"^s(\d+)\.ts$", 1).try_cast("int")
    gone = lambda c: F.coalesce(number(c) % 10 == 1, F.lit(False))
    changed = F.array_contains("labels", "Module") & F.coalesce(number(F.col("value")) % 7 == 0, F.lit(False))
    nodes = a.nodes.where(~gone(F.col("_module")) | F.col("_module").isNull()).withColumn("props", F.when(changed, F.regexp_replace("props", '"content_hash":"', '"content_hash":"0')).otherwise(F.col("props")))
    states = sinks.apply_incremental(spark, path, nodes, a.edges.where(~gone(F.col("owner_module")) | F.col("owner_module").isNull()))
    after = sinks.load_snapshot(spark, path)[0].where("labels[0] = 'Module'").agg(F.count("*").alias("kept"))
    return states.groupBy("state").agg(F.count("*").alias("n")).crossJoin(after)
