"""Queries over the driver's tables, each with the SQL that must give the same rows.

Pages stand in for modules, their links for imports, line items for calls. Every query reads its whole tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from callweave.functions import text as x
from callweave.operators import closure, edges, incremental, rows

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str):
    """Registers a query under its function's name, with its SQL."""

    def register(f):
        QUERIES[f.__name__] = f
        ORACLE_SQL[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


HREF = 'href="([^"]*)"'


def specifiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each page refers to: its links and its own address."""
    pages = table(spark, sf_dir, "pages")
    links = F.concat(F.regexp_extract_all("html", F.lit(HREF), F.lit(1)), F.array("url"))
    return pages.select("page_id", F.explode(links).alias("specifier"))


@query("""
WITH s AS (SELECT page_id, unnest(list_append(regexp_extract_all(html, 'href="([^"]*)"', 1), url)) AS specifier FROM pages)
SELECT page_id AS source, specifier AS target, count(*) AS weight, specifier <> '' AND NOT regexp_matches(specifier, '^[./]') AS external FROM s GROUP BY ALL
""")
def link_graph(spark, sf_dir):
    found = specifiers(spark, sf_dir).select(F.col("page_id").alias("source"), F.col("specifier").alias("target"))
    return edges.edge_rollup(found, ["source", "target"]).withColumn("external", x.is_external(F.col("target")))


@query("""SELECT page_id, link, count(*) AS n FROM (SELECT page_id, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS link FROM pages) GROUP BY ALL""")
def link_extract(spark, sf_dir):
    links = table(spark, sf_dir, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit(HREF), F.lit(1))).alias("link"))
    return links.groupBy("page_id", "link").agg(F.count("*").alias("n"))


@query("""
WITH s AS (SELECT page_id, unnest(list_append(regexp_extract_all(html, 'href="([^"]*)"', 1), url)) AS specifier FROM pages)
SELECT CASE WHEN specifier <> '' AND NOT regexp_matches(specifier, '^[./]') THEN 'external' ELSE 'internal' END AS class, count(*) AS n, count(DISTINCT specifier) AS n_distinct FROM s GROUP BY 1
""")
def link_classify(spark, sf_dir):
    kind = F.when(x.is_external(F.col("specifier")), "external").otherwise("internal").alias("class")
    return specifiers(spark, sf_dir).groupBy(kind).agg(F.count("*").alias("n"), F.countDistinct("specifier").alias("n_distinct"))


@query("SELECT l_orderkey AS source, l_suppkey AS target, count(*) AS weight, bool_or(l_returnflag = 'R') AS returned FROM lineitem GROUP BY ALL")
def edge_rollup(spark, sf_dir):
    calls = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("source"), F.col("l_suppkey").alias("target"), "l_returnflag")
    return edges.edge_rollup(calls, ["source", "target"], F.bool_or(F.col("l_returnflag") == "R").alias("returned"))


def provider(spark, sf_dir, flag: str) -> DataFrame:
    """The edges of one return flag as those of one provider."""
    calls = table(spark, sf_dir, "lineitem").where(F.col("l_returnflag") == flag).select(F.col("l_orderkey").alias("source"), F.col("l_suppkey").alias("target"), F.lit(0).alias("ordinal"), F.create_map(F.lit("flag"), F.lit(flag)).alias("tags"))
    return edges.call_edges(calls, flag)


@query("""
WITH b AS (SELECT l_orderkey AS source, l_suppkey AS target, count(*) AS w FROM lineitem WHERE l_returnflag = 'A' GROUP BY ALL),
     o AS (SELECT l_orderkey AS source, l_suppkey AS target, count(*) AS w FROM lineitem WHERE l_returnflag = 'R' GROUP BY ALL)
SELECT source, target, coalesce(b.w, 0) + coalesce(o.w, 0) AS weight, concat_ws(',', CASE WHEN b.w IS NOT NULL THEN 'A' END, CASE WHEN o.w IS NOT NULL THEN 'R' END) AS provenance,
       CASE WHEN b.w IS NOT NULL THEN 'A' ELSE 'R' END AS flag
FROM b FULL OUTER JOIN o USING (source, target)
""")
def edge_merge(spark, sf_dir):
    merged = edges.merge_edges(provider(spark, sf_dir, "A"), provider(spark, sf_dir, "R"))
    return merged.select("source", "target", "weight", F.array_join("provenance", ",").alias("provenance"), F.col("tags")["flag"].alias("flag"))


@query("""
WITH b AS (SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem WHERE l_returnflag = 'A'), o AS (SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem WHERE l_returnflag = 'R')
SELECT (SELECT count(*) FROM b SEMI JOIN o USING (l_orderkey, l_suppkey)) AS shared, (SELECT count(*) FROM b ANTI JOIN o USING (l_orderkey, l_suppkey)) AS only_left, (SELECT count(*) FROM o ANTI JOIN b USING (l_orderkey, l_suppkey)) AS only_right
""")
def edge_diff(spark, sf_dir):
    items = table(spark, sf_dir, "lineitem")
    return edges.edge_diff(items.where("l_returnflag = 'A'"), items.where("l_returnflag = 'R'"), ["l_orderkey", "l_suppkey"])


@query("""
SELECT c_nationkey AS nation, c_name AS name, 'customer' AS origin FROM customer WHERE c_acctbal > 9900
UNION ALL SELECT s_nationkey, s_name, 'supplier' FROM supplier ANTI JOIN (SELECT DISTINCT c_nationkey FROM customer WHERE c_acctbal > 9900) ON s_nationkey = c_nationkey
""")
def base_wins(spark, sf_dir):
    base = table(spark, sf_dir, "customer").where("c_acctbal > 9900").select(F.col("c_nationkey").alias("nation"), F.col("c_name").alias("name"), F.lit("customer").alias("origin"))
    overlay = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("nation"), F.col("s_name").alias("name"), F.lit("supplier").alias("origin"))
    return edges.base_wins_union(base, overlay, ["nation"])


@query("""
SELECT c_nationkey AS nation, c_mktsegment AS segment, c_name AS name, 'customer' AS origin FROM customer
UNION ALL SELECT s_nationkey, 'MACHINERY', s_name, 'supplier' FROM supplier WHERE NOT EXISTS (SELECT 1 FROM customer WHERE s_nationkey = c_nationkey AND c_mktsegment = 'MACHINERY' )
UNION ALL SELECT s_nationkey, 'none', s_name, 'supplier' FROM supplier
""")
def base_wins_all(spark, sf_dir):
    """All customers, and the suppliers' entries where no customer of the nation has the segment."""
    base = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("nation"), F.col("c_mktsegment").alias("segment"), F.col("c_name").alias("name"), F.lit("customer").alias("origin"))
    overlay = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("nation"), F.explode(F.array(F.lit("MACHINERY"), F.lit("none"))).alias("segment"), F.col("s_name").alias("name"), F.lit("supplier").alias("origin"))
    return edges.base_wins_union(base, overlay, ["nation", "segment"])


@query("SELECT l_orderkey, count(*) AS n FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F') GROUP BY 1")
def signature_gate(spark, sf_dir):
    known = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("l_orderkey"))
    return edges.gate(table(spark, sf_dir, "lineitem").select("l_orderkey"), known, ["l_orderkey"]).groupBy("l_orderkey").agg(F.count("*").alias("n"))


@query("""
SELECT o_orderkey, coalesce(c_name, 'external.' || o_orderpriority) AS target, c_name IS NULL AS external
FROM orders LEFT JOIN (SELECT c_custkey, c_name FROM customer WHERE c_mktsegment = 'BUILDING') ON o_custkey = c_custkey
""")
def phantom_fallback(spark, sf_dir):
    inside = table(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"), "c_name")
    found = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority").join(inside, "o_custkey", "left")
    return found.select("o_orderkey", F.coalesce("c_name", x.dotted(F.lit("external"), F.col("o_orderpriority"))).alias("target"), F.col("c_name").isNull().alias("external"))


@query("SELECT o_orderkey, o_orderstatus FROM orders ANTI JOIN lineitem ON o_orderkey = l_orderkey")
def anti_prune(spark, sf_dir):
    return incremental.prune(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus"), table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey")), ["o_orderkey"])


def tree(spark, sf_dir) -> DataFrame:
    """Regions hold nations, nations hold customers."""
    nation, customer = table(spark, sf_dir, "nation"), table(spark, sf_dir, "customer")
    name = lambda kind, c: F.concat(F.lit(kind), F.col(c).cast("string"))
    return nation.select(name("r", "n_regionkey").alias("parent"), name("n", "n_nationkey").alias("child")).unionByName(customer.select(name("n", "c_nationkey").alias("parent"), name("c", "c_custkey").alias("child")))


TREE_SQL = "e AS (SELECT 'r' || n_regionkey AS parent, 'n' || n_nationkey AS child FROM nation UNION ALL SELECT 'n' || c_nationkey, 'c' || c_custkey FROM customer)"


@query(f"""
WITH RECURSIVE {TREE_SQL}, t AS (SELECT 'r' || r_regionkey AS seed, 'r' || r_regionkey AS node, 0 AS depth FROM region UNION ALL SELECT seed, child, depth + 1 FROM t JOIN e ON node = parent)
SELECT seed, node, depth FROM t WHERE depth > 0
""")
def containment_closure(spark, sf_dir):
    seeds = table(spark, sf_dir, "region").select(F.concat(F.lit("r"), F.col("r_regionkey").cast("string")).alias("seed"))
    return closure.fixpoint_closure(tree(spark, sf_dir), seeds)


@query("""
WITH p AS (SELECT DISTINCT p_type, p_brand, p_partkey FROM part), used AS (SELECT DISTINCT l_partkey FROM lineitem WHERE l_quantity >= 49)
SELECT 't:' || p_type AS owner, count(*) AS n_targets, min('p:' || p_partkey) AS first_target FROM p SEMI JOIN used ON p_partkey = l_partkey WHERE p_partkey % 5 <> 0 GROUP BY 1
""")
def rta_expand(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    kind, brand, leaf = F.concat(F.lit("t:"), "p_type"), F.concat(F.lit("b:"), "p_type", F.lit("/"), "p_brand"), F.concat(F.lit("p:"), F.col("p_partkey").cast("string"))
    parents = part.select(brand.alias("child"), kind.alias("parent")).union(part.select(leaf.alias("child"), brand.alias("parent"))).distinct()
    methods = part.select(leaf.alias("owner"), F.lit("run").alias("member"))
    used = table(spark, sf_dir, "lineitem").where("l_quantity >= 49").select(F.concat(F.lit("p:"), F.col("l_partkey").cast("string")).alias("type"))
    abstract = part.where("p_partkey % 5 = 0").select(leaf.alias("type"))
    calls = part.select(kind.alias("owner")).distinct().select(F.col("owner").alias("call"), "owner", F.lit("run").alias("member"))
    found = closure.rta_expand(calls, parents, methods, used, abstract)
    return found.groupBy(F.col("call").alias("owner")).agg(F.count("*").alias("n_targets"), F.regexp_replace(F.min("target"), r"\.run$", "").alias("first_target"))


@query("""
SELECT event_id, start_id FROM (
  SELECT a.event_id, b.event_id AS start_id, row_number() OVER (PARTITION BY a.event_id ORDER BY b.ts DESC, b.event_id DESC) AS k
  FROM events a JOIN events b ON a.user_id = b.user_id AND b.event_type = 'signup' AND (b.ts < a.ts) WHERE a.event_type = 'purchase') WHERE k = 1
""")
def enclosing_top1(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    points = events.where("event_type = 'purchase'").select("event_id", "user_id", "ts")
    starts = events.where("event_type = 'signup'").select("user_id", F.col("event_id").alias("start_id"), F.col("ts").alias("start"))
    return rows.latest(points, starts, ["user_id"], "ts", "start", ["start_id"]).select("event_id", "start_id")


@query("""
SELECT o_orderkey, c_custkey FROM (
  SELECT o_orderkey, c_custkey, row_number() OVER (PARTITION BY o_orderkey ORDER BY c_custkey DESC) AS k
  FROM orders JOIN customer ON o_custkey * 3 >= c_custkey * 3 AND o_custkey * 3 < c_custkey * 3 + 1 + (c_custkey * 7919) % 97) WHERE k = 1
""")
def enclosing_ranges(spark, sf_dir):
    """The range that starts last around each point, ranges of one file that nest and cross."""
    file = F.lit("bundle").alias("path")
    points = table(spark, sf_dir, "orders").select(file, "o_orderkey", (F.col("o_custkey") * 3).alias("at"))
    start = F.col("c_custkey") * 3
    ranges = table(spark, sf_dir, "customer").select(file, "c_custkey", start.alias("start"), (start + 1 + F.col("c_custkey") * 7919 % 97).alias("end"))
    return rows.innermost(points, ranges, ["path"], ["o_orderkey"], "at", "start", "end").select("o_orderkey", "c_custkey")


@query("""
SELECT a.s_suppkey AS node, b.s_suppkey AS ancestor, (a.s_suppkey - b.s_suppkey)::INTEGER AS depth
FROM supplier a JOIN supplier b ON a.s_suppkey > b.s_suppkey AND a.s_suppkey // 128 = b.s_suppkey // 128
""")
def containment_chain(spark, sf_dir):
    """Everything around each node, where each holds the next, in chains of 128."""
    key = F.col("s_suppkey")
    return closure.ancestors(table(spark, sf_dir, "supplier").where(key % 128 != 0).select((key - 1).alias("parent"), key.alias("child")).join(table(spark, sf_dir, "supplier").select((key).alias("parent")), "parent"))


@query("SELECT doc_id, sha256(text) AS content_hash FROM documents")
def content_hash(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("content_hash"))


@query("""
WITH n AS (SELECT o_orderkey AS k, o_orderstatus AS h FROM orders WHERE o_orderkey % 10 <> 1), o AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 7 = 0 THEN 'X' ELSE o_orderstatus END AS h FROM orders WHERE o_orderkey % 10 <> 2)
SELECT CASE WHEN o.k IS NULL THEN 'added' WHEN n.k IS NULL THEN 'removed' WHEN n.h = o.h THEN 'unchanged' ELSE 'changed' END AS state, count(*) AS n FROM n FULL OUTER JOIN o ON n.k = o.k GROUP BY 1
""")
def module_diff(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_orderstatus").alias("h"))
    new = orders.where("k % 10 <> 1")  # two snapshots, made from the one table
    old = orders.where("k % 10 <> 2").withColumn("h", F.when(F.col("k") % 7 == 0, "X").otherwise(F.col("h")))
    return incremental.module_diff(new, old, ["k"], "h", "h").groupBy("state").agg(F.count("*").alias("n"))


@query("""
WITH d AS (SELECT c_custkey, 'moved' AS c_mktsegment, CASE WHEN c_custkey % 6 = 0 THEN 'renamed' END AS c_name FROM customer WHERE c_custkey % 3 = 0 UNION ALL SELECT c_custkey + 10000000, 'new', 'new' FROM customer WHERE c_custkey % 50 = 0)
SELECT coalesce(c.c_custkey, d.c_custkey) AS c_custkey, coalesce(d.c_name, c.c_name) AS c_name, coalesce(d.c_mktsegment, c.c_mktsegment) AS c_mktsegment, c.c_nationkey FROM customer c FULL OUTER JOIN d ON c.c_custkey = d.c_custkey
""")
def upsert(spark, sf_dir):
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment", "c_nationkey")
    renamed = F.when(F.col("c_custkey") % 6 == 0, "renamed")
    delta = customer.where("c_custkey % 3 = 0").select("c_custkey", F.lit("moved").alias("c_mktsegment"), renamed.alias("c_name"))
    added = customer.where("c_custkey % 50 = 0").select((F.col("c_custkey") + 10_000_000).alias("c_custkey"), F.lit("new").alias("c_mktsegment"), F.lit("new").alias("c_name"))
    return incremental.upsert(customer, delta.unionByName(added), ["c_custkey"])


@query("SELECT user_id, event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS k FROM events) WHERE k = 1")
def first_wins(spark, sf_dir):
    return rows.first_wins(table(spark, sf_dir, "events"), ["user_id", "event_type"], [F.col("ts"), F.col("event_id")]).select("user_id", "event_type", "event_id")


@query("SELECT conv_id, turn, role, md5(text) AS hash FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, role DESC, text DESC) AS k FROM conversations) WHERE k = 1")
def last_wins(spark, sf_dir):
    last = rows.last_wins(table(spark, sf_dir, "conversations"), ["conv_id"], [F.col("turn"), F.col("role"), F.col("text")])
    return last.select("conv_id", "turn", "role", F.md5("text").alias("hash"))


@query(r"""
SELECT page_id, url FROM pages WHERE NOT list_has_any(list_slice(string_split(url, '/'), 1, len(string_split(url, '/')) - 1), ['en', 'node_modules', 'dist', 'build', 'out', 'coverage', 'vendor'])
""")
def path_filter(spark, sf_dir):
    skipped = F.array(*[F.lit(d) for d in ("en", "node_modules", "dist", "build", "out", "coverage", "vendor")])
    return table(spark, sf_dir, "pages").select("page_id", "url").where(~F.arrays_overlap(x.directories(F.col("url")), skipped))


@query(r"""
SELECT page_id, regexp_replace(regexp_replace(url, '\.d\.ts$', ''), '\.(ts|tsx|mts|cts|js|jsx|mjs|cjs)$', '') AS stripped, split_part(url, '/', -1) AS base, regexp_extract(url, '^(.*)\.[^.]*$', 1) AS owner, split_part(url, '.', -1) AS member FROM pages
""")
def strip_and_split(spark, sf_dir):
    url = F.col("url")
    return table(spark, sf_dir, "pages").select("page_id", x.strip_extension(url).alias("stripped"), x.basename(url).alias("base"), x.owner_of(url).alias("owner"), x.member_of(url).alias("member"))


@query("SELECT doc_id, md5(substring(text, 1, 400)) AS clamped, length(substring(text, 1, 20000)) AS n FROM documents")
def clamp_code(spark, sf_dir):
    text = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(x.clamp(text, x.TYPE_LENGTH)).alias("clamped"), F.length(x.clamp(text, x.CODE_LENGTH)).cast("bigint").alias("n"))


@query("SELECT doc_id, length(text) - length(replace(text, chr(10), '')) + 1 AS lines FROM documents")
def line_count(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", x.line_count(F.col("text")).cast("bigint").alias("lines"))


@query("SELECT doc_id, len(regexp_extract_all(text, '[,.;]')) + 1 AS complexity FROM documents")
def decision_count(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", (F.regexp_count("text", F.lit("[,.;]")) + 1).cast("bigint").alias("complexity"))


@query("SELECT page_id, trim(unnest(regexp_extract_all(html, '<!--([^>]*)-->', 1))) AS comment FROM pages")
def comment_extract(spark, sf_dir):
    found = F.transform(F.regexp_extract_all("html", F.lit("<!--([^>]*)-->"), F.lit(1)), lambda c: F.trim(c))
    return table(spark, sf_dir, "pages").select("page_id", F.explode(found).alias("comment"))


@query("SELECT event_type, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, count(*) AS n FROM events GROUP BY ALL")
def json_props(spark, sf_dir):
    k = F.get_json_object("props", "$.k").cast("bigint").alias("k")
    return table(spark, sf_dir, "events").groupBy("event_type", k).agg(F.count("*").alias("n"))


@query("SELECT o_orderpriority, CAST(floor((k - 1) / 500) AS BIGINT) AS batch, count(*) AS n, min(o_orderkey) AS first_key FROM (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) AS k FROM orders) GROUP BY ALL")
def batch_groups(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderpriority", "o_orderkey")
    return rows.batches(orders, ["o_orderpriority"], [F.col("o_orderkey")], 500).groupBy("o_orderpriority", "batch").agg(F.count("*").alias("n"), F.min("o_orderkey").alias("first_key"))


@query("SELECT count(*) FILTER (l_returnflag = 'A') AS resolved, count(*) FILTER (l_returnflag = 'R') AS rta, count(*) FILTER (l_returnflag = 'N') AS unresolved, count(DISTINCT (l_orderkey, l_suppkey)) AS unique_edges FROM lineitem")
def run_stats(spark, sf_dir):
    flag = F.col("l_returnflag")
    return table(spark, sf_dir, "lineitem").agg(F.count_if(flag == "A").alias("resolved"), F.count_if(flag == "R").alias("rta"), F.count_if(flag == "N").alias("unresolved"), F.countDistinct("l_orderkey", "l_suppkey").alias("unique_edges"))


@query(f"""
WITH RECURSIVE {TREE_SQL}, t AS (SELECT 'r' || r_regionkey AS seed, 'r' || r_regionkey AS node, 0 AS depth FROM region UNION ALL SELECT seed, child, depth + 1 FROM t JOIN e ON node = parent)
SELECT seed, depth, count(*) AS n FROM t WHERE depth > 0 GROUP BY ALL
""")
def tree_rollup(spark, sf_dir):
    return containment_closure(spark, sf_dir).groupBy("seed", "depth").agg(F.count("*").alias("n"))
