"""Sinks: JSON documents and Cypher statements; snapshots are those of :mod:`callweave.sources.snapshot`."""

from __future__ import annotations

from pathlib import Path
from typing import BinaryIO

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from callweave.operators.rows import batches
from callweave.sources.snapshot import apply_incremental, load_snapshot, versions
from callweave.sources.storage import names_in, pieces_of, stored

__all__ = ["apply_incremental", "copy_json", "cypher_statements", "in_order", "literal", "load_snapshot", "module_documents", "versions", "write_contract", "write_cypher", "write_json"]
STATEMENT_ROWS = 500


def module_documents(tables: dict[str, DataFrame], edges: DataFrame | None = None) -> DataFrame:
    """(file_key, from_cache, json): one document a module, nulls kept. Every list is grouped by file before it is joined, so a group is
    one file's rows; the tables join on the file alone."""
    out = tables["module"].select("file_key", "from_cache", F.struct("module_name", "is_tsx", "is_declaration_file", "content_hash", "last_modified", "file_size", "comments").alias("module"))
    for name in ("declaration", "callable", "call_site", "attribute", "variable", "import", "export"):
        rows = tables[name]
        fields = [c for c in rows.columns if c not in ("app_name", "file_key", "is_target")]
        lists = rows.groupBy("file_key").agg(F.array_sort(F.collect_list(F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}))).alias(f"{name}s"))
        out = out.join(lists, "file_key", "left")
    lists = [c for c in out.columns if c not in ("file_key", "from_cache", "module")]
    body = F.concat(F.lit('{"module":'), F.to_json("module", {"ignoreNullFields": "false"}), *[F.concat(F.lit(f',"{c}":['), F.coalesce(F.array_join(c, ","), F.lit("")), F.lit("]")) for c in lists], F.lit("}"))
    return out.select("file_key", "from_cache", body.alias("json"))


def in_order(rows: DataFrame, *keys: str) -> DataFrame:
    """Rows dealt by ranges of the keys, as people sort names, so that the files written from them follow each other."""
    order = [F.collate(k, "UNICODE") for k in keys] + [F.col(k) for k in keys]
    return rows.repartitionByRange(*order).sortWithinPartitions(*order)


def write_json(tables: dict[str, DataFrame], edges: DataFrame, path: str) -> dict[str, int]:
    """One compact document a line for modules, by file, and one for edges, by their ends, below ``path``: the files of a
    folder, one after the other, are one sorted list. Returns what was counted while they were written."""
    built, linked = Observation("modules written"), Observation("edges written")
    documents = in_order(module_documents(tables), "file_key")  # counted behind the shuffle, whose sampling reads rows twice
    documents = documents.observe(built, F.count("*").alias("modules"), F.count_if("from_cache").alias("cached"), F.count_if(~F.col("from_cache")).alias("built"))
    documents.select("json").write.mode("overwrite").text(f"{path}/modules")
    ordered = in_order(edges, "source", "target").observe(linked, F.count("*").alias("edges"), F.coalesce(F.sum("weight"), F.lit(0)).alias("weight"))
    ordered.select(F.to_json(F.struct(*edges.columns), {"ignoreNullFields": "false"})).write.mode("overwrite").text(f"{path}/call_graph")
    return built.get | linked.get


def copy_json(spark: SparkSession, path: str, out: BinaryIO) -> None:
    """Copies the files of :func:`write_json` to a stream in their order, in pieces, modules first."""
    for folder in ("modules", "call_graph"):
        for name in sorted(n for n in names_in(spark, f"{path}/{folder}") if n.startswith("part-")):
            for piece in pieces_of(spark, f"{path}/{folder}/{name}"):
                out.write(piece)


def literal(json: Column) -> Column:
    """A JSON object as a Cypher map: the same text with bare keys."""
    return F.regexp_replace(json, r'(?<=[{,])"([A-Za-z_][A-Za-z_0-9]*)":', "$1: ")


def cypher_statements(nodes: DataFrame, edges: DataFrame, app: str, size: int = STATEMENT_ROWS) -> DataFrame:
    """(part, statement): uniqueness, the wipe of the application's own nodes, nodes, edges; ``size`` rows a statement."""
    from callweave.plans import contract

    spark = nodes.sparkSession
    quoted = app.replace("\\", "\\\\").replace("'", "\\'")
    first = [(0, f"CREATE CONSTRAINT IF NOT EXISTS FOR (n:{m}) REQUIRE n.{k} IS UNIQUE;") for m, k in contract.constraints()]
    first += [(0, f"{text};") for text in contract.INDEXES]
    first.append((1, f"MATCH (a:Application {{name: '{quoted}'}})-[:HAS_MODULE|DECLARES|HAS_METHOD|HAS_ATTRIBUTE|DECLARES_VAR|HAS_CALLSITE*1..]->(n) DETACH DELETE n;"))
    head = spark.createDataFrame(first, "part int, statement string")
    shape = F.array_join("labels", ":")
    made = batches(nodes.select(shape.alias("labels"), "key_prop", "value", "props"), ["labels", "key_prop"], [F.col("value")], size)
    row = F.concat(F.lit("{k: "), F.to_json(F.struct("value")).substr(F.lit(10), F.length(F.to_json(F.struct("value"))) - 10), F.lit(", p: "), literal(F.col("props")), F.lit("}"))
    merge = F.element_at(F.split("labels", ":"), 1)
    more = F.when(F.contains(F.col("labels"), F.lit(":")), F.concat(F.lit(" SET n:"), F.element_at(F.split("labels", ":"), -1))).otherwise("")
    node_rows = made.groupBy("labels", "key_prop", "batch").agg(F.array_join(F.array_sort(F.collect_list(row)), ", ").alias("rows")).select(F.lit(2).alias("part"), F.concat(F.lit("UNWIND ["), "rows", F.lit("] AS r MERGE (n:"), merge, F.lit(" {"), "key_prop", F.lit(": r.k}) SET n += r.p"), more, F.lit(";")).alias("statement"))
    keys = F.create_map(*[F.lit(v) for m, k in contract.constraints() for v in (m, k)])
    linked = batches(edges, ["type", "from_label", "to_label"], [F.col("from_key"), F.col("to_key")], size)
    text = lambda c: F.concat(F.lit('"'), F.regexp_replace(F.regexp_replace(c, r"\\", r"\\\\"), '"', r"\\\""), F.lit('"'))
    pair = F.concat(F.lit("{a: "), text("from_key"), F.lit(", b: "), text("to_key"), F.lit(", p: "), literal(F.col("props")), F.lit("}"))
    edge_rows = linked.groupBy("type", "from_label", "to_label", "batch").agg(F.array_join(F.array_sort(F.collect_list(pair)), ", ").alias("rows"))
    ends = F.concat(F.lit("] AS r MATCH (a:"), "from_label", F.lit(" {"), F.element_at(keys, F.col("from_label")), F.lit(": r.a}), (b:"), "to_label", F.lit(" {"), F.element_at(keys, F.col("to_label")), F.lit(": r.b}) MERGE (a)-[e:"), "type", F.lit("]->(b) SET e += r.p;"))
    edge_rows = edge_rows.select(F.lit(3).alias("part"), F.concat(F.lit("UNWIND ["), "rows", ends).alias("statement"))
    return head.unionByName(node_rows).unionByName(edge_rows)


def write_cypher(nodes: DataFrame, edges: DataFrame, app: str, path: str) -> None:
    """Statements as text, in an order in which they can be run: files are ranges of part and statement, in their order."""
    rows = stored(cypher_statements(nodes, edges, app), "statements")
    rows.repartitionByRange("part", "statement").sortWithinPartitions("part", "statement").select("statement").write.mode("overwrite").text(path)


def write_contract(path: str) -> None:
    from callweave.plans.contract import as_json

    Path(path).write_text(as_json())
