"""python -m callweave -i ROOT: analyses a source tree and writes tables, a graph or the graph's contract."""

from __future__ import annotations

import argparse
import logging
import os
import sys

from callweave.plans.engine import Options, analyze

LOG = logging.getLogger("callweave")


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser("callweave", description="Code-graph analytics on Spark.")
    add = p.add_argument
    add("-i", "--input", help="root of the source tree; not needed with --emit schema")
    add("-o", "--output", help="folder to write to; without it JSON goes to standard output")
    add("--emit", default="json", help="json, neo4j (Cypher statements), parquet (graph tables) or schema (the graph's contract); unknown: json")
    add("--app-name", help="name of the application in the graph; otherwise the input folder's")
    add("--neo4j-uri", default=os.environ.get("NEO4J_URI"), help="accepted; statements are written instead of pushed (env: NEO4J_URI)")
    add("--neo4j-user", default=os.environ.get("NEO4J_USERNAME", "neo4j"), help="accepted (env: NEO4J_USERNAME)")
    add("--neo4j-password", default=os.environ.get("NEO4J_PASSWORD", "neo4j"), help="accepted (env: NEO4J_PASSWORD)")
    add("--neo4j-database", default=os.environ.get("NEO4J_DATABASE"), help="accepted (env: NEO4J_DATABASE)")
    add("--snapshot", help="graph snapshot to bring up to date")
    add("-a", "--analysis-level", default="1", help="1 or 2; both give the same")
    add("-t", "--target-files", nargs="+", help="make nodes and edges of these files alone")
    add("--skip-dir", action="append", metavar="NAME", help="leave out directories of this name too; may be repeated")
    add("--skip-tests", action="store_true", help="leave test trees out (default)")
    add("--include-tests", action="store_true", help="take test trees too")
    add("--eager", action="store_true", help="parse every file again")
    add("--lazy", action="store_true", help="take unchanged files from the cache (default)")
    add("--no-build", action="store_true", help="accepted; dependencies are never installed")
    add("--no-phantoms", action="store_true", help="no external symbols for calls into packages")
    add("--call-graph-provider", default="union", help="union, tsc or jelly; both is an old name of union; unknown: union")
    add("--flow-file", help="result of a flow analyzer, for jelly and union")
    add("--tsc-only", action="store_true", help="the same as --call-graph-provider tsc, and stronger")
    add("-c", "--cache-dir", help="folder of parsed files to reuse and bring up to date")
    add("-v", "--verbose", action="count", default=0, help="say more; may be repeated")
    return p


def options(argv: list[str]) -> Options:
    p = parser()
    a, _ = p.parse_known_args(argv)
    if a.emit != "schema" and not a.input:
        p.error("--input is needed")
    if a.call_graph_provider == "both":
        LOG.warning("the provider 'both' is now called 'union'")
    provider = "tsc" if a.tsc_only else a.call_graph_provider if a.call_graph_provider in ("tsc", "jelly") else "union"
    logging.basicConfig(stream=sys.stderr, level=[logging.WARNING, logging.INFO, logging.DEBUG][min(a.verbose, 2)])
    return Options(
        a.input or "", a.app_name, a.target_files, not a.include_tests, provider, not a.no_phantoms, a.flow_file, a.emit, a.output, a.snapshot,
        2 if a.analysis_level == "2" else 1, not a.no_build, a.cache_dir, a.eager, a.skip_dir,
    )


def main(argv: list[str] | None = None) -> int:
    chosen = options(sys.argv[1:] if argv is None else argv)
    if chosen.emit == "schema":
        from callweave.plans import contract
        from callweave.sources import sinks

        print(contract.as_json(), end="") if not chosen.output else sinks.write_contract(chosen.output)
        return 0
    from pyspark.sql import SparkSession

    from callweave.sources import sinks
    from callweave.sources.storage import delete_path, fresh_path

    spark = SparkSession.builder.appName("callweave").getOrCreate()
    done = analyze(spark, chosen)
    if not chosen.output:
        path = fresh_path(spark, "json")
        done.figures = sinks.write_json(done.tables, done.graph.edges, path)
        sinks.copy_json(spark, path, sys.stdout.buffer)
        delete_path(spark, path)
    if done.figures:
        LOG.info("modules: %(modules)d, of which built %(built)d and cached %(cached)d; edges: %(edges)d of weight %(weight)d", done.figures)
    return 0


if __name__ == "__main__":
    sys.exit(main())
