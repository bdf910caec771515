"""The whole run: scan, parse, resolve, merge, project, write."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from callweave.sources.storage import stored
from callweave.plans.project import project_graph
from callweave.plans.providers import Context, Graph, choose
from callweave.sources import sinks
from callweave.sources.scan import ProjectConfig, parse_modules, project_config, resolve_aliases, scan_sources


@dataclass
class Options:
    """What a run takes. ``level`` and ``materialize`` are accepted for compatibility and change nothing."""

    input: str
    app_name: str | None = None
    targets: list[str] | None = None
    skip_tests: bool = True
    provider: str = "union"
    phantoms: bool = True
    flow_path: str | None = None
    emit: str = "json"
    output: str | None = None
    snapshot: str | None = None
    level: int = 1
    materialize: bool = False
    cache: str | None = None
    eager: bool = False
    skipped: list[str] | None = None

    @property
    def name(self) -> str:
        return self.app_name or self.input.rstrip("/").rsplit("/", 1)[-1]


@dataclass
class Analysis:
    tables: dict[str, DataFrame]
    graph: Graph
    nodes: DataFrame | None = None
    edges: DataFrame | None = None
    changes: DataFrame | None = field(default=None)
    figures: dict[str, int] | None = None  # counted while JSON was written: modules built and cached, edges and their weight


def analyze(spark: SparkSession, options: Options) -> Analysis:
    files = scan_sources(spark, options.input, options.skip_tests, options.targets, options.skipped)
    return analyze_files(spark, files, options, project_config(spark, options.input))


def analyze_files(spark: SparkSession, files: DataFrame, options: Options, config: ProjectConfig | None = None) -> Analysis:
    """From rows of files; all of them are read for resolution, targets alone make nodes and edges."""
    tables = resolve_aliases(parse_modules(files, options.name, options.cache, options.eager), config or ProjectConfig())
    graph = choose(options.provider).build(Context(spark, tables, options.phantoms, options.flow_path, root=options.input or None))
    out = Analysis(tables, graph)
    kind = options.emit if options.emit in ("json", "neo4j", "schema", "parquet") else "json"
    if kind in ("neo4j", "parquet") or options.snapshot:
        resolved = graph.resolved
        resolved.edges, resolved.external = graph.edges, graph.external
        nodes, edges = project_graph(tables, resolved, options.name, graph.synthesized)
        out.nodes, out.edges = nodes, stored(edges, "graph-edges")
    if options.snapshot:
        out.changes = sinks.apply_incremental(spark, options.snapshot, out.nodes, out.edges, options.targets is None)
    if options.output:
        if kind == "json":
            out.figures = sinks.write_json(tables, graph.edges, options.output)
        elif kind == "neo4j":
            sinks.write_cypher(out.nodes, out.edges, options.name, options.output)
        elif kind == "parquet":
            out.nodes.write.mode("overwrite").parquet(f"{options.output}/nodes")
            out.edges.write.mode("overwrite").parquet(f"{options.output}/edges")
        else:
            sinks.write_contract(options.output)
    return out
