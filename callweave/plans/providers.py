"""Call graph providers, chosen by name, and their union."""

from __future__ import annotations

import logging
from dataclasses import dataclass, replace
from typing import Protocol

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession

from callweave.sources.storage import exists, stored
from callweave.operators.edges import base_wins_union, edge_diff, merge_edges
from callweave.operators.flow import flow_edges
from callweave.operators.resolve import Resolved, resolve_calls
from callweave.sources.scan import declared_packages, ingest_flow, within_policy

LOG = logging.getLogger("callweave")

@dataclass
class Context:
    spark: SparkSession
    tables: dict[str, DataFrame]
    phantoms: bool = True
    flow_path: str | None = None
    resolved: Resolved | None = None  # of these tables with phantoms, if it is known already
    root: str | None = None  # the project's folder; its manifest tells which packages a flow result may name

@dataclass
class Graph:
    edges: DataFrame
    external: DataFrame
    synthesized: DataFrame
    resolved: Resolved
    flow_stats: DataFrame | None = None

class Provider(Protocol):
    name: str

    def build(self, context: Context) -> Graph: ...

def no_synthesized(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], "signature string, name string, path string, start_line int, start_column int")

class Resolver:
    name = "tsc"

    def build(self, context: Context) -> Graph:
        r = resolve_calls(context.tables, context.phantoms)
        return Graph(r.edges, r.external, no_synthesized(context.spark), r)

class FlowProvider:
    """Reads the result of a flow analyzer, which is run elsewhere."""

    name = "jelly"

    def build(self, context: Context) -> Graph:
        if not context.flow_path:
            raise ValueError("the flow provider needs the path of a flow result")
        r = context.resolved or resolve_calls(context.tables, True)
        flow = ingest_flow(context.spark, context.flow_path)
        if context.root and exists(context.spark, manifest := f"{context.root}/package.json"):
            flow = within_policy(flow, declared_packages(context.spark, manifest))
        edges, external, synthesized, stats = flow_edges(flow, context.tables, r.call_sites)
        return Graph(stored(edges, "flow-edges"), stored(external, "flow-external"), stored(synthesized, "flow-synthesized"), r, stored(stats, "flow-stats"))

class Union:
    """The resolver's graph with the flow provider's laid over it. If the second fails, also late, the first stands."""

    name = "union"

    def build(self, context: Context) -> Graph:
        base = Resolver().build(context)
        if not context.flow_path:
            return base
        try:
            over = FlowProvider().build(replace(context, resolved=base.resolved if context.phantoms else None))
            merged = merge_call_graphs(base, over)
            edges = stored(merged.edges, "merged-edges")  # acts now, so that a failure shows here
        except (PySparkException, Py4JJavaError, ValueError, OSError) as error:  # what reading and parsing it may raise
            LOG.warning("the flow provider failed, the resolver's graph stands: %s", error)
            return base
        return Graph(edges, merged.external, merged.synthesized, base.resolved, over.flow_stats)

def merge_call_graphs(base: Graph, overlay: Graph) -> Graph:
    """Weights add up, provenance is the union, tags and symbols of the base win."""
    return Graph(merge_edges(base.edges, overlay.edges), base_wins_union(base.external, overlay.external, ["signature"]), base_wins_union(base.synthesized, overlay.synthesized, ["signature"]), base.resolved)

def compare(base: Graph, overlay: Graph) -> DataFrame:
    return edge_diff(base.edges, overlay.edges, ["source", "target"])

def choose(name: str) -> Provider:
    """Unknown names mean the union."""
    return {"tsc": Resolver(), "jelly": FlowProvider()}.get(name, Union())

__all__ = ["Context", "FlowProvider", "Graph", "Provider", "Resolver", "Union", "choose", "compare", "merge_call_graphs"]
