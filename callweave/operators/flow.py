"""Adapter for the result of a whole-program flow analyzer: positions to signatures, boundary policy, edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from callweave.functions import text as x
from callweave.operators.edges import call_edges
from callweave.operators.rows import first_wins, innermost
from callweave.sources.scan import Flow
from callweave.sources.storage import stored


COLUMNS = 1 << 24


def place(line: str, column: str) -> Column:
    """A line and column as one number. Columns from ``COLUMNS`` on would run into the next line; no file has such lines."""
    return F.col(line).cast("long") * COLUMNS + F.col(column)


def functions_of(flow: Flow, tables: dict[str, DataFrame]) -> DataFrame:
    """(id, class, signature, module, member, path, line, column) of the analyzer's functions.

    A project function is the callable whose function starts at its place (of a named arrow, the arrow and not the variable);
    else an anonymous one, named after the innermost callable around it, or after its module. A function below ``node_modules`` belongs to its package.
    """
    rows = flow.functions.select("id", "path", F.col("place.start_line").alias("line"), F.col("place.start_column").alias("column"), x.package_of(F.col("path")).alias("p"))
    modules = tables["module"].select(F.col("file_key").alias("path"), "module_name")
    inside = rows.where("p is null").join(modules, "path")
    written = tables["callable"].where("not is_implicit")
    spans = written.select(F.col("file_key").alias("path"), F.col("signature").alias("host"), place("start_line", "start_column").alias("start"), place("end_line", "end_column").alias("end"))
    host = innermost(inside.select("id", "path", place("line", "column").alias("at")), spans, ["path"], ["id"], "at", "start", "end").select("id", "host")
    exact = written.select(F.col("file_key").alias("path"), F.col("function_line").alias("line"), F.col("function_column").alias("column"), F.col("signature").alias("own")).dropDuplicates(["path", "line", "column"])
    named = inside.join(host, "id", "left").join(exact, ["path", "line", "column"], "left")
    anonymous = x.anonymous_signature(F.coalesce("host", "module_name"), F.col("line"), F.col("column"))
    project = named.select("id", F.when(F.col("own").isNotNull(), "project").otherwise("anonymous").alias("class"), F.coalesce("own", anonymous).alias("signature"), F.lit(None).cast("string").alias("module"), F.lit(None).cast("string").alias("member"), "path", "line", "column")
    library = rows.where("p is not null").select("id", F.lit("library").alias("class"), x.anonymous_signature(F.concat_ws(":", "p.package", "p.path"), F.col("line"), F.col("column")).alias("signature"), F.col("p.package").alias("module"), F.lit(None).cast("string").alias("member"), "path", "line", "column")
    return project.unionByName(library)


def border_calls(flow: Flow, functions: DataFrame, sites: DataFrame) -> DataFrame:
    """(source, target, module, member, ordinal) of the project's calls into libraries.

    A call is the innermost call site around its place; it belongs to the innermost of the analyzer's own functions around
    it, and is named by what the site resolved to, else by the library function's place. Calls of no function are left out.
    """
    calls = flow.calls.select(F.col("id").alias("call"), "path", place("place.start_line", "place.start_column").alias("at"))
    library = functions.where("class = 'library'").select(F.col("id").alias("callee"), F.col("signature").alias("place_name"), F.col("module").alias("package"))
    met = flow.call2fun.join(library, "callee").join(calls, "call")
    around = functions.where("class <> 'library'").join(flow.functions.select("id", "place"), "id")
    around = around.select("path", F.col("signature").alias("source"), place("place.start_line", "place.start_column").alias("start"), place("place.end_line", "place.end_column").alias("end"))
    owned = innermost(met, around, ["path"], ["call", "callee"], "at", "start", "end").drop("start", "end")
    spans = sites.select(F.col("file_key").alias("path"), place("start_line", "start_column").alias("start"), place("end_line", "end_column").alias("end"), F.when(F.col("is_external"), F.col("callee_signature")).alias("named"))
    sited = innermost(owned, spans, ["path"], ["call", "callee"], "at", "start", "end").select("call", "callee", "named")
    out = owned.join(sited, ["call", "callee"], "left")
    member = F.when(F.col("named").isNotNull(), x.member_of(F.col("named")))
    module = F.coalesce(F.when(F.col("named").isNotNull(), x.owner_of(F.col("named"))), F.col("package"))
    return out.select("source", F.coalesce("named", "place_name").alias("target"), module.alias("module"), member.alias("member"), F.struct("call", "callee").alias("ordinal"))


def flow_edges(flow: Flow, tables: dict[str, DataFrame], sites: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(edges, external, synthesized, stats).

    Pairs of functions give the edges inside the project and those from libraries into it; calls give the edges into
    libraries, because a call's text names what is called. Pairs inside libraries, and unknown ends, are dropped.
    """
    functions = stored(functions_of(flow, tables), "flow-functions")
    calls = stored(border_calls(flow, functions, sites), "border-calls")
    a = functions.select(F.col("id").alias("caller"), F.col("signature").alias("source"), F.col("class").alias("a"), F.col("module").alias("a_module"))
    b = functions.select(F.col("id").alias("callee"), F.col("signature").alias("target"), F.col("class").alias("b"))
    pairs = stored(flow.fun2fun.join(a, "caller", "left").join(b, "callee", "left"), "flow-pairs")
    inner, inbound = (F.col("a") != "library") & (F.col("b") != "library"), (F.col("a") == "library") & (F.col("b") != "library")
    outbound = (F.col("a") != "library") & (F.coalesce("b", F.lit("library")) == "library")
    none = F.create_map().cast("map<string,string>")
    tags = lambda module: F.create_map(F.lit("ts.external"), F.lit("true"), F.lit("ts.module"), F.col(module))
    good = pairs.where(inner | inbound).select("source", "target", F.struct(F.lit(1).alias("k"), "caller", "callee").alias("ordinal"), F.when(inbound, tags("a_module")).otherwise(none).alias("tags"))
    out = calls.select("source", "target", F.struct(F.lit(0).alias("k"), F.col("ordinal.call").alias("caller"), F.col("ordinal.callee").alias("callee")).alias("ordinal"), tags("module").alias("tags"))
    edges = stored(call_edges(good.unionByName(out), "jelly"), "flow-call-edges")
    ends = edges.select(F.explode(F.array("source", "target")).alias("signature")).distinct()
    synthesized = functions.where(F.col("class") == "anonymous").join(ends, "signature", "left_semi").select("signature", F.lit("(anonymous)").alias("name"), "path", F.col("line").alias("start_line"), F.col("column").alias("start_column")).dropDuplicates(["signature"])
    named = calls.select(F.col("target").alias("signature"), F.coalesce("member", F.lit("(anonymous)")).alias("name"), "module")
    entered = functions.where("class = 'library'").join(ends, "signature", "left_semi").select("signature", F.lit("(anonymous)").alias("name"), "module")
    external = first_wins(named.unionByName(entered), ["signature"], [F.col("name"), F.col("module")])
    dropped = ~(F.coalesce(inner, F.lit(False)) | F.coalesce(inbound, F.lit(False)) | F.coalesce(outbound, F.lit(False)))
    stats = functions.agg(F.count("*").alias("functions"), F.count_if(F.col("class") != "library").alias("first_party"), F.count_if(F.col("class") == "anonymous").alias("synthesized"))
    stats = stats.crossJoin(synthesized.agg(F.count("*").alias("materialized"))).crossJoin(external.agg(F.count("*").alias("external"))).crossJoin(edges.agg(F.count("*").alias("edges")))
    counted = pairs.agg(F.count("*").alias("pairs"), F.count_if(inbound).alias("inbound"), F.count_if(dropped).alias("dropped"))
    stats = stats.crossJoin(counted).crossJoin(calls.agg(F.count("*").alias("outbound")))
    return edges, external, synthesized, stats.withColumn("boundary", F.col("inbound") + F.col("outbound")).drop("inbound", "outbound")
