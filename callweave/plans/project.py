"""The property graph of a resolved source tree, and its conformance with the contract.

Nodes: app_name, labels (merge label first), key_prop, value, props (JSON of the declared properties that are not null),
_module (null for shared nodes). Edges: app_name, type, from_label, from_key, to_label, to_key, props, owner_module.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from callweave.functions import text as x
from callweave.operators.resolve import Resolved
from callweave.operators.rows import first_wins, last_wins
from callweave.plans import contract
from callweave.sources.storage import stored

NODE = ["app_name", "labels", "key_prop", "value", "props", "_module"]
EDGE = ["app_name", "type", "from_label", "from_key", "to_label", "to_key", "props", "owner_module"]


def node(rows: DataFrame, app: str, label: str, **given: Column) -> DataFrame:
    """Nodes of one label; columns that the contract declares are taken by name, ``given`` ones as they are given."""
    merge, key, declared = contract.NODES[label]
    columns = {p: given.get(p, F.col(p) if p in rows.columns else None) for p in contract.properties(declared)}
    casts = {"integer": "bigint", "string": "string", "boolean": "boolean", "string[]": "array<string>"}
    props = F.struct(*[c.cast(casts[contract.properties(declared)[p]]).alias(p) for p, c in columns.items() if c is not None])
    labels = F.array(*[F.lit(v) for v in dict.fromkeys([merge, label])])
    module = columns.get("_module")
    out = rows.select(F.lit(app).alias("app_name"), labels.alias("labels"), F.lit(key).alias("key_prop"), columns[key].cast("string").alias("value"), F.to_json(props).alias("props"), (module if module is not None else F.lit(None).cast("string")).alias("_module"))
    return out.where("value is not null")


def edge(rows: DataFrame, app: str, kind: str, source: tuple[str, Column], target: tuple[str, Column], props: Column | None = None) -> DataFrame:
    """Edges between (label, key) pairs; ``owner_module`` is filled in by :func:`project_graph`."""
    made = F.to_json(props) if props is not None else F.lit("{}")
    return rows.select(F.lit(app).alias("app_name"), F.lit(kind).alias("type"), F.lit(contract.merge_label(source[0])).alias("from_label"), source[1].cast("string").alias("from_key"), F.lit(contract.merge_label(target[0])).alias("to_label"), target[1].cast("string").alias("to_key"), made.alias("props"))


def span_key(prefix: str) -> Column:
    return F.concat("owner", F.lit(f"#{prefix}:"), "name", F.lit("@"), F.concat_ws(":", "start_line", "start_column"))


def project_graph(tables: dict[str, DataFrame], resolved: Resolved, app: str, synthesized: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges), the nodes written. Ends that are no nodes drop their edge; the number is the difference to the rows given."""
    own = {k: v.where("is_target") for k, v in tables.items()}
    generic = F.transform("type_parameters", lambda p: p["name"])
    kinds = {"class": "Class", "interface": "Interface", "enum": "Enum", "type_alias": "TypeAlias", "namespace": "Namespace"}
    types = stored(last_wins(own["declaration"], ["signature"], [F.col("order")]), "types")
    calls = stored(last_wins(own["callable"], ["signature"], [F.col("order")]), "callables")
    module = F.col("file_key")
    sites = resolved.call_sites.where("is_target")
    fields = own["attribute"].withColumn("id", F.concat("owner", F.lit("#attr:"), "name")).dropDuplicates(["id"])
    variables = own["variable"].withColumn("id", span_key("var")).dropDuplicates(["id"])
    bare = own["import"].where(x.is_external(F.col("module")) & F.col("target").isNull()).select(F.col("module").alias("name"))
    again = own["export"].where(x.is_external(F.col("module")) & F.col("target").isNull()).select(F.col("module").alias("name"))
    packages = resolved.external.select(F.col("module").alias("name")).unionByName(bare).unionByName(again).distinct()
    marked = [own[t].select(F.explode("decorators").alias("d")).select("d.*") for t in ("callable", "declaration", "attribute")]
    decorators = first_wins(marked[0].unionByName(marked[1]).unionByName(marked[2]).select("qualified_name", "name"), ["qualified_name"], [F.col("name")])
    parts = [node(own["module"].sparkSession.range(1).select(F.lit(app).alias("name")), app, "Application", schema_version=F.lit(contract.VERSION)), node(own["module"], app, "Module", _module=module)]
    for kind, label in kinds.items():
        parts.append(node(types.where(F.col("kind") == kind), app, label, _module=module, type_parameter_names=generic, member_names=F.transform("members", lambda m: m["name"]), member_values=F.transform("members", lambda m: m["value"])))
    parts.append(node(calls, app, "Callable", _module=module, type_parameter_names=generic, parameters_json=F.to_json("parameters"), accessed_symbols_json=F.lit("[]")))
    parts.append(node(resolved.external, app, "External"))
    parts += [node(packages, app, "Package"), node(decorators, app, "Decorator")]
    parts.append(node(sites, app, "CallSite", _module=module))
    parts += [node(fields, app, "Attribute", _module=module), node(variables, app, "Variable", _module=module)]
    if synthesized is not None:
        parts.append(node(synthesized, app, "AnonymousCallable", _module=F.col("path")))
    nodes = parts[0]
    for p in parts[1:]:
        nodes = nodes.unionByName(p)

    nodes = stored(nodes.select(NODE), "nodes")  # edges meet it twice
    by = lambda column: F.col(column)
    parents = resolved.parents
    modules = tables["module"].select("file_key", "module_name")
    owner_names = modules.select(F.col("module_name").alias("owner_signature"), F.col("file_key").alias("owner_file"))
    inner = types.select("signature", "owner_signature").unionByName(calls.where("owner_kind not in ('class', 'interface')").select("signature", "owner_signature")).join(owner_names, "owner_signature", "left")
    variable_owner = variables.join(owner_names.withColumnRenamed("owner_signature", "owner"), "owner", "left")
    index = modules.where("module_name like '%/index'").select(F.regexp_replace("module_name", "/index$", "").alias("target"), F.col("file_key").alias("to_index"))
    reached = lambda rows: rows.join(modules.select(F.col("module_name").alias("target"), F.col("file_key").alias("to_file")), "target", "left").join(index, "target", "left").withColumn("to_key", F.coalesce("to_file", "to_index"))
    target = reached(own["import"])
    rolled = target.withColumn("package", F.when(F.col("target").isNull(), F.col("module"))).groupBy("file_key", "to_key", "package").agg(F.array_sort(F.collect_set("name")).alias("imported_names"), F.array_sort(F.collect_set("import_kind")).alias("import_kinds"), F.bool_and("is_type_only").alias("is_type_only"))
    imported = F.struct("imported_names", "import_kinds", "is_type_only")
    exports = reached(own["export"].where("module is not null")).withColumn("package", F.when(F.col("target").isNull(), F.col("module"))).select("file_key", "to_key", "package").distinct()
    called = F.struct("weight", "provenance", F.col("tags")["ts.dispatch"].alias("dispatch"), F.when(F.col("tags")["ts.external"] == "true", True).alias("external"), F.col("tags")["ts.module"].alias("module"))

    def decorated(rows: DataFrame, label: str, key: Column) -> DataFrame:
        d = rows.select(key.alias("key"), F.explode("decorators").alias("d"))
        props = F.struct(F.col("d.positional_arguments").alias("positional_arguments"), F.to_json("d.keyword_arguments").alias("keyword_arguments_json"), F.col("d.start_line").alias("start_line"), F.col("d.end_line").alias("end_line"))
        return edge(d, app, "DECORATED_BY", (label, by("key")), ("Decorator", by("d.qualified_name")), props)

    ends = [
        edge(own["module"], app, "HAS_MODULE", ("Application", F.lit(app)), ("Module", module)),
        edge(inner.where("owner_file is not null"), app, "DECLARES", ("Module", by("owner_file")), ("Class", by("signature"))),
        edge(inner.where("owner_file is null"), app, "DECLARES", ("Class", by("owner_signature")), ("Class", by("signature"))),
        edge(calls.where("owner_kind in ('class', 'interface')"), app, "HAS_METHOD", ("Class", by("owner_signature")), ("Callable", by("signature"))),
        edge(fields, app, "HAS_ATTRIBUTE", ("Class", by("owner")), ("Attribute", by("id"))),
        edge(variable_owner.where("owner_file is not null"), app, "DECLARES_VAR", ("Module", by("owner_file")), ("Variable", by("id"))),
        edge(variable_owner.where("owner_file is null"), app, "DECLARES_VAR", ("Callable", by("owner")), ("Variable", by("id"))),
        edge(sites, app, "HAS_CALLSITE", ("Callable", by("caller")), ("CallSite", by("id"))),
        edge(sites.where("callee_signature is not null"), app, "RESOLVES_TO", ("CallSite", by("id")), ("Callable", by("callee_signature"))),
        edge(resolved.edges, app, "CALLS", ("Callable", by("source")), ("Callable", by("target")), called),
        edge(parents.where("extends"), app, "EXTENDS", ("Class", by("child")), ("Class", by("parent"))),
        edge(parents.where("not extends"), app, "IMPLEMENTS", ("Class", by("child")), ("Interface", by("parent"))),
        edge(rolled.where("to_key is not null"), app, "IMPORTS", ("Module", module), ("Module", by("to_key")), imported),
        edge(rolled.where("package is not null"), app, "IMPORTS", ("Module", module), ("Package", by("package")), imported),
        edge(exports.where("to_key is not null"), app, "RE_EXPORTS", ("Module", module), ("Module", by("to_key"))),
        edge(exports.where("package is not null"), app, "RE_EXPORTS", ("Module", module), ("Package", by("package"))),
        edge(resolved.external, app, "MEMBER_OF", ("External", by("signature")), ("Package", by("module"))),
        decorated(types.where("kind = 'class'"), "Class", by("signature")), decorated(calls, "Callable", by("signature")), decorated(fields, "Attribute", by("id")),
    ]
    if synthesized is not None:
        hosted = synthesized.withColumn("host", F.regexp_replace("signature", r":<\d+:\d+>$", "")).join(owner_names.withColumnRenamed("owner_signature", "host"), "host", "left")
        ends.append(edge(hosted.where("owner_file is null"), app, "DECLARES", ("Callable", by("host")), ("AnonymousCallable", by("signature"))))
        ends.append(edge(hosted.where("owner_file is not null"), app, "DECLARES", ("Module", by("owner_file")), ("AnonymousCallable", by("signature"))))
    edges = ends[0]
    for e in ends[1:]:
        edges = edges.unionByName(e)
    keys = nodes.select(F.element_at("labels", 1).alias("label"), "value", "_module")
    edges = edges.join(keys.select(F.col("label").alias("from_label"), F.col("value").alias("from_key"), F.col("_module").alias("owner_module")), ["from_label", "from_key"])
    edges = edges.join(keys.select(F.col("label").alias("to_label"), F.col("value").alias("to_key")), ["to_label", "to_key"], "left_semi")
    return nodes, edges.select(EDGE)


def check_conformance(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(problem, subject) for everything the contract does not allow; must be empty. Ends are judged by merge labels."""
    labels = F.create_map(*[v for n, (_, _, p) in contract.NODES.items() for v in (F.lit(n), F.array(*[F.lit(k) for k in contract.properties(p)]))])
    label = F.element_at("labels", -1)
    bad_label = nodes.where(~label.isin(list(contract.NODES))).select(F.lit("undeclared label").alias("problem"), label.alias("subject"))
    extra = F.array_except(F.json_object_keys("props"), F.element_at(labels, label))
    bad_prop = nodes.where(label.isin(list(contract.NODES)) & (F.size(extra) > 0)).select(F.lit("undeclared property").alias("problem"), F.concat_ws(".", label, F.array_join(extra, ",")).alias("subject"))
    twice = nodes.groupBy("app_name", F.element_at("labels", 1).alias("l"), "value").count().where("count > 1").select(F.lit("repeated key").alias("problem"), F.concat_ws(" ", "l", "value").alias("subject"))
    ends = F.array(*[F.lit(f"{t} {contract.merge_label(a)} {contract.merge_label(b)}") for t, (f, g, _) in contract.RELATIONSHIPS.items() for a in f.split() for b in g.split()])
    shape = F.concat_ws(" ", "type", "from_label", "to_label")
    bad_end = edges.where(~F.array_contains(ends, shape)).select(F.lit("undeclared ends").alias("problem"), shape.alias("subject"))
    allowed = F.create_map(*[v for t, (_, _, p) in contract.RELATIONSHIPS.items() for v in (F.lit(t), F.array(*[F.lit(k) for k in contract.properties(p)]).cast("array<string>"))])
    more = F.array_except(F.coalesce(F.json_object_keys("props"), F.array().cast("array<string>")), F.element_at(allowed, F.col("type")))
    bad_edge_prop = edges.where(F.col("type").isin(list(contract.RELATIONSHIPS)) & (F.size(more) > 0)).select(F.lit("undeclared property").alias("problem"), F.concat_ws(".", "type", F.array_join(more, ",")).alias("subject"))
    return bad_label.unionByName(bad_prop).unionByName(twice).unionByName(bad_end).unionByName(bad_edge_prop)
