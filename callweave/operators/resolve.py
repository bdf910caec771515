"""Callees by joins: names through scopes and imports, receivers through the types of members, then packages.

A call is a root and steps. The root is looked up in the innermost scope that declares it; each step then joins the
members of the type reached. Variables whose type comes from an expression are evaluated the same way, in rounds, because
one may rest on another; a round that types nothing new is the last.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from callweave.functions import text as x
from callweave.operators.closure import fixpoint_closure, dispatch
from callweave.operators.edges import call_edges
from callweave.operators.rows import first_wins
from callweave.sources.storage import stored

SAME_ARRAY = ["filter", "slice", "concat", "reverse", "sort", "toSorted", "toReversed"]
ELEMENT = ["find", "at", "pop", "shift", "findLast"]


@dataclass
class Resolved:
    """Call sites with their callee and types, edges, external symbols, run statistics, and the heritage found."""

    call_sites: DataFrame
    edges: DataFrame
    external: DataFrame
    stats: DataFrame
    parents: DataFrame


def visible(rows: DataFrame, names: DataFrame) -> DataFrame:
    """``rows`` (id, scopes, name) with the entry of ``names`` (scope, name, ...) in the innermost of their scopes."""
    places = rows.select("id", "name", F.posexplode("scopes").alias("depth", "scope"))
    met = places.join(names, ["scope", "name"])
    best = met.groupBy("id").agg(F.max_by(F.struct(*[c for c in names.columns if c not in ("scope", "name")]), F.struct("depth", F.col("rank"))).alias("e"))
    return best.select("id", "e.*")


def exported(tables: dict[str, DataFrame]) -> DataFrame:
    """(prefix, name, kind, sig): what each module offers, through re-exports."""
    modules = tables["module"].select("file_key", F.col("module_name").alias("prefix"))
    own = declared(tables).join(modules.select(F.col("prefix").alias("scope")), "scope", "left_semi").select(F.col("scope").alias("prefix"), "name", "kind", "sig")
    default = tables["default_export"].join(modules, "file_key").join(own, ["prefix", "name"]).select("prefix", F.lit("default").alias("name"), "kind", "sig")
    found = stored(own.unionByName(default).dropDuplicates(["prefix", "name"]), "exports")
    again = tables["export"].join(modules, "file_key").select("prefix", F.col("name").alias("from_name"), F.col("alias"), F.coalesce("target", "prefix").alias("target"), F.col("module").isNotNull().alias("other"))
    again = stored(again, "re-exports")
    if again.isEmpty():
        return found
    while True:
        source = found.select(F.col("prefix").alias("target"), F.col("name").alias("from_name"), "kind", "sig").unionByName(found.where("prefix like '%/index'").select(F.regexp_replace("prefix", "/index$", "").alias("target"), F.col("name").alias("from_name"), "kind", "sig"))
        named = again.where("from_name <> '*'").join(source, ["target", "from_name"]).select("prefix", F.coalesce("alias", "from_name").alias("name"), "kind", "sig")
        stars = again.where("from_name = '*' and alias is null").drop("from_name").join(source, "target").where("from_name <> 'default'").select("prefix", F.col("from_name").alias("name"), "kind", "sig")
        more = named.unionByName(stars).join(found, ["prefix", "name"], "left_anti").dropDuplicates(["prefix", "name"])
        more = stored(more, "exports")
        if more.isEmpty():
            break
        found = found.unionByName(more)
    return found


def declared(tables: dict[str, DataFrame]) -> DataFrame:
    """(scope, name, kind, sig) of declarations and functions."""
    types = tables["declaration"].select(F.col("owner_signature").alias("scope"), "name", "kind", F.col("signature").alias("sig"))
    functions = tables["callable"].where(F.col("kind").isin("function", "arrow", "function_expression")).select(F.col("owner_signature").alias("scope"), "name", F.lit("function").alias("kind"), F.col("signature").alias("sig"))
    return types.unionByName(functions)


def names_in_scope(tables: dict[str, DataFrame]) -> DataFrame:
    """(scope, name, kind, sig): declarations, and imports of project modules."""
    modules = tables["module"].select("file_key", F.col("module_name").alias("prefix"))
    imports = tables["import"].where("target is not null").join(modules.withColumnRenamed("prefix", "scope"), "file_key")
    offered = exported(tables)
    whole = offered.unionByName(offered.where("prefix like '%/index'").withColumn("prefix", F.regexp_replace("prefix", "/index$", "")))
    wanted = imports.where("import_kind <> 'namespace'").select("scope", "local", F.col("target").alias("prefix"), F.when(F.col("import_kind") == "default", "default").otherwise(F.col("name")).alias("name"))
    named = wanted.join(whole, ["prefix", "name"]).select("scope", F.col("local").alias("name"), "kind", "sig")
    spaces = imports.where("import_kind = 'namespace'").select("scope", F.col("local").alias("name"), F.lit("namespace").alias("kind"), F.col("target").alias("sig"))
    both = declared(tables).withColumn("rank", F.lit(1)).unionByName(named.unionByName(spaces).withColumn("rank", F.lit(0)))
    return stored(both.dropDuplicates(["scope", "name", "rank", "sig"]), "names")


def typed(rows: DataFrame, names: DataFrame, types: DataFrame) -> DataFrame:
    """(id, sig) of the types that ``rows`` (id, scopes, type_name) name: the first part through scopes, the rest as members."""
    asked = rows.where("type_name is not null and type_name <> 'this'")
    first = asked.select("id", "scopes", F.substring_index("type_name", ".", 1).alias("name"), F.regexp_extract("type_name", r"^[^.]*(\..*)?$", 1).alias("rest"))
    found = visible(first.select("id", "scopes", "name"), names.where("kind <> 'function'")).join(first.select("id", "rest"), "id")
    return found.select("id", F.concat("sig", "rest").alias("sig")).join(types.select(F.col("signature").alias("sig")).distinct(), "sig", "left_semi").select("id", "sig")


def ancestors(tables: dict[str, DataFrame], names: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(child, parent, from_class, extends) resolved heritage, and its closure (child, ancestor, depth)."""
    rows = tables["declaration"].where("kind in ('class', 'interface')")
    flat = rows.select("signature", "kind", "scopes", F.posexplode("base_classes").alias("k", "text"), F.coalesce("extends_types", F.array()).alias("extends_types"))
    flat = flat.select(F.concat_ws("|", "signature", "k").alias("id"), "signature", "kind", "scopes", F.col("text").alias("type_name"), F.array_contains("extends_types", F.col("text")).alias("extends"))
    found = typed(flat, names, rows)
    parents = stored(flat.join(found, "id").select(F.col("signature").alias("child"), F.col("sig").alias("parent"), (F.col("kind") == "class").alias("from_class"), "extends").distinct(), "parents")
    closed = fixpoint_closure(parents.select(F.col("child").alias("parent"), F.col("parent").alias("child")), parents.select(F.col("child").alias("seed")).distinct())
    return parents, closed.select(F.col("seed").alias("child"), F.col("node").alias("ancestor"), "depth")


def members(tables: dict[str, DataFrame], names: DataFrame, closed: DataFrame) -> DataFrame:
    """(owner, member, target, sig, array, self): methods, attributes and what namespaces hold, inherited ones included."""
    types = tables["declaration"]
    scopes = types.select(F.col("signature").alias("owner"), F.concat("scopes", F.array("signature")).alias("scopes"))
    modules = tables["module"].select(F.col("module_name").alias("owner"), F.array("module_name").alias("scopes"))
    scopes = scopes.unionByName(modules).dropDuplicates(["owner"])
    calls = tables["callable"].where("kind <> 'constructor'").select(F.col("owner_signature").alias("owner"), F.col("name").alias("member"), F.col("signature").alias("target"), F.col("return_name").alias("type_name"), F.col("return_array").alias("array"), F.lit(1).alias("rank"))
    fields = tables["attribute"].select("owner", F.col("name").alias("member"), F.lit(None).cast("string").alias("target"), "type_name", F.col("type_array").alias("array"), F.lit(0).alias("rank"))
    both = calls.unionByName(fields).withColumn("id", F.concat_ws("|", "owner", "member", "rank")).dropDuplicates(["id"])
    found = typed(both.join(scopes, "owner"), names, types.where("kind in ('class', 'interface', 'namespace')"))
    own = both.join(found, "id", "left").select("owner", "member", "target", "sig", "array", (F.col("type_name") == "this").alias("self"), "rank")
    held = types.select(F.col("owner_signature").alias("owner"), F.col("name").alias("member"), F.lit(None).cast("string").alias("target"), F.col("signature").alias("sig"), F.lit(False).alias("array"), F.lit(False).alias("self"), F.lit(-1).alias("rank"))
    own = stored(own.unionByName(held), "own-members").withColumn("depth", F.lit(0))
    inherited = closed.join(own.drop("depth").withColumnRenamed("owner", "ancestor"), "ancestor").select(F.col("child").alias("owner"), "member", "target", "sig", "array", "self", "rank", "depth")
    return stored(first_wins(own.unionByName(inherited), ["owner", "member"], [F.col("depth"), -F.col("rank"), F.col("target")]).select("owner", "member", "target", F.col("sig").alias("next"), "array", "self"), "members")


def evaluate(chains: DataFrame, names: DataFrame, values: DataFrame, known: DataFrame, types: DataFrame, parents: DataFrame, returns: DataFrame) -> DataFrame:
    """(id, target, sig, array, receiver, receiver_array) of ``chains`` (id, scopes, root, steps): the callee of the last step,
    the type reached, and the type before the last step. A chain leaves the joins soon after its own last step."""
    chains = stored(chains.select("id", "scopes", "root", "steps").where("root is not null"), "chains")
    longest = chains.agg(F.max(F.size("steps"))).first()[0] or 0
    classes = types.where("kind = 'class'").select(F.col("signature").alias("scope"))
    inside = chains.where("root in ('this', 'super')").select("id", "root", F.posexplode("scopes").alias("depth", "scope")).join(classes, "scope").groupBy("id", "root").agg(F.max_by("scope", "depth").alias("sig"))
    above = parents.where("from_class and extends").select(F.col("child").alias("sig"), "parent")
    upper = inside.where("root = 'super'").join(above, "sig").select("id", F.col("parent").alias("sig"))
    own = inside.where("root = 'this'").select("id", "sig")
    made = typed(chains.where("root = 'new'").select("id", "scopes", F.get("steps", 0)["member"].alias("type_name")), names, types.where("kind = 'class'"))
    entries = names.select("scope", "name", "kind", "sig", F.lit(False).alias("array"), "rank").unionByName(values.select("scope", "name", F.lit("value").alias("kind"), "sig", "array", F.lit(2).alias("rank")))
    found = visible(chains.where("root not in ('this', 'super', 'new')").select("id", "scopes", F.col("root").alias("name")), entries)
    start = own.select("id", F.lit("value").alias("kind"), "sig", F.lit(False).alias("array")).unionByName(upper.select("id", F.lit("super").alias("kind"), "sig", F.lit(False).alias("array")))
    start = start.unionByName(made.select("id", F.lit("new").alias("kind"), "sig", F.lit(False).alias("array"))).unionByName(found.select("id", "kind", "sig", "array"))
    state = chains.select("id", "steps").join(start, "id").join(returns.withColumnRenamed("callable", "sig"), "sig", "left")
    bare = (F.get("steps", 0)["member"] == "") & F.get("steps", 0)["called"]
    constructor = F.concat("sig", F.lit(".constructor"))
    target = F.when(F.col("kind") == "new", constructor).when((F.col("kind") == "super") & bare, constructor).when((F.col("kind") == "function") & bare, F.col("sig"))
    used = F.when(F.col("kind") == "new", 1).when(F.col("kind").isin("function", "super") & bare, 1).otherwise(0)
    reached = F.when((F.col("kind") == "function") & bare, F.col("returned")).when(F.col("kind") == "function", F.lit(None)).when((F.col("kind") == "super") & bare, F.lit(None)).otherwise(F.col("sig"))
    many = F.when((F.col("kind") == "function") & bare, F.col("returned_array")).otherwise(F.col("array"))
    none = F.lit(None).cast("string")
    state = state.select("id", "steps", used.alias("at"), target.alias("target"), reached.alias("sig"), F.coalesce(many, F.lit(False)).alias("array"), none.alias("receiver"), F.lit(False).alias("receiver_array"))
    state = stored(state, "state")
    columns = ["id", "target", "sig", "array", "receiver", "receiver_array"]
    finished = state.where("false").select(columns)
    steps = known.select("owner", "member", F.col("target").alias("next_target"), "next", F.col("array").alias("next_array"), "self", F.lit(True).alias("hit"))
    for k in range(longest):
        if k % 4 == 0:
            state = stored(state, "state") if k else state
            finished, state = finished.unionByName(state.where(F.size("steps") <= k).select(columns)), state.where(F.size("steps") > k)
        step = F.get("steps", F.lit(k))
        named = F.col("member")
        met = state.withColumn("member", step["member"]).withColumn("owner", F.when(~F.col("array"), F.col("sig"))).join(steps, ["owner", "member"], "left")
        due, many = (F.col("at") == k) & (F.size("steps") > k), F.col("array")
        inner = step["element"] | named.isin(ELEMENT)
        sig = F.when(many & (inner | named.isin(SAME_ARRAY)), F.col("sig")).when(many, F.lit(None)).when(F.col("self"), F.col("sig")).otherwise(F.col("next"))
        array = F.when(many, ~inner).otherwise(F.coalesce("next_array", F.lit(False)))
        after = {
            "at": F.lit(k + 1), "target": F.when(F.col("hit") & step["called"], F.col("next_target")), "sig": sig, "array": array,
            "receiver": F.col("sig"), "receiver_array": many,
        }
        state = met.select("id", "steps", *[F.when(due, v).otherwise(F.col(c)).alias(c) for c, v in after.items()])
    return stored(finished.unionByName(state.select(columns)), "evaluated")


def value_types(tables: dict[str, DataFrame], names: DataFrame, known: DataFrame, parents: DataFrame, returns: DataFrame) -> DataFrame:
    """(scope, name, sig, array) of parameters and variables."""
    types = tables["declaration"]
    rows = tables["binding"].withColumn("id", F.xxhash64("file_key", "scope", "name").cast("string")).dropDuplicates(["id"])
    rows = stored(rows.select("id", "scope", "scopes", "name", "type_name", "type_array", "root", "steps", "element"), "bindings")
    direct = rows.join(typed(rows, names, types.where("kind in ('class', 'interface')")), "id").select("id", "scope", "name", "sig", F.col("type_array").alias("array"))
    values = stored(direct, "values")
    while True:
        open_ = rows.where("type_name is null and root is not null").join(values.select("id"), "id", "left_anti")
        found = evaluate(open_, names, values, known, types, parents, returns).where("sig is not null")
        more = rows.select("id", "scope", "name", "element").join(found, "id")
        more = more.where("not element or array").select("id", "scope", "name", "sig", (F.col("array") & ~F.col("element")).alias("array"))
        more = stored(more, "values")
        if more.isEmpty():
            break
        values = stored(values.unionByName(more), "values")
    return values


def external_bindings(tables: dict[str, DataFrame]) -> tuple[DataFrame, DataFrame]:
    """(file_key, local, module, member) of names, and (file_key, local, module) of namespaces, that come from packages."""
    imports = tables["import"].where(x.is_external(F.col("module")) & F.col("target").isNull() & (F.col("import_kind") != "side_effect"))
    default = imports["import_kind"] == "default"
    required = tables["require"].where(x.is_external(F.col("module")))
    named = imports.where("import_kind <> 'namespace'").select("file_key", "local", "module", F.when(~default, F.col("name")).alias("member")).unionByName(required.select("file_key", "local", "module", "member"))
    spaces = imports.where("import_kind <> 'named'").select("file_key", "local", "module").unionByName(required.where("namespace").select("file_key", "local", "module"))
    return named.dropDuplicates(["file_key", "local"]), spaces.dropDuplicates(["file_key", "local"])


def phantoms(sites: DataFrame, tables: dict[str, DataFrame]) -> DataFrame:
    """(id, signature, module, member) of calls into packages, one hop deep."""
    named, spaces = external_bindings(tables)
    first, size = F.get("steps", 0), F.size("steps")
    new = F.col("root") == "new"
    parts = F.split(first["member"], r"\.")
    bare = sites.select("id", "file_key", F.when(new & (size == 1) & (F.size(parts) == 1), first["member"]).when(~new & (size == 1) & (first["member"] == ""), F.col("root")).alias("local"))
    inner = sites.select("id", "file_key", F.when(new & (size == 1) & (F.size(parts) == 2), F.get(parts, 0)).when(~new & (size == 1) & (first["member"] != ""), F.col("root")).alias("local"), F.when(new, F.get(parts, 1)).otherwise(first["member"]).alias("member"))
    a = bare.join(named, ["file_key", "local"]).select("id", "module", F.coalesce("member", "local").alias("member"))
    b = inner.join(spaces, ["file_key", "local"]).select("id", "module", "member")
    direct = sites.where((F.col("root") == "require") & (size == 2) & x.is_external(F.col("required"))).select("id", F.col("required").alias("module"), F.get("steps", 1)["member"].alias("member"))
    return a.unionByName(b).unionByName(direct).dropDuplicates(["id"]).select("id", x.dotted(F.col("module"), F.col("member")).alias("signature"), "module", "member")


def resolve_calls(tables: dict[str, DataFrame], use_phantoms: bool = True) -> Resolved:
    """All of it: callees, call edges with virtual dispatch over instantiated subtypes, external symbols, statistics."""
    types = tables["declaration"]
    names = names_in_scope(tables)
    parents, closed = ancestors(tables, names)
    known = members(tables, names, closed)
    functions = tables["callable"].where("kind in ('function', 'arrow', 'function_expression')")
    reached = typed(functions.join(scopes_of(tables), functions["owner_signature"] == F.col("scope_owner")).select(F.col("signature").alias("id"), "scopes", F.col("return_name").alias("type_name")), names, types.where("kind in ('class', 'interface')"))
    returns = stored(functions.select(F.col("signature").alias("callable"), F.col("return_array").alias("returned_array")).join(reached.select(F.col("id").alias("callable"), F.col("sig").alias("returned")), "callable").dropDuplicates(["callable"]), "returns")
    values = value_types(tables, names, known, parents, returns)
    sites = tables["call_site"].where("is_target and not file_key like '%.d.ts'").withColumn("id", F.concat_ws("|", "caller", F.concat_ws("-", "start_line", "start_column", "end_line", "end_column"))).dropDuplicates(["id"])
    sites = stored(sites, "sites")
    universe = stored(tables["callable"].where("is_target").select(F.col("signature").alias("target")).distinct(), "universe")
    found = evaluate(sites, names, values, known, types, parents, returns)
    inside = stored(found.where("target is not null").join(universe, "target", "left_semi").select("id", "target"), "inside")
    received = found.where("receiver is not null").select("id", F.concat(x.member_of(F.col("receiver")), F.when(F.col("receiver_array"), "[]").otherwise("")).alias("receiver_type"))
    given = tables["callable"].select(F.col("signature").alias("target"), "return_type", "kind", "order")
    given = first_wins(given, ["target"], [F.col("order")]).select("target", F.when(F.col("kind") == "constructor", x.member_of(x.owner_of(F.col("target")))).otherwise(F.col("return_type")).alias("return_type"))
    outside = stored(phantoms(sites.join(inside, "id", "left_anti"), tables) if use_phantoms else inside.where("false").select("id", F.lit("").alias("signature"), F.lit("").alias("module"), F.lit("").alias("member")), "outside")
    done = sites.join(inside, "id", "left").join(given, "target", "left").join(received, "id", "left").join(outside, "id", "left").withColumn("callee_signature", F.coalesce("target", "signature"))
    done = done.withColumn("return_type", F.when(F.col("return_type") == "this", F.col("receiver_type")).otherwise(F.col("return_type")))
    done = stored(done.withColumn("is_external", F.col("target").isNull() & F.col("signature").isNotNull()), "resolved-sites")
    created = typed(tables["new_expr"].withColumn("id", F.concat_ws("|", "file_key", "start_line", "start_column")), names, types.where("kind = 'class'")).select(F.col("sig").alias("type"))
    created = created.unionByName(done.where("is_constructor_call and target is not null").select(x.without_constructor(F.col("target")).alias("type"))).distinct()
    virtual = done.where("target is not null and receiver_expr is not null and not is_constructor_call").select(x.owner_of(F.col("target")).alias("owner"), x.member_of(F.col("target")).alias("member"), "caller", F.col("target").alias("direct"), "order")
    groups = virtual.where("member <> 'constructor'").groupBy("caller", "owner", "member", "direct").agg(F.count("*").alias("weight"), F.min("order").alias("order"))
    groups = stored(groups, "virtual-groups")  # calls of one method by one caller go through dispatch together
    methods = tables["callable"].where("owner_kind = 'class' and kind = 'method'").select(F.col("owner_signature").alias("owner"), F.col("name").alias("member"))
    over = dispatch(groups, parents.where("from_class").select("child", "parent"), methods, created, types.where("kind = 'class' and is_abstract").select(F.col("signature").alias("type")))
    over = over.join(universe, "target", "left_semi")
    over = stored(groups.join(over, ["owner", "member"]).where("target <> direct").select("caller", "target", "order", "weight"), "overrides")
    tags = lambda *kv: F.create_map(*[F.lit(v) if isinstance(v, str) else v for v in kv]).cast("map<string,string>")
    none = F.create_map().cast("map<string,string>")
    exact = done.where("target is not null").select(F.col("caller").alias("source"), "target", F.col("order").alias("ordinal"), none.alias("tags"), F.lit(1).cast("long").alias("weight"))
    dispatched = over.select(F.col("caller").alias("source"), "target", F.col("order").alias("ordinal"), tags("ts.dispatch", "rta").alias("tags"), "weight")
    away = done.where("is_external").select(F.col("caller").alias("source"), F.col("signature").alias("target"), F.col("order").alias("ordinal"), tags("ts.external", "true", "ts.module", F.col("module")).alias("tags"))
    edges = stored(call_edges(exact.unionByName(dispatched), "tsc").unionByName(call_edges(away, "import")), "edges")
    external = outside.select("signature", F.col("member").alias("name"), "module").dropDuplicates(["signature"])
    stats = done.agg(F.count_if(F.col("target").isNotNull()).alias("resolved"), F.count_if(F.col("is_external")).alias("phantom"), F.count_if(F.col("callee_signature").isNull()).alias("unresolved"))
    stats = stats.crossJoin(over.agg(F.coalesce(F.sum("weight"), F.lit(0)).alias("rta"))).crossJoin(edges.agg(F.count("*").alias("unique_edges"), F.coalesce(F.sum("weight"), F.lit(0)).alias("weight")))
    return Resolved(done.drop("target", "signature", "member"), edges, external, stats, parents)


def scopes_of(tables: dict[str, DataFrame]) -> DataFrame:
    """(scope_owner, scopes) from the module to each declaration, callable and module."""
    modules = tables["module"].select(F.col("module_name").alias("scope_owner"), F.array("module_name").alias("scopes"))
    types = tables["declaration"].select(F.col("signature").alias("scope_owner"), F.concat("scopes", F.array("signature")).alias("scopes"))
    bound = tables["binding"].select(F.col("scope").alias("scope_owner"), "scopes")
    return modules.unionByName(types).unionByName(bound).dropDuplicates(["scope_owner"])
