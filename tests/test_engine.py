"""The project below tests/project from source text to graph, against numbers found by hand."""

import json
import re
import shutil

import pytest
from pyspark.sql import functions as F

from callweave.__main__ import main, options
from callweave.plans import contract, providers
from callweave.plans.engine import Options, analyze
from callweave.plans.project import check_conformance, project_graph
from callweave.plans.providers import Context, FlowProvider, choose, compare
from callweave.sources import scan, sinks
from callweave.streaming.watch import STATE, tree_changes, watch
from tests.conftest import ROOT

PROJECT = f"{ROOT}/tests/project"
TARGETS = {
    "src/field/plan.Plan.run": {"src/field/plan.Plan.all": 1, "src/field/valve.Tap.open": 2, "src/field/valve.Dripper.open": 2, "src/field/valve.Sprinkler.open": 2},
    "src/field/plan.Plan.size": {"src/field/plan.Plan.all": 1},
    "src/field/plan.drip": {"src/field/valve.Dripper.constructor": 1, "src/field/valve.Sprinkler.constructor": 1, "src/kit/queue.Queue.push": 2},
    "src/field/plan.plans.load": {"node:fs.readFileSync": 1, "src/field/plan.plans.make": 1},
    "src/field/plan.plans.make": {"src/field/valve.Sprinkler.constructor": 1},
    "src/field/valve.Dripper.open": {"src/kit/units.litres": 1},
    "src/field/valve.Sprinkler.open": {"src/kit/units.clampTo": 1, "src/kit/units.litres": 1},
    "src/field/valve.Valve.report": {"src/field/valve.Valve.open": 1, "src/field/valve.Dripper.open": 1, "src/field/valve.Sprinkler.open": 1},
    "src/kit/queue.Queue.push": {"src/kit/queue.Queue.grow": 1, "src/kit/queue.WideQueue.grow": 1},
    "src/main.day": {"node:crypto.randomInt": 1, "src/field/plan.Plan.run": 2, "src/field/plan.drip": 1, "src/field/plan.plans.load": 1, "src/field/plan.plans.make": 1, "src/kit/units.litres": 1},
    "src/main.night": {"src/field/plan.Plan.run": 1},
}
EDGES = sum(map(len, TARGETS.values()))


@pytest.fixture(scope="module")
def run(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("app")
    shutil.copytree(PROJECT, root / "demo")
    return analyze(spark, Options(str(root / "demo"), provider="tsc", emit="neo4j", snapshot=str(root / "snapshot"))), root


def test_tables(run):
    t = run[0].tables
    counts = {k: t[k].count() for k in ("module", "callable", "attribute", "variable", "import", "export", "call_site", "error")}
    assert counts == {"module": 6, "callable": 28, "attribute": 6, "variable": 9, "import": 17, "export": 4, "call_site": 32, "error": 0}
    assert t["callable"].agg(F.sum("cyclomatic_complexity"), F.count_if("is_implicit"), F.sum(F.size("overloads"))).first()[:] == (27, 5, 4)
    assert {r[0]: r[1] for r in t["declaration"].groupBy("kind").count().collect()} == {"class": 7, "interface": 1, "enum": 1, "namespace": 1}


def test_overloads_belong_to_their_implementation(run):
    rows = {r.signature: r for r in run[0].tables["callable"].where("size(overloads) > 0").collect()}
    assert {k: [(len(o.parameters), o.return_type, o.start_line) for o in r.overloads] for k, r in rows.items()} == {
        "src/kit/queue.Queue.take": [(0, "T | undefined", 20), (1, "T[]", 21)],
        "src/kit/units.clampTo": [(1, "number", 12), (2, "number", 13)],
    }
    assert all(r.has_body for r in rows.values())


def test_enum_constants_are_evaluated(run):
    [r] = run[0].tables["declaration"].where("kind = 'enum'").collect()
    assert [(m.name, m.value) for m in r.members] == [("None", "0"), ("Slow", "2"), ("Fast", "4"), ("Any", "6"), ("Next", "7"), ("Label", "l/min")]


def test_constant_expressions():
    from callweave.sources.declarations import Parser

    text = "enum E { A = -1, B, C = ~5 & 0xF, D = (1 + 2) * 3 ** 2, F = 7 / 2, G = 1 >>> 0, H = -8 >> 1, I = `x` + 1, J = E.D % 4, K = unknown(), L, M = 2 ** 3 ** 0 - 1 }"
    [(_, row)] = [r for r in Parser("e.ts", text).run() if r[0] == "declaration"]
    assert {m["name"]: m["value"] for m in row["members"]} == {
        "A": "-1", "B": "0", "C": "10", "D": "27", "F": "3.5", "G": "1", "H": "-4", "I": "x1", "J": "3", "K": "unknown()", "L": None, "M": "1",
    }


def test_comments_that_lead_statements(run):
    got = {r.file_key: [(c.content, c.start_line, c.is_docstring) for c in r.comments] for r in run[0].tables["module"].where("size(comments) > 0").collect()}
    assert got == {
        "src/kit/queue.ts": [("// A queue of readings, oldest first.", 1, False), ("/* kept small: see grow() */", 4, False)],
        "src/main.ts": [("/** Runs one day. */", 5, True)],
    }


def test_aliases_lead_to_modules(run, spark, tmp_path):
    assert {(r.module, r.target) for r in run[0].tables["import"].where("module like '@%'").collect()} == {("@kit", "src/kit/index"), ("@kit/index", "src/kit/index"), ("@kit/units", "src/kit/units")}
    (tmp_path / "base.json").write_text('{"compilerOptions": {"baseUrl": "lib", "paths": {"x/*": ["gone/*", "y/*/z"]}}}')
    (tmp_path / "tsconfig.build.json").write_text('{"extends": "./base", /* none */ "compilerOptions": {},}')
    config = scan.project_config(spark, str(tmp_path))
    assert (config.base, config.paths) == ("lib", {"x/*": ["lib/gone/*", "lib/y/*/z"]})
    imports = spark.createDataFrame([("a.ts", m, None) for m in ("x/q", "plain", "folder", "react", "./near")], "file_key string, module string, target string")
    modules = spark.createDataFrame([("lib/y/q/z",), ("lib/plain",), ("lib/folder/index",)], "module_name string")
    tables = scan.resolve_aliases({"import": imports, "export": imports.limit(0), "module": modules}, config)
    assert {r.module: r.target for r in tables["import"].collect()} == {"x/q": "lib/y/q/z", "plain": "lib/plain", "folder": "lib/folder/index", "react": None, "./near": None}
    assert scan.project_config(spark, str(tmp_path / "none")) == scan.ProjectConfig()


def test_edges(run):
    rows = run[0].graph.edges.collect()
    assert {(r.source, r.target): r.weight for r in rows} == {(s, t): w for s, many in TARGETS.items() for t, w in many.items()}
    virtual = {(r.source.split(".")[-1], r.target) for r in rows if r.tags.get("ts.dispatch") == "rta"}
    valves = {"src/field/valve.Dripper.open", "src/field/valve.Sprinkler.open"}
    assert virtual == {(s, t) for s in ("run", "report") for t in valves} | {("push", "src/kit/queue.WideQueue.grow")}
    assert {r.tags["ts.module"] for r in rows if r.provenance == ["import"]} == {"node:crypto", "node:fs"}
    s = run[0].graph.resolved.stats.first()
    assert (s.resolved, s.rta, s.phantom, s.unresolved, s.unique_edges, s.weight) == (22, 7, 2, 8, 26, 31)


def test_types_of_call_sites(run):
    rows = {(r.caller.split("/")[-1], r.method_name, r.start_column): r for r in run[0].graph.resolved.call_sites.collect()}
    types = {(c, m): (r.receiver_type, r.return_type, r.argument_types) for (c, m, _), r in rows.items()}
    assert types["plan.Plan.size", "all"] == ("Plan", "Tap[]", [])
    assert types["plan.drip", "Dripper"] == (None, "Dripper", ["unknown"])
    assert types["plan.drip", "push"][:2] == ("Queue", "Queue")
    assert types["main.day", "make"] == ("plans", "Plan", ["string"])
    assert types["main.day", "litres"] == (None, "number", ["number", "unknown"])
    assert types["queue.Queue.take", "splice"] == (None, None, ["number", "unknown"])


def test_graph_conforms(run):
    a = run[0]
    assert check_conformance(a.nodes, a.edges).collect() == []
    assert json.loads(contract.as_json())["schema_version"] == contract.VERSION


def test_comparing_a_graph_with_itself_finds_no_difference(run):
    r = compare(run[0].graph, run[0].graph).first()
    assert (r.shared, r.only_left, r.only_right) == (EDGES, 0, 0)


def test_documents_and_statements(run):
    a = run[0]
    docs = {r.file_key: json.loads(r.json) for r in sinks.module_documents(a.tables).collect()}
    assert len(docs) == 6 and len(docs["src/main.ts"]["imports"]) == 6 and docs["src/kit/units.ts"]["module"]["module_name"] == "src/kit/units"
    text = [r.statement for r in sinks.cypher_statements(a.nodes, a.edges, "demo").collect()]
    assert sum(s.startswith("CREATE CONSTRAINT") for s in text) == len(contract.constraints()) and sum("INDEX" in s for s in text) == 3
    few = [r.statement for r in sinks.cypher_statements(a.nodes, a.edges, "demo", size=5).collect()]
    assert sum("MERGE (n:CallSite" in s for s in few) == 7 and sum(s.count("{k: ") for s in few) == a.nodes.count()
    assert any("MERGE (n:Symbol {signature: r.k}) SET n += r.p SET n:Callable;" in s for s in text)


def test_cache_reuses_what_did_not_change(spark, tmp_path, monkeypatch):
    shutil.copytree(PROJECT, tmp_path / "demo")
    seen = []
    monkeypatch.setattr(scan, "parsed", lambda files, f=scan.parsed: seen.append(sorted(r[0] for r in files.select("file_key").collect())) or f(files))
    tables = lambda **more: scan.parse_modules(scan.scan_sources(spark, str(tmp_path / "demo")), "demo", str(tmp_path / "cache"), **more)
    rows = lambda t: sorted(str(r) for r in t["callable"].collect())
    first = rows(tables())
    assert rows(tables()) == first and rows(tables(eager=True)) == first
    (tmp_path / "demo/src/main.ts").touch()
    (tmp_path / "demo/src/more.ts").write_text("export function more() { return 1; }")
    again = tables()
    assert len(rows(again)) == len(first) + 1
    assert scan.build_statistics(again).first()[:] == (1, 6, 7)
    assert [len(x) for x in seen] == [6, 0, 6, 1] and seen[3] == ["src/more.ts"]
    spark.createDataFrame([("0",)], "v string").write.mode("overwrite").text(str(tmp_path / "cache/version"))
    assert scan.load_cache(spark, str(tmp_path / "cache")) is None


def test_targets_alone_make_nodes(spark, run):
    root = str(run[1] / "demo")
    a = analyze(spark, Options(root, targets=["src/field/plan.ts", "src/none.ts"], provider="tsc", emit="neo4j"))
    assert {r.value for r in a.nodes.where("labels[0] = 'Module'").collect()} == {"src/field/plan.ts"}
    assert {r.source.split(".")[0] for r in a.graph.edges.collect()} == {"src/field/plan"}


def test_flow_results(spark, run, monkeypatch):
    """Functions are found by their places, named arrows too; calls into libraries are named by the call, what libraries call
    is kept, what lies beyond the border is dropped."""
    a, root = run
    flow = {
        "files": ["src/field/plan.ts", "src/kit/units.ts", "node_modules/@x/lib/deep/a.js", "node_modules/b/i.js", "src/main.ts"],
        "functions": {
            "0": "0:39:8:41:2", "1": "1:10:23:10:78", "2": "2:3:4:9:1", "3": "3:1:1:2:1", "4": "9:1:1:1:1", "5": "1:900:1:901:1",
            "6": "4:6:8:12:2", "7": "4:11:22:11:41", "8": "1:14:8:16:2",
        },
        "fun2fun": [[0, 1], [0, 1], [0, 2], [2, 1], [2, 3], [4, 1], [5, 1], [6, 7], [7, 1]],
        "call2fun": [[0, 2], [1, 3], [2, 3], [3, 3], [0, 1]], "calls": {"0": "4:10:26:10:38", "1": "1:15:10:15:30", "2": "3:1:1:1:9", "3": "4:19:1:19:33"},
    }
    (root / "flow.json").write_text(json.dumps(flow))
    monkeypatch.setattr(providers, "resolve_calls", lambda *more: a.graph.resolved)
    g = FlowProvider().build(Context(spark, a.tables, True, str(root / "flow.json")))
    got = {(r.source, r.target): (r.weight, r.tags.get("ts.external"), r.tags.get("ts.module")) for r in g.edges.collect()}
    litres, arrow = "src/kit/units.litres", "src/main.day:<11:22>"
    assert got == {
        ("src/field/plan.drip", litres): (2, None, None), ("@x/lib:deep/a.js:<3:4>", litres): (1, "true", "@x/lib"), ("src/kit/units:<900:1>", litres): (1, None, None),
        ("src/main.day", arrow): (1, None, None), (arrow, litres): (1, None, None),
        ("src/main.day", "node:crypto.randomInt"): (1, "true", "node:crypto"), ("src/kit/units.clampTo", "b:i.js:<1:1>"): (1, "true", "b"),
    }
    assert sorted((r.signature, r.name, r.module) for r in g.external.collect()) == [("@x/lib:deep/a.js:<3:4>", "(anonymous)", "@x/lib"), ("b:i.js:<1:1>", "(anonymous)", "b"), ("node:crypto.randomInt", "randomInt", "node:crypto")]
    assert sorted((r.signature, r.start_line) for r in g.synthesized.collect()) == [("src/kit/units:<900:1>", 900), (arrow, 11)]
    s = g.flow_stats.first().asDict()
    assert s == {"functions": 8, "first_party": 6, "synthesized": 2, "materialized": 2, "external": 3, "edges": 7, "pairs": 9, "dropped": 2, "boundary": 3}
    both = choose("union").build(Context(spark, a.tables, True, str(root / "flow.json")))
    assert both.edges.count() == EDGES + 6  # one of seven is known already
    assert choose("anything").build(Context(spark, a.tables, True, str(root / "missing.json"))).edges.count() == EDGES
    nodes, edges = project_graph(a.tables, a.graph.resolved, "demo", g.synthesized)
    assert {(r.from_label, r.from_key) for r in edges.where("type = 'DECLARES' and to_key like '%:<%'").collect()} == {("Module", "src/kit/units.ts"), ("Symbol", "src/main.day")}
    assert check_conformance(nodes, edges).collect() == []


def test_packages(spark, tmp_path):
    (tmp_path / "package.json").write_text(json.dumps({"dependencies": {"a": "1", "@s/b": "2"}, "devDependencies": {"c": "3"}}))
    declared = scan.declared_packages(spark, str(tmp_path / "package.json"))
    paths = spark.createDataFrame([("node_modules/a/i.js",), ("node_modules/@s/b/i.js",), ("node_modules/@s/d/i.js",), ("node_modules/.bin/x",), ("node_modules/e/i.js",)], "path string")
    assert {r[0] for r in scan.excluded_packages(scan.installed_packages(paths), declared).collect()} == {"@s/d", "e"}
    assert scan.declared_packages(spark, str(tmp_path / "none.json")).count() == 0


def test_a_stream_of_looks_keeps_the_snapshot_current(spark, tmp_path):
    """Added, changed, renamed and deleted files, and a batch that finds nothing."""
    src, checkpoint = tmp_path / "demo/src", tmp_path / "checkpoint"
    src.mkdir(parents=True)
    given = Options(str(tmp_path / "demo"), provider="tsc", snapshot=str(tmp_path / "snapshot"))

    def batch() -> tuple[set, set, set]:
        """What the batch says has changed, and the modules and functions of the snapshot after it."""
        seen = set((checkpoint / "changes").glob("batch=*"))
        watch(spark, given, str(checkpoint)).awaitTermination()
        new = sorted(set((checkpoint / "changes").glob("batch=*")) - seen)
        found = {(r.file_key, r.change) for path in new for r in spark.read.parquet(str(path)).collect()}
        nodes = sinks.load_snapshot(spark, str(tmp_path / "snapshot"))[0]
        keys = lambda label: {r.value for r in nodes.where(F.array_contains("labels", label)).collect()}
        return found, keys("Module"), keys("Callable")

    (src / "more.ts").write_text("export function more() { return 1; }")
    (src / "use.ts").write_text("export function use() { return 2; }")
    found, modules, _ = batch()
    assert found == {("src/more.ts", "added"), ("src/use.ts", "added")} and modules == {"src/more.ts", "src/use.ts"}
    assert batch()[0] == set()
    (src / "more.ts").write_text("export function less() { return 10; }")
    found, _, functions = batch()
    assert found == {("src/more.ts", "changed")} and functions == {"src/more.less", "src/use.use"}
    (src / "use.ts").rename(src / "used.ts")
    (src / "more.ts").unlink()
    found, modules, functions = batch()
    assert found == {("src/more.ts", "deleted"), ("src/use.ts", "deleted"), ("src/used.ts", "added")}
    assert modules == {"src/used.ts"} and functions == {"src/used.use"}


def test_tree_changes(spark):
    rows = lambda *r: spark.createDataFrame(list(r), STATE)
    before, now = rows(("a", 1.0, 5), ("b", 1.0, 5), ("c", 1.0, 5), ("d", 1.0, 5)), rows(("a", 1.0, 5), ("b", 2.0, 5), ("c", 1.0, 6), ("e", 1.0, 5))
    assert {r[:] for r in tree_changes(now, before).collect()} == {("b", "changed"), ("c", "changed"), ("d", "deleted"), ("e", "added")}
    assert {r[:] for r in tree_changes(now, rows()).collect()} == {(k, "added") for k in "abce"} and tree_changes(rows(), rows()).isEmpty()


def test_options():
    got = options(["-i", "x/y", "-t", "a.ts", "b.ts", "--include-tests", "--tsc-only", "--call-graph-provider", "jelly", "--no-phantoms", "-vv"])
    assert (got.name, got.targets, got.skip_tests, got.provider, got.phantoms) == ("y", ["a.ts", "b.ts"], False, "tsc", False)
    assert options(["-i", "x", "--call-graph-provider", "odd"]).provider == "union"
    with pytest.raises(SystemExit):
        options([])
    assert main(["--emit", "schema"]) == 0


def test_incremental(spark, run):
    a, root = run
    path = str(root / "snapshot")
    again = sinks.apply_incremental(spark, path, a.nodes, a.edges)
    assert {r.state for r in again.collect()} == {"unchanged"}
    nodes, edges = sinks.load_snapshot(spark, path)
    assert (nodes.count(), edges.count()) == (a.nodes.count(), a.edges.count())
    less = a.nodes.where("_module is null or _module <> 'src/main.ts'")
    some = a.edges.where("owner_module is null or owner_module <> 'src/main.ts'")
    sinks.apply_incremental(spark, path, less, some, full_run=False)
    assert sinks.load_snapshot(spark, path)[0].where("_module = 'src/main.ts'").count() > 0
    sinks.apply_incremental(spark, path, less, some, full_run=True)
    nodes, edges = sinks.load_snapshot(spark, path)
    assert nodes.where("_module = 'src/main.ts'").count() == 0 and nodes.where("_module is null").count() == a.nodes.where("_module is null").count()
    keys = {r.value for r in nodes.collect()}
    assert all(r.from_key in keys and r.to_key in keys for r in edges.collect())


def test_a_broken_version_leaves_the_snapshot(spark, run, tmp_path):
    """Two applications share a snapshot; an unfinished version is not read, and storage errors are not taken for emptiness."""
    a, path = run[0], str(tmp_path / "shared")
    other = [rows.withColumn("app_name", F.lit("other")) for rows in (a.nodes, a.edges)]
    sinks.apply_incremental(spark, path, a.nodes, a.edges)
    sinks.apply_incremental(spark, path, *other)
    a.nodes.limit(1).write.parquet(f"{path}/v000000000003/nodes")  # stopped before its end
    sinks.apply_incremental(spark, path, *other)
    assert sinks.versions(spark, path) == ["v000000000002", "v000000000004"]
    assert {r[0]: r[1] for r in sinks.load_snapshot(spark, path)[0].groupBy("app_name").count().collect()} == {name: a.nodes.count() for name in ("demo", "other")}
    shutil.rmtree(f"{path}/v000000000004/nodes")
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        sinks.apply_incremental(spark, path, *other)


def test_skipped_directories_are_an_option(spark):
    keys = lambda **more: {r.file_key for r in scan.scan_sources(spark, PROJECT, **more).select("file_key").collect()}
    assert len(keys(skip_tests=False)) == 7 and len(keys()) == 6 and keys(skipped=["kit", "field"]) == {"src/main.ts"}


def test_batches_of_one_key_come_from_many_ranges(spark):
    from callweave.operators.rows import batches

    rows = spark.range(5000).selectExpr("id", "if(id % 10 = 0, 'b', null) as k").repartition(7)
    got = {r.id: (r.k, r.batch) for r in batches(rows, ["k"], [F.col("id")], 300).collect()}
    want = {}
    for key in ("b", None):
        for n, i in enumerate(i for i in range(5000) if (i % 10 == 0) == (key == "b")):
            want[i] = (key, n // 300)
    assert got == want


def test_closure_reaches_the_end_of_a_deep_chain(spark):
    from callweave.operators.closure import fixpoint_closure

    chain = spark.range(103).selectExpr("id as parent", "id + 1 as child")
    assert sorted((r.node, r.depth) for r in fixpoint_closure(chain, spark.range(1).toDF("seed")).collect()) == [(k, k) for k in range(1, 104)]


def test_tables_of_a_program_are_read_alone_and_parsed_by_many_tasks(spark):
    """A table of texts in one file is parsed by more than one task, and a parsed table is read without the others' records."""
    rows = spark.range(40).selectExpr("concat('m', id, '.ts') as path", "concat('export function f', id, '() { return ', id, '; }') as text").coalesce(1)
    files = scan.sources_from_table(rows, "path", "text")
    assert scan.parsed(files).select(F.spark_partition_id()).distinct().count() > 1
    tables = scan.parse_modules(files, "demo")
    assert re.search(r"PartitionFilters: \[[^\]]*_record#\d+ = callable", tables["callable"]._jdf.queryExecution().executedPlan().toString())
    assert {r["signature"] for r in tables["callable"].collect()} == {f"m{k}.f{k}" for k in range(40)} and tables["module"].count() == 40 and tables["attribute"].isEmpty()
