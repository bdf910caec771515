"""Snapshots: what a run rewrites, writers that meet, folders of other formats, and what is deleted."""

import json
import threading
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from callweave.sources import snapshot

NODES = "app_name string, labels array<string>, key_prop string, value string, props string, _module string"
EDGES = "app_name string, type string, from_label string, from_key string, to_label string, to_key string, props string, owner_module string"


def graph(spark, app, modules, calls=()):
    """Modules (name → content), each with a function; calls (module, module) from function to function."""
    nodes = [(app, ["Application"], "name", app, "{}", None), (app, ["Package"], "name", "zlib", '{"name":"zlib"}', None)]
    edges = [(app, "CALLS", "Callable", f"{a}.f", "Callable", f"{b}.f", "{}", a) for a, b in calls]
    for m, text in modules.items():
        nodes += [(app, ["Module"], "file_key", m, json.dumps({"content_hash": text}), m), (app, ["Callable"], "signature", f"{m}.f", json.dumps({"code": text}), m)]
        edges += [(app, "HAS_MODULE", "Application", app, "Module", m, "{}", None), (app, "DECLARES", "Module", m, "Callable", f"{m}.f", "{}", m)]
    return spark.createDataFrame(nodes, NODES), spark.createDataFrame(edges, EDGES)


def state(spark, path):
    nodes, edges = snapshot.load_snapshot(spark, path)
    return sorted((r.app_name, r.value, r.props) for r in nodes.collect()), sorted((r.app_name, r.type, r.from_key, r.to_key) for r in edges.collect())


def test_one_changed_module_rewrites_its_bucket(spark, tmp_path):
    path, modules = str(tmp_path), {f"m{k}.ts": "a" for k in range(200)}
    calls = [("m1.ts", "m2.ts"), ("m3.ts", "m2.ts")]
    snapshot.apply_incremental(spark, path, *graph(spark, "app", modules, calls))
    before = state(spark, path)
    assert len(before[0]) == 402 and len(before[1]) == 402
    changed = graph(spark, "app", modules | {"m2.ts": "b"}, calls)
    states = snapshot.apply_incremental(spark, path, *changed)
    assert {r.file_key for r in states.where("state = 'changed'").collect()} == {"m2.ts"}
    new = snapshot.rewritten(spark, path).where("is_new")
    assert sorted(r.kind for r in new.collect()) == ["edges", "nodes"]
    assert {(v, p) for _, v, p in state(spark, path)[0]} - {(v, p) for _, v, p in before[0]} == {("m2.ts", '{"content_hash": "b"}'), ("m2.ts.f", '{"code": "b"}')}
    snapshot.apply_incremental(spark, path, *changed)
    assert snapshot.rewritten(spark, path).where("is_new").count() == 0
    gone = {k: v for k, v in modules.items() if k != "m2.ts"}
    snapshot.apply_incremental(spark, path, *graph(spark, "app", gone, []), full_run=False)
    assert ("app", "CALLS", "m1.ts.f", "m2.ts.f") in state(spark, path)[1]
    snapshot.apply_incremental(spark, path, *graph(spark, "app", gone, calls))
    nodes, edges = state(spark, path)
    assert len(nodes) == 400 and not [e for e in edges if "m2.ts" in e[2] + e[3]] and len(edges) == 398
    assert len(snapshot.versions(spark, path)) == 2


def test_shared_nodes_are_patched(spark, tmp_path):
    path = str(tmp_path)
    nodes, edges = graph(spark, "app", {"a.ts": "1"})
    snapshot.apply_incremental(spark, path, nodes, edges)
    more = nodes.withColumn("props", F.when(F.col("value") == "zlib", '{"version":"9"}').otherwise(F.col("props")))
    snapshot.apply_incremental(spark, path, more, edges)
    assert json.loads(next(p for _, v, p in state(spark, path)[0] if v == "zlib")) == {"name": "zlib", "version": "9"}
    assert [(r.kind, r.bucket >= snapshot.BUCKETS) for r in snapshot.rewritten(spark, path).where("is_new").collect()] == [("nodes", True)]


def test_writers_of_two_applications_meet(spark, tmp_path, monkeypatch):
    """Both plan from the same version; the second commits on top of the first."""
    path = str(tmp_path)
    snapshot.apply_incremental(spark, path, *graph(spark, "old", {"a.ts": "1"}))
    ready, plain = threading.Barrier(2, timeout=120), snapshot.plan

    def together(*args):
        out = plain(*args)
        ready.wait()
        return out

    monkeypatch.setattr(snapshot, "plan", together)
    failed = []

    def run(app):
        try:
            snapshot.apply_incremental(spark, path, *graph(spark, app, {"b.ts": app}))
        except Exception as error:  # noqa: BLE001
            failed.append(error)

    threads = [threading.Thread(target=run, args=(app,)) for app in ("one", "two")]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert not failed and {a for a, _, _ in state(spark, path)[0]} == {"old", "one", "two"}


def test_a_writer_of_the_same_application_starts_again(spark, tmp_path, monkeypatch):
    path, plain, first = str(tmp_path), snapshot.plan, []
    snapshot.apply_incremental(spark, path, *graph(spark, "app", {"a.ts": "1"}))

    def interrupted(*args):
        out = plain(*args)
        if not first:
            first.append(1)
            snapshot.apply_incremental(spark, path, *graph(spark, "app", {"a.ts": "2", "b.ts": "1"}))
        return out

    monkeypatch.setattr(snapshot, "plan", interrupted)
    states = snapshot.apply_incremental(spark, path, *graph(spark, "app", {"a.ts": "3"}))
    assert {(r.file_key, r.state) for r in states.collect()} == {("a.ts", "changed"), ("b.ts", "removed")}
    assert [(v, p) for _, v, p in state(spark, path)[0] if v.endswith(".ts")] == [("a.ts", '{"content_hash": "3"}')]


def test_other_formats_are_refused(spark, tmp_path):
    (tmp_path / "v000000000001/complete").mkdir(parents=True)
    with pytest.raises(ValueError, match="format"):
        snapshot.apply_incremental(spark, str(tmp_path), *graph(spark, "app", {"a.ts": "1"}))
    other = tmp_path / "other"
    (other / "_log").mkdir(parents=True)
    (other / "_log/000000000007").write_text(json.dumps({"format": "9", "name": "v000000000001"}))
    with pytest.raises(ValueError, match="format 9"):
        snapshot.load_snapshot(spark, str(other))
    assert snapshot.load_snapshot(spark, str(tmp_path / "none")) is None


def test_old_folders_are_merged_and_deleted(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(snapshot, "FOLDERS", 2)
    path, modules = str(tmp_path), {f"m{k}.ts": "0" for k in range(6)}
    for k in range(5):
        modules[f"m{k}.ts"] = str(k + 1)
        snapshot.apply_incremental(spark, path, *graph(spark, "app", modules))
    assert {v: json.loads(p)["content_hash"] for _, v, p in state(spark, path)[0] if v.endswith(".ts")} == modules
    assert len(set(snapshot.head(spark, path).units.values())) <= 3
    assert len([p for p in Path(path).iterdir() if p.name.startswith("v")]) <= 5
