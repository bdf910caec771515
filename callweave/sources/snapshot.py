"""Snapshots of the graph: bucketed tables, copied on write, committed by an optimistic log.

Rows of a module lie in one bucket of their application, by a digest of the module's name; rows that modules share lie in
buckets of their own, by their keys. A version is a folder with the buckets that its run rewrote, and a manifest that tells for
every bucket which folder holds it; buckets that nothing changed stay where they are. The log has one entry a commit, each a
file that is created only if absent, so of two writers that start from the same entry one wins. The other reads what has
been committed meanwhile: if that touched other applications alone, it commits its buckets on top, else it starts again.

Readers take the last entry, so a run that fails leaves the snapshot as it was. The last two versions stay readable; folders
that no manifest of theirs names any more are deleted, and buckets of the oldest folders are rewritten along the way when a
manifest names more than ``FOLDERS``.
"""

from __future__ import annotations

import json
import re
import time
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from callweave.operators.incremental import module_diff, patch
from callweave.sources.storage import create_new, delete_path, exists, names_in, read_small, stored

SNAPSHOT_VERSION = "2.0.0"
BUCKETS = 64
FOLDERS = 16
NODES = "app_name string, labels array<string>, key_prop string, value string, props string, _module string, bucket int"
EDGES = "app_name string, type string, from_label string, from_key string, to_label string, to_key string, props string, owner_module string, bucket int"
UNITS = "kind string, app_name string, bucket int, folder string"


@dataclass
class Version:
    """A committed version: its number in the log, its name, and (kind, application, bucket) → folder."""

    number: int
    name: str
    units: dict[tuple[str, str, int], str]

    @property
    def folders(self) -> list[str]:
        return sorted({self.name, *self.units.values()})


def bucket_of(app: Column, module: Column, key: Column) -> Column:
    """Buckets from 0 for modules, from ``BUCKETS`` for rows that modules share."""
    number = F.conv(F.substring(F.md5(F.concat_ws("|", app, F.coalesce(module, key))), 1, 8), 16, 10).cast("long") % BUCKETS
    return (number + F.when(module.isNull(), BUCKETS).otherwise(0)).cast("int")


def log_entries(spark: SparkSession, path: str) -> list[int]:
    return sorted(int(n) for n in names_in(spark, f"{path}/_log") if re.fullmatch(r"\d{12}", n))


def entry(spark: SparkSession, path: str, number: int) -> dict:
    """What a log entry says. One that is just being written is waited for."""
    for _ in range(50):
        if text := read_small(spark, f"{path}/_log/{number:012d}"):
            return json.loads(text)
        time.sleep(0.1)
    raise RuntimeError(f"log entry {number} of {path} stays empty")


def versions(spark: SparkSession, path: str) -> list[str]:
    """The names of the versions that can be read, the oldest first."""
    return [entry(spark, path, n)["name"] for n in log_entries(spark, path)]


def version(spark: SparkSession, path: str, number: int) -> Version:
    said = entry(spark, path, number)
    if said.get("format") != SNAPSHOT_VERSION:
        raise ValueError(f"{path} is a snapshot of format {said.get('format')}, not {SNAPSHOT_VERSION}")
    rows = spark.read.schema(UNITS).json(f"{path}/{said['name']}/manifest").collect()  # a row for each bucket of an application
    return Version(number, said["name"], {(r["kind"], r["app_name"], r["bucket"]): r["folder"] for r in rows})


def head(spark: SparkSession, path: str) -> Version | None:
    """The last version; None if there is none. A snapshot of another format is refused, not taken for none."""
    if numbers := log_entries(spark, path):
        return version(spark, path, numbers[-1])
    if any(exists(spark, f"{path}/{n}/complete") for n in names_in(spark, path) if re.fullmatch(r"v\d{12}", n)):
        raise ValueError(f"{path} is a snapshot of another format than {SNAPSHOT_VERSION}")
    return None


def table_of(spark: SparkSession, path: str, state: Version | None, kind: str) -> DataFrame:
    """The rows of one kind with their buckets. The manifest's rows for a folder select its partitions."""
    schema = NODES if kind == "nodes" else EDGES
    out = spark.createDataFrame([], schema)
    for folder in state.folders if state else []:
        units = [(a, b) for (k, a, b), f in state.units.items() if k == kind and f == folder]
        rows = spark.read.schema(schema).parquet(f"{path}/{folder}/{kind}")
        out = out.unionByName(rows.join(F.broadcast(spark.createDataFrame(units, "app_name string, bucket int")), ["app_name", "bucket"], "left_semi"))
    return out


def load_snapshot(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame] | None:
    """(nodes, edges) of the last version; None if there is none."""
    state = head(spark, path)
    return None if state is None else tuple(table_of(spark, path, state, k).drop("bucket") for k in ("nodes", "edges"))


def changes(old: DataFrame, nodes: DataFrame) -> DataFrame:
    """(app_name, file_key, state) of the modules, by content hash."""
    hashed = lambda n: n.where(F.array_contains("labels", "Module")).select("app_name", F.col("value").alias("file_key"), F.get_json_object("props", "$.content_hash").alias("hash"))
    return module_diff(hashed(nodes), hashed(old), ["app_name", "file_key"], "hash", "hash")


@dataclass
class Rewrite:
    """What a run changes: the states of modules, the buckets it rewrites, and all rows that these hold then."""

    states: DataFrame
    units: set[tuple[str, str, int]]
    nodes: DataFrame
    edges: DataFrame


def plan(spark: SparkSession, path: str, state: Version | None, nodes: DataFrame, edges: DataFrame, full_run: bool) -> Rewrite:
    """Modules that changed are replaced with their nodes and the edges that start there; others keep theirs. Shared nodes are
    patched and never removed. Modules that vanished go on a full run alone. Edges whose ends are gone go. Every key holds the
    application's name, so other applications stay."""
    nodes = nodes.withColumn("bucket", bucket_of(F.col("app_name"), F.col("_module"), F.col("value")))
    edges = edges.withColumn("bucket", bucket_of(F.col("app_name"), F.col("owner_module"), F.concat_ws(">", "from_key", "to_key")))
    apps = nodes.select("app_name").distinct()
    old_nodes, old_edges = (table_of(spark, path, state, k).join(F.broadcast(apps), "app_name", "left_semi") for k in ("nodes", "edges"))
    every = table_of(spark, path, state, "nodes").where(F.array_contains("labels", "Module"))
    states = stored(changes(every, nodes), "changes")
    moved = states.where("state in ('added', 'changed')").select("app_name", F.col("file_key").alias("m"))
    gone = states.join(apps, "app_name", "left_semi").where("state = 'removed'").select("app_name", F.col("file_key").alias("m"))
    out = stored(moved.unionByName(gone) if full_run else moved, "replaced")
    in_out = lambda rows, c, how: rows.withColumn("m", F.col(c)).join(out, ["app_name", "m"], how).drop("m")
    in_moved = lambda rows, c: rows.withColumn("m", F.col(c)).join(moved, ["app_name", "m"], "left_semi").drop("m")
    node_columns, edge_columns = nodes.columns, edges.columns

    owned = old_nodes.where("_module is not null")
    fresh = in_moved(nodes, "_module")
    both = old_nodes.where("_module is null").alias("o").join(nodes.where("_module is null").alias("n"), ["app_name", "labels", "key_prop", "value", "bucket"], "full_outer")
    kinds = "map<string,string>"
    merged = F.when(F.col("n.props").isNull(), F.col("o.props")).when(F.col("o.props").isNull() | (F.col("o.props") == F.col("n.props")), F.col("n.props"))
    merged = F.coalesce(merged, F.to_json(patch(F.from_json("o.props", kinds), F.from_json("n.props", kinds))))
    shared = both.select("app_name", "labels", "key_prop", "value", merged.alias("props"), F.lit(None).cast("string").alias("_module"), "bucket", (~F.col("o.props").eqNullSafe(merged)).alias("differs"))
    shared = stored(shared, "shared-nodes")
    final = in_out(owned, "_module", "left_anti").select(node_columns).unionByName(fresh.select(node_columns)).unionByName(shared.select(node_columns))

    key = lambda rows, side="": rows.select("app_name", F.element_at("labels", 1).alias(f"{side}label"), F.col("value").alias(f"{side}key"))
    keys = stored(key(final), "keys")
    lost = stored(key(in_out(owned, "_module", "left_semi")).join(keys, ["app_name", "label", "key"], "left_anti").distinct(), "lost-keys")
    ends = ["app_name", "type", "from_label", "from_key", "to_label", "to_key"]
    given = edges.where("owner_module is null").unionByName(in_moved(edges, "owner_module").select(edge_columns))
    kept = in_out(old_edges.where("owner_module is not null"), "owner_module", "left_anti").select(edge_columns)
    kept = kept.unionByName(old_edges.where("owner_module is null").join(edges.where("owner_module is null"), ends, "left_anti").select(edge_columns))
    for side in ("from", "to"):
        named = lambda rows: rows.withColumnsRenamed({"label": f"{side}_label", "key": f"{side}_key"})  # noqa: B023, E731
        given = given.join(named(keys), ["app_name", f"{side}_label", f"{side}_key"], "left_semi")
        kept = kept.join(named(lost), ["app_name", f"{side}_label", f"{side}_key"], "left_anti")
    hit = lambda side: old_edges.join(lost.withColumnsRenamed({"label": f"{side}_label", "key": f"{side}_key"}), ["app_name", f"{side}_label", f"{side}_key"], "left_semi").select(edge_columns)
    cut = hit("from").unionByName(hit("to"))
    given = stored(given.select(edge_columns), "given-edges")
    same = old_edges.where("owner_module is null").select(*ends, "props").intersect(given.where("owner_module is null").select(*ends, "props"))
    odd = given.where("owner_module is null").select(*ends, "props", "bucket").join(same, [*ends, "props"], "left_anti")

    modules = out.select("app_name", bucket_of(F.col("app_name"), F.col("m"), F.col("m")).alias("bucket"))
    touched = [modules.select(F.lit(k).alias("kind"), "app_name", "bucket") for k in ("nodes", "edges")]
    touched.append(shared.where("differs").select(F.lit("nodes").alias("kind"), "app_name", "bucket"))
    touched += [rows.select(F.lit("edges").alias("kind"), "app_name", "bucket") for rows in (cut, odd)]
    found = touched[0]
    for rows in touched[1:]:
        found = found.unionByName(rows)
    units = {(r["kind"], r["app_name"], r["bucket"]) for r in found.distinct().collect()}  # buckets of the applications given
    old = {u: f for u, f in state.units.items()} if state else {}
    mine = {r[0] for r in apps.collect()}
    for folder in sorted(set(old.values()))[:-FOLDERS]:
        units |= {u for u, f in old.items() if f == folder and u[1] in mine}
    chosen = lambda rows, k: rows.join(F.broadcast(spark.createDataFrame([u[1:] for u in units if u[0] == k], "app_name string, bucket int")), ["app_name", "bucket"], "left_semi")
    return Rewrite(states, units, chosen(final, "nodes").select(node_columns), chosen(kept.select(edge_columns).unionByName(given), "edges").select(edge_columns))


def reserved(spark: SparkSession, path: str) -> str:
    """The name of a version's folder that no other writer has."""
    number = max([int(n[1:]) for n in names_in(spark, path) if re.fullmatch(r"v\d{12}", n)], default=0) + 1
    while not create_new(spark, f"{path}/v{number:012d}/writer", "reserved"):
        number += 1
    return f"v{number:012d}"


def committed(spark: SparkSession, path: str, name: str, base: Version | None, written: dict[tuple[str, str, int], str], touched: set[tuple[str, str, int]]) -> bool:
    """Adds the version to the log. False if another writer has touched the same applications since ``base``."""
    mine = {u[1] for u in touched}
    while True:
        last = head(spark, path)
        was, now = (base.units if base else {}), (last.units if last else {})
        if {u[1] for u in was.keys() | now.keys() if was.get(u) != now.get(u)} & mine:
            return False
        units = {u: f for u, f in now.items() if u not in touched} | written
        rows = [(k, a, b, f) for (k, a, b), f in sorted(units.items())]
        spark.createDataFrame(rows, UNITS).coalesce(1).write.mode("overwrite").json(f"{path}/{name}/manifest")
        number = (last.number if last else 0) + 1
        if create_new(spark, f"{path}/_log/{number:012d}", json.dumps({"format": SNAPSHOT_VERSION, "name": name})):
            return True


def apply_incremental(spark: SparkSession, path: str, nodes: DataFrame, edges: DataFrame, full_run: bool = True) -> DataFrame:
    """Commits the next version and returns the modules' states (app_name, file_key, state)."""
    while True:
        base = head(spark, path)
        made = plan(spark, path, base, nodes, edges, full_run)
        name = reserved(spark, path)
        written = {}
        for kind, rows in (("nodes", made.nodes), ("edges", made.edges)):
            target = f"{path}/{name}/{kind}"
            rows.repartition("app_name", "bucket").write.partitionBy("app_name", "bucket").parquet(target)
            schema = NODES if kind == "nodes" else EDGES
            held = spark.read.schema(schema).parquet(target).select("app_name", "bucket").distinct().collect()
            written |= {(kind, r["app_name"], r["bucket"]): name for r in held}
        if committed(spark, path, name, base, written, made.units):
            break
        delete_path(spark, f"{path}/{name}")
    clean(spark, path)
    return made.states


def clean(spark: SparkSession, path: str, keep: int = 2) -> None:
    """Drops all log entries but the last ``keep``, and the folders of committed versions that none of those names. Folders
    of runs that have not committed are left alone."""
    numbers = log_entries(spark, path)
    old = [entry(spark, path, n)["name"] for n in numbers[:-keep]]
    needed = {f for n in numbers[-keep:] for f in version(spark, path, n).folders}
    for n, name in zip(numbers[:-keep], old):
        delete_path(spark, f"{path}/{name}/manifest")
        create_new(spark, f"{path}/{name}/retired", "")
        delete_path(spark, f"{path}/_log/{n:012d}")
    for name in names_in(spark, path):
        if re.fullmatch(r"v\d{12}", name) and name not in needed and exists(spark, f"{path}/{name}/retired"):
            delete_path(spark, f"{path}/{name}")


def rewritten(spark: SparkSession, path: str) -> DataFrame:
    """(kind, app_name, bucket, folder, is_new) of the buckets of the last version: is_new if its own run wrote them."""
    state = head(spark, path)
    rows = [(k, a, b, f, f == state.name) for (k, a, b), f in sorted(state.units.items())] if state else []
    return spark.createDataFrame(rows, UNITS + ", is_new boolean")
