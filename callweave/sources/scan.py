"""Sources: source trees, parsed tables, manifests, installed packages, flow results, snapshots."""

from __future__ import annotations

import json
import logging
import posixpath
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from callweave.functions import text as x
from callweave.sources.storage import exists, names_in, stored

LOG = logging.getLogger("callweave")
CACHE_VERSION = "2.0.0"
SPAN = "start_line int, start_column int, end_line int, end_column int"
DECORATOR = f"struct<name:string,qualified_name:string,positional_arguments:array<string>,keyword_arguments:map<string,string>,{SPAN.replace(' ', ':').replace(',:', ',')}>"
PARAMETER = f"struct<name:string,type:string,default_value:string,is_optional:boolean,is_rest:boolean,is_readonly:boolean,accessibility:string,decorators:array<{DECORATOR}>,{SPAN.replace(' ', ':').replace(',:', ',')}>"
TYPE_PARAMETER = "struct<name:string,constraint:string,default:string>"
OVERLOAD = f"struct<parameters:array<{PARAMETER}>,return_type:string,type_parameters:array<{TYPE_PARAMETER}>,start_line:int,end_line:int>"
STEPS = "array<struct<member:string,called:boolean,element:boolean>>"
#: The tables that a file's records become, by record.
TABLES = {
    "module": "module_name string, is_tsx boolean, is_declaration_file boolean, comments array<struct<content:string,is_docstring:boolean,start_line:int,start_column:int,end_line:int,end_column:int>>",
    "declaration": f"map_key string, signature string, kind string, owner_signature string, scopes array<string>, depth int, name string, code string, docstring string, base_classes array<string>, extends_types array<string>, implements_types array<string>, type_parameters array<{TYPE_PARAMETER}>, members array<struct<name:string,value:string>>, decorators array<{DECORATOR}>, call_signatures array<string>, index_signatures array<string>, aliased_type string, is_const boolean, is_abstract boolean, is_exported boolean, is_ambient boolean, order bigint, {SPAN}",
    "callable": f"map_key string, signature string, name string, kind string, owner_signature string, owner_kind string, depth int, path string, parameters array<{PARAMETER}>, type_parameters array<{TYPE_PARAMETER}>, return_type string, return_name string, return_array boolean, code string, docstring string, decorators array<{DECORATOR}>, code_start_line int, cyclomatic_complexity int, accessibility string, is_static boolean, is_abstract boolean, is_async boolean, is_generator boolean, is_optional boolean, is_readonly boolean, is_exported boolean, is_ambient boolean, is_implicit boolean, accessor_kind string, has_body boolean, overloads array<{OVERLOAD}>, function_line int, function_column int, order bigint, {SPAN}",
    "call_site": f"caller string, scopes array<string>, method_name string, receiver_expr string, argument_texts array<string>, argument_types array<string>, type_arguments array<string>, is_constructor_call boolean, is_optional_chain boolean, root string, steps {STEPS}, required string, order bigint, {SPAN}",
    "new_expr": f"scopes array<string>, type_name string, {SPAN}",
    "attribute": f"owner string, name string, type string, type_name string, type_array boolean, initializer string, accessibility string, is_static boolean, is_readonly boolean, is_optional boolean, is_abstract boolean, decorators array<{DECORATOR}>, {SPAN}",
    "variable": f"owner string, name string, type string, initializer string, value string, scope string, declaration_kind string, is_readonly boolean, is_exported boolean, {SPAN}",
    "import": f"module string, name string, alias string, is_type_only boolean, import_kind string, local string, target string, order bigint, {SPAN}",
    "export": f"module string, name string, alias string, is_type_only boolean, export_kind string, target string, order bigint, {SPAN}",
    "require": "local string, module string, member string, namespace boolean",
    "binding": f"scope string, scopes array<string>, name string, type_name string, type_array boolean, root string, steps {STEPS}, element boolean",
    "default_export": "name string",
    "error": "message string",
}


def scan_sources(spark: SparkSession, root: str, skip_tests: bool = True, targets: list[str] | None = None, skipped: list[str] | None = None) -> DataFrame:
    """(file_key, last_modified, file_size, content, is_target) of the source files below ``root``.

    Vendored directories and further ``skipped`` ones, and tests on request, are left out by path before any content is read. With ``targets`` (paths
    relative to the root or absolute) only those are marked, whatever their extension; missing ones are dropped.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    base = re.sub("^[a-z]+:/*", "/", root.rstrip("/"))
    key = F.regexp_replace(F.regexp_replace("path", "^[a-z]+:/*", "/"), rf"^.*?{re.escape(base)}/", "")
    files = files.select(key.alias("file_key"), (F.unix_micros("modificationTime") / 1000).alias("last_modified"), F.col("length").alias("file_size"), "content")
    path = F.col("file_key")
    kept = x.is_source(path) & ~x.is_vendored(path, skipped)
    if targets is None:
        return files.where(kept & ~x.is_test(path) if skip_tests else kept).withColumn("is_target", F.lit(True))
    wanted = [t[len(root.rstrip("/")) + 1 :] if t.startswith(root.rstrip("/") + "/") else t.removeprefix("./") for t in targets]
    return files.withColumn("is_target", path.isin(wanted)).where(kept | F.col("is_target"))


def sources_from_table(rows: DataFrame, path_col: str, text_col: str) -> DataFrame:
    """The same rows from a table of paths and texts, for corpora that are not a tree of files. They are dealt over tasks by
    their paths: a small file of a table may hold, or expand to, very many texts, and would be parsed by one task."""
    content = F.col(text_col).cast("binary")
    tasks = 4 * rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(tasks, path_col).select(F.col(path_col).alias("file_key"), F.lit(0.0).alias("last_modified"), F.length(content).cast("bigint").alias("file_size"), content.alias("content"), F.lit(True).alias("is_target"))


PARSED = "file_key string, record string, payload string"
META = "file_key string, last_modified double, file_size bigint, content_hash string"


def parsed(files: DataFrame) -> DataFrame:
    """(file_key, record, payload, is_target) of the files' contents; a file that cannot be parsed gives a record ``error``."""
    from callweave.sources.declarations import parse

    schema = pa.schema([("file_key", pa.string()), ("record", pa.string()), ("payload", pa.string()), ("is_target", pa.bool_())])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, content, target in zip(*[c.to_pylist() for c in batch.columns]):
                found = list(parse(key, (content or b"").decode("utf-8-sig", "replace")))
                columns = [[key] * len(found), [r for r, _ in found], [p for _, p in found], [target] * len(found)]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, schema.types)], schema=schema)

    return files.select("file_key", "content", "is_target").mapInArrow(task, f"{PARSED}, is_target boolean")


def load_cache(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame] | None:
    """(meta, parsed) of a cache of parsed files; None if there is none, it is broken, or another version made it."""
    try:
        if [r[0] for r in spark.read.text(f"{path}/version").collect()] != [CACHE_VERSION]:
            return None
        at = f"{path}/{spark.read.text(f'{path}/current').first()[0]}"
        return spark.read.schema(META).parquet(f"{at}/meta"), spark.read.schema(PARSED).parquet(f"{at}/parsed")
    except AnalysisException as error:  # absent or broken: everything is parsed again
        LOG.info("no cache is read: %s", error)
        return None


def unchanged(files: DataFrame, cached: DataFrame) -> DataFrame:
    """(file_key, last_modified, file_size, content_hash) of files that are as they were when cached.

    Time and size decide first, without reading contents; what they leave open is hashed.
    """
    old = cached.select("file_key", F.col("last_modified").alias("t"), F.col("file_size").alias("n"), F.col("content_hash").alias("h"))
    light = files.select("file_key", "last_modified", "file_size").join(old, "file_key")
    as_before = (F.col("t") == F.col("last_modified")) & (F.col("n") == F.col("file_size"))
    same = light.where(as_before).select("file_key", "last_modified", "file_size", F.col("h").alias("content_hash"))
    open_ = light.where(~as_before & (F.col("n") == F.col("file_size"))).select("file_key", "h")
    hashed = files.join(open_, "file_key").where(F.sha2("content", 256) == F.col("h"))
    return same.unionByName(hashed.select("file_key", "last_modified", "file_size", F.col("h").alias("content_hash")))


def parse_modules(files: DataFrame, app_name: str, cache: str | None = None, eager: bool = False) -> dict[str, DataFrame]:
    """The tables of TABLES. With ``cache`` only files that changed are parsed, unless ``eager``; files that are not among
    ``files`` keep their place in the cache. Records are written once, typed and a folder for each table, so that what reads a
    table later neither reads nor parses another's records, nor the files."""
    spark = files.sparkSession
    hashed = lambda rows: rows.select("file_key", "last_modified", "file_size", F.sha2("content", 256).alias("content_hash"))
    state = load_cache(spark, cache) if cache else None
    reused = None
    if state and not eager:
        keep = stored(unchanged(files, state[0]), "unchanged")
        fresh = files.join(keep.select("file_key"), "file_key", "left_anti")
        old = state[1].join(files.select("file_key", "is_target").join(keep.select("file_key"), "file_key", "left_semi"), "file_key")
        rows, meta = old.unionByName(parsed(fresh)), keep.unionByName(hashed(fresh))
        reused = keep.select("file_key", F.lit(True).alias("from_cache"))
    else:
        rows, meta = parsed(files), hashed(files)
    meta = stored(meta, "meta")
    if cache:
        rows = stored(rows, "parsed")
        save_cache(spark, cache, meta, rows.drop("is_target"), state)
    typed = [F.when(F.col("record") == record, F.from_json("payload", ddl)).alias(record) for record, ddl in TABLES.items()]
    rows = stored(rows.select("file_key", "is_target", *typed, F.col("record").alias("_record")), "records", by="_record")
    out = {record: rows.where(F.col("_record") == record).select(F.lit(app_name).alias("app_name"), "file_key", "is_target", f"{record}.*") for record in TABLES}
    modules = out["module"].join(meta, "file_key")
    modules = modules.join(reused, "file_key", "left").fillna(False, ["from_cache"]) if reused is not None else modules.withColumn("from_cache", F.lit(False))
    return out | {"module": stored(modules, "modules")}


def build_statistics(tables: dict[str, DataFrame]) -> DataFrame:
    """One row: how many modules were built, taken from the cache, and are there in all."""
    return tables["module"].agg(F.count_if(~F.col("from_cache")).alias("built"), F.count_if("from_cache").alias("cached"), F.count("*").alias("modules"))


@dataclass
class ProjectConfig:
    """Where specifiers that do not start with a dot may lead: paths below the root, by pattern, and the base folder."""

    base: str | None = None
    paths: dict[str, list[str]] = field(default_factory=dict)


def project_config(spark: SparkSession, root: str) -> ProjectConfig:
    """The configuration at a project's root: tsconfig.json, else the first tsconfig*.json by name, else jsconfig.json, else
    none. Comments and trailing commas are allowed; what it extends by a relative path is read too, its own values win."""
    names = names_in(spark, root)
    name = next((n for n in ["tsconfig.json", *sorted(n for n in names if re.fullmatch(r"tsconfig.*\.json", n)), "jsconfig.json"] if n in names), None)
    found: dict = {}
    seen: set[str] = set()
    while name and name not in seen:
        seen.add(name)
        if not exists(spark, f"{root.rstrip('/')}/{name}"):
            break
        text = spark.read.text(f"{root.rstrip('/')}/{name}", wholetext=True).first()[0]
        try:
            about = json.loads(plain_json(text))
        except ValueError as error:
            LOG.warning("%s is not read: %s", name, error)
            break
        given, folder = about.get("compilerOptions") or {}, posixpath.dirname(name)
        base = posixpath.normpath(posixpath.join(folder, given.get("baseUrl", ".")))
        if "baseUrl" in given:
            found.setdefault("base", base)
        if "paths" in given:
            found.setdefault("paths", {k: [posixpath.normpath(posixpath.join(base, p)) for p in v] for k, v in given["paths"].items()})
        above = about.get("extends")
        name = posixpath.normpath(posixpath.join(folder, above if above.endswith(".json") else f"{above}.json")) if isinstance(above, str) and above.startswith(".") else None
    return ProjectConfig(found.get("base"), found.get("paths", {}))


def plain_json(text: str) -> str:
    """JSON without comments and trailing commas; strings are left as they are."""
    whole = re.compile(r'("(?:[^"\\]|\\.)*")|//[^\n]*|/\*.*?\*/', re.S)
    text = whole.sub(lambda m: m[1] or "", text)
    return re.sub(r'("(?:[^"\\]|\\.)*")|,(?=\s*[}\]])', lambda m: m[1] or "", text)


def resolve_aliases(tables: dict[str, DataFrame], config: ProjectConfig) -> dict[str, DataFrame]:
    """Imports and exports with the module that a path alias leads to as their target.

    The pattern with the longest beginning decides; its paths, then the base folder, are tried in order, and the first that
    is a module, or a folder with an index, is taken. Specifiers that lead nowhere stay packages."""
    if not config.paths and config.base is None:
        return tables
    module = F.col("module")
    tried = F.array().cast("array<string>")
    for pattern in sorted(config.paths, key=lambda p: ("*" not in p, len(p.split("*")[0]))):  # the last one to match wins
        head, star, tail = pattern.partition("*")
        fits = (module.startswith(head) & module.endswith(tail) & (F.length(module) >= len(head) + len(tail))) if star else module == pattern
        middle = F.substring(module, F.lit(len(head) + 1), F.length(module) - len(head) - len(tail))
        one = lambda path: F.concat(*[y for k, part in enumerate(path.split("*")) for y in ([middle] if k else []) + [F.lit(part)]])
        tried = F.when(fits, F.array(*map(one, config.paths[pattern]))).otherwise(tried)
    if config.base is not None:
        tried = F.concat(tried, F.array(module if config.base == "." else F.concat(F.lit(f"{config.base}/"), module)))
    names = tables["module"].select(F.col("module_name").alias("place"), F.col("module_name").alias("to"))
    names = names.unionByName(names.where("place like '%/index'").select(F.regexp_replace("place", "/index$", "").alias("place"), "to")).dropDuplicates(["place"])
    both = tables["import"].select("module", "target").unionByName(tables["export"].select("module", "target"))
    asked = both.where(x.is_external(module) & F.col("target").isNull()).select("module").distinct()
    asked = asked.select("module", F.posexplode(tried).alias("rank", "place")).withColumn("place", x.strip_extension(F.col("place")))
    led = asked.join(names, "place").groupBy("module").agg(F.min_by("to", "rank").alias("led"))
    led = stored(led, "aliases")
    out = dict(tables)
    for name in ("import", "export"):
        out[name] = tables[name].join(led, "module", "left").withColumn("target", F.coalesce("target", "led")).select(tables[name].columns)
    return out


def save_cache(spark: SparkSession, path: str, meta: DataFrame, rows: DataFrame, state: tuple[DataFrame, DataFrame] | None) -> None:
    """Writes the next cache beside the last; a pointer file is replaced at the end. A failure is logged, not raised."""
    try:
        if state:
            gone = [old.join(meta.select("file_key"), "file_key", "left_anti") for old in state]
            meta, rows = meta.unionByName(gone[0].select(meta.columns)), rows.unionByName(gone[1].select(rows.columns))
        name = f"c{uuid.uuid4().hex}"
        meta.write.parquet(f"{path}/{name}/meta")
        rows.write.parquet(f"{path}/{name}/parsed")
        for text, where in ((CACHE_VERSION, "version"), (name, "current")):
            spark.createDataFrame([(text,)], "v string").coalesce(1).write.mode("overwrite").text(f"{path}/{where}")
    except Exception as error:
        LOG.warning("the cache was not written: %s", error)


def declared_packages(spark: SparkSession, manifest: str) -> DataFrame:
    """(package) that a package manifest declares; a manifest that is missing or broken declares none."""
    kinds = ["dependencies", "devDependencies", "peerDependencies", "optionalDependencies"]
    if not exists(spark, manifest):
        return spark.createDataFrame([], "package string")
    rows = spark.read.text(manifest, wholetext=True)
    parsed = rows.select(F.from_json("value", ", ".join(f"{k} map<string,string>" for k in kinds)).alias("m"))
    names = F.concat(*[F.coalesce(F.map_keys(F.col("m")[k]), F.array().cast("array<string>")) for k in kinds])
    return parsed.select(F.explode(names).alias("package")).distinct()


INSTALLED = r"(?:^|/)node_modules/(@[^/]+/[^/]+|[^@./][^/]*)/"  # the package of a path


def installed_packages(paths: DataFrame) -> DataFrame:
    """(package) of a table of file paths below ``node_modules``; names that start with a dot are left out."""
    first = F.regexp_extract("path", INSTALLED, 1)
    return paths.select(first.alias("package")).where("package <> ''").distinct()


def excluded_packages(installed: DataFrame, declared: DataFrame) -> DataFrame:
    return installed.join(declared, "package", "left_anti")


FLOW = "files array<string>, functions map<string,string>, fun2fun array<array<bigint>>, call2fun array<array<bigint>>, calls map<string,string>"


@dataclass
class Flow:
    """A flow analysis as tables: functions (id, path, place), fun2fun (caller, callee), call2fun (call, callee), calls."""

    functions: DataFrame
    fun2fun: DataFrame
    call2fun: DataFrame
    calls: DataFrame


def ingest_flow(spark: SparkSession, path: str) -> Flow:
    """Reads the JSON of a flow analyzer: locations are ``file:line:column:line:column``, the file a place in ``files``."""
    row = spark.read.text(path, wholetext=True).select(F.from_json("value", FLOW).alias("f")).select("f.*")

    def located(column: str) -> DataFrame:
        rows = row.select("files", F.explode(column).alias("id", "text"))
        place = x.location(F.col("text"))
        return rows.select(F.col("id").cast("bigint").alias("id"), F.get("files", place["file"]).alias("path"), place.alias("place")).where("path is not null")

    pairs = lambda column, a, b: row.select(F.explode(column).alias("p")).select(F.get("p", 0).alias(a), F.get("p", 1).alias(b))
    return Flow(located("functions"), pairs("fun2fun", "caller", "callee"), pairs("call2fun", "call", "callee"), located("calls"))


def within_policy(flow: Flow, declared: DataFrame) -> Flow:
    """The flow without functions of packages that are installed and not declared; what names them is unknown then."""
    excluded = excluded_packages(installed_packages(flow.functions.select("path")), declared)
    marked = flow.functions.withColumn("package", F.regexp_extract("path", INSTALLED, 1))
    return replace(flow, functions=marked.join(excluded, "package", "left_anti").drop("package"))
