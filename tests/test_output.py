"""JSON in order, figures counted while it is written, and the package policy of flow results."""

import io
import json

from pyspark.sql import functions as F

from callweave.sources import scan, sinks


def tables(spark, names):
    """The tables that documents are made of, with modules alone."""
    out = {t: spark.createDataFrame([], f"app_name string, file_key string, is_target boolean, {ddl}") for t, ddl in scan.TABLES.items()}
    rows = spark.createDataFrame([(n, k % 3 == 0) for k, n in enumerate(names)], "file_key string, from_cache boolean").repartition(5)
    more = {f.name: f.dataType for f in out["module"].schema if f.name not in rows.columns}
    rows = rows.select("*", *[F.lit(None).cast(t).alias(c) for c, t in more.items()])
    for name, kind in (("content_hash", "string"), ("last_modified", "timestamp"), ("file_size", "long")):
        if name not in rows.columns:
            rows = rows.withColumn(name, F.lit(None).cast(kind))
    return out | {"module": rows.withColumn("module_name", F.col("file_key"))}


def test_json_is_one_sorted_list(spark, tmp_path):
    names = [f"src/{c}{k}.ts" for k in range(40) for c in ("a", "B", "é", "z", "Ab")]
    edges = spark.createDataFrame([(n, m, k + 1) for k, n in enumerate(names) for m in ("b.x", "A.y")], "source string, target string, weight long").repartition(7)
    figures = sinks.write_json(tables(spark, names), edges, str(tmp_path / "out"))
    assert figures == {"modules": 200, "cached": 67, "built": 133, "edges": 400, "weight": 2 * sum(range(1, 201))}
    out = io.BytesIO()
    sinks.copy_json(spark, str(tmp_path / "out"), out)
    lines = [json.loads(line) for line in out.getvalue().decode().splitlines()]
    order = [r.file_key for r in spark.createDataFrame([(n,) for n in names], "file_key string").orderBy(F.collate("file_key", "UNICODE"), "file_key").collect()]
    assert [x["module"]["module_name"] for x in lines[:200]] == order and order[0] == "src/a0.ts" and order.index("src/B0.ts") < order.index("src/z0.ts")
    assert [(x["source"], x["target"]) for x in lines[200:]] == [(n, m) for n in order for m in ("A.y", "b.x")]


def test_undeclared_packages_are_not_followed(spark):
    paths = [(1, "src/a.ts"), (2, "node_modules/good/i.js"), (3, "node_modules/@s/odd/i.js"), (4, "node_modules/.bin/x")]
    functions = spark.createDataFrame(paths, "id long, path string")
    flow = scan.within_policy(scan.Flow(functions, functions, functions, functions), spark.createDataFrame([("good",)], "package string"))
    assert {r.id for r in flow.functions.collect()} == {1, 2, 4} and flow.calls.count() == 4
