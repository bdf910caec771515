"""Interval and as-of joins, ancestors by doubling and factorised dispatch, against plain versions."""

import random

import pytest
from pyspark.sql import functions as F

from callweave.operators import closure, rows


def test_innermost(spark):
    """Random ranges that nest, cross, touch and are empty, one key with most of them."""
    chosen = random.Random(1)
    keys = ["hot"] * 8 + ["a", "b", None]
    ranges = [(chosen.choice(keys), k, a := chosen.randrange(1000), a + chosen.choice([0, 1, 2, 7, 100, 5000, -3])) for k in range(400)] + [("a", 900, None, 5), ("a", 901, 5, None), ("b", 902, 0, 2**40)]
    points = [(chosen.choice(keys), k, chosen.randrange(1200)) for k in range(600)] + [("hot", 700, None), ("none", 701, 5), ("b", 702, 2**40 - 1), ("b", 703, 2**40)]
    p = spark.createDataFrame(points, "f string, p int, at long").repartition(3)
    r = spark.createDataFrame(ranges, "f string, r int, s long, e long").repartition(3)
    got = {x.p: x.r for x in rows.innermost(p, r, ["f"], ["p"], "at", "s", "e").collect()}
    want = {}
    for f, k, at in points:
        held = [(s, -e, n) for g, n, s, e in ranges if f is not None and f == g and None not in (at, s, e) and s <= at < e]
        if held:
            want[k] = max(held)[:2]
    ends = {n: (s, -e) for _, n, s, e in ranges if None not in (s, e)}
    assert {k: ends[v] for k, v in got.items()} == want
    assert rows.innermost(p, r.where("s < 0"), ["f"], ["p"], "at", "s", "e").columns == ["f", "p", "at", "r", "s", "e"]


def test_cells_cover_exactly(spark):
    for a, b in ((0, 8), (1, 8), (3, 4), (5, 5), (7, 3), (1, 1023), (6, 2**33 + 5)):
        found = spark.range(1).select(rows.cells(F.lit(a).cast("long"), F.lit(b).cast("long"), 34).alias("c")).first()["c"]
        spans = sorted((x.cell << x.level, (x.cell + 1) << x.level) for x in found)
        assert sum(e - s for s, e in spans) == max(0, b - a) and len(spans) <= 70
        assert not spans or spans[0][0] == a and spans[-1][1] == b and all(x[1] == y[0] for x, y in zip(spans, spans[1:]))


def test_a_file_with_very_many_ranges(spark):
    """A bundle of 50,000 functions of four lines each in one of another: no more rows than points times levels."""
    ranges = spark.range(50_000).select(F.lit("f").alias("f"), F.col("id").alias("r"), (F.col("id") * 4).alias("s"), (F.col("id") * 4 + 4).alias("e")).union(spark.sql("select 'f', -1L, 0L, 1000000L"))
    points = spark.range(100_000).select(F.lit("f").alias("f"), F.col("id").alias("p"), (F.col("id") * 3).alias("at"))
    got = rows.innermost(points, ranges, ["f"], ["p"], "at", "s", "e")
    assert got.where(F.col("r") != F.when(F.col("at") < 200_000, F.floor(F.col("at") / 4)).otherwise(-1)).count() == 0 and got.count() == 100_000


def test_innermost_passes_points_once(spark):
    """Points are not multiplied by levels, nor sent again to be put together: the only rows made of a range are its cells."""
    points = spark.range(500).select(F.lit("f").alias("f"), F.col("id").alias("p"), (F.col("id") * 3).alias("at"))
    ranges = spark.range(400).select(F.lit("f").alias("f"), F.col("id").alias("r"), (F.col("id") * 3).alias("s"), (F.col("id") * 3 + 90).alias("e"))
    got = rows.innermost(points, ranges, ["f"], ["p"], "at", "s", "e")
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Generate explode") == 1 and plan.count("Join") == 1
    assert {x.p: x.r for x in got.collect()} == {k: min(k, 399) for k in range(429)}


def test_innermost_around_blocks(spark):
    """Wide and narrow ranges around the borders of blocks of places, with equal starts and equal ends."""
    chosen = random.Random(4)
    ranges = [(k, a := chosen.choice([0, 1, 63, 64, 65, 127, 128, 4095, 4096, 5000]), a + chosen.choice([1, 63, 64, 65, 128, 129, 4096, 2**33])) for k in range(60)]
    points = list(range(0, 10_000, 7)) + [62, 63, 64, 65, 4095, 4096, 2**33 + 100, 2**33 + 6000]
    p, r = spark.createDataFrame([("f", x) for x in set(points)], "f string, at long"), spark.createDataFrame([("f", *x) for x in ranges], "f string, r int, s long, e long")
    got = {x.at: (x.s, -x.e) for x in rows.innermost(p, r, ["f"], ["at"], "at", "s", "e").collect()}
    assert got == {x: max((s, -e) for _, s, e in ranges if s <= x < e) for x in points if any(s <= x < e for _, s, e in ranges)}


def test_latest(spark):
    chosen = random.Random(2)
    keys = ["hot"] * 8 + ["a", "b", None]
    marks = [(chosen.choice(keys), k, chosen.choice([None, *range(60)])) for k in range(300)]
    points = [(chosen.choice(keys), k, chosen.choice([None, *range(70)])) for k in range(300)]
    p, m = spark.createDataFrame(points, "u string, p int, at int").repartition(3), spark.createDataFrame(marks, "u string, m int, t int").repartition(3)
    got = {x.p: x.m for x in rows.latest(p, m, ["u"], "at", "t", ["m"]).collect()}
    want = {k: max(held)[1] for u, k, at in points if u is not None and at is not None and (held := [(t, n) for v, n, t in marks if v == u and t is not None and t < at])}
    assert got == want
    assert rows.latest(p, m.limit(0), ["u"], "at", "t", ["m"]).collect() == []


def test_ancestors(spark):
    chosen = random.Random(3)
    parent = {k: chosen.randrange(k) for k in range(1, 150)} | {k: k - 1 for k in range(1001, 2001)}
    table = spark.createDataFrame([(p, c) for c, p in parent.items()] + [(None, 5), (7, None), (9, 9)], "parent int, child int")
    want = set()
    for node in parent:
        at, depth = node, 0
        while at in parent:
            at, depth = parent[at], depth + 1
            want.add((node, at, depth))
    assert {tuple(r) for r in closure.ancestors(table).collect()} == want
    assert closure.ancestors(table.limit(0)).collect() == []
    for bad in ([(1, 2), (3, 2)], [(1, 2), (2, 3), (3, 1)]):
        with pytest.raises(ValueError):
            closure.ancestors(spark.createDataFrame(bad, "parent int, child int"))


def test_dispatch_is_one_row_a_method_and_override(spark):
    frame = spark.createDataFrame
    calls = frame([(k, "A", "run") for k in range(500)] + [(500, "B", "run"), (501, "A", "stop")], "call int, owner string, member string")
    parents = frame([("B", "A"), ("C", "B"), ("D", "A")], "child string, parent string")
    methods = frame([("B", "run"), ("C", "run"), ("D", "run"), ("D", "other")], "owner string, member string")
    made, abstract = frame([("C",), ("D",), ("B",)], "type string"), frame([("B",)], "type string")
    found = closure.dispatch(calls, parents, methods, made, abstract)
    assert sorted(map(tuple, found.collect())) == [("A", "run", "C.run"), ("A", "run", "D.run"), ("B", "run", "C.run")]
    assert closure.rta_expand(calls, parents, methods, made, abstract).count() == 1001
