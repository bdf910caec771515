"""What the training-data operators share: the shared folder, written tables, streams of sorted groups, components."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from callweave.sources.storage import delete_path, fresh_path, scratch
from callweave.sources.storage import stored as written

__all__ = ["Forest", "Task", "bound", "components", "delete_path", "fresh_path", "numbered", "one_task_each", "rows_to_batches", "scratch", "sorted_groups", "tasks_for", "written"]


def sorted_groups(batches: Iterable[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """The runs of equal ``keys`` in Arrow batches that arrive sorted by them; holds one run at a time."""
    import numpy as np

    held: list[pa.Table] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        columns = [table.column(k).to_numpy(zero_copy_only=False) for k in keys]
        change = np.zeros(len(table), bool)
        for c in columns:
            change[1:] |= c[1:] != c[:-1]
        cuts = [0, *np.flatnonzero(change).tolist(), len(table)]
        for a, b in zip(cuts, cuts[1:]):
            key = tuple(c[a] for c in columns)
            if held and key != last:
                yield pa.concat_tables(held)
                held = []
            held.append(table.slice(a, b - a))
            last = key
    if held:
        yield pa.concat_tables(held)


def components(edges: DataFrame, label: str = "components", rounds: int = 60) -> DataFrame:
    """Connected components of ``edges`` (a, b): rows (node, component), component the smallest node reachable.

    Alternates large-star and small-star contraction. Each step takes a minimum per node, aggregated before the shuffle.
    Only nodes whose edges change are joined back: a node that is the least of its neighbours, as the centre of a finished
    star is, keeps them as they are. The minima are written before they are joined, so that Spark sees two plain inputs
    and splits the edges of a node with very many neighbours over tasks. The edges of each round are written to the shared
    folder, and the last round's deleted. Null ends are dropped; an empty table gives an empty one.
    """
    spark = edges.sparkSession
    edges = edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct()
    path, before = fresh_path(spark, label), None
    edges.write.parquet(path)
    for _ in range(rounds):
        now = spark.read.parquet(path)
        total = now.agg(F.count("*").alias("n"), F.sum(F.hash("a", "b").cast("long")).alias("h")).first()
        if before == (total["n"], total["h"]):
            break
        before = (total["n"], total["h"])
        after = fresh_path(spark, label)
        with scratch(spark):
            both = now.union(now.select("b", "a").toDF("a", "b"))
            moved = written(both.groupBy("a").agg(F.min("b").alias("m")).where("m < a"), label)
            large = both.where("b > a").join(moved, "a", "left").select(F.col("b").alias("u"), F.coalesce("m", "a").alias("v"))
            large = written(large.distinct(), label)
            low = written(large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")), label)
            stars = low.select(F.col("m").alias("a"), F.col("u").alias("b"))
            rest = large.join(low.where("n > 1").select("u", "m"), "u").where("v <> m").select(F.col("m").alias("a"), F.col("v").alias("b"))
            stars.union(rest).distinct().write.parquet(after)
        delete_path(spark, path)
        path = after
    else:
        raise RuntimeError(f"{label}: components are not found after {rounds} rounds")
    stars = spark.read.parquet(path)
    nodes = stars.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("component"))
    return nodes.union(stars.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct())


def tasks_for(spark: SparkSession, work: int, each: int) -> int:
    """How many tasks share ``work``, ``each`` to a task; never fewer than four for each core of the cluster."""
    return max(4 * spark.sparkContext.defaultParallelism, min(100_000, -(-int(work) // each)))


def bound(value: Column, use) -> Column:
    """``use`` of ``value``, which is computed once however often ``use`` refers to it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def one_task_each(rows: DataFrame, key: str) -> DataFrame:
    """Small ``rows`` that each stand for a file, one to a task; the number given keeps them from being coalesced."""
    return rows.repartitionByRange(max(1, rows.count()), key)


def numbered(rows: DataFrame, key: str, order: list[str], label: str = "numbered") -> DataFrame:
    """``rows`` with rank (of ``key`` among its values, from 0, null first), number (of the row within its key in ``order``,
    from 0) and last (whether no row of the key follows).

    Rows are dealt by ranges of key and order, so a key that holds most of the rows is spread over many tasks, and so are
    equal rows, by a number of their own. Each task numbers its own rows; what precedes them in other tasks is summed up on
    the driver from one row for each task.
    """
    import numpy as np
    from pyspark import TaskContext
    from pyspark.sql.types import BooleanType, LongType, StructField, StructType

    spark, names, at = rows.sparkSession, rows.columns, rows.columns.index(key)
    more = [("part", pa.int64(), LongType()), ("rank", pa.int64(), LongType()), ("number", pa.int64(), LongType()), ("last", pa.bool_(), BooleanType()), ("final", pa.bool_(), BooleanType())]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, rank, number, before = TaskContext.get().partitionId(), -1, 0, None
        held: tuple | None = None

        def done(follows: bool) -> pa.RecordBatch:
            batch, ranks, numbers, last = held
            last[-1], final = not follows, np.zeros(len(last), bool)
            final[-1] = not more_to_come
            columns = [pa.array(np.full(len(last), part)), pa.array(ranks), pa.array(numbers), pa.array(last), pa.array(final)]
            return pa.RecordBatch.from_arrays([*batch.columns, *columns], names=[*batch.schema.names, *(n for n, _, _ in more)])

        more_to_come = True
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = batch.column(at).to_pylist()
            new = np.array([rank < 0 or keys[0] != before, *(a != b for a, b in zip(keys, keys[1:]))])
            if held is not None:
                yield done(not new[0])
            ranks = rank + np.cumsum(new)
            starts = np.maximum.accumulate(np.where(new, np.arange(len(keys)), -1))
            numbers = np.arange(len(keys)) - starts + np.where(starts < 0, number - 1, 0)
            rank, number, before = int(ranks[-1]), int(numbers[-1]) + 1, keys[-1]
            held = batch, ranks, numbers, np.append(new[1:], True)
        more_to_come = False
        if held is not None:
            yield done(False)

    sort = [F.col(c).asc_nulls_first() for c in (key, *order)]
    dealt = rows.withColumn("tie", F.monotonically_increasing_id()).repartitionByRange(*sort, "tie").sortWithinPartitions(*sort, "tie").drop("tie")
    schema = StructType([*rows.schema.fields, *(StructField(n, t) for n, _, t in more)])
    placed = written(dealt.mapInArrow(task, schema), label)
    place = F.struct("rank", "number")
    ends = placed.groupBy("part").agg(F.max("rank").alias("keys"), F.min_by(F.struct(key), place).alias("first"), F.max_by(F.struct(key, "number"), place).alias("end")).orderBy("part").collect()
    shifts, keys, open_key, run = [], 0, None, 0
    for r in ends:
        goes_on = bool(shifts) and r["first"][0] == open_key
        if goes_on:
            shifts[-1][3] = True
            keys -= 1
        shifts.append([r["part"], keys, run if goes_on else 0, False])
        run = r["end"][1] + 1 + (shifts[-1][2] if r["keys"] == 0 else 0)
        keys, open_key = keys + r["keys"] + 1, r["end"][0]
    shift = spark.createDataFrame(shifts or [], "part long, keys_before long, rows_before long, goes_on boolean")
    joined = placed.join(F.broadcast(shift), "part")
    number = F.col("number") + F.when(F.col("rank") == 0, F.col("rows_before")).otherwise(F.lit(0))
    return joined.select(*names, "part", (F.col("rank") + F.col("keys_before")).alias("rank"), number.alias("number"), (F.col("last") & ~(F.col("final") & F.col("goes_on"))).alias("last"))


class Forest:
    """Union-find over the integers below ``n``, for the pairs of one bounded block."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, x: int, y: int) -> bool:
        """True if x and y were apart."""
        x, y = self.root(x), self.root(y)
        if x == y:
            return False
        self.up[max(x, y)] = min(x, y)
        return True


def rows_to_batches(rows: Iterable[tuple], schema: pa.Schema, size: int = 4096) -> Iterator[pa.RecordBatch]:
    """Tuples as Arrow batches."""
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) >= size:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
    pa.default_memory_pool().release_unused()  # the worker lives on, for tasks of other stages


Task = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]
