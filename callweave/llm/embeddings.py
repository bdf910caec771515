"""Operator 8: near-duplicate vectors by Euclidean p-stable hashing, checked by exact cosine.

Vectors are normalised, so that a cosine of at least ``least`` is a Euclidean distance of at most sqrt(2 - 2 least). Each of
``tables`` tables hashes a vector to the whole parts of ``projections`` random projections, shifted and divided by
``width``. A bucket, known by a hash of its table, cells and label, has as its leader the smallest id in it; only buckets
and ids are shuffled to find leaders. Vectors that are close share most of their buckets, and so a few leaders: a vector
is sent once to each of its leaders, not once to each of its tables. Vectors of one label that meet at a leader are compared
exactly, in double precision, by matrix products of square tiles of bounded size. A pair counts at the smallest leader
that both have, so links are counted once. Tiles yield a vector's number of links and a spanning forest, never the pairs.
Equal vectors are one class that is hashed once.

With 64 dimensions and the defaults a pair at cosine 0.98 meets in one of the tables with a probability over 0.999, a
closer one more surely; the tests measure recall against brute force.

Nulls and ties: vectors that are null, empty, zero, or hold a null or non-finite component, and those with a null label,
link with nothing; vectors of different lengths never link; a null id keeps its row, links with nothing and is kept; rows
that repeat an id count as one vector each; an empty table gives an empty result; other columns are left out.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callweave.llm.common import components, rows_to_batches, sorted_groups, tasks_for, written

TILE = 2048
ROWS = 256  # of a product at once
PAIRS = 40_000_000  # to a task
_FOUND = pa.schema([("id", pa.int64()), ("links", pa.int64()), ("root", pa.int64())])


def planes(dimensions: int, tables: int, projections: int, seed: int = 8) -> tuple[np.ndarray, np.ndarray]:
    """The projections' directions and shifts, the same on every worker."""
    random = np.random.default_rng([seed, dimensions])
    return random.standard_normal((dimensions, tables * projections)), random.random(tables * projections)


def buckets(vectors: np.ndarray, tables: int, projections: int, width: float) -> np.ndarray:
    """For each vector its bucket in each table, told apart from those of other tables."""
    directions, shifts = planes(vectors.shape[1], tables, projections)
    unit = vectors / np.sqrt((vectors * vectors).sum(1, keepdims=True))
    cells = np.floor(unit @ directions / width + shifts).astype(np.int64).view(np.uint64).reshape(len(vectors), tables, projections)
    out = np.tile(np.arange(tables, dtype=np.uint64) * np.uint64(1 << 32) + np.uint64(vectors.shape[1]), (len(vectors), 1))
    for k in range(projections):
        out = (out ^ cells[:, :, k]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(31)
    return out.view(np.int64)


def hashed(vectors: DataFrame, tables: int, projections: int, width: float) -> DataFrame:
    """Rows (id, label, v, copies) with their buckets."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.column(2)
            lengths = np.diff(rows.offsets.to_numpy())
            out: list = [None] * batch.num_rows
            for size in np.unique(lengths):
                where = np.flatnonzero(lengths == size)
                found = buckets(rows.take(pa.array(where)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(where), size), tables, projections, width)
                for k, row in zip(where.tolist(), found):
                    out[k] = row
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.list_(pa.int64()))], names=["id", "label", "v", "copies", "buckets"])

    return vectors.select("id", "label", "v", "copies").mapInArrow(task, "id long, label string, v array<double>, copies long, buckets array<long>")


def compare(tiles: DataFrame, least: float, tasks: int) -> DataFrame:
    """Rows (leader, label, size, ti, tj, part, id, copies, v, leaders) → links of each vector, and forests (id, root)."""

    def compared(group: pa.Table) -> Iterator[tuple]:
        ids, parts, copies = group.column("id").to_pylist(), group.column("part").to_numpy(), group.column("copies").to_numpy()
        leader = group.column("leader")[0].as_py()
        vectors = group.column("v").combine_chunks().flatten().to_numpy().reshape(len(ids), -1)
        vectors = vectors / np.sqrt((vectors * vectors).sum(1, keepdims=True))
        before = [[x for x in row if x < leader] for row in group.column("leaders").to_pylist()]
        names = {x: k for k, x in enumerate(sorted({x for row in before for x in row}))}
        earlier = np.zeros((len(ids), (len(names) + 7) // 8), np.uint8)  # the smaller leaders of each vector, as bits
        for k, row in enumerate(before):
            for x in row:
                earlier[k, names[x] // 8] |= 1 << names[x] % 8
        across = group.column("ti")[0].as_py() != group.column("tj")[0].as_py()
        near = np.zeros((len(ids), len(ids)), bool)
        links = np.zeros(len(ids), np.int64)
        for k in range(0, len(ids), ROWS):
            x = slice(k, k + ROWS)
            near[x] = vectors[x] @ vectors.T >= least
            if across:
                near[x] &= parts[x][:, None] != parts[None]
            a, b = np.nonzero(near[x])
            a += k
            again = a == b
            if len(names):
                step = max(64, (1 << 24) // earlier.shape[1])
                for j in range(0, len(a), step):
                    y = slice(j, j + step)
                    again[y] |= (earlier[a[y]] & earlier[b[y]]).any(1)
            near[a[again], b[again]] = False
            links[x] = near[x] @ copies
        left = np.ones(len(ids), bool)
        for root in range(len(ids)):
            if not left[root]:
                continue
            left[root] = False
            front = np.array([root])
            while len(front):
                front = np.flatnonzero(near[front].any(0) & left)
                left[front] = False
                for x in front.tolist():
                    yield ids[x], int(links[x]), ids[root]
            if links[root]:
                yield ids[root], int(links[root]), ids[root]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from rows_to_batches((r for g in sorted_groups(batches, keys) if len(g) > 1 for r in compared(g)), _FOUND)

    keys = ["leader", "label", "size", "ti", "tj"]
    return tiles.select(*keys, "part", "id", "copies", "v", "leaders").repartition(tasks, *keys).sortWithinPartitions(*keys, "id").mapInArrow(task, "id long, links long, root long")


def near_duplicates(rows: DataFrame, least: float = 0.98, tables: int = 24, projections: int = 10, width: float = 1.3, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """A row for each vector: vec_id, n_links, component_id (the smallest id that links lead to) and kept."""
    spark = rows.sparkSession
    sent = written(rows.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("string").alias("label"), F.col(vector_col).cast("array<double>").alias("v")), "vectors")
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(math.inf)))
    good = F.coalesce(F.col("id").isNotNull() & F.col("label").isNotNull() & finite & F.exists("v", lambda x: x != 0), F.lit(False))
    sent = sent.withColumn("good", good).withColumn("h", F.when(good, F.xxhash64("v", "label")))
    classes = sent.where("good").groupBy("label", "h", "v").agg(F.min("id").alias("id"), F.count("*").alias("copies"))
    classes = written(classes.select("label", "h", "v", "copies", F.col("id").alias("least"), F.monotonically_increasing_id().alias("id")), "vector-classes")
    points = hashed(classes, tables, projections, width)
    key = F.explode(F.transform("buckets", lambda b: F.xxhash64(b, F.col("label")))).alias("key")
    places = written(points.select(key, "id"), "places")
    buckets_of = written(places.groupBy("key").agg(F.min("id").alias("leader"), F.count("*").alias("n")).where("n > 1").select("key", "leader"), "leaders")
    leaders = places.join(buckets_of, "key").select("id", "leader").distinct().groupBy("id").agg(F.sort_array(F.collect_list("leader")).alias("leaders"))
    met = written(classes.select("id", "label", F.size("v").alias("size"), "v", "copies").join(leaders, "id"), "met")
    sizes = written(met.select(F.explode("leaders").alias("leader")).groupBy("leader").agg(F.count("*").alias("count")), "leader-sizes")
    pairs = sizes.agg(F.sum(F.col("count") * F.least("count", F.lit(TILE)))).first()[0] or 0
    met = met.withColumn("leader", F.explode("leaders")).join(sizes, "leader").withColumn("tiles", F.ceil(F.col("count") / TILE))
    part = F.pmod(F.xxhash64("id"), F.col("tiles"))
    square = F.transform(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1), lambda j: F.struct(F.least("part", j).alias("ti"), F.greatest("part", j).alias("tj")))
    tiles = met.withColumn("part", part).withColumn("tile", F.explode(square)).select("*", "tile.ti", "tile.tj")
    found = written(compare(tiles, least, tasks_for(spark, pairs, PAIRS)), "vector-links")
    links = found.groupBy("id").agg(F.sum("links").alias("links"))
    groups = components(found.select(F.col("id").alias("a"), F.col("root").alias("b")), "vector-groups")
    groups = groups.join(classes.select(F.col("id").alias("node"), "least"), "node")
    groups = groups.join(groups.groupBy("component").agg(F.min("least").alias("first")), "component").select(F.col("node").alias("id"), "first")
    names = classes.join(links, "id", "left").join(groups, "id", "left")
    names = names.select("label", "h", "v", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"), F.coalesce("first", "least").alias("component"))
    out = sent.join(names, ["label", "h", "v"], "left")
    component = F.coalesce("component", "id")
    return out.select(F.col("id").alias("vec_id"), F.coalesce("links", F.lit(0).cast("long")).alias("n_links"), component.alias("component_id"), F.coalesce(component == F.col("id"), F.lit(True)).alias("kept"))
