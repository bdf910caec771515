"""Operator 11: the prefix trie of conversations, with subtree totals by leaf-peeling message passing.

1. Turns become digests of role and text, and get their place in the conversation. Conversations are rebuilt from the first
   turns of the first conversation of their hundred and their own later turns.
2. A prefix is known by its depth and an exclusive or of the digests of (place, turn), 120 bits of them. The rows of one
   prefix are a node; its smallest member and its depth name it, and its parent.
3. A node with a single child that goes on with the same smallest member is one run with it, so that rounds follow the
   branchings and not the length of conversations. Each run holds a counter of children that have not reported. In each round
   the runs whose counter is zero are complete: they leave, and send their subtree's totals to their parents, summed by parent
   before they are shuffled; until only the root finishes. A node's totals are its run's without what stands above it.
4. The ids of the members that end at a node are joined in chunks by range, and the chunks of a node hashed one after the other.

A conversation or a prefix that holds most rows is spread over tasks: places and prefixes are summed in blocks, by
(block, conversation), and nodes are counted before they are shuffled. A round is written to the shared folder.

Nulls and ties: turns come with null first, turns of equal number by their digests; a null role or text counts as empty;
rows without a conv_id belong to no conversation and are left out; repeated rows are separate turns; an empty table gives an
empty result, without a root; other columns are left out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from callweave.llm.common import delete_path, fresh_path, numbered, written

HUNDRED = 100
HEADS = 6
CHUNK = 4096
ROUNDS = 1_000_000


def head_length(conv: Column) -> Column:
    return (F.crc32(conv.cast("string")) % HEADS).cast("int")


def lanes(*parts: Column) -> list[Column]:
    """120 bits of a digest as two numbers."""
    text = F.sha2(F.concat_ws(" ", *parts), 256)
    return [F.conv(F.substring(text, at, 15), 16, 10).cast("long") for at in (1, 16)]


def turns(rows: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """(conv, turn, digest, chars) of each row of a conversation."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role_col, text_col))
    digest = F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256)
    return rows.where(F.col(conv_col).isNotNull()).select(F.col(conv_col).cast("long").alias("conv"), F.col(turn_col).alias("turn"), digest.alias("digest"), F.length(text).cast("long").alias("chars"))


def rebuilt(own: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Conversations (conv, length), and their turns after rebuilding (conv, part, place, digest, chars), places from 1.

    ``part`` is the block of the numbered turns, -1 for those taken over; blocks follow each other."""
    placed = numbered(own, "conv", ["turn", "digest"], "turns").withColumn("place", F.col("number") + 1)
    counts = placed.groupBy("conv").agg(F.count("*").alias("n"))
    first = placed.where((F.col("conv") % HUNDRED == 0) & (F.col("place") < HEADS)).groupBy("conv")
    first = first.agg(F.array_sort(F.collect_list(F.struct("place", "digest", "chars"))).alias("head")).withColumnRenamed("conv", "base")
    convs = counts.withColumn("h", head_length(F.col("conv"))).withColumn("base", F.col("conv") - F.col("conv") % HUNDRED).join(first, "base", "left")
    convs = convs.withColumn("head", F.slice(F.coalesce("head", F.array()), F.lit(1), F.col("h")))
    convs = written(convs.select("conv", "h", "head", (F.size("head") - F.col("h")).alias("shift"), (F.size("head") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("length")), "conversations")
    blocks = placed.groupBy("part", "conv").agg(F.lit(1).alias("one")).join(convs.select("conv", "h", "shift"), "conv").select("part", "conv", "h", "shift")
    later = placed.join(blocks, ["part", "conv"]).where(F.col("place") > F.col("h")).select("conv", "part", (F.col("place") + F.col("shift")).alias("place"), "digest", "chars")
    taken = convs.select("conv", F.explode("head").alias("t")).select("conv", F.lit(-1).cast("long").alias("part"), "t.place", "t.digest", "t.chars")
    return convs.select("conv", "length"), later.union(taken)


def prefixes(convs: DataFrame, rows: DataFrame) -> DataFrame:
    """(depth, p1, p2, conv, part, chars, q1, q2, ends): each prefix of each conversation, q1 and q2 of the prefix before."""
    marked = written(rows.select("*", *[c.alias(n) for c, n in zip(lanes(F.col("place").cast("string"), F.col("digest")), ("t1", "t2"))]).drop("digest"), "marked")
    sums = marked.groupBy("part", "conv").agg(F.bit_xor("t1").alias("s1"), F.bit_xor("t2").alias("s2"))
    above = Window.partitionBy("conv").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each block
    before = sums.select("part", "conv", *[F.coalesce(F.bit_xor(s).over(above), F.lit(0)).alias(b) for s, b in (("s1", "b1"), ("s2", "b2"))])
    before = before.join(convs, "conv")
    inside = Window.partitionBy("part", "conv").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    runs = marked.select("*", F.bit_xor("t1").over(inside).alias("r1"), F.bit_xor("t2").over(inside).alias("r2")).join(before, ["part", "conv"])
    p1, p2 = F.col("r1").bitwiseXOR(F.col("b1")), F.col("r2").bitwiseXOR(F.col("b2"))
    return runs.select(F.col("place").alias("depth"), p1.alias("p1"), p2.alias("p2"), "conv", "part", "chars", p1.bitwiseXOR(F.col("t1")).alias("q1"), p2.bitwiseXOR(F.col("t2")).alias("q2"), (F.col("place") == F.col("length")).alias("ends"))


def ends_hashed(ends: DataFrame) -> DataFrame:
    """(depth, p1, p2, ends_sha256) of (depth, p1, p2, conv): the digest of the ids of each node, ascending, comma-joined."""
    keys = ["depth", "p1", "p2"]
    whole = pa.schema([*((k, pa.int64()) for k in keys), ("first", pa.int64()), ("ids", pa.string())])
    result = pa.schema([*((k, pa.int64()) for k in keys), ("ends_sha256", pa.string())])

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Consecutive rows of a node, ``CHUNK`` at most, as one row."""
        held, ids = None, []

        def full(out: list) -> None:
            out.append((*held, ids[0], ",".join(map(str, ids))))

        for batch in batches:
            out: list[tuple] = []
            for depth, p1, p2, conv in zip(*(c.to_pylist() for c in batch.columns)):
                if ids and (held != (depth, p1, p2) or len(ids) == CHUNK):
                    full(out)
                    ids = []
                held = depth, p1, p2
                ids.append(conv)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), whole)], schema=whole)
        if ids:
            last: list[tuple] = []
            full(last)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*last), whole)], schema=whole)

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Streams the chunks of each node, in order, through one digest."""
        held, state = None, hashlib.sha256()
        for batch in batches:
            out: list[tuple] = []
            for depth, p1, p2, _, ids in zip(*(c.to_pylist() for c in batch.columns)):
                if held == (depth, p1, p2):
                    state.update(b",")
                else:
                    if held is not None:
                        out.append((*held, state.hexdigest()))
                    held, state = (depth, p1, p2), hashlib.sha256()
                state.update(ids.encode())
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), result)], schema=result)
        if held is not None:
            yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip((*held, state.hexdigest()), result)], schema=result)

    joined = ends.select(*keys, "conv").repartitionByRange(*keys, "conv").sortWithinPartitions(*keys, "conv").mapInArrow(chunks, "depth long, p1 long, p2 long, first long, ids string")
    return joined.repartition(*keys).sortWithinPartitions(*keys, "first").mapInArrow(hashes, "depth long, p1 long, p2 long, ends_sha256 string")


def peel(runs: DataFrame) -> DataFrame:
    """(conv_id, bottom, saved, leaves) of the subtree of each run of ``runs`` (conv_id, bottom, parent_conv, parent_depth,
    n_children, own), by rounds: complete runs leave and report to their parents."""
    spark = runs.sparkSession
    state = runs.select("conv_id", "bottom", "parent_conv", "parent_depth", F.col("n_children").alias("open"), F.col("own").alias("saved"), F.when(F.col("n_children") == 0, 1).otherwise(0).cast("long").alias("leaves"))
    path, finished = fresh_path(spark, "peel"), fresh_path(spark, "peeled")
    state.write.parquet(path)
    for _ in range(ROUNDS):
        now = spark.read.schema(state.schema).parquet(path)
        complete = now.where("open = 0")
        complete.select("conv_id", "bottom", "saved", "leaves").write.mode("append").parquet(finished)
        sent = complete.groupBy(F.col("parent_conv").alias("conv_id"), F.col("parent_depth").alias("bottom")).agg(F.count("*").alias("m"), F.sum("saved").alias("more_saved"), F.sum("leaves").alias("more_leaves"))
        waiting = now.where("open > 0").join(sent, ["conv_id", "bottom"], "left")
        got = lambda c: F.coalesce(c, F.lit(0))
        after = fresh_path(spark, "peel")
        waiting.select("conv_id", "bottom", "parent_conv", "parent_depth", (F.col("open") - got("m")).alias("open"), (F.col("saved") + got("more_saved")).alias("saved"), (F.col("leaves") + got("more_leaves")).alias("leaves")).write.parquet(after)
        delete_path(spark, path)
        path = after
        if spark.read.schema(state.schema).parquet(path).isEmpty():
            break
    return spark.read.schema("conv_id long, bottom long, saved long, leaves long").parquet(finished)


def trie(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """A row for each node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    spark = conversations.sparkSession
    convs, rows = rebuilt(turns(conversations, conv_col, turn_col, role_col, text_col))
    every = written(prefixes(convs, rows), "prefixes")
    root = convs.agg(F.min("conv").alias("conv_id"), F.count("*").alias("n_convs")).first()
    if not root["n_convs"]:
        return spark.createDataFrame([], "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string")

    own = every.groupBy("depth", "p1", "p2").agg(F.min(F.struct("conv", "part", "q1", "q2", "ends")).alias("first"), F.count("*").alias("n_convs"), F.max("chars").alias("chars"))
    own = own.select("depth", "p1", "p2", F.col("first.conv").alias("conv_id"), "first.part", "first.q1", "first.q2", "first.ends", "n_convs", ((F.col("n_convs") - 1) * F.col("chars")).alias("own"))
    top = spark.range(1).select(F.lit(0).cast("long").alias("depth"), F.lit(0).cast("long").alias("p1"), F.lit(0).cast("long").alias("p2"), F.lit(root["conv_id"]).alias("conv_id"), F.lit(-2).cast("long").alias("part"), F.lit(None).cast("long").alias("q1"), F.lit(None).cast("long").alias("q2"), F.lit(True).alias("ends"), F.lit(root["n_convs"]).alias("n_convs"), F.lit(0).cast("long").alias("own"))
    nodes = written(own.unionByName(top), "nodes")
    children = nodes.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("q1").alias("p1"), F.col("q2").alias("p2")).agg(F.count("*").alias("n_children"))
    parents = nodes.join(children, ["depth", "p1", "p2"], "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)))
    parents = written(parents, "parents")
    named = parents.where("n_children > 0 and depth > 0").select((F.col("depth") + 1).alias("depth"), F.col("p1").alias("q1"), F.col("p2").alias("q2"), F.col("conv_id").alias("parent_conv_id"))
    below = parents.where("depth > 1").join(named, ["depth", "q1", "q2"])
    above = parents.where("depth <= 1").withColumn("parent_conv_id", F.when(F.col("depth") == 1, F.lit(root["conv_id"])))
    nodes = below.unionByName(above)

    stop = F.when((F.col("n_children") != 1) | F.col("ends"), 1).otherwise(0)
    inside = Window.partitionBy("conv_id", "part").orderBy("depth").rowsBetween(Window.unboundedPreceding, -1)
    nodes = written(nodes.withColumn("run", F.coalesce(F.sum(stop).over(inside), F.lit(0))), "runs")
    run = ["conv_id", "part", "run"]
    ends_of = nodes.groupBy(*run).agg(F.max("depth").alias("bottom"), (F.min("depth") - 1).alias("parent_depth"), F.min_by("parent_conv_id", "depth").alias("parent_conv"), F.max_by("n_children", "depth").alias("n_children"), F.sum("own").alias("own"))
    totals = peel(ends_of).select("conv_id", "bottom", "saved", "leaves")
    earlier = F.coalesce(F.sum("own").over(Window.partitionBy(*run).orderBy("depth").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    whole = nodes.select("*", earlier.alias("earlier"), F.max("depth").over(Window.partitionBy(*run)).alias("bottom")).join(totals, ["conv_id", "bottom"])

    last = every.where("ends").select("depth", "p1", "p2", "conv")
    turnless = convs.where("length = 0").select(*[F.lit(0).cast("long").alias(c) for c in ("depth", "p1", "p2")], "conv")
    whole = whole.join(ends_hashed(last.union(turnless)), ["depth", "p1", "p2"], "left")
    none = F.lit(hashlib.sha256().hexdigest())
    return whole.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", F.col("leaves").alias("n_leaves"), (F.col("saved") - F.col("earlier")).alias("saved_tokens"), F.coalesce("ends_sha256", none).alias("ends_sha256"))
