"""Operator 12: a Merkle manifest of a table, built and verified by supersteps over RDDs of nodes.

A row's leaf is the digest of its fields. The leaves of a source, ascending by id, are the lowest level of its tree, and each
``FAN`` consecutive nodes have a parent; the roots of the sources, ordered by source, are the leaves of the last tree.

A vertex of the message passing is a node with the levels of its subtree below it that ``SPAN`` counts, so that the supersteps
are a third of the levels. Upward supersteps: each vertex sends its digest to its parent, the vertex ``SPAN`` levels above. A
parent whose children have all reported hashes them level by level, keeps their digests and sends on; a tree ends where one
node is left. Downward supersteps: each vertex sends each child the path above it with the siblings on the child's way up put
before, until the leaves have the whole path, by which a leaf, as it is now, is folded back to a root and compared.

Vertices are keyed by (tree, place), so those of a source that holds most rows are spread like all others; each superstep has
``FAN`` ** ``SPAN`` times fewer of them than the one before, and as many tasks as they need. Texts pass no shuffle, only digests do. Each level
is checkpointed in the shared folder. The driver gets one number for each level and the root.

Nulls and ties: any field may be null, and is then written as ``-``; null ids come first and nothing tampers with them; rows of
one source with equal ids are ordered by their leaves, so equal rows are equal leaves side by side; rows without a source are
a source, the first; an empty table gives an empty result; other columns are left out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

from pyspark import RDD, StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from callweave.llm.common import numbered
from callweave.sources.storage import shared_dir

FAN = 3
SPAN = 3
BLOCK = FAN**SPAN
EACH = 20_000
RESULT = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


def field(value: Column) -> Column:
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(fields: list[Column]) -> Column:
    return F.unhex(F.sha2(F.concat(*map(field, fields)), 256))


def digest(parts: list[bytes]) -> bytes:
    return hashlib.sha256("".join([p.hex() for p in parts]).encode()).digest()


def layers(digests: list[bytes], top: bool) -> list[list[bytes]]:
    """The levels of a vertex, from its children up: ``SPAN`` more, or up to the root in the vertex that ends its tree."""
    out = [digests]
    while len(out[-1]) > 1 if top else len(out) <= SPAN:
        out.append([digest(out[-1][a : a + FAN]) for a in range(0, len(out[-1]), FAN)])
    return out


def sides(levels: list[list[bytes]], child: int) -> tuple:
    """The (left, right) siblings on the way up from a child of a vertex."""
    out = []
    for level in levels[:-1]:
        first = child - child % FAN
        out.append((b"".join(level[first:child]), b"".join(level[child + 1 : first + FAN])))
        child //= FAN
    return tuple(out)


def kept(level: RDD) -> RDD:
    """The level, written to the shared folder; the cache only spares its second computation."""
    level = level.persist(StorageLevel.MEMORY_AND_DISK)
    level.checkpoint()
    level.count()
    return level.unpersist()


def climb(leaves: RDD, largest: int, tasks: int) -> list[RDD]:
    """Upward supersteps over leaves ((tree, place), (last, digest, payload)), ``largest`` of them in the largest tree. The
    levels hold ((tree, place), (last, digest, children)) of their vertices, children as (digest, payload)."""

    def send(node):
        (tree, place), (last, own, payload) = node
        return (tree, place // BLOCK), (place % BLOCK, last, own, payload)

    def hashed(node):
        (tree, place), messages = node
        children = sorted(messages, key=lambda m: m[0])
        last = any(m[1] for m in children)
        top = layers([m[2] for m in children], ends((tree, place), last))[-1]
        return (tree, place), (last, top[0], [m[2:] for m in children])

    levels, waiting = [], leaves
    while True:
        levels.append(kept(waiting.map(send).groupByKey(tasks).map(hashed, preservesPartitioning=True)))
        largest, tasks = -(-largest // BLOCK), max(1, -(-tasks // BLOCK))
        if largest == 1:
            return levels
        waiting = levels[-1].filter(lambda node: not ends(node[0], node[1][0])).mapValues(lambda v: (v[0], v[1], None))


def ends(key: tuple[int, int], last: bool) -> bool:
    """Whether a vertex is the only one left of its tree."""
    return last and key[1] == 0


def tops(levels: list[RDD]) -> RDD:
    """(tree, (digest, level)) of the node left of each tree."""
    found = [level.filter(lambda n: ends(n[0], n[1][0])).map(lambda n, k=k: (n[0][0], (n[1][1], k))) for k, level in enumerate(levels)]
    return found[0].context.union(found) if len(found) > 1 else found[0]


def descend(levels: list[RDD], starts: RDD) -> RDD:
    """Downward supersteps. ``starts``: ((tree, level), message) for each tree's top node. Gives (payload, digest, message,
    path) of every leaf; a path is a (left, right) of sibling digests for each level, from the leaf up."""

    def below(node) -> Iterator:
        (tree, place), ((last, _, children), (message, path)) = node
        inner = layers([own for own, _ in children], ends((tree, place), last))
        for k, (own, payload) in enumerate(children):
            yield (tree, place * BLOCK + k), (payload, own, message, sides(inner, k) + path)

    sent: RDD | None = None
    for k in range(len(levels) - 1, -1, -1):
        new = starts.filter(lambda s, k=k: s[0][1] == k).map(lambda s: ((s[0][0], 0), (s[1], ())))
        messages = new if sent is None else new.union(sent.mapValues(lambda v: (v[2], v[3])))
        sent = levels[k].join(messages, levels[k].getNumPartitions()).flatMap(below)
    return sent.values()




def fold(leaf: bytes, path: tuple) -> bytes:
    for left, right in path:
        leaf = hashlib.sha256((left.hex() + leaf.hex() + right.hex()).encode()).digest()
    return leaf


def manifest(docs: DataFrame, tampered: Column | None = None, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", fields: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text")) -> DataFrame:
    """A row for each document: its leaf, its source's and the whole table's root, the digest of the siblings on its way up,
    and the root to which its text as ``tampered`` has it (null: unchanged) folds with those siblings."""
    spark = docs.sparkSession
    now = F.coalesce(tampered, F.col(text_col)) if tampered is not None else F.col(text_col)
    own, changed = leaf([F.col(c) for c in fields]), leaf([now if c == text_col else F.col(c) for c in fields])
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"), own.alias("leaf"), F.nullif(changed, own).alias("changed"))
    placed = numbered(rows, "source", ["doc_id", "leaf"], "leaves")
    total, sources, largest = placed.agg(F.count("*"), F.count_if("last"), F.max("number") + 1).first()
    if not total:
        return spark.createDataFrame([], RESULT)
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_dir(spark))
    raw = lambda value: None if value is None else bytes(value)
    leaves = placed.select("rank", "number", "last", "doc_id", "leaf", "changed").rdd.map(lambda r: ((r[0], r[1]), (r[2], raw(r[4]), (r[3], raw(r[5])))))
    levels = climb(leaves, largest, -(-total // EACH))
    roots = tops(levels)
    above = climb(roots.map(lambda r: ((0, r[0]), (r[0] == sources - 1, r[1][0], (r[0], r[1][1])))), sources, -(-sources // EACH))
    ((_, (root, height)),) = tops(above).collect()
    start = context.parallelize([((0, height), None)], 1)
    starts = descend(above, start).map(lambda s: ((s[0][0], s[0][1]), (s[1], s[3])))

    def row(found):
        (doc_id, changed), own, (subroot, upper), path = found
        path = path + upper
        proof = hashlib.sha256("".join([a.hex() + b.hex() for a, b in path]).encode()).hexdigest()
        folded = fold(changed or own, path)
        return doc_id, own.hex(), subroot.hex(), root.hex(), proof, folded.hex(), folded == root

    return spark.createDataFrame(descend(levels, starts).map(row), RESULT)
