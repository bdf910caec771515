"""Operator 5: exact joins on the Jaccard similarity of word shingles, found with parity sketches.

A set's sketch is a row of bits in which every shingle flips the bit its hash names. The Hamming distance of two sketches
is at most the size of the sets' symmetric difference, and a similarity of ``num/den`` bounds that difference by
(a + b)(den - num)/(den + num). Three steps use this:

1. Texts with equal sets are one class, represented by its smallest id.
2. Sets are grouped in bands of sizes; a set also joins the next band if a partner could be there. The sketch is cut into
   as many blocks as a band's largest sets need; a block's value is the XOR of its shingles' hashes. A set's size bounds
   its difference from any partner by t, so that of the blocks, put in one order for all sets (empty ones last), the first
   t + 1 + 2s of two linked sets have 2s + 1 in common at least: these are its keys. Every set leaves out those s of them
   that most sets share (empty ones, and passages that very many texts repeat), so linked sets still meet in one. Sets
   that meet are compared by a second sketch of 256 bits, in square tiles of bounded size, and grouped into clusters.
3. Inside each cluster, again in tiles, sets that are not yet connected and whose sketches allow it are compared exactly.
   Links that hold make the components. A cluster of more than one tile is first compared with ``HUBS`` of its members: what
   they connect into one group need not be compared again, so that only the rest is tiled, with itself and with the group.
   A cluster of copies of one text thus sends each text about once, not once for every tile.

Pairs are never emitted: a tile yields a spanning forest. No partner is lost, whatever the size of a group. Texts are known
by the class of their set, not by their document's id, so that rows that share an id but not a text are told apart.

Words are runs of characters other than ASCII white space, A-Z lower-cased. A text of fewer than k words is one shingle.
A shingle is its 64-bit hash.

Nulls and ties: null and wordless texts have no shingles and link with nothing; a null id keeps its row, with a null
component, and takes no part; equal rows come out once each, in one component; an empty table gives an empty result; other
columns are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from callweave.llm.common import components, rows_to_batches, sorted_groups, tasks_for, written

GROWTH = 2.5  # of the bands' sizes
SKIPPED = 14  # a band's sets leave out one key, and one for so many by which its largest may differ
KEY_BITS = np.uint64((1 << 48) - 1)  # of a key; keys that are equal by chance only make candidates
TILE = 768
TILE_SHINGLES = 400_000
HUBS = 8
PAIRS = 30_000_000  # of sketches to a task
WORDS_KEPT = 100_000  # hashes of words that a task remembers
M1, M2, M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93), np.uint64(0xC2B2AE3D27D4EB4F)
COUNTED = "doc_id long, text_hash long, n int, h1 long, h2 long"
_COUNTED = pa.schema([("doc_id", pa.int64()), ("text_hash", pa.int64()), ("n", pa.int32()), ("h1", pa.int64()), ("h2", pa.int64())])
SIGNED = "doc_id long, text_hash long, n int, s array<long>, own array<long>, own_skip int, up array<long>, up_skip int"
_SIGNED = pa.schema([("doc_id", pa.int64()), ("text_hash", pa.int64()), ("n", pa.int32()), ("s", pa.list_(pa.int64())), ("own", pa.list_(pa.int64())), ("own_skip", pa.int32()), ("up", pa.list_(pa.int64())), ("up_skip", pa.int32())])
_EDGE = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(29))) * M2
    return x ^ (x >> np.uint64(32))


def shingle_hashes(text: str, k: int, kept: dict[bytes, int]) -> np.ndarray:
    """The sorted, distinct hashes of a text's shingles; ``kept`` remembers hashes of words, up to a bound."""
    import xxhash

    words = text.encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    if len(kept) > WORDS_KEPT:
        kept.clear()
    get, one = kept.get, xxhash.xxh64_intdigest
    hashes = []
    for w in words:
        h = get(w)
        if h is None:
            h = kept[w] = one(w)
        hashes.append(h)
    x = np.array(hashes, np.uint64)
    size = min(k, len(words))
    code = x[: len(x) - size + 1] + np.uint64(size)
    for j in range(1, size):
        code = code * M1 + x[j : len(x) - size + 1 + j]
    return np.unique(mixed(code))


def band(n: int) -> int:
    """The band of sizes from GROWTH**b to GROWTH**(b+1)."""
    b = int(np.log(n) / np.log(GROWTH) + 1e-9)
    return b


def band_end(b: int) -> int:
    """The largest size in band ``b``."""
    return int(np.ceil(GROWTH ** (b + 1) * (1 + 1e-9)))


def most_apart(a: int, b: int, num: int, den: int) -> int:
    """The largest symmetric difference of linked sets of sizes ``a`` and ``b``."""
    return (a + b) * (den - num) // (den + num)


def blocks(codes: np.ndarray, b: int, num: int, den: int) -> tuple[np.ndarray, int]:
    """The keys of a set in band ``b``, and how many of them it leaves out."""
    end, n = band_end(b), len(codes)
    t = most_apart(n, min(end, n * den // num), num, den)
    if t == 0:
        return np.zeros(0, np.int64), 0
    most = most_apart(end, end, num, den)
    skip = 1 + most // SKIPPED
    count = most + 1 + 2 * skip
    where = ((codes >> np.uint64(32)) * np.uint64(count) >> np.uint64(32)).astype(np.int64)
    values = np.zeros(count, np.uint64)
    np.bitwise_xor.at(values, where, codes)
    places = np.arange(count, dtype=np.uint64) * M3 + np.full(count, b, np.uint64) * M1
    keys = mixed(mixed(values + np.uint64(1)) + places) & KEY_BITS
    return keys[np.lexsort((keys, values == 0))[: t + 1 + 2 * skip]].view(np.int64), skip


def sketch(codes: np.ndarray) -> np.ndarray:
    """256 bits of parity as four integers."""
    bits = np.bincount((codes & np.uint64(255)).astype(np.int64), minlength=256) & 1
    return np.packbits(bits.astype(np.uint8)).view("<i8")


def texts_of(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, text_hash, text)."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(F.col(text_col).cast("string")).alias("text_hash"), F.col(text_col).cast("string").alias("text"))


def counted(texts: DataFrame, k: int) -> DataFrame:
    """For each text the size and hash of its set."""

    def row(doc: int | None, text_hash: int, text: str | None, kept: dict) -> tuple:
        codes = shingle_hashes(text, k, kept) if text else np.zeros(0, np.uint64)
        return doc, text_hash, len(codes), *set_hash(codes)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[bytes, int] = {}
        yield from rows_to_batches((row(*r, kept) for b in batches for r in zip(*(c.to_pylist() for c in b.columns))), _COUNTED)

    return texts.mapInArrow(task, COUNTED)


def set_hash(codes: np.ndarray) -> tuple[int, int]:
    with np.errstate(over="ignore"):
        return int(codes.sum(dtype=np.uint64).view(np.int64)), int(np.bitwise_xor.reduce(codes * M3).view(np.int64))


def signed(texts: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """For each text with words the size of its set, its sketch, and its keys in its band and the next."""

    def row(doc: int, text_hash: int, codes: np.ndarray) -> tuple:
        n = len(codes)
        own, own_skip = blocks(codes, band(n), num, den)
        above = band(n * den // num)
        up, up_skip = blocks(codes, above, num, den) if above != band(n) else ([], 0)
        return doc, text_hash, n, sketch(codes), own, own_skip, up, up_skip

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[bytes, int] = {}
        sets = ((d, h, shingle_hashes(t, k, kept)) for b in batches for d, h, t in zip(*(c.to_pylist() for c in b.columns)) if t)
        yield from rows_to_batches((row(d, h, codes) for d, h, codes in sets if len(codes)), _SIGNED, 1024)

    return texts.where("doc_id is not null").mapInArrow(task, SIGNED)


def may_link(sketches: np.ndarray, sizes: np.ndarray, x: slice, y: slice, num: int, den: int) -> np.ndarray:
    """Which pairs of two stretches of sets the sizes and sketches allow to link."""
    a, b = sizes[x][:, None], sizes[y][None]
    far = np.zeros((len(a), b.shape[1]), np.int64)
    for w in range(sketches.shape[1]):
        far += np.bitwise_count(sketches[x, w][:, None] ^ sketches[y, w][None])
    return (far * (den + num) <= (a + b) * (den - num)) & (a * den >= b * num) & (b * den >= a * num)


def spanning(allowed: np.ndarray) -> Iterator[tuple[int, int]]:
    """A tree over each component of a symmetric matrix."""
    left = np.ones(len(allowed), bool)
    for root in range(len(allowed)):
        if not left[root]:
            continue
        left[root] = False
        front = np.array([root])
        while len(front):
            front = np.flatnonzero(allowed[front].any(0) & left)
            left[front] = False
            for x in front.tolist():
                yield root, x


def tiled(rows: DataFrame, tiles: str) -> DataFrame:
    """Each row once for every tile of its group that it belongs to: pairs (ti, tj) of its own part with all parts."""
    part = F.pmod(F.xxhash64("id"), F.col(tiles))
    pairs = F.transform(F.sequence(F.lit(0).cast("long"), F.col(tiles) - 1), lambda j: F.struct(F.least("part", j).alias("ti"), F.greatest("part", j).alias("tj")))
    return rows.withColumn("part", part).withColumn("tile", F.explode(pairs)).select("*", "tile.ti", "tile.tj").drop("tile")


def meet(groups: DataFrame, num: int, den: int, tasks: int) -> DataFrame:
    """Forests of the sets that share a key and may link, dealt over so many tasks. Rows: key, ti, tj, part, id, n, s."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for group in sorted_groups(batches, ["key", "ti", "tj"]):
                if len(group) < 2:
                    continue
                ids, sizes = group.column("id").to_numpy(), group.column("n").to_numpy().astype(np.int64)
                sketches = group.column("s").combine_chunks().flatten().to_numpy().view(np.uint64).reshape(len(ids), -1)
                allowed = np.empty((len(ids), len(ids)), bool)
                for at in range(0, len(ids), 256):
                    allowed[at : at + 256] = may_link(sketches, sizes, slice(at, at + 256), slice(None), num, den)
                yield from ((int(ids[a]), int(ids[b])) for a, b in spanning(allowed))

        yield from rows_to_batches(rows(), _EDGE)

    columns = ["key", "ti", "tj", "part", "id", "n", "s"]
    return groups.select(columns).repartition(tasks, "key", "ti", "tj").sortWithinPartitions("key", "ti", "tj").mapInArrow(task, "a long, b long")


def verify(groups: DataFrame, k: int, num: int, den: int, tasks: int) -> DataFrame:
    """Forests of the sets of a cluster that do link. Rows: cluster, ti, tj, part, id, text. In a tile whose ti and tj differ
    only sets of different parts are compared."""
    from callweave.llm.common import Forest

    def links(group: pa.Table, kept: dict[bytes, int]) -> Iterator[tuple[int, int]]:
        ids, parts = group.column("id").to_pylist(), group.column("part").to_numpy()
        across = group.column("ti")[0].as_py() != group.column("tj")[0].as_py()
        sets = [shingle_hashes(t, k, kept) for t in group.column("text").to_pylist()]
        sizes = np.array([len(s) for s in sets], np.int64)
        sketches = np.array([sketch(s) for s in sets]).view(np.uint64)
        codes = np.split(np.unique(np.concatenate(sets), return_inverse=True)[1], np.cumsum(sizes)[:-1])
        mark, forest = np.zeros(1 + max(int(c.max()) for c in codes), bool), Forest(len(ids))
        roots = np.arange(len(ids))
        for x in range(len(ids) - 1):
            allowed = may_link(sketches, sizes, slice(x, x + 1), slice(x + 1, None), num, den)[0]
            if across:
                allowed &= parts[x + 1 :] != parts[x]
            if not allowed.any():
                continue
            mark[codes[x]] = True
            for y in (np.flatnonzero(allowed & (roots[x + 1 :] != roots[x])) + x + 1).tolist():
                if roots[y] == roots[x]:
                    continue
                both = int(np.count_nonzero(mark[codes[y]]))
                if den * both >= num * (sizes[x] + sizes[y] - both):
                    forest.join(x, y)
                    roots[roots == roots[y]] = roots[x]
                    yield ids[x], ids[y]
            mark[codes[x]] = False

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[bytes, int] = {}
        yield from rows_to_batches((e for g in sorted_groups(batches, ["cluster", "ti", "tj"]) if len(g) > 1 for e in links(g, kept)), _EDGE)

    columns = ["cluster", "ti", "tj", "part", "id", "text"]
    return groups.select(columns).repartition(tasks, "cluster", "ti", "tj").sortWithinPartitions("cluster", "ti", "tj").mapInArrow(task, "a long, b long")


def connected(members: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """(a, b): links that connect the clusters' members. Rows: cluster, id, n, text, each id once."""
    spark = members.sparkSession
    size = members.groupBy("cluster").agg(F.count("*").alias("members"), F.sum("n").alias("shingles"))
    tiles = F.greatest(F.ceil(F.col("members") / TILE), F.ceil(F.col("shingles") / TILE_SHINGLES))
    size = written(size.withColumn("tiles", tiles), "cluster-sizes")
    total = size.agg(F.sum(F.col("members") * F.least("members", F.lit(TILE))).alias("pairs"), F.max("tiles").alias("tiles")).first()
    tasks = tasks_for(spark, total["pairs"] or 0, PAIRS // 100)
    rows = members.join(size.select("cluster", "tiles"), "cluster")
    links = verify(tiled(rows.where("tiles = 1"), "tiles"), k, num, den, tasks)
    if (total["tiles"] or 0) <= 1:
        return links
    large = rows.where("tiles > 1").withColumn("part", F.pmod(F.xxhash64("id"), F.col("tiles")))
    centres = large.join(chosen_hubs(large), ["cluster", "id"], "left_semi").withColumn("ti", F.explode(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1)))
    first = large.withColumn("ti", F.col("part")).unionByName(centres.withColumn("part", F.lit(-2).cast("long"))).withColumn("tj", F.lit(-1).cast("long"))
    near = written(verify(first, k, num, den, tasks), "hub-links")
    groups = components(near, "hub-groups")
    labels = large.select("cluster", "id").join(groups.select(F.col("node").alias("id"), "component"), "id", "left").select("cluster", "id", F.coalesce("component", "id").alias("label"))
    labels = written(labels, "hub-labels")
    main = labels.groupBy("cluster", "label").agg(F.count("*").alias("n")).groupBy("cluster").agg(F.max_by("label", F.struct("n", "label")).alias("main"))
    main = written(main, "main-labels")  # one row a large cluster, so that Spark sees how small it is
    parted = large.drop("part").join(labels, ["cluster", "id"]).join(main, "cluster").withColumn("rest", F.col("label") != F.col("main"))
    many = F.greatest(F.lit(1), F.ceil(F.count_if("rest") * F.first("tiles") / F.count("*"))).alias("rest_tiles")
    parted = parted.join(written(parted.groupBy("cluster").agg(many), "rest-tiles"), "cluster")
    rest = parted.where("rest")
    inner = tiled(rest, "rest_tiles")
    sides = rest.select("cluster", "rest_tiles").distinct()
    across = rest.withColumn("part", F.pmod(F.xxhash64("id"), F.col("rest_tiles"))).withColumn("tj", F.col("part")).withColumn("ti", F.explode(F.sequence(-F.col("tiles"), F.lit(-1).cast("long"))))
    others = parted.where("not rest").join(sides.select("cluster"), "cluster", "left_semi").withColumn("ti", -1 - F.pmod(F.xxhash64("id"), F.col("tiles"))).withColumn("part", F.lit(-1).cast("long"))
    others = others.withColumn("tj", F.explode(F.sequence(F.lit(0).cast("long"), F.col("rest_tiles") - 1)))
    columns = ["cluster", "ti", "tj", "part", "id", "text"]
    left = verify(inner.select(columns).unionByName(across.select(columns)).unionByName(others.select(columns)), k, num, den, tasks)
    return links.unionByName(near).unionByName(left)


def chosen_hubs(large: DataFrame) -> DataFrame:
    """(cluster, id) of HUBS members of each cluster: the least by hash in so many shares of it. Aggregated before the shuffle."""
    share = F.pmod(F.xxhash64("id", F.lit(2)), F.lit(HUBS))
    best = large.groupBy("cluster", share.alias("share")).agg(F.min_by("id", F.xxhash64("id", F.lit(1))).alias("id"))
    return best.select("cluster", "id")


def grouped(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """What :func:`link` returns, and text_hash, the xxhash64 of each row's text."""
    spark, every = docs.sparkSession, texts_of(docs, id_col, text_col)
    sets = written(counted(every, k), "sets")
    some = sets.where("n > 0 and doc_id is not null")
    classes = some.groupBy("h1", "h2", "n").agg(F.min(F.struct("doc_id", "text_hash")).alias("rep"))
    classes = written(classes.select("h1", "h2", "n", "rep.doc_id", "rep.text_hash", F.monotonically_increasing_id().alias("id")), "classes")
    reps = signed(every, k, num, den).join(classes.select("doc_id", "text_hash", "id"), ["doc_id", "text_hash"])
    reps = written(reps.drop("doc_id", "text_hash").dropDuplicates(["id"]), "representatives", compression="zstd")

    def keys(column: str, up: bool) -> DataFrame:
        return reps.select("id", F.explode(column).alias("key"), F.lit(up).alias("up"))

    rows = keys("own", False).unionByName(keys("up", True))
    shared = written(rows.groupBy("key").agg(F.count("*").alias("count")).where("count > 1"), "shared-keys")
    pairs = shared.agg(F.sum(F.col("count") * F.least("count", F.lit(TILE)))).first()[0] or 0
    order = Window.partitionBy("id", "up").orderBy(F.desc("count"), "key")
    skip = F.when(F.col("up"), F.col("up_skip")).otherwise(F.col("own_skip"))
    met = rows.join(shared, "key").join(reps.select("id", "n", "s", "own_skip", "up_skip"), "id")
    met = met.withColumn("rank", F.row_number().over(order)).where(F.col("rank") > skip).select("key", "id", "n", "s", "count").withColumn("tiles", F.ceil(F.col("count") / TILE))
    clusters = components(meet(tiled(met, "tiles"), num, den, tasks_for(spark, pairs, PAIRS)), "clusters")
    clusters = clusters.select(F.col("node").alias("id"), F.col("component").alias("cluster")).join(classes.select("id", "doc_id", "text_hash", "n"), "id")
    members = clusters.join(every, ["doc_id", "text_hash"]).dropDuplicates(["id"])
    members = written(members.select("cluster", "id", "n", "text"), "members", compression="zstd")
    found = components(connected(members, k, num, den), "links")
    least = found.join(classes.select(F.col("id").alias("node"), "doc_id"), "node").groupBy("component").agg(F.min("doc_id").alias("least"))
    merged = found.join(least, "component").select(F.col("node").alias("id"), "least")
    merged = classes.join(merged, "id", "left").select("h1", "h2", "n", F.coalesce("least", "doc_id").alias("component"))
    out = sets.join(merged, ["h1", "h2", "n"], "left")
    component = F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "text_hash", F.col("n").cast("long").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), component).alias("component_id"))


def link(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each document: doc_id, n_shingles and component_id, the smallest id that links lead to.

    Documents link when den * (size of the intersection) >= num * (size of the union) of their sets of k-word shingles.
    Rows that share an id but not a text have a row each, with the component of their own text.
    """
    return grouped(docs, k, num, den, id_col, text_col).drop("text_hash")
