"""Operator 10: benchmark passages in documents, by SimHash of item-sized windows. DataFrame functions only.

1. Every position of every document is looked up among the items' five-word shingles. A window of the item's length that
   reaches the similarity asked for has a least number of positions where one of the item's shingles stands, in whatever
   order; all windows with so many hits are candidates, wherever in the item the hits belong. All other windows are thereby
   excluded without loss.
2. Windows of equal text become one. Each gets a SimHash of 64 bits over its shingles, counted as often as they occur.
3. Fingerprints are cut into ``BLOCKS`` blocks. If a window's and an item's differ in at most ``radius`` bits, then in one
   block at least by no more than ``radius`` / ``BLOCKS`` bits. Each item is entered under all values so near to its own, in
   each block, so a join on blocks finds all such pairs. The item's bag of shingles, by which step 1 found the window, is part
   of the join's key: a window meets the items whose shingles it holds enough of, and no others.
4. Candidates are verified by exact weighted similarity: the sum over shingles of the smaller count, divided by the sum of
   the larger one.

At similarity 0.8 the expected distance is about 10 of 64 bits, with a deviation of 3; the default radius is 19. So the steps
1, 3 and 4 lose nothing, and step 2 loses a pair whose fingerprints are further apart than that: the tests ask for every
pair at 0.85 and for 97 of 100 at 0.8, in passages edited, rotated, swapped and interleaved.

Words are runs of characters other than ASCII white space, in lower case. Nulls and ties: null texts and texts of fewer than
five words match nothing, items of fewer than five words are matched by nothing; rows without an id are judged like others (``find``,
which gives pairs of ids, leaves them out), as are rows that share an id but not a text; equal rows match alike and give one row; empty tables give an empty result; other
columns are left out.
The items' shingles are broadcast only if there are at most ``BROADCAST_ROWS`` of them, else joined by a shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from callweave.llm.common import bound, written

SHINGLE = 5
BROADCAST_ROWS = 1_000_000
BLOCKS = 7
LANES = 0x0001000100010001


def words(text: Column) -> Column:
    return F.split(F.trim(F.regexp_replace(F.lower(text), r"[\x20\x09-\x0D]+", " ")), " ")


def shingles(row: str, count: Column) -> Column:
    """The hashes of the shingles of an array column of ``count`` words, in order."""
    w = F.col(row)
    return F.transform(F.sequence(F.lit(0), count - SHINGLE), lambda i: F.xxhash64(*[F.get(w, i + j) for j in range(SHINGLE)]))


def simhash(hashes: Column) -> Column:
    """64 bits, each the majority of that bit among ``hashes``.

    Bits are counted four at a time, sixteen bits apart in one sum; arrays too long for such counters are counted bit by bit."""

    def counted(h: Column) -> Column:
        lane = lambda k: F.aggregate(h, F.lit(0).cast("long"), lambda n, x: n + F.shiftright(x, k).bitwiseAND(F.lit(LANES)))
        return bound(F.array(*map(lane, range(16))), lambda s: majority(lambda k: F.shiftright(F.get(s, F.lit(k % 16)), k // 16 * 16).bitwiseAND(F.lit(0xFFFF)), F.size(h)))

    def single(h: Column) -> Column:
        return majority(lambda k: F.aggregate(h, F.lit(0).cast("long"), lambda n, x: n + F.shiftright(x, k).bitwiseAND(F.lit(1).cast("long"))), F.size(h))

    return bound(hashes, lambda h: F.when(F.size(h) < 1 << 16, counted(h)).otherwise(single(h)))


def majority(count, of: Column) -> Column:
    """The number whose bit k is set where ``count(k)`` is more than half of ``of``."""
    bits = [F.when(count(k) * 2 > of, F.lit((1 << k) - (1 << 64 if k == 63 else 0)).cast("long")).otherwise(F.lit(0).cast("long")) for k in range(64)]
    while len(bits) > 1:
        bits = [a.bitwiseOR(b) for a, b in zip(bits[::2], bits[1::2])]
    return bits[0]


def blocks(fingerprint: Column, near: int = 0) -> Column:
    """(block, bits) of each block of a fingerprint, with ``near`` also all values that differ in so many bits of it."""
    cuts = [64 * k // BLOCKS for k in range(BLOCKS + 1)]

    def block(k: int) -> Column:
        full = F.lit((1 << (cuts[k + 1] - cuts[k])) - 1).cast("long")
        own = F.shiftright(fingerprint, cuts[k]).bitwiseAND(full)
        if not near:
            return F.array(F.struct(F.lit(k).alias("block"), own.alias("bits")))
        flips = F.filter(F.sequence(F.lit(0).cast("long"), full), lambda x: F.bit_count(x) <= near)
        return F.transform(flips, lambda x: F.struct(F.lit(k).alias("block"), own.bitwiseXOR(x).alias("bits")))

    return F.flatten(F.array(*map(block, range(BLOCKS))))


def weighted_similarity(a: str, b: str) -> Column:
    """Sum of the smaller counts over the sum of the larger ones of two bags of hashes."""
    both = F.aggregate(F.array_distinct(F.col(a)), F.lit(0), lambda n, k: n + F.least(F.size(F.filter(a, lambda x: x == k)), F.size(F.filter(b, lambda x: x == k))))
    return both / (F.size(a) + F.size(b) - both)


def prepared(items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    rows = items.select(F.col(id_col).cast("long").alias("item_id"), words(F.col(text_col)).alias("w")).withColumn("len", F.size("w")).where(F.col("len") >= SHINGLE)
    rows = rows.withColumn("item_hashes", shingles("w", F.col("len"))).withColumn("item_print", simhash(F.col("item_hashes")))
    return rows.select("item_id", "len", "item_hashes", "item_print", F.xxhash64(F.array_sort("item_hashes")).alias("bag"))


def anchors(items: DataFrame) -> DataFrame:
    """(shingle, len, bag): the shingles of each item; items that hold the same ones equally often are one bag."""
    return items.select(F.explode("item_hashes").alias("shingle"), "len", "bag").distinct()


def starts(docs: DataFrame, marks: DataFrame, least: float, few: bool) -> DataFrame:
    """(doc_id, text_hash, starts): for each text, and each item's length and bag, where windows with enough positions at
    which a shingle of the item stands begin.

    Of a window with m shingles and an item with n, at least ``least`` (m + n) / (1 + ``least``) are common to both. Each run
    of so many hits, one after the other, that fits into a window gives all starts of windows that hold it; runs come in
    order, so each gives what goes beyond the one before."""
    texts = docs.select("doc_id", "text_hash", words(F.col("text")).alias("w")).withColumn("n", F.size("w")).where(F.col("n") >= SHINGLE)
    places = texts.select("doc_id", "text_hash", "n", F.posexplode(shingles("w", F.col("n"))).alias("i", "shingle"))
    met = places.join(F.broadcast(marks) if few else marks, "shingle")
    hits = met.groupBy("doc_id", "text_hash", "n", "len", "bag").agg(F.sort_array(F.collect_set("i")).alias("hits"))
    held = F.least("n", "len") - (SHINGLE - 1)
    need = F.ceil((held + F.col("len") - (SHINGLE - 1)) * (least / (1 + least)) - 1e-9).cast("int")
    hits = hits.withColumn("held", held).withColumn("need", F.greatest(need, F.lit(1))).where(F.size("hits") >= F.col("need"))
    high = lambda k: F.least(F.get("hits", k), F.greatest(F.lit(0), F.col("n") - F.col("len")))
    before = lambda k: F.when(k > 0, high(k - 1)).otherwise(F.lit(-1))
    low = lambda k: F.greatest(F.lit(0), F.get("hits", k + F.col("need") - 1) - F.col("held") + 1, before(k) + 1)
    run = lambda k: F.when(low(k) <= high(k), F.sequence(low(k), high(k))).otherwise(F.array().cast("array<int>"))
    found = hits.withColumn("starts", F.flatten(F.transform(F.sequence(F.lit(0), F.size("hits") - F.col("need")), run))).where("size(starts) > 0")
    return found.groupBy("doc_id", "text_hash").agg(F.collect_list(F.struct("len", "bag", "starts")).alias("starts"))


def windows(docs: DataFrame, marks: DataFrame, least: float, id_col: str, text_col: str, few: bool) -> DataFrame:
    """(doc_id, text_hash, start, len, bag, window): windows with enough hits of an item of that bag.

    A document is known by its id, null or not, and its text: equal rows are one. Texts are shuffled once, as text and not as
    words, to meet their starts, at every size alike, and are cut into words once for all their starts. Of windows of one
    text that are equal the first is kept."""
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(F.col(text_col).cast("string")).alias("text_hash"), F.col(text_col).cast("string").alias("text"))
    found = written(starts(own, marks, least, few), "starts").toDF("start_id", "start_hash", "starts")
    met = own.join(found.hint("merge"), F.col("doc_id").eqNullSafe(F.col("start_id")) & (F.col("text_hash") == F.col("start_hash")))
    cut = lambda w, s: F.transform(s["starts"], lambda at: F.struct(F.array_join(F.slice(w, at + 1, s["len"]), " ").alias("window"), s["len"].alias("len"), s["bag"].alias("bag"), at.alias("start")))
    every = bound(words(F.col("text")), lambda w: F.flatten(F.transform("starts", lambda s: cut(w, s))))
    rows = met.select("doc_id", "text_hash", F.explode(every).alias("x")).select("doc_id", "text_hash", "x.*")
    return rows.groupBy("doc_id", "text_hash", "len", "bag", "window").agg(F.min("start").alias("start"))


def matches(docs: DataFrame, items: DataFrame, least: float = 0.8, radius: int = 19, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(doc_id, text_hash, item_id, similarity, start): the best window of each document, known by its id and its text's
    xxhash64, for each item that it reaches ``least`` with; start is the window's first word. Ties go to the first window."""
    ready = written(prepared(items, item_col, item_text_col), "items")
    marks = anchors(ready)
    met = written(windows(docs, marks, least, id_col, text_col, marks.count() <= BROADCAST_ROWS), "windows")
    texts = met.select("window", "len", "bag").distinct().withColumn("w", F.split("window", " "))
    texts = texts.withColumn("hashes", shingles("w", F.size("w"))).withColumn("print", simhash(F.col("hashes"))).select("window", "len", "bag", "hashes", "print")
    texts = written(texts, "prints")
    left = texts.select("window", "len", "bag", "print", F.explode(blocks(F.col("print"))).alias("k")).select("window", "len", "bag", "print", "k.block", "k.bits")
    right = ready.select("item_id", "len", "bag", "item_print", F.explode(blocks(F.col("item_print"), radius // BLOCKS)).alias("k")).select("item_id", "len", "bag", "item_print", "k.block", "k.bits")
    close = left.join(right, ["len", "bag", "block", "bits"]).where(F.bit_count(F.col("print").bitwiseXOR(F.col("item_print"))) <= radius)
    close = close.select("window", "len", "bag", "item_id").distinct().join(texts.select("window", "len", "bag", "hashes"), ["window", "len", "bag"]).join(ready.select("item_id", "item_hashes"), "item_id")
    sure = close.withColumn("similarity", weighted_similarity("hashes", "item_hashes")).where(F.col("similarity") >= least).select("window", "len", "item_id", "similarity").distinct()
    places = met.groupBy("doc_id", "text_hash", "window", "len").agg(F.min("start").alias("start"))
    best = F.max_by(F.struct("similarity", "start"), F.struct("similarity", -F.col("start"))).alias("best")
    found = places.join(sure, ["window", "len"]).groupBy("doc_id", "text_hash", "item_id").agg(best)
    return found.select("doc_id", "text_hash", "item_id", "best.similarity", F.col("best.start").cast("long").alias("start"))


def find(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """(doc_id, item_id, similarity, start) as :func:`matches` has them, of rows with an id; of rows that share one, the best."""
    best = F.max_by(F.struct("similarity", "start"), F.struct("similarity", -F.col("start"))).alias("best")
    return matches(docs, items, **options).where("doc_id is not null").groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", "best.similarity", "best.start")
