"""First and last rows of a key, batches, and innermost containers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from callweave.sources.storage import stored

BLOCK = 6  # an innermost range is looked up in the 64 places around a point

def first_wins(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key. A minimum by a struct, so it is aggregated before the shuffle and needs no sort."""
    best = rows.groupBy(*keys).agg(F.min_by(F.struct(*rows.columns), F.struct(*order)).alias("r"))
    return best.select("r.*")


def last_wins(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    best = rows.groupBy(*keys).agg(F.max_by(F.struct(*rows.columns), F.struct(*order)).alias("r"))
    return best.select("r.*")


def batches(rows: DataFrame, keys: list[str], order: list[Column], size: int) -> DataFrame:
    """``rows`` with the number of their batch inside their key, ``size`` rows to a batch.

    Rows are dealt by ranges of key and order and numbered inside each range; what stands before a range of the same key is
    a sum over a small table of counts. So a key with very many rows is spread over tasks. Rows that tie stand in any order.
    """
    ranged = rows.repartitionByRange(*keys, *order).withColumn("_range", F.spark_partition_id())
    ranged = stored(ranged, "ranged")
    counts = ranged.groupBy(*keys, "_range").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.select(*[F.col(k).alias(f"_key{n}") for n, k in enumerate(keys)], F.col("_range").alias("_key_range"), before.alias("_before"))
    number = F.row_number().over(Window.partitionBy("_range", *keys).orderBy(*order))
    same = F.col("_range") == F.col("_key_range")
    for n, k in enumerate(keys):
        same &= F.col(k).eqNullSafe(F.col(f"_key{n}"))
    placed = ranged.withColumn("_number", number).join(counts, same)
    return placed.withColumn("batch", F.floor((F.col("_before") + F.col("_number") - 1) / size)).select(*rows.columns, "batch")


def cells(start: Column, end: Column, bits: int) -> Column:
    """The cells (level, cell), at most two of each level, that cover the places from ``start`` up to ``end`` exactly; a cell
    of level k is 2 ** k places wide. Empty if the range is."""

    def level(k: Column) -> Column:
        below = F.call_function("shiftleft", F.lit(1).cast("long"), k) - 1
        low, high = F.call_function("shiftright", start + below, k), F.call_function("shiftright", end, k)
        both = F.array(F.when(low % 2 == 1, low), F.when(high % 2 == 1, high - 1))
        return F.when(low < high, F.transform(F.filter(both, lambda c: c.isNotNull()), lambda c: F.struct(k.alias("level"), c.alias("cell"))))

    return F.flatten(F.filter(F.transform(F.sequence(F.lit(0), F.lit(bits)), level), lambda x: x.isNotNull()))


def innermost(points: DataFrame, ranges: DataFrame, on: list[str], point_key: list[str], at: str, start: str, end: str) -> DataFrame:
    """``points`` with the columns of the range of the same ``on`` that holds ``at`` and starts last; points in none are left out.

    Places are whole numbers from 0; a range holds ``start`` and not ``end``; of ranges with equal starts the one that ends
    first holds. Ranges may nest or cross. Each range is cut into cells of doubling width, two of a level at most, and a cell
    keeps the range that starts last. Cells of up to ``2 ** BLOCK`` places meet in the block they lie in, one row with a range
    for each place; wider ones are asked for by blocks that hold points, one range a block. So a point passes the shuffle once and
    meets one row, and a key with very many ranges is dealt over tasks by its blocks. Ranges without a place, and points
    without one or without a ``point_key``, take no part.
    """
    good = ranges.where((F.col(start) >= 0) & (F.col(end) > F.col(start))).dropna(subset=on)
    body = [c for c in ranges.columns if c not in on]
    widest, longest = good.agg(F.max(end), F.max(F.col(end) - F.col(start))).first()
    if widest is None:
        others = [f for f in ranges.schema.fields if f.name not in on and f.name not in points.columns]
        return points.where("false").select("*", *[F.lit(None).cast(f.dataType).alias(f.name) for f in others])
    shift = lambda way, value, n: F.call_function(f"shift{way}", value, n)
    held = F.struct(*body)
    cut = good.groupBy(*on, start, end).agg(F.max_by(held, F.to_json(held)).alias("_range"))
    cut = cut.select(*on, "_range", F.explode(cells(F.col(start).cast("long"), F.col(end).cast("long"), int(widest).bit_length())).alias("_c"))
    last = F.max_by("_range", F.struct(F.col(f"_range.{start}"), -F.col(f"_range.{end}"))).alias("_range")
    best = cut.groupBy(*on, F.col("_c.level").alias("_level"), F.col("_c.cell").alias("_cell")).agg(last)
    asked = points.where(F.col(at) >= 0).dropna(subset=[*on, *point_key]).withColumn("_block", F.shiftright(F.col(at).cast("long"), BLOCK))
    if longest >= 2 << BLOCK:  # no range has a wider cell than itself
        best = stored(best, "cells")
        levels = [r[0] for r in best.where(F.col("_level") > BLOCK).select("_level").distinct().collect()]  # a few dozen at most
        probes = asked.select(*on, "_block").distinct().withColumn("_level", F.explode(F.array(*[F.lit(k) for k in levels]).cast("array<int>")))
        probes = probes.withColumn("_cell", shift("right", F.col("_block"), F.col("_level") - BLOCK))
        wide = probes.join(best, [*on, "_level", "_cell"]).groupBy(*on, "_block").agg(last).select(*on, "_block", F.lit(0).alias("_node"), "_range")
    below = F.lit(BLOCK) - F.col("_level")
    first = shift("left", F.lit(1).cast("long"), below)  # cells of a block are numbered level by level, from 1
    inner = best.where(F.col("_level") <= BLOCK).withColumn("_block", shift("right", F.col("_cell"), below))
    inner = inner.select(*on, "_block", (first + F.col("_cell") - shift("left", F.col("_block"), below)).cast("int").alias("_node"), "_range")
    nodes = inner.unionByName(wide) if longest >= 2 << BLOCK else inner
    tree = F.col("_tree")

    def winner(place: Column) -> Column:
        around = F.array(F.lit(0), *[F.shiftright(place + 2**BLOCK, k) for k in range(BLOCK + 1)])
        found = F.transform(around, lambda n: F.struct(F.try_element_at(tree, n)[start].alias("s"), (-F.try_element_at(tree, n)[end]).alias("e"), n.alias("n")))
        return F.try_element_at(tree, F.array_max(F.filter(found, lambda c: c["s"].isNotNull()))["n"])

    blocks = nodes.groupBy(*on, "_block").agg(F.map_from_entries(F.collect_list(F.struct("_node", "_range"))).alias("_tree"))  # 128 at most
    blocks = blocks.select(*on, "_block", F.transform(F.sequence(F.lit(0), F.lit(2**BLOCK - 1)), winner).alias("_places"))
    met = asked.join(blocks, [*on, "_block"]).withColumn("_range", F.get("_places", F.col(at).cast("long").bitwiseAND(2**BLOCK - 1).cast("int")))
    return met.where("_range is not null").select(*points.columns, *[F.col(f"_range.{c}").alias(c) for c in body if c not in points.columns])


def latest(points: DataFrame, marks: DataFrame, on: list[str], at: str, since: str, tie: list[str]) -> DataFrame:
    """``points`` with the columns of the last mark of the same ``on`` before ``at``; points without one are left out.

    Of marks at one time the last by ``tie`` holds. Points and marks are dealt together by ranges of key and time; each range
    hands its last mark of a key on to the ranges that follow, one row for each range and key. So a key with most of the rows
    is spread over tasks, and no point meets more than one mark. Rows without a key or a time take no part.
    """
    body = [c for c in marks.columns if c not in on]
    point = points.select(*on, F.col(at).alias("_time"), F.lit(0).alias("_kind"), F.struct(*points.columns).alias("_point"), F.lit(None).cast(marks.select(F.struct(*body)).schema[0].dataType).alias("_mark"))
    mark = marks.select(*on, F.col(since).alias("_time"), F.lit(1).alias("_kind"), F.lit(None).cast(points.select(F.struct(*points.columns)).schema[0].dataType).alias("_point"), F.struct(*body).alias("_mark"))
    both = point.unionByName(mark).dropna(subset=[*on, "_time"])
    order = ["_time", "_kind", *[f"_mark.{t}" for t in tie]]
    ranged = stored(both.repartitionByRange(*on, *order).withColumn("_range", F.spark_partition_id()), "ranged")
    held = ranged.where("_kind = 1").groupBy(*on, "_range").agg(F.max_by("_mark", F.struct(*order)).alias("_held"))
    parts = ranged.select(*on, "_range").distinct().join(held, [*on, "_range"], "left")
    before = F.last("_held", ignorenulls=True).over(Window.partitionBy(*on).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    parts = parts.select(*on, "_range", before.alias("_before"))
    inside = F.last("_mark", ignorenulls=True).over(Window.partitionBy(*on, "_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    found = ranged.withColumn("_own", inside).where("_kind = 0").join(parts, [*on, "_range"])
    found = found.withColumn("_mark", F.coalesce("_own", "_before")).where("_mark is not null")
    return found.select("_point.*", *[F.col(f"_mark.{c}").alias(c) for c in body if c not in points.columns])
