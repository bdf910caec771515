"""Weighted edges with provenance and tags: roll-up, merge and comparison."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CALL_DEPENDENCY = "CALL_DEP"
EDGE = "source string, target string, type string, weight bigint, provenance array<string>, tags map<string,string>"


def edge_rollup(contributions: DataFrame, keys: list[str], *more: Column) -> DataFrame:
    """One edge a key: weight counts the contributions, or sums their ``weight`` where they have one. Any order gives the same
    edges; the sums are partial before the shuffle."""
    weight = F.sum("weight") if "weight" in contributions.columns else F.count("*")
    return contributions.groupBy(*keys).agg(weight.alias("weight"), *more)


def call_edges(contributions: DataFrame, provenance: str) -> DataFrame:
    """Edges from (source, target, ordinal, tags), and weight if contributions are groups. Tags of the first contribution hold; the mark of a virtual dispatch
    holds if any contribution carries it."""
    rta = F.coalesce(F.col("tags")["ts.dispatch"] == "rta", F.lit(False))
    rows = edge_rollup(contributions, ["source", "target"], F.bool_or(rta).alias("rta"), F.min_by("tags", "ordinal").alias("first"))
    plain = F.map_filter(F.coalesce("first", F.create_map().cast("map<string,string>")), lambda k, v: k != "ts.dispatch")
    tags = F.when(F.col("rta"), F.map_concat(plain, F.create_map(F.lit("ts.dispatch"), F.lit("rta")))).otherwise(plain)
    return rows.select("source", "target", F.lit(CALL_DEPENDENCY).alias("type"), "weight", F.array(F.lit(provenance)).alias("provenance"), tags.alias("tags"))


def merge_edges(base: DataFrame, overlay: DataFrame) -> DataFrame:
    """Both providers' edges: weights add up, provenance is the ordered union, the base's tags win."""
    left, right = base.alias("l"), overlay.alias("r")
    joined = left.join(right, ["source", "target"], "full_outer")
    none, no_tags = F.array().cast("array<string>"), F.create_map().cast("map<string,string>")
    ours, theirs = F.coalesce("l.tags", no_tags), F.coalesce("r.tags", no_tags)
    extra = F.map_filter(theirs, lambda k, v: ~F.map_contains_key(ours, k))
    return joined.select(
        "source", "target", F.coalesce("l.type", "r.type").alias("type"), (F.coalesce("l.weight", F.lit(0)) + F.coalesce("r.weight", F.lit(0))).alias("weight"),
        F.array_union(F.coalesce("l.provenance", none), F.coalesce("r.provenance", none)).alias("provenance"), F.map_concat(ours, extra).alias("tags"),
    )


def base_wins_union(base: DataFrame, overlay: DataFrame, keys: list[str]) -> DataFrame:
    """All of ``base`` and those rows of ``overlay`` whose key ``base`` lacks."""
    return base.unionByName(overlay.join(base.select(*keys).distinct(), keys, "left_anti").select(*base.columns))


def edge_diff(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """One row: how many keys both have, only the left one, only the right one."""
    a, b = left.select(*keys, F.lit(1).alias("in_left")).distinct(), right.select(*keys, F.lit(1).alias("in_right")).distinct()
    both = a.join(b, keys, "full_outer")
    return both.agg(F.count_if(F.col("in_left").isNotNull() & F.col("in_right").isNotNull()).alias("shared"), F.count_if(F.col("in_right").isNull()).alias("only_left"), F.count_if(F.col("in_left").isNull()).alias("only_right"))


def gate(rows: DataFrame, universe: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose key is known."""
    return rows.join(universe.select(*keys).distinct(), keys, "left_semi")
