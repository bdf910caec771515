"""Snapshots by content hash: what changed, patches, and what to drop."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def module_diff(new: DataFrame, old: DataFrame, keys: list[str], new_hash: str, old_hash: str) -> DataFrame:
    """All keys of either side with their state: added, changed, unchanged or removed. A null hash counts as changed."""
    a, b = new.select(*keys, F.col(new_hash).alias("new_hash"), F.lit(True).alias("in_new")), old.select(*keys, F.col(old_hash).alias("old_hash"), F.lit(True).alias("in_old"))
    state = F.when(F.col("in_old").isNull(), "added").when(F.col("in_new").isNull(), "removed").when(F.coalesce(F.col("new_hash") == F.col("old_hash"), F.lit(False)), "unchanged").otherwise("changed")
    return a.join(b, keys, "full_outer").select(*keys, state.alias("state"))


def patch(old: Column, new: Column) -> Column:
    """A map of properties with another set over it: new ones override, absent ones stay."""
    none = F.create_map().cast("map<string,string>")
    kept = F.map_filter(F.coalesce(old, none), lambda k, v: ~F.map_contains_key(F.coalesce(new, none), k))
    return F.map_concat(kept, F.coalesce(new, none))


def upsert(target: DataFrame, delta: DataFrame, keys: list[str]) -> DataFrame:
    """``target`` patched with ``delta``: its non-null values override, unknown keys are added."""
    others = [c for c in target.columns if c not in keys]
    joined = target.alias("t").join(delta.alias("d"), keys, "full_outer")
    return joined.select(*keys, *[F.coalesce(f"d.{c}", f"t.{c}").alias(c) if c in delta.columns else F.col(f"t.{c}").alias(c) for c in others])


def prune(rows: DataFrame, kept: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose key is gone."""
    return rows.join(kept.select(*keys).distinct(), keys, "left_anti")
