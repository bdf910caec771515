"""Transitive closure and the expansion of calls over subtypes."""

from __future__ import annotations

from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callweave.sources.storage import stored


def fixpoint_closure(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """(seed, node, depth): every node that ``edges`` (parent, child) lead to from ``seeds`` (seed), with the least depth.

    Each round joins the frontier alone and drops what has been reached, so cycles end: the last round is one
    that finds nothing. Rounds are written tables, and many of them are joined into one, so that deep chains keep plans short.
    """
    edges = edges.select("parent", "child").distinct()
    reached = stored(seeds.select("seed", F.col("seed").alias("node"), F.lit(0).alias("depth")).distinct(), "closure")
    parts, frontier = [reached], reached
    for depth in count(1):
        seen = parts[0]
        for p in parts[1:]:
            seen = seen.unionByName(p)
        step = frontier.join(edges, frontier["node"] == edges["parent"]).select("seed", F.col("child").alias("node")).distinct()
        frontier = stored(step.join(seen.select("seed", "node"), ["seed", "node"], "left_anti").withColumn("depth", F.lit(depth)), "closure")
        if frontier.isEmpty():
            break
        parts.append(frontier)
        if len(parts) > 20:
            later = parts[1]
            for p in parts[2:]:
                later = later.unionByName(p)
            parts = [reached, stored(later, "closure")]
    out = parts[1] if len(parts) > 1 else parts[0].where("false")
    for p in parts[2:]:
        out = out.unionByName(p)
    return out


def ancestors(edges: DataFrame) -> DataFrame:
    """(node, ancestor, depth) of a forest ``edges`` (parent, child), in which a node has one parent at most.

    Distances double: what stands up to n above a node, and what stands up to n above its n-th ancestor, is what stands up to
    2 n above it. So a chain of a thousand takes ten rounds, not a thousand. Null ends and loops from a node to itself are
    dropped; a node with two parents, or a cycle, is an error.
    """
    links = stored(edges.where("parent is not null and child is not null and parent <> child").select(F.col("child").alias("node"), F.col("parent").alias("ancestor")).distinct(), "links")
    nodes, distinct = links.agg(F.count("*"), F.countDistinct("node")).first()
    if nodes != distinct:
        raise ValueError("a node has two parents")
    near, jump, n = links.withColumn("depth", F.lit(1)), links.withColumnRenamed("ancestor", "via"), 1
    parts = [near]
    while n <= 2 * max(nodes, 1):
        far = near.select(F.col("node").alias("via"), "ancestor", (F.col("depth") + n).alias("depth"))
        near = stored(jump.join(far, "via").select("node", "ancestor", "depth"), "doubled")
        if near.isEmpty():
            return union_of(parts)
        parts.append(near)
        jump, n = near.where(F.col("depth") == 2 * n).select("node", F.col("ancestor").alias("via")), 2 * n
        near = union_of(parts)
    raise ValueError("the edges hold a cycle")


def union_of(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def dispatch(calls: DataFrame, parents: DataFrame, methods: DataFrame, instantiated: DataFrame, abstract: DataFrame) -> DataFrame:
    """(owner, member, target): for each called method its overrides in instantiated subtypes. One row a method and override,
    however often the method is called."""
    called = calls.select("owner", "member").distinct()
    subtypes = fixpoint_closure(parents.select("parent", "child"), called.select(F.col("owner").alias("seed")).distinct())
    able = subtypes.join(instantiated.select(F.col("type").alias("node")).distinct(), "node", "left_semi").join(abstract.select(F.col("type").alias("node")).distinct(), "node", "left_anti")
    over = able.join(methods.select(F.col("owner").alias("node"), "member").distinct(), "node").select(F.col("seed").alias("owner"), "member", F.concat_ws(".", "node", "member").alias("target"))
    return over.join(called, ["owner", "member"], "left_semi")


def rta_expand(calls: DataFrame, parents: DataFrame, methods: DataFrame, instantiated: DataFrame, abstract: DataFrame) -> DataFrame:
    """Further targets of method calls: overrides in instantiated subtypes.

    calls (call, owner, member); parents (child, parent); methods (owner, member); instantiated (type); abstract (type).
    Subtypes are walked through abstract and never instantiated ones, only targets are filtered. Returns (call, target).
    The closure starts at the calls' owners only.
    """
    over = dispatch(calls, parents, methods, instantiated, abstract)
    return calls.join(over, ["owner", "member"]).select("call", "target")
