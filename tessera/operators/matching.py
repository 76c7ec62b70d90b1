"""Maximum bipartite matchings of many graphs at once, by augmenting rounds over edge tables.

In a round all free left nodes of all graphs grow trees of alternating paths level by level, each right node joining one
tree only. As soon as trees reach free right nodes, each such tree's path is turned around: the paths share no node, so all
are turned at once, and the next round begins. When no tree grows any more and none has reached a free node, no
augmenting path is left anywhere and all matchings are largest. Every step is a join or an aggregate over edges; the
driver sees counts. A graph's hub is one key of a join that adaptive execution can split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.graph import saved


def maximum_matching(edges: DataFrame) -> DataFrame:
    """edges (graph, left, right) -> (graph, left, right): a largest matching of each graph. Repeated edges count once."""
    edges = saved(edges.select("graph", "left", "right").distinct(), "matching-edges")
    lefts = saved(edges.select("graph", "left").distinct(), "matching-left")
    matched = saved(edges.limit(0), "matching")
    while True:
        found = _paths(edges, lefts, matched)
        if found is None:
            return matched
        # What the paths' left nodes had goes; each gets the right node before it on its path.
        matched = saved(matched.join(found, ["graph", "left"], "left_anti").unionByName(found), "matching")


def _paths(edges: DataFrame, lefts: DataFrame, matched: DataFrame) -> DataFrame | None:
    """The edges that shortest augmenting paths add, one path a tree; None if there are no such paths."""
    front = saved(lefts.join(matched, ["graph", "left"], "left_anti").select("graph", F.col("left").alias("root"), "left"), "matching-front")
    seen, level = None, 0
    while not front.isEmpty():
        level += 1
        near = edges.join(front, ["graph", "left"])
        if seen is not None:
            near = near.join(seen, ["graph", "right"], "left_anti")
        # A right node joins one tree; which, a hash says, so that trees share out what many of them see.
        first = F.min_by(F.struct("root", "left"), F.struct(F.xxhash64("root", "right"), "root", "left"))
        fresh = saved(near.groupBy("graph", "right").agg(first.alias("by")).select("graph", "right", "by.root", "by.left", F.lit(level).alias("level")), "matching-level")
        free = fresh.join(matched.select("graph", "right"), ["graph", "right"], "left_anti")
        ends = saved(free.groupBy("graph", "root").agg(F.min("right").alias("right")), "matching-ends")
        seen = fresh if seen is None else saved(seen.unionByName(fresh), "matching-seen")
        if not ends.isEmpty():
            return _turned(ends, seen, matched, level)
        front = saved(fresh.join(matched.withColumnRenamed("left", "next"), ["graph", "right"]).select("graph", "root", F.col("next").alias("left")), "matching-front")
    return None


def _turned(ends: DataFrame, seen: DataFrame, matched: DataFrame, level: int) -> DataFrame:
    """The paths from the trees' ends back to their roots: the edge by which each right node was reached."""
    at, steps = ends.select("graph", "right"), []
    for k in range(level):
        step = saved(seen.join(at, ["graph", "right"]).select("graph", "left", "right"), "matching-path")
        steps.append(step)
        if k + 1 < level:
            at = step.select("graph", "left").join(matched, ["graph", "left"]).select("graph", "right")
    out = steps[0]
    for step in steps[1:]:
        out = out.unionByName(step)
    return out
