"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(v, c): for each vertex of ``edges`` (columns a, b) the smallest vertex of its component.

    Rounds of star contraction: each vertex links to the smallest label around it, and
    labels jump to their label's label, so a path of n vertices takes about log n
    rounds. Minima are combined before the shuffles, so a vertex with very many edges
    costs a row per task there. Every round is a written table; nothing is collected.
    """
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    arcs = scratch.table(both.where("a <> b").distinct())
    labels = scratch.table(arcs.groupBy(F.col("a").alias("v")).agg(F.min("b").alias("m")).select("v", F.least("v", "m").alias("c")))
    while True:
        near = arcs.join(labels, F.col("b") == F.col("v")).groupBy("a").agg(F.min("c").alias("m"))
        lower = labels.join(near, F.col("v") == F.col("a")).select("v", "c", F.least("c", "m").alias("d"))
        # the old label learns of the new one as well, so that whole stars move at once
        hook = lower.where("d < c").groupBy(F.col("c").alias("h")).agg(F.min("d").alias("hd"))
        moved = lower.join(hook, F.col("v") == F.col("h"), "left").select("v", "c", F.least("d", F.coalesce("hd", "d")).alias("d"))
        jump = moved.select(F.col("v").alias("j"), F.col("d").alias("jd"))
        fresh = scratch.table(moved.join(jump, F.col("d") == F.col("j"), "left").select("v", F.least("d", F.coalesce("jd", "d")).alias("c"), F.col("c").alias("old")))
        changed = not fresh.where("c < old").isEmpty()
        scratch.drop(labels)
        labels = fresh
        if not changed:
            scratch.drop(arcs)
            return labels.select("v", "c")


def joined(labels: DataFrame, edges: DataFrame, scratch: Scratch) -> DataFrame:
    """``labels`` (v, c) after more ``edges``, by the components of the components that these touch."""
    if edges.isEmpty():
        return labels
    ends = [labels.select(F.col("v").alias(x), F.col("c").alias(f"c{x}")) for x in ("a", "b")]
    named = edges.select("a", "b").join(ends[0], "a", "left").join(ends[1], "b", "left")
    named = scratch.table(named.select("a", "b", F.coalesce("ca", "a").alias("ca"), F.coalesce("cb", "b").alias("cb")))
    moved = components(named.select(F.col("ca").alias("a"), F.col("cb").alias("b")), scratch).withColumnsRenamed({"v": "w", "c": "d"})
    fresh = named.select(F.explode(F.array("a", "b")).alias("v")).distinct().join(labels, "v", "left_anti").select("v", F.col("v").alias("c"))
    every = labels.unionByName(fresh)
    return scratch.table(every.join(moved, F.col("c") == F.col("w"), "left").select("v", F.coalesce("d", "c").alias("c")))
