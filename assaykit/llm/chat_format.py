"""Chat formatting after cumulative-snapshot collapse.

Chat logs often store a conversation anew after each turn. Such a snapshot is a
proper prefix of a longer conversation and adds nothing. Each turn gets a hash of
its place, role and text; a running combination of them gives one fingerprint per
turn prefix. A conversation goes if its whole fingerprint is a proper prefix of
another one's, or if an equal conversation has a smaller id (anti-joins); the rest
are rendered.

The running combination is an XOR of two 64-bit hashes salted with the place of the
turn, so it is order-dependent and can be taken in two levels: inside runs of
``RUN`` turns, then over the runs. A conversation with very many turns is so spread
over tasks. Prefix fingerprints are made distinct before the joins, so a first turn
or a conversation that a third of all rows share is one row there.

Cases: turns are ordered by (turn, role, text), nulls first, and a null role or text
differs from an empty one in the hash and is rendered as empty; repeated turns count
as turns; rows without conv_id are ignored; extra columns are ignored; an empty table
gives an empty result; equal conversations keep the smallest conv_id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

RUN = 1024


def _turns(conversations: DataFrame) -> DataFrame:
    """Turns with their place (from 1) in the conversation and their salted hashes."""
    t = conversations.where("conv_id IS NOT NULL").select("conv_id", "turn", "role", "text").withColumn("run", F.coalesce(F.floor(F.col("turn") / RUN), F.lit(-(1 << 40))))
    runs = t.groupBy("conv_id", "run").agg(F.count("*").alias("n"))
    over = Window.partitionBy("conv_id").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    before = runs.select("conv_id", "run", F.coalesce(F.sum("n").over(over), F.lit(0)).alias("before"))
    inside = Window.partitionBy("conv_id", "run").orderBy(F.asc_nulls_first("turn"), F.asc_nulls_first("role"), F.asc_nulls_first("text"))
    placed = t.withColumn("k", F.row_number().over(inside)).join(before, ["conv_id", "run"]).withColumn("k", F.col("k") + F.col("before")).drop("before")
    body = (F.col("k"), F.col("role").isNull(), F.coalesce("role", F.lit("")), F.col("text").isNull(), F.coalesce("text", F.lit("")))
    return placed.withColumns({"h1": F.xxhash64(F.lit(1), *body), "h2": F.xxhash64(F.lit(2), *body[::-1])})


def prefix_hashes(turns: DataFrame) -> DataFrame:
    """(conv_id, k, p1, p2): fingerprints of the first k turns."""
    runs = turns.groupBy("conv_id", "run").agg(F.bit_xor("h1").alias("x1"), F.bit_xor("h2").alias("x2"))
    over = Window.partitionBy("conv_id").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    before = runs.select("conv_id", "run", *(F.coalesce(F.bit_xor(f"x{i}").over(over), zero).alias(f"b{i}") for i in (1, 2)))
    inside = Window.partitionBy("conv_id", "run").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    return turns.join(before, ["conv_id", "run"]).select("conv_id", "k", *(F.bit_xor(f"h{i}").over(inside).bitwiseXOR(F.col(f"b{i}")).alias(f"p{i}") for i in (1, 2)))


def maximal(conversations: DataFrame) -> DataFrame:
    """(conv_id, n_turns, n_copies) of conversations that no longer or equal earlier one covers."""
    prefixes = prefix_hashes(_turns(conversations))
    sizes = prefixes.groupBy("conv_id").agg(F.max("k").alias("n"), F.max_by(F.struct("p1", "p2"), "k").alias("p"))
    unique = sizes.select("conv_id", "n", "p.p1", "p.p2").groupBy("n", "p1", "p2").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_copies"))
    proper = prefixes.join(sizes.select("conv_id", "n"), "conv_id").where("k < n").select(F.col("k").alias("n"), "p1", "p2").distinct()
    return unique.join(proper, ["n", "p1", "p2"], "left_anti").select("conv_id", F.col("n").cast("long").alias("n_turns"), "n_copies")


def chat_format(conversations: DataFrame, head: str = "<|im_start|>", end: str = "<|im_end|>") -> DataFrame:
    """Maximal conversations with their rendered text: conv_id, n_turns, n_copies, rendered."""
    kept = maximal(conversations)
    turn = F.concat(F.lit(head), F.coalesce("role", F.lit("")), F.lit("\n"), F.coalesce("text", F.lit("")), F.lit(end), F.lit("\n"))
    lines = _turns(conversations).select("conv_id", "run", "k", turn.alias("line")).join(kept, "conv_id")
    ordered = lambda name, value: F.array_sort(F.collect_list(F.struct(name, value)))
    runs = lines.groupBy("conv_id", "n_turns", "n_copies", "run").agg(F.array_join(ordered("k", "line")["line"], "").alias("part"))
    return runs.groupBy("conv_id", "n_turns", "n_copies").agg(F.array_join(ordered("run", "part")["part"], "").alias("rendered"))
