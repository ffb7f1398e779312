"""Bit sets in blocks: packed rows, a table of the pairs of blocks that can matter, and tasks that compare two blocks.

A block is one row: the keys of up to some thousands of bit sets, how many bits each has, and
the bits themselves, packed. Blocks are cut from rows sorted by their number of bits (or by
key), so a bound on the similarity of two sizes bounds whole blocks, and the partners of a
block are a range of block numbers. A task gets two blocks and compares all their rows in numpy;
what is not needed never leaves it. No pair of rows is ever a row of a shuffle unless it is part of the result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a block: at least and at most; in between an eighth of the input, so that small inputs keep several cores busy.
LEAST_ROWS, MOST_ROWS = 256, 8192
#: Entries of a matrix that a task holds at once.
TILE = 1 << 22
Table = Callable[[DataFrame], DataFrame]


@dataclass
class Blocks:
    """``df``: b (dense, in order), lo, hi (numbers of bits), n (rows), ids, sizes, words; ``width``: bytes of a packed row."""

    df: DataFrame
    rows: int
    width: int
    key: str  # type of the keys

    def meta(self) -> DataFrame:
        return self.df.select("b", "lo", "hi", "n")


def packed(bits: list[np.ndarray], width: int) -> np.ndarray:
    """Rows of ``width`` bytes of lists of on-bits."""
    out = np.zeros((len(bits), width * 8), np.uint8)
    n = np.array([len(b) for b in bits], np.int64)
    if n.sum():
        out[np.repeat(np.arange(len(bits)), n), np.concatenate(bits)] = 1
    return np.packbits(out, axis=1)


def unpacked(words: bytes, width: int) -> np.ndarray:
    """Rows of zeros and ones, as floats for matrix products; counts below 2**24 are exact in them."""
    return np.unpackbits(np.frombuffer(words, np.uint8).reshape(-1, width), axis=1).astype(np.float32)


def width_of(*frames: tuple[DataFrame, str]) -> tuple[list[int], int]:
    """Rows of each frame, and the bytes that their widest bit set needs."""
    counts, top = [], -1
    for df, bits in frames:
        n, low, high = df.agg(F.count("*"), F.min(F.array_min(bits)), F.max(F.array_max(bits))).first()
        if low is not None and low < 0:
            raise ValueError(f"bit {low} is below 0")
        counts.append(n)
        top = max(top, -1 if high is None else high)
    return counts, max(1, -(-(top + 1) // 8))


def block_rows(rows: int, parts: int = 8) -> int:
    return int(min(MOST_ROWS, max(LEAST_ROWS, -(-rows // parts))))


def pack(df: DataFrame, key: str, bits: str, table: Table, rows: int, width: int, size: int | None = None, by_key: bool = False) -> Blocks:
    """Blocks of ``size`` rows, by number of bits and key or by key alone. Null bits are an empty set; bits that repeat count once."""
    size = size or block_rows(rows)
    sets = df.select(F.col(key).alias("k"), F.coalesce(F.array_distinct(bits), F.array().cast("array<int>")).cast("array<int>").alias("s")).withColumn("c", F.size("s"))
    order = ["k"] if by_key else ["c", "k"]
    parts = max(1, -(-rows // (32 * size)))
    placed = (sets.repartition(1) if parts == 1 else sets.repartitionByRange(parts, *order)).sortWithinPartitions(*order)
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, seq, held, n = TaskContext.get().partitionId(), 0, [], 0

        def out(rows_: pa.Table) -> pa.RecordBatch:
            rows_ = rows_.combine_chunks()
            counts = rows_.column("c").to_numpy()
            lists = rows_.column("s").to_numpy()
            words = packed([np.asarray(x, np.int64) for x in lists], width)
            cols = [[part], [seq], [int(counts.min())], [int(counts.max())], [len(counts)], [rows_.column("k").to_pylist()], [counts.tolist()], [words.tobytes()]]
            kinds = [pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.list_(rows_.schema.field("k").type), pa.list_(pa.int32()), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=["part", "seq", "lo", "hi", "n", "ids", "sizes", "words"])

        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            while n >= size:
                whole = pa.Table.from_batches(held)
                yield out(whole.slice(0, size))
                seq, held, n = seq + 1, whole.slice(size).to_batches(), n - size
        if n:
            yield out(pa.Table.from_batches(held))

    found = table(placed.mapInArrow(run, f"part int, seq int, lo int, hi int, n int, ids array<{kind}>, sizes array<int>, words binary"))
    # a row for each partition of the sort is what one task sees
    each = found.groupBy("part").agg(F.count("*").alias("m"))
    starts = each.select("part", (F.coalesce(F.sum("m").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).alias("start"))
    return Blocks(found.join(F.broadcast(starts), "part").withColumn("b", F.col("start") + F.col("seq")).drop("part", "seq", "start"), rows, width, kind)


def last_block(blocks: Blocks, meta: DataFrame, limit: Column) -> DataFrame:
    """Adds ``last``: the largest number of a block that begins with at most ``limit`` bits; null without one.

    Block numbers rise with their bits, so the blocks' beginnings are a table of at most
    one entry per number of bits.
    """
    steps = blocks.meta().groupBy("lo").agg(F.max("b").alias("b")).agg(F.array_sort(F.collect_list(F.struct("lo", "b"))).alias("steps")).withColumn("one", F.lit(1))
    reach = F.filter("steps", lambda s: s["lo"] <= limit)
    return meta.withColumn("one", F.lit(1)).join(F.broadcast(steps), "one", "left").withColumn("last", F.try_element_at(reach, F.lit(-1))["b"]).drop("one", "steps")


def matched(left: Blocks, right: Blocks, pairs: DataFrame, run: Callable[..., pa.RecordBatch | None], schema: str, extra: list[str] | None = None) -> DataFrame:
    """``run(left block, right block, extra columns)`` for each row (i, j) of ``pairs``.

    A block is a dict of its columns; the pairs are dealt out evenly, whatever their number.
    """
    extra = extra or []
    names = ["b", "ids", "sizes", "words"]
    a = left.df.select(*(F.col(c).alias(f"a_{c}") for c in names))
    b = right.df.select(*(F.col(c).alias(f"b_{c}") for c in names))
    dealt = pairs.repartition(max(2 * pairs.sparkSession.sparkContext.defaultParallelism, 8), "i", "j")
    both = dealt.join(a, F.col("i") == F.col("a_b")).join(b, F.col("j") == F.col("b_b"))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = {c: batch.column(c)[k] for c in batch.schema.names}
                x, y = ({c: row[f"{side}_{c}"] for c in names} for side in "ab")
                yield from run(x, y, {c: row[c].as_py() for c in extra})

    return both.select(*extra, *(f"a_{c}" for c in names), *(f"b_{c}" for c in names)).mapInArrow(each, schema)


def rows_of(block: dict, width: int) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Keys, numbers of bits and unpacked bits of a block."""
    return block["ids"].values, block["sizes"].values.to_numpy(zero_copy_only=False).astype(np.int64), unpacked(block["words"].as_py(), width)


def chunks(n: int, other: int) -> Iterator[slice]:
    """Row ranges of a matrix of n rows that stay below ``TILE`` entries each."""
    step = max(1, TILE // max(1, other))
    for a in range(0, n, step):
        yield slice(a, min(a + step, n))


def similarities(common: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Tanimoto of sets of a and b bits with ``common`` shared ones; 0 for two empty ones."""
    common = common.astype(np.float64)
    return common / np.maximum(a + b - common, 1)
