"""Blocks of rows, and rounds of questions about them.

Several operators need to know something about each of very many small keys of a
text (is this fingerprint also elsewhere? how frequent is this n-gram?). A row per
key would cost far more than the key. Instead

* rows are packed into blocks of about ``GROUP_BYTES`` of text, each one compressed
  Arrow batch; blocks are spread by id and persisted, so later rounds join on
  ``block_id`` without moving the texts again;
* in a round each block sends, per bucket of the key space, one buffer with its
  distinct keys (so a key that is in a third of all rows is sent once per block and
  no bucket gets more than one buffer per block); a task answers all buffers of one
  bucket in numpy and returns one small buffer per block;
* the block picks the answers up in a co-grouping on ``block_id``.

The number of buckets follows the input's size, so what one task holds does not; blocks
and buckets grow with its root up to ``GROW`` times, so that buffers stay worth a row each.
Keys are mixed hashes: buckets are even whatever the data look like. Blocks are
built from a deterministic scan; if an executor is lost, Spark recomputes the lost
blocks and buffers from the input. Input that comes out of a shuffle must be
written (or checkpointed) first.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel, TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kernels import GROUP_BYTES, buffers, groups, release

#: Blocks and buckets grow to so many times their least size, from inputs of ``GROW_FROM`` bytes of text on.
GROW, GROW_FROM = 4, 4 << 30
NULL_ID = np.iinfo(np.int64).max
_IPC = pa.ipc.IpcWriteOptions(compression="zstd")


def encode_batch(batch: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=_IPC) as writer:
        writer.write_batch(batch)
    return sink.getvalue().to_pybytes()


_CODEC = pa.Codec("zstd", compression_level=1)


def pack_ints(*arrays: np.ndarray) -> bytes:
    """Arrays of one length of integers of at least 0, compressed by planes of equal significance."""
    parts, widths = [], bytearray()
    for x in arrays:
        top = int(x.max(initial=0))
        width = (top.bit_length() + 7) // 8
        widths.append(width)
        parts.append(np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes())
    flat = b"".join(parts)
    return struct.pack("<I", len(arrays[0])) + bytes(widths) + (_CODEC.compress(flat, asbytes=True) if flat else b"")


def unpack_ints(blob: bytes, n_arrays: int) -> list[np.ndarray]:
    """What ``pack_ints`` got, as 64-bit numbers."""
    n, widths = struct.unpack_from("<I", blob)[0], blob[4 : 4 + n_arrays]
    size = n * sum(widths)
    flat = np.frombuffer(_CODEC.decompress(blob[4 + n_arrays :], size), np.uint8) if size else np.zeros(0, np.uint8)
    out, at = [], 0
    for width in widths:
        x = np.zeros((n, 8), np.uint8)
        x[:, :width] = flat[at : at + n * width].reshape(width, n).T
        out.append(x.view("<u8").reshape(-1))
        at += n * width
    return out


def decode_batch(body: bytes) -> pa.RecordBatch:
    return pa.ipc.open_stream(body).read_next_batch()


@dataclass
class Blocks:
    """``df`` has block_id and body; ``bits``: 2**bits buckets."""

    df: DataFrame
    rows: int
    text_bytes: int
    bits: int

    def ask(self, emit: Callable, answer: Callable, tag: int, earlier: DataFrame | None = None, bits: int | None = None) -> DataFrame:
        """One round; returns (block_id, tag, bucket, blob).

        ``emit(batch, answers)`` gives (bucket, buffer) pairs in order of the bucket,
        ``answer(buffers)`` one buffer for each.
        """

        def send(block_id: int, body: bytes, answers: dict[int, list[bytes]]) -> pa.RecordBatch:
            sent = list(emit(decode_batch(body), answers))
            return pa.RecordBatch.from_arrays(
                [pa.array([b for b, _ in sent], pa.int32()), pa.array([block_id] * len(sent), pa.int64()), pa.array([x for _, x in sent], pa.binary())], names=["bucket", "block_id", "blob"]
            )

        schema = "bucket int, block_id long, blob binary"
        if earlier is None:

            def from_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                for batch in batches:
                    for block_id, body in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                        yield send(block_id, body.as_py(), {})
                        release()

            sent = self.df.mapInArrow(from_blocks, schema)
        else:
            sent = self.with_answers(earlier, lambda block_id, body, answers: send(block_id, body, answers), schema)

        def reply(key: tuple, table: pa.Table) -> pa.Table:
            got = answer([b.as_py() for b in table.column("blob")])
            n = len(got)
            release()
            return pa.table({"block_id": table.column("block_id"), "tag": pa.array([tag] * n, pa.int32()), "bucket": table.column("bucket"), "blob": pa.array(got, pa.binary())})

        return sent.groupBy("bucket").applyInArrow(reply, "block_id long, tag int, bucket int, blob binary")

    def release(self) -> None:
        """Gives the blocks' storage back, once all that reads them is written."""
        self.df.unpersist()

    def with_answers(self, answers: DataFrame, use: Callable, schema: str) -> DataFrame:
        """``use(block_id, body, {tag: buffers by bucket})`` for every block, a batch or table each."""

        def run(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
            by_tag: dict[int, list] = {}
            for tag, bucket, blob in zip(right.column("tag").to_pylist(), right.column("bucket").to_pylist(), right.column("blob"), strict=True):
                by_tag.setdefault(tag, []).append((bucket, blob))
            sorted_ = {t: [b.as_py() for _, b in sorted(x, key=lambda y: y[0])] for t, x in by_tag.items()}
            out = [use(i, body.as_py(), sorted_) for i, body in zip(left.column("block_id").to_pylist(), left.column("body"), strict=True)]
            release()
            return pa.Table.from_batches([b for o in out for b in (o.to_batches() if isinstance(o, pa.Table) else [o])])

        return self.df.groupBy("block_id").cogroup(answers.groupBy("block_id")).applyInArrow(run, schema)


def pack(docs: DataFrame, text: str = "text", add: Callable[[pa.RecordBatch], pa.RecordBatch] | None = None, bucket_bytes: int = 8 << 20) -> Blocks:
    """Blocks of all rows, with the columns that ``add`` gives them; null texts become empty. Runs one job (sizes) and persists lazily."""
    spark = docs.sparkSession
    docs = docs.withColumn(text, F.coalesce(F.col(text), F.lit("")))
    rows, total = docs.agg(F.count("*"), F.coalesce(F.sum(F.octet_length(text)), F.lit(0))).first()
    at = docs.columns.index(text)
    grow = min(GROW, max(1.0, (total / GROW_FROM) ** 0.5))
    block_bytes, bucket_bytes = int(GROUP_BYTES * grow), bucket_bytes * grow

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, n = TaskContext.get().partitionId() << 40, 0
        for batch in batches:
            _, offsets = buffers(batch.column(at))
            for i, j in groups(offsets, block_bytes):
                rows = batch.slice(i, j - i)
                yield pa.RecordBatch.from_arrays([pa.array([base + n], pa.int64()), pa.array([encode_batch(add(rows) if add else rows)], pa.binary())], names=["block_id", "body"])
                n += 1

    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // (32 << 20)))
    df = docs.mapInArrow(build, "block_id long, body binary").repartition(parts, "block_id").persist(StorageLevel.MEMORY_AND_DISK)
    return Blocks(df, rows, total, max(3, int(np.ceil(np.log2(max(1, total) / bucket_bytes)))))


def split_key(key: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket (the top bits) and the 32 bits below it."""
    return (key >> np.uint64(64 - bits)).astype(np.int64), ((key << np.uint64(bits)) >> np.uint64(32)).astype(np.uint32)


def slices(bucket: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(bucket, start, end) of each run in a sorted array."""
    if len(bucket):
        cut = np.flatnonzero(np.diff(bucket)) + 1
        for a, b in zip(np.concatenate(([0], cut)).tolist(), np.concatenate((cut, [len(bucket)])).tolist(), strict=True):
            yield int(bucket[a]), a, b


def id_array(column: pa.Array) -> np.ndarray:
    """Integer ids; null counts as the largest."""
    return column.cast(pa.int64()).fill_null(int(NULL_ID)).to_numpy(zero_copy_only=False)
