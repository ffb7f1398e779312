"""Ranked lexical search with block-max pruning.

An index row is a shard: a range of documents in the order they were read, cut into blocks of
``block_docs`` documents. It holds

* the shard's terms (sorted hashes) and how many documents have each,
* for every term and block the largest impact of the term in the block's documents,
* the forward index: each document's terms and their impacts.

An impact is ``(10**9 * tf) div (1000 * tf + 8 * m)``, so a score is the sum of weight times
impact over an item's terms, all in 64-bit integers. Items are searched in query blocks of
bounded size, each against every shard:

1. document frequencies of the block's terms are summed over the shards, which gives weights;
2. each task bounds every (item, block) from the maxima alone and keeps each item's best
   blocks; the best of all tasks are scored, and the k-th best score found there is a
   threshold that the item's final k-th score cannot be below;
3. each task sorts the blocks by the item's bound and scores forward-index blocks until the
   bound drops below the threshold, which rises with what the task has found; it sends at
   most k documents an item. A block whose bound equals the threshold is scored, as its
   documents may have smaller ids.

Shards are made without a shuffle and no step gathers by term, so hot terms, hot sources and
groups of copies cost nothing extra; what tasks send is a row per item and task times k. The
index is a written table in the shared folder. Lost tasks are computed again from it.

Terms are known by 64-bit hashes. Two different terms of up to eight bytes and one length never
have the same; for longer ones the chance that any of V terms of a corpus meets one of Q terms
of the items is about V * Q / 2**64 (10**9 and 10**4: one in two million).

Cases: null or empty texts have no terms and are never found; documents with equal ids are
separate documents; ids must be integers (an error otherwise), and a null id comes after all
others among equal scores and is returned as null. Every row of ``items`` is an item of its
own, so repeated rows repeat their results; an item without terms, or whose terms no document
has, has no rows. Other columns are ignored, whatever their names; without documents or items
the result is empty.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .blocks import NULL_ID, pack_ints, unpack_ints
from .kernels import Words, buffers, groups, release
from .scratch import Scratch

#: Bytes of terms: digits, letters and all that is not ASCII.
TERM = np.zeros(256, bool)
TERM[48:58] = TERM[65:91] = TERM[97:123] = TERM[128:] = True
#: Blocks that are scored for an item's first threshold.
SEEDS = 4
#: Documents of a shard at most, so that a table of its blocks by query term stays small where texts are short.
SHARD_DOCS = 4096
_SCHEMA = "shard long, n_blocks int, block_docs int, ids array<long>, terms binary, maxima binary, forward_ptr binary, forward binary"


@dataclass
class LexicalIndex:
    """``table`` as described above; documents with a term, and all their terms."""

    table: DataFrame
    n_docs: int
    n_terms: int


def _terms(column: pa.Array) -> Words:
    data, offsets = buffers(column)
    return Words(data, offsets, TERM, lower=True)


def _totals(docs: DataFrame) -> tuple[int, int]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        some = every = 0
        for batch in batches:
            data, offsets = buffers(batch.column(0))
            for i, j in groups(offsets):
                n = Words(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], TERM, hashes=False).counts
                some, every = some + int((n > 0).sum()), every + int(n.sum())
                release()
        yield pa.RecordBatch.from_arrays([pa.array([some], pa.int64()), pa.array([every], pa.int64())], names=["some", "every"])

    got = docs.select("text").mapInArrow(run, "some long, every long").agg(F.sum("some"), F.sum("every")).first()
    return got[0] or 0, got[1] or 0


def _shard(words: Words, n_docs: int, n_terms: int, block_docs: int) -> list[bytes]:
    """terms, maxima, forward_ptr and forward of a shard's documents."""
    terms, at = np.unique(words.hash, return_inverse=True)
    size = max(1, len(terms))
    entry, tf = np.unique(words.owners() * size + at, return_counts=True)
    doc, term = np.divmod(entry, size)
    m = 25 + 75 * words.counts * n_docs // max(1, n_terms)
    impact = 1_000_000_000 * tf // (1000 * tf + 8 * m[doc])
    n_blocks = -(-len(words.counts) // block_docs)
    place = term * n_blocks + doc // block_docs
    order = np.argsort(place, kind="stable")
    first = np.flatnonzero(np.diff(place[order], prepend=-1))
    most = np.maximum.reduceat(impact[order], first) if len(first) else impact[:0]
    delta = np.diff(terms, prepend=np.uint64(0))
    return [
        pack_ints(delta, np.bincount(term, minlength=len(terms)).astype(np.int64)),
        pack_ints(np.diff(place[order][first], prepend=0), most),
        pack_ints(np.bincount(doc, minlength=len(words.counts))),
        pack_ints(term, impact),
    ]


def build_index(docs: DataFrame, scratch: Scratch, shard_bytes: int = 4 << 20, block_docs: int = 32) -> LexicalIndex:
    """Indexes ``docs`` (doc_id, text): two scans, one to count documents and terms and one to write the index."""
    if docs.schema["doc_id"].dataType.typeName() not in ("byte", "short", "integer", "long"):
        raise TypeError("doc_id must be an integer")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text"))
    n_docs, n_terms = _totals(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = TaskContext.get().partitionId() << 40
        for batch in batches:
            _, offsets = buffers(batch.column(1))
            for i, j in ((a, min(a + SHARD_DOCS, j)) for i, j in groups(offsets, shard_bytes) for a in range(i, j, SHARD_DOCS)):
                part = batch.slice(i, j - i)
                blobs = _shard(_terms(part.column(1)), n_docs, n_terms, block_docs)
                cols = [[shard], [-(-(j - i) // block_docs)], [block_docs], [part.column(0).to_pylist()], *([b] for b in blobs)]
                kinds = [pa.int64(), pa.int32(), pa.int32(), pa.list_(pa.int64()), *[pa.binary()] * 4]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=["shard", "n_blocks", "block_docs", "ids", "terms", "maxima", "forward_ptr", "forward"])
                shard += 1
                release()

    return LexicalIndex(scratch.table(docs.mapInArrow(run, _SCHEMA)), n_docs, n_terms)


@dataclass
class Queries:
    """A bounded block of items: item i has terms ``term[ptr[i]:ptr[i + 1]]`` (numbers in ``vocabulary``), each ``times`` times."""

    ids: pa.Array
    ptr: np.ndarray
    term: np.ndarray
    times: np.ndarray
    vocabulary: np.ndarray

    def weighted(self, df: np.ndarray, n_docs: int) -> np.ndarray:
        w = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * d + 1))) for d in df.tolist()], np.int64)
        return w[self.term] * self.times


def _query_blocks(items: DataFrame, query_bytes: int) -> Iterator[Queries]:
    """Items in blocks of about ``query_bytes`` of text, one on the driver at a time."""
    kind = items.schema["item_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, offsets = buffers(batch.column(1))
            for i, j in groups(offsets, query_bytes):
                part = batch.slice(i, j - i)
                words = _terms(part.column(1))
                vocabulary, at = np.unique(words.hash, return_inverse=True)
                entry, times = np.unique(words.owners() * max(1, len(vocabulary)) + at, return_counts=True)
                owner, term = np.divmod(entry, max(1, len(vocabulary)))
                blobs = [pack_ints(np.bincount(owner, minlength=j - i)), pack_ints(term, times), pack_ints(np.diff(vocabulary, prepend=np.uint64(0)))]
                yield pa.RecordBatch.from_arrays([pa.array([part.column(0).to_pylist()], pa.list_(part.column(0).type)), *(pa.array([b], pa.binary()) for b in blobs)], names=["ids", "size", "entries", "vocabulary"])

    rows = items.select("item_id", F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text"))
    for row in rows.mapInArrow(run, f"ids array<{kind}>, size binary, entries binary, vocabulary binary").toLocalIterator():
        size = unpack_ints(bytes(row["size"]), 1)[0].astype(np.int64)
        term, times = (x.astype(np.int64) for x in unpack_ints(bytes(row["entries"]), 2))
        vocabulary = np.cumsum(unpack_ints(bytes(row["vocabulary"]), 1)[0])
        if len(vocabulary):
            yield Queries(row["ids"], np.concatenate(([0], np.cumsum(size))), term, times, vocabulary)


class _Shard:
    """A shard as a query block sees it; the forward index is unpacked when a block is first scored."""

    def __init__(self, row: dict, vocabulary: np.ndarray):
        self.row, self.n_blocks, self.block_docs = row, row["n_blocks"], row["block_docs"]
        delta, self.df = unpack_ints(row["terms"], 2)
        terms = np.cumsum(delta)
        place = np.searchsorted(vocabulary, terms)
        place[place == len(vocabulary)] = 0
        #: the query term that a term of the shard is, or -1
        self.number = np.where(vocabulary[place] == terms, place, -1) if len(terms) else np.zeros(0, np.int64)
        self._forward = None
        self._blocks: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def bounds(self, q: Queries, coefficient: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """(first item, bounds of some items for all blocks)."""
        delta, most = unpack_ints(self.row["maxima"], 2)
        term, block = np.divmod(np.cumsum(delta).astype(np.int64), self.n_blocks)
        known = self.number[term] >= 0 if len(term) else np.zeros(0, bool)
        present = self.number[self.number >= 0]
        row_of = np.full(len(q.vocabulary), len(present))
        row_of[present] = np.arange(len(present))
        table = np.zeros((len(present) + 1, self.n_blocks), np.int32)
        table[row_of[self.number[term[known]]], block[known]] = most[known]
        step = max(1, (1 << 22) // self.n_blocks)  # entries at once
        a = 0
        while a < len(q.ptr) - 1:
            b = max(a + 1, int(np.searchsorted(q.ptr, q.ptr[a] + step, "right")) - 1)
            out = np.zeros((b - a, self.n_blocks), np.int64)
            sizes = np.diff(q.ptr[a : b + 1])
            full = np.flatnonzero(sizes)
            if len(full):
                at = slice(q.ptr[a], q.ptr[b])
                out[full] = np.add.reduceat(table[row_of[q.term[at]]] * coefficient[at, None], q.ptr[a:b][full] - q.ptr[a], axis=0)
            yield a, out
            a = b

    def scores(self, block: int, q: Queries, coefficient: np.ndarray, item: int) -> np.ndarray:
        """Scores of an item for the documents of a block."""
        if self._forward is None:
            size = unpack_ints(self.row["forward_ptr"], 1)[0].astype(np.int64)
            self._forward = (np.concatenate(([0], np.cumsum(size))), *(x.astype(np.int64) for x in unpack_ints(self.row["forward"], 2)))
        ptr, term, impact = self._forward
        first, last = block * self.block_docs, min((block + 1) * self.block_docs, len(ptr) - 1)
        if block not in self._blocks:
            at = slice(ptr[first], ptr[last])
            number, doc = self.number[term[at]], np.repeat(np.arange(last - first), np.diff(ptr[first : last + 1]))
            known = number >= 0
            here, col = np.unique(number[known], return_inverse=True)
            dense = np.zeros((last - first, len(here) + 1), np.int64)
            dense[doc[known], col] = impact[at][known]
            self._blocks[block] = (here, dense)
        here, dense = self._blocks[block]
        if not len(here):
            return np.zeros(last - first, np.int64)
        at = slice(q.ptr[item], q.ptr[item + 1])
        col = np.searchsorted(here, q.term[at])
        col[(col == len(here)) | (here[np.minimum(col, len(here) - 1)] != q.term[at])] = len(here)
        return dense[:, col] @ coefficient[at]


def _shards(batches: Iterator[pa.RecordBatch], vocabulary: np.ndarray) -> Iterator[_Shard]:
    for batch in batches:
        for k in range(batch.num_rows):
            yield _Shard({name: batch.column(name)[k].as_py() for name in batch.schema.names}, vocabulary)
            release()


def _search(index: LexicalIndex, q: Queries, k: int, id_kind: str) -> DataFrame:
    """(item_id, q, doc_id, score) of a query block, at most k per item and task."""
    spark, n_items = index.table.sparkSession, len(q.ptr) - 1

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(q.vocabulary), np.int64)
        for shard in _shards(batches, q.vocabulary):
            known = shard.number >= 0
            total[shard.number[known]] += shard.df[known].astype(np.int64)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(total[some], pa.int64())], names=["term", "df"])

    df = np.zeros(len(q.vocabulary), np.int64)
    for row in index.table.select("n_blocks", "block_docs", "terms").mapInArrow(frequencies, "term int, df long").groupBy("term").agg(F.sum("df").alias("df")).toLocalIterator():
        df[row.term] = row.df
    coefficient = q.weighted(df, index.n_docs)

    def best_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bound, where = np.zeros((n_items, SEEDS), np.int64), np.full((n_items, SEEDS, 2), -1, np.int64)
        for shard in _shards(batches, q.vocabulary):
            for a, some in shard.bounds(q, coefficient):
                b = a + len(some)
                both = np.concatenate((bound[a:b], some), axis=1)
                places = np.empty((*both.shape, 2), np.int64)
                places[:, :SEEDS], places[:, SEEDS:, 0], places[:, SEEDS:, 1] = where[a:b], shard.row["shard"], np.arange(shard.n_blocks)
                top = np.argsort(-both, axis=1, kind="stable")[:, :SEEDS]
                bound[a:b], where[a:b] = np.take_along_axis(both, top, 1), np.take_along_axis(places, top[:, :, None], 1)
        item, slot = np.nonzero(bound)
        cols = [pa.array(item, pa.int32()), pa.array(bound[item, slot]), pa.array(where[item, slot, 0]), pa.array(where[item, slot, 1], pa.int32())]
        yield pa.RecordBatch.from_arrays(cols, names=["q", "bound", "shard", "block"])

    order = Window.partitionBy("q").orderBy(F.desc("bound"), "shard", "block")
    ranked = index.table.select("shard", "n_blocks", "block_docs", "terms", "maxima").mapInArrow(best_blocks, "q int, bound long, shard long, block int").withColumn("r", F.row_number().over(order))
    seeds: dict[int, list[tuple[int, int]]] = {}
    for row in ranked.where(F.col("r") <= SEEDS).toLocalIterator():
        seeds.setdefault(row.shard, []).append((row.q, row.block))

    def seed_scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[tuple[int, int]] = []
        for shard in _shards(batches, q.vocabulary):
            for item, block in seeds.get(shard.row["shard"], []):
                s = np.sort(shard.scores(block, q, coefficient, item))[::-1][:k]
                found += [(item, int(x)) for x in s if x > 0]
        yield pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], pa.int32()), pa.array([f[1] for f in found], pa.int64())], names=["q", "score"])

    threshold = np.ones(n_items, np.int64)  # a score must be above 0
    if seeds:
        chosen = index.table.join(F.broadcast(spark.createDataFrame([(s,) for s in seeds], "shard long")), "shard", "leftsemi")
        scored = chosen.mapInArrow(seed_scores, "q int, score long").withColumn("r", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"))))
        for row in scored.where(F.col("r") == k).toLocalIterator():
            threshold[row.q] = row.score

    def best_documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heaps: list[list[tuple[int, int, int]]] = [[] for _ in range(n_items)]
        least = threshold.copy()
        for shard in _shards(batches, q.vocabulary):
            ids = shard.row["ids"]
            for a, some in shard.bounds(q, coefficient):
                for i in np.flatnonzero((some >= least[a : a + len(some), None]).any(axis=1)).tolist():
                    item, bound, heap = a + i, some[i], heaps[a + i]
                    for block in np.argsort(-bound, kind="stable").tolist():
                        if bound[block] < least[item]:
                            break
                        s = shard.scores(block, q, coefficient, item)
                        for d in np.flatnonzero(s >= least[item]).tolist():
                            doc = ids[block * shard.block_docs + d]
                            new = (int(s[d]), -(int(NULL_ID) if doc is None else doc), doc is not None)
                            if len(heap) < k:
                                heapq.heappush(heap, new)
                            elif new > heap[0]:
                                heapq.heapreplace(heap, new)
                        if len(heap) == k:
                            least[item] = max(least[item], heap[0][0])
        out = [(i, -minus if known else None, score) for i, heap in enumerate(heaps) for score, minus, known in heap]
        cols = [pa.array([o[0] for o in out], pa.int32()), pa.array([o[1] for o in out], pa.int64()), pa.array([o[2] for o in out], pa.int64())]
        yield pa.RecordBatch.from_arrays(cols, names=["q", "doc_id", "score"])

    found = index.table.mapInArrow(best_documents, "q int, doc_id long, score long")
    order = Window.partitionBy("q").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    names = spark.createDataFrame(list(enumerate(q.ids)), f"q int, item_id {id_kind}")
    top = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return top.join(F.broadcast(names), "q").select("item_id", "rank", "doc_id", "score")


def lexical_search(docs: DataFrame, items: DataFrame, k: int = 10, query_bytes: int = 1 << 20, shard_bytes: int = 4 << 20, block_docs: int = 32) -> DataFrame:
    """(item_id, rank, doc_id, score): the k documents of ``docs`` (doc_id, text) that score best for each of ``items`` (item_id, text)."""
    if k < 1:
        raise ValueError("k must be at least 1")
    scratch = Scratch(docs.sparkSession)
    index = build_index(docs, scratch, shard_bytes, block_docs)
    return search(index, items, scratch, k, query_bytes)


def search(index: LexicalIndex, items: DataFrame, scratch: Scratch, k: int = 10, query_bytes: int = 1 << 20) -> DataFrame:
    """The same over an index that exists; every query block's results are a written table."""
    kind = items.schema["item_id"].dataType.simpleString()
    found = [scratch.table(_search(index, q, k, kind)) for q in _query_blocks(items, query_bytes)]
    empty = index.table.sparkSession.createDataFrame([], f"item_id {kind}, rank int, doc_id long, score long")
    return reduce(DataFrame.unionByName, found, empty)
