"""LM scoring by cross-entropy difference (Moore and Lewis).

A target bigram model (texts marked as target) and a background one (all others) share
one vocabulary, the words that occur at least twice in all texts, with one unknown
word for the rest. Both interpolate the bigram with an additively smoothed unigram. A
text's score is the mean over its words of the target loss less the background loss;
lower is closer to the target. A text's own counts are taken out of its model first.

Counts cover all texts: in two rounds of questions each block sends its distinct words,
then its distinct word pairs, with their counts in both parts, and gets the totals
back. A frequent word is one entry per block, and no table of counts is collected. Words
and pairs are 64-bit hashes (words of at most eight bytes don't collide with others of
their length): among n different pairs, n * n / 2**65 are expected to be counted
with another one. Totals are 64-bit numbers.

Cases: null and empty texts have no words and null scores; repeated rows are texts of
their own and count as such; extra columns are kept, and those that clash with an
output name are replaced; empty tables give empty results; without target texts the
target model is the uniform one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import decode_batch, pack, pack_ints, slices, split_key, unpack_ints
from .kernels import Words, buffers, mix64
from .scratch import Scratch

U64 = np.uint64
UNKNOWN = np.uint64(0x0123456789ABCDEF)
MIX, SMOOTH = 0.5, 1.0


def _entries(keys: np.ndarray, target: np.ndarray, bits: int) -> Iterator[tuple[int, bytes]]:
    """Per bucket the distinct keys, as steps from one to the next, with their counts in both parts."""
    unique, of = np.unique(keys, return_inverse=True)
    t = np.bincount(of, weights=target, minlength=len(unique)).astype(np.int64)
    b = np.bincount(of, minlength=len(unique)) - t
    bucket, _ = split_key(unique, bits)
    low = unique & U64((1 << 64 - bits) - 1)
    for k, i, j in slices(bucket):
        yield k, pack_ints(np.diff(low[i:j], prepend=U64(0)), t[i:j], b[i:j])


def _answer(blobs: list[bytes]) -> list[bytes]:
    """Totals of the keys that other blocks have too, behind a bit for each key."""
    parts = [unpack_ints(b, 3) for b in blobs]
    key = np.concatenate([np.cumsum(p[0]) for p in parts])
    order = np.argsort(key, kind="stable")
    new = np.ones(len(order), bool)
    new[1:] = key[order][1:] != key[order][:-1]
    at, head = np.cumsum(new) - 1, np.flatnonzero(new)
    many = np.zeros(len(order), bool)
    many[order] = (np.diff(np.append(head, len(order))) > 1)[at]
    totals = []
    for c in (1, 2):
        total = np.empty(len(order), np.int64)
        total[order] = np.add.reduceat(np.concatenate([p[c] for p in parts]).astype(np.int64)[order], head)[at]
        totals.append(total)
    out, i = [], 0
    for p in parts:
        j = i + len(p[0])
        m = many[i:j]
        out.append(np.packbits(m).tobytes() + pack_ints(*(x[i:j][m] for x in totals)))
        i = j
    return out


def _totals(keys: np.ndarray, target: np.ndarray, bits: int, blobs: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Totals (target, background) for each of ``keys``."""
    unique, of = np.unique(keys, return_inverse=True)
    t = np.bincount(of, weights=target, minlength=len(unique)).astype(np.int64)
    b = np.bincount(of, minlength=len(unique)) - t
    for (_, i, j), blob in zip(slices(split_key(unique, bits)[0]), blobs, strict=True):
        size = -(-(j - i) // 8)
        many = np.flatnonzero(np.unpackbits(np.frombuffer(blob, np.uint8, size), count=j - i)) + i
        t[many], b[many] = unpack_ints(blob[size:], 2)
    return t[of], b[of]


def _own(owner: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """How often each key occurs in its own text."""
    order = np.lexsort((keys, owner))
    new = np.ones(len(order), bool)
    new[1:] = (keys[order][1:] != keys[order][:-1]) | (owner[order][1:] != owner[order][:-1])
    at = np.cumsum(new) - 1
    out = np.empty(len(order), np.int64)
    out[order] = np.bincount(at)[at] if len(at) else at
    return out


class _Text:
    def __init__(self, batch: pa.RecordBatch, text_at: int, flag_at: int):
        words = Words(*buffers(batch.column(text_at)), lower=True)
        self.n, self.owner, self.word = words.counts, words.owners(), words.hash
        self.flag = np.array(batch.column(flag_at).fill_null(False).to_pylist(), bool)
        self.target = self.flag[self.owner].astype(float)

    def known(self, t: np.ndarray, b: np.ndarray, least: int) -> None:
        self.word = np.where(t + b >= least, self.word, UNKNOWN)

    def pairs(self) -> np.ndarray:
        """Keys of (previous word or start, word)."""
        before = np.empty_like(self.word)
        before[1:] = self.word[:-1]
        before[np.concatenate(([0], np.cumsum(self.n)[:-1]))[self.n > 0]] = U64(1)
        self.before = before
        return mix64(before * U64(0x9E3779B97F4A7C15) + self.word)


def lm_scoring(docs: DataFrame, target: str = "target", text: str = "text", least: int = 2) -> DataFrame:
    """``docs`` (with a boolean ``target``) without the text, with n_words, ce_target, ce_background, score."""
    names = ["n_words", "ce_target", "ce_background", "score"]
    docs = docs.select(*[c for c in docs.columns if c in (text, target) or c.lower() not in names])
    text_at, flag_at = docs.columns.index(text), docs.columns.index(target)
    blocks, scratch = pack(docs, text), Scratch(docs.sparkSession)
    bits = blocks.bits
    load = lambda batch: _Text(batch, text_at, flag_at)

    def ask_words(batch: pa.RecordBatch, _: dict):
        x = load(batch)
        return _entries(x.word, x.target, bits)

    first = scratch.table(blocks.ask(ask_words, _answer, 1))

    def with_words(batch: pa.RecordBatch, answers: dict) -> tuple[_Text, np.ndarray, np.ndarray]:
        x = load(batch)
        t, b = _totals(x.word, x.target, bits, answers.get(1, []))
        x.known(t, b, least)
        return x, t, b

    def size(block_id: int, body: bytes, answers: dict) -> pa.RecordBatch:
        x, t, b = with_words(decode_batch(body), answers)
        total = t + b
        known = total >= least
        # each occurrence of a word counts 1 / total towards the number of words
        return pa.RecordBatch.from_pydict({"t": [float(x.target.sum())], "b": [float(len(x.word) - x.target.sum())], "v": [float((1 / total[known]).sum())], "ut": [float(x.target[~known].sum())], "ub": [float((1 - x.target)[~known].sum())]})

    n_t, n_b, vocabulary, u_t, u_b = (x or 0.0 for x in blocks.with_answers(first, size, "t double, b double, v double, ut double, ub double").agg(*(F.sum(c) for c in ("t", "b", "v", "ut", "ub"))).first())
    vocabulary = round(vocabulary) + 1

    def ask_pairs(batch: pa.RecordBatch, answers: dict):
        x, _, _ = with_words(batch, answers)
        return _entries(x.pairs(), x.target, bits)

    second = scratch.table(blocks.ask(ask_pairs, _answer, 2, first))
    keep = [c for c in docs.columns if c != text]
    where, types = {c: docs.columns.index(c) for c in keep}, dict(docs.dtypes)
    schema = ", ".join([f"`{c}` {types[c]}" for c in keep] + ["n_words bigint, ce_target double, ce_background double, score double"])

    def finish(block_id: int, body: bytes, answers: dict) -> pa.RecordBatch:
        batch = decode_batch(body)
        x, t1, b1 = with_words(batch, answers)
        unknown = x.word == UNKNOWN
        t1, b1 = np.where(unknown, u_t, t1), np.where(unknown, u_b, b1)
        keys = x.pairs()
        t2, b2 = _totals(keys, x.target, bits, answers.get(2, []))
        own1, own2, size = _own(x.owner, x.word), _own(x.owner, keys), x.n[x.owner]
        starts = x.before == U64(1)
        losses = []
        for uni, pair, total, inside in ((t1, t2, n_t, x.target > 0), (b1, b2, n_b, x.target == 0)):
            uni, pair, total = uni - own1 * inside, pair - own2 * inside, total - size * inside
            p1 = (np.maximum(uni, 0) + SMOOTH) / (np.maximum(total, 0) + SMOOTH * vocabulary)
            prior = np.empty_like(uni, dtype=float)  # count of the word before
            prior[1:] = uni[:-1]
            prior[starts] = 0
            p2 = np.divide(pair, prior, out=p1.astype(float).copy(), where=prior > 0)
            losses.append(-np.log(MIX * np.minimum(p2, 1) + (1 - MIX) * p1))
        m = len(x.n)
        n = np.where(x.n > 0, x.n, 1)
        ce = [np.bincount(x.owner, weights=l, minlength=m) / n for l in losses]
        none = x.n == 0
        cols = [pa.array(x.n, pa.int64()), *(pa.array(v, pa.float64(), mask=none) for v in (ce[0], ce[1], ce[0] - ce[1]))]
        return pa.RecordBatch.from_arrays([*(batch.column(where[c]) for c in keep), *cols], names=[*keep, *names])

    return blocks.with_answers(first.unionByName(second), finish, schema)


def mark_target(docs: DataFrame, ids: DataFrame, broadcast_rows: int = 1_000_000) -> DataFrame:
    """``docs`` with ``target``: whether doc_id is in ``ids``; broadcast only if those are counted to be few.

    Beyond that the shuffled join is written as a table, so that blocks are always made of the same rows.
    """
    ids = ids.select("doc_id").where("doc_id IS NOT NULL").distinct().withColumn("target", F.lit(True))
    few = ids.limit(broadcast_rows + 1).count() <= broadcast_rows
    marked = docs.drop("target").join(F.broadcast(ids) if few else ids, "doc_id", "left").withColumn("target", F.coalesce("target", F.lit(False)))
    return marked if few else Scratch(docs.sparkSession).table(marked)
