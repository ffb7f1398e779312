"""SentencePiece encoding and decoding: unigram Viterbi over a double-array trie.

The pieces come from a SentencePiece model file (its path is a parameter; nothing is
trained). A unigram model's scores are used as they are. The pieces of a BPE model
carry their rank instead, so their log scores follow Zipf's law,
``-log(rank + ZIPF_SHIFT)`` normalised over the vocabulary.

Encoding follows the SentencePiece rules for the identity normaliser: a space becomes
the marker U+2581, one marker is put before the text, and where no piece covers a
single character an unknown edge with the lowest score minus 10 is taken, which
becomes the character's byte pieces. No piece of such a vocabulary has a marker after
another character, so the best path of a text is the sequence of the best paths of its
units (runs of markers with what follows). Distinct units of a batch go through the
trie and the Viterbi recursion together in numpy, position by position, in 32-bit
floats and with the earliest start kept on ties. A model with pieces across units is
encoded in one unit per text.

A narrow map: no shuffle; the trie is shipped once (a vocabulary, not data). Memory is
bounded by one Arrow batch plus scratch for ``CELLS`` trellis cells or one long unit.

Cases: a null or empty text has no pieces and decodes to an empty text; a text that
itself holds U+2581 decodes to a space there, so ``round_trip`` is false; repeated
rows are encoded row by row; extra columns are kept, and those that clash with an
output name are replaced; an empty table gives an empty result.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kernels import buffers, groups, hash_ranges, release, same_ranges

MARK = "▁".encode()
UNKNOWN_PENALTY = 10.0
ZIPF_SHIFT = 2.7
CELLS = 1 << 20
#: Piece kinds and model kinds of the file format (fixed values).
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2
_CHAR_BYTES = np.ones(256, np.int64)
_CHAR_BYTES[0xC0:0xE0], _CHAR_BYTES[0xE0:0xF0], _CHAR_BYTES[0xF0:] = 2, 3, 4


def _fields(data: bytes) -> Iterator[tuple[int, object]]:
    """(field number, value) pairs of a protocol buffer message."""
    i = 0

    def varint() -> int:
        nonlocal i
        value = shift = 0
        while True:
            byte = data[i]
            i += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while i < len(data):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
        elif kind == 2:
            n = varint()
            yield tag >> 3, data[i : i + n]
            i += n
        else:
            n = {1: 8, 5: 4}[kind]
            yield tag >> 3, struct.unpack("<d" if n == 8 else "<f", data[i : i + n])[0]
            i += n


@dataclass
class Vocabulary:
    pieces: list[bytes]
    scores: np.ndarray  # float32 log scores
    kinds: np.ndarray
    byte_ids: np.ndarray  # id of each byte's piece, or the unknown id
    unknown: int

    @staticmethod
    def load(path: str) -> Vocabulary:
        with open(path, "rb") as f:
            return Vocabulary.parse(f.read())

    @staticmethod
    def parse(data: bytes) -> Vocabulary:
        pieces, scores, kinds, model = [], [], [], UNIGRAM
        for field, value in _fields(data):
            if field == 1:
                got = dict(_fields(value))
                pieces.append(bytes(got.get(1, b"")))
                scores.append(got.get(2, 0.0))
                kinds.append(got.get(3, NORMAL))
            elif field == 2:
                model = dict(_fields(value)).get(3, UNIGRAM)
        return Vocabulary.of(pieces, scores, kinds, model)

    @staticmethod
    def of(pieces: list[bytes], scores: list[float], kinds: list[int], model: int = UNIGRAM) -> Vocabulary:
        k, s = np.array(kinds), np.array(scores, np.float64)
        if model == BPE:
            normal = k == NORMAL
            weight = -np.log(-s[normal] + ZIPF_SHIFT)
            s[normal] = weight - np.log(np.exp(weight).sum())
        unknown = int(np.flatnonzero(k == UNKNOWN)[0])
        byte_ids = np.full(256, unknown, np.int32)
        for i in np.flatnonzero(k == BYTE):
            byte_ids[int(pieces[i][3:5], 16)] = i
        return Vocabulary(pieces, s.astype(np.float32), k, byte_ids, unknown)


@dataclass
class DoubleArray:
    """A trie in two arrays: the child of node s by byte c is t = base[s] + c + 1 if check[t] == s."""

    base: np.ndarray
    check: np.ndarray
    value: np.ndarray  # a key's number at its last node, or -1

    @staticmethod
    def build(keys: list[tuple[bytes, int]]) -> DoubleArray:
        keys = sorted(keys)
        size = 1 << 12
        base, check, value = np.zeros(size, np.int32), np.full(size, -1, np.int32), np.full(size, -1, np.int32)
        check[0] = 0
        free = 1  # no free cell lies before it
        todo = [(0, 0, len(keys), 0)]  # node, range of keys, depth
        while todo:
            node, low, high, depth = todo.pop()
            if low < high and len(keys[low][0]) == depth:
                value[node] = keys[low][1]
                low += 1
            if low == high:
                continue
            cuts, labels = [low], [keys[low][0][depth]]
            for i in range(low + 1, high):
                c = keys[i][0][depth]
                if c != labels[-1]:
                    cuts.append(i)
                    labels.append(c)
            steps = np.array(labels) + 1
            low_cell, at = free, -1
            while at < 0:
                if low_cell + 1024 > size:
                    base, check, value = (np.concatenate((x, np.full(size, v, np.int32))) for x, v in ((base, 0), (check, -1), (value, -1)))
                    size *= 2
                cells = np.flatnonzero(check[low_cell : min(low_cell + 2048, size - 512)] < 0) + low_cell
                tries = cells[cells >= steps[0]] - steps[0]
                fits = (check[tries[:, None] + steps] < 0).all(axis=1) if len(tries) else np.zeros(0, bool)
                if fits.any():
                    at = int(tries[fits.argmax()])
                elif low_cell == free and len(cells) < 64:
                    free += 1024  # as good as full
                low_cell += 1024
            base[node] = at
            check[at + steps] = node
            for s, a, b in zip(steps.tolist(), cuts, [*cuts[1:], high], strict=True):
                todo.append((at + s, a, b, depth + 1))
        return DoubleArray(base, check, value)


class Encoder:
    def __init__(self, vocabulary: Vocabulary):
        self.v = v = vocabulary
        usable = np.isin(v.kinds, (NORMAL, USER_DEFINED))
        self.trie = DoubleArray.build([(p, i) for i, p in enumerate(v.pieces) if usable[i] and p])
        self.unknown_score = np.float32(v.scores[v.kinds == NORMAL].min() - UNKNOWN_PENALTY)
        self.split = not any(p.lstrip(MARK).find(MARK) >= 0 if p.startswith(MARK) else MARK in p for i, p in enumerate(v.pieces) if usable[i])
        out = [bytes([int(p[3:5], 16)]) if k == BYTE else b" \xe2\x81\x87 " if k == UNKNOWN else b"" if k == CONTROL else p for p, k in zip(v.pieces, v.kinds.tolist(), strict=True)]
        self.size = np.array([len(p) for p in out])
        self.begin = np.concatenate(([0], np.cumsum(self.size)))
        self.flat = np.frombuffer(b"".join(out), np.uint8)

    def _viterbi(self, data: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Best paths of n units of similar size: flat piece ids, pieces per unit. Unknown characters become bytes."""
        n, most = len(start), int(size.max())
        cells = np.zeros((n, most), np.uint8)
        inside = np.arange(most) < size[:, None]
        cells[inside] = data[np.repeat(start - (np.cumsum(size) - size), size) + np.arange(size.sum())]
        best = np.full((n, most + 1), -np.inf, np.float32)
        best[:, 0] = 0
        back, piece = np.zeros((n, most + 1), np.int32), np.full((n, most + 1), -1, np.int32)
        base, check, value, scores = self.trie.base, self.trie.check, self.trie.value, self.v.scores
        for s in range(most):
            rows = np.flatnonzero((size > s) & (best[:, s] > -np.inf))
            if not len(rows):
                continue
            here = best[rows, s]
            char = np.minimum(_CHAR_BYTES[cells[rows, s]], size[rows] - s)
            single = np.zeros(len(rows), bool)
            live, node, t = np.arange(len(rows)), np.zeros(len(rows), np.int32), s
            while len(live):
                r = rows[live]
                ok = size[r] > t
                if not ok.any():
                    break
                live, node, r = live[ok], node[ok], r[ok]
                step = base[node] + cells[r, t] + 1
                ok = check[step] == node
                live, node, r = live[ok], step[ok], r[ok]
                t += 1
                got = value[node]
                hit = got >= 0
                if hit.any():
                    l, r, got = live[hit], r[hit], got[hit]
                    single[l] |= char[l] == t - s
                    score = scores[got] + here[l]
                    up = score > best[r, t]
                    r = r[up]
                    best[r, t], back[r, t], piece[r, t] = score[up], s, got[up]
            lone = ~single
            if lone.any():
                r, end = rows[lone], s + char[lone]
                score = self.unknown_score + here[lone]
                up = score > best[r, end]
                r, end = r[up], end[up]
                best[r, end], back[r, end], piece[r, end] = score[up], s, -1
        # paths from the ends; an unknown character gives as many pieces as bytes
        at, steps = size.copy(), []
        rows = np.arange(n)
        while len(rows):
            end = at[rows]
            begin = back[rows, end]
            steps.append((rows, begin, end, piece[rows, end]))
            at[rows] = begin
            rows = rows[begin > 0]
        row, begin, end, got = (np.concatenate(x) for x in zip(*steps, strict=True))
        count = np.where(got < 0, end - begin, 1)
        order = np.lexsort((begin, row))
        row, begin, got, count = row[order], begin[order], got[order], count[order]
        ids = np.repeat(got, count)
        pos = np.repeat(begin - (np.cumsum(count) - count), count) + np.arange(len(ids))
        raw = ids < 0
        ids[raw] = self.v.byte_ids[cells[np.repeat(row, count)[raw], pos[raw]]]
        return ids, np.bincount(row, weights=count, minlength=n).astype(np.int64)

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Flat piece ids of all texts, and n + 1 offsets into them."""
        n = len(offsets) - 1
        # markers: three bytes for each space, and three before each text that isn't empty
        size = np.diff(offsets)
        width = np.where(data == 32, 3, 1)
        first = offsets[:-1][size > 0]
        lead = np.zeros(len(data), np.int64)
        lead[first] = 3
        place = np.cumsum(width + lead) - width
        text = np.zeros(int(place[-1] + width[-1]) if len(data) else 0, np.uint8)
        space = data == 32
        text[place[~space]] = data[~space]
        marks = np.concatenate((place[space], place[first] - 3))
        for k in range(3):
            text[marks + k] = MARK[k]
        bounds = np.concatenate((place[first] - 3, [len(text)])).astype(np.int64)
        if self.split and len(text):
            is_mark = np.zeros(len(text), bool)
            third = (text[:-2] == MARK[0]) & (text[1:-1] == MARK[1]) & (text[2:] == MARK[2])
            is_mark[:-2] = third
            follows = np.zeros(len(text), bool)
            follows[3:] = is_mark[:-3]
            begins = is_mark & ~follows
            begins[bounds[:-1]] = True
            start = np.flatnonzero(begins)
        else:
            start = bounds[:-1]
        end = np.concatenate((start[1:], [len(text)])).astype(np.int64)
        if not len(start):
            return np.zeros(0, np.int32), np.zeros(n + 1, np.int64)
        hashes, units = hash_ranges(text, start, end), end - start
        _, head, of = np.unique(hashes, return_index=True, return_inverse=True)
        # a unit that isn't what its hash stands for is a unit of its own; up to eight bytes hashes don't collide
        odd = [np.flatnonzero(units != units[head][of])]
        long = np.flatnonzero((units == units[head][of]) & (units > 8) & (start != start[head][of]))
        for part in np.array_split(long, 1 + len(long) // 8192):
            odd.append(part[~same_ranges(text, start[part], units[part], start[head][of[part]])])
        odd = np.concatenate(odd)
        of[odd] = len(head) + np.arange(len(odd))
        head = np.concatenate((head, odd))
        u_start, u_size = start[head], units[head]
        order = np.argsort(u_size, kind="stable")
        counts = np.zeros(len(head), np.int64)
        parts, i = [], 0
        while i < len(order):
            j = i + 1
            low, high = i + 1, min(len(order), i + CELLS)
            while low <= high:  # as many units as the trellis may hold
                mid = (low + high) // 2
                if (mid - i) * (u_size[order[mid - 1]] + 1) <= CELLS:
                    j, low = mid, mid + 1
                else:
                    high = mid - 1
            rows = order[i:j]
            ids, c = self._viterbi(text, u_start[rows], u_size[rows])
            counts[rows] = c
            parts.append(ids)
            i = j
        flat = np.concatenate(parts)
        where = np.zeros(len(head), np.int64)
        where[order] = np.cumsum(counts[order]) - counts[order]
        c = counts[of]
        out = flat[np.repeat(where[of] - (np.cumsum(c) - c), c) + np.arange(c.sum())].astype(np.int32)
        ends = np.concatenate(([0], np.cumsum(c)))
        filled = np.flatnonzero(size > 0)
        last = np.searchsorted(start, bounds[1:])
        result = np.zeros(n + 1, np.int64)
        result[filled + 1] = ends[last]
        return out, np.maximum.accumulate(result)

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> list[bytes]:
        """Bytes of each sequence: markers become spaces, and the first one goes."""
        size = self.size[ids]
        flat = self.flat[np.repeat(self.begin[ids] - (np.cumsum(size) - size), size) + np.arange(size.sum())].tobytes()
        ends = np.concatenate(([0], np.cumsum(size)))[offsets]
        return [flat[a:b].replace(MARK, b" ")[1 if a < b else 0 :] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]


OUTPUT = {"ids": "array<int>", "n_tokens": "bigint", "n_byte_tokens": "bigint", "ids_sha256": "string", "decoded": "string", "round_trip": "boolean"}
_KINDS = {"ids": pa.list_(pa.int32()), "n_tokens": pa.int64(), "n_byte_tokens": pa.int64(), "ids_sha256": pa.string(), "decoded": pa.string(), "round_trip": pa.bool_()}


def sentencepiece(docs: DataFrame, model_path: str, text: str = "text", outputs: tuple[str, ...] = tuple(OUTPUT)) -> DataFrame:
    """``docs`` with the chosen outputs; ``ids_sha256`` is over the ids, comma-joined."""
    import hashlib

    encoder = Encoder(Vocabulary.load(model_path))
    shared = docs.sparkSession.sparkContext.broadcast(encoder)  # a vocabulary: bounded whatever the data
    keep = [c for c in docs.columns if c.lower() not in OUTPUT]
    types = dict(docs.dtypes)
    schema = ", ".join([f"`{c}` {types[c]}" for c in keep] + [f"{o} {OUTPUT[o]}" for o in outputs])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = shared.value
        byte_piece = e.v.kinds == BYTE
        for batch in batches:
            data, offsets = buffers(batch.column(batch.num_columns - 1))
            for i, j in groups(offsets):
                part, where = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
                ids, ends = e.encode(part, where)
                cols: dict[str, object] = {"n_tokens": np.diff(ends)}
                if "ids" in outputs:
                    cols["ids"] = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids, pa.int32()))
                if "n_byte_tokens" in outputs:
                    cols["n_byte_tokens"] = np.diff(np.concatenate(([0], np.cumsum(byte_piece[ids])))[ends])
                if "ids_sha256" in outputs:
                    every = ids.tolist()
                    cols["ids_sha256"] = [hashlib.sha256(",".join(map(str, every[a:b])).encode()).hexdigest() for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
                if "decoded" in outputs or "round_trip" in outputs:
                    back, whole = e.decode(ids, ends), part.tobytes()
                    if "decoded" in outputs:
                        cols["decoded"] = [b.decode("utf-8", "replace") for b in back]
                    cols["round_trip"] = [b == whole[x:y] for b, x, y in zip(back, where[:-1].tolist(), where[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([*batch.slice(i, j - i).columns[:-1], *(x if isinstance(x := cols[o], pa.Array) else pa.array(x, _KINDS[o]) for o in outputs)], names=[*keep, *outputs])
                del ids, cols
                release()

    return docs.select(*[F.col(f"`{c}`") for c in keep], F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("__text")).mapInArrow(run, schema)
