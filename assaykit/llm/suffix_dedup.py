"""Suffix-array dedup by merging the Burrows-Wheeler transforms of shards.

A byte goes if a string of ``width`` bytes covers it that also starts in a document
with a smaller id. Matches never cross documents, overlaps count, and strings are
judged on the input.

1. Windows of ``width`` bytes fall into runs that share the gram of ``GRAM`` bytes with
   the smallest rolling hash inside (winnowing); they are cut once, and kept with the text.
   The key is a hash of the gram. Equal windows have equal keys, so one round of
   questions finds the keys that more than one document has; all else is unique.
2. A run's bytes are a segment. In a second round each block sends digests of its
   distinct segments. If all segments of a key are the same string, the smallest id
   among them settles every window in them. "The same" and the keys go by 64-bit hashes; two of n
   different segments are taken for one by chance with probability n * n / 2**65.
3. For the others the blocks send the segments themselves, but for the gram that all
   windows of a segment share: a mark and a number of its key stand in its place, which
   leaves 21 or so of 50 symbols to sort by. Windows that hold their gram repeatedly are
   sent whole. In each bucket they form shards; each shard gets its suffix array and BWT,
   and the BWTs are merged by iterative interleave refinement (Holt and McMillan): a step
   sorts the merged suffixes by q symbols more, from the interleave so far and the BWT
   symbols alone (the q symbols before each suffix, as many as fit in 64 bits beside a
   place), and where a new boundary opens the suffixes share what had been sorted before.
   After a window's symbols the intervals without boundary are the repeated windows; the
   smallest id in each decides. No suffix of the merged text is compared or sorted anew. A
   key of which only one string is left has nothing to merge.
   A key with very many different segments (a passage that a large share of the
   documents quote, each with its own neighbours) is sent window by window under
   keys of the windows, so that no bucket holds the group.

Cases: a null text is empty; texts shorter than ``width`` lose nothing; rows with one
id don't cover each other; ids must be integers (an error otherwise), a null id counts as the largest; repeated rows are
separate rows; extra columns pass through, and those that clash with a chosen output
are replaced; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import Blocks, decode_batch, id_array, pack, slices, split_key
from .kernels import KEEP, buffers, hash_ranges, mix64, rolling, sliding_min
from .scratch import Scratch

GRAM = 32
#: Bytes of text of a bucket, at least.
BUCKET_BYTES = 16 << 20
#: Bits of a key that tell runs apart before the third round.
KEY_BITS = 44
#: Instead of the place of the gram, where windows hold it repeatedly; the symbol before a gram's number.
RAW, MARK = (1 << 16) - 1, 256
#: Windows of a segment at most; cuts runs of a repeated gram.
MAX_RUN = 128
#: Distinct segments of one key from which its windows get keys of their own.
HOT = 256
#: Bytes of a text whose rolling values are made at a time.
CACHED = 1 << 16
U64 = np.uint64


def in_order(key: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The stable order of numbers of ``bits`` bits, and the numbers in it: one sort of numbers with their places, where both fit in 64 bits."""
    room = len(key).bit_length()
    if bits + room > 64:
        order = np.argsort(key, kind="stable")
        return order, key[order]
    both = key << U64(room)
    both |= np.arange(len(key), dtype=U64)
    both.sort()
    return (both & U64((1 << room) - 1)).astype(np.int64), both >> U64(room)


def _lowest_grams(data: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """For each window where its smallest gram begins in it, the first of equal ones, and whether there are more; in pieces that stay in a core's cache."""
    n, place = len(data) - width + 1, U64((1 << 17) - 1)
    lead, more = np.empty(n, np.uint16), np.empty(n, bool)
    for a in range(0, n, CACHED):
        value = rolling(data[a : min(a + CACHED, n) + width - 1], GRAM)
        value &= ~place
        at = np.arange(len(value), dtype=U64)
        first, last = (sliding_min(value | x, width - GRAM + 1) & place for x in (at, place - at))
        lead[a : a + CACHED] = first - at[: len(first)]
        np.not_equal(first, place - last, out=more[a : a + CACHED])
    return lead, more


def cut_runs(data: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows that share their smallest gram: text, number of windows (128 more where they hold it repeatedly) less one, and where the gram begins in the first."""
    n = len(data) - width + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint8), np.zeros(0, np.uint16)
    lead, more = _lowest_grams(data, width)
    # the place of the gram changes; where windows hold it repeatedly only the first and the last of them count
    new = np.ones(n, bool)
    np.not_equal(lead[1:] + 1, lead[:-1], out=new[1:])
    new[1:] &= ~more[1:]
    new[1:] |= more[1:] != more[:-1]
    new[offsets[:-1][offsets[:-1] < n]] = True
    start = np.flatnonzero(new)
    text = np.searchsorted(offsets, start, "right") - 1
    # windows that would leave their text, the last width - 1 starts of each, don't count
    length = np.minimum(np.concatenate((start[1:], [n])), offsets[text + 1] - width + 1) - start
    good = length > 0
    start, length, text = start[good], length[good], text[good]
    if len(length) and length.max() > MAX_RUN:
        parts = -(-length // MAX_RUN)
        which = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
        start, length, text = np.repeat(start, parts) + which * MAX_RUN, np.minimum(np.repeat(length, parts) - which * MAX_RUN, MAX_RUN), np.repeat(text, parts)
    return text, (length - 1 + 128 * more[start]).astype(np.uint8), lead[start]


def with_runs(batch: pa.RecordBatch, text_at: int, width: int) -> pa.RecordBatch:
    """The batch with the runs of each text as two more columns."""
    data, offsets = buffers(batch.column(text_at))
    text, length, lead = cut_runs(data, offsets, width)
    end = np.searchsorted(text, np.arange(len(batch) + 1))
    columns = [pa.Array.from_buffers(pa.binary(), len(batch), [None, pa.py_buffer((end * x.itemsize).astype(np.int32)), pa.py_buffer(x)]) for x in (length, lead)]
    return pa.RecordBatch.from_arrays([*batch.columns, *columns], names=[*batch.schema.names, "length_", "lead_"])


class Strings:
    """Strings with a terminator each, read in circles: a position's symbols end where it began.

    What follows a terminator is of no meaning, but orders all positions, so that the
    step from a position to the one ``q`` symbols before is a permutation.
    """

    def __init__(self, texts: np.ndarray, offsets: np.ndarray):
        m = len(offsets) - 1
        self.begin = offsets[:-1] + np.arange(m)
        self.size = np.diff(offsets) + 1
        used = np.zeros(MARK + 1, bool)
        used[texts] = True
        #: symbols: the bytes and marks that occur, in order, behind the terminator 0
        self.kinds = int(used.sum()) + 1
        self.symbols = np.zeros(len(texts) + m, U64)
        keep = np.ones(len(self.symbols), bool)
        keep[self.begin + self.size - 1] = False
        self.symbols[keep] = np.cumsum(used).astype(U64)[texts]
        #: symbols that fit in 64 bits beside a position, and their bits
        room = 64 - len(self.symbols).bit_length()
        self.step = next(q for q in range(room, 0, -1) if self.kinds**q <= 1 << room)
        self.bits = (self.kinds**self.step - 1).bit_length()

    def ahead(self, by: int) -> np.ndarray:
        """The position ``by`` symbols further on, for all positions."""
        at = np.arange(by, len(self.symbols) + by)
        # only the last positions of a string go round
        last = np.minimum(self.size, by)
        size = np.repeat(self.size, last)
        step = np.arange(len(size)) - np.repeat(np.cumsum(last) - last, last)
        past = np.repeat(self.begin + self.size - last, last) + step
        at[past] = np.repeat(self.begin, last) + (at[past] - np.repeat(self.begin, last)) % size
        return at

    def codes(self, n: int) -> np.ndarray:
        """The next ``n`` symbols of each position as one number."""
        if n == 1:
            return self.symbols
        half = self.codes(n // 2)
        out = half * U64(self.kinds ** (n // 2)) + half[self.ahead(n // 2)]
        return out * U64(self.kinds) + self.symbols[self.ahead(n - 1)] if n % 2 else out


def suffix_array(strings: Strings, codes: np.ndarray, low: int, high: int, depth: int) -> np.ndarray:
    """Positions of whole strings low to high, sorted by ``depth`` symbols at least; ties in any order. ``codes``: the next ``step`` symbols of each position."""
    done, room = strings.step, (high - low).bit_length()
    order, s = in_order(codes[low:high], strings.bits)
    while done < depth:
        rank = np.empty(len(order), U64)
        rank[order] = np.cumsum(np.concatenate(([0], s[1:] != s[:-1]))).astype(U64)
        order, s = in_order((rank << U64(room)) | rank[strings.ahead(done)[low:high] - low], 2 * room)
        done *= 2
    return order + low


def merge_bwts(sizes: list[int], bwt: Callable[[int], np.ndarray], step: int, bits: int, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Interleaves the BWTs of shards with ``sizes`` suffixes; returns the merged order (global item numbers) and common prefixes.

    ``bwt(q)`` holds the ``q`` symbols before each shard's suffixes in order of their rank,
    as numbers of ``bits`` bits at most. Each step refines the interleave by ``step``
    symbols, the first by what else is left: merged suffixes sorted stably by the symbols
    before them are the suffixes that begin there, in order. ``lcp[j]`` says how many symbols
    merged suffixes j - 1 and j were known to share when a boundary opened between them
    (``depth``: none opened).
    """
    total = sum(sizes)
    ranks = item = np.arange(total, dtype=np.int32)
    z, group = np.repeat(np.arange(len(sizes)), sizes).astype(np.uint8), np.zeros(total, np.int32)
    lcp = np.full(total, depth, np.int16)
    lcp[0] = done = 0
    while done < depth:
        q = step if (depth - done) % step == 0 else (depth - done) % step
        if done <= step:  # the first step, or the first whole one
            symbols = bwt(q)
        order, symbol = in_order(symbols[item], bits)
        group, z = group[order], z[order]
        item = np.empty(total, np.int32)
        item[np.argsort(z, kind="stable")] = ranks
        edge = (symbol[1:] != symbol[:-1]) | (group[1:] != group[:-1])
        opened = lcp[1:]
        opened[edge & (opened == depth)] = done
        np.cumsum(edge, out=group[1:])
        group[0] = 0
        done += q
        if group[-1] == total - 1:  # every suffix stands alone
            break
    return item, lcp


def window_owners(texts: np.ndarray, offsets: np.ndarray, n_windows: np.ndarray, owner: np.ndarray, width: int, n_shards: int = 4) -> list[np.ndarray]:
    """For each string the smallest owner of each of its windows, among all the strings."""
    m = len(offsets) - 1
    n_shards = max(1, min(n_shards, m))
    strings = Strings(texts, offsets)
    begin, total = strings.begin, len(strings.symbols)
    cuts = np.searchsorted(begin, np.linspace(0, total, n_shards + 1)[1:-1])
    edges = np.unique(np.concatenate(([0], cuts, [m])))
    codes = strings.codes(strings.step)
    arrays = [suffix_array(strings, codes, int(begin[a]), int(begin[b]) if b < m else total, width) for a, b in zip(edges[:-1], edges[1:], strict=True)]
    every = np.concatenate(arrays)

    def bwt(q: int) -> np.ndarray:
        before = np.empty(total, U64)
        before[strings.ahead(q)] = codes if q == strings.step else strings.codes(q)
        return before[every]

    item, lcp = merge_bwts([len(sa) for sa in arrays], bwt, strings.step, strings.bits, width)
    place = every[item]
    string = np.repeat(np.arange(m), strings.size)[place]
    window = (place - begin[string]) < n_windows[string]
    value = np.where(window, owner[string], np.iinfo(np.int64).max)
    head = np.flatnonzero(lcp < width)
    least = np.minimum.reduceat(value, head)
    at = np.empty(total, np.int64)
    at[place] = np.repeat(least, np.diff(np.concatenate((head, [total]))))
    return [at[b : b + w] for b, w in zip(begin.tolist(), n_windows.tolist(), strict=True)]


def named_grams(text: np.ndarray, length: np.ndarray, lead: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, int]:
    """Strings with a name in the place of their grams, and the length of a name: a mark and the key's number, in bytes that occur."""
    number = np.cumsum(np.concatenate(([0], key[1:] != key[:-1])))
    digits = np.flatnonzero(np.bincount(text, minlength=2))
    digits = digits if len(digits) > 1 else np.arange(2)
    n = 1
    while len(digits) ** n <= number[-1]:
        n += 1
    begin = np.cumsum(length) - length
    step = np.arange(len(text)) - np.repeat(begin, length)
    name = begin + lead + np.arange(len(length)) * (n + 1)
    out = np.empty(len(text) + len(length) * (n + 1), np.uint16)
    out[np.arange(len(text)) + (n + 1) * (np.repeat(np.arange(len(length)), length) + (step >= np.repeat(lead, length)))] = text
    out[name] = MARK
    for k in range(n):
        out[name + 1 + k] = digits[number // len(digits) ** k % len(digits)]
    return out, n + 1


def short_hashes(data: np.ndarray, at: np.ndarray, size: np.ndarray | int, most: int) -> np.ndarray:
    """64-bit hashes of ranges of up to ``most`` bytes: eight bytes a round, each round a bijection of what it mixes in. All take as many rounds."""
    padded = np.concatenate((data, np.zeros(8, np.uint8)))
    eight = np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))
    out, size = np.zeros(len(at), U64), np.broadcast_to(size, len(at))
    for a in range(0, len(at), CACHED):
        some, left = at[a : a + CACHED], size[a : a + CACHED]
        h = left.astype(U64)
        for k in range(0, most, 8):
            # a range that has ended takes zeros in, from any place
            h ^= eight[np.minimum(some + k, len(data))] & KEEP[np.clip(left - k, 0, 8)] if k + 8 > int(left.min()) else eight[some + k]
            h *= U64(0x9FB21C651E98DF25)
            h ^= h >> U64(32)
        out[a : a + CACHED] = mix64(h)
    return out


class _Block:
    """What one block knows: its runs, distinct segments and, as answers come in, removed windows."""

    def __init__(self, batch: pa.RecordBatch, text_at: int, id_at: int, width: int, bits: int):
        self.width, self.bits = width, bits
        self.data, self.offsets = buffers(batch.column(text_at))
        self.ids = id_array(batch.column(id_at))
        length, end = buffers(batch.column(batch.num_columns - 2))
        lead = buffers(batch.column(batch.num_columns - 1))[0].view(np.uint16).astype(np.int64)
        runs, more = np.diff(end), length >= 128
        text = np.repeat(np.arange(len(runs)), runs)
        length = (length & 127) + np.int64(1)
        begin = np.concatenate(([0], np.cumsum(length)))
        start = begin[:-1] + np.repeat(self.offsets[:-1] - begin[end[:-1]], runs)
        key = short_hashes(self.data, start + lead, GRAM, GRAM)
        key[more] = mix64(key[more] ^ U64(0x5851F42D4C957F2D))
        lead[more] = RAW
        self.start, self.length, self.text, self.key, self.lead = start, length, text, key, lead
        self.order, short = in_order(key >> U64(64 - KEY_BITS), KEY_BITS)
        self.head = np.flatnonzero(np.concatenate((np.ones(min(1, len(short)), bool), short[1:] != short[:-1])))
        self.unique = short[self.head] << U64(64 - KEY_BITS)

    def _take(self, rows: np.ndarray) -> None:
        self.start, self.length, self.text, self.key, self.lead = (x[rows] for x in (self.start, self.length, self.text, self.key, self.lead))

    def local(self) -> np.ndarray:
        """Whether rows of different ids have a key."""
        ids = self.ids[self.text[self.order]]
        return np.minimum.reduceat(ids, self.head) < np.maximum.reduceat(ids, self.head) if len(ids) else np.zeros(0, bool)

    def distinct(self, shared: np.ndarray) -> None:
        """Keeps the runs with a shared key; collapses equal segments to their smallest id."""
        size = np.diff(np.concatenate((self.head, [len(self.start)])))
        rows = np.repeat(shared, size)
        group, rows = np.repeat(np.arange(len(size)), size)[rows].astype(U64), self.order[rows]
        start, size = self.start[rows], self.length[rows] + self.width - 1
        most = 2 * self.width - GRAM  # where all windows share their gram
        content, rest = short_hashes(self.data, start, np.minimum(size, most), most), np.flatnonzero(size > most)
        if len(rest):
            content[rest] = hash_ranges(self.data, start[rest], start[rest] + size[rest])
        # equal ones that this order leaves apart are found by who answers
        bits, room = len(shared).bit_length(), len(rows).bit_length()
        some = max(0, 64 - bits - room)
        order, _ = in_order((group << U64(some)) | (content >> U64(64 - some)) if some else group, bits + some)
        self._take(rows[order])
        content, group, ids = content[order], group[order], self.ids[self.text]
        new = np.ones(len(order), bool)
        new[1:] = (content[1:] != content[:-1]) | (group[1:] != group[:-1])
        self.of = np.cumsum(new) - 1  # distinct segment of each run
        self.first = np.flatnonzero(new)
        self.content, self.least = content[self.first], np.minimum.reduceat(ids, self.first) if len(ids) else ids

    def strings(self, code: np.ndarray) -> tuple[np.ndarray, ...]:
        """What the third round sends: start, windows, smallest id, key, where the gram begins, and for single windows which distinct window each is."""
        plain = np.flatnonzero(code == 2)
        first = self.first[plain]
        start, size, least, key, lead = self.start[first], self.length[first], self.least[plain], self.key[first], self.lead[first]
        hot = np.flatnonzero(code == 3)
        lengths = self.length[self.first[hot]]
        step = np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        each = np.repeat(self.start[self.first[hot]], lengths) + step
        leads = np.repeat(self.lead[self.first[hot]], lengths)
        leads = np.where(leads == RAW, RAW, leads - step)
        window = hash_ranges(self.data, each, each + self.width)
        owner = np.repeat(self.least[hot], lengths)
        order = np.argsort(window)
        new = np.ones(len(order), bool)
        new[1:] = window[order][1:] != window[order][:-1]
        which = np.empty(len(order), np.int64)
        which[order] = np.cumsum(new) - 1
        head = order[new]
        start, size, lead = np.concatenate((start, each[head])), np.concatenate((size, np.ones(len(head), np.int64))), np.concatenate((lead, leads[head]))
        least = np.concatenate((least, np.minimum.reduceat(owner[order], np.flatnonzero(new)) if len(order) else owner))
        key = np.concatenate((key, mix64(window[head] ^ U64(0x1234567))))
        rank = np.argsort(key, kind="stable")
        return start[rank], size[rank], least[rank], key[rank], lead[rank], rank, plain, hot, lengths, which, owner


def _ask_shared(block: _Block):
    bucket, rest = split_key(block.unique, block.bits)
    for b, i, j in slices(bucket):
        yield b, rest[i:j].tobytes()


def _answer_shared(blobs: list[bytes]) -> list[bytes]:
    parts = [np.frombuffer(b, np.uint32) for b in blobs]
    order, s = in_order(np.concatenate(parts).astype(U64), 32)
    same = s[1:] == s[:-1]
    many = np.zeros(len(s), bool)
    many[1:] |= same
    many[:-1] |= same
    flag = np.empty(len(s), bool)
    flag[order] = many
    return [np.packbits(x).tobytes() for x in np.split(flag, np.cumsum([len(p) for p in parts])[:-1])]


_SEGMENT = np.dtype([("rest", np.uint32), ("content", np.uint64), ("least", np.int64)])


def _answer_segments(blobs: list[bytes]) -> list[bytes]:
    """0: kept as far as other ids go, 1: removed, 2: send the bytes, 3: send the windows."""
    parts = [np.frombuffer(b, _SEGMENT) for b in blobs]
    every = np.concatenate(parts)
    rest, content, least = (np.ascontiguousarray(every[n]) for n in ("rest", "content", "least"))
    order = np.argsort(content)
    order = order[in_order(rest[order].astype(U64), 32)[0]]
    rest, content, least = rest[order], content[order], least[order]
    new_key = np.ones(len(order), bool)
    new_key[1:] = rest[1:] != rest[:-1]
    new = new_key.copy()
    new[1:] |= content[1:] != content[:-1]
    head = np.flatnonzero(new_key)
    size = np.diff(np.concatenate((head, [len(order)])))
    kinds, lowest = np.repeat(np.add.reduceat(new, head, dtype=np.int64), size), np.repeat(np.minimum.reduceat(least, head), size)
    code = np.empty(len(order), np.uint8)
    code[order] = np.where(kinds == 1, (lowest < least).astype(np.uint8), np.where(kinds <= HOT, 2, 3))
    return [x.tobytes() for x in np.split(code, np.cumsum([len(p) for p in parts])[:-1])]


#: Symbols merged at a time; keys are independent of each other, and so much stays in a core's cache.
MERGE_SYMBOLS = 1 << 16
#: Windows answered at a time.
WINDOWS = 1 << 18


def _ask_windows(block: _Block, code: np.ndarray):
    """Windows, smallest ids, keys, places of the grams, and the bytes; those of a gram are left out where all windows share it, as its key stands for it."""
    start, size, least, key, lead, *_ = block.strings(code)
    length = size + np.where(lead == RAW, block.width, block.width - GRAM) - 1
    end = np.concatenate(([0], np.cumsum(length)))
    fields = least, key, lead.astype(np.uint16), (size - 1).astype(np.uint8)
    cuts = list(slices(split_key(key, block.bits)[0]))
    while cuts:
        # some buckets at a time, as each byte needs some numbers
        n = max(1, int(np.searchsorted([end[j] for _, _, j in cuts], end[cuts[0][1]] + MERGE_SYMBOLS)))
        a, b = cuts[0][1], cuts[n - 1][2]
        step = np.arange(end[b] - end[a]) - np.repeat(end[a:b] - end[a], length[a:b])
        data = block.data[np.repeat(start[a:b], length[a:b]) + step + GRAM * (step >= np.repeat(lead[a:b], length[a:b]))]
        for bucket, i, j in cuts[:n]:
            yield bucket, b"".join((np.int64(j - i).tobytes(), *(x[i:j].tobytes() for x in fields), data[end[i] - end[a] : end[j] - end[a]].tobytes()))
        cuts = cuts[n:]


def _answer_windows(width: int):
    def unpack(blob: bytes) -> tuple[np.ndarray, ...]:
        n, at, out = int(np.frombuffer(blob, np.int64, 1)[0]), 8, []
        for kind in (np.int64, U64, np.uint16, np.uint8):
            out.append(np.frombuffer(blob, kind, n, at))
            at += n * out[-1].itemsize
        return *out, np.frombuffer(blob, np.uint8, offset=at)

    def answer(blobs: list[bytes]) -> list[bytes]:
        parts = [unpack(b) for b in blobs]
        counts = [len(p[0]) for p in parts]
        least, key, lead, size, text = (np.concatenate(x) for x in zip(*parts, strict=True))
        size, lead = size + np.int64(1), lead.astype(np.int64)
        length = size + np.where(lead == RAW, width, width - GRAM) - 1
        offsets = np.concatenate(([0], np.cumsum(length)))
        content = hash_ranges(text, offsets[:-1], offsets[1:]) ^ mix64(lead.astype(U64))
        order = np.lexsort((content, key))
        new_key = np.concatenate(([True], key[order][1:] != key[order][:-1]))
        new = new_key.copy()
        new[1:] |= content[order][1:] != content[order][:-1]
        of = np.empty(len(order), np.int64)
        of[order] = np.cumsum(new) - 1
        first, lowest = order[new], np.minimum.reduceat(least[order], np.flatnonzero(new))
        begin = np.concatenate(([0], np.cumsum(size[first])))
        # what a key has only one string of is that string's; the others are merged, many keys at a time
        flat = np.repeat(lowest, size[first])
        group = np.cumsum(new_key[new]) - 1
        several = np.bincount(group)[group] > 1
        for raw in (False, True):
            some = np.flatnonzero(several & ((lead[first] == RAW) == raw))
            if not len(some):
                continue
            before = np.cumsum((size + width)[first[some]]) - (size + width)[first[some]]
            head = np.flatnonzero(np.concatenate(([True], group[some][1:] != group[some][:-1])))
            part = before[head] // MERGE_SYMBOLS
            cuts = [*head[np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1])))].tolist(), len(some)]
            for i, j in zip(cuts[:-1], cuts[1:], strict=True):
                these = some[i:j]
                rows, n = first[these], length[first[these]]
                symbols, depth = text[np.repeat(offsets[rows] - (np.cumsum(n) - n), n) + np.arange(n.sum())], width
                if not raw:
                    symbols, more = named_grams(symbols, n, lead[rows], key[rows])
                    n, depth = n + more, width - GRAM + more
                owners = np.concatenate(window_owners(symbols, np.concatenate(([0], np.cumsum(n))), size[rows], lowest[these], depth))
                w = size[rows]
                flat[np.repeat(begin[these] - (np.cumsum(w) - w), w) + np.arange(w.sum())] = owners
        # the parts of some blocks at a time, as their windows need some arrays of numbers each
        out, end, begin = [], np.cumsum([0, *counts]), begin[of]
        windows = np.concatenate(([0], np.cumsum(size)))[end]
        i = 0
        while i < len(counts):
            j = max(i + 1, int(np.searchsorted(windows, windows[i] + WINDOWS, "right")) - 1)
            n = size[end[i] : end[j]]
            each = np.repeat(begin[end[i] : end[j]] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            gone = flat[each] < np.repeat(least[end[i] : end[j]], n)
            out += [np.packbits(gone[a:b]).tobytes() for a, b in zip((windows[i:j] - windows[i]).tolist(), (windows[i + 1 : j + 1] - windows[i]).tolist(), strict=True)]
            i = j
        return out

    return answer


def _bits(blobs: list[bytes], counts: list[int]) -> np.ndarray:
    return np.concatenate([np.unpackbits(np.frombuffer(b, np.uint8), count=n) for b, n in zip(blobs, counts, strict=True)]).astype(bool) if blobs else np.zeros(0, bool)


def _shared(block: _Block, blobs: list[bytes]) -> None:
    counts = [j - i for _, i, j in slices(split_key(block.unique, block.bits)[0])]
    block.distinct(_bits(blobs, counts) | block.local())


OUTPUT = [("n_bytes", "bigint"), ("n_removed", "bigint"), ("n_spans", "bigint"), ("kept_sha256", "string"), ("kept", "binary"), ("kept_text", "string"), ("removed_spans", "array<struct<start:bigint,end:bigint>>")]


def suffix_dedup(docs: DataFrame, width: int = 50, text: str = "text", doc_id: str = "doc_id", outputs: tuple[str, ...] = tuple(n for n, _ in OUTPUT)) -> DataFrame:
    """``docs`` without the text, with the chosen ``outputs`` (all of ``OUTPUT`` by default)."""
    if docs.schema[doc_id].dataType.typeName() not in ("byte", "short", "integer", "long"):
        raise TypeError(f"{doc_id} must be an integer")
    docs = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c in (text, doc_id) or c.lower() not in outputs])
    text_at, id_at = docs.columns.index(text), docs.columns.index(doc_id)
    blocks: Blocks = pack(docs, text, lambda batch: with_runs(batch, text_at, width), BUCKET_BYTES)
    bits = blocks.bits

    def open_block(batch: pa.RecordBatch) -> _Block:
        return _Block(batch, text_at, id_at, width, bits)

    # the answers are small; as written tables they are made once, though later rounds read them again
    scratch = Scratch(docs.sparkSession)
    first = scratch.table(blocks.ask(lambda batch, _: _ask_shared(open_block(batch)), _answer_shared, 1))

    def ask_segments(batch: pa.RecordBatch, answers: dict):
        block = open_block(batch)
        _shared(block, answers.get(1, []))
        bucket, rest = split_key(block.key[block.first], bits)  # distinct segments are in order of the key
        out = np.zeros(len(rest), _SEGMENT)
        out["rest"], out["content"], out["least"] = rest, block.content, block.least
        for b, i, j in slices(bucket):
            yield b, out[i:j].tobytes()

    second = scratch.table(blocks.ask(ask_segments, _answer_segments, 2, first))

    def codes(block: _Block, answers: dict) -> np.ndarray:
        _shared(block, answers.get(1, []))
        return np.concatenate([np.frombuffer(b, np.uint8) for b in answers[2]]) if 2 in answers else np.zeros(0, np.uint8)

    def ask_windows(batch: pa.RecordBatch, answers: dict):
        block = open_block(batch)
        yield from _ask_windows(block, codes(block, answers))

    known = first.unionByName(second)
    third = scratch.table(blocks.ask(ask_windows, _answer_windows(width), 3, known))

    keep = [c for c in docs.columns if c != text]
    types = dict(docs.dtypes)
    schema = ", ".join([f"`{c}` {types[c]}" for c in keep] + [f"{n} {t}" for n, t in OUTPUT if n in outputs])

    def finish(block_id: int, body: bytes, answers: dict) -> pa.RecordBatch:
        batch = decode_batch(body)
        block = open_block(batch)
        code = codes(block, answers)
        _, size, least, key, _, rank, plain, hot, lengths, which, owner = block.strings(code)
        counts = [int(size[i:j].sum()) for _, i, j in slices(split_key(key, bits)[0])]
        bit = _bits(answers.get(3, []), counts)
        sent = np.empty(len(rank), np.int64)  # where the bits of a string begin
        sent[rank] = np.cumsum(size) - size
        seg_size = block.length[block.first]
        begin = np.cumsum(seg_size) - seg_size
        removed = np.repeat(code == 1, seg_size)
        if len(plain):
            w = seg_size[plain]
            step = np.arange(w.sum()) - np.repeat(np.cumsum(w) - w, w)
            removed[np.repeat(begin[plain], w) + step] = bit[np.repeat(sent[: len(plain)], w) + step]
        if len(hot):
            step = np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)
            inv = sent[len(plain) :]
            low = np.empty(len(inv), np.int64)
            low_sorted = np.empty(len(rank), np.int64)
            low_sorted[rank] = least
            low[:] = low_sorted[len(plain) :]
            removed[np.repeat(begin[hot], lengths) + step] = bit[inv[which]] | (low[which] < owner)
        # from distinct segments to all runs, then to bytes
        w = block.length
        step = np.arange(w.sum()) - np.repeat(np.cumsum(w) - w, w)
        later = np.repeat(block.ids[block.text] > block.least[block.of], w) if len(w) else np.zeros(0, bool)
        gone = removed[np.repeat(begin[block.of], w) + step] | later if len(w) else later
        at = (np.repeat(block.start, w) + step)[gone]
        mark = np.zeros(len(block.data) + width, bool)
        mark[at + width] = True
        so_far = np.cumsum(mark, dtype=np.int32)  # windows that begin up to here, width bytes further on
        dead = so_far[width:] > so_far[:-width]
        # a text's own runs of removed bytes
        first, last = dead.copy(), dead.copy()
        first[1:] &= ~dead[:-1]
        last[:-1] &= ~dead[1:]
        edge = block.offsets[(block.offsets > 0) & (block.offsets < len(dead))]
        first[edge], last[edge - 1] = dead[edge], dead[edge - 1]
        first, last = np.flatnonzero(first), np.flatnonzero(last) + 1
        span = np.searchsorted(first, block.offsets)
        kept, end = block.data[~dead], block.offsets - np.concatenate(([0], np.cumsum(last - first)))[span]
        n_bytes, ends = np.diff(block.offsets), list(zip(end[:-1].tolist(), end[1:].tolist(), strict=True))
        made = {
            "n_bytes": lambda: pa.array(n_bytes, pa.int64()),
            "n_removed": lambda: pa.array(n_bytes - np.diff(end), pa.int64()),
            "n_spans": lambda: pa.array(np.diff(span), pa.int64()),
            "kept_sha256": lambda: pa.array([hashlib.sha256(kept[a:b]).hexdigest() for a, b in ends], pa.string()),
            "kept": lambda: pa.array([kept[a:b].tobytes() for a, b in ends], pa.binary()),
            # a character that lost a byte goes
            "kept_text": lambda: pa.array([kept[a:b].tobytes().decode("utf-8", "ignore") for a, b in ends], pa.string()),
            "removed_spans": lambda: pa.array(
                [[{"start": x - a, "end": y - a} for x, y in zip(first[i:j].tolist(), last[i:j].tolist(), strict=True)] for a, i, j in zip(block.offsets.tolist(), span.tolist(), span[1:].tolist())],
                pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])),
            ),
        }
        names = [n for n, _ in OUTPUT if n in outputs]
        return pa.RecordBatch.from_arrays([*(batch.column(docs_at[c]) for c in keep), *(made[n]() for n in names)], names=[*keep, *names])

    docs_at = {c: i for i, c in enumerate(docs.columns)}
    return blocks.with_answers(known.unionByName(third), finish, schema)

