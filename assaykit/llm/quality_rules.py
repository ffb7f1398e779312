"""Quality rules: repetition coverage by rolling hashes.

Words are maximal runs of bytes other than ASCII white space (0x20, 0x09-0x0D).
For each text, n-grams of several lengths get rolling hashes in numpy; a group of
equal hashes is confirmed word by word, so a collision can't change a result.
Coverage is the share of word characters inside n-grams that occur before or again in
the same text, and of the bytes of lines (those with a word) in lines equal to an
earlier one.

The operator is a narrow map: no shuffle, one text never leaves its row and goes to
Python once, and memory is bounded by two Arrow batches (PySpark holds one while it
reads the next; Spark's defaults end one at 10 000 rows or 64 MB) plus scratch of a few
times ``GROUP_BYTES`` or, if larger, of one text.

Cases: a null or empty text has no words, counts of 0, and fails; ties and
repeated rows are judged row by row; extra columns are kept, and those that clash
with an output name are replaced; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kernels import Words, buffers, gram_hashes, groups, release

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
OUTPUT = [
    ("n_words", pa.int64()), ("word_chars", pa.int64()), ("n_symbols", pa.int64()), ("n_dup_lines", pa.int64()), ("n_repeat_words", pa.int64()),
    ("base_failed", pa.bool_()), ("top_gram_share", pa.float64()), ("dup_gram_share", pa.float64()), ("dup_line_share", pa.float64()), ("symbol_share", pa.float64()), ("kept", pa.bool_()),
]
_DDL = {pa.int64(): "bigint", pa.bool_(): "boolean", pa.float64(): "double"}


@dataclass(frozen=True)
class QualityParams:
    """Limits on coverage (shares of word characters); a text above any of them is rejected.

    ``dup`` maps an n-gram length to the largest share inside n-grams that occur
    twice or more; ``top`` limits the share that the single most frequent n-gram covers.
    """

    min_words: int = 10
    max_repeat_words: float = 0.20
    dup: dict[int, float] = field(default_factory=lambda: {5: 0.30, 7: 0.25, 10: 0.20})
    top: dict[int, float] = field(default_factory=lambda: {2: 0.25, 3: 0.20})
    max_dup_line_chars: float = 0.30
    max_symbols: float = 0.10


def _same(ids: np.ndarray, a: np.ndarray, b: np.ndarray, n: int) -> bool:
    return all(np.array_equal(ids[a + k], ids[b + k]) for k in range(n))


def repeated(ids: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts of n-grams that occur twice or more, and a class number for each such start.

    ``ids`` are word numbers, equal exactly for equal words.
    """
    h = gram_hashes(ids.astype(np.uint64), n)
    if len(h) < 2:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    order = np.argsort(h, kind="stable")
    s = h[order]
    same = s[1:] == s[:-1]
    if not same.any():
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    new = np.concatenate(([True], ~same))
    cls = np.cumsum(new) - 1
    head = order[np.flatnonzero(new)][cls]
    if not _same(ids, order, head, n):  # a collision of hashes: compare the words themselves
        rows = np.stack([ids[k : k + len(h)] for k in range(n)], 1)
        _, cls = np.unique(rows, axis=0, return_inverse=True)
        order, cls = np.arange(len(h)), cls.reshape(-1)
    many = np.bincount(cls)[cls] > 1
    return order[many], cls[many]


def covered(starts: np.ndarray, n: int, size: int) -> np.ndarray:
    """Words inside at least one of the n-word windows at ``starts``."""
    mark = np.zeros(size + 1, np.int32)
    np.add.at(mark, starts, 1)
    np.add.at(mark, starts + n, -1)
    return np.cumsum(mark[:size]) > 0


def _dup_lines(text: bytes) -> tuple[int, int, int]:
    """Lines equal to an earlier one (those without a word don't count), their bytes, all lines' bytes."""
    seen: set[bytes] = set()
    dup = dup_bytes = total = 0
    for line in text.split(b"\n"):
        if line.strip():
            total += len(line)
            if line in seen:
                dup += 1
                dup_bytes += len(line)
            else:
                seen.add(line)
    return dup, dup_bytes, total


def measure(data: np.ndarray, offsets: np.ndarray, p: QualityParams) -> dict[str, list]:
    """All output columns for the texts of one buffer."""
    out: dict[str, list] = {name: [] for name, _ in OUTPUT}
    whole = data.tobytes()
    # places, not running sums, which would be eight bytes for each byte
    inner = np.flatnonzero((data & 0xC0) == 0x80)
    symbols = np.searchsorted(np.flatnonzero(_SYMBOL[data]), offsets)
    words = Words(data, offsets, hashes=False)
    chars = words.end - words.start
    chars -= np.searchsorted(inner, words.end) - np.searchsorted(inner, words.start)
    points = np.concatenate(([0], np.cumsum(chars)))[words.bounds]
    for i in range(len(offsets) - 1):
        a, b = offsets[i], offsets[i + 1]
        text = whole[a:b]
        seen: dict[bytes, int] = {}
        ids = np.array([seen.setdefault(w, len(seen)) for w in text.split()], np.int64)
        n, size = len(ids), chars[words.bounds[i] : words.bounds[i + 1]]
        word_chars, n_symbols = int(points[i + 1] - points[i]), int(symbols[i + 1] - symbols[i])
        dup_lines, dup_bytes, line_bytes = _dup_lines(text)
        top_share = dup_share = 0.0
        rejected, repeat_words = False, 0
        for g in sorted({5, *p.dup, *p.top}):
            starts, cls = repeated(ids, g)
            if not len(starts):
                continue
            inside = covered(starts, g, n)
            if g == 5:
                repeat_words = int(inside.sum())
            share = float(size[inside].sum()) / word_chars
            if g in p.dup:
                dup_share = max(dup_share, share)
                rejected |= share > p.dup[g]
            if g in p.top:
                often = np.bincount(cls)[cls]
                best = starts[often == often.max()].min()  # of equally frequent ones the first in the text
                most = cls[np.flatnonzero(starts == best)[0]]
                share = float(size[covered(starts[cls == most], g, n)].sum()) / word_chars
                top_share = max(top_share, share)
                rejected |= share > p.top[g]
        base = n < p.min_words or 100 * repeat_words > round(100 * p.max_repeat_words) * n
        line_share = dup_bytes / line_bytes if line_bytes else 0.0
        symbol_share = n_symbols / word_chars if word_chars else 0.0
        rejected |= line_share > p.max_dup_line_chars or symbol_share > p.max_symbols
        row = (n, word_chars, n_symbols, dup_lines, repeat_words, base, top_share, dup_share, line_share, symbol_share, not base and not rejected)
        for (name, _), v in zip(OUTPUT, row, strict=True):
            out[name].append(v)
    return out


def quality_rules(docs: DataFrame, params: QualityParams = QualityParams(), text: str = "text", keep_text: bool = True) -> DataFrame:
    """``docs`` with the measures of ``OUTPUT`` for each row's ``text``; the texts themselves come back only where ``keep_text`` asks for them."""
    names = [n for n, _ in OUTPUT]
    own = text if text in docs.columns else next((c for c in docs.columns if c.lower() == text.lower()), text)
    keep = [c for c in docs.columns if c.lower() not in names and (keep_text or c != own)]
    # a text that is kept is measured where it stands: it goes to Python once
    at = keep.index(own) if own in keep and dict(docs.dtypes)[own] in ("string", "binary") else len(keep)
    kept = docs.select(*[F.col(f"`{c}`") for c in keep])
    source = kept if at < len(keep) else docs.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{own}`").cast("binary").alias("__bytes"))
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema] + [f"{n} {_DDL[t]}" for n, t in OUTPUT])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = buffers(batch.column(at))
            for i, j in groups(offsets):
                got = measure(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], params)
                part = batch.slice(i, j - i)
                yield pa.RecordBatch.from_arrays([*part.columns[: len(keep)], *(pa.array(got[n], t) for n, t in OUTPUT)], names=[*keep, *names])
                del got
                release()

    return source.mapInArrow(run, schema)
