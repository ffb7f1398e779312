"""Toxicity: maximum-scoring segments over token log-odds.

Tokens are runs of letters, digits and non-ASCII characters, A-Z lower-cased. Inflected
forms share a stem, so a token without evidence of its own backs off to its first bytes,
the longest of ``STEMS`` first. Evidence is counted in texts, as a word's occurrences in
one text are not independent: z is the signed root of the likelihood ratio that a word's
share of toxic texts is the overall one, which has no bound for words of toxic texts
alone. Words and stems whose z passes ``min_z`` score their log-odds between toxic and
clean texts, smoothed by ``prior`` texts at the overall rate and shrunk by ``shrink``
standard errors; all others get a small negative ``drift``. Cross-validation inside the
labels given chooses ``min_z`` and the shortest stem, by the loss of the fitted scores.
A linear scan (Ruzzo and Tompa) finds every maximal segment of a text. Their
extreme-value parameters come from clean texts: lambda solves E[exp(lambda s)] = 1 and K
is the moment estimate from the largest segments. A text's statistic is the best sum of
normalised scores of its r best segments less r log(K n) (Karlin and Altschul), which a
logistic curve, fitted on statistics of labelled texts from log-odds of the other folds,
turns into a score; the final log-odds use all labels given. Labels, languages, sources and ids are no inputs of a score.

Fitting uses at most ``MAX_FIT_ROWS`` labelled rows (the smallest hashes of doc_id),
whole texts; counts are summed in Spark. The lexicon is bounded by that sample.
Scoring is a narrow map over all whole texts.

Cases: null and empty texts have no segment and get the score of such texts; repeated
rows are scored alike; extra columns are kept and those that clash with an output name
replaced; without labels of both kinds every score is the rate of label 1 (0 without
labels); an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kernels import LOWER, Words, buffers, groups, hash_ranges
from .scratch import Scratch

TOKEN = np.zeros(256, bool)
TOKEN[48:58] = TOKEN[65:91] = TOKEN[97:123] = TOKEN[128:] = True
MAX_FIT_ROWS = 20_000
#: Bytes of the stems, in the order in which tokens back off to them.
STEMS = (8, 6, 5, 4)
FOLDS = 5
#: What cross-validation chooses from: (least z, number of STEMS).
CHOICES = tuple((z, k) for k in (3, 4) for z in (3.0, 4.0, 5.0))
_STEM_SALT = 0x6A09E667F3BCC909


def features(data: np.ndarray, offsets: np.ndarray, stems: int = len(STEMS)) -> tuple[Words, list[np.ndarray]]:
    """Words of the texts, and the hashes of the words and of each of their stems."""
    lower = LOWER[data]
    words = Words(lower, offsets, TOKEN)
    salts = [np.uint64(_STEM_SALT * (2 * i + 1) % (1 << 64)) for i in range(stems)]
    return words, [words.hash, *(hash_ranges(lower, words.start, np.minimum(words.end, words.start + n)) ^ salt for n, salt in zip(STEMS, salts))]


@dataclass
class ToxicModel:
    keys: np.ndarray  # sorted token hashes
    scores: np.ndarray
    drift: float
    lam: float
    k: float
    slope: float
    cut: float
    rate: float
    stems: int = len(STEMS)

    def token_scores(self, levels: list[np.ndarray]) -> np.ndarray:
        """Scores of tokens from the hashes of the words and their stems; the first that is known counts."""
        out = np.full(len(levels[0]), self.drift)
        if len(self.keys):
            for hashes in reversed(levels[: self.stems + 1]):
                at = np.minimum(np.searchsorted(self.keys, hashes), len(self.keys) - 1)
                out = np.where(self.keys[at] == hashes, self.scores[at], out)
        return out

    def statistic(self, best: list[float], n: int) -> float:
        if not best:
            return -np.log(self.k * max(n, 1) + 1)
        norm = self.lam * np.sort(np.array(best))[::-1] - np.log(self.k * max(n, 1) + 1)
        return float(np.cumsum(norm).max())

    def score(self, statistic: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * (statistic - self.cut), -40, 40)))


def maximal_segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (start, end, score), by one scan.

    Each candidate remembers the nearest earlier one that begins lower, so that a search
    skips what an earlier search has passed, and the scan is linear.
    """
    positive = np.flatnonzero(scores > 0)
    if not len(positive):
        return []
    total = np.concatenate(([0.0], np.cumsum(scores)))
    left, right, start, end, lower = [], [], [], [], []
    for i, l, r in zip(positive.tolist(), total[positive].tolist(), total[positive + 1].tolist(), strict=True):
        s, e, j = i, i + 1, len(left) - 1
        while True:
            while j >= 0 and left[j] >= l:
                j = lower[j]
            if j < 0 or right[j] >= r:
                break
            l, s, next_j = left[j], start[j], lower[j]
            del left[j:], right[j:], start[j:], end[j:], lower[j:]
            j = next_j
        left.append(l)
        right.append(r)
        start.append(s)
        end.append(e)
        lower.append(j)
    return [(s, e, r - l) for s, e, l, r in zip(start, end, left, right, strict=True)]


def _scan(column: pa.Array, model: ToxicModel) -> tuple[np.ndarray, np.ndarray, list[list[tuple[int, int, float]]]]:
    """Per text its number of tokens, statistic, and segments."""
    data, offsets = buffers(column)
    ns, stats, found = [], [], []
    for i, j in groups(offsets):
        words, levels = features(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], model.stems)
        scores = model.token_scores(levels)
        for a, b in zip(words.bounds[:-1].tolist(), words.bounds[1:].tolist(), strict=True):
            segments = maximal_segments(scores[a:b])
            ns.append(b - a)
            stats.append(model.statistic([s for *_, s in segments], b - a))
            found.append(segments)
    return np.array(ns, np.int64), np.array(stats), found


def evidence(d1: np.ndarray, d0: np.ndarray, m1: float, m0: float, prior: float, shrink: float) -> tuple[np.ndarray, np.ndarray]:
    """z and shrunk log-odds of words that d1 of m1 toxic and d0 of m0 clean texts have."""
    t, m, r = d1 + d0, m1 + m0, m1 / (m1 + m0)

    def part(seen: np.ndarray, expected: np.ndarray) -> np.ndarray:
        return np.where(seen > 0, seen * np.log(np.maximum(seen, 1) / np.maximum(expected, 1e-300)), 0.0)

    z = np.sqrt(np.maximum(2 * (part(d1, t * r) + part(d0, t * (1 - r)) + part(m1 - d1, (m - t) * r) + part(m0 - d0, (m - t) * (1 - r))), 0))
    p1, p0 = d1 + prior * r, d0 + prior * (1 - r)
    delta = np.log(p1 / (m1 - d1 + prior * r)) - np.log(p0 / (m0 - d0 + prior * (1 - r)))
    return z, np.sign(delta) * np.maximum(np.abs(delta) - shrink * np.sqrt(1 / p1 + 1 / p0), 0)


@dataclass
class Counts:
    """Per key (sorted) its level, its shorter stems, and texts and clean tokens by fold."""

    keys: np.ndarray
    level: np.ndarray
    above: np.ndarray  # keys of the shorter stems, by level
    d1: np.ndarray
    d0: np.ndarray
    y0: np.ndarray
    m1: np.ndarray  # texts by fold
    m0: np.ndarray
    n0: np.ndarray  # clean tokens by fold

    def model(self, fold: int | None, min_z: float, stems: int, prior: float, shrink: float, drift: float) -> ToxicModel:
        """Log-odds and lambda of all folds but ``fold``."""
        d1, d0, y0, m1, m0, n0 = ((x.sum(-1) - (x[..., fold] if fold is not None else 0)).astype(float) for x in (self.d1, self.d0, self.y0, self.m1, self.m0, self.n0))
        if not len(self.keys) or not m1 or not m0:
            return ToxicModel(np.zeros(0, np.uint64), np.zeros(0), drift, 1.0, 1.0, 0.0, 0.0, 0.0, stems)
        z, value = evidence(d1, d0, m1, m0, prior, shrink)
        use = (z >= min_z) & (self.level <= stems) & (d1 + d0 > 0)
        # clean tokens that stop at each key: its own less those that stop at longer ones
        share = y0.copy()
        for level in range(stems):
            at = np.flatnonzero(use & (self.level == level))
            for up in range(level, stems):
                to = np.minimum(np.searchsorted(self.keys, self.above[at, up]), len(self.keys) - 1)
                here = self.keys[to] == self.above[at, up]
                share -= np.bincount(to[here], weights=share[at[here]], minlength=len(share))
        share, scores = share[use] / max(n0, 1), value[use] + drift

        def excess(lam: float) -> float:
            return float((share * np.exp(lam * scores)).sum() + max(0.0, 1 - share.sum()) * np.exp(lam * drift) - 1)

        low, high = 1e-3, 1.0
        while excess(high) < 0 and high < 16:
            high *= 2
        for _ in range(60):
            mid = (low + high) / 2
            low, high = (mid, high) if excess(mid) < 0 else (low, mid)
        return ToxicModel(self.keys[use], scores, drift, low, 1.0, 0.0, 0.0, 0.0, stems)


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float, float]:
    """Slope, cut and mean loss of a logistic curve."""
    mean, scale = x.mean(), x.std() or 1.0
    z, w = (x - mean) / scale, np.zeros(2)
    for _ in range(50):  # Newton's method with a small ridge
        p = 1 / (1 + np.exp(-np.clip(w[0] + w[1] * z, -30, 30)))
        g = np.array([(y - p).sum(), ((y - p) * z).sum()]) - 0.1 * w
        v = p * (1 - p)
        h = np.array([[v.sum(), (v * z).sum()], [(v * z).sum(), (v * z * z).sum()]]) + 0.1 * np.eye(2)
        w += np.linalg.solve(h, g)
    slope = max(w[1] / scale, 1e-6)
    cut = float(mean - w[0] / slope)
    p = 1 / (1 + np.exp(-np.clip(slope * (x - cut), -40, 40)))
    return float(slope), cut, float(-np.log(np.maximum(np.where(y == 1, p, 1 - p), 1e-12)).mean())


def fit(docs: DataFrame, labels: DataFrame, prior: float = 1.0, choices: tuple[tuple[float, int], ...] = CHOICES, shrink: float = 2.0, drift: float = -0.1, max_rows: int = MAX_FIT_ROWS) -> ToxicModel:
    """Fits on labelled rows (doc_id, toxic); callers leave out what is held out."""
    scratch = Scratch(docs.sparkSession)
    chosen = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    chosen = scratch.table(chosen)  # at most max_rows pairs of numbers
    fold = F.pmod(F.xxhash64(F.col("doc_id"), F.lit(7)), F.lit(FOLDS)).cast("int")
    sample = scratch.table(docs.join(F.broadcast(chosen), "doc_id").where("text IS NOT NULL").select("text", F.col("toxic").cast("int").alias("toxic"), fold.alias("fold")))

    ups = [f"up_{i}" for i in range(len(STEMS))]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, levels = features(*buffers(batch.column(0)))
            owner = words.owners()
            toxic, part = np.array(batch.column(1).to_pylist(), np.int64), np.array(batch.column(2).to_pylist(), np.int64)
            for level, hashes in enumerate(levels):
                keys, first, of = np.unique(hashes, return_index=True, return_inverse=True)
                in_fold = of * FOLDS + part[owner]
                pairs = np.unique(of * len(toxic) + owner)  # a word counts once a text
                key, text = pairs // max(len(toxic), 1), pairs % max(len(toxic), 1)
                at, size = key * FOLDS + part[text], len(keys) * FOLDS
                d1, d0 = (np.bincount(at[toxic[text] == kind], minlength=size) for kind in (1, 0))
                y0 = np.bincount(in_fold[toxic[owner] == 0], minlength=size)
                some = np.flatnonzero(d1 + d0)
                above = [levels[i][first].view(np.int64)[some // FOLDS] if i > level else np.zeros(len(some), np.int64) for i in range(1, len(levels))]
                cols = [keys.view(np.int64)[some // FOLDS], np.full(len(some), level, np.int32), *above, (some % FOLDS).astype(np.int32), *(x[some].astype(np.int32) for x in (d1, d0, y0))]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["k", "level", *ups, "fold", "d1", "d0", "y0"])

    by_fold = [f"CAST(sum(IF(fold = {f}, {c}, 0)) AS INT) AS {c}_{f}" for c in ("d1", "d0", "y0") for f in range(FOLDS)]
    counts = sample.select("text", "toxic", "fold").mapInArrow(count, f"k bigint, level int, {', '.join(f'{u} bigint' for u in ups)}, fold int, d1 int, d0 int, y0 int")
    counts = scratch.table(counts.groupBy("k", "level").agg(*(F.first(u).alias(u) for u in ups), *map(F.expr, by_fold)))
    tokens = counts.where("level = 0").agg(*(F.sum(f"y0_{f}") for f in range(FOLDS))).first()
    texts = {(r.fold, r.toxic): r["count"] for r in sample.groupBy("fold", "toxic").count().collect()}
    n_rows, rate = sample.agg(F.count("*"), F.avg("toxic")).first()
    m1, m0 = (np.array([texts.get((f, kind), 0) for f in range(FOLDS)]) for kind in (1, 0))
    if not n_rows or not m1.sum() or not m0.sum():
        return ToxicModel(np.zeros(0, np.uint64), np.zeros(0), drift, 1.0, 1.0, 0.0, 0.0, rate or 0.0)
    places, least = [[counts.columns.index(f"{c}_{f}") for f in range(FOLDS)] for c in ("d1", "d0")], min(z for z, _ in choices)

    def passing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Keys that some model can use."""
        for batch in batches:
            d1, d0 = (np.stack([batch.column(i).to_numpy() for i in at], 1).astype(float) for at in places)
            use = np.zeros(len(d1), bool)
            for f in (None, *range(FOLDS)):
                a, b, c, d = (x.sum(-1) - (x[..., f] if f is not None else 0) for x in (d1, d0, m1, m0))
                if c and d:
                    use |= evidence(a, b, float(c), float(d), prior, shrink)[0] >= least
            yield batch.filter(pa.array(use))

    # words and stems of the bounded sample
    frequent = counts.mapInArrow(passing, counts.schema).toPandas()
    frequent = frequent.iloc[np.argsort(frequent.k.to_numpy(np.int64).view(np.uint64))]
    keys, above = (np.ascontiguousarray(frequent[c].to_numpy(np.int64)).view(np.uint64) for c in ("k", ups))
    d1, d0, y0 = (frequent[[f"{c}_{f}" for f in range(FOLDS)]].to_numpy(np.int64) for c in ("d1", "d0", "y0"))
    every = Counts(keys, frequent.level.to_numpy(), above, d1, d0, y0, m1, m0, np.array([x or 0 for x in tokens]))
    models = [[every.model(f, z, k, prior, shrink, drift) for f in range(FOLDS)] for z, k in choices]

    def largest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Segments of each text under each choice, from the log-odds of the other folds."""
        for batch in batches:
            data, offsets = buffers(batch.column(0))
            part, ns, best = np.array(batch.column(2).to_pylist(), np.int64), [], [[] for _ in models]
            for i, j in groups(offsets):
                words, levels = features(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                of = part[i:j][words.owners()]
                ns += words.counts.tolist()
                for choice, by_fold in enumerate(models):
                    scores = np.full(len(of), drift)
                    for f, model in enumerate(by_fold):
                        scores[of == f] = model.token_scores([h[of == f] for h in levels])
                    best[choice] += [[s for *_, s in maximal_segments(scores[a:b])] for a, b in zip(words.bounds[:-1].tolist(), words.bounds[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(ns, pa.int64()), *(pa.array(b, pa.list_(pa.float64())) for b in best), *batch.columns[1:]], names=["n", *(f"best_{c}" for c in range(len(models))), "toxic", "fold"])

    # segments stay in a table; the driver gets a largest one and a statistic of each of at most max_rows texts and choice
    schema = ", ".join(["n bigint", *(f"best_{c} array<double>" for c in range(len(models))), "toxic int", "fold int"])
    segments = scratch.table(sample.select("text", "toxic", "fold").mapInArrow(largest, schema))
    seen = segments.where("toxic = 0 AND n > 0").select("n", "fold", *(F.coalesce(F.array_max(f"best_{c}"), F.lit(0.0)).alias(f"top_{c}") for c in range(len(models)))).toPandas()
    n, part = seen.n.to_numpy(), seen.fold.to_numpy()
    for choice, by_fold in enumerate(models):
        lam = np.array([m.lam for m in by_fold])[part]
        same = float(1 / max(np.mean(n * np.exp(-lam * seen[f"top_{choice}"].to_numpy())), 1e-9)) if len(seen) else 1.0
        for m in by_fold:
            m.k = same

    def statistics(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ns, part = batch.column("n").to_pylist(), batch.column("fold").to_pylist()
            stats = [[by_fold[f].statistic(b, m) for f, b, m in zip(part, batch.column(f"best_{c}").to_pylist(), ns, strict=True)] for c, by_fold in enumerate(models)]
            yield pa.RecordBatch.from_arrays([batch.column("toxic"), *(pa.array(x, pa.float64()) for x in stats)], names=["toxic", *(f"stat_{c}" for c in range(len(models)))])

    stats = segments.mapInArrow(statistics, ", ".join(["toxic int", *(f"stat_{c} double" for c in range(len(models)))])).toPandas()
    y, found = stats.toxic.to_numpy(float), None
    for choice, (z, k) in enumerate(choices):
        slope, cut, loss = _logistic(stats[f"stat_{choice}"].to_numpy(), y)
        if found is None or loss < found[0]:
            found = (loss, z, k, models[choice][0].k, slope, cut)
    _, z, k, same, slope, cut = found
    model = every.model(None, z, k, prior, shrink, drift)
    model.k, model.slope, model.cut, model.rate = same, slope, cut, float(rate)
    return model


def toxicity(docs: DataFrame, model: ToxicModel, text: str = "text", threshold: float = 0.3, spans: bool = True) -> DataFrame:
    """``docs`` with score, predicted and, if wanted, the significant segments (token bounds and E values)."""
    names = ["score", "predicted"] + ["segments"] * spans
    keep = [c for c in docs.columns if c.lower() not in ("score", "predicted", "segments")]
    types = dict(docs.dtypes)
    schema = ", ".join([f"`{c}` {types[c]}" for c in keep] + ["score double, predicted int"] + ["segments array<struct<start:bigint,end:bigint,evalue:double>>"] * spans)
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("evalue", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, stat, found = _scan(batch.column(batch.num_columns - 1), model)
            score = model.score(stat) if model.slope else np.full(len(stat), model.rate)
            cols = [pa.array(score, pa.float64()), pa.array((score >= threshold).astype(np.int32))]
            if spans:
                e = [[{"start": a, "end": b, "evalue": float(model.k * m * np.exp(-model.lam * s))} for a, b, s in f] for f, m in zip(found, n.tolist(), strict=True)]
                cols.append(pa.array([[x for x in f if x["evalue"] < 0.05] for f in e], kind))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *cols], names=[*keep, *names])

    return docs.select(*[F.col(f"`{c}`") for c in keep], F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("__text")).mapInArrow(run, schema)
