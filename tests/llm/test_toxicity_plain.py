"""A small toxicity model and its scores, recomputed in plain Python from the texts."""

import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from assaykit.llm import toxicity as TX

PRIOR, SHRINK, DRIFT, MIN_Z, STEMS = 1.0, 2.0, -0.1, 3.0, 3


def tokens(text):
    return re.findall(rb"[0-9a-z\x80-\xff]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))


def keys(word):
    return [(0, word), *((i, word[:n]) for i, n in enumerate((8, 6, 5)[:STEMS], 1))]


def log_odds(rows):
    """{key: score} of the keys in use, and lambda."""
    m = [sum(y == k for _, y in rows) for k in (0, 1)]
    d, clean = ({}, {}), [w for t, y in rows if not y for w in tokens(t)]
    for t, y in rows:
        for key in {k for w in tokens(t) for k in keys(w)}:
            d[y][key] = d[y].get(key, 0) + 1
    r, out = m[1] / sum(m), {}
    for key in d[0].keys() | d[1].keys():
        d0, d1 = d[0].get(key, 0), d[1].get(key, 0)
        t, every = d0 + d1, sum(m)
        part = lambda seen, expected: seen * math.log(seen / expected) if seen else 0.0
        z = math.sqrt(max(0, 2 * (part(d1, t * r) + part(d0, t * (1 - r)) + part(m[1] - d1, (every - t) * r) + part(m[0] - d0, (every - t) * (1 - r)))))
        if z >= MIN_Z:
            p1, p0 = d1 + PRIOR * r, d0 + PRIOR * (1 - r)
            delta = math.log(p1 / (m[1] - d1 + PRIOR * r)) - math.log(p0 / (m[0] - d0 + PRIOR * (1 - r)))
            out[key] = math.copysign(max(0.0, abs(delta) - SHRINK * math.sqrt(1 / p1 + 1 / p0)), delta) + DRIFT
    of_clean = [score(w, out) for w in clean]
    excess = lambda lam: sum(math.exp(lam * s) for s in of_clean) / max(1, len(of_clean)) - 1
    low, high = 1e-3, 1.0
    while excess(high) < 0 and high < 16:
        high *= 2
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if excess(mid) < 0 else (low, mid)
    return out, low


def score(word, odds):
    return next((odds[k] for k in keys(word) if k in odds), DRIFT)


def segments(s):
    """Sums of maximal segments: the best one, then those before and after it."""
    best = max(((sum(s[i:j]), -i, j) for i in range(len(s)) for j in range(i + 1, len(s) + 1)), default=(0, 0, 0))
    if best[0] <= 1e-12:
        return []
    i, j = -best[1], best[2]
    return [*segments(s[:i]), best[0], *segments(s[j:])]


def statistic(best, n, lam, k):
    out, total = [], 0.0
    for b in sorted(best, reverse=True):
        total += lam * b - math.log(k * max(n, 1) + 1)
        out.append(total)
    return max(out) if out else -math.log(k * max(n, 1) + 1)


def logistic(x, y):
    mean, scale = sum(x) / len(x), np.std(x) or 1.0
    z, w = (np.array(x) - mean) / scale, np.zeros(2)
    design = np.stack([np.ones(len(z)), z], 1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-design @ w))
        w += np.linalg.solve(design.T @ (design * (p * (1 - p))[:, None]) + 0.1 * np.eye(2), design.T @ (y - p) - 0.1 * w)
    slope = max(w[1] / scale, 1e-6)
    return slope, mean - w[0] / slope


@pytest.fixture(scope="module")
def labelled(spark):
    rng = random.Random(21)
    plain = [f"word{i}" for i in range(25)] + ["the", "É", "a"]
    bad = ["vilestuff", "vilestuffer", "nastyness", "nastyest"]
    rows = []
    for i in range(120):
        y = int(i % 4 == 0)
        text = [rng.choice(plain) for _ in range(rng.randint(2, 25))]
        for _ in range(rng.randint(1, 4) if y else int(rng.random() < 0.05)):
            text.insert(rng.randrange(len(text) + 1), rng.choice(bad).upper() if rng.random() < 0.2 else rng.choice(bad))
        rows.append((i, " ".join(text), y))
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(500, None), (501, ""), (502, "vilestuffing and more"), (503, "word1 nastyest nastyest the")], "doc_id bigint, text string")
    return docs, spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id bigint, toxic int"), rows


def test_scores_are_those_of_a_plain_recomputation(labelled):
    docs, labels, rows = labelled
    fold = {r.doc_id: r.f for r in labels.select("doc_id", F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(TX.FOLDS)).alias("f")).collect()}
    found = []
    for f in range(TX.FOLDS):
        odds, lam = log_odds([(t, y) for i, t, y in rows if fold[i] != f])
        for i, t, y in rows:
            if fold[i] == f:
                w = tokens(t)
                found.append((segments([score(x, odds) for x in w]), len(w), lam, y))
    clean = [n * math.exp(-lam * max(best, default=0.0)) for best, n, lam, y in found if not y and n]
    k = 1 / max(sum(clean) / len(clean), 1e-9)
    slope, cut = logistic([statistic(best, n, lam, k) for best, n, lam, _ in found], np.array([y for *_, y in found]))
    odds, lam = log_odds([(t, y) for _, t, y in rows])
    model = TX.fit(docs, labels, PRIOR, ((MIN_Z, STEMS),), SHRINK, DRIFT)
    assert (model.lam, model.k, model.slope, model.cut) == pytest.approx((lam, k, slope, cut), rel=1e-6)
    assert len(model.keys) == len(odds) > 3
    got = {r.doc_id: (r.score, r.predicted) for r in TX.toxicity(docs, model, spans=False).collect()}
    for r in docs.collect():
        w = tokens(r.text)
        s = 1 / (1 + math.exp(-slope * (statistic(segments([score(x, odds) for x in w]), len(w), lam, k) - cut)))
        assert got[r.doc_id][0] == pytest.approx(s, abs=1e-6) and got[r.doc_id][1] == int(got[r.doc_id][0] >= 0.3)
    assert got[500] == got[501] and got[502][0] > 0.5 > got[500][0]


def test_segments_stay_out_of_the_driver(labelled, monkeypatch):
    """What fitting collects is a few numbers a text and the lexicon, no list of segments."""
    kinds, frame = [], type(labelled[0])
    real = frame.toPandas
    monkeypatch.setattr(frame, "toPandas", lambda self: (kinds.append([f.dataType.typeName() for f in self.schema]), real(self))[1])
    TX.fit(labelled[0], labelled[1])
    assert len(kinds) == 3 and not any("array" in k for k in kinds)
