"""Small tables against plain Python: nulls, empty and long texts, ties, repeated rows, clashing columns."""

import hashlib
import itertools
import random
import re
import struct

import numpy as np
import pyarrow as pa
import pytest

from assaykit.llm import decontaminate as D
from assaykit.llm import sentencepiece_unigram as SP
from assaykit.llm import toxicity as TX
from assaykit.llm import warc as W
from assaykit.llm.chat_format import chat_format
from assaykit.llm.kernels import Words, buffers, gram_hashes, gram_starts, sliding_min
from assaykit.llm.lm_scoring import lm_scoring, mark_target
from assaykit.llm.ngram_jaccard import ngram_jaccard
from assaykit.llm.quality_rules import quality_rules
from assaykit.llm.queries import quality_counts
from assaykit.llm.scratch import Scratch
from assaykit.llm.suffix_dedup import suffix_dedup, window_owners
from assaykit.llm.token_counts import TokenRollup, words_tokenizer

RNG = random.Random(11)
VOCAB = ["the", "of", "é", "Word", "alpha", "beta", "gamma", "delta", "x1", "ß"]
DOCS = "doc_id bigint, text string, n_words bigint"


def words(n, rng=RNG):
    return " ".join(rng.choice(VOCAB) + str(rng.randint(0, 30)) for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    base = [words(60), words(40), words(200)]
    near = [base[0].replace("the", "The", 1) + " tail", base[0], base[1] + " " + base[2][:300], base[2] + "\n" + base[2]]
    return [*base, *near, None, "", " \t\n", "one two", "ONE two", "a\x00b" * 60, "é" * 120, words(3000), *[words(30) for _ in range(25)]]


@pytest.fixture(scope="module")
def docs(spark, texts):
    return spark.createDataFrame([*((i, t, 7) for i, t in enumerate(texts)), (3, texts[3], 7)], DOCS).repartition(3)


def split(t):
    return re.findall(rb"[^\x20\x09-\x0d]+", (t or "").encode())


def test_word_kernel(texts):
    data, off = buffers(pa.array([t or "" for t in texts]))
    w = Words(data, off)
    assert w.counts.tolist() == [len(split(t)) for t in texts]
    h, ok = gram_hashes(w.hash, 5), gram_starts(w.bounds, 5)
    grams = [tuple(g[i : i + 5]) for t in texts for g in [split(t)] for i in range(len(g) - 4)]
    assert ok.sum() == len(grams) and len(np.unique(h[ok])) == len(set(grams))
    x = np.array([5, 3, 9, 1, 7], np.uint64)
    assert sliding_min(x, 3).tolist() == [3, 1, 1]


def test_quality_rules(docs, texts):
    rows = quality_rules(docs).collect()
    assert len(rows) == len(texts) + 1
    for r in rows:
        g = split(texts[r.doc_id])
        n = len(g)
        where = {}
        for i in range(n - 4):
            where.setdefault(tuple(g[i : i + 5]), []).append(i)
        hit = {i + k for s in where.values() if len(s) > 1 for i in s for k in range(5)}
        assert (r.n_words, r.n_repeat_words, r.word_chars) == (n, len(hit), sum(len(x.decode()) for x in g))
        assert r.base_failed == (n < 10 or 100 * len(hit) > 20 * n) and not (r.base_failed and r.kept)
        lines = [x for x in (texts[r.doc_id] or "").split("\n") if x.strip(" \t\r\x0b\x0c")]
        assert (r.n_symbols, r.n_dup_lines) == (sum((texts[r.doc_id] or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)))
    assert quality_rules(docs.limit(0)).count() == 0


def sent_and_received(df):
    """Bytes of Arrow that the Python tasks of a collected frame got and gave."""
    plan = df._jdf.queryExecution().executedPlan()
    while plan.nodeName() != "MapInArrow":
        plan = plan.executedPlan() if plan.nodeName() == "AdaptiveSparkPlan" else plan.children().head()
    return [plan.metrics().apply(f"pythonData{x}").value() for x in ("Sent", "Received")]


def test_quality_rules_sends_texts_once(spark, tmp_path):
    """texts went to Python twice and came back, also where nobody reads them."""
    n = 200
    docs = spark.createDataFrame([(i, words(300), 7) for i in range(n)], DOCS)
    size = docs.selectExpr("sum(octet_length(text))").first()[0]
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    df = quality_counts(spark, str(tmp_path))
    assert len(df.collect()) == n
    sent, received = sent_and_received(df)
    assert size < sent < 1.5 * size and received < size / 2
    df = quality_rules(docs)
    assert [(r.doc_id, r.text) for r in df.collect()] == [(r.doc_id, r.text) for r in docs.collect()]
    sent, received = sent_and_received(df)
    assert size < sent < 1.5 * size and size < received < 1.5 * size


def test_quality_rules_columns(spark, docs):
    """The text may stand anywhere, be binary, be written in another case, or clash with an output."""
    measures = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    want = sorted(quality_rules(docs).select("doc_id", *measures).collect())
    for df, text in ((docs.selectExpr("text as Body", "doc_id"), "body"), (docs.selectExpr("doc_id", "cast(text as binary) text"), "text"), (docs.selectExpr("text as kept", "doc_id"), "kept")):
        for keep_text in (True, False):
            got = quality_rules(df, text=text, keep_text=keep_text)
            assert got.columns[: -11] == [c for c in df.columns if c == "doc_id" or keep_text and c != "kept"]
            assert sorted(got.select("doc_id", *measures).collect()) == want


def test_suffix_dedup(docs, texts):
    rows = suffix_dedup(docs, width=50).collect()
    low = {}
    for i, t in enumerate(texts):
        b = (t or "").encode()
        for k in range(len(b) - 49):
            low.setdefault(b[k : k + 50], i)
    assert len(rows) == len(texts) + 1
    for r in rows:
        b = (texts[r.doc_id] or "").encode()
        gone = {k + x for k in range(len(b) - 49) if low[b[k : k + 50]] < r.doc_id for x in range(50)}
        kept = bytes(c for k, c in enumerate(b) if k not in gone)
        assert (r.n_bytes, r.n_removed, r.kept_sha256) == (len(b), len(gone), hashlib.sha256(kept).hexdigest())
        assert r.n_spans == sum(k - 1 not in gone for k in gone) == len(r.removed_spans)
    assert suffix_dedup(docs.limit(0)).count() == 0


def test_merged_bwt_intervals():
    for trial in range(60):
        rng = random.Random(trial)
        width = rng.choice([3, 5, 8])
        strings = [bytes(rng.choice(b"ab\x00") for _ in range(rng.randint(width, 30))) for _ in range(rng.randint(1, 9))]
        owner = np.array([rng.randint(0, 9) for _ in strings], np.int64)
        off = np.concatenate(([0], np.cumsum([len(s) for s in strings])))
        got = window_owners(np.frombuffer(b"".join(strings), np.uint8), off, np.diff(off) - width + 1, owner, width, rng.choice([1, 2, 4]))
        best = {}
        for s, o in zip(strings, owner.tolist(), strict=True):
            for i in range(len(s) - width + 1):
                best[s[i : i + width]] = min(best.get(s[i : i + width], 99), o)
        assert [g.tolist() for g in got] == [[best[s[i : i + width]] for i in range(len(s) - width + 1)] for s in strings]


def test_hot_key_windows(spark, monkeypatch):
    from assaykit.llm import suffix_dedup as module

    monkeypatch.setattr(module, "HOT", 1)
    passage = words(20, random.Random(5))
    rows = [(i, words(6, random.Random(100 + i)) + " " + passage + " " + words(6, random.Random(200 + i))) for i in range(12)]
    got = {r.doc_id: r.n_removed for r in suffix_dedup(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got[0] == 0 and all(got[i] >= len(passage.encode()) for i in range(1, 12))


def test_repeated_grams(spark):
    """Windows that hold their smallest gram repeatedly, beside others, against brute force."""
    rng = random.Random(9)
    tiles = ["a", "ab", "-=", "xyz ", "0123456789", "q" * 31 + "p", "q" * 32 + "p", words(3, rng) + " "]
    texts = ["".join(rng.choice(tiles) * rng.randint(1, 90) + words(rng.randint(0, 12), rng) for _ in range(4)) for _ in range(16)]
    texts += [t[:k] + "#" + t[k + 1 :] for t in texts for k in (len(t) // 3,)] + ["a" * 900, "ab" * 400, "a" * 49, "a" * 50, "é" * 300]
    low = {}
    for i, t in enumerate(texts):
        b = t.encode()
        for k in range(len(b) - 49):
            low.setdefault(b[k : k + 50], i)
    for r in suffix_dedup(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(5)).collect():
        b = texts[r.doc_id].encode()
        gone = sorted({k + x for k in range(len(b) - 49) if low[b[k : k + 50]] < r.doc_id for x in range(50)})
        assert (r.n_removed, r.kept) == (len(gone), bytes(c for k, c in enumerate(b) if k not in set(gone)))
        assert [x for s in r.removed_spans for x in range(s.start, s.end)] == gone and r.n_spans == len(r.removed_spans)


def test_merge_does_without_shared_grams(monkeypatch):
    """What segments of one key have in common is neither sent nor merged, and windows that nothing differs from aren't merged at all."""
    from assaykit.llm import suffix_dedup as module

    rng = random.Random(4)
    passage = " ".join(words(9, rng) for _ in range(40))
    texts = [passage[:k] + "~" + passage[k + 1 :] for k in (rng.randrange(len(passage)) for _ in range(60))]
    merged = []
    owners = module.window_owners
    monkeypatch.setattr(module, "window_owners", lambda text, *rest: merged.append((len(text), rest[3])) or owners(text, *rest))
    for code, most in ((2, 0.7), (3, 0.0)):  # segments, and their windows
        blobs, size = {}, 0
        for i, t in enumerate(texts):
            batch = module.with_runs(pa.RecordBatch.from_pydict({"doc_id": [i], "text": [t]}), 1, 50)
            block = module._Block(batch, 1, 0, 50, 3)
            block.distinct(np.ones(len(block.head), bool))
            size += int((block.length[block.first] + 49).sum())
            for bucket, blob in module._ask_windows(block, np.full(len(block.first), code, np.uint8)):
                blobs.setdefault(bucket, []).append((i, blob))
        merged.clear()
        for sent in blobs.values():
            module._answer_windows(50)([b for _, b in sent])
        assert sum(n for n, _ in merged) <= most * size and all(depth <= 24 for _, depth in merged)


def test_ngram_jaccard(docs, texts):
    sets = []
    for t in texts:
        g = [w.lower() if w.isascii() else re.sub(rb"[A-Z]", lambda m: m[0].lower(), w) for w in split(t)]
        sets.append({tuple(g[i : i + 5]) for i in range(len(g) - 4)} if len(g) >= 5 else {tuple(g)} if g else set())
    comp = brute_components(texts)
    rows = ngram_jaccard(docs).collect()
    assert len(rows) == len(texts) + 1
    for r in rows:
        assert (r.n_shingles, r.component_id) == (len(sets[r.doc_id]), comp[r.doc_id])


def brute_components(texts):
    sets = []
    for t in texts:
        g = [re.sub(rb"[A-Z]", lambda m: m[0].lower(), w) for w in split(t)]
        sets.append({tuple(g[i : i + 5]) for i in range(len(g) - 4)} if len(g) >= 5 else {tuple(g)} if g else set())
    comp = list(range(len(texts)))
    for a, b in itertools.combinations(range(len(texts)), 2):
        if sets[a] and comp[a] != comp[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
            low, high = sorted((comp[a], comp[b]))
            comp = [low if c == high else c for c in comp]
    return comp


@pytest.mark.parametrize("frequent", [2, 3])
def test_frequent_classes_use_pairs(spark, frequent):
    """With nearly all shared n-grams frequent, texts meet in pairs of n-grams alone."""
    from assaykit.llm import ngram_jaccard as module

    rng = random.Random(2)
    texts = []
    for size in (12, 40, 90, 300):
        for _ in range(3):
            base = words(size, rng).split()
            texts += [" ".join(w if rng.random() > 0.03 else f"z{rng.randint(0, 9)}" for w in base[: rng.randint(size - size // 9, size)]) for _ in range(9)]
    texts += [words(k, rng) for k in (1, 2, 3, 4, 5, 6)] * 2
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r.doc_id: r.component_id for r in module.ngram_jaccard(df, frequent=frequent).collect()}
    want = brute_components(texts)
    assert [got[i] for i in range(len(texts))] == want and 1 < len(set(want)) < len(texts)


def test_signatures_of_linking_sets_meet():
    from assaykit.llm import ngram_jaccard as module

    rng = np.random.default_rng(5)
    for _ in range(400):
        n = int(rng.integers(1, 400))
        pool = module.mix64(rng.integers(1, 1 << 60, 2 * n, dtype=np.uint64))
        cls = dict(zip(pool.tolist(), rng.integers(2, 4, 2 * n).tolist()))
        x = pool[:n]
        lost = int(rng.integers(0, n // 5 + 1))
        y = np.concatenate((x[lost:], pool[n : n + int(rng.integers(0, n // 8 + 1))]))
        if 5 * len(np.intersect1d(x, y)) < 4 * len(np.union1d(x, y)):
            continue
        found = []
        for v in (x, y):
            parts = [4**k for k in module.levels(len(v), 80)]
            s = module.signatures(v, np.array([cls[k] for k in v.tolist()], np.uint8), len(v) + -(-80 * len(v) // -100), parts, 3)
            assert len(s) <= 3 * len(v) + 8
            found.append(s)
        assert len(np.intersect1d(*found))
    v = module.mix64(np.arange(100_000, dtype=np.uint64))
    parts = [4**k for k in module.levels(len(v), 80)]
    assert len(module.signatures(v, np.full(len(v), 12, np.uint8), 20_000, parts)) < 200_000


def test_decontaminate_both_ways(spark, docs, texts):
    rx = re.compile(rb"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
    toks = lambda t: rx.findall(re.sub(rb"[A-Z]", lambda m: m[0].lower(), (t or "").encode()))
    items = [(1, texts[0][20:160]), (2, "One two"), (3, None), (4, words(12)), (1, texts[0][20:160])]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    for limit in (1 << 20, 0):
        for r in D.decontaminate(docs, bench, broadcast_bytes=limit).collect():
            g, hit, found = toks(texts[r.doc_id]), set(), set()
            for item, t in items:
                w = toks(t)
                for s in range(max(len(w) - 9, 1) if w else 0):
                    q = w[s : s + 10]
                    for i in range(len(g) - len(q) + 1):
                        if g[i : i + len(q)] == q:
                            hit |= set(range(i, i + len(q)))
                            found.add(str(item))
            assert (r.n_words, r.n_hit, r.item_ids, r.contaminated) == (len(g), len(hit), sorted(found), bool(hit))
    assert D.decontaminate(docs, bench.limit(0)).where("contaminated").count() == 0


def test_chat_format(spark):
    turns = [(1, 0, "user", "a"), (1, 1, "bot", "b"), (2, 0, "user", "a"), (3, 0, "user", "a"), (3, 1, "bot", "b"), (3, 2, "user", None), (4, 0, "user", "z"), (5, 0, "user", "z"), (None, 0, "user", "q")]
    got = {r.conv_id: (r.n_turns, r.n_copies, r.rendered) for r in chat_format(spark.createDataFrame(turns, "conv_id bigint, turn bigint, role string, text string")).collect()}
    assert set(got) == {3, 4} and got[4] == (1, 2, "<|im_start|>user\nz<|im_end|>\n") and got[3][2].endswith("user\n<|im_end|>\n")


def test_token_rollup(spark, docs):
    path = Scratch(spark).dir
    rollup = TokenRollup(spark, path, {"w": words_tokenizer()})
    rows = spark.createDataFrame([("s", "en", "a b c", 1), ("s", "en", None, 1), (None, "de", "x", 1)], "source string, lang string, text string, sign int")
    assert rollup.commit("1/a b", rows) and not rollup.commit("1/a b", rows)
    assert rollup.commit("2", spark.createDataFrame([(None, "de", "x", -1), ("s", "en", "a b c", -1), ("s", "en", "a", 1)], rows.schema))
    assert rollup.commit("3", rows.limit(0)) and rollup.committed() == ["1/a b", "2", "3"]
    want = [("s", "en", 2, 1)]
    read = lambda r: [(x.source, x.lang, x.n_docs, x.n_tokens) for x in r.totals().collect()]
    assert read(rollup) == want
    # a driver that has staged its deltas when another one commits the batch loses
    staged = f"{path}/staging/late"
    rows.selectExpr("source", "lang", "'w' tokenizer", "1L n_docs", "1L n_tokens").write.parquet(staged)
    assert not rollup._publish(staged, "deltas/2") and read(rollup) == want
    other = TokenRollup(spark, path, {"w": words_tokenizer()})
    assert rollup.compact() and not rollup.compact() and read(other) == want
    assert not other.commit("2", rows) and other.commit("4", rows) and rollup.compact()
    assert read(other) == [("s", "en", 4, 4), (None, "de", 1, 1)] or sorted(map(str, read(other))) == sorted(map(str, [("s", "en", 4, 4), (None, "de", 1, 1)]))


def test_byte_bpe_counts(spark, docs, texts):
    """The byte-level BPE against merges in plain Python, rank by rank."""
    from assaykit.llm.queries import TOKENIZERS
    from assaykit.llm.token_counts import byte_bpe_tokenizer
    import base64
    import importlib.util

    import regex

    spec = importlib.util.spec_from_file_location("tokenizer_folder", f"{TOKENIZERS}/__init__.py")
    module = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(module)
    rank = {}
    with open(f"{TOKENIZERS}/byte_bpe_50k.tiktoken", "rb") as f:
        for line in f:
            a, b = line.split()
            rank[base64.b64decode(a)] = int(b)

    def count(t):
        total = 0
        for m in regex.findall(module.PATTERN, t or ""):
            parts = [bytes([c]) for c in m.encode()]
            while len(parts) > 1:
                low, k = min((rank.get(parts[i] + parts[i + 1], 1 << 60), i) for i in range(len(parts) - 1))
                if low == 1 << 60:
                    break
                parts[k : k + 2] = [parts[k] + parts[k + 1]]
            total += len(parts)
        return total

    rollup = TokenRollup(spark, Scratch(spark).dir, {"bpe": byte_bpe_tokenizer(TOKENIZERS, "byte_bpe_50k.tiktoken")})
    change = docs.selectExpr("cast(doc_id % 3 as string) source", "'x' lang", "text", "if(doc_id = 5, -1, 1) sign")
    rollup.commit("all", change)
    got = {r.source: (r.n_docs, r.n_tokens) for r in rollup.totals().collect()}
    want = {}
    for i, t in [*enumerate(texts), (3, texts[3])]:
        n, k = want.get(str(i % 3), (0, 0))
        sign = -1 if i == 5 else 1
        want[str(i % 3)] = (n + sign, k + sign * count(t))
    assert got == want


def test_warc(spark):
    pages = spark.createDataFrame([(1, "u", "aa"), (2, "u\r\nX: y", "aa"), (3, None, None), (None, "v", "aa"), (5, "w", "é" * 5000), (6, "w", "")], "page_id bigint, url string, html string")
    got = {r.page_id: (r.payload_bytes, r.record_type, r.refers_to) for r in W.warc_round_trip(pages).collect()}
    assert got == {1: (2, "response", None), 2: (2, "revisit", 1), 3: (0, "response", None), None: (2, "revisit", 1), 5: (10000, "response", None), 6: (0, "revisit", 3)}
    good = W.write_archive([W.record_bytes(1, "u", b"abc", W.digest(b"abc"), None)], b"")
    assert next(iter(W.read_archive(good)))["payload"] == b"abc"
    bad = W.write_archive([W.record_bytes(1, "u", b"abc", W.digest(b"abd"), None)], b"")
    for broken in (good[4:], good[:-1], bad, b"", struct.pack("<II", W.DICT_MAGIC, 99)):
        with pytest.raises(W.ArchiveError):
            list(W.read_archive(broken))


def test_viterbi_is_optimal():
    rng = random.Random(4)
    pieces = [b"<unk>", *(f"<0x{i:02X}>".encode() for i in range(256)), SP.MARK, b"a", b"b", b"ab", b"ba", SP.MARK + b"a", b"aab", "é".encode()]
    scores = [0.0] * 257 + [-rng.uniform(1, 9) for _ in pieces[257:]]
    v = SP.Vocabulary.of(pieces, scores, [2] + [6] * 256 + [1] * (len(pieces) - 257))
    e = SP.Encoder(v)
    table = {p: float(np.float32(s)) for p, s in zip(pieces[257:], scores[257:], strict=True)}
    for _ in range(200):
        t = "".join(rng.choice("ab éc") for _ in range(rng.randint(0, 9)))
        ids, ends = e.encode(*buffers(pa.array([t, ""])))
        assert ends[-1] == ends[1] and e.decode(ids, ends)[0].decode() == t
        b = ("▁" + t.replace(" ", "▁")).encode() if t else b""
        best = {0: 0.0}
        for i in range(len(b)):
            if i in best:
                for p, s in table.items():
                    if b.startswith(p, i):
                        best[i + len(p)] = max(best.get(i + len(p), -1e9), best[i] + s)
                if b[i : i + 1] == b"c":
                    best[i + 1] = max(best.get(i + 1, -1e9), best[i] + float(e.unknown_score))
        total = sum(table.get(pieces[x], float(e.unknown_score)) for x in ids.tolist())
        assert abs(total - best[len(b)]) < 1e-3


def test_maximal_segments():
    for trial in range(200):
        rng = random.Random(trial)
        x = np.array([rng.choice([-2.0, -1.0, 1.0, 2.5]) for _ in range(rng.randint(0, 14))])
        got = TX.maximal_segments(x)
        best = max((x[i:j].sum() for i in range(len(x)) for j in range(i + 1, len(x) + 1)), default=0)
        assert max((s for *_, s in got), default=0) == pytest.approx(max(best, 0))
        assert [(a, b) for a, b, _ in got] == list(all_maximal(x.tolist(), 0))


def all_maximal(x, at):
    """The best segment (of ties the first, then the shortest), then those on its two sides."""
    spans = [(-sum(x[i:j]), i, j) for i in range(len(x)) for j in range(i + 1, len(x) + 1)]
    if spans and min(spans)[0] < 0:
        # a maximal segment has no proper part of the same score and no neighbour that adds to it
        best = min(spans)[0]
        ties = [(i, j) for s, i, j in spans if abs(s - best) < 1e-9]
        i, j = min((t for t in ties if not any(u != t and t[0] <= u[0] and u[1] <= t[1] for u in ties)), default=ties[0])
        yield from all_maximal(x[:i], at)
        yield (at + i, at + j)
        yield from all_maximal(x[j:], at + j)


def test_scan_is_linear():
    import time

    def took(n):
        x = np.tile([1.0, -2.0], n // 2)
        began = time.perf_counter()
        assert len(TX.maximal_segments(x)) == n // 2
        return time.perf_counter() - began

    took(40_000)
    assert took(400_000) < 15 * max(took(40_000), 0.02)


def test_toxicity(spark):
    rng = random.Random(9)
    rows = [(i, words(60, rng) + (" vile nasty vile" if i % 5 == 0 else ""), int(i % 5 == 0)) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, toxic int")
    model = TX.fit(df.select("doc_id", "text"), df.where("doc_id % 2 = 0").select("doc_id", "toxic"))
    got = TX.toxicity(df, model).collect()
    assert sum((r.score >= 0.3) == bool(r.toxic) for r in got) > 390
    none = TX.toxicity(spark.createDataFrame([(1, None), (2, "")], "doc_id bigint, text string"), model).collect()
    assert none[0].score == none[1].score < 0.3


def test_toxic_words_need_few_texts(spark):
    """Words of toxic texts alone count from a few texts on, and inflected forms by their longest known stem."""
    rng = random.Random(10)
    # clean texts share four bytes with the toxic words; each toxic word is in 8 fitted texts of 2 000
    clean = [(i, words(60, rng) + " reeu" + rng.choice("abcdef") * 3, 0) for i in range(1840)]
    toxic = [(2000 + i, words(60, rng) + f" reeuxvi{'abcde'[i % 5]}{'klmnopqrst'[i // 5 % 10]} vile{i % 20}", 1) for i in range(160)]
    df = spark.createDataFrame(clean + toxic, "doc_id bigint, text string, toxic int")
    model = TX.fit(df.select("doc_id", "text"), df.select("doc_id", "toxic"))
    new = spark.createDataFrame([(i, words(60, rng) + f" reeuxvi{i}zz", 1) for i in range(20)] + [(i, words(60, rng) + " reeuaaa", 0) for i in range(20)], df.schema)
    assert all(r.predicted == r.toxic for r in TX.toxicity(new, model).collect())
    z = [TX.evidence(np.array([float(n)]), np.zeros(1), 300.0 * n, 2700.0 * n, 1.0, 2.0)[0][0] for n in (4, 16, 64)]
    assert z[1] == pytest.approx(2 * z[0], rel=0.01) and z[2] == pytest.approx(4 * z[0], rel=0.01)


def test_statistic_takes_all_segments():
    model = TX.ToxicModel(np.zeros(0, np.uint64), np.zeros(0), -0.1, 1.0, 1.0, 1.0, 0.0, 0.1)
    norm = 3.0 - np.log(11)
    assert model.statistic([3.0] * 100, 10) == pytest.approx(100 * norm) and norm > 0


def test_lm_scoring(spark, docs):
    rows = lm_scoring(mark_target(docs, docs.where("doc_id < 4"))).collect()
    assert len(rows) == docs.count()
    assert all((r.score is None) == (r.n_words == 0) for r in rows)
    assert all(r.ce_target > 0 and abs(r.score - (r.ce_target - r.ce_background)) < 1e-9 for r in rows if r.n_words)


def test_lm_cross_entropies(spark, docs, texts):
    """The losses by counting words and pairs of all rows in plain Python."""
    from collections import Counter

    lower = lambda g: re.sub(rb"[A-Z]", lambda m: m[0].lower(), g)
    rows = [(i, [lower(g) for g in split(t)]) for i, t in [*enumerate(texts), (3, texts[3])]]
    every = Counter(g for _, w in rows for g in w)
    known = {g for g, n in every.items() if n >= 2}
    rows = [(i, [g if g in known else None for g in w]) for i, w in rows]
    want = {}
    for kind in (0, 1):
        inside = [w for i, w in rows if (i < 4) == (kind == 0)]
        uni, pair = Counter(g for w in inside for g in w), Counter(p for w in inside for p in itertools.pairwise(w))
        for i, w in rows:
            own, own2 = (Counter(w), Counter(itertools.pairwise(w))) if (i < 4) == (kind == 0) else (Counter(), Counter())
            total = uni.total() - own.total()
            loss = []
            for k, g in enumerate(w):
                p1 = (uni[g] - own[g] + 1) / (total + len(known) + 1)
                before = uni[w[k - 1]] - own[w[k - 1]] if k else 0
                p2 = (pair[w[k - 1], g] - own2[w[k - 1], g]) / before if before > 0 else p1
                loss.append(-np.log(0.5 * min(p2, 1) + 0.5 * p1))
            want.setdefault(i, {})[kind] = np.mean(loss) if loss else None
    for r in lm_scoring(mark_target(docs, docs.where("doc_id < 4"))).collect():
        for kind, got in enumerate((r.ce_target, r.ce_background)):
            assert got == (None if want[r.doc_id][kind] is None else pytest.approx(want[r.doc_id][kind], abs=1e-9))
