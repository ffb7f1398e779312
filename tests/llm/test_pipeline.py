"""The pipeline on a small table, held against plain Python stage by stage."""

import random
import re

import corpus_pipeline as P
import pytest
import sentencepiece as spm

WORDS = [a + b for a in ("ka", "lo", "mi", "ren", "tus", "vor", "zel", "quo") for b in ("da", "fin", "gor", "hul", "pex", "sta", "ty", "wob", "é")]
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, kept boolean, kept_text string, n_words int, cls string, file string, c2_ int"


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + rng.choice(WORDS) for _ in range(n))


def words(t):
    return re.findall(rb"[^\x20\x09-\x0d]+", (t or "").encode())


def rows_of():
    rng = random.Random(21)
    base = [prose(rng, 120) for _ in range(12)]
    passage, leak = prose(rng, 40), prose(rng, 14)
    texts = [
        (7, base[0]), (3, base[0]), (3, base[0]), (None, base[0]), (None, base[1]), (None, base[1]), (4, base[2]), (4, base[3]), (9, base[2].replace(base[2].split()[50], "changed")),
        (10, base[4] + " " + passage), (11, base[5] + " " + passage + " end"), (12, passage), (None, base[6] + " " + leak), (13, base[7] + " " + leak), (13, base[8]), (14, None), (15, ""), (16, "too short"),
        (17, " ".join(["again and again the same words"] * 30)), (18, "\n".join([base[9]] * 3)), (19, base[10] + " " + "#$%&" * 80), (20, prose(rng, 9000)), (21, base[11] + " ▁ x  y"),
    ]
    return [(i, t, "en", "s", len(t or ""), False, "mine", 5, "c", "f", k) for k, (i, t) in enumerate(texts)], [(1, leak), (2, None), (None, base[9][:20])]


def passes(t):
    """The quality verdict."""
    w = words(t)
    n, size = len(w), [len(x.decode()) for x in w]
    total = sum(size) or 1

    def share(places):
        return sum(size[k] for k in places) / total

    def spots(g):
        found = {}
        for i in range(n - g + 1):
            found.setdefault(tuple(w[i : i + g]), []).append(i)
        return {k: v for k, v in found.items() if len(v) > 1}

    def inside(lists, g):
        return {i + k for v in lists for i in v for k in range(g)}

    if n < 10 or 100 * len(inside(spots(5).values(), 5)) > 20 * n:
        return False
    if any(share(inside(spots(g).values(), g)) > limit for g, limit in ((5, 0.30), (7, 0.25), (10, 0.20))):
        return False
    for g, limit in ((2, 0.25), (3, 0.20)):
        found = sorted(spots(g).values(), key=lambda v: (-len(v), v[0]))
        if found and share(inside(found[:1], g)) > limit:
            return False
    lines, seen, dup, every = t.encode().split(b"\n"), set(), 0, 0
    for line in lines:
        if line.strip():
            every += len(line)
            dup += len(line) if line in seen else 0
            seen.add(line)
    return dup <= 0.30 * every and sum(t.count(c) for c in "#*$%&|<>") <= 0.10 * total


def grams(t):
    w = [re.sub(rb"[A-Z]", lambda m: m[0].lower(), x) for x in words(t)]
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def one_of_each(rows):
    sets = [grams(r[1]) for r in rows]
    group = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                group = [group[a] if g == group[b] else g for g in group]
    best = {}
    for k, r in enumerate(rows):
        key = (r[0] is None, r[0] or 0, r[10])
        best[group[k]] = min(best.get(group[k], key), key)
    return [r for k, r in enumerate(rows) if best[group[k]] == (r[0] is None, r[0] or 0, r[10])]


def cut(rows):
    first, big = {}, 1 << 62
    for r in rows:
        b, i = r[1].encode(), big if r[0] is None else r[0]
        for k in range(len(b) - 49):
            first[b[k : k + 50]] = min(first.get(b[k : k + 50], i), i)
    out = []
    for r in rows:
        b, i = r[1].encode(), big if r[0] is None else r[0]
        gone = {k + x for k in range(len(b) - 49) if first[b[k : k + 50]] < i for x in range(50)}
        t = bytes(c for k, c in enumerate(b) if k not in gone).decode("utf-8", "ignore")
        if t.strip(" "):
            out.append((r[0], t, *r[2:4], len(t), *r[5:]))
    return out


def clean(rows, items):
    rx = re.compile(rb"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
    toks = lambda t: rx.findall(re.sub(rb"[A-Z]", lambda m: m[0].lower(), (t or "").encode()))
    wins = {tuple(w[s : s + 10]) for _, t in items for w in [toks(t)] if w for s in range(max(len(w) - 9, 1))}
    return [r for r in rows if not any(tuple(w[i : i + len(x)]) == x for w in [toks(r[1])] for x in wins for i in range(len(w) - len(x) + 1))]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("tables"))
    rows, items = rows_of()
    assert any(i is None and t for i, t in items)
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder, rows, items


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=lambda r: r[10])


def test_every_stage(spark, tables, tmp_path):
    folder, rows, items = tables
    want = {"quality_rules": lambda r: [x for x in r if passes(x[1])], "ngram_jaccard": one_of_each, "suffix_dedup": cut, "decontaminate": lambda r: clean(r, items)}
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in P.STAGES[:-1]:
        before = len(rows)
        rows = want[name](rows)
        out = stage(spark, docs, folder)
        assert out.columns == docs.columns and out.dtypes == docs.dtypes
        assert got(out) == rows, name
        out.coalesce(1).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        assert name == "suffix_dedup" or len(rows) < before
    last = P.run(spark, folder).collect()
    assert sorted(r.c2_ for r in last) == [r[10] for r in rows]
    texts = {r[10]: r[1] for r in rows}
    for r in last:
        assert r.n_tokens == len(r.ids) and r.round_trip == (r.text == texts[r.c2_]) and r.text == texts[r.c2_].replace("▁", " ")
    with_pieces = spm.SentencePieceProcessor(model_file=f"{P.TOKENIZERS}/piece_bpe_32k.model")
    assert all(with_pieces.decode(list(r.ids)) == r.text for r in last)


def test_without_rows_and_without_files(spark, tables):
    folder, rows, _ = tables
    none = spark.read.parquet(f"{folder}/documents.parquet").limit(0)
    for _, stage in P.STAGES:
        assert stage(spark, none, folder).count() == 0
    # rows that come from no file are written first
    some = spark.createDataFrame([r for r in rows if passes(r[1])], SCHEMA).repartition(2)
    assert P.near_duplicates(spark, some, folder).count() == len(one_of_each([r for r in rows if passes(r[1])]))
