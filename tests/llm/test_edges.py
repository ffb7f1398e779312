"""Colliding-looking words, clashing names, empty tables, long texts, linear time, bounded archives."""

import time

import numpy as np
import pyarrow as pa
import pytest

from assaykit.llm import decontaminate as D
from assaykit.llm import sentencepiece_unigram as SP
from assaykit.llm import toxicity as TX
from assaykit.llm import warc as W
from assaykit.llm.blocks import pack_ints, unpack_ints
from assaykit.llm.chat_format import chat_format
from assaykit.llm.kernels import buffers, hash_ranges, same_ranges
from assaykit.llm.lm_scoring import lm_scoring, mark_target
from assaykit.llm.ngram_jaccard import ngram_jaccard
from assaykit.llm.quality_rules import quality_rules
from assaykit.llm.queries import TOKENIZERS
from assaykit.llm.scratch import Scratch
from assaykit.llm.suffix_dedup import suffix_dedup, window_owners
from assaykit.llm.token_counts import TokenRollup, words_tokenizer

MODEL = f"{TOKENIZERS}/piece_bpe_32k.model"


def thue_morse(bits, a="a", b="b"):
    word = [0]
    for _ in range(bits):
        word += [1 - x for x in word]
    return "".join((a, b)[x] for x in word)


@pytest.mark.parametrize("bits", [10, 11, 12])
def test_structured_words_differ(spark, bits):
    """Words whose polynomial hashes modulo 2**64 are equal."""
    x, y = thue_morse(bits), thue_morse(bits, "b", "a")
    data, off = buffers(pa.array([x, y]))
    assert len(set(hash_ranges(data, off[:-1], off[1:]).tolist())) == 2
    df = spark.createDataFrame([(1, x), (2, y), (3, f"{x} c"), (4, f"{y} c")], "doc_id bigint, text string")
    assert [r.component_id for r in ngram_jaccard(df).orderBy("doc_id").collect()] == [1, 2, 3, 4]
    for r in SP.sentencepiece(df, MODEL).collect():
        assert r.round_trip and r.decoded == {1: x, 2: y, 3: f"{x} c", 4: f"{y} c"}[r.doc_id]
    got = {r.doc_id: r.ce_target for r in lm_scoring(df.selectExpr("*", "doc_id IN (1, 3) AS target")).collect()}
    assert got[1] != got[2] and got[3] != got[4]
    assert [r.n_removed for r in suffix_dedup(spark.createDataFrame([(1, x), (2, "q" * 60)], df.schema)).orderBy("doc_id").collect()] == [0, 0]


def test_hashes_and_packing():
    rng = np.random.default_rng(3)
    data = rng.integers(0, 3, 4000).astype(np.uint8)
    start = rng.integers(0, 3000, 3000)
    end = start + rng.choice([0, 1, 7, 8, 9, 15, 16, 255, 256, 257, 600, 900], 3000)
    h, raw = hash_ranges(data, start, end), data.tobytes()
    parts = [raw[a:b] for a, b in zip(start.tolist(), end.tolist())]
    assert len(set(h.tolist())) == len(set(parts)) and len(set(zip(h.tolist(), parts))) == len(set(parts))
    size = end - start
    other = rng.integers(0, 3000, 3000)
    assert same_ranges(data, start, size, other).tolist() == [raw[a : a + n] == raw[b : b + n] for a, n, b in zip(start.tolist(), size.tolist(), other.tolist())]
    for n in (0, 1, 1000):
        a, b = rng.integers(0, 1 << 63, n, dtype=np.uint64), rng.integers(0, 300, n)
        x, y = unpack_ints(pack_ints(a, b), 2)
        assert x.tolist() == a.tolist() and y.tolist() == b.tolist()


def test_merge_on_wide_alphabets():
    rng = np.random.default_rng(8)
    for trial in range(40):
        width, kinds = int(rng.choice([3, 5, 8, 50])), int(rng.choice([2, 5, 30, 256]))
        core = rng.integers(0, kinds, width + 30).astype(np.uint8).tobytes()
        strings = [core[k : k + width + int(rng.integers(0, 20))] + bytes(rng.integers(0, kinds, 3).tolist()) for k in rng.integers(0, 12, 6).tolist()]
        owner = rng.integers(0, 9, 6)
        off = np.concatenate(([0], np.cumsum([len(s) for s in strings])))
        got = window_owners(np.frombuffer(b"".join(strings), np.uint8), off, np.diff(off) - width + 1, owner, width, 1 + trial % 4)
        best = {}
        for s, o in zip(strings, owner.tolist()):
            for i in range(len(s) - width + 1):
                best[s[i : i + width]] = min(best.get(s[i : i + width], 99), o)
        assert [g.tolist() for g in got] == [[best[s[i : i + width]] for i in range(len(s) - width + 1)] for s in strings]


TEXT = " ".join(f"word{i % 37} and{i}" for i in range(60))


def test_clashing_names(spark):
    """Columns with the names of outputs are replaced, all others kept, inner names included."""
    names = ["cls", "grams", "sigs", "bits", "lead", "kept", "n_bytes", "kept_text", "score", "predicted", "segments", "ids", "decoded", "n_shingles", "component_id", "__text", "n_words", "target2"]
    df = spark.createDataFrame([(i, TEXT, *[str(i)] * len(names)) for i in (2, 1)], ["doc_id", "text", *names])
    df = df.withColumn("doc_id", df.doc_id.cast("bigint"))
    outs = {
        "op2": (suffix_dedup(df, outputs=("n_removed", "n_bytes")), {"n_removed", "n_bytes"}, {"text"}),
        "op4": (ngram_jaccard(df), {"n_shingles", "component_id", "n_verified"}, {"text"}),
        "op6": (SP.sentencepiece(df.drop("__text"), MODEL, outputs=("ids", "decoded")), set(SP.OUTPUT), {"__text"}),
        "op8": (TX.toxicity(df.drop("__text"), TX.ToxicModel(np.zeros(0, np.uint64), np.zeros(0), -0.1, 1.0, 1.0, 0.0, 0.0, 0.2)), {"score", "predicted", "segments"}, {"__text"}),
        "op10": (lm_scoring(df.selectExpr("*", "true AS target")), {"n_words", "ce_target", "ce_background", "score"}, {"text"}),
    }
    for op, (out, made, gone) in outs.items():
        rows = out.collect()
        assert len(rows) == 2, op
        for r in rows:
            for c in set(names) - made - gone:
                assert r[c] == str(r.doc_id), (op, c)
    assert [r.component_id for r in outs["op4"][0].collect()] == [1, 1]


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id bigint, text string")
    model = TX.fit(none, spark.createDataFrame([], "doc_id bigint, toxic int"))
    assert ngram_jaccard(none).count() == SP.sentencepiece(none, MODEL).count() == TX.toxicity(none, model).count() == 0
    assert lm_scoring(mark_target(none, none)).count() == 0 and D.decontaminate(none, spark.createDataFrame([(1, "a b")], "item_id bigint, text string")).count() == 0
    assert chat_format(spark.createDataFrame([], "conv_id bigint, turn bigint, role string, text string")).count() == 0
    assert W.warc_round_trip(spark.createDataFrame([], "page_id bigint, url string, html string")).count() == 0
    assert TokenRollup(spark, Scratch(spark).dir, {"w": words_tokenizer()}).totals().count() == 0


def test_nulls_and_long_texts(spark):
    long = " ".join(f"w{i * 7919 % 5003}" for i in range(40_000))
    df = spark.createDataFrame([(1, None), (2, ""), (3, long), (4, "x" * 100_000)], "doc_id bigint, text string")
    got = {r.doc_id: r for r in SP.sentencepiece(df, MODEL).collect()}
    assert got[1].n_tokens == got[2].n_tokens == 0 and got[1].decoded == "" and all(r.round_trip for r in got.values())
    model = TX.ToxicModel(np.zeros(0, np.uint64), np.zeros(0), -0.1, 1.0, 1.0, 1.0, 0.0, 0.1)
    assert len(TX.toxicity(df, model).collect()) == 4 and quality_rules(df).where("n_words = 40000").count() == 1
    rollup = TokenRollup(spark, Scratch(spark).dir, {"w": words_tokenizer()})
    rollup.commit("a", df.selectExpr("'s' source", "'l' lang", "text", "1 sign"))
    assert rollup.totals().first().n_tokens == 40_001
    turns = spark.createDataFrame([(1, k, "user", long[:500]) for k in range(2500)] + [(2, k, "user", long[:500]) for k in range(2400)], "conv_id bigint, turn bigint, role string, text string")
    kept = chat_format(turns).collect()
    assert [(r.conv_id, r.n_turns) for r in kept] == [(1, 2500)] and kept[0].rendered.count("<|im_start|>") == 2500


def test_archives_are_read_in_linear_time():
    def took(n):
        content = W.write_archive([W.record_bytes(i, "u", b"abc%d" % i, W.digest(b"abc%d" % i), None) for i in range(n)], b"")
        began = time.perf_counter()
        assert sum(1 for _ in W.read_archive(content)) == n
        return time.perf_counter() - began

    took(1000)
    assert took(40_000) < 15 * max(took(4_000), 0.01)


def test_archives_of_empty_pages_are_bounded(spark):
    pages = spark.range(45_000).coalesce(1).selectExpr("id AS page_id", "'u' AS url", "'' AS html")
    sizes = [len(list(W.read_archive(bytes(r.content)))) for r in W.write_archives(pages).collect()]
    assert sum(sizes) == 45_000 and max(sizes) <= W.ARCHIVE_RECORDS
    with pytest.raises(W.ArchiveError):
        list(W.read_archive(W.write_archive([b"x"], b"")[:-1]))


def test_large_benchmarks_count_every_copy(spark):
    """Both ways of the join agree on repeated rows, nulls and items with shared windows."""
    words = [f"w{i}" for i in range(40)]
    docs = spark.createDataFrame([(1, " ".join(words)), (1, " ".join(words)), (2, None), (None, " ".join(words[5:30])), (3, "w1 w2")], "doc_id bigint, text string")
    items = spark.createDataFrame([(i, " ".join(words[3 + i : 16 + i])) for i in range(6)] + [(9, "w1 W2")], "item_id bigint, text string")
    a, b = (sorted(map(str, D.decontaminate(docs, items, broadcast_bytes=n).collect())) for n in (1 << 20, 0))
    assert a == b and len(a) == 5 and a.count(a[0]) in (1, 2)


@pytest.mark.parametrize("limit", [1 << 20, 300, 0])
def test_items_without_an_id_are_hit(spark, limit):
    """Windows without an item id count as hits, not as items; equal rows stay apart; slices of prefix words change nothing."""
    words = [f"w{i}" for i in range(60)]
    docs = spark.createDataFrame([(1, " ".join(words)), (2, "x y z"), (3, "a b " + " ".join(words[:30])), (3, "a b " + " ".join(words[:30]))], "doc_id bigint, text string")
    items = [(None, " ".join(words[10:22])), (None, "x Y"), *((i, " ".join(words[35 + i : 47 + i])) for i in range(12))]
    got = {r.doc_id: (r.n_hit, r.n_items, r.item_ids, r.contaminated) for r in D.decontaminate(docs, spark.createDataFrame(items, "item_id bigint, text string"), broadcast_bytes=limit).collect()}
    assert got == {1: (12 + 23, 12, sorted(map(str, range(12))), True), 2: (2, 0, [], True), 3: (12, 0, [], True)}
    assert D.decontaminate(docs, spark.createDataFrame(items, "item_id bigint, text string"), broadcast_bytes=limit).count() == 4


def test_large_benchmarks_shuffle_occurrences_of_prefix_words_only(spark):
    docs = spark.createDataFrame([(1, "a b c d e")], "doc_id bigint, text string")
    items = spark.createDataFrame([(1, "c d e " * 40)], "item_id bigint, text string")
    plan = D.decontaminate(docs, items, broadcast_bytes=100)._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftSemi" in plan and plan.count("Generate posexplode(w") >= 1


def test_totals_while_batches_are_compacted(spark):
    """A reader that took its base before a compaction, or its frame, still reads all batches."""
    path = Scratch(spark).dir
    rollup = TokenRollup(spark, path, {"w": words_tokenizer()})
    rows = spark.createDataFrame([("s", "en", "a b c", 1), ("s", "en", "d e f", 1)], "source string, lang string, text string, sign int")
    read = lambda df: [(r.n_docs, r.n_tokens) for r in df.collect()]
    rollup.commit("1", rows)
    late, other = TokenRollup(spark, path, {"w": words_tokenizer()}), TokenRollup(spark, path, {"w": words_tokenizer()})
    early = late.totals()
    base, names = late._base, late._names

    def between():
        found = base()
        late._base = base
        other.compact()
        return found

    late._base = between
    assert read(late.totals()) == [(2, 6)] and read(early) == [(2, 6)]
    rollup.commit("2", rows)
    assert rollup.compact() and not rollup.compact() and read(late.totals()) == [(4, 12)]
    rollup.commit("3", rows)
    assert rollup.compact() and read(late.totals()) == [(6, 18)] and not rollup.commit("1", rows)
    # what the base before the last held is gone
    assert sorted(n for n in names("deltas") if not any(f.getPath().getName().endswith(".parquet") for f in late._fs.listStatus(late._path(f"{path}/deltas/{n}")))) == ["1", "2"]


def test_page_ids_below_zero_and_none(spark):
    rows = [(-5, "a", "same"), (3, "b", "same"), (-1, "c", "other"), (None, "d", "same"), (None, "e", "own"), (None, "f", "own"), ((1 << 63) - 1, "g", "last"), (None, "h", "last")]
    got = {r.url: (r.page_id, r.record_type, r.refers_to, r.payload_bytes) for r in W.warc_round_trip(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()}
    own = sorted([got.pop("e"), got.pop("f")], key=repr)
    assert got == {"a": (-5, "response", None, 4), "b": (3, "revisit", -5, 4), "c": (-1, "response", None, 5), "d": (None, "revisit", -5, 4), "g": ((1 << 63) - 1, "response", None, 4), "h": (None, "revisit", (1 << 63) - 1, 4)}
    assert own == [(None, "response", None, 3), (None, "revisit", None, 3)]


def test_foreign_archives():
    """Archives of other writers: WARC/1.0, no dictionary or a packed one, frames without a size, other record types, HTTP blocks, folded headers."""
    import struct

    import zstandard

    def record(head, body, version="WARC/1.0"):
        return "\r\n".join([version, *head, f"Content-Length: {len(body)}"]).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"

    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n\r\n<p>hi</p>"
    records = [
        record(["WARC-Type: warcinfo", "WARC-Record-ID: <urn:uuid:1>", "WARC-Date: 2020-01-01T00:00:00Z"], b"software: x"),
        record(["WARC-Type: response", "WARC-Record-ID: <urn:uuid:2>", "WARC-Date: 2020-01-01T00:00:00Z", "WARC-Target-URI:", " http://a/", "Content-Type: application/http; msgtype=response", f"WARC-Payload-Digest: sha1:{W.digest(b'<p>hi</p>')}", f"WARC-Block-Digest: sha1:{W.digest(http)}"], http),
        record(["WARC-Type: resource", "WARC-Record-ID: <urn:uuid:3>", "WARC-Date: 2020-01-01T00:00:00Z"], b"", "WARC/1.1"),
    ]
    stream = lambda r: (lambda c: c.compress(r) + c.flush())(zstandard.ZstdCompressor(write_content_size=False).compressobj())
    plain = b"".join(zstandard.ZstdCompressor().compress(r) for r in records[:1]) + struct.pack("<II", 0x184D2A50, 3) + b"xyz" + b"".join(map(stream, records[1:]))
    got = list(W.read_archive(plain))
    assert [(r["record_type"], r["page_id"], r["record_id"], r["url"], r["payload"], r["date"]) for r in got] == [
        ("warcinfo", None, "<urn:uuid:1>", "", b"software: x", "2020-01-01T00:00:00Z"), ("response", None, "<urn:uuid:2>", "http://a/", b"<p>hi</p>", "2020-01-01T00:00:00Z"), ("resource", None, "<urn:uuid:3>", "", b"", "2020-01-01T00:00:00Z")]
    assert got[1]["payload_digest"] == W.digest(b"<p>hi</p>")
    raw = bytes(range(256)) * 8
    dictionary = zstandard.ZstdCompressor().compress(raw)
    packer = zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(raw))
    packed = struct.pack("<II", W.DICT_MAGIC, len(dictionary)) + dictionary + b"".join(map(packer.compress, records))
    assert [r["record_id"] for r in W.read_archive(packed)] == ["<urn:uuid:1>", "<urn:uuid:2>", "<urn:uuid:3>"]
    wrong = [
        record(["WARC-Type: response", "WARC-Record-ID: <urn:uuid:2>", f"WARC-Block-Digest: sha1:{W.digest(b'no')}"], b"yes"),
        record(["WARC-Record-ID: <urn:uuid:2>"], b"no type"), record(["WARC-Type: response"], b"no id"), records[0][:-1], records[0].replace(b"WARC/1.0", b"WARC/9.9"),
    ]
    for r in wrong:
        with pytest.raises(W.ArchiveError):
            list(W.read_archive(zstandard.ZstdCompressor().compress(r)))
    own = W.record_bytes(7, "http://b/", b"abc", W.digest(b"abc"), None).split(b"\r\n")
    assert b"WARC-Date: 1970-01-01T00:00:00Z" in own and own[0] == b"WARC/1.1"


@pytest.mark.parametrize("rows", [3, 256])
def test_pairs_of_a_hot_signature_are_all_met(spark, rows):
    from assaykit.llm.ngram_jaccard import BITMAP, _pairs

    given = [(1, i, 100, i % 7, [0] * BITMAP) for i in range(40)] + [(2, i, 100, i, [0] * BITMAP) for i in (3, 90, 91)] + [(3, 5, 10, 5, [0] * BITMAP), (3, 6, 100, 6, [0] * BITMAP)]
    open_ = spark.createDataFrame(given, "sig bigint, cls bigint, n bigint, c bigint, bits array<bigint>")
    got = sorted(map(tuple, _pairs(open_, 80, lambda df: df, rows).collect()))
    want = {(x[1], y[1]) for x in given for y in given if x[0] == y[0] and x[1] < y[1] and x[3] != y[3] and 100 * min(x[2], y[2]) >= 80 * max(x[2], y[2])}
    assert got == sorted(want)


def test_ids_that_are_no_integers_are_an_error(spark):
    with pytest.raises(TypeError, match="doc_id"):
        suffix_dedup(spark.createDataFrame([("a", "b")], "doc_id string, text string"))
    with pytest.raises(TypeError, match="page_id"):
        W.write_archives(spark.createDataFrame([("a", "u", "b")], "page_id string, url string, html string"))


def test_pieces_of_bytes_and_digests_of_ids(spark):
    """n_byte_tokens and ids_sha256 follow from the ids; pieces of bytes are those of characters that no piece has."""
    import hashlib

    import sentencepiece as spm

    model = spm.SentencePieceProcessor(model_file=MODEL)
    docs = spark.createDataFrame([(1, "plain words"), (2, "\U0001f9ff\u4e9c\ue000 x\ue001"), (3, None), (4, "")], "doc_id int, text string")
    for r in SP.sentencepiece(docs, MODEL).collect():
        assert r.n_byte_tokens == sum(model.is_byte(i) for i in r.ids) and r.n_tokens == len(r.ids)
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, r.ids)).encode()).hexdigest()
        assert (r.n_byte_tokens > 0) == (r.doc_id == 2)
