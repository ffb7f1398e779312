"""N-gram Jaccard join on token-combination prefixes.

A text's set holds its distinct word n-grams (words split on ASCII white space, A-Z
lower-cased; a text with fewer words is one n-gram). Two texts link when the Jaccard
similarity of their sets is at least ``percent`` / 100; the result has each text's
component under these links. Candidates are complete, whatever the data; n-grams are
64-bit hashes, of which two of n different ones are equal by chance with probability
n * n / 2**65.

1. Frequencies: one round of questions gives each block the class (bit length of the
   document frequency) of its n-grams. N-grams that no other text has can't be shared;
   a text with more of them than the threshold allows is settled without candidates.
2. Signatures: the rest order their n-grams by class, rarest first. Rare ones are
   signatures alone. The frequent ones fall into parts by hash, and in each
   part pairs of them are signatures, so that m n-grams there cover m - 1 mismatches;
   prefixes are extended until the cover exceeds the allowed mismatches. Then two texts
   that link share a signature: the one whose prefix ends first would otherwise miss
   more n-grams of the other than allowed. There are as many parts as the power of
   four at or below the set's size, so that signatures are about as many as n-grams at
   most; a set whose partners may have another power has signatures for both. A set that can't
   give such a cover (at 80 percent only one of a single n-gram) adds its frequent n-grams
   singly, which meets all others of this kind.
3. Texts with equal sets are one class from here on, by a 64-bit digest of the set; two of n different sets
   have one by chance with probability n * n / 2**65. For each signature its classes are
   checked against one leader; a verified link joins components. Signatures whose
   classes are still in different components then yield those pairs that cross
   components and pass the length and bitmap bounds, which are verified as well. So pairs
   inside a group of copies are never enumerated, yet no link between components is lost.
   The bitmap holds the parity of the n-grams per bit; an n-gram that only one of two sets
   has changes one bit, so sets whose bitmaps differ in more bits than the threshold
   allows n-grams to differ can't link.

Cases: null or empty texts and texts without words have no set and are alone; equal
sets always link; repeated rows are rows of their own; a null id takes part, but is
never the smallest of a component that has another; extra columns are kept, and those
that clash with an output name are replaced; empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce
from operator import add

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .blocks import Blocks, decode_batch, pack, slices, split_key
from .components import components, joined
from .kernels import Words, buffers, gram_hashes, gram_starts, mix64
from .scratch import Scratch

U64 = np.uint64
#: N-grams with at least 2 ** (FREQUENT - 1) documents are frequent.
FREQUENT = 9
#: 64-bit words of a bitmap.
BITMAP = 16
#: Rounds with other leaders before the remaining pairs are compared, and rows of a signature that are compared in one place then.
STAR_ROUNDS, PAIR_ROWS = 2, 256


def sets_of(column: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Distinct (text, n-gram hash) pairs, in order of the hash, then of the text; number of texts."""
    data, offsets = buffers(column)
    words = Words(data, offsets, lower=True)
    h = gram_hashes(words.hash, n)
    ok = np.flatnonzero(gram_starts(words.bounds, n))
    text, value = [words.owners()[ok]], [h[ok]]
    for k in range(1, n):
        few = np.flatnonzero(words.counts == k)
        if len(few):
            text.append(few)
            value.append(gram_hashes(words.hash, k)[words.bounds[few]])
    text, value = np.concatenate(text), np.concatenate(value)
    order = np.lexsort((text, value))
    text, value = text[order], value[order]
    new = np.ones(len(text), bool)
    new[1:] = (value[1:] != value[:-1]) | (text[1:] != text[:-1])
    return text[new], value[new], len(offsets) - 1


def _runs(sorted_values: np.ndarray) -> np.ndarray:
    new = np.ones(len(sorted_values), bool)
    new[1:] = sorted_values[1:] != sorted_values[:-1]
    return new


def _ask(column: pa.Array, n: int, bits: int) -> Iterator[tuple[int, bytes]]:
    _, value, _ = sets_of(column, n)
    new = np.flatnonzero(_runs(value))
    count = np.diff(np.concatenate((new, [len(value)]))).astype(np.uint32)
    bucket, rest = split_key(value[new], bits)
    for b, i, j in slices(bucket):
        many = np.flatnonzero(count[i:j] > 1).astype(np.uint32)
        yield b, np.uint32(j - i).tobytes() + rest[i:j].tobytes() + many.tobytes() + count[i:j][many].tobytes()


def _answer(blobs: list[bytes]) -> list[bytes]:
    """Which keys two or more documents have (bits), and the class of each of those."""
    rests, counts = [], []
    for b in blobs:
        n = int(np.frombuffer(b, np.uint32, 1)[0])
        tail = np.frombuffer(b, np.uint32, offset=4 + 4 * n)
        count = np.ones(n, np.int64)
        count[tail[: len(tail) // 2]] = tail[len(tail) // 2 :]
        rests.append(np.frombuffer(b, np.uint32, n, 4))
        counts.append(count)
    rest, count = np.concatenate(rests), np.concatenate(counts)
    order = np.argsort(rest, kind="stable")
    new = _runs(rest[order])
    total = np.add.reduceat(count[order], np.flatnonzero(new)) if len(rest) else count
    df = np.empty(len(rest), np.int64)
    df[order] = total[np.cumsum(new) - 1]
    cls = np.frexp(df.astype(np.float64))[1].astype(np.uint8)
    out = []
    for c in np.split(cls, np.cumsum([len(r) for r in rests])[:-1]):
        out.append(np.packbits(c > 1).tobytes() + c[c > 1].tobytes())
    return out


def _classes(blobs: list[bytes], counts: list[int]) -> np.ndarray:
    parts = [np.zeros(0, np.uint8)]
    for b, n in zip(blobs, counts, strict=True):
        size = -(-n // 8)
        cls = np.ones(n, np.uint8)
        cls[np.unpackbits(np.frombuffer(b, np.uint8, size), count=n).astype(bool)] = np.frombuffer(b, np.uint8, offset=size)
        parts.append(cls)
    return np.concatenate(parts)


def levels(size: int, percent: int) -> range:
    """Powers of four at or below the sizes that a partner of a set may have."""
    return range((max(1, -(-size * percent // 100)).bit_length() - 1) // 2, ((size * 100 // percent).bit_length() + 1) // 2)


def signatures(value: np.ndarray, cls: np.ndarray, spare: int, parts: list[int], frequent: int = FREQUENT) -> np.ndarray:
    """Signatures of a set's shared n-grams when up to ``spare`` of them may be missing in a partner, for each number of parts."""
    order = np.lexsort((value, cls))
    every, often = value[order], cls[order] >= frequent
    at = np.flatnonzero(often)
    out = []
    for n_parts in parts:
        part = (mix64(every[at]) >> U64(20)).astype(np.int64) % n_parts
        gain = np.ones(len(every), np.int64)
        if len(at):
            by = np.argsort(part, kind="stable")
            gain[at[by[_runs(part[by])]]] = 0  # the first of a part covers nothing
        end = int(np.searchsorted(np.cumsum(gain), spare + 1)) + 1
        rare, w = every[:end][~often[:end]], every[at[at < end]]
        out.append(mix64(rare ^ U64(0xA5A5A5A5)))
        # pairs inside a part: each n-gram with those before it, a step further back at a time
        by = np.lexsort((w, part[: len(w)]))
        w, p = w[by], part[: len(w)][by]
        for back in range(1, len(w)):
            same = np.flatnonzero(p[back:] == p[:-back])
            if not len(same):
                break
            out.append(mix64((w[same] * U64(0x9FB21C651E98DF25) + w[same + back]) ^ U64(n_parts)))
        if end > len(every):
            out.append(mix64(w ^ U64(0x5A5A5A5A)))
    return np.unique(np.concatenate(out))


def parity_bitmap(value: np.ndarray) -> np.ndarray:
    """Parity of the number of values per bit, as BITMAP signed 64-bit words."""
    bit = (mix64(value) % U64(64 * BITMAP)).astype(np.int64)
    return np.packbits((np.bincount(bit, minlength=64 * BITMAP) & 1).astype(bool)).view(np.int64)


def _may_link(n: str, m: str, bits: str, bobs: str, percent: int) -> Column:
    """Length and bitmap bounds of two sets, by the names of their sizes and bitmaps."""
    x, y = F.col(n), F.col(m)
    differ = reduce(add, (F.bit_count(F.get(bits, F.lit(i)).bitwiseXOR(F.get(bobs, F.lit(i)))) for i in range(BITMAP)))
    return (F.least(x, y) * 100 >= F.greatest(x, y) * percent) & (differ * (100 + percent) <= (x + y) * (100 - percent))


def _scan(docs: DataFrame, text: str, n: int, percent: int, frequent: int, extra: list[str]) -> tuple[DataFrame, Blocks]:
    """Each row without its text, with n_shingles, and, if it may link, the ``extra`` columns: class, n-grams, signatures, bitmap; and the blocks it reads."""
    blocks = pack(docs, text)
    bits, at = blocks.bits, docs.columns.index(text)
    answers = blocks.ask(lambda batch, _: _ask(batch.column(at), n, bits), _answer, 1)
    keep = [c for c in docs.columns if c != text]
    where = {c: docs.columns.index(c) for c in keep}
    types = dict(docs.dtypes)
    schema = ", ".join([f"`{c}` {types[c]}" for c in keep] + ["n_shingles bigint", *(f"`{c}` {t}" for c, t in zip(extra, ("bigint", "binary", "array<bigint>", "array<bigint>"), strict=True))])

    def use(block_id: int, body: bytes, got: dict) -> pa.RecordBatch:
        batch = decode_batch(body)
        owner, value, m = sets_of(batch.column(at), n)
        new = _runs(value)
        counts = [j - i for _, i, j in slices(split_key(value[new], bits)[0])]
        cls = _classes(got.get(1, []), counts)[np.cumsum(new) - 1] if len(value) else np.zeros(0, np.uint8)
        order = np.argsort(owner, kind="stable")
        value, cls, size = value[order], cls[order], np.bincount(owner, minlength=m)
        ends = np.cumsum(size)
        ids, grams, sigs, maps = [None] * m, [None] * m, [None] * m, [None] * m
        for i in range(m):
            v, c = value[ends[i] - size[i] : ends[i]], cls[ends[i] - size[i] : ends[i]]
            need = -(-percent * int(size[i]) // 100)
            shared = c > 1
            if size[i] and shared.sum() >= need:
                parts = [4**level for level in levels(int(size[i]), percent)]
                s = signatures(v[shared], c[shared], int(shared.sum()) - need, parts, frequent)
                digest = mix64(np.bitwise_xor.reduce(mix64(v), keepdims=True) + v.sum(dtype=U64, keepdims=True) + U64(size[i]))
                ids[i], grams[i], sigs[i], maps[i] = int(digest.view(np.int64)[0]), v[shared].tobytes(), s.view(np.int64), parity_bitmap(v)
        return pa.RecordBatch.from_arrays(
            [*(batch.column(where[c]) for c in keep), pa.array(size, pa.int64()), pa.array(ids, pa.int64()), pa.array(grams, pa.binary()), pa.array(sigs, pa.list_(pa.int64())), pa.array(maps, pa.list_(pa.int64()))],
            names=[*keep, "n_shingles", *extra],
        )

    return blocks.with_answers(answers, use, schema), blocks


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of classes that reach the similarity."""
    one = sets.select(F.col("cls").alias("a"), F.col("n_shingles").alias("na"), F.col("grams").alias("ga"))
    two = sets.select(F.col("cls").alias("b"), F.col("n_shingles").alias("nb"), F.col("grams").alias("gb"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            na, nb = batch.column("na").to_numpy(), batch.column("nb").to_numpy()
            good = np.zeros(batch.num_rows, bool)
            for i, (x, y) in enumerate(zip(batch.column("ga"), batch.column("gb"), strict=True)):
                both = np.concatenate((np.frombuffer(x.as_buffer(), U64), np.frombuffer(y.as_buffer(), U64)))
                both.sort(kind="stable")
                common = int((both[1:] == both[:-1]).sum())
                good[i] = 100 * common >= percent * (int(na[i]) + int(nb[i]) - common)
            mask = pa.array(good)
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(mask), batch.column("b").filter(mask)], names=["a", "b"])

    return pairs.select("a", "b").join(one, "a").join(two, "b").select("a", "b", "na", "nb", "ga", "gb").mapInArrow(run, "a bigint, b bigint")


def _pairs(open_: DataFrame, percent: int, table: Callable[[DataFrame], DataFrame], rows: int = PAIR_ROWS) -> DataFrame:
    """Pairs (a, b) of classes of different components that share a signature and may link.

    A signature's rows fall into parts of about ``rows`` by hash, and its pairs into pairs of parts (i, j), so
    that a hot signature is dealt out over as many keys as its pairs need.
    """
    sizes = table(open_.groupBy("sig").agg(F.ceil(F.count("*") / rows).cast("int").alias("k")))
    placed = open_.join(sizes, "sig").withColumn("p", F.pmod(F.xxhash64("cls"), F.col("k")).cast("int"))
    left = placed.select("sig", F.col("cls").alias("a"), F.col("n").alias("na"), F.col("c").alias("ca"), "bits", F.col("p").alias("i"), F.explode(F.sequence("p", F.col("k") - 1)).alias("j"))
    right = placed.select("sig", F.col("cls").alias("b"), F.col("n").alias("nb"), F.col("c").alias("cb"), F.col("bits").alias("bobs"), F.explode(F.sequence(F.lit(0), "p")).alias("i"), F.col("p").alias("j"))
    met = left.join(right, ["sig", "i", "j"]).where("ca <> cb AND (i <> j OR a < b)").where(_may_link("na", "nb", "bits", "bobs", percent))
    return met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def ngram_jaccard(docs: DataFrame, n: int = 5, percent: int = 80, text: str = "text", doc_id: str = "doc_id", frequent: int = FREQUENT) -> DataFrame:
    """``docs`` without the text, with n_shingles, component_id and n_verified.

    n_verified counts links between different sets that were verified on the way to the
    component, not all there are. ``doc_id`` may be of any type that has an order.
    """
    docs = docs.select(*[c for c in docs.columns if c in (text, doc_id) or c.lower() not in ("n_shingles", "component_id", "n_verified")])
    scratch = Scratch(docs.sparkSession)
    extra = ["cls", "grams", "sigs", "bits"]
    while {c.lower() for c in docs.columns} & set(extra):  # not the names of columns that are kept
        extra = [f"_{c}" for c in extra]
    scanned, blocks = _scan(docs, text, n, percent, frequent, extra)
    rows = scratch.table(scanned)
    blocks.release()
    own = rows.select(F.col(f"`{doc_id}`").alias("low"), "n_shingles", *(F.col(c).alias(k) for c, k in zip(extra, ("cls", "grams", "sigs", "bits"), strict=True)))
    sets = scratch.table(own.where("cls IS NOT NULL").groupBy("cls").agg(F.min("low").alias("low"), *(F.first(c).alias(c) for c in ("n_shingles", "grams", "sigs", "bits"))))
    sigs = sets.select("cls", F.col("n_shingles").alias("n"), F.explode("sigs").alias("sig"))
    fits = lambda x, y: (F.least(x, y) * 100 >= F.greatest(x, y) * percent)
    leaders = sigs.groupBy("sig").agg(F.min(F.struct("cls", "n")).alias("lead"), F.count("*").alias("m")).where("m > 1").select("sig", F.col("lead.cls").alias("a"), F.col("lead.n").alias("na"))
    stars = scratch.table(sigs.join(leaders, "sig").where(F.col("cls") != F.col("a")).where(fits(F.col("n"), F.col("na"))).select("a", F.col("cls").alias("b")).distinct())
    links = scratch.table(_verified(stars, sets, percent))

    labels = components(links, scratch)

    def unsettled() -> DataFrame:
        """Signature rows whose classes are still in different components."""
        labelled = sigs.join(labels.withColumnRenamed("v", "cls"), "cls", "left").select("sig", "cls", "n", F.coalesce("c", "cls").alias("c"))
        # written, so that the join with them has nothing but rows to deal out and Spark may split it
        mixed = scratch.table(labelled.groupBy("sig").agg(F.min("c").alias("c0"), F.max("c").alias("c1")).where("c0 < c1").select("sig"))
        return scratch.table(labelled.join(mixed, "sig").join(sets.select("cls", "bits"), "cls"))

    # other leaders, not the same in each signature, join what the first ones could not, so that few pairs are left to compare one by one
    tested = stars
    for salt in range(STAR_ROUNDS + 1):
        open_ = unsettled()
        if open_.isEmpty():
            break
        if salt < STAR_ROUNDS:
            lead = open_.groupBy("sig").agg(F.min(F.struct(F.xxhash64("cls", "sig", F.lit(salt)), F.col("cls").alias("x"), F.col("n").alias("m"), F.col("c").alias("d"), F.col("bits").alias("bobs"))).alias("l")).select("sig", "l.x", "l.m", "l.d", "l.bobs")
            more = open_.join(scratch.table(lead), "sig").where("c <> d").where(_may_link("n", "m", "bits", "bobs", percent)).select(F.least("cls", "x").alias("a"), F.greatest("cls", "x").alias("b")).distinct()
        else:
            more = _pairs(open_, percent, scratch.table)
        more = scratch.table(more.join(tested, ["a", "b"], "left_anti"))
        tested = tested.unionByName(more)
        more = scratch.table(_verified(more, sets, percent))
        scratch.drop(open_)
        links = links.unionByName(more)
        labels = joined(labels, more, scratch)
    every, final = links, labels
    ends = every.select(F.explode(F.array("a", "b")).alias("cls")).groupBy("cls").agg(F.count("*").alias("n_verified"))
    member = sets.select("cls", "low").join(final.withColumnRenamed("v", "cls"), "cls", "left").withColumn("c", F.coalesce("c", "cls"))
    smallest = member.groupBy("c").agg(F.min("low").alias("component_id"))
    by_class = member.join(smallest, "c").join(ends, "cls", "left").select(F.col("cls").alias(extra[0]), "component_id", F.coalesce("n_verified", F.lit(0)).alias("n_verified"))
    keep = [F.col(f"`{c}`") for c in rows.columns if c not in extra]
    return rows.join(by_class, extra[0], "left").select(*keep, F.coalesce("component_id", F.col(f"`{doc_id}`")).alias("component_id"), F.coalesce("n_verified", F.lit(0)).alias("n_verified"))
