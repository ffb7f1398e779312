"""Benchmark decontamination: a prefix-filtered join of item windows and documents.

A window is ``window`` consecutive words of a benchmark item; an item with fewer
words, but not none, is one window. A document that holds a window must hold every
word of it, so for exact containment the necessary prefix of a window is its single
rarest word. Rarity is the count over all documents. Document words meet only
those prefix words; a match then passes the positional bound (the window's start
is not before the text's) and the length bound (its end is not past the text's)
and is verified word by word in place.

Everything is DataFrame code: one generator and one hash join in the same
generated stage, then an aggregation that shuffles one marker row per document
plus the verified matches. The side with the windows is broadcast only after its
size has been measured (``broadcast_bytes``). Above that bound words are counted with
partial sums before the shuffle, and the distinct prefix words, far fewer than the windows,
are broadcast in slices of measured size: each slice of a scan keeps the occurrences of its
words only, with the ``window`` words to either side, and only those go to the shuffled join
with the windows, in which Spark may split hot words and which verifies in place.

Cases: null or empty texts have no words and no hits; an item without words is
ignored; the windows of an item without an id are hit like others, but the item is neither
counted nor listed; repeated windows and ties in rarity (broken by the word itself) don't
change the result; rows equal in ``doc_id`` and text give a row each; other columns
of the inputs are ignored, whatever their names; empty tables give empty results
or, without items, clean documents.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Separators of words, fixed by the contract.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Stands for the end of a text; no word can equal it, as it is a separator.
_MARK = " "


def lower_ascii(text: Column) -> Column:
    """Lower-cases A-Z alone."""
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, _UPPER, _LOWER))


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(lower_ascii(F.coalesce(text, F.lit(""))), SEPARATORS), "")


def item_windows(items: DataFrame, window: int) -> DataFrame:
    """Distinct windows (g, length, items: ids as strings, without nulls) of the items."""
    w = items.select(F.col("item_id").cast("string").alias("item"), words_of(F.col("text")).alias("w")).where("size(w) > 0")
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - window + 1, F.lit(1)))
    each = w.select("item", "w", F.explode(starts).alias("s")).select("item", F.slice("w", F.col("s"), F.lit(window)).alias("g"))
    return each.groupBy("g").agg(F.collect_set("item").alias("items")).withColumn("length", F.size("g"))


def _exploded(docs: DataFrame, *carried: str) -> DataFrame:
    return docs.select(*carried, F.posexplode(F.concat("w", F.array(F.lit(_MARK)))).alias("pos", "word"))


def decontaminate(docs: DataFrame, items: DataFrame, window: int = 10, broadcast_bytes: int = 4 << 20) -> DataFrame:
    """Per document: n_words, n_hit, n_items, item_ids (sorted strings), items_sha256, contaminated.

    ``docs`` has doc_id and text, ``items`` item_id and text.
    """
    spark = docs.sparkSession
    texts = docs.select("doc_id", F.xxhash64("text").alias("key"), words_of(F.col("text")).alias("w")).withColumn("n_words", F.size("w").cast("long"))
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    small = size <= broadcast_bytes
    hint = F.broadcast if small else (lambda df: df)
    windows = item_windows(items, window)
    vocabulary = windows.select(F.explode("g").alias("word")).distinct()
    if small:
        counts = _exploded(texts, "doc_id").join(F.broadcast(vocabulary), "word").groupBy("word").agg(F.count("*").alias("df"))
    else:
        counts = texts.select(F.explode("w").alias("word")).groupBy("word").agg(F.count("*").alias("df")).join(vocabulary, "word")
    # the rarest word of each window; a word that no document has makes the window impossible
    ranked = (
        windows.select("g", "items", "length", F.posexplode("g").alias("off", "word"))
        .join(hint(counts), "word", "left")
        .groupBy("g")
        .agg(F.min(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "word", "off")).alias("r"), F.first("items").alias("items"), F.first("length").alias("length"))
    )
    prefixes = ranked.where("r.df > 0").select(F.col("r.word").alias("word"), F.col("r.off").alias("off"), "length", "g", "items")
    marker = spark.range(1).select(
        F.lit(_MARK).alias("word"), F.lit(0).alias("off"), F.lit(0).alias("length"), F.array().cast("array<string>").alias("g"), F.array().cast("array<string>").alias("items")
    )
    begin = (F.col("pos") - F.col("off")).alias("start")
    ends_inside = (F.col("pos") >= F.col("off")) & (F.col("pos") - F.col("off") + F.col("length") <= F.col("n_words"))
    found = ["doc_id", "key", "n_words", begin, "length", "items"]
    if small:
        same = F.slice("w", F.col("pos") - F.col("off") + 1, F.greatest("length", F.lit(1))) == F.col("g")
        near = _exploded(texts, "doc_id", "key", "n_words", "w").join(F.broadcast(prefixes.unionByName(marker)), "word")
        found = near.where((F.col("length") == 0) | (ends_inside & same)).select(*found)
    else:
        around = F.slice("w", F.greatest(F.col("pos") - window + 2, F.lit(1)), 2 * window - 1).alias("around")
        wanted = prefixes.select("word").distinct()
        size = wanted.agg(F.sum(F.octet_length("word") + 16)).first()[0] or 0
        n_slices = max(1, -(-size // broadcast_bytes)) if broadcast_bytes else 1
        each = texts.select("doc_id", "key", "n_words", "w", F.posexplode("w").alias("pos", "word"))
        parts = [wanted.where(F.pmod(F.xxhash64("word"), F.lit(n_slices)) == i) for i in range(n_slices)]
        if broadcast_bytes:
            parts = [F.broadcast(p) for p in parts]
        near = reduce(DataFrame.unionByName, (each.join(p, "word", "leftsemi").select("doc_id", "key", "n_words", "pos", "word", around) for p in parts))
        at = F.col("pos") - F.col("off") - F.greatest(F.col("pos") - window + 1, F.lit(0)) + 1
        same = F.slice("around", F.greatest(at, F.lit(1)), "length") == F.col("g")
        found = near.join(prefixes, "word").where(ends_inside & same).select(*found)
        found = found.unionByName(texts.select("doc_id", "key", "n_words", F.lit(0).alias("start"), F.lit(0).alias("length"), F.array().cast("array<string>").alias("items")))
    span = F.when(F.col("length") > 0, F.struct("start", "length"))
    by_doc = found.groupBy("doc_id", "key", "n_words").agg(
        F.collect_set(span).alias("spans"), F.collect_set(F.when(F.col("length") > 0, F.col("items"))).alias("found"), F.count_if(F.col("length") == 0).alias("copies")
    )

    def widen(acc: Column, s: Column) -> Column:
        end = s["start"] + s["length"]
        return F.struct(F.greatest(acc["end"], end).alias("end"), (acc["n"] + F.greatest(F.lit(0), end - F.greatest(acc["end"], s["start"]))).alias("n"))

    n_hit = F.aggregate(F.array_sort("spans"), F.struct(F.lit(0).alias("end"), F.lit(0).alias("n")), widen)["n"].cast("long")
    item_ids = F.array_sort(F.array_distinct(F.flatten("found")))
    each = F.explode(F.array_repeat(F.lit(0), F.col("copies").cast("int")))  # equal rows have been judged together
    return by_doc.select("doc_id", "n_words", n_hit.alias("n_hit"), item_ids.alias("item_ids"), each.alias("copy")).select(
        "doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"), "item_ids",
        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )
