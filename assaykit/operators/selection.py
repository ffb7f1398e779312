"""Dedup by first submission, ranking, representatives, report union, counts, pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def deduplicate(df: DataFrame, key: str = "key", order: str = "ord", name: str = "identifier") -> DataFrame:
    """Adds ``duplicate_of``: the identifier of the first row with the key, null on that row.

    Null keys and rows without an ``order`` are always kept. The first row of each key is combined before the shuffle
    and joined back, a join that can be split where a key is hot, so no key's rows need
    to meet in one task. Null keys have no first row; the join deals them out by
    their ``order`` (a plain 0 on the other side would be folded away, and the rows would meet in one task).
    """
    first = df.where(F.col(key).isNotNull() & F.col(order).isNotNull()).groupBy(key).agg(F.min(F.struct(F.col(order).alias("o"), F.col(name).alias("n"))).alias("__first"), F.max(F.lit(0).cast("bigint")).alias("__null"))
    dealt = df.withColumn("__null", F.when(F.col(key).isNull(), F.xxhash64(order)).otherwise(F.lit(0).cast("bigint")))
    joined = dealt.join(first, [key, "__null"], "left")
    return joined.withColumn("duplicate_of", F.when(F.col("__first.o") < F.col(order), F.col("__first.n"))).select(*df.columns, "duplicate_of")


def ranked(df: DataFrame, score: str = "score", name: str = "identifier", order: str = "ord") -> DataFrame:
    return df.orderBy(F.desc(score), name, order)


def top_n(df: DataFrame, n: int) -> DataFrame:
    if n < 1:
        raise ValueError("top_n must be at least 1")
    return ranked(df).limit(n)


def representatives(df: DataFrame, cluster: str = "cluster_id", score: str = "score", name: str = "identifier", order: str = "ord") -> DataFrame:
    """Adds is_cluster_representative: the best (score, identifier) of each cluster, then the first by ``order``."""
    best = df.where(F.col(cluster).isNotNull()).groupBy(cluster).agg(F.max(F.struct(score, name, (-F.col(order)).alias("o"))).alias("__best"))
    return df.join(best, cluster, "left").withColumn("is_cluster_representative", F.coalesce(F.col("__best.o") == -F.col(order), F.lit(False))).drop("__best")


def page(df: DataFrame, offset: int = 0, limit: int = 100) -> DataFrame:
    if not 1 <= limit <= 1000 or offset < 0:
        raise ValueError("limit must be 1 to 1000 and offset at least 0")
    return ranked(df).offset(offset).limit(limit)


def count_columns(clusters: bool = False) -> list[Column]:
    """Reconciling counts of rows with parse_ok, drop_reason, duplicate_of as aggregates, for ``agg`` or ``observe``.

    ``clusters`` counts the representatives, of which each cluster has one: a sum, where
    distinct ids would need a shuffle and can't be observed.
    """
    kept = F.col("parse_ok") & F.col("drop_reason").isNull()
    reasons = [F.count_if(F.col("parse_ok") & (F.col("drop_reason") == r)).alias(r) for r in ("dropped_by_window", "dropped_by_rule", "dropped_by_alert")]
    return [
        F.count("*").alias("submitted"), F.count_if("parse_ok").alias("parsed"), F.count_if(~F.col("parse_ok")).alias("parse_failed"),
        F.count_if(kept & F.col("duplicate_of").isNotNull()).alias("duplicates_removed"), *reasons, F.count_if(kept & F.col("duplicate_of").isNull()).alias("retained"),
        *([F.count_if("is_cluster_representative").alias("clusters")] if clusters else []),
    ]


def counts(df: DataFrame, clusters: bool = False) -> DataFrame:
    """One row of ``count_columns``."""
    return df.agg(*count_columns(clusters))


def dense_index(df: DataFrame, order: list, name: str, table) -> DataFrame:
    """Adds ``name``: 0, 1, 2... in ``order``, by a range-partitioned sort; one row per partition is what a single task sees.

    ``table`` keeps the sorted rows, so that their places are the same when read again.
    """
    rows = table(df.orderBy(*order).withColumn("__at", F.monotonically_increasing_id()))
    rows = rows.withColumn("__part", F.shiftright("__at", 33))
    sizes = rows.groupBy("__part").agg(F.count("*").alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select("__part", before.alias("__start"))
    inside = F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))
    return rows.join(starts, "__part").withColumn(name, F.col("__start") + inside).drop("__part", "__at", "__start")
