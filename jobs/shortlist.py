"""Shortlist of a text library: ``python -m jobs.shortlist DOCUMENTS OUTPUT [--config FILE]``.

The batch triage of submitted records, for texts: descriptors, descriptor windows, alert
patterns, duplicates of earlier submissions, a score, and the ``top_n`` best of each language.
Nothing is lost on the way: every record is in the output with its status

    shortlisted | below_cut | duplicate | dropped_by_window | dropped_by_alert

as Parquet under ``OUTPUT``, partitioned by language and status, so that a reader of one
shortlist opens that folder only. The whole output is replaced by each run, and a run over the
same input writes the same rows. Texts are read once and don't go through a shuffle, but for an input of
fewer partitions than cores, which is spread first. A text that occurs very
often is no hot spot: its first record is found by partial minima, and the join that brings it
back can be split. Ranks come from a window whose limit Spark applies before the shuffle.

A null or empty text has no words, so the window on ``n_words`` drops it; a null language is a
partition of its own, shared with an empty one; rows with equal doc_id and text are not told
apart: they have one rank or are duplicates together. Without any record the output is empty.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark import StorageLevel
from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from assaykit.functions import rules as R
from assaykit.operators import selection as S
from assaykit.plans.triage import spread

from .config import LOG, command_line

SPACE = r"[ \t\n\x0B\f\r]+"
OUTPUT = ["doc_id", "source", "lang", "n_words", "symbol_share", "alerts", "status", "duplicate_of", "score", "rank"]


@dataclass(frozen=True)
class ShortlistConfig:
    """Inclusive windows of n_words, n_chars and symbol_share (null: no bound); alert patterns, and which of them drop a record; the score's centre and width."""

    windows: dict[str, list] = field(default_factory=dict)
    alerts: dict[str, str] = field(default_factory=dict)
    drop_alerts: list[str] = field(default_factory=list)
    centre_words: float = 300
    width: float = 1.5
    top_n: int = 100

    def __post_init__(self) -> None:
        unknown = [a for a in self.drop_alerts if a not in self.alerts]
        if unknown:
            raise KeyError(f"no pattern for alerts: {', '.join(unknown)}")
        unknown = sorted(set(self.windows) - {"n_words", "n_chars", "symbol_share"})
        if unknown:
            raise KeyError(f"no descriptor for windows: {', '.join(unknown)}")
        if self.top_n < 1 or self.width <= 0 or self.centre_words <= 0:
            raise ValueError("top_n, width and centre_words must be above 0")


def described(docs: DataFrame) -> DataFrame:
    """Adds n_chars, n_words, symbol_share and the key under which equal texts meet (case of A-Z and white space apart)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    # lower() is several times faster than translate(), and the same where there is nothing but ASCII
    low = F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    plain = F.trim(F.regexp_replace(low, SPACE, " "))
    symbols = F.length(text) - F.length(F.translate(text, "#*$%&|<>", ""))
    return docs.select("*", F.length(text).alias("n_chars"), F.regexp_count(text, F.lit(SPACE.replace("[", "[^"))).alias("n_words"),
        (symbols / F.greatest(F.length(text), F.lit(1))).alias("symbol_share"), F.sha2(plain.cast("binary"), 256).alias("key"))


def read(docs: DataFrame, config: ShortlistConfig) -> DataFrame:
    """Every record with all that is taken from its text, without it."""
    found = F.array_compact(F.array(*(F.when(F.col("text").rlike(p), F.lit(name)) for name, p in config.alerts.items())).cast("array<string>"))
    return described(docs).select("doc_id", "source", "lang", "n_chars", "n_words", "symbol_share", "key", found.alias("alerts"))


def judged(docs: DataFrame, config: ShortlistConfig) -> DataFrame:
    """Every record with its alerts, drop_reason, duplicate_of, score and the columns that are counted; without its text."""
    return weighed(read(docs, config), config)


def weighed(rows: DataFrame, config: ShortlistConfig) -> DataFrame:
    """``judged`` for the rows of ``read``."""
    dropping = F.size(F.array_intersect("alerts", F.array(*map(F.lit, config.drop_alerts)).cast("array<string>")))
    rows = rows.withColumn("drop_reason", R.drop_reason({k: tuple(v) for k, v in config.windows.items()}, None, dropping)).withColumn("parse_ok", F.lit(True))
    rows = S.deduplicate(rows.withColumn("key", F.when(F.col("drop_reason").isNull(), F.col("key"))), "key", "doc_id", "doc_id")
    far = (F.ln(F.greatest("n_words", F.lit(1))) - F.ln(F.lit(float(config.centre_words)))) / config.width
    score = F.exp(-far * far / 2) / (1 + F.size("alerts")) / (1 + 10 * F.col("symbol_share"))
    return rows.withColumn("score", F.when(F.col("drop_reason").isNull() & F.col("duplicate_of").isNull(), F.round(score, 9)))


def shortlist(spark: SparkSession, documents: str, output: str, config: ShortlistConfig) -> dict[str, int]:
    """Writes the output and returns the counts, which Spark takes while it writes."""
    docs = spread(spark.read.parquet(documents).select("doc_id", "source", "lang", "text"))
    # dedup takes its rows twice; texts are worked on once
    facts = read(docs, config).persist(StorageLevel.MEMORY_AND_DISK)
    rows, counts = weighed(facts, config).persist(StorageLevel.MEMORY_AND_DISK), Observation("counts")
    try:
        order = Window.partitionBy("lang").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
        # ids may repeat, so ranks are joined on all that they depend on
        best = rows.where(F.col("score").isNotNull()).select("lang", "score", "doc_id").distinct().withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= config.top_n)
        best = best.select(F.col("lang").alias("__lang"), F.col("score").alias("__score"), F.col("doc_id").alias("__id"), "rank")
        same = F.col("lang").eqNullSafe(F.col("__lang")) & (F.col("score") == F.col("__score")) & F.col("doc_id").eqNullSafe(F.col("__id"))
        status = F.coalesce(F.col("drop_reason"), F.when(F.col("duplicate_of").isNotNull(), "duplicate").when(F.col("rank").isNotNull(), "shortlisted").otherwise("below_cut"))
        out = rows.join(best, same, "left").withColumn("status", status)
        # files of even size: hot languages are split, small ones put together
        out = out.hint("rebalance", "lang", "status").observe(counts, *S.count_columns())
        out.withColumn("alerts", F.array_join("alerts", ",")).select(*OUTPUT).write.mode("overwrite").partitionBy("lang", "status").parquet(output)
    finally:
        rows.unpersist()
        facts.unpersist()
    got = counts.get
    LOG.info("read %d records of %s", got["submitted"], documents)
    LOG.info("wrote %s: %s", output, ", ".join(f"{k} {v}" for k, v in got.items()))
    return got


if __name__ == "__main__":
    command_line("shortlist", __doc__.split("\n")[0], ShortlistConfig, ["documents", "output"], shortlist)
