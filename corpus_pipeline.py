"""The corpus pipeline: quality rules, near-duplicate groups, repeated passages, benchmark leaks, tokens.

Each stage takes (spark, docs, sf_dir) and works on all rows that its predecessor kept;
all but the last return the columns of ``documents``. Decisions hold for rows, not for
ids: a row is known by its file and its place there, so repeated and null ids do no harm.
``docs`` that are no files are written first. Of near duplicates the row with the
smallest doc_id stays, then the first in the files; rows without an id come last. Columns
keep their values whatever their names, but for ``n_chars``, which follows the text, and
in the last stage for those named as its outputs.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assaykit.llm.decontaminate import decontaminate
from assaykit.llm.ngram_jaccard import ngram_jaccard
from assaykit.llm.quality_rules import quality_rules
from assaykit.llm.queries import TOKENIZERS
from assaykit.llm.scratch import Scratch
from assaykit.llm.sentencepiece_unigram import sentencepiece
from assaykit.llm.suffix_dedup import suffix_dedup


def _safe(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` with names for the other columns that no operator uses, and what they were."""
    names = {f"c{i}_": c for i, c in enumerate(docs.columns) if c not in ("doc_id", "text")}
    return docs.select(*(F.col(f"`{c}`") for c in ("doc_id", "text")), *(F.col(f"`{c}`").alias(k) for k, c in names.items())), names


def _back(out: DataFrame, names: dict[str, str], columns: list[str]) -> DataFrame:
    """The columns of ``documents`` again, in their order."""
    now = {c: k for k, c in names.items()}
    return out.select(*(F.col(f"`{now.get(c, c)}`").alias(c) for c in columns))


def _rows(spark: SparkSession, docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``docs``, and the same with doc_id as (no id, id, file, place in the file), which no other row has."""
    key = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))
    # as Arrow has them: all fields may be null
    key = key.cast(f"struct<none:boolean,doc_id:{dict(docs.dtypes)['doc_id']},file:string,row:bigint>")
    try:
        return docs, docs.select("*", key.alias("key_"))
    except AnalysisException:  # no scan of Parquet files
        docs = Scratch(spark).table(docs)
        return docs, docs.select("*", key.alias("key_"))


def _without(keyed: DataFrame, gone: DataFrame, columns: list[str]) -> DataFrame:
    """Rows whose key is not in ``gone`` (key)."""
    out = gone.select(F.col("key.file").alias("file_"), F.col("key.row").alias("row_"))
    same = (F.col("key_.file") == F.col("file_")) & (F.col("key_.row") == F.col("row_"))
    return keyed.join(out, same, "left_anti").select(*(F.col(f"`{c}`") for c in columns))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents that pass the quality rules."""
    safe, names = _safe(docs)
    return _back(quality_rules(safe).where("kept"), names, docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps of each group of near duplicates the row with the smallest key."""
    docs, keyed = _rows(spark, docs)
    groups = ngram_jaccard(keyed.select(F.col("key_").alias("doc_id"), "text"))
    return _without(keyed, groups.where("component_id <> doc_id").select(F.col("doc_id").alias("key")), docs.columns)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes out passages of 50 bytes or more that an earlier document has; drops what is then blank."""
    safe, names = _safe(docs)
    out = suffix_dedup(safe, outputs=("kept_text",)).withColumnRenamed("kept_text", "text")
    out = _back(out.where("trim(text) <> ''"), names, docs.columns)
    return out.withColumn("n_chars", F.length("text").cast(dict(docs.dtypes)["n_chars"])) if "n_chars" in docs.columns else out


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a window of a benchmark item."""
    docs, keyed = _rows(spark, docs)
    found = decontaminate(keyed.select(F.col("key_").alias("doc_id"), "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return _without(keyed, found.where("contaminated").select(F.col("doc_id").alias("key")), docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Adds piece ids and replaces the text by what they decode to."""
    out = sentencepiece(docs, f"{TOKENIZERS}/piece_bpe_32k.model", outputs=("ids", "n_tokens", "decoded", "round_trip"))
    return out.withColumn("text", F.col("decoded")).drop("decoded")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality), ("ngram_jaccard", near_duplicates), ("suffix_dedup", repeated_passages), ("decontaminate", benchmark_leaks), ("sentencepiece", tokens),
]
#: SQL can't express the last stage; tests/llm/test_pipeline.py holds all stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again."""
    scratch = Scratch(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = scratch.table(stage(spark, docs, sf_dir))
    return docs


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {}
