"""The per-molecule kernel on streams of library rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..plans.triage import describe
from ..sources.readers import SCHEMA


def read_stream(spark: SparkSession, path: str) -> DataFrame:
    """Rows (ord, identifier, input_smiles) of Parquet files that arrive in a folder."""
    return spark.readStream.schema(SCHEMA).parquet(path)


def describe_stream(library: DataFrame, out: str, checkpoint: str, standardize: bool = True) -> StreamingQuery:
    """Describes what has arrived and appends it to ``out``; exactly once through the checkpoint."""
    rows = describe(library, standardize)
    return rows.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).outputMode("append").start()
