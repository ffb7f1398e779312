"""Sinks of reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def json_lines(df: DataFrame) -> DataFrame:
    """One JSON object per row in ``value``, nulls included."""
    return df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value"))


def write_json_lines(df: DataFrame, path: str) -> None:
    json_lines(df).write.text(path)


def write_pages(df: DataFrame, path: str, rows_per_file: int = 50_000) -> int:
    """Rows with a dense ``rank`` from 0, a file for each ``rows_per_file`` of them, and a manifest; returns their number.

    The manifest (total, rows_per_file) is written last, with a total that was counted
    while the rows were written: a page is then a look into at most two known files.
    """
    if rows_per_file < 1000:
        raise ValueError("rows_per_file must be at least 1000, the most rows of a page")
    spark, total = df.sparkSession, Observation("total")
    part = F.floor(F.col("rank") / rows_per_file)
    placed = df.withColumn("part", part).repartition("part").sortWithinPartitions("part", "rank")
    placed.observe(total, F.count("*").alias("n")).write.mode("overwrite").partitionBy("part").parquet(f"{path}/rows")
    n = total.get["n"]
    spark.createDataFrame([(n, rows_per_file)], "total bigint, rows_per_file bigint").coalesce(1).write.mode("overwrite").json(f"{path}/manifest")
    return n


def read_manifest(spark: SparkSession, path: str) -> tuple[int, int]:
    """(total, rows per file)."""
    return tuple(spark.read.schema("total bigint, rows_per_file bigint").json(f"{path}/manifest").first())


def read_page(spark: SparkSession, path: str, offset: int, limit: int) -> tuple[DataFrame | None, int]:
    """Rows offset to offset + limit - 1 in order, from the files that hold them, and the total; None where there are none."""
    if not 1 <= limit <= 1000 or offset < 0:
        raise ValueError("limit must be 1 to 1000 and offset at least 0")
    total, size = read_manifest(spark, path)
    end = min(offset + limit, total)
    if offset >= end:
        return None, total
    rows = spark.read.parquet(*(f"{path}/rows/part={k}" for k in range(offset // size, (end - 1) // size + 1)))
    return rows.where((F.col("rank") >= offset) & (F.col("rank") < end)).orderBy("rank"), total
