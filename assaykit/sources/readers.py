"""Sources of (ord, identifier, input_smiles): inline, line files and CSV files."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SCHEMA = "ord bigint, identifier string, input_smiles string"


def inline(spark: SparkSession, smiles: list[str], identifiers: list[str] | None = None) -> DataFrame:
    if identifiers is not None and len(identifiers) != len(smiles):
        raise ValueError(f"{len(identifiers)} identifiers for {len(smiles)} SMILES")
    names = identifiers or [str(i) for i in range(len(smiles))]
    return spark.createDataFrame([(i, n, s) for i, (n, s) in enumerate(zip(names, smiles, strict=True))], SCHEMA)


def _placed(raw: DataFrame) -> DataFrame:
    """Adds ``ord``: the row's place by file, block and row, so that files may be split; one row per block is what a single task sees."""
    at = raw.select("*", F.col("_metadata.file_path").alias("__file"), F.col("_metadata.file_block_start").alias("__block"), F.monotonically_increasing_id().alias("__at"))
    blocks = at.groupBy("__file", "__block").agg(F.min("__at").alias("__first"), F.count("*").alias("__n"))
    before = F.sum("__n").over(Window.orderBy("__file", "__block").rowsBetween(Window.unboundedPreceding, -1))
    starts = blocks.select("__file", "__block", "__first", F.coalesce(before, F.lit(0)).alias("__start"))
    return at.join(starts, ["__file", "__block"]).withColumn("ord", (F.col("__start") + F.col("__at") - F.col("__first")).cast("bigint")).drop("__file", "__block", "__at", "__first", "__start")


def _utf8(text: Column) -> Column:
    """The text; bytes that are not UTF-8 fail the query."""
    return F.when(~F.is_valid_utf8(text), F.raise_error(F.lit("the library is not UTF-8")).cast("string")).otherwise(text)


def lines(spark: SparkSession, path: str) -> DataFrame:
    """A line holds SMILES and perhaps an identifier (default: the raw line number); # starts a comment line."""
    raw = _placed(spark.read.text(path))
    kept = raw.withColumn("p", F.split(F.trim(F.regexp_replace(_utf8(F.col("value")), r"\s+", " ")), " ")).where((F.col("p")[0] != "") & ~F.col("p")[0].startswith("#"))
    return kept.select("ord", F.coalesce(F.try_element_at("p", F.lit(2)), F.col("ord").cast("string")).alias("identifier"), F.col("p")[0].alias("input_smiles"))


def _records(spark: SparkSession, path: str) -> DataFrame:
    """(record, header, text) of CSV files, records numbered by file and place without headers; line breaks inside quotes are part of a record.

    Files are split like any text. In each block every line gets the parity of the quotes before it
    in the block, and the number of records that have begun up to it, for both cases: that the block
    begins outside quotes or inside. Which case holds, and how many records came before, follows
    from a table of one row per block. Only lines of records that span several are shuffled. Blank
    lines between records are none. An open quote reaches to the end of its file.
    """
    raw = spark.read.option("lineSep", "\n").text(path)
    lines_ = raw.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, parity, n0, n1 = None, 0, 0, 0
        for batch in batches:
            quotes = pc.count_substring(batch.column(0), '"').to_numpy(zero_copy_only=False)
            blank = np.asarray(pc.is_in(batch.column(0), pa.array(["", "\r"])))
            place = list(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True))
            cut = [0, *(i for i in range(1, len(place)) if place[i] != place[i - 1]), len(place)]
            before, begun0, begun1 = (np.zeros(len(place), np.int64) for _ in range(3))
            for a, b in zip(cut[:-1], cut[1:], strict=True):
                if a < b and place[a] != here:
                    here, parity, n0, n1 = place[a], 0, 0, 0
                before[a:b] = (parity + np.cumsum(quotes[a:b]) - quotes[a:b]) % 2
                begun0[a:b] = n0 + np.cumsum((before[a:b] == 0) & ~blank[a:b])
                begun1[a:b] = n1 + np.cumsum((before[a:b] == 1) & ~blank[a:b])
                if a < b:
                    parity, n0, n1 = (parity + int(quotes[a:b].sum())) % 2, int(begun0[b - 1]), int(begun1[b - 1])
            cols = [*batch.columns, pa.array(quotes % 2, pa.int32()), pa.array(before, pa.int32()), pa.array(blank), pa.array(begun0), pa.array(begun1)]
            yield pa.RecordBatch.from_arrays(cols, names=[*batch.schema.names, "odd", "before", "blank", "begun0", "begun1"])

    seen = lines_.mapInArrow(run, "value string, file string, block bigint, at bigint, odd int, before int, blank boolean, begun0 bigint, begun1 bigint")
    blocks = seen.groupBy("file", "block").agg(F.sum("odd").alias("odd"), F.max("begun0").alias("n0"), F.max("begun1").alias("n1"))
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("inside", F.coalesce(F.sum("odd").over(earlier), F.lit(0)) % 2).withColumn("n", F.when(F.col("inside") == 0, F.col("n0")).otherwise(F.col("n1")))
    everywhere = Window.orderBy("file", "block")  # a row for each block
    blocks = blocks.withColumn("start", F.coalesce(F.sum("n").over(everywhere.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn("files", F.dense_rank().over(Window.orderBy("file")))
    blocks = blocks.select("file", "block", "inside", "start", F.first("start").over(Window.partitionBy("file").orderBy("block")).alias("first"), "files")
    placed = seen.join(blocks, ["file", "block"])
    begins = F.col("before") == F.col("inside")
    number = F.col("start") + F.when(F.col("inside") == 0, F.col("begun0")).otherwise(F.col("begun1")) - 1
    placed = placed.where(~(begins & F.col("blank"))).select((number - F.col("files")).alias("record"), (number == F.col("first")).alias("header"), "value", "at", (begins & (F.col("odd") == 0)).alias("whole"))
    whole = placed.where("whole").select("record", "header", F.col("value").alias("text"))
    several = placed.where(~F.col("whole")).groupBy("record", "header").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "value"))), lambda x: x["value"]), "\n").alias("text"))
    return whole.unionByName(several)


def csv(spark: SparkSession, path: str, smiles_column: str = "smiles", id_column: str | None = None) -> DataFrame:
    """Blank SMILES rows are skipped; a blank or absent identifier is the row number, skipped rows counted. Large files are read by many tasks."""
    names = spark.read.option("header", True).option("escape", '"').option("multiLine", True).csv(path).columns
    if smiles_column not in names:
        raise ValueError(f"no column {smiles_column!r}; the header is {names}")
    text = F.regexp_replace(_utf8(F.col("text")), "\r$", "")
    fields = F.from_csv(text, ", ".join(f"c{i} string" for i in range(len(names))), {"escape": '"', "multiLine": "true"})
    value = lambda name: F.trim(F.coalesce(F.col(f"f.c{names.index(name)}"), F.lit("")))
    rows = _records(spark, path).where(~F.col("header")).select(F.col("record").alias("ord"), fields.alias("f"))
    rows = rows.select("ord", (value(id_column) if id_column in names else F.lit("")).alias("identifier"), value(smiles_column).alias("input_smiles")).where("input_smiles <> ''")
    return rows.withColumn("identifier", F.coalesce(F.nullif("identifier", F.lit("")), F.col("ord").cast("string")))


def size_of(spark: SparkSession, path: str) -> int:
    """Bytes under a path of any file system that Spark reads."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(where).getLength()


def read_library(spark: SparkSession, path: str, max_bytes: int | None = None, **csv_options) -> DataFrame:
    """By the name's ending; more than ``max_bytes`` is an error."""
    if max_bytes is not None and size_of(spark, path) > max_bytes:
        raise ValueError(f"the library has more than {max_bytes} bytes")
    return csv(spark, path, **csv_options) if path.lower().endswith(".csv") else lines(spark, path)
