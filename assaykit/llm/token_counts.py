"""Token counts as delta-maintained rollups.

Totals by source, language and tokenizer version are additive. A batch of changes is
a table of signed rows: an insert is a row with sign 1, a delete the old row with sign
-1, a revision both. Each batch is counted once, summed to its signed deltas (partial
sums before the shuffle, so a hot source is a few rows), written to a staging folder, and
made visible by one rename to ``deltas/<batch>``, which fails where that exists. A batch
that is committed again, or by two drivers at once, therefore counts once; a batch
that dies leaves nothing visible. ``totals`` sums the committed deltas. ``compact`` sums
them into a base, published by a rename as well, and empties the folders of batches that the
base before it held already; the folders themselves stay, so that a batch keeps counting once.
Readers take the latest base and the deltas that it does not hold, and look again where the base
has changed meanwhile; what they have read stays until the second compaction after. A frame of
``totals`` that is older than that fails with a missing file and is never short of a batch. Renames
must be atomic on the file system used, as they are on HDFS and local disks.

Cases: null texts have no tokens but count as documents; null sources and languages
are groups of their own; repeated rows count as often as they occur; an empty batch
commits and changes nothing; extra columns are ignored; groups whose documents are all
gone have no row.
"""

from __future__ import annotations

import base64
import importlib.util
import uuid
from collections.abc import Callable, Iterator
from functools import lru_cache
from urllib.parse import quote, unquote

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .kernels import Words, buffers

KEYS = ("source", "lang", "tokenizer")


@lru_cache(maxsize=4)
def _byte_bpe(ranks: bytes, pattern: str):
    import tiktoken

    table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
    return tiktoken.Encoding("counted", pat_str=pattern, mergeable_ranks=table, special_tokens={})


def words_tokenizer() -> Callable[[pa.Array], np.ndarray]:
    """Counts runs of bytes other than ASCII white space."""

    def count(column: pa.Array) -> np.ndarray:
        return Words(*buffers(column), hashes=False).counts

    return count


def byte_bpe_tokenizer(folder: str, name: str) -> Callable[[pa.Array], np.ndarray]:
    """Counts tokens of a byte-level BPE given as ranks; the file is read on the driver and shipped."""
    spec = importlib.util.spec_from_file_location("tokenizer_folder", f"{folder}/__init__.py")
    module = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(module)
    with open(f"{folder}/{name}", "rb") as f:
        ranks = f.read()
    pattern = module.PATTERN

    def count(column: pa.Array) -> np.ndarray:
        encoding = _byte_bpe(ranks, pattern)
        return np.array([len(encoding.encode_ordinary(t)) if t else 0 for t in column.to_pylist()], np.int64)

    return count


def deltas(changes: DataFrame, tokenizers: dict[str, Callable[[pa.Array], np.ndarray]]) -> DataFrame:
    """Signed sums (source, lang, tokenizer, n_docs, n_tokens) of rows with source, lang, text, sign."""
    names = list(tokenizers)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name in names:
                n = pa.array(tokenizers[name](batch.column(3)), pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array([name] * batch.num_rows), n], names=["source", "lang", "sign", "tokenizer", "n"])

    rows = changes.select("source", "lang", F.col("sign").cast("long"), "text").mapInArrow(run, "source string, lang string, sign bigint, tokenizer string, n bigint")
    return rows.groupBy(*KEYS).agg(F.sum("sign").alias("n_docs"), F.sum(F.col("sign") * F.col("n")).alias("n_tokens"))


class TokenRollup:
    """Rollup whose batches live under ``path``, a folder that driver and executors share."""

    SCHEMA = "source string, lang string, tokenizer string, n_docs bigint, n_tokens bigint"

    def __init__(self, spark: SparkSession, path: str, tokenizers: dict[str, Callable[[pa.Array], np.ndarray]]):
        self.spark, self.path, self.tokenizers = spark, path, tokenizers
        jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(path).getFileSystem(conf)
        for name in ("deltas", "bases", "staging"):
            self._fs.mkdirs(self._path(f"{path}/{name}"))
        self._context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), conf)
        self._no_options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)

    def _names(self, folder: str) -> list[str]:
        return [s.getPath().getName() for s in self._fs.listStatus(self._path(f"{self.path}/{folder}"))]

    def _publish(self, staged: str, to: str) -> bool:
        """Renames a staged folder; False, and the folder gone, where the name is taken."""
        source, target = self._path(staged), self._path(f"{self.path}/{to}")
        try:
            self._context.rename(source, target, self._no_options)
            return True
        except Exception:  # noqa: BLE001  py4j has one class for all of them
            self._fs.delete(source, True)
            if not self._fs.exists(target):
                raise
            return False

    def committed(self) -> list[str]:
        """Ids of the batches that count."""
        return sorted(unquote(n) for n in self._names("deltas"))

    def commit(self, batch_id: str, changes: DataFrame) -> bool:
        """Applies a batch; False if it was committed before."""
        name = quote(batch_id, safe="")
        if not name or self._fs.exists(self._path(f"{self.path}/deltas/{name}")):
            if name:
                return False
            raise ValueError("a batch needs an id")
        staged = f"{self.path}/staging/{uuid.uuid4().hex}"
        deltas(changes, self.tokenizers).write.parquet(staged)
        return self._publish(staged, f"deltas/{name}")

    def _last(self) -> int:
        return max((int(n) for n in self._names("bases")), default=0)

    def _held(self, base: int) -> set[str]:
        """Folders of the batches that a base holds; a name per commit."""
        return {r.name for r in self.spark.read.schema("name string").parquet(f"{self.path}/bases/{base}/batches").collect()} if base else set()

    def _base(self) -> tuple[int, set[str]]:
        """Number of the latest base (0: none) and the folders of the batches it holds."""
        last = self._last()
        return last, self._held(last)

    def _rows(self) -> tuple[DataFrame, int, set[str], list[str]]:
        while True:
            last, held = self._base()
            fresh = [n for n in self._names("deltas") if n not in held]
            folders = [f"{self.path}/bases/{last}/totals"] * (last > 0) + [f"{self.path}/deltas/{n}" for n in fresh]
            # the files are listed here
            rows = self.spark.read.schema(self.SCHEMA).parquet(*folders) if folders else self.spark.createDataFrame([], self.SCHEMA)
            if self._last() == last:
                break
        return rows.groupBy(*KEYS).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens")).where("n_docs <> 0 OR n_tokens <> 0"), last, held, fresh

    def totals(self) -> DataFrame:
        return self._rows()[0]

    def compact(self) -> bool:
        """Sums all committed deltas into a new base; False if there are none, or another driver was first."""
        totals, last, held, fresh = self._rows()
        if not fresh:
            return False
        staged = f"{self.path}/staging/{uuid.uuid4().hex}"
        totals.write.parquet(f"{staged}/totals")
        self.spark.createDataFrame([(n,) for n in sorted(held | set(fresh))], "name string").coalesce(1).write.parquet(f"{staged}/batches")
        if not self._publish(staged, f"bases/{last + 1}"):
            return False
        # readers of the last base still need what it lacks
        for name in held - self._held(last - 1) if last else ():
            for status in self._fs.listStatus(self._path(f"{self.path}/deltas/{name}")):
                self._fs.delete(status.getPath(), True)
        return True
