"""Intake of records that arrive in a folder: ``python -m jobs.intake ARRIVALS REGISTER CHECKPOINT [--config FILE]``.

A file stream with a checkpoint: each run registers the files that came since the last one
and ends. A record whose text (case of A-Z and white space apart) was registered before, by
this or an earlier run, is a duplicate and names the record that came first, for good:
later arrivals never change what is written. Within one batch the smaller doc_id came first.

``ARRIVALS`` is a folder of Parquet files or a pattern of paths. ``REGISTER`` is Parquet, partitioned by the batch's number and by status (new, duplicate,
empty). A batch that is repeated after a failure replaces its own partitions with the same
rows. Earlier records are looked up by a join on the text's digest; only partitions with
status new are read for it, and of them two columns.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import SparkSession

from assaykit.streaming.register import register_stream

from .config import LOG, command_line
from .shortlist import described


@dataclass(frozen=True)
class IntakeConfig:
    """``max_files_per_run``: files of one batch (null: all that there are)."""

    max_files_per_run: int | None = None


def intake(spark: SparkSession, arrivals: str, register: str, checkpoint: str, config: IntakeConfig = IntakeConfig()) -> dict[str, int]:
    """Registers what is new and waits for the stream to end; returns how many records were read and how they were registered."""
    schema = spark.read.parquet(arrivals).select("doc_id", "source", "lang", "text").schema
    reader = spark.readStream.schema(schema)
    if config.max_files_per_run is not None:
        reader = reader.option("maxFilesPerTrigger", config.max_files_per_run)
    rows = described(reader.parquet(arrivals))
    rows = rows.selectExpr("doc_id AS identifier", "doc_id AS ord", "source", "lang", "n_words", "IF(n_words > 0, key, NULL) AS key")
    totals: dict[str, int] = {"submitted": 0, "new": 0, "duplicate": 0, "empty": 0}

    def seen(epoch: int, counts: dict[str, int]) -> None:
        LOG.info("batch %d: read %d records of %s; wrote %s", epoch, counts["submitted"], arrivals, ", ".join(f"{k} {v}" for k, v in counts.items()))
        for k, v in counts.items():
            totals[k] += v

    query = register_stream(rows, register, checkpoint, seen)
    query.awaitTermination()
    LOG.info("%s: %s", register, ", ".join(f"{k} {v}" for k, v in totals.items()))
    return totals


if __name__ == "__main__":
    command_line("intake", __doc__.split("\n")[0], IntakeConfig, ["arrivals", "register", "checkpoint"], intake)
