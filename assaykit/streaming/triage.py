"""Triage of records that keep arriving: the kernel and filters on each batch, duplicates against all that was kept before."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..plans.triage import TriageConfig, describe, finalize
from ..sources.shared import Tables
from .register import register_batch


def triage_batch(batch: DataFrame, epoch: int, path: str, config: TriageConfig) -> dict[str, int]:
    """Registers a batch of (ord, identifier, input_smiles) under ``path`` and returns its counts.

    Rows that parse and that no filter drops are keyed by their standard text; the first of a key, in this batch or an
    earlier one, is new and scored, the others are duplicates of it. Rows without a key are registered as
    empty, with their parse_error or drop_reason. A batch that is done again replaces what it wrote.
    """
    alone = replace(config, deduplicate=False, cluster=False, representatives_only=False, top_n=None)
    table = Tables(batch.sparkSession)
    try:
        described = table(describe(batch, config.standardize, config.alert_catalogs, config.fingerprint_radius, config.fingerprint_bits))
        rows = finalize(described, alone, table).drop("duplicate_of", "cluster_id", "is_cluster_representative", "fingerprint")
        live = F.col("parse_ok") & F.col("drop_reason").isNull()
        return register_batch(rows.withColumn("key", F.when(live, F.nullif("standard_smiles", F.lit("")))), epoch, path)
    finally:
        table.drop()


def triage_stream(library: DataFrame, path: str, checkpoint: str, config: TriageConfig = TriageConfig(), seen: Callable[[int, dict[str, int]], None] = lambda epoch, counts: None) -> StreamingQuery:
    """Registers all that has arrived since the checkpoint, batch by batch, and ends."""

    def run(batch: DataFrame, epoch: int) -> None:
        seen(epoch, triage_batch(batch, epoch, path, config))

    return library.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
