"""Duplicates across arrivals: each batch of a stream against all that was registered before it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.selection import deduplicate


def register_batch(batch: DataFrame, epoch: int, path: str) -> dict[str, int]:
    """Registers the rows (key, ord, identifier, ...) of one batch under ``path``; returns their counts.

    Adds ``duplicate_of`` and the partition columns ``epoch`` and ``status``. The first row of a
    key is the one with the smallest ``ord`` of the earliest batch that has the key; rows
    without a key are registered as empty. Only earlier batches are looked at, and only this batch's
    partitions are replaced, so a batch that is done again gives what it gave before.
    """
    spark, rows = batch.sparkSession, deduplicate(batch)
    if epoch > 0:
        kinds = {f.name: f.dataType.simpleString() for f in batch.schema}
        known = spark.read.schema(f"key {kinds['key']}, identifier {kinds['identifier']}, duplicate_of {kinds['identifier']}, epoch long, status string").parquet(path)
        # the batch's keys go to the register, which is large, and not the other way; one row a key
        # is new there unless a batch has equal ord twice
        wanted = batch.where(F.col("key").isNotNull()).select("key").distinct()
        earlier = known.where((F.col("epoch") < epoch) & (F.col("status") == "new")).join(wanted, "key", "leftsemi").groupBy("key").agg(F.min(F.struct("epoch", "identifier")).alias("__f"))
        rows = rows.join(earlier, "key", "left").withColumn("duplicate_of", F.coalesce(F.col("__f.identifier"), F.col("duplicate_of"))).drop("__f")
    status = F.when(F.col("key").isNull(), "empty").when(F.col("duplicate_of").isNotNull(), "duplicate").otherwise("new")
    counts = Observation(f"register-{epoch}")
    out = rows.select(*batch.columns, "duplicate_of", F.lit(epoch).cast("long").alias("epoch"), status.alias("status"))
    out = out.hint("rebalance", "status").observe(counts, F.count("*").alias("submitted"), *(F.count_if(F.col("status") == s).alias(s) for s in ("new", "duplicate", "empty")))
    out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("epoch", "status").parquet(path)
    return counts.get


def register_stream(rows: DataFrame, path: str, checkpoint: str, seen: Callable[[int, dict[str, int]], None] = lambda epoch, counts: None) -> StreamingQuery:
    """Registers all that has arrived since the checkpoint, batch by batch, and ends; ``seen`` gets each batch's counts."""

    def run(batch: DataFrame, epoch: int) -> None:
        seen(epoch, register_batch(batch, epoch, path))

    return rows.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
