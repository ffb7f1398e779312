"""Tables that cut lineage, in the shared folder of the session's ``spark.checkpoint.dir``."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The cluster's checkpoint folder; a fresh local one only where none is set (local mode, tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp())
        found = spark.sparkContext.getCheckpointDir()
    return found


class Scratch:
    """A folder of its own for one call; ``table`` writes a frame as Parquet and reads it back."""

    def __init__(self, spark: SparkSession):
        self.spark, self.dir, self.n = spark, f"{shared_dir(spark)}/tables-{uuid.uuid4().hex}", 0

    def table(self, df: DataFrame) -> DataFrame:
        self.n += 1
        path = f"{self.dir}/{self.n}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        # shuffle files of what has just been written go only when the driver collects its garbage
        del df
        gc.collect()
        self.spark._jvm.System.gc()
        return out

    def drop(self, df: DataFrame) -> None:
        """Removes a table that nothing reads any more."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(df._scratch_path)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
