"""``python -m assaykit LIBRARY REPORT [--config FILE]``: triage of a .smi or .csv file into JSON lines and counts."""

from __future__ import annotations

import argparse
import json

from pyspark.sql import SparkSession

from .plans.jobs import Settings
from .plans.triage import TriageConfig, triage
from .sources.readers import read_library
from .sources.sinks import write_json_lines


config_of = TriageConfig.from_json


def main(args: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="assaykit", description=__doc__)
    parser.add_argument("library")
    parser.add_argument("report")
    parser.add_argument("--config", help="a JSON file with fields of TriageConfig")
    parser.add_argument("--smiles-column", default="smiles")
    parser.add_argument("--id-column")
    given = parser.parse_args(args)
    config = TriageConfig()
    if given.config:
        with open(given.config, encoding="utf-8") as f:
            config = config_of(f.read())
    spark = SparkSession.builder.appName("assaykit").getOrCreate()
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder and spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(folder)
    options = {"smiles_column": given.smiles_column, "id_column": given.id_column} if given.library.lower().endswith(".csv") else {}
    report, counts = triage(read_library(spark, given.library, Settings.from_env().max_file_bytes, **options), config)
    write_json_lines(report, given.report)
    print(json.dumps(counts.first().asDict()))


if __name__ == "__main__":
    main()
