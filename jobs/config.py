"""Config files and logs of the jobs."""

from __future__ import annotations

import argparse
import json
import logging
from collections.abc import Callable
from dataclasses import fields
from pathlib import Path
from typing import Any

from pyspark.sql import SparkSession

LOG = logging.getLogger("assaykit.jobs")


def read_config(kind: type, path: str | Path) -> Any:
    """``kind`` (a dataclass) from a JSON object; names that are not known are errors."""
    given = json.loads(Path(path).read_text(encoding="utf-8"))
    unknown = sorted(set(given) - {f.name for f in fields(kind)})
    if unknown:
        raise KeyError(f"unknown settings in {path}: {', '.join(unknown)}")
    return kind(**given)


def command_line(name: str, description: str, kind: type, paths: list[str], run: Callable, args: list[str] | None = None) -> None:
    """Runs ``run(session, *paths, config)`` in a session of its own, which ends with it."""
    parser = argparse.ArgumentParser(prog=f"python -m jobs.{name}", description=description)
    for p in paths:
        parser.add_argument(p)
    parser.add_argument("--config", default=str(Path(__file__).with_name(f"{name}.json")), help="a JSON file; default: %(default)s")
    given = parser.parse_args(args)
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(levelname)s %(name)s %(message)s")
    spark = SparkSession.builder.appName(f"assaykit {name}").getOrCreate()
    try:
        run(spark, *(getattr(given, p) for p in paths), read_config(kind, given.config))
    finally:
        spark.stop()
