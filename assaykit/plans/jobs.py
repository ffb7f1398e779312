"""Triage jobs: submit, state, results by page, cancel."""

from __future__ import annotations

import os
import re
import threading
import uuid
from collections.abc import Mapping
from dataclasses import dataclass, fields, replace

from pyspark import InheritableThread
from pyspark.sql import DataFrame, SparkSession

from ..kernel import parse, write
from ..sources.readers import read_library
from ..sources.sinks import read_page
from .store import CANCELLED, FAILED, MAX_NAME, PENDING, RUNNING, SUCCEEDED, TERMINAL, Job, JobNotFoundError, JobStore, MemoryStore, Progress
from .triage import TriageConfig, describe, finalize, standardised, write_report

__all__ = ["CANCELLED", "FAILED", "PENDING", "RUNNING", "SUCCEEDED", "TERMINAL", "Job", "JobNotFoundError", "JobStateError", "Progress", "Settings", "TooLargeError", "TriageEngine", "origin"]


class JobStateError(RuntimeError):
    """The job's state does not allow the request."""


class TooLargeError(ValueError):
    """More rows than a direct call may have; submit a job instead."""


@dataclass(frozen=True)
class Settings:
    """Limits of an engine; ``from_env`` reads ASSAYKIT_MAX_LIBRARY_SIZE and the like."""

    max_library_size: int = 250_000
    max_direct_rows: int = 100
    max_file_bytes: int = 64 << 20

    @classmethod
    def from_env(cls, env: Mapping[str, str] = os.environ) -> Settings:
        found = {f.name: int(env[name]) for f in fields(cls) if (name := f"ASSAYKIT_{f.name.upper()}") in env}
        return cls(**found)


def origin(error: BaseException) -> str:
    """The error that a worker or an expression raised, without what Spark wraps around it."""
    text = str(error).strip()
    if raised := re.search(r"\[USER_RAISED_EXCEPTION\] (.*?)(?: SQLSTATE: \w+)?(?:\n|$)", text):
        return raised.group(1)
    in_worker = re.findall(r"^(?:\w+\.)*(\w+(?:Error|Exception|Interrupt): .*)$", text, re.M) if "Traceback (most recent call last)" in text else []
    return in_worker[-1] if in_worker else f"{type(error).__name__}: {text.splitlines()[0] if text else ''}"


class TriageEngine:
    """Runs jobs in threads of one session; jobs and their reports are in a store, by default one of this process under ``path``."""

    def __init__(self, spark: SparkSession, path: str, max_library_size: int | None = None, settings: Settings | None = None, store: JobStore | None = None):
        self.spark, self.settings, self.store = spark, settings or Settings(), store or MemoryStore(spark, path)
        self.max_library_size = max_library_size or self.settings.max_library_size
        self._threads: dict[str, InheritableThread] = {}
        self._lock = threading.Lock()

    def submit(self, library: DataFrame, config: TriageConfig = TriageConfig(), name: str = "") -> str:
        if len(name) > MAX_NAME:
            raise ValueError(f"a name has at most {MAX_NAME} characters")
        n = library.limit(self.max_library_size + 1).count()
        if not n:
            raise ValueError("the library is empty")
        if n > self.max_library_size:
            raise TooLargeError(f"more than {self.max_library_size} records")
        job = Job(uuid.uuid4().hex, name, config)
        self.store.create(job)
        self.store.update_progress(job.id, Progress(molecules_total=n))
        with self._lock:
            self._threads[job.id] = InheritableThread(target=self._run, args=(job.id, library, n))
            self._threads[job.id].start()
        return job.id

    def submit_path(self, path: str, config: TriageConfig | str = TriageConfig(), name: str | None = None, **csv_options) -> str:
        """A job over a .smi or .csv file, named like the file unless ``name`` says otherwise; ``config`` may be JSON."""
        config = TriageConfig.from_json(config) if isinstance(config, str) else config
        library = read_library(self.spark, path, self.settings.max_file_bytes, **csv_options)
        return self.submit(library, config, path.rstrip("/").rsplit("/", 1)[-1] if name is None else name)

    def _direct(self, library: DataFrame) -> DataFrame:
        n = library.limit(self.settings.max_direct_rows + 1).count()
        if n > self.settings.max_direct_rows:
            raise TooLargeError(f"more than {self.settings.max_direct_rows} rows")
        if not n:
            raise ValueError("the library is empty")
        return library

    def describe(self, library: DataFrame, config: TriageConfig = TriageConfig()) -> DataFrame:
        """Few rows at once: the kernel's columns and the rules, without filters, clusters or scores."""
        rows = describe(self._direct(library), config.standardize, config.alert_catalogs, config.fingerprint_radius, config.fingerprint_bits)
        plain = replace(config, descriptor_windows={}, drop_rule_failures=False, drop_alert_hits=False, deduplicate=False, cluster=False, representatives_only=False)
        out = finalize(rows, plain, lambda x: x)
        return out.select(*(c for c in out.columns if c not in ("fingerprint", "score", "score_breakdown", "drop_reason", "duplicate_of", "cluster_id", "is_cluster_representative"))).orderBy("ord")

    def standardize(self, library: DataFrame) -> DataFrame:
        """Few rows at once: (input_smiles, standard_smiles, error) in order."""
        return standardised(self._direct(library)).orderBy("ord").select("input_smiles", "standard_smiles", "error")

    def health(self) -> dict[str, object]:
        """Whether the session is alive and the kernel does its work."""
        alive = self.spark.sparkContext._jsc is not None and not self.spark.sparkContext._jsc.sc().isStopped()
        kernel = write(parse("OCC")) == write(parse("CCO"))
        return {"status": "ok" if alive and kernel else "degraded", "session": alive, "kernel": kernel}

    def progress(self, job_id: str) -> Progress:
        """The phase and its molecules, and the tasks done and known of the job's Spark jobs in this session."""
        job, tracker = self.get(job_id), self.spark.sparkContext.statusTracker()
        stages = {s for j in tracker.getJobIdsForGroup(job_id) if (info := tracker.getJobInfo(j)) for s in info.stageIds}
        known = [info for s in stages if (info := tracker.getStageInfo(s))]
        return replace(job.progress, phase=job.status if job.status in TERMINAL or job.progress.phase == PENDING else job.progress.phase, done=sum(i.numCompletedTasks for i in known), total=sum(i.numTasks for i in known))

    def close(self) -> None:
        """Cancels what this engine still runs."""
        for job_id in list(self._threads):
            try:
                if self.get(job_id).status not in TERMINAL:
                    self.cancel(job_id)
            except JobNotFoundError:
                continue

    def _run(self, job_id: str, library: DataFrame, n: int) -> None:
        def phase(name: str) -> None:
            if not self.store.update_progress(job_id, Progress(name, molecules_processed=0 if name == "per_molecule" else n, molecules_total=n)):
                raise JobStateError(f"job {job_id} has ended")  # another engine may have cancelled it

        try:
            if not self.store.set_status(job_id, RUNNING):
                return
            self.spark.sparkContext.setJobGroup(job_id, f"triage {job_id}", interruptOnCancel=True)
            counts = write_report(library, self.get(job_id).config, self.store.results_path(job_id), phase=phase)
            self.store.set_status(job_id, SUCCEEDED, counts=counts)
        except JobNotFoundError:
            return
        except Exception as e:  # noqa: BLE001  the job fails, not the engine
            try:
                self.store.set_status(job_id, FAILED, error=origin(e))
            except JobNotFoundError:
                return

    def wait(self, job_id: str, timeout: float | None = None) -> Job:
        if job_id in self._threads:
            self._threads[job_id].join(timeout)
        return self.get(job_id)

    def get(self, job_id: str) -> Job:
        return self.store.get(job_id)

    def list_jobs(self, limit: int = 50, offset: int = 0) -> list[Job]:
        """Newest first, at most 200 at a time."""
        return self.store.list_jobs(limit, offset)[0]

    def _finished(self, job_id: str, *allowed: str) -> Job:
        job = self.get(job_id)
        if job.status not in allowed:
            raise JobStateError(f"job {job_id} is {job.status}" + (f": {job.error}" if job.error else ""))
        return job

    def results(self, job_id: str) -> DataFrame:
        """All rows of the report."""
        self._finished(job_id, SUCCEEDED)
        return self.spark.read.parquet(f"{self.store.results_path(job_id)}/rows").drop("part")

    def page(self, job_id: str, offset: int = 0, limit: int = 100) -> tuple[list, int, int | None]:
        """Rows, total, and the next offset or None; a cancelled job has no rows."""
        if not 1 <= limit <= 1000 or offset < 0:
            raise ValueError("limit must be 1 to 1000 and offset at least 0")
        if self._finished(job_id, SUCCEEDED, CANCELLED).status == CANCELLED:
            return [], 0, None
        rows, total = read_page(self.spark, self.store.results_path(job_id), offset, limit)
        got = rows.collect() if rows is not None else []
        return got, total, offset + len(got) if offset + len(got) < total else None

    def cancel(self, job_id: str) -> None:
        """Cancels a job that runs; removes one that has ended, with its results."""
        if not self.store.set_status(job_id, CANCELLED, error="cancelled by request"):
            self.store.delete(job_id)
            return
        self.spark.sparkContext.cancelJobGroup(job_id)
