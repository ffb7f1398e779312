"""Stores of jobs: what a job is, its states, and where they are kept.

``JobStore`` is what an engine needs; ``MemoryStore`` lives as long as its process,
``FolderStore`` in a folder that several drivers may share. There a job is a folder of
numbered events, each one published by a rename that fails where the number is taken, so
that of two drivers one wins and the other looks again. A job's state is what its events
add up to; its results lie in the same folder and go when it is deleted. Renames must be
atomic on the file system used, as they are on HDFS and local disks.
"""

from __future__ import annotations

import json
import threading
import uuid
from abc import ABC, abstractmethod
from dataclasses import asdict, dataclass, field, replace
from datetime import UTC, datetime
from typing import Any

from pyspark.sql import SparkSession

from .triage import TriageConfig

PENDING, RUNNING, SUCCEEDED, FAILED, CANCELLED = "pending", "running", "succeeded", "failed", "cancelled"
TERMINAL = (SUCCEEDED, FAILED, CANCELLED)
MAX_NAME, MAX_LIST = 200, 200


class JobNotFoundError(KeyError):
    """No job has this id."""


@dataclass(frozen=True)
class Progress:
    """Where a job is: its phase, molecules through the first phase, and tasks of its Spark jobs so far, whose total may still grow."""

    phase: str = PENDING
    done: int = 0
    total: int = 0
    molecules_processed: int = 0
    molecules_total: int = 0

    @property
    def fraction(self) -> float:
        return self.done / self.total if self.total else 0.0


@dataclass
class Job:
    id: str
    name: str
    config: TriageConfig
    status: str = PENDING
    created_at: datetime = field(default_factory=lambda: datetime.now(UTC))
    started_at: datetime | None = None
    finished_at: datetime | None = None
    counts: dict[str, int] = field(default_factory=dict)
    error: str | None = None
    progress: Progress = Progress()

    @property
    def duration_seconds(self) -> float | None:
        """Since the start, until the end or now; None before the start."""
        return ((self.finished_at or datetime.now(UTC)) - self.started_at).total_seconds() if self.started_at else None

    def after(self, event: dict[str, Any]) -> Job:
        """The job after an event; a terminal state stays as it is."""
        if self.status in TERMINAL:
            return self
        at, status = datetime.fromisoformat(event["at"]), event.get("status", self.status)
        return replace(
            self, status=status, error=event.get("error", self.error), counts=dict(event.get("counts", self.counts)), progress=Progress(**event["progress"]) if "progress" in event else self.progress,
            started_at=self.started_at or (at if status == RUNNING else None), finished_at=at if status in TERMINAL else None,
        )


def _event(**given: Any) -> dict[str, Any]:
    return {"at": datetime.now(UTC).isoformat()} | {k: v for k, v in given.items() if v is not None}


class JobStore(ABC):
    """Jobs by id. What it returns is a copy; ids that are not known raise JobNotFoundError."""

    @abstractmethod
    def create(self, job: Job) -> None: ...

    @abstractmethod
    def get(self, job_id: str) -> Job: ...

    @abstractmethod
    def all(self) -> list[Job]: ...

    @abstractmethod
    def add(self, job_id: str, event: dict[str, Any]) -> bool:
        """Applies an event; False if the job has ended."""

    @abstractmethod
    def delete(self, job_id: str) -> None:
        """Removes the job and its results."""

    @abstractmethod
    def results_path(self, job_id: str) -> str: ...

    def list_jobs(self, limit: int = 50, offset: int = 0) -> tuple[list[Job], int]:
        """Newest first, and how many there are."""
        if not 1 <= limit <= MAX_LIST or offset < 0:
            raise ValueError(f"limit must be 1 to {MAX_LIST} and offset at least 0")
        jobs = sorted(self.all(), key=lambda j: j.created_at, reverse=True)
        return jobs[offset : offset + limit], len(jobs)

    def set_status(self, job_id: str, status: str, error: str | None = None, counts: dict[str, int] | None = None) -> bool:
        return self.add(job_id, _event(status=status, error=error, counts=counts))

    def update_progress(self, job_id: str, progress: Progress) -> bool:
        return self.add(job_id, _event(progress=asdict(progress)))


class _Files:
    """The few steps on a Hadoop file system that a store needs."""

    def __init__(self, spark: SparkSession, path: str):
        jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
        self._path, self._io = jvm.org.apache.hadoop.fs.Path, jvm.org.apache.commons.io.IOUtils
        self._fs = self._path(path).getFileSystem(conf)
        self._context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), conf)
        self._no_options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)

    def names(self, path: str) -> list[str]:
        where = self._path(path)
        return sorted(s.getPath().getName() for s in self._fs.listStatus(where)) if self._fs.exists(where) else []

    def read(self, path: str) -> str:
        stream = self._fs.open(self._path(path))
        try:
            return self._io.toString(stream, "UTF-8")
        finally:
            stream.close()

    def publish(self, staged: str, path: str, text: str) -> bool:
        """Writes a file that was not there; False where it was."""
        stream = self._fs.create(self._path(staged), True)
        try:
            stream.write(bytearray(text, "utf-8"))
        finally:
            stream.close()
        try:
            self._context.rename(self._path(staged), self._path(path), self._no_options)
            return True
        except Exception:  # noqa: BLE001  py4j has one class for all of them
            self._fs.delete(self._path(staged), True)
            if not self._fs.exists(self._path(path)):
                raise
            return False

    def make(self, path: str) -> None:
        self._fs.mkdirs(self._path(path))

    def exists(self, path: str) -> bool:
        return self._fs.exists(self._path(path))

    def remove(self, path: str) -> bool:
        return self._fs.delete(self._path(path), True)


class MemoryStore(JobStore):
    """Jobs of one process; their results are removed with them."""

    def __init__(self, spark: SparkSession, path: str):
        self._files, self._dir, self._jobs, self._lock = _Files(spark, path), path, {}, threading.Lock()

    def create(self, job: Job) -> None:
        with self._lock:
            self._jobs[job.id] = job

    def get(self, job_id: str) -> Job:
        with self._lock:
            if job_id not in self._jobs:
                raise JobNotFoundError(job_id)
            job = self._jobs[job_id]
            return replace(job, counts=dict(job.counts))

    def all(self) -> list[Job]:
        with self._lock:
            return [replace(j, counts=dict(j.counts)) for j in self._jobs.values()]

    def add(self, job_id: str, event: dict[str, Any]) -> bool:
        with self._lock:
            if job_id not in self._jobs:
                raise JobNotFoundError(job_id)
            if self._jobs[job_id].status in TERMINAL:
                return False
            self._jobs[job_id] = self._jobs[job_id].after(event)
            return True

    def delete(self, job_id: str) -> None:
        with self._lock:
            if job_id not in self._jobs:
                raise JobNotFoundError(job_id)
            del self._jobs[job_id]
        self._files.remove(self.results_path(job_id))

    def results_path(self, job_id: str) -> str:
        return f"{self._dir}/{job_id}"


class FolderStore(JobStore):
    """Jobs under a folder that drivers share and that outlives them."""

    def __init__(self, spark: SparkSession, path: str):
        self._files, self._dir = _Files(spark, path), path
        for name in ("jobs", "staging"):
            self._files.make(f"{path}/{name}")

    def _folder(self, job_id: str) -> str:
        if not job_id or not all(c.isalnum() or c in "-_" for c in job_id):
            raise JobNotFoundError(job_id)
        return f"{self._dir}/jobs/{job_id}"

    def _publish(self, job_id: str, number: int, event: dict[str, Any]) -> bool:
        return self._files.publish(f"{self._dir}/staging/{uuid.uuid4().hex}", f"{self._folder(job_id)}/events/{number:08d}.json", json.dumps(event))

    def create(self, job: Job) -> None:
        self._files.make(f"{self._folder(job.id)}/events")
        if not self._publish(job.id, 0, {"name": job.name, "config": job.config.to_json(), "created_at": job.created_at.isoformat()}):
            raise ValueError(f"there is a job {job.id}")

    def _read(self, job_id: str) -> tuple[Job, int]:
        folder = f"{self._folder(job_id)}/events"
        names = self._files.names(folder)
        if not names:
            raise JobNotFoundError(job_id)
        try:
            first, *events = (json.loads(self._files.read(f"{folder}/{n}")) for n in names)
        except Exception:
            if not self._files.names(folder):  # deleted meanwhile
                raise JobNotFoundError(job_id) from None
            raise
        job = Job(job_id, first["name"], TriageConfig.from_json(first["config"]), created_at=datetime.fromisoformat(first["created_at"]))
        for e in events:
            job = job.after(e)
        return job, len(names)

    def get(self, job_id: str) -> Job:
        return self._read(job_id)[0]

    def all(self) -> list[Job]:
        out = []
        for job_id in self._files.names(f"{self._dir}/jobs"):
            try:
                out.append(self.get(job_id))
            except JobNotFoundError:
                continue
        return out

    def add(self, job_id: str, event: dict[str, Any]) -> bool:
        while True:
            job, number = self._read(job_id)
            if job.status in TERMINAL:
                return False
            if self._publish(job_id, number, event):
                return True

    def delete(self, job_id: str) -> None:
        self.get(job_id)
        self._files.remove(self._folder(job_id))

    def results_path(self, job_id: str) -> str:
        return f"{self._folder(job_id)}/results"
