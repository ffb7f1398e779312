import json

import pytest

from assaykit.plans.jobs import JobNotFoundError, TriageEngine
from assaykit.plans.triage import TriageConfig
from assaykit.sources import readers
from assaykit.sources.sinks import json_lines
from assaykit.streaming.describe import describe_stream, read_stream


def test_job_pages_and_counts(spark, tmp_path):
    engine = TriageEngine(spark, str(tmp_path))
    job = engine.wait(engine.submit(readers.inline(spark, ["CCO", "OCC", "c1ccccc1", "C((("]), TriageConfig(rule_sets=()), "demo"), 60)
    assert job.status == "succeeded" and job.counts["submitted"] == 4 and job.counts["duplicates_removed"] == 1
    rows, total, after = engine.page(job.id, 0, 3)
    assert (len(rows), total, after) == (3, 4, 3) and engine.page(job.id, 3, 3)[2] is None
    assert [j.id for j in engine.list_jobs()] == [job.id]
    assert None in json.loads(json_lines(engine.results(job.id)).first().value).values()
    engine.cancel(job.id)
    with pytest.raises(JobNotFoundError):
        engine.get(job.id)
    with pytest.raises(ValueError):
        engine.submit(readers.inline(spark, ["CCO"]).limit(0))


def test_stream(spark, tmp_path):
    readers.inline(spark, ["CCO", "C((("]).write.parquet(str(tmp_path / "in"))
    describe_stream(read_stream(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "c")).awaitTermination(60)
    assert sorted(r.parse_ok for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [False, True]
