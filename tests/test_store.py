"""Stores, results by page, observed counts, the output contract and errors of jobs."""

import json
import os
from datetime import UTC, datetime

import pytest
from pyspark.sql import functions as F

from assaykit.operators import selection as S
from assaykit.plans.jobs import FAILED, PENDING, RUNNING, SUCCEEDED, JobNotFoundError, JobStateError, TooLargeError, TriageEngine, origin
from assaykit.plans.store import CANCELLED, FolderStore, Job, MemoryStore, Progress
from assaykit.plans.triage import TriageConfig, finalize, report, triage, write_report
from assaykit.sources import readers
from assaykit.sources.contract import REPORT, Field, checked, violations, with_fields
from assaykit.sources.shared import shared_dir
from assaykit.sources.sinks import read_manifest, read_page, write_pages


@pytest.fixture(params=[MemoryStore, FolderStore])
def store(request, spark, tmp_path):
    return request.param(spark, str(tmp_path / "store"))


def job(i="j1", day=1, **more):
    return Job(i, f"job {i}", TriageConfig(rule_sets=("egan",), descriptor_windows={"tpsa": (None, 9.0)}), created_at=datetime(2026, 1, day, tzinfo=UTC), **more)


def test_store_keeps_what_it_is_told(store):
    store.create(job())
    got = store.get("j1")
    assert (got.status, got.name, got.config, got.created_at) == (PENDING, "job j1", job().config, job().created_at) and got.duration_seconds is None
    got.status, got.counts["x"] = SUCCEEDED, 1
    assert store.get("j1").status == PENDING and store.get("j1").counts == {}
    assert store.set_status("j1", RUNNING)
    began = store.get("j1").started_at
    assert began is not None and store.set_status("j1", RUNNING) and store.get("j1").started_at == began
    assert store.update_progress("j1", Progress("report", 1, 4, 7, 9)) and store.get("j1").progress == Progress("report", 1, 4, 7, 9) and store.get("j1").progress.fraction == 0.25
    assert store.set_status("j1", SUCCEEDED, counts={"submitted": 5})
    done = store.get("j1")
    assert done.finished_at >= done.started_at and done.counts == {"submitted": 5} and done.duration_seconds >= 0
    # an ended job stays as it is
    assert not store.set_status("j1", FAILED, error="late") and not store.update_progress("j1", Progress()) and store.get("j1") == done


def test_store_lists_newest_first_and_deletes(store):
    for k, day in (("a", 2), ("b", 9), ("c", 5)):
        store.create(job(k, day))
    assert ([j.id for j in store.list_jobs()[0]], store.list_jobs()[1]) == (["b", "c", "a"], 3)
    assert [j.id for j in store.list_jobs(1, 1)[0]] == ["c"] and store.list_jobs(5, 9) == ([], 3)
    for wrong in ((0, 0), (201, 0), (1, -1)):
        with pytest.raises(ValueError):
            store.list_jobs(*wrong)
    store.delete("b")
    for call in (store.get, store.delete, lambda i: store.set_status(i, RUNNING)):
        with pytest.raises(JobNotFoundError):
            call("b")
    with pytest.raises(JobNotFoundError):
        store.get("../a")


def test_two_drivers_and_a_restart(spark, tmp_path):
    path = str(tmp_path / "shared")
    one, two = FolderStore(spark, path), FolderStore(spark, path)
    one.create(job())
    with pytest.raises(ValueError):
        two.create(job())
    assert two.set_status("j1", RUNNING) and one.get("j1").status == RUNNING
    # the other driver publishes between our look and our write: we look again
    real, calls = one._read, []

    def read(job_id):
        found = real(job_id)
        if not calls:
            calls.append(two.set_status(job_id, CANCELLED))
        return found

    one._read = read
    assert not one.set_status("j1", SUCCEEDED, counts={"submitted": 1}) and calls == [True]
    again = FolderStore(spark, path)
    assert again.get("j1").status == CANCELLED and again.get("j1").counts == {} and os.listdir(f"{path}/staging") == []


def test_engines_share_jobs_and_results(spark, tmp_path):
    path = str(tmp_path / "shared")
    one, two = (TriageEngine(spark, path, store=FolderStore(spark, path)) for _ in range(2))
    done = one.wait(one.submit(readers.inline(spark, ["CCO", "OCC", "c1ccccc1", "C((("]), TriageConfig(rule_sets=()), "demo"), 120)
    assert (done.status, done.error) == (SUCCEEDED, None)
    assert done.counts == {"submitted": 4, "parsed": 3, "parse_failed": 1, "duplicates_removed": 1, "dropped_by_window": 0, "dropped_by_rule": 0, "dropped_by_alert": 0, "retained": 2, "clusters": 2}
    assert done.progress == Progress("report", molecules_processed=4, molecules_total=4) and one.progress(done.id).phase == SUCCEEDED
    assert two.get(done.id) == one.get(done.id) and [j.id for j in two.list_jobs()] == [done.id]
    assert [r.identifier for r in two.page(done.id, 0, 1000)[0]] == [r.identifier for r in one.results(done.id).orderBy("rank").collect()]
    restarted = TriageEngine(spark, path, store=FolderStore(spark, path))
    assert restarted.page(done.id, 1, 2)[1:] == (4, 3) and restarted.page(done.id, 99, 4) == ([], 4, None)
    folder = restarted.store.results_path(done.id)
    assert os.path.isdir(folder)
    two.cancel(done.id)
    assert not os.path.exists(folder)
    for engine in (one, two, restarted):
        with pytest.raises(JobNotFoundError):
            engine.get(done.id)


def test_failed_jobs_say_what_happened(spark, tmp_path):
    engine = TriageEngine(spark, str(tmp_path), settings=None)
    bad = readers.inline(spark, ["CCO"]).withColumn("input_smiles", F.when(F.col("ord") == 0, F.raise_error(F.lit("the file is broken"))).otherwise(F.col("input_smiles")))
    failed = engine.wait(engine.submit(bad), 60)
    assert (failed.status, failed.error) == (FAILED, "the file is broken") and engine.store.results_path(failed.id)
    with pytest.raises(JobStateError, match="the file is broken"):
        engine.page(failed.id)
    with pytest.raises(ValueError, match="200"):
        engine.submit(readers.inline(spark, ["CCO"]), name="n" * 201)
    with pytest.raises(TooLargeError):
        TriageEngine(spark, str(tmp_path), max_library_size=1).submit(readers.inline(spark, ["C", "CC"]))
    with pytest.raises(KeyError, match="no_such"):
        engine.submit_path(__file__, '{"no_such": 1}')


def test_errors_of_workers_are_unwrapped(spark):
    def fail(batches):
        raise ValueError("molecule 7 has no atoms")
        yield

    for df, text in ((spark.range(1).mapInArrow(fail, "id long"), "ValueError: molecule 7 has no atoms"), (spark.range(1).select(F.raise_error(F.lit("a b"))), "a b")):
        with pytest.raises(Exception) as e:
            df.collect()
        assert origin(e.value) == text
    assert origin(KeyError("x")) == "KeyError: 'x'"


def test_pages_are_files(spark, tmp_path):
    path = str(tmp_path / "pages")
    df = spark.range(0, 7500).select((F.lit(7499) - F.col("id")).alias("rank"), F.col("id").alias("v")).repartition(5)
    assert write_pages(df, path, 2000) == 7500 and read_manifest(spark, path) == (7500, 2000)
    assert sorted(d for d in os.listdir(f"{path}/rows") if d.startswith("part=")) == [f"part={k}" for k in range(4)]
    assert all(len([f for f in os.listdir(f"{path}/rows/part={k}") if f.endswith(".parquet")]) == 1 for k in range(4))
    for offset, limit in ((0, 1), (1990, 20), (2000, 1000), (7400, 1000)):
        rows, total = read_page(spark, path, offset, limit)
        assert total == 7500 and [r["rank"] for r in rows.collect()] == list(range(offset, min(offset + limit, 7500)))
        assert len(rows.inputFiles()) == (2 if offset == 1990 else 1)
    assert read_page(spark, path, 7500, 10) == (None, 7500)
    for wrong in ((0, 0), (0, 1001), (-1, 5)):
        with pytest.raises(ValueError):
            read_page(spark, path, *wrong)
    assert write_pages(df.limit(0), str(tmp_path / "none"), 1000) == 0 and read_page(spark, str(tmp_path / "none"), 0, 5) == (None, 0)


SMILES = ["CCO", "OCC", "c1ccccc1", "C(((", "CCN", "Cc1ccccc1", "CCCCCCCCCCCCCCCCCC", "CC(=O)Oc1ccccc1C(=O)O"]


@pytest.mark.parametrize("more", [{}, {"top_n": 2}, {"representatives_only": True, "cluster_cutoff": 0.8}, {"cluster": False}, {"cluster_method": "leader", "representatives_only": True, "top_n": 1, "cluster_cutoff": 0.9}])
def test_written_reports_equal_the_plan(spark, tmp_path, more):
    config = TriageConfig(rule_sets=("veber",), drop_rule_failures=True, **more)
    library = readers.inline(spark, SMILES)
    seen, before = [], set(os.listdir(shared_dir(spark)))
    counts = write_report(library, config, str(tmp_path / "r"), phase=seen.append)
    assert set(os.listdir(shared_dir(spark))) == before  # no table in between is left
    plan, plan_counts = triage(library, config)
    want = [(r.identifier, r.report_group, r.duplicate_of, r.cluster_id, r.is_cluster_representative, r.score) for r in plan.collect()]
    rows = spark.read.parquet(str(tmp_path / "r" / "rows")).orderBy("rank").collect()
    assert [(r.identifier, r.report_group, r.duplicate_of, r.cluster_id, r.is_cluster_representative, r.score) for r in rows] == want
    assert [r["rank"] for r in rows] == list(range(len(want))) and seen == ["per_molecule", "deduplicate", "report"]
    assert counts == {"clusters": 0} | plan_counts.first().asDict()
    assert counts["submitted"] == 8 == counts["parse_failed"] + counts["duplicates_removed"] + counts["dropped_by_rule"] + counts["retained"]


def test_counts_take_no_pass_of_their_own(spark, tmp_path):
    """Observed in plans that write, so no job of the report only counts."""
    described, config = readers.inline(spark, SMILES), TriageConfig(rule_sets=())
    from pyspark.sql import Observation

    from assaykit.plans.triage import describe

    seen, plans = Observation("c"), []

    def table(df):
        plans.append(df._jdf.queryExecution().analyzed().toString())
        from assaykit.sources.shared import written

        return written(df)

    rows = finalize(describe(described), config, table, seen)
    assert seen.get == {k: v for k, v in S.counts(rows).first().asDict().items()}
    assert sum("CollectMetrics" in p for p in plans) == 1 and report(rows, config).count() == 8


GOOD = [("a", 1, 0.5), ("b", 2, None)]
CONTRACT = [Field("name", "string", True), Field("n", "int", True, "n > 0"), Field("score", "double", rule="score BETWEEN 0 AND 1")]


def test_contract(spark):
    df = spark.createDataFrame(GOOD, "name string, n int, score double")
    assert sorted(map(tuple, checked(df.select("score", "n", "name"), CONTRACT).collect())) == GOOD and checked(df, CONTRACT).columns == ["name", "n", "score"]
    for broken, text in ((df.drop("n"), "lacks n"), (df.withColumn("more", F.lit(1)), "no place for more"), (df.withColumn("n", F.col("n").cast("bigint")), "field n is bigint, not int")):
        with pytest.raises(ValueError, match=text):
            with_fields(broken, CONTRACT)
    for row, text in (((None, 1, 0.1), "field name .* not null"), (("a", None, 0.1), "field n .* n > 0"), (("a", 0, 0.1), "field n "), (("a", 1, 1.1), "field score .* BETWEEN")):
        bad = spark.createDataFrame([*GOOD, row], df.schema)
        with pytest.raises(Exception, match=text):
            checked(bad, CONTRACT).collect()
        assert sum(bad.agg(*violations(CONTRACT)).first()) == 1
    assert len({f.name for f in REPORT}) == len(REPORT)


def test_reports_break_their_contract_by_name(spark, tmp_path, monkeypatch):
    from assaykit.plans import triage as plan

    config, library = TriageConfig(rule_sets=(), cluster=False), readers.inline(spark, ["CCO"])
    real = plan.finalize
    for change, text in ((lambda r: r.withColumn("score", F.lit(7.0)), "field score"), (lambda r: r.withColumn("extra", F.lit(1)), "no place for extra"), (lambda r: r.withColumn("cluster_id", F.lit(1)), "cluster_id is int")):
        monkeypatch.setattr(plan, "finalize", lambda *a, change=change: change(real(*a)))
        with pytest.raises(Exception, match=text):
            write_report(library, config, str(tmp_path / "x"))


def test_config_as_json():
    config = TriageConfig(descriptor_windows={"tpsa": (1.0, None)}, top_n=3, alert_catalogs=("pains",))
    assert TriageConfig.from_json(config.to_json()) == config and json.loads(config.to_json())["top_n"] == 3
    assert TriageConfig().max_cluster_rows == 20_000
