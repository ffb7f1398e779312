import json

import pytest

from assaykit import kernel as K
from assaykit.__main__ import config_of, main
from assaykit.kernel.smarts import Pattern
from assaykit.operators import similarity as T
from assaykit.plans.jobs import Progress, Settings, TooLargeError, TriageEngine
from assaykit.plans.triage import TriageConfig, describe, finalize, generic_scaffolds, standardised
from assaykit.sources import readers


def test_direct_calls_and_limits(spark, tmp_path):
    engine = TriageEngine(spark, str(tmp_path), settings=Settings(max_direct_rows=3))
    three = readers.inline(spark, ["CC(=O)[O-].[Na+]", "C(((", "CCO"])
    rows = engine.standardize(three).collect()
    assert [r.standard_smiles for r in rows] == ["CC(=O)O", None, "CCO"] and [r.error is None for r in rows] == [True, False, True]
    rows = engine.describe(three, TriageConfig(drop_alert_hits=True)).collect()
    assert [r.parse_ok for r in rows] == [True, False, True] and "score" not in rows[0] and rows[0].rules[0].name == "veber"
    with pytest.raises(TooLargeError):
        engine.describe(readers.inline(spark, ["C"] * 4))
    with pytest.raises(ValueError):
        engine.standardize(three.limit(0))
    assert engine.health() == {"status": "ok", "session": True, "kernel": True}


def test_file_jobs_progress_and_settings(spark, tmp_path):
    (tmp_path / "lib.csv").write_text("smiles,name\nCCO,a\nOCC,b\n")
    engine = TriageEngine(spark, str(tmp_path / "out"), settings=Settings(max_file_bytes=100))
    job = engine.wait(engine.submit_path(str(tmp_path / "lib.csv"), TriageConfig(cluster=False), id_column="name"), 90)
    assert (job.status, job.name, job.counts["duplicates_removed"]) == ("succeeded", "lib.csv", 1) and job.duration_seconds > 0
    done = engine.progress(job.id)
    assert done.phase == "succeeded" and 0 <= done.fraction <= 1 and done.done <= done.total
    assert Progress().fraction == 0.0
    (tmp_path / "big.smi").write_text("C\n" * 60)
    with pytest.raises(ValueError):
        engine.submit_path(str(tmp_path / "big.smi"))
    engine.close()
    assert Settings.from_env({"ASSAYKIT_MAX_DIRECT_ROWS": "7", "OTHER": "x"}) == Settings(max_direct_rows=7)


def test_command_line(spark, tmp_path, capsys):
    (tmp_path / "lib.smi").write_text("CCO first\nC(((\n")
    (tmp_path / "c.json").write_text(json.dumps({"cluster": False, "rule_sets": [], "descriptor_windows": {"molecular_weight": {"max": 10}}}))
    session, stop = spark, spark.stop
    main([str(tmp_path / "lib.smi"), str(tmp_path / "report"), "--config", str(tmp_path / "c.json")])
    assert session.range(1).count() == 1 and stop
    assert json.loads(capsys.readouterr().out.strip().splitlines()[-1])["dropped_by_window"] == 1
    assert {json.loads(r.value)["identifier"] for r in spark.read.text(str(tmp_path / "report")).collect()} == {"first", "1"}
    with pytest.raises(KeyError):
        config_of('{"no_such": 1}')


def test_generic_scaffolds_and_standard_texts(spark):
    lib = readers.inline(spark, ["c1ccncc1CC", "C1CCCCC1O", "CCO", "C((("])
    rows = generic_scaffolds(describe(lib).select("ord", "murcko_scaffold")).orderBy("ord").collect()
    assert [r.generic_scaffold for r in rows] == ["C1CCCCC1", "C1CCCCC1", None, None]
    assert standardised(lib.limit(0)).count() == 0
    assert standardised(lib).where("error is null").count() == 3


def test_cluster_checks(spark):
    rows = spark.createDataFrame([(1,), (2,), (3,)], "id int")
    make = lambda *x: spark.createDataFrame(list(x), "id int, cluster_id int")
    assert T.check_clusters(rows, make((1, 0), (2, 0), (3, 1))).count() == 3
    for bad, text in (((1, 0), (2, 0), (3, 1), (4, 1)), "row 4 .* no row"), (((1, 0), (1, 1), (2, 0), (3, 1)), "row 1 .* more than one"), (((1, 0), (3, 1)), "row 2 .* no cluster"):
        with pytest.raises(ValueError, match=text):
            T.check_clusters(rows, make(*bad))


def test_missing_fingerprint_is_an_error(spark):
    from pyspark.sql import functions as F

    rows = describe(readers.inline(spark, ["CCO", "CCN"], ["x", "y"])).withColumn("fingerprint", F.when(F.col("ord") == 0, F.col("fingerprint")))
    with pytest.raises(Exception, match="no fingerprint to cluster for y"):
        finalize(rows, TriageConfig()).collect()


def test_patterns_know_the_elements_they_need():
    assert Pattern("[F,Cl,Br,I]C(=O)[#6]").needs == {6, 8} and Pattern("[!#6;!#1]=[#7]").needs == {7} and Pattern("[SX2H1]").needs == {16}
    assert Pattern("[OX2;H1,$(O[#6])][NX3;!$(N=*)]").needs == {7, 8} and Pattern("[R]~*").needs == set()


def test_standardise_leaves_its_input_alone():
    for text in ("C[NH3+].[Cl-]", "CC(=O)[O-]", "C[C@H](N)C(=O)O", "CCO"):
        mol = K.parse(text)
        before = K.write(mol)
        once = K.standardise(mol)
        assert K.write(K.parse(text)) == before == K.write(mol) and K.write(K.standardise(once)) == K.write(once)
