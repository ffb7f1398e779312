"""Session functions of SQL, and triage across arrivals."""

import pytest

from assaykit.functions import rules as R
from assaykit.functions import score as X
from assaykit.functions.sql import arguments, register
from assaykit.operators import selection as S
from assaykit.plans.triage import TriageConfig
from assaykit.sources import readers
from assaykit.streaming.describe import read_stream
from assaykit.streaming.triage import triage_batch, triage_stream
from pyspark.sql import functions as F

ROWS = [(500.0, 5.0, 140.0, 5, 10, 10, 20, 4, 0, 0), (501.0, 5.1, 140.5, 6, 11, 11, 71, 5, 2, 3), (120.0, -1.5, 5.0, 0, 0, 0, 8, 0, 0, 1), (349.9, 3.5, 75.0, 3, 3, 3, 45, 6, 1, 0)]
NAMES = ["molecular_weight", "clogp", "tpsa", "hbd", "hba", "rotatable_bonds", "total_atoms", "rings", "unassigned_stereocentres", "n_alerts"]


@pytest.fixture(scope="module")
def table(spark):
    assert "tanimoto" in register(spark) and len(register(spark)) == 4 + 2 * len(R.RULES)
    df = spark.createDataFrame(ROWS, NAMES)
    df.createOrReplaceTempView("surface")
    return df


def test_rules_of_sql_are_those_of_columns(spark, table):
    for rule in R.RULES:
        given = ", ".join(arguments(rule))
        sql = spark.sql(f"SELECT broken_{rule}({given}), passes_{rule}({given}) FROM surface").collect()
        columns = table.select(F.element_at(R.evaluate([rule], table.columns), 1).alias("r")).collect()
        assert [tuple(r) for r in sql] == [(len(r.r.violations), r.r.passed) for r in columns]


def test_score_window_and_similarity(spark, table):
    sql = spark.sql(f"SELECT triage_score({', '.join(['molecular_weight', 'clogp', 'tpsa', 'unassigned_stereocentres', 'rings', 'CAST(n_alerts AS INT)'])}) AS s FROM surface").collect()
    columns = table.select(X.composite_score(n_alerts=F.col("n_alerts"))[0].alias("s")).collect()
    assert [r.s for r in sql] == pytest.approx([r.s for r in columns], rel=1e-12)
    one = lambda text: spark.sql(f"SELECT {text}").first()[0]
    assert one("within_window(1, 1, 2)") and one("within_window(5, NULL, NULL)") and one("within_window(double('NaN'), 1, 2)") and not one("within_window(0.9, 1, NULL)")
    assert one("tanimoto(array(1, 2, 3), array(2, 3, 4))") == 0.5 and one("tanimoto(array(), array())") == 0.0
    assert one("drop_reason(false, true, true)") == "dropped_by_rule" and one("drop_reason(false, false, false)") is None
    for text in ("within_window(NULL, 1, 2)", "passes_veber(NULL, 3)", "triage_score(1, NULL, 1, 0, 0, 0)", "triage_score(1, 1, 1, 0, 0, -1)"):
        with pytest.raises(Exception, match="value|negative"):
            one(text)


def test_functions_are_inlined(spark, table):
    plan = spark.sql("SELECT passes_lipinski(molecular_weight, clogp, hbd, hba) FROM surface WHERE within_window(tpsa, 1, 100)")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "passes_lipinski(" not in plan.split("Project")[1].split("AS")[0]


def test_absent_values_break_rules_and_windows(spark):
    df = spark.createDataFrame([(None, 50.0)], "rotatable_bonds int, tpsa double")
    for bad in (R.evaluate(["veber"], df.columns), R.within("rotatable_bonds", None, 5)):
        with pytest.raises(Exception, match="value"):
            df.select(bad).collect()


def library(spark, rows):
    return spark.createDataFrame(rows, "ord bigint, identifier string, input_smiles string").coalesce(1)


def test_duplicates_across_arrivals(spark, tmp_path):
    arrivals, path, checkpoint = (str(tmp_path / x) for x in ("in", "out", "checkpoint"))
    config, seen = TriageConfig(rule_sets=("veber",), descriptor_windows={"molecular_weight": (None, 150.0)}), {}
    run = lambda: triage_stream(read_stream(spark, arrivals), path, checkpoint, config, seen.__setitem__).awaitTermination(120)
    library(spark, [(5, "a", "CCO"), (6, "b", "OCC"), (7, "c", "C((("), (8, "big", "C" * 30)]).write.parquet(arrivals)
    run()
    library(spark, [(1, "d", "C(O)C"), (2, "e", "CCN"), (3, "f", "NCC")]).write.mode("append").parquet(arrivals)
    run()
    run()
    assert seen == {0: {"submitted": 4, "new": 1, "duplicate": 1, "empty": 2}, 1: {"submitted": 3, "new": 1, "duplicate": 2, "empty": 0}}
    read = lambda: {r.identifier: (r.status, r.duplicate_of, r.epoch, r.drop_reason, r.parse_error is None) for r in spark.read.parquet(path).collect()}
    want = {
        "a": ("new", None, 0, None, True), "b": ("duplicate", "a", 0, None, True), "c": ("empty", None, 0, None, False), "big": ("empty", None, 0, "dropped_by_window", True),
        "d": ("duplicate", "a", 1, None, True), "e": ("new", None, 1, None, True), "f": ("duplicate", "e", 1, None, True),
    }
    assert read() == want
    # an epoch that is done again changes nothing, and the counts of all arrivals reconcile
    assert triage_batch(library(spark, [(1, "d", "C(O)C"), (2, "e", "CCN"), (3, "f", "NCC")]), 1, path, config) == seen[1] and read() == want
    every = spark.read.parquet(path)
    counts = every.agg(*S.count_columns()).first()
    assert counts.submitted == 7 == counts.parse_failed + counts.duplicates_removed + counts.dropped_by_window + counts.retained and counts.retained == 2
    assert every.where("status = 'new' AND score IS NULL").count() == 0
