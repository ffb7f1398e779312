"""The jobs over copies of small tables: reruns, growing input, repeated batches, config."""

import json
import os
import re
import subprocess
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from assaykit.streaming.register import register_batch
from jobs.config import read_config
from jobs.intake import IntakeConfig, intake
from jobs.queries import HERE, REGISTER_SCHEMA, SHORTLIST, SHORTLIST_SCHEMA
from jobs.shortlist import ShortlistConfig, shortlist

ROOT = Path(__file__).resolve().parent.parent
DOCS = "doc_id bigint, text string, lang string, source string, score double"
WORDS = " ".join(f"word{i}" for i in range(40))


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.fixture
def library(spark, tmp_path):
    rows = [(i, f"{WORDS} number {i}", "en" if i % 2 else "de", "s", 0.0) for i in range(20)]
    rows += [(100, f"{WORDS} number 3", "en", "s", 0.0), (2000, f" {WORDS.upper()}\n\tNUMBER 3 ", "fr", "t", 0.0)]  # copies of 3
    rows += [(101, None, "en", "s", 0.0), (102, "", "en", None, 0.0), (103, "few words", None, "s", 0.0), (104, f"{WORDS} a.b@example.org", "en", "s", 0.0)]
    rows += [(105, f"{WORDS} licensed under x", "en", "s", 0.0), (106, WORDS + " ###### $$$$$$ %%%%%% ####### &&&&&&", "en", "s", 0.0), (None, f"{WORDS} without id", "", "s", 0.0), (7, f"{WORDS} number 7", "en", "s", 0.0)]
    spark.createDataFrame(rows, DOCS).repartition(3).write.parquet(path := str(tmp_path / "documents"))
    return path


def test_shortlist_accounts_for_every_record(spark, library, tmp_path):
    config = ShortlistConfig(**{**SHORTLIST.__dict__, "top_n": 4})
    out = str(tmp_path / "out")
    counts = shortlist(spark, library, out, config)
    got = {r.doc_id: r for r in spark.read.schema(SHORTLIST_SCHEMA).parquet(out).collect()}
    assert counts == {"submitted": 30, "parsed": 30, "parse_failed": 0, "duplicates_removed": 2, "dropped_by_window": 4, "dropped_by_rule": 0, "dropped_by_alert": 1, "retained": 23}
    assert (got[100].status, got[100].duplicate_of, got[2000].duplicate_of, got[3].duplicate_of) == ("duplicate", 3, 3, None)
    assert {i: got[i].status for i in (101, 102, 103, 106)} == dict.fromkeys((101, 102, 103, 106), "dropped_by_window") and got[104].status == "dropped_by_alert"
    assert got[104].alerts == "email" and got[105].alerts == "license" and got[105].status == "below_cut" and got[105].score < got[1].score
    assert [i for i in range(1, 20, 2) if got[i].status == "shortlisted"] == [1, 3, 5, 7] and got[7].rank == 4 and got[None].rank == 1
    assert os.path.isdir(f"{out}/lang=en/status=shortlisted")
    first = rows_of(spark.read.schema(SHORTLIST_SCHEMA).parquet(out))
    shortlist(spark, library, out, config)
    assert rows_of(spark.read.schema(SHORTLIST_SCHEMA).parquet(out)) == first and len(first) == 30


def test_shortlist_of_nothing(spark, tmp_path):
    spark.createDataFrame([], DOCS).write.parquet(str(tmp_path / "none"))
    assert shortlist(spark, str(tmp_path / "none"), str(tmp_path / "out"), SHORTLIST)["submitted"] == 0
    assert spark.read.schema(SHORTLIST_SCHEMA).parquet(str(tmp_path / "out")).count() == 0


def test_shortlist_reads_four_columns_and_limits_groups_before_the_shuffle(spark, library, tmp_path):
    from pyspark.sql import Window

    from jobs.shortlist import judged

    rows = judged(spark.read.parquet(library).select("doc_id", "source", "lang", "text"), SHORTLIST)
    order = Window.partitionBy("lang").orderBy(F.desc("score"), "doc_id")
    plan = rows.withColumn("rank", F.row_number().over(order)).where("rank <= 3")._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "score#" not in plan.split("ReadSchema:")[1].split("\n")[0]


def put(spark, path, rows):
    spark.createDataFrame([(i, t, "en", s, 0.0) for i, t, s in rows], DOCS).coalesce(1).write.mode("append").parquet(path)


def test_intake_takes_what_is_new(spark, tmp_path):
    arrivals, register, checkpoint = (str(tmp_path / x) for x in ("in", "register", "checkpoint"))
    put(spark, arrivals, [(5, "a b", "s"), (3, "A  b", "s"), (6, "c", "s"), (7, None, "s")])
    assert intake(spark, arrivals, register, checkpoint) == {"submitted": 4, "new": 2, "duplicate": 1, "empty": 1}
    read = lambda: {r.identifier: (r.status, r.duplicate_of, r.epoch) for r in spark.read.schema(REGISTER_SCHEMA).parquet(register).collect()}
    assert read() == {5: ("duplicate", 3, 0), 3: ("new", None, 0), 6: ("new", None, 0), 7: ("empty", None, 0)}
    assert intake(spark, arrivals, register, checkpoint) == {"submitted": 0, "new": 0, "duplicate": 0, "empty": 0}
    # smaller ids in a later arrival don't take the place of what was registered
    put(spark, arrivals, [(1, "a B", "t"), (2, "d", "t"), (4, "D", "t")])
    assert intake(spark, arrivals, register, checkpoint) == {"submitted": 3, "new": 1, "duplicate": 2, "empty": 0}
    put(spark, arrivals, [(0, " d ", "t"), (9, "", "t")])
    intake(spark, arrivals, register, checkpoint)
    want = {5: ("duplicate", 3, 0), 3: ("new", None, 0), 6: ("new", None, 0), 7: ("empty", None, 0), 1: ("duplicate", 3, 1), 2: ("new", None, 1), 4: ("duplicate", 2, 1), 0: ("duplicate", 2, 2), 9: ("empty", None, 2)}
    assert read() == want
    assert os.path.isdir(f"{register}/epoch=1/status=new")


def test_intake_in_small_batches_loses_nothing(spark, tmp_path):
    arrivals, register, checkpoint = (str(tmp_path / x) for x in ("in", "register", "checkpoint"))
    for k in range(4):
        put(spark, arrivals, [(10 * k + i, f"text {i * (k % 2)}", "s") for i in range(5)])
    got = intake(spark, arrivals, register, checkpoint, IntakeConfig(max_files_per_run=1))
    rows = spark.read.schema(REGISTER_SCHEMA).parquet(register)
    assert got == {"submitted": 20, "new": 5, "duplicate": 15, "empty": 0} and rows.count() == 20 and rows.select("epoch").distinct().count() == 4
    assert rows.where("status = 'new'").select("key").distinct().count() == 5
    named = rows.alias("d").join(rows.alias("n"), F.col("d.duplicate_of") == F.col("n.identifier")).where("d.status = 'duplicate'")
    assert named.where("n.status = 'new' AND n.key = d.key AND n.epoch <= d.epoch").count() == 15


def test_a_batch_done_again_changes_nothing(spark, tmp_path):
    path = str(tmp_path / "register")
    kind = "key string, ord bigint, identifier string, source string"
    batches = [[("k", 1, "a", "s"), ("k", 2, "b", "s"), (None, 3, "c", "s")], [("k", 0, "d", "s"), ("m", 0, "e", "s"), ("m", 0, "f", "s")], [("m", 9, "g", "s")]]
    for epoch, rows in enumerate(batches):
        register_batch(spark.createDataFrame(rows, kind), epoch, path)
    schema = "key string, ord bigint, identifier string, source string, duplicate_of string, epoch bigint, status string"
    first = rows_of(spark.read.schema(schema).parquet(path))
    assert len(first) == 7 and [r[4] for r in sorted(first, key=lambda r: r[2])] == [None, "a", None, "a", None, None, "e"]
    for epoch in (1, 0, 2, 1):
        assert register_batch(spark.createDataFrame(batches[epoch], kind), epoch, path)["submitted"] == len(batches[epoch])
        assert rows_of(spark.read.schema(schema).parquet(path)) == first


def test_intake_after_a_crash(spark, tmp_path, monkeypatch):
    """A run that dies after it wrote a batch, before Spark noted it, is done again as it was, whatever has arrived meanwhile."""
    from assaykit.streaming import register as module

    arrivals, register, checkpoint = (str(tmp_path / x) for x in ("in", "register", "checkpoint"))
    put(spark, arrivals, [(1, "a", "s"), (2, "b", "s")])
    intake(spark, arrivals, register, checkpoint)
    put(spark, arrivals, [(3, "a", "s"), (4, "c", "s"), (5, "c", "s")])
    real = module.register_batch

    def dies(*args):
        real(*args)
        raise OSError("lost the driver")

    monkeypatch.setattr(module, "register_batch", dies)
    with pytest.raises(Exception, match="lost the driver"):
        intake(spark, arrivals, register, checkpoint)
    half = rows_of(spark.read.schema(REGISTER_SCHEMA).parquet(register))
    assert len(half) == 5
    monkeypatch.setattr(module, "register_batch", real)
    put(spark, arrivals, [(0, "c", "s")])
    # the batch that was lost, and then what came after it
    assert intake(spark, arrivals, register, checkpoint) == {"submitted": 4, "new": 1, "duplicate": 3, "empty": 0}
    rows = spark.read.schema(REGISTER_SCHEMA).parquet(register)
    assert rows_of(rows.where("epoch < 2")) == half
    assert {r.identifier: (r.status, r.duplicate_of, r.epoch) for r in rows.collect()} == {
        1: ("new", None, 0), 2: ("new", None, 0), 3: ("duplicate", 1, 1), 4: ("new", None, 1), 5: ("duplicate", 4, 1), 0: ("duplicate", 4, 2)}


def test_growing_documents(spark, tmp_path):
    """A copy of the documents that arrives in parts gives each text one first record, and a rerun of everything at once the same keys."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").repartition(3, "doc_id")
    arrivals, register, checkpoint = (str(tmp_path / x) for x in ("in", "register", "checkpoint"))
    want, seen = {}, {}
    for part in range(3):
        some = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(3)) == part)
        some.coalesce(1).write.mode("append").parquet(arrivals)
        got = intake(spark, arrivals, register, checkpoint)
        rows = sorted((r.doc_id, " ".join(re.sub("[A-Z]", lambda m: m[0].lower(), r.text or "").split())) for r in some.collect())
        assert got["submitted"] == len(rows) and got["new"] + got["duplicate"] + got["empty"] == len(rows)
        for i, text in rows:
            want[i] = ("empty", None) if not text else ("duplicate", seen[text]) if text in seen else ("new", None)
            seen.setdefault(text, i)
    found = spark.read.schema(REGISTER_SCHEMA).parquet(register)
    assert {r.identifier: (r.status, r.duplicate_of) for r in found.collect()} == want and len(want) == docs.count()
    intake(spark, arrivals, f"{register}-2", f"{checkpoint}-2")
    assert rows_of(found.where("status = 'new'").select("key")) == rows_of(spark.read.schema(REGISTER_SCHEMA).parquet(f"{register}-2").where("status = 'new'").select("key"))


def test_config(tmp_path):
    assert read_config(ShortlistConfig, HERE / "shortlist.json").top_n == 100
    bad = tmp_path / "bad.json"
    bad.write_text(json.dumps({"top": 3}))
    with pytest.raises(KeyError, match="top"):
        read_config(ShortlistConfig, bad)
    for wrong in ({"drop_alerts": ["x"]}, {"windows": {"x": [1, 2]}}):
        with pytest.raises(KeyError):
            ShortlistConfig(**wrong)
    with pytest.raises(ValueError):
        ShortlistConfig(top_n=0)


def test_command_line(spark, library, tmp_path):
    config = tmp_path / "c.json"
    config.write_text(json.dumps({"top_n": 2}))
    run = [sys.executable, "-m", "jobs.shortlist", library, str(tmp_path / "out"), "--config", str(config)]
    done = subprocess.run(run, cwd=ROOT, capture_output=True, text=True, timeout=200, env={**os.environ, "PYTHONPATH": str(ROOT), "SPARK_LOCAL_IP": "127.0.0.1", "PYSPARK_SUBMIT_ARGS": "--master local[2] --conf spark.sql.shuffle.partitions=2 --conf spark.ui.enabled=false pyspark-shell"})
    assert done.returncode == 0, done.stderr[-2000:]
    assert "read 30 records" in done.stderr and "retained" in done.stderr
    assert spark.read.schema(SHORTLIST_SCHEMA).parquet(str(tmp_path / "out")).count() == 30


def test_texts_are_worked_on_once_a_run(spark, tmp_path, monkeypatch):
    from jobs import shortlist as J

    spark.createDataFrame([(i, "s", "en", "Abİ K " * (i % 7 + 3)) for i in range(40)], "doc_id bigint, source string, lang string, text string").write.parquet(f"{tmp_path}/in")
    seen, real = [], J.S.deduplicate
    monkeypatch.setattr(J.S, "deduplicate", lambda df, *rest: (seen.append(df._jdf.queryExecution().executedPlan().toString()), real(df, *rest))[1])
    assert shortlist(spark, f"{tmp_path}/in", f"{tmp_path}/out", ShortlistConfig())["duplicates_removed"] == 33
    assert len(seen) == 1 and "InMemoryTableScan" in seen[0]
