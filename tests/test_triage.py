import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from assaykit.functions import rules as R
from assaykit.functions.score import composite_score
from assaykit import kernel as K
from assaykit.operators import selection as S
from assaykit.operators import similarity as T
from assaykit.plans import triage as P
from assaykit.plans.triage import TriageConfig, describe, triage
from assaykit.sources import readers

ASPIRIN = "CC(=O)Oc1ccccc1C(=O)O"


@pytest.mark.parametrize("text", ["", " \n ", "water", "N(C", "C1CC", "[Qq]", "*", "[*]*", "null", "CC;CC", "C=", "C)C"])
def test_rejects(text):
    with pytest.raises(K.SmilesError):
        K.parse(text)


def test_descriptors_and_canonical_text():
    d = K.descriptors(K.parse(ASPIRIN))
    assert (round(d["molecular_weight"], 2), d["heavy_atoms"], d["total_atoms"], d["hba"], d["hbd"], d["rings"]) == (180.16, 13, 21, 4, 1, 1)
    same = [ASPIRIN, "OC(=O)c1ccccc1OC(C)=O", "CC(=O)Oc1ccccc1C(=O)[O-].[Na+]"]
    assert len({K.write(K.standardise(K.parse(s))) for s in same}) == 1
    for s in (ASPIRIN, "Cn1cnc2c1c(=O)n(C)c(=O)n2C", "CN1CCC[C@H]1c1cccnc1"):
        once = K.write(K.parse(s))
        assert K.write(K.parse(once)) == once
    assert K.scaffold(K.parse("CCCCO")) is None and K.scaffold(K.parse(ASPIRIN)) == "c1ccccc1"


def test_rules(spark):
    df = spark.createDataFrame([(520.0, 3.0, 2, 5), (520.0, 6.0, 2, 5), (499.0, 0.0, 0, 0), (501.0, 0.0, 0, 0)], "molecular_weight double, clogp double, hbd int, hba int")
    rows = R.with_rules(df, ["lipinski", "lipinski"]).collect()
    assert [(len(r.rules), r.rules[0].passed, len(r.rules[0].violations)) for r in rows] == [(1, True, 1), (1, False, 2), (1, True, 0), (1, True, 1)]
    assert rows[3].rules[0].violations == ["MW 501 > 500"]
    with pytest.raises(KeyError):
        R.evaluate(["ghose"], df.columns)


def test_window_lets_nan_pass(spark):
    df = spark.createDataFrame([(float("nan"),), (5.0,), (11.0,)], "x double")
    assert df.select(R.within("x", 0, 10).alias("k")).collect() == [(True,), (True,), (False,)]


def test_score_goldens(spark):
    df = spark.createDataFrame([(284.746, 3.1538, 32.67, 3, 0), (18.015, -0.8247, 31.5, 0, 0)], "molecular_weight double, clogp double, tpsa double, rings int, unassigned_stereocentres int")
    assert [round(r[0], 4) for r in df.select(composite_score()[0]).collect()] == [0.7487, 0.0902]


def test_triage_report(spark):
    lib = readers.inline(spark, [ASPIRIN, "CC(=O)Oc1ccccc1C(=O)[O-].[Na+]", "Cn1cnc2c1c(=O)n(C)c(=O)n2C", "C((("], ["aspirin", "salt", "caffeine", "bad"])
    report, counts = triage(lib, TriageConfig(rule_sets=()))
    assert {(r.identifier, r.duplicate_of, r.report_group) for r in report.collect()} == {("aspirin", None, 0), ("caffeine", None, 0), ("salt", "aspirin", 1), ("bad", None, 3)}
    c = counts.first()
    assert (c.submitted, c.parsed, c.parse_failed, c.duplicates_removed, c.retained) == (4, 3, 1, 1, 2)
    assert describe(lib.limit(0)).count() == 0


def test_sources(spark, tmp_path):
    (tmp_path / "a.smi").write_text("CCO e\n# c\n\nc1ccccc1 b extra\nC\n")
    assert [(r.identifier, r.input_smiles) for r in readers.read_library(spark, str(tmp_path / "a.smi")).orderBy("ord").collect()] == [("e", "CCO"), ("b", "c1ccccc1"), ("4", "C")]
    (tmp_path / "b.csv").write_text("id,smiles\nA1,CCO\n,\n,C\n")
    assert [r.identifier for r in readers.read_library(spark, str(tmp_path / "b.csv"), id_column="id").orderBy("ord").collect()] == ["A1", "2"]
    with pytest.raises(ValueError):
        readers.csv(spark, str(tmp_path / "b.csv"), "structure")


def test_butina_equals_greedy(spark):
    rng = random.Random(3)
    rows = [(i, sorted(rng.sample(range(12), rng.randint(1, 6)))) for i in range(40)]
    got = {r.id: r for r in T.butina(spark.createDataFrame(rows, "id int, bits array<int>"), 0.5).collect()}
    near = {i: {j for j, b in rows if j != i and len(set(a) & set(b)) / len(set(a) | set(b)) >= 0.5} for i, a in rows}
    centres, free = set(), set(near)
    for i in sorted(near, key=lambda k: (-len(near[k]), k)):
        if i in free:
            centres.add(i)
            free -= near[i] | {i}
    assert {i for i, r in got.items() if r.is_centroid} == centres and len(got) == 40


def test_descriptors_of_all_kinds(spark, tmp_path):
    """The registered query has every row of part: alkanols, alkylbenzenes and broken records."""
    from assaykit import queries as Q

    spark.createDataFrame([(k, 1 + k % 7) for k in range(1, 51)], "p_partkey bigint, p_size int").write.parquet(str(tmp_path / "part.parquet"))
    rows = {r.ord: r for r in Q.queries()["descriptors_library"](spark, str(tmp_path)).collect()}
    assert sorted(rows) == list(range(1, 51)) and "descriptors_library" in Q.oracle_sql()
    for k, r in rows.items():
        n = 1 + k % 7
        got = (r.parse_ok, r.heavy_atoms, r.total_atoms, r.hbd, r.hba, r.rotatable_bonds, r.rings, r.murcko_scaffold)
        if k % 5 == 4:
            assert got == (False, *[None] * 7) and r.molecular_weight is None
        elif k % 5 == 3:
            assert got == (True, n + 6, 3 * n + 12, 0, 0, n - 1, 1, "c1ccccc1") and r.molecular_weight == pytest.approx(12.011 * (n + 6) + 1.008 * (2 * n + 6))
        else:
            assert got == (True, n + 1, 3 * n + 3, 1, 1, max(n - 2, 0), 0, None)


def test_unknown_rule_set_is_an_error(spark):
    lib = readers.inline(spark, ["CCO", "C((("])
    with pytest.raises(KeyError):
        triage(lib, TriageConfig(rule_sets=("lipinsky",)))
    assert triage(lib)[1].first().retained == 1


DRUGS = [  # SMILES, logP, polar surface, rotatable bonds, aromatic rings
    ("CN1CCC[C@H]1c1cccnc1", 1.8483, 16.13, 1, 1), ("c1ccc2[nH]ccc2c1", 2.1679, 15.79, 0, 2), ("O", -0.8247, 31.5, 0, 0), ("O=[N+]([O-])c1ccccc1", 1.5948, 43.14, 1, 1),
    ("CC(C)c1c(C(=O)Nc2ccccc2)c(-c2ccccc2)c(-c2ccc(F)cc2)n1CC[C@@H](O)C[C@@H](O)CC(=O)O", 6.3136, 111.79, 12, 4),
]


@pytest.mark.parametrize("text, logp, surface, turning, aromatic", DRUGS)
def test_published_descriptors(text, logp, surface, turning, aromatic):
    d = K.descriptors(K.parse(text))
    assert (round(d["clogp"], 4), round(d["tpsa"], 2), d["rotatable_bonds"], d["aromatic_rings"]) == (logp, surface, turning, aromatic)


def test_one_text_for_all_spellings_and_stereo_kept():
    from assaykit.kernel import canon, mol

    rng = random.Random(1)
    for text in [d[0] for d in DRUGS] + ["C/C=C/C=C\\CO", "C[C@H]1CC[C@@H](O)CC1", "O[C@H]1[C@@H](O)[C@H](O)[C@@H](CO)OC1O", "c1ccc2cccc2cc1"]:
        m = K.parse(text)
        want = K.write(m)
        for _ in range(5):
            order = list(range(len(m)))
            rng.shuffle(order)
            assert K.write(mol.subset(m, order)) == want
        assert K.write(K.parse(want)) == want
    same = lambda a, b: K.write(K.parse(a)) == K.write(K.parse(b))
    assert same("C1=CC=CC=C1", "c1ccccc1") and same("CN(=O)=O", "C[N+](=O)[O-]") and same("[H][C@](C)(N)C(=O)O", "[C@H](C)(N)C(=O)O")
    assert not same("C[C@H](N)C(=O)O", "C[C@@H](N)C(=O)O") and not same("F/C=C/F", "F/C=C\\F") and same("F/C=C/F", "F\\C=C\\F")
    assert canon.parity([0, 1, 2, -1], [0, 1, 2]) == 1
    for bad in ("c1cccc1", "[C](C)(C)(C)(C)C", "CN(C)(C)C", "C=", "c1ccnc1"):
        with pytest.raises(K.SmilesError):
            K.parse(bad)


def test_stereocentres_fingerprints_scaffolds():
    counts = lambda s: (K.descriptors(K.parse(s))["stereocentres"], K.descriptors(K.parse(s))["unassigned_stereocentres"])
    assert counts("CC(N)C(=O)O") == (1, 1) and counts("C[C@H](N)C(=O)O") == (1, 0) and counts("CC=CC(=O)O") == (0, 0) and counts("CCO") == (0, 0)
    assert K.fingerprint(K.parse("C[C@H](N)C(=O)O")) == K.fingerprint(K.parse("C[C@@H](N)C(=O)O"))
    f2, f3 = K.fingerprint(K.parse(ASPIRIN)), K.fingerprint(K.parse(ASPIRIN), 3)
    assert set(f2) < set(f3) and max(K.fingerprint(K.parse(ASPIRIN), 2, 512)) < 512
    near = lambda s: len(set(f2) & set(x := K.fingerprint(K.parse(s)))) / len(set(f2) | set(x))
    assert max(["OC(=O)c1ccccc1O", "Cn1cnc2c1c(=O)n(C)c(=O)n2C", "CCO"], key=near) == "OC(=O)c1ccccc1O"
    assert K.generic_scaffold(K.parse("O=C1CCCCC1")) == "CC1CCCCC1" and K.scaffold(K.parse("O=C(c1ccccc1)C")) == "c1ccccc1"


def test_alerts():
    names = lambda s, *c: [(h["catalog"], h["name"]) for h in K.find_alerts(K.parse(s), c or ("pains", "brenk"))]
    assert names("Cc1ccc(O)c(O)c1", "pains", "pains_b", "nih") == [("PAINS_B", "catechol_A(92)"), ("NIH", "catechol")]
    assert names("CCOC(C)=O", "pains") == [] and names("COc1ccc(CCN)cc1") == [] and names("CC1CCCCC1C(N)=O") == []
    (hit,) = [h for h in K.find_alerts(K.parse("Cc1cc([N+](=O)[O-])cc(C)c1[N+](=O)[O-]"), ("brenk",))]
    assert (hit["name"], hit["atom_indices"]) == ("nitro_group", [4, 5, 6, 11, 12, 13])
    assert len(K.Pattern("[#6;R]1~[#6]~[#6]~[#6]~[#6]~[#6]1").matches(K.parse("c1ccccc1"))) == 1
    with pytest.raises(KeyError):
        names("C", "panes")


def test_whole_plan(spark):
    lib = readers.inline(spark, [ASPIRIN, "OC(=O)c1ccccc1OC(C)=O", "C[C@H](N)C(=O)O", "C[C@@H](N)C(=O)O", "CCCCCCCCCCCCCCCO", "C((("], ["a", "b", "l", "d", "wax", "bad"])
    out, counts = triage(lib, TriageConfig(drop_rule_failures=True))
    rows = {r.identifier: r for r in out.collect()}
    assert rows["b"].duplicate_of == "a" and rows["l"].duplicate_of is None and rows["d"].duplicate_of is None and rows["wax"].drop_reason == "dropped_by_rule" and rows["bad"].parse_error
    assert rows["l"].cluster_id == rows["d"].cluster_id != rows["a"].cluster_id and [rows["l"].is_cluster_representative, rows["d"].is_cluster_representative] == [True, False]
    assert 0 < rows["a"].score < 1 and rows["a"].score_breakdown["alert_penalty"] == 0.5 and rows["b"].score is None and rows["wax"].rules[0].violations == ["rotatable bonds 13 > 10"]
    c = counts.first()
    assert (c.retained, c.clusters, c.dropped_by_rule) == (3, 2, 1)
    best, _ = triage(lib, TriageConfig(representatives_only=True, top_n=1, alert_catalogs=()))
    assert [r.report_group for r in best.collect()] == [0, 1, 3]
    for wrong in ({"descriptor_windows": {"mass": (0, 1)}}, {"alert_catalogs": ("x",)}):
        with pytest.raises(KeyError):
            TriageConfig(**wrong)
    for wrong in ({"cluster": False, "representatives_only": True}, {"cluster_cutoff": 2}, {"fingerprint_bits": 8}, {"top_n": 0}, {"descriptor_windows": {"tpsa": (2, 1)}}):
        with pytest.raises(ValueError):
            TriageConfig(**wrong)


@pytest.mark.parametrize("bad", [float("nan"), None])
def test_no_score_without_numbers(spark, bad):
    df = spark.createDataFrame([(bad, 2.0, 70.0, 1, 0)], "molecular_weight double, clogp double, tpsa double, rings int, unassigned_stereocentres int")
    with pytest.raises(Exception, match="molecular_weight"):
        df.select(composite_score()[0]).collect()


def test_nearest_is_complete(spark):
    rows = [(i, [i % 3]) for i in range(6)] + [(9, [])]
    df = spark.createDataFrame(rows, "id int, bits array<int>")
    got = [(r.q, r["rank"], r.t, r.similarity) for r in T.nearest(df.where("id in (0, 9)"), df, 3).orderBy("q", "rank").collect()]
    assert got == [(0, 1, 3, 1.0), (0, 2, 1, 0.0), (0, 3, 2, 0.0), (9, 1, 0, 0.0), (9, 2, 1, 0.0), (9, 3, 2, 0.0)]


def test_long_line_files_and_guards(spark, tmp_path):
    n = 5000
    (tmp_path / "a.smi").write_text("".join(f"C n{i}\n" for i in range(n)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        rows = readers.lines(spark, str(tmp_path / "a.smi")).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert sorted(r.ord for r in rows) == list(range(n)) and all(r.identifier == f"n{r.ord}" for r in rows)
    with pytest.raises(ValueError):
        readers.read_library(spark, str(tmp_path / "a.smi"), max_bytes=100)
    (tmp_path / "b.smi").write_bytes(b"C \xff\n")
    with pytest.raises(Exception, match="UTF-8"):
        readers.lines(spark, str(tmp_path / "b.smi")).collect()


def test_rows_without_a_key_do_not_meet_in_one_task(spark):
    """Dropped and broken records have null keys and are most of some inputs."""
    was = {c: spark.conf.get(c) for c in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        df = spark.range(4000).selectExpr("id AS ord", "CAST(id AS STRING) AS identifier", "CASE WHEN id % 10 = 0 THEN id % 300 END AS key")
        found = S.deduplicate(df).withColumn("part", F.spark_partition_id())
        assert [r["count"] < 1500 for r in found.groupBy("part").count().collect()] == [True] * 4
        assert found.where("duplicate_of IS NOT NULL").count() == 400 - 30 and found.count() == 4000
    finally:
        for c, v in was.items():
            spark.conf.set(c, v)


def test_each_text_is_worked_on_once_a_task(monkeypatch):
    seen, held, kinds = [], {}, [pa.string(), pa.list_(pa.int32())]
    work = lambda t: (seen.append(t), [t.upper(), [len(t)]] if t else [None])[1]
    for _ in range(2):
        got = [c.to_pylist() for c in P._once(pa.array(["cc", None, "o", "cc", "", "o"]), work, kinds, held)]
        assert got == [["CC", None, "O", "CC", None, "O"], [[2], None, [1], [2], None, [1]]]
    assert seen == ["cc", "", "o"]
    monkeypatch.setattr(P, "MOST_TEXTS", 2)
    assert P._once(pa.array(["a", "b", "c"]), work, kinds, held)[0].to_pylist() == ["A", "B", "C"] and len(held) <= 2
