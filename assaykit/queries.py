"""Queries of the triage operators on the driver's tables, and their SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import rules as R
from .functions import score as X
from .functions.sql import arguments, register
from .operators import selection as S
from .operators import similarity as T
from .plans.triage import TriageConfig, describe, generic_scaffolds, standardised, triage, write_report
from .sources.shared import new_folder, written
from .sources.sinks import json_lines, read_page

#: Descriptors derived from order keys; the same text runs in Spark and DuckDB.
PROXY = """o_orderkey AS ord, 'C' || CAST(o_orderkey AS VARCHAR(20)) AS identifier, CAST(100 + (o_orderkey * 37) % 500 AS DOUBLE) AS molecular_weight,
 CAST((o_orderkey * 13) % 900 AS DOUBLE) / 100.0E0 - 1.5E0 AS clogp, CAST((o_orderkey * 29) % 200 AS DOUBLE) + 0.5E0 AS tpsa, CAST(o_orderkey % 9 AS INT) AS hbd, CAST(o_orderkey % 13 AS INT) AS hba,
 CAST(o_orderkey % 14 AS INT) AS rotatable_bonds, CAST(10 + o_orderkey % 70 AS INT) AS total_atoms, CAST(o_orderkey % 7 AS INT) AS rings, CAST(o_orderkey % 4 AS INT) AS unassigned_stereocentres,
 CAST(o_orderkey % 3 AS INT) AS n_alerts, o_custkey AS key, CAST(o_custkey % 50 AS INT) AS cluster_id, (o_orderkey % 17) <> 0 AS parse_ok"""
P = f"WITH p AS (SELECT {PROXY} FROM orders)"


def proxy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/orders.parquet").selectExpr(*[x.strip() for x in _split(PROXY)])


def _split(text: str) -> list[str]:
    out, depth, now = [], 0, ""
    for c in text:
        depth += (c == "(") - (c == ")")
        if c == "," and not depth:
            out.append(now)
            now = ""
        else:
            now += c
    return [*out, now]


def _rule(name: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        p = proxy(spark, sf_dir)
        r = R.evaluate([name], p.columns)[0]
        return p.select("ord", r["passed"].alias("passed"), F.array_join(r["violations"], "; ").alias("violations"))

    return run


def _num(key: str) -> str:
    return f"rtrim(rtrim(printf('%.2f', CAST({key} AS DOUBLE)), '0'), '.')"


def _rule_sql(name: str) -> str:
    allowed, bounds = R.RULES[name]
    tests = []
    for b in bounds:
        for op, limit in ((">", b.high), ("<", b.low)):
            if limit is not None:
                tests.append(f"CASE WHEN {b.key} {op} {limit} THEN '{b.label} ' || {_num(b.key)} || ' {op} {R._limit_text(limit)}' END")
    return f"{P}, v AS (SELECT ord, list_filter([{', '.join(tests)}], lambda x: x IS NOT NULL) AS v FROM p) SELECT ord, len(v) <= {allowed} AS passed, array_to_string(v, '; ') AS violations FROM v"


_CENTRAL = " * ".join(f"exp(-pow(({k} - {c}) / {w}, 2) / 2)" for k, (c, w) in X.CENTRES.items())
_COMPLEX = "1.0E0 / (1 + 0.35E0 * unassigned_stereocentres + 0.2E0 * greatest(0, rings - 4))"
_SCORE = f"exp((1.0E0 * ln(greatest({_CENTRAL}, 1e-6)) + 0.5E0 * ln(1.0E0 / (1 + n_alerts)) + 0.25E0 * ln({_COMPLEX})) / 1.75E0)"
_REASON = "CASE WHEN molecular_weight > 500 OR tpsa < 10 THEN 'dropped_by_window' WHEN rotatable_bonds > 10 OR tpsa > 140 THEN 'dropped_by_rule' WHEN n_alerts > 0 THEN 'dropped_by_alert' END"


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    score, _ = X.composite_score(n_alerts=F.col("n_alerts"))
    return proxy(spark, sf_dir).withColumn("score", F.round(score, 9))


def components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return proxy(spark, sf_dir).select("ord", F.round(X.property_centrality(), 9).alias("centrality"), F.round(X.complexity_penalty(), 9).alias("complexity"), F.round(X.alert_penalty(F.col("n_alerts")), 9).alias("alert"))


def judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = proxy(spark, sf_dir)
    reason = R.drop_reason({"molecular_weight": (None, 500), "tpsa": (10, None)}, R.evaluate(["veber"], p.columns), F.col("n_alerts"))
    p = p.withColumn("drop_reason", F.when(F.col("parse_ok"), reason))
    live = F.col("parse_ok") & F.col("drop_reason").isNull()
    return S.deduplicate(p.withColumn("key", F.when(live, F.col("key"))))


_JUDGED = f"""{P}, r AS (SELECT *, CASE WHEN parse_ok THEN {_REASON} END AS drop_reason FROM p),
 l AS (SELECT *, CASE WHEN parse_ok AND drop_reason IS NULL THEN key END AS k FROM r),
 j AS (SELECT *, CASE WHEN k IS NOT NULL AND min(ord) OVER (PARTITION BY k) < ord THEN arg_min(identifier, ord) OVER (PARTITION BY k) END AS duplicate_of FROM l)"""


def molecules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alkanols, respellings, salts and broken records made from part keys."""
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    n = F.col("p_size")
    kind = F.col("p_partkey") % 5
    text = F.when(kind == 0, F.concat(F.repeat(F.lit("C"), n), F.lit("O"))).when(kind == 1, F.concat(F.lit("O"), F.repeat(F.lit("C"), n))).when(kind == 2, F.concat(F.repeat(F.lit("C"), n), F.lit("[O-].[Na+]"))).when(
        kind == 3, F.concat(F.lit("c1ccccc1"), F.repeat(F.lit("C"), n))).otherwise("C(((")
    return part.select(F.col("p_partkey").alias("ord"), F.col("p_partkey").cast("string").alias("identifier"), text.alias("input_smiles"), n.alias("n"))


def descriptors_library(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Descriptors of all kinds of molecules and of the broken records."""
    d = describe(molecules(spark, sf_dir))
    return d.select("ord", "parse_ok", F.round("molecular_weight", 6).alias("molecular_weight"), "heavy_atoms", "total_atoms", "hbd", "hba", "rotatable_bonds", "rings", "murcko_scaffold")


#: Published values of known drugs (fixed values): SMILES, MW, logP, polar surface, HBD, HBA, rotatable bonds, aromatic rings, rings, stereocentres, alerts, scaffold.
DRUGS = [
    ("CC(=O)Oc1ccccc1C(=O)O", 180.159, 1.3101, 63.6, 1, 4, 2, 1, 1, 0, "phenol_ester", "c1ccccc1"),
    ("CC(C)CC1=CC=C(C=C1)[C@H](C)C(O)=O", 206.285, 3.0732, 37.3, 1, 2, 4, 1, 1, 1, "", "c1ccccc1"),
    ("CN1C=NC2=C1C(=O)N(C(=O)N2C)C", 194.194, -1.0293, 61.82, 0, 6, 0, 2, 2, 0, "", "O=c1[nH]c(=O)c2[nH]cnc2[nH]1"),
    ("CC(=O)Nc1ccc(O)cc1", 151.165, 1.3506, 49.33, 2, 3, 1, 1, 1, 0, "hydroquinone", "c1ccccc1"),
    ("Cc1ccc(cc1)-c1cc(nn1-c1ccc(cc1)S(N)(=O)=O)C(F)(F)F", 381.379, 3.5139, 77.98, 1, 5, 3, 3, 3, 0, "", "c1ccc(cc1)-c1ccnn1-c1ccccc1"),
    ("CN1C(=O)CN=C(c2ccccc2)c2cc(Cl)ccc12", 284.746, 3.1538, 32.67, 0, 3, 1, 2, 3, 0, "", "O=C1CN=C(c2ccccc2)c2ccccc2N1"),
    ("C[C@H](N)C(=O)O", 89.094, -0.5818, 63.32, 2, 3, 1, 0, 0, 1, "", None),
    ("C[C@@H](N)C(=O)O", 89.094, -0.5818, 63.32, 2, 3, 1, 0, 0, 1, "", None),
]


#: Heavy atoms of the drugs above, in their order (fixed values).
HEAVY = [13, 15, 14, 11, 26, 20, 6, 6]


def drugs(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = F.array(*(F.lit(d[0]) for d in DRUGS))
    return spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").alias("ord"), F.col("p_partkey").cast("string").alias("identifier"), F.get(texts, (F.col("p_partkey") % len(DRUGS)).cast("int")).alias("input_smiles"))


def descriptors_drugs(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = describe(drugs(spark, sf_dir), catalogs=("brenk", "pains"))
    return d.select("ord", F.round("molecular_weight", 3).alias("molecular_weight"), F.round("clogp", 4).alias("clogp"), F.round("tpsa", 2).alias("tpsa"), "hbd", "hba", "rotatable_bonds", "aromatic_rings", "rings", "stereocentres", "unassigned_stereocentres", F.array_join(F.col("alerts.name"), ",").alias("alerts"), "murcko_scaffold")


def generic_scaffold_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scaffolds with all atoms carbon and all bonds single, and how many drugs have them."""
    rows = generic_scaffolds(describe(drugs(spark, sf_dir)).select("ord", "murcko_scaffold"))
    return rows.groupBy("generic_scaffold").agg(F.count("*").alias("n"), F.count_distinct("murcko_scaffold").alias("scaffolds"), F.min("ord").alias("first_ord"))


#: Generic scaffolds of the drugs above, in their order (fixed values).
GENERIC = ["C1CCCCC1", "C1CCCCC1", "CC1CC(C)C2CCCC2C1", "C1CCCCC1", "C1CCC(CC1)C1CCCC1C1CCCCC1", "CC1CCC(C2CCCCC2)C2CCCCC2C1", None, None]


def standardised_drugs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each standard text: how many rows and spellings it stands for, its length, and whether it is its own standard text."""
    rows = standardised(drugs(spark, sf_dir))
    each = written(rows.groupBy("standard_smiles").agg(F.count("*").alias("n"), F.min("ord").alias("first_ord"), F.count("error").alias("errors"), F.count_distinct("input_smiles").alias("spellings")))
    again = standardised(each.select(F.col("first_ord").alias("ord"), F.lit("").alias("identifier"), F.col("standard_smiles").alias("input_smiles"))).select(F.col("ord").alias("first_ord"), F.col("standard_smiles").alias("again"))
    letters = F.length(F.regexp_replace("standard_smiles", "[^A-Za-z]|H|l", "")).alias("atoms")  # none has another element of two letters
    return each.join(again, "first_ord").select("n", "first_ord", "errors", "spellings", letters, (F.col("again") == F.col("standard_smiles")).alias("stable"))


def triage_drugs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole plan: alerts, rules, dedup that tells enantiomers apart, scores, clusters and representatives."""
    out, _ = triage(drugs(spark, sf_dir), TriageConfig(rule_sets=("veber", "lipinski")))
    return out.select("identifier", "duplicate_of", "report_group", F.round("score", 4).alias("score"), F.size(F.filter("rules", lambda r: r["passed"])).alias("passed"), "is_cluster_representative")


def submitted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The drugs, every eleventh record broken."""
    return drugs(spark, sf_dir).withColumn("input_smiles", F.when(F.col("ord") % 11 == 0, "C(((").otherwise(F.col("input_smiles")))


def report_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of a report, clusters included, as they were taken while it was written."""
    counts = write_report(submitted(spark, sf_dir), TriageConfig(rule_sets=("veber", "lipinski")), new_folder(spark, "report"))
    return spark.createDataFrame([counts]).select(*(F.col(c).cast("bigint").alias(c) for c in counts))


def report_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page of a report that was written under its contract."""
    path = new_folder(spark, "report")
    write_report(submitted(spark, sf_dir), TriageConfig(rule_sets=("veber", "lipinski"), top_n=5), path, rows_per_file=1000)
    return read_page(spark, path, 0, 200)[0].select("rank", "identifier", "report_group", "duplicate_of", F.round("score", 4).alias("score"))


def sql_surface(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules, windows and the score in SQL text alone, over the session functions."""
    register(spark)
    view = f"p_{uuid.uuid4().hex}"
    proxy(spark, sf_dir).createOrReplaceTempView(view)
    called = lambda kind, rule: f"{kind}_{rule}({', '.join(arguments(rule))})"
    return spark.sql(f"""
        WITH j AS (SELECT *, drop_reason(NOT within_window(molecular_weight, NULL, 500) OR NOT within_window(tpsa, 10, NULL), NOT {called("passes", "veber")}, n_alerts > 0) AS drop_reason FROM {view})
        SELECT ord, {called("broken", "lipinski")} AS broken_lipinski, {called("passes", "ghose")} AS ghose, CASE WHEN parse_ok THEN drop_reason END AS drop_reason,
          round(triage_score(molecular_weight, clogp, tpsa, unassigned_stereocentres, rings, n_alerts), 9) AS score FROM j""")


def sql_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each fingerprint against the one before it, in SQL text alone."""
    register(spark)
    view = f"f_{uuid.uuid4().hex}"
    fingerprints(spark, sf_dir).createOrReplaceTempView(view)
    return spark.sql(f"SELECT b.id, round(tanimoto(a.bits, b.bits), 9) AS similarity FROM {view} a JOIN {view} b ON a.id + 1 = b.id")


def _text(value: str | None) -> str:
    return "NULL" if value is None else f"'{value}'"


def _drug_sql() -> str:
    rows = ", ".join("(" + ", ".join("NULL" if v is None else f"'{v}'" if isinstance(v, str) else f"{v}E0" if isinstance(v, float) else str(v) for v in (i, *d[1:])) + ")" for i, d in enumerate(DRUGS))
    return f"WITH d(k, molecular_weight, clogp, tpsa, hbd, hba, rotatable_bonds, aromatic_rings, rings, stereocentres, alerts, murcko_scaffold) AS (VALUES {rows}), m AS (SELECT p_partkey AS ord, CAST(p_partkey AS VARCHAR) AS identifier, d.* FROM part JOIN d ON p_partkey % {len(DRUGS)} = k)"


#: Enantiomers, the drugs 6 and 7, are one cluster; every other drug is its own.
_REPORT = f"""{_drug_sql()}, f AS (SELECT *, min(ord) FILTER (ord % 11 <> 0) OVER (PARTITION BY k) AS first, 0 AS unassigned_stereocentres, CASE WHEN alerts = '' THEN 0 ELSE 1 END AS n_alerts,
 CASE WHEN ord % 11 = 0 THEN 3 WHEN min(ord) FILTER (ord % 11 <> 0) OVER (PARTITION BY k) < ord THEN 1 ELSE 0 END AS g FROM m)"""


def fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    bits = F.filter(F.sequence(F.lit(0), F.lit(63)), lambda i: F.col("embedding")[i] > 0)
    return e.select(F.col("vec_id").alias("id"), bits.alias("bits"))


_FP = "WITH f AS (SELECT vec_id AS id, list_filter(range(0, 64), lambda i: embedding[i + 1] > 0) AS bits FROM embeddings), s AS (SELECT a.id AS a, b.id AS b, len(list_intersect(a.bits, b.bits)) AS c, len(a.bits) AS x, len(b.bits) AS y FROM f a, f b WHERE a.id <> b.id)"


def butina_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.butina(fingerprints(spark, sf_dir), 0.5).select("id", "cluster_id", "is_centroid")


def leader_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.leader_clusters(fingerprints(spark, sf_dir), 0.5)


def cluster_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of every fingerprint: its cluster's size and centroid, and whether it is within the cutoff of that centroid."""
    rows = fingerprints(spark, sf_dir)
    found = written(T.check_clusters(rows, written(T.butina(rows, 0.5))))
    centre = found.where("is_centroid").select("cluster_id", F.col("id").alias("centroid")).join(rows.select(F.col("id").alias("centroid"), F.col("bits").alias("theirs")), "centroid")
    sizes = found.groupBy("cluster_id").agg(F.count("*").alias("size"))
    near = F.lit(1).cast("float") - T.tanimoto(F.col("bits"), F.col("theirs")).cast("float") <= 0.5
    return found.join(rows, "id").join(centre, "cluster_id").join(sizes, "cluster_id").select("id", "size", "centroid", (near | (F.col("id") == F.col("centroid"))).alias("within"))


def distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each row's distance to the row before it and to the row of half its number, read from the tiles of the triangle that hold one of them."""
    rows = fingerprints(spark, sf_dir)
    r = F.col("id")
    places = spark.range(1, rows.count()).select(F.explode(F.array(F.shiftright(r * (r - 1), 1) + r - 1, F.shiftright(r * (r - 1), 1) + F.shiftright(r, 1))).alias("position")).distinct()
    tiles = written(T.distance_tiles(rows, size=256, positions=places))
    return T.distances_at(tiles, places).select("position", "row", "column", F.col("distance").cast("double").alias("distance"))


def scaffold_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = describe(molecules(spark, sf_dir)).where("parse_ok")
    return rows.groupBy("murcko_scaffold").agg(F.count("*").alias("n"), F.min("ord").alias("first_ord"))


def ndjson_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = judged(spark, sf_dir).select("ord", "drop_reason")
    return json_lines(rows)


def triage_end_to_end(spark: SparkSession, sf_dir: str) -> DataFrame:
    out, _ = triage(molecules(spark, sf_dir).drop("n"), TriageConfig(rule_sets=()))
    return out.select("identifier", "parse_ok", "duplicate_of", "report_group")


_MOL = "WITH m AS (SELECT p_partkey AS ord, CAST(p_partkey AS VARCHAR) AS identifier, p_partkey % 5 AS kind, p_size AS n FROM part), k AS (SELECT *, CASE WHEN kind < 3 THEN 'a' || n WHEN kind = 3 THEN 'b' || n END AS key FROM m)"


def _greedy_sql(order: str) -> str:
    """Rows in ``order``, one a step: an undecided one takes its undecided neighbours; ``c`` of row p is the place of the row that took it."""
    return f"""WITH RECURSIVE f AS (SELECT vec_id AS id, list_filter(range(0, 64), lambda i: embedding[i + 1] > 0) AS bits FROM embeddings),
 e AS MATERIALIZED (SELECT a.id AS a, b.id AS b FROM f a, f b WHERE a.id <> b.id AND len(a.bits) > 0 AND len(b.bits) > 0
  AND CAST(1 AS FLOAT) - CAST(len(list_intersect(a.bits, b.bits)) / (len(a.bits) + len(b.bits) - len(list_intersect(a.bits, b.bits))) AS FLOAT) <= 0.5),
 o AS MATERIALIZED (SELECT id, row_number() OVER (ORDER BY {order}) AS p FROM f LEFT JOIN (SELECT a, count(*) AS d FROM e GROUP BY a) ON a = id),
 n AS MATERIALIZED (SELECT x.p AS p, list(y.p) FILTER (y.p IS NOT NULL) AS near FROM o x LEFT JOIN e ON e.a = x.id LEFT JOIN o y ON y.id = e.b GROUP BY x.p),
 r AS (SELECT 0 AS step, (SELECT list(0 ORDER BY p) FROM o) AS taken UNION ALL
  SELECT step + 1, CASE WHEN taken[step + 1] > 0 THEN taken ELSE list_transform(taken, lambda x, i: CASE WHEN x = 0 AND (i = step + 1 OR list_contains(near, i)) THEN step + 1 ELSE x END) END FROM r JOIN n ON n.p = step + 1),
 l AS (SELECT taken FROM r ORDER BY step DESC LIMIT 1),
 g AS (SELECT o.id, o.p, l.taken[o.p] AS c FROM o, l),
 z AS (SELECT c, count(*) AS size FROM g GROUP BY c)"""


_BUTINA, _LEADER = _greedy_sql("coalesce(d, 0) DESC, id"), _greedy_sql("id")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    out: dict[str, Callable[[SparkSession, str], DataFrame]] = {f"rule_{r}": _rule(r) for r in R.RULES}
    out |= {
        "score_components": components,
        "composite_score": lambda s, d: scored(s, d).select("ord", "score"),
        "window_filter": lambda s, d: proxy(s, d).where(R.within("molecular_weight", 200, 450) & R.within("clogp", None, 5)).select("ord", "molecular_weight", "clogp"),
        "drop_reason": lambda s, d: judged(s, d).select("ord", "drop_reason"),
        "dedup_first": lambda s, d: judged(s, d).select("ord", "duplicate_of"),
        "counts_reconcile": lambda s, d: S.counts(judged(s, d)),
        "top_n": lambda s, d: S.top_n(scored(s, d), 25).select("ord", "identifier", "score"),
        "page": lambda s, d: S.page(scored(s, d), 100, 50).select("ord", "identifier", "score"),
        "representatives": lambda s, d: S.representatives(scored(s, d)).where("is_cluster_representative").select("cluster_id", "ord"),
        "descriptors_drugs": descriptors_drugs,
        "triage_drugs": triage_drugs,
        "report_counts": report_counts,
        "sql_surface": sql_surface,
        "sql_similarity": sql_similarity,
        "report_page": report_page,
        "generic_scaffold_groups": generic_scaffold_groups,
        "standardised_drugs": standardised_drugs,
        "cluster_check": cluster_check,
        "descriptors_library": descriptors_library,
        "triage_end_to_end": triage_end_to_end,
        "butina_clusters": butina_clusters,
        "leader_clusters": leader_clusters,
        "distance_positions": distances,
        "nearest_all": lambda s, d: T.nearest(fingerprints(s, d), fingerprints(s, d), 5).select("q", "t", F.round("similarity", 9).alias("similarity"), F.col("rank").cast("long").alias("rank")),
        "scaffold_groups": scaffold_groups,
        "ndjson_rows": ndjson_rows,
        "tanimoto_pairs": lambda s, d: T.threshold_pairs(fingerprints(s, d), 0.5).select("a", "b", F.round("similarity", 9).alias("similarity")),
        "nearest_neighbours": lambda s, d: T.nearest(fingerprints(s, d).where("id % 50 = 0"), fingerprints(s, d), 3).select("q", "t", F.round("similarity", 9).alias("similarity"), F.col("rank").cast("long").alias("rank")),
    }
    return out


def oracle_sql() -> dict[str, str]:
    out = {f"rule_{r}": _rule_sql(r) for r in R.RULES}
    out |= {
        "score_components": f"{P} SELECT ord, round({_CENTRAL}, 9) AS centrality, round({_COMPLEX}, 9) AS complexity, round(1.0E0 / (1 + n_alerts), 9) AS alert FROM p",
        "composite_score": f"{P} SELECT ord, round({_SCORE}, 9) AS score FROM p",
        "window_filter": f"{P} SELECT ord, molecular_weight, clogp FROM p WHERE molecular_weight BETWEEN 200 AND 450 AND clogp <= 5",
        "drop_reason": f"{_JUDGED} SELECT ord, drop_reason FROM j",
        "dedup_first": f"{_JUDGED} SELECT ord, duplicate_of FROM j",
        "counts_reconcile": f"""{_JUDGED} SELECT count(*) AS submitted, count(*) FILTER (parse_ok) AS parsed, count(*) FILTER (NOT parse_ok) AS parse_failed, count(duplicate_of) AS duplicates_removed,
            count(*) FILTER (drop_reason = 'dropped_by_window') AS dropped_by_window, count(*) FILTER (drop_reason = 'dropped_by_rule') AS dropped_by_rule, count(*) FILTER (drop_reason = 'dropped_by_alert') AS dropped_by_alert,
            count(*) FILTER (k IS NOT NULL AND duplicate_of IS NULL) AS retained FROM j""",
        "top_n": f"{P} SELECT ord, identifier, round({_SCORE}, 9) AS score FROM p ORDER BY score DESC, identifier, ord LIMIT 25",
        "page": f"{P} SELECT ord, identifier, round({_SCORE}, 9) AS score FROM p ORDER BY score DESC, identifier, ord LIMIT 50 OFFSET 100",
        "representatives": f"{P}, s AS (SELECT *, round({_SCORE}, 9) AS score FROM p) SELECT cluster_id, ord FROM s QUALIFY row_number() OVER (PARTITION BY cluster_id ORDER BY score DESC, identifier DESC, ord) = 1",
        "descriptors_library": """SELECT p_partkey AS ord, p_partkey % 5 < 4 AS parse_ok,
            round(CASE WHEN p_partkey % 5 < 3 THEN 12.011 * p_size + 1.008 * (2 * p_size + 2) + 15.999 WHEN p_partkey % 5 = 3 THEN 12.011 * (p_size + 6) + 1.008 * (2 * p_size + 6) END, 6) AS molecular_weight,
            CAST(CASE WHEN p_partkey % 5 < 3 THEN p_size + 1 WHEN p_partkey % 5 = 3 THEN p_size + 6 END AS INT) AS heavy_atoms, CAST(CASE WHEN p_partkey % 5 < 3 THEN 3 * p_size + 3 WHEN p_partkey % 5 = 3 THEN 3 * p_size + 12 END AS INT) AS total_atoms,
            CASE WHEN p_partkey % 5 < 3 THEN 1 WHEN p_partkey % 5 = 3 THEN 0 END AS hbd, CASE WHEN p_partkey % 5 < 3 THEN 1 WHEN p_partkey % 5 = 3 THEN 0 END AS hba,
            CAST(CASE WHEN p_partkey % 5 < 3 THEN greatest(p_size - 2, 0) WHEN p_partkey % 5 = 3 THEN greatest(p_size - 1, 0) END AS INT) AS rotatable_bonds,
            CASE WHEN p_partkey % 5 < 3 THEN 0 WHEN p_partkey % 5 = 3 THEN 1 END AS rings, CASE WHEN p_partkey % 5 = 3 THEN 'c1ccccc1' END AS murcko_scaffold FROM part""",
        "descriptors_drugs": f"{_drug_sql()} SELECT ord, molecular_weight, clogp, tpsa, hbd, hba, rotatable_bonds, aromatic_rings, rings, stereocentres, 0 AS unassigned_stereocentres, alerts, murcko_scaffold FROM m",
        "triage_drugs": f"""{_drug_sql()}, f AS (SELECT *, min(ord) OVER (PARTITION BY k) AS first, 0 AS unassigned_stereocentres, CASE WHEN alerts = '' THEN 0 ELSE 1 END AS n_alerts FROM m)
            SELECT identifier, CASE WHEN first < ord THEN CAST(first AS VARCHAR) END AS duplicate_of, CASE WHEN first < ord THEN 1 ELSE 0 END AS report_group, CASE WHEN first = ord THEN round({_SCORE}, 4) END AS score, 2 AS passed,
            first = ord AND (k < 6 OR identifier = (SELECT max(identifier) FROM f g WHERE g.k >= 6 AND g.first = g.ord)) AS is_cluster_representative FROM f""",
        "sql_surface": f"""{P}, b AS (SELECT *, CAST(molecular_weight > 500 AS INT) + CAST(clogp > 5 AS INT) + CAST(hbd > 5 AS INT) + CAST(hba > 10 AS INT) AS broken_lipinski FROM p)
            SELECT ord, broken_lipinski, molecular_weight BETWEEN 160 AND 480 AND clogp BETWEEN -0.4 AND 5.6 AND total_atoms BETWEEN 20 AND 70 AS ghose, CASE WHEN parse_ok THEN {_REASON} END AS drop_reason, round({_SCORE}, 9) AS score FROM b""",
        "sql_similarity": f"{_FP} SELECT b AS id, round(c / (x + y - c), 9) AS similarity FROM s WHERE a + 1 = b",
        "report_counts": f"""{_REPORT} SELECT count(*) AS submitted, count(*) FILTER (g < 3) AS parsed, count(*) FILTER (g = 3) AS parse_failed, count(*) FILTER (g = 1) AS duplicates_removed,
            CAST(0 AS BIGINT) AS dropped_by_window, CAST(0 AS BIGINT) AS dropped_by_rule, CAST(0 AS BIGINT) AS dropped_by_alert, count(*) FILTER (g = 0) AS retained, count(DISTINCT least(k, 6)) FILTER (g = 0) AS clusters FROM f""",
        "report_page": f"""{_REPORT}, s AS (SELECT *, CASE WHEN g = 0 THEN {_SCORE} END AS score FROM f),
            t AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY score DESC, identifier, ord) AS place FROM s)
            SELECT row_number() OVER (ORDER BY g, place) - 1 AS rank, identifier, g AS report_group, CASE WHEN g = 1 THEN CAST(first AS VARCHAR) END AS duplicate_of, round(score, 4) AS score FROM t WHERE g > 0 OR place <= 5 QUALIFY rank < 200""",
        "generic_scaffold_groups": f"{_drug_sql()}, g AS (SELECT *, CASE k {' '.join(f'WHEN {i} THEN {_text(g)}' for i, g in enumerate(GENERIC))} END AS generic_scaffold FROM m) SELECT generic_scaffold, count(*) AS n, count(DISTINCT murcko_scaffold) AS scaffolds, min(ord) AS first_ord FROM g GROUP BY 1",
        "standardised_drugs": f"{_drug_sql()}, a AS (SELECT * FROM (VALUES {', '.join(f'({i}, {n})' for i, n in enumerate(HEAVY))}) t(k, atoms)) SELECT count(*) AS n, min(ord) AS first_ord, CAST(0 AS BIGINT) AS errors, CAST(1 AS BIGINT) AS spellings, any_value(atoms) AS atoms, true AS stable FROM m JOIN a USING (k) GROUP BY k",
        "butina_clusters": f"{_BUTINA}, k AS (SELECT c, row_number() OVER (ORDER BY size DESC, c) - 1 AS cluster_id FROM z) SELECT id, CAST(cluster_id AS BIGINT) AS cluster_id, p = c AS is_centroid FROM g JOIN k USING (c)",
        "cluster_check": f"{_BUTINA} SELECT g.id, size, m.id AS centroid, g.p = g.c OR EXISTS (SELECT 1 FROM e WHERE e.a = g.id AND e.b = m.id) AS within FROM g JOIN z USING (c) JOIN o m ON m.p = g.c",
        "leader_clusters": f"{_LEADER} SELECT g.id, m.id AS leader, g.p = g.c AS is_leader FROM g JOIN o m ON m.p = g.c",
        "distance_positions": """WITH f AS (SELECT row_number() OVER (ORDER BY vec_id) - 1 AS r, list_filter(range(0, 64), lambda i: embedding[i + 1] > 0) AS bits FROM embeddings),
            p AS (SELECT r AS i, unnest(list_distinct([r - 1, r // 2])) AS j FROM f WHERE r > 0)
            SELECT i * (i - 1) // 2 + j AS position, i AS row, j AS "column", CAST(CAST(1 AS FLOAT) - CAST(CASE WHEN len(a.bits) + len(b.bits) = 0 THEN 0 ELSE len(list_intersect(a.bits, b.bits)) / (len(a.bits) + len(b.bits) - len(list_intersect(a.bits, b.bits))) END AS FLOAT) AS DOUBLE) AS distance
            FROM p JOIN f a ON a.r = i JOIN f b ON b.r = j""",
        "nearest_all": f"{_FP} SELECT a AS q, b AS t, round(c / (x + y - c), 9) AS similarity, row_number() OVER (PARTITION BY a ORDER BY c / (x + y - c) DESC, b) AS rank FROM s QUALIFY rank <= 5",
        "triage_end_to_end": f"{_MOL}, j AS (SELECT *, CASE WHEN key IS NOT NULL AND min(ord) OVER (PARTITION BY key) < ord THEN arg_min(identifier, ord) OVER (PARTITION BY key) END AS d FROM k) SELECT identifier, kind < 4 AS parse_ok, d AS duplicate_of, CASE WHEN kind = 4 THEN 3 WHEN d IS NOT NULL THEN 1 ELSE 0 END AS report_group FROM j",
        "scaffold_groups": f"{_MOL} SELECT CASE WHEN kind = 3 THEN 'c1ccccc1' END AS murcko_scaffold, count(*) AS n, min(ord) AS first_ord FROM m WHERE kind < 4 GROUP BY 1",
        "ndjson_rows": f"{_JUDGED} SELECT '{{\"ord\":' || ord || ',\"drop_reason\":' || coalesce('\"' || drop_reason || '\"', 'null') || '}}' AS value FROM j",
        "tanimoto_pairs": f"{_FP} SELECT a, b, round(c / (x + y - c), 9) AS similarity FROM s WHERE a < b AND c / (x + y - c) >= 0.5",
        "nearest_neighbours": f"{_FP} SELECT a AS q, b AS t, round(c / (x + y - c), 9) AS similarity, row_number() OVER (PARTITION BY a ORDER BY c / (x + y - c) DESC, b) AS rank FROM s WHERE a % 50 = 0 QUALIFY rank <= 3",
    }
    return out
