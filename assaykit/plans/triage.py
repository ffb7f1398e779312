"""The triage plan: kernel, filters, dedup, score, clusters, report and counts.

The described rows are written once (``materialised``) and everything after reads them, so
that the kernel runs once per molecule however many branches the report has.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import asdict, dataclass, field, fields

import pyarrow as pa
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..functions import rules as R
from ..functions.score import DEFAULT_WEIGHTS, check_weights, composite_score
from ..kernel import CATALOGS
from ..kernel.alerts import ENTRIES, Entry
from ..operators import selection as S
from ..operators.similarity import butina, leader_clusters, numbered_leaders
from ..sources.contract import REPORT, checked
from ..sources.shared import Tables, written
from ..sources.sinks import write_pages

DESCRIPTORS = {
    "molecular_weight": pa.float64(), "heavy_atoms": pa.int32(), "total_atoms": pa.int32(), "clogp": pa.float64(), "tpsa": pa.float64(), "hbd": pa.int32(), "hba": pa.int32(),
    "rotatable_bonds": pa.int32(), "aromatic_rings": pa.int32(), "rings": pa.int32(), "fraction_csp3": pa.float64(), "formal_charge": pa.int32(), "stereocentres": pa.int32(),
    "unassigned_stereocentres": pa.int32(),
}
_SQL = {pa.float64(): "double", pa.int32(): "int"}
_ALERT = pa.list_(pa.struct([("catalog", pa.string()), ("name", pa.string()), ("description", pa.string()), ("atom_indices", pa.list_(pa.int32()))]))
_HEAD = {"parse_ok": pa.bool_(), "parse_error": pa.string(), "standard_smiles": pa.string(), "murcko_scaffold": pa.string(), "alerts": _ALERT, "fingerprint": pa.list_(pa.int32())}
_HEAD_SQL = "parse_ok boolean, parse_error string, standard_smiles string, murcko_scaffold string, alerts array<struct<catalog string, name string, description string, atom_indices array<int>>>, fingerprint array<int>"
Table = Callable[[DataFrame], DataFrame]
#: Different texts whose results a task holds at once.
MOST_TEXTS = 10_000


#: The rows, computed once: a table in the shared folder.
materialised = written


@dataclass(frozen=True)
class TriageConfig:
    """What a run does; names that are not known and bounds that contradict are errors at once.

    Butina clusters of more than ``max_cluster_rows`` rows are refused (None: never); ``cluster_method`` "leader"
    takes any number.
    """

    standardize: bool = True
    deduplicate: bool = True
    rule_sets: tuple[str, ...] = ("veber",)
    drop_rule_failures: bool = False
    descriptor_windows: dict[str, tuple[float | None, float | None]] = field(default_factory=dict)
    alert_catalogs: tuple[str, ...] = ("pains", "brenk")
    drop_alert_hits: bool = False
    cluster: bool = True
    cluster_cutoff: float = 0.35
    cluster_method: str = "butina"
    max_cluster_rows: int | None = 20_000
    fingerprint_radius: int = 2
    fingerprint_bits: int = 2048
    top_n: int | None = None
    representatives_only: bool = False
    score_weights: dict[str, float] = field(default_factory=lambda: dict(DEFAULT_WEIGHTS))

    def __post_init__(self) -> None:
        check_weights(self.score_weights)
        for names, known, what in ((self.rule_sets, R.RULES, "rule set"), (self.alert_catalogs, CATALOGS, "alert catalog"), (self.descriptor_windows, DESCRIPTORS, "descriptor")):
            for name in names:
                if name not in known:
                    raise KeyError(f"unknown {what} {name!r}; there are {', '.join(known)}")
        for key, (low, high) in self.descriptor_windows.items():
            if low is not None and high is not None and low > high:
                raise ValueError(f"window of {key}: {low} > {high}")
        for ok, text in (
            (self.top_n is None or self.top_n >= 1, "top_n must be at least 1"),
            (0 <= self.cluster_cutoff <= 1, "cluster_cutoff must be 0 to 1"),
            (self.cluster_method in ("butina", "leader"), "cluster_method must be butina or leader"),
            (1 <= self.fingerprint_radius <= 4, "fingerprint_radius must be 1 to 4"),
            (512 <= self.fingerprint_bits <= 8192, "fingerprint_bits must be 512 to 8192"),
            (self.cluster or not self.representatives_only, "representatives_only needs cluster"),
        ):
            if not ok:
                raise ValueError(text)

    def to_json(self) -> str:
        return json.dumps(asdict(self))

    @classmethod
    def from_json(cls, text: str) -> TriageConfig:
        """A configuration from a JSON object; names that are not known are errors."""
        given = json.loads(text)
        unknown = sorted(set(given) - {f.name for f in fields(cls)})
        if unknown:
            raise KeyError(f"unknown settings: {', '.join(unknown)}")
        for name in ("rule_sets", "alert_catalogs"):
            if name in given:
                given[name] = tuple(given[name])
        if "descriptor_windows" in given:
            given["descriptor_windows"] = {k: (v.get("min"), v.get("max")) if isinstance(v, dict) else tuple(v) for k, v in given["descriptor_windows"].items()}
        return cls(**given)


def spread(library: DataFrame) -> DataFrame:
    """A batch library of fewer partitions than cores, over all cores: short rows, long work."""
    if library.isStreaming:
        return library
    cores = library.sparkSession.sparkContext.defaultParallelism
    return library.repartition(cores) if library.rdd.getNumPartitions() < cores else library


def _once(texts: pa.Array, work: Callable[[str], list], kinds: list[pa.DataType], held: dict[str, list]) -> list[pa.Array]:
    """Columns of ``work(text)`` for each text: each different one is worked on once; ``held`` keeps what it gave for the batches that follow."""
    codes = texts.fill_null("").dictionary_encode()
    rows = []
    for text in codes.dictionary.to_pylist():
        if text not in held:
            if len(held) >= MOST_TEXTS:
                held.clear()
            held[text] = work(text)
        rows.append(held[text])
    return [pa.array([r[k] if k < len(r) else None for r in rows], t).take(codes.indices) for k, t in enumerate(kinds)]


def describe(library: DataFrame, standardize: bool = True, catalogs: tuple[str, ...] = (), radius: int = 2, n_bits: int = 2048, entries: tuple[Entry, ...] = ENTRIES) -> DataFrame:
    """Adds what the kernel finds of ``input_smiles``: parse_ok, parse_error, standard_smiles, murcko_scaffold, alerts, fingerprint, descriptors.

    A bad record has parse_ok false and a parse_error; it never fails the job. A text that a task meets again
    (copies are a large part of what is submitted) costs a look-up, not another pass of the kernel.
    """
    keep = library.columns
    schema = ", ".join([f"`{c}` {t}" for c, t in library.dtypes] + [_HEAD_SQL] + [f"{d} {_SQL[t]}" for d, t in DESCRIPTORS.items()])
    at = keep.index("input_smiles")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from .. import kernel as K

        def one(text: str) -> list:
            shown = repr(text.strip()[:60]) + ("..." if len(text.strip()) > 60 else "")
            try:
                mol = K.parse(text)
            except K.SmilesError as e:
                return [False, f"could not parse SMILES {shown}: {e}"]
            try:
                mol = K.standardise(mol) if standardize else mol
                d = K.descriptors(mol)
                return [True, None, K.write(mol), K.scaffold(mol), K.find_alerts(mol, catalogs, entries) if catalogs else [], K.fingerprint(mol, radius, n_bits), *(d[k] for k in DESCRIPTORS)]
            except Exception as e:  # noqa: BLE001  one record must not fail the others
                return [False, f"{type(e).__name__}: {e}"]

        names, kinds = [*_HEAD, *DESCRIPTORS], [*_HEAD.values(), *DESCRIPTORS.values()]
        held: dict[str, list] = {}
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, *_once(batch.column(at), one, kinds, held)], names=[*keep, *names])

    return spread(library).mapInArrow(run, schema)


def standardised(library: DataFrame) -> DataFrame:
    """(ord, identifier, input_smiles, standard_smiles, error): the kernel's first half only; a bad record has an error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from .. import kernel as K

        def one(text: str) -> list[str | None]:
            try:
                return [K.write(K.standardise(K.parse(text))), None]
            except Exception as e:  # noqa: BLE001  one record must not fail the others
                return [None, f"could not standardise: {e}"]

        held: dict[str, list] = {}
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, *_once(batch.column(2), one, [pa.string(), pa.string()], held)], names=["ord", "identifier", "input_smiles", "standard_smiles", "error"])

    rows = spread(library.select(F.col("ord").cast("bigint"), F.col("identifier").cast("string"), "input_smiles"))
    return rows.mapInArrow(run, "ord bigint, identifier string, input_smiles string, standard_smiles string, error string")


def generic_scaffolds(described: DataFrame) -> DataFrame:
    """Adds ``generic_scaffold``: each different Murcko scaffold is worked on once; null without one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from .. import kernel as K

        for batch in batches:
            texts = batch.column(0).to_pylist()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([K.generic_scaffold(K.parse(t)) for t in texts], pa.string())], names=["__scaffold", "generic_scaffold"])

    each = described.where(F.col("murcko_scaffold").isNotNull()).select(F.col("murcko_scaffold").alias("__scaffold")).distinct()
    found = each.mapInArrow(run, "__scaffold string, generic_scaffold string")
    return described.join(found, F.col("murcko_scaffold") == F.col("__scaffold"), "left").drop("__scaffold")


def finalize(described: DataFrame, config: TriageConfig, table: Table = materialised, counts: Observation | None = None) -> DataFrame:
    """Adds rules, drop_reason, duplicate_of, score, score_breakdown, cluster_id and is_cluster_representative.

    ``counts`` observes the rows (``selection.count_columns``) as they are written for the steps after.
    """
    ok = F.col("parse_ok")
    empty = F.array().cast("array<struct<name string, passed boolean, violations array<string>>>")
    rows = described.withColumn("rules", F.when(ok, R.evaluate(list(config.rule_sets), described.columns)).otherwise(empty) if config.rule_sets else empty)
    n_alerts = F.size("alerts") if "alerts" in described.columns else F.lit(0)
    rows = rows.withColumn("drop_reason", F.when(ok, R.drop_reason(config.descriptor_windows, F.col("rules") if config.drop_rule_failures else None, n_alerts if config.drop_alert_hits else None)))
    live = ok & F.col("drop_reason").isNull()
    rows = rows.withColumn("key", F.when(live, F.nullif("standard_smiles", F.lit(""))))
    rows = S.deduplicate(rows).drop("key") if config.deduplicate else rows.drop("key").withColumn("duplicate_of", F.lit(None).cast("string"))
    kept = live & F.col("duplicate_of").isNull()
    score, breakdown = composite_score(config.score_weights, F.col("rules"), n_alerts)
    rows = rows.withColumn("score", F.when(kept, score)).withColumn("score_breakdown", F.when(kept, breakdown))
    rows = table(rows.observe(counts, *S.count_columns()) if counts is not None else rows)
    if not config.cluster:
        return rows.withColumn("cluster_id", F.lit(None).cast("bigint")).withColumn("is_cluster_representative", F.lit(False))
    bits = F.when(F.col("fingerprint").isNull(), F.raise_error(F.concat(F.lit("no fingerprint to cluster for "), "identifier"))).otherwise(F.col("fingerprint"))
    sets = rows.where(kept).select("ord", bits.cast("array<int>").alias("fingerprint"))
    if config.cluster_method == "leader":
        found = numbered_leaders(leader_clusters(sets, config.cluster_cutoff, "ord", "fingerprint", table=table), "ord", table)
    else:
        found = butina(sets, config.cluster_cutoff, "ord", "fingerprint", config.max_cluster_rows, table)
    found = found.select("ord", "cluster_id")
    return S.representatives(rows.join(found, "ord", "left"))


def _grouped(rows: DataFrame, config: TriageConfig) -> DataFrame:
    """Rows of the report before the cut, with report_group 0 to 3."""
    group = F.when(~F.col("parse_ok"), 3).when(F.col("drop_reason").isNotNull(), 2).when(F.col("duplicate_of").isNotNull(), 1).otherwise(0)
    out = rows.withColumn("report_group", group)
    return out.where((F.col("report_group") > 0) | F.col("is_cluster_representative")) if config.representatives_only else out


def report(rows: DataFrame, config: TriageConfig) -> DataFrame:
    """Shortlist, duplicates, dropped and failed rows in that order, with report_group 0 to 3."""
    out = _grouped(rows, config)
    if config.top_n is not None:
        out = S.top_n(out.where("report_group = 0"), config.top_n).unionByName(out.where("report_group > 0"))
    return out.drop("fingerprint").orderBy("report_group", F.desc("score"), "identifier", "ord")


def write_report(library: DataFrame, config: TriageConfig, path: str, entries: tuple[Entry, ...] = ENTRIES, phase: Callable[[str], None] = lambda name: None, rows_per_file: int = 50_000) -> dict[str, int]:
    """Writes the report as pages under ``path`` and returns the counts.

    Everything that is counted is counted while rows are written that the plan writes anyway:
    submitted to retained with the scored rows, clusters (a representative each) with the sorted ones.
    The tables in between are removed at the end.
    """
    table = Tables(library.sparkSession)
    try:
        return _write_report(library, config, path, table, entries, phase, rows_per_file)
    finally:
        table.drop()


def _write_report(library: DataFrame, config: TriageConfig, path: str, table: Table, entries: tuple[Entry, ...], phase: Callable[[str], None], rows_per_file: int) -> dict[str, int]:
    phase("per_molecule")
    described = table(describe(library, config.standardize, config.alert_catalogs, config.fingerprint_radius, config.fingerprint_bits, entries))
    phase("deduplicate")
    counts, clusters = Observation("counts"), Observation("clusters")
    rows = _grouped(finalize(described, config, table, counts), config).drop("fingerprint")
    phase("report")

    def sorted_table(df: DataFrame) -> DataFrame:
        return table(df.observe(clusters, F.count_if("is_cluster_representative").alias("clusters"), F.count_if(F.col("report_group") == 0).alias("short")))

    ranked = S.dense_index(rows, ["report_group", F.desc("score"), "identifier", "ord"], "rank", sorted_table)
    if config.top_n is not None:
        cut = max(0, clusters.get["short"] - config.top_n)
        ranked = ranked.where((F.col("report_group") > 0) | (F.col("rank") < config.top_n)).withColumn("rank", F.when(F.col("report_group") > 0, F.col("rank") - cut).otherwise(F.col("rank")))
    write_pages(checked(ranked.withColumn("rank", F.col("rank").cast("bigint")), REPORT), path, rows_per_file)
    return {**counts.get, "clusters": clusters.get["clusters"]}


def triage(library: DataFrame, config: TriageConfig = TriageConfig(), table: Table = materialised, entries: tuple[Entry, ...] = ENTRIES) -> tuple[DataFrame, DataFrame]:
    """(report, counts) of a library (ord, identifier, input_smiles)."""
    described = table(describe(library, config.standardize, config.alert_catalogs, config.fingerprint_radius, config.fingerprint_bits, entries))
    rows = finalize(described, config, table)
    return report(rows, config), S.counts(rows, config.cluster)
