"""Output contracts: the fields of a result, their types and what holds for them, checked while it is written."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType


@dataclass(frozen=True)
class Field:
    """``rule``: SQL that a value must make true (null passes); ``required``: no nulls."""

    name: str
    type: str
    required: bool = False
    rule: str | None = None

    def broken(self) -> Column:
        out = F.col(f"`{self.name}`").isNull() if self.required else F.lit(False)
        return out | ~F.coalesce(F.expr(self.rule), F.lit(True)) if self.rule else out

    def says(self) -> str:
        return " and ".join(([f"{self.name} is not null"] if self.required else []) + ([self.rule] if self.rule else []))


def _plain(kind: DataType) -> str:
    return kind.simpleString()


def with_fields(df: DataFrame, contract: list[Field]) -> DataFrame:
    """The contract's fields in its order; a missing, further or mistyped one is an error that names it, before anything runs."""
    names = [f.name for f in contract]
    for what, found in (("lacks", [n for n in names if n not in df.columns]), ("has no place for", [c for c in df.columns if c not in names])):
        if found:
            raise ValueError(f"the result {what} {', '.join(found)}")
    for f in contract:
        given, wanted = _plain(df.schema[f.name].dataType), _plain(DataType.fromDDL(f.type))
        if given != wanted:
            raise ValueError(f"field {f.name} is {given}, not {wanted}")
    return df.select(*(f"`{n}`" for n in names))


def checked(df: DataFrame, contract: list[Field]) -> DataFrame:
    """The result in one projection that fails at the first row that breaks the contract, and names the field and what should hold."""
    rows = with_fields(df, contract)
    return rows.select(*(F.when(f.broken(), F.raise_error(F.lit(f"field {f.name} breaks its contract: {f.says()}")).cast(f.type)).otherwise(F.col(f"`{f.name}`")).alias(f.name) if f.required or f.rule else F.col(f"`{f.name}`") for f in contract))


def violations(contract: list[Field]) -> list[Column]:
    """How many rows break each field, as aggregates for ``agg`` or ``observe``."""
    return [F.count_if(f.broken()).alias(f.name) for f in contract if f.required or f.rule]


_RULES, _ALERTS = "array<struct<name string, passed boolean, violations array<string>>>", "array<struct<catalog string, name string, description string, atom_indices array<int>>>"
#: A row of a job's report.
REPORT = [
    Field("rank", "bigint", True, "rank >= 0"), Field("report_group", "int", True, "report_group BETWEEN 0 AND 3"), Field("ord", "bigint", True), Field("identifier", "string", True), Field("input_smiles", "string"),
    Field("parse_ok", "boolean", True), Field("parse_error", "string", rule="parse_ok = (parse_error IS NULL)"), Field("standard_smiles", "string", rule="parse_ok = (standard_smiles IS NOT NULL)"),
    Field("molecular_weight", "double", rule="molecular_weight > 0"), *(Field(n, "int", rule=f"{n} >= 0") for n in ("heavy_atoms", "total_atoms")), Field("clogp", "double", rule="NOT isnan(clogp)"), Field("tpsa", "double", rule="tpsa >= 0"),
    *(Field(n, "int", rule=f"{n} >= 0") for n in ("hbd", "hba", "rotatable_bonds", "aromatic_rings", "rings")), Field("fraction_csp3", "double", rule="fraction_csp3 BETWEEN 0 AND 1"), Field("formal_charge", "int"),
    *(Field(n, "int", rule=f"{n} >= 0") for n in ("stereocentres", "unassigned_stereocentres")), Field("rules", _RULES, True), Field("alerts", _ALERTS), Field("murcko_scaffold", "string"),
    Field("drop_reason", "string", rule="drop_reason IN ('dropped_by_window', 'dropped_by_rule', 'dropped_by_alert')"), Field("duplicate_of", "string", rule="duplicate_of IS NULL OR (parse_ok AND drop_reason IS NULL)"),
    Field("cluster_id", "bigint", rule="cluster_id >= 0"), Field("is_cluster_representative", "boolean", True, "NOT is_cluster_representative OR cluster_id IS NOT NULL"),
    Field("score", "double", rule="score BETWEEN 0 AND 1"), Field("score_breakdown", "map<string, double>"),
]
