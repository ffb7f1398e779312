"""Drug-likeness rules and descriptor windows as column expressions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Bound:
    key: str
    label: str
    low: float | None = None
    high: float | None = None


_MW, _LOGP, _TPSA, _ROT = ("molecular_weight", "MW"), ("clogp", "clogp"), ("tpsa", "TPSA"), ("rotatable_bonds", "rotatable bonds")
_HBD, _HBA, _ATOMS = ("hbd", "HBD"), ("hba", "HBA"), ("total_atoms", "atoms")
#: Published bounds (fixed values): rule, allowed violations, bounds.
RULES: dict[str, tuple[int, list[Bound]]] = {
    "lipinski": (1, [Bound(*_MW, high=500), Bound(*_LOGP, high=5), Bound(*_HBD, high=5), Bound(*_HBA, high=10)]),
    "veber": (0, [Bound(*_ROT, high=10), Bound(*_TPSA, high=140)]),
    "egan": (0, [Bound(*_TPSA, high=131.6), Bound(*_LOGP, low=-1, high=5.88)]),
    "ghose": (0, [Bound(*_MW, low=160, high=480), Bound(*_LOGP, low=-0.4, high=5.6), Bound(*_ATOMS, low=20, high=70)]),
    "lead_like": (0, [Bound(*_MW, high=350), Bound(*_LOGP, high=3.5), Bound(*_ROT, high=7)]),
    "fragment": (0, [Bound(*_MW, high=300), Bound(*_LOGP, high=3), Bound(*_HBD, high=3), Bound(*_HBA, high=3), Bound(*_ROT, high=3)]),
}


def number_text(v: Column) -> Column:
    """Two decimals at most, none for whole numbers, six significant digits."""
    r, size = F.round(v.cast("double"), 2), F.abs(F.round(v.cast("double"), 2))
    bare = lambda s: F.regexp_replace(s, r"\.?0+$", "")
    digits = F.when(size < 1e4, bare(F.format_string("%.2f", r))).when(size < 1e5, bare(F.format_string("%.1f", r))).otherwise(F.format_string("%.0f", r))
    large = F.concat(bare(F.substring_index(F.format_string("%.5e", r), "e", 1)), F.lit("e"), F.substring_index(F.format_string("%.5e", r), "e", -1))
    return F.when(r == F.floor(r), r.cast("bigint").cast("string")).when(size >= 1e6, large).otherwise(digits)


def _limit_text(x: float) -> str:
    return str(int(x)) if x == int(x) else f"{x:g}"


def usable(raw: Column, key: str) -> Column:
    """The value as a double; a row where it is absent, NaN or infinite fails the query."""
    v = raw.cast("double")
    bad = v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))
    return F.when(bad, F.raise_error(F.lit(f"{key} has no finite value")).cast("double")).otherwise(v)


def violations(bounds: list[Bound], columns: list[str], rule: str = "bounds", prefix: str = "") -> Column:
    """Messages of broken bounds in order; an absent or not finite value raises, so that no row passes for lack of one."""
    out = []
    for b in bounds:
        if b.key not in columns:
            raise KeyError(f"no column {b.key!r} for rule {rule}")
        raw = F.col(f"{prefix}{b.key}")
        v = usable(raw, b.key)
        if b.high is not None:
            out.append(F.when(v > b.high, F.concat(F.lit(f"{b.label} "), number_text(raw), F.lit(f" > {_limit_text(b.high)}"))))
        if b.low is not None:
            out.append(F.when(v < b.low, F.concat(F.lit(f"{b.label} "), number_text(raw), F.lit(f" < {_limit_text(b.low)}"))))
    return F.filter(F.array(*out), lambda x: x.isNotNull())


def evaluate(rules: list[str], columns: list[str], prefix: str = "") -> Column:
    """array<struct<name, passed, violations>> in order of first request."""
    out = []
    for name in dict.fromkeys(rules):
        if name not in RULES:
            raise KeyError(f"unknown rule set {name!r}")
        allowed, bounds = RULES[name]
        v = violations(bounds, columns, name, prefix)
        out.append(F.struct(F.lit(name).alias("name"), (F.size(v) <= allowed).alias("passed"), v.alias("violations")))
    return F.array(*out)


def within(key: str, low: float | None = None, high: float | None = None) -> Column:
    """Inclusive window; NaN passes, as no comparison with it holds. A row where the value is absent fails the query."""
    if low is not None and high is not None and low > high:
        raise ValueError(f"window of {key}: {low} > {high}")
    raw = F.col(key).cast("double")
    v, out = F.when(raw.isNull(), F.raise_error(F.lit(f"{key} has no value")).cast("double")).otherwise(raw), F.lit(False)
    if low is not None:
        out |= v < low
    if high is not None:
        out |= v > high
    return F.isnan(v) | ~out


def drop_reason(windows: dict[str, tuple[float | None, float | None]], rules: Column | None, n_alerts: Column | None) -> Column:
    """First match of window, rule, alert; null when the row stays."""
    reason = F.lit(None).cast("string")
    if n_alerts is not None:
        reason = F.when(n_alerts > 0, "dropped_by_alert").otherwise(reason)
    if rules is not None:
        reason = F.when(F.exists(rules, lambda r: ~r["passed"]), "dropped_by_rule").otherwise(reason)
    for key, (low, high) in windows.items():
        reason = F.when(~within(key, low, high), "dropped_by_window").otherwise(reason)
    return reason


def with_rules(df: DataFrame, rules: list[str]) -> DataFrame:
    return df.withColumn("rules", evaluate(rules, df.columns))
