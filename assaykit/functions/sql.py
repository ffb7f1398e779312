"""The library's functions for SQL text: session functions that Catalyst inlines, none of them Python.

``register(spark)`` makes

* ``tanimoto(a, b)``: similarity of two arrays of on-bits,
* ``within_window(value, low, high)``: inclusive; null bounds don't bind, NaN passes, an absent value is an error,
* ``broken_<rule>(...)`` for each rule set: how many of its bounds are broken, and ``passes_<rule>(...)``; arguments are the rule's
  descriptors in the order of its bounds (``arguments``); an absent or not finite one is an error,
* ``drop_reason(outside, broken, alerted)``: the first that is true of window, rule and alert, else null,
* ``triage_score(molecular_weight, clogp, tpsa, unassigned_stereocentres, rings, n_alerts)``: the composite score with default weights.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from . import score as X
from .rules import RULES


def arguments(rule: str) -> list[str]:
    """Descriptors that a rule's functions take, in order."""
    return list(dict.fromkeys(b.key for b in RULES[rule][1]))


def _usable(key: str) -> str:
    bad = f"{key} IS NULL OR isnan({key}) OR abs({key}) = double('infinity')"
    return f"if({bad}, CAST(raise_error('{key} has no finite value') AS DOUBLE), {key})"


def _broken(rule: str) -> str:
    tests = [f"if({_usable(b.key)} {op} {limit}D, 1, 0)" for b in RULES[rule][1] for op, limit in ((">", b.high), ("<", b.low)) if limit is not None]
    return " + ".join(tests)


def _score() -> str:
    central = " * ".join(f"exp(-pow(({_usable(k)} - {c}D) / {w}D, 2) / 2)" for k, (c, w) in X.CENTRES.items())
    parts = {
        "property_centrality": central, "alert_penalty": "if(n_alerts < 0, CAST(raise_error('negative number of alerts') AS DOUBLE), 1D / (1 + n_alerts))",
        "complexity_penalty": f"1D / (1 + {X.STEREO_COST}D * {_usable('unassigned_stereocentres')} + {X.RING_COST}D * greatest(0D, {_usable('rings')} - {X.FREE_RINGS}))",
    }
    mean = " + ".join(f"{w}D * ln(greatest({parts[name]}, {X.FLOOR:.7f}D))" for name, w in X.DEFAULT_WEIGHTS.items())
    return f"least(greatest(exp(({mean}) / {sum(X.DEFAULT_WEIGHTS.values())}D), 0D), 1D)"


def definitions() -> dict[str, str]:
    """SQL of each function, by name."""
    out = {
        "tanimoto": "tanimoto(a ARRAY<INT>, b ARRAY<INT>) RETURNS DOUBLE RETURN if(size(array_union(a, b)) > 0, size(array_intersect(a, b)) / CAST(greatest(size(array_union(a, b)), 1) AS DOUBLE), 0D)",
        "within_window": "within_window(value DOUBLE, low DOUBLE, high DOUBLE) RETURNS BOOLEAN RETURN if(value IS NULL, CAST(raise_error('a window needs a value') AS BOOLEAN), isnan(value) OR NOT (coalesce(value < low, false) OR coalesce(value > high, false)))",
        "drop_reason": "drop_reason(outside BOOLEAN, broken BOOLEAN, alerted BOOLEAN) RETURNS STRING RETURN CASE WHEN outside THEN 'dropped_by_window' WHEN broken THEN 'dropped_by_rule' WHEN alerted THEN 'dropped_by_alert' END",
        "triage_score": f"triage_score(molecular_weight DOUBLE, clogp DOUBLE, tpsa DOUBLE, unassigned_stereocentres DOUBLE, rings DOUBLE, n_alerts INT) RETURNS DOUBLE RETURN {_score()}",
    }
    for rule, (allowed, _) in RULES.items():
        given = ", ".join(f"{a} DOUBLE" for a in arguments(rule))
        out[f"broken_{rule}"] = f"broken_{rule}({given}) RETURNS INT RETURN {_broken(rule)}"
        out[f"passes_{rule}"] = f"passes_{rule}({given}) RETURNS BOOLEAN RETURN ({_broken(rule)}) <= {allowed}"
    return out


def register(spark: SparkSession) -> list[str]:
    """Makes the functions in the session, over older ones of their names; returns the names."""
    for text in definitions().values():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {text}")
    return sorted(definitions())
