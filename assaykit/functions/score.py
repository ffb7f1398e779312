"""The composite score: a weighted geometric mean of named components."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Component order and constants (fixed values).
COMPONENTS = ("rule_compliance", "alert_penalty", "property_centrality", "complexity_penalty")
DEFAULT_WEIGHTS = {"property_centrality": 1.0, "alert_penalty": 0.5, "complexity_penalty": 0.25}
CENTRES = {"molecular_weight": (350.0, 150.0), "clogp": (2.5, 2.0), "tpsa": (75.0, 50.0)}
FLOOR, STEREO_COST, RING_COST, FREE_RINGS = 1e-6, 0.35, 0.20, 4


def rule_compliance(rules: Column) -> Column:
    return F.when(F.size(rules) > 0, F.size(F.filter(rules, lambda r: r["passed"])) / F.greatest(F.size(rules), F.lit(1))).otherwise(1.0)


def alert_penalty(n_alerts: Column) -> Column:
    return F.when(n_alerts < 0, F.raise_error(F.lit("negative number of alerts")).cast("double")).otherwise(1 / (1 + n_alerts.cast("double")))


def _number(key: str) -> Column:
    """The descriptor as a double; a row where it is absent, NaN or infinite fails the query."""
    v = F.col(key).cast("double")
    bad = v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))
    return F.when(bad, F.raise_error(F.lit(f"no score without a usable value of {key}")).cast("double")).otherwise(v)


def property_centrality() -> Column:
    out = F.lit(1.0)
    for key, (centre, width) in CENTRES.items():
        out = out * F.exp(-F.pow((_number(key) - centre) / width, 2) / 2)
    return out


def complexity_penalty() -> Column:
    return 1 / (1 + STEREO_COST * _number("unassigned_stereocentres") + RING_COST * F.greatest(F.lit(0.0), _number("rings") - FREE_RINGS))


def check_weights(weights: dict[str, float]) -> dict[str, float]:
    for name, w in weights.items():
        if name not in COMPONENTS:
            raise KeyError(f"no component {name!r} in the score; choose from {', '.join(COMPONENTS)}")
        if not 0 <= w < float("inf"):
            raise ValueError(f"weight of {name} must be a number of at least 0")
    if sum(weights.values()) <= 0:
        raise ValueError("score weights must add up to more than 0")
    return weights


def composite_score(weights: dict[str, float] | None = None, rules: Column | None = None, n_alerts: Column | None = None) -> tuple[Column, Column]:
    """(score, breakdown) with the unweighted components that ``weights`` names."""
    weights = check_weights(DEFAULT_WEIGHTS if weights is None else weights)
    build = {
        "rule_compliance": lambda: rule_compliance(rules) if rules is not None else F.lit(1.0), "alert_penalty": lambda: alert_penalty(n_alerts if n_alerts is not None else F.lit(0)),
        "property_centrality": property_centrality, "complexity_penalty": complexity_penalty,
    }
    used = [(c, build[c]()) for c in COMPONENTS if c in weights]
    total = sum(weights.values())
    mean = sum((weights[c] * F.ln(F.greatest(v, F.lit(FLOOR))) for c, v in used), F.lit(0.0)) / total
    breakdown = F.map_from_arrays(F.array(*(F.lit(c) for c, _ in used)), F.array(*(v.cast("double") for _, v in used)))
    return F.least(F.greatest(F.exp(mean), F.lit(0.0)), F.lit(1.0)), breakdown
