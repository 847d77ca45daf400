"""Cosine distance and weighted lane fusion as column expressions."""

from pyspark.sql import Column, functions as F

# Fixed weights of the named lane presets.
LANE_PRESETS = {
    "balanced": {"w_func": 0.6, "w_call": 0.2, "w_class": 0.2, "w_fts": 0.1},
    "func": {"w_func": 0.7, "w_call": 0.15, "w_class": 0.05, "w_fts": 0.1},
    "call": {"w_func": 0.15, "w_call": 0.7, "w_class": 0.05, "w_fts": 0.1},
    "class": {"w_func": 0.15, "w_call": 0.05, "w_class": 0.7, "w_fts": 0.1},
}
DEFAULT_WEIGHTS = LANE_PRESETS["balanced"]


def lane_weights(lane: str | None = None, overrides: dict | None = None) -> dict:
    """Preset weights; a partial override keeps the default for the rest."""
    return {**LANE_PRESETS[lane or "balanced"], **(overrides or {})}


def _col(c):
    return F.col(c) if isinstance(c, str) else c


def dot(a, b) -> Column:
    products = F.zip_with(_col(a), _col(b), lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def norm(a) -> Column:
    return F.sqrt(dot(a, a))


def cosine_distance(a, b) -> Column:
    """1 - cos(a, b) in double; NULL when a vector is missing or all zero."""
    length = norm(a) * norm(b)
    return F.when(length > 0, F.lit(1.0) - dot(a, b) / length)


def vector_literal(values) -> Column:
    return F.lit([float(v) for v in values])


def fused_score(weights: dict) -> Column:
    """Weighted distances minus the weighted text rank; lower is better."""
    return (
        F.lit(weights["w_func"]) * F.col("d_func")
        + F.lit(weights["w_call"]) * F.col("d_call")
        + F.lit(weights["w_class"]) * F.col("d_class")
        - F.lit(weights["w_fts"]) * F.col("ts_score")
    )
