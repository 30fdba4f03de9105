"""Correctness and reward rules as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from veracity.functions.text import col_, py_strip


def substring_correctness(answer: Column | str, gold: Column | str) -> Column:
    """10 when the lower-cased, stripped gold text is inside the answer, else 0."""
    a = F.lower(py_strip(col_(answer)))
    g = F.lower(py_strip(col_(gold)))
    return F.when(a.contains(g), F.lit(10.0)).otherwise(F.lit(0.0))


def _clamp_out_of_range(x: Column) -> Column:
    # Values outside [0, 10] are clamped to [0, 1] (not [0, 10]) before scaling.
    return F.when(x.between(0, 10), x).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), x)))


def reward(correctness: Column | str, confidence: Column | str,
           variant: str = "quadratic") -> Column:
    """Reward of a (correctness, confidence) pair, both nominally 0..10.

    ``quadratic``: ``2 * (0.5 - (corr/10 - conf/10)^2)`` in [-1, 1].
    ``sign``: ``conf/10`` when correctness >= 5 else ``-conf/10``.
    """
    corr = _clamp_out_of_range(col_(correctness).cast("double")) / 10.0
    conf = _clamp_out_of_range(col_(confidence).cast("double")) / 10.0
    if variant == "quadratic":
        return 2.0 * (F.lit(0.5) - F.pow(corr - conf, 2))
    if variant == "sign":
        return F.when(col_(correctness) >= 5, conf).otherwise(-conf)
    raise ValueError(f"unknown reward variant {variant!r}")


def out_of_range(correctness: Column | str, confidence: Column | str) -> Column:
    """True when either input is outside [0, 10] (the rule's warning case)."""
    return ~(col_(correctness).between(0, 10) & col_(confidence).between(0, 10))


def clean_reward(r: Column | str) -> Column:
    """NaN -> 0, +inf -> largest double, -inf -> lowest double."""
    c = col_(r)
    big = 1.7976931348623157e308
    return (F.when(F.isnan(c), F.lit(0.0))
            .when(c == float("inf"), F.lit(big))
            .when(c == float("-inf"), F.lit(-big))
            .otherwise(c))
