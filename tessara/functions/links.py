"""Links from real numbers to parameters, and the normal distribution."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def softplus(x: Column) -> Column:
    return F.greatest(x, F.lit(0.0)) + F.log1p(F.exp(-F.abs(x)))


def sigma_link(x: Column, kind: str = "softplus", eps: float = 1e-3) -> Column:
    if kind not in ("softplus", "exp"):
        raise ValueError(f"unknown sigma link {kind!r}")
    return (softplus(x) if kind == "softplus" else F.exp(F.least(x, F.lit(20.0)))) + eps


def nu_link(x: Column, floor: float = 2.0) -> Column:
    return softplus(x) + floor


def normal_pdf(z: Column) -> Column:
    return F.exp(-z * z / 2) / 2.5066282746310002


def normal_cdf(z: Column) -> Column:
    """By the error function's polynomial 7.1.26 of Abramowitz and Stegun (error below 1e-7)."""
    x = F.abs(z) / 1.4142135623730951
    t = 1 / (1 + 0.3275911 * x)
    series = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))
    tail = series * F.exp(-x * x) / 2
    return F.when(z >= 0, 1 - tail).otherwise(tail)
