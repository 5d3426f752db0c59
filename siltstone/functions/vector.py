"""Vector metrics and checks as expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

METRICS = ("COSINE", "IP", "L2")


def narrow(v: Column) -> Column:
    """Model output is stored in single precision; what is lost is part of the result."""
    return v.cast("array<float>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Null if either vector is null or zero."""
    return F.try_divide(dot(a, b), norm(a) * norm(b))


def l2(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") - y.cast("double")), F.lit(0.0), lambda s, x: s + x * x))


def metric(name: str | None) -> str:
    """A metric's canonical name; blank means cosine, anything unknown is an error."""
    wanted = (name or "").strip().upper() or "COSINE"
    if wanted not in METRICS:
        raise ValueError(f"unknown metric {name!r}")
    return wanted


def score(name: str | None, a: Column, b: Column) -> Column:
    return {"COSINE": cosine, "IP": dot, "L2": l2}[metric(name)](a, b)


def ascending(name: str | None) -> bool:
    """Whether lower scores are better."""
    return metric(name) == "L2"


def is_valid(v: Column, dim: int) -> Column:
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce((F.size(v) == dim) & ~bad, F.lit(False))
