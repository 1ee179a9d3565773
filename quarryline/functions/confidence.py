"""Confidence and verdicts (inventory A-01 to A-06, Q-19): signals are structs of name, value and weight."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ISSUE = "struct<code:string,severity:string>"


def signal(name: str, value: Column, weight: float = 1.0) -> Column:
    return F.struct(F.lit(name).alias("name"), value.cast("double").alias("value"), F.lit(float(weight)).alias("weight"))


def mean_of(signals: Column) -> Column:
    """A-01: weighted mean rounded to 6 places; 0 without signals or weight."""
    total = F.aggregate(signals, F.lit(0.0), lambda s, x: s + x.weight)
    value = F.aggregate(signals, F.lit(0.0), lambda s, x: s + x.value * x.weight)
    return F.when(total > 0, F.round(value / total, 6)).otherwise(F.lit(0.0))


def combined(*signals: Column) -> Column:
    """A-02: from the signals of several; their own scores don't count."""
    return mean_of(F.concat(*signals))


def weighted_score(parts: dict[str, tuple[Column, float]]) -> Column:
    """A-03: weighted mean, 1 at most, rounded to 6 places."""
    weight = sum(w for _, w in parts.values())
    if weight <= 0:
        return F.lit(0.0)
    return F.round(F.least(sum((v * F.lit(float(w)) for v, w in parts.values()), F.lit(0.0)) / F.lit(float(weight)), F.lit(1.0)), 6)


def level(score: Column) -> Column:
    return F.when(score <= 0, "none").when(score < 0.5, "low").when(score < 0.8, "medium").otherwise("high")


def issues(*cases: tuple[Column, str | Column, str]) -> Column:
    """An array of (code, severity) of the cases that hold; a null condition doesn't. A code may be a column."""
    made = [F.when(F.coalesce(c, F.lit(False)), F.struct((code if isinstance(code, Column) else F.lit(code)).alias("code"), F.lit(severity).alias("severity"))) for c, code, severity in cases]
    return F.filter(F.array(*made), lambda x: x.isNotNull())


def succeeds(found: Column) -> Column:
    """A-04: no error and nothing fatal."""
    return ~F.exists(found, lambda x: x.severity.isin("error", "fatal"))


def codes(found: Column) -> Column:
    return F.array_join(F.transform(found, lambda x: x.code), ",")


def rate(part: Column, whole: Column) -> Column:
    """A-05: over measured rows only; null when nothing was measured."""
    measured = part.isNotNull() & whole.isNotNull()
    return F.sum(F.when(measured, part)) / F.nullif(F.sum(F.when(measured, whole)), F.lit(0))
