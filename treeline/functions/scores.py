"""Weights, step scores and grades."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Weight of each dimension. Fixed values.
WEIGHTS = {"mc": 15, "cd": 10, "fi": 15, "dc": 10, "fs": 10, "td": 15, "mf": 15, "re": 10}

#: Upper bounds and their scores, then the score beyond. Fixed values.
LADDERS = {
    "mc": (((0.2, 10), (0.35, 8), (0.5, 6)), 4),
    "cd": (((0, 10), (2, 6)), 3),
    "fi": (((0.05, 10), (0.1, 8), (0.2, 6)), 4),
    "dc": (((0.1, 10), (0.25, 8), (0.45, 6), (0.65, 4)), 2),
    "fs": (((0.05, 10), (0.1, 8), (0.2, 6)), 4),
    "td": (((1, 10), (3, 8), (6, 6)), 4),
    "mf": (((0.15, 10), (0.25, 8), (0.40, 6)), 4),
    "re": (((0.10, 10), (0.20, 8), (0.35, 6)), 4),
}


def step_score(dimension: str, value: Column) -> Column:
    steps, beyond = LADDERS[dimension]
    found = F.when(value.isNull(), F.lit(None).cast("int"))
    for bound, score in steps:
        found = found.when(value <= bound, score)
    return found.otherwise(beyond)


def ratio(part: Column, whole: Column) -> Column:
    return part / F.greatest(whole, F.lit(1))


def grade(total: Column) -> Column:
    return F.when(total >= 850, "A").when(total >= 700, "B").when(total >= 500, "C").otherwise("D")


def call_weight(times: Column) -> Column:
    """1 + log2 of a call count, at most 5."""
    return F.least(F.lit(1.0) + F.log2(F.greatest(times, F.lit(1)).cast("double")), F.lit(5.0))


def fan_in_band(n: Column) -> Column:
    return F.when(n > 5, 3).when(n > 2, 2).when(n > 0, 1).when(n == 0, 0)


def coverage_band(percent: Column) -> Column:
    return F.when(percent <= 0, 3).when(percent <= 50, 2).otherwise(1)
