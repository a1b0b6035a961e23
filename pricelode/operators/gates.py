"""Routing with reasons: every row gets one route and the sorted reasons for it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def reasons(rules: dict[str, Column]) -> Column:
    """Sorted names of the rules that hold (null counts as not)."""
    return F.array_sort(F.array_compact(F.array(*(F.when(c, F.lit(name)) for name, c in rules.items()))))


def route(found: Column, hard: list[str]) -> Column:
    """ready without reasons, excluded with a hard one, else review."""
    return F.when(F.size(found) == 0, "ready").when(F.arrays_overlap(found, F.array(*map(F.lit, hard))), "excluded").otherwise("review")


def cascade(rules: list[tuple[str, Column]], other: str) -> Column:
    """Name of the first rule that holds."""
    out = F.when(rules[0][1], F.lit(rules[0][0]))
    for name, c in rules[1:]:
        out = out.when(c, F.lit(name))
    return out.otherwise(F.lit(other))


def score(weights: list[tuple[float, Column]]) -> Column:
    """Sum of the weights whose condition holds."""
    out = F.lit(0.0)
    for w, c in weights:
        out = out + F.when(c, F.lit(w)).otherwise(F.lit(0.0))
    return out
