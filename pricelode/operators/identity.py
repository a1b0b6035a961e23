"""Identities: suppression of physical duplicates, links that follow a stable key, unions in which one source wins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: What makes two winners the same physical offer.
PHYSICAL = ["state", "chain", "store", "folded", "cents", "valid_from", "valid_until", "image"]


def suppress_rescued(winners: DataFrame) -> DataFrame:
    """Where one physical offer has rescued and other rows, only the newest rescued one stays."""
    w = Window.partitionBy(*PHYSICAL)
    rank = F.row_number().over(w.orderBy(F.desc("rescue"), F.desc("collected_at"), F.desc("id")))
    rows = winners.withColumn("folded", F.lower("name")).withColumn("_rank", rank)
    mixed = F.bool_or("rescue").over(w) & F.bool_or(~F.col("rescue")).over(w)
    return rows.withColumn("_mixed", mixed).filter(~F.col("_mixed") | (F.col("_rank") == 1)).drop("_mixed", "_rank", "folded")


def null_safe(a: DataFrame, b: DataFrame, keys: list[str]) -> Column:
    """Equality on keys in which null equals null; it stays a hash join."""
    out = a[keys[0]].eqNullSafe(b[keys[0]])
    for k in keys[1:]:
        out = out & a[k].eqNullSafe(b[k])
    return out


def stable_links(links: DataFrame, keys: list[str], target: str) -> DataFrame:
    """Keys that were ever linked to exactly one target; an ambiguous key links to none."""
    found = links.groupBy(*keys).agg(F.min(target).alias(target), F.max(target).alias("_most"))
    return found.filter(F.col(target) == F.col("_most")).drop("_most")


def first_of_sources(parts: list[DataFrame], keys: list[str]) -> DataFrame:
    """Union in which, for each key, the row of the earliest part stays (rows are unique by key within a part)."""
    ranked = [p.withColumn("_part", F.lit(i)) for i, p in enumerate(parts)]
    rows = ranked[0]
    for r in ranked[1:]:
        rows = rows.unionByName(r)
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy("_part"))
    return rows.withColumn("_rank", rank).filter("_rank = 1").drop("_rank", "_part")
