"""Comparing two states of a table: keyed diffs, accounting, pairing by content, order-independent digests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def keyed(old: DataFrame, new: DataFrame, keys: list[str], value: str) -> DataFrame:
    """added, removed, changed or kept, for every key of either side (keys are unique on each)."""
    a, b = old.select(*keys, F.col(value).alias("_a"), F.lit(True).alias("_o")), new.select(*keys, F.col(value).alias("_b"), F.lit(True).alias("_n"))
    kind = F.when(F.col("_o").isNull(), "added").when(F.col("_n").isNull(), "removed").when(F.col("_a").eqNullSafe(F.col("_b")), "kept").otherwise("changed")
    return a.join(b, keys, "full").select(*keys, kind.alias("kind"))


def retention(diff: DataFrame) -> DataFrame:
    """Kept, added and removed counts and the share kept of the old, to two places, half to even."""
    is_ = lambda k: F.count_if(F.col("kind").isin(*k))
    out = diff.agg(is_(["kept", "changed"]).alias("retained"), is_(["added"]).alias("added"), is_(["removed"]).alias("removed"))
    old = F.col("retained") + F.col("removed")
    return out.withColumn("retention_percent", F.when(old > 0, F.bround((F.col("retained") * 100).cast("decimal(20,0)") / old, 2).cast("double")))


def multiset_digest(columns: list[Column]) -> Column:
    """Aggregate: an order-independent digest of rows, the sum of 60-bit hash parts, which keeps repeats apart."""
    part = F.conv(F.substring(F.sha2(F.concat_ws("|", *columns), 256), 1, 15), 16, 10).cast("decimal(38,0)")
    return F.sum(part)


def rollover(old: DataFrame, new: DataFrame, place: str, content: str) -> DataFrame:
    """Pair rows of equal content: those at the same place first, then the others in order of place.

    kind: same, moved, old_only or new_only, with both places.
    """
    a, b = old.select(F.col(place).alias("old_place"), F.col(content).alias("c")), new.select(F.col(place).alias("new_place"), F.col(content).alias("c"))
    same = a.join(b, (a["c"] == b["c"]) & (a["old_place"] == b["new_place"])).select(a["c"], "old_place", "new_place", F.lit("same").alias("kind"))
    rest = lambda df, p: df.join(same.select("c", F.col(p)), ["c", p], "left_anti").withColumn("rn", F.row_number().over(Window.partitionBy("c").orderBy(p)))
    left = rest(a, "old_place").join(rest(b, "new_place"), ["c", "rn"], "full")
    kind = F.when(F.col("new_place").isNull(), "old_only").when(F.col("old_place").isNull(), "new_only").otherwise("moved")
    return same.unionByName(left.select("c", "old_place", "new_place", kind.alias("kind")))
