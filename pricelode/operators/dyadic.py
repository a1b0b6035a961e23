"""Windows of any length by dyadic intervals: a window is at most two nodes on each level of a binary tree over the days.

Node ``k`` of level ``j`` is the days [k * 2**j, (k + 1) * 2**j).  A day lies in one node of each level, a window is cut into
the largest nodes that fit, so a day and a window that holds it meet in exactly one node.  A window of years costs two
dozen rows instead of one a day, and an open end costs no more.  Days are whole numbers from 0 to 2**LEVELS - 1 (unix days;
the last is in the year 2149); windows are cut to them, empty ones have no nodes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEVELS = 16
LAST = (1 << LEVELS) - 1


def day_number(day: Column) -> Column:
    return F.unix_date(day)


def nodes_of_day(day: Column) -> Column:
    """struct(level, node) of the nodes that hold a day."""
    return F.array(*(F.struct(F.lit(j).alias("level"), F.shiftright(day, j).alias("node")) for j in range(LEVELS + 1)))


def nodes_of_window(first: Column, last: Column) -> Column:
    """struct(level, node) of the nodes that a window of days is cut into; null ends are open."""
    a = F.greatest(F.coalesce(first, F.lit(0)), F.lit(0)).cast("int")
    b = F.least(F.coalesce(last, F.lit(LAST)), F.lit(LAST)).cast("int") + 1  # behind the last day
    out = []
    for j in range(LEVELS + 1):
        # on level j the window still is [lo, hi), both multiples of 2**j; an odd end has a node of its own
        step = 1 << j
        lo = F.shiftright(a + (step - 1), j)
        hi = F.shiftright(b, j)
        whole = lo < hi
        # an even start or end is part of a larger node
        out += [F.when(whole & (lo % 2 == 1), F.struct(F.lit(j).alias("level"), lo.alias("node"))), F.when(whole & (hi % 2 == 1), F.struct(F.lit(j).alias("level"), (hi - 1).alias("node")))]
    return F.array_compact(F.array(*out))


def with_day_nodes(df: DataFrame, day: Column) -> DataFrame:
    return df.withColumn("_n", F.explode(nodes_of_day(day))).select(*df.columns, F.col("_n.level").alias("_level"), F.col("_n.node").alias("_node"))


def with_window_nodes(df: DataFrame, first: Column, last: Column) -> DataFrame:
    return df.withColumn("_n", F.explode(nodes_of_window(first, last))).select(*df.columns, F.col("_n.level").alias("_level"), F.col("_n.node").alias("_node"))


def holding(windows: DataFrame, days: DataFrame, first: Column, last: Column, day: Column) -> DataFrame:
    """Each pair of a window and a day in it, once; columns of both."""
    return with_window_nodes(windows, first, last).join(with_day_nodes(days, day), ["_level", "_node"]).drop("_level", "_node")


def open_counts(windows: DataFrame, days: DataFrame, first: Column, last: Column, day: Column) -> DataFrame:
    """``days`` with ``n_open``, how many windows hold each: windows are counted by node first, so what a day meets is a
    row for each level, not its windows."""
    counts = with_window_nodes(windows, first, last).groupBy("_level", "_node").agg(F.count(F.lit(1)).alias("_c"))
    met = with_day_nodes(days, day).join(counts, ["_level", "_node"], "left")
    return met.groupBy(*days.columns).agg(F.coalesce(F.sum("_c"), F.lit(0)).alias("n_open"))


def overlapping(windows: DataFrame, identity: str, first: Column, last: Column) -> DataFrame:
    """left, right: ids of each pair of windows with a day in common, once.  The window that begins later (of equal ones the
    larger id) begins inside the other."""
    rows = windows.select(F.col(identity).alias("id"), F.greatest(F.coalesce(first, F.lit(0)), F.lit(0)).cast("int").alias("a"), F.least(F.coalesce(last, F.lit(LAST)), F.lit(LAST)).cast("int").alias("b")).filter("a <= b")
    early = with_window_nodes(rows.select(F.col("id").alias("left"), F.col("a").alias("_a"), F.col("b").alias("_b")), F.col("_a"), F.col("_b"))
    late = with_day_nodes(rows.select(F.col("id").alias("right"), F.col("a").alias("_s")), F.col("_s"))
    before = (F.col("_a") < F.col("_s")) | ((F.col("_a") == F.col("_s")) & (F.col("left") < F.col("right")))
    return early.join(late, ["_level", "_node"]).filter(before).select("left", "right")
