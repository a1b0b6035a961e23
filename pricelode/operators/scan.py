"""Scans along an order in groups, also where one group holds most rows: rows are dealt by ranges, and what a range needs to
know of those before it in its group is a row a range, carried over the edges."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pricelode.shared import written


def dealt(rows: DataFrame, groups: Sequence[str], order: Sequence[str]) -> DataFrame:
    """``rows`` written by ranges of group and order, with the number of their range ``_range``; ``order`` tells rows of a group apart."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return written(rows.repartitionByRange(parts, *groups, *order).withColumn("_range", F.spark_partition_id()), "ranges")


def _carried(ranged: DataFrame, groups: Sequence[str], each: Column, over: Callable[[str], Column]) -> DataFrame:
    """_g* and _of_range of the ranges that go on with a group, and ``_in``: ``over`` all of ``each`` before.  At most a row a range."""
    per = ranged.groupBy(*groups, "_range").agg(each.alias("_each"))
    before = Window.partitionBy(*groups).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    rows = per.withColumn("_there", F.count(F.lit(1)).over(before)).withColumn("_in", over("_each").over(before)).filter("_there > 0")
    return rows.select(*(F.col(g).alias(f"_g{i}") for i, g in enumerate(groups)), F.col("_range").alias("_of_range"), "_in")


def _joined(ranged: DataFrame, groups: Sequence[str], carried: DataFrame) -> DataFrame:
    same = F.col("_range") == F.col("_of_range")
    for i, g in enumerate(groups):
        same = same & F.col(g).eqNullSafe(F.col(f"_g{i}"))
    # a group goes on in a range only where the range before ends with it, so there is at most a row for each range
    return ranged.join(F.broadcast(carried), same, "left").drop("_of_range", *(f"_g{i}" for i in range(len(groups))))


def _inside(groups: Sequence[str], order: Sequence[str]) -> Window:
    return Window.partitionBy(*groups, "_range").orderBy(*order)


def before(ranged: DataFrame, groups: Sequence[str], order: Sequence[str], columns: Sequence[str], name: str) -> DataFrame:
    """``name``: struct of ``columns`` of the row before in the group, null for the first."""
    what = F.struct(*columns)
    last = _carried(ranged, groups, F.max_by(what, F.struct(*order)), lambda c: F.last(c))
    rows = _joined(ranged, groups, last)
    return rows.withColumn(name, F.coalesce(F.lag(what).over(_inside(groups, order)), F.col("_in"))).drop("_in")


def running(ranged: DataFrame, groups: Sequence[str], order: Sequence[str], value: Column, name: str, how: str = "sum", past: bool = False) -> DataFrame:
    """``name``: sum or max (``how``) of ``value`` from the group's first row to this one; with ``past`` to the row before."""
    fold = {"sum": F.sum, "max": F.max}[how]
    rows = _joined(ranged.withColumn("_v", value), groups, _carried(ranged.withColumn("_v", value), groups, fold("_v"), lambda c: fold(c)))
    own = fold("_v").over(_inside(groups, order).rowsBetween(Window.unboundedPreceding, -1 if past else 0))
    both = F.coalesce(F.col("_in") + own, F.col("_in"), own) if how == "sum" else F.greatest("_in", own)
    return rows.withColumn(name, both).drop("_in", "_v")


def segments(rows: DataFrame, groups: Sequence[str], order: Sequence[str], columns: Sequence[str], fresh: Callable[[Column], Column], name: str) -> DataFrame:
    """``rows`` with the number (from 1 in each group) of their segment: a row begins one if ``fresh`` says so of the struct of
    ``columns`` of the row before, or if there is none."""
    told = before(dealt(rows, groups, order), groups, order, columns, "_prev")
    begins = F.col("_prev").isNull() | F.coalesce(fresh(F.col("_prev")), F.lit(True))
    return running(told, groups, order, begins.cast("long"), name).drop("_prev", "_range")


def text_lines(words: DataFrame, page: str, down: float = 2.6, across: float = 8.0) -> DataFrame:
    """``words(page, id, x0, y0, x1, y1)`` with the line they are on: ``row`` by gaps of over ``down`` between centres from
    top to bottom, and in it ``line`` by gaps of over ``across`` from all words before to the next, from left to right."""
    rows = words.withColumn("_cy", (F.col("y0") + F.col("y1")) / 2)
    rows = segments(rows, [page], ["_cy", "id"], ["_cy"], lambda prev: F.col("_cy") - prev["_cy"] > down, "row")
    ranged = dealt(rows, [page, "row"], ["x0", "id"])
    reach = running(ranged, [page, "row"], ["x0", "id"], F.col("x1"), "_reach", "max", past=True)
    begins = F.col("_reach").isNull() | (F.col("x0") - F.col("_reach") > across)
    return running(reach, [page, "row"], ["x0", "id"], begins.cast("long"), "line").drop("_cy", "_reach", "_range")


def gaps(boxes: DataFrame, groups: Sequence[str], low: str, high: str) -> DataFrame:
    """groups, start, end of the stretches between a group's boxes that none of them covers, by a sweep from the least ``low``: a gap is
    where the next box begins behind all ends so far."""
    order = [low, "id"]
    swept = running(dealt(boxes.select(*groups, "id", low, high), groups, order), groups, order, F.col(high), "_end", "max", past=True)
    return swept.filter(F.col(low) > F.col("_end")).select(*groups, F.col("_end").alias("start"), F.col(low).alias("end"))


def widest_cut(boxes: DataFrame, groups: Sequence[str]) -> DataFrame:
    """groups, axis, start, end of each group's widest gap on either axis; of equal ones x before y, then the first."""
    x, y = (gaps(boxes, groups, f"{a}0", f"{a}1").withColumn("axis", F.lit(a)) for a in ("x", "y"))
    rank = F.struct((F.col("start") - F.col("end")).alias("w"), "axis", "start", "end")
    return x.unionByName(y).groupBy(*groups).agg(F.min(rank).alias("c")).select(*groups, "c.axis", "c.start", "c.end")


def regions(boxes: DataFrame, page: str, least: float) -> DataFrame:
    """``boxes`` with ``region``, the least id of the boxes that no gap of ``least`` or more on either axis parts, when each page
    is cut at its gaps, its parts likewise, and so on.

    A gap stays a gap when other cuts take boxes away, so the order of cuts does not matter and all gaps of an axis are cut
    at once, in all regions of all pages: rounds follow how deep cuts nest, not how many there are."""
    rows = written(boxes.withColumn("_r", F.lit("")), "regions")
    while True:
        fresh = 0
        for low, high in (("x0", "x1"), ("y0", "y1")):
            order = [low, "id"]
            swept = running(dealt(rows, [page, "_r"], order), [page, "_r"], order, F.col(high), "_end", "max", past=True)
            cut = F.coalesce(F.col(low) - F.col("_end") >= least, F.lit(False))
            part = written(running(swept.withColumn("_cut", cut), [page, "_r"], order, F.col("_cut").cast("long"), "_part"), "parts")
            fresh += part.filter("_cut").limit(1).count()
            rows = part.withColumn("_r", F.concat_ws(".", "_r", F.col("_part").cast("string"))).select(*rows.columns)
        if not fresh:
            break
    names = rows.groupBy(F.col(page).alias("_p"), F.col("_r").alias("_n")).agg(F.min("id").alias("region"))
    return rows.join(names, F.col(page).eqNullSafe(F.col("_p")) & (F.col("_r") == F.col("_n"))).select(*boxes.columns, "region")


def around_cut(boxes: DataFrame, groups: Sequence[str], share: float = 0.02, least: float = 0.5) -> DataFrame:
    """groups, axis, at, before, near, after: centres on either side of the middle of each group's widest gap, and those within ``share`` of the
    group's extent or ``least`` of it."""
    cuts = widest_cut(boxes, groups).select(*(F.col(g).alias(f"_g{i}") for i, g in enumerate(groups)), "axis", ((F.col("start") + F.col("end")) / 2).alias("at"))
    extent = boxes.groupBy(*groups).agg(*(fold(f"{a}{e}").alias(f"_{a}{e}") for a in "xy" for e, fold in (("0", F.min), ("1", F.max))))
    known = extent.join(cuts, [F.col(g).eqNullSafe(F.col(f"_g{i}")) for i, g in enumerate(groups)]).drop(*(f"_g{i}" for i in range(len(groups))))
    known = known.select(*(F.col(g).alias(f"_g{i}") for i, g in enumerate(groups)), "axis", "at", *(f"_{a}{e}" for a in "xy" for e in "01"))
    same = [F.col(g).eqNullSafe(F.col(f"_g{i}")) for i, g in enumerate(groups)]
    rows = boxes.join(known, same)
    by = lambda x, y: F.when(F.col("axis") == "x", x).otherwise(y)
    mid = by((F.col("x0") + F.col("x1")) / 2, (F.col("y0") + F.col("y1")) / 2)
    tolerance = F.greatest(by(F.col("_x1") - F.col("_x0"), F.col("_y1") - F.col("_y0")) * share, F.lit(least))
    return rows.groupBy(*groups, "axis", "at").agg(F.count_if(mid < F.col("at") - tolerance).alias("before"), F.count_if(F.abs(mid - F.col("at")) <= tolerance).alias("near"), F.count_if(mid > F.col("at") + tolerance).alias("after"))
