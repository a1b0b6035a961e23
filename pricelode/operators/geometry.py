"""Layout geometry on bounding boxes: containment, gaps, nearest neighbours by page, components, assignment."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pricelode.shared import written


def centre(p: str = "") -> tuple[Column, Column]:
    return (F.col(f"{p}x0") + F.col(f"{p}x1")) / 2, (F.col(f"{p}y0") + F.col(f"{p}y1")) / 2


def area(p: str = "") -> Column:
    return (F.col(f"{p}x1") - F.col(f"{p}x0")) * (F.col(f"{p}y1") - F.col(f"{p}y0"))


def overlap_1d(a0: str, a1: str, b0: str, b1: str) -> Column:
    return F.greatest(F.least(a1, b1) - F.greatest(a0, b0), F.lit(0.0))


def intersection(a: str, b: str) -> Column:
    return overlap_1d(f"{a}x0", f"{a}x1", f"{b}x0", f"{b}x1") * overlap_1d(f"{a}y0", f"{a}y1", f"{b}y0", f"{b}y1")


def iou(a: str, b: str) -> Column:
    both = intersection(a, b)
    return both / (area(a) + area(b) - both)


def gap(a: str, b: str) -> Column:
    """Distance between two boxes, 0 where they touch."""
    dx = F.greatest(F.col(f"{a}x0") - F.col(f"{b}x1"), F.col(f"{b}x0") - F.col(f"{a}x1"), F.lit(0.0))
    dy = F.greatest(F.col(f"{a}y0") - F.col(f"{b}y1"), F.col(f"{b}y0") - F.col(f"{a}y1"), F.lit(0.0))
    return F.hypot(dx, dy)


def contains(a: str, b: str, margin: float = 0.0) -> Column:
    """The centre of b lies in a, give or take the margin."""
    x, y = centre(b)
    return x.between(F.col(f"{a}x0") - margin, F.col(f"{a}x1") + margin) & y.between(F.col(f"{a}y0") - margin, F.col(f"{a}y1") + margin)


def prefixed(df: DataFrame, p: str) -> DataFrame:
    return df.select(*(F.col(c).alias(f"{p}{c}") for c in df.columns))


def near_pairs(df: DataFrame, radius: float) -> DataFrame:
    """Pairs of boxes of a page whose gap is within ``radius``, met in grid cells of that size rather than in all
    pairs of the page.  Columns a_* and b_*, a_id < b_id."""
    cell = lambda c, pad: F.floor((F.col(c) + pad) / F.lit(radius)).cast("long")
    a = prefixed(df, "a_").withColumn("_cx", F.explode(F.sequence(cell("a_x0", -radius), cell("a_x1", radius)))).withColumn("_cy", F.explode(F.sequence(cell("a_y0", -radius), cell("a_y1", radius))))
    b = prefixed(df, "b_").withColumn("_cx", F.explode(F.sequence(cell("b_x0", 0.0), cell("b_x1", 0.0)))).withColumn("_cy", F.explode(F.sequence(cell("b_y0", 0.0), cell("b_y1", 0.0))))
    met = a.join(b, (F.col("a_page") == F.col("b_page")) & (a["_cx"] == b["_cx"]) & (a["_cy"] == b["_cy"])).filter("a_id < b_id")
    return met.filter(gap("a_", "b_") <= radius).drop(a["_cx"], a["_cy"], b["_cx"], b["_cy"]).dropDuplicates(["a_id", "b_id"])


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, component): least id reachable.  Rounds of least label and pointer jumping, each written to the shared
    folder, until nothing changes."""
    both = written(edges.select("a", "b").union(edges.select(F.col("b"), F.col("a"))).distinct(), "edges")
    labels = written(nodes.select("id", F.col("id").alias("component")), "components")
    while True:
        near = both.join(labels.select(F.col("id").alias("b"), "component"), "b").groupBy(F.col("a").alias("id")).agg(F.min("component").alias("near"))
        low = labels.join(near, "id", "left").select("id", F.col("component").alias("was"), F.least("component", F.coalesce("near", "component")).alias("low"))
        up = labels.select(F.col("id").alias("low"), F.col("component").alias("top"))
        new = written(low.join(up, "low").select("id", "was", F.least("low", "top").alias("component")), "components")
        if new.filter("component < was").isEmpty():
            return new.select("id", "component")
        labels = new.select("id", "component")


def best_match(pairs: DataFrame, key: list[str], score: str, tie: str, margin: float) -> DataFrame:
    """Per key the pair with the greatest score; ``sure`` if the runner-up is at least ``margin`` behind."""
    w = Window.partitionBy(*key).orderBy(F.desc(score), tie)
    rows = pairs.withColumn("_rn", F.row_number().over(w)).withColumn("_next", F.lead(score).over(w)).filter("_rn = 1")
    return rows.withColumn("sure", F.col("_next").isNull() | (F.col(score) - F.col("_next") >= margin)).drop("_rn", "_next")


def _hungarian(cost: np.ndarray) -> list[int]:
    """Column of each row in a minimum-cost assignment; rows are at most as many as columns.

    Shortest augmenting paths: rows enter one by one, potentials keep reduced costs from going negative.
    """
    rows, cols = cost.shape
    u, v, owner = np.zeros(rows), np.zeros(cols), np.full(cols, -1)
    for row in range(rows):
        dist, prev, done = np.full(cols, np.inf), np.full(cols, -1), np.zeros(cols, bool)
        at, r, base = -1, row, 0.0
        while True:
            reach = base + cost[r] - u[r] - v
            better = ~done & (reach < dist)
            dist[better], prev[better] = reach[better], at
            at = int(np.where(done, np.inf, dist).argmin())
            base, done[at] = dist[at], True
            if owner[at] < 0:
                break
            r = owner[at]
        u[row] += base
        passed = done.copy()
        passed[at] = False
        for j in np.flatnonzero(passed):
            u[owner[j]] += base - dist[j]
            v[j] -= base - dist[j]
        while at >= 0:
            before = prev[at]
            owner[at] = owner[before] if before >= 0 else row
            at = before
    out = [-1] * rows
    for j, r in enumerate(owner):
        if r >= 0:
            out[r] = j
    return out


def assign(costs: DataFrame, page: str, row: str, col: str, cost: str) -> DataFrame:
    """Minimum-cost one-to-one assignment within each page; a page's pairs fit one task, as its boxes do on paper."""
    kind = {c: costs.schema[c].dataType.simpleString() for c in (page, row, col)}

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        grid = frame.pivot(index=row, columns=col, values=cost).sort_index().sort_index(axis=1)
        values = grid.to_numpy(np.float64)
        big = np.nanmax(np.abs(values)) * (values.size + 1) + 1
        full = np.where(np.isnan(values), big, values)
        turned = full.shape[0] > full.shape[1]
        found = _hungarian(full.T if turned else full)
        pairs = [(c, r) if turned else (r, c) for r, c in enumerate(found)]
        rows = [(frame[page].iloc[0], grid.index[r], grid.columns[c], full[r, c]) for r, c in pairs if full[r, c] < big]
        return pd.DataFrame(rows, columns=[page, row, col, cost])

    return costs.groupBy(page).applyInPandas(run, f"{page} {kind[page]}, {row} {kind[row]}, {col} {kind[col]}, {cost} double")


def assign_near(costs: DataFrame, row: str, col: str, cost: str) -> DataFrame:
    """row, col, cost, component: as many one-to-one pairs as there can be, and of such choices one of the least total cost, where
    ``costs`` holds the pairs that may be made at all (ids are whole numbers).

    Pairs bind only within a connected component of the graph that they make, so each is solved by itself: a component with one row or
    one column takes its cheapest pair (of equal costs the smallest ids), in a grouped minimum; the others go to tasks by component,
    never a page at once.  A pair that is there twice counts with its lower cost; null or non-finite costs are no pair."""
    value = F.col(cost).cast("double")
    known = costs.filter(value.isNotNull() & ~F.isnan(value) & (F.abs(value) < F.lit(float("inf")))).groupBy(row, col).agg(F.min(value).alias(cost))
    a, b = F.col(row).cast("long") * 2, F.col(col).cast("long") * 2 + 1
    edges = written(known.select(row, col, cost, a.alias("a"), b.alias("b")), "costs")
    nodes = edges.select(F.col("a").alias("id")).union(edges.select("b")).distinct()
    dealt = written(edges.join(components(nodes, edges).withColumnRenamed("id", "a"), "a").drop("a", "b"), "dealt")
    span = [f(c).alias(f"_{i}{c}") for c in (row, col) for i, f in enumerate((F.min, F.max))]
    kinds = dealt.groupBy("component").agg(*span, F.min_by(F.struct(row, col, cost), F.struct(cost, row, col)).alias("_least"))
    star = (F.col(f"_0{row}") == F.col(f"_1{row}")) | (F.col(f"_0{col}") == F.col(f"_1{col}"))
    single = kinds.filter(star).select(f"_least.{row}", f"_least.{col}", f"_least.{cost}", "component")
    rest = dealt.join(kinds.filter(~star).select("component"), "component", "left_semi")
    return single.unionByName(assign(rest, "component", row, col, cost))


def overlapping_pairs(boxes: DataFrame, least: float, same: tuple[str, ...] = ("page",)) -> DataFrame:
    """Pairs of boxes that agree in ``same`` and whose overlap over union is ``least`` (above 0) or more: a_* and b_*, a_id < b_id.

    Such boxes are alike in width and height by the factor ``least``, and their centres are near: they meet in a cell of a
    grid whose step follows their size, not in all pairs of a page.  Boxes without an area overlap nothing."""
    base = 1.01 / least
    real = boxes.filter((F.col("x1") > F.col("x0")) & (F.col("y1") > F.col("y0")))
    number = lambda size: F.floor(F.log(size) / F.log(F.lit(base))).cast("int")
    step = lambda k: F.pow(F.lit(base), k + 1)
    cell = lambda at, k: F.floor(at / step(k)).cast("long")
    axes = [("x", "x0", "x1"), ("y", "y0", "y1")]
    a, b = prefixed(real, "a_"), prefixed(real, "b_")
    for axis, lo, hi in axes:
        size, mid = F.col(f"a_{hi}") - F.col(f"a_{lo}"), (F.col(f"a_{hi}") + F.col(f"a_{lo}")) / 2
        a = a.withColumn(f"_k{axis}", number(size)).withColumn(f"_c{axis}", cell(mid, F.col(f"_k{axis}")))
        size, mid = F.col(f"b_{hi}") - F.col(f"b_{lo}"), (F.col(f"b_{hi}") + F.col(f"b_{lo}")) / 2
        b = b.withColumn(f"_k{axis}", F.explode(F.sequence(number(size) - 1, number(size) + 1)))
        far = step(F.col(f"_k{axis}")) * ((1 - least) * base + 1e-6)
        b = b.withColumn(f"_c{axis}", F.explode(F.sequence(cell(mid - far, F.col(f"_k{axis}")), cell(mid + far, F.col(f"_k{axis}")))))
    met = a.join(b, ["_kx", "_cx", "_ky", "_cy"]).filter("a_id < b_id")
    for c in same:
        met = met.filter(F.col(f"a_{c}").eqNullSafe(F.col(f"b_{c}")))
    return met.filter(iou("a_", "b_") >= least).drop("_kx", "_cx", "_ky", "_cy")


def first_independent(edges: DataFrame) -> DataFrame:
    """id of the nodes that a greedy walk leaves out, where ``edges(first, second)`` point from the earlier to the later node:
    a node is left out if an earlier one next to it is kept.

    All nodes whose earlier neighbours are decided are decided at once, so a round settles many at every place: the number of
    rounds is the length of the longest chain of decisions that depend on each other, not the number of nodes."""
    edges = written(edges.select("first", "second"), "edges")
    gone = []
    while not edges.isEmpty():
        heads = edges.select("first").distinct().join(edges.select(F.col("second").alias("first")).distinct(), "first", "left_anti")
        out = written(edges.join(heads, "first").select(F.col("second").alias("id")).distinct(), "gone")
        gone.append(out)
        # what a kept node points at is out; what is out decides nothing; kept nodes have no open edges left
        edges = written(edges.join(out.withColumnRenamed("id", "first"), "first", "left_anti").join(out.withColumnRenamed("id", "second"), "second", "left_anti"), "edges")
    every = edges.select(F.col("first").alias("id"))
    for out in gone:
        every = every.union(out)
    return every


def greedy_distinct(boxes: DataFrame, least: float = 0.8, same: tuple[str, ...] = ("page",)) -> DataFrame:
    """page and id of boxes that, in order of rank and id, overlap no earlier kept one that agrees in ``same`` by ``least`` or
    more.  A page is not walked box by box: it is the lexicographically first independent set of the graph of overlaps."""
    own = boxes.select("page", "id", "rank", "x0", "y0", "x1", "y1", *(c for c in same if c != "page"))
    met = overlapping_pairs(own, least, same)
    turned = F.col("a_rank") <= F.col("b_rank")  # a_id < b_id
    edges = met.select(F.when(turned, F.col("a_id")).otherwise(F.col("b_id")).alias("first"), F.when(turned, F.col("b_id")).otherwise(F.col("a_id")).alias("second"))
    return boxes.select("page", "id").join(first_independent(edges), "id", "left_anti").select("page", "id")
