"""Spatial joins and greedy walks against loops over all pairs."""

import random

import pytest
from pyspark.sql import functions as F

from pricelode.operators import geometry

BOXES = "page int, id int, rank double, x0 double, y0 double, x1 double, y1 double, price int"


def iou(a, b):
    w, h = min(a[5], b[5]) - max(a[3], b[3]), min(a[6], b[6]) - max(a[4], b[4])
    both = max(w, 0) * max(h, 0)
    union = (a[5] - a[3]) * (a[6] - a[4]) + (b[5] - b[3]) * (b[6] - b[4]) - both
    return both / union if union and (a[5] - a[3]) * (a[6] - a[4]) and (b[5] - b[3]) * (b[6] - b[4]) else 0


def made(n, seed, spread):
    pick = random.Random(seed)
    out = []
    for i in range(n):
        x, y, w, h = pick.uniform(-spread, spread), pick.uniform(-spread, spread), 2 ** pick.uniform(-2, 6), 2 ** pick.uniform(-2, 6)
        out.append((i % 3, i, float(pick.randrange(5)), x, y, x + w, y + h, pick.randrange(2)))
        if pick.random() < 0.5:  # one like it, of another size or place
            x, y, w, h = x + w * pick.uniform(-0.3, 0.3), y + h * pick.uniform(-0.3, 0.3), w * pick.uniform(0.6, 1.6), h * pick.uniform(0.6, 1.6)
            out.append((i % 3, n + i, float(pick.randrange(5)), x, y, x + w, y + h, pick.randrange(2)))
    return [*out, (0, 9001, 0.0, 1.0, 1.0, 1.0, 5.0, 0), (0, 9002, 0.0, 1.0, 1.0, 1.0, 5.0, 0), *[(1, 9100 + i, 1.0, 0.0, 0.0, 8.0, 8.0, 0) for i in range(4)]]


@pytest.mark.parametrize("least", [0.2, 0.5, 0.8, 1.0])
def test_pairs_and_greedy_walk(spark, least):
    rows = made(160, 4, 60)
    frame = spark.createDataFrame(rows, BOXES).repartition(4)
    got = {(r["a_id"], r["b_id"]) for r in geometry.overlapping_pairs(frame, least).select("a_id", "b_id").collect()}
    assert got == {(a[1], b[1]) for a in rows for b in rows if a[1] < b[1] and a[0] == b[0] and iou(a, b) >= least}
    for same in (("page",), ("page", "price")):
        kept = []
        for r in sorted(rows, key=lambda r: (r[2], r[1])):
            if not any(k[0] == r[0] and (len(same) == 1 or k[7] == r[7]) and iou(k, r) >= least for k in kept):
                kept.append(r)
        assert {r["id"] for r in geometry.greedy_distinct(frame, least, same).collect()} == {k[1] for k in kept}


def test_rounds_follow_chains_not_boxes(spark, monkeypatch):
    """A thousand boxes in one place are one round; each box in a chain waits for the one before."""
    made = []
    real = geometry.written
    monkeypatch.setattr(geometry, "written", lambda df, tag: made.append(tag) or real(df, tag))
    pile = spark.createDataFrame([(0, i, 0.0, 0.0, 0.0, 5.0, 5.0, 0) for i in range(60)], BOXES)
    assert [r["id"] for r in geometry.greedy_distinct(pile, 0.8).collect()] == [0] and made.count("gone") == 1
    made.clear()
    chain = spark.createDataFrame([(0, i, 0.0, float(i), 0.0, i + 4.0, 4.0, 0) for i in range(8)], BOXES)  # each overlaps the next by 3 / 5
    assert sorted(r["id"] for r in geometry.greedy_distinct(chain, 0.6).collect()) == [0, 2, 4, 6] and made.count("gone") == 4
    assert geometry.greedy_distinct(chain.limit(0), 0.6).count() == 0


def cheapest(pairs):
    """Most pairs and then least cost of one component, by trying every choice."""
    rows = sorted({r for r, _ in pairs})
    best = (0, 0.0)

    def walk(i, used, n, total):
        nonlocal best
        if i == len(rows):
            best = min(best, (-n, total))
            return
        walk(i + 1, used, n, total)
        for (r, c), cost in pairs.items():
            if r == rows[i] and c not in used:
                walk(i + 1, used | {c}, n + 1, total + cost)

    walk(0, frozenset(), 0, 0.0)
    return best


def test_assignment_by_components(spark):
    pick = random.Random(3)
    parts = [{(k * 10 + pick.randrange(n), k * 10 + pick.randrange(m)): float(pick.randrange(-3, 9)) for _ in range(n * m)} for k in range(40) for n, m in [(pick.randrange(1, 6), pick.randrange(1, 6))]]
    rows = [(r, c, w) for p in parts for (r, c), w in p.items()]
    noise = [(r, c, w + 1) for r, c, w in rows[::3]] + [(r, c + 1000, bad) for (r, c, _), bad in zip(rows, [None, float("nan"), float("inf"), float("-inf")] * 5, strict=False)]
    frame = spark.createDataFrame(rows + noise, "row int, col int, cost double").repartition(3)
    got = geometry.assign_near(frame, "row", "col", "cost").collect()
    for k, p in enumerate(parts):
        own = [r for r in got if r["row"] // 10 == k]
        assert all(p[r["row"], r["col"]] == r["cost"] for r in own)
        assert len({r["row"] for r in own}) == len({r["col"] for r in own}) == len(own)
        assert (-len(own), sum(r["cost"] for r in own)) == cheapest(p)
    assert geometry.assign_near(frame.filter("false"), "row", "col", "cost").count() == 0


def test_near_assignment_is_the_one_of_whole_pages(spark, sf):
    """As many pairs as an assignment over all near pairs of a page at once gives, at the same cost."""
    from pricelode.plans import q_geometry
    from pricelode.plans.registry import queries

    got = queries()["near_assignment"](spark, sf).toPandas()
    b = q_geometry.boxes(spark, sf)
    near = geometry.prefixed(b.filter("id % 4 = 0"), "a_").join(geometry.prefixed(b.filter("id % 4 = 1"), "b_"), F.col("a_page") == F.col("b_page")).filter(geometry.gap("a_", "b_") <= 40)
    (ax, ay), (bx, by) = geometry.centre("a_"), geometry.centre("b_")
    costs = near.select(F.col("a_page").alias("page"), F.col("a_id").alias("price"), F.col("b_id").alias("title"), F.sqrt(F.pow(ax - bx, F.lit(2)) + F.pow(ay - by, F.lit(2))).alias("cost"))
    want = geometry.assign(costs, "page", "price", "title", "cost").toPandas()
    assert len(got) == len(want) > 0 and got.price.is_unique and got.title.is_unique
    assert abs(got.cost.sum() - want.cost.sum()) < 1e-3
