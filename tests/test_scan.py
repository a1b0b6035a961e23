"""Scans over ranges against loops, with a group that holds most rows and spans all ranges."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from pricelode.operators import scan


def rows(seed=1, n=900):
    pick = random.Random(seed)
    out = [(None if i % 40 == 0 else "rare" + str(i % 7) if i % 10 == 1 else "hot", i, float(pick.randrange(0, 3000)), None if i % 23 == 0 else pick.randrange(-50, 50)) for i in range(n)]
    return [*out, ("one", 9000, 1.0, 4), ("z", 9001, 0.0, None)]


FRAME = "g string, id int, y double, v int"


def grouped(data):
    key = lambda r: (r[0] is not None, r[0] or "")
    return [sorted(v, key=lambda r: (r[2], r[1])) for _, v in itertools.groupby(sorted(data, key=key), key=key)]


def test_segments(spark):
    data = rows()
    got = {r["id"]: r["s"] for r in scan.segments(spark.createDataFrame(data, FRAME), ["g"], ["y", "id"], ["y"], lambda prev: F.col("y") - prev["y"] > 2.6, "s").collect()}
    want = {}
    for own in grouped(data):
        number = 0
        for i, r in enumerate(own):
            number += i == 0 or r[2] - own[i - 1][2] > 2.6
            want[r[1]] = number
    assert got == want
    assert scan.segments(spark.createDataFrame([], FRAME), ["g"], ["y", "id"], ["y"], lambda prev: F.col("y") > prev["y"], "s").count() == 0


@pytest.mark.parametrize("how", ["sum", "max"])
@pytest.mark.parametrize("past", [False, True])
def test_running(spark, how, past):
    data = rows(2)
    ranged = scan.dealt(spark.createDataFrame(data, FRAME), ["g"], ["y", "id"])
    assert ranged.filter("g = 'hot'").select("_range").distinct().count() > 1
    got = {r["id"]: r["r"] for r in scan.running(ranged, ["g"], ["y", "id"], F.col("v"), "r", how, past).collect()}
    fold = sum if how == "sum" else max
    want = {}
    for own in grouped(data):
        for i, r in enumerate(own):
            held = [x[3] for x in own[: i + (not past)] if x[3] is not None]
            want[r[1]] = fold(held) if held else None
    assert got == want


def boxes(seed, n, pages=3):
    pick = random.Random(seed)
    out = []
    for i in range(n):
        x, y = pick.randrange(0, 6) * 100 + pick.uniform(0, 20), pick.randrange(0, 5) * 90 + pick.uniform(0, 15)
        out.append((i % pages if i % 11 else 0, i, x, y, x + pick.uniform(5, 60), y + pick.uniform(2, 30)))
    return out


BOXES = "page int, id int, x0 double, y0 double, x1 double, y1 double"


def widest(own):
    found = []
    for axis, lo, hi in (("x", 2, 4), ("y", 3, 5)):
        end = None
        for r in sorted(own, key=lambda r: (r[lo], r[1])):
            if end is not None and r[lo] > end:
                found.append((end - r[lo], axis, end, r[lo]))
            end = r[hi] if end is None else max(end, r[hi])
    return min(found) if found else None


def test_lines_cuts_and_regions(spark):
    data = boxes(3, 240)
    frame = spark.createDataFrame(data, BOXES).repartition(3)
    got = {r["id"]: (r["row"], r["line"]) for r in scan.text_lines(frame, "page", 4.0, 30.0).collect()}
    want = {}
    for p in range(3):
        own = sorted((r for r in data if r[0] == p), key=lambda r: ((r[3] + r[5]) / 2, r[1]))
        lines, last = [], None
        for r in own:
            cy = (r[3] + r[5]) / 2
            if last is None or cy - last > 4.0:
                lines.append([])
            lines[-1].append(r)
            last = cy
        for number, line in enumerate(lines, 1):
            at, end = 0, None
            for r in sorted(line, key=lambda r: (r[2], r[1])):
                if end is None or r[2] - end > 30.0:
                    at += 1
                end = r[4] if end is None else max(end, r[4])
                want[r[1]] = (number, at)
    assert got == want and len({x for x, _ in want.values()}) > 3 and max(y for _, y in want.values()) > 1

    cuts = {r["page"]: (r["start"] - r["end"], r["axis"], r["start"], r["end"]) for r in scan.widest_cut(frame, ["page"]).collect()}
    assert cuts == {p: widest([r for r in data if r[0] == p]) for p in range(3)}

    def cut(own):
        w = widest(own)
        if not w or -w[0] < 12:
            return {r[1]: min(x[1] for x in own) for r in own}
        lo = 2 if w[1] == "x" else 3
        return {**cut([r for r in own if r[lo] <= w[2]]), **cut([r for r in own if r[lo] > w[2]])}

    found = {r["id"]: r["region"] for r in scan.regions(frame, "page", 12.0).collect()}
    assert found == {k: v for p in range(3) for k, v in cut([r for r in data if r[0] == p]).items()} and len(set(found.values())) > 5
    sides = {r["page"]: (r["axis"], r["at"], r["before"], r["near"], r["after"]) for r in scan.around_cut(frame, ["page"]).collect()}
    for p, (axis, at, before, near, after) in sides.items():
        own, w = [r for r in data if r[0] == p], widest([r for r in data if r[0] == p])
        lo, hi = (2, 4) if axis == "x" else (3, 5)
        t = max(0.5, 0.02 * (max(r[hi] for r in own) - min(r[lo] for r in own)))
        mids = [(r[lo] + r[hi]) / 2 for r in own]
        assert at == (w[2] + w[3]) / 2 and (before, near, after) == (sum(m < at - t for m in mids), sum(abs(m - at) <= t for m in mids), sum(m > at + t for m in mids))
    assert scan.regions(frame.limit(0), "page", 12.0).count() == scan.widest_cut(frame.filter("id = 5"), ["page"]).count() == 0
