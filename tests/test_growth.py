"""Queries whose groups hold many rows: what they form follows the rows, not their pairs."""

import datetime
import re

from pyspark.sql import functions as F

from pricelode.operators import hamming, matching, pointers
from pricelode.plans import q_evidence
from pricelode.streaming import stateful


def events(spark, folder, ids):
    at = datetime.datetime(2024, 1, 3)
    rows = [(i, at, i % 9, "view", (i * 31 % 977) / 100.0, '{"k": 1}') for i in ids]
    spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string, value double, props string").write.parquet(f"{folder}/events.parquet")
    return rows


def test_split_prices_of_one_line(spark, tmp_path):
    """All words on one line of one page, many at one place: no pair but the nearest is formed."""
    words = [(i, i * 37 % 500, round(v * 100)) for i, _, _, _, v, _ in events(spark, tmp_path, [2100 * k for k in (0, 1, 2, 3, 4, 5, 6, 10, 15, 20)])]
    want = set()
    for i, x, cents in words:
        near = min(((x2 - x, i2, c2) for i2, x2, c2 in words if 0 < x2 - x <= 120), default=None)
        if near:
            want.add((i, near[1], cents // 100 * 100 + near[2] % 100, float(near[0])))
    found = q_evidence.split_prices(spark, str(tmp_path))
    assert want and {tuple(r) for r in found.collect()} == want
    assert "row_number" not in found._jdf.queryExecution().toString()


def test_circles_end_the_rounds(spark, monkeypatch):
    """A round in which no node comes to its end is the last one: circles do not cost a round for each doubling of the table."""
    count, write = [], pointers.written
    monkeypatch.setattr(pointers, "written", lambda df, tag: (count.append(tag), write(df, tag))[1])
    rows = [(0, i, i + 1 if i < 5 else None) for i in range(6)] + [(0, 10, 11), (0, 11, 10), (0, 12, 10)] + [(0, i, None) for i in range(100, 600)]
    got = {r["node"]: (r["last"], r["outcome"]) for r in pointers.chased(spark.createDataFrame(rows, "doc int, node int, target int")).collect()}
    assert got[0] == (5, "resolved") and got[100] == (100, "resolved") and [got[i] for i in (10, 11, 12)] == [(None, "cycle")] * 3 and len(got) == 509
    assert len(count) <= 6


def test_tasks_follow_embedded_entries(spark, sf, monkeypatch):
    monkeypatch.setattr(q_evidence, "ENTRIES", 50)
    rows = spark.read.parquet(f"{sf}/lineitem.parquet").count()
    plan = q_evidence.embedded_products(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert re.search(rf"hashpartitioning\(l_orderkey#\d+L, {rows // 50 + 1}\)", plan)


def test_near_codes_meet_once(spark):
    """A pair is formed in one choice of parts only, so no distinct follows, and keys are spread by number."""
    codes = {i: (i * 2654435761 ^ (i << 7)) & 0xFF0F | (0x80000000 if i % 3 else 0) for i in range(200)}
    first = {c: min(i for i, x in codes.items() if x == c) for c in set(codes.values())}
    want = sorted((first[a], first[b], (a ^ b).bit_count()) for a in first for b in first if first[a] < first[b] and (a ^ b).bit_count() <= 6)
    pairs, _ = hamming.near_codes(spark.createDataFrame(list(codes.items()), "id long, code long"), "id", "code", 32, 6)
    assert sorted(tuple(r) for r in pairs.collect()) == want and len(want) > 100
    plan = pairs._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_NUM" in plan and "HashAggregate" not in plan


def test_state_partitions_follow_cores(spark):
    with stateful.with_store(spark):
        small = spark.conf.get("spark.sql.shuffle.partitions")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "100")
    try:
        with stateful.with_store(spark):
            assert int(spark.conf.get("spark.sql.shuffle.partitions")) == 2 * spark.sparkContext.defaultParallelism
        assert spark.conf.get("spark.sql.shuffle.partitions") == "100"
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert small == before


def test_codes_are_read_after_the_distinct(spark):
    """Copies of a product are told apart by their columns as they stand; its code and name are read once, not once a copy."""
    rows = [("x", "red ring", "b", 1, "4006381333931"), ("y", "red ring", "b", 1, "40-06381 333931"), ("y", "red ring", "b", 1, None)] * 50
    found = matching.products(spark.createDataFrame(rows, "p_type string, p_name string, p_brand string, p_size int, code string"), F.col("code"))
    coded = found.filter("code is not null")
    assert found.count() == 3 and {(r["chain"], r["code"]) for r in coded.collect()} == {("x", "04006381333931"), ("y", "04006381333931")}
    plan = coded._jdf.queryExecution().executedPlan().toString()
    assert "FileScan" in plan and "Exchange" not in plan and "LocalTableScan" not in plan
