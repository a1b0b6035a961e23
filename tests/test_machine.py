"""The state machine in pieces against a loop, and its stream: restarts, late events, idle items, carried records."""

import random
import uuid
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from pricelode.operators import machine
from pricelode.operators.machine import APPLIED, FORBIDDEN, REVIEW
from pricelode.streaming import stateful


def events(seed=1, hot=900, items=12):
    pick = random.Random(seed)
    rows = [("hot", f"{i:05d}") for i in range(hot)] + [(f"i{pick.randrange(items)}", f"{i:05d}") for i in range(1000, 1400)]
    return [(k, s, pick.choice([*REVIEW.actions, "seed", "nonsense", None])) for k, s in rows]


def loop(rows, m=REVIEW):
    held, out = {}, []
    for k, s, a in sorted(rows, key=lambda r: (r[0] or "", r[1])):
        state, revision = held.get(k, ("none", 0))
        after, verdict = m.move(state, a)
        revision += verdict == APPLIED
        held[k] = (after, revision)
        out.append((k, s, a, state, after, verdict, revision))
    return sorted(out, key=repr)


@pytest.mark.parametrize("piece", [1, 7, 128, 5000])
def test_pieces_give_what_a_loop_gives(spark, monkeypatch, piece):
    monkeypatch.setattr(machine, "PIECE", piece)
    rows = events() + [(None, "00001", "seed"), (None, "00002", "approve")]
    frame = spark.createDataFrame(rows, "item string, seq string, action string").repartition(5)
    got = machine.folded(frame, REVIEW, "item", [F.col("seq")], F.col("action")).collect()
    assert sorted(map(tuple, got), key=repr) == loop(rows)
    assert machine.folded(frame.limit(0), REVIEW, "item", [F.col("seq")], F.col("action")).count() == 0


def test_forbidden_moves():
    assert REVIEW.move("approved", "reopen") == ("approved", FORBIDDEN) and REVIEW.move("rejected", "draft") == ("rejected", FORBIDDEN)
    assert REVIEW.move("none", "approve") == ("none", FORBIDDEN) and REVIEW.move("rejected", "reopen") == ("pending", APPLIED)
    assert REVIEW.move("approved", "approve")[1] == REVIEW.move("pending", "reopen")[1] == "no_op"


def test_stream_agrees_and_restarts_change_nothing(spark):
    rows = events(2, 60, 5)
    frame = lambda part: spark.createDataFrame(part, "item string, seq string, action string").repartition(3)
    cut = lambda a, b: frame([r for r in rows if a <= r[1] < b] or rows[:0])
    run = lambda slices: sorted(map(tuple, stateful.in_runs(slices, "item", stateful.MachineProcessor(REVIEW), stateful.VERDICTS).collect()), key=repr)
    want = loop(rows)
    assert run([frame(rows)]) == want
    assert run([cut("", "00030"), cut("00030", "01200"), cut("01200", "9"), frame(rows[:1]).limit(0)]) == want


def test_late_events_are_rows(spark):
    frame = lambda part: spark.createDataFrame(part, "item string, seq string, action string")
    out = stateful.in_runs([frame([("a", "1", "seed"), ("a", "5", "approve")]), frame([("a", "3", "reject"), ("a", "6", "reject"), ("a", "5", "approve")])], "item", stateful.MachineProcessor(REVIEW), stateful.VERDICTS)
    got = sorted((r["seq"], r["action"], r["to_state"], r["verdict"], r["revision"]) for r in out.collect())
    assert got == [("1", "seed", "pending", "applied", 1), ("3", "reject", "approved", "late", 2), ("5", "approve", "approved", "applied", 2), ("5", "approve", "approved", "late", 2), ("6", "reject", "approved", "forbidden", 2)]


def test_idle_items_are_reported_once(spark, tmp_path):
    """Timers on event time: a draft left for over two days is reported, one that moved on is not."""
    day = lambda d: datetime(2024, 1, 1) + timedelta(days=d)
    parts = [[("a", "1", "seed", day(0)), ("a", "2", "draft", day(1)), ("b", "1", "seed", day(0)), ("b", "2", "draft", day(1))], [("b", "3", "approve", day(2)), ("z", "1", "seed", day(9))], [("z", "2", "approve", day(20))], [("z", "3", "approve", day(40))]]
    processor = stateful.MachineProcessor(REVIEW, idle=2, waiting=("draft", "needs_followup"))
    folder = f"{tmp_path}/{uuid.uuid4().hex}"
    with stateful.with_store(spark, 2):
        for part in parts:
            frame = spark.createDataFrame(part, "item string, seq string, action string, at timestamp")
            frame.write.mode("append").parquet(f"{folder}/in")
            stream = spark.readStream.schema(frame.schema).parquet(f"{folder}/in").withWatermark("at", "1 hour")
            stateful.run_once(stream, "item", processor, stateful.VERDICTS, folder, "EventTime")
    rows = [tuple(r) for r in spark.read.schema(stateful.VERDICTS).parquet(f"{folder}/out").collect()]
    assert [r for r in rows if r[2] == "idle"] == [("a", "2", "idle", "draft", "draft", "notice", 2)]
    assert len(rows) == 9


def test_carried_records(spark):
    frame = lambda part: spark.createDataFrame(part, "scope string, seq string, week long, identity string, scheduled boolean")
    one = [("s", "01", 1, "x", False), ("s", "02", 1, "x", True), ("s", "03", 1, "x", True), ("s", "04", 1, "y", True), ("s", "05", 2, "x", True)]
    two = [("s", "06", 2, "z", True), ("s", "07", 4, "x", True), ("s", "08", 5, "x", True), ("s", "09", 6, "q", True), ("s", "10", 7, "q", True), ("s", "11", 3, "q", True)]
    out = sorted((r["seq"], r["verdict"], r["run"]) for r in stateful.in_runs([frame(one), frame(two)], "scope", stateful.CarriedProcessor(3), stateful.CARRIED).collect())
    assert out == [
        ("01", "not_scheduled", 0), ("02", "recorded", 1), ("03", "duplicate", 1), ("04", "conflict", 1), ("05", "recorded", 2),
        ("06", "conflict", 2), ("07", "recorded", 1), ("08", "recorded", 2), ("09", "recorded", 3), ("10", "recorded", 3), ("11", "late", 3),
    ]
