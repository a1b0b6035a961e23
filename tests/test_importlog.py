"""Imports are whole or not there: replays, conflicts, killed and competing writers, a changed log."""

import json
import os
import threading

import pytest
from pyspark.sql import functions as F

from pricelode.operators import importlog
from pricelode.operators.importlog import ImportRejected, committed, import_content, import_snapshot, manifests, put_if_absent, vacuum

COLUMNS = "snapshot string, source_id string, cents long, raw string"
VALUES = ["cents", "raw"]


def batch(spark, ids, name="s", cents=5):
    return spark.createDataFrame([(name, str(i), cents * i, f"r{i}") for i in ids], COLUMNS).repartition(3)


def put(df, path, name="s", **more):
    return import_snapshot(df, path, name, "source_id", VALUES, **more)


def test_replay_and_conflict(spark, tmp_path):
    path = f"{tmp_path}/t"
    assert put(batch(spark, range(1, 9)), path, expected=8) == importlog.Receipt("committed", "s", 1, 8, 8)
    assert put(batch(spark, range(8, 0, -1)), path).written == 0
    for other in (range(1, 8), range(1, 10), range(2, 10)):
        with pytest.raises(ImportRejected, match="other rows"):
            put(batch(spark, other), path)
    with pytest.raises(ImportRejected, match="conflicting': 8"):
        put(batch(spark, range(1, 9), cents=6), path)
    assert put(batch(spark, [1], "second"), path, "second").version == 2
    schema = batch(spark, []).schema
    assert committed(spark, path, schema).count() == 9 and committed(spark, path, schema, version=1).count() == 8 and committed(spark, path, schema, snapshot="second").count() == 1
    assert len(os.listdir(f"{path}/data")) == 2


@pytest.mark.parametrize(
    ("rows", "why"),
    [([("s", "1", 1, ""), ("other", "2", 1, "")], "another snapshot"), ([("s", "1", 1, ""), (None, "2", 1, "")], "another snapshot"), ([("s", " 1", 1, "")], "canonical"), ([("s", "", 1, "")], "canonical"), ([("s", None, 1, "")], "canonical"), ([("s", "1", 1, ""), ("s", "1", 1, "")], "twice"), ([("s", "1", 1, "")], "1 rows instead of 2")],
)
def test_rules_leave_nothing(spark, tmp_path, rows, why):
    path = f"{tmp_path}/t"
    with pytest.raises(ImportRejected, match=why):
        put(spark.createDataFrame(rows, COLUMNS), path, expected=2 if why.startswith("1 rows") else None)
    assert manifests(spark, path) == [] and os.listdir(f"{path}/data") == []


def test_a_killed_write_leaves_nothing(spark, tmp_path, monkeypatch):
    """A task that fails in the middle, and a driver that dies between the files and the manifest."""
    path = f"{tmp_path}/t"
    schema = batch(spark, []).schema
    broken = batch(spark, range(200)).withColumn("cents", F.when(F.col("source_id") == "77", F.raise_error(F.lit("killed"))).otherwise(F.col("cents")))
    with pytest.raises(Exception, match="killed"):
        put(broken, path)
    assert committed(spark, path, schema).count() == 0

    class Killed(BaseException):
        pass

    def die(*_):
        raise Killed

    with monkeypatch.context() as m:
        m.setattr(importlog, "put_if_absent", die)
        m.setattr(importlog, "_drop", lambda *_: None)  # no clean-up either
        with pytest.raises(Killed):
            put(batch(spark, range(200)), path)
    assert committed(spark, path, schema).count() == 0 and len(os.listdir(f"{path}/data")) >= 1
    assert put(batch(spark, range(200)), path).written == 200
    assert vacuum(spark, path, hours=1) == 0 and vacuum(spark, path, hours=-1) >= 1
    assert committed(spark, path, schema).count() == 200 and len(os.listdir(f"{path}/data")) == 1


def test_one_of_many_publishes(spark, tmp_path):
    won = []
    threads = [threading.Thread(target=lambda i=i: won.append((put_if_absent(spark, f"{tmp_path}/log/1.json", str(i)), i))) for i in range(12)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    winners = [i for ok, i in won if ok]
    assert len(winners) == 1 and len(won) == 12
    assert open(f"{tmp_path}/log/1.json").read() == str(winners[0]) and [f for f in os.listdir(f"{tmp_path}/log") if f.endswith(".tmp")] == []


def test_competing_writers(spark, tmp_path, monkeypatch):
    """A writer that comes second commits the next version; with the same snapshot it is a replay, with other rows it is refused."""
    path = f"{tmp_path}/t"
    real = importlog.put_if_absent

    def other_first(rival, name):
        def publish(*args):
            monkeypatch.setattr(importlog, "put_if_absent", real)
            assert put(rival, path, name).state == "committed"
            return real(*args)

        monkeypatch.setattr(importlog, "put_if_absent", publish)

    other_first(batch(spark, [1, 2], "rival"), "rival")
    assert put(batch(spark, [1], "own"), path, "own").version == 2
    other_first(batch(spark, [5, 6], "same"), "same")
    assert put(batch(spark, [6, 5], "same"), path, "same").state == "replayed"
    other_first(batch(spark, [7], "clash"), "clash")
    with pytest.raises(ImportRejected):
        put(batch(spark, [8], "clash"), path, "clash")
    assert [m["snapshot"] for m in manifests(spark, path)] == ["rival", "own", "same", "clash"]
    assert committed(spark, path, batch(spark, []).schema).count() == 6 and len(os.listdir(f"{path}/data")) == 4


def test_a_changed_log_is_refused(spark, tmp_path):
    path = f"{tmp_path}/t"
    for name in ("a", "b", "c"):
        put(batch(spark, [1], name), path, name)
    second = f"{path}/log/{2:020d}.json"
    text = open(second).read()
    for change in (lambda m: m.update(rows=9), lambda m: m.update(version=5), lambda m: m.update(previous="x")):
        m = json.loads(text)
        change(m)
        open(second, "w").write(json.dumps(m))
        with pytest.raises(ImportRejected, match="not whole"):
            manifests(spark, path)
    m["sha256"] = importlog.digest(m)  # whole in itself, but not the one that followed
    open(second, "w").write(json.dumps(m))
    with pytest.raises(ImportRejected, match="not whole"):
        manifests(spark, path)
    os.remove(second)
    with pytest.raises(ImportRejected, match="not whole"):
        manifests(spark, path)


def test_optional_columns_and_empty_batches(spark, tmp_path):
    path = f"{tmp_path}/t"
    old = batch(spark, [1, 2]).withColumn("raw", F.lit(None).cast("string"))
    put(old, path)
    with pytest.raises(ImportRejected):
        put(batch(spark, [1, 2]), path)
    assert put(batch(spark, [1, 2]), path, optional=["raw"]).state == "replayed"
    assert put(batch(spark, []), path, "none") == importlog.Receipt("replayed", "none", 1, 0, 0)
    assert len(manifests(spark, path)) == 1


def test_content_is_used_again(spark, tmp_path):
    path = f"{tmp_path}/t"
    rows = batch(spark, range(5)).drop("snapshot")
    go = lambda df, window="w": import_content(df, path, "src", window, "source_id", VALUES)
    first = go(rows)
    assert first.state == "committed" and go(rows.orderBy(F.desc("cents"))) == importlog.Receipt("reused", first.snapshot, 1, 0, 5)
    assert go(rows, "w2").version == 2 and go(rows.filter("cents > 0"), "w2").version == 3 and go(rows, "w2").version == 4
    assert import_content(rows, path, "other", "w", "source_id", VALUES).version == 5
