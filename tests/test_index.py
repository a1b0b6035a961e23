"""Digest trees, dyadic windows and pigeonholes against all pairs."""

import itertools
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from pricelode.operators import dyadic, hamming, merkle
from pricelode.plans import q_index, registry


@pytest.mark.parametrize("levels", [1, 4])
def test_differences_are_located(spark, levels):
    old = {(i, f"k{i}"): (i % 7, None if i % 5 == 0 else "v") for i in range(3000)}
    new = dict(old)
    for i in (5, 17, 2000):
        new[(i, f"k{i}")] = (99, "v")
    del new[(40, "k40")]
    new[(9000, "new")] = (None, None)
    new[(15, "k15")] = (1, "")  # null is not the empty text
    frame = lambda d: spark.createDataFrame([(*k, *v) for k, v in d.items()], "a int, b string, x int, y string").repartition(3)
    got = {tuple(r) for r in merkle.differences(frame(old), frame(new), ["a", "b"], ["x", "y"], levels).collect()}
    assert got == {(5, "k5", "changed"), (17, "k17", "changed"), (2000, "k2000", "changed"), (40, "k40", "removed"), (9000, "new", "added"), (15, "k15", "changed")}
    assert merkle.differences(frame(old), frame(old), ["a", "b"], ["x", "y"], levels).count() == 0
    assert merkle.differences(frame(old), frame(old).limit(0), ["a", "b"], ["x", "y"], levels).count() == 3000


def test_only_unlike_branches_are_looked_at(spark):
    rows = spark.range(20000).select("id", (F.col("id") % 9).alias("v"))
    one = rows.withColumn("v", F.when(F.col("id") == 77, 5000).otherwise(F.col("v")))
    trees = [merkle.tree(merkle.laid_out(x, ["id"]), ["id"], ["v"]) for x in (rows, one, rows.repartition(7))]
    by_level = {r["level"]: r["n"] for r in merkle.unlike(trees[0], trees[1]).groupBy("level").agg(F.count("node").alias("n")).collect()}
    assert by_level == dict.fromkeys(range(5), 1)  # a path from the root to one leaf
    assert merkle.unlike(trees[0], trees[2]).count() == 0
    totals = {r["level"]: (r["nodes"], r["rows"]) for r in trees[0].groupBy("level").agg(F.count("node").alias("nodes"), F.sum("n").alias("rows")).collect()}
    assert totals[0] == (1, 20000) and all(rows == 20000 for _, rows in totals.values()) and totals[1][0] == 16


def test_sealed_reports():
    report = merkle.sealed({"b": [1, "ü"], "a": None})
    assert merkle.opened(report) == report and merkle.sealed({"a": None, "b": [1, "ü"]})["digest"] == report["digest"]
    for bad in ({**report, "a": 1}, {**report, "c": 1}, {k: v for k, v in report.items() if k != "digest"}, {**report, "digest": report["digest"].upper()}):
        with pytest.raises(ValueError, match="digest"):
            merkle.opened(bad)


def test_windows_and_days(spark):
    pick = random.Random(2)
    spans = [(i, pick.randrange(0, 700), pick.choice([None, pick.randrange(0, 700), pick.randrange(0, 60000)])) for i in range(80)]
    spans += [(80, None, 5), (81, None, None), (82, 0, 0), (83, dyadic.LAST, None), (84, 9, 8), (85, -50, 3), (86, 5, 1 << 20), (87, 700, 700), (88, 700, 700)]
    held = [(i, max(a or 0, 0), min(dyadic.LAST if b is None else b, dyadic.LAST)) for i, a, b in spans]
    frame = spark.createDataFrame(spans, "id int, a int, b int")
    nodes = frame.select("id", dyadic.nodes_of_window(F.col("a"), F.col("b")).alias("n")).collect()
    for r, (_, a, b) in zip(sorted(nodes), held, strict=True):
        cut = sorted((n["node"] << n["level"], (n["node"] + 1 << n["level"]) - 1) for n in r["n"])
        assert len(cut) <= 2 * dyadic.LEVELS and [x for c in cut for x in c] == sorted(x for c in cut for x in c)
        assert (cut == []) == (a > b) and (not cut or (cut[0][0] == a and cut[-1][1] == b and all(y[0] == x[1] + 1 for x, y in itertools.pairwise(cut))))
    days = [0, 3, 8, 9, 250, 699, 700, 701, 30000, dyadic.LAST]
    asked = spark.createDataFrame([(d,) for d in days], "day int")
    got = sorted((r["id"], r["day"]) for r in dyadic.holding(frame, asked, F.col("a"), F.col("b"), F.col("day")).collect())
    assert got == sorted((i, d) for i, a, b in held for d in days if a <= d <= b)
    counts = {r["day"]: r["n_open"] for r in dyadic.open_counts(frame, asked, F.col("a"), F.col("b"), F.col("day")).collect()}
    assert counts == {d: sum(a <= d <= b for _, a, b in held) for d in days}
    pairs = sorted(tuple(r) for r in dyadic.overlapping(frame, "id", F.col("a"), F.col("b")).collect())
    real = [x for x in held if x[1] <= x[2]]
    assert pairs == sorted((x[0], y[0]) for x in real for y in real if (x[1], x[0]) < (y[1], y[0]) and x[2] >= y[1])


@pytest.mark.parametrize("share", [1, 2])
@pytest.mark.parametrize("bound", [0, 1, 5])
def test_codes_within_a_bound(spark, share, bound):
    pick = random.Random(bound)
    codes = [pick.getrandbits(32) for _ in range(60)]
    codes += [c ^ (1 << pick.randrange(32)) ^ (1 << pick.randrange(32)) for c in codes[:30]] + [codes[0]] * 20 + [None, 0, 0, (1 << 32) - 1]
    frame = spark.createDataFrame(list(enumerate(codes)), "id long, code long")
    pairs, members = hamming.near_codes(frame, "id", "code", 32, bound, share)
    of = {}
    for i, c in enumerate(codes):
        if c is not None:
            of.setdefault(c, i)
    want = sorted((min(i, j), max(i, j), (a ^ b).bit_count()) for (a, i), (b, j) in itertools.combinations(of.items(), 2) if (a ^ b).bit_count() <= bound)
    assert sorted(map(tuple, pairs.collect())) == want
    assert {r["id"]: r["class"] for r in members.collect()} == {i: of[c] for i, c in enumerate(codes) if c is not None}


def test_deviations(spark):
    vectors = spark.createDataFrame([(1, [0.0] * 200), (2, [float(i) for i in range(200)]), (3, [0.5])], "id int, v array<double>")
    pairs = spark.createDataFrame([(1, 2)], "left int, right int")
    r = hamming.deviations(pairs, vectors, "id", "v").first()
    assert (r["mae"], r["p99"], r["most"]) == (99.5, 197.0, 199.0) and abs(r["rms"] - (sum(i * i for i in range(200)) / 200) ** 0.5) < 1e-9
    assert spark.createDataFrame([([0.1, -0.1, 0.0, 2.0],)], "v array<double>").select(hamming.sign_code(F.col("v"), 3), hamming.sign_code(F.col("v"), 60)).first()[:] == (1, 9)


def vectors(pick):
    """Many vectors of few codes, copies, and odd ones: no components, null ones, no numbers, ids that come twice or are null."""
    base = [[pick.uniform(-1, 1) for _ in range(40)] for _ in range(6)]
    out = [[x * pick.uniform(0.5, 1) * (-1 if pick.random() < 0.1 else 1) for x in pick.choice(base)] for _ in range(60)]
    out += [[x * pick.uniform(0.5, 1) for x in base[0]] for _ in range(40)] + [base[0]] * 8
    out += [None, None, [], [], [0.0] * 40, [-0.0] * 40, [-1.0], [1.0, None], [None, None], [float("nan")] * 3, [float("nan")] * 3, [float("inf"), -1.0]]
    return [*((i * 7 % 131 if i % 10 else i % 3, v) for i, v in enumerate(out)), (None, base[1]), (None, base[1]), (None, [0.5] * 40), (5, base[2]), (5, base[2])]


@pytest.mark.parametrize("together", [5, 256])
def test_all_vectors_behind_near_codes(spark, tmp_path, monkeypatch, together):
    """Different vectors of one code are pairs as well, and each vector behind a code counts, not the one with its least id."""
    monkeypatch.setattr(hamming, "TOGETHER", together)
    rows = vectors(random.Random(4))
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3).write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    con.sql(f"create view embeddings as select * from '{tmp_path}/embeddings.parquet/*.parquet'")
    want = con.sql(registry.oracle_sql()["perceptual_neighbours"])
    found = q_index.perceptual_neighbours(spark, str(tmp_path))
    assert found.columns == want.columns
    got, want = [tuple(r) for r in found.collect()], want.fetchall()
    assert sorted(map(repr, got)) == sorted(map(repr, want))
    code = lambda v: sum(1 << i for i, x in enumerate((v or [])[:32]) if x is not None and not x <= 0)
    key = lambda v: repr(v and [x if x is None else x + 0.0 for x in v])
    of = {}
    for i, v in rows:
        of.setdefault(key(v), (code(v), set()))[1].add(i)
    near = sum((a ^ b).bit_count() <= 6 for (a, _), (b, _) in itertools.combinations(of.values(), 2))
    assert len(got) == near + sum(len(ids) - 1 for _, ids in of.values()) and sum(r[2] == 0 for r in got) > 700
