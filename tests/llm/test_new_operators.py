"""Vector codes, hard negatives and line dedup against plain versions, with odd rows, hot keys and many small blocks."""

import hashlib
import math
import random
from collections import defaultdict

import duckdb
import numpy as np
import pytest

from pricelode.llm import linededup, negatives, registry, veccodes
from pricelode.llm.common import Scratch

VECTORS = "vec_id long, embedding array<float>, label int, v string, part int, codes string, row int, s int, b int, n long"


def vectors(n=400, dim=16, seed=1, hot=0.3):
    rng = np.random.default_rng(seed)
    same = rng.normal(0, 0.3, dim)
    out = []
    for i in range(n):
        v = same if rng.random() < hot else rng.normal(0, 0.3, dim)
        out.append((i, [float(np.float32(x)) for x in v], int(rng.integers(0, 10))))
    return out


def odd():
    nan, inf = float("nan"), float("inf")
    return [(1000, None, 1), (1001, [0.1] * 15 + [None], 1), (1002, [nan] * 16, 2), (1003, [inf] + [0.0] * 15, 2), (1004, [0.25] * 16, None), (1005, [0.0] * 16, 3), (1100, [0.5] * 16, None)]


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, "y", 2, 3, 4, 5) for r in rows], VECTORS).repartition(5)


def plain_codes(rows, parts=8, entries=16, rounds=6):
    kept = [r for r in rows if r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, [math.floor(4096 * x) for x in r[1]]))
    v = np.array([[math.floor(4096 * x) for x in r[1]] for r in kept], np.int64)
    v = v.reshape(len(kept), parts, -1)
    books = v[:entries].transpose(1, 0, 2).copy()
    code = lambda: ((v[:, :, None, :] - books[None]) ** 2).sum(-1)
    for _ in range(rounds):
        at = code().argmin(2)
        for p in range(parts):
            for e in range(books.shape[1]):
                own = v[at[:, p] == e, p]
                if len(own):
                    books[p, e] = own.sum(0) // len(own)
    d = code()
    at, off = d.argmin(2), d.min(2).sum(1)
    return sorted(((r[0] is None, r[0]), "".join(f"{x:02x}" for x in a), int(o)) for r, a, o in zip(kept, at, off, strict=True)), books


@pytest.mark.parametrize("rows", [vectors() + odd(), vectors(9), vectors(40)[:20] * 3 + [(None, [0.1] * 16, 1)] * 2, [(i, [0.5] * 16, 1) for i in range(50)]])
def test_vector_codes(spark, rows):
    with Scratch(spark) as scratch:
        out, books = veccodes.quantised(frame(spark, rows), scratch)
        got = sorted(((r["vec_id"] is None, r["vec_id"]), r["code"], r["error"]) for r in out.collect())
    want, plain = plain_codes(rows)
    assert got == want and (books == plain).all()


def test_vector_codes_of_odd_shapes(spark):
    """No row, none usable, short vectors, vectors of other lengths and components beyond the bound."""
    for rows in ([], odd()[:4]):
        with Scratch(spark) as scratch:
            assert veccodes.quantised(frame(spark, rows), scratch)[0].count() == 0
    rows = [(1, [0.5, 0.25], 1), (2, [], 1), (3, [1.0] * 9, 1), (4, [3e38, -3e38], 1)]
    with Scratch(spark) as scratch:
        out = {r["vec_id"]: r for r in veccodes.quantised(frame(spark, rows), scratch)[0].collect()}
    assert set(out) == {1, 2, 3, 4} and all(len(r["code"]) == 16 and r["error"] >= 0 for r in out.values())


def test_only_changes_are_shuffled(spark):
    """What a round hands on are the parts whose code changed: rows of part and entry, none where nothing changed."""
    with Scratch(spark) as scratch:
        state = scratch.staged(frame(spark, vectors(300)).selectExpr("vec_id", "label", "transform(embedding, x -> cast(floor(4096 * x) as int)) as v", "cast(null as binary) as codes"), "t")
        books = np.array([r[0] for r in state.orderBy("vec_id").select("v").limit(16).collect()]).reshape(16, 8, 2).transpose(1, 0, 2)
        one = scratch.staged(veccodes.assigned(state, books, True), "t")
        tasks = state.rdd.getNumPartitions()
        assert one.filter("part is not null").count() <= tasks * 128 and one.filter("part is not null").groupBy("part").sum("n").filter("`sum(n)` = 300").count() == 8
        again = veccodes.assigned(one.filter("part is null").select("vec_id", "label", "v", "codes"), books, False)
        assert again.filter("part is not null").count() == 0


def plain_negatives(rows):
    rows = [r for r in rows if r[0] is not None and r[2] is not None and r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])]
    own = [(i, (y + 1) % 10 if i % 7 == 0 else y, [math.floor(256 * x) for x in v]) for i, v, y in rows]
    out = []
    for a, label, v in own:
        if a % 100:
            continue
        scored = [(-sum(x * y for x, y in zip(v, w, strict=True)), i, other == label) for i, other, w in own if i != a]
        for ps, p, _ in sorted(x for x in scored if x[2])[:5]:
            found = sorted(x for x in scored if not x[2] and 80 * -ps <= 100 * -x[0] <= 100 * -ps)[:5]
            out += [(a, p, k + 1, i, -ps, -s) for k, (s, i, _) in enumerate(found)]
    return sorted(out)


@pytest.mark.parametrize(("digit", "shard", "anchors"), [(8, 32768, 512), (2, 50, 2), (3, 1, 1)])
@pytest.mark.parametrize("hot", [0.0, 0.4])
def test_hard_negatives(spark, monkeypatch, digit, shard, anchors, hot):
    for name, value in (("DIGIT", digit), ("SHARD", shard if shard > 1 else 97), ("ANCHORS", anchors)):
        monkeypatch.setattr(negatives, name, value)
    rows = vectors(500, hot=hot) + odd()
    moved = negatives.F.expr("case when vec_id % 7 = 0 then (label + 1) % 10 else label end")
    with Scratch(spark) as scratch:
        out = negatives.hard_negatives(negatives.usable(frame(spark, rows), moved), scratch)
        got = sorted(map(tuple, out.collect()))
    assert got == plain_negatives(rows) and len(got) > 20


def test_hard_negatives_of_odd_tables(spark):
    with Scratch(spark) as scratch:
        for rows in ([], odd(), vectors(1), [(100 * i, [-0.5, 0.5 * (-1) ** i] * 8, i % 2) for i in range(6)], [(i, [1.0] * (i % 3), i % 2) for i in range(12)]):
            assert negatives.hard_negatives(negatives.usable(frame(spark, rows)), scratch).count() >= 0
        twice = vectors(300)
        one = sorted(map(tuple, negatives.hard_negatives(negatives.usable(frame(spark, twice)), scratch).collect()))
        two = sorted(map(tuple, negatives.hard_negatives(negatives.usable(frame(spark, twice + twice[:150] + [(None, [0.5] * 16, 1)])), scratch).collect()))
        assert one == two and one


LINES = "doc_id long, text string, d long, k string, pos int, h1 long, runs string, own string"


def line_table():
    pick = random.Random(3)
    common = ["Read more about this page", " ÉCOLE und Straße heute ", "short", "all rights reserved 2020", "x" * 9, "y" * 10, " padded with nbsp ", "DUPLICATE line here\r"]
    rows = []
    for i in range(120):
        own = [f"line {i} {pick.random()}" if pick.random() < 0.5 else pick.choice(common).swapcase() if pick.random() < 0.2 else pick.choice(common) for _ in range(pick.randrange(0, 12))]
        rows.append((i, "\n".join(own)))
    rows += [(200, None), (201, ""), (202, "\n\n"), (203, "\n".join(["all rights reserved 2020"] * 3)), (204, "only once here\nonly once here"), (None, common[0] + "\nnull id only line"), (None, "null id only line\nz")]
    rows += [rows[5]] * 3 + [(5, common[3] + "\nother text of the same id")] + [(300, "\n".join(f"long {i % 900} of many lines" for i in range(20000))), (301, "long 7 of many lines")]
    return rows


def key(line):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line.strip(" \t\n\x0b\x0c\r"))


def plain_lines(rows):
    last = (1 << 63) - 1
    first = defaultdict(lambda: last)
    for i, t in rows:
        for x in (t or "").split("\n"):
            first[key(x)] = min(first[key(x)], last if i is None else i)
    out = []
    for i, t in rows:
        own = (t or "").split("\n")
        kept = [x for x in own if len(key(x)) < 10 or (last if i is None else i) == first[key(x)]]
        out.append((i is None, i or 0, len(own), len(own) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("a_partition", [4, 1 << 40, 0])
def test_line_dedup(spark, monkeypatch, tmp_path, a_partition):
    """With some keys, all keys and no key taken as hot."""
    monkeypatch.setattr(linededup, "HOT_A_PARTITION", a_partition)
    if a_partition > 4:
        monkeypatch.setattr(linededup, "partitions", lambda spark: 4)
        monkeypatch.setattr(linededup, "min", lambda *_: 4096, raising=False)
    rows = line_table()
    spark.createDataFrame([(*r, 1, "k", 2, 3, "r", "o") for r in rows], LINES).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    out = linededup.op13_line_dedup(spark, str(tmp_path)).collect()
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["n_lines"], r["n_dropped"], r["kept_sha256"]) for r in out) == plain_lines(rows)
    con = duckdb.connect()
    con.sql(f"create view documents as select doc_id, text from '{tmp_path}/documents.parquet/*.parquet'")
    want = con.sql(linededup.op13_sql())
    order = ["doc_id", "n_lines", "n_dropped", "kept_runs", "kept_sha256"]
    assert sorted(repr(tuple(r[c] for c in order)) for r in out) == sorted(repr(tuple(r[want.columns.index(c)] for c in order)) for r in want.fetchall())


def test_line_dedup_of_nothing(spark, tmp_path):
    spark.createDataFrame([], LINES).write.parquet(f"{tmp_path}/documents.parquet")
    assert linededup.op13_line_dedup(spark, str(tmp_path)).count() == 0


def test_hot_line_keys_are_found_and_native(spark):
    rows = spark.range(20000).selectExpr("id as d", "if(id % 3 = 0, 42L, xxhash64(id)) as h1")
    assert 42 in [r[0] for r in linededup.hot_keys(rows).collect()] and linededup.hot_keys(rows).count() <= 64
    plan = linededup.hot_keys(rows)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


@pytest.mark.parametrize("name", ["op11_vector_codes", "op12_hard_negatives", "op13_line_dedup"])
def test_against_sql(spark, sf, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    got, want = registry.queries()[name](spark, sf), con.sql(registry.oracle_sql()[name])
    order = sorted(got.columns)
    assert order == sorted(want.columns)
    at = [want.columns.index(c) for c in order]
    assert sorted((tuple(r[c] for c in order) for r in got.collect()), key=repr) == sorted((tuple(r[i] for i in at) for r in want.fetchall()), key=repr)
