"""The queries with SQL against DuckDB, on the tables as they are and on a fixture of copies, nulls and repeated strings."""

import random

import duckdb
import pytest

from pricelode.llm import registry, suffix, warc

SQL = registry.oracle_sql()


def same(frame, want):
    assert sorted(frame.columns) == sorted(want.columns)
    order = sorted(frame.columns)
    at = [want.columns.index(c) for c in order]
    got = sorted((tuple(r[c] for c in order) for r in frame.collect()), key=repr)
    assert got == sorted((tuple(r[i] for i in at) for r in want.fetchall()), key=repr)


@pytest.mark.parametrize("name", ["op2_suffix_dedup", "op8_warc"])
def test_against_sql(spark, sf, name):
    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    same(registry.queries()[name](spark, sf), con.sql(SQL[name]))


def texts():
    pick = random.Random(5)
    word = lambda n: "".join(pick.choice("abcdeéß€ \n") for _ in range(n))
    shared = [word(n) for n in (150, 240, 300, 399, 400, 401, 900)]
    out = [word(pick.randrange(0, 700)) + pick.choice(shared) + word(pick.randrange(0, 300)) + pick.choice(shared) for _ in range(40)]
    return [*out, *out[:3], None, None, "", "x" * 1200, "x" * 1200, "xy" * 450, shared[4], shared[6]]


@pytest.mark.parametrize("which", ["op2", "op8"])
def test_fixture_against_sql(spark, tmp_path, which):
    rows = [(i if i % 9 else None, f"http://h/{i % 5}", t) for i, t in enumerate(texts())]
    name, columns = ("documents", "doc_id long, url string, text string") if which == "op2" else ("pages", "page_id long, url string, html string")
    spark.createDataFrame(rows, columns).write.parquet(f"{tmp_path}/{name}.parquet")
    con = duckdb.connect()
    con.sql(f"create view {name} as select * from '{tmp_path}/{name}.parquet/*.parquet'")
    op, sql = (suffix.op2_suffix_dedup, suffix.op2_sql()) if which == "op2" else (warc.op8_warc, warc.op8_sql())
    same(op(spark, str(tmp_path)), con.sql(sql))
