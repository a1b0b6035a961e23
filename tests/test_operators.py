"""Operators on small hand-made tables: the cases their rules turn on."""

import itertools
import uuid
from datetime import date

import numpy as np
import pytest
from pyspark.sql import functions as F

from pricelode.functions import text, walk
from pricelode.operators import diff, geometry, identity, log, matching, pricing, temporal
from pricelode.sources import readers
from pricelode.streaming import replay

D = lambda d: date(2024, 1, d)
OBS = "id int, valid_from date, valid_until date, app_cents long, app_from date, app_until date"


@pytest.mark.parametrize(
    ("row", "want"),
    [
        ((D(1), D(20), None, None, None), "current"),  # the last day counts
        ((D(20), D(20), None, None, None), "current"),
        ((D(21), D(22), None, None, None), "upcoming"),
        ((D(1), D(19), None, None, None), "expired"),
        ((D(1), None, None, None, None), "unknown"),  # half a window is none
        ((D(1), D(5), None, D(18), D(22)), "expired"),  # the app's window needs its price
        ((D(1), D(5), 90, D(18), D(22)), "current"),
        ((None, None, 90, D(18), D(19)), "expired"),
        ((D(1), D(5), 90, D(21), D(22)), "upcoming"),
        ((D(1), D(5), 90, None, D(22)), "expired"),
        ((None, None, None, None, None), "unknown"),
    ],
)
def test_state(spark, row, want):
    frame = spark.createDataFrame([(1, *row)], OBS)
    assert frame.select(temporal.state(F.lit("2024-01-20").cast("date"))).first()[0] == want


def test_winner_ties(spark):
    rows = [(1, D(1), D(30), 5), (2, D(1), D(30), 5), (3, D(1), D(30), 4)]
    frame = spark.createDataFrame([(i, a, b, None, None, None, "c", None, 7, t) for i, a, b, t in rows], OBS + ", chain string, store string, offer int, collected_at int")
    assert [r["id"] for r in temporal.winners(frame, F.lit("2024-01-20").cast("date")).collect()] == [2]


def test_islands_and_streaks(spark):
    days = spark.createDataFrame([("a", D(d)) for d in (1, 8, 15, 16, 29)], "k string, day date")
    got = temporal.islands(days, ["k"], "day", gap=7).select("length").collect()
    assert sorted(r[0] for r in got) == [1, 1, 3]
    flags = spark.createDataFrame([("a", i, f) for i, f in enumerate([True, False, True, True])] + [("b", 0, False)], "k string, i int, f boolean")
    assert dict(map(tuple, temporal.trailing_streak(flags, ["k"], [F.desc("i")], F.col("f")).collect())) == {"a": 2, "b": 0}


def test_ambiguous_links_give_none(spark):
    links = spark.createDataFrame([("c", None, 1, 10), ("c", None, 1, 10), ("c", "s", 2, 10), ("c", "s", 2, 11)], "chain string, store string, offer int, product int")
    found = identity.stable_links(links, ["chain", "store", "offer"], "product")
    assert [tuple(r) for r in found.collect()] == [("c", None, 1, 10)]
    keys = spark.createDataFrame([("c", None, 1), ("c", "s", 2)], "chain string, store string, offer int")
    joined = keys.join(found, identity.null_safe(keys, found, ["chain", "store", "offer"]), "left")
    assert sorted((r["product"] is None, r["product"]) for r in joined.select("product").collect()) == [(False, 10), (True, None)]


def test_rescue_keeps_the_newest_rescued(spark):
    base = dict(state="current", chain="c", store=None, name="Milk", cents=99, valid_from=D(1), valid_until=D(2), image="u")
    rows = [dict(base, id=i, rescue=r, collected_at=t) for i, r, t in ((1, False, 9), (2, True, 5), (3, True, 7))] + [dict(base, id=4, rescue=False, collected_at=1, name="milk!"), dict(base, id=5, rescue=True, collected_at=1, store="x")]
    schema = "state string, chain string, store string, name string, cents int, valid_from date, valid_until date, image string, id int, rescue boolean, collected_at int"
    assert sorted(r["id"] for r in identity.suppress_rescued(spark.createDataFrame(rows, schema)).collect()) == [3, 4, 5]


def test_basket(spark):
    offers = spark.createDataFrame([("a", 1, 100, 1), ("a", 1, 90, 2), ("a", 2, 50, 3), ("b", 1, 80, 4)], "scope string, product int, cents long, id int")
    basket = spark.createDataFrame([(1, 60), (1, 60), (2, 1)], "product int, quantity long")
    got = {r["scope"]: r for r in pricing.basket_totals(offers, basket, ["scope"], "product", "cents", "id").collect()}
    assert (got["a"]["total"], got["a"]["complete"], got["a"]["missing"]) == (90 * 99 + 50, True, [])
    assert (got["b"]["total"], got["b"]["complete"], got["b"]["missing"]) == (80 * 99, False, [2])


PACKAGES = [
    ("2 x 250 g", (250.0, "g", 2, "metric_multipack")), ("4x100ml", (100.0, "ml", 4, "metric_multipack")), ("1,5 kg Beutel", (1500.0, "g", 1, "metric_single")), ("75 cl", (750.0, "ml", 1, "metric_single")),
    ("0.33 l", (330.0, "ml", 1, "metric_single")), ("10er-Packung", (None, "piece", 10, "count_pack")), ("8er Rolle", (None, "piece", 8, "count_pack")), ("6 Stück", (None, "piece", 6, "piece_count")), ("3 Stk.", (None, "piece", 3, "piece_count")),
    ("Stück", (None, "piece", 1, "piece_single")), ("kg-Preis", (None, None, None, "variable_weight_kg_price")), ("Beutel", (None, None, None, None)), (None, (None, None, None, None)), ("3 Gramm", (None, None, None, None)),
]


def test_packages(spark):
    frame = spark.createDataFrame([(i, p) for i, (p, _) in enumerate(PACKAGES)], "i int, p string")
    got = {r["i"]: tuple(r["x"]) for r in frame.select("i", text.package(F.col("p")).alias("x")).collect()}
    assert got == {i: want for i, (_, want) in enumerate(PACKAGES)}


def test_codes_prices_dates(spark):
    one = lambda c, *v: [r[0] for r in spark.createDataFrame([(x,) for x in v], "x string").select(c(F.col("x"))).collect()]
    assert one(text.gtin14, "4006381333931", "96385074", "4006381333932", "036000291452", "12", None, "40-06381 333931", "abc") == ["04006381333931", "00000096385074", None, "00036000291452", None, None, "04006381333931", None]
    assert one(text.price_cents, "1,99", "1.–", "2,5 €", "12", "a", "1.234,00", "3-") == [199, 100, 250, 1200, None, None, 300]
    assert one(lambda c: text.date_range(c, 2024)["last"], "gültig 28.12. bis 03.01.", "1.2. - 5.2.", "x") == [date(2025, 1, 3), date(2024, 2, 5), None]
    assert one(text.normalized, "Süß & Salzig 50%!", None, "  ") == ["süss salzig 50%", "", ""]
    assert one(text.composed, "ﬁne ①", "STRASSE ß") == ["fine 1", "strasse ss"]
    assert one(text.ascii_folded, "Crème Brûlée ß") == ["cremebruleess"]


def test_nearest_year(spark):
    frame = spark.createDataFrame([(28, 12, D(3)), (5, 1, date(2023, 12, 30)), (1, 6, D(15))], "d int, m int, r date")
    assert [r[0] for r in frame.select(text.nearest_year(F.col("d"), F.col("m"), F.col("r"))).collect()] == [date(2023, 12, 28), date(2024, 1, 5), date(2024, 6, 1)]


def test_match_evidence(spark):
    rows = [("x", "vollmilch frisch", "berg", 1), ("y", "berg vollmilch frisch", "q", 1), ("y", "vollmilch frisch", "q", 2), ("z", "vollmilch frisch", "q", 0), ("z", "andere milch", "q", 1)]
    parts = spark.createDataFrame(rows, "p_type string, p_name string, p_brand string, p_size int")
    got = {(r["left_chain"], r["right_chain"], r["left_name"], r["right_name"]): (r["method"], r["score"]) for r in matching.evidence(matching.blocked_pairs(matching.products(parts))).collect()}
    assert got[("x", "y", "vollmilch frisch", "berg vollmilch frisch")] == ("brand_prefix", 0.99)
    assert got[("x", "z", "vollmilch frisch", "vollmilch frisch")] == ("exact_name", 0.88)
    assert ("x", "y", "vollmilch frisch", "vollmilch frisch") not in got  # another package
    assert not any("andere milch" in k for k in got)


def test_walk_and_ids(spark):
    assert list(walk.walk({"a": [{"b": 1}, {"c": None}]})) == [("$.a", "a", None), ("$.a[0].b", "b", "1"), ("$.a[1].c", "c", None)]
    rows = spark.createDataFrame([(1, '{"x":{"Bar_Code":"4006381333931"},"ean":"96385074"}'), (2, "no json"), (3, '{"ean":"1"}'), (4, None)], "id int, j string")
    assert [tuple(r) for r in walk.explicit_codes(rows, "id", "j").collect()] == [(1, "04006381333931", "$.x.Bar_Code")]
    names = ["a", "ü:1", "snapshot:42"] + [f"n{i}" for i in range(40)]
    space = str(uuid.NAMESPACE_DNS)
    frame = spark.createDataFrame([(n,) for n in names], "n string")
    got = dict(map(tuple, frame.select("n", walk.uuid5_column(space, F.col("n"))).collect()))
    assert got == {n: str(uuid.uuid5(uuid.NAMESPACE_DNS, n)) for n in names}
    assert dict(map(tuple, frame.select("n", walk.uuid5(F.lit(space), F.col("n"))).collect())) == got


def test_assignment_is_the_cheapest():
    rng = np.random.default_rng(2)
    for n, m in itertools.product((1, 2, 4), (4, 6)):
        cost = rng.integers(0, 30, (n, m)).astype(float)
        got = geometry._hungarian(cost)
        assert len(set(got)) == n
        best = min(sum(cost[i, c] for i, c in enumerate(p)) for p in itertools.permutations(range(m), n))
        assert sum(cost[i, c] for i, c in enumerate(got)) == best


def test_components_of_chains(spark):
    nodes = spark.createDataFrame([(i,) for i in range(12)], "id long")
    edges = spark.createDataFrame([(i, i + 1) for i in range(6)] + [(9, 8)], "a long, b long")
    assert dict(map(tuple, geometry.components(nodes, edges).collect())) == {**dict.fromkeys(range(7), 0), 7: 7, 8: 8, 9: 8, 10: 10, 11: 11}


def test_rollover_pairs_by_content(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a"), (4, "x")], "p int, c string")
    new = spark.createDataFrame([(1, "a"), (5, "a"), (6, "b"), (7, "y")], "p int, c string")
    got = sorted((r["c"], r["old_place"] or 0, r["new_place"] or 0, r["kind"]) for r in diff.rollover(old, new, "p", "c").collect())
    assert got == [("a", 1, 1, "same"), ("a", 3, 5, "moved"), ("b", 2, 6, "moved"), ("x", 4, 0, "old_only"), ("y", 0, 7, "new_only")]


def test_digest_ignores_order_and_keeps_repeats(spark):
    d = lambda rows: spark.createDataFrame([(x,) for x in rows], "x string").agg(diff.multiset_digest([F.col("x")])).first()[0]
    assert d("abc") == d("cab") != d("abcc")


def test_append_is_idempotent(spark, tmp_path):
    batch = spark.createDataFrame([(1, None, "a"), (2, "s", "b"), (2, "s", "b")], "id int, store string, v string")
    path = f"{tmp_path}/log"
    assert log.append_batch(spark, batch, path, ["id", "store"]) == 2
    assert log.append_batch(spark, batch, path, ["id", "store"]) == 0
    assert log.append_batch(spark, spark.createDataFrame([(1, "s", "c")], batch.schema), path, ["id", "store"]) == 1
    assert spark.read.parquet(path).count() == 3


def test_dom_cards(spark):
    html = '<article><h2>A <b>b</b></h2><a href="#x">go</a><p>1,99</p><script>no</script></article><p>out</p><article><br>z</article>'
    got = readers.dom_cards(spark.createDataFrame([(1, html), (2, None)], "id int, html string"), "id", "html").collect()
    assert [tuple(r) for r in got] == [(1, 0, "#x", "A b", "A b go 1,99"), (1, 1, None, "", "z")]


def test_stream_takes_up_where_it_ended(spark, tmp_path):
    rows = spark.createDataFrame([(i, f"2024-01-01 00:00:{i:02d}") for i in range(5)], "id int, t string").select("id", F.col("t").cast("timestamp").alias("t"))
    rows.write.parquet(f"{tmp_path}/in")
    stream = lambda: replay.deduplicated(spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in"), ["id"], "t", "1 hour")
    replay.run_to_end(stream(), f"{tmp_path}/out", f"{tmp_path}/state")
    rows.filter("id < 2").union(rows.filter("id = 4").selectExpr("id + 5", "t")).write.mode("append").parquet(f"{tmp_path}/in")
    replay.run_to_end(stream(), f"{tmp_path}/out", f"{tmp_path}/state")
    assert sorted(r[0] for r in spark.read.parquet(f"{tmp_path}/out").select("id").collect()) == [0, 1, 2, 3, 4, 9]


def test_block_lines(spark):
    """Prices, package and name of a text block: hyphenated names, prices that end in a digit of their line's number, none."""
    from pricelode.functions import blocks as b

    texts = ["Ries-\nling\n0,75 l\nUVP 5,99\n3,45\n(1 l = 4,60)\nzzgl. Pfand 0,25", "Bio-\nMilch \n 1 l \n1,10", "  ", None, "Käse\n(1 kg = 9,90)\n2,99"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").withColumn("rows", b.lines(F.col("t")))
    at = b.package_line(F.col("rows"))
    got = rows.select(b.joined_name(F.col("rows"), at), b.package(F.col("rows"), at), b.primary_price(F.col("rows")), b.regular_price(F.col("rows")), b.deposit(F.col("t")), *b.unit_price(F.col("t"))).collect()
    assert [tuple(r) for r in got] == [("Riesling", "0,75 l", 345, 599, 25, 460, "l"), ("Bio-Milch", "1 l", 110, None, None, None, None), (None,) * 7, (None,) * 7, (None, None, 299, None, None, 990, "kg")]


def test_numbered_in_a_hot_group(spark):
    """Places are those of a window, though one group holds most rows and a group is null."""
    from pricelode.operators import ranking

    rows = spark.range(3000).select("id", F.when(F.col("id") % 50 == 0, None).when(F.col("id") % 10 == 1, "rare").otherwise("hot").alias("g"), (F.col("id") * 37 % 101).alias("v"))
    got = {r["id"]: r["place"] for r in ranking.numbered(rows, "place", [F.desc("v"), F.col("id")], ["g"]).collect()}
    want, seen = {}, {}
    for r in sorted(rows.collect(), key=lambda r: (-r["v"], r["id"])):
        seen[r["g"]] = want[r["id"]] = seen.get(r["g"], 0) + 1
    assert got == want
    assert ranking.numbered(rows.limit(0), "place", [F.col("id")]).count() == 0
    assert sorted(r["place"] for r in ranking.numbered(rows, "place", [F.col("id")]).collect()) == list(range(1, 3001))
