"""Reads with parameters: pages join to the whole, filters and search against plain Python, wrong parameters refused."""

import pytest
from pyspark.sql import functions as F

from pricelode.operators import reads, search
from pricelode.sources.observations import AS_OF, observations


@pytest.fixture(scope="module")
def obs(spark, sf):
    return observations(spark, sf)


@pytest.mark.parametrize("sort", search.SORTS)
def test_pages_join_to_the_whole(obs, sort):
    whole = [r["id"] for r in reads.deals(obs, AS_OF, sort=sort, limit=500).collect()]
    parts = [r["id"] for k in range(0, len(whole), 20) for r in reads.deals(obs, AS_OF, sort=sort, offset=k, limit=20).collect()]
    assert whole and parts == whole and len(set(whole)) == len(whole)


def test_filters_and_facets(obs):
    rows = reads.visible(obs, AS_OF).filter("state = 'current'").collect()
    found = [r for r in rows if "item 1" in r["name"].lower() or "item 1" in (r["brand"] or "").lower()]
    app = [r for r in found if r["app_cents"] is not None or r["requires_app"]]
    got = reads.deals(obs, AS_OF, q="ITEM 1 ", app_only=True, limit=500).collect()
    assert {r["id"] for r in got} == {r["id"] for r in app} and {r["available"] for r in got} == {len(app)}
    counts = {(r["facet"], r["value"]): r["n"] for r in reads.facets(obs, AS_OF, q="item 1").collect()}
    assert counts["feature", "app"] == len(app) and sum(n for (f, _), n in counts.items() if f == "retailer") == len(found)
    chain = found[0]["chain"]
    asked = reads.deals(obs, AS_OF, q="item 1", retailer=f" {chain.upper()} ", coupon_only=True, limit=500).collect()
    assert {r["id"] for r in asked} == {r["id"] for r in found if r["chain"] == chain and r["coupon"]}


def test_wrong_parameters(obs):
    for wrong in ({"sort": "best"}, {"view": "expired"}, {"limit": 0}, {"limit": 501}, {"offset": -1}, {"q": ""}, {"q": "x" * 101}):
        with pytest.raises(ValueError):
            reads.deals(obs, AS_OF, **wrong)


def test_catalogue_states(spark, obs):
    schema = "id long, chain string, store string, offer long, cents long, mode string, valid_from date, valid_until date, collected_at timestamp"
    rows = [(1, "a", None, 1, 200, None), (2, "b", "1", 2, 150, "fixed_package"), (3, "a", None, 3, 90, None), (4, "a", "1", 4, 10, "unit_basis"), (5, "a", None, 1, 210, None)]
    log = spark.createDataFrame([(*r, None, None, None) for r in rows], schema).withColumns({c: F.lit("2024-01-20").cast("date") for c in ("valid_from", "valid_until")})
    log = log.withColumn("collected_at", F.lit("2024-01-20").cast("timestamp"))
    products = spark.createDataFrame([(1, "milk", "x"), (2, "bread", None), (3, "salt", "x")], "product long, name string, brand string")
    links = spark.createDataFrame([(1, "a", None, 1), (1, "b", "1", 2), (2, "a", None, 3), (3, "a", "1", 4), (1, "a", None, 1)], "product long, chain string, store string, offer long")
    ask = lambda **k: [(r["product"], r["offers"], r["retailers"], r["least"], r["status"]) for r in reads.catalogue(log, products, links, "2024-01-20", **k).collect()]
    milk, bread, salt = (1, 2, 2, 150, reads.COMPARISON[2]), (2, 1, 1, 90, reads.COMPARISON[1]), (3, 0, 0, None, reads.COMPARISON[0])
    assert ask() == [milk, salt, bread]
    assert ask(sort="price_asc") == [bread, milk, salt] and ask(sort="price_desc") == [milk, bread, salt] and ask(sort="retailers_desc") == [milk, bread, salt]
    assert ask(current_only=True) == [milk, bread] and ask(comparison_only=True) == [milk] and ask(retailer="B") == [milk] and ask(q="BREA") == [bread]
