"""Queries on prices: catalogue, comparison, basket, history, families."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pricelode.operators import pricing
from pricelode.plans.base import query, table
from pricelode.plans.q_search import CURRENT_SQL, current
from pricelode.sources.observations import observations

#: A request: (product, quantity); one product comes twice.
BASKET = [(1, 2), (2, 1), (3, 60), (5, 1), (3, 50)]
BASKET_SQL = "basket(product, quantity) as (values " + ", ".join(f"({p}, {q})" for p, q in BASKET) + ")"


def priced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Current comparable deals with their product."""
    return current(spark, sf_dir).filter("mode is null or mode = 'fixed_package'").withColumn("product", F.col("offer") % 40)


PRICED_SQL = f"{CURRENT_SQL}, priced as materialized (select *, offer % 40 as product from cur where mode is null or mode = 'fixed_package')"


@query(f"""with {PRICED_SQL} select product, min(cents) as least, max(cents) as most, count(distinct (chain, store)) as scopes, count(*) as offers,
  case when count(distinct (chain, store)) >= 2 then max(cents) - min(cents) end as spread from priced group by product""")
def price_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pricing.spread(priced(spark, sf_dir), "product", F.struct("chain", "store"), "cents")


@query(f"with {PRICED_SQL} select product, id, chain, store, cents from priced qualify cents = min(cents) over (partition by product)")
def cheapest_with_ties(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = priced(spark, sf_dir).withColumn("least", F.min("cents").over(Window.partitionBy("product")))
    return rows.filter("cents = least").select("product", "id", "chain", "store", "cents")


@query(f"""with {PRICED_SQL} select p_partkey, p_name, count(distinct chain || '/' || coalesce(store, '-')) as retailers, min(cents) as least,
  case count(distinct chain || '/' || coalesce(store, '-')) when 0 then 'none' when 1 then 'single' else 'comparable' end as status
from part left join priced on p_partkey = product group by all""")
def catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part")
    joined = parts.join(priced(spark, sf_dir), F.col("p_partkey") == F.col("product"), "left")
    scope = F.when(F.col("id").isNotNull(), F.struct("chain", "store"))
    out = joined.groupBy("p_partkey", "p_name").agg(F.countDistinct(scope).alias("retailers"), F.min("cents").alias("least"))
    return out.withColumn("status", F.when(F.col("retailers") == 0, "none").when(F.col("retailers") == 1, "single").otherwise("comparable"))


@query(f"with {PRICED_SQL} select chain, count(*) as offers, count(distinct product) as products, min(cents) as least, sum(cents)::bigint as total from priced group by chain")
def overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    return priced(spark, sf_dir).groupBy("chain").agg(F.count(F.lit(1)).alias("offers"), F.countDistinct("product").alias("products"), F.min("cents").alias("least"), F.sum("cents").alias("total"))


@query(f"""with {PRICED_SQL}, {BASKET_SQL}, want as (select product, least(sum(quantity), 99)::bigint as quantity from basket group by product),
best as (select p.*, quantity from priced p join want using (product) qualify row_number() over (partition by chain, store, product order by cents, offer, id) = 1),
sums as (select chain, store, sum(cents * quantity)::bigint as total, count(*) as covered, list(product) as has from best group by chain, store)
select chain, store, total, covered, (select count(*) from want) as wanted, covered = (select count(*) from want) as complete,
  coalesce((select string_agg(product::varchar, ',' order by product) from want where not list_contains(has, product)), '') as missing from sums""")
def basket_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    basket = spark.createDataFrame(BASKET, "product long, quantity long")
    totals = pricing.basket_totals(priced(spark, sf_dir), basket, ["chain", "store"], "product", "cents", "offer", "id")
    return totals.withColumn("missing", F.array_join(F.array_sort("missing"), ","))


@query("""with b as (select o_custkey as scope, l_partkey % 20 as product, round(l_extendedprice * 100)::bigint as cents, l_orderkey, l_linenumber from lineitem join orders on l_orderkey = o_orderkey),
best as (select * from b where product < 3 qualify row_number() over (partition by scope, product order by cents, l_orderkey, l_linenumber) = 1),
t as (select scope, sum(cents)::bigint as total, count(*) as covered from best group by scope having count(*) = 3)
select scope, total, total - min(total) over () as over_best from t qualify rank() over (order by total) <= 10""")
def best_baskets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten cheapest complete baskets, ties included."""
    lines, orders = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    rows = lines.join(orders, lines["l_orderkey"] == orders["o_orderkey"])
    rows = rows.select(F.col("o_custkey").alias("scope"), (F.col("l_partkey") % 20).alias("product"), F.round(F.col("l_extendedprice") * 100).cast("long").alias("cents"), "l_orderkey", "l_linenumber").filter("product < 3")
    best = pricing.cheapest(rows, ["scope", "product"], "cents", "l_orderkey", "l_linenumber")
    totals = best.groupBy("scope").agg(F.sum("cents").alias("total"), F.count(F.lit(1)).alias("covered")).filter("covered = 3").select("scope", "total")
    top = totals.orderBy("total", "scope").limit(10)
    edge, least = top.agg(F.max("total")).scalar(), top.agg(F.min("total")).scalar()
    return totals.filter(F.col("total") <= edge).select("scope", "total", (F.col("total") - least).alias("over_best"))


@query("""select id, chain, store, offer, collected_at, cents from obs where (chain, coalesce(store, '-'), offer) in (select (chain, coalesce(store, '-'), offer) from obs where id % 3 = 1 and offer % 40 = 7)
order by collected_at desc, id limit 500""")
def price_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All observations of a product's identities, newest first, 500 at most."""
    obs = observations(spark, sf_dir)
    keys = obs.filter("id % 3 = 1 and offer % 40 = 7").select(F.col("chain").alias("c"), F.col("store").alias("s"), F.col("offer").alias("o")).distinct()
    same = obs["chain"].eqNullSafe(keys["c"]) & obs["store"].eqNullSafe(keys["s"]) & obs["offer"].eqNullSafe(keys["o"])
    return obs.join(keys, same, "left_semi").orderBy(F.desc("collected_at"), "id").limit(500).select("id", "chain", "store", "offer", "collected_at", "cents")


@query("""select offer, id, row_number() over w as place, case when max(cents) over g = min(cents) over g then 0.5 else round((cents - min(cents) over g) / (max(cents) over g - min(cents) over g)::double, 6) end as height
from obs where chain = 'click' window w as (partition by offer order by collected_at, id), g as (partition by offer)""")
def price_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = observations(spark, sf_dir).filter("chain = 'click'")
    g = Window.partitionBy("offer")
    low, high = F.min("cents").over(g), F.max("cents").over(g)
    place = F.row_number().over(g.orderBy("collected_at", "id"))
    marked = rows.select("offer", "id", "cents", place.alias("place"), low.alias("low"), high.alias("high"))
    height = F.when(F.col("high") == F.col("low"), F.lit(0.5)).otherwise(F.round((F.col("cents") - F.col("low")) / (F.col("high") - F.col("low")), 6))
    return marked.select("offer", "id", "place", height.alias("height"))


@query("""with f as (select l_partkey % 100 as family, l_suppkey as scope, round(l_extendedprice * 100)::bigint as cents, l_quantity::int as quantity, l_orderkey, l_linenumber from lineitem where l_returnflag <> 'R'),
u as (select *, cents * 1000 // quantity as unit_price from f)
select family, count(*) as offers, min(unit_price) as least, max(unit_price) - min(unit_price) as spread, count(*) filter (unit_price = low) as ties,
  case when count(distinct quantity) = 1 then min(cents) end as package_price from (select *, min(unit_price) over (partition by family) as low from u) group by family""")
def family_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unit prices within a family; packages are compared only if all are alike."""
    rows = table(spark, sf_dir, "lineitem").filter("l_returnflag <> 'R'")
    rows = rows.select((F.col("l_partkey") % 100).alias("family"), F.round(F.col("l_extendedprice") * 100).cast("long").alias("cents"), F.col("l_quantity").cast("int").alias("quantity"))
    rows = rows.withColumn("unit_price", F.expr("cents * 1000 div quantity"))
    marked = rows.withColumn("low", F.min("unit_price").over(Window.partitionBy("family")))
    return marked.groupBy("family").agg(
        F.count(F.lit(1)).alias("offers"), F.min("unit_price").alias("least"), (F.max("unit_price") - F.min("unit_price")).alias("spread"), F.count_if(F.col("unit_price") == F.col("low")).alias("ties"),
        F.when(F.countDistinct("quantity") == 1, F.min("cents")).alias("package_price"),
    )


@query("""select id, case when regular_cents > cents then (((regular_cents - cents) * 200 + regular_cents) // (regular_cents * 2))::int end as percent_off,
  round_even(cents / 8.0, 0)::bigint as half_even, round(cents / 8.0, 0)::bigint as half_up from obs""")
def rounding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Discounts round half up, ratios half to even."""
    off = F.when(F.col("regular_cents") > F.col("cents"), pricing.percent_half_up(F.col("regular_cents") - F.col("cents"), F.col("regular_cents")))
    eighth = F.col("cents").cast("decimal(18,3)") / F.lit(8).cast("decimal(2,0)")
    return observations(spark, sf_dir).select("id", off.alias("percent_off"), F.bround(eighth, 0).cast("long").alias("half_even"), F.round(eighth, 0).cast("long").alias("half_up"))
