"""Queries that ask the reads with a caller's parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pricelode.operators import reads
from pricelode.plans.base import query, table
from pricelode.plans.q_pricing import BASKET, BASKET_SQL
from pricelode.plans.q_search import DISCOUNT
from pricelode.plans.q_temporal import WINNERS_SQL
from pricelode.sources.observations import AS_OF, observations

VISIBLE_SQL = f"""{WINNERS_SQL}, twins as (select *, bool_or(rescue) over g and bool_or(not rescue) over g as mixed, row_number() over (g order by rescue desc, collected_at desc, id desc) as rn
  from winners window g as (partition by state, chain, store, lower(name), cents, valid_from, valid_until, image)), visible as (select * from twins where not mixed or rn = 1)"""


@query(f"""with {VISIBLE_SQL}, found as (select * from visible where state = 'upcoming' and chain = 'click' and {DISCOUNT}
  and (contains(lower(name), 'item 1') or contains(lower(coalesce(brand, '')), 'item 1')))
select id, chain, name, cents, (select count(*) from found) as available from found order by collected_at desc, lower(name), chain, id limit 50 offset 5""")
def requested_deals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page of upcoming deals of one retailer, searched, filtered and sorted as a caller asks."""
    page = reads.deals(observations(spark, sf_dir), AS_OF, q=" Item 1", retailer="CLICK", view="upcoming", discount_only=True, sort="newest", offset=5, limit=50)
    return page.select("id", "chain", "name", "cents", "available")


@query(f"""with {VISIBLE_SQL} select chain, count(*) filter (state = 'current') as current, count(*) filter (state = 'upcoming') as upcoming,
  count(*) filter (state = 'expired') as expired, count(*) filter (state = 'unknown') as unknown from visible group by chain""")
def visible_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reads.state_counts(observations(spark, sf_dir), AS_OF)


@query(f"""with seeds as (select distinct chain, store, offer, offer % 40 as product from obs),
cur as (select product, o.chain, o.store, o.offer, o.id, o.cents from seeds s join obs o on s.chain = o.chain and s.store is not distinct from o.store and s.offer = o.offer
  where (mode is null or mode = 'fixed_package') and date '{AS_OF}' between valid_from and valid_until
  qualify row_number() over (partition by product, o.chain, o.store, o.offer order by collected_at desc, o.id) = 1),
n as (select product, count(*) as offers, count(distinct chain || '/' || coalesce(store, '-')) as retailers, min(cents) as least, bool_or(chain = 'click') as asked from cur group by product)
select p_partkey as product, p_name as name, p_brand as brand, offers, retailers, least, 'multi_store_comparison' as status from part join n on p_partkey = product
where asked and retailers >= 2 and (contains(lower(p_name), 'a') or contains(lower(p_brand), 'a')) order by retailers desc, least, lower(p_name), p_partkey limit 100""")
def requested_catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Products that a retailer sells and others too, those with most retailers first."""
    obs = observations(spark, sf_dir)
    products = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("product"), F.col("p_name").alias("name"), F.col("p_brand").alias("brand"))
    links = obs.select((F.col("offer") % 40).alias("product"), "chain", "store", "offer")
    return reads.catalogue(obs, products, links, AS_OF, q="A", retailer="Click", comparison_only=True, sort="retailers_desc")


CUR_SQL = f"""seeds as (select distinct chain, store, offer, offer % 40 as product from obs), cur as (select product, o.chain, o.store, o.offer, o.id, o.cents from seeds s join obs o on s.chain = o.chain and s.store is not distinct from o.store and s.offer = o.offer
  where (mode is null or mode = 'fixed_package') and date '{AS_OF}' between valid_from and valid_until qualify row_number() over (partition by product, o.chain, o.store, o.offer order by collected_at desc, o.id) = 1)"""


def _links(obs: DataFrame) -> DataFrame:
    return obs.select((F.col("offer") % 40).alias("product"), "chain", "store", "offer")


@query(f"""select id, chain, store, offer, collected_at, cents from obs where offer % 40 = 7 and collected_at::date <= date '{AS_OF}' order by collected_at desc, id limit 300""")
def requested_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A product's observations up to a day, newest first."""
    obs = observations(spark, sf_dir)
    return reads.price_history(obs, _links(obs), 7, AS_OF, 300).select("id", "chain", "store", "offer", "collected_at", "cents")


@query(f"""with {CUR_SQL}, {BASKET_SQL}, want as (select product, least(sum(quantity), 99)::bigint as quantity from basket group by product),
best as (select c.*, quantity from cur c join want using (product) qualify row_number() over (partition by chain, store, product order by cents, offer, id) = 1)
select chain, store, sum(cents * quantity)::bigint as total, count(*) as covered, count(*) = (select count(*) from want) as complete,
  coalesce((select string_agg(product::varchar, ',' order by product) from want where not list_contains(list(best.product), product)), '') as missing from best group by chain, store""")
def requested_basket(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A caller's basket at every store."""
    obs = observations(spark, sf_dir)
    found = reads.basket(obs, _links(obs), BASKET, AS_OF)
    return found.select("chain", "store", "total", "covered", "complete", F.array_join(F.array_sort("missing"), ",").alias("missing"))


@query("""with w as (select * from obs where valid_from <= date '2024-01-21' and valid_until >= date '2024-01-15' qualify row_number() over (partition by chain, store, offer order by collected_at desc, id) = 1)
select id, chain, store, offer, cents, (least(valid_until, date '2024-01-21') - greatest(valid_from, date '2024-01-15') + 1)::int as days from w""")
def requested_week(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Offers of the week that starts on a Monday."""
    return reads.weekly(observations(spark, sf_dir), "2024-01-15").select("id", "chain", "store", "offer", "cents", "days")


@query(f"""select id, chain, store, offer, cents from obs where valid_from = date '{AS_OF}' and valid_until = date '{AS_OF}'
qualify row_number() over (partition by chain, store, offer order by collected_at desc, id) = 1""")
def requested_specials(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is on offer on this one day only, the newest of each identity."""
    return reads.daily_specials(observations(spark, sf_dir), AS_OF).select("id", "chain", "store", "offer", "cents")
