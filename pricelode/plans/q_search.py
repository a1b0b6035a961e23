"""Queries of the search over current deals, and of identities."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pricelode.operators import identity, ranking, search
from pricelode.operators.temporal import STATES, newest
from pricelode.plans.base import query, table
from pricelode.plans.q_temporal import WINNERS_SQL, winners
from pricelode.shared import written
from pricelode.sources.observations import IDENTITY, observations

CURRENT_SQL = f"{WINNERS_SQL}, cur as materialized (select * from winners where state = 'current')"
SAVING = "greatest(coalesce(regular_cents - cents, 0), 0)"
DISCOUNT = "(coalesce(regular_cents > cents, false) or coalesce(percent > 0, false))"
UNIT = "coalesce(mode in ('unit_basis', 'example_weight', 'variable_weight'), false)"


def current(spark: SparkSession, sf_dir: str) -> DataFrame:
    return winners(spark, sf_dir).filter("state = 'current'")


@query(f"with {CURRENT_SQL} select id, chain, store, offer, name, brand, cents, regular_cents, app_cents, valid_from, valid_until, collected_at from cur order by lower(name)")
def current_deals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship read: state, winner, current only, in the order of names."""
    cols = ["id", "chain", "store", "offer", "name", "brand", "cents", "regular_cents", "app_cents", "valid_from", "valid_until", "collected_at"]
    return current(spark, sf_dir).orderBy(*search.sort_key("name")).select(*cols)


@query(f"with {WINNERS_SQL} select s.state, count(w.id) as n from (values ('current'), ('upcoming'), ('expired'), ('unknown')) as s(state) left join winners w using (state) group by s.state")
def state_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Zero-filled counts by state."""
    domain = spark.createDataFrame([(s,) for s in STATES], "state string")
    counts = winners(spark, sf_dir).groupBy("state").agg(F.count(F.lit(1)).alias("n"))
    return domain.join(counts, "state", "left").select("state", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


@query(f"""with {WINNERS_SQL} select chain, count(*) filter (state = 'current') as current, count(*) filter (state = 'upcoming') as upcoming,
  count(*) filter (state = 'expired') as expired, count(*) filter (state = 'unknown') as unknown from winners group by chain""")
def chain_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    return winners(spark, sf_dir).groupBy("chain").pivot("state", list(STATES)).count().fillna(0)


@query(f"""with {CURRENT_SQL}, found as (select * from cur where contains(lower(name), 'item 1') or contains(lower(coalesce(brand, '')), 'item 1'))
select 'retailer' as facet, chain as value, count(*) as n from found group by chain
union all select 'feature', 'app', count(*) from found where app_cents is not null or requires_app
union all select 'feature', 'coupon', count(*) from found where coupon
union all select 'feature', 'discount', count(*) from found where {DISCOUNT}
union all select 'feature', 'image', count(*) from found where image <> ''""")
def deal_facets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facets after the search and before the filters."""
    found = current(spark, sf_dir).filter(search.contains_text("Item 1", ["name", "brand"]))
    flags = {"app": search.has_app(), "coupon": F.col("coupon"), "discount": search.has_discount(), "image": search.has_image()}
    values = F.array(F.struct(F.lit("retailer").alias("facet"), F.col("chain").alias("value"), F.lit(True).alias("on")), *(F.struct(F.lit("feature").alias("facet"), F.lit(k).alias("value"), c.alias("on")) for k, c in flags.items()))
    return found.select(F.explode(values).alias("f")).groupBy("f.facet", "f.value").agg(F.count_if("f.on").alias("n"))


@query(f"""with {CURRENT_SQL}, found as (select * from cur where {DISCOUNT} and image <> '' and chain in ('click', 'view')),
page as (select * from found order by cents, lower(name), chain, id limit 25 offset 10)
select id, chain, name, cents, {SAVING} as saving, (select count(*) from found) as available from page""")
def deals_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One page of 25 after 10, with the count of all that the filters leave."""
    found = current(spark, sf_dir).filter(search.has_discount() & search.has_image() & F.lower("chain").isin("click", "view"))
    page = found.orderBy(*search.sort_key("price_asc")).offset(10).limit(25)
    total = found.agg(F.count(F.lit(1))).scalar()
    return page.select("id", "chain", "name", "cents", search.saving().alias("saving"), total.alias("available"))


@query(f"""with {CURRENT_SQL} select id, chain,
  row_number() over (partition by chain order by lower(name), lower(coalesce(brand, '')), cents, coalesce(store, ''), offer, id) as by_name,
  row_number() over (partition by chain order by cents, lower(name), id) as by_price_asc, row_number() over (partition by chain order by cents desc, lower(name), id) as by_price_desc,
  row_number() over (partition by chain order by collected_at desc, lower(name), id) as by_newest,
  row_number() over (partition by chain order by {SAVING} desc, coalesce(percent, 0) desc, cents, lower(name), id) as by_discount_desc from cur""")
def deal_sort_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each row's place within its chain under the five orders."""
    rows = current(spark, sf_dir).select("id", "chain", "store", "offer", "name", "brand", "cents", "regular_cents", "percent", "collected_at")
    rows = written(rows, "current")  # each of the five orders reads it twice
    for s in search.SORTS:
        rows = ranking.numbered(rows, f"by_{s}", search.sort_key(s), ["chain"])
    return rows.select("id", "chain", *(F.col(f"by_{s}").cast("long").alias(f"by_{s}") for s in search.SORTS))


@query(f"""select id, (app_cents is not null or requires_app) as has_app, {DISCOUNT} as has_discount, {SAVING} as saving, image <> '' as has_image,
  mode is null or mode = 'fixed_package' as comparable, not {UNIT} as not_unit_basis from obs""")
def deal_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    fixed = F.col("mode").isNull() | (F.col("mode") == "fixed_package")
    return observations(spark, sf_dir).select("id", search.has_app().alias("has_app"), search.has_discount().alias("has_discount"), search.saving().alias("saving"), search.has_image().alias("has_image"), fixed.alias("comparable"), (~search.unit_basis()).alias("not_unit_basis"))


@query(f"""with {WINNERS_SQL}, m as (select *, bool_or(rescue) over g and bool_or(not rescue) over g as mixed, row_number() over (g order by rescue desc, collected_at desc, id desc) as rn
  from winners window g as (partition by state, chain, store, lower(name), cents, valid_from, valid_until, image))
select id, state, rescue from m where not mixed or rn = 1""")
def rescue_suppression(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identity.suppress_rescued(winners(spark, sf_dir)).select("id", "state", "rescue")


@query(f"""with {CURRENT_SQL}, links as (select o.chain, o.store, o.offer, p_partkey as product from obs o join part on p_partkey = o.offer % 50 + (case when o.id % 97 = 0 then 1 else 0 end)),
one as (select chain, store, offer, min(product) as product from links group by all having count(distinct product) = 1)
select cur.id, one.product from cur left join one on cur.chain = one.chain and cur.store is not distinct from one.store and cur.offer = one.offer""")
def identity_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A product link follows the stable identity (null store included); an ambiguous one links to nothing."""
    obs, part = observations(spark, sf_dir), table(spark, sf_dir, "part")
    linked = obs.withColumn("p_partkey", F.col("offer") % 50 + (F.col("id") % 97 == 0).cast("int")).join(part.select("p_partkey"), "p_partkey")
    one = identity.stable_links(linked.select(*IDENTITY, F.col("p_partkey").alias("product")), IDENTITY, "product")
    cur = current(spark, sf_dir)
    return cur.join(one, identity.null_safe(cur, one, IDENTITY), "left").select(cur["id"], "product")


@query("""with seeds as (select distinct chain, store, offer, offer % 40 as product from obs where id % 3 = 1)
select product, o.chain, o.store, o.offer, o.id, cents from seeds s join obs o on s.chain = o.chain and s.store is not distinct from o.store and s.offer = o.offer
where mode is null or mode = 'fixed_package' qualify row_number() over (partition by product, o.chain, o.store, o.offer order by collected_at desc, o.id) = 1""")
def product_offers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Latest comparable offer of every product's identities; of equal times the smaller id."""
    obs = observations(spark, sf_dir)
    seeds = obs.filter("id % 3 = 1").select(*IDENTITY, (F.col("offer") % 40).alias("product")).distinct()
    fixed = obs.filter("mode is null or mode = 'fixed_package'")
    found = fixed.join(seeds, identity.null_safe(fixed, seeds, IDENTITY)).select("product", *(fixed[k] for k in IDENTITY), fixed["id"], fixed["cents"], fixed["collected_at"])
    return newest(found, ["product", *IDENTITY], F.desc("collected_at"), F.col("id")).drop("collected_at")


@query("""select chain, offer, day, id from obs qualify row_number() over (partition by chain, offer, day order by collected_at desc, id) = 1""")
def newest_of_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    return newest(observations(spark, sf_dir), ["chain", "offer", "day"], F.desc("collected_at"), F.col("id")).select("chain", "offer", "day", "id")


@query("""with a as (select distinct offer, day from obs where chain = 'purchase'), b as (select distinct offer, day from obs where chain = 'click')
select offer, day, 'explicit' as kind from a union all select offer, day, 'ordinary' from b where (offer, day) not in (select (offer, day) from a)""")
def explicit_before_ordinary(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = lambda c, k: observations(spark, sf_dir).filter(F.col("chain") == c).select("offer", "day", F.lit(k).alias("kind")).distinct()
    return identity.first_of_sources([days("purchase", "explicit"), days("click", "ordinary")], ["offer", "day"])


@query("""select doc_id, lang from documents where contains(replace(lower(text), 'ß', 'ss'), 'grossen') or contains(lower(source), 'src1') or contains(lower(text), 'license')""")
def document_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    hit = search.contains_text("Großen", ["text"]) | search.contains_text("SRC1", ["source"]) | search.contains_text("License", ["text"])
    return docs.filter(hit).select("doc_id", "lang")


@query("""select p_partkey, p_name, row_number() over (partition by p_brand order by p_name nulls last, nullif(p_size, 1) nulls last, p_partkey) as place from part""")
def product_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("p_brand").orderBy(F.asc_nulls_last("p_name"), F.asc_nulls_last(F.nullif("p_size", F.lit(1))), "p_partkey")
    return table(spark, sf_dir, "part").select("p_partkey", "p_name", F.row_number().over(w).alias("place"))


@query("""with n as (select chain, id, cents, row_number() over (partition by chain order by cents desc, id) as rn from obs) select chain, id, cents, rn as turn from n where rn <= 5""")
def round_robin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Interleaving: the first of every chain, then the second, and so on, five turns."""
    turn = F.row_number().over(Window.partitionBy("chain").orderBy(F.desc("cents"), "id"))
    return observations(spark, sf_dir).select("chain", "id", "cents", turn.alias("turn")).filter("turn <= 5").orderBy("turn", "chain")
