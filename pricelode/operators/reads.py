"""Reads with a caller's parameters: a page of deals, its facets and counts, and the product catalogue.

``obs`` is an observation log (see ``sources.observations``).  A page is at most ``MOST`` rows, so Spark keeps the first
``offset + limit`` rows of each task and sorts no more than those.
"""

from __future__ import annotations

import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pricelode.operators import identity, pricing, search, temporal

# The parameters' domains and limits, and the states of a comparison.
VIEWS = ("current", "upcoming")
CATALOGUE_SORTS = ("name", "price_asc", "price_desc", "retailers_desc")
MOST = 500
COMPARISON = ("no_current_offers", "single_current_offer", "multi_store_comparison")
#: Where a search looks, if the log has the column.
SEARCHED = ["name", "brand", "description", "package_text"]


def _day(as_of: str | datetime.date) -> Column:
    return F.lit(str(as_of)).cast("date")


def _check(sort: str, sorts: tuple[str, ...], q: str | None, offset: int, limit: int) -> None:
    if sort not in sorts:
        raise ValueError(f"sort is one of {sorts}")
    if q is not None and not 1 <= len(q) <= 100:
        raise ValueError("q has 1 to 100 characters")
    if offset < 0 or not 1 <= limit <= MOST:
        raise ValueError(f"offset is 0 or more, limit 1 to {MOST}")


def _matching(rows: DataFrame, q: str | None, columns: list[str]) -> DataFrame:
    needle = (q or "").strip()
    return rows.filter(search.contains_text(needle, [c for c in columns if c in rows.columns])) if needle else rows


def visible(obs: DataFrame, as_of: str | datetime.date) -> DataFrame:
    """The newest row of each state and identity, with ordinary twins of rescued offers left out."""
    return identity.suppress_rescued(temporal.winners(obs, _day(as_of)))


def state_counts(obs: DataFrame, as_of: str | datetime.date) -> DataFrame:
    """A row for each retailer with the number of its offers in each state, 0 where there is none."""
    return visible(obs, as_of).groupBy("chain").pivot("state", list(temporal.STATES)).count().fillna(0)


def searched(obs: DataFrame, as_of: str | datetime.date, view: str = "current", q: str | None = None) -> DataFrame:
    """Offers of a view that the search finds: what facets are counted on."""
    if view not in VIEWS:
        raise ValueError(f"view is one of {VIEWS}")
    return _matching(visible(obs, as_of).filter(F.col("state") == view), q, SEARCHED)


def facets(obs: DataFrame, as_of: str | datetime.date, view: str = "current", q: str | None = None) -> DataFrame:
    """(facet, value, n): retailers with offers and features, before any filter."""
    flags = {"app": search.has_app(), "coupon": F.col("coupon"), "discount": search.has_discount(), "image": search.has_image()}
    value = lambda facet, name, on: F.struct(F.lit(facet).alias("facet"), name.alias("value"), on.alias("on"))
    values = [value("retailer", F.col("chain"), F.lit(True)), *(value("feature", F.lit(k), on) for k, on in flags.items())]
    rows = searched(obs, as_of, view, q).select(F.explode(F.array(*values)).alias("f"))
    return rows.groupBy("f.facet", "f.value").agg(F.count_if("f.on").alias("n"))


def deals(
    obs: DataFrame, as_of: str | datetime.date, q: str | None = None, retailer: str | None = None, view: str = "current",
    app_only: bool = False, coupon_only: bool = False, discount_only: bool = False, image_only: bool = False,
    sort: str = "name", offset: int = 0, limit: int = 250,
) -> DataFrame:
    """One page of deals in the order asked for; ``available`` is the number of all that the filters leave."""
    _check(sort, search.SORTS, q, offset, limit)
    rows = searched(obs, as_of, view, q)
    if retailer and retailer.strip():
        rows = rows.filter(F.lower("chain") == retailer.strip().lower())
    asked = [(app_only, search.has_app()), (coupon_only, F.col("coupon")), (discount_only, search.has_discount()), (image_only, search.has_image())]
    for wanted, holds in asked:
        rows = rows.filter(holds) if wanted else rows
    available = rows.agg(F.count(F.lit(1))).scalar()
    return rows.orderBy(*search.sort_key(sort)).offset(offset).limit(limit).withColumn("available", available)


def current_offers(obs: DataFrame, links: DataFrame, as_of: str | datetime.date) -> DataFrame:
    """The newest open offer of each identity of a product; ``links`` has product, chain, store and offer.  Only offers of
    whole packages count; of equal times the smaller id stays."""
    day = _day(as_of)
    fixed = obs.filter((F.col("mode").isNull() | (F.col("mode") == "fixed_package")) & F.col("offer").isNotNull() & day.between(F.col("valid_from"), F.col("valid_until")))
    keys = ["chain", "store", "offer"]
    seeds = links.select("product", *(F.col(k).alias(f"_{k}") for k in keys)).distinct()
    same = F.col("chain").eqNullSafe(F.col("_chain")) & F.col("store").eqNullSafe(F.col("_store")) & F.col("offer").eqNullSafe(F.col("_offer"))
    joined = fixed.join(seeds, same).drop("_chain", "_store", "_offer")
    return temporal.newest(joined, ["product", *keys], F.desc("collected_at"), F.col("id"))


def catalogue(
    obs: DataFrame, products: DataFrame, links: DataFrame, as_of: str | datetime.date, q: str | None = None, retailer: str | None = None,
    current_only: bool = False, comparison_only: bool = False, sort: str = "name", limit: int = 100,
) -> DataFrame:
    """Products (product, name, brand) with their current offers counted and compared, in the order asked for."""
    _check(sort, CATALOGUE_SORTS, q, 0, limit)
    asked = F.lower("chain") == (retailer or "").strip().lower()
    found = current_offers(obs, links, as_of).groupBy(F.col("product").alias("_product")).agg(
        F.count(F.lit(1)).alias("offers"), F.countDistinct(F.struct("chain", "store")).alias("retailers"), F.min("cents").alias("least"), F.bool_or(asked).alias("_asked"),
    )
    rows = _matching(products, q, ["name", "brand"]).join(found, F.col("product") == F.col("_product"), "left").drop("_product")
    rows = rows.withColumns({c: F.coalesce(c, F.lit(0).cast("long")) for c in ("offers", "retailers")})
    status = F.when(F.col("offers") == 0, COMPARISON[0]).when(F.col("retailers") == 1, COMPARISON[1]).otherwise(COMPARISON[2])
    rows = rows.withColumn("status", status)
    if retailer and retailer.strip():
        rows = rows.filter("_asked")
    rows = rows.filter("offers > 0") if current_only else rows
    rows = rows.filter(F.col("status") == COMPARISON[2]) if comparison_only else rows
    orders = {
        "price_asc": [F.asc_nulls_last("least"), search.folded("name")],
        "price_desc": [F.desc_nulls_last("least"), search.folded("name")],
        "retailers_desc": [F.desc("retailers"), F.asc_nulls_last("least"), search.folded("name")],
        "name": [F.asc_nulls_last(F.lower("brand")), search.folded("name")],
    }
    return rows.orderBy(*orders[sort], F.col("product")).limit(limit).drop("_asked")


def price_history(obs: DataFrame, links: DataFrame, product: int, until: str | datetime.date | None = None, limit: int = 200) -> DataFrame:
    """What was seen of a product's identities, newest first; of equal times the smaller id comes first."""
    if not 1 <= limit <= MOST:
        raise ValueError(f"limit is 1 to {MOST}")
    keys = links.filter(F.col("product") == product).select(*(F.col(k).alias(f"_{k}") for k in ("chain", "store", "offer")))
    same = F.col("chain").eqNullSafe(F.col("_chain")) & F.col("store").eqNullSafe(F.col("_store")) & F.col("offer").eqNullSafe(F.col("_offer"))
    rows = obs if until is None else obs.filter(F.to_date("collected_at") <= _day(until))
    return rows.join(keys, same, "left_semi").orderBy(F.desc("collected_at"), "id").limit(limit)


def basket(obs: DataFrame, links: DataFrame, items: list[tuple[int, int]], as_of: str | datetime.date) -> DataFrame:
    """The total of a basket of (product, quantity) at every store, cheapest complete ones first; a store that lacks some is
    told which."""
    if not items or any(n < 1 for _, n in items):
        raise ValueError("a basket has items, each at least once")
    wanted = obs.sparkSession.createDataFrame(items, "product long, quantity long")
    offers = current_offers(obs, links, as_of).withColumn("product", F.col("product").cast("long"))
    totals = pricing.basket_totals(offers, wanted, ["chain", "store"], "product", "cents", "offer", "id")
    return totals.orderBy(F.desc("complete"), F.desc("covered"), "total", "chain", "store")


def weekly(obs: DataFrame, week_start: str | datetime.date) -> DataFrame:
    """The newest offer of each identity that is open in the week of a Monday, with the days it is open in it."""
    first = datetime.date.fromisoformat(str(week_start))
    if first.weekday():
        raise ValueError("a week starts on a Monday")
    monday, sunday = _day(first), _day(first + datetime.timedelta(days=6))
    touching = obs.filter((F.col("valid_from") <= sunday) & (F.col("valid_until") >= monday))
    days = F.datediff(F.least("valid_until", sunday), F.greatest("valid_from", monday)) + 1
    return temporal.newest(touching.withColumn("days", days), ["chain", "store", "offer"], F.desc("collected_at"), F.col("id"))


def daily_specials(obs: DataFrame, as_of: str | datetime.date) -> DataFrame:
    """The newest of each identity's offers that are open on this one day only."""
    day = _day(as_of)
    return temporal.newest(obs.filter((F.col("valid_from") == day) & (F.col("valid_until") == day)), ["chain", "store", "offer"], F.desc("collected_at"), F.col("id"))
