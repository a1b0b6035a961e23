"""Price comparison: spreads with ties, baskets over scopes, families by unit price."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def spread(df: DataFrame, key: str, scope: Column, price: str) -> DataFrame:
    """Per key the least and greatest price, the scopes, and the spread where there are two scopes at least."""
    out = df.groupBy(key).agg(F.min(price).alias("least"), F.max(price).alias("most"), F.countDistinct(scope).alias("scopes"), F.count(F.lit(1)).alias("offers"))
    return out.withColumn("spread", F.when(F.col("scopes") >= 2, F.col("most") - F.col("least")))


def cheapest(df: DataFrame, keys: list[str], price: str, *ties: str) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(price, *ties))
    return df.withColumn("_rank", rank).filter("_rank = 1").drop("_rank")


def basket_totals(offers: DataFrame, basket: DataFrame, scope: list[str], product: str, price: str, *ties: str) -> DataFrame:
    """Per scope: products of the basket covered, the total, the missing ones.  Equal products in the basket add up to
    99 of each at most; ``basket(product, quantity)`` is as small as a request."""
    wanted = basket.groupBy(product).agg(F.least(F.sum("quantity"), F.lit(99).cast("long")).alias("quantity"))
    size, products = wanted.agg(F.count(F.lit(1))).scalar(), wanted.agg(F.sort_array(F.collect_list(product))).scalar()
    best = cheapest(offers.join(F.broadcast(wanted), product), [*scope, product], price, *ties)
    sums = best.groupBy(*scope).agg(F.sum(F.col(price) * F.col("quantity")).alias("total"), F.count(F.lit(1)).alias("covered"), F.collect_set(product).alias("_has"))
    out = sums.withColumn("wanted", size).withColumn("missing", F.array_except(products, F.col("_has")))
    return out.withColumn("complete", F.col("covered") == F.col("wanted")).drop("_has")


def percent_half_up(part: Column, whole: Column) -> Column:
    """Integer percent, halves away from zero."""
    return F.floor((part * 200 + whole) / (whole * 2)).cast("int")
