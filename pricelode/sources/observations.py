"""The observation log: a typed projection of the ``events`` table with the columns an offer observation has.

Money is held in whole cents, so sums and comparisons are exact; a null store is a value of the identity.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: What makes an offer the same offer over time.
IDENTITY = ["chain", "store", "offer"]
#: The day for which queries ask unless told otherwise.
AS_OF = "2024-01-20"


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    i, user, day = F.col("event_id"), F.col("user_id"), F.to_date("ts")
    e = e.withColumn("cents", F.round(F.col("value") * 100).cast("long")).withColumn("day", day)
    from_ = F.when(i % 11 != 0, F.date_add("day", (i % 5).cast("int")))
    return e.select(
        i.alias("id"),
        F.col("event_type").alias("chain"),
        F.when(user % 5 != 0, (user % 8).cast("string")).alias("store"),
        user.alias("offer"),
        F.concat(F.initcap("event_type"), F.lit(" item "), (user % 200).cast("string")).alias("name"),
        F.when(i % 6 != 0, F.concat(F.lit("Brand#"), (user % 25).cast("string"))).alias("brand"),
        F.col("ts").alias("collected_at"),
        "day",
        "cents",
        F.when(i % 2 == 0, F.col("cents") + F.expr("cents div 4")).alias("regular_cents"),
        F.when(i % 7 != 0, (i % 7 * 5).cast("int")).alias("percent"),
        F.when(i % 4 == 0, F.expr("cents * 9 div 10")).alias("app_cents"),
        (i % 13 == 0).alias("requires_app"),
        (i % 9 == 0).alias("coupon"),
        F.when(i % 3 == 1, "fixed_package").when(i % 3 == 2, "unit_basis").alias("mode"),
        F.when(i % 7 == 0, "").otherwise(F.concat(F.lit("https://img.example/"), user.cast("string"))).alias("image"),
        from_.alias("valid_from"),
        F.date_add(from_, (i % 6).cast("int")).alias("valid_until"),
        F.when(i % 4 == 0, F.date_add("day", 1)).alias("app_from"),
        F.when(i % 4 == 0, F.date_add("day", 2)).alias("app_until"),
        (F.get_json_object("props", "$.k").cast("int") % 10 == 0).alias("rescue"),
        "props",
    )


OBS_SQL = """
select event_id as id, event_type as chain, case when user_id % 5 <> 0 then (user_id % 8)::varchar end as store, user_id as offer,
  upper(event_type[1]) || event_type[2:] || ' item ' || (user_id % 200)::varchar as name,
  case when event_id % 6 <> 0 then 'Brand#' || (user_id % 25)::varchar end as brand,
  ts as collected_at, ts::date as day, round(value * 100)::bigint as cents,
  case when event_id % 2 = 0 then round(value * 100)::bigint + round(value * 100)::bigint // 4 end as regular_cents,
  case when event_id % 7 <> 0 then (event_id % 7 * 5)::int end as percent,
  case when event_id % 4 = 0 then round(value * 100)::bigint * 9 // 10 end as app_cents,
  event_id % 13 = 0 as requires_app, event_id % 9 = 0 as coupon,
  case event_id % 3 when 1 then 'fixed_package' when 2 then 'unit_basis' end as mode,
  case when event_id % 7 = 0 then '' else 'https://img.example/' || user_id::varchar end as image,
  case when event_id % 11 <> 0 then ts::date + (event_id % 5)::int end as valid_from,
  case when event_id % 11 <> 0 then ts::date + (event_id % 5)::int + (event_id % 6)::int end as valid_until,
  case when event_id % 4 = 0 then ts::date + 1 end as app_from, case when event_id % 4 = 0 then ts::date + 2 end as app_until,
  json_extract_string(props, '$.k')::int % 10 = 0 as rescue, props
from events"""
