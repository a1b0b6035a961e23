"""Queries that find rows by an index of their own: digest trees, dyadic windows, pigeonholes of bit codes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pricelode.operators import dyadic, hamming, merkle
from pricelode.plans.base import query, table
from pricelode.sources.observations import observations


@query("""with a as (select chain, offer, max(cents) as cents, max(brand) as brand from obs where day <= date '2024-01-10' group by all), b as (select chain, offer, max(cents) as cents, max(brand) as brand from obs where day between date '2024-01-11' and date '2024-01-20' group by all)
select coalesce(a.chain, b.chain) as chain, coalesce(a.offer, b.offer) as offer, case when a.chain is null then 'added' when b.chain is null then 'removed' else 'changed' end as kind from a full join b on a.chain = b.chain and a.offer = b.offer
where a.chain is null or b.chain is null or a.cents is distinct from b.cents or a.brand is distinct from b.brand""")
def differing_offers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What differs between the offers of the first ten days and of the ten after, found by trees of digests."""
    obs = observations(spark, sf_dir).select("chain", "offer", "cents", "brand", "day")
    state = lambda a, b: obs.filter(F.col("day").between(F.lit(a).cast("date"), F.lit(b).cast("date"))).groupBy("chain", "offer").agg(F.max("cents").alias("cents"), F.max("brand").alias("brand"))
    return merkle.differences(state("2024-01-01", "2024-01-10"), state("2024-01-11", "2024-01-20"), ["chain", "offer"], ["cents", "brand"])


OPEN_SQL = "w as materialized (select id, valid_from, case when id % 17 <> 0 then valid_until end as valid_until from obs where valid_from is not null)"


def open_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, first, last: windows as day numbers; some never end."""
    obs = observations(spark, sf_dir).filter("valid_from is not null")
    return obs.select("id", dyadic.day_number(F.col("valid_from")).alias("first"), F.when(F.col("id") % 17 != 0, dyadic.day_number(F.col("valid_until"))).alias("last"))


@query(f"""with {OPEN_SQL}, d as (select distinct day from obs) select day, count(w.id) as n_open from d left join w on day >= valid_from and day <= coalesce(valid_until, date '2140-01-01') group by day""")
def window_day_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many windows are open on each day, open ends included."""
    days = observations(spark, sf_dir).select("day").distinct()
    return dyadic.open_counts(open_windows(spark, sf_dir), days, F.col("first"), F.col("last"), dyadic.day_number(F.col("day")))


@query(f"""with {OPEN_SQL}, c as materialized (select valid_from, valid_until, min(id) as id, count(*) as n from w group by all)
select a.id as left_id, b.id as right_id, a.n * b.n as n_pairs from c a join c b on (a.valid_from < b.valid_from or (a.valid_from = b.valid_from and a.id < b.id)) and coalesce(a.valid_until, date '2140-01-01') >= b.valid_from and coalesce(b.valid_until, date '2140-01-01') >= b.valid_from""")
def endless_window_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of classes of equal windows with a day in common, and how many pairs of observations they stand for."""
    classes = open_windows(spark, sf_dir).groupBy("first", "last").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("n"))
    pairs = dyadic.overlapping(classes, "id", F.col("first"), F.col("last"))
    n = lambda p: classes.select(F.col("id").alias(p), F.col("n").alias(f"{p}_n"))
    return pairs.join(n("left"), "left").join(n("right"), "right").select(F.col("left").alias("left_id"), F.col("right").alias("right_id"), (F.col("left_n") * F.col("right_n")).alias("n_pairs"))


@query("""with c as materialized (select vec_id, list_sum(list_transform(range(1, 33), lambda i: case when embedding[i] > 0 then (1::bigint << (i - 1)::int) else 0::bigint end))::bigint as code, embedding as v, dense_rank() over (order by embedding) as n from embeddings),
k as materialized (select n, any_value(code) as code, min(vec_id) as id from c group by n),
p as (select case when b.id is null or a.id <= b.id then a.id else b.id end as l, case when b.id is null or a.id <= b.id then b.id else a.id end as r, a.n as ln, b.n as rn, bit_count(xor(a.code, b.code))::int as distance from k a join k b on a.n < b.n where bit_count(xor(a.code, b.code)) <= 6
union all select distinct k.id, c.vec_id, c.n, c.n, 0 from c join k on c.n = k.n where c.vec_id is distinct from k.id),
v as materialized (select distinct on (n) n, v from c),
d as (select l, r, distance, list_sort(list_transform(list_zip(x.v, y.v), lambda z: abs(z[1]::double - z[2]::double))) as d from p join v x on x.n = p.ln join v y on y.n = p.rn)
select l as left_id, r as right_id, distance, round(list_sum(d) / len(d), 6) as mae, round(sqrt(list_sum(list_transform(d, lambda x: x * x)) / len(d)), 6) as rms, round(d[ceil(len(d) * 0.99 - 1e-9)::int], 6) as p99, round(d[len(d)], 6) as most from d""")
def perceptual_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of different vectors whose sign codes differ in six of 32 bits at most, equal codes included, and copies with the
    least id of their vector: how far apart they are."""
    pairs = hamming.near_vectors(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", 32, 6)
    out = hamming.measured(pairs, ["left", "right", "distance"])
    return out.select(F.col("left").alias("left_id"), F.col("right").alias("right_id"), "distance", *(F.round(c, 6).alias(c) for c in ("mae", "rms", "p99", "most")))
