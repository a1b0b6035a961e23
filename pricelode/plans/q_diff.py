"""Queries that compare two weeks, two sources, two sets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pricelode.operators import diff
from pricelode.plans.base import query, table
from pricelode.sources.observations import observations

WEEKS_SQL = """a as (select offer, max(cents)::bigint as cents from obs where day between date '2024-01-08' and date '2024-01-09' group by offer),
b as (select offer, max(cents)::bigint as cents from obs where day between date '2024-01-15' and date '2024-01-16' group by offer)"""


def weeks(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    obs = observations(spark, sf_dir)
    span = lambda x, y: obs.filter(F.col("day").between(F.lit(x).cast("date"), F.lit(y).cast("date"))).groupBy("offer").agg(F.max("cents").alias("cents"))
    return span("2024-01-08", "2024-01-09"), span("2024-01-15", "2024-01-16")


@query(f"with {WEEKS_SQL} select coalesce(a.offer, b.offer) as offer, case when a.offer is null then 'added' when b.offer is null then 'removed' when a.cents = b.cents then 'kept' else 'changed' end as kind from a full join b on a.offer = b.offer")
def week_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diff.keyed(*weeks(spark, sf_dir), ["offer"], "cents")


@query(f"""with {WEEKS_SQL}, k as (select count(*) filter (a.offer is not null and b.offer is not null) as retained, count(*) filter (a.offer is null) as added, count(*) filter (b.offer is null) as removed from a full join b on a.offer = b.offer)
select *, case when retained + removed > 0 then round_even(retained * 100.0 / (retained + removed), 2)::double end as retention_percent from k""")
def week_retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diff.retention(diff.keyed(*weeks(spark, sf_dir), ["offer"], "cents"))


@query("""select count(*) filter (d.doc_id is not null) as source, count(*) filter (l.quality = 1) as parsed, count(*) filter (l.quality = 0) as excluded, count(*) filter (l.doc_id is null) as unexplained, count(*) filter (d.doc_id is null) as stray
from documents d full join labels l on d.doc_id = l.doc_id""")
def accounting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """source = parsed + excluded + unexplained; nothing parsed that the source has not."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("d"))
    labels = table(spark, sf_dir, "labels")
    both = d.join(labels, F.col("d") == F.col("doc_id"), "full")
    is_ = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    return both.agg(is_(F.col("d").isNotNull()).alias("source"), is_(F.col("quality") == 1).alias("parsed"), is_(F.col("quality") == 0).alias("excluded"), is_(F.col("doc_id").isNull()).alias("unexplained"), is_(F.col("d").isNull()).alias("stray"))


@query("""select chain, sum(('0x' || substr(sha256(concat_ws('|', offer, cents, valid_from)), 1, 15))::bigint::hugeint)::varchar as digest, count(*) as n from obs group by chain""")
def table_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order-independent fingerprint of each chain's rows without the volatile columns."""
    columns = [F.col("offer").cast("string"), F.col("cents").cast("string"), F.col("valid_from").cast("string")]
    return observations(spark, sf_dir).groupBy("chain").agg(diff.multiset_digest(columns).cast("string").alias("digest"), F.count(F.lit(1)).alias("n"))


@query("""with a as (select id // 2 as place, cents as c from obs where id % 2 = 0), b as (select id // 2 as place, cents as c from obs where id % 2 = 1),
same as (select a.c, a.place as old_place, b.place as new_place from a join b on a.c = b.c and a.place = b.place),
ra as (select *, row_number() over (partition by c order by place) as rn from a where (c, place) not in (select (c, old_place) from same)), rb as (select *, row_number() over (partition by c order by place) as rn from b where (c, place) not in (select (c, new_place) from same))
select c, old_place, new_place, 'same' as kind from same union all
select coalesce(ra.c, rb.c), ra.place, rb.place, case when rb.c is null then 'old_only' when ra.c is null then 'new_only' else 'moved' end from ra full join rb on ra.c = rb.c and ra.rn = rb.rn""")
def content_rollover(spark: SparkSession, sf_dir: str) -> DataFrame:
    obs = observations(spark, sf_dir)
    place = F.expr("id div 2").alias("place")  # two sides of one size: even ids are the old places, odd ids the new ones
    a, b = (obs.filter(F.col("id") % 2 == k).select(place, F.col("cents").alias("content")) for k in (0, 1))
    return diff.rollover(a, b, "place", "content")


@query("""with u as (select chain, offer, day, id, cents, coalesce(store, '-') as s from obs), n as (select chain, offer, day, count(*) as n, count(distinct s) as stores, count(distinct cents) as prices, max({'c': cents, 'i': id}) as top, list_sort(list(id)) as ids from u group by all)
select chain, offer, day, n, case when prices > 1 then 'unresolved' else 'agreed' end as verdict, top.i as representative, array_to_string(ids, ',') as occurrences from n where n > 1""")
def logical_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeats of an offer on a day: one representative, all occurrences kept, conflicting prices left unresolved."""
    g = observations(spark, sf_dir).groupBy("chain", "offer", "day")
    out = g.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("cents").alias("p"), F.max(F.struct("cents", "id"))["id"].alias("representative"), F.array_join(F.array_sort(F.collect_list("id")), ",").alias("occurrences"))
    return out.filter("n > 1").select("chain", "offer", "day", "n", F.when(F.col("p") > 1, "unresolved").otherwise("agreed").alias("verdict"), "representative", "occurrences")


@query("""select coalesce(o.k, l.k) as k, case when o.k is null then 'line_only' when l.k is null then 'order_only' when o.n = l.n then 'equal' else 'different' end as parity from
 (select o_orderkey as k, o_orderkey % 7 as n from orders where o_orderkey % 3 > 0) o full join (select l_orderkey as k, count(*) as n from lineitem group by 1) l on o.k = l.k""")
def bidirectional_parity(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").filter("o_orderkey % 3 > 0").select(F.col("o_orderkey").alias("k"), (F.col("o_orderkey") % 7).alias("a"))
    n = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(F.count(F.lit(1)).alias("b"))
    parity = F.when(F.col("a").isNull(), "line_only").when(F.col("b").isNull(), "order_only").when(F.col("a") == F.col("b"), "equal").otherwise("different")
    return o.join(n, "k", "full").select("k", parity.alias("parity"))


@query("""with w as (select id, valid_from as f, valid_until as u from obs where valid_from is not null and chain = 'view'), act as (select max({'f': f, 'u': u}) as m from w where date '2024-01-20' between f and u),
nxt as (select min(f) as f from w where f > date '2024-01-20') select id, case when f = act.m.f and u = act.m.u then 'active' when w.f = nxt.f then 'next' end as role from w, act, nxt where (f = act.m.f and u = act.m.u) or w.f = nxt.f""".replace("select id, case when f = act", "select id, case when w.f = act").replace("where (f = act", "where (w.f = act"))
def flyer_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the active window (the latest that is open) and of the nearest that follows."""
    day = F.lit("2024-01-20").cast("date")
    w = observations(spark, sf_dir).filter("valid_from is not null and chain = 'view'").select("id", F.col("valid_from").alias("f"), F.col("valid_until").alias("u"))
    is_open = day.between(F.col("f"), F.col("u"))
    active = w.agg(F.max(F.when(is_open, F.struct("f", "u")))).scalar()
    following = w.agg(F.min(F.when(F.col("f") > day, F.col("f")))).scalar()
    rows = w.select("id", F.when(F.struct("f", "u") == active, "active").when(F.col("f") == following, "next").alias("role"))
    return rows.filter("role is not null")
