"""Queries on states, winners, calendars, streaks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pricelode.operators import temporal as t
from pricelode.plans.base import query, table
from pricelode.sources.observations import AS_OF, observations

BASE = "(valid_from is not null and valid_until is not null)"
APP = "(app_cents is not null and app_from is not null and app_until is not null)"
STATE_SQL = f"""case
  when ({BASE} and date '{AS_OF}' between valid_from and valid_until) or ({APP} and date '{AS_OF}' between app_from and app_until) then 'current'
  when ({BASE} and valid_from > date '{AS_OF}') or ({APP} and app_from > date '{AS_OF}') then 'upcoming'
  when ({BASE} or {APP}) and (not {BASE} or valid_until < date '{AS_OF}') and (not {APP} or app_until < date '{AS_OF}') then 'expired'
  else 'unknown' end"""
WINNERS_SQL = f"""winners as materialized (select * from (select *, {STATE_SQL} as state from obs)
  qualify row_number() over (partition by state, chain, store, offer order by collected_at desc, id desc) = 1)"""


def as_of() -> Column:
    return F.lit(AS_OF).cast("date")


def winners(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t.winners(observations(spark, sf_dir), as_of())


@query(f"select state, count(*) as n, count(distinct offer) as offers from (select *, {STATE_SQL} as state from obs) group by state")
def observation_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    rated = observations(spark, sf_dir).withColumn("state", t.state(as_of()))
    return rated.groupBy("state").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("offer").alias("offers"))


@query(f"with {WINNERS_SQL} select id, state, chain, store, offer, collected_at from winners")
def state_winners(spark: SparkSession, sf_dir: str) -> DataFrame:
    return winners(spark, sf_dir).select("id", "state", "chain", "store", "offer", "collected_at")


@query(f"""select id, coalesce({BASE} and date '{AS_OF}' between valid_from and valid_until, false) as base_price_current,
  coalesce({APP} and date '{AS_OF}' between app_from and app_until, false) as app_price_current from obs""")
def price_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    no = F.lit(False)
    return observations(spark, sf_dir).select("id", F.coalesce(t.base_current(as_of()), no).alias("base_price_current"), F.coalesce(t.app_current(as_of()), no).alias("app_price_current"))


@query("""select id, chain, offer, d::date as on_day from obs, unnest(generate_series(greatest(valid_from, date '2024-01-15'),
  least(valid_until, date '2024-01-21'), interval 1 day)) as s(d) where valid_from <= date '2024-01-21' and valid_until >= date '2024-01-15'""")
def week_calendar(spark: SparkSession, sf_dir: str) -> DataFrame:
    first, last = (F.lit(x).cast("date") for x in ("2024-01-15", "2024-01-21"))
    return t.expand_days(observations(spark, sf_dir), "valid_from", "valid_until", first, last).select("id", "chain", "offer", "on_day")


@query("""with w as (select id, chain, unnest([{'kind': 'base', 'f': valid_from, 'u': valid_until}, {'kind': 'app', 'f': app_from, 'u': app_until}]) as x from obs where chain <> 'signup')
select id, chain, x.kind as kind, x.f as first_day, x.u as last_day, (x.u - x.f + 1)::int as days from w where x.f is not null and x.u >= x.f and x.u - x.f + 1 <= 3""")
def short_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    window = lambda kind, a, b: F.struct(F.lit(kind).alias("kind"), F.col(a).alias("first_day"), F.col(b).alias("last_day"))
    rows = observations(spark, sf_dir).filter("chain <> 'signup'").select("id", "chain", F.explode(F.array(window("base", "valid_from", "valid_until"), window("app", "app_from", "app_until"))).alias("w"))
    days = F.datediff("last_day", "first_day") + 1
    return rows.select("id", "chain", "w.*").withColumn("days", days).filter("first_day is not null and last_day >= first_day and days <= 3")


@query("""with snaps as (select id, chain, collected_at, valid_from, valid_until from obs where valid_from is not null),
days as (select distinct day as d from obs)
select d, chain, id as snapshot from (select d, chain, id, row_number() over (partition by d, chain order by collected_at desc, id desc) as rn
  from days join snaps on d between valid_from and valid_until) where rn = 1""")
def snapshot_of_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    obs = observations(spark, sf_dir)
    snaps = obs.filter("valid_from is not null").select("id", "chain", "collected_at", "valid_from", "valid_until")
    open_days = snaps.withColumn("d", F.explode(F.sequence("valid_from", "valid_until")))
    found = open_days.join(obs.select(F.col("day").alias("d")).distinct(), "d")
    return t.newest(found, ["d", "chain"], F.desc("collected_at"), F.desc("id")).select("d", "chain", F.col("id").alias("snapshot"))


@query("""with s as (select valid_from as f, valid_until as u, min(id) as id, count(*) as n from obs where valid_from is not null group by all)
select a.id as a, b.id as b, greatest(a.f, b.f) as first_day, least(a.u, b.u) as last_day, case when a.id = b.id then a.n * (a.n - 1) // 2 else a.n * b.n end::bigint as pairs
from s a join s b on a.id <= b.id and a.f <= b.u and a.u >= b.f where a.id < b.id or a.n > 1""")
def window_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlapping windows of all observations.  Equal windows are one class, named by its least id; ``pairs`` is the
    number of pairs of observations that a row stands for."""
    obs = observations(spark, sf_dir).filter("valid_from is not null")
    s = obs.groupBy(F.col("valid_from").alias("f"), F.col("valid_until").alias("u")).agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("n"))
    a, b = (t.interval_buckets(s, "f", "u").select("_bucket", F.col("id").alias(k), *(F.col(c).alias(c + k) for c in "fun")) for k in "ab")
    # a pair that shares several buckets is taken in the one where the overlap begins
    first = F.greatest("fa", "fb")
    met = a.join(b, "_bucket").filter("a <= b and fa <= ub and ua >= fb").filter(F.floor(F.unix_date(first) / 8) == F.col("_bucket")).filter("a < b or na > 1")
    pairs = F.when(F.col("a") == F.col("b"), F.expr("na * (na - 1) div 2")).otherwise(F.col("na") * F.col("nb"))
    return met.select("a", "b", first.alias("first_day"), F.least("ua", "ub").alias("last_day"), pairs.alias("pairs"))


@query("""with snaps as (select chain, valid_from as f, valid_until as u, max({'c': collected_at, 'i': id}) as s from obs where valid_from is not null group by all), days as (select distinct day as d from obs)
select d, chain, max(s).i as snapshot from days join snaps on d between f and u group by d, chain""")
def newest_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``snapshot_of_day`` with every observation as a snapshot: the newest of each window first, then of each day."""
    obs = observations(spark, sf_dir)
    newest = F.max(F.struct("collected_at", "id")).alias("s")
    snaps = obs.filter("valid_from is not null").groupBy("chain", "valid_from", "valid_until").agg(newest)
    open_days = snaps.select("chain", "s", F.explode(F.sequence("valid_from", "valid_until")).alias("d"))
    found = open_days.join(obs.select(F.col("day").alias("d")).distinct(), "d")
    return found.groupBy("d", "chain").agg(F.max("s")["id"].alias("snapshot"))


@query("""with s as (select id, valid_from as f, valid_until as u from obs where valid_from is not null), w as (select f, u, count(*) as n from s group by all),
p as (select a.f, a.u, b.n - (a.f = b.f and a.u = b.u)::int as n, greatest(a.f, b.f) as x, least(a.u, b.u) as y from w a join w b on a.f <= b.u and a.u >= b.f),
g as (select f, u, sum(n)::bigint as n_overlaps, min(x) as first_day, max(y) as last_day from p where n > 0 group by all)
select id, n_overlaps, first_day, last_day from s join g using (f, u)""")
def window_overlap_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many windows of other observations each one overlaps, over all of them, and the first and last day shared;
    equal windows are counted before the join."""
    s = observations(spark, sf_dir).filter("valid_from is not null").select("id", F.col("valid_from").alias("f"), F.col("valid_until").alias("u"))
    windows = t.interval_buckets(s.groupBy("f", "u").agg(F.count(F.lit(1)).alias("n")), "f", "u")
    a, b = (windows.select("_bucket", *(F.col(c).alias(f"{c}{n}") for c in ("f", "u", "n"))) for n in ("a", "b"))
    first, itself = F.greatest("fa", "fb"), (F.col("fa") == F.col("fb")) & (F.col("ua") == F.col("ub"))
    pairs = a.join(b, "_bucket").filter("fa <= ub and ua >= fb").filter(F.floor(F.unix_date(first) / 8) == F.col("_bucket"))
    others = pairs.withColumns({"n": F.col("nb") - itself.cast("int"), "x": first, "y": F.least("ua", "ub")}).filter("n > 0")
    found = others.groupBy(F.col("fa").alias("f"), F.col("ua").alias("u")).agg(F.sum("n").alias("n_overlaps"), F.min("x").alias("first_day"), F.max("y").alias("last_day"))
    return s.join(found, ["f", "u"]).select("id", "n_overlaps", "first_day", "last_day")


@query("""with d as (select distinct offer, day from obs), r as (select offer, day, day - (row_number() over (partition by offer order by day))::int as run from d)
select offer, max(n)::bigint as longest from (select offer, run, count(*) as n from r group by all) group by offer""")
def longest_day_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t.islands(observations(spark, sf_dir), ["offer"], "day").groupBy("offer").agg(F.max("length").alias("longest"))


@query("""with r as (select offer, sum((cents >= 2000)::int) over (partition by offer order by collected_at desc, id desc) as breaks from obs)
select offer, count(*) filter (breaks = 0) as streak from r group by offer""")
def cheap_streak(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t.trailing_streak(observations(spark, sf_dir), ["offer"], [F.desc("collected_at"), F.desc("id")], F.col("cents") < 2000)


@query("""with s as (select * from (select *, row_number() over (partition by offer order by collected_at desc, id desc) as rn from obs) where rn <= 12)
select offer, count(*) as samples, count(*) filter (chain = 'error') as errors,
  case when count(*) < 6 then 'not enough' when count(*) filter (chain = 'error') * 4 >= count(*) then 'alert' else 'ok' end as verdict from s group by offer""")
def sample_window_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    last = t.last_n(observations(spark, sf_dir), ["offer"], 12, F.desc("collected_at"), F.desc("id"))
    errors = F.count_if(F.col("chain") == "error")
    out = last.groupBy("offer").agg(F.count(F.lit(1)).alias("samples"), errors.alias("errors"))
    return out.withColumn("verdict", F.when(F.col("samples") < 6, "not enough").when(F.col("errors") * 4 >= F.col("samples"), "alert").otherwise("ok"))


@query("""with w as (select distinct o_custkey as c, date_trunc('week', o_orderdate)::date as wk from orders),
g as (select c, wk, wk - lag(wk) over (partition by c order by wk) as gap from w)
select c, count(*) as weeks, count(*) filter (gap = 7) as in_cadence, count(*) filter (gap > 7) as gaps from g group by c""")
def weekly_cadence(spark: SparkSession, sf_dir: str) -> DataFrame:
    weeks = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c"), F.to_date(F.date_trunc("week", "o_orderdate")).alias("wk")).distinct()
    gap = F.datediff("wk", F.lag("wk").over(Window.partitionBy("c").orderBy("wk")))
    return weeks.withColumn("gap", gap).groupBy("c").agg(F.count(F.lit(1)).alias("weeks"), F.count_if(F.col("gap") == 7).alias("in_cadence"), F.count_if(F.col("gap") > 7).alias("gaps"))


@query("""with a as (select offer, max(collected_at) as attempt, max(collected_at) filter (chain <> 'error') as success from obs group by offer)
select offer, attempt, success, case when success is null then 'never' when date_diff('second', success, timestamp '2024-01-30') > 192 * 3600 then 'stale'
  when attempt > success and date_diff('second', success, attempt) > 30 * 3600 then 'failing' else 'fresh' end as health from a""")
def source_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = observations(spark, sf_dir).groupBy("offer").agg(F.max("collected_at").alias("attempt"), F.max(F.when(F.col("chain") != "error", F.col("collected_at"))).alias("success"))
    age = lambda a, b: F.timestamp_diff("SECOND", a, b)
    now = F.lit("2024-01-30 00:00:00").cast("timestamp_ntz")
    failing = (F.col("attempt") > F.col("success")) & (age(F.col("success"), F.col("attempt")) > 30 * 3600)
    health = F.when(F.col("success").isNull(), "never").when(age(F.col("success"), now) > 192 * 3600, "stale").when(failing, "failing").otherwise("fresh")
    return seen.withColumn("health", health)


@query("select chain, id as snapshot, collected_at, cents from obs qualify row_number() over (partition by chain order by collected_at desc, id desc) = 1")
def latest_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    last = F.max_by(F.struct("id", "cents"), F.struct("collected_at", "id"))
    return observations(spark, sf_dir).groupBy("chain").agg(last.alias("l"), F.max("collected_at").alias("collected_at")).select("chain", F.col("l.id").alias("snapshot"), "collected_at", F.col("l.cents").alias("cents"))


@query("""with c as (select chain, day, valid_until as u, count(*) as n from obs where valid_until - day between -2 and 8 group by all),
t as (select chain, day, sum(n) as total, max({'n': n, 'u': u}) as top from c group by all),
e as (select chain, day, top.u as week_end, top.n::bigint as support, top.n >= greatest(10, ceil(total / 10.0)) as sure from t)
select o.chain, o.day, week_end, support, sure, count(*) as rows, count(*) filter (sure and o.valid_until > week_end) as clamped,
  max(case when sure then least(o.valid_until, week_end) else o.valid_until end) as last_day
from obs o join e on o.chain = e.chain and o.day = e.day group by all""")
def page_week_end(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weighted mode of the end day with a least support, ties to the later; rows past it are clamped."""
    obs = observations(spark, sf_dir)
    near = obs.filter(F.datediff("valid_until", "day").between(-2, 8)).groupBy("chain", "day", F.col("valid_until").alias("u")).agg(F.count(F.lit(1)).alias("n"))
    ends = near.groupBy("chain", "day").agg(F.sum("n").alias("total"), F.max(F.struct("n", "u")).alias("top"))
    ends = ends.select("chain", "day", F.col("top.u").alias("week_end"), F.col("top.n").alias("support"), (F.col("top.n") >= F.greatest(F.lit(10), F.ceil(F.col("total") / 10))).alias("sure"))
    cut = F.when(F.col("sure"), F.least("valid_until", "week_end")).otherwise(F.col("valid_until"))
    joined = obs.join(ends, ["chain", "day"])
    return joined.groupBy("chain", "day", "week_end", "support", "sure").agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.col("sure") & (F.col("valid_until") > F.col("week_end"))).alias("clamped"), F.max(cut).alias("last_day"))


@query("""with w as (select *, date_trunc('week', day)::date as week from obs)
select chain, week, count(*) as n, count(distinct day) as active_days, min(valid_from) as first_valid, max(valid_until) as last_valid, max(collected_at) as latest,
  case when count(*) filter (valid_from is not null) = 0 then 'source_unavailable' when count(*) filter (cents < 5000) = 0 then 'no_offers'
    when max(valid_until) < max(day) then 'stale_data' else 'offers' end as week_state from w group by all""")
def retailer_weeks(spark: SparkSession, sf_dir: str) -> DataFrame:
    weeks = observations(spark, sf_dir).withColumn("week", F.to_date(F.date_trunc("week", "day")))
    has = F.count_if(F.col("valid_from").isNotNull())
    state = F.when(has == 0, "source_unavailable").when(F.count_if(F.col("cents") < 5000) == 0, "no_offers").when(F.max("valid_until") < F.max("day"), "stale_data").otherwise("offers")
    return weeks.groupBy("chain", "week").agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("day").alias("active_days"), F.min("valid_from").alias("first_valid"), F.max("valid_until").alias("last_valid"), F.max("collected_at").alias("latest"), state.alias("week_state")
    )
