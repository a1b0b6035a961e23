"""State machines and carried state: each as a batch fold and as a stream with keyed state, which agree."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pricelode.operators import machine
from pricelode.plans.base import query
from pricelode.shared import written
from pricelode.sources.observations import observations
from pricelode.streaming import stateful

ACTIONS = ["draft", "approve", "reject", "reopen", "needs_followup", "seed", "archive"]
CAP = 3

REVIEW_SQL = f"""with recursive n as materialized (select *, row_number() over (partition by item order by seq) as place from
  (select 'offer-' || offer as item, strftime(collected_at, '%Y%m%d%H%M%S%f') || lpad(id::varchar, 12, '0') as seq, {ACTIONS}[abs(cents) % 7 + 1] as action from obs)),
r as (select item, place, seq, action, 'none' as from_state, case when action = 'seed' then 'pending' else 'none' end as to_state, case when action = 'seed' then 'applied' else 'forbidden' end as verdict, (action = 'seed')::bigint as revision from n where place = 1
union all select n.item, n.place, n.seq, n.action, r.to_state,
  case when r.to_state = 'none' then case when n.action = 'seed' then 'pending' else 'none' end
    when r.to_state in ('pending', 'draft', 'needs_followup') then case n.action when 'draft' then 'draft' when 'needs_followup' then 'needs_followup' when 'approve' then 'approved' when 'reject' then 'rejected' when 'reopen' then 'pending' else r.to_state end
    when r.to_state = 'rejected' and n.action = 'reopen' then 'pending' else r.to_state end, v.verdict, r.revision + (v.verdict = 'applied')::bigint
from r join n on n.item = r.item and n.place = r.place + 1, lateral (select case when n.action = 'archive' then 'forbidden' when r.to_state = 'none' then case when n.action = 'seed' then 'applied' else 'forbidden' end when n.action = 'seed' then 'no_op'
    when r.to_state in ('pending', 'draft', 'needs_followup') then case when r.to_state = 'pending' and n.action = 'reopen' then 'no_op' else 'applied' end
    when r.to_state = 'approved' then case when n.action = 'approve' then 'no_op' else 'forbidden' end
    else case n.action when 'reject' then 'no_op' when 'reopen' then 'applied' else 'forbidden' end end as verdict) v)
select item, seq, action, from_state, to_state, verdict, revision from r"""


def review_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """item, seq, action, day: an action for each observation of an offer."""
    seq = F.concat(F.date_format("collected_at", "yyyyMMddHHmmssSSSSSS"), F.lpad(F.col("id").cast("string"), 12, "0"))
    action = F.element_at(F.array(*map(F.lit, ACTIONS)), (F.abs("cents") % 7 + 1).cast("int"))
    return observations(spark, sf_dir).select(F.concat(F.lit("offer-"), "offer").alias("item"), seq.alias("seq"), action.alias("action"), "day")


@query(REVIEW_SQL)
def review_machine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict and revision of every action on a review item, folded from the log in pieces."""
    events = review_events(spark, sf_dir).drop("day")
    return machine.folded(events, machine.REVIEW, "item", [F.col("seq")], F.col("action"))


@query(REVIEW_SQL)
def review_machine_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same from a stream that is stopped after half of the days and started again."""
    events = review_events(spark, sf_dir)
    cut = F.lit("2024-01-15").cast("date")
    return stateful.reviewed(events.filter(F.col("day") < cut).drop("day"), events.filter(F.col("day") >= cut).drop("day"))


CARRIED_SQL = f"""with recursive d as materialized (select chain || '/' || coalesce(store, '-') as scope, day::varchar as seq, ((day - date '1970-01-01') + 3) // 7 as week, (max(cents) % 3)::varchar as identity, count(*) % 3 <> 0 as scheduled from obs group by chain, store, day),
f as (select *, scheduled and row_number() over (partition by scope, week, scheduled order by seq) = 1 as taken, min(case when scheduled then seq end) over (partition by scope, week) as first_seq from d),
k as materialized (select *, row_number() over (partition by scope order by seq) as place, week - row_number() over (partition by scope order by seq) as grp from f where taken),
h as (select scope, place, seq, week, identity, grp, sha256('|' || week || '|' || identity) as digest from k where place = 1
union all select k.scope, k.place, k.seq, k.week, k.identity, k.grp, sha256(h.digest || '|' || k.week || '|' || k.identity) from h join k on k.scope = h.scope and k.place = h.place + 1),
w as (select *, row_number() over (partition by scope, grp order by seq) as run from h)
select f.scope, f.seq, f.week, case when not f.scheduled then 'not_scheduled' when f.taken then 'recorded' when f.identity = o.identity then 'duplicate' else 'conflict' end as verdict, least(coalesce(w.run, 0), {CAP})::bigint as run, coalesce(w.digest, '') as digest
from f left join f o on o.scope = f.scope and o.week = f.week and o.taken asof left join w on w.scope = f.scope and w.seq <= f.seq"""


def scheduled_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """scope, seq, week, identity, scheduled: what a scope's source showed on each day."""
    scope = F.concat_ws("/", "chain", F.coalesce("store", F.lit("-")))
    days = observations(spark, sf_dir).groupBy(scope.alias("scope"), "day").agg(F.max("cents").alias("most"), F.count(F.lit(1)).alias("n"))
    return days.select("scope", F.col("day").cast("string").alias("seq"), F.floor((F.unix_date("day") + 3) / 7).alias("week"), (F.col("most") % 3).cast("string").alias("identity"), (F.col("n") % 3 != 0).alias("scheduled"))


@query(CARRIED_SQL)
def carried_weeks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records that a scope carries from week to week: one a week, on schedule only; another identity in the same week is an error."""
    days = scheduled_days(spark, sf_dir)
    week = Window.partitionBy("scope", "week")
    first = F.min(F.when(F.col("scheduled"), F.struct("seq", "identity"))).over(week)
    rows = days.withColumn("first", first).withColumn("taken", F.coalesce(F.col("scheduled") & (F.col("first.seq") == F.col("seq")), F.lit(False)))
    # a scope has a record a week: its list is as long as the calendar
    taken = rows.filter("taken").groupBy("scope").agg(F.sort_array(F.collect_list(F.struct("seq", "week", "identity"))).alias("records"))
    zero = F.struct(F.lit("").alias("digest"), F.lit(None).cast("long").alias("week"), F.lit(0).cast("long").alias("run"), F.array().cast("array<struct<seq:string,run:bigint,digest:string>>").alias("all"))

    def add(acc, r):  # noqa: ANN001, ANN202
        digest = F.sha2(F.concat_ws("|", acc["digest"], r["week"].cast("string"), r["identity"]), 256)
        run = F.when(acc["week"] == r["week"] - 1, acc["run"] + 1).otherwise(F.lit(1).cast("long"))
        return F.struct(digest.alias("digest"), r["week"].alias("week"), run.alias("run"), F.concat(acc["all"], F.array(F.struct(r["seq"].alias("seq"), run.alias("run"), digest.alias("digest")))).alias("all"))

    chained = taken.select(F.col("scope").alias("of"), F.explode(F.aggregate("records", zero, add)["all"]).alias("r")).select("of", F.col("r.seq").alias("of_seq"), "r.run", "r.digest")
    joined = rows.join(chained, (F.col("scope") == F.col("of")) & (F.col("seq") == F.col("of_seq")), "left")
    so_far = Window.partitionBy("scope").orderBy("seq")
    run, digest = F.last("run", ignorenulls=True).over(so_far), F.last("digest", ignorenulls=True).over(so_far)
    verdict = F.when(~F.col("scheduled"), "not_scheduled").when(F.col("taken"), "recorded").when(F.col("identity") == F.col("first.identity"), "duplicate").otherwise("conflict")
    return joined.select("scope", "seq", "week", verdict.alias("verdict"), F.least(F.coalesce(run, F.lit(0)), F.lit(CAP)).cast("long").alias("run"), F.coalesce(digest, F.lit("")).alias("digest"))


@query(CARRIED_SQL)
def carried_weeks_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same from a stream whose state holds the last records and the digest, started three times."""
    days = written(scheduled_days(spark, sf_dir), "days")
    cuts = ["", "2024-01-10", "2024-01-20", "9"]
    slices = [days.filter((F.col("seq") >= a) & (F.col("seq") < b)) for a, b in zip(cuts, cuts[1:], strict=False)]
    return stateful.in_runs(slices, "scope", stateful.CarriedProcessor(CAP), stateful.CARRIED)
