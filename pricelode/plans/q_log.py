"""Queries on the append-only log and state folded from it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pricelode.operators import importlog, log
from pricelode.plans.base import query, table
from pricelode.shared import shared_path
from pricelode.sources.observations import observations
from pricelode.streaming import replay


@query("""with old as (select distinct chain, offer from obs where day < date '2024-01-10'), new as (select chain, offer from obs where day >= date '2024-01-10')
select distinct chain, offer from new where (chain, offer) not in (select (chain, offer) from old)""")
def insert_ignore(spark: SparkSession, sf_dir: str) -> DataFrame:
    obs = observations(spark, sf_dir).select("chain", "offer", "day")
    cut = F.lit("2024-01-10").cast("date")
    return log.new_rows(obs.filter(F.col("day") >= cut), obs.filter(F.col("day") < cut), ["chain", "offer"]).select("chain", "offer")


@query("""with a as (select id, cents, chain from obs where day < date '2024-01-20'), b as (select id, case when id % 100 = 0 then cents + 1 else cents end as cents, chain from obs where day >= date '2024-01-10')
select count(*) filter (b.id is null) as new, count(*) filter (a.cents = b.cents) as same, count(*) filter (a.cents <> b.cents) as conflicting, count(*) filter (a.id is null) as missing from a full join b on a.id = b.id""")
def exact_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    obs = observations(spark, sf_dir).select("id", "cents", "chain", "day")
    changed = F.when(F.col("id") % 100 == 0, F.col("cents") + 1).otherwise(F.col("cents"))
    return log.exact_set(obs.filter("day < date '2024-01-20'"), obs.filter("day >= date '2024-01-10'").withColumn("cents", changed), ["id"], ["cents", "chain"])


@query("""with a as (select id, cents, coalesce(brand, '-') as brand from obs where day < date '2024-01-20'), b as (select id, case when id % 100 = 0 then cents + 1 else cents end as cents, case when id % 50 = 0 then 'other' else coalesce(brand, '-') end as brand from obs where day >= date '2024-01-10')
select a.id, case when b.id is null then 'CREATE' when a.cents = b.cents and a.brand = b.brand then 'NO_OP_IDENTICAL' else 'CONFLICT' end as action,
  case when b.id is null then '' else concat_ws(',', case when a.brand <> b.brand then 'brand' end, case when a.cents <> b.cents then 'cents' end) end as differ from a left join b on a.id = b.id""")
def action_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    obs = observations(spark, sf_dir).select("id", "cents", F.coalesce("brand", F.lit("-")).alias("brand"), "day")
    there = obs.filter("day >= date '2024-01-10'").select("id", F.when(F.col("id") % 100 == 0, F.col("cents") + 1).otherwise(F.col("cents")).alias("cents"), F.when(F.col("id") % 50 == 0, "other").otherwise(F.col("brand")).alias("brand"))
    return log.plan(obs.filter("day < date '2024-01-20'").drop("day"), there, ["id"], ["cents", "brand"])


@query("""select conv_id, arg_max(role, turn) as status, count(*) as revisions, max(turn) as last_revision from conversations group by conv_id""")
def review_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Status of each item folded from its append-only revisions."""
    return log.folded(table(spark, sf_dir, "conversations"), "conv_id", "turn", "role")


@query("""select conv_id, string_agg(turn || ':' || role, ' ' order by turn, role) as revisions, max(turn) + 1 as next_revision from conversations group by conv_id""")
def review_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = F.array_sort(F.collect_list(F.struct("turn", "role")))
    joined = F.array_join(F.transform(parts, lambda p: F.concat_ws(":", p["turn"].cast("string"), p["role"])), " ")
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(joined.alias("revisions"), (F.max("turn") + 1).alias("next_revision"))


@query("""select o_orderstatus as status, count(*) as n, count(*) filter (o_orderpriority < '3') as urgent from orders group by 1""")
def review_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").groupBy(F.col("o_orderstatus").alias("status")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("o_orderpriority") < "3").alias("urgent"))


@query("select l_orderkey, l_partkey, count(*) as n from lineitem group by all having count(*) > 1")
def duplicate_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_partkey").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


@query("""with c as (select chain, day, max(cents)::bigint as f from obs group by all) select chain, day, f as fingerprint, coalesce(f = lag(f) over (partition by chain order by day), false) as no_op from c""")
def change_detection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A day with the fingerprint of the day before is no new cycle."""
    days = observations(spark, sf_dir).groupBy("chain", "day").agg(F.max("cents").alias("fingerprint"))
    return days.withColumn("no_op", F.coalesce(F.col("fingerprint") == F.lag("fingerprint").over(Window.partitionBy("chain").orderBy("day")), F.lit(False)))


@query("""select chain, offer, count(*) as n, max(collected_at) as latest, min(cents) as least from obs group by chain, offer""")
def streamed_offers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same aggregate from a stream over the table's files, run until all is read."""
    return replay.offers_by_stream(spark, sf_dir)


def snapshots(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The observations before and from 15 January as two batches with string keys."""
    obs = observations(spark, sf_dir).select(F.col("id").cast("string").alias("source_id"), "chain", "offer", "cents", F.when(F.col("day") < F.lit("2024-01-15").cast("date"), "early").otherwise("late").alias("snapshot"))
    return obs.filter("snapshot = 'early'"), obs.filter("snapshot = 'late'")


@query("""with s as (select case when day < date '2024-01-15' then 'early' else 'late' end as snapshot from obs), c as (select count(*) filter (snapshot = 'early') as e, count(*) filter (snapshot = 'late') as l from s)
select * from (select 1 as step, 'early' as snapshot, 'committed' as state, e as written, e as visible from c union all select 2, 'early', 'replayed', 0, e from c union all select 3, 'late', 'rejected', 0, e from c
union all select 4, 'late', 'committed', l, e + l from c union all select 5, 'early', 'rejected', 0, e + l from c union all select 6, 'late', 'rejected', 0, e + l from c)""")
def atomic_import(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Imports through the log: the first of each snapshot is written as a whole, a replay writes nothing, and a batch of
    two snapshots, one with changed prices, or one that lacks rows leaves nothing to see."""
    path = shared_path(spark, "imports")
    early, late = snapshots(spark, sf_dir)
    steps = [
        (early, "early"), (early.repartition("chain"), "early"), (late.withColumn("snapshot", F.when(F.col("cents") % 2 == 0, "late").otherwise("other")), "late"),
        (late, "late"), (early.withColumn("cents", F.col("cents") + 1), "early"), (late.filter("cents % 2 = 0"), "late"),
    ]
    out = []
    for number, (batch, snapshot) in enumerate(steps, 1):
        try:
            receipt = importlog.import_snapshot(batch, path, snapshot, "source_id", ["chain", "offer", "cents"])
            state, count = receipt.state, receipt.written
        except importlog.ImportRejected:
            state, count = "rejected", 0
        out.append((number, snapshot, state, count, importlog.committed(spark, path, batch.schema).count()))
    return spark.createDataFrame(out, "step int, snapshot string, state string, written long, visible long")


@query("""select id::varchar as source_id, chain, offer, cents, case when day < date '2024-01-15' then 'early' else 'late' end as snapshot from obs""")
def imported_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows that readers of the log see after both snapshots were imported and one replayed."""
    path = shared_path(spark, "imports")
    early, late = snapshots(spark, sf_dir)
    for batch, name in ((late, "late"), (early, "early"), (late, "late")):
        importlog.import_snapshot(batch, path, name, "source_id", ["chain", "offer", "cents"])
    return importlog.committed(spark, path, early.schema)


@query("""with c as (select count(*) as n, count(*) filter (day < date '2024-01-15') as e from obs)
select * from (select 1 as step, 'written' as action, e as rows, 1 as version from c union all select 2, 'reused', e, 1 from c union all select 3, 'written', e, 2 from c union all select 4, 'written', n, 3 from c union all select 5, 'reused', n, 3 from c)""")
def content_imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A source's content is written under its fingerprint, and used again while fingerprint, count and window stay."""
    path = shared_path(spark, "content")
    obs = observations(spark, sf_dir).select(F.col("id").cast("string").alias("source_id"), "chain", "cents", "day")
    early = obs.filter("day < date '2024-01-15'")
    out = []
    for number, (batch, window) in enumerate([(early, "w1"), (early.repartition("chain"), "w1"), (early, "w2"), (obs, "w2"), (obs.orderBy("cents"), "w2")], 1):
        receipt = importlog.import_content(batch, path, "observations", window, "source_id", ["chain", "cents"])
        out.append((number, "reused" if receipt.state == "reused" else "written", receipt.rows, receipt.version))
    return spark.createDataFrame(out, "step int, action string, rows long, version int")
