"""Queries of quality gates, scopes, scores and metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pricelode.operators import gates
from pricelode.plans.base import query, table
from pricelode.sources.observations import observations


@query("""with r as (select id, list_sort(list_filter([case when cents < 100 then 'store_price_missing' end, case when regular_cents is not null and mode is null then 'reference_price_not_explicitly_owned' end,
  case when regular_cents < cents then 'reference_price_below_store_price' end, case when app_cents >= cents then 'app_price_not_lower_than_store_price' end,
  case when app_cents is not null and valid_from is null then 'app_price_validity_incomplete' end, case when chain = 'error' then 'not_physical_store' end, case when image = '' then 'source_page_missing' end], lambda x: x is not null)) as rs from obs)
select id, array_to_string(rs, ',') as reasons, case when len(rs) = 0 then 'ready' when list_has_any(rs, ['not_physical_store', 'store_price_missing']) then 'excluded' else 'review' end as route from r""")
def eligibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = {
        "store_price_missing": F.col("cents") < 100,
        "reference_price_not_explicitly_owned": F.col("regular_cents").isNotNull() & F.col("mode").isNull(),
        "reference_price_below_store_price": F.col("regular_cents") < F.col("cents"),
        "app_price_not_lower_than_store_price": F.col("app_cents") >= F.col("cents"),
        "app_price_validity_incomplete": F.col("app_cents").isNotNull() & F.col("valid_from").isNull(),
        "not_physical_store": F.col("chain") == "error",
        "source_page_missing": F.col("image") == "",
    }
    rows = observations(spark, sf_dir).select("id", gates.reasons(rules).alias("r"))
    return rows.select("id", F.array_join("r", ",").alias("reasons"), gates.route(F.col("r"), ["not_physical_store", "store_price_missing"]).alias("route"))


@query(r"""select p_partkey, case when regexp_matches(p_name, '(?i)\b(ring|nut)\b') then 'in_scope' when regexp_matches(p_name, '(?i)\b(gear|bolt)\b') then 'excluded' when regexp_matches(p_type, '(?i)^eco') then 'excluded'
  when regexp_matches(p_type, '(?i)^(small|promo)') then 'in_scope' when regexp_matches(p_name, '(?i)red|blue') then 'in_scope' else 'review' end as scope from part""")
def scope_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    name, kind = F.col("p_name"), F.col("p_type")
    rules = [("in_scope", name.rlike(r"(?iu)\b(ring|nut)\b")), ("excluded", name.rlike(r"(?iu)\b(gear|bolt)\b")), ("excluded", kind.rlike("(?iu)^eco")), ("in_scope", kind.rlike("(?iu)^(small|promo)")), ("in_scope", name.rlike("(?iu)red|blue"))]
    return table(spark, sf_dir, "part").select("p_partkey", gates.cascade(rules, "review").alias("scope"))


@query("""with s as (select id, chain, cents, case id % 3 when 1 then 8.0 when 2 then 6.0 else 1.0 end + case when id % 2 = 0 then 2.0 else 0 end + case when cents >= 9000 then 2.0 when cents >= 6000 then 1.0 else 0 end + case when coupon then 2.0 else 0 end
  + case when brand is not null then 1.5 else 0 end + case when requires_app then 3.0 else 0 end as score, image = '' as broken, id % 3 as tier, count(distinct cents) over (partition by day, name) as prices from (select * from obs) )
select id, score::double as score, case when broken and tier = 1 then 'math_verified_name_review' when broken and tier = 2 then 'correction_review' when broken then 'reject_noise' when tier = 1 then 'precision_ready' when tier = 2 then 'correction_review'
  when score >= 7 then 'semantic_high_precision' when score >= 4 then 'semantic_review' else 'reject_noise' end as disposition from s""")
def candidate_precision(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Additive evidence, then the disposition cascade at 7 and 4."""
    tier, broken = F.col("id") % 3, F.col("image") == ""
    points = gates.score([(8.0, tier == 1), (6.0, tier == 2), (1.0, tier == 0), (2.0, F.col("id") % 2 == 0), (2.0, F.col("cents") >= 9000), (1.0, F.col("cents").between(6000, 8999)), (2.0, F.col("coupon")), (1.5, F.col("brand").isNotNull()), (3.0, F.col("requires_app"))])
    rules = [("math_verified_name_review", broken & (tier == 1)), ("correction_review", broken & (tier == 2)), ("reject_noise", broken), ("precision_ready", tier == 1), ("correction_review", tier == 2), ("semantic_high_precision", F.col("score") >= 7), ("semantic_review", F.col("score") >= 4)]
    rows = observations(spark, sf_dir).withColumn("score", points)
    return rows.select("id", "score", gates.cascade(rules, "reject_noise").alias("disposition"))


@query("""with g as (select day, name, count(distinct cents) as prices, count(*) as n from obs group by all)
select id, prices, case when prices > 1 then 'strict_review' when cents < 100 then 'strict_review' when n >= 1 and cents >= 1000 then 'strict_ready' else 'strict_reject' end as gate from obs join g on obs.day = g.day and obs.name = g.name""")
def strict_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One label with several prices on a day is a collision and goes to review."""
    rows = observations(spark, sf_dir).withColumn("prices", F.size(F.collect_set("cents").over(Window.partitionBy("day", "name"))).cast("long"))
    rules = [("strict_review", (F.col("prices") > 1) | (F.col("cents") < 100)), ("strict_ready", F.col("cents") >= 1000)]
    return rows.select("id", "prices", gates.cascade(rules, "strict_reject").alias("gate"))


@query("""with c as (select o_orderkey as cell, round(l_extendedprice * 100)::bigint as price from orders join lineitem on l_orderkey = o_orderkey where l_returnflag = 'N'),
s as (select cell, count(distinct price) as n, min(price) as p from c group by cell)
select o_orderkey as cell, case when n = 1 then p end as selected, case when n is null then 'normal_price_missing' when n > 1 then 'ambiguous_normal_price' else '' end as reason,
  case when n = 1 and o_orderpriority not like '1%' then 'accept' else 'review' end as route from orders left join s on cell = o_orderkey""")
def visual_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A cell is priced by its only distinct candidate; none or several go to review."""
    orders = table(spark, sf_dir, "orders")
    lines = table(spark, sf_dir, "lineitem").filter("l_returnflag = 'N'").groupBy("l_orderkey").agg(F.countDistinct(F.round(F.col("l_extendedprice") * 100).cast("long")).alias("n"), F.min(F.round(F.col("l_extendedprice") * 100).cast("long")).alias("p"))
    rows = orders.join(lines, orders["o_orderkey"] == lines["l_orderkey"], "left")
    reason = F.when(F.col("n").isNull(), "normal_price_missing").when(F.col("n") > 1, "ambiguous_normal_price").otherwise("")
    accept = F.coalesce(F.col("n") == 1, F.lit(False)) & ~F.col("o_orderpriority").startswith("1")
    return rows.select(F.col("o_orderkey").alias("cell"), F.when(F.col("n") == 1, F.col("p")).alias("selected"), reason.alias("reason"), F.when(accept, "accept").otherwise("review").alias("route"))


@query("""select l_returnflag as field, count(*) as n, count(*) filter (l_linestatus = 'O') as predicted, count(*) filter (l_linestatus = 'O' and l_quantity < 25) as right_ones,
  round(count(*) filter (l_linestatus = 'O' and l_quantity < 25) / nullif(count(*) filter (l_linestatus = 'O' and l_tax < 0.08), 0)::double, 6) as precision_, round(count(*) filter (l_linestatus = 'O') / count(*)::double, 6) as coverage,
  case when count(*) < 25 then 'NOT_EVALUABLE' when count(*) filter (l_linestatus = 'O' and l_quantity < 25) / nullif(count(*) filter (l_linestatus = 'O' and l_tax < 0.08), 0)::double >= 0.5 then 'PASS' else 'FAIL' end as verdict from lineitem group by 1""")
def field_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Precision and coverage per field, with a denominator that leaves the ambiguous out, and a least sample."""
    said = F.col("l_linestatus") == "O"
    right, base = F.count_if(said & (F.col("l_quantity") < 25)), F.count_if(said & (F.col("l_tax") < 0.08))
    out = table(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("field")).agg(F.count(F.lit(1)).alias("n"), F.count_if(said).alias("predicted"), right.alias("right_ones"), base.alias("base"))
    share = F.when(F.col("base") > 0, F.col("right_ones") / F.col("base"))
    verdict = F.when(F.col("n") < 25, "NOT_EVALUABLE").when(share >= 0.5, "PASS").otherwise("FAIL")
    return out.select("field", "n", "predicted", "right_ones", F.round(share, 6).alias("precision_"), F.round(F.col("predicted") / F.col("n"), 6).alias("coverage"), verdict.alias("verdict"))


@query("""select quality, count(*) filter (toxic = 1) as toxic, count(*) filter (toxic = 0) as clean, count(*) filter (toxic is null) as unknown from (select quality, toxic from labels) group by quality""")
def confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = table(spark, sf_dir, "labels").groupBy("quality").agg(F.count_if(F.col("toxic") == 1).alias("toxic"), F.count_if(F.col("toxic") == 0).alias("clean"), F.count_if(F.col("toxic").isNull()).alias("unknown"))
    return out


@query("""select chain, median(cents) as median_cents, quantile_cont(cents, 0.99) as p99, array_to_string(list_sort(list(distinct cents // 10000)), ',') as bins from obs group by chain""")
def distributions(spark: SparkSession, sf_dir: str) -> DataFrame:
    bins = F.array_join(F.array_sort(F.collect_set(F.expr("cents div 10000"))), ",")
    return observations(spark, sf_dir).groupBy("chain").agg(F.median("cents").alias("median_cents"), F.percentile("cents", 0.99).alias("p99"), bins.alias("bins"))


@query("""with r as (select unnest(['cheap', 'app', 'rescued']) as rule, unnest([cents < 2000, app_cents is not null, rescue]) as hit, chain = 'purchase' as truth from obs)
select rule, count(*) filter (hit and truth) as tp, count(*) filter (hit and not truth) as fp, count(*) filter (not hit and truth) as fn, count(*) filter (not hit and not truth) as tn from r group by rule""")
def rule_contingency(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = {"cheap": F.col("cents") < 2000, "app": F.col("app_cents").isNotNull(), "rescued": F.col("rescue")}
    rows = observations(spark, sf_dir).select((F.col("chain") == "purchase").alias("t"), F.explode(F.array(*(F.struct(F.lit(k).alias("rule"), c.alias("hit")) for k, c in rules.items()))).alias("r"))
    hit, t = F.col("r.hit"), F.col("t")
    return rows.groupBy(F.col("r.rule").alias("rule")).agg(F.count_if(hit & t).alias("tp"), F.count_if(hit & ~t).alias("fp"), F.count_if(~hit & t).alias("fn"), F.count_if(~hit & ~t).alias("tn"))


@query("""select l_orderkey, bool_and(l_discount < 0.08) as all_good, bool_or(l_discount < 0.02) as any_good, count(distinct l_returnflag) as kinds, case when bool_and(l_discount < 0.08) then 'single' when count(distinct l_returnflag) > 1 then 'mixed' else 'unresolved' end as outcome,
  (sum(case when l_returnflag = 'N' then l_quantity::bigint else 0 end) * 1000 + sum(l_quantity::bigint) // 2)::bigint // sum(l_quantity::bigint)::bigint as tenths from lineitem group by 1""")
def parent_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parents from their children: all, any, kinds, and completion in integer tenths of a percent, half up."""
    q = F.col("l_quantity").cast("long")
    good = F.bool_and(F.col("l_discount") < 0.08)
    kinds = F.countDistinct("l_returnflag")
    out = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(good.alias("all_good"), F.bool_or(F.col("l_discount") < 0.02).alias("any_good"), kinds.alias("kinds"), F.sum(F.when(F.col("l_returnflag") == "N", q).otherwise(0)).alias("d"), F.sum(q).alias("w"))
    return out.select("l_orderkey", "all_good", "any_good", "kinds", F.when(F.col("all_good"), "single").when(F.col("kinds") > 1, "mixed").otherwise("unresolved").alias("outcome"), F.expr("(d * 1000 + w div 2) div w").alias("tenths"))


@query("""select id, array_to_string(list_sort(list_filter([case when cents <= 0 then 'price_not_positive' end, case when valid_until < valid_from then 'window_reversed' end, case when (app_from is null) <> (app_until is null) then 'app_window_not_a_pair' end,
 case when app_from is not null and app_cents is null then 'app_window_without_price' end, case when mode = 'unit_basis' and regular_cents is null then 'unit_basis_without_reference' end, case when trim(coalesce(brand, '')) = '' then 'brand_empty' end], lambda x: x is not null)), ',') as broken from obs""")
def integrity_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = {
        "price_not_positive": F.col("cents") <= 0,
        "window_reversed": F.col("valid_until") < F.col("valid_from"),
        "app_window_not_a_pair": F.col("app_from").isNull() != F.col("app_until").isNull(),
        "app_window_without_price": F.col("app_from").isNotNull() & F.col("app_cents").isNull(),
        "unit_basis_without_reference": (F.col("mode") == "unit_basis") & F.col("regular_cents").isNull(),
        "brand_empty": F.trim(F.coalesce("brand", F.lit(""))) == "",
    }
    return observations(spark, sf_dir).select("id", F.array_join(gates.reasons(rules), ",").alias("broken"))
