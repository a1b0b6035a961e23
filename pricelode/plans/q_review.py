"""Queries of review work: assignments with margins, adjudication, contracts of a scan, plans against live rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pricelode.functions.text import sequence_ratio, tokens, with_letter_bound
from pricelode.operators import diff, gates, geometry, identity
from pricelode.operators.setjoin import Overlap, similar_pairs
from pricelode.plans.base import query, table
from pricelode.plans.q_geometry import BOXES_SQL, boxes
from pricelode.sources.observations import observations


@query(f"""with {BOXES_SQL}, p as (select a.id as a, b.id as b, greatest(least(a.x1, b.x1) - greatest(a.x0, b.x0), 0) / least(a.x1 - a.x0, b.x1 - b.x0) as share from boxes a join boxes b on a.page = b.page and a.id % 2 = 0 and b.id % 2 = 1)
select a, max(share) >= 0.55 as same_column, count(*) filter (share >= 0.55) as columns from p group by a""")
def same_column(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a box shares 55 % of the narrower width with one of the other kind on its page."""
    b = boxes(spark, sf_dir)
    pairs = geometry.prefixed(b.filter("id % 2 = 0"), "a_").join(geometry.prefixed(b.filter("id % 2 = 1"), "b_"), F.col("a_page") == F.col("b_page"))
    share = geometry.overlap_1d("a_x0", "a_x1", "b_x0", "b_x1") / F.least(F.col("a_x1") - F.col("a_x0"), F.col("b_x1") - F.col("b_x0"))
    rows = pairs.select(F.col("a_id").alias("a"), share.alias("share"))
    return rows.groupBy("a").agg((F.max("share") >= 0.55).alias("same_column"), F.count_if(F.col("share") >= 0.55).alias("columns"))


@query(f"""with {BOXES_SQL}, t as (select * from boxes where id % 4 = 0), g as (select * from boxes where id % 4 = 1), s as (select * from boxes where id % 4 = 2),
p as (select t.id as text, g.id as grp, abs((t.x0 + t.x1) / 2 - (g.x0 + g.x1) / 2) + abs((t.y0 + t.y1) / 2 - (g.y0 + g.y1) / 2) as cost from t join g on t.page = g.page
  where not exists (select 1 from s where s.page = t.page and (s.x0 + s.x1) / 2 between least((t.x0 + t.x1) / 2, (g.x0 + g.x1) / 2) and greatest((t.x0 + t.x1) / 2, (g.x0 + g.x1) / 2)
    and s.y0 <= least((t.y0 + t.y1) / 2, (g.y0 + g.y1) / 2) and s.y1 >= greatest((t.y0 + t.y1) / 2, (g.y0 + g.y1) / 2))),
r as (select *, row_number() over (partition by text order by cost, grp) as rn, lead(cost) over (partition by text order by cost, grp) as nxt from p where cost <= 220)
select text, case when nxt is null or nxt - cost >= 18 then grp end as grp, case when nxt is null or nxt - cost >= 18 then 'assigned' else 'ambiguous' end as route from r where rn = 1""")
def text_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A text goes to the cheapest group no separator cuts off (220 at most), if the next is 18 or more behind."""
    b = boxes(spark, sf_dir)
    side = lambda k, p: geometry.prefixed(b.filter(f"id % 4 = {k}"), p)
    (tx, ty), (gx, gy), (sx, _) = geometry.centre("t_"), geometry.centre("g_"), geometry.centre("s_")
    pairs = side(0, "t_").join(side(1, "g_"), F.col("t_page") == F.col("g_page")).withColumn("cost", F.abs(tx - gx) + F.abs(ty - gy)).filter("cost <= 220")
    cuts = (F.col("s_page") == F.col("t_page")) & sx.between(F.least(tx, gx), F.greatest(tx, gx)) & (F.col("s_y0") <= F.least(ty, gy)) & (F.col("s_y1") >= F.greatest(ty, gy))
    free = pairs.join(side(2, "s_"), cuts, "left_anti").select(F.col("t_id").alias("text"), F.col("g_id").alias("grp"), "cost")
    w = Window.partitionBy("text").orderBy("cost", "grp")
    rows = free.withColumn("rn", F.row_number().over(w)).withColumn("next", F.lead("cost").over(w)).filter("rn = 1")
    sure = F.col("next").isNull() | (F.col("next") - F.col("cost") >= 18)
    return rows.select("text", F.when(sure, F.col("grp")).alias("grp"), F.when(sure, "assigned").otherwise("ambiguous").alias("route"))


@query()
def unrepresented_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles with no like title (0.82) among those of the other kind with which they share a word."""
    part = table(spark, sf_dir, "part")
    a = part.filter("p_size > 25").select(F.concat_ws(" ", "p_name", F.lower("p_type")).alias("title")).distinct()
    b = part.filter("p_size <= 25").select(F.col("p_name").alias("other")).distinct()
    words = lambda df, c: df.select(c, F.explode(tokens(F.col(c), 4)).alias("w"))
    met = words(a, "title").join(words(b, "other"), "w").select("title", "other").distinct()
    like = with_letter_bound(met, "title", "other", "most").filter("most >= 0.82").withColumn("r", sequence_ratio("title", "other")).filter("r >= 0.82")
    return a.join(like.select("title").distinct(), "title", "left_anti")


@query("""with s as (select page_id, sha256(html) as sha, page_id % 2 as side from pages), m as (select a.page_id, count(b.page_id) as hits, min(b.page_id) as found from s a left join s b on a.sha = b.sha and b.side = 0 where a.side = 1 group by 1)
select page_id, hits, case when hits = 1 then found end as match, case hits when 0 then 'none' when 1 then 'match' else 'ambiguous' end as verdict from m""")
def corpus_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Match by digest; more than one match is ambiguous."""
    s = table(spark, sf_dir, "pages").select("page_id", F.sha2("html", 256).alias("sha"))
    known = s.filter("page_id % 2 = 0").groupBy("sha").agg(F.count(F.lit(1)).alias("hits"), F.min("page_id").alias("found"))
    rows = s.filter("page_id % 2 = 1").join(known, "sha", "left").withColumn("hits", F.coalesce("hits", F.lit(0)).cast("long"))
    return rows.select("page_id", "hits", F.when(F.col("hits") == 1, F.col("found")).alias("match"), gates.cascade([("none", F.col("hits") == 0), ("match", F.col("hits") == 1)], "ambiguous").alias("verdict"))


@query("""with g as (select l_orderkey as grp, list_sort(list(distinct l_returnflag)) as regions, count(*) as atoms from lineitem group by 1)
select grp, array_to_string(regions, '') as regions, atoms, case when regions = ['N'] then 'excluded' when len(regions) = 1 then 'single' when list_contains(regions, 'N') then 'mixed' else 'unresolved' end as outcome from g""")
def group_adjudication(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outcome class of a group from the regions that its atoms hit."""
    g = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("grp")).agg(F.array_sort(F.collect_set("l_returnflag")).alias("r"), F.count(F.lit(1)).alias("atoms"))
    rules = [("excluded", (F.size("r") == 1) & F.array_contains("r", "N")), ("single", F.size("r") == 1), ("mixed", F.array_contains("r", "N"))]
    return g.select("grp", F.array_join("r", "").alias("regions"), "atoms", gates.cascade(rules, "unresolved").alias("outcome"))


@query("""select chain, count(*) as rows, count(*) filter (cents >= 1000) as safe, count(*) filter (cents between 100 and 999) as review, count(*) filter (cents < 100) as excluded, count(distinct id) = count(*) as keys_unique,
  count(distinct valid_from) <= 1 as one_window, count(*) = count(*) filter (cents >= 1000) + count(*) filter (cents between 100 and 999) + count(*) filter (cents < 100) as accounted from obs group by chain""")
def scan_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of a scan's partitions, key collisions, whether there is one window, and that all rows are accounted for."""
    c, n = F.col("cents"), F.count(F.lit(1))
    safe, review, excluded = F.count_if(c >= 1000), F.count_if(c.between(100, 999)), F.count_if(c < 100)
    return observations(spark, sf_dir).groupBy("chain").agg(n.alias("rows"), safe.alias("safe"), review.alias("review"), excluded.alias("excluded"), (F.countDistinct("id") == n).alias("keys_unique"), (F.countDistinct("valid_from") <= 1).alias("one_window"), (n == safe + review + excluded).alias("accounted"))


@query("""with a as (select id % 300 as page, 'cheap' as hint, id from obs where cents < 150 union all select id % 300, 'no image', id from obs where image = '' and coupon)
select page, string_agg(hint || ':' || id, ',' order by hint, id) as hints, count(*) as n from a group by page""")
def page_hints(spark: SparkSession, sf_dir: str) -> DataFrame:
    obs = observations(spark, sf_dir).withColumn("page", F.col("id") % 300)
    hints = F.array_compact(F.array(F.when(F.col("cents") < 150, "cheap"), F.when((F.col("image") == "") & F.col("coupon"), "no image")))
    rows = obs.select("page", "id", F.explode(hints).alias("hint"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("hint", "id"))), lambda h: F.concat_ws(":", h["hint"], h["id"].cast("string"))), ",")
    return rows.groupBy("page").agg(joined.alias("hints"), F.count(F.lit(1)).alias("n"))


@query("""with p as (select id, chain, offer, cents from obs where id % 5 < 4), l as (select id, chain, offer, case when id % 200 = 0 then cents + 5 else cents end as cents from obs where id % 5 > 0)
select count(*) filter (p.id is not null and l.id is not null) as met, count(*) filter (p.chain = l.chain and p.offer = l.offer and p.cents = l.cents) as identical, count(*) filter (p.id is not null and l.id is not null and p.cents <> l.cents) as drifted,
  count(*) filter (l.id is null) as not_live, count(*) filter (p.id is null) as not_planned from p full join l on p.id = l.id""")
def plan_against_live(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A plan's rows against the live ones: met, identical, drifted, missing on either side."""
    obs = observations(spark, sf_dir).select("id", "chain", "offer", "cents")
    p = obs.filter("id % 5 < 4").select("id", F.struct("chain", "offer", "cents").alias("p"))
    live = obs.filter("id % 5 > 0").select("id", F.struct("chain", "offer", F.when(F.col("id") % 200 == 0, F.col("cents") + 5).otherwise(F.col("cents")).alias("cents")).alias("l"))
    both, no = p.join(live, "id", "full"), F.lit(False)
    met = F.col("p").isNotNull() & F.col("l").isNotNull()
    return both.agg(F.count_if(met).alias("met"), F.count_if(met & F.coalesce(F.col("p") == F.col("l"), no)).alias("identical"), F.count_if(met & F.coalesce(F.col("p.cents") != F.col("l.cents"), no)).alias("drifted"), F.count_if(F.col("l").isNull()).alias("not_live"), F.count_if(F.col("p").isNull()).alias("not_planned"))


@query("""select id, list_sort(list_filter([case when brand is null then 'brand' end, case when valid_from is null then 'validity' end, case when image = '' then 'image' end], lambda x: x is not null)) = ['brand'] as scope_only,
  coalesce(brand, '') <> '' and valid_from is not null and cents > 0 as fields_present from obs""")
def fast_review(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows whose only reason is the one that a quick look settles, and whether the required fields are there."""
    found = gates.reasons({"brand": F.col("brand").isNull(), "validity": F.col("valid_from").isNull(), "image": F.col("image") == ""})
    there = (F.coalesce("brand", F.lit("")) != "") & F.col("valid_from").isNotNull() & (F.col("cents") > 0)
    return observations(spark, sf_dir).select("id", (found == F.array(F.lit("brand"))).alias("scope_only"), there.alias("fields_present"))


@query("""with w as (select min(valid_from) as f, max(valid_until) as u from obs where chain = 'view' and day = date '2024-01-10') select id, case when valid_from is null then w.f else valid_from end as first_day, coalesce(valid_until, w.u) as last_day from obs, w where chain = 'click'""")
def campaign_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One campaign's window for every offer that has none."""
    obs = observations(spark, sf_dir)
    campaign = obs.filter("chain = 'view' and day = date '2024-01-10'")
    first, last = campaign.agg(F.min("valid_from")).scalar(), campaign.agg(F.max("valid_until")).scalar()
    return obs.filter("chain = 'click'").select("id", F.coalesce(F.col("valid_from"), first).alias("first_day"), F.coalesce(F.col("valid_until"), last).alias("last_day"))


@query("""with k as (select p_partkey, string_split(p_name, ' ') as a, p_type as t from part), d as (select distinct string_split(p_name, ' ') as b, p_name from part)
select p_partkey, p_name, (len(list_intersect(a, b)) * 3.0 + case when len(list_intersect(a, b)) = 2 then 1.5 else 0 end + case when t = 'SMALL' then 1.0 else 0 end)::double as score from k join d on list_has_any(a, b) where len(list_intersect(a, b)) * 3.0 + case when len(list_intersect(a, b)) = 2 then 1.5 else 0 end + case when t = 'SMALL' then 1.0 else 0 end >= 5.5""")
def pairing_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlap of words and metadata as a score; 5.5 accepts."""
    part = table(spark, sf_dir, "part")
    names = part.select("p_name").distinct().select("p_name", F.split("p_name", " ").alias("b"))
    # names that accept each other share two words, which are the key; parts come back by their name
    found = similar_pairs(names.select(F.col("p_name").alias("id"), F.col("b").alias("words")), None, Overlap(2), width=2)
    self = names.filter(F.size(F.array_distinct("b")) >= 2).select(F.col("p_name").alias("own"), "p_name")
    met = found.select(F.col("left_id").alias("own"), F.col("right_id").alias("p_name")).union(found.select("right_id", "left_id")).union(self)
    a = part.select("p_partkey", F.col("p_name").alias("own"), F.split("p_name", " ").alias("a"), "p_type")
    met = a.join(met, "own").withColumn("b", F.split("p_name", " "))
    common = F.size(F.array_intersect("a", "b"))
    score = common * 3.0 + gates.score([(1.5, common == 2), (1.0, F.col("p_type") == "SMALL")])
    return met.select("p_partkey", "p_name", score.alias("score")).filter("score >= 5.5")


@query("""with u as (select 'explicit' as src, offer, chain from obs where id % 7 = 0 union all select 'parsed', offer, chain from obs where id % 3 = 0), a as (select distinct offer, chain from u), b as (select distinct offer, chain from obs where id % 4 = 0)
select coalesce(a.chain, b.chain) as chain, count(*) filter (a.offer is not null and b.offer is not null) as retained, count(*) filter (a.offer is null) as added, count(*) filter (b.offer is null) as removed from a full join b on a.offer = b.offer and a.chain = b.chain group by 1""")
def card_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Retained, added and removed over all cards of two cycles, parsed and explicitly excluded ones together."""
    obs = observations(spark, sf_dir).select("offer", "chain", "id")
    old = identity.first_of_sources([obs.filter("id % 7 = 0").select("offer", "chain").distinct(), obs.filter("id % 3 = 0").select("offer", "chain").distinct()], ["offer", "chain"]).withColumn("o", F.lit(True))
    new = obs.filter("id % 4 = 0").select("offer", "chain").distinct().withColumn("n", F.lit(True))
    there = lambda c: F.col(c).isNotNull()
    return old.join(new, ["offer", "chain"], "full").groupBy("chain").agg(F.count_if(there("o") & there("n")).alias("retained"), F.count_if(~there("o")).alias("added"), F.count_if(~there("n")).alias("removed"))


@query("""select l_orderkey, array_to_string(list_sort(list(distinct l_partkey)), ',') as products, list_max(list(l_quantity)) >= 40 as wide, min(l_linenumber) as first_line, arg_min(l_partkey, (l_quantity, l_linenumber, l_partkey)) as narrowest, count(*) filter (l_quantity >= 25) as covering from lineitem group by 1""")
def document_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Products linked by a document over all its pages, and coverage by threshold."""
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(
        F.array_join(F.array_sort(F.collect_set("l_partkey")), ",").alias("products"), (F.max("l_quantity") >= 40).alias("wide"), F.min("l_linenumber").alias("first_line"),
        F.min_by("l_partkey", F.struct("l_quantity", "l_linenumber", "l_partkey")).alias("narrowest"), F.count_if(F.col("l_quantity") >= 25).alias("covering"),
    )


@query("""select sum(('0x' || substr(sha256(id::varchar), 1, 15))::bigint::hugeint)::varchar as snapshot, count(distinct offer) as offers, false as apply_authorized, min(day) as first_day from obs where chain = 'purchase' and day between date '2024-01-10' and date '2024-01-12'""")
def write_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A create-only plan: snapshot identity from its evidence, never authorised by itself."""
    rows = observations(spark, sf_dir).filter("chain = 'purchase' and day between date '2024-01-10' and date '2024-01-12'")
    snapshot = diff.multiset_digest([F.col("id").cast("string")]).cast("string")
    return rows.agg(snapshot.alias("snapshot"), F.countDistinct("offer").alias("offers"), F.lit(False).alias("apply_authorized"), F.min("day").alias("first_day"))
