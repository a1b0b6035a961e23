"""Queries on evidence: embedded JSON, receipts, manifests, samples, reconciliations, line and column grouping."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pricelode.functions import walk
from pricelode.functions.text import CODE_KEYS, normalized, sequence_ratio, tokens, with_letter_bound
from pricelode.operators import gates, ranking, scan
from pricelode.plans.base import query, table
from pricelode.shared import shared_path
from pricelode.sources.observations import observations

#: Entries of embedded pages that a task takes.
ENTRIES = 500_000
NAMESPACE = "6ba7b811-9dad-11d1-80b4-00c04fd430c8"


@query("""select l_orderkey as page, l_partkey::varchar as object_id, (max(l_extendedprice) * 100)::bigint as cents, count(*) as times from lineitem where l_quantity > 5 group by all""".replace("(max(l_extendedprice) * 100)::bigint", "round(max(l_extendedprice) * 100)::bigint"))
def embedded_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page's script block holds JSON that holds JSON (a map by object id); entries without a price are left out."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_partkey").cast("string").alias("object_id"), F.when(F.col("l_quantity") > 5, F.round(F.col("l_extendedprice") * 100).cast("long")).alias("cents"))
    # tasks follow the rows: a task builds and parses the pages of about so many of them, in all steps
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    lines = lines.repartition(max(parts, lines.count() // ENTRIES + 1), "l_orderkey")
    entry = F.struct("object_id", F.struct("cents").alias("price"))
    inner = lines.groupBy("l_orderkey").agg(F.to_json(F.collect_list(entry)).alias("data"))
    page = F.concat(F.lit('<html><script id="__NEXT_DATA__" type="application/json">'), F.to_json(F.struct(F.struct("data").alias("props"))), F.lit("</script></html>"))
    pages = inner.select(F.col("l_orderkey").alias("page"), page.alias("html"))
    outer = F.regexp_extract("html", '<script id="__NEXT_DATA__"[^>]*>(.*?)</script>', 1)
    found = pages.select("page", F.from_json(F.get_json_object(outer, "$.props.data"), "array<struct<object_id: string, price: struct<cents: bigint>>>").alias("d"))
    rows = found.select("page", F.explode("d").alias("e")).select("page", "e.object_id", "e.price.cents").filter("cents is not null")
    return rows.groupBy("page", "object_id").agg(F.max("cents").alias("cents"), F.count(F.lit(1)).alias("times"))


WALKED_SQL = "select event_id, t.key as name, replace(t.fullkey, '\"', '') as path, t.type, t.atom ->> '$' as value, t.id as spot from {}, json_tree(body::json) t where t.fullkey <> '$' and not ends_with(t.fullkey, ']')"


@query(f"""with j as (select event_id, '{{"a":[' || props || ',{{"b":{{"EAN-13":"4006381333931"}}}}]}}' as body from events), w as ({WALKED_SQL.format("j")})
select event_id, (row_number() over (partition by event_id order by spot) - 1)::int as place, path, name, case when type not in ('OBJECT', 'ARRAY', 'NULL') then value end as value from w""")
def json_walk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every key at any depth of nested JSON made of the events."""
    rows = table(spark, sf_dir, "events").select("event_id", F.concat(F.lit('{"a":['), F.col("props"), F.lit(',{"b":{"EAN-13":"4006381333931"}}]}')).alias("body"))
    return walk.walked(rows, "event_id", "body")


@query(f"""with j as (select event_id, '{{"ean":"123","a":[' || props || ',{{"b":{{"EAN-13":"' || case when event_id % 3 = 0 then '4006381333931' else '4006381333932' end || '"}}}}]}}' as body from events), w as ({WALKED_SQL.format("j")}),
c as (select *, reverse(value) as r from w where regexp_replace(lower(name), '[^a-z0-9]+', '', 'g') in {tuple(CODE_KEYS)} and regexp_full_match(value, '[0-9]{{8}}|[0-9]{{12,14}}')),
g as (select *, (10 - list_sum(list_transform(range(2, len(r) + 1), lambda i: r[i]::int * case when i % 2 = 0 then 3 else 1 end)) % 10) % 10 = r[1]::int as good from c)
select event_id, lpad(arg_min(value, spot), 14, '0') as gtin, arg_min(path, spot) as path from g where good group by event_id""")
def explicit_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    code = F.when(F.col("event_id") % 3 == 0, "4006381333931").otherwise("4006381333932")
    rows = table(spark, sf_dir, "events").select("event_id", F.concat(F.lit('{"ean":"123","a":['), F.col("props"), F.lit(',{"b":{"EAN-13":"'), code, F.lit('"}}]}')).alias("body"))
    return walk.explicit_codes(rows, "event_id", "body")


@query("""with h as (select id, sha1(unhex('6ba7b8119dad11d180b400c04fd430c8') || encode(chain || ':' || offer || ':' || id)) as h from obs)
select id, h[1:8] || '-' || h[9:12] || '-5' || h[14:16] || '-' || substr('89ab', (('0x' || h[17:17])::int % 4 + 1)::int, 1) || h[18:20] || '-' || h[21:32] as uuid from h""")
def stable_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Name-based ids, from built-in functions."""
    name = F.concat_ws(":", "chain", F.col("offer").cast("string"), F.col("id").cast("string"))
    return observations(spark, sf_dir).select("id", walk.uuid5_column(NAMESPACE, name).alias("uuid"))


@query("""select lower(url) as folded, count(*) as n, string_agg(distinct substr(sha256(html), 1, 16), ',' order by substr(sha256(html), 1, 16)) as digests, sum(strlen(html))::bigint as bytes from pages group by 1""")
def manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digest and size by path; paths that fold to one are seen by their count."""
    digest = F.substring(F.sha2("html", 256), 1, 16)
    return table(spark, sf_dir, "pages").groupBy(F.lower("url").alias("folded")).agg(F.count(F.lit(1)).alias("n"), F.array_join(F.array_sort(F.collect_set(digest)), ",").alias("digests"), F.sum(F.octet_length("html")).cast("long").alias("bytes"))


@query("""with old as (select distinct sha256(html) as s from pages where page_id % 2 = 0) select max(page_id) as page_id, sha256(html) as sha from pages where page_id % 2 = 1 and sha256(html) not in (select s from old) group by sha256(html)""")
def register_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages").select("page_id", F.sha2("html", 256).alias("sha"))
    new = p.filter("page_id % 2 = 1").join(p.filter("page_id % 2 = 0").select("sha").distinct(), "sha", "left_anti")
    return new.groupBy("sha").agg(F.max("page_id").alias("page_id"))


@query("""with t as (select conv_id, turn, role, lag(role) over (partition by conv_id order by turn, role) as was from conversations)
select conv_id, count(*) filter (was is not null and was = role) as broken, count(*) as steps, count(*) filter (was is null) as starts from t group by conv_id""")
def state_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A step that repeats the state before it is not a transition."""
    was = F.lag("role").over(Window.partitionBy("conv_id").orderBy("turn", "role"))
    rows = table(spark, sf_dir, "conversations").withColumn("was", was)
    return rows.groupBy("conv_id").agg(F.count_if(F.coalesce(F.col("was") == F.col("role"), F.lit(False))).alias("broken"), F.count(F.lit(1)).alias("steps"), F.count_if(F.col("was").isNull()).alias("starts"))


@query("""select chain, count(*) filter (day < date '2024-01-15') as before_, count(*) as after_, count(*) filter (day >= date '2024-01-15') as delta from obs group by chain""")
def table_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = F.col("day") < F.lit("2024-01-15").cast("date")
    return observations(spark, sf_dir).groupBy("chain").agg(F.count_if(old).alias("before_"), F.count(F.lit(1)).alias("after_"), F.count_if(~old).alias("delta"))


@query("""with r as (select l_orderkey as card, l_linestatus || l_returnflag as role, l_partkey as evidence from lineitem), e as (select evidence, count(distinct role) as roles from r group by 1),
k as (select card, role, count(*) as n, max(roles) as shared from r join e using (evidence) group by all) select card, count(*) filter (n > 1) as repeated_roles, max(shared) as widest, count(*) filter (n > 1) = 0 as verified from k group by card""")
def receipts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One observation for each role of a card, and how many roles share its evidence at most."""
    r = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("card"), F.concat("l_linestatus", "l_returnflag").alias("role"), F.col("l_partkey").alias("evidence"))
    roles = r.groupBy("evidence").agg(F.countDistinct("role").alias("roles"))
    k = r.join(roles, "evidence").groupBy("card", "role").agg(F.count(F.lit(1)).alias("n"), F.max("roles").alias("shared"))
    repeated = F.count_if(F.col("n") > 1)
    return k.groupBy("card").agg(repeated.alias("repeated_roles"), F.max("shared").alias("widest"), (repeated == 0).alias("verified"))


@query("select id, chain, store from obs where (chain, coalesce(store, '-')) in (('click', '-'), ('view', '3'), ('error', '4')) and (store is not distinct from null or store = '3')")
def scope_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Membership in a small set of (chain, store) pairs, a null store being one."""
    scopes = spark.createDataFrame([("click", None), ("view", "3"), ("error", "4")], "c string, s string")
    obs = observations(spark, sf_dir).filter(F.col("store").isNull() | (F.col("store") == "3"))
    return obs.join(scopes, (obs["chain"] == scopes["c"]) & obs["store"].eqNullSafe(scopes["s"]), "left_semi").select("id", "chain", "store")


@query("""select doc_id, regexp_matches(text, '(?i)license|copyright') as excluded, len(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[0-9]')))::int as basis_lines,
  regexp_matches(text, '(?i)license') and len(string_split(text, chr(10))) <= 12 as accepted from documents""")
def line_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Acceptance by what lines hold and do not hold, and how many lines have a signature."""
    lines = F.split("text", "\n")
    licensed = F.col("text").rlike("(?i)license")
    return table(spark, sf_dir, "documents").select("doc_id", F.col("text").rlike("(?i)license|copyright").alias("excluded"), F.size(F.filter(lines, lambda x: x.rlike("[0-9]"))).alias("basis_lines"), (licensed & (F.size(lines) <= 12)).alias("accepted"))


@query("""select id, case when brand is not null then 'corrected' else 'original' end as name_source, coalesce(brand, name) as name, case when app_cents is null and regular_cents is null then 'single' when app_cents is null or regular_cents is null then 'pdf' when app_cents = regular_cents then 'agreed' else 'conflict' end as arbitration from obs""")
def merged_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Corrections override the original payload; two sources that disagree are a conflict."""
    original = F.create_map(F.lit("name"), F.col("name"), F.lit("name_source"), F.lit("original"))
    corrected = F.when(F.col("brand").isNotNull(), F.create_map(F.lit("name"), F.col("brand"), F.lit("name_source"), F.lit("corrected"))).otherwise(F.create_map().cast("map<string,string>"))
    merged = F.map_from_entries(F.map_entries(F.map_filter(original, lambda k, v: ~F.coalesce(F.array_contains(F.map_keys(corrected), k), F.lit(False)))))
    both = F.map_concat(merged, corrected)
    rules = [("single", F.col("app_cents").isNull() & F.col("regular_cents").isNull()), ("pdf", F.col("app_cents").isNull() | F.col("regular_cents").isNull()), ("agreed", F.col("app_cents") == F.col("regular_cents"))]
    rows = observations(spark, sf_dir).select("id", both.alias("m"), gates.cascade(rules, "conflict").alias("arbitration"))
    return rows.select("id", F.col("m")["name_source"].alias("name_source"), F.col("m")["name"].alias("name"), "arbitration")


@query("""with n as (select chain, id, row_number() over (partition by chain order by id) as rn, count(*) over (partition by chain) as total from obs), k as (select unnest(range(0, 6)) as i)
select chain, id, rn from n join k on rn = (i * (total - 1) + 2) // 5 + 1""")
def stratified_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six rows of each chain, evenly spaced: places round(i * (n - 1) / 5) + 1."""
    obs = observations(spark, sf_dir).select("chain", "id")
    total = obs.groupBy("chain").agg(F.count(F.lit(1)).alias("total"))  # a row for each chain
    rows = ranking.numbered(obs, "rn", [F.col("id")], ["chain"]).join(total, "chain")
    places = F.transform(F.sequence(F.lit(0), F.lit(5)), lambda i: F.floor((i * (F.col("total") - 1) + 2) / 5) + 1)
    return rows.filter(F.array_contains(places, F.col("rn").cast("long"))).select("chain", "id", "rn")


@query("""with s as (select id, offer, image, cents % 17 as score, cents % 5 as width from obs where image <> '') select offer, arg_max(case when width = 0 then null else image || '#' || id end, score * 100000000 + width * 10000000 + id) as best, count(*) as n from s group by offer""".replace("arg_max(", "arg_max_null("))
def best_image(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The image with the best (score, width, id); null where that one is a logo (width 0)."""
    s = observations(spark, sf_dir).filter("image <> ''").select("offer", "id", (F.col("cents") % 17).alias("score"), (F.col("cents") % 5).alias("width"), F.concat_ws("#", "image", F.col("id").cast("string")).alias("link"))
    best = F.max_by(F.struct(F.when(F.col("width") > 0, F.col("link")).alias("link")), F.struct("score", "width", "id"))
    return s.groupBy("offer").agg(best["link"].alias("best"), F.count(F.lit(1)).alias("n"))


@query("""with p as (select offer, max(cents)::bigint filter (chain = 'view') as public_, max(cents)::bigint filter (chain = 'click') as origin from obs group by offer)
select offer, public_, origin, case when public_ is null and origin is null then 'no_data' when origin is null then 'origin_down' when public_ is null then 'edge_down' when public_ > origin * 2 then 'slow_edge' else 'healthy' end as class from p""".replace("max(cents)::bigint filter (chain = 'view')", "(max(cents) filter (chain = 'view'))::bigint").replace("max(cents)::bigint filter (chain = 'click')", "(max(cents) filter (chain = 'click'))::bigint"))
def endpoint_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both readings of an endpoint side by side, then a class."""
    p = observations(spark, sf_dir).groupBy("offer").pivot("chain", ["view", "click"]).agg(F.max("cents")).withColumnsRenamed({"view": "public_", "click": "origin"})
    rules = [("no_data", F.col("public_").isNull() & F.col("origin").isNull()), ("origin_down", F.col("origin").isNull()), ("edge_down", F.col("public_").isNull()), ("slow_edge", F.col("public_") > F.col("origin") * 2)]
    return p.withColumn("class", gates.cascade(rules, "healthy"))


@query("""with a as (select doc_id, quality from labels where doc_id % 5 < 4), b as (select doc_id, 1 - toxic as quality from labels where doc_id % 5 > 0)
select count(*) filter (a.doc_id is not null and b.doc_id is not null) as both_, count(*) filter (a.quality = b.quality) as agreed, count(*) filter (b.doc_id is null) as first_only, count(*) filter (a.doc_id is null) as second_only from a full join b on a.doc_id = b.doc_id""")
def review_reconciliation(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels")
    a = labels.filter("doc_id % 5 < 4").select("doc_id", F.col("quality").alias("a"))
    b = labels.filter("doc_id % 5 > 0").select("doc_id", (1 - F.col("toxic")).alias("b"))
    j = a.withColumn("in_a", F.lit(True)).join(b.withColumn("in_b", F.lit(True)), "doc_id", "full")
    there = lambda c: F.col(c).isNotNull()
    return j.agg(F.count_if(there("in_a") & there("in_b")).alias("both_"), F.count_if(F.coalesce(F.col("a") == F.col("b"), F.lit(False))).alias("agreed"), F.count_if(~there("in_b")).alias("first_only"), F.count_if(~there("in_a")).alias("second_only"))


@query()
def best_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best structured title for each product name: a shared word of four letters, ratio of 0.55 at least, ties by name."""
    names = table(spark, sf_dir, "part").select(F.col("p_name").alias("title")).distinct()
    nations = table(spark, sf_dir, "part").select(F.concat_ws(" ", "p_name", F.lower("p_type")).alias("other")).distinct()
    a, b = names.select("title", F.explode(tokens(F.col("title"), 4)).alias("w")), nations.select("other", F.explode(tokens(F.col("other"), 4)).alias("w"))
    met = a.join(b, "w").select(normalized(F.col("title")).alias("a"), normalized(F.col("other")).alias("b"), "title", "other").distinct()
    pairs = with_letter_bound(met, "a", "b", "most").filter("most >= 0.55").withColumn("ratio", sequence_ratio("a", "b")).filter("ratio >= 0.55")
    rank = F.row_number().over(Window.partitionBy("title").orderBy(F.desc("ratio"), "other"))
    return pairs.withColumn("rn", rank).filter("rn = 1").select("title", "other", "ratio")


@query("""with w as (select id, id % 300 as page, id % 7 as line, cents // 100 as euro, cents % 100 as cent, (id * 37 % 500)::double as x from obs),
p as (select a.id as euro_id, b.id as cent_id, a.euro * 100 + b.cent as price, b.x - a.x as gap, row_number() over (partition by a.id order by b.x - a.x, b.id) as rn from w a join w b on a.page = b.page and a.line = b.line and b.x > a.x and b.x - a.x <= 120)
select euro_id, cent_id, price, gap from p where rn = 1""")
def split_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A euro word and the nearest cent word to its right on the line, within 120."""
    w = observations(spark, sf_dir).select("id", (F.col("id") % 300).alias("page"), (F.col("id") % 7).alias("line"), F.expr("cents div 100").alias("euro"), (F.col("cents") % 100).alias("cent"), (F.col("id") * 37 % 500).cast("double").alias("x"))
    # places that words of a line share are one row: the first cent word of each, and the next place to its right
    spots = w.groupBy("page", "line", "x").agg(F.min(F.struct(F.col("id").alias("cent_id"), "cent")).alias("word")).withColumn("_left", -F.col("x"))
    told = scan.before(scan.dealt(spots, ["page", "line"], ["_left"]), ["page", "line"], ["_left"], ["x", "word"], "next")
    gap = F.col("next.x") - F.col("x")
    near = told.select("page", "line", "x", gap.alias("gap"), "next.word.cent_id", "next.word.cent").filter("gap <= 120")
    found = w.join(near.withColumnRenamed("cent", "_cent"), ["page", "line", "x"]).select(F.col("id").alias("euro_id"), "cent_id", (F.col("euro") * 100 + F.col("_cent")).alias("price"), "gap")
    return found.groupBy("euro_id").agg(F.min(F.struct("gap", "cent_id", "price")).alias("p")).select("euro_id", "p.cent_id", "p.price", "p.gap")


@query("""with w as (select id, id % 50 as page, (id * 53 % 1000)::double as y, cents as conf from obs), g as (select *, case when y - lag(y) over (partition by page order by y, id) <= 2.6 then 0 else 1 end as fresh from w),
r as (select *, sum(fresh) over (partition by page order by y, id) as line from g) select page, line::bigint as line, min(y) as top, max(y) as bottom, count(*) as words, round(avg(conf), 6) as confidence, string_agg(id::varchar, ' ' order by y, id) as joined from r group by page, line""")
def line_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words joined to lines by a vertical gap of 2.6 at most: bounds, mean confidence, words in order."""
    rows = observations(spark, sf_dir).select("id", (F.col("id") % 50).alias("page"), (F.col("id") * 53 % 1000).cast("double").alias("y"), F.col("cents").alias("conf"))
    rows = scan.segments(rows, ["page"], ["y", "id"], ["y"], lambda prev: F.col("y") - prev["y"] > 2.6, "line")
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("y", "id"))), lambda s: s["id"].cast("string")), " ")
    return rows.groupBy("page", "line").agg(F.min("y").alias("top"), F.max("y").alias("bottom"), F.count(F.lit(1)).alias("words"), F.round(F.avg("conf"), 6).alias("confidence"), joined.alias("joined"))


@query("""select l_orderkey, l_linenumber, l_partkey, (round(l_extendedprice * 100)::bigint * 1000 // (l_quantity::bigint * 100))::bigint as expected, abs(round(l_extendedprice * 100)::bigint * 10 // l_quantity::bigint - p_retailprice * 1000) <= greatest(30, p_retailprice * 15) as consistent
from lineitem join part on l_partkey = p_partkey""")
def unit_price_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Printed against computed unit price, within max(0.03, 1.5 %)."""
    rows = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    rows = rows.withColumn("c", F.round(F.col("l_extendedprice") * 100).cast("long")).withColumn("q", F.col("l_quantity").cast("long"))
    off = F.abs(F.expr("c * 10 div q") - F.col("p_retailprice") * 1000)
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", F.expr("c * 1000 div (q * 100)").alias("expected"), (off <= F.greatest(F.lit(30.0), F.col("p_retailprice") * 15)).alias("consistent"))


@query("""with l as (select day, name, cents, count(distinct chain || (id % 2)) as modes, count(distinct id % 2) as readings from obs group by all) select day, name, cents, readings = 2 as consensus from l where modes > 0""")
def reading_consensus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same line in both readings."""
    return observations(spark, sf_dir).groupBy("day", "name", "cents").agg((F.countDistinct(F.col("id") % 2) == 2).alias("consensus"))


@query("""with n as (select chain, case when brand is null then 'brand_missing' when mode is null then 'mode_missing' else 'complete' end as status from obs)
select chain, status, n, round_even(n * 100.0 / sum(n) over (partition by chain), 2)::double as percent from (select chain, status, count(*) as n from n group by all)""")
def normalization_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = [("brand_missing", F.col("brand").isNull()), ("mode_missing", F.col("mode").isNull())]
    counts = observations(spark, sf_dir).groupBy("chain", gates.cascade(rules, "complete").alias("status")).agg(F.count(F.lit(1)).alias("n"))
    total = F.sum("n").over(Window.partitionBy("chain"))
    return counts.withColumn("percent", F.bround((F.col("n") * 100).cast("decimal(20,0)") / total.cast("decimal(20,0)"), 2).cast("double"))


@query("""with c as (select o_custkey, count(*) as n from orders group by 1), r as (select c_nationkey, c_custkey, n, rank() over (partition by c_nationkey order by n desc) as rk from c join customer on o_custkey = c_custkey)
select c_nationkey, case when count(*) = 1 then min(c_custkey) end as top, count(*) > 1 as ambiguous from r where rk = 1 group by 1""")
def unique_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The parent with the most children; a tie is ambiguous and gives none."""
    n = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"))
    rows = n.join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    ranked = rows.withColumn("rk", F.rank().over(Window.partitionBy("c_nationkey").orderBy(F.desc("n")))).filter("rk = 1")
    return ranked.groupBy("c_nationkey").agg(F.when(F.count(F.lit(1)) == 1, F.min("c_custkey")).alias("top"), (F.count(F.lit(1)) > 1).alias("ambiguous"))


@query("""with d as (select distinct day, offer, cents % 10 as k from obs), e as (select offer, count(distinct k) > 1 as conflict, min(k) as k from d group by offer), i as (select day, list_sort(list(distinct offer)) as ids from d group by day)
select day, id as offer, e.conflict, case when not e.conflict then e.k end as k from (select day, unnest(ids) as id from i) join e on id = e.offer""")
def day_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Day lists kept as entities and id arrays, and put back together; an entity told two ways is a conflict."""
    d = observations(spark, sf_dir).select("day", "offer", (F.col("cents") % 10).alias("k")).distinct()
    entities = d.groupBy("offer").agg((F.countDistinct("k") > 1).alias("conflict"), F.min("k").alias("k"))
    lists = d.groupBy("day").agg(F.array_sort(F.collect_set("offer")).alias("ids"))
    back = lists.select("day", F.explode("ids").alias("offer")).join(entities, "offer")
    return back.select("day", "offer", "conflict", F.when(~F.col("conflict"), F.col("k")).alias("k"))


@query("""with u as (select offer, chain, cents, id, 0 as src from obs where id % 2 = 0 union all select offer, chain, cents, id, 1 from obs where id % 3 = 0)
select offer, chain, cents, min(id) as id, count(*) as times from u group by offer, chain, cents having count(*) >= 1""")
def content_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Union of two review sets, one row for each content."""
    obs = observations(spark, sf_dir).select("offer", "chain", "cents", "id")
    return obs.filter("id % 2 = 0").union(obs.filter("id % 3 = 0")).groupBy("offer", "chain", "cents").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("times"))


@query("""select day, offer, id from obs qualify row_number() over (partition by day, offer order by (app_cents is not null) desc, (brand is not null) desc, id) = 1""")
def keep_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = [F.desc(F.col("app_cents").isNotNull()), F.desc(F.col("brand").isNotNull()), F.col("id")]
    return observations(spark, sf_dir).withColumn("rn", F.row_number().over(Window.partitionBy("day", "offer").orderBy(*order))).filter("rn = 1").select("day", "offer", "id")


@query("""select day, id, rn::int as place from (select *, row_number() over (partition by day order by coalesce(percent, 0) desc, cents, lower(name), id) as rn from obs) where rn <= 4""")
def day_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = [F.desc(F.coalesce("percent", F.lit(0))), F.col("cents"), F.lower("name"), F.col("id")]
    return observations(spark, sf_dir).withColumn("place", F.row_number().over(Window.partitionBy("day").orderBy(*order))).filter("place <= 4").select("day", "id", "place")


@query("""select id, (collected_at + interval 1 hour)::date as berlin_day, date_trunc('day', collected_at + interval 1 hour) - interval 25 hours as yesterday_begins from obs""")
def business_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The business date in Berlin (winter), and where the day before begins in UTC."""
    local = F.from_utc_timestamp(F.col("collected_at").cast("timestamp"), "Europe/Berlin")
    day = F.to_date(local)
    begins = F.to_utc_timestamp(F.date_sub(day, 1).cast("timestamp"), "Europe/Berlin").cast("timestamp_ntz")
    return observations(spark, sf_dir).select("id", day.alias("berlin_day"), begins.alias("yesterday_begins"))


@query("select id::varchar as id, chain, coalesce(brand, '') as brand, (rescue)::varchar as rescue from obs")
def tsv_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Written as tab-separated text (null empty, booleans in lower case) and read back as text."""
    rows = observations(spark, sf_dir).select(F.col("id").cast("string").alias("id"), "chain", F.coalesce("brand", F.lit("")).alias("brand"), F.lower(F.col("rescue").cast("string")).alias("rescue"))
    path = shared_path(spark, "tsv")
    rows.write.option("sep", "\t").option("header", True).option("emptyValue", "").csv(path)
    return spark.read.option("sep", "\t").option("header", True).option("quote", "").schema(rows.schema).csv(path).fillna("")


@query("""with h as (select chain, day, count(*) as n from obs group by all), k as (select *, row_number() over (partition by chain order by day) as rn, lag(n) over (partition by chain order by day) as was from h)
select chain, day, n, coalesce(n <> was, true) as appended, sha256(chain || '|' || day || '|' || n || '|' || coalesce(was, 0)) as digest from k where rn > (select max(rn) - 20 from k)""")
def carried_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """History that a run carries on: appended only on change, with a digest over the state before, 20 kept."""
    h = observations(spark, sf_dir).groupBy("chain", "day").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("chain")
    k = h.withColumn("was", F.lag("n").over(w.orderBy("day"))).withColumn("back", F.row_number().over(w.orderBy(F.desc("day")))).filter("back <= 20")
    digest = F.sha2(F.concat_ws("|", "chain", F.col("day").cast("string"), F.col("n").cast("string"), F.coalesce("was", F.lit(0)).cast("string")), 256)
    return k.select("chain", "day", "n", F.coalesce(F.col("n") != F.col("was"), F.lit(True)).alias("appended"), digest.alias("digest"))
