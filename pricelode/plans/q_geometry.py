"""Queries on layout geometry: boxes are made of the first four components of the embeddings, a label is a page."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pricelode.operators import geometry as g
from pricelode.operators import scan
from pricelode.plans.base import query, table

#: x0, y0 from components 1 and 2, size from 3 and 4, on a grid of whole numbers so that both engines agree.
BOXES_SQL = """boxes as materialized (select vec_id as id, label::bigint * 1000000 + vec_id // 500 as page, x0, y0, x0 + w as x1, y0 + h as y1 from (select vec_id, label, floor(embedding[1]::double * 1000) as x0, floor(embedding[2]::double * 1000) as y0,
  10 + floor(abs(embedding[3]::double) * 200) as w, 10 + floor(abs(embedding[4]::double) * 200) as h from embeddings))"""
GAP = "sqrt(pow(greatest(a.x0 - b.x1, b.x0 - a.x1, 0), 2) + pow(greatest(a.y0 - b.y1, b.y0 - a.y1, 0), 2))"
CENTRE = "sqrt(pow((a.x0 + a.x1 - b.x0 - b.x1) / 2, 2) + pow((a.y0 + a.y1 - b.y0 - b.y1) / 2, 2))"
BOTH = "(greatest(least(a.x1, b.x1) - greatest(a.x0, b.x0), 0) * greatest(least(a.y1, b.y1) - greatest(a.y0, b.y0), 0))"


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = lambda i: F.col("embedding")[i].cast("double")
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), (F.col("label").cast("long") * 1000000 + F.expr("vec_id div 500")).alias("page"), F.floor(e(0) * 1000).cast("double").alias("x0"), F.floor(e(1) * 1000).cast("double").alias("y0"), (10 + F.floor(F.abs(e(2)) * 200)).cast("double").alias("w"), (10 + F.floor(F.abs(e(3)) * 200)).cast("double").alias("h"))
    return rows.select("id", "page", "x0", "y0", (F.col("x0") + F.col("w")).alias("x1"), (F.col("y0") + F.col("h")).alias("y1"))


@query(f"with {BOXES_SQL} select a.id as a_id, b.id as b_id, round({GAP}, 6) as gap, round({BOTH} / ((a.x1 - a.x0) * (a.y1 - a.y0) + (b.x1 - b.x0) * (b.y1 - b.y0) - {BOTH}), 6) as iou from boxes a join boxes b on a.page = b.page and a.id < b.id where {GAP} <= 25")
def near_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = g.near_pairs(boxes(spark, sf_dir), 25.0)
    return pairs.select("a_id", "b_id", F.round(g.gap("a_", "b_"), 6).alias("gap"), F.round(g.iou("a_", "b_"), 6).alias("iou"))


@query(f"""with {BOXES_SQL}, p as (select a.id as price, b.id as title, {CENTRE} as d from boxes a join boxes b on a.page = b.page and a.id % 3 = 0 and b.id % 3 <> 0)
select price, title, round(d, 6) as distance, rn::int as place from (select *, row_number() over (partition by price order by d, title) as rn from p where d <= 400) where rn <= 3""")
def nearest_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three nearest titles of a price on its page, within 400."""
    b = boxes(spark, sf_dir)
    pairs = g.prefixed(b.filter("id % 3 = 0"), "a_").join(g.prefixed(b.filter("id % 3 <> 0"), "b_"), F.col("a_page") == F.col("b_page"))
    (ax, ay), (bx, by) = g.centre("a_"), g.centre("b_")
    near = pairs.select(F.col("a_id").alias("price"), F.col("b_id").alias("title"), F.sqrt(F.pow(ax - bx, F.lit(2)) + F.pow(ay - by, F.lit(2))).alias("d")).filter("d <= 400")
    rn = F.row_number().over(Window.partitionBy("price").orderBy("d", "title"))
    return near.withColumn("place", rn).filter("place <= 3").select("price", "title", F.round("d", 6).alias("distance"), "place")


@query(f"""with {BOXES_SQL}, p as (select a.id as card, b.id as mark from boxes a join boxes b on a.page = b.page and a.id % 2 = 0 and b.id % 2 = 1 where (b.x0 + b.x1) / 2 between a.x0 - 5 and a.x1 + 5 and (b.y0 + b.y1) / 2 between a.y0 - 5 and a.y1 + 5),
n as (select card, count(*) as marks, min(mark) as mark from p group by card)
select b.id as card, coalesce(marks, 0) as marks, case when marks = 1 then mark end as bound, case when marks = 1 then 'bound' else 'review' end as route from boxes b left join n on card = id where b.id % 2 = 0""")
def card_binding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A card is bound by the only mark whose centre it holds; none or several go to review."""
    b = boxes(spark, sf_dir)
    pairs = g.prefixed(b.filter("id % 2 = 0"), "a_").join(g.prefixed(b.filter("id % 2 = 1"), "b_"), F.col("a_page") == F.col("b_page")).filter(g.contains("a_", "b_", 5.0))
    n = pairs.groupBy(F.col("a_id").alias("card")).agg(F.count(F.lit(1)).alias("marks"), F.min("b_id").alias("mark"))
    rows = b.filter("id % 2 = 0").select(F.col("id").alias("card")).join(n, "card", "left")
    one = F.coalesce(F.col("marks") == 1, F.lit(False))
    return rows.select("card", F.coalesce("marks", F.lit(0)).cast("long").alias("marks"), F.when(one, F.col("mark")).alias("bound"), F.when(one, "bound").otherwise("review").alias("route"))


@query(f"""with {BOXES_SQL} select a.id from boxes a where a.id % 5 = 0 and not exists (select 1 from boxes b where b.id % 5 <> 0 and b.page = a.page and {CENTRE} <= 60)""")
def unowned_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = boxes(spark, sf_dir)
    a, o = g.prefixed(b.filter("id % 5 = 0"), "a_"), g.prefixed(b.filter("id % 5 <> 0"), "b_")
    (ax, ay), (bx, by) = g.centre("a_"), g.centre("b_")
    near = F.sqrt(F.pow(ax - bx, F.lit(2)) + F.pow(ay - by, F.lit(2))) <= 60
    return a.join(o, (F.col("a_page") == F.col("b_page")) & near, "left_anti").select(F.col("a_id").alias("id"))


@query(f"""with recursive {BOXES_SQL}, e as materialized (select a.id as a, b.id as b from boxes a join boxes b on a.page = b.page and a.id <> b.id where {GAP} <= 25),
r as (select id, id as root from boxes union select r.id, e.b from r join e on e.a = r.root) select id, min(root) as component from r group by id""")
def box_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = boxes(spark, sf_dir)
    return g.components(b, g.near_pairs(b, 25.0).select(F.col("a_id").alias("a"), F.col("b_id").alias("b")))


@query(f"""with {BOXES_SQL}, p as (select a.id as id, b.id as other, round(100 - {CENTRE} / 10, 3) as score from boxes a join boxes b on a.page = b.page and a.id % 3 = 0 and b.id % 3 = 1),
k as (select *, row_number() over (partition by id order by score desc, other) as rn, lead(score) over (partition by id order by score desc, other) as nxt from p)
select id, other, score, coalesce(score - nxt >= 2, true) as sure from k where rn = 1""")
def best_match_margin(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = boxes(spark, sf_dir)
    pairs = g.prefixed(b.filter("id % 3 = 0"), "a_").join(g.prefixed(b.filter("id % 3 = 1"), "b_"), F.col("a_page") == F.col("b_page"))
    (ax, ay), (bx, by) = g.centre("a_"), g.centre("b_")
    score = F.round(100 - F.sqrt(F.pow(ax - bx, F.lit(2)) + F.pow(ay - by, F.lit(2))) / 10, 3)
    rows = pairs.select(F.col("a_id").alias("id"), F.col("b_id").alias("other"), score.alias("score"))
    return g.best_match(rows, ["id"], "score", "other", 2.0).select("id", "other", "score", "sure")


@query(f"""with {BOXES_SQL}, c as (select page, avg((x0 + x1) / 2) as cx, avg((y0 + y1) / 2) as cy from boxes group by page)
select b.page, count(*) filter ((x0 + x1) / 2 < cx and (y0 + y1) / 2 < cy) as upper_left, count(*) filter ((x0 + x1) / 2 >= cx and (y0 + y1) / 2 < cy) as upper_right,
  count(*) filter ((x0 + x1) / 2 < cx and (y0 + y1) / 2 >= cy) as lower_left, count(*) filter ((x0 + x1) / 2 >= cx and (y0 + y1) / 2 >= cy) as lower_right, min(x0) as left_edge, max(y1) as bottom from boxes b join c on b.page = c.page group by b.page""")
def quadrants(spark: SparkSession, sf_dir: str) -> DataFrame:
    x, y = g.centre()
    rows = boxes(spark, sf_dir).withColumn("x", x).withColumn("y", y)
    w = Window.partitionBy("page")
    rows = rows.withColumn("left", F.col("x") < F.avg("x").over(w)).withColumn("up", F.col("y") < F.avg("y").over(w))
    left, up = F.col("left"), F.col("up")
    return rows.groupBy("page").agg(F.count_if(left & up).alias("upper_left"), F.count_if(~left & up).alias("upper_right"), F.count_if(left & ~up).alias("lower_left"), F.count_if(~left & ~up).alias("lower_right"), F.min("x0").alias("left_edge"), F.max("y1").alias("bottom"))


@query("""with p as (select a.vec_id as a, b.vec_id as b, list_transform(list_zip(a.embedding, b.embedding), lambda x: abs(x[1]::double - x[2]::double)) as d, list_transform(list_zip(a.embedding, b.embedding), lambda x: (x[1] > 0) <> (x[2] > 0)) as s
  from embeddings a join embeddings b on a.label = b.label and b.vec_id = a.vec_id + 10)
select a, b, len(list_filter(s, lambda x: x))::int as hamming, round(list_avg(d), 6) as mae, round(sqrt(list_avg(list_transform(d, lambda x: x * x))), 6) as rms, round(list_max(d), 6) as most from p""")
def vector_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "embeddings")
    a, b = v.select(F.col("vec_id").alias("a"), "label", F.col("embedding").alias("va")), v.select(F.col("vec_id").alias("b"), F.col("label").alias("l"), F.col("embedding").alias("vb"))
    pairs = a.join(b, (F.col("label") == F.col("l")) & (F.col("b") == F.col("a") + 10))
    d = F.zip_with("va", "vb", lambda x, y: F.abs(x.cast("double") - y.cast("double")))
    mean = lambda c: F.aggregate(c, F.lit(0.0), lambda s, x: s + x) / F.size(c)
    flips = F.size(F.filter(F.zip_with("va", "vb", lambda x, y: (x > 0) != (y > 0)), lambda x: x))
    rows = pairs.select("a", "b", flips.alias("hamming"), d.alias("d"))
    return rows.select("a", "b", "hamming", F.round(mean(F.col("d")), 6).alias("mae"), F.round(F.sqrt(mean(F.transform("d", lambda x: x * x))), 6).alias("rms"), F.round(F.array_max("d"), 6).alias("most"))


@query()
def page_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Minimum-cost assignment of prices to titles on each page."""
    b = boxes(spark, sf_dir)
    pairs = g.prefixed(b.filter("id % 4 = 0"), "a_").join(g.prefixed(b.filter("id % 4 = 1"), "b_"), F.col("a_page") == F.col("b_page"))
    (ax, ay), (bx, by) = g.centre("a_"), g.centre("b_")
    cost = F.sqrt(F.pow(ax - bx, F.lit(2)) + F.pow(ay - by, F.lit(2)))
    return g.assign(pairs.select(F.col("a_page").alias("page"), F.col("a_id").alias("price"), F.col("b_id").alias("title"), cost.alias("cost")), "page", "price", "title", "cost")


@query()
def near_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Assignment of prices to titles that are at most 40 away, at the least total distance of centres: by components of near boxes."""
    b = boxes(spark, sf_dir).filter("id % 4 < 2")
    met = g.near_pairs(b, 40.0).filter("a_id % 4 <> b_id % 4")
    (ax, ay), (bx, by) = g.centre("a_"), g.centre("b_")
    price = F.when(F.col("a_id") % 4 == 0, F.col("a_id")).otherwise(F.col("b_id"))
    costs = met.select(price.alias("price"), (F.col("a_id") + F.col("b_id") - price).alias("title"), F.sqrt(F.pow(ax - bx, F.lit(2)) + F.pow(ay - by, F.lit(2))).alias("cost"))
    return g.assign_near(costs, "price", "title", "cost").select("price", "title", F.round("cost", 6).alias("cost"))


@query(f"""with recursive {BOXES_SQL}, n as materialized (select *, (x1 - x0) * (y1 - y0) as area, row_number() over (partition by page order by (x1 - x0) * (y1 - y0) desc, id) as place from boxes),
r as (select page, place, [{{'id': id, 'x0': x0, 'y0': y0, 'x1': x1, 'y1': y1}}] as kept from n where place = 1
union all select n.page, n.place, case when len(list_filter(kept, lambda k: greatest(least(n.x1, k.x1) - greatest(n.x0, k.x0), 0) * greatest(least(n.y1, k.y1) - greatest(n.y0, k.y0), 0) / (n.area + (k.x1 - k.x0) * (k.y1 - k.y0) - greatest(least(n.x1, k.x1) - greatest(n.x0, k.x0), 0) * greatest(least(n.y1, k.y1) - greatest(n.y0, k.y0), 0)) >= 0.5)) > 0 then kept
  else list_append(kept, {{'id': n.id, 'x0': n.x0, 'y0': n.y0, 'x1': n.x1, 'y1': n.y1}}) end from r join n on n.page = r.page and n.place = r.place + 1)
select page, unnest(list_transform(arg_max(kept, place), lambda k: k.id)) as id from r group by page""")
def distinct_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Greedy spatial de-duplication by overlap, in order of size."""
    return g.greedy_distinct(boxes(spark, sf_dir).withColumn("rank", -g.area()), 0.5)


@query(f"""with {BOXES_SQL}, c as (select *, (y0 + y1) / 2 as cy from boxes), r as (select *, sum(fresh) over (partition by page order by cy, id) as row from (select *, case when cy - lag(cy) over (partition by page order by cy, id) <= 2.6 then 0 else 1 end as fresh from c)),
l as (select * exclude (fresh), case when x0 - max(x1) over (partition by page, row order by x0, id rows between unbounded preceding and 1 preceding) <= 8 then 0 else 1 end as fresh from r), n as (select *, sum(fresh) over (partition by page, row order by x0, id) as line from l)
select page, row::bigint as row, line::bigint as line, min(x0) as x0, min(y0) as y0, max(x1) as x1, max(y1) as y1, count(*) as words, median(y1 - y0) as height, string_agg(id::varchar, ' ' order by x0, id) as joined from n group by page, row, line""")
def word_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words joined to lines by gaps downwards and then across: bounds, median height, words from left to right."""
    words = scan.text_lines(boxes(spark, sf_dir), "page")
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("x0", "id"))), lambda s: s["id"].cast("string")), " ")
    bounds = [fold(c).alias(c) for c, fold in (("x0", F.min), ("y0", F.min), ("x1", F.max), ("y1", F.max))]
    return words.groupBy("page", "row", "line").agg(*bounds, F.count(F.lit(1)).alias("words"), F.median(F.col("y1") - F.col("y0")).alias("height"), joined.alias("joined"))


@query(f"""with {BOXES_SQL}, g as (select page, 'x' as axis, max(x1) over w as start, x0 as stop from boxes window w as (partition by page order by x0, id rows between unbounded preceding and 1 preceding) union all select page, 'y', max(y1) over w, y0 from boxes window w as (partition by page order by y0, id rows between unbounded preceding and 1 preceding)),
c as (select page, axis, (start + stop) / 2 as position from g where stop > start qualify row_number() over (partition by page order by start - stop, axis, start) = 1),
e as (select c.*, b.x0, b.y0, b.x1, b.y1, greatest(0.5, 0.02 * case when axis = 'x' then max(x1) over (partition by page) - min(x0) over (partition by page) else max(y1) over (partition by page) - min(y0) over (partition by page) end) as t from c join boxes b using (page)),
m as (select page, axis, position, t, case when axis = 'x' then (x0 + x1) / 2 else (y0 + y1) / 2 end as mid from e)
select page, axis, position, count(*) filter (mid < position - t) as before, count(*) filter (abs(mid - position) <= t) as near, count(*) filter (mid > position + t) as after from m group by all""")
def widest_cuts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The widest gap of each page that no box covers, and the boxes on both sides of it."""
    return scan.around_cut(boxes(spark, sf_dir), ["page"]).withColumnRenamed("at", "position")


def _regions_sql(least: float, rounds: int = 12) -> str:
    """Cuts on both axes in turn, so often that none is left."""
    text = f"with {BOXES_SQL}, r0 as (select *, '' as r from boxes)"
    for i in range(rounds):
        low, high = ("x0", "x1") if i % 2 == 0 else ("y0", "y1")
        text += f""", g{i} as (select *, case when {low} - max({high}) over (partition by page, r order by {low}, id rows between unbounded preceding and 1 preceding) >= {least} then 1 else 0 end as cut from r{i}),
r{i + 1} as materialized (select * exclude (cut, r), r || '.' || sum(cut) over (partition by page, r order by {low}, id) as r from g{i})"""
    return f"{text} select page, id, min(id) over (partition by page, r) as region from r{rounds}"


@query(_regions_sql(12.0))
def page_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions of each page by cuts at its gaps on both axes, again and again."""
    return scan.regions(boxes(spark, sf_dir).select("page", "id", "x0", "y0", "x1", "y1"), "page", 12.0).select("page", "id", "region")
