"""Queries on text blocks, their prices, cards and marks, on carried pages and on flyers checked against their details."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pricelode.functions import blocks as b
from pricelode.functions import text as x
from pricelode.operators import geometry as g
from pricelode.plans.base import query, table
from pricelode.plans.q_geometry import BOXES_SQL, GAP, boxes

BLOCK_SQL = """blocks as (select p_partkey, concat_ws(chr(10), case when p_partkey % 5 = 0 then p_brand || '-' end, case when p_partkey % 13 <> 0 then p_name end, case when p_partkey % 7 <> 0 then p_size * 10 || ' g Dose' end,
  case when p_partkey % 3 = 0 then 'UVP ' || ((100 + p_partkey * 37 % 900 + (p_partkey % 5 - 1) * 50) // 100) || ',' || lpad(((100 + p_partkey * 37 % 900 + (p_partkey % 5 - 1) * 50) % 100)::varchar, 2, '0') end,
  case when p_partkey % 11 <> 0 then ((100 + p_partkey * 37 % 900) // 100) || ',' || lpad(((100 + p_partkey * 37 % 900) % 100)::varchar, 2, '0') end,
  '(1 kg = 9,' || lpad((p_partkey % 100)::varchar, 2, '0') || ')', case when p_partkey % 4 = 0 then 'zzgl. Pfand 0,25' end) as text from part)"""
MONEY_SQL = "try_cast(replace(replace({0}, ',', ''), '.', '') as bigint)"


def _blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A block of text for each part: name, package and prices, some of them missing."""
    k = F.col("p_partkey")
    money = lambda c: F.concat((F.floor(c / 100)).cast("string"), F.lit(","), F.lpad((c % 100).cast("string"), 2, "0"))
    price = F.lit(100) + k * 37 % 900
    parts = [
        F.when(k % 5 == 0, F.concat("p_brand", F.lit("-"))),
        F.when(k % 13 != 0, F.col("p_name")),
        F.when(k % 7 != 0, F.concat((F.col("p_size") * 10).cast("string"), F.lit(" g Dose"))),
        F.when(k % 3 == 0, F.concat(F.lit("UVP "), money(price + (k % 5 - 1) * 50))),
        F.when(k % 11 != 0, money(price)),
        F.concat(F.lit("(1 kg = 9,"), F.lpad((k % 100).cast("string"), 2, "0"), F.lit(")")),
        F.when(k % 4 == 0, F.lit("zzgl. Pfand 0,25")),
    ]
    return table(spark, sf_dir, "part").select("p_partkey", F.concat_ws("\n", *parts).alias("text"))


@query(rf"""with {BLOCK_SQL}, l as (select *, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> '') as rows from blocks),
p as (select *, coalesce(list_position(list_transform(rows, lambda x: regexp_matches(x, '{b.AMOUNT}') and x[1:1] <> '('), true), 0) as pos, list_filter(rows, lambda x: regexp_full_match(x, '{b.MONEY}')) as alone from l),
f as (select p_partkey, nullif(list_reduce(rows[1:greatest(pos - 1, 0)], lambda n, x: case when n = '' then x when n[-1:] <> '-' then n || ' ' || x when regexp_matches(x, '^\p{{Ll}}') then n[:-2] || x else n || x end, ''), '') as name,
  case when pos > 0 then regexp_extract(rows[pos], '{b.AMOUNT}', 0) end as package, {MONEY_SQL.format("alone[-1]")} as price,
  list_max(list_transform(regexp_extract_all(array_to_string(list_filter(rows, lambda x: regexp_matches(x, '{b.REGULAR}')), ' '), '{b.MONEY}'), lambda x: {MONEY_SQL.format("x")})) as regular,
  {MONEY_SQL.format(f"regexp_extract(text, '{b.DEPOSIT} ({b.MONEY})', 1)")} as deposit, {MONEY_SQL.format(rf"regexp_extract(text, '{b.UNIT_PRICE}', 2)")} as unit_price, nullif(regexp_extract(text, '{b.UNIT_PRICE}', 1), '') as unit from p)
select *, case when package is null then 'no_package' when name is null then 'no_name' when price is null then 'no_price' when regular <= price then 'regular_not_above' else 'candidate' end as route from f""")
def block_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily-special candidates of the text lane: what a block says, or why it is none."""
    rows = _blocks(spark, sf_dir).withColumn("rows", b.lines(F.col("text")))
    rows = rows.withColumn("at", b.package_line(F.col("rows")))
    r, at, t = F.col("rows"), F.col("at"), F.col("text")
    unit, per = b.unit_price(t)
    out = rows.select("p_partkey", b.joined_name(r, at).alias("name"), b.package(r, at).alias("package"), b.primary_price(r).alias("price"), b.regular_price(r).alias("regular"), b.deposit(t).alias("deposit"), unit.alias("unit_price"), per.alias("unit"))
    route = F.when(F.col("package").isNull(), "no_package").when(F.col("name").isNull(), "no_name").when(F.col("price").isNull(), "no_price").when(F.col("regular") <= F.col("price"), "regular_not_above").otherwise("candidate")
    return out.withColumn("route", route)


def _ordered(pairs: DataFrame, first: str, second: str) -> DataFrame:
    """Pairs a, b with ``first`` true for a and ``second`` for b, out of pairs that are kept one way only."""
    turned = pairs.select(*(F.col(("b_" if c[0] == "a" else "a_") + c[2:]).alias(c) for c in pairs.columns))
    return pairs.unionByName(turned).filter(first).filter(second)


@query(f"""with {BOXES_SQL}, p as (select a.id as price, b.id as other, b.id % 4 as kind, {GAP} as gap, b.x0 - a.x1 as beside, least(a.y1, b.y1) - greatest(a.y0, b.y0) as shared from boxes a join boxes b on a.page = b.page and a.id % 4 = 0 and b.id <> a.id where {GAP} <= 125),
n as (select price, min(struct_pack(gap := round(gap, 6), id := other)) filter (kind = 1) as product, count(*) filter (kind = 2) as confirmations, min(struct_pack(beside := beside, id := other)) filter (kind = 0 and beside between -5 and 80 and shared >= 5) as companion from p group by price)
select b.id as price, product.id as product, product.gap as gap, coalesce(confirmations, 0) as confirmations, companion.id as companion,
  case when product is null then 'no_product' when coalesce(confirmations, 0) = 0 then 'unconfirmed' else 'bound' end as route from boxes b left join n on n.price = b.id where b.id % 4 = 0""")
def block_price_binding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A price block's nearest product block, the blocks that confirm it, and the price tile on its right."""
    rows = boxes(spark, sf_dir)
    pairs = _ordered(g.near_pairs(rows, 125.0), "a_id % 4 = 0", "b_id <> a_id")
    kind, beside = F.col("b_id") % 4, F.col("b_x0") - F.col("a_x1")
    shared = F.least("a_y1", "b_y1") - F.greatest("a_y0", "b_y0")
    n = pairs.groupBy(F.col("a_id").alias("price")).agg(
        F.min(F.when(kind == 1, F.struct(F.round(g.gap("a_", "b_"), 6).alias("gap"), F.col("b_id").alias("id")))).alias("product"),
        F.count_if(kind == 2).alias("confirmations"),
        F.min(F.when((kind == 0) & beside.between(-5, 80) & (shared >= 5), F.struct(beside.alias("beside"), F.col("b_id").alias("id")))).alias("companion"),
    )
    out = rows.filter("id % 4 = 0").select(F.col("id").alias("price")).join(n, "price", "left")
    seen = F.coalesce("confirmations", F.lit(0)).cast("long")
    route = F.when(F.col("product").isNull(), "no_product").when(seen == 0, "unconfirmed").otherwise("bound")
    return out.select("price", F.col("product.id").alias("product"), F.col("product.gap").alias("gap"), seen.alias("confirmations"), F.col("companion.id").alias("companion"), route.alias("route"))


# Weights of prices inside and near an official box and of the title; least margins over the runner-up.
INSIDE, NEAR, TITLE = 8.0, 3.0, 5.0
MARGIN_INSIDE, MARGIN_TITLE, SURE_TITLE = 0.75, 1.0, 0.92
AROUND_X, AROUND_Y = 70, 110
IN_CARD = "(p.x0 + p.x1) / 2 between c.x0 - 40 and c.x1 + 40 and (p.y0 + p.y1) / 2 between c.y0 - 40 and c.y1 + 40"


@query(f"""with {BOXES_SQL}, names as (select p_partkey, list_distinct(list_filter(string_split(trim(regexp_replace(replace(lower(p_name), 'ß', 'ss'), '[^\\p{{L}}\\p{{N}}%]+', ' ', 'g')), ' '), lambda w: length(w) >= 3)) as words from part),
prices as (select c.id as card, (p.x0 + p.x1) / 2 as x, (p.y0 + p.y1) / 2 as y, c.page from boxes c join boxes p on c.page = p.page and c.id % 5 = 0 and p.id % 5 in (1, 2) where {IN_CARD}),
hits as (select card, o.id as official, count(*) filter (x between o.x0 and o.x1 and y between o.y0 and o.y1) as inside, count(*) as around from prices p join boxes o on p.page = o.page and o.id % 5 = 3 where x between o.x0 - {AROUND_X} and o.x1 + {AROUND_X} and y between o.y0 - {AROUND_Y} and o.y1 + {AROUND_Y} group by all),
alike as (select c.id as card, o.id as official, a.words as w, b.words as v from boxes c join boxes o on c.page = o.page and c.id % 5 = 0 and o.id % 5 = 3 join names a on a.p_partkey = c.id % 200 + 1 join names b on b.p_partkey = o.id // 2 % 200 + 1),
s as (select card, official, coalesce(inside, 0) as inside, coalesce(around - inside, 0) as near, case when len(w) + len(v) > 0 then round(len(list_intersect(w, v)) / len(list_distinct(list_concat(w, v))), 4) else 0 end as similarity from alike left join hits using (card, official)),
r as (select *, inside * {INSIDE} + near * {NEAR} + similarity * {TITLE} as score from s),
k as (select *, row_number() over w as rn, score - lead(score) over w as margin from r window w as (partition by card order by score desc, official))
select card, official, inside, near, similarity, round(score, 4) as score, round(coalesce(margin, 999), 4) as margin, (inside > 0 and coalesce(margin, 999) >= {MARGIN_INSIDE}) or (similarity >= {SURE_TITLE} and coalesce(margin, 999) >= {MARGIN_TITLE}) as bound from k where rn = 1""")
def official_binding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A card's best official product box by its prices inside and near it and by its title; bound by a clear margin only."""
    rows = boxes(spark, sf_dir)
    names = table(spark, sf_dir, "part").select("p_partkey", x.tokens(F.col("p_name")).alias("words"))
    cards, official = g.prefixed(rows.filter("id % 5 = 0"), "c_"), g.prefixed(rows.filter("id % 5 = 3"), "o_")
    prices = g.prefixed(rows.filter("id % 5 in (1, 2)"), "p_")
    px, py = g.centre("p_")
    held = cards.join(prices, F.col("c_page") == F.col("p_page")).filter(g.contains("c_", "p_", 40.0)).select("c_id", "c_page", px.alias("x"), py.alias("y"))
    at = lambda dx, dy: F.col("x").between(F.col("o_x0") - dx, F.col("o_x1") + dx) & F.col("y").between(F.col("o_y0") - dy, F.col("o_y1") + dy)
    hits = held.join(official, F.col("c_page") == F.col("o_page")).filter(at(AROUND_X, AROUND_Y)).groupBy("c_id", "o_id").agg(F.count_if(at(0, 0)).alias("inside"), F.count(F.lit(1)).alias("around"))
    alike = cards.select("c_id", "c_page").join(official.select("o_id", "o_page"), F.col("c_page") == F.col("o_page")).drop("c_page", "o_page")
    alike = alike.join(names.select(F.col("p_partkey").alias("ck"), F.col("words").alias("w")), F.col("c_id") % 200 + 1 == F.col("ck"))
    alike = alike.join(names.select(F.col("p_partkey").alias("ok"), F.col("words").alias("v")), F.expr("o_id div 2 % 200 + 1") == F.col("ok"))
    none = F.lit(0).cast("long")
    s = alike.join(hits, ["c_id", "o_id"], "left").select("c_id", "o_id", F.coalesce("inside", none).alias("inside"), F.coalesce(F.col("around") - F.col("inside"), none).alias("near"), x.jaccard(F.col("w"), F.col("v")).alias("similarity"))
    s = s.withColumn("score", F.col("inside") * INSIDE + F.col("near") * NEAR + F.col("similarity") * TITLE)
    w = Window.partitionBy("c_id").orderBy(F.desc("score"), "o_id")
    k = s.withColumn("margin", F.coalesce(F.col("score") - F.lead("score").over(w), F.lit(999.0))).withColumn("rn", F.row_number().over(w)).filter("rn = 1")
    sure = ((F.col("inside") > 0) & (F.col("margin") >= MARGIN_INSIDE)) | ((F.col("similarity") >= SURE_TITLE) & (F.col("margin") >= MARGIN_TITLE))
    return k.select(F.col("c_id").alias("card"), F.col("o_id").alias("official"), "inside", "near", "similarity", F.round("score", 4).alias("score"), F.round("margin", 4).alias("margin"), sure.alias("bound"))


ROLE_SQL = "case b.id % 3 when 0 then 'member' when 1 then 'normal' else 'other' end"
AREA_A, AREA_B = "(a.x1 - a.x0) * (a.y1 - a.y0)", "(b.x1 - b.x0) * (b.y1 - b.y0)"
#: Largest area of a badge against its anchor's, and up to which areas count as equal.
BADGE_RATIO, BADGE_TIE = 12, 1.25


@query(f"""with {BOXES_SQL}, near as (select a.id as anchor, b.id as label, a.page, (a.x0 + a.x1) / 2 as ax, (a.y0 + a.y1) / 2 as ay, (b.x0 + b.x1) / 2 as qx, (b.y0 + b.y1) / 2 as qy from boxes a join boxes b on a.page = b.page and a.id % 4 = 0 and b.id % 4 = 1 where {GAP} <= 80),
cut as (select distinct anchor, label from near join boxes s on s.page = near.page and s.id % 4 = 2 and (s.x0 + s.x1) / 2 between least(ax, qx) and greatest(ax, qx) and (s.y0 + s.y1) / 2 between least(ay, qy) and greatest(ay, qy)),
free as (select n.anchor, count(*) as labels, count(*) filter (c.label is null) as open from near n left join cut c on c.anchor = n.anchor and c.label = n.label group by n.anchor),
rect as (select a.id as anchor, {ROLE_SQL} as role, {AREA_B} as size, min({AREA_B}) over (partition by a.id) as least from boxes a join boxes b on a.page = b.page and a.id % 4 = 0 and b.id % 4 = 3 and b.id % 10 >= 3
  where (a.x0 + a.x1) / 2 between b.x0 and b.x1 and (a.y0 + a.y1) / 2 between b.y0 and b.y1 and {AREA_B} <= {BADGE_RATIO} * {AREA_A}),
badge as (select anchor, case when bool_or(role = 'member') and bool_or(role = 'normal') then 'ambiguous' else min(role) end as badge from rect where size <= least * {BADGE_TIE} group by anchor)
select a.id as anchor, coalesce(labels, 0) as labels, coalesce(open, 0) > 0 as labelled, coalesce(badge, 'none') as badge from boxes a left join free on free.anchor = a.id left join badge on badge.anchor = a.id where a.id % 4 = 0""")
def anchor_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a price anchor has a label near it with no separator between, and what its badge (the smallest opaque box
    around its centre) says; a member and a normal one of about the same size are ambiguous."""
    rows = boxes(spark, sf_dir)
    near = _ordered(g.near_pairs(rows.filter("id % 4 in (0, 1)"), 80.0), "a_id % 4 = 0", "b_id % 4 = 1")
    (ax, ay), (bx, by) = g.centre("a_"), g.centre("b_")
    near = near.select(F.col("a_id").alias("anchor"), F.col("b_id").alias("label"), F.col("a_page").alias("page"), ax.alias("ax"), ay.alias("ay"), bx.alias("bx"), by.alias("by"))
    sep = g.prefixed(rows.filter("id % 4 = 2"), "s_")
    sx, sy = g.centre("s_")
    between = sx.between(F.least("ax", "bx"), F.greatest("ax", "bx")) & sy.between(F.least("ay", "by"), F.greatest("ay", "by"))
    cut = near.join(sep, F.col("page") == F.col("s_page")).filter(between).select("anchor", "label").distinct().withColumn("cut", F.lit(True))
    free = near.join(cut, ["anchor", "label"], "left").groupBy("anchor").agg(F.count(F.lit(1)).alias("labels"), F.count_if(F.col("cut").isNull()).alias("open"))
    anchors, rects = g.prefixed(rows.filter("id % 4 = 0"), "a_"), g.prefixed(rows.filter("id % 4 = 3 and id % 10 >= 3"), "b_")
    rect = anchors.join(rects, F.col("a_page") == F.col("b_page")).filter(g.contains("b_", "a_") & (g.area("b_") <= BADGE_RATIO * g.area("a_")))
    role = F.when(F.col("b_id") % 3 == 0, "member").when(F.col("b_id") % 3 == 1, "normal").otherwise("other")
    rect = rect.select(F.col("a_id").alias("anchor"), role.alias("role"), g.area("b_").alias("size")).withColumn("least", F.min("size").over(Window.partitionBy("anchor")))
    both = F.bool_or(F.col("role") == "member") & F.bool_or(F.col("role") == "normal")
    badge = rect.filter(F.col("size") <= F.col("least") * BADGE_TIE).groupBy("anchor").agg(F.when(both, "ambiguous").otherwise(F.min("role")).alias("badge"))
    out = anchors.select(F.col("a_id").alias("anchor")).join(free, "anchor", "left").join(badge, "anchor", "left")
    return out.select("anchor", F.coalesce("labels", F.lit(0)).cast("long").alias("labels"), (F.coalesce("open", F.lit(0)) > 0).alias("labelled"), F.coalesce("badge", F.lit("none")).alias("badge"))


ROUTES = [
    ("titles = 0", "no_title"), ("titles > 1", "ambiguous_title"), ("n = 0", "no_price"), ("n = 1 and marked = 0", "single"), ("n = 1", "member_without_base"),
    ("n = 2 and marked = 1 and member < base", "member_pair"), ("n = 2 and marked = 1", "member_not_below_base"), ("marked > 0", "ambiguous_member"), ("least = most", "repeated_price"),
]
ROUTES_SQL = "case " + " ".join(f"when {c} then '{r}'" for c, r in ROUTES) + " else 'several_prices' end"
PRICE_SQL = "50 + p.id * 37 % 500"


@query(f"""with {BOXES_SQL}, h as (select c.id as card, p.id % 4 as kind, p.id % 8 = 2 as mark, {PRICE_SQL} as price from boxes c join boxes p on c.page = p.page and c.id % 4 = 0 and p.id % 4 <> 0 where {IN_CARD}),
s as (select c.id as card, count(*) filter (kind = 1) as titles, count(*) filter (kind = 2) as n, count(*) filter (kind = 2 and mark) as marked, min(price) filter (kind = 2 and mark) as member, min(price) filter (kind = 2 and not mark) as base, min(price) filter (kind = 2) as least, max(price) filter (kind = 2) as most
  from boxes c left join h on h.card = c.id where c.id % 4 = 0 group by c.id), r as (select *, {ROUTES_SQL} as route from s)
select card, titles, n as prices, marked, route, case when route = 'member_pair' then base when route in ('single', 'repeated_price') then least end as price, case when route = 'member_pair' then member end as member_price from r""")
def card_semantics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a card's title, prices and member marks say together, or the reason why they say nothing sure."""
    rows = boxes(spark, sf_dir)
    cards, held = g.prefixed(rows.filter("id % 4 = 0"), "c_"), g.prefixed(rows.filter("id % 4 <> 0"), "p_")
    kind, mark, price = F.col("p_id") % 4, F.col("p_id") % 8 == 2, 50 + F.col("p_id") * 37 % 500
    h = cards.join(held, F.col("c_page") == F.col("p_page")).filter(g.contains("c_", "p_", 40.0)).groupBy(F.col("c_id").alias("card")).agg(
        F.count_if(kind == 1).alias("titles"), F.count_if(kind == 2).alias("n"), F.count_if((kind == 2) & mark).alias("marked"), F.min(F.when((kind == 2) & mark, price)).alias("member"),
        F.min(F.when((kind == 2) & ~mark, price)).alias("base"), F.min(F.when(kind == 2, price)).alias("least"), F.max(F.when(kind == 2, price)).alias("most"),
    )
    s = cards.select(F.col("c_id").alias("card")).join(h, "card", "left").fillna(0, ["titles", "n", "marked"]).withColumn("route", F.expr(ROUTES_SQL))
    own: Column = F.when(F.col("route") == "member_pair", F.col("base")).when(F.col("route").isin("single", "repeated_price"), F.col("least"))
    return s.select("card", "titles", F.col("n").alias("prices"), "marked", "route", own.alias("price"), F.when(F.col("route") == "member_pair", F.col("member")).alias("member_price"))


@query("""with v as (select p_partkey % 2 as side, p_partkey // 2 as place, sha256(p_name || (p_partkey // 2 % 3)) as sha from part),
same as (select o.place as old_page, n.place as new_page, o.sha from v o join v n on o.side = 0 and n.side = 1 and o.place = n.place and o.sha = n.sha),
o as (select place, sha from v where side = 0 and place not in (select old_page from same)), n as (select place, sha from v where side = 1 and place not in (select new_page from same)),
moved as (select min(o.place) as old_page, min(n.place) as new_page, sha from o join n using (sha) group by sha having count(*) = 1)
select old_page, new_page, sha, 'exact_same_position' as method from same union all select old_page, new_page, sha, 'exact_moved_page' from moved""")
def carried_mappings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of an old set carried to a new one: equal bytes at the same place, else the only one with equal bytes on both
    sides; so no page is used twice, and a changed page is never carried."""
    v = table(spark, sf_dir, "part").select((F.col("p_partkey") % 2).alias("side"), F.expr("p_partkey div 2").alias("place"), F.sha2(F.concat("p_name", F.expr("p_partkey div 2 % 3").cast("string")), 256).alias("sha"))
    sides = F.col("side") == 0
    at = v.groupBy("place").agg(F.max(F.when(sides, F.col("sha"))).alias("o"), F.max(F.when(~sides, F.col("sha"))).alias("n"))
    same = at.filter("o = n").select(F.col("place").alias("old_page"), F.col("place").alias("new_page"), F.col("o").alias("sha"), F.lit("exact_same_position").alias("method"))
    rest = at.filter("not (o <=> n)").select("place", F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col("o").alias("sha")), F.struct(F.lit(1).alias("side"), F.col("n").alias("sha")))).alias("s")).select("place", "s.*").filter("sha is not null")
    one = rest.groupBy("sha").agg(F.count_if(sides).alias("olds"), F.count_if(~sides).alias("news"), F.min(F.when(sides, F.col("place"))).alias("old_page"), F.min(F.when(~sides, F.col("place"))).alias("new_page"))
    return same.union(one.filter("olds = 1 and news = 1").select("old_page", "new_page", "sha", F.lit("exact_moved_page")))


FLYER_SQL = """flyers as (select o_custkey as store, o_orderkey as flyer, o_orderkey % 7 as region, o_orderdate::date as first, (o_orderdate::date + interval 6 day)::date as last,
  '{"flyer":{"regions":[{"code":"' || o_orderkey % 5 || '"},{"code":"' || o_orderkey % 3 || '"}],"offerStartDate":"' || strftime(o_orderdate::date, '%Y-%m-%d') || '","offerEndDate":"' || strftime((o_orderdate::date + interval (case when o_orderkey % 6 = 0 then 7 else 6 end) day)::date, '%Y-%m-%d') || '","pdfUrl":"' || case when o_orderkey % 8 = 0 then 'http' else 'https' end || '://flyers.example/' || o_orderkey || '.pdf"}}' as payload from orders)"""
#: The day flyers are looked for.
TODAY = "1996-06-01"


@query(f"""with {FLYER_SQL}, k as (select *, case when last < date '{TODAY}' then null when first <= date '{TODAY}' then 'current' else 'next' end as target from flyers),
t as (select *, row_number() over (partition by store, target order by case when target = 'current' then last end, first, flyer) as rn from k where target is not null),
d as (select *, list_contains(json_extract_string(payload, '$.flyer.regions[*].code'), region::varchar) as told, json_extract_string(payload, '$.flyer.offerStartDate') as a, json_extract_string(payload, '$.flyer.offerEndDate') as z, json_extract_string(payload, '$.flyer.pdfUrl') as pdf from t where rn = 1)
select store, target, flyer, pdf, case when not told then 'region_not_advertised' when a <> strftime(first, '%Y-%m-%d') or z <> strftime(last, '%Y-%m-%d') then 'validity_mismatch' when not regexp_matches(pdf, '^https://[^/]+/') then 'no_https_pdf' else 'accepted' end as status from d""")
def flyer_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A store's current and next flyer, checked against the detail its source gives: region, window, and an HTTPS file."""
    k, day = F.col("flyer"), F.lit(TODAY).cast("date")
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("store"), F.col("o_orderkey").alias("flyer"), F.col("o_orderdate").cast("date").alias("first"))
    rows = rows.withColumns({"region": (k % 7).cast("string"), "last": F.date_add("first", 6)})
    target = F.when(F.col("last") < day, F.lit(None)).when(F.col("first") <= day, "current").otherwise("next")
    order = Window.partitionBy("store", "target").orderBy(F.when(F.col("target") == "current", F.col("last")), "first", "flyer")
    chosen = rows.withColumn("target", target).filter("target is not null").withColumn("rn", F.row_number().over(order)).filter("rn = 1")
    code = lambda m: F.struct((k % m).cast("string").alias("code"))
    url = F.concat(F.when(k % 8 == 0, "http").otherwise("https"), F.lit("://flyers.example/"), k.cast("string"), F.lit(".pdf"))
    detail = F.struct(F.array(code(5), code(3)).alias("regions"), F.col("first").cast("string").alias("offerStartDate"), F.date_add("first", F.when(k % 6 == 0, 7).otherwise(6)).cast("string").alias("offerEndDate"), url.alias("pdfUrl"))
    read = F.from_json(F.to_json(F.struct(detail.alias("flyer"))), "flyer struct<regions: array<struct<code: string>>, offerStartDate: string, offerEndDate: string, pdfUrl: string>")
    d = chosen.withColumn("d", read.getField("flyer"))
    off = (F.col("d.offerStartDate") != F.col("first").cast("string")) | (F.col("d.offerEndDate") != F.col("last").cast("string"))
    told = F.array_contains(F.col("d.regions.code"), F.col("region"))
    status = F.when(~told, "region_not_advertised").when(off, "validity_mismatch").when(~F.col("d.pdfUrl").rlike("^https://[^/]+/"), "no_https_pdf").otherwise("accepted")
    return d.select("store", "target", "flyer", F.col("d.pdfUrl").alias("pdf"), status.alias("status"))
