"""Queries on labels, brands, money and rule checks of offers, and on orders and replays of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pricelode.functions import labels as b
from pricelode.functions import text as x
from pricelode.operators import ranking
from pricelode.plans.base import query, table
from pricelode.plans.q_text import NORM
from pricelode.shared import written
from pricelode.sources.observations import observations

CHARS = "regexp_replace(lower(coalesce({0}, '')), '[^\\p{{L}}]+', ' ', 'g')"


@query(f"""select p_partkey, p_name || '  No. ' || p_size || ' Größe' as raw, regexp_replace(replace(lower(p_name || '  No. ' || p_size || ' Größe'), 'ß', 'ss'), '[^\\p{{L}}\\p{{N}}]+', '', 'g') as compact,
trim({CHARS.format("p_name || '  No. ' || p_size || ' Größe'")}) as words, trim(regexp_replace(p_name || '  No. ' || p_size || ' Größe', '\\s+', ' ', 'g')) as blanks, lower(p_name || '  No. ' || p_size || ' Größe') as search,
trim(regexp_replace(replace(lower(p_name || '  No. ' || p_size || ' Größe'), 'ß', 'ss'), '[^\\p{{L}}\\p{{N}}%]+', ' ', 'g')) as normal from part""")
def text_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five forms a text is compared in."""
    raw = F.concat("p_name", F.lit("  No. "), F.col("p_size").cast("string"), F.lit(" Größe"))
    r = F.col("raw")
    rows = table(spark, sf_dir, "part").select("p_partkey", raw.alias("raw"))
    return rows.select("p_partkey", "raw", b.compact(r).alias("compact"), b.words_only(r).alias("words"), b.one_blank(r).alias("blanks"), b.search_text(r).alias("search"), b.normalized(r).alias("normal"))


TOKENS = "list_distinct(list_filter(string_split({0}, ' '), lambda w: length(w) >= 3))"


@query(f"""with t as (select a.p_partkey, a.p_name as name, case a.p_partkey % 4 when 0 then replace(a.p_name, ' ', '') when 1 then split_part(a.p_name, ' ', 1) when 2 then b.p_name else upper(a.p_name) || ' XL' end as other from part a left join part b on b.p_partkey = a.p_partkey - 1),
n as (select p_partkey, {NORM.format("name")} as n, {NORM.format("other")} as m from t),
c as (select *, regexp_replace(n, '[ %]', '', 'g') as x, regexp_replace(m, '[ %]', '', 'g') as y, {TOKENS.format("n")} as a, {TOKENS.format("m")} as b, list_distinct(string_split(n, ' ')) as words from n),
r as (select *, case when len(a) + len(b) = 0 then 0.0 else round(len(list_intersect(a, b)) / (len(a) + len(b) - len(list_intersect(a, b)))::double, 4) end::double as ratio from c)
select p_partkey, case when x <> '' and y <> '' and (contains(x, y) or contains(y, x)) then 1.0 when x <> '' and y <> '' and (contains(' ' || n || ' ', ' ' || m || ' ') or contains(' ' || m || ' ', ' ' || n || ' ')) then greatest(ratio, 0.9) else ratio end::double as similarity,
  n <> '' and (contains(m, n) or len(list_intersect(words, string_split(m, ' '))) >= len(words) * 0.6) as echo from r""")
def contained_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Similarity by words with a floor for names that hold each other, and whether a name is read again in a text: of a name
    with itself in other forms, and with the part before it."""
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_name")
    before = parts.select((F.col("p_partkey") + 1).alias("p_partkey"), F.col("p_name").alias("before"))
    k, name = F.col("p_partkey") % 4, F.col("p_name")
    other = F.when(k == 0, F.replace(name, F.lit(" "), F.lit(""))).when(k == 1, F.split(name, " ")[0]).when(k == 2, F.col("before")).otherwise(F.concat(F.upper(name), F.lit(" XL")))
    rows = parts.join(before, "p_partkey", "left").select("p_partkey", "p_name", other.alias("other"))
    ratio = x.jaccard(x.tokens(F.col("p_name")), x.tokens(F.col("other")))
    return rows.select("p_partkey", b.contained(F.col("p_name"), F.col("other"), ratio).alias("similarity"), b.echoes(F.col("other"), F.col("p_name")).alias("echo"))


@query(f"""with t as (select id, brand, case when id % 2 = 0 then coalesce(brand, 'None') || ' ' || name when id % 7 = 1 then brand else name end as whole, case id % 3 when 0 then upper(name) when 1 then upper(name) || ' aus der region' else name end as shown,
  name || case id % 5 when 0 then '®  und' when 1 then '™ groß' when 2 then ' ' || chr(9) || 'FÜR' when 3 then ' ohne' else ' mit je' end as label from obs),
n as (select *, {NORM.format("whole")} as n, nullif({NORM.format("brand")}, '') as b, trim(regexp_replace(regexp_replace(label, '[®™©]', '', 'g'), '\\s+', ' ', 'g')) as bare,
  len(regexp_extract_all(shown, '\\p{{L}}')) as letters, len(regexp_extract_all(shown, '\\p{{Lu}}')) as capitals from t)
select id, b as brand, case when starts_with(n, b || ' ') and trim(substr(n, length(b) + 1)) <> '' then trim(substr(n, length(b) + 1)) else n end as rest,
  letters > 0 and capitals >= letters * 0.75 as brandlike, trim(regexp_replace(bare, '(?i) ({'|'.join(b.GLUE_WORDS)})$', '')) as label from n""")
def brand_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Brands normalised and taken off names; names in capitals; labels without signs and trailing glue words."""
    i, name = F.col("id"), F.col("name")
    whole = F.when(i % 2 == 0, F.concat(F.coalesce("brand", F.lit("None")), F.lit(" "), name)).when(i % 7 == 1, F.col("brand")).otherwise(name)
    shown = F.when(i % 3 == 0, F.upper(name)).when(i % 3 == 1, F.concat(F.upper(name), F.lit(" aus der region"))).otherwise(name)
    ends = F.element_at(F.array(*map(F.lit, ("®  und", "™ groß", " \tFÜR", " ohne", " mit je"))), (i % 5 + 1).cast("int"))
    rows = observations(spark, sf_dir).select("id", "brand", whole.alias("whole"), shown.alias("shown"), F.concat(name, ends).alias("label"))
    return rows.select("id", b.brand(F.col("brand")).alias("brand"), b.without_brand(F.col("whole"), F.col("brand")).alias("rest"), b.brandlike(F.col("shown")).alias("brandlike"), b.clean_label(F.col("label")).alias("label"))


AMOUNTS = """case id % 7 when 0 then '_70Prz_' || n || 'g_' || id when 1 then '_3_7_' || (id % 8 + 2) || 'x' || n || 'g_' || id || '003' when 2 then '_' || (id % 30 + 2) || 'x0_' || n || 'l' when 3 then '-' || n || '-ML' when 4 then '_Nr_' || n
  when 5 then '_' || n || 'g_' || (n::int + 5) || 'cl.v2' else '_x' || n || 'gr' end"""
SAID = """case id % 6 when 0 then 'je ' || n || ' g (1 kg = 9,90)' when 1 then n || ' g, auch als <b>' || n || '–g</b>' when 2 then n || ' g oder ' || (n::int + 1) || ' g' when 3 then 'lose'
  when 4 then '6 x 0,' || n || ' l Flasche, 1 l = 1,11' else '2x' || n || ' ml und ' || n || ' g' end"""
FACTORS = "{0} * case {1} when 'kg' then 1000 when 'l' then 1000 when 'cl' then 10 when 'mg' then 0.001 else 1 end"


@query(f"""with t as (select id, (id % 90 + 10)::varchar as n, cents from obs), u as (select id, lower('Item_' || cents || {AMOUNTS}) as stem, {SAID} as said from t),
s as (select id, stem, regexp_extract(stem, '(?:^|[^a-z0-9])([0-9]{{1,3}})x([0-9]+(?:[.,_][0-9]+)?)[-_]?(kg|mg|ml|cl|g|l)(?:[_.-]|$)', ['n', 'q', 'u']) as m, regexp_extract('_' || stem, '^.*[^a-z0-9]([0-9]+)[-_]?(kg|mg|ml|cl|g|l)(?:[_.-]|$)', ['q', 'u']) as x,
  regexp_replace(regexp_replace(regexp_replace(lower(said), '<[^>]+>', ' ', 'g'), '\\([^)]*1 *(kg|l) *=[^)]*\\)', ' ', 'g'), '[,;]? *1 *(kg|l) *=.*$', ' ', 'g') as d from u),
a as (select *, list_distinct(regexp_extract_all(d, '[0-9]+ ?x ?[0-9,.]+ ?[-–—]? ?(?:kg|mg|ml|cl|g|l)\\b')) as multi, list_distinct(list_transform(regexp_extract_all(d, '[0-9][0-9,.]* ?[-–—]? ?(?:kg|mg|ml|cl|g|l)\\b'), lambda y: regexp_replace(y, ' ?[-–—]? ?([a-z])', '\\1'))) as single from s),
p as (select id, case when m.n <> '' then round({FACTORS.format("try_cast(replace(replace(m.q, '_', '.'), ',', '.') as double)", "m.u")}, 4) when x.q <> '' then round({FACTORS.format("try_cast(x.q as double)", "x.u")}, 4) end as quantity,
  case when m.n <> '' then case when m.u in ('kg', 'g', 'mg') then 'g' else 'ml' end when x.q <> '' then case when x.u in ('kg', 'g', 'mg') then 'g' else 'ml' end end as unit, case when m.n <> '' then try_cast(m.n as int) when x.q <> '' then 1 end as pack,
  case when len(multi) = 1 then multi[1] when len(multi) = 0 and len(single) = 1 then single[1] end as told from a),
q as (select *, regexp_extract(told, '^(?:([0-9]+) ?x ?)?([0-9][0-9,.]*) ?[-–—]? ?(kg|mg|ml|cl|g|l)$', ['n', 'q', 'u']) as w from p)
select id, quantity, unit, pack, case when told is not null then round({FACTORS.format("try_cast(replace(w.q, ',', '.') as double)", "w.u")}, 4) end as said_quantity, case when told is not null then case when w.u in ('kg', 'g', 'mg') then 'g' else 'ml' end end as said_unit,
  case when told is not null then coalesce(try_cast(w.n as int), 1) end as said_pack from q""")
def image_packages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packages from image file names, and from a description where all it says is the same."""
    as_spark = lambda e: F.expr(e.replace("n::int", "cast(n as int)"))
    rows = observations(spark, sf_dir).select("id", "cents", (F.col("id") % 90 + 10).cast("string").alias("n"))
    url = F.concat(F.lit("https://img.example/250g/a%20b/Item_"), F.col("cents").cast("string"), as_spark(AMOUNTS), F.lit(".png?w=500ml"))
    rows = rows.select("id", x.image_package(url).alias("p"), x.described_package(as_spark(SAID)).alias("d"))
    return rows.select("id", "p.quantity", "p.unit", "p.pack", F.col("d.quantity").alias("said_quantity"), F.col("d.unit").alias("said_unit"), F.col("d.pack").alias("said_pack"))


LINES = ["Versandkosten 4,99", "24 Monate Laufzeit", "Monat 9,99", "1 kg = 3,99", "statt 5,99", "inkl. {} Pfand", "Packung: {}", "6 x {}", "je {} g", "je {} g nur € {}", "Karate-Anzug {}", "Apparate {}", "Monatsangebot {}", "UVP {}", "nur heute {}", "{} kg=1,00"]
LINE_SQL = "replace([{}][id % {} + 1], '{{}}', (cents // 100) || ',' || lpad((cents % 100)::varchar, 2, '0'))".format(", ".join(f"'{x}'" for x in LINES), len(LINES))
#: The contexts in the other engine's pattern language, which has no look-around: the characters on both sides are matched.
CONTEXT_SQL = r"""case when regexp_matches({0}, '(^|[^\p{{L}}\p{{N}}_])(versand|versandkosten|versandkostenpauschale|porto|lieferkosten|lieferung|zzgl\.?\s+liefer)($|[^\p{{L}}\p{{N}}_])') then 'shipping'
  when regexp_matches({0}, '(^|[^\p{{L}}\p{{N}}_])(ratenzahlung|monat|laufzeit|gesamtpreis)($|[^\p{{L}}\p{{N}}_])') then 'installment'
  when regexp_matches({0}, '(^|[^\p{{L}}\p{{N}}_])(grundpreis|1\s*(kg|l|ltr|liter)|100\s*(g|ml))($|[^\p{{L}}\p{{N}}_])') or regexp_matches({0}, '(^|[^\p{{L}}\p{{N}}_])(kg|l)\s*=') then 'unit'
  when regexp_matches({0}, '(^|[^\p{{L}}\p{{N}}_])(normalpreis|uvp|statt|vorher|regulär)($|[^\p{{L}}\p{{N}}_])') then 'reference' {1} else 'sale' end"""
REFINED = r"""when regexp_extract(l, '([0-9]{1,4}([,.][0-9]{1,2})?)\s*(€|eur)?\s*pfand($|[^\p{L}\p{N}_])', 1) = t then 'deposit'
  when not contains(l, '€') and (regexp_extract(l, '([0-9]{1,4}([,.][0-9]{1,3})?)\s*(kg|g|l|ltr|liter|ml|cl)($|[^\p{L}\p{N}_])', 1) = t or regexp_extract(l, '[0-9]{1,3}\s*[x×]\s*([0-9]{1,4}([,.][0-9]{1,3})?)', 1) = t or regexp_extract(l, '(gebinde|standardpackung|packung)\s*:?\s*([0-9]{1,4}([,.][0-9]{1,3})?)', 2) = t) then 'package'"""


@query(f"""with z as (select *, lower({LINE_SQL}) as l, (cents // 100) || ',' || lpad((cents % 100)::varchar, 2, '0') as t from obs)
select id, {CONTEXT_SQL.format("l", REFINED)} as context,
  case when id % 4 in (0, 1) then cents end as money, case when id % 6 < 2 then valid_from end as day, case when id % 2 = 0 then 2 + id % 5 end::int as pieces, case when id % 2 = 0 then cents % 100000 end as bundle_cents from z""")
def price_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Context of a price by its line's words and its own number, money in canonical form, days written in two ways, and "N für P" bundles."""
    i, c = F.col("id"), F.col("cents")
    whole, rest = F.expr("cents div 100").cast("string"), F.lpad((c % 100).cast("string"), 2, "0")
    token = F.concat(whole, F.lit(","), rest)
    line = F.replace(F.element_at(F.array(*(F.lit(x) for x in LINES)), (i % len(LINES) + 1).cast("int")), F.lit("{}"), token)
    money = F.when(i % 4 < 2, F.concat(whole, F.lit("."), rest)).when(i % 4 == 2, F.concat(F.lit("0"), whole, F.lit("."), rest)).otherwise(F.concat(whole, F.lit(",5")))
    seconds = F.unix_timestamp(F.col("valid_from").cast("timestamp")).cast("string")
    day = F.when(i % 6 == 0, F.col("valid_from").cast("string")).when(i % 6 == 1, seconds).otherwise("soon")
    said = F.when(i % 2 == 0, F.concat((i % 5 + 2).cast("string"), F.lit(" für "), F.expr("cents % 100000 div 100").cast("string"), F.lit(","), rest)).otherwise("einzeln")
    rows = observations(spark, sf_dir).select("id", line.alias("line"), token.alias("token"), money.alias("money"), day.alias("day"), b.bundle(said).alias("bundle"))
    return rows.select("id", b.price_context(F.col("line"), F.col("token")).alias("context"), b.canonical_cents(F.col("money")).alias("money"), b.day_of(F.col("day")).alias("day"), F.col("bundle.count").alias("pieces"), F.col("bundle.cents").alias("bundle_cents"))


@query(f"""with l as (select doc_id, lower(unnest(string_split(text, chr(10)))) as l from documents), c as (select doc_id, {CONTEXT_SQL.format("l", "")} as context from l where regexp_matches(l, '[0-9]'))
select doc_id, context, count(*) as n_lines from c group by all""")
def document_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many lines with a number of each document are of each context."""
    lines = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("line")).filter(F.col("line").rlike("[0-9]"))
    return lines.groupBy("doc_id", b.price_context(F.col("line")).alias("context")).agg(F.count(F.lit(1)).alias("n_lines"))


@query("""select l_orderkey, l_linenumber, l_partkey, round(l_extendedprice * 100)::bigint as price, 1 + l_partkey % 900 as unit, case when l_quantity > 3 and l_partkey % 5 <> 0 then (round(l_extendedprice * 100)::bigint * 2000 + 1 + l_partkey % 900) // (2 * (1 + l_partkey % 900)) end as grams,
  l_quantity > 3 and l_partkey % 5 <> 0 and l_linenumber < 6 as accepted from lineitem""")
def variable_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weight in grams from price and unit price, half up, where there is one unit price; accepted with a context and without a package."""
    prices = F.when(F.col("l_quantity") > 3, F.array(F.col("unit"), F.when(F.col("l_partkey") % 5 == 0, F.col("unit") + 1))).otherwise(F.array().cast("array<bigint>"))
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", F.round(F.col("l_extendedprice") * 100).cast("long").alias("price"), (F.col("l_partkey") % 900 + 1).cast("long").alias("unit"))
    one = rows.withColumn("one", b.only_one(prices))
    grams = F.expr("(price * 2000 + one) div (2 * one)")
    return one.select("l_orderkey", "l_linenumber", "l_partkey", "price", "unit", grams.alias("grams"), (F.col("one").isNotNull() & (F.col("l_linenumber") < 6)).alias("accepted"))


#: Price objects and banners as text, in words that both engines read: flat, nested, without units, none, broken.
BODY = """case id % 5 when 0 then '{"price": {"cents": ' || cents || ', "units": [{"kind": "base", "cents": ' || cents * 2 || '}]}}' when 1 then '{"price": {"current": {"cents": ' || (cents + 1) || '}, "units": [{"kind": "other", "cents": ' || cents || '}, {"kind": "base", "cents": ' || cents * 3 || '}]}}'
  when 2 then '{"price": {"cents": ' || cents || ', "current": {"cents": 1}}}' when 3 then '{"price": null}' else '{"price": {"units": [{"kind": "base"}]}}' end"""


@query(f"""with t as (select id, ({BODY})::json as v, {NORM.format("case id % 3 when 0 then '  Nur am ' || upper(strftime(day, '%a')) || '! ' when 1 then 'Am ' || ['Sonntag', 'MONTAG', 'dienstag', 'Mittwoch', 'Donnerstag', 'Freitag', 'Samstag'][dayofweek(day) + 1] || ' –' else name end")} as banner from obs)
select id, coalesce(try_cast(v->>'$.price.cents' as bigint), try_cast(v->>'$.price.current.cents' as bigint)) as price,
  try_cast(list_filter(coalesce(cast(v->'$.price.units' as json[]), []), lambda u: u->>'$.kind' = 'base')[1]->>'$.cents' as bigint) as unit_price,
  case when list_contains([{', '.join(f"'{d}'" for d in b.WEEKDAYS)}], string_split(banner, ' ')[-1]) then string_split(banner, ' ')[-1] || '_special' end as special from t""")
def nested_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regular and unit price of a nested price object in its forms, and the kind of special of a banner that ends in a weekday."""
    i, day = F.col("id"), F.col("day")
    names = F.array(*map(F.lit, ("Sonntag", "MONTAG", "dienstag", "Mittwoch", "Donnerstag", "Freitag", "Samstag")))
    banner = F.when(i % 3 == 0, F.concat(F.lit("  Nur am "), F.upper(F.date_format(day, "E")), F.lit("! "))).when(i % 3 == 1, F.concat(F.lit("Am "), F.get(names, F.dayofweek(day) - 1), F.lit(" –"))).otherwise(F.col("name"))
    rows = observations(spark, sf_dir).select("id", F.parse_json(F.expr(BODY)).alias("v"), x.normalized(banner).alias("banner"))
    price = F.coalesce(F.try_variant_get("v", "$.price.cents", "bigint"), F.try_variant_get("v", "$.price.current.cents", "bigint"))
    units = F.filter(F.try_variant_get("v", "$.price.units", "array<struct<kind: string, cents: bigint>>"), lambda u: u["kind"] == "base")
    kinds = F.create_map(*(F.lit(x) for d in b.WEEKDAYS for x in (d, f"{d}_special")))
    return rows.select("id", price.alias("price"), F.get(units, 0)["cents"].alias("unit_price"), F.try_element_at(kinds, F.element_at(F.split("banner", " "), -1)).alias("special"))


#: Titles around the names of offers, in words that both engines read.
TITLE = """case id % 8 when 0 then 'Payback Coupon für ' || name when 1 then 'zzgl. 0,25 Pfand' when 2 then '-- ' || cents || ' --' when 3 then name || ' zzgl. Pfand' when 4 then upper(name) || ' GUTSCHEIN' when 5 then 'Pfand ' || cents when 6 then brand else name end"""


@query(f"""with t as (select *, {TITLE} as title from obs), k as (select *, case when regexp_matches(lower(title), '{'|'.join(b.PROMO_WORDS)}') then 'promo' when contains(lower(title), 'pfand') and not regexp_matches(lower(title), '[a-z]{{5,}}.*pfand') then 'deposit_only'
  when not coalesce(regexp_matches(title, '\\p{{L}}{{2}}'), false) then 'noise' else 'product' end as kind from t),
known as (select distinct {NORM.format("name")} as title from obs where requires_app and app_cents is null and day = (select min(day) from obs))
select id, kind, case when kind = 'promo' then 'noise_recognised' when kind = 'product' and {NORM.format("k.title")} in (select title from known) then 'known_miss' else 'candidate' end as miss,
  case when coalesce(abs(regular_cents * (100 - percent) - cents * 100) <= 100, false) then case when mode = 'fixed_package' then 'math_verified' else 'math_correction_review' end
    when regular_cents is not null and percent is not null and mode = 'fixed_package' then 'unresolved_math_conflict' else 'semantic_price_only' end as tier from k""")
def title_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles that are promotion, a bare deposit or noise; misses known by their title from the first day's app-only offers without
    an app price; the tier of the evidence of a price: whether the regular price and the percentage give it, to a cent."""
    obs = observations(spark, sf_dir).withColumn("title", F.expr(TITLE))
    first = obs.agg(F.min("day").alias("first"))
    known = obs.filter("requires_app and app_cents is null").join(F.broadcast(first), F.col("day") == F.col("first")).select(x.normalized(F.col("name")).alias("known")).distinct()
    low = F.lower("title")
    kind = F.when(low.rlike("|".join(b.PROMO_WORDS)), "promo").when(low.rlike("pfand") & ~low.rlike(r"[a-z]{5,}.*pfand"), "deposit_only").when(~F.coalesce(F.col("title").rlike(r"\p{L}{2}"), F.lit(False)), "noise").otherwise("product")
    rows = obs.withColumns({"kind": kind, "key": x.normalized(F.col("title"))}).join(known, F.col("key") == F.col("known"), "left")
    miss = F.when(F.col("kind") == "promo", "noise_recognised").when((F.col("kind") == "product") & F.col("known").isNotNull(), "known_miss").otherwise("candidate")
    math = F.coalesce(F.abs(F.col("regular_cents") * (100 - F.col("percent")) - F.col("cents") * 100) <= 100, F.lit(False))
    exact = F.coalesce(F.col("mode") == "fixed_package", F.lit(False))
    tried = F.col("regular_cents").isNotNull() & F.col("percent").isNotNull()
    tier = F.when(math & exact, "math_verified").when(math, "math_correction_review").when(tried & exact, "unresolved_math_conflict").otherwise("semantic_price_only")
    return rows.select("id", "kind", miss.alias("miss"), tier.alias("tier"))


@query("""with r as (select id, list_sort(list_distinct(list_filter([case when id % 10 = 0 then 'bad_key' end, case when cents <= 0 then 'bad_price' end, case when (app_cents is not null) <> requires_app then 'app_price_mismatch' end, case when valid_until < valid_from then 'bad_window' end, case when mode is null then 'unknown_mode' end, case when o.day > date '2024-01-25' then 'page_out_of_range' end], lambda x: x is not null))) as reasons from obs o)
select id, array_to_string(reasons, ',') as reasons, len(reasons) = 0 as valid, case when len(reasons) = 0 then 'projected' else 'reported' end as route from r""")
def record_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules on a record: sorted distinct reasons; valid ones are projected, the others reported; pages by the reviewed list."""
    key = F.when(F.col("id") % 10 == 0, "x").otherwise(F.concat(F.lit("r-"), F.col("id").cast("string")))
    obs = observations(spark, sf_dir).withColumn("key", key)
    rules = {
        "bad_key": ~F.col("key").rlike("^r-[0-9]+$"), "bad_price": F.col("cents") <= 0, "app_price_mismatch": F.col("app_cents").isNotNull() != F.col("requires_app"),
        "bad_window": F.col("valid_until") < F.col("valid_from"), "unknown_mode": F.col("mode").isNull(), "page_out_of_range": F.col("day") > F.lit("2024-01-25").cast("date"),
    }
    reasons = F.array_sort(F.array_distinct(F.filter(F.array(*(F.when(bad, name) for name, bad in rules.items())), lambda x: x.isNotNull())))
    rows = obs.select("id", reasons.alias("r"))
    return rows.select("id", F.array_join("r", ",").alias("reasons"), (F.size("r") == 0).alias("valid"), F.when(F.size("r") == 0, "projected").otherwise("reported").alias("route"))


@query("""with k as (select chain, store, min(cents) as least, count(distinct offer) as retailers from obs group by all)
select chain, store, least, retailers, row_number() over (order by chain, store nulls last)::int as by_name, row_number() over (order by least nulls last, chain, store nulls last)::int as by_price, row_number() over (order by least desc nulls last, chain, store nulls last)::int as by_price_desc,
  row_number() over (order by retailers desc, chain, store nulls last)::int as by_retailers, row_number() over (order by (retailers >= 10) desc, chain, store nulls last)::int as by_coverage from k""")
def scope_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sorts of the catalogue and of basket scopes, missing prices last, as ranks (one row for each scope)."""
    k = observations(spark, sf_dir).groupBy("chain", "store").agg(F.min("cents").alias("least"), F.countDistinct("offer").alias("retailers"))
    last = [F.col("chain").asc(), F.col("store").asc_nulls_last()]
    rank = lambda *first: F.row_number().over(Window.orderBy(*first, *last))
    price = F.col("least")
    return k.select("*", rank().alias("by_name"), rank(price.asc_nulls_last()).alias("by_price"), rank(price.desc_nulls_last()).alias("by_price_desc"), rank(F.desc("retailers")).alias("by_retailers"), rank((F.col("retailers") >= 10).desc()).alias("by_coverage"))


@query("""select chain, id, row_number() over (partition by chain order by valid_from desc nulls last, store is null, store, collected_at, id)::int as review_place, row_number() over (partition by chain, day order by lower(name), cents, offer, id)::int as merged_place from obs""")
def review_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order of a review list (newest flyer first, pages that are missing last) and of a day's merged list, within a chain."""
    review = [F.col("valid_from").desc_nulls_last(), F.col("store").isNull(), F.col("store"), F.col("collected_at"), F.col("id")]
    merged = Window.partitionBy("chain", "day").orderBy(F.lower("name"), "cents", "offer", "id")
    rows = observations(spark, sf_dir).select("chain", "day", "id", "valid_from", "store", "collected_at", "name", "cents", "offer")
    rows = ranking.numbered(rows, "review_place", review, ["chain"])
    return rows.select("chain", "id", F.col("review_place").cast("int").alias("review_place"), F.row_number().over(merged).alias("merged_place"))


@query("""with s as (select chain, day, count(*) as n, sum(hash_part) as print from (select *, (id % 1000 * 31 + cents) % 65521 as hash_part from obs) group by all), p as (select *, lag(n) over w as was, lag(print) over w as before from s window w as (partition by chain order by day))
select chain, day, n, case when was = n and before = print then 'reused' else 'written' end as action from p""")
def content_reuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A day's content is written again only if its fingerprint or count differs from that of the day before."""
    part = (F.col("id") % 1000 * 31 + F.col("cents")) % 65521
    s = observations(spark, sf_dir).groupBy("chain", "day").agg(F.count(F.lit(1)).alias("n"), F.sum(part).alias("print"))
    w = Window.partitionBy("chain").orderBy("day")
    same = (F.lag("n").over(w) == F.col("n")) & (F.lag("print").over(w) == F.col("print"))
    return s.select("chain", "day", "n", F.when(same, "reused").otherwise("written").alias("action"))


@query("""select 'first' as attempt, count(*) as written, count(distinct id) as ids from obs where day < date '2024-01-15' union all select 'replay', 0, 0 union all select 'rest', count(*), count(distinct id) from obs where day >= date '2024-01-15'""")
def replayed_import(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An import that is written as a whole: replayed it adds nothing, the rest adds the rest."""
    obs = observations(spark, sf_dir).select("id", "day")
    cut = F.lit("2024-01-15").cast("date")
    store = written(obs.filter(F.col("day") < cut), "import")
    attempts = [("first", store), ("replay", obs.filter(F.col("day") < cut).join(store, "id", "left_anti")), ("rest", obs.join(store, "id", "left_anti"))]
    counted = [rows.agg(F.count(F.lit(1)).alias("written"), F.countDistinct("id").alias("ids")).select(F.lit(name).alias("attempt"), "written", "ids") for name, rows in attempts]
    return counted[0].unionByName(counted[1]).unionByName(counted[2])


@query("""select o.id, o.chain, case when t.n is null then 'unlabelled' when t.n > 1 then 'ambiguous' when t.top = o.cents then 'right' else 'wrong' end as outcome from (select * from obs where day >= date '2024-01-20') o
left join (select chain, offer, count(distinct cents) as n, max(cents) as top from obs where day < date '2024-01-05' group by all) t on o.chain = t.chain and o.offer = t.offer""")
def truth_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frozen rows meet the labels afterwards; several labels of a key are ambiguous."""
    obs = observations(spark, sf_dir)
    truth = obs.filter("day < date '2024-01-05'").groupBy("chain", "offer").agg(F.countDistinct("cents").alias("n"), F.max("cents").alias("top"))
    rows = obs.filter("day >= date '2024-01-20'").join(truth, ["chain", "offer"], "left")
    outcome = F.when(F.col("n").isNull(), "unlabelled").when(F.col("n") > 1, "ambiguous").when(F.col("top") == F.col("cents"), "right").otherwise("wrong")
    return rows.select("id", "chain", outcome.alias("outcome"))


@query("""with r as (select chain, day, lower(name) as name, min({'t': collected_at, 'i': id}).i as first_id from obs where id % 3 = 0 group by all)
select o.id, first_id as suppressed_by, first_id is null as open from (select * from obs where id % 3 = 1) o left join r on o.chain = r.chain and o.day = r.day and lower(o.name) = r.name""")
def suppressed_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates that a review row of the same page and title has already, the first of them by time and id."""
    obs = observations(spark, sf_dir).withColumn("title", b.normalized(F.col("name")))
    first = obs.filter("id % 3 = 0").groupBy("chain", "day", "title").agg(F.min_by("id", F.struct("collected_at", "id")).alias("suppressed_by"))
    rows = obs.filter("id % 3 = 1").join(first, ["chain", "day", "title"], "left")
    return rows.select("id", "suppressed_by", F.col("suppressed_by").isNull().alias("open"))


@query("""select c.custkey, o_orderkey::bigint as product, o_orderdate::date as day, o_orderdate::date = (select max(o_orderdate)::date from orders where o_custkey = c.custkey) as one_day from (select o_custkey as custkey, o_orderkey, o_orderdate from orders) c""")
def category_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A category's list of product ids joined to the map of products; whether a product's day is the category's label."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("custkey"), F.col("o_orderkey").cast("long").alias("product"), F.to_date("o_orderdate").alias("day"))
    scan = orders.groupBy("custkey").agg(F.to_json(F.struct(F.collect_list("product").alias("productIds"), F.max("day").cast("string").alias("label"))).alias("body"))
    read = scan.select("custkey", F.from_json("body", "productIds array<bigint>, label date").alias("c"))
    ids = read.select("custkey", F.col("c.label").alias("label"), F.explode("c.productIds").alias("product"))
    return ids.join(orders.drop("custkey"), "product").select("custkey", "product", "day", (F.col("day") == F.col("label")).alias("one_day"))


@query("""select r.chain, count(*) as scanned, count(t.id) as reported, count(*) filter (t.id is null) as missing from obs r left join (select id from obs where id % 6 <> 0) t using (id) group by r.chain""")
def scan_against_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table's scan joined to a report written as JSON lines, with the counts that say whether it is complete."""
    obs = observations(spark, sf_dir).select("id", "chain")
    path = written(obs.filter("id % 6 <> 0").select(F.to_json(F.struct("id")).alias("line")), "report")
    report = path.select(F.from_json("line", "id bigint")["id"].alias("reported_id"))
    joined = obs.join(report, F.col("id") == F.col("reported_id"), "left")
    return joined.groupBy("chain").agg(F.count(F.lit(1)).alias("scanned"), F.count("reported_id").alias("reported"), F.count_if(F.col("reported_id").isNull()).alias("missing"))


@query("""with d as (select chain, array_agg(distinct valid_from order by valid_from) filter (valid_from is not null and day = date '2024-01-08') as days from obs group by chain) select chain, coalesce(len(days), 0)::int as ranges, case when len(days) = 1 then days[1] end as only_day from d""")
def single_validity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A prospect's validity holds if its texts name one distinct range."""
    days = observations(spark, sf_dir).groupBy("chain").agg(F.collect_set(F.when(F.col("day") == F.lit("2024-01-08").cast("date"), F.col("valid_from"))).alias("days"))
    return days.select("chain", F.size("days").alias("ranges"), b.only_one(F.col("days")).alias("only_day"))


@query("""select id, chain || '/' || replace(lower(name), ' ', '-') as slug, substr(sha256(chain || '|' || lower(name) || '|' || cents), 1, 20) as staging_key from obs""")
def staging_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slugs and stable staging keys."""
    title = b.normalized(F.col("name"))
    slug = F.concat_ws("/", "chain", F.replace(title, F.lit(" "), F.lit("-")))
    return observations(spark, sf_dir).select("id", slug.alias("slug"), F.substring(F.sha2(F.concat_ws("|", "chain", title, F.col("cents").cast("string")), 256), 1, 20).alias("staging_key"))
