"""A page's document tree as a table, and offer cards read from it, whole page or nothing."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pricelode.shared import written

VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
#: Elements and one class whose nearest enclosing node every node knows.
MARKS = ("article", "dialog", "a", "title", "sr-only")
_MARKS = frozenset(MARKS)


class _Nodes(HTMLParser):
    """Nodes in document order: number, last number of the subtree, tag (#text for text), attributes, text, nearest marks."""

    def __init__(self) -> None:
        super().__init__()
        self.rows: list[list] = []
        self.open: list[tuple[str, int, dict[str, int]]] = []

    def add(self, tag: str, attrs: dict[str, str] | None, text: str | None) -> int:
        marks = self.open[-1][2] if self.open else {}
        self.rows.append([len(self.rows), len(self.rows), tag, attrs, text, marks])
        return len(self.rows) - 1

    def close_to(self, depth: int) -> None:
        while len(self.open) > depth:
            self.rows[self.open.pop()[1]][1] = len(self.rows) - 1

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        held = {k: v or "" for k, v in attrs} if attrs else {}
        node = self.add(tag, held, None)
        if tag not in VOID:
            marks = self.open[-1][2] if self.open else {}
            named = _MARKS.intersection((tag, *held["class"].split())) if "class" in held else (tag,) if tag in _MARKS else ()
            self.open.append((tag, node, {**marks, **dict.fromkeys(named, node)} if named else marks))

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.add(tag, {k: v or "" for k, v in attrs}, None)

    def handle_endtag(self, tag: str) -> None:
        for depth in range(len(self.open) - 1, -1, -1):
            if self.open[depth][0] == tag:
                return self.close_to(depth)

    def handle_data(self, data: str) -> None:
        if data.strip() and not (self.open and self.open[-1][0] in ("script", "style")):
            self.add("#text", None, " ".join(data.split()))  # a no-break space is space to split()


#: Plain markup, token by token: an end tag, a start tag with quoted attributes, text, what makes no node; all else is not plain.
_TOKEN = re.compile(r"""</([a-zA-Z][a-zA-Z0-9]*)[ \t\n\r\f]*>|<([a-zA-Z][a-zA-Z0-9]*)((?:[ \t\n\r\f]+[a-zA-Z][a-zA-Z0-9-]*="[^"]*")*)[ \t\n\r\f]*(/?)>|([^<]+)|(<![dD][oO][cC][tT][yY][pP][eE][^<>]*>|<!--[^->][^-]*-->)|(<)""")
_ATTRIBUTE = re.compile(r'([a-zA-Z][a-zA-Z0-9-]*)="([^"]*)"')
# Elements whose content is no markup, so a page with one (or with more than text in its title) is not plain.
_RAW = re.compile(r"<(?:script|style|textarea|xmp|iframe|noembed|noframes|noscript|plaintext|svg|math)\b|<title\b(?![^<>]*>[^<]*</title>)", re.I)


def _parsed(body: str) -> list[list]:
    """Rows of the nodes of a page.  Plain pages are read by one expression; all others by the parser, with the same rows."""
    nodes = _Nodes()
    if not _RAW.search(body):
        for token in _TOKEN.finditer(body):
            end, start, attrs, alone, text, _, other = token.groups()
            if other:
                break
            if text:
                nodes.handle_data(unescape(text) if "&" in text else text)
            elif end:
                nodes.handle_endtag(end.lower())
            elif start:
                pairs = [(k.lower(), unescape(v) if "&" in v else v) for k, v in _ATTRIBUTE.findall(attrs)] if attrs else []
                (nodes.handle_startendtag if alone else nodes.handle_starttag)(start.lower(), pairs)
        else:
            nodes.close_to(0)
            return nodes.rows
        nodes = _Nodes()
    nodes.feed(body)
    nodes.close()
    nodes.close_to(0)
    return nodes.rows


#: Columns of the nearest marks of a node.
_IN = {mark: f"in_{mark.replace('-', '_')}" for mark in MARKS}
#: Nodes of a batch that goes back to Spark.
BATCH = 50_000


def _nodes(pages: DataFrame, page: str, html: str, only: frozenset[str] | None = None) -> DataFrame:
    """page, node, last, tag, attrs, text and a column for each mark; the nodes of ``only`` these tags."""
    kind = pages.schema[page].dataType
    marks = list(_IN)
    schema = f"{page} {kind.simpleString()}, node int, last int, tag string, attrs map<string,string>, text string, {', '.join(f'{c} int' for c in _IN.values())}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held, keys = [], []

            def made() -> pa.RecordBatch:
                node, last, tag, attrs, text, around = ([r[i] for r in held] for i in range(6))
                pairs = [None if x is None else list(x.items()) for x in attrs]
                columns = [batch.column(0).take(pa.array(keys, pa.int32())), pa.array(node, pa.int32()), pa.array(last, pa.int32()), pa.array(tag, pa.string()), pa.array(pairs, pa.map_(pa.string(), pa.string())), pa.array(text, pa.string())]
                columns += [pa.array([x.get(m) for x in around], pa.int32()) for m in marks]
                return pa.RecordBatch.from_arrays(columns, [batch.schema.names[0], "node", "last", "tag", "attrs", "text", *_IN.values()])

            for i, body in enumerate(batch.column(1)):
                rows = _parsed(body.as_py() or "")
                rows = rows if only is None else [r for r in rows if r[2] in only]
                held += rows
                keys += [i] * len(rows)
                if len(held) >= BATCH:
                    yield made()
                    held, keys = [], []
            yield made()

    return pages.select(page, html).mapInArrow(run, schema)


def document_tree(pages: DataFrame, page: str, html: str) -> DataFrame:
    """page, node, last, tag, attrs, text, marks (name of a mark -> nearest enclosing node).  A node encloses those from its
    own number to ``last``.  Null pages have no nodes; elements that are never closed end with what encloses them."""
    marks = F.map_filter(F.create_map(*(c for mark, at in _IN.items() for c in (F.lit(mark), F.col(at)))), lambda _, at: at.isNotNull())
    return _nodes(pages, page, html).select(page, "node", "last", "tag", "attrs", "text", marks.alias("marks"))


# Forms of an offer's fragment, of the labels that say what a price is, of the dates of a page, and words.
FRAGMENT = r"^angebot-([0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12})$"
PRICE_LABELS = {"fixed": "Festpreis von", "reduced": "Rabattierter Preis von", "app": "App-Preis von"}
VALID_FROM = r"(?i)Gültig\s+ab\s+(\d{2}\.\d{2}\.\d{4})"
VALID_UNTIL = r"(?i)Alle\s+Angebote\s+gültig\s+bis(?:\s+[A-Za-zÄÖÜäöüß]+,)?\s+den\s+(\d{2}\.\d{2}\.\d{4})"
POINTS_ONLY = r"(?i)\d{1,4}\s*Extra°Punkte.*?Mit\s+PAYBACK.*?Extra\s+Punkte\s+sammeln"
TITLE_PREFIX = r"(?i)^\s*Angebot:\s*"
PRICE_WORDS = ["preis", "€", "eur", "rabatt", "pfand"]
LONGEST_DAYS = 7


def printed_cents(text: Column, kind: str) -> Column:
    """Cents of the first price that carries this label in a text, zero included."""
    pattern = rf"(?i){PRICE_LABELS[kind].replace(' ', chr(92) + 's+')}\s+(\d{{1,4}}(?:[.,]\d{{1,2}})?)\s*€"
    number = F.replace(F.nullif(F.regexp_extract(text, pattern, 1), F.lit("")), F.lit(","), F.lit(".")).try_cast("decimal(8,2)")
    return (number * 100).cast("long")


def _of_containers(tree: DataFrame, page: str, marks: tuple[str, ...]) -> DataFrame:
    """page, at (node of an element of these marks), pieces (node, text, label_node) of its text in order."""
    at = F.explode(F.array_compact(F.array(*(_IN[m] for m in marks))))
    rows = tree.filter("tag = '#text'").select(page, at.alias("at"), F.struct("node", "text", F.col("in_sr_only").alias("label_node")).alias("piece"))
    return rows.groupBy(page, "at").agg(F.sort_array(F.collect_list("piece")).alias("pieces"))


def _readings(tree: DataFrame, page: str) -> DataFrame:
    """page, at, price and what else is said in each article and dialog, one row of plain values: price struct(cents, app_cents, requires_app, app_printed)
    by its labels, where none says so by its whole text; points (points only), unknown (a label with a price word), money (a
    deposit's) and other (what may be a price beside it).  Prices are columns of their own step, as each is read more than once."""
    said = lambda pieces: F.transform(pieces, lambda p: p["text"])
    spoken = F.array_sort(F.array_distinct(F.array_compact(F.transform("pieces", lambda p: p["label_node"]))))
    rows = _of_containers(tree, page, ("article", "dialog")).select(page, "at", "pieces", said("pieces").alias("texts"), spoken.alias("spoken"))
    labels = F.transform("spoken", lambda n: F.array_join(said(F.filter("pieces", lambda p: p["label_node"] == n)), " "))
    rows = rows.select(page, "at", "texts", labels.alias("labels"), F.array_join("texts", " ").alias("text"), F.transform("texts", F.lower).alias("low"))
    of = lambda kind: F.transform("labels", lambda x: printed_cents(x, kind))
    listed = {f"_l_{k}": of(k) for k in PRICE_LABELS}
    rows = rows.withColumns(listed | {f"_t_{k}": printed_cents(F.col("text"), k) for k in PRICE_LABELS})
    counts = lambda c: F.get(F.filter(c, lambda x: x > 0), F.lit(0))
    rows = rows.withColumns({f"_s_{k}": counts(F.col(f"_l_{k}")) for k in PRICE_LABELS} | {"_p_app": F.get(F.array_compact("_l_app"), F.lit(0))})
    named = F.coalesce(*(F.col(f"_s_{k}") for k in PRICE_LABELS)).isNotNull()
    # a price that counts is one above zero
    rows = rows.withColumns({f"_{k}": F.when(named, F.col(f"_s_{k}")).otherwise(F.nullif(F.col(f"_t_{k}"), F.lit(0).cast("long"))) for k in PRICE_LABELS} | {"_printed": F.when(named, F.col("_p_app")).otherwise(F.col("_t_app"))})
    plain = F.coalesce("_fixed", "_reduced")
    made = F.struct(F.coalesce(plain, "_app").alias("cents"), F.col("_app").alias("app_cents"), plain.isNull().alias("requires_app"), F.coalesce("_app", "_printed").alias("app_printed"))
    money, deposit = lambda p: p.rlike("€|eur"), lambda p: F.contains(p, F.lit("pfand"))
    no_dates = lambda p: F.regexp_replace(p, r"\b\d{2}\.\d{2}\.\d{4}\b", "")
    other = F.exists("low", lambda p: p.rlike("preis|rabatt") | (~deposit(p) & (money(p) | no_dates(p).rlike(r"\b\d{1,4}[.,]\d{1,2}\b"))))
    return rows.select(
        page, "at", F.when(F.coalesce(plain, "_app").isNotNull(), made).alias("price"), F.col("text").rlike(POINTS_ONLY).alias("points"),
        F.exists("labels", lambda x: F.lower(x).rlike("|".join(PRICE_WORDS))).alias("unknown"), F.exists("low", lambda p: deposit(p) & money(p)).alias("money"), other.alias("other"),
    )


def offer_cards(pages: DataFrame, page: str, html: str, url: str, collected: str, store: str) -> tuple[DataFrame, DataFrame]:
    """(offers, states) of store pages with ``url``, day of collection and name of the store.

    offers: page, offer_id, name, cents, app_cents, requires_app, valid_from, valid_until, app_printed (the app price as it
    is printed: a zero there is no price, so app_cents is null).  states: page, state (ok or
    rejected), reasons (sorted), n_offers.  A card is a link to a fragment with an offer's id, the article around it and the dialog
    of that id; the first link of an id counts.  Its price is what a label in the article says, else in the dialog.  A card
    with points only or with nothing but a deposit is left out.  A page whose meaning is not sure in any point (title of another store, no or several
    dates, dates that do not cover the collection, links to other pages, cards without article, dialog, name or known
    price, no card at all) gives no offer."""
    tree = written(_nodes(pages, page, html, frozenset(("#text", "a", "dialog"))), "tree")
    of = pages.select(page, url, collected, store)
    pieces = tree.filter("tag = '#text'").groupBy(page).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("node", "text"))), lambda x: x["text"]), " ").alias("text"))
    joined = lambda mark: _of_containers(tree, page, (mark,)).select(page, "at", F.array_join(F.transform("pieces", lambda p: p["text"]), " ").alias("text"))
    titles = joined("title").groupBy(page).agg(F.min_by("text", "at").alias("title"))
    day = lambda pattern: F.array_distinct(F.regexp_extract_all("text", F.lit(pattern), F.lit(1)))
    bound = of.join(pieces, page, "left").join(titles, page, "left").withColumns({"text": F.coalesce("text", F.lit(""))}).withColumns({"froms": day(VALID_FROM), "untils": day(VALID_UNTIL)})
    date = lambda c: F.when(F.size(c) == 1, F.try_to_date(F.get(c, F.lit(0)), "dd.MM.yyyy"))
    bound = bound.withColumns({"valid_from": date("froms"), "valid_until": date("untils")})
    a, b, seen = F.col("valid_from"), F.col("valid_until"), F.col(collected)
    page_rules = {
        "title of another store": ~F.coalesce(F.contains(F.lower("title"), F.lower(store)), F.lit(False)), "not one valid_from": a.isNull(), "not one valid_until": b.isNull(),
        "ends before it begins": b < a, "window too long": F.datediff(b, a) + 1 > LONGEST_DAYS, "collected outside the window": ~seen.between(a, b),
    }

    href = F.col("href")
    fragment = F.regexp_extract(F.element_at(F.split(href, "#"), -1), FRAGMENT, 1)
    links = tree.filter("tag = 'a'").select(page, "node", F.element_at("attrs", "href").alias("href"), F.col("in_article").alias("article_node")).filter(F.contains("href", F.lit("#")))
    links = links.withColumn("offer_id", F.lower(fragment)).filter("offer_id <> ''").join(of.select(page, F.col(url).alias("_url")), page)
    base, own = F.regexp_extract(href, "^([^#]*)", 1), F.regexp_extract("_url", "^([^#]*)", 1)
    path = F.regexp_extract(own, r"^[a-zA-Z]+://[^/]+(/[^?]*)?", 1)
    links = links.withColumn("outside", ~((base == "") | (base == own) | ((base == path) & ~F.contains(own, F.lit("?")))))
    first = F.row_number().over(Window.partitionBy(page, "offer_id").orderBy("node"))
    cards = links.withColumn("_n", first).filter("_n = 1").drop("_n")

    dialogs = tree.filter("tag = 'dialog'").select(F.col(page).alias("_p"), F.lower(F.element_at("attrs", "id")).alias("_id"), "node").groupBy("_p", "_id").agg(F.min("node").alias("dialog_node"))
    cards = cards.join(dialogs, (F.col(page) == F.col("_p")) & (F.concat(F.lit("dialog-angebot-"), "offer_id") == F.col("_id")), "left").drop("_p", "_id")
    readings = written(_readings(tree, page), "readings")
    for mark in ("article", "dialog"):
        own = readings.select(page, F.col("at").alias(f"{mark}_node"), *(F.col(c).alias(f"{mark}_{c}") for c in ("price", "points", "unknown", "money", "other")))
        cards = cards.join(own, [page, f"{mark}_node"], "left")
    names = joined("a").select(page, F.col("at").alias("node"), F.trim(F.regexp_replace("text", TITLE_PREFIX, "")).alias("name"))
    cards = cards.join(names, [page, "node"], "left").withColumns({"name": F.coalesce("name", F.lit(""))})
    so = lambda c: F.coalesce(c, F.lit(False))
    # the only money in the texts of a card is a deposit: nothing else names a price, a discount or a decimal number
    deposit_only = (so("article_money") | so("dialog_money")) & ~so("article_other") & ~so("dialog_other")
    out = F.when(F.col("article_price").isNotNull(), "offer").when(so("article_points"), "left_out").when(so("article_unknown"), "unknown")
    out = out.when(F.col("dialog_price").isNotNull(), "offer").when(deposit_only, "left_out").otherwise("unknown")
    cards = written(cards.withColumns({"outcome": out, "price": F.coalesce("article_price", "dialog_price")}).select(page, "offer_id", "name", "outside", "article_node", "dialog_node", "outcome", "price"), "cards")
    card_rules = {
        "link to another page": F.col("outside"), "card without an article": F.col("article_node").isNull(), "card without a dialog": F.col("dialog_node").isNull(),
        "card without a name": F.col("name") == "", "card of unknown price": F.col("outcome") == "unknown",
    }
    counted = cards.groupBy(page).agg(F.count_if(F.col("outcome") == "offer").alias("n"), *(F.bool_or(rule).alias(f"_{i}") for i, rule in enumerate(card_rules.values())))
    states = bound.join(counted, page, "left")
    broken = [F.when(F.coalesce(rule, F.lit(False)), F.lit(name)) for name, rule in page_rules.items()]
    broken += [F.when(F.coalesce(F.col(f"_{i}"), F.lit(False)), F.lit(name)) for i, name in enumerate(card_rules)]
    broken.append(F.when(F.coalesce("n", F.lit(0)) == 0, F.lit("no offer card")))
    states = states.withColumn("reasons", F.array_sort(F.array_compact(F.array(*broken))))
    state = F.when(F.size("reasons") == 0, "ok").otherwise("rejected")
    states = written(states.select(page, state.alias("state"), F.array_join("reasons", "; ").alias("reasons"), F.when(F.size("reasons") == 0, F.col("n")).otherwise(0).cast("long").alias("n_offers"), "valid_from", "valid_until"), "states")
    fine = states.filter("state = 'ok'").select(page, "valid_from", "valid_until")
    offers = cards.filter("outcome = 'offer'").join(fine, page).select(page, "offer_id", "name", "price.cents", "price.app_cents", "price.requires_app", "valid_from", "valid_until", "price.app_printed")
    return offers, states.drop("valid_from", "valid_until")
