"""Readers for semi-structured sources: HTML anchors and cards, OCR tables, flyer and embedded JSON, page probes."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The columns of an OCR table.
OCR_FIELDS = ("level", "page_num", "block_num", "par_num", "line_num", "word_num", "left", "top", "width", "height", "conf", "text")


def anchors(pages: DataFrame, key: str, html: str) -> DataFrame:
    """Every link of a page once, in document order: key, place, href."""
    hrefs = F.regexp_extract_all(F.col(html), F.lit(r'<a\s[^>]*?href="([^"]*)"'), F.lit(1))
    rows = pages.select(key, F.posexplode(hrefs).alias("place", "href"))
    return rows.groupBy(key, "href").agg(F.min("place").alias("place"))


def probe(pages: DataFrame, key: str, html: str, keywords: list[str]) -> DataFrame:
    """Digest, size, keyword counts and a hint at how to read the page."""
    low = F.lower(html)
    hits = [F.regexp_count(low, F.lit(k)).alias(k) for k in keywords]
    rows = pages.select(key, F.sha2(html, 256).alias("sha256"), F.octet_length(html).alias("content_bytes"), F.regexp_count(F.col(html), F.lit("application/ld\\+json")).alias("json_ld_blocks"), *hits)
    total = sum((F.col(k) for k in keywords), F.lit(0))
    hint = F.when(total >= 2, "http_html_candidate").otherwise("html_needs_inspection")
    return rows.select(key, "sha256", "content_bytes", "json_ld_blocks", total.alias("keyword_hits"), hint.alias("strategy"), (F.col("content_bytes") >= 1000).alias("success"))


def line_cards(docs: DataFrame, key: str, text: str, marker: Column, priced: Column) -> DataFrame:
    """Cards of a line stream: a card starts at each line for which ``marker`` holds, its first line after that is the
    name, and it counts only with a line for which ``priced`` holds.  Both are expressions over ``line``."""
    lines = docs.select(key, F.split(F.col(text), "\n").alias("lines"))
    lines = lines.select(key, F.posexplode("lines").alias("place", "line")).filter(F.trim("line") != "")
    w = Window.partitionBy(key).orderBy("place")
    carded = lines.withColumn("card", F.sum(marker.cast("int")).over(w)).filter("card > 0").withColumn("_m", marker)
    cards = carded.groupBy(key, "card").agg(F.min_by("line", F.when(~F.col("_m"), F.col("place"))).alias("name"), F.count_if(~F.col("_m")).alias("n_lines"), F.bool_or(priced & ~F.col("_m")).alias("priced"))
    return cards.filter("priced").select(key, "card", "name", "n_lines")


def ocr_words(lines: DataFrame, column: str, least: float = 0.0) -> DataFrame:
    """Words of an OCR table: 12 fields cut at tabs, quotes are text; ``ok`` is false for a malformed row."""
    f = F.split(F.col(column), "\t", 12)
    rows = lines.withColumn("_f", f)
    number = lambda i: F.get("_f", F.lit(i)).try_cast("int").alias(OCR_FIELDS[i])
    ok = (F.size("_f") == 12) & F.get("_f", F.lit(0)).try_cast("int").isNotNull() & F.get("_f", F.lit(10)).try_cast("double").isNotNull()
    out = rows.select(*lines.columns, *(number(i) for i in range(10)), F.get("_f", F.lit(10)).try_cast("double").alias("conf"), F.get("_f", F.lit(11)).alias("text"), ok.alias("ok"))
    return out.filter(~F.col("ok") | (F.col("conf") >= least))


def flyer_products(flyers: DataFrame, key: str, column: str) -> DataFrame:
    """Links of a flyer's pages with the product they name: page and link from 1, and the title if the product is known."""
    schema = "struct<products: map<string, struct<title: string>>, pages: array<struct<links: array<struct<product: string, left: double, top: double>>>>>"
    parsed = flyers.select(key, F.from_json(column, schema).alias("f"))
    pages = parsed.select(key, "f.products", F.posexplode("f.pages").alias("page", "p"))
    links = pages.select(key, "products", (F.col("page") + 1).alias("page"), F.posexplode("p.links").alias("link", "l"))
    return links.select(key, "page", (F.col("link") + 1).alias("link"), F.col("l.product").alias("product"), F.try_element_at("products", F.col("l.product"))["title"].alias("title"), F.when(F.col("l.left") < 0.5, "left").when(F.col("l.left") >= 0.5, "right").alias("side"))


class _Cards(HTMLParser):
    """Articles of a page: id of the link inside, heading, and all visible text."""

    def __init__(self) -> None:
        super().__init__()
        self.cards: list[dict] = []
        self.stack: list[str] = []

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag == "article":
            self.cards.append({"href": None, "heading": "", "text": "", "open": True})
        self.stack.append(tag)
        if tag == "a" and self.cards and self.cards[-1]["open"]:
            self.cards[-1]["href"] = self.cards[-1]["href"] or dict(attrs).get("href")

    def handle_endtag(self, tag: str) -> None:
        if tag in self.stack:
            while self.stack.pop() != tag:
                pass
        if tag == "article" and self.cards:
            self.cards[-1]["open"] = False

    def handle_data(self, data: str) -> None:
        if self.cards and self.cards[-1]["open"] and not {"script", "style"} & set(self.stack):
            card = self.cards[-1]
            card["text"] += data + " "
            if {"h1", "h2", "h3"} & set(self.stack):
                card["heading"] += data


def dom_cards(pages: DataFrame, key: str, html: str) -> DataFrame:
    """Article cards of pages whose markup patterns alone can't cut: key, place, href, heading, text."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for k, body in zip(frame[key], frame[html], strict=True):
                parser = _Cards()
                parser.feed(body or "")
                rows += [(k, i, c["href"], " ".join(c["heading"].split()), " ".join(c["text"].split())) for i, c in enumerate(parser.cards)]
            yield pd.DataFrame(rows, columns=[key, "place", "href", "heading", "text"])

    return pages.select(key, html).mapInPandas(run, f"{key} {pages.schema[key].dataType.simpleString()}, place int, href string, heading string, text string")
