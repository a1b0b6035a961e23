"""Offer cards of a page: what a card is, what its price is, and pages that are refused as a whole."""

import random
from datetime import date

import pytest

from pricelode.sources import tree

URL = "https://www.shop.example/maerkte/4711/angebote/"
IDS = [f"{i:08x}-1111-4222-8333-abcdefabcdef" for i in range(20)]
WINDOW = "<p>Gültig ab 20.07.2026</p><p>Alle Angebote gültig bis Samstag, den 25.07.2026, KW 30.</p>"


def card(i, body, name="Angebot: Mini&nbsp;Tomaten", dialog="", href=None, dialog_id=None):
    return f'<article><h3><a href="{href or f"#angebot-{IDS[i]}"}">{name}</a></h3>{body}</article><dialog id="dialog-angebot-{dialog_id or IDS[i]}"><b>x</b>{dialog}{WINDOW}</dialog>'


def page(*cards, title="Angebote Markt Nord", extra=""):
    return f"<!doctype html><html><head><title>{title}</title><script>Festpreis von 9.99 €</script></head><body>{extra}{''.join(cards)}</body></html>"


FIXED, APP, REDUCED = ('<div class="sr-only">{} von {} €</div>'.format(*x) for x in (("Festpreis", "1.11"), ("App-Preis", "0,99"), ("Rabattierter Preis", "2,5")))


def read(spark, *htmls, day=date(2026, 7, 21), url=URL):
    frame = spark.createDataFrame([(i, h, url, day, "Markt Nord") for i, h in enumerate(htmls)], "page int, html string, url string, day date, store string")
    offers, states = tree.offer_cards(frame, "page", "html", "url", "day", "store")
    return sorted((r["page"], r["offer_id"][:8], r["name"], r["cents"], r["app_cents"], r["requires_app"]) for r in offers.collect()), {r["page"]: (r["state"], r["reasons"], r["n_offers"]) for r in states.collect()}


def test_prices_of_cards(spark):
    html = page(
        card(0, FIXED), card(1, APP + FIXED), card(2, APP), card(3, "<p>Rabattierter <b>Preis</b> von 2,50 €</p>"), card(4, "<p>lose</p>", dialog=REDUCED),
        card(5, '<div class="a sr-only b"><span>Festpreis</span> von 3 €</div><div class="sr-only">Festpreis von 4 €</div>'), card(0, FIXED.replace("1.11", "7.77")),  # the first of an id counts
        card(6, "<p>10 Extra°Punkte</p><p>Mit PAYBACK 10 Extra Punkte sammeln, Normalpreis 3,99 €</p>"), card(7, "<p>Mehrweg</p><p>zzgl. 0,25 € Pfand</p>"),
        card(8, '<div class="sr-only">zum Merkzettel</div>', dialog=FIXED), card(9, FIXED, href=f"/maerkte/4711/angebote/#angebot-{IDS[9].upper()}"), '<a href="#other">x</a><a>y</a>',
    )
    offers, states = read(spark, html)
    name = "Mini Tomaten"
    assert offers == [
        (0, "00000000", name, 111, None, False), (0, "00000001", name, 111, 99, False), (0, "00000002", name, 99, 99, True), (0, "00000003", name, 250, None, False), (0, "00000004", name, 250, None, False),
        (0, "00000005", name, 300, None, False), (0, "00000008", name, 111, None, False), (0, "00000009", name, 111, None, False),
    ]
    assert states == {0: ("ok", "", 8)}


def test_pages_are_refused_as_a_whole(spark):
    good = card(0, FIXED)
    unclear = "<p>Gültig ab 21.07.2026</p>"
    cases = [
        (page(good, title="Anderer Markt"), "title of another store"), (page(good, extra=unclear), "not one valid_from"), (page(good.replace("gültig bis", "bis")), "not one valid_until"),
        (page(good.replace("25.07.2026", "19.07.2026")), "collected outside the window; ends before it begins"), (page(good.replace("25.07.2026", "29.07.2026")), "window too long"), (page(good.replace("20.07.2026", "22.07.2026")), "collected outside the window"),
        (page(good, card(1, FIXED, href=f"https://elsewhere.example/#angebot-{IDS[1]}")), "link to another page"), (page(good, card(1, FIXED).replace("article", "section")), "card of unknown price; card without an article"),
        (page(good, card(1, FIXED, dialog_id=IDS[2])), "card without a dialog"), (page(good, card(1, FIXED, name=" Angebot: ")), "card without a name"),
        (page(good, card(1, '<div class="sr-only">Mondpreis von 1 €</div>', dialog=FIXED)), "card of unknown price"), (page(good, card(1, "<p>nur 1,99 €</p>")), "card of unknown price"),
        (page(good, card(1, "<p>Pfand 0,25 €</p><p>1,99</p>")), "card of unknown price"), (page(good, card(1, '<div class="sr-only">Festpreis von 0,00 €</div>')), "card of unknown price"),
        (page(extra=WINDOW), "no offer card"), (page(good.replace("20.07.2026", "99.07.2026")), "not one valid_from"),
        ("", "no offer card; not one valid_from; not one valid_until; title of another store"), (None, "no offer card; not one valid_from; not one valid_until; title of another store"),
    ]
    offers, states = read(spark, *(h for h, _ in cases))
    assert offers == [] and states == {i: ("rejected", why, 0) for i, (_, why) in enumerate(cases)}


def test_tree_of_any_markup(spark):
    """Subtrees nest, marks are the nearest around, whatever is not closed or closed twice."""
    pick = random.Random(3)
    parts = ["<article>", "</article>", "<a href='#x'>", "</a>", "<p class='sr-only'>", "</p>", "text ", "<br>", "<img src=x/>", "<dialog id=d>", "</dialog>", "</b>", "<script>no</script>", "&amp; ", "<"]
    pages = ["".join(pick.choice(parts) for _ in range(pick.randrange(0, 40))) for _ in range(60)]
    frame = spark.createDataFrame(list(enumerate(pages)), "page int, html string")
    by = {}
    for r in tree.document_tree(frame, "page", "html").collect():
        by.setdefault(r["page"], []).append(r)
    for rows in by.values():
        assert [r["node"] for r in rows] == list(range(len(rows))) and all(r["node"] <= r["last"] < len(rows) for r in rows)
        for r in rows:
            around = [x for x in rows if x["node"] < r["node"] <= x["last"]]
            assert all(x["last"] >= r["last"] for x in around) and (r["text"] is None) == (r["tag"] != "#text")
            for mark in tree.MARKS:
                found = [x["node"] for x in around if x["tag"] == mark or mark in (x["attrs"] or {}).get("class", "").split()]
                assert r["marks"].get(mark) == (max(found) if found else None)


@pytest.mark.parametrize("url", [URL, URL + "?a=1"])
def test_links_within_the_page(spark, url):
    hrefs = [f"{url}#angebot-{IDS[0]}", f"#angebot-{IDS[1]}"]
    offers, states = read(spark, page(*(card(i, FIXED, href=h) for i, h in enumerate(hrefs))), url=url)
    assert states == {0: ("ok", "", 2)} and len(offers) == 2


def test_app_price_of_zero(spark):
    """No price to act on, but printed: the query reports it beside the plain price, and alone it is no price."""
    zero = APP.replace("0,99", "0,00")
    frame = spark.createDataFrame([(0, page(card(0, zero + FIXED), card(1, APP + FIXED)), URL, date(2026, 7, 21), "Markt Nord"), (1, page(card(2, zero)), URL, date(2026, 7, 21), "Markt Nord")], "page int, html string, url string, day date, store string")
    offers, states = tree.offer_cards(frame, "page", "html", "url", "day", "store")
    assert sorted((r["cents"], r["app_cents"] or -1, r["app_printed"]) for r in offers.collect()) == [(111, -1, 0), (111, 99, 99)]
    assert {r["page"]: r["state"] for r in states.collect()} == {0: "ok", 1: "rejected"}


def test_plain_markup_is_read_as_the_parser_reads_it(monkeypatch):
    """Pages of plain markup take the short way, all others the parser's, with the same nodes; a plain page never meets the parser."""
    pick = random.Random(7)
    plain = ["<article>", "</article>", '<a href="#y&amp;z" HREF="q">', "</a >", '<P Class="x sr-only">', "</p>", "text ", "<br>", "<br/>", '<dialog id="d">', "</b>", "&amp; ", "&", "<!-- x -->", "<title>t &lt; u</title>", '<a\n k="v">', "\xa0", "a & b"]
    odd = ["<a href='#x'>", "<img src=x/>", "<script><a></script>", "<", "<!-->", "<title>a<b>c</title>", "<title>", "<?x>", '<a k="1"l="2">', "</>", "<a-b>", "<p k>"]

    def by_parser(body):
        nodes = tree._Nodes()
        nodes.feed(body)
        nodes.close()
        nodes.close_to(0)
        return nodes.rows

    bodies = ["".join(pick.choice(plain + odd * (i % 2)) for _ in range(pick.randrange(0, 30))) for i in range(3000)]
    want = [by_parser(b) for b in bodies]
    assert [tree._parsed(b) for b in bodies] == want
    monkeypatch.setattr(tree._Nodes, "feed", None)
    assert [tree._parsed(b) for b in bodies[::2]] == want[::2]


def test_containers_are_read_once(spark, monkeypatch):
    """The tree holds the nodes that cards need, and what articles and dialogs say is written as one row of plain values each."""
    made = {}
    write = tree.written
    monkeypatch.setattr(tree, "written", lambda df, tag: made.setdefault(tag, write(df, tag)))
    read(spark, page(*(card(i, "<p><b>x</b></p>" * 5 + FIXED) for i in range(4))))
    assert {r["tag"] for r in made["tree"].select("tag").distinct().collect()} == {"#text", "a", "dialog"}
    assert made["readings"].count() == 8 and not any("array" in t for _, t in made["readings"].dtypes)
