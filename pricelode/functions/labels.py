"""Labels, titles, brands and money of offers as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pricelode.functions.text import normalized

# Words that a label does not end with, and words of promotion that are no product: this library's own lists.
GLUE_WORDS = ["und", "oder", "mit", "aus", "von", "für", "je", "in", "im"]
PROMO_WORDS = ["aktion", "rabatt", "gutschein", "payback", "gewinnspiel", "newsletter", "coupon"]
# Whole words that tell what a price in a line is, in the order in which they are tried.
CONTEXT_WORDS = {
    "shipping": ["versand", "versandkosten", "versandkostenpauschale", "porto", "lieferkosten", "lieferung"],
    "installment": ["ratenzahlung", "monat", "laufzeit", "gesamtpreis"],
    "unit": ["grundpreis"],
    "reference": ["normalpreis", "uvp", "statt", "vorher", "regulär"],
}
# Units of a base price and of an amount in a package, words in front of a package's amount.
BASE_UNITS, SMALL_BASE_UNITS = ["kg", "l", "ltr", "liter"], ["g", "ml"]
AMOUNT_UNITS = ["kg", "g", "l", "ltr", "liter", "ml", "cl"]
PACKAGING_WORDS = ["gebinde", "standardpackung", "packung"]
WEEKDAYS = ["montag", "dienstag", "mittwoch", "donnerstag", "freitag", "samstag", "sonntag"]


def compact(c: Column) -> Column:
    """Letters and digits of the normalised text."""
    return F.regexp_replace(normalized(c), "[ %]", "")


def words_only(c: Column) -> Column:
    """Letters with blanks between them; digits and signs go."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"[^\p{L}]+", " "))


def one_blank(c: Column) -> Column:
    """White space as one blank, nothing else changed."""
    return F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", " "))


def search_text(c: Column) -> Column:
    """Lower case without white space at the ends; null stays."""
    return F.lower(F.trim(c))


def contained(a: Column, b: Column, ratio: Column, floor: float = 0.9) -> Column:
    """Similarity of two names: 1 where one's letters and digits hold the other's, ``floor`` at least where its words do."""
    x, y = compact(a), compact(b)
    some = (F.length(x) > 0) & (F.length(y) > 0)
    whole = lambda p, q: F.contains(F.concat(F.lit(" "), p, F.lit(" ")), F.concat(F.lit(" "), q, F.lit(" ")))
    n, m = normalized(a), normalized(b)
    return F.when(some & (F.contains(x, y) | F.contains(y, x)), F.lit(1.0)).when(some & (whole(n, m) | whole(m, n)), F.greatest(ratio, F.lit(floor))).otherwise(ratio)


def echoes(text: Column, title: Column, share: float = 0.6) -> Column:
    """Whether a title is read again in a text: as it is, or by ``share`` of its words."""
    n, t = normalized(text), normalized(title)
    words = F.array_distinct(F.split(t, " "))
    found = F.size(F.array_intersect(words, F.split(n, " ")))
    return (F.length(t) > 0) & (F.contains(n, t) | (found >= F.size(words) * share))


def brand(c: Column) -> Column:
    """The normalised brand, null for none."""
    return F.nullif(normalized(c), F.lit(""))


def without_brand(name: Column, brand_: Column) -> Column:
    """A normalised name without the brand in front of it, unless nothing would be left."""
    n, b = normalized(name), brand(brand_)
    rest = F.trim(F.substring(n, F.length(b) + 1, F.length(n)))
    return F.when(b.isNotNull() & F.startswith(n, F.concat(b, F.lit(" "))) & (rest != ""), rest).otherwise(n)


def brandlike(c: Column, share: float = 0.75) -> Column:
    """Whether the letters are upper case for the most part."""
    letters = F.regexp_count(c, F.lit(r"\p{L}"))
    return (letters > 0) & (F.regexp_count(c, F.lit(r"\p{Lu}")) >= letters * share)


def clean_label(c: Column) -> Column:
    """One-blank text without trade-mark signs and without a glue word at its end."""
    bare = one_blank(F.regexp_replace(c, "[®™©]", ""))
    return F.trim(F.regexp_replace(bare, rf"(?iu) ({'|'.join(GLUE_WORDS)})$", ""))


def _whole(*patterns: str) -> str:
    """A pattern for any of these with no letter, digit or underline on either side."""
    return rf"(?<![\p{{L}}\p{{N}}_])(?:{'|'.join(patterns)})(?![\p{{L}}\p{{N}}_])"


def context_patterns() -> dict[str, str]:
    base = rf"1\s*(?:{'|'.join(BASE_UNITS)})"
    small = rf"100\s*(?:{'|'.join(SMALL_BASE_UNITS)})"
    out = {name: _whole(*words) for name, words in CONTEXT_WORDS.items()}
    out["shipping"] += r"|(?<![\p{L}\p{N}_])zzgl\.?\s+liefer(?![\p{L}\p{N}_])"
    out["unit"] += rf"|{_whole(base, small)}|(?<![\p{{L}}\p{{N}}_])(?:kg|l)\s*="
    return out


def same_amount(line: Column, pattern: str, token: Column) -> Column:
    """Whether one of the numbers that the pattern's first group finds in a line is the token's number."""
    number = lambda x: F.replace(x, F.lit(","), F.lit(".")).try_cast("decimal(12,4)")
    own = number(F.regexp_replace(token, r"[€\s]|eur", ""))
    return F.exists(F.regexp_extract_all(line, F.lit(pattern), F.lit(1)), lambda x: F.coalesce(number(x) == own, F.lit(False)))


def price_context(line: Column, token: Column | None = None, nearby: Column | None = None) -> Column:
    """What a price is by the words of its line and of the text ``nearby``: shipping, installment, unit, reference, else
    sale.  Of a sale the exact number ``token`` is looked at: it is a ``deposit`` if it stands before Pfand, a ``package`` amount if it
    stands before a unit, after a count or after a word for packaging, unless the line names a currency."""
    low = F.lower(F.coalesce(line, F.lit("")))
    whole = low if nearby is None else F.concat_ws(" ", low, F.lower(nearby))
    out = F.lit("sale")
    if token is not None:
        t = F.lower(token)
        number = r"(\d{1,4}(?:[,.]\d{1,3})?)"
        units = rf"(?<!\d){number}\s*(?:{'|'.join(AMOUNT_UNITS)})(?![\p{{L}}\p{{N}}_])"
        times = rf"(?<![\p{{L}}\p{{N}}_])\d{{1,3}}\s*[x×]\s*{number}(?![\p{{L}}\p{{N}}_])"
        packed = rf"(?<![\p{{L}}\p{{N}}_])(?:{'|'.join(PACKAGING_WORDS)})\s*:?\s*{number}(?![\p{{L}}\p{{N}}_])"
        deposit = r"(\d{1,4}(?:[,.]\d{1,2})?)\s*(?:€|eur)?\s*pfand(?![\p{L}\p{N}_])"
        package_amount = same_amount(low, units, t) | same_amount(low, times, t) | same_amount(low, packed, t)
        currency = low.rlike(rf"€|{_whole('eur')}")
        out = F.when(same_amount(low, deposit, t), "deposit").when(package_amount & ~currency, "package").otherwise(out)
    for name, pattern in reversed(context_patterns().items()):
        out = F.when(whole.rlike(pattern), name).otherwise(out)
    return out


def canonical_cents(c: Column) -> Column:
    """Cents of text that is money in canonical form (no sign, no leading zeros, two decimals); null otherwise."""
    return F.when(c.rlike(r"^(0|[1-9]\d{0,6})\.\d{2}$"), F.replace(c, F.lit("."), F.lit("")).try_cast("long"))


def day_of(c: Column) -> Column:
    """A day from text that is an ISO date or seconds since 1970 (in UTC); null otherwise."""
    seconds = F.when(c.rlike(r"^\d{9,10}$"), F.to_date(F.timestamp_seconds(c.try_cast("long"))))
    return F.coalesce(F.when(c.rlike(r"^\d{4}-\d{2}-\d{2}$"), c.try_cast("date")), seconds)


def bundle(c: Column) -> Column:
    """struct(count, cents) of "N für P"."""
    p = r"(\d{1,2}) für (\d{1,4}),(\d{2})"
    n = [F.regexp_extract(c, p, i).try_cast("int") for i in (1, 2, 3)]
    return F.when(c.rlike(p), F.struct(n[0].alias("count"), (n[1] * 100 + n[2]).cast("long").alias("cents")))


def only_one(values: Column) -> Column:
    """The one distinct value of an array; null for none or several."""
    known = F.array_distinct(F.filter(values, lambda v: v.isNotNull()))
    return F.when(F.size(known) == 1, known[0])
