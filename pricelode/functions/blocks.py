"""Prices, packages and names in the lines of a text block, as Column expressions.  Prices are whole cents."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words of a regular price, of a deposit, and units of an amount and of a unit price.
REGULAR = "UVP|statt"
DEPOSIT = "Pfand"
AMOUNT = r"(\d+(?:[.,]\d+)?) ?(kg|g|ml|l)\b"
UNIT_PRICE = r"\(1 (kg|l) = (\d+[.,]\d\d)\)"
MONEY = r"\d{1,4}[.,]\d\d"


def cents(c: Column) -> Column:
    """Cents of ``1,99`` or ``1.99``; null for other text."""
    return F.when(c.rlike(f"^{MONEY}$"), F.regexp_replace(c, "[.,]", "").try_cast("long"))


def lines(c: Column) -> Column:
    """The lines of a block, trimmed; blank ones are left out."""
    return F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), "\n"), lambda x: F.trim(x)), lambda x: x != "")


def standalone_prices(rows: Column) -> Column:
    """Prices that are a line of their own, in order."""
    return F.filter(F.transform(rows, cents), lambda x: x.isNotNull())


def primary_price(rows: Column) -> Column:
    """The last price that is a line of its own."""
    found = standalone_prices(rows)
    return F.get(found, F.size(found) - 1)


def regular_price(rows: Column) -> Column:
    """The largest price on lines with a word of a regular price."""
    told = F.array_join(F.filter(rows, lambda x: x.rlike(REGULAR)), " ")
    return F.array_max(F.transform(F.regexp_extract_all(told, F.lit(f"({MONEY})"), 1), cents))


def deposit(c: Column) -> Column:
    return cents(F.regexp_extract(c, rf"{DEPOSIT} ({MONEY})", 1))


def unit_price(c: Column) -> tuple[Column, Column]:
    """Cents, and the unit they are for."""
    return cents(F.regexp_extract(c, UNIT_PRICE, 2)), F.nullif(F.regexp_extract(c, UNIT_PRICE, 1), F.lit(""))


def package_line(rows: Column) -> Column:
    """Place (from 1) of the first line with an amount that is not in brackets, as unit prices are; 0 for none."""
    return F.coalesce(F.array_position(F.transform(rows, lambda x: x.rlike(AMOUNT) & ~F.startswith(x, F.lit("("))), True), F.lit(0)).cast("int")


def package(rows: Column, at: Column) -> Column:
    """The amount in the line at a place."""
    return F.when(at > 0, F.regexp_extract(F.get(rows, at - 1), AMOUNT, 0))


def joined_name(rows: Column, at: Column) -> Column:
    """The lines before a place as one name.  A hyphen at a line's end stays unless the next line goes on in lower case."""

    def add(name: Column, x: Column) -> Column:
        small = F.substring(x, 1, 1).rlike(r"^\p{Ll}")
        bare = F.substring(name, F.lit(1), F.length(name) - 1)
        return F.when(name == "", x).when(~F.endswith(name, F.lit("-")), F.concat(name, F.lit(" "), x)).when(small, F.concat(bare, x)).otherwise(F.concat(name, x))

    return F.nullif(F.aggregate(F.slice(rows, 1, F.greatest(at - 1, F.lit(0))), F.lit(""), add), F.lit(""))
