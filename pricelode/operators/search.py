"""Faceted search: substring search over several columns, feature flags, composite sort keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SORTS = ("name", "price_asc", "price_desc", "newest", "discount_desc")


def folded(c: str) -> Column:
    """Case folding for search: lower case, sharp s as ss, null as empty."""
    return F.replace(F.lower(F.coalesce(F.col(c), F.lit(""))), F.lit("ß"), F.lit("ss"))


def contains_text(needle: str, columns: list[str]) -> Column:
    hit = F.lit(False)
    for c in columns:
        hit = hit | folded(c).contains(needle.lower().replace("ß", "ss"))
    return hit


def has_app() -> Column:
    return F.col("app_cents").isNotNull() | F.col("requires_app")


def has_discount() -> Column:
    return F.coalesce(F.col("regular_cents") > F.col("cents"), F.lit(False)) | F.coalesce(F.col("percent") > 0, F.lit(False))


def saving() -> Column:
    return F.greatest(F.coalesce(F.col("regular_cents") - F.col("cents"), F.lit(0).cast("long")), F.lit(0).cast("long"))


def has_image() -> Column:
    """An empty link is no image."""
    return F.coalesce(F.col("image"), F.lit("")) != ""


def unit_basis() -> Column:
    return F.coalesce(F.col("mode").isin("unit_basis", "example_weight", "variable_weight"), F.lit(False))


def sort_key(sort: str) -> list[Column]:
    """The composite key of a sort order, made unique by the id."""
    name = folded("name")
    keys = {
        "price_asc": [F.col("cents"), name, F.col("chain")],
        "price_desc": [F.desc("cents"), name, F.col("chain")],
        "newest": [F.desc("collected_at"), name, F.col("chain")],
        "discount_desc": [F.desc(saving()), F.desc(F.coalesce("percent", F.lit(0))), F.col("cents"), name],
        "name": [name, folded("brand"), F.col("cents"), F.col("chain"), F.coalesce("store", F.lit("")), F.col("offer")],
    }
    return [*keys[sort], F.col("id")]
