"""Nested JSON that no path can name beforehand: a walker as a table function, and deterministic ids."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pricelode.functions.text import CODE_KEYS, gtin14


def walk(value: object, path: str = "$") -> Iterator[tuple[str, str, str | None]]:
    """(path, key, scalar text) of every key of every object, in document order."""
    if isinstance(value, dict):
        for k, v in value.items():
            own = f"{path}.{k}"
            yield own, k, None if isinstance(v, dict | list) or v is None else str(v)
            yield from walk(v, own)
    elif isinstance(value, list):
        for i, v in enumerate(value):
            yield from walk(v, f"{path}[{i}]")


def walked(df: DataFrame, key: str, column: str) -> DataFrame:
    """key, place, path, name, value of every key in the JSON of ``column``; text that is no JSON gives none."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for k, body in zip(frame[key], frame[column], strict=True):
                try:
                    found = json.loads(body) if body else None
                except ValueError:
                    found = None
                rows += [(k, i, *x) for i, x in enumerate(walk(found))]
            yield pd.DataFrame(rows, columns=[key, "place", "path", "name", "value"])

    return df.select(key, column).mapInPandas(run, f"{key} {df.schema[key].dataType.simpleString()}, place int, path string, name string, value string")


def explicit_codes(df: DataFrame, key: str, column: str) -> DataFrame:
    """First key that names a product code and holds a right one: key, gtin, path."""
    name = F.regexp_replace(F.lower("name"), "[^a-z0-9]+", "")
    hits = walked(df, key, column).filter(name.isin(CODE_KEYS)).withColumn("gtin", gtin14(F.col("value"))).filter("gtin is not null")
    return hits.groupBy(key).agg(F.min(F.struct("place", "gtin", "path")).alias("m")).select(key, "m.gtin", "m.path")


@F.pandas_udf(T.StringType())
def uuid5(namespace: pd.Series, name: pd.Series) -> pd.Series:
    return pd.Series([str(uuid.uuid5(uuid.UUID(n), x)) for n, x in zip(namespace, name, strict=True)])


def uuid5_column(namespace: str, name: Column) -> Column:
    """The same id from built-in functions: sha1 of namespace and name, version and variant bits set."""
    space = uuid.UUID(namespace).hex
    h = F.substring(F.sha1(F.concat(F.unhex(F.lit(space)), name.cast("binary"))), 1, 32)
    part = lambda a, n: F.substring(h, a, n)
    variant = F.lower(F.hex((F.conv(part(17, 1), 16, 10).cast("int") % 4) + 8))
    return F.concat(part(1, 8), F.lit("-"), part(9, 4), F.lit("-5"), part(14, 3), F.lit("-"), variant, part(18, 3), F.lit("-"), part(21, 12))

