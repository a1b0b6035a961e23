"""Where two states of a table differ: trees of digests, of which only unlike branches are looked at again."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pricelode.shared import written

#: A node has 2**BITS children; the leaves are on level LEVELS.
BITS, LEVELS = 4, 4


def leaf(keys: Sequence[str], levels: int = LEVELS) -> Column:
    """Number of a row's leaf: the first bits of a hash of its keys, so leaves are alike in size whatever the keys are."""
    return F.shiftrightunsigned(F.xxhash64(*keys), 64 - BITS * levels)


def content(columns: Sequence[str]) -> list[Column]:
    """Aggregates that tell a multiset of rows: how many, and two sums of hashes."""
    return [F.count(F.lit(1)).alias("n"), *(F.sum(F.xxhash64(F.lit(i), *columns).cast("decimal(38,0)")).alias(f"d{i}") for i in (1, 2))]


def laid_out(rows: DataFrame, keys: Sequence[str], levels: int = LEVELS) -> DataFrame:
    """The rows written in the order of their leaves, so that a filter on leaves skips files."""
    return written(rows.withColumn("_leaf", leaf(keys, levels)).repartitionByRange("_leaf").sortWithinPartitions("_leaf"), "leaves")


def tree(laid: DataFrame, keys: Sequence[str], values: Sequence[str], levels: int = LEVELS) -> DataFrame:
    """level (0 is the root), node, n, d1, d2 of a table that ``laid_out`` has written.  Rows are read once; a level is summed
    from the one below."""
    below = written(laid.groupBy(F.col("_leaf").alias("node")).agg(*content([*keys, *values])), "digests")
    out = below.select(F.lit(levels).alias("level"), "node", "n", "d1", "d2")
    for level in reversed(range(levels)):
        up = below.groupBy(F.shiftrightunsigned("node", BITS * (levels - level)).alias("node")).agg(*(F.sum(c).alias(c) for c in ("n", "d1", "d2")))
        out = out.unionByName(up.select(F.lit(level).alias("level"), "node", "n", F.col("d1").cast("decimal(38,0)").alias("d1"), F.col("d2").cast("decimal(38,0)").alias("d2")))
    return written(out, "tree")


def unlike(a: DataFrame, b: DataFrame, levels: int = LEVELS) -> DataFrame:
    """level, node of the nodes that differ, found from the root down: a node is compared if the one above it differs.

    Without a difference the comparison ends at the root; else a level looks at 2**BITS children of each unlike node."""
    found, above = None, None
    for level in range(levels + 1):
        own, other = a.filter(F.col("level") == level), b.filter(F.col("level") == level)
        if above is not None:
            open_ = above.select(F.col("node").alias("_up"))
            under = F.shiftrightunsigned("node", BITS) == F.col("_up")
            own, other = own.join(open_, under, "left_semi"), other.join(open_, under, "left_semi")
        y = other.select(F.col("node").alias("_node"), F.struct("n", "d1", "d2").alias("_y"))
        both = own.select("node", F.struct("n", "d1", "d2").alias("_x")).join(y, F.col("node") == F.col("_node"), "full")
        above = written(both.filter(~F.col("_x").eqNullSafe(F.col("_y"))).select(F.lit(level).alias("level"), F.coalesce("node", "_node").alias("node")), "unlike")
        found = above if found is None else found.unionByName(above)
        if above.isEmpty():
            break
    return found


def differences(old: DataFrame, new: DataFrame, keys: Sequence[str], values: Sequence[str], levels: int = LEVELS) -> DataFrame:
    """keys and kind (added, removed, changed) of the rows that differ, for tables with one row for each key (keys not null).  Rows
    are compared in unlike leaves only."""
    a, b = laid_out(old.select(*keys, *values), keys, levels), laid_out(new.select(*keys, *values), keys, levels)
    leaves = unlike(tree(a, keys, values, levels), tree(b, keys, values, levels), levels).filter(F.col("level") == levels).select(F.col("node").alias("_leaf"))
    x = a.join(leaves, "_leaf", "left_semi").select(*keys, F.struct(*values).alias("_x"))
    y = b.join(leaves, "_leaf", "left_semi").select(*(F.col(k).alias(f"_{k}") for k in keys), F.struct(*values).alias("_y"))
    same = F.lit(True)
    for k in keys:
        same = same & (F.col(k) == F.col(f"_{k}"))
    both = x.join(y, same, "full").filter(~F.col("_x").eqNullSafe(F.col("_y")))
    kind = F.when(F.col("_x").isNull(), "added").when(F.col("_y").isNull(), "removed").otherwise("changed")
    return both.select(*(F.coalesce(k, f"_{k}").alias(k) for k in keys), kind.alias("kind"))


def canonical(report: dict) -> bytes:
    """The bytes that a report's digest covers: keys in order, no blanks, UTF-8, without the digest itself."""
    return json.dumps({k: v for k, v in report.items() if k != "digest"}, sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()


def sealed(report: dict) -> dict:
    """The report with the digest of its canonical bytes."""
    return {**report, "digest": hashlib.sha256(canonical(report)).hexdigest()}


def opened(report: dict) -> dict:
    """The report, refused if it is not what its digest says."""
    if report.get("digest") != hashlib.sha256(canonical(report)).hexdigest():
        raise ValueError("the report is not what its digest says")
    return report
