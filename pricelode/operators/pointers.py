"""References between nodes of documents, followed to their ends by jumps that double."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricelode.shared import written

DEEPEST = 10


def chased(nodes: DataFrame, deepest: int = DEEPEST) -> DataFrame:
    """doc, node, last, steps, outcome for ``nodes(doc, node, target)``, of which each document has a node once.

    A node whose target is null, or no node of the document, is an end.  ``last`` is the end that a node leads to: itself,
    or what its target leads to.  Each round looks up the nodes that are not at an end yet and doubles their steps, so chains of n steps take
    log n rounds, a node that has its end is written once, and what is open after a round in which none came to its end
    runs in a circle: outcome
    ``cycle``, last and steps null.  Chains of over ``deepest`` steps are ``too_deep``."""
    own = nodes.select("doc", "node", "target")
    there = own.select(F.col("doc").alias("_d"), F.col("node").alias("_n"))
    known = own.join(there, F.col("doc").eqNullSafe(F.col("_d")) & (F.col("target") == F.col("_n")), "left")
    at = written(known.select("doc", "node", F.coalesce("_n", "node").alias("last"), F.col("_n").isNotNull().cast("long").alias("steps"), F.col("_n").isNotNull().alias("open")), "pointers")
    ended, left = at.filter("not open"), at.filter("open")
    while not left.isEmpty():
        to = ended.union(left).select(F.col("doc").alias("_d"), F.col("node").alias("_n"), F.col("last").alias("_last"), F.col("steps").alias("_steps"), F.col("open").alias("_open"))
        joined = left.join(to, F.col("doc").eqNullSafe(F.col("_d")) & (F.col("last") == F.col("_n")))
        moved = written(joined.select("doc", "node", F.col("_last").alias("last"), (F.col("steps") + F.col("_steps")).alias("steps"), F.col("_open").alias("open")), "pointers")
        fresh, left = moved.filter("not open"), moved.filter("open")
        if fresh.isEmpty():  # every jump from an open node leads to an open one, so none of them ever ends
            break
        ended = ended.union(fresh)
    at = ended.union(left)
    outcome = F.when(F.col("open"), "cycle").when(F.col("steps") > deepest, "too_deep").otherwise("resolved")
    return at.select("doc", "node", F.when(~F.col("open"), F.col("last")).alias("last"), F.when(~F.col("open"), F.col("steps")).alias("steps"), outcome.alias("outcome"))


def payload_nodes(df: DataFrame, doc: str, payload: str) -> DataFrame:
    """doc, node, target, value (JSON) of each element of a JSON array in which a whole number that is an index of the array
    refers to that element.  Text that is no JSON array gives none."""
    array = df.select(F.col(doc).alias("doc"), F.try_variant_get(F.try_parse_json(F.col(payload)), "$", "array<variant>").alias("a"))
    each = array.select("doc", F.size("a").alias("n"), F.posexplode("a").alias("node", "v"))
    index = F.when(F.schema_of_variant("v") == "BIGINT", F.try_variant_get("v", "$", "bigint"))
    return each.select("doc", "node", F.when((index >= 0) & (index < F.col("n")), index.cast("int")).alias("target"), F.to_json("v").alias("value"))
