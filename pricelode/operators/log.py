"""The append-only log: idempotent appends, exact sets, plans of action, and state folded from events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def new_rows(batch: DataFrame, existing: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of the batch whose key is not there yet; of equal keys within the batch none is taken twice."""
    same = [batch[k].eqNullSafe(existing[k]) for k in keys]
    condition = same[0]
    for c in same[1:]:
        condition = condition & c
    return batch.join(existing, condition, "left_anti").dropDuplicates(keys)


def exact_set(batch: DataFrame, existing: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """One row: how many keys are new, the same, conflicting, and missing; a replay has the same ones only."""
    a = batch.select(*keys, F.struct(*values).alias("_a"))
    b = existing.select(*keys, F.struct(*values).alias("_b"))
    both = a.join(b, keys, "full")
    return both.agg(
        F.count_if(F.col("_b").isNull()).alias("new"), F.count_if(F.col("_a").isNotNull() & F.col("_b").isNotNull() & (F.col("_a") == F.col("_b"))).alias("same"),
        F.count_if(F.col("_a").isNotNull() & F.col("_b").isNotNull() & (F.col("_a") != F.col("_b"))).alias("conflicting"), F.count_if(F.col("_a").isNull()).alias("missing"),
    )


def plan(batch: DataFrame, existing: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Per row of the batch CREATE, NO_OP_IDENTICAL or CONFLICT with the columns that differ, sorted."""
    old = existing.select(*keys, *(F.col(v).alias(f"_{v}") for v in values), F.lit(True).alias("_there"))
    joined = batch.join(old, keys, "left")
    differ = F.array_sort(F.array_compact(F.array(*(F.when(~F.col(v).eqNullSafe(F.col(f"_{v}")), F.lit(v)) for v in values))))
    action = F.when(F.col("_there").isNull(), "CREATE").when(F.size(differ) == 0, "NO_OP_IDENTICAL").otherwise("CONFLICT")
    why = F.when(F.col("_there").isNull(), F.lit("")).otherwise(F.array_join(differ, ","))
    return joined.select(*keys, action.alias("action"), why.alias("differ"))


def folded(events: DataFrame, key: str, order: str, state: str) -> DataFrame:
    """Latest state and number of revisions from an event log."""
    return events.groupBy(key).agg(F.max_by(state, order).alias("status"), F.count(F.lit(1)).alias("revisions"), F.max(order).alias("last_revision"))


def append_batch(spark: SparkSession, batch: DataFrame, path: str, keys: list[str]) -> int:
    """Append what is new to the Parquet log at ``path``; a replay of a batch writes nothing.  Returns the rows written."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    there = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop)
    existing = spark.read.schema(batch.schema).parquet(path) if there else spark.createDataFrame([], batch.schema)
    fresh = new_rows(batch, existing, keys).persist()
    try:
        count = fresh.count()
        if count:
            fresh.write.mode("append").parquet(path)
        return count
    finally:
        fresh.unpersist()
