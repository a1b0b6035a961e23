"""Places of rows in an order, also where one group holds a large share of all rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pricelode.shared import written


def numbered(rows: DataFrame, name: str, order: Sequence[Column], groups: Sequence[str] = ()) -> DataFrame:
    """``rows`` with the place (from 1) of each in its group by ``order``, which must tell any two rows apart.

    Rows are dealt by ranges of group and order, so a group spreads over as many tasks as it needs.  Each range is numbered
    by itself; what lies before it in its group comes from the counts, a row for each group and range.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = written(rows.repartitionByRange(parts, *(F.col(g) for g in groups), *order).withColumn("_range", F.spark_partition_id()), "ranges")
    sizes = dealt.groupBy(*groups, "_range").agg(F.count(F.lit(1)).alias("_n"))
    so_far = Window.partitionBy(*groups).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    before = sizes.select(*(F.col(g).alias(f"_of_{g}") for g in groups), F.col("_range").alias("_of_range"), F.coalesce(F.sum("_n").over(so_far), F.lit(0)).alias("_before"))
    same = F.col("_range") == F.col("_of_range")
    for g in groups:
        same = same & F.col(g).eqNullSafe(F.col(f"_of_{g}"))
    place = F.row_number().over(Window.partitionBy(*groups, "_range").orderBy(*order))
    joined = dealt.withColumn("_place", place).join(before, same)
    return joined.select(*rows.columns, (F.col("_place") + F.col("_before")).alias(name))
