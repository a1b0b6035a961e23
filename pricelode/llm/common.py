"""Shared helpers: written tables in the cluster's shared folder, row keys, byte slices of Arrow batches."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pricelode.shared import shared_dir


def new_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{tag}-{uuid.uuid4().hex}"


def staged(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back: it cuts lineage, and its size is known."""
    spark = df.sparkSession
    path = new_path(spark, tag)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


class Scratch:
    """Tables that are only needed until a result is written: gone when the ``with`` block ends."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths, self.names = spark, [], []

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_: object) -> None:
        for name in self.names:
            self.spark.sql(f"drop table if exists {name}")
        hadoop = self.spark._jvm.org.apache.hadoop.fs.Path
        for path in self.paths:
            where = hadoop(path)
            where.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(where, True)

    def path(self, tag: str) -> str:
        self.paths.append(new_path(self.spark, tag))
        return self.paths[-1]

    def staged(self, df: DataFrame, tag: str) -> DataFrame:
        path = self.path(tag)
        df.write.option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def bucketed(self, df: DataFrame, tag: str, *keys: str) -> DataFrame:
        """A table whose joins on ``keys`` need no shuffle."""
        name = f"{tag}_{uuid.uuid4().hex}"
        self.names.append(name)
        writer = df.write.bucketBy(partitions(self.spark), *keys).sortBy(*keys)
        writer.option("path", self.path(tag)).option("compression", "zstd").saveAsTable(name)
        return self.spark.table(name)

    def kept(self, df: DataFrame, tag: str) -> DataFrame:
        """A result: written like the others, but it stays."""
        return staged(df, tag)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def text_key(text: Column) -> tuple[Column, Column]:
    """Two independent 64-bit hashes of a text; together a 128-bit identity of its content."""
    return F.xxhash64(text), F.xxhash64(F.lit("k2"), text)


def only_rows(docs: DataFrame, keep: DataFrame) -> DataFrame:
    """One row of ``docs`` for each of ``keep(doc_id, k1, k2)``, doc_id and text keys (of text, null as it is).  Equal rows
    are told apart after the join, where they lie together already, so texts are shuffled once."""
    k1, k2 = text_key(F.col("text"))
    name = F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("__id")
    keyed = docs.withColumns({"__id": F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "__k1": k1, "__k2": k2})
    wanted = keep.select(name, F.col("k1").alias("__k1"), F.col("k2").alias("__k2"))
    return keyed.join(wanted, ["__id", "__k1", "__k2"], "left_semi").dropDuplicates(["__id", "__k1", "__k2"]).select(*docs.columns)


def text_bytes(value: str | None) -> bytes:
    return value.encode("utf-8", "surrogatepass") if value else b""


def slices(batches: Iterator[pa.RecordBatch], column: str, most: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """Cut record batches so that ``column`` holds about ``most`` bytes in each (one row at least)."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        sizes = pa.compute.fill_null(pa.compute.binary_length(batch.column(column)), 0).to_pylist()
        begin, held = 0, 0
        for i, n in enumerate(sizes):
            if i > begin and held + n > most:
                yield batch.slice(begin, i - begin)
                begin, held = i, 0
            held += n
        yield batch.slice(begin)
