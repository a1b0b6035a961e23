"""Micro-batch variants: file streams read until nothing is left, with state in a checkpoint."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pricelode.shared import shared_path


def run_to_end(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Write all that the stream has now; another call with the same checkpoint takes up where this one ended."""
    stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start().awaitTermination()


def deduplicated(events: DataFrame, keys: list[str], time: str, late: str) -> DataFrame:
    """Each key once; keys are forgotten when ``late`` behind, so state stays bounded."""
    return events.withWatermark(time, late).dropDuplicatesWithinWatermark(keys)


def offers_by_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, latest time and least price of each offer: per-batch partial aggregates are appended by a stream, and
    merged when read, so replays and restarts add nothing twice."""
    folder = shared_path(spark, "stream")
    source = f"{sf_dir}/events.parquet"
    read = spark.read.parquet(source)
    stream = spark.readStream.schema(read.schema)
    if all(f.endswith("/events.parquet") for f in read.inputFiles()):  # a table of one file: a stream reads folders
        events = stream.option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    else:
        events = stream.parquet(source)

    def merge(batch: DataFrame, number: int) -> None:
        part = batch.groupBy(F.col("event_type").alias("chain"), F.col("user_id").alias("offer")).agg(F.count(F.lit(1)).alias("n"), F.max("ts").alias("latest"), F.min(F.round(F.col("value") * 100).cast("long")).alias("least"))
        part.write.mode("overwrite").parquet(f"{folder}/out/batch={number}")  # a batch run again replaces itself

    events.writeStream.foreachBatch(merge).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    parts = spark.read.parquet(f"{folder}/out")
    return parts.groupBy("chain", "offer").agg(F.sum("n").alias("n"), F.max("latest").alias("latest"), F.min("least").alias("least"))
