"""Imports that are there as a whole or not at all: immutable data folders and a log of manifests.

A table is a folder.  ``data/<random name>`` holds the files of one import, written by Spark; ``log/<version>.json`` is the
manifest of a commit and names one data folder, its snapshot, counts and digests.  Readers see the folders that manifests name and
nothing else, so a write that dies leaves nothing but an unnamed folder, which ``vacuum`` removes.  A manifest is published by
one put-if-absent (a rename that does not overwrite), so of writers that compete for a version one wins; the others read
the log again and try the next version, after the same checks against what has been committed meanwhile.

Each manifest carries the digest of the one before and of itself; a log that does not add up is refused.  The manifests are
read on the driver: a row for each import, however large.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Sequence
from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

ATTEMPTS = 20


class ImportRejected(ValueError):
    """The import breaks a rule; nothing of it is visible."""


@dataclass(frozen=True)
class Receipt:
    """What an import did: ``committed``, ``replayed`` (all rows were there, none written) or ``reused``."""

    state: str
    snapshot: str
    version: int
    written: int
    rows: int


def _path(spark: SparkSession, path: str):  # noqa: ANN202
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark._jsc.hadoopConfiguration())


def put_if_absent(spark: SparkSession, path: str, text: str) -> bool:
    """Publish a small file in one step unless there is one of the name; whether this call did it."""
    jvm = spark._jvm
    target, fs = _path(spark, path)
    fs.mkdirs(target.getParent())
    draft = jvm.org.apache.hadoop.fs.Path(target.getParent(), f".{uuid.uuid4().hex}.tmp")
    out = fs.create(draft, True)
    out.write(bytearray(text.encode()))
    out.close()
    try:
        if fs.getScheme() == "file":  # a local rename overwrites, a link does not
            local = lambda p: jvm.java.io.File(p.toUri().getPath()).toPath()
            jvm.java.nio.file.Files.createLink(local(target), local(draft))
        else:
            kind = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
            options = spark.sparkContext._gateway.new_array(kind, 1)
            options[0] = kind.valueOf("NONE")
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), spark._jsc.hadoopConfiguration()).rename(draft, target, options)
        return True
    except Py4JJavaError as e:
        if "AlreadyExists" in e.java_exception.getClass().getName():
            return False
        raise
    finally:
        fs.delete(draft, False)


def canonical(manifest: dict) -> str:
    """Bytes of a manifest that its digest covers: keys in order, no blanks, without the digest."""
    return json.dumps({k: v for k, v in manifest.items() if k != "sha256"}, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def digest(manifest: dict) -> str:
    return hashlib.sha256(canonical(manifest).encode()).hexdigest()


def manifests(spark: SparkSession, path: str) -> list[dict]:
    """All commits in order; a gap, a changed manifest or a broken chain of digests is an error."""
    where, fs = _path(spark, f"{path}/log")
    if not fs.exists(where):
        return []
    lines = spark.read.option("wholetext", True).option("pathGlobFilter", "*.json").text(f"{path}/log").collect()
    found = sorted((json.loads(r[0]) for r in lines), key=lambda m: m["version"])
    before = ""
    for number, m in enumerate(found, 1):
        if m["version"] != number or m["sha256"] != digest(m) or m["previous"] != before:
            raise ImportRejected(f"the log is not whole at version {number}")
        before = m["sha256"]
    return found


def committed(spark: SparkSession, path: str, schema: StructType, version: int | None = None, snapshot: str | None = None) -> DataFrame:
    """Rows of the table as of ``version`` (all), of one snapshot (all)."""
    folders = [f"{path}/data/{m['folder']}" for m in manifests(spark, path) if (version is None or m["version"] <= version) and (snapshot is None or m["snapshot"] == snapshot)]
    return spark.read.schema(schema).parquet(*folders) if folders else spark.createDataFrame([], schema)


def content_digest(columns: Sequence[str]) -> list[Column]:
    """Aggregates that tell a multiset of rows by its content, not its order: count and two sums of hashes."""
    return [F.count(F.lit(1)).alias("rows"), *(F.sum(F.xxhash64(F.lit(i), *columns).cast("decimal(38,0)")).alias(f"sum{i}") for i in (1, 2))]


def differences(new: DataFrame, old: DataFrame, key: str, values: Sequence[str], optional: Sequence[str] = ()) -> dict[str, int]:
    """How many keys are new, missing, the same or conflicting; null in a stored ``optional`` column matches anything."""
    a = new.select(F.col(key).alias("_k"), F.struct(*values).alias("_new"))
    b = old.select(F.col(key).alias("_k"), F.struct(*values).alias("_old"))
    same = F.lit(True)
    for v in values:
        equal = F.col(f"_new.{v}").eqNullSafe(F.col(f"_old.{v}"))
        same = same & (equal | F.col(f"_old.{v}").isNull() if v in optional else equal)
    both = F.col("_new").isNotNull() & F.col("_old").isNotNull()
    row = a.join(b, "_k", "full").agg(
        F.count_if(F.col("_old").isNull()).alias("new"), F.count_if(F.col("_new").isNull()).alias("missing"),
        F.count_if(both & same).alias("same"), F.count_if(both & ~same).alias("conflicting"),
    ).first()
    return row.asDict()


def _faults(rows: DataFrame, snapshot: str, snapshot_column: str, key: str, expected: int | None) -> list[str]:
    """Broken rules of a batch: one snapshot, canonical keys, each once, as many as announced."""
    id_ = F.col(key)
    blank = F.coalesce(F.trim(id_) != id_, F.lit(True)) | (F.trim(id_) == "")
    found = rows.agg(
        F.count(F.lit(1)).alias("n"), F.count_if(~F.col(snapshot_column).eqNullSafe(F.lit(snapshot))).alias("others"), F.count_if(blank).alias("blank"),
    ).first()
    twice = rows.groupBy(key).count().filter("count > 1").count()
    checks = [
        (found["others"], f"{found['others']} rows are of another snapshot"), (found["blank"], f"{found['blank']} keys are not canonical"), (twice, f"{twice} keys come twice"),
        (expected is not None and found["n"] != expected, f"{found['n']} rows instead of {expected}"),
    ]
    return [text for broken, text in checks if broken]


def _drop(spark: SparkSession, path: str) -> None:
    where, fs = _path(spark, path)
    fs.delete(where, True)


def import_snapshot(
    batch: DataFrame, path: str, snapshot: str, key: str, values: Sequence[str], snapshot_column: str = "snapshot", expected: int | None = None,
    optional: Sequence[str] = (), extra: dict | None = None,
) -> Receipt:
    """Commit a batch of one snapshot, or nothing.

    The batch is written to a folder of its own and checked there, so what is checked is what is published: one snapshot,
    keys (strings) without blanks around them and each once, ``expected`` rows.  A snapshot that is there already must have
    exactly these keys and ``values``; then nothing is written.  Anything else raises ``ImportRejected``.  An empty batch is not written."""
    spark = batch.sparkSession
    folder = uuid.uuid4().hex
    own = f"{path}/data/{folder}"
    kept = False
    try:
        batch.write.parquet(own)
        rows = spark.read.schema(batch.schema).parquet(own)
        if faults := _faults(rows, snapshot, snapshot_column, key, expected):
            raise ImportRejected("; ".join(faults))
        told = rows.agg(*content_digest([key, *values])).first()
        for _ in range(ATTEMPTS):
            log = manifests(spark, path)
            if there := [m for m in log if m["snapshot"] == snapshot]:
                found = differences(rows, committed(spark, path, batch.schema, snapshot=snapshot), key, values, optional)
                if found["new"] or found["missing"] or found["conflicting"]:
                    raise ImportRejected(f"snapshot {snapshot} is there with other rows: {found}")
                return Receipt("replayed", snapshot, there[0]["version"], 0, found["same"])
            if not told["rows"]:
                return Receipt("replayed", snapshot, len(log), 0, 0)
            manifest = {
                "version": len(log) + 1, "snapshot": snapshot, "folder": folder, "rows": told["rows"], "content": f"{told['sum1']}:{told['sum2']}",
                "previous": log[-1]["sha256"] if log else "", **(extra or {}),
            }
            manifest["sha256"] = digest(manifest)
            if put_if_absent(spark, f"{path}/log/{manifest['version']:020d}.json", json.dumps(manifest, sort_keys=True, ensure_ascii=False)):
                kept = True
                return Receipt("committed", snapshot, manifest["version"], told["rows"], told["rows"])
        raise ImportRejected(f"other writers won {ATTEMPTS} times")
    finally:
        if not kept:
            _drop(spark, own)


def import_content(batch: DataFrame, path: str, source: str, window: str, key: str, values: Sequence[str]) -> Receipt:
    """Commit the content of a source under the name of what it holds; if the source's last commit has the same content, count and window,
    it is used again and nothing is written.  Order of rows does not matter."""
    told = batch.agg(*content_digest([key, *values])).first()
    content = f"{told['sum1']}:{told['sum2']}"
    before = [m for m in manifests(batch.sparkSession, path) if m.get("source") == source]
    if before and (before[-1]["content"], before[-1]["rows"], before[-1]["window"]) == (content, told["rows"], window):
        return Receipt("reused", before[-1]["snapshot"], before[-1]["version"], 0, told["rows"])
    name = hashlib.sha256(f"{source}|{len(before)}|{window}|{content}|{told['rows']}".encode()).hexdigest()
    named = batch.withColumn("snapshot", F.lit(name))
    return import_snapshot(named, path, name, key, values, expected=told["rows"], extra={"source": source, "window": window})


def vacuum(spark: SparkSession, path: str, hours: float = 24.0) -> int:
    """Delete data folders that no manifest names and that were begun more than ``hours`` ago; how many."""
    import time

    where, fs = _path(spark, f"{path}/data")
    if not fs.exists(where):
        return 0
    named = {m["folder"] for m in manifests(spark, path)}
    old = [s for s in fs.listStatus(where) if s.getPath().getName() not in named and s.getModificationTime() / 1000 <= time.time() - hours * 3600]
    for s in old:
        fs.delete(s.getPath(), True)
    return len(old)
