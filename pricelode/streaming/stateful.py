"""Keyed state over streams with Spark's ``transformWithState``: a state machine, and records that a key carries on.

State lives in the checkpoint; a stream that is started again on it goes on where it ended.  Both need the RocksDB state
store (``with_store``).  What a key's rows of one micro-batch are is held together, what came before is only its state.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from pricelode.operators.machine import APPLIED, REVIEW, Machine
from pricelode.shared import shared_path, written

STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def with_store(spark: SparkSession, partitions: int | None = None) -> Iterator[None]:
    """Streams started inside use the RocksDB store and at most so many state partitions (two a core, unless told); settings
    come back after."""
    partitions = partitions or max(4, 2 * spark.sparkContext.defaultParallelism)
    own = {"spark.sql.streaming.stateStore.providerClass": STORE, "spark.sql.shuffle.partitions": str(min(partitions, int(spark.conf.get("spark.sql.shuffle.partitions"))))}
    before = {k: spark.conf.get(k, None) for k in own}
    for k, v in own.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


class MachineProcessor(StatefulProcessor):
    """Rows (item, seq, action) to rows (item, seq, action, from_state, to_state, verdict, revision).

    An event that does not come after the item's last (by seq) is ``late`` and changes nothing.  With ``idle`` days, an item
    in one of ``waiting`` states without an event for so long by the watermark is reported once by a row with action ``idle``."""

    def __init__(self, machine: Machine, idle: int | None = None, waiting: tuple[str, ...] = ()):
        self.machine, self.idle, self.waiting = machine, idle, waiting

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", "state string, revision long, seq string, due long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        frame = pd.concat(list(rows)).sort_values("seq", kind="stable")
        state, revision, last, due = self.held.get() if self.held.exists() else (self.machine.states[0], 0, "", 0)
        out = []
        for seq, action in zip(frame["seq"], frame["action"], strict=True):
            action = None if pd.isna(action) else action
            after, verdict = self.machine.move(state, action) if seq > last else (state, "late")
            revision += verdict == APPLIED
            out.append((key[0], seq, action, state, after, verdict, revision))
            state, last = after, max(last, seq)
        if self.idle is not None:
            if due:
                self.handle.deleteTimer(due)
            due = int(frame["at"].max().timestamp() * 1000) + self.idle * 86_400_000 if state in self.waiting else 0
            if due:
                self.handle.registerTimer(due)
        self.held.update((state, revision, last, due))
        yield pd.DataFrame(out, columns=COLUMNS)

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        state, revision, last, _ = self.held.get()
        self.held.update((state, revision, last, 0))
        yield pd.DataFrame([(key[0], last, "idle", state, state, "notice", revision)], columns=COLUMNS)

    def close(self) -> None:
        pass


COLUMNS = ["item", "seq", "action", "from_state", "to_state", "verdict", "revision"]
VERDICTS = "item string, seq string, action string, from_state string, to_state string, verdict string, revision long"


class CarriedProcessor(StatefulProcessor):
    """Rows (scope, seq, week, identity, scheduled) to rows with a verdict, the length of the run of weeks, and the digest of
    the state, in which the last ``cap`` records are kept and which covers the digest before.

    Only scheduled rows are recorded, and each week once: the same identity again is a ``duplicate``, another one of the
    same week a ``conflict``.  ``week`` is a number that grows by one from week to week."""

    def __init__(self, cap: int):
        self.cap = cap

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getValueState("held", "records string, digest string")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        frame = pd.concat(list(rows)).sort_values("seq", kind="stable")
        text, digest = self.held.get() if self.held.exists() else ("[]", "")
        records, out = json.loads(text), []
        for seq, week, identity, scheduled in zip(frame["seq"], frame["week"], frame["identity"], frame["scheduled"], strict=True):
            week, known = int(week), {r[0]: r[1] for r in records}
            if not scheduled:
                verdict = "not_scheduled"
            elif week in known:
                verdict = "duplicate" if known[week] == identity else "conflict"
            elif records and week < records[-1][0]:
                verdict = "late"
            else:
                verdict = "recorded"
                run = records[-1][2] + 1 if records and records[-1][0] == week - 1 else 1
                records = [*records, (week, identity, run)][-self.cap :]
                digest = hashlib.sha256(f"{digest}|{week}|{identity}".encode()).hexdigest()
            out.append((key[0], seq, week, verdict, min(records[-1][2], self.cap) if records else 0, digest))
        self.held.update((json.dumps(records), digest))
        yield pd.DataFrame(out, columns=["scope", "seq", "week", "verdict", "run", "digest"])

    def close(self) -> None:
        pass


CARRIED = "scope string, seq string, week long, verdict string, run long, digest string"


def in_runs(slices: list[DataFrame], key: str, processor: StatefulProcessor, schema: str) -> DataFrame:
    """Each slice is appended to a folder and a stream over the folder is started on the same checkpoint and run to its end:
    what a job that is started again and again gives.  Rows of the sink's folder."""
    spark = slices[0].sparkSession
    folder = shared_path(spark, "stateful")
    with with_store(spark):
        for part in slices:
            part.write.mode("append").parquet(f"{folder}/in")
            run_once(spark.readStream.schema(part.schema).parquet(f"{folder}/in"), key, processor, schema, folder)
    return spark.read.schema(schema).parquet(f"{folder}/out")


def run_once(stream: DataFrame, key: str, processor: StatefulProcessor, schema: str, folder: str, time: str = "None") -> None:
    """Process what the stream has now."""
    out = stream.groupBy(key).transformWithStateInPandas(statefulProcessor=processor, outputStructType=schema, outputMode="Append", timeMode=time)
    out.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").outputMode("append").trigger(availableNow=True).start().awaitTermination()


def reviewed(events: DataFrame, cut: DataFrame, machine: Machine = REVIEW) -> DataFrame:
    """The machine over two slices of events in turn."""
    return in_runs([written(events, "slice"), written(cut, "slice")], "item", MachineProcessor(machine), VERDICTS)
