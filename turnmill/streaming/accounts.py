"""Account state and heads from streams whose events arrive out of order."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import timedelta

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import BooleanType, StringType, StructField, StructType

from turnmill.operators.ordered import newest
from turnmill.plans.accounts import advance_heads
from turnmill.sinks.tables import compact, read_deltas, write_delta

ENTITLEMENT = ["account_id", "event_id", "state", "effective_at"]
ORDER = ["effective_at", "event_id"]
EVENT = ["arrival", "event_id", "account_id", "customer_id", "effective_at", "state"]
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
COMPACT_EVERY = 50


class _FirstArrival(StatefulProcessor):
    """Per event id: whether an arrival is the first. The id is kept for ``keep_ms``, or for good."""

    def __init__(self, keep_ms: int | None):
        self.keep_ms = keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getValueState("seen", "seen boolean", self.keep_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        seen = self.seen.exists()
        self.seen.update((True,))
        for part in _by_arrival(rows):
            yield part.assign(is_first=[n == 0 and not seen for n in range(len(part))])

    def close(self) -> None:
        pass


class _CustomerOwner(StatefulProcessor):
    """Per customer id: whether an event names a customer that an earlier event gave to another account."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.owner = handle.getValueState("owner", "account_id string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        owner = self.owner.get()[0] if self.owner.exists() else None
        for part in _by_arrival(rows):
            conflicts = []
            for account, counts in zip(part["account_id"], part["is_first"] & part["known"]):
                if counts and owner is None and key[0] is not None:
                    owner = account
                    self.owner.update((owner,))
                conflicts.append(owner is not None and owner != account)
            yield part.assign(conflict=conflicts)

    def close(self) -> None:
        pass


class _NewestEvent(StatefulProcessor):
    """Per account: the status of each event against the newest one before it."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.newest = handle.getValueState("newest", "effective_at string, event_id string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        newest = tuple(self.newest.get()) if self.newest.exists() else None
        for part in _by_arrival(rows):
            statuses = []
            for first, known, conflict, place in zip(part["is_first"], part["known"], part["conflict"], zip(part["effective_at"], part["event_id"])):
                if not first:
                    statuses.append("duplicate")
                elif not known:
                    statuses.append("unknown-account")
                elif conflict:
                    statuses.append("customer-conflict")
                elif newest is None or place > newest:
                    newest = place
                    statuses.append("applied")
                else:
                    statuses.append("stale")
            if newest is not None:
                self.newest.update(newest)
            yield part[EVENT].assign(status=statuses)

    def close(self) -> None:
        pass


def _by_arrival(rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The rows of one key in a micro-batch, in order of arrival; the trigger bounds a micro-batch."""
    parts = list(rows)
    if parts:
        yield pd.concat(parts, ignore_index=True).sort_values("arrival", kind="stable", ignore_index=True)


def event_statuses(events: DataFrame, accounts: DataFrame | None = None, keep_ids: timedelta | None = None) -> DataFrame:
    """A stream of events with what became of each: the statuses of ``plans.accounts.event_status``, in the same order of tests.

    ``events``: the columns of EVENT; ``arrival`` rises from one micro-batch to the next. ``accounts``: account_id of the known
    ones. What decides is kept as state by its own key: seen event ids (for ``keep_ids``, or for good), the account that owns
    a customer, and the newest event of an account, so a batch reads no more than the keys it has. Effective times must not be
    null, as in normalised events without an error.
    """
    events.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    keep_ms = None if keep_ids is None else int(keep_ids.total_seconds() * 1000)
    rows = events.select(*EVENT)
    if accounts is None:
        rows = rows.withColumn("known", F.lit(True))
    else:
        named = accounts.select("account_id").distinct().withColumn("known", F.lit(True))
        rows = rows.join(named, "account_id", "left").select(*EVENT, F.coalesce("known", F.lit(False)).alias("known"))

    def keyed(df: DataFrame, key: str, processor: StatefulProcessor, columns: list[str], new: StructField) -> DataFrame:
        schema = StructType([*[df.schema[c] for c in columns], new])
        time = "processingTime" if keep_ms is not None and key == "event_id" else "none"
        return df.groupBy(key).transformWithStateInPandas(processor, schema, "append", time)

    first = keyed(rows, "event_id", _FirstArrival(keep_ms), rows.columns, StructField("is_first", BooleanType()))
    owned = keyed(first, "customer_id", _CustomerOwner(), first.columns, StructField("conflict", BooleanType()))
    return keyed(owned, "account_id", _NewestEvent(), EVENT, StructField("status", StringType()))


def current_entitlements(spark: SparkSession, root: str) -> DataFrame | None:
    """The newest applied event of every account."""
    log = read_deltas(spark, f"{root}/entitlements")
    return None if log is None else newest(log.select(*ENTITLEMENT), ["account_id"], ORDER)


def event_log(spark: SparkSession, root: str) -> DataFrame | None:
    """Every event with its status."""
    return read_deltas(spark, f"{root}/statuses")


def start_entitlements(events: DataFrame, root: str, checkpoint: str, accounts: DataFrame | None = None,
                       keep_ids: timedelta | None = None, **trigger):
    """Log every event with its status, and the newest applied event per account of every micro-batch.

    Every COMPACT_EVERY batches the log of entitlements is made one table.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        # Without this the stateful operators would run once for each of the two tables.
        batch.persist()
        write_delta(batch, f"{root}/statuses", batch_id)
        write_delta(newest(batch.filter("status = 'applied'").select(*ENTITLEMENT), ["account_id"], ORDER), f"{root}/entitlements", batch_id)
        batch.unpersist()
        _compact(batch.sparkSession, f"{root}/entitlements", batch_id, ENTITLEMENT, ORDER)

    statuses = event_statuses(events, accounts, keep_ids)
    if keep_ids is None:
        return _start(statuses, write, checkpoint, trigger)
    # State under a time-to-live asks for batch after batch even without events; a query takes this setting along when it starts.
    conf, name = events.sparkSession.conf, "spark.sql.streaming.noDataMicroBatches.enabled"
    before = conf.get(name)
    conf.set(name, "false")
    try:
        return _start(statuses, write, checkpoint, trigger)
    finally:
        conf.set(name, before)


def current_heads(spark: SparkSession, root: str, before: int | None = None) -> DataFrame | None:
    log = read_deltas(spark, root)
    if log is None:
        return None
    if before is not None:
        log = log.filter(F.col("batch") < before)
    return newest(log.select("account_id", "generation_id", "batch"), ["account_id"], ["batch"]).drop("batch")


def start_heads(uploads: DataFrame, root: str, checkpoint: str, **trigger):
    """Move heads with every micro-batch of uploads. A repeated batch sees the heads from before it."""
    def write(batch: DataFrame, batch_id: int) -> None:
        _, tips = advance_heads(batch, current_heads(batch.sparkSession, root, batch_id))
        write_delta(tips, root, batch_id)
        _compact(batch.sparkSession, root, batch_id, ["account_id", "generation_id"], ["batch"])

    return _start(uploads, write, checkpoint, trigger)


def _compact(spark: SparkSession, root: str, batch_id: int, columns: list[str], order: list[str]) -> None:
    """Now and then fold all batches before this one; this one may be repeated and stays as it is."""
    if batch_id % COMPACT_EVERY == COMPACT_EVERY - 1:
        log = read_deltas(spark, root).filter(F.col("batch") < batch_id)
        kept = newest(log.select(*columns, "batch"), ["account_id"], order)
        compact(kept.withColumn("batch", F.lit(batch_id - 1).cast("int")), root)


def _start(stream: DataFrame, write, checkpoint: str, trigger):
    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(
        **(trigger or {"availableNow": True})).start()
