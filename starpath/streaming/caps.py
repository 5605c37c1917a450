"""Each user's first ratings as keyed state over a stream, equal to the cap in batch for any cut into batches.

The state of a user is its first ``cap`` ratings by date, item and rating, so at most ``cap`` rows. A batch that changes
them gives the user's whole list anew; the last list given is the user's cap. A user whose state saw no rating
for ``idle`` is forgotten by a timer, with the first later batch that brings it no rating: ratings that come after
that start a new list, so choose it longer than ratings may be late.

Users are dealt to ``GROUPS`` groups by a hash, and a group's users are one state, packed: a call of the processor costs
far more than a user's few rows, so it is made per group and not per user. The number is part of a stream's progress and
must stay as it is for the stream's life.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import timedelta

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from starpath.streaming.requests import write_batches

# Keyed state with timers needs this store.
_STORE = "spark.sql.streaming.stateStore.providerClass"
_STORE_CLASS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_RATING = "item_id bigint, rating double, rated_at string"
_LIST = f"user_id bigint, position int, {_RATING}"
#: Groups that users are dealt to.
GROUPS = 4096


def _first(cap: int, idle_ms: int | None) -> StatefulProcessor:
    """The processor; its class is made here so that it travels by value, as Spark also loads it outside the workers."""
    kinds = pa.schema([("user_id", pa.int64()), ("item_id", pa.int64()), ("rating", pa.float64()), ("rated_at", pa.string()),
                       ("seen", pa.int64())])
    columns = kinds.names[:4]

    class First(StatefulProcessor):
        """A group's state: its users' lists in order, each row with the time at which its user last had a rating."""

        def init(self, handle: StatefulProcessorHandle) -> None:
            self._handle = handle
            self._ratings = handle.getValueState("ratings", "packed binary")

        def _held(self) -> pd.DataFrame:
            packed = self._ratings.get()
            if packed is None:
                return kinds.empty_table().to_pandas()
            return pa.ipc.open_stream(packed[0]).read_all().to_pandas()

        def _hold(self, held: pd.DataFrame) -> None:
            table = pa.Table.from_pandas(held, kinds, preserve_index=False)
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, kinds, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                out.write_table(table)
            self._ratings.update((sink.getvalue().to_pybytes(),))

        def _wake(self, held: pd.DataFrame) -> None:
            """The next time at which a user of the group is due to be forgotten."""
            for timer in list(self._handle.listTimers()):
                self._handle.deleteTimer(timer)
            if len(held):
                self._handle.registerTimer(int(held["seen"].min()) + idle_ms)

        def _first(self, rows: pd.DataFrame) -> pd.DataFrame:
            rows = rows.sort_values(["user_id", "rated_at", "item_id", "rating"], kind="stable", ignore_index=True)
            return rows[rows.groupby("user_id").cumcount() < cap].reset_index(drop=True)

        def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
            now = timerValues.getCurrentProcessingTimeInMs() if idle_ms is not None else 0
            before = self._held()
            held, users, waiting, n = before, [], [], 0

            def take() -> None:
                nonlocal held, n
                new = pd.concat(waiting, ignore_index=True)
                users.append(new["user_id"].unique())
                held = self._first(pd.concat([held, new.assign(seen=now)] if len(held) else [new.assign(seen=now)], ignore_index=True))
                waiting.clear()
                n = 0

            for batch in rows:
                waiting.append(batch[columns])
                n += len(batch)
                if n > len(held) + 100_000:
                    take()
            if waiting:
                take()
            if not users:
                return
            rated = held["user_id"].isin(np.unique(np.concatenate(users)))
            if idle_ms is not None:
                held = held.assign(seen=held["seen"].where(~rated, now))
                kept = rated | (held["seen"] + idle_ms > now)
                held, rated = held[kept].reset_index(drop=True), rated[kept].reset_index(drop=True)
                self._wake(held)
            self._hold(held)
            # a list that is as before is not given again
            own = held[rated].copy()
            own["position"] = (own.groupby("user_id").cumcount() + 1).astype("int32")
            old = before[before["user_id"].isin(own["user_id"])].copy()
            old["position"] = old.groupby("user_id").cumcount() + 1
            met = own.merge(old, "left", ["user_id", "position"], suffixes=("", "_old"))
            same = (met["item_id"] == met["item_id_old"]) & (met["rating"] == met["rating_old"]) & (met["rated_at"] == met["rated_at_old"])
            changed = met.loc[~same, "user_id"].unique()
            yield own[own["user_id"].isin(changed)][["user_id", "position", "item_id", "rating", "rated_at"]]

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
            held = self._held()
            held = held[held["seen"] + idle_ms > timerValues.getCurrentProcessingTimeInMs()].reset_index(drop=True)
            self._hold(held)
            self._wake(held)
            return iter([])

        def close(self) -> None:
            pass

    return First()


def first_ratings(ratings: DataFrame, cap: int = 11, idle: timedelta | None = None) -> DataFrame:
    """``user_id, position, item_id, rating, rated_at`` of a stream: the list of each user that a batch changed.

    Rows without a user, an item, a rating or a date have no place in the order and are left out.
    """
    whole = ratings.select(F.col("user_id").cast("bigint"), F.col("item_id").cast("bigint"), F.col("rating").cast("double"),
                           "rated_at").dropna()
    group = F.pmod(F.xxhash64("user_id"), F.lit(GROUPS)).cast("int").alias("group")
    return whole.select(group, *whole.columns).groupBy("group").transformWithStateInPandas(
        _first(cap, None if idle is None else int(idle.total_seconds() * 1000)), outputStructType=_LIST,
        outputMode="Update", timeMode="none" if idle is None else "processingTime")


def write_first_ratings(ratings: DataFrame, out: str, checkpoint: str, cap: int = 11, idle: timedelta | None = None,
                        trigger: dict | None = None) -> StreamingQuery:
    """Runs the state over new ratings and writes the changed lists per batch.

    With timers there may always be another batch, so ``availableNow`` would not end: give a query with ``idle`` a
    trigger by time, or it takes what is there in one batch.
    The state store is set for this query alone: a query keeps the settings it was started with.
    """
    settings = ratings.sparkSession.conf
    before = settings.get(_STORE, None)
    settings.set(_STORE, _STORE_CLASS)
    try:
        return write_batches(first_ratings(ratings, cap, idle), lambda batch: batch, out, checkpoint,
                             trigger or (None if idle is None else {"once": True}), mode="update")
    finally:
        settings.unset(_STORE) if before is None else settings.set(_STORE, before)


def current_lists(spark: SparkSession, out: str) -> DataFrame:
    """Each user's list as the last batch that changed it gave it."""
    written = spark.read.parquet(out)
    last = F.max("batch_id").over(W.partitionBy("user_id"))
    return written.withColumn("_last", last).filter(F.col("batch_id") == F.col("_last")).drop("_last", "batch_id")
