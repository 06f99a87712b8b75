"""The rolling minute of each call as a stream, in keyed state with timers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from codeloom import constants as C

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_KEPT = "call_id bigint, us bigint, tokens bigint, own boolean"
_OUT = "model string, call_id bigint, us bigint, requests_in_window bigint, tokens_in_window bigint"


def frames(us: np.ndarray, tokens: np.ndarray, known: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each of the moments the calls, tokens and known token counts from ``width`` before it to itself, both included."""
    order = np.argsort(us, kind="stable")
    at = us[order]
    low, high = np.searchsorted(at, us - width, "left"), np.searchsorted(at, us, "right")
    inside = lambda values: np.concatenate([[0], np.cumsum(values[order])])[high] - np.concatenate([[0], np.cumsum(values[order])])[low]
    return high - low, inside(tokens), inside(known.astype(np.int64))


class RollingFrames(StatefulProcessor):
    """State of one model and pane of the window's length: the calls of the pane and of the one before.

    When the watermark passes the pane's end no call of either can come any more; the
    pane's calls go out with their frames and the state is dropped.
    """

    def __init__(self, width: int):
        self.width = width

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.calls = handle.getListState("calls", _KEPT)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for batch in rows:
            tokens = batch["tokens"].astype(object).where(batch["tokens"].notna(), None)
            kept = zip(batch["call_id"], batch["us"], tokens, batch["own"])
            self.calls.appendList([(int(c), int(u), None if t is None else int(t), bool(o)) for c, u, t, o in kept])
        self.handle.registerTimer((int(key[1]) + 1) * self.width // 1000)
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        held = list(self.calls.get())
        self.calls.clear()
        ids, us, tokens, own = (np.array(c, dtype=object) for c in zip(*held))
        known = np.array([t is not None for t in tokens])
        calls, total, counted = frames(us.astype(np.int64), np.where(known, tokens, 0).astype(np.int64), known, self.width)
        mine = own.astype(bool)
        sums = pd.array(np.where(counted > 0, total, 0), dtype="Int64")
        sums[counted == 0] = pd.NA
        out = pd.DataFrame({"call_id": ids.astype(np.int64), "us": us.astype(np.int64), "requests_in_window": calls, "tokens_in_window": sums})[mine]
        out.insert(0, "model", key[0])
        if len(out):
            yield out

    def close(self) -> None:
        pass


def stream_rate_limit_audit(
    calls: DataFrame, out: str, checkpoint: str, requests_per_minute: int = C.REQUESTS_PER_MINUTE,
    tokens_per_minute: int = C.TOKENS_PER_MINUTE, window_seconds: int = 60, late: str = "10 minutes", **trigger,
) -> StreamingQuery:
    """``rate_limit_audit`` on a stream (call_id, started_at, model, input_tokens), appended to a parquet folder.

    A call goes out once the watermark has passed the end of its pane of ``window_seconds``, as
    then no call of its window can still come. State is keyed by model and pane, so it is bounded by
    what one model does in two windows, and a model that makes all the calls is as many keys as
    there are panes open. Calls without a time are left out.
    """
    spark = calls.sparkSession
    width = window_seconds * 1_000_000
    timed = calls.withColumn("started_at", F.col("started_at").cast("timestamp")).filter("started_at is not null").withWatermark("started_at", late)
    us = F.unix_micros("started_at")
    pane = F.floor(us / F.lit(width)).cast("bigint")
    # A call counts in its own pane and in the frames of the next.
    placed = timed.select(
        "model", "started_at", F.col("call_id").cast("bigint").alias("call_id"), us.alias("us"), F.col("input_tokens").cast("bigint").alias("tokens"),
        F.inline(F.array(F.struct(pane.alias("pane"), F.lit(True).alias("own")), F.struct((pane + 1).alias("pane"), F.lit(False).alias("own")))))
    framed = placed.groupBy("model", "pane").transformWithStateInPandas(
        RollingFrames(width), outputStructType=_OUT, outputMode="append", timeMode="eventTime")
    audited = framed.select(
        "call_id", "model", F.timestamp_micros("us").alias("started_at"), "requests_in_window", "tokens_in_window",
        (F.col("requests_in_window") > requests_per_minute).alias("over_requests"), (F.col("tokens_in_window") > tokens_per_minute).alias("over_tokens"))
    # Timers need this state store; a query keeps the settings it was started with.
    before = spark.conf.get(_PROVIDER)
    spark.conf.set(_PROVIDER, _ROCKSDB)
    try:
        return (
            audited.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint)
            .trigger(**(trigger or {"availableNow": True})).start(out)
        )
    finally:
        spark.conf.set(_PROVIDER, before)
