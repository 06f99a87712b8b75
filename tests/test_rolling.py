from __future__ import annotations

from datetime import datetime, timedelta

import numpy as np
from pyspark.sql import functions as F

from codeloom.operators.calls import rate_limit_audit
from codeloom.streaming import rolling

START = datetime(2024, 1, 1)
SCHEMA = "call_id long, started_at timestamp, model string, input_tokens long"


def call(i, seconds, model="m", tokens=10):
    return (i, START + timedelta(seconds=seconds), model, tokens)


def test_frames_include_both_ends_and_equal_moments():
    us = np.array([60, 0, 61, 60, 1])
    calls, tokens, known = rolling.frames(us, np.array([1, 2, 4, 8, 0]), np.array([True, True, True, True, False]), 60)
    assert (calls.tolist(), tokens.tolist(), known.tolist()) == ([4, 1, 4, 4, 2], [11, 2, 13, 11, 2], [3, 1, 3, 3, 1])


def test_the_stream_equals_the_audit_over_batches_late_rows_and_a_restart(spark, tmp_path):
    first = [call(i, i * 7, "mn"[i % 3 == 0], None if i % 5 == 0 else i) for i in range(60)]
    # Rows 100 and 101 come after later ones, but before the watermark.
    second = [call(200, 700), call(201, 700, "n", None), call(100, 419), call(101, 405, "n"), (102, None, "m", 1)]
    third = [call(i, 800 + i, "m" if i % 2 else None) for i in range(300, 340)] + [call(400, 5000)]
    source, out, state = (str(tmp_path / n) for n in ("source", "out", "state"))
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    for batch in (first, second, third):  # each run goes on from the checkpoint
        spark.createDataFrame(batch, SCHEMA).coalesce(1).write.mode("append").parquet(source)
        arriving = spark.readStream.schema(SCHEMA).parquet(source)
        rolling.stream_rate_limit_audit(arriving, out, state, 4, 60, late="5 minutes").awaitTermination()
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass") == before
    columns = ["call_id", "model", "requests_in_window", "tokens_in_window", "over_requests", "over_tokens"]
    whole = spark.createDataFrame(first + second + third, SCHEMA).filter("started_at < timestamp '2024-01-01 01:18:00'")
    key = lambda df: sorted((tuple(r) for r in df.select(columns).collect()), key=str)
    want = rate_limit_audit(whole.filter("model is not null"), 4, 60)
    got = spark.read.parquet(out)
    assert key(got.filter("model is not null")) == key(want) and got.count() == 60 + 4 + 40
    assert any(r["over_requests"] for r in want.collect()) and got.filter("model is null").count() == 20
