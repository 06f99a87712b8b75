"""Queries over call logs: cost, latency, rate limits."""

from __future__ import annotations

from pyspark.sql import functions as F

from codeloom.operators import calls
from codeloom.session import scratch_path
from codeloom.sources import logs
from codeloom.streaming import rolling, streams
from workload.q_files import COST, PRICES
from workload.registry import query

def append_in_time(log, folder: str, parts: int) -> None:
    """The log as files of one equal span of time each, in the order of time."""
    first, last = log.agg(F.min("started_at"), F.max("started_at")).first()
    cuts = [first + (last - first) / parts * i for i in range(1, parts)]
    at = F.col("started_at")
    for low, high in zip([None, *cuts], [*cuts, None]):
        part = log.filter((at >= F.lit(low) if low else F.lit(True)) & (at < F.lit(high) if high else F.lit(True)))
        part.coalesce(1).write.mode("append").parquet(folder)


_SUMS = """count(*) as call_count, cast(sum(input_tokens) as bigint) as total_input_tokens, cast(sum(output_tokens) as bigint) as total_output_tokens,
    cast(sum(latency_ms) as bigint) as total_latency_ms"""
_SPEED = "round(case when sum(latency_ms) > 0 then sum(output_tokens) / sum(latency_ms) * 1000 else 0 end, 6) as avg_tokens_per_second"
_LEVELS = f"""levels as (select level, cast(sum(input_tokens) as bigint) as input_tokens, cast(sum(output_tokens) as bigint) as output_tokens, count(*) as api_calls,
    arg_max(model, (started_at, call_id)) as model, sum({COST}) as estimated_cost from v_calls group by level)"""


@query("g9_level_metrics", "select level, input_tokens, output_tokens, api_calls, model, round(estimated_cost, 6) as estimated_cost from levels", _LEVELS)
def level_metrics(w):
    return calls.level_metrics(w.view("v_calls"), PRICES).withColumn("estimated_cost", F.round("estimated_cost", 6))


@query("g9_levels_of_a_log", """
    select cast(level as integer) as level, cast(sum(input_tokens) as bigint) as input_tokens, cast(sum(output_tokens) filter (output_tokens > 50) as bigint) as output_tokens, count(*) as api_calls,
        arg_max(model, (started_at, model)) as model, 0.0::double as estimated_cost from v_calls group by level""")
def levels_of_log(w):
    """From the log file by its keys to the metrics, without any column the log does not have."""
    base = scratch_path(w.spark, "log")
    w.view("v_calls").select(
        F.col("started_at").cast("timestamp").alias("timestamp"), F.concat(F.lit("Level"), F.col("level").cast("string"), F.lit(" run")).alias("level"), "model",
        F.concat(F.lit("File annotation for: "), "task_id").alias("purpose"), F.col("input_tokens").alias("inputTokens"),
        F.when(F.col("output_tokens") > 50, F.col("output_tokens")).alias("outputTokens")).write.json(base)
    return calls.level_metrics(calls.logged_calls(logs.read_call_log(w.spark, base)), {})


@query("g9_run_totals", """
    select cast(sum(input_tokens) as bigint) as total_input_tokens, cast(sum(output_tokens) as bigint) as total_output_tokens,
        cast(sum(api_calls) as bigint) as total_api_calls, round(sum(estimated_cost), 6) as total_estimated_cost from levels""", _LEVELS)
def run_totals(w):
    levels = calls.level_metrics(w.view("v_calls"), PRICES)
    return calls.run_totals(levels).withColumn("total_estimated_cost", F.round("total_estimated_cost", 6))


@query("g10_cost_by_model", f"""
    select model, 'call' as booked, round(sum({COST}), 6) as cost from v_calls group by model
    union all select model, 'level', round(sum(estimated_cost), 6) from levels group by model""", _LEVELS)
def cost_by_model(w):
    log = w.view("v_calls")
    tag = lambda df, name: df.select("model", F.lit(name).alias("booked"), F.round("cost", 6).alias("cost"))
    return tag(calls.cost_by_model(log, PRICES), "call").unionByName(tag(calls.cost_by_model(log, PRICES, book_level=True), "level"))


def rounded(df):
    return df.withColumns({c: F.round(c, 6) for c in ("avg_latency_ms", "avg_tokens_per_second") if c in df.columns})


@query("g11_level_latency", f"""
    select level, case level when 1 then 'Detection' when 2 then 'Division' when 3 then 'Annotation' end as name, {_SUMS},
        round(avg(latency_ms), 6) as avg_latency_ms, {_SPEED} from v_calls group by level""")
def level_latency(w):
    return rounded(calls.level_latency(w.view("v_calls")))


@query("g12_task_latency", f"select task_id, {_SUMS}, {_SPEED} from v_calls where level = 3 group by task_id")
def task_latency(w):
    return rounded(calls.task_latency(w.view("v_calls")))


@query("k4_slowest_tasks", f"select task_id, {_SUMS}, {_SPEED} from v_calls where level = 3 group by task_id order by total_latency_ms desc, task_id limit 5")
def slowest(w):
    return rounded(calls.slowest_tasks(w.view("v_calls")))


@query("g13_latency_summary", f"select {_SUMS.replace('call_count', 'total_calls')}, {_SPEED} from v_calls")
def latency_summary(w):
    return rounded(calls.latency_summary(w.view("v_calls")))


@query("l4_rate_limit_audit", """
    select call_id, requests_in_window, tokens_in_window, requests_in_window > 3 as over_requests, tokens_in_window > 2000 as over_tokens from (
        select call_id, count(*) over frame as requests_in_window, cast(sum(input_tokens) over frame as bigint) as tokens_in_window from v_calls
        window frame as (partition by model order by started_at range between interval 10 minutes preceding and current row))""")
def audit(w):
    audited = calls.rate_limit_audit(w.view("v_calls"), requests_per_minute=3, tokens_per_minute=2000, window_seconds=600)
    return audited.select("call_id", "requests_in_window", "tokens_in_window", "over_requests", "over_tokens")


@query("l2_call_windows", f"""
    select time_bucket(interval '1 hour', started_at) as window_start, level, {_SUMS}, round(avg(latency_ms), 6) as avg_latency_ms, {_SPEED}
    from v_calls group by 1, 2""")
def windows(w):
    out = rounded(streams.call_windows(w.view("v_calls"), "1 hour"))
    return out.withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


@query("l4_rate_windows", """
    select window_start, model, count(*) as requests, cast(sum(input_tokens) as bigint) as tokens, count(*) > 2 as over_requests, sum(input_tokens) > 1000 as over_tokens
    from (select model, input_tokens, unnest(range(6)) as i, time_bucket(interval '10 seconds', started_at) - to_seconds(i * 10) as window_start from v_calls) group by 1, 2""")
def rate_windows(w):
    out = streams.rate_windows(w.view("v_calls"), requests_per_minute=2, tokens_per_minute=1000)
    return out.withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


@query("l4_stream_rate_windows", """
    select window_start, model, count(*) as requests, cast(sum(input_tokens) as bigint) as tokens, count(*) > 2 as over_requests, sum(input_tokens) > 1000 as over_tokens
    from (select model, input_tokens, unnest(range(6)) as i, time_bucket(interval '10 seconds', started_at) - to_seconds(i * 10) as window_start from v_calls)
    where window_start + interval '1 minute' <= (select max(started_at) - interval '10 minutes' from v_calls) group by 1, 2""")
def stream_rate_windows(w):
    """The audit as a stream over several batches in the order of time: windows the watermark has closed."""
    source, out, state = (scratch_path(w.spark, name) for name in ("rated", "rates", "state"))
    log = w.view("v_calls")
    append_in_time(log, source, 4)
    arriving = w.spark.readStream.schema(log.schema).option("maxFilesPerTrigger", 1).parquet(source)
    rated = streams.rate_windows(arriving, requests_per_minute=2, tokens_per_minute=1000)
    streams.stream_to_table(rated, out, state).awaitTermination()
    return w.spark.read.parquet(out).withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


@query("l4_stream_rate_limit_audit", """
    select call_id, requests_in_window, tokens_in_window, requests_in_window > 3 as over_requests, tokens_in_window > 2000 as over_tokens from (
        select call_id, started_at, count(*) over frame as requests_in_window, cast(sum(input_tokens) over frame as bigint) as tokens_in_window from v_calls
        window frame as (partition by model order by started_at range between interval 10 minutes preceding and current row))
    where time_bucket(interval '10 minutes', started_at) + interval '10 minutes' <= (select max(started_at) - interval '10 minutes' from v_calls)""")
def stream_audit(w):
    """The audit call by call in keyed state; the stream runs twice from one checkpoint, over two batches each."""
    source, out, state = (scratch_path(w.spark, name) for name in ("audited", "frames", "state"))
    log = w.view("v_calls")
    middle = log.agg(F.percentile_approx("started_at", 0.5)).first()[0]
    for half in (log.filter(F.col("started_at") < F.lit(middle)), log.filter(F.col("started_at") >= F.lit(middle))):
        append_in_time(half, source, 2)
        arriving = w.spark.readStream.schema(log.schema).option("maxFilesPerTrigger", 1).parquet(source)
        rolling.stream_rate_limit_audit(arriving, out, state, requests_per_minute=3, tokens_per_minute=2000, window_seconds=600).awaitTermination()
    return w.spark.read.parquet(out).select("call_id", "requests_in_window", "tokens_in_window", "over_requests", "over_tokens")
