"""Call logs: keys, speed, cost, latency and rate-limit audits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom import constants as C
from codeloom.functions import text
from codeloom.operators.running import running_sums
from codeloom.session import stored


def call_keys(prompt_log: DataFrame) -> DataFrame:
    """Level number and task id out of the log's level and purpose texts; a number that is none of an integer's size is 0."""
    level = F.regexp_extract("level", r"(?i)level(\d+)", 1)
    task = F.trim(F.regexp_extract("purpose", r"for:\s*(.+)\z", 1))
    return prompt_log.withColumns({
        "level_number": F.coalesce(F.nullif(level, F.lit("")).try_cast("int"), F.lit(0)),
        "task_id": F.nullif(task, F.lit("")),
    })


def logged_calls(prompt_log: DataFrame) -> DataFrame:
    """A call table out of a prompt log as ``read_call_log`` gives it: what the aggregates by level and task take."""
    return call_keys(prompt_log).drop("level").withColumnRenamed("level_number", "level")


def metric_labels(df: DataFrame) -> DataFrame:
    """Readable columns for duration_ms, latency_ms, cost, tokens and tokens_per_second where present."""
    labels = {
        "duration_ms": ("duration_label", text.pretty_duration),
        "latency_ms": ("latency_label", text.pretty_latency),
        "cost": ("cost_label", text.pretty_cost),
        "tokens": ("tokens_label", text.grouped_int),
        "tokens_per_second": ("speed_label", text.pretty_speed),
    }
    return df.withColumns({name: label(F.col(column)) for column, (name, label) in labels.items() if column in df.columns})


def speed(output_tokens: Column, latency_ms: Column) -> Column:
    """Tokens per second, 0 without latency."""
    return F.when(latency_ms > 0, output_tokens / latency_ms * 1000).otherwise(F.lit(0.0))


def call_cost(prices: dict[str, tuple[float, float]] | None = None) -> Column:
    """USD of a call; an unknown model costs nothing."""
    prices = C.MODEL_PRICES if prices is None else prices
    cost = F.lit(0.0)
    for model, (per_input, per_output) in prices.items():
        cost = F.when(
            F.col("model") == model,
            F.col("input_tokens") / 1e6 * per_input + F.col("output_tokens") / 1e6 * per_output,
        ).otherwise(cost)
    return cost


def call_speed(calls: DataFrame, prices: dict[str, tuple[float, float]] | None = None) -> DataFrame:
    return calls.withColumns({
        "tokens_per_second": speed(F.col("output_tokens"), F.col("latency_ms")),
        "cost": call_cost(prices),
    })


def _token_sums() -> list[Column]:
    return [
        F.sum("input_tokens").cast("bigint").alias("input_tokens"),
        F.sum("output_tokens").cast("bigint").alias("output_tokens"),
        F.count(F.lit(1)).alias("api_calls"),
    ]


def level_metrics(calls: DataFrame, prices: dict[str, tuple[float, float]] | None = None) -> DataFrame:
    """Tokens, calls, cost and the model of the latest call per level."""
    return calls.groupBy("level").agg(
        *_token_sums(),
        F.max_by("model", F.struct("started_at", *[c for c in ("call_id", "model") if c in calls.columns])).alias("model"),
        F.sum(call_cost(prices)).alias("estimated_cost"),
    )


def run_totals(levels: DataFrame) -> DataFrame:
    """Totals over the rows of ``level_metrics``."""
    return levels.agg(
        F.sum("input_tokens").alias("total_input_tokens"),
        F.sum("output_tokens").alias("total_output_tokens"),
        F.sum("api_calls").alias("total_api_calls"),
        F.sum("estimated_cost").alias("total_estimated_cost"),
    )


def cost_by_model(calls: DataFrame, prices: dict[str, tuple[float, float]] | None = None, book_level: bool = False) -> DataFrame:
    """Cost per model, call by call; ``book_level`` books each level to the model of its latest call."""
    if book_level:
        levels = level_metrics(calls, prices).filter(F.col("estimated_cost") > 0)
        return levels.groupBy("model").agg(F.sum("estimated_cost").alias("cost"))
    return calls.groupBy("model").agg(F.sum(call_cost(prices)).alias("cost")).filter(F.col("cost") > 0)


def latency_aggregates() -> list[Column]:
    """Count, token and latency sums, mean latency and the speed as a ratio of sums."""
    latency, output = F.sum("latency_ms"), F.sum("output_tokens")
    return [
        F.count(F.lit(1)).alias("call_count"),
        F.sum("input_tokens").cast("bigint").alias("total_input_tokens"),
        output.cast("bigint").alias("total_output_tokens"),
        latency.cast("bigint").alias("total_latency_ms"),
        F.avg("latency_ms").alias("avg_latency_ms"),
        speed(output, latency).alias("avg_tokens_per_second"),
    ]


def level_name(level: Column) -> Column:
    out = F.concat(F.lit("Level "), level.cast("string"))
    for number, name in C.LEVEL_NAMES.items():
        out = F.when(level == number, F.lit(name)).otherwise(out)
    return out


def level_latency(calls: DataFrame) -> DataFrame:
    return calls.groupBy("level").agg(*latency_aggregates()).withColumn("name", level_name(F.col("level")))


def task_latency(calls: DataFrame) -> DataFrame:
    """Level 3 calls with a task, slowest task first."""
    named = calls.filter((F.col("level") == 3) & F.col("task_id").isNotNull() & (F.col("task_id") != ""))
    return named.groupBy("task_id").agg(*latency_aggregates()).drop("avg_latency_ms").orderBy(F.desc("total_latency_ms"), "task_id")


def slowest_tasks(calls: DataFrame, n: int = 5) -> DataFrame:
    return task_latency(calls).limit(n)


def latency_summary(calls: DataFrame) -> DataFrame:
    return calls.agg(*latency_aggregates()).drop("avg_latency_ms").withColumnRenamed("call_count", "total_calls")


def rate_limit_audit(
    calls: DataFrame,
    requests_per_minute: int = C.REQUESTS_PER_MINUTE,
    tokens_per_minute: int = C.TOKENS_PER_MINUTE,
    keys: tuple[str, ...] = ("model",),
    window_seconds: int = 60,
) -> DataFrame:
    """Each call with the requests and input tokens of the minute that ends with it.

    What the log has up to a moment less what it had up to a minute before. Calls of
    one model and moment are added up first; the sums run over bounded parts of the log
    (``running_sums``), so that a model that makes all the calls is many tasks.
    Calls without a time are left out.
    """
    timed = calls.filter(F.col("started_at").isNotNull()).withColumn("_us", F.unix_micros(F.col("started_at").cast("timestamp")))
    moments = stored(timed.groupBy(*keys, "_us").agg(
        F.count(F.lit(1)).alias("_n"), F.sum("input_tokens").alias("_tokens"), F.count("input_tokens").alias("_known")), "moments")
    began = F.col("_us") - window_seconds * 1_000_000
    # Kind 0 stands before all calls of its moment and asks for what came before; kind 1 adds the calls.
    points = moments.select(*keys, "_us", F.lit(1).alias("_kind"), F.col("_us").alias("_at"), "_n", "_tokens", "_known").unionByName(
        moments.select(*keys, "_us", F.lit(0).alias("_kind"), began.alias("_at")), allowMissingColumns=True)
    summed = running_sums(points, list(keys), ["_at", "_kind"], {"_n_up_to": "_n", "_tokens_up_to": "_tokens", "_known_up_to": "_known"})
    upto = lambda kind, name: F.coalesce(F.max(F.when(F.col("_kind") == kind, F.col(name))), F.lit(0))
    inside = lambda name: upto(1, name) - upto(0, name)
    frames = summed.groupBy(*keys, "_us").agg(
        inside("_n_up_to").cast("bigint").alias("requests_in_window"),
        F.when(inside("_known_up_to") > 0, inside("_tokens_up_to")).cast("bigint").alias("tokens_in_window"))
    other = frames.select(*[F.col(c).alias(f"_of_{c}") for c in (*keys, "_us")], "requests_in_window", "tokens_in_window")
    same = F.col("_us") == F.col("_of__us")
    for key in keys:
        same = same & F.col(key).eqNullSafe(F.col(f"_of_{key}"))
    audited = timed.join(other, same).select(*calls.columns, "requests_in_window", "tokens_in_window")
    return audited.withColumns({
        "over_requests": F.col("requests_in_window") > requests_per_minute,
        "over_tokens": F.col("tokens_in_window") > tokens_per_minute,
    })


def latest_run(run_log: DataFrame) -> DataFrame:
    """Newest run per repository (repo, finished_at, …)."""
    return run_log.groupBy("repo").agg(F.max_by(F.struct("*"), "finished_at").alias("run")).select("run.*")
