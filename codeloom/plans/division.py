"""Rules and heuristics for plans that divide a repository into scopes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom import constants as C


def _plans(plan_tasks: DataFrame, file_counts: DataFrame) -> DataFrame:
    """One row per plan with the aggregates both rule sets need; ``file_counts`` is (plan_id, total_files)."""
    size = lambda name: F.count_if(F.col("agent_size") == name)
    plans = plan_tasks.groupBy("plan_id").agg(
        F.count(F.lit(1)).alias("tasks"),
        F.sum("estimated_files").cast("bigint").alias("estimated"),
        size("small").alias("small"),
        size("medium").alias("medium"),
        size("large").alias("large"),
        # Stated once per plan; the rows of a plan that differ are a violation of their own.
        F.min("execution").alias("execution"),
        F.min("estimated_total_minutes").alias("minutes"),
        (F.min("execution").eqNullSafe(F.max("execution")) & F.min("estimated_total_minutes").eqNullSafe(F.max("estimated_total_minutes"))).alias("uniform"),
    )
    return plans.join(file_counts, "plan_id")


def check_plan(plan_tasks: DataFrame, file_counts: DataFrame) -> DataFrame:
    """(plan_id, severity, rule, subject): every rule a plan breaks."""
    def rows(df: DataFrame, severity: str, rule: str, subject: Column) -> DataFrame:
        return df.select("plan_id", F.lit(severity).alias("severity"), F.lit(rule).alias("rule"), subject.cast("string").alias("subject"))

    n, total = F.col("estimated_files"), F.col("total_files")
    plans = _plans(plan_tasks, file_counts)
    deviation = F.try_divide(F.abs(F.col("estimated") - total), total) * 100
    scopes = plan_tasks.groupBy("plan_id", "scope").agg(F.count(F.lit(1)).alias("_n"))
    per_file = F.try_divide(F.col("minutes"), total)
    return (
        rows(plan_tasks.filter(n > C.MAX_FILES_PER_TASK), "error", "too_many_files", F.col("scope"))
        .unionByName(rows(plan_tasks.filter(n < 1), "error", "no_files", F.col("scope")))
        .unionByName(rows(plans.filter(deviation > C.MAX_DEVIATION_PERCENT), "error", "file_total_deviates", F.format_string("%.1f", deviation)))
        .unionByName(rows(plans.filter(total < 1), "error", "no_files_in_repository", total))
        .unionByName(rows(plans.filter(~F.col("uniform")), "error", "rows_differ", F.lit("execution or minutes")))
        .unionByName(rows(scopes.filter(F.col("_n") > 1), "error", "duplicate_scope", F.col("scope")))
        .unionByName(rows(plans.filter(~F.col("execution").isin("parallel", "sequential")), "error", "invalid_execution", F.col("execution")))
        .unionByName(rows(plans.filter(F.col("minutes") < 1), "error", "invalid_minutes", F.col("minutes").cast("bigint")))
        .unionByName(rows(plans.filter(per_file > C.MAX_MINUTES_PER_FILE), "warning", "slow_estimate", F.format_string("%.2f", per_file)))
    )


def plan_heuristics(plan_tasks: DataFrame, file_counts: DataFrame) -> DataFrame:
    """(plan_id, warnings, suggestions) per plan."""
    plans = _plans(plan_tasks, file_counts)
    tasks, total = F.col("tasks"), F.col("total_files")
    average = total / tasks
    n = F.col("estimated_files")
    uneven = (
        plan_tasks.select("plan_id", "estimated_files").join(plans.select("plan_id", average.alias("_average")), "plan_id")
        .filter((n > F.col("_average") * C.IMBALANCE_HIGH) | (n < F.col("_average") * C.IMBALANCE_LOW))
        .groupBy("plan_id").agg(F.count(F.lit(1)).alias("_uneven"))
    )
    plans = plans.join(uneven, "plan_id", "left").withColumn("uneven", F.coalesce("_uneven", F.lit(0)))
    say = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])
    imbalanced = F.col("uneven") > tasks / 2
    slow = (F.col("execution") == "sequential") & (tasks > 3)
    coarse = (tasks < C.MIN_TASK_COUNT) & (total > C.LARGE_REPO_FILES)
    all_costly = (F.col("small") == 0) & (total > C.SMALL_AGENT_FILES)
    mostly_large = F.col("large") > F.col("medium") + F.col("small")
    warnings = F.array_compact(F.array(
        F.when(imbalanced, say("Many tasks (", F.col("uneven"), "/", tasks, ") are far from the average size")),
        F.when(slow, say("The tasks run one after the other")),
        F.when(mostly_large, say("More than half of the tasks need the largest agent")),
    ))
    suggestions = F.array_compact(F.array(
        F.when(imbalanced, say("Move files from the largest to the smallest tasks")),
        F.when(slow, say("Run tasks that share no files at the same time")),
        F.when(coarse, say("Only ", tasks, " tasks for ", total, " files: divide further")),
        F.when(tasks > 20, say("Many tasks (", tasks, "): join neighbouring scopes")),
        F.when(all_costly, say("No task uses the smallest agent: simple files could")),
        F.when(mostly_large, say("Check which of them a smaller agent could do")),
    ))
    return plans.select("plan_id", warnings.alias("warnings"), suggestions.alias("suggestions"))
