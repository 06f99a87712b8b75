"""JSON-lines annotation files, change logs and call logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codeloom.schemas import ANNOTATION, CALL_LOG
from codeloom.sources.files import path_exists

_BAD = "_bad"


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType = ANNOTATION) -> tuple[DataFrame, DataFrame]:
    """(rows, malformed lines); both empty when there is no such file."""
    if not path_exists(spark, path):
        return spark.createDataFrame([], schema), spark.createDataFrame([], "line string")
    full = T.StructType(schema.fields + [T.StructField(_BAD, T.StringType())])
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": _BAD}
    lines = spark.read.text(path).filter(F.trim("value") != "")
    rows = lines.select("value", F.from_json("value", full, options).alias("row"))
    broken = F.col(f"row.{_BAD}").isNotNull()
    good = rows.filter(~broken).select("row.*").drop(_BAD)
    return good, rows.filter(broken).select(F.col("value").alias("line"))


def append_jsonl(rows: DataFrame, path: str) -> None:
    """Add the rows; nothing is written for an empty batch."""
    if not rows.isEmpty():
        rows.write.mode("append").json(path)


def compact_jsonl(spark: SparkSession, path: str, out: str, schema: T.StructType = ANNOTATION, files: int | None = None) -> None:
    """Rewrite all good rows as one dataset of about ``files`` files."""
    good, _ = read_jsonl(spark, path, schema)
    (good.repartition(files) if files else good).write.mode("overwrite").json(out)


def count_jsonl(spark: SparkSession, path: str) -> int:
    """Lines that are not blank, malformed ones included."""
    if not path_exists(spark, path):
        return 0
    return spark.read.text(path).filter(F.trim("value") != "").count()


def count_jsonl_by_repo(spark: SparkSession, base: str) -> DataFrame:
    """(repo, lines) for files in folders ``repo=<name>`` below one location, counted like ``count_jsonl``."""
    rows = spark.read.schema("value string, repo string").text(base).filter(F.trim("value") != "")
    return rows.groupBy("repo").agg(F.count(F.lit(1)).alias("lines"))


def read_change_log(spark: SparkSession, path: str, repo: str | None = None) -> DataFrame:
    """(repo, line) of a change log; without ``repo`` the name of each file names the repository."""
    name = F.lit(repo) if repo else F.regexp_extract(F.col("_metadata.file_name"), r"^(.*?)(\.[^.]*)?$", 1)
    return spark.read.text(path).select(name.alias("repo"), F.col("value").alias("line")).filter(F.trim("line") != "")


def read_change_logs(spark: SparkSession, base: str) -> DataFrame:
    """(repo, line) of the change logs of many repositories, in folders ``repo=<name>`` below one location: one scan."""
    rows = spark.read.schema("value string, repo string").text(base)
    return rows.select("repo", F.col("value").alias("line")).filter(F.trim("line") != "")


def read_call_log(spark: SparkSession, path: str) -> DataFrame:
    """Prompt log rows; optional fields are NULL where a line lacks them."""
    return spark.read.schema(CALL_LOG).json(path).withColumnsRenamed({
        "inputTokens": "input_tokens", "outputTokens": "output_tokens", "timestamp": "started_at",
    })
