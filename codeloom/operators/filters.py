"""Row filters on files, annotations and changes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom import constants as C
from codeloom.functions.paths import ancestors, base_name, extension


def filter_skipped_dirs(files: DataFrame) -> DataFrame:
    """Drop files below a skipped or hidden directory; hidden files themselves stay."""
    segments = F.split(F.col("path"), "/")
    dirs = F.slice(segments, F.lit(1), F.size(segments) - 1)
    return files.filter(~F.exists(dirs, lambda d: d.isin(C.SKIPPED_DIRS) | F.startswith(d, F.lit("."))))


def filter_binary_ext(files: DataFrame) -> DataFrame:
    return files.filter(~F.lower(extension(F.col("path"))).isin(C.BINARY_EXTENSIONS))


def filter_binary_content(files: DataFrame, probe: int = 8192) -> DataFrame:
    """Drop files with a NUL byte in the first ``probe`` bytes of the binary column ``content``."""
    return files.filter(~F.contains(F.substring(F.col("content"), 1, probe), F.lit(bytearray(b"\0"))))


def is_change_noise(path: Column) -> Column:
    inside = [
        F.startswith(path, F.lit(f"{d}/")) | F.contains(path, F.lit(f"/{d}/")) for d in C.CHANGE_SKIPPED_DIRS
    ]
    return reduce(lambda a, b: a | b, inside) | F.lower(extension(path)).isin(C.CHANGE_SKIPPED_EXTENSIONS)


def filter_change_noise(changes: DataFrame) -> DataFrame:
    return changes.filter(~is_change_noise(F.col("path")))


def dir_prefix(prefix: Column) -> Column:
    return F.when(F.endswith(prefix, F.lit("/")), prefix).otherwise(F.concat(prefix, F.lit("/")))


def filter_by_path(files: DataFrame, prefix: str) -> DataFrame:
    """Files below a directory, or the one file that is named."""
    inside = prefix if prefix.endswith("/") else f"{prefix}/"
    return files.filter(F.startswith(F.col("path"), F.lit(inside)) | (F.col("path") == prefix))


def match_prefixes(queries: DataFrame, files: DataFrame) -> DataFrame:
    """``filter_by_path`` for a table of queries (query_id, repo, prefix).

    Directories are matched first, each keyed by itself and every directory above it, so that
    the prefix test becomes a hash join instead of a comparison of all pairs. Files then
    look up their directory, whatever its depth, and the queries that name them.
    """
    path, prefix = F.col("path"), F.col("prefix")
    others = [c for c in files.columns if c != "repo"]
    folder = F.substr(path, F.lit(1), F.length(path) - F.length(F.substring_index(path, "/", -1)))
    placed = files.withColumn("_dir", folder)
    wanted = queries.select("query_id", "repo", "prefix")
    keyed = placed.select("repo", "_dir").distinct().withColumn("_key", F.explode(ancestors(F.col("_dir"))))
    found = keyed.join(wanted.withColumn("_key", dir_prefix(prefix)), ["repo", "_key"]).drop("_key")
    below = placed.join(found, ["repo", "_dir"])
    # A name that ends with a slash is below itself.
    named = files.join(wanted.filter(~F.endswith(prefix, F.lit("/"))).withColumn("path", prefix), ["repo", "path"])
    columns = ["repo", *others, "query_id", "prefix"]
    return below.select(*columns).unionByName(named.select(*columns))


def find_by_path(files: DataFrame, path: str) -> DataFrame:
    return files.filter(F.col("path") == path)


def find_paths(queries: DataFrame, files: DataFrame) -> DataFrame:
    """Exact lookup for a table of queries (query_id, repo, path)."""
    return queries.select("query_id", "repo", "path").join(files, ["repo", "path"])


def subset_files(files: DataFrame, changed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Changed files and, per repository, their recomputed totals."""
    kept = files.join(changed.select("repo", "path").distinct(), ["repo", "path"], "left_semi")
    totals = kept.groupBy("repo").agg(
        F.count(F.lit(1)).alias("total_files"),
        F.sum("size_bytes").alias("total_size_bytes"),
    )
    return kept, totals


def with_name(df: DataFrame) -> DataFrame:
    return df.withColumn("name", base_name(F.col("path")))
