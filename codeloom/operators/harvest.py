"""Totals, directory summaries and texts over scanned files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom import constants as C
from codeloom.functions.paths import base_name, directory
from codeloom.operators.ranking import top_n


def harvest_totals(files: DataFrame, commits: DataFrame | None = None) -> DataFrame:
    """Files and bytes per repository; ``commits`` (repo, git_commit, scanned_at) adds the snapshot."""
    totals = files.groupBy("repo").agg(
        F.count(F.lit(1)).alias("total_files"),
        F.sum("size_bytes").alias("total_size_bytes"),
    )
    if commits is None:
        return totals
    return totals.join(commits, "repo", "left").withColumn("git_commit", F.coalesce("git_commit", F.lit("unknown")))


def directory_groups(files: DataFrame) -> DataFrame:
    """Files and KB per directory; the members are ``directory_members``."""
    return files.groupBy("repo", directory(F.col("path")).alias("dir")).agg(
        F.count(F.lit(1)).alias("total_files"),
        (F.sum("size_bytes") / 1024).alias("total_kb"),
    )


def directory_members(files: DataFrame) -> DataFrame:
    """(repo, dir, name, size_bytes, language): the member list as rows."""
    path = F.col("path")
    return files.select("repo", directory(path).alias("dir"), base_name(path).alias("name"), "size_bytes", "language")


def _tag(language: str = "language"):
    return F.when(F.col(language).isNotNull(), F.concat(F.lit(" ["), F.col(language), F.lit("]"))).otherwise(F.lit(""))


def directory_listing(files: DataFrame, n: int = C.MAX_FILES_IN_PROMPT) -> DataFrame:
    """(repo, dir, listing): a header, the first n names and how many more there are."""
    members = directory_members(files)
    first = (
        top_n(members, n, ["repo", "dir"], [F.col("name")])
        .groupBy("repo", "dir")
        .agg(F.sort_array(F.collect_list(F.struct("position", F.concat(F.lit("  - "), "name", _tag(), F.lit("\n")).alias("line")))).alias("lines"))
    )
    header = F.concat(
        F.col("dir"), F.lit("/ ("), F.col("total_files").cast("string"), F.lit(" files, "),
        F.format_string("%.1f", F.col("total_kb")), F.lit(" KB)\n"),
    )
    more = F.when(
        F.col("total_files") > n, F.concat(F.lit("  ... and "), (F.col("total_files") - n).cast("string"), F.lit(" more files\n"))
    ).otherwise(F.lit(""))
    return directory_groups(files).join(first, ["repo", "dir"]).select(
        "repo", "dir", F.concat(header, F.array_join(F.col("lines.line"), ""), more).alias("listing")
    )


def file_tree(files: DataFrame) -> DataFrame:
    """(repo, dir, name, line): the tree text as rows.

    Directory headers have an empty name, so ordering by repo, dir and name
    gives the text of every repository without gathering any of them whole.
    """
    members = directory_members(files)
    lines = members.select(
        "repo", "dir", "name",
        F.concat(F.lit("  "), "name", _tag(), F.lit(" ("), F.format_string("%.1f", F.col("size_bytes") / 1024), F.lit(" KB)")).alias("line"),
    )
    headers = members.select("repo", "dir").distinct().select(
        "repo", "dir", F.lit("").alias("name"), F.concat("dir", F.lit("/")).alias("line")
    )
    return headers.unionByName(lines)


def repo_names(files: DataFrame) -> DataFrame:
    """``name`` of the package.json at the root, else the repository's directory name."""
    name = F.get_json_object("content", "$.name")
    packages = files.filter(F.col("path") == "package.json").groupBy("repo").agg(F.max(F.nullif(name, F.lit(""))).alias("_name"))
    return (
        files.select("repo").distinct().join(packages, "repo", "left")
        .select("repo", F.coalesce("_name", base_name(F.col("repo"))).alias("repo_name"))
    )


def build_stats(annotations: DataFrame, assignments: DataFrame, issues: DataFrame, meta: DataFrame) -> DataFrame:
    """Files annotated, tasks, validation issues and the size of the last delta, per repository."""
    n = F.count(F.lit(1))
    files = annotations.groupBy("repo").agg(n.alias("files_annotated"))
    tasks = assignments.select("repo", "task_id").distinct().groupBy("repo").agg(n.alias("agents_used"))
    found = issues.groupBy("repo").agg(n.alias("validation_issues"))
    delta = F.when(F.col("update_type") == "delta", F.col("files_changed"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("bigint").alias(c)
    return (
        meta.select("repo", delta.cast("bigint").alias("last_delta_files"))
        .join(files, "repo", "left").join(tasks, "repo", "left").join(found, "repo", "left")
        .select("repo", zero("files_annotated"), zero("agents_used"), zero("validation_issues"), "last_delta_files")
    )
