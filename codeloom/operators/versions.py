"""Version numbers, their rules and readable histories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def latest_meta(meta_history: DataFrame) -> DataFrame:
    """Row of the highest version per repository."""
    return meta_history.groupBy("repo").agg(F.max_by(F.struct("*"), "map_version").alias("m")).select("m.*")


def next_version(meta_history: DataFrame, builds: DataFrame) -> DataFrame:
    """Version row of a new build (repo, git_commit, update_type, files_changed, built_at).

    The first build of a repository is version 1 without a parent; later ones
    follow the latest version and keep the creation time.
    """
    latest = meta_history.groupBy("repo").agg(
        F.max("map_version").alias("_version"),
        F.max_by("created_at", "map_version").alias("_created"),
    )
    return builds.join(latest, "repo", "left").select(
        "repo",
        F.coalesce(F.col("_version") + 1, F.lit(1)).cast("bigint").alias("map_version"),
        F.col("_version").cast("bigint").alias("parent_version"),
        "git_commit", "update_type", "files_changed",
        F.coalesce("_created", "built_at").alias("created_at"),
        F.col("built_at").alias("last_updated"),
    )


def check_versions(meta_history: DataFrame) -> DataFrame:
    """(repo, map_version, rule): the first rule each version row breaks."""
    version, parent = F.col("map_version"), F.col("parent_version")
    kind, files = F.col("update_type"), F.col("files_changed")
    rules = [
        (version < 1, "Invalid map version: must be >= 1"),
        ((version == 1) & parent.isNotNull(), "First version should not have a parent version"),
        ((version > 1) & parent.isNull(), "Version > 1 should have a parent version"),
        (parent.isNotNull() & (parent >= version), "Parent version must be less than current version"),
        ((kind == "delta") & files.isNull(), "Delta updates must specify files_changed"),
        ((kind == "full") & files.isNotNull(), "Full rebuilds should not have files_changed set"),
    ]
    broken = F.lit(None).cast("string")
    for fails, rule in reversed(rules):
        broken = F.when(fails, F.lit(rule)).otherwise(broken)
    return meta_history.select("repo", "map_version", broken.alias("rule")).filter(F.col("rule").isNotNull())


def version_string() -> Column:
    """``vN (delta) ← vP``"""
    return F.concat_ws(
        " ",
        F.concat(F.lit("v"), F.col("map_version").cast("string")),
        F.when(F.col("update_type") == "delta", F.lit("(delta)")),
        F.when(F.coalesce(F.col("parent_version"), F.lit(0)) != 0, F.concat(F.lit("← v"), F.col("parent_version").cast("string"))),
    )


def days_between(start: Column, end: Column) -> Column:
    seconds = F.unix_timestamp(end.cast("timestamp")) - F.unix_timestamp(start.cast("timestamp"))
    return F.floor(seconds / 86400).cast("bigint")


def history_text() -> Column:
    age = days_between(F.col("created_at"), F.col("last_updated"))
    has_parent = F.coalesce(F.col("parent_version"), F.lit(0)) != 0
    lines = F.concat_ws(
        "\n",
        F.concat(F.lit("Version "), F.col("map_version").cast("string")),
        F.when(has_parent, F.concat(F.lit("Built from version "), F.col("parent_version").cast("string"))),
        F.concat(F.lit("Update type: "), F.col("update_type")),
        F.when(
            (F.col("update_type") == "delta") & F.col("files_changed").isNotNull(),
            F.concat(F.lit("Files changed: "), F.col("files_changed").cast("string")),
        ),
        F.concat(F.lit("Map age: "), age.cast("string"), F.lit(" days")),
    )
    return F.when(F.col("map_version") == 1, F.lit("Initial version")).otherwise(lines)


def version_report(meta_history: DataFrame) -> DataFrame:
    return meta_history.select("repo", "map_version", version_string().alias("version"), history_text().alias("history"))


def compare_versions(old: DataFrame, new: DataFrame) -> DataFrame:
    """(repo, version_diff, description) between two rows per repository."""
    diff = F.col("_new") - F.col("_old")
    text = F.when(diff == 1, F.lit("Latest version (1 update)")).otherwise(
        F.concat(diff.cast("string"), F.lit(" versions newer ("), diff.cast("string"), F.lit(" updates)"))
    )
    return (
        old.select("repo", F.col("map_version").alias("_old"))
        .join(new.select("repo", F.col("map_version").alias("_new")), "repo")
        .select("repo", diff.cast("bigint").alias("version_diff"), text.alias("description"))
    )


def needs_update(meta: DataFrame, heads: DataFrame) -> DataFrame:
    """Whether each repository of ``heads`` (repo, current_commit) has no map or one of another commit."""
    stale = F.col("git_commit").isNull() | (F.col("git_commit") != F.col("current_commit"))
    return heads.select("repo", "current_commit").join(meta.select("repo", "git_commit"), "repo", "left").select("repo", stale.alias("needs_update"))
