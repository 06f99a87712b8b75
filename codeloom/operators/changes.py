"""Change lists, the update strategy and the status of a map."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom import constants as C
from codeloom.functions.paths import top_directory
from codeloom.operators.filters import is_change_noise


def parse_changes(lines: DataFrame) -> DataFrame:
    """Lines (repo, line) of ``status<TAB>path[<TAB>new path]`` to rows (repo, status, path).

    A rename becomes a deletion and an addition; other status codes are left
    out. Noise is judged on everything after the status, so a rename line goes
    by the extension of its new path.
    """
    line = F.col("line")
    code = F.substring(line, 1, 1)
    rest = F.when(F.contains(line, F.lit("\t")), F.regexp_extract(line, r"(?s)^[^\t]*\t(.*)\z", 1)).otherwise(F.lit(""))
    paths = F.split(F.col("rest"), "\t")
    old, new = F.get(paths, F.lit(0)), F.get(paths, F.lit(1))
    change = lambda status, path: F.struct(F.lit(status).alias("status"), path.alias("path"))
    renamed = F.when(F.length(F.coalesce(new, F.lit(""))) > 0, F.array(change("D", old), change("A", new)))
    rows = F.when(F.col("code") == "R", renamed)
    for status in ("A", "M", "D"):
        rows = F.when(F.col("code") == status, F.array(change(status, F.col("rest")))).otherwise(rows)
    return (
        lines.filter(F.trim(line) != "")
        .select("repo", code.alias("code"), rest.alias("rest"))
        .filter(~is_change_noise(F.col("rest")))
        .select("repo", F.inline(rows))
    )


def new_top_dirs(changes: DataFrame, listing: DataFrame) -> DataFrame:
    """(repo, top_dir) that added files bring and the previous listing does not have."""
    nested = F.contains(F.col("path"), F.lit("/"))
    top = top_directory(F.col("path")).alias("top_dir")
    added = changes.filter((F.col("status") == "A") & nested).select("repo", top).distinct()
    existing = listing.filter(nested).select("repo", top).filter(~F.startswith("top_dir", F.lit("."))).distinct()
    return added.join(existing, ["repo", "top_dir"], "left_anti")


def update_strategy(changes: DataFrame, meta: DataFrame, heads: DataFrame, new_dirs: DataFrame) -> DataFrame:
    """Strategy and reason per repository of ``heads`` (repo, current_commit).

    ``meta`` is (repo, git_commit) of the existing map; ``new_dirs`` is ``new_top_dirs``.
    """
    n = F.col("total_changes")
    count = lambda status: F.count_if(F.col("status").isin(*status))
    counted = changes.groupBy("repo").agg(
        count(["A", "M"]).alias("changed_files"), count(["D"]).alias("deleted_files")
    )
    flagged = new_dirs.select("repo").distinct().withColumn("_new_dir", F.lit(True))
    joined = (
        heads.select("repo", "current_commit").join(meta.select("repo", "git_commit"), "repo", "left")
        .join(counted, "repo", "left")
        .join(flagged, "repo", "left")
    )
    compared = F.col("git_commit").isNotNull() & (F.col("git_commit") != F.col("current_commit"))
    number = lambda c: F.when(compared, F.coalesce(F.col(c), F.lit(0))).otherwise(F.lit(0)).cast("bigint")
    rows = joined.withColumns({
        "changed_files": number("changed_files"),
        "deleted_files": number("deleted_files"),
        "has_new_top_dir": compared & F.coalesce("_new_dir", F.lit(False)),
    }).withColumn("total_changes", F.col("changed_files") + F.col("deleted_files"))
    low, high = C.VALIDATE_FROM_CHANGES, C.REBUILD_ABOVE_CHANGES
    said = lambda tail: F.concat(n.cast("string"), F.lit(f" files changed ({tail})"))
    cases = [
        (F.col("git_commit").isNull(), "full-rebuild", F.lit("No existing map found")),
        (F.col("git_commit") == F.col("current_commit"), "delta", F.lit("Map is up to date")),
        (F.col("has_new_top_dir"), "full-rebuild", F.lit("New top-level directory detected")),
        (n > high, "full-rebuild", said(f">{high}")),
        (n >= low, "delta-with-validation", said(f"{low}-{high}")),
    ]
    strategy, reason = F.lit("delta"), said(f"<{low}")
    for holds, name, why in reversed(cases):
        strategy = F.when(holds, F.lit(name)).otherwise(strategy)
        reason = F.when(holds, why).otherwise(reason)
    return rows.select(
        "repo", "git_commit", "current_commit", "changed_files", "deleted_files", "total_changes", "has_new_top_dir",
        strategy.alias("strategy"), reason.alias("reason"),
    )


def commit_distance(commits: DataFrame, meta: DataFrame, now: str) -> DataFrame:
    """Age in days of the map's commit and the number of later commits, per repository.

    ``commits`` is (repo, commit, committed_at, ordinal); a commit that is not
    listed has age 0 and nothing ahead.
    """
    built = meta.select("repo", F.col("git_commit").alias("commit")).join(
        commits.select("repo", "commit", F.col("ordinal").alias("_at"), F.col("committed_at").alias("_when")), ["repo", "commit"], "left"
    )
    ahead = (
        commits.join(built.select("repo", "_at"), "repo")
        .filter(F.col("ordinal") > F.col("_at"))
        .groupBy("repo").agg(F.count(F.lit(1)).alias("_ahead"))
    )
    seconds = F.unix_timestamp(F.lit(now).cast("timestamp")) - F.unix_timestamp(F.col("_when").cast("timestamp"))
    return built.join(ahead, "repo", "left").select(
        "repo", F.col("commit").alias("git_commit"),
        F.coalesce(F.floor(seconds / 86400), F.lit(0)).cast("bigint").alias("commit_age_days"),
        F.coalesce("_ahead", F.lit(0)).cast("bigint").alias("commits_ahead"),
    )


def map_status(meta: DataFrame, strategies: DataFrame, distances: DataFrame) -> DataFrame:
    """Version, commits, change counts and verdict of every existing map."""
    from codeloom.operators.versions import version_string

    verdict = (
        F.when(F.col("total_changes") == 0, F.lit("up-to-date"))
        .when(F.col("strategy") == "full-rebuild", F.lit("full-rebuild-recommended"))
        .otherwise(F.lit("update-recommended"))
    )
    return (
        meta.select("repo", version_string().alias("version"), "schema_version")
        .join(strategies, "repo").join(distances.drop("git_commit"), "repo", "left")
        .select(
            "repo", "version", "schema_version",
            F.substring("git_commit", 1, 7).alias("build_commit_short"),
            F.substring("current_commit", 1, 7).alias("current_commit_short"),
            "commit_age_days", "commits_ahead", "total_changes", "changed_files", "deleted_files", "strategy", "reason",
            verdict.alias("verdict"),
        )
    )
