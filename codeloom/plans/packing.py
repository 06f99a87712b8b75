"""Packing files into work units of about equal size, in directory order."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom import constants as C
from codeloom.functions.paths import directory, is_complex_file, sort_key
from codeloom.session import cut_lineage

# Packing is a scan with a small state: the size of the open task, or NONE.
NONE = -1


def _advance(open_size: int, loc: int, effective: int, moved: bool, target: int) -> tuple[int, int]:
    """State after one file, and 1 if the file starts a task."""
    if loc > target:
        return NONE, 1
    if open_size < 0 or open_size + effective > target or (moved and open_size * 2 >= target):
        return effective, 1
    return open_size + effective, 0


def _advance_all(open_size: np.ndarray, loc: int, effective: int, moved, target: int) -> tuple[np.ndarray, np.ndarray]:
    """``_advance`` for an array of states at once."""
    if loc > target:
        return np.full_like(open_size, NONE), np.ones_like(open_size)
    full = (open_size + effective > target) | (moved & (open_size * 2 >= target))
    starts = (open_size < 0) | full
    return np.where(starts, effective, open_size + effective), starts.astype(np.int64)


class _EveryEntry:
    """Follows a chunk's rows from every possible entry state at once.

    An entry state is the open size and whether the chunk's first file changes
    directory. States soon fall together, so the work shrinks to one state.
    """

    def __init__(self, target: int):
        sizes = np.arange(target + 1)
        self.moved = np.concatenate([[False], np.repeat([False, True], target + 1)])
        self.open = np.concatenate([[NONE], sizes, sizes])
        self.group = np.arange(len(self.open))
        self.extra = np.zeros(len(self.open), dtype=np.int64)
        self.started = np.zeros(len(self.open), dtype=np.int64)
        self.target = target

    def step(self, loc: int, effective: int, moved: bool, first: bool) -> None:
        if len(self.open) == 1:
            changes = bool(self.moved[0]) if first else moved
            self.open[0], starts = _advance(int(self.open[0]), loc, effective, changes, self.target)
            self.started[0] += starts
        else:
            changes = self.moved if first else moved
            self.open, starts = _advance_all(self.open, loc, effective, changes, self.target)
            self.started = self.started + starts
            self.open, merged = np.unique(self.open, return_inverse=True)
            self.extra = self.extra + self.started[self.group]
            self.group = merged[self.group]
            self.started = np.zeros(len(self.open), dtype=np.int64)

    def table(self) -> tuple[list[int], list[int]]:
        """(exit state, tasks started) for each entry state."""
        return self.open[self.group].tolist(), (self.extra + self.started[self.group]).tolist()


def _rows(batches: Iterator[pd.DataFrame], columns: list[str]):
    for batch in batches:
        yield from batch[columns].itertuples(index=False, name=None)


_SCAN = ["chunk", "repo", "dir", "loc", "effective_loc"]


def _chunk_tables(target: int):
    """Per chunk and repository: first and last directory and the transition from entry to exit state.

    Only a chunk's first repository can continue from the chunk before; any
    other one is entered with no open task.
    """
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out, current, table, first_dir, last_dir, is_first = [], None, None, None, None, True

        def emit():
            exits, starts = table.table()
            # Runs of equal results are kept once, with the first entry state they hold for.
            pairs = list(zip(exits, starts))
            heads = [i for i, pair in enumerate(pairs) if i == 0 or pair != pairs[i - 1]]
            out.append((
                current[0], current[1], first_dir, last_dir, is_first, heads, [pairs[i][0] for i in heads], [pairs[i][1] for i in heads],
            ))

        for chunk, repo, where, loc, effective in _rows(batches, _SCAN):
            if (chunk, repo) != current:
                if current is not None:
                    emit()
                    is_first = False
                current, first_dir, last_dir = (chunk, repo), where, where
                table = _EveryEntry(target)
                if not is_first:
                    table.open, table.group, table.moved = table.open[:1], table.group[:1], table.moved[:1]
                    table.extra, table.started = table.extra[:1], table.started[:1]
                table.step(loc, effective, False, True)
            else:
                table.step(loc, effective, where != last_dir, False)
                last_dir = where
        if current is not None:
            emit()
        yield pd.DataFrame(out, columns=["chunk", "repo", "first_dir", "last_dir", "is_first", "heads", "exits", "starts"])

    return run


def _chain_chunks(target: int):
    """Entry state and task offset of each chunk of one repository, in order."""
    def run(chunks: pd.DataFrame) -> pd.DataFrame:
        chunks = chunks.sort_values("chunk")
        state, offset, last_dir, out = NONE, 0, None, []
        for row in chunks.itertuples(index=False):
            moved = last_dir is not None and last_dir != row.first_dir
            entry = 0 if state == NONE else 1 + state + (target + 1 if moved else 0)
            out.append((row.chunk, row.repo, state, bool(moved), offset))
            at = int(np.searchsorted(np.asarray(row.heads), entry, side="right")) - 1
            state, offset, last_dir = int(row.exits[at]), offset + int(row.starts[at]), row.last_dir
        return pd.DataFrame(out, columns=["chunk", "repo", "entry_open", "entry_moved", "entry_tasks"])

    return run


def _assign(target: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, last_dir, state, task = None, None, NONE, 0
        for batch in batches:
            numbers = []
            scan = batch[["chunk", "repo", "dir", "loc", "effective_loc", "entry_open", "entry_moved", "entry_tasks"]]
            for chunk, repo, where, loc, effective, entry_open, entry_moved, entry_tasks in scan.itertuples(index=False, name=None):
                if (chunk, repo) != current:
                    current, state, task, moved = (chunk, repo), int(entry_open), int(entry_tasks), bool(entry_moved)
                else:
                    moved = where != last_dir
                state, starts = _advance(state, loc, effective, moved, target)
                task += starts
                last_dir = where
                numbers.append(task)
            yield batch[["repo", "path", "dir", "language", "loc", "effective_loc", "trimmed"]].assign(task_no=numbers)

    return run


def pack_tasks(files: DataFrame, target: int = C.TARGET_LOC, cap: int = C.LOC_CAP, order: str = "binary") -> DataFrame:
    """(repo, path, dir, language, loc, effective_loc, trimmed, task_no, task_id).

    Files in directory and path order join the open task until it would exceed
    the target, or until the directory changes and the task is at least half
    full; a file above the target is a task of its own.

    The scan is sequential per repository, yet no repository has to fit into
    one task: rows are range-partitioned into chunks of the sort order, each
    chunk reports its transition from any entry state, the short chain of chunk
    reports yields every chunk's true entry state, and a second pass over the
    same chunks numbers the tasks. Chunks are materialised once so that both
    passes see the same boundaries.
    """
    path = F.col("path")
    rows = files.select(
        "repo", "path", directory(path).alias("dir"), "language",
        F.col("line_count").cast("bigint").alias("loc"),
        F.least(F.col("line_count"), F.lit(cap)).cast("bigint").alias("effective_loc"),
    ).withColumn("trimmed", F.col("effective_loc") < F.col("loc"))
    keys = ["repo", sort_key(F.col("dir"), order), sort_key(path, order)]
    chunks = cut_lineage(
        rows.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("chunk", F.spark_partition_id())
    )
    tables = chunks.select(_SCAN).mapInPandas(
        _chunk_tables(target),
        "chunk int, repo string, first_dir string, last_dir string, is_first boolean, "
        "heads array<int>, exits array<bigint>, starts array<bigint>",
    )
    entries = tables.groupBy("repo").applyInPandas(
        _chain_chunks(target), "chunk int, repo string, entry_open bigint, entry_moved boolean, entry_tasks bigint"
    )
    # At most one row per chunk continues an earlier one; all others start afresh.
    continued = entries.filter((F.col("entry_tasks") > 0) | (F.col("entry_open") != NONE))
    entered = chunks.join(F.broadcast(continued), ["chunk", "repo"], "left").fillna(
        {"entry_open": NONE, "entry_moved": False, "entry_tasks": 0}
    )
    packed = entered.mapInPandas(
        _assign(target),
        "repo string, path string, dir string, language string, loc bigint, effective_loc bigint, trimmed boolean, task_no bigint",
    )
    number = F.col("task_no").cast("string")
    padded = F.when(F.length(number) < 3, F.lpad(number, 3, "0")).otherwise(number)
    return packed.withColumn("task_id", F.concat(F.lit("task_"), padded))


def task_summary(assignments: DataFrame) -> DataFrame:
    """One row per task: files, sizes, main directory and the agent it calls for."""
    demanding = (F.col("loc") > C.LARGE_LOC) | is_complex_file(F.col("path"), F.col("loc"))
    per_dir = assignments.groupBy("repo", "task_id", "dir").agg(
        F.count(F.lit(1)).alias("_n"),
        F.sum("effective_loc").alias("_effective"),
        F.sum("loc").alias("_original"),
        F.bool_or(demanding).alias("_demanding"),
    )
    return per_dir.groupBy("repo", "task_id").agg(
        F.sum("_n").alias("file_count"),
        F.sum("_effective").alias("total_loc"),
        F.sum("_original").alias("original_loc"),
        # Files come in directory order, so of equally large directories the first seen is the smallest.
        F.min_by("dir", F.struct(-F.col("_n"), F.col("dir"))).alias("primary_directory"),
        F.when(F.bool_or("_demanding"), F.lit("medium")).otherwise(F.lit("small")).alias("agent_size"),
    )


def plan_totals(assignments: DataFrame) -> DataFrame:
    """Tasks, files and sizes of the whole plan of each repository."""
    files = assignments.groupBy("repo").agg(
        F.count(F.lit(1)).alias("total_files"),
        F.sum("loc").alias("total_loc"),
        F.count_if("trimmed").alias("trimmed_files"),
    )
    size = lambda name: F.count_if(F.col("agent_size") == name)
    tasks = task_summary(assignments).groupBy("repo").agg(
        F.count(F.lit(1)).alias("tasks"),
        F.min("total_loc").alias("min_loc"),
        F.floor(F.avg("total_loc") + 0.5).cast("bigint").alias("avg_loc"),
        F.max("total_loc").alias("max_loc"),
        size("small").alias("small_tasks"),
        size("medium").alias("medium_tasks"),
        size("large").alias("large_tasks"),
        F.count_if(F.col("total_loc") > 2000).alias("high_loc_tasks"),
    )
    return files.join(tasks, "repo")


def plan_warnings(assignments: DataFrame, large_file: int = C.TARGET_LOC) -> DataFrame:
    """Balance of each plan, its warnings and a comparison with tasks of a fixed number of files."""
    big = assignments.groupBy("repo").agg(F.count_if(F.col("loc") >= large_file).alias("_big"))
    totals = plan_totals(assignments).join(big, "repo")
    ratio = F.when(F.col("min_loc") > 0, F.format_string("%.1f", F.col("max_loc") / F.col("min_loc"))).otherwise(F.lit("N/A"))
    note = lambda holds, *parts: F.when(holds, F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts]))
    count = lambda name: F.col(name).cast("string")
    warnings = F.array_compact(F.array(
        note(F.try_to_number(F.col("imbalance_ratio"), F.lit("9999999999.0")) > 5, "Largest and smallest task differ by a factor of ", F.col("imbalance_ratio")),
        note(F.col("high_loc_tasks") > 0, count("high_loc_tasks"), " tasks are above 2000 lines"),
        note(F.col("trimmed_files") > 0, count("trimmed_files"), " files are cut to fit a prompt"),
        note(F.col("_big") > 0, count("_big"), f" files of {large_file} lines or more"),
    ))
    by_count = F.ceil(F.col("total_files") / C.MAX_FILES_PER_TASK).cast("bigint")
    return totals.withColumn("imbalance_ratio", ratio).select(
        "repo", "tasks", "imbalance_ratio", warnings.alias("warnings"),
        by_count.alias("tasks_by_file_count"), (F.col("tasks") - by_count).alias("extra_tasks"),
    )


def check_assignments(assignments: DataFrame, files: DataFrame, declared: DataFrame | None = None) -> DataFrame:
    """(repo, rule, subject): files without a task, files in several, repeated task ids, count mismatches.

    ``declared`` is the plan's own statement (repo, total_files) and, for
    repeated ids, ``check_task_ids`` takes its task list.
    """
    keys = ["repo", "path"]
    missing = files.select(keys).distinct().join(assignments.select(keys), keys, "left_anti").select(
        "repo", F.lit("unassigned_file").alias("rule"), F.col("path").alias("subject")
    )
    repeated = assignments.groupBy(keys).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > 1).select(
        "repo", F.lit("file_in_several_tasks").alias("rule"), F.col("path").alias("subject")
    )
    counted = assignments.groupBy("repo").agg(F.count(F.lit(1)).alias("total_files")) if declared is None else declared.select("repo", "total_files")
    actual = files.groupBy("repo").agg(F.count(F.lit(1)).alias("_actual"))
    mismatch = counted.join(actual, "repo", "full").filter(~F.col("total_files").eqNullSafe(F.col("_actual"))).select(
        "repo", F.lit("file_count_mismatch").alias("rule"),
        F.concat(
            F.lit("plan has "), F.coalesce("total_files", F.lit(0)).cast("string"),
            F.lit(", scan has "), F.coalesce("_actual", F.lit(0)).cast("string"),
        ).alias("subject"),
    )
    return missing.unionByName(repeated).unionByName(mismatch)


def check_task_ids(tasks: DataFrame) -> DataFrame:
    """Task ids that occur more than once in a task list (repo, task_id)."""
    return tasks.groupBy("repo", "task_id").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > 1).select(
        "repo", F.lit("duplicate_task_id").alias("rule"), F.col("task_id").alias("subject")
    )
