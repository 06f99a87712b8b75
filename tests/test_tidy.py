"""Disk that written steps leave: no shuffle files, no tables that nothing reads any more."""

from __future__ import annotations

import time
from collections import Counter
from pathlib import Path

from pyspark.sql import functions as F

from codeloom.operators import checks, repair
from codeloom.operators import graph as G
from codeloom.schemas import Graph
from codeloom.session import stored, tidy
from workload import views

SETTING = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shuffle_files(spark):
    folders = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()
    return {f for d in folders for f in Path(d.getPath()).rglob("shuffle_*")}


def test_stored_tables_leave_no_shuffle_files(spark):
    was, before = spark.conf.get(SETTING, None), shuffle_files(spark)
    counts = spark.range(1000).groupBy((F.col("id") % 10).alias("k")).count()
    table = stored(counts.repartition(3, "count"))
    for _ in range(50):
        left = shuffle_files(spark) - before
        if not left:
            break
        time.sleep(0.1)
    assert not left and spark.conf.get(SETTING, None) == was and table.count() == 10
    try:
        with tidy(spark):
            raise KeyError
    except KeyError:
        assert spark.conf.get(SETTING, None) == was


def test_entry_issues_in_steps(spark, notes, graph_of, table):
    """Written in steps or not, the rows are the same; what was looked up is removed."""
    files = notes(("a", ["b", "gone"]), ("b",), ("c", ["a"]))
    g = graph_of({"a": (["b"], ["c", "b"]), "b": ([], []), "c": (["a", "x"], [])})
    listing = table([("r", "a"), ("r", "b")], "repo string, path string")
    at_once, stepwise = [checks.consistency_issues(files, g, listing, write) for write in (False, True)]
    shown = lambda df: Counter(map(str, df.collect()))
    assert shown(at_once) == shown(stepwise) and at_once.count() == 7
    plan = stepwise._jdf.queryExecution().optimizedPlan().toString()
    assert "Join " not in plan and "codeloom-cases" not in plan


def test_updates_and_repairs_are_written_as_they_are_worked_out(spark, notes, graph_of, table):
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    files = notes(("a", ["b", "gone"]), ("b",), ("c", ["a"]))
    g = graph_of({"a": (["b", "gone"], ["c"]), "b": ([], []), "c": (["a"], [])})
    later = G.update_graph(g, notes(("a", ["c"])), table([("r", "b")], "repo string, path string"))
    assert "Join " not in plan(later.imports) and sorted(map(tuple, later.imports.collect())) == [("r", "a", "c"), ("r", "c", "a")]
    assert sorted(map(tuple, later.importers.collect())) == [("r", "a", "c"), ("r", "c", "a")]
    fixed = repair.autofix(files, g, table([("r", "a"), ("r", "b"), ("r", "c")], "repo string, path string"), stored)
    assert "Join " not in plan(fixed.graph.imports) and plan(fixed.log).count("Join ") <= 1
    assert Counter(r.type for r in fixed.log.collect()) == {"missing_import": 1, "asymmetric_graph": 1}


def test_corpus_keeps_no_table_that_is_used_up(spark, tmp_path):
    w = views.Workspace(spark, str(tmp_path / "none"))
    some = lambda: spark.createDataFrame([("r", "a")], "repo string, path string")
    lines = Path(w.derived("lines", some).scratch_path.removeprefix("file:"))
    w.derived("edges", some)
    w.spent("lines", "part_files", "edges")
    assert lines.exists()
    w.derived("part_files", some)
    assert w.part_files().count() == 1 and not lines.exists()
    assert Path(w.derived("lines", some).scratch_path.removeprefix("file:")).exists()


def test_graph_of_the_corpus_reads_imports_from_the_annotations(spark, notes, tmp_path):
    w = views.Workspace(spark, str(tmp_path / "own"))
    w.derived("annotations", lambda: notes(("a", ["b", "b"]), ("b",)))
    g = w.graph()
    assert isinstance(g, Graph) and sorted(map(tuple, g.imports.collect())) == [("r", "a", "b"), ("r", "a", "b")]
    assert sorted(map(tuple, g.importers.collect())) == [("r", "b", "a")]
    assert not [k for k in views._DERIVED if k[1] == w.sf_dir and k[2] == "graph_imports"]
