"""Hot keys: a third of all rows on one key must be split, not gathered."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from codeloom.operators import checks, graph, joins


@pytest.fixture
def skewed(spark):
    """60,000 files of one repository; each imports a file of its own or the hub."""
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "10KB",
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
        "spark.sql.shuffle.partitions": "16",
    }
    before = {key: spark.conf.get(key, None) for key in settings}
    for key, value in settings.items():
        spark.conf.set(key, value)
    i = F.col("id")
    name = lambda n: F.concat(F.lit("src/f"), n.cast("string"))
    files = spark.range(0, 60_000, 1, 8).select(
        F.lit("r").alias("repo"), name(i).alias("path"), F.lit("TypeScript").alias("language"), F.lit(1).cast("bigint").alias("size_bytes"),
        F.lit(1).cast("bigint").alias("line_count"), F.lit("p").alias("purpose"), F.array(F.lit("x")).alias("exports"),
        F.array(F.when(i % 3 == 0, F.lit("src/hub")).otherwise(name(i + 1)), F.lit("src/hub2")).alias("imports"))
    yield files
    for key, value in before.items():
        spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def final_plan(df):
    df.write.format("noop").mode("overwrite").save()
    rows = df.collect()
    return df._jdf.queryExecution().executedPlan().toString(), rows


def test_lookup_of_a_hot_target_is_split(skewed):
    plan, rows = final_plan(checks.missing_entries(skewed))
    assert "skew=true" in plan
    assert len(rows) == 20_000 + 60_000 + 1  # the last file imports one behind the end


def test_edges_of_a_hot_target_are_split(skewed):
    plan, rows = final_plan(graph.edges(skewed))
    assert "skew=true" in plan
    assert sum(r.resolved for r in rows) == 40_000 - 1


def test_degrees_and_stored_form_of_a_hub(spark, skewed):
    files = skewed.unionByName(skewed.limit(1).withColumns({"path": F.lit("src/hub"), "imports": F.array().cast("array<string>")}))
    g = graph.build_graph(files)
    top = graph.degrees(g).orderBy(F.desc("imported_by_count")).first()
    assert (top.path, top.imported_by_count) == ("src/hub", 20_000)
    parts = [p for p in graph.listed(g).rdd.mapPartitions(lambda p: [sum(r.path == "src/hub" for r in p)]).collect() if p]
    assert sum(parts) == 20_001 and len(parts) > 1 and max(parts) < 20_000


def test_scopes_that_end_alike_meet_only_what_they_match(spark, skewed):
    """A third of the scopes end like a third of the paths; candidates stay close to the matches."""
    n = F.col("id")
    paths = spark.range(0, 6000, 1, 8).select(F.lit("r").alias("repo"), F.concat(F.lit("src/m"), n.cast("string"), F.when(n % 3 == 0, "/index.ts").otherwise("/x.ts")).alias("path"))
    tasks = spark.range(300).select(F.lit("r").alias("repo"), n.alias("task_id"), F.concat(F.lit("m"), (n + 1000).cast("string"), F.when(n % 3 == 0, "/index.ts").otherwise("/x")).alias("scope"))
    got = joins.match_scopes(tasks, paths)
    plan, rows = final_plan(got)
    want = {(t, p) for t, s in ((r.task_id, r.scope) for r in tasks.collect()) for p in ((r.path) for r in paths.collect()) if s in p}
    assert {(r.task_id, r.path) for r in rows} == want


def test_blank_scopes_name_no_files(spark):
    tasks = spark.createDataFrame([("r", 1, ""), ("r", 2, None), ("r", 3, "a")], "repo string, task_id int, scope string")
    files = spark.createDataFrame([("r", "a.ts")], "repo string, path string")
    assert [(r.task_id, r.path) for r in joins.match_scopes(tasks, files).collect()] == [(3, "a.ts")]
    assert sorted(r.task_id for r in joins.blank_scopes(tasks).collect()) == [1, 2]


def test_scopes_of_many_tasks_and_files_meet_in_blocks(spark, monkeypatch):
    """A scope of many tasks is joined a block of tasks at a time, one of missing ids included; what is dealt out grows with the files."""
    monkeypatch.setattr(joins, "BLOCK_TASKS", 7)
    monkeypatch.setattr(joins, "SPREAD", 4)
    files = spark.createDataFrame([("r", f"lib/{i}.ts") for i in range(50)] + [("s", "lib/0.ts"), ("r", "src/0.ts")], "repo string, path string")
    tasks = spark.createDataFrame([("r", i, "lib") for i in range(40)] + [("r", None, "lib"), ("r", 3, "lib"), ("s", 1, "lib"), ("s", 2, "src"), ("r", 41, "lib/")], "repo string, task_id int, scope string")
    got = joins.match_scopes(tasks, files)
    plan, rows = final_plan(got)
    found = sorted((r.repo, r.task_id if r.task_id is not None else -1, r.path) for r in rows)
    assert found == sorted([("r", t, f"lib/{i}.ts") for t in [*range(40), -1, 3, 41] for i in range(50)] + [("s", 1, "lib/0.ts")])
    assert "explode(_tasks" in plan
