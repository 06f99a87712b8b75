from __future__ import annotations

from pyspark.sql import functions as F

from codeloom.operators import graph as G
from codeloom.operators import joins, ranking
from codeloom.schemas import Graph
from conftest import rows


def nested(g):
    return {r.path: (r.imports, r.imported_by) for r in G.adjacency(g).collect()}


def test_build(notes):
    files = notes(("index", ["auth", "utils"]), ("auth", ["utils", "utils", "gone"]), ("utils",), ("self", ["self"]))
    assert nested(G.build_graph(files)) == {
        "index": (["auth", "utils"], []), "auth": (["gone", "utils", "utils"], ["index"]), "utils": ([], ["auth", "index"]), "self": (["self"], ["self"])}
    assert rows(G.edges(files).filter("not resolved"), "src", "dst") == [("auth", "gone")]


def test_repositories_do_not_mix(notes):
    g = G.build_graph(notes(("a", ["b"])).unionByName(notes(("b",), repo="other")))
    assert g.importers.count() == 0


def test_stored_form(spark, notes):
    g = G.build_graph(notes(("hub",), *[(f"f{i:03d}", ["hub", "hub", "gone"]) for i in range(40)]))
    back = G.from_listed(G.listed(g))
    assert all(rows(getattr(back, part)) == rows(getattr(g, part)) for part in Graph._fields)
    parts = [[(r.path, r.direction, r.other or "") for r in p] for p in G.listed(g).rdd.glom().collect()]
    assert all(p == sorted(p) for p in parts)


def test_update_equals_rebuild(notes, table):
    before = notes(("a", ["b", "c"]), ("b", ["c"]), ("c",), ("d", ["new", "b"]), ("e", ["a"]))
    updated = notes(("b", ["a", "new"]), ("new", ["c"]))
    deleted = table([("r", "c")], "repo string, path string")
    got = nested(G.update_graph(G.build_graph(before), updated, deleted))
    # The updated files keep the imports they were annotated with, even of deleted files.
    assert got == {"a": (["b"], ["b", "e"]), "b": (["a", "new"], ["a", "d"]), "d": (["b", "new"], []), "e": (["a"], []), "new": (["c"], ["b", "d"])}


def test_stats(graph_of):
    row = G.graph_stats(graph_of({"a": (["b", "c"], []), "b": ([], ["a"]), "c": ([], ["a"]), "d": ([], [])})).first()
    assert (row.total_files, row.total_imports, row.avg_imports_per_file, row.max_imports, row.max_imported_by, row.orphan_count) == (4, 2, 0.5, 2, 1, 1)
    assert G.graph_stats(graph_of({"x": ([], [])})).first().avg_imports_per_file == 0.0


def test_diff(graph_of):
    old = graph_of({"a": (["b", "b", "c"], []), "b": ([], ["a"]), "gone": (["b", "b"], [])})
    new = graph_of({"a": (["b"], ["n"]), "b": ([], ["a"]), "n": (["a"], [])})
    got = {(r.path, r.direction): (r.added, r.removed) for r in G.graph_diff(old, new).collect()}
    assert got == {("a", "imports"): (0, 1), ("a", "imported_by"): (1, 0), ("gone", "imports"): (0, 2), ("n", "imports"): (1, 0)}
    assert G.edges_updated(old, new).first().edges_updated == 5


def test_diff_counts_an_import_and_its_reverse_as_one_pair(graph_of):
    old = graph_of({"a": (["b", "b", "a"], ["a"]), "b": ([], ["a", "x"]), "gone": (["a"], [])})
    new = graph_of({"a": (["c"], ["a"]), "b": ([], ["a"]), "c": ([], ["a", "a"])})
    diff = G.graph_diff(old, new)
    assert rows(diff, "path", "direction", "added", "removed") == [("a", "imports", 1, 2), ("b", "imported_by", 0, 1), ("c", "imported_by", 2, 0), ("gone", "imports", 0, 1)]
    plan = diff._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate [repo" in plan and not any("Aggregate [" in line and "other" in line.split("],")[0] for line in plan.splitlines())


def test_broken_references(graph_of, table):
    g = graph_of({"a": (["x"], ["x", "b"]), "b": (["a"], [])})
    assert rows(G.broken_references(g, table([("r", "x")], "repo string, path string")), "path", "direction") == [("a", "imported_by"), ("a", "imports")]


def test_neighbours(notes, table):
    files = notes(("src/a", ["src/b", "lib/c", "none"]), ("src/b", ["lib/c"]), ("lib/c",), ("app/d", ["src/a", "src/b"]))
    g = G.build_graph(files)
    queries = table([(1, "r", "src/a"), (2, "r", "missing")], "query_id int, repo string, path string")
    assert rows(G.dependencies(queries, g, files), "query_id", "path") == [(1, "lib/c"), (1, "src/b")]
    both = table([(1, "r", "src/a"), (1, "r", "src/b")], "query_id int, repo string, path string")
    assert rows(G.dependents(both, g, files), "query_id", "path") == [(1, "app/d"), (1, "src/a")]
    dirs = table([(1, "r", "src"), (2, "r", "lib/")], "query_id int, repo string, prefix string")
    assert rows(G.external_dependents(dirs, g, files), "query_id", "path") == [(1, "app/d"), (2, "src/a"), (2, "src/b")]


def test_ranking(notes, graph_of):
    files = notes(("big", [], ["x"], 1500), ("hub", [], ["x", "y"], 10), ("lone", [], [], 1000), ("tie", [], [], 5))
    g = graph_of({"big": (["hub"], ["a", "b"]), "hub": ([], ["big", "z", "q"])})
    ranked = [(r.path, r.score, r.connectivity) for r in ranking.rank_files(files, g).collect()]
    assert ranked == [("hub", 21, 3), ("big", 10, 3), ("lone", 0, 0), ("tie", 0, 0)]
    scored = ranking.scored_files(files, g)
    assert [r.path for r in ranking.top_files(scored, 2).collect()] == ["hub", "big"]
    assert ranking.top_files(scored, 0).count() == 0
    assert ranking.top_files(scored, 1, per=["repo"]).first().path == "hub"


def test_section_limits(notes):
    got = ranking.limit_section(notes(*[(f"f{i}",) for i in range(7)]), 5, ["repo"], [F.col("path")]).collect()
    assert len(got) == 5 and {(r.total, r.remaining) for r in got} == {(7, 2)}


def test_top_n_cuts_groups_before_the_shuffle(notes):
    plan = ranking.top_n(notes(("a",)), 3, ["repo"], [F.col("path")])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2 and "Partial" in plan


def test_scopes_match_brute_force(table):
    names = ["src/auth/a.ts", "lib/src/x.ts", "authority.md", "b/c/d.ts", "z"]
    scopes = ["src/", "auth", "src/auth/", "c/d", "d.ts", "z", "a", "authority.md", "no", "/", ".t"]
    files = table([("r", p) for p in names] + [("s", "src/other.ts")], "repo string, path string")
    tasks = table([("r", i, s) for i, s in enumerate(scopes)], "repo string, task_id int, scope string")
    got = {(r.task_id, r.path) for r in joins.match_scopes(tasks, files).collect()}
    assert got == {(i, p) for i, s in enumerate(scopes) for p in names if (p.startswith(s) if s.endswith("/") else s in p)}


def test_merge(notes, table):
    merged = joins.merge_annotations(notes(("a",), ("b",), ("c",)), notes(("b", ["a"]), ("d",)), table([("r", "c")], "repo string, path string"))
    assert {r.path: r.imports for r in merged.collect()} == {"a": [], "b": ["a"], "d": []}


def test_remaining_tasks(table):
    tasks = joins.scope_task_id(table([("r", 0, "src/auth/"), ("r", 1, "lib")], "repo string, task_index int, scope string"))
    done = table([("r", "task_0_src_auth_")], "repo string, task_id string")
    assert [r.task_id for r in joins.remaining_tasks(tasks, done).collect()] == ["task_1_lib"]


def test_chain_of_a_thousand(notes):
    files = notes(*[(f"f{i:04d}", [f"f{i + 1:04d}"]) for i in range(1000)])
    assert G.build_graph(files).importers.count() == 999
    assert isinstance(G.build_graph(files), Graph)
