from __future__ import annotations

import random

import pytest

from codeloom.operators import checks, cycles, repair
from codeloom.operators.graph import build_graph
from codeloom.schemas import Graph
from codeloom.session import stored
from conftest import rows

PATHS = "repo string, path string"


@pytest.fixture
def paths(table):
    return lambda *names: table([("r", n) for n in names], PATHS)


def test_missing_imports(notes):
    got = checks.missing_imports(notes(("a", ["b", "x", "x"]), ("b",)))
    assert rows(got, "file", "message") == [("a", 'Imports "x" which is not in the map')] * 2


def test_asymmetry_has_four_cases(graph_of):
    g = graph_of({"a": (["b", "gone"], ["ghost", "b"]), "b": ([], [])})
    got = {(r.type, r.message) for r in checks.asymmetric_edges(g).collect()}
    assert got == {
        ("broken_graph_reference", 'Graph references "gone" which doesn\'t exist in graph'),
        ("asymmetric_graph", 'Imports "b" but "b" doesn\'t list it in imported_by'),
        ("broken_graph_reference", 'Graph lists "ghost" in imported_by but it doesn\'t exist in graph'),
        ("asymmetric_graph", 'Listed in "b" imported_by but "b" doesn\'t import it'),
    }
    assert not checks.graph_consistency(g).first().consistent
    assert checks.graph_consistency(graph_of({"a": (["b"], []), "b": ([], ["a"])})).first().consistent


def test_deleted_files(notes, paths):
    assert rows(checks.deleted_files(notes(("a",), ("b",)), paths("a")), "file") == [("b",)]


def test_mismatch(notes, graph_of):
    got = checks.graph_annotation_mismatch(graph_of({"a": (["x", "x"], []), "only": (["q"], [])}), notes(("a", ["y"]), ("b", ["z"])))
    assert rows(got, "severity", "file") == [("error", "b"), ("error", "only"), ("warning", "a"), ("warning", "a")]


def test_orphans(notes, graph_of, paths):
    files = notes(("main",), ("conf",), ("used",), ("lone",), ("unknown",))
    g = graph_of({"main": (["used"], []), "conf": ([], []), "used": ([], ["main"]), "lone": ([], [])})
    assert rows(checks.orphan_files(files, g, paths("main"), paths("conf")), "file") == [("lone",)]


def test_no_exports(notes, paths):
    files = notes(("a", ["b"]), ("b", [], ["x"]), ("a.test.ts", ["b"]), ("main", ["b"]), ("idle",))
    assert rows(checks.no_exports(files, paths("main")), "file") == [("a",)]


@pytest.mark.parametrize("edges, groups", [
    ([("a", "b"), ("b", "a")], [{"a", "b"}]),
    ([("a", "b"), ("b", "c"), ("c", "a")], [{"a", "b", "c"}]),
    ([("a", "b"), ("b", "c"), ("a", "c")], []),
    ([("a", "a")], [{"a"}]),
    ([("a", "a"), ("a", "b"), ("b", "a"), ("b", "c"), ("c", "d"), ("d", "c"), ("d", "x")], [{"a", "b"}, {"c", "d"}]),
    ([], []),
])
def test_cycles(notes, edges, groups):
    names = sorted({n for e in edges for n in e} | {"z"})
    g = build_graph(notes(*[(n, [d for s, d in edges if s == n]) for n in names]))
    found: dict[str, set[str]] = {}
    for r in cycles.cycle_members(g).collect():
        found.setdefault(r.cycle, set()).add(r.path)
    assert sorted(map(sorted, found.values())) == sorted(map(sorted, groups))
    assert all(cycle == min(members) for cycle, members in found.items())


def test_cycle_message(notes):
    row = cycles.circular_dependencies(build_graph(notes(("src/b", ["src/a"]), ("src/a", ["src/b"])))).first()
    assert (row.severity, row.type, row.file) == ("info", "circular_dependency", "src/a")
    assert row.message == "Circular dependency detected: 2 files, first src/a"


@pytest.mark.parametrize("part, seed", [(100_000, 7), (4, 8)])
def test_cycles_match_brute_force(table, notes, monkeypatch, part, seed):
    """In one part, and in parts so small that cycles run through many."""
    monkeypatch.setattr(cycles, "PART_EDGES", part)
    rng = random.Random(seed)
    names = [f"n{i:02d}" for i in range(40)]
    pairs = {(rng.choice(names), rng.choice(names)) for _ in range(55)}
    reach = {n: {d for s, d in pairs if s == n} for n in names}
    for _ in names:
        reach = {n: reach[n] | {x for m in reach[n] for x in reach[m]} for n in names}
    want = {(min(m for m in names if m in reach[n] and n in reach[m]), n) for n in names if n in reach[n]}
    g = build_graph(notes(*[(n, sorted(d for s, d in pairs if s == n)) for n in names]))
    assert {(r.cycle, r.path) for r in cycles.cycle_members(g).collect()} == want


def test_chain_of_many_small_components(spark, table, monkeypatch):
    """Three hundred rings of three, each importing the next, cut into parts that split rings, in few tables."""
    monkeypatch.setattr(cycles, "PART_EDGES", 100)
    written = []
    for module in (cycles,):
        keep = module.stored
        monkeypatch.setattr(module, "stored", lambda df, *a: written.append(1) or keep(df, *a))
    order = list(range(900))
    random.Random(3).shuffle(order)
    name = lambda i: f"n{order[i]:04d}"
    pairs = []
    for i in range(0, 900, 3):
        pairs += [(name(i), name(i + 1)), (name(i + 1), name(i + 2)), (name(i + 2), name(i))] + ([(name(i + 2), name(i + 3))] if i < 897 else [])
    imports = table([("r", a, b) for a, b in pairs], "repo string, path string, target string")
    found = cycles.cycle_members(Graph(imports.select("repo", "path"), imports, imports)).collect()
    want = {("r", min(name(j) for j in range(i, i + 3)), name(k)) for i in range(0, 900, 3) for k in range(i, i + 3)}
    assert {tuple(x) for x in found} == want and len(found) == 900
    assert len(written) < 30


def test_only_edges_that_lead_on_are_compared(table, monkeypatch):
    """A cycle of three files that import two hundred others: what imports nothing goes into no table."""
    sizes, keep = [], cycles.stored
    monkeypatch.setattr(cycles, "stored", lambda df, *a: (kept := keep(df, *a), sizes.append(kept.count()))[0])
    pairs = [("a", "b"), ("b", "c"), ("c", "a"), ("a", "b"), ("s", "s"), *[(n, f"leaf{i:03d}") for n in "abc" for i in range(200)]]
    imports = table([("r", a, b) for a, b in pairs], "repo string, path string, target string")
    found = cycles.cycle_members(Graph(imports.select("repo", "path"), imports, imports.limit(0).withColumnRenamed("target", "importer")))
    assert rows(found) == [("r", "a", "a"), ("r", "a", "b"), ("r", "a", "c"), ("r", "s", "s")]
    assert max(sizes) <= 6


@pytest.mark.parametrize("whole, tables", [(12, 12), (0, 1000)])
def test_scattered_ring(table, monkeypatch, whole, tables):
    """Files of a ring lie in other parts than their neighbours: repositories whole in the end, or label rounds if they are too large for that."""
    monkeypatch.setattr(cycles, "PART_EDGES", 20)
    monkeypatch.setattr(cycles, "WHOLE_PARTS", whole, raising=False)
    written, keep = [], cycles.stored
    monkeypatch.setattr(cycles, "stored", lambda df, *a: written.append(1) or keep(df, *a))
    order = [f"n{i * 37 % 101:03d}" for i in range(101)]
    imports = table([("r", a, b) for a, b in zip(order, [*order[1:], order[0]])], "repo string, path string, target string")
    found = cycles.cycle_members(Graph(imports.select("repo", "path"), imports, imports)).collect()
    assert {tuple(x) for x in found} == {("r", "n000", n) for n in order} and len(found) == 101
    assert len(written) < tables


@pytest.mark.parametrize("part", [100_000, 70])
def test_long_cycles(spark, table, monkeypatch, part):
    """A ring, a two-way chain and a tail of hundreds of files each, in two repositories."""
    monkeypatch.setattr(cycles, "PART_EDGES", part)
    name = lambda i: f"n{i:04d}"
    ring = [(name(i), name((i + 1) % 300)) for i in range(300)]
    chain = [p for i in range(400, 700) for p in ((name(i), name(i + 1)), (name(i + 1), name(i)))]
    tail = [(name(i), name(i + 1)) for i in range(800, 1100)]
    imports = table([(r, a, b) for r in ("r", "s") for a, b in ring + chain + tail], "repo string, path string, target string")
    g = Graph(imports.select("repo", "path"), imports, imports)
    want = {(r, name(0), name(i)) for r in ("r", "s") for i in range(300)} | {(r, name(400), name(i)) for r in ("r", "s") for i in range(400, 701)}
    assert {tuple(x) for x in cycles.cycle_members(g).collect()} == want


def test_repairs(notes, graph_of, paths):
    files = notes(("a", ["b", "gone", "none"]), ("b",), ("gone",))
    g = graph_of({"a": (["b", "gone", "none"], []), "b": ([], ["gone"]), "gone": (["b"], ["a"])})
    fixed = repair.autofix(files, g, paths("a", "b"))
    assert {r.path: r.imports for r in fixed.annotations.collect()} == {"a": ["b"], "b": []}
    assert rows(fixed.graph.nodes, "path") == [("a",), ("b",)]
    assert rows(fixed.graph.importers, "path", "importer") == [("b", "a")]
    assert rows(fixed.log, "type", "message") == [
        ("asymmetric_graph", 'Added missing imported_by reference from "a"'),
        ("deleted_file", "Removed deleted file from map"),
        ("missing_import", 'Removed import to non-existent file "gone"'),
        ("missing_import", 'Removed import to non-existent file "none"'),
    ]
    assert checks.asymmetric_edges(fixed.graph).count() == 0


def test_wrong_reverse_entries_are_removed(notes, graph_of):
    fixed = repair.fix_imported_by(notes(("a",), ("b",)), graph_of({"a": ([], ["b"]), "b": ([], [])}))
    assert rows(fixed.log, "file", "message") == [("a", 'Removed incorrect imported_by reference from "b"')]


def test_validation(notes, graph_of, paths):
    files, g = notes(("a", ["b", "none"]), ("b", ["a"])), graph_of({"a": (["b", "none"], ["b"]), "b": (["a"], ["a"])})
    result = repair.validate_map(files, g, paths("a", "b"), paths(), paths())
    row = result.summary.first()
    assert (row.errors, row.warnings, row.info, row.auto_fixed, row.requires_attention) == (1, 0, 0, 1, 1)
    raw = repair.validate_map(files, g, paths("a", "b"), paths(), paths(), fix=False, include_info=True)
    assert rows(raw.issues, "severity", "type") == [
        ("error", "broken_graph_reference"), ("error", "missing_import"), ("info", "circular_dependency"), ("info", "no_exports"), ("info", "no_exports")]
    assert raw.summary.first().auto_fixed == 0
    assert {r.type: r.issues for r in checks.issues_by_type(raw.issues).collect()}["no_exports"] == 2
    assert {r.file: r.issues for r in checks.issues_by_file(raw.issues).collect()} == {"a": 4, "b": 1}


def test_consistency_is_the_four_checks_together(spark, table, graph_of):
    """Odd rows included: repeated files, entries and nodes, missing paths, targets and repositories."""
    some = [None, "a", "b", "c", "ghost"]
    draw = random.Random(11)
    repo = lambda: draw.choice(["r", "r", "r", None])
    files = table(
        [(repo(), draw.choice(some), [draw.choice(some) for _ in range(draw.randrange(4))]) for _ in range(30)] + [("s", "a", None)],
        "repo string, path string, imports array<string>")
    flat = lambda n, *names: table([(repo(), *[draw.choice(some) for _ in names]) for _ in range(n)], ", ".join(f"{c} string" for c in ("repo", *names)))
    g = Graph(flat(6, "path"), flat(25, "path", "target"), flat(25, "path", "importer"))
    listing = flat(4, "path")
    together = checks.consistency_issues(files, g, listing)
    apart = checks.union_all([
        checks.missing_imports(files), checks.asymmetric_edges(g), checks.deleted_files(files, listing), checks.graph_annotation_mismatch(g, files)])
    shown = lambda df: sorted(map(str, df.select(apart.columns).collect()))
    assert shown(together) == shown(apart) and {r.type for r in apart.collect()} == {
        "missing_import", "asymmetric_graph", "broken_graph_reference", "deleted_file", "graph_annotation_mismatch"}
    # Three lists of entries and three of files, counted once each.
    plan = together._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join ") == 1 and plan.count("explode(imports") == 1


def test_repairs_look_files_up_in_the_listing_once(notes, graph_of, paths):
    """What several repaired tables read is a table by then; the listing is not read again for each."""
    files = notes(("a", ["b", "gone", "lost"]), ("b", ["a"]), ("gone", ["a"]))
    g = graph_of({"a": (["b", "gone", "lost"], ["b", "gone"]), "b": (["a"], []), "gone": (["a"], ["a"])})
    listing = stored(paths("a", "b"), "listing")
    fixed = repair.autofix(files, g, listing)
    for df in (fixed.log, fixed.annotations, *fixed.graph):
        assert not any("codeloom-listing" in name for name in df.inputFiles())
    assert rows(fixed.log, "type", "file") == [
        ("asymmetric_graph", "b"), ("deleted_file", "gone"), ("missing_import", "a"), ("missing_import", "a")]
    assert rows(fixed.graph.imports, "path", "target") == [("a", "b"), ("b", "a")] == rows(fixed.graph.importers, "path", "importer")
