from __future__ import annotations

import random

import pytest

from codeloom.plans import division, packing
from conftest import rows

FILES = "repo string, path string, language string, line_count long"


@pytest.fixture
def plan(table):
    def make(*files, **options):
        return packing.pack_tasks(table([("r", p, "TypeScript", n) for p, n in files], FILES), **options)

    return make


def by_task(assignments):
    out: dict[str, list[str]] = {}
    for r in sorted(assignments.collect(), key=lambda r: (r.task_no, r.dir, r.path)):
        out.setdefault(r.task_id, []).append(r.path)
    return out


def greedy(files, target, cap):
    """Sequential packing of one repository, the oracle of these tests."""
    folder = lambda p: p.rsplit("/", 1)[0] if "/" in p else "."
    number, size, last, out = 0, None, None, {}
    for path, loc in sorted(files, key=lambda f: (folder(f[0]), f[0])):
        cut = min(loc, cap)
        if loc > target:
            number, size = number + 1, None
        elif size is None or size + cut > target or (folder(path) != last and size >= target / 2):
            number, size = number + 1, cut
        else:
            size += cut
        last = folder(path)
        out[path] = number
    return out


def test_small_directories_share_a_task(plan):
    assert len(by_task(plan(("src/d1/a.ts", 100), ("src/d1/b.ts", 100), ("src/d2/c.ts", 100)))) == 1


def test_directory_change_splits_half_full_tasks(plan):
    packed = plan(("src/d1/a.ts", 200), ("src/d1/b.ts", 200), ("src/d2/c.ts", 200))
    assert by_task(packed) == {"task_001": ["src/d1/a.ts", "src/d1/b.ts"], "task_002": ["src/d2/c.ts"]}
    assert rows(packing.task_summary(packed), "task_id", "primary_directory", "total_loc") == [("task_001", "src/d1", 400), ("task_002", "src/d2", 200)]


def test_large_files_stand_alone(plan):
    packed = plan(("src/small.ts", 50), ("src/huge.ts", 600), ("src/small2.ts", 50))
    assert by_task(packed) == {"task_001": ["src/huge.ts"], "task_002": ["src/small.ts", "src/small2.ts"]}
    row = packed.filter("path = 'src/huge.ts'").first()
    assert (row.loc, row.effective_loc, row.trimmed) == (600, 500, True)


def test_agent_sizes(plan):
    assert packing.task_summary(plan(("src/test.json", 50), ("src/config.yaml", 50))).first().agent_size == "small"
    assert packing.task_summary(plan(("src/x.ts", 150), ("src/y.ts", 150))).first().agent_size == "medium"
    assert packing.task_summary(plan(("notes.md", 301))).first().agent_size == "medium"


@pytest.mark.parametrize("seed, target, cap", [(1, 100, 100), (2, 100, 60), (3, 7, 7), (4, 500, 500)])
def test_chunked_packing_matches_the_sequential_scan(table, seed, target, cap):
    """Four repositories over several chunks, one of them with most of the rows and with hot directories."""
    rng = random.Random(seed)
    corpus = {}
    for repo, n in (("a", 5), ("hot", 600), ("m", 1), ("z", 120)):
        corpus[repo] = [(f"d{rng.randrange(3 if repo == 'hot' else 40):02d}/f{i:04d}.ts", rng.choice([1, 1, 3, 20, 49, 51, 99, 100, 101, 700])) for i in range(n)]
    files = table([(repo, p, "TypeScript", n) for repo, fs in corpus.items() for p, n in fs], FILES)
    packed = packing.pack_tasks(files.repartition(5), target=target, cap=cap)
    got = {(r.repo, r.path): r.task_no for r in packed.collect()}
    assert got == {(repo, p): n for repo, fs in corpus.items() for p, n in greedy(fs, target, cap).items()}


def test_uniform_sizes_never_resynchronise(table):
    """Entry states that stay apart: files of one size in one directory."""
    files = [(f"d/f{i:04d}", 1) for i in range(500)]
    packed = packing.pack_tasks(table([("r", p, None, n) for p, n in files], FILES), target=7, cap=7)
    assert {r.path: r.task_no for r in packed.collect()} == greedy(files, 7, 7)


def test_totals_and_warnings(plan):
    packed = plan(*[(f"d/f{i}.ts", 100) for i in range(4)], ("e/big.ts", 900), ("f/x.ts", 20))
    row = packing.plan_totals(packed).first()
    assert (row.total_files, row.total_loc, row.trimmed_files, row.tasks, row.min_loc, row.avg_loc, row.max_loc) == (6, 1320, 1, 3, 20, 307, 500)
    note = packing.plan_warnings(packed).first()
    assert note.imbalance_ratio == "25.0" and note.tasks_by_file_count == 1 and note.extra_tasks == 2
    assert note.warnings == ["Largest and smallest task differ by a factor of 25.0", "1 files are cut to fit a prompt", "1 files of 500 lines or more"]


def test_assignment_checks(plan, table):
    files = table([("r", p, "TypeScript", 10) for p in ("a", "b")], FILES)
    packed = plan(("a", 10), ("b", 10))
    assert packing.check_assignments(packed, files).count() == 0
    twice = packed.filter("path = 'a'").unionByName(packed.filter("path = 'a'"))
    declared = table([("r", 5)], "repo string, total_files long")
    assert rows(packing.check_assignments(twice, files, declared), "rule", "subject") == [
        ("file_count_mismatch", "plan has 5, scan has 2"), ("file_in_several_tasks", "a"), ("unassigned_file", "b")]
    ids = table([("r", "t1"), ("r", "t1"), ("r", "t2")], "repo string, task_id string")
    assert rows(packing.check_task_ids(ids), "subject") == [("t1",)]


PLAN = "plan_id int, scope string, agent_size string, estimated_files long, execution string, estimated_total_minutes double"


def division_of(table, tasks, total, execution="parallel", minutes=10.0):
    df = table([(1, s, size, n, execution, minutes) for s, size, n in tasks], PLAN)
    counts = table([(1, total)], "plan_id int, total_files long")
    return division.check_plan(df, counts), division.plan_heuristics(df, counts)


@pytest.mark.parametrize("tasks, total, options, rules", [
    ([("a/", "small", 10), ("b/", "medium", 10)], 20, {}, []),
    ([("a/", "small", 51)], 51, {}, ["too_many_files"]),
    ([("a/", "small", 0), ("b/", "small", 10)], 10, {}, ["no_files"]),
    ([("a/", "small", 10)], 20, {}, ["file_total_deviates"]),
    ([("a/", "small", 5), ("a/", "small", 5)], 10, {}, ["duplicate_scope"]),
    ([("a/", "small", 10)], 10, {"execution": "random"}, ["invalid_execution"]),
    ([("a/", "small", 10)], 10, {"minutes": 0.5}, ["invalid_minutes"]),
    ([("a/", "small", 10)], 10, {"minutes": 51.0}, ["slow_estimate"]),
])
def test_division_rules(table, tasks, total, options, rules):
    assert [r.rule for r in division_of(table, tasks, total, **options)[0].collect()] == rules


def test_division_heuristics(table):
    row = division_of(table, [("a", "large", 29), ("b", "large", 1)], 120)[1].first()
    assert row.warnings == ["Many tasks (2/2) are far from the average size", "More than half of the tasks need the largest agent"]
    assert len(row.suggestions) == 4 and row.suggestions[1].startswith("Only 2 tasks for 120 files")
    row = division_of(table, [(str(i), "small", 1) for i in range(21)], 21, execution="sequential")[1].first()
    assert row.warnings == ["The tasks run one after the other"] and len(row.suggestions) == 2
