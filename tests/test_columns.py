from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from codeloom.functions import paths, text
from codeloom.operators import calls, filters


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


@pytest.mark.parametrize("path, name, ext, folder, top", [
    ("src/core/a.ts", "a.ts", ".ts", "src/core", "src"),
    (".env", ".env", "", ".", "."),
    ("x/.env.local", ".env.local", ".local", "x", "x"),
    ("Makefile", "Makefile", "", ".", "."),
    ("a.b.TSX", "a.b.TSX", ".TSX", ".", "."),
    ("v1.2/readme", "readme", "", "v1.2", "v1.2"),
])
def test_path_parts(table, path, name, ext, folder, top):
    row = paths.with_path_parts(table([(path,)], "path string")).first()
    assert (row.name, row.extension, row.dir, row.top_dir) == (name, ext, folder, top)


def test_language(table):
    got = {r.path: r.language for r in paths.with_language(table([("a.TS",), ("b.py",), ("c.unknown",), ("d",)], "path string")).collect()}
    assert got == {"a.TS": "TypeScript", "b.py": "Python", "c.unknown": None, "d": None}


@pytest.mark.parametrize("content, lines", [("", 1), ("a", 1), ("a\nb\n", 3)])
def test_line_count(table, content, lines):
    assert paths.with_size(table([(content,)], "content string")).first().line_count == lines


@pytest.mark.parametrize("path, expected", [
    ("src/./a", "src/a"), ("src/../a", "a"), ("a/../../b", "../b"), ("a/b/../../..", ".."), ("a/..", "."), ("a/../", ""), ("src/x/", "src/x/"),
])
def test_collapse_path(spark, path, expected):
    assert value(spark, paths.collapse_path(F.lit(path))) == expected


def test_ancestors(spark):
    assert value(spark, paths.ancestors(F.lit("a/b/c.ts"))) == ["a/", "a/b/"]
    assert value(spark, paths.ancestors(F.lit("c.ts"))) == []


def test_truncation(spark):
    lines = [str(i) for i in range(20)]
    got = value(spark, text.truncated(F.lit("\n".join(lines)), max_lines=10)).split("\n")
    assert got == lines[:7] + ["", "... [TRUNCATED: 10 lines omitted] ...", ""] + lines[-3:]
    assert value(spark, text.truncated(F.lit("a\nb"), max_lines=2)) == "a\nb"


def test_token_estimate(spark):
    assert [value(spark, paths.token_estimate(F.lit("x" * n))) for n in (0, 1, 4, 5)] == [0, 1, 1, 2]


def test_labels(spark):
    assert value(spark, text.pretty_duration(F.lit(154000))) == "2m 34s"
    assert value(spark, text.pretty_duration(F.lit(59999))) == "59s"
    assert [value(spark, text.pretty_latency(F.lit(ms))) for ms in (999, 1500, 90500)] == ["999ms", "1.5s", "1m 31s"]
    assert value(spark, text.pretty_cost(F.lit(0.16))) == "$0.16"
    assert value(spark, text.grouped_int(F.lit(68450))) == "68,450"


def test_call_keys(table):
    log = table([("Level3_x", "purpose for: src/a.ts "), ("main", "Detect structure")], "level string, purpose string")
    got = [(r.level_number, r.task_id) for r in calls.call_keys(log).collect()]
    assert got == [(3, "src/a.ts"), (0, None)]


def test_classify(table):
    row = paths.classify_files(table([("src/Config.ts", 101)], "path string, line_count long")).first()
    assert (row.is_test, row.is_config_or_test, row.is_complex, row.is_large) == (False, True, True, False)


def test_directory_and_binary_filters(table):
    files = table([(p,) for p in ("src/a.ts", ".github/x.yml", "a/node_modules/b.js", ".env", "img/x.SVG", "bin")], "path string")
    kept = filters.filter_binary_ext(filters.filter_skipped_dirs(files))
    assert sorted(r.path for r in kept.collect()) == [".env", "bin", "src/a.ts"]


def test_binary_content_probe(table):
    files = table([("a", bytearray(b"x" * 8191 + b"\0")), ("b", bytearray(b"x" * 8192 + b"\0")), ("c", bytearray(b""))], "path string, content binary")
    assert [r.path for r in filters.filter_binary_content(files).collect()] == ["b", "c"]


def test_filter_by_path(table):
    files = table([(p,) for p in ("src/auth/a.ts", "src/authx/b.ts", "src/auth", "lib/auth/c.ts")], "path string")
    assert sorted(r.path for r in filters.filter_by_path(files, "src/auth").collect()) == ["src/auth", "src/auth/a.ts"]
    assert [r.path for r in filters.filter_by_path(files, "src/auth/").collect()] == ["src/auth/a.ts"]


def test_match_prefixes_agrees_with_the_single_form(spark, table):
    names = ["src/auth/a.ts", "src/authx/b.ts", "src/auth", "lib/auth/c.ts", "d.ts"]
    files = table([("r", p) for p in names], "repo string, path string")
    wanted = ["src/auth", "src/auth/", "src", "d.ts", "", "lib/auth/c.ts"]
    queries = table([(i, "r", p) for i, p in enumerate(wanted)], "query_id int, repo string, prefix string")
    got = {(r.query_id, r.path) for r in filters.match_prefixes(queries, files).collect()}
    want = {(i, r.path) for i, p in enumerate(wanted) for r in filters.filter_by_path(files, p).collect()}
    assert got == want


def test_match_prefixes_keys_directories(table):
    """Ancestors are listed for directories, of which there are fewer than files; repeated files are kept."""
    files = table([("r", "a/b/c/f.ts", 1), ("r", "a/b/c/f.ts", 2), ("r", "a/b/", 3), ("r", "a", 4), ("r", None, 5), (None, "a/x", 6), ("q", "a/b/f.ts", 7)], "repo string, path string, n int")
    queries = table([(1, "r", "a"), (2, "r", "a/b/"), (3, "r", "a/b/c/f.ts"), (4, "r", "a/b/c/f.ts/"), (5, "r", None), (6, None, "a")], "query_id int, repo string, prefix string")
    got = filters.match_prefixes(queries, files)
    assert got.columns == ["repo", "path", "n", "query_id", "prefix"]
    assert sorted((r.query_id, r.n) for r in got.collect()) == [(1, 1), (1, 2), (1, 3), (1, 4), (2, 1), (2, 2), (2, 3), (3, 1), (3, 2)]
    plan = got._jdf.queryExecution().optimizedPlan().toString().splitlines()
    listed = next(i for i, line in enumerate(plan) if "Generate explode" in line)
    assert any("Aggregate [repo" in line for line in plan[listed:])


def test_rate_limit_windows_match_brute_force(spark, table):
    import random
    rng = random.Random(3)
    stamps = sorted(rng.sample(range(0, 4000), 150))
    log = [(i, f"2024-01-01 {s // 3600:02d}:{s // 60 % 60:02d}:{s % 60:02d}", "m", s % 97) for i, s in enumerate(stamps)]
    df = table(log, "call_id int, t string, model string, input_tokens long").withColumn("started_at", F.to_timestamp("t"))
    got = {r.call_id: (r.requests_in_window, r.tokens_in_window) for r in calls.rate_limit_audit(df).collect()}
    for i, s in enumerate(stamps):
        inside = [x for x in stamps if s - 60 <= x <= s]
        assert got[i] == (len(inside), sum(x % 97 for x in inside))
