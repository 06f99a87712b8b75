from __future__ import annotations

import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from codeloom import constants as C
from codeloom.operators import ignore

CASES = [
    (["package-lock.json"], {"package-lock.json": True, "package.json": False}),
    (["*.log", "*.tmp"], {"debug.log": True, "deep/app.tmp": True, "app.js": False}),
    (["node_modules/", "dist/"], {"node_modules/": True, "node_modules/p/index.js": True, "a/dist/b.js": True, "dist": False}),
    (["**/test/**", "**/__tests__/**"], {"src/test/helper.js": True, "lib/__tests__/u.spec.ts": True, "src/testing/a.ts": False}),
    (["*.log", "!important.log"], {"debug.log": True, "important.log": False}),
    (["# note", "", "*.log"], {"debug.log": True, "# note": False}),
    (["dist/"], {"dist\\bundle.js": True}),
    (["/build"], {"build/x.js": True, "src/build/x.js": False}),
    (["docs/*.md"], {"docs/a.md": True, "docs/x/a.md": False, "x/docs/a.md": False}),
    (["logs/", "!logs/keep.txt"], {"logs/keep.txt": True, "logs/a": True}),
    (["logs/*", "!logs/keep.txt"], {"logs/keep.txt": False, "logs/a": True}),
    (["file?.ts"], {"file1.ts": True, "file12.ts": False}),
    (["[ab].ts"], {"a.ts": True, "c.ts": False}),
    (["a/**/z.ts"], {"a/z.ts": True, "a/b/c/z.ts": True}),
    (["*.TXT"], {"a.txt": True}),
    (["\\!odd"], {"!odd": True}),
]


@pytest.mark.parametrize("patterns, expected", CASES)
def test_patterns(table, patterns, expected):
    df = table([(p,) for p in expected], "path string")
    got = {r.path: r.hit for r in df.withColumn("hit", ignore.is_ignored(F.col("path"), patterns)).collect()}
    assert got == expected


@pytest.mark.parametrize("patterns, expected", CASES)
def test_patterns_by_repo(table, patterns, expected):
    files = table([("r", p) for p in expected], "repo string, path string")
    rules = table([("r", i, p) for i, p in enumerate(patterns)], "repo string, position long, pattern string")
    kept = {r.path for r in ignore.filter_ignored_by_repo(files, rules).collect()}
    assert kept == {p for p, hit in expected.items() if not hit}


def test_defaults(table):
    hidden = ["dist/a.js", "x/node_modules/y.js", "a.min.js", "yarn.lock", "x/.DS_Store", ".git/config", "target/a"]
    df = table([(p,) for p in hidden + ["src/index.ts"]], "path string")
    assert [r.path for r in ignore.filter_ignored(df, [], defaults=True).collect()] == ["src/index.ts"]
    always = df.filter(ignore.is_ignored(F.col("path"), []))
    assert [r.path for r in always.collect()] == [".git/config"]
    assert C.ALWAYS_IGNORED == [".git/", ".repo_map/"]


def test_stats(table):
    names = ["src/index.ts", "src/utils.ts", "debug.log", "error.log", "dist/bundle.js"]
    row = ignore.ignore_stats(table([("r", p) for p in names], "repo string, path string"), ["*.log", "dist/"]).first()
    assert (row.total_checked, row.passed_count, row.ignored_count, row.ignored_percent) == (5, 2, 3, 60)


def ignored_by_hand(path: str, patterns: list[str]) -> bool:
    """Every rule as a regex of its own, over every directory above the path and the path; the last match decides."""
    path = path.replace("\\", "/")
    parts = path.split("/")
    prefixes = ["/".join(parts[:i]) + "/" for i in range(1, len(parts))] + [path]
    rules = [r for r in map(ignore.compile_rule, patterns) if r]

    def verdict(prefix):
        out = False
        for rule in rules:
            if re.fullmatch(rule.regex, prefix, re.I | re.A | re.S):
                out = not rule.negated
        return out

    always = [r for r in map(ignore.compile_rule, C.ALWAYS_IGNORED)]
    return any(map(verdict, prefixes)) or any(re.fullmatch(r.regex, p, re.I) for r in always for p in prefixes)


def test_index_agrees_with_rule_by_rule(table):
    rng = random.Random(7)
    names = ["a", "B", "a.b", "x.min.js", "Y.MIN.js", ".env", "lib", "é.md", "É.md", "a b", "..x", "t.", "-", "[q]", "log.txt"]
    pieces = names + ["*", "**", "*.js", "*.min.js", "a*", "?", "[ab]", "*.", "*.*", "\\*", "x.*.js", "*lib"]
    pattern = lambda: rng.choice(["", "", "", "!", "/"]) + "/".join(rng.choices(pieces, k=rng.choice([1, 1, 1, 2, 3]))) + rng.choice(["", "", "/", " "])
    sets = [[pattern() for _ in range(rng.randint(0, 6))] for _ in range(120)] + [["*.md", "!é.md"], ["!a"], ["#", ""], ["a/", "a"], ["lib/", "!lib/a"]]
    paths = ["/".join(rng.choices(names, k=rng.randint(1, 4))) for _ in range(60)]
    files = table([(f"r{i}", p) for i in range(len(sets) + 1) for p in paths], "repo string, path string")
    rules = table([(f"r{i}", j, p) for i, some in enumerate(sets) for j, p in enumerate(some)], "repo string, position long, pattern string")
    kept = Counter((r.repo, r.path) for r in ignore.filter_ignored_by_repo(files, rules).collect())
    want = Counter((f"r{i}", p) for i, some in enumerate([*sets, []]) for p in paths if not ignored_by_hand(p, some))
    assert kept == want


def test_rules_that_are_looked_up():
    assert ignore.index_rules(tuple(C.DEFAULT_IGNORED))[0][2] == "^(?:.*/)?[^/]*\\.log\\.[^/]*/?"
    assert [ignore.rule_key(p) for p in ("Dist/", "*.LOG", "!yarn.lock", "a/b", "*.log.*", "*x", "a?", "/", "!")] == [
        ("dist/", False), ("*.log", False), ("yarn.lock", True), None, None, None, None, None, None]


def test_rules_too_large_to_broadcast(table, monkeypatch):
    monkeypatch.setattr(ignore, "BROADCAST_BYTES", 0)
    files = table([("r", "a.log"), ("q", "a.log"), ("r", "b")], "repo string, path string")
    found = ignore.filter_ignored_by_repo(files, table([("r", 0, "*.log")], "repo string, position long, pattern string"))
    assert sorted(map(tuple, found.collect())) == [("q", "a.log"), ("r", "b")]
