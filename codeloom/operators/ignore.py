"""Ignore files: pattern lists with directory, anchor, glob and negation rules."""

from __future__ import annotations

import re
from functools import lru_cache
from itertools import groupby
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom import constants as C
from codeloom.functions.paths import ancestors
from codeloom.session import stored


class Rule(NamedTuple):
    regex: str
    negated: bool


def _glob_body(glob: str) -> str:
    out, i = [], 0
    while i < len(glob):
        rest = glob[i:]
        if rest.startswith("**/") and (i == 0 or glob[i - 1] == "/"):
            out.append("(?:.*/)?")
            i += 3
        elif rest == "**" and i > 0 and glob[i - 1] == "/":
            out.append(".+")
            i += 2
        elif rest.startswith("*"):
            width = len(rest) - len(rest.lstrip("*"))
            # A star that is a whole segment needs a name; next to other characters it may be empty.
            whole = (i == 0 or glob[i - 1] == "/") and (len(rest) == width or rest[width] == "/")
            out.append("[^/]+" if whole else "[^/]*")
            i += width
        elif rest.startswith("?"):
            out.append("[^/]")
            i += 1
        elif rest.startswith("[") and "]" in rest[2:]:
            close = rest.index("]", 2)
            chars = rest[1:close].replace("\\", "\\\\")
            out.append("[" + ("^" + chars[1:] if chars.startswith("!") else chars) + "]")
            i += close + 1
        elif rest.startswith("\\") and len(rest) > 1:
            out.append(re.escape(rest[1]))
            i += 2
        else:
            out.append(re.escape(rest[0]))
            i += 1
    return "".join(out)


def compile_rule(pattern: str) -> Rule | None:
    """Regex over slash-terminated directory prefixes and file paths; None for blanks and comments."""
    text = re.sub(r"(?<!\\)\s+$", "", pattern)
    if not text or text.startswith("#"):
        return None
    negated = text.startswith("!")
    text = text[1:] if negated else text
    dir_only = text.endswith("/")
    glob = text.rstrip("/") if dir_only else text
    anchored = "/" in glob
    body = _glob_body(glob.lstrip("/"))
    start = "^" if anchored else "^(?:.*/)?"
    return Rule(f"{start}{body}" + ("/" if dir_only else "/?"), negated)


def compile_rules(patterns: list[str], defaults: bool = False) -> list[Rule]:
    listed = C.ALWAYS_IGNORED + (C.DEFAULT_IGNORED if defaults else []) + list(patterns)
    return [rule for rule in map(compile_rule, listed) if rule]


def _either(rules: list[Rule], case: str, end: str) -> str:
    return f"{case}(?:" + "|".join(r.regex for r in rules) + ")" + end


def is_ignored(path: Column, patterns: list[str], defaults: bool = False, ignore_case: bool = True) -> Column:
    """Whether the last matching rule ignores the path or a directory above it."""
    path = F.replace(path, F.lit("\\"), F.lit("/"))
    rules = compile_rules(patterns, defaults)
    case = "(?i)" if ignore_case else ""
    if not any(rule.negated for rule in rules):
        # Without negation one scan decides: a rule that matches any directory prefix is enough.
        alternatives = [
            r.regex if r.regex.endswith("/") else f"{r.regex[:-2]}(?:/|\\z)" for r in rules
        ]
        return path.rlike(case + "(?:" + "|".join(alternatives) + ")")
    runs = [(negated, list(run)) for negated, run in groupby(rules, key=lambda r: r.negated)]

    def verdict(prefix: Column) -> Column:
        out = F.lit(False)
        for negated, run in runs:
            out = F.when(prefix.rlike(_either(run, case, "\\z")), F.lit(not negated)).otherwise(out)
        return out

    return F.exists(F.concat(ancestors(path), F.array(path)), verdict)


def filter_ignored(files: DataFrame, patterns: list[str], defaults: bool = False, ignore_case: bool = True) -> DataFrame:
    return files.filter(~is_ignored(F.col("path"), patterns, defaults, ignore_case))


def ignore_stats(files: DataFrame, patterns: list[str], defaults: bool = False) -> DataFrame:
    """Checked, ignored and passed paths per repository with the rounded percentage."""
    ignored = F.count_if(is_ignored(F.col("path"), patterns, defaults))
    checked = F.count(F.lit(1))
    return (
        files.groupBy("repo")
        .agg(checked.alias("total_checked"), ignored.alias("ignored_count"))
        .withColumns({
            "passed_count": F.col("total_checked") - F.col("ignored_count"),
            "ignored_percent": F.floor(F.col("ignored_count") * 100 / F.col("total_checked") + 0.5).cast("bigint"),
        })
    )


# Rules of one repository, in runs of the same sign; see ``index_rules``.
RUNS = "array<struct<negated: boolean, keys: array<string>, regex: string>>"
_CAPITALS, _SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# Compiled rules up to so many bytes are broadcast, more are joined by repository.
BROADCAST_BYTES = 16 << 20


def _small(text: str) -> str:
    return text.translate(str.maketrans(_CAPITALS, _SMALL))


def rule_key(pattern: str) -> tuple[str, bool] | None:
    """Key under which a rule is looked up, and whether it is negated; None for rules that need a regex.

    ``name`` for an exact name anywhere, ``name/`` for a directory's, ``*.end`` for the
    end of a name from a dot on.
    """
    text = re.sub(r"(?<!\\)\s+$", "", pattern)
    negated = text.startswith("!")
    text = text[1:] if negated else text
    name = text.rstrip("/")
    if not name or "/" in name or re.search(r"[?\[\\]", name):
        return None
    if "*" not in name:
        return _small(name + "/" if text.endswith("/") else name), negated
    if name == text and name.startswith("*.") and "*" not in name[1:]:
        return _small(name), negated
    return None


@lru_cache(maxsize=256)
def index_rules(patterns: tuple[str, ...]) -> tuple[tuple[bool, tuple[str, ...], str | None], ...]:
    """(negated, keys, regex) per run of rules of the same sign, in order.

    Within a run it makes no difference which rule matches, so that keys are a set and
    the rules without one are a single pattern.
    """
    rules = [(p, rule) for p in patterns if (rule := compile_rule(p))]
    runs = []
    for negated, run in groupby(rules, key=lambda r: r[1].negated):
        run = list(run)
        keys = sorted({key[0] for p, _ in run if (key := rule_key(p))})
        rest = list(dict.fromkeys(rule.regex for p, rule in run if not rule_key(p)))
        runs.append((negated, tuple(keys), "|".join(rest) or None))
    return tuple(runs)


def compile_rule_table(patterns: DataFrame) -> DataFrame:
    """(repo, position, pattern) → (repo, runs): the indexed rules of every repository that has any."""
    listed = patterns.groupBy("repo").agg(F.array_sort(F.collect_list(F.struct("position", "pattern"))).alias("listed"))

    def index(batches):
        for batch in batches:
            rows = []
            for repo, some in batch[["repo", "listed"]].itertuples(index=False):
                runs = index_rules(tuple(r["pattern"] for r in some))
                if runs:
                    rows.append((repo, [{"negated": negated, "keys": list(keys), "regex": regex} for negated, keys, regex in runs]))
            yield pd.DataFrame(rows, columns=["repo", "runs"])

    return listed.mapInPandas(index, f"repo string, runs {RUNS}")


def _keys(names: Column, folders: Column) -> Column:
    """Keys the names and folder names (ASCII capitals made small) can be looked up under."""
    def ends(name: Column) -> Column:
        parts = F.split(name, "\\.")
        n = F.size(parts)
        return F.when(n > 1, F.transform(F.sequence(F.lit(2), n), lambda i: F.concat(
            F.lit("*."), F.array_join(F.slice(parts, i, n), ".")))).otherwise(F.array().cast("array<string>"))

    return F.concat(names, F.transform(folders, lambda name: F.concat(name, F.lit("/"))), F.flatten(F.transform(names, ends)))


def _found(text: Column, regex: Column) -> Column:
    """Whether a pattern that matches no empty text is found; the pattern is compiled when it differs from the row's before."""
    return F.call_function("regexp_extract", text, regex, F.lit(0)) != ""


def _ignored_by_runs(path: Column, runs: Column) -> Column:
    """Whether the last matching run ignores the path or a directory above it."""
    small = F.translate(path, _CAPITALS, _SMALL)
    segments = F.split(small, "/")
    folders = F.slice(segments, F.lit(1), F.size(segments) - 1)
    # Without negation one look-up of all keys and one search decide.
    only = runs[0]
    at_once = F.arrays_overlap(_keys(segments, folders), only["keys"]) | F.coalesce(
        _found(path, F.concat(F.lit("(?i)(?:"), only["regex"], F.lit(")(?:(?<=/)|/|\\z)"))), F.lit(False))

    def verdict(prefix: Column) -> Column:
        name = F.element_at(F.split(F.translate(F.rtrim(prefix, F.lit("/")), _CAPITALS, _SMALL), "/"), -1)
        nothing = F.array().cast("array<string>")
        keys = _keys(F.array(name), F.when(F.endswith(prefix, F.lit("/")), F.array(name)).otherwise(nothing))
        return F.aggregate(
            runs, F.lit(False),
            lambda seen, run: F.when(
                F.arrays_overlap(keys, run["keys"])
                | F.coalesce(_found(prefix, F.concat(F.lit("(?i)(?:"), run["regex"], F.lit(")\\z"))), F.lit(False)),
                ~run["negated"]).otherwise(seen))

    one_by_one = F.exists(F.concat(ancestors(path), F.array(path)), verdict)
    return F.when((F.size(runs) == 1) & ~only["negated"], at_once).otherwise(one_by_one)


def filter_ignored_by_repo(files: DataFrame, patterns: DataFrame) -> DataFrame:
    """``filter_ignored`` with each repository's own ignore file (repo, position, pattern).

    Rules that are a name, a directory's name or the end of a name are looked up in a
    set; only the others are searched for, in one pattern per repository.
    """
    rules = stored(compile_rule_table(patterns), "rules")
    path = F.replace(F.col("path"), F.lit("\\"), F.lit("/"))
    size = rules.agg(F.sum(F.length(F.to_json("runs")))).first()[0] or 0
    known = files.filter(~is_ignored(F.col("path"), [])).join(F.broadcast(rules) if size <= BROADCAST_BYTES else rules, "repo", "left")
    return known.filter(F.col("runs").isNull() | ~_ignored_by_runs(path, F.col("runs"))).drop("runs")
