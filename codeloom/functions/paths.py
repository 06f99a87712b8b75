"""Column functions on paths, sizes and languages."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom import constants as C


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def extension(path: Column) -> Column:
    """Last dot and what follows; a name that only starts with a dot has none."""
    return F.regexp_extract(base_name(path), r"(?s)^.+(\.[^.]*)$", 1)


def directory(path: Column) -> Column:
    """Everything before the last slash, ``.`` for files at the root."""
    return F.when(F.contains(path, F.lit("/")), F.regexp_extract(path, r"(?s)^(.*)/[^/]*$", 1)).otherwise(".")


def top_directory(path: Column) -> Column:
    return F.when(F.contains(path, F.lit("/")), F.substring_index(path, "/", 1)).otherwise(".")


def ancestors(path: Column) -> Column:
    """Every prefix of the path that ends with a slash, outermost first."""
    parts = F.split(path, "/")
    depth = F.size(parts) - 1
    return F.when(
        depth > 0,
        F.transform(F.sequence(F.lit(1), depth), lambda i: F.concat(F.array_join(F.slice(parts, F.lit(1), i), "/"), F.lit("/"))),
    ).otherwise(F.array().cast("array<string>"))


def language_of(path: Column) -> Column:
    pairs = [F.lit(x) for pair in C.LANGUAGE_BY_EXTENSION.items() for x in pair]
    return F.try_element_at(F.create_map(*pairs), F.lower(extension(path)))


def contains_any(text: Column, marks: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(text, F.lit(m)) for m in marks])


def with_path_parts(df: DataFrame) -> DataFrame:
    path = F.col("path")
    return df.withColumns({
        "name": base_name(path),
        "extension": extension(path),
        "dir": directory(path),
        "top_dir": top_directory(path),
    })


def with_language(df: DataFrame) -> DataFrame:
    return df.withColumn("language", language_of(F.col("path")))


def line_count(text: Column) -> Column:
    """Newlines + 1, so that an empty text has one line."""
    return (F.length(text) - F.length(F.replace(text, F.lit("\n"))) + 1).cast("bigint")


def with_size(df: DataFrame, text: str = "content") -> DataFrame:
    lines = line_count(F.col(text))
    return df.withColumns({
        "line_count": lines,
        "size_bytes": F.octet_length(text).cast("bigint"),
        "is_oversized": lines > C.MAX_PROMPT_LINES,
    })


def token_estimate(text: Column) -> Column:
    return F.ceil(F.length(text) / F.lit(4)).cast("bigint")


def with_token_estimate(df: DataFrame, text: str, name: str = "tokens") -> DataFrame:
    return df.withColumn(name, token_estimate(F.col(text)))


def with_effective_loc(df: DataFrame, cap: int = C.LOC_CAP) -> DataFrame:
    effective = F.least(F.col("line_count"), F.lit(cap)).cast("bigint")
    return df.withColumns({"effective_loc": effective, "trimmed": effective < F.col("line_count")})


def is_test_path(path: Column) -> Column:
    return contains_any(path, C.TEST_MARKS)


def is_complex_file(path: Column, loc: Column) -> Column:
    return F.lower(F.substring_index(path, ".", -1)).isin(C.COMPLEX_EXTENSIONS) & (loc > C.COMPLEX_LOC)


def classify_files(df: DataFrame) -> DataFrame:
    path, loc = F.col("path"), F.col("line_count")
    return df.withColumns({
        "is_test": is_test_path(path),
        "is_config_or_test": contains_any(F.lower(path), C.CONFIG_OR_TEST_MARKS),
        "is_complex": is_complex_file(path, loc),
        "is_large": loc > C.LARGE_LOC,
    })


def computed_once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is worked out once, however often ``use`` names it.

    Inside a lambda Spark evaluates an expression anew wherever it stands; the variable of
    a transform is a value.
    """
    return F.get(F.transform(F.array(value), use), F.lit(0))


def collapse_path(path: Column) -> Column:
    """Resolve ``.`` and ``..`` segments; steps above the root stay as ``..``."""
    none = F.array().cast("array<string>")
    stack = F.aggregate(
        F.split(path, "/"),
        none,
        lambda acc, part: F.when(part.isin("", "."), acc)
        .when(
            (part == "..") & (F.size(acc) > 0) & (F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit("..")) != ".."),
            F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0))),
        )
        .otherwise(F.concat(acc, F.array(part))),
    )
    trailing = F.endswith(path, F.lit("/"))
    return computed_once(F.array_join(stack, "/"), lambda joined: (
        F.when((joined == "") & trailing, F.lit(""))
        .when(joined == "", F.lit("."))
        .when(trailing, F.concat(joined, F.lit("/")))
        .otherwise(joined)
    ))


def sort_key(column: Column, order: str = "binary") -> Column:
    """Binary order by default; ``unicode`` orders as a locale-aware comparison would."""
    if order == "unicode":
        return F.collate(column, "UNICODE")
    if order != "binary":
        raise ValueError(f"unknown order: {order}")
    return column
