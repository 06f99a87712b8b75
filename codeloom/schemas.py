"""Row layouts of the tables and the container for a dependency graph."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import types as T

ANNOTATION = T.StructType([
    T.StructField("repo", T.StringType()),
    T.StructField("path", T.StringType()),
    T.StructField("language", T.StringType()),
    T.StructField("size_bytes", T.LongType()),
    T.StructField("line_count", T.LongType()),
    T.StructField("purpose", T.StringType()),
    T.StructField("exports", T.ArrayType(T.StringType())),
    T.StructField("imports", T.ArrayType(T.StringType())),
])

MODULE = T.StructType([T.StructField("path", T.StringType()), T.StructField("description", T.StringType())])

META = T.StructType([
    T.StructField("repo", T.StringType()),
    T.StructField("schema_version", T.StringType()),
    T.StructField("map_version", T.LongType()),
    T.StructField("git_commit", T.StringType()),
    T.StructField("created_at", T.StringType()),
    T.StructField("last_updated", T.StringType()),
    T.StructField("parent_version", T.LongType()),
    T.StructField("update_type", T.StringType()),
    T.StructField("files_changed", T.LongType()),
    T.StructField("repo_name", T.StringType()),
    T.StructField("purpose", T.StringType()),
    T.StructField("stack", T.StringType()),
    T.StructField("languages", T.ArrayType(T.StringType())),
    T.StructField("entrypoints", T.ArrayType(T.StringType())),
    T.StructField("modules", T.ArrayType(MODULE)),
    T.StructField("config_files", T.ArrayType(T.StringType())),
    T.StructField("conventions", T.ArrayType(T.StringType())),
])

CALL_LOG = T.StructType([
    T.StructField("timestamp", T.TimestampType()),
    T.StructField("level", T.StringType()),
    T.StructField("purpose", T.StringType()),
    T.StructField("model", T.StringType()),
    T.StructField("prompt", T.StringType()),
    T.StructField("response", T.StringType()),
    T.StructField("inputTokens", T.LongType()),
    T.StructField("outputTokens", T.LongType()),
])

ISSUE_COLUMNS = ["repo", "severity", "type", "file", "message"]


class Graph(NamedTuple):
    """A dependency graph as three flat tables.

    nodes      (repo, path)
    imports    (repo, path, target)    one row per import entry, duplicates kept
    importers  (repo, path, importer)  the reverse lists, one row per entry

    Flat rows keep a hub that half the corpus imports from becoming one huge
    array; ``operators.graph.listed`` is the form to store, ``adjacency`` the nested one.
    """

    nodes: DataFrame
    imports: DataFrame
    importers: DataFrame
