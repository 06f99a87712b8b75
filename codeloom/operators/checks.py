"""Consistency and structure checks. Each returns rows (repo, severity, type, file, message)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.functions.paths import is_test_path
from codeloom.operators.cycles import circular_dependencies
from codeloom.operators.graph import import_entries
from codeloom.schemas import ISSUE_COLUMNS, Graph
from codeloom.session import discard, stored


def issue(severity: str, kind: str, file: str | Column, message: str | Column) -> list[Column]:
    return [
        F.col("repo"),
        F.lit(severity).alias("severity"),
        F.lit(kind).alias("type"),
        (F.col(file) if isinstance(file, str) else file).alias("file"),
        (F.lit(message) if isinstance(message, str) else message).alias("message"),
    ]


def quoted(*parts: str | Column) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def meta_paths(meta: DataFrame, column: str) -> DataFrame:
    """(repo, path) rows of a path array of the metadata."""
    return meta.select("repo", F.explode(column).alias("path"))


def missing_entries(annotations: DataFrame) -> DataFrame:
    """(repo, path, target) import entries whose target is not annotated."""
    known = annotations.select("repo", F.col("path").alias("target"))
    return import_entries(annotations).join(known, ["repo", "target"], "left_anti").select("repo", "path", "target")


def missing_imports(annotations: DataFrame) -> DataFrame:
    return missing_entries(annotations).select(
        *issue("error", "missing_import", "path", quoted('Imports "', F.col("target"), '" which is not in the map'))
    )


def asymmetric_edges(graph: Graph) -> DataFrame:
    """Entries of either list without their mirror entry.

    Both lists are counted per (importer, imported) pair in one aggregate. A
    pair in both lists has both ends by construction, so only one-sided pairs
    look up whether their other end exists.
    """
    forward = graph.imports.select("repo", F.col("path").alias("src"), F.col("target").alias("dst"), F.lit(1).alias("_f"), F.lit(0).alias("_r"))
    reverse = graph.importers.select("repo", F.col("importer").alias("src"), F.col("path").alias("dst"), F.lit(0).alias("_f"), F.lit(1).alias("_r"))
    pairs = forward.unionByName(reverse).groupBy("repo", "src", "dst").agg(F.sum("_f").alias("_f"), F.sum("_r").alias("_r"))
    is_forward = F.col("_r") == 0
    one_sided = pairs.filter((F.col("_f") == 0) | is_forward).select(
        "repo",
        F.when(is_forward, F.col("src")).otherwise(F.col("dst")).alias("file"),
        F.when(is_forward, F.col("dst")).otherwise(F.col("src")).alias("other"),
        is_forward.alias("forward"),
        F.explode(F.sequence(F.lit(1), (F.col("_f") + F.col("_r")).cast("int"))).alias("_copy"),
    )
    known = graph.nodes.select("repo", F.col("path").alias("other"), F.lit(True).alias("_known")).distinct()
    looked_up = one_sided.join(known, ["repo", "other"], "left")
    exists, other, ahead = F.col("_known").isNotNull(), F.col("other"), F.col("forward")
    message = (
        F.when(ahead & ~exists, quoted('Graph references "', other, '" which doesn\'t exist in graph'))
        .when(ahead, quoted('Imports "', other, '" but "', other, '" doesn\'t list it in imported_by'))
        .when(~exists, quoted('Graph lists "', other, '" in imported_by but it doesn\'t exist in graph'))
        .otherwise(quoted('Listed in "', other, '" imported_by but "', other, '" doesn\'t import it'))
    )
    kind = F.when(exists, F.lit("asymmetric_graph")).otherwise(F.lit("broken_graph_reference"))
    return looked_up.select("repo", F.lit("error").alias("severity"), kind.alias("type"), "file", message.alias("message"))


def graph_consistency(graph: Graph) -> DataFrame:
    """(repo, consistent) for every repository of the graph; the offending rows are ``asymmetric_edges``."""
    broken = asymmetric_edges(graph).select("repo").distinct().withColumn("_broken", F.lit(True))
    return graph.nodes.select("repo").distinct().join(broken, "repo", "left").select(
        "repo", F.col("_broken").isNull().alias("consistent")
    )


def deleted_files(annotations: DataFrame, listing: DataFrame) -> DataFrame:
    return annotations.join(listing.select("repo", "path"), ["repo", "path"], "left_anti").select(
        *issue("error", "deleted_file", "path", "File in map but doesn't exist on disk")
    )


def graph_annotation_mismatch(graph: Graph, annotations: DataFrame) -> DataFrame:
    files = annotations.select("repo", "path").distinct()
    kind = "graph_annotation_mismatch"
    only_node = graph.nodes.join(files, ["repo", "path"], "left_anti").select(
        *issue("error", kind, "path", "File exists in graph but not in annotations")
    )
    only_file = annotations.join(graph.nodes, ["repo", "path"], "left_anti").select(
        *issue("error", kind, "path", "File exists in annotations but not in graph")
    )
    sides = graph.imports.select("repo", "path", "target", F.lit(True).alias("_graph")).unionByName(
        import_entries(annotations).withColumn("_graph", F.lit(False))
    )
    one_sided = (
        sides.groupBy("repo", "path", "target")
        .agg(F.bool_or("_graph").alias("_in_graph"), F.bool_and("_graph").alias("_graph_only"))
        .filter(~F.col("_in_graph") | F.col("_graph_only"))
    )
    both = graph.nodes.join(files, ["repo", "path"], "left_semi")
    message = F.when(
        F.col("_graph_only"), quoted('Graph lists import "', F.col("target"), '" but annotation doesn\'t')
    ).otherwise(quoted('Annotation lists import "', F.col("target"), '" but graph doesn\'t'))
    differing = one_sided.join(both, ["repo", "path"], "left_semi").select(*issue("warning", kind, "path", message))
    return union_all([only_node, differing, only_file])


def _row_issues(annotations: DataFrame, graph: Graph, listing: DataFrame) -> DataFrame:
    """Files of which annotations, nodes and listing do not tell the same, from one count per path.

    A missing repository or path matches nothing.
    """
    side = lambda df, name: df.select("repo", "path", F.lit(name).alias("_side"))
    sides = union_all([side(annotations, "a"), side(graph.nodes, "n"), side(listing, "l")])
    n = lambda name: F.count_if(F.col("_side") == name).alias(f"_{name}")
    counts = sides.groupBy("repo", "path").agg(n("a"), n("n"), n("l"))
    unknown = F.col("repo").isNull() | F.col("path").isNull()
    kind = "graph_annotation_mismatch"
    found = lambda lacking, copies, name, message: F.when(
        (F.col(lacking) == 0) | unknown, F.struct(F.col(copies).alias("n"), F.lit(name).alias("type"), F.lit(message).alias("message")))
    cases = F.filter(F.array(
        found("_l", "_a", "deleted_file", "File in map but doesn't exist on disk"),
        found("_a", "_n", kind, "File exists in graph but not in annotations"),
        found("_n", "_a", kind, "File exists in annotations but not in graph"),
    ), lambda c: c["n"] > 0)
    rows = counts.select("repo", "path", F.explode(cases).alias("c"))
    return rows.select(
        "repo", F.lit("error").alias("severity"), F.col("c.type").alias("type"), F.col("path").alias("file"), F.col("c.message").alias("message"),
        F.explode(F.sequence(F.lit(1), F.col("c.n").cast("int"))).alias("_copy")).drop("_copy")


def _entry_issues(annotations: DataFrame, graph: Graph, write: bool) -> DataFrame:
    """Missing imports, one-sided entries, and entries of which graph and annotations do not tell the same.

    The three lists are counted per pair in one aggregate; what a pair may break is
    then looked up among the files and nodes at once. With ``write`` both are tables, so
    that what the pairs were shuffled for is gone before they are looked up.
    """
    def side(df: DataFrame, src: str, dst: str, at: int) -> DataFrame:
        return df.select("repo", F.col(src).alias("src"), F.col(dst).alias("dst"), *[F.lit(int(i == at)).alias(n) for i, n in enumerate(("_a", "_f", "_r"))])

    sides = union_all([side(import_entries(annotations), "path", "target", 0), side(graph.imports, "path", "target", 1), side(graph.importers, "importer", "path", 2)])
    pairs = sides.groupBy("repo", "src", "dst").agg(*[F.sum(n).alias(n) for n in ("_a", "_f", "_r")])
    noted, ahead, back = F.col("_a"), F.col("_f"), F.col("_r")
    case = lambda holds, name, file, look, n, named=F.lit(None).cast("string"): F.when(holds, F.struct(
        F.lit(name).alias("case"), F.col(file).alias("file"), F.col(look).alias("look"), named.alias("dst"), n.cast("int").alias("n")))
    cases = F.array_compact(F.array(
        case(noted > 0, "missing", "src", "dst", noted),
        case((ahead > 0) & (back == 0), "ahead", "src", "dst", ahead),
        case((back > 0) & (ahead == 0), "back", "dst", "src", back),
        case((ahead > 0) & (noted == 0), "graph only", "src", "src", F.lit(1), F.col("dst")),
        case((noted > 0) & (ahead == 0), "noted only", "src", "src", F.lit(1), F.col("dst")),
    ))
    flag = lambda df, file, node: df.select("repo", F.col("path").alias("look"), F.lit(file).alias("_file"), F.lit(node).alias("_node"))
    places = flag(annotations, True, False).unionByName(flag(graph.nodes, False, True)).groupBy("repo", "look").agg(
        F.bool_or("_file").alias("_file"), F.bool_or("_node").alias("_node"))
    asked = pairs.select("repo", F.inline(cases))
    asked = stored(asked, "cases") if write else asked
    looked_up = asked.join(places, ["repo", "look"], "left")
    kept, file, node = F.col("case"), F.coalesce("_file", F.lit(False)), F.coalesce("_node", F.lit(False))
    broken = looked_up.filter(
        F.when(kept == "missing", ~file).when(kept.isin("graph only", "noted only"), file & node).otherwise(F.lit(True)))
    other = F.col("look")
    message = (
        F.when(kept == "missing", quoted('Imports "', other, '" which is not in the map'))
        .when(kept == "graph only", quoted('Graph lists import "', F.col("dst"), '" but annotation doesn\'t'))
        .when(kept == "noted only", quoted('Annotation lists import "', F.col("dst"), '" but graph doesn\'t'))
        .when((kept == "ahead") & ~node, quoted('Graph references "', other, '" which doesn\'t exist in graph'))
        .when(kept == "ahead", quoted('Imports "', other, '" but "', other, '" doesn\'t list it in imported_by'))
        .when(~node, quoted('Graph lists "', other, '" in imported_by but it doesn\'t exist in graph'))
        .otherwise(quoted('Listed in "', other, '" imported_by but "', other, '" doesn\'t import it'))
    )
    differing = kept.isin("graph only", "noted only")
    kind = (
        F.when(kept == "missing", "missing_import").when(differing, "graph_annotation_mismatch")
        .when(node, "asymmetric_graph").otherwise("broken_graph_reference"))
    found = broken.select(
        "repo", F.when(differing, "warning").otherwise("error").alias("severity"), kind.alias("type"), "file", message.alias("message"),
        F.explode(F.sequence(F.lit(1), F.col("n"))).alias("_copy")).drop("_copy")
    if not write:
        return found
    written = stored(found, "issues")
    discard(asked)
    return written


def consistency_issues(annotations: DataFrame, graph: Graph, listing: DataFrame, write: bool = False) -> DataFrame:
    """The rows of ``missing_imports``, ``asymmetric_edges``, ``deleted_files`` and ``graph_annotation_mismatch`` together.

    Every table is dealt out once for all of them. With ``write`` issues of entries are worked out
    at once, in two steps, which takes less disk.
    """
    return _entry_issues(annotations, graph, write).unionByName(_row_issues(annotations, graph, listing))


def orphan_files(annotations: DataFrame, graph: Graph, entrypoints: DataFrame, config_files: DataFrame) -> DataFrame:
    """Files of the graph nobody imports that are neither entry point nor configuration."""
    keys = ["repo", "path"]
    excused = union_all([
        graph.importers.select(keys).distinct(), entrypoints.select(keys), config_files.select(keys),
    ])
    return annotations.select(keys).join(graph.nodes, keys, "left_semi").join(excused, keys, "left_anti").select(
        *issue("warning", "orphan_file", "path",
               "File is not imported by anything and is not an entry point (possible dead code)")
    )


def no_exports(annotations: DataFrame, entrypoints: DataFrame) -> DataFrame:
    silent = annotations.filter((F.size("imports") > 0) & (F.size("exports") == 0) & ~is_test_path(F.col("path")))
    return silent.join(entrypoints.select("repo", "path"), ["repo", "path"], "left_anti").select(
        *issue("info", "no_exports", "path",
               "File imports but exports nothing (may be side-effect only or incorrectly annotated)")
    )


def structural_issues(
    annotations: DataFrame, graph: Graph, entrypoints: DataFrame, config_files: DataFrame, include_info: bool = True
) -> DataFrame:
    """Orphans, import cycles and files without exports; the last two are informational."""
    found = [orphan_files(annotations, graph, entrypoints, config_files)]
    if include_info:
        found += [circular_dependencies(graph), no_exports(annotations, entrypoints)]
    return union_all(found)


def _links(annotations: DataFrame, graph: Graph) -> list[DataFrame]:
    """(repo, path, other): what the files of a map name in annotations and in either list, a table each."""
    return [df.select("repo", "path", F.col(other).alias("other")) for df, other in (
        (graph.imports, "target"), (graph.importers, "importer"), (import_entries(annotations), "target"))]


def recheck(
    issues: DataFrame, changed: DataFrame, before: tuple[DataFrame, Graph], after: tuple[DataFrame, Graph],
    listing: DataFrame, entrypoints: DataFrame, config_files: DataFrame,
) -> DataFrame:
    """The issues after a change, from those before it: only changed files and their neighbours are checked again.

    ``issues`` are what consistency, orphan and export checks found on the map ``before``
    (annotations and graph). ``changed`` (repo, path) names every file whose annotation,
    node, listing or role as entry point or configuration differs ``after``. An
    issue depends on its file, its entries and whether the files they name exist, so
    those of all other files stand. Import cycles may run through the whole map: issues
    of that type are handed on as they are. Types that ``issues`` should not have, such as
    ``no_exports`` for a report without them, are dropped from the result by the caller.
    """
    keys = ["repo", "path"]
    seeds = stored(changed.select(*keys).distinct(), "seeds")
    as_other = lambda df: df.select("repo", F.col("path").alias("other"))
    # One list at a time, here and below: what was shuffled for one goes before the next is read.
    around = [seeds]
    for pairs in [*_links(*before), *_links(*after)]:
        around.append(stored(pairs.join(seeds, keys, "left_semi").select("repo", F.col("other").alias("path")).distinct(), "around"))
        around.append(stored(pairs.join(as_other(seeds), ["repo", "other"], "left_semi").select(*keys).distinct(), "around"))
    near = stored(union_all(around).distinct(), "near")
    for df in around[1:]:
        discard(df)

    annotations, graph = after
    by = lambda df, column: df.join(near.withColumnRenamed("path", column), ["repo", column], "left_semi")
    # Entries with an end among them, each once, and the files these name.
    ends = lambda df, other: union_all([by(df, "path"), by(df, other).join(near, keys, "left_anti")]).select(*keys, other)
    imports, importers = stored(ends(graph.imports, "target"), "imports"), stored(ends(graph.importers, "importer"), "importers")
    noted = import_entries(by(annotations, "path"))
    ways = ((noted, "target"), (imports, "target"), (imports, "path"), (importers, "importer"), (importers, "path"))
    named = [stored(df.select("repo", F.col(c).alias("path")).distinct(), "named") for df, c in ways]
    wanted = stored(union_all([near, *named]).distinct(), "wanted")
    for df in named:
        discard(df)
    files = stored(annotations.join(wanted, keys, "left_semi"), "files")
    part = Graph(graph.nodes.join(wanted, keys, "left_semi"), imports, importers)
    checked = (consistency_issues(files, part, listing, True), orphan_files(files, part, entrypoints, config_files), no_exports(files, entrypoints))
    found = [stored(by(df, "file").select(ISSUE_COLUMNS), "found") for df in checked]
    cyclic = F.col("type") == "circular_dependency"
    local = issues.filter(~cyclic).join(near.withColumnRenamed("path", "file"), ["repo", "file"], "left_anti")
    return union_all([*found, local.select(ISSUE_COLUMNS), issues.filter(cyclic).select(ISSUE_COLUMNS)])


def issue_summary(issues: DataFrame, fixes: DataFrame | None = None) -> DataFrame:
    """Counts per repository; ``fixes`` are the rows of the repair log among the issues."""
    severity = lambda s: F.count_if(F.col("severity") == s)
    summary = issues.groupBy("repo").agg(
        severity("error").alias("errors"),
        severity("warning").alias("warnings"),
        severity("info").alias("info"),
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("severity").isin("error", "warning")).alias("requires_attention"),
    )
    if fixes is None:
        return summary.withColumn("auto_fixed", F.lit(0).cast("bigint"))
    fixed = fixes.groupBy("repo").agg(F.count(F.lit(1)).alias("_fixed"))
    return summary.join(fixed, "repo", "left").withColumn("auto_fixed", F.coalesce("_fixed", F.lit(0)).cast("bigint")).drop("_fixed")


def issues_by(issues: DataFrame, key: str) -> DataFrame:
    """Number of issues per severity for each ``type`` or ``file`` of a repository.

    The members of a group are the issue rows themselves, sorted with ``orderBy(key)``.
    """
    severity = lambda s: F.count_if(F.col("severity") == s)
    return issues.groupBy("repo", key).agg(
        F.count(F.lit(1)).alias("issues"),
        severity("error").alias("errors"),
        severity("warning").alias("warnings"),
        severity("info").alias("info"),
    )


def issues_by_type(issues: DataFrame) -> DataFrame:
    return issues_by(issues, "type")


def issues_by_file(issues: DataFrame) -> DataFrame:
    return issues_by(issues, "file")
