"""Dependency graphs: building, updating, comparing and looking up neighbours."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.functions.paths import sort_key
from codeloom.operators.filters import dir_prefix, match_prefixes
from codeloom.operators.running import running_sums
from codeloom.schemas import Graph
from codeloom.session import stored

# Entries of a node's list in one piece.
SEGMENT = 1000
# Entries up to which a list is put together in one row.
TOGETHER = 100_000


def import_entries(annotations: DataFrame) -> DataFrame:
    """(repo, path, target): one row per import entry."""
    return annotations.select("repo", "path", F.explode("imports").alias("target"))


def _as_target(nodes: DataFrame) -> DataFrame:
    return nodes.select("repo", F.col("path").alias("target"))


def edges(annotations: DataFrame) -> DataFrame:
    """(repo, src, dst, resolved): ``resolved`` tells whether the target is an annotated file."""
    known = _as_target(annotations.select("repo", "path")).distinct().withColumn("_known", F.lit(True))
    return (
        import_entries(annotations)
        .join(known, ["repo", "target"], "left")
        .select("repo", F.col("path").alias("src"), F.col("target").alias("dst"), F.coalesce("_known", F.lit(False)).alias("resolved"))
    )


def _reverse(imports: DataFrame, nodes: DataFrame) -> DataFrame:
    distinct = imports.select("repo", "path", "target").distinct()
    return distinct.join(_as_target(nodes), ["repo", "target"], "left_semi").select(
        "repo", F.col("target").alias("path"), F.col("path").alias("importer")
    )


def build_graph(annotations: DataFrame) -> Graph:
    """A node per annotation, its import entries, and the reverse lists of the targets that exist."""
    nodes = annotations.select("repo", "path").distinct()
    imports = import_entries(annotations)
    return Graph(nodes, imports, _reverse(imports, nodes))


def degrees(graph: Graph, paths: DataFrame | None = None) -> DataFrame:
    """(repo, path, import_count, imported_by_count) for every node, or those among ``paths`` (repo, path).

    Entries are counted before they are looked up among the paths, as counts are far fewer.
    """
    only = lambda df: df if paths is None else df.join(paths, ["repo", "path"], "left_semi")
    out_degree = only(graph.imports.groupBy("repo", "path").agg(F.count(F.lit(1)).alias("_out")))
    in_degree = only(graph.importers.groupBy("repo", "path").agg(F.count(F.lit(1)).alias("_in")))
    return (
        only(graph.nodes).join(out_degree, ["repo", "path"], "left")
        .join(in_degree, ["repo", "path"], "left")
        .select(
            "repo", "path",
            F.coalesce("_out", F.lit(0)).cast("bigint").alias("import_count"),
            F.coalesce("_in", F.lit(0)).cast("bigint").alias("imported_by_count"),
        )
    )


def entries(graph: Graph) -> DataFrame:
    """Both directions as (repo, path, direction, other)."""
    return graph.imports.select("repo", "path", F.lit("imports").alias("direction"), F.col("target").alias("other")).unionByName(
        graph.importers.select("repo", "path", F.lit("imported_by").alias("direction"), F.col("importer").alias("other"))
    )


def listed(graph: Graph) -> DataFrame:
    """The graph as rows (repo, path, direction, other) in order: ``node`` rows without an ``other``, then the entries.

    The form to store: range-partitioned, so the list of a hub is spread over as
    many files as it needs.
    """
    nodes = graph.nodes.select("repo", "path", F.lit("node").alias("direction"), F.lit(None).cast("string").alias("other"))
    keys = ["repo", "path", "direction", "other"]
    return nodes.unionByName(entries(graph)).repartitionByRange(*keys).sortWithinPartitions(*keys)


def from_listed(rows: DataFrame) -> Graph:
    """The graph ``listed`` gave."""
    of = lambda direction: rows.filter(F.col("direction") == direction)
    return Graph(
        of("node").select("repo", "path"), of("imports").select("repo", "path", F.col("other").alias("target")),
        of("imported_by").select("repo", "path", F.col("other").alias("importer")),
    )


def hubs(graph: Graph) -> DataFrame | None:
    """(repo, path, direction) of the lists of more than ``TOGETHER`` entries, if there are any: a small table."""
    keys = ["repo", "path", "direction"]
    counts = entries(graph).groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    found = stored(counts.filter(F.col("_n") > TOGETHER).select(*keys), "hubs")
    return None if found.isEmpty() else found


def among(rows: DataFrame, few: DataFrame, keys: list[str], how: str = "left_semi") -> DataFrame:
    """``rows`` that are, or with ``left_anti`` are not, among a small table's; missing keys are equal."""
    other = few.select(*[F.col(k).alias(f"_{k}") for k in keys]).distinct()
    return rows.join(F.broadcast(other), [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys], how)


def segments(graph: Graph, length: int = SEGMENT) -> DataFrame:
    """(repo, path, direction, segment, others): the sorted lists of all nodes in pieces of ``length`` entries, numbered from 0.

    Lists of up to ``TOGETHER`` entries are sorted and cut where they meet. Longer ones have
    to fit into no row or task: their places come from running sums over bounded parts. The
    graph is read two or three times; pass stored tables.
    """
    keys = ["repo", "path", "direction"]
    rows, long = entries(graph), hubs(graph)
    short = rows if long is None else among(rows, long, keys, "left_anti")
    # Dealt out first: lists are short, so that collecting before the shuffle only sorts them once more.
    lists = short.repartition(*keys).groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("other"))).alias("_all"))
    # Cut before they are dealt into rows, so that no piece carries the whole list along.
    numbers = F.sequence(F.lit(0), F.floor((F.size("_all") - 1) / length).cast("int"))
    pieces = F.transform(numbers, lambda i: F.slice("_all", i * length + 1, length))
    cut = lists.select(*keys, F.posexplode_outer(pieces).alias("segment", "_piece")).select(
        *keys, "segment", F.array_compact(F.col("_piece")["other"]).alias("others"))
    if long is None:
        return cut
    spread = stored(among(rows, long, keys).withColumn("_one", F.lit(1)), "entries")
    placed = running_sums(spread, keys, ["other"], {"_place": "_one"})
    segment = F.floor((F.col("_place") - 1) / length).cast("int").alias("segment")
    return cut.unionByName(placed.groupBy(*keys, segment).agg(F.sort_array(F.collect_list("other")).alias("others")))


def adjacency(graph: Graph) -> DataFrame:
    """Nested form (repo, path, imports, imported_by) with whole sorted lists, in one shuffle.

    A hub is one row here; it suits graphs that are looked at. Stored are ``listed``
    rows or ``segments``.
    """
    none = F.lit(None).cast("string")
    rows = graph.nodes.select("repo", "path", none.alias("direction"), none.alias("other")).unionByName(entries(graph))
    of = lambda direction: F.sort_array(F.collect_list(F.when(F.col("direction") == direction, F.col("other")))).alias(direction)
    return rows.repartition("repo", "path").groupBy("repo", "path").agg(of("imports"), of("imported_by"))


def from_adjacency(nested: DataFrame) -> Graph:
    """Flat tables of a nested graph (repo, path, imports, imported_by)."""
    return Graph(
        nested.select("repo", "path").distinct(),
        nested.select("repo", "path", F.explode("imports").alias("target")),
        nested.select("repo", "path", F.explode("imported_by").alias("importer")),
    )


def update_graph(graph: Graph, updated: DataFrame, deleted: DataFrame) -> Graph:
    """Replace the nodes of re-annotated files and drop deleted ones.

    Reverse entries of unchanged importers are kept, and entries that pointed
    to a file which only now exists are added, so the result equals a rebuild
    from the merged annotations.
    """
    gone = stored(deleted.select("repo", "path").distinct(), "gone")
    new_nodes = stored(updated.select("repo", "path").distinct(), "updated")
    touched = stored(gone.unionByName(new_nodes).distinct(), "touched")
    nodes = graph.nodes.join(touched, ["repo", "path"], "left_anti").unionByName(new_nodes)
    # Written as it is read for both lists; what was shuffled for it is gone before the next is read.
    kept = stored(
        graph.imports.join(touched, ["repo", "path"], "left_anti").join(_as_target(gone), ["repo", "target"], "left_anti").select("repo", "path", "target"), "kept")
    new_imports = import_entries(updated)
    imports = kept.unionByName(new_imports)

    # Entries of nodes that were not there before are built anew, like those of re-annotated importers.
    appeared = stored(new_nodes.join(graph.nodes, ["repo", "path"], "left_anti"), "appeared")
    as_importer = touched.select("repo", F.col("path").alias("importer"))
    unchanged = stored(
        graph.importers.join(as_importer, ["repo", "importer"], "left_anti")
        .join(gone.unionByName(appeared), ["repo", "path"], "left_anti")
        .select("repo", "path", "importer"), "unchanged")
    anew = _reverse(new_imports, nodes).unionByName(
        kept.join(_as_target(appeared), ["repo", "target"], "left_semi").select("repo", F.col("target").alias("path"), F.col("path").alias("importer")).distinct())
    return Graph(nodes, imports, unchanged.unionByName(anew))


def graph_stats(graph: Graph) -> DataFrame:
    ins, outs = F.col("imported_by_count"), F.col("import_count")
    return degrees(graph).groupBy("repo").agg(
        F.count(F.lit(1)).alias("total_files"),
        F.sum(outs).alias("total_imports"),
        F.avg(outs).alias("avg_imports_per_file"),
        F.max(outs).alias("max_imports"),
        F.max(ins).alias("max_imported_by"),
        F.count_if((ins == 0) & (outs == 0)).alias("orphan_count"),
    )


def graph_diff(old: Graph, new: Graph) -> DataFrame:
    """(repo, path, direction, added, removed) for every list that differs.

    Lists of a node on both sides compare as sets; a node on one side only
    counts all its entries. An import and its reverse entry are counted as one pair.
    """
    names = ["_old_imports", "_new_imports", "_old_importers", "_new_importers"]
    side = lambda df, src, dst, at: df.select("repo", F.col(src).alias("src"), F.col(dst).alias("dst"), F.lit(at).cast("tinyint").alias("_side"))
    sides = side(old.imports, "path", "target", 0)
    for df, src, dst, at in ((new.imports, "path", "target", 1), (old.importers, "importer", "path", 2), (new.importers, "importer", "path", 3)):
        sides = sides.unionByName(side(df, src, dst, at))
    # Dealt out first: sides hardly repeat a pair, so that counting before the shuffle only holds them once more.
    pairs = sides.repartition("repo", "src", "dst").groupBy("repo", "src", "dst").agg(*[F.count_if(F.col("_side") == i).alias(n) for i, n in enumerate(names)])
    case = lambda direction, path, was, now: F.when((F.col(was) == 0) != (F.col(now) == 0), F.struct(
        F.col(path).alias("path"), F.lit(direction).alias("direction"), F.col(was).alias("_old"), F.col(now).alias("_new")))
    differing = F.array_compact(F.array(case("imports", "src", *names[:2]), case("imported_by", "dst", *names[2:])))
    counts = pairs.select("repo", F.inline(differing))
    both = old.nodes.join(new.nodes, ["repo", "path"], "left_semi").withColumn("_both", F.lit(True))
    entry = lambda n: F.when(F.col("_both"), F.least(n, F.lit(1))).otherwise(n)
    return (
        counts.join(both, ["repo", "path"], "left")
        .groupBy("repo", "path", "direction")
        .agg(
            F.sum(entry(F.col("_new"))).cast("bigint").alias("added"),
            F.sum(entry(F.col("_old"))).cast("bigint").alias("removed"),
        )
    )


def edges_updated(old: Graph, new: Graph) -> DataFrame:
    return graph_diff(old, new).groupBy("repo").agg(F.sum(F.col("added") + F.col("removed")).alias("edges_updated"))


def broken_references(graph: Graph, deleted: DataFrame) -> DataFrame:
    """(repo, path, direction, other): entries of either direction that name a deleted file."""
    gone = deleted.select("repo", F.col("path").alias("other")).distinct()
    return entries(graph).join(gone, ["repo", "other"], "left_semi").select("repo", "path", "direction", "other")


def dependencies(queries: DataFrame, graph: Graph, annotations: DataFrame) -> DataFrame:
    """Annotated files that the queried files import; one row per import entry."""
    files = annotations.withColumnRenamed("path", "target").drop("imports")
    return (
        queries.select("query_id", "repo", "path")
        .join(graph.imports, ["repo", "path"])
        .join(files, ["repo", "target"])
        .drop("path")
        .withColumnRenamed("target", "path")
    )


def dependents(queries: DataFrame, graph: Graph, annotations: DataFrame) -> DataFrame:
    """Annotated files that import any of a query's files (direct importers, each once).

    ``queries`` is (query_id, repo, path) with one row per target file.
    """
    importers = (
        queries.select("query_id", "repo", "path")
        .join(graph.importers, ["repo", "path"])
        .select("query_id", "repo", F.col("importer").alias("path"))
        .distinct()
    )
    return importers.join(annotations.drop("imports"), ["repo", "path"])


def external_dependents(dir_queries: DataFrame, graph: Graph, annotations: DataFrame, inside: DataFrame | None = None) -> DataFrame:
    """Dependents of the files below each (query_id, repo, prefix), without those below it themselves.

    ``inside`` is what ``match_prefixes`` gives for the queries, if that is at hand.
    """
    if inside is None:
        inside = match_prefixes(dir_queries, annotations.select("repo", "path"))
    targets = inside.join(graph.importers, ["repo", "path"])
    outside = (
        targets.filter(~F.startswith(F.col("importer"), dir_prefix(F.col("prefix"))))
        .select("query_id", "repo", F.col("importer").alias("path"))
        .distinct()
    )
    return outside.join(annotations.drop("imports"), ["repo", "path"])


def by_path(df: DataFrame, *keys: str, order: str = "binary") -> DataFrame:
    """Sorted by the keys and then by path."""
    return df.orderBy(*keys, sort_key(F.col("path"), order))
