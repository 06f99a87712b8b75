"""Queries over map quality: consistency, structure, cycles, repair, validation."""

from __future__ import annotations

from pyspark.sql import functions as F

from codeloom.operators import checks, cycles, graph, joins, repair
from codeloom.schemas import Graph
from codeloom.session import stored
from workload.q_graph import CLEAN, MERGED, updated
from workload.registry import query
from workload.views import Workspace

# Issue rows as SQL. Tables of the statement: files (repo, path, n_exports),
# listed (repo, path), fwd (repo, src, dst), rev (repo, path, importer), nodes (repo, path).
_MISSING = """select a.repo, 'error' as severity, 'missing_import' as type, a.src as file, concat('Imports "', a.dst, '" which is not in the map') as message
    from ann a left join files f on f.repo = a.repo and f.path = a.dst where f.path is null"""
_ASYMMETRIC = """select p.repo, 'error' as severity, case when n.path is null then 'broken_graph_reference' else 'asymmetric_graph' end as type, p.file,
        case when n.path is null and ahead then concat('Graph references "', p.other, '" which doesn''t exist in graph')
            when ahead then concat('Imports "', p.other, '" but "', p.other, '" doesn''t list it in imported_by')
            when n.path is null then concat('Graph lists "', p.other, '" in imported_by but it doesn''t exist in graph')
            else concat('Listed in "', p.other, '" imported_by but "', p.other, '" doesn''t import it') end as message
    from (select repo, case when f = 1 then src else dst end as file, case when f = 1 then dst else src end as other, f = 1 as ahead
        from (select repo, src, dst, max(f) as f, count(*) as n from (select repo, src, dst, 1 as f from fwd union all select repo, importer, path, 0 from rev) group by repo, src, dst)
        where n = 1) p left join nodes n on n.repo = p.repo and n.path = p.other"""
_DELETED = """select f.repo, 'error' as severity, 'deleted_file' as type, f.path as file, 'File in map but doesn''t exist on disk' as message
    from files f left join listed l on l.repo = f.repo and l.path = f.path where l.path is null"""
_MISMATCH = """select n.repo, 'error' as severity, 'graph_annotation_mismatch' as type, n.path as file, 'File exists in graph but not in annotations' as message
    from nodes n left join files f on f.repo = n.repo and f.path = n.path where f.path is null
    union all select f.repo, 'error', 'graph_annotation_mismatch', f.path, 'File exists in annotations but not in graph'
    from files f left join nodes n on f.repo = n.repo and f.path = n.path where n.path is null
    union all select e.repo, 'warning', 'graph_annotation_mismatch', e.src, concat('Graph lists import "', e.dst, '" but annotation doesn''t')
    from (select * from fwd except select * from ann) e join files f on f.repo = e.repo and f.path = e.src join nodes n on n.repo = e.repo and n.path = e.src
    union all select e.repo, 'warning', 'graph_annotation_mismatch', e.src, concat('Annotation lists import "', e.dst, '" but graph doesn''t')
    from (select * from ann except select * from fwd) e join files f on f.repo = e.repo and f.path = e.src join nodes n on n.repo = e.repo and n.path = e.src"""
_ORPHANS = """select f.repo, 'warning' as severity, 'orphan_file' as type, f.path as file,
        'File is not imported by anything and is not an entry point (possible dead code)' as message
    from files f join nodes n on n.repo = f.repo and n.path = f.path
    where not exists (select 1 from rev r where r.repo = f.repo and r.path = f.path)
        and not exists (select 1 from v_entry e where e.repo = f.repo and e.path = f.path) and not exists (select 1 from v_config c where c.repo = f.repo and c.path = f.path)"""
_SILENT = """select f.repo, 'info' as severity, 'no_exports' as type, f.path as file,
        'File imports but exports nothing (may be side-effect only or incorrectly annotated)' as message
    from files f where f.n_exports = 0 and not regexp_matches(f.path, 'test|spec|__tests__') and exists (select 1 from ann a where a.repo = f.repo and a.src = f.path)
        and not exists (select 1 from v_entry e where e.repo = f.repo and e.path = f.path)"""
# Components by mutual reachability. Only nodes with an out-edge can lie on a cycle.
_REACH = """heads as (select distinct repo, src as path from fwd),
    inner_edges as (select e.* from fwd e join heads h on h.repo = e.repo and h.path = e.dst),
    reach(repo, a, b) as (select repo, src, dst from inner_edges
        union select r.repo, r.a, e.dst from reach r join inner_edges e on e.repo = r.repo and e.src = r.b),
    cycles as (select x.repo, x.a as path, min(x.b) as cycle from reach x join reach y on x.repo = y.repo and x.a = y.b and x.b = y.a group by all)"""
_CYCLES = """select repo, 'info' as severity, 'circular_dependency' as type, cycle as file, concat('Circular dependency detected: ',
        cast(count(*) as varchar), ' files, first ', cycle) as message
    from cycles group by repo, cycle"""

_FILES = "files as (select repo, path, case when export_list = '' then 0 else 1 end as n_exports from v_files)"
STALE = f"""{_FILES}, nodes as (select repo, path from v_files), listed as (select * from v_listing),
    ann as (select repo, src, dst from v_edges), fwd as (select repo, src, dst from v_edges), rev as (select repo, path, importer from v_importers)"""
# Annotations without the entry files; graph without the files that are gone and without promo imports.
PARTIAL = """files as (select repo, path from v_files f where not exists (select 1 from v_entry e where e.repo = f.repo and e.path = f.path)),
    nodes as (select repo, path from v_listing), ann as (select e.repo, e.src, e.dst from v_edges e join files f on f.repo = e.repo and f.path = e.src),
    fwd as (select e.repo, e.src, e.dst from v_edges e join nodes n on n.repo = e.repo and n.path = e.src where not e.dst like 'lib/promo/%')"""
# The map after all repairs.
FIXED = """files as (select f.repo, f.path, case when export_list = '' then 0 else 1 end as n_exports from v_files f join v_listing l on l.repo = f.repo and l.path = f.path),
    listed as (select * from v_listing), nodes as (select repo, path from files),
    ann as (select e.repo, e.src, e.dst from v_edges e join files a on a.repo = e.repo and a.path = e.src join files b on b.repo = e.repo and b.path = e.dst),
    fwd as (select * from ann), rev as (select repo, dst as path, src as importer from ann),
    old_rev as (select r.* from v_importers r join files a on a.repo = r.repo and a.path = r.path join files b on b.repo = r.repo and b.path = r.importer),
    gone_log as (select repo, 'error' as severity, 'deleted_file' as type, path as file, 'Removed deleted file from map' as message from v_gone),
    import_log as (select e.repo, 'error', 'missing_import', e.src, concat('Removed import to non-existent file "', e.dst, '"') from v_edges e
        join files a on a.repo = e.repo and a.path = e.src left join files b on b.repo = e.repo and b.path = e.dst where b.path is null),
    mirror_log as (select repo, 'error', 'asymmetric_graph', path, concat('Added missing imported_by reference from "', importer, '"') from (select * from rev except select * from old_rev)
        union all select repo, 'error', 'asymmetric_graph', path, concat('Removed incorrect imported_by reference from "', importer, '"') from (select * from old_rev except select * from rev)),
    fixes as (select * from gone_log union all select * from import_log union all select * from mirror_log)"""


def stale(w: Workspace):
    return w.annotations(), w.stale_graph(), w.listing(), w.view("v_entry"), w.view("v_config")


@query("i1_missing_imports", _MISSING, STALE)
def missing(w):
    return checks.missing_imports(w.annotations())


@query("i2_asymmetric_edges", _ASYMMETRIC, STALE)
def asymmetric(w):
    return checks.asymmetric_edges(w.stale_graph())


@query("f6_graph_consistent", """
    select repo, 'stale' as graph, repo not in (select repo from issues) as consistent from nodes group by repo
    union all select repo, 'fixed', true from v_listing group by repo""", f"{STALE}, issues as ({_ASYMMETRIC})")
def consistent(w):
    files, old, listing, _, _ = stale(w)
    fixed = repair.autofix(files, old, listing).graph
    tag = lambda g, name: checks.graph_consistency(g).select("repo", F.lit(name).alias("graph"), "consistent")
    return tag(old, "stale").unionByName(tag(fixed, "fixed"))


@query("i3_deleted_files", _DELETED, STALE)
def deleted(w):
    return checks.deleted_files(w.files(), w.listing())


def partial(w: Workspace):
    files = w.annotations().join(w.view("v_entry"), ["repo", "path"], "left_anti")
    nodes = w.listing().select("repo", "path")
    imports = w.imports().join(nodes, ["repo", "path"], "left_semi").filter(~F.startswith("target", F.lit("lib/promo/")))
    return files, Graph(nodes, imports.select("repo", "path", "target"), w.importers())


@query("i4_graph_annotation_mismatch", _MISMATCH, PARTIAL)
def mismatch(w):
    files, some = partial(w)
    return checks.graph_annotation_mismatch(some, files)


_ALL_CONSISTENCY = " union all ".join(f"select * from ({s})" for s in (_MISSING, _ASYMMETRIC, _DELETED, _MISMATCH))


@query("i5_consistency_issues", _ALL_CONSISTENCY, STALE)
def consistency(w):
    files, old, listing, _, _ = stale(w)
    return checks.consistency_issues(files, old, listing, True)


@query("i6_orphan_files", _ORPHANS, STALE)
def orphans(w):
    files, old, _, entries, config = stale(w)
    return checks.orphan_files(files, old, entries, config)


@query("i7_cycle_members", "select repo, cycle, path from cycles", f"{STALE}, {_REACH}")
def members(w):
    return cycles.cycle_members(Graph(w.files().select("repo", "path"), w.imports(), w.importers()))


@query("i7_circular_dependencies", _CYCLES, f"{STALE}, {_REACH}")
def circular(w):
    return checks.circular_dependencies(w.stale_graph())


# Every order of a nation imports the next one, the last one the first: one cycle of all its files.
_RING = """select repo, path as src, coalesce(lead(path) over (partition by repo order by order_id), first_value(path) over (partition by repo order by order_id)) as dst from v_order"""


@query("i7_large_cycles", "select repo, min(path) over (partition by repo) as cycle, path from v_order")
def large_cycles(w):
    ring = w.sql(_RING)
    imports = ring.select("repo", F.col("src").alias("path"), F.col("dst").alias("target"))
    return cycles.cycle_members(Graph(imports.select("repo", "path"), imports, imports.limit(0).withColumnRenamed("target", "importer")))


@query("i8_no_exports", _SILENT, STALE)
def silent(w):
    return checks.no_exports(w.annotations(), w.view("v_entry"))


@query("i9_structural_issues", " union all ".join(f"select * from ({s})" for s in (_ORPHANS, _CYCLES, _SILENT)), f"{STALE}, {_REACH}")
def structural(w):
    files, old, _, entries, config = stale(w)
    return checks.structural_issues(files, old, entries, config)


@query("i10_fix_deleted", """
    select repo, path, 'node' as row from v_listing union all select repo, path, 'log' from v_gone
    union all select e.repo, concat(e.src, ' > ', e.dst), 'import' from v_edges e join v_listing l on l.repo = e.repo and l.path = e.src""")
def fix_deleted(w):
    files, old, listing, _, _ = stale(w)
    fixed = repair.fix_deleted(files, old, listing)
    row = lambda df, path, name: df.select("repo", path.alias("path"), F.lit(name).alias("row"))
    return (
        row(fixed.graph.nodes, F.col("path"), "node").unionByName(row(fixed.log, F.col("file"), "log"))
        .unionByName(row(fixed.graph.imports, F.concat("path", F.lit(" > "), "target"), "import")))


@query("i11_fix_imports", """
    select repo, 'annotation' as row, e.src as path, e.dst as other from kept e union all select repo, 'graph', src, dst from kept
    union all select repo, 'importer', r.path, r.importer from v_importers r where exists (select 1 from v_files f where f.repo = r.repo and f.path = r.importer)""",
    "kept as (select e.* from v_edges e join v_files f on f.repo = e.repo and f.path = e.dst)")
def fix_imports(w):
    files, old, _, _, _ = stale(w)
    fixed = repair.fix_imports(files, old)
    row = lambda df, name, other: df.select("repo", F.lit(name).alias("row"), "path", F.col(other).alias("other"))
    return (
        row(graph.import_entries(fixed.annotations), "annotation", "target").unionByName(row(fixed.graph.imports, "graph", "target"))
        .unionByName(row(fixed.graph.importers, "importer", "importer")))


@query("i12_fix_imported_by", """
    select repo, 'error' as severity, 'asymmetric_graph' as type, path as file, concat('Added missing imported_by reference from "', importer, '"') as message
    from (select * from reverse except select * from v_importers)
    union all select repo, 'error', 'asymmetric_graph', path, concat('Removed incorrect imported_by reference from "', importer, '"')
    from (select * from v_importers except select * from reverse)""", CLEAN)
def fix_imported_by(w):
    files, old, _, _, _ = stale(w)
    return repair.fix_imported_by(files, old).log


@query("i13_autofix", "select * from fixes", FIXED)
def autofix(w):
    files, old, listing, _, _ = stale(w)
    return repair.autofix(files, old, listing, stored).log


_REMAINING = " union all ".join(f"select * from ({s})" for s in (_MISSING, _ASYMMETRIC, _DELETED, _MISMATCH, _ORPHANS))


@query("i14_validate_map", f"select * from fixes union all {_REMAINING}", FIXED)
def validate(w):
    return repair.validate_map(*stale(w)).issues


@query("i14_validate_map_unfixed", " union all ".join([_ALL_CONSISTENCY] + [f"select * from ({s})" for s in (_ORPHANS, _CYCLES, _SILENT)]), f"{STALE}, {_REACH}")
def validate_unfixed(w):
    return repair.validate_map(*stale(w), fix=False, include_info=True).issues


_CHANGED = f"""{MERGED}, files as (select m.repo, m.path, case when u.path is null and export_list <> '' then 1 else 0 end as n_exports
        from merged m left join u on u.repo = m.repo and u.path = m.path left join v_files f on f.repo = m.repo and f.path = m.path),
    nodes as (select repo, path from merged), listed as (select * from v_listing), fwd as (select repo, src, dst from merged_edges),
    ann as (select repo, src, dst from ue union all select e.repo, e.src, e.dst from v_edges e join merged m on m.repo = e.repo and m.path = e.src
        where not exists (select 1 from u where u.repo = e.repo and u.path = e.src)),
    rev as (select r.repo, r.path, r.importer from v_importers r where not exists (select 1 from u where u.repo = r.repo and u.path = r.importer)
            and not exists (select 1 from v_gone g where g.repo = r.repo and g.path in (r.path, r.importer))
        union all select e.repo, e.dst, e.src from ue e join merged m on m.repo = e.repo and m.path = e.dst
        union all select e.repo, e.dst, e.src from merged_edges e join u on u.repo = e.repo and u.path = e.dst left join v_files f on f.repo = e.repo and f.path = e.dst
        where f.path is null and not exists (select 1 from u x where x.repo = e.repo and x.path = e.src))"""


@query("i14_recheck", " union all ".join(f"select * from ({s})" for s in (_MISSING, _ASYMMETRIC, _DELETED, _MISMATCH, _ORPHANS, _SILENT)), _CHANGED)
def recheck(w):
    """The issues of the map before a change, brought up to date with it."""
    files, old, listing, entries, config = stale(w)
    checked = (checks.consistency_issues(files, old, listing, True), checks.structural_issues(files, old, entries, config, False), checks.no_exports(files, entries))
    found = checks.union_all([stored(df, "issues") for df in checked])
    new, gone = updated(w), w.gone()
    later = graph.update_graph(old, new, gone)
    after = stored(joins.merge_annotations(files, new, gone)), Graph(stored(later.nodes), later.imports, stored(later.importers))
    changed = new.select("repo", "path").unionByName(gone.select("repo", "path"))
    return checks.recheck(found, changed, (files, old), after, listing, entries, config)


@query("g7_issue_summary", """
    select repo, count(*) filter (severity = 'error') as errors, count(*) filter (severity = 'warning') as warnings, count(*) filter (severity = 'info') as info,
        count(*) as total, count(*) filter (severity <> 'info') as requires_attention,
        (select count(*) from fixes x where x.repo = i.repo) as auto_fixed from issues i group by repo""", f"{FIXED}, issues as (select * from fixes union all {_REMAINING})")
def summary(w):
    return repair.validate_map(*stale(w)).summary


_GROUPED = """select repo, {0}, count(*) as issues, count(*) filter (severity = 'error') as errors, count(*) filter (severity = 'warning') as warnings,
    count(*) filter (severity = 'info') as info from issues group by repo, {0}"""


@query("g8_issues_by_type", _GROUPED.format("type"), f"{STALE}, issues as ({_ALL_CONSISTENCY})")
def by_type(w):
    files, old, listing, _, _ = stale(w)
    return checks.issues_by_type(checks.consistency_issues(files, old, listing, True))


@query("g8_issues_by_file", _GROUPED.format("file"), f"{STALE}, issues as ({_ALL_CONSISTENCY})")
def by_file(w):
    files, old, listing, _, _ = stale(w)
    return checks.issues_by_file(checks.consistency_issues(files, old, listing, True))
