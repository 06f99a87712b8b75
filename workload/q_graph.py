"""Queries over the dependency graph: building, updating, neighbours, ranking."""

from __future__ import annotations

from pyspark.sql import functions as F

from codeloom.operators import graph as G
from codeloom.operators import joins, ranking
from workload.registry import query
from workload.views import Workspace

CLEAN = "reverse as (select e.repo, e.dst as path, e.src as importer from v_edges e join v_files f on e.repo = f.repo and e.dst = f.path)"
DEGREES = f"""{CLEAN},
    outs as (select repo, src as path, count(*) as n from v_edges group by all), ins as (select repo, path, count(*) as n from reverse group by all),
    degrees as (select f.repo, f.path, coalesce(outs.n, 0) as import_count, coalesce(ins.n, 0) as imported_by_count, f.line_count, f.purpose,
        case when export_list = '' then 0 else len(string_split(export_list, ',')) end as n_exports, export_list
        from v_files f left join outs on outs.repo = f.repo and outs.path = f.path left join ins on ins.repo = f.repo and ins.path = f.path),
    scored as (select *, cast(5 * imported_by_count + 2 * import_count + 3 * n_exports - case when line_count > 1000 then 5 else 0 end as bigint) as score from degrees)"""


@query("e1_edges", """
    select e.repo, src, dst, f.path is not null as resolved from v_edges e left join v_files f on e.repo = f.repo and e.dst = f.path""")
def edges(w):
    return G.edges(w.annotations())


@query("e2_dependencies", """
    select o.order_id as query_id, f.path, f.purpose from v_order o join v_edges e on o.repo = e.repo and o.path = e.src
    join v_files f on e.repo = f.repo and e.dst = f.path""")
def dependencies(w):
    wanted = w.view("v_order").withColumnRenamed("order_id", "query_id")
    files = w.annotations()
    return G.dependencies(wanted, w.graph(), files).select("query_id", "path", "purpose")


@query("e3_dependents", f"""
    select distinct n_nationkey as query_id, r.importer as path from nation join reverse r on r.repo = n_name and r.path like 'lib/promo/%'
    join v_files f on f.repo = r.repo and f.path = r.importer""", CLEAN)
def dependents(w):
    wanted = w.sql("select n_nationkey as query_id, repo, path from v_files join nation on repo = n_name where path like 'lib/promo/%'")
    files = w.annotations()
    return G.dependents(wanted, w.graph(), files).select("query_id", "path")


@query("e4_external_dependents", f"""
    select distinct q.query_id, r.importer as path from q join reverse r on r.repo = q.repo and (r.path = q.prefix or starts_with(r.path, concat(q.prefix, '/')))
        and not starts_with(r.importer, concat(q.prefix, '/'))""", f"""{CLEAN},
    q as (select distinct concat(repo, ':', split_part(path, '/', 2)) as query_id, repo,
        concat(split_part(path, '/', 1), '/', split_part(path, '/', 2)) as prefix from v_files)""")
def external(w):
    wanted = w.files().select(
        F.concat("repo", F.lit(":"), F.split_part("path", F.lit("/"), F.lit(2))).alias("query_id"), "repo",
        F.substring_index("path", "/", 2).alias("prefix")).distinct()
    files = w.annotations()
    return G.external_dependents(wanted, w.graph(), files).select("query_id", "path")


SCOPES = """select c_custkey as task_id, n_name as repo, case when c_mktsegment = 'MACHINERY' then concat('src/c', cast(c_custkey as varchar(20)), '/')
    when c_mktsegment = 'BUILDING' then concat('c', cast(c_custkey as varchar(20)), '/o') when c_mktsegment = 'HOUSEHOLD' then cast(c_custkey as varchar(20))
    else concat('lib/', split_part('promo,small,economy', ',', cast(c_custkey % 3 as int) + 1)) end as scope
    from customer join nation on c_nationkey = n_nationkey"""


@query("e5_match_scopes", """
    select t.task_id, t.repo, f.path from t join v_files f on t.repo = f.repo
        and case when ends_with(t.scope, '/') then starts_with(f.path, t.scope) else contains(f.path, t.scope) end""", f"t as ({SCOPES})")
def scopes(w):
    return joins.match_scopes(w.sql(SCOPES), w.files().select("repo", "path")).select("task_id", "repo", "path")


@query("e7_remaining_tasks", """
    select repo, concat('task_', cast(order_id as varchar), '_src_c', cast(cust_id as varchar), '_') as task_id from v_order where status <> 'F'""")
def remaining(w):
    orders = w.view("v_order").select("repo", "status", F.col("order_id").alias("task_index"),
                                      F.concat(F.lit("src/c"), F.col("cust_id").cast("string"), F.lit("/")).alias("scope"))
    tasks = joins.scope_task_id(orders)
    return joins.remaining_tasks(tasks, tasks.filter(F.col("status") == "F")).select("repo", "task_id")


# Files annotated anew: medium-priority orders, now without their part imports,
# and all missing part files, which turn up without imports of their own.
UPDATED_FILES = """
    select f.repo, f.path, f.line_count from v_files f join v_order o on o.repo = f.repo and o.path = f.path where o.priority = '3-MEDIUM'
    union all select distinct e.repo, e.dst, cast(1 as bigint) from v_edges e left join v_files f on e.repo = f.repo and e.dst = f.path where f.path is null"""
UPDATED_EDGES = """
    select e.repo, e.src, e.dst from v_edges e join v_order o on o.repo = e.repo and o.path = e.src where o.priority = '3-MEDIUM' and not e.dst like 'lib/%'"""
MERGED = f"""u as ({UPDATED_FILES}), ue as ({UPDATED_EDGES}),
    merged as (select repo, path, line_count from u union all select f.repo, f.path, f.line_count from v_files f
        where not exists (select 1 from u where u.repo = f.repo and u.path = f.path) and not exists (select 1 from v_gone g where g.repo = f.repo and g.path = f.path)),
    merged_edges as (select * from ue union all select e.* from v_edges e
        where not exists (select 1 from u where u.repo = e.repo and u.path = e.src) and not exists (select 1 from v_gone g where g.repo = e.repo and g.path in (e.src, e.dst)))"""


def updated(w: Workspace):
    return w.derived("updated", lambda: _updated(w))


def _updated(w: Workspace):
    empty = F.array().cast("array<string>")
    lists = w.sql(f"select * from ({UPDATED_EDGES}) as x").groupBy("repo", F.col("src").alias("path")).agg(F.collect_list("dst").alias("imports"))
    return w.sql(f"select * from ({UPDATED_FILES}) as x").join(lists, ["repo", "path"], "left").select(
        "repo", "path", F.lit("TypeScript").alias("language"), F.lit(1).cast("bigint").alias("size_bytes"), "line_count", F.lit("new").alias("purpose"),
        empty.alias("exports"), F.coalesce("imports", empty).alias("imports"))


@query("e8_merge_annotations", """
    select m.repo, m.path, m.line_count, coalesce(n, 0) as imports from merged m
    left join (select repo, src, count(*) as n from kept group by all) k on k.repo = m.repo and k.src = m.path""", f"""{MERGED},
    kept as (select * from ue union all select e.* from v_edges e where not exists (select 1 from u where u.repo = e.repo and u.path = e.src))""")
def merge(w):
    merged = joins.merge_annotations(w.annotations(), updated(w), w.gone())
    return merged.select("repo", "path", "line_count", F.size("imports").cast("bigint").alias("imports"))


@query("e8_merge_counts", """
    select n_name as repo, (select count(*) from u where u.repo = n_name) as files_reannotated, (select count(*) from v_gone g where g.repo = n_name) as files_removed,
        (select count(*) from v_files f where f.repo = n_name) - (select count(*) from v_gone g where g.repo = n_name)
        - (select count(*) from u where u.repo = n_name) as files_kept from nation""", MERGED)
def merge_counts(w):
    new = updated(w)
    return joins.merge_counts(w.files(), new, new, w.gone())


LISTED = """select repo, path, 'node' as direction, cast(null as varchar) as other from v_files
    union all select repo, src, 'imports', dst from v_edges union all select repo, path, 'imported_by', importer from reverse"""


@query("f1_build_graph", LISTED, CLEAN)
def build(w):
    return G.listed(G.build_graph(w.annotations()))


@query("f1_segments", """
    select repo, path, direction, cast((place - 1) // 3 as int) as segment, string_agg(other, '|' order by other) as others from (
        select *, row_number() over (partition by repo, path, direction order by other) as place from (
            select repo, src as path, 'imports' as direction, dst as other from v_edges
            union all select e.repo, e.dst, 'imported_by', e.src from v_edges e join v_files f on f.repo = e.repo and f.path = e.dst)) group by 1, 2, 3, 4""")
def segments(w):
    """The lists of all nodes in pieces of three entries."""
    return G.segments(w.graph(), 3).withColumn("others", F.array_join("others", "|"))


@query("f1_adjacency", """
    select f.repo, f.path, coalesce(i.l, '') as imports, coalesce(r.l, '') as imported_by from v_files f
    left join (select repo, src, string_agg(dst, '|' order by dst) as l from v_edges group by all) i on i.repo = f.repo and i.src = f.path
    left join (select repo, path, string_agg(importer, '|' order by importer) as l from reverse group by all) r on r.repo = f.repo and r.path = f.path""", CLEAN)
def nested(w):
    return G.adjacency(w.graph()).select("repo", "path", F.array_join("imports", "|").alias("imports"), F.array_join("imported_by", "|").alias("imported_by"))


@query("f2_update_graph", """
    select repo, src as path, 'imports' as direction, dst as other from merged_edges
    union all select distinct e.repo, e.dst, 'imported_by', e.src from merged_edges e join merged m on m.repo = e.repo and m.path = e.dst""", MERGED)
def update(w):
    return G.entries(G.update_graph(w.graph(), updated(w), w.gone()))


@query("f3_graph_stats", """
    select repo, count(*) as total_files, cast(sum(import_count) as bigint) as total_imports, round(avg(import_count), 6) as avg_imports_per_file,
        max(import_count) as max_imports, max(imported_by_count) as max_imported_by, count(*) filter (import_count + imported_by_count = 0) as orphan_count
    from degrees group by repo""", DEGREES)
def stats(w):
    return G.graph_stats(w.graph()).withColumn("avg_imports_per_file", F.round("avg_imports_per_file", 6))


@query("f4_graph_diff", """
    select coalesce(a.repo, b.repo) as repo, coalesce(a.path, b.path) as path, coalesce(a.direction, b.direction) as direction,
        count(*) filter (a.path is null) as added, count(*) filter (b.path is null) as removed
    from old_entries a full join new_entries b on a.repo = b.repo and a.path = b.path and a.direction = b.direction and a.other = b.other
    where a.path is null or b.path is null group by all""", f"""{MERGED}, {CLEAN},
    old_entries as (select repo, src as path, 'imports' as direction, dst as other from v_edges union all select repo, path, 'imported_by', importer from reverse),
    new_entries as (select repo, src as path, 'imports' as direction, dst as other from merged_edges
        union all select e.repo, e.dst, 'imported_by', e.src from merged_edges e join merged m on m.repo = e.repo and m.path = e.dst)""")
def diff(w):
    old = w.graph()
    return G.graph_diff(old, G.update_graph(old, updated(w), w.gone()))


@query("f4_edges_updated", """
    select coalesce(a.repo, b.repo) as repo, count(*) as edges_updated
    from old_entries a full join new_entries b on a.repo = b.repo and a.path = b.path and a.direction = b.direction and a.other = b.other
    where a.path is null or b.path is null group by all""", f"""{MERGED}, {CLEAN},
    old_entries as (select repo, src as path, 'imports' as direction, dst as other from v_edges union all select repo, path, 'imported_by', importer from reverse),
    new_entries as (select repo, src as path, 'imports' as direction, dst as other from merged_edges
        union all select e.repo, e.dst, 'imported_by', e.src from merged_edges e join merged m on m.repo = e.repo and m.path = e.dst)""")
def edges_changed(w):
    old = w.graph()
    return G.edges_updated(old, G.update_graph(old, updated(w), w.gone())).withColumn("edges_updated", F.col("edges_updated").cast("bigint"))


@query("f5_broken_references", """
    select e.repo, e.src as path, 'imports' as direction, e.dst as other from v_edges e join v_gone g on g.repo = e.repo and g.path = e.dst
    union all select r.repo, r.path, 'imported_by', r.importer from reverse r join v_gone g on g.repo = r.repo and g.path = r.importer""", CLEAN)
def broken(w):
    return G.broken_references(w.graph(), w.gone())


@query("k1_rank_files", "select repo, path, import_count, imported_by_count, import_count + imported_by_count as connectivity, score from scored", DEGREES)
def rank(w):
    files = w.annotations()
    return ranking.rank_files(files, w.graph()).select("repo", "path", "import_count", "imported_by_count", "connectivity", "score")


@query("k2_top_files", "select repo, path, score from scored order by score desc, repo, path limit 25", DEGREES)
def top(w):
    files = w.annotations()
    return ranking.top_files(ranking.scored_files(files, w.graph()), 25).select("repo", "path", "score")


@query("k2_top_files_per_repo", """
    select repo, path, score, import_count, imported_by_count from scored qualify row_number() over (partition by repo order by score desc, path) <= 10""", DEGREES)
def top_per_repo(w):
    files = w.annotations()
    ranked = ranking.scored_files(files, w.graph())
    return ranking.top_files(ranked, 10, per=["repo"]).select("repo", "path", "score", "import_count", "imported_by_count")


@query("k3_limit_section", """
    select repo, path, position, total, greatest(total - 10, 0) as remaining from (
        select repo, path, row_number() over (partition by repo order by path) as position, count(*) over (partition by repo) as total from v_files)
    where position <= 10""")
def section(w):
    return ranking.limit_section(w.files(), 10, ["repo"], [F.col("path")]).select(
        "repo", "path", F.col("position").cast("bigint").alias("position"), "total", "remaining")
