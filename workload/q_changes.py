"""Queries over change lists, update strategies and versions."""

from __future__ import annotations

from pyspark.sql import functions as F

from codeloom.operators import calls, changes, versions
from workload.registry import query
from workload.views import Workspace


@query("j1_parse_changes", """
    select repo, case status when 'P' then 'D' when 'F' then 'M' else 'A' end as status, path from v_order where not priority in ('4-NOT SPECIFIED', '5-LOW', '3-MEDIUM')
    union all select repo, 'D', path from v_order where priority = '4-NOT SPECIFIED'
    union all select repo, 'A', replace(path, 'src/', 'app/') from v_order where priority = '4-NOT SPECIFIED'""")
def parse(w):
    return changes.parse_changes(w.view("v_change_lines"))


_NEW = "new_dirs as (select distinct repo, 'hot' as top_dir from v_changes where path like 'hot/%')"


@query("j2_new_top_dirs", "select * from new_dirs", _NEW)
def new_dirs(w):
    return changes.new_top_dirs(w.view("v_changes"), w.files())


# Changes of one commit: a repository sees those of its last days, so that small and large lists occur.
_RECENT = """select c.* from v_changes c join v_heads h on h.repo = c.repo where c.ordered_at >= case h.n_regionkey when 0 then timestamp '2001-06-01 00:00:00'
        when 2 then timestamp '2001-01-01 00:00:00' else timestamp '1995-01-01 00:00:00' end and (h.n_regionkey >= 3 or not c.path like 'hot/%')"""
_STRATEGY = f"""recent as ({_RECENT}), counted as (select h.repo, h.current_commit, case when n_regionkey <> 4 then h.git_commit end as git_commit,
        coalesce(count(c.path) filter (c.status <> 'D'), 0) as changed, coalesce(count(c.path) filter (c.status = 'D'), 0) as deleted,
        coalesce(bool_or(c.path like 'hot/%'), false) as hot from v_heads h left join recent c on c.repo = h.repo group by all),
    zeroed as (select repo, current_commit, git_commit, git_commit is not null and git_commit <> current_commit as compared,
        case when compared then changed else 0 end as changed_files, case when compared then deleted else 0 end as deleted_files, compared and hot as has_new_top_dir from counted),
    strategies as (select repo, git_commit, current_commit, changed_files, deleted_files, changed_files + deleted_files as total_changes, has_new_top_dir,
        case when git_commit is null then 'full-rebuild' when git_commit = current_commit then 'delta' when has_new_top_dir then 'full-rebuild'
            when total_changes > 100 then 'full-rebuild' when total_changes >= 20 then 'delta-with-validation' else 'delta' end as strategy,
        case when git_commit is null then 'No existing map found' when git_commit = current_commit then 'Map is up to date' when has_new_top_dir then 'New top-level directory detected'
            when total_changes > 100 then concat(cast(total_changes as varchar), ' files changed (>100)')
            when total_changes >= 20 then concat(cast(total_changes as varchar), ' files changed (20-100)') else concat(cast(total_changes as varchar), ' files changed (<20)') end as reason from zeroed)"""


def strategies(w: Workspace):
    recent = w.sql(_RECENT)
    heads = w.view("v_heads")
    meta = heads.filter(F.col("n_regionkey") != 4)
    return changes.update_strategy(recent, meta, heads.select("repo", "current_commit"), changes.new_top_dirs(recent, w.files()))


@query("j3_update_strategy", "select * from strategies", _STRATEGY)
def strategy(w):
    return strategies(w)


# Commits of a repository: its orders by date; the map was built at one of them.
_COMMITS = "select repo, path as commit, ordered_at as committed_at, order_id as ordinal from v_order"
_BUILT = "select repo, case when repo = 'NATION_3' then 'unknown' else max(path) end as git_commit from v_order where status = 'F' group by repo"
_DISTANCE = f"""commits as ({_COMMITS}), built as ({_BUILT}), distances as (select b.repo, b.git_commit, coalesce(datediff('second', c.committed_at, timestamp '2002-01-01 12:00:00') // 86400, 0) as commit_age_days,
        coalesce((select count(*) from commits x where x.repo = b.repo and x.ordinal > c.ordinal), 0) as commits_ahead
    from built b left join commits c on c.repo = b.repo and c.commit = b.git_commit)"""


def distances(w: Workspace):
    return changes.commit_distance(w.sql(_COMMITS), w.sql(_BUILT), "2002-01-01 12:00:00")


@query("j4_commit_distance", "select * from distances", _DISTANCE)
def distance(w):
    return distances(w)


_VERSION = """concat('v', cast(map_version as varchar), case when update_type = 'delta' then ' (delta)' else '' end,
    case when coalesce(parent_version, 0) <> 0 then concat(' ← v', cast(parent_version as varchar)) else '' end)"""


def last_versions(w: Workspace):
    return versions.latest_meta(w.view("v_history"))


@query("j5_map_status", f"""
    select m.repo, {_VERSION} as version, m.schema_version, substr(s.git_commit, 1, 7) as build_commit_short, substr(s.current_commit, 1, 7) as current_commit_short,
        commit_age_days, commits_ahead, total_changes, changed_files, deleted_files, strategy, reason,
        case when total_changes = 0 then 'up-to-date' when strategy = 'full-rebuild' then 'full-rebuild-recommended' else 'update-recommended' end as verdict
    from (select * from v_history qualify row_number() over (partition by repo order by map_version desc) = 1) m
    join strategies s on s.repo = m.repo left join distances d on d.repo = m.repo""", f"{_STRATEGY}, {_DISTANCE}")
def status(w):
    return changes.map_status(last_versions(w), strategies(w), distances(w))


@query("j6_next_version", """
    select b.repo, coalesce(m.v + 1, 1) as map_version, m.v as parent_version, b.git_commit, 'full' as update_type, cast(null as bigint) as files_changed,
        coalesce(m.c, timestamp '2024-06-01 00:00:00') as created_at, timestamp '2024-06-01 00:00:00' as last_updated
    from (select n_name as repo, 'head' as git_commit from nation union all select s_name, 'head' from supplier) b
    left join (select repo, max(map_version) as v, max(created_at) as c from v_history group by repo) m on m.repo = b.repo""")
def next_version(w):
    builds = w.sql("""
        select repo, 'head' as git_commit, 'full' as update_type, cast(null as bigint) as files_changed, timestamp_ntz '2024-06-01 00:00:00' as built_at
        from (select n_name as repo from nation union all select s_name from supplier) as x""")
    return versions.next_version(w.view("v_history"), builds).withColumns(
        {c: F.col(c).cast("timestamp_ntz") for c in ("created_at", "last_updated")})


@query("j7_check_versions", """
    select repo, map_version, rule from (select repo, map_version, case when map_version < 1 then 'Invalid map version: must be >= 1'
        when map_version = 1 and parent_version is not null then 'First version should not have a parent version'
        when map_version > 1 and parent_version is null then 'Version > 1 should have a parent version'
        when parent_version >= map_version then 'Parent version must be less than current version'
        when update_type = 'delta' and files_changed is null then 'Delta updates must specify files_changed'
        when update_type = 'full' and files_changed is not null then 'Full rebuilds should not have files_changed set' end as rule from v_history) where rule is not null""")
def check(w):
    return versions.check_versions(w.view("v_history"))


@query("j8_version_report", f"""
    select repo, map_version, {_VERSION} as version, case when map_version = 1 then 'Initial version' else concat('Version ', cast(map_version as varchar),
        case when coalesce(parent_version, 0) <> 0 then concat(chr(10), 'Built from version ', cast(parent_version as varchar)) else '' end,
        chr(10), 'Update type: ', update_type,
        case when update_type = 'delta' and files_changed is not null then concat(chr(10), 'Files changed: ', cast(files_changed as varchar)) else '' end,
        chr(10), 'Map age: 1 days') end as history from v_history""")
def report(w):
    return versions.version_report(w.view("v_history"))


@query("j8_compare_versions", """
    select repo, max(map_version) - min(map_version) as version_diff, case when max(map_version) - min(map_version) = 1 then 'Latest version (1 update)'
        else concat(cast(max(map_version) - min(map_version) as varchar), ' versions newer (', cast(max(map_version) - min(map_version) as varchar), ' updates)') end as description
    from v_history group by repo""")
def compare(w):
    history = w.view("v_history")
    return versions.compare_versions(history.filter(F.col("map_version") == 1), versions.latest_meta(history))


@query("j8_needs_update", "select repo, n_regionkey <> 1 as needs_update from v_heads")
def needs(w):
    heads = w.view("v_heads")
    return versions.needs_update(heads.filter(F.col("n_regionkey") != 4), heads)


@query("j9_latest_run", "select repo, map_version, git_commit from v_history qualify row_number() over (partition by repo order by map_version desc) = 1")
def latest(w):
    runs = w.view("v_history").withColumn("finished_at", F.col("map_version"))
    return calls.latest_run(runs).select("repo", "map_version", "git_commit")
