"""Corpus views over the provided tables, as SQL that reads the same in Spark and DuckDB.

Nations are repositories. Each customer is a directory of a repository and each
order a source file in it; parts are library files. An order file imports the
part files of its lines, the shared types file of the repository (a hub), and
the customer's next order; orders in status P import the previous one as well,
which closes cycles. A part file exists only if some line that was not returned
uses it, so imports of parts that were only ever returned dangle.

``@join(expr; separator; order)`` stands for the ordered string aggregate, whose
spelling differs between the engines.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Collection

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.operators.graph import build_graph
from codeloom.schemas import Graph
from codeloom.session import discard, stored

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages", "conversations"]

VIEWS = {
    "v_order": """
        select n_name as repo, concat('src/c', cast(o_custkey as varchar(20)), '/o', cast(o_orderkey as varchar(20)), '.ts') as path,
            o_orderkey as order_id, o_custkey as cust_id, o_orderstatus as status, o_orderpriority as priority,
            o_orderdate as ordered_at, o_totalprice as price
        from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey""",
    "v_line": """
        select v.repo, v.path, concat('lib/', lower(p_type), '/p', cast(p_partkey as varchar(20)), '.ts') as target,
            p_partkey as part_id, p_name, p_brand, p_size, l_returnflag as flag
        from lineitem join v_order v on l_orderkey = v.order_id join part on l_partkey = p_partkey""",
    "v_part_file": """
        select distinct repo, target as path, part_id, p_name, p_size from v_line where flag <> 'R'""",
    "v_files": """
        select repo, path, 'TypeScript' as language, cast(floor(price * 3) as bigint) as size_bytes,
            cast(floor(price / 400) as bigint) + 1 as line_count, concat('Order in status ', status) as purpose,
            case status when 'P' then '' when 'O' then concat('Order', cast(order_id as varchar(20)))
                else concat('Order', cast(order_id as varchar(20)), ',load,save') end as export_list
        from v_order
        union all
        select repo, path, 'TypeScript', cast(p_size * 1000 as bigint), cast(p_size * 25 as bigint), p_name,
            case when p_size > 40 then 'make,sell,size,brand,type,price,name' else 'make' end
        from v_part_file
        union all
        select n_name, 'src/types.ts', 'TypeScript', cast(4096 as bigint), cast(120 as bigint), 'Shared types', 'OrderId,PartId'
        from nation""",
    "v_chain": """
        select repo, path as src, next_path as dst, next_status from (
            select repo, path, lead(path) over (partition by cust_id order by order_id) as next_path,
                lead(status) over (partition by cust_id order by order_id) as next_status from v_order) as chained
        where next_path is not null""",
    "v_edges": """
        select repo, path as src, target as dst from v_line
        union select repo, path, 'src/types.ts' from v_order
        union select repo, src, dst from v_chain
        union select repo, dst, src from v_chain where next_status = 'P'
        union select repo, path, path from v_part_file where p_size = 50""",
    # Reverse lists with faults: promo parts list nobody, every order lists its
    # successor, and importers of missing part files are listed by those parts.
    "v_importers": """
        select e.repo, e.dst as path, e.src as importer from v_edges e join v_files f on e.repo = f.repo and e.dst = f.path
        where not e.dst like 'lib/promo/%'
        union select repo, src, dst from v_chain
        union select e.repo, e.src, e.dst from v_edges e left join v_files f on e.repo = f.repo and e.dst = f.path
        where f.path is null""",
    "v_gone": "select repo, path from v_order where priority = '2-HIGH' and status = 'F'",
    "v_listing": """
        select f.repo, f.path from v_files f left join v_gone g on f.repo = g.repo and f.path = g.path where g.path is null""",
    "v_entry": "select repo, path from v_order where priority = '1-URGENT'",
    "v_config": "select repo, path from v_order where priority = '5-LOW' and status = 'O'",
    "v_meta": """
        select n_name as repo, n_name as repo_name, concat('Orders of ', n_name) as purpose, r_name as stack,
            concat('src/', lower(n_name), '.ts') as entry, case when r_regionkey = 0 then '' when r_regionkey = 1 then 'Sort imports'
            else 'Sort imports;No cycles;One order per file;Types in one place;Short names;No globals;Test first' end as convention_list
        from nation join region on n_regionkey = r_regionkey""",
    "v_text": """
        select source as repo, concat(lang, '/', cast(doc_id % 5 as varchar(20)), '/doc', cast(doc_id as varchar(20)), '.md') as path,
            text, lang, cast(length(text) - length(replace(text, chr(10), '')) + 1 as bigint) as line_count, doc_id
        from documents""",
    "v_kinds": """
        select p_type as repo, concat(split_part('src,node_modules,.github,dist,lib,Lib', ',', cast(p_partkey % 6 as int) + 1), '/',
            lower(replace(p_brand, '#', '')), '/p', cast(p_partkey as varchar(20)),
            split_part('.ts;.py;.GO;.rs;.svg;.lock;.md;;.JSON;.weird;.min.js;.test.tsx', ';', p_size % 12 + 1)) as path,
            cast(p_size * 25 as bigint) as line_count, cast(p_size * 100 as bigint) as size_bytes, p_partkey as part_id
        from part""",
    "v_pages": """
        select page_id, regexp_replace(url, '^https?://[^/]+/', '') as path, html from pages""",
    "v_source_line": """
        select repo, src as path, dst, case when dst like 'lib/%' then concat('import { x } from ', chr(39), '../../', dst, chr(39), ';')
            when dst = 'src/types.ts' then concat('import type { T } from ', chr(39), '../types', chr(39), ';')
            else concat('import ', chr(39), './', regexp_replace(dst, '^.*/', ''), chr(39), ';') end as line
        from v_edges where src like 'src/%'
        union all
        select repo, path, '~fs', concat('const fs = require(', chr(39), 'fs', chr(39), ');') from v_order""",
    "v_source": """
        select repo, path, 'TypeScript' as language, @join(line; chr(10); dst) as content from v_source_line group by repo, path""",
    "v_part_source": """
        select p_type as repo, concat('lib/p', cast(p_partkey as varchar(20)), '.ts') as path, 'TypeScript' as language,
            cast(p_partkey as varchar(20)) as k,
            concat('// export const hidden = 1;', chr(10), 'export const p', cast(p_partkey as varchar(20)), ' = ', cast(p_size as varchar(20)), ';', chr(10),
            'export class Part', cast(p_partkey as varchar(20)), ' {}', chr(10), 'export type T', cast(p_partkey as varchar(20)), ' = string;', chr(10),
            'export { make as make', cast(p_partkey as varchar(20)), ' };', chr(10), 'export { x as y', cast(p_partkey as varchar(20)), ' } from "./base";', chr(10),
            'export * from "./all";', chr(10), 'export default p', cast(p_partkey as varchar(20)), ';') as content
        from part""",
    # Statements that are easily misread: type arguments, declarations without semicolons, regular expressions with quotes in them.
    "v_tricky_source": """
        select p_type as repo, concat('lib/q', cast(p_partkey as varchar(20)), '.ts') as path, 'TypeScript' as language, cast(p_partkey as varchar(20)) as k,
            concat('export const m', cast(p_partkey as varchar(20)), ': Map<string, number> = new Map();', chr(10),
            'export const f', cast(p_partkey as varchar(20)), ' = <T, U>(a: T, b: U) => a;', chr(10),
            'export const a', cast(p_partkey as varchar(20)), ' = 1', chr(10), 'type P = Map<string, number>', chr(10),
            'const r = /', chr(96), '/g;', chr(10), 'import a from ', chr(39), './a', cast(p_partkey as varchar(20)), chr(39), chr(10),
            's.replace(/', chr(39), '/g, ""); const z = require(', chr(39), './z', cast(p_partkey as varchar(20)), chr(39), ')', chr(10),
            'export const { d', cast(p_partkey as varchar(20)), ', e: [g', cast(p_partkey as varchar(20)), '] } = x, h', cast(p_partkey as varchar(20)), ' = y / 2', chr(10)) as content
        from part""",
    "v_calls": """
        select event_id as call_id, ts as started_at, user_id % 3 + 1 as level, concat('task', cast(user_id as varchar(20))) as task_id,
            case when event_type in ('click', 'view') then 'model-a' else 'model-b' end as model,
            cast(round(value * 100) as bigint) as latency_ms, cast(regexp_extract(props, '([0-9]+)', 1) as bigint) * 10 as input_tokens,
            cast(regexp_extract(props, '([0-9]+)', 1) as bigint) as output_tokens
        from events""",
    "v_call_log": """
        select event_id, case when event_type = 'error' then 'setup' when event_id % 50 = 7 then 'Level99999999999 run' else concat('Level', cast(user_id % 3 + 1 as varchar(20)), ' run') end as level,
            case when event_type in ('click', 'view') then concat('File annotation for: src/u', cast(user_id as varchar(20)), '.ts ')
            else 'Structure detection' end as purpose
        from events""",
    "v_changes": """
        select repo, order_id, ordered_at, case status when 'O' then 'A' when 'F' then 'M' else 'D' end as status,
            case when priority = '1-URGENT' and status = 'O' then concat('hot', substr(path, 4)) else path end as path
        from v_order""",
    "v_change_lines": """
        select repo, case when priority = '4-NOT SPECIFIED' then concat('R100', chr(9), path, chr(9), replace(path, 'src/', 'app/'))
            when priority = '5-LOW' then concat('T', chr(9), path)
            when priority = '3-MEDIUM' then concat(status, chr(9), replace(path, '.ts', '.PNG'))
            else concat(case status when 'P' then 'D' when 'F' then 'M' else 'A' end, chr(9), path) end as line
        from v_order""",
    "v_heads": """
        select n_name as repo, concat('commit', cast(n_nationkey as varchar(20)), 'head') as current_commit,
            case when n_regionkey = 1 then concat('commit', cast(n_nationkey as varchar(20)), 'head')
            else concat('commit', cast(n_nationkey as varchar(20)), 'base') end as git_commit, n_regionkey
        from nation""",
    "v_versions": """
        select n_name as repo, cast(row_number() over (partition by c_nationkey order by c_custkey) as bigint) as map_version,
            lag(c_custkey) over (partition by c_nationkey order by c_custkey) as prev_key, c_custkey as commit_key,
            case when c_custkey % 3 = 0 then 'delta' else 'full' end as update_type,
            case when c_custkey % 4 = 0 then c_custkey % 90 end as files_changed, c_acctbal as balance
        from customer join nation on c_nationkey = n_nationkey""",
    "v_history": """
        select repo, map_version, case when prev_key is null and commit_key % 2 = 0 then cast(null as bigint)
            when commit_key % 7 = 0 then cast(null as bigint) when commit_key % 11 = 0 then map_version else map_version - 1 end as parent_version,
            update_type, files_changed, concat('k', cast(commit_key as varchar(20))) as git_commit, '1.0' as schema_version,
            timestamp '2024-01-01 00:00:00' as created_at, timestamp '2024-01-01 00:00:00' + interval '30' hour as last_updated
        from v_versions""",
    "v_responses": """
        select p_type as repo, concat('lib/p', cast(p_partkey as varchar(20)), '.ts') as path, p_partkey as part_id, p_name, p_brand,
            cast(p_size * 25 as bigint) as line_count,
            case when p_size = 13 then 'prose' when p_size = 17 then 'number' when p_size = 19 then 'newline' when p_size = 23 then 'no_exports'
                when p_size = 29 then 'mixed' when p_size = 31 then 'blank' when p_size = 37 then 'long' when p_size > 40 then 'bare' else 'fenced' end as kind,
            case when p_size = 13 then 'no json here'
                when p_size = 17 then '{"purpose": 5, "exports": []}'
                when p_size = 19 then concat('{"purpose": "', p_name, chr(10), 'x", "exports": [], "imports": ["./a.ts", "react"]}')
                when p_size = 23 then concat('{"purpose": "', p_name, '"}')
                when p_size = 29 then concat('{"purpose": "', p_name, '", "exports": ["a", 1]}')
                when p_size = 31 then '{"purpose": "  ", "exports": []}'
                when p_size = 37 then concat('{"purpose": "', repeat('word ', 50), '", "exports": []}')
                when p_size > 40 then concat('Here: {"purpose": "', p_name, '", "exports": ["', p_brand, '", "b"]} done')
                else concat('Sure:', chr(10), '```json', chr(10), '{"purpose": "', p_name, ' ", "exports": ["', p_brand, '", " "]}', chr(10), '```') end as response
        from part""",
    "v_structure_responses": """
        select s_name as repo, s_nationkey as n, concat('{"repo_name": "', s_name, '", "purpose": "', case when s_nationkey = 3 then ' ' else 'Sells' end,
            '", "stack": ', case when s_nationkey = 5 then '7' else '"SQL"' end, ', "languages": ', case when s_nationkey = 7 then '[]' else '["SQL", "Go"]' end,
            ', "entrypoints": ["main.go"], "modules": ', case when s_nationkey = 9 then '[{"path": "a"}]' else '[{"path": "a", "description": "b", "more": 1}]' end,
            ', "config_files": ', case when s_nationkey = 11 then '[1]' else '[]' end, ', "conventions": ["x"], "extra": ', case when s_nationkey = 13 then 'tru' else 'true' end, '}') as response
        from supplier""",
    "v_plan_responses": """
        select repo, cast(order_id as varchar(20)) as plan_id, status, priority, order_id, concat('{"tasks": ', case when priority = '5-LOW' then '[]' else
            concat('[{"scope": "src/', case when priority = '4-NOT SPECIFIED' then '' else 'c' end, cast(cust_id as varchar(20)), '/", "agent_size": "',
            case status when 'O' then 'small' when 'F' then 'medium' else 'huge' end, '", "estimated_files": ', cast(order_id % 60 as varchar(20)),
            '}, {"scope": "lib/", "agent_size": "large", "estimated_files": 12}]') end, ', "execution": "',
            case when priority = '1-URGENT' then 'random' else 'parallel' end, '", "estimated_total_minutes": 15}') as response
        from v_order""",
    "v_plan": """
        select cust_id as plan_id, concat('d', cast(order_id % 10 as varchar(20)), '/') as scope,
            case status when 'O' then 'small' when 'F' then 'medium' else 'large' end as agent_size,
            order_id % 60 as estimated_files, case when cust_id % 3 = 0 then 'sequential' when cust_id % 50 = 1 then 'random' else 'parallel' end as execution,
            cast(cust_id % 700 as double) as estimated_total_minutes
        from v_order""",
    "v_plan_files": "select c_custkey as plan_id, cast(c_custkey % 300 + 1 as bigint) as total_files from customer",
}

_JOIN = re.compile(r"@join\(([^;]+);([^;]+);([^@]+?)\) as ")


def in_duckdb(sql: str) -> str:
    return _JOIN.sub(lambda m: f"string_agg({m[1].strip()}, {m[2].strip()} order by {m[3].strip()}) as ", sql)


def in_spark(sql: str) -> str:
    return _JOIN.sub(lambda m: f"listagg({m[1].strip()}, {m[2].strip()}) within group (order by {m[3].strip()}) as ", sql)


def with_views(select: str, ctes: str = "", kept: str = "", tables: Collection[str] = ()) -> str:
    """The statement with the common table expressions of all views it mentions, directly or not.

    ``kept`` is the word that has DuckDB derive each of them once. Views among ``tables``
    are there as tables.
    """
    needed: list[str] = []

    def need(text: str) -> None:
        for name in re.findall(r"\bv_\w+", text):
            if name in VIEWS and name not in needed and name not in tables:
                need(VIEWS[name])
                needed.append(name)

    need(ctes + " " + select)
    parts = [f"{name} as {kept}({VIEWS[name]})" for name in dict.fromkeys(needed)]
    if ctes:
        parts.append(re.sub(r"(\b\w+ as )(\(\s*(?:select|values)\b)", rf"\1{kept}\2", ctes) if kept else ctes)
    return f"with recursive {', '.join(parts)} {select}" if parts else select


def _part_path() -> Column:
    return F.concat(F.lit("lib/"), F.col("_type"), F.lit("/p"), F.col("part_id").cast("string"), F.lit(".ts"))


# Corpus tables derived so far, by application, folder and name.
_DERIVED: dict[tuple[str, str, str], DataFrame] = {}


class Workspace:
    """The corpus over one folder of parquet tables.

    Files, edges and annotations are the operators' input tables. Spark derives
    them whole from the given tables, once per session, into the shared folder.
    """

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir.rstrip("/")

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def sql(self, select: str) -> DataFrame:
        """The statement over the given tables and, instead of ``STORED`` views, the tables derived for them."""
        text = in_spark(with_views(select, tables=STORED)).replace("with recursive", "with", 1)
        for name, of in STORED.items():
            if re.search(rf"\b{name}\b", text):
                of(self).createOrReplaceTempView(name)
        for name in TABLES:
            if re.search(rf"\b{name}\b", text):
                self.table(name).createOrReplaceTempView(name)
        return self.spark.sql(text)

    def view(self, name: str) -> DataFrame:
        return self.sql(f"select * from {name}")

    def derived(self, name: str, build: Callable[[], DataFrame]) -> DataFrame:
        key = (self.spark.sparkContext.applicationId, self.sf_dir, name)
        if key not in _DERIVED:
            table = build()
            _DERIVED[key] = table if hasattr(table, "scratch_path") else stored(table, name)
        return _DERIVED[key]

    def spent(self, name: str, *used_by: str) -> None:
        """Remove the table ``name`` once the tables worked out from it are there; it is derived anew if it is asked for again."""
        key = lambda n: (self.spark.sparkContext.applicationId, self.sf_dir, n)
        if key(name) in _DERIVED and all(key(n) in _DERIVED for n in used_by):
            discard(_DERIVED.pop(key(name)))

    def annotations(self) -> DataFrame:
        return self.derived("annotations", self._annotations)

    def _annotations(self) -> DataFrame:
        """Files with their import lists, sorted; a list is as long as its file has imports."""
        # Dealt out first: files have few imports, so that collecting before the shuffle only sorts them once more.
        dealt = self.edges().select("repo", F.col("src").alias("path"), "dst").repartition("repo", "path")
        imports = dealt.groupBy("repo", "path").agg(F.sort_array(F.collect_list("dst")).alias("imports"))
        empty = F.array().cast("array<string>")
        exports = F.when(F.col("export_list") == "", empty).otherwise(F.split("export_list", ","))
        return self.files().join(imports, ["repo", "path"], "left").select(
            "repo", "path", "language", "size_bytes", "line_count", "purpose", exports.alias("exports"), F.coalesce("imports", empty).alias("imports")
        )

    def lines(self) -> DataFrame:
        """(repo, cust_id, order_id, part_id, sold): the parts of every order by number; ``sold`` if a line of it was not returned."""
        return self.derived("lines", self._lines)

    def _lines(self) -> DataFrame:
        owners = self.sql("select o_orderkey as order_id, o_custkey as cust_id, n_name as repo from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey")
        lines = self.table("lineitem").select(
            F.col("l_orderkey").alias("order_id"), F.col("l_partkey").alias("part_id"), F.coalesce(F.col("l_returnflag") != "R", F.lit(False)).alias("sold"))
        return lines.join(owners, "order_id").groupBy("repo", "cust_id", "order_id", "part_id").agg(F.max("sold").alias("sold"))

    def part_files(self) -> DataFrame:
        """The rows of ``v_part_file``."""
        found = self.derived("part_files", self._part_files)
        self.spent("lines", "part_files", "edges")
        return found

    def _part_files(self) -> DataFrame:
        sold = self.lines().filter("sold").select("repo", "part_id")
        parts = self.table("part").select(F.col("p_partkey").alias("part_id"), F.lower("p_type").alias("_type"), "p_name", "p_size")
        found = sold.join(parts, "part_id").select("repo", "part_id", "_type", "p_name", "p_size").distinct()
        return found.select("repo", _part_path().alias("path"), "part_id", "p_name", "p_size")

    def files(self) -> DataFrame:
        return self.derived("files", lambda: self.sql(VIEWS["v_files"]))

    def order_edges(self) -> DataFrame:
        """(repo, src, dst, ahead): edges of order files to the types file and to each other; those of ``v_chain`` are ``ahead``.

        The paths name the customer, so an edge repeats within its customer only.
        """
        return self.derived("order_edges", self._order_edges)

    def _order_edges(self) -> DataFrame:
        chain = self.sql("""
            select cust_id, repo, path, lead(path) over (partition by cust_id order by order_id) as next_path,
                lead(status) over (partition by cust_id order by order_id) as next_status from v_order""")
        path, after = F.col("path"), F.col("next_path")
        edge = lambda src, dst, ahead: F.struct(src.alias("src"), dst.alias("dst"), F.lit(ahead).alias("ahead"))
        found = F.array_compact(F.array(
            edge(path, F.lit("src/types.ts"), False), F.when(after.isNotNull(), edge(path, after, True)),
            F.when(after.isNotNull() & (F.col("next_status") == "P"), edge(after, path, False))))
        rows = chain.select("cust_id", "repo", F.explode(found).alias("e")).select("cust_id", "repo", "e.*")
        return rows.groupBy("cust_id", "repo", "src", "dst").agg(F.max("ahead").alias("ahead")).drop("cust_id")

    def edges(self) -> DataFrame:
        found = self.derived("edges", self._edges)
        self.spent("lines", "part_files", "edges")
        self.spent("order_edges", "edges", "importers")
        return found

    def _edges(self) -> DataFrame:
        """The rows of ``v_edges``, each kind of edge without its own repeats.

        Edges to parts, from parts and between orders differ in their paths, so that no
        edge is of two kinds. Missing paths look alike: if there are any, all edges are compared.
        """
        types = self.table("part").select(F.col("p_partkey").alias("part_id"), F.lower("p_type").alias("_type")).distinct()
        order_path = F.concat(F.lit("src/c"), F.col("cust_id").cast("string"), F.lit("/o"), F.col("order_id").cast("string"), F.lit(".ts"))
        to_parts = self.lines().join(types, "part_id").select("repo", order_path.alias("src"), _part_path().alias("dst"))
        selfish = self.part_files().filter("p_size = 50").select("repo", F.col("path").alias("src"), F.col("path").alias("dst")).distinct()
        found = stored(to_parts.unionByName(self.order_edges().drop("ahead")).unionByName(selfish), "edges")
        if found.filter("repo is null or src is null or dst is null").isEmpty():
            return found
        return found.distinct()

    def gone(self) -> DataFrame:
        return self.derived("gone", lambda: self.sql(VIEWS["v_gone"]))

    def listing(self) -> DataFrame:
        return self.derived("listing", lambda: self.sql(VIEWS["v_listing"]))

    def imports(self) -> DataFrame:
        return self.edges().select("repo", F.col("src").alias("path"), F.col("dst").alias("target"))

    def graph(self) -> Graph:
        """The graph of all annotations, as it would be loaded from a stored map."""
        built = build_graph(self.annotations())
        # Import entries are a scan of the annotations, which are a table already.
        return Graph(self.derived("graph_nodes", lambda: built.nodes), built.imports, self.derived("graph_importers", lambda: built.importers))

    def stale_graph(self) -> Graph:
        return Graph(self.files().select("repo", "path"), self.imports(), self.importers())

    def importers(self) -> DataFrame:
        found = self.derived("importers", self._importers)
        self.spent("order_edges", "edges", "importers")
        return found

    def _importers(self) -> DataFrame:
        """The rows of ``v_importers``: targets are looked up once, whether they are there or missing."""
        known = self.files().select("repo", F.col("path").alias("dst"), F.lit(True).alias("_known")).distinct()
        looked_up = self.edges().join(known, ["repo", "dst"], "left")
        there, path, importer = F.col("_known").isNotNull(), F.col("dst"), F.col("src")
        named = looked_up.filter(~there | ~F.startswith(path, F.lit("lib/promo/"))).select(
            "repo", F.when(there, path).otherwise(importer).alias("path"), F.when(there, importer).otherwise(path).alias("importer"))
        following = self.order_edges().filter("ahead").select("repo", F.col("src").alias("path"), F.col("dst").alias("importer"))
        return named.unionByName(following).distinct()

    def meta(self) -> DataFrame:
        empty = F.array().cast("array<string>")
        return self.view("v_meta").select(
            "repo", "repo_name", "purpose", "stack", F.array(F.lit("TypeScript")).alias("languages"),
            F.array("entry").alias("entrypoints"),
            F.array(F.struct(F.lit("src").alias("path"), F.lit("Orders").alias("description")),
                    F.struct(F.lit("lib").alias("path"), F.lit("Parts").alias("description"))).alias("modules"),
            empty.alias("config_files"),
            F.when(F.col("convention_list") == "", empty).otherwise(F.split("convention_list", ";")).alias("conventions"),
        )


# Views Spark reads from tables that are derived once, where other views build on them.
STORED: dict[str, Callable[[Workspace], DataFrame]] = {
    "v_part_file": Workspace.part_files, "v_files": Workspace.files, "v_edges": Workspace.edges, "v_importers": Workspace.importers,
    "v_gone": Workspace.gone, "v_listing": Workspace.listing,
}
