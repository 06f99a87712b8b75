"""Queries over files: columns, filters, extraction and responses."""

from __future__ import annotations

from pyspark.sql import functions as F

from codeloom import constants as C
from codeloom.functions import paths, text
from codeloom.operators import calls, filters, harvest, ignore, imports, responses, symbols
from workload.registry import query
from workload.views import Workspace

# Pieces of SQL that several statements share.
EXT = r"regexp_extract(regexp_extract(path, '([^/]*)$', 1), '^.+(\.[^.]*)$', 1)"
DIR = "case when contains(path, '/') then regexp_extract(path, '^(.*)/[^/]*$', 1) else '.' end"


def _quoted(values: list[str]) -> str:
    return ", ".join(f"'{v}'" for v in values)


def contents(w: Workspace):
    return w.view("v_text").withColumnRenamed("text", "content")


# --- columns ---------------------------------------------------------------


@query("b1_path_parts", rf"""
    select repo, path, regexp_extract(path, '([^/]*)$', 1) as name, {EXT} as extension, {DIR} as dir, split_part(path, '/', 1) as top_dir
    from v_kinds""")
def path_parts(w):
    return paths.with_path_parts(w.view("v_kinds")).select("repo", "path", "name", "extension", "dir", "top_dir")


@query("b2_language", rf"""
    select repo, path, case lower({EXT}) when '.ts' then 'TypeScript' when '.tsx' then 'TypeScript' when '.js' then 'JavaScript'
        when '.py' then 'Python' when '.go' then 'Go' when '.rs' then 'Rust' when '.md' then 'Markdown' when '.json' then 'JSON' end as language
    from v_kinds""")
def language(w):
    return paths.with_language(w.view("v_kinds")).select("repo", "path", "language")


@query("b3_size", """
    select repo, path, line_count, cast(strlen(text) as bigint) as size_bytes, line_count > 10000 as is_oversized from v_text""")
def size(w):
    return paths.with_size(contents(w)).select("repo", "path", "line_count", "size_bytes", "is_oversized")


@query("b4_token_estimate", "select repo, path, cast(ceil(length(text) / 4.0) as bigint) as tokens from v_text")
def tokens(w):
    return paths.with_token_estimate(w.view("v_text"), "text").select("repo", "path", "tokens")


@query("b5_effective_loc", """
    select repo, path, least(line_count, 500) as effective_loc, line_count > 500 as trimmed from v_files""")
def effective_loc(w):
    return paths.with_effective_loc(w.files()).select("repo", "path", "effective_loc", "trimmed")


_TRUNCATED = """
    case when len(lines) <= 10 then text else array_to_string(list_concat(lines[1:7], ['',
        concat('... [TRUNCATED: ', cast(len(lines) - 10 as varchar), ' lines omitted] ...'), ''], lines[len(lines) - 2:]), chr(10)) end"""


@query("b6_truncate_content", f"""
    select repo, path, {_TRUNCATED} as content from (select *, string_split(text, chr(10)) as lines from v_text)""")
def truncate(w):
    return text.truncate_content(contents(w), max_lines=10).select("repo", "path", "content")


@query("b7_annotation_prompts", """
    select repo, path, prompt, cast(ceil(length(prompt) / 4.0) as bigint) as tokens from (
        select repo, path, concat('Describe one source file of a repository.', chr(10), chr(10), 'File: ', path, chr(10), 'Language: Markdown', chr(10),
            'Lines: ', cast(line_count as varchar), chr(10), chr(10), '```markdown', chr(10), text, chr(10), '```', chr(10), chr(10),
            'Answer with JSON only: {"purpose": one sentence of at most 200 characters, "exports": [names the file exports]}') as prompt
        from v_text)""")
def prompts(w):
    return text.annotation_prompts(paths.with_language(contents(w)))


@query("b8_classify_files", rf"""
    select repo, path, regexp_matches(path, 'test|spec|__tests__') as is_test,
        regexp_matches(lower(path), 'config|test|\.json|\.yaml|\.yml|\.md|\.env') as is_config_or_test,
        regexp_matches(lower(path), '(^|\.)(ts|tsx|js|jsx|py|go|rs|java)$') and line_count > 100 as is_complex, line_count > 300 as is_large
    from v_kinds""")
def classify(w):
    return paths.classify_files(w.view("v_kinds")).select("repo", "path", "is_test", "is_config_or_test", "is_complex", "is_large")


@query("b9_call_keys", """
    select event_id, case when level like 'Level99%' then 0 when level like 'Level%' then cast(substr(level, 6, 1) as int) else 0 end as level_number,
        case when contains(purpose, 'for:') then trim(substr(purpose, 22)) end as task_id from v_call_log""")
def call_keys(w):
    return calls.call_keys(w.view("v_call_log")).select("event_id", "level_number", "task_id")


@query("b10_metric_labels", """
    select call_id, case when duration_ms >= 60000 then concat(cast(duration_ms // 60000 as varchar), 'm ', cast(duration_ms // 1000 % 60 as varchar), 's')
            else concat(cast(duration_ms // 1000 as varchar), 's') end as duration_label,
        case when latency_ms < 1000 then concat(cast(latency_ms as varchar), 'ms')
            when latency_ms < 60000 then concat(cast(cast(round(cast(latency_ms as decimal(18,3)) / 1000, 1) as decimal(18,1)) as varchar), 's')
            else concat(cast(latency_ms // 60000 as varchar), 'm ', cast((latency_ms % 60000 + 500) // 1000 as varchar), 's') end as latency_label,
        concat('$', cast(cast(round(cast(cost as decimal(18,6)), 2) as decimal(18,2)) as varchar)) as cost_label,
        format('{:,}', tokens) as tokens_label, concat(cast(cast(floor(speed + 0.5) as bigint) as varchar), ' tok/s') as speed_label
    from labelled""", """
    labelled as (select call_id, latency_ms * 50 as duration_ms, latency_ms * 5 as latency_ms, input_tokens * 100 as tokens,
        input_tokens / 100.0 as cost, output_tokens / 8.0 as speed from v_calls)""")
def metric_labels(w):
    rows = w.view("v_calls").select(
        "call_id", (F.col("latency_ms") * 50).alias("duration_ms"), (F.col("latency_ms") * 5).alias("latency_ms"),
        (F.col("input_tokens") * 100).alias("tokens"), (F.col("input_tokens") / 100).alias("cost"),
        (F.col("output_tokens") / 8).alias("tokens_per_second"),
    )
    return calls.metric_labels(rows).select("call_id", "duration_label", "latency_label", "cost_label", "tokens_label", "speed_label")


PRICES = {"model-a": (0.25, 1.25), "model-b": (3.0, 15.0)}
COST = """(case model when 'model-a' then input_tokens / 1e6 * 0.25 + output_tokens / 1e6 * 1.25
    when 'model-b' then input_tokens / 1e6 * 3.0 + output_tokens / 1e6 * 15.0 else 0 end)"""


@query("b11_call_speed", f"""
    select call_id, round(case when latency_ms > 0 then output_tokens / latency_ms * 1000 else 0 end, 6) as tokens_per_second,
        round({COST}, 8) as cost from v_calls""")
def call_speed(w):
    return calls.call_speed(w.view("v_calls"), PRICES).select(
        "call_id", F.round("tokens_per_second", 6).alias("tokens_per_second"), F.round("cost", 8).alias("cost"))


# --- filters ---------------------------------------------------------------


@query("c1_filter_skipped_dirs", f"""
    select repo, path from v_kinds where not split_part(path, '/', 1) in ({_quoted(C.SKIPPED_DIRS)}) and not path like '.%'""")
def skipped_dirs(w):
    return filters.filter_skipped_dirs(w.view("v_kinds")).select("repo", "path")


@query("c2_filter_binary_ext", f"select repo, path from v_kinds where not lower({EXT}) in ({_quoted(C.BINARY_EXTENSIONS)})")
def binary_ext(w):
    return filters.filter_binary_ext(w.view("v_kinds")).select("repo", "path")


@query("c3_filter_binary_content", """
    select repo, path, cast(strlen(text) + case when lang = 'fr' then 1 else 0 end as bigint) as bytes from v_text
    where lang <> 'de' and (lang <> 'fr' or strlen(text) >= 8192)""")
def binary_content(w):
    # A NUL in front of German texts and behind French ones: only the first is always inside the probe.
    nul = F.lit("\0")
    marked = F.when(F.col("lang") == "de", F.concat(nul, F.col("text"))).when(F.col("lang") == "fr", F.concat("text", nul)).otherwise(F.col("text"))
    rows = w.view("v_text").withColumn("content", F.encode(marked, "UTF-8"))
    return filters.filter_binary_content(rows).select("repo", "path", F.octet_length("content").cast("bigint").alias("bytes"))


PATTERNS = ["# generated", "*.SVG", "node_modules/", "/lib/", "", "*.md", "!p1*.md", "src/**/p2?.ts"]
IGNORED = r"""regexp_matches(path, '(?i)^lib/') or path like 'node_modules/%' or path ilike '%.svg'
    or (path ilike '%.md' and not regexp_matches(path, '(?i)/p1[^/]*\.md$')) or regexp_matches(path, '(?i)^src/(.*/)?p2[^/]\.ts$')"""


@query("c4_filter_ignored", f"select repo, path from v_kinds where not ({IGNORED})")
def ignored(w):
    return ignore.filter_ignored(w.view("v_kinds"), PATTERNS).select("repo", "path")


@query("c4_filter_ignored_defaults", r"""
    select repo, path from v_kinds where not regexp_matches(path, '(?i)^(node_modules|dist)/') and not path ilike '%.min.js'""")
def ignored_defaults(w):
    return ignore.filter_ignored(w.view("v_kinds"), [], defaults=True).select("repo", "path")


@query("c4_filter_ignored_by_repo", r"""
    select repo, path from v_kinds where not (case when repo = 'PROMO' then path ilike '%.md' and not regexp_matches(path, '(?i)/p1[^/]*\.md$')
        when repo = 'ECONOMY' then path like 'src/%' else false end)""")
def ignored_by_repo(w):
    repos = w.table("part").select(F.col("p_type").alias("repo")).distinct()
    rules = repos.select("repo", F.when(F.col("repo") == "PROMO", F.array(F.lit("*.md"), F.lit("!p1*.md")))
                         .when(F.col("repo") == "ECONOMY", F.array(F.lit("src/"), F.lit("!src/*"))).otherwise(F.array(F.lit("# none"))).alias("p"))
    return ignore.filter_ignored_by_repo(w.view("v_kinds"), rules.select("repo", F.posexplode("p").alias("position", "pattern"))).select("repo", "path")


@query("c5_ignore_stats", f"""
    select repo, count(*) as total_checked, count(*) filter ({IGNORED}) as ignored_count, count(*) filter (not ({IGNORED})) as passed_count,
        cast(floor(count(*) filter ({IGNORED}) * 100.0 / count(*) + 0.5) as bigint) as ignored_percent
    from v_kinds group by repo""")
def ignore_stats(w):
    return ignore.ignore_stats(w.view("v_kinds"), PATTERNS)


@query("c6_filter_change_noise", f"""
    select repo, path from v_kinds where not regexp_matches(path, '(^|/)(node_modules|\\.git|\\.repo_map|dist|build|coverage)/')
        and not lower({EXT}) in ({_quoted(C.CHANGE_SKIPPED_EXTENSIONS)})""")
def change_noise(w):
    return filters.filter_change_noise(w.view("v_kinds")).select("repo", "path")


@query("c7_filter_by_path", """
    select q.query_id, f.repo, f.path from q join v_files f on q.repo = f.repo and (f.path = q.prefix
        or starts_with(f.path, case when ends_with(q.prefix, '/') then q.prefix else concat(q.prefix, '/') end))""", """
    q as (select c_custkey as query_id, n_name as repo, concat('src/c', cast(c_custkey as varchar), case when c_mktsegment = 'MACHINERY' then '/' else '' end) as prefix
        from customer join nation on c_nationkey = n_nationkey
        union all select order_id + 1000000000, repo, path from v_order where status = 'F')""")
def by_path(w):
    wanted = w.sql("""
        select c_custkey as query_id, n_name as repo, concat('src/c', cast(c_custkey as varchar(20)), case when c_mktsegment = 'MACHINERY' then '/' else '' end) as prefix
        from customer join nation on c_nationkey = n_nationkey
        union all select order_id + 1000000000, repo, path from v_order where status = 'F'""")
    return filters.match_prefixes(wanted, w.files().select("repo", "path")).select("query_id", "repo", "path")


@query("c8_find_by_path", """
    select order_id as query_id, f.repo, f.path, f.line_count from v_order o join v_files f on o.repo = f.repo and o.path = f.path""")
def find(w):
    wanted = w.view("v_order").withColumnRenamed("order_id", "query_id")
    return filters.find_paths(wanted, w.files()).select("query_id", "repo", "path", "line_count")


@query("c9_subset_files", """
    select repo, count(*) as total_files, cast(sum(size_bytes) as bigint) as total_size_bytes from v_files f
    where exists (select 1 from v_changes c where c.repo = f.repo and c.path = f.path and c.status <> 'D') group by repo""")
def subset(w):
    changed = w.view("v_changes").filter(F.col("status") != "D")
    return filters.subset_files(w.files(), changed)[1]


# --- extraction ------------------------------------------------------------


@query("d1_extract_imports", r"""
    select repo, path, array_to_string(list_concat(regexp_extract_all(content, 'import\s+[^''"]+?\s+from\s+[''"]([^''"]+)[''"]', 1),
        regexp_extract_all(content, 'import\s+[''"]([^''"]+)[''"]', 1), regexp_extract_all(content, 'require\s*\(\s*[''"]([^''"]+)[''"]\s*\)', 1)), '|') as raw_imports
    from v_source""")
def extract(w):
    return imports.extract_imports(w.derived("source", lambda: w.view("v_source"))).select("repo", "path", F.array_join("raw_imports", "|").alias("raw_imports"))


_SOURCE = """case when dst = '~fs' then 'fs' when dst like 'lib/%' then concat('../../', dst) when dst = 'src/types.ts' then '../types'
    else concat('./', regexp_replace(dst, '^.*/', '')) end"""


@query("d1_raw_imports", f"select repo, path, string_agg({_SOURCE}, '|' order by dst) as raw_imports from v_source_line group by repo, path")
def raw(w):
    rows = symbols.raw_imports(w.derived("source", lambda: w.view("v_source")))
    return rows.select("repo", "path", F.array_join("raw_imports", "|").alias("raw_imports"))


@query("d2_symbol_imports", r"""
    select repo, path, cast(row_number() over (partition by repo, path order by dst) as int) as line, case when dst = '~fs' then 'require'
        when dst = 'src/types.ts' then 'type-only' else 'static' end as type, dst like 'src/c%' as is_side_effect,
        case when dst = '~fs' then 'fs' when dst like 'lib/%' then concat('../../', dst) when dst = 'src/types.ts' then '../types'
            else concat('./', regexp_replace(dst, '^.*/', '')) end as source,
        case when dst like 'lib/%' then 'x' when dst = 'src/types.ts' then 'T' else '' end as names
    from v_source_line""")
def symbol_imports(w):
    return symbols.symbol_imports(w.derived("source", lambda: w.view("v_source"))).select(
        "repo", "path", "line", "type", "is_side_effect", "source",
        F.coalesce(F.array_join("named_imports", ","), F.lit("")).alias("names"))


@query("d3_symbol_exports", """
    select repo, path, symbol, kind from v_part_source, lateral (select unnest([concat('p', k), concat('Part', k), concat('T', k), concat('make', k), 'default']) as symbol,
        unnest(['variable', 'class', 'type', 'list', 'default']) as kind)""")
def symbol_exports(w):
    return symbols.symbol_exports(w.view("v_part_source")).select("repo", "path", "symbol", "kind")


@query("d3_symbol_exports_tricky", "select repo, path, concat(unnest(['m', 'f', 'a', 'd', 'g', 'h']), k) as symbol, 'variable' as kind from v_tricky_source")
def tricky_exports(w):
    return symbols.symbol_exports(w.view("v_tricky_source")).select("repo", "path", "symbol", "kind")


@query("d2_symbol_imports_tricky", "select repo, path, concat(unnest(['./a', './z']), k) as source, unnest([6, 7])::int as line from v_tricky_source")
def tricky_imports(w):
    return symbols.symbol_imports(w.view("v_tricky_source")).select("repo", "path", "source", "line")


@query("d4_re_exports", """
    select repo, path, concat('y', k) as symbol, './base' as source from v_part_source
    union all select repo, path, '*', './all' from v_part_source""")
def re_exports(w):
    return symbols.re_exports(w.view("v_part_source")).select("repo", "path", "symbol", "source")


@query("d5_register_extractor", r"""
    select repo, path, len(list_distinct(regexp_extract_all(text, '([0-9]+)', 1))) as sources from v_text""")
def registered(w):
    rows = contents(w).withColumn("language", F.lit("Numbers"))
    found = imports.extract_imports(rows, imports.with_extractor("Numbers", ["([0-9]+)"]))
    return found.select("repo", "path", F.size("raw_imports").cast("bigint").alias("sources"))


@query("d5_own_patterns_for_scripts", r"""
    select repo, path, len(list_distinct(regexp_extract_all(text, '([0-9]+)', 1))) as sources from v_text""")
def own_patterns(w):
    rows = contents(w).withColumn("language", F.lit("TypeScript"))
    found = symbols.raw_imports(rows, imports.with_extractor("TypeScript", ["([0-9]+)"]))
    return found.select("repo", "path", F.size("raw_imports").cast("bigint").alias("sources"))


_RAW = """case when dst = '~fs' then 'node:fs' when dst like 'lib/%' then concat('../../', dst) when dst = 'src/types.ts' then '@scope/types'
    else concat('./', regexp_replace(dst, '^.*/', '')) end"""


@query("d6_filter_internal", f"""
    select repo, path, string_agg({_RAW}, '|' order by dst) as imports from v_source_line
    where dst <> '~fs' and dst <> 'src/types.ts' group by repo, path""")
def internal(w):
    rows = w.view("v_source_line").withColumn("s", F.expr(_RAW)).groupBy("repo", "path").agg(
        F.sort_array(F.collect_list(F.struct("dst", "s"))).alias("raw"))
    kept = imports.filter_internal(rows.withColumn("raw_imports", F.col("raw.s")))
    return kept.filter(F.size("raw_imports") > 0).select("repo", "path", F.array_join("raw_imports", "|").alias("imports"))


@query("d7_resolve_imports", r"""
    select repo, path, string_agg(regexp_replace(dst, '\.ts$', ''), '|' order by dst like 'src/c%', dst) as imports
    from v_source_line where dst <> '~fs' group by repo, path""")
def resolve(w):
    found = imports.extract_imports(w.derived("source", lambda: w.view("v_source")))
    return imports.resolve_imports(found).select("repo", "path", F.array_join("imports", "|").alias("imports"))


@query("d8_resolve_targets_exact", """
    select e.repo, src as path, dst as target, f.path as resolved from v_edges e left join v_files f on e.repo = f.repo and e.dst = f.path""")
def resolve_exact(w):
    return imports.resolve_targets(w.imports(), w.files())


@query("d8_resolve_targets_extensions", r"""
    select e.repo, src as path, regexp_replace(dst, '\.ts$', '') as target, f.path as resolved
    from v_edges e left join v_files f on e.repo = f.repo and e.dst = f.path""")
def resolve_extensions(w):
    bare = w.imports().withColumn("target", imports.without_code_extension(F.col("target")))
    return imports.resolve_targets(bare, w.files(), mode="extensions")


@query("d9_extract_json", r"""
    select repo, path, case when kind = 'fenced' then concat('{"purpose": "', p_name, ' ", "exports": ["', p_brand, '", " "]}')
        when kind = 'bare' then concat('{"purpose": "', p_name, '", "exports": ["', p_brand, '", "b"]}') else response end as json_text
    from v_responses""")
def extract_json(w):
    return responses.extract_json(w.view("v_responses")).select("repo", "path", "json_text")


@query("d10_parse_responses", """
    select repo, path, kind <> 'prose' as parsed, case when kind = 'prose' then 'no json here' else '' end as preview from v_responses""")
def parse(w):
    ok, rejected = responses.parse_responses(w.view("v_responses"))
    return ok.select("repo", "path", F.lit(True).alias("parsed"), F.lit("").alias("preview")).unionByName(
        rejected.select("repo", "path", F.lit(False).alias("parsed"), "preview"))


def _answered(w: Workspace):
    files = w.view("v_responses").filter("part_id % 10 <> 3").select(
        "repo", "path", F.lit("TypeScript").alias("language"), F.lit(1).cast("bigint").alias("size_bytes"), "line_count",
        F.when(F.col("kind") == "bare", F.array(F.lit("./b.ts"), F.lit("fs"))).alias("raw_imports"))
    # Some answers name no file, some come twice, the second one with other exports.
    again = w.view("v_responses").filter("part_id % 10 = 4 and kind = 'fenced'").withColumn("response", F.replace("response", F.lit('"exports": ["'), F.lit('"exports": ["~')))
    answers = w.view("v_responses").unionByName(again).select("repo", "path", "response")
    return files, *responses.annotations_from_responses(files, answers)


@query("d11_annotations_from_responses", """
    select repo, path, 'TypeScript' as language, line_count, case kind when 'newline' then concat(p_name, chr(10), 'x')
            when 'long' then concat(substr(repeat('word ', 50), 1, 197), '...') else p_name end as purpose,
        case kind when 'fenced' then p_brand when 'bare' then concat(p_brand, '|b') else '' end as exports,
        case kind when 'newline' then 'lib/a' when 'bare' then 'lib/b' else '' end as imports
    from v_responses where kind in ('newline', 'long', 'fenced', 'bare') and part_id % 10 <> 3""")
def annotations(w):
    return _answered(w)[1].select(
        "repo", "path", "language", "line_count", "purpose", F.array_join("exports", "|").alias("exports"), F.array_join("imports", "|").alias("imports"))


@query("d11_rejected_responses", """
    select repo, path, case when kind = 'prose' then 'Failed to parse JSON response' when part_id % 10 = 3 then 'No such file'
        when kind = 'no_exports' then 'Field "exports" must be an array' when kind = 'mixed' then 'All exports must be strings' else 'Field "purpose" must be a non-empty string' end as reason
    from v_responses where part_id % 10 = 3 or kind in ('prose', 'number', 'no_exports', 'mixed', 'blank')
    union all select repo, path, 'File answered before' from v_responses where part_id % 10 = 4 and kind = 'fenced'""")
def rejected_annotations(w):
    return _answered(w)[2].select("repo", "path", "reason")


@query("d11_unanswered_files", "select repo, path from v_responses where part_id % 10 <> 3 and kind not in ('newline', 'long', 'fenced', 'bare')")
def unanswered(w):
    files, accepted, _ = _answered(w)
    return responses.unanswered_files(files, accepted)


@query("d12_structure_from_responses", """
    select repo, case n when 3 then 'Missing or invalid field: purpose (must be non-empty string)' when 5 then 'Missing or invalid field: stack (must be non-empty string)'
            when 7 then 'Field "languages" must contain at least one language' when 9 then 'Field "modules" must be an array of {path, description} objects'
            when 11 then 'Field "config_files" must be an array of strings' when 13 then 'Failed to parse JSON response' else 'ok' end as outcome,
        case when n in (3, 5, 7, 9, 11, 13) then '' else 'SQL,Go a:b' end as detail
    from v_structure_responses""")
def structure(w):
    ok, rejected = responses.structure_from_responses(w.view("v_structure_responses"))
    module = F.get("modules", F.lit(0))
    detail = F.concat(F.array_join("languages", ","), F.lit(" "), module["path"], F.lit(":"), module["description"])
    return ok.select("repo", F.lit("ok").alias("outcome"), detail.alias("detail")).unionByName(
        rejected.select("repo", F.col("reason").alias("outcome"), F.lit("").alias("detail")))


_PLAN_REASON = """case when priority = '5-LOW' then 'Field "tasks" must contain at least one task'
    when status = 'P' then 'Task agent_size must be "small", "medium", or "large"'
    when order_id % 60 < 1 then 'Task estimated_files must be a positive number' when order_id % 60 > 50 then 'Task estimated_files exceeds maximum'
    when priority = '1-URGENT' then 'Field "execution" must be "parallel" or "sequential"' else 'ok' end"""


@query("d13_plan_from_responses", f"""
    select r.repo, plan_id, reason, case when reason = 'ok' then scope else '' end as scope,
        case when reason = 'ok' then n else 0 end as estimated_files, reason = 'ok' and abs(order_id % 60 + 12 - files) * 1.0 / files > 0.1 as deviates
    from (select *, {_PLAN_REASON} as reason from v_plan_responses) r join counts on counts.repo = r.repo,
        lateral (select unnest([regexp_extract(response, '"scope": "([^"]*)"', 1), 'lib/']) as scope,
            unnest([cast(order_id % 60 as double), 12.0]) as n, unnest([0, 1]) as i)
    where reason = 'ok' or i = 0""", "counts as (select repo, count(*) as files from v_files group by repo)")
def plan(w):
    ok, rejected = responses.plan_from_responses(w.view("v_plan_responses"), w.files())
    return ok.select("repo", "plan_id", F.lit("ok").alias("reason"), "scope", "estimated_files", "deviates").unionByName(
        rejected.select("repo", "plan_id", "reason", F.lit("").alias("scope"), F.lit(0.0).alias("estimated_files"), F.lit(False).alias("deviates")))


# --- totals and texts ------------------------------------------------------


def sized_texts(w: Workspace):
    return paths.with_language(paths.with_size(contents(w))).select("repo", "path", "size_bytes", "line_count", "language", "content")


@query("g1_harvest_totals", """
    select repo, count(*) as total_files, cast(sum(strlen(text)) as bigint) as total_size_bytes from v_text group by repo""")
def totals(w):
    return harvest.harvest_totals(sized_texts(w))


@query("g2_directory_groups", f"""
    select repo, {DIR} as dir, count(*) as total_files, round(sum(strlen(text)) / 1024, 6) as total_kb from v_text group by all""")
def groups(w):
    return harvest.directory_groups(sized_texts(w)).withColumn("total_kb", F.round("total_kb", 6))


@query("g2_directory_members", f"""
    select repo, {DIR} as dir, regexp_extract(path, '([^/]*)$', 1) as name, cast(strlen(text) as bigint) as size_bytes from v_text""")
def members(w):
    return harvest.directory_members(sized_texts(w)).select("repo", "dir", "name", "size_bytes")


_KB = "cast(cast(round(cast({0} as decimal(28,10)) / 1024, 1) as decimal(18,1)) as varchar)"


@query("g3_directory_listing", f"""
    select repo, dir, concat(dir, '/ (', cast(count(*) as varchar), ' files, ', {_KB.format('sum(bytes)')}, ' KB)', chr(10),
        string_agg(concat('  - ', name, ' [Markdown]', chr(10)), '' order by name) filter (n <= 3),
        case when count(*) > 3 then concat('  ... and ', cast(count(*) - 3 as varchar), ' more files', chr(10)) else '' end) as listing
    from m group by repo, dir""", f"""
    m as (select repo, {DIR} as dir, regexp_extract(path, '([^/]*)$', 1) as name, strlen(text) as bytes,
        row_number() over (partition by repo, {DIR} order by regexp_extract(path, '([^/]*)$', 1)) as n from v_text)""")
def listing(w):
    return harvest.directory_listing(sized_texts(w), n=3)


@query("g4_file_tree", f"""
    select distinct repo, {DIR} as dir, '' as name, concat({DIR}, '/') as line from v_text
    union all select repo, {DIR}, regexp_extract(path, '([^/]*)$', 1),
        concat('  ', regexp_extract(path, '([^/]*)$', 1), ' [Markdown] (', {_KB.format('strlen(text)')}, ' KB)') from v_text""")
def tree(w):
    return harvest.file_tree(sized_texts(w))


@query("g5_repo_names", """
    select concat('org/', s_name) as repo, case when s_nationkey % 3 = 0 then concat('@shop/', s_name) else s_name end as repo_name from supplier""")
def names(w):
    base = w.table("supplier").select(F.concat(F.lit("org/"), "s_name").alias("repo"), "s_name", "s_nationkey")
    third = F.col("s_nationkey") % 3
    body = F.when(third == 0, F.concat(F.lit('{"name": "@shop/'), "s_name", F.lit('"}'))).when(third == 1, F.lit('{"name": ""}')).otherwise(F.lit("{broken"))
    packages = base.select("repo", F.lit("package.json").alias("path"), body.alias("content"))
    nested = base.select("repo", F.lit("web/package.json").alias("path"), F.lit('{"name": "nested"}').alias("content"))
    return harvest.repo_names(packages.unionByName(nested))
