"""Queries that write to the shared folder and read back: sources, sinks and streams."""

from __future__ import annotations

from pyarrow import fs
from pyspark.sql import functions as F

from codeloom.functions import paths
from codeloom.operators import checks
from codeloom.operators import graph as G
from codeloom.operators import harvest
from codeloom.session import scratch_path
from codeloom.sources import buckets, contracts, files, logs, maps
from codeloom.streaming import streams
from workload.q_calls import append_in_time
from workload.q_graph import CLEAN, LISTED, MERGED, updated
from workload.registry import query
from workload.views import Workspace


def joined(df, *names: str):
    return df.withColumns({n: F.array_join(n, "|") for n in names})


_ANNOTATIONS = """select f.repo, f.path, f.line_count, replace(f.export_list, ',', '|') as exports, coalesce(i.l, '') as imports from v_files f
    left join (select repo, src, string_agg(dst, '|' order by dst) as l from v_edges group by all) i on i.repo = f.repo and i.src = f.path"""


def shown(annotations):
    return joined(annotations, "exports", "imports").select("repo", "path", "line_count", "exports", "imports")


@query("a1_scan_files", """
    select lang as repo, concat(cast(doc_id // 100 as varchar), repeat('/n', cast(doc_id % 30 as int)), '/_doc', cast(doc_id as varchar), '.md') as path,
        cast(case when lang = 'fr' then length(text) else strlen(text) end as bigint) as size_bytes, line_count from v_text""")
def scan(w):
    """Every document as a text file of its language's folder, scanned back as one repository per folder.

    Files lie up to thirty folders deep; French ones are Latin-1, so not UTF-8.
    """
    base = scratch_path(w.spark, "scan")

    def write(batches):
        for batch in batches:
            for lang, doc_id, text in batch.itertuples(index=False):
                system, root = fs.FileSystem.from_uri(base)
                folder = f"{root}/lang={lang}/{doc_id // 100}" + "/n" * (doc_id % 30)
                system.create_dir(folder, recursive=True)
                with system.open_output_stream(f"{folder}/_doc{doc_id}.md") as stream:
                    stream.write(text.encode("latin-1", "replace") if lang == "fr" else text.encode())
            yield batch[["doc_id"]]

    w.view("v_text").select("lang", "doc_id", "text").mapInPandas(write, "doc_id bigint").write.format("noop").mode("overwrite").save()
    roots = w.table("documents").select(F.col("lang").alias("repo"), F.concat(F.lit(f"{base}/lang="), "lang").alias("root")).distinct()
    return files.harvest(w.spark, roots).select("repo", "path", "size_bytes", "line_count")


def meta_rows(w: Workspace):
    return w.meta().select(
        "repo", F.lit("1.0").alias("schema_version"), F.lit(1).cast("bigint").alias("map_version"), F.lit("abc").alias("git_commit"),
        F.lit("2024-01-01T00:00:00Z").alias("created_at"), F.lit("2024-01-01T00:00:00Z").alias("last_updated"),
        F.lit(None).cast("bigint").alias("parent_version"), F.lit("full").alias("update_type"), F.lit(None).cast("bigint").alias("files_changed"),
        "repo_name", "purpose", "stack", "languages", "entrypoints", "modules", "config_files", "conventions")


def written_map(w: Workspace):
    base = scratch_path(w.spark, "map")
    annotations = w.annotations()
    stats = harvest.harvest_totals(annotations)
    maps.write_map(annotations, w.graph(), meta_rows(w), stats, checks.missing_imports(annotations), base)
    return maps.read_tables(w.spark, base)


def documents(w: Workspace) -> str:
    base = scratch_path(w.spark, "documents")
    maps.write_documents(w.annotations(), w.graph(), meta_rows(w), base)
    return base


@query("a2_read_map", f"{LISTED} union all select repo, 'meta', concat(repo_name, ' ', purpose), convention_list from v_meta", CLEAN)
def map_documents(w):
    stored = maps.read_map(w.spark, f"{documents(w)}/*")
    meta = stored.meta.select("repo", F.lit("meta").alias("path"), F.concat("repo_name", F.lit(" "), "purpose").alias("direction"), F.array_join("conventions", ";").alias("other"))
    return G.listed(stored.graph).unionByName(meta)


@query("a2_read_map_annotations", _ANNOTATIONS)
def map_document_annotations(w):
    return shown(maps.read_map(w.spark, f"{documents(w)}/*", check=False).annotations)


@query("a3_read_tree_documents", _ANNOTATIONS)
def tree_documents(w):
    return shown(maps.read_all_tree_documents(w.spark, documents(w)))


@query("a6_write_map", f"{_ANNOTATIONS}")
def map_annotations(w):
    return shown(written_map(w).annotations)


@query("a2_read_map_graph", """
    select repo, src as path, 'imports' as direction, dst as other from v_edges
    union all select e.repo, e.dst, 'imported_by', e.src from v_edges e join v_files f on e.repo = f.repo and e.dst = f.path""")
def map_graph(w):
    return G.entries(written_map(w).graph)


@query("a7_write_tree", _ANNOTATIONS)
def tree(w):
    base = scratch_path(w.spark, "tree")
    maps.write_tree(w.annotations(), base)
    return shown(maps.read_tree(w.spark, base))


@query("a3_read_tree", "select repo, path, case when contains(path, '/') then split_part(path, '/', 1) else '.' end as top_dir, line_count from v_files")
def read_tree(w):
    base = scratch_path(w.spark, "tree")
    maps.write_tree(w.annotations(), base)
    return paths.with_path_parts(maps.read_tree(w.spark, base)).select("repo", "path", "top_dir", "line_count")


@query("a4_read_jsonl", """
    select 'good' as row, repo, path from v_files union all select 'bad', '', concat('{"repo": "', repo, '", "path": "', path) from v_gone""")
def jsonl(w):
    base = scratch_path(w.spark, "jsonl")
    logs.append_jsonl(w.annotations(), base)
    # Lines cut off in the middle, as an interrupted writer leaves them.
    w.view("v_gone").select(F.concat(F.lit('{"repo": "'), "repo", F.lit('", "path": "'), "path")).write.mode("append").text(base)
    good, bad = logs.read_jsonl(w.spark, base)
    return good.select(F.lit("good").alias("row"), "repo", "path").unionByName(bad.select(F.lit("bad").alias("row"), F.lit("").alias("repo"), F.col("line").alias("path")))


@query("a5_compact_jsonl", f"{_ANNOTATIONS}")
def compact(w):
    base, out = scratch_path(w.spark, "jsonl"), scratch_path(w.spark, "compacted")
    rows = w.annotations()
    logs.append_jsonl(rows.filter(F.startswith("path", F.lit("src/"))), base)
    logs.append_jsonl(rows.filter(~F.startswith("path", F.lit("src/"))), base)
    logs.compact_jsonl(w.spark, base, out)
    return shown(logs.read_jsonl(w.spark, out)[0])


@query("a5_count_jsonl", "select repo, count(*) as lines from v_files group by repo")
def count_lines(w):
    """Rows and an empty batch, appended per repository; blank lines between them don't count."""
    base = scratch_path(w.spark, "counted")
    rows = w.annotations()
    logs.append_jsonl(rows.limit(0), base)
    rows.select("repo", F.to_json(F.struct("path", "purpose")).alias("line")).select("repo", F.concat("line", F.lit("\n"))).write.partitionBy("repo").mode("append").text(base)
    counted = logs.count_jsonl_by_repo(w.spark, base)
    assert counted.agg(F.sum("lines")).first()[0] == logs.count_jsonl(w.spark, base)
    return counted


@query("a8_read_change_log", "select repo, line from v_change_lines")
def change_log(w):
    base = scratch_path(w.spark, "changes")
    # Blank lines lie between the entries.
    w.view("v_change_lines").select("repo", F.concat("line", F.lit("\n"))).write.partitionBy("repo").text(base)
    return logs.read_change_logs(w.spark, base)


@query("a9_read_call_log", """
    select started_at, concat('level', cast(level as varchar)) as level, model, concat('call ', cast(call_id as varchar)) as purpose, input_tokens,
        case when output_tokens > 50 then output_tokens end as output_tokens from v_calls""")
def call_log(w):
    base = scratch_path(w.spark, "calls")
    rows = w.view("v_calls").select(
        F.col("started_at").cast("timestamp").alias("timestamp"), F.concat(F.lit("level"), F.col("level").cast("string")).alias("level"), "model",
        F.concat(F.lit("call "), F.col("call_id").cast("string")).alias("purpose"), F.col("input_tokens").alias("inputTokens"),
        F.when(F.col("output_tokens") > 50, F.col("output_tokens")).alias("outputTokens"))
    rows.write.option("timestampFormat", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX").json(base)
    return logs.read_call_log(w.spark, base).select(
        F.col("started_at").cast("timestamp_ntz").alias("started_at"), "level", "model", "purpose", "input_tokens", "output_tokens")


@query("a10_check_contract", """
    select repo, path as subject, 'line_count' as field, 'non-negative' as rule from v_files where line_count > 1000
    union all select repo, path, 'purpose', 'required' from v_files where purpose = 'Order in status P'
    union all select repo, path, 'exports', 'elements required' from v_files where export_list like '%,%'
    union all select repo, path, 'imports', 'required' from v_part_file where p_size < 50""")
def contract(w):
    faulty = w.annotations().withColumns({
        "line_count": F.when(F.col("line_count") > 1000, -F.col("line_count")).otherwise(F.col("line_count")),
        "purpose": F.nullif("purpose", F.lit("Order in status P")),
        "exports": F.when(F.size("exports") > 1, F.transform("exports", lambda e: F.nullif(e, F.get("exports", F.lit(1))))).otherwise(F.col("exports")),
        "imports": F.when(F.startswith("path", F.lit("lib/")) & (F.size("imports") == 0), F.lit(None)).otherwise(F.col("imports")),
    })
    return contracts.check_contract(faulty, "annotations")


@query("a10_check_contract_meta", """
    select repo, '1' as subject, 'created_at' as field, 'ISO datetime' as rule from v_meta where stack = 'ASIA'
    union all select repo, '1', 'update_type', 'full or delta' from v_meta where stack = 'EUROPE'
    union all select repo, '1', 'modules', 'elements required' from v_meta where stack = 'AFRICA'
    union all select repo, '1', 'stack', 'required' from v_meta where stack = 'AMERICA'""")
def contract_meta(w):
    of = lambda name, bad, good: F.when(F.col("stack") == name, bad).otherwise(good)
    incomplete = F.transform("modules", lambda m: F.struct(m["path"].alias("path"), F.lit(None).cast("string").alias("description")))
    faulty = meta_rows(w).withColumns({
        "created_at": of("ASIA", F.lit("2024-01-01"), F.col("created_at")), "update_type": of("EUROPE", F.lit("partial"), F.col("update_type")),
        "modules": of("AFRICA", incomplete, F.col("modules")), "stack": F.nullif("stack", F.lit("AMERICA"))})
    return contracts.check_contract(faulty, "meta")


@query("a10_check_contract_graph", """
    select repo, path as subject, 'imports' as field, 'required' as rule from v_order where status = 'P'
    union all select repo, path, 'imported_by', 'elements required' from v_part_file where p_size = 50""")
def contract_graph(w):
    graph, keys = w.graph(), ["repo", "path"]
    lacking = graph.nodes.join(w.view("v_order").filter("status = 'P'").select(*keys), keys, "left_semi").withColumn("direction", F.lit("imports"))
    holed = graph.nodes.join(w.view("v_part_file").filter("p_size = 50").select(*keys), keys, "left_semi").withColumn("direction", F.lit("imported_by"))
    rows = G.listed(graph).join(lacking.unionByName(holed), [*keys, "direction"], "left_anti").unionByName(
        holed.withColumn("other", F.lit(None).cast("string")))
    return contracts.check_graph_rows(rows, lacking)


# --- streams ---------------------------------------------------------------


def _age(spark, folder: str, millis: int) -> None:
    """Give the files of a folder a modification time in the past."""
    place = spark._jvm.org.apache.hadoop.fs.Path(folder)
    system = place.getFileSystem(spark._jsc.hadoopConfiguration())
    for status in system.listStatus(place):
        system.setTimes(status.getPath(), millis, -1)


@query("l1_stream_annotations", f"{_ANNOTATIONS}")
def stream_annotations(w):
    """Three runs of one stream: outdated annotations, then newer ones, then files that are older than all before."""
    source, out, state = (scratch_path(w.spark, name) for name in ("arriving", "annotated", "state"))
    rows, own = w.annotations(), F.startswith("path", F.lit("src/"))
    run = lambda: streams.stream_annotations(w.spark, f"{source}/*", out, state).awaitTermination()
    logs.append_jsonl(rows.filter(own).withColumns({"line_count": F.lit(0).cast("bigint"), "imports": F.array(F.lit("outdated"))}), f"{source}/1")
    _age(w.spark, f"{source}/1", 1_600_000_000_000)
    run()
    logs.append_jsonl(rows.filter(own), f"{source}/2")
    run()
    logs.append_jsonl(rows.filter(~own), f"{source}/3")
    _age(w.spark, f"{source}/3", 1_000_000_000_000)
    run()
    return shown(streams.latest_annotations(w.spark, out))


@query("l2_stream_call_metrics", """
    select time_bucket(interval '1 hour', started_at) as window_start, level, count(*) as call_count, cast(sum(latency_ms) as bigint) as total_latency_ms
    from v_calls where time_bucket(interval '1 hour', started_at) + interval '1 hour' <= (select max(started_at) - interval '10 minutes' from v_calls) group by 1, 2""")
def stream_calls(w):
    """Windows the watermark has closed by the end of the log, which arrives in four batches."""
    source, out, state = (scratch_path(w.spark, name) for name in ("calls", "windows", "state"))
    log = w.view("v_calls")
    append_in_time(log, source, 4)
    arriving = w.spark.readStream.schema(log.schema).option("maxFilesPerTrigger", 1).parquet(source)
    streams.stream_to_table(streams.call_windows(arriving, "1 hour"), out, state).awaitTermination()
    return w.spark.read.parquet(out).select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "level", "call_count", "total_latency_ms")


_UPDATED_MAP = """
    select repo, src as path, 'imports' as direction, dst as other from merged_edges
    union all select distinct e.repo, e.dst, 'imported_by', e.src from merged_edges e join merged m on m.repo = e.repo and m.path = e.dst
    union all select repo, path, 'lines', cast(line_count as varchar) from merged"""


@query("l3_stream_changes", _UPDATED_MAP, MERGED)
def stream_changes(w):
    """Two streams with checkpoints of their own, first outdated versions, then the final ones; compacted, the map matches a batch update."""
    first, second, out, base = (scratch_path(w.spark, name) for name in ("changes", "changes", "recorded", "compacted"))
    columns = w.annotations().columns
    new = updated(w).select("repo", "path", F.lit("M").alias("status"), F.struct(*columns).alias("annotation"))
    gone = w.gone().join(new, ["repo", "path"], "left_anti").select("repo", "path", F.lit("D").alias("status"), F.lit(None).cast(new.schema["annotation"].dataType).alias("annotation"))
    final = new.unionByName(gone).withColumn("seq", F.lit(2))
    new.withColumns({"status": F.lit("D"), "seq": F.lit(1)}).write.parquet(first)
    final.write.parquet(second)
    for source in (first, second):
        arriving = w.spark.readStream.schema(final.schema).option("maxFilesPerTrigger", 4).parquet(source)
        streams.stream_changes(arriving, out, scratch_path(w.spark, "state")).awaitTermination()
    merged, graph = streams.compact_changes(w.spark, w.annotations(), w.graph(), out, base)
    merged, graph = streams.apply_changes(w.spark, merged, graph, out)
    lines = merged.select("repo", "path", F.lit("lines").alias("direction"), F.col("line_count").cast("string").alias("other"))
    return G.entries(graph).unionByName(lines)


def shown_map(m):
    lines = m.annotations().select("repo", "path", F.lit("lines").alias("direction"), F.col("line_count").cast("string").alias("other"))
    return G.entries(m.graph()).unionByName(lines)


@query("f2_update_stored", _UPDATED_MAP, MERGED)
def update_stored(w):
    """The map in buckets, brought up to date in place."""
    m = buckets.store_map(w.annotations(), scratch_path(w.spark, "map"), buckets=64)
    buckets.update_stored(w.spark, m.location, updated(w), w.gone())
    return shown_map(m)


@query("l3_stream_into_map", _UPDATED_MAP, MERGED)
def stream_into_map(w):
    """Outdated and final changes as they arrive, in two runs of one stream, into a map in buckets."""
    source, state = scratch_path(w.spark, "changes"), scratch_path(w.spark, "state")
    m = buckets.store_map(w.annotations(), scratch_path(w.spark, "map"), buckets=64)
    columns = w.annotations().columns
    new = updated(w).select("repo", "path", F.lit("M").alias("status"), F.struct(*columns).alias("annotation"))
    gone = w.gone().join(new, ["repo", "path"], "left_anti").select("repo", "path", F.lit("D").alias("status"), F.lit(None).cast(new.schema["annotation"].dataType).alias("annotation"))
    final = new.unionByName(gone).withColumn("seq", F.lit(2))
    outdated = new.withColumns({"annotation": F.col("annotation").withField("line_count", F.lit(-1).cast("bigint")), "seq": F.lit(1)})
    for arrived in (outdated, final):
        arrived.write.mode("append").parquet(source)
        arriving = w.spark.readStream.schema(final.schema).parquet(source)
        streams.stream_into_map(arriving, m.location, state).awaitTermination()
    return shown_map(m)
