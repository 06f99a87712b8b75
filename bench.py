"""Time the headline queries and print one JSON line.

BENCH_SF_DIR names the folder of tables, BENCH_CPUS the number of local threads.
The corpus tables all queries read are derived first and timed on their own.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

from codeloom.session import build_session, scratch_path, stored
from codeloom.sources import buckets
from workload import QUERIES
from workload.views import Workspace

HEADLINE = [
    "a1_scan_files", "d1_extract_imports", "d2_symbol_imports", "d7_resolve_imports", "c4_filter_ignored_defaults", "b3_size",
    "f1_build_graph", "f2_update_graph", "f3_graph_stats", "e3_dependents", "e5_match_scopes",
    "k2_top_files_per_repo", "k5_file_context", "k6_path_context",
    "i2_asymmetric_edges", "i7_cycle_members", "i14_validate_map",
    "h1_pack_tasks", "h3_plan_totals", "j3_update_strategy", "d11_annotations_from_responses",
    "g12_task_latency", "l4_rate_limit_audit",
]


def stored_map(corpus: Workspace) -> dict[str, float]:
    """Seconds to store the corpus in buckets, to bring in a change of some files, and of one look-up once warm."""
    spark, seconds = corpus.spark, {}

    def timed(name, action):
        start = time.time()
        result = action()
        seconds[name] = round(time.time() - start, 3)
        return result

    files = corpus.annotations()
    m = timed("store_map", lambda: buckets.store_map(files, scratch_path(spark, "map"), buckets=256))
    # One directory's files of one repository: what a commit touches.
    commit = stored(files.filter("repo = 'NATION_1' and startswith(path, 'src/c')").orderBy("path").limit(20))
    timed("update_stored_20_files", lambda: buckets.update_stored(spark, m.location, commit, commit.limit(0).select("repo", "path")))
    asked = [(r["repo"], r["path"]) for r in commit.limit(6).collect()]
    meta = stored(corpus.meta())
    for pair in asked[:-1]:
        buckets.look_up(spark, m.location, [pair], meta).collect()
    timed("look_up_one_file", lambda: buckets.look_up(spark, m.location, [asked[-1]], meta).collect())
    return seconds


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8))
    names = sys.argv[1:] or HEADLINE
    spark = build_session(
        "bench", f"local[{cpus}]",
        **{"spark.checkpoint.dir": tempfile.mkdtemp(prefix="codeloom-"), "spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "16g"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    spark.range(1000).selectExpr("sum(id)").collect()

    start = time.time()
    corpus = Workspace(spark, sf_dir)
    corpus.graph()
    corpus.importers()
    corpus.listing()
    corpus.derived("source", lambda: corpus.view("v_source"))
    seconds = {"corpus": round(time.time() - start, 3)}
    for name in (n for n in names if n != "stored_map"):
        start = time.time()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.time() - start, 3)
        print(f"{name}: {seconds[name]}", file=sys.stderr, flush=True)
    if not sys.argv[1:] or "stored_map" in sys.argv[1:]:
        seconds |= stored_map(corpus)
    total = round(sum(seconds.values()), 3)
    print(json.dumps({"metric": "total wall time of headline queries", "value": total, "unit": "sec", "queries": seconds, "sf": sf_dir.rstrip("/").rsplit("sf", 1)[-1]}))


if __name__ == "__main__":
    main()
