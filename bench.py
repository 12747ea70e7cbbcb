"""Times the headline queries and prints one JSON line.

    BENCH_SF_DIR=/root/testdata/sf0.1 BENCH_CPUS=8 python bench.py [query ...]

Every query runs once, in full, into Spark's no-op sink, with no stage left by another one.
The tables come as one file of one row group each; they are first laid out in several files,
as tables on a cluster are, and that is timed as ``layout``.
"""

from __future__ import annotations

import json
import os
import shutil
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = (
    "txt2_normalize_text", "ret1_chunks", "ret3_tfidf_cosine", "ret6_hybrid_topk", "evd1_label_pairs", "evd3_grid_pairs",
    "evd9_field_matches", "evd12_fuzzy_labels", "evd16_best_candidates", "dec3_decision_matrix", "lin1_traceability",
    "cmp1_index_delta", "cmp7_structure_drift", "cmp9_cell_issues", "cmp13_full_coverage", "dq5_provenance", "dq14_sensitive_scan",
)


def main() -> None:
    from proofgrain.plans import catalog
    from proofgrain.plans.stages import drop_stages
    from proofgrain.session import build_session, checkpoint_dir

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session("bench", f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": str(2 * int(cpus)) if cpus.isdigit() else "16",
        "spark.driver.memory": "16g", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    queries = catalog.queries()
    spark.range(1000).selectExpr("sum(id)").collect()  # the JVM is up before the clock starts
    times, start = {}, time.time()
    laid_out = f"{checkpoint_dir(spark)}/bench-{os.getpid()}/{os.path.basename(sf_dir.rstrip('/'))}"
    for table in sorted(x for x in os.listdir(sf_dir) if x.endswith(".parquet")):
        spark.read.parquet(f"{sf_dir}/{table}").repartition(2 * spark.sparkContext.defaultParallelism).write.parquet(f"{laid_out}/{table}")
    times["layout"] = round(time.time() - start, 3)
    for name in sys.argv[1:] or HEADLINE:
        drop_stages(spark)
        start = time.time()
        queries[name](spark, laid_out).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - start, 3)
        print(f"{name} {times[name]}", file=sys.stderr, flush=True)
    print(json.dumps({
        "metric": "headline_query_seconds", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))
    shutil.rmtree(os.path.dirname(laid_out).removeprefix("file://"), ignore_errors=True)
    spark.stop()


if __name__ == "__main__":
    main()
