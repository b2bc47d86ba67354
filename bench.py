"""Times the headline queries and prints one JSON line.

BENCH_SF_DIR picks the data (default sf0.1), BENCH_CPUS the local cores.
Before the timing the tables are copied into one file per core, since the test
files have a single row group each and scans cannot split that.
Each query is run to the end through a no-op sink; the first run of a query
warms the JVM, the better of the next runs counts.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = (
    "slice_stopword_savings", "a4_daily_rollup", "a11_summary_full", "a16_report", "x2_stop_words",
    "x3_redundant_sentences", "x3c_first_sentences", "x3c_near_copies", "x4_tfidf", "x4c_corpus_tfidf",
    "x6_condense", "x12_standard", "x14_weight", "x15_content_dispatch", "c13_code_pipeline", "c10_log_summary",
    "r1_content_class_fixed", "r10_provider_resolution", "h5_exact_lookup", "h6_semantic_lookup", "h9_top_similar",
    "p6_adjudication", "p8_sliding_quota", "v3_masked_text", "n1_normalised_responses",
)
TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def main() -> None:
    from quillmill import suite
    from quillmill.session import build_session

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8))
    repeats = int(os.environ.get("BENCH_REPEATS", "1"))
    spark = build_session("quillmill-bench", f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "16g", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    queries = suite.all_queries()
    given, sf_dir = sf_dir, tempfile.mkdtemp(prefix="bench-")
    for name in TABLES:
        spark.read.parquet(f"{given}/{name}.parquet").repartition(int(cpus)).write.parquet(f"{sf_dir}/{name}.parquet")
    seconds: dict[str, float] = {}
    for name in HEADLINE:
        best = None
        for _ in range(1 + repeats):
            start = time.perf_counter()
            queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            took = time.perf_counter() - start
            best = took if best is None else min(best, took)
        seconds[name] = round(best, 3)
        print(f"{name}: {best:.2f}s", file=sys.stderr, flush=True)
    print(json.dumps({"metric": "total_headline_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec",
                      "queries": seconds, "sf": os.path.basename(given.rstrip("/")).removeprefix("sf"),
                      "cpus": int(cpus)}))


if __name__ == "__main__":
    main()
