"""Time the headline queries and print one JSON line.

    BENCH_SF_DIR   data folder (default /root/testdata/sf0.1)
    BENCH_CPUS     local cores (default 8)
    BENCH_RUNS     warm runs per query, the median counts (default 3)

Results go to the ``noop`` sink, so a query is computed whole. Every query runs
once before it is timed; that first time is reported beside the warm one, with
rows per second of its main input table.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

from corpusgauge.catalog import QUERIES
from corpusgauge.session import local_session

# query -> main input table
HEADLINE = {
    "f2_oov_rates": "documents",
    "f6_diversity": "documents",
    "f8_top_bigrams": "documents",
    "f9_class_unigrams": "documents",
    "f12_language": "documents",
    "b3_word_tokens": "documents",
    "b6_drop_dictionary": "documents",
    "b7_collapse_repeats": "documents",
    "d0_null_profile": "documents",
    "d1_row_duplicates": "documents",
    "d3_conflict_summary": "documents",
    "d8_describe_orders": "orders",
    "d9_describe_text": "documents",
    "e3_compare_discrete": "documents",
    "e5_histogram_orders": "orders",
    "e6_histogram_on_edges": "lineitem",
    "e8_box_by_dataset": "orders",
    "e15_quantile_bins": "lineitem",
    "g4_pair_datetime": "orders",
    "h2_overall": "documents",
    "h3_report_true_labels": "documents",
    "h8_threshold_curve": "documents",
    "h15_small_classes_merged": "documents",
    "i3_hash_tree": "lineitem",
    "i6_compare_stats": "orders",
    "i8_overall_status": "orders",
    "j1_tfidf_terms": "documents",
    "k1_normalise_label": "documents",
    "k8_similarity_gate": "embeddings",
    "k8_nearest_vector": "embeddings",
    "k9_near_copies": "documents",
    "k10_closest_word": "documents",
}


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = max(1, int(os.environ.get("BENCH_RUNS", "3")))
    only = sys.argv[1:]
    spark = local_session(cpus, "bench")
    rows = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet").count() for t in set(HEADLINE.values())}

    def once(name: str) -> float:
        t0 = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - t0

    first, warm, rate = {}, {}, {}
    for name, main_table in HEADLINE.items():
        if only and name not in only:
            continue
        first[name] = round(once(name), 3)
        warm[name] = round(statistics.median(once(name) for _ in range(runs)), 3)
        rate[name] = round(rows[main_table] / warm[name])
    print(
        json.dumps(
            {
                "metric": "total warm seconds of the headline queries",
                "value": round(sum(warm.values()), 3),
                "unit": "sec",
                "queries": warm,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
                "first_run": first,
                "rows_per_sec": rate,
            }
        )
    )


if __name__ == "__main__":
    main()
