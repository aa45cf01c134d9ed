"""Headline queries on ``$BENCH_SF_DIR``: median of three runs after one warm-up, one JSON line."""

from __future__ import annotations

import json
import os
import statistics
import time

from isolens.plans import registry
from isolens.session import local_session

HEADLINE = [
    "marker_prevalence_by_source_year", "marker_frequency", "topk_prevalence", "sampling_weights", "genotype_signatures", "bucket_stack",
    "classify_source", "derive_year", "audit_label", "flag_in_interval", "best_per_key", "with_row_id",
    "feature_counts", "hypergeom_enrichment", "definer_bins_all_runs", "fisher_vs_rest", "fisher_pairwise", "element_summary_with_letters",
    "pangenome_summary", "accumulation_curve", "hill_numbers", "bootstrap_hill", "permutation_hill", "stratified_selection",
    "gene_rollup", "functional_summary", "pairwise_tree_distance", "distance_summary", "parse_ann", "longest_orf",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    registry.load()
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "isolens-bench")
    spark.sparkContext.setLogLevel("ERROR")
    times: dict[str, float] = {}
    for name in HEADLINE:
        taken: list[float] = []
        for run in range(runs + 1):
            start = time.time()
            registry.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            if run:
                taken.append(time.time() - start)
        times[name] = round(statistics.median(taken), 3)
    sf = sf_dir.rstrip("/").rsplit("sf", 1)[-1]
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": float(sf)}))


if __name__ == "__main__":
    main()
