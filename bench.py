"""Seconds per headline query at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

After an untimed warm-up every query runs twice: "cold" holds the first runs, which are mostly code generation, "queries" the
second ones.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "c01_label_distribution", "c03_run_summary", "c09_quartiles", "d02_rare_aware_sample", "d06_cv_subset", "d13_disjoint_runs",
    "d16_stratified_folds", "e01_frozen_one_hot", "e06_reduction_fit_apply", "e08_refit_per_run", "e09_gaussian_noise",
    "f01_anova_f", "f01_anova_f_vectors", "f03_mutual_information", "f11_fisher", "f12_davies_bouldin", "f22_pearson",
    "f23_spearman", "f20_bootstrap_rows", "g01_linear_rows", "g09_map_statistics_linear", "g11_cka_maps", "g15_kernel_bootstrap",
    "h01_linear_classifier", "i03_macro_f1", "i05_roc_auc", "i07_average_precision", "i13_calibration_error", "j03_mcnemar_statistic",
    "j08_mann_whitney", "k02_run_matrix", "k03_noise_sweep", "l01_sanity_suite", "d11_prior_subsample", "g12_effective_rank_linear", "f08_k_summary",
]


def main() -> None:
    from tarnfold.session import local_session
    from workloads.catalog import load

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, shuffle_partitions=max(2, int(cpus) if cpus.isdigit() else 8), app="bench")
    spark.sparkContext.setLogLevel("ERROR")
    queries = load()[0]
    def seconds(name):
        start = time.perf_counter()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        return round(time.perf_counter() - start, 3)

    spark.read.parquet(f"{sf_dir}/lineitem.parquet").groupBy("l_returnflag").count().collect()  # untimed: session and readers start
    cold = {name: seconds(name) for name in HEADLINE}
    warm = {name: seconds(name) for name in HEADLINE}
    sf = os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(warm.values()), 3), "unit": "sec",
                      "queries": warm, "cold": cold, "sf": float(sf) if sf.replace(".", "").isdigit() else sf}), flush=True)
    spark.stop()


if __name__ == "__main__":
    main()
