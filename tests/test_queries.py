"""Registered queries next to their SQL, on the smallest tables."""

import pytest

from workloads.catalog import load
from workloads.check import compare, connect

SF = "/root/testdata/sf0.001"
NAMES = ["a06_json_results", "b02_category_lookup", "b10_clip_report", "c09_quartiles", "c13_rank_shift", "d02_rare_aware_sample", "d05_draw_with_replacement",
         "d07_cv_subset_capped", "d13_disjoint_runs", "d14_seeded_runs", "d16_stratified_folds", "e01_frozen_one_hot", "e06_reduction_fit_apply",
         "e09_gaussian_noise", "f01_anova_f_vectors", "f03_neighbour_information", "f12_davies_bouldin", "f20_bootstrap_rows", "f23_spearman", "g05_poly_neighbor",
         "g09_map_statistics_linear", "g15_kernel_bootstrap", "i06_operating_corners", "i06_operating_points", "i09_group_average_precision", "i12_reliability_bins", "j10_mcnemar_per_category",
         "j08_mann_whitney", "k02_run_matrix", "k05_prior_subsample", "l01_sanity_suite"]


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, con, name):
    queries, oracles = load()
    verdict = compare(spark, con, name, queries[name], oracles[name], SF)[0]
    assert verdict.startswith("ok") and "EMPTY" not in verdict, verdict


def test_every_oracle_has_a_query():
    queries, oracles = load()
    assert set(oracles) <= set(queries) and len(queries) > 150


def test_entry(spark):
    import __spark_entry__ as e
    out = e.entry(spark)
    assert out.columns == ["feature", "f_score", "rank"] and out.count() == 4
