"""Every registered query runs on the smallest tables and agrees with its oracle."""

from __future__ import annotations

from pathlib import Path

import pytest

import __spark_entry__ as entry
from check import compare, connect
from metricspark.plans import registry

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="driver tables not present")
# The costly ones are left to check.py; the rest guards the registry as a whole.
QUICK = (
    "metric_counts", "scope_counts", "invalid_diagnostics", "monthly_summary", "derived_columns", "strict_classify",
    "manifest_join", "completeness", "preflight_checks", "snapshot_diff", "range_edges", "reference_compare",
    "multi_axis_summary", "multiset_excess", "align_best", "label_cascade", "readiness", "template_families",
    "derived_metrics", "classify_direct", "cell_order", "top_changes", "row_problems", "merge_anchor", "mismatch_stats", "scan_typed", "metric_counts_large_catalog",
)


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


def test_every_query_has_an_oracle():
    entry.queries()
    assert set(registry.QUERIES) == set(registry.ORACLES) <= set(entry.oracle_sql())


@pytest.mark.parametrize("name", QUICK)
def test_query_matches_oracle(spark, duck, name):
    line = compare(spark, duck, SF, name, entry.queries()[name], entry.oracle_sql()[name])
    assert line.startswith("ok"), line
