"""Range edges: sides that bins multiply are never broadcast, edges of targets with one range need no grouping."""

from __future__ import annotations

from pyspark.sql import functions as F

from metricspark.operators import diff


def _tables(spark, tmp_path):
    path = str(tmp_path / "cells")
    spark.range(2000).select(F.lit("s").alias("sheet"), F.col("id").alias("row_no"), (F.col("id") % 7).alias("col_no")).write.parquet(path)
    cells = spark.read.parquet(path)
    ranges = cells.filter("row_no % 50 = 0").select(
        F.col("sheet").alias("target_sheet"), (F.col("row_no") % 1000).alias("target_row"), F.lit(99).alias("target_col"),
        F.col("row_no").alias("ref_no"), F.col("sheet").alias("ref_sheet"), F.col("row_no").alias("row_start"),
        (F.col("row_no") + F.when(F.col("row_no") % 100 == 0, 0).otherwise(1200)).alias("row_end"),
        F.lit(0).alias("col_start"), F.lit(6).alias("col_end"))
    return cells, ranges


def test_no_side_is_broadcast_by_the_size_of_its_file(spark, tmp_path):
    cells, ranges = _tables(spark, tmp_path)
    lines = diff.range_edges(cells, ranges)._jdf.queryExecution().executedPlan().toString().splitlines()
    assert not [x for x in lines if "BroadcastHashJoin" in x and "row_bin" in x]
    assert [x for x in lines if "SortMergeJoin" in x and "row_bin" in x]


def test_one_edge_per_pair_with_one_and_several_ranges(spark, tmp_path):
    """Rows 1000 on read for the same targets as those before; repeated cells count once."""
    cells, ranges = _tables(spark, tmp_path)
    ranges = ranges.filter("row_no <> 1500")
    got = diff.range_edges(cells.unionByName(cells), ranges).collect()
    kinds: dict = {}
    for r in sorted(ranges.collect(), key=lambda r: r.ref_no):
        for row in range(r.row_start, min(r.row_end, 1999) + 1):
            kinds.setdefault((row, r.target_row), "range")
    assert sorted((r.row_no, r.target_row) for r in got) == sorted(kinds)
    assert {r.dependency_type for r in got} == {"range"}
