"""Diffs by digests of blocks: the same rows, and nothing joined that did not change."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from metricspark.operators import diff

CELLS = "sheet string, row_no long, col_no int, value_num double, value_txt string, formula string"


def snapshot(rng, n):
    return {(rng.choice("AB"), rng.randint(1, 400), rng.randint(1, 4)): (rng.choice([None, 1.0, 2.5]), rng.choice([None, "", "x", "y"]), rng.choice([None, "", "=A1"])) for _ in range(n)}


def frame(spark, cells):
    return spark.createDataFrame([(*k, *v) for k, v in cells.items()], CELLS)


def changes(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_equal_to_the_plain_diff(spark):
    rng = random.Random(5)
    before = snapshot(rng, 500)
    after = {k: v for k, v in before.items() if rng.random() > 0.02}
    after |= {k: (3.0, v[1], v[2]) for k, v in after.items() if rng.random() < 0.02} | {k: (v[0] and v[0] + 1e-12, v[1], v[2]) for k, v in after.items() if rng.random() < 0.02}
    after |= {("C", 1, 1): (1.0, None, None), ("A", 5000, 1): (None, "new", None)}
    before[("D", 1, 1)] = (1.0, None, None)
    b, a = frame(spark, before), frame(spark, after)
    want = changes(diff.snapshot_diff(b, a))
    for size in (1, 16, 10_000):
        assert changes(diff.snapshot_diff_by_blocks(b, a, size)) == want
    assert diff.snapshot_diff_by_blocks(b, b.limit(0), 16).count() == 0


def test_unchanged_sheets_are_not_joined(spark):
    before = spark.range(10_000).selectExpr("concat('s', id % 4) AS sheet", "id AS row_no", "1 AS col_no", "CAST(id AS DOUBLE) AS value_num", "CAST(NULL AS STRING) AS value_txt", "CAST(NULL AS STRING) AS formula")
    after = before.repartition(7).withColumn("value_num", F.when(F.col("row_no") == 4001, -1.0).otherwise(F.col("value_num")))
    assert [tuple(r) for r in diff.differing_blocks(before, after, 1000).collect()] == [("s1", 4)]
    found = diff.snapshot_diff_by_blocks(before, after, 1000)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("FullOuter") < plan.index("LeftSemi") and plan.count("LeftSemi") == 2
    assert [r.row_no for r in found.collect()] == [4001]


def test_digests_see_nulls_places_and_copies(spark):
    one = frame(spark, {("A", 1, 1): (None, "x", None)})
    for other in ({("A", 1, 1): (None, None, "x")}, {("A", 1, 2): (None, "x", None)}, {("A", 1, 1): (None, "x", "")}):
        assert diff.differing_blocks(one, frame(spark, other), 8).count() == 1
    assert diff.differing_blocks(one, one.union(one), 8).count() == 1 and diff.differing_blocks(one, one, 8).count() == 0
