"""Issues are worked out once per distinct reading and belong to every metric that has it."""

from __future__ import annotations

from pyspark.sql import functions as F

from metricspark.operators import decide
from metricspark.plans import queries_align as q


def _metrics(spark):
    part = spark.range(400).select(
        F.col("id").alias("p_partkey"), F.lit("red bolt").alias("p_name"), F.lit("PROMO").alias("p_type"),
        (F.col("id") % 4).cast("int").alias("p_size"))
    return spark.sql(q._METRICS, part=part)


def test_issues_by_reading_equal_issues_by_metric(spark):
    metrics = _metrics(spark)
    want = decide.readiness(decide.map_metrics(q._split(metrics)), q._POLICY).select("metric_id", "form", F.inline("issues"))
    got = q.issues_by_reading(metrics.withColumn("read", F.sha2(F.to_json(F.struct(*q._READ)), 256)))
    rows = lambda df: sorted(tuple(r) for r in df.select("metric_id", "form", "dimension", "issue_type", "severity").collect())
    assert rows(got) == rows(want) and len(rows(got)) > 400


def test_labels_are_read_once_per_row(spark):
    """The age patterns stand once in the plan, however many flags depend on them."""
    plan = decide.readiness(decide.map_metrics(q._split(_metrics(spark))), q._POLICY)._jdf.queryExecution().optimizedPlan().toString()
    pattern = decide.fixed.AGE_LABELS[0][0]
    assert 1 <= plan.count(f"RLIKE({pattern}") + plan.count(f"RLIKE {pattern}") + plan.count(f", {pattern})") <= 4
