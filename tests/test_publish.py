"""Publishing that can be repeated after a failure, and audits taken in the run's own pass."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from metricspark.sources import publish

DDL = "target string, value double, instruction_id string, metric_id string, expected_value_type string"
GOOD = [("t1", 1.0, "i1", "a", "NUMBER"), ("t2", 2.0, "i2", "b", "NUMBER")]


@pytest.fixture
def put(spark, tmp_path):
    values = spark.createDataFrame([("a",), ("b",)], "metric_id string")
    return lambda data=GOOD: publish.publish(spark.createDataFrame(data, DDL), values, str(tmp_path / "out"))


def test_a_failed_read_back_blocks_nobody(spark, tmp_path, put, monkeypatch):
    whole = publish.verify_readback
    monkeypatch.setattr(publish, "verify_readback", lambda expected, actual, key: whole(expected, actual.limit(1), key))
    with pytest.raises(publish.PublishRefused, match="read-back"):
        put()
    assert not list(tmp_path.iterdir())
    monkeypatch.undo()
    assert put().filter("status = 'OK'").count() == 2
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2 and (tmp_path / "out" / "_VERIFIED").exists()


def test_of_two_writers_one_wins(spark, tmp_path, put, monkeypatch):
    place = publish._take_place

    def late(spark, staged, path):
        monkeypatch.setattr(publish, "_take_place", place)
        put([("t1", 7.0, "i1", "a", "NUMBER"), ("t2", 8.0, "i2", "b", "NUMBER")])  # the other one, in between
        return place(spark, staged, path)

    monkeypatch.setattr(publish, "_take_place", late)
    with pytest.raises(publish.PublishRefused, match="exists"):
        put()
    assert sorted(r.value for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [7.0, 8.0]
    assert [p.name for p in tmp_path.iterdir()] == ["out"]


def test_rename_refuses_what_came_in_between(spark, tmp_path):
    for name in ("staged", "out"):
        spark.range(1).write.parquet(str(tmp_path / name))
    assert not publish._take_place(spark, str(tmp_path / "staged"), str(tmp_path / "out"))
    assert (tmp_path / "staged").exists()


def test_lost_attempts_are_found_and_cleared(spark, tmp_path, put):
    spark.range(1).write.parquet(str(tmp_path / "_out.attempt-dead"))
    spark.range(1).write.parquet(str(tmp_path / "_other.attempt-live"))
    assert put().count() == 2
    assert [x.rsplit("/", 1)[1] for x in publish.dead_attempts(spark, str(tmp_path / "out"))] == ["_out.attempt-dead"]
    assert publish.clear_attempts(spark, str(tmp_path / "out")) == 1 and publish.clear_attempts(spark, str(tmp_path / "out")) == 0
    assert (tmp_path / "_other.attempt-live").exists() and publish.dead_attempts(spark, str(tmp_path / "no" / "out")) == []


def test_rows_are_evaluated_once(spark, tmp_path):
    """Rows that differ between evaluations are checked, written and compared as one and the same."""
    unstable = spark.createDataFrame(GOOD, DDL).withColumn("value", F.rand())
    assert publish.publish(unstable, spark.createDataFrame([("a",), ("b",)], "metric_id string"), str(tmp_path / "out")).filter("status <> 'OK'").count() == 0


def test_observed_audit(spark, tmp_path):
    spark.range(1000).selectExpr("id", "id % 7 AS kind").write.parquet(str(tmp_path / "in"))
    df = spark.read.parquet(str(tmp_path / "in"))
    parts = ({"sevens": F.col("kind") == 0}, {"SIXES": F.col("kind") == 6, "EIGHTS": F.col("kind") == 8}, [F.col("id"), F.col("kind")])
    rows, seen = publish.observed_audit(df, "run", *parts)
    rows.filter("kind < 3").groupBy("kind").count().write.format("noop").mode("overwrite").save()
    assert seen.get == publish.run_audit(df, *parts).first().asDict() and seen.get["warnings"] == "SIXES" and seen.get["records"] == 1000
    plan = rows.filter("kind < 3")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "CollectMetrics" in plan
