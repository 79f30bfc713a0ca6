"""What the plans must look like for the jobs to hold at scale."""

from __future__ import annotations

import contextlib
import io
import re

import pytest
from pyspark.sql import functions as F

from metricspark import session
from metricspark.functions.dates import in_period
from metricspark.operators import diff, metrics, reconcile, scope, summary
from metricspark.plans import registry
from metricspark.sources import scan


def plan(df) -> str:
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain("formatted")
    return out.getvalue()


@pytest.fixture(scope="module")
def facts(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("facts") / "t")
    spark.range(1000).select(
        (F.col("id") % 3).cast("string").alias("flag"), (F.col("id") % 50).alias("qty"), F.col("id"),
        F.timestamp_seconds(F.lit(850_000_000) + F.col("id") * 86_400).cast("timestamp_ntz").alias("day"),
    ).write.parquet(path)
    return spark.read.parquet(path)


def test_period_range_reaches_the_scan(facts):
    text = plan(facts.filter(in_period(F.col("day"), "1997-01-01", "1997-02-01")).select("qty"))
    assert re.search(r"PushedFilters: .*GreaterThanOrEqual\(day,1997-01-01.*LessThan\(day,1997-02-01", text)
    assert "struct<qty:bigint,day:timestamp_ntz>" in text


@pytest.mark.parametrize("many", [False, True])
def test_metric_catalog_scans_once(facts, many):
    terms = [metrics.Term(f"m{i}", (("flag", str(i % 3)), ("qty", f">{i}"))) for i in range(60 if many else 3)]
    text = plan(metrics.metric_counts(facts.withColumn("period", F.trunc("day", "month")), terms))
    assert text.count("Scan parquet") == 2  # once in the tree, once in the details
    assert "Cartesian" not in text and "NestedLoop" not in text


def test_group_lists_are_cut_before_the_shuffle(facts):
    text = plan(summary.review_clusters(facts, ["flag"], "id"))
    assert "WindowGroupLimit" in text


def test_range_join_is_an_equality(spark, facts):
    cells = facts.select(F.col("flag").alias("sheet"), F.col("id").alias("row_no"), F.col("qty").alias("col_no"))
    ranges = cells.select(
        F.col("sheet").alias("target_sheet"), F.col("row_no").alias("target_row"), F.col("col_no").alias("target_col"),
        F.lit(0).alias("ref_no"), F.col("sheet").alias("ref_sheet"), F.col("row_no").alias("row_start"),
        (F.col("row_no") + 90).alias("row_end"), F.lit(1).alias("col_start"), F.lit(9).alias("col_end"))
    text = plan(diff.range_edges(cells, ranges))
    assert "Cartesian" not in text and "NestedLoop" not in text


def test_multiset_sides_share_one_shuffle(facts):
    text = plan(reconcile.multiset_check(facts.filter("qty > 3"), facts, F.col("flag")))
    assert "Join" not in text


def test_only_what_is_used_is_read(spark, tmp_path):
    """No column is kept alive by parsing, and a record with a date needs few of its fields."""
    path = str(tmp_path / "raw")
    spark.range(5).selectExpr("'01/02/1997' AS DIA_CITA", "'01/02/1977' AS FECHA_NACIMIENTO", "'F' AS SEXO", "'t' AS TIPO_DE_CITA", "'x' AS SUCURSAL",
                              "'y' AS ESPECIALIDAD", "'z' AS PRESTACION", "date'1997-02-01' AS day").write.parquet(path)
    raw = spark.read.parquet(path).filter("day >= date'1997-02-01'")
    fields = ("DIA_CITA", "FECHA_NACIMIENTO", "SEXO", "TIPO_DE_CITA", "SUCURSAL", "ESPECIALIDAD", "PRESTACION")
    layout = scope.RecordLayout(fields=fields)
    text = plan(scope.detect_periods(scope.scope_flags(scan.typed(raw, fields), layout)))
    assert "GreaterThanOrEqual(day,1997-02-01)" in text
    read = re.search(r"ReadSchema: (.*)", text).group(1)
    assert "SEXO" in read and not any(f in read for f in ("SUCURSAL", "ESPECIALIDAD", "PRESTACION"))
    times = scan.typed(spark.createDataFrame([("05/07/2026 09:30",)], "DIA_CITA string"), ["DIA_CITA"], moments=True).first()
    assert (str(times.DIA_CITA), str(times.DIA_CITA_at)) == ("2026-07-05", "2026-07-05 09:30:00")


def test_paths_stay_as_given(spark):
    assert registry.Tables(spark, "s3a://bucket/x/").directory == "s3a://bucket/x"


def test_checkpoint_folder_comes_from_the_session(spark):
    folder = session.ensure_checkpoint_dir(spark)
    assert session.ensure_checkpoint_dir(spark) == folder == spark.sparkContext.getCheckpointDir()
