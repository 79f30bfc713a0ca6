from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from metricspark.functions import compare, criteria, dates, labels, text


def column(spark, values, expr, ddl="x string"):
    df = spark.createDataFrame([(v,) for v in values], ddl)
    return [r[0] for r in df.select(expr).collect()]


def test_blank_and_normalise(spark):
    values = [None, "", " \t ", " ", "NaT", " nan ", "<NA>", "0", "Nan"]
    assert column(spark, values, text.is_blank(F.col("x"))) == [True] * 7 + [False, False]
    values = ["  Atención   médica ", "ñandú", None, "20 a 24 años", "Á"]
    assert column(spark, values, text.normalize_text(F.col("x"))) == [
        "ATENCION MEDICA", "NANDU", "", "20 A 24 ANOS", "A"]
    assert column(spark, ["Ñandú  X"], text.casefold_text(F.col("x"))) == ["ñandú  x"]
    assert text.header_key("  Fecha de  Atención. ") == "FECHA_DE_ATENCION"
    assert column(spark, ["Tipo de (cita)"], text.field_key(F.col("x"))) == ["TIPO_DE_CITA"]


def test_concat_text(spark):
    got = column(spark, [5.0, 2.5, None], text.concat_text(F.col("x"), "double"), "x double")
    assert got == ["5", "2.5", ""]
    assert column(spark, [True, None], text.concat_text(F.col("x"), "boolean"), "x boolean") == ["TRUE", ""]


def test_expression_key_keeps_literals(spark):
    assert column(spark, ['=SUM(A1,"Mixed  Case") + B2'], text.expression_key(F.col("x"))) == [
        '=sum(a1,"Mixed  Case") + b2']


def test_day_first_parsing(spark):
    values = ["05/07/2026", "5-7-2026", "2026-07-05", "5/7/2026 9:30", "31/02/2026", "no-es-fecha", "", None]
    got = column(spark, values, dates.parse_day_first(F.col("x")))
    day = dt.datetime(2026, 7, 5)
    assert got == [day, day, day, dt.datetime(2026, 7, 5, 9, 30), None, None, None, None]


@pytest.mark.parametrize("birth, service, age", [
    ("2004-02-29", "2005-02-28", 0), ("2004-02-29", "2005-03-01", 1), ("1990-07-10", "2026-07-10", 36),
    ("1990-07-11", "2026-07-10", 35), ("1990-07-09", "2026-07-10", 36), ("2027-01-01", "2026-07-10", 0),
    (None, "2026-07-10", None),
])
def test_completed_years(spark, birth, service, age):
    df = spark.createDataFrame([(birth, service)], "b string, s string")
    assert df.select(dates.age_years(F.to_date("b"), F.to_date("s"))).first()[0] == age


@pytest.mark.parametrize("raw, hits", [
    ("mujer", ["Mujer", "MUJER"]), ("*MED*", ["Consulta médica", "medir"][1:]), ("<>mujer", ["Hombre", None, "medir", "Consulta médica", "a*b", "12"]),
    ("a~*b", ["a*b"]), ("?2", ["12"]), (">=12", ["12"]), ("<>13", ["12"]), ("<>12", []),
])
def test_text_criteria(spark, raw, hits):
    values = ["Mujer", "MUJER", "Hombre", None, "medir", "Consulta médica", "a*b", "12"]
    df = spark.createDataFrame([(v,) for v in values], "x string")
    got = [r[0] for r in df.filter(criteria.matches(criteria.parse_criterion(raw), F.col("x"))).collect()]
    assert sorted(got, key=str) == sorted(hits, key=str)


def test_numeric_criteria_edges(spark):
    values = ["5d", "nan", "inf", " 7 ", "1e1", "", None, "1_0"]
    test = criteria.matches(criteria.parse_criterion("<>0"), F.col("x"))
    assert column(spark, values, test) == [False, False, False, True, True, False, False, True]
    with pytest.raises(criteria.UnsupportedCriterion):
        criteria.parse_criterion("<abc")


def test_reference_statuses(spark):
    rows = [(5, 5, True), (0, None, True), (0, 0, True), (5, 3, True), (5, None, True), (5, None, False)]
    df = spark.createDataFrame(rows, "c int, r int, a boolean")
    got = [r[0] for r in df.select(compare.historical_status(F.col("c"), F.col("r"), F.col("a"))).collect()]
    assert got == ["EXACT_MATCH", "ZERO_VS_BLANK_EQUIVALENT", "EXACT_MATCH", "REAL_MISMATCH", "REAL_MISMATCH",
                   "REFERENCE_UNAVAILABLE"]


def test_value_type_gate(spark):
    df = spark.createDataFrame([(3.0,), (2.5,), (-1.0,), (float("nan"),), (None,)], "v double")
    value, reason = compare.value_type_gate(F.col("v"), "double", F.lit("INTEGER_COUNT"))
    assert [tuple(r) for r in df.select(value, reason).collect()] == [
        (3.0, "COERCED_EXACT_FLOAT"), (None, "NON_INTEGER_FLOAT"), (None, "NEGATIVE_COUNT"),
        (None, "NON_FINITE_FLOAT"), (None, "NON_NUMERIC")]


@pytest.mark.parametrize("label, bounds", [
    ("20 A 24 AÑOS", (20, 24)), ("Menos de 1 año - 1 año", (0, 1)), ("Menor de 15 años", (None, 14)),
    ("75 y más años", (75, None)), ("15 - 19", (15, 19)), ("5 años", (5, 5)), ("Total", None),
])
def test_age_labels(spark, label, bounds):
    got = column(spark, [label], labels.parse_age_label(text.normalize_label(F.col("x"))))[0]
    assert (tuple(got) if got else None) == bounds


@pytest.mark.parametrize("path, found", [
    (["5010009 - VIDRIO", "x"], ("5010009", "VIDRIO")), (["A", "0101316", "123456", "Consulta"], ("0101316", "Consulta")),
    (["12345"], ("12345", "")), (["99 - corto"], ("", "")), ([], ("", "")),
])
def test_procedure_code(spark, path, found):
    df = spark.createDataFrame([(path,)], "p array<string>")
    assert tuple(df.select(labels.procedure_code(F.col("p")).alias("c")).first()[0]) == found


@pytest.mark.parametrize("a, b, expected", [
    (["X"], ["X"], "MATCH"), (["G", "X"], ["X"], "MATCH"), (["X", "Y"], ["X"], "PARTIAL"), (["X"], ["Y"], "MISMATCH"),
    ([], ["Y"], "MISSING"), ([], [], "NOT_APPLICABLE"), (["A", "X"], ["B", "X"], "PARTIAL"),
])
def test_path_evidence(spark, a, b, expected):
    df = spark.createDataFrame([(a, b)], "a array<string>, b array<string>")
    assert df.select(labels.evidence_name(labels.path_evidence(F.col("a"), F.col("b")))).first()[0] == expected
