"""Validity, period and status scoping of detail records, with blocking diagnostics."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from metricspark import fixed_values as fixed
from metricspark.functions.dates import in_period, period_of
from metricspark.functions.text import status_key


@dataclass(frozen=True)
class RecordLayout:
    """Which typed field plays which part; ``<field>_blank`` flags must be present."""

    fields: tuple[str, ...] = fixed.REQUIRED_FIELDS + fixed.OPTIONAL_FIELDS
    service: str = "DIA_CITA"
    birth: str = "FECHA_NACIMIENTO"
    required_text: tuple[str, ...] = ("SEXO", "TIPO_DE_CITA")
    status: str = "ESTADO"

    def problems(self) -> list[tuple[str, str, str]]:
        """``(code, field, flag column)`` of everything that makes a record invalid."""
        return [
            (f"{self.service}_INVALID", self.service, "service_bad"),
            (f"{self.birth}_INVALID", self.birth, "birth_bad"),
            *[(f"{f}_EMPTY", f, f"{f}_empty") for f in self.required_text],
        ]


def scope_flags(df: DataFrame, layout: RecordLayout) -> DataFrame:
    """Validity masks as boolean columns plus the month of every dated record."""
    service, birth = F.col(layout.service), F.col(layout.birth)
    # a record with a readable service date cannot be empty: the other fields are not looked at
    empty = F.when(service.isNotNull(), F.lit(False)).otherwise(
        reduce(and_, [F.col(f"{f}_blank") for f in layout.fields]))
    active = ~F.col("structurally_empty")
    birth_given = ~F.col(f"{layout.birth}_blank")
    valid = service.isNotNull() & (~birth_given | birth.isNotNull())
    for f in layout.required_text:
        valid = valid & ~F.col(f"{f}_blank")
    flags = df.withColumn("structurally_empty", empty).withColumns({
        "service_bad": active & service.isNull(),
        "birth_bad": active & birth_given & birth.isNull(),
        **{f"{f}_empty": active & F.col(f"{f}_blank") for f in layout.required_text},
        "birth_after": active & birth_given & F.coalesce(birth > service, F.lit(False)),
        "period": period_of(service),
    })
    invalid = reduce(lambda a, b: a | b, [F.col(flag) for _, _, flag in layout.problems()])
    return flags.withColumn("invalid", invalid).withColumn("valid", valid)


def scope_counts(
    flags: DataFrame, layout: RecordLayout, start: str, end: str, labelled: Column
) -> DataFrame:
    """Scope totals of one period in a single pass, one row.

    ``labelled`` says whether a record falls into at least one category.
    """
    in_scope = F.col("valid") & in_period(F.col(layout.service), start, end)
    aged = in_scope & F.col(layout.birth).isNotNull()
    count = F.count_if
    totals = flags.agg(
        F.count(F.lit(1)).alias("physical_rows"),
        count("structurally_empty").alias("structural_empty_rows"),
        count(F.col("valid")).alias("valid_records"),
        count(F.col("invalid")).alias("invalid_records"),
        count(in_scope).alias("scope_records"),
        count(in_scope & labelled).alias("labelled_records"),
        count(in_scope & ~labelled).alias("unlabelled_records"),
        count(aged & ~F.col("birth_after")).alias("age_computed"),
        count(in_scope & F.col("birth_after")).alias("age_zero"),
        F.min(F.when(F.col("valid"), F.col(layout.service))).alias("first_date"),
        F.max(F.when(F.col("valid"), F.col(layout.service))).alias("last_date"),
    )
    return totals.withColumns({
        "total_records": F.col("physical_rows") - F.col("structural_empty_rows"),
        "out_of_period_records": F.col("valid_records") - F.col("scope_records"),
        "age_missing": F.col("scope_records") - F.col("age_computed") - F.col("age_zero"),
    }).withColumn(
        "consistent",
        (F.col("total_records") == F.col("valid_records") + F.col("invalid_records"))
        & (F.col("scope_records") <= F.col("valid_records"))
        & (F.col("labelled_records") + F.col("unlabelled_records") == F.col("scope_records")),
    )


def period_scope(flags: DataFrame, layout: RecordLayout, start: str, end: str) -> DataFrame:
    """Valid records of one period; other periods stay out of every metric."""
    return flags.filter(F.col("valid") & in_period(F.col(layout.service), start, end))


def period_breakdown(
    flags: DataFrame, layout: RecordLayout, start: str, end: str
) -> DataFrame:
    inside = F.col("valid") & in_period(F.col(layout.service), start, end)
    return flags.agg(
        F.count(F.lit(1)).alias("physical_records"),
        F.count_if("valid").alias("structurally_valid_records"),
        F.count_if(~F.col("valid")).alias("structurally_invalid_records"),
        F.count_if(inside).alias("in_period_records"),
        F.count_if(F.col("valid") & ~inside).alias("out_of_period_records"),
    )


def detect_periods(flags: DataFrame) -> DataFrame:
    return flags.filter("valid").select("period").distinct().orderBy("period")


def invalid_diagnostics(flags: DataFrame, layout: RecordLayout) -> DataFrame:
    """Per month: what blocks it. Records without a readable date block every month."""
    codes = [(code, flag) for code, _, flag in layout.problems()]
    by_period = flags.groupBy("period").agg(
        F.count_if("valid").alias("valid_records"),
        F.count_if("invalid").alias("own_invalid"),
        *[F.count_if(flag).alias(f"own_{code}") for code, flag in codes],
    )
    # One row per month remains, so the frame over all of them is small by construction.
    everywhere = Window.partitionBy()

    def with_undated(name: str) -> Column:
        return F.col(name) + F.coalesce(
            F.sum(F.when(F.col("period").isNull(), F.col(name))).over(everywhere), F.lit(0)
        )

    return (
        by_period.select(
            "period", "valid_records",
            with_undated("own_invalid").alias("invalid_records"),
            (with_undated("own_invalid") - F.col("own_invalid")).alias("unassigned_records"),
            *[with_undated(f"own_{code}").alias(code.lower()) for code, _ in codes],
        )
        .filter(F.col("period").isNotNull())
        .withColumn("period_scope_records", F.col("valid_records") + F.col("invalid_records"))
        .withColumn("blocked", F.col("invalid_records") > 0)
    )


def problem_counts(diagnostics: DataFrame, layout: RecordLayout) -> DataFrame:
    """The same diagnostics in long form, codes without a record omitted."""
    names = [code.lower() for code, _, _ in layout.problems()]
    return (
        diagnostics.unpivot(["period"], names, "code", "records")
        .filter("records > 0")
        .withColumn("code", F.upper("code"))
    )


@dataclass(frozen=True)
class StatusRule:
    """Allow-list of statuses; without confirmation or entries nothing is filtered."""

    included: tuple[str, ...] = fixed.INCLUDED_STATES
    confirmed: bool = True

    @property
    def applies(self) -> bool:
        return self.confirmed and bool(self.included)

    def keeps(self, c: Column) -> Column:
        if not self.applies:
            return F.lit(True)
        allowed = [s.strip().lower() for s in self.included]
        return F.coalesce(status_key(c).isin(*allowed), F.lit(False))


def status_filter(df: DataFrame, column: str, rule: StatusRule) -> DataFrame:
    return df.filter(rule.keeps(F.col(column)))


def row_problems(
    flags: DataFrame, layout: RecordLayout, row_id: str, limit: int | None = None
) -> DataFrame:
    """One row per (record, field, code), never with the value.

    All of them, unless a screen asks for the first ``limit`` in record order; then
    ``truncated`` says whether more exist.
    """
    entries = [*layout.problems(), ("BIRTH_AFTER_SERVICE", layout.birth, "birth_after")]
    listed = F.array(*[
        F.when(F.col(flag), F.struct(
            F.lit(i).alias("position"), F.lit(field).alias("field"), F.lit(code).alias("code")))
        for i, (code, field, flag) in enumerate(entries)
    ])
    found = flags.select(row_id, F.inline(F.array_compact(listed)))
    if limit is None:
        return found.select(row_id, "field", "code")
    first = found.orderBy(row_id, "position").limit(limit + 1)
    ranked = first.withColumn(
        "rank", F.row_number().over(Window.orderBy(row_id, "position"))
    ).withColumn("truncated", F.count(F.lit(1)).over(Window.partitionBy()) > limit)
    return ranked.filter(F.col("rank") <= limit).select(row_id, "field", "code", "truncated")


def blank_profile(df: DataFrame, fields: Sequence[str]) -> DataFrame:
    """Blank, filled and total cells per field in one pass."""
    n = len(fields)
    counted = df.agg(
        F.count(F.lit(1)).alias("total"),
        *[F.count_if(f"{f}_blank").alias(f"b{i}") for i, f in enumerate(fields)],
    )
    rows = F.array(*[
        F.struct(F.lit(f).alias("field"), F.col(f"b{i}").alias("blank"),
                 (F.col("total") - F.col(f"b{i}")).alias("filled"), F.col("total").alias("total"))
        for i, f in zip(range(n), fields)
    ])
    return counted.select(F.inline(rows))
