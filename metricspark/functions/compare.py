"""Value comparison with three-way absence: present, blank, not readable."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Comparison statuses and what a zero meant on the other side.
MATCH = "MATCH"
MISMATCH = "MISMATCH"
ZERO_VS_BLANK = "ZERO_VS_BLANK_EQUIVALENT"
SOURCE_UNAVAILABLE = "SOURCE_UNAVAILABLE"
TARGET_UNAVAILABLE = "TARGET_UNAVAILABLE"
ZERO_ZERO = "SOURCE_ZERO_TARGET_ZERO"
ZERO_BLANK = "SOURCE_ZERO_TARGET_BLANK"
ZERO_OTHER = "SOURCE_ZERO_TARGET_OTHER"
ZERO_NOT_APPLICABLE = "NOT_APPLICABLE"
EXACT_MATCH = "EXACT_MATCH"
REAL_MISMATCH = "REAL_MISMATCH"
REFERENCE_UNAVAILABLE = "REFERENCE_UNAVAILABLE"


def compare_status(source: Column, target: Column, present: Column) -> tuple[Column, Column]:
    """``(status, zero_semantics)`` of a computed value against a form slot."""
    zero = F.coalesce(source == 0, F.lit(False))
    equal = F.coalesce(source == target, F.lit(False))
    status = (
        F.when(source.isNull(), SOURCE_UNAVAILABLE)
        .when(~present & zero, ZERO_VS_BLANK)
        .when(~present, TARGET_UNAVAILABLE)
        .when(equal, MATCH)
        .otherwise(MISMATCH)
    )
    zero_semantics = (
        F.when(~zero, ZERO_NOT_APPLICABLE)
        .when(~present, ZERO_BLANK)
        .when(equal, ZERO_ZERO)
        .otherwise(ZERO_OTHER)
    )
    return status, zero_semantics


def historical_status(calculated: Column, reference: Column, available: Column) -> Column:
    """Comparison with an earlier report: a readable blank against non-zero is a mismatch."""
    return (
        F.when(~available, REFERENCE_UNAVAILABLE)
        .when(reference.isNull() & (calculated == 0), ZERO_VS_BLANK)
        .when(reference.isNull(), REAL_MISMATCH)
        .when(calculated == reference, EXACT_MATCH)
        .otherwise(REAL_MISMATCH)
    )


def value_type_gate(value: Column, dtype: str, expected: Column) -> tuple[Column, Column]:
    """``(coerced, reason)``: only ``OK`` and ``COERCED_EXACT_FLOAT`` may be published.

    A whole float becomes a count; anything else is reported and never truncated.
    """
    count, numeric = expected == "INTEGER_COUNT", expected == "NUMERIC"
    if dtype == "boolean":
        reason = F.when(count, "BOOL_NOT_INTEGER_COUNT").when(numeric, "BOOL_NOT_NUMERIC")
    elif dtype in ("double", "float"):
        finite = value.isNotNull() & ~F.isnan(value) & (F.abs(value) != float("inf"))
        reason = (
            F.when(count & value.isNull(), "NON_NUMERIC")
            .when(count & ~finite, "NON_FINITE_FLOAT")
            .when(count & (value != F.floor(value)), "NON_INTEGER_FLOAT")
            .when(count & (value < 0), "NEGATIVE_COUNT")
            .when(count, "COERCED_EXACT_FLOAT")
            .when(numeric & ~finite, "NON_NUMERIC")
        )
    elif dtype in ("tinyint", "smallint", "int", "bigint"):
        reason = F.when((count | numeric) & value.isNull(), "NON_NUMERIC").when(
            count & (value < 0), "NEGATIVE_COUNT"
        )
    else:
        reason = F.when(count | numeric, "NON_NUMERIC")
    reason = F.coalesce(reason, F.lit("OK"))
    accepted = reason.isin("OK", "COERCED_EXACT_FLOAT")
    return F.when(accepted, value), reason
