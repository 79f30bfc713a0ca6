"""Checks over metric values: IF-rules, padding sensitivity and population impact."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from metricspark.functions import criteria as C
from metricspark.functions.text import casefold_text
from metricspark.operators.metrics import Term, metric_counts
from metricspark.session import cut_lineage


def padding_sensitivity(facts: DataFrame, empty: Column, terms: Sequence[Term]) -> DataFrame:
    """Metrics that would count a structurally empty record, with the false count."""
    padded = facts.filter(empty).withColumn("period", F.lit("all"))
    return metric_counts(padded, terms).filter("value <> 0").select(
        "metric_id", F.col("value").alias("padded_count")
    )


def population_impact(
    facts: DataFrame, terms: Sequence[Term], kept: Column, *, period: str = "period"
) -> DataFrame:
    """The same metrics under all records and under ``kept`` ones, from one pass."""
    both = metric_counts(facts, terms, period=period, flags={"value_b": kept})
    return both.select(
        period, "metric_id", F.col("value").alias("value_a"), "value_b",
        (F.col("value") - F.col("value_b")).alias("delta"),
        ((F.col("value") != 0) & (F.col("value_b") == 0)).alias("went_to_zero"),
    ).filter("delta <> 0")


def impact_summary(impact: DataFrame, group: Mapping[str, Column]) -> DataFrame:
    return impact.groupBy(*[c.alias(n) for n, c in group.items()]).agg(
        F.count(F.lit(1)).alias("metrics_changed"),
        F.sum(F.abs("delta")).alias("sum_abs_delta"),
        F.count_if("went_to_zero").alias("went_to_zero"),
    )


def metric_checks(checks: DataFrame, values: DataFrame) -> DataFrame:
    """Evaluate ``IF(left op right, then, else)`` rows against metric values.

    ``checks`` has ``check_id``, ``op`` and a ``<side>_kind`` / ``<side>_ref`` pair for
    left, right (METRIC, NUM, STR), then and otherwise (also CHECK, a nested rule).
    ``=`` and ``<>`` with a text literal compare as text, everything else as numbers.
    The result is ``(check_id, supported, result)``.
    """
    known = values.select("metric_id", F.col("value").cast("string").alias("text"))

    def resolve(df: DataFrame, side: str) -> DataFrame:
        kind, ref = F.col(f"{side}_kind"), F.col(f"{side}_ref")
        found = known.select(F.col("metric_id").alias(f"{side}_key"), F.col("text").alias(f"{side}_text"),
                             F.lit(True).alias(f"{side}_found"))
        return (
            df.withColumn(f"{side}_key", F.when(kind == "METRIC", ref))
            .join(found, f"{side}_key", "left")
            .withColumns({
                f"{side}_value": F.when(kind == "METRIC", F.col(f"{side}_text")).otherwise(ref),
                f"{side}_ok": F.when(kind == "METRIC", F.coalesce(f"{side}_found", F.lit(False)))
                .otherwise(True),
            }).drop(f"{side}_key", f"{side}_text", f"{side}_found")
        )

    sides = resolve(resolve(checks, "left"), "right")
    op = F.col("op")
    text_mode = op.isin("=", "<>") & ((F.col("left_kind") == "STR") | (F.col("right_kind") == "STR"))
    same = casefold_text(F.col("left_value")) == casefold_text(F.col("right_value"))

    def number(side: str) -> Column:
        return C.to_number(F.col(f"{side}_value"), "string")

    left, right = number("left"), number("right")
    numeric = F.lit(None).cast("boolean")
    for o in ("=", "<>", "<", "<=", ">", ">="):
        numeric = F.when(op == o, C.compare_numbers(left, o, right)).otherwise(numeric)
    holds = F.when(text_mode, F.when(op == "=", same).otherwise(~same)).otherwise(numeric)
    decided = sides.withColumn("holds", F.when(F.col("left_ok") & F.col("right_ok"), holds)).select(
        "check_id", "holds",
        *[F.when(F.col("holds"), F.col(f"then_{x}")).when(~F.col("holds"), F.col(f"otherwise_{x}"))
          .alias(f"branch_{x}") for x in ("kind", "ref")],
    )
    flat = resolve(decided, "branch").select(
        "check_id",
        (F.col("branch_kind") == "CHECK").alias("nested"),
        F.col("branch_ref").alias("nested_id"),
        (F.col("holds").isNotNull() & F.col("branch_ok")).alias("supported"),
        F.col("branch_value").alias("result"),
    )
    # Nested rules take over the outcome of the rule they point to, level by level.
    pending = cut_lineage(flat.filter("coalesce(nested, false)").select("check_id", "nested_id"))
    done = cut_lineage(flat.filter("not coalesce(nested, false)").select("check_id", "supported", "result"))
    fresh = done
    while not pending.isEmpty() and not fresh.isEmpty():
        target = fresh.withColumnRenamed("check_id", "nested_id")
        fresh = cut_lineage(pending.join(target, "nested_id").select("check_id", "supported", "result"))
        pending = cut_lineage(pending.join(fresh, "check_id", "left_anti"))
        done = done.unionByName(fresh)
    dangling = pending.select(
        "check_id", F.lit(False).alias("supported"), F.lit(None).cast("string").alias("result"))
    out = done.unionByName(dangling)
    return out.select("check_id", "supported", F.when(F.col("supported"), F.col("result")).alias("result"))


def control_rollup(controls: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Errors per control, those from modules not produced yet, and the verdict."""
    total = F.sum("errors")
    return controls.groupBy(*keys).agg(
        F.sum("errors").alias("total_errors"),
        F.coalesce(F.sum(F.when(F.col("pending_module"), F.col("errors"))), F.lit(0))
        .alias("pending_errors"),
        F.when(total.isNull(), "UNAVAILABLE").when(total == 0, "PASS").otherwise("FAIL")
        .alias("verdict"),
    )
