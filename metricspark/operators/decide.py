"""Decision layers: inference from two sources, readiness and write readiness."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from metricspark import fixed_values as fixed
from metricspark.functions import labels as L
from metricspark.functions.text import ANY_CASE, normalize_label
from metricspark.session import evaluate_once

DIMENSIONS = ("form", "row_path", "aggregation_scope", "sex", "age", "procedure")


def infer_two_source(labels: Column, criteria: Column) -> Column:
    """``STRUCT<value, status, conflict>`` of sex from column labels and criteria.

    Disagreement is reported with the label's value and never repaired.
    """
    by_label = F.array_distinct(F.array_compact(F.transform(
        labels, lambda x: F.try_element_at(F.create_map(*[
            F.lit(y) for kv in fixed.SEX_LABELS.items() for y in kv]), normalize_label(x)))))
    by_criterion = F.array_compact(F.array(*[
        F.when(F.exists(criteria, lambda c: F.lower(c).contains(part)), F.lit(value))
        for part, value in fixed.SEX_CRITERIA.items()]))
    label, criterion = F.get(by_label, F.lit(0)), F.get(by_criterion, F.lit(0))
    n_label, n_criterion = F.size(by_label), F.size(by_criterion)
    status = (
        F.when(n_label > 1, "CONFLICT")
        .when((n_label == 1) & (n_criterion == 1) & (label == criterion), "CONFIRMED")
        .when((n_label == 1) & (n_criterion == 1), "CONFLICT")
        .when(n_label == 1, "LABEL_ONLY").when(n_criterion == 1, "FORMULA_ONLY")
        .when(n_criterion > 1, "UNRESOLVED").otherwise("NOT_APPLICABLE")
    )
    value = F.when(n_label > 1, "").when(n_label == 1, label).when(n_criterion == 1, criterion).otherwise("")
    conflict = F.when(n_label > 1, "SEX_LABELS_DISAGREE").when(
        (n_label == 1) & (n_criterion == 1) & (label != criterion), "SEX_LABEL_FORMULA_MISMATCH")
    return F.struct(value.alias("value"), status.alias("status"), conflict.alias("conflict"))


def infer_interval(label: Column, formula: Column, ambiguous: Column) -> Column:
    """``STRUCT<lo, hi, status, conflict>`` of ages; the label's bounds are kept."""
    agree = L.interval_consistency(label, formula)
    status = (
        F.when(agree == "CONSISTENT", "CONFIRMED").when(agree == "CONFLICT", "CONFLICT")
        .when(label.isNotNull(), "LABEL_ONLY").when(formula.isNotNull(), "FORMULA_ONLY")
        .when(ambiguous, "UNRESOLVED").otherwise("NOT_APPLICABLE")
    )
    chosen = F.coalesce(label, formula)
    return F.struct(
        chosen["lo"].alias("lo"), chosen["hi"].alias("hi"), status.alias("status"),
        F.when(agree == "CONFLICT", "AGE_LABEL_FORMULA_DISJOINT").alias("conflict"))


def formula_bounds(predicates: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Tightest age bounds per metric from ``(*keys, op, number)`` predicate rows."""
    op, n = F.col("op"), F.col("number").cast("int")
    low = F.when(op.isin(">=", "=", ""), n).when(op == ">", n + 1)
    high = F.when(op.isin("<=", "=", ""), n).when(op == "<", n - 1)
    return predicates.groupBy(*keys).agg(F.max(low).alias("lo"), F.min(high).alias("hi"))


def with_formula_age(metrics: DataFrame, predicates: DataFrame) -> DataFrame:
    """Adds ``formula_age``, the bounds that a metric's own age predicates set, for ``map_metrics``."""
    bounds = formula_bounds(predicates, ["metric_id"]).filter("lo IS NOT NULL OR hi IS NOT NULL")
    return metrics.join(bounds.select("metric_id", F.struct("lo", "hi").alias("formula_age")), "metric_id", "left")


def aggregation_scope(columns: Column, row: Column, own_header: Column, detailed: Column) -> Column:
    """``STRUCT<scope, status>``: a TOTAL column, a header row, or a detail cell."""
    header = own_header | ((F.size(row) == 1) & F.coalesce(F.get(row, F.lit(0)).rlike(ANY_CASE + fixed.GROUP_HEADER), F.lit(False)))
    total = F.exists(columns, lambda x: normalize_label(x) == "TOTAL")
    return F.struct(
        F.when(total, "TOTAL").when(header, "SUBTOTAL").otherwise("DETAIL").alias("scope"),
        F.when(total | header | detailed, "CONFIRMED").otherwise("UNRESOLVED").alias("status"))


def mapping_status(sex: Column, age: Column, scope: Column, conflict: Column) -> Column:
    fine = ("CONFIRMED", "NOT_APPLICABLE")
    return (
        F.when(conflict, "CONFLICT")
        .when(sex.isin(*fine) & age.isin(*fine) & (scope == "CONFIRMED"), "CONFIRMED").otherwise("PARTIAL"))


def map_metrics(metrics: DataFrame) -> DataFrame:
    """Semantic reading of metrics from their label paths and criteria.

    Input: ``metric_id, form, row_path, column_path, criteria`` (arrays), ``formula_age``
    (struct), ``context_status, own_header``. Labels are read once per row, in steps that the
    optimizer does not copy into the flags that use them.
    """
    labels = evaluate_once(metrics.withColumn("__labels", L.normal_path(F.col("column_path"))), ["__labels"])
    read = evaluate_once(labels.withColumns({
        "sex": infer_two_source(F.col("column_path"), F.col("criteria")),
        "__age": F.get(L.first_age(F.col("__labels")), F.lit(0)), "proc": L.procedure_code(F.col("row_path")),
    }), ["sex", "__age", "proc"])
    read = evaluate_once(read.withColumn("age", infer_interval(
        F.col("__age"), F.col("formula_age"), F.col("context_status") == "AMBIGUOUS")), ["age"])
    known = F.col("sex.status").isin(*L.RESOLVED) | F.col("age.status").isin(*L.RESOLVED)
    scoped = evaluate_once(read.withColumn("scope", aggregation_scope(
        F.col("column_path"), F.col("row_path"), F.col("own_header"), known | (F.col("proc.code") != ""))), ["scope"])
    conflict = F.col("sex.conflict").isNotNull() | F.col("age.conflict").isNotNull()
    procedure = F.when(F.col("proc.code") != "", "EXPLICIT").when(
        F.col("scope.scope").isin(*fixed.ROLLUP_SCOPES), "NOT_APPLICABLE").otherwise("UNRESOLVED")
    return scoped.select(
        "metric_id", "form", "row_path",
        F.col("sex.value").alias("sex_value"), F.col("sex.status").alias("sex_status"),
        F.col("sex.conflict").alias("sex_conflict"),
        F.col("age.lo").alias("age_lo"), F.col("age.hi").alias("age_hi"),
        F.col("age.status").alias("age_status"), F.col("age.conflict").alias("age_conflict"),
        F.col("scope.scope").alias("aggregation_scope"), F.col("scope.status").alias("scope_status"),
        F.col("proc.code").alias("procedure_code"), F.col("proc.label").alias("procedure_label"),
        procedure.alias("procedure_status"),
        mapping_status(F.col("sex.status"), F.col("age.status"), F.col("scope.status"), conflict)
        .alias("mapping_status"),
    )


@dataclass(frozen=True)
class ReadinessPolicy:
    """Required dimensions per form for detail cells, with a default; roll-ups use the default."""

    default: tuple[str, ...] = ("form", "row_path", "aggregation_scope")
    by_form: Mapping[str, tuple[str, ...]] = field(default_factory=dict)
    overrides: tuple[str, ...] = ()
    #: Column that overrides are matched by: an id, or a semantic signature that outlives ids.
    override_on: str = "metric_id"

    def required(self, dimension: str, form: Column, rollup: Column) -> Column:
        special = [f for f in self.by_form]
        named = [f for f, dims in self.by_form.items() if dimension in dims]
        detail = F.when(
            form.isin(*special), form.isin(*named) if named else F.lit(False)
        ).otherwise(dimension in self.default) if special else F.lit(dimension in self.default)
        return F.when(rollup, dimension in self.default).otherwise(detail)


_OPEN = ("LABEL_ONLY", "FORMULA_ONLY", "UNRESOLVED", "MISSING")


def readiness(mapped: DataFrame, policy: ReadinessPolicy) -> DataFrame:
    """Adds ``readiness_status``, the issues found and whether an override is on file.

    Conflicts always block, roll-ups are not filled in, open required dimensions go to
    review. An override is recorded and changes nothing.
    """
    rollup = F.col("aggregation_scope").isin(*fixed.ROLLUP_SCOPES)
    status = {
        "form": F.when(F.coalesce("form", F.lit("")) != "", "RESOLVED").otherwise("MISSING"),
        "row_path": F.when(F.size("row_path") > 0, "RESOLVED").otherwise("MISSING"),
        "aggregation_scope": F.col("scope_status"), "sex": F.col("sex_status"),
        "age": F.col("age_status"), "procedure": F.col("procedure_status"),
    }

    def issue(dimension: str, kind: Column, severity: Column) -> Column:
        return F.struct(F.lit(dimension.upper()).alias("dimension"), kind.alias("issue_type"),
                        severity.alias("severity"))

    found = [
        F.when(F.col(f"{d}_conflict").isNotNull(), issue(d, F.col(f"{d}_conflict"), F.lit("BLOCKING")))
        for d in ("sex", "age")
    ] + [
        F.when(status[d].isin(*_OPEN), issue(
            d, F.concat(F.lit(f"{d.upper()}_"), status[d]),
            F.when(policy.required(d, F.col("form"), rollup), "REVIEW").otherwise("INFO")))
        for d in DIMENSIONS
    ]
    out = evaluate_once(mapped.withColumn("issues", F.array_compact(F.array(*found))), ["issues"])
    has = lambda s: F.exists("issues", lambda x: x["severity"] == s)
    reasons = F.array_sort(F.array_distinct(F.transform(
        F.filter("issues", lambda x: x["severity"] != "INFO"), lambda x: x["issue_type"])))
    override = F.coalesce(F.col(policy.override_on).isin(*policy.overrides), F.lit(False)) if policy.overrides else F.lit(False)
    return out.withColumns({
        "readiness_status": F.when(has("BLOCKING"), "BLOCKED_CONFLICT").when(rollup, "NOT_APPLICABLE")
        .when(has("REVIEW"), "REVIEW_REQUIRED").otherwise("AUTO_READY"),
        "review_reasons": F.array_join(reasons, "|"),
        "override_matched": override,
    })


@dataclass(frozen=True)
class WritePolicy:
    """Gates of the write decision; required evidence of a strong match may vary by form."""

    native: str = "NATIVE"
    foreign: tuple[str, ...] = ()
    strong_default: tuple[str, ...] = ("SECTION", "ROW_PATH", "COLUMN_PATH")
    strong_by_form: Mapping[str, tuple[str, ...]] = field(default_factory=dict)


def write_readiness(rows: DataFrame, policy: WritePolicy) -> DataFrame:
    """Adds ``write_status``, ``write_reason`` and missing evidence of aligned rows.

    Gates run in order: eligibility, match, cell role, lock, expected source, value type,
    evidence. Needs ``readiness_status, outcome, target_kind, target_role, locked,
    expectation, target_num, target_txt, form, ev_*``. Where ``expected_value_type`` is TEXT,
    text fits and a number does not; without that column numbers are expected. Collisions are
    a separate step.
    """
    from metricspark.operators.align import EVIDENCE

    ev = {d: F.col(f"ev_{d.lower()}") for d in EVIDENCE}
    mismatched = F.array_compact(F.array(*[F.when(e == "MISMATCH", F.lit(d)) for d, e in ev.items()]))

    def lacking(dims: Sequence[str]) -> Column:
        return F.array_compact(F.array(*[
            F.when(~ev[d].isin("MATCH", "NOT_APPLICABLE"), F.lit(d)) for d in dims]))

    missing = lacking(policy.strong_default)
    for form, dims in policy.strong_by_form.items():
        missing = F.when(F.col("form") == form, lacking(dims)).otherwise(missing)
    # Both lists are read by the gates and by the report.
    rows = evaluate_once(rows.withColumns({"__mismatched": mismatched, "__missing": missing}))
    mismatched, missing = F.col("__mismatched"), F.col("__missing")
    gate = lambda status, reason: F.struct(F.lit(status).alias("s"), F.lit(reason).alias("r"))
    outcome, kind = F.col("outcome"), F.col("target_kind")
    text_there = F.coalesce(F.col("target_txt"), F.lit("")) != ""
    unfit = text_there
    if "expected_value_type" in rows.columns:
        unfit = F.when(F.upper("expected_value_type").eqNullSafe("TEXT"), F.col("target_num").isNotNull()).otherwise(text_there)
    decision = (
        F.when(~F.coalesce(F.col("readiness_status") == "AUTO_READY", F.lit(False)),
               gate("NOT_WRITABLE", "SOURCE_REVIEW_REQUIRED"))
        .when(outcome == "AMBIGUOUS", gate("WRITE_BLOCKED", "MATCH_AMBIGUOUS"))
        .when(outcome == "CONFLICT", gate("WRITE_BLOCKED", "DIMENSION_CONFLICT"))
        .when(kind == "FORMULA_TARGET", gate("NOT_WRITABLE", "TARGET_IS_FORMULA"))
        .when(kind != "DIRECT_INPUT_TARGET", gate("NOT_WRITABLE", "TARGET_NOT_INPUT_CELL"))
        .when(F.col("target_role") != "INPUT_TARGET", gate("NOT_WRITABLE", "TARGET_ROLE_NOT_INPUT"))
        .when(F.coalesce("locked", F.lit(True)), gate("WRITE_BLOCKED", "TARGET_LOCKED"))
        .when(F.col("expectation").isin(*policy.foreign) if policy.foreign else F.lit(False),
              gate("WRITE_BLOCKED", f"TARGET_SOURCE_NOT_{policy.native}"))
        .when(F.col("expectation") != policy.native,
              gate("WRITE_REVIEW_REQUIRED", "TARGET_SOURCE_EXPECTATION_UNKNOWN"))
        .when(unfit, gate("WRITE_REVIEW_REQUIRED", "EXPECTED_VALUE_TYPE_INCOMPATIBLE"))
        .when(outcome == "EXACT_SEMANTIC_MATCH", gate("WRITE_READY", "EXACT_ALL_DIMENSIONS_MATCH"))
        .when(outcome != "STRONG_MATCH", gate("WRITE_REVIEW_REQUIRED", "UNHANDLED_MATCH_STATUS"))
        .when(F.size(mismatched) > 0, gate("WRITE_REVIEW_REQUIRED", "STRONG_DIMENSION_MISMATCH"))
        .when(F.size(missing) > 0, gate("WRITE_REVIEW_REQUIRED", "STRONG_MISSING_REQUIRED_DIMENSION"))
        .otherwise(gate("WRITE_READY", "STRONG_REQUIRED_DIMENSIONS_MATCH"))
    )
    lack = F.when(F.col("write_reason") == "STRONG_DIMENSION_MISMATCH", mismatched).when(
        F.col("write_reason") == "STRONG_MISSING_REQUIRED_DIMENSION", missing).otherwise(
        F.array().cast("array<string>"))
    return rows.withColumn("__gate", decision).withColumns({
        "write_status": F.col("__gate.s"), "write_reason": F.col("__gate.r"),
    }).withColumn("missing_evidence", lack).drop("__gate", "__mismatched", "__missing")


def apply_collisions(rows: DataFrame) -> DataFrame:
    """Blocks every candidate that takes part in a collision of targets or sources."""
    from metricspark.operators.manifest import block_collisions

    pool = rows.filter(F.col("write_status").isin("WRITE_READY", "WRITE_REVIEW_REQUIRED"))
    hit = block_collisions(pool.select(
        "metric_id", F.col("target_cell").alias("target"), F.lit(None).cast("string").alias("instruction_id"))
    ).filter("blocked").select("metric_id").distinct().withColumn("collides", F.lit(True))
    candidate = F.col("write_status").isin("WRITE_READY", "WRITE_REVIEW_REQUIRED")
    down = candidate & F.coalesce("collides", F.lit(False))
    return rows.join(hit, "metric_id", "left").withColumns({
        "write_reason": F.when(down, "WRITE_COLLISION").otherwise(F.col("write_reason")),
        "write_status": F.when(down, "WRITE_BLOCKED").otherwise(F.col("write_status")),
    }).drop("collides")
