"""Evidence read from labels: sex, age bounds, procedure codes, path agreement."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from metricspark import fixed_values as fixed
from metricspark.functions.text import normalize_label

# Evidence is a small number while pairs are compared and gets its name for the report.
NOT_APPLICABLE, MISSING, MISMATCH, PARTIAL, MATCH = range(5)
EVIDENCE_NAMES = ("NOT_APPLICABLE", "MISSING", "MISMATCH", "PARTIAL", "MATCH")
RESOLVED = ("CONFIRMED", "LABEL_ONLY", "FORMULA_ONLY")


def normal_path(path: Column) -> Column:
    """Normalised labels of a path, blank ones dropped."""
    return F.filter(F.transform(path, normalize_label), lambda x: x != "")


def _bound(label: Column, pattern: str, spec: str | None) -> Column:
    if spec is None:
        return F.lit(None).cast("int")
    if not spec.startswith("g"):
        return F.lit(int(spec))
    value = F.regexp_extract(label, pattern, int(spec[1])).try_cast("int")
    return value - 1 if spec.endswith("-1") else value


def parse_age_label(label: Column) -> Column:
    """``STRUCT<lo, hi>`` of a normalised age label, inclusive; null if it is none."""
    out = None
    for pattern, lo, hi in fixed.AGE_LABELS:
        bounds = F.struct(_bound(label, pattern, lo).alias("lo"), _bound(label, pattern, hi).alias("hi"))
        hit = label.rlike(pattern)
        out = F.when(hit, bounds) if out is None else out.when(hit, bounds)
    return out


def first_age(path: Column) -> Column:
    """Bounds of the first age label of a normalised path."""
    return F.filter(F.transform(path, parse_age_label), lambda x: x.isNotNull())


def sex_of(label: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in fixed.SEX_LABELS.items() for x in kv]), label)


def strip_sex_age(path: Column) -> Column:
    return F.filter(
        path, lambda x: ~x.isin(*fixed.SEX_LABELS)
        & ~x.rlike("|".join(f"(?:{p})" for p, _, _ in fixed.AGE_LABELS)))


def procedure_code(path: Column, low: int = fixed.PROCEDURE_DIGITS[0],
                   high: int = fixed.PROCEDURE_DIGITS[1]) -> Column:
    """``STRUCT<code, label>`` of the first explicit code; both ``""`` if there is none.

    Either ``code - text`` in one label, or a bare code whose text is the next label that
    is no code itself.
    """
    inline, bare = rf"^(\d{{{low},{high}}})\s*-\s*(.+)$", rf"^(\d{{{low},{high}}})$"
    either = f"{inline}|{bare}"
    labels = F.transform(path, lambda x: F.trim(x))
    at = F.array_position(F.transform(labels, lambda x: x.rlike(either)), True)
    hit = F.try_element_at(labels, F.when(at > 0, at.cast("int")))
    rest = F.filter(F.slice(labels, F.greatest(at, F.lit(1)).cast("int") + 1, F.size(labels) + 1),
                    lambda x: ~x.rlike(either))
    code = F.regexp_extract(hit, r"^(\d+)", 1)
    text = F.when(hit.rlike(inline), F.trim(F.regexp_extract(hit, inline, 2))).otherwise(
        F.coalesce(F.try_element_at(rest, F.lit(1)), F.lit("")))
    return F.struct(F.when(hit.isNull(), "").otherwise(code).alias("code"),
                    F.when(hit.isNull(), "").otherwise(text).alias("label"))


def intervals_overlap(a: Column, b: Column) -> Column:
    """Open ends never exclude; both arguments are ``STRUCT<lo, hi>``."""
    apart = F.coalesce(a["lo"] > b["hi"], F.lit(False)) | F.coalesce(b["lo"] > a["hi"], F.lit(False))
    return ~apart


def interval_consistency(label: Column, formula: Column) -> Column:
    return (
        F.when(label.isNull() | formula.isNull(), "NO_COMPARABLE")
        .when(intervals_overlap(label, formula), "CONSISTENT").otherwise("CONFLICT")
    )


def path_evidence(source: Column, target: Column) -> Column:
    """How far two label paths agree; a deeper path with the same leaf is the same row."""
    n, m = F.size(source), F.size(target)
    leaf = F.try_element_at(source, F.lit(-1)) == F.try_element_at(target, F.lit(-1))
    nested = (F.size(F.array_except(source, target)) == 0) | (F.size(F.array_except(target, source)) == 0)
    # Cheap tests first: set operations run only where one level each cannot decide.
    return (
        F.when((n == 0) & (m == 0), NOT_APPLICABLE).when((n == 0) | (m == 0), MISSING)
        .when(source == target, MATCH).when((n == 1) & (m == 1), MISMATCH)
        .when(leaf & nested, MATCH).when(leaf | F.arrays_overlap(source, target), PARTIAL)
        .otherwise(MISMATCH)
    )


def sex_evidence(value: Column, status: Column, target: Column) -> Column:
    return (
        F.when(~status.isin(*RESOLVED) | (value == "") | (target == ""), MISSING)
        .when(value == target, MATCH)
        .when((value == "BOTH") | (target == "BOTH"), PARTIAL).otherwise(MISMATCH)
    )


def age_evidence(lo: Column, hi: Column, status: Column, t_lo: Column, t_hi: Column) -> Column:
    known = status.isin(*RESOLVED) & (lo.isNotNull() | hi.isNotNull())
    t_known = t_lo.isNotNull() | t_hi.isNotNull()
    overlap = F.coalesce(F.greatest(lo, t_lo) <= F.least(hi, t_hi), F.lit(True))  # open ends never exclude
    return (
        F.when(~known | ~t_known, MISSING)
        .when(lo.eqNullSafe(t_lo) & hi.eqNullSafe(t_hi), MATCH)
        .when(overlap, PARTIAL).otherwise(MISMATCH)
    )


def code_evidence(source: Column, target: Column) -> Column:
    return (
        F.when((source == "") & (target == ""), NOT_APPLICABLE)
        .when((source == "") | (target == ""), MISSING)
        .when(source == target, MATCH).otherwise(MISMATCH)
    )


def pack(evidence: list[Column]) -> Column:
    """All dimensions of a pair in one number, three bits each."""
    return reduce(lambda a, b: a + b, [
        e.cast("bigint") * F.lit(8 ** i) for i, e in enumerate(evidence)])


def unpack(packed: Column, position: int) -> Column:
    return F.shiftright(packed, 3 * position).bitwiseAND(F.lit(7).cast("bigint")).cast("int")


def evidence_name(code: Column) -> Column:
    return F.get(F.array(*[F.lit(n) for n in EVIDENCE_NAMES]), code)


def score(evidence: dict[str, Column], weights: dict[str, float]) -> Column:
    """Weighted share of agreement over the dimensions both sides speak about."""
    total = reduce(lambda a, b: a + b, [
        F.when(e >= MISMATCH, float(weights[d])).otherwise(0.0) for d, e in evidence.items()])
    got = reduce(lambda a, b: a + b, [
        F.greatest(e - MISMATCH, F.lit(0)) * float(weights[d] / 2) for d, e in evidence.items()])
    return F.when(total > 0, F.round(got / total, 4)).otherwise(0.0)
