"""Multiset reconciliation, reference comparison and the statistics over it."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from metricspark import fixed_values as fixed
from metricspark.functions import compare as cmp
from metricspark.functions.text import normalize_text, trim_ws
from metricspark.operators.summary import grouped_counts
from metricspark.session import cut_lineage

#: Quantile slices of the id range, each cut into equal parts: a hot fingerprint is
#: spread over slices * parts groups.
_SLICES = 64
_PARTS = 1024


def fingerprint(fields: Sequence[str], dates: Sequence[str] = ()) -> Column:
    """Fields joined by ``|``: dates as ISO days, text trimmed, blank markers empty."""
    def part(name: str) -> Column:
        if name in dates:
            return F.coalesce(F.date_format(F.col(name), "yyyy-MM-dd"), F.lit(""))
        text = trim_ws(F.col(name).cast("string"))
        blank = F.lower(text).isin("", "nan", "nat", "none", "<na>")
        return F.coalesce(F.when(~blank, text), F.lit(""))

    return F.concat_ws("|", *[part(f) for f in fields])


def _paired_counts(subset: DataFrame, superset: DataFrame, key: Column) -> DataFrame:
    """Multiplicity of each fingerprint on both sides from one shuffle."""
    tagged = subset.select(key.alias("fp"), F.lit(1).alias("s"), F.lit(0).alias("t")).unionByName(
        superset.select(key.alias("fp"), F.lit(0).alias("s"), F.lit(1).alias("t")))
    return tagged.groupBy("fp").agg(F.sum("s").alias("n_sub"), F.sum("t").alias("n_super"))


def multiset_check(subset: DataFrame, superset: DataFrame, key: Column) -> DataFrame:
    """One row: matched, unmatched and excess records counted with multiplicity."""
    zero = F.lit(0).cast("bigint")
    return _paired_counts(subset, superset, key).agg(
        F.coalesce(F.sum("n_sub"), zero).alias("subset_records"),
        F.coalesce(F.sum("n_super"), zero).alias("superset_records"),
        F.coalesce(F.sum(F.least("n_sub", "n_super")), zero).alias("matched"),
        F.coalesce(F.sum(F.greatest(F.col("n_sub") - F.col("n_super"), zero)), zero).alias("unmatched"),
        F.coalesce(F.sum(F.greatest(F.col("n_super") - F.col("n_sub"), zero)), zero).alias("excess"),
    ).withColumn("is_exact_subset", F.col("unmatched") == 0)


def _ordered_bins(df: DataFrame, row_id: str) -> Column:
    """Bin number that grows with a numeric id, fine enough for any spread of ids."""
    cuts = [i / _SLICES for i in range(_SLICES + 1)]
    points = df.select(F.percentile_approx(row_id, cuts, 10_000)).first()[0]
    if not points:
        return F.lit(0)
    points = sorted(set(points))
    bounds, value = points[1:-1], F.col(row_id)

    def search(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(value < F.lit(bounds[mid]), search(lo, mid)).otherwise(search(mid + 1, hi))

    at = search(0, len(bounds))
    low = F.element_at(F.array(*[F.lit(float(x)) for x in [points[0], *bounds]]), at + 1)
    high = F.element_at(F.array(*[F.lit(float(x)) for x in [*bounds, points[-1]]]), at + 1)
    part = F.floor((value - low) / F.greatest(high - low, F.lit(1e-9)) * _PARTS)
    return at * _PARTS + F.greatest(F.lit(0), F.least(part, F.lit(_PARTS - 1)))


def multiset_excess(superset: DataFrame, subset: DataFrame, key: Column, row_id: str) -> DataFrame:
    """Records of ``superset`` beyond the multiplicity of ``subset``, in ``row_id`` order.

    Copies of one fingerprint may be a large part of the data, so they are never ranked
    in one task. Numeric ids are cut into bins; bins wholly covered by the other side are
    dropped, bins wholly beyond it kept, and only the one bin per fingerprint where the
    allowance runs out is ranked record by record.
    """
    binned = superset.withColumn("fp", key).withColumn("bin", _ordered_bins(superset, row_id))
    per_bin = binned.groupBy("fp", "bin").agg(F.count(F.lit(1)).alias("n"))
    allowance = subset.groupBy(key.alias("fp")).agg(F.count(F.lit(1)).alias("allowed"))
    before = Window.partitionBy("fp").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    # At most one row per (fingerprint, bin) is windowed here.
    quota = per_bin.join(allowance, "fp", "left").select(
        "fp", "bin", "n",
        (F.coalesce("allowed", F.lit(0)) - F.coalesce(F.sum("n").over(before), F.lit(0))).alias("left"),
    ).filter("left < n").select("fp", "bin", F.greatest("left", F.lit(0)).alias("skip"))
    candidates = binned.join(quota, ["fp", "bin"])
    whole = candidates.filter("skip = 0")
    rank = F.row_number().over(Window.partitionBy("fp", "bin").orderBy(row_id))
    partial = candidates.filter("skip > 0").withColumn("__rank", rank).filter(
        F.col("__rank") > F.col("skip")).drop("__rank")
    return whole.unionByName(partial).drop("fp", "bin", "skip")


def symmetric_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows in only one result, with multiplicity, and the side they are on."""
    columns = a.columns
    tagged = a.withColumn("__d", F.lit(1)).unionByName(b.withColumn("__d", F.lit(-1)))
    surplus = tagged.groupBy(*columns).agg(F.sum("__d").alias("__d")).filter("__d <> 0")
    return surplus.select(
        *columns, F.when(F.col("__d") > 0, "LEFT").otherwise("RIGHT").alias("side"),
        F.abs("__d").alias("copies"))


def label_counts(df: DataFrame, fields: Sequence[str], blank: str = fixed.EMPTY_LABEL) -> DataFrame:
    """``(field, label, n)`` over several fields in one pass."""
    def clean(name: str) -> Column:
        text = trim_ws(F.col(name).cast("string"))
        return F.when(F.coalesce(F.lower(text), F.lit("")).isin("", "nan", "nat", "none", "<na>"), blank
                      ).otherwise(text)

    cells = F.array(*[F.struct(F.lit(f).alias("field"), clean(f).alias("label")) for f in fields])
    return df.select(F.inline(cells)).groupBy("field", "label").agg(F.count(F.lit(1)).alias("n"))


def reconcile(
    direct: DataFrame, earlier: DataFrame, *, fields: Sequence[str], status: str,
    dates: Sequence[str], row_id: str, kept: Column, describe: Sequence[str],
) -> DataFrame:
    """Long report ``(section, field, label, n)``: is the earlier detail a subset of the
    direct export, with and without the status, and who are the records left out."""
    without = fingerprint([f for f in fields if f != status], dates)
    # Each side is read by several checks; one period of it is stored once.
    direct, earlier = cut_lineage(direct), cut_lineage(earlier)

    def section(name: str, check: DataFrame) -> DataFrame:
        names = ["subset_records", "superset_records", "matched", "unmatched", "excess"]
        return check.unpivot([], names, "label", "n").select(
            F.lit(name).alias("section"), F.lit("").alias("field"), "label", "n")

    excess = multiset_excess(direct, earlier, without, row_id)
    states = direct.agg(F.count_if(kept).alias("kept"), F.count_if(~kept).alias("dropped"))
    return (
        section("with_status", multiset_check(earlier, direct, fingerprint(fields, dates)))
        .unionByName(section("without_status", multiset_check(earlier, direct, without)))
        .unionByName(states.unpivot([], ["kept", "dropped"], "label", "n").select(
            F.lit("status_rule").alias("section"), F.lit("").alias("field"), "label", "n"))
        .unionByName(label_counts(excess, describe).select(
            F.lit("excess").alias("section"), "field", "label", "n"))
    )


def reference_compare(
    computed: DataFrame, reference: DataFrame, periods: DataFrame, *, key: Sequence[str]
) -> DataFrame:
    """Computed values against earlier reports for all periods at once.

    ``periods``: ``(period, available, ok)``. A period whose invariants fail is left out:
    nothing is compared for it.
    """
    joined = (
        computed.join(periods.filter("ok").drop("ok"), "period")
        .join(reference.select("period", *key, "reference"), ["period", *key], "left")
    )
    available = F.coalesce("available", F.lit(False))
    shown = F.when(available, F.col("reference"))
    return joined.select(
        "period", *key, *[c for c in computed.columns if c not in ("period", "calculated", *key)],
        "calculated", shown.alias("reference"), available.alias("available"),
        cmp.historical_status(F.col("calculated"), shown, available).alias("status"),
        (shown - F.col("calculated")).alias("delta"),
    )


def status_counts() -> dict[str, Column]:
    status = F.col("status")
    return {
        "exact_match": status == cmp.EXACT_MATCH,
        "zero_vs_blank": status == cmp.ZERO_VS_BLANK,
        "real_mismatch": status == cmp.REAL_MISMATCH,
        "unavailable": status == cmp.REFERENCE_UNAVAILABLE,
    }


def equivalence_rate() -> Column:
    """Share of agreeing cells; unavailable ones stay in the denominator."""
    return F.round((F.col("exact_match") + F.col("zero_vs_blank")) / F.col("compared"), 4)


def multi_axis_summary(compared: DataFrame, axes: Mapping[str, Column]) -> DataFrame:
    return grouped_counts(compared, axes, status_counts()).withColumn(
        "equivalence_rate", equivalence_rate())


def period_summary(compared: DataFrame) -> DataFrame:
    counts = status_counts()
    return compared.groupBy("period").agg(
        F.count(F.lit(1)).alias("compared"), *[F.count_if(c).alias(n) for n, c in counts.items()]
    ).withColumn("equivalence_rate", equivalence_rate())


def mismatch_stats(compared: DataFrame, group: str, dependency: Column) -> DataFrame:
    """Mismatches per group and overall, split by a dependency, with delta statistics."""
    rows = compared.filter(F.col("status") != cmp.REFERENCE_UNAVAILABLE).withColumn("dep", F.coalesce(dependency, F.lit(False)))
    wrong = F.col("status") == cmp.REAL_MISMATCH
    delta = F.when(wrong, F.col("delta"))
    stats = rows.groupingSets([[group], []], group).agg(
        F.count_if(wrong).alias("real_mismatch"),
        F.count_if(wrong & F.col("dep")).alias("dependent_mismatch"),
        F.count_if("dep").alias("dependent_compared"),
        F.count_if(~F.col("dep")).alias("independent_compared"),
        F.count(delta).alias("delta_count"),
        F.count_if(wrong & F.col("reference").isNull()).alias("blank_reference"),
        F.min(delta).alias("delta_min"), F.max(delta).alias("delta_max"),
        F.avg(delta).alias("delta_mean"),
        F.count_if(delta > 0).alias("reference_greater"),
        F.count_if(delta < 0).alias("reference_less"),
        F.grouping_id().alias("gid"),
    )
    rate = F.try_divide
    return stats.withColumns({
        group: F.when(F.col("gid") == 1, "ALL").otherwise(F.col(group)),
        "rate_dependent": rate(F.col("dependent_mismatch"), F.col("dependent_compared")),
        "rate_independent": rate(F.col("real_mismatch") - F.col("dependent_mismatch"),
                                 F.col("independent_compared")),
    }).drop("gid")


def mismatch_axes(compared: DataFrame, axes: Mapping[str, Column]) -> DataFrame:
    """Of all mismatches, how many depend on each axis."""
    wrong = compared.filter(F.col("status") == cmp.REAL_MISMATCH).agg(
        F.count(F.lit(1)).alias("TOTAL"), *[F.count_if(c).alias(n) for n, c in axes.items()])
    return wrong.unpivot([], ["TOTAL", *axes], "axis", "mismatches")


def equivalence(values: DataFrame) -> DataFrame:
    """Adds status and zero semantics to rows ``(source, target, present)``."""
    status, zero = cmp.compare_status(F.col("source"), F.col("target"), F.col("present"))
    return values.withColumn("status", status).withColumn("zero_semantics", zero)


def mismatch_clusters(rows: DataFrame, keys: Sequence[str], example: str) -> DataFrame:
    """Disagreeing rows grouped by their explanation, with delta range and an example."""
    delta = F.col("target") - F.col("source")
    return rows.filter(~F.col("status").isin(cmp.MATCH, cmp.ZERO_VS_BLANK)).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.min(delta).alias("delta_min"),
        F.max(delta).alias("delta_max"), F.min(example).alias("example"),
    )


def zero_policy(rows: DataFrame, keys: Sequence[str] = (), *, declared: str = "UNRESOLVED",
                min_cases: int = fixed.ZERO_MIN_CASES,
                min_ratio: float = fixed.ZERO_MIN_RATIO) -> DataFrame:
    """What the evidence says about writing zeros, next to what is declared.

    Too few or contradicting cases stay unresolved; the declared policy is never changed.
    """
    zero = F.col("zero_semantics")
    counted = rows.filter(zero != cmp.ZERO_NOT_APPLICABLE).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("cases"),
        F.count_if(zero == cmp.ZERO_ZERO).alias("target_zero"),
        F.count_if(zero == cmp.ZERO_BLANK).alias("target_blank"),
        F.count_if(zero == cmp.ZERO_OTHER).alias("target_other"),
    )
    decided = F.col("target_zero") + F.col("target_blank")
    enough = (F.col("cases") >= min_cases) & (decided > 0)
    share = lambda n: F.try_divide(n, decided) >= min_ratio
    return counted.withColumn(
        "resolution",
        F.when(enough & (F.col("target_blank") == 0) & share(F.col("target_zero")), "WRITE_ZERO")
        .when(enough & (F.col("target_zero") == 0) & share(F.col("target_blank")),
              "PRESERVE_BLANK_FOR_ZERO").otherwise("UNRESOLVED"),
    ).withColumn("matches_declared", F.col("resolution") == declared)


def equivalence_pivot(rows: DataFrame, form: str) -> DataFrame:
    """Status counts per form and for all forms (rollup)."""
    status = F.col("status")
    counted = rows.rollup(form).agg(
        F.count_if(status == cmp.MATCH).alias("match"),
        F.count_if(status == cmp.ZERO_VS_BLANK).alias("zero_vs_blank"),
        F.count_if(status == cmp.MISMATCH).alias("mismatch"),
        F.count_if(status.isin(cmp.SOURCE_UNAVAILABLE, cmp.TARGET_UNAVAILABLE)).alias("unavailable"),
        F.count(F.lit(1)).alias("total"), F.grouping_id().alias("gid"),
    )
    return counted.withColumn(form, F.when(F.col("gid") == 1, "ALL").otherwise(F.col(form))).drop("gid")


def column_equivalence(
    computed: DataFrame, supplied: DataFrame, row_id: str, columns: Sequence[str],
    numeric: Sequence[str] = (),
) -> DataFrame:
    """``(column, status, mismatch_type, n)``: recomputed columns against supplied ones.

    Both sides are compared column by column inside one joined row, so the join moves
    each record once and only counts leave it.
    """
    a = computed.select(row_id, F.struct(*columns).alias("a"))
    b = supplied.select(row_id, F.struct(*columns).alias("b"))
    joined = a.join(b, row_id, "left")

    def verdict(name: str) -> Column:
        x, y = F.col(f"a.{name}"), F.col(f"b.{name}")
        xt, yt = F.coalesce(x.cast("string"), F.lit("")), F.coalesce(y.cast("string"), F.lit(""))
        if name in numeric:
            xn, yn = x.try_cast("double"), y.try_cast("double")
            both = xn.isNotNull() & yn.isNotNull()
            kind = (
                F.when(y.isNull(), "UNAVAILABLE:CACHE_MISSING")
                .when(both & (xn == yn), "EXACT:")
                .when(both & (yn == 0) & (xn > 0), "UNAVAILABLE:STALE_CACHE_SUSPECTED")
                .when(both, "MISMATCH:VALUE_MISMATCH")
                .when(x.isNull(), "MISMATCH:PY_NONE")
                .when(yt.startswith("#"), "UNAVAILABLE:LEGACY_ERROR")
                .when(xt == yt, "EXACT:").otherwise("MISMATCH:VALUE_MISMATCH")
            )
        else:
            kind = (
                F.when(y.isNull(), "UNAVAILABLE:CACHE_MISSING")
                .when(xt == yt, "EXACT:")
                .when(normalize_text(xt) == normalize_text(yt), "MISMATCH:SEMANTIC_MISMATCH")
                .otherwise("MISMATCH:VALUE_MISMATCH")
            )
        return F.struct(F.lit(name).alias("column"), kind.alias("verdict"))

    return (
        joined.select(F.inline(F.array(*[verdict(c) for c in columns])))
        .groupBy("column", "verdict").agg(F.count(F.lit(1)).alias("n"))
        .select("column", F.split_part("verdict", F.lit(":"), F.lit(1)).alias("status"),
                F.split_part("verdict", F.lit(":"), F.lit(2)).alias("mismatch_type"), "n")
    )


def distinct_pair_audit(pairs: DataFrame, keys: Sequence[str], recomputed: Column,
                        supplied: DataFrame) -> DataFrame:
    """Recompute a value once per distinct pair and compare; only counts come out.

    ``supplied`` holds ``(*keys, supplied)``.
    """
    distinct = pairs.select(*keys).dropna().distinct().withColumn("recomputed", recomputed)
    joined = distinct.join(supplied, list(keys), "left")
    return joined.agg(
        F.count(F.lit(1)).alias("pairs"),
        F.count_if(F.col("supplied") == F.col("recomputed")).alias("match"),
        F.count_if(F.col("supplied") != F.col("recomputed")).alias("mismatch"),
        F.count_if(F.col("supplied").isNull()).alias("errors"),
    )


def column_invariants(df: DataFrame, columns: Sequence[str], has_data: Column,
                      pattern: Mapping[str, Column]) -> DataFrame:
    """``(column, check_name, found, expected)``: unfilled cells, mixed patterns, gaps."""
    counted = df.agg(
        F.count_if(has_data).alias("rows"),
        *[F.count_if(F.col(c).isNotNull()).alias(f"{i}_filled") for i, c in enumerate(columns)],
        *[F.count_if(has_data & F.col(c).isNull()).alias(f"{i}_gaps") for i, c in enumerate(columns)],
        *[F.countDistinct(pattern[c]).alias(f"{i}_patterns") for i, c in enumerate(columns)],
    )

    def finding(i: int, name: str, check: str, found: Column, expected: Column, bad: Column) -> Column:
        return F.when(bad, F.struct(
            F.lit(name).alias("column"), F.lit(check).alias("check_name"),
            found.alias("found"), expected.cast("bigint").alias("expected")))

    rows = F.array(*[
        item for i, c in enumerate(columns) for item in (
            finding(i, c, "filled_vs_data_rows", F.col(f"{i}_filled"), F.col("rows"),
                    F.col(f"{i}_filled") != F.col("rows")),
            finding(i, c, "pattern_count", F.col(f"{i}_patterns"), F.lit(1), F.col(f"{i}_patterns") > 1),
            finding(i, c, "gaps", F.col(f"{i}_gaps"), F.lit(0), F.col(f"{i}_gaps") > 0),
        )
    ])
    return counted.select(F.inline(F.array_compact(rows)))
