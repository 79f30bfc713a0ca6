"""Distributions, profiles, bands, coverage grids and review lists."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from metricspark import fixed_values as fixed
from metricspark.functions.dates import age_years
from metricspark.functions.text import ANY_SCRIPT, trim_ws
from metricspark.session import cut_lineage, evaluate_once


class MissingDimension(ValueError):
    pass


def aggregate_long(
    df: DataFrame, dimensions: Sequence[str], value: str | None = None
) -> DataFrame:
    """Sum of ``value`` (1 when absent) per combination; null dimensions form a group."""
    missing = [d for d in dimensions if d not in df.columns]
    if missing:
        raise MissingDimension(", ".join(missing))
    amount = F.coalesce(F.col(value), F.lit(1)) if value else F.lit(1)
    return df.groupBy(*dimensions).agg(F.sum(amount).alias("value")).orderBy(*dimensions)


def clean_label(c: Column, missing: str = fixed.MISSING_LABEL) -> Column:
    text = trim_ws(c.cast("string"))
    return F.when(text.isNull() | (text == ""), missing).otherwise(text)


def distribution(df: DataFrame, label: Column, *, digits: int = 2) -> DataFrame:
    """``(label, n, percent)`` with the most frequent first, label as tie-break."""
    counts = df.groupBy(label.alias("label")).agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n")).scalar()
    return counts.withColumn(
        "percent", F.round(F.lit(100.0) * F.col("n") / total, digits)
    ).orderBy(F.desc("n"), "label")


def top_n_other(
    df: DataFrame, label: Column, n: int = fixed.TOP_N, other: str = fixed.OTHER_LABEL
) -> DataFrame:
    """The ``n`` most frequent labels and one summed row for all the rest."""
    counts = df.groupBy(label.alias("label")).agg(F.count(F.lit(1)).alias("n"))
    top = counts.orderBy(F.desc("n"), "label").limit(n)
    ranked = top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("n"), "label")))
    rest = counts.agg(F.sum("n").alias("total")).select(
        F.lit(other).alias("label"),
        (F.col("total") - F.coalesce(top.agg(F.sum("n")).scalar(), F.lit(0))).alias("n"),
        F.lit(n + 1).alias("rank"),
    ).filter("n > 0")
    return ranked.unionByName(rest)


def band(value: Column, bands: Sequence[tuple[str, int, int]] = fixed.AGE_BANDS) -> Column:
    """Label of the half-open band that holds the value; null stays null."""
    start = F.when(F.lit(False), F.lit(None).cast("string"))
    return reduce(
        lambda acc, b: acc.when((value >= b[1]) & (value < b[2]), b[0]), bands, start
    )


def band_order(label: Column, bands: Sequence[tuple[str, int, int]]) -> Column:
    return F.array_position(F.array(*[F.lit(b[0]) for b in bands]), label)


def age_bands(
    df: DataFrame, birth: str, service: str, *, keys: Sequence[str] = (),
    bands: Sequence[tuple[str, int, int]] = fixed.AGE_BANDS,
) -> DataFrame:
    """Records per age band, in band order, then the unknown ages and those outside all bands."""
    # The age is a column of its own, so that it is worked out once and not per band.
    aged = df.select(*keys, age_years(F.col(birth), F.col(service)).alias("__age"))
    label = F.when(F.col("__age").isNull(), fixed.MISSING_LABEL).otherwise(
        F.coalesce(band(F.col("__age"), bands), F.lit(fixed.OUTSIDE_LABEL)))
    order = F.when(F.col("label") == fixed.MISSING_LABEL, len(bands) + 1).when(F.col("label") == fixed.OUTSIDE_LABEL, len(bands) + 2).otherwise(
        band_order(F.col("label"), bands)
    )
    return (
        aged.groupBy(*keys, label.alias("label")).agg(F.count(F.lit(1)).alias("n"))
        .withColumn("position", order.cast("int"))
    )


def column_profile(
    df: DataFrame, fields: Sequence[str], *, blank_suffix: str = "_blank",
    max_unique: int | None = None, top: int | None = None,
    categorical: Sequence[str] | None = None,
) -> DataFrame:
    """Per field: filled cells, distinct values and all values, the most frequent first.

    ``max_unique`` shows no values of fields that have more, ``top`` only the first ones.
    Only fields of ``categorical`` (default: all) may show values; of others only the
    counts are told, as their cells may hold personal text.

    Cells are unpivoted and counted with map-side combine, so the shuffle carries one
    row per distinct (field, value), and no group is ever collected.
    """
    cells = F.array(*[
        F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value"),
                 F.col(f"{f}{blank_suffix}").alias("blank"))
        for f in fields
    ])
    counts = (
        df.select(F.inline(cells)).filter(~F.col("blank"))
        .groupBy("field", "value").agg(F.count(F.lit(1)).alias("n"))
    )
    totals = counts.groupBy("field").agg(
        F.sum("n").alias("non_blank"), F.count(F.lit(1)).alias("distinct_values")
    )
    shown = F.col("field").isin(*(fields if categorical is None else categorical))
    if max_unique is not None:
        shown &= F.col("distinct_values") <= max_unique
    # A rank is the place in the order of all fields, less the values of the fields before.
    placed = cut_lineage(ordered_positions(
        counts.join(totals.filter(shown), "field").withColumn("__falling", -F.col("n")), ["field", "__falling", "value"]))
    firsts = placed.groupBy("field").agg((F.min("position") - 1).alias("__before"))
    ranked = (
        placed.join(firsts, "field").withColumn("rank", (F.col("position") - F.col("__before")).cast("int"))
        .filter(F.lit(True) if top is None else F.col("rank") <= top)
        .select("field", "non_blank", "distinct_values", "rank", "value", "n")
    )
    many = totals.filter(~shown).select(
        "field", "non_blank", "distinct_values", F.lit(None).cast("int").alias("rank"),
        F.lit(None).cast("string").alias("value"), F.lit(None).cast("bigint").alias("n"),
    )
    return ranked.unionByName(many)


def grouped_counts(
    df: DataFrame, axes: Mapping[str, Column], counts: Mapping[str, Column],
    *, total: str | None = "TOTAL",
) -> DataFrame:
    """Grand total plus one grouping per axis, from one pass over the input.

    Records are first counted per combination of all axes; only those combinations
    are then spread over the axes.
    """
    entries = list(axes)
    combined = df.groupBy(*[k.cast("string").alias(n) for n, k in axes.items()]).agg(
        F.count(F.lit(1)).alias("compared"), *[F.count_if(c).alias(n) for n, c in counts.items()]
    )
    spread = [F.struct(F.lit(n).alias("group_type"), F.col(n).alias("group_key")) for n in entries]
    if total:
        spread.insert(0, F.struct(F.lit(total).alias("group_type"), F.lit("ALL").alias("group_key")))
    names = ["compared", *counts]
    return (
        combined.select(*names, F.inline(F.array(*spread)))
        .groupBy("group_type", "group_key").agg(*[F.sum(n).alias(n) for n in names])
    )


def coverage_grid(
    df: DataFrame, keys: Sequence[str], status: str, statuses: Sequence[str]
) -> DataFrame:
    """Status counts by the full key and in total (grouping sets)."""
    counted = df.groupingSets([list(keys), []], *keys).agg(
        F.count(F.lit(1)).alias("total"),
        *[F.count_if(F.col(status) == s).alias(s.lower()) for s in statuses],
        F.grouping_id().alias("gid"),
    )
    return counted.select(
        *[F.when(F.col("gid") == 0, F.col(k)).otherwise("TOTAL").alias(k) for k in keys],
        "total", *[s.lower() for s in statuses],
    )


def review_clusters(
    df: DataFrame, keys: Sequence[str], member: str, examples: int = 5
) -> DataFrame:
    """Cluster size with its first member ids.

    Members are ranked by a partitioned window and cut before they are collected, so a
    hot cluster never becomes one big array. Spark pushes the rank limit below the
    shuffle, which keeps what moves to ``examples`` rows per cluster and task.
    """
    ranked = (
        df.select(*keys, member)
        .withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(member)))
        .filter(F.col("rank") <= examples)
        .groupBy(*keys)
        .agg(F.sort_array(F.collect_list(member)).alias("examples"))
    )
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("members"))
    on = reduce(lambda a, b: a & b, [sizes[k].eqNullSafe(ranked[k]) for k in keys])
    return sizes.join(ranked, on).select(*[sizes[k] for k in keys], "members", "examples")


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def stratified_sample(
    df: DataFrame, row_id: str, buckets: Mapping[str, tuple[Column, int | None]]
) -> DataFrame:
    """First k ids of every predicate bucket in id order, each id once.

    A bucket with ``None`` for k is kept whole (e.g. all conflicts).
    """
    chosen = []
    limited = {n: (c, k) for n, (c, k) in buckets.items() if k is not None}
    whole = [c for c, k in buckets.values() if k is None]
    memberships = F.array_compact(F.array(*[
        F.when(c, F.struct(F.lit(n).alias("bucket"), F.lit(k).alias("k")))
        for n, (c, k) in limited.items()
    ]))
    if limited:
        window = Window.partitionBy("bucket").orderBy(row_id)
        top = max(k for _, k in limited.values())
        chosen.append(
            df.select(row_id, F.inline(memberships))
            .withColumn("rank", F.row_number().over(window))
            .filter(F.col("rank") <= top)
            .filter(F.col("rank") <= F.col("k")).select(row_id)
        )
    if whole:
        chosen.append(df.filter(reduce(lambda a, b: a | b, whole)).select(row_id))
    return reduce(DataFrame.union, chosen).distinct()


def template_families(df: DataFrame, text: Column, steps: Sequence[tuple[str, str]]) -> DataFrame:
    """Group texts by what is left after replacing literals, references and numbers."""
    family = reduce(lambda c, s: F.regexp_replace(c, s[0], s[1]), steps, trim_ws(text))
    return df.select(family.alias("family"), text.alias("text")).groupBy("family").agg(
        F.count(F.lit(1)).alias("n"), F.min("text").alias("example")
    )


def structural_fingerprint(df: DataFrame, group: str, key: Column) -> DataFrame:
    """Order-free fingerprint per group from the distinct keys it holds.

    Sums over two parts of each key's digest combine map-side, so a huge group costs no more
    memory than a small one; reordering rows or changing values leaves it unchanged.
    """
    digest = F.sha2("key", 256)

    def part(start: int) -> Column:
        return F.conv(F.substring(digest, start, 15), 16, 10).cast("decimal(38,0)")

    keys = df.select(F.col(group), key.cast("string").alias("key")).distinct()
    return keys.groupBy(group).agg(
        F.count(F.lit(1)).alias("n_keys"),
        F.sha2(F.concat_ws(":", F.count(F.lit(1)), F.sum(part(1)), F.sum(part(16))), 256)
        .alias("fingerprint"),
    )


def cross_foot(df: DataFrame, checks: Mapping[str, tuple[Column, Column]]) -> DataFrame:
    """Two aggregations of one population must agree; a difference is a question."""
    sums = df.agg(*[
        F.sum(side).cast("double").alias(f"{i}_{j}")
        for i, pair in enumerate(checks.values()) for j, side in enumerate(pair)
    ])
    rows = F.array(*[
        F.struct(F.lit(name).alias("check_name"), F.col(f"{i}_0").alias("left_value"),
                 F.col(f"{i}_1").alias("right_value"))
        for i, name in enumerate(checks)
    ])
    return sums.select(F.inline(rows)).withColumn(
        "difference", F.col("left_value") - F.col("right_value")
    ).withColumn(
        "status",
        F.when(F.abs("difference") <= fixed.VALUE_TOLERANCE, "CONSISTENT").otherwise("REVIEW"),
    )


def pii_scan(df: DataFrame, texts: Mapping[str, Column],
             patterns: Sequence[tuple[str, str]] = fixed.PERSONAL_DATA) -> DataFrame:
    """Hits per field and pattern over whole texts; no value leaves the scan."""
    # Each text is searched once per pattern: a row with a hit is a row with a count.
    found = evaluate_once(df.select(*[
        F.coalesce(F.regexp_count(text, F.lit(ANY_SCRIPT + regex)), F.lit(0)).alias(f"{i}_{j}")
        for i, text in enumerate(texts.values()) for j, (_, regex) in enumerate(patterns)
    ]))
    counted = found.agg(
        *[F.coalesce(F.sum(f"{c}"), F.lit(0)).alias(f"{c}_hits") for c in found.columns],
        *[F.count_if(F.col(c) > 0).alias(f"{c}_rows") for c in found.columns],
    )
    rows = F.array(*[
        F.struct(F.lit(field).alias("field"), F.lit(name).alias("pattern"),
                 F.col(f"{i}_{j}_hits").cast("bigint").alias("hits"),
                 F.col(f"{i}_{j}_rows").alias("rows"))
        for i, field in enumerate(texts) for j, (name, _) in enumerate(patterns)
    ])
    return counted.select(F.inline(rows))


def monthly_summary(flags: DataFrame, layout, rule, *, sex: str, service: str) -> DataFrame:
    """``(period, axis, label, included, n, percent)`` of all months at once.

    The scope totals count invalid records that touch a month; the status axis is taken
    before the status filter, every other axis after it. All axes come from one
    aggregation over the valid records, keyed by what the axes can distinguish.
    """
    from metricspark.operators.scope import invalid_diagnostics

    years = age_years(F.col(layout.birth), F.col(layout.service))
    counted = (
        flags.filter("valid").withColumn("__age", years)
        .groupBy(
            "period", clean_label(F.col(layout.status)).alias("status"),
            rule.keeps(F.col(layout.status)).alias("included"),
            clean_label(F.col(sex)).alias("sex"), clean_label(F.col(service)).alias("service"),
            F.coalesce(band(F.col("__age")), F.lit(fixed.MISSING_LABEL)).alias("age"),
        )
        .agg(F.count(F.lit(1)).alias("n"))
    )
    axes = F.array(
        F.struct(F.lit("status").alias("axis"), F.col("status").alias("label")),
        *[F.when(F.col("included"), F.struct(F.lit(a).alias("axis"), F.col(a).alias("label")))
          for a in ("sex", "age", "service")],
        F.when(F.col("included"), F.struct(F.lit("total").alias("axis"),
                                           F.lit("included_records").alias("label"))),
    )
    # Small by now: one row per month, axis and label. Stored, because three parts read it.
    long = cut_lineage(
        counted.select("period", "included", "n", F.inline(F.array_compact(axes)))
        .groupBy("period", "axis", "label", "included").agg(F.sum("n").alias("n"))
    )
    # Of the services of a month only the top labels are ranked; the rest is a difference.
    services = long.filter("axis = 'service'")
    by_rank = Window.partitionBy("period").orderBy(F.desc("n"), "label")
    top = services.withColumn("rank", F.row_number().over(by_rank)).filter(
        F.col("rank") <= fixed.TOP_N).drop("rank")
    rest = (
        services.groupBy("period").agg(F.sum("n").alias("all_n"))
        .join(top.groupBy("period").agg(F.sum("n").alias("top_n")), "period")
        .select("period", F.lit("service").alias("axis"), F.lit(fixed.OTHER_LABEL).alias("label"),
                F.lit(True).alias("included"), (F.col("all_n") - F.col("top_n")).alias("n"))
        .filter("n > 0")
    )
    dist = long.filter("axis <> 'service'").unionByName(top).unionByName(rest)
    head = invalid_diagnostics(flags, layout).select(
        "period", "period_scope_records", "valid_records", "invalid_records"
    )
    included = dist.filter("axis = 'total'").select("period", F.col("n").alias("included_records"))
    totals = head.join(included, "period", "left").fillna(0, ["included_records"]).withColumn(
        "excluded_records", F.col("valid_records") - F.col("included_records")
    ).withColumn(
        "share", F.when(F.col("period_scope_records") == 0, 0.0).otherwise(
            F.round(F.lit(100.0) * F.col("included_records") / F.col("period_scope_records"), 1))
    )
    total_rows = totals.unpivot(
        ["period", "share"],
        ["period_scope_records", "valid_records", "invalid_records", "included_records",
         "excluded_records"], "label", "n",
    ).select(
        "period", F.lit("total").alias("axis"), "label", F.lit(True).alias("included"), "n",
        F.when(F.col("label") == "included_records", F.col("share")).alias("percent"),
    )
    return dist.filter("axis <> 'total'").withColumn(
        "percent", F.lit(None).cast("double")
    ).unionByName(total_rows)


def ordered_positions(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Every row with its position in key order.

    Rows are dealt out by ranges of the keys. A position is the place inside its range plus
    the rows of the ranges before it, so no task sees more than one range.
    """
    dealt = cut_lineage(df.repartitionByRange(*keys).withColumn("__range", F.spark_partition_id()))
    before = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = dealt.groupBy("__range").agg(F.count(F.lit(1)).alias("__rows")).select(
        "__range", F.coalesce(F.sum("__rows").over(before), F.lit(0)).alias("__offset"))
    inside = Window.partitionBy("__range").orderBy(*keys)
    return (
        dealt.withColumn("__place", F.row_number().over(inside)).join(offsets, "__range")
        .withColumn("position", (F.col("__offset") + F.col("__place")).cast("bigint"))
        .drop("__range", "__place", "__offset")
    )
