"""Metric values against the manifest of what has to be published."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def manifest_join(values: DataFrame, manifest: DataFrame) -> DataFrame:
    """Pending writes. A second value for one id is never settled by picking one."""
    single = values.groupBy("metric_id").agg(
        F.count(F.lit(1)).alias("n"), F.min("value").alias("value")
    )
    return manifest.join(single, "metric_id").select(
        *manifest.columns,
        F.when(F.col("n") == 1, F.col("value")).alias("value"),
        F.when(F.col("n") == 1, "OK").otherwise("DUPLICATE_VALUE").alias("value_status"),
    )


def completeness(values: DataFrame, manifest: DataFrame) -> DataFrame:
    """``(kind, metric_id)`` of missing, duplicate and orphan ids; empty means complete."""
    have = values.groupBy("metric_id").agg(F.count(F.lit(1)).alias("n"))
    want = manifest.select("metric_id").distinct().withColumn("wanted", F.lit(True))
    kinds = F.array_compact(F.array(
        F.when(F.col("n").isNull(), F.lit("missing")),
        F.when(F.col("n") > 1, F.lit("duplicate")),
        F.when(F.col("wanted").isNull(), F.lit("orphan")),
    ))
    return have.join(want, "metric_id", "full_outer").select(
        F.explode(kinds).alias("kind"), "metric_id"
    )


def collisions(writes: DataFrame) -> DataFrame:
    """``(collision_type, key, parties)`` over ``(metric_id, target, instruction_id)``."""
    pairs = writes.select("metric_id", "target").distinct()
    return (
        pairs.groupBy("target").agg(F.count(F.lit(1)).alias("parties")).filter("parties > 1")
        .select(F.lit("MULTIPLE_SOURCES_SAME_TARGET").alias("collision_type"),
                F.col("target").alias("key"), "parties")
        .unionByName(
            pairs.groupBy("metric_id").agg(F.count(F.lit(1)).alias("parties")).filter("parties > 1")
            .select(F.lit("SAME_SOURCE_MULTIPLE_TARGETS").alias("collision_type"),
                    F.col("metric_id").alias("key"), "parties"))
        .unionByName(
            writes.filter(F.col("instruction_id").isNotNull())
            .groupBy("instruction_id").agg(F.count(F.lit(1)).alias("parties")).filter("parties > 1")
            .select(F.lit("DUPLICATE_INSTRUCTION_IDENTITY").alias("collision_type"),
                    F.col("instruction_id").alias("key"), "parties"))
    )


def block_collisions(writes: DataFrame) -> DataFrame:
    """Adds ``blocked``: every party of any collision is blocked, nobody wins."""
    found = collisions(writes)

    def involved(kind: str, column: str) -> DataFrame:
        return found.filter(F.col("collision_type") == kind).select(F.col("key").alias(column))

    parties = (
        writes.join(involved("MULTIPLE_SOURCES_SAME_TARGET", "target"), "target", "left_semi")
        .select("metric_id")
        .union(involved("SAME_SOURCE_MULTIPLE_TARGETS", "metric_id"))
        .union(writes.join(involved("DUPLICATE_INSTRUCTION_IDENTITY", "instruction_id"),
                           "instruction_id", "left_semi").select("metric_id"))
        .distinct().withColumn("hit", F.lit(True))
    )
    return writes.join(parties, "metric_id", "left").withColumn(
        "blocked", F.coalesce("hit", F.lit(False))
    ).drop("hit")


def catalog_violations(
    catalog: DataFrame,
    *,
    edges: DataFrame | None = None,
    expected_rows: int | None = None,
    allowed: Sequence[str] = (),
    denied: Sequence[str] = (),
) -> DataFrame:
    """``(check_name, key, detail)`` for each breach of the catalog contract."""
    def breach(df: DataFrame, name: str, key: Column, detail: Column) -> DataFrame:
        return df.select(F.lit(name).alias("check_name"), key.cast("string").alias("key"),
                         detail.cast("string").alias("detail"))

    def repeated(name: str, column: str) -> DataFrame:
        counted = catalog.groupBy(column).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
        return breach(counted, name, F.col(column), F.col("n"))

    out = repeated("DUPLICATE_ID", "instruction_id").unionByName(repeated("DUPLICATE_TARGET", "target"))
    totals = catalog.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("version").alias("versions"))
    out = out.unionByName(breach(
        totals.filter("versions <> 1"), "VERSION_FINGERPRINT", F.lit("*"), F.col("versions")))
    if expected_rows is not None:
        out = out.unionByName(breach(
            totals.filter(F.col("n") != expected_rows), "ROW_COUNT", F.lit("*"), F.col("n")))
    if edges is not None:
        known = catalog.select(F.col("metric_id").alias("dep_metric_id")).distinct()
        needed = edges.join(catalog.select("metric_id"), "metric_id", "left_semi")
        out = out.unionByName(breach(
            needed.join(known, "dep_metric_id", "left_anti").select("dep_metric_id").distinct(),
            "DEPENDENCY_NOT_COVERED", F.col("dep_metric_id"), F.lit("")))
    both = sorted(set(allowed) & set(denied))
    if both:
        out = out.unionByName(breach(
            totals.select(F.explode(F.lit(both)).alias("k")), "ALLOW_DENY_OVERLAP", F.col("k"), F.lit("")))
    return out
