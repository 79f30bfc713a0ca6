"""Publish once, then prove it; run audit and content hashes."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from metricspark import fixed_values as fixed
from metricspark.functions.compare import value_type_gate
from metricspark.session import cut_lineage


class PublishRefused(RuntimeError):
    """Pre-checks or the read-back found something; nothing was published."""


def preflight_checks(writes: DataFrame, values: DataFrame) -> DataFrame:
    """``(check_name, failures)`` of all conditions for publishing.

    ``writes`` are manifest rows with ``value`` (null if none was computed).
    """
    dtype = dict(writes.dtypes)["value"]
    _, reason = value_type_gate(F.col("value"), dtype, F.col("expected_value_type"))
    row_checks = writes.agg(
        F.count_if(F.col("value").isNull()).alias("NULL_VALUE"),
        F.count_if(F.col("value") < 0).alias("NEGATIVE_VALUE"),
        F.count_if(F.col("value").isNotNull() & ~reason.isin("OK", "COERCED_EXACT_FLOAT"))
        .alias("VALUE_TYPE"),
    )

    def excess(column: str, name: str) -> DataFrame:
        per_key = writes.groupBy(column).agg(F.count(F.lit(1)).alias("n"))
        return per_key.agg(F.count_if(F.col("n") > 1).alias("failures")).select(
            F.lit(name).alias("check_name"), "failures")

    wanted = writes.select("metric_id").distinct()
    have = values.select("metric_id").distinct().withColumn("have", F.lit(True))
    sides = wanted.withColumn("want", F.lit(True)).join(have, "metric_id", "full_outer").agg(
        F.count_if(F.col("have").isNull()).alias("MISSING_INSTRUCTION"),
        F.count_if(F.col("want").isNull()).alias("ORPHAN_INSTRUCTION"),
    )
    return (
        row_checks.unpivot([], row_checks.columns, "check_name", "failures")
        .unionByName(excess("instruction_id", "DUPLICATE_INSTRUCTION"))
        .unionByName(excess("target", "DUPLICATE_TARGET"))
        .unionByName(sides.unpivot([], sides.columns, "check_name", "failures"))
    )


def verify_readback(expected: DataFrame, actual: DataFrame, key: str = "target") -> DataFrame:
    """``(target, expected, actual, status)`` of every target that was to be written.

    A target found more than once is one row and a mismatch.
    """
    found = actual.groupBy(key).agg(
        F.first(F.col("value").cast("double")).alias("actual"), F.count(F.lit(1)).alias("copies"))
    same = F.abs(F.col("expected") - F.col("actual")) <= fixed.VALUE_TOLERANCE
    return (
        expected.select(F.col(key), F.col("value").cast("double").alias("expected"))
        .join(found, key, "left")
        .withColumn("status", F.when(F.col("copies").isNull(), "MISSING")
                    .when(F.coalesce(same, F.lit(False)) & (F.col("copies") == 1), "OK").otherwise("VALUE_MISMATCH"))
        .drop("copies")
    )


_ATTEMPT = ".attempt-"


def _file_system(spark: SparkSession, path: str):
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    target = jvm.org.apache.hadoop.fs.Path(path)
    return jvm, conf, target, target.getFileSystem(conf)


def _take_place(spark: SparkSession, staged: str, path: str) -> bool:
    """Renames ``staged`` to ``path`` in one step; false if another writer was there first."""
    jvm, conf, target, fs = _file_system(spark, path)
    if fs.exists(target):
        return False
    files = jvm.org.apache.hadoop.fs
    none = spark.sparkContext._gateway.new_array(files.Options.Rename, 0)
    try:
        files.FileContext.getFileContext(fs.getUri(), conf).rename(files.Path(staged), fs.makeQualified(target), none)
    except Exception as error:
        if "AlreadyExists" in str(error) or fs.exists(target):
            return False
        raise
    return True


def dead_attempts(spark: SparkSession, path: str) -> list[str]:
    """Attempts to publish ``path`` whose driver ended before it could delete them, or that still run."""
    jvm, _, target, fs = _file_system(spark, path)
    parent = target.getParent()
    found = fs.listStatus(parent) if fs.exists(parent) else []
    return sorted(x.getPath().toString() for x in found if x.getPath().getName().startswith(f"_{target.getName()}{_ATTEMPT}"))


def clear_attempts(spark: SparkSession, path: str) -> int:
    """Deletes the attempts at ``path``, how many; call it when no writer is running."""
    dead = dead_attempts(spark, path)
    for attempt in dead:
        _, _, target, fs = _file_system(spark, attempt)
        fs.delete(target, True)
    return len(dead)


def publish(writes: DataFrame, values: DataFrame, path: str, *, key: str = "target",
            partition_by: list[str] | None = None, violations: list[DataFrame] | None = None) -> DataFrame:
    """Refuse, or write ``path`` once, read it back and return the verification table.

    Nothing is written while a pre-check counts a failure or a table of ``violations``
    (contract, catalog, completeness) has a row. ``writes`` is evaluated once: the same rows are
    checked, written and compared. They go to an attempt of this run next to ``path`` and are read
    back from there. Only an attempt whose targets all agree gets the mark ``_VERIFIED`` and then
    takes the place of ``path``, in one rename that fails if something is there: of two writers one
    wins, a reader sees all or nothing, and an earlier output is never overwritten. An attempt that
    fails is deleted, so it blocks nobody; ``clear_attempts`` deletes those of drivers that were
    lost. Where the store has no atomic rename, writers must be kept apart by other means.
    """
    spark = writes.sparkSession
    _, _, target, fs = _file_system(spark, path)
    if fs.exists(target):
        raise PublishRefused(f"{path} exists")
    writes = cut_lineage(writes)
    failed = preflight_checks(writes, values).filter("failures > 0").collect()  # a row per check
    if failed:
        raise PublishRefused("pre-checks failed: " + ", ".join(f"{r.check_name}={r.failures}" for r in failed))
    for table in violations or ():
        if not table.isEmpty():
            raise PublishRefused(f"violations: {', '.join(table.columns)}")
    attempt = target.getParent().toString() + f"/_{target.getName()}{_ATTEMPT}{uuid.uuid4().hex}"
    _, _, staged, _ = _file_system(spark, attempt)
    try:
        writer = writes.write.mode("errorifexists")
        (writer.partitionBy(*partition_by) if partition_by else writer).parquet(attempt)
        report = cut_lineage(verify_readback(writes, spark.read.parquet(attempt), key))
        if not report.filter("status <> 'OK'").isEmpty():
            raise PublishRefused(f"read-back differs; nothing is published at {path}")
        spark.createDataFrame([("OK",)], "status string").coalesce(1).write.mode("errorifexists").text(f"{attempt}/_VERIFIED")
        if not _take_place(spark, attempt, path):
            raise PublishRefused(f"{path} exists: another writer was first")
    finally:
        fs.delete(staged, True)  # nothing is there after the rename
    return report


def write_artefact(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """One long-form table per artefact: parquet, JSON lines or CSV with header."""
    writer = df.write.mode("errorifexists").format(fmt)
    (writer.option("header", True) if fmt == "csv" else writer).save(path)


def order_free_hash(*columns: Column) -> Column:
    """Aggregate that identifies a table's content regardless of row order."""
    digest = F.sha2(F.concat_ws("|", *[F.coalesce(c.cast("string"), F.lit("")) for c in columns]), 256)
    return F.sha2(F.sum(F.conv(F.substring(digest, 1, 15), 16, 10).cast("decimal(38,0)")).cast("string"), 256)


def _audit_columns(counters: dict[str, Column], warnings: dict[str, Column], identity: list[Column]) -> list[Column]:
    raised = F.array_compact(F.array(*[
        F.when(F.count_if(c) > 0, F.lit(name)) for name, c in warnings.items()
    ]))
    return [
        F.count(F.lit(1)).alias("records"),
        *[F.count_if(c).alias(name) for name, c in counters.items()],
        F.array_join(raised, ",").alias("warnings"),
        order_free_hash(*identity).alias("input_hash"),
    ]


def run_audit(df: DataFrame, counters: dict[str, Column], warnings: dict[str, Column],
              identity: list[Column]) -> DataFrame:
    """One row about a run: records, counters, raised warnings and the input's hash."""
    return df.agg(*_audit_columns(counters, warnings, identity))


def observed_audit(df: DataFrame, name: str, counters: dict[str, Column], warnings: dict[str, Column],
                   identity: list[Column]) -> tuple[DataFrame, Observation]:
    """The same rows, and the audit that the run's own pass over them leaves behind.

    The counters of ``run_audit`` are taken while an action of the run computes the rows, so they
    cost no scan of their own. ``observation.get`` waits for that action; rows that a later filter
    drops are counted, rows that a limit never reads are not.
    """
    watched = Observation(name)
    return df.observe(watched, *_audit_columns(counters, warnings, identity)), watched


def content_hashes(df: DataFrame, row_id: str, text: Column) -> DataFrame:
    return df.select(row_id, F.sha2(text, 256).alias("sha256"))


def file_hashes(spark: SparkSession, path: str) -> DataFrame:
    """SHA-256 of whole input files, hashed where they are read."""
    files = spark.read.format("binaryFile").load(path)
    return files.select("path", "length", F.sha2("content", 256).alias("sha256"))
