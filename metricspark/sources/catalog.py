"""Catalog tables: exact schema, no duplicates, no dangling references."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from metricspark.functions.criteria import parse_criterion
from metricspark.operators.classify import Category
from metricspark.operators.metrics import Term
from metricspark.session import read_config

TERM_SCHEMA = "metric_id string, term_no int, sign int"
PREDICATE_SCHEMA = "metric_id string, term_no int, pred_no int, col string, op string, value string"
MANIFEST_SCHEMA = (
    "instruction_id string, metric_id string, sheet string, target string, "
    "expected_value_type string, version string"
)
CATEGORY_SCHEMA = "code string, field string, operator string, output_literal string, values array<string>"


class CatalogError(ValueError):
    """The catalog does not have the agreed form."""


def read_catalog(spark: SparkSession, path: str, ddl: str) -> DataFrame:
    """CSV catalog with exactly the agreed header; a malformed row stops the load."""
    schema = StructType.fromDDL(ddl)
    header = spark.read.option("header", True).csv(path).columns
    if header != schema.names:
        raise CatalogError(f"header {header} is not {schema.names}")
    return spark.read.option("header", True).option("mode", "FAILFAST").schema(schema).csv(path)


def require(df: DataFrame, ddl: str, unique: Sequence[str]) -> DataFrame:
    """Check columns, non-emptiness and uniqueness of a catalog held as a table."""
    names = StructType.fromDDL(ddl).names
    if df.columns != names:
        raise CatalogError(f"columns {df.columns} are not {names}")
    if df.isEmpty():
        raise CatalogError("catalog is empty")
    repeated = df.groupBy(*unique).count().filter("count > 1").limit(5).collect()
    if repeated:
        raise CatalogError(f"repeated {tuple(unique)}: {[tuple(r)[:-1] for r in repeated]}")
    return df


def load_terms(terms: DataFrame, predicates: DataFrame) -> list[Term]:
    """Counting terms out of ``metric_term`` and ``metric_predicate``.

    They come to the driver to be compiled into expressions. ``metric_counts_from_tables`` counts
    catalogs of any size and leaves them where they are.
    """
    require(terms, TERM_SCHEMA, ["metric_id", "term_no"])
    by_term: dict[tuple[str, int], list[tuple[int, str, str]]] = {}
    for row in read_config(predicates.select("metric_id", "term_no", "pred_no", "col", "op", "value")):
        raw = (row["op"] or "") + (row["value"] or "")
        parse_criterion(raw)  # unsupported criteria surface here, not in the middle of a run
        by_term.setdefault((row["metric_id"], row["term_no"]), []).append((row["pred_no"], row["col"], raw))
    out = []
    for row in sorted(read_config(terms), key=lambda r: (r["metric_id"], r["term_no"])):
        own = sorted(by_term.pop((row["metric_id"], row["term_no"]), []))
        out.append(Term(row["metric_id"], tuple((c, raw) for _, c, raw in own), row["sign"]))
    if by_term:
        raise CatalogError(f"predicates without a term: {sorted(by_term)[:5]}")
    return out


def load_categories(rules: DataFrame) -> list[Category]:
    require(rules, CATEGORY_SCHEMA, ["code"])
    return [
        Category(r["code"], r["field"], r["operator"], r["output_literal"] or "", tuple(r["values"]))
        for r in sorted(read_config(rules), key=lambda r: r["code"])
    ]
