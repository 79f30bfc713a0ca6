"""Registry of runnable queries, each with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession

from metricspark.session import prepare

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)


class Tables:
    """Lazy access to one directory of tables: ``t.orders`` is a DataFrame."""

    def __init__(self, spark: SparkSession, directory: str):
        prepare(spark)
        self.spark = spark
        self.directory = directory.rstrip("/")

    def __getattr__(self, name: str) -> DataFrame:
        if name not in TABLES:
            raise AttributeError(name)
        return self.spark.read.parquet(f"{self.directory}/{name}.parquet")

    def sql(self, text: str) -> DataFrame:
        """Run SQL over the tables it names in braces, e.g. ``FROM {orders}``."""
        used = {n: getattr(self, n) for n in TABLES if "{" + n + "}" in text}
        return self.spark.sql(text, **used)


Runner = Callable[[Tables], DataFrame]
QUERIES: dict[str, Runner] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None) -> Callable[[Runner], Runner]:
    def register(fn: Runner) -> Runner:
        if name in QUERIES:
            raise ValueError(f"query registered twice: {name}")
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn

    return register


def plain(sql: str) -> str:
    """The same input SQL for an engine that knows the tables by their own names."""
    for name in TABLES:
        sql = sql.replace("{" + name + "}", name)
    return sql


@lru_cache(maxsize=1)
def load_all() -> None:
    """Import every module that registers queries."""
    from importlib import import_module
    from pkgutil import iter_modules

    import metricspark.plans as package

    for module in sorted(m.name for m in iter_modules(package.__path__)):
        if module.startswith("queries_"):
            import_module(f"metricspark.plans.{module}")
