"""Intermediate tables in the folder that ``spark.checkpoint.dir`` names."""

from __future__ import annotations

import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir


_scopes = threading.local()


class Scratch:
    """Stored tables of one piece of work; all but those kept are deleted when it ends."""

    def __init__(self) -> None:
        self.paths: dict[str, SparkSession] = {}

    def keep(self, df: DataFrame) -> DataFrame:
        """A stored table that outlives this scope; the scope around it, if any, takes it over."""
        path = df.stored_at
        spark = self.paths.pop(path)
        outer = _scopes.stack[-2] if len(_scopes.stack) > 1 else None
        if outer is not None:
            outer.paths[path] = spark
        return df

    def drop(self, *frames: DataFrame) -> None:
        """Deletes stored tables that nothing reads any more. What was made from them must be stored itself."""
        for df in frames:
            _delete(self.paths.pop(df.stored_at), df.stored_at)

    def close(self) -> None:
        for path, spark in self.paths.items():
            _delete(spark, path)


def _delete(spark: SparkSession, path: str) -> None:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


@contextmanager
def scratch() -> Iterator[Scratch]:
    """Within this, stored tables are noted and deleted at the end; the result must be stored and kept."""
    if not hasattr(_scopes, "stack"):
        _scopes.stack = []
    scope = Scratch()
    _scopes.stack.append(scope)
    try:
        yield scope
    finally:
        _scopes.stack.pop()
        scope.close()


def stored(df: DataFrame) -> DataFrame:
    """Write the rows once as Parquet in the shared folder and read them back.

    The result no longer depends on executors that may be lost, it is computed once however
    often it is used, and its true size is known to the optimizer. Outside a ``scratch`` scope such
    tables stay until the checkpoint folder is cleared, as other checkpoint data does.
    """
    path = f"{ensure_checkpoint_dir(df.sparkSession)}/llm-{uuid.uuid4().hex}"
    if getattr(_scopes, "stack", None):
        _scopes.stack[-1].paths[path] = df.sparkSession
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def column(df: DataFrame, name: str) -> F.Column:
    """A column by its exact name, whatever characters the name holds."""
    return df["`" + name.replace("`", "``") + "`"]


def partitions(spark) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
