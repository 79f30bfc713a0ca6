"""Session helpers: lineage cuts and guarded reads of small configuration tables."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: Worth setting when a session is built. The JVM never compiles a method above 8000
#: bytes of bytecode, so past that size one big generated method runs many times slower
#: than operators generated one by one. Recording the Python call site of every
#: expression costs more than planning does.
RECOMMENDED_CONF = {
    "spark.sql.codegen.hugeMethodLimit": "8000",
    "spark.python.sql.dataFrameDebugging.enabled": "false",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
}


def prepare(spark: SparkSession) -> None:
    """Keep generated code compilable in this session; set once, later settings stay."""
    marker, name = "spark.metricspark.prepared", "spark.sql.codegen.hugeMethodLimit"
    if spark.conf.get(marker, None) is None:
        spark.conf.set(name, RECOMMENDED_CONF[name])
        spark.conf.set(marker, "true")


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names, as the session has it.

    Only a session that names none, as in tests, gets a folder in its warehouse.
    """
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None) or f"{spark.conf.get('spark.sql.warehouse.dir')}/checkpoints"
    context.setCheckpointDir(configured)
    return configured


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: later stages survive the loss of any executor."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def read_config(df: DataFrame) -> list[Row]:
    """Bring rules that become column expressions to the driver: one expression a row."""
    return df.collect()


def config_table(spark: SparkSession, rows: list[tuple], ddl: str) -> DataFrame:
    """Configuration rows as a local relation.

    Going through Arrow keeps the true size visible to the optimizer, so whether
    the table is broadcast is decided by its size and not by a hint.
    """
    schema = StructType.fromDDL(ddl)
    columns = list(zip(*rows)) if rows else [() for _ in schema.fields]
    arrow = to_arrow_schema(schema)
    table = pa.table([pa.array(c, type=f.type) for c, f in zip(columns, arrow)], schema=arrow)
    return spark.createDataFrame(table, schema=schema)


def evaluate_once(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Work out the projected expressions once per row: all, or those of ``columns``.

    The optimizer copies an expression into every later filter and flag that uses it,
    which multiplies costly ones such as date parsing and can outgrow the size limit of
    generated code. Columns that come out of a generator are not copied; the row stays
    in the same task and nothing is shuffled or stored. The generator needs all columns
    given to it, so the others stay outside and can be pruned.
    """
    once = columns if columns is not None else df.columns
    others = [F.col(f"`{c}`") for c in df.columns if c not in once]
    return df.select(*others, F.inline(F.array(F.struct(*[F.col(f"`{c}`") for c in once]))))
