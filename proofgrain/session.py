"""Session helpers: building a session, reading tables, cutting lineage, rule tables."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

def build_session(app: str = "proofgrain", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators rely on (adaptive plans, UTC)."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A parquet table, as its files are now."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def compute_once(df: DataFrame, name: str, expr: Column) -> DataFrame:
    """Adds or replaces a column that later steps use many times.

    A generated column is not copied into the filters and expressions that refer to it, so
    a costly text expression runs once per row.
    """
    return df.select(*[c for c in df.columns if c != name], F.explode(F.array(expr)).alias(name))


def rule_table(spark: SparkSession, rows: Sequence[tuple], schema: str) -> DataFrame:
    """A table from plain Python rows.  Spark joins it as its measured size suggests."""
    return spark.createDataFrame(list(rows), schema)


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``.

    Where it is unset, a local session (as in tests) gets a temporary folder; any other
    session is an error, since each executor would write to its own disk.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="spark-proofgrain-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


#: Spark removes the shuffle files of a query when it ends, not when the driver collects garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def write_stage(df: DataFrame, path: str) -> None:
    """Writes ``df``; the shuffle files that it took go as soon as it is written."""
    spark = df.sparkSession
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.mode("overwrite").parquet(path)
    finally:
        if before is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, before)


def cut_lineage(df: DataFrame) -> DataFrame:
    """``df`` written once to the shared folder and read back, so later stages survive lost
    executors.  The files go when the application ends."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/cut/{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"
    write_stage(df, path)
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(where)
    return spark.read.schema(df.schema).parquet(path)
