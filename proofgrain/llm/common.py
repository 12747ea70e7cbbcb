"""Shared helpers: tables, the shared folder, written stages, per-worker state, Arrow rows."""

from __future__ import annotations

import sys
import tempfile
import types
import uuid
import weakref
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from proofgrain.session import write_stage


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``.

    Where it is unset, a local session (as in tests) gets a temporary folder; any other
    session is an error, since each executor would then write to its own disk.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="spark-llm-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, removed when the application ends."""
    path = f"{shared_dir(spark)}/llm/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    hadoop = jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    return path


#: The folders of staged tables.
_FOLDERS: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


def staged(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to the shared folder and read back: the lineage ends there, so a
    lost executor costs only the tasks that it ran, and the shuffle files before it go."""
    spark = df.sparkSession
    path = new_folder(spark, name)
    write_stage(df, path)
    out = spark.read.schema(df.schema).parquet(path)
    _FOLDERS[out] = path
    return out


def release(*tables: DataFrame) -> None:
    """Deletes the files of staged tables, once no later step reads them."""
    for df in tables:
        path = _FOLDERS.pop(df, None)
        if path:
            spark = df.sparkSession
            hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


def kept(name: str, build: Callable[[], Any]) -> Any:
    """State of a Python worker that outlives a task (caches of pure functions).

    A worker holds the state of one name at a time: what an earlier operator left goes."""
    store = sys.modules.setdefault("_llm_worker_state", types.ModuleType("_llm_worker_state")).__dict__.setdefault("held", {})
    if name not in store:
        store.clear()
        store[name] = build()
    return store[name]


def let_go(name: str) -> None:
    """Empties what ``kept`` holds under a name, for steps that no longer need it."""
    store = sys.modules.get("_llm_worker_state")
    if store:
        store.__dict__.get("held", {}).pop(name, None)


def unused(df: DataFrame, name: str) -> str:
    """``name``, or a like one that no column of ``df`` has."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def row_key(*columns: str) -> Column:
    """A never-null 16-byte key of a row's content.

    Rows that repeat each other share a key, and so share every per-row result.
    """
    parts = []
    for name in columns:
        value = F.col(name).cast("string")
        parts += [F.when(value.isNull(), "n").otherwise("v"), F.coalesce(value, F.lit("")), F.lit("\x00")]
    return F.unhex(F.md5(F.concat(*parts)))


def utf8(column: pa.Array) -> list[bytes]:
    """The values as UTF-8 bytes, null as empty."""
    return [x or b"" for x in column.cast(pa.large_binary()).to_pylist()]


def slices(texts: list[bytes], size: int) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive texts of about ``size`` bytes together, one text at least."""
    begin = total = 0
    for i, text in enumerate(texts):
        if total and total + len(text) > size:
            yield begin, i
            begin, total = i, 0
        total += len(text)
    if begin < len(texts):
        yield begin, len(texts)


def small(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """The batches in slices of some hundred rows, so that what a task widens stays small."""
    for part in batches:
        for at in range(0, part.num_rows, rows):
            yield part.slice(at, rows)


def batch(schema: pa.Schema, *columns: Any) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)
