"""Written stages: a table that several later steps read is computed once per application and
state of the input, and stored in the shared folder, as each stage of a run stores its tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from proofgrain.session import checkpoint_dir, write_stage

_WRITTEN: dict[tuple[str, str, str, int], str] = {}


def _hadoop(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark._jsc.hadoopConfiguration())


def input_state(spark: SparkSession, folder: str) -> int:
    """A number that changes with the names, sizes and times of the files below a folder."""
    where, fs = _hadoop(spark, folder)
    found, files = [], fs.listFiles(where, True)
    while files.hasNext():
        f = files.next()
        found.append((f.getPath().toString(), f.getLen(), f.getModificationTime()))
    return hash(tuple(sorted(found)))


def stage(spark: SparkSession, sf: str, name: str, build: Callable[[], DataFrame]) -> DataFrame:
    app = spark.sparkContext.applicationId
    key = (app, sf, name, input_state(spark, sf))
    if key not in _WRITTEN:
        path = f"{checkpoint_dir(spark)}/stages/{app}/{sf.strip('/').replace('/', '_').replace(':', '')}/{name}-{key[3] & (2**63 - 1):x}"
        write_stage(build(), path)
        where, fs = _hadoop(spark, path)
        fs.deleteOnExit(where)
        _WRITTEN[key] = path
    return spark.read.parquet(_WRITTEN[key])


def drop_stages(spark: SparkSession) -> None:
    """Forget and delete the stages of this application."""
    app = spark.sparkContext.applicationId
    for key in [k for k in _WRITTEN if k[0] == app]:
        where, fs = _hadoop(spark, _WRITTEN.pop(key))
        fs.delete(where, True)
