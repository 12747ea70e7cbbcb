"""Published attempts: readers see whole runs only.

A writer fills folders of its own attempt and then publishes it under a key, by renaming one
small finished file into ``<root>/published/<key>/``.  Until then readers keep to the attempt
that was published before, and a failed attempt is never seen.  Of two writers of one key that
publish at once, one wins for all its tables.
"""

from __future__ import annotations

import json
import uuid
from urllib.parse import quote, unquote

from pyspark.sql import SparkSession


def _fs(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def _names(spark: SparkSession, folder: str) -> list[str]:
    fs, where = _fs(spark, folder)
    return sorted(s.getPath().getName() for s in fs.listStatus(where)) if fs.exists(where) else []


def keys(spark: SparkSession, root: str) -> list[str]:
    """All keys that were published, in order."""
    return sorted(unquote(n) for n in _names(spark, f"{root}/published"))


def newest(spark: SparkSession, root: str, key: str) -> dict | None:
    """What was published last under the key."""
    folder = f"{root}/published/{quote(key, safe='')}"
    names = [n for n in _names(spark, folder) if n.endswith(".json") and n[0].isdigit()]
    return json.loads(spark.read.text(f"{folder}/{names[-1]}", wholetext=True).first()[0]) if names else None


def publish(spark: SparkSession, root: str, key: str, body: dict) -> None:
    folder = f"{root}/published/{quote(key, safe='')}"
    taken = [int(n.partition("-")[0]) for n in _names(spark, folder) if n[0].isdigit()]
    mark = uuid.uuid4().hex
    fs, unfinished = _fs(spark, f"{folder}/_{mark}")
    stream = fs.create(unfinished)
    stream.write(bytearray(json.dumps(body).encode()))
    stream.close()
    target = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{max(taken, default=0) + 1:012d}-{mark}.json")
    if not fs.rename(unfinished, target):
        raise OSError(f"could not publish {target}")


def sweep(spark: SparkSession, folder: str, kept: set[str]) -> int:
    """Deletes the attempts in a folder that are not to be kept, and returns how many.  For
    times without readers of old attempts and without writers."""
    gone = [n for n in _names(spark, folder) if n.startswith("attempt=") and n.partition("=")[2] not in kept]
    for name in gone:
        fs, where = _fs(spark, f"{folder}/{name}")
        fs.delete(where, True)
    return len(gone)
