"""Incremental inbox index: new, changed and deleted files since the last look."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from proofgrain.sources import published

FILE_SCHEMA = "path string, modificationTime timestamp, length long, content binary"
INDEX_SCHEMA = "name string, hash string, modified timestamp, bytes long"
LOG_SCHEMA = f"{INDEX_SCHEMA}, change string, batch_id long"


def current_index(spark: SparkSession, table: str, before: int | None = None) -> DataFrame:
    """(name, hash, modified, bytes) of the files that the index holds, as of the batches
    below ``before``: the whole index that the last of these published."""
    batches = [k for k in published.keys(spark, table) if before is None or int(k) < before]
    if not batches:
        return spark.createDataFrame([], INDEX_SCHEMA)
    return spark.read.schema(INDEX_SCHEMA).parquet(f"{table}/index/attempt={published.newest(spark, table, batches[-1])['attempt']}")


def changes(spark: SparkSession, table: str) -> DataFrame:
    """The published changes of all batches."""
    folders = [f"{table}/changes/batch_id={int(k)}/attempt={published.newest(spark, table, k)['attempt']}" for k in published.keys(spark, table)]
    if not folders:
        return spark.createDataFrame([], LOG_SCHEMA)
    return spark.read.schema(f"{LOG_SCHEMA}, attempt string").option("basePath", f"{table}/changes").parquet(*folders).drop("attempt")


def sweep_index(spark: SparkSession, table: str) -> int:
    """Deletes the whole indexes of all batches but the last; for times without readers."""
    batches = published.keys(spark, table)
    return published.sweep(spark, f"{table}/index", {published.newest(spark, table, batches[-1])["attempt"]}) if batches else 0


def refresh_index(spark: SparkSession, inbox: str, table: str, batch_id: int, pattern: str = "*") -> None:
    """Compare the whole inbox with the index and log what differs as batch ``batch_id``.

    Files whose time and size are as the index has them are not read.  The others are hashed;
    those of equal content are logged as ``same``, so that they aren't read again.  A batch
    writes its changes and the whole index after it, and publishes both at once, so a batch
    reads one index and no log, readers never see half a batch, and running it again changes
    nothing.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").schema(FILE_SCHEMA).load(inbox)
    name = F.regexp_replace("path", rf"^(?:[a-z]+:)?/*{re.escape(inbox.partition(':')[2].strip('/') or inbox.strip('/'))}/+", "")
    listing = files.select(name.alias("name"), F.col("modificationTime").alias("modified"), F.col("length").alias("bytes"))
    before = current_index(spark, table, batch_id)
    old = before.select("name", F.col("hash").alias("old"), F.col("modified").alias("old_modified"), F.col("bytes").alias("old_bytes"))
    touched = listing.join(old, "name", "left").where(~F.col("modified").eqNullSafe(F.col("old_modified")) | ~F.col("bytes").eqNullSafe(F.col("old_bytes")))
    earliest = touched.agg(F.min("modified")).first()[0]
    gone = old.join(listing.select("name"), "name", "left_anti").select("name", F.col("old").alias("hash"), F.col("old_modified").alias("modified"), F.col("old_bytes").alias("bytes"), F.lit("deleted").alias("change"))
    log = gone
    if earliest is not None:
        # the bound on the time reaches the source, so older files aren't opened
        hashed = files.where(F.col("modificationTime") >= F.lit(earliest)).select(name.alias("name"), F.sha2("content", 256).alias("hash"))
        change = F.when(F.col("old").isNull(), "new").when(F.col("old") != F.col("hash"), "changed").otherwise("same")
        log = touched.join(hashed, "name").select("name", "hash", "modified", "bytes", change.alias("change")).unionByName(gone)
    attempt = uuid.uuid4().hex
    folder = f"{table}/changes/batch_id={batch_id}/attempt={attempt}"
    log.write.parquet(folder)
    logged = spark.read.schema(log.schema).parquet(folder)
    kept = before.join(logged.select("name"), "name", "left_anti")
    now = kept.unionByName(logged.where("change <> 'deleted'").drop("change"))
    now.write.parquet(f"{table}/index/attempt={attempt}")
    published.publish(spark, table, f"{batch_id:019d}", {"attempt": attempt})


def stream_index(spark: SparkSession, inbox: str, table: str, checkpoint: str, pattern: str = "*"):
    """Start one available-now pass over the inbox and return the query.

    Arriving files, whatever their date, start a batch; the batch then compares the whole
    inbox, since a stream of files never sees a path twice and never a deletion.  Where no
    file arrived, ``refresh_index`` does the same by itself.
    """
    arrived = (
        spark.readStream.format("binaryFile").schema(FILE_SCHEMA).option("pathGlobFilter", pattern)
        .option("recursiveFileLookup", "true").option("maxFileAge", "36500d").load(inbox).select("path"))

    def apply(batch: DataFrame, batch_id: int) -> None:
        refresh_index(batch.sparkSession, inbox, table, batch_id, pattern)

    return arrived.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
