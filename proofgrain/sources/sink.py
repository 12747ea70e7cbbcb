"""The run store: every table of a run as files partitioned by run and form."""

from __future__ import annotations

import functools
import json
import uuid
from collections.abc import Mapping
from urllib.parse import quote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from proofgrain.sources import published

RUN_TABLES = (
    "runs", "field_maps", "requirements", "answers", "writes",
    "documents", "chunks", "candidates", "ledger", "decisions", "trace", "reports",
)


def write_run(tables: Mapping[str, DataFrame], out: str, run_id: str, fmt: str = "parquet") -> None:
    """Write each table under ``out/<table>/run_id=<run>/attempt=<id>`` and publish the attempt.

    Readers go from all tables of the run's last published attempt to all of this one at once;
    a failed attempt changes nothing for them.  Running a run again replaces all that it wrote
    before, tables and forms that it no longer has among them, and nothing of other runs.  Rows
    are dealt by form, so a form of moderate size is one file.  ``sweep_run`` deletes what was
    replaced.
    """
    unknown = [name for name in tables if name not in RUN_TABLES]
    if unknown:
        raise ValueError(f"unknown run table {unknown[0]!r}; known: {', '.join(RUN_TABLES)}")
    attempt, schemas = uuid.uuid4().hex, {}
    for name, df in tables.items():
        rows = df.drop("run_id")
        schemas[name] = rows.schema.jsonValue()
        by_form = "form_id" in rows.columns
        writer = (rows.hint("rebalance", F.col("form_id")) if by_form else rows).write.format(fmt)
        (writer.partitionBy("form_id") if by_form else writer).save(f"{_folder(out, name, run_id)}/attempt={attempt}")
    if tables:
        spark = next(iter(tables.values())).sparkSession
        published.publish(spark, out, run_id, {"attempt": attempt, "tables": schemas})


def _folder(out: str, name: str, run_id: str) -> str:
    return f"{out}/{name}/run_id={quote(run_id, safe='')}"


def read_run(spark: SparkSession, out: str, name: str, run_id: str | None = None, fmt: str = "parquet") -> DataFrame:
    """A run table, of one run or of all, from the last published attempts only.

    Runs that wrote other columns are filled up with nulls.  Without any published run that
    holds the table, a LookupError.
    """
    paths: dict[str, list[str]] = {}
    for run in published.keys(spark, out) if run_id is None else [run_id]:
        body = published.newest(spark, out, run)
        if body and name in body["tables"]:
            paths.setdefault(json.dumps(body["tables"][name]), []).append(f"{_folder(out, name, run)}/attempt={body['attempt']}")
    if not paths:
        raise LookupError(f"no published run in {out} holds {name}" + ("" if run_id is None else f" as {run_id}"))
    parts = []
    for schema, folders in paths.items():
        columns = StructType.fromJson(json.loads(schema)).add("run_id", "string").add("attempt", "string")
        parts.append(spark.read.format(fmt).schema(columns).option("basePath", f"{out}/{name}").load(folders).drop("attempt"))
    return functools.reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def sweep_run(spark: SparkSession, out: str, run_id: str) -> int:
    """Deletes the run's attempts but the published one; for times without readers."""
    body = published.newest(spark, out, run_id)
    kept = {body["attempt"]} if body else set()
    return sum(published.sweep(spark, _folder(out, name, run_id), kept) for name in RUN_TABLES)
