"""Text, CSV and JSON sources as evidence chunks."""

from __future__ import annotations

import json
import re
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def chunk_key(source: Column, suffix: Column) -> Column:
    """A stable id: file stem, position in the file, short hash of both."""
    stem = F.regexp_replace(source, r"\.[^.]*$", "")
    digest = F.substring(F.sha1(F.concat_ws("::", source, suffix).cast("binary")), 1, 12)
    return F.concat_ws(".", stem, suffix, digest)


def read_text_docs(spark: SparkSession, path: str) -> DataFrame:
    """Whole files as (source_file, method, text); a file is named by its path below ``path``."""
    root = re.escape(path.partition(":")[2].strip("/") or path.strip("/"))
    return spark.read.option("recursiveFileLookup", "true").text(path, wholetext=True).select(
        F.regexp_replace("_metadata.file_path", rf"^(?:[a-z]+:)?/*{root}/+", "").alias("source_file"),
        F.when(F.lower("_metadata.file_name").endswith(".log"), "local_log").otherwise("local_text").alias("method"),
        F.col("value").alias("text"),
    )


def split_paragraphs(docs: DataFrame) -> DataFrame:
    """Blank-line separated paragraphs of (source_file, text) as chunks."""
    return (
        docs.select("source_file", F.posexplode(F.split("text", r"\n\s*\n")).alias("i", "part"))
        .withColumn("text", F.regexp_replace("part", r"^\s+|\s+$", ""))
        .where("text <> ''")
        .select(
            "source_file",
            chunk_key(F.col("source_file"), F.concat(F.lit("chunk."), F.col("i").cast("string"))).alias("chunk_id"),
            "text",
        )
    )


def rows_to_label_lines(df: DataFrame, source_name: str, key_cols: Sequence[str], labels: dict[str, str] | None = None) -> DataFrame:
    """Each row becomes one chunk of 'label: value' lines (``text``) and one ' | ' joined
    line (``joined``).  Empty values give no line."""
    labels = labels or {c: c for c in df.columns}
    lines = [
        F.when(F.coalesce(F.col(c).cast("string"), F.lit("")) != "", F.concat(F.lit(f"{label}: "), F.col(c).cast("string")))
        for c, label in labels.items()
    ]
    cells = [F.coalesce(F.trim(F.col(c).cast("string")), F.lit("")) for c in labels]
    source = F.lit(source_name)
    suffix = F.concat_ws(".", F.lit("row"), *[F.col(k).cast("string") for k in key_cols])
    return df.select(
        source.alias("source_file"),
        chunk_key(source, suffix).alias("chunk_id"),
        F.concat_ws("\n", *lines).alias("text"),
        F.concat_ws(" | ", *cells).alias("joined"),
    ).where("text <> ''")


# ------------------------------------------------------------------ JSON
_LEAF = T.ArrayType(T.StructType([T.StructField("path", T.StringType()), T.StructField("value", T.StringType())]))


@F.pandas_udf(_LEAF)
def _flatten_rest(values: pd.Series) -> pd.Series:
    """Leaves of JSON containers nested deeper than the unrolled levels."""

    def walk(node, path):
        if isinstance(node, dict):
            for key, child in node.items():
                yield from walk(child, f"{path}.{key}" if path else str(key))
        elif isinstance(node, list):
            for i, child in enumerate(node):
                yield from walk(child, f"{path}[{i}]")
        elif node is not None:
            yield {"path": path, "value": str(node)}

    return values.map(lambda v: None if v is None else list(walk(json.loads(v), "")))


def flatten_json(df: DataFrame, col: str, keys: Sequence[str], levels: int = 3) -> DataFrame:
    """(keys, section, path, value) of every non-null leaf of a JSON column.

    The section is the top-level key (or item.N, or root); the path is relative to it.
    ``levels`` container levels are unrolled in the JVM; deeper parts, whatever their
    depth, go through one Arrow function that sees only those parts.  No shuffle.
    """
    keys = list(keys)
    ks = ", ".join(f"`{k}`" for k in keys)
    view = df.select(*keys, F.try_parse_json(F.col(col)).alias("v")).where("v is not null")
    spark = df.sparkSession
    top = spark.sql(
        f"""SELECT {ks}, CASE WHEN NOT is_box THEN 'root' ELSE coalesce(key, concat('item.', pos)) END AS section,
                   '' AS path, CASE WHEN is_box THEN value ELSE v END AS v
            FROM (SELECT *, schema_of_variant(v) RLIKE '^(OBJECT|ARRAY)' AS is_box FROM {{src}}),
                 LATERAL variant_explode_outer(CASE WHEN is_box THEN v END)""",
        src=view,
    )
    for _ in range(levels):
        top = spark.sql(
            f"""SELECT {ks}, section,
                       CASE WHEN NOT is_box THEN path
                            WHEN key IS NULL THEN concat(path, '[', pos, ']')
                            WHEN path = '' THEN key ELSE concat(path, '.', key) END AS path,
                       CASE WHEN is_box THEN value ELSE v END AS v
                FROM (SELECT *, coalesce(schema_of_variant(v) RLIKE '^(OBJECT|ARRAY)', false) AS is_box FROM {{src}}),
                     LATERAL variant_explode_outer(CASE WHEN is_box THEN v END)""",
            src=top,
        )
    deep = F.expr("coalesce(schema_of_variant(v) RLIKE '^(OBJECT|ARRAY)', false)")
    leaf = F.expr(
        # a whole number that was written as a fraction keeps its ".0"
        "CASE WHEN schema_of_variant(v) = 'BOOLEAN' THEN initcap(CAST(v AS STRING)) "
        "WHEN schema_of_variant(v) LIKE 'DECIMAL(%,0)' THEN concat(CAST(v AS STRING), '.0') ELSE CAST(v AS STRING) END"
    )
    rest = top.where("v is not null and not is_variant_null(v)").select(
        *keys, "section", "path", "v",
        F.explode_outer(_flatten_rest(F.when(deep, F.to_json("v")))).alias("d"),
    )
    joined = (
        F.when(F.col("d.path").startswith("["), F.concat("path", "d.path"))
        .when(F.col("path") == "", F.col("d.path"))
        .otherwise(F.concat_ws(".", "path", "d.path"))
    )
    return rest.select(
        *keys, "section",
        F.when(F.col("d").isNotNull(), joined).otherwise(F.col("path")).alias("path"),
        F.when(F.col("d").isNotNull(), F.col("d.value")).when(~deep, leaf).alias("value"),
    ).where("value is not null")


def json_lines(flat: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Flattened leaves as 'path: value' lines."""
    return flat.select(*keys, "section", F.concat("path", F.lit(": "), "value").alias("line"))
