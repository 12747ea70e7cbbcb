"""Evidence extraction: label/value pairs from lines, grids, rules and JSON."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from proofgrain.functions import rules
from proofgrain.functions import text as tx
from proofgrain.functions.ranking import number_repeats
from proofgrain.session import compute_once

LINE_BREAK = r"\r\n|[\n\r\x0b\x0c\x{85}\x{2028}\x{2029}]"


# ------------------------------------------------------------------ lines
def label_pairs(docs: DataFrame, keys: Sequence[str] = ("doc_id",), max_value: int = 160, keep_long: bool = False) -> DataFrame:
    """(keys, key, value, ord): 'label: value' lines of each document.

    A label without a value takes the next line, if that has no colon.  Values are distinct
    per key in first-seen order; a carried line is appended to the key's last value.  Values
    longer than ``max_value`` are no evidence; with ``keep_long`` they are returned as well,
    without an ``ord``, and a column ``too_long`` tells them apart.
    """
    keys = list(keys)
    def trimmed(c: Column) -> Column:
        return F.regexp_replace(c, r"^[ |\s]+|[ |\s]+$", "")

    # the text is cleaned as a whole, once, as NFC refers to it three times; a line then only
    # loses its ends
    cleaned = compute_once(docs.select(*keys, "text"), "text", tx.safe_text(F.regexp_replace("text", LINE_BREAK, "\n"), with_nfc=False))
    lines = F.filter(F.transform(F.split(tx.nfc(F.col("text")), "\n"), trimmed), lambda s: s != "")

    def parsed(line: Column) -> Column:
        label = F.regexp_replace(F.regexp_extract(line, "^([^:]*):", 1), r"^table_[0-9]+_row_[0-9]+\s*", "")
        return F.struct(
            line.alias("line"), F.contains(line, F.lit(":")).alias("colon"), tx.label_key(label, clean=True).alias("key"),
            trimmed(F.regexp_extract(line, "(?s)^[^:]*:(.*)$", 1)).alias("value"))

    def event(p: Column, i: Column) -> Column:
        before = F.get(F.col("lines"), i - 1)
        waits = (i > 0) & before["colon"] & (before["value"] == "")
        return F.struct(
            i.alias("i"), F.when(p["colon"], p["key"]).when(waits, before["key"]).alias("key"),
            F.when(p["colon"], p["value"]).otherwise(p["line"]).alias("value"), (~p["colon"]).alias("carry"))

    def counts(e: Column) -> Column:
        usable = ~F.startswith(e["value"], F.lit(rules.REVIEW_MARKER))
        return (e["key"] != "") & (e["value"] != "") & (e["carry"] | usable)

    rows = compute_once(cleaned, "lines", F.transform(lines, parsed)).drop("text")
    events = rows.select(*keys, F.inline(F.filter(F.transform("lines", event), counts)))
    long = ~F.col("carry") & (F.length("value") > max_value)
    found = carried_forward(events.where(~long), keys)
    if not keep_long:
        return found
    extra = events.where(long).select(*keys, "key", "value", F.lit(None).cast("int").alias("ord"), F.lit(True).alias("too_long")).distinct()
    return found.withColumn("too_long", F.lit(False)).unionByName(extra)


def carried_forward(events: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, key, value, ord) from events (keys, key, i, value, carry).

    Whether a value is new depends on what carried lines made of the values before it, so the
    events of a key are read in order, once, as a stream: a task holds the last value and the
    digests of the earlier ones, never the events of a key.
    """
    group = [*keys, "key"]
    dealt = events.select(*group, "i", "carry", "value").repartition(*group).sortWithinPartitions(*group, "i")
    fields = T.StructType([*(dealt.schema[g] for g in group), T.StructField("value", T.StringType()), T.StructField("ord", T.IntegerType())])
    schema = to_arrow_schema(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine, last, size, number, seen, out = None, [], 0, 0, set(), []

        def close() -> None:
            if last:
                value = " ".join(last)
                out.append((*mine, value, number))
                seen.add(hashlib.blake2b(value.encode(), digest_size=16).digest())

        for part in batches:
            columns = [part.column(c).to_pylist() for c in (*group, "carry", "value")]
            for *now, carry, value in zip(*columns, strict=True):
                if now != mine:
                    close()
                    mine, last, size, number, seen = now, [], 0, 0, set()
                if carry and last:
                    last.append(value)
                    size += 1 + len(value)
                elif not (size == len(value) and last and " ".join(last) == value or hashlib.blake2b(value.encode(), digest_size=16).digest() in seen):
                    close()
                    number += bool(last)
                    last, size = [value], len(value)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in out], f.type) for c, f in enumerate(schema)], schema=schema)
                out.clear()
        close()
        if out:
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in out], f.type) for c, f in enumerate(schema)], schema=schema)

    return dealt.mapInArrow(run, fields)


def merge_pairs(primary: DataFrame, fallback: DataFrame, keys: Sequence[str] = ("doc_id",)) -> DataFrame:
    """Distinct values of both sets; those of ``primary`` come first (``source`` 0, then 1)."""
    both = primary.withColumn("source", F.lit(0)).unionByName(fallback.withColumn("source", F.lit(1)))
    first = both.groupBy(*keys, "key", "value").agg(F.min(F.struct("source", "ord")).alias("m"))
    return first.select(*keys, "key", "value", "m.source", "m.ord")


STRICT_PAIR = r"^\s*([A-Za-z0-9 _./()&\-#\[\]]+)[:=]\s*(.+?)\s*$"


def strict_pairs(chunks: DataFrame, own_scope_only: bool = True) -> DataFrame:
    """'label: value' or 'label = value' lines of the chunks a form may use."""
    if own_scope_only:
        chunks = chunks.where("scope_hint is null or scope_hint = form_id")
    lines = F.filter(F.split("text", LINE_BREAK), lambda s: F.trim(s) != "")
    return (
        chunks.withColumn("source_text", F.get(lines, F.lit(0)))
        .select("*", F.posexplode(F.split("text", LINE_BREAK)).alias("line_no", "line")).drop("text")
        .where(F.col("line").rlike(STRICT_PAIR))
        .withColumn("label", F.lower(F.trim(F.regexp_extract("line", STRICT_PAIR, 1))))
        .withColumn("value", F.trim(F.regexp_extract("line", STRICT_PAIR, 2)))
        .where("label <> '' and value <> ''").drop("line")
    )


# ------------------------------------------------------------------ grids
def _row_classes(cells: DataFrame) -> DataFrame:
    """Cells with cleaned text, their own class, and whether their row is a label row.

    A cell counts once per column it spans."""
    row = Window.partitionBy("doc", "tbl", "row")
    c = compute_once(cells, "text", tx.clean_cell(F.col("text")))
    c = c.withColumn("is_label", tx.looks_like_label(F.col("text"))).withColumn("is_value", tx.looks_like_value(F.col("text")))

    def width(cond: Column) -> Column:
        return F.sum(F.when(cond, F.col("span")).otherwise(0)).over(row)

    filled = F.when(F.col("text") != "", F.lower("text"))
    n, labels, values = width(F.col("text") != ""), width(F.col("is_label")), width(F.col("is_value"))
    varied = F.min(filled).over(row) != F.max(filled).over(row)
    return c.withColumn(
        "label_row",
        F.coalesce(varied, F.lit(False)) & (labels >= F.greatest(F.lit(1), F.floor(n / 3))) & (labels >= values),
    ).withColumn("row_labels", F.sum(F.col("is_label").cast("int")).over(row))


def grid_pairs(cells: DataFrame) -> DataFrame:
    """(doc, label, value, tbl, row, col): a label cell and the cell below that covers its
    column.

    ``cells`` is (doc, tbl, row, col, span, text).  The row number is part of the equi-join
    key; the span test is a residual condition inside one pair of rows.
    """
    c = _row_classes(cells)
    labels = c.where("is_label and (label_row or row_labels >= 2)").select(
        "doc", "tbl", (F.col("row") + 1).alias("row"), F.col("col").alias("label_col"), F.col("text").alias("label"))
    values = c.where("not label_row and not is_label and text <> ''").select(
        "doc", "tbl", "row", "col", "span", F.col("text").alias("value"))
    covered = (F.col("col") <= F.col("label_col")) & (F.col("label_col") < F.col("col") + F.col("span"))
    pairs = labels.join(values, ["doc", "tbl", "row"]).where(covered & (F.col("label") != F.col("value")))
    return pairs.groupBy("doc", "label", "value").agg(F.min(F.struct("tbl", "row", "col")).alias("at")).select(
        "doc", "label", "value", "at.tbl", "at.row", "at.col")


PLACEHOLDERS = ("choose an item.", "choose an item", "☐ yes", "☐ no", "yes", "no", "n/a")


def field_slug(label: Column) -> Column:
    out = F.regexp_replace(F.trim(label), r"^[0-9]+[.)]\s*", "")
    out = F.regexp_replace(F.replace(out, F.lit("#"), F.lit("number")), r"[^A-Za-z0-9]+", "_")
    out = F.lower(F.regexp_replace(out, r"^_+|_+$", ""))
    return F.when(out == "", "field").otherwise(out)


def left_label_pairs(cells: DataFrame) -> DataFrame:
    """Blank or dropdown cells named by the nearest filled cell to their left.

    Repeated names within a document get _2, _3 in reading order."""
    row = Window.partitionBy("doc", "tbl", "row").orderBy("col").rowsBetween(Window.unboundedPreceding, -1)
    text = tx.collapse(F.col("text"))
    c = cells.withColumn("text", text).withColumn(
        "label", F.last(F.when(F.col("text") != "", F.col("text")), ignorenulls=True).over(row))
    open_cell = (F.col("text") == "") | F.lower("text").isin(*PLACEHOLDERS)
    found = c.where(open_cell & F.col("label").isNotNull() & ~tx.looks_like_section(F.col("label"))).withColumn("base", field_slug(F.col("label")))
    repeats = number_repeats(found.select("doc", "base", "tbl", "row", "col"), ["doc", "base"], ["tbl", "row", "col"])
    return found.join(repeats, ["doc", "base", "tbl", "row", "col"], "left").select(
        "doc", "tbl", "row", "col", "label",
        F.when(F.coalesce("n", F.lit(1)) == 1, F.col("base")).otherwise(F.concat_ws("_", "base", F.col("n").cast("string"))).alias("field_id"))


# ------------------------------------------------------------------ rules
NEXT_MARKER = r"(?i)\s+(?:[A-Za-z][A-Za-z0-9_]*(?:\.[A-Za-z0-9_]+)+\s*[:=-]|table_[0-9]+_row_[0-9]+\s*:)"


def trim_at_marker(value: Column, labels: Sequence[str] = ()) -> Column:
    """Cut the value where the next field starts."""
    out = F.regexp_replace(value, f"(?s){NEXT_MARKER}.*$", "")
    if labels:
        out = F.regexp_replace(out, r"(?is)\s+(?:" + "|".join(labels) + r")\s*[:=-].*$", "")
    return F.trim(out)


def rule_confidence(field: Column, value: Column, score: Column, long_fields: Sequence[str] = ("facility_name", "car_number")) -> Column:
    base = (
        F.lit(0.62) + F.least(score, F.lit(5)) * F.lit(0.05)
        + F.when(field.contains("."), 0.05).otherwise(0.0)
        + F.when(field.isin(*long_fields) & (F.length(F.trim(value)) >= 8), 0.08).otherwise(0.0)
        + F.when((field == "date") & value.rlike("[0-9]{4}[-/][0-9]{1,2}[-/][0-9]{1,2}"), 0.08).otherwise(0.0)
    )
    return F.bround(F.least(base, F.lit(0.95)), 2)


def extract_by_rules(
    hits: DataFrame,
    rule_rows: Sequence[tuple[str | None, str, str]],
    *,
    form: str = "form_id",
    code_pattern: str | None = None,
    code_markers: dict[str, Sequence[str]] | None = None,
    code_fields: Sequence[str] = (),
    labels: Sequence[str] = (),
) -> DataFrame:
    """(form, field_id, value, confidence, source_file, chunk_id): regex rules over hits.

    ``rule_rows`` are (form or None, field, pattern with one group).  The rules become one
    expression, so each text is read once and no join is needed.  A rule is tried on the
    text, then on the text with collapsed blanks.  ``code_*``: a value of a code field must
    not carry, nor stand in a text that carries, only codes of other forms.
    """
    flat = F.col("_flat")

    def attempt(owner: str | None, field: str, pattern: str) -> Column:
        hit = F.coalesce(tx.first_match(F.col("text"), pattern), tx.first_match(flat, pattern))
        if owner is not None:
            hit = F.when(F.col(form) == owner, hit)
        return F.when(hit.isNotNull(), F.struct(F.lit(field).alias("field_id"), F.trim(hit).alias("value")))

    tries = F.array_compact(F.array(*[attempt(*r) for r in rule_rows]))
    # lambda variables keep each step's result from being computed again per use
    def cleaned(h: Column) -> Column:
        return F.struct(h["field_id"].alias("field_id"), tx.strip_ends(tx.collapse(trim_at_marker(h["value"], labels))).alias("value"))

    def dated(h: Column) -> Column:
        is_date = h["field_id"].rlike(r"(?i)date|_dt$")
        return F.struct(h["field_id"].alias("field_id"), F.when(is_date, tx.iso_date(h["value"])).otherwise(h["value"]).alias("value"))

    found = F.filter(
        F.transform(F.transform(tries, cleaned), dated),
        lambda h: (h["value"] != "") & tx.plausible(h["field_id"], h["value"]))
    out = hits.withColumn("_flat", tx.collapse(F.col("text"))).withColumn("_hits", found).drop("_flat")
    out = out.select(*hits.columns, F.inline("_hits"))
    if code_pattern and code_markers:
        expected = F.create_map(*[x for f, m in code_markers.items() for x in (F.lit(f), F.array(*[F.lit(v) for v in m]))])

        def allowed(text: Column) -> Column:
            codes = F.regexp_extract_all(F.upper(text), F.lit(code_pattern), F.lit(0))
            want = F.try_element_at(expected, F.col(form))
            return want.isNull() | (F.size(codes) == 0) | F.arrays_overlap(codes, want)

        context = F.concat_ws("\n", "source_file", "text")
        out = out.where(~F.col("field_id").isin(*code_fields) | (allowed(F.col("value")) & allowed(context)))
    scored = out.withColumn("confidence", rule_confidence(F.col("field_id"), F.col("value"), F.col("score")))
    first = scored.groupBy(form, "field_id", "value").agg(
        F.min_by(F.struct("confidence", "source_file", "chunk_id"), F.struct("rank", "source_file", "chunk_id")).alias("m"))
    return first.select(form, "field_id", "value", "m.confidence", "m.source_file", "m.chunk_id")


def extract_in_window(
    hits: DataFrame,
    anchors: Sequence[tuple[str, str, int, int, str, float]] = (),
    parts: Sequence[tuple[str, str, str, int, float]] = (),
) -> DataFrame:
    """Rules that fire near an anchor or on one part of a delimited line.

    ``anchors``: (field, anchor pattern, characters before, after, pattern, confidence);
    ``parts``: (field, line pattern with one group, separator pattern, part index, confidence).
    """
    flat = tx.collapse(F.col("text"))
    tries = []
    for field, anchor, before, after, pattern, confidence in anchors:
        at = F.regexp_instr(F.col("_flat"), F.lit(anchor))
        size = F.length(F.regexp_extract("_flat", anchor, 0))
        begin = F.greatest(F.lit(1), at - before)
        window = F.substring(F.col("_flat"), begin, at + size + after - begin)
        value = F.when(at > 0, tx.first_match(window, pattern))
        tries.append(F.when(value.isNotNull(), F.struct(F.lit(field).alias("field_id"), value.alias("value"), F.lit(confidence).alias("confidence"))))
    for field, pattern, separator, index, confidence in parts:
        pieces = F.filter(F.split(F.regexp_extract("text", pattern, 1), separator), lambda p: F.trim(p) != "")
        value = F.when(F.col("text").rlike(pattern), F.trim(F.get(pieces, F.lit(index))))
        tries.append(F.when(value.isNotNull(), F.struct(F.lit(field).alias("field_id"), value.alias("value"), F.lit(confidence).alias("confidence"))))
    keep = [c for c in hits.columns if c != "text"]
    return hits.withColumn("_flat", flat).select(*keep, F.inline(F.array_compact(F.array(*tries))))


# ------------------------------------------------------------------ JSON
def extract_by_path(df: DataFrame, json_col: str, mapping: Sequence[tuple[str, Sequence[str]]], keys: Sequence[str], confidence: float = 0.97) -> DataFrame:
    """(keys, path, field_id, value, confidence): one row per target field of each path."""
    tries = []
    for path, fields in mapping:
        value = F.try_variant_get("_v", "$." + path, "string")
        value = F.when(value.isin("", "[]", "{}"), None).otherwise(value)
        tries.append(F.when(value.isNotNull(), F.struct(
            F.lit(path).alias("path"), F.array(*[F.lit(f) for f in fields]).alias("fields"), value.alias("value"))))
    rows = df.select(*keys, F.try_parse_json(F.col(json_col)).alias("_v")).select(*keys, F.inline(F.array_compact(F.array(*tries))))
    norm = tx.strip_ends(tx.collapse(F.col("value")))
    return rows.select(*keys, "path", F.explode("fields").alias("field_id"), "value").select(
        *keys, "path", "field_id",
        F.when(F.lower("path").endswith("date"), tx.iso_date(norm)).otherwise(norm).alias("value"),
        F.lit(confidence).alias("confidence")).where("value <> ''")


def flatten_payload(df: DataFrame, json_col: str, keys: Sequence[str]) -> DataFrame:
    """Extraction payloads {fields: {name: {value, confidence, sources} | scalar}} as rows."""
    ks = ", ".join(f"`{k}`" for k in keys)
    src = df.select(*keys, F.try_parse_json(F.col(json_col)).alias("v"))
    return df.sparkSession.sql(
        f"""SELECT {ks}, try_variant_get(v, '$.schema_id', 'string') AS schema_id, try_variant_get(v, '$.status', 'string') AS status,
              try_variant_get(v, '$.document_id', 'string') AS document_id, key AS field_id,
              CASE WHEN is_box THEN coalesce(try_variant_get(value, '$.value', 'string'), '') ELSE CAST(value AS STRING) END AS value,
              CASE WHEN is_box THEN try_variant_get(value, '$.confidence', 'double') END AS confidence,
              CASE WHEN is_box THEN nullif(try_variant_get(value, '$.sources', 'string'), '[]') END AS sources
            FROM (SELECT *, schema_of_variant(value) LIKE 'OBJECT%' AS is_box
                  FROM {{src}}, LATERAL variant_explode(try_variant_get(v, '$.fields', 'variant')))""",
        src=src,
    )
