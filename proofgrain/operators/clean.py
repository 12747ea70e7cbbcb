"""Cleaning and normalising jobs over a text column."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from proofgrain.functions import rules, text
from proofgrain.session import compute_once


def clean_ocr(df: DataFrame, col: str, ocr_rules=rules.OCR_RULES) -> DataFrame:
    return df.withColumn(col, text.clean_ocr(F.col(col), ocr_rules))


def normalize_text(df: DataFrame, col: str, keep_lines: bool = True) -> DataFrame:
    """Adds ``text_norm`` and ``notes``: one note per rule that changed the text."""
    stages: list[tuple[str, str, Column, Column]] = []
    out = df.withColumn("_0", F.coalesce(F.col(col), F.lit("")))
    for i, (code, pattern) in enumerate(rules.TEXT_SAFETY_RULES):
        out = compute_once(out, f"_{i + 1}", F.regexp_replace(f"_{i}", pattern, ""))
        stages.append((code, f"Removed {code} characters", F.col(f"_{i}"), F.col(f"_{i + 1}")))
    last = f"_{len(rules.TEXT_SAFETY_RULES)}"
    out = compute_once(out, "_tidy", text.tidy_spaces(F.col(last), keep_lines)).withColumn("text_norm", text.nfc(F.col("_tidy")))
    ends = F.regexp_replace(F.col(last), r"^[\s\p{Z}]+|[\s\p{Z}]+$", "")

    def note(code: str, detail: str, changed: Column, before: Column, after: Column) -> Column:
        return F.when(changed, F.struct(
            F.lit(code).alias("code"), F.lit(detail).alias("detail"),
            before.alias("before_preview"), after.alias("after_preview")))

    notes = [
        note(code, detail, before != after, F.substring(before, 1, 80), F.substring(after, 1, 80))
        for code, detail, before, after in stages
    ]
    blank = F.lit("")
    notes.append(note("whitespace", "Collapsed duplicate whitespace safely", F.col("_tidy") != ends, blank, blank))
    notes.append(note("unicode_nfc", "Applied Unicode NFC normalization", F.col("_tidy") != F.col("text_norm"), blank, blank))
    out = out.withColumn("notes", F.array_compact(F.array(*notes)))
    return out.drop("_tidy", *[f"_{i}" for i in range(len(rules.TEXT_SAFETY_RULES) + 1)])


def note_counts(df: DataFrame, by: Sequence[str]) -> DataFrame:
    return df.select(*by, F.explode("notes.code").alias("code")).groupBy(*by, "code").agg(F.count("*").alias("n"))


def normalize_dates(df: DataFrame, col: str) -> DataFrame:
    """Adds ``iso`` (ISO date or the text itself) and ``shown`` (M/D/YYYY or '')."""
    return df.withColumn("iso", text.iso_date(F.col(col))).withColumn("shown", text.display_date(F.col(col)))


def file_name_dates(files: DataFrame) -> DataFrame:
    """A date in the file name is a candidate with confidence 0.98."""
    return files.withColumn("value", text.date_from_name(F.col("source_file"))).where("value is not null").select(
        "source_file", F.lit("date").alias("field_id"), "value", F.lit(0.98).alias("confidence"))


def normalize_values(
    cands: DataFrame,
    kinds: dict[str, str],
    field: str = "field_id",
    value: str = "value",
    range_fields: Sequence[str] = ("voltage", "amps", "travel_speed"),
) -> DataFrame:
    """Normalise values by the kind of their field: identity, spec, material, date, length.

    ``kinds`` maps field ids to kinds; a field with 'date' in its id is a date.  Fractions
    and, in range fields, ranges are then made explicit.
    """
    raw = F.col(value)
    base = text.strip_ends(text.collapse(raw))
    fid = F.col(field)
    makers = {
        "identity": text.identity_code, "spec": text.design_spec, "material": text.material_spec,
        "length": lambda c: F.regexp_replace(text.strip_ends(text.collapse(c)), r"(?i)\s+(?:filete|fillet|mete)\b.*$", ""),
    }
    out = F.when(fid.rlike(rules.DATE_FIELDS) | fid.endswith("_dt"), text.iso_date(base))
    for kind, maker in makers.items():
        of_kind = [f for f, k in kinds.items() if k == kind]
        if of_kind:
            out = out.when(fid.isin(*of_kind), maker(raw))
    out = text.fraction_value(out.otherwise(base))
    ranged = fid.rlike("(?i)" + "|".join(range_fields))
    return cands.withColumn(value, F.when(ranged, text.range_value(out)).otherwise(out))


def label_keys(df: DataFrame, col: str) -> DataFrame:
    return df.withColumn("label_key", text.label_key(F.col(col))).withColumn("compact_key", text.compact_key(F.col(col)))


def split_clusters(df: DataFrame, col: str) -> DataFrame:
    """Pipe-separated parts of a cell, with the number of date tokens in the whole cell."""
    parts = F.filter(F.transform(F.split(col, r"\|"), lambda p: F.regexp_replace(p, r"^\s+|\s+$", "")), lambda p: p != "")
    dates = F.regexp_count(F.col(col), F.lit(rules.DATE_TOKEN)).cast("bigint")
    return df.withColumn("dates", dates).select("*", F.posexplode(parts).alias("part_no", "part"))
