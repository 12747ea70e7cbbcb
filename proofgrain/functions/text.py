"""Column expressions over text: cleaning, normalising, keys, shapes.

Everything here is a plain Column -> Column function, so it stays inside whole-stage code
generation.  The one exception is Unicode NFC, which Spark has no built-in for; only the
strings that can change under NFC cross to Python.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from proofgrain.functions import rules


@F.pandas_udf(StringType())
def _nfc(values: pd.Series) -> pd.Series:
    return values.map(lambda v: None if v is None else unicodedata.normalize("NFC", v))


def nfc(col: Column) -> Column:
    """Unicode NFC.  Code points below U+0300 are stable, so pure Latin text stays in the JVM."""
    return F.coalesce(_nfc(F.when(col.rlike(r"[^\x00-\x{2ff}]"), col)), col)


def collapse(col: Column) -> Column:
    """Runs of white space become one blank; ends are trimmed."""
    return F.trim(F.regexp_replace(col, r"\s+", " "))


def strip_ends(col: Column, chars: str = r"\s,.;") -> Column:
    return F.regexp_replace(col, rf"^[{chars}]+|[{chars}]+$", "")


def preview(col: Column, limit: int = 600) -> Column:
    flat = collapse(col)
    return F.when(F.length(flat) <= limit, flat).otherwise(
        F.concat(F.substring(flat, 1, limit - 3), F.lit("..."))
    )


def tokens(col: Column) -> Column:
    """Lower-case ASCII word tokens, in order."""
    return F.regexp_extract_all(F.lower(col), F.lit("[a-z0-9]+"), F.lit(0))


def first_match(col: Column, pattern: str, group: int = 1) -> Column:
    """The regex group, or null (not '') when the pattern does not occur."""
    return F.when(col.rlike(pattern), F.regexp_extract(col, pattern, group))


# ------------------------------------------------------------------ cleaning
def clean_ocr(col: Column, ocr_rules=rules.OCR_RULES) -> Column:
    out = F.regexp_replace(col, rules.OCR_DATE_DASHES, "$1-$2-$3")
    for pattern, replacement in ocr_rules:
        out = F.regexp_replace(out, pattern, replacement)
    return out


def strip_hidden(col: Column) -> Column:
    out = col
    for _code, pattern in rules.TEXT_SAFETY_RULES:
        out = F.regexp_replace(out, pattern, "")
    return out


def tidy_spaces(col: Column, keep_lines: bool = True) -> Column:
    out = F.regexp_replace(col, r"\x{00a0}", " ")
    out = F.regexp_replace(out, r"\r\n?", "\n")
    if keep_lines:
        out = F.regexp_replace(out, r"[ \t]{2,}", " ")
        out = F.regexp_replace(out, r"(?dm)^[\t\p{Zs}]+|[\t\p{Zs}]+$", "")
        out = F.regexp_replace(out, r"\n{3,}", "\n\n")
    else:
        out = F.regexp_replace(out, r"\s+", " ")
    return F.regexp_replace(out, r"^[\s\p{Z}]+|[\s\p{Z}]+$", "")


def safe_text(col: Column, keep_lines: bool = True, with_nfc: bool = True) -> Column:
    """Text without hidden characters, with tidy spaces, in NFC.

    One line of printable ASCII with single blanks, as most table cells are, stays as it is.
    """
    plain = (
        col.rlike("^[ -~]*$") & ~F.contains(col, F.lit("  ")) & ~F.contains(col, F.lit("???")) & (F.trim(col) == col)
    )
    out = tidy_spaces(strip_hidden(col), keep_lines)
    return F.when(plain, col).otherwise(nfc(out) if with_nfc else out)


def clean_cell(col: Column, with_nfc: bool = False) -> Column:
    """A table cell: safe text without blank or pipe ends."""
    return F.regexp_replace(safe_text(col, True, with_nfc), r"^[ |]+|[ |]+$", "")


# ------------------------------------------------------------------ keys
def label_key(col: Column, stopwords=rules.LABEL_STOPWORDS, clean: bool = False) -> Column:
    """Lower-case words without parentheses and stop words; ``clean``: the text is cleaned."""
    out = F.lower(col if clean else clean_cell(col))
    out = F.replace(F.replace(out, F.lit("/"), F.lit(" ")), F.lit("&"), F.lit(" and "))
    out = F.regexp_replace(out, r"\([^)]*\)", " ")
    words = F.split(F.trim(F.regexp_replace(out, r"[^a-z0-9]+", " ")), " ")
    return F.array_join(
        F.filter(words, lambda w: (w != "") & ~w.isin(*stopwords)), " "
    )


def compact_key(col: Column) -> Column:
    return F.lower(F.regexp_replace(col, r"[^A-Za-z0-9]+", ""))


# ------------------------------------------------------------------ dates


def month_number(col: Column) -> Column:
    pairs = []
    for name, number in rules.MONTHS.items():
        pairs += [F.lit(name), F.lit(number)]
    return F.try_element_at(F.create_map(*pairs), F.lower(col))


_DAY_MONTH_YEAR = r"^([0-9]{1,2})[-\s]([A-Za-zÁÉÍÓÚáéíóúñÑ]+)[-\s]([0-9]{2,4})$"


def iso_date(col: Column) -> Column:
    """Day, month name, year -> ISO text; anything else passes through, collapsed."""
    text = collapse(col)
    day = F.regexp_extract(text, _DAY_MONTH_YEAR, 1).try_cast("int")
    month = month_number(F.regexp_extract(text, _DAY_MONTH_YEAR, 2))
    raw_year = F.regexp_extract(text, _DAY_MONTH_YEAR, 3)
    year = raw_year.try_cast("int") + F.when(F.length(raw_year) == 2, 2000).otherwise(0)
    return F.when(
        text.rlike(_DAY_MONTH_YEAR) & month.isNotNull(),
        F.format_string("%04d-%02d-%02d", year, month, day),
    ).otherwise(text)


def display_date(col: Column) -> Column:
    """The first 'day-month-year', else 'month-day-year', in the text as M/D/YYYY; else ''."""
    names = "|".join(sorted(rules.MONTHS, key=len, reverse=True))
    text = F.regexp_replace(col, r"[\x{2013}\x{2014}]", "-")
    dmy = rf"(?i)\b([0-9]{{1,2}})\s*-\s*({names})\s*-\s*([0-9]{{4}})\b"
    mdy = rf"(?i)\b({names})\s*-\s*([0-9]{{1,2}})\s*-\s*([0-9]{{4}})\b"

    def shown(pattern: str, month_group: int, day_group: int) -> Column:
        return F.concat_ws(
            "/",
            month_number(F.regexp_extract(text, pattern, month_group)).cast("string"),
            F.regexp_extract(text, pattern, day_group).try_cast("int").cast("string"),
            F.regexp_extract(text, pattern, 3).try_cast("int").cast("string"),
        )

    return (
        F.when(text.rlike(dmy), shown(dmy, 2, 1))
        .when(text.rlike(mdy), shown(mdy, 1, 2))
        .otherwise("")
    )


def date_from_name(col: Column) -> Column:
    """'... March 5, 2024 ...' in a file name -> ISO date, else null."""
    names = "|".join(sorted(rules.MONTHS, key=len, reverse=True))
    pattern = rf"(?i)(?:^|[^A-Za-z])({names})[\s_]+([0-9]{{1,2}}),?[\s_]+([0-9]{{4}})\b"
    return F.when(
        col.rlike(pattern),
        iso_date(
            F.concat_ws(
                " ",
                F.regexp_extract(col, pattern, 2),
                F.regexp_extract(col, pattern, 1),
                F.regexp_extract(col, pattern, 3),
            )
        ),
    )


# ------------------------------------------------------------------ typed values
_IDENTITY = r"\b([A-Z]{2,10})[-\s]([A-Z0-9.]{2,10})\b"
_IDENTITY_NOISE = r"(?i)\b(?:PROBETA\s+MUESTRA|MUESTRA\s+PROBETA|SPECIMEN\s+SAMPLE)\b"
_SPEC = r"\b(?:DOT|AAR)\s*[0-9][A-Z0-9./-]{3,}\b"
_NOT_SPEC = r"(?i)^(?:tank\s+car|car\s+type|t[-\s]?joint|junta\s+t)$"


def identity_code(col: Column) -> Column:
    """The last 'MARK-NUMBER' code in the text, upper-cased and cleaned of scan noise."""
    text = strip_ends(collapse(col))
    hits = F.regexp_extract_all(text, F.lit("(?i)" + _IDENTITY), F.lit(0))
    last = F.try_element_at(hits, F.lit(-1))
    mark = F.upper(F.regexp_extract(last, "(?i)" + _IDENTITY, 1))
    suffix = F.regexp_replace(F.upper(F.regexp_extract(last, "(?i)" + _IDENTITY, 2)), "[^A-Z0-9]", "")
    dash = last.contains("-") | ~suffix.rlike("^[0-9]+$")
    return (
        F.when(F.size(hits) > 0, F.trim(F.concat(mark, F.when(dash, "-").otherwise(" "), suffix)))
        .when(text.rlike(_IDENTITY_NOISE), "")
        .otherwise(text)
    )


def design_spec(col: Column) -> Column:
    """Distinct recognised specifications, in order, joined by ' / '."""
    text = strip_ends(collapse(col))
    parts = F.transform(
        F.split(text, r"\s*/\s*"),
        lambda p: F.regexp_replace(F.upper(F.regexp_extract(strip_ends(p), "(?i)" + _SPEC, 0)), r"\s+", ""),
    )
    joined = F.array_join(F.array_distinct(F.filter(parts, lambda p: p != "")), " / ")
    return F.when(text.rlike(_NOT_SPEC), "").otherwise(joined)


def material_spec(col: Column) -> Column:
    out = strip_ends(collapse(col))
    for pattern, replacement in (
        (r"(?i)\bA51G\b", "A516"),
        (r"(?i)\bGrado\s+([0-9A-Z]+)\b", "Gr. $1"),
        (r"(?i)\bA36\s*([0-9]+/[0-9]+)", "A36 $1"),
        (r"([0-9]+/[0-9]+)\s*['’]", "$1 in"),
        (r"(?i)\bo\s*A11\s*10\s*cal\.?\s*([0-9]+)\b", "/ A1110 cal. $1"),
        (r"(?i)\bA11\s*10\s*cal\.?\s*([0-9]+)\b", "A1110 cal. $1"),
        (r"\s+/\s+", " / "),
        (r"(?i)\s*/\s*(A[0-9])", " / $1"),
    ):
        out = F.regexp_replace(out, pattern, replacement)
    return strip_ends(collapse(out))


def fraction_value(col: Column) -> Column:
    """'3/8"' -> '0.375'; other text unchanged."""
    pattern = r'^(\d+)/(\d+)"?$'
    text = F.trim(col)
    top = F.regexp_extract(text, pattern, 1).try_cast("double")
    bottom = F.regexp_extract(text, pattern, 2).try_cast("double")
    return F.when(text.rlike(pattern) & (bottom != 0), F.try_divide(top, bottom).cast("string")).otherwise(col)


def range_value(col: Column) -> Column:
    """'18 - 22' -> 'min: 18, max: 22'; other text unchanged."""
    pattern = r"^(\d+(?:\.\d+)?)\s*-\s*(\d+(?:\.\d+)?)$"
    return F.when(
        F.trim(col).rlike(pattern),
        F.regexp_replace(F.trim(col), pattern, "min: $1, max: $2"),
    ).otherwise(col)


# ------------------------------------------------------------------ shapes
def _any_word(col: Column, words) -> Column:
    return col.rlike("|".join(words))


def looks_like_label(col: Column) -> Column:
    """A table cell that reads as a label (expects a cleaned cell)."""
    words = F.split(F.trim(F.regexp_replace(col, r"\s+", " ")), " ")
    upper = (
        col.rlike("[A-Z]")
        & (F.upper(col) == col)
        & (F.size(words) <= 8)
        & ((F.size(words) > 1) | (F.length(col) > 8))
    )
    return (
        (col != "")
        & ~col.rlike(r"^(?:[0-9]{1,2}/[0-9]{1,2}/[0-9]{2,4}|[0-9]{4}-[0-9]{1,2}-[0-9]{1,2})$")
        & ~col.rlike(r"^(?:(?:DOT|AAR)\s*[0-9][A-Z0-9./-]{3,}|[A-Z]{2,6}\s*[- ]?\d{3,8}[A-Z]?)$")
        & (F.lower(col).endswith(":") | _any_word(F.lower(col), rules.LABEL_WORDS) | upper)
    )


def looks_like_value(col: Column) -> Column:
    words = F.split(F.trim(F.regexp_replace(col, r"\s+", " ")), " ")
    return (col != "") & (
        col.rlike(r"\b\d{1,2}[/-]\d{1,2}[/-]\d{2,4}\b|\b[A-Z]{2,6}\s*[- ]?\d{3,8}\b")
        | col.rlike(r"(?i)\b\d+(?:\.\d+)?\s*(?:psi|psig|f|mils?|in|%)\b")
        | (col.rlike("[a-z]") & (F.size(words) <= 12))
    )


def looks_like_section(col: Column) -> Column:
    letters = F.regexp_replace(col, "[^A-Za-z]", "")
    return (col != "") & (
        (F.length(col) > 80)
        | ((letters != "") & (F.upper(col) == col) & (F.length(letters) > 6))
    )


def overcaptured(col: Column) -> Column:
    """The value swallowed a following numbered label."""
    return col.rlike(rules.EMBEDDED_LABEL)


def plausible(field_id: Column, value: Column) -> Column:
    """Does the value have a shape its field can hold?  The field id names the shape."""
    size = F.length(value)
    return (
        F.when(F.coalesce(value, F.lit("")) == "", True)
        .when(overcaptured(value), False)
        .when(field_id.rlike(rules.DATE_FIELDS), (size <= rules.SHORT_VALUE) & value.rlike(rules.DATE_VALUE))
        .when(field_id.rlike(rules.NUMERIC_FIELDS), (size <= rules.SHORT_VALUE) & value.rlike(r"\d"))
        .when(field_id.rlike(rules.ID_FIELDS) | field_id.rlike(rules.NAME_FIELDS), size <= rules.SHORT_VALUE)
        .otherwise(size <= rules.MEDIUM_VALUE)
    )


def label_accepts(label: Column, value: Column) -> Column:
    """Can this value stand under this label?  ``label`` is a label key (see label_key)."""
    words = F.split(label, " ")

    def has(*names: str) -> Column:
        return F.arrays_overlap(words, F.array(*[F.lit(n) for n in names]))

    def has_all(*names: str) -> Column:
        out = F.array_contains(words, names[0])
        for n in names[1:]:
            out = out & F.array_contains(words, n)
        return out

    low = F.lower(value)
    is_spec = ~value.rlike(_NOT_SPEC) & value.rlike("(?i)" + _SPEC)
    value_words = F.size(F.split(F.trim(F.regexp_replace(value, r"\s+", " ")), " "))
    short_code = value.rlike(r"^[A-Za-z0-9./-]{1,16}(?:\s+[A-Za-z0-9./-]{1,16}){0,2}$")
    return (
        F.when(F.coalesce(value, F.lit("")) == "", False)
        .when(low.isin("n/a", "na", "none", "-", "—"), False)
        .when(low.rlike(r"^[a-z]\)$"), False)
        .when(low.rlike(r"(?:^|\s)[a-z]\)(?:\s+[a-z]\))+"), False)
        .when(low.rlike(r"\bday\s+where\s+the\s+action\b"), False)
        .when(has_all("station", "stencil"), value.rlike(r"(?i)^[A-Z0-9.-]{1,16}$"))
        .when((has_all("design", "spec") | has_all("stencil", "spec")) & ~is_spec, False)
        .when(has("date") & ~value.rlike(rules.LOOKS_DATE), False)
        .when(has("mark") & value.rlike(r"(?i)^[A-Z]{2,10}(?:[-\s][A-Z0-9]{2,10})?$"), True)
        .when(has(*rules.NUMERIC_LABEL_TOKENS) & ~value.rlike(r"\d"), False)
        .when(has("approved") & ~has("date") & ~has("by") & ((value_words > 3) | ~short_code), False)
        .when(has("revision", "rev"), value.rlike(r"^[A-Za-z0-9._-]{1,16}$"))
        .otherwise(True)
    )
