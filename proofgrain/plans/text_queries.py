"""Queries over the cleaning operators, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from proofgrain.functions import rules
from proofgrain.operators import clean
from proofgrain.plans import inputs
from proofgrain.plans.ctes import with_ctes
from proofgrain.session import table

QUERIES, ORACLES = {}, {}

MONTH_SQL = "MAP {" + ", ".join(f"'{m}': {n}" for m, n in rules.MONTHS.items()) + "}"
MONTH_NAMES = "|".join(sorted(rules.MONTHS, key=len, reverse=True))


def txt1(spark, sf):
    o = table(spark, sf, "orders")
    text = F.concat(
        F.lit("Fecha "), F.date_format("o_orderdate", "dd"), F.lit("--"),
        F.element_at(F.array(*[F.lit(m) for m in ("ene", "Feb", "MAR", "xyz")]), (F.col("o_orderkey") % 4 + 1).cast("int")),
        F.lit("---"), F.date_format("o_orderdate", "yyyy"), F.lit(" placa A51G  Grado 70, a51g or A51GX"))
    return clean.clean_ocr(o.select("o_orderkey", text.alias("text")), "text")


QUERIES["txt1_clean_ocr"] = txt1
ORACLES["txt1_clean_ocr"] = r"""
WITH t AS (SELECT o_orderkey, 'Fecha ' || strftime(o_orderdate, '%d') || '--' || (['ene','Feb','MAR','xyz'])[o_orderkey % 4 + 1]
    || '---' || strftime(o_orderdate, '%Y') || ' placa A51G  Grado 70, a51g or A51GX' AS text FROM orders)
SELECT o_orderkey, regexp_replace(regexp_replace(regexp_replace(text,
    '(?i)(\d{1,2})-+(ene|feb|mar|abr|may|jun|jul|ago|sep|oct|nov|dic)-+(\d{2,4})', '\1-\2-\3', 'g'),
    '(?i)A51G\s*Grado\s*70', 'A516 Gr. 70', 'g'), '(?i)\bA51G\b', 'A516', 'g') AS text FROM t"""


def _noisy(spark, sf):
    d = F.col("doc_id")
    return table(spark, sf, "documents").select("doc_id", "source", F.concat(
        F.when(d % 4 == 0, "​ a b ").otherwise(""),
        F.when(d % 6 == 0, "what???? ☑ ").otherwise(""),
        F.when(d % 5 == 0, "one two\x07  three\t\t \r\n\r\n\r\n\r\nfour ").otherwise(""),
        F.when(d % 9 == 0, "café ").otherwise(""), "text").alias("text"))


def txt2(spark, sf):
    return clean.normalize_text(_noisy(spark, sf), "text").select(
        "doc_id", F.sha2("text_norm", 256).alias("norm_hash"), F.array_join("notes.code", ",").alias("codes"))


_NOISY = """
SELECT doc_id, source,
  CASE WHEN doc_id % 4 = 0 THEN chr(8203) || ' a' || chr(160) || 'b ' ELSE '' END
  || CASE WHEN doc_id % 6 = 0 THEN 'what???? ' || chr(9745) || ' ' ELSE '' END
  || CASE WHEN doc_id % 5 = 0 THEN 'one' || chr(8232) || 'two' || chr(7) || '  three' || chr(9) || chr(9) || ' '
       || repeat(chr(13) || chr(10), 4) || 'four ' ELSE '' END
  || CASE WHEN doc_id % 9 = 0 THEN 'cafe' || chr(769) || ' ' ELSE '' END || text AS t0
FROM documents"""
_NORM = rf"""
WITH n AS ({_NOISY}),
a AS (SELECT *, regexp_replace(t0, '{rules.HIDDEN_UNICODE}', '', 'g') AS t1 FROM n),
b AS (SELECT *, regexp_replace(t1, '{rules.OCR_GARBAGE}', '', 'g') AS t2 FROM a),
c AS (SELECT *, regexp_replace(t2, '{rules.MALFORMED_SEPARATOR}', '', 'g') AS t3 FROM b),
d AS (SELECT *, regexp_replace(t3, '{rules.CONTROL_CHARS}', '', 'g') AS t4 FROM c),
e AS (SELECT *, regexp_replace(t4, '^[\s\p{{Z}}]+|[\s\p{{Z}}]+$', '', 'g') AS ends,
  regexp_replace(regexp_replace(replace(t4, chr(160), ' '), '\r\n?', chr(10), 'g'), '[ \t]{{2,}}', ' ', 'g') AS t5 FROM d),
f AS (SELECT *, regexp_replace(regexp_replace(regexp_replace(t5, '(?m)^[\t\p{{Zs}}]+|[\t\p{{Zs}}]+$', '', 'g'),
  '\n{{3,}}', chr(10) || chr(10), 'g'), '^[\s\p{{Z}}]+|[\s\p{{Z}}]+$', '', 'g') AS tidy FROM e),
g AS (SELECT *, nfc_normalize(tidy) AS norm FROM f),
h AS (SELECT doc_id, source, norm, list_filter([CASE WHEN t0 <> t1 THEN 'hidden_unicode' END, CASE WHEN t1 <> t2 THEN 'ocr_garbage' END,
  CASE WHEN t2 <> t3 THEN 'malformed_separator' END, CASE WHEN t3 <> t4 THEN 'control_char' END,
  CASE WHEN tidy <> ends THEN 'whitespace' END, CASE WHEN tidy <> norm THEN 'unicode_nfc' END], lambda x: x IS NOT NULL) AS codes FROM g)
"""
QUERIES["txt2_normalize_text"] = txt2
ORACLES["txt2_normalize_text"] = _NORM + "SELECT doc_id, sha256(norm) AS norm_hash, coalesce(array_to_string(codes, ','), '') AS codes FROM h"
QUERIES["txt2_note_counts"] = lambda spark, sf: clean.note_counts(clean.normalize_text(_noisy(spark, sf), "text"), ["source"])
ORACLES["txt2_note_counts"] = _NORM + "SELECT source, code, count(*) AS n FROM (SELECT source, unnest(codes) AS code FROM h) GROUP BY 1, 2"


def _dates(spark, sf):
    k = F.col("o_orderkey")
    d = F.col("o_orderdate")
    month = F.element_at(F.array(*[F.lit(m) for m in
        ("ene", "Febrero", "march", "ABR", "may", "Junio", "july", "ago", "Sept", "octubre", "nov", "Brumaire")]), F.month(d))
    return table(spark, sf, "orders").select(
        "o_orderkey",
        F.when(k % 5 == 0, F.concat_ws("-", F.dayofmonth(d).cast("string"), month, F.date_format(d, "yy")))
        .when(k % 5 == 1, F.concat_ws(" ", F.dayofmonth(d).cast("string"), month, F.date_format(d, "yyyy")))
        .when(k % 5 == 2, F.concat(F.lit("Rev "), month, F.lit(" - "), F.dayofmonth(d).cast("string"), F.lit(" - "), F.date_format(d, "yyyy")))
        .when(k % 5 == 3, F.concat(F.lit("signed "), F.dayofmonth(d).cast("string"), F.lit("–"), month, F.lit("–"), F.date_format(d, "yyyy"), F.lit(" ok")))
        .otherwise(F.concat(F.lit("  "), inputs.day(d), F.lit("  n/a "))).alias("raw"),
    )


_DATES = """
SELECT o_orderkey, CASE o_orderkey % 5
  WHEN 0 THEN day(o_orderdate) || '-' || m || '-' || strftime(o_orderdate, '%y')
  WHEN 1 THEN day(o_orderdate) || ' ' || m || ' ' || strftime(o_orderdate, '%Y')
  WHEN 2 THEN 'Rev ' || m || ' - ' || day(o_orderdate) || ' - ' || strftime(o_orderdate, '%Y')
  WHEN 3 THEN 'signed ' || day(o_orderdate) || chr(8211) || m || chr(8211) || strftime(o_orderdate, '%Y') || ' ok'
  ELSE '  ' || strftime(o_orderdate, '%Y-%m-%d') || '  n/a ' END AS raw
FROM (SELECT *, (['ene','Febrero','march','ABR','may','Junio','july','ago','Sept','octubre','nov','Brumaire'])[month(o_orderdate)] AS m FROM orders)"""
QUERIES["txt3_normalize_dates"] = lambda spark, sf: clean.normalize_dates(_dates(spark, sf), "raw")
ORACLES["txt3_normalize_dates"] = rf"""
WITH d AS ({_DATES}),
c AS (SELECT *, trim(regexp_replace(raw, '\s+', ' ', 'g')) AS t, replace(replace(raw, chr(8211), '-'), chr(8212), '-') AS u FROM d),
p AS (SELECT *, regexp_extract(t, '^([0-9]{{1,2}})[-\s]([A-Za-zÁÉÍÓÚáéíóúñÑ]+)[-\s]([0-9]{{2,4}})$', ['dd','mm','yy']) AS x,
  regexp_extract(u, '(?i)\b([0-9]{{1,2}})\s*-\s*({MONTH_NAMES})\s*-\s*([0-9]{{4}})\b', ['dd','mm','yy']) AS y,
  regexp_extract(u, '(?i)\b({MONTH_NAMES})\s*-\s*([0-9]{{1,2}})\s*-\s*([0-9]{{4}})\b', ['mm','dd','yy']) AS z, {MONTH_SQL} AS months FROM c)
SELECT o_orderkey, raw,
  CASE WHEN x.dd <> '' AND months[lower(x.mm)] IS NOT NULL THEN
    printf('%04d-%02d-%02d', TRY_CAST(x.yy AS INTEGER) + CASE WHEN length(x.yy) = 2 THEN 2000 ELSE 0 END, months[lower(x.mm)], TRY_CAST(x.dd AS INTEGER))
    ELSE t END AS iso,
  CASE WHEN y.dd <> '' THEN months[lower(y.mm)] || '/' || TRY_CAST(y.dd AS INTEGER) || '/' || TRY_CAST(y.yy AS INTEGER)
       WHEN z.dd <> '' THEN months[lower(z.mm)] || '/' || TRY_CAST(z.dd AS INTEGER) || '/' || TRY_CAST(z.yy AS INTEGER) ELSE '' END AS shown
FROM p"""


def txt3_names(spark, sf):
    d = F.col("o_orderdate")
    month = F.element_at(F.array(*[F.lit(m) for m in ("January", "feb", "Marzo", "abril", "Mayo", "june", "Jul", "agosto", "sept", "Oct", "november", "Brumaire")]), F.month(d))
    return clean.file_name_dates(table(spark, sf, "orders").select(
        F.concat(F.lit("scan_"), F.col("o_orderkey").cast("string"), F.lit(" "), month, F.lit("_"),
                 F.dayofmonth(d).cast("string"), F.lit(", "), F.date_format(d, "yyyy"), F.lit(" copy.pdf")).alias("source_file")))


QUERIES["txt3_file_name_dates"] = txt3_names
ORACLES["txt3_file_name_dates"] = f"""
SELECT 'scan_' || o_orderkey || ' ' || m || '_' || day(o_orderdate) || ', ' || strftime(o_orderdate, '%Y') || ' copy.pdf' AS source_file,
  'date' AS field_id, strftime(o_orderdate, '%Y-%m-%d') AS value, CAST(0.98 AS DOUBLE) AS confidence
FROM (SELECT *, (['January','feb','Marzo','abril','Mayo','june','Jul','agosto','sept','Oct','november','Brumaire'])[month(o_orderdate)] AS m FROM orders)
WHERE m <> 'Brumaire'"""

VALUE_KINDS = {"part.code": "identity", "part.spec": "spec", "part.material": "material", "weld.length": "length"}


def txt4(spark, sf):
    k, size = F.col("p_partkey"), F.col("p_size").cast("string")
    brand = F.regexp_replace("p_brand", "#", "-")
    rows = table(spark, sf, "part").select("p_partkey", F.inline(F.array(
        F.struct(F.lit("part.code").alias("field_id"),
                 F.when(k % 7 == 0, "SPECIMEN SAMPLE").when(k % 3 == 0, F.concat(F.lit(" old AB-12 then "), brand, F.lit(";")))
                 .otherwise(F.concat(F.lit("mark "), size, F.lit("."))).alias("value")),
        F.struct(F.lit("part.spec").alias("field_id"),
                 F.when(k % 5 == 0, "tank car").otherwise(F.concat(F.lit("dot 1"), size, F.lit("A100 / AAR 203W / DOT1"), size, F.lit("A100 / none"))).alias("value")),
        F.struct(F.lit("part.material").alias("field_id"),
                 F.concat(F.lit(" A51G Grado "), size, F.lit("/A36 3/8' o A11 10 cal. "), size, F.lit(" ,")).alias("value")),
        F.struct(F.lit("weld.length").alias("field_id"), F.concat(size, F.lit("/8"), F.when(k % 2 == 0, '"').otherwise(" in filete corner")).alias("value")),
        F.struct(F.lit("voltage.used").alias("field_id"), F.concat(size, F.lit(".5 - "), (F.col("p_size") + 4).cast("string")).alias("value")),
        F.struct(F.lit("made_date").alias("field_id"), F.concat((F.col("p_size") % 28 + 1).cast("string"), F.lit("  marzo-21")).alias("value")),
    )))
    return clean.normalize_values(rows, VALUE_KINDS)


QUERIES["txt4_normalize_values"] = txt4
ORACLES["txt4_normalize_values"] = r"""
WITH p AS (SELECT p_partkey AS k, CAST(p_size AS VARCHAR) AS s, p_size AS n, replace(p_brand, '#', '-') AS brand FROM part),
code AS (SELECT k, CASE WHEN k % 7 = 0 THEN 'SPECIMEN SAMPLE' WHEN k % 3 = 0 THEN 'old AB-12 then ' || brand ELSE 'mark ' || s END AS t FROM p),
hit AS (SELECT k, t, regexp_extract_all(t, '(?i)\b([A-Z]{2,10})[-\s]([A-Z0-9.]{2,10})\b') AS h FROM code),
last AS (SELECT k, t, h[-1] AS m FROM hit)
SELECT k AS p_partkey, 'part.code' AS field_id, CASE WHEN m IS NOT NULL THEN
   upper(regexp_extract(m, '(?i)\b([A-Z]{2,10})[-\s]([A-Z0-9.]{2,10})\b', 1))
   || CASE WHEN m LIKE '%-%' OR NOT regexp_full_match(regexp_replace(upper(regexp_extract(m, '(?i)\b([A-Z]{2,10})[-\s]([A-Z0-9.]{2,10})\b', 2)), '[^A-Z0-9]', '', 'g'), '[0-9]+') THEN '-' ELSE ' ' END
   || regexp_replace(upper(regexp_extract(m, '(?i)\b([A-Z]{2,10})[-\s]([A-Z0-9.]{2,10})\b', 2)), '[^A-Z0-9]', '', 'g')
   WHEN t = 'SPECIMEN SAMPLE' THEN '' ELSE t END AS value FROM last
UNION ALL SELECT k, 'part.spec', CASE WHEN k % 5 = 0 THEN '' ELSE 'DOT1' || s || 'A100 / AAR203W' END FROM p
UNION ALL SELECT k, 'part.material', 'A516 Gr. ' || s || ' / A36 3/8 in / A1110 cal. ' || s FROM p
UNION ALL SELECT k, 'weld.length', CASE WHEN k % 2 = 0 THEN CAST(n / 8.0::DOUBLE AS VARCHAR) ELSE s || '/8 in' END FROM p
UNION ALL SELECT k, 'voltage.used', 'min: ' || s || '.5, max: ' || (n + 4) FROM p
UNION ALL SELECT k, 'made_date', printf('2021-03-%02d', n % 28 + 1) FROM p"""


def txt5(spark, sf):
    label = F.concat("p_name", F.lit(" ("), "p_brand", F.lit(") / Size & Type of the "), "p_type", F.lit(": |"))
    return clean.label_keys(table(spark, sf, "part").select("p_partkey", label.alias("label")), "label")


QUERIES["txt5_label_keys"] = txt5
ORACLES["txt5_label_keys"] = r"""
WITH l AS (SELECT p_partkey, p_name || ' (' || p_brand || ') / Size & Type of the ' || p_type || ': |' AS label FROM part),
t AS (SELECT *, string_split(trim(regexp_replace(lower(p.p_name || '   size and type of the ' || p.p_type), '[^a-z0-9]+', ' ', 'g')), ' ') AS w
  FROM l JOIN part p USING (p_partkey))
SELECT p_partkey, label, array_to_string(list_filter(w, lambda x: x NOT IN ('a','an','and','by','for','from','in','of','on','or','the','to','with','aar','tank','car')), ' ') AS label_key,
  lower(regexp_replace(label, '[^A-Za-z0-9]+', '', 'g')) AS compact_key FROM t"""


def txt6(spark, sf):
    cells = inputs.grid(spark, sf).where("text <> ''")
    return clean.split_clusters(cells.select("doc", "row", "col", "text"), "text").select(
        "doc", "row", "col", "dates", "part_no", "part")


QUERIES["txt6_split_clusters"] = txt6
ORACLES["txt6_split_clusters"] = with_ctes(rf"""
SELECT doc, CAST(row AS INTEGER) AS row, CAST(col AS INTEGER) AS col, len(regexp_extract_all(text, '{rules.DATE_TOKEN}')) AS dates, CAST(i - 1 AS INTEGER) AS part_no, parts[i] AS part
FROM (SELECT *, list_filter(list_transform(string_split(text, '|'), lambda x: trim(x)), lambda x: x <> '') AS parts FROM grid WHERE text <> ''),
  LATERAL (SELECT unnest(generate_series(1, len(parts))) AS i)""")
