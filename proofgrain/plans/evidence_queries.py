"""Queries over evidence extraction, matching and the ledger, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from proofgrain.operators import answers, ledger, match, pairs, retrieve
from proofgrain.plans import inputs
from proofgrain.plans.ctes import ALIAS_RULES, CTES, TERM, with_ctes
from proofgrain.plans.retrieve_queries import doc_chunks, requirements, reranked
from proofgrain.plans.stages import stage
from proofgrain.session import table

QUERIES, ORACLES = {}, {}
GLOBAL_FIELDS = ("customer.nation",)


# ------------------------------------------------------------------ shared steps
def own_candidates(spark, sf, own_scope_only=True):
    fields = inputs.field_spec(spark, sf)
    found = pairs.strict_pairs(inputs.evidence_chunks(spark, sf), own_scope_only)
    return match.match_fields(fields, found, match.alias_keys(fields, ALIAS_RULES))


def universe(spark, sf):
    fields = inputs.field_spec(spark, sf).where("not never_write").select("form_id", "field_id")
    return inputs.packets(spark, sf).select("packet_id", "form_id").join(fields, "form_id")


def staged_ledger(spark, sf):
    """The guarded ledger of all packets, written once for the steps that build on it."""
    return stage(spark, sf, "ledger", lambda: own_ledger(spark, sf)[0])


def staged_alternates(spark, sf):
    return stage(spark, sf, "alternates", lambda: own_ledger(spark, sf)[1])


def own_ledger(spark, sf, own_scope_only=True):
    """(guarded ledger, alternates)"""
    multi = ledger.multi_scope_sources(inputs.evidence_chunks(spark, sf))
    entries, alternates = ledger.pick_best(own_candidates(spark, sf, own_scope_only), multi, universe(spark, sf))
    return ledger.guard_scope(entries, multi, GLOBAL_FIELDS), alternates


# ------------------------------------------------------------------ pairs
QUERIES["evd1_label_pairs"] = lambda spark, sf: pairs.label_pairs(inputs.label_documents(spark, sf), keep_long=True)
ORACLES["evd1_label_pairs"] = with_ctes("""
SELECT *, false AS too_long FROM label_pairs
UNION ALL SELECT DISTINCT doc_id, key, value, CAST(NULL AS INTEGER), true FROM all_line_events WHERE NOT carry AND key <> '' AND length(value) > 160""")


def merged(spark, sf):
    own = pairs.label_pairs(inputs.label_documents(spark, sf))
    return pairs.merge_pairs(own.where("doc_id % 2 = 0 or key <> 'order status'"), own.where("doc_id % 2 = 1 or ord > 0"))


QUERIES["evd1_merged_pairs"] = merged
ORACLES["evd1_merged_pairs"] = with_ctes("""
SELECT doc_id, key, value, CAST(min(source) AS INTEGER) AS source, arg_min(ord, struct_pack(s := source, o := ord)) AS ord
FROM (SELECT *, 0 AS source FROM label_pairs WHERE doc_id % 2 = 0 OR key <> 'order status'
  UNION ALL SELECT *, 1 FROM label_pairs WHERE doc_id % 2 = 1 OR ord > 0) GROUP BY doc_id, key, value""")

QUERIES["evd2_strict_pairs"] = lambda spark, sf: pairs.strict_pairs(inputs.evidence_chunks(spark, sf))
ORACLES["evd2_strict_pairs"] = with_ctes("SELECT * FROM strict_pairs WHERE scope_hint IS NULL OR scope_hint = form_id")

QUERIES["evd3_grid_pairs"] = lambda spark, sf: pairs.grid_pairs(inputs.grid(spark, sf))
ORACLES["evd3_grid_pairs"] = with_ctes("""
SELECT doc, label, value, CAST(m.t AS INTEGER) AS tbl, CAST(m.r AS INTEGER) AS row, CAST(m.c AS INTEGER) AS col FROM (
  SELECT l.doc, l.text AS label, v.text AS value, min(struct_pack(t := v.tbl, r := v.row, c := v.col)) AS m
  FROM grid_cells l JOIN grid_rows lr ON lr.doc = l.doc AND lr.tbl = l.tbl AND lr.row = l.row
  JOIN grid_cells v ON v.doc = l.doc AND v.tbl = l.tbl AND v.row = l.row + 1 AND v.col <= l.col AND l.col < v.col + v.span
  JOIN grid_rows vr ON vr.doc = v.doc AND vr.tbl = v.tbl AND vr.row = v.row
  WHERE l.is_label AND (lr.label_row OR lr.row_labels >= 2) AND NOT vr.label_row AND NOT v.is_label AND v.text <> '' AND l.text <> v.text
  GROUP BY ALL)""")


def left_labels(spark, sf):
    cells = inputs.grid(spark, sf).withColumn("text", F.when(F.col("text").rlike("^[A-Z]+$"), "Choose an item.").otherwise(F.col("text")))
    return pairs.left_label_pairs(cells)


QUERIES["evd4_left_labels"] = left_labels
ORACLES["evd4_left_labels"] = with_ctes(r"""
WITH c AS (SELECT doc, tbl, row, col, CASE WHEN regexp_matches(text, '^[A-Z]+$') THEN 'Choose an item.' ELSE text END AS text FROM grid),
l AS (SELECT *, last_value(CASE WHEN text <> '' THEN text END IGNORE NULLS) OVER (PARTITION BY doc, tbl, row ORDER BY col ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS label FROM c),
f AS (SELECT *, lower(trim(regexp_replace(replace(label, '#', 'number'), '[^A-Za-z0-9]+', '_', 'g'), '_')) AS base FROM l
  WHERE label IS NOT NULL AND (text = '' OR lower(text) IN ('choose an item.', 'choose an item', 'yes', 'no', 'n/a'))
    AND NOT (upper(label) = label AND length(regexp_replace(label, '[^A-Za-z]', '', 'g')) > 6)),
n AS (SELECT *, row_number() OVER (PARTITION BY doc, base ORDER BY tbl, row, col) AS n FROM f)
SELECT doc, CAST(tbl AS INTEGER) AS tbl, CAST(row AS INTEGER) AS row, CAST(col AS INTEGER) AS col, label,
  CASE WHEN n = 1 THEN base ELSE base || '_' || n END AS field_id FROM n""")

RULES = (
    (None, "contact.email", r"([A-Za-z0-9._]+@[A-Za-z0-9.-]+[.][a-z]{2,})"),
    (None, "contact.phone", r"([+]\d [(]\d{3}[)] \d{3}-\d{4})"),
    ("en", "first.number", r"(\d{2,})"),
    ("de", "end.word", r"([A-Za-z]+)[.]$"),
)


def rule_hits(spark, sf):
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("doc"), "text", F.col("lang").alias("form_id"), F.col("source").alias("source_file"))
    return retrieve.chunk_documents(docs, carry=("form_id", "source_file")).select(
        "form_id", "source_file", "doc", "chunk_id", "text", (F.col("chunk_id") % 7).alias("score"),
        F.struct("doc", "chunk_id").alias("rank"))


QUERIES["evd5_rule_extraction"] = lambda spark, sf: pairs.extract_by_rules(rule_hits(spark, sf), RULES)
ORACLES["evd5_rule_extraction"] = with_ctes(r"""
SELECT form_id, field_id, value, arg_min(confidence, k) AS confidence, arg_min(source_file, k) AS source_file, arg_min(chunk_id, k) AS chunk_id
FROM (SELECT *, round_even(least(0.95::DOUBLE, 0.62::DOUBLE + least(chunk_id % 7, 5) * 0.05::DOUBLE + 0.05::DOUBLE), 2) AS confidence, struct_pack(d := doc, c := chunk_id) AS k
  FROM (SELECT form_id, source_file, doc, chunk_id, r.f AS field_id,
      regexp_replace(trim(regexp_replace(regexp_replace(v, '(?is)\s+(?:[A-Za-z][A-Za-z0-9_]*(?:\.[A-Za-z0-9_]+)+\s*[:=-]|table_[0-9]+_row_[0-9]+\s*:).*$', ''), '\s+', ' ', 'g')), '^[\s,.;]+|[\s,.;]+$', '', 'g') AS value
    FROM (SELECT c.*, d.lang AS form_id, d.source AS source_file, unnest([
        {'f': 'contact.email', 'v': regexp_extract(c.text, '([A-Za-z0-9._]+@[A-Za-z0-9.-]+[.][a-z]{2,})', 1)},
        {'f': 'contact.phone', 'v': coalesce(nullif(regexp_extract(c.text, '([+]\d [(]\d{3}[)] \d{3}-\d{4})', 1), ''), regexp_extract(trim(regexp_replace(c.text, '\s+', ' ', 'g')), '([+]\d [(]\d{3}[)] \d{3}-\d{4})', 1))},
        {'f': 'first.number', 'v': CASE WHEN d.lang = 'en' THEN regexp_extract(c.text, '(\d{2,})', 1) END},
        {'f': 'end.word', 'v': CASE WHEN d.lang = 'de' THEN regexp_extract(c.text, '([A-Za-z]+)[.]$', 1) END}]) AS r
      FROM chunks c JOIN documents d ON d.doc_id = c.doc), LATERAL (SELECT r.v AS v))
  WHERE value <> '' AND CASE WHEN field_id = 'first.number' THEN length(value) <= 60 ELSE length(value) <= 120 END)
GROUP BY form_id, field_id, value""")

ANCHORS = (("near.number", "(?i) the ", 120, 120, r"(\d{3})", 0.90), ("after.anchor", "(?i) der ", 0, 40, r" der ([a-z]+)", 0.86))
PARTS = (("line.first", r"^([^\n]+)", r",\s+|\.\s+", 0, 0.95), ("line.third", r"^([^\n]+)", r",\s+|\.\s+", 2, 0.92))

QUERIES["evd6_window_extraction"] = lambda spark, sf: pairs.extract_in_window(doc_chunks(spark, sf).select("doc", "chunk_id", "text"), ANCHORS, PARTS)
ORACLES["evd6_window_extraction"] = with_ctes(r"""
WITH t AS (SELECT doc, chunk_id, text, trim(regexp_replace(text, '\s+', ' ', 'g')) AS flat FROM chunks),
a AS (SELECT *, CASE WHEN regexp_matches(flat, '(?i) the ') THEN length(regexp_extract(flat, '(?is)^(.*?) the ', 1)) + 1 END AS p1,
  CASE WHEN regexp_matches(flat, '(?i) der ') THEN length(regexp_extract(flat, '(?is)^(.*?) der ', 1)) + 1 END AS p2,
  list_filter(regexp_split_to_array(regexp_extract(text, '^([^\n]+)', 1), ',\s+|\.\s+'), lambda x: trim(x) <> '') AS parts FROM t),
v AS (SELECT doc, chunk_id, unnest([
  {'f': 'near.number', 'v': nullif(regexp_extract(substr(flat, greatest(1, p1 - 120), p1 + 5 + 120 - greatest(1, p1 - 120)), '(\d{3})', 1), ''), 'c': 0.90::DOUBLE},
  {'f': 'after.anchor', 'v': nullif(regexp_extract(substr(flat, p2, 45), ' der ([a-z]+)', 1), ''), 'c': 0.86::DOUBLE},
  {'f': 'line.first', 'v': trim(parts[1]), 'c': 0.95::DOUBLE}, {'f': 'line.third', 'v': trim(parts[3]), 'c': 0.92::DOUBLE}]) AS r FROM a)
SELECT doc, chunk_id, r.f AS field_id, r.v AS value, r.c AS confidence FROM v WHERE r.v IS NOT NULL""")


def json_paths(spark, sf):
    j = F.expr("""concat('{"order": {"station": "', event_type, ' ", "signedDate": "', day(ts), ' marzo 21", "empty": ', CASE WHEN event_id % 2 = 0 THEN '[]' ELSE '{}' END,
        '}, "props": ', props, ', "note": ', CASE WHEN event_id % 3 = 0 THEN '""' ELSE '"x;"' END, '}')""")
    mapping = (("order.station", ("facility", "site.name")), ("order.signedDate", ("signed",)), ("order.empty", ("never",)),
               ("props.k", ("key.number",)), ("note", ("note",)), ("missing.path", ("never",)))
    return pairs.extract_by_path(table(spark, sf, "events").select("event_id", j.alias("j")), "j", mapping, ["event_id"])


QUERIES["evd7_json_paths"] = json_paths
ORACLES["evd7_json_paths"] = """
SELECT event_id, 'order.station' AS path, f AS field_id, event_type AS value, 0.97::DOUBLE AS confidence FROM events, (VALUES ('facility'), ('site.name')) v(f)
UNION ALL SELECT event_id, 'order.signedDate', 'signed', printf('2021-03-%02d', day(ts)), 0.97::DOUBLE FROM events
UNION ALL SELECT event_id, 'props.k', 'key.number', json_extract_string(props, '$.k'), 0.97::DOUBLE FROM events
UNION ALL SELECT event_id, 'note', 'note', 'x', 0.97::DOUBLE FROM events WHERE event_id % 3 <> 0"""


def payloads(spark, sf):
    j = F.expr("""concat('{"schema_id": "s1", "status": "done", "document_id": "', event_id, '", "fields": {"kind": {"value": "', event_type,
        '", "confidence": 0.', user_id % 10, ', "sources": ["p', event_id % 3, '"]}, "k": ', event_id % 50, ', "none": {"confidence": null, "sources": []}}}')""")
    return pairs.flatten_payload(table(spark, sf, "events").select("event_id", j.alias("j")), "j", ["event_id"])


QUERIES["evd8_payload_fields"] = payloads
ORACLES["evd8_payload_fields"] = """
SELECT event_id, 's1' AS schema_id, 'done' AS status, CAST(event_id AS VARCHAR) AS document_id, 'kind' AS field_id, event_type AS value,
  CAST('0.' || (user_id % 10) AS DOUBLE) AS confidence, '["p' || (event_id % 3) || '"]' AS sources FROM events
UNION ALL SELECT event_id, 's1', 'done', CAST(event_id AS VARCHAR), 'k', CAST(event_id % 50 AS VARCHAR), NULL, NULL FROM events
UNION ALL SELECT event_id, 's1', 'done', CAST(event_id AS VARCHAR), 'none', '', NULL, NULL FROM events"""

# ------------------------------------------------------------------ matching
QUERIES["evd9_field_matches"] = own_candidates
ORACLES["evd9_field_matches"] = with_ctes("SELECT * FROM candidates")

QUERIES["evd10_governed_aliases"] = lambda spark, sf: match.resolve_aliases(
    pairs.strict_pairs(inputs.evidence_chunks(spark, sf)), ALIAS_RULES).drop("source_text", "page")
ORACLES["evd10_governed_aliases"] = with_ctes("""
SELECT packet_id, form_id, source_file, source_type, chunk_id, scope_hint, line_no, label, value, from_key, field_id, direction, risk, authority,
  direction = 'write_bridge' AS authorises_write
FROM strict_pairs JOIN alias_rules ON from_key = regexp_replace(label, '[^a-z0-9]+', '_', 'g')
WHERE (scope_hint IS NULL OR scope_hint = form_id) AND (len(forms) = 0 OR list_contains(forms, form_id))""")

BACKFILL = (("order.status", "order.remark"), ("order.remark", "audit.note"), ("customer.name", "audit.note"), ("customer.nation", "customer.region"), ("audit.note", "audit.copy"))


def backfill(spark, sf):
    entries = staged_ledger(spark, sf)
    cands = entries.where("value is not null").select("packet_id", "form_id", "field_id", "value", "confidence", "source_file", "chunk_id")
    return match.expand_aliases(cands, BACKFILL)


QUERIES["evd11_alias_backfill"] = backfill
ORACLES["evd11_alias_backfill"] = with_ctes("""
WITH c AS (SELECT packet_id, form_id, field_id, value, confidence, source_file, chunk_id FROM own_guarded WHERE value IS NOT NULL),
s AS (SELECT *, CAST(NULL AS VARCHAR) AS origin FROM c),
r AS (SELECT * REPLACE ('order.remark' AS field_id), field_id AS origin FROM c WHERE field_id = 'order.status'),
n AS (SELECT packet_id, form_id, 'audit.note' AS field_id, value, confidence, source_file, chunk_id, 'order.remark' AS origin FROM r
  UNION ALL SELECT packet_id, form_id, 'audit.note', value, confidence, source_file, chunk_id, 'customer.name' FROM c
    WHERE field_id = 'customer.name' AND packet_id NOT IN (SELECT packet_id FROM r))
SELECT * FROM s UNION ALL SELECT packet_id, form_id, field_id, value, confidence, source_file, chunk_id, origin FROM r
UNION ALL SELECT * FROM n UNION ALL SELECT packet_id, form_id, 'audit.copy', value, confidence, source_file, chunk_id, 'audit.note' FROM n
UNION ALL SELECT packet_id, form_id, 'customer.region', value, confidence, source_file, chunk_id, 'customer.nation' FROM c WHERE field_id = 'customer.nation'""")



def identity(spark, sf):
    """Each part as a packet: a mark, a number that may be missing or empty, and two fields
    that stand for its identity."""
    k, words = F.col("p_partkey"), F.split("p_name", " ")
    head = [F.upper(F.substring(words[i], 1, 4)) for i in (0, 1)]

    def row(field, value, confidence):
        return F.struct(field.alias("field_id"), value.alias("value"), F.lit(confidence).alias("confidence"))

    rows = F.array(
        row(F.lit("mark"), F.concat_ws(" ", head[0], F.col("p_size")), 0.5),
        row(F.when(k % 3 != 0, "number").otherwise("other"), F.when(k % 7 == 0, "").otherwise(F.concat_ws("-", head[1], k + 1000)), 0.6),
        row(F.lit("car"), F.lit("old"), 0.4), row(F.lit("plate"), F.lit(""), 0.99))
    cands = table(spark, sf, "part").select(k.alias("packet_id"), F.lit("F").alias("form_id"), F.inline(rows))
    return match.combine_identity(cands, "mark", "number", ["car", "plate"])


QUERIES["evd11_identity"] = identity
ORACLES["evd11_identity"] = """
WITH p AS (SELECT p_partkey AS k, upper(left(string_split(p_name, ' ')[1], 4)) || ' ' || p_size AS mark,
  CASE WHEN p_partkey % 7 = 0 THEN '' ELSE upper(left(string_split(p_name, ' ')[2], 4)) || '-' || (p_partkey + 1000) END AS number FROM part),
i AS (SELECT *, CASE WHEN k % 3 <> 0 AND number <> '' THEN number ELSE mark END AS id FROM p)
SELECT k AS packet_id, 'F' AS form_id, 'mark' AS field_id, mark AS value, 0.5::DOUBLE AS confidence FROM i
UNION ALL SELECT k, 'F', CASE WHEN k % 3 <> 0 THEN 'number' ELSE 'other' END, number, 0.6 FROM i
UNION ALL SELECT k, 'F', 'car', id, 0.95 FROM i UNION ALL SELECT k, 'F', 'plate', id, 0.99 FROM i"""


TIERS = {"low": 1, "medium": 3}


def graded(spark, sf):
    """The governed aliases as proposals whose tier follows from their risk."""
    found = match.resolve_aliases(pairs.strict_pairs(inputs.evidence_chunks(spark, sf)), ALIAS_RULES)
    tier = F.when(F.col("value").startswith("5"), None)
    for risk, n in TIERS.items():
        tier = tier.when(F.col("risk") == risk, n)
    text = F.when(F.col("line_no") % 2 == 0, "").otherwise(F.upper("label"))
    return match.grade_aliases(found.select("packet_id", "form_id", "chunk_id", "line_no", "label", "field_id", text.alias("from_text"), tier.alias("tier")))


QUERIES["dec9_alias_tiers"] = graded
ORACLES["dec9_alias_tiers"] = with_ctes("""
SELECT *, CASE WHEN auto_usable THEN 'use' ELSE 'review' END AS route FROM (SELECT *, coalesce(tier <= 2, false) AS auto_usable FROM (
  SELECT packet_id, form_id, chunk_id, line_no, label, field_id, CASE WHEN line_no % 2 = 0 THEN label ELSE upper(label) END AS from_text,
    CAST(CASE WHEN starts_with(value, '5') THEN NULL WHEN risk = 'low' THEN 1 WHEN risk = 'medium' THEN 3 END AS INTEGER) AS tier
  FROM strict_pairs JOIN alias_rules ON from_key = regexp_replace(label, '[^a-z0-9]+', '_', 'g')
  WHERE (scope_hint IS NULL OR scope_hint = form_id) AND (len(forms) = 0 OR list_contains(forms, form_id))))""")

LABELS = ("Order Status", "Date of the Order", "Priority", "Order Priority Code", "Equipment Calibration", "Approved Order Status", "Notes Text", "Drawing Number")


def packet_evidence(spark, sf):
    docs = table(spark, sf, "orders").select(F.col("o_orderkey").alias("doc_id"), F.col("o_custkey").alias("packet_id"))
    # two columns of all orders look small beside their file; they would pass the driver whole
    found = pairs.label_pairs(inputs.label_documents(spark, sf)).join(docs.hint(match.GROWS), "doc_id")
    return found.groupBy("packet_id", "key", "value").agg(F.min(F.struct("doc_id", "ord")).alias("ord"))


def packet_labels(spark, sf):
    rows = F.array(*[F.struct(F.lit(i).alias("label_id"), F.lit(x).alias("label")) for i, x in enumerate(LABELS)])
    return table(spark, sf, "customer").select(F.col("c_custkey").alias("packet_id"), F.inline(rows))


# keys to try before fuzzy matching: (tokens that must occur in the label, keys)
PREFERRED = ((("calibration",), ("calibration due",)), (("handling", "notes"), ("notes",)))

QUERIES["evd12_fuzzy_labels"] = lambda spark, sf: match.fuzzy_labels(packet_labels(spark, sf), packet_evidence(spark, sf), PREFERRED)
CTES["packet_evidence"] = """
SELECT o_custkey AS packet_id, key, value, min(struct_pack(d := doc_id, o := ord)) AS ord FROM label_pairs JOIN orders ON o_orderkey = doc_id GROUP BY ALL"""
CTES["fuzzy_labels"] = r"""
WITH lab AS (SELECT label_id, l_key, string_split(l_key, ' ') AS lt FROM (VALUES (0, 'order status'), (1, 'date order'), (2, 'priority'), (3, 'order priority code'),
    (4, 'equipment calibration'), (5, 'approved order status'), (6, 'notes text'), (7, 'drawing number')) v(label_id, l_key)),
keys AS (SELECT DISTINCT packet_id, key, string_split(key, ' ') AS kt FROM packet_evidence),
tries AS (
  SELECT packet_id, label_id, l_key, key, 0 AS stage FROM lab JOIN keys ON key = l_key
  UNION ALL SELECT packet_id, label_id, l_key, key, 1 FROM lab JOIN keys ON label_id = 4 AND key = 'calibration due'
  UNION ALL SELECT packet_id, label_id, l_key, key, 2 FROM (
    SELECT *, row_number() OVER (PARTITION BY packet_id, label_id ORDER BY score DESC, key) AS r FROM (
      SELECT packet_id, label_id, l_key, key, n / greatest(len(lt), len(kt))::DOUBLE + CASE WHEN n = len(lt) OR n = len(kt) THEN 0.25::DOUBLE ELSE 0 END AS score
      FROM (SELECT *, len(list_intersect(lt, kt)) AS n,
          list_intersect(lt, ['calibration','equipment','function','location','material','method','ndt','personnel','procedure','stencil','stenciling','thermocouple','training','visual','welding']) AS sens FROM lab, keys)
      WHERE n > 0 AND (NOT list_contains(lt, 'date') OR list_contains(kt, 'date'))
        AND (NOT list_has_any(lt, ['id','number','no','form','drawing','spec','stencil','mark','mtr']) OR list_has_any(kt, ['id','number','no','form','drawing','spec','stencil','mark','mtr']))
        AND (len(sens) = 0 OR list_has_any(kt, sens)) AND (len(lt) < 3 OR n >= 2)))
    WHERE r = 1 AND score >= 0.38),
ok AS (SELECT *, CASE WHEN label_id = 1 THEN length(value) ELSE 0 END AS len FROM tries JOIN packet_evidence e USING (packet_id, key)
  WHERE lower(value) NOT IN ('n/a', 'na', 'none', '-') AND CASE label_id
    WHEN 1 THEN regexp_matches(value, '^(?:[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}|[0-9]{1,2}/[0-9]{1,2}/[0-9]{2,4}|[0-9]{1,2}[-\s][A-Za-z]+[-\s][0-9]{2,4})$')
    WHEN 5 THEN len(regexp_split_to_array(trim(value), '\s+')) <= 3 AND regexp_matches(value, '^[A-Za-z0-9./-]{1,16}(?:\s+[A-Za-z0-9./-]{1,16}){0,2}$')
    WHEN 7 THEN regexp_matches(value, '\d') ELSE true END)
SELECT packet_id, label_id, value, key AS matched_key, CASE stage WHEN 0 THEN 'direct' WHEN 1 THEN 'preferred' ELSE 'fuzzy' END AS step
FROM (SELECT *, row_number() OVER (PARTITION BY packet_id, label_id ORDER BY stage, len, ord, value) AS r FROM ok) WHERE r = 1"""
ORACLES["evd12_fuzzy_labels"] = with_ctes("SELECT * FROM fuzzy_labels")

# ------------------------------------------------------------------ scopes and ledger
NAME_RULES = (("ONE", "src1"), ("TWO", "src.*2$"), ("ONE_TWO", "src12"))
EXACT_RULES = (("MAIL", "@mail3"), ("PHONE", r"[+]1 [(]"))
LOOSE_RULES = (("GERMAN", "(?iu)heit|keit"), ("SPANISH", "(?iu)ción"), ("FRENCH", "(?iu)ement"))


def scoped(spark, sf):
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("doc"), "text", F.col("source").alias("source_file"), (F.col("doc_id") % 3).alias("packet_id"))
    return ledger.assign_scope(retrieve.chunk_documents(docs, carry=("source_file", "packet_id")), NAME_RULES, EXACT_RULES, LOOSE_RULES)


CTES["scoped_chunks"] = """
SELECT doc, chunk_id, source AS source_file, doc % 3 AS packet_id, CASE
  WHEN CAST(source LIKE '%src1%' AS INTEGER) + CAST(regexp_matches(source, 'src.*2$') AS INTEGER) + CAST(source LIKE '%src12%' AS INTEGER) = 1
    THEN CASE WHEN source LIKE '%src1%' THEN 'ONE' ELSE 'TWO' END
  WHEN c.text LIKE '%@mail3%' THEN 'MAIL' WHEN contains(c.text, '+1 (') THEN 'PHONE'
  WHEN regexp_matches(c.text, '(?i)heit|keit') THEN 'GERMAN' WHEN regexp_matches(c.text, '(?i)ción') THEN 'SPANISH'
  WHEN regexp_matches(c.text, '(?i)ement') THEN 'FRENCH' END AS scope_hint
FROM chunks c JOIN documents d ON d.doc_id = c.doc"""
QUERIES["evd13_scopes"] = lambda spark, sf: scoped(spark, sf).select("doc", "chunk_id", "source_file", "packet_id", "scope_hint")
ORACLES["evd13_scopes"] = with_ctes("SELECT * FROM scoped_chunks")

QUERIES["evd14_multi_scope_sources"] = lambda spark, sf: ledger.multi_scope_sources(scoped(spark, sf))
ORACLES["evd14_multi_scope_sources"] = with_ctes("SELECT packet_id, source_file FROM scoped_chunks GROUP BY 1, 2 HAVING count(DISTINCT scope_hint) >= 2")

QUERIES["evd15_guarded_ledger"] = lambda spark, sf: own_ledger(spark, sf, own_scope_only=False)[0]
ORACLES["evd15_guarded_ledger"] = with_ctes("SELECT * FROM open_guarded")


def best(spark, sf, part):
    multi = ledger.multi_scope_sources(inputs.evidence_chunks(spark, sf))
    return ledger.pick_best(own_candidates(spark, sf), multi, universe(spark, sf))[part]


QUERIES["evd16_best_candidates"] = lambda spark, sf: best(spark, sf, 0)
ORACLES["evd16_best_candidates"] = with_ctes("SELECT * FROM own_ledger")
QUERIES["evd16_alternates"] = lambda spark, sf: best(spark, sf, 1)
ORACLES["evd16_alternates"] = with_ctes("SELECT * FROM own_alternates")


def run_fill(spark, sf):
    cands = own_candidates(spark, sf).where("strength >= 0.5").select(
        "packet_id", "form_id", "field_id", "value", F.col("strength").alias("confidence"), "source_file", "chunk_id")
    run_values = ledger.run_level_values(cands, "orders_[12]", group=["form_id"])
    forms = inputs.packets(spark, sf).select("packet_id", "form_id")
    # here a run is a form's whole evidence, so its values are offered to each of its packets
    offers = forms.join(run_values, "form_id").select("packet_id", "field_id", "value", "confidence", "source_file", "chunk_id")
    return ledger.fill_gaps(cands, offers, forms, skip=[("ASIA", "order.status")])


QUERIES["evd17_run_level_fill"] = run_fill
ORACLES["evd17_run_level_fill"] = with_ctes(r"""
WITH c AS (SELECT packet_id, form_id, field_id, value, strength AS confidence, source_file, chunk_id FROM candidates WHERE strength >= 0.5),
b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY form_id, field_id ORDER BY confidence DESC,
    CASE WHEN regexp_matches(source_file, 'orders_[12]') THEN 2 ELSE 0 END DESC, length(regexp_replace(value, '[^\p{L}\p{N}\s-]', '', 'g')) DESC,
    value DESC, source_file DESC, chunk_id DESC) AS r FROM c) WHERE r = 1)
SELECT *, false AS run_level FROM c
UNION ALL
SELECT p.packet_id, p.form_id, b.field_id, b.value, b.confidence, b.source_file, b.chunk_id, true
FROM packets p JOIN b USING (form_id) WHERE NOT (form_id = 'ASIA' AND b.field_id = 'order.status')
  AND NOT EXISTS (SELECT 1 FROM c WHERE c.packet_id = p.packet_id AND c.field_id = b.field_id)""")


def records(spark, sf):
    o, k = table(spark, sf, "orders"), F.col("o_orderkey")
    prose = o.select(F.col("o_custkey").alias("section"), F.lit(0).alias("source"), k.alias("seq"),
                     F.when(k % 3 == 0, F.col("o_orderstatus")).alias("status"), F.lit(None).cast("string").alias("priority"),
                     F.when(k % 5 == 0, F.concat(F.lit("clerk "), (F.col("o_custkey") % 3).cast("string"))).alias("approved_by"))
    rows = o.select(F.col("o_custkey").alias("section"), F.lit(1).alias("source"), k.alias("seq"),
                    F.lit("R").alias("status"), F.when(k % 2 == 0, F.col("o_orderpriority")).alias("priority"), F.lit(None).cast("string").alias("approved_by"))
    parts = prose.unionByName(rows).withColumn("packet", F.floor(F.col("section") / 4))
    return ledger.merge_records(parts, ["packet", "section"], ["status", "priority", "approved_by"], ["source", "seq"], shared="approved_by", scope=["packet"])


QUERIES["evd18_merged_records"] = records
ORACLES["evd18_merged_records"] = """
WITH m AS (SELECT o_custkey // 4 AS packet, o_custkey AS section,
  coalesce(arg_min(o_orderstatus, o_orderkey) FILTER (o_orderkey % 3 = 0), 'R') AS status,
  arg_min(o_orderpriority, o_orderkey) FILTER (o_orderkey % 2 = 0) AS priority,
  CASE WHEN bool_or(o_orderkey % 5 = 0) THEN 'clerk ' || (o_custkey % 3) END AS own FROM orders GROUP BY o_custkey)
SELECT packet, section, status, priority, coalesce(own, CASE WHEN min(own) OVER w = max(own) OVER w THEN min(own) OVER w END) AS approved_by
FROM m WINDOW w AS (PARTITION BY packet)"""

PATH_RULES = (("widget", "catalog.widget.size"), ("rod", "catalog.rod.length"), ("promo.*hot", "promo.flag"))


def schema_paths(spark, sf):
    part = table(spark, sf, "part")
    labels = part.select(F.col("p_brand").alias("form_id"), F.concat_ws(" ", F.initcap("p_type"), "p_name", F.lit("Date")).alias("label"))
    paths = part.select(F.col("p_brand").alias("form_id"),
                                                   F.concat(F.lit("catalog."), F.replace("p_name", F.lit(" "), F.lit(".")), F.lit(".size")).alias("path"))
    return match.infer_paths(labels, paths, PATH_RULES)


QUERIES["evd19_schema_paths"] = schema_paths
ORACLES["evd19_schema_paths"] = r"""
WITH l AS (SELECT DISTINCT p_brand AS form_id, upper(left(p_type, 1)) || lower(substr(p_type, 2)) || ' ' || p_name || ' Date' AS label FROM part),
p AS (SELECT DISTINCT p_brand AS form_id, 'catalog.' || replace(p_name, ' ', '.') || '.size' AS path FROM part),
r AS (SELECT *, CASE WHEN lower(label) LIKE '%widget%' THEN 'catalog.widget.size' WHEN lower(label) LIKE '%rod%' THEN 'catalog.rod.length'
  WHEN regexp_matches(lower(label), 'promo.*hot') THEN 'promo.flag' END AS rp FROM l),
w AS (SELECT l.form_id, l.label, min(p.path) AS wp FROM l JOIN p ON p.form_id = l.form_id
  AND len(list_filter(string_split(lower(l.label), ' '), lambda x: length(x) > 3 AND contains(lower(p.path), x))) > 0 GROUP BY ALL)
SELECT form_id, label, coalesce(rp, wp) AS path, CASE WHEN rp IS NOT NULL THEN
    CASE WHEN EXISTS (SELECT 1 FROM p WHERE p.form_id = r.form_id AND (p.path = rp OR ends_with(p.path, string_split(rp, '.')[-1]))) THEN 0.75::DOUBLE ELSE 0.55::DOUBLE END
  WHEN wp IS NOT NULL THEN 0.45::DOUBLE ELSE 0.0::DOUBLE END AS confidence, 'date' AS field_type
FROM r LEFT JOIN w USING (form_id, label)"""

# ------------------------------------------------------------------ bundles and answers
def bundles(spark, sf):
    return answers.bundle(requirements(spark, sf), reranked(spark, sf))


CTES["bundles"] = r"""
SELECT q.*, coalesce(b.items, 0) AS items, CASE WHEN b.items IS NULL THEN 'No evidence found for ''' || field_label || ''' (' || search_directive || ')' END AS gap,
  coalesce(snippets, 0) > 3 AS contradiction, CASE WHEN coalesce(snippets, 0) > 3 THEN by_authority ELSE by_weight END AS best
FROM requirements q LEFT JOIN (
  SELECT req_id, count(*) AS items, count(DISTINCT trim(regexp_replace(lower(content), '\s+', ' ', 'g'))) AS snippets,
    arg_max(item, struct_pack(w := round(confidence * authority, 9), l := length(content), r := -rank)) AS by_weight,
    arg_max(item, struct_pack(a := authority, r := -rank)) AS by_authority
  FROM (SELECT *, struct_pack(source_file := source_file, doc := doc, chunk_id := chunk_id, confidence := confidence, authority := authority, content := content) AS item
    FROM reranked) GROUP BY req_id) b USING (req_id)"""
QUERIES["evd20_bundles"] = lambda spark, sf: bundles(spark, sf).select(
    "req_id", "items", "gap", "contradiction", F.col("best.source_file").alias("source_file"), F.col("best.doc").alias("doc"), F.col("best.chunk_id").alias("chunk_id"))
ORACLES["evd20_bundles"] = with_ctes("""
SELECT req_id, items, gap, contradiction, best.source_file AS source_file, best.doc AS doc, best.chunk_id AS chunk_id FROM bundles""")

CTES["answers"] = r"""
SELECT req_id, field_type, required, mapping_confidence, can_auto_fill, fallback_behavior, field_label, items, gap, contradiction,
  CASE WHEN fb THEN CASE WHEN field_type = 'number' AND required THEN 'N/A - not verified in provided source documents'
      WHEN fallback_behavior IN ('leave_blank', 'use_default') THEN '' ELSE 'Not verified in provided source documents.' END
    WHEN field_type = 'narrative' THEN 'Based on source documentation (' || best.source_file || '), ' || field_label || ': ' || found ELSE found END AS text,
  CASE WHEN fb THEN CASE WHEN field_type = 'number' AND required THEN 'N/A - not verified in provided source documents'
      WHEN fallback_behavior IN ('leave_blank', 'use_default') THEN '' ELSE 'Not verified in provided source documents.' END
    WHEN field_type = 'narrative' THEN 'Based on source documentation (' || best.source_file || '), ' || field_label || ': ' || left(found, CASE WHEN field_type IN ('number', 'date') THEN 80 ELSE 500 END) ELSE left(found, CASE WHEN field_type IN ('number', 'date') THEN 80 ELSE 500 END) END AS shown,
  CASE WHEN fb THEN 0.0::DOUBLE ELSE conf END AS confidence,
  CASE WHEN fb THEN CASE WHEN contains(lower(why), 'conflict') THEN 'completed_with_conflict_resolution' WHEN contains(lower(why), 'failure') THEN 'failed_with_fallback' ELSE 'completed_with_missing_evidence' END
    WHEN contradiction THEN 'completed_with_conflict_resolution' WHEN conf < 0.55 THEN 'completed_with_low_confidence' ELSE 'completed' END AS status,
  fb AS fallback, CASE WHEN NOT fb THEN best.source_file END AS cited, why AS justification
FROM (SELECT *, items = 0 OR NOT can_auto_fill AS fb, least(0.99::DOUBLE, best.confidence * best.authority) AS conf,
    CASE WHEN items = 0 THEN 'Missing evidence: ' || gap
      WHEN NOT can_auto_fill THEN printf('Low mapping confidence (%.2f); fallbackBehavior=', mapping_confidence) || fallback_behavior
      ELSE 'Synthesized from ' || items || ' evidence item(s). Semantic match for: ' || field_label END AS why,
    CASE field_type WHEN 'number' THEN CASE WHEN regexp_matches(t, '[-+]?\d*\.?\d+(?:\s*%)?') THEN regexp_extract(t, '[-+]?\d*\.?\d+(?:\s*%)?') ELSE string_split(t, '.')[1] END
      WHEN 'date' THEN CASE WHEN regexp_matches(t, '\b\d{1,2}[/-]\d{1,2}[/-]\d{2,4}\b|\b\d{4}-\d{2}-\d{2}\b') THEN regexp_extract(t, '\b\d{1,2}[/-]\d{1,2}[/-]\d{2,4}\b|\b\d{4}-\d{2}-\d{2}\b') ELSE t END
      ELSE coalesce(nullif(regexp_extract(t, '(?s)^(.*?[.!?])(?:\s.*)?$', 1), ''), t) END AS found
  FROM (SELECT *, trim(best.content) AS t FROM bundles))"""
QUERIES["evd21_answers"] = lambda spark, sf: answers.answers(bundles(spark, sf)).drop("query", "search_directive")
ORACLES["evd21_answers"] = with_ctes("SELECT * FROM answers")


def field_terms(spark, sf):
    """What to search for where a field has no value."""
    return inputs.field_spec(spark, sf).select("form_id", "field_id", "label", F.array(F.substring_index("label", " ", -1), F.lit("pending"), F.col("label")).alias("terms"))


def gap_search(spark, sf):
    entries = staged_ledger(spark, sf)
    found = retrieve.targeted_search(entries, inputs.evidence_chunks(spark, sf), field_terms(spark, sf))
    return ledger.apply_targeted(entries.join(found.select("packet_id", "form_id", "field_id"), ["packet_id", "form_id", "field_id"], "left_semi"), found).select(
        "packet_id", "form_id", "field_id", "value", "source_file", "chunk_id", "source_text", "scope", "confidence", "decision")


QUERIES["ret9_targeted_search"] = gap_search


WORD_LIST = f"regexp_extract_all(lower(@), '{TERM}')"
OVERLAP_LIST = "list_distinct(regexp_extract_all(lower(@), '[a-z0-9_./-]+'))"
CTES["gaps"] = f"""
SELECT packet_id, form_id, field_id, confidence AS old, label, [string_split(label, ' ')[-1], 'pending', label] AS terms,
  label || ' ' || string_split(label, ' ')[-1] || ' pending ' || label AS query_text
FROM own_guarded JOIN field_spec USING (form_id, field_id) WHERE decision NOT IN ('usable', 'conflict')"""


def gap_ctes(p: str, asks: str, scope: str) -> None:
    """CTE <p>_top: the five best chunks of each asked field, by the statistics of its packet."""
    grams = "list_concat(w, list_transform(generate_series(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1]))"
    on, chunk = "packet_id, form_id", "packet_id, form_id, source_file, chunk_id"
    CTES[f"{p}_chunks"] = f"""
SELECT g.packet_id, g.form_id, source_file, chunk_id, {WORD_LIST.replace('@', 'text')} AS w, {OVERLAP_LIST.replace('@', 'text')} AS o, count(*) OVER (PARTITION BY g.packet_id, g.form_id) AS nd
FROM (SELECT DISTINCT packet_id, form_id FROM {asks}) g JOIN evidence_chunks c ON c.packet_id = g.packet_id AND ({scope})"""
    CTES[f"{p}_cp"] = f"SELECT {chunk}, nd, term, count(*) AS n FROM (SELECT {chunk}, nd, unnest({grams}) AS term FROM {p}_chunks WHERE nd > 1) GROUP BY ALL"
    CTES[f"{p}_df"] = f"SELECT {on}, term, count(*) AS df FROM {p}_cp GROUP BY ALL"
    CTES[f"{p}_asked"] = f"SELECT {on}, field_id, {WORD_LIST.replace('@', 'query_text')} AS w, {OVERLAP_LIST.replace('@', 'query_text')} AS o FROM {asks}"
    CTES[f"{p}_qp"] = f"SELECT {on}, field_id, term, count(*) AS n FROM (SELECT {on}, field_id, unnest({grams}) AS term FROM {p}_asked) GROUP BY ALL"
    CTES[f"{p}_q"] = f"""
SELECT q.*, ln((2.0::DOUBLE + nd) / (2.0::DOUBLE + coalesce(df, 0))) + 1.0::DOUBLE AS idf
FROM {p}_qp q JOIN (SELECT DISTINCT {on}, nd FROM {p}_chunks) USING ({on}) LEFT JOIN {p}_df USING ({on}, term)"""
    CTES[f"{p}_c"] = f"SELECT c.*, ln((2.0::DOUBLE + nd) / (1.0::DOUBLE + df)) + 1.0::DOUBLE AS idf FROM {p}_cp c JOIN {p}_df USING ({on}, term)"
    CTES[f"{p}_top"] = f"""
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {on}, field_id ORDER BY score DESC, source_file, chunk_id) AS rank FROM (
    SELECT {chunk}, field_id, round(dot / (sqrt(ss + shift) * qn), 6) AS score
    FROM (SELECT {', '.join('c.' + x for x in chunk.split(', '))}, field_id, sum(c.n * q.idf * q.n * q.idf) AS dot, sum(CAST(c.n AS DOUBLE) * c.n * (q.idf * q.idf - c.idf * c.idf)) AS shift
      FROM {p}_c c JOIN {p}_q q USING ({on}, term) GROUP BY ALL)
    JOIN (SELECT {chunk}, sum(n * idf * n * idf) AS ss FROM {p}_c GROUP BY ALL) USING ({chunk})
    JOIN (SELECT {on}, field_id, sqrt(sum(n * idf * n * idf)) AS qn FROM {p}_q GROUP BY ALL) USING ({on}, field_id)
    UNION ALL
    SELECT {chunk}, field_id, round(len(list_intersect(c.o, a.o)) / CAST(len(a.o) AS DOUBLE), 6) FROM {p}_chunks c JOIN {p}_asked a USING ({on}) WHERE nd = 1)
  WHERE score >= 0.05) WHERE rank <= 5"""


gap_ctes("near", "gaps", "scope_hint IS NULL OR scope_hint = g.form_id")
CTES["far_gaps"] = "SELECT * FROM gaps WHERE NOT EXISTS (SELECT 1 FROM near_top n WHERE n.packet_id = gaps.packet_id AND n.form_id = gaps.form_id AND n.field_id = gaps.field_id)"
gap_ctes("far", "far_gaps", "true")


def _good(v: str) -> str:
    return f"({v} <> '' AND length({v}) <= 100 AND NOT regexp_matches({v}, '[:=]$') AND NOT regexp_matches({v}, '^[A-Z][a-z]+ [A-Z][a-z]+ [A-Z][a-z]+$'))"


_pair = r"'^\s*([A-Za-z0-9 _./()&\-#]+?)\s*[:=\-\x{2013}]\s*(.+?)$'"
CTES["gap_snippets"] = r"""
SELECT *, trim(regexp_replace(substring(text, greatest(1, place - 60), place + length(term) + 120 - greatest(1, place - 60)), '\s+', ' ', 'g')) AS snippet
FROM (SELECT *, instr(lower(text), term) AS place FROM (
  SELECT t.*, c.text, c.scope_hint, g.old, [lower(label)] || low AS all_terms, list_filter(low, lambda x: contains(lower(text), x))[1] AS term, scope_hint IS NULL OR scope_hint = t.form_id AS own
  FROM (SELECT * FROM near_top UNION ALL SELECT * FROM far_top) t JOIN evidence_chunks c ON c.packet_id = t.packet_id AND c.source_file = t.source_file AND c.chunk_id = t.chunk_id
  JOIN (SELECT *, list_transform(terms, lambda x: lower(trim(x))) AS low FROM gaps) g ON g.packet_id = t.packet_id AND g.form_id = t.form_id AND g.field_id = t.field_id))"""
CTES["gap_values"] = rf"""
SELECT *, CASE WHEN own OR rank = 1 THEN coalesce(list_filter(behind, lambda v: {_good('v')})[1],
    CASE WHEN regexp_matches(snippet, {_pair}) AND {_good('found_value')}
      AND len(list_filter(all_terms, lambda t: contains(found_label, t) OR contains(t, found_label))) > 0 THEN found_value END) END AS value
FROM (SELECT *, lower(trim(regexp_extract(snippet, {_pair}, 1))) AS found_label, trim(regexp_extract(snippet, {_pair}, 2)) AS found_value,
  list_transform(list_filter(all_terms, lambda t: contains(lower(snippet), t)), lambda t: trim(regexp_extract(substring(snippet, instr(lower(snippet), t) + length(t)), '^:\s*(.+?)$', 1))) AS behind
  FROM gap_snippets)"""
ORACLES["ret9_targeted_search"] = with_ctes("""
SELECT packet_id, form_id, field_id, coalesce(f.hit.value, l.value) AS value, f.hit.source_file AS source_file, f.hit.chunk_id AS chunk_id, f.hit.snippet AS source_text,
  coalesce(f.hit.scope_hint, l.scope) AS scope, greatest(old, CASE WHEN f.hit.value IS NOT NULL THEN least(0.75::DOUBLE, 0.5::DOUBLE + f.hit.score) ELSE least(0.5::DOUBLE, 0.3::DOUBLE + f.hit.score) END) AS confidence,
  CASE WHEN f.hit.value IS NOT NULL THEN 'usable' ELSE 'weak' END AS decision
FROM (SELECT packet_id, form_id, field_id, old, coalesce(arg_min(x, rank) FILTER (x.value IS NOT NULL), arg_min(x, rank)) AS hit, arg_min(x, rank) AS head
  FROM (SELECT *, struct_pack(source_file := source_file, chunk_id := chunk_id, scope_hint := scope_hint, score := score, snippet := snippet, value := value) AS x FROM gap_values)
  GROUP BY packet_id, form_id, field_id, old) f
JOIN own_guarded l USING (packet_id, form_id, field_id) WHERE f.head.snippet IS NOT NULL""")
