"""Queries over decisions, policies, lineage and audit tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from proofgrain.functions import text as tx
from proofgrain.operators import answers, decide, lineage
from proofgrain.plans import inputs
from proofgrain.plans.ctes import CTES, with_ctes
from proofgrain.plans.evidence_queries import PREFERRED, bundles, field_terms, own_candidates, packet_evidence, packet_labels, staged_alternates, staged_ledger
from proofgrain.plans.stages import stage
from proofgrain.operators import match

QUERIES, ORACLES = {}, {}


def pk(spark, sf):
    return inputs.packets(spark, sf).select("packet_id", "form_id")


# ------------------------------------------------------------------ review mode
def suggestions(spark, sf):
    return stage(spark, sf, "candidates", lambda: own_candidates(spark, sf)).select(
        "packet_id", "form_id", "field_id", "value", "source_file", "chunk_id", "page",
        F.col("strength").alias("confidence"), F.coalesce("page", F.lit(0)).alias("score"))


def required_fields(spark, sf):
    need = inputs.field_spec(spark, sf).where("required").select("form_id", "field_id")
    return pk(spark, sf).join(need, "form_id")


def reviewed(spark, sf):
    return stage(spark, sf, "reviewed", lambda: decide.decide(required_fields(spark, sf), suggestions(spark, sf), 0.75))


CTES["suggestions"] = "SELECT packet_id, form_id, field_id, value, source_file, chunk_id, page, strength AS confidence, coalesce(page, 0) AS score FROM candidates"
CTES["reviewed"] = """
SELECT packet_id, form_id, field_id, required, 'FILL' AS state,
  CASE WHEN b.value IS NULL THEN 'REVIEW_REQUIRED: ' || field_id || ' missing retrieved evidence candidate' ELSE b.value END AS value,
  CASE WHEN b.value IS NULL THEN 1.0::DOUBLE WHEN n > 1 OR conf < 0.75 THEN greatest(conf, 0.75::DOUBLE) ELSE conf END AS confidence,
  CASE WHEN b.value IS NULL THEN 'missing required evidence; visible marker inserted for human completion'
    WHEN n > 1 THEN 'auto-filled best candidate; conflicting extracted values require reviewer verification'
    WHEN conf < 0.75 THEN 'auto-filled low-confidence candidate below threshold 0.75; reviewer verification required'
    ELSE 'selected highest-confidence local evidence' END AS reason,
  coalesce(n, 0) AS n_values, b.value IS NULL OR n > 1 OR conf < 0.75 AS needs_review
FROM (SELECT packet_id, form_id, field_id, coalesce(r.required, false) AS required, b.value, b.conf, b.n
  FROM (SELECT p.packet_id, f.form_id, f.field_id, true AS required FROM packets p JOIN field_spec f USING (form_id) WHERE f.required) r
  FULL JOIN (SELECT packet_id, form_id, field_id, arg_max(value, struct_pack(c := confidence, s := score, l := length(value), v := value)) AS value,
      max(confidence) AS conf, count(DISTINCT value) AS n FROM suggestions GROUP BY ALL) b USING (packet_id, form_id, field_id)) b"""
QUERIES["dec1_review_decisions"] = lambda spark, sf: decide.decide(required_fields(spark, sf), suggestions(spark, sf), 0.75)
ORACLES["dec1_review_decisions"] = with_ctes("SELECT * FROM reviewed")


def cells(spark, sf):
    d = reviewed(spark, sf)
    return d.select("packet_id", "form_id", "field_id", decide.decide_cell(
        F.col("value"), F.col("confidence"), 0.9, F.col("required"), F.col("n_values") > 2, F.when(F.col("packet_id") % 5 == 0, "notes").otherwise("target")).alias("state"))


QUERIES["dec1_cell_decisions"] = cells
ORACLES["dec1_cell_decisions"] = with_ctes("""
SELECT packet_id, form_id, field_id, CASE WHEN n_values > 2 THEN 'CONFLICT' WHEN confidence < 0.9 THEN 'LOW_CONFIDENCE'
  WHEN packet_id % 5 = 0 THEN 'REVIEW_REQUIRED' ELSE 'FILL' END AS state FROM reviewed""")

QUERIES["dec2_decision_summary"] = lambda spark, sf: decide.summarize(reviewed(spark, sf), ["FILL", "BLANK"])
ORACLES["dec2_decision_summary"] = with_ctes("""
SELECT packet_id, form_id, count(*) AS fields, count(*) FILTER (state = 'FILL') AS fill, count(*) FILTER (state = 'BLANK') AS blank,
  count(*) FILTER (needs_review) AS human_review FROM reviewed GROUP BY ALL""")
QUERIES["dec2_review_lists"] = lambda spark, sf: decide.review_lists(reviewed(spark, sf))
ORACLES["dec2_review_lists"] = with_ctes("""
SELECT packet_id, form_id, field_id, 'fill_eligible' AS list FROM reviewed
UNION ALL SELECT packet_id, form_id, field_id, 'human_review' FROM reviewed WHERE needs_review
UNION ALL SELECT packet_id, form_id, field_id, 'missing' FROM reviewed WHERE reason LIKE '%missing%'
UNION ALL SELECT packet_id, form_id, field_id, 'conflict' FROM reviewed WHERE n_values > 1
UNION ALL SELECT packet_id, form_id, field_id, 'low_confidence' FROM reviewed WHERE reason LIKE '%below threshold%'""")


# ------------------------------------------------------------------ matrix
def approvals(spark, sf):
    return decide.na_approvals(inputs.field_spec(spark, sf), staged_ledger(spark, sf), inputs.na_policy(spark, sf), pk(spark, sf))


def judgements(spark, sf):
    p = F.col("packet_id")
    return staged_ledger(spark, sf).where("decision in ('conflict', 'weak')").select(
        "packet_id", "field_id", F.when(p % 3 == 0, "supports_field").otherwise("unclear").alias("judgement"),
        (F.lit(0.6) + (p % 5) / 10).alias("judged"))


def matrix(spark, sf, judged=False):
    return decide.decide_matrix(inputs.field_spec(spark, sf), staged_ledger(spark, sf), pk(spark, sf),
                                approvals(spark, sf), judgements(spark, sf) if judged else None)


def decisions(spark, sf):
    return stage(spark, sf, "decisions", lambda: matrix(spark, sf))


CTES["na_approved"] = """
SELECT p.packet_id, f.form_id, f.field_id, n.policy_id FROM packets p JOIN field_spec f USING (form_id) JOIN na_policy n ON n.form_id = f.form_id AND n.field_id = f.field_id
WHERE f.required AND f.na_allowed AND NOT EXISTS (SELECT 1 FROM own_guarded l WHERE l.packet_id = p.packet_id AND l.field_id = f.field_id AND l.value <> '')"""
CTES["judgements"] = """
SELECT packet_id, field_id, CASE WHEN packet_id % 3 = 0 THEN 'supports_field' ELSE 'unclear' END AS judgement, 0.6::DOUBLE + (packet_id % 5) / 10::DOUBLE AS judged
FROM own_guarded WHERE decision IN ('conflict', 'weak')"""


def _matrix(name: str, judged: bool) -> None:
    won = "(judgement = 'supports_field' AND judged >= CASE WHEN what = 'conflict' THEN 0.8 ELSE 0.75 END) IS TRUE" if judged else "false"
    join = "LEFT JOIN judgements j ON j.packet_id = p.packet_id AND j.field_id = f.field_id" if judged else ""
    CTES[f"{name}_input"] = f"""
SELECT *, {won} AS won, round_even(confidence * 0.95::DOUBLE, 4) AS wr,
  CASE WHEN coalesce(value, '') = '' THEN true WHEN field_id LIKE '%date%' THEN regexp_matches(value, '^\\s*(?:\\d{{1,2}}/\\d{{1,2}}/\\d{{2,4}}|\\d{{4}}-\\d{{2}}-\\d{{2}})\\s*$') AND length(value) <= 60
    WHEN field_id LIKE '%.name' THEN length(value) <= 60 ELSE length(value) <= 120 END AS ok
FROM (SELECT p.packet_id, p.form_id, f.field_id, f.label, f.required, f.never_write, f.authorised AS auth, l.value, coalesce(l.value, '') <> '' AS has,
    coalesce(l.decision, 'missing') AS what, l.confidence, l.source_file, l.page, l.chunk_id, l.alias_used, coalesce(l.n_alternates, 0) AS n_alternates,
    n.field_id IS NOT NULL AS na {", judgement, judged" if judged else ""}
  FROM packets p JOIN field_spec f USING (form_id)
  LEFT JOIN own_guarded l ON l.packet_id = p.packet_id AND l.field_id = f.field_id
  LEFT JOIN na_approved n ON n.packet_id = p.packet_id AND n.field_id = f.field_id {join})"""
    CTES[f"{name}_verdict"] = f"""
SELECT *, CASE
  WHEN never_write THEN ['OPTIONAL_BLANK', 'Never-write field; left untouched.']
  WHEN what = 'conflict' AND auth AND NOT required THEN ['OPTIONAL_BLANK', 'Optional field; conflicting candidates found, so left blank.']
  WHEN what = 'conflict' AND auth AND won AND NOT ok THEN ['LOW_CONFIDENCE', 'Judgement resolved the conflict but the value failed the sanity gate.']
  WHEN what = 'conflict' AND auth AND won THEN ['FILL', 'Conflict resolved by judgement.']
  WHEN what = 'conflict' AND auth THEN ['CONFLICT', 'Multiple distinct values in evidence: primary=''' || value || '''; alternates=' || n_alternates]
  WHEN has AND auth AND what <> 'weak' AND NOT ok AND NOT required THEN ['OPTIONAL_BLANK', 'Optional field; implausible candidate found, so left blank.']
  WHEN has AND auth AND what <> 'weak' AND NOT ok THEN ['LOW_CONFIDENCE', 'Value failed sanity gate: ''' || left(value, 40) || '...'' is not a plausible value for ' || field_id || '.']
  WHEN has AND auth AND what <> 'weak' AND wr > 0 AND wr < 0.6 AND n_alternates > 0 AND won THEN ['FILL', 'Low confidence promoted by judgement.']
  WHEN has AND auth AND what <> 'weak' AND wr > 0 AND wr < 0.6 THEN ['LOW_CONFIDENCE', 'Evidence value ''' || value || ''' present but write-confidence too low (' || wr || ').']
  WHEN has AND auth AND what <> 'weak' THEN ['FILL', 'Authorized fill from ' || source_file || ' (chunk ' || chunk_id || ').']
  WHEN has AND NOT auth THEN ['BLOCKED_UNAUTHORIZED', 'Evidence found but no exact approval-map authorization for this cell.']
  WHEN what = 'weak' AND NOT required THEN ['OPTIONAL_BLANK', 'Optional field; weak candidate found, so left blank.']
  WHEN what = 'weak' AND (confidence < 0.75 OR n_alternates > 0) AND won AND NOT ok THEN ['LOW_CONFIDENCE', 'Judgement supports the value but it failed the sanity gate.']
  WHEN what = 'weak' AND (confidence < 0.75 OR n_alternates > 0) AND won THEN ['FILL', 'Weak evidence promoted by judgement.']
  WHEN what = 'weak' THEN ['LOW_CONFIDENCE', 'Targeted-search hint found but no extracted value.']
  WHEN what = 'out_of_scope' AND NOT required THEN ['OPTIONAL_BLANK', 'Optional field; only out-of-scope candidates found, so left blank.']
  WHEN what = 'out_of_scope' THEN ['BLOCKED_NO_SOURCE', 'Only out-of-scope candidates found (cross-form contamination).']
  WHEN required AND na THEN ['APPROVED_NA', 'No evidence found; approved N/A exception applied.']
  WHEN required THEN ['REVIEW_REQUIRED', 'Required field with no evidence and no approved N/A; manual review marker emitted.']
  ELSE ['OPTIONAL_BLANK', 'Optional field; left blank.'] END AS v FROM {name}_input"""
    CTES[name] = f"""
SELECT packet_id, form_id, field_id, label, required, never_write, v[1] AS state, CASE WHEN v[1] IN ('FILL', 'LOW_CONFIDENCE') THEN value END AS value, v[2] AS reason,
  authority AS write_authority, round_even(r, 4) AS retrieval, round_even(ex, 4) AS extraction, CASE WHEN full_auth THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS "authorization",
  round_even(w, 4) AS write, round_even(CASE WHEN has AND w > 0 THEN least(w, 0.95::DOUBLE) WHEN na THEN 0.99::DOUBLE ELSE 0.0::DOUBLE END, 4) AS completion,
  source_file, page, chunk_id, alias_used, n_alternates
FROM (SELECT *, CASE WHEN na AND b = 0 THEN 0.99::DOUBLE ELSE b END AS w FROM (SELECT *, CASE WHEN has AND full_auth THEN least(ex, 1.0::DOUBLE) ELSE 0.0::DOUBLE END AS b
  FROM (SELECT *, authority = 'exact_approval_map' AS full_auth, coalesce(confidence, 0.0::DOUBLE) AS r, CASE WHEN has THEN coalesce(confidence, 0.0::DOUBLE) * 0.95::DOUBLE ELSE 0.0::DOUBLE END AS ex
    FROM (SELECT *, CASE WHEN v[1] = 'APPROVED_NA' THEN 'approved_na_insertion'
        WHEN never_write OR v[1] IN ('BLOCKED_UNAUTHORIZED', 'REVIEW_REQUIRED') OR NOT auth THEN 'unauthorized' ELSE 'exact_approval_map' END AS authority FROM {name}_verdict))))"""


_matrix("decided", False)
_matrix("judged_matrix", True)
QUERIES["dec3_decision_matrix"] = matrix
ORACLES["dec3_decision_matrix"] = with_ctes("SELECT * FROM decided")

AXES = ("retrieval", "extraction", "authorization", "write", "completion")
QUERIES["dec4_confidence_axes"] = lambda spark, sf: matrix(spark, sf).select(
    "packet_id", "form_id", "field_id", *AXES, ((F.col("write") > 0) & (F.col("write") < 0.6)).alias("low"))
ORACLES["dec4_confidence_axes"] = with_ctes("""
SELECT packet_id, form_id, field_id, retrieval, extraction, "authorization", write, completion, write > 0 AND write < 0.6 AS low FROM decided""")


def shapes(spark, sf):
    c = suggestions(spark, sf)
    key = F.when(F.col("packet_id") % 2 == 0, "order date").otherwise("mark number")
    return c.groupBy("field_id", "value", "packet_id").agg(F.count("*").alias("n")).select(
        "packet_id", "field_id", "value", tx.plausible(F.col("field_id"), F.col("value")).alias("plausible"),
        decide.unsafe_reason(key, F.col("field_id"), F.col("value")).alias("unsafe"))


QUERIES["dec5_value_shapes"] = shapes
ORACLES["dec5_value_shapes"] = with_ctes(r"""
SELECT DISTINCT packet_id, field_id, value, CASE WHEN field_id LIKE '%date%' THEN regexp_matches(value, '^\s*(?:\d{1,2}/\d{1,2}/\d{2,4}|\d{4}-\d{2}-\d{2})\s*$') ELSE length(value) <= 120 END AS plausible,
  CASE WHEN CASE WHEN packet_id % 2 = 0 THEN regexp_matches(value, '^(?:[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}|[0-9]{1,2}/[0-9]{1,2}/[0-9]{2,4}|[0-9]{1,2}[-\s][A-Za-z]+[-\s][0-9]{2,4})$')
      ELSE regexp_full_match(value, '(?i)[A-Z]{2,10}(?:[-\s][A-Z0-9]{2,10})?') OR regexp_matches(value, '\d') END THEN '' ELSE 'rejected incompatible value; needs manual completion' END AS unsafe
FROM candidates""")

QUERIES["dec6_na_approvals"] = approvals
ORACLES["dec6_na_approvals"] = with_ctes("SELECT * FROM na_approved")

POLICY = (
    {"forms": ["asia"], "optional": ["*remark*"], "required": ["customer.*", "order_r*"], "required_ids": ["order.remark"]},
    {"form_prefixes": ["A"], "optional": ["customer.balance"], "required": ["*.nation", "account_?alance", "*mark*"]},
    {"forms": ["EUROPE"], "required": ["*"]},
)


def policy_fields(spark, sf):
    """Map rows per form and part name: field ids with and without clone suffixes."""
    parts = inputs.table(spark, sf, "part").select(F.concat(F.replace("p_name", F.lit(" "), F.lit("_")), F.lit("_"), (F.col("p_partkey") % 7).cast("string")).alias("clone"), "p_partkey")
    spec = inputs.field_spec(spark, sf)
    return spec.select("form_id", "field_id", "label").unionByName(
        parts.select(F.element_at(F.array(*[F.lit(r) for r in ("AFRICA", "ASIA", "EUROPE")]), (F.col("p_partkey") % 3 + 1).cast("int")).alias("form_id"),
                     F.when(F.col("p_partkey") % 2 == 0, F.col("clone")).otherwise(F.concat(F.lit("part.mark."), "p_partkey")).alias("field_id"),
                     F.lit("Order / R-est").alias("label")).distinct())


QUERIES["dec7_required_policy"] = lambda spark, sf: decide.promote_required(policy_fields(spark, sf), POLICY)
ORACLES["dec7_required_policy"] = with_ctes(r"""
WITH f AS (SELECT form_id, field_id, label FROM field_spec UNION ALL
  SELECT DISTINCT (['AFRICA', 'ASIA', 'EUROPE'])[p_partkey % 3 + 1], CASE WHEN p_partkey % 2 = 0 THEN replace(p_name, ' ', '_') || '_' || (p_partkey % 7) ELSE 'part.mark.' || p_partkey END, 'Order / R-est' FROM part),
n AS (SELECT *, regexp_replace(trim(regexp_replace(lower(label), '[/-]', ' ', 'g')), '\s+', '_', 'g') AS l, regexp_matches(field_id, '_\d+$') AS clone FROM f)
SELECT form_id, field_id, label, NOT clone AND (
  (form_id = 'ASIA' AND NOT (field_id GLOB '*remark*' OR l GLOB '*remark*') AND (field_id GLOB 'customer.*' OR l GLOB 'customer.*' OR field_id GLOB 'order_r*' OR l GLOB 'order_r*' OR field_id = 'order.remark'))
  OR (form_id LIKE 'A%' AND NOT field_id = 'customer.balance' AND (field_id GLOB '*.nation' OR l GLOB '*.nation' OR field_id GLOB 'account_?alance' OR l GLOB 'account_?alance' OR field_id GLOB '*mark*' OR l GLOB '*mark*'))
  OR form_id = 'EUROPE') AS promoted FROM n""")

QUERIES["dec8_obligations"] = lambda spark, sf: decide.obligations(inputs.field_spec(spark, sf), inputs.na_policy(spark, sf), ["order.priority"], POLICY)
ORACLES["dec8_obligations"] = with_ctes("""
SELECT form_id, field_id, label, CAST(tbl AS INTEGER) AS tbl, CAST(row AS INTEGER) AS row, CAST(col AS INTEGER) AS col, req AS required, NOT req AS optional, na AS na_allowed, req AS evidence_required, req AND NOT na AS completion_blocker,
  never_write, label || '|' || lower(label) AS search_terms
FROM (SELECT f.*, n.field_id IS NOT NULL OR f.field_id = 'order.priority' AS na, f.required OR (f.form_id = 'ASIA' AND f.field_id LIKE 'customer.%')
    OR (f.form_id LIKE 'A%' AND f.field_id <> 'customer.balance' AND (f.field_id LIKE '%.nation' OR f.field_id LIKE '%mark%' OR f.label LIKE '%Market%')) OR f.form_id = 'EUROPE' AS req
  FROM field_spec f LEFT JOIN na_policy n USING (form_id, field_id))""")
QUERIES["dec8_classified_fields"] = lambda spark, sf: decide.classify(decide.obligations(inputs.field_spec(spark, sf), inputs.na_policy(spark, sf)))
ORACLES["dec8_classified_fields"] = with_ctes("""
SELECT form_id, count(*) FILTER (NOT never_write AND required) AS required_total, count(*) FILTER (NOT never_write AND NOT required) AS optional_total,
  count(*) FILTER (never_write) AS never_write_total FROM field_spec GROUP BY 1""")

QUERIES["dec9_judged_decisions"] = lambda spark, sf: matrix(spark, sf, judged=True)
ORACLES["dec9_judged_decisions"] = with_ctes("SELECT * FROM judged_matrix")


def drafts(spark, sf):
    made = answers.answers(bundles(spark, sf)).drop("query", "search_directive")
    return made.withColumn("valid_place", F.col("req_id") % 13 != 5).withColumn(
        "text", F.when(F.col("req_id") % 17 == 3, F.concat(F.lit("review_required: "), "text")).otherwise(F.col("text"))).withColumn(
        "expected_unit", F.when(F.col("req_id") % 2 == 0, "mm"))


QUERIES["dec10_validated_answers"] = lambda spark, sf: answers.validate_answers(drafts(spark, sf)).select(
    "req_id", "text", "shown", "confidence", "status", "fallback", "justification")
CTES["drafts"] = "SELECT * REPLACE (CASE WHEN req_id % 17 = 3 THEN 'review_required: ' || text ELSE text END AS text), req_id % 13 <> 5 AS valid_place, CASE WHEN req_id % 2 = 0 THEN 'mm' END AS expected_unit FROM answers"
_nv = "CASE WHEN field_type = 'number' THEN 'N/A - not verified in provided source documents' ELSE 'Not verified in provided source documents.' END"


def _gate_steps() -> str:
    """The same ordered checks, one nested SELECT per check."""
    sql = "SELECT *, trim(text) AS t, confidence AS c, status AS s, fallback AS fb, justification AS why FROM drafts"

    def step(sql, cond, t="t", c="c", s="s", fb="fb", why="why"):
        cols = ", ".join(f"CASE WHEN ({cond}) IS TRUE THEN {v} ELSE {n} END AS {n}" for n, v in (("t", t), ("c", c), ("s", s), ("fb", fb), ("why", why)))
        name = f"gate_{sum(n.startswith('gate_') for n in CTES)}"
        CTES[name] = sql
        return f"SELECT * REPLACE ({cols}) FROM {name}"

    none = "'Not verified in provided source documents.'"
    miss, fail = "'completed_with_missing_evidence'", "'failed_with_fallback'"
    sql = step(sql, "NOT valid_place", none, s=fail, fb="true", why="why || '; invalid write coordinate'")
    sql = step(sql, "NOT can_auto_fill", f"CASE WHEN fallback_behavior = 'leave_blank' THEN '' ELSE {_nv} END", "0.0::DOUBLE", fail, "true")
    sql = step(sql, "items = 0", _nv, "0.0::DOUBLE", miss, "true", "'Missing evidence: ' || gap")
    sql = step(sql, "items > 0 AND contradiction AND cited IS NOT NULL", s="'completed_with_conflict_resolution'",
               why="why || '; resolved conflict: Multiple distinct evidence snippets; authority resolution may apply'")
    sql = step(sql, r"field_type = 'number' AND t <> '' AND NOT fb AND NOT regexp_matches(replace(t, ',', ''), '^[-+]?\d*\.?\d+')",
               "'N/A - not verified in provided source documents'", s=miss, fb="true")
    sql = step(sql, r"field_type = 'date' AND t <> '' AND NOT fb AND NOT regexp_matches(t, '^\d{4}-\d{2}-\d{2}$|^\d{1,2}[/-]\d{1,2}[/-]\d{2,4}$') AND try_strptime(left(t, 10), ['%m/%d/%Y', '%d/%m/%Y']) IS NULL", none, fb="true")
    sql = step(sql, "required AND t = '' AND fallback_behavior <> 'leave_blank'", _nv, s=miss, fb="true")
    sql = step(sql, "NOT fb AND c >= 0.55", s="CASE WHEN cited IS NOT NULL AND c >= 0.8 THEN 'completed' ELSE 'completed_with_low_confidence' END")
    sql = step(sql, "contains(upper(t), 'REVIEW_REQUIRED')", none, s=fail, fb="true")
    return sql


CTES["validated"] = f"SELECT req_id, t AS text, CASE WHEN length(t) > 2000 THEN left(t, 1997) || '...' ELSE t END AS shown, c AS confidence, s AS status, fb AS fallback, why AS justification FROM ({_gate_steps()})"
ORACLES["dec10_validated_answers"] = with_ctes("SELECT * FROM validated")
QUERIES["dec10_strict_gate"] = lambda spark, sf: answers.validate_answers_strict(drafts(spark, sf))
ORACLES["dec10_strict_gate"] = with_ctes("""
SELECT req_id, CASE WHEN contains(r, 'REVIEW_REQUIRED') THEN 'Not verified in provided source documents.' ELSE r END AS resolved,
  CASE WHEN contains(r, 'REVIEW_REQUIRED') THEN 'modified_by_fallback' WHEN NOT fall THEN 'accepted' WHEN fallback_behavior = 'leave_blank' THEN 'blanked' ELSE 'modified_by_fallback' END AS action,
  NOT fall AND NOT contains(r, 'REVIEW_REQUIRED') AS valid, low AS low_confidence, empty AS missing_required
FROM (SELECT *, CASE WHEN NOT fall THEN text WHEN fallback_behavior = 'leave_blank' THEN '' WHEN fallback_behavior = 'use_default' THEN CASE WHEN expected_unit IS NOT NULL THEN '0 ' || expected_unit ELSE 'N/A' END
    WHEN fallback_behavior = 'fill_not_verified' OR trim(text) = '' THEN 'Not verified in provided source documents.' ELSE trim(text) END AS r
  FROM (SELECT *, low OR empty AS fall FROM (SELECT *, NOT can_auto_fill OR confidence < 0.7 AS low, required AND trim(text) = '' AS empty FROM drafts)))""")


# ------------------------------------------------------------------ publishing and judging
def published(spark, sf):
    return decide.publish(decisions(spark, sf), inputs.field_spec(spark, sf))


CTES["published"] = """
SELECT packet_id, form_id, field_id, tbl, row, col, kind, CASE kind WHEN 'write' THEN value WHEN 'na_insert' THEN 'N/A' WHEN 'marker' THEN '<<REVIEW_REQUIRED>>' END AS text,
  CASE kind WHEN 'write' THEN write_authority = 'exact_approval_map' WHEN 'na_insert' THEN write_authority = 'approved_na_insertion' WHEN 'marker' THEN true END AS authorised,
  kind IN ('blocked', 'marker') AS blocked
FROM (SELECT d.*, f.tbl, f.row, f.col, CASE WHEN state = 'FILL' AND value IS NOT NULL THEN 'write' WHEN state = 'APPROVED_NA' THEN 'na_insert' WHEN state = 'REVIEW_REQUIRED' THEN 'marker'
    WHEN state = 'OPTIONAL_BLANK' THEN 'skip' ELSE 'blocked' END AS kind FROM decided d JOIN field_spec f USING (form_id, field_id))"""
QUERIES["dec11_publish_table"] = published
ORACLES["dec11_publish_table"] = with_ctes("SELECT * REPLACE (CAST(tbl AS INTEGER) AS tbl, CAST(row AS INTEGER) AS row, CAST(col AS INTEGER) AS col) FROM published")


def review_writes(spark, sf):
    d = reviewed(spark, sf).withColumn("role", F.when(F.col("packet_id") % 4 == 0, "notes").otherwise("target")).withColumn(
        "value", F.when(F.col("packet_id") % 9 == 0, F.lit(None)).when(F.col("packet_id") % 9 == 1, "").otherwise(F.col("value")))
    return decide.value_for_write(d, 0.8).select("packet_id", "form_id", "field_id", "role", "written")


QUERIES["dec11_review_writes"] = review_writes
ORACLES["dec11_review_writes"] = with_ctes("""
SELECT packet_id, form_id, field_id, role, CASE WHEN role = 'notes' AND coalesce(v, '') <> '' THEN v WHEN role = 'notes' THEN CASE WHEN required THEN 'REVIEW_REQUIRED: ' || field_id || ' missing required notes' END
  WHEN v IS NULL THEN CASE WHEN required THEN 'REVIEW_REQUIRED: ' || field_id || ' missing required value' END WHEN v LIKE 'REVIEW_REQUIRED%' THEN v
  WHEN v = '' THEN CASE WHEN required THEN 'REVIEW_REQUIRED: ' || field_id || ' missing required value' ELSE '' END
  WHEN confidence < 0.8 THEN 'REVIEW_REQUIRED: ' || field_id || ' low confidence ' || printf('%.2f', confidence) ELSE v END AS written
FROM (SELECT *, CASE WHEN packet_id % 4 = 0 THEN 'notes' ELSE 'target' END AS role, CASE packet_id % 9 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE value END AS v FROM reviewed)""")


def gap_fill(spark, sf):
    d = reviewed(spark, sf).select("packet_id", "form_id", "field_id", F.when((F.col("packet_id") % 6 != 0) | (F.col("field_id") != "order.priority"), F.col("value")).alias("value"), "confidence")
    names = F.element_at(F.array(*[F.lit(n) for n in ("order.status", "order.date", "order.priority", "extra.code", "extra.calibration", "extra.approved", "extra.notes", "extra.drawing")]), F.col("label_id") + 1)
    offers = match.fuzzy_labels(packet_labels(spark, sf), packet_evidence(spark, sf), PREFERRED).join(pk(spark, sf).hint(match.GROWS), "packet_id").select(
        "packet_id", "form_id", names.alias("field_id"), F.col("value").alias("offer"))
    return decide.mark_missing(decide.fill_from_labels(d, offers), required_fields(spark, sf))


QUERIES["dec12_gap_fill"] = gap_fill
ORACLES["dec12_gap_fill"] = with_ctes("""
WITH d AS (SELECT packet_id, form_id, field_id, CASE WHEN packet_id % 6 <> 0 OR field_id <> 'order.priority' THEN value END AS value, confidence FROM reviewed),
o AS (SELECT packet_id, form_id, (['order.status', 'order.date', 'order.priority', 'extra.code', 'extra.calibration', 'extra.approved', 'extra.notes', 'extra.drawing'])[label_id + 1] AS field_id, value AS offer FROM fuzzy_labels JOIN packets USING (packet_id)),
f AS (SELECT packet_id, form_id, field_id, CASE WHEN takes THEN offer ELSE value END AS value, CASE WHEN takes THEN greatest(coalesce(confidence, 0.0::DOUBLE), 0.99::DOUBLE) ELSE confidence END AS confidence, takes
  FROM (SELECT *, offer IS NOT NULL AND (coalesce(value, '') = '' OR contains(value, 'REVIEW_REQUIRED')) AS takes FROM d FULL JOIN o USING (packet_id, form_id, field_id))),
r AS (SELECT packet_id, form_id, field_id, true AS need FROM packets JOIN field_spec USING (form_id) WHERE required)
SELECT packet_id, form_id, field_id, CASE WHEN gone THEN 'REVIEW_REQUIRED: ' || field_id || ' missing evidence candidate; needs manual completion' ELSE value END AS value,
  CASE WHEN gone THEN 1.0::DOUBLE ELSE confidence END AS confidence, coalesce(takes, false) AS from_label, gone AS marked
FROM (SELECT *, coalesce(need, false) AND trim(coalesce(value, '')) = '' AS gone FROM f FULL JOIN r USING (packet_id, form_id, field_id))""")


def visible_cells(spark, sf):
    """The published cells as a reader would find them: some lost, some with a marker left."""
    p = F.col("packet_id")
    return published(spark, sf).where("text is not null").select(
        "packet_id", "form_id", "tbl", "row", "col",
        F.when(p % 13 == 0, "").when(p % 17 == 0, F.concat("text", F.lit(" <<REVIEW_REQUIRED>>"))).otherwise(F.col("text")).alias("text"))


CTES["visible"] = """
SELECT packet_id, form_id, tbl, row, col, CASE WHEN packet_id % 13 = 0 THEN '' WHEN packet_id % 17 = 0 THEN text || ' <<REVIEW_REQUIRED>>' ELSE text END AS text
FROM published WHERE text IS NOT NULL"""
CTES["placed"] = """
SELECT d.*, coalesce(v.text, '') AS text FROM decided d JOIN field_spec f USING (form_id, field_id)
LEFT JOIN visible v ON v.packet_id = d.packet_id AND v.form_id = d.form_id AND v.tbl = f.tbl AND v.row = f.row AND v.col = f.col"""
QUERIES["dec13_completeness"] = lambda spark, sf: decide.completeness(visible_cells(spark, sf), inputs.field_spec(spark, sf), pk(spark, sf))[1]
ORACLES["dec13_completeness"] = with_ctes("""
SELECT packet_id, form_id, count(*) FILTER (s = 'filled') AS filled, count(*) FILTER (s = 'manual_marker') AS markers, count(*) FILTER (s = 'blank') AS blank, count(*) FILTER (s = 'blank') = 0 AS complete
FROM (SELECT packet_id, form_id, CASE WHEN trim(text) = '' THEN 'blank' WHEN contains(text, 'REVIEW_REQUIRED') THEN 'manual_marker' ELSE 'filled' END AS s FROM placed WHERE required AND NOT never_write)
GROUP BY ALL""")


def guard(spark, sf):
    return pk(spark, sf).where("packet_id % 19 <> 7").withColumn("guard_passed", F.col("packet_id") % 11 != 3)


CTES["judged"] = """
SELECT *, CASE WHEN passed THEN 'success' WHEN NOT passed_format THEN 'failed_structure_guard' WHEN blocked_unauthorized > 0 THEN 'failed_unauthorized_write'
  WHEN conflicts > 0 THEN 'failed_conflict_resolution' WHEN low_confidence > 0 THEN 'failed_low_confidence_resolution'
  WHEN blocked_no_source > 0 THEN 'blocked_pending_no_source_or_na_resolution' WHEN review_required > 0 THEN 'blocked_pending_review_required' ELSE 'failed_completion' END AS final_status
FROM (SELECT *, passed_format AND passed_completion AS passed FROM (SELECT *, packet_id % 19 <> 7 AND packet_id % 11 <> 3 AS passed_format,
    required_total = required_filled AND blocked_no_source + blocked_unauthorized + review_required + conflicts + low_confidence = 0 AS passed_completion
  FROM (SELECT packet_id, form_id, count(*) FILTER (required AND NOT never_write) AS required_total,
    count(*) FILTER (required AND (state = 'APPROVED_NA' OR (state = 'FILL' AND seen))) AS required_filled,
    count(*) FILTER (state IN ('BLOCKED_NO_SOURCE', 'BLOCKED_UNAUTHORIZED') OR (required AND (state IN ('REVIEW_REQUIRED', 'CONFLICT', 'LOW_CONFIDENCE') OR (state = 'FILL' AND NOT seen)))) AS required_blocked,
    count(*) FILTER (state = 'REVIEW_REQUIRED') AS review_required, count(*) FILTER (state = 'CONFLICT') AS conflicts, count(*) FILTER (state = 'LOW_CONFIDENCE') AS low_confidence,
    count(*) FILTER (state = 'APPROVED_NA') AS approved_na, count(*) FILTER (state = 'BLOCKED_NO_SOURCE') AS blocked_no_source, count(*) FILTER (state = 'BLOCKED_UNAUTHORIZED') AS blocked_unauthorized
  FROM (SELECT *, text <> '' AND NOT contains(text, '<<REVIEW_REQUIRED>>') AS seen FROM placed) GROUP BY ALL)))"""
QUERIES["dec14_completion_judge"] = lambda spark, sf: decide.judge(decisions(spark, sf), inputs.field_spec(spark, sf), visible_cells(spark, sf), guard(spark, sf))
ORACLES["dec14_completion_judge"] = with_ctes("SELECT * FROM judged")
CTES["blockers"] = """
SELECT packet_id, form_id, field_id, field_id || CASE WHEN state = 'FILL' THEN ': writer claimed FILL but cell visible text is empty/marker' ELSE ': ' || state END AS blocker
FROM placed WHERE (state = 'FILL' AND required AND (text = '' OR contains(text, '<<REVIEW_REQUIRED>>'))) OR state IN ('BLOCKED_NO_SOURCE', 'BLOCKED_UNAUTHORIZED')
  OR (required AND state IN ('REVIEW_REQUIRED', 'CONFLICT', 'LOW_CONFIDENCE'))"""
QUERIES["dec14_blockers"] = lambda spark, sf: decide.blockers(decisions(spark, sf), inputs.field_spec(spark, sf), visible_cells(spark, sf))
ORACLES["dec14_blockers"] = with_ctes("SELECT * FROM blockers")
QUERIES["dec15_readback"] = lambda spark, sf: decide.readback(decisions(spark, sf), inputs.field_spec(spark, sf), visible_cells(spark, sf))
ORACLES["dec15_readback"] = with_ctes("""
SELECT packet_id, form_id, field_id, issue, CASE WHEN issue = 'value_invisible' THEN value END AS expected, text AS visible
FROM (SELECT *, CASE WHEN state = 'FILL' AND value <> '' AND NOT contains(text, value) THEN 'value_invisible' WHEN state = 'FILL' AND value <> '' AND contains(text, '<<REVIEW_REQUIRED>>') THEN 'marker_overlap'
  WHEN state = 'APPROVED_NA' AND NOT contains(text, 'N/A') THEN 'approved_na_not_visible' WHEN state = 'REVIEW_REQUIRED' AND NOT contains(text, '<<REVIEW_REQUIRED>>') THEN 'review_marker_missing' END AS issue FROM placed)
WHERE issue IS NOT NULL""")


def statuses(spark, sf):
    """Runs are thirds of the requirements, forms are items."""
    final = answers.validate_answers(drafts(spark, sf))
    fields = final.select((F.col("req_id") % 3).alias("run_id"), (F.floor(F.col("req_id") / 6)).alias("form_id"), "status", "fallback")
    forms = fields.select("run_id", "form_id").distinct().withColumn("guard_passed", F.col("form_id") % 5 != 0).withColumn(
        "error", F.when(F.col("form_id") % 9 == 1, "boom"))
    return decide.run_status(fields, forms)


CTES["form_status"] = """
SELECT req_id % 3 AS run_id, req_id // 6 AS form_id, CASE WHEN bool_or(status = 'failed_with_fallback') THEN 'failed_with_fallback' WHEN bool_or(status <> 'completed') THEN 'completed_with_warnings' ELSE 'completed' END AS status,
  count(*) AS fields, count(*) FILTER (fallback) AS fallbacks, count(*) FILTER (status = 'completed_with_low_confidence') AS low_confidence FROM validated GROUP BY ALL"""
QUERIES["dec16_form_status"] = lambda spark, sf: statuses(spark, sf)[0]
ORACLES["dec16_form_status"] = with_ctes("SELECT * FROM form_status")
QUERIES["dec16_run_status"] = lambda spark, sf: statuses(spark, sf)[1]
ORACLES["dec16_run_status"] = with_ctes("""
SELECT *, status = 'completed' AND errors = 0 AS overall_passed FROM (SELECT run_id, CASE WHEN bool_or(status = 'failed_with_fallback') THEN 'failed_with_fallback' WHEN bool_or(status <> 'completed') THEN 'completed_with_warnings' ELSE 'completed' END AS status,
  count(*) AS forms, CAST(sum(fields) AS BIGINT) AS fields, CAST(sum(fallbacks) AS BIGINT) AS fallbacks, CAST(sum(low_confidence) AS BIGINT) AS low_confidence,
  bool_and(form_id % 5 <> 0) AS structure_guard_passed, count(*) FILTER (form_id % 9 = 1) AS errors FROM form_status GROUP BY run_id)""")

# ------------------------------------------------------------------ lineage
STATUSES = ("written", "skipped_missing_template", "discarded_structure_guard_failed", "written")


def writes(spark, sf):
    p = F.col("packet_id")
    return pk(spark, sf).where("packet_id % 10 <> 9").select(
        "packet_id", "form_id", F.element_at(F.array(*[F.lit(s) for s in STATUSES]), (p % 4 + 1).cast("int")).alias("status"), (p % 7 != 0).alias("guard_passed"))


def patched(spark, sf):
    return reviewed(spark, sf).where("packet_id % 4 in (0, 3) and packet_id % 7 <> 0 and packet_id % 10 <> 9 and field_id <> 'order.status'").select("packet_id", "form_id", "field_id")


CTES["traced"] = """
SELECT *, map_target IS NOT NULL AND fill AS authorised_for_write, pat AND fill AS filled,
  CASE WHEN pat AND fill THEN NULL WHEN NOT fill THEN 'decision_not_fill:' || coalesce(state, '') WHEN map_target IS NULL THEN 'field_not_in_approval_map' WHEN packet_id % 10 = 9 THEN 'docx_not_attempted'
    WHEN packet_id % 4 = 1 THEN 'skipped_missing_template' WHEN packet_id % 4 = 2 OR packet_id % 7 = 0 THEN 'structure_guard_failed' WHEN NOT pat THEN 'field_not_patched' END AS block_reason,
  CASE state WHEN 'FILL' THEN 'ok' WHEN 'BLANK' THEN 'blank_optional' ELSE 'unknown' END AS reviewer_status
FROM (SELECT s.*, CASE WHEN f.authorised THEN printf('t%d r%d c%d', f.tbl, f.row, f.col) END AS map_target, coalesce(state = 'FILL', false) AS fill,
    packet_id % 4 IN (0, 3) AND packet_id % 7 <> 0 AND packet_id % 10 <> 9 AND field_id <> 'order.status' AS pat
  FROM (SELECT g.packet_id, g.form_id, g.field_id, g.value AS suggested, r.value AS selected, r.state, g.source_file, g.chunk_id, sha256(c.text) AS chunk_hash, g.confidence
      FROM (SELECT packet_id, form_id, field_id, value, source_file, chunk_id, max(confidence) AS confidence FROM suggestions GROUP BY ALL) g
      LEFT JOIN reviewed r USING (packet_id, form_id, field_id) LEFT JOIN evidence_chunks c ON c.packet_id = g.packet_id AND c.source_file = g.source_file AND c.chunk_id = g.chunk_id
    UNION ALL SELECT packet_id, form_id, field_id, NULL, value, state, NULL, NULL, NULL, confidence FROM reviewed r
      WHERE NOT EXISTS (SELECT 1 FROM suggestions g WHERE g.packet_id = r.packet_id AND g.field_id = r.field_id)) s
  JOIN field_spec f USING (form_id, field_id))"""
QUERIES["lin1_traceability"] = lambda spark, sf: lineage.traceability(
    suggestions(spark, sf), reviewed(spark, sf), inputs.field_spec(spark, sf), writes(spark, sf), patched(spark, sf), inputs.evidence_chunks(spark, sf))
ORACLES["lin1_traceability"] = with_ctes("SELECT * EXCLUDE (fill, pat) FROM traced")


def canon(spark, sf):
    return lineage.canonical(reviewed(spark, sf), suggestions(spark, sf), inputs.field_spec(spark, sf), writes(spark, sf), patched(spark, sf))


CTES["canon"] = """
SELECT t.packet_id, t.form_id, t.field_id, any_value(t.state) AS state, any_value(selected) AS selected, any_value(r.confidence) AS confidence, count(DISTINCT suggested) AS candidate_values,
  (SELECT count(DISTINCT (value, source_file, page, chunk_id)) FROM suggestions g WHERE g.packet_id = t.packet_id AND g.field_id = t.field_id) AS sources,
  any_value(reviewer_status) AS reviewer_status, any_value(filled) AS filled, any_value(block_reason) AS block_reason
FROM traced t JOIN reviewed r ON r.packet_id = t.packet_id AND r.form_id = t.form_id AND r.field_id = t.field_id GROUP BY t.packet_id, t.form_id, t.field_id"""
QUERIES["lin2_canonical_fields"] = lambda spark, sf: canon(spark, sf)[0]
ORACLES["lin2_canonical_fields"] = with_ctes("SELECT * FROM canon")
QUERIES["lin2_canonical_values"] = lambda spark, sf: canon(spark, sf)[1]
ORACLES["lin2_canonical_values"] = with_ctes("""
SELECT DISTINCT packet_id, form_id, field_id, value, source_file || CASE WHEN page IS NOT NULL THEN ' p.' || page ELSE '' END || ' chunk=' || chunk_id AS provenance FROM suggestions""")


def roles(spark, sf):
    fields = canon(spark, sf)[0]
    bad = F.when(F.col("packet_id") % 3 == 0, "review_required").otherwise(F.col("reviewer_status"))
    return lineage.role_views(fields.withColumn("reviewer_status", bad))


QUERIES["lin3_role_views"] = roles
ORACLES["lin3_role_views"] = with_ctes("""
WITH c AS (SELECT *, packet_id % 3 = 0 AS gap FROM canon)
SELECT 'auditor' AS role, form_id, 'gap' AS item, field_id, count(*) AS n FROM c WHERE gap GROUP BY ALL
UNION ALL SELECT 'auditor', form_id, 'evidence_map', field_id, count(*) FROM c GROUP BY ALL
UNION ALL SELECT 'operator', form_id, 'usable', field_id, count(*) FROM c WHERE NOT gap AND reviewer_status = 'ok' GROUP BY ALL
UNION ALL SELECT 'admin', form_id, 'field_count', NULL, count(*) FROM c GROUP BY ALL
UNION ALL SELECT 'management', form_id, 'gap_count', NULL, count(*) FILTER (gap) FROM c GROUP BY ALL""")

QUERIES["lin4_explanations"] = lambda spark, sf: lineage.explain(decisions(spark, sf))
ORACLES["lin4_explanations"] = with_ctes("""
SELECT packet_id, form_id, field_id, state, field_id || CASE state
  WHEN 'FILL' THEN ' was filled with ''' || value || ''' because the value was extracted from ' || source_file || CASE WHEN coalesce(page, 0) > 0 THEN ' page ' || page ELSE '' END
    || CASE WHEN alias_used IS NOT NULL THEN ', bridged through the approved ' || alias_used || ' -> ' || field_id || ' alias' ELSE '' END || ', and the ' || form_id || ' exact approval map authorized the target cell.'
  WHEN 'CONFLICT' THEN ' is a CONFLICT: multiple distinct candidate values found (' || n_alternates || ' alternates). The Writer refuses to pick; manual disambiguation required.'
  WHEN 'APPROVED_NA' THEN ' was marked N/A because no evidence was found and the form''s approved N/A exception policy permits this exception. This is not a completion blocker.'
  WHEN 'REVIEW_REQUIRED' THEN ' remains REVIEW_REQUIRED because no extracted value matched the obligation graph for this required field. This is a completion blocker, not a structure failure.'
  WHEN 'LOW_CONFIDENCE' THEN ' is LOW_CONFIDENCE: evidence was found but write-confidence is below threshold. Refusing to fill without human review.'
  WHEN 'BLOCKED_NO_SOURCE' THEN ' is BLOCKED_NO_SOURCE: required, no evidence in scope, no approved N/A. This is a hard completion blocker.'
  WHEN 'BLOCKED_UNAUTHORIZED' THEN ' is BLOCKED_UNAUTHORIZED: a candidate value exists, but the exact approval map does not authorize writes to this cell.'
  ELSE ' was left blank because it is optional and no evidence was found.' END AS explanation FROM decided""")
QUERIES["lin4_conflict_lines"] = lambda spark, sf: lineage.explain_conflicts(decisions(spark, sf), staged_alternates(spark, sf))
ORACLES["lin4_conflict_lines"] = with_ctes("""
SELECT packet_id, form_id, field_id, 'candidate ''' || a.value || ''' from ' || a.source_file || ' (chunk ' || a.chunk_id || ')' AS line
FROM own_alternates a JOIN decided d USING (packet_id, form_id, field_id) WHERE d.state = 'CONFLICT'""")
QUERIES["lin5_evidence_debt"] = lambda spark, sf: lineage.evidence_debt(decisions(spark, sf), field_terms(spark, sf), (("balance", "Ledger extract"), ("status|date", "Order book")))
ORACLES["lin5_evidence_debt"] = with_ctes("""
SELECT packet_id, form_id, field_id, CASE WHEN state IN ('BLOCKED_NO_SOURCE', 'REVIEW_REQUIRED') THEN 'missing_source' WHEN state = 'BLOCKED_UNAUTHORIZED' THEN 'out_of_scope_source' ELSE 'weak_source' END AS debt_type,
  required AS blocking, CASE WHEN field_id LIKE '%balance%' THEN 'Ledger extract' WHEN regexp_matches(field_id, 'status|date') THEN 'Order book' ELSE 'Source document containing ' || label END AS recommended_source,
  CASE state WHEN 'BLOCKED_UNAUTHORIZED' THEN 'update approval map|remove field|approved exception' WHEN 'CONFLICT' THEN 'disambiguate evidence|remove conflicting source|approved exception'
    WHEN 'LOW_CONFIDENCE' THEN 'provide stronger evidence|manual confirmation' ELSE 'provide source|approved exception' END AS resolution_paths,
  string_split(label, ' ')[-1] || '|pending|' || label AS search_terms
FROM decided WHERE state NOT IN ('FILL', 'OPTIONAL_BLANK', 'APPROVED_NA')""")
QUERIES["lin6_exceptions"] = lambda spark, sf: lineage.exceptions(decisions(spark, sf))[0]
CTES["exceptions"] = """
SELECT packet_id, form_id, field_id, CASE WHEN state = 'CONFLICT' THEN 'conflict' WHEN state = 'LOW_CONFIDENCE' THEN 'low_confidence' ELSE 'missing_required' END AS extract, value, reason
FROM decided WHERE state IN ('CONFLICT', 'LOW_CONFIDENCE') OR (required AND state IN ('BLOCKED_NO_SOURCE', 'REVIEW_REQUIRED'))"""
ORACLES["lin6_exceptions"] = with_ctes("SELECT * FROM exceptions")
QUERIES["lin6_exception_counts"] = lambda spark, sf: lineage.exceptions(decisions(spark, sf))[1]
ORACLES["lin6_exception_counts"] = with_ctes("SELECT form_id, extract, count(*) AS n FROM exceptions GROUP BY ALL")
