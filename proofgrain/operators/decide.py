"""Decisions, policies and their aggregates, keyed by (packet_id, form_id, field_id)."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from proofgrain.functions import rules
from proofgrain.functions import text as tx

FIELD = ["packet_id", "form_id", "field_id"]
FORM = ["packet_id", "form_id"]


# ------------------------------------------------------------------ review mode
def decide(required: DataFrame, cands: DataFrame, threshold: float = 0.70) -> DataFrame:
    """One decision per required or suggested field.

    The best candidate (confidence, score, length, value) is kept even when values clash
    or confidence is low, with the reason; a missing required field gets a visible marker.
    ``needs_review`` flags every decision a person should see.
    """
    trimmed = cands.withColumn("value", F.trim(F.coalesce("value", F.lit(""))))
    rank = F.struct("confidence", "score", F.length("value"), "value")
    per_value = trimmed.groupBy(*FIELD, "value").agg(F.max(rank).alias("rank"))
    best = per_value.groupBy(*FIELD).agg(F.max("rank").alias("rank"), F.count_if(F.col("value") != "").alias("n_values"))
    joined = required.select(*FIELD).distinct().withColumn("required", F.lit(True)).join(best, FIELD, "full_outer")
    need = F.coalesce("required", F.lit(False))
    none, empty = F.col("rank").isNull(), (F.col("n_values") == 0) | (F.col("rank.value") == "")
    clash, low = F.col("n_values") > 1, F.col("rank.confidence") < threshold

    def marker(text: str) -> Column:
        return F.concat(F.lit(f"{rules.REVIEW_MARKER}: "), F.col("field_id"), F.lit(f" {text}"))

    state = F.when((none | empty) & ~need, "BLANK").otherwise("FILL")
    value = (
        F.when(none & need, marker("missing retrieved evidence candidate"))
        .when(empty & need, marker("candidate had no extracted value")).when(~none & ~empty, F.col("rank.value"))
    )
    confidence = (
        F.when((none | empty) & need, 1.0).when(none | empty, None)
        .when(clash | low, F.greatest(F.col("rank.confidence"), F.lit(threshold))).otherwise(F.col("rank.confidence"))
    )
    reason = (
        F.when(none, F.when(need, "missing required evidence; visible marker inserted for human completion").otherwise("no retrieved evidence candidate"))
        .when(empty, F.when(need, "missing required extracted value; visible marker inserted for human completion").otherwise("candidate had no extracted value"))
        .when(clash, "auto-filled best candidate; conflicting extracted values require reviewer verification")
        .when(low, f"auto-filled low-confidence candidate below threshold {threshold:.2f}; reviewer verification required")
        .otherwise("selected highest-confidence local evidence")
    )
    out = joined.select(
        *FIELD, need.alias("required"), state.alias("state"), value.alias("value"), confidence.alias("confidence"),
        reason.alias("reason"), F.coalesce("n_values", F.lit(0)).cast("bigint").alias("n_values"))
    seen = F.coalesce("value", F.lit("")).startswith(rules.REVIEW_MARKER) | F.lower("reason").rlike("review|conflict|missing")
    return out.withColumn("needs_review", seen)


def decide_cell(value: Column, confidence: Column, threshold: float, required: Column, conflict: Column, role: Column) -> Column:
    """The decision of one mapped cell."""
    missing = F.trim(F.coalesce(value, F.lit(""))) == ""
    return (
        F.when(missing & required, "MISSING").when(missing, "BLANK").when(conflict, "CONFLICT")
        .when(confidence < threshold, "LOW_CONFIDENCE").when(role == "notes", "REVIEW_REQUIRED").otherwise("FILL")
    )


def summarize(decisions: DataFrame, states: Sequence[str]) -> DataFrame:
    """Per form: decisions, one count per state, fields to fill, fields for review."""
    return decisions.groupBy(*FORM).agg(
        F.count("*").alias("fields"),
        *[F.count_if(F.col("state") == s).alias(s.lower()) for s in states],
        F.count_if("needs_review").alias("human_review"))


def review_lists(decisions: DataFrame) -> DataFrame:
    """(packet, form, list, field_id): the entries of each review list, one per row."""
    entry = F.array_compact(F.array(
        F.when(F.col("state") == "FILL", F.lit("fill_eligible")),
        F.when(F.col("needs_review"), F.lit("human_review")),
        F.when(F.lower("reason").contains("missing"), F.lit("missing")),
        F.when(F.col("n_values") > 1, F.lit("conflict")),
        F.when(F.col("reason").contains("below threshold"), F.lit("low_confidence"))))
    return decisions.select(*FIELD, F.explode(entry).alias("list"))


# ------------------------------------------------------------------ confidence
def confidence_axes(value: Column, retrieval: Column, authorised: Column, na_approved: Column) -> Column:
    """Five axes: retrieval, extraction, authorization, write, completion."""
    has = F.coalesce(value, F.lit("")) != ""
    r = F.coalesce(retrieval, F.lit(0.0))
    extraction = F.when(has, r * F.lit(0.95)).otherwise(0.0)
    authorization = F.when(authorised, 1.0).otherwise(0.0)
    base = F.when(has & authorised, F.least(extraction, authorization)).otherwise(0.0)
    write = F.when(na_approved & (base == 0.0), 0.99).otherwise(base)
    completion = F.when(has & (write > 0), F.least(write, F.lit(0.95))).when(na_approved, 0.99).otherwise(0.0)
    return F.struct(
        F.bround(r, 4).alias("retrieval"), F.bround(extraction, 4).alias("extraction"),
        authorization.alias("authorization"), F.bround(write, 4).alias("write"), F.bround(completion, 4).alias("completion"))


# ------------------------------------------------------------------ eight states
def decide_matrix(fields: DataFrame, ledger: DataFrame, packets: DataFrame, na: DataFrame | None = None, judgements: DataFrame | None = None, markers: bool = True) -> DataFrame:
    """Every field of every packet in exactly one of eight states; the first rule that fits
    wins.

    ``fields``: form_id, field_id, required, never_write, authorised; ``na``: approved
    exceptions (packet_id, form_id, field_id); ``judgements``: (packet_id, field_id,
    judgement, judged) may turn a conflict or weak value into a fill, never without
    authority.
    """
    every = packets.select(*FORM).join(fields.select("form_id", "field_id", "label", "required", "never_write", "authorised"), "form_id")
    j = every.join(ledger.select(*FIELD, "value", "decision", "confidence", "source_file", "page", "chunk_id", "alias_used", "n_alternates"), FIELD, "left")
    if na is not None:
        j = j.join(na.select(*FIELD).withColumn("na_approved", F.lit(True)), FIELD, "left")
    else:
        j = j.withColumn("na_approved", F.lit(False))
    if judgements is not None:
        j = j.join(judgements.select("packet_id", "field_id", "judgement", "judged"), ["packet_id", "field_id"], "left")
    else:
        j = j.withColumn("judgement", F.lit(None).cast("string")).withColumn("judged", F.lit(None).cast("double"))
    j = j.withColumn("na_approved", F.coalesce("na_approved", F.lit(False))).withColumn(
        "plausible", tx.plausible(F.col("field_id"), F.col("value")))
    has = F.coalesce("value", F.lit("")) != ""
    what = F.coalesce("decision", F.lit("missing"))
    conflict, weak, foreign = what == "conflict", what == "weak", what == "out_of_scope"
    auth, req, ok = F.col("authorised"), F.col("required"), F.col("plausible")
    supports = F.coalesce(F.col("judgement") == "supports_field", F.lit(False))
    write = F.bround(F.col("confidence") * F.lit(0.95), 4)
    low = (write > 0) & (write < 0.6)
    several = F.coalesce(F.col("n_alternates") > 0, F.lit(False))
    unsure = F.coalesce(F.col("confidence") < 0.75, F.lit(False)) | several
    won = supports & (F.col("judged") >= F.when(conflict, 0.8).otherwise(0.75))
    shown = F.coalesce("value", F.lit("<none>"))

    steps = [
        (F.col("never_write"), "OPTIONAL_BLANK", F.lit("Never-write field; left untouched.")),
        (conflict & auth & ~req, "OPTIONAL_BLANK", F.lit("Optional field; conflicting candidates found, so left blank.")),
        (conflict & auth & won & ~ok, "LOW_CONFIDENCE", F.lit("Judgement resolved the conflict but the value failed the sanity gate.")),
        (conflict & auth & won, "FILL", F.lit("Conflict resolved by judgement.")),
        (conflict & auth, "CONFLICT", F.concat(F.lit("Multiple distinct values in evidence: primary='"), shown, F.lit("'; alternates="), F.col("n_alternates").cast("string"))),
        (has & auth & ~weak & ~ok & ~req, "OPTIONAL_BLANK", F.lit("Optional field; implausible candidate found, so left blank.")),
        (has & auth & ~weak & ~ok, "LOW_CONFIDENCE", F.concat(F.lit("Value failed sanity gate: '"), F.substring("value", 1, 40), F.lit("...' is not a plausible value for "), "field_id", F.lit("."))),
        (has & auth & ~weak & low & several & won, "FILL", F.lit("Low confidence promoted by judgement.")),
        (has & auth & ~weak & low, "LOW_CONFIDENCE", F.concat(F.lit("Evidence value '"), shown, F.lit("' present but write-confidence too low ("), write.cast("string"), F.lit(")."))),
        (has & auth & ~weak, "FILL", F.concat(F.lit("Authorized fill from "), "source_file", F.lit(" (chunk "), "chunk_id", F.lit(")."))),
        (has & ~auth, "BLOCKED_UNAUTHORIZED", F.lit("Evidence found but no exact approval-map authorization for this cell.")),
        (weak & ~req, "OPTIONAL_BLANK", F.lit("Optional field; weak candidate found, so left blank.")),
        (weak & unsure & won & ~ok, "LOW_CONFIDENCE", F.lit("Judgement supports the value but it failed the sanity gate.")),
        (weak & unsure & won, "FILL", F.lit("Weak evidence promoted by judgement.")),
        (weak, "LOW_CONFIDENCE", F.lit("Targeted-search hint found but no extracted value.")),
        (foreign & ~req, "OPTIONAL_BLANK", F.lit("Optional field; only out-of-scope candidates found, so left blank.")),
        (foreign, "BLOCKED_NO_SOURCE", F.lit("Only out-of-scope candidates found (cross-form contamination).")),
        (req & F.col("na_approved"), "APPROVED_NA", F.lit("No evidence found; approved N/A exception applied.")),
        (req & F.lit(markers), "REVIEW_REQUIRED", F.lit("Required field with no evidence and no approved N/A; manual review marker emitted.")),
        (req, "BLOCKED_NO_SOURCE", F.lit("Required field with no evidence; review markers disabled by policy.")),
    ]
    verdict = F.struct(F.lit("OPTIONAL_BLANK").alias("state"), F.lit("Optional field; left blank.").alias("reason"))
    for cond, state, reason in reversed(steps):
        verdict = F.when(cond, F.struct(F.lit(state).alias("state"), reason.alias("reason"))).otherwise(verdict)
    d = j.withColumn("v", verdict)
    state = F.col("v.state")
    blocked = F.col("never_write") | state.isin("BLOCKED_UNAUTHORIZED", "REVIEW_REQUIRED") | (
        (state == "BLOCKED_NO_SOURCE") & ~foreign)
    authority = (
        F.when(state == "APPROVED_NA", "approved_na_insertion").when(blocked | ~auth, "unauthorized").otherwise("exact_approval_map"))
    d = d.withColumn("axes", confidence_axes(F.col("value"), F.col("confidence"), authority == "exact_approval_map", F.col("na_approved")))
    return d.select(
        *FIELD, "label", "required", "never_write", state.alias("state"),
        F.when(state.isin("FILL", "LOW_CONFIDENCE"), F.col("value")).alias("value"),
        F.col("v.reason").alias("reason"), authority.alias("write_authority"),
        "axes.retrieval", "axes.extraction", "axes.authorization", "axes.write", "axes.completion",
        "source_file", "page", "chunk_id", "alias_used", F.coalesce("n_alternates", F.lit(0)).cast("bigint").alias("n_alternates"))


# ------------------------------------------------------------------ policies
def na_approvals(fields: DataFrame, ledger: DataFrame, policy: DataFrame, packets: DataFrame) -> DataFrame:
    """(packet, form, field, policy_id): required fields without a value whose exception a
    policy approves."""
    open_fields = fields.where("required and na_allowed").join(policy, ["form_id", "field_id"]).select("form_id", "field_id", "policy_id")
    held = ledger.where("value is not null and value <> ''").select(*FIELD)
    return packets.select(*FORM).join(open_fields, "form_id").join(held, FIELD, "left_anti").select(*FIELD, "policy_id")


def promote_required(fields: DataFrame, policy: Sequence[dict]) -> DataFrame:
    """Adds ``promoted``: a policy rule of the form requires the field and no optional
    pattern of that rule vetoes it.

    Rules are {forms, form_prefixes, optional, required, required_ids} with glob patterns
    for field id or label; numbered clones (..._2) are never promoted.  The globs become
    one expression over the fields.
    """
    form, field = F.lower("form_id"), F.lower("field_id")
    label = F.regexp_replace(F.trim(F.regexp_replace(F.lower("label"), "[/-]", " ")), r"\s+", "_")

    def any_of(patterns: Sequence[str]) -> Column:
        out = F.lit(False)
        for p in patterns:
            regex = "^" + "".join({"*": ".*", "?": "."}.get(c, re.escape(c)) for c in p.lower()) + "$"
            out = out | field.rlike(regex) | label.rlike(regex)
        return out

    promoted = F.lit(False)
    for rule in policy:
        here = form.isin(*[f.lower() for f in rule.get("forms", [])] or ["\0"])
        for prefix in rule.get("form_prefixes", []):
            here = here | form.startswith(prefix.lower())
        wanted = (any_of(rule.get("required", [])) | F.col("field_id").isin(*rule.get("required_ids", []) or ["\0"]))
        promoted = promoted | (here & ~any_of(rule.get("optional", [])) & ~field.rlike(r"_\d+$") & wanted)
    return fields.withColumn("promoted", promoted)


def obligations(field_map: DataFrame, policy: DataFrame, na_eligible: Sequence[str] = (), required_policy: Sequence[dict] = ()) -> DataFrame:
    """Map rows with their duties: required, N/A allowed, blocker, never-write, search terms."""
    promoted = promote_required(field_map, required_policy)
    allowed = policy.select("form_id", "field_id").distinct().withColumn("_na", F.lit(True))
    j = promoted.join(allowed, ["form_id", "field_id"], "left")
    required = F.col("required") | F.col("promoted")
    na = F.coalesce("_na", F.lit(False)) | F.col("field_id").isin(*na_eligible or ["\0"])
    return j.select(
        "form_id", "field_id", "label", "tbl", "row", "col",
        required.alias("required"), (~required).alias("optional"), na.alias("na_allowed"), required.alias("evidence_required"),
        (required & ~na).alias("completion_blocker"), "never_write",
        F.array_join(F.array_distinct(F.array("label", F.lower("label"))), "|").alias("search_terms"))


def classify(obligation: DataFrame) -> DataFrame:
    return obligation.groupBy("form_id").agg(
        F.count_if(~F.col("never_write") & F.col("required")).alias("required_total"),
        F.count_if(~F.col("never_write") & ~F.col("required")).alias("optional_total"),
        F.count_if("never_write").alias("never_write_total"))


# ------------------------------------------------------------------ publishing
def publish(decisions: DataFrame, fields: DataFrame) -> DataFrame:
    """What goes where: writes, N/A inserts, markers, and what stays blocked."""
    state = F.col("state")
    kind = (
        F.when((state == "FILL") & F.col("value").isNotNull(), "write").when(state == "APPROVED_NA", "na_insert")
        .when(state == "REVIEW_REQUIRED", "marker").when(state == "OPTIONAL_BLANK", "skip").otherwise("blocked"))
    text = F.when(kind == "write", F.col("value")).when(kind == "na_insert", "N/A").when(kind == "marker", rules.CELL_MARKER)
    authorised = (
        F.when(kind == "write", F.col("write_authority") == "exact_approval_map")
        .when(kind == "na_insert", F.col("write_authority") == "approved_na_insertion").when(kind == "marker", True))
    places = fields.select("form_id", "field_id", "tbl", "row", "col")
    return decisions.join(places, ["form_id", "field_id"]).select(
        *FIELD, "tbl", "row", "col", kind.alias("kind"), text.alias("text"), authorised.alias("authorised"),
        (kind.isin("blocked", "marker")).alias("blocked"))


def value_for_write(df: DataFrame, threshold: float = 0.70) -> DataFrame:
    """Adds ``written``: the text a review-mode cell gets (null: the cell is left alone)."""
    value, role, need = F.col("value"), F.col("role"), F.col("required")
    empty = F.trim(F.coalesce(value, F.lit(""))) == ""

    def review(text: Column) -> Column:
        return F.concat(F.lit(f"{rules.REVIEW_MARKER}: "), F.col("field_id"), F.lit(" "), text)

    low = F.col("confidence") < threshold
    return df.withColumn("written",
        F.when((role == "notes") & ~empty, value)
        .when(role == "notes", F.when(need, review(F.lit("missing required notes"))))
        .when(value.isNull(), F.when(need, review(F.lit("missing required value"))))
        .when(value.startswith(rules.REVIEW_MARKER), value)
        .when(empty, F.when(need, review(F.lit("missing required value"))).otherwise(""))
        .when(low, review(F.concat(F.lit("low confidence "), F.format_string("%.2f", "confidence"))))
        .otherwise(value))


def fill_from_labels(decided: DataFrame, offers: DataFrame) -> DataFrame:
    """Empty or marked fields take the value their label found (confidence at least .99).

    ``decided``: (packet, form, field, value, confidence); ``offers``: (packet, form, field,
    offer).  Offers for fields that are not decided become new rows.
    """
    j = decided.join(offers.select(*FIELD, "offer"), FIELD, "full_outer")
    current = F.coalesce("value", F.lit(""))
    takes = F.col("offer").isNotNull() & ((current == "") | current.contains(rules.REVIEW_MARKER))
    return j.select(
        *FIELD, F.when(takes, F.col("offer")).otherwise(F.col("value")).alias("value"),
        F.when(takes, F.greatest(F.coalesce("confidence", F.lit(0.0)), F.lit(0.99))).otherwise(F.col("confidence")).alias("confidence"),
        takes.alias("from_label"))


def mark_missing(filled: DataFrame, required: DataFrame) -> DataFrame:
    """Required fields still empty get a visible marker."""
    j = filled.join(required.select(*FIELD).withColumn("required", F.lit(True)), FIELD, "full_outer")
    empty = F.coalesce("required", F.lit(False)) & (F.trim(F.coalesce("value", F.lit(""))) == "")
    mark = F.concat(F.lit(f"{rules.REVIEW_MARKER}: "), F.col("field_id"), F.lit(" missing evidence candidate; needs manual completion"))
    return j.select(
        *FIELD, F.when(empty, mark).otherwise(F.col("value")).alias("value"),
        F.when(empty, 1.0).otherwise(F.col("confidence")).alias("confidence"),
        F.coalesce("from_label", F.lit(False)).alias("from_label"), empty.alias("marked"))


def unsafe_reason(label_key: Column, field: Column, value: Column) -> Column:
    """'' or why a mapped value must not be written."""
    low = F.lower(value)
    return (
        F.when(low.rlike(r"\b(?:specimen|sample)\b") & field.rlike(r"(?i)mark|number"), "rejected junk identity text; needs manual completion")
        .when(~tx.label_accepts(label_key, value), "rejected incompatible value; needs manual completion").otherwise(""))


# ------------------------------------------------------------------ completeness
def completeness(cells: DataFrame, fields: DataFrame, packets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(required cells with their status, totals per form)."""
    need = fields.where("required and not never_write").select("form_id", "field_id", "tbl", "row", "col")
    j = packets.select(*FORM).join(need, "form_id").join(cells.select(*FORM, "tbl", "row", "col", "text"), [*FORM, "tbl", "row", "col"], "left")
    text = F.trim(F.coalesce("text", F.lit("")))
    status = F.when(text == "", "blank").when(text.contains(rules.REVIEW_MARKER), "manual_marker").otherwise("filled")
    rows = j.select(*FIELD, status.alias("status"))
    totals = rows.groupBy(*FORM).agg(
        F.count_if(F.col("status") == "filled").alias("filled"), F.count_if(F.col("status") == "manual_marker").alias("markers"),
        F.count_if(F.col("status") == "blank").alias("blank"), (F.count_if(F.col("status") == "blank") == 0).alias("complete"))
    return rows, totals


def _visible(decisions: DataFrame, fields: DataFrame, cells: DataFrame) -> DataFrame:
    placed = decisions.join(fields.select("form_id", "field_id", "tbl", "row", "col"), ["form_id", "field_id"])
    return placed.join(cells.select(*FORM, "tbl", "row", "col", "text"), [*FORM, "tbl", "row", "col"], "left").withColumn("text", F.coalesce("text", F.lit("")))


def blockers(decisions: DataFrame, fields: DataFrame, cells: DataFrame) -> DataFrame:
    """(packet, form, field, blocker): why a form is not complete."""
    v = _visible(decisions, fields, cells)
    state = F.col("state")
    hidden = (state == "FILL") & F.col("required") & ((F.col("text") == "") | F.col("text").contains(rules.CELL_MARKER))
    hard = state.isin("BLOCKED_NO_SOURCE", "BLOCKED_UNAUTHORIZED")
    soft = state.isin("REVIEW_REQUIRED", "CONFLICT", "LOW_CONFIDENCE") & F.col("required")
    return v.where(hidden | hard | soft).select(*FIELD, F.concat(
        "field_id", F.when(hidden, ": writer claimed FILL but cell visible text is empty/marker").otherwise(F.concat(F.lit(": "), state))).alias("blocker"))


def judge(decisions: DataFrame, fields: DataFrame, cells: DataFrame, guard: DataFrame) -> DataFrame:
    """Completion report per form.  ``guard``: (packet_id, form_id, guard_passed)."""
    v = _visible(decisions, fields, cells)
    state, req = F.col("state"), F.col("required")
    seen = (F.col("text") != "") & ~F.col("text").contains(rules.CELL_MARKER)
    filled = req & (((state == "FILL") & seen) | (state == "APPROVED_NA"))
    stuck = state.isin("BLOCKED_NO_SOURCE", "BLOCKED_UNAUTHORIZED") | (
        req & (state.isin("REVIEW_REQUIRED", "CONFLICT", "LOW_CONFIDENCE") | ((state == "FILL") & ~seen)))

    def n(name: str) -> Column:
        return F.count_if(state == name)

    per = v.groupBy(*FORM).agg(
        F.count_if(req & ~F.col("never_write")).alias("required_total"), F.count_if(filled).alias("required_filled"),
        F.count_if(stuck).alias("required_blocked"), n("REVIEW_REQUIRED").alias("review_required"), n("CONFLICT").alias("conflicts"),
        n("LOW_CONFIDENCE").alias("low_confidence"), n("APPROVED_NA").alias("approved_na"),
        n("BLOCKED_NO_SOURCE").alias("blocked_no_source"), n("BLOCKED_UNAUTHORIZED").alias("blocked_unauthorized"))
    open_states = ("blocked_no_source", "blocked_unauthorized", "review_required", "conflicts", "low_confidence")
    done = F.col("required_total") == F.col("required_filled")
    for name in open_states:
        done = done & (F.col(name) == 0)
    fmt = F.coalesce("guard_passed", F.lit(False))
    status = (
        F.when(done & fmt, "success").when(~fmt, "failed_structure_guard")
        .when(F.col("blocked_unauthorized") > 0, "failed_unauthorized_write").when(F.col("conflicts") > 0, "failed_conflict_resolution")
        .when(F.col("low_confidence") > 0, "failed_low_confidence_resolution")
        .when(F.col("blocked_no_source") > 0, "blocked_pending_no_source_or_na_resolution")
        .when(F.col("review_required") > 0, "blocked_pending_review_required").otherwise("failed_completion"))
    return per.join(guard, FORM, "left").select(
        *per.columns, fmt.alias("passed_format"), done.alias("passed_completion"), (done & fmt).alias("passed"), status.alias("final_status"))


def readback(decisions: DataFrame, fields: DataFrame, cells: DataFrame) -> DataFrame:
    """Findings where the visible cell does not show what was decided."""
    v = _visible(decisions, fields, cells)
    state, text = F.col("state"), F.col("text")
    has = (state == "FILL") & (F.coalesce("value", F.lit("")) != "")
    issue = (
        F.when(has & ~F.contains(text, F.col("value")), "value_invisible").when(has & text.contains(rules.CELL_MARKER), "marker_overlap")
        .when((state == "APPROVED_NA") & ~text.contains("N/A"), "approved_na_not_visible")
        .when((state == "REVIEW_REQUIRED") & ~text.contains(rules.CELL_MARKER), "review_marker_missing"))
    return v.withColumn("issue", issue).where("issue is not null").select(
        *FIELD, "issue", F.when(F.col("issue") == "value_invisible", F.col("value")).alias("expected"), F.col("text").alias("visible"))


def run_status(fields: DataFrame, forms: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(status per form, status per run): the worst status wins.

    ``fields``: (run_id, form_id, status, fallback); ``forms``: (run_id, form_id,
    guard_passed, error).
    """
    def worst(col: Column, bad: str = "failed_with_fallback") -> Column:
        return F.when(F.bool_or(col == bad), bad).when(F.bool_or(col != "completed"), "completed_with_warnings").otherwise("completed")

    per_form = fields.groupBy("run_id", "form_id").agg(
        worst(F.col("status")).alias("status"), F.count("*").alias("fields"), F.count_if("fallback").alias("fallbacks"),
        F.count_if(F.col("status") == "completed_with_low_confidence").alias("low_confidence"))
    joined = forms.join(per_form, ["run_id", "form_id"], "left")
    per_run = joined.groupBy("run_id").agg(
        worst(F.coalesce("status", F.lit("failed_with_fallback"))).alias("status"), F.count("*").alias("forms"),
        F.coalesce(F.sum("fields"), F.lit(0)).cast("bigint").alias("fields"), F.coalesce(F.sum("fallbacks"), F.lit(0)).cast("bigint").alias("fallbacks"),
        F.coalesce(F.sum("low_confidence"), F.lit(0)).cast("bigint").alias("low_confidence"),
        F.bool_and("guard_passed").alias("structure_guard_passed"), F.count("error").alias("errors"))
    success = (F.col("status") == "completed") & (F.col("errors") == 0)
    return per_form, per_run.withColumn("overall_passed", success)
