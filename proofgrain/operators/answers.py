"""Evidence bundles and answers per requirement."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from proofgrain.functions import rules

FALLBACK_TEXT = {
    "fill_not_verified": rules.NOT_VERIFIED, "leave_blank": "", "use_default": "", "use_best_effort": rules.NOT_VERIFIED,
}


def bundle(requirements: DataFrame, hits: DataFrame) -> DataFrame:
    """One row per requirement: items, gap, contradiction and the best item.

    ``hits`` are at most a handful per requirement (see rerank).  The best item has the
    highest confidence x authority, then the longest text; under a contradiction the
    highest authority.  More than three different contents, without regard to case and white
    space, contradict.
    """
    told = F.md5(F.trim(F.regexp_replace(F.lower("content"), r"\s+", " ")))
    item = F.struct("source_file", "doc", "chunk_id", "confidence", "authority", "content")
    weight = F.round(F.col("confidence") * F.col("authority"), 9)
    per = hits.groupBy("req_id").agg(
        F.count("*").alias("items"),
        F.count_distinct(told).alias("snippets"),
        F.max_by(item, F.struct(weight, F.length("content"), -F.col("rank"))).alias("by_weight"),
        F.max_by(item, F.struct("authority", -F.col("rank"))).alias("by_authority"),
    )
    joined = requirements.join(per, "req_id", "left")
    clash = F.coalesce(F.col("snippets"), F.lit(0)) > 3
    return joined.select(
        *requirements.columns,
        F.coalesce("items", F.lit(0)).cast("bigint").alias("items"),
        F.when(F.col("items").isNull(), F.concat(
            F.lit("No evidence found for '"), "field_label", F.lit("' ("), "search_directive", F.lit(")"))).alias("gap"),
        clash.alias("contradiction"),
        F.when(clash, F.col("by_authority")).otherwise(F.col("by_weight")).alias("best"),
    )


def snippet(text: Column, kind: Column) -> Column:
    """The number, date or first sentence of a text, by field type; else the text."""
    t = F.trim(text)
    number = r"[-+]?\d*\.?\d+(?:\s*%)?"
    date = r"\b\d{1,2}[/-]\d{1,2}[/-]\d{2,4}\b|\b\d{4}-\d{2}-\d{2}\b"
    sentence = F.regexp_extract(t, r"(?s)^(.*?[.!?])(?:\s.*)?$", 1)
    return (
        F.when(kind == "number", F.when(t.rlike(number), F.regexp_extract(t, number, 0))
               .otherwise(F.split(t, r"\.")[0]))
        .when(kind == "date", F.when(t.rlike(date), F.regexp_extract(t, date, 0)).otherwise(t))
        .otherwise(F.when(sentence != "", sentence).otherwise(t))
    )


def answers(bundles: DataFrame) -> DataFrame:
    """(bundle columns, text, shown, confidence, status, fallback, cited): one answer each.

    ``text`` is the whole answer; ``shown`` holds at most 80 characters of a number or date
    and 500 of any other text.
    """
    kind = F.col("field_type")
    default = F.lit(rules.NOT_VERIFIED)
    for name, text in FALLBACK_TEXT.items():
        default = F.when(F.col("fallback_behavior") == name, text).otherwise(default)
    fallback_text = F.when((kind == "number") & F.col("required"), rules.NUMERIC_NOT_VERIFIED).otherwise(default)
    no_items = F.col("items") == 0
    fallback = no_items | ~F.col("can_auto_fill")
    found = snippet(F.col("best.content"), kind)
    seen = F.substring(found, F.lit(1), F.when(kind.isin("number", "date"), 80).otherwise(500))

    def told(value: Column) -> Column:
        return F.when(kind == "narrative", F.concat(
            F.lit("Based on source documentation ("), F.col("best.source_file"), F.lit("), "), F.col("field_label"), F.lit(": "), value)).otherwise(value)

    confidence = F.least(F.lit(0.99), F.col("best.confidence") * F.col("best.authority"))
    justification = (
        F.when(no_items, F.concat(F.lit("Missing evidence: "), F.col("gap")))
        .when(fallback, F.concat(
            F.lit("Low mapping confidence ("), F.format_string("%.2f", "mapping_confidence"),
            F.lit("); fallbackBehavior="), F.col("fallback_behavior")))
        .otherwise(F.concat(F.lit("Synthesized from "), F.col("items").cast("string"),
                            F.lit(" evidence item(s). Semantic match for: "), F.col("field_label")))
    )
    status = (
        F.when(fallback & F.lower(justification).contains("conflict"), "completed_with_conflict_resolution")
        .when(fallback & F.lower(justification).contains("failure"), "failed_with_fallback")
        .when(fallback, "completed_with_missing_evidence")
        .when(F.col("contradiction"), "completed_with_conflict_resolution")
        .when(confidence < 0.55, "completed_with_low_confidence").otherwise("completed")
    )
    return bundles.select(
        *[c for c in bundles.columns if c != "best"],
        F.when(fallback, fallback_text).otherwise(told(found)).alias("text"),
        F.when(fallback, fallback_text).otherwise(told(seen)).alias("shown"),
        F.when(fallback, 0.0).otherwise(confidence).alias("confidence"),
        status.alias("status"), fallback.alias("fallback"),
        F.when(~fallback, F.col("best.source_file")).alias("cited"),
        justification.alias("justification"),
    )


def _not_verified() -> Column:
    return F.when(F.col("field_type") == "number", rules.NUMERIC_NOT_VERIFIED).otherwise(rules.NOT_VERIFIED)


def validate_answers(drafts: DataFrame) -> DataFrame:
    """Final answers: every draft ends in a text, a status and a fallback flag.

    The checks run in order, each on the result of the one before.  ``valid_place`` (may be
    null) says whether the write coordinate exists.  ``text`` stays whole, ``shown`` is cut
    after 2,000 characters.
    """
    out = drafts.withColumn("text", F.trim(F.coalesce("text", F.lit("")))).withColumn(
        "_place_bad", ~F.coalesce(F.col("valid_place"), F.lit(True)))

    def stage(df: DataFrame, cond: Column, **changes: Column) -> DataFrame:
        df = df.withColumn("_hit", cond)
        for name, value in changes.items():
            df = df.withColumn(name, F.when(F.col("_hit"), value).otherwise(F.col(name)))
        return df

    yes, zero = F.lit(True), F.lit(0.0)
    missing, failed = F.lit("completed_with_missing_evidence"), F.lit("failed_with_fallback")
    out = stage(out, F.col("_place_bad"), text=F.lit(rules.NOT_VERIFIED), fallback=yes, status=failed,
                justification=F.concat("justification", F.lit("; invalid write coordinate")))
    out = stage(out, ~F.col("can_auto_fill"),
                text=F.when(F.col("fallback_behavior") == "leave_blank", "").otherwise(_not_verified()),
                fallback=yes, status=failed, confidence=zero)
    no_items = F.col("items") == 0
    out = stage(out, no_items, text=_not_verified(), fallback=yes, status=missing, confidence=zero,
                justification=F.concat(F.lit("Missing evidence: "), F.col("gap")))
    out = stage(out, ~no_items & F.col("contradiction") & F.col("cited").isNotNull(),
                status=F.lit("completed_with_conflict_resolution"),
                justification=F.concat("justification", F.lit("; resolved conflict: Multiple distinct evidence snippets; authority resolution may apply")))
    number_ok = F.replace("text", F.lit(","), F.lit("")).rlike(r"^[-+]?\d*\.?\d+")
    out = stage(out, (F.col("field_type") == "number") & (F.col("text") != "") & ~F.col("fallback") & ~number_ok,
                text=F.lit(rules.NUMERIC_NOT_VERIFIED), fallback=yes, status=missing)
    date_ok = F.col("text").rlike(r"^\d{4}-\d{2}-\d{2}$|^\d{1,2}[/-]\d{1,2}[/-]\d{2,4}$")
    head = F.substring("text", 1, 10)
    parsed = F.try_to_timestamp(head, F.lit("M/d/yyyy")).isNotNull() | F.try_to_timestamp(head, F.lit("d/M/yyyy")).isNotNull()
    out = stage(out, (F.col("field_type") == "date") & (F.col("text") != "") & ~F.col("fallback") & ~date_ok & ~parsed,
                text=F.lit(rules.NOT_VERIFIED), fallback=yes)
    out = stage(out, F.col("required") & (F.col("text") == "") & (F.col("fallback_behavior") != "leave_blank"),
                text=_not_verified(), fallback=yes, status=missing)
    sure = F.col("cited").isNotNull() & (F.col("confidence") >= rules.HIGH_CONFIDENCE) & ~F.col("fallback")
    out = stage(out, sure, status=F.lit("completed"))
    out = stage(out, ~sure & (F.col("confidence") >= rules.MEDIUM_CONFIDENCE) & ~F.col("fallback"),
                status=F.lit("completed_with_low_confidence"))
    out = stage(out, F.upper("text").contains(rules.REVIEW_MARKER), text=F.lit(rules.NOT_VERIFIED), fallback=yes, status=failed)
    long = F.length("text") > 2000
    out = out.withColumn("shown", F.when(long, F.concat(F.substring("text", 1, 1997), F.lit("..."))).otherwise(F.col("text")))
    return out.drop("_hit", "_place_bad")


def validate_answers_strict(drafts: DataFrame, threshold: float = 0.7) -> DataFrame:
    """The second gate: one threshold, four fallback behaviours.

    Returns (req_id, resolved, action, valid, low_confidence, missing_required)."""
    low = ~F.col("can_auto_fill") | (F.col("confidence") < threshold)
    empty = F.col("required") & (F.trim(F.coalesce("text", F.lit(""))) == "")
    fall = low | empty
    unit = F.col("expected_unit")
    best_effort = F.when(F.trim(F.coalesce("text", F.lit(""))) != "", F.trim("text")).otherwise(rules.NOT_VERIFIED)
    behaviour = F.col("fallback_behavior")
    resolved = (
        F.when(~fall, F.col("text")).when(behaviour == "leave_blank", "")
        .when(behaviour == "use_default", F.when(unit.isNotNull(), F.concat(F.lit("0 "), unit)).otherwise("N/A"))
        .when(behaviour == "fill_not_verified", rules.NOT_VERIFIED).otherwise(best_effort)
    )
    marked = resolved.contains(rules.REVIEW_MARKER)
    action = (
        F.when(marked, "modified_by_fallback").when(~fall, "accepted")
        .when(behaviour == "leave_blank", "blanked").otherwise("modified_by_fallback")
    )
    return drafts.select(
        "req_id", F.when(marked, rules.NOT_VERIFIED).otherwise(resolved).alias("resolved"), action.alias("action"),
        (~fall & ~marked).alias("valid"), low.alias("low_confidence"), empty.alias("missing_required"))
