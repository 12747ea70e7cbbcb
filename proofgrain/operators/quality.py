"""The data-quality rule suite: every check is one findings query.

A finding is (error, check, location, detail).  ``run_all`` unions the checks; the release
gate counts findings per gate.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from proofgrain.functions import rules
from proofgrain.session import cut_lineage

FINDING = ["error", "check", "location", "detail"]


def _finding(cond: Column, error: str, detail: Column | str) -> tuple[Column, str, Column]:
    return cond, error, F.lit(detail) if isinstance(detail, str) else detail


def _checks(df: DataFrame, location: Column, **found: Sequence[tuple[Column, str, Column]]) -> DataFrame:
    """All findings of all named checks of a row, in one pass over the rows."""
    rows = [
        F.when(cond, F.struct(F.lit(error).alias("error"), F.lit(check).alias("check"), location.cast("string").alias("location"), detail.alias("detail")))
        for check, several in found.items() for cond, error, detail in several]
    return df.select(F.inline(F.array_compact(F.array(*rows))))


def _findings(df: DataFrame, check: str, location: Column, *found: tuple[Column, str, Column]) -> DataFrame:
    return _checks(df, location, **{check: found})


def _quoted(col: Column) -> Column:
    return F.concat(F.lit("'"), F.coalesce(col, F.lit("None")), F.lit("'"))


# ------------------------------------------------------------------ identity
def glued(value: Column) -> Column:
    """Two values run together: a lower-case letter or dot before a capital."""
    return F.regexp_replace(value, rules.NAME_PARTICLES, "").rlike(rules.GLUED)


def merged_codes(value: Column, vocabulary: Sequence[str]) -> Column:
    """The valid codes a value splits into ('' unless it is two or more of them)."""
    up = F.upper(F.trim(value))
    parts = F.regexp_extract_all(up, F.lit("|".join(sorted(vocabulary, key=lambda v: (-len(v), v)))), F.lit(0))
    return F.when((F.size(parts) > 1) & (F.array_join(parts, "") == up), F.array_join(parts, " + ")).otherwise("")


def check_personnel(df: DataFrame) -> DataFrame:
    """One person per row: (table, row, name, level, method)."""
    out = [_finding(glued(F.col("name")), "E-013", "name cell holds two glued identities")]
    for col, what, words in (("level", "two levels merged", rules.QUALIFICATION_LEVELS), ("method", "two methods merged", rules.METHODS)):
        value = F.trim(F.coalesce(F.col(col), F.lit("")))
        split = merged_codes(value, words)
        out.append(_finding((value != "") & ~value.isin(*words), "E-013", F.concat(
            F.lit(f"{col} "), _quoted(value), F.when(split != "", F.concat(F.lit(f" is {what} ("), split, F.lit(")"))).otherwise(" is outside the controlled set"))))
    return _findings(df, "check_personnel_rows", F.concat_ws(" row ", "table", F.col("row").cast("string")), *out)


def check_equipment(df: DataFrame) -> DataFrame:
    """One instrument per row: (table, row, equipment_name, equipment_id, function)."""
    return _findings(df, "check_equipment_rows", F.concat_ws(" row ", "table", F.col("row").cast("string")), *[
        _finding(glued(F.col(c)), "E-013", f"{c} holds two glued records") for c in ("equipment_name", "equipment_id", "function")])


def check_record_types(df: DataFrame, expected: DataFrame) -> DataFrame:
    """Record types stay apart: (identifier, type); expected: (identifier, types)."""
    kind = F.upper(F.coalesce("type", F.lit("")))
    unknown = _findings(df, "check_record_type_separation", F.col("identifier"), _finding(
        ~kind.isin(*rules.RECORD_TYPES), "E-010", F.concat(F.lit("record type "), _quoted(F.col("type")), F.lit(" is not a distinct known type"))))
    per = df.groupBy("identifier").agg(F.min(kind).alias("a"), F.max(kind).alias("b")).where("a = b").join(expected, "identifier")
    return unknown.unionByName(_findings(per, "check_record_type_separation", F.col("identifier"), _finding(
        F.col("types") > 1, "E-010", "one identifier resolved to a single type where several were expected")))


def check_leaf_keys(df: DataFrame) -> DataFrame:
    """Leaf keys name a meaning, not a position: (printed_section, leaf_key)."""
    positional = F.filter(F.split("leaf_key", "[|/]"), lambda s: F.trim(s).rlike(rules.POSITIONAL_SEGMENT))
    rows = _findings(df, "check_leaf_identity", F.col("leaf_key"), _finding(
        F.size(positional) > 0, "E-011", F.concat(F.lit("leaf key carries position "), F.array_join(positional, ", "), F.lit(" as identity"))))
    per = df.groupBy("printed_section", "leaf_key").agg(F.count("*").alias("n")).groupBy("printed_section").agg(F.max("n").alias("n"))
    return rows.unionByName(_findings(per, "check_leaf_identity", F.col("printed_section"), _finding(
        F.col("n") > 1, "E-011", "repeated printed section resolves to fewer composite keys than leaves")))


def check_provenance(df: DataFrame) -> DataFrame:
    """Matches, comparisons, coordinates and mappings rest on the current run and on
    identity: (item, method, coordinate_source, keyed_by, map_source, validated,
    source_field, target_field)."""
    def words(ws: Sequence[str]) -> Column:
        return F.array(*[F.lit(w) for w in ws])

    keyed = F.transform("keyed_by", lambda k: F.lower(F.trim(k)))
    placed = F.array_sort(F.array_intersect(keyed, words(rules.POSITION_KEYS)))
    lacking = F.array_sort(F.array_except(words(rules.IDENTITY_KEYS), keyed))
    source = F.lower("coordinate_source")
    exact = _finding(F.lower("method") == "substring", "E-012", F.concat(F.lit("matched by "), "method"))
    prior = _finding(source == "prior_run", "E-014", "physical coordinate sourced from a prior run")
    mapping = [
        _finding(F.size(placed) > 0, "E-014", F.concat(F.lit("reusable mapping keyed by "), F.array_join(placed, ", "), F.lit(", which is position, not identity"))),
        _finding((F.size(placed) == 0) & (F.size(lacking) > 0), "E-014", F.concat(F.lit("identity is missing "), F.array_join(lacking, ", "))),
        _finding(source != "current_run", "E-014", F.concat(F.lit("coordinates carried in from "), _quoted(F.col("coordinate_source")))),
        _finding((F.lower("map_source") == "run_derived") & ~F.col("validated"), "E-002", "run-derived map used without validation against the current controlled form")]
    compared = _finding(
        (F.col("source_field") != "") & (F.col("target_field") != "") & (F.col("source_field") != F.col("target_field")), "E-015",
        F.concat(F.lit("compared "), _quoted(F.col("source_field")), F.lit(" against "), _quoted(F.col("target_field"))))
    return _checks(
        df, F.col("item"), check_exact_identity_matching=[exact], check_coordinate_provenance=[prior],
        check_field_mapping_authority=mapping, check_comparison_identity=[compared])


def normal_mode(col: Column) -> Column:
    return F.regexp_replace(F.upper(F.trim(F.coalesce(col, F.lit("")))), r"[\s\-/]+", "_")


def check_mode(runs: DataFrame, items: DataFrame) -> DataFrame:
    """Job mode and rework baseline.  ``runs``: (run_id, mode, started_from,
    rebuild_reason, accepted_baseline); ``items``: (run_id, item, was_correct,
    target_value)."""
    known = F.create_map(*[F.lit(x) for pair in rules.MODE_ALIASES.items() for x in pair])
    r = runs.withColumn("m", normal_mode(F.col("mode"))).withColumn("resolved", F.try_element_at(known, F.col("m")))
    mode = _findings(
        r, "check_mode_and_baseline", F.col("run_id"),
        _finding(F.col("m") == "", "E-019", "no job mode declared"),
        _finding((F.col("m") != "") & F.col("resolved").isNull(), "E-036", F.concat(F.lit("mode "), _quoted(F.col("mode")), F.lit(" is unrecognized and cannot be checked"))),
        _finding(F.col("resolved").isin(*rules.BLANK_START_MODES) & F.col("accepted_baseline"), "E-019", F.concat(_quoted(F.col("mode")), F.lit(" chosen while an accepted working form already exists"))))
    why = F.lower(F.trim(F.coalesce("rebuild_reason", F.lit(""))))
    rework = r.where("resolved = 'REWORK'")
    restarted = _findings(rework, "check_rework_baseline", F.col("run_id"), _finding(
        (F.lower("started_from") == "blank") & ~why.isin(*rules.REBUILD_EXCEPTIONS), "E-019",
        F.concat(F.lit("rework restarted from a clean blank with no qualifying exception (reason: "), F.coalesce("rebuild_reason", F.lit("none given")), F.lit(")"))))
    lost = items.join(rework.select("run_id"), "run_id", "left_semi")
    return mode.unionByName(restarted).unionByName(_findings(lost, "check_rework_baseline", F.col("item"), _finding(
        F.col("was_correct") & (F.trim(F.coalesce("target_value", F.lit(""))) == ""), "E-019", "correct existing values were lost during rework")))


# ------------------------------------------------------------------ completeness and evidence
def check_dispositions(df: DataFrame) -> DataFrame:
    """Every identity has an honest disposition: (key, disposition, target_value)."""
    state = F.upper(F.trim(F.coalesce("disposition", F.lit(""))))
    empty = F.trim(F.coalesce("target_value", F.lit(""))) == ""
    none = state.isin("", "UNACCOUNTED", "UNEVALUATED")
    return _findings(
        df, "check_two_way_completeness", F.col("key"),
        _finding(none, "E-016", "required identity has no disposition"),
        _finding(~none & ~state.isin(*rules.DISPOSITIONS), "E-016", F.concat(F.lit("disposition "), _quoted(state), F.lit(" is outside the known dispositions"))),
        _finding((state == "POPULATED_VERIFIED") & empty, "E-017", "claimed POPULATED_VERIFIED while the destination is blank"),
        _finding((state == "BLANK_UNSUPPORTED") & ~empty, "E-016", "claimed BLANK_UNSUPPORTED while the destination is populated"))


def check_conflicts(df: DataFrame) -> DataFrame:
    """Conflicts stay visible: (key, disposition, sources_disagree, low_confidence)."""
    state = F.upper(F.trim(F.coalesce("disposition", F.lit(""))))
    return _findings(
        df, "check_conflict_preservation", F.col("key"),
        _finding(F.col("sources_disagree") & (state != "WITHHELD_FLAGGED_DISCREPANCY"), "E-018", F.concat(F.lit("sources disagree but disposition is "), _quoted(state))),
        _finding(F.col("low_confidence") & (state == "POPULATED_VERIFIED"), "E-018", "low-confidence candidate promoted to POPULATED_VERIFIED"))


def check_admissible(df: DataFrame) -> DataFrame:
    """Accepted values have the shape of their type: (key, type, value, accepted,
    via_fallback, fallback_recorded)."""
    value, bad = F.trim(F.coalesce("value", F.lit(""))), F.lit(False)
    for kind, shape in rules.ADMISSIBLE_SHAPES.items():
        bad = bad | ((F.lower("type") == kind) & ~value.rlike(shape))
    return _findings(
        df.where("accepted"), "check_candidate_admissibility", F.col("key"),
        _finding(bad, "E-003", F.concat(F.lit("accepted "), _quoted(F.col("value")), F.lit(" which is not a valid "), "type")),
        _finding(F.col("via_fallback") & ~F.coalesce("fallback_recorded", F.lit(False)), "E-005", "value arrived through an undisclosed fallback"))


def check_claims(df: DataFrame) -> DataFrame:
    """Absence and event claims: (item, environment_ok, surfaces, asserted, support)."""
    absence = [
        _finding(~F.col("environment_ok"), "E-007", "absence concluded while the environment was degraded"),
        _finding(F.col("environment_ok") & (F.size("surfaces") < 2), "E-006", "absence concluded after a single search path")]
    event = _finding(F.col("asserted") & (F.lower("support") == "master_list"), "E-008", "event asserted on register or master-list support alone")
    return _checks(df, F.col("item"), check_absence_claims=absence, check_event_proof=[event])


def check_readable(df: DataFrame) -> DataFrame:
    """What a reader sees and what an extractor reads agree: (key, visible, machine)."""
    v, m = F.trim(F.coalesce("visible", F.lit(""))), F.trim(F.coalesce("machine", F.lit("")))
    return _findings(
        df, "check_machine_readability", F.col("key"),
        _finding((v != "") & (m == ""), "E-025", "visible value extracts as blank"),
        _finding((v != "") & (m != "") & (v != m), "E-025", "visible and extracted values differ"))


def check_structure(df: DataFrame, dimensions: Sequence[str] = rules.STRUCTURE_DIMENSIONS) -> DataFrame:
    """Protected structure survives: (key, <dimension>_before, <dimension>_after ...,
    late_formatting, tail_valid); dimensions without columns are skipped."""
    out = []
    for d in dimensions:
        if f"{d}_before" in df.columns:
            b, a = F.col(f"{d}_before"), F.col(f"{d}_after")
            out.append(_finding(b != a, "E-027", F.concat(F.lit(f"{d} changed from "), b.cast("string"), F.lit(" to "), a.cast("string"))))
    out.append(_finding(F.coalesce("late_formatting", F.lit(False)), "E-026", "a formatting pass ran after the write"))
    out.append(_finding(~F.coalesce("tail_valid", F.lit(True)), "E-027", "document tail is not valid"))
    return _findings(df, "check_protected_structure", F.col("key"), *out)


def check_status_scope(findings: DataFrame, requested: DataFrame, delivered: DataFrame) -> DataFrame:
    """Signature blanks on drafts are no defect; nothing is delivered unasked.

    ``findings``: (item, status, finding_type); ``requested`` / ``delivered``: (run_id,
    entry).  A run that requested nothing is not checked."""
    status = _findings(findings, "check_document_status", F.col("item"), _finding(
        (F.col("finding_type") == "SIGNATURE_BLANK") & (F.upper(F.trim("status")) == "DRAFT"), "E-030", "signature blank reported as a defect on a DRAFT document"))
    asked = requested.where("entry is not null").select("run_id", F.lower(F.trim("entry")).alias("e")).distinct()
    extra = delivered.withColumn("e", F.lower(F.trim("entry"))).join(asked.select("run_id").distinct(), "run_id", "left_semi").join(asked, ["run_id", "e"], "left_anti")
    return status.unionByName(_findings(extra, "check_scope_discipline", F.concat_ws(":", F.col("run_id").cast("string"), "entry"), _finding(
        F.lit(True), "E-045", "delivered outside the requested scope")))


def scan_sensitive(docs: DataFrame, patterns: Sequence[tuple[str, str]] = rules.SENSITIVE_PATTERNS, name_pattern: str | None = None) -> DataFrame:
    """First hit per document and pattern: (name, text).  The patterns are one expression,
    so each text is scanned once per pattern and nothing is joined."""
    out = [
        _finding(F.col("text").rlike(p), "E-044", F.concat(F.lit(f"contains {label}: "), _quoted(F.regexp_extract("text", p, 0))))
        for label, p in patterns]
    if name_pattern:
        out.append(_finding(F.col("name").rlike(name_pattern), "E-044", "sensitive file name"))
    return _findings(docs, "check_customer_data_firewall", F.col("name"), *out)


def check_snapshot(df: DataFrame) -> DataFrame:
    """(item, snapshot_source)"""
    return _findings(df, "check_customer_data_firewall", F.col("item"), _finding(
        F.col("snapshot_source") == "filesystem_walk", "E-043", "snapshot enumerated the filesystem instead of the governed file list"))


# ------------------------------------------------------------------ suite and gate
def run_all(findings: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, findings)


def release_gate(findings: DataFrame, gates: Mapping[str, Sequence[str]] = rules.GATES) -> DataFrame:
    """(gate, findings, blocking, ready): one row per gate, and one for other findings if
    there are any; ready only when all are 0."""
    gate = F.lit(rules.OTHER_GATE)
    for name, errors in gates.items():
        gate = F.when(F.col("error").isin(*errors), name).otherwise(gate)
    # a row for each gate, written, so that the total does not run the checks again
    counted = cut_lineage(findings.groupBy("error").agg(F.count("*").alias("n")).groupBy(gate.alias("gate")).agg(F.sum("n").alias("findings")))
    spark = findings.sparkSession
    every = spark.createDataFrame([(g,) for g in gates], "gate string")
    out = every.join(counted, "gate", "full_outer").select("gate", F.coalesce("findings", F.lit(0)).cast("bigint").alias("findings"))
    total = counted.agg(F.coalesce(F.sum("findings"), F.lit(0))).scalar()
    return out.withColumn("blocking", F.col("findings") > 0).withColumn("ready", total == 0)


def disposition_ledger(dispositions: DataFrame, rows: DataFrame) -> DataFrame:
    """(identity, destination, disposition): dispositions, and every row as populated."""
    return dispositions.select(
        F.col("key").alias("identity"), F.coalesce("target", "key").alias("destination"), F.coalesce("disposition", F.lit("UNEVALUATED")).alias("disposition")
    ).unionByName(rows.select(
        F.coalesce("name", F.lit("?")).alias("identity"), F.concat_ws(" row ", "table", F.col("row").cast("string")).alias("destination"),
        F.lit("POPULATED_VERIFIED").alias("disposition")))
