"""Comparison, set operations, consistency and structure checks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from proofgrain.functions import rules
from proofgrain.functions import text as tx
from proofgrain.session import compute_once, cut_lineage

FORM = ["packet_id", "form_id"]


# ------------------------------------------------------------------ indexes and runs
def index_delta(prev: DataFrame, cur: DataFrame) -> DataFrame:
    """(name, change): new, changed and deleted documents between two (name, hash) indexes."""
    j = cur.select("name", F.col("hash").alias("c")).join(prev.select("name", F.col("hash").alias("p")), "name", "full_outer")
    change = F.when(F.col("p").isNull(), "new").when(F.col("c").isNull(), "deleted").when(F.col("c") != F.col("p"), "changed")
    return j.withColumn("change", change).where("change is not null").select("name", "change")


def duplicate_files(index: DataFrame) -> DataFrame:
    """(hash, name) of files whose content occurs more than once, one row each."""
    many = index.groupBy("hash").agg(F.count("*").alias("copies")).where("copies > 1")
    return index.join(many, "hash").select("hash", "name", "copies")


def run_delta(blockers: DataFrame, runs: DataFrame, current: str) -> tuple[DataFrame, DataFrame]:
    """(blocker changes, progress per form) against the latest earlier run of the form.

    ``blockers``: (run_id, packet_id, form_id, blocker); ``runs``: (run_id, packet_id,
    form_id, finished, status).  Without an earlier run every blocker remains.
    """
    earlier = runs.where(F.col("run_id") != current).groupBy(*FORM).agg(F.max_by(F.struct("run_id", "status"), F.struct("finished", "run_id")).alias("prev"))
    now_runs = runs.where(F.col("run_id") == current).select(*FORM, "status").join(earlier, FORM, "left")
    old = blockers.join(earlier.select(*FORM, F.col("prev.run_id").alias("run_id")), [*FORM, "run_id"]).select(*FORM, "blocker").distinct().withColumn("old", F.lit(True))
    new = blockers.where(F.col("run_id") == current).select(*FORM, "blocker").distinct().withColumn("new", F.lit(True))
    j = new.join(old, [*FORM, "blocker"], "full_outer").join(now_runs.select(*FORM, F.col("prev").isNotNull().alias("had_prev")), FORM)
    change = (
        F.when(~F.col("had_prev"), "remaining").when(F.col("new").isNull(), "resolved").when(F.col("old").isNull(), "new").otherwise("remaining"))
    rows = j.select(*FORM, "blocker", change.alias("change"))
    counts = rows.groupBy(*FORM).agg(*[F.count_if(F.col("change") == c).alias(c) for c in ("resolved", "new", "remaining")])
    r, n = F.coalesce("resolved", F.lit(0)), F.coalesce("new", F.lit(0))
    net = F.when((r > 0) & (r >= n), "improved").when(n > 0, "regressed").otherwise("unchanged")
    progress = now_runs.join(counts, FORM, "left").select(
        *FORM, F.col("prev.status").alias("previous_status"), F.col("status").alias("current_status"),
        r.alias("resolved"), n.alias("new"), F.coalesce("remaining", F.lit(0)).alias("remaining"), net.alias("net_progress"))
    return rows, progress


def rollover(old: DataFrame, new: DataFrame, keys: Sequence[str] = ("packet_id", "field_id")) -> DataFrame:
    """Old against new value of each field -> one of six classes and the reason."""
    j = old.select(*keys, F.col("label").alias("l1"), F.nullif(F.trim("value"), F.lit("")).alias("old_value")).join(
        new.select(*keys, F.col("label").alias("l2"), F.nullif(F.trim("value"), F.lit("")).alias("new_value")), list(keys), "full_outer")
    words = F.lower(F.concat_ws(" ", "field_id", F.coalesce("l1", "l2")))
    date, person = words.rlike("date|permission|calibration"), words.rlike("welder|auditor|approved_by|name")
    o, n = F.col("old_value"), F.col("new_value")

    def verdict(name: str, why: str) -> Column:
        return F.struct(F.lit(name).alias("decision"), F.lit(why).alias("reason"))

    v = (
        F.when(o.isNull() & n.isNull(), verdict("requires_new_evidence", "no value in either run"))
        .when(o.isNull(), verdict("safe_to_roll", "new evidence present, no prior value"))
        .when(n.isNull() & person, verdict("do_not_roll", "personnel field; new evidence required"))
        .when(n.isNull() & date, verdict("obsolete", "date field with no new evidence"))
        .when(n.isNull(), verdict("requires_new_evidence", "prior value present but new evidence missing"))
        .when((o == n) & date, verdict("roll_with_date_check", "date matches; verify period validity"))
        .when(o == n, verdict("safe_to_roll", "identical to prior packet"))
        .when(person, verdict("do_not_roll", "personnel changed in new evidence"))
        .otherwise(verdict("conflict", "value differs from prior packet")))
    return j.withColumn("v", v).select(*keys, "old_value", "new_value", "v.decision", "v.reason")


# ------------------------------------------------------------------ ontology
def build_ontology(field_maps: DataFrame, identity: Sequence[str] = ()) -> DataFrame:
    """Canonical fields that occur in two or more form fields: category, display name and
    policies.  ``field_maps``: (form_id, field_id, label)."""
    cid = F.regexp_replace("field_id", r"_\d+$", "")
    category = F.lit("other")
    for pattern, name in reversed(rules.CATEGORY_RULES):
        category = F.when(F.lower("canonical_id").rlike(pattern), name).otherwise(category)
    policy = F.lit("manual_only")
    for name, mode in rules.ROLLOVER_POLICY.items():
        policy = F.when(F.col("category") == name, mode).otherwise(policy)
    label = F.when(F.col("label") != "", F.col("label"))
    per = field_maps.withColumn("canonical_id", cid).groupBy("canonical_id").agg(
        F.count("*").alias("instances"), F.min_by(label, F.when(label.isNotNull(), F.struct(-F.length("label"), "label"))).alias("longest"))
    return per.where("instances >= 2").withColumn("category", category).select(
        "canonical_id", F.coalesce("longest", F.initcap(F.replace("canonical_id", F.lit("_"), F.lit(" ")))).alias("display_name"), "instances", "category",
        F.when(F.col("category").isin(*rules.IGNORED_CATEGORIES), "ignore").otherwise("exact_match").alias("consistency"),
        policy.alias("rollover"),
        (F.col("canonical_id").isin(*identity or ["\0"]) | F.col("category").isin(*rules.EXACT_CATEGORIES)).alias("must_agree"))


def bindings(field_maps: DataFrame, ontology: DataFrame) -> DataFrame:
    """(form_id, field_id, canonical_id): which entity each form field stands for."""
    return field_maps.select("form_id", "field_id", F.regexp_replace("field_id", r"_\d+$", "").alias("canonical_id")).join(
        ontology.select("canonical_id"), "canonical_id", "left_semi")


def governed_bindings(field_maps: DataFrame, ontology: DataFrame) -> DataFrame:
    """``bindings`` with the mode and ``must_agree`` of their entity, as ``consistency`` reads them."""
    rules_of = ontology.select("canonical_id", F.col("consistency").alias("mode"), "must_agree")
    return bindings(field_maps, ontology).distinct().join(rules_of, "canonical_id")


def consistency(filled: DataFrame, bound: DataFrame, packet: str = "packet_id") -> DataFrame:
    """Canonical fields seen in two or more forms of a packet, and whether they agree.

    ``filled``: (packet, form_id, field_id, value); ``bound``: (form_id, field_id,
    canonical_id, mode, and optionally must_agree).  exact_match: one value; prefix_match: one
    first word; contains: every value contains, or is contained in, the smallest value.
    Entities compared as a whole or that must agree give errors, others warnings.
    """
    if "must_agree" not in bound.columns:
        bound = bound.withColumn("must_agree", F.lit(False))
    rows = filled.where("value <> ''").join(bound.where("mode <> 'ignore'"), ["form_id", "field_id"])
    # a form has one value per entity: that of its last field
    per_form = rows.groupBy(packet, "canonical_id", "mode", "form_id").agg(F.max_by("value", "field_id").alias("value"), F.max("must_agree").alias("must_agree"))
    first = F.upper(F.get(F.split(F.trim("value"), r"\s+"), F.lit(0)))
    per = per_form.groupBy(packet, "canonical_id", "mode").agg(
        F.count("*").alias("forms"), F.max("must_agree").alias("must_agree"), F.min("value").alias("base"), (F.min("value") == F.max("value")).alias("equal"), (F.min(first) == F.max(first)).alias("same_prefix"))
    per = per.where("forms >= 2")
    apart = per_form.join(per.where("mode = 'contains'").select(packet, "canonical_id", "base"), [packet, "canonical_id"]).where(
        ~F.contains("value", "base") & ~F.contains("base", "value")).select(packet, "canonical_id").distinct().withColumn("apart", F.lit(True))
    j = per.join(apart, [packet, "canonical_id"], "left")
    agrees = (
        F.when(F.col("mode") == "exact_match", F.col("equal")).when(F.col("mode") == "prefix_match", F.col("same_prefix"))
        .otherwise(F.col("apart").isNull()))
    return j.select(
        packet, "canonical_id", "mode", "forms", agrees.alias("agrees"),
        F.when(~agrees, F.when((F.col("mode") == "exact_match") | F.col("must_agree"), "error").otherwise("warning")).alias("severity"))


# ------------------------------------------------------------------ maps
def validate_map(field_map: DataFrame, manifest: DataFrame, grid: DataFrame) -> DataFrame:
    """(form_id, field_id, issue): what is wrong with a field map.

    ``field_map`` and ``manifest``: (form_id, field_id, tbl, row, col); ``grid``:
    (form_id, tbl, row, col, span).
    """
    at = ["form_id", "tbl", "row", "col"]
    crowded = field_map.groupBy(*at).agg(F.count("*").alias("n")).where("n > 1")
    duplicate = field_map.join(crowded, at, "left_semi").select("form_id", "field_id", F.lit("duplicate_coordinate").alias("issue"))
    cells = grid.select("form_id", "tbl", "row", F.col("col").alias("start"), "span")
    inside = field_map.join(cells, ["form_id", "tbl", "row"]).where("start <= col and col < start + span")
    shared = inside.groupBy("form_id", "tbl", "row", "start").agg(F.min("col").alias("a"), F.max("col").alias("b")).where("a <> b")
    merged = inside.join(shared.select("form_id", "tbl", "row", "start"), ["form_id", "tbl", "row", "start"], "left_semi").select(
        "form_id", "field_id", F.lit("duplicate_physical_cell").alias("issue"))
    outside = field_map.join(inside.select("form_id", "field_id"), ["form_id", "field_id"], "left_anti").select("form_id", "field_id", F.lit("outside_grid").alias("issue"))
    m = manifest.select("form_id", "field_id", F.struct("tbl", "row", "col").alias("m"))
    both = field_map.select("form_id", "field_id", F.struct("tbl", "row", "col").alias("f")).join(m, ["form_id", "field_id"], "full_outer")
    aligned = both.withColumn("issue", F.when(F.col("m").isNull(), "missing_from_manifest").when(F.col("f").isNull(), "not_in_map").when(F.col("m") != F.col("f"), "manifest_mismatch"))
    return duplicate.unionByName(merged).unionByName(outside).unionByName(aligned.where("issue is not null").select("form_id", "field_id", "issue"))


def suggest_ids(requested: DataFrame, known: DataFrame) -> DataFrame:
    """Unknown ids with the first known id that is equal without case or starts with
    '<id>_'."""
    unknown = requested.select("id").distinct().join(known.select(F.col("id")).distinct(), "id", "left_anti").withColumn("low", F.lower("id"))
    names = known.select(F.col("id").alias("known")).distinct().withColumn("k", F.lower("known"))
    # every prefix of a known id that ends before '_', plus the id itself, is a join key
    parts = F.split("k", "_")
    heads = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "_"))
    keyed = names.select("known", "k", F.explode(F.array_distinct(heads)).alias("low"))
    best = unknown.join(keyed, "low", "left").groupBy("id").agg(F.min_by("known", F.struct(F.col("k") != F.col("low"), "known")).alias("suggestion"))
    return best.select("id", "suggestion")


def normalize_ids(df: DataFrame, col: str, aliases: dict[str, str]) -> DataFrame:
    """Comma-separated id lists -> one canonical id per row (``form_id``)."""
    key = F.upper(F.regexp_replace(F.replace(F.col("piece"), F.lit("-"), F.lit("_")), r"\s+", " "))
    known = F.create_map(*[F.lit(x) for pair in aliases.items() for x in pair])
    pieces = F.filter(F.transform(F.split(col, ","), lambda p: F.trim(p)), lambda p: p != "")
    return df.withColumn("piece", F.explode(pieces)).withColumn("form_id", F.coalesce(F.try_element_at(known, key), F.replace(F.col("piece"), F.lit("-"), F.lit("_")))).drop("piece")


# ------------------------------------------------------------------ structure
def structure_drift(before: DataFrame, after: DataFrame) -> DataFrame:
    """Tables, rows and cells added and removed per document; passes when all are 0."""
    def shape(cells: DataFrame, n: str) -> DataFrame:
        return cells.groupBy("doc", "tbl", "row").agg(F.count("*").alias(n))

    rows = shape(before, "b").join(shape(after, "a"), ["doc", "tbl", "row"], "full_outer")
    old, new = F.col("b").isNotNull(), F.col("a").isNotNull()
    d = F.coalesce("a", F.lit(0)) - F.coalesce("b", F.lit(0))
    tables = rows.groupBy("doc", "tbl").agg(
        F.bool_or(old).alias("had"), F.bool_or(new).alias("has"), F.count_if(new & ~old).alias("rows_added"), F.count_if(old & ~new).alias("rows_removed"),
        F.sum(F.greatest(d, F.lit(0))).alias("cells_added"), F.sum(F.greatest(-d, F.lit(0))).alias("cells_removed"))
    per = tables.groupBy("doc").agg(
        F.count_if(F.col("has") & ~F.col("had")).alias("tables_added"), F.count_if(F.col("had") & ~F.col("has")).alias("tables_removed"),
        *[F.sum(c).alias(c) for c in ("rows_added", "rows_removed", "cells_added", "cells_removed")])
    total = sum((F.col(c) for c in per.columns[2:]), F.col(per.columns[1]))
    return per.withColumn("passed", total == 0)


def fingerprints(cells: DataFrame, header_rows: int = 3) -> DataFrame:
    """(doc, tbl, rows, headers, digest): the non-empty header rows of each table as JSON
    and a 16-digit digest.  Only header cells are gathered."""
    head = cells.where(F.col("row") < header_rows).withColumn("text", tx.safe_text(F.col("text"), keep_lines=False))
    line = head.groupBy("doc", "tbl", "row").agg(F.array_sort(F.collect_list(F.struct("col", "text"))).alias("c"), F.bool_or(F.col("text") != "").alias("filled"))
    table = line.where("filled").groupBy("doc", "tbl").agg(F.array_sort(F.collect_list(F.struct("row", F.col("c.text").alias("t")))).alias("r"))
    size = cells.groupBy("doc", "tbl").agg((F.max("row") + 1).alias("rows"))
    headers = F.coalesce(F.to_json(F.col("r.t")), F.lit("[]"))
    return size.join(table, ["doc", "tbl"], "left").select("doc", "tbl", "rows", headers.alias("headers"), F.substring(F.sha2(headers, 256), 1, 16).alias("digest"))


def compare_fingerprints(actual: DataFrame, expected: DataFrame, keys: Sequence[str]) -> DataFrame:
    """match, drift, missing_expected (no schema for the form) or extra_table.

    Both sides have ``keys`` (form first, then table) and digest."""
    form = keys[0]
    listed = expected.select(form).distinct().withColumn("listed", F.lit(True))
    j = actual.join(expected.select(*keys, F.col("digest").alias("want")), list(keys), "left").join(listed, form, "left")
    status = (
        F.when(F.col("listed").isNull(), "missing_expected").when(F.col("want").isNull(), "extra_table")
        .when(F.col("digest") == F.col("want"), "match").otherwise("drift"))
    return j.withColumn("status", status).drop("listed")


def cell_issues(cells: DataFrame, id_tokens: str = r"(?i)\bU\d{6,}\b", search_rows: int = 4) -> DataFrame:
    """(doc, tbl, row, col, code): cells whose text seems to span several columns."""
    # cleaned once, and written: headers, register tables, cells and repeated texts all read it
    c = cut_lineage(compute_once(cells.select("doc", "tbl", "row", "col", "text"), "text", tx.clean_cell(F.col("text"))).where("text <> ''"))
    # a word of a header lies in one of its cells, so the cells are asked, and no text is gathered
    text = F.col("text")
    told = c.where(F.col("row") < search_rows).select(
        "doc", "tbl", "col", text.rlike(r"(?i)\b(?:id|serial|gauge|equipment)\b").alias("for_ids"),
        text.rlike(r"(?i)\b(?:date|due|calibration|qualified|expires|expiration|approved)\b").alias("for_dates")).where("for_ids or for_dates").groupBy(
        "doc", "tbl", "col").agg(F.bool_or("for_ids").alias("for_ids"), F.bool_or("for_dates").alias("for_dates"))
    low = F.lower("text")
    gear = c.where("row <= 1").select(
        "doc", "tbl", "row", low.rlike("equipment|calibration|measure").alias("a"), low.rlike("id|date|due").alias("b")).where("a or b").groupBy(
        "doc", "tbl", "row").agg(F.bool_or("a").alias("a"), F.bool_or("b").alias("b")).where("a and b").select("doc", "tbl").distinct().withColumn("gear", F.lit(True))
    body = c.where("row >= 1")
    dates = F.regexp_count(F.col("text"), F.lit(rules.DATE_TOKEN))
    parts = F.size(F.filter(F.split("text", r"\|"), lambda p: F.trim(p) != ""))
    # what a cell's own text says of it goes to the headers, not the text
    own = body.select("doc", "tbl", "row", "col", (F.col("text").contains("|") & (parts >= 2)).alias("pipes"), (dates >= 2).alias("dates"),
                      F.col("text").rlike(id_tokens).alias("ids"), (F.length("text") > 180).alias("long")).where("pipes or dates or ids or long")
    j = own.join(told, ["doc", "tbl", "col"], "left").join(gear, ["doc", "tbl"], "left")
    codes = F.array_compact(F.array(
        F.when(F.col("pipes"), F.lit("pipe_delimited_spill")), F.when(F.col("for_ids") & F.col("dates"), F.lit("date_in_id_column")),
        F.when(F.col("for_dates") & F.col("ids"), F.lit("id_in_date_column")), F.when(F.col("gear") & F.col("long"), F.lit("equipment_cell_overflow"))))
    single = j.select("doc", "tbl", "row", "col", F.explode(codes).alias("code"))
    twins = body.where(F.length("text") >= 4).groupBy("doc", "tbl", "row", F.lower("text").alias("v")).agg(F.count("*").alias("n"), F.min("col").alias("col"))
    spill = (F.col("n") >= 3) | F.col("v").contains("|") | (F.regexp_count(F.col("v"), F.lit(rules.DATE_TOKEN)) >= 2) | (F.length("v") > 60)
    return single.unionByName(twins.where((F.col("n") >= 2) & spill).select("doc", "tbl", "row", "col", F.lit("duplicate_across_columns").alias("code")))


def date_tokens(docs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, code, token): ISO dates and month/year-only tokens in body text."""
    iso = F.regexp_extract_all("text", F.lit(r"\b\d{4}-\d{2}-\d{2}\b"), F.lit(0))
    month = F.regexp_extract_all("text", F.lit(r"(?<!\d/)\b\d{1,2}/\d{4}\b(?!\d)"), F.lit(0))

    def tagged(code: str, found: Column) -> Column:
        return F.transform(found, lambda t: F.struct(F.lit(code).alias("code"), t.alias("token")))

    return docs.select(*keys, F.inline(F.concat(tagged("iso_date_in_body", iso), tagged("month_year_only", month))))


def date_order(cells: DataFrame) -> DataFrame:
    """Rows whose first date (by column) lies after their last one: the calibration date
    must not follow its due date.  A year of two digits lies in this century."""
    found = F.regexp_extract("text", r"\b(\d{1,2}/\d{1,2}/\d{2,4})\b", 1)
    day = F.to_date(F.try_to_timestamp(F.regexp_replace(found, r"/(\d\d)$", "/20$1"), F.lit("M/d/yyyy")))
    dated = cells.withColumn("day", day).where("day is not null")
    per = dated.groupBy("doc", "tbl", "row").agg(F.count("*").alias("n"), F.min_by("day", "col").alias("first_day"), F.max_by("day", "col").alias("last_day"))
    return per.where("n >= 2 and first_day > last_day").select("doc", "tbl", "row", "first_day", "last_day")


def validation_summary(drift: DataFrame, cell: DataFrame, dates: DataFrame, fingerprint: DataFrame, docs: DataFrame,
                       flagged: DataFrame, typos: DataFrame, unresolved: DataFrame) -> DataFrame:
    """Issues per class and document, and whether the document passes.

    ``drift`` has doc and passed; the others doc (fingerprint also status).  Inconsistencies
    that were only flagged and typos that were mended are counted but fail no document."""
    classes = ((drift.where("not passed"), "layout_integrity_warnings"), (cell, "cell_boundary_issues"), (dates, "date_format_issues"),
               (fingerprint.where("status = 'drift'"), "fingerprint_drift_tables"), (unresolved, "unresolved_conflicts"),
               (flagged, "flagged_only_inconsistencies"), (typos, "typo_fixes_applied"))
    names = [name for _, name in classes]
    # one count of all classes by document, not a join for each
    found = docs.select("doc", F.lit("doc").alias("class"))
    for df, name in classes:
        found = found.unionByName(df.select("doc", F.lit(name).alias("class")))
    out = found.groupBy("doc").agg(*[F.count_if(F.col("class") == n).alias(n) for n in names], F.bool_or(F.col("class") == "doc").alias("_known"))
    out = out.where("_known").drop("_known")
    failing = names[:-2]
    return out.withColumn("passed", sum((F.col(n) for n in failing[1:]), F.col(failing[0])) == 0)


def covered_by(candidates: DataFrame, masters: DataFrame) -> DataFrame:
    """(doc, pages, covered, redundant): a document is redundant when every one of its page
    fingerprints occurs in the master corpus.  Documents without pages do not appear."""
    def prints(df: DataFrame) -> DataFrame:
        return df.withColumn("print", F.sha2(F.lower(F.trim("page_text")), 256))

    have = prints(masters).select("print").distinct().withColumn("hit", F.lit(True))
    pages = prints(candidates).groupBy("doc", "print").agg(F.count("*").alias("n"))
    j = pages.join(have, "print", "left")
    per = j.groupBy("doc").agg(F.sum("n").alias("pages"), F.coalesce(F.sum(F.when(F.col("hit"), F.col("n"))), F.lit(0)).alias("covered"))
    return per.withColumn("redundant", F.col("pages") == F.col("covered"))
