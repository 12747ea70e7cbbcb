"""Queries over the rule suite and the streaming index, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from proofgrain.functions import rules
from proofgrain.operators import compare, quality
from proofgrain.plans import inputs
from proofgrain.plans.ctes import CTES, with_ctes
from proofgrain.plans.decision_queries import decisions
from proofgrain.plans.scratch import scratch
from proofgrain.session import cut_lineage, table
from proofgrain.streaming import index

QUERIES, ORACLES = {}, {}


def _pick(value, *options):
    return F.element_at(F.array(*[F.lit(o) for o in options]), (value % len(options) + 1).cast("int"))


def personnel(spark, sf):
    k = F.col("c_custkey")
    word = F.initcap("c_mktsegment")
    return table(spark, sf, "customer").select(
        F.lit("people").alias("table"), k.alias("row"), F.when(k % 4 == 0, F.concat(word, word)).when(k % 4 == 1, F.concat(F.lit("Mc"), word)).otherwise(F.concat_ws(" ", word, "c_name")).alias("name"),
        _pick(k, "I", "II", "III", "IIII", "IV", "", " II ").alias("level"), _pick(k, "UT", "UTTVT", "XX", "HLT", "MTPT").alias("method"))


CTES["dq_people"] = rf"""
SELECT 'E-013' AS error, 'check_personnel_rows' AS "check", 'people row ' || k AS location, unnest(list_filter([
  CASE WHEN regexp_matches(regexp_replace(name, '{rules.NAME_PARTICLES.replace("'", "''")}', '', 'g'), '[a-z.][A-Z]') THEN 'name cell holds two glued identities' END,
  CASE level WHEN 'IIII' THEN 'level ''IIII'' is two levels merged (III + I)' WHEN 'IV' THEN 'level ''IV'' is outside the controlled set' END,
  CASE method WHEN 'UTTVT' THEN 'method ''UTTVT'' is two methods merged (UTT + VT)' WHEN 'MTPT' THEN 'method ''MTPT'' is two methods merged (MT + PT)' WHEN 'XX' THEN 'method ''XX'' is outside the controlled set' END],
  lambda x: x IS NOT NULL)) AS detail
FROM (SELECT c_custkey AS k, CASE c_custkey % 4 WHEN 0 THEN w || w WHEN 1 THEN 'Mc' || w ELSE w || ' ' || c_name END AS name,
    (['I', 'II', 'III', 'IIII', 'IV', '', ' II '])[c_custkey % 7 + 1] AS level, (['UT', 'UTTVT', 'XX', 'HLT', 'MTPT'])[c_custkey % 5 + 1] AS method
  FROM (SELECT *, upper(c_mktsegment[1]) || lower(c_mktsegment[2:]) AS w FROM customer))"""
QUERIES["dq1_personnel"] = lambda spark, sf: quality.check_personnel(personnel(spark, sf))
ORACLES["dq1_personnel"] = with_ctes("SELECT * FROM dq_people")


def equipment(spark, sf):
    k = F.col("p_partkey")
    return table(spark, sf, "part").select(
        F.lit("gear").alias("table"), k.alias("row"), F.when(k % 3 == 0, F.concat("p_name", F.initcap("p_name"))).otherwise(F.col("p_name")).alias("equipment_name"),
        F.when(k % 5 == 0, F.concat(F.lower("p_brand"), F.lit(".X"))).otherwise(F.col("p_brand")).alias("equipment_id"), F.concat_ws(" ", "p_type", "p_name").alias("function"))


CTES["dq_gear"] = """
SELECT 'E-013' AS error, 'check_equipment_rows' AS "check", 'gear row ' || p_partkey AS location, f || ' holds two glued records' AS detail
FROM part, (VALUES ('equipment_name', 3), ('equipment_id', 5)) v(f, m) WHERE p_partkey % m = 0"""
QUERIES["dq2_equipment"] = lambda spark, sf: quality.check_equipment(equipment(spark, sf))
ORACLES["dq2_equipment"] = with_ctes("SELECT * FROM dq_gear")


def record_types(spark, sf):
    kind = F.when(F.col("o_custkey") % 6 == 0, "form").when(F.col("o_orderstatus") == "F", "PROCEDURE").when(F.col("o_orderstatus") == "O", "Form").otherwise("note")
    rows = table(spark, sf, "orders").select(F.col("o_custkey").cast("string").alias("identifier"), kind.alias("type"))
    expected = table(spark, sf, "customer").select(F.col("c_custkey").cast("string").alias("identifier"), (F.col("c_custkey") % 4).alias("types"))
    return quality.check_record_types(rows, expected)


CTES["dq_types"] = """
SELECT 'E-010' AS error, 'check_record_type_separation' AS "check", CAST(o_custkey AS VARCHAR) AS location, 'record type ''note'' is not a distinct known type' AS detail
FROM orders WHERE o_custkey % 6 <> 0 AND o_orderstatus NOT IN ('F', 'O')
UNION ALL SELECT 'E-010', 'check_record_type_separation', CAST(o_custkey AS VARCHAR), 'one identifier resolved to a single type where several were expected'
FROM orders WHERE o_custkey % 4 > 1 GROUP BY o_custkey HAVING o_custkey % 6 = 0 OR count(DISTINCT CASE WHEN o_orderstatus IN ('F', 'O') THEN o_orderstatus END) + CAST(bool_or(o_orderstatus NOT IN ('F', 'O')) AS INTEGER) = 1"""
QUERIES["dq3_record_types"] = record_types
ORACLES["dq3_record_types"] = with_ctes("SELECT * FROM dq_types")


def leaves(spark, sf):
    l, k = F.col("l_linenumber").cast("string"), F.col("l_orderkey")
    key = F.when(k % 5 == 0, F.concat_ws("|", k.cast("string"), F.concat(F.lit("row "), l))).when(k % 5 == 1, F.concat_ws("/", F.lit("S"), k.cast("string"), F.col("l_returnflag"))).otherwise(
        F.concat_ws("|", k.cast("string"), F.col("l_partkey").cast("string"), F.col("l_suppkey").cast("string"), l, F.col("l_quantity").cast("int").cast("string")))
    return table(spark, sf, "lineitem").select(k.cast("string").alias("printed_section"), key.alias("leaf_key"))


CTES["dq_leaves"] = """
SELECT 'E-011' AS error, 'check_leaf_identity' AS "check", leaf_key AS location, 'leaf key carries position row ' || l_linenumber || ' as identity' AS detail
FROM (SELECT *, l_orderkey || '|row ' || l_linenumber AS leaf_key FROM lineitem WHERE l_orderkey % 5 = 0)
UNION ALL SELECT DISTINCT 'E-011', 'check_leaf_identity', CAST(k AS VARCHAR), 'repeated printed section resolves to fewer composite keys than leaves'
FROM (SELECT l_orderkey AS k, CASE l_orderkey % 5 WHEN 0 THEN 'row ' || l_linenumber WHEN 1 THEN l_returnflag ELSE l_partkey || '|' || l_suppkey || '|' || l_linenumber || '|' || l_quantity END AS leaf FROM lineitem) GROUP BY k, leaf HAVING count(*) > 1"""
QUERIES["dq4_leaf_keys"] = lambda spark, sf: quality.check_leaf_keys(leaves(spark, sf))
ORACLES["dq4_leaf_keys"] = with_ctes("SELECT * FROM dq_leaves")

CTES["dq_provenance"] = """
SELECT 'E-012' AS error, 'check_exact_identity_matching' AS "check", item AS location, 'matched by ' || method AS detail FROM run_records WHERE method = 'Substring'
UNION ALL SELECT 'E-014', 'check_coordinate_provenance', item, 'physical coordinate sourced from a prior run' FROM run_records WHERE coordinate_source = 'prior_run'
UNION ALL SELECT 'E-014', 'check_field_mapping_authority', item, 'reusable mapping keyed by page, which is position, not identity' FROM run_records WHERE keyed_by[1] = 'Page'
UNION ALL SELECT 'E-014', 'check_field_mapping_authority', item, 'identity is missing section' FROM run_records WHERE keyed_by[1] = 'form_version' AND len(keyed_by) = 2
UNION ALL SELECT 'E-014', 'check_field_mapping_authority', item, 'coordinates carried in from ''prior_run''' FROM run_records WHERE coordinate_source = 'prior_run'
UNION ALL SELECT 'E-002', 'check_field_mapping_authority', item, 'run-derived map used without validation against the current controlled form' FROM run_records WHERE map_source = 'run_derived' AND NOT validated
UNION ALL SELECT 'E-015', 'check_comparison_identity', item, 'compared ''order.status'' against ''order.date''' FROM run_records WHERE target_field = 'order.date'"""
QUERIES["dq5_provenance"] = lambda spark, sf: quality.check_provenance(inputs.run_records(spark, sf))
ORACLES["dq5_provenance"] = with_ctes("SELECT * FROM dq_provenance")


def modes(spark, sf):
    r = inputs.run_records(spark, sf)
    return quality.check_mode(r.select("run_id", "mode", "started_from", "rebuild_reason", "accepted_baseline").distinct(), r.select("run_id", "item", "was_correct", "target_value"))


CTES["dq_modes"] = """
WITH r AS (SELECT DISTINCT run_id, mode, started_from, rebuild_reason, accepted_baseline, mode IN ('rework', 'Rollover', 'CORRECTION') AS rework FROM run_records)
SELECT 'E-019' AS error, 'check_mode_and_baseline' AS "check", CAST(run_id AS VARCHAR) AS location, 'no job mode declared' AS detail FROM r WHERE mode = ''
UNION ALL SELECT 'E-036', 'check_mode_and_baseline', CAST(run_id AS VARCHAR), 'mode ''roll-over'' is unrecognized and cannot be checked' FROM r WHERE mode = 'roll-over'
UNION ALL SELECT 'E-019', 'check_mode_and_baseline', CAST(run_id AS VARCHAR), '''New Work'' chosen while an accepted working form already exists' FROM r WHERE mode = 'New Work' AND accepted_baseline
UNION ALL SELECT 'E-019', 'check_rework_baseline', CAST(run_id AS VARCHAR), 'rework restarted from a clean blank with no qualifying exception (reason: ' || coalesce(rebuild_reason, 'none given') || ')' FROM r WHERE rework AND started_from = 'blank' AND rebuild_reason IS DISTINCT FROM 'corrupted'
UNION ALL SELECT 'E-019', 'check_rework_baseline', item, 'correct existing values were lost during rework' FROM run_records WHERE run_id IN (SELECT run_id FROM r WHERE rework) AND was_correct AND target_value = ''"""
QUERIES["dq6_modes"] = modes
ORACLES["dq6_modes"] = with_ctes("SELECT * FROM dq_modes")


def dispositions(spark, sf):
    state = F.col("state")
    disposition = (
        F.when(state == "FILL", "populated_verified").when(state == "CONFLICT", "WITHHELD_FLAGGED_DISCREPANCY").when(state == "LOW_CONFIDENCE", "PENDING")
        .when(state == "REVIEW_REQUIRED", "UNEVALUATED").when(state == "BLOCKED_UNAUTHORIZED", F.lit(None)).otherwise("BLANK_UNSUPPORTED"))
    return decisions(spark, sf).select(
        F.concat_ws("/", F.col("packet_id").cast("string"), "field_id").alias("key"), F.lit(None).cast("string").alias("target"), disposition.alias("disposition"),
        F.when(state == "APPROVED_NA", "N/A").when((state == "FILL") & (F.col("packet_id") % 9 == 0), " ").otherwise(F.col("value")).alias("target_value"),
        (F.col("n_alternates") > 0).alias("sources_disagree"), (F.col("write") < 0.8).alias("low_confidence"))


CTES["dispositions"] = """
SELECT packet_id || '/' || field_id AS key, CASE state WHEN 'FILL' THEN 'POPULATED_VERIFIED' WHEN 'CONFLICT' THEN 'WITHHELD_FLAGGED_DISCREPANCY' WHEN 'LOW_CONFIDENCE' THEN 'PENDING' WHEN 'REVIEW_REQUIRED' THEN 'UNEVALUATED'
    WHEN 'BLOCKED_UNAUTHORIZED' THEN '' ELSE 'BLANK_UNSUPPORTED' END AS d,
  CASE WHEN state = 'APPROVED_NA' THEN 'N/A' WHEN state = 'FILL' AND packet_id % 9 = 0 THEN '' ELSE coalesce(value, '') END AS t, n_alternates > 0 AS disagree, write < 0.8 AS low FROM decided"""
CTES["dq_dispositions"] = """
SELECT CASE WHEN d = 'POPULATED_VERIFIED' THEN 'E-017' ELSE 'E-016' END AS error, 'check_two_way_completeness' AS "check", key AS location,
  CASE d WHEN '' THEN 'required identity has no disposition' WHEN 'UNEVALUATED' THEN 'required identity has no disposition' WHEN 'PENDING' THEN 'disposition ''PENDING'' is outside the known dispositions'
    WHEN 'POPULATED_VERIFIED' THEN 'claimed POPULATED_VERIFIED while the destination is blank' ELSE 'claimed BLANK_UNSUPPORTED while the destination is populated' END AS detail
FROM dispositions WHERE d IN ('', 'UNEVALUATED', 'PENDING') OR (d = 'POPULATED_VERIFIED' AND t = '') OR (d = 'BLANK_UNSUPPORTED' AND t <> '')"""
CTES["dq_conflicts"] = """
SELECT 'E-018' AS error, 'check_conflict_preservation' AS "check", key AS location, 'sources disagree but disposition is ''' || d || '''' AS detail FROM dispositions WHERE disagree AND d <> 'WITHHELD_FLAGGED_DISCREPANCY'
UNION ALL SELECT 'E-018', 'check_conflict_preservation', key, 'low-confidence candidate promoted to POPULATED_VERIFIED' FROM dispositions WHERE low AND d = 'POPULATED_VERIFIED'"""
QUERIES["dq7_dispositions"] = lambda spark, sf: quality.check_dispositions(dispositions(spark, sf))
ORACLES["dq7_dispositions"] = with_ctes("SELECT * FROM dq_dispositions")
QUERIES["dq8_conflicts"] = lambda spark, sf: quality.check_conflicts(dispositions(spark, sf))
ORACLES["dq8_conflicts"] = with_ctes("SELECT * FROM dq_conflicts")


def admissible(spark, sf):
    e = F.col("event_id")
    return table(spark, sf, "events").select(
        e.cast("string").alias("key"), _pick(e, "Date", "identifier", "number").alias("type"),
        F.when(e % 3 == 0, F.when(e % 2 == 0, F.date_format("ts", "M/d/yyyy")).otherwise(F.date_format("ts", "yyyy-MM"))).when(e % 3 == 1, F.when(e % 4 == 0, " ").otherwise(F.col("event_type"))).otherwise(F.lit("x")).alias("value"),
        (e % 5 != 0).alias("accepted"), (e % 7 == 0).alias("via_fallback"), F.when(e % 2 == 0, True).alias("fallback_recorded"))


CTES["dq_admissible"] = """
SELECT 'E-003' AS error, 'check_candidate_admissibility' AS "check", CAST(event_id AS VARCHAR) AS location, CASE WHEN event_id % 3 = 0 THEN 'accepted ''' || strftime(ts, '%Y-%m') || ''' which is not a valid Date' ELSE 'accepted '' '' which is not a valid identifier' END AS detail
FROM events WHERE event_id % 5 <> 0 AND ((event_id % 3 = 0 AND event_id % 2 = 1) OR (event_id % 3 = 1 AND event_id % 4 = 0))
UNION ALL SELECT 'E-005', 'check_candidate_admissibility', CAST(event_id AS VARCHAR), 'value arrived through an undisclosed fallback' FROM events WHERE event_id % 5 <> 0 AND event_id % 7 = 0 AND event_id % 2 = 1"""
QUERIES["dq9_admissible"] = lambda spark, sf: quality.check_admissible(admissible(spark, sf))
ORACLES["dq9_admissible"] = with_ctes("SELECT * FROM dq_admissible")

CTES["dq_claims"] = """
SELECT CASE WHEN environment_ok THEN 'E-006' ELSE 'E-007' END AS error, 'check_absence_claims' AS "check", item AS location,
  CASE WHEN environment_ok THEN 'absence concluded after a single search path' ELSE 'absence concluded while the environment was degraded' END AS detail FROM run_records WHERE NOT environment_ok OR len(surfaces) < 2
UNION ALL SELECT 'E-008', 'check_event_proof', item, 'event asserted on register or master-list support alone' FROM run_records WHERE asserted AND support = 'Master_List'"""
QUERIES["dq10_claims"] = lambda spark, sf: quality.check_claims(inputs.run_records(spark, sf))
ORACLES["dq10_claims"] = with_ctes("SELECT * FROM dq_claims")


def readable(spark, sf):
    p = F.col("page_id")
    return table(spark, sf, "pages").select(
        p.cast("string").alias("key"), F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("visible"),
        F.when(p % 4 == 0, "").otherwise(F.regexp_extract("html", "<h1>([^<]*)</h1>", 1)).alias("machine"))


CTES["dq_readable"] = """
SELECT 'E-025' AS error, 'check_machine_readability' AS "check", CAST(page_id AS VARCHAR) AS location, CASE WHEN m = '' THEN 'visible value extracts as blank' ELSE 'visible and extracted values differ' END AS detail
FROM (SELECT page_id, trim(regexp_extract(html, '<title>([^<]*)</title>', 1)) AS v, CASE WHEN page_id % 4 = 0 THEN '' ELSE trim(regexp_extract(html, '<h1>([^<]*)</h1>', 1)) END AS m FROM pages) WHERE v <> '' AND v <> m"""
QUERIES["dq11_readable"] = lambda spark, sf: quality.check_readable(readable(spark, sf))
ORACLES["dq11_readable"] = with_ctes("SELECT * FROM dq_readable")


def structures(spark, sf):
    """Shapes before and after a run in which some documents lost row 1 of their first table
    (from 1,000,000 parts on, a part and an order share a document)."""
    tables = inputs.grid(spark, sf).groupBy("doc", "tbl").agg(
        F.count_distinct("row").alias("rows"), F.count_if(F.col("span") > 1).alias("merges"),
        F.max((F.col("row") == 1).cast("int")).alias("hit"), F.count_if((F.col("span") > 1) & (F.col("row") == 1)).alias("hit_merges"))
    shape = tables.groupBy("doc").agg(
        F.sum("rows").alias("rows_before"), F.count("*").alias("tables_before"), F.sum("merges").alias("merges_before"),
        F.min_by(F.struct("hit", "hit_merges", (F.col("rows") == F.col("hit")).cast("int").alias("gone")), "tbl").alias("first"))
    shape = shape.select("*", *[
        (F.col(f"{what}_before") - F.when(F.col("doc") % 17 == 0, F.col(f"first.{lost}")).otherwise(0)).alias(f"{what}_after")
        for what, lost in (("rows", "hit"), ("tables", "gone"), ("merges", "hit_merges"))]).drop("first")
    return shape.select(F.col("doc").cast("string").alias("key"), *[c for c in shape.columns if c != "doc"], (F.col("doc") % 31 == 0).alias("late_formatting"), F.when(F.col("doc") % 37 == 0, False).alias("tail_valid"))


CTES["dq_structure"] = """
SELECT 'E-027' AS error, 'check_protected_structure' AS "check", CAST(doc AS VARCHAR) AS location, 'rows changed from ' || n || ' to ' || (n - 1) AS detail FROM (SELECT doc, count(DISTINCT (tbl, row)) AS n FROM grid GROUP BY 1) WHERE doc % 17 = 0
UNION ALL SELECT 'E-027', 'check_protected_structure', CAST(doc AS VARCHAR), 'merges changed from ' || n || ' to ' || m FROM (SELECT doc, count(*) FILTER (span > 1) AS n, count(*) FILTER (span > 1 AND row <> 1) AS m FROM grid GROUP BY 1) WHERE doc % 17 = 0 AND n <> m
UNION ALL SELECT DISTINCT 'E-026', 'check_protected_structure', CAST(doc AS VARCHAR), 'a formatting pass ran after the write' FROM grid WHERE doc % 31 = 0
UNION ALL SELECT DISTINCT 'E-027', 'check_protected_structure', CAST(doc AS VARCHAR), 'document tail is not valid' FROM grid WHERE doc % 37 = 0"""
QUERIES["dq12_structure"] = lambda spark, sf: quality.check_structure(structures(spark, sf))
ORACLES["dq12_structure"] = with_ctes("SELECT * FROM dq_structure")


def status_scope(spark, sf):
    r = inputs.run_records(spark, sf)
    return quality.check_status_scope(r, r.select("run_id", F.col("requested").alias("entry")), r.select("run_id", F.col("delivered").alias("entry")))


CTES["dq_status"] = """
SELECT 'E-030' AS error, 'check_document_status' AS "check", item AS location, 'signature blank reported as a defect on a DRAFT document' AS detail FROM run_records WHERE finding_type = 'SIGNATURE_BLANK' AND upper(status) = 'DRAFT'
UNION ALL SELECT 'E-045', 'check_scope_discipline', run_id || ':' || delivered, 'delivered outside the requested scope' FROM run_records r WHERE requested IS NOT NULL
  AND NOT EXISTS (SELECT 1 FROM run_records q WHERE q.run_id = r.run_id AND q.requested = r.delivered)"""
QUERIES["dq13_status_scope"] = status_scope
ORACLES["dq13_status_scope"] = with_ctes("SELECT * FROM dq_status")

SCAN = (*rules.SENSITIVE_PATTERNS, ("e-mail", r"[A-Za-z0-9._]+@[A-Za-z0-9.-]+[.][a-z]{2,}"), ("phone", r"[+]\d [(]\d{3}[)] \d{3}-\d{4}"))


def sensitive(spark, sf):
    docs = table(spark, sf, "documents").select(F.concat("source", F.lit("/"), F.col("doc_id").cast("string")).alias("name"), "text")
    return quality.scan_sensitive(docs, SCAN, "^src7/").unionByName(quality.check_snapshot(inputs.run_records(spark, sf)))


_scans = " UNION ALL ".join(f"SELECT 'E-044' AS error, 'check_customer_data_firewall' AS \"check\", source || '/' || doc_id AS location, 'contains {n}: ''' || regexp_extract(text, '{p}') || '''' AS detail FROM documents WHERE regexp_matches(text, '{p}')" for n, p in SCAN)
CTES["dq_sensitive"] = _scans + """
UNION ALL SELECT 'E-044', 'check_customer_data_firewall', source || '/' || doc_id, 'sensitive file name' FROM documents WHERE source = 'src7'
UNION ALL SELECT 'E-043', 'check_customer_data_firewall', item, 'snapshot enumerated the filesystem instead of the governed file list' FROM run_records WHERE snapshot_source = 'filesystem_walk'"""
QUERIES["dq14_sensitive_scan"] = sensitive
ORACLES["dq14_sensitive_scan"] = with_ctes("SELECT * FROM dq_sensitive")

CHECKS = ("dq1_personnel", "dq2_equipment", "dq3_record_types", "dq4_leaf_keys", "dq5_provenance", "dq6_modes", "dq7_dispositions", "dq8_conflicts",
          "dq9_admissible", "dq10_claims", "dq11_readable", "dq12_structure", "dq13_status_scope", "dq14_sensitive_scan")
TABLES = ("dq_people", "dq_gear", "dq_types", "dq_leaves", "dq_provenance", "dq_modes", "dq_dispositions", "dq_conflicts", "dq_admissible", "dq_claims",
          "dq_readable", "dq_structure", "dq_status", "dq_sensitive")


def suite(spark, sf):
    """Each check's findings are written before the next runs: fourteen checks in one plan would
    hold the shuffle files of all until the last is done."""
    return quality.run_all([cut_lineage(QUERIES[name](spark, sf)) for name in CHECKS])


CTES["dq_all"] = " UNION ALL ".join(f'SELECT error, "check", location, detail FROM {t}' for t in TABLES)
QUERIES["dq15_suite"] = lambda spark, sf: suite(spark, sf)
ORACLES["dq15_suite"] = with_ctes("SELECT * FROM dq_all")

_gate = " ".join(f"WHEN error IN ({', '.join(repr(e) for e in es)}) THEN '{g}'" for g, es in rules.GATES.items())
_gates = ", ".join(f"('{g}')" for g in rules.GATES)
QUERIES["dq16_release_gate"] = lambda spark, sf: quality.release_gate(suite(spark, sf))
ORACLES["dq16_release_gate"] = with_ctes(f"""
SELECT gate, coalesce(n, 0) AS findings, coalesce(n, 0) > 0 AS blocking, (SELECT count(*) FROM dq_all) = 0 AS ready
FROM (VALUES {_gates}) v(gate) FULL JOIN (SELECT CASE {_gate} ELSE '{rules.OTHER_GATE}' END AS gate, count(*) AS n FROM dq_all GROUP BY 1) USING (gate)""")
QUERIES["dq16_disposition_ledger"] = lambda spark, sf: quality.disposition_ledger(dispositions(spark, sf), personnel(spark, sf))
ORACLES["dq16_disposition_ledger"] = with_ctes("""
SELECT key AS identity, key AS destination, CASE d WHEN '' THEN 'UNEVALUATED' WHEN 'POPULATED_VERIFIED' THEN 'populated_verified' ELSE d END AS disposition FROM dispositions
UNION ALL SELECT CASE c_custkey % 4 WHEN 0 THEN w || w WHEN 1 THEN 'Mc' || w ELSE w || ' ' || c_name END, 'people row ' || c_custkey, 'POPULATED_VERIFIED' FROM (SELECT *, upper(c_mktsegment[1]) || lower(c_mktsegment[2:]) AS w FROM customer)""")


WAVES_OF_SOURCE, DOCS_OF_FILE = 8, 500


def streamed(spark, sf):
    """Every document goes into files of a source, a range of ids and a bucket, at most
    ``DOCS_OF_FILE`` documents in each; in the second wave some files
    are rewritten, some deleted, some come new and with an old date, and the others stay."""
    inbox, log, state, made = (scratch(spark, x) for x in ("inbox", "index", "stream", "made"))
    docs = table(spark, sf, "documents").select(
        F.concat_ws("-", F.coalesce("source", F.lit("none")), F.expr(f"doc_id div {WAVES_OF_SOURCE * DOCS_OF_FILE}").cast("string"), (F.col("doc_id") % WAVES_OF_SOURCE).cast("string")).alias("file"),
        (F.col("doc_id") % WAVES_OF_SOURCE).alias("bucket"), "text")
    jvm, conf = spark._jvm.org.apache.hadoop.fs, spark._jsc.hadoopConfiguration()
    fs = jvm.Path(inbox).getFileSystem(conf)

    def put(rows, wave, folder):
        """A file of each name; returns their paths."""
        paths = []
        rows.select("file", "text").repartition("file").write.partitionBy("file").text(f"{made}/{wave}")
        fs.mkdirs(jvm.Path(f"{inbox}/{folder}"))
        for of_file in fs.listStatus(jvm.Path(f"{made}/{wave}")):
            if of_file.isDirectory():
                target = jvm.Path(f"{inbox}/{folder}/{of_file.getPath().getName().partition('=')[2]}.txt")
                fs.delete(target, False)
                fs.rename(next(f.getPath() for f in fs.listStatus(of_file.getPath()) if f.getPath().getName().startswith("part-")), target)
                paths.append(target)
        return paths

    first = put(docs.where("bucket <> 1"), "first", "main")
    index.stream_index(spark, inbox, log, state, "*.txt").awaitTermination()
    put(docs.where("bucket = 0").withColumn("text", F.concat("text", F.lit(" revised"))), "second", "main")
    for path in put(docs.where("bucket = 1"), "third", "late"):
        fs.setTimes(path, 1_000_000_000_000, -1)
    for path in first:
        if path.getName().endswith("-2.txt"):
            fs.delete(path, False)
    index.stream_index(spark, inbox, log, state, "*.txt").awaitTermination()
    index.refresh_index(spark, inbox, log, 1, "*.txt")  # the batch once more
    index.refresh_index(spark, inbox, log, 2, "*.txt")  # nothing has changed since
    changes = index.changes(spark, log).groupBy(F.col("batch_id").cast("int").alias("batch_id"), "change").agg(F.count("*").alias("files"))
    return changes.unionByName(index.current_index(spark, log).agg(F.lit(-1).alias("batch_id"), F.lit("current").alias("change"), F.count("*").alias("files")))


QUERIES["str1_stream_index"] = streamed
ORACLES["str1_stream_index"] = f"""
WITH files AS (SELECT DISTINCT coalesce(source, 'none') AS source, doc_id // {WAVES_OF_SOURCE * DOCS_OF_FILE} AS block, doc_id % {WAVES_OF_SOURCE} AS bucket FROM documents),
n AS (
  SELECT 0 AS batch_id, 'new' AS change, count(*) AS files FROM files WHERE bucket <> 1
  UNION ALL SELECT 1, 'changed', count(*) FROM files WHERE bucket = 0
  UNION ALL SELECT 1, 'new', count(*) FROM files WHERE bucket = 1
  UNION ALL SELECT 1, 'deleted', count(*) FROM files WHERE bucket = 2)
SELECT * FROM n WHERE files > 0
UNION ALL SELECT -1, 'current', CAST(sum(CASE change WHEN 'new' THEN files WHEN 'deleted' THEN -files ELSE 0 END) AS BIGINT) FROM n"""
