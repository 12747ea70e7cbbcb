"""Queries over comparison and structure checks, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from proofgrain.functions import rules
from proofgrain.operators import compare
from proofgrain.plans import inputs
from proofgrain.plans.ctes import CTES, with_ctes
from proofgrain.plans.decision_queries import decisions, reviewed
from proofgrain.plans.evidence_queries import staged_ledger
from proofgrain.plans.stages import stage
from proofgrain.session import table

QUERIES, ORACLES = {}, {}

QUERIES["cmp1_index_delta"] = lambda spark, sf: compare.index_delta(inputs.index_prev(spark, sf), inputs.index_cur(spark, sf))
ORACLES["cmp1_index_delta"] = with_ctes("""
SELECT name, CASE WHEN p.hash IS NULL THEN 'new' WHEN c.hash IS NULL THEN 'deleted' ELSE 'changed' END AS change
FROM index_cur c FULL JOIN index_prev p USING (name) WHERE c.hash IS DISTINCT FROM p.hash""")
QUERIES["cmp1_duplicate_files"] = lambda spark, sf: compare.duplicate_files(inputs.index_cur(spark, sf))
ORACLES["cmp1_duplicate_files"] = with_ctes("""
SELECT hash, name, copies FROM (SELECT *, count(*) OVER (PARTITION BY hash) AS copies FROM index_cur) WHERE copies > 1""")


def run_tables(spark, sf):
    """Three runs: the current one and two earlier ones that had other blockers."""
    open_rows = decisions(spark, sf).where("state not in ('FILL', 'OPTIONAL_BLANK', 'APPROVED_NA')")
    base = open_rows.select("packet_id", "form_id", F.concat_ws(": ", "field_id", "state").alias("blocker"), F.length("field_id").alias("n"))
    p = F.col("packet_id")
    blockers = base.where("(packet_id + n) % 3 <> 0").withColumn("run_id", F.lit("r3")).unionByName(
        base.where("packet_id % 5 <> 1 and (packet_id + n) % 4 <> 0").withColumn("run_id", F.lit("r2"))).unionByName(base.withColumn("run_id", F.lit("r1"))).drop("n")
    forms = inputs.packets(spark, sf).select("packet_id", "form_id")
    runs = forms.select(F.lit("r3").alias("run_id"), "packet_id", "form_id", F.lit(30).alias("finished"), F.lit("failed_completion").alias("status")).unionByName(
        forms.where("packet_id % 5 <> 1").select(F.lit("r2"), "packet_id", "form_id", F.when(p % 2 == 0, 20).otherwise(5), F.lit("failed_conflict_resolution")).toDF("run_id", "packet_id", "form_id", "finished", "status")).unionByName(
        forms.where("packet_id % 7 <> 1").select(F.lit("r1"), "packet_id", "form_id", F.lit(10), F.lit("success")).toDF("run_id", "packet_id", "form_id", "finished", "status"))
    return blockers, runs


CTES["run_blockers"] = """
SELECT 'r3' AS run_id, * FROM (SELECT packet_id, form_id, field_id || ': ' || state AS blocker, length(field_id) AS n FROM decided WHERE state NOT IN ('FILL', 'OPTIONAL_BLANK', 'APPROVED_NA')) WHERE (packet_id + n) % 3 <> 0
UNION ALL SELECT 'r2', * FROM (SELECT packet_id, form_id, field_id || ': ' || state, length(field_id) AS n FROM decided WHERE state NOT IN ('FILL', 'OPTIONAL_BLANK', 'APPROVED_NA')) WHERE packet_id % 5 <> 1 AND (packet_id + n) % 4 <> 0
UNION ALL SELECT 'r1', packet_id, form_id, field_id || ': ' || state, 0 FROM decided WHERE state NOT IN ('FILL', 'OPTIONAL_BLANK', 'APPROVED_NA')"""
CTES["prev_run"] = """
SELECT packet_id, form_id, CASE WHEN has2 AND (even OR NOT has1) THEN 'r2' WHEN has1 THEN 'r1' WHEN has2 THEN 'r2' END AS run_id
FROM (SELECT packet_id, form_id, packet_id % 5 <> 1 AS has2, packet_id % 7 <> 1 AS has1, packet_id % 2 = 0 AS even FROM packets)"""
CTES["blocker_change"] = """
SELECT packet_id, form_id, blocker, CASE WHEN prev IS NULL THEN 'remaining' WHEN NOT now THEN 'resolved' WHEN NOT old THEN 'new' ELSE 'remaining' END AS change
FROM (SELECT b.packet_id, b.form_id, b.blocker, any_value(p.run_id) AS prev, bool_or(b.run_id = 'r3') AS now, bool_or(b.run_id = p.run_id) IS TRUE AS old
  FROM run_blockers b JOIN prev_run p USING (packet_id, form_id) WHERE b.run_id = 'r3' OR b.run_id = p.run_id GROUP BY ALL)"""
QUERIES["cmp2_blocker_changes"] = lambda spark, sf: compare.run_delta(*run_tables(spark, sf), "r3")[0]
ORACLES["cmp2_blocker_changes"] = with_ctes("SELECT * FROM blocker_change")
QUERIES["cmp2_run_progress"] = lambda spark, sf: compare.run_delta(*run_tables(spark, sf), "r3")[1]
ORACLES["cmp2_run_progress"] = with_ctes("""
SELECT packet_id, form_id, CASE run_id WHEN 'r2' THEN 'failed_conflict_resolution' WHEN 'r1' THEN 'success' END AS previous_status, 'failed_completion' AS current_status,
  resolved, new, remaining, CASE WHEN resolved > 0 AND resolved >= new THEN 'improved' WHEN new > 0 THEN 'regressed' ELSE 'unchanged' END AS net_progress
FROM (SELECT p.*, count(*) FILTER (change = 'resolved') AS resolved, count(*) FILTER (change = 'new') AS new, count(*) FILTER (change = 'remaining') AS remaining
  FROM prev_run p LEFT JOIN blocker_change c USING (packet_id, form_id) GROUP BY ALL)""")

QUERIES["cmp3_rollover"] = lambda spark, sf: compare.rollover(inputs.period_values(spark, sf, False), inputs.period_values(spark, sf, True))
ORACLES["cmp3_rollover"] = with_ctes("""
SELECT packet_id, field_id, o.value AS old_value, n.value AS new_value,
  CASE WHEN o.value IS NULL THEN 'safe_to_roll' WHEN n.value IS NULL THEN CASE field_id WHEN 'order.priority' THEN 'do_not_roll' WHEN 'order.date' THEN 'obsolete' ELSE 'requires_new_evidence' END
    WHEN o.value = n.value THEN CASE WHEN field_id = 'order.date' THEN 'roll_with_date_check' ELSE 'safe_to_roll' END WHEN field_id = 'order.priority' THEN 'do_not_roll' ELSE 'conflict' END AS decision,
  CASE WHEN o.value IS NULL THEN 'new evidence present, no prior value' WHEN n.value IS NULL THEN CASE field_id WHEN 'order.priority' THEN 'personnel field; new evidence required' WHEN 'order.date' THEN 'date field with no new evidence' ELSE 'prior value present but new evidence missing' END
    WHEN o.value = n.value THEN CASE WHEN field_id = 'order.date' THEN 'date matches; verify period validity' ELSE 'identical to prior packet' END WHEN field_id = 'order.priority' THEN 'personnel changed in new evidence' ELSE 'value differs from prior packet' END AS reason
FROM old_values o FULL JOIN new_values n USING (packet_id, field_id)""")


def filled_forms(spark, sf):
    """Review decisions read as forms of a larger packet: ten customers share one."""
    r = reviewed(spark, sf)
    return r.select(F.floor(F.col("packet_id") / 10).alias("packet_id"), F.col("packet_id").cast("string").alias("form_id"), "field_id",
                    F.when(F.col("field_id") == "customer.nation", F.concat_ws(" ", F.lit("Land"), "value")).otherwise(F.col("value")).alias("value"))


def bound(spark, sf):
    mode = F.element_at(F.array(*[F.lit(m) for m in ("exact_match", "prefix_match", "contains", "ignore")]),
                        F.when(F.col("field_id") == "order.status", 1).when(F.col("field_id") == "customer.nation", 2)
                        .when(F.col("field_id").isin("order.priority", "customer.segment"), 3).otherwise(4))
    return filled_forms(spark, sf).select("form_id", "field_id").distinct().select("form_id", "field_id", F.regexp_replace("field_id", "^(customer|order)[.]", "").alias("canonical_id"), mode.alias("mode"))


QUERIES["cmp4_cross_form_consistency"] = lambda spark, sf: compare.consistency(filled_forms(spark, sf), bound(spark, sf))
ORACLES["cmp4_cross_form_consistency"] = with_ctes("""
WITH f AS (SELECT packet_id // 10 AS packet_id, string_split(field_id, '.')[2] AS canonical_id, CASE field_id WHEN 'order.status' THEN 'exact_match' WHEN 'customer.nation' THEN 'prefix_match' ELSE 'contains' END AS mode,
    CASE WHEN field_id = 'customer.nation' THEN 'Land ' || value ELSE value END AS value FROM reviewed WHERE field_id IN ('order.status', 'customer.nation', 'order.priority', 'customer.segment') AND value <> ''),
g AS (SELECT packet_id, canonical_id, mode, count(*) AS forms, CASE mode WHEN 'exact_match' THEN count(DISTINCT value) = 1 WHEN 'prefix_match' THEN count(DISTINCT upper(string_split(value, ' ')[1])) = 1
    ELSE bool_and(contains(value, base) OR contains(base, value)) END AS agrees FROM (SELECT *, min(value) OVER (PARTITION BY packet_id, canonical_id) AS base FROM f) GROUP BY packet_id, canonical_id, mode)
SELECT packet_id, canonical_id, mode, forms, agrees, CASE WHEN NOT agrees THEN CASE WHEN mode = 'exact_match' THEN 'error' ELSE 'warning' END END AS severity FROM g WHERE forms >= 2""")


def field_maps(spark, sf):
    k = F.col("p_partkey")
    stem = F.element_at(F.array(*[F.lit(s) for s in ("car_mark", "owner_name", "pitp_id", "welder_stamp", "plate_size", "due_date", "odd", "gauge_id")]), (k % 8 + 1).cast("int"))
    part = table(spark, sf, "part")
    return part.select(F.col("p_brand").alias("form_id"),
                       F.concat_ws("_", stem, F.split("p_name", " ")[1], F.when(k % 3 == 0, (k % 40).cast("string"))).alias("field_id"),
                       F.when(k % 5 == 0, "").otherwise(F.concat(F.initcap("p_name"), F.lit(" "), "p_brand")).alias("label"), "p_size", "p_type")


QUERIES["cmp5_field_ontology"] = lambda spark, sf: compare.build_ontology(field_maps(spark, sf), ["odd_gear"])
CTES["field_maps"] = """
SELECT p_brand AS form_id, (['car_mark', 'owner_name', 'pitp_id', 'welder_stamp', 'plate_size', 'due_date', 'odd', 'gauge_id'])[p_partkey % 8 + 1] || '_' || string_split(p_name, ' ')[2]
    || CASE WHEN p_partkey % 3 = 0 THEN '_' || (p_partkey % 40) ELSE '' END AS field_id,
  CASE WHEN p_partkey % 5 = 0 THEN '' ELSE array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(w[1]) || w[2:]), ' ') || ' ' || p_brand END AS label, p_size, p_type FROM part"""
_cases = " ".join(f"WHEN regexp_matches(canonical_id, '{p}') THEN '{c}'" for p, c in rules.CATEGORY_RULES)
_roll = " ".join(f"WHEN '{c}' THEN '{m}'" for c, m in rules.ROLLOVER_POLICY.items())
CTES["ontology"] = rf"""
SELECT canonical_id, coalesce(longest, array_to_string(list_transform(string_split(canonical_id, '_'), lambda w: upper(w[1]) || w[2:]), ' ')) AS display_name, instances, category,
  CASE WHEN category IN ('personnel', 'date') THEN 'ignore' ELSE 'exact_match' END AS consistency, CASE category {_roll} ELSE 'manual_only' END AS rollover,
  canonical_id = 'odd_gear' OR category IN ('car_identity', 'owner_identity') AS must_agree
FROM (SELECT *, CASE {_cases} ELSE 'other' END AS category FROM (
  SELECT regexp_replace(field_id, '_\d+$', '') AS canonical_id, count(*) AS instances, arg_min(label, struct_pack(n := -length(label), l := label)) FILTER (label <> '') AS longest FROM field_maps GROUP BY 1) WHERE instances >= 2)"""
ORACLES["cmp5_field_ontology"] = with_ctes("SELECT * FROM ontology")
QUERIES["cmp5_bindings"] = lambda spark, sf: compare.bindings(field_maps(spark, sf), compare.build_ontology(field_maps(spark, sf))).distinct()
ORACLES["cmp5_bindings"] = with_ctes(r"""
SELECT DISTINCT form_id, field_id, regexp_replace(field_id, '_\d+$', '') AS canonical_id FROM field_maps WHERE regexp_replace(field_id, '_\d+$', '') IN (SELECT canonical_id FROM ontology)""")


def governed(spark, sf):
    """Parts of a size are a packet, their brands its forms; the entities' rules say what must agree."""
    maps = field_maps(spark, sf)
    filled = maps.groupBy(F.col("p_size").alias("packet_id"), "form_id", "field_id").agg(F.min(F.substring_index("p_type", " ", 1)).alias("value"))
    return compare.consistency(filled, compare.governed_bindings(maps, compare.build_ontology(maps, ["odd_gear"])))


QUERIES["cmp4_governed_consistency"] = governed
ORACLES["cmp4_governed_consistency"] = with_ctes(r"""
WITH v AS (SELECT p_size AS packet_id, form_id, field_id, regexp_replace(field_id, '_\d+$', '') AS canonical_id, min(string_split(p_type, ' ')[1]) AS value FROM field_maps GROUP BY ALL),
f AS (SELECT packet_id, canonical_id, consistency AS mode, form_id, arg_max(value, field_id) AS value FROM v JOIN ontology USING (canonical_id) WHERE consistency <> 'ignore' GROUP BY ALL)
SELECT packet_id, canonical_id, mode, forms, agrees, CASE WHEN NOT agrees THEN 'error' END AS severity
FROM (SELECT packet_id, canonical_id, mode, count(*) AS forms, count(DISTINCT value) = 1 AS agrees FROM f GROUP BY ALL) WHERE forms >= 2""")


def map_check(spark, sf):
    """Each part is a form: two mapped cells, a manifest with drift, and its grid row."""
    k = F.col("p_partkey")
    part = table(spark, sf, "part")
    form = k.cast("string").alias("form_id")

    def rows(second_row, second_col, extra=None):
        return part.select(form, F.inline(F.array(
            F.struct(F.lit("name").alias("field_id"), F.lit(0).alias("tbl"), F.lit(1).alias("row"), F.lit(0).alias("col")),
            F.struct(F.lit("size").alias("field_id"), F.lit(0).alias("tbl"), second_row.cast("int").alias("row"), second_col.cast("int").alias("col")))))

    field_map = rows(F.when(k % 11 == 0, 9).otherwise(1), F.when(k % 5 == 0, 0).otherwise(1))
    manifest = rows(F.when(k % 11 == 0, 9).otherwise(1), F.when(k % 7 == 0, 3).when(k % 5 == 0, 0).otherwise(1)).where("not (field_id = 'name' and form_id like '%3')")
    manifest = manifest.unionByName(part.where("p_partkey % 13 = 0").select(form, F.lit("ghost").alias("field_id"), F.lit(0).alias("tbl"), F.lit(0).alias("row"), F.lit(0).alias("col")))
    grid = inputs.grid(spark, sf).where("tbl = 0").select(F.col("doc").cast("string").alias("form_id"), "tbl", "row", "col", "span")
    return compare.validate_map(field_map, manifest, grid)


QUERIES["cmp6_map_issues"] = map_check
ORACLES["cmp6_map_issues"] = with_ctes("""
WITH m AS (SELECT p_partkey AS k, p_partkey || '' AS form_id, f AS field_id, CASE WHEN f = 'size' AND p_partkey % 11 = 0 THEN 9 ELSE 1 END AS row, CASE WHEN f = 'size' AND p_partkey % 5 <> 0 THEN 1 ELSE 0 END AS col
  FROM part, (VALUES ('name'), ('size')) v(f)),
n AS (SELECT k, form_id, field_id, row, CASE WHEN field_id = 'size' AND k % 7 = 0 THEN 3 ELSE col END AS col FROM m WHERE NOT (field_id = 'name' AND form_id LIKE '%3')
  UNION ALL SELECT p_partkey, p_partkey || '', 'ghost', 0, 0 FROM part WHERE p_partkey % 13 = 0),
i AS (SELECT m.*, g.col AS start FROM m JOIN grid g ON g.doc = m.k AND g.tbl = 0 AND g.row = m.row AND g.col <= m.col AND m.col < g.col + g.span)
SELECT form_id, field_id, 'duplicate_coordinate' AS issue FROM (SELECT *, count(*) OVER (PARTITION BY form_id, row, col) AS c FROM m) WHERE c > 1
UNION ALL SELECT form_id, field_id, 'duplicate_physical_cell' FROM (SELECT *, min(col) OVER w AS a, max(col) OVER w AS b FROM i WINDOW w AS (PARTITION BY form_id, row, start)) WHERE a <> b
UNION ALL SELECT form_id, field_id, 'outside_grid' FROM m WHERE NOT EXISTS (SELECT 1 FROM i WHERE i.k = m.k AND i.field_id = m.field_id)
UNION ALL SELECT form_id, field_id, CASE WHEN n.k IS NULL THEN 'missing_from_manifest' WHEN m.k IS NULL THEN 'not_in_map' ELSE 'manifest_mismatch' END
FROM m FULL JOIN n USING (form_id, field_id) WHERE n.k IS NULL OR m.k IS NULL OR m.row <> n.row OR m.col <> n.col""")


def id_hints(spark, sf):
    known = table(spark, sf, "part").select(F.concat(F.initcap(F.split("p_name", " ")[1]), F.lit("_"), "p_type").alias("id"))
    asked = table(spark, sf, "part").select(F.when(F.col("p_partkey") % 3 == 0, F.split("p_name", " ")[1]).when(F.col("p_partkey") % 3 == 1, F.lower(F.concat(F.split("p_name", " ")[1], F.lit("_"), "p_type")))
                                            .otherwise(F.col("p_name")).alias("id"))
    return compare.suggest_ids(asked, known)


QUERIES["cmp6_id_suggestions"] = id_hints
ORACLES["cmp6_id_suggestions"] = """
WITH p AS (SELECT *, string_split(p_name, ' ')[2] AS w FROM part), k AS (SELECT DISTINCT upper(w[1]) || w[2:] || '_' || p_type AS known FROM p),
a AS (SELECT DISTINCT CASE p_partkey % 3 WHEN 0 THEN w WHEN 1 THEN lower(w || '_' || p_type) ELSE p_name END AS id FROM p)
SELECT id, (SELECT known FROM k WHERE lower(known) = lower(id) OR starts_with(lower(known), lower(id) || '_') ORDER BY lower(known) <> lower(id), known LIMIT 1) AS suggestion FROM a WHERE id NOT IN (SELECT known FROM k)"""


def id_lists(spark, sf):
    lists = table(spark, sf, "orders").select("o_orderkey", F.concat_ws(", ", F.lit(" a-1"), "o_orderstatus", F.lit(""), F.concat(F.lit("b  2"))).alias("ids"))
    return compare.normalize_ids(lists, "ids", {"A_1": "ALPHA", "B 2": "BETA", "F": "FINAL"}).select("o_orderkey", "form_id")


QUERIES["cmp6_id_lists"] = id_lists
ORACLES["cmp6_id_lists"] = """
SELECT o_orderkey, 'ALPHA' AS form_id FROM orders UNION ALL SELECT o_orderkey, 'BETA' FROM orders UNION ALL SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'FINAL' ELSE o_orderstatus END FROM orders"""

QUERIES["cmp7_structure_drift"] = lambda spark, sf: compare.structure_drift(inputs.grid(spark, sf), inputs.grid_after(spark, sf))
CTES["drift"] = """
SELECT *, tables_added + tables_removed + rows_added + rows_removed + cells_added + cells_removed = 0 AS passed FROM (
  SELECT doc, 0::BIGINT AS tables_added, 0::BIGINT AS tables_removed, 0::BIGINT AS rows_added, count(*) FILTER (gone) AS rows_removed, 0::BIGINT AS cells_added, CAST(sum(CASE WHEN gone THEN n ELSE 0 END) AS BIGINT) AS cells_removed
  FROM (SELECT doc, tbl, row, count(*) AS n, doc % 17 = 0 AND row = 1 AS gone FROM grid GROUP BY ALL) GROUP BY doc)"""
ORACLES["cmp7_structure_drift"] = with_ctes("SELECT * FROM drift")


def header_prints(spark, sf, grid=None):
    return compare.fingerprints(inputs.grid(spark, sf) if grid is None else grid)


QUERIES["cmp8_fingerprints"] = header_prints
CTES["prints"] = """
SELECT doc, tbl, CAST(rows AS INTEGER) AS rows, headers, left(sha256(headers), 16) AS digest FROM (
  SELECT g.doc, g.tbl, any_value(g.rows) AS rows, coalesce('[' || string_agg(h.line, ',' ORDER BY h.row) || ']', '[]') AS headers
  FROM (SELECT doc, tbl, max(row) + 1 AS rows FROM grid GROUP BY ALL) g
  LEFT JOIN (SELECT doc, tbl, row, '[' || string_agg('"' || trim(regexp_replace(text, '\\s+', ' ', 'g')) || '"', ',' ORDER BY col) || ']' AS line FROM grid WHERE row < 3 GROUP BY ALL HAVING bool_or(trim(text) <> '')) h
    ON h.doc = g.doc AND h.tbl = g.tbl GROUP BY g.doc, g.tbl)"""
ORACLES["cmp8_fingerprints"] = with_ctes("SELECT * FROM prints")


def print_check(spark, sf, grid=None):
    actual = header_prints(spark, sf, grid).select(F.when(F.col("doc") < 1000000, F.concat(F.lit("P"), (F.col("doc") % 6).cast("string"))).otherwise("R").alias("form_id"), "doc", "tbl", "digest")
    expected = actual.where("doc < 1000000 and doc % 6 < 4 and tbl = 0").groupBy("form_id", "tbl").agg(F.min_by("digest", "doc").alias("digest")).where("form_id <> 'P3'").unionByName(
        actual.where("form_id = 'P3'").groupBy("form_id").agg(F.lit(7).alias("tbl"), F.min("digest").alias("digest")).select("form_id", "tbl", "digest"))
    return compare.compare_fingerprints(actual, expected, ["form_id", "tbl"])


QUERIES["cmp8_fingerprint_status"] = print_check
CTES["print_status"] = """
SELECT a.form_id, a.doc, a.tbl, a.digest, e.want, CASE WHEN a.form_id IN ('P4', 'P5', 'R') THEN 'missing_expected' WHEN e.want IS NULL THEN 'extra_table' WHEN e.want = a.digest THEN 'match' ELSE 'drift' END AS status
FROM (SELECT *, CASE WHEN doc < 1000000 THEN 'P' || (doc % 6) ELSE 'R' END AS form_id FROM prints) a
LEFT JOIN (SELECT 'P' || (doc % 6) AS form_id, arg_min(digest, doc) AS want FROM prints WHERE doc < 1000000 AND doc % 6 < 3 GROUP BY 1) e USING (form_id)"""
ORACLES["cmp8_fingerprint_status"] = with_ctes("SELECT * REPLACE (CAST(tbl AS INTEGER) AS tbl) FROM print_status")

QUERIES["cmp9_cell_issues"] = lambda spark, sf: compare.cell_issues(inputs.grid(spark, sf))
CTES["cell_issues"] = rf"""
WITH c AS (SELECT doc, tbl, row, col, trim(regexp_replace(text, '[ \t]{{2,}}', ' ', 'g'), ' |') AS text FROM grid),
h AS (SELECT doc, tbl, col, string_agg(text, ' | ' ORDER BY row) AS header FROM c WHERE row < 4 AND text <> '' GROUP BY ALL),
g AS (SELECT DISTINCT doc, tbl FROM (SELECT doc, tbl, row, lower(string_agg(text, ' ')) AS t FROM c WHERE row <= 1 GROUP BY ALL) WHERE regexp_matches(t, 'equipment|calibration|measure') AND regexp_matches(t, 'id|date|due')),
b AS (SELECT c.*, coalesce(header, '') AS header, g.doc IS NOT NULL AS gear, len(regexp_extract_all(text, '{rules.DATE_TOKEN}')) AS dates FROM c LEFT JOIN h ON h.doc = c.doc AND h.tbl = c.tbl AND h.col = c.col LEFT JOIN g ON g.doc = c.doc AND g.tbl = c.tbl WHERE row >= 1 AND text <> '')
SELECT doc, tbl, row, col, 'pipe_delimited_spill' AS code FROM b WHERE text LIKE '%|%' AND len(list_filter(string_split(text, '|'), lambda x: trim(x) <> '')) >= 2
UNION ALL SELECT doc, tbl, row, col, 'date_in_id_column' FROM b WHERE regexp_matches(header, '(?i)\b(?:id|serial|gauge|equipment)\b') AND dates >= 2
UNION ALL SELECT doc, tbl, row, col, 'id_in_date_column' FROM b WHERE regexp_matches(header, '(?i)\b(?:date|due|calibration|qualified|expires|expiration|approved)\b') AND regexp_matches(text, '(?i)\bU\d{{6,}}\b')
UNION ALL SELECT doc, tbl, row, col, 'equipment_cell_overflow' FROM b WHERE gear AND length(text) > 180
UNION ALL SELECT doc, tbl, row, min(col), 'duplicate_across_columns' FROM b WHERE length(text) >= 4 GROUP BY doc, tbl, row, lower(text)
  HAVING count(*) >= 3 OR (count(*) >= 2 AND (lower(text) LIKE '%|%' OR length(lower(text)) > 60 OR len(regexp_extract_all(lower(text), '{rules.DATE_TOKEN}')) >= 2))"""
ORACLES["cmp9_cell_issues"] = with_ctes("SELECT doc, CAST(tbl AS INTEGER) AS tbl, CAST(row AS INTEGER) AS row, CAST(col AS INTEGER) AS col, code FROM cell_issues")


def dated_docs(spark, sf):
    d = F.col("doc_id")
    docs = table(spark, sf, "documents").select(F.concat(F.lit("d"), d.cast("string")).alias("doc"), F.concat(
        "text", F.lit(" due 2024-0"), (d % 9 + 1).cast("string"), F.lit("-15 or "), (d % 12 + 1).cast("string"), F.lit("/2023, not 3/"), (d % 12 + 1).cast("string"), F.lit("/2022 or 12/20245 ")).alias("text"))
    talks = table(spark, sf, "conversations").select(F.concat(F.lit("c"), F.col("conv_id").cast("string"), F.lit("-"), F.col("turn").cast("string")).alias("doc"), "text")
    return docs.unionByName(talks)


QUERIES["cmp10_date_tokens"] = lambda spark, sf: compare.date_tokens(dated_docs(spark, sf), ["doc"])
ORACLES["cmp10_date_tokens"] = r"""
WITH d AS (SELECT 'd' || doc_id AS doc, text || ' due 2024-0' || (doc_id % 9 + 1) || '-15 or ' || (doc_id % 12 + 1) || '/2023, not 3/' || (doc_id % 12 + 1) || '/2022 or 12/20245 ' AS text FROM documents
  UNION ALL SELECT 'c' || conv_id || '-' || turn, text FROM conversations)
SELECT doc, 'iso_date_in_body' AS code, unnest(regexp_extract_all(text, '\b\d{4}-\d{2}-\d{2}\b')) AS token FROM d
UNION ALL SELECT doc, 'month_year_only', unnest(regexp_extract_all(regexp_replace(text, '\d/\d{1,2}/\d{4}', '#', 'g'), '\b\d{1,2}/\d{4}\b')) FROM d"""

QUERIES["cmp11_date_order"] = lambda spark, sf: compare.date_order(inputs.grid(spark, sf))
CTES["late_days"] = r"""
SELECT doc, CAST(tbl AS INTEGER) AS tbl, CAST(row AS INTEGER) AS row, a AS first_day, b AS last_day FROM (
  SELECT doc, tbl, row, count(*) AS n, arg_min(day, col) AS a, arg_max(day, col) AS b
  FROM (SELECT *, CAST(try_strptime(regexp_replace(nullif(regexp_extract(text, '\b(\d{1,2}/\d{1,2}/\d{2,4})\b', 1), ''), '/(\d\d)$', '/20\1'), '%m/%d/%Y') AS DATE) AS day FROM grid) WHERE day IS NOT NULL GROUP BY ALL) WHERE n >= 2 AND a > b"""
ORACLES["cmp11_date_order"] = with_ctes("SELECT * FROM late_days")


def summary(spark, sf):
    # eight steps read the grid, whose lines are numbered by a shuffle of all order lines
    grid = stage(spark, sf, "grid", lambda: inputs.grid(spark, sf))
    return compare.validation_summary(compare.structure_drift(grid, inputs.lost_rows(grid)), compare.cell_issues(grid),
                                      compare.date_tokens(grid, ["doc"]), print_check(spark, sf, grid), grid,
                                      compare.date_order(grid), grid.where("text like '%|%' or text <> trim(text)"),
                                      staged_ledger(spark, sf).where("decision = 'conflict'").select(F.col("packet_id").alias("doc")))


QUERIES["cmp12_validation_summary"] = summary
ORACLES["cmp12_validation_summary"] = with_ctes(r"""
SELECT *, layout_integrity_warnings + cell_boundary_issues + date_format_issues + fingerprint_drift_tables + unresolved_conflicts = 0 AS passed FROM (
  SELECT doc, (SELECT count(*) FROM drift x WHERE x.doc = d.doc AND NOT passed) AS layout_integrity_warnings, coalesce(c.n, 0) AS cell_boundary_issues,
    coalesce(t.n, 0) AS date_format_issues, (SELECT count(*) FROM print_status x WHERE x.doc = d.doc AND status = 'drift') AS fingerprint_drift_tables,
    (SELECT count(*) FROM own_guarded x WHERE x.packet_id = d.doc AND decision = 'conflict') AS unresolved_conflicts,
    (SELECT count(*) FROM late_days x WHERE x.doc = d.doc) AS flagged_only_inconsistencies,
    (SELECT count(*) FROM grid x WHERE x.doc = d.doc AND (text LIKE '%|%' OR text <> trim(text))) AS typo_fixes_applied
  FROM (SELECT DISTINCT doc FROM grid) d LEFT JOIN (SELECT doc, count(*) AS n FROM cell_issues GROUP BY 1) c USING (doc)
  LEFT JOIN (SELECT doc, CAST(sum(len(regexp_extract_all(text, '\b\d{4}-\d{2}-\d{2}\b')) + len(regexp_extract_all(regexp_replace(text, '\d/\d{1,2}/\d{4}', '#', 'g'), '\b\d{1,2}/\d{4}\b'))) AS BIGINT) AS n FROM grid GROUP BY 1) t USING (doc))""")


def coverage(spark, sf):
    lines = table(spark, sf, "documents").select(F.col("doc_id").alias("doc"), F.explode(F.split("text", "\n")).alias("page_text"))
    return compare.covered_by(lines.where("doc % 2 = 1"), lines.where("doc % 2 = 0"))


QUERIES["cmp13_full_coverage"] = coverage
ORACLES["cmp13_full_coverage"] = """
WITH l AS (SELECT doc_id AS doc, sha256(lower(trim(unnest(string_split(text, chr(10)))))) AS p FROM documents)
SELECT doc, count(*) AS pages, count(*) FILTER (hit) AS covered, bool_and(hit) AS redundant
FROM (SELECT doc, p IN (SELECT p FROM l WHERE doc % 2 = 0) AS hit FROM l WHERE doc % 2 = 1) GROUP BY doc"""
