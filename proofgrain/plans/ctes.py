"""The derived inputs in SQL, as named CTEs for the DuckDB checks.

``with_ctes(sql)`` puts the CTEs a statement needs (and what those need) in front of it.
"""

from __future__ import annotations

import re

from proofgrain.plans.inputs import FIELDS, ROLLOVER_DAY

CTES: dict[str, str] = {}


#: Large steps that several others read: computed once, so that plans do not hang on guesses
#: of their sizes.
STEPS = ("evidence_chunks", "candidates", "suggestions", "reviewed", "gaps", "far_gaps",
         *(f"{p}_{x}" for p in ("near", "far") for x in ("chunks", "cp", "df", "q", "c", "top")))


def with_ctes(sql: str) -> str:
    needed: set[str] = set()

    def visit(text: str) -> None:
        for name in CTES:
            if name not in needed and re.search(rf"\b{name}\b", text):
                needed.add(name)
                visit(CTES[name])

    visit(sql)
    # a CTE may only use CTEs defined before it, so definition order is a valid order
    parts = [f"{name} AS {'MATERIALIZED ' if name.startswith('gate_') or name in STEPS else ''}({CTES[name]})" for name in CTES if name in needed]
    if not parts:
        return sql
    own = sql.strip()
    joint = ",\n" + own[5:] if own.startswith("WITH ") else "\n" + own
    return "WITH RECURSIVE " + ",\n".join(parts) + joint


def pick(expr: str, *options: str) -> str:
    items = ", ".join("'" + o + "'" for o in options)
    return f"([{items}])[({expr}) % {len(options)} + 1]"


_fields = ", ".join(f"('{i}', '{n}', {o})" for i, n, o in FIELDS)

CTES["field_spec"] = f"""
SELECT r_name AS form_id, field_id, label, 0 AS tbl, ord // 2 AS row, ord % 2 AS col, ord,
  ord % 4 <> 3 AS required, ord % 3 = 0 AS na_allowed, ord = 7 AS never_write,
  (ord + r_regionkey) % 5 <> 0 AS authorised
FROM region, (VALUES {_fields}) f(field_id, label, ord)"""

CTES["na_policy"] = """
SELECT form_id, field_id, 'NA-' || ord AS policy_id FROM field_spec WHERE na_allowed AND ord <> 3"""

CTES["packets"] = """
SELECT c_custkey AS packet_id, r_name AS form_id, r_regionkey, c_name, c_mktsegment, c_acctbal, n_name
FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"""

CTES["evidence_chunks"] = """
SELECT packet_id, form_id, 'customers.csv' AS source_file, 'csv' AS source_type, 'c.' || packet_id AS chunk_id,
  CAST(NULL AS INTEGER) AS page,
  'Customer Name: ' || c_name || chr(10) || 'Market Segment: ' || c_mktsegment || chr(10) || 'Account Balance: '
    || CAST(CAST(c_acctbal AS DECIMAL(15,2)) AS VARCHAR) || chr(10) || 'Nation: ' || n_name AS text,
  form_id AS scope_hint
FROM packets
UNION ALL
SELECT packet_id, form_id, 'orders_' || (o_orderkey % 4) || '.csv',
  CASE WHEN o_orderkey % 5 = 0 THEN 'json' ELSE 'csv' END, 'o.' || o_orderkey,
  CASE WHEN o_orderkey % 2 = 0 THEN CAST(o_orderkey % 9 AS INTEGER) END,
  CASE WHEN o_custkey % 10 = 0 THEN 'Order ' || o_orderkey || ' came without details' ELSE
    CASE WHEN o_orderkey % 5 = 0 THEN 'order.status: ' WHEN o_orderkey % 6 = 1 THEN 'Status: ' ELSE 'Order Status: ' END
    || CASE WHEN o_custkey % 10 IN (1, 2, 3) THEN 'F' ELSE o_orderstatus END || chr(10)
    || CASE WHEN o_orderkey % 7 = 3 THEN 'Shipping / Order Priority (code): ' ELSE 'Order Priority: ' END
    || CASE WHEN o_custkey % 10 IN (1, 2, 3) THEN '5-LOW' ELSE o_orderpriority END || chr(10)
    || CASE WHEN o_orderkey % 8 = 2 THEN 'Date = ' ELSE 'Order Date: ' END
    || CASE WHEN o_custkey % 10 IN (1, 2, 3) THEN '1995-0' || (o_custkey % 9 + 1) || '-15' WHEN o_orderkey % 13 = 0 THEN 'pending' ELSE strftime(o_orderdate, '%Y-%m-%d') END END,
  CASE WHEN o_orderkey % 7 = 0 THEN NULL WHEN o_orderkey % 11 = 0 THEN other.r_name ELSE form_id END
FROM orders JOIN packets ON o_custkey = packet_id
JOIN region other ON (packets.r_regionkey + 1) % 5 = other.r_regionkey"""

CTES["label_documents"] = """
SELECT o_orderkey AS doc_id, 'Order Status: ' || o_orderstatus
  || CASE WHEN o_orderkey % 3 = 0 THEN chr(10) || 'Order Priority:' || chr(10) ELSE chr(10) || 'Order Priority: ' END
  || o_orderpriority
  || CASE WHEN o_orderkey % 4 = 0 THEN chr(10) || 'Order Status: X' ELSE chr(10) || 'free text without a pair' END
  || CASE WHEN o_orderkey % 6 = 0 THEN chr(10) || 'Order Priority:' || chr(10) || chr(10) || 'urgent handling' ELSE '' END
  || CASE WHEN o_orderkey % 5 = 0 THEN chr(10) || 'table_0_row_1: Order (Date) of the Car | ' ELSE chr(10) || 'Date: ' END
  || strftime(o_orderdate, '%Y-%m-%d')
  || CASE WHEN o_orderkey % 7 = 0 THEN chr(10) || 'Order Status: REVIEW_REQUIRED: order.status missing' ELSE '' END
  || CASE WHEN o_orderkey % 11 = 0 THEN chr(10) || 'Notes: ' || repeat('long text ', 20) ELSE '' END
  || CASE WHEN o_orderkey % 9 = 0 THEN chr(10) || 'Calibration Due: ' || strftime(o_orderdate, '%-m/%-d/%Y') ELSE '' END AS text
FROM orders"""

CTES["numbered_lines"] = """
SELECT *, row_number() OVER (PARTITION BY l_orderkey
  ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS rn
FROM lineitem"""

CTES["part_cells"] = """
SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 1 ELSE 0 END AS wide,
  CASE WHEN p_partkey % 7 = 0 THEN 1 ELSE 0 END AS merged, p_name, p_brand,
  CASE WHEN p_partkey % 4 = 0 THEN '' ELSE p_type END AS p_type, CAST(p_size AS VARCHAR) AS p_size
FROM part"""

CTES["register_cells"] = """
SELECT l_orderkey, rn, 'U' || lpad(CAST(l_partkey AS VARCHAR), 7, '0') AS tag,
  strftime(l_shipdate, '%-m/%-d/%Y') AS shown,
  strftime(l_shipdate + INTERVAL 365 DAY, '%-m/%-d/%Y') AS due, l_suppkey, l_linenumber, l_returnflag
FROM numbered_lines"""

CTES["grid"] = """
SELECT p_partkey AS doc, 0 AS tbl, 0 AS row, 0 AS col, 1 + wide AS span, 'Part Name' AS text FROM part_cells
UNION ALL SELECT p_partkey, 0, 0, 1 + wide, 1, 'Brand Code' FROM part_cells
UNION ALL SELECT p_partkey, 0, 0, 2 + wide, 1, 'Material Type' FROM part_cells
UNION ALL SELECT p_partkey, 0, 0, 3 + wide, 1, 'Part Size' FROM part_cells
UNION ALL SELECT p_partkey, 0, 1, 0, 1 + wide + merged, p_name FROM part_cells
UNION ALL SELECT p_partkey, 0, 1, 1 + wide + merged, 1, p_brand FROM part_cells
UNION ALL SELECT p_partkey, 0, 1, 2 + wide + merged, 1, p_type FROM part_cells
UNION ALL SELECT p_partkey, 0, 1, 3 + wide + merged, 1, p_size FROM part_cells
UNION ALL
SELECT k + 1000000, 1, 0, col, 1, text
FROM (SELECT DISTINCT l_orderkey AS k FROM lineitem),
     (VALUES (0, 'Equipment ID'), (1, 'Calibration Date'), (2, 'Due Date'), (3, 'Status')) h(col, text)
UNION ALL
SELECT l_orderkey + 1000000, 1, rn, 0, 1,
  CASE WHEN l_orderkey % 13 = 0 THEN tag || ' | ' || l_suppkey
       WHEN l_orderkey % 19 = 0 THEN tag || ' ' || shown || ' ' || due ELSE tag END FROM register_cells
UNION ALL
SELECT l_orderkey + 1000000, 1, rn, 1, 1,
  CASE WHEN l_orderkey % 23 = 0 THEN 'same text' WHEN l_orderkey % 17 = 0 THEN tag ELSE shown END FROM register_cells
UNION ALL
SELECT l_orderkey + 1000000, 1, rn, 2, 1,
  CASE WHEN l_orderkey % 23 = 0 THEN 'same text' WHEN l_linenumber = 6 THEN '1/1/1990' ELSE due END FROM register_cells
UNION ALL
SELECT l_orderkey + 1000000, 1, rn, 3, 1,
  CASE WHEN l_orderkey % 23 = 0 THEN 'Same Text' WHEN l_orderkey % 29 = 0 THEN repeat('overflow ', 25) ELSE l_returnflag END
FROM register_cells"""

CTES["grid_after"] = "SELECT * FROM grid WHERE NOT (doc % 17 = 0 AND row = 1)"

CTES["index_prev"] = """
SELECT CAST(doc_id AS VARCHAR) AS name, sha256(text) AS hash FROM documents WHERE doc_id % 10 <> 0"""
CTES["index_cur"] = """
SELECT CAST(doc_id AS VARCHAR) AS name, sha256(CASE WHEN doc_id % 7 = 0 THEN text || 'x' ELSE text END) AS hash
FROM documents WHERE doc_id % 10 <> 1"""


def _period(condition: str) -> str:
    return f"""
SELECT packet_id, u.field_id, u.label, u.value FROM (
  SELECT o_custkey AS packet_id, unnest([
    {{'field_id': 'order.status', 'label': 'Order Status', 'value': o_orderstatus}},
    {{'field_id': 'order.priority', 'label': 'Priority Auditor', 'value': o_orderpriority}},
    {{'field_id': 'order.date', 'label': 'Order Date', 'value': strftime(o_orderdate, '%Y-%m-%d')}}]) AS u
  FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn
        FROM orders WHERE {condition}) WHERE rn = 1)"""


CTES["old_values"] = _period(f"o_orderdate < TIMESTAMP '{ROLLOVER_DAY}'")
CTES["new_values"] = _period(f"o_orderdate >= TIMESTAMP '{ROLLOVER_DAY}'")

_s = "(l_orderkey + rn)"
CTES["run_records"] = f"""
SELECT l_orderkey AS run_id, l_orderkey || '-' || rn AS item,
  {pick(_s, 'exact', 'alias', 'Substring')} AS method,
  {pick(_s, 'current_run', 'current_run', 'current_run', 'prior_run')} AS coordinate_source,
  CASE {_s} % 5 WHEN 0 THEN ['Page', 'label'] WHEN 1 THEN ['form_version', 'label']
    ELSE ['form_version', 'section', 'label'] END AS keyed_by,
  {pick(_s, 'approved', 'approved', 'run_derived')} AS map_source,
  {_s} % 2 = 0 AS validated, 'order.status' AS source_field,
  CASE WHEN {_s} % 9 = 0 THEN 'order.date' ELSE 'order.status' END AS target_field,
  {pick('l_orderkey', 'New Work', 'rework', 'roll-over', 'Rollover', 'final review', '', 'CORRECTION')} AS mode,
  {pick('l_orderkey', 'blank', 'working form', 'blank')} AS started_from,
  CASE l_orderkey % 11 WHEN 0 THEN 'corrupted' WHEN 1 THEN 'because' END AS rebuild_reason,
  l_orderkey % 4 = 0 AS accepted_baseline, rn % 2 = 1 AS was_correct,
  CASE WHEN {_s} % 6 = 0 THEN '' ELSE l_returnflag END AS target_value,
  CASE WHEN {_s} % 3 = 0 THEN ['text'] ELSE ['text', 'table'] END AS surfaces,
  {_s} % 8 <> 0 AS environment_ok, {_s} % 2 = 1 AS asserted,
  {pick(_s, 'record', 'Master_List', 'report')} AS support,
  {pick('l_orderkey', 'DRAFT', 'final', 'draft')} AS status,
  {pick('rn', 'SIGNATURE_BLANK', 'TYPO')} AS finding_type,
  CASE WHEN l_orderkey % 5 <> 0 THEN CAST(l_linenumber AS VARCHAR) END AS requested,
  CAST(l_linenumber + CASE WHEN {_s} % 10 = 0 THEN 100 ELSE 0 END AS VARCHAR) AS delivered,
  {pick(_s, 'filesystem_walk', 'file_list', 'file_list', 'file_list')} AS snapshot_source
FROM numbered_lines"""

# ------------------------------------------------------------------ retrieval
TERM = r"[\p{L}\p{N}_]{2,}"
STOP_WORDS = (
    "the", "and", "of", "to", "in", "is", "that", "for", "it", "as", "was", "with", "be", "by", "on", "not", "he",
    "his", "but", "at", "are", "this", "have", "from", "or", "had", "an", "they", "which", "one", "you", "were",
    "her", "all", "she", "there", "would", "their", "we", "him", "been", "has", "when", "who", "will", "more", "no",
    "if", "out", "so", "said", "what", "up", "its", "about", "into", "than", "them", "can", "only", "other",
)
FORM_PHRASES = (
    ("G_1", "heit"), ("G_1", "keit ge"), ("G_1", "der"),
    ("S_1", "ción"), ("S_1", "mente"), ("S_1", "los la"),
    ("F_1", "ement"), ("F_1", "pour"), ("F_1", "aux"),
    ("E_1", "tion and"), ("E_1", "ing"), ("E_1", "the of"),
    ("Ü", "ü"), ("Ü", "öß"),
)
FORMS = ("G_1", "S_1", "F_1", "E_1", "Ü")

CTES["clean_docs"] = r"""
SELECT doc_id AS doc, regexp_replace(regexp_replace(text, '\n{3,}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g') AS c FROM documents"""
_STOP = r"""CASE WHEN {s} + 900 >= length(c) THEN length(c)
  WHEN substr(c, {s} + 1, 900) LIKE '%' || chr(10) || '%'
   AND length(regexp_replace(substr(c, {s} + 1, 900), '\n[^\n]*$', '')) > 200
  THEN {s} + length(regexp_replace(substr(c, {s} + 1, 900), '\n[^\n]*$', '')) ELSE {s} + 900 END"""
CTES["chunk_steps"] = f"""
SELECT doc, c, 0::BIGINT AS b, {_STOP.format(s='0::BIGINT')} AS e FROM clean_docs WHERE c <> ''
UNION ALL
SELECT doc, c, e AS b, {_STOP.format(s='e')} AS e FROM chunk_steps WHERE e < length(c)"""
CTES["chunks"] = r"""
SELECT doc, CAST(row_number() OVER (PARTITION BY doc ORDER BY b) AS INTEGER) AS chunk_id, CAST(b AS INTEGER) AS "start",
  CAST(e AS INTEGER) AS "end", t AS text,
  TRY_CAST(regexp_extract(t, '(?i)\[page\s+([0-9]+)\]', 1) AS INTEGER) AS page
FROM (SELECT *, regexp_replace(substr(c, b + 1, e - b), '^\s+|\s+$', '', 'g') AS t FROM chunk_steps) WHERE t <> ''"""
CTES["doc_files"] = """
SELECT doc_id AS doc, (['policy_', 'audit report ', 'log-', 'note_', 'misc_'])[doc_id % 5 + 1] || doc_id || '.txt' AS source_file,
  sha256(text) AS sha256 FROM documents"""


def tfidf_ctes(prefix: str, tokens: str, *, chunks: str = "chunks", asks: str = "SELECT item_id AS query, text AS query_text FROM benchmark",
               raw_tf: bool = False, max_features: int | None = None, fit: int = 0) -> None:
    """CTEs <prefix>_scores(query, doc, chunk_id, score, words)."""
    tf = "CAST(n AS DOUBLE)" if raw_tf else "n / CAST(len AS DOUBLE)"
    p = prefix
    CTES[f"{p}_ct"] = f"SELECT doc, chunk_id, w, len(w) AS len FROM (SELECT doc, chunk_id, {tokens.replace('@', 'text')} AS w FROM {chunks})"
    CTES[f"{p}_cp"] = f"SELECT doc, chunk_id, len, term, count(*) AS n FROM (SELECT doc, chunk_id, len, unnest(w) AS term FROM {p}_ct) GROUP BY ALL"
    CTES[f"{p}_qt"] = f"SELECT query, w, len(w) AS len FROM (SELECT query, {tokens.replace('@', 'query_text')} AS w FROM ({asks}))"
    CTES[f"{p}_qp"] = f"SELECT query, len, term, count(*) AS n FROM (SELECT query, len, unnest(w) AS term FROM {p}_qt) GROUP BY ALL"
    top = f"ORDER BY cf DESC, term LIMIT {max_features}" if max_features else ""
    CTES[f"{p}_df"] = f"SELECT term, count(*) AS df, sum(n) AS cf FROM {p}_cp GROUP BY term {top}"
    CTES[f"{p}_n"] = f"SELECT count(*) + {fit} AS nd FROM {chunks}"
    join = "JOIN" if max_features else "LEFT JOIN"
    CTES[f"{p}_q"] = (f"SELECT query, term, ln((1.0::DOUBLE + nd) / (1.0::DOUBLE + coalesce(df, 0) + {fit})) + 1.0::DOUBLE AS idf, {tf} AS tf "
                      f"FROM {p}_qp {join} {p}_df USING (term), {p}_n")
    CTES[f"{p}_c"] = (f"SELECT doc, chunk_id, term, {tf} AS tf, ln((1.0::DOUBLE + nd) / (1.0::DOUBLE + df)) + 1.0::DOUBLE AS idf "
                      f"FROM {p}_cp JOIN {p}_df USING (term), {p}_n")
    CTES[f"{p}_ss"] = f"SELECT doc, chunk_id, sum(tf * idf * tf * idf) AS ss FROM {p}_c GROUP BY ALL"
    CTES[f"{p}_qn"] = f"SELECT query, sqrt(sum(tf * idf * tf * idf)) AS qn FROM {p}_q GROUP BY ALL"
    CTES[f"{p}_dots"] = (f"SELECT query, doc, chunk_id, sum(c.tf * q.idf * q.tf * q.idf) AS dot, "
                         f"sum(c.tf * c.tf * (q.idf * q.idf - c.idf * c.idf)) AS shift, count(*) FILTER (length(term) > 1) AS words "
                         f"FROM {p}_c c JOIN {p}_q q USING (term) GROUP BY ALL")
    CTES[f"{p}_scores"] = (f"SELECT query, doc, chunk_id, round(dot / (sqrt(ss + {'shift' if fit else '0'}) * qn), 6) AS score, words "
                           f"FROM {p}_dots JOIN {p}_ss USING (doc, chunk_id) JOIN {p}_qn USING (query)")


TOKENS = "regexp_extract_all(lower(@), '[a-z0-9]+')"
WORDS = f"regexp_extract_all(lower(@), '{TERM}')"
_stop_list = "(" + ", ".join(f"'{w}'" for w in STOP_WORDS) + ")"
tfidf_ctes("base", TOKENS)
tfidf_ctes("capped", f"list_filter({WORDS}, lambda x: x NOT IN {_stop_list})", raw_tf=True, max_features=4096)
CTES["gram_chunks"] = f"SELECT doc, chunk_id, {WORDS.replace('@', 'text')} AS text FROM chunks"
CTES["gram_asks"] = f"SELECT item_id AS query, {WORDS.replace('@', 'text')} AS query_text FROM benchmark"
tfidf_ctes("gram", "list_concat(@, list_transform(generate_series(1, len(@) - 1), lambda i: @[i] || ' ' || @[i + 1]))",
           chunks="gram_chunks", asks="SELECT * FROM gram_asks", raw_tf=True, fit=1)
_forms = ", ".join(f"('{f}', '" + " ".join([p for g, p in FORM_PHRASES if g == f] + [f.replace("_", " "), f]) + "')" for f in FORMS)
CTES["form_asks"] = f"SELECT * FROM (VALUES {_forms}) v(query, query_text)"
tfidf_ctes("form", TOKENS, asks="SELECT * FROM form_asks")


def _topk(pairs: str) -> str:
    return f"""
SELECT query, doc, chunk_id, semantic_score, keyword_score,
  CASE WHEN max(semantic_score) OVER (PARTITION BY query) <= 0 THEN keyword_score ELSE combined END AS retrieval_score, rank,
  CASE WHEN max(semantic_score) OVER (PARTITION BY query) <= 0 THEN 'keyword_fallback' ELSE 'tfidf_cosine' END AS retrieval_method
FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query ORDER BY semantic_score DESC, keyword_score DESC, doc, chunk_id) AS INTEGER) AS rank
  FROM (SELECT *, CAST(round_even(semantic_score * 1000, 0) AS BIGINT) + 2 * keyword_score AS combined FROM ({pairs}))
  WHERE combined > 0) WHERE rank <= 8"""


CTES["text_hits"] = _topk("SELECT query, doc, chunk_id, score AS semantic_score, words AS keyword_score FROM base_scores")
_points = []
for _form in FORMS:
    _own = [f"CASE WHEN contains(t, '{p.lower()}') THEN 2 ELSE 0 END" for f, p in FORM_PHRASES if f == _form]
    _own += [f"CASE WHEN contains(t, '{x}') THEN 1 ELSE 0 END" for x in re.findall("[a-z0-9]+", _form.lower()) if len(x) > 1]
    _points.append(f"SELECT doc, chunk_id, '{_form}' AS query, CAST({' + '.join(_own)} AS BIGINT) AS kw FROM (SELECT doc, chunk_id, lower(text) AS t FROM chunks)")
CTES["phrase_scores"] = "SELECT * FROM (" + " UNION ALL ".join(_points) + ") WHERE kw > 0"
CTES["form_hits"] = _topk("""SELECT query, doc, chunk_id, coalesce(score, 0.0::DOUBLE) AS semantic_score, coalesce(kw, 0) AS keyword_score
  FROM form_scores FULL JOIN phrase_scores USING (query, doc, chunk_id)""")

CTES["requirements"] = """
SELECT item_id AS query, item_id * 2 + i AS req_id, array_to_string(w[i * 3 + 1 : i * 3 + 3], ' ') AS field_label,
  'Find evidence supporting ' || coalesce(w[8 + i], 'nothing') AS search_directive,
  (['number', 'date', 'narrative', 'boolean'])[(item_id + i) % 4 + 1] AS field_type,
  (item_id + i) % 3 <> 0 AS required, round((item_id % 10) / 10.0::DOUBLE, 1) AS mapping_confidence, item_id % 10 >= 2 AS can_auto_fill,
  (['fill_not_verified', 'leave_blank', 'use_default', 'use_best_effort'])[(item_id // 2 + i) % 4 + 1] AS fallback_behavior
FROM (SELECT item_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM benchmark), (VALUES (0), (1)) v(i)"""
CTES["reranked"] = r"""
SELECT query, req_id, doc, chunk_id, source_file, semantic_score, retrieval_score, directive_hits, rank,
  least(0.99::DOUBLE, greatest(0.35::DOUBLE, retrieval_score + 0.4::DOUBLE)) AS confidence,
  CASE WHEN regexp_matches(lower(source_file), 'policy|procedure') THEN 0.95::DOUBLE WHEN regexp_matches(lower(source_file), 'report|audit') THEN 0.85::DOUBLE
    WHEN regexp_matches(lower(source_file), 'log|record') THEN 0.75::DOUBLE ELSE 0.65::DOUBLE END AS authority, content, content_preview, chunk_hash
FROM (SELECT *, CAST(row_number() OVER (PARTITION BY req_id ORDER BY directive_hits DESC, semantic_score DESC, retrieval_score DESC, doc, chunk_id) AS INTEGER) AS rank
  FROM (SELECT h.query, r.req_id, h.doc, h.chunk_id, f.source_file, h.semantic_score, h.retrieval_score, sha256(c.text) AS chunk_hash,
      len(list_filter(list_distinct(regexp_extract_all(lower(r.search_directive || ' ' || r.field_label), '[a-z0-9]+')), lambda t: length(t) > 2 AND contains(lower(c.text), t))) AS directive_hits,
      trim(regexp_replace(c.text, '\s+', ' ', 'g')) AS content,
      CASE WHEN length(trim(regexp_replace(c.text, '\s+', ' ', 'g'))) <= 600 THEN trim(regexp_replace(c.text, '\s+', ' ', 'g'))
        ELSE left(trim(regexp_replace(c.text, '\s+', ' ', 'g')), 597) || '...' END AS content_preview
    FROM text_hits h JOIN requirements r USING (query) JOIN chunks c USING (doc, chunk_id) JOIN doc_files f USING (doc)))
WHERE rank <= 5"""


# ------------------------------------------------------------------ pairs
_key = lambda c: (
    "array_to_string(list_filter(string_split(trim(regexp_replace(regexp_replace(replace(replace(lower(" + c + "), '/', ' '), '&', ' and '), "
    r"'\([^)]*\)', ' ', 'g'), '[^a-z0-9]+', ' ', 'g')), ' '), lambda x: x <> '' AND x NOT IN "
    "('a','an','and','by','for','from','in','of','on','or','the','to','with','aar','tank','car')), ' ')")
_cell = lambda c: f"trim(regexp_replace({c}, '[ \\t]{{2,}}', ' ', 'g'), ' |')"

CTES["doc_lines"] = f"""
SELECT doc_id, i, lines[i] AS line, lines[i - 1] AS before FROM (
  SELECT doc_id, lines, unnest(generate_series(1, len(lines))) AS i FROM (
    SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda s: {_cell('s')}), lambda s: s <> '') AS lines
    FROM label_documents))"""
CTES["all_line_events"] = f"""
SELECT doc_id, i, NOT has_colon AS carry, CASE WHEN has_colon THEN {_key('label')} ELSE {_key('before_label')} END AS key,
  CASE WHEN has_colon THEN value ELSE line END AS value
FROM (SELECT *, contains(line, ':') AS has_colon, {_cell("regexp_extract(line, '^[^:]*:(.*)$', 1)")} AS value,
    {_cell("regexp_extract(before, '^[^:]*:(.*)$', 1)")} AS before_value,
    regexp_replace(regexp_extract(line, '^([^:]*):', 1), '^table_[0-9]+_row_[0-9]+\\s*', '') AS label,
    regexp_replace(regexp_extract(before, '^([^:]*):', 1), '^table_[0-9]+_row_[0-9]+\\s*', '') AS before_label FROM doc_lines)
WHERE (has_colon AND value <> '' AND value NOT LIKE 'REVIEW_REQUIRED%')
   OR (NOT has_colon AND contains(before, ':') AND before_value = '')"""
CTES["line_events"] = "SELECT * FROM all_line_events WHERE carry OR length(value) <= 160"
CTES["key_events"] = """
SELECT *, row_number() OVER (PARTITION BY doc_id, key ORDER BY i) AS n, count(*) OVER (PARTITION BY doc_id, key) AS total FROM line_events WHERE key <> ''"""
CTES["key_fold"] = """
SELECT doc_id, key, n, total, [value] AS bucket FROM key_events WHERE n = 1
UNION ALL
SELECT f.doc_id, f.key, e.n, f.total, CASE WHEN e.carry THEN list_append(f.bucket[1 : -2], f.bucket[-1] || ' ' || e.value)
  WHEN list_contains(f.bucket, e.value) THEN f.bucket ELSE list_append(f.bucket, e.value) END
FROM key_fold f JOIN key_events e ON e.doc_id = f.doc_id AND e.key = f.key AND e.n = f.n + 1"""
CTES["label_pairs"] = """
SELECT doc_id, key, bucket[i] AS value, CAST(i - 1 AS INTEGER) AS ord
FROM (SELECT doc_id, key, bucket, unnest(generate_series(1, len(bucket))) AS i FROM key_fold WHERE n = total)"""

CTES["strict_pairs"] = r"""
SELECT packet_id, form_id, source_file, source_type, chunk_id, page, scope_hint, string_split(text, chr(10))[1] AS source_text,
  CAST(i - 1 AS INTEGER) AS line_no, lower(trim(x.l)) AS label, trim(x.v) AS value
FROM (SELECT *, regexp_extract(string_split(text, chr(10))[i], '^\s*([A-Za-z0-9 _./()&\-#\[\]]+)[:=]\s*(.+?)\s*$', ['l', 'v']) AS x
  FROM (SELECT *, unnest(generate_series(1, len(string_split(text, chr(10))))) AS i FROM evidence_chunks))
WHERE trim(x.l) <> '' AND trim(x.v) <> ''"""

_words = "len(string_split(trim(regexp_replace(text, '\\s+', ' ', 'g')), ' '))"
_label_words = "|".join(__import__("proofgrain.functions.rules", fromlist=["rules"]).LABEL_WORDS)
CTES["grid_cells"] = rf"""
SELECT doc, tbl, row, col, span, text,
  text <> '' AND NOT regexp_full_match(text, '[0-9]{{1,2}}/[0-9]{{1,2}}/[0-9]{{2,4}}|[0-9]{{4}}-[0-9]{{1,2}}-[0-9]{{1,2}}')
  AND NOT regexp_full_match(text, '(?:DOT|AAR)\s*[0-9][A-Z0-9./-]{{3,}}|[A-Z]{{2,6}}\s*[- ]?\d{{3,8}}[A-Z]?')
  AND (text LIKE '%:' OR regexp_matches(lower(text), '{_label_words}')
    OR (regexp_matches(text, '[A-Z]') AND upper(text) = text AND {_words} <= 8 AND ({_words} > 1 OR length(text) > 8))) AS is_label,
  text <> '' AND (regexp_matches(text, '\b\d{{1,2}}[/-]\d{{1,2}}[/-]\d{{2,4}}\b|\b[A-Z]{{2,6}}\s*[- ]?\d{{3,8}}\b')
    OR regexp_matches(text, '(?i)\b\d+(?:\.\d+)?\s*(?:psi|psig|f|mils?|in|%)\b')
    OR (regexp_matches(text, '[a-z]') AND {_words} <= 12)) AS is_value
FROM (SELECT doc, tbl, row, col, span, {_cell('text')} AS text FROM grid)"""
CTES["grid_rows"] = """
SELECT doc, tbl, row, count(DISTINCT lower(text)) FILTER (text <> '') > 1
    AND sum(CASE WHEN is_label THEN span ELSE 0 END) >= greatest(1, sum(CASE WHEN text <> '' THEN span ELSE 0 END) // 3)
    AND sum(CASE WHEN is_label THEN span ELSE 0 END) >= sum(CASE WHEN is_value THEN span ELSE 0 END) AS label_row,
  count(*) FILTER (is_label) AS row_labels
FROM grid_cells GROUP BY ALL"""

# ------------------------------------------------------------------ ledger
ALIAS_RULES = (
    ("status", "order.status", "write_bridge", [], "low", "approved_alias_rule"),
    ("date", "order.date", "read_lookup", ["ASIA", "EUROPE"], "medium", "approved_alias_rule"),
    ("market_segment", "customer.segment", "write_bridge", ["AFRICA", "AMERICA"], "low", "approved_alias_rule"),
    ("order_priority", "order.priority", "write_bridge", ["EUROPE"], "low", "approved_alias_rule"),
)
CTES["alias_rules"] = "SELECT * FROM (VALUES " + ", ".join(
    f"('{a}', '{b}', '{c}', {d or '[]::VARCHAR[]'}, '{e}', '{f}')" for a, b, c, d, e, f in ALIAS_RULES) + ") v(from_key, field_id, direction, forms, risk, authority)"
CTES["field_keys"] = """
SELECT DISTINCT form_id, field_id, label, key FROM (
  SELECT form_id, field_id, label, unnest([field_id, lower(label), replace(field_id, '.', '_'), replace(field_id, '.', ' ')]) AS key FROM field_spec WHERE NOT never_write
  UNION ALL SELECT s.form_id, s.field_id, s.label, a.from_key FROM field_spec s JOIN alias_rules a ON a.field_id = s.field_id
    AND (len(a.forms) = 0 OR list_contains(a.forms, s.form_id)) WHERE NOT never_write)"""
_norm = lambda c: f"lower(regexp_replace({c}, '[^A-Za-z0-9]+', '', 'g'))"
CTES["label_matches"] = f"""
SELECT form_id, label, field_id, arg_min(key, struct_pack(s := -strength, k := key)) AS key, max(strength) AS strength,
  bool_or(contains(label, '.') AND l_norm <> '' AND len(list_filter(string_split(replace(field_id, '_', '.'), '.'),
    lambda w: w NOT IN ('', 'id', 'name', 'type', 'date', 'number', 'code') AND contains(l_norm, w))) = 0) AS dot_bad
FROM (SELECT l.form_id, l.label, l.l_norm, k.field_id, k.key,
    CASE WHEN l.label = lower(k.key) OR (l_norm <> '' AND k_norm <> '' AND (l_norm = k_norm
           OR (length(replace(l_norm, 'tco', '')) > 4 AND replace(l_norm, 'tco', '') = replace(k_norm, 'tco', ''))
           OR (length(replace(l_norm, 'lco', '')) > 4 AND replace(l_norm, 'lco', '') = replace(k_norm, 'lco', '')))) THEN 1.0::DOUBLE
         WHEN l_norm <> '' AND k_norm <> '' AND (contains(l_norm, k_norm) OR contains(k_norm, l_norm)) THEN 0.72::DOUBLE
         WHEN contains(l.label, lower(k.key)) OR contains(lower(k.key), l.label) THEN 0.7::DOUBLE END AS strength
  FROM (SELECT DISTINCT form_id, label, {_norm('label')} AS l_norm FROM strict_pairs) l
  JOIN (SELECT *, {_norm('key')} AS k_norm FROM field_keys) k ON k.form_id = l.form_id)
WHERE strength IS NOT NULL GROUP BY form_id, label, field_id"""


def _candidates(pairs: str) -> str:
    return r"""
SELECT packet_id, form_id, field_id, source_file, source_type, chunk_id, page, scope_hint, source_text, line_no, label, value,
  CASE WHEN not_date THEN least(s2, 0.45::DOUBLE) ELSE s2 END AS strength,
  CASE WHEN key <> field_id AND key <> own THEN key END AS alias_used
FROM (SELECT *, CASE WHEN source_type = 'json' THEN least(1.0::DOUBLE, s1 + 0.08::DOUBLE) ELSE s1 END AS s2
  FROM (SELECT p.*, m.field_id, m.key, lower(f.label) AS own, CASE WHEN dot_bad THEN least(strength, 0.45::DOUBLE) ELSE strength END AS s1,
      m.field_id LIKE '%date%' AND NOT regexp_matches(p.value, '^\s*(?:\d{1,2}/\d{1,2}/\d{2,4}|\d{4}-\d{2}-\d{2})(?:\s+\d{1,2}:\d{2}(?:\s*[AaPp][Mm])?)?\s*$') AS not_date
    FROM (""" + pairs + r""") p JOIN label_matches m ON m.form_id = p.form_id AND m.label = p.label
    JOIN field_spec f ON f.form_id = m.form_id AND f.field_id = m.field_id))"""


CTES["candidates"] = _candidates("SELECT * FROM strict_pairs WHERE scope_hint IS NULL OR scope_hint = form_id")
CTES["open_candidates"] = _candidates("SELECT * FROM strict_pairs")
CTES["multi_sources"] = """
SELECT packet_id, source_file FROM evidence_chunks GROUP BY 1, 2 HAVING count(DISTINCT scope_hint) >= 2"""
CTES["universe"] = """
SELECT packet_id, f.form_id, field_id FROM packets JOIN field_spec f USING (form_id) WHERE NOT never_write"""


def ledger_ctes(prefix: str, cands: str) -> None:
    """CTEs <prefix>_ledger and <prefix>_alternates."""
    p = prefix
    CTES[f"{p}_flag"] = f"""
SELECT c.*, m.source_file IS NOT NULL AS multi FROM {cands} c LEFT JOIN multi_sources m ON m.packet_id = c.packet_id AND m.source_file = c.source_file"""
    CTES[f"{p}_kept"] = f"""
SELECT * FROM (SELECT *, max(strength) FILTER (NOT multi) OVER w AS single, max(strength) OVER w AS top FROM {p}_flag
  WINDOW w AS (PARTITION BY packet_id, form_id, field_id)) WHERE NOT multi OR single IS NULL OR single < top - 0.05::DOUBLE"""
    CTES[f"{p}_ranked"] = f"""
SELECT *, row_number() OVER (PARTITION BY packet_id, form_id, field_id, value ORDER BY strength DESC, source_file, chunk_id, line_no) AS rb,
  row_number() OVER (PARTITION BY packet_id, form_id, field_id, value ORDER BY source_file, chunk_id, line_no) AS rf FROM {p}_kept"""
    CTES[f"{p}_values"] = f"""
SELECT packet_id, form_id, field_id, value, max(strength) AS strength,
  max(CASE WHEN rb = 1 THEN struct_pack(source_file := source_file, source_type := source_type, page := page, chunk_id := chunk_id, source_text := source_text, scope := scope_hint, alias_used := alias_used) END) AS best,
  max(CASE WHEN rf = 1 THEN struct_pack(source_file := source_file, page := page, chunk_id := chunk_id, line_no := line_no) END) AS first,
  min(source_file) AS a, max(source_file) AS b, bool_and(multi) AS multi FROM {p}_ranked GROUP BY ALL"""
    CTES[f"{p}_order"] = f"""
SELECT *, row_number() OVER (w ORDER BY strength DESC, first.source_file, first.chunk_id, first.line_no, value) AS r, count(*) OVER w AS n,
  bool_and(multi) OVER w AS all_multi, min(a) OVER w = max(b) OVER w AS one_file FROM {p}_values WINDOW w AS (PARTITION BY packet_id, form_id, field_id)"""
    CTES[f"{p}_decided"] = f"""
SELECT t.packet_id, t.form_id, t.field_id, t.value, t.best.source_file AS source_file, t.best.source_type AS source_type, t.best.page AS page,
  t.best.chunk_id AS chunk_id, t.best.source_text AS source_text,
  CASE WHEN t.n = 1 OR (t.strength >= 0.75 AND s.strength <= 0.55) THEN least(0.95::DOUBLE, 0.6::DOUBLE + 0.35::DOUBLE * t.strength)
    WHEN t.all_multi OR t.one_file THEN 0.5::DOUBLE ELSE 0.55::DOUBLE END AS confidence,
  t.best.scope AS scope,
  CASE WHEN t.n = 1 THEN CASE WHEN least(0.95::DOUBLE, 0.6::DOUBLE + 0.35::DOUBLE * t.strength) >= 0.65 THEN 'usable' ELSE 'weak' END
    WHEN t.strength >= 0.75 AND s.strength <= 0.55 THEN 'usable' WHEN t.all_multi OR t.one_file THEN 'weak' ELSE 'conflict' END AS decision,
  t.best.alias_used AS alias_used, t.n - 1 AS n_alternates
FROM {p}_order t LEFT JOIN {p}_order s ON s.packet_id = t.packet_id AND s.form_id = t.form_id AND s.field_id = t.field_id AND s.r = 2
WHERE t.r = 1"""
    CTES[f"{p}_ledger"] = f"""
SELECT u.packet_id, u.form_id, u.field_id, value, source_file, source_type, page, chunk_id, source_text, coalesce(confidence, 0.0::DOUBLE) AS confidence,
  CASE WHEN decision IS NULL THEN string_split(u.field_id, '.')[1] ELSE scope END AS scope, coalesce(decision, 'missing') AS decision, alias_used,
  coalesce(n_alternates, 0) AS n_alternates
FROM universe u LEFT JOIN {p}_decided d ON d.packet_id = u.packet_id AND d.form_id = u.form_id AND d.field_id = u.field_id"""
    CTES[f"{p}_alternates"] = f"""
SELECT packet_id, form_id, field_id, value, first.source_file AS source_file, first.page AS page, first.chunk_id AS chunk_id FROM {p}_order WHERE r > 1"""
    CTES[f"{p}_guarded"] = f"""
SELECT packet_id, form_id, field_id, CASE WHEN NOT gone THEN value END AS value, source_file, source_type, page, chunk_id, source_text,
  CASE WHEN gone THEN 0.0::DOUBLE WHEN loose THEN least(confidence, CASE WHEN mixed THEN 0.5::DOUBLE ELSE 0.85::DOUBLE END) ELSE confidence END AS confidence, scope,
  CASE WHEN gone THEN 'out_of_scope' WHEN loose AND mixed AND decision = 'usable' THEN 'weak' ELSE decision END AS decision, alias_used,
  n_alternates + CASE WHEN gone THEN 1 ELSE 0 END AS n_alternates,
  CASE WHEN gone THEN value END AS rejected_value, CASE WHEN gone THEN 'cross_form_contamination' END AS rejected_reason
FROM (SELECT l.*, m.source_file IS NOT NULL AS mixed, value IS NOT NULL AND field_id <> 'customer.nation' AND scope IS NOT NULL AND scope <> form_id AS gone,
    value IS NOT NULL AND field_id <> 'customer.nation' AND scope IS NULL AND source_type <> 'json' AS loose
  FROM {p}_ledger l LEFT JOIN multi_sources m ON m.packet_id = l.packet_id AND m.source_file = l.source_file)"""


ledger_ctes("own", "candidates")
ledger_ctes("open", "open_candidates")
