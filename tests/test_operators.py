"""Operators on small literal fixtures, some against brute force."""

import math
import random
import re

import pytest
from pyspark.sql import functions as F

from proofgrain.operators import answers, compare, decide, ledger, match, pairs, quality, retrieve

FIELD = ["packet_id", "form_id", "field_id"]


def rows(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


# ------------------------------------------------------------------ text and retrieval
def test_chunks_cover_the_text_and_end_at_line_breaks(spark):
    rng = random.Random(1)
    text = "".join(rng.choice("abc \n") for _ in range(5000))
    docs = spark.createDataFrame([(1, text), (2, " \n "), (3, "short [page 7]")], "doc long, text string")
    out = retrieve.chunk_documents(docs, target=300).orderBy("doc", "chunk_id").collect()
    clean = re.sub(r"\n{3,}", "\n\n", text).strip()
    mine = [r for r in out if r.doc == 1]
    assert [r.chunk_id for r in mine] == list(range(1, len(mine) + 1))
    assert all(r.text == clean[r.start:r.end].strip() and r.end - r.start <= 300 for r in mine)
    assert not [r for r in out if r.doc == 2]
    assert [r.page for r in out if r.doc == 3] == [7]


@pytest.mark.parametrize("fit", [False, True])
def test_tfidf_equals_brute_force(spark, fit):
    rng = random.Random(2)
    words = ["alpha", "beta", "gamma", "delta", "x", "y9"]
    texts = [" ".join(rng.choices(words, k=rng.randint(1, 12))) for _ in range(20)]
    asked = ["alpha beta beta zeta", "y9", "nothing here"]
    chunks = spark.createDataFrame([(i, 1, t) for i, t in enumerate(texts)], "doc long, chunk_id int, text string")
    queries = spark.createDataFrame(list(enumerate(asked)), "query long, query_text string")
    got = {(r.query, r.doc): r.score for r in retrieve.tfidf_scores(chunks, queries, raw_tf=fit, fit_query=fit).collect()}
    want = {}
    for q, query in enumerate(asked):
        corpus = [t.split() for t in texts] + ([query.split()] if fit else [])

        def vec(tokens):
            n = 1 if fit else len(tokens)
            return {t: tokens.count(t) / n * (math.log((1 + len(corpus)) / (1 + sum(t in c for c in corpus))) + 1) for t in set(tokens)}

        a = vec(query.split())
        for d, text in enumerate(texts):
            b = vec(text.split())
            dot = sum(a[t] * b[t] for t in a.keys() & b.keys())
            if dot:
                want[q, d] = dot / math.sqrt(sum(v * v for v in a.values())) / math.sqrt(sum(v * v for v in b.values()))
    assert got.keys() == want.keys()
    assert all(abs(got[k] - want[k]) < 2e-6 for k in want)


def test_targeted_search_finds_a_value_or_marks_weak(spark):
    schema = "packet_id long, form_id string, field_id string, decision string, confidence double"
    gaps = spark.createDataFrame([(1, "F", "a", "missing", 0.0), (1, "F", "b", "weak", 0.4), (1, "F", "c", "usable", 0.9), (2, "F", "a", "missing", 0.0)], schema)
    chunks = spark.createDataFrame([
        (1, "s", "1", "intro words\nOwner Name: Dale Works\n", "F"), (1, "s", "2", "patch plate seen without a value", None),
        (1, "s", "3", "Owner Name: Foreign", "G"), (2, "s", "9", "Owner Name: Only Foreign", "G")],
        "packet_id long, source_file string, chunk_id string, text string, scope_hint string")
    terms = spark.createDataFrame([("F", "a", "Owner", ["Owner Name"]), ("F", "b", "Patch", ["patch plate"]), ("F", "c", "Owner", ["Owner Name"])],
                                  "form_id string, field_id string, label string, terms array<string>")
    out = rows(retrieve.targeted_search(gaps, chunks, terms), "packet_id", "field_id", "value", "chunk_id", "decision")
    assert out == [(1, "a", "Dale Works", "1", "usable"), (1, "b", None, "2", "weak"), (2, "a", "Only Foreign", "9", "usable")]


# ------------------------------------------------------------------ pairs and matching
def test_label_pairs_carry_and_deduplicate(spark):
    text = "Alpha: 1\nAlpha: 1\nAlpha:\nmore\nBeta:\n\nnext line\nGamma: REVIEW_REQUIRED: x\nfree\nTotal (sum): 9"
    out = rows(pairs.label_pairs(spark.createDataFrame([(1, text)], "doc_id long, text string")), "key", "value", "ord")
    assert out == [("alpha", "1 more", 0), ("beta", "next line", 0), ("total", "9", 0)]


def test_label_pairs_fold_equals_brute_force(spark):
    """Carried lines change what later values repeat; NFC joins both encodings of a word."""
    rng, texts = random.Random(8), []
    for _ in range(60):
        texts.append("\n".join(rng.choice(["P: x", "P: x y", "P:\ny", "P: z", "Q: x", "P:", "y", "Q:\nx"]) for _ in range(rng.randint(1, 14))))
    got = {}
    for r in pairs.label_pairs(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect():
        got.setdefault((r.doc_id, r.key), {})[r.ord] = r.value
    want = {}
    for i, text in enumerate(texts):
        waits = None
        for line in filter(None, text.split("\n")):
            label, colon, value = line.partition(":")
            key, value, carry = (label.lower(), value.strip(), False) if colon else (waits, line, True)
            waits = key if colon and not value else None
            if not key or not value:
                continue
            held = want.setdefault((i, key), [])
            if carry and held:
                held[-1] += " " + value
            elif value not in held:
                held.append(value)
    assert {k: [v[o] for o in sorted(v)] for k, v in got.items()} == want
    composed = spark.createDataFrame([(1, "Caf\u00e9: 1\nCafe\u0301: \u00e9t\u00e9\nCaf\u00e9: e\u0301te\u0301")], "doc_id long, text string")
    assert sorted(r.value for r in pairs.label_pairs(composed).collect()) == ["1", "\u00e9t\u00e9"]


def test_label_pairs_of_one_key_with_many_lines(spark):
    text = "\n".join(f"Date: {i % 70_000}" if i % 10 else "Date:\nmore" for i in range(100_000)) + "\nDate: " + "x" * 200
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    found = pairs.label_pairs(docs, keep_long=True).collect()
    assert sum(r.too_long for r in found) == 1 and sorted(r.ord for r in found if not r.too_long) == list(range(len(found) - 1))
    assert len(found) > 63_000 and pairs.label_pairs(docs).count() == len(found) - 1


def every_overlap(labels, keys, group, floor):
    """All pairs of labels and keys that share a token."""
    left = labels.withColumn("lt", F.array_distinct(F.split("l_key", " "))).withColumn("token", F.explode("lt"))
    right = keys.withColumn("kt", F.array_distinct(F.split("key", " "))).withColumn("token", F.explode("kt"))
    return left.join(right, [*group, "token"]).groupBy(*group, "label_id", "l_key", "key", "lt", "kt").agg(F.count("*").alias("n"))


def test_fuzzy_labels_equal_all_overlaps(spark, monkeypatch):
    rng = random.Random(6)
    words = ["date", "permission", "drawing", "number", "material", "thickness", "pitp", "approved", "status", "id", "code", "owner", "x1", "x2", "x3"]
    some = lambda most: " ".join(rng.sample(words, rng.randint(1, most)))
    labels = spark.createDataFrame([(i % 3, i, some(4)) for i in range(150)], "packet_id long, label_id int, label string")
    evidence = spark.createDataFrame([(i % 3, some(9), rng.choice(["1", "yes", "2024-01-02", "text here"]), i) for i in range(150)], "packet_id long, key string, value string, ord int")
    for floor in (0.38, 0.2, 0.6):
        got = sorted(map(tuple, match.fuzzy_labels(labels, evidence, (), floor=floor).collect()))
        with monkeypatch.context() as m:
            m.setattr(match, "overlapping", every_overlap)
            assert got == sorted(map(tuple, match.fuzzy_labels(labels, evidence, (), floor=floor).collect())) and len(got) > 50


def test_a_token_of_all_labels_never_joins(spark):
    def pairs_of(n):
        labels = spark.createDataFrame([(1, i, f"common a{i} b{i}") for i in range(n)] + [(1, n + i, f"common c{i}") for i in range(n)] + [(1, 2 * n, "common")], "g long, label_id int, l_key string")
        keys = spark.createDataFrame([(1, f"common a{i} d{i}") for i in range(n)] + [(1, f"common e{i}") for i in range(n)], "g long, key string")
        return match.overlapping(labels, keys, ["g"], 0.38).count()

    assert pairs_of(200) <= 200 * 4 and pairs_of(800) <= 800 * 4


def test_containment_equals_nested_loop(spark):
    rng = random.Random(3)
    words = ["".join(rng.choices("ab.", k=rng.randint(1, 6))) for _ in range(60)]
    n = spark.createDataFrame([(1, w) for w in set(words[:30])], "g int, needle string")
    h = spark.createDataFrame([(1, w) for w in set(words[30:])], "g int, hay string")
    got = rows(match.containment_pairs(n, h, ["g"], "needle", "hay"), "needle", "hay")
    assert got == sorted((a, b) for a in set(words[:30]) for b in set(words[30:]) if a in b)


def test_match_strengths(spark):
    fields = spark.createDataFrame([("F", "order.date", "Order Date", False), ("F", "pitp.id", "PITP ID", False)], "form_id string, field_id string, label string, never_write boolean")
    schema = "packet_id long, form_id string, source_file string, source_type string, chunk_id string, page int, scope_hint string, source_text string, line_no int, label string, value string"
    found = [("order date", "2024-01-02", "csv"), ("order date", "soon", "csv"), ("date", "2024-01-02", "json"), ("other.date", "2024-01-02", "csv"), ("tco order date", "2024-01-02", "csv")]
    p = spark.createDataFrame([(1, "F", "s", t, "c", None, None, "", i, label, v) for i, (label, v, t) in enumerate(found)], schema)
    got = {(r.label, r.value): round(r.strength, 2) for r in match.match_fields(fields, p).where("field_id = 'order.date'").collect()}
    assert got == {("order date", "2024-01-02"): 1.0, ("order date", "soon"): 0.45, ("date", "2024-01-02"): 0.8, ("tco order date", "2024-01-02"): 1.0}


def test_alias_rules_apply_in_order(spark):
    cands = spark.createDataFrame([(1, "F", "a", "va"), (1, "F", "d", "vd"), (2, "F", "b", "vb")], "packet_id long, form_id string, field_id string, value string")
    order = [("a", "b"), ("b", "c"), ("d", "c"), ("c", "e"), ("b", "a")]
    got = rows(match.expand_aliases(cands, order), *FIELD[::2], "value")
    want = []
    for packet in (1, 2):
        held = {r.field_id: r.value for r in cands.where(F.col("packet_id") == packet).collect()}
        for source, target in order:
            if source in held and target not in held:
                held[target] = held[source]
        want += [(packet, f, v) for f, v in held.items()]
    assert got == sorted(want)


def test_code_guard_rejects_other_forms(spark):
    hits = spark.createDataFrame([("B1", "s", "1", "car mark: AB-B2", 3, 1), ("B1", "s", "2", "car mark: AB-B1", 3, 2), ("B1", "s", "3", "car mark: AB-77", 3, 3)],
                                 "form_id string, source_file string, chunk_id string, text string, score int, rank int")
    out = pairs.extract_by_rules(hits, [(None, "car_mark", r"car mark: (\S+)")], code_pattern=r"\bB[12]\b", code_markers={"B1": ["B1"], "B2": ["B2"]}, code_fields=["car_mark"])
    assert rows(out, "value", "chunk_id") == [("AB-77", "3"), ("AB-B1", "2")]


# ------------------------------------------------------------------ ledger and decisions
def _cands(spark, items):
    schema = "packet_id long, form_id string, field_id string, value string, source_file string, source_type string, chunk_id string, page int, scope_hint string, source_text string, line_no int, strength double, alias_used string"
    return spark.createDataFrame([(1, "F", f, v, src, "csv", f"c{i}", None, "F", "", 0, s, None) for i, (f, v, src, s) in enumerate(items)], schema)


def test_best_candidate_and_conflicts(spark):
    c = _cands(spark, [("one", "x", "a", 1.0), ("clash", "x", "a", 1.0), ("clash", "y", "b", 0.72), ("clear", "x", "a", 1.0), ("clear", "y", "b", 0.45),
                       ("samefile", "x", "a", 1.0), ("samefile", "y", "a", 1.0), ("multi", "x", "m", 1.0), ("multi", "y", "a", 0.97)])
    multi = spark.createDataFrame([(1, "m")], "packet_id long, source_file string")
    universe = spark.createDataFrame([(1, "F", f) for f in ("one", "clash", "clear", "samefile", "multi", "none.x")], "packet_id long, form_id string, field_id string")
    entries, alternates = ledger.pick_best(c, multi, universe)
    got = {r.field_id: (r.value, r.decision, round(r.confidence, 4)) for r in entries.collect()}
    assert got == {"one": ("x", "usable", 0.95), "clash": ("x", "conflict", 0.55), "clear": ("x", "usable", 0.95), "samefile": ("x", "weak", 0.5),
                   "multi": ("y", "usable", 0.9395), "none.x": (None, "missing", 0.0)}
    assert rows(alternates, "field_id", "value") == [("clash", "y"), ("clear", "y"), ("samefile", "y")]


def test_eight_states(spark):
    fields = spark.createDataFrame([("F", f, f, need, never, auth) for f, need, never, auth in (
        ("fill", True, False, True), ("noauth", True, False, False), ("na", True, False, True), ("review", True, False, True), ("blank", False, False, True),
        ("weak", True, False, True), ("conflict", True, False, True), ("optconflict", False, False, True), ("foreign", True, False, True), ("never", True, True, True), ("due_date", True, False, True))],
        "form_id string, field_id string, label string, required boolean, never_write boolean, authorised boolean")
    entries = spark.createDataFrame([(1, "F", f, v, d, c, "s", None, "c", None, 1) for f, v, d, c in (
        ("fill", "x", "usable", 0.92), ("noauth", "x", "usable", 0.92), ("weak", "x", "weak", 0.35), ("conflict", "x", "conflict", 0.8), ("optconflict", "x", "conflict", 0.8),
        ("foreign", None, "out_of_scope", 0.0), ("never", "x", "usable", 0.9), ("due_date", "not a date", "usable", 0.9))],
        "packet_id long, form_id string, field_id string, value string, decision string, confidence double, source_file string, page int, chunk_id string, alias_used string, n_alternates long")
    packets = spark.createDataFrame([(1, "F")], "packet_id long, form_id string")
    na = spark.createDataFrame([(1, "F", "na")], "packet_id long, form_id string, field_id string")
    out = decide.decide_matrix(fields, entries, packets, na)
    assert {r.field_id: r.state for r in out.collect()} == {
        "fill": "FILL", "noauth": "BLOCKED_UNAUTHORIZED", "na": "APPROVED_NA", "review": "REVIEW_REQUIRED", "blank": "OPTIONAL_BLANK", "weak": "LOW_CONFIDENCE",
        "conflict": "CONFLICT", "optconflict": "OPTIONAL_BLANK", "foreign": "BLOCKED_NO_SOURCE", "never": "OPTIONAL_BLANK", "due_date": "LOW_CONFIDENCE"}
    # no fill without authority
    assert not out.where("state = 'FILL' and write_authority <> 'exact_approval_map'").count()


def test_a_clash_is_filled_with_a_reason(spark):
    cands = spark.createDataFrame([(1, "F", "a", "x", 0.9, 1), (1, "F", "a", "y", 0.95, 0)], "packet_id long, form_id string, field_id string, value string, confidence double, score int")
    need = spark.createDataFrame([(1, "F", "a"), (1, "F", "b")], "packet_id long, form_id string, field_id string")
    got = {r.field_id: r for r in decide.decide(need, cands).collect()}
    assert got["a"].state == "FILL" and got["a"].value == "y" and "conflicting" in got["a"].reason and got["a"].needs_review
    assert got["b"].value.startswith("REVIEW_REQUIRED: b") and got["b"].confidence == 1.0


# ------------------------------------------------------------------ comparison
def test_structure_drift_counts_unmatched_tables(spark):
    schema = "doc int, tbl int, row int, col int"
    before = spark.createDataFrame([(1, 0, 0, 0), (1, 0, 0, 1), (1, 1, 0, 0), (2, 0, 0, 0)], schema)
    after = spark.createDataFrame([(1, 0, 0, 0), (1, 0, 1, 0), (2, 0, 0, 0)], schema)
    got = {r.doc: r for r in compare.structure_drift(before, after).collect()}
    assert (got[1].tables_removed, got[1].rows_added, got[1].rows_removed, got[1].cells_added, got[1].cells_removed, got[1].passed) == (1, 1, 1, 1, 2, False)
    assert got[2].passed


def test_hot_page_does_not_hide_a_missing_one(spark):
    hot = [(1, "same")] * 500 + [(1, "only here")] + [(2, "same")] * 500
    c = spark.createDataFrame(hot, "doc int, page_text string")
    m = spark.createDataFrame([(9, " SAME ")], "doc int, page_text string")
    assert rows(compare.covered_by(c, m), "doc", "pages", "covered", "redundant") == [(1, 501, 500, False), (2, 500, 500, True)]


# ------------------------------------------------------------------ rule suite: bad must be found, good must not
def test_bad_and_good_records(spark):
    def n(df):
        return df.count()

    people = "table string, row int, name string, level string, method string"
    assert n(quality.check_personnel(spark.createDataFrame([("p", 1, "TechATechB", "IIII", "UTTVT")], people))) == 3
    assert n(quality.check_personnel(spark.createDataFrame([("p", 1, "TECH_A", "II", "UTT")], people))) == 0
    disp = "key string, disposition string, target_value string, sources_disagree boolean, low_confidence boolean"
    bad = spark.createDataFrame([("A", "POPULATED_VERIFIED", "", False, False), ("B", "UNEVALUATED", "", False, False), ("C", "BLANK_UNSUPPORTED", "", True, False), ("D", "POPULATED_VERIFIED", "v", False, True)], disp)
    good = spark.createDataFrame([("A", "POPULATED_VERIFIED", "v", False, False), ("C", "WITHHELD_FLAGGED_DISCREPANCY", "", True, True)], disp)
    assert n(quality.check_dispositions(bad)) == 2 and n(quality.check_conflicts(bad)) == 2
    assert n(quality.check_dispositions(good)) == 0 and n(quality.check_conflicts(good)) == 0
    cand = "key string, type string, value string, accepted boolean, via_fallback boolean, fallback_recorded boolean"
    assert n(quality.check_admissible(spark.createDataFrame([("E", "date", "l2//O3l2O24 ~", True, False, False), ("F", "identifier", "  ", True, True, False)], cand))) == 3
    assert n(quality.check_admissible(spark.createDataFrame([("E", "date", "12/03/2024", True, False, False), ("F", "identifier", "ID_C", True, True, True)], cand))) == 0
    clean = quality.release_gate(quality.check_dispositions(good))
    assert n(clean) == len(quality.rules.GATES) and all(r.ready for r in clean.collect())
    assert not any(r.ready for r in quality.release_gate(quality.check_dispositions(bad)).collect())


def test_strict_gate_fallbacks(spark):
    d = spark.createDataFrame([(1, True, 0.9, "ok", True, "leave_blank", None), (2, True, 0.5, "low", True, "leave_blank", None), (3, False, 0.9, "x", True, "use_default", "mm"),
                               (4, True, 0.9, "", True, "use_best_effort", None), (5, True, 0.9, "REVIEW_REQUIRED", True, "leave_blank", None)],
                              "req_id int, can_auto_fill boolean, confidence double, text string, required boolean, fallback_behavior string, expected_unit string")
    got = {r.req_id: (r.resolved, r.action, r.valid) for r in answers.validate_answers_strict(d).collect()}
    none = "Not verified in provided source documents."
    assert got == {1: ("ok", "accepted", True), 2: ("", "blanked", False), 3: ("0 mm", "modified_by_fallback", False), 4: (none, "modified_by_fallback", False), 5: (none, "modified_by_fallback", False)}


# ------------------------------------------------------------------ numbering
@pytest.mark.parametrize("parts", ["1", "7"])
def test_numbering_is_the_same_for_any_partitioning(spark, parts):
    from proofgrain.functions.ranking import number_repeats

    df = spark.createDataFrame([("hot", i) for i in range(300)] + [("two", 2), ("two", 1), ("single", 1)], "g string, o int").repartition(5)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        got = {(r.g, r.o): r.n for r in number_repeats(df, ["g"], ["o"]).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert got == {**{("hot", i): i + 1 for i in range(300)}, ("two", 1): 1, ("two", 2): 2}


def test_two_digit_years_lie_in_this_century(spark):
    from proofgrain.operators import compare

    cells = spark.createDataFrame([(1, 0, 0, 0, "5/5/2025"), (1, 0, 0, 1, "2/2/24"), (1, 0, 1, 0, "1/1/24"), (1, 0, 1, 1, "2/2/2024")], "doc int, tbl int, row int, col int, text string")
    assert [(r.row, str(r.first_day), str(r.last_day)) for r in compare.date_order(cells).collect()] == [(0, "2025-05-05", "2024-02-02")]


def test_wide_headers_enter_the_digest_whole(spark):
    from proofgrain.operators import compare

    def digest(last):
        cells = [(1, 0, 0, c, f"h{c}" if c < 29 else last) for c in range(30)]
        return compare.fingerprints(spark.createDataFrame(cells, "doc int, tbl int, row int, col int, text string")).first().digest

    assert digest("h29") != digest("other")


def test_tables_are_read_as_they_are_now(spark, tmp_path):
    from proofgrain.session import table

    spark.range(3).withColumnRenamed("id", "a").write.parquet(f"{tmp_path}/t.parquet")
    assert table(spark, str(tmp_path), "t").columns == ["a"]
    spark.range(3).withColumnRenamed("id", "b").write.mode("overwrite").parquet(f"{tmp_path}/t.parquet")
    assert sorted(r.b for r in table(spark, str(tmp_path), "t").collect()) == [0, 1, 2]


def test_whole_fractions_keep_their_form(spark):
    from proofgrain.sources import text

    df = spark.createDataFrame([(1, '{"a": 1.0, "b": 1, "c": 100.0, "d": 1.50, "e": true}')], "k int, j string")
    got = {r.section: r.value for r in text.flatten_json(df, "j", ["k"]).collect()}
    assert got == {"a": "1.0", "b": "1", "c": "100.0", "d": "1.5", "e": "True"}


def test_shape_of_office_files_and_guard_against_entities(spark):
    from proofgrain.plans.scratch import docx_bytes, docx_table_bytes, zip_bytes
    from proofgrain.sources import containers

    bomb = zip_bytes({"word/document.xml": b'<!DOCTYPE d [<!ENTITY a "aaaa">]><d>&a;</d>'})
    rows = [("a.docx", docx_bytes("one\ntwo")), ("b.docx", docx_table_bytes([[(1, "x"), (1, "y")]])), ("c.docx", bomb), ("d.txt", b"no")]
    df = spark.createDataFrame(rows, "name string, content binary")
    assert sorted(map(tuple, containers.extract_shape(df).collect())) == [("a.docx", 2, 0), ("b.docx", 2, 1), ("c.docx", 0, 0)]
    assert {r.source_file: r.method for r in containers.extract_container_text(df).collect()}["c.docx"] == "local_docx_failed:ParseError"


def test_combined_identity(spark):
    from proofgrain.operators import match

    rows = [(1, "f", "mark", "ABCX 1", 0.5), (1, "f", "number", "ABCX 123456", 0.6), (1, "f", "id", "old", 0.4), (2, "f", "mark", "XYZ 9", 0.5), (2, "f", "id", "", 0.99), (3, "f", "id", "stays", 0.1)]
    df = spark.createDataFrame(rows, "packet_id int, form_id string, field_id string, value string, confidence double")
    got = {(r.packet_id, r.field_id): (r.value, r.confidence) for r in match.combine_identity(df, "mark", "number", ["id"]).collect()}
    assert got[1, "id"] == ("ABCX 123456", 0.95)
    assert got[2, "id"][1] == 0.99 and got[2, "id"][0] and got[3, "id"] == ("stays", 0.1) and got[1, "mark"] == ("ABCX 1", 0.5)


def test_answers_read_whole_chunks(spark):
    filler = "All words of this part are the same and say nothing at all "
    text = (filler * 12)[:700] + "the load limit is 4711 " + filler * 3
    hits = spark.createDataFrame([(1, 1, "c1", "report.txt", text, 0.9, 0.9)], "query long, doc long, chunk_id string, source_file string, text string, semantic_score double, retrieval_score double")
    asked = spark.createDataFrame(
        [(1, 10, "load", "find load", "number", True, 0.9, True, "leave_blank"), (1, 11, "load", "find load", "narrative", True, 0.9, True, "leave_blank")],
        "query long, req_id long, field_label string, search_directive string, field_type string, required boolean, mapping_confidence double, can_auto_fill boolean, fallback_behavior string")
    ranked = retrieve.rerank(hits, asked)
    row = ranked.first()
    assert row.content == " ".join(text.split()) and len(row.content_preview) == 600
    made = {r.req_id: r for r in answers.answers(answers.bundle(asked, ranked)).collect()}
    assert made[10].text == made[10].shown == "4711"
    assert "4711" in made[11].text and len(made[11].shown) < len(made[11].text)
    long = answers.answers(answers.bundle(asked, ranked.withColumn("content", F.repeat("content", 4)))).withColumn("valid_place", F.lit(True))
    final = {r.req_id: r for r in answers.validate_answers(long).collect()}
    assert len(final[11].text) > 2000 and len(final[11].shown) == 2000


def test_fuzzy_labels_broadcast_no_labels_and_parse_once(spark):
    docs = spark.createDataFrame([(i, f"Order Status: v{i}\nOrder Date: 2024-01-0{i % 9 + 1}") for i in range(50)], "doc_id long, text string")
    evidence = pairs.label_pairs(docs).withColumn("packet_id", F.col("doc_id") % 5)
    labels = spark.range(5).select(F.col("id").alias("packet_id"), F.inline(F.array(*[
        F.struct(F.lit(i).alias("label_id"), F.lit(x).alias("label")) for i, x in enumerate(("Order Status", "Approved Order Status", "Status"))])))
    found = match.fuzzy_labels(labels, evidence, ())
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan and "MapInArrow" not in plan
    assert found.count() == 15
