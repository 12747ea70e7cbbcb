"""Queries over chunking and retrieval, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from proofgrain.functions import text as tx
from proofgrain.operators import retrieve
from proofgrain.plans.ctes import FORM_PHRASES, FORMS, STOP_WORDS, TERM, with_ctes
from proofgrain.session import cut_lineage, rule_table, table

QUERIES, ORACLES = {}, {}


def doc_chunks(spark, sf):
    return retrieve.chunk_documents(table(spark, sf, "documents").select(F.col("doc_id").alias("doc"), "text"))


def file_chunks(spark, sf, hits=None):
    """Chunks with the name and hash of their file; with ``hits``, those of their documents only."""
    d = F.col("doc_id")
    kind = F.element_at(F.array(*[F.lit(k) for k in ("policy_", "audit report ", "log-", "note_", "misc_")]), (d % 5 + 1).cast("int"))
    docs = table(spark, sf, "documents").select(
        d.alias("doc"), "text", F.concat(kind, d.cast("string"), F.lit(".txt")).alias("source_file"), F.sha2("text", 256).alias("sha256"))
    if hits is not None:
        docs = docs.join(hits.select("doc").distinct(), "doc", "left_semi")
    return retrieve.chunk_documents(docs, carry=("source_file", "sha256"))


def item_queries(spark, sf):
    return table(spark, sf, "benchmark").select(F.col("item_id").alias("query"), F.col("text").alias("query_text"))


def form_queries(spark):
    rows = [(f, " ".join([p for g, p in FORM_PHRASES if g == f] + [f.replace("_", " "), f])) for f in FORMS]
    return rule_table(spark, rows, "query string, query_text string")


def text_hits(spark, sf):
    scores = retrieve.tfidf_topk(doc_chunks(spark, sf), item_queries(spark, sf))
    return retrieve.hybrid_topk(retrieve.text_pairs(scores))


def requirements(spark, sf):
    item, i, w = F.col("item_id"), F.col("i"), F.col("w")

    def pick(value, *options):
        return F.element_at(F.array(*[F.lit(o) for o in options]), (value % len(options) + 1).cast("int"))

    return table(spark, sf, "benchmark").select(
        "item_id", tx.tokens(F.col("text")).alias("w"), F.explode(F.array(F.lit(0), F.lit(1))).alias("i")).select(
        item.alias("query"), (item * 2 + i).alias("req_id"),
        F.array_join(F.slice(w, i * 3 + 1, F.lit(3)), " ").alias("field_label"),
        F.concat(F.lit("Find evidence supporting "), F.coalesce(F.get(w, i + 7), F.lit("nothing"))).alias("search_directive"),
        pick(item + i, "number", "date", "narrative", "boolean").alias("field_type"),
        ((item + i) % 3 != 0).alias("required"),
        F.round((item % 10) / 10, 1).alias("mapping_confidence"),
        (item % 10 >= 2).alias("can_auto_fill"),
        pick(F.floor(item / 2) + i, "fill_not_verified", "leave_blank", "use_default", "use_best_effort").alias("fallback_behavior"),
    )


def reranked(spark, sf):
    hits = cut_lineage(text_hits(spark, sf))
    located = file_chunks(spark, sf, hits).join(hits, ["doc", "chunk_id"])
    return retrieve.rerank(located.withColumn("chunk_hash", F.sha2("text", 256)), requirements(spark, sf))


QUERIES["ret1_chunks"] = doc_chunks
ORACLES["ret1_chunks"] = with_ctes("SELECT * FROM chunks")

QUERIES["ret2_enriched_chunks"] = lambda spark, sf: retrieve.enrich_chunks(
    file_chunks(spark, sf), "2026-01-01T00:00:00+00:00").drop("text")
ORACLES["ret2_enriched_chunks"] = with_ctes(r"""
SELECT source_file, sha256 AS source_sha256, chunk_id, "start", "end", page, 'body' AS section, '2026-01-01T00:00:00+00:00' AS timestamp,
  sha256(text) AS chunk_hash, 1.0::DOUBLE AS confidence,
  CASE WHEN length(flat) <= 600 THEN flat ELSE left(flat, 597) || '...' END AS chunk_excerpt
FROM (SELECT *, trim(regexp_replace(text, '\s+', ' ', 'g')) AS flat FROM chunks) JOIN doc_files USING (doc)""")

QUERIES["ret3_tfidf_cosine"] = lambda spark, sf: retrieve.tfidf_scores(doc_chunks(spark, sf), item_queries(spark, sf))
ORACLES["ret3_tfidf_cosine"] = with_ctes("SELECT * FROM base_scores")

QUERIES["ret4_capped_tfidf"] = lambda spark, sf: retrieve.tfidf_scores(
    doc_chunks(spark, sf), item_queries(spark, sf), pattern=TERM, stopwords=STOP_WORDS, max_features=4096, raw_tf=True)
ORACLES["ret4_capped_tfidf"] = with_ctes("SELECT * FROM capped_scores")

QUERIES["ret4_ngram_tfidf"] = lambda spark, sf: retrieve.tfidf_scores(
    doc_chunks(spark, sf), item_queries(spark, sf), pattern=TERM, ngrams=2, raw_tf=True, fit_query=True)
ORACLES["ret4_ngram_tfidf"] = with_ctes("SELECT * FROM gram_scores")

TOP = """SELECT * EXCLUDE r FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, words DESC, doc, chunk_id) AS r
  FROM {} WHERE round_even(score * 1000, 0) > 0 OR words > 0) WHERE r <= 8"""
QUERIES["ret3_tfidf_topk"] = lambda spark, sf: retrieve.tfidf_topk(doc_chunks(spark, sf), item_queries(spark, sf))
ORACLES["ret3_tfidf_topk"] = with_ctes(TOP.format("base_scores"))

QUERIES["ret4_capped_topk"] = lambda spark, sf: retrieve.tfidf_topk(
    doc_chunks(spark, sf), item_queries(spark, sf), pattern=TERM, stopwords=STOP_WORDS, max_features=4096, raw_tf=True)
ORACLES["ret4_capped_topk"] = with_ctes(TOP.format("capped_scores"))

QUERIES["ret5_phrase_scores"] = lambda spark, sf: retrieve.phrase_scores(doc_chunks(spark, sf), FORM_PHRASES, FORMS)
ORACLES["ret5_phrase_scores"] = with_ctes("SELECT * FROM phrase_scores")

QUERIES["ret6_hybrid_topk"] = text_hits
ORACLES["ret6_hybrid_topk"] = with_ctes("SELECT * FROM text_hits")


def form_topk(spark, sf):
    chunks = doc_chunks(spark, sf)
    scores = retrieve.tfidf_scores(chunks, form_queries(spark))
    return retrieve.hybrid_topk(retrieve.form_pairs(scores, retrieve.phrase_scores(chunks, FORM_PHRASES, FORMS)))


QUERIES["ret6_form_topk"] = form_topk
ORACLES["ret6_form_topk"] = with_ctes("SELECT * FROM form_hits")

QUERIES["ret7_overlap_scores"] = lambda spark, sf: retrieve.overlap_scores(doc_chunks(spark, sf), item_queries(spark, sf))
OVERLAP = r"""
SELECT query, doc, chunk_id, round(count(*) / CAST(any_value(size) AS DOUBLE), 6) AS score
FROM (SELECT doc, chunk_id, unnest(list_distinct(regexp_extract_all(lower(text), '[a-z0-9_./-]+'))) AS term FROM chunks)
JOIN (SELECT item_id AS query, len(list_distinct(regexp_extract_all(lower(text), '[a-z0-9_./-]+'))) AS size,
        unnest(list_distinct(regexp_extract_all(lower(text), '[a-z0-9_./-]+'))) AS term FROM benchmark) USING (term)
GROUP BY query, doc, chunk_id"""
ORACLES["ret7_overlap_scores"] = with_ctes(OVERLAP)

QUERIES["ret7_overlap_topk"] = lambda spark, sf: retrieve.overlap_topk(doc_chunks(spark, sf), item_queries(spark, sf))
ORACLES["ret7_overlap_topk"] = with_ctes(f"""
SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query ORDER BY score DESC, doc, chunk_id) AS INTEGER) AS rank FROM ({OVERLAP})) WHERE rank <= 8""")

QUERIES["ret8_reranked_hits"] = reranked
ORACLES["ret8_reranked_hits"] = with_ctes("""
SELECT r.*, q.field_label, q.search_directive, q.field_type, q.required, q.mapping_confidence, q.can_auto_fill, q.fallback_behavior,
  h.keyword_score, h.retrieval_method, c."start", c."end", c.page, f.sha256
FROM reranked r JOIN requirements q USING (req_id) JOIN text_hits h ON h.query = r.query AND h.doc = r.doc AND h.chunk_id = r.chunk_id
JOIN chunks c ON c.doc = r.doc AND c.chunk_id = r.chunk_id JOIN doc_files f ON f.doc = r.doc""")


def gated(spark, sf):
    hits = cut_lineage(text_hits(spark, sf))
    located = file_chunks(spark, sf, hits).select("doc", "chunk_id", "text", "source_file").join(hits, ["doc", "chunk_id"]).select(
        "query", "source_file", "chunk_id", F.when(F.col("query") % 7 != 0, F.sha2("text", 256)).alias("chunk_hash"),
        F.least(F.lit(1.0), F.col("semantic_score") * 2).alias("confidence"))
    asked = item_queries(spark, sf)
    return retrieve.gated_answers(located).unionByName(retrieve.unanswered(asked, located))


QUERIES["ret10_gated_answers"] = gated
ORACLES["ret10_gated_answers"] = with_ctes("""
SELECT query, CASE WHEN best IS NULL OR query % 7 = 0 OR best < 0.7 THEN 'low' WHEN best >= 0.85 THEN 'high' ELSE 'medium' END AS tier,
  CASE WHEN best IS NULL THEN 'Evidence is insufficient to answer this question.'
    WHEN query % 7 = 0 THEN 'Evidence is insufficient because no citation-ready chunks were retrieved.'
    WHEN best >= 0.85 THEN 'Answer supported by high-confidence evidence.'
    WHEN best >= 0.7 THEN 'Answer is partially supported; reviewer caveat required.'
    ELSE 'Evidence is insufficient to provide a reliable answer.' END AS answer, best,
  CASE WHEN best IS NULL OR query % 7 = 0 THEN 0 ELSE n END AS citations
FROM (SELECT item_id AS query FROM benchmark) LEFT JOIN
  (SELECT query, max(least(1.0::DOUBLE, semantic_score * 2)) AS best, count(*) AS n FROM text_hits GROUP BY 1) USING (query)""")
