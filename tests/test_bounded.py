"""The k best by bounds against all scores, and how many pairs they make."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from proofgrain.functions import text as tx
from proofgrain.operators import bounded, retrieve


def corpus(spark, seed, n=400):
    """Chunks where some words are in nearly all; queries hold these and a few rare ones."""
    r = random.Random(seed)
    common, rare = ["the", "of", "and", "a"], [f"w{i}" for i in range(300)]
    chunks = [(i, 1, " ".join(r.choices(common, k=r.randint(1, 12)) + r.choices(rare, k=r.randint(0, 8)))) for i in range(n)]
    chunks += [(n + i, 2, chunks[i][2]) for i in range(40)] + [(9000, 1, ""), (9001, 1, None), (9002, 1, "x")]
    queries = [(i, " ".join(r.choices(common, k=6) + r.choices(rare, k=r.randint(0, 4)))) for i in range(30)] + [(90, None), (91, "nowhere"), (92, "a"), (93, "x")]
    return spark.createDataFrame(chunks, "doc long, chunk_id int, text string").repartition(4), spark.createDataFrame(queries, "query long, query_text string")


def top(df, k, *order):
    rank = F.row_number().over(Window.partitionBy("query").orderBy(*order, "doc", "chunk_id"))
    return sorted(map(tuple, df.withColumn("r", rank).where(F.col("r") <= k).drop("r", "rank").collect()))


@pytest.mark.parametrize("seed", [1, 2])
def test_topk_equals_the_best_of_all_scores(spark, seed, monkeypatch):
    chunks, queries = corpus(spark, seed)
    for looked_up in (1_000, 20):
        monkeypatch.setattr(bounded, "LOOKED_UP", looked_up)
        for options in ({}, {"raw_tf": True, "max_features": 100, "stopwords": ("of",)}):
            every = retrieve.tfidf_scores(chunks, queries, **options).where("bround(score * 1000) > 0 or words > 0")
            assert top(retrieve.tfidf_topk(chunks, queries, 5, **options), 5, F.desc("score"), F.desc("words")) == top(every, 5, F.desc("score"), F.desc("words"))
        every = retrieve.overlap_scores(chunks, queries)
        assert top(retrieve.overlap_topk(chunks, queries, 5), 5, F.desc("score")) == top(every, 5, F.desc("score"))
    assert retrieve.tfidf_topk(chunks.limit(0), queries).collect() == [] and retrieve.overlap_topk(chunks, queries.limit(0)).collect() == []


def test_common_terms_bring_in_no_rows(spark):
    """Half of a query's weight is in words that all rows hold; the rows that are scored follow
    from the rare words, so ten times as many rows add no candidates."""
    def pairs(n):
        rows = [(i, 1, "the", 0.3) for i in range(n)] + [(i, 1, f"r{i % 5}", 0.9) for i in range(50)]
        impacts = spark.createDataFrame(rows, "doc long, chunk_id int, term string, x double")
        asked = spark.createDataFrame([(q, t, w) for q in range(5) for t, w in (("the", 0.6), (f"r{q}", 0.8))], "query long, term string, weight double")
        found = bounded.candidates(impacts, asked, 8).collect()
        assert len({(r.query, r.doc) for r in found}) == len(found) and all(abs(r.total - 0.9) < 1e-9 and r.words == 2 for r in found)
        return len(found)

    assert pairs(500) == pairs(5_000) == 50


def test_terms_are_counted_inside_rows(spark):
    chunks, _ = corpus(spark, 3)
    counted = retrieve.counted_terms(chunks, ["doc", "chunk_id"], tx.tokens(F.col("text")))
    want = retrieve._postings(chunks, ["doc", "chunk_id"], tx.tokens(F.col("text")))
    assert sorted(map(tuple, counted.select(*want.columns).collect())) == sorted(map(tuple, want.collect()))
    plan = retrieve.counted_terms(spark.range(9).selectExpr("id doc", "'a b a' text"), ["doc"], tx.tokens(F.col("text")))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_scores_shuffle_no_text_and_chunks_leave_in_bounded_frames(spark, monkeypatch):
    docs = spark.range(300).selectExpr("id doc", "concat('word', id % 7, ' other', id % 3, ' rare', id) text")
    queries = spark.createDataFrame([(1, "word1 other2 rare5"), (2, "word3 nothing")], "query long, query_text string")
    chunks = retrieve.chunk_documents(docs)
    want = sorted(retrieve.tfidf_scores(chunks, queries).collect())
    # rare terms by their own way, and pairs dealt to many tasks
    monkeypatch.setattr(retrieve, "COMMON", 4)
    monkeypatch.setattr(retrieve, "PAIRS", 100)
    monkeypatch.setattr(retrieve, "MET", 100)
    scores = retrieve.tfidf_scores(chunks, queries)
    assert sorted(scores.collect()) == want and len(want) > 100
    plan = scores._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_NUM" in plan and "text#" not in plan and "MapIn" not in plan
    shared = retrieve.overlap_scores(chunks, queries)
    plan = shared._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_NUM" in plan and "text#" not in plan and shared.count() == len(want)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
    monkeypatch.setattr(retrieve, "AT_ONCE", 7)
    assert chunks.count() == retrieve.chunk_documents(docs).distinct().count() == 300


def test_topk_makes_no_row_of_a_pair(spark, monkeypatch):
    """Scores come from products inside the tasks: no join by term, however many copies tie, and the
    same rows in many tasks, steps and blocks of queries."""
    chunks, queries = corpus(spark, 4, 120)
    chunks = chunks.unionByName(spark.range(10_000, 10_200).selectExpr("id doc", "1 chunk_id", "'the w1 of w2' text"))
    every = retrieve.tfidf_scores(chunks, queries).where("bround(score * 1000) > 0 or words > 0")
    want = top(every, 5, F.desc("score"), F.desc("words"))
    monkeypatch.setattr(retrieve, "COMMON", 4)
    for cells, at_a_time, sent in ((4_000_000, 100_000, 1_000), (3_000, 300, 12)):
        monkeypatch.setattr(retrieve, "CELLS", cells)
        monkeypatch.setattr(retrieve, "AT_A_TIME", at_a_time)
        monkeypatch.setattr(retrieve, "SENT", sent)
        got = retrieve.tfidf_topk(chunks, queries, 5)
        assert top(got, 5, F.desc("score"), F.desc("words")) == want
        assert "Join" not in got._jdf.queryExecution().executedPlan().toString()
