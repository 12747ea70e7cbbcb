"""Plans whose cost must not hang on how small a file is or how few keys there are."""

import time

from pyspark.sql import functions as F

from proofgrain.operators import compare, match, pairs, retrieve
from proofgrain.plans import compare_queries, inputs, quality_queries, retrieve_queries
from proofgrain.plans.evidence_queries import own_ledger, packet_evidence
from proofgrain.plans.ctes import ALIAS_RULES
from proofgrain.session import cut_lineage

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_orders_are_not_broadcast_and_pairs_are_not_dealt_by_label(spark):
    chunks = inputs.evidence_chunks(spark, SF)
    assert "SortMergeJoin" in plan(chunks)
    fields = inputs.field_spec(spark, SF)
    found = pairs.strict_pairs(chunks)
    matched = match.match_fields(fields, found, match.alias_keys(fields, ALIAS_RULES))
    assert "hashpartitioning(form_id" not in plan(matched) and matched.count() > found.select("packet_id").distinct().count()


def test_evidence_of_packets_broadcasts_no_orders(spark):
    assert "Broadcast" not in plan(packet_evidence(spark, SF))


def test_the_summary_numbers_lines_once_and_headers_gather_no_text(spark):
    assert "Window" not in plan(compare_queries.summary(spark, SF))  # the grid is a written table
    assert "collect_list" not in plan(compare.cell_issues(inputs.grid(spark, SF)))


def test_candidates_are_dealt_once_by_field(spark):
    for part in own_ledger(spark, SF):
        assert not [line for line in plan(part).splitlines() if "Exchange hashpartitioning" in line and "field_id" in line and "value" in line]


def test_a_written_stage_leaves_no_shuffle_files(spark):
    def left():
        return spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString("\n").count("/shuffle_")

    before = left()
    cut_lineage(spark.range(10_000).repartition(7))
    for _ in range(100):
        if left() == before:
            break
        time.sleep(0.1)
    assert left() == before


def test_the_suite_holds_no_shuffle_of_two_checks(spark, monkeypatch):
    named = ("dq3_record_types", "dq4_leaf_keys", "dq12_structure")
    monkeypatch.setattr(quality_queries, "CHECKS", named)
    found = quality_queries.suite(spark, SF)
    assert "Exchange" not in plan(found)
    assert found.count() == sum(quality_queries.QUERIES[name](spark, SF).count() for name in named)


def test_norms_are_written_and_terms_of_one_chunk_are_not_shuffled(spark):
    chunks, queries = retrieve_queries.doc_chunks(spark, SF), retrieve_queries.item_queries(spark, SF)
    got = retrieve._Weighed(chunks, queries, ["doc", "chunk_id"], ["query"], None, (), None, 2, True, 1)
    assert "df#" in plan(got.rare_norms()) and "> 1)" in plan(got.rare_norms())
    want = got._squares(got.posts.join(got.stats.select("term", "i"), "term"))
    both = got.norms().withColumnRenamed("ss", "a").join(want, ["doc", "chunk_id"], "full")
    assert both.where("a is null or ss is null or abs(a - ss) > 1e-9 * ss").count() == 0
    assert plan(retrieve.tfidf_scores(chunks, queries, ngrams=2, raw_tf=True)).count("LeftAnti") == 0


def test_the_summary_counts_all_classes_at_once(spark):
    def of(*docs, **more):
        df = spark.createDataFrame([(d,) for d in docs], "doc long")
        return df.select("doc", *[F.lit(v).alias(k) for k, v in more.items()])

    out = compare.validation_summary(of(1, passed=False), of(1, 1), of(2), of(2, 2, status="drift"), of(1, 1, 2, 3), of(3), of(3, 3), of(3, 9))
    assert "Join" not in plan(out)
    assert sorted(map(tuple, out.collect())) == [(1, 1, 2, 0, 0, 0, 0, 0, False), (2, 0, 0, 1, 2, 0, 0, 0, False), (3, 0, 0, 0, 0, 1, 1, 2, False)]
