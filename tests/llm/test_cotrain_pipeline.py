"""Co-training on held-out labels, and the whole pipeline stage by stage."""

import pathlib
import random

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from proofgrain.llm import cotrain, queries
from proofgrain.llm.common import shared_dir, staged

SF = "/root/testdata/sf0.01"


def test_held_out_labels(spark):
    """266 labels are few: what is bad by its shape is found, and good documents stay."""
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    train, test = labels.where("doc_id % 3 > 0"), {r.doc_id: r for r in labels.where("doc_id % 3 = 0").collect()}
    got = {r.doc_id: r for r in cotrain.classify(docs, train).collect()}
    assert len(got) == docs.count() and all(0 <= r.score <= 1 for r in got.values())
    assert {r.doc_id for r in cotrain.good_documents(docs, train).collect()} == {i for i, r in got.items() if not r.rejected}
    bad = [got[i].rejected for i, r in test.items() if r.quality == 0]
    good = [got[i].rejected for i, r in test.items() if r.quality == 1 and r.toxic == 0]
    assert sum(bad) >= 0.6 * len(bad) and sum(good) <= 0.03 * len(good)


def test_toxic_words_by_their_beginnings():
    """Held-out accuracy of the text view where toxic words vary in their endings."""
    r = random.Random(4)
    word = lambda: "".join(r.choice(("on", "the", "ti", "ea", "st", "er")) for _ in range(r.randint(1, 4)))
    texts, bad = [], []
    for i in range(2400):
        words = [word() for _ in range(r.randint(20, 200))]
        bad.append(i % 8 == 0)
        for _ in range(r.randint(1, 4) * bad[-1]):
            words.insert(r.randrange(len(words)), "vexxo" + word())
        texts.append(" ".join(words).encode())
    found = [cotrain.text_features(t) for t in texts]
    meta = pa.array([cotrain.meta_values("en", f"src{i % 5}", len(t)) for i, t in enumerate(texts)])
    whole = cotrain.Held(*cotrain.both_views(meta, pa.array([f[0] for f in found]), pa.array([f[1].tobytes() for f in found])), np.array(bad))
    part = lambda a, b: whole.where((np.arange(2400) >= a) & (np.arange(2400) < b))
    views = cotrain.Views()
    views.ready = True
    for view, which in ((views.text, "text"), (views.meta, "meta")):
        view.fit(getattr(part(0, 1200), which), part(0, 1200).bad.astype(float))
        view.calibrate(getattr(part(1200, 1600), which), part(1200, 1600).bad)
    views.prior = float(np.log(1 / 7))
    rest = part(1600, 2400)
    says = cotrain.sigmoid(views.log_odds(rest.text, rest.meta)[2]) >= cotrain.REJECTED
    truth = np.array(bad[1600:])
    assert says[truth].mean() > 0.95 and says[~truth].mean() < 0.01


def test_awkward_rows_and_few_labels(spark, awkward, no_docs):
    labels = spark.createDataFrame([(i, i % 2, None, "x") for i in range(1, 12)] + [(None, 1, 1, "x"), (4, 0, 1, "x")], "doc_id long, quality int, toxic int, is_bad string")
    assert [cotrain.size_class(x) for x in (None, "many", float("nan"), float("inf"), -3, "7")] == ["none"] * 4 + ["0", "12"]
    for some in (labels, labels.limit(0), labels.where("quality = 1")):
        got = cotrain.classify(awkward, some).collect()
        assert len(got) == awkward.count() and not any(r.rejected for r in got)
    assert cotrain.classify(no_docs, labels).collect() == []
    many = spark.createDataFrame([(i, "GOOD fine text" if i % 2 else "idiot bad text") for i in range(200)], "doc_id long, text string")
    marks = spark.createDataFrame([(i, 1, 1 - i % 2) for i in range(120)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r.rejected for r in cotrain.classify(many.unionByName(awkward.select("doc_id", "text").where("doc_id = 4")), marks).collect() if r.doc_id > 20}
    assert all(got[i] == (i % 2 == 0) for i in got)
    assert cotrain.good_documents(awkward, labels).columns == awkward.columns


def test_pipeline_stages(spark):
    """Every stage does to its own input what its operator reports."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id: r.text for r in docs.collect()}
        out = staged(stage(spark, docs, SF), "out")
        if name == "packing":
            assert {r.doc_id for r in out.select("doc_id").distinct().collect()} == set(before)
            break
        assert sorted(out.columns) == sorted(names)
        after = {r.doc_id: r.text for r in out.collect()}
        assert set(after) <= set(before) and out.count() == len(after)
        if name == "near duplicates":
            from test_neardup import brute

            assert set(after) == {i for i, _, _, kept in brute(list(before.items()), corpus_pipeline.NEAR) if kept}
        if name == "benchmark decontamination":
            from test_secrets_decontam import check

            items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
            assert set(after) == {w[0] for w in check(list(before.items()), items) if not w[5]}
        if name == "secret scan":
            from test_secrets_decontam import brute, brute_every_class

            assert set(after) == set(before)
            assert all((after[i] == t) == (not brute_every_class(t) and not sum(brute(t)[:3])) for i, t in before.items())
        docs = out


def test_registered():
    import __spark_entry__

    assert [k.split("_")[0] for k in queries.QUERIES] == [f"op{n}" for n in range(1, 14)]
    assert set(queries.QUERIES) <= set(__spark_entry__.queries()) and "pipeline" in __spark_entry__.queries()


@pytest.mark.parametrize("name", list(queries.ORACLES))
def test_query_equals_sql(spark, name):
    from oracle_check import compare, duck

    sf = "/root/testdata/sf0.001"
    rows, problems = compare(queries.QUERIES[name](spark, sf), duck(sf), queries.ORACLES[name])
    assert not problems and rows > 0


def test_stages_leave_only_what_their_result_reads(spark):
    """Staged tables go once no later step reads them (the benchmark's terms stay); results
    stay readable."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    folder = pathlib.Path(shared_dir(spark).removeprefix("file://").removeprefix("file:")) / "llm" / spark.sparkContext.applicationId
    for (name, stage), most in zip(corpus_pipeline.STAGES[:3], ([], ["stay"], ["contaminated", "terms"])):
        before = set(folder.glob("*"))
        out = stage(spark, docs, SF)
        assert sorted(p.name.rsplit("-", 1)[0] for p in folder.glob("*") if p not in before) == most, name
        assert 0 < out.count() <= docs.count()
