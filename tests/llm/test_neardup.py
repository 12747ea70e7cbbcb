"""Near-duplicate groups against brute force over all pairs."""

import random

import pytest

from proofgrain.llm import neardup


def shingles(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute(rows, similar=85):
    """Sorted (doc_id, n_shingles, component_id, kept)."""
    sets = [(i, shingles(t)) for i, t in rows]
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and y and 100 * len(x & y) >= similar * len(x | y):
                root[find(a)] = find(b)
    least = {}
    for a, (i, _) in enumerate(sets):
        if i is not None:
            least[find(a)] = min(i, least.get(find(a), i))
    return sorted(((i if i is not None else -1), len(s), least.get(find(a), -1), i == least.get(find(a))) for a, (i, s) in enumerate(sets))


def found(df):
    return sorted((r.doc_id if r.doc_id is not None else -1, r.n_shingles, r.component_id if r.component_id is not None else -1, r.kept) for r in df.collect())


def near_copies(seed):
    """Copies with few and with many edits, chains of small steps, and short texts."""
    r = random.Random(seed)
    word = lambda: f"w{r.randrange(400)}"
    rows = []
    for _ in range(6):
        base = [word() for _ in range(r.randint(30, 200))]
        for edits in (0, 0, 1, 1, 2, 3, 5, 8):
            copy = list(base)
            for _ in range(edits):
                copy[r.randrange(len(copy))] = word()
            rows.append(" ".join(copy))
    chain = [word() for _ in range(120)]
    for step in range(12):
        rows.append(" ".join(chain))
        chain[7 * step % 120] = word()
        chain[(7 * step + 50) % 120] = word()
    rows += ["A b", "a B", "a b c d", "a b c d e", "a  b\tc d E", "", " ", None, "a"]
    r.shuffle(rows)
    return list(enumerate(rows))


@pytest.mark.parametrize("seed,block", [(1, 2048), (2, 3)])
def test_groups_equal_brute_force(spark, monkeypatch, seed, block):
    monkeypatch.setattr(neardup, "BLOCK", block)
    rows = near_copies(seed)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert found(neardup.near_duplicates(docs)) == brute(rows)


@pytest.mark.parametrize("block", [2048, 4])
def test_third_round_alone_finds_every_group(spark, monkeypatch, block):
    """All nodes in one bucket, none connected so far."""
    monkeypatch.setattr(neardup, "BLOCK", block)
    rows = near_copies(3)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    marked = neardup.signatures(docs).where("node IS NOT NULL")
    nodes = marked.groupBy("node").agg({"signature": "min", "key": "min"}).toDF("node", "signature", "key")
    one_bucket = nodes.selectExpr("0 AS band", "0L AS bucket", "node")
    links = neardup.across(one_bucket, nodes.selectExpr("node", "node AS root").limit(0), nodes.select("node", "signature"), neardup.whole_sets(docs, nodes.select("key", "node")))
    least = {bytes(r.node): r.d for r in marked.groupBy("node").agg({"doc_id": "min"}).toDF("node", "d").collect()}
    root = {i: i for i in least.values()}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for r in links.collect():
        x, y = find(least[bytes(r.a)]), find(least[bytes(r.b)])
        root[max(x, y)] = min(x, y)
    want = {i: c for i, n, c, _ in brute(rows) if n}
    assert {i: find(i) for i in root} == {i: want[i] for i in root}


def test_components_of_a_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 140)] + [(200, 200)]
    df = spark.createDataFrame(edges, "a long, b long")
    got = {r.u: r.v for r in neardup.components(df).collect()}
    assert got == {**{i: 0 for i in range(1, 41)}, **{i: 100 for i in range(101, 140)}}


def test_awkward_rows(awkward, no_docs):
    assert found(neardup.near_duplicates(awkward)) == brute([(r.doc_id, r.text) for r in awkward.collect()])
    assert neardup.near_duplicates(no_docs).collect() == []
    left = neardup.one_of_each(awkward)
    assert left.columns == awkward.columns
    assert sorted(r.doc_id or -1 for r in left.collect()) == [-1, 1, 2, 3, 4, 6, 9, 10, 11]


@pytest.mark.parametrize("block", [2048, 3])
def test_stage_at_80_percent_equals_brute_force(spark, monkeypatch, block):
    """Pairs between 0.80 and 0.85 as well, one of them at 0.80 exactly."""
    import corpus_pipeline

    monkeypatch.setattr(neardup, "BLOCK", block)
    rows = near_copies(4)
    base = [f"v{i}" for i in range(200)]
    for place in ((100,), (40, 80), (20, 60, 100, 140), (20, 60, 100, 140, 180)):
        rows.append((len(rows), " ".join(f"x{len(rows)}" if i in place else w for i, w in enumerate(base))))
    exact = [f"u{i}" for i in range(13)]
    rows += [(len(rows), " ".join(exact[:12])), (len(rows) + 1, " ".join(exact[:11] + ["z"])), (len(rows) + 2, " ".join(exact))]
    exact = [f"t{i}" for i in range(14)]
    rows += [(len(rows), " ".join(exact[:12])), (len(rows) + 1, " ".join(exact))]
    sets = [shingles(t) for _, t in rows]
    near = [100 * len(x & y) / len(x | y) for i, x in enumerate(sets) for y in sets[:i] if x and y]
    assert any(p == 80 for p in near) and sum(80 <= p < 85 for p in near) > 5
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    kept = {r.doc_id for r in corpus_pipeline.one_of_each_group(spark, docs, "").collect()}
    assert kept == {i for i, least in enumerate(components_at(sets, 80)) if i == least}
    assert kept != {i for i, least in enumerate(components_at(sets, 85)) if i == least}


def components_at(sets, percent):
    """The smallest position that each position reaches."""
    least = list(range(len(sets)))

    def find(x):
        while least[x] != x:
            x = least[x]
        return x

    for a, x in enumerate(sets):
        for b, y in enumerate(sets[:a]):
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                low, high = sorted((find(a), find(b)))
                least[high] = low
    return [find(i) for i in range(len(sets))]


def test_rules_follow_from_the_similarity():
    for percent, bands in ((85, 24), (80, 35), (100, 1)):
        asked = neardup.rule(percent)
        alike = percent / 100
        assert asked.bands == bands and (1 - alike**neardup.ROWS) ** bands <= 1e-6
        assert alike - asked.agreeing >= 6 * (alike * (1 - alike) / asked.minima) ** 0.5


def test_pipeline_stages_at_80(spark, monkeypatch):
    """Every check of the pipeline's stages, with the near copies of 0.80 and more."""
    import test_cotrain_pipeline
    import test_neardup

    def at_80(rows, similar=80):
        rows = sorted(rows)
        least = components_at([shingles(t) for _, t in rows], 80)
        return [(i, 0, rows[c][0], c == at) for at, ((i, _), c) in enumerate(zip(rows, least, strict=True))]

    monkeypatch.setattr(test_neardup, "brute", at_80)
    test_cotrain_pipeline.test_pipeline_stages(spark)
