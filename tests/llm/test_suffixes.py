"""Repeated bytes against brute force."""

import hashlib
import random

import pytest

from proofgrain.llm import suffixes


def brute(texts, length):
    places = {}
    for t in texts:
        for i in range(len(t) - length + 1):
            places[t[i : i + length]] = places.get(t[i : i + length], 0) + 1
    out = []
    for t in texts:
        hit = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if places[t[i : i + length]] > 1:
                hit[i : i + length] = b"\1" * length
        kept = bytes(b for b, h in zip(t, hit) if not h)
        runs = sum(1 for i, h in enumerate(hit) if h and not (i and hit[i - 1]))
        out.append((len(t), sum(hit), runs, hashlib.sha256(kept).hexdigest()))
    return out


def some_texts(seed):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcé") for _ in range(r.randint(1, 6)))
    base = [" ".join(word() for _ in range(r.randint(5, 60))) for _ in range(20)]
    for _ in range(25):
        a, b = r.choice(base), r.choice(base)
        i, j = r.randrange(len(a)), r.randrange(len(b))
        base.append(b[:j] + a[i : i + r.randint(20, 120)] + b[j:])
    base += ["ab" * 150, "x" * 130, base[0], base[0][:41], base[0][3:]]
    return base


@pytest.mark.parametrize("seed,large", [(1, 20_000), (2, 1), (3, 4)])
def test_removed_bytes(spark, seed, large):
    texts = some_texts(seed)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffixes.without_repeats(docs, length=40, gram=8, large=large).collect()}
    assert got == dict(enumerate(brute([t.encode() for t in texts], 40)))


def test_groups_are_maximal_repeats(spark):
    texts = some_texts(5)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    keys = {bytes(r.key): r.text.encode() for r in docs.select(suffixes.row_key("doc_id", "text").alias("key"), "text").collect()}
    groups = {}
    for r in suffixes.repeat_groups(docs, length=40, gram=8).collect():
        groups.setdefault((bytes(r.repeat), r.length, r.anchor), []).append((keys[bytes(r.key)], r.start))
    assert groups
    for (_, length, _), found in groups.items():
        assert len(found) > 1 and len({t[s : s + length] for t, s in found}) == 1


def test_intervals_and_maximal_repeats():
    assert sorted(suffixes.intervals([2, 2, 0, 3])) == [(0, 0, 4), (2, 0, 2), (3, 3, 4)]
    found = {(a, b, tuple(sorted(x))) for a, b, x in suffixes.maximal_repeats([b"ab", b"ac", b"zz"], [b"12345", b"12399", b"12345"], 3)}
    assert found == {(1, 3, (0, 1)), (0, 5, (0, 2)), (0, 3, (0, 1, 2))}


def test_slices_of_long_texts(spark, monkeypatch):
    text = "".join(random.Random(9).choice("abcdefgh") for _ in range(9000))
    docs = spark.createDataFrame([(1, text), (2, text[100:7000]), (3, "z" + text[4000:])], "doc_id long, text string")
    monkeypatch.setattr(suffixes, "SLICE", 1500)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffixes.without_repeats(docs).collect()}
    assert got == dict(zip((1, 2, 3), brute([t.text.encode() for t in docs.orderBy("doc_id").collect()], 400)))


def test_awkward_rows(awkward, no_docs):
    rows = awkward.collect()
    got = sorted((r.doc_id or -1, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffixes.without_repeats(awkward).collect())
    short = [(r.text or "").encode() for r in rows]
    want = brute([t[:5000] if len(t) > 5000 else t for t in short], 400)
    for (doc, n, removed, spans, _), row in zip(got, sorted(rows, key=lambda r: (r.doc_id or -1, len((r.text or "").encode())))):
        assert (doc, n) == (row.doc_id or -1, len((row.text or "").encode()))
        if doc in (6, 7, 8):
            assert removed == n - (3 if doc == 7 else 0) and spans == 1  # " " after the last word also follows that word inside
        else:
            assert removed == spans == 0
    assert len(want) == len(got)
    assert suffixes.without_repeats(no_docs).collect() == []
