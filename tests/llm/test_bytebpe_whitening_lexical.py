"""Byte-level BPE against the library on whole texts, whitening against numpy over all rows,
and ranked search against a brute-force ranking."""

import base64
import hashlib
import math
import re
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from proofgrain.llm import bytebpe, lexical, whitening

RANKS, PATTERN = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("whole", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def digests(library, text):
    ids = library.encode_ordinary(text or "")
    return len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()


@settings(max_examples=400, deadline=None)
@given(st.text(st.one_of(st.sampled_from("aZ09'sdlt ,.!\t\n\r\x1c\x85\xa0　日本語、。éß_²½٣"), st.characters(codec="utf-8")), max_size=80), st.integers(1, 9))
def test_parts_encode_as_the_whole_text(text, size):
    library = bytebpe.encoding(RANKS, PATTERN)
    pieces = list(bytebpe.parts(text, size))
    assert "".join(pieces) == text
    ids = bytebpe.ids_of(library, text, size)
    assert np.frombuffer(ids, "<u4").tolist() == library.encode_ordinary(text)
    assert bytebpe.bytes_of(library, ids) == text.encode()


def test_byte_bpe_equals_the_library(spark, awkward, no_docs, library):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    many = spark.createDataFrame([(100, "x" * 600_000), (101, " " * 300_000 + "y 7"), (102, "日本語" * 150_000), (103, "ab 12, it's\n" * 60_000)], "doc_id long, text string")
    for table in (docs, awkward, many):
        want = Counter((r.doc_id, *digests(library, r.text)) for r in table.select("doc_id", "text").collect())
        got = bytebpe.round_trip(table, RANKS, PATTERN)
        assert got.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
        assert Counter(map(tuple, got.collect())) == want
    assert bytebpe.round_trip(no_docs, RANKS, PATTERN).collect() == []


def test_ids_that_end_inside_a_character_decode_to_its_bytes(spark, library):
    ids = [i for i in range(50_256) if library.decode_single_token_bytes(i) == "é".encode()[:1]][:1]
    rows = spark.createDataFrame([(1, bytearray(np.array(ids, "<u4").tobytes()))], bytebpe.IDS)
    assert bytes(bytebpe.decode(rows, RANKS, PATTERN).first().decoded) == "é".encode()[:1]


def check_whitened(rows, got, weights=None):
    """``rows``: (vec_id, embedding) that take part."""
    x = np.array([[math.floor(1024 * float(c)) + 100_000 for c in e] for _, e in rows], object)
    fit = x if weights is None else np.array(list({tuple(r): r for r in x}.values()))
    n, total = len(fit), fit.sum(axis=0)
    centred = ((fit * n - total) / n).astype(float)
    values, axes = np.linalg.eigh(centred.T @ centred / n)
    values, axes = values[::-1], axes[:, ::-1]
    k = min(8, x.shape[1])
    want = {}
    for (vec_id, _), r in zip(rows, x):
        want.setdefault(vec_id, []).append((int(((r * n - total) ** 2).sum()), ((r * n - total) / n).astype(float) @ axes[:, :k] / np.sqrt(values[:k])))
    assert len(got) == k * len(rows)
    flip = {}
    for r in got:
        options = [w for w in want[r.vec_id] if w[0] == r.deviation]
        assert options and r.n == n and abs(r.explained - values[r.component - 1] / values.sum()) <= 1e-9 and r.identity_error <= 1e-9
        value = options[0][1][r.component - 1]
        if abs(value) > 1e-4:
            assert flip.setdefault(r.component, np.sign(value * r.whitened)) == np.sign(value * r.whitened)
        assert abs(abs(value) - abs(r.whitened)) <= 1e-6


def test_whitening_equals_numpy(spark):
    table = spark.read.parquet(f"{SF}/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in table.collect()]
    check_whitened(rows, whitening.whiten(table).collect())


def test_whitening_counts_copies_and_skips_broken_rows(spark):
    r = np.random.default_rng(5)
    base = [[float(v) for v in np.float32(r.normal(size=5) * [1, 2, 3, 4, 5])] for _ in range(40)]
    good = [(i, base[0] if i % 3 == 0 else base[i % 40]) for i in range(300)] + [(7, base[1]), (7, base[1]), (None, base[2])]
    broken = [(900, None), (901, []), (902, [1.0, None, 1.0, 1.0, 1.0]), (903, [float("nan")] * 5), (904, [float("inf"), 0.0, 0.0, 0.0, 0.0]), (905, [3e38, 0.0, 0.0, 0.0, 0.0]), (906, [1.0, 2.0])]
    df = spark.createDataFrame([(i, e, 1, [1], b"k") for i, e in good + broken], "vec_id long, embedding array<float>, n int, x array<int>, key binary").repartition(5)
    check_whitened(good, whitening.whiten(df).collect())
    check_whitened(good, whitening.whiten(df, weighted=False).collect(), weights=1)
    assert whitening.whiten(df.limit(0)).collect() == []


def test_whitening_without_variance_and_beyond_64_bits(spark):
    same = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(4)], "vec_id long, embedding array<float>")
    got = whitening.whiten(same).collect()
    assert len(got) == 8 and all(r.deviation == 0 and r.whitened is None and r.explained is None and r.identity_error is None for r in got)
    line = spark.createDataFrame([(i, [float(i), 2.0, 2.0 * i]) for i in range(10)], "vec_id long, embedding array<double>")
    got = whitening.whiten(line).collect()
    assert len(got) == 30 and all((r.whitened is None) == (r.component > 1) and r.identity_error < 1e-9 for r in got)
    far = spark.createDataFrame([(i, [1e9 * (i % 2), float(i)]) for i in range(6)], "vec_id long, embedding array<double>")
    got = whitening.whiten(far).collect()
    assert len(got) == 12 and all(r.deviation is None and r.identity_error < 1e-4 for r in got)


def brute_ranking(docs, items, k=20):
    cut = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    terms = [(i, Counter(cut(t))) for i, t in docs]
    n_docs, n_terms = sum(bool(c) for _, c in terms), sum(c.total() for _, c in terms)
    df = Counter(t for _, c in terms for t in c)
    out = []
    for item, text in set(items):
        asked, found = Counter(cut(text)), []
        for doc, c in terms:
            m = 100 - 25 + (25 * c.total() * n_docs) // max(1, n_terms)
            score = sum(q * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * c[t]) // (1000 * c[t] + 12 * m)) for t, q in asked.items() if t in c)
            if score > 0:
                found.append((-score, doc is None, doc or 0))
        out += [(item, rank, None if null else doc, -score) for rank, (score, null, doc) in enumerate(sorted(found)[:k], 1)]
    return Counter(out)


ITEMS = [(1, "One two three three"), (1, "One two three three"), (1, "w5x5 end"), (2, None), (3, ""), (4, "nowhere"), (None, "été rest TOKEN"), (5, "日本語 😀 w1x1 w1x1 w2x2")]


def test_search_equals_brute_force(spark, awkward, no_docs):
    items = spark.createDataFrame([(i, t, 1, b"x") for i, t in ITEMS], "item_id long, text string, times int, item binary")
    docs = [(r.doc_id, r.text) for r in awkward.collect()]
    for block in (lexical.BLOCK, 3):
        got = lexical.search(awkward, items, block=block)
        assert got.columns == ["item_id", "rank", "doc_id", "score"] and Counter(map(tuple, got.collect())) == brute_ranking(docs, ITEMS)
    assert lexical.search(no_docs, items).collect() == [] and lexical.search(awkward, items.limit(0)).collect() == []
    assert lexical.search(awkward.where("text IS NULL"), items).collect() == []


def test_search_breaks_ties_among_many_copies(spark):
    docs = [(i * 7 % 3001, "common word here" if i % 3 else f"common other {i % 5}") for i in range(3000)]
    table = spark.createDataFrame(docs, "doc_id long, text string").repartition(6)
    items = [(i, f"common word {i % 5} other") for i in range(30)]
    got = lexical.search(table, spark.createDataFrame(items, "item_id long, text string"), k=7)
    assert Counter(map(tuple, got.collect())) == brute_ranking(docs, items, 7)


def test_search_on_the_tables(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    got = lexical.search(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet"))
    assert Counter(map(tuple, got.collect())) == brute_ranking(docs, items)


def test_long_texts_are_counted_in_slices():
    text = ("Alpha beta,gamma 1x " * 50).encode()
    assert all(lexical.count_terms(text, size) == lexical.count_terms(text) for size in range(1, 40))
