"""WARC archives and exact search."""

import base64
import gzip
import hashlib
import io
import math

import pytest

from proofgrain.llm import topk, warc
from proofgrain.llm.common import new_folder

PAGES = [(1, "http://a/x y\n", "<p>one</p>"), (2, None, "<p>one</p>"), (3, "http://b", ""), (4, "http://c", None), (5, "u", "é" * 5000), (6, "u", "<p>two</p>"), (None, "u", "<p>two</p>"), (7, "u", "WARC/1.1\r\n\r\n"),
         (8, "u", "<p>one</p>"), (1, "http://again", "<p>one</p>")]


def want(rows):
    out = []
    for page, _, html in rows:
        data = (html or "").encode()
        first = min(p for p, _, h in rows if (h or "") == (html or "") and p is not None)
        kind = ("response", None) if page == first else ("revisit", first)
        out.append((page, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), *kind))
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame([(*r, "x", 1) for r in PAGES], "page_id long, url string, html string, digest string, revisit int").repartition(2)


def test_round_trip(pages):
    assert sorted(map(tuple, warc.round_trip(pages).collect()), key=str) == want(PAGES)
    assert warc.round_trip(pages.limit(0)).collect() == []


@pytest.mark.parametrize("split", [1, 50, 333])
def test_every_record_belongs_to_one_split(spark, pages, split):
    folder = new_folder(spark, "warc")
    got = warc.read(spark, warc.write(pages, folder, file_bytes=900), folder, split_bytes=split).collect()
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=str) == want(PAGES)
    payload = {r.page_id: r.payload for r in got if r.record_type == "response"}
    assert bytes(payload[5]) == ("é" * 5000).encode() and bytes(payload[7]) == b"WARC/1.1\r\n\r\n"


def test_short_payloads_are_never_revisits(pages):
    got = warc.round_trip(pages, revisit_from=11).collect()
    assert {r.record_type for r in got} == {"response"}


def test_false_magic_is_passed_over():
    record = warc.record(1, "u", b"body", warc.digest_of(b"body"))
    other = gzip.compress(b"not a record " * 50)
    data = warc.MAGIC + b"junk" + other + warc.member(record) + b"\x1f\x8b" + warc.member(record) + warc.MAGIC
    for size in (1, 7, 4096):
        whole = [b for _, b in warc.owned_records(io.BytesIO(data), len(data), 0, len(data), size)]
        assert len(whole) == 2 and whole[0].endswith(b"body")
    cut = sum(len(list(warc.owned_records(io.BytesIO(data), len(data), a, min(a + 13, len(data)), 64))) for a in range(0, len(data), 13))
    assert cut == 2


VECTORS = [(i, [((i * 37 + j * 11) % 21 - 10) / 10.0 for j in range(4)]) for i in range(0, 120)] + [(500 + i, [0.5, 0.5, 0.5, 0.5]) for i in range(40)] + [
    (700, None), (701, [0.1, None, 0.2, 0.3]), (702, [float("nan"), 0.0, 0.0, 0.0]), (703, [float("inf"), 0.0, 0.0, 0.0]), (704, [1.0, 2.0]), (750, [3.0, 1.0]), (50, [-1.0, 0.7, 0.1, -0.4]), (None, [1.0, 1.0, 1.0, 1.0])]


def brute(rows, every, k):
    ok = {}
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            ok[i] = min(ok.get(i, v), v)
    quantized = {i: [math.floor(256 * x) for x in v] for i, v in ok.items()}
    out = []
    for q, a in quantized.items():
        if q % every == 0:
            scores = sorted((-sum(x * y for x, y in zip(a, b)), c) for c, b in quantized.items() if c != q and len(b) == len(a))
            out += [(q, rank, c, -s) for rank, (s, c) in enumerate(scores[:k], 1)]
    return sorted(out)


@pytest.mark.parametrize("every,k", [(50, 5), (10, 3), (1, 200)])
def test_search_equals_brute_force(spark, every, k):
    df = spark.createDataFrame([(*r, 0, "x") for r in VECTORS], "vec_id long, embedding array<double>, rank int, score string").repartition(3)
    assert sorted(map(tuple, topk.search(df, every, k).collect())) == brute(VECTORS, every, k)


def test_search_in_small_blocks_and_of_nothing(spark):
    df = spark.createDataFrame(VECTORS, "vec_id long, embedding array<double>")
    vectors = topk.quantized(df)
    got = topk.top_k(vectors.where("vec_id % 10 = 0"), vectors, 3, q_size=4, c_size=16)
    assert sorted(map(tuple, got.collect())) == brute(VECTORS, 10, 3)
    assert topk.search(df.limit(0)).collect() == []


def test_groups_of_blocks_are_shuffled_and_never_broadcast(spark, monkeypatch):
    df = spark.createDataFrame(VECTORS + [(900, [2000.0, -2000.0, 1.0, 0.0]), (910, [3e5, 1.0, 0.0, 0.0])], "vec_id long, embedding array<double>")
    vectors = topk.quantized(df)
    for held in (1, 1 << 24):
        monkeypatch.setattr(topk, "HELD", held)
        found = topk.top_k(vectors.where("vec_id % 10 = 0"), vectors, 3, q_size=4, c_size=16)
        assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
        assert sorted(map(tuple, found.collect())) == brute([tuple(r) for r in df.collect()], 10, 3)
