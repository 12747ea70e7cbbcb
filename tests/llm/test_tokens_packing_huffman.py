"""Packing and Huffman id files against the tokenizers library itself."""

import heapq
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from proofgrain.llm import huffman, packing, tokens
from proofgrain.llm.common import new_folder

PATH = public_tokenizers.path("word_bpe_49k.json")
DOCS = "/root/testdata/sf0.001/documents.parquet"


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def ids_of(library, text):
    return np.array(library.encode(text or "", add_special_tokens=False).ids + [2], "<u4")


def rows_of(df):
    return sorted((r.asDict() for r in df.collect()), key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, r.get("start", 0)))


@settings(max_examples=60, deadline=None)
@given(st.text(st.one_of(st.sampled_from("aAbB's,.!<|>_ \n\t́İßΣ 1²"), st.characters(codec="utf-8")), max_size=60))
def test_ids_equal_the_librarys(text):
    library = Tokenizer.from_file(PATH)
    assert tokens.encode(PATH, [text.encode()], 2)[0] == ids_of(library, text).tobytes()


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 1024), min_size=1, max_size=200), st.integers(1, 12))
def test_differencing_deals_every_piece_once_and_evenly(lengths, windows):
    found = packing.difference(lengths, windows)
    assert sorted(i for w in found for i in w) == list(range(len(lengths))) and len(found) <= windows
    loads = [sum(lengths[i] for i in w) for w in found] + [0] * (windows - len(found))
    assert max(loads) - min(loads) <= max(lengths)


def test_windows_never_exceed_the_capacity():
    lengths = [1000, 900, 800, 700, 600, 500, 400, 300] * 30
    found = packing.windows_of(lengths, 1024)
    assert max(sum(lengths[i] for i in w) for w in found) <= 1024


def check_packed(library, docs, got, capacity):
    want = {}
    for r in docs.collect():
        want.setdefault(r.doc_id, []).append(ids_of(library, r.text))
    held = {}
    for r in got:
        options = [x for x in want[r["doc_id"]] if len(x) == r["doc_tokens"] and zlib.crc32(x[r["start"] : r["start"] + r["length"]].tobytes()) == r["ids_crc32"]]
        assert options, r
        held.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert sum(r["length"] for r in got) == sum(len(x) for v in want.values() for x in v)
    for places in held.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return len(held)


def test_packing_whole_documents(spark, library):
    docs = spark.read.parquet(DOCS)
    got = rows_of(packing.pack(docs, PATH))
    windows = check_packed(library, docs, got, 4096)
    total = sum(r["length"] for r in got)
    assert windows * 4096 - total < 0.05 * total + 4096


def test_packing_many_blocks(spark, library):
    docs = spark.read.parquet(DOCS)
    got = rows_of(packing.pack(docs, PATH, capacity=512, piece=100, block_tokens=4096))
    check_packed(library, docs, got, 512)


def test_packing_awkward_rows(awkward, no_docs, library):
    check_packed(library, awkward, rows_of(packing.pack(awkward, PATH)), 4096)
    assert packing.pack(no_docs, PATH).collect() == []


def plain_huffman_cost(counts):
    heap = list(counts)
    heapq.heapify(heap)
    cost = 0
    while len(heap) > 1:
        a = heapq.heappop(heap) + heapq.heappop(heap)
        cost += a
        heapq.heappush(heap, a)
    return cost


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 10_000), min_size=2, max_size=60))
def test_code_lengths_are_optimal_and_limited(counts):
    counts = np.array(counts)
    free = huffman.code_lengths(counts, 40)
    assert int((counts * free).sum()) == plain_huffman_cost(counts.tolist())
    tight = huffman.code_lengths(counts, max(6, int(len(counts) - 1).bit_length()))
    assert tight.max() <= max(6, int(len(counts) - 1).bit_length()) and (0.5 ** tight.astype(float)).sum() <= 1


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(0, 300), min_size=1, max_size=700), st.integers(1, 64))
def test_block_round_trip(ids, interval):
    ids = np.array(ids, np.uint32)
    values, counts = np.unique(ids, return_counts=True)
    code = huffman.Code.from_book(huffman.Code.of_counts(dict(zip(values.tolist(), counts.tolist()))).book())
    for numeric, keys in ((True, [None, -7]), (False, [None, "kéy"])):
        block = huffman.write_block(keys, [1, len(ids) - 1], ids, code, interval, numeric)
        got_keys, sizes, back = huffman.read_block(block, code, numeric)
        assert sizes == [1, len(ids) - 1] and back.tolist() == ids.tolist()
        assert got_keys == keys


def check_files(library, docs, got):
    want = sorted(((r.doc_id is not None, r.doc_id or 0, ids_of(library, r.text)) for r in docs.collect()), key=lambda x: x[:2])
    assert [r["doc_id"] for r in got] == [x[1] if x[0] else None for x in want]
    at = 0
    for r, x in zip(got, want):
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (at, len(x[2]), zlib.crc32(x[2].tobytes())), r
        at += len(x[2])


def test_files_of_whole_documents(spark, library):
    docs = spark.read.parquet(DOCS)
    check_files(library, docs, rows_of(huffman.round_trip(docs, PATH)))


def test_files_in_many_parts_and_blocks(spark, library):
    docs, folder = spark.read.parquet(DOCS), new_folder(spark, "parts")
    manifest = huffman.write(docs, folder, PATH, limit=15, interval=7, block_tokens=3000, file_tokens=20_000)
    assert manifest.select("part").distinct().count() > 3 and manifest.count() > 20
    got = huffman.read(spark, folder, manifest).selectExpr("doc_id", "start", "n_tokens", "crc32(ids) AS ids_crc32")
    check_files(library, docs, rows_of(got))


def test_files_of_awkward_rows(awkward, no_docs, library):
    check_files(library, awkward, rows_of(huffman.round_trip(awkward, PATH)))
    assert huffman.round_trip(no_docs, PATH).collect() == []
