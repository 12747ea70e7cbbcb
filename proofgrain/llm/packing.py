"""Packing of documents into fixed windows by multiway Karmarkar-Karp differencing.

Documents are encoded and cut: whole windows first, then pieces of at most ``piece`` ids.
Whole windows stand alone.  The other pieces are dealt by a hash of their content to blocks
of about ``block_tokens`` ids; each block is packed by itself, so a task holds a bounded
list of lengths and never any text.

In a block, every piece begins as a partition with one loaded window.  The two partitions of
the largest spread are merged, the fullest windows of one with the emptiest of the other,
until one is left: near-equal windows.  If its fullest window exceeds the capacity, the
number of windows rises and the block is differenced again.

Null and empty texts are the end id alone.  Repeated rows are packed once each.  An empty
table gives an empty result.  Columns other than ``doc_id`` and ``text`` are ignored.
"""

from __future__ import annotations

import heapq
import zlib
from bisect import insort
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from proofgrain.llm import tokens
from proofgrain.llm.common import batch, staged, utf8


def cuts(n: int, capacity: int, piece: int) -> Iterator[tuple[int, int]]:
    """(start, length) of a document's pieces."""
    start = 0
    while n - start >= capacity:
        yield start, capacity
        start += capacity
    while start < n:
        length = min(piece, n - start)
        yield start, length
        start += length


def pieces(docs: DataFrame, tokenizer: str, end_id: int = 2, capacity: int = 4096, piece: int = 1024) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens."""
    docs = docs.select("doc_id", "text")
    kind = docs.schema["doc_id"].dataType
    key = pa.int64() if kind.simpleString() in ("bigint", "int", "smallint", "tinyint") else pa.string()
    schema = pa.schema([("doc_id", key), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            out: list[list] = [[], [], [], [], []]
            for doc, ids in zip(rows.column("doc_id").cast(key).to_pylist(), tokens.encode(tokenizer, utf8(rows.column("text")), end_id), strict=True):
                n, view = len(ids) // 4, memoryview(ids)
                for start, length in cuts(n, capacity, piece):
                    for column, value in zip(out, (doc, start, length, zlib.crc32(view[4 * start : 4 * (start + length)]), n), strict=True):
                        column.append(value)
            yield batch(schema, *out)

    return docs.mapInArrow(run, f"doc_id {'bigint' if key == pa.int64() else 'string'}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint")


def difference(lengths: list[int], windows: int) -> list[list[int]]:
    """The pieces (by position) of each window, by multiway Karmarkar-Karp differencing."""
    children: list[tuple[int, int]] = []  # of merged loads; a leaf is its piece's position
    n = len(lengths)

    def joined(a: tuple[int, int], b: tuple[int, int]) -> tuple[int, int]:
        children.append((a[1], b[1]))
        return a[0] + b[0], n + len(children) - 1

    def spread(loads: list[tuple[int, int]]) -> int:
        return loads[-1][0] - (loads[0][0] if len(loads) == windows else 0)

    # a partition is its loaded windows in ascending order; windows not listed are empty
    heap = [(-size, i, [(size, i)]) for i, size in enumerate(lengths)]
    heapq.heapify(heap)
    while len(heap) > 1:
        _, tie, a = heapq.heappop(heap)
        _, _, b = heapq.heappop(heap)
        if len(a) < len(b):
            a, b = b, a
        over = len(a) + len(b) - windows  # so many loads of b meet loads of a
        if len(b) == 1:
            insort(a, joined(a.pop(0), b[0]) if over > 0 else b[0])
        elif over <= 0:
            a = sorted(a + b)
        else:
            met = [joined(a[i], b[over - 1 - i]) for i in range(over)]  # b's smaller loads that found no empty window
            a = sorted(met + a[over:] + b[over:])
        heapq.heappush(heap, (-spread(a), tie, a))
    out = []
    for _, root in heap[0][2] if heap else []:
        found, todo = [], [root]
        while todo:
            x = todo.pop()
            if x < n:
                found.append(x)
            else:
                todo.extend(children[x - n])
        out.append(sorted(found))
    return out


def windows_of(lengths: list[int], capacity: int) -> list[list[int]]:
    total = sum(lengths)
    count = max(1, -(-total // capacity))
    while True:
        found = difference(lengths, count)
        most = max((sum(lengths[i] for i in w) for w in found), default=0)
        if most <= capacity:
            return found
        count += max(1, (most - capacity) * count // (2 * capacity))


def pack(docs: DataFrame, tokenizer: str, end_id: int = 2, capacity: int = 4096, piece: int = 1024, block_tokens: int = 1 << 22) -> DataFrame:
    """One row per piece, with its sequence_id and its offset there.

    sequence_id is unique over all blocks: the window's number in its block, times the
    number of blocks, plus the block's number.
    """
    if piece > capacity:
        raise ValueError("a piece must fit into a window")
    cut = staged(pieces(docs, tokenizer, end_id, capacity, piece), "pieces")
    blocks = max(1, -(-(cut.agg(F.sum("length")).first()[0] or 0) // block_tokens))
    dealt = cut.withColumn("block", F.pmod(F.xxhash64("doc_id", "start", "doc_tokens", "ids_crc32"), F.lit(blocks)))
    names = cut.columns

    def run(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([(c, "ascending") for c in names])
        block, lengths = rows.column("block")[0].as_py(), rows.column("length").to_pylist()
        whole = [i for i, x in enumerate(lengths) if x == capacity]
        part = [i for i, x in enumerate(lengths) if x < capacity]
        packed = [[i] for i in whole] + [[part[i] for i in w] for w in windows_of([lengths[i] for i in part], capacity)] * bool(part)
        sequence, offset = [0] * len(lengths), [0] * len(lengths)
        for number, window in enumerate(packed):
            at = 0
            for i in window:
                sequence[i], offset[i] = number * blocks + block, at
                at += lengths[i]
        return rows.drop_columns(["block"]).append_column("sequence_id", pa.array(sequence, pa.int64())).append_column("offset", pa.array(offset, pa.int64()))

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in cut.schema)
    return dealt.groupBy("block").applyInArrow(run, f"{kinds}, sequence_id bigint, offset bigint")
