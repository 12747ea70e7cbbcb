"""Token ids in Huffman-coded block files.

The code is one canonical, length-limited code built by package-merge from the counts of all
ids.  A file is a run of independent blocks in ascending doc_id order; its code book lies in
a file of its own beside it.  A block (little-endian):

    u32 documents, u32 checkpoint interval, u64 ids, u64 bits
    per document: i64 doc_id (or the length-prefixed string of any other key), u8 null mark, u32 ids
    u64 bit offset of every interval-th id
    the codes, most significant bit first, padded to bytes

A decoder looks up the next bits in a table that gives an id and its code's length.  Every
checkpoint is an entry point, so all of them step through the table side by side.

Null and empty texts hold the end id alone.  Repeated rows are stored once each, ordered by
(doc_id, ids).  A null doc_id sorts first.  An empty table gives no file and no rows.
Columns other than ``doc_id`` and ``text`` are ignored.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from proofgrain.llm import tokens
from proofgrain.llm.common import batch, new_folder, staged, utf8

MAX_BITS = 24  # a code and seven bits of its first byte fit into 32 bits


def code_lengths(counts: np.ndarray, limit: int) -> np.ndarray:
    """Optimal code lengths of at most ``limit`` bits for positive counts, by package-merge."""
    n = len(counts)
    if n <= 1:
        return np.ones(n, np.uint8)
    order = np.argsort(counts, kind="stable")
    weights = counts[order].astype(np.float64)
    packages, leaf_flags = np.zeros(0), []
    for _ in range(limit):
        pairs = packages[: len(packages) // 2 * 2].reshape(-1, 2).sum(axis=1)
        merged = np.concatenate([weights, pairs])
        by_weight = np.argsort(merged, kind="stable")
        leaf_flags.append(by_weight < n)
        packages = merged[by_weight]
    lengths, take = np.zeros(n, np.uint8), 2 * (n - 1)
    for flags in reversed(leaf_flags):
        leaves = int(flags[:take].sum())
        lengths[:leaves] += 1
        take = 2 * (take - leaves)
    out = np.empty(n, np.uint8)
    out[order] = lengths
    return out


class Code:
    """The canonical code of a dense array of code lengths by id (0: the id never occurs)."""

    def __init__(self, lengths: np.ndarray):
        self.lengths = lengths.astype(np.uint8)
        used = np.flatnonzero(self.lengths)
        order = used[np.lexsort((used, self.lengths[used]))]
        sizes = self.lengths[order].astype(np.int64)
        self.bits = int(sizes.max()) if len(sizes) else 1
        share = np.int64(1) << (self.bits - sizes)
        first = np.cumsum(share) - share
        self.codes = np.zeros(len(lengths), np.uint64)
        self.codes[order] = (first >> (self.bits - sizes)).astype(np.uint64)
        self.symbol = np.zeros(1 << self.bits, np.uint32)
        self.symbol[: share.sum()] = np.repeat(order, share)
        self.size = np.ones(1 << self.bits, np.uint8)
        self.size[: share.sum()] = np.repeat(sizes, share)

    @classmethod
    def of_counts(cls, counts: dict[int, int], limit: int = 16) -> Code:
        ids = np.array(sorted(counts), np.int64)
        dense = np.zeros(int(ids.max()) + 1 if len(ids) else 1, np.uint8)
        if len(ids):
            limit = max(limit, int(len(ids) - 1).bit_length())
            if limit > MAX_BITS:
                raise ValueError(f"{len(ids)} ids need codes of more than {MAX_BITS} bits")
            dense[ids] = code_lengths(np.array([counts[int(i)] for i in ids]), limit)
        return cls(dense)

    def book(self) -> bytes:
        return zlib.compress(self.lengths.tobytes())

    @classmethod
    def from_book(cls, data: bytes) -> Code:
        return cls(np.frombuffer(zlib.decompress(data), np.uint8))

    def encode(self, ids: np.ndarray, interval: int) -> tuple[bytes, int, np.ndarray]:
        """The code bytes, the number of bits, and the bit offset of every interval-th id."""
        sizes = self.lengths[ids].astype(np.int64)
        ends = np.cumsum(sizes)
        starts = ends - sizes
        total = int(ends[-1]) if len(ids) else 0
        word = starts >> 5
        value = self.codes[ids] << (64 - sizes - (starts & 31)).astype(np.uint64)
        # the bits of different ids never overlap, so sums below 2**32 are unions
        n = (total >> 5) + 2
        high = np.bincount(word, (value >> np.uint64(32)).astype(np.float64), n)
        low = np.bincount(word + 1, (value & np.uint64(0xFFFFFFFF)).astype(np.float64), n)
        return (high + low).astype(">u4").tobytes()[: (total + 7) // 8], total, starts[::interval]

    def decode(self, data: bytes, n: int, checkpoints: np.ndarray, interval: int) -> np.ndarray:
        raw = np.frombuffer(data + bytes(8), np.uint8).astype(np.uint32)
        window = (raw[:-3] << 24) | (raw[1:-2] << 16) | (raw[2:-1] << 8) | raw[3:]
        lanes = len(checkpoints)
        out = np.zeros((interval, lanes), np.uint32)
        at, last, shift = checkpoints.astype(np.int64), len(window) - 1, np.uint32(32 - self.bits)
        for step in range(min(interval, n)):
            live = lanes if step < n - (lanes - 1) * interval else lanes - 1
            at = at[:live]
            bits = (window[np.minimum(at >> 3, last)] << (at & 7).astype(np.uint32)) >> shift
            out[step, :live] = self.symbol[bits]
            at = at + self.size[bits]
        return out.T.reshape(-1)[:n]


def files_at(path: str):
    """pyarrow's file system and path of a folder or file in the shared folder."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def write_block(doc_ids: list, sizes: list[int], ids: np.ndarray, code: Code, interval: int, numeric: bool) -> bytes:
    data, bits, checkpoints = code.encode(ids, interval)
    if numeric:
        keys = np.array([x or 0 for x in doc_ids], "<i8").tobytes()
    else:
        keys = b"".join(struct.pack("<I", len(b := (x or "").encode())) + b for x in doc_ids)
    return b"".join((
        struct.pack("<IIQQ", len(doc_ids), interval, len(ids), bits), keys, np.array([x is None for x in doc_ids], np.uint8).tobytes(),
        np.array(sizes, "<u4").tobytes(), checkpoints.astype("<u8").tobytes(), data))


def read_block(data: bytes, code: Code, numeric: bool) -> tuple[list, list[int], np.ndarray]:
    docs, interval, n, _ = struct.unpack_from("<IIQQ", data)
    at = 24
    if numeric:
        doc_ids = np.frombuffer(data, "<i8", docs, at).tolist()
        at += 8 * docs
    else:
        doc_ids = []
        for _ in range(docs):
            (size,) = struct.unpack_from("<I", data, at)
            doc_ids.append(data[at + 4 : at + 4 + size].decode())
            at += 4 + size
    nulls = np.frombuffer(data, np.uint8, docs, at)
    at += docs
    sizes = np.frombuffer(data, "<u4", docs, at).tolist()
    at += 4 * docs
    lanes = -(-n // interval)
    checkpoints = np.frombuffer(data, "<u8", lanes, at)
    ids = code.decode(data[at + 8 * lanes :], n, checkpoints, interval)
    return [None if gone else x for x, gone in zip(doc_ids, nulls, strict=True)], sizes, ids


def tokenized(docs: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    """doc_id, n_tokens, ids (unsigned 16-bit where the vocabulary allows it, else 32-bit)."""
    docs = docs.select("doc_id", "text")
    numeric = docs.schema["doc_id"].dataType.simpleString() in ("bigint", "int", "smallint", "tinyint")
    key = pa.int64() if numeric else pa.string()
    schema = pa.schema([("doc_id", key), ("n_tokens", pa.int64()), ("ids", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            found = tokens.encode(tokenizer, utf8(rows.column("text")), end_id)
            yield batch(schema, rows.column("doc_id").cast(key), [len(x) // 4 for x in found], [narrow(np.frombuffer(x, "<u4")) for x in found])

    return docs.mapInArrow(run, f"doc_id {'bigint' if numeric else 'string'}, n_tokens bigint, ids binary")


def narrow(ids: np.ndarray) -> bytes:
    """A mark of the width, then the ids in it."""
    return b"\x02" + ids.astype("<u2").tobytes() if not len(ids) or ids.max() < 1 << 16 else b"\x04" + ids.tobytes()


def wide(data: bytes) -> np.ndarray:
    return np.frombuffer(data, f"<u{data[0]}", -1, 1).astype(np.uint32)


def id_counts(rows: DataFrame) -> dict[int, int]:
    """How often each id occurs; as many entries as the vocabulary has at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for part in batches:
            for data in part.column("ids").to_pylist():
                got = np.bincount(wide(data))
                if len(got) > len(total):
                    got[: len(total)] += total
                    total = got
                else:
                    total[: len(got)] += got
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(total[used], pa.int64())], names=["id", "n"])

    found = rows.select("ids").mapInArrow(run, "id bigint, n bigint").groupBy("id").agg(F.sum("n").alias("n")).toArrow()
    return dict(zip(found.column("id").to_pylist(), found.column("n").to_pylist(), strict=True))


def write(docs: DataFrame, folder: str, tokenizer: str, end_id: int = 2, limit: int = 16, interval: int = 256,
          block_tokens: int = 1 << 20, file_tokens: int = 1 << 24) -> DataFrame:
    """Writes the files and returns their manifest, a row per block.

    Columns: part, path, block, at (byte offset), size, n_tokens.  A task that is run again
    writes a file of another name; the manifest names the one that counts.
    """
    spark = docs.sparkSession
    rows = staged(tokenized(docs, tokenizer, end_id), "ids")
    numeric = rows.schema["doc_id"].dataType.simpleString() == "bigint"
    code = Code.of_counts(id_counts(rows), limit)
    target, path = files_at(folder)
    target.create_dir(path, recursive=True)
    with target.open_output_stream(f"{path}/codebook") as out:
        out.write(code.book())
    total = rows.agg(F.sum("n_tokens")).first()[0] or 0
    schema = pa.schema([("part", pa.int64()), ("path", pa.string()), ("block", pa.int64()), ("at", pa.int64()), ("size", pa.int64()), ("n_tokens", pa.int64())])
    lengths = code.lengths

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, code, out, at = TaskContext.get().partitionId(), Code(lengths), None, 0
        fs, base = files_at(folder)
        name, found = f"{base}/part-{part:06d}-{uuid.uuid4().hex}.huff", []
        doc_ids, ids, held = [], [], 0

        def flush() -> None:
            nonlocal at, held
            data = write_block(doc_ids, [len(x) for x in ids], np.concatenate(ids), code, interval, numeric)
            out.write(data)
            found.append((part, name, len(found), at, len(data), held))
            at, held = at + len(data), 0
            doc_ids.clear()
            ids.clear()

        for rows in batches:
            for doc, data in zip(rows.column("doc_id").to_pylist(), rows.column("ids").to_pylist(), strict=True):
                out = out or fs.open_output_stream(name)
                doc_ids.append(doc)
                ids.append(wide(data))
                held += len(ids[-1])
                if held >= block_tokens:
                    flush()
        if doc_ids:
            flush()
        if out:
            out.close()
        yield batch(schema, *([x[i] for x in found] for i in range(6)))

    ordered = rows.withColumn("tie", F.md5("ids")).repartitionByRange(max(1, -(-total // file_tokens)), "doc_id", "tie").sortWithinPartitions("doc_id", "tie")
    return staged(ordered.select("doc_id", "ids").mapInArrow(run, "part bigint, path string, block bigint, at bigint, size bigint, n_tokens bigint"), "manifest")


def read(spark: SparkSession, folder: str, manifest: DataFrame, numeric: bool = True) -> DataFrame:
    """The documents of the files: doc_id, start, n_tokens, ids (little-endian 32-bit)."""
    parts = manifest.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before_part"))
    blocks = manifest.join(before, "part").withColumn("first", F.col("before_part") + F.sum("n_tokens").over(Window.partitionBy("part").orderBy("block")) - F.col("n_tokens"))
    key = pa.int64() if numeric else pa.string()
    schema = pa.schema([("doc_id", key), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        target, base = files_at(folder)

        def load() -> Code:
            with target.open_input_stream(f"{base}/codebook") as source:
                return Code.from_book(source.read())

        code = None
        for rows in batches:
            for path, at, size, first in zip(*(rows.column(c).to_pylist() for c in ("path", "at", "size", "first")), strict=True):
                code = code or load()
                with target.open_input_file(path) as source:
                    source.seek(at)
                    doc_ids, sizes, ids = read_block(source.read(size), code, numeric)
                ends = np.cumsum(sizes)
                data, starts = ids.astype("<u4").tobytes(), ends - sizes
                yield batch(schema, doc_ids, starts + first, sizes, [data[4 * a : 4 * b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)])

    dealt = blocks.select("path", "at", "size", "first").repartition(spark.sparkContext.defaultParallelism * 2, "path", "at")
    return dealt.mapInArrow(run, f"doc_id {'bigint' if numeric else 'string'}, start bigint, n_tokens bigint, ids binary")


def round_trip(docs: DataFrame, tokenizer: str, end_id: int = 2) -> DataFrame:
    """Writes the documents and reads them back: doc_id, start, n_tokens, ids_crc32."""
    spark = docs.sparkSession
    folder = new_folder(spark, "huffman")
    manifest = write(docs, folder, tokenizer, end_id)
    numeric = docs.schema["doc_id"].dataType.simpleString() in ("bigint", "int", "smallint", "tinyint")
    return read(spark, folder, manifest, numeric).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
