"""Removal of repeated byte strings by an enhanced suffix array over sampled suffixes.

A string of ``length`` bytes repeats if it also starts anywhere else.  Every such string holds
a smallest ``gram``-byte hash, its anchor; equal strings have it at the same place.  So the
sampled suffixes that start at anchors, with the bytes before them as far as their windows
reach, hold every repeat, and suffixes with different anchor hashes never share one.

1. A pass over the texts lists each document's anchors with the windows that they stand for.
   Anchors whose hash occurs once are done.  An anchor whose whole context occurs twice is
   done too: all its windows repeat.  Both come from counts, combined before they are sent.
2. The other suffixes, and one of each repeated context, are gathered by anchor hash and
   sorted.  A stack scan over the array of common prefixes lists its intervals; in each, a scan
   over the common left extensions lists the maximal repeats, which differ to the left and to
   the right, with all their occurrences.
3. The bytes under repeats are cut from the texts.

A hash with more than ``large`` different contexts is not gathered: each of its windows is
counted by itself, which needs no group in one place.

Texts are shipped packed.  Null text is empty.  Rows that repeat a doc_id and text count as
places of their own, and each gets its row.  Texts shorter than ``length`` have no repeats.
Empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from proofgrain.llm.common import batch, kept, row_key, staged, utf8

LENGTH, GRAM, LARGE, HOT_SHARE = 400, 48, 20_000, 1_000
SLICE = 1 << 21
PLACE_BITS = np.uint64(28)
BASE = 0x9E3779B97F4A7C55


def powers() -> tuple[np.ndarray, np.ndarray]:
    n = 2 * SLICE
    with np.errstate(over="ignore"):
        return tuple(np.concatenate([[np.uint64(1)], np.cumprod(np.full(n - 1, x, np.uint64))]) for x in (BASE, pow(BASE, -1, 1 << 64)))


def gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """A mixed hash of the ``gram`` bytes that start at each place."""
    up, down = kept("gram_powers", powers)
    total = np.concatenate([[np.uint64(0)], np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)])])
    h = (total[gram:] - total[:-gram]) * down[: len(data) - gram + 1]
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xC2B2AE3D27D4EB4F)
    return h ^ (h >> np.uint64(32))


def sliding_min(v: np.ndarray, width: int) -> np.ndarray:
    n = len(v) - width + 1
    rows = -(-len(v) // width)
    padded = np.full(rows * width, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(v)] = v
    grid = padded.reshape(rows, width)
    ahead = np.minimum.accumulate(grid, axis=1).reshape(-1)
    back = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return np.minimum(back[:n], ahead[width - 1 : width - 1 + n])


def anchors_of(data: bytes, bounds: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """Of texts side by side (bounds: their ends): hash, place, first and last window start."""
    if len(data) < length:
        return tuple(np.zeros(0, t) for t in (np.uint64, np.int64, np.int64, np.int64))
    h = gram_hashes(np.frombuffer(data, np.uint8), gram)
    tagged = (h >> PLACE_BITS << PLACE_BITS) | np.arange(len(h), dtype=np.uint64)
    least = sliding_min(tagged, length - gram + 1)
    starts = np.arange(len(least))
    inside = bounds[np.searchsorted(bounds, starts, "right")] - starts >= length
    starts, least = starts[inside], least[inside]
    new = np.flatnonzero(np.concatenate([[True], (least[1:] != least[:-1]) | (starts[1:] != starts[:-1] + 1)]))[: len(starts)]
    last = np.concatenate([new[1:], [len(starts)]])[: len(new)] - 1
    place = (least[new] & ((np.uint64(1) << PLACE_BITS) - np.uint64(1))).astype(np.int64)
    return h[place], place, starts[new], starts[last]


def anchors(docs: DataFrame, length: int, gram: int) -> DataFrame:
    """key, anchor (hash), context (digest), at, lo, hi: byte offsets of the anchor and of the
    first and last window that it stands for."""
    rows = docs.select("doc_id", "text").select(row_key("doc_id", "text").alias("key"), "text")
    schema = pa.schema([("key", pa.binary()), ("anchor", pa.int64()), ("context", pa.binary()), ("at", pa.int64()), ("lo", pa.int64()), ("hi", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            keys, held, size = part.column("key"), [], 0
            segments = ((i, at, text[at : at + SLICE + length - 1]) for i, text in enumerate(utf8(part.column("text"))) for at in range(0, max(1, len(text) - length + 1), SLICE) if len(text) >= length)
            for segment in segments:
                if held and size + len(segment[2]) > SLICE:
                    yield listed(keys, held)
                    held, size = [], 0
                held.append(segment)
                size += len(segment[2])
            if held:
                yield listed(keys, held)

    def listed(keys: pa.Array, held: list) -> pa.RecordBatch:
        data = b"".join(x[2] for x in held)
        bounds = np.cumsum([len(x[2]) for x in held])
        h, place, lo, hi = anchors_of(data, bounds, length, gram)
        which = np.searchsorted(bounds, lo, "right")
        shift = np.array([x[1] for x in held])[which] - np.concatenate([[0], bounds])[which]
        view = memoryview(data)
        contexts = [xxhash.xxh3_128_digest(view[a : b + length]) for a, b in zip(lo.tolist(), hi.tolist(), strict=True)]
        rows = pa.array(np.array([x[0] for x in held])[which])
        return batch(schema, keys.take(rows), h.view(np.int64), contexts, place + shift, lo + shift, hi + shift)

    return rows.mapInArrow(run, "key binary, anchor bigint, context binary, at bigint, lo bigint, hi bigint")


def packed(docs: DataFrame) -> DataFrame:
    """key, doc_id, and the text's bytes compressed."""
    rows = docs.select("doc_id", "text").select(row_key("doc_id", "text").alias("key"), F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    schema = pa.schema([("key", pa.binary()), ("doc_id", pa.int64()), ("packed", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=3).compress
        for part in batches:
            yield batch(schema, part.column("key"), part.column("doc_id"), [pack(x) for x in utf8(part.column("text"))])

    return rows.mapInArrow(run, "key binary, doc_id bigint, packed binary")


def common(a: bytes, b: bytes) -> int:
    """The length of the common prefix."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    return int((np.frombuffer(a, np.uint8, n) != np.frombuffer(b, np.uint8, n)).argmax())


def intervals(lcp: list[int]) -> Iterator[tuple[int, int, int]]:
    """The common-prefix intervals (value, first, last) of a sorted array, inner ones first;
    lcp[i] is of neighbours i and i + 1."""
    stack: list[tuple[int, int]] = []  # (value, first)
    for i, value in enumerate([*lcp, -1]):
        first = i
        while stack and stack[-1][0] > value:
            top, first = stack.pop()
            yield top, first, i
        if value >= 0 and not (stack and stack[-1][0] == value):
            stack.append((value, first))


def maximal_repeats(lefts: list[bytes], rights: list[bytes], length: int) -> Iterator[tuple[int, int, list[int]]]:
    """Maximal repeats through one anchor: (bytes before it, bytes from it on, occurrences).

    ``rights`` are the suffixes from the anchor on; ``lefts`` the bytes before it, reversed.
    """
    order = sorted(range(len(rights)), key=rights.__getitem__)
    lcp = [common(rights[a], rights[b]) for a, b in zip(order, order[1:])]
    longest = max(map(len, lefts))
    for right, first, last in intervals(lcp):
        if right + longest < length:
            continue
        inner = order[first : last + 1]
        child, number = {}, 0  # of each suffix: which child interval holds it
        for i, x in enumerate(inner):
            number += i > 0 and lcp[first + i - 1] == right
            child[x] = number
        inner.sort(key=lefts.__getitem__)
        lcs = [common(lefts[a], lefts[b]) for a, b in zip(inner, inner[1:])]
        for left, begin, end in intervals(lcs):
            if left + right < length:
                continue
            found = inner[begin : end + 1]
            if any(child[x] != child[found[0]] for x in found):
                yield left, right, found


def gathered(members: DataFrame, texts: DataFrame, length: int) -> DataFrame:
    """anchor, key, at, lo, hi, left (reversed) and right bytes of the given anchors."""
    per_text = members.groupBy("key").agg(F.collect_list(F.struct("anchor", "at", "lo", "hi")).alias("places"))
    joined = texts.select("key", "packed").join(per_text, "key").select("key", "packed", "places")
    schema = pa.schema([("anchor", pa.int64()), ("key", pa.binary()), ("at", pa.int64()), ("lo", pa.int64()), ("hi", pa.int64()), ("left", pa.binary()), ("right", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        for part in batches:
            for i in range(0, part.num_rows, 256):
                some, out = part.slice(i, 256), []
                for key, data, places in zip(some.column("key").to_pylist(), some.column("packed").to_pylist(), some.column("places").to_pylist(), strict=True):
                    text = unpack(data)
                    for p in places:
                        anchor, at, lo, hi = p["anchor"], p["at"], p["lo"], p["hi"]
                        out.append((anchor, key, at, lo, hi, text[lo:at][::-1], text[at : hi + length]))
                yield batch(schema, *([x[c] for x in out] for c in range(7)))

    return joined.mapInArrow(run, "anchor bigint, key binary, at bigint, lo bigint, hi bigint, left binary, right binary")


SPAN = pa.schema([("key", pa.binary()), ("first", pa.int64()), ("last", pa.int64())])
GROUP = pa.schema([("anchor", pa.int64()), ("repeat", pa.binary()), ("length", pa.int64()), ("key", pa.binary()), ("start", pa.int64())])


def by_anchor(suffixes: DataFrame, length: int, spans: bool) -> DataFrame:
    """Spans (key, first, last) of repeated bytes, or the maximal repeats with their occurrences
    (anchor, repeat, length, key, start), of suffixes gathered by anchor."""
    dealt = suffixes.repartition("anchor").sortWithinPartitions("anchor", "key", "at")

    def solved(rows: list[dict]) -> list[tuple]:
        lefts, rights = [r["left"] for r in rows], [r["right"] for r in rows]
        if not spans:
            return [(rows[0]["anchor"], xxhash.xxh3_128_digest(lefts[f[0]][:a][::-1] + rights[f[0]][:b]), a + b, rows[x]["key"], rows[x]["at"] - a) for a, b, f in maximal_repeats(lefts, rights, length) for x in f]
        reach: dict[int, list[int]] = {}
        for left, right, found in maximal_repeats(lefts, rights, length):
            for x in found:
                most = reach.setdefault(x, [0, 0])
                most[0], most[1] = max(most[0], left), max(most[1], right)
        return [(rows[x]["key"], rows[x]["at"] - a, rows[x]["at"] + b) for x, (a, b) in reach.items()]

    schema = SPAN if spans else GROUP

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group: list[dict] = []
        for part in batches:
            out = []
            for row in part.to_pylist():
                if group and group[0]["anchor"] != row["anchor"]:
                    if len(group) > 1:
                        out += solved(group)
                    group = []
                group.append(row)
            if out:
                yield batch(schema, *([x[c] for x in out] for c in range(len(schema))))
        if len(group) > 1:
            out = solved(group)
            yield batch(schema, *([x[c] for x in out] for c in range(len(schema))))

    return dealt.mapInArrow(run, "key binary, first bigint, last bigint" if spans else "anchor bigint, repeat binary, length bigint, key binary, start bigint")


def by_window(suffixes: DataFrame, length: int) -> DataFrame:
    """Spans of the windows that occur more than once, each window counted by itself."""
    schema = pa.schema([("window", pa.binary()), ("key", pa.binary()), ("first", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            for row in part.to_pylist():
                text = memoryview(row["left"][::-1] + row["right"])
                starts = range(row["lo"], row["hi"] + 1)
                yield batch(schema, [xxhash.xxh3_128_digest(text[s - row["lo"] : s - row["lo"] + length]) for s in starts], [row["key"]] * len(starts), list(starts))

    windows = suffixes.mapInArrow(run, "window binary, key binary, first bigint")
    twice = windows.groupBy("window").agg(F.count("*").alias("n")).where("n > 1").select("window")
    return windows.join(twice, "window").select("key", "first", (F.col("first") + length).alias("last"))


def beside(rows: DataFrame, per_anchor: DataFrame) -> DataFrame:
    """Rows with what ``per_anchor`` (anchor, n, ...) says of their anchor; anchors that it does
    not name go.

    An anchor with more than one in ``1 / HOT_SHARE`` of all n is hot.  There are at most
    ``HOT_SHARE`` of those, so they are sent to every task, and no task gets all of their rows.
    """
    per_anchor = staged(per_anchor, "per_anchor")
    limit = (per_anchor.agg(F.sum("n")).first()[0] or 0) // HOT_SHARE
    hot = F.broadcast(per_anchor.where(F.col("n") > limit))
    others = rows.join(hot.select("anchor"), "anchor", "left_anti").join(per_anchor.where(F.col("n") <= limit), "anchor")
    return rows.join(hot, "anchor").unionByName(others)


def marked(docs: DataFrame, length: int, gram: int, large: int) -> DataFrame:
    """The anchors whose hash occurs again: key, anchor, at, lo, hi, again (the whole context
    repeats), sent (a suffix that must be compared) and n_contexts."""
    every = staged(anchors(docs, length, gram), "anchors")
    twice = every.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1")
    rows = staged(beside(every, twice).drop("n"), "repeated_anchors")
    place = F.xxhash64("key", "lo")
    contexts = staged(rows.groupBy("anchor", "context").agg(F.count("*").alias("copies"), F.min(place).alias("chosen")), "contexts")
    per_anchor = contexts.groupBy("anchor").agg(F.count("*").alias("n"), F.sum((F.col("copies") == 1).cast("int")).alias("single"))
    known = beside(contexts, per_anchor).withColumnRenamed("n", "n_contexts").where("copies > 1 OR n_contexts > 1")
    sent = (F.col("single") > 0) & (F.col("n_contexts") > 1) & ((F.col("copies") == 1) | (place == F.col("chosen")))
    return staged(rows.join(known, ["anchor", "context"]).select("key", "anchor", "at", "lo", "hi", (F.col("copies") > 1).alias("again"), sent.alias("sent"), "n_contexts").where("again OR sent"), "marked")


def repeat_groups(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """Every maximal repeat of at least ``length`` bytes through an anchor, with all its
    occurrences among different contexts: anchor, repeat (digest), length, key, start."""
    rows = marked(docs, length, gram, LARGE).where("sent")
    return by_anchor(gathered(rows.select("key", "anchor", "at", "lo", "hi"), packed(docs), length), length, spans=False)


def without_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, large: int = LARGE) -> DataFrame:
    """Per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept (packed bytes),
    removed_share (null for empty texts) and repeated (whether any byte went)."""
    rows, texts = marked(docs, length, gram, large), packed(docs)
    suffixes = gathered(rows.where("sent").select("key", "anchor", "at", "lo", "hi"), texts, length)
    if rows.where(F.col("sent") & (F.col("n_contexts") > large)).isEmpty():
        compared = by_anchor(suffixes, length, spans=True)
    else:
        many = rows.where(F.col("n_contexts") > large).select("anchor").distinct()
        held = staged(suffixes, "suffixes")
        compared = by_anchor(held.join(many, "anchor", "left_anti"), length, spans=True).unionByName(by_window(held.join(many, "anchor", "left_semi"), length))
    spans = staged(compared.unionByName(rows.where("again").select("key", F.col("lo").alias("first"), (F.col("hi") + length).alias("last"))), "spans")
    per_text = spans.groupBy("key").agg(F.collect_set(F.struct("first", "last")).alias("spans"))
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("kept", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack, pack = zstandard.ZstdDecompressor().decompress, zstandard.ZstdCompressor(level=3).compress
        for part in batches:
            out = []
            for doc, data, found in zip(part.column("doc_id").to_pylist(), part.column("packed").to_pylist(), part.column("spans").to_pylist(), strict=True):
                text, at, runs, left = unpack(data), 0, [], []
                for first, last in sorted((s["first"], s["last"]) for s in found or ()):
                    if runs and first <= runs[-1][1]:
                        runs[-1][1] = max(runs[-1][1], last)
                    else:
                        runs.append([first, last])
                for first, last in runs:
                    left.append(text[at:first])
                    at = last
                rest = b"".join(left) + text[at:]
                out.append((doc, len(text), len(text) - len(rest), len(runs), hashlib.sha256(rest).hexdigest(), pack(rest) if runs else data))
            yield batch(schema, *([x[c] for x in out] for c in range(6)))

    joined = texts.join(per_text, "key", "left").select("doc_id", "packed", "spans")
    found = joined.mapInArrow(run, "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, kept binary")
    return found.withColumns({"removed_share": F.try_divide("n_removed", "n_bytes"), "repeated": F.col("n_removed") > 0})
