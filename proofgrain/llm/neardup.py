"""Near-duplicate groups: MinHash bands, verified links, large-star and small-star components.

A document's set is its distinct word shingles (a shorter text: the whole word sequence as
one; no words: empty, and linked with nothing).  Documents of one set are one node.  Minima of
universal hash functions make a signature; its bands are buckets of candidates.  Two nodes are
linked where their whole sets have at least the given Jaccard similarity.

Buckets are never turned into all their pairs.  Links are looked for in three rounds, and each
round leaves out pairs that are connected already:
1. every node with the smallest node of any of its buckets,
2. every node with the smallest node of each of its buckets,
3. in buckets that still hold several components, the nodes outside the largest one with all
   others, in blocks of bounded size, where the signatures agree well enough: first to see
   which nodes have anything to be compared with, then with the sets of these.
Round 3 looks at every pair that could still join two components, so no group is missed.

The similarity asked for is given in percent, and a ``Rule`` follows from it: as many bands of
5 minima as it takes for two documents at it to share no bucket with a chance of at most 1e-6
(24 at 85 percent, 35 at 80), and for round 3 an agreement of signatures 6 standard deviations
below theirs.

Null text has no words.  Rows that repeat a doc_id and text get the same result each.  A null
doc_id counts as the largest.  Empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from proofgrain.llm.common import batch, kept, let_go, release, row_key, slices, small, staged, unused, utf8

WORDS, ROWS = 5, 5
SIMILAR = 85  # percent
MISSED, DEVIATIONS = 1e-6, 6
BLOCK = 2048
WORDS_KEPT = 150_000
SEED = 20240501
MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD)]


class Rule:
    """The bands, hash functions and agreement of signatures that a similarity asks for."""

    def __init__(self, percent: int):
        alike = percent / 100
        self.percent, self.bands = percent, math.ceil(math.log(MISSED) / math.log1p(-(alike**ROWS))) if percent < 100 else 1
        self.minima = self.bands * ROWS
        self.agreeing = math.floor(100 * (alike - DEVIATIONS * math.sqrt(alike * (1 - alike) / self.minima))) / 100
        seed = np.random.RandomState(SEED)
        self.factors = (seed.randint(0, 2**31, (self.minima, 1)).astype(np.uint32) << 1) | np.uint32(1)
        self.offsets = seed.randint(0, 2**31, (self.minima, 1)).astype(np.uint32) * np.uint32(2) + seed.randint(0, 2, (self.minima, 1)).astype(np.uint32)


@functools.cache
def rule(percent: int) -> Rule:
    return Rule(percent)


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def shingle_set(words: list[bytes], hashes: WordHashes, width: int = WORDS) -> np.ndarray:
    """The sorted distinct 64-bit hashes of a word sequence's shingles."""
    h = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    if not len(h):
        return h
    n = min(width, len(h))
    out = np.full(len(h) - n + 1, n, np.uint64)
    for i in range(n):
        out = (out ^ (h[i : len(h) - n + 1 + i] * MIX[i % len(MIX)])) * MIX[(i + 1) % len(MIX)]
        out ^= out >> np.uint64(29)
    return np.unique(out)


def shingle_sets(texts: list[bytes]) -> Iterator[np.ndarray]:
    hashes = kept("word_hashes", WordHashes)
    for a, b in slices(texts, 4_000_000):
        for text in texts[a:b]:
            yield shingle_set(text.lower().split(), hashes)
        while len(hashes) > WORDS_KEPT:
            hashes.popitem()


def signature(values: np.ndarray, percent: int = SIMILAR) -> np.ndarray:
    """The minima of the rule's universal hash functions over a set."""
    asked = rule(percent)
    x = (values >> np.uint64(32)).astype(np.uint32)
    best = np.full(asked.minima, 2**32 - 1, np.uint32)
    for i in range(0, len(x), 4096):
        np.minimum(best, (asked.factors * x[i : i + 4096] + asked.offsets).min(axis=1), out=best)
    return best


def signatures(docs: DataFrame, percent: int = SIMILAR) -> DataFrame:
    """key, doc_id, n_shingles, node (digest of the set, null if empty), signature."""
    rows = docs.select("doc_id", "text").select(row_key("doc_id", "text").alias("key"), F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    schema = pa.schema([("key", pa.binary()), ("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("node", pa.binary()), ("signature", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in small(batches):
            sizes, nodes, found = [], [], []
            for values in shingle_sets(utf8(part.column("text"))):
                sizes.append(len(values))
                nodes.append(xxhash.xxh3_128_digest(values.tobytes()) if len(values) else None)
                found.append(signature(values, percent).tobytes() if len(values) else None)
            yield batch(schema, part.column("key"), part.column("doc_id"), sizes, nodes, found)

    return rows.mapInArrow(run, "key binary, doc_id bigint, n_shingles bigint, node binary, signature binary")


def whole_sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """node, hashes of the wanted rows (key, node)."""
    rows = docs.select("doc_id", "text").select(row_key("doc_id", "text").alias("key"), "text").join(wanted, "key")
    schema = pa.schema([("node", pa.binary()), ("hashes", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in small(batches):
            yield batch(schema, part.column("node"), [x.tobytes() for x in shingle_sets(utf8(part.column("text")))])

    return rows.select("node", "text").mapInArrow(run, "node binary, hashes binary")


def similar(a: np.ndarray, b: np.ndarray, percent: int = SIMILAR) -> bool:
    """Whether two sorted sets have 100 * intersection >= percent * union."""
    most = min(len(a), len(b))
    if 100 * most < percent * max(len(a), len(b)):
        return False
    at = np.minimum(np.searchsorted(a, b), len(a) - 1)
    both = int((a[at] == b).sum())
    return 100 * both >= percent * (len(a) + len(b) - both)


def linked(pairs: DataFrame, sets: DataFrame, percent: int = SIMILAR) -> DataFrame:
    """The pairs (a, b) whose whole sets are similar.

    The set of ``a`` is sent once to each block of at most about BLOCK partners.
    """
    pairs = pairs.distinct()
    blocks = pairs.groupBy("a").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    members = pairs.join(blocks, "a").withColumn("block", F.pmod(F.xxhash64("b"), F.col("blocks")).cast("int"))
    beside = members.select("a", "block", "b").join(sets.withColumnRenamed("node", "b"), "b").select("a", "block", "b", "hashes")
    heads = blocks.select("a", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block")).join(sets.withColumnRenamed("node", "a"), "a").select("a", "block", F.lit(None).cast("binary").alias("b"), "hashes")
    dealt = heads.unionByName(beside).repartition("a", "block").sortWithinPartitions("a", "block", F.asc_nulls_first("b"))
    schema = pa.schema([("a", pa.binary()), ("b", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go("word_hashes")
        mine, head = b"", np.zeros(0, np.uint64)
        for part in small(batches):
            out: tuple[list, list] = ([], [])
            for a, b, hashes in zip(part.column("a").to_pylist(), part.column("b").to_pylist(), part.column("hashes").to_pylist(), strict=True):
                values = np.frombuffer(hashes, np.uint64)
                if b is None:
                    mine, head = a, values
                elif a == mine and similar(head, values, percent):
                    out[0].append(a)
                    out[1].append(b)
            yield batch(schema, *out)

    return dealt.mapInArrow(run, "a binary, b binary").distinct()


def star(edges: DataFrame, large: bool) -> DataFrame:
    """One large-star or small-star step over edges (u, v) with u > v.

    Large: every larger neighbour of a node moves to the smallest of its neighbours and itself.
    Small: a node and its smaller neighbours move to the smallest of these.
    """
    around = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges
    least = around.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    moved = around.join(least, "u")
    if large:
        out = moved.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = moved.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return out.where("u <> v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """u, v: every node of the edges (a, b) but the smallest of its component, beside that."""
    now = staged(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges")

    def state(df: DataFrame):
        return df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()

    before = state(now)
    while before[0]:
        last, now = now, staged(star(star(now, True), False), "stars")
        release(last)
        after = state(now)
        if after == before:
            break
        before = after
    return now


BESIDE = "band int, bucket bigint, m int, s int, side int, node binary, root binary, signature binary"
KEYS = ["band", "bucket", "m", "s"]


def mixed_blocks(buckets: DataFrame, roots: DataFrame, prints: DataFrame) -> DataFrame:
    """The buckets that still hold several components, in blocks: nodes outside the largest
    component (side 0) beside nodes of the whole bucket (side 1)."""
    rooted = buckets.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    per_root = rooted.groupBy("band", "bucket", "root").agg(F.count("*").alias("n"))
    mixed = per_root.groupBy("band", "bucket").agg(F.count("*").alias("roots"), F.sum("n").alias("n"), F.max(F.struct("n", "root")).alias("top")).where("roots > 1").select(
        "band", "bucket", F.col("top.root").alias("top"), F.ceil(F.col("n") / BLOCK).cast("int").alias("m_blocks"), F.ceil((F.col("n") - F.col("top.n")) / BLOCK).cast("int").alias("s_blocks"))
    members = rooted.join(mixed, ["band", "bucket"]).join(prints, "node")
    place = F.xxhash64("node")
    every = members.select("band", "bucket", F.pmod(place, F.col("m_blocks")).cast("int").alias("m"), F.explode(F.sequence(F.lit(0), F.col("s_blocks") - 1)).alias("s"), F.lit(1).alias("side"), "node", "root", "signature")
    strays = members.where("root <> top").select("band", "bucket", F.explode(F.sequence(F.lit(0), F.col("m_blocks") - 1)).alias("m"), F.pmod(place, F.col("s_blocks")).cast("int").alias("s"), F.lit(0).alias("side"), "node", "root", "signature")
    return strays.unionByName(every)


def dealt_blocks(rows: DataFrame) -> DataFrame:
    return rows.repartition(*KEYS).sortWithinPartitions(*KEYS, "side", "node")


def block_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, list[dict]]]:
    """The rows of each block, which arrive together."""
    mine, rows = None, []
    for part in small(batches):
        for row in part.to_pylist():
            key = tuple(row[k] for k in KEYS)
            if key != mine:
                if rows:
                    yield mine, rows
                mine, rows = key, []
            rows.append(row)
    if rows:
        yield mine, rows


def worth_comparing(strays: np.ndarray, roots: list[bytes], member: dict, band: int, percent: int) -> np.ndarray:
    """The strays of another component whose signatures agree well enough with a member's, and
    share no earlier band with it (there, the pair has its turn)."""
    asked = rule(percent)
    same = strays == np.frombuffer(member["signature"], np.uint32)
    earlier = same.reshape(len(strays), asked.bands, ROWS)[:, :band].all(axis=2).any(axis=1)
    return np.array([i for i in np.flatnonzero((same.mean(axis=1) >= asked.agreeing) & ~earlier) if roots[i] != member["root"]], np.int64)


def promising(blocks: DataFrame, percent: int) -> DataFrame:
    """The rows of the blocks that have anything to be compared with."""
    schema = pa.schema([("band", pa.int32()), ("bucket", pa.int64()), ("m", pa.int32()), ("s", pa.int32()), ("side", pa.int32()), ("node", pa.binary()), ("root", pa.binary()), ("signature", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, rows in block_runs(batches):
            strays = [r for r in rows if r["side"] == 0]
            prints, roots = np.array([np.frombuffer(r["signature"], np.uint32) for r in strays]), [r["root"] for r in strays]
            wanted, out = set(), []
            for row in rows[len(strays) :] if strays else ():
                found = worth_comparing(prints, roots, row, key[0], percent)
                if len(found):
                    wanted.update(found.tolist())
                    out.append(row)
            out += [strays[i] for i in sorted(wanted)]
            if out:
                yield batch(schema, *([r[f.name] for r in out] for f in schema))

    return dealt_blocks(blocks).mapInArrow(run, BESIDE)


def across(buckets: DataFrame, roots: DataFrame, prints: DataFrame, sets: DataFrame, percent: int = SIMILAR) -> DataFrame:
    """Round 3: links (a, b) between components, found inside the buckets that hold several."""
    return linked_across(staged(promising(mixed_blocks(buckets, roots, prints), percent), "promising"), sets, percent)


def linked_across(some: DataFrame, sets: DataFrame, percent: int = SIMILAR) -> DataFrame:
    """The links among promising rows of blocks.

    A block passes over pairs that its own links have connected already, so it never makes
    more links than it has nodes.
    """
    schema = pa.schema([("a", pa.binary()), ("b", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, rows in block_runs(batches):
            strays = [r for r in rows if r["side"] == 0]
            prints, roots = np.array([np.frombuffer(r["signature"], np.uint32) for r in strays]), [r["root"] for r in strays]
            held = [np.frombuffer(r["hashes"], np.uint64) for r in strays]
            joined: dict[bytes, bytes] = {}

            def top(x: bytes) -> bytes:
                while x in joined:
                    x = joined[x]
                return x

            out: tuple[list, list] = ([], [])
            for row in rows[len(strays) :] if strays else ():
                values = np.frombuffer(row["hashes"], np.uint64)
                for i in worth_comparing(prints, roots, row, key[0], percent):
                    one, other = top(roots[i]), top(row["root"])
                    if one != other and similar(held[i], values, percent):
                        joined[one] = other
                        out[0].append(strays[i]["node"])
                        out[1].append(row["node"])
            if out[0]:
                yield batch(schema, *out)

    return dealt_blocks(some.join(sets, "node").select(*KEYS, "side", "node", "root", "signature", "hashes")).mapInArrow(run, "a binary, b binary")


def groups(docs: DataFrame, percent: int = SIMILAR) -> DataFrame:
    """Per row: key, doc_id, n_shingles, node, component_id (the smallest doc_id reachable)."""
    return grouped(docs, percent)[0]


def grouped(docs: DataFrame, percent: int = SIMILAR) -> tuple[DataFrame, list[DataFrame]]:
    """The groups, and the staged tables that they read."""
    rows = staged(signatures(docs, percent), "signatures")
    nodes = staged(rows.where("node IS NOT NULL").groupBy("node").agg(F.min("doc_id").alias("least_id"), F.min("key").alias("key"), F.min("signature").alias("signature")), "nodes")
    bands = F.array(*[F.struct(F.lit(b).alias("band"), F.xxhash64(F.substring("signature", 1 + 4 * ROWS * b, 4 * ROWS)).alias("bucket")) for b in range(rule(percent).bands)])
    members = nodes.select("node", F.explode(bands).alias("x")).select("x.band", "x.bucket", "node")
    heads = members.groupBy("band", "bucket").agg(F.min("node").alias("head"), F.count("*").alias("n")).where("n > 1").select("band", "bucket", "head")
    buckets = staged(members.join(heads, ["band", "bucket"]), "buckets")
    wanted = buckets.select("node").distinct().join(nodes, "node").select("key", "node")
    sets = staged(whole_sets(docs, wanted), "sets")

    stars = buckets.where("node <> head").select("head", "node")
    first = stars.groupBy("node").agg(F.min("head").alias("a")).select("a", F.col("node").alias("b"))
    edges = staged(linked(first, sets, percent), "links")
    forest = components(edges)
    release(edges)

    def roots() -> DataFrame:
        return forest.select(F.col("u").alias("node"), F.col("v").alias("root"))

    def rooted(pairs: DataFrame) -> DataFrame:
        """The pairs (a, b) of different components so far."""
        out = pairs
        for side in ("a", "b"):
            out = out.join(roots().select(F.col("node").alias(side), F.col("root").alias(f"{side}_root")), side, "left")
        return out.where(F.coalesce("a_root", "a") != F.coalesce("b_root", "b")).select("a", "b")

    def heads() -> DataFrame:
        return rooted(stars.select(F.col("head").alias("a"), F.col("node").alias("b")).distinct())

    def strays() -> DataFrame:
        return promising(mixed_blocks(buckets.drop("head"), roots(), nodes.select("node", "signature")), percent)

    for name, among, links_of in (("pairs", heads, linked), ("promising", strays, linked_across)):
        some = staged(among(), name)
        links = staged(links_of(some, sets, percent), "links")
        release(some)
        if not links.isEmpty():
            last, forest = forest, components(forest.select(F.col("u").alias("a"), F.col("v").alias("b")).unionByName(links))
            release(last)
        release(links)
    release(buckets, sets)

    labelled = nodes.select("node", "least_id").join(roots(), "node", "left").withColumn("root", F.coalesce("root", "node"))
    smallest = labelled.groupBy("root").agg(F.min("least_id").alias("component_id"))
    named = labelled.select("node", "root").join(smallest, "root").select("node", "root", "component_id")
    out = rows.select("key", "doc_id", "n_shingles", "node").join(named, "node", "left")
    out = out.select("key", "doc_id", "n_shingles", "node", "root", F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))
    return out, [rows, nodes, forest]


def near_duplicates(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, n_shingles, component_id, kept."""
    return groups(docs).select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def one_of_each(docs: DataFrame, percent: int = SIMILAR) -> DataFrame:
    """The documents without near copies of a smaller doc_id; rows that repeat stay once."""
    found, read = grouped(docs, percent)
    alone = found.where("root IS NULL").select("key")
    chosen = found.where("root IS NOT NULL").groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "key")).alias("x")).select("x.key")
    key = unused(docs, "row_key")
    stay = staged(alone.unionByName(chosen).distinct().withColumnRenamed("key", key), "stay")
    release(*read)
    keyed = docs.withColumn(key, row_key("doc_id", "text"))
    return keyed.join(stay, key).dropDuplicates([key]).select(*docs.columns)



SQL = """
WITH RECURSIVE t AS MATERIALIZED (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS MATERIALIZED (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(generate_series(1, greatest(1, len(w) - 4))) AS i FROM t WHERE len(w) > 0)),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
e AS MATERIALIZED (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * shared >= 85 * (x.n + y.n - shared)),
u AS MATERIALIZED (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r(a, b) AS (SELECT doc_id, doc_id FROM t UNION SELECT r.a, u.b FROM r JOIN u ON r.b = u.a)
SELECT t.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, c.component_id, t.doc_id = c.component_id AS kept
FROM t LEFT JOIN n USING (doc_id) JOIN (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY a) c USING (doc_id)
"""
