"""Ranked lexical search, reversed: documents stream through an index of the items' terms.

The items are few beside the documents, so the inverted index holds their terms and goes to
every task.  It is made in blocks of about ``block`` postings; a block is what is sent at
once, whatever the number of items, and the documents are read once for each.

1. Documents are cut into terms and counted; how often the block's terms occur in each is
   written.  From that come the number of documents holding each term.
2. Every document's counts run through the index and add to the scores of the items that
   share its terms.  A task keeps a heap of the k best documents for each item; scores below
   the least of a full heap are passed over.
3. The tasks' heaps, k rows an item each, are merged by rank.

Scores are whole numbers, summed in doubles only where they stay below 2**53.

Null and empty texts have no terms.  Every row of documents is a document, also where it
repeats a doc_id; null ids come last among equal scores.  Rows of items with the same item_id
and text are one item; other texts under one item_id are items ranked by themselves.  Very long
texts are counted in slices.  Where items or documents are empty there are no rows; other
columns are ignored.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from proofgrain.llm.common import batch, row_key, staged, utf8

TERMS = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
BLOCK, TEXT_SLICE, CELLS = 1_000_000, 1 << 22, 1 << 21
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Every byte as it stands in a term, and a space for those that no term holds.
FOLDED = bytes(ord(chr(b).lower()) if b < 128 and chr(b).isalnum() else b if b >= 128 else 32 for b in range(256))
ROWS = "item_id bigint, rank int, doc_id bigint, score bigint"
NO_ID = 1 << 63  # comes after every 64-bit id


def count_terms(text: bytes, size: int = TEXT_SLICE) -> Counter:
    """How often each term occurs; cut between terms, ``size`` bytes at a time."""
    counts: Counter = Counter()
    folded, at = text.translate(FOLDED), 0
    while at < len(folded):
        end = folded.find(b" ", at + size) if len(folded) - at > size else -1
        end = len(folded) if end < 0 else end
        counts.update(folded[at:end].split())
        at = end
    return counts


@dataclass
class Index:
    """A block of items by their terms: ids of terms, and per term the items that hold it and
    how often."""

    item_ids: list[int | None]
    items: list[bytes]
    terms: dict[bytes, int]
    begin: np.ndarray
    item: np.ndarray
    times: np.ndarray


def index_of(postings: pa.Table) -> Index:
    """From rows (item, item_id, term, times)."""
    item_column, id_column = postings.column("item").to_pylist(), postings.column("item_id").to_pylist()
    ids = dict(zip(item_column, id_column, strict=True))
    items = sorted(ids)
    number = {x: i for i, x in enumerate(items)}
    words = [t.encode() for t in postings.column("term").to_pylist()]
    terms = {t: i for i, t in enumerate(sorted(set(words)))}
    term = np.array([terms[t] for t in words], np.int64)
    item = np.array([number[x] for x in item_column], np.int64)
    times = postings.column("times").to_numpy()
    order = np.lexsort((item, term))
    begin = np.searchsorted(term[order], np.arange(len(terms) + 1))
    return Index([ids[x] for x in items], items, terms, begin, item[order], times[order])


def blocks(items: DataFrame, size: int) -> Iterator[Index]:
    """The items in blocks of about ``size`` postings; an item is never cut."""
    one = items.select(F.col("item_id").cast("bigint").alias("item_id"), "text").distinct()
    folded = one.select(row_key("item_id", "text").alias("item"), "item_id", F.translate("text", UPPER, LOWER).alias("text"))
    words = folded.select("item", "item_id", F.explode(F.regexp_extract_all("text", F.lit(TERMS), F.lit(0))).alias("term"))
    postings = staged(words.groupBy("item", "item_id", "term").agg(F.count("*").alias("times")), "postings")
    n = -(-postings.count() // size)
    for i in range(n):
        some = postings.where(F.pmod(F.xxhash64("item"), F.lit(n)) == i).toArrow()
        if len(some):
            yield index_of(some)


def matched(docs: DataFrame, terms: dict[bytes, int]) -> DataFrame:
    """doc_id, n (its terms), and the ids and counts of those among ``terms``."""
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("ids", pa.binary()), ("times", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            n, ids, times = [], [], []
            for text in utf8(part.column("text")):
                counts = count_terms(text)
                found = [(terms[t], c) for t, c in counts.items() if t in terms]
                n.append(counts.total())
                ids.append(np.array([x[0] for x in found], np.int32).tobytes())
                times.append(np.array([x[1] for x in found], np.int64).tobytes())
            yield batch(schema, part.column("doc_id"), n, ids, times)

    return rows.mapInArrow(run, "doc_id bigint, n bigint, ids binary, times binary")


def holding(counts: DataFrame, size: int) -> np.ndarray:
    """How many documents hold each of the ``size`` terms."""
    schema = pa.schema([("id", pa.int32()), ("df", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for part in batches:
            total += np.bincount(np.frombuffer(b"".join(part.column("ids").to_pylist()), np.int32), minlength=size)
        used = np.flatnonzero(total)
        yield batch(schema, used.astype(np.int32), total[used])

    found = counts.select("ids").mapInArrow(run, "id int, df bigint").groupBy("id").agg(F.sum("df").alias("df")).toArrow()
    df = np.zeros(size, np.int64)
    df[found.column("id").to_numpy()] = found.column("df").to_numpy()
    return df


def scored(counts: DataFrame, index: Index, weight: np.ndarray, n_docs: int, n_terms: int, k: int) -> DataFrame:
    """Every task's k best documents of each item: item, item_id, doc_id, score."""
    schema = pa.schema([("item", pa.binary()), ("item_id", pa.int64()), ("doc_id", pa.int64()), ("score", pa.int64())])
    begin, item, times, n_items = index.begin, index.item, index.times, len(index.items)
    per_term = np.diff(begin)
    # a term adds at most a million times its weight, each time that the item holds it
    most = np.bincount(item, np.repeat(weight, per_term) * times * 1e6, n_items).max(initial=0)
    exact = most < 2**52

    def table_of(rows: dict) -> np.ndarray:
        """Scores of some documents (down) for every item (across)."""
        size = [len(x) // 4 for x in rows["ids"]]
        ids, times_in = np.frombuffer(b"".join(rows["ids"]), np.int32), np.frombuffer(b"".join(rows["times"]), np.int64)
        length = np.array([75 + 25 * n * n_docs // n_terms for n in rows["n"]], np.int64)
        of = np.repeat(np.arange(len(size)), size)
        gain = weight[ids] * ((1_000_000_000 * times_in) // (1000 * times_in + 12 * length[of]))
        many = per_term[ids]
        place = np.repeat(begin[ids] - np.cumsum(many) + many, many) + np.arange(many.sum())
        cell, value = np.repeat(of, many) * n_items + item[place], np.repeat(gain, many) * times[place]
        if exact:
            return np.bincount(cell, value, len(size) * n_items).astype(np.int64).reshape(-1, n_items)
        out = np.zeros(len(size) * n_items, np.int64)
        np.add.at(out, cell, value)
        return out.reshape(-1, n_items)

    def parts(part: pa.RecordBatch) -> Iterator[dict]:
        """Documents whose cells and postings fit in memory together; one at least."""
        ids = part.column("ids").to_pylist()
        cost = [n_items + int(per_term[np.frombuffer(x, np.int32)].sum()) for x in ids]
        at = total = 0
        for i, c in enumerate(cost):
            if total and total + c > CELLS:
                yield part.slice(at, i - at).to_pydict()
                at, total = i, 0
            total += c
        if at < len(cost):
            yield part.slice(at).to_pydict()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heaps: list[list[tuple[int, int]]] = [[] for _ in range(n_items)]
        least = np.ones(n_items, np.int64)  # a score counts from here on
        for part in batches:
            for rows in parts(part):
                table = table_of(rows)
                floor = least
                if len(table) > k:  # below a part's own k-th score nothing can be among the best
                    floor = np.maximum(least, np.partition(table, len(table) - k, axis=0)[len(table) - k])
                down, across = np.nonzero(table >= floor)
                for d, i, score in zip(down.tolist(), across.tolist(), table[down, across].tolist(), strict=True):
                    doc = rows["doc_id"][d]
                    entry, heap = (score, -(NO_ID if doc is None else doc)), heaps[i]
                    if len(heap) < k:
                        heapq.heappush(heap, entry)
                    else:
                        heapq.heappushpop(heap, entry)
                for i in np.unique(across).tolist():
                    if len(heaps[i]) == k:
                        least[i] = heaps[i][0][0]
        out = [(index.items[i], index.item_ids[i], None if -d == NO_ID else -d, s) for i, heap in enumerate(heaps) for s, d in heap]
        for a in range(0, len(out), 100_000):
            yield batch(schema, *([x[c] for x in out[a : a + 100_000]] for c in range(4)))

    return counts.mapInArrow(run, "item binary, item_id bigint, doc_id bigint, score bigint")


def search(docs: DataFrame, items: DataFrame, k: int = 20, block: int = BLOCK) -> DataFrame:
    """item_id, rank, doc_id, score: the k documents that score highest for each item."""
    found = None
    for index in blocks(items, block):
        counts = staged(matched(docs, index.terms), "counts")
        n_docs, n_terms = counts.where("n > 0").agg(F.count("*"), F.sum("n")).first()
        if not n_docs:
            break
        df = holding(counts, len(index.terms))
        weight = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * x + 1))) for x in df.tolist()], np.int64)
        heaps = scored(counts, index, weight, n_docs, n_terms, k)
        found = heaps if found is None else found.unionByName(heaps)
    if found is None:
        return docs.sparkSession.createDataFrame([], ROWS)
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("item_id", "rank", "doc_id", "score")


SQL = rf"""
WITH d AS (
  SELECT row_number() OVER () AS row_id, doc_id, regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '{TERMS}') AS terms FROM documents),
i AS (
  SELECT row_number() OVER () AS item, item_id, regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '{TERMS}') AS terms
  FROM (SELECT DISTINCT item_id, text FROM benchmark)),
it AS (SELECT item, term, count(*) AS times FROM (SELECT item, unnest(terms) AS term FROM i) GROUP BY ALL),
totals AS (SELECT count(*) AS n_docs, CAST(sum(len(terms)) AS BIGINT) AS n_terms FROM d WHERE len(terms) > 0),
dt AS (
  SELECT row_id, term, count(*) AS tf FROM (SELECT row_id, unnest(terms) AS term FROM d)
  WHERE term IN (SELECT term FROM it) GROUP BY ALL),
w AS (
  SELECT term, CAST(floor(1000 * ln((2 * n_docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM dt, totals GROUP BY term, n_docs),
m AS (SELECT row_id, doc_id, 100 - 25 + ((25 * len(terms) * n_docs) // n_terms) AS m FROM d, totals WHERE len(terms) > 0),
s AS (
  SELECT it.item, m.doc_id, CAST(sum(it.times * w.w * ((1000000000 * dt.tf) // (1000 * dt.tf + 12 * m.m))) AS BIGINT) AS score
  FROM it JOIN dt USING (term) JOIN w USING (term) JOIN m USING (row_id) GROUP BY it.item, m.row_id, m.doc_id),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM s WHERE score > 0)
SELECT i.item_id, r.rank, r.doc_id, r.score FROM r JOIN i USING (item) WHERE r.rank <= 20
"""
