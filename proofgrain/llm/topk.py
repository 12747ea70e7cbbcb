"""Exact top-k search by distributed histogram selection.

Vectors are cut into blocks, some blocks (about ``HELD`` bytes) make a group, and every group
of queries meets every group of candidates in a task of its own, which scores block by block as
matrix products.  Both sides are shuffled, none is broadcast, so no process holds more than one
group of each.  No score is ever stored.  Instead each query's k-th score
is located: tasks count scores in the bins of the query's current interval, the counts are
added up over all candidates, and the bin that holds the k-th score is the next interval,
until a bin is one score wide.  A last pass keeps the scores at or above that value and ranks
them, ties by the smaller vec_id.

A task reports, for a query, only its upper bins down to the one where its own counts reach
what is sought, and at the last pass the k smallest ids among the ties: what it leaves out
cannot be in the answer.

Scores are exact: integer components, products summed in doubles only where they stay below
2**53.  Vectors that are null or hold null or non-finite components, and rows without a
vec_id, take no part.  Rows that repeat a vec_id are one vector, the smallest.  Vectors of
another dimension than the query's are no candidates.  Empty tables give no rows; other
columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from proofgrain.llm.common import release, staged

BINS = 256
HELD = 1 << 24
OUT = np.iinfo(np.int64).min // 2


def quantized(rows: DataFrame, scale: int = 256) -> DataFrame:
    """vec_id, dim, vec: floor(scale * x) of every component."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    clean = rows.select("vec_id", "embedding").where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()).where(finite)
    one = clean.groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    return one.select("vec_id", F.size("embedding").alias("dim"), F.transform("embedding", lambda x: F.floor(x.cast("double") * scale).cast("bigint")).alias("vec"))


def blocked(vectors: DataFrame, size: int, name: str) -> DataFrame:
    """dim, block, ids and data (vectors of a block side by side, in the least integer type that
    holds them), and the largest norm."""
    count = max(1, -(-vectors.count() // size))
    schema = pa.schema([("dim", pa.int32()), (name, pa.int32()), ("ids", pa.binary()), ("data", pa.binary()), ("norm", pa.float64())])

    def run(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("vec_id")
        dim, block = rows.column("dim")[0].as_py(), rows.column(name)[0].as_py()
        data = np.array(rows.column("vec").combine_chunks().flatten(), np.int64).reshape(len(rows), dim)
        norm = float(np.sqrt((data.astype(np.float64) ** 2).sum(axis=1)).max())
        kind = next((t for t in (np.int16, np.int32) if not data.size or np.iinfo(t).min <= data.min() and data.max() <= np.iinfo(t).max), np.int64)
        return pa.table([[dim], [block], [np.array(rows.column("vec_id"), np.int64).tobytes()], [data.astype(kind).tobytes()], [norm]], schema=schema)

    dealt = vectors.withColumn(name, F.pmod(F.xxhash64("vec_id"), F.lit(count)).cast("int"))
    return staged(dealt.groupBy("dim", name).applyInArrow(run, f"dim int, {name} int, ids binary, data binary, norm double"), name)


def vectors_of(data: bytes, n: int, dim: int) -> np.ndarray:
    return np.frombuffer(data, f"i{len(data) // (n * dim)}" if dim else np.int64).reshape(n, dim)


def scores(asked: dict, block: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Query ids, candidate ids, and their scores; a vector's score with itself is OUT."""
    q_ids, c_ids = np.frombuffer(asked["q_ids"], np.int64), np.frombuffer(block["ids"], np.int64)
    q, c = vectors_of(asked["q_data"], len(q_ids), asked["dim"]), vectors_of(block["data"], len(c_ids), block["dim"])
    exact = asked["q_norm"] * block["norm"] < 2**52
    found = (q.astype(np.float64) @ c.T.astype(np.float64)).astype(np.int64) if exact else q.astype(np.int64) @ c.T.astype(np.int64)
    at = np.minimum(np.searchsorted(c_ids, q_ids), len(c_ids) - 1)
    own = np.flatnonzero(c_ids[at] == q_ids)
    found[own, at[own]] = OUT
    return q_ids, c_ids, found


def met(queries: DataFrame, candidates: DataFrame, run, kinds: str, q_sizes: tuple[int, int], c_sizes: tuple[int, int]) -> DataFrame:
    """``run`` over every group of query blocks and every group of candidate blocks of its
    dimension; of each side: the number of blocks, and how many make a group."""
    groups = [-(-blocks // per) for blocks, per in (q_sizes, c_sizes)]
    keys = ["dim", "q_group", "c_group"]

    def dealt(rows: DataFrame, block: str, own: str, per: int, other: str, count: int) -> DataFrame:
        sent = rows.withColumn(own, F.floor(F.col(block) / per).cast("int")).withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(count - 1))))
        return sent.repartition(groups[0] * groups[1], *keys).groupBy(*keys)

    return dealt(queries, "q_block", "q_group", q_sizes[1], "c_group", groups[1]).cogroup(dealt(candidates, "c_block", "c_group", c_sizes[1], "q_group", groups[0])).applyInArrow(run, kinds)


def top_k(queries: DataFrame, candidates: DataFrame, k: int = 5, q_size: int = 1024, c_size: int = 2048) -> DataFrame:
    """query_id, rank, vec_id, score over quantized vectors."""
    cand = blocked(candidates, c_size, "c_block")
    asked = blocked(queries, q_size, "q_block").select("dim", "q_block", F.col("ids").alias("q_ids"), F.col("data").alias("q_data"), F.col("norm").alias("q_norm"))
    last, norm, c_bytes = cand.agg(F.max("c_block"), F.max("norm"), F.max(F.length("data"))).first()
    q_last, q_norm, q_bytes = asked.agg(F.max("q_block"), F.max("q_norm"), F.max(F.length("q_data"))).first()
    spark = queries.sparkSession
    if last is None or q_last is None:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score bigint")
    if norm * q_norm >= 2**62:
        raise ValueError("scores of these vectors exceed 64 bits")
    # small tables are dealt finer than the memory asks, so that all cores have work
    tasks = 3 * spark.sparkContext.defaultParallelism
    c_sizes = (last + 1, max(1, min(HELD // max(1, c_bytes), (last + 1) // tasks)))
    q_sizes = (q_last + 1, max(1, HELD // max(1, q_bytes)))
    bound = int(norm * q_norm) + 2
    width = -(-(2 * bound + 1) // BINS)
    # of each query: the interval's lower end, and how many scores are sought in it
    state = asked.withColumn("lo", F.lit(None).cast("binary")).withColumn("need", F.lit(None).cast("binary"))
    kinds = "dim int, q_block int, q_ids binary, q_data binary, q_norm double, lo binary, need binary"

    def sought(row: dict, n: int) -> tuple[np.ndarray, np.ndarray]:
        if row["lo"] is None:
            return np.full(n, -bound, np.int64), np.full(n, k, np.int64)
        return np.frombuffer(row["lo"], np.int64), np.frombuffer(row["need"], np.int64)

    def histogram(width: int, span: int):
        schema = pa.schema([("dim", pa.int32()), ("q_block", pa.int32()), ("q", pa.int32()), ("bin", pa.int32()), ("n", pa.int64())])

        def run(asked: pa.Table, blocks: pa.Table) -> pa.Table:
            out = [schema.empty_table()]
            for row in asked.to_pylist() if len(blocks) else []:
                n = len(row["q_ids"]) // 8
                (lo, need), counts = sought(row, n), np.zeros(n * BINS, np.int64)
                for at in range(len(blocks)):
                    past = scores(row, blocks.slice(at, 1).to_pylist()[0])[2] - lo[:, None]
                    inside = (past >= 0) & (past < span)
                    counts += np.bincount((np.arange(n)[:, None] * BINS + past // width)[inside], minlength=n * BINS)
                counts = counts.reshape(-1, BINS)
                above = np.cumsum(counts[:, ::-1], axis=1)[:, ::-1] - counts
                q, b = np.nonzero((counts > 0) & (above < need[:, None]))
                same = np.zeros(len(q), np.int32)
                out.append(pa.table([same + row["dim"], same + row["q_block"], q.astype(np.int32), b.astype(np.int32), counts[q, b]], schema=schema))
            return pa.concat_tables(out)

        return run

    def narrowed(width: int):
        def run(blocks: pa.Table, bins: pa.Table) -> pa.Table:
            row = blocks.to_pylist()[0]
            n = len(row["q_ids"]) // 8
            lo, need = (x.copy() for x in sought(row, n))
            counts = np.zeros((n, BINS), np.int64)
            if len(bins):
                counts[np.array(bins.column("q")), np.array(bins.column("bin"))] = np.array(bins.column("n"))
            down = np.cumsum(counts[:, ::-1], axis=1)
            reached = down >= need[:, None]
            step = np.where(reached.any(axis=1), reached.argmax(axis=1), BINS - 1)
            at = BINS - 1 - step
            rest = need - np.where(step > 0, down[np.arange(n), np.maximum(step - 1, 0)], 0)
            row |= {"lo": (lo + at * width).tobytes(), "need": rest.tobytes()}
            return pa.table({f.name: pa.array([row[f.name]], f.type) for f in blocks.schema}, schema=blocks.schema)

        return run

    span = BINS * width
    while True:
        counted = met(state, cand, histogram(width, span), "dim int, q_block int, q int, bin int, n bigint", q_sizes, c_sizes).groupBy("dim", "q_block", "q", "bin").agg(F.sum("n").alias("n"))
        before, state = state, staged(state.groupBy("dim", "q_block").cogroup(counted.groupBy("dim", "q_block")).applyInArrow(narrowed(width), kinds), "interval")
        release(before)
        if width == 1:
            break
        width, span = -(-width // BINS), width

    def kept(asked: pa.Table, blocks: pa.Table) -> pa.Table:
        schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])
        out = [schema.empty_table()]
        for row in asked.to_pylist() if len(blocks) else []:
            for at in range(len(blocks)):
                q_ids, c_ids, found = scores(row, blocks.slice(at, 1).to_pylist()[0])
                least, _ = sought(row, len(q_ids))
                q, c = np.nonzero(found > least[:, None])
                tq, tc = np.nonzero(found == least[:, None])
                nth = np.arange(len(tq)) - np.searchsorted(tq, tq)  # a block's candidates ascend by id
                q, c = np.concatenate([q, tq[nth < k]]), np.concatenate([c, tc[nth < k]])
                out.append(pa.table([q_ids[q], c_ids[c], found[q, c]], schema=schema))
        return pa.concat_tables(out)

    best = met(state, cand, kept, "query_id bigint, vec_id bigint, score bigint", q_sizes, c_sizes)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return best.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def search(embeddings: DataFrame, every: int = 50, k: int = 5) -> DataFrame:
    """The rows whose vec_id is divisible by ``every``, against all others."""
    vectors = staged(quantized(embeddings), "vectors")
    return top_k(vectors.where(F.col("vec_id") % every == 0), vectors, k)


SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
