"""Whitening of embeddings over distinct vectors and how often each occurs.

1. Components become integers.  Rows of the same integers are one vector; how many there are
   is its weight in the fit (or one, without ``weighted``).  They are counted in slices of a
   vector's rows first, so a vector of very many rows is never one task's work.
2. Sums are exact integers.  The covariance is the weighted product of the centred distinct
   vectors with themselves: every task multiplies its own, and the squares are added up.
3. Every distinct vector is centred, projected on the leading eigenvectors and scaled, once,
   and joined back to its rows, again by vector and slice.

The driver sees sums and products of the dimensions only, never vectors.

Rows take no part if their vector is null or empty, holds null or non-finite entries, or one
whose integer is 2**40 or beyond, or if it has another dimension than most rows (of two equally
frequent ones, the larger counts).  ``deviation`` is null where it passes 64 bits.  A component
without variance has a null ``whitened`` and does not count in ``identity_error``; where no
vector differs, ``explained`` and ``identity_error`` are null.  Rows that repeat a vec_id, and
those without one, get rows of their own.  Empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from proofgrain.llm.common import batch, staged

SCALE, SHIFT, COMPONENTS = 1024, 100_000, 8
LIMIT, SALTS, LOW = 1 << 40, 64, 20
ROWS = "vec_id bigint, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"


def integers(rows: DataFrame, scale: int, shift: int) -> DataFrame:
    """vec_id, x (integer components), key of x, and the slice of its rows."""
    held = F.forall("c", lambda c: c.isNotNull() & (F.abs(c) < float((LIMIT - shift) // scale)))
    clean = rows.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("embedding").cast("array<double>").alias("c")).where((F.size("c") > 0) & held)
    x = clean.select("vec_id", F.transform("c", lambda c: F.floor(c * scale).cast("bigint") + F.lit(shift).cast("bigint")).alias("x"))
    return x.select("vec_id", "x", F.unhex(F.md5(F.col("x").cast("string"))).alias("key"), F.pmod(F.xxhash64("vec_id"), F.lit(SALTS)).cast("int").alias("salt"))


def arrays(part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """The vectors of a batch as rows of a matrix, and their weights."""
    weight = part.column("weight").to_numpy(zero_copy_only=False)
    return np.asarray(part.column("x").flatten(), np.int64).reshape(len(weight), -1), weight


def sums(vectors: DataFrame) -> DataFrame:
    """Per dimension, weighted sums of the high and the low parts of the integers, and the
    largest size."""
    schema = pa.schema([("i", pa.int32()), ("high", pa.int64()), ("low", pa.int64()), ("most", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for part in batches:
            if part.num_rows:
                x, weight = arrays(part)
                found = np.stack([weight @ (x >> LOW), weight @ (x & ((1 << LOW) - 1)), np.abs(x).max(axis=0)])
                total = found if total is None else np.concatenate([total[:2] + found[:2], np.maximum(total[2:], found[2:])])
        if total is not None:
            yield batch(schema, np.arange(total.shape[1], dtype=np.int32), *total)

    parts = vectors.select("x", "weight").mapInArrow(run, "i int, high bigint, low bigint, most bigint")
    return parts.groupBy("i").agg(F.sum("high").alias("high"), F.sum("low").alias("low"), F.max("most").alias("most"))


def scaled_deviations(x: np.ndarray, n: int, total: list[int], most: int) -> np.ndarray:
    """n * x - S, exact: 64-bit integers where they suffice, else Python's."""
    if 2 * n * max(1, most) < 1 << 62:
        return x * n - np.array(total, np.int64)
    return x.astype(object) * n - np.array(total, object)


def products(vectors: DataFrame, n: int, total: list[int], most: int) -> DataFrame:
    """The upper triangle of the weighted product of the centred vectors with themselves."""
    schema = pa.schema([("i", pa.int32()), ("j", pa.int32()), ("v", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        square = None
        for part in batches:
            if part.num_rows:
                x, weight = arrays(part)
                centred = scaled_deviations(x, n, total, most).astype(np.float64) / n
                found = (centred * weight[:, None]).T @ centred
                square = found if square is None else square + found
        if square is not None:
            i, j = np.triu_indices(len(square))
            yield batch(schema, i.astype(np.int32), j.astype(np.int32), square[i, j])

    return vectors.select("x", "weight").mapInArrow(run, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v"))


@dataclass
class Fit:
    """What whitening needs: the size of the fit list, sums, eigenvectors and eigenvalues."""

    n: int
    total: list[int]
    most: int
    axes: np.ndarray
    values: np.ndarray
    trace: float

    def explained(self) -> list[float | None]:
        return [float(v) / self.trace if self.trace > 0 else None for v in self.values]

    def varies(self) -> np.ndarray:
        """Which components have a variance beyond rounding."""
        floor = 64 * np.finfo(float).eps * len(self.total) * (self.values[0] if len(self.values) else 0)
        return self.values > max(floor, 0.0)


def fitted(vectors: DataFrame, components: int) -> Fit:
    n = vectors.agg(F.sum("weight")).first()[0]
    found = sums(vectors).orderBy("i").collect()  # a row per dimension
    total, most = [(r.high << LOW) + r.low for r in found], max(r.most for r in found)
    square = products(vectors, n, total, most).toArrow()
    i, j, v = (square.column(c).to_numpy() for c in ("i", "j", "v"))
    covariance = np.zeros((len(total), len(total)))
    covariance[i, j] = covariance[j, i] = v / n
    values, axes = np.linalg.eigh(covariance)
    first = np.argsort(-values, kind="stable")[:components]
    return Fit(n, total, most, axes[:, first], np.maximum(values[first], 0.0), float(np.trace(covariance)))


def exact_squares(scaled: np.ndarray) -> list[int | None]:
    """Sums of squares, None where one passes 64 bits."""
    about = (scaled.astype(np.float64) ** 2).sum(axis=1)
    small = about < 2.0**62
    out: list[int | None] = [None] * len(scaled)
    for at, value in zip(np.flatnonzero(small).tolist(), (scaled[small].astype(np.int64) ** 2).sum(axis=1).tolist(), strict=True):
        out[at] = value
    for at in np.flatnonzero(~small).tolist():
        value = sum(int(v) ** 2 for v in scaled[at])
        out[at] = value if value < 1 << 63 else None
    return out


def whitened(vectors: DataFrame, fit: Fit) -> DataFrame:
    """key, weight, deviation and whitened (an array) of every distinct vector."""
    schema = pa.schema([("key", pa.binary()), ("weight", pa.int64()), ("deviation", pa.int64()), ("whitened", pa.list_(pa.float64()))])
    varies = fit.varies()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            if not part.num_rows:
                continue
            x, _ = arrays(part)
            scaled = scaled_deviations(x, fit.n, fit.total, fit.most)
            placed = scaled.astype(np.float64) / fit.n @ fit.axes
            white = placed / np.sqrt(np.where(varies, fit.values, 1.0))
            rows = white.tolist() if varies.all() else [[v if ok else None for v, ok in zip(r, varies, strict=True)] for r in white.tolist()]
            yield batch(schema, part.column("key"), part.column("weight"), exact_squares(scaled), rows)

    return vectors.mapInArrow(run, "key binary, weight bigint, deviation bigint, whitened array<double>")


def identity_error(white: DataFrame, fit: Fit) -> float | None:
    """The largest entry of |covariance of the whitened fit list - identity|."""
    used = np.flatnonzero(fit.varies()).tolist()
    if not used:
        return None
    at = {c: F.col("whitened")[c] for c in used}
    pairs = [(a, b) for a in used for b in used if a <= b]
    found = white.agg(*(F.sum(F.col("weight") * at[a]) for a in used), *(F.sum(F.col("weight") * at[a] * at[b]) for a, b in pairs)).first()
    mean = {a: found[i] / fit.n for i, a in enumerate(used)}
    return max(abs(found[len(used) + i] / fit.n - mean[a] * mean[b] - (a == b)) for i, (a, b) in enumerate(pairs))


def whiten(embeddings: DataFrame, scale: int = SCALE, shift: int = SHIFT, components: int = COMPONENTS, weighted: bool = True) -> DataFrame:
    """Per row and component: vec_id, component, n, deviation, whitened, explained,
    identity_error."""
    rows = integers(embeddings, scale, shift)
    counted = staged(rows.groupBy("key", "salt", "x").agg(F.count("*").alias("weight")), "counted")
    usual = counted.groupBy(F.size("x").alias("dim")).agg(F.sum("weight").alias("n")).orderBy(F.desc("n"), F.desc("dim")).first()
    if usual is None:
        return embeddings.sparkSession.createDataFrame([], ROWS)
    same = counted.where(F.size("x") == usual.dim)
    weight = F.sum("weight") if weighted else F.lit(1).cast("bigint")
    vectors = staged(same.groupBy("key", "x").agg(weight.alias("weight")), "distinct")
    fit = fitted(vectors, components)
    white = staged(whitened(vectors, fit), "whitened")
    error = identity_error(white, fit)
    per_slice = same.select("key", "salt").join(white.select("key", "deviation", "whitened"), "key")
    back = rows.select("vec_id", "key", "salt").join(per_slice, ["key", "salt"])
    explained = F.array(*(F.lit(e).cast("double") for e in fit.explained()))
    spread = back.select("vec_id", "deviation", F.posexplode("whitened").alias("at", "whitened"))
    return spread.select(
        "vec_id", (F.col("at") + 1).alias("component"), F.lit(fit.n).cast("bigint").alias("n"), "deviation", "whitened",
        F.get(explained, F.col("at")).alias("explained"), F.lit(error).cast("double").alias("identity_error"))
