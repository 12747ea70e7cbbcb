"""Document quality by co-training of two views, from a few labels.

The text view sees the words and the shape of the text, the metadata view sees language,
source and recorded length.  A document is bad if its label says low quality or toxic.  Each
view is a logistic regression.  In every round both score all unlabelled documents; each
hands its most certain ones to the other as further training rows.  In the end both views are
calibrated on labelled rows kept aside, and their log-odds are added.  A document is rejected
from a probability of ``REJECTED`` on, or from a higher one where that rejects more than
``GOOD_LOST`` of the good rows kept aside.

Features of all documents are written once and scored by Spark.  Only the fit is local: it
sees at most about ``labelled`` labelled rows and ``handed`` rows per round and view, taken by
the hash of their doc_id.  Where labels are few or of one class only, no document is rejected.

Null texts are empty; null metadata is a value of its own, and so is a recorded length that is
no finite number.  A doc_id with several labels is
bad if one of them says so.  Repeated documents get a row each.  Empty tables give no rows;
other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from proofgrain.llm.common import batch, kept, let_go, release, row_key, small, staged, utf8

LABELLED, HANDED, ROUNDS = 16_000, 3_000, 2
CERTAIN, REJECTED, GOOD_LOST = 0.99, 0.4, 0.005
BITS = 20
STEMS = (4, 5)
LEAST_ROWS = 20
UPPER, DIGITS = bytes(range(65, 91)), bytes(range(48, 58))
LETTERS = bytes([*range(65, 91), *range(97, 123), *range(128, 256)])
EDGES = bytes([*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)])
WORDS_KEPT = 150_000
#: Rows widened at once, in tasks and in the fit.
SLICE = 512
FEATURES = "key binary, doc_id bigint, meta array<string>, shape array<float>, words binary"


class WordIds(dict):
    """The hashed ids (little-endian 32-bit) of a word without punctuation at its ends, and of
    how it begins."""

    def __missing__(self, word: bytes) -> bytes:
        bare = word.strip(EDGES)
        parts = [bare, *(bare[:n] + b"*" for n in STEMS if len(bare) > n)]
        found = b"".join([(xxhash.xxh32_intdigest(x) >> (32 - BITS)).to_bytes(4, "little") for x in parts])
        if len(self) < WORDS_KEPT:
            self[word] = found
        return found


def text_features(text: bytes) -> tuple[list[float], np.ndarray]:
    """The shape of a text, and its distinct hashed words and word beginnings."""
    n, words = len(text), text.lower().split()
    ids = kept("word_ids", WordIds)
    distinct = set(words)
    found = np.unique(np.frombuffer(b"".join(map(ids.__getitem__, distinct)), "<i4"))
    lines = [x for x in text.split(b"\n") if x.strip()]

    def share(drop: bytes) -> float:
        return (n - len(text.translate(None, drop))) / max(1, n)

    shape = [
        math.log1p(n), share(UPPER), share(DIGITS), share(LETTERS), share(EDGES), share(b"!?"), share(b"#$%&*|<>{}\\"),
        len(distinct) / max(1, len(words)), math.log1p(len(words)), n / max(1, len(words)), len(set(lines)) / max(1, len(lines)), len(lines) / max(1, len(words))]
    return shape, found


def size_class(n_chars: object) -> str:
    """A recorded length in quarters of powers of two; what is no finite number is ``none``."""
    try:
        value = float(n_chars)  # type: ignore[arg-type]
    except (TypeError, ValueError):
        return "none"
    return str(int(4 * math.log2(1 + max(0.0, value)))) if math.isfinite(value) else "none"


def meta_values(lang: object, source: object, n_chars: object) -> list[str]:
    return [f"lang={lang}", f"source={source}", f"size={size_class(n_chars)}", f"lang={lang}/source={source}"]


def metadata(docs: DataFrame) -> list[Column]:
    """The recorded columns as strings, null where there is none."""
    return [(F.col(c) if c in docs.columns else F.lit(None)).cast("string").alias(c) for c in ("lang", "source", "n_chars")]


def features(docs: DataFrame) -> DataFrame:
    rows = docs.select(row_key("doc_id", "text").alias("key"), F.col("doc_id").cast("bigint").alias("doc_id"), "text", *metadata(docs))
    schema = pa.schema([("key", pa.binary()), ("doc_id", pa.int64()), ("meta", pa.list_(pa.string())), ("shape", pa.list_(pa.float32())), ("words", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some in small(batches, SLICE):
            found = [text_features(x) for x in utf8(some.column("text"))]
            meta = [meta_values(*x) for x in zip(*(some.column(c).to_pylist() for c in ("lang", "source", "n_chars")), strict=True)]
            yield batch(schema, some.column("key"), some.column("doc_id"), meta, [x[0] for x in found], [x[1].tobytes() for x in found])

    return rows.mapInArrow(run, FEATURES)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


class Rows:
    """Rows of sparse binary features (32-bit ids side by side, and where each row begins) and
    dense ones.  Sums over ids go through the rows slice by slice, so what a slice gathers is
    all that is widened."""

    def __init__(self, ids: np.ndarray, begin: np.ndarray, dense: np.ndarray):
        self.ids, self.begin, self.dense, self.n = ids, begin, dense, len(begin) - 1

    def slices(self) -> Iterator[tuple[int, int, np.ndarray]]:
        for a in range(0, self.n, SLICE):
            b = min(self.n, a + SLICE)
            yield a, b, self.ids[self.begin[a] : self.begin[b]]

    def margins(self, weights: np.ndarray, dense_weights: np.ndarray) -> np.ndarray:
        out = self.dense @ dense_weights
        for a, b, ids in self.slices():
            run = np.concatenate([[0.0], np.cumsum(weights[ids])])
            at = self.begin[a : b + 1] - self.begin[a]
            out[a:b] += run[at[1:]] - run[at[:-1]]
        return out

    def spread(self, values: np.ndarray, size: int) -> np.ndarray:
        """Of every id, the sum of the values of the rows that hold it."""
        out = np.zeros(size)
        for a, b, ids in self.slices():
            out += np.bincount(ids, np.repeat(values[a:b], np.diff(self.begin[a : b + 1])), size)
        return out

    def of_ids(self, place: np.ndarray) -> Rows:
        """With the ids that ``place`` gives, without those that it sets to -1."""
        out, end, size = np.empty(len(self.ids), place.dtype), 0, []
        for a, b, ids in self.slices():
            held = place[ids]
            used = held >= 0
            size.append(np.diff(np.concatenate([[0], np.cumsum(used)])[self.begin[a : b + 1] - self.begin[a]]))
            found = held[used]
            out[end : end + len(found)] = found
            end += len(found)
        return Rows(out[:end], np.concatenate([[0], *size]).cumsum(), self.dense)


class Logistic:
    """Ridge logistic regression; ids in fewer than ``least`` rows are not used."""

    def __init__(self, size: int, ridge: float, least: int):
        self.size, self.ridge, self.least = size, ridge, least
        self.weights, self.dense_weights = np.zeros(size), np.zeros(0)
        self.mean = self.scale = np.zeros(0)
        self.slope, self.shift = 1.0, 0.0

    def scaled(self, dense: np.ndarray) -> np.ndarray:
        return np.concatenate([(dense - self.mean) / self.scale, np.ones((len(dense), 1))], axis=1)

    def fit(self, given: Rows, bad: np.ndarray, steps: int = 200) -> None:
        seen = given.spread(np.ones(given.n), self.size)
        used = np.flatnonzero(seen >= self.least)
        place = np.full(self.size, -1, np.int32)
        place[used] = np.arange(len(used))
        self.mean, self.scale = given.dense.mean(axis=0), given.dense.std(axis=0) + 1e-6
        rows = given.of_ids(place)
        rows.dense = self.scaled(given.dense)
        w = np.zeros(len(used) + rows.dense.shape[1])
        first, second = np.zeros_like(w), np.zeros_like(w)
        ridge = np.full(len(w), self.ridge / rows.n)
        ridge[-1] = 0
        for step in range(1, steps + 1):  # Adam over all rows, with a rate that falls to zero
            error = (sigmoid(rows.margins(w[: len(used)], w[len(used) :])) - bad) / rows.n
            slope = np.concatenate([rows.spread(error, len(used)), error @ rows.dense]) + ridge * w
            first, second = 0.9 * first + 0.1 * slope, 0.99 * second + 0.01 * slope * slope
            w -= 0.3 * (1 - step / (steps + 1)) * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-9)
        self.weights = np.zeros(self.size)
        self.weights[used], self.dense_weights = w[: len(used)], w[len(used) :]
        self.slope, self.shift = 1.0, 0.0

    def log_odds(self, rows: Rows) -> np.ndarray:
        return self.slope * Rows(rows.ids, rows.begin, self.scaled(rows.dense)).margins(self.weights, self.dense_weights) + self.shift

    def calibrate(self, rows: Rows, bad: np.ndarray) -> None:
        """Platt scaling on rows that the fit has not seen."""
        self.slope, self.shift = 1.0, 0.0
        x = self.log_odds(rows)
        target = np.where(bad, (bad.sum() + 1) / (bad.sum() + 2), 1 / ((~bad).sum() + 2))
        a, b = 1.0, 0.0
        for _ in range(50):
            p = sigmoid(a * x + b)
            v = p * (1 - p) + 1e-9
            g = np.array([((p - target) * x).sum() + 1e-3 * (a - 1), (p - target).sum()])
            h = np.array([[(v * x * x).sum() + 1e-3, (v * x).sum()], [(v * x).sum(), v.sum() + 1e-6]])
            step = np.linalg.solve(h, g)
            a, b = a - np.clip(step[0], -1, 1), b - np.clip(step[1], -1, 1)
        self.slope, self.shift = max(a, 0.0), b


META_BITS = 12


def both_views(meta: pa.Array, shape: pa.Array, words: pa.Array) -> tuple[Rows, Rows]:
    """The rows of the text view and of the metadata view, from columns of features."""
    blobs = words.to_pylist()
    return views_of(meta, shape, np.frombuffer(b"".join(blobs), "<i4"), np.concatenate([[0], np.cumsum([len(x) // 4 for x in blobs])]))


def views_of(meta: pa.Array, shape: pa.Array, word_ids: np.ndarray, begin: np.ndarray) -> tuple[Rows, Rows]:
    n = len(meta)
    if not n:
        empty = Rows(np.zeros(0, np.int32), np.zeros(1, np.int64), np.zeros((0, 0)))
        return empty, empty
    text = Rows(word_ids, begin, np.asarray(shape.flatten(), np.float64).reshape(n, -1))
    values = meta.to_pylist()
    ids = np.array([xxhash.xxh32_intdigest(v) >> (32 - META_BITS) for x in values for v in x], np.int32)
    return text, Rows(ids, np.concatenate([[0], np.cumsum([len(x) for x in values])]), np.zeros((n, 0)))


class Views:
    """The two classifiers, what they say together, and from where on that rejects."""

    def __init__(self) -> None:
        self.text, self.meta, self.prior = Logistic(1 << BITS, 2.0, 3), Logistic(1 << META_BITS, 8.0, 1), 0.0
        self.rejected, self.ready = REJECTED, False

    def log_odds(self, text: Rows, meta: Rows) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of being bad: by text, by metadata, by both."""
        if not self.ready or not text.n:
            never = np.full(text.n, -35.0)
            return never, never, never
        t, m = self.text.log_odds(text), self.meta.log_odds(meta)
        return t, m, t + m - self.prior

    def choose_threshold(self, text: Rows, meta: Rows, bad: np.ndarray) -> None:
        """``REJECTED``, or higher where that would reject more than ``GOOD_LOST`` of the good
        rows kept aside.  Where these are too few to tell, their tail is drawn out: by one unit
        of log-odds, e times fewer rows lie above."""
        good = np.sort(self.log_odds(text, meta)[2][~bad])[::-1]
        lost = GOOD_LOST * (len(good) + 1)
        edge = good[int(lost)] if lost >= 1 else good[0] - math.log(lost)
        self.rejected = max(REJECTED, float(sigmoid(np.nextafter(edge, math.inf))))


def scored(rows: DataFrame, views: Views) -> DataFrame:
    """key, doc_id, text_bad, meta_bad, bad (probabilities) of rows with features."""
    schema = pa.schema([("key", pa.binary()), ("doc_id", pa.int64()), ("text_bad", pa.float64()), ("meta_bad", pa.float64()), ("bad", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go("word_ids")
        for some in small(batches, SLICE):
            found = views.log_odds(*both_views(*(some.column(c) for c in ("meta", "shape", "words"))))
            yield batch(schema, some.column("key"), some.column("doc_id"), *(sigmoid(x) for x in found))

    return rows.mapInArrow(run, "key binary, doc_id bigint, text_bad double, meta_bad double, bad double")


def share_of(bound: int, n: int):
    """A filter that keeps about ``bound`` of ``n`` rows, by the hash of their doc_id."""
    return F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int((1 << 30) * min(1.0, bound / max(1, n)))


@dataclass
class Held:
    """Rows on the driver: both views, and whether each is bad."""

    text: Rows
    meta: Rows
    bad: np.ndarray

    def where(self, chosen: np.ndarray) -> Held:
        return Held(*(taken(rows, chosen) for rows in (self.text, self.meta)), self.bad[chosen])


def taken(rows: Rows, chosen: np.ndarray) -> Rows:
    size = np.diff(rows.begin)
    return Rows(rows.ids[np.repeat(chosen, size)], np.concatenate([[0], np.cumsum(size[chosen])]), rows.dense[chosen])


def together(one: tuple[Rows, np.ndarray], other: tuple[Rows, np.ndarray]) -> tuple[Rows, np.ndarray]:
    """The rows of one view, and whether each is bad, with further ones."""
    rows = [one[0], other[0]]
    size = np.concatenate([np.diff(r.begin) for r in rows])
    dense = np.concatenate([r.dense for r in rows if r.n] or [rows[0].dense])
    return Rows(np.concatenate([r.ids for r in rows]), np.concatenate([[0], np.cumsum(size)]), dense), np.concatenate([one[1], other[1]])


def ordered_ids(words: pa.ChunkedArray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ids of the rows in an order, side by side, and where each row begins: read where they
    lie, so that they are held once besides."""
    size = np.concatenate([np.zeros(0, np.int64), *(pc.binary_length(x).to_numpy(zero_copy_only=False) for x in words.chunks)]) // 4
    begin = np.concatenate([[0], np.cumsum(size[order])]).astype(np.int64)
    to = np.empty(len(order), np.int64)
    to[order] = begin[:-1]
    out = np.empty(begin[-1], "<i4")
    for at, n, value in zip(to.tolist(), size.tolist(), (x for chunk in words.chunks for x in chunk), strict=True):
        out[at : at + n] = np.frombuffer(value.as_buffer(), "<i4")
    return out, begin


def picked(rows: DataFrame, few: DataFrame) -> tuple[np.ndarray, Held]:
    """The doc_ids and features of a bounded choice of rows, which ``few`` names by its first
    column and a label."""
    found = rows.join(F.broadcast(few), few.columns[0]).select("doc_id", "meta", "shape", "words", "is_bad").toArrow()
    order = np.argsort(found.column("doc_id").to_numpy(), kind="stable")
    ids, begin = ordered_ids(found.column("words"), order)
    found = found.drop_columns(["words"]).take(order).combine_chunks()
    meta, shape, bad = (found.column(c).combine_chunks() for c in ("meta", "shape", "is_bad"))
    return found.column("doc_id").to_numpy(), Held(*views_of(meta, shape, ids, begin), np.asarray(bad.to_numpy(zero_copy_only=False), bool))


def fitted(rows: DataFrame, labels: DataFrame, labelled: int = LABELLED, handed: int = HANDED, rounds: int = ROUNDS) -> Views:
    """The two views after co-training; ``rows`` are the features of all documents."""
    views = Views()
    known = staged(labels.where("doc_id IS NOT NULL AND (quality IS NOT NULL OR toxic IS NOT NULL)").groupBy(F.col("doc_id").cast("bigint").alias("doc_id")).agg(
        F.max(F.coalesce(F.col("quality") == 0, F.lit(False)) | F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("is_bad")), "labels")
    doc_ids, own = picked(rows, known.where(share_of(labelled, known.count())))
    aside = np.array([xxhash.xxh32_intdigest(str(x)) % 4 == 0 for x in doc_ids.tolist()], bool)
    train, held = own.where(~aside), own.where(aside)
    if min((x.bad == side).sum() for x in (train, held) for side in (False, True)) < 1 or len(doc_ids) < LEAST_ROWS:
        release(known)
        return views
    for_text, for_meta = (train.text, train.bad), (train.meta, train.bad)
    del own, train
    views.prior = float(np.log(held.bad.mean() / (1 - held.bad.mean())))
    views.ready = True
    for turn in range(rounds + 1):
        for view, (given, bad), aside_rows in ((views.text, for_text, held.text), (views.meta, for_meta, held.meta)):
            view.fit(given, bad.astype(np.float64))
            view.calibrate(aside_rows, held.bad)
        del given, bad
        if turn == rounds:
            break
        free = staged(scored(rows, views).join(known, "doc_id", "left_anti"), "scored")
        chosen = {}
        for column in ("text_bad", "meta_bad"):
            certain = free.where((F.col(column) >= CERTAIN) | (F.col(column) <= 1 - CERTAIN))
            few = certain.where(share_of(handed, certain.count())).groupBy("key").agg(F.max(F.col(column) >= 0.5).alias("is_bad"))
            chosen[column] = picked(rows, few)[1]
        for_text = together(for_text, (chosen["meta_bad"].text, chosen["meta_bad"].bad))
        for_meta = together(for_meta, (chosen["text_bad"].meta, chosen["text_bad"].bad))
        del chosen
        release(free)
    release(known)
    views.choose_threshold(held.text, held.meta, held.bad)
    return views


def classify(docs: DataFrame, labels: DataFrame, **bounds: int) -> DataFrame:
    """Per document: doc_id, text_score, meta_score, score (probabilities of being good) and
    rejected."""
    rows = staged(features(docs), "features")
    views = fitted(rows, labels, **bounds)
    found = scored(rows, views)
    return found.select("doc_id", (1 - F.col("text_bad")).alias("text_score"), (1 - F.col("meta_bad")).alias("meta_score"), (1 - F.col("bad")).alias("score"), (F.col("bad") >= views.rejected).alias("rejected"))


def good_documents(docs: DataFrame, labels: DataFrame, **bounds: int) -> DataFrame:
    """The documents that are not rejected, with all their columns.

    The fitted views judge each document where it lies, so no text is shuffled."""
    rows = staged(features(docs), "features")
    views = fitted(rows, labels, **bounds)
    release(rows)

    @F.arrow_udf("boolean")
    def rejected(text: pa.Array, lang: pa.Array, source: pa.Array, n_chars: pa.Array) -> pa.Array:
        out = np.zeros(len(text), bool)
        for at in range(0, len(text), SLICE):
            found = [text_features(x) for x in utf8(text.slice(at, SLICE))]
            meta = [meta_values(*x) for x in zip(*(c.slice(at, SLICE).to_pylist() for c in (lang, source, n_chars)), strict=True)]
            shape = pa.array([np.array(x[0], np.float32) for x in found], pa.list_(pa.float32()))
            odds = views.log_odds(*both_views(pa.array(meta), shape, pa.array([x[1].tobytes() for x in found], pa.binary())))
            out[at : at + SLICE] = sigmoid(odds[2]) >= views.rejected
        return pa.array(out)

    return docs.where(~rejected("text", *metadata(docs)))
