"""Byte-level BPE ids of whole texts by the tiktoken library, and the bytes that ids stand for.

The ranks come from a local file: a line per token, its bytes in base64 and its rank.  The
pattern splits a text into matches, and each match is merged by itself.  A long text is first
cut at places that no match spans, so a task never holds the ids of more than one part as
Python objects:

* between a character that is no white space and white space,
* between an ASCII letter and an ASCII digit, either way round,
* between an ASCII letter, a digit, a kana or a common ideograph, and punctuation after it.

Both sides of such a place match as they would in the whole text: only white space looks
ahead, and no part ends in white space.  A text without such a place stays whole, as it is one
match.  This holds for patterns whose matches are runs of letters, of digits, of other signs
(each after at most one space), of white space, or an apostrophe with letters.

Decoding joins the bytes of the tokens, so ids that end inside a character lose nothing.

Null text is empty and has no ids.  Bytes that are no UTF-8 become U+FFFD before encoding.
Rows that repeat each other get a row each, and a null doc_id stays null.  Empty tables give
no rows; other columns are ignored.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from proofgrain.llm.common import batch, kept, slices, utf8

#: Characters of a part, ids decoded at once, and bytes of texts in a batch that is sent on.
PART, IDS_AT_ONCE, SENT = 1 << 18, 1 << 18, 1 << 22
_SAFE = re.compile(
    r"(?<=[^\s\x1c-\x1f])(?=[ \t\r\n])"
    r"|(?<=[A-Za-z])(?=[0-9])|(?<=[0-9])(?=[A-Za-z])"
    r"|(?<=[A-Za-z0-9ぁ-ゖァ-ヺ一-龥])(?=[!-/:-@\[-`{-~、。，])")
IDS = "doc_id bigint, ids binary"


def encoding(path: str, pattern: str) -> Any:
    """The library's encoding of a rank file, built once in a worker."""

    def build() -> Any:
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, filter(bytes.strip, lines))}
        return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    return kept(f"ranks {path} {pattern}", build)


def parts(text: str, size: int = PART) -> Iterator[str]:
    """The text in pieces of about ``size`` characters, cut where no match of the pattern is."""
    at = 0
    while len(text) - at > size:
        cut = _SAFE.search(text, at + size)
        if not cut:
            break
        yield text[at : cut.start()]
        at = cut.start()
    yield text[at:]


def ids_of(encoder: Any, text: str, size: int = PART) -> bytes:
    """The ids of a text as little-endian unsigned 32-bit integers."""
    return b"".join([np.array(encoder.encode_ordinary(part), "<u4").tobytes() for part in parts(text, size)])


def bytes_of(encoder: Any, ids: bytes) -> bytes:
    found = np.frombuffer(ids, "<u4")
    return b"".join([encoder.decode_bytes(found[i : i + IDS_AT_ONCE].tolist()) for i in range(0, len(found), IDS_AT_ONCE)])


def encode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, ids (little-endian unsigned 32-bit integers) of every document."""
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoding(path, pattern)
        for part in batches:
            texts = utf8(part.column("text"))
            for a, b in slices(texts, SENT):
                yield batch(schema, part.column("doc_id").slice(a, b - a), [ids_of(encoder, t.decode("utf-8", "replace")) for t in texts[a:b]])

    return rows.mapInArrow(run, IDS)


def decode(rows: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, ids, and the bytes that they stand for."""
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.binary()), ("decoded", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoding(path, pattern)
        for part in batches:
            ids = part.column("ids").to_pylist()
            for a, b in slices(ids, SENT):
                yield batch(schema, part.column("doc_id").slice(a, b - a), ids[a:b], [bytes_of(encoder, x) for x in ids[a:b]])

    return rows.select("doc_id", "ids").mapInArrow(run, f"{IDS}, decoded binary")


def round_trip(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """Per document: doc_id, n_tokens, ids_sha256 and decoded_sha256."""
    found = decode(encode(docs, path, pattern), path, pattern)
    return found.select("doc_id", (F.length("ids") / 4).cast("bigint").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
