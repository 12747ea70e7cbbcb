"""Secret scan: fixed patterns, and windows of high entropy over candidate strings.

Base kinds, leftmost and non-overlapping each: ``assign``, ``access``, ``hex``.  The method
adds ``entropy`` spans.  A candidate is a maximal run of key characters.  A window of fixed
width slides over it; the counts of its characters, and the sum of c*log2(c) over them, change
with the one character that enters and the one that leaves (in whole units of 2**-20 bits, so
no rounding gathers).  Windows fall into a class by their characters (hex digits with a
digit, or upper case with lower case and digits; with ``others``, the classes named there as
well); those whose Shannon entropy reaches their class's threshold are joined into spans.
From a candidate of a shape on the allow-list, what is harmless is cut out (an identifier, a
word such as "example", the slashes of a path), and the pieces between are judged.

Only DataFrame functions are used: each document is one row, nothing is shuffled.  Null text
is empty.  Positions are code points, the end exclusive.  Repeated rows get a row each, empty
tables none; other columns are ignored.
"""

from __future__ import annotations

import math
import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from proofgrain.llm.common import unused

ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
KINDS = ("assign", "access", "hex", "entropy")
CANDIDATE = r"[A-Za-z0-9+/_=-]{%d,}"
ALPHABET = string.digits + "abcdefABCDEF" + string.ascii_lowercase[6:] + string.ascii_uppercase[6:] + "+/_=-"
ALLOWED = (
    r"[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}",  # UUIDs
    r"(?i).*(example|placeholder|changeme|dummy).*",
    r"(/[A-Za-z0-9_-]+){3,}/?",  # paths
)
#: What is cut out of candidates of these shapes.
CUTS = tuple(zip(ALLOWED, (ALLOWED[0], "(?i)example|placeholder|changeme|dummy", "/"), strict=True))
#: Thresholds of the other classes: what 99 of 100 random windows of 20 from 36, 32, 10, 52 and
#: 26 characters reach.  Signs (+/_=-) are of no class.
OTHERS = {"lower_digit": 3.41, "upper_digit": 3.35, "digit": 2.5, "letters": 3.58, "one_case": 3.21}
UNIT = 1 << 20


def matches(text: Column, pattern: str, group: int = 0) -> Column:
    """All matches in order: struct(start, end, value of the group)."""
    found, values, gaps = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.regexp_extract_all(text, F.lit(pattern), F.lit(group)), F.split(text, pattern, -1)
    empty = F.array().cast("array<struct<start:int,end:int,value:string>>")
    rows = F.zip_with(F.zip_with(found, values, lambda m, v: F.struct(m.alias("m"), v.alias("v"))), F.slice(gaps, 1, F.size(found)), lambda x, g: F.struct(x["m"].alias("m"), x["v"].alias("v"), g.alias("g")))
    walked = F.aggregate(rows, F.struct(F.lit(0).alias("at"), empty.alias("out")), lambda s, x: F.struct(
        (s["at"] + F.length(x["g"]) + F.length(x["m"])).alias("at"),
        F.concat(s["out"], F.array(F.struct((s["at"] + F.length(x["g"])).alias("start"), (s["at"] + F.length(x["g"]) + F.length(x["m"])).alias("end"), x["v"].alias("value")))).alias("out")))
    return F.when(text.rlike(pattern), walked["out"]).otherwise(empty)


def let(value: Column, then) -> Column:
    """``then(value)`` with the value computed once."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def pieces(value: Column, cuts: tuple[tuple[str, str], ...], width: int) -> Column:
    """The parts of a candidate that are judged: array of struct(start, value) within it."""
    def between(cut: Column) -> Column:
        starts, ends = F.transform(cut, lambda x: x["start"]), F.transform(cut, lambda x: x["end"])
        parts = F.zip_with(F.concat(F.array(F.lit(0)), ends), F.concat(starts, F.array(F.length(value))), lambda a, b: F.struct(a.alias("start"), F.substring(value, a + 1, b - a).alias("value")))
        return F.filter(parts, lambda x: F.length(x["value"]) >= width)

    none = F.array().cast("array<struct<start:int,end:int,value:string>>")
    found = [F.when(value.rlike(f"^(?:{shape})$"), matches(value, cut)).otherwise(none) for shape, cut in cuts]
    return let(F.array_sort(F.concat(none, *found)), between)


def entropy_runs(value: Column, width: int, hex_bits: float, mixed_bits: float, others: dict[str, float]) -> Column:
    """The joined hot windows of one string: array of struct(start, end) within it."""
    xlogx = F.array(*[F.lit(round(UNIT * c * math.log2(c)) if c else 0).cast("bigint") for c in range(width + 2)])
    hex_most, mixed_most, *most = (round(UNIT * width * (math.log2(width) - bits)) for bits in (hex_bits, mixed_bits, *others.values()))
    most = dict(zip(others, most, strict=True))
    spans = F.array().cast("array<struct<start:int,end:int>>")

    def state(counts, total, a, b, out) -> Column:
        return F.struct(counts.alias("counts"), total.alias("total"), a.alias("a"), b.alias("b"), out.alias("out"))

    def slid(s: Column, x: Column) -> Column:
        """One character enters, and the one ``width`` before it leaves."""
        n_in, n_out = F.get(s["counts"], x["enters"]), F.coalesce(F.get(s["counts"], x["leaves"]), F.lit(0))
        more = F.get(xlogx, n_in + 1) - F.get(xlogx, n_in)
        less = F.when(x["leaves"] >= 0, F.get(xlogx, n_out) - F.get(xlogx, n_out - 1)).otherwise(0)
        total = F.when(x["enters"] == x["leaves"], s["total"]).otherwise(s["total"] + more - less)
        return state(F.transform(s["counts"], lambda c, j: c + (j == x["enters"]).cast("int") - (j == x["leaves"]).cast("int")), total, s["a"], s["b"], s["out"])

    def judged(s: Column, end: Column) -> Column:
        def some(first: int, n: int) -> Column:
            return F.aggregate(F.slice(s["counts"], first + 1, n), F.lit(0), lambda x, y: x + y)

        digits, lower_hex, upper_hex, lower, upper = some(0, 10), some(10, 6), some(16, 6), some(22, 20), some(42, 20)
        small, large = lower_hex + lower > 0, upper_hex + upper > 0
        hot = F.when(end < width, False).when((digits > 0) & (digits + lower_hex + upper_hex == width), s["total"] <= hex_most).when((digits > 0) & small & large, s["total"] <= mixed_most)
        for name, where in (("lower_digit", (digits > 0) & small), ("upper_digit", (digits > 0) & large), ("digit", digits > 0), ("letters", small & large), ("one_case", small | large)):
            hot = hot.when(where, s["total"] <= most[name] if name in most else F.lit(False))
        hot = hot.otherwise(False)
        apart = (s["b"] < 0) | (end - width > s["b"])
        return let(hot, lambda h: state(
            s["counts"], s["total"], F.when(h & apart, end - width).otherwise(s["a"]), F.when(h, end).otherwise(s["b"]),
            F.when(h & apart & (s["b"] >= 0), F.concat(s["out"], F.array(F.struct(s["a"].alias("start"), s["b"].alias("end"))))).otherwise(s["out"])))

    def walked(codes: Column) -> Column:
        moves = F.transform(codes, lambda c, i: F.struct(c.alias("enters"), F.when(i >= width, F.get(codes, i - width)).otherwise(-1).alias("leaves"), (i + 1).alias("end")))
        start = state(F.array_repeat(F.lit(0), len(ALPHABET)), F.lit(0).cast("bigint"), F.lit(-1), F.lit(-1), spans)
        done = F.aggregate(moves, start, lambda s, x: let(slid(s, x), lambda t: judged(t, x["end"])))
        return let(done, lambda s: F.when(s["b"] >= 0, F.concat(s["out"], F.array(F.struct(s["a"].alias("start"), s["b"].alias("end"))))).otherwise(s["out"]))

    return let(F.transform(F.split(value, ""), lambda c: F.instr(F.lit(ALPHABET), c) - 1), walked)


def scan(docs: DataFrame, width: int = 20, hex_bits: float = 2.9, mixed_bits: float = 3.6, cuts: tuple[tuple[str, str], ...] = CUTS, others: dict[str, float] | None = None) -> DataFrame:
    """All columns of ``docs``, and last the spans: array of struct(start, rank of the kind, end).

    Without ``others``, windows of the classes named in OTHERS are never hot.
    """
    text = F.coalesce(F.col("text"), F.lit(""))

    def of_kind(rank: int, found: Column, keep) -> Column:
        return F.transform(F.filter(found, keep), lambda m: F.struct(m["start"].alias("start"), F.lit(rank).alias("rank"), m["end"].alias("end")))

    def hot(m: Column) -> Column:
        return F.flatten(F.transform(pieces(m["value"], cuts, width), lambda x: F.transform(entropy_runs(x["value"], width, hex_bits, mixed_bits, others or {}), lambda r: F.struct(
            (m["start"] + x["start"] + r["start"]).alias("start"), F.lit(3).alias("rank"), (m["start"] + x["start"] + r["end"]).alias("end")))))

    def suspect(m: Column) -> Column:
        return F.lit(True) if others else m["value"].rlike("[0-9]")

    spans = F.concat(
        of_kind(0, matches(text, ASSIGN, 2), lambda m: F.length(m["value"]) >= 6),
        of_kind(1, matches(text, "AKIA[A-Z0-9]{16,}"), lambda m: F.lit(True)),
        of_kind(2, matches(text, "[0-9a-f]{24,}"), lambda m: F.lit(True)),
        F.flatten(F.transform(F.filter(matches(text, CANDIDATE % width), suspect), hot)))
    return docs.select("*", F.array_sort(spans).alias(unused(docs, "spans")))


def digest(spans: Column) -> Column:
    kind = F.array(*[F.lit(k) for k in KINDS])
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", F.get(kind, s["rank"]), s["start"].cast("string"), s["end"].cast("string"))))


def report(docs: DataFrame, **settings) -> DataFrame:
    """Per document: doc_id, n_assign, n_access, n_hex, base_sha256, spans."""
    found = scan(docs.select("doc_id", "text"), **settings)

    def count(rank: int) -> Column:
        return F.size(F.filter("spans", lambda s: s["rank"] == rank)).cast("bigint").alias(f"n_{KINDS[rank]}")

    return found.select("doc_id", count(0), count(1), count(2), F.sha2(digest(F.filter("spans", lambda s: s["rank"] < 3)), 256).alias("base_sha256"), digest(F.col("spans")).alias("spans"))


def redact(docs: DataFrame, mark: str = "[secret]", **settings) -> DataFrame:
    """The documents with every span, overlapping ones as one, replaced in the text."""
    found = scan(docs, **settings)
    spans, text = found.columns[-1], F.col("text")
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    cut = F.aggregate(spans, start, lambda s, x: F.struct(
        F.greatest(s["at"], x["end"]).alias("at"),
        F.when((x["start"] < s["at"]) & (s["at"] > 0), s["out"]).otherwise(F.concat(s["out"], F.substring(text, s["at"] + 1, x["start"] - s["at"]), F.lit(mark))).alias("out")))
    clean = F.when(F.size(spans) == 0, text).otherwise(let(cut, lambda s: F.concat(s["out"], F.substring(text, s["at"] + 1, F.length(text)))))
    return found.select(*[clean.alias("text") if c == "text" else F.col(c) for c in docs.columns])
