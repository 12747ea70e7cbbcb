"""Exact k best rows for each query by per-term upper bounds.

``impacts`` are (keys, term, x) with x >= 0: what a term of weight 1 adds to the row's score.
``asked`` are (query, term, weight) with weight >= 0.  A row's score for a query is the sum of
weight * x over the query's terms, so weight * max(x) bounds what a term can add.

1. Of each query the rarest terms are looked up, and the best rows found by them get their
   whole scores.  The k-th of these is the least that a row must reach (``floor``).
2. The commonest terms of a query whose bounds together stay below the floor cannot bring a
   row in by themselves, so they are never looked up: rows come from the other, rarer terms,
   and go where what these add and the bounds of the common ones do not reach the floor.
3. To the rows that are left, the common terms' share is added, by a join on row and term.

So the pairs of a query with the rows that hold only its commonest words are never made.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from proofgrain.session import cut_lineage

#: Rows that the rarest terms of a query should bring in for the floor, and how many of the
#: best of these get their whole scores, as a multiple of k.
LOOKED_UP, TRIED = 1_000, 4


def added(pairs: DataFrame, impacts: DataFrame, terms: DataFrame, query: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """(query, keys, total, words): the given pairs' own total and words, and what the given
    terms of their queries add."""
    own = pairs.select(*query, *keys, "total", "words")
    wanted = own.select(*query, *keys).join(terms.select(*query, "term", "weight"), list(query))
    met = wanted.join(impacts.select(*keys, "term", "x"), [*keys, "term"]).select(
        *query, *keys, (F.col("x") * F.col("weight")).alias("total"), F.when(F.length("term") > 1, 1).otherwise(0).cast("bigint").alias("words"))
    return own.unionByName(met).groupBy(*query, *keys).agg(F.sum("total").alias("total"), F.sum("words").alias("words"))


def looked_up(impacts: DataFrame, terms: DataFrame, query: Sequence[str], keys: Sequence[str], *carried: str) -> DataFrame:
    """(query, keys, total, words) of all rows that hold any of the given terms."""
    return impacts.join(terms.select(*query, *carried, "term", "weight"), "term").groupBy(*query, *carried, *keys).agg(
        F.sum(F.col("x") * F.col("weight")).alias("total"), F.count_if(F.length("term") > 1).alias("words"))


def candidates(impacts: DataFrame, asked: DataFrame, k: int, query: Sequence[str] = ("query",), keys: Sequence[str] = ("doc", "chunk_id"),
               slack: float = 1e-6, trusted: float = 0.0) -> DataFrame:
    """(query, keys, total, words) of every pair that can be among the k best of its query, with
    its whole score.

    Scores that differ by ``slack`` or less count as equal, so rows that tie after rounding
    all stay.  Where the floor is not above ``trusted``, every row of the query stays.
    """
    query, keys = list(query), list(keys)
    terms = cut_lineage(impacts.groupBy("term").agg(F.count("*").alias("df"), F.max("x").alias("most")))
    bounded = cut_lineage(asked.join(terms, "term").withColumn("bound", F.col("weight") * F.col("most")))

    rare = Window.partitionBy(*query).orderBy("df", "term")
    before = F.coalesce(F.sum("df").over(rare.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    order = cut_lineage(bounded.withColumn("seed", before < max(LOOKED_UP, TRIED * k)))
    best = Window.partitionBy(*query).orderBy(F.desc("total"), *keys)
    tried = looked_up(impacts, order.where("seed"), query, keys).withColumn("r", F.row_number().over(best)).where(F.col("r") <= TRIED * k)
    scored = added(tried, impacts, order.where("not seed"), query, keys)
    kth = scored.withColumn("r", F.row_number().over(best)).where(F.col("r") == k).where(F.col("total") > trusted + 2 * slack)
    floors = kth.select(*query, (F.col("total") - 2 * slack).alias("floor"))

    common = Window.partitionBy(*query).orderBy(F.desc("df"), F.desc("term"))
    split = bounded.join(floors, query, "left").withColumn("sum", F.sum("bound").over(common)).withColumn(
        "sought", F.coalesce(F.col("sum") >= F.col("floor"), F.lit(True)))
    rest = F.coalesce(F.max(F.when(~F.col("sought"), F.col("sum"))).over(Window.partitionBy(*query)), F.lit(0.0))
    split = cut_lineage(split.withColumn("least", F.coalesce(F.col("floor") - rest, F.lit(0.0))))
    found = cut_lineage(looked_up(impacts, split.where("sought"), query, keys, "least").where("total >= least"))
    return added(found, impacts, split.where("not sought"), query, keys)
