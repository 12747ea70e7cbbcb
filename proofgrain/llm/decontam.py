"""Benchmark decontamination by a distributed positional inverted index.

Words are runs of letters and digits, of any script, with A-Z in lower case.  A window is 13
consecutive words of an item, or a shorter item as a whole.  Every window has a rarest term
by the counts of all documents; its place in the item is a seed.  The index holds, for the
terms of all seeds, each occurrence in the documents (document, position) with the words
around it.  A posting and a seed of the same term fix an alignment of document and item; the
words around both are compared outwards, and the common run is an exact match where it
covers a window.  Common terms therefore never need posting lists.

Only DataFrame functions are used.  The benchmark's term and seed tables are written first,
so that Spark knows their size and broadcasts them only while they are small.

Null and empty texts have no words and no hits.  Repeated documents get a row each.  Items
that repeat count by their distinct item_id; a null item_id counts as ``null``.  Empty tables
give no rows (documents) or no hits (benchmark).  Other columns are ignored.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from proofgrain.llm.common import release, row_key, staged, unused

SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WINDOW = 13


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case, all else as it is; ``lower`` does that for texts of ASCII only."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, string.ascii_uppercase, string.ascii_lowercase))


def words(text: Column) -> Column:
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), SEPARATORS), "")


def document_words(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "text").select("doc_id", row_key("doc_id", "text").alias("key"), words(F.col("text")).alias("words"))


def item_words(benchmark: DataFrame) -> DataFrame:
    return benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("item"), words(F.col("text")).alias("item_words")).where(F.size("item_words") > 0).distinct()


def term_counts(docs: DataFrame, items: DataFrame) -> DataFrame:
    """How often each benchmark term occurs in all documents: term, n."""
    terms = staged(items.select(F.explode("item_words").alias("term")).distinct().coalesce(1), "terms")
    return docs.select(F.explode("words").alias("term")).join(terms, "term").groupBy("term").agg(F.count("*").alias("n"))


def seeds(items: DataFrame, counts: DataFrame, width: int = WINDOW) -> DataFrame:
    """The rarest term's place of every window: term, item, need, left and right (the item's
    words before, nearest first, and after).  Windows with a term that no document has go."""
    places = items.select("item", "item_words", F.posexplode("item_words").alias("place", "term"))
    rated = places.join(counts, "term", "left").select("item", "item_words", "place", "term", F.coalesce("n", F.lit(0)).alias("n"))
    per_item = rated.groupBy("item", "item_words").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "n"))), lambda x: x["n"]).alias("ns"))
    width_of = F.least(F.lit(width), F.size("item_words"))
    each = per_item.select("item", "item_words", "ns", width_of.alias("need"), F.explode(F.sequence(F.lit(0), F.size("item_words") - width_of)).alias("first"))
    rarest = F.array_min(F.transform(F.slice("ns", F.col("first") + 1, F.col("need")), lambda n, i: F.struct(n.alias("n"), (F.col("first") + i).alias("place"))))
    chosen = each.withColumn("rarest", rarest).where("rarest.n > 0").select("item", "item_words", "need", F.col("rarest.place").alias("place")).distinct()
    return chosen.select(
        F.element_at("item_words", F.col("place") + 1).alias("term"), "item", "need",
        F.reverse(F.slice("item_words", F.greatest(F.lit(1), F.col("place") - width + 2), F.least(F.lit(width - 1), F.col("place")))).alias("left"),
        F.slice("item_words", F.col("place") + 2, F.lit(width - 1)).alias("right"))


def index(docs: DataFrame, terms: DataFrame, width: int = WINDOW) -> DataFrame:
    """Postings of the given terms: term, key, n_words, at, before (nearest first) and after."""
    return docs.select("key", "words", F.size("words").cast("bigint").alias("n_words"), F.posexplode("words").alias("at", "term")).join(terms, "term").select(
        "term", "key", "n_words", "at",
        F.reverse(F.slice("words", F.greatest(F.lit(1), F.col("at") - width + 2), F.least(F.lit(width - 1), F.col("at")))).alias("before"),
        F.slice("words", F.col("at") + 2, F.lit(width - 1)).alias("after"))


def agreeing(a: str, b: str) -> Column:
    """How many leading words two arrays share."""
    same = F.zip_with(a, b, lambda x, y: x.eqNullSafe(y))
    differs = F.array_position(same, False)
    return F.when(differs == 0, F.size(same)).otherwise(differs - 1).cast("int")


def phrase_matches(postings: DataFrame, seeds: DataFrame) -> DataFrame:
    """Exact matches: key, n_words, item, first and last (the matching run of document words)."""
    met = postings.join(seeds, "term").select("key", "n_words", "item", "need", "at", agreeing("before", "left").alias("l"), agreeing("after", "right").alias("r"))
    return met.where("l + 1 + r >= need").select("key", "n_words", "item", (F.col("at") - F.col("l")).alias("first"), (F.col("at") + F.col("r")).alias("last"))


def proximity_matches(docs: DataFrame, benchmark: DataFrame, terms: int = 3, span: int = 30) -> DataFrame:
    """Documents where an item's rarest terms all lie within ``span`` words of each other, in
    any order: key, item, first (the earliest such place)."""
    docs, items = document_words(docs), staged(item_words(benchmark), "items")
    counts = staged(term_counts(docs, items), "counts")
    rated = items.select("item", F.explode(F.array_distinct("item_words")).alias("term")).distinct().join(counts, "term")
    ranked = rated.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy("n", "term"))).where(F.col("rank") <= terms)
    rare = staged(ranked.withColumn("of", F.count("*").over(Window.partitionBy("item"))).select("term", "item", "of").coalesce(1), "rare")
    hits = staged(index(docs, rare.select("term").distinct()).select("term", "key", "at"), "postings").distinct().join(rare, "term")
    near = Window.partitionBy("key", "item").orderBy("at").rangeBetween(0, span - 1)
    return hits.withColumn("seen", F.size(F.collect_set("term").over(near))).where("seen = of").groupBy("key", "item").agg(F.min("at").alias("first"))


def hits(docs: DataFrame, benchmark: DataFrame, width: int = WINDOW) -> DataFrame:
    """Per matching document: key, n_words, n_hit, n_items, items_sha256."""
    return found_hits(docs, benchmark, width)[0]


def found_hits(docs: DataFrame, benchmark: DataFrame, width: int = WINDOW) -> tuple[DataFrame, DataFrame]:
    """The hits, and the staged matches that they read."""
    items = staged(item_words(benchmark), "items")
    found = document_words(docs)
    starts = staged(seeds(items, term_counts(found, items), width).coalesce(1), "seeds")
    terms = staged(starts.select("term").distinct().coalesce(1), "seed_terms")
    postings = staged(index(found, terms, width), "postings")
    matches = staged(phrase_matches(postings.distinct(), starts), "matches")
    release(items, starts, terms, postings)
    before = Window.partitionBy("key").orderBy("first", "last").rowsBetween(Window.unboundedPreceding, -1)
    new = F.greatest(F.lit(0), F.col("last") - F.greatest(F.col("first") - 1, F.coalesce(F.max("last").over(before), F.lit(-1))))
    runs = matches.select("key", "n_words", "first", "last").distinct().select("key", "n_words", new.alias("new")).groupBy("key").agg(F.max("n_words").alias("n_words"), F.sum("new").cast("bigint").alias("n_hit"))
    named = matches.select("key", "item").distinct().groupBy("key").agg(F.count("*").alias("n_items"), F.sha2(F.concat_ws(",", F.array_sort(F.collect_list("item"))), 256).alias("items_sha256"))
    return runs.join(named, "key"), matches


def decontaminate(docs: DataFrame, benchmark: DataFrame, width: int = WINDOW, share: int = 20) -> DataFrame:
    """Per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    found = document_words(docs).select("doc_id", "key", F.size("words").cast("bigint").alias("n_words"))
    joined = found.join(hits(docs, benchmark, width).drop("n_words"), "key", "left")
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("bigint")
    return joined.select("doc_id", "n_words", n_hit.alias("n_hit"), F.coalesce("n_items", F.lit(0)).cast("bigint").alias("n_items"),
                         F.coalesce("items_sha256", F.sha2(F.lit(""), 256)).alias("items_sha256"), ((n_hit > 0) & (n_hit * share >= F.col("n_words"))).alias("contaminated"))


def clean_documents(docs: DataFrame, benchmark: DataFrame, width: int = WINDOW, share: int = 20) -> DataFrame:
    """The documents that are not contaminated, with all their columns.

    The keys of the few others are written, so that Spark knows their size: texts are shuffled
    only where these are many."""
    found, matches = found_hits(docs, benchmark, width)
    key = unused(docs, "row_key")
    bad = staged(found.where(F.col("n_hit") * share >= F.col("n_words")).select(F.col("key").alias(key)), "contaminated")
    release(matches)
    return docs.withColumn(key, row_key("doc_id", "text")).join(bad, key, "left_anti").select(*docs.columns)


SQL = """
WITH d AS (
  SELECT row_number() OVER () AS k, doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') AS w
  FROM documents),
b AS (
  SELECT item_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') AS w
  FROM benchmark),
wins AS (
  SELECT DISTINCT item_id, least(13, len(w)) AS n, array_to_string(w[s:s + least(13, len(w)) - 1], ' ') AS gram
  FROM (SELECT item_id, w, unnest(generate_series(1, len(w) - least(13, len(w)) + 1)) AS s FROM b WHERE len(w) > 0)),
grams AS (
  SELECT k, n, s, array_to_string(w[s:s + n - 1], ' ') AS gram
  FROM (SELECT k, w, n, unnest(generate_series(1, len(w) - n + 1)) AS s FROM d, (SELECT DISTINCT n FROM wins) WHERE len(w) >= n)),
m AS (SELECT k, item_id, s, n FROM grams JOIN wins USING (n, gram)),
h AS (SELECT k, count(DISTINCT p) AS n_hit FROM (SELECT k, unnest(generate_series(s, s + n - 1)) AS p FROM m) GROUP BY k),
i AS (SELECT k, count(*) AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS items_sha256 FROM (SELECT DISTINCT k, CAST(item_id AS VARCHAR) AS item FROM m) GROUP BY k)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       coalesce(items_sha256, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN h USING (k) LEFT JOIN i USING (k)
"""
