"""Benchmark decontamination: documents that contain a run of words of a benchmark item.

A prefix-filtered join on words as the tokens of item-sized windows. A window is contained
only where all its words are, so of its words ordered by rarity the first is all the prefix
that is necessary.

1. Rarity: how often every word of the benchmark occurs in all documents. A window with a
   word that never does is dropped.
2. Prefix: each window is filed under its rarest word, with the word's place in the window.
3. Join: the words of all documents against the prefixes. The place of the word in the
   document gives where the window would begin, which must leave room on both sides.
4. Verification: the document's words there are compared with the window's, all of them.

Only DataFrame functions are used. Prefixes are broadcast while there are no more than
``broadcast_windows`` of them (their rows are then compared in the task that reads the text, without a
shuffle of words); beyond, the words are joined by a shuffle and the texts are read again
for verification.

Upper case: A-Z only counts as equal to a-z. Prefixes are looked up by Spark's ``lower``, which
also equates other letters; verification does not.

Defined results: null and empty texts have no words, items without words have no windows, an
item of fewer words than a window is one window. Rows with equal ``doc_id`` are judged by
their own text. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kithwatch.operators.scratch import Scratch

WINDOW = 10
BROADCAST_WINDOWS = 100_000
_BREAK = "[\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words_of(text: Column | str) -> Column:
    """Words as they stand in the text."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), _BREAK), "")


# The outer forms of explode below keep Spark from splitting each text once more to see that it has words.


def _keyed(documents: DataFrame) -> DataFrame:
    """Rows that can be told apart by ``_id`` and ``_text`` (a hash), but for repeated ones."""
    return documents.select(F.col("doc_id").alias("_id"), F.xxhash64("text").alias("_text"), words_of("text").alias("_words"))


def item_windows(benchmark: DataFrame, window: int) -> DataFrame:
    """``(item_id, begin, words)`` of each window, lower-cased."""
    found = benchmark.select("item_id", words_of(F.translate("text", _UPPER, _LOWER)).alias("words")).where(F.size("words") > 0)
    begins = F.sequence(F.lit(0), F.greatest(F.size("words") - window, F.lit(0)))
    each = found.select("item_id", "words", F.explode(begins).alias("begin"))
    return each.select("item_id", "begin", F.slice("words", F.col("begin") + 1, window).alias("words"))


def prefixes(documents: DataFrame, windows: DataFrame, broadcast_windows: int = BROADCAST_WINDOWS) -> DataFrame:
    """``(item_id, words, token, place)``: windows under their rarest word in the documents."""
    placed = windows.select("item_id", "begin", "words", F.posexplode("words").alias("place", "word"))
    placed = placed.withColumn("token", F.lower("word"))
    vocabulary = placed.select("token").distinct()
    if vocabulary.count() <= broadcast_windows:
        vocabulary = F.broadcast(vocabulary)
    seen = documents.select(F.explode_outer(words_of("text")).alias("word")).select(F.lower("word").alias("token"))
    counts = seen.join(vocabulary, "token").groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    rated = placed.join(counts, "token", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    rarest = F.min(F.struct("n", "token", "place")).alias("rarest")
    chosen = rated.groupBy("item_id", "begin", "words").agg(rarest).where("rarest.n > 0")
    return chosen.select("item_id", "words", "rarest.token", "rarest.place").distinct()


def benchmark_hits(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW, broadcast_windows: int = BROADCAST_WINDOWS) -> DataFrame:
    """``(_id, _text, start, length, item_id)``: where windows occur in documents."""
    scratch = Scratch(documents.sparkSession, "decontamination")
    windows = scratch.save(item_windows(benchmark, window), "windows")
    filed = scratch.save(prefixes(documents, windows, broadcast_windows), "prefixes")
    start = F.col("_place") - F.col("place")
    inside = (start >= 0) & (start + F.size("words") <= F.col("_size"))
    same = F.translate(F.array_join(F.slice("_words", start + 1, F.size("words")), " "), _UPPER, _LOWER) == F.array_join("words", " ")
    kept = ["_id", "_text", start.alias("start"), F.size("words").alias("length"), "item_id"]
    keyed = _keyed(documents).withColumn("_size", F.size("_words"))
    if filed.count() <= broadcast_windows:
        each = keyed.select("*", F.posexplode_outer("_words").alias("_place", "_word"))
        # Where nothing matches, the array of words is not copied: reading, splitting and joining are one stage.
        return each.join(F.broadcast(filed), F.lower("_word") == F.col("token")).where(inside & same).select(*kept)
    each = keyed.select("_id", "_text", "_size", F.posexplode_outer("_words").alias("_place", "_word"))
    possible = each.join(filed, F.lower("_word") == F.col("token")).where(inside)
    texts = keyed.dropDuplicates(["_id", "_text"]).withColumnsRenamed({"_id": "_of", "_text": "_key"})
    found = possible.drop("_size").join(texts, F.col("_id").eqNullSafe(F.col("_of")) & (F.col("_text") == F.col("_key")))
    return found.where(same).select(*kept)


def contamination(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW, broadcast_windows: int = BROADCAST_WINDOWS) -> DataFrame:
    """``(doc_id, n_words, n_hit, n_items, items_sha256, contaminated)`` for every row."""
    hits = benchmark_hits(documents, benchmark, window, broadcast_windows)
    covered = F.flatten(F.transform("spans", lambda s: F.sequence(s["start"], s["start"] + s["length"] - 1)))
    found = (
        hits.groupBy("_id", "_text")
        .agg(F.collect_set(F.struct("start", "length")).alias("spans"), F.collect_set(F.col("item_id").cast("string")).alias("items"))
        .select(
            F.col("_id").alias("_of"),
            F.col("_text").alias("_key"),
            F.size(F.array_distinct(covered)).cast("long").alias("n_hit"),
            F.size("items").cast("long").alias("n_items"),
            F.array_join(F.array_sort("items"), ",").alias("items"),
        )
    )
    sized = _keyed(documents).select("_id", "_text", F.size("_words").cast("long").alias("n_words"))
    joined = sized.join(found, F.col("_id").eqNullSafe(F.col("_of")) & (F.col("_text") == F.col("_key")), "left")
    none = F.lit(0).cast("long")
    return joined.select(
        F.col("_id").alias("doc_id"),
        "n_words",
        F.coalesce("n_hit", none).alias("n_hit"),
        F.coalesce("n_items", none).alias("n_items"),
        F.sha2(F.coalesce("items", F.lit("")), 256).alias("items_sha256"),
        F.col("n_hit").isNotNull().alias("contaminated"),
    )


def without_contaminated(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """Rows without a hit, with all their columns."""
    hits = benchmark_hits(documents, benchmark, window).select("_id", "_text").distinct()
    # The row travels as one column, so that none of its names can clash.
    rows = documents.select(F.struct("*").alias("row"), F.col("doc_id").alias("key"), F.xxhash64("text").alias("key_text"))
    match = F.col("key").eqNullSafe(F.col("_id")) & (F.col("key_text") == F.col("_text"))
    return rows.join(hits, match, "left_anti").select("row.*")
