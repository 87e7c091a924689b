"""A training corpus from raw documents: five stages, each a table that the next one reads.

Language identification drops what is in no language that the labels teach, near duplicates leave one document of each group,
contaminated documents go, personal data is replaced, and what is left is packed into
sequences. Stages hand on the columns of ``documents``; the last one returns the pieces.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kithwatch.llm.decontamination import without_contaminated
from kithwatch.llm.jaccard import BROADCAST_IDS, jaccard_components
from kithwatch.llm.language import in_known_language
from kithwatch.llm.packing import pack_best_fit, tokenized_pieces
from kithwatch.llm.pii import redact
from kithwatch.operators.scratch import Scratch

#: Bytes that Spark hands to a Python worker at a time, while a stage of the pipeline is written.
BATCH_BYTES = 8 << 20

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows in one of the languages that the labels teach.

    Null and letterless texts go, and those that score far below labelled rows of their length.
    """
    return in_known_language(docs, docs, COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group: that of the smallest ``doc_id``, and of equal ids one text.

    A document is its id and its text: texts that share an id by chance are told apart, equal rows
    are one. Rows without an id name no group and stay.
    """
    docs = docs.select(*COLUMNS)
    keyed = docs.withColumn("key", F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", F.xxhash64("text").alias("text_hash"))))
    groups = jaccard_components(keyed.select(F.col("key").alias("doc_id"), "text"), size=5, least=80, of=100)
    gone = groups.where("component_id != doc_id").select(F.col("doc_id").alias("key")).distinct()
    gone = Scratch(spark, "gone").save(gone, "keys")
    # Few keys go to where the texts are read; for more of them texts are shuffled.
    if gone.count() <= BROADCAST_IDS:
        gone = F.broadcast(gone)
    kept = keyed.join(gone, "key", "left_anti")
    repeated = groups.where("component_id = doc_id").groupBy(F.col("doc_id").alias("key")).agg(F.count(F.lit(1)).alias("rows")).where("rows > 1").select("key")
    if repeated.isEmpty():
        return kept.select(*COLUMNS)
    once = kept.join(repeated, "key", "left_anti").select(*COLUMNS)
    first = kept.join(repeated, "key", "left_semi").groupBy("key").agg(F.min(F.struct(*COLUMNS)).alias("row")).select("row.*")
    return once.union(first)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows without ten words in a row from a benchmark item."""
    return without_contaminated(docs.select(*COLUMNS), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, personal data replaced by its kind; ``n_chars`` follows the text."""
    cleaned = redact(docs.select(*COLUMNS))
    changed = F.when(F.col("n_chars").isNotNull(), F.length("text")).cast(docs.schema["n_chars"].dataType)
    return cleaned.withColumn("n_chars", changed).select(*COLUMNS)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows as pieces of sequences."""
    return pack_best_fit(tokenized_pieces(docs, public_tokenizers.path("word_bpe_49k.json")))


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("personal_data", personal_data),
    ("packing", packing),
]

#: Hyperdimensional vectors and packing are not SQL; tests compare the stages with plain Python.
ORACLE_SQL = None


@contextmanager
def _small_batches(spark: SparkSession) -> Iterator[None]:
    """Ten thousand texts at a time are held twice outside the heap and once by the worker."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(BATCH_BYTES))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder, each written and read again.

    What a stage has written for itself goes as soon as its documents are written.
    """
    kept = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = None
    for name, stage in STAGES[:-1]:
        with Scratch(spark, name), _small_batches(spark):
            docs = kept.save(stage(spark, docs, sf_dir), name)
        if before is not None:
            kept.drop(before)
        before = name
    return STAGES[-1][1](spark, docs, sf_dir)
