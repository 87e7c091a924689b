"""Folders of block files with transactions as JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kithwatch.functions.expressions import Moment, moment, transaction_time

# Fixed value: the fields of a block file that are read.
BLOCK_SCHEMA = (
    "data array<struct<time: string, confirmations: bigint, is_coinbase: boolean, "
    "inputs: array<struct<address: string>>, "
    "outputs: array<struct<address: string, value: decimal(38,0)>>>>"
)


def _options(reader, one_per_line: bool):
    """Batch and stream read alike; a malformed file fails the run, it is never left out."""
    return reader.schema(BLOCK_SCHEMA).option("multiLine", not one_per_line).option("mode", "FAILFAST")


def transactions_of(blocks: DataFrame, lenient_time: bool = False) -> DataFrame:
    """One row per transaction of a table of blocks, its time as timestamp."""
    return (
        blocks.select(F.explode("data").alias("tx"))
        .select("tx.*")
        .withColumn("time", transaction_time("time", lenient_time))
    )


def read_transactions(
    spark: SparkSession, path: str, one_per_line: bool = False, lenient_time: bool = False
) -> DataFrame:
    """Transactions of a folder of block files, one block per file or per line.

    The schema is given, so no pass over the files is spent on guessing it.
    """
    return transactions_of(_options(spark.read, one_per_line).json(path), lenient_time)


def stream_transactions(
    spark: SparkSession,
    path: str,
    one_per_line: bool = False,
    files_per_batch: int = 1000,
    lenient_time: bool = False,
) -> DataFrame:
    """The same as a stream of the files that arrive in the folder."""
    reader = _options(spark.readStream, one_per_line).option("maxFilesPerTrigger", files_per_batch)
    return transactions_of(reader.json(path), lenient_time)


def save_transactions(transactions: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """A columnar copy of transactions in a folder per day, so that a window reads its days only.

    Days are written by as many tasks as their rows need.
    """
    dated = transactions.withColumn("day", F.to_date("time")).hint("rebalance", "day")
    dated.write.mode(mode).partitionBy("day").parquet(path)


def load_transactions(spark: SparkSession, path: str, start: Moment = None, end: Moment = None) -> DataFrame:
    """Transactions of the days from ``start`` to ``end`` of such a copy.

    Whether a time at a bound counts is left to who uses them, as networks differ in it.
    """
    kept = F.lit(True)
    if start is not None:
        kept = kept & (F.col("day") >= F.to_date(moment(start)))
    if end is not None:
        kept = kept & (F.col("day") <= F.to_date(moment(end)))
    return spark.read.parquet(path).where(kept).drop("day")
