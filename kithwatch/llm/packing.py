"""Best-fit packing of tokenized documents into sequences of a fixed length.

Bulk-synchronous best fit, largest documents first. Pieces are range-sorted by length, each
gets its rank among those of its length, and the lengths are swept downwards in supersteps:

1. *successor sweep*: the pieces of one length look for the smallest gap that holds them;
2. *conflicts by rank*: the first of them, as many as the sequences with that gap can take,
   get those sequences in order of rank, the others go on to the next larger gap, the last
   ones open new sequences;
3. *update*: the gaps of all sequences that took something shrink together.

Pieces of one length are alike to the sweep, and gaps of one size too, so a superstep works
on at most ``capacity`` classes with their counts, however many documents there are: that
table is all the driver sees. It becomes a table of moves (length, from rank, to sequence),
bounded by the capacity as well, which every task applies to its own range of pieces. Sorting, ranking and
placing, where the rows are, are Spark jobs. The result is the one that best-fit decreasing gives when it takes the
pieces one by one.

Defined results: a null text is empty; a text without ids is one piece with the end id;
repeated rows and repeated doc_ids are pieces of their own; an empty table gives no rows.
Only ``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kithwatch.llm.arrays import runs, slices
from kithwatch.llm.tokens import Encoder
from kithwatch.operators.scratch import Scratch

CAPACITY = 2048
END_ID = 0


def tokenized_pieces(documents: DataFrame, tokenizer: str, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """``(doc_id, piece, start, length, ids_crc32)``, cut only where a document is longer.

    ``with_ids`` adds the ids of each piece as little-endian unsigned 32-bit numbers.
    """
    end = np.array([END_ID], "<u4").tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(tokenizer)
        for part in slices(batches):
            texts = [text or "" for text in part["text"].to_pylist()]
            ids = [found + end for found in encoder.encode(texts)]
            lengths = np.array([len(found) // 4 for found in ids])
            pieces = -(-lengths // capacity)
            number = runs(pieces)
            owner = np.repeat(np.arange(len(ids)), pieces)
            start = number * capacity
            length = np.minimum(capacity, lengths[owner] - start)
            chunks = [ids[k][4 * s : 4 * (s + n)] for k, s, n in zip(owner, start, length, strict=True)]
            columns = {
                "doc_id": part["doc_id"].take(pa.array(owner)),
                "piece": pa.array(number, pa.int32()),
                "start": pa.array(start, pa.int64()),
                "length": pa.array(length, pa.int64()),
                "ids_crc32": pa.array([zlib.crc32(chunk) for chunk in chunks], pa.int64()),
            }
            if with_ids:
                columns["ids"] = pa.array(chunks, pa.binary())
            yield pa.RecordBatch.from_pydict(columns)

    kind = dict(documents.dtypes)["doc_id"]
    schema = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids
    return documents.select("doc_id", "text").mapInArrow(cut, schema)


def best_fit_moves(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Supersteps over length classes: ``(length, first rank, first sequence, a sequence takes, offset)``.

    A move holds until the first rank of the next move of the same length.
    """
    gaps: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]
    filled = np.zeros(capacity + 1, bool)
    moves, opened = [], 0
    for length in sorted((n for n in counts if counts[n]), reverse=True):
        rank, left = 0, counts[length]
        while left:
            ahead = np.flatnonzero(filled[length:])
            if len(ahead):
                gap = length + int(ahead[0])
                first, bins = gaps[gap].pop()
            else:
                gap, first, bins = capacity, opened, -(-left // (capacity // length))
                opened += bins
            takes = gap // length
            whole, rest = divmod(min(left, bins * takes), takes)
            moves.append((length, rank, first, takes, capacity - gap))
            used = whole + (rest > 0)
            if used < bins:
                gaps[gap].append((first + used, bins - used))
            if whole and gap - takes * length:
                gaps[gap - takes * length].append((first, whole))
            if rest:
                gaps[gap - rest * length].append((first + whole, 1))
            for size in {gap, gap - takes * length, gap - rest * length}:
                filled[size] = bool(gaps[size]) and size > 0
            rank += whole * takes + rest
            left -= whole * takes + rest
    return moves


def pack_best_fit(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` with ``sequence_id`` and ``offset``; needs a ``length`` from 1 to ``capacity``.

    Pieces of a length are ranked over key ranges, so a length that most pieces share is
    ranked by as many tasks as its rows need.
    """
    spark = pieces.sparkSession
    scratch = Scratch(spark, "packing")
    columns = pieces.columns

    def ranked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rank among the pieces of its length in this range; the rows come sorted."""
        last, taken = -1, 0
        for batch in batches:
            length = batch["length"].to_numpy()
            if not len(length):
                continue
            heads = np.flatnonzero(np.concatenate([[True], length[1:] != length[:-1]]))
            rank = runs(np.diff(np.append(heads, len(length))))
            if length[0] == last:
                rank[: heads[1] if len(heads) > 1 else len(rank)] += taken
            last, taken = length[-1], rank[-1] + 1
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(rank, pa.int64())], names=[*batch.schema.names, "_rank"])

    order = ["length", *(name for name in ("doc_id", "piece", "start", "ids_crc32") if name in columns)]
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    kinds = ", ".join(f"`{name}` {kind}" for name, kind in pieces.dtypes)
    # Written first, else taking the sample for the ranges would tokenize everything once more.
    sorted_pieces = scratch.save(pieces, "pieces").repartitionByRange(parts, *order).sortWithinPartitions(*order)
    # Written, so that chunks and ranks stay the same however often they are read.
    ranges = sorted_pieces.mapInArrow(ranked, f"{kinds}, _rank long").withColumn("_chunk", F.spark_partition_id())
    ranges = scratch.save(ranges, "ranked")
    # At most one row for each length and one more for each range.
    sizes = ranges.groupBy("length", "_chunk").agg((F.max("_rank") + 1).alias("n"))
    before = Window.partitionBy("length").orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.withColumn("first", F.coalesce(F.sum("n").over(before), F.lit(0))).collect()
    counts: dict[int, int] = {}
    for row in starts:
        counts[row["length"]] = max(counts.get(row["length"], 0), row["first"] + row["n"])
    moves = np.array(sorted(best_fit_moves(counts, capacity)), np.int64).reshape(-1, 5)
    firsts = {(row["length"], row["_chunk"]): row["first"] for row in starts}
    key = (moves[:, 0] << 44) + moves[:, 1]

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, chunk = batch["length"].to_numpy(), batch["_chunk"].to_numpy()
            pair, back = np.unique(length * (1 << 32) + chunk, return_inverse=True)
            first = np.array([firsts[p >> 32, p & 0xFFFFFFFF] for p in pair.tolist()], np.int64)
            rank = batch["_rank"].to_numpy() + (first[back] if len(back) else 0)
            move = moves[np.searchsorted(key, (length << 44) + rank, "right") - 1]
            nth = rank - move[:, 1]
            sequence = move[:, 2] + nth // move[:, 3]
            offset = move[:, 4] + nth % move[:, 3] * length
            yield pa.RecordBatch.from_arrays([*(batch[name] for name in columns), pa.array(sequence), pa.array(offset)], names=[*columns, "sequence_id", "offset"])

    return ranges.mapInArrow(placed, f"{kinds}, sequence_id long, offset long")
