"""Removal of long byte strings that occur more than once, by merged Burrows-Wheeler transforms.

Which strings of ``length`` bytes occur twice is read off the suffix order of all texts:
neighbours with a common prefix that long. The order is not built by sorting suffixes, but by
merging the transforms of small shards (Holt, McMillan: "Merging of multi-string BWTs with
applications", 2014): from the plain concatenation of the shards, each pass moves every
suffix to its predecessor and refines the interleave by one more character, and a block
keeps those that agree so far. After ``length`` passes the blocks with two members or more
are the repeated intervals. Passes begin where windows end, ``length`` steps before they
would be complete, and leave out suffixes that are alone in their block.

To merge only what can repeat, texts are first cut into contexts by content:

1. Every window of ``length`` bytes is named after its smallest hashed 32-gram (leftmost at
   a tie), so equal windows have equal names at equal places. A run of windows with the same
   gram is a context: the bytes of all of them, 285 on average. Each window is in exactly
   one context.
2. A gram that occurs once has no repeated window. Where all contexts of a gram are equal,
   they are copies of one and repeated as a whole. These are decided by counting.
3. The distinct contexts that share a gram with different ones are what shards are made of.
   Contexts of a gram stay together in a task, which merges about a quarter of a megabyte at a time. A gram
   with more than ``spark.kithwatch.contexts`` of them (2,000) is not given to one task: its windows
   are counted one by one, by a hash, with sums before the shuffle.

Hashes stand for grams, contexts and (for crowded grams) windows: pairs of 64 bits.

Defined results: null is the empty text; texts shorter than ``length`` keep everything; a row
that occurs twice is two documents. ``doc_id`` may be null or repeated. Only ``doc_id`` and
``text`` are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kithwatch.llm.arrays import Rolling, mixed, runs, slices, utf8
from kithwatch.operators.scratch import Scratch

LENGTH = 200
GRAM = 32
UNIT_BYTES = 1 << 18
SHARDS = 8
_PLACE = np.uint64((1 << 30) - 1)


def contexts_of(data: np.ndarray, offsets: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """``(first window, windows, place of the gram, gram's hash, context's hash)`` of each context."""
    none = tuple(np.zeros(0, kind) for kind in (np.int64, np.int64, np.int64, np.uint64, np.uint64))
    if len(data) < length:
        return none
    rolling = Rolling(data)
    at = np.arange(len(data) - gram + 1)
    hashes = rolling.of(at, at + gram)
    least = (hashes & ~_PLACE) | at.astype(np.uint64)
    span, width = 1, length - gram + 1
    while span * 2 <= width:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    if width > span:
        least = np.minimum(least[: len(least) - (width - span)], least[width - span :])
    ends = np.repeat(offsets[1:], np.diff(offsets))[: len(least)]
    start = np.flatnonzero(np.arange(len(least)) + length <= ends)
    if not len(start):
        return none
    place = (least[start] & _PLACE).astype(np.int64)
    head = np.ones(len(start), bool)
    head[1:] = (place[1:] != place[:-1]) | (start[1:] != start[:-1] + 1)
    first = np.flatnonzero(head)
    count = np.diff(np.append(first, len(start)))
    start, place = start[first], place[first]
    shape = (count << 20) | (place - start)
    context = mixed(rolling.of(start, start + count - 1 + length) ^ mixed(shape.astype(np.uint64)))
    return start, count, place, hashes[place], context


class _Shard:
    """Transform of some strings: the byte before each suffix, in suffix order, and where that suffix is."""

    def __init__(self, strings: list[bytes], length: int):
        sizes = np.array([len(s) + 1 for s in strings])
        ends = np.cumsum(sizes) - 1
        text = np.zeros(int(sizes.sum()), np.int64)
        body = np.ones(len(text), bool)
        body[ends] = False
        text[body] = np.frombuffer(b"".join(strings), np.uint8).astype(np.int64) + 1
        # Seven symbols at once, then doubled. What reaches past its string's end differs from all others.
        ahead = np.concatenate([text, np.zeros(6, np.int64)])
        rank = np.zeros(len(text), np.int64)
        for k in range(7):
            rank = rank * 257 + ahead[k : k + len(text)]
        rest = np.repeat(ends, sizes) - np.arange(len(text))
        span = 7
        order, rank = self._ranked(rank, rest < span)
        while span < length:
            after = np.zeros(len(rank), np.int64)
            after[:-span] = rank[span:]
            span *= 2
            order, rank = self._ranked(rank * len(rank) + after, rest < span)
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        heads = ends - sizes + 1
        before = np.arange(len(text)) - 1
        before[heads] = ends
        symbol = np.where(body, text - 1, 0)[before]
        self.symbols = symbol[order].astype(np.uint8)
        self.previous = place[before][order]  # suffix order of the suffix one byte longer
        number = np.repeat(np.arange(len(strings)), sizes)
        self.string, self.offset = number[order], (np.arange(len(text)) - heads[number])[order]


    @staticmethod
    def _ranked(key: np.ndarray, alone: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Order of the keys and their ranks; equal keys marked ``alone`` are told apart by place."""
        order = np.argsort(key)
        ranked = key[order]
        new = np.zeros(len(key), np.int64)
        new[1:] = (ranked[1:] != ranked[:-1]) | alone[order[1:]]
        rank = np.empty(len(key), np.int64)
        rank[order] = np.cumsum(new)
        return order, rank


def repeated_windows(strings: list[bytes], length: int, shards: int = SHARDS) -> tuple[np.ndarray, np.ndarray]:
    """``(string, offset)`` of every window of ``length`` bytes that these strings have twice."""
    step = -(-len(strings) // max(1, min(shards, len(strings))))
    parts = [_Shard(strings[k : k + step], length) for k in range(0, len(strings), step)]
    shifts = np.cumsum([0, *(len(part.symbols) for part in parts)])
    symbols = np.concatenate([part.symbols for part in parts])
    previous = np.concatenate([part.previous + shift for part, shift in zip(parts, shifts, strict=False)]).astype(np.int32)
    offsets = np.concatenate([part.offset for part in parts])
    # Shard after shard, nothing compared yet: the places where a window ends.
    order = np.flatnonzero(offsets >= length).astype(np.int32)
    block = np.zeros(len(order), np.int32)
    for _ in range(length):
        symbol = symbols[order]
        moved = np.argsort(symbol, kind="stable")
        symbol, block = symbol[moved], block[moved]
        order = previous[order[moved]]
        new = np.ones(len(order) + 1, bool)
        new[1:-1] = (symbol[1:] != symbol[:-1]) | (block[1:] != block[:-1])
        shared = ~(new[:-1] & new[1:])  # not alone in its block
        block = np.cumsum(new[:-1], dtype=np.int32)[shared]
        order = order[shared]
        if not len(order):
            break
    string = np.concatenate([part.string + k * step for k, part in enumerate(parts)])[order]
    return string, offsets[order]


def _signed(hashes: np.ndarray) -> pa.Array:
    return pa.array(hashes.view(np.int64))


def _packed(documents: DataFrame) -> DataFrame:
    """Rows with compressed text, which halves what travels, under a name of their own."""
    import zstandard

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=1)
        for part in slices(batches):
            data = [press.compress((text or "").encode()) for text in part["text"].to_pylist()]
            yield pa.RecordBatch.from_pydict({"doc_id": part["doc_id"], "row": part["row"], "size": part["size"], "packed": pa.array(data, pa.binary())})

    kind = dict(documents.dtypes)["doc_id"]
    return documents.mapInArrow(pack, f"doc_id {kind}, row long, size long, packed binary")


def _anchors(documents: DataFrame, length: int, gram: int) -> DataFrame:
    """``(row, size, spot, gram, context)``; ``spot`` holds first window, windows and gram's place."""

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            data, offsets = utf8(part["text"])
            start, count, place, grams, names = contexts_of(data, offsets, length, gram)
            owner = np.searchsorted(offsets, start, "right") - 1
            spot = ((start - offsets[owner]) << 20) | (count << 10) | (place - start)
            row = part["row"].to_numpy()[owner] if len(owner) else np.zeros(0, np.int64)
            size = part["size"].to_numpy()[owner] if len(owner) else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_pydict({"row": row, "size": size, "spot": spot, "gram": _signed(grams), "context": _signed(names)})

    return documents.select("row", "size", "text").mapInArrow(found, "row long, size long, spot long, gram long, context long")


def _cut_contexts(wanted: DataFrame, packed: DataFrame, length: int) -> DataFrame:
    """``(gram, context, n, windows, bytes)`` for one occurrence of each context."""
    import zstandard

    lists = wanted.groupBy("row", "size").agg(F.collect_list(F.struct("gram", "context", "n", "spot")).alias("items"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdDecompressor()
        for batch in batches:
            out: dict[str, list] = {"gram": [], "context": [], "n": [], "windows": [], "bytes": []}
            for data, items in zip(batch["packed"].to_pylist(), batch["items"].to_pylist(), strict=True):
                text = press.decompress(data)
                for item in items:
                    start, windows = item["spot"] >> 20, (item["spot"] >> 10) & 1023
                    for name in ("gram", "context", "n"):
                        out[name].append(item[name])
                    out["windows"].append(windows)
                    out["bytes"].append(text[start : start + windows - 1 + length])
            yield pa.RecordBatch.from_pydict({name: pa.array(values, pa.binary() if name == "bytes" else pa.int64()) for name, values in out.items()})

    found = lists.join(packed, ["row", "size"]).select("packed", "items")
    return found.mapInArrow(cut, "gram long, context long, n long, windows long, bytes binary")


def _merged(contexts: DataFrame, length: int, unit: int) -> DataFrame:
    """``(gram, context, low, high)``: runs of repeated windows in contexts that occur once."""

    def unit_runs(rows: list[tuple]) -> pa.RecordBatch:
        string, offset = repeated_windows([row[2] for row in rows], length)
        keys = np.unique(string * (1 << 20) + offset)
        head = np.ones(len(keys), bool)
        head[1:] = keys[1:] != keys[:-1] + 1
        low = keys[head]
        high = keys[np.append(np.flatnonzero(head)[1:] - 1, len(keys) - 1)] if len(keys) else low
        which = (low >> 20).tolist()
        return pa.RecordBatch.from_pydict(
            {
                "gram": pa.array([rows[k][0] for k in which], pa.int64()),
                "context": pa.array([rows[k][1] for k in which], pa.int64()),
                "low": low & ((1 << 20) - 1),
                "high": high & ((1 << 20) - 1),
            }
        )

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        held = 0
        for batch in batches:
            for row in zip(*(batch[name].to_pylist() for name in ("gram", "context", "bytes")), strict=True):
                if held >= unit and row[0] != rows[-1][0]:
                    yield unit_runs(rows)
                    rows, held = [], 0
                rows.append(row)
                held += len(row[2])
        if rows:
            yield unit_runs(rows)

    parts = max(1, int(contexts.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = contexts.select("gram", "context", "bytes").repartition(parts, "gram").sortWithinPartitions("gram")
    return dealt.mapInArrow(merge, "gram long, context long, low long, high long")


def _counted(contexts: DataFrame, length: int) -> DataFrame:
    """The same for grams with too many contexts for one task, by counting windows."""

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, text="bytes", limit=1 << 18):
            count = part["windows"].to_numpy()
            data = np.frombuffer(b"".join(part["bytes"].to_pylist()), np.uint8)
            first = np.concatenate([[0], np.cumsum(count - 1 + length)[:-1]]).astype(np.int64)
            owner, place = np.repeat(np.arange(len(count)), count), runs(count)
            start = first[owner] + place
            one = Rolling(data).of(start, start + length)
            half = Rolling(data[::-1]).of(len(data) - start - length, len(data) - start)
            yield pa.RecordBatch.from_pydict(
                {
                    "gram": part["gram"].to_numpy()[owner],
                    "context": part["context"].to_numpy()[owner],
                    "n": part["n"].to_numpy()[owner],
                    "low": place,
                    "one": _signed(one),
                    "half": _signed(half),
                }
            )

    each = contexts.mapInArrow(windows, "gram long, context long, n long, low long, one long, half long")
    twice = each.groupBy("one", "half").agg(F.sum("n").alias("all")).where("all > 1").select("one", "half")
    return each.join(twice, ["one", "half"], "left_semi").select("gram", "context", "low", F.col("low").alias("high"))


def remove_repeats(documents: DataFrame, length: int = LENGTH, gram: int = GRAM, unit: int = UNIT_BYTES) -> DataFrame:
    """``(doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept)`` of every row.

    ``kept`` are the remaining bytes; a character may have been cut, so they need not be UTF-8.
    """
    import zstandard

    spark = documents.sparkSession
    scratch = Scratch(spark, "repeats")
    crowded = int(spark.conf.get("spark.kithwatch.contexts", "2000"))
    named = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    named = named.withColumns({"row": F.xxhash64("doc_id", "text"), "size": F.octet_length("text").cast("long")})
    packed = _packed(named)
    anchors = scratch.save(_anchors(named, length, gram), "anchors")
    grams = anchors.groupBy("gram").agg(F.count(F.lit(1)).alias("n"), F.min("context").alias("one"), F.max("context").alias("other"))
    found = anchors.join(grams.where("n > 1").select("gram", F.expr("one != other").alias("differ")), "gram")
    found = scratch.save(found, "found")
    start, windows = F.shiftright("spot", 20), F.shiftright("spot", 10).bitwiseAND(1023)
    whole = found.where("not differ").select("row", "size", start.alias("low"), (start + windows + (length - 1)).alias("high"))

    mixed_grams = found.where("differ")
    distinct = mixed_grams.groupBy("gram", "context").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("row", "size", "spot")).alias("at"))
    contexts = scratch.save(_cut_contexts(distinct.select("gram", "context", "n", "at.*"), packed, length), "contexts")
    many = contexts.groupBy("gram").count().where(F.col("count") > crowded).select("gram")
    parts = contexts.where("n > 1").select("gram", "context", F.lit(0).cast("long").alias("low"), (F.col("windows") - 1).alias("high"))
    parts = parts.union(_merged(contexts.join(many, "gram", "left_anti"), length, unit))
    parts = parts.union(_counted(contexts.join(many, "gram", "left_semi"), length))
    parts = scratch.save(parts, "parts")
    some = mixed_grams.join(parts, ["gram", "context"]).select(
        "row", "size", (start + F.col("low")).alias("low"), (start + F.col("high") + length).alias("high")
    )
    spans = whole.union(some).groupBy("row", "size").agg(
        F.collect_set(F.shiftleft("low", 32).bitwiseOR(F.col("high"))).alias("spans")
    )

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdDecompressor()
        for batch in batches:
            out: dict[str, list] = {"n_bytes": [], "n_removed": [], "n_spans": [], "kept_sha256": [], "kept": []}
            for data, spans in zip(batch["packed"].to_pylist(), batch["spans"].to_pylist(), strict=True):
                text = press.decompress(data) if data else b""
                pieces, at, removed, count, last = [], 0, 0, 0, -1
                for span in sorted(spans or ()):
                    low, high = span >> 32, span & 0xFFFFFFFF
                    if low > last:
                        count += 1
                    if high > at:
                        pieces.append(text[at : max(at, low)])
                        removed += high - max(at, low)
                        at = high
                    last = max(last, high)
                pieces.append(text[at:])
                kept = b"".join(pieces)
                for name, value in zip(out, (len(text), removed, count, hashlib.sha256(kept).hexdigest(), kept), strict=True):
                    out[name].append(value)
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], *(pa.array(out[n], pa.int64()) for n in ("n_bytes", "n_removed", "n_spans")), pa.array(out["kept_sha256"], pa.string()), pa.array(out["kept"], pa.binary())],
                names=["doc_id", *out],
            )

    kind = dict(documents.dtypes)["doc_id"]
    joined = packed.join(spans, ["row", "size"], "left").select("doc_id", "packed", "spans")
    return joined.mapInArrow(keep, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
