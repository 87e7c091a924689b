"""Cost-balanced packing of tokenized documents: no padding, and sequences that cost about the same.

A document of n tokens costs ``linear * n + quadratic * n^2``: projections and layers take time
in proportion to its tokens, attention (within a document) to their square. A task gathers
the documents it reads into shards of about ``SHARD_TOKENS`` tokens and deals each shard to
sequences of its own:

1. *descending documents*: the longest piece first, to the sequence of lowest cost among those
   with room for it (a heap of costs; a sequence too full for the current length waits until
   the lengths have come down to its room);
2. *cuts*: pieces that no sequence can take whole are cut to fill what room is left, the
   longest into the largest. A document longer than a sequence is cut first, into equal parts of at
   most ``LONGEST`` tokens: a part that fills a sequence costs most of all, and leaves no room by
   which its cost could be balanced.

The room of a shard's sequences is exactly the number of its tokens, so nothing is padded:
what goes beyond whole sequences moves on to the next shard, and at the end of a task to
sequences whose sizes are the powers of two that add up to it.

Documents never leave their task: one pass over the text, no shuffle, memory of a shard (plus
the longest text). Sequences are balanced within a shard of about a thousand; a key or source
that holds many rows is spread over shards as its rows are. Numbers follow from the partition
and the order of its rows, so a task that is run again gives the same rows wherever its input
does, as a written table does.

Defined results: a null or empty text is its end id alone; repeated rows and ids are documents
of their own, a null id stays null; an empty table gives no rows. Equal lengths are dealt in
order of their rows. Columns but ``doc_id`` and ``text`` are ignored, whatever their names.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from kithwatch.llm.arrays import runs, slices
from kithwatch.llm.tokens import Encoder

CAPACITY, LONGEST = 2048, 1536
END_ID = 1
SHARD_TOKENS = 1 << 21
#: Cost of a token and of a pair of tokens: a layer of width d takes about 24 d^2 operations for
#: each token and 4 d for each pair, which is 6 d to 1, here for a width of 1,024.
LINEAR, QUADRATIC = 6.0 * 1024, 1.0


def deal(lengths: np.ndarray, rooms: np.ndarray, linear: float = LINEAR, quadratic: float = QUADRATIC) -> tuple[np.ndarray, np.ndarray]:
    """The sequence of each piece (-1: no room for all of it), longest first, and the room left."""
    room, cost = rooms.tolist(), [0.0] * len(rooms)
    heap = [(0.0, sequence) for sequence in range(len(room))]
    shown = max(room, default=0)
    waiting: list[list[int]] = [[] for _ in range(shown + 1)]
    placed = np.full(len(lengths), -1, np.int64)
    for piece in np.argsort(-lengths, kind="stable").tolist():
        need = int(lengths[piece])
        while shown > need:
            shown -= 1
            for sequence in waiting[shown]:
                heapq.heappush(heap, (cost[sequence], sequence))
            waiting[shown] = []
        while heap and room[heap[0][1]] < need:
            _, sequence = heapq.heappop(heap)
            waiting[room[sequence]].append(sequence)
        if not heap:
            continue
        sequence = heap[0][1]
        placed[piece] = sequence
        room[sequence] -= need
        cost[sequence] += linear * need + quadratic * need * need
        if room[sequence]:
            heapq.heapreplace(heap, (cost[sequence], sequence))
        else:
            heapq.heappop(heap)
    return placed, np.array(room, np.int64)


def _overlay(pieces: np.ndarray, rooms: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pieces laid end to end over rooms laid end to end: piece, room and length of each part."""
    ends, limits = np.cumsum(pieces), np.cumsum(rooms)
    stops = np.union1d(ends, limits)
    return np.searchsorted(ends, stops), np.searchsorted(limits, stops), np.diff(stops, prepend=0)


def pack_shard(lengths: np.ndarray, rooms: np.ndarray, linear: float = LINEAR, quadratic: float = QUADRATIC) -> tuple[np.ndarray, ...]:
    """``(piece, start, length, sequence, offset)`` of parts that fill rooms of the same total exactly.

    Parts come in order of sequence and offset.
    """
    placed, left = deal(lengths, rooms, linear, quadratic)
    whole, over = np.flatnonzero(placed >= 0), np.flatnonzero(placed < 0)
    over = over[np.argsort(-lengths[over], kind="stable")]
    free = np.flatnonzero(left)
    free = free[np.argsort(-left[free], kind="stable")]
    cut, gap, size = _overlay(lengths[over], left[free])
    start = np.cumsum(size) - size - (np.cumsum(lengths[over]) - lengths[over])[cut]
    piece = np.concatenate([whole, over[cut]])
    sequence = np.concatenate([placed[whole], free[gap]])
    start = np.concatenate([np.zeros(len(whole), np.int64), start])
    length = np.concatenate([lengths[whole], size])
    order = np.argsort(sequence, kind="stable")
    piece, start, length, sequence = piece[order], start[order], length[order], sequence[order]
    offset = np.cumsum(length) - length
    first = np.flatnonzero(np.diff(sequence, prepend=-1))
    return piece, start, length, sequence, offset - np.repeat(offset[first], np.diff(first, append=len(offset)))


class _Shard:
    """Documents, or what is left of them, that wait to be dealt."""

    def __init__(self, capacity: int):
        self.capacity, self.total = capacity, 0
        #: Ids of the documents seen since the last shard, and how many these are.
        self.keys: list[pa.Array] = []
        self.seen = 0
        #: Place among these ids, all tokens of the document, first token here, token ids.
        self.held: list[tuple[int, int, int, bytes]] = []

    def add(self, keys: pa.Array, found: list[bytes]) -> None:
        self.keys.append(keys)
        self.held.extend((place, len(ids) // 4, 0, ids) for place, ids in enumerate(found, self.seen))
        self.seen += len(keys)
        self.total += sum(map(len, found)) // 4

    def take(self, last: bool) -> tuple[pa.Array, list[tuple[int, int, int, bytes]], np.ndarray]:
        """Ids, documents for whole sequences and the rooms of these; at the end all, with small rooms."""
        rest = self.total % self.capacity
        rooms = [self.capacity] * (self.total // self.capacity)
        later = []
        if last:
            rooms += [1 << bit for bit in range(rest.bit_length() - 1, -1, -1) if rest >> bit & 1]
        else:
            while rest:
                key, tokens, first, ids = self.held.pop()
                keep = max(0, len(ids) // 4 - rest)
                rest -= len(ids) // 4 - keep
                if keep:
                    self.held.append((key, tokens, first, ids[: 4 * keep]))
                later.append((key, tokens, first + keep, ids[4 * keep :]))
        keys = pa.concat_arrays(self.keys) if self.keys else pa.nulls(0)
        taken, later = self.held, later[::-1]
        self.held = [(place, *rest) for place, (_, *rest) in enumerate(later)]
        self.keys, self.seen = [keys.take(pa.array([place for place, *_ in later], pa.int64()))], len(later)
        self.total = sum(len(ids) // 4 for _, _, _, ids in self.held)
        return keys, taken, np.array(rooms, np.int64)


def pack_balanced(
    documents: DataFrame,
    tokenizer: str,
    capacity: int = CAPACITY,
    end_id: int = END_ID,
    linear: float = LINEAR,
    quadratic: float = QUADRATIC,
    longest: int | None = None,
    shard_tokens: int = SHARD_TOKENS,
    with_ids: bool = False,
) -> DataFrame:
    """``(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset)``, one row per piece.

    Sequences hold ``capacity`` tokens, but for at most one of each smaller power of two in
    every task. ``longest`` (three quarters of ``capacity``, if not given) limits the parts of documents
    beyond the capacity. ``with_ids`` adds the ids of each piece as little-endian unsigned 32-bit numbers.
    """
    end = np.array([end_id], "<u4").tobytes()
    limit = longest or max(1, capacity * LONGEST // CAPACITY)
    kind = dict(documents.dtypes)["doc_id"]
    schema = f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + ", ids binary" * with_ids

    def dealt(shard: _Shard, last: bool, number: int) -> tuple[pa.RecordBatch | None, int]:
        keys, taken, rooms = shard.take(last)
        if not taken:
            return None, number
        place, tokens, first, ids = zip(*taken, strict=True)
        place, tokens, first = np.array(place), np.array(tokens), np.array(first)
        sizes = np.array(list(map(len, ids))) // 4
        parts = np.where(sizes > capacity, -(-sizes // limit), 1)
        owner, nth = np.repeat(np.arange(len(taken)), parts), runs(parts)
        low, high = nth * sizes[owner] // parts[owner], (nth + 1) * sizes[owner] // parts[owner]
        piece, start, length, sequence, offset = pack_shard(high - low, rooms, linear, quadratic)
        owner, low = owner[piece], low[piece] + start
        chunks = [ids[k][a:z] for k, a, z in zip(owner.tolist(), (4 * low).tolist(), (4 * (low + length)).tolist(), strict=True)]
        base = (TaskContext.get().partitionId() << 40) + number
        columns = {
            "doc_id": keys.take(pa.array(place[owner])),
            "start": pa.array(first[owner] + low),
            "length": pa.array(length),
            "ids_crc32": pa.array(list(map(zlib.crc32, chunks)), pa.int64()),
            "doc_tokens": pa.array(tokens[owner]),
            "sequence_id": pa.array(base + sequence),
            "offset": pa.array(offset),
        }
        if with_ids:
            columns["ids"] = pa.array(chunks, pa.binary())
        return pa.RecordBatch.from_pydict(columns), number + len(rooms)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, shard, number = Encoder(tokenizer), _Shard(capacity), 0
        for part in slices(batches):
            texts = [text or "" for text in part["text"].to_pylist()]
            shard.add(part["doc_id"], [found + end for found in encoder.encode(texts)])
            if shard.total >= shard_tokens:
                made, number = dealt(shard, False, number)
                if made is not None:
                    yield made
        made, number = dealt(shard, True, number)
        if made is not None:
            yield made

    return documents.select("doc_id", "text").mapInArrow(pack, schema)
