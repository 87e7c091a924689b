"""Scores of texts under an interpolated modified Kneser-Ney bigram model.

The model is counted in Spark and kept as sorted arrays in the shared folder. Workers map the
files into memory, so only the pages that a text touches are read, and no model is sent
around. Files are cut by the leading bits of word hashes into as many parts as there are
shuffle partitions (rounded up to a power of two), so they grow in number, not in size.

1. Words: each task sums the words of its texts, sorted by hash; every part is merged by one
   task and written as hashes and counts. A word's number is its place in all parts.
2. Bigrams: tasks look up the numbers of their words and sum pairs of numbers, dealt by the
   first word. Pairs after very frequent words (more than a quarter of a part's share of all
   words; at most four for each part) and after the start of a text are dealt by both words.
   A part is written as sorted pairs with counts, and how many words follow each first word
   once, twice, more often.
3. Continuations: from the distinct pairs, how many different words stand before each word.

What tasks hand on are sorted arrays as differences, in byte planes, compressed: about 4 bytes
for each pair. Tasks hand on after every few million entries, so their memory does not grow.

The probability of a word after another is the discounted share of its count, and what the
discounts leave is shared out by continuation counts, then evenly over all words and one
unknown word (Chen, Goodman 1999). Discounts follow from the counts of counts; where these
are too small for that, they are 0.5, 1 and 1.5.

``spark.checkpoint.dir`` must be a mounted folder (``file:`` or a plain path): other stores cannot be
mapped into memory. Files are written under another name and then renamed, so a task may run
twice.

Defined results: null is the empty text, which has one token, the end; without training texts
every token has base probability 1 (there is only the unknown word) and model probability 1.
Only ``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

import os
import struct
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import unquote, urlparse

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from kithwatch.llm.arrays import SPACES, mixed, slices, utf8, words
from kithwatch.operators.scratch import Scratch

#: Entries a task holds before it hands them on.
HELD = 3_000_000
_END = np.uint64(0x9D39247E33776D41)
_LOW = np.uint64(0xFFFFFFFF)
_UP = np.uint64(32)


def _folder(spark: SparkSession) -> str:
    where = urlparse(Scratch(spark, "kneser-ney").base)
    if where.scheme not in ("", "file"):
        raise ValueError("language models need spark.checkpoint.dir on a mounted folder (file:)")
    os.makedirs(unquote(where.path), exist_ok=True)
    return unquote(where.path)


def _write(path: str, values: np.ndarray) -> None:
    own = f"{path}.{os.getpid()}.{os.urandom(4).hex()}"
    values.tofile(own)
    os.replace(own, path)


def _mapped(path: str, kind: type) -> np.ndarray:
    return np.memmap(path, kind, "r") if os.path.getsize(path) else np.zeros(0, kind)


def _summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, each with the sum of its counts."""
    order = np.argsort(keys)
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, int)
    return keys[first], np.add.reduceat(counts, first) if len(first) else counts


def _packed(keys: np.ndarray, counts: np.ndarray) -> bytes:
    import zstandard

    steps = np.diff(keys, prepend=np.uint64(0))
    planes = np.ascontiguousarray(steps.view(np.uint8).reshape(-1, 8).T).tobytes()
    planes += np.ascontiguousarray(counts.astype(np.uint64).view(np.uint8).reshape(-1, 8).T).tobytes()
    return struct.pack("<q", len(keys)) + zstandard.ZstdCompressor(level=1).compress(planes)


def _unpacked(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    import zstandard

    (size,) = struct.unpack_from("<q", data)
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data[8:]), np.uint8).reshape(2, 8, size)
    steps, counts = (np.ascontiguousarray(plane.T).view(np.uint64).reshape(-1) for plane in planes)
    return np.cumsum(steps, dtype=np.uint64), counts.astype(np.int64)


class _Sums:
    """Keys with counts, gathered until they are handed on, one packed array for each part."""

    def __init__(self, parts: int):
        self.parts, self.keys, self.counts, self.held = parts, [], [], 0

    def add(self, keys: np.ndarray, counts: np.ndarray | None = None) -> None:
        if counts is None:
            keys, counts = np.unique(keys, return_counts=True)
        self.keys.append(keys)
        self.counts.append(counts)
        self.held += len(keys)

    def full(self) -> bool:
        return self.held > HELD

    def handed_on(self, part_of) -> Iterator[pa.RecordBatch]:
        if not self.held:
            return
        keys, counts = _summed(np.concatenate(self.keys), np.concatenate(self.counts))
        self.keys, self.counts, self.held = [], [], 0
        part = part_of(keys)
        order = np.argsort(part, kind="stable")
        keys, counts = keys[order], counts[order]
        bounds = np.searchsorted(part[order], np.arange(self.parts + 1))
        for number in np.flatnonzero(np.diff(bounds)).tolist():
            low, high = bounds[number], bounds[number + 1]
            data = _packed(keys[low:high], counts[low:high])
            yield pa.RecordBatch.from_pydict({"part": pa.array([number], pa.int32()), "data": pa.array([data], pa.binary())})


def _by_part(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Merged keys and counts of each part; the rows come sorted by part."""
    at, held = None, []
    for batch in batches:
        for number, data in zip(batch["part"].to_pylist(), batch["data"].to_pylist(), strict=True):
            if held and number != at:
                yield at, *_summed(np.concatenate([k for k, _ in held]), np.concatenate([c for _, c in held]))
                held = []
            at = number
            held.append(_unpacked(data))
    if held:
        yield at, *_summed(np.concatenate([k for k, _ in held]), np.concatenate([c for _, c in held]))


def _dealt(rows: DataFrame) -> DataFrame:
    """All rows of a part in one task; every part has a row, if an empty one."""
    count = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return rows.repartition(count, "part").sortWithinPartitions("part")


def _tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts, each text closed by the end; where each text begins."""
    found = words(data, offsets, SPACES)
    closes = found.first[1:] + np.arange(len(found.first) - 1)
    out = np.empty(len(found.hash) + len(closes), np.uint64)
    inside = np.ones(len(out), bool)
    inside[closes] = False
    out[closes], out[inside] = _END, found.hash
    return out, np.concatenate([[0], closes + 1])


@dataclass
class KneserNey:
    """A trained model: where its files are, and the few numbers that hold for all of it."""

    folder: str
    bits: int
    bases: np.ndarray  # number of the first word of each part, and of all words
    tokens: int
    hot: np.ndarray  # numbers of the first words whose pairs are dealt by both words
    hot_rows: np.ndarray  # their totals and followers seen once, twice, more often
    pair_discounts: np.ndarray
    word_discounts: np.ndarray
    pairs: int  # distinct
    word_classes: np.ndarray  # words with one, two, more words before them

    @property
    def size(self) -> int:
        return int(self.bases[-1])

    def part_of_pair(self, keys: np.ndarray) -> np.ndarray:
        first = keys >> _UP
        part = np.searchsorted(self.bases, first.astype(np.int64), "right") - 1
        hot = np.isin(first, self.hot)
        part[hot] = (mixed(keys[hot]) >> np.uint64(64 - self.bits)).astype(np.int64) if self.bits else 0
        return part


class _Files:
    """Looks values up in the mapped files of a model."""

    def __init__(self, model: KneserNey):
        self.model, self.maps = model, {}

    def get(self, name: str, part: int, kind: type) -> np.ndarray:
        if (name, part) not in self.maps:
            self.maps[name, part] = _mapped(f"{self.model.folder}/{name}-{part}", kind)
        return self.maps[name, part]

    def _find(self, keys: np.ndarray, part: np.ndarray, name: str, kind: type) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """For each part: which of the (sorted) keys are in it, and where."""
        order = np.argsort(part, kind="stable")
        bounds = np.searchsorted(part[order], np.arange((1 << self.model.bits) + 1))
        for number in np.flatnonzero(np.diff(bounds)).tolist():
            which = order[bounds[number] : bounds[number + 1]]
            stored = self.get(name, number, kind)
            if len(stored):
                place = np.minimum(np.searchsorted(stored, keys[which]), len(stored) - 1)
                good = stored[place] == keys[which]
                yield number, which[good], place[good]

    def numbers(self, hashes: np.ndarray) -> np.ndarray:
        """Number of each (sorted) word, the vocabulary's size for an unknown one."""
        out = np.full(len(hashes), self.model.size, np.int64)
        part = _part_of_word(hashes, self.model.bits)
        for number, which, place in self._find(hashes, part, "words", np.uint64):
            out[which] = self.model.bases[number] + place
        return out

    def of_words(self, numbers: np.ndarray, name: str, kind: type, width: int = 1) -> np.ndarray:
        """A row of stored values for each word; zeros for an unknown one."""
        out = np.zeros((len(numbers), width), np.int64)
        part = np.searchsorted(self.model.bases, numbers, "right") - 1
        for number in np.unique(part[numbers < self.model.size]).tolist():
            which = np.flatnonzero(part == number)
            stored = self.get(name, number, kind)
            if len(stored):
                out[which] = stored.reshape(-1, width)[numbers[which] - self.model.bases[number]]
        return out if width > 1 else out[:, 0]

    def pair_counts(self, keys: np.ndarray) -> np.ndarray:
        out = np.zeros(len(keys), np.int64)
        for number, which, place in self._find(keys, self.model.part_of_pair(keys), "pairs", np.uint64):
            out[which] = self.get("pair-counts", number, np.uint32)[place]
        return out


def _part_of_word(hashes: np.ndarray, bits: int) -> np.ndarray:
    return (hashes >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(hashes), np.int64)


def _pairs(files: _Files, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Numbers of all tokens, each with the one before (or the start) as a key; where texts begin."""
    hashes, first = _tokens(data, offsets)
    known, back = np.unique(hashes, return_inverse=True)
    number = files.numbers(known)[back]
    start = np.int64(files.model.size + 1)
    before = np.concatenate([[start], number[:-1]])
    before[first[:-1]] = start
    return number, (before.astype(np.uint64) << _UP) | number.astype(np.uint64), first


def _discounts(classes: np.ndarray) -> np.ndarray:
    """Discounts of counts 0, 1, 2 and 3 or more from how many keys have counts 1 to 4."""
    one, two, three, four = (float(n) for n in classes)
    if not (one and two and three and four):
        return np.array([0.0, 0.5, 1.0, 1.5])
    y = one / (one + 2 * two)
    found = [1 - 2 * y * two / one, 2 - 3 * y * three / two, 3 - 4 * y * four / three]
    return np.array([0.0, *(min(max(d, 0.0), float(k)) for k, d in enumerate(found, 1))])


def _followers(keys: np.ndarray, counts: np.ndarray, base: int, size: int) -> np.ndarray:
    """Total and numbers of followers seen once, twice, more often, for each first word."""
    first = (keys >> _UP).astype(np.int64) - base
    out = np.zeros((size, 4), np.int64)
    out[:, 0] = np.bincount(first, weights=counts, minlength=size).astype(np.int64)
    for column, chosen in enumerate((counts == 1, counts == 2, counts > 2), 1):
        out[:, column] = np.bincount(first[chosen], minlength=size)
    return out


def train(texts: DataFrame) -> KneserNey:
    """Count a model from the ``text`` column of all given rows."""
    spark = texts.sparkSession
    folder = _folder(spark)
    bits = (max(1, int(spark.conf.get("spark.sql.shuffle.partitions"))) - 1).bit_length()
    parts = 1 << bits
    texts = texts.select("text")

    def count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = _Sums(parts)
        for batch in slices(batches):
            sums.add(_tokens(*utf8(batch["text"]))[0])
            if sums.full():
                yield from sums.handed_on(lambda keys: _part_of_word(keys, bits))
        yield from sums.handed_on(lambda keys: _part_of_word(keys, bits))

    def store_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, keys, counts in _by_part(batches):
            _write(f"{folder}/words-{part}", keys)
            _write(f"{folder}/word-counts-{part}", counts.astype(np.uint64))
            # The most frequent words, as many as could be too frequent for one task.
            top = np.argsort(-counts, kind="stable")[: 4 * parts]
            yield pa.RecordBatch.from_pydict(
                {"part": pa.array([part], pa.int32()), "size": [len(keys)], "total": [int(counts.sum())], "place": [top.tolist()], "n": [counts[top].tolist()]}
            )

    handed = "part int, data binary"
    stored = _dealt(texts.mapInArrow(count_words, handed)).mapInArrow(store_words, "part int, size long, total long, place array<long>, n array<long>")
    rows = {row["part"]: row for row in stored.collect()}
    for part in set(range(parts)) - rows.keys():
        for name in ("words", "word-counts"):
            _write(f"{folder}/{name}-{part}", np.zeros(0, np.uint64))
    bases = np.cumsum([0, *(rows[part]["size"] if part in rows else 0 for part in range(parts))])
    tokens = sum(row["total"] for row in rows.values())
    hot = [bases[part] + place for part, row in rows.items() for place, n in zip(row["place"], row["n"], strict=True) if n * 4 * parts > tokens]
    start = int(bases[-1]) + 1
    hot = np.array(sorted([*hot, start]), np.uint64)
    none = np.zeros(4, np.int64)
    model = KneserNey(folder, bits, bases, tokens, hot, np.zeros((len(hot), 4), np.int64), _discounts(none), _discounts(none), 0, none[:3])

    def count_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, files = _Sums(parts), _Files(model)
        for batch in slices(batches):
            sums.add(_pairs(files, *utf8(batch["text"]))[1])
            if sums.full():
                yield from sums.handed_on(model.part_of_pair)
        yield from sums.handed_on(model.part_of_pair)

    def store_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, keys, counts in _by_part(batches):
            _write(f"{folder}/pairs-{part}", keys)
            _write(f"{folder}/pair-counts-{part}", counts.astype(np.uint32))
            often = np.isin(keys >> _UP, model.hot)
            base, size = int(bases[part]), int(bases[part + 1] - bases[part])
            _write(f"{folder}/followers-{part}", _followers(keys[~often], counts[~often], base, size).reshape(-1))
            place = np.searchsorted(model.hot, keys[often] >> _UP)
            shared = _followers(place.astype(np.uint64) << _UP, counts[often], 0, len(model.hot))
            classes = [int((counts == k).sum()) for k in range(1, 5)]
            yield pa.RecordBatch.from_pydict(
                {
                    "part": pa.array([part, -1], pa.int32()),
                    "data": pa.array([None, None], pa.binary()),
                    "numbers": [[len(keys), *classes], shared.reshape(-1).tolist()],
                }
            )
            sums = _Sums(parts)
            sums.add((keys & _LOW))
            for batch in sums.handed_on(lambda found: np.searchsorted(bases, found.astype(np.int64), "right") - 1):
                yield pa.RecordBatch.from_pydict({**{name: batch[name] for name in ("part", "data")}, "numbers": pa.array([None], pa.list_(pa.int64()))})

    def store_continuations(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, keys, counts in _by_part(batches):
            out = np.zeros(int(bases[part + 1] - bases[part]), np.uint32)
            out[keys.astype(np.int64) - bases[part]] = counts
            _write(f"{folder}/before-{part}", out)
            classes = [int((counts == k).sum()) for k in range(1, 5)]
            yield pa.RecordBatch.from_pydict({"numbers": [[len(keys), *classes]]})

    scratch = Scratch(spark, "kneser-ney-rows")
    pairs = _dealt(texts.mapInArrow(count_pairs, handed)).mapInArrow(store_pairs, "part int, data binary, numbers array<long>")
    pairs = scratch.save(pairs, "pairs")
    written, totals = set(), np.zeros(5, np.int64)
    for row in pairs.where("data is null").select("part", "numbers").collect():
        if row["part"] < 0:
            model.hot_rows += np.array(row["numbers"]).reshape(-1, 4)
        else:
            written.add(row["part"])
            totals += np.array(row["numbers"])
    for part in set(range(parts)) - written:
        _write(f"{folder}/pairs-{part}", np.zeros(0, np.uint64))
        _write(f"{folder}/pair-counts-{part}", np.zeros(0, np.uint32))
        _write(f"{folder}/followers-{part}", np.zeros(4 * int(bases[part + 1] - bases[part]), np.int64))
    model.pairs, model.pair_discounts = int(totals[0]), _discounts(totals[1:])
    spread = _dealt(pairs.where("data is not null").select("part", "data"))
    totals = np.zeros(5, np.int64)
    for row in spread.mapInArrow(store_continuations, "numbers array<long>").collect():
        totals += np.array(row["numbers"])
    model.word_discounts = _discounts(totals[1:])
    model.word_classes = np.array([totals[1], totals[2], totals[0] - totals[1] - totals[2]])
    return model


def _log_probabilities(files: _Files, number: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """log10 of the model's probability of each token after the one before."""
    model = files.model
    distinct, back = np.unique(keys, return_inverse=True)
    before, word = (distinct >> _UP).astype(np.int64), (distinct & _LOW).astype(np.int64)
    spread = float(model.word_discounts[1:] @ model.word_classes) / model.pairs if model.pairs else 1.0
    names, place = np.unique(word, return_inverse=True)
    seen = files.of_words(names, "before", np.uint32)
    low = (np.maximum(seen - model.word_discounts[np.minimum(seen, 3)], 0) / max(model.pairs, 1) + spread / (model.size + 1))[place]
    names, place = np.unique(before, return_inverse=True)
    rows = files.of_words(np.minimum(names, model.size), "followers", np.int64, 4)
    often = np.isin(names.astype(np.uint64), model.hot)
    rows[often] = model.hot_rows[np.searchsorted(model.hot, names[often].astype(np.uint64))]
    total = rows[:, 0]
    left = np.where(total > 0, (rows[:, 1:] @ model.pair_discounts[1:]) / np.maximum(total, 1), 1.0)
    count = files.pair_counts(distinct)
    high = np.maximum(count - model.pair_discounts[np.minimum(count, 3)], 0) / np.maximum(total[place], 1)
    return np.log10(high + left[place] * low)[back]


def score_texts(documents: DataFrame, model: KneserNey) -> DataFrame:
    """``(doc_id, n_tokens, n_known, train_tokens, base_score, score, perplexity)``, logarithms to base 10."""

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files = _Files(model)
        for part in slices(batches):
            number, keys, first = _pairs(files, *utf8(part["text"]))
            known, back = np.unique(number, return_inverse=True)
            count = files.of_words(known, "word-counts", np.uint64)[back]
            base = np.log10((count + 1) / (model.tokens + model.size + 1))
            tokens = np.diff(first)
            score = np.add.reduceat(_log_probabilities(files, number, keys), first[:-1])
            yield pa.RecordBatch.from_pydict(
                {
                    "doc_id": part["doc_id"],
                    "n_tokens": pa.array(tokens, pa.int64()),
                    "n_known": pa.array(np.add.reduceat((count > 0).astype(np.int64), first[:-1]), pa.int64()),
                    "train_tokens": pa.array(np.full(len(tokens), model.tokens), pa.int64()),
                    "base_score": np.add.reduceat(base, first[:-1]),
                    "score": score,
                    "perplexity": 10.0 ** np.minimum(-score / tokens, 300.0),
                }
            )

    kind = dict(documents.dtypes)["doc_id"]
    schema = f"doc_id {kind}, n_tokens long, n_known long, train_tokens long, base_score double, score double, perplexity double"
    return documents.select("doc_id", "text").mapInArrow(scored, schema)
