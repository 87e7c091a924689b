"""Language identification with hyperdimensional profiles.

Every letter has a random vector of +1 and -1. An n-gram is the product of its letters'
vectors, the vector at place i being rotated i times. A text is the sum of the vectors of
its n-grams, a language the sum of its texts, both taken relative to the mean language, and
a text belongs to the language whose prototype has the largest cosine with it
(Joshi, Halseth, Kanerva: "Language Geometry using Random Indexing", 2016).

The sum over n-grams is a product of counts and n-gram vectors. A slice of texts has a few
thousand different n-grams, so the counts of the slice are one small dense matrix.

What is in no known language scores low too, and so does a short text. ``in_known_language``
takes the bound between both from labelled rows, each scored by prototypes that have not seen it,
among texts with about as many different n-grams: repeating a word adds nothing to judge by.

Defined results: a text that is null, empty or without a letter is ``und`` with score 0, as
is every text when nothing could be learned; ties go to the first language by name. Other
columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kithwatch.llm.arrays import LOWER, mixed, slices, utf8

UNKNOWN = "und"
DIMENSIONS = 1024
#: Rows of each language, at most about so many, that the prototypes are learned from.
LEARNED_ROWS = 20_000
#: Parts that labelled rows are held out by when the bounds are calibrated.
FOLDS = 4
#: Kept is what scores above this share of the score that all but one in RARE labelled rows reach.
MARGIN, RARE = 0.5, 100
#: Fewer labelled rows of a length than this are joined by the next shorter ones, of a language by other rare ones.
LEAST_ROWS = 10
_BINS = 400
_SEED = 0x5EED
_letters: dict[str, np.ndarray] = {}


def _is_letter() -> np.ndarray:
    """One flag for each code point."""
    if "flags" not in _letters:
        _letters["flags"] = np.array([chr(i).isalpha() for i in range(0x110000)], bool)
    return _letters["flags"]


def _lower_case() -> np.ndarray:
    """The lower case of each code point by itself: one code point, whatever stands beside it."""
    if "lower" not in _letters:
        _letters["lower"] = np.array([ord(chr(i).lower()[0]) for i in range(0x110000)], np.uint32)
    return _letters["lower"]


def _letter_vectors(points: np.ndarray, dimensions: int) -> np.ndarray:
    """The random vector of each code point, the same in every task."""
    blocks = np.arange(-(-dimensions // 64), dtype=np.uint64)
    bits = mixed(mixed(points.astype(np.uint64)[:, None] + np.uint64(_SEED << 32)) + blocks[None, :])
    flags = np.unpackbits(bits.view(np.uint8), axis=1)[:, :dimensions]
    return flags.astype(np.float32) * 2 - 1


class Profiles:
    """Turns slices of texts into vectors; remembers the n-grams it has seen."""

    def __init__(self, dimensions: int, size: int = 3, most: int = 1 << 13):
        self.dimensions, self.size, self.most = dimensions, size, most
        #: Different n-grams of each text of the last call of ``of``.
        self.different = np.zeros(0, np.int64)
        #: Keys in order, and where the vector of each is.
        self.keys, self.places = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        # Taken once and filled as n-grams are seen, so that learning more copies none of them.
        self.vectors = np.empty((most, dimensions), np.float32)

    def _ngrams(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Key and text of every n-gram of letters, a word being set in blanks; texts with letters."""
        if (data >= 0x80).any():
            points = _lower_case()[np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)]
        else:
            points = LOWER[data].astype(np.uint32)
        heads = (data & 0xC0) != 0x80
        bounds = np.concatenate([[0], np.cumsum(heads)])[offsets]
        letter = _is_letter()[points]
        # Every text gets a blank on both sides, every run of other characters counts as one.
        owner = np.repeat(np.arange(len(offsets) - 1), np.diff(bounds))
        blank = ~letter
        keep = letter | np.concatenate([[True], letter[:-1] | (owner[1:] != owner[:-1])])[: len(letter)]
        points, owner = np.where(blank, np.uint32(32), points)[keep], owner[keep]
        key = points.astype(np.uint64)
        for step in range(1, self.size):
            key = key[:-1] * np.uint64(1 << 21) + points[step:]
        same = owner[: len(key)] == owner[self.size - 1 :]
        seen = np.bincount(owner[points != 32], minlength=len(offsets) - 1) > 0
        return key[same], owner[: len(key)][same], seen

    def _learn(self, keys: np.ndarray) -> None:
        new = np.setdiff1d(keys, self.keys)
        if not len(new):
            return
        if len(self.keys) + len(new) > self.most:
            self.keys, self.places = self.keys[:0], self.places[:0]
            new = np.unique(keys)
            if len(self.vectors) != max(self.most, len(new)):
                self.vectors = np.empty((max(self.most, len(new)), self.dimensions), np.float32)
        held = len(self.keys)
        made = self.vectors[held : held + len(new)]
        made[:] = 1
        for place in range(self.size):
            points = (new >> np.uint64(21 * (self.size - 1 - place))) & np.uint64((1 << 21) - 1)
            distinct, back = np.unique(points, return_inverse=True)
            letters = np.roll(_letter_vectors(distinct, self.dimensions), place, axis=1)
            for low in range(0, len(new), 1024):
                made[low : low + 1024] *= letters[back[low : low + 1024]]
        order = np.argsort(np.concatenate([self.keys, new]), kind="stable")
        self.keys = np.concatenate([self.keys, new])[order]
        self.places = np.concatenate([self.places, np.arange(held, held + len(new))])[order]

    def of(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """One vector per text, of length 1 (0 without n-grams), and whether it has letters."""
        rows = len(offsets) - 1
        self.different = np.zeros(rows, np.int64)
        if not len(data):
            return np.zeros((rows, self.dimensions), np.float32), np.zeros(rows, bool)
        keys, owner, seen = self._ngrams(data, offsets)
        known, place = np.unique(keys, return_inverse=True)
        self._learn(known)
        out = np.zeros((rows, self.dimensions), np.float32)
        if len(known):
            used = self.vectors[self.places[np.searchsorted(self.keys, known)]]
            # Dense counts for some texts at a time: as much as a few megabytes.
            step = max(1, (1 << 20) // len(known))
            bounds = np.searchsorted(owner, np.arange(0, rows + step, step))
            for k, (low, high) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)):
                if low < high:
                    n = min(step, rows - k * step)
                    cell = (owner[low:high] - k * step) * len(known) + place[low:high]
                    counts = np.bincount(cell, minlength=n * len(known)).reshape(n, -1)
                    out[k * step : k * step + n] = counts.astype(np.float32) @ used
                    self.different[k * step : k * step + n] = np.count_nonzero(counts, axis=1)
        norms = np.linalg.norm(out, axis=1, keepdims=True)
        return out / np.where(norms == 0, 1, norms), seen


def _drawn(labelled: DataFrame, rows: int | None) -> DataFrame:
    """``(text, lang)``, of languages with more than ``rows`` rows about so many, chosen by a hash of the text; without ``rows`` all."""
    given = labelled.select("text", "lang").where(F.col("text").isNotNull() & F.col("lang").isNotNull())
    if rows is None:
        return given
    sizes = given.groupBy("lang").count()
    share = F.least(F.lit(1.0), F.lit(float(rows)) / F.col("count"))
    drawn = F.pmod(F.xxhash64(F.lit(_SEED), "text"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    return given.join(F.broadcast(sizes), "lang").where(drawn < share).select("text", "lang")


def _fold(folds: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(_SEED + 1), "text"), F.lit(folds)).cast("int")


def _sums(labelled: DataFrame, dimensions: int, rows: int | None, folds: int) -> dict[tuple[int, str], np.ndarray]:
    """The sum of the vectors of each fold and language."""
    chosen = _drawn(labelled, rows).withColumn("fold", _fold(folds))

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        profiles, sums = Profiles(dimensions), {}
        for part in slices(batches):
            vectors, _ = profiles.of(*utf8(part["text"]))
            names, which = np.unique(part["lang"].to_numpy(zero_copy_only=False).astype(str), return_inverse=True)
            fold = part["fold"].to_numpy()
            for number in np.unique(fold).tolist():
                for k, name in enumerate(names):
                    mine = (which == k) & (fold == number)
                    if mine.any():
                        sums[number, name] = sums.get((number, name), 0) + vectors[mine].sum(axis=0, dtype=np.float64)
        for (number, name), total in sums.items():
            yield pa.RecordBatch.from_pydict(
                {
                    "fold": pa.array([number] * dimensions, pa.int32()),
                    "lang": [name] * dimensions,
                    "place": np.arange(dimensions, dtype=np.int32),
                    "value": total,
                }
            )

    parts = chosen.mapInArrow(summed, "fold int, lang string, place int, value double")
    cells = parts.groupBy("fold", "lang", "place").agg(F.sum("value").alias("value"))
    found = cells.groupBy("fold", "lang").agg(F.array_sort(F.collect_list(F.struct("place", "value"))).alias("cells"))
    return {(row["fold"], row["lang"]): np.array([cell["value"] for cell in row["cells"]]) for row in found.collect()}


def learn_prototypes(labelled: DataFrame, dimensions: int = DIMENSIONS, rows: int = LEARNED_ROWS) -> dict[str, list[float]]:
    """One vector per language from ``(text, lang)`` rows; null texts and labels are left out.

    Languages with more than ``rows`` rows are learned from about so many, chosen by a hash
    of the text: the bound of what a classifier is fitted on. What comes to the driver is
    one vector for each language.
    """
    return {name: vector.tolist() for (_, name), vector in _sums(labelled, dimensions, rows, 1).items()}


def identify_language(documents: DataFrame, prototypes: dict[str, list[float]], keep: list[str] | None = None, different: bool = False) -> DataFrame:
    """The ``keep`` columns with ``lang_pred`` and ``score``, the cosine cut off at 0.

    With ``different`` also ``n_different``, the number of different n-grams.
    """
    keep = ["doc_id"] if keep is None else keep
    names = sorted(prototypes)
    matrix = np.array([prototypes[name] for name in names], np.float64).reshape(len(names), -1) if names else np.zeros((0, DIMENSIONS))
    dimensions = matrix.shape[1] if names else DIMENSIONS
    if names:
        matrix /= np.maximum(np.linalg.norm(matrix, axis=1, keepdims=True), 1e-30)
        centre = matrix.mean(axis=0) if len(names) > 1 else np.zeros(dimensions)
        matrix -= centre
        matrix /= np.maximum(np.linalg.norm(matrix, axis=1, keepdims=True), 1e-30)
        matrix, centre = matrix.astype(np.float32), centre.astype(np.float32)

    more = ["n_different"] if different else []

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        profiles = Profiles(dimensions)
        for part in slices(batches):
            vectors, seen = profiles.of(*utf8(part["text"]))
            score, best = np.zeros(len(vectors)), np.zeros(len(vectors), int)
            if names:
                vectors = vectors - centre
                vectors /= np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-12)
                cosine = vectors @ matrix.T
                best = cosine.argmax(axis=1)
                score = np.clip(cosine[np.arange(len(best)), best].astype(float), 0, 1)
            given = seen & bool(names)
            guess = [names[k] if ok else UNKNOWN for k, ok in zip(best, given, strict=True)]
            columns = [part[name] for name in keep] + [pa.array(guess, pa.string()), pa.array(np.where(given, score, 0.0))]
            columns += [pa.array(profiles.different)] if different else []
            yield pa.RecordBatch.from_arrays(columns, names=[*keep, "lang_pred", "score", *more])

    kinds = [f"`{name}` {kind}" for name, kind in documents.select(*keep).dtypes]
    wanted = [*keep] if "text" in keep else [*keep, "text"]
    return documents.select(*wanted).mapInArrow(judge, ", ".join([*kinds, "lang_pred string", "score double", *(f"{name} long" for name in more)]))


def _length(different: Column) -> Column:
    """Texts of one class have up to twice as many different n-grams as others."""
    return F.floor(F.log2(F.greatest(different, F.lit(1)))).cast("int")


def calibrated_bounds(counts: dict[tuple[int, str], dict[int, int]]) -> list[float]:
    """The bound of each length class, from the scores (in bins) of the rows of each class and language.

    In a class every language counts on its own, so that none goes because it is rare, but those
    with few rows count together. The longest class stands for longer texts too.
    """
    bounds: list[float] = []
    for length in range(max((length for length, _ in counts), default=-1) + 1):
        pooled: dict[str, dict[int, int]] = {}
        for shorter in range(length, -1, -1):
            for (at, name), bins in counts.items():
                if at == shorter:
                    mine = pooled.setdefault(name, {})
                    for score, rows in bins.items():
                        mine[score] = mine.get(score, 0) + rows
            if sum(sum(bins.values()) for bins in pooled.values()) >= LEAST_ROWS:
                break
        else:
            bounds.append(0.0)
            continue
        rare: dict[int, int] = {}
        for name in [name for name, bins in pooled.items() if sum(bins.values()) < LEAST_ROWS]:
            for score, rows in pooled.pop(name).items():
                rare[score] = rare.get(score, 0) + rows
        lows = []
        for bins in [*pooled.values(), *([rare] if rare else [])]:
            left = sum(bins.values()) // RARE
            for score in sorted(bins):
                left -= bins[score]
                if left < 0:
                    lows.append(score / _BINS)
                    break
        bounds.append(MARGIN * min(lows))
    return bounds


def in_known_language(documents: DataFrame, labelled: DataFrame, keep: list[str]) -> DataFrame:
    """The ``keep`` columns of the rows in one of the languages of ``(text, lang)`` rows.

    Prototypes and bounds come from all labelled rows. What comes to the driver are a vector for each
    language and fold, and counts of scores for each language and length. Where labelled rows are too few to say how texts so short score,
    all but those like no language (score 0) stay.
    """
    sums = _sums(labelled, DIMENSIONS, None, FOLDS)

    def without(left_out: int | None) -> dict[str, list[float]]:
        total: dict[str, np.ndarray] = {}
        for (fold, name), vector in sorted(sums.items(), key=lambda item: item[0]):
            if fold != left_out:
                total[name] = total.get(name, 0) + vector
        return {name: vector.tolist() for name, vector in total.items()}

    chosen = _drawn(labelled, None)
    scored = [identify_language(chosen.where(_fold(FOLDS) == fold), without(fold), ["lang"], True) for fold in range(FOLDS)]
    binned = reduce(DataFrame.unionAll, scored).where(F.col("lang_pred") != UNKNOWN)
    binned = binned.groupBy(_length(F.col("n_different")).alias("length"), "lang", F.floor(F.col("score") * _BINS).cast("int").alias("bin")).count()
    counts: dict[tuple[int, str], dict[int, int]] = {}
    for row in binned.collect():
        counts.setdefault((row["length"], row["lang"]), {})[row["bin"]] = row["count"]
    bounds = calibrated_bounds(counts) or [0.0]
    bound = F.element_at(F.array(*map(F.lit, bounds)), F.least(_length(F.col("n_different")), F.lit(len(bounds) - 1)) + 1)
    found = identify_language(documents, without(None), keep, True)
    return found.where((F.col("lang_pred") != UNKNOWN) & (F.col("score") > bound)).select(*keep)
