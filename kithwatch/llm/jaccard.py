"""Similarity join of documents on the Jaccard coefficient of their word n-grams.

1. Each document becomes a sorted array of distinct n-gram hashes, rare n-grams first. How rare
   one is comes from the counts of its words over all documents (65,536 classes of word hashes);
   n-grams that are frequent by themselves (a summary of the most frequent ones is kept by each
   task and added up) come after all others, by their own counts. Any common order gives the same
   links; a good one keeps out of the tiles what documents share by chance, and passages that
   many of them share. There are far fewer words than n-grams, so counts of their classes tell
   rare from common at any size of the corpus.
2. Documents with equal sets are one class; only one of them is compared.
3. *Size-banded tiles*: two sets that are alike enough share an n-gram among their first
   ``n - ceil(t n) + 1``. A tile is such an n-gram together with a band of sizes; a band
   doubles in size, and a set is in its own band and in all those up to the largest size it can
   link to, so two sets of fitting sizes always meet in the band of the larger one. Of tiles with
   the same members one is kept.
4. *Bitmap signatures*: a set sets or clears bits of a map that has two to four bits for each of
   its n-grams (1,024 bits at least, 65,536 at most; a wider map folds to a narrower one). As many
   bits as differ at least, elements differ, which bounds the overlap from above.
5. What the bound lets through is compared exactly, by merging the two sorted arrays.

A tile of n documents is not turned into its n^2 pairs. First everyone is compared with the
smallest and the largest row of the tile; components are drawn from the links found. Then
tiles that hold several components are compared in blocks, bitmap by bitmap, and only pairs
of different components that the bound allows become rows; small tiles at once, larger ones after more rounds of
single partners where there are many to compare. A link between two components is thus never missed, one inside a
component need not be found. :func:`jaccard_links` finds all of them.

Defined results: null texts and texts without words have the empty set and link to nothing;
a text with fewer words than an n-gram is one n-gram. Rows with the same ``doc_id`` are one
node, also with different texts. A null ``doc_id`` never names a component. Only ``doc_id`` (of
any type that can be ordered) and ``text`` are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from kithwatch.llm.arrays import SPACES, chained, lists, mixed, runs, slices, utf8, words
from kithwatch.operators.components import component_roots
from kithwatch.operators.scratch import Scratch

CLASSES = 1 << 16
#: Frequent n-grams that are told apart by a task's summary, and in the whole.
FREQUENT = 1 << 16
#: Hashes that a task gathers before they are added to its summary.
GATHERED = 1 << 20
#: Words of 64 bits that a bitmap has at least and at most.
LANES, MOST_LANES = 16, 1024
#: Ids that may be broadcast: a few megabytes.
BROADCAST_IDS = 500_000
_UP = np.uint64(48)


@dataclass
class Rarity:
    """Logarithm of the count of each class of words, and the frequent n-grams (sorted) with their ranks."""

    words: np.ndarray
    frequent: np.ndarray
    ranks: np.ndarray

    def of(self, words: np.ndarray, grams: np.ndarray, whole: np.ndarray, size: int) -> np.ndarray:
        """Ranks of n-grams, which begin at the ``words`` marked as ``whole``; the rarest is lowest."""
        each = self.words[(words >> _UP).astype(np.int64)]
        score = sum(each[step : step + len(whole)] for step in range(size))[whole] if len(whole) else np.zeros(0)
        # A logarithm is below 64, so a score fills 16 bits.
        rank = (score * (CLASSES / (64 * size))).astype(np.int64)
        if len(self.frequent):
            at = np.minimum(np.searchsorted(self.frequent, grams), len(self.frequent) - 1)
            hit = self.frequent[at] == grams
            rank[hit] = CLASSES + self.ranks[at[hit]]
        return rank


def _grams(data: np.ndarray, offsets: np.ndarray, size: int, rarity: Rarity | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, text and rank of every n-gram; a text with fewer words is one n-gram."""
    found = words(data, offsets, SPACES)
    text = found.text
    whole = chained(found.hash, size)
    same = text[: len(whole)] == text[size - 1 :] if len(whole) else np.zeros(0, bool)
    hashes, owner = whole[same], text[: len(whole)][same]
    ranks = np.zeros(len(hashes), np.int64) if rarity is None else rarity.of(found.hash, hashes, same, size)
    count = np.diff(found.first)
    for few in range(1, size):
        rows = np.flatnonzero(count == few)
        if len(rows):
            short = np.zeros(len(rows), np.uint64)
            for step in range(few):
                short = mixed(short + found.hash[found.first[rows] + step])
            hashes, owner = np.concatenate([hashes, short]), np.concatenate([owner, rows])
            ranks = np.concatenate([ranks, np.zeros(len(rows), np.int64)])
    return hashes, owner, ranks


@dataclass
class Sets:
    """Distinct n-grams of texts, one text after another: hashes in order, and how many each has."""

    hashes: np.ndarray
    count: np.ndarray

    def names(self) -> np.ndarray:
        """128 bits for each set that do not depend on the order of its n-grams."""
        names = np.zeros((2, len(self.count)), np.uint64)
        full = np.flatnonzero(self.count)
        if len(full):
            first = (np.cumsum(self.count) - self.count)[full]
            drawn = mixed(self.hashes)
            names[0, full] = np.add.reduceat(drawn, first)
            names[1, full] = np.add.reduceat(mixed(drawn), first)
        return names.view(np.int64)


def _sets(data: np.ndarray, offsets: np.ndarray, size: int, rarity: Rarity | None = None) -> Sets:
    """The set of every text, sorted by rarity if there is one, and by hash."""
    hashes, owner, ranks = _grams(data, offsets, size, rarity)
    group = owner * (2 * CLASSES) + ranks
    order = np.lexsort((hashes, group))
    hashes, group, owner = hashes[order], group[order], owner[order]
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (group[1:] != group[:-1])
    return Sets(hashes[new], np.bincount(owner[new], minlength=len(offsets) - 1))


def _summed(keys: np.ndarray, counts: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Counts by key; of more than ``most`` keys the largest, less the first count that is left out.

    So a key with more than a ``most``-th of all is never lost, and memory is bounded.
    """
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
    keys, counts = keys[first], np.add.reduceat(counts, first) if len(first) else counts
    if len(keys) > most:
        counts = counts - np.partition(counts, len(counts) - most - 1)[len(counts) - most - 1]
        keys, counts = keys[counts > 0], counts[counts > 0]
    return keys, counts


def rarity_of(documents: DataFrame, size: int, scratch: Scratch) -> Rarity:
    """How often words, and n-grams that are frequent by themselves, are in all documents."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(CLASSES, np.int64)
        keys, counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        held, waiting = [], 0
        for part in slices(batches):
            data, offsets = utf8(part["text"])
            hashes = _sets(data, offsets, size).hashes
            total += np.bincount((words(data, offsets, SPACES).hash >> _UP).astype(np.int64), minlength=CLASSES)
            held.append(hashes)
            waiting += len(hashes)
            if waiting >= GATHERED:
                keys, counts = _summed(np.concatenate([keys, *held]), np.concatenate([counts, np.ones(waiting, np.int64)]), FREQUENT)
                held, waiting = [], 0
        keys, counts = _summed(np.concatenate([keys, *held]), np.concatenate([counts, np.ones(waiting, np.int64)]), FREQUENT)
        # What a task saw once is not frequent.
        keys, counts = keys[counts > 1], counts[counts > 1]
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict(
            {
                "single": np.repeat([False, True], [len(used), len(keys)]),
                "key": np.concatenate([used, keys.view(np.int64)]).astype(np.int64),
                "n": np.concatenate([total[used], counts]),
            }
        )

    parts = documents.select("text").mapInArrow(counted, "single boolean, key long, n long")
    sums = scratch.save(parts.groupBy("single", "key").agg(F.sum("n").alias("n")), "rarity")
    classes = np.zeros(CLASSES, np.int64)
    for row in sums.where("not single").collect():
        classes[row["key"]] = row["n"]
    top = sums.where("single").orderBy(F.desc("n"), "key").limit(FREQUENT).collect()
    scratch.drop("rarity")
    frequent = np.array([row["key"] for row in top], np.int64).view(np.uint64)
    ranks = np.arange(len(frequent) - 1, -1, -1)
    order = np.argsort(frequent)
    return Rarity(np.log2(classes + 1), frequent[order], ranks[order])


def _bitmaps(sets: Sets) -> tuple[np.ndarray, np.ndarray]:
    """Bitmaps of all sets, one after another, and how many words of 64 bits each has."""
    lanes = np.clip(1 << np.maximum(np.frexp(np.maximum(sets.count, 1))[1].astype(np.int64) + 1 - 6, 0), LANES, MOST_LANES)
    first = np.cumsum(lanes) - lanes
    owner = np.repeat(np.arange(len(lanes)), sets.count)
    bit = (mixed(sets.hashes) & (lanes[owner] * 64 - 1).astype(np.uint64)).astype(np.int64)
    odd = np.bincount(first[owner] * 64 + bit, minlength=int(lanes.sum()) * 64) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.uint64), lanes


def _folded(bits: pa.ListArray, lanes: int) -> np.ndarray:
    """Bitmaps as rows of ``lanes`` words; wider ones are folded, bit upon bit."""
    width = pc.list_value_length(bits).to_numpy(zero_copy_only=False)
    flat = bits.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
    first = np.cumsum(width) - width
    out = np.zeros((len(width), lanes), np.uint64)
    for wide in np.unique(width).tolist():
        rows = np.flatnonzero(width == wide)
        words = flat[(first[rows, None] + np.arange(wide)).reshape(-1)]
        out[rows] = np.bitwise_xor.reduce(words.reshape(len(rows), wide // lanes, lanes), axis=1)
    return out


def _few_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same rows at most 1,024 at a time: with the widest bitmaps on both sides 16 MB."""
    for batch in batches:
        for first in range(0, batch.num_rows, BLOCK):
            yield batch.slice(first, BLOCK)


def _may_link(differing: np.ndarray, one: np.ndarray, other: np.ndarray, least: int, of: int) -> np.ndarray:
    """Whether sets of these sizes, with as many differing bits, can be a link."""
    both = one + other
    return (np.minimum(one, other) * of >= np.maximum(one, other) * least) & ((both - differing) // 2 * (of + least) >= both * least)


def gram_sets(documents: DataFrame, size: int, least: int, of: int, rarity: Rarity) -> DataFrame:
    """``(doc_id, n, k1, k2, tiles, bits)``: size, 128-bit name, tiles and bitmap of each set."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            sets = _sets(*utf8(part["text"]), size, rarity)
            count, rows = sets.count, part.num_rows
            first = np.cumsum(count) - count
            names = sets.names()
            bits, lanes = _bitmaps(sets)
            # The rarest n-grams, each in the band of its size and in those up to the largest partner's.
            ahead = np.where(count > 0, count - -(-count * least // of) + 1, 0)
            band = np.frexp(np.maximum(count, 1))[1].astype(np.int64)
            last = np.frexp(np.maximum(count * of // least, 1))[1].astype(np.int64)
            copies = ahead * (last - band + 1)
            nth = runs(copies)
            row = np.repeat(np.arange(rows), copies)
            step = np.maximum(ahead[row], 1)
            tile = mixed(sets.hashes[first[row] + nth % step] + mixed((band[row] + nth // step).astype(np.uint64)))
            yield pa.RecordBatch.from_pydict(
                {
                    "doc_id": part["doc_id"],
                    "n": pa.array(count, pa.int64()),
                    "k1": names[0],
                    "k2": names[1],
                    "tiles": lists(tile.view(np.int64), copies, pa.int64()),
                    "bits": lists(bits.view(np.int64), lanes, pa.int64()),
                }
            )

    kind = documents.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n long, k1 long, k2 long, tiles array<long>, bits array<long>"
    return documents.select("doc_id", "text").mapInArrow(made, schema)


NAME = ["k1", "k2", "n"]


@dataclass
class _Classes:
    """Documents whose sets are equal, as one row each.

    ``rows`` has ``(doc_id, n, k1, k2)`` of every document, ``classes`` ``(rep, doc_id, k1, k2, n)``
    with the smallest ``doc_id``, ``traits`` the bitmap and ``members`` the tiles of classes that
    share one, ``bridges`` the classes that rows of one ``doc_id`` tie together.
    """

    rows: DataFrame
    classes: DataFrame
    traits: DataFrame
    members: DataFrame
    bridges: DataFrame
    placed: int
    repeated: bool


def _filed(scratch: Scratch, documents: DataFrame, size: int, least: int, of: int) -> _Classes:
    rarity = rarity_of(documents, size, scratch)
    # Numbered where it is written, and only read from there.
    sets = scratch.save(gram_sets(documents, size, least, of, rarity).withColumn("row", F.monotonically_increasing_id()), "sets")
    named = sets.where("n > 0 and doc_id is not null")
    classes = scratch.save(named.groupBy(*NAME).agg(F.min("row").alias("rep"), F.min("doc_id").alias("doc_id")), "classes")
    chosen = sets.join(classes.select(F.col("rep").alias("row")), "row", "left_semi")
    chosen = scratch.save(chosen.select(F.col("row").alias("rep"), "n", "tiles", "bits"), "chosen")
    rows = scratch.save(sets.select("doc_id", *NAME), "rows")
    scratch.drop("sets")
    seen = Observation()
    ids = rows.where("n > 0 and doc_id is not null").groupBy("doc_id")
    ids = ids.agg(F.count(F.lit(1)).alias("copies"), *(f(name).alias(f"{f.__name__}_{name}") for f in (F.min, F.max) for name in NAME))
    differing = ids.observe(seen, F.max("copies").alias("most")).where("min_k1 != max_k1 or min_k2 != max_k2 or min_n != max_n")
    tied = scratch.save(differing.select("doc_id"), "tied")
    tied = rows.join(tied, "doc_id", "left_semi").join(classes.select("rep", *NAME), NAME).select("doc_id", "rep").distinct()
    firsts = tied.groupBy("doc_id").agg(F.min("rep").alias("a"))
    bridges = scratch.save(tied.join(firsts, "doc_id").where("a != rep").select("a", F.col("rep").alias("b")), "bridges")
    tiles = chosen.select("rep", F.explode("tiles").alias("tile"))
    ends = tiles.groupBy("tile").agg(F.count(F.lit(1)).alias("size"), F.min("rep").alias("low"), F.max("rep").alias("high")).where("size > 1")
    shared = scratch.save(tiles.join(ends, "tile"), "shared")
    # Tiles with the same members are one.
    prints = shared.groupBy("tile").agg(F.first("size").alias("size"), F.bit_xor(F.xxhash64("rep")).alias("x"), F.bit_xor(F.xxhash64(F.lit(1), "rep")).alias("y"))
    kept = prints.groupBy("size", "x", "y").agg(F.min("tile").alias("tile")).select("tile")
    members = scratch.save(shared.join(kept, "tile", "left_semi"), "members")
    scratch.drop("shared")
    traits = scratch.save(chosen.select("rep", "n", "bits").join(members.select("rep").distinct(), "rep", "left_semi"), "traits")
    scratch.drop("chosen")
    return _Classes(rows, classes, traits, members, bridges, members.count(), (seen.get["most"] or 0) > 1)


class _Links:
    """Compares pairs and keeps what has been found so far."""

    def __init__(self, scratch: Scratch, documents: DataFrame, filed: _Classes, size: int, least: int, of: int):
        self.scratch, self.documents, self.filed, self.size, self.least, self.of = scratch, documents, filed, size, least, of
        self.traits = filed.traits
        self.tested: DataFrame | None = None
        self.links = filed.bridges
        self.rounds = self.drawn = 0

    def _possible(self, pairs: DataFrame) -> DataFrame:
        """Pairs whose sizes and bitmaps allow a link."""
        least, of = self.least, self.of
        one = self.traits.select(F.col("rep").alias("a"), F.col("n").alias("na"), F.col("bits").alias("xa"))
        two = self.traits.select(F.col("rep").alias("b"), F.col("n").alias("nb"), F.col("bits").alias("xb"))

        def allowed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in _few_rows(batches):
                narrow = np.minimum(*(pc.list_value_length(batch[name]).to_numpy(zero_copy_only=False) for name in ("xa", "xb")))
                for lanes in np.unique(narrow).tolist():
                    part = batch.filter(pa.array(narrow == lanes))
                    differing = np.bitwise_count(_folded(part["xa"], lanes) ^ _folded(part["xb"], lanes)).sum(axis=1, dtype=np.int64)
                    good = pa.array(_may_link(differing, part["na"].to_numpy(), part["nb"].to_numpy(), least, of))
                    yield pa.RecordBatch.from_arrays([part["a"].filter(good), part["b"].filter(good)], names=["a", "b"])

        sized = F.least("na", "nb") * of >= F.greatest("na", "nb") * least
        joined = pairs.join(one, "a").join(two, "b").where(sized)
        return joined.select("a", "b", "na", "nb", "xa", "xb").mapInArrow(allowed, "a long, b long")

    def _texts(self, reps: DataFrame) -> DataFrame:
        """``(rep, text)``: a text of each class, taken from a row with its id and its set."""
        size = self.size
        wanted = reps.join(self.filed.classes, "rep").select("rep", "doc_id", *(F.col(name).alias(f"of_{name}") for name in NAME))
        wanted = self.scratch.save(wanted, "wanted")
        # Few ids go to where the texts are read; more are joined by a shuffle.
        if wanted.count() <= BROADCAST_IDS:
            wanted = F.broadcast(wanted)

        def same(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part in slices(batches):
                sets = _sets(*utf8(part["text"]), size)
                k1, k2 = sets.names()
                good = (k1 == part["of_k1"].to_numpy()) & (k2 == part["of_k2"].to_numpy()) & (sets.count == part["of_n"].to_numpy())
                yield part.select(["rep", "text"]).filter(pa.array(good))

        texts = self.documents.select("doc_id", "text").join(wanted, "doc_id")
        if self.filed.repeated:
            # Rows with one id: only those with the class's set, and of equal ones the first.
            texts = texts.select("rep", "of_k1", "of_k2", "of_n", "text").mapInArrow(same, "rep long, text string").dropDuplicates(["rep"])
        return self.scratch.save(texts.select("rep", "text"), "texts")

    def _exact(self, pairs: DataFrame) -> DataFrame:
        """Pairs that are links, by merging their sorted arrays."""
        size, least, of = self.size, self.least, self.of
        texts = self._texts(pairs.select(F.explode(F.array("a", "b")).alias("rep")).distinct())
        # The end that more pairs share comes last, so that its text travels least.
        sided = pairs.join(texts.select(F.col("rep").alias("b"), F.col("text").alias("text_b")), "b")
        sided = sided.join(texts.select(F.col("rep").alias("a"), "text"), "a")

        def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part in slices(batches, limit=1 << 20):
                one, two = _sets(*utf8(part["text"]), size), _sets(*utf8(part["text_b"]), size)
                owner = np.concatenate([np.repeat(np.arange(part.num_rows), one.count), np.repeat(np.arange(part.num_rows), two.count)])
                both = np.concatenate([one.hashes, two.hashes])
                order = np.lexsort((both, owner))
                both, owner = both[order], owner[order]
                shared = owner[1:][(both[1:] == both[:-1]) & (owner[1:] == owner[:-1])]
                overlap = np.bincount(shared, minlength=part.num_rows)
                good = pa.array((overlap * of >= (one.count + two.count - overlap) * least) & (one.count > 0))
                yield pa.RecordBatch.from_arrays([part["a"].filter(good), part["b"].filter(good)], names=["a", "b"])

        return sided.select("a", "b", "text", "text_b").mapInArrow(linked, "a long, b long")

    def test(self, pairs: DataFrame) -> None:
        """Compare new pairs."""
        pairs = pairs.where("a < b").distinct()
        if self.tested is not None:
            pairs = pairs.join(self.tested, ["a", "b"], "left_anti")
        self.rounds += 1
        pairs = self.scratch.save(pairs, f"pairs-{self.rounds}")
        self.tested = pairs if self.tested is None else self.tested.union(pairs)
        possible = self.scratch.save(self._possible(pairs), "possible")
        if not possible.isEmpty():
            self.links = self.links.union(self.scratch.save(self._exact(possible), f"links-{self.rounds}"))
            self.scratch.drop("wanted")
            self.scratch.drop("texts")
        self.scratch.drop("possible")

    def components(self) -> DataFrame | None:
        """``(rep, component)`` of all linked classes, written out.

        One link of each class to its component then stands for all links so far: dense groups have
        far more, and none is looked at again.
        """
        if self.links.isEmpty():
            return None
        self.drawn += 1
        edges = self.links.select(F.col("a").alias("src"), F.col("b").alias("dst"))
        with Scratch(self.scratch.spark, "linked"):
            # Classes are numbers already, and the first of a link is the smaller one.
            tied = self.scratch.save(component_roots(edges).toDF("rep", "component"), f"tied-{self.drawn}")
        self.links = tied.select(F.col("component").alias("a"), F.col("rep").alias("b"))
        return self.scratch.save(tied.union(tied.select("component", "component").distinct()), f"components-{self.drawn}")


#: Comparisons for each row of the tiles beyond which another round of single partners comes first.
PATIENCE = 4
#: Members up to which a tile is compared whole at once: fewer than half as many comparisons a row.
WHOLE = 64
#: Members of a tile that one task compares with as many others.
BLOCK = 1024
#: Words of 64 bits that are compared at a time.
COMPARED = 1 << 20


def _tile_pairs(placed: DataFrame, traits: DataFrame, least: int, of: int) -> DataFrame:
    """Pairs in the same tile, but in different components, that sizes and bitmaps allow.

    ``placed`` has ``(tile, size, rep, component)``. A large tile is cut into blocks by a hash,
    and a task gets two of them at a time, so no task holds more than two blocks.
    """
    blocks = F.ceil(F.col("size") / BLOCK).cast("int")
    own = F.pmod(F.xxhash64("rep"), blocks).cast("int")
    rows = placed.join(traits, "rep").withColumns({"own": own, "other": F.explode(F.sequence(F.lit(0), blocks - 1))})
    rows = rows.select("tile", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), (F.col("own") <= F.col("other")).alias("left"), "rep", "component", "n", "bits")
    parts = max(1, int(placed.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = rows.repartition(parts, "tile", "i", "j").sortWithinPartitions("tile", "i", "j", "rep")

    def compared(group: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        rep, component, n = (group[name].to_numpy() for name in ("rep", "component", "n"))
        bits = group["bits"].combine_chunks()
        lanes = int(pc.min(pc.list_value_length(bits)).as_py())
        bits = _folded(bits, lanes)
        left = group["left"].to_numpy()
        same = group["i"][0].as_py() == group["j"][0].as_py()
        rows = np.arange(len(left)) if same else np.flatnonzero(left)
        others = rows if same else np.flatnonzero(~left)
        a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        step = max(1, COMPARED // max(1, len(others) * lanes))
        for low in range(0, len(rows), step):
            some = rows[low : low + step]
            differing = np.bitwise_count(bits[some][:, None, :] ^ bits[others][None, :, :]).sum(axis=2, dtype=np.int64)
            good = _may_link(differing, n[some][:, None], n[others][None, :], least, of)
            good &= component[some][:, None] != component[others][None, :]
            x, y = np.nonzero(good)
            a.append(rep[some[x]])
            b.append(rep[others[y]])
        a, b = np.concatenate(a), np.concatenate(b)
        return np.minimum(a, b), np.maximum(a, b)

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in _with_end(batches):
            table = None if batch is None else pa.Table.from_batches([batch])
            if held is not None and table is not None:
                table = pa.concat_tables([held, table])
            elif table is None:
                table = held
            if table is None or not table.num_rows:
                continue
            keys = np.stack([table[name].to_numpy() for name in ("tile", "i", "j")], axis=1)
            ends = np.append(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1, table.num_rows)
            if batch is not None:
                ends = ends[:-1]
            found, begin = [], 0
            for end in ends.tolist():
                if end - begin > 1:
                    found.append(compared(table.slice(begin, end - begin)))
                begin = end
            held = table.slice(begin) if batch is not None else None
            if found:
                a, b = np.unique(np.stack([np.concatenate(side) for side in zip(*found, strict=True)]), axis=1)
                yield pa.RecordBatch.from_pydict({"a": a, "b": b})

    return dealt.mapInArrow(made, "a long, b long").distinct()


def _with_end(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch | None]:
    yield from batches
    yield None


def _open(links: _Links, members: DataFrame, found: DataFrame | None, name: str) -> DataFrame:
    """``(tile, size, rep, component)`` of the tiles that hold several components."""
    placed = members if found is None else members.join(found, "rep", "left")
    label = F.col("rep") if found is None else F.coalesce("component", "rep")
    # Written, so that rows are given their component once.
    placed = links.scratch.save(placed.select("tile", "size", "rep", label.alias("component")), f"{name}-placed")
    several = placed.groupBy("tile").agg(F.min("component").alias("one"), F.max("component").alias("other")).where("one != other")
    opened = links.scratch.save(placed.join(several.select("tile"), "tile", "left_semi"), name)
    links.scratch.drop(f"{name}-placed")
    return opened


def _partners(placed: DataFrame, turn: int) -> DataFrame:
    """Each row with one other of its tile, drawn by a hash."""
    chosen = placed.groupBy("tile").agg(F.min_by("rep", F.xxhash64("rep", F.lit(turn))).alias("partner"))
    single = placed.join(chosen, "tile")
    return single.select(F.least("rep", "partner").alias("a"), F.greatest("rep", "partner").alias("b"))


def _settle(links: _Links, members: DataFrame, rows: int) -> DataFrame | None:
    """Compare everything in the tiles that is not in one component yet.

    Small tiles are compared whole at once, and are done with: most of them hold sets that meet by
    chance, which no round would bring together. Rounds are for the others, and each reads
    only the tiles that the one before left open.
    """
    # A tile of three has no pair that has not been compared with one of its ends.
    left = _open(links, members.where("size > 3"), links.components(), "open-0")
    small = _tile_pairs(left.where(F.col("size") <= WHOLE), links.traits, links.least, links.of)
    left = left.where(F.col("size") > WHOLE)
    links.test(small.union(_partners(left, 0)))
    before, turn = None, 0
    while True:
        found = links.components()
        turn += 1
        placed = _open(links, left.select("tile", "size", "rep"), found, f"open-{turn}")
        links.scratch.drop(f"open-{turn - 1}")
        groups = placed.groupBy("tile", "component", "size").agg(F.count(F.lit(1)).alias("n"))
        # Pairs of members in different components.
        work = groups.agg(F.sum(F.col("n") * (F.col("size") - F.col("n"))).alias("pairs")).first()["pairs"] or 0
        if not work:
            return found
        if work <= PATIENCE * rows or (before is not None and work > 0.8 * before):
            links.test(_tile_pairs(placed, links.traits, links.least, links.of))
            return links.components()
        before, left = work, placed
        links.test(_partners(placed, turn))


def jaccard_components(documents: DataFrame, size: int = 5, least: int = 80, of: int = 100) -> DataFrame:
    """``(doc_id, n_shingles, component_id)``, linked where ``of * overlap >= least * union``.

    ``component_id`` is the smallest ``doc_id`` that links lead to, the document's own included.
    """
    spark = documents.sparkSession
    scratch, result = Scratch(spark, "jaccard"), Scratch(spark, "jaccard-classes")
    with scratch:
        filed = _filed(scratch, documents, size, least, of)
        links = _Links(scratch, documents, filed, size, least, of)
        if filed.placed:
            pairs = filed.members.select("rep", F.explode(F.array("low", "high")).alias("end"))
            links.test(pairs.select(F.least("rep", "end").alias("a"), F.greatest("rep", "end").alias("b")))
            found = _settle(links, filed.members.select("tile", "size", "rep"), filed.placed)
        else:
            found = links.components()
        classes = filed.classes.select(*NAME, "rep", "doc_id")
        if found is not None:
            # A component is named after the smallest id of all its classes.
            joined = found.join(classes, "rep")
            names = joined.groupBy("component").agg(F.min("doc_id").alias("name"))
            named = joined.join(names, "component").select("rep", "name")
            classes = classes.join(named, "rep", "left").select(*NAME, F.coalesce("name", "doc_id").alias("component"))
        else:
            classes = classes.select(*NAME, F.col("doc_id").alias("component"))
        # A null id is no node of its own: its set's component, if any, is still its component.
        placed = filed.rows.join(classes, NAME, "left")
        return result.save(placed.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id")), "rows")


def jaccard_links(documents: DataFrame, size: int = 5, least: int = 80, of: int = 100) -> tuple[DataFrame, DataFrame]:
    """All links between different sets, ``(a, b)``, and the membership ``(doc_id, rep)``.

    ``a`` and ``b`` are representatives of the classes of equal sets. There are as many rows as
    there are links, so a group of n near copies costs n^2; copies cost nothing.
    """
    scratch, result = Scratch(documents.sparkSession, "jaccard"), Scratch(documents.sparkSession, "jaccard-links")
    with scratch:
        filed = _filed(scratch, documents, size, least, of)
        links = _Links(scratch, documents, filed, size, least, of)
        links.links = links.links.limit(0)
        if filed.placed:
            placed = filed.members.select("tile", "size", "rep", F.col("rep").alias("component"))
            links.test(_tile_pairs(placed, links.traits, least, of))
        found = result.save(links.links.distinct(), "links")
        rows = filed.rows.where("n > 0").join(filed.classes.select("rep", *NAME), NAME)
        return found, result.save(rows.select("doc_id", "rep"), "membership")
