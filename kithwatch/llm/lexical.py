"""Ranked lexical search by the best position algorithm over impact-sorted lists.

Akbarinia, Pacitti, Valduriez: "Best Position Algorithms for Top-k Queries" (2007). Documents are
indexed in shards (one row each, a few megabytes of text): for every term the documents that
hold it and how often. A search turns these lists into impacts, which need the lengths and
counts of the whole table, sorts each list by falling impact and for each query

1. reads the lists of its terms in step, some positions of each at a time;
2. looks up every new document in all lists (*direct access*), which gives its score, and marks
   its position in each of them as seen, whether it was read there or not;
3. follows in each list the *best position*, up to which all positions are seen. A document not
   seen yet lies behind it in every list, so it scores at most the weighted sum of the impacts
   that come next. That is never above the bound from the last positions read;
4. stops when this bound is strictly below the k-th best score, so that a document that ties
   with the k-th is always found. The k-th best of a task's earlier shards counts as well.

Shards are searched where they are read. Each task hands on its best k of a query, which are
merged in two steps, so the rows of a query never meet in one task before they are few.
Queries are taken in blocks of about ``BLOCK_TERMS`` terms, which are what tasks are sent. The
index holds the terms of the queries only, or all terms where those are more than
``SENT_TERMS``. Memory: a shard, its lists, and ``CELLS`` impacts laid out for direct access;
a query with very many terms sees a shard in several parts. Long texts make one shard each.

Terms are told apart by 64-bit hashes. Defined results: a null text has no terms, nor has a
text of separators only; neither counts as a document or is found. Rows with equal ids are
documents of their own, and equal queries queries of their own; null ids come last among equal
scores. Empty tables give no rows. Columns other than id and text are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kithwatch.llm.arrays import NOT_WORD, lists, slices, utf8, words
from kithwatch.operators.scratch import Scratch
from kithwatch.operators.skew import lookup

#: Postings (and bytes of text) after which a shard is closed.
SHARD_POSTINGS, SHARD_BYTES = 1 << 20, 1 << 25
#: Terms of the queries of a block, and distinct terms of all queries, that are sent to tasks at once.
BLOCK_TERMS, SENT_TERMS = 1_000_000, 4_000_000
#: Impacts laid out at once for direct access.
CELLS = 1 << 22
#: Groups of tasks whose findings are merged first.
MERGERS = 256
#: Positions read from each list at first; every later step reads twice as many.
STEP = 64


def _terms(part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text and hash of every term of a slice, and the number of terms of each text."""
    found = words(*utf8(part["text"]), NOT_WORD)
    return found.text, found.hash.view(np.int64), np.diff(found.first)


def _counted(owner: np.ndarray, term: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (owner, term) in this order, with their number."""
    order = np.lexsort((term, owner))
    owner, term = owner[order], term[order]
    first = np.flatnonzero(np.concatenate([[True], (owner[1:] != owner[:-1]) | (term[1:] != term[:-1])])[: len(owner)])
    return owner[first], term[first], np.diff(first, append=len(owner))


def query_terms(queries: DataFrame) -> DataFrame:
    """``(item_id, terms, times)``: distinct terms of each query and how often it has them."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            owner, term, times = _counted(*_terms(part)[:2])
            sizes = np.bincount(owner, minlength=part.num_rows)
            yield pa.RecordBatch.from_pydict({"item_id": part["item_id"], "terms": lists(term, sizes, pa.int64()), "times": lists(times, sizes, pa.int64())})

    kind = dict(queries.dtypes)["item_id"]
    return queries.select("item_id", "text").mapInArrow(read, f"item_id {kind}, terms array<bigint>, times array<bigint>")


def index_terms(documents: DataFrame, wanted: np.ndarray | None = None, shard_postings: int = SHARD_POSTINGS) -> DataFrame:
    """Shards of an inverted index over ``(doc_id, text)``, a row each.

    ``doc_ids`` and ``sizes`` (terms of each) are the documents with postings. ``terms`` are the
    terms of the shard, ``df`` the number of documents of each, and ``docs`` (places in
    ``doc_ids``) and ``tf`` the postings by term and document. ``n_docs`` and ``n_terms`` count
    all documents with a term and their terms. ``wanted`` (sorted hashes) limits the postings.
    """

    def shard(held: list[tuple], kept: list[pa.Array], docs: int, total: int) -> pa.RecordBatch:
        owner, term, tf, sizes = (np.concatenate(column) for column in zip(*held, strict=True))
        order = np.lexsort((owner, term))
        owner, term, tf = owner[order], term[order], tf[order]
        first = np.flatnonzero(np.concatenate([[True], term[1:] != term[:-1]])[: len(term)])
        whole = lambda values, kind: lists(values, np.array([len(values)]), kind)
        ids = pa.concat_arrays(kept)
        return pa.RecordBatch.from_pydict(
            {
                "n_docs": pa.array([docs], pa.int64()),
                "n_terms": pa.array([total], pa.int64()),
                "doc_ids": pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids),
                "sizes": whole(sizes, pa.int64()),
                "terms": whole(term[first], pa.int64()),
                "df": whole(np.diff(first, append=len(term)), pa.int32()),
                "docs": whole(owner, pa.int32()),
                "tf": whole(tf, pa.int32()),
            }
        )

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, kept, docs, total, known, postings, size = [], [], 0, 0, 0, 0, 0
        for part in slices(batches):
            owner, term, counts = _terms(part)
            docs, total = docs + int((counts > 0).sum()), total + int(counts.sum())
            if wanted is not None:
                there = wanted[np.minimum(np.searchsorted(wanted, term), len(wanted) - 1)] == term if len(wanted) else np.zeros(len(term), bool)
                owner, term = owner[there], term[there]
            owner, term, tf = _counted(owner, term)
            used, place = np.unique(owner, return_inverse=True)
            held.append((place + known, term, tf, counts[used]))
            kept.append(part["doc_id"].take(pa.array(used)))
            known, postings, size = known + len(used), postings + len(term), size + part["text"].nbytes
            if postings >= shard_postings or size >= SHARD_BYTES:
                yield shard(held, kept, docs, total)
                held, kept, docs, total, known, postings, size = [], [], 0, 0, 0, 0, 0
        if held:
            yield shard(held, kept, docs, total)

    kind = dict(documents.dtypes)["doc_id"]
    return documents.select("doc_id", "text").mapInArrow(
        build,
        f"n_docs long, n_terms long, doc_ids array<{kind}>, sizes array<bigint>, terms array<bigint>, df array<int>, docs array<int>, tf array<int>",
    )


@dataclass
class Lists:
    """The lists of a query over the documents of a shard, all by falling impact."""

    weights: np.ndarray
    docs: list[np.ndarray]
    impacts: list[np.ndarray]

    def best(self, documents: int, floor: int, k: int) -> tuple[np.ndarray, np.ndarray, int]:
        """Documents, their scores, and positions read; none is missed that scores ``floor`` or is among the best ``k``."""
        direct = np.zeros((len(self.docs), documents))
        for row, (docs, impacts) in enumerate(zip(self.docs, self.impacts, strict=True)):
            direct[row, docs] = impacts
        # All products are whole and far below 2^53, where doubles are exact.
        weights = self.weights.astype(np.float64)
        sizes = np.array([len(docs) for docs in self.docs])
        seen, best = np.zeros(documents, bool), np.zeros(len(self.docs), np.int64)
        found, scores, kth = [], [], floor
        depth, step, read = 0, STEP, 0
        while True:
            ahead = [docs[depth : depth + step] for docs, size in zip(self.docs, sizes, strict=True) if size > depth]
            if not ahead:
                break
            near = np.concatenate(ahead)
            read += len(near)
            fresh = np.unique(near[~seen[near]])
            if len(fresh):
                seen[fresh] = True
                reached = (weights @ direct[:, fresh]).astype(np.int64)
                good = reached >= kth
                found.append(fresh[good])
                scores.append(reached[good])
                have = np.concatenate(scores)
                if len(have) >= k:
                    kth = max(kth, int(np.partition(have, len(have) - k)[len(have) - k]))
            bound = 0
            for row, docs in enumerate(self.docs):
                at = int(best[row])
                while at < sizes[row]:
                    gaps = np.flatnonzero(~seen[docs[at : at + 4 * step]])
                    at = at + int(gaps[0]) if len(gaps) else min(at + 4 * step, int(sizes[row]))
                    if len(gaps):
                        break
                best[row] = at
                if at < sizes[row]:
                    bound += int(self.weights[row]) * int(self.impacts[row][at])
            if bound < kth:
                break
            depth, step = depth + step, 2 * step
        none = np.zeros(0, np.int64)
        return (np.concatenate(found) if found else none), (np.concatenate(scores) if scores else none), read


def _norms(sizes: np.ndarray, documents: int, terms: int) -> np.ndarray:
    """``m`` of documents with these numbers of terms: ``100 - 25 + (25 n N) div L``.

    ``25 n N`` can pass 64 bits on very large tables, so it is worked out in Python's integers,
    once for each distinct length.
    """
    distinct, back = np.unique(sizes, return_inverse=True)
    return np.array([75 + 25 * int(n) * documents // terms for n in distinct], np.int64)[back]


def _comparable(ids: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Ids as numbers or text that numpy can sort, and which of them are null."""
    none = ids.is_null().to_numpy(zero_copy_only=False)
    if pa.types.is_integer(ids.type):
        return ids.fill_null(0).to_numpy(zero_copy_only=False), none
    return np.array([str(value) for value in ids.to_pylist()], dtype=str), none


class _Best:
    """The best k of a query among the shards of a task."""

    def __init__(self, k: int):
        self.k, self.floor = k, 1
        self.scores, self.ids, self.none, self.kept = np.zeros(0, np.int64), None, None, None

    def add(self, scores: np.ndarray, ids: pa.Array) -> None:
        values, none = _comparable(ids)
        if self.ids is not None:
            scores = np.concatenate([self.scores, scores])
            values, none = np.concatenate([self.ids, values]), np.concatenate([self.none, none])
            ids = pa.concat_arrays([self.kept, ids])
        order = np.lexsort((values, none, -scores))[: self.k]
        self.scores, self.ids, self.none, self.kept = scores[order], values[order], none[order], ids.take(pa.array(order))
        if len(order) == self.k:
            self.floor = max(self.floor, int(self.scores[-1]))


def _search_shard(row: dict, queries: list[tuple[np.ndarray, np.ndarray]], best: list[_Best], documents: int, terms: int, k: int, cells: int) -> None:
    """All queries of a block over one shard."""
    doc, tf = row["docs"], row["tf"].astype(np.int64)
    names, bounds = row["terms"], np.concatenate([[0], np.cumsum(row["df"])])
    impact = (1_000_000_000 * tf) // (1000 * tf + 12 * _norms(row["sizes"], documents, terms)[doc])
    owner = np.repeat(np.arange(len(names)), row["df"])
    order = np.lexsort((doc, -impact, owner))
    doc, impact = doc[order], impact[order]
    for number, (wanted, weights) in enumerate(queries):
        if not len(names) or not len(wanted):
            continue
        place = np.minimum(np.searchsorted(names, wanted), len(names) - 1)
        there = names[place] == wanted
        place, weight = place[there], weights[there]
        if not len(place):
            continue
        ranges = [slice(bounds[t], bounds[t + 1]) for t in place]
        docs, impacts = [doc[r] for r in ranges], [impact[r] for r in ranges]
        width = max(1, cells // len(place))
        for low in range(0, len(row["sizes"]), width):
            high = min(low + width, len(row["sizes"]))
            if high - low < len(row["sizes"]):
                inside = [(d >= low) & (d < high) for d in docs]
                mine = Lists(weight, [d[i] - low for d, i in zip(docs, inside, strict=True)], [v[i] for v, i in zip(impacts, inside, strict=True)])
            else:
                mine = Lists(weight, docs, impacts)
            found, scores, _ = mine.best(high - low, best[number].floor, k)
            if len(found):
                best[number].add(scores, row["doc_ids"].take(pa.array(found + low)))


def _columns(batch: pa.RecordBatch) -> Iterator[dict]:
    """Shards of a batch, their arrays as numpy views."""
    for row in range(batch.num_rows):
        cell = {name: batch[name][row].values for name in ("sizes", "terms", "df", "docs", "tf")}
        yield {"doc_ids": batch["doc_ids"][row].values, **{name: values.to_numpy() for name, values in cell.items()}}


def search(
    documents: DataFrame,
    queries: DataFrame,
    k: int = 20,
    block_terms: int = BLOCK_TERMS,
    sent_terms: int = SENT_TERMS,
    shard_postings: int = SHARD_POSTINGS,
    cells: int = CELLS,
) -> DataFrame:
    """``(item_id, rank, doc_id, score)``: the ``k`` best of ``documents`` for each of ``queries``."""
    spark = documents.sparkSession
    scratch = Scratch(spark, "lexical")
    asked = scratch.save(query_terms(queries).withColumn("row", F.monotonically_increasing_id()), "queries")
    each = asked.select("row", "item_id", F.explode(F.arrays_zip("terms", "times")).alias("t")).select("row", "item_id", "t.*")
    entries, distinct = each.agg(F.count(F.lit(1)), F.count_distinct("terms")).first()
    wanted = None
    if distinct <= sent_terms:
        # At most ``sent_terms`` numbers.
        wanted = np.sort(np.array([r[0] for r in each.select("terms").distinct().collect()], np.int64))
    index = scratch.save(index_terms(documents, wanted, shard_postings), "index")
    counted = index.agg(F.sum("n_docs"), F.sum("n_terms")).first()
    n, total = int(counted[0] or 0), int(counted[1] or 0)
    held = index.select(F.explode(F.arrays_zip("terms", "df")).alias("t")).groupBy("t.terms").agg(F.sum("t.df").alias("df"))
    weighed = (
        lookup(each, held, "terms", ["row"], rows=entries)
        .groupBy("row")
        .agg(F.first("item_id").alias("item_id"), F.sort_array(F.collect_list(F.struct("terms", "times", "df"))).alias("held"))
    )
    weighed = scratch.save(weighed, "weighed")
    blocks = max(1, -(-entries // block_terms))
    item, key = dict(queries.dtypes)["item_id"], dict(documents.dtypes)["doc_id"]
    merged = spark.createDataFrame([], f"row long, item_id {item}, doc_id {key}, score long")
    for block in range(blocks):
        # The queries of a block: about ``block_terms`` terms, and at least one query.
        mine = weighed.where(F.pmod(F.xxhash64("row"), F.lit(blocks)) == block).toArrow() if blocks > 1 else weighed.toArrow()
        if mine.num_rows and n:
            merged = merged.unionByName(_search_block(index, mine, n, total, k, cells, item, key))
    ranked = merged.withColumn("rank", F.row_number().over(Window.partitionBy("row").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))))
    return ranked.where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


def _search_block(index: DataFrame, block: pa.Table, n: int, total: int, k: int, cells: int, item: str, key: str) -> DataFrame:
    """The best ``k`` of each group of tasks for the queries of a block."""
    block = block.combine_chunks()
    queries = []
    for held in block["held"].to_pylist():
        weight = [t["times"] * math.floor(1000 * math.log((2 * n + 2) / (2 * t["df"] + 1))) for t in held]
        queries.append((np.array([t["terms"] for t in held], np.int64), np.array(weight, np.int64)))
    names = block.select(["row", "item_id"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [_Best(k) for _ in queries]
        for batch in batches:
            for row in _columns(batch):
                _search_shard(row, queries, best, n, total, k, cells)
        used = [number for number, held in enumerate(best) if held.kept is not None]
        if used:
            sizes = [len(best[number].scores) for number in used]
            asked = names.take(pa.array(np.repeat(used, sizes))).combine_chunks()
            yield pa.RecordBatch.from_pydict(
                {
                    "row": asked["row"].combine_chunks(),
                    "item_id": asked["item_id"].combine_chunks(),
                    "doc_id": pa.concat_arrays([best[number].kept for number in used]),
                    "score": pa.array(np.concatenate([best[number].scores for number in used])),
                }
            )

    found = index.drop("n_docs", "n_terms").mapInArrow(run, f"row long, item_id {item}, doc_id {key}, score long")
    # First in groups of tasks, then all: a query has few rows left when they meet.
    groups = F.pmod(F.spark_partition_id(), F.lit(MERGERS))
    order = Window.partitionBy("row", "_group").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    first = found.withColumn("_group", groups).withColumn("_place", F.row_number().over(order))
    return first.where(F.col("_place") <= k).drop("_group", "_place")
