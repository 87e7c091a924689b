"""Homomorphic multiset fingerprints of documents.

A document is the multiset of its passages: the parts between line breaks, sentence ends and,
in long paragraphs, blanks that their own surroundings choose. Each passage hashes to a wide vector, a fingerprint is the sum of the vectors modulo
powers of two: the order of passages does not matter, and a passage or a whole document is
put in or taken out by adding or subtracting (Bellare, Micciancio 1997; Clarke et al. 2003).

The vector has two parts. Four lanes modulo 2^64 are filled by every passage and decide
equality. Levels of 64 lanes modulo 2^16 are filled in one lane each, by all passages, by one
in two, by one in four and so on. How many lanes are used, and how many differ, tells how many
passages two documents have and how many only one of them has, even where some passages meet in
a lane; how alike they are is twice what is shared over the sum of both. The level is the
finest that is not too full, so about 24 to 48 lanes are compared whatever the size (a deviation
of about 0.06); there are levels for more passages than a text of 2^31 bytes can have. As base64 the
levels after the last used one are left out.

Defined results: null is the empty text, whose fingerprint is all zeros and which is alike
only to another empty one. Rows with equal doc_id are ordered by text, a null doc_id comes
first. Other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kithwatch.llm.arrays import Rolling, mixed, ranges, slices, utf8

DENSE, LEVELS, LANES = 4, 25, 64
#: A level with more used lanes than this is too full to tell lanes apart.
FULL = 48
WIDTH = DENSE * 8 + LEVELS * LANES * 2


def vectors_of(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One fingerprint of ``WIDTH`` bytes per text."""
    rows = len(offsets) - 1
    ends = data == 0x0A
    if len(data) > 1:
        ends[1:] |= (data[1:] == 0x20) & (data[:-1] == 0x2E)
    rolling = Rolling(data)
    # Long paragraphs are cut where the eight bytes before a blank say so, whatever surrounds them.
    blanks = np.flatnonzero(data == 0x20)
    blanks = blanks[blanks - offsets[np.searchsorted(offsets, blanks, "right") - 1] >= 8]
    ends[blanks[rolling.of(blanks - 8, blanks) % np.uint64(8) == 0]] = True
    start, stop = ranges(~ends, offsets)
    hashes = rolling.of(start, stop)
    first = np.searchsorted(start, offsets)
    owner = np.repeat(np.arange(rows), np.diff(first))
    dense = np.zeros((rows, DENSE), np.uint64)
    full = np.flatnonzero(np.diff(first))
    for lane in range(DENSE):
        if len(full):
            dense[full, lane] = np.add.reduceat(mixed(hashes + np.uint64(lane + 1)), first[full])
    wide = np.zeros((rows, LEVELS, LANES), np.uint16)
    drawn = mixed(hashes ^ np.uint64(0xA5A5A5A5A5A5A5A5))
    for level in range(LEVELS):
        taken = (drawn & np.uint64((1 << level) - 1)) == 0
        drawn, owner = drawn[taken], owner[taken]
        if not len(drawn):
            break
        value = ((drawn >> np.uint64(32)) & np.uint64(0xFFFF)) | np.uint64(1)
        lane = (drawn >> np.uint64(56)) % np.uint64(LANES)
        cell = owner * LANES + lane.astype(np.int64)
        sums = np.bincount(cell, weights=value.astype(float), minlength=rows * LANES)
        wide[:, level] = (sums.astype(np.int64) & 0xFFFF).astype(np.uint16).reshape(rows, LANES)
    return np.concatenate([dense.view(np.uint8).reshape(rows, -1), wide.reshape(rows, -1).view(np.uint8)], axis=1)


def _parts(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    prints = np.ascontiguousarray(prints)
    dense = np.ascontiguousarray(prints[:, : DENSE * 8]).view(np.uint64)
    wide = np.ascontiguousarray(prints[:, DENSE * 8 :]).view(np.uint16)
    return dense, wide.reshape(len(prints), LEVELS, LANES)


def combined(a: np.ndarray, b: np.ndarray, sign: int = 1) -> np.ndarray:
    """Fingerprints of two multisets put together (sign 1), or of ``a`` without ``b`` (-1)."""
    (da, wa), (db, wb) = _parts(a), _parts(b)
    dense, wide = (da + db, wa + wb) if sign > 0 else (da - db, wa - wb)
    return np.concatenate([dense.view(np.uint8), wide.reshape(len(a), -1).view(np.uint8)], axis=1)


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """From 0 (nothing shared) to 1 (equal), row by row."""
    (da, wa), (db, wb) = _parts(a), _parts(b)
    used = ((wa != 0) | (wb != 0)).sum(axis=2)
    differing = (wa != wb).sum(axis=2)
    fits = used <= FULL
    fits[:, -1] = True
    row, level = np.arange(len(a)), fits.argmax(axis=1)
    # Passages from the lanes they fill, some together; never more than LANES - 1 lanes, as all tell no number.
    either, one = (-np.log1p(-np.minimum(n[row, level], LANES - 1) / LANES) for n in (used, differing))
    both = either - one
    found = 2 * both / np.where(either == 0, 1, either + both)
    return np.where((da == db).all(axis=1), 1.0, np.clip(found, 0.0, 1.0))


def text_of(prints: np.ndarray) -> list[str]:
    """Base64 of each, up to the last level in use."""
    levels = _parts(prints)[1].any(axis=2)
    used = np.where(levels.any(axis=1), LEVELS - levels[:, ::-1].argmax(axis=1), 0)
    return [base64.b64encode(row[: DENSE * 8 + n * LANES * 2].tobytes()).decode() for row, n in zip(prints, used.tolist(), strict=True)]


def prints_of(texts: list[str]) -> np.ndarray:
    """The fingerprints that ``text_of`` wrote."""
    return np.frombuffer(b"".join(base64.b64decode(text).ljust(WIDTH, b"\0") for text in texts), np.uint8).reshape(-1, WIDTH)


def fingerprint_documents(documents: DataFrame) -> DataFrame:
    """``(doc_id, fingerprint)``, base64 of the vector, in one pass without a shuffle."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            yield pa.RecordBatch.from_pydict({"doc_id": part["doc_id"], "fingerprint": text_of(vectors_of(*utf8(part["text"])))})

    kind = dict(documents.dtypes)["doc_id"]
    return documents.select("doc_id", "text").mapInArrow(made, f"doc_id {kind}, fingerprint string")


def in_order(documents: DataFrame, per_partition: int = 4) -> DataFrame:
    """``(doc_id, text, _bucket, _extra)`` sorted inside each partition, every bucket followed by the next row.

    Buckets are ranges of ``doc_id``. The first rows of the following bucket (of the first
    one, after the last) are copied to the end of each with ``_extra`` set, so that a task
    knows the document after its last one.
    """
    spark = documents.sparkSession
    keyed = documents.select("doc_id", "text", F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("_key"))
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    ranged = keyed.select("_key").repartitionByRange(parts * per_partition, "_key")
    lows = sorted(row["low"] for row in ranged.groupBy(F.spark_partition_id()).agg(F.min("_key").alias("low")).collect())
    rows = []
    for bucket, low in enumerate(lows):
        after = lows[bucket + 1] if bucket + 1 < len(lows) else None
        rows.append((bucket, False, low, after))
        rows.append((bucket, True, lows[0] if after is None else after, None))
    # As many rows as there are buckets, twice: a number set by the cluster, not by the data.
    bounds = spark.createDataFrame(rows, "_bucket int, _extra boolean, _low long, _high long")
    inside = ~F.col("_extra") & (F.col("_key") >= F.col("_low")) & (F.col("_high").isNull() | (F.col("_key") < F.col("_high")))
    placed = keyed.join(F.broadcast(bounds), inside | (F.col("_extra") & (F.col("_key") == F.col("_low"))))
    dealt = placed.repartition(parts, "_bucket").sortWithinPartitions("_bucket", "_extra", "_key", "text")
    return dealt.select("doc_id", "text", "_bucket", "_extra")


def compare_with_next(documents: DataFrame) -> DataFrame:
    """Each document's fingerprint, that of its edited text, and how alike it is to both.

    The edit replaces the last quarter of the code points by the first as many (or all) of
    the next document.
    """

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carried = None
        for part in slices(batches):
            texts = [text or "" for text in part["text"].to_pylist()]
            prints = vectors_of(*utf8(part["text"]))
            bucket, extra = part["_bucket"].to_numpy(), part["_extra"].to_numpy(zero_copy_only=False)
            ids = part["doc_id"].to_pylist()
            if carried:
                ids, texts = [carried[0], *ids], [carried[1], *texts]
                bucket, extra = np.append(carried[2], bucket), np.append(carried[3], extra)
                prints = np.concatenate([carried[4], prints])
            carried = ids[-1], texts[-1], bucket[-1:], extra[-1:], prints[-1:]
            kept = np.flatnonzero((bucket[:-1] == bucket[1:]) & ~extra[:-1])
            if not len(kept):
                continue
            edited = []
            for k in kept:
                size = len(texts[k]) // 4
                edited.append(texts[k][: len(texts[k]) - size] + texts[k + 1][:size])
            changed = vectors_of(*utf8(pa.array(edited, pa.large_string())))
            yield pa.RecordBatch.from_pydict(
                {
                    "doc_id": pa.array([ids[k] for k in kept], part.schema.field("doc_id").type),
                    "n_chars": pa.array([len(texts[k]) for k in kept], pa.int64()),
                    "edited_sha256": [hashlib.sha256(text.encode()).hexdigest() for text in edited],
                    "fingerprint": text_of(prints[kept]),
                    "edited_fingerprint": text_of(changed),
                    "near_edited": likeness(prints[kept], changed),
                    "near_next": likeness(prints[kept], prints[kept + 1]),
                }
            )

    kind = dict(documents.dtypes)["doc_id"]
    schema = f"doc_id {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return in_order(documents).mapInArrow(made, schema)
