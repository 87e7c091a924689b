"""Ranked search, hard negatives, balanced packing and what they share, against plain Python."""

import heapq
import math
import random
import re
import zlib
from array import array
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from cases import documents, empty, prose, repeated, rows_of, texts_of  # noqa: F401
from contracts import CASE
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from kithwatch.llm import balance, language, lexical, negatives
from kithwatch.llm.tokens import Encoder

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


# Token ids and letters alone and in company


def test_ids_equal_the_tokenizer_for_any_text():
    rng = random.Random(5)
    letters = list("abcXYZ019 .,'/!?<>|\"-_ \t\n\x0b\x1c\x1f\x85\xa0ªº²½µßÀÿÖñİıΣσςǅſKǺ̧̈̊가각가漢字​ 　﻿ﬁ😀ЖщЁ́ा­") + ["<|endoftext|>", "'s", "'LL", "the", "Hello", "İ/"]
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(1, 12))) for _ in range(20_000)] + ["İ/", "ΑΣ. ΑΣ", "É", "İ" * 300]
    encoder, tokenizer = Encoder(VOCABULARY), Tokenizer.from_file(VOCABULARY)
    for k in range(0, len(texts), 400):
        part = texts[k : k + 400]
        wanted = [array("I", found.ids).tobytes() for found in tokenizer.encode_batch(part, add_special_tokens=False)]
        assert encoder.encode(part) == wanted


def test_language_of_a_text_is_the_same_in_any_company(spark, prose):
    labelled = prose.where("lang is not null and text is not null").select("doc_id", F.upper("text").alias("text"), "lang").orderBy("doc_id").limit(40).coalesce(1)
    prototypes = language.learn_prototypes(prose)
    alone = rows_of(language.identify_language(labelled.select("doc_id", "text"), prototypes), "doc_id", "lang_pred", "score")
    odd = spark.createDataFrame([(-1, "İ"), (-2, "ΑΣ"), (-3, "ß İİ ΣΑΣ")], "doc_id long, text string")
    mixed = odd.union(labelled.select("doc_id", "text")).union(odd).coalesce(1)
    found = rows_of(language.identify_language(mixed, prototypes).where("doc_id >= 0"), "doc_id", "lang_pred", "score")
    assert sorted(found) == sorted(alone) and len(alone) == 40


def test_vectors_of_texts_equal_the_definition():
    texts = ["Ünï İst", "", "a", "ΣΑΣ, 12 Жя", "x" * 50, "  tab\tnew\nline "]
    data = [text.encode() for text in texts]
    offsets = np.cumsum([0, *map(len, data)])
    found, seen = language.Profiles(256).of(np.frombuffer(b"".join(data), np.uint8), offsets)
    for text, vector, letters in zip(texts, found, seen, strict=True):
        low = "".join(c.lower()[0] for c in text)
        line = re.sub(" +", " ", "".join(c if c.isalpha() else " " for c in low))
        total = np.zeros(256)
        for gram in (line[i : i + 3] for i in range(len(line) - 2)):
            made = np.ones(256)
            for place, letter in enumerate(gram):
                made *= np.roll(language._letter_vectors(np.array([ord(letter)]), 256)[0], place)
            total += made
        assert letters == any(c.isalpha() for c in low)
        assert vector == pytest.approx(total / (np.linalg.norm(total) or 1), abs=1e-5)


# 11: ranked lexical search


def ranked(rows, items, k=20):
    held = [(key, Counter(TERM.findall((text or "").translate(CASE)))) for key, text in rows]
    held = [(key, terms) for key, terms in held if terms]
    n, total = len(held), sum(sum(terms.values()) for _, terms in held)
    df = Counter(term for _, terms in held for term in terms)
    out = []
    for item, text in items:
        asked = TERM.findall((text or "").translate(CASE))
        scores = []
        for key, terms in held:
            m = 75 + 25 * sum(terms.values()) * n // total
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * terms[t]) // (1000 * terms[t] + 12 * m)) for t in asked if t in terms)
            if score > 0:
                scores.append((-score, key is None, key, score))
        out += [(item, rank, key, score) for rank, (_, _, key, score) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=str)


SIZES = [{}, {"shard_postings": 1, "cells": 1}, {"shard_postings": 40, "cells": 60, "block_terms": 20, "sent_terms": 0}]


@pytest.mark.parametrize("sizes", SIZES)
@pytest.mark.parametrize("k", [1, 4])
def test_search_equals_scoring_all(spark, documents, sizes, k):
    items = [(1, "the quick brown fox, the LAZY dog"), (2, None), (3, ""), (4, "MIT license word7919 word7919"), (5, "nowhere"), (6, "漢字 café über"), (6, "fox")]
    queries = spark.createDataFrame([(*item, "x") for item in items], "item_id long, text string, doc_id string")
    found = rows_of(lexical.search(documents, queries, k, **sizes), "item_id", "rank", "doc_id", "score")
    assert sorted(found, key=str) == ranked(texts_of(documents), items, k)


def test_search_of_real_texts_and_early_stops(spark, prose):
    items = rows_of(spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet"), "item_id", "text")
    queries = spark.createDataFrame(items, "item_id long, text string")
    found = rows_of(lexical.search(prose, queries, 20, shard_postings=2000), "item_id", "rank", "doc_id", "score")
    assert sorted(found, key=str) == ranked(texts_of(prose), items)


def test_best_positions_stop_before_the_lists_end():
    rng = np.random.default_rng(3)
    documents, weights = 20_000, np.array([900, 700, 40])
    strength = rng.permutation(documents)
    docs, impacts = [], []
    for _ in weights:
        value = 1000 + np.maximum(0, strength * 40 + rng.integers(0, 2000, documents))
        order = np.argsort(-value, kind="stable")
        docs.append(order)
        impacts.append(value[order])
    found, scores, read = lexical.Lists(weights, docs, impacts).best(documents, 1, 20)
    every = np.zeros(documents, np.int64)
    for weight, d, i in zip(weights, docs, impacts, strict=True):
        every[d] += weight * i
    wanted = sorted(zip(-every, range(documents), strict=True))[:20]
    assert sorted(zip(-scores, found, strict=True))[:20] == wanted
    assert read < documents / 4


def test_search_of_repeated_and_no_rows(spark, repeated, empty):
    items = [(1, "quick brown fox"), (1, "quick brown fox"), (None, "data")]
    queries = spark.createDataFrame(items, "item_id long, text string")
    found = rows_of(lexical.search(repeated, queries), "item_id", "rank", "doc_id", "score")
    assert sorted(found, key=str) == ranked(texts_of(repeated), items)
    assert lexical.search(empty, queries).collect() == []
    assert lexical.search(repeated, queries.limit(0)).collect() == []


# 12: hard negatives


def mined(rows, anchors, positives=5, negatives=5):
    usable = [(key, label, [math.floor(256 * x) for x in v]) for key, label, v in rows if key is not None and label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    dot = lambda a, b: sum(x * y for x, y in zip(a, b, strict=False))
    out = []
    for anchor, label, v in usable:
        if not anchors(anchor):
            continue
        others = sorted((-dot(v, w), key, name) for key, name, w in usable if key != anchor)
        for score, positive, _ in [o for o in others if o[2] == label][:positives]:
            inside = [(s, key) for s, key, name in others if name != label and 80 * -score <= 100 * -s <= 100 * -score]
            out += [(anchor, positive, rank, key, -score, -s) for rank, (s, key) in enumerate(inside[:negatives], 1)]
    return sorted(out)


VECTORS = "vec_id long, label int, embedding array<double>, v string, score int, _anchor int, _row int"


def vectors(spark, rows):
    return spark.createDataFrame([(*row, "x", 1, 2, 3) for row in rows], VECTORS)


def random_vectors(count, seed):
    rng = np.random.default_rng(seed)
    centers = rng.normal(0, 1, (4, 20))
    rows = []
    for key in range(count):
        v = centers[key % 4] * 0.6 + rng.normal(0, 0.7, 20) * np.linspace(2, 0.1, 20)
        rows.append((key, int(key * 7 % 3), [float(round(x, 2)) for x in v]))
    return rows


ODD = [
    (1000, None, [1.0]),
    (1001, 1, None),
    (1002, 1, [1.0, None]),
    (1003, 1, [float("nan")]),
    (1004, 1, [float("inf"), 1.0]),
    (None, 1, [1.0, 1.0]),
    (1005, 1, []),
    (1010, 2, [0.0] * 20),
    (1020, 2, [3.0, -1.0]),
    (1030, 0, [-2.0] * 20),
]


@pytest.mark.parametrize("block", [8192, 7])
def test_negatives_equal_all_pairs(spark, block):
    rows = random_vectors(160, 4) + ODD
    table = negatives.quantized(vectors(spark, rows)).repartition(3)
    found = rows_of(negatives.mine(table, F.col("vec_id") % 10 == 0, block_anchors=block), "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
    wanted = mined(rows, lambda key: key % 10 == 0)
    assert sorted(found) == wanted and len(wanted) > 100


def test_negatives_of_ties_copies_and_no_rows(spark):
    rows = [(key, key % 2, [1.0, 0.5]) for key in range(30)] + [(key, key % 3, [0.9, 0.5]) for key in range(30, 60)]
    table = negatives.quantized(vectors(spark, rows))
    find = lambda t: sorted(rows_of(negatives.mine(t, F.col("vec_id") % 10 == 0), "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"))
    assert find(table) == mined(rows, lambda key: key % 10 == 0)
    twice = find(table.union(table))
    assert {row[0] for row in twice} == {0, 10, 20, 30, 40, 50} and all(row[1] != row[0] != row[3] for row in twice)
    assert find(table.limit(0)) == [] and find(table.where("vec_id % 10 != 0")) == []
    with pytest.raises(ArithmeticError):
        find(negatives.quantized(vectors(spark, [(1, 1, [1e9])])))


def test_index_leaves_out_what_norms_cover():
    rng = np.random.default_rng(1)
    rows = np.round(rng.normal(0, 100, (300, 64)) * np.linspace(3, 0.01, 64))
    rows[:50] = np.round(rows[:50] / 100)
    anchors = np.round(rng.normal(0, 100, (9, 64)) * np.linspace(3, 0.01, 64))
    floors = 0.4 * np.linalg.norm(anchors, axis=1) * np.linalg.norm(rows, axis=1).max()
    index = negatives.SliceIndex(rows, float((floors / np.linalg.norm(anchors, axis=1)).min()))
    assert set(range(50)).isdisjoint(index.place.tolist()) and (index.lists < 4).any()
    a, r, score = index.join(anchors, floors, np.ones((9, 300), bool))
    wanted = {(i, j) for i, j in zip(*np.nonzero(anchors @ rows.T >= floors[:, None]), strict=True)}
    assert set(zip(a.tolist(), r.tolist(), strict=True)) == wanted and wanted


# 13: balanced packing


def check_balanced(table, found, capacity=balance.CAPACITY, tasks=None):
    tokenizer, pieces, sequences = Tokenizer.from_file(VOCABULARY), defaultdict(list), defaultdict(list)
    for row in found:
        assert row["ids_crc32"] == zlib.crc32(bytes(row["ids"])) and len(row["ids"]) == 4 * row["length"] > 0
        pieces[row["doc_id"]].append(row)
        sequences[row["sequence_id"]].append((row["offset"], row["length"]))
    for key, text in texts_of(table):
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        mine = sorted(pieces[key], key=lambda row: row["start"])
        assert [row["start"] for row in mine] == [0, *np.cumsum([row["length"] for row in mine])[:-1].tolist()]
        assert all(row["doc_tokens"] == len(ids) for row in mine)
        assert b"".join(bytes(row["ids"]) for row in mine) == ids.tobytes()
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        # Nothing is padded.
        assert at == capacity or (at < capacity and at & (at - 1) == 0)
    return sequences


def balanced(table, **options):
    return balance.pack_balanced(table, VOCABULARY, with_ids=True, **options).collect()


@pytest.mark.parametrize("options", [{}, {"shard_tokens": 1, "capacity": 64}, {"shard_tokens": 5000}])
def test_balanced_round_trip(documents, prose, options):
    capacity = options.get("capacity", balance.CAPACITY)
    check_balanced(documents, balanced(documents, **options), capacity)
    check_balanced(prose, balanced(prose.coalesce(2), **options), capacity)


def test_balanced_sequences_cost_about_the_same():
    rng = np.random.default_rng(2)
    lengths = np.minimum(700, np.maximum(1, rng.lognormal(5, 1, 20_000).astype(int)))
    lengths = np.append(lengths, 2048 - lengths.sum() % 2048)
    rooms = np.full(int(lengths.sum()) // 2048, 2048)
    piece, start, length, sequence, offset = balance.pack_shard(lengths, rooms)
    assert (np.bincount(sequence, length) == 2048).all()
    assert len(piece) - len(lengths) <= len(rooms)
    squares = np.bincount(sequence, length.astype(float) ** 2)
    # Filled in the given order, cut wherever a sequence ends.
    cut, room, size = balance._overlay(lengths, rooms)
    plain = np.bincount(room, size.astype(float) ** 2)
    assert squares.std() < plain.std() / 5 and squares.max() < 1.1 * squares.mean()


def test_dealing_equals_choosing_one_by_one():
    rng = np.random.default_rng(7)
    for _ in range(30):
        lengths, rooms = rng.integers(1, 40, 25), rng.integers(1, 60, 9)
        placed, left = balance.deal(lengths, rooms, 3.0, 1.0)
        room, cost, wanted = rooms.copy(), np.zeros(9), {}
        for piece in np.argsort(-lengths, kind="stable"):
            fit = [(cost[s], s) for s in range(9) if room[s] >= lengths[piece]]
            wanted[piece] = min(fit)[1] if fit else -1
            if fit:
                room[wanted[piece]] -= lengths[piece]
                cost[wanted[piece]] += 3.0 * lengths[piece] + lengths[piece] ** 2
        assert [wanted[p] for p in range(25)] == placed.tolist() and (room == left).all()


def test_balanced_of_repeated_and_no_rows(repeated, empty):
    found = balanced(repeated)
    assert sum(row["start"] == 0 for row in found) == repeated.count()
    places = [(row["sequence_id"], row["offset"]) for row in found]
    assert len(places) == len(set(places))
    assert balanced(empty) == []
