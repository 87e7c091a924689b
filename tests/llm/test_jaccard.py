"""Links of the n-gram Jaccard join: repeated ids, low thresholds, all links, wide bitmaps."""

import itertools

import numpy as np
import pyarrow as pa
import pytest
from cases import PROSE, rows_of
from contracts import components

import corpus_pipeline
from kithwatch.llm import jaccard
from kithwatch.llm.arrays import utf8

NUMBERED = [f"w{i}" for i in range(400)]


def _grams(text, size):
    words = text.lower().split()
    return {tuple(words[i : i + size]) for i in range(len(words) - size + 1)} if len(words) >= size else {tuple(words)} - {()}


def test_rows_of_one_id_with_different_texts_are_one_node(spark):
    base = " ".join(NUMBERED[:60])
    rows = [(1, "something else entirely here"), (1, base), (2, base + " more"), (3, "alone in the dark")]
    found = rows_of(jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), 3, 90, 100), "doc_id", "component_id")
    assert sorted(found) == [(1, 1), (1, 1), (2, 1), (3, 3)]


def test_ids_of_text_and_thresholds_below_half(spark):
    rows = [("b", " ".join(NUMBERED[:12])), ("a", " ".join(NUMBERED[:40])), ("c", " ".join(NUMBERED[200:240]))]
    table = spark.createDataFrame(rows, "doc_id string, text string")
    wanted = components(rows, 3, 20, 100)
    found = rows_of(jaccard.jaccard_components(table, 3, 20, 100), "doc_id", "n_shingles", "component_id")
    assert {key: (n, name) for key, n, name in found} == wanted and wanted["b"][1] == "a"


def test_all_links_between_different_sets(spark):
    texts = [" ".join(NUMBERED[k : k + 60]) for k in range(0, 30, 2)] + [PROSE * 2, PROSE * 2, " ".join(NUMBERED[300:360])]
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    links, membership = jaccard.jaccard_links(table, 3, 80, 100)
    rep = dict(rows_of(membership, "doc_id", "rep"))
    assert rep[15] == rep[16] and len(set(rep.values())) == len(texts) - 1
    wanted = set()
    for a, b in itertools.combinations(range(len(texts)), 2):
        one, two = _grams(texts[a], 3), _grams(texts[b], 3)
        if rep[a] != rep[b] and 100 * len(one & two) >= 80 * len(one | two):
            wanted.add(tuple(sorted((rep[a], rep[b]))))
    assert set(rows_of(links, "a", "b")) == wanted and len(wanted) > 20


@pytest.mark.parametrize("words", [(300, 310), (1000, 1100), (5000, 9000)])
def test_bitmaps_bound_the_overlap_and_turn_unlike_sets_away(words):
    texts = [" ".join(f"{name}{i}" for i in range(count)) for name, count in zip("ab", words)]
    texts.append(texts[0] + " " + " ".join(f"c{i}" for i in range(words[0] // 20)))
    sets = jaccard._sets(*utf8(pa.array(texts)), 3)
    flat, lanes = jaccard._bitmaps(sets)
    column = jaccard.lists(flat.view(np.int64), lanes, pa.int64())
    bits = jaccard._folded(column, int(lanes.min()))
    differing = np.bitwise_count(bits[0] ^ bits).sum(axis=1)
    exact = [len(_grams(texts[0], 3) ^ _grams(text, 3)) for text in texts]
    assert all(differing <= exact)
    allowed = [jaccard._may_link(d, sets.count[0], n, 90, 100) for d, n in zip(differing, sets.count)]
    assert allowed == [True, False, True]


def test_frequent_grams_come_last_and_memory_is_bounded():
    keys, counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    for turn in range(50):
        new = np.append(np.arange(turn * 100, turn * 100 + 100), [7, 7, 7]).astype(np.uint64)
        keys, counts = jaccard._summed(np.concatenate([keys, new]), np.concatenate([counts, np.ones(len(new), np.int64)]), 20)
        assert len(keys) <= 20
    assert keys[np.argmax(counts)] == 7
    grams = np.array([9, 5, 6, 4], np.uint64)
    rarity = jaccard.Rarity(np.arange(1 << 16) / 4096, np.array([5, 9], np.uint64), np.array([1, 0]))
    words = np.array([3 << 60, 2 << 60, 15 << 60, 1 << 60, 0], np.uint64)
    ranks = rarity.of(words, grams, np.ones(4, bool), 2)
    # Frequent ones last, by count; the others by what their words add up to.
    assert np.argsort(ranks).tolist() == [3, 2, 0, 1]


def test_stage_keeps_unlike_texts_of_one_id(spark):
    base = " ".join(NUMBERED[:80])
    rows = [(1, "quite another text of its own"), (1, base + " x"), (0, base), (2, "third"), (2, "third"), (None, base)]
    docs = spark.createDataFrame([(key, text, "en", "s", None) for key, text in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kept = rows_of(dict(corpus_pipeline.STAGES)["near_duplicates"](spark, docs, ""), "doc_id", "text")
    assert sorted(kept, key=str) == sorted([rows[0], rows[2], rows[3], rows[5]], key=str)


def test_small_tiles_of_unlike_sets_are_compared_once_and_for_all(spark, monkeypatch):
    # Every passage is in several texts, and no two texts are alike but the last two.
    passages = [" ".join(f"p{k}w{i}" for i in range(20)) for k in range(9)]
    texts = [" ".join(pair) for pair in itertools.combinations(passages, 2)]
    texts += [" ".join(passages[:5]), " ".join(passages[:5]) + " more"]
    rows, tests, test = list(enumerate(texts)), [], jaccard._Links.test
    monkeypatch.setattr(jaccard._Links, "test", lambda links, pairs: (tests.append(1), test(links, pairs)))
    table = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    found = rows_of(jaccard.jaccard_components(table, 3, 90, 100), "doc_id", "n_shingles", "component_id")
    assert {key: (n, name) for key, n, name in found} == components(rows, 3, 90, 100)
    assert len(tests) == 2
    # Tiles beyond the limit go through rounds and give the same.
    monkeypatch.setattr(jaccard, "WHOLE", 3)
    again = rows_of(jaccard.jaccard_components(table, 3, 90, 100), "doc_id", "n_shingles", "component_id")
    assert sorted(again) == sorted(found) and len(tests) > 4


def test_links_of_a_dense_group_are_looked_at_once(spark, monkeypatch):
    # Near copies: each with two words of its own, so that their tiles differ and many pairs are links.
    base = [f"w{i}" for i in range(200)]
    rng = np.random.default_rng(5)
    texts = []
    for k in range(60):
        copy = list(base)
        copy[int(rng.integers(200))] = f"x{k}"
        texts.append(" ".join(copy))
    rows = list(enumerate(texts))
    seen, roots = [], jaccard.component_roots

    def counted(edges):
        seen.append((edges.count(), edges.where("src >= dst").count()))
        return roots(edges)

    monkeypatch.setattr(jaccard, "component_roots", counted)
    monkeypatch.setattr(jaccard, "WHOLE", 3)
    table = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    found = rows_of(jaccard.jaccard_components(table, 3, 90, 100), "doc_id", "n_shingles", "component_id")
    assert {key: (n, name) for key, n, name in found} == components(rows, 3, 90, 100)
    # After the first time there is a link for each class that is not its component's name, and what is new.
    assert len(seen) > 1 and seen[0][0] > 100 and all(links < 60 for links, _ in seen[1:])
    assert not any(wrong for _, wrong in seen)


def test_stage_reads_texts_where_they_are(spark):
    base = " ".join(NUMBERED[:80])
    rows = [(k, base + (" x" if k else "")) for k in range(3)] + [(9, "another text")]
    docs = spark.createDataFrame([(key, text, "en", "s", None) for key, text in rows], "doc_id long, text string, lang string, source string, n_chars long")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        kept = dict(corpus_pipeline.STAGES)["near_duplicates"](spark, docs, "")
        assert "SortMergeJoin" not in kept._jdf.queryExecution().sparkPlan().toString()
        assert sorted(rows_of(kept, "doc_id")) == [(0,), (9,)]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
