"""The stages one by one, each against what it was given."""

import random
import tracemalloc

import numpy as np
import pytest
from cases import TABLES, documents, empty, repeated, rows_of, texts_of  # noqa: F401
from contracts import components, contamination, private_spans

import corpus_pipeline
from kithwatch.llm.language import Profiles, calibrated_bounds


def test_stages(spark, documents):
    docs = documents.select(*corpus_pipeline.COLUMNS).union(spark.read.parquet(f"{TABLES}/documents.parquet").selectExpr("doc_id + 5000", "text", "lang", "source", "n_chars"))
    items = [tuple(row) for row in spark.read.parquet(f"{TABLES}/benchmark.parquet").select("item_id", "text").collect()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, docs, TABLES)
        assert kept.columns == corpus_pipeline.COLUMNS and kept.dtypes == docs.dtypes
        before, after = dict(texts_of(docs)), dict(texts_of(kept))
        if name == "language":
            assert before.keys() - after.keys() == {1, 2, 3, 13}
        if name == "near_duplicates":
            groups = components(list(before.items()), 5, 80, 100)
            assert after.keys() == {key for key, (_, group) in groups.items() if key == group}
        if name == "decontamination":
            assert after.keys() == {row[0] for row in contamination(list(before.items()), items, 10) if not row[-1]}
        if name == "personal_data":
            assert after.keys() == before.keys() and not any(private_spans(text) for text in after.values())
            assert all(after[key] == before[key] for key in before if key in (7, 17))
        kept.write.mode("overwrite").parquet(f"{spark.conf.get('spark.checkpoint.dir')}/stage-{name}")
        docs = spark.read.parquet(f"{spark.conf.get('spark.checkpoint.dir')}/stage-{name}")
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, TABLES)
    assert {key for (key,) in rows_of(pieces, "doc_id")} == {key for (key,) in rows_of(docs, "doc_id")}


def test_stages_of_repeated_and_no_rows(spark, repeated, empty):
    for table in (repeated, empty):
        docs = table
        for _, stage in corpus_pipeline.STAGES[:-1]:
            docs = stage(spark, docs, TABLES)
        assert (docs.count() == 0) == (table is empty)
    near = dict(corpus_pipeline.STAGES)["near_duplicates"]
    ids = [key for (key,) in rows_of(near(spark, repeated, TABLES), "doc_id") if key is not None]
    assert len(ids) == len(set(ids)) and {6, 9} <= set(ids) and not {8, 10} & set(ids)


@pytest.mark.parametrize("unlearned", ["de", "es", "fr"])
def test_language_stage_drops_unlearned_languages_and_noise(spark, unlearned):
    draw = random.Random(1)
    noise = [" ".join("".join(draw.choices("abcdefghijklmnopqrstuvwxyz", k=draw.randint(2, 9))) for _ in range(200)) for _ in range(20)]
    real = spark.read.parquet(f"{TABLES}/documents.parquet").select(*corpus_pipeline.COLUMNS)
    labels = {row["doc_id"]: (row["lang"], len(set(row["text"].split()))) for row in real.collect()}
    rows = [(10_000 + k, text, None, "noise", len(text)) for k, text in enumerate(noise)]
    foreign = "Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan. Heille on annettu järki ja omatunto, ja heidän on toimittava toisiaan kohtaan veljeyden hengessä. " + "Jokaisella on oikeus elämään, vapauteen ja henkilökohtaiseen turvallisuuteen. Ketään ei saa pitää orjana."
    rows.append((20_000, foreign, None, "fi", len(foreign)))
    hidden = real.selectExpr("doc_id", "text", f"nullif(lang, '{unlearned}') as lang", "source", "n_chars")
    docs = hidden.union(spark.createDataFrame(rows, real.schema))
    kept = {key for (key,) in rows_of(dict(corpus_pipeline.STAGES)["language"](spark, docs, TABLES), "doc_id")}
    assert all(key in kept for key, (lang, _) in labels.items() if lang != unlearned)
    assert not [key for key, (lang, n_words) in labels.items() if lang == unlearned and n_words > 40 and key in kept]
    assert not [key for key in kept if key >= 10_000]


def test_bounds_of_lengths():
    assert calibrated_bounds({}) == [] and calibrated_bounds({(1, "en"): {40: 9}}) == [0, 0]
    # Of 300 rows the three lowest do not count; few rows of a length are joined by shorter ones.
    assert calibrated_bounds({(0, "en"): {4: 2, 8: 1, 80: 297}, (1, "en"): {160: 5}}) == [0.1, 0.1]
    # A rare language of at least ten rows has its own bound.
    assert calibrated_bounds({(0, "en"): {200: 9000}, (0, "fi"): {40: 10}}) == [0.05]


def test_language_stage_learns_from_all_labelled_rows(spark, monkeypatch):
    from kithwatch.llm import language

    texts = {"en": "the cat sat on the mat and went away number", "de": "die Katze sitzt auf der Matte und geht dann weg"}
    table = [(i, f"{texts[lang]} {'abcdefghij'[i % 10] * 3}", lang) for i, lang in enumerate(["en", "de"] * 30)]
    docs = spark.createDataFrame([*table, (90, None, "en"), (91, "no label", None)], "doc_id long, text string, lang string")
    monkeypatch.setattr(language, "LEARNED_ROWS", 4)
    monkeypatch.setattr(language, "CALIBRATED_ROWS", 4, raising=False)
    judged = []
    bounds = language.calibrated_bounds

    def watched(counts):
        judged.extend(rows for bins in counts.values() for rows in bins.values())
        return bounds(counts)

    monkeypatch.setattr(language, "calibrated_bounds", watched)
    kept = language.in_known_language(docs, docs, ["doc_id"])
    assert sum(judged) == len(table)
    assert {row.doc_id for row in kept.collect()} >= set(range(60))


def test_learning_ngrams_copies_no_vectors():
    letters = "abcdefghijklmnopqrstuvwxyz"
    texts = ["".join(f"{a}{b}{c}" for b in letters for c in letters).encode() for a in letters[:8]]
    one = Profiles(512)
    vectors = [one.of(np.frombuffer(text, np.uint8), np.array([0, len(text)]))[0] for text in texts]
    tracemalloc.start()
    profiles = Profiles(512)
    for text, wanted in zip(texts, vectors, strict=True):
        # Known before or not, a text has the same vector.
        assert np.allclose(profiles.of(np.frombuffer(text, np.uint8), np.array([0, len(text)]))[0], wanted, atol=1e-6)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(profiles.keys) > 4000
    assert peak < 1.5 * profiles.most * 512 * 4
