"""The SQL of the text queries against the contracts in plain Python."""

import hashlib
from pathlib import Path

import duckdb
import pytest
from cases import TABLES
from contracts import components, contamination, license_base, private_spans, without_repeats

from kithwatch.llm.licenses import PHRASES
from kithwatch.llm.queries import ORACLE, QUERIES


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for path in Path(TABLES).glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return con


def test_every_sql_has_its_query():
    assert set(ORACLE) <= set(QUERIES)


def test_sql_says_what_the_contracts_say(tables):
    ask = lambda sql: sorted(tables.execute(sql).fetchall())
    documents = ask("SELECT doc_id, text FROM documents")
    assert ask(ORACLE["op1_ngram_jaccard"]) == sorted((key, *found) for key, found in components(documents, 3, 90, 100).items())
    assert ask(ORACLE["op5_decontamination"]) == sorted(contamination(documents, ask("SELECT item_id, text FROM benchmark"), 10))
    found = without_repeats(documents, 200)
    assert ask(ORACLE["op10_repeated_strings"]) == sorted((key, *rest) for (key, _), rest in zip(documents, found, strict=True))
    counts = [(key, *(sum(span[1] == kind for span in private_spans(text)) for kind in (1, 2, 3, 4))) for key, text in documents]
    assert ask(ORACLE["personal_data_counts"]) == counts
    by_id = lambda sql: sorted(tables.execute(sql).fetchall(), key=lambda row: row[0])
    assert by_id(ORACLE["license_phrases"]) == [(key, *license_base(text, PHRASES)) for key, text in documents]
    edits = []
    for (key, text), (_, following) in zip(documents, documents[1:] + documents[:1], strict=True):
        text, following = text or "", following or ""
        cut = len(text) // 4
        edits.append((key, len(text), hashlib.sha256((text[: len(text) - cut] + following[:cut]).encode()).hexdigest()))
    assert ask(ORACLE["fingerprint_edits"]) == edits
