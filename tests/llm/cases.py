import pytest

TABLES = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row long, size string, packed string, spans string, base string, __text string, _id string, score string, n int, tile string"
PROSE = "The quick brown fox jumps over the lazy dog while seven wizards brew a potion of bright amber light. "


def cases():
    """Nulls, empty, very short and very long texts, exact and near copies, equal rows."""
    long_text = " ".join(f"word{i * 7919 % 10007}" for i in range(30_000))
    changed = PROSE * 3
    rows = [
        (1, None),
        (2, ""),
        (3, " \n\t "),
        (4, "one"),
        (5, "one two"),
        (6, PROSE * 3),
        (7, changed.replace("potion", "stew", 1)),
        (8, PROSE * 3),
        (9, long_text),
        (10, long_text + " end"),
        (11, "Ünïcödé straße 漢字 naïve — café " * 9),
        (12, "X" * 5000),
        (13, "!!! ... ???"),
        (14, "Released under the MIT License. Licensed under the Apache License, Version 2.0."),
        (15, "call +1 (343) 555-6039 or mail a.b@mail.example.com, card 4799134681044206, host 10.0.0.255"),
        (16, "no data here 256.1.1.1 1234567890123456"),
        (17, "the quick brown fox jumps over the lazy dog while"),
        (18, "seven wizards " + PROSE.upper()),
    ]
    return rows


@pytest.fixture(scope="session")
def documents(spark):
    """The cases with extra columns whose names operators use themselves."""
    return spark.createDataFrame([(key, text, "en" if key % 2 else None, "s", None, 1, "x", "y", "z", "b", "t", "i", "s", 5, "t") for key, text in cases()], SCHEMA)


@pytest.fixture(scope="session")
def empty(documents):
    return documents.limit(0)


@pytest.fixture(scope="session")
def repeated(spark, documents):
    """Every row twice, and rows without a ``doc_id``."""
    none = documents.where("doc_id in (6, 9, 15)").withColumn("doc_id", documents["doc_id"] * None)
    return documents.union(documents).union(none)


@pytest.fixture(scope="session")
def prose(spark):
    return spark.read.parquet(f"{TABLES}/documents.parquet")


def rows_of(table, *columns):
    return [tuple(row) for row in table.select(*columns).collect()]


def texts_of(table):
    return [tuple(row) for row in table.select("doc_id", "text").collect()]
