from __future__ import annotations

import pytest

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def shared(spark, tmp_path_factory):
    """A shared folder for what operators write between stages."""
    if not spark.conf.get("spark.checkpoint.dir", None):
        spark.conf.set("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
    return spark


#: Nulls, empty, blank, repeated and long texts, with extra columns whose names operators use inside.
ODD = [
    (1, "the quick brown fox jumps over the lazy dog again and again", "en", "s", 1, 1.0),
    (2, None, None, None, None, 2.0),
    (3, "", "en", "s", 0, 3.0),
    (4, " \t\n ", "de", "s", 4, 4.0),
    (5, "word " * 40_000, "en", "s", 200_000, 5.0),
    (5, "word " * 40_000, "en", "s", 200_000, 5.0),
    (None, "the quick brown fox jumps over the lazy dog again and again", "en", "s", 1, 6.0),
    (6, "1234 !!! ???", "fr", None, 12, 7.0),
    (7, "Ünïcödé — 漢字 😀 İstanbul K", "de", "s", 20, 8.0),
    (8, "the  quick brown\tfox jumps over the lazy dog again and again", "en", "s", 1, 9.0),
]
ODD_SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, bucket double"


@pytest.fixture(scope="session")
def odd(shared):
    return shared.createDataFrame(ODD, ODD_SCHEMA)


@pytest.fixture(scope="session")
def nothing(shared):
    return shared.createDataFrame([], ODD_SCHEMA)
