import sys
from pathlib import Path

import pytest

HERE = Path(__file__).resolve().parent
sys.path[:0] = [str(HERE), str(HERE.parent)]

WORDS = "the quick brown fox jumps over a lazy dog while seven wizards mix jugs of amber wine and quartz for the old king of north hills".split()


def passage(k, n=60):
    return " ".join(f"{WORDS[(i * (k + 3) + k) % len(WORDS)]}{(i * i + k) % 11}" for i in range(n))


#: Ids, texts, languages and sources with nulls, empty and long texts, exact and near copies, ties and shared passages.
EDGES = [
    (1, passage(1), "en", "a"),
    (2, passage(1), "en", "a"),
    (3, passage(1) + " tail", "en", "b"),
    (4, None, "en", None),
    (5, "", None, "b"),
    (6, " \t\n\x0b\x0c\r ", "de", "c"),
    (7, "word", "de", "c"),
    (8, "WORD", "de", "c"),
    (9, "two words", None, None),
    (10, "äöü ßß x " * 40, "fr", "é"),
    (11, "line one is here\nline two is here\nline three is here\nline four is here\nmore", "en", "a"),
    (12, "other\nline one is here\n\n  line two is here\nline three is here\nline four is here\nend", "en", "d"),
    (13, "x\nx\nx\nx\nx\nx", "en", "d"),
    (14, "\n".join(passage(k, 30) for k in range(400)), "en", "a"),
    (15, "a" * 400, "en", "a"),
    (16, "b" + "a" * 300 + "c", "en", "a"),
    (17, passage(9, 200)[:300] + "Ⱥ" + passage(1), "en", "a"),
    (18, "#*$%&|<> " * 80, "en", "b"),
    (19, passage(5), "en", "e"),
    (20, passage(5).replace(" ", "  "), "en", "e"),
]


@pytest.fixture(scope="session")
def edges(spark):
    """EDGES with a repeated column name to clash with and an extra one."""
    rows = [(*r, float(r[0]), "extra") for r in EDGES]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, size double, `_start` string")


@pytest.fixture(scope="session")
def nothing(edges):
    return edges.where("false")


@pytest.fixture(scope="session")
def documents(spark, sf):
    return [(r.doc_id, r.text, r.source) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "source").collect()]
