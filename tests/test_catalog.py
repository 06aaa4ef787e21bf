import oracle
import pytest

from sparkloom import catalog


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_queries_equal_their_sql(spark, sf, name):
    ours, theirs = oracle.both(spark, sf, catalog.queries()[name], catalog.oracle_sql()[name])
    assert ours == theirs


def test_strategy_summary_covers_all_files(spark, tmp_path):
    rows = [(i, "the api" if i < 350 else "plain", "en", "a", 100 if i < 350 else 20_000) for i in range(400)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    out = {r.cost: (r.n, r.avg_value) for r in catalog.strategy_summary(spark, str(tmp_path)).collect()}
    assert out == {1: (350, 2.0), 2: (50, 0.0)}


def test_phrases_and_terms(spark, sf):
    import re

    from sparkloom.functions.text import TASK_STOP_WORDS

    rows = {r.item_id: r for r in catalog.task_phrases(spark, sf).collect()}
    for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect():
        terms = list(dict.fromkeys(t for t in re.findall("[a-z0-9]+", r.text.lower()) if len(t) > 2 and t not in TASK_STOP_WORDS))
        runs = {tuple(terms[i : i + k]) for k in (2, 3) for i in range(len(terms) - k + 1)}
        assert (rows[r.item_id].n_terms, rows[r.item_id].n_phrases) == (len(terms), len(runs))


def test_entry_has_rows(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
