"""The inverted index gives every pair the score that the column expression gives it."""

import random

from pyspark.sql import functions as F

from sparkloom.functions import relevance as R
from sparkloom.operators import taskindex
from sparkloom.plans import code_queries

WORDS = ["add", "login", "form", "page", "hook", "test", "failing", "api", "style", "user", "service", "userservice", "card", "getsmall", "anvil", "bolt", "index", "main", "schema", "db", "button", "view", "client", "x", "ser", "rv", "ice", "cart", "store"]


def test_scores_equal_the_columns(spark, sf):
    rng = random.Random(11)
    texts = [" ".join(rng.choices(WORDS, k=rng.randrange(1, 7))) for _ in range(25)] + [*code_queries.TASKS, "", "the of", "zzzz qqqq"]
    files = code_queries.described_files(spark, sf).where("file_id % 4 = 1 OR size(routes) > 0").persist()
    tasks = spark.createDataFrame([*enumerate(texts), (99, None)], "task long, text string")
    got = {(r.task, r.file_id): (r.score, r.n_matched, r.confidence) for r in taskindex.file_scores(spark, tasks, files).collect()}
    columns = []
    for i, text in enumerate(texts):
        score = R.task_relevance(text, F.col("path"), F.col("roles")).cast("long")
        n = F.size(R.matched_terms(text))
        columns.append(F.struct(F.lit(i).alias("task"), score.alias("score"), n.cast("long").alias("n"), R.score_confidence(score, n, F.col("roles")).alias("confidence")))
    n_files = files.count()
    for r in files.select("file_id", F.inline(F.array(*columns))).collect():
        if (r.task, r.file_id) in got:
            assert got.pop((r.task, r.file_id)) == (r.score, r.n, r.confidence), (texts[r.task], r.file_id)
        else:
            assert r.score <= 1 and r.n == 0, (texts[r.task], r.file_id, r.score)
    assert not got and n_files
    files.unpersist()


def test_selection_and_few(spark):
    rows = [(1, "src/pages/home.ts", ["GetHome"], [], [], []), (2, "src/b.ts", [], [], [], []), (3, "lib/zz.py", [], [], [], [])]
    files = spark.createDataFrame(rows, "file_id long, path string, classes array<string>, functions array<string>, imports array<string>, said array<string>").withColumn("symbols", F.concat("classes", "functions"))
    from sparkloom.functions import paths as X

    files = R.described(files, "path", "symbols", "imports", "said").withColumn("roles", X.file_roles(F.col("path"), F.lit(0)))
    tasks = spark.createDataFrame([(1, "home view"), (2, "nothing here"), (3, None)], "task long, text string")
    chosen = spark.createDataFrame([(2, "lib/zz.py"), (3, "src/b.ts"), (3, "gone.ts"), (3, None)], "task long, path string")
    got = sorted((r.task, r.place, r.path) for r in taskindex.rank_files(taskindex.file_scores(spark, tasks, files, selected=chosen), 5).collect())
    assert got == [(1, 1, "src/pages/home.ts"), (2, 1, "lib/zz.py"), (3, 1, "src/b.ts")]
    assert taskindex.file_scores(spark, tasks.where("false"), files).count() == 0 and taskindex.file_scores(spark, tasks, files.where("false")).count() == 0
