"""Relevance of files to any number of tasks, by an inverted index of the words in the files' fields.

Scores are those of :func:`sparkloom.functions.relevance.task_relevance`, which reads one task as literals and every
file for it. Here the words of all files are written once as postings, tasks are rows, and one join and one aggregation
score all pairs that have anything in common. A term that is only part of a word is found by the word's grams, so no term is
compared with every word.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import relevance as R
from ..functions import text as T
from ..store import Stage
from .ranking import top_per_group
from .substrings import words_with

#: Fields of a file, as bits: its name, path, symbols, imports, routes; its bag of terms; texts without spaces; a word of the
#: bag that is the term.
OWN, WHOLE, NAMES, BROUGHT, WAYS, BAG, CLOSE, EXACT = (1 << i for i in range(8))
WORD = "([a-z0-9]+)"


def task_rows(tasks: DataFrame, key: str, text: str) -> DataFrame:
    """``key, terms, wide, phrases`` and for each kind of files whether the task hints at it."""
    terms = T.task_terms(F.coalesce(F.col(text), F.lit("")))
    synonyms = F.create_map(*[x for k, v in R.TASK_SYNONYMS.items() for x in (F.lit(k), F.array(*[F.lit(w) for w in v]))])
    empty = F.array().cast("array<string>")
    rows = tasks.select(key, terms.alias("terms")).withColumn("wide", F.array_distinct(F.flatten(F.transform("terms", lambda t: F.concat(F.array(t), F.coalesce(synonyms[t], empty))))))
    hints = {f"hint_{k}": F.arrays_overlap("terms", F.array(*[F.lit(w) for w in v])) for k, v in R.TASK_HINTS.items()}
    return rows.withColumn("phrases", T.phrases(F.col("terms"))).withColumns(hints)


def postings(files: DataFrame, key: str) -> DataFrame:
    """``word, key, fields``: each distinct word of a row of :func:`relevance.described`, with the bits of its fields."""
    words = lambda c: F.regexp_extract_all(c, F.lit(WORD), 1)
    of = lambda values, bit: F.transform(F.array_distinct(F.flatten(F.transform(values, words))), lambda w: F.struct(w.alias("word"), F.lit(bit).alias("bit")))
    squeezed = F.transform(F.concat(F.array("whole"), F.col("ways")), lambda x: F.replace(x, F.lit(" "), F.lit("")))
    every = F.concat(of(F.array("own"), OWN), of(F.array("whole"), WHOLE), of(F.col("names"), NAMES), of(F.col("brought"), BROUGHT), of(F.col("ways"), WAYS), of(F.col("bag"), BAG), of(squeezed, CLOSE))
    return files.select(key, F.inline(every)).groupBy(key, "word").agg(F.bit_or("bit").alias("fields"))


def file_scores(spark: SparkSession, tasks: DataFrame, files: DataFrame, *, task: str = "task", text: str = "text", key: str = "file_id", selected: DataFrame | None = None, path: str = "path") -> DataFrame:
    """``task, key, path, score, n_matched, confidence, is_test, selected`` of all pairs with a score or a selection.

    ``tasks`` has ``task`` and ``text``; ``files`` are rows of :func:`relevance.described` with ``roles``, under a
    ``key`` of their own; ``selected`` has ``task, path``. Pairs that share no term, phrase or hinted role have no row
    (their score would be 0 or below). A null task has no terms, so only its selection counts. Empty tables give no rows.
    """
    stage = Stage(spark, "taskindex")
    asked = stage.save(task_rows(tasks, task, text))
    # what describes a file is computed once
    files = stage.save(files.select(key, path, "own", "whole", "names", "brought", "ways", "bag", "roles"))
    index = stage.save(postings(files, key))
    # phrases are looked up without their spaces, in texts without spaces
    of_terms = asked.select(task, F.explode("wide").alias("term"), F.lit(False).alias("phrase"))
    of_phrases = asked.select(task, F.explode(F.array_distinct(F.transform("phrases", lambda p: F.replace(p, F.lit(" "), F.lit(""))))).alias("term"), F.lit(True).alias("phrase"))
    wanted = stage.save(of_terms.unionByName(of_phrases))
    met = words_with(wanted, index)
    found = wanted.join(met, "term").join(index, "word")
    own_bits = F.when(F.col("phrase"), F.col("fields").bitwiseAND(CLOSE)).otherwise(F.col("fields").bitwiseAND(~CLOSE) + F.when((F.col("fields").bitwiseAND(BAG) > 0) & (F.col("word") == F.col("term")), EXACT).otherwise(0))
    by_term = found.groupBy(task, key, "term", "phrase").agg(F.bit_or(own_bits).alias("fields")).where("fields > 0")

    has = lambda bit: F.col("fields").bitwiseAND(bit) > 0
    points = F.when(has(OWN), 6).when(has(WHOLE), 4).otherwise(0)
    for bit, n in ((EXACT, 3), (NAMES, 2), (BROUGHT, 1), (WAYS, 3)):
        points = points + F.when(has(bit), n).otherwise(0)
    texts = has(WHOLE | NAMES | BROUGHT | WAYS)
    plain = ~F.col("phrase")
    direct = asked.select(task, F.explode("terms").alias("term"), F.lit(True).alias("direct"))
    scored = by_term.join(direct, [task, "term"], "left").groupBy(task, key).agg(
        F.sum(F.when(plain, points).otherwise(0)).alias("points"),
        F.count_if(plain & has(EXACT)).alias("shared"),
        F.count_if(plain & has(EXACT) & F.col("direct")).alias("shared_direct"),
        F.count_if(plain & texts & F.col("direct")).alias("n_matched"),
        F.collect_set(F.when(F.col("phrase"), F.col("term"))).alias("said"),
    )  # fmt: skip  # a task's phrases bound the set
    role_points = [F.when(F.col(f"hint_{hint}"), F.struct(F.lit(role).alias("role"), F.lit(n).alias("n"))) for role, hint, n in R.ROLE_BONUS]
    role_points.append(F.when(F.array_contains("terms", "hook") | F.col("hint_frontend_ui"), F.struct(F.lit("hook").alias("role"), F.lit(7).alias("n"))))
    hinted = asked.select(task, F.inline(F.array_compact(F.array(*role_points))))
    of_role = files.select(key, F.explode("roles").alias("role")).join(hinted, "role").groupBy(task, key).agg(F.sum("n").alias("role_points"))
    pairs = scored.join(of_role, [task, key], "full")
    if selected is not None:
        chosen = files.select(key, path).join(selected.select(task, path).distinct(), path).select(task, key, F.lit(True).alias("selected"))
        pairs = pairs.join(chosen, [task, key], "full")
    else:
        pairs = pairs.withColumn("selected", F.lit(False))
    pairs = pairs.fillna(0, ["points", "shared", "shared_direct", "n_matched", "role_points"]).fillna(False, ["selected"])
    return _settled(pairs, asked, files, task, key, path)


def _settled(pairs: DataFrame, asked: DataFrame, files: DataFrame, task: str, key: str, path: str) -> DataFrame:
    """The pairs' scores with what only the file's own texts tell: phrases across the bag, tests and support files."""
    rows = pairs.join(asked.drop("wide"), task).join(files.select(key, path, "roles", F.array_join("bag", " ").alias("bag")), key)
    said = F.coalesce("said", F.array().cast("array<string>"))

    def of_phrase(p: Column) -> Column:
        return F.when(F.contains(F.col("bag"), p), 4 + F.size(F.split(p, " "))).otherwise(0) + F.when(F.array_contains(said, F.replace(p, F.lit(" "), F.lit(""))), 5).otherwise(0)

    shared = F.when(F.col("shared") >= 2, F.col("shared") * 2).otherwise(F.col("shared"))
    total = F.col("points") + F.col("role_points") + shared + F.col("shared_direct") * 4 + F.aggregate("phrases", F.lit(0), lambda acc, p: acc + of_phrase(p))
    less = lambda c, hit, n: F.greatest(c - F.when(hit, n).otherwise(0), F.when(hit, 1).otherwise(0))
    is_test = F.array_contains("roles", "test")
    total = F.when(F.col("hint_tests"), total).otherwise(less(total, is_test, 15))
    total = F.when(F.col("hint_tests") | F.col("hint_styles"), total).otherwise(less(total, F.lower(path).rlike(R.SUPPORT_FILE), 12))
    total = F.when(F.size("terms") > 0, total).otherwise(0).cast("long")
    rows = rows.withColumn("score", total)
    confidence = R.score_confidence(F.col("score"), F.col("n_matched"), F.col("roles"))
    return rows.select(task, key, path, "score", "n_matched", confidence.alias("confidence"), is_test.alias("is_test"), "selected", F.col("hint_tests").alias("asks_tests"))


def rank_files(scores: DataFrame, shown: int, *, task: str = "task", key: str = "file_id", path: str = "path", few: int = 3) -> DataFrame:
    """``task, place, key, path, score, confidence``: per task the selected files, then the best that fit.

    A file fits with a match or more than low confidence; if none does, the ``few`` best are shown. Tests come last
    unless the task asks for them. A window's rows are cut to ``shown`` a task before they are shuffled.
    """
    fits = F.col("selected") | F.col("confidence").isin("high", "medium") | (F.col("n_matched") > 0)
    rows = scores.where("selected OR score > 0").withColumns({"fits": fits, "last": F.col("is_test") & ~F.col("asks_tests")})
    best = top_per_group(rows, [task], [F.desc("selected"), F.desc("fits"), F.col("last"), F.desc("score"), F.col(path), F.col(key)], shown, "place")
    some = best.groupBy(task).agg(F.bool_or("fits").alias("any_fit"))
    return best.join(some, task).where(F.col("fits") | (~F.col("any_fit") & (F.col("place") <= few))).select(task, "place", key, path, "score", "confidence")
