"""Relationships between items: caps that interact, merging of evidence, scores, groups and test-to-source matches."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import paths as X
from ..store import Stage
from .substrings import texts_with


def interacting_caps(spark: SparkSession, df: DataFrame, order: str, caps: dict[str, int], total: int) -> DataFrame:
    """``df`` with ``kept`` and ``drop_reason`` when rows are taken by the unique column ``order`` under caps by column and in all.

    Only kept rows use up a cap, so the caps interact. Decided in rounds: a row is kept for certain if even all rows
    before it that may be kept leave it within every cap, and dropped for certain if those kept already fill one. The
    first open row is always decided, and so are most in the first rounds. ``drop_reason`` is ``total``, or the first
    column of ``caps`` whose cap was full. Null is a value (``unknown``) like others.
    """
    stage = Stage(spark, "caps")
    keys = {c: f"_cap_{i}" for i, c in enumerate(caps)}
    rows = df.withColumns({k: F.coalesce(F.col(c).cast("string"), F.lit("unknown")) for c, k in keys.items()}).withColumn("_state", F.lit(0))
    rows = stage.save(rows)
    at = F.struct(F.col(order).alias("at"))  # a struct, so a null comes before all others

    def filled(hits: dict[str, Column]) -> DataFrame:
        """``rows`` with, for each name, an array by cap: whether the rows before, of those that it hits, fill the cap.

        They do from the row on that follows the cap's last; of a value only the first rows up to the cap are numbered,
        whatever its number of rows, and Spark cuts each task's rows to these before they meet.
        """
        out = rows
        for c, cap in caps.items():
            for name, hit in hits.items():
                flag = f"_{name}{keys[c]}"
                if cap <= 0:
                    out = out.withColumn(flag, F.lit(True))
                    continue
                n = F.row_number().over(Window.partitionBy(keys[c]).orderBy(order))
                last = rows.where(hit).select(keys[c], order).withColumn("_n", n).where(F.col("_n") == cap)
                last = stage.save(last.select(keys[c], at.alias("_last")))
                out = out.join(last, keys[c], "left").withColumn(flag, F.coalesce(at > F.col("_last"), F.lit(False))).drop("_last")
        return out

    every = lambda name: [F.col(f"_{name}{k}") for k in keys.values()]
    while not rows.where("_state = 0").isEmpty():
        judged = filled({"likely": F.col("_state") < 2, "sure": F.col("_state") == 1})
        sure, unlikely = (reduce(or_, every(name), F.lit(False)) for name in ("sure", "likely"))
        state = F.when(F.col("_state") > 0, F.col("_state")).when(sure, 2).when(~unlikely, 1).otherwise(0)
        rows = stage.save(judged.withColumn("_state", state).select(rows.columns))
    reason = F.coalesce(*[F.when(full, c) for c, full in zip(caps, every("sure"), strict=True)], F.lit(None).cast("string"))
    # the rows kept at last are few: the first ``total`` in order
    cut = rows.where("_state = 1").orderBy(order).limit(total).agg(F.when(F.count("*") == total, F.max(order)).alias("cut")).scalar()
    out = filled({"sure": F.col("_state") == 1}).withColumns({"_reason": reason, "_cut": cut})
    late = F.coalesce(F.col(order) > F.col("_cut"), F.lit(False))
    out = out.withColumn("drop_reason", F.when(late, "total").when(F.col("_state") == 2, F.col("_reason")))
    return out.select(*df.columns, F.col("drop_reason").isNull().alias("kept"), "drop_reason")


def bounded_list(values: Column, most: int, noun: str) -> Column:
    """At most ``most`` values; where some are left out, the last says how many."""
    more = F.size(values) - most + 1
    last = F.array(F.concat(F.lit("...and "), more.cast("string"), F.lit(f" more {noun}")))
    return F.when(F.size(values) <= most, values).otherwise(F.concat(F.slice(values, 1, most - 1), last))


def merge_by_origin(df: DataFrame, keys: list[str], origin: str, ranks: dict[str, int], score: str, evidence: str, most: int) -> DataFrame:
    """One row per identity: origin and score of the best origin (then highest score), the union of the evidence.

    ``evidence`` is cut to the first ``most`` in order, ``omitted`` counts the rest, which are counted, not collected.
    """
    rank = F.coalesce(*[F.when(F.col(origin) == o, r) for o, r in ranks.items()], F.lit(len(ranks)))
    best = F.min(F.struct(rank.alias("r"), (-F.col(score)).alias("s"), F.col(origin).alias("o"))).alias("_b")
    heads = df.groupBy(*keys).agg(best, F.count("*").alias("n"))
    distinct = df.select(*keys, evidence).distinct()
    numbered = distinct.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(evidence)))
    lists = numbered.groupBy(*keys).agg(F.sort_array(F.collect_list(F.when(F.col("_r") <= most, F.col(evidence)))).alias("evidence"), F.greatest(F.count("*") - most, F.lit(0)).alias("omitted"))
    return heads.join(lists, keys).select(*keys, F.col("_b.o").alias("origin"), (-F.col("_b.s")).alias("score"), "n", "evidence", "omitted")


def without_suppressed(df: DataFrame, pair: list[str], kind: str, origin: str, explicit: str) -> DataFrame:
    """Rows of a pair but those inferred for another kind than the pair's explicit one (the first, where several).

    What is explicit is grouped first and joined, so the rows of a pair that nearly all share need not meet in one task.
    """
    said = df.where(F.col(origin) == explicit).groupBy(*[F.col(c).alias(f"_said_{i}") for i, c in enumerate(pair)]).agg(F.min(kind).alias("_said"))
    same = F.lit(True)
    for i, c in enumerate(pair):
        same = same & F.col(c).eqNullSafe(F.col(f"_said_{i}"))
    return df.join(said, same, "left").where(F.col("_said").isNull() | (F.col(origin) == explicit) | (F.col(kind) == F.col("_said"))).select(*df.columns)


def evidence_score(df: DataFrame, keys: list[str], signal: str, weights: dict[str, float], weak: tuple[str, ...]) -> DataFrame:
    """``keys, n_signals, score, band``: each kind of signal once; weak ones alone at most 0.30, all at most 0.95."""
    weight = F.coalesce(*[F.when(F.col(signal) == s, F.lit(w)) for s, w in weights.items()], F.lit(0.0))
    once = df.groupBy(*keys, signal).agg(F.first(weight).alias("_w"))
    out = once.groupBy(*keys).agg(F.count("*").alias("n_signals"), F.sum("_w").alias("_s"), F.bool_and(F.col(signal).isin(*weak)).alias("_weak"))
    score = F.round(F.least(F.when(F.col("_weak"), F.least(F.col("_s"), F.lit(0.30))).otherwise(F.col("_s")), F.lit(0.95)), 3)
    band = F.when(score >= 0.65, "high").when(score >= 0.35, "medium").otherwise("low")
    return out.select(*keys, "n_signals", score.alias("score"), band.alias("band"))


def origin_score(origin: Column, n: Column, strongest: Column, all_weak: Column) -> Column:
    """1 for explicit; 0.25 without evidence; else the strongest, 0.35 at most if all is weak, 0.75 at least from files."""
    capped = F.when(all_weak, F.least(strongest, F.lit(0.35))).otherwise(strongest)
    raised = F.when(origin.isin("workspace_file", "local_path_reference"), F.greatest(capped, F.lit(0.75))).otherwise(capped)
    return F.when(origin == "explicit", 1.0).when(n == 0, 0.25).otherwise(F.round(F.least(raised, F.lit(0.95)), 3))


def detected_frameworks(df: DataFrame, unit: list[str], framework: str, kind: str, score: str, least: float, must: dict[str, tuple[str, ...]]) -> DataFrame:
    """``unit, framework, score, detected``: each kind of evidence once; enough of it, and one of the kinds it must have."""
    once = df.groupBy(*unit, framework, kind).agg(F.max(score).alias("_s"))
    needed = F.lit(False)
    for name, kinds in must.items():
        needed = needed | ((F.col(framework) == name) & F.col(kind).isin(*kinds))
    out = once.groupBy(*unit, framework).agg(F.sum("_s").alias("score"), F.max(needed).alias("_must"))
    free = ~F.col(framework).isin(*must)
    return out.select(*unit, framework, "score", ((F.col("score") >= least) & (F.col("_must") | free)).alias("detected"))


# fixed values: points of a match between a test and a source
FILENAME, REFERENCED, CHOSEN, MOST_TERMS, SAME_FOLDER, PER_FOLDER, FOLDERS_COUNTED = 300, 180, 40, 15, 80, 15, 3


def best_source_of_tests(files: DataFrame, path: str, texts: Column, terms: Column, selected: Column) -> DataFrame:
    """``test, source, score, exact``: the source file that each test most likely tests; tests without one have no row.

    A source counts if the test's stem is the source's, with ``test_`` before it or not, or if the test's path or
    ``texts`` (an array, its imports) contain the source's stem, in lower case and with spaces for ``_`` and ``-``. A
    path, module or name that is spoken of contains the stem, so the stem alone is looked for. Nearness of the folders,
    being ``selected`` and the number of the source's ``terms`` add to the score. Ties go to the exact, the selected,
    the shorter and then the greater path. A null path is no file; equal paths are one file, with the least of its texts.

    No test meets all sources of a common stem: of a stem the best source is taken for each folder, and for each of the
    first folders of the path that count for nearness, and a test meets those of its own folders only.
    """
    p = F.col(path)
    normal = lambda c: F.lower(F.translate(c, "\\_-", "/  "))
    rows = files.where(p.isNotNull()).select(p.alias("p"), X.stem(p).alias("stem"), X.folders(p).alias("above"), X.is_matching_test(p).alias("t"), F.coalesce(texts, F.array().cast("array<string>")).alias("texts"), F.size(terms).alias("n_terms"), F.coalesce(selected, F.lit(False)).alias("selected"))
    rows = rows.groupBy("p", "stem", "above", "t").agg(F.min("texts").alias("texts"), F.max("n_terms").alias("n_terms"), F.max("selected").alias("selected"))

    def places(above: Column, shared: Column) -> Column:
        """A file's own folder, and its first folders by number, as keys with their points."""
        near = F.transform(F.sequence(F.lit(0), F.lit(FOLDERS_COUNTED)), lambda k: F.when(F.size(shared) >= k, F.struct(F.concat(k.cast("string"), F.lit(" "), F.array_join(F.slice(shared, F.lit(1), k), "/")).alias("place"), (k * PER_FOLDER).alias("near"))))
        return F.array_compact(F.concat(near, F.array(F.struct(F.concat(F.lit("= "), F.array_join(above, "/")).alias("place"), F.lit(SAME_FOLDER).alias("near")))))

    own = F.struct((F.when(F.col("selected"), CHOSEN).otherwise(0) + F.least("n_terms", F.lit(MOST_TERMS))).alias("own"), "selected", (-F.char_length("p")).alias("short"), F.col("p").alias("source"))
    sources = rows.where("NOT t").select("stem", normal(F.col("stem")).alias("needle"), F.explode(places(F.col("above"), F.col("above"))["place"]).alias("place"), own.alias("best"))
    sources = sources.groupBy("stem", "needle", "place").agg(F.max("best").alias("best"))

    bare = F.regexp_replace("stem", r"(?i)\.(test|spec)$", "")
    tests = rows.where("t").select(F.col("p").alias("test"), bare.alias("bare"), F.col("above"), normal(F.array_join(F.concat(F.array("p"), "texts"), " ")).alias("hint"))
    spoken = texts_with(sources.select("needle"), tests, "test", "hint")
    named = tests.select("test", F.explode(F.array_distinct(F.array("bare", F.regexp_replace("bare", "^test_", "")))).alias("stem"))
    meets = spoken.join(sources.select("needle", "stem").distinct(), "needle").select("test", "stem", F.lit(REFERENCED).alias("said"), F.lit(0).alias("named"))
    meets = meets.unionByName(named.join(sources.select("stem").distinct(), "stem").select("test", "stem", F.lit(0).alias("said"), F.lit(FILENAME).alias("named")))
    meets = meets.groupBy("test", "stem").agg(F.max("said").alias("said"), F.max("named").alias("named"))
    at = tests.select("test", F.inline(places(F.col("above"), F.filter("above", lambda x: x != "__tests__"))))
    score = (F.col("said") + F.col("named") + F.col("near") + F.col("best.own")).cast("long")
    found = meets.join(at, "test").join(sources.drop("needle"), ["stem", "place"])
    top = F.max(F.struct(score.alias("score"), (F.col("named") > 0).alias("exact"), "best.selected", "best.short", "best.source"))
    return found.groupBy("test").agg(top.alias("_b")).select("test", "_b.source", "_b.score", "_b.exact")


def ordered_limits(df: DataFrame, group: str, order: list[Column], per_group: int, total: int) -> DataFrame:
    """Rows with ``place``: of each group the first ``per_group`` in order, and of these the first ``total``."""
    w = Window.partitionBy(group).orderBy(*order)
    few = df.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= per_group).drop("_r")
    return few.orderBy(*order).limit(total).withColumn("place", F.row_number().over(Window.orderBy(*order)).cast("long"))
