"""Operator 1: quality rules whose thresholds come from quantile sketches per language and source."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .store import Stage
from .text import SPACES, words

SYMBOLS = "#*$%&|<>"
MILLION = 1_000_000
#: Features that the adaptive rules bound from above, in parts per million of words, lines or characters.
FEATURES = ("symbol_ppm", "dup_line_ppm", "repeat_ppm", "word_len_milli")
#: A sketch with fewer documents is merged with its language's, then with everything.
LEAST_ROWS = 200
#: Features that are bounded from below too.
TWO_SIDED = ("word_len_milli",)
#: A threshold lies this many times the distance from the median to the tail quantile beyond that quantile.
REACH = 2
#: What a threshold grants besides, in the feature's unit, as values come in coarse bins.
TOLERANCE = {"symbol_ppm": 0, "dup_line_ppm": 0, "repeat_ppm": 20_000, "word_len_milli": 300}
#: Of features that most documents have none of, the threshold is at least this quantile of the documents that have some:
#: marks are rare in prose and make tables or noise, repeated lines are rare too but may be headings.
POSITIVE = {"symbol_ppm": 0.01, "dup_line_ppm": 0.9}
#: For that, a sketch needs so many documents that have some; where all documents together have fewer, the data say
#: nothing of what is usual, and these values hold.
LEAST_POSITIVE = 20
UNKNOWN = {"symbol_ppm": 5_000, "dup_line_ppm": 100_000}


def text_features(df: DataFrame, *, text_col: str = "text") -> DataFrame:
    """``df`` with ``n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words`` (long; 0 for a null text).

    ``n_repeat_words`` counts the words covered by three-word windows that occur twice or more in the text, the first
    occurrence included. Windows of a text are sorted by a hash of 64 bits; neighbours with one hash are compared by
    their words.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = df.withColumn("_q_words", words(F.col(text_col)))
    w, n = F.col("_q_words"), F.size("_q_words")
    rows = rows.withColumn("_q_hashes", F.transform(w, lambda x: F.xxhash64(x)))
    h = F.col("_q_hashes")

    def window(x: Column, i: Column) -> Column:
        return F.struct(F.xxhash64(x, F.get(h, i + 1), F.get(h, i + 2)).alias("h"), i.alias("i"))

    rows = rows.withColumn("_q_sorted", F.when(n > 3, F.sort_array(F.transform(F.slice(h, F.lit(1), n - 2), window))))
    s = F.col("_q_sorted")

    def equals_next(k: Column) -> Column:
        a, b = F.get(s, k), F.get(s, k + 1)
        same = a["h"] == b["h"]
        for j in range(3):
            same = same & (F.get(w, a["i"] + j) == F.get(w, b["i"] + j))
        return same

    rows = rows.withColumn("_q_twice", F.when(n > 3, F.filter(F.sequence(F.lit(0), n - 4), equals_next)))

    def six(k: Column) -> Column:
        a, b = F.get(s, k)["i"], F.get(s, k + 1)["i"]
        return F.array(a, a + 1, a + 2, b, b + 1, b + 2)

    rows = rows.withColumn("_q_covered", F.when(n > 3, F.size(F.array_distinct(F.flatten(F.transform("_q_twice", six))))))
    joined = F.array_join(w, "")
    symbols = sum((F.char_length(text) - F.char_length(F.replace(text, F.lit(c), F.lit(""))) for c in SYMBOLS), F.lit(0))
    lines = F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(SPACES)) != "")
    rows = rows.withColumn("_q_lines", lines)
    made = {
        "n_words": F.size(w),
        "word_chars": F.char_length(joined),
        "n_symbols": symbols,
        "n_lines": F.size("_q_lines"),
        "n_dup_lines": F.size("_q_lines") - F.size(F.array_distinct("_q_lines")),
        "n_repeat_words": F.coalesce("_q_covered", F.lit(0)),
    }
    spare = ["_q_words", "_q_hashes", "_q_sorted", "_q_twice", "_q_covered", "_q_lines"]
    return rows.withColumns({k: v.cast("long") for k, v in made.items()}).drop(*spare)


def sketch_bin(value: Column) -> Column:
    """Bin of a non-negative integer in a quantile sketch with a relative error of 1/16: its top five bits and shift.

    Sketches of this kind are counts by bin. They merge by adding counts, in any order, to the same result, and their
    size is bounded: about 16 bins for each power of two.
    """
    shift = F.greatest(F.lit(0), F.length(F.bin(value)) - 5)
    return (shift * 16 + F.call_function("shiftright", value, shift)).cast("int")


def bin_top(b: Column) -> Column:
    """Largest value of a bin (the inverse of :func:`sketch_bin`)."""
    shift = F.when(b < 32, F.lit(0)).otherwise((F.floor(b / 16) - 1).cast("int"))
    lead = (b - shift * 16).cast("long")
    return F.call_function("shiftleft", lead + 1, shift) - 1


def _ratios(rows: DataFrame) -> dict[str, Column]:
    def share(part: Column, whole: Column, unit: int) -> Column:
        return F.when(whole > 0, F.floor(part * unit / whole)).otherwise(0).cast("long")

    return {
        "symbol_ppm": share(rows["n_symbols"], rows["word_chars"], MILLION),
        "dup_line_ppm": share(rows["n_dup_lines"], rows["n_lines"], MILLION),
        "repeat_ppm": share(rows["n_repeat_words"], rows["n_words"], MILLION),
        "word_len_milli": share(rows["word_chars"], rows["n_words"], 1000),
    }


def quantile_sketches(rows: DataFrame, keys: list[str], features) -> DataFrame:
    """``keys, feature, bin, n``: one mergeable sketch per key and feature; only bin counts are shuffled."""
    pairs = F.inline(F.array(*[F.struct(F.lit(f).alias("feature"), sketch_bin(F.col(f)).alias("bin")) for f in features]))
    return rows.select(*keys, pairs).groupBy(*keys, "feature", "bin").agg(F.count("*").alias("n"))


def sketch_quantiles(sketch: DataFrame, keys: list[str], points: dict[str, float], positive: dict[str, float]) -> DataFrame:
    """``keys, feature, rows, positives``, a column for each point and ``some``: the top of the bin in which it lies.

    ``some`` is the quantile ``positive[feature]`` of the values above zero, null for other features.
    """
    from pyspark.sql import Window

    own = Window.partitionBy(*keys, "feature")
    upto, none = F.sum("n").over(own.orderBy("bin")), F.coalesce(F.sum(F.when(F.col("bin") == 0, F.col("n"))).over(own), F.lit(0))
    placed = sketch.select(*keys, "feature", "bin", upto.alias("_upto"), F.sum("n").over(own).alias("_all"), none.alias("_none"))
    hit = [F.min(F.when(F.col("_upto") >= F.lit(q) * F.col("_all"), bin_top(F.col("bin")))).alias(c) for c, q in points.items()]
    share = F.create_map(*[F.lit(x) for pair in positive.items() for x in pair])[F.col("feature")]
    above = (F.col("bin") > 0) & (F.col("_upto") - F.col("_none") >= share * (F.col("_all") - F.col("_none")))
    some = F.min(F.when(above, bin_top(F.col("bin")))).alias("some")
    return placed.groupBy(*keys, "feature").agg(F.max("_all").alias("rows"), F.max(F.col("_all") - F.col("_none")).alias("positives"), some, *hit)


def adaptive_thresholds(rows: DataFrame, *, lang_col="lang", source_col="source", least_rows: int = LEAST_ROWS) -> DataFrame:
    """``lang, source`` with ``max_<feature>`` and, for TWO_SIDED ones, ``min_<feature>``, from tail quantiles of the sketches.

    The upper limit is q90 + REACH * (q90 - q50) + TOLERANCE, the lower one q10 - REACH * (q50 - q10) - TOLERANCE; for
    features in POSITIVE the upper one is at least that quantile of the values above zero. A (language, source) with
    fewer than ``least_rows`` documents, or with a median and a tail of zeros and fewer than LEAST_POSITIVE values above it, takes the
    merged sketch of its language, and if that says too little too, of all documents. Null is a language and a source of
    its own.
    """
    fine = quantile_sketches(rows.select(F.col(lang_col).alias("lang"), F.col(source_col).alias("source"), *FEATURES), ["lang", "source"], FEATURES)
    points = {"q10": 0.1, "q50": 0.5, "q90": 0.9}
    by_lang = fine.groupBy("lang", "feature", "bin").agg(F.sum("n").alias("n"))
    overall = by_lang.groupBy("feature", "bin").agg(F.sum("n").alias("n"))
    grant = F.create_map(*[F.lit(x) for f in FEATURES for x in (f, TOLERANCE[f])])
    unknown = F.create_map(*[F.lit(x) for f in UNKNOWN for x in (f, UNKNOWN[f])])

    def limit(sketch: DataFrame, keys: list[str], tag: str) -> DataFrame:
        q = sketch_quantiles(sketch, keys, points, POSITIVE)
        usual = F.when((F.col("q90") > 0) | (F.col("positives") >= LEAST_POSITIVE), F.col("some")).otherwise(unknown[F.col("feature")])
        top = F.greatest(F.col("q90") + (F.col("q90") - F.col("q50")) * REACH + grant[F.col("feature")], usual)
        tells = (F.col("rows") >= least_rows) & (~F.col("feature").isin(*POSITIVE) | (F.col("q90") > 0) | (F.col("positives") >= LEAST_POSITIVE))
        low = F.col("q10") - (F.col("q50") - F.col("q10")) * REACH - grant[F.col("feature")]
        named = [F.col(k).alias(f"{tag}_{k}") for k in keys]
        return q.select(*named, F.col("feature").alias(f"{tag}_feature"), tells.alias(f"{tag}_tells"), F.struct(top.alias("top"), low.alias("low")).alias(f"{tag}_max"))

    own, lang, all_ = limit(fine, ["lang", "source"], "s"), limit(by_lang, ["lang"], "l"), limit(overall, [], "a")
    chosen = (
        own.join(lang, F.col("s_lang").eqNullSafe(F.col("l_lang")) & (F.col("s_feature") == F.col("l_feature")))
        .join(all_, F.col("s_feature") == F.col("a_feature"))
        .withColumn("limits", F.when(F.col("s_tells"), F.col("s_max")).when(F.col("l_tells"), F.col("l_max")).otherwise(F.col("a_max")))
    )
    return chosen.groupBy(F.col("s_lang").alias("lang"), F.col("s_source").alias("source")).agg(
        *[F.max(F.when(F.col("s_feature") == f, F.col("limits.top"))).alias(f"max_{f}") for f in FEATURES],
        *[F.max(F.when(F.col("s_feature") == f, F.col("limits.low"))).alias(f"min_{f}") for f in TWO_SIDED],
    )


def quality_rules(spark: SparkSession, df: DataFrame, *, id_col="doc_id", text_col="text", lang_col="lang", source_col="source", least_words: int = 50, most_repeat_percent: int = 50, least_rows: int = LEAST_ROWS) -> DataFrame:
    """One row per input row: the id, the features, ``base_failed``, the features' thresholds and ``kept``.

    ``base_failed``: fewer than ``least_words`` words, or more than ``most_repeat_percent`` percent of the words lie in
    repeated three-word windows. ``kept``: not base_failed and no feature beyond its (language, source) thresholds.
    Thresholds come from the documents that pass the base rules, as the others would widen them. Null or empty texts
    have zeros and fail the base rules; null languages and sources are groups of their own; equal rows give equal rows;
    an empty table gives an empty result; a very long text
    is read in one task, its windows as one array. Other columns are not looked at, whatever their names.
    """
    stage = Stage(spark, "quality")
    rows = text_features(df.select(F.col(id_col).alias(id_col), F.col(text_col).alias("_q_text"), F.col(lang_col).alias("lang"), F.col(source_col).alias("source")), text_col="_q_text").drop("_q_text")
    rows = rows.withColumn("base_failed", (F.col("n_words") < least_words) | (F.col("n_repeat_words") * 100 > F.col("n_words") * most_repeat_percent))
    rows = stage.save(rows.withColumns(_ratios(rows)))
    limits = adaptive_thresholds(rows.where(~F.col("base_failed")), least_rows=least_rows)
    limits = limits.withColumnsRenamed({"lang": "_q_lang", "source": "_q_source"})
    joined = rows.join(limits, F.col("lang").eqNullSafe(F.col("_q_lang")) & F.col("source").eqNullSafe(F.col("_q_source")), "left")
    over = F.lit(False)
    for f in FEATURES:
        over = over | F.coalesce(F.col(f) > F.col(f"max_{f}"), F.lit(False))
    for f in TWO_SIDED:
        over = over | F.coalesce(F.col(f) < F.col(f"min_{f}"), F.lit(False))
    return joined.withColumn("kept", ~F.col("base_failed") & ~over).drop("_q_lang", "_q_source")
