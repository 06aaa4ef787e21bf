"""Operator 12: how far the word use of sources lies apart, by row accumulation over a term-major index."""

from __future__ import annotations

from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .store import Stage

#: Every byte that belongs to no term becomes a space; A to Z become small. Bytes from 128 on are parts of letters.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
#: Bytes of a text that are cut into terms at a time, and terms that a task holds before it hands them on.
PIECE, HELD = 1 << 20, 400_000
#: Postings of a block of the index, and groups whose rows one task accumulates.
POSTINGS, SLAB = 1 << 18, 1 << 10
#: Cells of an intermediate array.
CELLS = 1 << 22


def _pieces(text: bytes):
    """The text in pieces that end between terms."""
    text = text.translate(FOLD)
    at = 0
    while at < len(text):
        end = text.find(b" ", at + PIECE)
        end = len(text) if end < 0 else end
        yield text[at:end]
        at = end


def _batches(counts: dict, docs: dict, met: Counter):
    """A row for each group and term: occurrences and documents; and one for each group with a null term."""
    rows = [(*group, None, 0, n) for group, n in met.items()]
    for group, of in counts.items():
        seen = docs[group]
        for term, n in of.items():
            rows.append((*group, term, n, seen[term]))
            if len(rows) >= 1 << 15:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), KINDS, strict=True)], names=NAMES)
                rows = []
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), KINDS, strict=True)], names=NAMES)


NAMES, KINDS = ["lang", "source", "term", "n", "docs"], [pa.string(), pa.string(), pa.binary(), pa.int64(), pa.int64()]


def _counted(batches):
    counts, docs, met, held = defaultdict(Counter), defaultdict(Counter), Counter(), 0
    for batch in batches:
        langs, sources, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).cast(pa.binary())
        for i, group in enumerate(zip(langs, sources, strict=True)):
            met[group] += 1
            own, seen = counts[group], set()
            held -= len(own)
            for piece in _pieces(texts[i].as_py()):
                terms = piece.split()
                own.update(terms)
                seen.update(terms)
            docs[group].update(seen)
            held += len(own)
            if held > HELD:
                yield from _batches(counts, docs, met)
                counts, docs, met, held = defaultdict(Counter), defaultdict(Counter), Counter(), 0
    yield from _batches(counts, docs, met)


def rate(count: Column, total: Column, kinds: Column) -> Column:
    """1 + floor(10^9 (count + 2) / (total + 2 kinds)), exact; null if there are no kinds."""
    above = (count + 2).cast("decimal(28,0)") * F.lit(10**9).cast("decimal(10,0)")
    return F.when(kinds > 0, F.call_function("div", above, (total + 2 * kinds).cast("decimal(20,0)")) + 1)


def apart(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / (p + q))"""
    return F.call_function("div", (p - q) * (p - q), p + q)


def _apart(p, q):
    return (p - q) ** 2 // (p + q)


def accumulate(term: np.ndarray, group: np.ndarray, p: np.ndarray, zero: np.ndarray, rows: np.ndarray):
    """Yields (group, dense array by peer) for each of ``rows``; ``zero`` has each group's value of an absent term.

    The postings, sorted by term and group, are the index. A row holds what its terms are apart from each peer's zero.
    Then every term of the row is looked up in the index: at the peers after it that have the term too, the two zero
    baselines are taken back and the true distance is put in.
    """
    order = np.lexsort((group, term))
    term, group, p = term[order], group[order], p[order]
    stop = np.searchsorted(term, term, "right")
    by_group = np.argsort(group, kind="stable")
    cuts = np.searchsorted(group[by_group], np.arange(len(zero) + 1))
    for g in rows:
        own = by_group[cuts[g] : cuts[g + 1]]
        row = np.zeros(len(zero), np.int64)
        values, times = np.unique(p[own], return_counts=True)
        step = max(1, CELLS // max(1, len(zero)))
        for k in range(0, len(values), step):
            row += (_apart(values[k : k + step, None], zero[None, :]) * times[k : k + step, None]).sum(axis=0)
        length = stop[own] - own - 1
        ends = np.cumsum(length)
        at = 0
        while at < len(own):
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + CELLS, "right")))
            n = length[at:to]
            peers = np.repeat(own[at:to] + 1 - (np.cumsum(n) - n), n) + np.arange(n.sum())
            h, mine, theirs = group[peers], np.repeat(p[own[at:to]], n), p[peers]
            np.add.at(row, h, _apart(mine, theirs) - _apart(mine, zero[h]) - _apart(zero[g], theirs) + _apart(zero[g], zero[h]))
            at = to
        row[g] = 0
        yield g, row


def _met(postings: pa.Table, peers: pa.Table) -> pa.Table:
    """One block of terms, one slab of rows: what each row has gathered at each peer."""
    kinds = pa.schema([("lang", pa.string()), ("lo", pa.int32()), ("hi", pa.int32()), ("v", pa.int64())])
    if not postings.num_rows:
        return kinds.empty_table()
    zero, slab = peers.sort_by("peer")["zero"].to_numpy(), postings["slab"][0].as_py()
    term = postings["term"].combine_chunks().dictionary_encode().indices.to_numpy()
    group = postings["i"].to_numpy().astype(np.int64)
    rows = np.unique(group[group // SLAB == slab])
    every = np.arange(len(zero))
    made = [(np.minimum(g, every), np.maximum(g, every), row) for g, row in accumulate(term, group, postings["p"].to_numpy(), zero, rows)]
    if not made:
        return kinds.empty_table()
    lo, hi, v = (np.concatenate([m[k] for m in made]) for k in range(3))
    some = v != 0
    lang = pa.repeat(postings["lang"][0], int(some.sum()))
    return pa.Table.from_arrays([lang, pa.array(lo[some], pa.int32()), pa.array(hi[some], pa.int32()), pa.array(v[some])], schema=kinds)


def source_divergence(spark: SparkSession, docs: DataFrame, *, lang_col="lang", source_col="source", text_col="text", least_docs: int = 10, top: int = 10) -> DataFrame:
    """Rows ``lang, source, part, item, value, rank``: distances of all pairs of sources of a language, and top terms.

    A null language, source or text is read as empty. Terms are letters' runs, A to Z lower-cased; a language keeps
    those in at least ``least_docs`` of its documents. Part ``pair`` sums over the kept terms how far the rates of two
    sources lie apart, and has all other sources of the language by rank; part ``term`` has the ``top`` terms that
    are more frequent in the source than in its language. All integers are exact. Ties go by UTF-8 order of the item.

    Repeated rows count as often as they are there. A source without terms, or a language without kept ones, has its
    pairs all the same. An empty table gives no rows. Texts of any length are counted in pieces. Other columns are not
    looked at.

    A task counts its texts by source before anything is shuffled. The kept terms are postings, cut by a hash of the
    term into blocks of about POSTINGS; a block's task accumulates the rows of at most SLAB sources, and emits sums by
    pair of sources, never pairs of postings. So a language or source of any share is spread over blocks. The result has
    all pairs of sources of a language, as asked, so it grows with their square.
    """
    stage = Stage(spark, "divergence")
    given = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for n, c in (("lang", lang_col), ("source", source_col), ("text", text_col))))
    counts = given.mapInArrow(_counted, "lang string, source string, term binary, n long, docs long")
    counts = stage.save(counts.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")))
    words = counts.where("term IS NOT NULL")
    kept = words.groupBy("lang", "term").agg(F.sum("n").alias("lang_n"), F.sum("docs").alias("lang_docs"), F.count("*").alias("places")).where(F.col("lang_docs") >= least_docs)
    kept = stage.save(kept.drop("lang_docs"))
    postings = stage.save(words.select("lang", "source", "term", "n").join(kept.select("lang", "term", "lang_n"), ["lang", "term"]))

    langs = kept.groupBy("lang").agg(F.count("*").alias("v"), F.sum("lang_n").alias("lang_total"), F.sum("places").alias("places"))
    totals = postings.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count("*").alias("k"))
    groups = counts.where("term IS NULL").select("lang", "source").join(totals, ["lang", "source"], "left").join(langs, "lang", "left")
    groups = groups.fillna(0, ["total", "k", "v", "lang_total", "places"])
    groups = groups.withColumn("p0", rate(F.lit(0).cast("long"), F.col("total"), F.col("v"))).withColumn("i", F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1)
    groups = groups.withColumn("blocks", F.greatest(F.lit(1), F.ceil(F.col("places") / POSTINGS)).cast("int"))
    groups = stage.save(groups)

    rated = postings.join(groups.drop("k", "places"), ["lang", "source"]).withColumn("p", rate(F.col("n"), F.col("total"), F.col("v")))
    return _pairs(rated, groups).unionByName(_terms(rated, top))


def _terms(rated: DataFrame, top: int) -> DataFrame:
    q = rate(F.col("lang_n"), F.col("lang_total"), F.col("v"))
    own = rated.withColumn("q", q).where("p > q").select("lang", "source", "term", apart(F.col("p"), F.col("q")).alias("value"))
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "term"))
    return own.withColumn("rank", rank).where(F.col("rank") <= top).select("lang", "source", F.lit("term").alias("part"), F.col("term").cast("string").alias("item"), "value", "rank")


def _pairs(rated: DataFrame, groups: DataFrame) -> DataFrame:
    block = F.pmod(F.xxhash64("term"), F.col("blocks")).cast("int")
    # a slab of rows needs the postings of its own groups and of those after it
    index = rated.select("lang", "term", "i", "p", block.alias("block"), F.explode(F.sequence(F.lit(0), F.floor(F.col("i") / SLAB).cast("int"))).alias("slab"))
    slabs = F.floor(F.count("*").over(Window.partitionBy("lang")) / SLAB).cast("int")
    peers = groups.where("v > 0").select(F.col("lang").alias("of"), F.col("i").alias("peer"), F.col("p0").alias("zero"), "blocks", slabs.alias("slabs"))
    peers = peers.select("of", "peer", "zero", "slabs", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("met_block"))
    peers = peers.select("of", "peer", "zero", "met_block", F.explode(F.sequence(F.lit(0), F.col("slabs"))).alias("met_slab"))
    met = index.groupBy("lang", "block", "slab").cogroup(peers.groupBy("of", "met_block", "met_slab")).applyInArrow(_met, "lang string, lo int, hi int, v long")
    sums = met.groupBy("lang", "lo", "hi").agg(F.sum("v").alias("sum"))

    left, right = (groups.select("lang", "v", *(F.col(c).alias(f"{side}_{c}") for c in ("source", "i", "k", "p0"))) for side in "ab")
    pairs = left.join(right.drop("v"), "lang").where("a_i < b_i")
    pairs = pairs.join(sums, (pairs.lang == sums.lang) & (F.col("a_i") == F.col("lo")) & (F.col("b_i") == F.col("hi")), "left").drop(sums.lang)
    absent = (F.col("v") - F.col("a_k") - F.col("b_k")) * apart(F.col("a_p0"), F.col("b_p0"))
    value = F.when(F.col("v") > 0, F.coalesce(F.col("sum"), F.lit(0)) + absent).otherwise(0).cast("long")
    ways = F.array(F.struct(F.col("a_source").alias("source"), F.col("b_source").alias("item")), F.struct(F.col("b_source").alias("source"), F.col("a_source").alias("item")))
    both = pairs.select("lang", value.alias("value"), F.inline(ways))
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    return both.select("lang", "source", F.lit("pair").alias("part"), "item", "value", rank.alias("rank"))
