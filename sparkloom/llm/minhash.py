"""Operator 2: near-duplicates by b-bit MinHash with band candidates and exact confirmation."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .components import connected_components, forest
from .shingles import mix, shingle_sets
from .store import Stage, release_shuffles

BANDS, ROWS = 24, 4
HASHES = BANDS * ROWS
#: Low bits kept of each minimum; 16 of them make one 64-bit word of the packed signature.
BITS = 4
WORDS = HASHES * BITS // 64
#: Standard errors of the estimate below the threshold at which a candidate is still confirmed exactly.
MARGIN = 5.0
#: Rounds in which each bucket that still spans several components tries another pivot.
ROUNDS = 3
#: Members of a family that meet in one task, from each of two blocks, where no pivot settles it.
BLOCK = 256
#: Bytes of a text for each of its shingles, about.
WORD_BYTES = 8
#: Members that are confirmed against one copy of a pivot's text.
PER_PIVOT = 64

_RNG = np.random.default_rng(2)
_A = _RNG.integers(0, 1 << 32, HASHES, dtype=np.uint32) | np.uint32(1)
_B = _RNG.integers(0, 1 << 32, HASHES, dtype=np.uint32)
_SIGNATURE = [f"s{i}" for i in range(WORDS)]
_SET = ["set_a", "set_b"]


def minima(hashes: np.ndarray) -> np.ndarray:
    """The HASHES minima of a shingle set under random permutations of 32 bits."""
    low = (hashes >> np.uint64(32)).astype(np.uint32)
    out = np.full(HASHES, 0xFFFFFFFF, np.uint32)
    for i in range(0, len(low), 2048):
        np.minimum(out, (low[i : i + 2048, None] * _A + _B).min(axis=0), out=out)
    return out


def pack(signature: np.ndarray) -> np.ndarray:
    """The low bits of the minima, packed in 64-bit words."""
    low = (signature & np.uint32((1 << BITS) - 1)).astype(np.uint64).reshape(WORDS, -1)
    return np.bitwise_or.reduce(low << (np.arange(64 // BITS, dtype=np.uint64) * np.uint64(BITS)), axis=1)


def _sign(batches, shingle: int):
    odd = mix(np.arange(7, 7 + HASHES, dtype=np.uint64)) | np.uint64(1)
    bands_of = np.arange(BANDS, dtype=np.uint64)
    names = ["id", "text_key", "n_shingles", *_SET, *_SIGNATURE, "bands"]
    for batch in batches:
        n_rows = batch.num_rows
        sizes, whole = np.zeros(n_rows, np.int64), np.zeros((n_rows, 2), np.int64)
        packed, bands = np.zeros((n_rows, WORDS), np.uint64), np.zeros((n_rows, BANDS), np.uint64)
        texts = batch.column(2).cast(pa.binary()).to_pylist()
        for i, hashes in enumerate(shingle_sets(texts, shingle)):
            sizes[i] = len(hashes)
            if len(hashes):
                whole[i] = np.frombuffer(hashlib.blake2b(hashes.tobytes(), digest_size=16).digest(), np.int64)
                least = minima(hashes)
                packed[i] = pack(least)
                bands[i] = (least.astype(np.uint64) * odd).reshape(BANDS, ROWS).sum(axis=1)
        bands = mix(bands + bands_of * np.uint64(0x9E3779B97F4A7C15))
        flat = pa.array(bands.view(np.int64).ravel())
        offsets = pa.array(np.arange(0, (n_rows + 1) * BANDS, BANDS, dtype=np.int32))
        columns = [
            batch.column(0),
            batch.column(1),
            pa.array(sizes),
            *[pa.array(whole[:, k].copy(), mask=sizes == 0) for k in (0, 1)],
            *[pa.array(packed[:, j].copy().view(np.int64)) for j in range(WORDS)],
            pa.ListArray.from_arrays(offsets, flat),
        ]
        yield pa.RecordBatch.from_arrays(columns, names=names)


def signatures(df: DataFrame, id_col: str, text_col: str, shingle: int) -> DataFrame:
    """``id, text_key, n_shingles, set_a, set_b, s0.., bands``: a hash of 128 bits of the whole set, null if empty."""
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("text_key"), F.col(text_col).cast("string").alias("text"))
    schema = "id long, text_key long, n_shingles long, set_a long, set_b long, " + "".join(f"{s} long, " for s in _SIGNATURE) + "bands array<long>"
    return rows.mapInArrow(lambda batches: _sign(batches, shingle), schema)


def estimate(left: str, right: str) -> Column:
    """Similarity from packed signatures: the share of equal b-bit groups, less what equals by chance."""
    unequal = F.lit(0)
    ones = sum(1 << (BITS * i) for i in range(64 // BITS))
    ones -= (1 << 64) * (ones >> 63)
    for s in _SIGNATURE:
        x = F.col(f"{left}.{s}").bitwiseXOR(F.col(f"{right}.{s}"))
        for shift in (1, 2):
            x = x.bitwiseOR(F.shiftrightunsigned(x, shift))
        unequal = unequal + F.bit_count(x.bitwiseAND(F.lit(ones)))
    chance = 1 / (1 << BITS)
    return (1 - unequal / F.lit(HASHES) - chance) / (1 - chance)


def _plausible(left: str, right: str, percent: int) -> Column:
    """Whether two sets can reach the threshold: by their sizes (exact), and by the estimate with its margin."""
    j = percent / 100
    p = j + (1 - j) / (1 << BITS)
    error = (p * (1 - p) / HASHES) ** 0.5 / (1 - 1 / (1 << BITS))
    a, b = F.col(f"{left}.n_shingles"), F.col(f"{right}.n_shingles")
    return (F.least(a, b) * 100 >= F.greatest(a, b) * percent) & (estimate(left, right) >= j - MARGIN * error)


def _confirm(batches, shingle: int, percent: int):
    """Rows ``pivot, part, role, node, text`` sorted by the first three: links of the pivot (role 0) with the others."""
    key = pivot = None
    for batch in batches:
        out_a, out_b = [], []
        keys = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))
        roles, nodes = batch.column(2).to_pylist(), batch.column(3).to_pylist()
        texts = batch.column(4).cast(pa.binary()).to_pylist()
        for own, role, node, hashes in zip(keys, roles, nodes, shingle_sets(texts, shingle), strict=True):
            if role == 0:
                key, pivot = own, hashes
                continue
            assert key == own, "a pivot's row comes before its members'"
            both = len(pivot) + len(hashes) - len(np.union1d(pivot, hashes))
            if 100 * both >= percent * (len(pivot) + len(hashes) - both):
                out_a.append(own[0])
                out_b.append(node)
        yield pa.RecordBatch.from_arrays([pa.array(out_a, pa.int64()), pa.array(out_b, pa.int64())], names=["a", "b"])


def confirm_pairs(pairs: DataFrame, texts: DataFrame, shingle: int, percent: int) -> DataFrame:
    """The pairs ``a, b`` of nodes whose full shingle sets reach the threshold; ``texts`` has ``node, text``.

    Members are dealt to (pivot, part) groups of about PER_PIVOT with one copy of the pivot's text each, so a pivot of
    thousands is spread, and texts are taken only for rows that a pair names.
    """
    parts = pairs.groupBy("a").agg(F.ceil(F.count("*") / PER_PIVOT).cast("int").alias("parts"))
    members = pairs.join(parts, "a").select(
        F.col("a").alias("pivot"), F.pmod(F.xxhash64("b"), F.col("parts")).cast("int").alias("part"), F.lit(1).alias("role"), F.col("b").alias("node")
    )
    pivots = parts.select(
        F.col("a").alias("pivot"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(0).alias("role"), F.col("a").alias("node")
    )
    rows = members.unionByName(pivots).join(texts, "node").select("pivot", "part", "role", "node", "text")
    dealt = rows.repartition("pivot", "part").sortWithinPartitions("pivot", "part", "role")
    return dealt.mapInArrow(lambda batches: _confirm(batches, shingle, percent), "a long, b long").distinct()


def _texts_of(stage: Stage, df: DataFrame, signed: DataFrame, wanted: DataFrame, id_col: str, text_col: str, size: int) -> DataFrame:
    """``node, text`` of the nodes ``node, id, text_key``, one row each, dealt by node so that later joins don't move them."""
    again = stage.save(signed.groupBy("id", "text_key").count().where("count > 1").select(F.col("id").alias("i"), F.col("text_key").alias("k")))
    same = F.col("w.id").eqNullSafe(F.col("t.id")) & (F.col("w.text_key") == F.col("t.text_key"))
    texts = df.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("text_key"), F.col(text_col).cast("string").alias("text"))
    known = F.col("id").eqNullSafe(F.col("i")) & (F.col("text_key") == F.col("k"))
    once, several = wanted.join(again, known, "left_anti"), wanted.join(again, known, "left_semi")
    rows = once.alias("w").join(texts.alias("t"), same).select("node", "text")
    more = several.alias("w").join(texts.alias("t"), same).select("node", "text").dropDuplicates(["node"])
    return stage.save_dealt(rows.unionByName(more), ["node"], size)


def _relabel(stage: Stage, labels: DataFrame, links: DataFrame) -> DataFrame:
    """``node, component`` after the links ``a, b`` joined some of the components."""
    for side in ("a", "b"):
        links = links.join(labels.select(F.col("node").alias(side), F.col("component").alias(f"c{side}")), side)
    bridges = links.select(F.col("ca").alias("a"), F.col("cb").alias("b")).where("a <> b")
    merged = connected_components(stage, bridges).select(F.col("node").alias("component"), F.col("component").alias("final"))
    return stage.save(labels.join(merged, "component", "left").select("node", F.coalesce("final", "component").alias("component")))


def _open(stage: Stage, shared: DataFrame, labels: DataFrame) -> DataFrame:
    """``bucket, node, component`` of the buckets that span several components."""
    labelled = shared.select("bucket", "node").join(labels, "node")
    several = labelled.groupBy("bucket").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high").select("bucket")
    return stage.save(labelled.join(several, "bucket").select("bucket", "node", "component"))


def near_duplicates(spark: SparkSession, df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, percent: int = 80) -> DataFrame:
    """``id_col, text_key, n_shingles, component_id, kept`` for every row of ``df``.

    Two documents link if 100 * intersection >= percent * union of their sets of ``shingle``-word shingles (ASCII
    lower case). Documents with equal sets (by a hash of 128 bits) form a class, one node. Nodes that agree in a band of
    minima are candidates. In each of up to ROUNDS rounds every bucket that spans several components tries one of its
    nodes, the pivot, with all others of other components, so most of a dense family of any size settles. What is left
    is searched in full: the nodes of the first pivots' families that are in a bucket of several components meet in
    blocks. Candidates whose b-bit estimate is within reach are confirmed on full sets; the last step gives out spanning
    forests, not pairs.
    ``component_id`` is the smallest id reachable by links, ``kept`` whether the row has it. Texts that are null or
    without words have no shingles and only reach themselves. Rows with equal ids are rows of their own; equal rows get
    equal results; a null id counts only where its component has no other. An empty table gives an empty result; very
    long texts are read in one task each, their sets never meet in the driver. Other columns are not looked at.
    """
    stage = Stage(spark, "minhash")
    signed = stage.save(signatures(df, id_col, text_col, shingle))
    classes = signed.where("set_a is not null").groupBy(*_SET).agg(
        F.min(F.struct("id", "text_key")).alias("rep"),
        F.min("id").alias("least_id"),
        *[F.first(c).alias(c) for c in ("n_shingles", *_SIGNATURE, "bands")],
    )
    classes = stage.save(classes.withColumn("node", F.monotonically_increasing_id()))
    sketch = classes.select("node", "n_shingles", *_SIGNATURE)
    entries = classes.select(F.explode("bands").alias("bucket"), "node")
    several = entries.groupBy("bucket").count().where("count > 1").select("bucket")
    shared = stage.save(entries.join(several, "bucket"))
    wanted = classes.select("node", F.col("rep.id").alias("id"), F.col("rep.text_key").alias("text_key")).join(shared.select("node").distinct(), "node")
    words = classes.agg(F.sum("n_shingles")).first()[0] or 0
    texts = _texts_of(stage, df, signed, wanted, id_col, text_col, words * WORD_BYTES)
    release_shuffles(spark)
    labels = classes.select("node", F.col("node").alias("component"))
    left, first = shared.withColumn("component", F.col("node")), None
    for i in range(ROUNDS):
        pivots = left.groupBy("bucket").agg(F.min(F.struct(F.xxhash64("node", F.lit(i)), "node", "component")).alias("p"))
        stars = left.join(pivots, "bucket").where("component <> p.component").select(F.col("p.node").alias("a"), F.col("node").alias("b")).distinct()
        stars = stage.save(stars)
        first = stars if first is None else first
        links = stage.save(confirm_pairs(stage.save(_within_reach(stars, sketch, percent)), texts, shingle, percent))
        labels = _relabel(stage, labels, links)
        left = _open(stage, left, labels)
        if left.isEmpty():
            break
    else:
        labels = _relabel(stage, labels, _rest(stage, first, left, labels, sketch, texts, shingle, percent))
    smallest = classes.select("node", "least_id").join(labels, "node").groupBy("component").agg(F.min("least_id").alias("component_id"))
    of_set = classes.select("node", *_SET).join(labels, "node").join(smallest, "component").select(*_SET, "component_id")
    of_set = stage.save(of_set)
    stage.drop(texts)
    out = signed.select("id", "text_key", "n_shingles", *_SET).join(of_set, _SET, "left")
    component = F.when(F.col("set_a").isNull(), F.col("id")).otherwise(F.col("component_id"))
    return out.select(
        F.col("id").alias(id_col), "text_key", "n_shingles", component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept")
    )


def _rest(stage: Stage, stars: DataFrame, left: DataFrame, labels: DataFrame, sketch: DataFrame, texts: DataFrame, shingle: int, percent: int) -> DataFrame:
    """Links ``a, b`` that span those between the components of each first pivot's family (the nodes of its buckets).

    Only nodes of buckets that still span several components take part.
    """
    open_ = left.select("node").distinct()
    members = stars.select(F.col("a").alias("pivot"), F.col("b").alias("node")).unionByName(stars.select(F.col("a").alias("pivot"), F.col("a").alias("node")).distinct())
    of_pivot = labels.select(F.col("node").alias("pivot"), F.col("component").alias("most"))
    family = members.join(open_, "node", "left_semi").join(labels, "node").join(of_pivot, "pivot").select(
        "pivot", "node", "component", (F.col("component") == F.col("most")).alias("near")
    )
    family = stage.save(family)
    sketched = _deal(family, "node").join(sketch, "node").select("pivot", "x", "y", "side", "node", "component", "n_shingles", *_SIGNATURE)
    sketched = sketched.repartition("pivot", "x", "y").sortWithinPartitions("pivot", "x", "y")
    hopeful = sketched.mapInArrow(lambda batches: _hopeful(batches, percent), "pivot long, node long").distinct()
    hopeful = stage.save(family.join(hopeful, ["pivot", "node"]))
    worded = _deal(hopeful, "node").join(texts, "node").select("pivot", "x", "y", "side", "node", "component", "text")
    worded = worded.repartition("pivot", "x", "y").sortWithinPartitions("pivot", "x", "y")
    return stage.save(worded.mapInArrow(lambda batches: _confirm_blocks(batches, shingle, percent), "a long, b long").distinct())


def _deal(family: DataFrame, node: str) -> DataFrame:
    """Members of families dealt to pairs of blocks ``x <= y`` of about BLOCK members, ``side`` 1 for those of y alone.

    Near members share one component and need not meet each other, so at least one block of a pair holds members that
    are not. A family of m members with few of these costs about m rows.
    """
    sizes = family.groupBy("pivot").agg(
        F.count(F.when(F.col("near"), 1)).alias("n_near"), F.count(F.when(~F.col("near"), 1)).alias("n_far")
    ).where("n_far > 1 or (n_far > 0 and n_near > 0)")
    rows = family.join(sizes, "pivot").withColumn("b_near", F.ceil(F.col("n_near") / BLOCK)).withColumn("b_far", F.ceil(F.col("n_far") / BLOCK))
    draw = F.xxhash64(node)
    own = F.when(F.col("near"), F.pmod(draw, F.col("b_near"))).otherwise(F.col("b_near") + F.pmod(draw, F.col("b_far")))
    first = F.when(F.col("near"), F.col("b_near")).otherwise(F.lit(0).cast("long"))
    rows = rows.withColumn("own", own).withColumn("with", F.explode(F.sequence(first, F.col("b_near") + F.col("b_far") - 1)))
    return rows.select(
        "pivot", node, "component", F.least("own", "with").alias("x"), F.greatest("own", "with").alias("y"), (F.col("own") > F.col("with")).alias("side")
    )


def _groups(batches):
    """Arrow tables of whole (pivot, x, y) groups, from batches sorted by them."""
    held: list = []
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([*held, batch]).combine_chunks()
        keys = [table.column(k).to_numpy() for k in range(3)]
        new = np.ones(table.num_rows, bool)
        new[1:] = (keys[0][1:] != keys[0][:-1]) | (keys[1][1:] != keys[1][:-1]) | (keys[2][1:] != keys[2][:-1])
        starts = np.flatnonzero(new)
        for a, b in zip(starts[:-1], starts[1:], strict=True):
            yield table.slice(a, b - a)
        held = table.slice(starts[-1]).to_batches()
    if held:
        yield pa.Table.from_batches(held)


def _sides(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers of both blocks of a pair (the same rows twice if it is one block)."""
    if table.column(1)[0].as_py() == table.column(2)[0].as_py():
        rows = np.arange(table.num_rows)
        return rows, rows
    side = table.column(3).to_numpy().astype(bool)
    return np.flatnonzero(~side), np.flatnonzero(side)


def _hopeful(batches, percent: int):
    """Members with a partner of another component that the packed signatures do not rule out."""
    j = percent / 100
    p = j + (1 - j) / (1 << BITS)
    error = (p * (1 - p) / HASHES) ** 0.5 / (1 - 1 / (1 << BITS))
    chance = 1 / (1 << BITS)
    most_unequal = (1 - (j - MARGIN * error) * (1 - chance) - chance) * HASHES
    ones = np.uint64(sum(1 << (BITS * i) for i in range(64 // BITS)))
    out_pivot, out_node = [], []
    for table in _groups(batches):
        left, right = _sides(table)
        node, component, size = (table.column(k).to_numpy() for k in (4, 5, 6))
        words = np.stack([table.column(7 + k).to_numpy().view(np.uint64) for k in range(WORDS)], axis=1)
        unequal = np.zeros((len(left), len(right)), np.int64)
        for k in range(WORDS):
            x = words[left, None, k] ^ words[None, right, k]
            x |= x >> np.uint64(1)
            x |= x >> np.uint64(2)
            unequal += np.bitwise_count(x & ones)
        low, high = np.minimum.outer(size[left], size[right]), np.maximum.outer(size[left], size[right])
        ok = (unequal <= most_unequal) & (low * 100 >= high * percent) & (component[left][:, None] != component[right][None, :])
        some = np.unique(np.concatenate([left[ok.any(axis=1)], right[ok.any(axis=0)]]))
        if len(some):
            out_pivot.append(np.full(len(some), table.column(0)[0].as_py()))
            out_node.append(node[some])
        if len(out_node) >= 2000:
            yield _two(out_pivot, out_node, "pivot", "node")
            out_pivot, out_node = [], []
    yield _two(out_pivot, out_node, "pivot", "node")


def _two(a: list, b: list, name_a: str, name_b: str) -> pa.RecordBatch:
    arrays = [pa.array(np.concatenate(x) if x else np.zeros(0, np.int64), pa.int64()) for x in (a, b)]
    return pa.RecordBatch.from_arrays(arrays, names=[name_a, name_b])


def _confirm_blocks(batches, shingle: int, percent: int):
    """A forest that spans the links between two blocks' members of different components, from their full sets."""
    out_a, out_b = [], []
    for table in _groups(batches):
        node, at = np.unique(table.column(4).to_numpy(), return_index=True)
        left, right = (x[np.isin(x, at)] for x in _sides(table))
        component = table.column(5).to_numpy()
        sets = list(shingle_sets(table.column(6).cast(pa.binary()).to_pylist(), shingle))
        size = np.array([len(x) for x in sets])
        element, index, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        owner = np.repeat(np.arange(len(sets)), size)
        common = count[index] > 1
        column, owner = (np.cumsum(count > 1) - 1)[index[common]], owner[common]
        both = np.zeros((len(sets), len(sets)), np.float32)
        n = int((count > 1).sum())
        order = np.argsort(column, kind="stable")
        column, owner = column[order], owner[order]
        for a in range(0, n, 8192):
            lo, hi = np.searchsorted(column, [a, a + 8192])
            has = np.zeros((len(sets), min(8192, n - a)), np.float32)
            has[owner[lo:hi], column[lo:hi] - a] = 1
            both += has @ has.T
        inter = both[np.ix_(left, right)].astype(np.int64)
        union = size[left][:, None] + size[right][None, :] - inter
        ok = (100 * inter >= percent * union) & (component[left][:, None] != component[right][None, :])
        i, j = np.nonzero(ok)
        if len(i):
            root = forest(len(sets), left[i], right[j])
            some = np.flatnonzero(root != np.arange(len(sets)))
            all_nodes = table.column(4).to_numpy()
            out_a.append(all_nodes[some])
            out_b.append(all_nodes[root[some]])
    yield _two(out_a, out_b, "a", "b")


def _within_reach(pairs: DataFrame, sketch: DataFrame, percent: int) -> DataFrame:
    joined = pairs.join(sketch.alias("x"), F.col("a") == F.col("x.node")).join(sketch.alias("y"), F.col("b") == F.col("y.node"))
    return joined.where(_plausible("x", "y", percent)).select("a", "b")


def without_near_duplicates(spark: SparkSession, df: DataFrame, **how) -> DataFrame:
    """``df`` with one document of each group of near-duplicates: that with the smallest id.

    Texts without words, null ones too, are in no group and stay; equal rows with that id all stay; a null id stays
    where its group has no other. Columns keep their names and order, whatever they are. An empty table stays empty.
    """
    id_col, text_col = how.get("id_col", "doc_id"), how.get("text_col", "text")
    kept = near_duplicates(spark, df, **how).where("kept").select(F.col(id_col).alias("_mh_id"), F.col("text_key").alias("_mh_key")).distinct().alias("k")
    same = F.col(f"d.{id_col}").eqNullSafe(F.col("k._mh_id")) & (F.xxhash64(f"d.{text_col}") == F.col("k._mh_key"))
    return df.alias("d").join(kept, same, "left_semi")
