import zlib
from collections import defaultdict

import brute
import pytest
from conftest import EDGES, passage  # noqa: F401  (this folder's)

from sparkloom.llm import lines, minhash, mixing, packing, quality, queries, repeats, sharding

PAIRS = [(r[0], r[1]) for r in EDGES]


def test_quality_rules_on_edges(spark, edges, nothing):
    out = {r.doc_id: r for r in quality.quality_rules(spark, edges).collect()}
    for i, t in PAIRS:
        x = out[i]
        assert brute.base_rules(t) == (x.n_words, x.word_chars, x.n_symbols, x.n_dup_lines, x.n_repeat_words, x.base_failed), i
        assert not (x.kept and x.base_failed)
    assert quality.quality_rules(spark, nothing).count() == 0


def test_quality_thresholds_reject_outliers(spark):
    def text(i):
        return " ".join(f"word{(i * 7 + k * k) % 9973}" for k in range(80 + i % 7))

    fine = [(i, text(i), "en", "s") for i in range(300)]
    odd = [(1000, text(3) + "".join(f" {k}####" for k in range(60)), "en", "s")]
    out = {r.doc_id: r.kept for r in quality.quality_rules(spark, spark.createDataFrame(fine + odd, "doc_id long, text string, lang string, source string"), least_rows=50).collect()}
    assert not out[1000] and all(out[i] for i in range(300))


def test_quality_limits_follow_the_tail(spark):
    """No limit is a fixed value: where the group's tail moves, its limit moves along."""

    def text(i, marks, lines):
        return " ".join(f"word{(i * 7 + k * k) % 9973}" for k in range(80)) + " #" * marks + "".join(f"\nline{k}" for k in range(20)) + "\nline0" * lines

    def limits(marks, lines):
        rows = [(i, text(i, marks * (i % 12 == 0) * (1 + i % 3), lines * (i % 15 == 0)), "en", "st"[i % 2]) for i in range(1200)]
        out = quality.quality_rules(spark, spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"))
        return {r.source: (r.max_symbol_ppm, r.max_dup_line_ppm, r.max_repeat_ppm) for r in out.select("doc_id", "source", "max_symbol_ppm", "max_dup_line_ppm", "max_repeat_ppm").collect()}

    low, high = limits(5, 2), limits(20, 8)
    assert set(low) == {"s", "t"}
    for group in low:
        for a, b in zip(low[group][:2], high[group][:2], strict=True):
            assert 0 < 2 * a < b
        assert not set(low[group][:2]) & {*quality.UNKNOWN.values(), *quality.TOLERANCE.values()}


@pytest.mark.parametrize("shingle, percent", [(3, 85), (5, 80)])
def test_near_duplicates_on_edges(spark, edges, nothing, shingle, percent):
    want = brute.near_duplicates(PAIRS, shingle, percent)
    out = minhash.near_duplicates(spark, edges, shingle=shingle, percent=percent).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in out} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in out)
    assert minhash.near_duplicates(spark, nothing).count() == 0


def test_near_duplicates_in_chains_and_large_groups(spark):
    words = passage(2, 120).split()
    chain = [(i, " ".join([f"w{k}" if k < i * 2 else w for k, w in enumerate(words)])) for i in range(40)]
    large = [(1000 + i, " ".join([*(f"z{k}" for k in range(100)), f"end{i}"])) for i in range(700)]
    rows = chain + large + [(5000 + i, large[0][1]) for i in range(50)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(spark, df, shingle=3, percent=85).collect()}
    assert out == brute.near_duplicates(rows, 3, 85)


def test_estimate_follows_similarity(spark):
    from pyspark.sql import functions as F

    base = [f"w{i}" for i in range(2000)]
    rows = [(i, " ".join(base[: 2000 - 200 * i] + [f"v{i}_{k}" for k in range(200 * i)])) for i in range(5)]
    signed = minhash.signatures(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text", 5)
    x = signed.alias("x").join(signed.alias("y"), F.col("x.id") == 0).select(F.col("y.id").alias("i"), minhash.estimate("x", "y").alias("e"))
    for r in x.collect():
        same = 1996 - 200 * r.i
        assert abs(r.e - same / (2 * 1996 - same)) < 0.2


def test_line_dedup_on_edges(edges, nothing):
    out = {r.doc_id: (r.text, r.n_lines, r.n_removed, r.n_windows_removed) for r in lines.dedup_lines(edges).collect()}
    assert out == brute.line_dedup(PAIRS)
    assert set(lines.dedup_lines(edges).columns) == {*edges.columns, "n_lines", "n_removed", "n_windows_removed"}
    assert lines.dedup_lines(nothing).count() == 0


def test_repeated_rows_and_null_ids_in_line_dedup(spark):
    t = "first line\nsecond line\nthird line\nfourth line"
    df = spark.createDataFrame([(1, t), (1, t), (None, t), (None, None)], "doc_id long, text string")
    out = sorted(((r.doc_id, r.text) for r in lines.dedup_lines(df).collect()), key=repr)
    assert out == sorted([(1, ""), (1, ""), (None, t), (None, None)], key=repr)


def test_repeated_strings_on_edges(spark, edges, nothing):
    out = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in repeats.repeated_strings(spark, edges).collect()}
    assert out == brute.repeated_strings(PAIRS)
    assert repeats.repeated_strings(spark, nothing).count() == 0


@pytest.mark.parametrize("most", [1, 1000])
def test_repeated_strings_in_and_across_shards(spark, monkeypatch, most):
    monkeypatch.setattr(repeats, "SHARD_RUNS", most)
    monkeypatch.setattr(repeats, "SHARD_BYTES", most * 100)
    shared = passage(7, 20)
    rows = [(i, f"{passage(i + 20, 8 + i % 5)} {shared[: 60 + i]} {passage(i + 50, 9)} {shared[20 + i :]}") for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in repeats.repeated_strings(spark, df).collect()}
    assert out == brute.repeated_strings(rows)


@pytest.mark.parametrize("ids", [(1, None, None, None, 5), (7, 7, None, 3, 3)])
def test_repeated_strings_of_rows_with_equal_or_no_ids(spark, ids):
    p, q = passage(3, 30)[:120], passage(11, 60)[:300]
    texts = [p, "zz" + p + "yy", q, q + p, p + q]
    rows = [(k, i, t) for k, (i, t) in enumerate(zip(ids, texts, strict=True))] * 2
    df = spark.createDataFrame([r[1:] for r in rows], "doc_id long, text string")
    out = sorted((repr(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in repeats.repeated_strings(spark, df).collect())
    assert out == sorted((repr(i), *v) for (_, i, _), v in zip(rows, brute.repeated_strings_of_rows([r[1:] for r in rows]), strict=True))


def test_only_runs_with_repeated_strings_are_sorted():
    import numpy as np
    import pyarrow as pa

    a, b = passage(3, 40).encode()[:200], passage(8, 40).encode()[:200]
    runs = [b"x" * 7 + a[:60] + b[:30], a[5:80], b[100:180], b"y" * 60, b"y" * 60, b"short", a[150:]]
    kept, begin, data = repeats.repeating(pa.array(runs, pa.binary()), np.array([1, 2, 3, 4, 4, 5, 6]))
    assert kept.tolist() == [0, 1] and begin.tolist() == [12, 0] and data.to_pylist() == [a[5:60]] * 2
    assert not len(repeats.repeating(pa.array([], pa.binary()), np.zeros(0, np.int64))[0])


def test_a_passage_with_many_continuations_is_split_before_its_strings_are_merged(spark, monkeypatch):
    monkeypatch.setattr(repeats, "SHARD_RUNS", 8)
    seen = []
    across = repeats._across_shards
    monkeypatch.setattr(repeats, "_across_shards", lambda stage, runs: seen.append(runs.selectExpr("sum(n % 64)").first()[0] or 0) or across(stage, runs))
    shared = passage(7, 40)[:170]
    rows = [(i, f"{i * 7919 % 10007:05d}{i * 104729 % 99991:05d}" * 5 + shared + f"{i * 15485863 % 99991:05d}{i * 31337 % 10007:05d}" * 5) for i in range(120)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in repeats.repeated_strings(spark, df).collect()}
    assert out == brute.repeated_strings(rows)
    assert seen[0] < 16 * len(rows)  # of the 220 strings of each text that touch the passage


def test_suffix_array_and_prefixes():
    import numpy as np

    body = np.random.default_rng(1).integers(97, 99, 400, dtype=np.uint8)
    order = repeats.suffix_array(body, 500)
    raw = body.tobytes()
    assert order.tolist() == sorted(range(400), key=lambda i: raw[i:])
    prefix = repeats.common_prefixes(body, order, np.array([0]), 64)
    for k in range(1, 400):
        a, b = raw[order[k - 1] :], raw[order[k] :]
        n = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
        assert min(prefix[k], 40) == min(n, 40)


def test_repeated_strings_on_documents(spark, sf, documents):
    out = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in queries.op7_repeated_strings(spark, sf).collect()}
    assert out == brute.repeated_strings([(i, t) for i, t, _ in documents])


def test_mixing_meets_targets(spark, edges, nothing):
    out = mixing.mix_sources(spark, edges).collect()
    sizes, taken, target, source = defaultdict(int), defaultdict(int), {}, {r[0]: r[3] for r in EDGES}
    assert len(out) == len(EDGES)
    for r in out:
        s = source[r.doc_id]
        sizes[s] += r.size
        taken[s] += r.taken
        target[s] = r.target
        assert 0 <= r.taken <= 3 * r.size and r.size == brute.base_rules(dict(PAIRS)[r.doc_id])[0]
    want = brute.targets(dict(sizes))
    for s in sizes:
        assert abs(want[s] - target[s]) < 1e-6 and taken[s] == int(target[s] + 1e-9)
    assert sorted(out) == sorted(mixing.mix_sources(spark, edges.repartition(3)).collect())
    assert mixing.mix_sources(spark, nothing).count() == 0


def test_mixed_documents_repeat_whole_rows(spark, edges):
    plan = {r.doc_id: r for r in mixing.mix_sources(spark, edges).collect()}
    mixed = mixing.mixed_documents(spark, edges)
    assert mixed.columns == edges.columns
    times = defaultdict(int)
    for r in mixed.collect():
        times[r.doc_id] += 1
    for i, r in plan.items():
        assert abs(times[i] * r.size - r.taken) <= r.size


def test_jump_sharding(spark, edges, nothing):
    import pyspark.sql.functions as F

    texts = dict(PAIRS)
    out = sharding.assign_shards(edges, shards=8).collect()
    slots = defaultdict(list)
    for r in out:
        body = (texts[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32) == (len(body) + 1, zlib.crc32(body))
        assert r.grown_shard in (r.shard, 8)
        slots[r.shard].append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    assert sharding.assign_shards(nothing).count() == 0
    many = spark.range(20000).select([sharding.jump_hash(F.col("id"), n).alias(f"n{n}") for n in (1, 8, 9)])
    rows = many.collect()
    assert all(r.n1 == 0 and r.n9 in (r.n8, 8) for r in rows)
    counts = [sum(r.n8 == k for r in rows) for k in range(8)]
    assert max(counts) < 1.15 * min(counts) and abs(sum(r.n9 == 8 for r in rows) - 20000 / 9) < 250


def test_shards_equal_a_scalar_jump_hash(spark):
    import struct

    import pyspark.sql.functions as F
    import xxhash

    def scalar(key, shards):
        b, j, step = -1, 0, 0
        while j < shards:
            b, step = j, step + 1
            seed = xxhash.xxh64_intdigest(struct.pack("<q", key), 42)
            draw = (xxhash.xxh64_intdigest(struct.pack("<i", step), seed) >> 33) + 1
            j = int((b + 1) * (float(1 << 31) / draw))
        return b

    rows = spark.range(500).select("id", *[sharding.jump_hash(F.col("id"), n).alias(f"n{n}") for n in (8, 1000)]).collect()
    assert all((r.n8, r.n1000) == (scalar(r.id, 8), scalar(r.id, 1000)) for r in rows)


def test_packing_against_a_plain_one(spark):
    rows = [(i % 9, " ".join(["w"] * (1 + i * i % 23))) for i in range(60)] + [(None, None), (3, "w")] * 2
    out = packing.pack_batches(spark, spark.createDataFrame(rows, "doc_id long, text string"), buckets=4, token_budget=60).collect()
    lengths = sorted(len((t or "").split()) + 1 for _, t in rows)
    assert sorted(r.n_tokens for r in out) == lengths
    import itertools

    top = sorted(set(lengths))
    best = min(sum(next(b for b in (*cut, top[-1]) if b >= n) - n for n in lengths) for cut in itertools.combinations(top[:-1], 3))
    assert sum(r.padding for r in out) == best
    full = defaultdict(int)
    for r in out:
        full[r.bucket, r.bucket_len, r.batch] += 1
    for (bucket, width, batch), n in full.items():
        last = max(b for k, _, b in full if k == bucket)
        assert n == max(1, 60 // width) or batch == last


def test_repeated_rows_and_null_ids(spark):
    """Rows that are equal, or lack an id, are rows of their own in every operator that gives a row for a row."""
    t = passage(1)
    rows = [(1, t, "en", "a", "k"), (1, t, "en", "a", "k"), (None, t, "en", "a", "k"), (None, None, None, None, "k"), (2, passage(2), "en", "b", "k"), (2, t + " more", "en", "b", "k")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, kept string")
    out = quality.quality_rules(spark, df).collect()
    assert len(out) == 6 and len({(r.doc_id, r.n_words, r.kept) for r in out}) == 5
    out = minhash.near_duplicates(spark, df, shingle=3, percent=85).collect()
    assert len(out) == 6 and {(r.doc_id, r.component_id) for r in out if r.n_shingles} == {(1, 1), (None, 1), (2, 2), (2, 1)} and sum(r.kept for r in out) == 4
    assert sorted(r.text for r in minhash.without_near_duplicates(spark, df).collect() if r.text) == sorted([t, t, passage(2)])
    out = mixing.mix_sources(spark, df).collect()
    assert len(out) == 6 and all(r.taken <= 3 * r.size for r in out)
    assert mixing.mixed_documents(spark, df.withColumnRenamed("kept", "_text_key")).columns == ["doc_id", "text", "lang", "source", "_text_key"]
    slots = defaultdict(list)
    for r in sharding.assign_shards(df, shards=3).collect():
        slots[r.shard].append(r.slot)
    assert sorted(len(v) for v in slots.values()) and all(sorted(v) == list(range(len(v))) for v in slots.values()) and sum(map(len, slots.values())) == 6


def test_packing(spark, edges, nothing):
    out = packing.pack_batches(spark, edges, buckets=3, token_budget=400).collect()
    assert sorted(r.doc_id for r in out) == [r[0] for r in EDGES]
    batches = defaultdict(list)
    for r in out:
        assert r.padding == r.bucket_len - r.n_tokens >= 0
        batches[r.bucket, r.batch].append(r)
    for rows in batches.values():
        assert len(rows) == 1 or len(rows) * rows[0].bucket_len <= 400
        assert sorted(r.place for r in rows) == list(range(len(rows)))
    assert packing.pack_batches(spark, nothing).count() == 0


def test_packing_boundaries_are_optimal():
    from itertools import combinations

    import numpy as np

    rng = np.random.default_rng(2)
    for m in (1, 2, 7, 9):
        top = np.sort(rng.choice(np.arange(1, 60), m, replace=False))
        count = rng.integers(1, 9, m)
        best = min(
            sum(int(c) * (min(b for b in (*cut, int(top[-1])) if b >= t) - int(t)) for t, c in zip(top, count, strict=True))
            for k in range(min(3, m))
            for cut in combinations(top[:-1].tolist(), k)
        )
        bounds = packing.best_boundaries(top, count, top * count, 3)
        got = sum(int(c) * (min(b for b in bounds if b >= t) - int(t)) for t, c in zip(top, count, strict=True))
        assert got == best


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_queries_equal_their_sql(spark, sf, name):
    import oracle

    ours, theirs = oracle.both(spark, sf, queries.queries()[name], queries.oracle_sql()[name])
    assert ours == theirs
