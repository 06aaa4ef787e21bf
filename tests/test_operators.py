import random
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from sparkloom.functions import predicates, text
from sparkloom.operators import compare, folds, graph, ranking, relations
from sparkloom.sources import parsing, scripts, tables
from sparkloom.streaming import changes


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_text_functions(spark):
    lit = F.lit
    assert one(spark, text.name_tokens(lit("parseHTTPRoute2Go_now"))) == ["parse", "httproute2", "go", "now"]
    assert one(spark, text.task_terms(lit("Fix the login API and the Login page"))) == ["login", "api", "page"]
    assert one(spark, text.phrases(text.task_terms(lit("login api page")))) == ["login api", "api page", "login api page"]
    assert one(spark, text.phrases(F.array(lit("x")))) == []
    assert [one(spark, text.estimate_tokens(lit(n))) for n in (0, 1, 33, 34)] == [0, 1, 10, 11]
    assert [one(spark, text.estimate_tokens_conservative(lit(n))) for n in (0, 1, 3, 4)] == [0, 1, 1, 2]
    assert [one(spark, text.route_path(lit(p))) for p in ("a//b/?q", "/", "/x/#y", None)] == ["/a/b", "/", "/x", "/"]
    assert one(spark, text.url_host(lit("HTTPS://Example.com:80/a"))) == "example.com:80"
    assert one(spark, text.url_host(lit("http://127.0.0.1:9/a"))) == "localhost:9"
    assert one(spark, text.url_host(lit("http://u:p@h/a"))) is None and one(spark, text.url_host(lit("ftp://h"))) is None
    assert one(spark, text.template_matches(lit("/a/{id}/c"), lit("/a/7/c"))) and not one(spark, text.template_matches(lit("/a/:id"), lit("/b/7")))
    assert one(spark, text.secret_like(lit("Bearer abc"))) and not one(spark, text.secret_like(lit("plain words")))
    assert one(spark, text.line_slice(lit("a\nb\nc\nd"), 2, 2)) == "b\nc"


def test_path_predicates(spark):
    lit = F.lit
    assert [one(spark, predicates.is_test_path(lit(p))) for p in ("tests/x.py", "a/test_x.py", "a/x.spec.ts", "a/contest.py")] == [True, True, True, False]
    assert [one(spark, predicates.is_generated_path(lit(p))) for p in ("dist/x.js", "a/x.min.js", "a/x_pb2.py", "yarn.lock", "a/x.py")] == [True, True, True, True, False]
    assert [one(spark, predicates.folder_role(lit(p))) for p in ("vendor/src/x", "src/x", "x", "y/x", "docs/src/x")] == ["vendor", "source", "root", "other", "docs"]
    assert one(spark, predicates.language(lit("A/B.TSX"))) == "typescript"
    assert [one(spark, predicates.size_class(lit(n))) for n in (100, 101, 5000, 5001)] == ["small", "medium", "large", "very_large"]
    assert [one(spark, predicates.confidence(lit(x))) for x in (0.7, 0.4, 0.39)] == ["high", "medium", "low"]


def test_budget_skips_what_does_not_fit_and_goes_on(spark):
    df = spark.createDataFrame([("g", i, f"f{i}", c) for i, c in enumerate([5, 9, 3, 2, 1])], "g string, o int, item string, cost int")
    out = folds.fill_budget(spark, df, ["g"], [F.col("o")], "item", "cost", 10).orderBy("place").collect()
    assert [r.admitted for r in out] == [True, False, True, True, False]


def test_budget_tries_every_row_of_a_group(spark):
    rng = random.Random(7)
    rows = [(g, i, f"f{i}", None if i % 97 == 5 else rng.randrange(9) if i > 700 else rng.randrange(100, 900)) for g in ("a", "b", None) for i in range(900 if g else 1)]
    out = folds.fill_budget(spark, spark.createDataFrame(rows, "g string, o int, item string, cost int"), ["g"], [F.col("o")], "item", "cost", 1500).collect()
    used, want = Counter(), {}
    for g, i, item, c in rows:
        fits = c is not None and used[g] + c <= 1500
        used[g] += c if fits else 0
        want[g, item] = (c, i + 1, fits)
    assert {(r.g, r.item): (r.cost, r.place, r.admitted) for r in out} == want and len(out) == len(rows)
    assert any(fits and place > 200 for _, place, fits in want.values())


def test_interacting_caps_against_a_plain_loop(spark):
    rng = random.Random(3)
    rows = [(i, rng.choice("abcdef") if i % 9 else None, rng.choice("xyz")) for i in range(2000)]
    df = spark.createDataFrame(rows, "ord long, s string, t string")
    for caps, total in (({"s": 5, "t": 9}, 250), ({"s": 40, "t": 30}, 20)):
        counts, kept, want = {c: Counter() for c in caps}, 0, {}
        for i, s, t in rows:
            v = {"s": s or "unknown", "t": t or "unknown"}
            full = [c for c in caps if counts[c][v[c]] >= caps[c]]
            want[i] = "total" if kept == total else full[0] if full else None
            if want[i] is None:
                kept += 1
                for c in caps:
                    counts[c][v[c]] += 1
        out = relations.interacting_caps(spark, df, "ord", caps, total).collect()
        assert {r.ord: r.drop_reason for r in out} == want and all(r.kept == (r.drop_reason is None) for r in out)


def test_merged_scores_against_a_fold(spark):
    rng = random.Random(4)
    rows = [(rng.randrange(6), rng.choice([100, 200, 350, 900]) / 1000, rng.random() < 0.03) for _ in range(120)]
    out = {r.k: r for r in folds.merge_scores(spark.createDataFrame(rows, "k int, s double, e boolean"), ["k"], "s", "e").collect()}
    groups = defaultdict(list)
    for k, s, e in rows:
        groups[k].append((s, e))
    for k, own in groups.items():
        explicit = any(e for _, e in own)
        at = None
        for s, _ in sorted(own):
            at = s if at is None else max(at, s) if explicit or at == s else min(1.0, max(at, s) + 0.05)
        assert abs(out[k].score - at) < 1e-6 and out[k].explicit == explicit and out[k].n == len(own)


def test_graph_on_random_edges(spark):
    rng = random.Random(5)
    edges = {(rng.randrange(9), rng.randrange(9)) for _ in range(16)}
    df = spark.createDataFrame(sorted(edges), "a int, b int")
    reach = {i: set() for i in range(9)}
    for i in range(9):
        new = {b for a, b in edges if a == i}
        while new - reach[i]:
            reach[i] |= new
            new = {b for a, b in edges if a in new}
    got = defaultdict(set)
    for r in graph.reachable(spark, df, df.select(F.col("a").alias("seed")), "a", "b").collect():
        assert r.node not in got[r.seed]
        got[r.seed].add(r.node)
    assert all(got[i] == reach[i] for i in {a for a, _ in edges})
    scc = {r.node: r.component for r in graph.strong_components(spark, df, "a", "b").collect()}
    want = {i: min(j for j in range(9) if j == i or (j in reach[i] and i in reach[j])) for i in range(9) if any(j != i and j in reach[i] and i in reach[j] for j in range(9))}
    assert scc == want

    def simple(path):
        for a, b in edges:
            if a == path[-1]:
                if b == path[0]:
                    yield tuple(path)
                elif b > path[0] and b not in path:
                    yield from simple([*path, b])

    cycles = sorted(tuple(r.path) for r in graph.cycles(spark, df, "a", "b").collect())
    assert cycles == sorted(c for i in range(9) for c in simple([i]))
    assert sorted(tuple(r.path) for r in graph.cycles(spark, df, "a", "b", most_nodes=2).collect()) == [c for c in cycles if len(c) <= 2]


def test_long_chains_and_rings(spark):
    ring = [(i, (i + 1) % 12) for i in range(12)] + [(100 + i, 101 + i) for i in range(30)] + [(3, 100), (130, 131)]
    df = spark.createDataFrame(ring, "a int, b int")
    assert {(r.node, r.component) for r in graph.strong_components(spark, df, "a", "b").collect()} == {(i, 0) for i in range(12)}
    seeds = spark.createDataFrame([(100,)], "seed int")
    assert graph.reachable(spark, df, seeds, "a", "b").agg(F.max("depth"), F.count("*")).first()[:] == (31, 31)
    assert graph.strong_components(spark, df.where("a >= 100"), "a", "b").count() == 0


def test_traversal_stops_at_its_caps(spark):
    edges = spark.createDataFrame([("s", t, r, 1.0, i) for i, (t, r) in enumerate([("b", 2), ("a", 2), ("c", 1)])] + [("c", "d", 3, 1.0, 0), ("a", "s", 0, 1.0, 0)], "source string, target string, rank long, cost double, ord int")
    seeds = spark.createDataFrame([("s",), ("lonely",)], "seed string")
    walk = lambda **caps: [r.node for r in graph.traverse(edges, seeds, **caps).where("seed = 's'").orderBy("place").collect()]
    assert walk() == ["s", "c", "a", "b", "d"] and walk(max_depth=1) == ["s", "c", "a", "b"] and walk(max_depth=0) == ["s"]
    out = graph.traverse(edges, seeds, max_files=2).where("seed = 's'").collect()
    assert [r.node for r in out] == ["s", "c"] and {r.stop for r in out} == {"files"}
    assert {r.stop for r in graph.traverse(edges, seeds, max_edges=2).collect() if r.seed == "s"} == {"edges"}
    assert {r.stop for r in graph.traverse(edges, seeds, max_cost=2.5).collect() if r.seed == "s"} == {"cost"}
    assert [r.node for r in graph.traverse(edges, seeds).where("seed = 'lonely'").collect()] == ["lonely"]


def test_lanes_caps_and_ambiguity(spark):
    lane = lambda rows: spark.createDataFrame(rows, "p string, d string, rank int")
    out = ranking.merged_lanes([lane([("a", "x", 1), ("b", "x", 2)]), lane([("b", "x", 1), ("c", "x", 2), ("d", "y", 3)])], "p", "d", per_lane=3, per_group=2, total=3)
    assert [r.p for r in out.orderBy("place").collect()] == ["a", "b", "d"]
    best = ranking.best_or_ambiguous(spark.createDataFrame([(1, 5, "a"), (1, 5, "b"), (2, 1, "c")], "k int, s int, n string"), ["k"], "s", "n")
    assert {r.k: (r.n, r.ambiguous) for r in best.collect()} == {1: (None, True), 2: ("c", False)}


def test_quality_of_empty_tiers(spark):
    assert [one(spark, predicates.relevance_band(F.lit(x))) for x in (0.0, 0.1, 0.4, 0.9)] == ["unknown", "low", "medium", "high"]
    ranked = spark.createDataFrame([("t", "a", 1), ("t", "b", 2), ("t", "c", 3)], "task string, item string, rank int")
    expected = spark.createDataFrame([("t", "a", "critical"), ("t", "z", "critical"), ("t", "b", "distractor"), ("u", "q", "useful")], "task string, item string, tier string")
    out = {r.task: r for r in compare.quality_at_k(ranked, expected, "task", "item", "rank", "tier", 3).collect()}
    assert (out["t"].critical_recall, out["t"].useful_coverage, out["t"].missed_critical) == (0.5, 1.0, 1)
    assert abs(out["t"].context_waste - 2 / 3) < 1e-9 and out["u"].evaluated == 0 and out["u"].context_waste == 0


def test_parsers(spark, tmp_path):
    source = 'import os\nfrom a.b import c\nfrom . import d\n\nclass K:\n    def m(self): pass\n\n@app.route("/x", methods=["POST", "GET"])\ndef f():\n    pass\n\n@r.get("/y")\nasync def g(): pass\n'
    (tmp_path / "src").mkdir()
    (tmp_path / "src" / "m.py").write_text(source)
    (tmp_path / "src" / "bad.py").write_text("def (:\n")
    (tmp_path / "src" / "raw.py").write_bytes(b"\xff\xfe\x00")
    files = tables.source_texts(spark, str(tmp_path))
    assert files.count() == 2
    facts = {(r.kind, r.name, r.line, r.detail) for r in parsing.parse_python(files).collect() if r.kind != "error"}
    assert facts == {("import", "os", 1, None), ("import", "a.b", 2, "c"), ("class", "K", 5, None), ("function", "f", 9, None), ("function", "g", 13, None), ("route", "/x", 9, "POST,GET"), ("route", "/y", 13, "GET")}
    assert parsing.parse_python(files).where("kind = 'error'").count() == 1
    inventory = tables.file_inventory(spark, str(tmp_path))
    assert {r.path.rsplit("/", 1)[1]: r.language for r in inventory.collect()} == {"m.py": "python", "bad.py": "python", "raw.py": "python"}
    script = 'import a from "./a"\n// import no from "./no"\nexport * from \'b\'\nconst u = "http://x/y"; const c = require("c")\nimport("./d")\n'
    bare = one(spark, scripts.without_comments(F.lit(script)))
    assert "./no" not in bare and "http://x/y" in bare
    assert [(r.form, r.source) for r in one(spark, scripts.script_imports(F.lit(script)))] == [("default", "./a"), ("dynamic", "./d"), ("require", "c")]
    assert [one(spark, scripts.balanced(F.lit(t))) for t in ("a { b '}' } // }", "{ {", "} {", "")] == [True, False, False, True]
    assert [r.name for r in one(spark, scripts.manifest_facts(F.lit("go.mod"), F.lit("module a.b/c\nreplace x => ../y\n")))] == ["a.b/c", "x"]


def test_snapshots_by_stamp(spark, tmp_path):
    path = str(tmp_path / "snap")
    tables.write_snapshot(spark.range(3), path, "20240101_000000")
    tables.write_snapshot(spark.range(5), path, "20240102_000000")
    tables.write_snapshot(spark.range(4), path, "20240102_000000")
    assert tables.latest_snapshot(spark, path).count() == 4 and spark.read.parquet(path).count() == 7


def test_stream_of_changes_and_windows(spark, tmp_path):
    source = str(tmp_path / "in")
    spark.createDataFrame([("a", "1"), ("b", "1")], "k string, f string").coalesce(1).write.mode("append").parquet(source)
    run = lambda: (
        spark.readStream.schema("k string, f string").parquet(source).writeStream.option("checkpointLocation", str(tmp_path / "cp"))
        .trigger(availableNow=True).foreachBatch(changes.apply_changes(spark, str(tmp_path / "known"), str(tmp_path / "changes"), "k", "f")).start().awaitTermination()
    )
    run()
    spark.createDataFrame([("a", "2"), ("b", "1"), ("c", "1")], "k string, f string").coalesce(1).write.mode("append").parquet(source)
    run()
    got = {(r.version, r.k, r.status) for r in spark.read.parquet(str(tmp_path / "changes")).collect()}
    assert got == {(0, "a", "added"), (0, "b", "added"), (1, "a", "changed"), (1, "c", "added")}


def test_windowed_stream_equals_batch(spark, sf, tmp_path):
    events = spark.read.parquet(f"{sf}/events.parquet")
    events.coalesce(1).write.parquet(str(tmp_path / "ev"))
    query = (
        changes.windowed_counts(spark.readStream.schema(events.schema).parquet(str(tmp_path / "ev")), "ts", "event_type")
        .writeStream.outputMode("complete").format("memory").queryName("hourly").trigger(availableNow=True).start()
    )
    query.awaitTermination()
    assert sorted(spark.table("hourly").collect()) == sorted(changes.windowed_counts(events, "ts", "event_type").collect())
