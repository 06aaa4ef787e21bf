"""The reports on tables of their own: literal cases, nulls, ties and empty tables."""

import pytest
from pyspark.sql import functions as F

from sparkloom.operators import compare, folds, relations, reports
from sparkloom.store import Stage


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


def test_addresses(spark):
    r = spark.createDataFrame([(1, "x", "HTTP://A.Example.com/"), (2, "a", "http://a.example.com"), (3, None, "http://localhost:8080/x"), (4, "x", None), (5, "x", "http://localhost:9000")], "ref long, own string, addr string")
    n = spark.createDataFrame([("a", "http://a.example.com", 80), ("b", "http://b.example.com", 8080), ("c", None, 9000), ("d", None, 9000), (None, None, None)], "repo string, url string, port int")
    got = rows(reports.match_addresses(r, n, "ref", "own", "addr", "repo", "url", "port"), "ref")
    assert got == [(1, "matched", "a", 0.95), (2, "none", None, None), (3, "matched", "b", 0.82), (4, "none", None, None), (5, "ambiguous", None, 0.82)]


def test_relation_hints(spark):
    r = spark.createDataFrame([(1, "api_base_url", "a", "b"), (2, "iframe_src", "a", "a"), (3, "other", "a", "b"), (4, "api_base_url", "x", "y"), (5, "api_base_url", "x", "a"), (6, "api_base_url", "a", None)], "id long, kind string, s string, t string")
    known = spark.createDataFrame([("a",), ("b",), ("b",), (None,)], "node string")
    got = rows(reports.relation_hints(r, known, "id", "kind", "s", "t", "node"), "id")
    assert [x[2] for x in got] == ["resolved", "self", "unsupported_type", "both_missing", "source_missing", "target_missing"] and got[0][1] == "calls_api"


def test_journeys(spark):
    steps = spark.createDataFrame([("j", 1, "open"), ("j", 2, "view"), ("j", 3, "open"), ("j", 4, "close"), ("k", 1, "open"), ("k", 2, "open"), ("l", 1, None)], "j string, n int, kind string")
    got = rows(reports.journey_summary(steps, "j", "kind", ["n"], "open", "close", 3, "never closed"), "j")
    assert got == [("j", 4, 3, 3, 1, None, "complete", 24.0), ("k", 2, 1, 0, 0, "never closed", "partial", 1.5), ("l", 1, 0, 0, 0, None, "limited", 0.0)]
    assert reports.journey_summary(steps.where("false"), "j", "kind", ["n"], "open", "close", 3, "g").count() == 0


def test_bounds_and_severities(spark):
    df = spark.createDataFrame([("a", i, "error" if i == 3 else "info") for i in range(5)] + [("b", 1, "warning"), (None, 7, None)], "g string, n int, s string")
    got = rows(reports.bounded_items(df, "g", [F.desc("n")], F.col("n"), 2), "g", "place")
    assert got == [(None, 1, "7"), ("a", 1, "4"), ("a", 2, "3"), ("a", 3, "omitted 3"), ("b", 1, "1")]
    assert rows(reports.severity_summary(df, "g", "s"), "g") == [(None, 0, 0, 0, "ready"), ("a", 4, 0, 1, "blocked"), ("b", 0, 1, 0, "partial")]


def test_roles_and_merges(spark):
    units = spark.createDataFrame([(1, "api"), (2, None), (3, None), (4, None)], "u long, conf string")
    found = spark.createDataFrame([(1, "web", 0.9, False), (2, "web", 0.6, False), (2, "api", 0.6, False), (2, "api", 0.1, False), (3, "db", 0.8, True), (None, "x", 1.0, False)], "u long, role string, s double, weak boolean")
    got = rows(reports.assess_roles(units, found, "u", "conf", "role", "s", "weak", conflict=F.col("configured") != F.col("found")), "u")
    assert got == [(1, "explicit", "api", 1.0, True), (2, "discovered", "api", 0.6, False), (3, "discovered", "db", 0.35, False), (4, "default", "unknown", 0.1, False)]
    df = spark.createDataFrame([("k", "n2", 3, "b"), ("k", "n1", 2, "a"), ("k", "n1", 2, "a"), ("l", None, None, None)], "k string, note string, files int, status string")
    assert rows(reports.merge_resolutions(df, ["k"], "note", "files", "status"), "k") == [("k", "n1,n2", 5, "a", 2), ("l", "", None, None, 1)]


def test_budgets(spark):
    df = spark.createDataFrame([("g", "a", 100), ("g", "b", 40), ("h", "c", 50), ("h", "d", None)], "g string, k string, t long")
    # 140 > 60: a is halved (90), b (70), then a is cut to an eighth (32 left)
    assert rows(reports.downgrade_to_budget(df, "g", "k", "t", 60), "g", "step", "k") == [("g", "a", 1, 50, 140), ("g", "b", 1, 20, 90), ("g", "a", 2, 38, 70)]
    p = spark.createDataFrame([(1, "path", 5), (2, "whole", None), (3, "whole", 9), (4, "whole", 2)], "k long, tier string, t int")
    assert rows(reports.order_representations(p, "k", "tier", "t", ("whole", "path"), 3), "place") == [(4, "whole", 2, 1, 2), (3, "whole", 9, 2, 11), (2, "whole", None, 3, 11)]


def test_changes_and_strategies(spark):
    df = spark.createDataFrame([("a", "r"), ("a", "n"), ("b", "r"), ("c", "u"), ("d", None)], "g string, c string")
    got = rows(reports.change_status(df, "g", F.col("c") == "r", F.col("c") == "n", F.col("c") == "u"), "g")
    assert [x[-1] for x in got] == ["pass", "warn", "fail", "pass"]
    s = spark.createDataFrame([("x", False, 0.5, 2, 0.5), ("x", True, 0.7, 2, 0.5), ("y", False, 0.5, 2, 0.5), ("y", True, 0.5, 1, 0.5), ("z", False, 0.5, 1, 0.1), ("z", True, 0.5, 1, 0.2), ("w", True, 0.5, 1, 0.2)], "g string, second boolean, r double, m int, c double")
    assert {x[0]: x[3] for x in rows(reports.compare_strategies(s, "g", "second", "r", "m", "c"), "g")} == {"x": "recall", "y": "fewer missed", "z": "coverage", "w": "not earned"}


def test_hints_for_several_tasks(spark):
    s = spark.createDataFrame([(1, "src/login.py", "LoginForm"), (1, "src/login.py", "other"), (2, "lib/form.py", "Draw"), (3, "lib/z.py", "Zed"), (3, "lib/z.py", None)], "id long, path string, sym string")
    t = spark.createDataFrame([(7, ["login", "form"], ["src/login.py"]), (8, ["form"], None), (9, [], ["lib/z.py"])], "task long, terms array<string>, sel array<string>")
    got = rows(reports.symbol_hints(s, t, "id", "path", "sym", "task", "terms", "sel", per_file=2, most=3), "task", "place")
    assert got == [(7, 1, "LoginForm", 0, 650, 1), (7, 1, "other", 2, 320, 2), (7, 2, "Draw", 4, 145, 3), (8, 1, "LoginForm", 4, 180, 1), (8, 2, "Draw", 4, 145, 2), (9, 3, "Zed", 2, 280, 1)]


def test_relevant_nodes(spark):
    n = spark.createDataFrame([(i, "node seven" if i == 7 else "node other", 5 if i % 2 else 0) for i in range(20)], "n long, text string, b int")
    t = spark.createDataFrame([(1, ["seven", "seven"]), (2, ["node"]), (3, [])], "task long, words array<string>")
    got = rows(reports.relevant_nodes(n, t, "n", F.col("text"), F.col("b"), "task", "words", most=2), "task", "place")
    assert got == [(1, 7, 15, 1, 18), (1, 1, 5, 2, 18), (2, 1, 15, 1, 18), (2, 3, 15, 2, 18), (3, 1, 5, 1, 18), (3, 3, 5, 2, 18)]


def test_records_endings_and_risks(spark):
    c = spark.createDataFrame([(1, 1, "user", "a"), (1, 2, "assistant", "b"), (2, 1, "assistant", ""), (3, 1, "user", "x"), (3, 2, "user", "y")], "r long, n int, role string, t string")
    assert rows(reports.record_issues(c, "r", "n", "role", "t"), "r") == [(1, "", "done"), (2, "start,empty,odd", "stop"), (3, "repeated", "answer")]
    f = spark.createDataFrame([(2, "a/UserCard.ts"), (1, "b/Card.ts"), (3, None)], "id long, path string")
    w = spark.createDataFrame([("Card.ts",), ("a/UserCard.ts",), ("x",), (None,), ("",)], "w string")
    assert rows(reports.lookup_endings(w, f, "w", "id", "path"), "w") == [("Card.ts", 1, "b/Card.ts"), ("a/UserCard.ts", 2, "a/UserCard.ts")]
    files = spark.createDataFrame([(1, ["r"], []), (2, ["r", "s"], []), (3, [], []), (4, ["r"], [])], "id long, routes array<string>, imports array<string>")
    lost = spark.createDataFrame([(1, "./x"), (2, "pkg"), (3, "./x")], "id long, imported string")
    assert rows(reports.routes_at_risk(files, "id", "routes", "imports", lost), "id") == [(1, 1, 1, "high"), (2, 2, 1, "medium"), (4, 1, 0, "low")]


@pytest.mark.parametrize("most", [1, 5])
def test_empty_tables(spark, most):
    none = spark.createDataFrame([], "g string, k long, t long")
    assert reports.downgrade_to_budget(none, "g", "k", "t", most).count() == 0
    assert reports.bounded_items(none, "g", [F.col("k")], F.col("t"), most).count() == 0


def test_digests_of_groups(spark):
    a = [("g", f"line {i % 7}") for i in range(50)] + [("h", "x"), ("h", None), (None, "x")]
    one = rows(compare.group_digests(spark.createDataFrame(a, "g string, t string"), ["g"], F.col("t"), 1), "g")
    two = rows(compare.group_digests(spark.createDataFrame(a[::-1], "g string, t string").repartition(7), ["g"], F.col("t"), 1), "g")
    less = rows(compare.group_digests(spark.createDataFrame(a[1:], "g string, t string"), ["g"], F.col("t"), 1), "g")
    assert one == two and [x[2] for x in one] == [1, 50, 2] and one[1][1] != less[1][1] and one[2] == less[2] and len({x[1] for x in one}) == 3


def test_suppression_keeps_columns_and_nulls(spark):
    df = spark.createDataFrame([("a", "b", "calls", "explicit", 1), ("a", "b", "embeds", "inferred", 2), ("a", "b", "calls", "inferred", 3), ("a", None, "x", "inferred", 4), (None, None, "y", "explicit", 5), (None, None, "x", "inferred", 6)], "s string, t string, kind string, origin string, n int")
    assert [r[-1] for r in rows(relations.without_suppressed(df, ["s", "t"], "kind", "origin", "explicit"), "n")] == [1, 3, 4, 5]


def test_places_with_clashing_names(spark):
    df = spark.createDataFrame([("g", i, "x") for i in range(9)], "g string, _row int, _tie string")
    assert [(r[1], r[3]) for r in rows(folds.placed(Stage(spark, "t"), df, ["g"], [F.desc("_row")]), "_row")] == [(i, 9 - i) for i in range(9)]


def test_changes_of_lists_and_sets(spark):
    old = spark.createDataFrame([(1, ["a", "b"], None), (2, ["x"], ["f"])], "k long, c array<string>, d array<string>")
    new = spark.createDataFrame([(1, ["b"], ["g"]), (3, ["x"], None)], "k long, c array<string>, d array<string>")
    assert rows(reports.changed_items(old, new, "k", ["c", "d"]), "k", "category", "name") == [(1, "c", "a", "removed"), (1, "d", "g", "added"), (2, "c", "x", "removed"), (2, "d", "f", "removed"), (3, "c", "x", "added")]
    a, b = spark.createDataFrame([(1, "p"), (1, "p"), (1, "q"), (2, "r"), (None, "s"), (1, None)], "k long, i string"), spark.createDataFrame([(1, "q"), (1, "z"), (1, "y"), (2, "r")], "k long, i string")
    assert rows(reports.changed_sets(a, b, "k", "i"), "k") == [(1, "y z", "p")]


def test_totals_and_firsts(spark):
    df = spark.createDataFrame([("x", 1, "v"), ("x", 2, "w"), (None, 3, "v")], "g string, n long, v string")
    assert rows(reports.totals(df, "g", {"n": F.sum("n")}), "is_total", "g") == [(None, 3, 0), ("x", 3, 0), (None, 6, 1)]
    assert [tuple(r) for r in reports.first_distinct(df, "v", ["n"], 5).collect()] == [("v", 1), ("w", 2)]
    r = spark.createDataFrame([("a", "b", "o", 0.9), ("a", "b", "o", 0.1), ("a", "c", "i", None)], "a string, b string, o string, s double")
    assert rows(reports.group_relationships(r, ["a"], ["b", "o"], "o", "s"), "a") == [("a", 3, 2, 1, 2, "i,o")]
