"""What must not grow faster than the tables: pairs at a hot path, tables sent around, rows of a small file in one task."""

import time

from sparkloom import store
from sparkloom.operators import contracts, graph, jsonwalk, prefixes, relations
from sparkloom.plans import code_tables, parser_queries, report_queries, route_queries
from sparkloom.sources import routers
from sparkloom.store import Stage


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_many_contracts_and_references_at_one_path(spark):
    n = 60_000
    made = spark.range(n).selectExpr("id AS contract", "CASE WHEN id % 4 < 3 THEN 'iframe_url' END AS kind", "1 AS repository", "'a.ts' AS path", "CASE WHEN id % 3 = 0 THEN 's' WHEN id % 3 = 1 THEN 'no' END AS symbol")
    seen = spark.range(n).selectExpr("1 AS repository", "'a.ts' AS path", "CASE WHEN id % 2 = 0 THEN 's' END AS name", "id % 20 AS line", "'iframe_src' AS type", "CASE WHEN id % 10 = 0 THEN 'x' END AS value")
    spans = spark.createDataFrame([(1, "a.ts", "s", 1, 1)] * 2, "repository int, path string, declared string, line long, end_line long")
    began = time.time()
    got = {tuple(r): c for *r, c in contracts.locate_contracts(spark, made, seen, spans).groupBy("symbol", "status", "n", "observed").count().selectExpr("symbol", "status", "n", "array_join(observed, ',')", "count").collect()}
    assert got == {
        ("s", "observed", n // 2 + n // 20, "x"): n // 4, ("no", "symbol_not_found", 0, ""): n // 4, (None, "observed", n, "x"): n // 4,
        ("s", "incompatible", 0, ""): n // 12, ("no", "incompatible", 0, ""): n // 12, (None, "incompatible", 0, ""): n // 12,
    }
    assert time.time() - began < 100  # of 3.6 billion pairs


def test_contract_of_several_kinds(spark):
    made = spark.createDataFrame([(1, "iframe_url", 1, "a", "s"), (1, "api_constant", 1, "a", "s"), (1, None, 1, "a", "s"), (2, "route_name", 1, "b", None)], "contract long, kind string, repository int, path string, symbol string")
    seen = spark.createDataFrame([(1, "a", "s", 1, "iframe_src", "v"), (1, "a", "s", 1, "api_base_url", "w"), (1, "a", None, 9, None, None)], "repository int, path string, name string, line long, type string, value string")
    spans = spark.createDataFrame([], "repository int, path string, declared string, line long, end_line long")
    assert sorted(tuple(r) for r in contracts.locate_contracts(spark, made, seen, spans).collect()) == [(1, 1, "a", "s", "ambiguous", 2, ["v", "w"]), (2, 1, "b", None, "path_not_found", 0, [])]


def test_masked_values_are_not_sent_around(spark):
    df = spark.createDataFrame([(1, '{"b": [1, {"token": 2}], "a": {"c": []}}'), (2, None)], "k long, j string")
    got = jsonwalk.redacted_json(spark, df, "k", "j")
    assert "Broadcast" not in plan(got) and {r.k: r.redacted for r in got.collect()} == {1: '{"a":{"c":[]},"b":[1,{"token":"[redacted]"}]}', 2: None}


def test_routes_are_not_sent_around(spark):
    files = spark.createDataFrame([("m.go", 'r.Route("/a", func(r chi.Router) {\n r.Get("/b", h)\n})')], "path string, text string")
    got = prefixes.full_routes(spark, *routers.go_tables(files))
    assert "Broadcast" not in plan(got) and [r.url for r in got.collect()] == ["/a/b"]


def test_components_are_not_sent_around(spark, monkeypatch):
    plans = []
    save = Stage.save
    monkeypatch.setattr(Stage, "save", lambda self, df: plans.append(plan(df)) or save(self, df))
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4), (4, 5), (5, 4), (6, 1)], "a long, b long")
    got = graph.strong_components(spark, edges, "a", "b")
    assert sorted(tuple(r) for r in got.collect()) == [(1, 1), (2, 1), (3, 1), (4, 4), (5, 4)]
    assert len(plans) > 5 and not any("Broadcast" in x for x in [*plans, plan(got)])


def test_rows_of_a_hot_value_are_not_sorted_in_one_task(spark, monkeypatch):
    plans = []
    save = Stage.save
    monkeypatch.setattr(Stage, "save", lambda self, df: plans.append(plan(df)) or save(self, df))
    df = spark.range(1000).selectExpr("id AS ord", "'x' AS s", "id % 500 AS t", "CAST(NULL AS STRING) AS u")
    got = relations.interacting_caps(spark, df, "ord", {"s": 30, "t": 1, "u": 25}, 20)
    why = {r.ord: r.drop_reason for r in got.collect()}
    assert why == {i: None if i < 20 else "total" for i in range(1000)}
    assert all(x.count("Window [") <= x.count("WindowGroupLimit") for x in [*plans, plan(got)]) and sum(x.count("Window [") for x in plans) > 5
    none = relations.interacting_caps(spark, df, "ord", {"s": 30, "t": 0}, 20)
    assert {r.drop_reason for r in none.collect()} == {"t"}


def test_a_task_of_a_call_trace_has_few_rows(spark, sf, monkeypatch):
    wanted = {tuple(r) for r in report_queries.call_trace(spark, sf).collect()}
    monkeypatch.setattr(store, "PART_ROWS", 100)
    got = report_queries.call_trace(spark, sf)
    parts = got.rdd.glom().map(len).collect()
    assert {tuple(r) for r in got.collect()} == wanted and len(wanted) > 3000 and max(parts) < 250


def test_rows_of_one_file_are_dealt(spark, sf):
    for df in (code_tables.code_files(spark, sf), parser_queries.sources(spark, sf), route_queries._files(spark, sf, "", route_queries._named("a", ""))):
        assert df.rdd.getNumPartitions() >= 8
