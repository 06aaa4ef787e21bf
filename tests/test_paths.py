from pyspark.sql import functions as F

from sparkloom.functions import normal, paths, relevance
from sparkloom.operators import relations, resolution


def all_of(spark, column_of, values):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string").select("i", column_of(F.col("v")).alias("x"))
    return [r.x for r in rows.orderBy("i").collect()]


def test_parts_of_odd_paths(spark):
    odd = ["", "a", "a/", "/a//b.py", "a\\b\\C.Ts", ".env", "a/.hidden", "x.tar.gz", None]
    assert all_of(spark, paths.name, odd) == ["", "a", "a", "b.py", "C.Ts", ".env", ".hidden", "x.tar.gz", ""]
    assert all_of(spark, paths.stem, odd)[:8] == ["", "a", "a", "b", "C", ".env", ".hidden", "x.tar"]
    assert all_of(spark, paths.extension, odd)[:8] == ["", "", "", "py", "ts", "", "", "gz"]
    assert all_of(spark, paths.is_relative_path, ["a/b", "/a", "../a", "a/../b", " a", "", "C:/x", ".", None]) == [True] + [False] * 8


def test_terms_and_roles(spark):
    assert all_of(spark, paths.identifier_terms, ["HTTPServerConfig2x", "src/useAuthToken.tsx", "a_b-CC", ""]) == [["http", "server", "config"], ["src", "use", "auth", "token"], ["cc"], []]
    assert all_of(spark, paths.frontend_role, ["src/pages/a.ts", "src/useX.ts", "src/userX.ts", "a/b.component.html", "x.py", "public/a.js", "a.test.ts"]) == ["page", "hook", "unknown", "template", "unknown", "asset", "test"]
    assert all_of(spark, paths.package_root, ["@a/b/c", "react/x", "./y"]) == ["@a/b", "react", "."]


def test_tasks_without_words(spark):
    assert relevance.task_terms("Fix the") == [] and relevance.task_phrases(["a", "b", "c"]) == ["a b", "b c", "a b c"]
    f = spark.createDataFrame([("src/login.py", ["f"], ["os"], ["GET"])], "p string, s array<string>, i array<string>, r array<string>")
    d = relevance.described(f, "p", "s", "i", "r").withColumn("roles", F.array(F.lit("page")))
    row = d.select(relevance.task_relevance("", F.col("p"), F.col("roles")).alias("none"), relevance.task_relevance("login", F.col("p"), F.col("roles")).alias("some"), relevance.candidate_score("").alias("c")).first()
    # name 6, bag 3, one shared term 1, directly shared 4
    assert (row.none, row.some, row.c) == (0, 14, 1)


def test_addresses_ports_and_bounds(spark):
    given = ["HTTP://A.B:80/", "https://u@h/x", "ws://127.0.0.1/x?y#z", "mailto:x", None, "http://h"]
    assert all_of(spark, normal.reference_url, given) == ["http://a.b:80", None, "ws://localhost/x?y#z", None, None, "http://h"]
    assert all_of(spark, normal.port_of, ["1", "65536", "0", "http://h:99/", "x", None]) == [1, None, None, 99, None, None]
    lists = spark.createDataFrame([([str(i) for i in range(n)],) for n in (2, 3, 5)], "v array<string>").select(relations.bounded_list(F.col("v"), 3, "items").alias("x")).collect()
    assert [r.x for r in lists] == [["0", "1"], ["0", "1", "2"], ["0", "1", "...and 3 more items"]]


def test_imports_that_leave_the_root(spark):
    files = spark.createDataFrame([("a/x.ts",), ("a/b/index.tsx",), ("y.js",)], "path string")
    rows = [("a/x.ts", "./b"), ("a/x.ts", "../y"), ("a/x.ts", "../../y"), ("a/x.ts", "lodash"), ("y.js", "~/x"), ("y.js", "~/none"), ("y.js", "./a/x")]
    out = resolution.resolve_scripts(spark.createDataFrame(rows, "path string, imported string"), files, "path", "imported", [("~/*", "a/*")])
    got = {(r.path, r.imported): (r.resolved, r.status) for r in out.collect()}
    assert got == dict(zip(rows, [("a/b/index.tsx", "relative"), ("y.js", "relative"), (None, "unresolved"), (None, "external"), ("a/x.ts", "alias"), (None, "unresolved"), ("a/x.ts", "relative")], strict=True))
