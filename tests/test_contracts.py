"""Points in spans against a loop, and the states of contract locations."""

import random

from sparkloom.operators import contracts


def test_points_in_random_spans(spark):
    rng = random.Random(1)
    points = [(rng.choice("ab"), rng.randrange(-50, 300), i) for i in range(200)] + [(None, 5, 900), ("a", None, 901)]
    spans = [(rng.choice("abc"), s := rng.randrange(-60, 250), s + rng.choice([-3, 0, 1, 2, 7, 40, 300]), i) for i in range(80)] + [("a", None, 5, 800), ("a", 5, None, 801), (None, 1, 9, 802)]
    p, s = spark.createDataFrame(points, "f string, at long, p int"), spark.createDataFrame(spans, "f string, a long, b long, s int")
    got = sorted((r.p, r.s) for r in contracts.points_in_spans(p, s, ["f"], "at", "a", "b").collect())
    assert got == sorted((i, j) for f, x, i in points[:200] for g, a, b, j in spans[:80] if f == g and a <= x <= b)


def test_states_of_locations(spark):
    c = spark.createDataFrame(
        [("whole", "route_name", "r", "a.ts", None), ("named", "route_name", "r", "a.ts", "HOME"), ("inside", "api_constant", "r", "b.ts", "setup"), ("gone", "route_name", "r", "z.ts", None), ("other", "iframe_url", "r", "a.ts", None), ("nosym", "route_name", "r", "a.ts", "NOPE"), ("odd", "no_such_kind", "r", "a.ts", None), ("null", None, None, "a.ts", None)],
        "contract string, kind string, repository string, path string, symbol string",
    )
    r = spark.createDataFrame(
        [("r", "a.ts", "HOME", 3, "route_constant", "/h"), ("r", "a.ts", None, 9, "route_constant", "/x"), ("r", "b.ts", None, 5, "api_base_url", "u"), ("r", "b.ts", None, 6, "api_base_url", "u"), ("r", "b.ts", None, 50, "api_base_url", "v"), ("r", "b.ts", None, 5, "iframe_src", "w"), ("q", "b.ts", None, 5, "api_base_url", "n")],
        "repository string, path string, name string, line long, type string, value string",
    )
    s = spark.createDataFrame([("r", "b.ts", "setup", 4, 10), ("r", "b.ts", "other", 1, 99), ("r", "b.ts", "setup", 6, 7)], "repository string, path string, declared string, line long, end_line long")
    got = {x.contract: (x.status, x.n, x.observed) for x in contracts.locate_contracts(spark, c, r, s).collect()}
    assert got == {
        "whole": ("ambiguous", 2, ["/h", "/x"]), "named": ("observed", 1, ["/h"]), "inside": ("observed", 2, ["u"]), "gone": ("path_not_found", 0, []),
        "other": ("incompatible", 0, []), "nosym": ("symbol_not_found", 0, []), "odd": ("incompatible", 0, []), "null": ("path_not_found", 0, []),
    }
    assert contracts.locate_contracts(spark, c.where("false"), r, s).count() == 0 and contracts.locate_contracts(spark, c, r.where("false"), s.where("false")).where("status <> 'path_not_found'").count() == 0
