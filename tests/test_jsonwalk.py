"""The walk through JSON and the masked value against Python's own."""

import json
import random

from sparkloom.operators import jsonwalk

NAMES = ["a", "b c", 'q"', "token", "Api-Key", "é", "n\n", "10", "2", "user_password"]


def value(rng, depth):
    kind = rng.randrange(8 if depth else 6)
    if kind >= 6:
        inner = [value(rng, depth - 1) for _ in range(rng.randrange(12 if kind == 7 else 4))]
        return inner if kind == 7 else {rng.choice(NAMES): x for x in inner}
    return [None, True, rng.randrange(-9, 9), 'te"xt \\ é\n', "password: abc, token=Bearer x; rest", "x" * 300][kind]


def leaves(v, path=()):
    if isinstance(v, dict) and v:
        return [x for k in v for x in leaves(v[k], (*path, k))]
    if isinstance(v, list) and v:
        return [x for i, e in enumerate(v) for x in leaves(e, (*path, str(i)))]
    kind = {dict: "object", list: "array", str: "string", bool: "boolean", type(None): "null"}.get(type(v), "number")
    return [(path, kind, v if isinstance(v, str) else json.dumps(v))]


def masked(v, name=None):
    import re

    if name is not None and any(w in name.lower().replace("-", "_") for w in jsonwalk.SECRET_NAMES):
        return "[redacted]"
    if isinstance(v, dict):
        return {k: masked(v[k], k) for k in sorted(v, key=str.encode)}
    if isinstance(v, list):
        return [masked(x) for x in v]
    if isinstance(v, str):
        v = re.sub(jsonwalk.SECRET_TEXT, r"\1=[redacted]", v)
        return v if len(v) <= 240 else v[:237] + "..."
    return v


def test_walks_of_random_values(spark):
    rng = random.Random(6)
    values = [value(rng, 6) for _ in range(120)] + [{}, [], "s", None, 5, {"a": {}}]
    deep = {"x": 1}
    for i in range(60):
        deep = {"d": deep, "l": [i]} if i % 2 else [deep]
    values.append(deep)
    rows = [(i, json.dumps(v, ensure_ascii=False)) for i, v in enumerate(values)] + [(900, '{"a": '), (901, None), (902, "")]
    df = spark.createDataFrame(rows, "k long, j string")
    got = {}
    for r in jsonwalk.json_leaves(spark, df, "k", "j").collect():
        got.setdefault(r.k, []).append((tuple(r.path), r.kind, r.value))
    for i, v in enumerate(values):
        assert sorted(got.pop(i)) == sorted(leaves(v)), v
    assert got == {900: [((), "error", None)], 902: [((), "error", None)]}
    for r in jsonwalk.redacted_json(spark, df, "k", "j").collect():
        assert r.redacted == (None if r.k >= 900 else json.dumps(masked(values[r.k]), ensure_ascii=False, separators=(",", ":"))), values[r.k] if r.k < 900 else r


def test_depth_and_nothing(spark):
    df = spark.createDataFrame([(1, '{"a": {"b": {"c": 1}}}')], "k long, j string")
    assert [(r.path, r.kind, r.value) for r in jsonwalk.json_leaves(spark, df, "k", "j", max_depth=2).collect()] == [(["a", "b"], "object", '{"c":1}')]
    assert jsonwalk.json_leaves(spark, df.where("false"), "k", "j").count() == 0 and jsonwalk.redacted_json(spark, df.where("false"), "k", "j").count() == 0
