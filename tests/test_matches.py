"""Tests matched to sources against a loop over all pairs, parts of strings, and imports that are null."""

import random
from pathlib import PurePosixPath

from pyspark.sql import functions as F

from sparkloom.operators import relations, resolution, substrings

SCHEMA = "path string, imports array<string>, terms array<string>, selected boolean"


def normal(text):
    return text.replace("\\", "/").replace("_", " ").replace("-", " ").lower()


def stem(path):
    return PurePosixPath(path).stem


def is_test(path):
    low = path.lower()
    s = stem(low)
    return low.startswith("tests/") or "/tests/" in low or ".test." in low or ".spec." in low or s.startswith("test_") or s.endswith((".test", ".spec"))


def plain(rows):
    out = {}
    for test, imports, _, _ in rows:
        if not is_test(test):
            continue
        s = stem(test)
        s = s[:-5] if s.lower().endswith((".test", ".spec")) else s
        hint, best = normal(" ".join([test, *(imports or [])])), None
        for source, _, terms, chosen in rows:
            if is_test(source):
                continue
            name, own = PurePosixPath(source).name, stem(source)
            exact = s in (own, f"test_{own}")
            module = source[:-3].replace("/", ".") if source.endswith(".py") else source.replace("/", ".")
            said = any(normal(n) and normal(n) in hint for n in (source, module, name, own))
            if not (exact or said):
                continue
            a, b = str(PurePosixPath(test).parent).strip("."), str(PurePosixPath(source).parent).strip(".")
            left, right = [x for x in a.split("/") if x and x != "__tests__"], [x for x in b.split("/") if x]
            shared = next((i for i, (x, y) in enumerate(zip(left, right, strict=False)) if x != y), min(len(left), len(right)))
            score = 300 * exact + 180 * said + (80 if a == b else min(45, 15 * shared)) + 40 * bool(chosen) + min(len(terms), 15)
            key = (score, exact, bool(chosen), -len(source), source)
            best = max(best, key) if best else key
        if best:
            out[test] = (best[4], best[0], best[1])
    return out


def matched(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    return {r.test: (r.source, r.score, r.exact) for r in relations.best_source_of_tests(df, "path", F.col("imports"), F.col("terms"), F.col("selected")).collect()}


def test_best_sources_of_random_files(spark):
    rng = random.Random(9)
    folders = ["", "app/", "app/models/", "src/a/b/c/", "src/a/b/d/", "tests/", "app/__tests__/", "src/a/"]
    stems = ["user", "users", "user_service", "User-card", "index", "a", "db", "é", "login", "x.y", "test_user"]
    for _ in range(3):
        paths = {rng.choice(folders) + rng.choice(["", "", "test_"]) + rng.choice(stems) + rng.choice(["", ".test", ".spec"]) + rng.choice([".py", ".ts"]) for _ in range(60)}
        rows = [(p, rng.choice([None, [], ["app.models.user"], ["./user_service", "react"], ["../User-card"]]), ["t"] * rng.randrange(20), rng.choice([None, False, True])) for p in sorted(paths)]
        assert matched(spark, rows) == plain(rows)


def test_literal_matches(spark):
    """Points by the fixed values: name 300, spoken of 180, same folder 80, 15 a shared folder, selected 40, terms up to 15."""
    rows = [
        ("tests/test_users.py", ["app.user"], [], False), ("app/user.py", [], ["app", "user"], False),
        ("src/card.ts", [], ["src", "card"], True), ("src/card.test.ts", ["./card"], [], False),
        ("lib/test_none.py", [], [], False), (None, [], [], False),
    ]
    assert matched(spark, rows) == {"tests/test_users.py": ("app/user.py", 182, False), "src/card.test.ts": ("src/card.ts", 300 + 180 + 80 + 40 + 2, True)}


def test_one_stem_in_many_folders_makes_few_rows(spark):
    rows = [(f"a/f{i}/index.ts", [], [], False) for i in range(400)] + [(f"a/f{i}/index.test.ts", ["./index"], [], False) for i in range(400)]
    assert {t: s[0] for t, s in matched(spark, rows).items()} == {f"a/f{i}/index.test.ts": f"a/f{i}/index.ts" for i in range(400)}


def test_parts_of_words(spark):
    rng = random.Random(3)
    words = ["".join(rng.choices("abé. ", k=rng.randrange(0, 9))) for _ in range(200)]
    terms = ["".join(rng.choices("abé.", k=rng.randrange(0, 5))) for _ in range(60)]
    t, w = spark.createDataFrame([(x,) for x in [*terms, None]], "term string"), spark.createDataFrame([(x,) for x in [*words, None]], "word string")
    assert {tuple(r) for r in substrings.words_with(t, w).collect()} == {(a, b) for a in terms for b in words if a and a in b}
    needles = spark.createDataFrame([(x,) for x in [*words[:50], None, " "]], "needle string")
    texts = spark.createDataFrame(list(enumerate(" ".join(rng.choices(words, k=4)) for _ in range(50))), "k long, t string")
    got = {tuple(r) for r in substrings.texts_with(needles, texts, "k", "t").collect()}
    assert got == {(n, r.k) for n in words[:50] for r in texts.collect() if n.strip() and n in r.t}


def test_no_import_is_lost(spark):
    imports = spark.createDataFrame([("a/x.ts", "./y", 1), ("a/x.ts", None, 2), (None, "./y", 3), ("a/x.ts", "./y", 4), ("a/x.ts", "react", 5)], "path string, imported string, n int")
    files = spark.createDataFrame([("a/x.ts",), ("a/y.ts",), (None,)], "path string")
    got = {r.n: (r.resolved, r.status) for r in resolution.resolve_scripts(imports, files, "path", "imported", []).collect()}
    assert got == {1: ("a/y.ts", "relative"), 2: (None, "unresolved"), 3: (None, "unresolved"), 4: ("a/y.ts", "relative"), 5: (None, "external")}
