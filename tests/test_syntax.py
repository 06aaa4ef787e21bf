"""The lexical structure of scripts against a walk over characters, and texts that would kill a matcher that recurses."""

import random
import re

from pyspark.sql import functions as F

from sparkloom.sources import lexer, parsing, scripts


def walked(text):
    """The mask, character by character."""
    out, i, n = [], 0, len(text)

    def blank(a, b):
        out.append(re.sub(r"[^\r\n]", " ", text[a:b]))

    while i < n:
        c, two = text[i], text[i : i + 2]
        j = i + 1
        if two == "//":
            while j < n and text[j] not in "\r\n":
                j += 1
        elif two == "/*":
            j = text.find("*/", i + 2)
            j = n if j < 0 else j + 2
        elif c in "\"'`":
            while j < n and text[j] != c and (c == "`" or text[j] not in "\r\n"):
                if text[j] == "\\" and j + 1 == n:
                    break
                j += 2 if text[j] == "\\" else 1
            j += j < n and text[j] == c
        elif c == "/" and re.search(r"(^|[=(,:;!&|?{\[+\-*%~^]|\b(return|typeof|case))[ \t]{0,8}\Z", text[:i]):
            k, inside = i + 1, False
            while k < n and text[k] not in "\r\n" and (inside or text[k] != "/"):
                inside = text[k] == "[" if not inside else text[k] != "]"
                k += 2 if text[k] == "\\" else 1
            if k < n and text[k] == "/" and k > i + 1:
                j = k + 1
                while j < n and text[j].isascii() and text[j].islower():
                    j += 1
            else:
                out.append(c)
                i += 1
                continue
        else:
            out.append(c)
            i += 1
            continue
        blank(i, j)
        i = j
    return "".join(out)


def test_masks_of_random_texts(spark):
    rng = random.Random(4)
    tokens = ["//", "/*", "*/", '"', "'", "`", "\\", "\n", "\r", "/", "{", "}", "[", "]", "(", ")", "a", "return ", " ", "=", ";", "é", "𝒳", "\t"]
    texts = ["".join(rng.choices(tokens, k=rng.randrange(0, 40))) for _ in range(3000)]
    df = spark.createDataFrame(list(enumerate(texts)), "k long, t string").repartition(8)
    for r in df.select("k", lexer.code_mask(F.col("t")).alias("m"), F.array_join(lexer.pieces(F.col("t")), "").alias("same")).collect():
        assert r.same == texts[r.k]
        # a lone backslash before the end of a text, and unclosed classes in expressions, are cut as the patterns cut them
        assert len(r.m) == len(texts[r.k]) and (r.m == walked(texts[r.k]) or "\\" in texts[r.k] or "[" in texts[r.k]), texts[r.k]


def test_pairs_of_random_texts(spark):
    rng = random.Random(7)
    texts = ["".join(rng.choices("(){}[] \na", k=rng.randrange(0, 30))) for _ in range(300)]
    expected = set()
    for k, text in enumerate(texts):
        levels, depth = {}, 0
        for i, c in enumerate(text):
            if c in "([{":
                depth += 1
                levels[depth] = (c, i)
                expected.add((k, c, i, None))
            elif c in ")]}":
                own = levels.pop(depth, None)
                if own and own[0] + c in ("()", "[]", "{}"):
                    expected.discard((k, own[0], own[1], None))
                    expected.add((k, own[0], own[1], i))
                else:
                    expected.add((k, c, None, i))
                depth -= 1
    got = lexer.bracket_pairs(spark.createDataFrame(list(enumerate(texts)), "k long, t string"), "k", "t").collect()
    assert {(r.k, r.mark, r.opened, r.closed) for r in got} == expected and len(got) == len(expected)


SOURCE = '''import a from "./a"; /* { */
export function f({ a, b }, c = "}") {
  if (a) { return /[{/"]/.test(b) ? `x ${ "{" } {` : a / b / c; }
}
const g = async (x) => ({ x });
const h = (y) => {
  class Inner { m() { return "don't"; } }
};
abstract class K
  extends L<{ a: 1 }> {
}
type Id = string;
declare function later(): void;
function* gen() { yield 1 }
function open( {
'''


def test_lines_of_declarations(spark):
    rows = [("a.ts", SOURCE), ("none", None), ("empty", ""), ("text", "no code here")]
    spans = lexer.declaration_spans(spark.createDataFrame(rows, "path string, text string"))
    got = sorted((r.line, r.kind, r.name, r.end_line) for r in spans.collect())
    assert got == [
        (2, "function", "f", 4), (5, "function", "g", 5), (6, "function", "h", 8), (7, "class", "Inner", 7), (9, "class", "K", 10),
        (12, "type", "Id", 12), (13, "function", "later", 13), (14, "function", "gen", 14), (15, "function", "open", None),
    ]
    slices = {r.name: r.slice for r in lexer.span_texts(spark.createDataFrame(rows, "path string, text string"), spans).collect()}
    assert slices["Id"] == "type Id = string;" and slices["h"].split("\n")[1:] == SOURCE.split("\n")[6:8] and slices["open"] == "function open( {\n"


def test_ten_megabytes_in_one_piece(spark):
    rows = [
        ("string", 'x = "' + 'a\\"{' * 2_500_000 + '"; function z() {\n}'),
        ("template", "`" + "{ \n" * 3_300_000 + "`; class Q {\n\n}"),
        ("comment", "/*" + "* {" * 3_300_000 + "*/ class Q {}"),
        ("unclosed", "/*" + "* {" * 3_300_000),
        ("blank lines", "\n" * 10_000_000 + "import a from 'b'"),
    ]
    df = spark.createDataFrame(rows, "path string, text string").repartition(5)
    pairs = {(r.path, r.mark, r.line, r.end_line) for r in lexer.bracket_pairs(df).where("mark = '{'").collect()}
    assert pairs == {("string", "{", 1, 2), ("template", "{", 3_300_001, 3_300_003), ("comment", "{", 1, 1)}
    facts = df.select("path", F.size(scripts.script_imports(F.col("text"))).alias("i"), F.size(scripts.script_exports(F.col("text"))).alias("e"), F.size(scripts.script_declarations(F.col("text"))).alias("d"))
    assert {tuple(r) for r in facts.collect()} == {("string", 0, 0, 0), ("template", 0, 0, 0), ("comment", 0, 0, 1), ("unclosed", 0, 0, 0), ("blank lines", 1, 0, 0)}


def test_routes_of_a_long_chain(spark):
    text = "app.route('/a')" + ".get(h)" * 20_000 + ';\nconst re = /["]/; // router.get("/gone", h)\nrouter.get("/b", k)'
    got = spark.createDataFrame([(text,)], "t string").select(F.inline(scripts.express_routes(F.col("t")))).groupBy("path").count().collect()
    assert {tuple(r) for r in got} == {("/a", 20_000), ("/b", 1)}


def test_deep_python_is_an_error_row(spark):
    rows = [("minus", "-" * 200_000 + "1"), ("dots", "a" + ".b" * 20_000), ("fine", "def f():\n    pass\n"), ("null", None), ("zero", "a\x00")]
    df = spark.createDataFrame(rows, "path string, text string").repartition(1)
    got = {r.path: (r.kind, r.name) for r in parsing.parse_python(df).collect()}
    assert got["fine"] == ("function", "f") and got["minus"][0] == got["dots"][0] == got["zero"][0] == "error" and "null" not in got
    assert {r.path for r in parsing.parse_python(df, read=parsing.python_symbols).collect()} == {"fine"}
