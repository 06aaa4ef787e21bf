"""Scripts as lexical pieces that keep every position: masks, bracket pairs and the lines that declarations span.

A text is cut into pieces that together are the text: comments, strings, templates, literals of regular expressions, and
what is between. All patterns are possessive, so the matcher runs in a loop and a string of any length needs no stack.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LINE_COMMENT = r"//[^\r\n]*+"
BLOCK_COMMENT = r"/\*(?:[^*]++|\*(?!/))*+(?:\*/|\z)"
#: A quote that its line doesn't close ends with the line; a template may span lines.
STRINGS = r""""(?:[^"\\\r\n]++|\\[\s\S])*+"?+|'(?:[^'\\\r\n]++|\\[\s\S])*+'?+|`(?:[^`\\]++|\\[\s\S])*+`?+"""
#: A slash begins a regular expression where a value may stand: after an operator, an opening bracket or a keyword.
VALUE_BEFORE = r"(?<=(?:\A|[=(,:;!&|?{\[+\-*%~^]|\b(?:return|typeof|case))[ \t]{0,8})"
EXPRESSION = rf"{VALUE_BEFORE}/(?:[^/\\\[\r\n]++|\\.|\[(?:[^\]\\\r\n]++|\\.)*+\])++/[a-z]*+"
PIECE = rf"""{LINE_COMMENT}|{BLOCK_COMMENT}|{STRINGS}|{EXPRESSION}|[^"'`/]++|/"""


def pieces(text: Column) -> Column:
    """The text as an array of pieces; joined they are the text again."""
    return F.regexp_extract_all(text, F.lit(PIECE), 0)


def _is_comment(piece: Column) -> Column:
    return piece.startswith("//") | piece.startswith("/*")


def _is_literal(piece: Column) -> Column:
    return piece.rlike(r"""\A["'`]""") | (piece.startswith("/") & ~_is_comment(piece) & (F.char_length(piece) > 1))


def _blank(piece: Column) -> Column:
    return F.regexp_replace(piece, r"[^\r\n]", " ")


def without_comments(text: Column) -> Column:
    """The text with blanks for comments, so positions and lines stay."""
    return F.array_join(F.transform(pieces(text), lambda p: F.when(_is_comment(p), _blank(p)).otherwise(p)), "")


def plain_strings(text: Column) -> Column:
    """The text with blanks for comments, templates, regular expressions, and strings that hold a quote.

    What still looks like a statement with a quoted name in it is one.
    """
    hidden = lambda p: _is_comment(p) | (_is_literal(p) & ~p.rlike(r"""\A(?:"[^"'`]*+"|'[^"'`]*+')\z"""))
    return F.array_join(F.transform(pieces(text), lambda p: F.when(hidden(p), _blank(p)).otherwise(p)), "")


def code_mask(text: Column) -> Column:
    """The text with blanks for all that is no code: comments, strings, templates and regular expressions.

    As long as the text, with the same line ends: a character's place in it is its place in the text. Null stays null.
    """
    return F.array_join(F.transform(pieces(text), lambda p: F.when(_is_comment(p) | _is_literal(p), _blank(p)).otherwise(p)), "")


def _events(files: DataFrame, key: str, text: str, marks: str) -> DataFrame:
    """``key, at, line, mark, depth`` of the marks in the code: brackets have the depth inside them, others that around."""
    # the rest after the last mark is a match too, or every place in it would be tried
    cut = F.regexp_extract_all(code_mask(F.col(text)), F.lit(rf"[^{marks}]*+(?:[{marks}]|\z)"), 0)
    small = F.transform(F.filter(cut, lambda p: p.rlike(rf"[{marks}]\z")), lambda p: F.struct(F.char_length(p).alias("size"), (F.char_length(p) - F.char_length(F.replace(p, F.lit("\n")))).alias("lines"), F.right(p, F.lit(1)).alias("mark")))
    rows = files.select(F.col(key), F.posexplode(small).alias("n", "p")).select(key, "n", "p.*")
    w = Window.partitionBy(key).orderBy("n")
    opened, closed = F.col("mark").isin(*"([{"), F.col("mark").isin(*")]}")
    return rows.select(
        key,
        (F.sum("size").over(w) - 1).cast("long").alias("at"),
        (F.sum("lines").over(w) + 1).cast("long").alias("line"),
        "mark",
        (F.sum(F.when(opened, 1).when(closed, -1).otherwise(0)).over(w) + closed.cast("int")).cast("int").alias("depth"),
    )


def bracket_pairs(files: DataFrame, key: str = "path", text: str = "text") -> DataFrame:
    """``key, mark, depth, opened, closed, line, end_line`` of all brackets in the code, by offset in characters.

    A closing bracket belongs to the opening one before it of the same depth; ``closed`` is null where there is none or
    one of another kind, and ``opened`` where nothing opened what is closed. Depths are prefix sums over a file's brackets and pairs are
    neighbours in (file, depth), so a file of any length is a sort, not a walk; null texts have none. Equal keys are one
    file: give them different ones.
    """
    e = _events(files, key, text, r"(){}\[\]")
    w = Window.partitionBy(key, "depth").orderBy("at")
    opens = F.col("mark").isin(*"([{")
    near = e.withColumns({"next": F.lead(F.struct("at", "line", "mark")).over(w), "before": F.lag("mark").over(w)})
    fits = F.translate("mark", "([{", ")]}") == F.col("next.mark")
    own = near.where(opens).select(key, "mark", "depth", F.col("at").alias("opened"), F.when(fits, F.col("next.at")).alias("closed"), "line", F.when(fits, F.col("next.line")).alias("end_line"))
    fitted = F.coalesce(F.translate("before", "([{", ")]}") == F.col("mark"), F.lit(False))
    lost = near.where(~opens & ~fitted).select(key, "mark", "depth", F.lit(None).cast("long").alias("opened"), F.col("at").alias("closed"), F.col("line"), F.col("line").alias("end_line"))
    return own.unionByName(lost)


_NAME = r"[A-Za-z_$][\w$]*+"
DECLARED = rf"^\s*+(?:export\s++)?(?:default\s++)?(?:declare\s++)?(?:(?:abstract|async)\s++)?(function\s*+\*?|class|interface|type|enum|namespace)\s*+(?<=[\s*])({_NAME})"
BOUND = rf"^\s*+(?:export\s++)?(?:const|let|var)\s++({_NAME})\s*+(?::[^=]++)?=\s*+(?:async\s*+)?(?:\(|{_NAME}\s*+=>|function\b)"


def declaration_spans(files: DataFrame, key: str = "path", text: str = "text") -> DataFrame:
    """``key, kind, name, line, end_line`` of functions, classes, types and bound functions, from the first to the last line.

    A declaration ends with the bracket that closes its body; its body is the first brace at its own depth, unless a
    semicolon comes first, where it ends without a body. Braces of parameters and of strings are no bodies. What is
    never closed has a null ``end_line``. Line ends are \\n, \\r before them is space.
    """
    lines = files.select(F.col(key), F.posexplode(F.split(code_mask(F.col(text)), "\n")).alias("n", "s"))
    told = lines.select(
        key, "n", "s", F.char_length("s").alias("size"),
        F.regexp_extract("s", DECLARED, 1).alias("k"), F.regexp_extract("s", DECLARED, 2).alias("d"), F.regexp_extract("s", BOUND, 1).alias("b"),
    )
    starts = told.withColumn("at", (F.sum(F.col("size") + 1).over(Window.partitionBy(key).orderBy("n")) - F.col("size") - 1).cast("long")).where("d <> '' OR b <> ''")
    kind = F.when(F.col("d") == "", "function").otherwise(F.regexp_extract("k", "[a-z]++", 0))
    starts = starts.select(key, "at", (F.col("n") + 1).cast("long").alias("line"), F.lit("declared").alias("mark"), F.struct(kind.alias("kind"), F.greatest("d", "b").alias("name")).alias("what"))
    # semicolons and declarations have the depth of the brackets around them; add one to meet those they may own
    marks = _events(files, key, text, r"(){};\[\]").withColumn("what", F.lit(None).cast(starts.schema["what"].dataType))
    every = marks.withColumn("depth", F.when(F.col("mark") == ";", F.col("depth") + 1).otherwise(F.col("depth"))).unionByName(starts.withColumn("depth", F.lit(None).cast("int")))
    order = Window.partitionBy(key).orderBy("at", F.col("what").isNull())
    closes = F.col("mark").isin(*")]}")
    around = F.last(F.when(closes | (F.col("mark") == ";"), F.col("depth") - 1).otherwise(F.col("depth")), ignorenulls=True).over(order)
    placed = every.withColumn("depth", F.coalesce("depth", F.coalesce(around, F.lit(0)) + 1))
    w = Window.partitionBy(key, "depth").orderBy("at", F.col("what").isNull()).rowsBetween(1, Window.unboundedFollowing)
    ended = placed.withColumn("end", F.first(F.when(closes, F.struct("line", "mark")), ignorenulls=True).over(w))
    body = F.first(F.when(F.col("mark").isin("{", ";"), F.struct("mark", "line", "end")), ignorenulls=True).over(w)
    found = ended.withColumn("body", body).where("what IS NOT NULL")
    last = F.when(F.col("body.mark") == ";", F.col("body.line")).when(F.col("body.end.mark") == "}", F.col("body.end.line"))
    return found.select(key, "what.kind", "what.name", "line", last.alias("end_line"))


def span_texts(files: DataFrame, spans: DataFrame, key: str = "path", text: str = "text") -> DataFrame:
    """``spans`` with ``slice``, the lines of the text from ``line`` to ``end_line`` (to the end where that is null)."""
    lined = F.split(F.col(text), "\n")
    n = F.coalesce(F.col("end_line"), F.size(lined).cast("long")) - F.col("line") + 1
    return spans.join(files.select(key, text), key).withColumn("slice", F.array_join(F.slice(lined, F.col("line").cast("int"), n.cast("int")), "\n")).drop(text)
