"""Queries on the lexical structure of the scripts among the stand-in sources, with SQL that cuts each text by recursion."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources import lexer
from .parser_queries import TEMPLATES, _of, _quoted, sources

_SCRIPT = r"\.(ts|tsx|js|jsx)$"


def code_masks(spark, sf_dir):
    """A digest of each script's mask, and of its text without comments."""
    text = F.col("text")
    return _of(sources(spark, sf_dir), _SCRIPT).select("file_id", F.md5(lexer.code_mask(text)).alias("mask"), F.md5(lexer.without_comments(text)).alias("bare"), F.char_length(lexer.code_mask(text)).cast("long").alias("n"))


def bracket_pairs(spark, sf_dir):
    return lexer.bracket_pairs(_of(sources(spark, sf_dir), _SCRIPT), "file_id")


def declaration_spans(spark, sf_dir):
    """Declarations with their lines, and a digest of these lines."""
    f = _of(sources(spark, sf_dir), _SCRIPT)
    spans = lexer.span_texts(f, lexer.declaration_spans(f, "file_id"), "file_id")
    return spans.withColumn("slice", F.md5("slice"))


# --- SQL: each step of the recursion takes one piece from the front of a text

_FILES = ", ".join(f"({i}, {_quoted(text)})" for i, (name, text) in enumerate(TEMPLATES) if name.rpartition(".")[2] in ("ts", "tsx", "js", "jsx"))
_PIECE = r"""^(?://[^\r\n]*|/\*(?:[^*]|\*+[^*/])*(?:\*+/|\**$)|"(?:[^"\\\r\n]|\\(?s:.))*"?|''(?:[^''\\\r\n]|\\(?s:.))*''?|`(?:[^`\\]|\\(?s:.))*`?|[^"''`/]+|/)"""
_EXPRESSION = r"^/(?:[^/\\\[\r\n]|\\.|\[(?:[^\]\\\r\n]|\\.)*\])+/[a-z]*"
_BEFORE = r"(?:[=(,:;!&|?{\[+*%~^-]|\b(?:return|typeof|case))[ \t]*$"
_MASKS = rf"""WITH RECURSIVE files AS (
  SELECT k AS file_id, replace(replace(replace(t, '@A@', a), '@B@', b), '@U@', upper(a[1]) || a[2:]) AS text
  FROM (SELECT p_partkey AS k, string_split(p_name, ' ')[1] AS a, string_split(p_name, ' ')[2] AS b FROM part) JOIN (VALUES {_FILES}) AS f(i, t) ON k % {len(TEMPLATES)} = i
),
pieces AS (
  SELECT file_id, text, 1 AS pos, '' AS p, false AS expression FROM files
  UNION ALL
  SELECT file_id, text, pos + length(q), q, e FROM (
    SELECT file_id, text, pos, e, CASE WHEN e THEN regexp_extract(substr(text, pos), '{_EXPRESSION}') ELSE regexp_extract(substr(text, pos), '{_PIECE}') END AS q FROM (
      SELECT *, substr(text, pos, 1) = '/' AND substr(text, pos + 1, 1) NOT IN ('/', '*') AND (trim(substr(text, 1, pos - 1)) = '' OR regexp_matches(substr(text, greatest(1, pos - 16), least(16, pos - 1)), '{_BEFORE}'))
        AND regexp_matches(substr(text, pos), '{_EXPRESSION}') AS e FROM (SELECT file_id, text, pos FROM pieces WHERE pos <= length(text))))
),
cut AS (SELECT file_id, pos - length(p) AS pos, p, p[:2] IN ('//', '/*') AS comment, expression OR p[1] IN ('"', '''', '`') AS literal FROM pieces WHERE p <> ''),
masks AS (
  SELECT file_id, string_agg(CASE WHEN comment OR literal THEN regexp_replace(p, '[^\r\n]', ' ', 'g') ELSE p END, '' ORDER BY pos) AS mask,
    string_agg(CASE WHEN comment THEN regexp_replace(p, '[^\r\n]', ' ', 'g') ELSE p END, '' ORDER BY pos) AS bare FROM cut GROUP BY file_id
)"""
_EVENTS = rf"""{_MASKS},
events AS (
  SELECT file_id, i - 1 AS pos, mark, line, mark IN ('(', '[', '{{') AS opens, sum(CASE WHEN mark IN ('(', '[', '{{') THEN 1 WHEN mark = ';' THEN 0 ELSE -1 END) OVER (PARTITION BY file_id ORDER BY i) AS after
  FROM (SELECT file_id, i, mask[i] AS mark, length(mask[:i]) - length(replace(mask[:i], chr(10), '')) + 1 AS line FROM masks, unnest(range(1, length(mask) + 1)) AS u(i)) WHERE mark IN ('(', ')', '[', ']', '{{', '}}', ';')
),
brackets AS (SELECT *, CASE WHEN opens THEN after ELSE after + 1 END AS depth FROM events WHERE mark <> ';'),
paired AS (SELECT *, lead({{'pos': pos, 'mark': mark, 'line': line}}) OVER w AS next, lag(mark) OVER w AS before FROM brackets WINDOW w AS (PARTITION BY file_id, depth ORDER BY pos))"""

SQL = {
    "code_masks": f"{_MASKS} SELECT file_id, md5(mask) AS mask, md5(bare) AS bare, length(mask) AS n FROM masks",
    "bracket_pairs": f"""{_EVENTS}
SELECT file_id, mark, depth::INT AS depth, pos AS opened, CASE WHEN fits THEN next.pos END AS closed, line, CASE WHEN fits THEN next.line END AS end_line FROM (SELECT *, coalesce(mark || next.mark IN ('()', '[]', '{{}}'), false) AS fits FROM paired) WHERE opens
UNION ALL SELECT file_id, mark, depth::INT, NULL, pos, line, line FROM paired WHERE NOT opens AND NOT coalesce(before || mark IN ('()', '[]', '{{}}'), false)""",
    "declaration_spans": rf"""{_EVENTS},
lines AS (SELECT file_id, n, s, sum(length(s) + 1) OVER (PARTITION BY file_id ORDER BY n) - length(s) - 1 AS pos FROM (SELECT file_id, unnest(string_split(mask, chr(10))) AS s, unnest(range(1, len(string_split(mask, chr(10))) + 1)) AS n FROM masks)),
told AS (
  SELECT file_id, n, pos, regexp_extract(s, '^\s*(?:export\s+)?(?:default\s+)?(?:declare\s+)?(?:(?:abstract|async)\s+)?(?:(function)\s*\*\s*|(function|class|interface|type|enum|namespace)\s+)([A-Za-z_$][\w$]*)', ['f', 'k', 'd']) AS d,
    regexp_extract(s, '^\s*(?:export\s+)?(?:const|let|var)\s+([A-Za-z_$][\w$]*)\s*(?::[^=]+)?=\s*(?:async\s*)?(?:\(|[A-Za-z_$][\w$]*\s*=>|function\b)', 1) AS b FROM lines
),
declared AS (
  SELECT file_id, n, pos, CASE WHEN d.d <> '' AND d.f = '' THEN d.k ELSE 'function' END AS kind, greatest(d.d, b) AS name,
    coalesce((SELECT max_by(after, e.pos) FROM events e WHERE e.file_id = t.file_id AND e.pos < t.pos), 0) AS depth FROM told t WHERE d.d <> '' OR b <> ''
),
body AS (
  SELECT d.*, (SELECT min_by({{'pos': e.pos, 'mark': e.mark, 'line': e.line}}, e.pos) FROM events e WHERE e.file_id = d.file_id AND e.pos >= d.pos AND ((e.mark = '{{' AND e.after = d.depth + 1) OR (e.mark = ';' AND e.after = d.depth))) AS body FROM declared d
),
ended AS (
  SELECT b.*, CASE WHEN body.mark = ';' THEN body.line ELSE (SELECT CASE WHEN min_by(e.mark, e.pos) = '}}' THEN min(e.line) END FROM events e WHERE e.file_id = b.file_id AND e.pos > body.pos AND e.after = b.depth AND NOT e.opens AND e.mark <> ';') END AS end_line FROM body b
)
SELECT file_id, kind, name, n AS line, end_line, md5(array_to_string(string_split(text, chr(10))[n:coalesce(end_line, 1000000)], chr(10))) AS slice FROM ended JOIN files USING (file_id)""",
}

QUERIES = {f.__name__: f for f in (code_masks, bracket_pairs, declaration_spans)}
