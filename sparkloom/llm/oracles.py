"""DuckDB SQL for the queries that SQL can express, over whole tables."""

from __future__ import annotations

SPACE = r"' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

_SHINGLES = r"""
words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents
),
sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_distinct([w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] for i in range(1, len(w) - 1)]) END AS s
  FROM words
)"""

OP1 = rf"""
WITH words AS (
  SELECT doc_id, lang, source, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
),
windows AS (
  SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM words, unnest(range(1, len(w) - 1)) AS u(i) WHERE len(w) > 3
),
twice AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM windows),
covered AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM twice, (VALUES (0), (1), (2)) AS o(k) WHERE n > 1 GROUP BY doc_id),
lined AS (SELECT doc_id, list_filter(string_split(t, chr(10)), lambda x: trim(x, {SPACE}) <> '') AS l FROM words),
raw AS (
  SELECT doc_id, lang, source, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
    length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, len(l)::BIGINT AS n_lines,
    (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(c.n, 0)::BIGINT AS n_repeat_words
  FROM words JOIN lined USING (doc_id) LEFT JOIN covered c USING (doc_id)
),
rows AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
    CASE WHEN word_chars > 0 THEN floor(n_symbols * 1000000 / word_chars) ELSE 0 END::BIGINT AS symbol_ppm,
    CASE WHEN n_lines > 0 THEN floor(n_dup_lines * 1000000 / n_lines) ELSE 0 END::BIGINT AS dup_line_ppm,
    CASE WHEN n_words > 0 THEN floor(n_repeat_words * 1000000 / n_words) ELSE 0 END::BIGINT AS repeat_ppm,
    CASE WHEN n_words > 0 THEN floor(word_chars * 1000 / n_words) ELSE 0 END::BIGINT AS word_len_milli
  FROM raw
),
long AS (
  SELECT lang, source, feature, v, greatest(0, length(bin(v)) - 5) AS shift FROM (
    SELECT lang, source, 'symbol_ppm' AS feature, symbol_ppm AS v FROM rows WHERE NOT base_failed
    UNION ALL SELECT lang, source, 'dup_line_ppm', dup_line_ppm FROM rows WHERE NOT base_failed
    UNION ALL SELECT lang, source, 'repeat_ppm', repeat_ppm FROM rows WHERE NOT base_failed
    UNION ALL SELECT lang, source, 'word_len_milli', word_len_milli FROM rows WHERE NOT base_failed)
),
fine AS (SELECT lang, source, feature, shift * 16 + (v >> shift) AS bin, ((v >> shift) + 1 << shift) - 1 AS top, count(*) AS n FROM long GROUP BY ALL),
levels AS (
  SELECT 's' AS tag, lang, source, feature, bin, top, n FROM fine
  UNION ALL SELECT 'l', lang, NULL, feature, bin, top, sum(n) FROM fine GROUP BY ALL
  UNION ALL SELECT 'a', NULL, NULL, feature, bin, top, sum(n) FROM fine GROUP BY ALL
),
placed AS (
  SELECT *, sum(n) OVER (PARTITION BY tag, lang, source, feature ORDER BY bin) AS upto, sum(n) OVER (PARTITION BY tag, lang, source, feature) AS total,
    coalesce(sum(n) FILTER (bin = 0) OVER (PARTITION BY tag, lang, source, feature), 0) AS none,
    CASE feature WHEN 'symbol_ppm' THEN 0.01::DOUBLE WHEN 'dup_line_ppm' THEN 0.9::DOUBLE END AS share FROM levels
),
tails AS (
  SELECT tag, lang, source, feature, max(total) AS total, min(CASE WHEN upto >= 0.1::DOUBLE * total THEN top END) AS q10,
    min(CASE WHEN upto >= 0.5::DOUBLE * total THEN top END) AS q50, min(CASE WHEN upto >= 0.9::DOUBLE * total THEN top END) AS q90,
    min(CASE WHEN bin > 0 AND upto - none >= share * (total - none) THEN top END) AS least_some, max(total - none) AS positives,
    CASE feature WHEN 'symbol_ppm' THEN 0 WHEN 'dup_line_ppm' THEN 0 WHEN 'repeat_ppm' THEN 20000 ELSE 300 END AS more
  FROM placed GROUP BY tag, lang, source, feature
),
limits AS (
  SELECT tag, lang, source, feature, total >= 200 AND (feature NOT IN ('symbol_ppm', 'dup_line_ppm') OR q90 > 0 OR positives >= 20) AS tells, greatest(q90 + (q90 - q50) * 2 + more, CASE WHEN q90 > 0 OR positives >= 20 THEN least_some WHEN feature = 'symbol_ppm' THEN 5000 WHEN feature = 'dup_line_ppm' THEN 100000 END) AS top, q10 - (q50 - q10) * 2 - more AS low FROM tails),
chosen AS (
  SELECT s.lang, s.source, s.feature, CASE WHEN s.tells THEN s.top WHEN l.tells THEN l.top ELSE a.top END AS top,
    CASE WHEN s.tells THEN s.low WHEN l.tells THEN l.low ELSE a.low END AS low
  FROM (SELECT * FROM limits WHERE tag = 's') s
  JOIN (SELECT * FROM limits WHERE tag = 'l') l ON s.lang IS NOT DISTINCT FROM l.lang AND s.feature = l.feature
  JOIN (SELECT * FROM limits WHERE tag = 'a') a ON s.feature = a.feature
),
wide AS (
  SELECT lang, source, max(top) FILTER (feature = 'symbol_ppm')::BIGINT AS max_symbol_ppm, max(top) FILTER (feature = 'dup_line_ppm')::BIGINT AS max_dup_line_ppm,
    max(top) FILTER (feature = 'repeat_ppm')::BIGINT AS max_repeat_ppm, max(top) FILTER (feature = 'word_len_milli')::BIGINT AS max_word_len_milli,
    max(low) FILTER (feature = 'word_len_milli')::BIGINT AS min_word_len_milli
  FROM chosen GROUP BY lang, source
)
SELECT doc_id, n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words, base_failed, symbol_ppm, dup_line_ppm, repeat_ppm, word_len_milli,
  max_symbol_ppm, max_dup_line_ppm, max_repeat_ppm, max_word_len_milli, min_word_len_milli,
  NOT base_failed AND NOT (coalesce(symbol_ppm > max_symbol_ppm, false) OR coalesce(dup_line_ppm > max_dup_line_ppm, false)
    OR coalesce(repeat_ppm > max_repeat_ppm, false) OR coalesce(word_len_milli > max_word_len_milli, false)
    OR coalesce(word_len_milli < min_word_len_milli, false)) AS kept
FROM rows LEFT JOIN wide ON rows.lang IS NOT DISTINCT FROM wide.lang AND rows.source IS NOT DISTINCT FROM wide.source
"""

OP2 = f"""
WITH RECURSIVE {_SHINGLES},
pairs AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n
  FROM (SELECT doc_id, unnest(s) AS g FROM sets) a JOIN (SELECT doc_id, unnest(s) AS g FROM sets) b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL
),
links AS (
  SELECT a, b FROM pairs JOIN sets x ON x.doc_id = a JOIN sets y ON y.doc_id = b WHERE 100 * n >= 85 * (len(x.s) + len(y.s) - n)
),
both_ways AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach AS (SELECT a, b FROM both_ways UNION SELECT r.a, e.b FROM reach r JOIN both_ways e ON r.b = e.a)
SELECT doc_id, len(s)::BIGINT AS n_shingles, least(doc_id, coalesce(m, doc_id)) AS component_id, doc_id <= coalesce(m, doc_id) AS kept
FROM sets LEFT JOIN (SELECT a, min(b) AS m FROM reach GROUP BY a) ON a = doc_id
"""

OP3 = """
WITH RECURSIVE fine AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings
  WHERE label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM fine a JOIN fine b ON a.label = b.label AND len(a.v) = len(b.v) AND a.vec_id <> b.vec_id
  WHERE list_dot_product(a.v, b.v) / (sqrt(list_dot_product(a.v, a.v)) * sqrt(list_dot_product(b.v, b.v))) >= 0.93
),
reach AS (SELECT a, b FROM links UNION SELECT r.a, e.b FROM reach r JOIN links e ON r.b = e.a)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, least(vec_id, coalesce(m, vec_id)) AS component_id, vec_id <= coalesce(m, vec_id) AS kept
FROM embeddings LEFT JOIN (SELECT a, count(*) AS n FROM links GROUP BY a) l ON l.a = vec_id LEFT JOIN (SELECT a, min(b) AS m FROM reach GROUP BY a) r ON r.a = vec_id
"""

OP6 = f"""
WITH lined AS (SELECT doc_id, text, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
worded AS (
  SELECT doc_id, list_filter(list_zip(range(0, len(l)), list_transform(l, lambda x: trim(x, {SPACE}))), lambda x: x[2] <> '') AS w FROM lined
),
windows AS (
  SELECT doc_id, w[i][1] AS first, w[i + 2][1] AS last, w[i][2] || chr(10) || w[i + 1][2] || chr(10) || w[i + 2][2] AS g
  FROM worded, unnest(range(1, len(w) - 1)) AS u(i)
),
ranked AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id, first) AS n FROM windows),
later AS (SELECT doc_id, list_distinct(flatten(list(range(first, last + 1)))) AS gone, count(*) AS n FROM ranked WHERE n > 1 GROUP BY doc_id)
SELECT d.doc_id,
  CASE WHEN gone IS NULL THEN d.text ELSE array_to_string(list_transform(list_filter(list_zip(range(0, len(l)), l), lambda x: NOT list_contains(gone, x[1])), lambda x: x[2]), chr(10)) END AS text,
  CASE WHEN d.text IS NULL THEN 0 ELSE len(l) END::BIGINT AS n_lines, coalesce(len(gone), 0)::BIGINT AS n_removed, coalesce(n, 0)::BIGINT AS n_windows_removed
FROM lined d LEFT JOIN later USING (doc_id)
"""

OP9 = r"""
WITH sized AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size, substr(md5(doc_id::VARCHAR || '/9'), 1, 15) AS key FROM documents),
sizes AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
caps AS (
  SELECT source, source_size, [5, 2, 1][(n % 3 + 1)::INT]::DOUBLE AS w, n, (source_size * 3)::DOUBLE AS cap
  FROM (SELECT *, row_number() OVER (ORDER BY source IS NULL, encode(source)) - 1 AS n FROM sizes)
),
levels AS (
  SELECT *, row_number() OVER (ORDER BY cap / w, n) AS o,
    (sum(source_size) OVER ()::DOUBLE - (sum(cap) OVER (ORDER BY cap / w, n) - cap)) / sum(w) OVER (ORDER BY cap / w, n ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM caps
),
found AS (SELECT arg_min(level, o) AS level FROM levels WHERE level * w <= cap),
targets AS (SELECT source, source_size, least(cap, coalesce(found.level * w, cap)) AS target FROM levels LEFT JOIN found ON true),
placed AS (
  SELECT s.*, source_size, target, floor(target)::BIGINT AS budget, sum(size) OVER (PARTITION BY s.source ORDER BY key, doc_id ROWS UNBOUNDED PRECEDING) - size AS start
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target,
  (CASE WHEN source_size > 0 THEN budget // source_size ELSE 0 END * size
    + least(size, greatest(0, budget - CASE WHEN source_size > 0 THEN budget // source_size ELSE 0 END * source_size - start)))::BIGINT AS taken
FROM placed
"""

OP11 = """
WITH fine AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
parts AS MATERIALIZED (SELECT vec_id, (i - 1) // (len(v) // 16) AS part, (i - 1) % (len(v) // 16) AS place, v[i] AS x FROM fine, unnest(range(1, len(v) + 1)) AS u(i)),
first AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM (SELECT vec_id FROM fine ORDER BY vec_id LIMIT 64)),
books0 AS MATERIALIZED (SELECT part, entry, place, x FROM parts JOIN first USING (vec_id)),
near0 AS MATERIALIZED (SELECT vec_id, part, arg_min(entry, away * 64 + entry) AS entry, min(away) AS away FROM (
    SELECT p.vec_id, p.part, b.entry, sum((p.x - b.x) * (p.x - b.x))::BIGINT AS away
    FROM parts p JOIN books0 b ON p.part = b.part AND p.place = b.place GROUP BY p.vec_id, p.part, b.entry) GROUP BY vec_id, part),
books1 AS MATERIALIZED (SELECT b.part, b.entry, b.place, coalesce(m.x, b.x) AS x FROM books0 b LEFT JOIN (
    SELECT part, entry, place, (sum(x) - (sum(x) % count(*) + count(*)) % count(*)) // count(*) AS x FROM near0 JOIN parts USING (vec_id, part) GROUP BY part, entry, place
  ) m ON b.part = m.part AND b.entry = m.entry AND b.place = m.place),
near1 AS MATERIALIZED (SELECT vec_id, part, arg_min(entry, away * 64 + entry) AS entry, min(away) AS away FROM (
    SELECT p.vec_id, p.part, b.entry, sum((p.x - b.x) * (p.x - b.x))::BIGINT AS away
    FROM parts p JOIN books1 b ON p.part = b.part AND p.place = b.place GROUP BY p.vec_id, p.part, b.entry) GROUP BY vec_id, part),
books2 AS MATERIALIZED (SELECT b.part, b.entry, b.place, coalesce(m.x, b.x) AS x FROM books1 b LEFT JOIN (
    SELECT part, entry, place, (sum(x) - (sum(x) % count(*) + count(*)) % count(*)) // count(*) AS x FROM near1 JOIN parts USING (vec_id, part) GROUP BY part, entry, place
  ) m ON b.part = m.part AND b.entry = m.entry AND b.place = m.place),
near2 AS MATERIALIZED (SELECT vec_id, part, arg_min(entry, away * 64 + entry) AS entry, min(away) AS away FROM (
    SELECT p.vec_id, p.part, b.entry, sum((p.x - b.x) * (p.x - b.x))::BIGINT AS away
    FROM parts p JOIN books2 b ON p.part = b.part AND p.place = b.place GROUP BY p.vec_id, p.part, b.entry) GROUP BY vec_id, part),
coded AS (SELECT vec_id, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, sum(away)::BIGINT AS error FROM near2 GROUP BY vec_id),
digest AS (SELECT sha256(string_agg(x::VARCHAR, ',' ORDER BY part, entry, place)) AS codebooks_sha256 FROM books2)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM coded JOIN fine USING (vec_id), digest
"""

OP12 = r"""
WITH docs AS (
  SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source, row_number() OVER () AS r,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents
),
by_doc AS (SELECT lang, source, r, term, count(*) AS n FROM docs, unnest(w) AS u(term) GROUP BY ALL),
counts AS (SELECT lang, source, term, sum(n) AS n, count(*) AS d FROM by_doc GROUP BY ALL),
kept AS (SELECT lang, term, sum(n) AS lang_n FROM counts GROUP BY ALL HAVING sum(d) >= 10),
langs AS (SELECT lang, count(term) AS v, coalesce(sum(lang_n), 0) AS lang_total FROM (SELECT DISTINCT lang FROM docs) LEFT JOIN kept USING (lang) GROUP BY lang),
cells AS (
  SELECT lang, source, term, coalesce(n, 0) AS n, lang_n, sum(coalesce(n, 0)) OVER (PARTITION BY lang, source) AS total
  FROM (SELECT DISTINCT lang, source FROM docs) JOIN kept USING (lang) LEFT JOIN counts USING (lang, source, term)
),
rates AS (
  SELECT lang, source, term, n, 1 + (1000000000 * (n + 2))::HUGEINT // (total + 2 * v)::HUGEINT AS p, 1 + (1000000000 * (lang_n + 2))::HUGEINT // (lang_total + 2 * v)::HUGEINT AS q
  FROM cells JOIN langs USING (lang)
),
sums AS (
  SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p))::BIGINT AS value
  FROM rates a JOIN rates b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
),
groups AS (SELECT DISTINCT lang, source FROM docs),
found AS (
  SELECT lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0) AS value
  FROM groups a JOIN groups b USING (lang) LEFT JOIN sums s USING (lang) WHERE a.source <> b.source AND (s.lang IS NULL OR (s.source = a.source AND s.item = b.source))
  UNION ALL SELECT lang, source, 'term', term, ((p - q) * (p - q) // (p + q))::BIGINT FROM rates WHERE n > 0 AND p > q
),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item))::INT AS rank FROM found)
SELECT * FROM ranked WHERE part = 'pair' OR rank <= 10
"""

SQL = {
    "op1_quality_rules": OP1,
    "op2_minhash_near_dedup": OP2,
    "op3_embedding_near_dedup": OP3,
    "op6_line_dedup": OP6,
    "op9_source_mixing": OP9,
    "op11_value_dictionaries": OP11,
    "op12_source_divergence": OP12,
}
