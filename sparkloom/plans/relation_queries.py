"""Queries on edges, imports, relationships, values, digests and differences, with their SQL."""

from __future__ import annotations

import sys

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import normal as N
from ..functions import paths as X
from ..functions import text as T
from ..operators import compare, graph, relations, reports, resolution
from .code_queries import SELECTED
from .code_tables import CODE, PATHS, SQL_TOKENS, code_files, sql_distinct, sql_list, sql_terms

# fixed values: kinds of edges and evidence, with their priority and cost
PRIORITIES = ("critical", "high", "medium", "low")
EVIDENCE = {"exact_import": "medium", "exact_re_export": "medium", "symbol_import": "low", "dynamic_import": "low", "commonjs_require": "low", "unknown": "low"}
EDGE_COSTS = {"import": 1.0, "re_export": 1.0, "route": 1.25, "template": 1.0, "style": 0.75, "config": 1.0, "unknown": 1.5}
ORIGINS = {"explicit": 0, "workspace_file": 1, "local_path_reference": 2, "discovered": 3, "inferred": 4}
PATTERNS = [("@app/*", "src/pages/*"), ("@app/home", "src/hooks/home"), ("@app/use*", "src/hooks/use*"), ("@ui", "src/components/index"), ("*/styles.css", "src/*/styles.css")]
STDLIB = tuple(sorted(sys.stdlib_module_names))  # Python's own list


def read(spark, sf_dir, name) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _pick(values, index):
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index % len(values) + 1).cast("int"))


def _map(values: dict):
    return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])


def dependency_edges(spark, sf_dir) -> DataFrame:
    """Three edges a file, some of them equal: ``source, target, edge_type, evidence``."""
    parts = read(spark, sf_dir, "part")
    n = parts.agg(F.max("p_partkey") + 1).scalar()
    k, j = F.col("p_partkey"), F.col("j")
    rows = parts.select(k, n.alias("n"), F.explode(F.array(*[F.lit(i) for i in range(4)])).alias("j"))
    target = F.when(j == 0, k * 3 + 1).when(j == 1, k * 7 + 2).when(j == 2, F.floor(k / 2)).otherwise(k * 3 + 1) % F.col("n")
    i = F.when(j == 3, 0).otherwise(j)
    return rows.select(k.alias("source"), target.cast("long").alias("target"), _pick(tuple(EDGE_COSTS), k + i).alias("edge_type"), _pick(tuple(EVIDENCE), k + 2 * i).alias("evidence"))


def priced_edges(spark, sf_dir) -> DataFrame:
    """Distinct edges with priority, rank and cost, and their place among the edges of their source."""
    e = dependency_edges(spark, sf_dir).dropDuplicates()
    e = e.withColumn("priority", F.element_at(_map(EVIDENCE), F.col("evidence")))
    e = e.withColumns({"rank": F.array_position(F.array(*[F.lit(p) for p in PRIORITIES]), F.col("priority")) - 1, "cost": F.element_at(_map(EDGE_COSTS), F.col("edge_type"))})
    w = Window.partitionBy("source").orderBy("rank", "target", "edge_type", "evidence")
    return e.withColumn("ord", F.row_number().over(w).cast("long"))


def edge_order(spark, sf_dir):
    return priced_edges(spark, sf_dir)


def traversal(spark, sf_dir):
    """Best-first traversals from every file."""
    seeds = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("seed"))
    return graph.traverse(priced_edges(spark, sf_dir), seeds, max_depth=4, max_files=12, max_edges=25, max_cost=20.0)


def traced_edges(spark, sf_dir):
    """The distinct edges of all files and how many of the files have each target."""
    return priced_edges(spark, sf_dir).groupBy("target").agg(F.count_distinct("source").alias("seeds"), F.sum("cost").alias("cost"), F.min("rank").alias("rank"))


def script_resolution(spark, sf_dir):
    f = code_files(spark, sf_dir)
    i = f.select("file_id", "path", F.posexplode("imports").alias("n", "imported"))
    out = resolution.resolve_scripts(i, f, "path", "imported", PATTERNS)
    return out.select("file_id", F.col("n").cast("long").alias("n"), "imported", "resolved", "status")


def module_resolution(spark, sf_dir):
    f = code_files(spark, sf_dir)
    names = F.array(F.lit("src.index"), F.lit("main"), F.lit("os.path"), F.lit("requests"), F.lit("user_service"), F.lit("app.models.x"))
    i = f.where(F.col("path").endswith(".py")).select("file_id", "path", F.posexplode(names).alias("n", "imported"))
    out = resolution.resolve_modules(i, f, "path", "imported", STDLIB)
    return out.select("file_id", F.col("n").cast("long").alias("n"), "imported", "resolved", "status")


def test_sources(spark, sf_dir):
    """The best source of each test, by names, imports, nearness, the selected files and the terms of the source."""
    f = code_files(spark, sf_dir)
    said = F.concat(F.array("path"), "classes", "functions", F.flatten(F.transform("routes", lambda r: F.array(r["method"], r["path"], r["source"]))))
    terms = F.array_distinct(F.flatten(F.transform(said, X.identifier_terms)))
    return relations.best_source_of_tests(f, "path", F.col("imports"), terms, F.col("path").isin(*SELECTED))


def test_hints(spark, sf_dir):
    """Of the symbols of test files two a file, and of these the first forty."""
    f = code_files(spark, sf_dir).where(X.is_matching_test(F.col("path")))
    s = f.select("path", "file_id", F.posexplode(F.concat("classes", "functions")).alias("n", "symbol"))
    return relations.ordered_limits(s, "path", [F.col("path"), F.col("file_id"), F.col("n")], 2, 40).select("place", "path", "file_id", "symbol")


def relationships(spark, sf_dir) -> DataFrame:
    """``a, b, kind, origin, score, evidence`` from the lines of orders."""
    n = F.col("l_linenumber") + F.col("l_orderkey")
    return read(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("a"), (F.col("l_partkey") % 40).alias("b"), _pick(("depends_on", "calls_api", "embeds"), n).alias("kind"), _pick(tuple(ORIGINS), F.col("l_partkey")).alias("origin"),
        (F.col("l_quantity") / 64).alias("score"), F.concat(F.lit("e"), ((F.col("l_partkey") + n) % 17).cast("string")).alias("evidence"),
    )


def merged_relationships(spark, sf_dir):
    out = relations.merge_by_origin(relations.without_suppressed(relationships(spark, sf_dir), ["a", "b"], "kind", "origin", "explicit"), ["a", "b", "kind"], "origin", ORIGINS, "score", "evidence", 3)
    return out.select("a", "b", "kind", "origin", "score", "n", F.array_join("evidence", ",").alias("evidence"), F.col("omitted").cast("long").alias("omitted"))


_STRENGTH = {"e0": 0.9, "e1": 0.6, "e2": 0.6, "e3": 0.3}


def origin_scores(spark, sf_dir):
    """A score of each pair and origin from the strength of its evidence; what is not listed is weak."""
    strength = F.coalesce(F.element_at(_map(_STRENGTH), F.col("evidence")), F.lit(0.3))
    g = relationships(spark, sf_dir).withColumn("s", F.when(F.col("evidence") != "e16", strength)).groupBy("a", "origin").agg(F.count("s").alias("n"), F.max("s").alias("top"), F.max("s").alias("m"))
    score = relations.origin_score(F.col("origin"), F.col("n"), F.col("top"), F.col("top") <= 0.3)
    return g.select("a", "origin", "n", score.alias("score"))


SIGNALS = {"view": 0.05, "click": 0.10, "signup": 0.35, "purchase": 0.45, "error": 0.20}


def signal_scores(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    return relations.evidence_score(e, ["user_id"], "event_type", SIGNALS, ("view", "click"))


def frameworks(spark, sf_dir):
    """Which of three frameworks each folder shows, from file kinds that speak for them."""
    f = code_files(spark, sf_dir).select(X.folders(F.col("path"))[0].alias("unit"), F.lower(X.name(F.col("path"))).alias("name"), "imports")
    found = F.array_compact(F.array(
        F.when(F.array_contains("imports", "react"), F.struct(F.lit("react").alias("framework"), F.lit("import").alias("kind"), F.lit(3).alias("score"))),
        F.when(F.col("name").rlike(r"\.[jt]sx$"), F.struct(F.lit("react").alias("framework"), F.lit("extension").alias("kind"), F.lit(2).alias("score"))),
        F.when(F.col("name").contains(".component."), F.struct(F.lit("angular").alias("framework"), F.lit("component").alias("kind"), F.lit(3).alias("score"))),
        F.when(F.col("name").contains(".module."), F.struct(F.lit("angular").alias("framework"), F.lit("module").alias("kind"), F.lit(2).alias("score"))),
        F.when(F.col("name").endswith(".html"), F.struct(F.lit("plain").alias("framework"), F.lit("page").alias("kind"), F.lit(1).alias("score"))),
    ))
    e = f.select("unit", F.inline(found))
    return relations.detected_frameworks(e, ["unit"], "framework", "kind", "score", 4, {"react": ("import",), "angular": ("component",)})


def entry_points(spark, sf_dir):
    """Of the events of a user and type the best by value (then the latest kind), with the first two as evidence."""
    e = read(spark, sf_dir, "events")
    best = F.max_by(F.struct("event_id", "props"), F.struct("value", "event_id")).alias("b")
    heads = e.groupBy("user_id", "event_type").agg(best, F.max("value").alias("value"), F.count("*").alias("n"))
    w = Window.partitionBy("user_id", "event_type").orderBy("event_id")
    first = e.withColumn("r", F.row_number().over(w)).where("r <= 2").groupBy("user_id", "event_type").agg(F.array_join(F.sort_array(F.collect_list("event_id")).cast("array<string>"), ",").alias("evidence"))
    return heads.join(first, ["user_id", "event_type"]).select("user_id", "event_type", F.col("b.event_id").alias("event_id"), "value", "n", "evidence")


def bounded_warnings(spark, sf_dir):
    """Each user's kinds of events, three at most, the last one saying how many more."""
    e = read(spark, sf_dir, "events").groupBy("user_id").agg(F.sort_array(F.collect_set("event_type")).alias("kinds"))
    return e.select("user_id", F.array_join(relations.bounded_list(F.col("kinds"), 3, "warnings"), "|").alias("warnings"))


_VALUES = ("8080", " 443 ", "70000", "0", "HTTP://LocalHost:3000/", "http://127.0.0.1:5000/x?y=1#z", "abc", "ws://Host.Example:9000", "https://user:pw@host/", "https://Example.com/", " Trim Me ", "ftp://host:21/")


def contract_values(spark, sf_dir):
    p = read(spark, sf_dir, "pages").select("page_id", F.when(F.col("page_id") % 2 == 0, _pick(_VALUES, F.floor(F.col("page_id") / 2))).otherwise(F.col("url")).alias("v"))
    return p.select("page_id", *[N.contract_value(F.col("v"), how).alias(how) for how in ("exact", "case_insensitive", "trimmed", "url", "port")])


def digests(spark, sf_dir):
    """Digests, masks, ages and names of orders."""
    o = read(spark, sf_dir, "orders")
    fields = {"key": F.col("o_orderkey"), "status": F.col("o_orderstatus"), "day": F.date_format("o_orderdate", "yyyy-MM-dd"), "priority": F.col("o_orderpriority")}
    masked = N.redacted_map(F.create_map(F.lit("api-key"), F.col("o_orderstatus"), F.lit("status"), F.col("o_orderstatus"), F.lit("userToken"), F.col("o_orderpriority")))
    return o.select(
        "o_orderkey", N.stable_digest(fields).alias("digest"), T.short_id(F.col("o_orderkey"), F.col("o_orderstatus")).alias("short"), F.array_join(F.map_values(masked), ",").alias("masked"),
        N.is_expired(F.col("o_orderdate"), F.lit("1998-08-01 12:00:00").cast("timestamp"), 86400.0 * 365).alias("expired"), N.snapshot_name(F.col("o_orderdate")).alias("snapshot"),
        T.secret_like(F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("Bearer "), F.col("o_orderstatus"))).when(F.col("o_orderkey") % 3 == 1, F.sha2(F.col("o_orderkey").cast("string"), 256)).otherwise(F.col("o_orderpriority"))).alias("secret"),
    )


def line_places(spark, sf_dir):
    """Lines of places in documents and a bounded snippet of each."""
    d = read(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    s = N.snippet(F.col("text"), 2, 9, 4, 120)
    return d.select("doc_id", N.line_of_offset(F.col("text"), F.floor(F.char_length("text") / 2).cast("int")).alias("line"), F.sha2(s["snippet"], 256).alias("snippet"), s["truncated"].alias("truncated"))


def cache_reuse(spark, sf_dir):
    """For each customer nation whether a cached state of its orders up to the cut can be reused, and why not."""
    o = read(spark, sf_dir, "orders").join(read(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    line = F.concat_ws("|", F.col("o_orderkey").cast("string"), "o_orderstatus")
    cached = o.where("o_orderkey % 40 <> 3 or c_nationkey > 5")
    before = compare.group_digests(cached, ["c_nationkey"], line).join(cached.groupBy("c_nationkey").agg(F.max("o_orderdate").alias("latest")), "c_nationkey")
    after = compare.group_digests(o, ["c_nationkey"], line)
    both = after.alias("x").join(before.alias("y"), "c_nationkey", "left")
    old = N.is_expired(F.col("y.latest"), F.lit("1998-08-02 00:00:00").cast("timestamp"), 86400.0 * 3)
    reasons = N.reuse_reasons({k: F.col(f"y.{k}") for k in ("digest", "n")}, {k: F.col(f"x.{k}") for k in ("digest", "n")}, old)
    status = F.when(F.col("y.n").isNull(), "miss").when(F.size(reasons) == 0, "hit").otherwise("stale")
    return both.select("c_nationkey", status.alias("status"), F.array_join(reasons, ",").alias("reasons"), (F.col("x.n") - F.coalesce("y.n", F.lit(0))).alias("n_more"))


def scan_drift(spark, sf_dir):
    """Drift of each order year: rows changed during a scan (every 30th of some years) and since the last snapshot."""
    o = read(spark, sf_dir, "orders").withColumn("y", F.year("o_orderdate").cast("long"))
    during = F.count_if((F.col("o_orderkey") % 30 == 0) & (F.col("y") % 3 == 0) | (F.col("o_orderkey") % 4 == 0) & (F.col("y") % 5 == 0))
    since = F.count_if((F.col("o_orderkey") % 11 == 0) & (F.col("y") % 2 == 0))
    g = o.groupBy("y").agg(F.count("*").alias("n"), during.alias("during"), since.alias("since"))
    status = N.drift_status(F.col("during"), F.col("since"), F.col("n"), F.col("y") != 1994)
    return g.select("y", "n", "during", "since", status.alias("status"), N.readiness(F.when(F.col("y") == 1996, "odd").otherwise(status)).alias("readiness"))


def _versions(spark, sf_dir):
    f = code_files(spark, sf_dir)
    old = f.where("file_id % 10 <> 0").withColumn("functions", F.when(F.col("file_id") % 7 == 0, F.array(F.lit("old_one"))).otherwise(F.col("functions")))
    return old, f.where("file_id % 13 <> 0").withColumn("classes", F.when(F.col("file_id") % 11 == 0, F.array(F.lit("NewOne"))).otherwise(F.col("classes")))


def surface_diff(spark, sf_dir):
    """Symbols of files that came or went between two versions."""
    return reports.changed_items(*_versions(spark, sf_dir), "file_id", ["classes", "functions"])


def unresolved_diff(spark, sf_dir):
    """Unresolved imports per file that came or went between two versions."""
    rows = []
    for v, patterns in zip(_versions(spark, sf_dir), ([("@app/*", "src/pages/*")], PATTERNS), strict=True):
        i = v.select("file_id", "path", F.explode("imports").alias("imported"))
        rows.append(resolution.resolve_scripts(i, v, "path", "imported", patterns).where("status = 'unresolved'"))
    return reports.changed_sets(*rows, "file_id", "imported")


def code_summary(spark, sf_dir):
    """Sums over all files in one row, and counts by language of files, symbols and routes."""
    f = code_files(spark, sf_dir).withColumn("language", X.language(F.col("path")))
    sums = {
        "files": F.count("*"), "symbols": F.sum(F.size("functions") + F.size("classes")), "imports": F.sum(F.size("imports")), "routes": F.sum(F.size("routes")),
        "route_files_at_risk": F.count_if((F.size("routes") > 0) & F.exists("imports", X.is_relative_import)),
    }
    return reports.totals(f, "language", sums)


def top_files(spark, sf_dir):
    f = code_files(spark, sf_dir)
    score = (F.size("functions") + F.size("classes")) * 4 + F.array_contains("imports", "react").cast("int") * 3 + F.size("imports")
    return f.select("file_id", "path", score.cast("long").alias("score")).orderBy(F.desc("score"), "path", "file_id").limit(5)


def first_symbols(spark, sf_dir):
    """The first twelve different symbols in the order of the files."""
    s = code_files(spark, sf_dir).select("file_id", F.posexplode(F.concat("classes", "functions")).alias("n", "symbol"))
    return reports.first_distinct(s, "symbol", ["file_id", "n"], 12).drop("n")


def route_table(spark, sf_dir):
    """Every route with its file, method by method."""
    f = code_files(spark, sf_dir).select("file_id", "path", F.inline("routes").alias("method", "route", "handler"))
    return f.select("file_id", F.upper("method").alias("method"), T.route_path(F.col("route")).alias("route"), "handler", F.concat_ws(":", "path", F.col("file_id").cast("string")).alias("location")).distinct()


def grouped_relationships(spark, sf_dir):
    """Relationships by source and by kind: how many, distinct ones, and how strong."""
    return reports.group_relationships(relationships(spark, sf_dir), ["a", "kind"], ["b", "origin"], "origin", "score")


# --- SQL

_N = "(SELECT max(p_partkey) + 1 FROM part)"
_EDGES = f"""edges AS (SELECT DISTINCT k AS source, CASE j WHEN 0 THEN k * 3 + 1 WHEN 1 THEN k * 7 + 2 WHEN 2 THEN k // 2 ELSE k * 3 + 1 END % {_N} AS target, {sql_list(EDGE_COSTS)}[(k + i) % 7 + 1] AS edge_type, {sql_list(EVIDENCE)}[(k + 2 * i) % 6 + 1] AS evidence
  FROM (SELECT p_partkey AS k, j, CASE WHEN j = 3 THEN 0 ELSE j END AS i FROM part, range(4) t(j))),
ranked AS (SELECT *, CASE WHEN evidence IN ('exact_import', 'exact_re_export') THEN 'medium' ELSE 'low' END AS priority, CASE WHEN evidence IN ('exact_import', 'exact_re_export') THEN 2 ELSE 3 END::BIGINT AS rank,
  CASE edge_type WHEN 'route' THEN 1.25 WHEN 'style' THEN 0.75 WHEN 'unknown' THEN 1.5 ELSE 1.0 END::DOUBLE AS cost FROM edges),
priced AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY rank, target, edge_type, evidence) AS ord FROM ranked)"""
_TARGETS = "targets AS (SELECT source, list({'r': rank, 'c': cost, 't': target} ORDER BY ord) AS out FROM priced GROUP BY source)"
_TRAVERSAL = f"""WITH RECURSIVE {_EDGES}, {_TARGETS},
walk AS (
  SELECT p_partkey AS seed, 0::BIGINT AS place, NULL::BIGINT AS node, NULL::BIGINT AS depth, [{{'r': -1::BIGINT, 'c': 0.0::DOUBLE, 'd': 0::BIGINT, 't': p_partkey}}] AS front, []::BIGINT[] AS seen, 0::BIGINT AS n_edges, 0.0::DOUBLE AS cost, NULL::VARCHAR AS stop FROM part
  UNION ALL
  SELECT seed, place + 1, m.t, m.d, list_filter(front, lambda x: x.t <> m.t) || list_transform(got, lambda x: {{'r': x.r, 'c': x.c, 'd': m.d + 1, 't': x.t}}), list_append(seen, m.t), n_edges + len(got), cost + coalesce(list_sum(list_transform(got, lambda x: x.c)), 0),
    CASE WHEN len(got) < len(out) THEN CASE WHEN n_edges + len(got) >= 25 THEN 'edges' ELSE 'cost' END WHEN len(got) > 0 AND n_edges + len(got) >= 25 THEN 'edges' WHEN len(seen) + 1 >= 12 AND len(list_filter(list_filter(front, lambda x: x.t <> m.t) || list_transform(got, lambda x: {{'r': x.r, 'c': x.c, 'd': m.d + 1, 't': x.t}}), lambda x: NOT list_contains(list_append(seen, m.t), x.t))) > 0 THEN 'files' END
  FROM (SELECT w.*, coalesce(out, []) AS out, coalesce(list_filter(out, lambda x, i: n_edges + i <= 25 AND cost + list_sum(list_transform(out[1:i], lambda y: y.c)) <= 20.0), []) AS got
    FROM (SELECT *, list_min(list_filter(front, lambda x: NOT list_contains(seen, x.t))) AS m FROM walk WHERE stop IS NULL) w
    LEFT JOIN (SELECT source, out FROM targets) t ON t.source = m.t AND m.d < 4 WHERE m IS NOT NULL)
)
SELECT seed, place, node, depth, last_value(n_edges) OVER w AS n_edges, last_value(cost) OVER w AS cost, last_value(stop) OVER w AS stop FROM walk WHERE place > 0 WINDOW w AS (PARTITION BY seed ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)"""

_SUFFIXES = sql_list(resolution.SCRIPT_SUFFIXES)


def _resolution_sql(code: str, patterns, name: str) -> str:
    """The candidates of every import of a table ``code`` (file_id, path, imports), as CTEs that end in ``{name}``."""
    ordered = sorted(patterns, key=lambda p: ("*" in p[0], -len(p[0].split("*")[0]), p[0]))
    made = []
    for pattern, target in ordered:
        before, star, after = pattern.partition("*")
        if not star:
            made.append(f"CASE WHEN imported = '{pattern}' THEN '{target}' END")
        else:
            t = target.partition("*")
            fits = f"starts_with(imported, '{before}') AND ends_with(imported, '{after}') AND length(imported) >= {len(before) + len(after)}"
            made.append(f"CASE WHEN {fits} THEN '{t[0]}' || substr(imported, {len(before) + 1}, length(imported) - {len(before) + len(after)}) || '{t[2]}' END")
    alias = "list_filter([" + ", ".join(made) + "], lambda x: x IS NOT NULL)"
    return f"""{name}_i AS (SELECT file_id, path, unnest(imports) AS imported, generate_subscripts(imports, 1) - 1 AS n FROM {code}),
{name}_r AS (SELECT *, regexp_matches(imported, '^\\.\\.?/') AS rel, string_split(path, '/')[1:len(string_split(path, '/')) - 1] AS above, {alias} AS al FROM {name}_i),
{name}_b AS (SELECT *, CASE WHEN rel THEN CASE WHEN starts_with(imported, './') THEN [array_to_string(above || string_split(imported[3:], '/'), '/')] WHEN len(above) > 0 THEN [array_to_string(above[1:len(above) - 1] || string_split(imported[4:], '/'), '/')] ELSE [] END ELSE al END AS bases FROM {name}_r),
{name}_t AS (SELECT *, flatten(list_transform(bases, lambda b: CASE WHEN regexp_matches(b, '\\.(ts|tsx|js|jsx|mjs|cjs)$') THEN [b] ELSE list_transform({_SUFFIXES}, lambda s: b || s) || list_transform({_SUFFIXES}, lambda s: b || '/index' || s) END)) AS tried FROM {name}_b),
{name}_h AS (SELECT file_id, n, arg_min(c, i) AS hit FROM (SELECT file_id, n, unnest(tried) AS c, generate_subscripts(tried, 1) AS i FROM {name}_t) JOIN (SELECT DISTINCT path FROM {code}) ON path = c GROUP BY ALL),
{name} AS (SELECT file_id, n, imported, hit AS resolved, CASE WHEN rel AND hit IS NOT NULL THEN 'relative' WHEN hit IS NOT NULL THEN 'alias' WHEN rel OR len(al) > 0 THEN 'unresolved' ELSE 'external' END AS status
  FROM {name}_t LEFT JOIN {name}_h USING (file_id, n))"""


_RELATIONS = f"""rel AS (SELECT l_suppkey AS a, l_partkey % 40 AS b, ['depends_on', 'calls_api', 'embeds'][(l_linenumber + l_orderkey) % 3 + 1] AS kind, {sql_list(ORIGINS)}[l_partkey % 5 + 1] AS origin, l_quantity / 64 AS score, 'e' || ((l_partkey + l_linenumber + l_orderkey) % 17) AS evidence FROM lineitem)"""
_URL_SQL = r"""CASE WHEN regexp_matches(trim(v), '^(?i:https?|wss?)://[^/?#:@]+(:[0-9]+)?([/?#].*)?$') THEN lower(regexp_extract(trim(v), '^([a-zA-Z]+)://', 1)) || '://' || regexp_replace(lower(regexp_extract(trim(v), '^[a-zA-Z]+://([^/?#:@]+)', 1)), '^(127\.[0-9.]+|0\.0\.0\.0)$', 'localhost')
  || regexp_extract(trim(v), '^[a-zA-Z]+://[^/?#:@]+(:[0-9]+)?', 1) || CASE WHEN regexp_extract(trim(v), '^[a-zA-Z]+://[^/?#@]+(.*)$', 1) = '/' THEN '' ELSE regexp_extract(trim(v), '^[a-zA-Z]+://[^/?#@]+(.*)$', 1) END END"""
_OLD = "old AS (SELECT file_id, path, classes, CASE WHEN file_id % 7 = 0 THEN ['old_one'] ELSE functions END AS functions, imports FROM code WHERE file_id % 10 <> 0)"
_NEW = "new AS (SELECT file_id, path, CASE WHEN file_id % 11 = 0 THEN ['NewOne'] ELSE classes END AS classes, functions, imports FROM code WHERE file_id % 13 <> 0)"
_MATCHING = "(regexp_matches(lower(path), '^tests/|/tests/|\\.(test|spec)\\.') OR regexp_matches(lower(stem), '^test_|\\.(test|spec)$'))"


def _language_sql() -> str:
    return "coalesce(MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in X.NAME_LANGUAGES.items()) + "}[lower(name)], MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in X.EXTENSION_LANGUAGES.items()) + "}[ext])"


_SUMS = "count(*) AS files, sum(len(functions) + len(classes))::BIGINT AS symbols, sum(len(imports))::BIGINT AS imports, sum(len(routes))::BIGINT AS routes, count(*) FILTER (len(routes) > 0 AND len(list_filter(imports, lambda x: regexp_matches(x, '^\\.\\.?/'))) > 0) AS route_files_at_risk"

SQL = {
    "edge_order": f"WITH {_EDGES} SELECT * FROM priced",
    "traversal": _TRAVERSAL,
    "traced_edges": f"WITH {_EDGES} SELECT target, count(DISTINCT source) AS seeds, sum(cost) AS cost, min(rank) AS rank FROM priced GROUP BY target",
    "script_resolution": f"WITH {CODE}, {_resolution_sql('code', PATTERNS, 'res')} SELECT file_id, n, imported, resolved, status FROM res",
    "module_resolution": f"""WITH {PATHS}, py AS (SELECT * FROM paths WHERE ends_with(path, '.py')), names AS (SELECT array_to_string(above || [stem], '.') AS m, min(path) AS by_name FROM py GROUP BY 1),
i AS (SELECT file_id, path, above, n, ['src.index', 'main', 'os.path', 'requests', 'user_service', 'app.models.x'][n + 1] AS imported FROM py, range(6) t(n)), files AS (SELECT DISTINCT path AS f FROM code)
SELECT file_id, n, imported, coalesce(by_name, f) AS resolved, CASE WHEN coalesce(by_name, f) IS NOT NULL THEN 'internal' WHEN list_contains({sql_list(STDLIB)}, string_split(imported, '.')[1]) THEN 'external' ELSE 'unresolved' END AS status
FROM i LEFT JOIN names ON m = imported LEFT JOIN files ON f = array_to_string(above || [imported || '.py'], '/')""",
    "test_sources": f"""WITH {PATHS}, said AS (SELECT path, stem, above, {_MATCHING} AS t, imports, len(list_distinct(flatten(list_transform([path] || classes || functions || flatten(list_transform(routes, lambda r: [r.method, r.path, r.source])), lambda t: {sql_terms("t")})))) AS n FROM paths),
r AS (SELECT path, any_value(stem) AS stem, any_value(above) AS above, bool_or(t) AS t, min(imports) AS imports, max(n) AS n, path IN {sql_list(SELECTED).replace("[", "(").replace("]", ")")} AS selected FROM said GROUP BY path),
x AS (SELECT *, lower(translate(array_to_string([path] || imports, ' '), '\\_-', '/  ')) AS hint, regexp_replace(stem, '\\.(test|spec)$', '', 'i') AS bare, lower(translate(stem, '\\_-', '/  ')) AS needle, list_filter(above, lambda f: f <> '__tests__') AS low FROM r),
m AS (SELECT a.path AS test, b.path AS source, a.bare IN (b.stem, 'test_' || b.stem) AS exact, b.selected,
  (300 * (a.bare IN (b.stem, 'test_' || b.stem))::INT + 180 * contains(a.hint, b.needle)::INT + CASE WHEN a.above = b.above THEN 80 ELSE least(45, 15 * (SELECT coalesce(max(k), 0) FROM range(0, 9) u(k) WHERE k <= len(a.low) AND k <= len(b.above) AND a.low[1:k] = b.above[1:k])) END
  + 40 * b.selected::INT + least(b.n, 15))::BIGINT AS score FROM x a JOIN x b ON a.t AND NOT b.t AND (a.bare IN (b.stem, 'test_' || b.stem) OR contains(a.hint, b.needle)))
SELECT test, source, score, exact FROM m QUALIFY row_number() OVER (PARTITION BY test ORDER BY score DESC, exact DESC, selected DESC, length(source), source DESC) = 1""",
    "test_hints": f"""WITH {PATHS}, s AS (SELECT path, file_id, unnest(classes || functions) AS symbol, generate_subscripts(classes || functions, 1) AS n FROM paths WHERE {_MATCHING}),
few AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY path ORDER BY file_id, n) <= 2) SELECT row_number() OVER (ORDER BY path, file_id, n) AS place, path, file_id, symbol FROM few QUALIFY place <= 40""",
    "merged_relationships": f"""WITH {_RELATIONS}, said AS (SELECT *, min(kind) FILTER (origin = 'explicit') OVER (PARTITION BY a, b) AS first FROM rel), live AS (SELECT * FROM said WHERE first IS NULL OR origin = 'explicit' OR kind = first),
ranked AS (SELECT *, list_position({sql_list(ORIGINS)}, origin) AS r FROM live),
heads AS (SELECT a, b, kind, count(*) AS n, arg_min(origin, r) AS origin, min(r) AS best FROM ranked GROUP BY ALL),
scores AS (SELECT a, b, kind, r, max(score) AS score FROM ranked GROUP BY ALL), ev AS (SELECT a, b, kind, list_sort(list(DISTINCT evidence)) AS e FROM live GROUP BY ALL)
SELECT h.a, h.b, h.kind, origin, score, n, array_to_string(e[1:3], ',') AS evidence, greatest(len(e) - 3, 0)::BIGINT AS omitted FROM heads h JOIN scores s ON (h.a, h.b, h.kind, best) = (s.a, s.b, s.kind, r) JOIN ev ON (h.a, h.b, h.kind) = (ev.a, ev.b, ev.kind)""",
    "origin_scores": f"""WITH {_RELATIONS}, g AS (SELECT a, origin, count(*) FILTER (evidence <> 'e16') AS n, max(CASE evidence WHEN 'e0' THEN 0.9 WHEN 'e1' THEN 0.6 WHEN 'e2' THEN 0.6 ELSE 0.3 END::DOUBLE) FILTER (evidence <> 'e16') AS top FROM rel GROUP BY ALL)
SELECT a, origin, n, CASE WHEN origin = 'explicit' THEN 1.0 WHEN n = 0 THEN 0.25 ELSE round(least(CASE WHEN origin IN ('workspace_file', 'local_path_reference') THEN greatest(top, 0.75) ELSE top END, 0.95), 3) END::DOUBLE AS score FROM g""",
    "signal_scores": """WITH g AS (SELECT user_id, list(DISTINCT event_type) AS k FROM events GROUP BY 1),
s AS (SELECT user_id, len(k) AS n_signals, list_sum(list_transform(k, lambda x: CASE x WHEN 'view' THEN 5 WHEN 'click' THEN 10 WHEN 'signup' THEN 35 WHEN 'purchase' THEN 45 ELSE 20 END))::BIGINT AS p, NOT list_has_any(k, ['signup', 'purchase', 'error']) AS weak FROM g),
t AS (SELECT user_id, n_signals, least(CASE WHEN weak THEN least(p, 30) ELSE p END, 95) / 100.0::DOUBLE AS score FROM s)
SELECT user_id, n_signals, score, CASE WHEN score >= 0.65 THEN 'high' WHEN score >= 0.35 THEN 'medium' ELSE 'low' END AS band FROM t""",
    "frameworks": f"""WITH {PATHS}, e AS (SELECT above[1] AS unit, unnest(list_filter([CASE WHEN list_contains(imports, 'react') THEN {{'f': 'react', 'k': 'import', 's': 3}} END, CASE WHEN regexp_matches(lower(name), '\\.[jt]sx$') THEN {{'f': 'react', 'k': 'extension', 's': 2}} END,
  CASE WHEN contains(lower(name), '.component.') THEN {{'f': 'angular', 'k': 'component', 's': 3}} END, CASE WHEN contains(lower(name), '.module.') THEN {{'f': 'angular', 'k': 'module', 's': 2}} END, CASE WHEN ends_with(lower(name), '.html') THEN {{'f': 'plain', 'k': 'page', 's': 1}} END], lambda x: x IS NOT NULL)) AS x FROM paths),
o AS (SELECT unit, x.f AS framework, x.k AS kind, max(x.s) AS s FROM e GROUP BY 1, 2, 3)
SELECT unit, framework, sum(s)::BIGINT AS score, sum(s) >= 4 AND (framework = 'plain' OR bool_or((framework = 'react' AND kind = 'import') OR (framework = 'angular' AND kind = 'component'))) AS detected FROM o GROUP BY unit, framework""",
    "entry_points": """SELECT user_id, event_type, arg_max(event_id, (value, event_id)) AS event_id, max(value) AS value, count(*) AS n, array_to_string(list_sort(list(event_id))[1:2], ',') AS evidence FROM events GROUP BY ALL""",
    "bounded_warnings": "SELECT user_id, CASE WHEN len(k) <= 3 THEN array_to_string(k, '|') ELSE array_to_string(k[1:2], '|') || '|...and ' || (len(k) - 2) || ' more warnings' END AS warnings FROM (SELECT user_id, list_sort(list(DISTINCT event_type)) AS k FROM events GROUP BY 1)",
    "contract_values": f"""WITH p AS (SELECT page_id, CASE WHEN page_id % 2 = 0 THEN {sql_list(_VALUES)}[page_id // 2 % {len(_VALUES)} + 1] ELSE url END AS v FROM pages), u AS (SELECT *, {_URL_SQL} AS u FROM p),
q AS (SELECT *, CASE WHEN regexp_matches(trim(v), '^[0-9]{{1,9}}$') THEN trim(v)::BIGINT ELSE TRY_CAST(nullif(regexp_extract(u, '^[a-z]+://[^/?#:]+:([0-9]+)', 1), '') AS BIGINT) END AS port FROM u)
SELECT page_id, 'str:' || v AS exact, 'str:' || lower(v) AS case_insensitive, 'str:' || trim(v) AS trimmed, 'str:' || u AS url, CASE WHEN port BETWEEN 1 AND 65535 THEN 'int:' || port END AS port FROM q""",
    "digests": """SELECT o_orderkey, sha256('{"day":"' || strftime(o_orderdate, '%Y-%m-%d') || '","key":' || o_orderkey || ',"priority":"' || o_orderpriority || '","status":"' || o_orderstatus || '"}') AS digest, substr(sha256(o_orderkey || '|' || o_orderstatus), 1, 16) AS short,
  '[redacted],' || o_orderstatus || ',[redacted]' AS masked, TIMESTAMP '1998-08-01 12:00:00' - o_orderdate > INTERVAL 365 DAY AS expired, strftime(o_orderdate, '%Y%m%d_%H%M%S') AS snapshot, o_orderkey % 3 < 2 AS secret FROM orders""",
    "line_places": r"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), s AS (SELECT *, string_split(t, chr(10))[2:9] AS w FROM d), k AS (SELECT *, array_to_string(w[1:4], chr(10)) AS kept FROM s)
SELECT doc_id, (length(t[1:length(t) // 2]) - length(replace(t[1:length(t) // 2], chr(10), '')) + 1)::BIGINT AS line, sha256(substr(kept, 1, 120)) AS snippet, len(w) > 4 OR length(kept) > 120 AS truncated FROM k""",
    "cache_reuse": """WITH o AS (SELECT c_nationkey, o_orderkey, sha256(o_orderkey || '|' || o_orderstatus) AS h, o_orderdate FROM orders JOIN customer ON o_custkey = c_custkey),
x AS (SELECT c_nationkey, sha256(string_agg(d, ',' ORDER BY bin)) AS digest, sum(n)::BIGINT AS n FROM (SELECT c_nationkey, h[:4] AS bin, sha256(string_agg(h, ',' ORDER BY h)) AS d, count(*) AS n FROM o GROUP BY ALL) GROUP BY 1),
y AS (SELECT c_nationkey, sha256(string_agg(d, ',' ORDER BY bin)) AS digest, sum(n)::BIGINT AS n, max(latest) AS latest FROM (SELECT c_nationkey, h[:4] AS bin, sha256(string_agg(h, ',' ORDER BY h)) AS d, count(*) AS n, max(o_orderdate) AS latest FROM o WHERE o_orderkey % 40 <> 3 OR c_nationkey > 5 GROUP BY ALL) GROUP BY 1),
r AS (SELECT x.c_nationkey, list_filter([CASE WHEN x.digest IS DISTINCT FROM y.digest THEN 'digest_changed' END, CASE WHEN x.n IS DISTINCT FROM y.n THEN 'n_changed' END, CASE WHEN coalesce(TIMESTAMP '1998-08-02' - latest > INTERVAL 3 DAY, true) THEN 'too_old' END], lambda z: z IS NOT NULL) AS reasons, x.n - coalesce(y.n, 0) AS n_more, y.n AS had FROM x LEFT JOIN y USING (c_nationkey))
SELECT c_nationkey, CASE WHEN had IS NULL THEN 'miss' WHEN len(reasons) = 0 THEN 'hit' ELSE 'stale' END AS status, array_to_string(reasons, ',') AS reasons, n_more FROM r""",
    "scan_drift": """WITH g AS (SELECT year(o_orderdate) AS y, count(*) AS n, count(*) FILTER ((o_orderkey % 30 = 0 AND year(o_orderdate) % 3 = 0) OR (o_orderkey % 4 = 0 AND year(o_orderdate) % 5 = 0)) AS during, count(*) FILTER (o_orderkey % 11 = 0 AND year(o_orderdate) % 2 = 0) AS since FROM orders GROUP BY 1),
s AS (SELECT *, CASE WHEN during = 0 AND since = 0 THEN 'fresh' WHEN during > 500 OR during / n::DOUBLE > 0.1 THEN 'stale' WHEN during > 0 THEN 'partial' WHEN y <> 1994 AND since > 0 THEN 'stale' ELSE 'fresh' END AS status FROM g)
SELECT y::BIGINT AS y, n, during, since, status, CASE WHEN y = 1996 THEN 'missing' ELSE status END AS readiness FROM s""",
    "surface_diff": f"""WITH {CODE}, {_OLD}, {_NEW}, a AS (SELECT DISTINCT file_id, 'classes' AS category, unnest(classes) AS name FROM old UNION SELECT file_id, 'functions', unnest(functions) FROM old), b AS (SELECT DISTINCT file_id, 'classes' AS category, unnest(classes) AS name FROM new UNION SELECT file_id, 'functions', unnest(functions) FROM new)
(SELECT *, 'removed' AS status FROM (SELECT * FROM a EXCEPT SELECT * FROM b)) UNION ALL (SELECT *, 'added' FROM (SELECT * FROM b EXCEPT SELECT * FROM a))""",
    "unresolved_diff": f"""WITH {CODE}, {_OLD}, {_NEW}, {_resolution_sql("old", [("@app/*", "src/pages/*")], "ra")}, {_resolution_sql("new", PATTERNS, "rb")},
a AS (SELECT file_id, list(DISTINCT imported) AS u FROM ra WHERE status = 'unresolved' GROUP BY 1), b AS (SELECT file_id, list(DISTINCT imported) AS u FROM rb WHERE status = 'unresolved' GROUP BY 1),
d AS (SELECT file_id, array_to_string(list_sort(list_filter(coalesce(b.u, []), lambda x: NOT list_contains(coalesce(a.u, []), x))), ' ') AS added, array_to_string(list_sort(list_filter(coalesce(a.u, []), lambda x: NOT list_contains(coalesce(b.u, []), x))), ' ') AS removed FROM a FULL JOIN b USING (file_id))
SELECT * FROM d WHERE added <> '' OR removed <> ''""",
    "code_summary": f"WITH {PATHS}, l AS (SELECT *, {_language_sql()} AS language FROM paths) SELECT language, {_SUMS}, grouping(language)::BIGINT AS is_total FROM l GROUP BY ROLLUP (language)",
    "top_files": f"WITH {CODE} SELECT file_id, path, (4 * (len(functions) + len(classes)) + 3 * list_contains(imports, 'react')::INT + len(imports))::BIGINT AS score FROM code ORDER BY score DESC, path, file_id LIMIT 5",
    "first_symbols": f"WITH {CODE}, s AS (SELECT file_id, unnest(classes || functions) AS symbol, generate_subscripts(classes || functions, 1) AS n FROM code) SELECT symbol, min(file_id) AS file_id FROM s GROUP BY symbol ORDER BY min((file_id, n)) LIMIT 12",
    "route_table": f"WITH {CODE}, r AS (SELECT file_id, path, unnest(routes) AS r FROM code) SELECT DISTINCT file_id, upper(r['method']) AS method, r['path'] AS route, r['source'] AS handler, path || ':' || file_id AS location FROM r",
    "grouped_relationships": f"WITH {_RELATIONS} SELECT a, kind, count(*) AS n, count(DISTINCT (b, origin)) AS n_distinct, count(*) FILTER (score >= 0.7) AS high, count(*) FILTER (score < 0.4) AS low, array_to_string(list_sort(list(DISTINCT origin)), ',') AS origins FROM rel GROUP BY ALL",
}

QUERIES = {f.__name__: f for f in (
    edge_order, traversal, traced_edges, script_resolution, module_resolution, test_sources, test_hints, merged_relationships, origin_scores, signal_scores, frameworks, entry_points,
    bounded_warnings, contract_values, digests, line_places, cache_reuse, scan_drift, surface_diff, unresolved_diff, code_summary, top_files, first_symbols, route_table, grouped_relationships,
)}
