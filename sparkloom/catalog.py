"""Queries that apply the operators to the driver's tables, with their SQL.

``documents`` stand for files (path: source/doc_id.lang), ``pages`` for routes, ``events`` for steps whose successors are
edges, foreign keys for dependencies, ``labels`` for expected tiers, dated parts of ``orders`` for snapshots.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import predicates as P
from .functions import text as T
from .operators import compare, folds, graph, joining, ranking, relations
from .plans import code_queries, contract_queries, graph_queries, parser_queries, relation_queries, report_queries, route_queries, syntax_queries
from .sources import parsing, tables
from .streaming import changes

TERMS = ["the", "and", "import", "service", "route", "api", "die", "que"]
CUT = "1998-01-01"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read(spark, sf_dir, "documents")
    return d.select(F.concat_ws("/", "source", F.concat_ws(".", F.col("doc_id").cast("string"), "lang")).alias("path"), "doc_id", "source", "lang", F.col("n_chars").alias("size"), F.coalesce("text", F.lit("")).alias("text"))


def term_hits(text: Column) -> Column:
    """How many of TERMS a text has among its tokens."""
    return F.size(F.array_intersect(F.array(*[F.lit(t) for t in TERMS]), T.tokens(text)))


def budget_fill(spark, sf_dir):
    """Over all files of each source."""
    f = files(spark, sf_dir).select("source", "path", term_hits(F.col("text")).alias("score"), T.estimate_tokens(F.char_length("text")).alias("tokens"))
    return folds.fill_budget(spark, f, ["source"], [F.desc("score"), F.col("path")], "path", "tokens", 4000)


def token_estimates(spark, sf_dir):
    n = F.char_length("text")
    return files(spark, sf_dir).select("doc_id", T.estimate_tokens(n).alias("tokens"), T.estimate_tokens_conservative(n).alias("tokens_safe"), T.efficiency_percent(n.cast("long"), F.least(n, F.lit(1000)).cast("long")).alias("saved_percent"))


def page_hosts_links(spark, sf_dir):
    links = F.size(F.regexp_extract_all("html", F.lit(r'href="([^"]*)"'), 1)).cast("long")
    return read(spark, sf_dir, "pages").select("page_id", T.url_host(F.col("url")).alias("host"), T.url_path(F.col("url")).alias("path"), links.alias("n_links"))


def event_edges(spark, sf_dir) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = read(spark, sf_dir, "events").select(F.col("event_type").alias("a"), F.lead("event_type").over(w).alias("b"))
    return e.where("b is not null").groupBy("a", "b").agg(F.count("*").alias("n"))


def event_cycles(spark, sf_dir):
    return graph.cycles(spark, event_edges(spark, sf_dir), "a", "b").select(F.array_join("path", ">").alias("cycle"), F.size("path").cast("long").alias("n"))


def event_scc(spark, sf_dir):
    return graph.strong_components(spark, event_edges(spark, sf_dir), "a", "b")


def fk_edges(spark, sf_dir) -> DataFrame:
    """``child, parent`` of the keys from customer and supplier up to region."""
    r = lambda t: read(spark, sf_dir, t)
    pre = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    n = r("nation").select(pre("n", "n_nationkey").alias("child"), pre("r", "n_regionkey").alias("parent"))
    c = r("customer").select(pre("c", "c_custkey").alias("child"), pre("n", "c_nationkey").alias("parent"))
    s = r("supplier").select(pre("s", "s_suppkey").alias("child"), pre("n", "s_nationkey").alias("parent"))
    return n.unionByName(c).unionByName(s)


def fk_impact(spark, sf_dir):
    e = fk_edges(spark, sf_dir)
    found = graph.reachable(spark, e, e.select(F.col("parent").alias("seed")), "parent", "child")
    out = found.groupBy("seed").agg(F.count_if(F.col("depth") == 1).alias("direct"), F.count("*").alias("transitive"))
    return out.withColumn("risk", P.risk_level(F.col("direct"), F.col("transitive")))


def fk_connectivity(spark, sf_dir):
    e = fk_edges(spark, sf_dir)
    nodes = e.select(F.col("child").alias("x")).union(e.select(F.col("parent").alias("x")))
    return graph.connectivity(nodes, e, "x", "child", "parent")


def degree_topk(spark, sf_dir):
    return ranking.top_counts(read(spark, sf_dir, "lineitem").select("l_partkey"), "l_partkey", 5)


def valued_files(spark, sf_dir) -> DataFrame:
    """``path, cost, value, folder_role`` of every file."""
    f = files(spark, sf_dir).select("path", "size", term_hits(F.col("text")).alias("score"))
    f = f.withColumn("cost", P.analysis_cost(F.col("size"), P.is_test_path(F.col("path")), P.is_generated_path(F.col("path"))))
    f = f.withColumn("value", P.value_score(F.col("score"), F.col("cost")))
    return f.select("path", "cost", "value", P.folder_role(F.col("path")).alias("folder_role"))


def value_rank(spark, sf_dir):
    return valued_files(spark, sf_dir).orderBy(F.desc("value"), "cost", "path").limit(300)


def duplicate_routes(spark, sf_dir):
    p = page_hosts_links(spark, sf_dir)
    return compare.duplicates(p, ["host", "path"], "page_id")


def duplicate_text(spark, sf_dir):
    d = read(spark, sf_dir, "documents").groupBy("source", F.sha2("text", 256).alias("h")).agg(F.count("*").alias("n"))
    return d.groupBy("source").agg(F.sum(F.col("n") - 1).alias("n_duplicates"), F.count("*").alias("n_distinct"))


def customer_snapshots(spark, sf_dir):
    o = read(spark, sf_dir, "orders")
    mark = F.concat_ws("|", F.count("*").cast("string"), F.max("o_orderkey").cast("string")).alias("mark")
    return o.where(F.col("o_orderdate") < CUT).groupBy("o_custkey").agg(mark), o.groupBy("o_custkey").agg(mark)


def snapshot_diff(spark, sf_dir):
    return compare.fingerprint_diff(*customer_snapshots(spark, sf_dir), "o_custkey", "mark")


def edge_diff(spark, sf_dir):
    """Which (customer nation, priority) edges came or went between the two parts of orders."""
    o = read(spark, sf_dir, "orders").join(read(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    o = o.select(F.col("c_nationkey").alias("source"), F.col("o_orderpriority").alias("target"), F.year("o_orderdate").alias("y"), "o_orderdate")
    return compare.set_diff(o.where(F.col("o_orderdate") < CUT), o.where(F.col("o_orderdate") >= CUT), ["source", "target", "y"])


def referential_check(spark, sf_dir):
    c, o, l, p = (read(spark, sf_dir, t) for t in ("customer", "orders", "lineitem", "part"))
    checks = {
        "lineitem_without_order": joining.missing_partners(l, "l_orderkey", o, "o_orderkey"),
        "lineitem_without_part": joining.missing_partners(l, "l_partkey", p, "p_partkey"),
        "order_without_customer": joining.missing_partners(o, "o_custkey", c, "c_custkey"),
        "customer_without_order": joining.missing_partners(c, "c_custkey", o, "o_custkey"),
    }
    out = None
    for name, rows in checks.items():
        one = rows.agg(F.count("*").alias("n")).select(F.lit(name).alias("check"), "n")
        out = one if out is None else out.unionByName(one)
    return out


def neighbours(spark, sf_dir):
    e = fk_edges(spark, sf_dir)
    inside = read(spark, sf_dir, "nation").where("n_regionkey = 0").select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("x"))
    return joining.neighbours_of_set(e, inside, "child", "parent", "x")


def best_supplier(spark, sf_dir):
    s = read(spark, sf_dir, "supplier").select("s_nationkey", F.floor(F.col("s_acctbal") / 1000).cast("long").alias("score"), "s_suppkey")
    return ranking.best_or_ambiguous(s, ["s_nationkey"], "score", "s_suppkey")


def longest_prefix(spark, sf_dir):
    p = page_hosts_links(spark, sf_dir).select("page_id", F.concat("host", "path").alias("name"))
    owners = p.select(F.substring_index("name", "/", 2).alias("owner")).union(p.select(F.substring_index("name", "/", 1).alias("owner")))
    return joining.longest_prefix(p, "page_id", "name", owners, "owner")


def import_cascade(spark, sf_dir):
    """Pages resolve first to a document of the number in their path and language, then to one of the number alone."""
    p = page_hosts_links(spark, sf_dir).select("page_id", F.regexp_extract("path", r"^/([a-z]+)/", 1).alias("lang"), F.regexp_extract("path", r"/([0-9]+)$", 1).alias("number"))
    d = read(spark, sf_dir, "documents").select("doc_id", "lang")
    index = d.select(F.concat_ws("/", "lang", F.col("doc_id").cast("string")).alias("k")).union(d.select(F.col("doc_id").cast("string")))
    out = joining.resolve_cascade(p, "page_id", F.array(F.concat_ws("/", "lang", "number"), F.col("number")), index, "k")
    return out.select("page_id", "resolved", F.col("step").cast("long").alias("step"))


def probe_pool(spark, sf_dir):
    f = files(spark, sf_dir).select("path", "source", "size", term_hits(F.col("text")).alias("score"))
    w = lambda *o: F.row_number().over(Window.orderBy(*o))
    top = lambda *o: f.orderBy(*o).limit(20).withColumn("rank", w(*o))
    lanes = [top(F.desc("score"), F.col("path")), top(F.desc("size"), F.col("path"))]
    return ranking.merged_lanes(lanes, "path", "source", per_lane=20, per_group=5, total=40).select("path", "source", F.col("lane").cast("long").alias("lane"), F.col("place").cast("long").alias("place"))


def relationship_caps(spark, sf_dir):
    l = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", "l_returnflag").groupBy("l_orderkey").agg(F.min("l_suppkey").alias("l_suppkey"), F.min("l_returnflag").alias("l_returnflag"))
    return relations.interacting_caps(spark, l, "l_orderkey", {"l_suppkey": 3, "l_returnflag": 100}, 250)


def content_probe(spark, sf_dir):
    f = files(spark, sf_dir)
    made = parsing.probe_score(F.col("text"), TERMS)
    return f.select("doc_id", *[made[k].alias(k) for k in made]).withColumn("band", P.relevance_band(F.col("relevance")))


def quality_at_10(spark, sf_dir):
    f = files(spark, sf_dir).select("source", "doc_id", term_hits(F.col("text")).alias("score"))
    ranked = ranking.top_per_group(f, ["source"], [F.desc("score"), F.col("doc_id")], 10)
    tier = F.when(F.col("toxic") == 1, "distractor").when((F.col("quality") == 1) & (F.col("doc_id") % 2 == 0), "critical").when(F.col("quality") == 1, "useful").otherwise("irrelevant")
    expected = f.join(read(spark, sf_dir, "labels"), "doc_id").select("source", "doc_id", tier.alias("tier"))
    return compare.quality_at_k(ranked, expected, "source", "doc_id", "rank", "tier", 10)


def route_templates(spark, sf_dir):
    """Pages whose path fits the template of their language: equal arity, open number."""
    p = page_hosts_links(spark, sf_dir)
    t = p.select(F.concat(F.substring_index("path", "/", 2), F.lit("/{id}")).alias("template"), F.substring_index("path", "/", 2).alias("head")).distinct()
    j = p.withColumn("head", F.substring_index("path", "/", 2)).join(t, "head").where(T.template_matches(F.col("template"), F.col("path")))
    return j.select("page_id", "template")


def merged_scores(spark, sf_dir):
    e = read(spark, sf_dir, "events").select("user_id", "event_type", (F.least(F.col("value"), F.lit(100.0)) / 200).alias("score"), (F.col("event_type") == "signup").alias("explicit"))
    return folds.merge_scores(e, ["user_id", "event_type"], "score", "explicit")


def first_conflicts(spark, sf_dir):
    return folds.first_and_conflicts(read(spark, sf_dir, "orders"), ["o_custkey", "o_orderpriority"], "o_orderkey", ["o_orderstatus"])


def health_gate(spark, sf_dir):
    o = read(spark, sf_dir, "orders").groupBy("o_orderpriority").agg(F.count("*").alias("n"), F.count_if(F.col("o_orderstatus") == "P").alias("n_open"))
    return compare.status_by_rules(o, F.col("n_open") * 3 > F.col("n"), F.col("n_open") * 4 > F.col("n"))


def contract_status(spark, sf_dir):
    o = read(spark, sf_dir, "orders").select("o_custkey", F.col("o_orderstatus").alias("status"))
    return compare.first_status(o, ["o_custkey"], "status", ["P", "O", "F"], "missing")


def contract_pairs(spark, sf_dir):
    l = read(spark, sf_dir, "lineitem").join(read(spark, sf_dir, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    one = l.groupBy("l_partkey", "s_nationkey").agg(F.max("l_returnflag").alias("flag"))
    return compare.agreement_pairs(one, "l_partkey", "s_nationkey", "flag")


def event_walk(spark, sf_dir):
    e = event_edges(spark, sf_dir).where("a <> b")
    return graph.best_walk(spark, e, e.select(F.col("a").alias("seed")).distinct(), "a", "b", "n").select("seed", F.col("step").cast("long").alias("step"), "node")


def session_turns(spark, sf_dir):
    w = Window.partitionBy("conv_id").orderBy("turn")
    c = read(spark, sf_dir, "conversations").withColumn("same", F.lag("role").over(w) == F.col("role"))
    return c.groupBy("conv_id").agg(F.count("*").alias("n"), F.count_if("same").alias("n_retries"), F.max_by("role", "turn").alias("last_role"))


def part_terms(spark, sf_dir):
    p = read(spark, sf_dir, "part").select(F.explode(T.name_tokens(F.col("p_name"))).alias("term"))
    return p.groupBy("term").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "term").limit(20)


def task_phrases(spark, sf_dir):
    b = read(spark, sf_dir, "benchmark").select("item_id", T.task_terms(F.col("text")).alias("t"))
    return b.select("item_id", F.size("t").cast("long").alias("n_terms"), F.size(T.phrases(F.col("t"))).cast("long").alias("n_phrases"), F.array_join(F.slice("t", 1, 5), " ").alias("head"))


def synthetic_facts(spark, sf_dir):
    return tables.synthetic_facts(spark, 5000)


def language_counts(spark, sf_dir):
    """Files by language and size class, every language with every class."""
    f = files(spark, sf_dir).select("lang", P.bins(F.col("size"), {"small": 500, "medium": 2000}, "large").alias("class"))
    dense = f.select("lang").distinct().select("lang", F.explode(F.array(*[F.lit(x) for x in ("small", "medium", "large")])).alias("class"))
    counts = f.groupBy("lang", "class").agg(F.count("*").alias("n"))
    return dense.join(counts, ["lang", "class"], "left").fillna(0, ["n"])


def strategy_summary(spark, sf_dir):
    """Over all files."""
    v = valued_files(spark, sf_dir)
    return v.groupBy("cost").agg(F.count("*").alias("n"), F.bround(F.avg("value"), 6).alias("avg_value"))


def hourly_events(spark, sf_dir):
    return changes.windowed_counts(read(spark, sf_dir, "events"), "ts", "event_type").withColumn("start", F.date_format("start", "yyyy-MM-dd HH:mm"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return budget_fill(spark, sf_dir)


_HITS = "len(list_intersect([" + ", ".join(f"'{t}'" for t in TERMS) + "], regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+')))"
_PATH = "source || '/' || doc_id || '.' || lang"
_EDGES = "edges AS (SELECT a, b, count(*) AS n FROM (SELECT event_type AS a, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS b FROM events) WHERE b IS NOT NULL GROUP BY a, b)"
_FK = "fk AS (SELECT 'n' || n_nationkey AS child, 'r' || n_regionkey AS parent FROM nation UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey FROM customer UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey FROM supplier)"
_PAGES = r"""hosted AS (SELECT page_id, html, regexp_replace(nullif(regexp_extract(lower(url), '^(?:https?|wss?)://([^/?#@]+)(?:[/?#]|$)', 1), ''), '^(127\.0\.0\.1|0\.0\.0\.0)(:|$)', 'localhost\2') AS host, '/' || trim(regexp_replace(regexp_extract(url, '^[a-zA-Z]+://[^/?#]*([^?#]*)', 1), '/+', '/', 'g'), '/') AS path FROM pages)"""
_VALUE = f"""ranked AS (SELECT path, cost, round_even(score / cost, 6) AS value, 'other' AS folder_role FROM (
  SELECT {_PATH} AS path, {_HITS} AS score, CASE WHEN n_chars <= 16384 THEN 1 WHEN n_chars <= 131072 THEN 2 WHEN n_chars <= 524288 THEN 4 WHEN n_chars <= 2097152 THEN 8 ELSE 16 END::BIGINT AS cost FROM documents))"""

SQL = {
    "budget_fill": f"""WITH RECURSIVE ranked AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY score DESC, path) AS place FROM (
  SELECT source, {_PATH} AS path, {_HITS} AS score, ceil(length(coalesce(text, '')) / 3.3::DOUBLE)::BIGINT AS tokens FROM documents)),
fold AS (SELECT source, 0::BIGINT AS place, 0::BIGINT AS used, ''::VARCHAR AS path, 0::BIGINT AS tokens, false AS admitted FROM (SELECT DISTINCT source FROM ranked)
  UNION ALL SELECT r.source, r.place, CASE WHEN f.used + r.tokens <= 4000 THEN f.used + r.tokens ELSE f.used END, r.path, r.tokens, f.used + r.tokens <= 4000 FROM fold f JOIN ranked r ON r.source = f.source AND r.place = f.place + 1)
SELECT source, path, tokens, place, admitted FROM fold WHERE place > 0""",
    "token_estimates": "SELECT doc_id, ceil(n / 3.3::DOUBLE)::BIGINT AS tokens, ((n + 2) // 3)::BIGINT AS tokens_safe, CASE WHEN n > 0 THEN (n - least(n, 1000)) * 100 // n ELSE 0 END::BIGINT AS saved_percent FROM (SELECT doc_id, length(coalesce(text, '')) AS n FROM documents)",
    "page_hosts_links": f"WITH {_PAGES} SELECT page_id, host, path, len(regexp_extract_all(html, 'href=\"([^\"]*)\"'))::BIGINT AS n_links FROM hosted",
    "event_cycles": f"""WITH RECURSIVE {_EDGES}, paths AS (SELECT a AS s, b AS z, [a, b] AS p FROM edges WHERE a < b
  UNION ALL SELECT s, e.b, list_append(p, e.b) FROM paths JOIN edges e ON e.a = z WHERE e.b > s AND NOT list_contains(p, e.b))
SELECT array_to_string(p, '>') AS cycle, len(p)::BIGINT AS n FROM paths JOIN edges e ON e.a = z AND e.b = s UNION ALL SELECT a, 1 FROM edges WHERE a = b""",
    "event_scc": f"""WITH RECURSIVE {_EDGES}, reach AS (SELECT a, b FROM edges UNION SELECT r.a, e.b FROM reach r JOIN edges e ON r.b = e.a)
SELECT x.a AS node, least(x.a, min(x.b)) AS component FROM reach x JOIN reach y ON x.a = y.b AND x.b = y.a WHERE x.a <> x.b GROUP BY x.a""",
    "fk_impact": f"""WITH RECURSIVE {_FK}, reach AS (SELECT parent AS seed, child AS node FROM fk UNION SELECT r.seed, f.child FROM reach r JOIN fk f ON f.parent = r.node)
SELECT seed, d AS direct, t AS transitive, CASE WHEN greatest(d, t) = 0 THEN 'low' WHEN greatest(d, t) <= 2 THEN 'medium' ELSE 'high' END AS risk
FROM (SELECT seed, count(*) AS t FROM reach GROUP BY seed) JOIN (SELECT parent AS seed, count(DISTINCT child) AS d FROM fk GROUP BY parent) USING (seed)""",
    "fk_connectivity": f"""WITH {_FK}, nodes AS (SELECT child AS node FROM fk UNION SELECT parent FROM fk)
SELECT node, n_in, n_out, CASE WHEN n_in = 0 AND n_out = 0 THEN 'isolated' WHEN n_in = 0 THEN 'root' WHEN n_out = 0 THEN 'leaf' ELSE 'inner' END AS kind FROM (
  SELECT node, (SELECT count(*) FROM fk WHERE parent = node) AS n_in, (SELECT count(*) FROM fk WHERE child = node) AS n_out FROM nodes)""",
    "degree_topk": "SELECT l_partkey, count(*) AS count FROM lineitem GROUP BY l_partkey ORDER BY 2 DESC, 1 DESC LIMIT 5",
    "value_rank": f"WITH {_VALUE} SELECT * FROM ranked ORDER BY value DESC, cost, path LIMIT 300",
    "strategy_summary": f"WITH {_VALUE} SELECT cost, count(*) AS n, round_even(avg(value), 6) AS avg_value FROM ranked GROUP BY cost",
    "duplicate_routes": f"WITH {_PAGES} SELECT host, path, count(*) AS n, min(page_id) AS first_item, max(page_id) AS last_item FROM hosted GROUP BY host, path HAVING count(*) > 1",
    "duplicate_text": "SELECT source, (count(*) - count(DISTINCT text))::BIGINT AS n_duplicates, count(DISTINCT text) AS n_distinct FROM documents GROUP BY source",
    "snapshot_diff": f"""WITH a AS (SELECT o_custkey, count(*) || '|' || max(o_orderkey) AS mark FROM orders WHERE o_orderdate < TIMESTAMP '{CUT}' GROUP BY 1), b AS (SELECT o_custkey, count(*) || '|' || max(o_orderkey) AS mark FROM orders GROUP BY 1)
SELECT o_custkey, CASE WHEN a.mark IS NULL THEN 'added' WHEN b.mark IS NULL THEN 'removed' ELSE 'changed' END AS status FROM a FULL JOIN b USING (o_custkey) WHERE a.mark IS DISTINCT FROM b.mark""",
    "edge_diff": f"""WITH e AS (SELECT c_nationkey AS source, o_orderpriority AS target, year(o_orderdate)::INT AS y, o_orderdate < TIMESTAMP '{CUT}' AS old FROM orders JOIN customer ON o_custkey = c_custkey)
SELECT source, target, y, CASE WHEN bool_and(old) THEN 'removed' WHEN bool_or(old) THEN 'kept' ELSE 'added' END AS status FROM e GROUP BY 1, 2, 3""",
    "referential_check": """SELECT 'lineitem_without_order' AS "check", count(*) AS n FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders) UNION ALL SELECT 'lineitem_without_part', count(*) FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part)
UNION ALL SELECT 'order_without_customer', count(*) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer) UNION ALL SELECT 'customer_without_order', count(*) FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)""",
    "neighbours": f"""WITH {_FK}, m AS (SELECT 'n' || n_nationkey AS x FROM nation WHERE n_regionkey = 0)
SELECT DISTINCT parent AS node, 'out' AS direction FROM fk WHERE child IN (SELECT x FROM m) AND parent NOT IN (SELECT x FROM m) UNION SELECT DISTINCT child, 'in' FROM fk WHERE parent IN (SELECT x FROM m) AND child NOT IN (SELECT x FROM m)""",
    "best_supplier": "SELECT s_nationkey, score, count(*) AS ties, CASE WHEN count(*) = 1 THEN min(s_suppkey) END AS s_suppkey, count(*) > 1 AS ambiguous FROM (SELECT s_nationkey, s_suppkey, floor(s_acctbal / 1000)::BIGINT AS score FROM supplier QUALIFY rank() OVER (PARTITION BY s_nationkey ORDER BY floor(s_acctbal / 1000) DESC) = 1) GROUP BY 1, 2",
    "longest_prefix": f"""WITH {_PAGES}, named AS (SELECT page_id, host || path AS name FROM hosted), owners AS (SELECT DISTINCT array_to_string(string_split(name, '/')[1:2], '/') AS owner FROM named UNION SELECT DISTINCT string_split(name, '/')[1] FROM named)
SELECT page_id, arg_max(owner, length(owner)) AS owner FROM named JOIN owners ON name = owner OR starts_with(name, owner || '/') GROUP BY page_id""",
    "import_cascade": f"""WITH {_PAGES}, p AS (SELECT page_id, regexp_extract(path, '^/([a-z]+)/', 1) AS lang, regexp_extract(path, '/([0-9]+)$', 1) AS number FROM hosted)
SELECT page_id, coalesce(a.lang || '/' || a.doc_id, b.doc_id::VARCHAR) AS resolved, CASE WHEN a.doc_id IS NOT NULL THEN 0 WHEN b.doc_id IS NOT NULL THEN 1 END::BIGINT AS step
FROM p LEFT JOIN documents a ON a.lang = p.lang AND a.doc_id::VARCHAR = p.number LEFT JOIN documents b ON b.doc_id::VARCHAR = p.number""",
    "probe_pool": f"""WITH f AS (SELECT {_PATH} AS path, source, n_chars AS size, {_HITS} AS score FROM documents),
lanes AS ((SELECT path, source, 0 AS lane, row_number() OVER (ORDER BY score DESC, path) AS rank FROM f QUALIFY rank <= 20) UNION ALL (SELECT path, source, 1, row_number() OVER (ORDER BY size DESC, path) AS rank FROM f QUALIFY rank <= 20)),
firsts AS (SELECT * FROM lanes QUALIFY row_number() OVER (PARTITION BY path ORDER BY lane, rank) = 1), kept AS (SELECT * FROM firsts QUALIFY row_number() OVER (PARTITION BY source ORDER BY lane, rank) <= 5)
SELECT path, source, lane::BIGINT AS lane, row_number() OVER (ORDER BY lane, rank) AS place FROM kept QUALIFY place <= 40""",
    "content_probe": rf"""SELECT doc_id, coverage, has_import, has_signature, has_route, least(1.0, 0.7::DOUBLE * coverage + 0.1::DOUBLE * has_import::INT + 0.1::DOUBLE * has_signature::INT + 0.1::DOUBLE * has_route::INT) AS relevance,
  CASE WHEN least(1.0, 0.7::DOUBLE * coverage + 0.1::DOUBLE * has_import::INT + 0.1::DOUBLE * has_signature::INT + 0.1::DOUBLE * has_route::INT) >= 0.7 THEN 'high' WHEN 0.7::DOUBLE * coverage + 0.1::DOUBLE * has_import::INT + 0.1::DOUBLE * has_signature::INT + 0.1::DOUBLE * has_route::INT >= 0.4 THEN 'medium' WHEN coverage > 0 OR has_import OR has_signature OR has_route THEN 'low' ELSE 'unknown' END AS band
FROM (SELECT doc_id, {_HITS} / {len(TERMS)}::DOUBLE AS coverage, regexp_matches(coalesce(text, ''), '(?m)^\s*(?:from\s+\S+\s+import\s+|import\s+|export\s+)') AS has_import,
  regexp_matches(coalesce(text, ''), '(?m)^\s*(?:(?:async\s+)?(?:def|class|function)\s+\w+|export\s+(?:default\s+)?(?:class|function|const)\s+)') AS has_signature,
  regexp_matches(coalesce(text, ''), '(?i)@(component|directive|injectable|route|get|post|put|delete)\b|\b(?:router|routes?)\s*[.(=:]|\bpath\s*\(') AS has_route FROM documents)""",
    "quality_at_10": f"""WITH f AS (SELECT source, doc_id, {_HITS} AS score FROM documents), e AS (SELECT source, doc_id, CASE WHEN toxic = 1 THEN 'distractor' WHEN quality = 1 AND doc_id % 2 = 0 THEN 'critical' WHEN quality = 1 THEN 'useful' ELSE 'irrelevant' END AS tier FROM f JOIN labels USING (doc_id)),
r AS (SELECT source, doc_id FROM f QUALIFY row_number() OVER (PARTITION BY source ORDER BY score DESC, doc_id) <= 10), h AS (SELECT r.source, count(*) AS n, count(*) FILTER (tier = 'critical') AS c, count(*) FILTER (tier = 'useful') AS u, count(*) FILTER (tier = 'distractor') AS d FROM r LEFT JOIN e USING (source, doc_id) GROUP BY r.source),
t AS (SELECT source, count(*) FILTER (tier = 'critical') AS critical, count(*) FILTER (tier = 'useful') AS useful FROM e GROUP BY source)
SELECT source, coalesce(n, 0) AS evaluated, CASE WHEN coalesce(critical, 0) = 0 THEN 1.0 ELSE coalesce(c, 0) / critical::DOUBLE END::DOUBLE AS critical_recall, CASE WHEN coalesce(useful, 0) = 0 THEN 1.0 ELSE coalesce(u, 0) / useful::DOUBLE END::DOUBLE AS useful_coverage, CASE WHEN coalesce(n, 0) = 0 THEN 0 ELSE d / n::DOUBLE END::DOUBLE AS distractor_rate,
  coalesce(critical, 0) - coalesce(c, 0) AS missed_critical, CASE WHEN coalesce(n, 0) = 0 THEN 0 ELSE (n - c - u) / n::DOUBLE END::DOUBLE AS context_waste FROM t FULL JOIN h USING (source)""",
    "route_templates": rf"WITH {_PAGES} SELECT page_id, array_to_string(string_split(path, '/')[1:2], '/') || '/{{id}}' AS template FROM hosted WHERE len(string_split(path, '/')) = 3",
    "first_conflicts": "SELECT o_custkey, o_orderpriority, min(o_orderkey) AS o_orderkey, arg_min(o_orderstatus, o_orderkey) AS o_orderstatus, count(*) AS n, count(DISTINCT o_orderstatus) > 1 AS conflict FROM orders GROUP BY 1, 2",
    "health_gate": "SELECT o_orderpriority, count(*) AS n, count(*) FILTER (o_orderstatus = 'P') AS n_open, CASE WHEN count(*) FILTER (o_orderstatus = 'P') * 3 > count(*) THEN 'FAIL' WHEN count(*) FILTER (o_orderstatus = 'P') * 4 > count(*) THEN 'WARN' ELSE 'PASS' END AS status FROM orders GROUP BY 1",
    "contract_status": "SELECT o_custkey, CASE WHEN bool_or(o_orderstatus = 'P') THEN 'P' WHEN bool_or(o_orderstatus = 'O') THEN 'O' WHEN bool_or(o_orderstatus = 'F') THEN 'F' ELSE 'missing' END AS status FROM orders GROUP BY 1",
    "contract_pairs": "WITH o AS (SELECT l_partkey, s_nationkey, max(l_returnflag) AS f FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2) SELECT x.s_nationkey AS a, y.s_nationkey AS b, count(*) FILTER (x.f = y.f) AS n_agree, count(*) FILTER (x.f <> y.f) AS n_differ FROM o x JOIN o y ON x.l_partkey = y.l_partkey AND x.s_nationkey < y.s_nationkey GROUP BY 1, 2",
    "event_walk": f"""WITH RECURSIVE {_EDGES}, best AS (SELECT a, b FROM edges WHERE a <> b QUALIFY row_number() OVER (PARTITION BY a ORDER BY n DESC, b) = 1),
walk AS (SELECT a AS seed, 0::BIGINT AS step, a AS node, [a] AS p FROM best UNION ALL SELECT seed, step + 1, b, list_append(p, b) FROM walk JOIN best ON node = a WHERE NOT list_contains(p, b) AND step < 19) SELECT seed, step, node FROM walk""",
    "session_turns": "SELECT conv_id, count(*) AS n, count(*) FILTER (same)::BIGINT AS n_retries, arg_max(role, turn) AS last_role FROM (SELECT conv_id, turn, role, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) = role AS same FROM conversations) GROUP BY conv_id",
    "part_terms": "SELECT term, count(*) AS n FROM (SELECT unnest(regexp_extract_all(lower(regexp_replace(p_name, '([a-z0-9])([A-Z])', '\\1 \\2', 'g')), '[a-z0-9]+')) AS term FROM part) GROUP BY term ORDER BY n DESC, term LIMIT 20",
    "synthetic_facts": "SELECT i AS row, printf('src/module_%05d.py', i) AS path, i * 37 % 8192 + 128 AS size, substr(sha256(i::VARCHAR), 1, 16) AS digest FROM range(5000) t(i)",
    "language_counts": "WITH f AS (SELECT lang, CASE WHEN n_chars <= 500 THEN 'small' WHEN n_chars <= 2000 THEN 'medium' ELSE 'large' END AS class FROM documents) SELECT l.lang, c.class, count(f.lang) AS n FROM (SELECT DISTINCT lang FROM f) l CROSS JOIN (VALUES ('small'), ('medium'), ('large')) c(class) LEFT JOIN f ON f.lang = l.lang AND f.class = c.class GROUP BY 1, 2",
    "relationship_caps": """WITH RECURSIVE base AS (SELECT l_orderkey, min(l_suppkey) AS l_suppkey, min(l_returnflag) AS l_returnflag FROM lineitem GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY l_orderkey) AS n FROM base),
f AS (SELECT 0::BIGINT AS n, []::BIGINT[] AS s, []::VARCHAR[] AS t, NULL::VARCHAR AS reason
  UNION ALL SELECT r.n, CASE WHEN why IS NULL THEN list_append(s, l_suppkey) ELSE s END, CASE WHEN why IS NULL THEN list_append(t, l_returnflag) ELSE t END, why FROM (
    SELECT r.*, s, t, CASE WHEN len(list_filter(s, lambda x: x = r.l_suppkey)) >= 3 THEN 'l_suppkey' WHEN len(list_filter(t, lambda x: x = r.l_returnflag)) >= 100 THEN 'l_returnflag' END AS why FROM f JOIN r ON r.n = f.n + 1 WHERE len(s) < 250) r)
SELECT l_orderkey, l_suppkey, l_returnflag, f.n IS NOT NULL AND reason IS NULL AS kept, CASE WHEN f.n IS NULL THEN 'total' ELSE reason END AS drop_reason FROM r LEFT JOIN (SELECT n, reason FROM f) f USING (n)""",
    "merged_scores": """WITH e AS (SELECT user_id, event_type, round_even(least(value, 100.0) / 200 * 1000, 0)::BIGINT AS s, event_type = 'signup' AS explicit FROM events),
g AS (SELECT user_id, event_type, list_sort(list({'s': s, 'n': n})) AS l, max(s) AS top, bool_or(x) AS explicit, sum(n)::BIGINT AS n FROM (SELECT user_id, event_type, s, count(*) AS n, bool_or(explicit) AS x FROM e GROUP BY ALL) GROUP BY user_id, event_type)
SELECT user_id, event_type, CASE WHEN explicit THEN top ELSE list_reduce(l, lambda a, x: {'s': CASE WHEN a.s = x.s THEN a.s ELSE least(1000, greatest(a.s, x.s) + 50 * x.n) END, 'n': 0::BIGINT}).s END / 1000.0::DOUBLE AS score, explicit, n FROM g""",
    "task_phrases": f"""WITH b AS (SELECT item_id, list_filter(regexp_extract_all(lower(text), '[a-z0-9]+'), lambda x: length(x) > 2 AND NOT list_contains({[*T.TASK_STOP_WORDS]}, x)) AS w FROM benchmark), t AS (SELECT item_id, list_filter(w, lambda x, i: list_position(w, x) = i) AS t FROM b)
SELECT item_id, len(t)::BIGINT AS n_terms, len(list_distinct(list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1]) || list_transform(range(1, len(t) - 1), lambda i: t[i] || ' ' || t[i + 1] || ' ' || t[i + 2])))::BIGINT AS n_phrases, array_to_string(t[1:5], ' ') AS head FROM t""",
    "hourly_events": "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M') AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2",
}

QUERIES = {f.__name__: f for f in (
    budget_fill, token_estimates, page_hosts_links, event_cycles, event_scc, fk_impact, fk_connectivity, degree_topk, value_rank, duplicate_routes,
    duplicate_text, snapshot_diff, edge_diff, referential_check, neighbours, best_supplier, longest_prefix, import_cascade, probe_pool, relationship_caps,
    content_probe, quality_at_10, route_templates, merged_scores, first_conflicts, health_gate, contract_status, contract_pairs, event_walk, session_turns,
    part_terms, task_phrases, synthetic_facts, language_counts, strategy_summary, hourly_events,
)}


def queries() -> dict:
    return QUERIES | code_queries.QUERIES | relation_queries.QUERIES | parser_queries.QUERIES | report_queries.QUERIES | syntax_queries.QUERIES | route_queries.QUERIES | graph_queries.QUERIES | contract_queries.QUERIES


def oracle_sql() -> dict[str, str]:
    return SQL | code_queries.SQL | relation_queries.SQL | parser_queries.SQL | report_queries.SQL | syntax_queries.SQL | route_queries.SQL | graph_queries.SQL | contract_queries.SQL
