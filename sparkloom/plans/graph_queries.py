"""Queries on condensed graphs and on traces, with their SQL; the graphs stand on the rows of ``part``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import condensation, graph, traces
from ..store import Stage
from .relation_queries import _EDGES, priced_edges

#: A trace goes through the front end, over a boundary, through the back end, to a response.
MOVES = [
    ("frontend", "import", "frontend"), ("frontend", "template", "frontend"), ("frontend", "route", "boundary"), ("frontend", "config", "boundary"), ("boundary", "import", "backend"), ("boundary", "style", "backend"),
    ("backend", "re_export", "backend"), ("backend", "import", "backend"), ("backend", "unknown", "response"), ("backend", "template", "response"), ("boundary", "re_export", "response"),
]
STATES = ["frontend", "boundary", "backend", "response"]
DEPTH = 5
ORIGINS = ("explicit", "workspace_file", "local_path_reference", "inferred")


def block_edges(spark, sf_dir) -> DataFrame:
    """Edges inside blocks of seven files, and from each block's first file to another block: ``a, b, cost, origin, score``."""
    k, j = F.col("p_partkey"), F.col("j")
    parts = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", F.explode(F.array(*[F.lit(i) for i in range(3)])).alias("j"))
    inside = F.floor(k / 7) * 7 + F.when(j == 0, k * 3 + 1).otherwise(k * 5 + F.floor(k / 7)) % 7
    b = F.when(j < 2, inside).when(k % 7 == 0, F.floor(k / 2))
    rows = parts.select(k.alias("a"), b.cast("long").alias("b"), ((k * 13 + j * 5) % 17).alias("cost"), F.element_at(F.array(*[F.lit(o) for o in ORIGINS]), ((k + j) % 4 + 1).cast("int")).alias("origin"), ((k * 7 + j) % 20 / 20).alias("score"))
    n = parts.agg(F.max("p_partkey")).scalar()
    return rows.where(F.col("b").isNotNull() & (F.col("b") <= n) & (F.col("a") != F.col("b")))


def condensed_graph(spark, sf_dir):
    """Each component (one file counts as its own) with its size, level, edges and a cycle."""
    e = Stage(spark, "blocks").save(block_edges(spark, sf_dir))
    c = Stage(spark, "blocks").save(graph.strong_components(spark, e, "a", "b"))
    nodes = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").alias("node"))
    every = nodes.join(c, "node", "left").withColumn("component", F.coalesce("component", "node"))
    dag = Stage(spark, "blocks").save(condensation.condense(e, c, "a", "b", "cost"))
    level = condensation.levels(spark, every.select(F.col("component").alias("node")), dag.select("source", "target"))
    out = dag.groupBy(F.col("source").alias("component")).agg(F.sum("n_edges").alias("edges_out"), F.min("least").alias("least_cost"))
    cycle = condensation.component_cycles(spark, e, c, "a", "b").select("component", F.array_join("cycle", ">").alias("cycle"))
    sizes = every.groupBy("component").agg(F.count("*").alias("nodes"))
    rows = sizes.join(level.withColumnRenamed("node", "component"), "component").join(out, "component", "left").join(cycle, "component", "left")
    return rows.fillna(0, ["edges_out"]).withColumn("level", F.col("level").cast("long"))


def graph_summary(spark, sf_dir):
    e = Stage(spark, "blocks").save(block_edges(spark, sf_dir))
    nodes = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").alias("node"))
    return condensation.summary(nodes, e, graph.strong_components(spark, e, "a", "b"), graph.connectivity(nodes, e, "node", "a", "b"), "a", "b", "origin", "score")


def _reach(spark, sf_dir, until=None) -> DataFrame:
    e = priced_edges(spark, sf_dir).select("source", "target", F.col("edge_type").alias("kind"))
    seeds = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").alias("seed"))
    return Stage(spark, "reach").save(traces.constrained_reach(spark, e, seeds, MOVES, "frontend", max_depth=DEPTH, until=until))


def journey_traces(spark, sf_dir):
    """From each file the steps through front end, boundary, back end and response, and which of these it never gets to."""
    out = traces.trace_summary(_reach(spark, sf_dir), STATES)
    return out.withColumns({"gaps": F.array_join("gaps", ","), "depth": F.col("depth").cast("long")})


def journey_paths(spark, sf_dir):
    """The shortest way from each file to a response, if it has one."""
    p = traces.trace_paths(spark, _reach(spark, sf_dir, "response"), "response")
    return p.select("seed", F.array_join("path", ">").alias("path"), F.array_join("states", ">").alias("states"))


# --- SQL

_BLOCKS = f"""e AS (
  SELECT k AS a, CASE WHEN j = 0 THEN k // 7 * 7 + (k * 3 + 1) % 7 WHEN j = 1 THEN k // 7 * 7 + (k * 5 + k // 7) % 7 WHEN k % 7 = 0 THEN k // 2 END AS b, (k * 13 + j * 5) % 17 AS cost, {list(ORIGINS)}[(k + j) % 4 + 1] AS origin, (k * 7 + j) % 20 / 20 AS score
  FROM (SELECT p_partkey AS k, max(p_partkey) OVER () AS n FROM part), range(3) AS r(j) WHERE b <= n AND b <> k
),
d AS (SELECT DISTINCT a, b FROM e),
reach AS (SELECT a, b FROM d UNION SELECT r.a, d.b FROM reach r JOIN d ON r.b = d.a),
c AS (SELECT x.a AS node, least(x.a, min(x.b)) AS component FROM reach x JOIN reach y ON x.a = y.b AND x.b = y.a WHERE x.a <> x.b GROUP BY x.a),
every AS (SELECT p_partkey AS node, coalesce(component, p_partkey) AS component FROM part LEFT JOIN c ON node = p_partkey)"""
_TRACES = "".join(
    f""",
t{d} AS (SELECT seed, node, state, {d} AS depth, min({{'parent': parent, 'parent_state': parent_state, 'kind': kind}}) AS via FROM (
  SELECT t.seed, p.target AS node, m.next AS state, t.node AS parent, t.state AS parent_state, p.kind FROM t{d - 1} t JOIN steps p ON p.source = t.node JOIN moves m ON m.state = t.state AND m.kind = p.kind) x
  WHERE {" AND ".join(f"NOT EXISTS (SELECT 1 FROM t{k} o WHERE o.seed = x.seed AND o.node = x.node AND o.state = x.state)" for k in range(d))} GROUP BY seed, node, state)"""
    for d in range(1, DEPTH + 1)
)
_REACH = f"""WITH RECURSIVE {_EDGES}, steps AS MATERIALIZED (SELECT DISTINCT source, target, edge_type AS kind FROM priced),
moves AS (SELECT * FROM (VALUES {", ".join(str(m) for m in MOVES)}) AS m(state, kind, next)),
t0 AS (SELECT p_partkey AS seed, p_partkey AS node, 'frontend' AS state, 0 AS depth, {{'parent': NULL::BIGINT, 'parent_state': NULL::VARCHAR, 'kind': NULL::VARCHAR}} AS via FROM part){_TRACES},
reached AS MATERIALIZED ({" UNION ALL ".join(f"SELECT seed, node, state, depth, via.parent AS parent, via.parent_state AS parent_state FROM t{d}" for d in range(DEPTH + 1))})"""
_COUNTS = ", ".join(f"count(*) FILTER (state = '{s}') AS n_{s}" for s in STATES)

SQL = {
    "condensed_graph": f"""WITH RECURSIVE {_BLOCKS},
dag AS (SELECT p.component AS source, q.component AS target, cost FROM e JOIN every p ON p.node = a JOIN every q ON q.node = b WHERE p.component <> q.component),
walks AS (SELECT component AS node, 0 AS level FROM (SELECT DISTINCT component FROM every) UNION SELECT target, level + 1 FROM walks JOIN dag ON source = node),
ways AS (
  SELECT component, node AS at, [node] AS path FROM c WHERE node = component
  UNION ALL SELECT w.component, d.b, list_append(path, d.b) FROM ways w JOIN d ON d.a = w.at JOIN c ON c.node = d.b AND c.component = w.component WHERE NOT list_contains(path, d.b)
),
closed AS (SELECT w.component, path FROM ways w JOIN d ON d.a = w.at AND d.b = w.component WHERE len(path) > 1 QUALIFY row_number() OVER (PARTITION BY w.component ORDER BY len(path), list_reverse(path)) = 1),
sizes AS (SELECT component, count(*) AS nodes FROM every GROUP BY 1)
SELECT component, nodes, (SELECT max(level) FROM walks WHERE node = component) AS level, coalesce(edges_out, 0) AS edges_out, least_cost, array_to_string(path, '>') AS cycle FROM sizes LEFT JOIN closed USING (component)
LEFT JOIN (SELECT source AS component, count(*) AS edges_out, min(cost) AS least_cost FROM dag GROUP BY 1) USING (component)""",
    "graph_summary": f"""WITH RECURSIVE {_BLOCKS}, k AS (SELECT p_partkey AS node, count(*) FILTER (b = p_partkey) AS n_in, count(*) FILTER (a = p_partkey) AS n_out FROM part LEFT JOIN e ON a = p_partkey OR b = p_partkey GROUP BY 1)
SELECT (SELECT count(*) FROM part) AS n_nodes, count(*) AS n_edges, count(*) FILTER (origin = 'explicit') AS n_explicit, count(*) FILTER (origin <> 'explicit') AS n_inferred,
  count(*) FILTER (score >= 0.75) AS n_high, count(*) FILTER (score >= 0.45 AND score < 0.75) AS n_medium, count(*) FILTER (score < 0.45) AS n_low, (SELECT count(DISTINCT component) FROM c) AS n_cycles, (SELECT count(*) FROM c) AS n_in_cycles,
  (SELECT count(*) FROM k WHERE n_in = 0 AND n_out = 0) AS n_isolated, (SELECT count(*) FROM k WHERE n_in = 0 AND n_out > 0) AS n_root, (SELECT count(*) FROM k WHERE n_in > 0 AND n_out = 0) AS n_leaf, (SELECT count(*) FROM k WHERE n_in > 0 AND n_out > 0) AS n_inner FROM e""",
    "journey_traces": f"""{_REACH},
wide AS (SELECT seed, count(*) AS n_steps, max(depth)::BIGINT AS depth, {_COUNTS} FROM reached GROUP BY seed),
fan AS (SELECT seed, max(n) AS fan_out FROM (SELECT seed, count(*) AS n FROM reached WHERE parent IS NOT NULL GROUP BY seed, parent, parent_state) GROUP BY seed)
SELECT wide.*, coalesce(fan_out, 0) AS fan_out, concat_ws(',', {", ".join(f"CASE WHEN n_{s} = 0 THEN '{s}' END" for s in STATES)}) AS gaps FROM wide LEFT JOIN fan USING (seed)""",
    "journey_paths": f"""{_REACH},
ends AS (SELECT seed, min({{'depth': depth, 'node': node}}) AS e FROM reached WHERE state = 'response' GROUP BY seed),
up AS (
  SELECT seed, e.node AS node, 'response' AS state, e.node::VARCHAR AS path, 'response' AS states FROM ends
  UNION ALL SELECT u.seed, r.parent, r.parent_state, r.parent || '>' || path, r.parent_state || '>' || states FROM up u JOIN reached r ON r.seed = u.seed AND r.node = u.node AND r.state = u.state WHERE r.parent IS NOT NULL
)
SELECT seed, path, states FROM up WHERE node = seed AND state = 'frontend' AND NOT EXISTS (SELECT 1 FROM reached r WHERE r.seed = up.seed AND r.node = up.node AND r.state = up.state AND r.parent IS NOT NULL)""",
}

QUERIES = {f.__name__: f for f in (condensed_graph, graph_summary, journey_traces, journey_paths)}
