"""Contracts and the places where they are observed; suppliers are contracts, lines of orders references, parts declarations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import contracts
from ..operators.contracts import COMPATIBLE

KINDS, TYPES = (*COMPATIBLE, "unknown"), ("iframe_src", "environment_url", "api_base_url", "route_constant", "post_message", "localhost_url")


def _pick(values, index):
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index % len(values) + 1).cast("int"))


def _path(k):
    return F.concat(F.lit("f"), k.cast("string"), F.lit(".ts"))


def _tables(spark, sf_dir):
    read = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    k = F.col("s_suppkey")
    made = read("supplier").select(k.alias("contract"), _pick(KINDS, k).alias("kind"), (k % 5).alias("repository"), _path((k * 7) % 420).alias("path"), F.when(k % 3 > 0, F.concat(F.lit("s"), (k % 11).cast("string"))).alias("symbol"))
    o = F.col("l_orderkey")
    seen = read("lineitem").select((o % 5).alias("repository"), _path(F.col("l_partkey") % 400).alias("path"), F.when(F.col("l_linenumber") > 5, F.concat(F.lit("s"), (o % 11).cast("string"))).alias("name"), (o % 200).alias("line"), _pick(TYPES, o + F.col("l_linenumber")).alias("type"), F.concat("l_returnflag", "l_linestatus").alias("value"))
    p = F.col("p_partkey")
    spans = read("part").select((p % 5).alias("repository"), _path(p % 400).alias("path"), F.concat(F.lit("s"), (p % 11).cast("string")).alias("declared"), ((p * 3) % 150).alias("line"), ((p * 3) % 150 + p % 40 - 1).alias("end_line"))
    return made, seen, spans


def contract_locations(spark, sf_dir):
    """What is observed of each contract: by symbol or by the lines of a declaration with that name, by fitting types."""
    made, seen, spans = _tables(spark, sf_dir)
    return contracts.locate_contracts(spark, made, seen, spans, COMPATIBLE).withColumn("observed", F.array_join("observed", ","))


def references_in_spans(spark, sf_dir):
    """How many references each declaration holds, and from which line to which."""
    _, seen, spans = _tables(spark, sf_dir)
    rows = contracts.points_in_spans(seen.withColumnRenamed("line", "at"), spans, ["repository", "path"], "at", "line", "end_line")
    return rows.groupBy("repository", "path", "declared", "line", "end_line").agg(F.count("*").alias("n"), F.min("at").alias("first"), F.max("at").alias("last"))


_TABLES = f"""c AS (SELECT s_suppkey AS contract, {list(KINDS)}[s_suppkey % {len(KINDS)} + 1] AS kind, s_suppkey % 5 AS repository, 'f' || (s_suppkey * 7 % 420) || '.ts' AS path, CASE WHEN s_suppkey % 3 > 0 THEN 's' || (s_suppkey % 11) END AS symbol FROM supplier),
r AS (SELECT row_number() OVER () AS ref, l_orderkey % 5 AS repository, 'f' || (l_partkey % 400) || '.ts' AS path, CASE WHEN l_linenumber > 5 THEN 's' || (l_orderkey % 11) END AS name, l_orderkey % 200 AS pos, {list(TYPES)}[(l_orderkey + l_linenumber) % {len(TYPES)} + 1] AS type, l_returnflag || l_linestatus AS value FROM lineitem),
s AS (SELECT p_partkey % 5 AS repository, 'f' || (p_partkey % 400) || '.ts' AS path, 's' || (p_partkey % 11) AS declared, p_partkey * 3 % 150 AS line, p_partkey * 3 % 150 + p_partkey % 40 - 1 AS end_line FROM part)"""
_FITS = "CASE kind " + " ".join(f"WHEN '{k}' THEN type IN {v}" for k, v in COMPATIBLE.items()) + " ELSE false END"

SQL = {
    "contract_locations": f"""WITH {_TABLES},
m AS (
  SELECT c.*, r.type, r.value, r.ref, coalesce({_FITS}, false) AS fits,
    coalesce(c.symbol IS NULL OR r.name = c.symbol OR EXISTS (SELECT 1 FROM s WHERE s.repository = r.repository AND s.path = r.path AND s.declared = c.symbol AND r.pos BETWEEN s.line AND s.end_line), false) AS here
  FROM c LEFT JOIN r ON r.repository = c.repository AND r.path = c.path
),
g AS (SELECT contract, repository, path, symbol, count(ref) AS a, count(*) FILTER (fits) AS f, count(*) FILTER (fits AND here) AS n, list_sort(list(DISTINCT value) FILTER (fits AND here)) AS o FROM m GROUP BY ALL)
SELECT contract, repository, path, symbol, CASE WHEN a = 0 THEN 'path_not_found' WHEN f = 0 THEN 'incompatible' WHEN n = 0 THEN 'symbol_not_found' WHEN len(o) > 1 THEN 'ambiguous' ELSE 'observed' END AS status, n, coalesce(array_to_string(o, ','), '') AS observed FROM g""",
    "references_in_spans": f"""WITH {_TABLES} SELECT s.repository, s.path, declared, line, end_line, count(*) AS n, min(pos) AS first, max(pos) AS last FROM s JOIN r ON r.repository = s.repository AND r.path = s.path AND pos BETWEEN line AND end_line GROUP BY ALL""",
}

QUERIES = {f.__name__: f for f in (contract_locations, references_in_spans)}
