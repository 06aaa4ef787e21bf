"""Where contracts are observed: by symbol, by the lines of a declaration, and by compatible types."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..store import Stage, unsent


# fixed values: which types of references can show a contract of a kind
COMPATIBLE = {
    "iframe_url": ("iframe_src", "environment_url", "shared_constant"), "api_constant": ("api_base_url", "environment_url", "shared_constant"), "route_name": ("route_constant", "shared_constant"),
    "port_number": ("localhost_url", "environment_url", "api_base_url", "shared_constant"), "message_event": ("post_message", "message_listener", "shared_constant"),
}


def _level(length: Column) -> Column:
    """The least power of two that is no less than the length, as its exponent."""
    return F.when(length <= 1, 0).otherwise(F.length(F.bin(length - 1)))


def points_in_spans(points: DataFrame, spans: DataFrame, on: list[str], at: str, start: str, end: str) -> DataFrame:
    """Every row of ``points`` with every row of ``spans`` that has the same ``on`` and holds it, both ends included.

    A span lies in at most two buckets of the power of two that its length asks for, and a point in one bucket of each
    length that occurs, so this is an equi-join whatever the lengths are; a hot file is split by its buckets. Rows with a
    null key, place or end, and spans that end before they start, match nothing. Columns other than ``on`` need
    different names on both sides.
    """
    level = _level(F.col(end) - F.col(start) + 1)
    cut = spans.where(F.col(end) >= F.col(start)).withColumn("_level", level.cast("int"))
    bucket = lambda c: F.floor(F.col(c) / F.pow(F.lit(2.0), F.col("_level"))).cast("long")
    cut = cut.select("*", F.explode(F.array_distinct(F.array(bucket(start), bucket(end)))).alias("_bucket"))
    lengths = cut.select(*on, "_level").distinct()
    dealt = points.join(lengths, on).withColumn("_bucket", bucket(at))
    met = dealt.join(cut, [*on, "_level", "_bucket"])
    return met.where((F.col(at) >= F.col(start)) & (F.col(at) <= F.col(end))).drop("_level", "_bucket")


def locate_contracts(spark: SparkSession, contracts: DataFrame, references: DataFrame, spans: DataFrame, compatible: dict[str, tuple[str, ...]] = COMPATIBLE) -> DataFrame:
    """``contract, repository, path, symbol, status, n, observed``: what is seen of each contract at each of its places.

    ``contracts`` has ``contract, kind, repository, path, symbol`` (null: the whole file), ``references`` has
    ``repository, path, name, line, type, value``, ``spans`` has ``repository, path, declared, line, end_line``. A
    reference counts if it is at the path, its type is among those ``compatible`` with the contract's kind, and, where a
    symbol is given, it has this name or lies in the lines of a declaration of that name.

    ``status``: ``path_not_found`` without any reference at the path, ``incompatible`` without one of a fitting type,
    ``symbol_not_found`` without one at the symbol, ``ambiguous`` with several different values, else ``observed``.
    ``n`` counts the references, ``observed`` has the different values in order. Null values count, but are no value.
    """
    types = F.create_map(*[x for k, v in compatible.items() for x in (F.lit(k), F.array(*[F.lit(t) for t in v]))])
    place = ["repository", "path"]
    stage = Stage(spark, "contracts")
    c = contracts.select("contract", "kind", *place, "symbol").distinct()
    # equal references are one row with their number, so a hot path is as large as its different references
    r = references.select(*place, "name", F.col("line").alias("at"), "type", "value").groupBy(*place, "name", "at", "type", "value").agg(F.count("*").alias("refs"))
    r = stage.save(r.withColumn("ref", F.monotonically_increasing_id()))  # written, so the numbers stay
    # of each reference the declarations around it, only where a contract asks for their name
    asked = c.where("symbol IS NOT NULL").select(*place, F.col("symbol").alias("declared")).distinct()
    held = spans.select(*place, "declared", F.col("line").alias("start"), "end_line").join(asked, [*place, "declared"], "left_semi")
    held = held.distinct()  # a declaration that is there twice holds nothing more
    names = points_in_spans(r.select("ref", *place, "at"), held, place, "at", "start", "end_line").select("ref", F.col("declared").alias("of"))
    names = names.unionByName(r.where("name IS NOT NULL").select("ref", F.col("name").alias("of"))).distinct()
    # contracts of one place, kind and symbol see the same: what is seen is counted once for all of them, and references
    # by what a contract can ask for, their place, symbol, type and value, before the two meet
    wanted = stage.save(c.select("kind", *place, "symbol").distinct())
    by_type = r.groupBy(*place, "type", "value").agg(F.sum("refs").alias("refs"))
    by_name = r.join(unsent(names), "ref").groupBy(*place, F.col("of").alias("symbol"), "type", "value").agg(F.sum("refs").alias("refs"))
    fits = F.coalesce(F.array_contains(F.try_element_at(types, F.col("kind")), F.col("type")), F.lit(False))
    total = lambda which: F.coalesce(F.sum(F.when(which, F.col("refs"))), F.lit(0))
    seen = F.array_sort(F.collect_set(F.when(fits, F.col("value"))))
    asks = ["kind", *place, "symbol"]
    whole = wanted.join(unsent(by_type), place).groupBy(*asks).agg(total(F.col("type").isNotNull()).alias("_any"), total(fits).alias("_fit"), seen.alias("_seen"))
    named = wanted.where("symbol IS NOT NULL").join(unsent(by_name), [*place, "symbol"]).groupBy(*asks).agg(total(fits).alias("_n"), seen.alias("_named"))
    # null kinds and symbols are values of their own here
    same = lambda x, y: F.equal_null(f"{x}.kind", f"{y}.kind") & F.equal_null(f"{x}.symbol", f"{y}.symbol") & (F.col(f"{x}.repository") == F.col(f"{y}.repository")) & (F.col(f"{x}.path") == F.col(f"{y}.path"))
    told = whole.alias("x").join(unsent(named.alias("y")), same("x", "y"), "left").select("x.*", "y._n", "y._named")
    met = c.alias("x").join(unsent(told.alias("y")), same("x", "y"), "left").select("x.*", *[f"y.{k}" for k in ("_any", "_fit", "_seen", "_n", "_named")])
    every = F.col("symbol").isNull()
    n = F.when(every, F.col("_fit")).otherwise(F.col("_n"))
    observed = F.flatten(F.collect_list(F.when(every, F.col("_seen")).otherwise(F.col("_named"))))
    # a contract of several kinds is one row
    g = met.groupBy("contract", *place, "symbol").agg(*[F.coalesce(F.sum(v), F.lit(0)).alias(k) for k, v in (("_any", F.col("_any")), ("_fit", F.col("_fit")), ("n", n))], F.array_sort(F.array_distinct(observed)).alias("observed"))
    status = F.when(F.col("_any") == 0, "path_not_found").when(F.col("_fit") == 0, "incompatible").when(F.col("n") == 0, "symbol_not_found").when(F.size("observed") > 1, "ambiguous").otherwise("observed")
    return g.select("contract", *place, "symbol", status.alias("status"), "n", "observed")
