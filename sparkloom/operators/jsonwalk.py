"""JSON of any depth: its leaves as rows, and the value with its secrets masked."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import normal as N
from ..store import Stage, unsent

# fixed values: parts of names of secrets, secrets inside a text, and how long a text may get
SECRET_NAMES = ("password", "secret", "token", "api_key", "apikey", "private_key", "credential", "authorization")
SECRET_TEXT = r"(?i)(password|secret|token|api[_-]?key|private[_-]?key|credential|authorization)\s*[:=]\s*(?:Bearer\s+)?[^,\s;]+"
MOST_CHARS = 240


def _parsed(df: DataFrame, key: str, text: str) -> DataFrame:
    return df.select(key, F.try_parse_json(F.col(text)).alias("v"), F.col(text).isNotNull().alias("given"))


def _kind(v: Column) -> Column:
    told = F.schema_of_variant(v)
    return F.when(told.startswith("OBJECT"), "object").when(told.startswith("ARRAY"), "array").when(told == "STRING", "string").when(told == "BOOLEAN", "boolean").when(told == "VOID", "null").otherwise("number")


def _levels(spark: SparkSession, df: DataFrame, key: str, text: str, max_depth: int | None, closed: Column | None = None) -> list[DataFrame]:
    """The nodes of all values, one table a depth: ``key, path, name, kind, v``; nodes of ``closed`` names are not opened."""
    stage = Stage(spark, "json")
    none = F.array().cast("array<string>")
    at = _parsed(df, key, text).where("v IS NOT NULL").select(key, none.alias("path"), F.lit("").alias("name"), _kind(F.col("v")).alias("kind"), "v")
    out, depth = [], 0
    while True:
        at = stage.save(at)
        if at.isEmpty():
            return out
        out.append(at)
        if max_depth is not None and depth >= max_depth:
            return out
        depth += 1
        opened = at.where(F.col("kind").isin("object", "array"))
        if closed is not None:
            opened = opened.where(~closed)
        inner = opened.select(key, F.col("path").alias("above"), "v").lateralJoin(spark.tvf.variant_explode(F.col("v").outer()).toDF("pos", "own", "value"))
        name = F.coalesce("own", F.col("pos").cast("string"))
        at = inner.select(key, F.concat("above", F.array(name)).alias("path"), name.alias("name"), _kind(F.col("value")).alias("kind"), F.col("value").alias("v"))


def _text(v: Column) -> Column:
    """A leaf as JSON."""
    return F.to_json(v)


def json_leaves(spark: SparkSession, df: DataFrame, key: str, text: str, *, max_depth: int | None = None) -> DataFrame:
    """``key, path, kind, value``: every leaf of the JSON in ``text``, whatever its depth.

    ``path`` is an array of names, numbers from 0 in arrays. ``value`` is the string itself or the leaf as JSON; empty
    objects and arrays are leaves too. A text that is no JSON has one row of kind ``error``, a null text none.
    With ``max_depth`` what lies deeper is one leaf, as JSON, of its kind. One written round for each depth.
    """
    levels = _levels(spark, df, key, text, max_depth)
    bad = _parsed(df, key, text).where("v IS NULL AND given").select(key, F.array().cast("array<string>").alias("path"), F.lit("error").alias("kind"), F.lit(None).cast("string").alias("value"))
    out = bad
    for i, level in enumerate(levels):
        last = max_depth is not None and i == max_depth
        empty = _text(F.col("v")).isin("{}", "[]")
        leaf = F.lit(True) if last else ~F.col("kind").isin("object", "array") | empty
        value = F.when(F.col("kind") == "string", F.variant_get("v", "$", "string")).otherwise(_text(F.col("v")))
        out = out.unionByName(level.where(leaf).select(key, "path", "kind", value.alias("value")))
    return out


def redacted_text(value: Column) -> Column:
    """A text with the values after names of secrets masked, cut to MOST_CHARS with three dots at the end."""
    masked = F.regexp_replace(value, SECRET_TEXT, f"$1={N.REDACTED}")
    return F.when(F.char_length(masked) > MOST_CHARS, F.concat(F.substring(masked, 1, MOST_CHARS - 3), F.lit("..."))).otherwise(masked)


def is_secret_name(name: Column) -> Column:
    bare = F.translate(F.lower(name), "-", "_")
    hit = F.lit(False)
    for word in SECRET_NAMES:
        hit = hit | bare.contains(word)
    return hit


def _quoted(text: Column) -> Column:
    listed = F.to_json(F.array(text))
    return F.substring(listed, F.lit(2), F.char_length(listed) - 2)


def redacted_json(spark: SparkSession, df: DataFrame, key: str, text: str) -> DataFrame:
    """``key, redacted``: the JSON with its objects in the order of their names and its secrets masked, at any depth.

    What stands under the name of a secret is masked whole; in other strings, what follows the name of a secret. A text
    that is no JSON, or null, gives null. Put together again from the deepest level up, one written round a depth; a
    value's own members meet in one task, as they are one value. Equal keys are one value: give rows keys of their own.
    """
    stage = Stage(spark, "redacted")
    secret = is_secret_name(F.col("name")) & (F.size("path") > 0)
    levels = _levels(spark, df, key, text, None, secret)
    told = F.when(secret, F.lit(f'"{N.REDACTED}"')).when(F.col("kind") == "string", _quoted(redacted_text(F.variant_get("v", "$", "string")))).otherwise(_text(F.col("v")))
    below = None
    for level in reversed(levels):
        own = level.select(key, "path", "name", "kind", F.when(~F.col("kind").isin("object", "array") | secret | _text(F.col("v")).isin("{}", "[]"), told).alias("json"))
        own = own.select(key, "path", "name", "json", F.when(F.col("json").isNull(), F.col("kind") == "array").alias("of_array"))
        if below is not None:
            # an opened value and its members meet in one grouping, so no table is joined or sent around
            up = below.select(key, F.slice("path", F.lit(1), F.size("path") - 1).alias("path"), F.struct("name", "json").alias("member"))
            opened = own.where("json IS NULL").select(key, "path", "name", "of_array", F.lit(None).cast(up.schema["member"].dataType).alias("member"))
            met = opened.unionByName(up.withColumns({"name": F.lit(None).cast("string"), "of_array": F.lit(None).cast("boolean")})).groupBy(key, "path").agg(
                F.max("name").alias("name"), F.max("of_array").alias("of_array"), F.collect_list("member").alias("m")
            )
            placed = F.transform("m", lambda x: F.struct(F.when(F.col("of_array"), x["name"].cast("long")).alias("place"), x["name"].alias("name"), x["json"].alias("json")))
            inside = F.array_join(F.transform(F.sort_array(placed), lambda x: F.when(F.col("of_array"), x["json"]).otherwise(F.concat(_quoted(x["name"]), F.lit(":"), x["json"]))), ",")
            made = F.when(F.col("of_array"), F.concat(F.lit("["), inside, F.lit("]"))).otherwise(F.concat(F.lit("{"), inside, F.lit("}")))
            own = own.where("json IS NOT NULL").drop("of_array").unionByName(met.select(key, "path", "name", made.alias("json")))
        below = stage.save(own.select(key, "path", "name", "json"))
    every = df.select(key)
    return every.withColumn("redacted", F.lit(None).cast("string")) if below is None else every.join(unsent(below.select(key, F.col("json").alias("redacted"))), key, "left")
