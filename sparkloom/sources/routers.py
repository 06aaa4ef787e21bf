"""Routes and mounts of routers across files: Django includes, mounted Express routers, groups of Go routers.

Each function makes the two tables that :func:`sparkloom.operators.prefixes.full_routes` composes: routes ``node,
method, path, handler`` and mounts ``parent, prefix, child, target``. A node is a file, or a router in a file
(``file#router``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import paths as X
from ..operators import resolution
from ..store import Stage, unsent
from . import lexer, scripts

_VAR = r"[A-Za-z_$][\w$]*+"


def _node(path: Column, router: Column) -> Column:
    return F.concat(path, F.lit("#"), router)


def django_tables(files: DataFrame, path: str = "path", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """Routes and includes of Django files; an include leads to the file whose module it names.

    A module's name is its path with dots; of several files with one name the least path is meant. The
    anchor at the front of a pattern goes, as prefixes are put together.
    """
    found = files.select(F.col(path).alias("node"), F.inline(scripts.django_routes(F.col(text)))).where("form IN ('url', 'include', 'register')")
    f = Stage(files.sparkSession, "django").save(found)
    own = F.regexp_replace("path", r"^\^", "")
    routes = f.where("form <> 'include'").select("node", "method", own.alias("path"), "handler")
    modules = files.select(X.module_name(F.col(path)).alias("target"), F.col(path).alias("child")).groupBy("target").agg(F.min("child").alias("child"))
    mounts = f.where("form = 'include'").select(F.col("node").alias("parent"), own.alias("prefix"), F.col("handler").alias("target")).join(unsent(modules), "target", "left")
    return routes, mounts.select("parent", "prefix", "child", "target")


def express_tables(files: DataFrame, path: str = "path", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """Routes and mounts of Express routers in script files.

    ``receiver.use(prefix, router)`` mounts a router of the same file, or the exported router of the file that the name
    was imported from (``require`` or ``import``, relative paths, with the usual extensions and index files); ``use``
    with a ``require`` in place of the name does so too. A call of a name that is neither mounts nothing.
    """
    stage = Stage(files.sparkSession, "express")
    # written, as every pattern reads it
    plain = stage.save(files.select(F.col(path).alias("f"), lexer.plain_strings(F.col(text)).alias("t")))
    none = F.lit("")

    def facts(pattern: str, **groups: int) -> DataFrame:
        found = F.arrays_zip(*[F.regexp_extract_all("t", F.lit(pattern), n).alias(k) for k, n in groups.items()])
        return plain.select("f", F.inline(found).alias(*groups))

    text_in = r"""(?:"([^"\n]*+)"|'([^'\n]*+)')"""
    called = facts(rf"\b({_VAR})\.(get|post|put|patch|delete|options|head|all)\s*+\(\s*+{text_in}\s*+(?:,\s*+([\w.$]++))?+", r=1, m=2, p=3, q=4, h=5)
    routers = facts(rf"(?:const|let|var)\s++({_VAR})\s*+=\s*+(?:new\s++)?(?:express\s*+\(|(?:\w++\.)?Router\s*+\()", r=1).unionByName(plain.select("f", F.explode(F.array(F.lit("app"), F.lit("router"))).alias("r"))).distinct()
    routers = unsent(stage.save(routers))
    method = F.when(F.col("m") == "all", "ANY").otherwise(F.upper("m"))
    routes = called.join(routers, ["f", "r"], "left_semi").select(_node(F.col("f"), F.col("r")).alias("node"), method.alias("method"), F.concat("p", "q").alias("path"), F.col("h").alias("handler"))

    required = facts(rf"(?:const|let|var)\s++({_VAR})\s*+=\s*+require\s*+\(\s*+{text_in}\s*+\)", v=1, p=2, q=3)
    imported = facts(rf"(?m)^[ \t]*+import\s++({_VAR})\s++from\s*+{text_in}", v=1, p=2, q=3)
    used = facts(rf"\b({_VAR})\.use\s*+\(\s*+{text_in}\s*+,\s*+(?:require\s*+\(\s*+{text_in}\s*+\)|({_VAR})\s*+\))", r=1, p=2, q=3, s=4, t=5, v=6)
    brought = required.unionByName(imported).select("f", "v", F.concat("p", "q").alias("i"))
    # a name's import is looked up; a require in the call is its own
    use = used.join(routers, ["f", "r"], "left_semi").join(unsent(brought.groupBy("f", "v").agg(F.min("i").alias("i"))), ["f", "v"], "left")
    use = stage.save(use.withColumn("i", F.coalesce(F.nullif(F.concat("s", "t"), none), "i")).withColumn("p", F.concat("p", "q")))
    sources = use.where("i IS NOT NULL").select("f", "i").distinct()
    known = plain.select("f").distinct()
    met = resolution.resolve_scripts(sources, known, "f", "i", []).select("f", "i", "resolved")
    local = routers.select("f", F.col("r").alias("v"), F.lit(True).alias("local"))
    use = use.join(unsent(met), ["f", "i"], "left").join(unsent(local), ["f", "v"], "left")
    child = F.when(F.col("i").isNotNull(), _node(F.col("resolved"), F.lit("exports"))).when(F.col("local"), _node(F.col("f"), F.col("v")))
    use = use.where("i IS NOT NULL OR local").select(_node(F.col("f"), F.col("r")).alias("parent"), F.col("p").alias("prefix"), child.alias("child"), F.coalesce("i", "v").alias("target"))

    handed = facts(rf"(?:module\.exports\s*+=|export\s++default)\s*+({_VAR})", r=1).join(routers, ["f", "r"], "left_semi")
    out = handed.select(_node(F.col("f"), F.lit("exports")).alias("parent"), none.alias("prefix"), _node(F.col("f"), F.col("r")).alias("child"), F.col("r").alias("target"))
    return routes, use.unionByName(out)


def go_tables(files: DataFrame, path: str = "path", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """Routes and groups of Go routers: nested ``Route`` and ``Group`` blocks, and routers made of a prefix.

    A block's routes are those between its braces, by position, so blocks may nest; the innermost is meant. The
    name that a block gives to its router is not looked at. ``Subrouter()`` and ``Group(prefix)`` make a router with a
    name. Raw strings in back quotes are no paths here.
    """
    # a Go file has the same comments and quotes as a script, so positions come from the same lexer
    stage = Stage(files.sparkSession, "go")
    bare = stage.save(files.select(F.col(path).alias("f"), lexer.plain_strings(F.col(text)).alias("s")))
    lines = bare.select("f", F.posexplode(F.split("s", "\n")).alias("n", "s")).withColumn("n", F.col("n") + 1)

    def told(pattern: str, **groups: int) -> Column:
        return F.struct(*[F.regexp_extract("s", pattern, i).alias(c) for c, i in groups.items()])

    call = r'\b([A-Za-z_]\w*+)\.(Get|Post|Put|Patch|Delete|Options|Head|GET|POST|PUT|PATCH|DELETE|OPTIONS|HEAD|HandleFunc|Handle)\(\s*+"([^"]*+)"\s*+,\s*+([\w.]++)'
    lines = lines.select(
        "f", "n",
        F.regexp_extract("s", rf'\b({_VAR})\.(?:Route|Group)\(\s*+(?:"([^"]*+)"\s*+,\s*+)?func\(', 1).alias("block"), F.regexp_extract("s", r'\.(?:Route|Group)\(\s*+"([^"]*+)"', 1).alias("block_prefix"),
        told(rf'\b({_VAR})\s*+:?=\s*+({_VAR})\.(?:PathPrefix|Group|Mount)\(\s*+"([^"]*+)"\s*+\)', v=1).alias("made"),
        F.regexp_extract("s", rf'=\s*+({_VAR})\.(?:PathPrefix|Group|Mount)\(', 1).alias("made_r"), F.regexp_extract("s", r'\.(?:PathPrefix|Group|Mount)\(\s*+"([^"]*+)"', 1).alias("made_prefix"),
        told(call, r=1, m=2, p=3, h=4).alias("call"), F.regexp_extract("s", r'\.Methods\(\s*+"(\w++)"', 1).alias("verb"),
    )
    # all patterns read a line once
    lines = stage.save(lines.where("block <> '' OR made.v <> '' OR call.m <> ''"))
    blocks = lines.where("block <> ''").select("f", "n", F.col("block").alias("r"), F.col("block_prefix").alias("prefix"))
    braces = lexer.bracket_pairs(files, path, text).where("mark = '{'").groupBy(F.col(path).alias("f"), F.col("line").alias("n")).agg(F.max_by("end_line", "opened").alias("end"))
    blocks = blocks.join(unsent(braces), ["f", "n"]).select("f", F.col("n").alias("start"), F.coalesce("end", F.lit(1 << 40)).alias("end"), "r", "prefix")
    blocks = stage.save(blocks)
    block = F.concat_ws("", F.lit("block "), F.col("start").cast("string"))

    made = lines.where("made.v <> ''").select("f", "n", "made.v", F.col("made_r").alias("r"), F.col("made_prefix").alias("prefix"))
    calls = lines.where("call.m <> ''").select("f", "n", "call.*", F.col("verb").alias("v"))

    def inside(rows: DataFrame) -> DataFrame:
        """Rows (f, n) with the start of the innermost block around them, or null."""
        near = rows.select("f", "n").distinct().join(unsent(blocks.select("f", "start", "end")), "f").where((F.col("n") > F.col("start")) & (F.col("n") <= F.col("end")))
        return rows.join(unsent(near.groupBy("f", "n").agg(F.max("start").alias("start"))), ["f", "n"], "left")

    named = made.select("f", F.col("v").alias("r"), F.lit(True).alias("named")).distinct()
    # a router made of a prefix keeps its name in any block; else the block that is around says where a call belongs
    at = F.when(F.col("named"), F.col("r")).when(F.col("start").isNotNull(), block).otherwise(F.col("r"))
    placed = lambda rows: inside(rows).join(unsent(named), ["f", "r"], "left").withColumn("at", _node(F.col("f"), at))
    method = F.when(F.col("v") != "", F.upper("v")).when(F.col("m").startswith("Handle"), "ANY").otherwise(F.upper("m"))
    routes = placed(calls).select(F.col("at").alias("node"), method.alias("method"), F.col("p").alias("path"), F.col("h").alias("handler"))
    nested = placed(blocks.withColumnsRenamed({"start": "n", "end": "_end"})).select(F.col("at").alias("parent"), "prefix", _node(F.col("f"), F.concat(F.lit("block "), F.col("n").cast("string"))).alias("child"), F.lit("").alias("target"))
    groups = placed(made).select(F.col("at").alias("parent"), "prefix", _node(F.col("f"), F.col("v")).alias("child"), F.col("v").alias("target"))
    return routes, nested.unionByName(groups)
