"""Resolution of imports: candidates by extension, alias patterns, packages, in an order of preference."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import paths as X
from ..store import unsent

# fixed values: what a script import may leave out, in the order in which it is tried
SCRIPT_SUFFIXES = (".ts", ".tsx", ".js", ".jsx", ".mjs", ".cjs")


def joined_path(folders: Column, imported: Column) -> Column:
    """The path that a relative import means, from the importer's folders; null if it leaves the root."""
    steps = F.concat(folders, F.filter(F.split(imported, "/"), lambda x: ~x.isin("", ".")))
    start = F.struct(F.array().cast("array<string>").alias("at"), F.lit(True).alias("ok"))

    def step(state: Column, x: Column) -> Column:
        up = F.struct(F.slice(state["at"], F.lit(1), F.greatest(F.size(state["at"]) - 1, F.lit(0))).alias("at"), (state["ok"] & (F.size(state["at"]) > 0)).alias("ok"))
        return F.when(x == "..", up).otherwise(F.struct(F.concat(state["at"], F.array(x)).alias("at"), state["ok"].alias("ok")))

    return F.aggregate(steps, start, step, lambda s: F.when(s["ok"], F.array_join(s["at"], "/")))


def source_candidates(base: Column) -> Column:
    """Paths to try for an import: itself if it ends in a known suffix, else with each suffix, then its index files."""
    named = base.rlike(r"\.(" + "|".join(s[1:] for s in SCRIPT_SUFFIXES) + r")$")
    tried = [F.concat(base, F.lit(s)) for s in SCRIPT_SUFFIXES] + [F.concat(base, F.lit(f"/index{s}")) for s in SCRIPT_SUFFIXES]
    return F.when(named, F.array(base)).otherwise(F.array(*tried))


def alias_targets(imported: Column, patterns: list[tuple[str, str]]) -> Column:
    """What the alias patterns make of an import, the most specific first: exact ones, then the longest before the star."""
    ordered = sorted(patterns, key=lambda p: ("*" in p[0], -len(p[0].split("*")[0]), p[0]))
    made = []
    for pattern, target in ordered:
        before, star, after = pattern.partition("*")
        if not star:
            made.append(F.when(imported == pattern, F.lit(target)))
            continue
        fits = imported.startswith(before) & imported.endswith(after) & (F.char_length(imported) >= len(before) + len(after))
        middle = F.substr(imported, F.lit(len(before) + 1), F.char_length(imported) - len(before) - len(after))
        made.append(F.when(fits, F.concat(F.lit(target.partition("*")[0]), middle, F.lit(target.partition("*")[2]))))
    return F.array_compact(F.array(*made))


def resolve_scripts(imports: DataFrame, files: DataFrame, path: str, imported: str, patterns: list[tuple[str, str]]) -> DataFrame:
    """``imports`` with ``resolved`` and ``status``: relative, alias, external or unresolved.

    A relative import is looked up from the importer's folder, any other by the alias patterns; each gives candidates,
    which one join with the files settles, the first in order winning. An import with an alias that finds nothing and a
    relative one without a file are unresolved, others external. Every row of ``imports`` comes back; one whose path or
    import is null is unresolved.
    """
    source, name = F.col(path), F.col(imported)
    relative = X.is_relative_import(name)
    targets = alias_targets(name, patterns)
    bases = F.when(relative, F.array_compact(F.array(joined_path(X.folders(source), name)))).otherwise(targets)
    tried = F.flatten(F.transform(bases, source_candidates))
    rows = imports.select(source.alias("_p"), name.alias("_i"), relative.alias("_rel"), (F.size(targets) > 0).alias("_alias"), tried.alias("_tried")).where("_p IS NOT NULL AND _i IS NOT NULL").distinct()
    opened = rows.select("_p", "_i", F.posexplode("_tried").alias("_at", "_candidate"))
    known = files.select(F.col(path).alias("_candidate")).distinct()
    hits = opened.join(unsent(known), "_candidate").groupBy("_p", "_i").agg(F.min(F.struct("_at", "_candidate")).alias("_hit"))
    found = rows.drop("_tried").join(unsent(hits), ["_p", "_i"], "left")
    hit = F.col("_hit").isNotNull()
    status = F.when(F.col("_rel") & hit, "relative").when(hit, "alias").when(F.col("_rel") | F.col("_alias"), "unresolved").otherwise("external")
    settled = found.select("_p", "_i", F.col("_hit._candidate").alias("resolved"), status.alias("status"))
    out = imports.join(unsent(settled), (source == F.col("_p")) & (name == F.col("_i")), "left").drop("_p", "_i")
    return out.withColumn("status", F.coalesce("status", F.lit("unresolved")))


def resolve_modules(imports: DataFrame, files: DataFrame, path: str, imported: str, stdlib: tuple[str, ...]) -> DataFrame:
    """``imports`` with ``resolved`` and ``status`` of module imports: by module name first, then by a file of the folder."""
    p = F.col(path)
    names = files.where(p.endswith(".py")).groupBy(X.module_name(p).alias("_m")).agg(F.min(path).alias("_by_name"))
    beside = files.groupBy(p.alias("_f")).agg(F.min(path).alias("_by_folder"))
    rows = imports.withColumn("_sibling", X.same_folder_module(p, F.col(imported)))
    rows = rows.join(names, F.col(imported) == F.col("_m"), "left").join(beside, F.col("_sibling") == F.col("_f"), "left")
    external = F.substring_index(F.col(imported), ".", 1).isin(*stdlib)
    found = F.coalesce("_by_name", "_by_folder")
    status = F.when(found.isNotNull(), "internal").when(external, "external").otherwise("unresolved")
    return rows.select(*imports.columns, found.alias("resolved"), status.alias("status"))
