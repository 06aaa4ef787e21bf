"""Reports on relations, journeys, roles, budgets and changes. Every function takes tables and the names of their columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import normal as N
from ..functions import paths as X
from . import compare, folds
from .ranking import top_per_group
from .substrings import words_with

# fixed values: how sure a match by the whole address or by the port alone is, and the relation that a reference stands for
BY_ADDRESS, BY_PORT = 0.95, 0.82
REFERENCE_RELATIONS = {"api_base_url": "calls_api", "environment_url": "calls_api", "iframe_src": "embeds_iframe", "post_message": "sends_messages_to", "message_listener": "receives_messages_from"}
SEVERITIES = ("info", "warning", "error")
READINESS = ("ready", "partial", "blocked")


def match_addresses(references: DataFrame, repositories: DataFrame, key: str, owner: str, address: str, repository: str, url: str, port: str) -> DataFrame:
    """``key, status, target, score``: the repository that each reference's address names, none or several.

    By the whole address or else by the port alone; a reference never means the repository that it stands in
    (``owner``). ``repositories`` has ``repository``, its normalised ``url`` and its ``port``. Two of the best score are
    ambiguous. A null or odd address matches none. Equal keys are one reference.
    """
    r = references.select(F.col(key).alias("k"), F.col(owner).alias("own"), N.reference_url(F.col(address)).alias("u"), N.port_of(F.col(address)).alias("p"))
    n = repositories.select(F.col(repository).alias("to"), F.col(url).alias("u"), F.col(port).cast("long").alias("p"))
    by_url = r.join(n.select("u", "to"), "u").where("to <> own OR own IS NULL").select("k", "to", F.lit(BY_ADDRESS).alias("score"))
    by_port = r.join(n.select("p", "to"), "p").where("to <> own OR own IS NULL").select("k", "to", F.lit(BY_PORT).alias("score"))
    best = by_url.unionByName(by_port).groupBy("k", "score").agg(F.count_distinct("to").alias("n"), F.min("to").alias("target")).groupBy("k").agg(F.max(F.struct("score", "n", "target")).alias("b"))
    out = r.select("k").distinct().join(best, "k", "left")
    status = F.when(F.col("b").isNull(), "none").when(F.col("b.n") > 1, "ambiguous").otherwise("matched")
    return out.select(F.col("k").alias(key), status.alias("status"), F.when(F.col("b.n") == 1, F.col("b.target")).alias("target"), F.col("b.score").alias("score"))


def relation_hints(references: DataFrame, known: DataFrame, key: str, kind: str, source: str, target: str, node: str) -> DataFrame:
    """``key, relation, reason``: what relation each reference stands for, and why it is not resolved.

    In this order: a kind without a relation, a reference to itself, both ends unknown, the source, the target; else
    ``resolved``. ``known`` has the known nodes. A null end is unknown.
    """
    relation = F.try_element_at(F.create_map(*[F.lit(x) for pair in REFERENCE_RELATIONS.items() for x in pair]), F.col(kind))
    nodes = known.select(F.col(node).alias("n")).where("n IS NOT NULL").distinct()
    rows = references.select(F.col(key), relation.alias("relation"), F.col(source).alias("s"), F.col(target).alias("t"))
    rows = rows.join(nodes.withColumnRenamed("n", "a"), F.col("s") == F.col("a"), "left").join(nodes.withColumnRenamed("n", "b"), F.col("t") == F.col("b"), "left")
    a, b = F.col("a").isNull(), F.col("b").isNull()
    reason = F.when(F.col("relation").isNull(), "unsupported_type").when(F.col("s") == F.col("t"), "self").when(a & b, "both_missing").when(a, "source_missing").when(b, "target_missing").otherwise("resolved")
    return rows.select(key, "relation", reason.alias("reason"))


def journey_summary(steps: DataFrame, journey: str, kind: str, order: list[str], opens: str, closes: str, kinds: int, gap: str) -> DataFrame:
    """``journey, steps, kinds, transitions, back_steps, gap, readiness, rank`` of the steps of each journey in order.

    A transition goes to another kind, a back step to one seen before the last. There is a gap (named ``gap``) where a
    step ``opens`` comes and none of kind ``closes`` after it. A journey without a gap is complete with all ``kinds``,
    else limited; with a gap it is partial. Complete ones rank 18 higher, two points a kind, half a point less for the gap.

    The kinds that came before are kept as a set, which the number of kinds bounds.
    """
    w = Window.partitionBy(journey).orderBy(*order)
    e = steps.withColumns({"_next": F.lead(kind).over(w), "_last": F.lag(kind).over(w), "_seen": F.collect_set(kind).over(w.rowsBetween(Window.unboundedPreceding, -1)), "_place": F.row_number().over(w)})
    back = F.array_contains("_seen", F.col(kind)) & (F.col(kind) != F.coalesce("_last", F.lit("")))
    g = e.withColumn("_back", back).groupBy(journey).agg(
        F.count("*").alias("steps"), F.count_distinct(kind).alias("kinds"), F.count_if(F.col("_next") != F.col(kind)).alias("transitions"), F.count_if("_back").alias("back_steps"),
        F.min(F.when(F.col(kind) == opens, F.col("_place"))).alias("s"), F.max(F.when(F.col(kind) == closes, F.col("_place"))).alias("p"),
    )
    named = F.when(F.col("s").isNotNull() & ~F.coalesce(F.col("p") > F.col("s"), F.lit(False)), gap)
    ready = F.when(named.isNotNull(), "partial").when(F.col("kinds") == kinds, "complete").otherwise("limited")
    rank = F.col("kinds") * 2 + F.when(ready == "complete", 18).otherwise(0) - F.when(named.isNotNull(), 0.5).otherwise(0.0)
    return g.select(journey, "steps", "kinds", "transitions", "back_steps", named.alias("gap"), ready.alias("readiness"), rank.cast("double").alias("rank"))


def bounded_items(df: DataFrame, group: str, order: list[Column], item: Column, most: int) -> DataFrame:
    """``group, place, item``: of each group the first ``most`` items in order, then a row that says how many were left out."""
    few = top_per_group(df.withColumn("_item", item.cast("string")), [group], order, most, "place").select(group, F.col("place").cast("long").alias("place"), F.col("_item").alias("item"))
    more = df.groupBy(group).agg(F.count("*").alias("_n")).where(F.col("_n") > most)
    return few.unionByName(more.select(group, F.lit(most + 1).cast("long").alias("place"), F.concat(F.lit("omitted "), (F.col("_n") - most).cast("string")).alias("item")))


def severity_summary(df: DataFrame, stage: str, severity: str) -> DataFrame:
    """``stage, info, warning, error, readiness``: counts by severity, and what the worst of them means."""
    rank = F.max(F.when(F.col(severity) == "error", 2).when(F.col(severity) == "warning", 1).otherwise(0))
    g = df.groupBy(stage).agg(*[F.count_if(F.col(severity) == x).alias(x) for x in SEVERITIES], rank.alias("_worst"))
    return g.select(stage, *SEVERITIES, F.element_at(F.array(*[F.lit(r) for r in READINESS]), F.col("_worst") + 1).alias("readiness"))


def merge_resolutions(df: DataFrame, keys: list[str], note: str, counter: str, status: str) -> DataFrame:
    """``keys, notes, files, status, n``: equal identities merged; equal rows count once.

    ``notes`` are the different notes in order, ``files`` the sum of the counter, ``status`` the least.
    """
    once = df.select(*keys, F.col(note).alias("_note"), F.col(counter).alias("_files"), F.col(status).alias("_status")).distinct()
    return once.groupBy(*keys).agg(F.array_join(F.sort_array(F.collect_set("_note")), ",").alias("notes"), F.sum("_files").alias("files"), F.min("_status").alias("status"), F.count("*").alias("n"))


def assess_roles(units: DataFrame, evidence: DataFrame, unit: str, configured: str, role: str, strength: str, weak: str, *, conflict: Column) -> DataFrame:
    """``unit, origin, role, score, conflict``: the configured role, else what the evidence suggests, else unknown.

    ``evidence`` has ``unit, role``, a ``strength`` from 0 to 1 and whether it is ``weak``. The role of the greatest
    strength is taken, of several that of most evidence, then the greatest by name. Its score is at most 0.9, and at most
    0.35 if all its evidence is weak; a configured role has 1, an unknown one 0.1. ``conflict`` compares ``configured``
    with ``found``, both not null.
    """
    o = evidence.where(F.col(unit).isNotNull()).groupBy(F.col(unit).alias("_u"), F.col(role).alias("_r")).agg(F.count("*").alias("n"), F.max(strength).alias("s"), F.bool_and(weak).alias("w"))
    best = o.groupBy("_u").agg(F.max(F.struct("s", "n", F.col("_r").alias("role"), "w")).alias("b"))
    j = units.select(unit, F.col(configured).alias("configured")).join(best, F.col(unit) == F.col("_u"), "left").withColumn("found", F.col("b.role"))
    known, found = F.col("configured").isNotNull(), F.col("b").isNotNull()
    score = F.when(known, 1.0).when(~found, 0.1).otherwise(F.least(F.when(F.col("b.w"), F.least(F.col("b.s"), F.lit(0.35))).otherwise(F.col("b.s")), F.lit(0.9)))
    origin = F.when(known, "explicit").when(found, "discovered").otherwise("default")
    return j.select(unit, origin.alias("origin"), F.coalesce("configured", "found", F.lit("unknown")).alias("role"), score.alias("score"), (known & found & conflict).alias("conflict"))


def order_representations(df: DataFrame, key: str, tier: str, tokens: str, tiers: tuple[str, ...], most: int) -> DataFrame:
    """``key, tier, tokens, place, running``: the first ``most`` representations by tier, then by tokens, unknown last.

    ``running`` sums the tokens so far. The cut comes first, so one small table is numbered.
    """
    place = F.array_position(F.array(*[F.lit(x) for x in tiers]), F.col("tier"))
    rows = df.select(F.col(key), F.col(tier).alias("tier"), F.col(tokens).cast("long").alias("tokens"))
    order = [place.asc(), F.asc_nulls_last("tokens"), F.col(key)]
    w = Window.orderBy(*order)
    running = F.sum(F.coalesce("tokens", F.lit(0))).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return rows.orderBy(*order).limit(most).select(key, "tier", "tokens", F.row_number().over(w).cast("long").alias("place"), running.alias("running"))


def downgrade_to_budget(df: DataFrame, group: str, key: str, tokens: str, budget: int) -> DataFrame:
    """``group, key, step, saved, tokens_before``: what becomes lighter until each group fits its budget.

    First all items are halved, then cut to an eighth, the largest first in each step; the steps that are needed are
    returned with the group's tokens before each. Items without tokens count as none.
    """
    s = df.select(group, key, F.coalesce(F.col(tokens), F.lit(0)).alias("_t"))
    steps = s.select("*", F.explode(F.array(F.lit(1), F.lit(2))).alias("step"))
    saved = F.when(F.col("step") == 1, F.col("_t") - F.floor(F.col("_t") / 2)).otherwise(F.floor(F.col("_t") / 2) - F.floor(F.col("_t") / 8))
    whole = s.groupBy(F.col(group).alias("_g")).agg(F.sum("_t").alias("_whole")).where(F.col("_whole") > budget)
    steps = steps.withColumn("saved", saved).join(whole, F.col(group) == F.col("_g"))  # groups that fit are not looked at
    w = Window.partitionBy(group).orderBy("step", F.desc("_t"), key).rowsBetween(Window.unboundedPreceding, -1)
    done = steps.withColumn("_left", F.col("_whole") - F.coalesce(F.sum("saved").over(w), F.lit(0))).where(F.col("_left") > budget)
    return done.select(group, key, F.col("step").cast("long").alias("step"), F.col("saved").cast("long").alias("saved"), F.col("_left").cast("long").alias("tokens_before"))


def change_status(df: DataFrame, group: str, removed: Column, added: Column, unresolved: Column) -> DataFrame:
    """``group, removed, added, unresolved, status``: fail with what is left open, warn if more went than came, else pass."""
    g = df.groupBy(group).agg(F.count_if(removed).alias("removed"), F.count_if(added).alias("added"), F.count_if(unresolved).alias("unresolved"))
    return g.withColumn("status", F.when(F.col("unresolved") > 0, "fail").when(F.col("removed") > F.col("added"), "warn").otherwise("pass"))


def compare_strategies(df: DataFrame, group: str, second: str, recall: str, missed: str, coverage: str, room: float = 1e-12) -> DataFrame:
    """``group, recall_gain, coverage_gain, earned_by``: two strategies by averages, and what the second earned its cost by.

    ``second`` tells the rows of the second strategy. More recall counts first, then fewer missed, then, with equal
    recall, more coverage.
    """
    of = lambda c, f: F.when(F.col(second) == f, F.col(c))
    pairs = [(i, f) for i, f in ((0, False), (1, True))]
    g = df.groupBy(group).agg(
        *[F.round(F.avg(of(c, f)), 9).alias(f"{n}_{i}") for n, c in (("r", recall), ("c", coverage)) for i, f in pairs], *[F.sum(of(missed, f)).alias(f"m_{i}") for i, f in pairs]
    )
    more = F.col("r_1") - F.col("r_0")
    why = F.when(more > room, "recall").when(F.col("m_1") < F.col("m_0"), "fewer missed").when((F.abs(more) <= room) & (F.col("c_1") > F.col("c_0") + room), "coverage").otherwise("not earned")
    return g.select(group, F.round(more, 9).alias("recall_gain"), F.round(F.col("c_1") - F.col("c_0"), 9).alias("coverage_gain"), why.alias("earned_by"))


def symbol_hints(symbols: DataFrame, tasks: DataFrame, key: str, path: str, symbol: str, task: str, terms: str, selected: str, *, per_file: int, most: int) -> DataFrame:
    """``task, key, symbol, rank, score, place``: for each task the symbols to look at, by class and score.

    ``tasks`` has an array of ``terms`` and of ``selected`` paths. Classes: of selected files those that two terms, one
    term, or none name; of others those that two terms or one name in symbol or path. ``per_file`` of a file and
    ``most`` of a task are kept.

    Symbols that share no term with a task, and lie in none of its files, never meet it: terms are looked up in the words of
    symbols and paths by an index.
    """
    rows = symbols.select(F.col(key), F.col(path).alias("path"), F.col(symbol).alias("symbol")).where("symbol IS NOT NULL").distinct()
    rows = rows.withColumns({"said": X.plain_text(F.col("symbol")), "whole": X.plain_text(F.col("path"))})
    t = tasks.select(F.col(task), F.col(terms).alias("terms"), F.coalesce(F.col(selected), F.array().cast("array<string>")).alias("chosen"))
    words = lambda c: F.array_distinct(F.regexp_extract_all(c, F.lit("([a-z0-9]+)"), 1))
    index = rows.select("symbol", "path", key, F.explode(F.array_distinct(F.concat(words(F.col("said")), words(F.col("whole"))))).alias("word"))
    asked = t.select(task, F.explode("terms").alias("term"))
    met = asked.join(words_with(asked, index), "term").join(index, "word").select(task, key, "path", "symbol").distinct()
    own = t.select(task, F.explode("chosen").alias("path")).join(rows.select(key, "path", "symbol"), "path").select(task, key, "path", "symbol")
    pairs = met.unionByName(own).distinct().join(rows, [key, "path", "symbol"]).join(t, task)
    count = lambda hit: F.size(F.filter("terms", hit))
    pairs = pairs.withColumns({"s": count(lambda w: F.contains("said", w)), "p": count(lambda w: F.contains("whole", w)), "m": count(lambda w: F.contains("said", w) | F.contains("whole", w)), "sel": F.array_contains("chosen", F.col("path"))})
    s, p, sel = F.col("s"), F.col("p"), F.col("sel")
    made = lambda rank, score: F.struct(F.lit(rank).alias("rank"), score.cast("long").alias("score"))
    of_selected = F.when(sel & (s >= 2), made(0, 500 + 70 * s + 10 * p)).when(sel & (s > 0), made(1, 400 + 60 * s + 8 * p)).when(sel & (p > 0), made(2, 300 + 20 * p)).when(sel, made(2, F.lit(280)))
    of_others = F.when(F.col("m") >= 2, made(3, 220 + 60 * s + 10 * p)).when(F.col("m") == 1, made(4, 140 + 40 * s + 5 * p))
    f = pairs.withColumn("c", F.coalesce(of_selected, of_others)).where("c IS NOT NULL").select(task, key, "path", "symbol", "c.rank", "c.score")
    order = [F.col("rank"), F.desc("score"), F.col("path"), F.col("symbol"), F.col(key)]
    few = top_per_group(top_per_group(f, [task, key], order, per_file, "_in_file"), [task], order, most, "place")
    return few.select(task, key, "symbol", F.col("rank").cast("long").alias("rank"), "score", F.col("place").cast("long").alias("place"))


def relevant_nodes(nodes: DataFrame, tasks: DataFrame, node: str, text: Column, bonus: Column, task: str, words: str, *, most: int) -> DataFrame:
    """``task, node, score, place, omitted``: for each task the nodes by the words that they share with it, ten a word.

    ``bonus`` is added to every node, so nodes without a shared word take part; of these only the best ``most`` can be
    shown, so the others are counted and left out before they meet a task.
    """
    rows = nodes.select(F.col(node), F.array_distinct(F.split(F.lower(text), " ")).alias("said"), bonus.alias("bonus"))
    t = tasks.select(F.col(task), F.array_distinct(F.col(words)).alias("words"))
    shared = t.select(task, F.explode("words").alias("w")).join(rows.select(node, F.explode("said").alias("w")), "w").groupBy(task, node).agg(F.count("*").alias("_shared"))
    met = shared.join(rows.select(node, "bonus"), node).select(task, node, (F.col("_shared") * 10 + F.col("bonus")).cast("long").alias("score"))
    plain = rows.select(node, F.col("bonus").cast("long").alias("score")).orderBy(F.desc("score"), node).limit(most)
    rest = t.select(task, F.inline(plain.agg(F.collect_list(F.struct(node, "score"))).scalar()))  # a bounded list
    every = met.unionByName(rest).groupBy(task, node).agg(F.max("score").alias("score"))
    omitted = nodes.agg(F.greatest(F.count("*") - most, F.lit(0))).scalar()
    few = top_per_group(every, [task], [F.desc("score"), F.col(node)], most, "place")
    return few.select(task, node, "score", F.col("place").cast("long").alias("place"), omitted.alias("omitted"))


def record_issues(df: DataFrame, record: str, order: str, role: str, text: str, first_roles: tuple[str, ...] = ("user", "system")) -> DataFrame:
    """``record, issues, action``: what is wrong with the states of each record, and what is to be done next.

    Issues: the first state is none of ``first_roles``, a role follows itself, a text is empty, or their number is odd.
    Of states with an equal order any may be first.
    """
    c = df.withColumn("_prev", F.lag(role).over(Window.partitionBy(record).orderBy(order)))
    g = c.groupBy(record).agg(F.min_by(role, order).alias("first"), F.max_by(role, order).alias("last"), F.count("*").alias("n"), F.count_if(F.col("_prev") == F.col(role)).alias("repeats"), F.count_if(F.coalesce(F.length(text), F.lit(0)) == 0).alias("empty"))
    issues = F.array_compact(F.array(F.when(~F.coalesce(F.lower("first").isin(*first_roles), F.lit(False)), "start"), F.when(F.col("repeats") > 0, "repeated"), F.when(F.col("empty") > 0, "empty"), F.when(F.col("n") % 2 == 1, "odd")))
    action = F.when(F.array_contains(issues, "empty"), "stop").when(F.col("last") == "user", "answer").when(F.size(issues) > 0, "review").otherwise("done")
    return g.select(record, F.array_join(issues, ",").alias("issues"), action.alias("action"))


def lookup_endings(wanted: DataFrame, files: DataFrame, name: str, key: str, path: str) -> DataFrame:
    """``name, key, path``: for each wanted ending the first file by key that is it or ends with it; none, no row.

    Endings are looked up in the paths by an index of grams, so no file is compared with every name.
    """
    terms = wanted.select(F.col(name).alias("term"))
    hits = words_with(terms, files.select(F.col(path).alias("word"))).where(F.endswith("word", "term"))
    found = hits.join(files.select(F.col(key), F.col(path).alias("word")), "word")
    return found.groupBy(F.col("term").alias(name)).agg(F.min(key).alias(key), F.min_by("word", key).alias(path))


def routes_at_risk(files: DataFrame, key: str, routes: str, imports: str, unresolved: DataFrame) -> DataFrame:
    """``key, n_routes, n_unresolved, risk``: files with routes whose imports are not resolved; none without routes.

    ``unresolved`` has ``key, imported``. The risk is high if the file's relative imports are among them, medium if
    others are, low without any.
    """
    lost = unresolved.groupBy(F.col(key).alias("_k")).agg(F.count("*").alias("n_unresolved"), F.bool_or(X.is_relative_import(F.col("imported"))).alias("_near"))
    rows = files.where(F.size(routes) > 0).select(key, F.size(routes).cast("long").alias("n_routes")).join(lost, F.col(key) == F.col("_k"), "left")
    risk = F.when(F.col("_near"), "high").when(F.col("n_unresolved") > 0, "medium").otherwise("low")
    return rows.select(key, "n_routes", F.coalesce("n_unresolved", F.lit(0)).alias("n_unresolved"), risk.alias("risk"))


def snippets(spark, df: DataFrame, group: str, key: str, tokens: str, budget: int) -> DataFrame:
    """``group, key, tokens`` of the snippets that fit in the budget, in the order of their keys; later ones may fit."""
    return folds.fill_budget(spark, df, [group], [F.col(key)], key, tokens, budget).where("admitted").select(group, key, tokens)


def changed_items(old: DataFrame, new: DataFrame, key: str, lists: list[str]) -> DataFrame:
    """``key, category, name, status``: items of the lists that came or went between two versions of a table."""

    def of(category: str) -> Column:
        own = F.coalesce(F.col(category), F.array().cast("array<string>"))
        return F.transform(own, lambda x: F.struct(F.lit(category).alias("category"), x.alias("name")))

    def items(df: DataFrame) -> DataFrame:
        return df.select(key, F.inline(F.concat(*map(of, lists))))

    return compare.set_diff(items(old), items(new), [key, "category", "name"]).where("status <> 'kept'")


def changed_sets(old: DataFrame, new: DataFrame, key: str, item: str) -> DataFrame:
    """``key, added, removed``: of each key the different items that came and went, in order; keys without a change are left out.

    Items are compared one by one before they are gathered, so what stays is in no list.
    """
    a, b = (df.select(key, F.col(item).alias("item")).where(F.col(key).isNotNull() & F.col("item").isNotNull()).distinct() for df in (old, new))
    came, went = b.join(a, [key, "item"], "left_anti").withColumn("came", F.lit(True)), a.join(b, [key, "item"], "left_anti").withColumn("came", F.lit(False))
    said = lambda hit: F.array_join(F.array_sort(F.collect_set(F.when(hit, F.col("item")))), " ")
    return came.unionByName(went).groupBy(key).agg(said(F.col("came")).alias("added"), said(~F.col("came")).alias("removed"))


def totals(df: DataFrame, by: str, sums: dict[str, Column]) -> DataFrame:
    """``by, <sums>, is_total``: the sums by value of a column, and of all rows in a row of its own."""
    return df.rollup(by).agg(*[c.alias(k) for k, c in sums.items()], F.grouping(by).cast("long").alias("is_total"))


def first_distinct(df: DataFrame, value: str, order: list[str], most: int) -> DataFrame:
    """``value`` and the columns of ``order``: the first ``most`` different values, each where it is seen first."""
    first = df.groupBy(value).agg(F.min(F.struct(*order)).alias("_at"))
    return first.orderBy("_at").limit(most).select(value, *[F.col(f"_at.{c}").alias(c) for c in order])


def group_relationships(df: DataFrame, keys: list[str], other: list[str], origin: str, score: str, high: float = 0.7, medium: float = 0.4) -> DataFrame:
    """``keys, n, n_distinct, high, low, origins``: relationships by key: how many, different ones, strong and weak ones."""
    return df.groupBy(*keys).agg(
        F.count("*").alias("n"), F.count_distinct(*other).alias("n_distinct"), F.count_if(F.col(score) >= high).alias("high"), F.count_if(F.coalesce(F.col(score) < medium, F.lit(True))).alias("low"),
        F.array_join(F.array_sort(F.collect_set(origin)), ",").alias("origins"),
    )
