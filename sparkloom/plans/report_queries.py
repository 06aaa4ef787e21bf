"""Queries that check, summarise, order and bound: journeys, workspaces, probes, budgets, with their SQL.

``events`` stand for the steps of a journey (a user), ``customer`` and ``nation`` for repositories of a workspace,
``orders`` for records with a status, ``pages`` for references by address.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import paths as X
from ..functions import relevance as R
from ..functions import text as T
from ..operators import graph, joining, jsonwalk, reports, resolution
from ..operators.reports import REFERENCE_RELATIONS
from ..store import Stage, dealt, spread, unsent
from .code_queries import _DESCRIBED, _PLACED, TASKS, _candidate_sql, described_files, tasks
from .code_tables import CODE, PATHS, SQL_TOKENS, code_files, sql_list
from .relation_queries import _EDGES, PATTERNS, _resolution_sql, priced_edges, read

# fixed values: presets of budgets, folders and names that rescue a file, words of back-end symbols
BUDGETS = {"tiny": 2000, "small": 4000, "medium": 8000, "large": 16000}
SOURCE_FOLDERS = ("api", "app", "components", "core", "features", "hooks", "lib", "pages", "routes", "services", "src")
GENERIC_STEMS = ("api", "app", "config", "helper", "helpers", "index", "main", "routes", "service", "util", "utils")
FRAMEWORK_CONFIGS = r"^(babel|eslint|jest|next|postcss|tailwind|vite)\.config\.|^(angular\.json|package\.json|pyproject\.toml|requirements\.txt|setup\.cfg|setup\.py|tsconfig\.json)$"
SYMBOL_CLASSES = (
    ("validation", ("validate", "validator", "valid"), 0.68), ("authorization", ("authorize", "authorization", "permission", "role", "policy"), 0.70),
    ("authentication", ("authenticate", "authentication", "auth", "login", "token", "session"), 0.68),
    ("database_access", ("repository", "repo", "dao", "db", "orm", "store", "query", "insert", "select"), 0.66), ("cache_access", ("cache", "redis", "memo"), 0.64),
    ("queue_publish", ("publish", "enqueue", "sendmessage", "queue"), 0.64), ("response", ("response", "respond", "render", "reply"), 0.70),
    ("backend_service", ("service", "svc", "usecase", "manager", "processor", "workflow", "interactor"), 0.66),
)


def symbol_class(symbol: Column) -> Column:
    """``{kind, score}`` of a back-end symbol by the words of its name, the first class that has one."""
    words = X.identifier_terms(symbol)
    out = F.lit(None)
    for kind, names, score in SYMBOL_CLASSES:
        hit = F.arrays_overlap(words, F.array(*[F.lit(n) for n in names]))
        made = F.struct(F.lit(kind).alias("kind"), F.lit(score).alias("score"))
        out = F.when(hit, made) if kind == "validation" else out.when(hit, made)
    return out.otherwise(F.struct(F.lit("business_logic").alias("kind"), F.lit(0.55).alias("score")))


def backend_symbols(spark, sf_dir):
    f = code_files(spark, sf_dir).select("file_id", F.concat(X.stem(F.col("path")), F.lit("."), F.col("functions")[0]).alias("symbol"))
    return f.select("file_id", "symbol", symbol_class(F.col("symbol"))["kind"].alias("kind"), symbol_class(F.col("symbol"))["score"].alias("score"))


def rescue_signals(path: Column, words: list[str]) -> dict[str, Column]:
    """Signs that a file matters though its name says nothing of the task."""
    low, stem = F.transform(X.folders(path), lambda x: F.lower(x)), F.substring_index(F.lower(X.stem(path)), ".", 1)
    has = lambda values, names: F.arrays_overlap(values, F.array(*[F.lit(n) for n in names]))
    return {
        "framework_config": F.lower(X.name(path)).rlike(FRAMEWORK_CONFIGS),
        "task_folder": has(X.folder_tokens(path), words),
        "generic_name": stem.isin(*GENERIC_STEMS),
        "directory_shape": has(low, SOURCE_FOLDERS),
    }


def probe_ranking(spark, sf_dir):
    """Files by a score of cheap rank, probe, structure and cost; the probe stands for the hits in the texts of documents."""
    words = R.task_words(TASKS[0], R.CANDIDATE_STOP_WORDS)
    f = described_files(spark, sf_dir).withColumn("cheap_score", R.candidate_score(TASKS[0])).select("file_id", "path", "size", "cheap_score", *[c.alias(k) for k, c in rescue_signals(F.col("path"), words).items()])
    w = Window.orderBy(F.desc("cheap_score"), F.lower("path"), "file_id")
    top = f.orderBy(F.desc("cheap_score"), F.lower("path"), "file_id").limit(40).withColumn("rank", F.row_number().over(w))
    signals = sum((F.col(k).cast("int") for k in ("framework_config", "task_folder", "generic_name", "directory_shape")), F.lit(0))
    d = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("file_id"), (F.least(F.col("n_chars"), F.lit(2000)) / 2000).alias("probe"))
    joined = top.join(d, "file_id", "left").select("file_id", "path", (1 - (F.col("rank") - 1) / 40).alias("cheap"), F.coalesce("probe", F.lit(0.0)).alias("probe"), (signals / 6).alias("structural"), (F.col("size") / 3000000).alias("cost"))
    score = R.probe_score(F.col("cheap"), F.col("probe"), F.col("structural"), F.col("cost"))
    return joined.withColumn("score", F.round(score, 9)).orderBy(F.desc("score"), "path").limit(25).select("file_id", "path", "score")


def starting_files(spark, sf_dir):
    """Script files to start from for the first task: candidate score with more for the extension and the front-end role."""
    f = described_files(spark, sf_dir).withColumn("cheap", R.candidate_score(TASKS[0]))
    f = f.where(F.col("extension").isin("js", "jsx", "ts", "tsx") & ~F.col("is_generated") & ~F.col("place").isin("generated", "vendor") & ~F.col("is_test") & (F.col("front") != "test"))
    more = F.when(F.col("extension").isin("jsx", "tsx"), 2).otherwise(1) + F.when(F.col("front").isin("page", "component", "form"), 3).when(F.col("front").isin("hook", "route"), 2).otherwise(0)
    return f.select("file_id", "path", "front", (F.col("cheap") + more).cast("long").alias("score")).orderBy(F.desc("score"), F.lower("path"), "file_id").limit(15)


def path_lookup(spark, sf_dir):
    """For each wanted ending the first file that is it or ends with it; every file's last two parts are wanted too."""
    f = code_files(spark, sf_dir)
    given = spark.createDataFrame([("index.py",), ("src/UserCard",), ("app.routes.ts",), ("never.x",)], "wanted string")
    own = f.select(F.substring_index("path", "/", -2).alias("wanted"))
    return reports.lookup_endings(given.unionByName(own).distinct(), f, "wanted", "file_id", "path")


def repository_matches(spark, sf_dir):
    """The repository (a nation) that an address names, by the whole address or else by its port; two are ambiguous."""
    n = read(spark, sf_dir, "nation").select("n_nationkey", F.concat(F.lit("http://"), F.lower("n_name"), F.lit(".example.com")).alias("url"), (F.col("n_nationkey") % 20 + 3000).cast("long").alias("port"))
    k = F.col("page_id")
    said = F.when(k % 3 == 0, F.concat(F.lit("HTTP://NATION_"), (k % 25).cast("string"), F.lit(".Example.com/"))).when(k % 3 == 1, F.concat(F.lit("http://localhost:"), (k % 23 + 3000).cast("string"))).otherwise(F.col("url"))
    r = read(spark, sf_dir, "pages").select("page_id", (k % 25).cast("int").alias("own"), said.alias("address"))
    return reports.match_addresses(r, n, "page_id", "own", "address", "n_nationkey", "url", "port")


def unresolved_relations(spark, sf_dir):
    """References as relations between nations: the type decides, then self, then which end is unknown."""
    k = F.col("s_suppkey")
    kinds = F.array(*[F.lit(x) for x in (*REFERENCE_RELATIONS, "shared_constant")])
    r = read(spark, sf_dir, "supplier").select(k, F.element_at(kinds, (k % (len(REFERENCE_RELATIONS) + 1) + 1).cast("int")).alias("reference"), F.col("s_nationkey").alias("source"), ((k * 3) % 29).cast("int").alias("target"))
    known = read(spark, sf_dir, "nation").where("n_nationkey % 7 <> 1")
    return reports.relation_hints(r, known, "s_suppkey", "reference", "source", "target", "n_nationkey")


def journey_checks(spark, sf_dir):
    """For each user (a journey): steps, kinds, transitions between unlike kinds, back steps, and whether a signup is followed by a purchase."""
    return reports.journey_summary(read(spark, sf_dir, "events"), "user_id", "event_type", ["ts", "event_id"], "signup", "purchase", 5, "no purchase after signup")


def bounded_diagnostics(spark, sf_dir):
    """Of each user's errors the first three; a last row says how many were left out."""
    e = read(spark, sf_dir, "events").where("event_type = 'error'")
    return reports.bounded_items(e, "user_id", [F.desc("value"), F.col("event_id")], F.col("event_id"), 3)


def status_summaries(spark, sf_dir):
    """One row a stage: counts by severity, the worst of them and the readiness that follows."""
    o = read(spark, sf_dir, "orders").select("o_orderpriority", F.element_at(F.array(F.lit("info"), F.lit("warning"), F.lit("error")), (F.col("o_orderkey") % 3 + 1).cast("int")).alias("s"), "o_orderstatus").where("o_orderstatus <> 'O' or s = 'info'")
    o = o.where("not (o_orderpriority like '1%' and s = 'error') and not (o_orderpriority like '2%' and s <> 'info')")
    return reports.severity_summary(o, "o_orderpriority", "s")


def resolution_merge(spark, sf_dir):
    """Equal identities merged: the union of notes, sums of counters, the least status."""
    note = F.concat(F.lit("n"), (F.col("l_suppkey") % 9).cast("string"))
    l = read(spark, sf_dir, "lineitem").select((F.col("l_partkey") % 60).alias("library"), F.col("l_returnflag").alias("class"), note.alias("note"), F.col("l_linenumber").cast("long").alias("count"), F.col("l_linestatus").alias("state"))
    return reports.merge_resolutions(l, ["library", "class"], "note", "count", "state")


def role_assessments(spark, sf_dir):
    """The role of each customer: the configured one, else what its orders suggest, else unknown; and how sure that is."""
    c = read(spark, sf_dir, "customer").select("c_custkey", F.when(F.col("c_custkey") % 3 == 0, F.col("c_mktsegment")).alias("segment"))
    strength = F.when(F.col("o_orderstatus") == "F", 0.9).when(F.col("o_orderstatus") == "O", 0.6).otherwise(0.3)
    o = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"), F.col("o_orderpriority").alias("priority"), strength.alias("strength"), (F.col("o_orderstatus") == "P").alias("weak"))
    conflict = F.substring("configured", 1, 1) != F.substring("found", 3, 1)
    return reports.assess_roles(c, o, "c_custkey", "segment", "priority", "strength", "weak", conflict=conflict)


def representation_order(spark, sf_dir):
    """Representations by tier, then by tokens with the unknown last, and the running savings."""
    tiers = ("whole", "symbol", "outline", "path")
    p = read(spark, sf_dir, "part").select("p_partkey", F.element_at(F.array(*[F.lit(x) for x in tiers]), (F.col("p_partkey") % 4 + 1).cast("int")).alias("tier"), F.when(F.col("p_partkey") % 5 > 0, (F.col("p_size") * 37 % 101).cast("long")).alias("tokens"))
    return reports.order_representations(p, "p_partkey", "tier", "tokens", tiers, 200)


def budget_values(spark, sf_dir):
    """Budgets by name or number, and the tokens that a share of each gives."""
    p = read(spark, sf_dir, "part").select("p_partkey", F.element_at(F.array(*[F.lit(x) for x in ("tiny", " Small ", "4000", "0", "", "many", "LARGE", "-5")]), (F.col("p_partkey") % 8 + 1).cast("int")).alias("raw"), ((F.col("p_size") % 5 + 1) / 8).alias("share"))
    bare = F.lower(F.trim("raw"))
    known = F.create_map(*[F.lit(x) for pair in BUDGETS.items() for x in pair])
    target = F.coalesce(F.try_element_at(known, bare), F.when(bare.rlike("^[0-9]+$"), F.nullif(bare.try_cast("int"), F.lit(0)))).cast("long")
    usable = F.greatest(F.lit(0), F.least(F.lit(6000), F.col("target") - 500) - F.floor(F.col("target") * 0.125))
    return p.withColumn("target", target).select("p_partkey", "raw", "target", F.when(F.col("target").isNotNull(), F.greatest(F.lit(1), F.floor(usable * F.col("share")))).cast("long").alias("tokens"))


def byte_capped_probe(spark, sf_dir):
    """The bytes that a probe reads of the first files of each source: 400 a file, 2,000 in all, files above 60,000 skipped."""
    d = read(spark, sf_dir, "documents").select("source", "doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("size"))
    w = Window.partitionBy("source").orderBy("doc_id")
    first = d.withColumn("place", F.row_number().over(w)).where("place <= 12")
    want = F.when(F.col("size") > 60000, 0).otherwise(F.least(F.col("size"), F.lit(400)))
    before = F.coalesce(F.sum(want).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    read_ = F.greatest(F.lit(0), F.least(want, 2000 - before))
    skipped = F.when(F.col("size") > 60000, "too_large").when(before >= 2000, "total_bytes").when(read_ < F.least(F.col("size"), F.lit(400)), "cut")
    return first.select("source", "doc_id", F.col("place").cast("long").alias("place"), read_.cast("long").alias("bytes"), skipped.alias("reason"))


def component_summary(spark, sf_dir):
    """Strong components of the edges of the files: their size, edges inside and the cheapest of them."""
    e = priced_edges(spark, sf_dir).select("source", "target", "cost")
    c = Stage(spark, "components").save(graph.strong_components(spark, e, "source", "target"))
    inside = e.join(unsent(c.withColumnRenamed("node", "source")), "source").join(unsent(c.select(F.col("node").alias("target"), F.col("component").alias("other"))), "target").where("component = other")
    sizes = unsent(c.groupBy("component").agg(F.count("*").alias("nodes")))
    return sizes.join(inside.groupBy("component").agg(F.count("*").alias("edges"), F.min("cost").alias("cheapest")), "component")


def call_trace(spark, sf_dir):
    """Files that a call chain of three edges reaches from each file, by the least number of steps."""
    stage = Stage(spark, "calls")
    e = stage.save(priced_edges(spark, sf_dir).select(F.col("source").alias("a"), F.col("target").alias("b")).distinct())
    at = e.select(F.col("a").alias("seed"), F.col("b").alias("node"), F.lit(1).alias("depth"))
    every, in_all = at, e.count()
    fan = e.groupBy("a").agg(F.count("*").alias("n"))
    for depth in (2, 3):
        # the rows that the join makes, before it is run
        met = at.groupBy("node").agg(F.count("*").alias("m")).join(unsent(fan), F.col("node") == F.col("a")).agg(F.coalesce(F.sum(F.col("m") * F.col("n")), F.lit(0))).first()[0]
        grown = dealt(at, met, "node").join(unsent(dealt(e, met, "a")), F.col("node") == F.col("a")).select("seed", F.col("b").alias("node"))
        at = stage.save(dealt(grown, met, "seed", "node").distinct().withColumn("depth", F.lit(depth)))
        every, in_all = every.unionByName(at), in_all + at.count()
    return dealt(every.where("seed <> node"), in_all, "seed", "node").groupBy("seed", "node").agg(F.min("depth").cast("long").alias("depth"))


def selected_sources(spark, sf_dir):
    """Files that a caller names: their bytes, cut at 500, or why not."""
    d = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("k"), F.coalesce("text", F.lit("")).alias("text"))
    wanted = read(spark, sf_dir, "part").where("p_partkey % 9 = 0").select(F.col("p_partkey"), (F.col("p_partkey") * 2).alias("k"))
    j = wanted.join(d, "k", "left")
    n = F.octet_length("text").cast("long")
    return j.select("p_partkey", F.when(F.col("text").isNull(), "missing").when(n > 20000, "too_large").when(n == 0, "empty").otherwise("read").alias("status"), F.when(n <= 20000, F.least(n, F.lit(500))).alias("bytes"))


def configs(spark, sf_dir) -> DataFrame:
    """``event_id, j``: a nested configuration for each event; that of every fiftieth is broken off."""
    props, k = F.coalesce("props", F.lit("{}")), F.col("event_id").cast("string")
    j = F.concat(F.lit('{"type": "'), "event_type", F.lit('", "a": {"list": [1, {"note": "token=abc, ok", "Api-Key": {"x": 1}}, [null, true, []]], "in": '), props, F.lit(', "id": '), k, F.lit("}}"))
    events = spread(read(spark, sf_dir, "events").select("event_id", "event_type", "props"), "event_id")
    return events.select("event_id", F.when(F.col("event_id") % 50 == 0, F.substring(j, F.lit(1), F.char_length(j) - 1)).otherwise(j).alias("j"))


def config_values(spark, sf_dir):
    """Key paths, kinds and values of nested configurations, at any depth."""
    return jsonwalk.json_leaves(spark, configs(spark, sf_dir), "event_id", "j").select("event_id", F.array_join("path", ".").alias("key"), "kind", "value")


def redacted_configs(spark, sf_dir):
    """The configurations with sorted names and masked secrets."""
    return jsonwalk.redacted_json(spark, configs(spark, sf_dir), "event_id", "j")


def related_edges(spark, sf_dir):
    """Edges that touch the files of the first task's terms: first those between them, then those that leave or enter."""
    f = described_files(spark, sf_dir).where(R.candidate_score(TASKS[0]) >= 6).select("file_id")
    f = Stage(spark, "related").save(f)
    e = priced_edges(spark, sf_dir).select("source", "target", "edge_type").distinct()
    out = joining.neighbours_of_set(e, f, "source", "target", "file_id").withColumn("node", F.col("node").cast("long"))
    inside = e.join(f.select(F.col("file_id").alias("source")), "source", "left_semi").join(f.select(F.col("file_id").alias("target")), "target", "left_semi").select(F.col("target").alias("node"), F.lit("inside").alias("direction")).distinct()
    return inside.unionByName(out).groupBy("direction").agg(F.count("*").alias("n"), F.min("node").alias("first"))


def diff_verification(spark, sf_dir):
    """What a change of each nation's orders means: fail, warn or pass by what was removed, added and left open."""
    o = read(spark, sf_dir, "orders").join(read(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")).where("c_nationkey <> 24")
    k = F.col("o_orderkey")
    return reports.change_status(o, "c_nationkey", k % 60 == 1, k % 25 == 2, (F.col("o_orderstatus") == "P") & (k % 400 == 3))


def strategy_costs(spark, sf_dir):
    """Two strategies compared by segment: averages before and after, and whether the second earned its cost."""
    c = read(spark, sf_dir, "customer").select("c_mktsegment", (F.floor(F.col("c_acctbal")) % 2 == 0).alias("second"), (F.floor(F.abs("c_acctbal")) % 8 / 8).alias("recall"), (F.col("c_custkey") % 4 / 4).alias("coverage"), (F.col("c_custkey") % 3).alias("missed"))
    return reports.compare_strategies(c, "c_mktsegment", "second", "recall", "missed", "coverage")


def symbol_hints(spark, sf_dir):
    """Symbols by priority class (files selected, then by matched words) and score: two a file, forty in all."""
    f = code_files(spark, sf_dir).select("file_id", "path", F.explode(F.concat("classes", "functions")).alias("symbol"))
    selected = F.array(F.lit("src/index.py"), F.lit("src/UserCard"))
    t = tasks(spark).where("task = 0").select("task", T.task_terms(F.col("text")).alias("terms"), selected.alias("selected"))
    return reports.symbol_hints(f, t, "file_id", "path", "symbol", "task", "terms", "selected", per_file=2, most=40).drop("task")


def workspace_relevance(spark, sf_dir):
    """Suppliers as nodes by the words they share with a task, ten a word, and what speaks for them; the rest counted."""
    s = read(spark, sf_dir, "supplier").join(read(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    text = F.concat_ws(" ", F.regexp_replace("s_name", "[^A-Za-z0-9]+", " "), F.regexp_replace("n_name", "[^A-Za-z0-9]+", " "))
    t = spark.createDataFrame([(0, ["nation", "supplier", "7", "12"])], "task long, words array<string>")
    return reports.relevant_nodes(s, t, "s_suppkey", text, F.when(F.col("s_acctbal") > 0, 5).otherwise(0), "task", "words", most=12).drop("task")


def snippet_budget(spark, sf_dir):
    """Snippets of each source in the order of their documents, as long as they fit in 900 tokens; later ones may fit."""
    d = read(spark, sf_dir, "documents").select("source", "doc_id", F.least(F.ceil(F.char_length(F.coalesce("text", F.lit(""))) / 3.3), F.lit(300)).cast("long").alias("tokens"))
    return reports.snippets(spark, d, "source", "doc_id", "tokens", 900)


def budget_downgrade(spark, sf_dir):
    """Which representations become lighter, tier by tier and the largest first, until each nation's parts fit its budget."""
    s = read(spark, sf_dir, "supplier").select("s_nationkey", "s_suppkey", (F.col("s_suppkey") % 7 * 40 + 60).alias("tokens"))
    return reports.downgrade_to_budget(s, "s_nationkey", "s_suppkey", "tokens", 100)


def library_probe(spark, sf_dir):
    """Where an import's library is found: installed with declarations, vendored, an archive, opaque, or nowhere."""
    f = code_files(spark, sf_dir)
    wanted = f.select(F.explode("functions").alias("library")).groupBy("library").agg(F.count("*").alias("uses"))
    found = f.select(F.col("functions")[0].alias("library"), F.when(F.col("path").startswith("node_modules") & F.col("path").endswith(".ts"), 0).when(F.col("path").startswith("vendor"), 1).when(F.col("path").endswith(".key"), 2).when(F.col("path").startswith("node_modules"), 3).alias("rank"), "path").where("rank is not null")
    best = found.groupBy("library").agg(F.min(F.struct("rank", "path")).alias("b"))
    kinds = F.array(*[F.lit(k) for k in ("declarations", "vendored", "archive", "opaque")])
    return wanted.join(best, "library", "left").select("library", "uses", F.coalesce(F.get(kinds, F.col("b.rank")), F.lit("missing")).alias("kind"), F.col("b.path").alias("path"))


def workflow_states(spark, sf_dir):
    """What is wrong with the record of each conversation, and the next action."""
    return reports.record_issues(read(spark, sf_dir, "conversations"), "conv_id", "turn", "role", "text")


def route_risks(spark, sf_dir):
    """Files with routes by what of their imports is not resolved."""
    f = code_files(spark, sf_dir)
    i = f.select("file_id", "path", F.explode("imports").alias("imported"))
    lost = resolution.resolve_scripts(i, f, "path", "imported", PATTERNS).where("status = 'unresolved'")
    return reports.routes_at_risk(f, "file_id", "routes", "imports", lost)


# --- SQL

_TASK_WORDS = R.task_terms(TASKS[0])
_PLAIN = "lower(translate({0}, '\\_-', '/  '))"
_HITS = {c: " + ".join(f"contains({_PLAIN.format(c)}, '{w}')::INT" for w in _TASK_WORDS) for c in ("symbol", "path")}
_EITHER = " + ".join(f"(contains({_PLAIN.format('symbol')}, '{w}') OR contains({_PLAIN.format('path')}, '{w}'))::INT" for w in _TASK_WORDS)
_FILES = f"""{_DESCRIBED}, {_PLACED}, scored AS (SELECT *, ({_candidate_sql(TASKS[0])})::BIGINT AS cheap_score FROM placed)"""
_WORDS = R.task_words(TASKS[0], R.CANDIDATE_STOP_WORDS)
_IS_TEST = "(list_has_any(low, ['__tests__', 'spec', 'specs', 'test', 'tests']) OR regexp_matches(lower(stem), '^test_|_test$|\\.test$|\\.spec$'))"


def _class_sql() -> str:
    return " ".join(f"WHEN list_has_any(w, {sql_list(names)}) THEN {{0}}".replace("{0}", f"'{kind}'") for kind, names, _ in SYMBOL_CLASSES)


def _class_score() -> str:
    return " ".join(f"WHEN list_has_any(w, {sql_list(names)}) THEN {score}" for _, names, score in SYMBOL_CLASSES)


def _terms(text: str) -> str:
    from .code_tables import sql_terms

    return sql_terms(text)


def _generated() -> str:
    from .code_queries import _GENERATED

    return _GENERATED


_CONFIGS = """j AS (SELECT event_id, CASE WHEN event_id % 50 = 0 THEN j[:length(j) - 1] ELSE j END AS j FROM (SELECT event_id, '{"type": "' || event_type || '", "a": {"list": [1, {"note": "token=abc, ok", "Api-Key": {"x": 1}}, [null, true, []]], "in": ' || coalesce(props, '{}') || ', "id": ' || event_id || '}}' AS j FROM events))"""

SQL = {
    "backend_symbols": f"WITH {PATHS}, s AS (SELECT file_id, stem || '.' || functions[1] AS symbol FROM paths), t AS (SELECT *, {_terms('symbol')} AS w FROM s) SELECT file_id, symbol, CASE {_class_sql()} ELSE 'business_logic' END AS kind, CASE {_class_score()} ELSE 0.55 END::DOUBLE AS score FROM t",
    "probe_ranking": f"""WITH {_FILES}, top AS (SELECT *, row_number() OVER (ORDER BY cheap_score DESC, lower(path), file_id) AS rank FROM scored QUALIFY rank <= 40),
s AS (SELECT *, regexp_matches(lower(name), '{FRAMEWORK_CONFIGS}')::INT + list_has_any(flatten(list_transform(above, lambda f: {SQL_TOKENS.format('f')})), {sql_list(_WORDS)})::INT + list_contains({sql_list(GENERIC_STEMS)}, string_split(lower(stem), '.')[1])::INT + list_has_any(low, {sql_list(SOURCE_FOLDERS)})::INT AS signals FROM top),
j AS (SELECT file_id, path, 1 - (rank - 1) / 40::DOUBLE AS cheap, CASE WHEN n_chars IS NULL THEN 0 ELSE least(n_chars, 2000) / 2000::DOUBLE END AS probe, signals / 6::DOUBLE AS structural, size / 3000000::DOUBLE AS cost FROM s LEFT JOIN documents ON doc_id = file_id)
SELECT file_id, path, round(0.35::DOUBLE * cheap + 0.30::DOUBLE * probe + 0.20::DOUBLE * structural - 0.15::DOUBLE * cost, 9) AS score FROM j ORDER BY score DESC, path LIMIT 25""",
    "starting_files": f"""WITH {_FILES} SELECT file_id, path, front, (cheap_score + CASE WHEN ext IN ('jsx', 'tsx') THEN 2 ELSE 1 END + CASE WHEN front IN ('page', 'component', 'form') THEN 3 WHEN front IN ('hook', 'route') THEN 2 ELSE 0 END)::BIGINT AS score FROM scored
WHERE ext IN ('js', 'jsx', 'ts', 'tsx') AND NOT {_generated()} AND place_role NOT IN ('generated', 'vendor') AND NOT {_IS_TEST} AND front <> 'test' ORDER BY score DESC, lower(path), file_id LIMIT 15""",
    "path_lookup": f"WITH {CODE}, w AS (SELECT unnest(['index.py', 'src/UserCard', 'app.routes.ts', 'never.x']) AS wanted UNION SELECT array_to_string(string_split(path, '/')[-2:], '/') FROM code) SELECT wanted, min(file_id) AS file_id, arg_min(path, file_id) AS path FROM w JOIN code ON ends_with(path, wanted) GROUP BY wanted",
    "repository_matches": r"""WITH n AS (SELECT n_nationkey, 'http://' || lower(n_name) || '.example.com' AS url, n_nationkey % 20 + 3000 AS port FROM nation),
r AS (SELECT page_id, page_id % 25 AS own, CASE WHEN page_id % 3 = 0 THEN 'http://nation_' || (page_id % 25) || '.example.com' WHEN page_id % 3 = 1 THEN 'http://localhost:' || (page_id % 23 + 3000) ELSE url END AS url, CASE WHEN page_id % 3 = 1 THEN page_id % 23 + 3000 END AS port FROM pages),
h AS (SELECT page_id, n_nationkey, 0.95::DOUBLE AS score FROM r JOIN n USING (url) WHERE n_nationkey <> own UNION ALL SELECT page_id, n_nationkey, 0.82 FROM r JOIN n USING (port) WHERE n_nationkey <> own),
b AS (SELECT page_id, score, count(DISTINCT n_nationkey) AS c, min(n_nationkey) AS target FROM h GROUP BY page_id, score QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY score DESC) = 1)
SELECT page_id, CASE WHEN c IS NULL THEN 'none' WHEN c > 1 THEN 'ambiguous' ELSE 'matched' END AS status, CASE WHEN c = 1 THEN target END AS target, score FROM r LEFT JOIN b USING (page_id)""",
    "unresolved_relations": f"""WITH r AS (SELECT s_suppkey, {sql_list((*REFERENCE_RELATIONS, "shared_constant"))}[s_suppkey % {len(REFERENCE_RELATIONS) + 1} + 1] AS reference, s_nationkey AS source, s_suppkey * 3 % 29 AS target FROM supplier), k AS (SELECT n_nationkey AS k FROM nation WHERE n_nationkey % 7 <> 1),
q AS (SELECT *, CASE reference WHEN 'api_base_url' THEN 'calls_api' WHEN 'environment_url' THEN 'calls_api' WHEN 'iframe_src' THEN 'embeds_iframe' WHEN 'post_message' THEN 'sends_messages_to' WHEN 'message_listener' THEN 'receives_messages_from' END AS relation, source IN (SELECT k FROM k) AS a, target IN (SELECT k FROM k) AS b FROM r)
SELECT s_suppkey, relation, CASE WHEN relation IS NULL THEN 'unsupported_type' WHEN source = target THEN 'self' WHEN NOT a AND NOT b THEN 'both_missing' WHEN NOT a THEN 'source_missing' WHEN NOT b THEN 'target_missing' ELSE 'resolved' END AS reason FROM q""",
    "journey_checks": """WITH e AS (SELECT *, lead(event_type) OVER w AS nxt, lag(event_type) OVER w AS prv, row_number() OVER w AS place, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) > 1 AS seen FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
g AS (SELECT user_id, count(*) AS steps, count(DISTINCT event_type) AS kinds, count(*) FILTER (nxt <> event_type) AS transitions, count(*) FILTER (seen AND event_type <> coalesce(prv, '')) AS back_steps, min(place) FILTER (event_type = 'signup') AS s, max(place) FILTER (event_type = 'purchase') AS p FROM e GROUP BY 1),
h AS (SELECT *, CASE WHEN s IS NOT NULL AND NOT coalesce(p > s, false) THEN 'no purchase after signup' END AS gap FROM g), r AS (SELECT *, CASE WHEN gap IS NOT NULL THEN 'partial' WHEN kinds = 5 THEN 'complete' ELSE 'limited' END AS readiness FROM h)
SELECT user_id, steps, kinds, transitions, back_steps, gap, readiness, (kinds * 2 + CASE WHEN readiness = 'complete' THEN 18 ELSE 0 END - CASE WHEN gap IS NOT NULL THEN 0.5 ELSE 0 END)::DOUBLE AS rank FROM r""",
    "bounded_diagnostics": """WITH e AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS place, count(*) OVER (PARTITION BY user_id) AS n FROM events WHERE event_type = 'error')
SELECT user_id, place, event_id::VARCHAR AS item FROM e WHERE place <= 3 UNION ALL SELECT user_id, 4, 'omitted ' || (n - 3) FROM e WHERE place = 4""",
    "status_summaries": """WITH o AS (SELECT o_orderpriority, ['info', 'warning', 'error'][o_orderkey % 3 + 1] AS s, o_orderstatus FROM orders),
f AS (SELECT * FROM o WHERE (o_orderstatus <> 'O' OR s = 'info') AND NOT (o_orderpriority LIKE '1%' AND s = 'error') AND NOT (o_orderpriority LIKE '2%' AND s <> 'info'))
SELECT o_orderpriority, count(*) FILTER (s = 'info') AS info, count(*) FILTER (s = 'warning') AS warning, count(*) FILTER (s = 'error') AS error, CASE WHEN bool_or(s = 'error') THEN 'blocked' WHEN bool_or(s = 'warning') THEN 'partial' ELSE 'ready' END AS readiness FROM f GROUP BY 1""",
    "resolution_merge": """WITH l AS (SELECT DISTINCT l_partkey % 60 AS library, l_returnflag AS class, 'n' || (l_suppkey % 9) AS note, l_linenumber::BIGINT AS files, l_linestatus AS status FROM lineitem)
SELECT library, class, array_to_string(list_sort(list(DISTINCT note)), ',') AS notes, sum(files)::BIGINT AS files, min(status) AS status, count(*) AS n FROM l GROUP BY ALL""",
    "role_assessments": """WITH o AS (SELECT o_custkey, o_orderpriority AS role, count(*) AS n, max(CASE o_orderstatus WHEN 'F' THEN 0.9 WHEN 'O' THEN 0.6 ELSE 0.3 END::DOUBLE) AS s, bool_and(o_orderstatus = 'P') AS weak FROM orders GROUP BY ALL),
b AS (SELECT * FROM o QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY s DESC, n DESC, role DESC, weak DESC) = 1), j AS (SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN c_mktsegment END AS configured, b.* FROM customer LEFT JOIN b ON c_custkey = o_custkey)
SELECT c_custkey, CASE WHEN configured IS NOT NULL THEN 'explicit' WHEN role IS NOT NULL THEN 'discovered' ELSE 'default' END AS origin, coalesce(configured, role, 'unknown') AS role,
  CASE WHEN configured IS NOT NULL THEN 1.0 WHEN role IS NULL THEN 0.1 ELSE least(CASE WHEN weak THEN least(s, 0.35) ELSE s END, 0.9) END::DOUBLE AS score, configured IS NOT NULL AND role IS NOT NULL AND substr(configured, 1, 1) <> substr(role, 3, 1) AS conflict FROM j""",
    "representation_order": """WITH p AS (SELECT p_partkey, ['whole', 'symbol', 'outline', 'path'][p_partkey % 4 + 1] AS tier, p_partkey % 4 AS t, CASE WHEN p_partkey % 5 > 0 THEN (p_size * 37 % 101)::BIGINT END AS tokens FROM part),
r AS (SELECT *, row_number() OVER (ORDER BY t, tokens NULLS LAST, p_partkey) AS place FROM p QUALIFY place <= 200) SELECT p_partkey, tier, tokens, place, sum(coalesce(tokens, 0)) OVER (ORDER BY place)::BIGINT AS running FROM r""",
    "budget_values": """WITH p AS (SELECT p_partkey, ['tiny', ' Small ', '4000', '0', '', 'many', 'LARGE', '-5'][p_partkey % 8 + 1] AS raw, (p_size % 5 + 1) / 8::DOUBLE AS share FROM part),
t AS (SELECT *, CASE lower(trim(raw)) WHEN 'tiny' THEN 2000 WHEN 'small' THEN 4000 WHEN 'large' THEN 16000 WHEN '4000' THEN 4000 END::BIGINT AS target FROM p)
SELECT p_partkey, raw, target, CASE WHEN target IS NOT NULL THEN greatest(1, floor(greatest(0, least(6000, target - 500) - floor(target * 0.125::DOUBLE)) * share)) END::BIGINT AS tokens FROM t""",
    "byte_capped_probe": """WITH d AS (SELECT source, doc_id, octet_length(encode(coalesce(text, ''))) AS size, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS place FROM documents QUALIFY place <= 12),
w AS (SELECT *, CASE WHEN size > 60000 THEN 0 ELSE least(size, 400) END AS want FROM d), b AS (SELECT *, coalesce(sum(want) OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM w)
SELECT source, doc_id, place, greatest(0, least(want, 2000 - before))::BIGINT AS bytes, CASE WHEN size > 60000 THEN 'too_large' WHEN before >= 2000 THEN 'total_bytes' WHEN greatest(0, least(want, 2000 - before)) < least(size, 400) THEN 'cut' END AS reason FROM b""",
    "component_summary": f"""WITH RECURSIVE {_EDGES}, e AS (SELECT source AS a, target AS b, cost FROM priced), d AS (SELECT DISTINCT a, b FROM e WHERE a <> b), reach AS (SELECT a, b FROM d UNION SELECT r.a, d.b FROM reach r JOIN d ON r.b = d.a),
c AS (SELECT x.a AS node, least(x.a, min(x.b)) AS component FROM reach x JOIN reach y ON x.a = y.b AND x.b = y.a WHERE x.a <> x.b GROUP BY x.a),
i AS (SELECT p.component, count(*) AS edges, min(cost) AS cheapest FROM e JOIN c p ON p.node = a JOIN c q ON q.node = b AND q.component = p.component GROUP BY 1)
SELECT component, nodes, edges, cheapest FROM (SELECT component, count(*) AS nodes FROM c GROUP BY 1) JOIN i USING (component)""",
    "call_trace": f"""WITH {_EDGES}, e AS (SELECT DISTINCT source AS a, target AS b FROM priced), x AS (SELECT a AS seed, b AS node, 1 AS depth FROM e), y AS (SELECT DISTINCT seed, b AS node, 2 AS depth FROM x JOIN e ON node = a), z AS (SELECT DISTINCT seed, b AS node, 3 AS depth FROM y JOIN e ON node = a)
SELECT seed, node, min(depth)::BIGINT AS depth FROM (SELECT * FROM x UNION ALL SELECT * FROM y UNION ALL SELECT * FROM z) WHERE seed <> node GROUP BY ALL""",
    "selected_sources": """WITH j AS (SELECT p_partkey, doc_id, octet_length(encode(coalesce(text, ''))) AS n FROM part LEFT JOIN documents ON doc_id = p_partkey * 2 WHERE p_partkey % 9 = 0)
SELECT p_partkey, CASE WHEN doc_id IS NULL THEN 'missing' WHEN n > 20000 THEN 'too_large' WHEN n = 0 THEN 'empty' ELSE 'read' END AS status, CASE WHEN doc_id IS NOT NULL AND n <= 20000 THEN least(n, 500) END::BIGINT AS bytes FROM j""",
    "config_values": f"""WITH RECURSIVE {_CONFIGS},
w AS (SELECT event_id, []::VARCHAR[] AS path, j::JSON AS v FROM j WHERE json_valid(j) UNION ALL SELECT w.event_id, list_append(w.path, e.key::VARCHAR), e.value FROM w, json_each(w.v) e WHERE json_type(w.v) IN ('OBJECT', 'ARRAY'))
SELECT event_id, array_to_string(path, '.') AS key, CASE json_type(v) WHEN 'VARCHAR' THEN 'string' WHEN 'NULL' THEN 'null' WHEN 'BOOLEAN' THEN 'boolean' WHEN 'OBJECT' THEN 'object' WHEN 'ARRAY' THEN 'array' ELSE 'number' END AS kind,
  CASE json_type(v) WHEN 'VARCHAR' THEN v->>'$' ELSE v::VARCHAR END AS value FROM w WHERE json_type(v) NOT IN ('OBJECT', 'ARRAY') OR v::VARCHAR IN ('{{}}', '[]')
UNION ALL SELECT event_id, '', 'error', NULL FROM j WHERE NOT json_valid(j)""",
    "redacted_configs": f"""WITH {_CONFIGS}, p AS (SELECT event_id, event_type, coalesce(props, '{{}}')::JSON AS props FROM events),
s AS (SELECT event_id, event_type, '{{' || coalesce((SELECT string_agg('"' || e.key || '":' || e.value::VARCHAR, ',' ORDER BY e.key) FROM json_each(p.props) e), '') || '}}' AS inside FROM p)
SELECT event_id, CASE WHEN event_id % 50 <> 0 THEN '{{"a":{{"id":' || event_id || ',"in":' || inside || ',"list":[1,{{"Api-Key":"[redacted]","note":"token=[redacted], ok"}},[null,true,[]]]}},"type":"' || event_type || '"}}' END AS redacted FROM s""",
    "diff_verification": """WITH g AS (SELECT c_nationkey, count(*) FILTER (o_orderkey % 60 = 1) AS removed, count(*) FILTER (o_orderkey % 25 = 2) AS added, count(*) FILTER (o_orderstatus = 'P' AND o_orderkey % 400 = 3) AS unresolved FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_nationkey <> 24 GROUP BY 1)
SELECT *, CASE WHEN unresolved > 0 THEN 'fail' WHEN removed > added THEN 'warn' ELSE 'pass' END AS status FROM g""",
    "strategy_costs": """WITH c AS (SELECT c_mktsegment, floor(c_acctbal)::BIGINT % 2 = 0 AS second, floor(abs(c_acctbal))::BIGINT % 8 / 8::DOUBLE AS recall, c_custkey % 4 / 4::DOUBLE AS coverage, c_custkey % 3 AS missed FROM customer),
g AS (SELECT c_mktsegment, round(avg(recall) FILTER (NOT second), 9) AS r0, round(avg(recall) FILTER (second), 9) AS r1, round(avg(coverage) FILTER (NOT second), 9) AS c0, round(avg(coverage) FILTER (second), 9) AS c1, sum(missed) FILTER (NOT second) AS m0, sum(missed) FILTER (second) AS m1 FROM c GROUP BY 1)
SELECT c_mktsegment, round(r1 - r0, 9) AS recall_gain, round(c1 - c0, 9) AS coverage_gain, CASE WHEN r1 - r0 > 1e-12 THEN 'recall' WHEN m1 < m0 THEN 'fewer missed' WHEN abs(r1 - r0) <= 1e-12 AND c1 > c0 + 1e-12 THEN 'coverage' ELSE 'not earned' END AS earned_by FROM g""",
    "symbol_hints": f"""WITH {CODE}, f AS (SELECT file_id, path, path IN ('src/index.py', 'src/UserCard') AS selected, unnest(classes || functions) AS symbol FROM code), h AS (SELECT *, {_HITS['symbol']} AS s, {_HITS['path']} AS p, {_EITHER} AS m FROM f),
c AS (SELECT *, CASE WHEN selected AND s >= 2 THEN 0 WHEN selected AND s > 0 THEN 1 WHEN selected THEN 2 WHEN m >= 2 THEN 3 WHEN m = 1 THEN 4 ELSE 5 END AS rank,
  CASE WHEN selected AND s >= 2 THEN 500 + 70 * s + 10 * p WHEN selected AND s > 0 THEN 400 + 60 * s + 8 * p WHEN selected AND p > 0 THEN 300 + 20 * p WHEN selected THEN 280 WHEN m >= 2 THEN 220 + 60 * s + 10 * p WHEN m = 1 THEN 140 + 40 * s + 5 * p ELSE 0 END AS score FROM h),
t AS (SELECT * FROM c WHERE rank < 5 QUALIFY row_number() OVER (PARTITION BY file_id ORDER BY rank, score DESC, path, symbol) <= 2)
SELECT file_id, symbol, rank::BIGINT AS rank, score::BIGINT AS score, row_number() OVER (ORDER BY rank, score DESC, path, symbol, file_id) AS place FROM t QUALIFY place <= 40""",
    "workspace_relevance": """WITH s AS (SELECT s_suppkey, s_acctbal, string_split(lower(regexp_replace(s_name, '[^A-Za-z0-9]+', ' ', 'g') || ' ' || regexp_replace(n_name, '[^A-Za-z0-9]+', ' ', 'g')), ' ') AS w FROM supplier JOIN nation ON s_nationkey = n_nationkey),
r AS (SELECT s_suppkey, (10 * len(list_intersect(['nation', 'supplier', '7', '12'], w)) + CASE WHEN s_acctbal > 0 THEN 5 ELSE 0 END)::BIGINT AS score, greatest(count(*) OVER () - 12, 0) AS omitted FROM s)
SELECT s_suppkey, score, row_number() OVER (ORDER BY score DESC, s_suppkey) AS place, omitted FROM r QUALIFY place <= 12""",
    "snippet_budget": """WITH RECURSIVE d AS (SELECT source, doc_id, least(ceil(length(coalesce(text, '')) / 3.3::DOUBLE), 300)::BIGINT AS tokens, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS place FROM documents),
f AS (SELECT source, 0::BIGINT AS place, 0::BIGINT AS used, NULL::BIGINT AS doc_id, 0::BIGINT AS tokens, false AS admitted FROM (SELECT DISTINCT source FROM d)
  UNION ALL SELECT d.source, d.place, CASE WHEN used + d.tokens <= 900 THEN used + d.tokens ELSE used END, d.doc_id, d.tokens, used + d.tokens <= 900 FROM f JOIN d ON d.source = f.source AND d.place = f.place + 1)
SELECT source, doc_id, tokens FROM f WHERE admitted""",
    "budget_downgrade": """WITH s AS (SELECT s_nationkey, s_suppkey, s_suppkey % 7 * 40 + 60 AS tokens FROM supplier), t AS (SELECT *, sum(tokens) OVER (PARTITION BY s_nationkey) AS whole FROM s),
x AS (SELECT *, CASE WHEN step = 1 THEN tokens - tokens // 2 ELSE tokens // 2 - tokens // 8 END AS saved FROM t, (VALUES (1), (2)) v(step)),
l AS (SELECT *, whole - coalesce(sum(saved) OVER (PARTITION BY s_nationkey ORDER BY step, tokens DESC, s_suppkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS tokens_before FROM x)
SELECT s_nationkey, s_suppkey, step::BIGINT AS step, saved::BIGINT AS saved, tokens_before::BIGINT AS tokens_before FROM l WHERE tokens_before > 100""",
    "library_probe": f"""WITH {CODE}, w AS (SELECT library, count(*) AS uses FROM (SELECT unnest(functions) AS library FROM code) GROUP BY 1),
f AS (SELECT functions[1] AS library, CASE WHEN starts_with(path, 'node_modules') AND ends_with(path, '.ts') THEN 0 WHEN starts_with(path, 'vendor') THEN 1 WHEN ends_with(path, '.key') THEN 2 WHEN starts_with(path, 'node_modules') THEN 3 END AS rank, path FROM code),
b AS (SELECT * FROM f WHERE rank IS NOT NULL QUALIFY row_number() OVER (PARTITION BY library ORDER BY rank, path) = 1)
SELECT library, uses, coalesce(['declarations', 'vendored', 'archive', 'opaque'][rank + 1], 'missing') AS kind, path FROM w LEFT JOIN b USING (library)""",
    "route_risks": f"""WITH {CODE}, {_resolution_sql("code", PATTERNS, "res")}, lost AS (SELECT file_id, count(*) AS n, bool_or(regexp_matches(imported, '^\\.\\.?/')) AS near FROM res WHERE status = 'unresolved' GROUP BY 1)
SELECT file_id, len(routes) AS n_routes, coalesce(n, 0) AS n_unresolved, CASE WHEN near THEN 'high' WHEN n > 0 THEN 'medium' ELSE 'low' END AS risk FROM code LEFT JOIN lost USING (file_id) WHERE len(routes) > 0""",
    "workflow_states": """WITH c AS (SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS prev FROM conversations),
g AS (SELECT conv_id, arg_min(role, turn) AS first, arg_max(role, turn) AS last, count(*) AS n, count(*) FILTER (prev = role) AS repeats, count(*) FILTER (coalesce(length(text), 0) = 0) AS empty FROM c GROUP BY 1),
i AS (SELECT *, list_filter([CASE WHEN NOT coalesce(lower(first) IN ('user', 'system'), false) THEN 'start' END, CASE WHEN repeats > 0 THEN 'repeated' END, CASE WHEN empty > 0 THEN 'empty' END, CASE WHEN n % 2 = 1 THEN 'odd' END], lambda x: x IS NOT NULL) AS issues FROM g)
SELECT conv_id, array_to_string(issues, ',') AS issues, CASE WHEN list_contains(issues, 'empty') THEN 'stop' WHEN last = 'user' THEN 'answer' WHEN len(issues) > 0 THEN 'review' ELSE 'done' END AS action FROM i""",
    "related_edges": f"""WITH {_FILES}, {_EDGES}, m AS (SELECT file_id FROM scored WHERE cheap_score >= 6), e AS (SELECT DISTINCT source, target FROM priced),
r AS (SELECT DISTINCT target AS node, 'inside' AS direction FROM e WHERE source IN (SELECT file_id FROM m) AND target IN (SELECT file_id FROM m) UNION SELECT DISTINCT target, 'out' FROM e WHERE source IN (SELECT file_id FROM m) AND target NOT IN (SELECT file_id FROM m) UNION SELECT DISTINCT source, 'in' FROM e WHERE target IN (SELECT file_id FROM m) AND source NOT IN (SELECT file_id FROM m))
SELECT direction, count(*) AS n, min(node) AS first FROM r GROUP BY 1""",
}

QUERIES = {f.__name__: f for f in (
    backend_symbols, probe_ranking, starting_files, path_lookup, repository_matches, unresolved_relations, journey_checks, bounded_diagnostics, status_summaries, resolution_merge, role_assessments,
    representation_order, budget_values, byte_capped_probe, component_summary, call_trace, selected_sources, config_values, redacted_configs, related_edges,
    diff_verification, strategy_costs, symbol_hints, workspace_relevance, snippet_budget, budget_downgrade, library_probe, workflow_states, route_risks,
)}
