"""Queries on files, terms, scores and rankings over the stand-in tables of source code, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import paths as X
from ..functions import predicates as P
from ..functions import relevance as R
from ..operators import taskindex
from .code_tables import CODE, PATHS, SQL_TOKENS, code_files, sql_distinct, sql_list, sql_terms

TASKS = (
    "Add a login form to the user page",
    "Fix failing test of the api client route",
    "Update styles of the cart store schema in python",
    "refactor HTTP server config",
)
SELECTED = ("src/index.py", "src/pages/main.ts")
SHOWN = 10


def path_predicates(spark, sf_dir):
    """Every predicate and class of a path."""
    p = F.col("path")
    return code_files(spark, sf_dir).select(
        "file_id", "path", X.extension(p).alias("extension"), X.is_ignored_path(p).alias("is_ignored"), P.is_test_path(p).alias("is_test"), X.is_matching_test(p).alias("is_matching_test"),
        P.is_generated_path(p).alias("is_generated"), P.folder_role(p).alias("folder_role"), X.language(p).alias("language"), X.is_secret_path(p).alias("is_secret"),
        X.frontend_role(p).alias("frontend_role"), X.extension(p).isin(*X.SCRIPT_EXTENSIONS, *X.TEMPLATE_EXTENSIONS, *X.STYLE_EXTENSIONS, *X.ASSET_EXTENSIONS).alias("is_frontend"),
        P.bins(F.col("size"), {"small": 100, "medium": 1000, "large": 5000}, "very_large").alias("size_class"),
    )


_ROLE_SQL = "CASE " + " ".join(f"WHEN list_has_any(low, {sql_list(v)}) THEN '{k}'" for k, v in P.FOLDER_ROLES.items()) + " WHEN len(seg) = 1 THEN 'root' ELSE 'other' END"
_IS_TEST = f"(list_has_any(low, {sql_list(P.TEST_FOLDERS)}) OR regexp_matches(lower(stem), '^test_|_test$|\\.test$|\\.spec$'))"
_GENERATED = f"(list_has_any(low, {sql_list(P.GENERATED_FOLDERS + P.VENDOR_FOLDERS)}) OR list_contains({sql_list(P.LOCKFILES)}, lower(name)) OR contains(lower(name), '.min.') OR contains(lower(name), '.generated.') OR regexp_matches(lower(stem), '_generated$|_pb2$|\\.designer$|\\.g$'))"
_MATCHING_TEST = "(regexp_matches(lower(path), '^tests/|/tests/|\\.(test|spec)\\.') OR regexp_matches(lower(stem), '^test_|\\.(test|spec)$'))"
_KIND = f"CASE WHEN list_contains({sql_list(X.TEMPLATE_EXTENSIONS)}, ext) THEN 'template' WHEN list_contains({sql_list(X.STYLE_EXTENSIONS)}, ext) THEN 'style' END"
_FRONT = sql_list((*X.SCRIPT_EXTENSIONS, *X.TEMPLATE_EXTENSIONS, *X.STYLE_EXTENSIONS, *X.ASSET_EXTENSIONS))


def _front_sql() -> str:
    words = SQL_TOKENS.format("stem")
    steps = []
    for role, names in X.FRONTEND_FOLDERS.items():
        hit = f"list_has_any(low, {sql_list(names)})"
        if role in X.FRONTEND_TOKENS:
            hit += f" OR list_has_any({words}, {sql_list(X.FRONTEND_TOKENS[role])})"
        hit += {"hook": " OR (starts_with(lower(stem), 'use') AND NOT starts_with(lower(stem), 'user'))", "component": " OR ext IN ('jsx', 'tsx')"}.get(role, "")
        steps.append(f"WHEN {hit} THEN '{role}'")
    return f"""CASE WHEN NOT list_contains({_FRONT}, ext) THEN 'unknown' WHEN regexp_matches(lower(stem), '^test[._-]|[._-](test|spec)$') OR list_has_any(low, {sql_list(X.FRONTEND_TEST_FOLDERS)}) THEN 'test'
  WHEN contains(lower(name), '.config.') OR list_contains({sql_list(X.CONFIG_STEMS)}, lower(stem)) THEN 'config' WHEN list_contains({sql_list(X.ASSET_EXTENSIONS)}, ext) OR list_has_any(low, {sql_list(X.ASSET_FOLDERS)}) THEN 'asset'
  WHEN contains(lower(name), '.component.') THEN coalesce({_KIND}, 'component') WHEN regexp_matches(lower(name), '\\.(service|guard|resolver)\\.') THEN 'service'
  WHEN contains(lower(name), '.routes.') OR contains(lower(name), 'routing.module.') THEN 'route' {" ".join(steps)} ELSE coalesce({_KIND}, 'unknown') END"""


_LANGUAGE = (
    "coalesce(MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in X.NAME_LANGUAGES.items()) + "}[lower(name)], MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in X.EXTENSION_LANGUAGES.items()) + "}[ext])"
)


def path_terms(spark, sf_dir):
    """Terms, names and module names of paths, joined by spaces."""
    p = F.col("path")
    said = lambda c: F.array_join(c, " ")
    first = F.try_element_at(F.col("imports"), F.lit(1))
    return code_files(spark, sf_dir).select(
        "file_id", said(X.stem_tokens(p)).alias("stem_tokens"), said(X.folder_tokens(p)).alias("folder_tokens"), said(X.identifier_terms(p)).alias("terms"), X.plain_text(p).alias("plain"),
        X.module_name(p).alias("module"), X.same_folder_module(p, F.lit("helper")).alias("sibling"), X.package_root(first).alias("package"), X.is_relative_import(first).alias("is_relative"),
        X.is_relative_path(F.when(F.col("file_id") % 5 == 0, F.concat(F.lit("../"), p)).when(F.col("file_id") % 7 == 0, F.concat(F.lit(" "), p)).when(F.col("file_id") % 11 == 0, F.concat(F.lit("/"), p)).otherwise(p)).alias("is_relative_path"),
        X.directory_distance(X.folders(p), F.array(F.lit("SRC"), F.lit("pages"))).cast("long").alias("distance"), X.directory_proximity(X.folders(p), F.array(F.lit("src"), F.lit("components"))).cast("long").alias("proximity"),
        X.contains_run(X.identifier_terms(p), F.array(F.lit("user"), F.lit("service"))).alias("has_user_service"),
    )


def described_files(spark, sf_dir) -> DataFrame:
    """Files with what the scores ask for, ``bag`` and ``roles`` among it."""
    f = code_files(spark, sf_dir)
    said = F.flatten(F.transform("routes", lambda r: F.array(r["method"], r["path"], r["source"])))
    f = f.withColumns({"symbols": F.concat("classes", "functions"), "said": said})
    return R.described(f, "path", "symbols", "imports", "said").withColumn("roles", X.file_roles(F.col("path"), F.size("routes")))


def file_bags(spark, sf_dir):
    """The bag of terms and the roles of each file."""
    return described_files(spark, sf_dir).select("file_id", F.array_join("bag", " ").alias("bag"), F.array_join("roles", " ").alias("roles"))


def tasks(spark) -> DataFrame:
    return spark.createDataFrame(list(enumerate(TASKS)), "task long, text string")


def task_ranking(spark, sf_dir):
    """For each task the selected files, then the best others; the three best if no file is a confident match."""
    asked = tasks(spark)
    selected = asked.select("task", F.explode(F.array(*[F.lit(p) for p in SELECTED])).alias("path"))
    scores = taskindex.file_scores(spark, asked, described_files(spark, sf_dir), selected=selected)
    return taskindex.rank_files(scores, SHOWN).withColumn("place", F.col("place").cast("long"))


def task_scores(spark, sf_dir):
    """The relevance, the matches and the cheap and brief scores of every file for every task."""
    f = described_files(spark, sf_dir)
    columns = {}
    for i, task in enumerate(TASKS):
        columns[f"relevance_{i}"] = R.task_relevance(task, F.col("path"), F.col("roles")).cast("long")
        columns[f"matched_{i}"] = F.array_join(R.matched_terms(task), " ")
        columns[f"candidate_{i}"] = R.candidate_score(task).cast("long")
        columns[f"brief_{i}"] = R.brief_score(R.task_terms(task), F.col("path"), F.col("classes"), F.col("functions"), ("user",)).cast("long")
    return f.select("file_id", *[c.alias(k) for k, c in columns.items()])


def candidate_ranking(spark, sf_dir):
    """Candidates by value for each task: a shortlist with its place, and how many files there were."""
    f = described_files(spark, sf_dir)
    cost = P.analysis_cost(F.col("size"), F.col("is_test"), F.col("is_generated") | F.col("place").isin("generated", "vendor"))
    f = f.withColumn("cost", cost)
    considered = f.agg(F.count("*").alias("considered")).scalar()
    out = None
    for i, task in enumerate(TASKS):
        one = f.select("file_id", "path", R.candidate_score(task).cast("long").alias("score"), "cost")
        one = one.withColumn("value", P.value_score(F.col("score"), F.col("cost")))
        order = [F.desc("value"), F.desc("score"), F.col("cost"), F.lower("path"), F.col("file_id")]
        best = one.orderBy(*order).limit(25).withColumn("place", F.row_number().over(Window.orderBy(*order)).cast("long"))
        one = best.withColumn("considered", considered).select(F.lit(i).cast("long").alias("task"), "place", "file_id", "score", "cost", "value", "considered", (F.col("considered") > 25).alias("truncated"))
        out = one if out is None else out.unionByName(one)
    return out


def route_ranking(spark, sf_dir):
    """Routes of the files, best first for each task; files with a match in their path are the relevant ones."""
    f = code_files(spark, sf_dir).select("file_id", "path", F.explode("routes").alias("r"))
    out = None
    for i, task in enumerate(TASKS):
        terms = R.task_terms(task)
        relevant = F.coalesce(F.lit(False), F.lit(False))
        for t in terms:
            relevant = relevant | X.plain_text(F.col("path")).contains(t)
        one = f.withColumn("score", R.route_score(terms, relevant, F.col("r.path"), F.col("path"), F.col("r.method"), F.col("r.source"))).where("score > 0")
        order = [F.desc("score"), F.col("r.path"), F.col("r.method"), F.col("path"), F.col("file_id")]
        best = one.orderBy(*order).limit(8).withColumn("place", F.row_number().over(Window.orderBy(*order)).cast("long"))
        one = best.select(F.lit(i).cast("long").alias("task"), "place", "file_id", F.col("r.method").alias("method"), F.col("r.path").alias("route"), F.col("score").cast("long").alias("score"))
        out = one if out is None else out.unionByName(one)
    return out


def reference_matches(spark, sf_dir):
    """For each reference the best file, the margin to the second and whether it is taken without asking."""
    f = code_files(spark, sf_dir).select("file_id", "path").groupBy("path").agg(F.min("file_id").alias("file_id"))
    out = None
    for i, reference in enumerate(REFERENCES):
        one = f.select("file_id", "path", R.reference_score(reference, F.col("path")).cast("long").alias("score"))
        order = [F.desc("score"), F.size(F.split("path", "/")), F.char_length("path"), F.col("path")]
        top = one.orderBy(*order).limit(2)
        w = Window.orderBy(*order)
        top = top.withColumns({"second": F.lead("score").over(w), "place": F.row_number().over(w)}).where("place = 1")
        one = top.select(F.lit(i).cast("long").alias("reference"), "file_id", "path", "score", "second", R.can_auto_resolve(F.col("score"), F.col("second"), F.lit(1) + F.col("second").isNotNull().cast("int")).alias("resolved"))
        out = one if out is None else out.unionByName(one)
    return out


REFERENCES = ("src/index.py", "useAuth", "userservice", "UserCard.jsx", "api/api_client", "usercard.tsx", "models/orderModel.ts", "HTTPServer config", "zzz")


# --- SQL

_PLAIN = "lower(translate({0}, '\\_-', '/  '))"
_DESCRIBED = f"""{PATHS},
said AS (SELECT *, classes || functions AS symbols, flatten(list_transform(routes, lambda r: [r.method, r.path, r.source])) AS ways, {_LANGUAGE} AS language FROM paths),
bags AS (SELECT *, {sql_terms("path")} AS own_terms, flatten(list_transform([path] || CASE WHEN language IS NULL THEN [] ELSE [language] END || symbols || imports || ways, lambda t: {sql_terms("t")})) AS every FROM said),
described AS (SELECT *, {sql_distinct("every")} AS bag,
  list_filter([CASE WHEN {_MATCHING_TEST} THEN 'test' END, CASE WHEN regexp_matches(lower(path), '\\.(css|scss|sass|less|styl)$') OR list_has_any(own_terms, ['style', 'styles']) THEN 'style' END,
    CASE WHEN list_contains(own_terms, 'middleware') THEN 'middleware' END, CASE WHEN list_contains(own_terms, 'controller') THEN 'controller' END, CASE WHEN list_contains(own_terms, 'service') THEN 'service' END,
    CASE WHEN list_has_any(own_terms, ['model', 'schema', 'entity', 'entities', 'migration', 'migrations']) THEN 'model' END,
    CASE WHEN list_contains(own_terms, 'config') OR regexp_matches(lower(path), '\\.config\\.(js|jsx|ts|tsx|py|json)$') THEN 'config' END,
    CASE WHEN len(routes) > 0 OR list_has_any(own_terms, ['route', 'routes']) THEN 'route' END,
    CASE WHEN (list_contains(own_terms, 'pages') AND list_has_any(own_terms, ['page', 'index', 'home', 'landing'])) OR (list_has_any(own_terms, ['app', 'pages']) AND lower(stem) IN ('page', 'index')) THEN 'page' END,
    CASE WHEN list_has_any(own_terms, ['component', 'components', 'ui']) OR ends_with(lower(stem), 'component') OR (regexp_matches(lower(path), '\\.[jt]sx$') AND regexp_matches(name, '^[A-Z]')) THEN 'component' END,
    CASE WHEN starts_with(stem, 'use') AND length(stem) > 3 AND regexp_matches(lower(path), '\\.[jt]sx?$') THEN 'hook' END], lambda x: x IS NOT NULL) AS roles FROM bags)"""


def _any(values: str, term: str) -> str:
    return f"len(list_filter({values}, lambda v: contains({_PLAIN.format('v')}, '{term}'))) > 0"


def _relevance_sql(task: str) -> str:
    terms, hints = R.task_terms(task), R.task_hints(task)
    wide = R.expanded_terms(terms)
    whole, own = _PLAIN.format("path"), _PLAIN.format("name")
    score = []
    for t in wide:
        score.append(f"CASE WHEN contains({own}, '{t}') THEN 6 WHEN contains({whole}, '{t}') THEN 4 ELSE 0 END")
        score.append(f"3 * list_contains(bag, '{t}')::INT + 2 * ({_any('symbols', t)})::INT + ({_any('imports', t)})::INT + 3 * ({_any('ways', t)})::INT")
    for p in R.task_phrases(terms):
        score.append(f"CASE WHEN contains(array_to_string(bag, ' '), '{p}') THEN {4 + len(p.split())} ELSE 0 END")
        score.append(f"5 * (len(list_filter([{whole}, {own}] || list_transform(ways, lambda v: {_PLAIN.format('v')}), lambda v: contains(v, '{p}') OR contains(replace(v, ' ', ''), '{p.replace(' ', '')}'))) > 0)::INT")
    shared = f"len(list_intersect(bag, {sql_list(wide)}))"
    score.append(f"CASE WHEN {shared} >= 2 THEN 2 * {shared} ELSE {shared} END + 4 * len(list_intersect(bag, {sql_list(terms)}))")
    score += [f"{points} * list_contains(roles, '{role}')::INT" for role, hint, points in R.ROLE_BONUS if hints[hint]]
    if "hook" in terms or hints["frontend_ui"]:
        score.append("7 * list_contains(roles, 'hook')::INT")
    total = "(" + " + ".join(score) + ")"
    if not hints["tests"]:
        total = f"CASE WHEN list_contains(roles, 'test') THEN greatest({total} - 15, 1) ELSE {total} END"
    if not (hints["tests"] or hints["styles"]):
        total = f"CASE WHEN regexp_matches(lower(path), '{R.SUPPORT_FILE}') THEN greatest({total} - 12, 1) ELSE {total} END"
    return total


def _matched_sql(task: str) -> str:
    texts = "[path] || symbols || imports || ways"
    return "list_filter([" + ", ".join(f"CASE WHEN {_any(f'({texts})', t)} THEN '{t}' END" for t in R.task_terms(task)) + "], lambda x: x IS NOT NULL)"


def _candidate_sql(task: str) -> str:
    words = R.task_words(task, R.CANDIDATE_STOP_WORDS)
    have = set(words)
    stem, above = SQL_TOKENS.format("stem"), f"flatten(list_transform(above, lambda f: {SQL_TOKENS.format('f')}))"
    score = [f"CASE WHEN list_contains({stem}, '{w}') THEN 6 WHEN list_contains({above}, '{w}') THEN 3 ELSE 0 END" for w in words]
    score += [f"{2 if r in have else 1} * (list_contains({stem}, '{r}') OR list_contains({above}, '{r}'))::INT" for r in R.ROLE_WORDS if r not in R.TEST_WORDS]
    if have & set(R.FRONTEND_WORDS):
        score += [f"{4 if have & set(names) else 2} * (front = '{r}')::INT" for r, names in R.FRONTEND_ROLE_WORDS.items()]
    score.append(f"CASE WHEN list_contains({sql_list(words)}, place_role) AND place_role <> 'test' THEN 3 WHEN place_role = 'source' THEN 1 ELSE 0 END")
    spoken = [k for k, v in {**{v: (v,) for v in X.EXTENSION_LANGUAGES.values()}, **R.LANGUAGE_ALIASES}.items() if have & set(v)]
    if spoken:
        score.append(f"2 * coalesce(list_contains({sql_list(spoken)}, {_LANGUAGE}), false)::INT")
    score.append(f"2 * list_contains({sql_list(words)}, ext)::INT + {8 if have & set(R.TEST_WORDS) else -12} * {_IS_TEST}::INT - 100 * ({_GENERATED} OR place_role IN ('generated', 'vendor'))::INT")
    return " + ".join(score)


_PLACED = f"placed AS (SELECT *, {_front_sql()} AS front, {_ROLE_SQL} AS place_role FROM described)"


def _brief_sql(task: str) -> str:
    words = R.task_terms(task)
    whole, own = _PLAIN.format("path"), _PLAIN.format("name")
    score = [f"5 * contains({whole}, '{w}')::INT + 4 * contains({own}, '{w}')::INT" for w in words] + [f"8 * (name = 'cli.py')::INT" for w in ("command", "commands", "cli") if w in words]
    for values, points in (("classes", 3), ("functions", 3), ("imports", 1)):
        score += [f"{points} * len(list_filter({values}, lambda v: contains({_PLAIN.format('v')}, '{w}')))" for w in words if w != "user"]
    return "(" + " + ".join(score) + ")::BIGINT"


def _ranking_sql() -> str:
    parts = []
    for i, task in enumerate(TASKS):
        asks = str(R.task_hints(task)["tests"]).lower()
        parts.append(f"SELECT {i} AS task, *, list_contains(roles, 'test') AND NOT {asks} AS last, ({_relevance_sql(task)}) AS score, len({_matched_sql(task)}) AS matched FROM described")
    sure = f"CASE WHEN matched >= 2 THEN 'high' WHEN matched = 1 OR (score >= 12 AND list_has_any(roles, {sql_list(R.CONFIDENT_ROLES)})) THEN 'medium' ELSE 'low' END"
    return f"""WITH {_DESCRIBED}, scored AS ({" UNION ALL ".join(parts)}),
sure AS (SELECT task, file_id, path, last, score, {sure} AS confidence, list_contains({sql_list(SELECTED)}, path) AS selected, matched FROM scored WHERE score > 0 OR list_contains({sql_list(SELECTED)}, path)),
fitting AS (SELECT *, selected OR confidence <> 'low' OR matched > 0 AS fits FROM sure),
placed AS (SELECT *, row_number() OVER (PARTITION BY task ORDER BY selected DESC, fits DESC, last, score DESC, path, file_id) AS place, bool_or(fits) OVER (PARTITION BY task) AS any_fit FROM fitting)
SELECT task::BIGINT AS task, place, file_id, path, score::BIGINT AS score, confidence FROM placed WHERE place <= {SHOWN} AND (fits OR (NOT any_fit AND place <= 3))"""


def _candidates_sql() -> str:
    parts = [f"SELECT {i} AS task, file_id, path, ({_candidate_sql(task)})::BIGINT AS score, cost FROM costed" for i, task in enumerate(TASKS)]
    generated = f"({_GENERATED} OR place_role IN ('generated', 'vendor'))"
    cost = f"(CASE WHEN size <= 16384 THEN 1 WHEN size <= 131072 THEN 2 WHEN size <= 524288 THEN 4 WHEN size <= 2097152 THEN 8 ELSE 16 END + {_IS_TEST}::INT + 20 * {generated}::INT)::BIGINT"
    return f"""WITH {_DESCRIBED}, {_PLACED}, costed AS (SELECT *, {cost} AS cost FROM placed), scored AS ({" UNION ALL ".join(parts)}),
valued AS (SELECT *, CASE WHEN score >= 0 THEN round_even(score / cost, 6) ELSE (score * cost)::DOUBLE END AS value FROM scored),
ranked AS (SELECT *, row_number() OVER (PARTITION BY task ORDER BY value DESC, score DESC, cost, lower(path), file_id) AS place, count(*) OVER (PARTITION BY task) AS considered FROM valued)
SELECT task::BIGINT AS task, place, file_id, score, cost, value, considered, considered > 25 AS truncated FROM ranked WHERE place <= 25"""


def _routes_sql() -> str:
    parts = []
    for i, task in enumerate(TASKS):
        terms = R.task_terms(task)
        relevant = " OR ".join(f"contains({_PLAIN.format('path')}, '{t}')" for t in terms) or "false"
        score = " + ".join([f"10 * ({relevant})::INT"] + [f"4 * contains({_PLAIN.format('r.path')}, '{t}')::INT + 2 * contains(path, '{t}')::INT + 5 * (lower(r.method) = '{t}')::INT + contains({_PLAIN.format('r.source')}, '{t}')::INT" for t in terms])
        parts.append(f"SELECT {i} AS task, file_id, path, r, ({score})::BIGINT AS score FROM ways")
    return f"""WITH {CODE}, ways AS (SELECT file_id, path, unnest(routes) AS r FROM code), scored AS ({" UNION ALL ".join(parts)}),
ranked AS (SELECT *, row_number() OVER (PARTITION BY task ORDER BY score DESC, r.path, r.method, path, file_id) AS place FROM scored WHERE score > 0)
SELECT task::BIGINT AS task, place, file_id, r.method AS method, r.path AS route, score FROM ranked WHERE place <= 8"""


def _references_sql() -> str:
    import re

    parts = []
    for i, reference in enumerate(REFERENCES):
        norm = re.sub("/+", "/", reference.replace("\\", "/"))
        low, apart = norm.lower(), "/" in norm
        own = [t.lower() for t in re.findall(r"[A-Z]+(?=[A-Z][a-z]|[0-9]|[^A-Za-z0-9]|$)|[A-Z]?[a-z]+|[0-9]+", reference)]
        own = list(dict.fromkeys(t for t in own if len(t) > 1 and t not in X.IDENTIFIER_STOP_WORDS))
        n, said = len(own), sql_list(own) + "::VARCHAR[]"
        shared = f"len(list_intersect(terms, {said}))"
        run = f"{n} >= 2 AND len(list_filter(range(1, len(terms) - {n} + 2), lambda j: terms[j:j + {n} - 1] = {said})) > 0"
        tiers = [f"WHEN lower(path) = '{low}' THEN 1000"]
        if apart:
            tiers.append(f"WHEN contains(lower(path), '{low}') THEN {850 + 10 * len([x for x in low.split('/') if x])}")
        else:
            tiers += [f"WHEN name = '{reference}' THEN 950", f"WHEN stem = '{reference}' THEN 925", f"WHEN lower(name) = '{low}' THEN 800", f"WHEN lower(stem) = '{low}' THEN 780"]
        tiers += [f"WHEN {run} THEN 775 + 10 * {n}", f"WHEN {shared} > 0 THEN 650 + 20 * {shared}"]
        fuzzy = f"100 + floor((1 - levenshtein('{low}', lower(path)) / greatest({len(low)}, length(path))::DOUBLE) * 100)::INT"
        bonus = f"CASE WHEN lower(path) <> '{low}' AND contains(lower(path), '{low}') THEN {min(25, max(5, 8 * len(norm.split('/'))))} ELSE 0 END"
        parts.append(f"SELECT {i} AS reference, file_id, path, (CASE {' '.join(tiers)} ELSE {fuzzy} END + {bonus} - (len(seg) - 1) - length(path) // 50 - 35 * {_MATCHING_TEST}::INT)::BIGINT AS score FROM termed")
    return f"""WITH {PATHS}, firsts AS (SELECT * FROM paths QUALIFY row_number() OVER (PARTITION BY path ORDER BY file_id) = 1), termed AS (SELECT *, list_distinct({sql_terms("path")}) AS unordered, {sql_distinct(sql_terms("path"))} AS terms FROM firsts),
scored AS ({" UNION ALL ".join(parts)}),
ranked AS (SELECT *, lead(score) OVER w AS second, row_number() OVER w AS place FROM scored WINDOW w AS (PARTITION BY reference ORDER BY score DESC, len(string_split(path, '/')), length(path), path))
SELECT reference::BIGINT AS reference, file_id, path, score, second, CASE WHEN second IS NULL THEN score >= 650 ELSE (score >= 850 AND score - second >= 20) OR (score >= 700 AND score - second >= 80) END AS resolved FROM ranked WHERE place = 1"""


_IGNORED = f"(len(list_filter(low, lambda x: list_contains({sql_list(X.IGNORED_FOLDERS)}, x) OR ends_with(x, '.egg-info'))) > 0 OR list_contains({sql_list(X.IGNORED_FILES)}, lower(name)) OR starts_with(lower(name), '.coverage'))"
_SECRET = f"(list_contains(low || [lower(name)], '.ssh') OR list_contains({sql_list(X.SECRET_FILES)}, lower(name)) OR regexp_matches(lower(name), '^(\\.env|secret\\.|secrets\\.)|\\.(key|pem)$'))"
_ODD = "CASE WHEN file_id % 5 = 0 THEN '../' || path WHEN file_id % 7 = 0 THEN ' ' || path WHEN file_id % 11 = 0 THEN '/' || path ELSE path END"
_COMMON = "(SELECT coalesce(max(n), 0) FROM (SELECT unnest(range(0, 3)) AS n) WHERE n <= len({a}) AND {a}[1:n] = {b}[1:n] AND n <= len({b}))"

SQL = {
    "path_predicates": f"""WITH {PATHS} SELECT file_id, path, ext AS extension, {_IGNORED} AS is_ignored, {_IS_TEST} AS is_test, {_MATCHING_TEST} AS is_matching_test, {_GENERATED} AS is_generated, {_ROLE_SQL} AS folder_role,
  {_LANGUAGE} AS language, {_SECRET} AS is_secret, {_front_sql()} AS frontend_role, list_contains({_FRONT}, ext) AS is_frontend,
  CASE WHEN size <= 100 THEN 'small' WHEN size <= 1000 THEN 'medium' WHEN size <= 5000 THEN 'large' ELSE 'very_large' END AS size_class FROM paths""",
    "path_terms": f"""WITH {PATHS}, t AS (SELECT *, {SQL_TOKENS.format("stem")} AS st, flatten(list_transform(above, lambda f: {SQL_TOKENS.format("f")})) AS ft, {sql_terms("path")} AS terms FROM paths),
u AS (SELECT *, {sql_distinct("terms")} AS own, {_COMMON.format(a="low", b="['src', 'pages']")} AS near, {_COMMON.format(a="above", b="['src', 'components']")} AS shared FROM t)
SELECT file_id, array_to_string({sql_distinct("st")}, ' ') AS stem_tokens, array_to_string({sql_distinct("ft")}, ' ') AS folder_tokens, array_to_string(own, ' ') AS terms, {_PLAIN.format("path")} AS plain,
  array_to_string(above || [stem], '.') AS module, array_to_string(above || ['helper.py'], '/') AS sibling,
  CASE WHEN starts_with(imports[1], '@') THEN array_to_string(string_split(imports[1], '/')[1:2], '/') ELSE string_split(imports[1], '/')[1] END AS package,
  regexp_matches(imports[1], '^\\.\\.?/') AS is_relative, NOT (file_id % 5 = 0 OR file_id % 7 = 0 OR file_id % 11 = 0) AS is_relative_path,
  (len(low) + 2 - 2 * near)::BIGINT AS distance, CASE WHEN above = ['src', 'components'] THEN 80 ELSE least(45, 15 * shared) END::BIGINT AS proximity,
  len(list_filter(range(1, len(own)), lambda j: own[j] = 'user' AND own[j + 1] = 'service')) > 0 AS has_user_service FROM u""",
    "file_bags": f"WITH {_DESCRIBED} SELECT file_id, array_to_string(bag, ' ') AS bag, array_to_string(roles, ' ') AS roles FROM described",
    "task_scores": f"WITH {_DESCRIBED}, {_PLACED} SELECT file_id, "
    + ", ".join(
        f"({_relevance_sql(t)})::BIGINT AS relevance_{i}, array_to_string({_matched_sql(t)}, ' ') AS matched_{i}, ({_candidate_sql(t)})::BIGINT AS candidate_{i}, {_brief_sql(t)} AS brief_{i}" for i, t in enumerate(TASKS)
    )
    + " FROM placed",
    "task_ranking": _ranking_sql(),
    "candidate_ranking": _candidates_sql(),
    "route_ranking": _routes_sql(),
    "reference_matches": _references_sql(),
}

QUERIES = {f.__name__: f for f in (path_predicates, path_terms, file_bags, task_scores, task_ranking, candidate_ranking, route_ranking, reference_matches)}
