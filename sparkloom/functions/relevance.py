"""Scores of files, routes and references for a task, as native columns.

A task is a plain string, so its terms are literals of the plan; files are rows of any number.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import paths as X
from . import predicates as P
from .text import TASK_STOP_WORDS

# fixed values: words of tasks, and what they hint at
CANDIDATE_STOP_WORDS = ("a", "add", "an", "and", "are", "as", "at", "be", "bug", "by", "change", "create", "fix", "for", "from", "implement", "in", "into", "is", "it", "of", "on", "or", "refactor", "remove", "the", "to", "update", "with")
TASK_HINTS = {
    "frontend_ui": ("button", "card", "component", "dashboard", "form", "hook", "home", "landing", "navbar", "page", "profile", "screen", "ui", "view"),
    "backend_api": ("api", "controller", "endpoint", "request", "response", "route", "server"),
    "tests": ("fail", "failed", "failing", "spec", "test", "tests"),
    "data_model": ("database", "db", "migration", "model", "schema"),
    "styles": ("css", "layout", "less", "sass", "scss", "style", "styles", "styling"),
}
TASK_SYNONYMS = {
    "api": ("endpoint", "route"), "auth": ("login", "session", "token"), "button": ("click", "handler", "onclick"), "db": ("database",),
    "endpoint": ("api", "route"), "form": ("input", "submit", "validation"), "home": ("index", "landing"), "landing": ("home", "index"),
    "page": ("screen", "view"), "screen": ("page", "view"),
}
ROLE_BONUS = (("page", "frontend_ui", 6), ("component", "frontend_ui", 3), ("route", "backend_api", 7), ("controller", "backend_api", 5), ("service", "backend_api", 4), ("test", "tests", 6), ("style", "styles", 6), ("model", "data_model", 5), ("config", "data_model", 2))
ROLE_WORDS = ("api", "client", "component", "controller", "hook", "model", "page", "route", "routes", "schema", "service", "spec", "store", "test", "view")
TEST_WORDS = ("spec", "specs", "test", "testing", "tests")
FRONTEND_WORDS = ("api", "button", "client", "component", "css", "form", "forms", "frontend", "hook", "hooks", "html", "markup", "page", "reducer", "route", "router", "routes", "routing", "screen", "service", "services", "state", "store", "stores", "style", "styles", "scss", "template", "ui", "view")
FRONTEND_ROLE_WORDS = {
    "page": ("page", "screen", "view"), "component": ("component",), "template": ("html", "markup", "template"), "style": ("css", "scss", "style", "styles"),
    "hook": ("hook", "hooks"), "service": ("service", "services"), "api_client": ("api", "client"), "route": ("route", "router", "routes", "routing"),
    "state_store": ("reducer", "state", "store", "stores"), "form": ("form", "forms"),
}
LANGUAGE_ALIASES = {"csharp": ("csharp", "cs"), "javascript": ("javascript", "js", "jsx"), "kotlin": ("kotlin", "kt", "kts"), "markdown": ("markdown", "md"), "powershell": ("powershell", "ps1"), "python": ("python", "py"), "typescript": ("typescript", "ts", "tsx"), "yaml": ("yaml", "yml")}
CONFIDENT_ROLES = ("page", "component", "hook", "route", "controller", "service", "model")
SUPPORT_FILE = r"\.component\.(html|css|scss|sass|less)$|\.module\.(css|scss|sass|less)$"


def task_words(task: str, stop_words, least: int = 1) -> list[str]:
    """Distinct tokens of a task, in order."""
    return list(dict.fromkeys(w for w in re.findall("[a-z0-9]+", task.lower()) if w not in stop_words and len(w) >= least))


def task_terms(task: str) -> list[str]:
    return task_words(task, TASK_STOP_WORDS, 3)


def expanded_terms(terms: list[str]) -> list[str]:
    """Each term followed by its synonyms."""
    return list(dict.fromkeys(x for t in terms for x in (t, *TASK_SYNONYMS.get(t, ()))))


def task_phrases(terms: list[str]) -> list[str]:
    return list(dict.fromkeys(" ".join(terms[i : i + n]) for n in (2, 3) for i in range(len(terms) - n + 1)))


def task_hints(task: str) -> dict[str, bool]:
    """Which kinds of files a task asks for."""
    own = set(task_terms(task))
    return {k: bool(own & set(v)) for k, v in TASK_HINTS.items()}


def _sum(columns) -> Column:
    out = F.lit(0)
    for c in columns:
        out = out + c
    return out


def _points(hit: Column, points: int) -> Column:
    return F.when(hit, points).otherwise(0)


def file_terms(path: Column, languages: Column, names: Column, routes: Column) -> Column:
    """The bag of terms of a file: from its path, language, symbols and imports, and routes."""
    every = F.concat(F.array(path), languages, names, routes)
    return F.array_distinct(F.flatten(F.transform(every, X.identifier_terms)))


def described(df: DataFrame, path: str, symbols: str, imports: str, routes: str) -> DataFrame:
    """``df`` with the columns that the scores below read, so that each is computed once a file.

    ``symbols, imports, routes`` are arrays of strings. Made: ``own, whole`` (plain texts of name and path), ``names,
    brought, ways`` (plain texts of the arrays), ``bag``, ``stem_words, folder_words``, ``front``, ``place``,
    ``language``, ``extension``, ``is_test``, ``is_generated``.
    """
    p = F.col(path)
    texts = {k: F.transform(c, X.plain_text) for k, c in (("names", symbols), ("brought", imports), ("ways", routes))}
    df = df.withColumns({"own": X.plain_text(X.name(p)), "whole": X.plain_text(p), **texts, "stem_words": X.stem_tokens(p), "folder_words": X.folder_tokens(p), "language": X.language(p)})
    more = {"front": X.frontend_role(p), "place": P.folder_role(p), "extension": X.extension(p), "is_test": P.is_test_path(p), "is_generated": P.is_generated_path(p)}
    spoken = F.array_compact(F.array("language"))
    return df.withColumns(more | {"bag": file_terms(p, spoken, F.concat(symbols, imports), F.col(routes))})


def _over(terms: list[str], points) -> Column:
    """Sum of the points of each term (a column made from the term's)."""
    return F.aggregate(F.array(*[F.lit(t) for t in terms]), F.lit(0), lambda acc, t: acc + points(t))


def _hits(words: list[str], values: Column) -> Column:
    """How often the words are in the values, together."""
    return _over(words, lambda w: F.size(F.filter(values, lambda x: x.contains(w))))


def task_relevance(task: str, path: Column, roles: Column) -> Column:
    """How well a file fits a task: terms by place, phrases, shared terms, roles that the task hints at, less for tests.

    For rows of :func:`described`; ``roles`` are the file's roles.
    """
    terms, hints = task_terms(task), task_hints(task)
    if not terms:
        return F.lit(0)
    wide, phrases = expanded_terms(terms), task_phrases(terms)
    own, whole, bag = F.col("own"), F.col("whole"), F.col("bag")

    def of_term(t: Column) -> Column:
        placed = F.when(own.contains(t), 6).when(whole.contains(t), 4).otherwise(0)
        hits = [(F.array_contains(bag, t), 3), *[(F.exists(c, lambda x: x.contains(t)), n) for c, n in (("names", 2), ("brought", 1), ("ways", 3))]]
        return placed + _sum(_points(hit, n) for hit, n in hits)

    def of_phrase(p: Column) -> Column:
        close = F.replace(p, F.lit(" "), F.lit(""))
        texts = F.concat(F.array(whole, own), F.col("ways"))
        said = F.exists(texts, lambda x: x.contains(p) | F.replace(x, F.lit(" "), F.lit("")).contains(close))
        return F.when(F.array_join(bag, " ").contains(p), 4 + F.size(F.split(p, " "))).otherwise(0) + _points(said, 5)

    shared, direct = (F.size(F.array_intersect(bag, F.array(*[F.lit(t) for t in own_terms]))) for own_terms in (wide, terms))
    score = [_over(wide, of_term), F.when(shared >= 2, shared * 2).otherwise(shared), direct * 4]
    if phrases:
        score.append(_over(phrases, of_phrase))
    score += [_points(F.array_contains(roles, role), points) for role, hint, points in ROLE_BONUS if hints[hint]]
    if "hook" in terms or hints["frontend_ui"]:
        score.append(_points(F.array_contains(roles, "hook"), 7))
    total = _sum(score)
    if not hints["tests"]:
        test = F.array_contains(roles, "test")
        total = F.greatest(total - _points(test, 15), _points(test, 1))
    if not (hints["tests"] or hints["styles"]):
        support = F.lower(path).rlike(SUPPORT_FILE)
        total = F.greatest(total - _points(support, 12), _points(support, 1))
    return total


def matched_terms(task: str) -> Column:
    """The task's terms that the path, symbols, imports or routes of a row of :func:`described` contain."""
    texts = F.concat(F.array("whole"), F.col("names"), F.col("brought"), F.col("ways"))
    return F.filter(F.array(*[F.lit(t) for t in task_terms(task)]).cast("array<string>"), lambda t: F.exists(texts, lambda x: x.contains(t)))


def score_confidence(score: Column, matched: Column, roles: Column) -> Column:
    """``matched`` counts the task's terms found in the file."""
    likely = (score >= 12) & F.arrays_overlap(roles, F.array(*[F.lit(r) for r in CONFIDENT_ROLES]))
    return F.when(matched >= 2, "high").when((matched >= 1) | likely, "medium").otherwise("low")


def candidate_score(task: str) -> Column:
    """The cheap score of a path alone: tokens of name and folders, roles, language, and less for tests and generated files.

    For rows of :func:`described`.
    """
    words = task_words(task, CANDIDATE_STOP_WORDS)
    have = set(words)
    stem, above, place = F.col("stem_words"), F.col("folder_words"), F.col("place")
    score = [_over(words, lambda w: F.when(F.array_contains(stem, w), 6).when(F.array_contains(above, w), 3).otherwise(0))] if words else []
    both = F.array_union(stem, above)
    for roles, points in ((have, 2), (set(ROLE_WORDS) - have, 1)):
        own = [r for r in ROLE_WORDS if r in roles and r not in TEST_WORDS]
        score.append(F.size(F.array_intersect(both, F.array(*[F.lit(r) for r in own]).cast("array<string>"))) * points)
    if have & set(FRONTEND_WORDS):
        role = F.col("front")
        score += [_points(role == r, 4 if have & set(names) else 2) for r, names in FRONTEND_ROLE_WORDS.items()]
    score.append(F.when(place.isin(*have) & (place != "test"), 3).when(place == "source", 1).otherwise(0) if have else _points(place == "source", 1))
    spoken = [x for x in {**{v: (v,) for v in X.EXTENSION_LANGUAGES.values()}, **LANGUAGE_ALIASES}.items() if have & set(x[1])]
    if spoken:
        score.append(_points(F.col("language").isin(*[k for k, _ in spoken]), 2))
    score.append(_points(F.col("extension").isin(*words) if words else F.lit(False), 2))
    score.append(_points(F.col("is_test"), 8 if have & set(TEST_WORDS) else -12))
    score.append(_points(F.col("is_generated") | place.isin("generated", "vendor"), -100))
    return _sum(F.coalesce(c, F.lit(0)) for c in score)


def brief_score(words: list[str], path: Column, classes: Column, functions: Column, quiet=()) -> Column:
    """The plainer score of a brief: 5 a word in the path, 4 in the name, 3 a symbol and 1 an import that contains it.

    For rows of :func:`described`; ``quiet`` words don't count in symbols and imports.
    """
    score = [_over(words, lambda w: _points(F.col("whole").contains(w), 5) + _points(F.col("own").contains(w), 4))]
    score += [_points(X.name(path) == "cli.py", 8) for w in ("command", "commands", "cli") if w in words]
    loud = [w for w in words if w not in quiet]
    for values, points in ((F.transform(classes, X.plain_text), 3), (F.transform(functions, X.plain_text), 3), (F.col("brought"), 1)):
        if loud:
            score.append(_hits(loud, values) * points)
    return _sum(score)


def route_score(terms: list[str], relevant: Column, path: Column, file: Column, method: Column, source: Column) -> Column:
    """10 in a relevant file, and by term 4 in the route, 2 in the file, 5 for the method, 1 in the handler."""
    texts = [X.plain_text(F.coalesce(c, F.lit(""))) for c in (path, method, source)]
    score = [_points(relevant, 10)]
    for t in terms:
        score += [_points(texts[0].contains(t), 4), _points(file.contains(t), 2), _points(texts[1] == t, 5), _points(texts[2].contains(t), 1)]
    return _sum(score)


def reference_score(reference: str, path: Column, asks_tests: bool = False) -> Column:
    """How well a path answers a file reference, by tiers: exact, name, stem, part of the path, tokens; 0 for no relation.

    What is left is told apart by edit distance (the last tier, 100 and up to 100 more).
    """
    raw = reference.strip()
    norm = re.sub("/+", "/", raw.replace("\\", "/"))
    low = norm.lower()
    apart = "/" in norm or raw.startswith((".", "~"))
    own, base, path_low = X.name(path), X.stem(path), F.lower(path)
    # the reference's terms by the same rule as the files'
    terms = X.identifier_terms(F.lit(raw))
    theirs = X.identifier_terms(path)
    n_terms, shared = F.size(terms), F.size(F.array_intersect(terms, theirs))
    close = 1 - F.levenshtein(F.lit(low), path_low) / F.greatest(F.lit(max(1, len(low))), F.char_length(path_low))
    tier = F.when(path_low == low, 1000)
    if apart:
        pieces = [x for x in low.split("/") if x]
        tier = tier.when(path_low.contains("/".join(pieces)) if pieces else F.lit(False), 850 + 10 * len(pieces))
    else:
        tier = tier.when(own == raw, 950).when(base == raw, 925).when(F.lower(own) == low, 800).when(F.lower(base) == low, 780)
    tier = tier.when(X.contains_run(theirs, terms), 775 + 10 * n_terms).when(shared > 0, 650 + 20 * shared).otherwise(100 + F.floor(close * 100).cast("int"))
    bonus = F.when((path_low != low) & path_low.contains(low), min(25, max(5, 8 * len(norm.split("/"))))).otherwise(0)
    test = X.is_matching_test(path)
    shift = F.when(test, 25 if asks_tests else -35).otherwise(-10 if asks_tests else 0)
    return tier + bonus - (F.size(X.parts(path)) - 1) - F.floor(F.char_length(path) / 50).cast("int") + shift


def can_auto_resolve(best: Column, second: Column, candidates: Column) -> Column:
    """Whether the best score stands far enough above the second to be taken without asking."""
    gap = F.coalesce(best - second, F.lit(1 << 30))
    return F.when(candidates == 1, best >= 650).otherwise(((best >= 850) & (gap >= 20)) | ((best >= 700) & (gap >= 80)))


def probe_score(cheap: Column, probe: Column, structural: Column, cost: Column) -> Column:
    """One score of four normalised components; cost counts against."""
    return 0.35 * cheap + 0.30 * probe + 0.20 * structural - 0.15 * cost
