"""Facts of script, Go and framework sources, by native expressions on the text without comments.

Each function gives an array of structs; ``F.inline`` makes rows of it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .lexer import code_mask, plain_strings, without_comments

_NAME = r"[A-Za-z_$][\w$]*"


def balanced(text: Column, opened: str = "{", closed: str = "}") -> Column:
    """Whether every brace outside strings and comments is closed, and none closed before it is opened."""
    only = F.filter(F.split(F.regexp_replace(code_mask(text), f"[^\\{opened}\\{closed}]", ""), ""), lambda x: x != "")
    start = F.struct(F.lit(0).alias("n"), F.lit(True).alias("ok"))
    step = F.aggregate(only, start, lambda s, x: F.struct((s["n"] + F.when(x == opened, 1).otherwise(-1)).alias("n"), (s["ok"] & (s["n"] + F.when(x == opened, 1).otherwise(-1) >= 0)).alias("ok")))
    return (step["n"] == 0) & step["ok"]


def _found(text: Column, pattern: str, groups: dict[str, int]) -> Column:
    """``[{name: group}]`` of all matches."""
    lists = [F.regexp_extract_all(text, F.lit(pattern), i).alias(k) for k, i in groups.items()]
    return F.arrays_zip(*lists)


def _rows(found: Column, **made) -> Column:
    return F.transform(found, lambda x: F.struct(*[F.coalesce(f(x), F.lit("")).alias(k) for k, f in made.items()]))


def script_imports(text: Column) -> Column:
    """``[{form, clause, source}]``: default, named, namespace, effect, dynamic and require, each in the order of the text."""
    bare = plain_strings(text)
    clauses = _found(bare, r"""(?m)^[ \t]*+import\s+(?:type\s+)?([\w$*{}\s,]+?)\s*from\s*['"]([^'"\n]+)['"]""", {"c": 1, "s": 2})
    form = lambda x: F.when(x["c"].contains("*"), "namespace").when(x["c"].startswith("{"), "named").otherwise("default")
    out = [_rows(clauses, form=form, clause=lambda x: F.regexp_replace(x["c"], r"\s+", " "), source=lambda x: x["s"])]
    others = {"effect": r"""(?m)^[ \t]*+import\s*['"]([^'"\n]+)['"]""", "dynamic": r"""\bimport\s*\(\s*['"]([^'"\n]+)['"]""", "require": r"""\brequire\s*\(\s*['"]([^'"\n]+)['"]"""}
    for name, pattern in others.items():
        out.append(_rows(_found(bare, pattern, {"s": 1}), form=_constant(name), clause=_constant(""), source=lambda x: x["s"]))
    return F.concat(*out)


def _constant(value: str):
    return lambda x: F.lit(value)


def script_exports(text: Column) -> Column:
    """``[{form, name, source}]``: declared, listed and star exports; ``source`` for those that are handed on."""
    bare = plain_strings(text)
    declared = _found(bare, rf"(?m)^[ \t]*+export\s+(default\s+)?(?:abstract\s+|async\s+)?(?:function|class|const|let|var|interface|type|enum)\s+({_NAME})", {"d": 1, "n": 2})
    out = [_rows(declared, form=lambda x: F.when(x["d"] != "", "default").otherwise("named"), name=lambda x: x["n"], source=_constant(""))]
    lists = _found(bare, r"""export\s*\{([^}]*)\}(?:\s*from\s*['"]([^'"\n]+)['"])?""", {"l": 1, "s": 2})
    each = F.flatten(F.transform(lists, lambda x: F.transform(F.filter(F.split(x["l"], ","), lambda y: F.trim(y) != ""), lambda y: F.struct(F.trim(F.regexp_replace(y, r"^.*\bas\s+", "")).alias("n"), x["s"].alias("s")))))
    out.append(_rows(each, form=_constant("listed"), name=lambda x: x["n"], source=lambda x: x["s"]))
    stars = _found(bare, r"""export\s*\*\s*(?:as\s+(\w+)\s*)?from\s*['"]([^'"\n]+)['"]""", {"n": 1, "s": 2})
    return F.concat(*out, _rows(stars, form=_constant("star"), name=lambda x: x["n"], source=lambda x: x["s"]))


def script_declarations(text: Column) -> Column:
    """``[{kind, name}]``: functions, arrows, classes, interfaces, types, enums; ``use`` names are hooks, capitals components."""
    bare = code_mask(text)
    named = _found(bare, rf"(?m)^[ \t]*+(?:export\s+)?(?:default\s+)?(?:declare\s+)?(?:abstract\s+|async\s+)?(function|class|interface|type|enum)\s+({_NAME})", {"k": 1, "n": 2})
    arrows = _found(bare, rf"(?m)^[ \t]*+(?:export\s+)?(?:const|let|var)\s+({_NAME})\s*(?::[^=\n]+)?=\s*(?:async\s*)?(?:\([^)\n]*\)(?:\s*:[^=\n]+)?|{_NAME})\s*=>", {"n": 1})
    told = lambda k, n: F.when(k != "function", k).when(n.rlike("^use[A-Z]"), "hook").when(n.rlike("^[A-Z]"), "component").otherwise(k)
    return F.concat(_rows(named, kind=lambda x: told(x["k"], x["n"]), name=lambda x: x["n"]), _rows(arrows, kind=lambda x: told(F.lit("function"), x["n"]), name=lambda x: x["n"]))


def express_routes(text: Column) -> Column:
    """``[{method, path, handler}]`` of app and router calls and of ``.route(...)`` chains; template paths are skipped."""
    bare = without_comments(text)
    calls = _found(bare, r"""\b(?:app|router)\.(get|post|put|patch|delete|options|head|all)\s*\(\s*(?:"([^"\n]+)"|'([^'\n]+)')\s*(?:,\s*([\w.]+)\s*\))?""", {"m": 1, "p": 2, "q": 3, "h": 4})
    out = _rows(calls, method=lambda x: F.upper(x["m"]), path=lambda x: F.concat(x["p"], x["q"]), handler=lambda x: x["h"])
    chains = _found(bare, r"""\.route\s*\(\s*['"]([^'"\n]+)['"]\s*\)((?:\s*\.\s*(?:get|post|put|patch|delete)\s*\(\s*[\w.]+\s*\))++)""", {"p": 1, "c": 2})

    def links(x):
        verbs, handlers = (F.regexp_extract_all(x["c"], F.lit(r"\.\s*(get|post|put|patch|delete)\s*\(\s*([\w.]+)"), i) for i in (1, 2))
        return F.transform(F.arrays_zip(verbs.alias("v"), handlers.alias("h")), lambda y: F.struct(F.upper(y["v"]).alias("method"), x["p"].alias("path"), y["h"].alias("handler")))

    return F.concat(out, F.flatten(F.transform(chains, links)))


def react_links(text: Column) -> Column:
    """``[{kind, name}]``: components used as tags, hooks called, calls of services, lazy parts."""
    bare = without_comments(text)
    tags = F.filter(_found(bare, r"<([A-Z][\w.]*)", {"n": 1}), lambda x: ~x["n"].isin("Fragment", "StrictMode", "React.Fragment", "React.StrictMode"))
    out = [_rows(tags, kind=_constant("renders"), name=lambda x: x["n"])]
    for kind, pattern in (("hook", r"\b(use[A-Z]\w*)\s*\("), ("calls", r"\b(fetch|\w*Api\.\w+)\s*\("), ("lazy", r"""\blazy\s*\(\s*\(\s*\)\s*=>\s*import\s*\(\s*['"]([^'"\n]+)['"]""")):
        out.append(_rows(_found(bare, pattern, {"n": 1}), kind=_constant(kind), name=lambda x: x["n"]))
    return F.array_distinct(F.concat(*out))


def angular_component(text: Column) -> Column:
    """``[{kind, name}]`` of component metadata: selector, template and style files; none without the decorator."""
    bare = without_comments(text)
    meta = F.regexp_extract(bare, r"@Component\s*\(\s*\{([\s\S]*?)\}\s*\)", 1)
    out = [_rows(_found(meta, rf"\b{k}\s*:\s*['\"]([^'\"\n]+)['\"]", {"n": 1}), kind=_constant(kind), name=lambda x: x["n"]) for k, kind in (("selector", "selector"), ("templateUrl", "template"), ("styleUrl", "style"))]
    listed = F.regexp_extract_all(F.regexp_extract(meta, r"\bstyleUrls\s*:\s*\[([^\]]*)\]", 1), F.lit(r"['\"]([^'\"\n]+)['\"]"), 1)
    out.append(F.transform(listed, lambda x: F.struct(F.lit("style").alias("kind"), x.alias("name"))))
    inline = F.when(meta.rlike(r"\btemplate\s*:"), F.array(F.struct(F.lit("inline").alias("kind"), F.lit("template").alias("name")))).otherwise(F.array().cast("array<struct<kind:string,name:string>>"))
    return F.concat(*out, inline)


def django_routes(text: Column) -> Column:
    """``[{form, method, path, handler}]`` of URL calls, includes, registered view sets and ``api_view`` functions."""
    urls = _found(text, r"""\b(?:re_)?path\s*\(\s*r?['"]([^'"\n]*)['"]\s*,\s*(include\s*\(\s*['"]([^'"\n]*)['"]|[\w.]+)""", {"p": 1, "h": 2, "i": 3})
    out = _rows(urls, form=lambda x: F.when(x["i"] != "", "include").otherwise("url"), method=_constant("ANY"), path=lambda x: x["p"], handler=lambda x: F.when(x["i"] != "", x["i"]).otherwise(x["h"]))
    sets = _found(text, r"""\.register\s*\(\s*r?['"]([^'"\n]*)['"]\s*,\s*([\w.]+)""", {"p": 1, "h": 2})
    views = _found(text, r"@api_view\s*\(\s*(\[[^\]]*\])?[^)]*\)\s*\n\s*(?:async\s+)?def\s+(\w+)", {"m": 1, "h": 2})
    said = lambda x: F.array_join(F.regexp_extract_all(x["m"], F.lit(r"['\"](\w+)['\"]"), 1), ",")
    return F.concat(
        out,
        _rows(sets, form=_constant("register"), method=_constant("ANY"), path=lambda x: x["p"], handler=lambda x: x["h"]),
        _rows(views, form=_constant("handler"), method=lambda x: F.when(said(x) != "", said(x)).otherwise("unknown"), path=_constant(""), handler=lambda x: x["h"]),
    )


def go_facts(text: Column) -> Column:
    """``[{kind, method, name, handler}]``: functions and methods, routes of mux and chi, with methods where named."""
    bare = without_comments(text)
    funcs = _found(bare, r"(?m)^func\s+(?:\([^)\n]*\)\s*)?(\w+)\s*\(", {"n": 1})
    handled = _found(bare, r"""\b(?:http|mux|r|router)\.Handle(?:Func)?\(\s*"([^"\n]+)"\s*,\s*([\w.]+)\s*\)(?:\.Methods\(\s*"(\w+)")?""", {"p": 1, "h": 2, "m": 3})
    chi = _found(bare, r"""\b(?:r|router)\.(Get|Post|Put|Patch|Delete)\(\s*"([^"\n]+)"\s*,\s*([\w.]+)""", {"m": 1, "p": 2, "h": 3})
    return F.concat(
        _rows(funcs, kind=_constant("func"), method=_constant(""), name=lambda x: x["n"], handler=_constant("")),
        _rows(handled, kind=_constant("route"), method=lambda x: F.when(x["m"] != "", F.upper(x["m"])).otherwise("ANY"), name=lambda x: x["p"], handler=lambda x: x["h"]),
        _rows(chi, kind=_constant("route"), method=lambda x: F.upper(x["m"]), name=lambda x: x["p"], handler=lambda x: x["h"]),
    )


def test_functions(text: Column) -> Column:
    """``[{form, name}]``: Python functions named ``test_`` and script calls of test, it and describe."""
    python = _found(text, r"(?m)^[ \t]*+(?:async\s+)?def\s+(test_\w+)", {"n": 1})
    calls = _found(without_comments(text), r"""(?m)^[ \t]*+(test|it|describe)(?:\.\w+)?\s*\(\s*['"]([^'"\n]+)['"]""", {"f": 1, "n": 2})
    return F.concat(_rows(python, form=_constant("def"), name=lambda x: x["n"]), _rows(calls, form=lambda x: x["f"], name=lambda x: x["n"]))


def references(text: Column) -> Column:
    """``[{kind, name, value}]``: values of named settings that are addresses or routes, frames, messages and listeners."""
    bare = without_comments(text)
    settings = _found(text, r"""(?m)^[ \t]*+(?:export\s+)?(?:const\s+)?([A-Za-z_][\w]*)\s*[:=]\s*['"]?((?:https?|wss?)://[^\s'",;]+)""", {"n": 1, "v": 2})
    kind = lambda x: F.when(x["n"].rlike("(?i)api|base|endpoint"), "api_base_url").otherwise("environment_url")
    routes = _found(text, r"""(?m)^[ \t]*+(?:export\s+)?const\s+([A-Z_]+)\s*=\s*['"](/[^\s'"]*)['"]""", {"n": 1, "v": 2})
    frames = _found(bare, r"""<iframe\b[^>]*\bsrc\s*=\s*['"]([^'"\n]+)['"]""", {"v": 1})
    sent = _found(bare, r"""\.postMessage\s*\(\s*\{\s*type\s*:\s*['"]([^'"\n]+)['"]""", {"v": 1})
    heard = _found(bare, r"""addEventListener\s*\(\s*['"](message)['"]""", {"v": 1})
    out = [_rows(settings, kind=kind, name=lambda x: x["n"], value=lambda x: x["v"]), _rows(routes, kind=_constant("route_constant"), name=lambda x: x["n"], value=lambda x: x["v"])]
    out += [_rows(found, kind=_constant(k), name=_constant(""), value=lambda x: x["v"]) for k, found in (("iframe_src", frames), ("post_message", sent), ("message_listener", heard))]
    return F.concat(*out)


def angular_routes(text: Column) -> Column:
    """``[{kind, route, target}]`` of route tables: components, and parts that are loaded late."""
    bare = without_comments(text)
    plain = _found(bare, r"""\{\s*path\s*:\s*['"]([^'"\n]*)['"]\s*,\s*component\s*:\s*([A-Z]\w*)""", {"p": 1, "t": 2})
    late = _found(bare, r"""\{\s*path\s*:\s*['"]([^'"\n]*)['"]\s*,\s*load(?:Children|Component)\s*:\s*\(\s*\)\s*=>\s*import\s*\(\s*['"]([^'"\n]+)['"]""", {"p": 1, "t": 2})
    return F.concat(*[_rows(f, kind=_constant(k), route=lambda x: x["p"], target=lambda x: x["t"]) for k, f in (("component", plain), ("lazy", late))])


def boundary_signals(text: Column) -> Column:
    """``[{kind, name, value}]``: remotes and exposed parts of a module federation, custom elements defined and used."""
    bare = without_comments(text)
    out = []
    for kind in ("remotes", "exposes"):
        body = F.regexp_extract(bare, rf"\b{kind}\s*:\s*\{{([^}}]*)\}}", 1)
        out.append(_rows(_found(body, r"""['"]?([\w./@$-]+)['"]?\s*:\s*['"]([^'"]+)['"]""", {"n": 1, "v": 2}), kind=_constant(kind), name=lambda x: x["n"], value=lambda x: x["v"]))
    defined = _found(bare, r"""\bcustomElements\s*\.\s*define\s*\(\s*['"]([a-z][\w.]*-[\w.-]+)['"]\s*,\s*(\w+)""", {"n": 1, "v": 2})
    used = F.array_distinct(_rows(_found(bare, r"<([a-z][\w.]*-[\w.-]+)", {"n": 1}), kind=_constant("element"), name=lambda x: x["n"], value=_constant("")))
    return F.concat(*out, _rows(defined, kind=_constant("defines"), name=lambda x: x["n"], value=lambda x: x["v"]), used)


def library_usage(text: Column, packages: list[str]) -> Column:
    """``[{package, name}]``: what a script imports from known packages or parts of them, name by name."""
    known = F.array(*[F.lit(p) for p in packages])
    own = F.filter(script_imports(text), lambda x: F.exists(known, lambda p: (x["source"] == p) | x["source"].startswith(F.concat(p, F.lit("/")))))
    names = lambda x: F.filter(F.transform(F.split(F.regexp_replace(x["clause"], "[{}]", ","), ","), lambda y: F.trim(F.regexp_replace(y, r"\s+as\s+\w+$", ""))), lambda y: y != "")
    return F.flatten(F.transform(own, lambda x: F.transform(names(x), lambda y: F.struct(x["source"].alias("package"), y.alias("name")))))


def entry_candidates(text: Column, words: list[str]) -> Column:
    """``[{kind, symbol, label, score}]`` where a journey may start: links, buttons and handlers that speak of the words.

    A route or an address of a link 0.94, a button's or link's label 0.84, an event's handler 0.82; a handler of nothing
    that was asked for 0.35.
    """
    said = lambda c: F.exists(F.array(*[F.lit(w) for w in words]), lambda w: F.lower(c).contains(w))
    tags = _found(text, r"""<(a|button)\b([^>]*)>([^<]*)</""", {"t": 1, "a": 2, "l": 3})
    route = lambda x: F.regexp_extract(x["a"], r"""\b(?:href|routerLink)\s*=\s*['"]([^'"]+)['"]""", 1)
    handler = lambda x: F.regexp_extract(x["a"], r"""(?:\(click\)|onClick)\s*=\s*['"{]\s*(\w+)""", 1)
    fact = lambda kind, symbol, label, score: F.struct(F.lit(kind).alias("kind"), symbol.alias("symbol"), label.alias("label"), F.lit(score).alias("score"))

    def of_tag(x: Column) -> Column:
        label, way, does = F.trim(x["l"]), route(x), handler(x)
        asked = said(label) | said(does)
        return F.array_compact(F.array(
            F.when((way != "") & said(way), fact("route", F.lit(""), way, 0.94)),
            F.when(asked, fact("tag", does, label, 0.84)).when(does != "", fact("tag", does, label, 0.35)),
        ))

    forms = _found(text, r"""<form\b[^>]*(?:\(ngSubmit\)|onSubmit)\s*=\s*['"{]\s*(\w+)""", {"h": 1})
    submits = F.transform(F.filter(forms, lambda x: said(x["h"])), lambda x: fact("form", x["h"], F.lit("form submit"), 0.82))
    return F.concat(F.flatten(F.transform(tags, of_tag)), submits)


def nest_routes(files: DataFrame, key: str, text: str) -> DataFrame:
    """``key, line, method, path, handler`` of controller classes: a route takes the prefix of its class and the next method.

    Line by line: the prefix of the last ``@Controller`` above goes forward; one without a literal prefix has no routes.
    """
    lines = files.select(key, F.posexplode(F.split(without_comments(F.col(text)), "\n")).alias("line", "s"))
    control = F.when(F.col("s").rlike(r"@Controller\s*\("), F.when(F.col("s").rlike(r"@Controller\s*\(\s*\)"), "").otherwise(F.nullif(F.regexp_extract("s", r"@Controller\s*\(\s*(['\"][^'\"]*['\"])", 1), F.lit(""))))
    open_ = F.col("s").rlike(r"@Controller\s*\(")
    verb = F.regexp_extract("s", r"@(Get|Post|Put|Patch|Delete|All)\s*\(\s*(?:['\"]([^'\"]*)['\"])?\s*\)", 1)
    own = F.regexp_extract("s", r"@(Get|Post|Put|Patch|Delete|All)\s*\(\s*(?:['\"]([^'\"]*)['\"])?\s*\)", 2)
    method = F.regexp_extract("s", r"^\s*(?:public\s+|private\s+|async\s+)*([a-zA-Z_]\w*)\s*\([^;]*\{\s*$", 1)
    marks = lines.select(key, "line", F.when(open_, F.struct(F.regexp_replace(control, r"['\"]", "").alias("prefix"))).alias("c"), verb.alias("verb"), own.alias("own"), F.when((method != "") & ~method.isin("if", "for", "while", "switch", "constructor"), method).alias("m"))
    w = Window.partitionBy(key).orderBy("line")
    placed = marks.withColumns({"at": F.last("c", ignorenulls=True).over(w), "handler": F.first("m", ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))})
    hits = placed.where((F.col("verb") != "") & F.col("at.prefix").isNotNull())
    path = F.regexp_replace(F.concat(F.lit("/"), F.col("at.prefix"), F.lit("/"), "own"), "/+", "/")
    return hits.select(key, (F.col("line") + 1).cast("long").alias("line"), F.upper("verb").alias("method"), F.when(path == "/", path).otherwise(F.regexp_replace(path, "/$", "")).alias("path"), F.coalesce("handler", F.lit("")).alias("handler"))


def manifest_facts(name: Column, text: Column) -> Column:
    """``[{kind, name, value}]`` of package, workspace, module, project, compose and tsconfig files, told by the file's name."""
    low = F.lower(name)
    package = F.from_json(text, "name string, dependencies map<string,string>, devDependencies map<string,string>, workspaces array<string>")
    none = F.array().cast("array<struct<kind:string,name:string,value:string>>")
    fact = lambda kind, n, v: F.struct(F.lit(kind).alias("kind"), F.coalesce(n, F.lit("")).alias("name"), F.coalesce(v, F.lit("")).alias("value"))
    each = lambda m, kind: F.coalesce(F.transform(F.array_sort(F.map_entries(m)), lambda e: fact(kind, e["key"], e["value"])), none)
    local = lambda m: F.filter(each(m, "dependency"), lambda e: e["value"].rlike("^(file|link|workspace):"))
    npm = F.concat(F.array(fact("package", package["name"], F.lit(""))), local(package["dependencies"]), local(package["devDependencies"]), F.coalesce(F.transform(package["workspaces"], lambda x: fact("workspace", x, F.lit(""))), none))
    config = F.from_json(without_comments(text), "compilerOptions struct<baseUrl:string, paths:map<string,array<string>>>")
    paths = F.transform(F.array_sort(F.map_entries(config["compilerOptions"]["paths"])), lambda e: fact("alias", e["key"], F.array_join(e["value"], ",")))
    listed = lambda pattern, kind: F.transform(F.regexp_extract_all(text, F.lit(pattern), 1), lambda x: fact(kind, x, F.lit("")))
    go = F.concat(listed(r"(?m)^module\s+(\S+)", "module"), F.transform(_found(text, r"(?m)^replace\s+(\S+)\s+=>\s+(\.\S*)", {"n": 1, "v": 2}), lambda x: fact("replace", x["n"], x["v"])), listed(r"(?m)^[ \t]*+use\s+(\.\S*)", "use"))
    project = F.regexp_extract(text, r"(?s)\[project\](.*?)(?:\n\[|\z)", 1)
    python = F.concat(F.array(fact("package", F.regexp_extract(project, r'(?m)^name\s*=\s*"([^"]+)"', 1), F.lit(""))), F.transform(F.regexp_extract_all(text, F.lit(r'path\s*=\s*"([^"]+)"'), 1), lambda x: fact("dependency", F.lit(""), x)))
    return (
        F.when(low == "package.json", npm).when(low.startswith("tsconfig"), F.coalesce(paths, none)).when(low.isin("go.mod", "go.work"), go).when(low == "pyproject.toml", python)
        .when(low == "pnpm-workspace.yaml", listed(r"(?m)^[ \t]*+-[ \t]*['\"]?([^'\"\n]+?)['\"]?\s*$", "workspace")).when(low.rlike(r"^(docker-)?compose\.ya?ml$"), listed(r"(?m)^[ \t]*+(?:build|context):\s*['\"]?(\.[^'\"\s]*)['\"]?\s*$", "build")).otherwise(none)
    )
