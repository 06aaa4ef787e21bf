"""Column functions on the paths of source files: parts, kinds, roles, terms and distances."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import predicates as P
from .text import tokens

# fixed values: names by which a path is ignored, secret, of a language or of a role
IGNORED_FOLDERS = (".aidc", ".cache", ".git", ".mypy_cache", ".nox", ".pytest_cache", ".ruff_cache", ".tox", ".venv", "__pycache__", "build", "coverage", "dist", "htmlcov", "node_modules", "venv")
IGNORED_FILES = (".coverage", "coverage.xml")
SECRET_FILES = ("credentials.json", "id_dsa", "id_rsa")
SECRET_PREFIXES = (".env", "secret.", "secrets.")
SECRET_SUFFIXES = (".key", ".pem")
EXTENSION_LANGUAGES = {
    "c": "c", "cc": "cpp", "cpp": "cpp", "cs": "csharp", "css": "css", "go": "go", "h": "c", "hpp": "cpp", "html": "html", "java": "java",
    "js": "javascript", "json": "json", "jsx": "javascript", "kt": "kotlin", "kts": "kotlin", "less": "less", "md": "markdown", "mjs": "javascript",
    "php": "php", "ps1": "powershell", "py": "python", "rb": "ruby", "rs": "rust", "sass": "sass", "scss": "scss", "sh": "shell", "sql": "sql",
    "swift": "swift", "toml": "toml", "ts": "typescript", "tsx": "typescript", "vue": "vue", "xml": "xml", "yaml": "yaml", "yml": "yaml",
}
NAME_LANGUAGES = {"dockerfile": "dockerfile", "gemfile": "ruby", "makefile": "makefile", "rakefile": "ruby"}
IDENTIFIER_STOP_WORDS = ("cjs", "css", "d", "gif", "html", "ico", "jpeg", "jpg", "js", "json", "less", "md", "mjs", "png", "py", "rb", "scss", "spec", "styl", "svg", "ts", "tsx", "txt", "yaml", "yml")
SCRIPT_EXTENSIONS = ("cjs", "js", "jsx", "mjs", "ts", "tsx")
TEMPLATE_EXTENSIONS = ("html",)
STYLE_EXTENSIONS = ("css", "less", "sass", "scss")
ASSET_EXTENSIONS = ("avif", "gif", "ico", "jpeg", "jpg", "png", "svg", "webp", "woff", "woff2")
#: Folders that make a front-end role, in the order in which they are asked, and tokens of the file's stem that do.
FRONTEND_FOLDERS = {
    "page": ("page", "pages", "screen", "screens", "view", "views"),
    "hook": ("hook", "hooks"),
    "route": ("route", "router", "routers", "routes", "routing"),
    "api_client": ("api", "apis", "client", "clients"),
    "state_store": ("state", "store", "stores"),
    "form": ("form", "forms"),
    "component": ("component", "components"),
}
FRONTEND_TOKENS = {"page": ("page",), "route": ("route", "routes", "router", "routing"), "api_client": ("api", "client"), "state_store": ("store", "reducer", "slice")}
FRONTEND_TEST_FOLDERS = ("__tests__", "e2e", "spec", "specs", "test", "tests")
ASSET_FOLDERS = ("asset", "assets", "image", "images", "public", "static")
CONFIG_STEMS = ("angular", "babel", "eslint", "jest", "postcss", "tailwind", "vite")


def _lits(values) -> Column:
    return F.array(*[F.lit(v) for v in values])


def parts(path: Column) -> Column:
    """The non-empty segments, with their case."""
    return F.filter(F.split(F.translate(path, "\\", "/"), "/"), lambda x: x != "")


def name(path: Column) -> Column:
    return F.coalesce(F.try_element_at(parts(path), F.lit(-1)), F.lit(""))


def folders(path: Column) -> Column:
    return F.slice(parts(path), F.lit(1), F.greatest(F.size(parts(path)) - 1, F.lit(0)))


def stem(path: Column) -> Column:
    """The name without its last extension; a leading dot is no extension."""
    return F.regexp_replace(name(path), r"(?<=.)\.[^.]*$", "")


def extension(path: Column) -> Column:
    """The last extension in lower case, without the dot; empty for none."""
    return F.regexp_extract(F.lower(name(path)), r".\.([^.]+)$", 1)


def _lower(values: Column) -> Column:
    return F.transform(values, lambda x: F.lower(x))


def _has(values: Column, names) -> Column:
    return F.arrays_overlap(values, _lits(names))


def is_ignored_folder(folder: Column) -> Column:
    bare = F.lower(F.trim(folder))
    return (bare == "") | bare.isin(*IGNORED_FOLDERS) | bare.endswith(".egg-info")


def is_ignored_file(path: Column) -> Column:
    bare = F.lower(F.trim(name(path)))
    return (bare == "") | bare.isin(*IGNORED_FILES) | bare.startswith(".coverage")


def is_ignored_path(path: Column) -> Column:
    return F.exists(folders(path), is_ignored_folder) | is_ignored_file(path)


def is_secret_path(path: Column) -> Column:
    own = F.lower(name(path))
    named = own.isin(*SECRET_FILES)
    for p in SECRET_PREFIXES:
        named = named | own.startswith(p)
    for s in SECRET_SUFFIXES:
        named = named | own.endswith(s)
    return (own != "") & (named | F.array_contains(_lower(parts(path)), ".ssh"))


def is_matching_test(path: Column) -> Column:
    """The looser rule of the task matcher: a ``tests`` folder, a ``test_`` name, or a .test or .spec part."""
    low, own = F.lower(F.translate(path, "\\", "/")), F.lower(stem(path))
    named = own.startswith("test_") | own.endswith(".test") | own.endswith(".spec")
    return low.startswith("tests/") | low.contains("/tests/") | named | low.contains(".test.") | low.contains(".spec.")


def language(path: Column) -> Column:
    """By the whole name first, then by the extension; null for others."""
    known = [F.create_map(*[F.lit(x) for pair in m.items() for x in pair]) for m in (NAME_LANGUAGES, EXTENSION_LANGUAGES)]
    return F.coalesce(F.try_element_at(known[0], F.lower(name(path))), F.try_element_at(known[1], extension(path)))


def name_tokens(text: Column) -> Column:
    return tokens(F.regexp_replace(text, r"([a-z0-9])([A-Z])", "$1 $2"))


def stem_tokens(path: Column) -> Column:
    return F.array_distinct(name_tokens(stem(path)))


def folder_tokens(path: Column) -> Column:
    return F.array_distinct(F.flatten(F.transform(folders(path), name_tokens)))


def path_tokens(path: Column) -> Column:
    return F.array_union(stem_tokens(path), folder_tokens(path))


def frontend_role(path: Column) -> Column:
    """A front-end role from the path alone; ``unknown`` for other files."""
    ext, own, base, above = extension(path), F.lower(name(path)), F.lower(stem(path)), _lower(folders(path))
    words = stem_tokens(path)
    front = ext.isin(*SCRIPT_EXTENSIONS, *TEMPLATE_EXTENSIONS, *STYLE_EXTENSIONS, *ASSET_EXTENSIONS)
    role = F.when(~front, "unknown")
    role = role.when(base.rlike(r"^test[._-]|[._-](test|spec)$") | _has(above, FRONTEND_TEST_FOLDERS), "test")
    role = role.when(own.contains(".config.") | base.isin(*CONFIG_STEMS), "config")
    role = role.when(ext.isin(*ASSET_EXTENSIONS) | _has(above, ASSET_FOLDERS), "asset")
    kind = F.when(ext.isin(*TEMPLATE_EXTENSIONS), "template").when(ext.isin(*STYLE_EXTENSIONS), "style")
    role = role.when(own.contains(".component."), F.coalesce(kind, F.lit("component")))
    role = role.when(own.rlike(r"\.(service|guard|resolver)\."), "service")
    role = role.when(own.contains(".routes.") | own.contains("routing.module."), "route")
    for r, names in FRONTEND_FOLDERS.items():
        hit = _has(above, names)
        if r in FRONTEND_TOKENS:
            hit = hit | _has(words, FRONTEND_TOKENS[r])
        if r == "hook":
            hit = hit | (base.startswith("use") & ~base.startswith("user"))
        if r == "component":
            hit = hit | ext.isin("jsx", "tsx")
        role = role.when(hit, r)
    return role.otherwise(F.coalesce(kind, F.lit("unknown")))


def identifier_terms(text: Column) -> Column:
    """Distinct lower-case terms of a path or identifier, cut at case, digit and punctuation changes; no single letters."""
    found = F.regexp_extract_all(text, F.lit(r"([A-Z]+(?=[A-Z][a-z]|[0-9]|[^A-Za-z0-9]|$)|[A-Z]?[a-z]+|[0-9]+)"), 1)
    kept = F.filter(_lower(found), lambda x: (F.char_length(x) > 1) & ~x.isin(*IDENTIFIER_STOP_WORDS))
    return F.array_distinct(kept)


def plain_text(text: Column) -> Column:
    """Lower case, with slashes one way and spaces for underscores and hyphens."""
    return F.lower(F.translate(text, "\\_-", "/  "))


def file_roles(path: Column, n_routes: Column) -> Column:
    """All roles that path and routes suggest, in a fixed order."""
    low, own, base = F.lower(path), name(path), F.lower(stem(path))
    terms = identifier_terms(path)

    def said(*names):
        return _has(terms, names)

    paged = (said("pages") & said("page", "index", "home", "landing")) | (said("app", "pages") & base.isin("page", "index"))
    made = said("component", "components", "ui") | base.endswith("component") | (low.rlike(r"\.[jt]sx$") & own.rlike("^[A-Z]"))
    roles = {
        "test": is_matching_test(path),
        "style": low.rlike(r"\.(css|scss|sass|less|styl)$") | said("style", "styles"),
        "middleware": said("middleware"),
        "controller": said("controller"),
        "service": said("service"),
        "model": said("model", "schema", "entity", "entities", "migration", "migrations"),
        "config": said("config") | low.rlike(r"\.config\.(js|jsx|ts|tsx|py|json)$"),
        "route": (n_routes > 0) | said("route", "routes"),
        "page": paged,
        "component": made,
        "hook": stem(path).startswith("use") & (F.char_length(stem(path)) > 3) & low.rlike(r"\.[jt]sx?$"),
    }
    return F.array_compact(F.array(*[F.when(hit, role) for role, hit in roles.items()]))


def is_relative_path(path: Column) -> Column:
    """Whether a path is relative, has no outer white space and no null, and does not leave its root."""
    bare = F.translate(path, "\\", "/")
    outside = bare.startswith("/") | bare.rlike(r"^[A-Za-z]:") | F.array_contains(F.split(bare, "/"), "..")
    return F.coalesce((path != "") & (F.trim(path) == path) & (F.instr(path, "\x00") == 0) & ~outside & ~bare.isin(".", "./"), F.lit(False))


def module_name(path: Column) -> Column:
    """The dotted name of a module file."""
    return F.array_join(F.concat(folders(path), F.array(stem(path))), ".")


def same_folder_module(path: Column, imported: Column) -> Column:
    return F.concat_ws("/", F.concat(folders(path), F.array(F.concat(imported, F.lit(".py")))))


def package_root(imported: Column) -> Column:
    """The package of an import: two parts for a scoped one, else the first."""
    return F.when(imported.startswith("@"), F.substring_index(imported, "/", 2)).otherwise(F.substring_index(imported, "/", 1))


def is_relative_import(imported: Column) -> Column:
    return imported.startswith("./") | imported.startswith("../")


def common_prefix(a: Column, b: Column) -> Column:
    """Number of leading elements that two arrays have in common."""
    same = F.zip_with(a, b, lambda x, y: F.coalesce(x == y, F.lit(False)))
    first = F.array_position(same, F.lit(False))
    return F.when(first > 0, first - 1).otherwise(F.size(same).cast("long"))


def directory_distance(a: Column, b: Column) -> Column:
    """Steps in the tree of folders from one to the other, without regard to case."""
    x, y = _lower(a), _lower(b)
    return F.size(x) + F.size(y) - 2 * common_prefix(x, y)


def directory_proximity(test_folders: Column, source_folders: Column) -> Column:
    """80 for the same folder, else 15 a common leading folder, 45 at most."""
    return F.when(test_folders == source_folders, 80).otherwise(F.least(F.lit(45), common_prefix(test_folders, source_folders) * 15)).cast("int")


def contains_run(whole: Column, run: Column) -> Column:
    """Whether an array has another of two elements or more as a contiguous run."""
    starts = F.sequence(F.lit(1), F.size(whole) - F.size(run) + 1)
    return F.when((F.size(run) >= 2) & (F.size(whole) >= F.size(run)), F.exists(starts, lambda i: F.slice(whole, i, F.size(run)) == run)).otherwise(False)


def inventory_columns(path: Column) -> dict[str, Column]:
    """What is known of a file from its path."""
    return {
        "extension": extension(path),
        "is_test": P.is_test_path(path),
        "is_generated": P.is_generated_path(path),
        "folder_role": P.folder_role(path),
        "language": language(path),
    }
