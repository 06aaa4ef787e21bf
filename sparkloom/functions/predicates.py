"""Column predicates and bins on paths, sizes and scores."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: folder and file names by which a path is told
TEST_FOLDERS = ("__tests__", "spec", "specs", "test", "tests")
VENDOR_FOLDERS = ("node_modules", "third_party", "third-party", "vendor")
GENERATED_FOLDERS = (".next", ".nuxt", "build", "coverage", "dist", "generated", "htmlcov", "out")
LOCKFILES = ("cargo.lock", "composer.lock", "gemfile.lock", "package-lock.json", "pnpm-lock.yaml", "poetry.lock", "uv.lock", "yarn.lock")
FOLDER_ROLES = {
    "vendor": VENDOR_FOLDERS,
    "generated": GENERATED_FOLDERS,
    "test": TEST_FOLDERS,
    "docs": ("docs", "doc", "documentation"),
    "config": ("config", "configs", ".config"),
    "scripts": ("scripts", "script", "tools", "bin"),
    "assets": ("assets", "asset", "images", "img", "public", "static"),
    "source": ("src", "source", "sources", "lib", "app"),
}
LANGUAGES = {"py": "python", "js": "javascript", "jsx": "javascript", "ts": "typescript", "tsx": "typescript", "go": "go", "java": "java", "rs": "rust", "md": "markdown", "yml": "yaml", "yaml": "yaml", "json": "json", "html": "html", "css": "css"}


def _parts(path: Column) -> Column:
    return F.split(F.lower(F.translate(path, "\\", "/")), "/")


def _name(path: Column) -> Column:
    return F.element_at(_parts(path), -1)


def _stem(path: Column) -> Column:
    return F.regexp_replace(_name(path), r"(?<=.)\.[^.]*$", "")


def in_folder(path: Column, names) -> Column:
    """Whether a folder above the file has one of the names."""
    folders = F.slice(_parts(path), F.lit(1), F.size(_parts(path)) - 1)
    return F.arrays_overlap(folders, F.array(*[F.lit(n) for n in names]))


def is_test_path(path: Column) -> Column:
    return in_folder(path, TEST_FOLDERS) | _stem(path).rlike(r"^test_|_test$|\.test$|\.spec$")


def is_generated_path(path: Column) -> Column:
    named = _name(path).isin(*LOCKFILES) | _name(path).contains(".min.") | _name(path).contains(".generated.")
    return in_folder(path, GENERATED_FOLDERS + VENDOR_FOLDERS) | named | _stem(path).rlike(r"_generated$|_pb2$|\.designer$|\.g$")


def folder_role(path: Column) -> Column:
    """The first role of FOLDER_ROLES that a folder has, else ``root`` or ``other``."""
    role = F.when(F.size(_parts(path)) == 1, "root").otherwise("other")
    for name, folders in reversed(FOLDER_ROLES.items()):
        role = F.when(in_folder(path, folders), name).otherwise(role)
    return role


def language(path: Column) -> Column:
    known = F.create_map(*[F.lit(x) for pair in LANGUAGES.items() for x in pair])
    return F.element_at(known, F.regexp_extract(_name(path), r"\.([a-z]+)$", 1))


def bins(value: Column, limits: dict[str, float], last: str) -> Column:
    """The first name whose limit the value does not pass, in the order given."""
    out = F.lit(last)
    for name, limit in reversed(limits.items()):
        out = F.when(value <= limit, name).otherwise(out)
    return out


def size_class(files: Column) -> Column:
    return bins(files, {"small": 100, "medium": 1000, "large": 5000}, "very_large")


def risk_level(direct: Column, transitive: Column) -> Column:
    """By all dependents: none is low, up to two medium, more high."""
    return bins(F.greatest(direct, transitive), {"low": 0, "medium": 2}, "high")


def confidence(score: Column, high: float = 0.7, medium: float = 0.4) -> Column:
    return F.when(score >= high, "high").when(score >= medium, "medium").otherwise("low")


def relevance_band(score: Column) -> Column:
    """Like :func:`confidence`, but what has no relevance at all is unknown."""
    return F.when(score > 0, confidence(score)).otherwise("unknown")


def analysis_cost(size: Column, is_test: Column, generated: Column) -> Column:
    kib = 1024
    by_size = F.when(size <= 16 * kib, 1).when(size <= 128 * kib, 2).when(size <= 512 * kib, 4).when(size <= 2048 * kib, 8).otherwise(16)
    return (by_size + is_test.cast("int") + 20 * generated.cast("int")).cast("long")


def value_score(score: Column, cost: Column) -> Column:
    """Score by cost, so that a costly low score is not rewarded."""
    return F.when(score >= 0, F.bround(score / cost, 6)).otherwise((score * cost).cast("double"))
