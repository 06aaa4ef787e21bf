"""Column functions on names, paths, tasks and budgets."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: words of a task that say nothing about its subject
TASK_STOP_WORDS = ("a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "in", "into", "is", "it", "of", "on", "or", "the", "this", "to", "with", "add", "change", "create", "delete", "do", "edit", "fix", "improve", "implement", "make", "modify", "remove", "replace", "rewrite", "task", "update", "upgrade")
# fixed value: characters of a token in the first estimate
CHARS_PER_TOKEN = 3.3


def tokens(text: Column) -> Column:
    """Lower-case runs of ASCII letters and digits, in order."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"([a-z0-9]+)"), 1)


def name_tokens(name: Column) -> Column:
    """Tokens of an identifier, also cut where a capital follows a small letter or digit."""
    return tokens(F.regexp_replace(name, r"([a-z0-9])([A-Z])", "$1 $2"))


def task_terms(task: Column) -> Column:
    """Distinct tokens of more than two characters that are no stop words, in the order of first sight."""
    kept = F.filter(tokens(task), lambda x: (F.char_length(x) > 2) & ~x.isin(*TASK_STOP_WORDS))
    return F.array_distinct(kept)


def phrases(terms: Column) -> Column:
    """All pairs, then all triples, of consecutive terms, joined by a space."""
    n = F.size(terms)

    def runs(k: int) -> Column:
        made = F.transform(F.sequence(F.lit(1), n - k + 1), lambda i: F.array_join(F.slice(terms, i, F.lit(k)), " "))
        return F.when(n >= k, made).otherwise(F.array().cast("array<string>"))

    return F.array_distinct(F.concat(runs(2), runs(3)))


def estimate_tokens(chars: Column) -> Column:
    """Characters by CHARS_PER_TOKEN, rounded up; 0 for none."""
    return F.ceil(chars.cast("double") / F.lit(CHARS_PER_TOKEN)).cast("long")


def estimate_tokens_conservative(chars: Column) -> Column:
    """A third of the characters, rounded up; 0 for none."""
    return F.floor((chars + 2) / 3).cast("long")


def efficiency_percent(full: Column, focused: Column) -> Column:
    """Whole percent saved by the focused text; 0 if it is not smaller."""
    return F.when((full > 0) & (focused <= full), F.floor((full - focused) * 100 / full)).otherwise(0).cast("long")


def route_path(path: Column) -> Column:
    """A route without query or fragment, with one slash in front, none doubled and none at the end."""
    bare = F.regexp_replace(F.regexp_replace(F.coalesce(path, F.lit("")), r"[?#].*$", ""), "/+", "/")
    led = F.when(bare.startswith("/"), bare).otherwise(F.concat(F.lit("/"), bare))
    return F.when(led == "/", led).otherwise(F.regexp_replace(led, "/$", ""))


def url_host(url: Column) -> Column:
    """Lower-case host (with port, without user) of an http, https, ws or wss address; else null."""
    host = F.regexp_extract(F.lower(url), r"^(?:https?|wss?)://([^/?#@]+)(?:[/?#]|$)", 1)
    return F.when(host != "", F.regexp_replace(host, r"^(127\.0\.0\.1|0\.0\.0\.0)(:|$)", "localhost$2"))


def url_path(url: Column) -> Column:
    """The normalised path of an address."""
    return route_path(F.regexp_extract(url, r"^[a-zA-Z]+://[^/?#]*([^?#]*)", 1))


def short_id(*parts: Column) -> Column:
    """The first 16 hex digits of the SHA-256 of the parts, joined by a bar; nulls are empty."""
    return F.substring(F.sha2(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]), 256), 1, 16)


def secret_like(value: Column) -> Column:
    """Key blocks, authorisation headers and long unbroken tokens."""
    return F.coalesce(value.rlike(r"-----BEGIN|(?i)^(bearer|basic)\s+\S|^[A-Za-z0-9+/_=-]{32,}$"), F.lit(False))


def template_matches(template: Column, path: Column) -> Column:
    """Whether a path fits a template of equal length; ``:x`` and ``{x}`` segments fit anything."""
    pairs = F.arrays_zip(F.split(template, "/").alias("t"), F.split(path, "/").alias("p"))
    fits = F.forall(pairs, lambda x: (x["t"] == x["p"]) | x["t"].rlike(r"^(:.+|\{.+\})$"))
    return (F.size(F.split(template, "/")) == F.size(F.split(path, "/"))) & fits


def line_slice(text: Column, first: int, count: int) -> Column:
    """``count`` lines from line ``first`` (1 is the first)."""
    return F.array_join(F.slice(F.split(text, "\n"), first, count), "\n")
