"""Normal forms of values, digests and decisions, as native columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: names that a secret has
SECRET_KEYWORDS = ("api_key", "apikey", "auth", "credential", "password", "passwd", "private_key", "secret", "token")
REDACTED = "[redacted]"
_URL = r"^(?i)(https?|wss?)://(?:([^/?#@]*)@)?([^/?#:@]+)(?::([0-9]+))?([^?#]*)(\?[^#]*)?(#.*)?$"


def reference_url(value: Column) -> Column:
    """An http, https, ws or wss address in its normal form; null for others and for those with credentials.

    Scheme and host are lower-case, loopback hosts are ``localhost``, a path of one slash with nothing after it goes.
    """
    part = [F.regexp_extract(F.trim(value), _URL, i) for i in range(8)]
    host = F.regexp_replace(F.lower(part[3]), r"^(127\.[0-9.]+|0\.0\.0\.0)$", "localhost")
    port = F.when(part[4] != "", F.concat(F.lit(":"), part[4].cast("long").cast("string"))).otherwise("")
    bare = (part[5] == "/") & (part[6] == "") & (part[7] == "")
    path = F.when(bare, "").otherwise(part[5])
    return F.when((part[1] != "") & (part[2] == ""), F.concat(F.lower(part[1]), F.lit("://"), host, port, path, part[6], part[7]))


def port_of(value: Column) -> Column:
    """A port from its digits or from an address that names one; null for none and outside 1 to 65535."""
    bare = F.trim(value)
    port = F.when(bare.rlike(r"^[0-9]{1,9}$"), bare.try_cast("long")).otherwise(F.regexp_extract(reference_url(bare), r"^[a-z]+://[^/?#:]+:([0-9]+)", 1).try_cast("long"))
    return F.when((port >= 1) & (port <= 65535), port)


def contract_value(value: Column, how: str) -> Column:
    """A typed key of a contract's value: exact, case_insensitive, trimmed, url or port; null if it has no such form."""
    made = {
        "exact": lambda: F.concat(F.lit("str:"), value),
        "case_insensitive": lambda: F.concat(F.lit("str:"), F.lower(value)),
        "trimmed": lambda: F.concat(F.lit("str:"), F.trim(value)),
        "url": lambda: F.concat(F.lit("str:"), reference_url(value)),
        "port": lambda: F.concat(F.lit("int:"), port_of(value).cast("string")),
    }
    return made[how]()


def is_secret_key(key: Column) -> Column:
    bare = F.translate(F.lower(key), "-", "_")
    hit = F.lit(False)
    for word in SECRET_KEYWORDS:
        hit = hit | bare.contains(word)
    return hit


def redacted_map(values: Column) -> Column:
    """A map of strings with the values of secret keys masked."""
    return F.transform_values(values, lambda k, v: F.when(is_secret_key(k), REDACTED).otherwise(v))


def stable_digest(fields: dict[str, Column]) -> Column:
    """SHA-256 of the canonical JSON: the fields in the order of their names, without spaces."""
    return F.sha2(F.to_json(F.struct(*[fields[k].alias(k) for k in sorted(fields)]), {"ignoreNullFields": "false"}), 256)


def is_expired(created: Column, now: Column, most_seconds: float) -> Column:
    """Whether a time is further back than ``most_seconds``; unknown times count as expired."""
    return F.coalesce(F.unix_micros(now.cast("timestamp")) - F.unix_micros(created.cast("timestamp")) > most_seconds * 1_000_000, F.lit(True))


def snapshot_name(ts: Column) -> Column:
    return F.date_format(ts, "yyyyMMdd_HHmmss")


def line_of_offset(text: Column, offset: Column) -> Column:
    """Number (from 1) of the line that holds a character."""
    before = F.substr(text, F.lit(1), offset)
    return (F.char_length(before) - F.char_length(F.replace(before, F.lit("\n"), F.lit(""))) + 1).cast("long")


def snippet(text: Column, first: int, last: int, most_lines: int, most_chars: int) -> Column:
    """``{snippet, truncated}``: lines ``first`` to ``last``, cut to so many lines and characters."""
    wanted = F.slice(F.split(text, "\n"), first, last - first + 1)
    kept = F.array_join(F.slice(wanted, 1, most_lines), "\n")
    return F.struct(F.substr(kept, F.lit(1), F.lit(most_chars)).alias("snippet"), ((F.size(wanted) > most_lines) | (F.char_length(kept) > most_chars)).alias("truncated"))


def token_allocation(target: int, reserved: int, safety: float, most_pack: int, share: float) -> int:
    """Tokens of one part of a pack: a share of what is usable, 1 at least."""
    return max(1, int((min(most_pack, target - reserved) - int(target * safety)) * share))


def reuse_reasons(before: dict[str, Column], after: dict[str, Column], expired: Column) -> Column:
    """Why a cached state can't be reused, in a fixed order; none if it can. The dicts have equal keys."""
    changed = [F.when(~before[k].eqNullSafe(after[k]), f"{k}_changed") for k in before]
    return F.array_compact(F.array(*changed, F.when(expired, "too_old")))


def drift_status(during: Column, since: Column, files: Column, has_previous: Column) -> Column:
    """fresh, partial (changed during the scan) or stale (massively, above 500 files or a tenth; or since the last one)."""
    massive = (during > 500) | ((files > 0) & (during / files > 0.1))
    return F.when((during == 0) & (since == 0), "fresh").when(massive, "stale").when(during > 0, "partial").when(has_previous & (since > 0), "stale").otherwise("fresh")


def readiness(status: Column) -> Column:
    known = F.lower(F.trim(status))
    return F.when(known.isin("fresh", "interrupted", "partial", "stale"), known).otherwise("missing")
