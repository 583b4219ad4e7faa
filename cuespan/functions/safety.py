"""Checks on paths and names that come from outside, and masking of personal data."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def looks_like_url(src: Column) -> Column:
    """``scheme://`` anywhere, or a colon in the first path piece that is not a drive letter."""
    head = F.regexp_extract(src, r"^([^\\/]*)", 1)
    return F.contains(src, F.lit("://")) | (
        F.contains(head, F.lit(":")) & ~head.rlike(r"^[A-Za-z]:?$")
    )


def normal_path(path: Column) -> Column:
    """Absolute path with ``.``, ``..`` and doubled slashes folded."""
    pieces = F.filter(F.split(path, "/"), lambda p: (p != "") & (p != "."))
    kept = F.aggregate(
        pieces,
        F.array().cast("array<string>"),
        lambda acc, p: F.when(
            p == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))
        ).otherwise(F.concat(acc, F.array(p))),
    )
    return F.concat(F.lit("/"), F.array_join(kept, "/"))


def source_ok(src: Column, root: str | None = None) -> Column:
    """A usable local source; with ``root`` it must also lie at or below that folder."""
    ok = src.isNotNull() & (src != "") & ~looks_like_url(src)
    if root is not None:
        base = root.rstrip("/")
        p = normal_path(src)
        ok = ok & F.startswith(src, F.lit("/")) & ((p == base) | F.startswith(p, F.lit(base + "/")))
    return F.coalesce(ok, F.lit(False))


def safe_component(value: Column) -> Column:
    """One path piece: no separators, colons, control characters, at most 255 bytes."""
    ok = (
        (value != "")
        & ~value.isin(".", "..")
        & ~value.rlike(r"[/\\:\x00-\x1f\x7f]")
        & (F.octet_length(value) <= 255)
    )
    return F.coalesce(ok, F.lit(False))


def safe_session(value: Column) -> Column:
    ok = (
        (value != "")
        & ~value.isin(".", "..")
        & ~value.rlike(r"[/\\\x00-\x1f]")
        & (F.length(value) <= 80)
    )
    return F.coalesce(ok, F.lit(False))


def tenant_ok(value: Column) -> Column:
    return F.coalesce(F.btrim(value).rlike(r"^[A-Za-z0-9_-]{1,32}$"), F.lit(False))


def glob_pattern(pattern: str) -> str:
    """Regex of a ``*``/``?`` file-name pattern."""
    out = []
    for ch in pattern:
        out.append(".*" if ch == "*" else "." if ch == "?" else "\\" + ch if not ch.isalnum() else ch)
    return "(?s)^" + "".join(out) + "$"


def excluded(rel: Column, patterns: Sequence[str]) -> Column:
    """``dir/`` matches a path piece anywhere, other patterns match the last piece."""
    pieces = F.split(rel, "/")
    name = F.element_at(pieces, -1)
    out = F.lit(False)
    for p in patterns:
        hit = F.array_contains(pieces, p[:-1]) if p.endswith("/") else name.rlike(glob_pattern(p))
        out = out | hit
    return out


def localize(value: Column, remote_root: str, folder: Column) -> Column:
    """A path below the remote root becomes the same file name in the local folder."""
    return F.when(
        F.startswith(value, F.lit(remote_root + "/")),
        F.concat(folder, F.lit("/"), F.regexp_extract(value, r"([^/]*)$", 1)),
    ).otherwise(value)


_PHONE = r"(?<!\d)(1[3-9]\d)(\d{4})(\d{4})(?!\d)"
_TOKEN = r"(sk-[A-Za-z0-9]{8,}|Bearer\s+[A-Za-z0-9._\-]{8,})"


def mask_phone(text: Column) -> Column:
    return F.regexp_replace(text, _PHONE, "$1****$3")


def redact(text: Column) -> Column:
    return F.regexp_replace(mask_phone(text), _TOKEN, "<已脱敏>")


def mask_uid(uid: Column) -> Column:
    s = F.coalesce(uid.cast("string"), F.lit(""))
    return F.when(F.length(s) <= 10, s).otherwise(
        F.concat(F.substring(s, 1, 6), F.lit("…"), F.right(s, F.lit(4)))
    )
