"""Scalar functions as native expressions: globs, path filters, names, URLs, masks."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


def _segment(glob: str) -> str:
    return "".join("[^/]*" if c == "*" else "[^/]" if c == "?" else re.escape(c) for c in re.sub(r"\*+", "*", glob))


def glob_regex(pattern: str) -> str:
    """An anchored regex for a path with ``/`` appended.

    Without ``/`` the pattern fits any one non-empty component, so a folder takes all below it; with it,
    components match in order, ``*`` and ``?`` inside a component and ``**`` over any number of them.
    """
    if "/" not in pattern:
        return rf"(?s)^(?:[^/]*/)*(?=[^/]){_segment(pattern)}/(?:[^/]*/)*$"
    parts = []
    for s in pattern.split("/"):
        if s == "**":
            if not parts or parts[-1] != "(?:[^/]*/)*":
                parts.append("(?:[^/]*/)*")
        else:
            parts.append(_segment(s) + "/")
    return "(?s)^" + "".join(parts) + "$"


def glob_match(value: Column, pattern: str) -> Column:
    return F.concat(value, F.lit("/")).rlike(glob_regex(pattern))


def any_glob(value: Column, patterns: list[str] | tuple[str, ...]) -> Column:
    """All patterns as one alternation: one regex pass, whatever their number."""
    if not patterns:
        return F.lit(False)
    return F.concat(value, F.lit("/")).rlike("|".join(f"(?:{glob_regex(p)})" for p in patterns))


@dataclass(frozen=True)
class PathFilter:
    """Excludes win. Includes are tried on the path as given and relative to ``root``; an exclude that is not
    absolute only on the relative form."""

    include: tuple[str, ...] = ()
    exclude: tuple[str, ...] = ()
    root: str = ""

    def allows(self, path: Column) -> Column:
        root = self.root.rstrip("/") + "/"
        relative = F.when(path.startswith(root), F.substring(path, F.lit(len(root) + 1), F.length(path))).otherwise(path) if self.root else path
        absolute_ex = tuple(p for p in self.exclude if p.startswith("/"))
        removed = any_glob(path, absolute_ex) | any_glob(relative, self.exclude)
        kept = (any_glob(path, self.include) | any_glob(relative, self.include)) if self.include else F.lit(True)
        return ~removed & kept


def base_name(name: Column) -> Column:
    """Without the parameter list and trailing ``?`` or ``!``."""
    return F.regexp_replace(F.regexp_replace(name, r"(?s)\(.*$", ""), r"[?!]+$", "")


def qualified_name(module: Column, name: Column) -> Column:
    return F.when(F.coalesce(module, F.lit("")) == "", name).otherwise(F.concat_ws(".", module, name))


def last_component(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def printable(text: Column) -> Column:
    """Control characters as ``\\u{XX}``-style escapes, backslashes doubled."""
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for code in (*range(0, 32), 127):
        out = F.replace(out, F.lit(chr(code)), F.lit(f"\\u{{{code:X}}}"))
    return out


SCHEME = r"^[A-Za-z][A-Za-z0-9+.\-]{0,60}://"


def url_authority(url: Column) -> Column:
    """Lower-cased host and port after the scheme, without user information; null without a scheme."""
    raw = F.regexp_extract(url, SCHEME + r"([^/?#]*)", 1)
    return F.when(url.rlike(SCHEME), F.lower(F.regexp_replace(raw, r"^.*@", "")))


def url_path(url: Column) -> Column:
    path = F.regexp_extract(url, SCHEME + r"[^/?#]*([^?#]*)", 1)
    return F.when(url.rlike(SCHEME), F.when(path == "", "/").otherwise(path))


def query_stripped(url: Column) -> Column:
    return F.when(url.rlike(SCHEME), url.rlike(r"[?#]"))


def mask_secrets(template: Column, authority: Column) -> Column:
    """Secret-like segments as ``{}``: those of webhook hosts, and any of 16 characters or more with a letter
    and a digit; segments that hold a parameter stay. ``template`` starts with a slash."""
    segments = F.split(F.substring(template, F.lit(2), F.length(template)), "/")
    start = (
        F.when(authority == "hooks.slack.com", 0)
        .when(authority.isin("discord.com", "discordapp.com") & (F.get(segments, F.lit(0)) == "api") & (F.get(segments, F.lit(1)) == "webhooks"), 2)
        .otherwise(1 << 30)
    )

    def mask(s: Column, i: Column) -> Column:
        plain = F.regexp_replace(s, r"%[0-9A-Fa-f]{2}", "%")
        letter = F.regexp_replace(s, r"%[0-9A-Fa-f]{2}", "").rlike("[A-Za-z]") | s.rlike(r"%(4[1-9A-Fa-f]|5[0-9Aa]|6[1-9A-Fa-f]|7[0-9Aa])")
        digit = F.regexp_replace(s, r"%[0-9A-Fa-f]{2}", "").rlike("[0-9]") | s.rlike(r"%3[0-9]")
        secret = (i >= start) | ((F.length(plain) >= 16) & letter & digit)
        return F.when(~s.contains("{") & secret, F.lit("{}")).otherwise(s)

    return F.concat(F.lit("/"), F.array_join(F.transform(segments, mask), "/"))


def key_path_valid(path: Column) -> Column:
    """At most 512 bytes and 16 ASCII identifiers; a leading SELF is dropped first."""
    parts = F.split(F.regexp_replace(path, r"^SELF\.", ""), r"\.")
    return (F.octet_length(path) <= 512) & (F.size(parts) <= 16) & F.forall(parts, lambda p: p.rlike(r"^[A-Za-z_][A-Za-z0-9_]*$"))
