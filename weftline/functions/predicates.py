"""Key paths that a predicate format compares: a small grammar, read by descent; what it does not know is unread."""

from __future__ import annotations

import math
import re

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

MAX_BYTES, MAX_TOKENS, MAX_DEPTH = 4096, 256, 16
SYMBOLS = {"=", "==", "!=", "<>", "<", "<=", ">", ">="}
OPERATORS = {"BEGINSWITH", "ENDSWITH", "CONTAINS", "LIKE", "MATCHES", "IN", "BETWEEN"}
CONSTANTS = {"TRUE", "FALSE", "YES", "NO", "NIL", "NULL", "SELF"}
UNKNOWN = {"AND", "OR", "NOT", "ANY", "ALL", "NONE", "SOME", "SUBQUERY", "FUNCTION", "CAST", "TRUEPREDICATE", "FALSEPREDICATE", "NAN", "INF"}
_TOKEN = re.compile(
    r"""(?P<space>\s+)|(?P<paren>[()])|(?P<text>'(?:\\.|[^'\\])*'|"(?:\\.|[^"\\])*")|%(?P<hole>[@K])|\[(?P<flag>c|d|cd|dc)\]
    |(?P<symbol>[=!<>]+)|(?P<number>[0-9+\-][0-9.eE+\-]*)|(?P<word>[A-Za-z_][A-Za-z0-9_.]*)""",
    re.X | re.S,
)
_NAME = re.compile(r"[A-Za-z_][A-Za-z0-9_]*\Z")


def _tokens(text: str) -> list[tuple[str, str]] | None:
    out, at = [], 0
    while at < len(text):
        m = _TOKEN.match(text, at)
        if m is None:
            return None
        at, kind, value = m.end(), m.lastgroup, m.group(m.lastgroup)
        if kind == "symbol":
            if value not in SYMBOLS:
                return None
            kind = "compare"
        elif kind == "number":
            try:
                if not math.isfinite(float(value)):
                    return None
            except ValueError:
                return None
            kind = "text"
        elif kind == "word" and value.upper() in OPERATORS:
            kind = "compare"
        if kind != "space":
            out.append((kind, value))
    return out


def path_parts(path: str) -> list[str] | None:
    """Identifiers of a key path (at most 512 bytes and 16 of them, a leading SELF dropped), or None."""
    parts = path.removeprefix("SELF.").split(".")
    return parts if len(path.encode()) <= 512 and len(parts) <= 16 and all(map(_NAME.match, parts)) else None


def key_paths(text: str | None, arguments: list[str | None] | None = None) -> list[str] | None:
    """The key paths of a predicate, sorted, each once; None where any part of it is not understood."""
    if text is None or len(text.encode()) > MAX_BYTES:
        return None
    found = _tokens(text)
    if found is None or len(found) > MAX_TOKENS:
        return None
    given, paths, at = iter(arguments or ()), set(), 0

    def word(value: str) -> bool:
        nonlocal at
        hit = at < len(found) and found[at][0] == "word" and found[at][1].upper() == value
        at += hit
        return hit

    def note(path: str | None) -> bool:
        parts = None if path is None else path_parts(path)
        if parts is not None:
            paths.add(".".join(parts))
        return parts is not None

    def operand() -> bool:
        nonlocal at
        if at >= len(found):
            return False
        (kind, value), at = found[at], at + 1
        if kind == "hole":
            try:
                argument = next(given)
            except StopIteration:
                return False
            return value == "@" or note(argument)
        if kind != "word":
            return kind == "text"
        return value.upper() in CONSTANTS or (value.upper() not in UNKNOWN and note(value))

    def term(depth: int) -> bool:
        nonlocal at
        if depth > MAX_DEPTH:
            return False
        if word("NOT"):
            return term(depth + 1)
        if at < len(found) and found[at] == ("paren", "("):
            at += 1
            if not either(depth + 1) or at >= len(found) or found[at] != ("paren", ")"):
                return False
            at += 1
            return True
        if word("TRUEPREDICATE") or word("FALSEPREDICATE"):
            return True
        if not operand() or at >= len(found) or found[at][0] != "compare":
            return False
        at += 1
        at += at < len(found) and found[at][0] == "flag"
        return operand()

    def chain(part, joiner: str, depth: int) -> bool:  # noqa: ANN001
        good = part(depth)
        while good and word(joiner):
            good = part(depth)
        return good

    def either(depth: int) -> bool:
        return chain(lambda d: chain(term, "AND", d), "OR", depth)

    return sorted(paths) if either(0) and at == len(found) else None


@F.pandas_udf(T.ArrayType(T.StringType()))
def predicate_key_paths(text: pd.Series, arguments: pd.Series) -> pd.Series:
    """``arguments``: array of the format's arguments, null where one is not a known text."""
    return pd.Series([key_paths(t, None if a is None else list(a)) for t, a in zip(text, arguments, strict=True)])
