"""Exact route template rules, batched through Arrow: validation order and percent rules are sequential."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

UNRESERVED = set("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-._~")
LITERAL = UNRESERVED | set("!$&'()*+,;=:@")
HEX = set("0123456789abcdefABCDEF")
METHODS = ("GET", "HEAD", "POST", "PUT", "PATCH", "DELETE", "OPTIONS", "TRACE")


def _segment_problem(s: str) -> str | None:
    seen, i = False, 0
    while i < len(s):
        c = s[i]
        if c == "{":
            if s.startswith("{**}", i):
                return "catch-all-partial"
            if s[i + 1 : i + 2] != "}":
                return "stray-brace"
            if seen:
                return "multiple-parameters"
            seen, i = True, i + 2
        elif c == "}":
            return "stray-brace"
        elif c == "%":
            pair = s[i + 1 : i + 3]
            if len(pair) < 2 or not set(pair) <= HEX:
                return "malformed-percent"
            if pair != pair.upper():
                return "lowercase-percent-hex"
            if chr(int(pair, 16)) in UNRESERVED:
                return "encoded-unreserved"
            i += 3
        elif c not in LITERAL:
            return "invalid-character"
        else:
            i += 1
    return None


def validate(template: str | None) -> str | None:
    """The first rejection code of a route template, or none."""
    if template is None:
        return None
    if len(template.encode("utf-16-le")) // 2 > 2048:
        return "too-long"
    if not template.startswith("/"):
        return "not-rooted"
    parts = template[1:].split("/")
    for k, s in enumerate(parts):
        if s == "{**}":
            if k != len(parts) - 1:
                return "catch-all-not-last"
        elif problem := _segment_problem(s):
            return problem
    return None


def normalize(text: str | None, holes: bool = False) -> str | None:
    """Canonical percent form: encoded unreserved bytes are decoded, others upper-cased, the rest encoded."""
    if text is None:
        return None
    out, i = [], 0
    while i < len(text):
        c = text[i]
        pair = text[i + 1 : i + 3]
        if holes and c == "\0":
            out.append("{}")
        elif c == "%" and len(pair) == 2 and set(pair) <= HEX:
            byte = chr(int(pair, 16))
            out.append(byte if byte in UNRESERVED else "%" + pair.upper())
            i += 2
        elif c in LITERAL or c == "/":
            out.append(c)
        else:
            out.append("".join(f"%{b:02X}" for b in c.encode("utf-8", "surrogatepass")))
        i += 1
    return "".join(out)


def compose(parts: list[tuple[str, str | None]]) -> tuple[str | None, str | None, bool]:
    """(template, known prefix of a dynamic one, query tail cut) of literal, value and tail parts.

    A value fills a whole segment or the route is dynamic. Everything from the first ``?`` or ``#`` is cut.
    """
    kept, cut = [], False
    for kind, text in parts:
        at = min((i for i in (text.find("?"), text.find("#")) if i >= 0), default=-1) if kind == "literal" else -1
        if at >= 0:
            if at:
                kept.append((kind, text[:at]))
            cut = True
            break
        kept.append((kind, text))
    while kept and kept[-1][0] == "tail":
        kept.pop()
        cut = True
    text = ""
    for k, (kind, part) in enumerate(kept):
        if kind == "literal":
            text += part.replace("\0", "%00")
            continue
        closes = k + 1 == len(kept) or (kept[k + 1][0] == "literal" and kept[k + 1][1].startswith("/"))
        if kind != "value" or not text.endswith("/") or not closes:
            return None, normalize(text, True) if text.startswith("/") else None, cut
        text += "\0"
    return (normalize(text, True), None, cut) if text.startswith("/") else (None, None, cut)


def base_join(join: str, base: str | None, path: str) -> tuple[str | None, str, str | None]:
    """(template, anchor, limitation) of a path joined to a base by rfc3986, slash-join or concatenation."""
    relative, rooted = normalize("/" + path.lstrip("/")), path.startswith("/")
    if join == "rfc3986":
        return (normalize(path), "root", None) if rooted else (relative, "base", None)
    if join == "slash-join":
        return relative, "base", None
    whole = (base or "") + path
    head, sep, rest = whole.partition("://")
    if base is not None and sep and head[:1].isalpha() and all(c.isalnum() or c in "+.-" for c in head):
        for k, c in enumerate(rest):
            if c in "/?#":
                tail = rest[k:]
                end = min((i for i in (tail.find("?"), tail.find("#")) if i >= 0), default=len(tail))
                return normalize(tail[:end] or "/"), "root", None
        return "/", "root", None
    return (normalize(path), "base", None) if rooted else (None, "base", "ambiguous-base-join:")


@F.pandas_udf(T.StringType())
def route_template_problem(s: pd.Series) -> pd.Series:
    return s.map(validate, na_action="ignore")


@F.pandas_udf(T.StringType())
def route_template_normalize(s: pd.Series) -> pd.Series:
    return s.map(normalize, na_action="ignore")


_PARTS = T.StructType([T.StructField("template", T.StringType()), T.StructField("channel_prefix", T.StringType()), T.StructField("query_tail_stripped", T.BooleanType())])


@F.pandas_udf(_PARTS)
def route_compose(parts: pd.Series) -> pd.DataFrame:
    """``parts``: array of struct (kind, text)."""
    rows = [compose([(p["kind"], p["text"]) for p in ps]) for ps in parts]
    return pd.DataFrame(rows, columns=["template", "channel_prefix", "query_tail_stripped"])


@F.pandas_udf(T.StructType([T.StructField(n, T.StringType()) for n in ("template", "anchor", "limitation")]))
def route_base_join(join: pd.Series, base: pd.Series, path: pd.Series) -> pd.DataFrame:
    rows = [base_join(j, b, p) for j, b, p in zip(join, base, path, strict=True)]
    return pd.DataFrame(rows, columns=["template", "anchor", "limitation"])


# ---- declared targets and wrappers, as native expressions

MAX_SUFFIX = 64


def _encoded(text, keep_slash: bool):  # noqa: ANN001, ANN202
    """Percent-encoded but for unreserved characters and, if kept, slashes; ``{}`` stands for a value and stays."""
    out = F.url_encode(text)
    for a, b in (("+", "%20"), ("*", "%2A"), ("%7E", "~"), ("%7B%7D", "{}"), *((("%2F", "/"),) if keep_slash else ())):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def target_route(join, base, path):  # noqa: ANN001, ANN201
    """(template, anchor) of a target's or router's ``path`` under ``base`` (an absolute url, or null where unknown).

    ``join``: moya (an empty path is the base itself), appending-path-component (one slash between, ``?`` and ``#`` of the
    path are text), appending-component (slashes of the path too), relative-to (RFC 3986) or concatenation. The path
    behind a known host is rooted; without one it is anchored at the base.
    """
    scheme = r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*"
    known = F.coalesce(base.rlike(scheme), F.lit(False))
    rest = F.regexp_replace(F.regexp_replace(base, scheme, ""), r"(?s)[?#].*", "")
    under = F.when(known, rest).otherwise("")
    one_slash = lambda tail: F.concat(F.regexp_replace(under, "/$", ""), F.lit("/"), tail)
    component = one_slash(_encoded(F.regexp_replace(path, "^/", ""), True))
    strip = lambda x: F.regexp_replace(x, r"(?s)[?#].*", "")
    whole = F.concat(F.coalesce(base, F.lit("")), path)
    joined = (
        F.when((join == "moya") & (path == ""), F.when(under == "", "/").otherwise(under))
        .when(join.isin("moya", "appending-path-component"), component)
        .when(join == "appending-component", one_slash(_encoded(path, False)))
        .when((join == "relative-to") & path.startswith("/"), strip(path))
        .when(join == "relative-to", F.concat(F.when(under == "", "/").otherwise(F.regexp_replace(under, r"[^/]*$", "")), strip(path)))
        .when(known, F.concat(F.when(F.regexp_replace(strip(whole), scheme, "").startswith("/"), "").otherwise("/"), F.regexp_replace(strip(whole), scheme, "")))
        .otherwise(F.when(path.startswith("/"), strip(path)))
    )
    anchor = F.when(known | ((join == "relative-to") & path.startswith("/")), "root").otherwise("base")
    return F.struct(joined.alias("template"), anchor.alias("anchor"))


def append_suffix(template, segments):  # noqa: ANN001, ANN201
    """(template, channel_prefix): declared suffix ``segments`` (array of text, null for a value) behind a wrapper's path.

    An unknown suffix (null), over 64 segments, and a segment that is empty, ``.``, ``..`` or holds control characters
    leave only the path that is sure, as a prefix.
    """
    bad = F.exists(segments, lambda s: s.isNotNull() & (s.isin("", ".", "..") | s.rlike(r"[\x00-\x1F\x7F-\x9F]")))
    unsure = segments.isNull() | (F.size(segments) > MAX_SUFFIX) | F.coalesce(bad, F.lit(False))
    tail = F.array_join(F.transform(segments, lambda s: F.when(s.isNull(), F.lit("{}")).otherwise(_encoded(s, False))), "/")
    full = F.when(F.size(segments) == 0, template).otherwise(F.concat(template, F.when(template.endswith("/"), "").otherwise("/"), tail))
    return F.struct(F.when(~unsure, full).alias("template"), F.when(unsure, template).alias("channel_prefix"))


def bound_argument(labels, label, index):  # noqa: ANN001, ANN201
    """Where a declared argument stands in a call: at its label, else at its index if that has no label or the same one;
    null if nowhere."""
    at = F.array_position(F.transform(labels, lambda x: F.coalesce(x, F.lit("\0"))), F.coalesce(label, F.lit("\1"))).cast("int") - 1
    there = F.get(labels, index)
    fits = (index < F.size(labels)) & (there.isNull() | there.eqNullSafe(label))
    return F.when(at >= 0, at).when(F.coalesce(fits, F.lit(False)), index)
