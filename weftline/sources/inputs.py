"""Small documents that steer a run: configuration, wrapper declarations, listings of tracked files."""

from __future__ import annotations

import json
from dataclasses import dataclass, fields

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.reach import Retention

MAX_BYTES = 1 << 20
LANGUAGES = ("swift", "kotlin", "dart", "js", "go", "rust", "python")
WRAPPER_KEYS = {"language", "kind", "owner", "name", "methodArg", "pathArg", "defaultMethod", "methodEnum", "pathAnchor", "service"}
WRAPPERS = "language string, kind string, owner string, name string, methodArg string, pathArg string, defaultMethod string, pathAnchor string, service string, pathSuffix array<string>"


@dataclass(frozen=True)
class Config:
    """What a run takes from its configuration; unknown keys and wrong types are refused."""

    include: tuple[str, ...] = ()
    exclude: tuple[str, ...] = ()
    level: str = "module"
    layers: tuple[tuple[str, tuple[str, ...]], ...] = ()
    retention: Retention = Retention()
    strict: bool = False
    limit: int | None = None


def read_config(text: str) -> Config:
    """A configuration from JSON: {"include": [..], "layers": {name: [globs]}, "retention": {..}, ...}."""
    doc = json.loads(text)
    known = {f.name for f in fields(Config)}
    if not isinstance(doc, dict) or (odd := sorted(set(doc) - known)):
        raise ValueError(f"unknown configuration: {odd if isinstance(doc, dict) else type(doc).__name__}")
    out = dict(doc)
    for key in ("include", "exclude"):
        if key in out:
            if not isinstance(out[key], list) or not all(isinstance(x, str) for x in out[key]):
                raise ValueError(f"{key} must be a list of patterns")
            out[key] = tuple(out[key])
    if "layers" in out:
        out["layers"] = tuple((name, tuple(globs)) for name, globs in out["layers"].items())
    if "retention" in out:
        plain = {k: tuple(v) if isinstance(v, list) else v for k, v in out["retention"].items()}
        if odd := sorted(set(plain) - {f.name for f in fields(Retention)}):
            raise ValueError(f"unknown retention options: {odd}")
        out["retention"] = Retention(**plain)
    if out.get("level", "module") not in ("module", "file", "type", "symbol"):
        raise ValueError(f"unknown level: {out['level']}")
    return Config(**out)


def read_wrappers(spark: SparkSession, text: str) -> DataFrame:
    """Declared HTTP wrappers of a version 1 or 2 document, at most 1 MiB; any fault refuses the whole document."""
    if len(text.encode()) > MAX_BYTES:
        raise ValueError("wrapper declarations are too large")
    doc = json.loads(text)
    if not isinstance(doc, dict) or set(doc) - {"format", "version", "wrappers"} or doc.get("format") != "http-wrappers" or doc.get("version") not in (1, 2) or not isinstance(doc.get("wrappers"), list):
        raise ValueError("expected http-wrappers of version 1 or 2")
    allowed = WRAPPER_KEYS | ({"pathSuffix"} if doc["version"] == 2 else set())
    one_of = {"language": LANGUAGES, "kind": ("constructor", "function"), "pathAnchor": ("root", "base")}
    rows = []
    for k, w in enumerate(doc["wrappers"]):
        if not isinstance(w, dict) or set(w) - allowed:
            raise ValueError(f"wrappers[{k}]: unknown fields")
        for field in ("language", "kind", "owner", "name", "pathAnchor", "pathArg"):
            if w.get(field) in (None, "") or (field in one_of and w[field] not in one_of[field]):
                raise ValueError(f"wrappers[{k}]: {field} is missing or not allowed")
        if w.get("methodArg") is None and w.get("defaultMethod") is None:
            raise ValueError(f"wrappers[{k}]: no verb")
        if any(set(p) not in ({"literal"}, {"argument", "shape"}) for p in w.get("pathSuffix", [])):
            raise ValueError(f"wrappers[{k}]: pathSuffix")
        shown = lambda v: None if v is None else v if isinstance(v, str) else json.dumps(v, sort_keys=True)
        rows.append(tuple(shown(w.get(c)) for c in ("language", "kind", "owner", "name", "methodArg", "pathArg", "defaultMethod", "pathAnchor", "service")) + ([json.dumps(p, sort_keys=True) for p in w.get("pathSuffix", [])],))
    return spark.createDataFrame(rows, WRAPPERS)


def tracked_files(listing: DataFrame) -> DataFrame:
    """path, stage of a ``ls-files --stage -z`` listing (column ``value``, one text): what version control tracks.

    The process that lists is not started here; a path in several merge stages is there once.
    """
    entry = listing.select(F.explode(F.split("value", "\\x00")).alias("e")).where("e <> ''")
    parts = entry.select(F.regexp_extract("e", r"^[0-7]{6} [0-9a-f]+ ([0-3])\t", 1).cast("int").alias("stage"), F.regexp_extract("e", r"(?s)^[^\t]*\t(.*)$", 1).alias("path"))
    return parts.groupBy("path").agg(F.min("stage").alias("stage"))
