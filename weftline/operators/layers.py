"""Layer assignment by ordered globs, and dependency rules between layers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import any_glob, glob_match
from ..sources.schemas import SOURCE_KINDS


def layer_of(value: Column, layers: list[tuple[str, list[str]]]) -> Column:
    """The first layer of an ordered list with a fitting pattern: one expression, no join."""
    out = F.lit(None).cast("string")
    for name, patterns in reversed(layers):
        out = F.when(any_glob(value, patterns), F.lit(name)).otherwise(out)
    return out


def explain_layer(nodes: DataFrame, layers: list[tuple[str, list[str]]], column: str = "id") -> DataFrame:
    """id, layer, pattern: the first pattern in order that fits."""
    tried = [F.when(glob_match(F.col(column), p), F.struct(F.lit(name).alias("layer"), F.lit(p).alias("pattern"))) for name, ps in layers for p in ps]
    return nodes.withColumn("m", F.coalesce(*tried)).select("id", "m.layer", "m.pattern")


def violations(edges: DataFrame, assigned: DataFrame, rules: DataFrame) -> DataFrame:
    """One row per (edge, rule): source, target, kind, rule, from_layer, to_layer, severity.

    ``assigned``: id, layer. ``rules``: name, from, allow, deny, severity. Only source dependencies between two
    assigned, different layers count; a denied layer violates, and so does one outside an allow list.
    """
    a = assigned.where("layer is not null")
    e = edges.where(F.col("kind").isin(*SOURCE_KINDS))
    e = e.join(a.select(F.col("id").alias("source"), F.col("layer").alias("from_layer")), "source").join(a.select(F.col("id").alias("target"), F.col("layer").alias("to_layer")), "target")
    e = e.where("from_layer <> to_layer")
    r = rules.select(F.col("name").alias("rule"), F.col("from").alias("from_layer"), "allow", "deny", "severity")
    broken = F.coalesce(F.array_contains("deny", F.col("to_layer")), F.lit(False)) | (F.col("allow").isNotNull() & ~F.coalesce(F.array_contains("allow", F.col("to_layer")), F.lit(False)))
    return e.join(r, "from_layer").where(broken).select("source", "target", "kind", "rule", "from_layer", "to_layer", "severity")


def unassigned(assigned: DataFrame) -> DataFrame:
    return assigned.where("layer is null").select("id")
