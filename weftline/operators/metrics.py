"""Coupling metrics and zones."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.schemas import SOURCE_KINDS
from .graph import degrees

TOLERANCE = 0.3


def composition(symbols: DataFrame, key: str = "module") -> DataFrame:
    """Types of each module; only protocols are abstract."""
    is_type = F.col("kind").isin("class", "struct", "enum", "protocol")
    return symbols.groupBy(F.col(key).alias("id")).agg(F.count_if(is_type).alias("types"), F.count_if(F.col("kind") == "protocol").alias("abstract_types"))


def coupling(nodes: DataFrame, edges: DataFrame, types: DataFrame | None = None) -> DataFrame:
    """id, ca, ce, instability, abstractness, distance, zone.

    Coupling counts distinct neighbours over source dependencies. An isolated node has instability 0 and its
    own zone; the others are in pain or useless beyond the tolerance from the main sequence, strictly.
    """
    d = degrees(nodes, edges, SOURCE_KINDS).select("id", F.col("in_degree").alias("ca"), F.col("out_degree").alias("ce"))
    if types is None:
        d = d.withColumns({"types": F.lit(0).cast("long"), "abstract_types": F.lit(0).cast("long")})
    else:
        d = d.join(types, "id", "left").fillna(0, ["types", "abstract_types"])
    total = F.col("ca") + F.col("ce")
    d = d.withColumn("instability", F.when(total > 0, F.col("ce") / total).otherwise(0.0))
    d = d.withColumn("abstractness", F.when(F.col("types") > 0, F.col("abstract_types") / F.col("types")).otherwise(0.0))
    d = d.withColumn("distance", F.abs(F.col("abstractness") + F.col("instability") - 1))
    zone = (
        F.when(total == 0, "isolated")
        .when((F.col("distance") > TOLERANCE) & (F.col("abstractness") + F.col("instability") < 1), "pain")
        .when(F.col("distance") > TOLERANCE, "useless")
        .otherwise("main-sequence")
    )
    return d.withColumn("zone", zone)


def ordered(metrics: DataFrame) -> DataFrame:
    return metrics.orderBy(F.col("zone") == "isolated", F.desc("distance"), "id")


def above(metrics: DataFrame, limit: float) -> DataFrame:
    """Modules whose distance exceeds a limit; isolated ones are no evidence."""
    return metrics.where((F.col("zone") != "isolated") & (F.col("distance") > limit))
