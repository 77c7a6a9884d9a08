"""Written tables that end lineage, and the loop kernel of the iterative operators."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


class Stage:
    """A folder of tables in the shared checkpoint folder (one local process may do without the setting, as tests do);
    ``add`` appends to a named table."""

    def __init__(self, spark: SparkSession, label: str):
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
                raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
            folder = f"file://{os.path.join(tempfile.gettempdir(), 'weftline-stages')}"
            spark.conf.set("spark.checkpoint.dir", folder)
        self.spark, self.base, self._n = spark, f"{folder}/{label}-{uuid.uuid4().hex}", 0

    def keep(self, df: DataFrame) -> DataFrame:
        self._n += 1
        return self.add(f"t{self._n}", df)

    def add(self, name: str, df: DataFrame) -> DataFrame:
        """Appends and returns all rows of the table so far, as one scan; ``rows`` is what was written."""
        self._n += 1
        seen = Observation()
        df.observe(seen, F.count(F.lit(1)).alias("n")).write.parquet(f"{self.base}/{name}/part={self._n}")
        self.rows = seen.get["n"]
        return self.read(name, df.schema)

    def read(self, name: str, schema) -> DataFrame:
        return self.spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(f"{self.base}/{name}")

    def latest(self, name: str, schema) -> DataFrame:
        return self.spark.read.schema(schema).parquet(f"{self.base}/{name}/part={self._n}")


#: A round's rows up to this many go to all executors; of more, both sides of a join are sorted.
FEW_ROWS = 10_000


def large(df: DataFrame) -> DataFrame:
    """``df`` as a side of joins that may grow with the input: they sort. Spark would broadcast it by its size on disk,
    which is far below what then passes through the driver, in every round of a loop again."""
    return df.hint("merge")


def semi_naive(
    seed: DataFrame,
    step: Callable[[DataFrame, DataFrame, int], DataFrame],
    keys: list[str],
    max_rounds: int | None = None,
    label: str = "loop",
) -> tuple[DataFrame, bool]:
    """Least fixpoint of ``seed`` under ``step(new rows, all rows, round)``; (rows, cut short).

    Each round joins only the rows that the last one found, drops known keys, and is written, so plans do
    not grow and a lost executor costs one round. A round of few rows (they are counted) is broadcast to its joins,
    all other rows are sorted for them. ``step`` must return one row per key and the columns of seed.
    With ``max_rounds``, the flag tells whether a further round would have found rows.
    """
    stage = Stage(seed.sparkSession, label)
    schema = seed.schema
    latest = lambda: (F.broadcast if stage.rows <= FEW_ROWS else large)(stage.latest("rows", schema))
    known = large(stage.add("rows", seed))
    new = latest()
    round_ = 0
    while True:
        found = step(new, known, round_ + 1).join(known.select(*keys), keys, "left_anti").select(*seed.columns)
        if max_rounds is not None and round_ >= max_rounds:
            return known, not found.isEmpty()
        known_next = large(stage.add("rows", found))
        if not stage.rows:
            return known, False
        new = latest()
        known = known_next
        round_ += 1


def min_label_components(edges: DataFrame, label: str = "components") -> DataFrame:
    """(node, root) with the least node of each undirected component of (source, target): minimum labels
    with pointer jumping, until a round changes nothing."""
    stage = Stage(edges.sparkSession, label)
    both = stage.keep(
        edges.select("source", "target").unionByName(edges.select(F.col("target").alias("source"), F.col("source").alias("target"))).distinct()
    )
    labels = stage.keep(both.groupBy("source").agg(F.least(F.min("target"), F.col("source")).alias("root")).withColumnRenamed("source", "node"))
    while True:
        hop = both.join(labels.withColumnRenamed("node", "target"), "target").groupBy("source").agg(F.min("root").alias("m"))
        lower = labels.join(hop.withColumnRenamed("source", "node"), "node", "left").select("node", F.least("root", F.coalesce("m", "root")).alias("root"), F.col("root").alias("was"))
        jump = lower.select(F.col("node").alias("root"), F.col("root").alias("far"))
        new = stage.keep(lower.join(jump, "root", "left").select("node", F.least("root", F.coalesce("far", "root")).alias("root"), "was"))
        changed = new.where("root <> was").isEmpty()
        labels = new.select("node", "root")
        if changed:
            return labels
