"""Shared pieces of the corpus operators: tables, cuts of lineage, skew-safe joins."""

from __future__ import annotations

import os
import tempfile
import threading
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"
#: A key is hot when it holds over 1/HOT_SHARE of all rows, so there are at most HOT_SHARE hot keys:
#: that is the proof of size for every broadcast of hot keys.
HOT_SHARE = 1024


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once per row (lambda variables are not re-expanded)."""
    return F.element_at(F.transform(F.array(value), body), 1)


def literal_rows(spark: SparkSession, columns: dict[str, list], types: dict[str, str]) -> DataFrame:
    """A short list as a table, made by the planner alone (no RDD is built from driver objects)."""
    names = list(columns)
    rows = list(zip(*columns.values(), strict=True))
    one = lambda row: F.struct(*[F.lit(v).cast(types[n]).alias(n) for n, v in zip(names, row, strict=True)])
    if not rows:
        return spark.range(0).select(*[F.lit(None).cast(types[n]).alias(n) for n in names])
    return spark.range(1).select(F.explode(F.array(*map(one, rows))).alias("r")).select("r.*")


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0))


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, else (one local process, as in tests) a temporary one."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    fallback = os.path.join(tempfile.gettempdir(), "weftline-checkpoints")
    os.makedirs(fallback, exist_ok=True)
    spark.conf.set("spark.checkpoint.dir", f"file://{fallback}")
    return f"file://{fallback}"


class Scratch:
    """The folders that ``Cuts`` made inside a ``with`` block in this thread; ``free`` deletes them.

    For chains of steps whose results are written: what a step cut is of no use once its result is stored.
    """

    _now = threading.local()

    def __init__(self, spark: SparkSession):
        self.spark, self.folders = spark, []

    def __enter__(self) -> Scratch:
        self._outer = getattr(Scratch._now, "it", None)
        Scratch._now.it = self
        return self

    def __exit__(self, *_: object) -> None:
        Scratch._now.it = self._outer

    def free(self) -> None:
        for folder in self.folders:
            delete(self.spark, folder)
        self.folders = []


def delete(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


class Cuts:
    """Tables written to the shared folder to end lineage; ``drop`` frees one that is no longer read."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark, self.base = spark, f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
        self._n = 0
        if (scratch := getattr(Scratch._now, "it", None)) is not None:
            scratch.folders.append(self.base)

    def cut(self, df: DataFrame) -> DataFrame:
        self._n += 1
        path = f"{self.base}/{self._n}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._weftline_path = path
        return out

    def drop(self, df: DataFrame | None) -> None:
        path = getattr(df, "_weftline_path", None)
        if path:
            delete(self.spark, path)


def join_unique(left: DataFrame, right: DataFrame, keys: list[str], weight: str, total: int, how: str = "inner") -> DataFrame:
    """Join with a right side that has one row per key and counts, in ``weight``, the key's rows on the left.

    Keys with over total/HOT_SHARE rows (at most HOT_SHARE of them) are broadcast, so that their rows on
    the left stay where they are; the others are shuffled and none of them is large.
    """
    limit = max(1, total // HOT_SHARE)
    payload = [c for c in right.columns if c not in keys]
    hot = F.broadcast(right.where(F.col(weight) > limit))
    on_hot = left.join(hot, keys, "left")
    seen = F.col(weight).isNotNull()
    done = on_hot.where(seen)
    rest = on_hot.where(~seen).drop(*payload)
    return done.unionByName(rest.join(right.where(F.col(weight) <= limit), keys, how))


def salted_join(left: DataFrame, right: DataFrame, key: str, total: int, how: str = "inner", least: int = 10_000) -> DataFrame:
    """Join with a right side of one (possibly large) row per key, where a key of ``left`` may hold most rows.

    A key with over max(least, total/HOT_SHARE) rows is split into parts of about that many; the right row is
    repeated once per part, which adds at most HOT_SHARE rows. Only (key, parts) of hot keys is broadcast.
    """
    limit = max(least, total // HOT_SHARE)
    hot = left.groupBy(key).agg(F.count("*").alias("_n")).where(F.col("_n") > limit)
    hot = F.broadcast(hot.select(key, F.ceil(F.col("_n") / limit).cast("int").alias("_parts")))
    others = [c for c in left.columns if c != key]
    salt = F.when(F.col("_parts").isNull(), F.lit(0)).otherwise(F.pmod(F.xxhash64(*others), F.col("_parts")).cast("int"))
    a = left.join(hot, key, "left").withColumn("_salt", salt).drop("_parts")
    b = right.join(hot, key, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce("_parts", F.lit(1)) - 1))).drop("_parts")
    return a.join(b, [key, "_salt"], how).drop("_salt")


def components(edges: DataFrame, cuts: Cuts) -> DataFrame:
    """(node, root): the least node of each connected component of ``edges`` (a, b), for nodes with an edge.

    Large-star and small-star rounds: every edge moves to the least neighbour until each component is a
    star. Hubs are handled by counts, and each round is written, so plans stay short and restartable.
    """
    now = cuts.cut(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    before = None
    while True:
        stamp = now.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))")).first()
        if tuple(stamp) == before:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
                now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
            )
        before = tuple(stamp)
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("n"))
        large = join_unique(both, least, ["u"], "n", 2 * before[0]).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = cuts.cut(large.where("u <> v").distinct())
        least = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        small = join_unique(large, least, ["u"], "n", before[0])
        small = small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        new = cuts.cut(small.where("u <> v").distinct())
        cuts.drop(now)
        cuts.drop(large)
        now = new
