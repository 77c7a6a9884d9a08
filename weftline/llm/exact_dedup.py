"""Exact dedup by deterministic block naming: sorted blocks become integers, adjacent pairs are named again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import HOT_SHARE, Cuts, join_unique, table

BUCKETS = 1 << 20
RANKS = 1 << 40


def name_keys(df: DataFrame, keys: list[str], hot_min: int = 1000) -> DataFrame:
    """Adds ``name``: equal keys get the same integer and different keys different ones, without collisions.

    Rows are sorted by key within 2^20 buckets of the key's hash; bucket and dense rank make the name, the
    same in every run. The HOT_SHARE most frequent hashes (seen over ``hot_min`` times) are named from
    their distinct keys in a broadcast table of at most about HOT_SHARE rows, so no bucket gathers a hot key.
    """
    spark = df.sparkSession
    h = F.xxhash64(*keys)
    counts = df.select(h.alias("h")).groupBy("h").count().where(F.col("count") > hot_min)
    hot = [r["h"] for r in counts.orderBy(F.desc("count"), "h").limit(HOT_SHARE).collect()]
    bucketed = df.withColumn("_h", h)
    ranked = lambda x: (
        x.withColumn("_b", F.pmod("_h", F.lit(BUCKETS)))
        .withColumn("name", F.col("_b") * RANKS + F.dense_rank().over(Window.partitionBy("_b").orderBy(*keys)))
        .drop("_b", "_h")
    )
    if not hot:
        return ranked(bucketed)
    marks = F.broadcast(spark.range(1).select(F.explode(F.lit(hot)).alias("_h")))
    warm = bucketed.join(marks, "_h", "left_semi")
    names = warm.select(*keys).distinct().withColumn("name", -F.row_number().over(Window.orderBy(*keys)).cast("long"))
    names = names.select(*[F.col(k).alias(f"_name_{k}") for k in keys], "name")
    named = warm.join(F.broadcast(names), [F.col(k).eqNullSafe(F.col(f"_name_{k}")) for k in keys]).select(*df.columns, "name")
    return ranked(bucketed.join(marks, "_h", "left_anti")).unionByName(named)


def exact_groups(docs: DataFrame, block_chars: int = 4096, hot_min: int = 1000) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    A text is cut into blocks of ``block_chars`` code points; blocks, then pairs of names, are named until
    one (level, name) is left per document, equal exactly for equal texts. Null text counts as empty. Of
    equal texts the row with the largest doc_id stays (null is smallest); of equal rows with that id, one. Texts of any
    length are named whole, block by block; an empty table gives an empty result; only doc_id and text are read, so
    further columns, whatever their names, do no harm.
    """
    spark = docs.sparkSession
    cuts = Cuts(spark, "exact")
    text = F.coalesce(F.col("text"), F.lit(""))
    blocks = F.when(text == "", F.array(F.lit(""))).otherwise(F.regexp_extract_all(text, F.lit(rf"(?s).{{1,{block_chars}}}"), F.lit(0)))
    base = docs.select(F.monotonically_increasing_id().alias("rid"), "doc_id", F.sha2(text, 256).alias("sha"), blocks.alias("bs"))
    rows = base.select("rid", F.size("bs").alias("n"), "doc_id", "sha", F.posexplode("bs").alias("pos", "block"))
    # The identity columns travel with a document's first block only.
    first = lambda c: F.when(F.col("pos") == 0, F.col(c)).alias(c)
    rows = rows.select("rid", "n", "pos", first("doc_id"), first("sha"), "block")
    level = 0
    now = cuts.cut(name_keys(rows, ["block"], hot_min).drop("block"))
    done = []
    while True:
        done.append(now.where("n = 1").select("rid", "doc_id", "sha", F.lit(level).alias("level"), "name"))
        more = now.where("n > 1")
        if more.isEmpty():
            break
        side = lambda odd, c: F.max(F.when(F.col("pos") % 2 == odd, F.col(c)))
        pairs = more.groupBy("rid", "n", F.expr("pos div 2").cast("int").alias("pos")).agg(
            side(0, "doc_id").alias("doc_id"), side(0, "sha").alias("sha"), side(0, "name").alias("a"), side(1, "name").alias("b")
        )
        pairs = pairs.select("rid", F.expr("(n + 1) div 2").cast("int").alias("n"), "pos", "doc_id", "sha", "a", "b")
        level += 1
        now = cuts.cut(name_keys(cuts.cut(pairs), ["a", "b"], hot_min).drop("a", "b"))
    ident = done[0]
    for d in done[1:]:
        ident = ident.unionByName(d)
    total = ident.count()
    groups = ident.groupBy("level", "name").agg(F.max(F.struct("doc_id", "rid")).alias("keep"), F.count("*").alias("group_size"))
    return join_unique(ident, groups, ["level", "name"], "group_size", total).select(
        "doc_id",
        F.col("keep.doc_id").alias("keep_id"),
        "group_size",
        (F.col("rid") == F.col("keep.rid")).alias("kept"),
        F.col("sha").alias("text_sha256"),
    )


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The group of equal texts of every row of ``documents``; edge cases as for ``exact_groups``."""
    return exact_groups(table(spark, sf_dir, "documents").select("doc_id", "text"))


ORACLE = """
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
g AS (SELECT *, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
             row_number() OVER (PARTITION BY t ORDER BY doc_id DESC NULLS LAST, rid DESC) AS k FROM d)
SELECT doc_id, keep_id, group_size, k = 1 AS kept, sha256(t) AS text_sha256 FROM g"""
