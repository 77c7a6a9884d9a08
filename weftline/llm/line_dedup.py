"""Line dedup: a suffix array over line-ID sequences by distributed prefix doubling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Cuts, join_unique, table
from .url_filters import MAX_BLOCKS, build_bloom, split_bloom


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def _rank(rows: DataFrame, keys: list[str], total: int, cuts: Cuts) -> DataFrame:
    """rid, ord, i, name, first: the rows whose key is found twice or more, with the key's rank and first place.

    Repeated keys are sorted by range; their place in that order is the rank, so ranks compare as keys do.
    Counting combines before the shuffle and hot keys are broadcast on the way back.
    """
    groups = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.min(F.struct("ord", "rid", "i")).alias("first"))
    repeated = cuts.cut(groups.where("n > 1"))
    ranked = cuts.cut(repeated.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("name", F.monotonically_increasing_id()))
    out = cuts.cut(join_unique(rows, ranked, keys, "n", total).select("rid", "ord", "i", "name", "first"))
    cuts.drop(repeated)
    cuts.drop(ranked)
    return out


def repeated_prefixes(lines: DataFrame, total: int, cuts: Cuts, min_lines: int) -> tuple[DataFrame, list[tuple[int, DataFrame]]]:
    """(windows of ``min_lines`` lines found twice or more, every doubling level as (length, rows)).

    ``lines``: rid, ord, i, h1, h2. Level k ranks the prefixes of 2^k lines of all suffixes; the pair of a
    suffix's rank and that of the suffix 2^k lines on is the key of the next. A suffix whose prefix is unique
    leaves: no longer prefix of it can repeat. Rows of a level with one rank are an interval of the suffix
    array whose common prefix has at least 2^k lines. Ends when no longer run repeats: log2 of it rounds.
    """
    level = _rank(lines, ["h1", "h2"], total, cuts)
    levels = [(1, level)]
    window = level if min_lines == 1 else None
    length = 1
    while True:
        if window is None and length < min_lines <= 2 * length:
            window = _rank(_pairs(level, min_lines - length), ["a", "b"], total, cuts)
        nxt = _rank(_pairs(level, length), ["a", "b"], total, cuts)
        length *= 2
        if nxt.isEmpty():
            break
        level = nxt
        levels.append((length, level))
    if window is None:
        window = level.limit(0)
    return window, levels


def _pairs(level: DataFrame, shift: int) -> DataFrame:
    then = level.select("rid", (F.col("i") - shift).alias("i"), F.col("name").alias("b"))
    return level.select("rid", "ord", "i", F.col("name").alias("a")).join(then, ["rid", "i"])


def common_prefix(pairs: DataFrame, levels: list[tuple[int, DataFrame]], cuts: Cuts) -> DataFrame:
    """``pairs`` (rid, i, first) with ``len``: how many lines the suffixes at (rid, i) and at ``first`` have in common.

    By descent through the doubling levels: where the suffixes behind the common part known so far have one rank at
    level k, 2^k lines more are common. No run of twice the top level's length repeats, so every level is tried once.
    """
    now = pairs.select("rid", "i", "first", F.lit(0).alias("len"))
    for length, level in reversed(levels):
        here = level.select("rid", F.col("i").alias("_i"), F.col("name").alias("_a"))
        there = level.select(F.col("rid").alias("_r"), F.col("i").alias("_j"), F.col("name").alias("_b"))
        now = now.withColumns({"_i": F.col("i") + F.col("len"), "_r": F.col("first.rid"), "_j": F.col("first.i") + F.col("len")})
        now = now.join(here, ["rid", "_i"], "left").join(there, ["_r", "_j"], "left")
        longer = F.when(F.col("_a") == F.col("_b"), F.col("len") + length).otherwise(F.col("len"))
        now = cuts.cut(now.select("rid", "i", "first", longer.alias("len")))
    return now


def find_repeats(docs: DataFrame, min_lines: int = 2) -> dict[str, DataFrame]:
    """``docs``: rid, doc_id and line count of every row; ``removed``: (rid, i) of each line to delete;
    ``runs``: the repeated runs (rid, start, n_lines, from_doc, from_rid, from_start).

    Repeated runs of ``min_lines`` lines are the intervals of the suffix array whose longest common prefix has that
    many lines. Each suffix of an interval but the first (in a document of smaller doc_id, null first, then by row,
    or further up in its own) copies that one; where the copied places follow one another they are one run, and it
    is followed to its end by the exact common prefix of its start and the place it copies. All lines of all runs
    are deleted. Lines without a word are left out of the sequences and never deleted. ``start``, ``from_start``
    and ``n_lines`` count lines with a word. Null and empty texts have no such line; texts of any length are read
    whole; rows equal in doc_id are separate documents; an empty table gives empty results.
    """
    cuts = Cuts(docs.sparkSession, "lines")
    base = docs.select(F.monotonically_increasing_id().alias("rid"), "doc_id", _lines(F.col("text")).alias("ls"))
    numbered = F.filter(
        F.transform("ls", lambda x, j: F.when(x.rlike(r"[^\x20\x09-\x0D]"), F.struct(F.xxhash64(x).alias("h1"), F.xxhash64(F.lit("line"), x).alias("h2"), j.alias("line")))),
        lambda s: s.isNotNull(),
    )
    # Positions count lines with a word; ``line`` is the number in the text.
    rows = base.select("rid", F.col("doc_id").alias("ord"), F.posexplode(numbered).alias("i", "s")).select("rid", "ord", "i", "s.*")
    rows = cuts.cut(rows)
    total = rows.count()
    window, levels = repeated_prefixes(rows.drop("line"), total, cuts, min_lines)
    later = window.where((F.col("first.rid") != F.col("rid")) | (F.col("first.i") != F.col("i")))
    by = Window.partitionBy("rid").orderBy("i")
    follows = (F.lag("i").over(by) == F.col("i") - 1) & (F.lag("first.rid").over(by) == F.col("first.rid")) & (F.lag("first.i").over(by) == F.col("first.i") - 1)
    starts = cuts.cut(later.withColumn("follows", F.coalesce(follows, F.lit(False))).where("not follows").select("rid", "i", "first"))
    runs = common_prefix(starts, levels, cuts)
    for _, level in levels:
        cuts.drop(level)
    covered = runs.select("rid", F.explode(F.sequence(F.col("i"), F.col("i") + F.col("len") - 1)).alias("i")).distinct()
    return {
        "docs": base.select("rid", "doc_id", F.size("ls").cast("long").alias("n_lines"), F.size(numbered).cast("long").alias("n_text_lines")),
        "removed": covered.join(rows.select("rid", "i", "line"), ["rid", "i"]).select("rid", F.col("line").alias("i"), F.col("i").alias("place")),
        "runs": runs.select("rid", F.col("i").alias("start"), F.col("len").alias("n_lines"), F.col("first.ord").alias("from_doc"), F.col("first.rid").alias("from_rid"), F.col("first.i").alias("from_start")),
    }


def dedup_lines(docs: DataFrame, min_lines: int = 2) -> DataFrame:
    """The columns of ``docs`` without repeated runs of lines in ``text``; ``n_chars``, where present, follows.

    A document that loses every line with a word is dropped: all of it stands elsewhere. Documents that lose
    nothing, wordless and null ones included, keep their text as it is and are not moved. ``docs`` must be a stored
    table, since its rows are numbered twice; its columns may have any names. Other cases as for ``find_repeats``.
    """
    cuts = Cuts(docs.sparkSession, "dedup")
    names = docs.columns
    found = find_repeats(docs.select("doc_id", "text"), min_lines)
    gone = cuts.cut(found["removed"].groupBy(F.col("rid").alias("_rid")).agg(F.collect_set("i").alias("_gone")))
    held = docs.select(F.struct(*names).alias("_d"), F.monotonically_increasing_id().alias("_rid"))
    n_blocks = max(1, min(MAX_BLOCKS, gone.count() * 12 // 512 + 1))
    bloom = build_bloom(gone.select(F.col("_rid").cast("string").alias("key")), n_blocks)
    touched, whole = split_bloom(held.withColumn("key", F.col("_rid").cast("string")), bloom, n_blocks)
    out = touched.select("_d", "_rid").join(gone, "_rid", "left")
    text, lost = F.col("_d")["text"], F.col("_gone").isNotNull()
    # Per line a flag, so that deletion is linear in the text.
    flags = F.array_except(F.sequence(F.lit(0), F.size("_ls") - 1), F.col("_gone"))
    out = out.withColumn("_ls", F.when(lost, _lines(text)))
    out = out.withColumn("_left", F.when(lost, F.when(F.size(flags) > 0, F.transform(flags, lambda j: F.get(F.col("_ls"), j)))))
    emptied = lost & ~F.coalesce(F.exists("_left", lambda x: x.rlike(r"[^\x20\x09-\x0D]")), F.lit(False))
    out = out.where(~emptied).withColumn("_t", F.when(lost, F.array_join("_left", "\n")).otherwise(text))
    changed = {"text": F.col("_t")}
    if "n_chars" in names:
        changed["n_chars"] = F.when(lost, F.length("_t").cast("long")).otherwise(F.col("_d")["n_chars"])
    out = out.select(*[changed.get(c, F.col("_d")[c]).alias(c) for c in names])
    return whole.select(*[F.col("_d")[c].alias(c) for c in names]).unionByName(out)


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every row of ``documents`` loses when later copies of repeated runs of two lines or more are deleted; edge
    cases as for ``find_repeats``. ``n_runs`` and ``longest_run``: stretches of deleted lines, counted in lines with a
    word."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = find_repeats(docs)
    # Neighbours in place are one stretch: place minus rank stays the same.
    rank = F.row_number().over(Window.partitionBy("rid").orderBy("place"))
    stretch = found["removed"].withColumn("g", F.col("place") - rank).groupBy("rid", "g").agg(F.count("*").alias("k"), F.collect_list("i").alias("is"))
    gone = stretch.groupBy("rid").agg(F.sort_array(F.flatten(F.collect_list("is"))).alias("gone"), F.count("*").alias("n_runs"), F.max("k").alias("longest"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    return (
        found["docs"]
        .join(gone, "rid", "left")
        .select(
            "doc_id",
            "n_lines",
            zero(F.size("gone")).alias("n_removed"),
            F.coalesce(F.array_join(F.col("gone").cast("array<string>"), ","), F.lit("")).alias("removed_lines"),
            zero("n_runs").alias("n_runs"),
            zero("longest").alias("longest_run"),
            (F.coalesce(F.size("gone"), F.lit(0)) < F.greatest("n_text_lines", F.lit(1))).alias("kept"),
        )
    )


ORACLE = r"""
WITH d AS (SELECT row_number() OVER (ORDER BY doc_id) AS rid, doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT rid, doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS i FROM d),
w AS (SELECT *, row_number() OVER (PARTITION BY rid ORDER BY i) AS place, lead(line) OVER (PARTITION BY rid ORDER BY i) AS nxt
      FROM l WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
p AS (SELECT rid, place, row_number() OVER (PARTITION BY line, nxt ORDER BY doc_id NULLS FIRST, rid, i) AS k FROM w WHERE nxt IS NOT NULL),
r AS (SELECT DISTINCT rid, unnest([place, place + 1]) AS place FROM p WHERE k > 1),
s AS (SELECT rid, i, place - row_number() OVER (PARTITION BY rid ORDER BY place) AS g FROM r JOIN w USING (rid, place)),
t AS (SELECT rid, g, count(*) AS k FROM s GROUP BY ALL),
g AS (SELECT rid, count(*) AS n, string_agg(i, ',' ORDER BY i) AS removed FROM s GROUP BY rid),
h AS (SELECT rid, count(*) AS n_runs, max(k) AS longest FROM t GROUP BY rid),
m AS (SELECT rid, count(*) AS m FROM w GROUP BY rid)
SELECT doc_id, len(ls)::BIGINT AS n_lines, coalesce(n, 0)::BIGINT AS n_removed, coalesce(removed, '') AS removed_lines,
       coalesce(n_runs, 0)::BIGINT AS n_runs, coalesce(longest, 0)::BIGINT AS longest_run, coalesce(n, 0) < greatest(coalesce(m, 0), 1) AS kept
FROM d LEFT JOIN g USING (rid) LEFT JOIN h USING (rid) LEFT JOIN m USING (rid)"""
