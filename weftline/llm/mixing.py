"""Mixing sources to target weights: a low-discrepancy schedule of source slots over shuffled token blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import WORD, Cuts, table

#: 2^64 / golden ratio, as a signed 64-bit number: slot i falls at frac(i * golden ratio), exactly.
GOLDEN = -7046029254386353131
RUN = 1 << 16


def _golden_point(i: Column) -> Column:
    """The i-th golden-ratio point in [0, 1), from 53 bits of the wrapped product (no float drift)."""
    low, high = F.lit(GOLDEN & 0xFFFFFFFF), F.lit((GOLDEN >> 32) & 0xFFFFFFFF)
    i0, i1 = i.bitwiseAND(0xFFFFFFFF), F.shiftrightunsigned(i, 32)
    # i * GOLDEN mod 2^64 >> 11, by 32-bit halves so that ANSI arithmetic never overflows.
    p0_lo = i0.bitwiseAND(0xFFFF) * low
    p0_hi = F.shiftright(i0, 16) * low
    low_sum = p0_lo + F.shiftleft(p0_hi.bitwiseAND(0xFFFF), 16)
    carry = F.shiftright(low_sum, 32) + F.shiftright(p0_hi, 16)
    cross = lambda a, b: ((F.shiftright(a, 16) * b).bitwiseAND(0xFFFF) * 65536 + a.bitwiseAND(0xFFFF) * b).bitwiseAND(0xFFFFFFFF)
    top = (carry + cross(i0, high) + cross(i1, low)).bitwiseAND(0xFFFFFFFF)
    return (top * F.lit(2097152.0) + F.shiftright(low_sum.bitwiseAND(0xFFFFFFFF), 11)) / F.lit(float(1 << 53))


def water_fill(sizes: DataFrame, weights: tuple[int, ...], share: float, cap: float) -> DataFrame:
    """Adds ``target`` to (source, source_size): share * all sizes, split by weight, none above cap * its size.

    Weights repeat over the sources in order of code points, null last. One source is capped before another
    when it reaches its cap at a lower level of words per weight, so the capped ones are a prefix of that
    order; the level is found from running sums. One row per source, in one task: sources are a dimension.
    """
    order = Window.orderBy(F.col("source").isNull(), "source")
    w = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int"))
    s = sizes.withColumn("weight", w.cast("double")).withColumn("limit", F.col("source_size") * cap)
    s = s.withColumn("level", F.col("limit") / F.col("weight"))
    by = Window.orderBy("level", F.col("source").isNull(), "source")
    before = by.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    s = s.withColumns(
        {
            "left": F.lit(share) * F.sum("source_size").over(every) - F.coalesce(F.sum("limit").over(before), F.lit(0.0)),
            "rest": F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)),
        }
    )
    # The first source not capped fixes the level of all that follow.
    s = s.withColumn("fill", F.col("left") / F.col("rest"))
    s = s.withColumn("level_all", F.min(F.when(F.col("fill") <= F.col("level"), F.struct("level", "fill"))).over(every)["fill"])
    target = F.when(F.col("level_all").isNull(), F.col("limit")).otherwise(F.least("limit", F.col("weight") * F.col("level_all")))
    return s.select("source", "source_size", "weight", target.alias("target"))


def shuffled_place(columns: list[Column], seed: str = "mix") -> dict[str, Column]:
    """Where a document stands in its source's shuffled order: by ``h``, the MD5 of its content, so that the order is
    the same in every run, for every layout of the files and in every engine; ``b``, its first four digits, is one of
    2^16 equal spans of that order."""
    h = F.md5(F.concat_ws("|", F.lit(seed), *[F.coalesce(c.cast("string"), F.lit("")) for c in columns]))
    return {"_mix_h": h, "_mix_b": F.conv(F.substring(h, 1, 4), 16, 10).cast("int")}


def plan_mix(
    sized: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, cap: float = 2.0, block_tokens: int = 64
) -> dict[str, DataFrame]:
    """``sources``: one row per source with its target, its ``slots`` and what they take; ``schedule``: (slot, sid,
    rank), the order in which blocks are drawn. ``sized``: source, size, b of every document.

    Slot i goes to the source whose span of cumulative target shares holds the i-th golden-ratio point; slots
    are ranked per source by counts of runs of slots, so no source's slots meet in one task. A source's
    documents, shuffled by hash and repeated ``cap`` times, form a token stream cut into equal blocks; the
    slot of rank k takes block k. Ranks of a source are 0, 1, 2, ... without a gap, so the join of slots and blocks
    on (source, rank) takes the stream's first slots * ``block_tokens`` words, capped: ``sources`` carries that cut
    per epoch, with the span of the shuffled order it falls in (``edge``) and the words before that span (``before``).
    """
    spark = sized.sparkSession
    cuts = Cuts(spark, "mix")
    per = cuts.cut(sized.groupBy("source", F.col("_mix_b").alias("b")).agg(F.sum("size").alias("w")))

    # A dimension of sources: sid is the order by code point, null last.
    dim = cuts.cut(
        water_fill(per.groupBy("source").agg(F.sum("w").alias("source_size")), weights, share, cap)
        .withColumn("sid", F.row_number().over(Window.orderBy(F.col("source").isNull(), "source")))
        .withColumn("total", F.sum("target").over(Window.partitionBy()))
        .withColumn("hi", F.sum("target").over(Window.orderBy("sid")) / F.greatest(F.col("total"), F.lit(1e-9)))
        .withColumn("lo", F.coalesce(F.lag("hi").over(Window.orderBy("sid")), F.lit(0.0)))
        .withColumn("hi", F.when(F.lead("sid").over(Window.orderBy("sid")).isNull(), F.lit(2.0)).otherwise(F.col("hi")))
    )
    total, n_sources = dim.agg(F.max("total"), F.count("*")).first()
    n_slots = int(-(-(total or 0.0) // block_tokens))

    slots = spark.range(n_slots).select(F.col("id").alias("slot"), _golden_point(F.col("id") + 1).alias("x"))
    slots = _lookup(slots, dim.where("hi > lo").select("sid", "lo", "hi"), n_sources)
    slots = slots.withColumn("run", F.expr(f"slot div {RUN}"))
    runs = cuts.cut(slots.groupBy("sid", "run").agg(F.count("*").alias("k")))
    base = F.coalesce(F.sum("k").over(Window.partitionBy("sid").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranked = slots.withColumn("r", F.row_number().over(Window.partitionBy("sid", "run").orderBy("slot")) - 1).join(
        runs.select("sid", "run", base.alias("base")), ["sid", "run"]
    )

    # What the slots take of each epoch's pass over the source, and the span of the order in which the pass ends.
    epochs = int(-(-cap // 1))
    taken = F.least(F.coalesce("slots", F.lit(0)) * block_tokens, F.floor(F.col("source_size") * F.lit(float(cap))))
    cut_at = dim.join(runs.groupBy("sid").agg(F.sum("k").alias("slots")), "sid", "left").withColumn("slots", F.coalesce("slots", F.lit(0)))
    cut_at = cut_at.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(epochs - 1))))
    cut_at = cut_at.withColumn("words", F.greatest(F.lit(0), F.least("source_size", taken - F.col("epoch") * F.col("source_size"))).cast("long"))
    running = F.sum("w").over(Window.partitionBy("source").orderBy("b"))
    spans = per.select(F.col("source").alias("s"), "b", (running - F.col("w")).alias("before"), running.alias("after"))
    met = cut_at.select("source", "epoch", "words").join(
        spans, F.col("source").eqNullSafe(F.col("s")) & (F.col("words") >= F.col("before")) & (F.col("words") < F.col("after"))
    )
    met = met.select("source", "epoch", F.col("b").alias("edge"), "before")
    cut_at = cut_at.alias("c").join(met.alias("m"), F.col("c.source").eqNullSafe(F.col("m.source")) & (F.col("c.epoch") == F.col("m.epoch")), "left")
    passes = F.sort_array(F.collect_list(F.struct("c.epoch", "words", "edge", "before")))
    sources = cuts.cut(cut_at.groupBy("c.source", "source_size", "weight", "target", "sid", "slots").agg(passes.alias("passes")))
    return {"sources": sources, "schedule": ranked.select("slot", "sid", (F.col("base") + F.col("r")).alias("rank"))}


def _take(rows: DataFrame, sources: DataFrame, order: list[Column], size: Column, any_size: Column | None = None) -> DataFrame:
    """``rows`` (source, _mix_h, _mix_b and whatever else) with ``size``, ``source_size``, ``target`` and ``takes``: the
    words that the mix takes of the document in each epoch. ``size`` is evaluated once per row, behind the split; for
    documents taken whole or not at all, ``any_size`` may stand for it (above 0 where there is a word).

    A document before the span in which a pass ends is taken whole, one behind it is not, both told from the row
    and its source's entry alone; only the rows of that one span in 2^16 are sorted. Nothing else moves.
    """
    n = sources.count()
    entry = sources.select(F.col("source").alias("_mix_s"), "source_size", "target", "passes")
    # Dimensions travel to the rows; the condition keeps null as a source of its own.
    rows = rows.join(_small(entry, n), F.col("source").eqNullSafe(F.col("_mix_s"))).drop("_mix_s")
    at_edge = F.exists("passes", lambda p: p["edge"] == F.col("_mix_b"))
    all_of = lambda p: F.when(p["edge"].isNull(), p["words"] > 0).otherwise(F.col("_mix_b") < p["edge"])
    plain = rows.where(~F.coalesce(at_edge, F.lit(False))).withColumn("size", size if any_size is None else any_size).withColumn("takes", F.transform("passes", lambda p: F.when(all_of(p), F.col("size")).otherwise(0).cast("long")))
    ahead = Window.partitionBy("source", "_mix_b").orderBy("_mix_h", *order).rowsBetween(Window.unboundedPreceding, -1)
    edge = rows.where(at_edge).withColumn("size", size).withColumn("_mix_w", F.coalesce(F.sum("size").over(ahead), F.lit(0)))
    some = lambda p: F.when(
        p["edge"] == F.col("_mix_b"), F.greatest(F.lit(0), F.least(F.col("size"), p["words"] - p["before"] - F.col("_mix_w")))
    ).otherwise(F.when(all_of(p), F.col("size")).otherwise(0))
    edge = edge.withColumn("takes", F.transform("passes", lambda p: some(p).cast("long"))).drop("_mix_w")
    return plain.unionByName(edge).drop("passes")


def draw_order(docs: DataFrame, block_tokens: int = 64, cap: float = 2.0, **params) -> DataFrame:
    """(slot, source, doc_id, epoch, first, words): the blocks in the order in which the mix draws them, each with
    the parts of documents that it holds (``first``: the part's first word in the document).

    The slot of rank k of a source is joined with block k of its stream. For a user who streams the mix; the counts
    and texts of the mix need no such join (see ``plan_mix``).
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    size = F.size(F.regexp_extract_all(text, F.lit(WORD), F.lit(0))).cast("long")
    sized = docs.select("doc_id", "source", size.alias("size"), *[c.alias(k) for k, c in shuffled_place([F.col("doc_id"), text]).items()])
    sized = Cuts(docs.sparkSession, "draw").cut(sized.where("size > 0"))
    plan = plan_mix(sized, cap=cap, block_tokens=block_tokens, **params)
    per = sized.groupBy("source", "_mix_b").agg(F.sum("size").alias("w"))
    running = F.sum("w").over(Window.partitionBy("source").orderBy("_mix_b")) - F.col("w")
    per = per.select(F.col("source").alias("s"), F.col("_mix_b").alias("b"), running.alias("before"))
    inner = Window.partitionBy("source", "_mix_b").orderBy("_mix_h", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    placed = sized.withColumn("within", F.coalesce(F.sum("size").over(inner), F.lit(0)))
    placed = placed.join(per, F.col("source").eqNullSafe(F.col("s")) & (F.col("_mix_b") == F.col("b")))
    n = plan["sources"].count()
    entry = plan["sources"].select(F.col("source").alias("_mix_s"), "sid", "source_size", "slots")
    placed = placed.join(_small(entry, n), F.col("source").eqNullSafe(F.col("_mix_s")))
    pieces = placed.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(int(-(-cap // 1)) - 1))))
    pieces = pieces.withColumn("a", F.col("before") + F.col("within") + F.col("epoch") * F.col("source_size"))
    pieces = pieces.withColumn("z", F.least(F.col("a") + F.col("size"), F.floor(F.col("source_size") * F.lit(float(cap))))).where("a < z")
    pieces = pieces.where(F.col("a") < F.col("slots") * block_tokens)
    blocks = pieces.withColumn("rank", F.explode(F.sequence(F.expr(f"a div {block_tokens}"), F.expr(f"(z - 1) div {block_tokens}"))))
    begin = F.greatest("a", F.col("rank") * block_tokens)
    blocks = blocks.select("sid", "rank", "source", "doc_id", "epoch", (begin - F.col("a")).alias("first"), (F.least("z", (F.col("rank") + 1) * block_tokens) - begin).alias("words"))
    return blocks.join(plan["schedule"], ["sid", "rank"]).select("slot", "source", "doc_id", "epoch", "first", "words")


#: A dimension of at most this many sources is broadcast (bound checked against its count); a larger one is hash joined.
SMALL_SOURCES = 50_000


def _small(df: DataFrame, n: int) -> DataFrame:
    return F.broadcast(df) if n <= SMALL_SOURCES else df


def _lookup(slots: DataFrame, spans: DataFrame, n: int) -> DataFrame:
    """The source of each point. Few spans: one expression; many: a join on a grid of 4096 cells of [0, 1)."""
    if n <= 64:
        edges = [(r["hi"], r["sid"]) for r in spans.orderBy("sid").collect()]  # at most 64
        sid = F.lit(edges[-1][1] if edges else None).cast("int")
        for hi, s in reversed(edges[:-1]):
            sid = F.when(F.col("x") < F.lit(hi), F.lit(s)).otherwise(sid)
        return slots.withColumn("sid", sid).drop("x")
    grid = spans.withColumn("cell", F.explode(F.sequence(F.floor(F.col("lo") * 4096), F.least(F.floor(F.col("hi") * 4096), F.lit(4095).cast("long")))))
    at = slots.withColumn("cell", F.floor(F.col("x") * 4096)).join(_small(grid, n), "cell")
    return at.where((F.col("x") >= F.col("lo")) & (F.col("x") < F.col("hi"))).select("slot", "sid")


def mix_counts(docs: DataFrame, **params) -> DataFrame:
    """One row per row of ``docs``: doc_id, source, size, source_size, target, taken.

    Null and wordless texts have size 0 and are never taken; null sources form one source, the last. Texts of any
    length count whole. Equal texts have places of their own by their doc_ids; rows equal in doc_id, text and source
    share a place and are interchangeable. An empty table gives an empty result. Only doc_id, source and text
    are read, so further columns, whatever their names, do no harm. Reruns agree, on any layout of the files.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    size = F.size(F.regexp_extract_all(text, F.lit(WORD), F.lit(0))).cast("long")
    sized = docs.select("doc_id", "source", size.alias("size"), *[c.alias(k) for k, c in shuffled_place([F.col("doc_id"), text]).items()])
    sized = Cuts(docs.sparkSession, "sized").cut(sized)
    out = _take(sized, plan_mix(sized, **params)["sources"], [F.col("doc_id"), F.col("size")], F.col("size"))
    taken = F.aggregate("takes", F.lit(0).cast("long"), lambda x, y: x + y)
    return out.select("doc_id", "source", "size", "source_size", "target", taken.alias("taken"))


def mix_documents(docs: DataFrame, **params) -> DataFrame:
    """The mix itself: the columns of ``docs``, one row per document and epoch, with the words taken as text.

    A document taken whole keeps its text; the one at the end of a source's share keeps its first taken words.
    ``n_chars``, where present, follows the text. Texts stay in place: only the documents of the span in which a
    source's share ends are shuffled. Edge cases as for ``mix_counts``; all columns of ``docs`` are kept, whatever
    their names, and rows that differ in other columns alone are told apart by a hash of all of them.
    """
    names = docs.columns
    # Clashing names: the input's columns travel as one struct.
    held = docs.select(F.struct(*names).alias("_mix_d"))
    col = lambda c: F.col("_mix_d")[c]
    text = F.coalesce(col("text"), F.lit(""))
    size = F.size(F.regexp_extract_all(text, F.lit(WORD), F.lit(0))).cast("long")
    place = [c.alias(k) for k, c in shuffled_place([col("doc_id"), text]).items()]
    rows = held.select("_mix_d", col("source").alias("source"), *place)
    plan = plan_mix(rows.withColumn("size", size).drop("_mix_d"), **params)
    out = _take(rows, plan["sources"], [F.xxhash64(F.to_json("_mix_d"))], size, text.rlike(r"[^\x20\x09-\x0D]").cast("long")).select("_mix_d", "size", F.explode("takes").alias("words")).where("words > 0")
    cut_text = F.array_join(F.slice(F.regexp_extract_all(col("text"), F.lit(WORD), F.lit(0)), F.lit(1), F.col("words").cast("int")), " ")
    whole = F.col("words") >= F.col("size")
    changed = {"text": F.when(whole, col("text")).otherwise(cut_text)}
    if "n_chars" in names:
        changed["n_chars"] = F.when(whole, col("n_chars")).otherwise(F.length(cut_text).cast("long"))
    return out.select(*[changed.get(c, col(c)).alias(c) for c in names])


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words that the mix takes of every row of ``documents``; edge cases as for ``mix_counts``."""
    return mix_counts(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))


ORACLE = r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
                  md5('mix|' || coalesce(doc_id::VARCHAR, '') || '|' || coalesce(text, '')) AS h FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source IS NULL, source) AS sid FROM d GROUP BY source),
w AS (SELECT *, CASE (sid - 1) % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END::DOUBLE AS weight, source_size * 2.0::DOUBLE AS lim FROM s),
l AS (SELECT *, lim / weight AS level, 1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(lim) OVER o, 0) AS remaining, sum(weight) OVER () - coalesce(sum(weight) OVER o, 0) AS rest
      FROM w WINDOW o AS (ORDER BY lim / weight, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT *, remaining / rest AS fill FROM l),
a AS (SELECT arg_min(fill, level) FILTER (WHERE fill <= level) AS all_fill FROM f),
t AS (SELECT f.*, CASE WHEN all_fill IS NULL THEN lim ELSE least(lim, weight * all_fill) END AS target FROM f, a),
sp AS (SELECT *, sum(target) OVER (ORDER BY sid) / greatest(sum(target) OVER (), 1e-9) AS hi, max(sid) OVER () AS final FROM t),
x AS (SELECT unnest(range(1, (SELECT ceil(sum(target) / 64)::BIGINT FROM t) + 1)) AS i),
y AS (SELECT i, ((i::HUGEINT * 11400714819323198485) % 18446744073709551616 // 2048)::DOUBLE / 9007199254740992 AS x FROM x),
z AS (SELECT i, min(sid) AS sid FROM y JOIN sp ON hi > x OR sid = final GROUP BY i),
k AS (SELECT sid, count(*) AS slots FROM z GROUP BY sid),
c AS (SELECT source, source_size, target, least(coalesce(slots, 0) * 64, source_size * 2) AS words FROM sp LEFT JOIN k USING (sid)),
p AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY source ORDER BY h, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ahead FROM d)
SELECT doc_id, p.source, size, source_size, target,
       (greatest(0, least(size, least(words, source_size) - ahead)) + greatest(0, least(size, words - source_size - ahead)))::BIGINT AS taken
FROM p JOIN c ON p.source IS NOT DISTINCT FROM c.source"""
