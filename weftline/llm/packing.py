"""Best-fit packing with several permitted sequence lengths, optimised jointly."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import WORD, Cuts, table

CAPACITIES = (256, 512, 1024, 2048, 4096)


def bin_cost(capacity: int, fixed: float = 24.0, attention: float = 1 / 16384) -> float:
    """Cost of one sequence: a fixed part, its padded length, and attention that grows with its square."""
    return fixed + capacity + attention * capacity * capacity


def best_fit(lengths: np.ndarray, capacities: Sequence[int], opening: int | None = None, cost=bin_cost) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """Best fit of lengths that fall; a piece that no open bin holds opens a bin. Returns each piece's bin and offset,
    and the bins' contents.

    Without ``opening`` the bin opened is that of least cost for each token it can come to hold: the piece itself and,
    as far as there is room, the pieces not yet placed that are no longer than that room. All sizes so compete at
    every opening for what is left. With ``opening`` that size is opened or, if the piece is longer, the least that
    holds it. The open bins are stacked by the room left; one integer's bits mark the non-empty stacks, so the
    tightest fit is the lowest set bit at or above the length.
    """
    caps = sorted(capacities)
    stacks: dict[int, list[int]] = {}
    marks, used = 0, []
    at, offset = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    # Tokens of the pieces from the i-th on; they fall, so those of a length or less are the tail from a place on.
    tail = np.concatenate([np.cumsum(lengths[::-1])[::-1], [0]]).tolist()
    place: dict[int, int] = {}
    costs = {c: cost(c) for c in caps}

    def open_size(i: int, n: int) -> int:
        if opening is not None:
            return opening if opening >= n else next(c for c in caps if c >= n)
        best, least = 0, math.inf
        for c in caps:
            if c < n:
                continue
            room = c - n
            if room not in place:
                place[room] = int(np.searchsorted(-lengths, -room, "left"))
            filled = n + min(room, tail[max(i + 1, place[room])])
            if costs[c] / filled < least:
                best, least = c, costs[c] / filled
        return best

    for i, n in enumerate(lengths.tolist()):
        fits = marks >> n
        if fits:
            room = n + ((fits & -fits).bit_length() - 1)
            stack = stacks[room]
            b = stack.pop()
            if not stack:
                marks &= ~(1 << room)
        else:
            b, room = len(used), open_size(i, n)
            used.append(0)
        at[i], offset[i] = b, used[b]
        used[b] += n
        room -= n
        if room:
            stacks.setdefault(room, []).append(b)
            marks |= 1 << room
    return at, offset, used


def pack_lengths(lengths: np.ndarray, capacities: Sequence[int] = CAPACITIES, cost=bin_cost) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bin, offset, bin_size, bin_tokens) of each piece; lengths must fall and not exceed the largest capacity.

    The packing that chooses the size at each opening competes with those that open one size throughout; of each the
    bins are downsized to the least capacity that holds their contents, and the one of least total cost stands
    (ties: the first named, then the larger size). So it is never dearer than any single size.
    """
    caps = np.array(sorted(capacities))
    best = None
    for opening in (None, *caps[::-1].tolist()):
        at, offset, used = best_fit(lengths, capacities, opening, cost)
        filled = np.array(used, np.int64)
        sizes = caps[np.searchsorted(caps, filled)] if len(filled) else filled
        total = sum(cost(int(c)) * int(k) for c, k in zip(*np.unique(sizes, return_counts=True), strict=True))
        if best is None or total < best[0]:
            best = (total, at, offset, sizes, filled)
    _, at, offset, sizes, filled = best
    return at, offset, sizes[at], filled[at]


def _numbered(docs: DataFrame, *columns: Column) -> DataFrame:
    """``row_key`` (a hash of doc_id and text) and ``copy`` (1, 2, ... among rows equal in both), doc_id, source and
    ``columns`` of every row: names of rows that do not depend on how the table is laid out."""
    source = F.col("source") if "source" in docs.columns else F.lit(None).cast("string")
    key = F.xxhash64(F.lit("pack"), F.col("doc_id").cast("string"), "text")
    rows = docs.select(key.alias("row_key"), "doc_id", source.alias("source"), *columns)
    return rows.withColumn("copy", F.row_number().over(Window.partitionBy("row_key").orderBy("source")))


def pack_documents(docs: DataFrame, capacities: Sequence[int] = CAPACITIES, shard_pieces: int = 20_000) -> DataFrame:
    """Places every word of every document: doc_id, source, row_key, copy, piece, start, n_tokens, bin_id, bin_size,
    bin_offset, bin_tokens.

    A document longer than the largest capacity is cut into pieces of that capacity, which fill bins of
    their own, and a rest. Rests and shorter documents are spread by hash over shards of about
    ``shard_pieces`` pieces; each shard is packed on its own, so memory is bounded and shards run in parallel.
    Pieces are sorted by length, then by a hash of doc_id and text: reruns agree on any layout of the files. doc_id
    may be of any type that casts to a string. Documents without words (null text too) have no piece; repeated
    rows are packed each on its own (``copy``); texts of any length are placed whole; an empty table gives an empty
    result. Further columns, whatever their names, are not read.
    """
    spark = docs.sparkSession
    cuts = Cuts(spark, "pack")
    top = max(capacities)
    n = F.size(F.regexp_extract_all(F.coalesce(F.col("text"), F.lit("")), F.lit(WORD), F.lit(0)))
    sized = cuts.cut(_numbered(docs, n.cast("long").alias("n")).where("n > 0"))
    shards = max(1, sized.count() // shard_pieces)
    ids = ["row_key", "copy", "doc_id", "source"]
    full = sized.where(F.col("n") >= top).select(*ids, F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"n div {top} - 1"))).alias("piece"))
    full = full.select(
        *ids,
        "piece",
        (F.col("piece") * top).alias("start"),
        F.lit(top).cast("long").alias("n_tokens"),
        F.concat_ws("-", F.lit("f"), F.lower(F.hex("row_key")), "copy", "piece").alias("bin_id"),
        F.lit(top).cast("long").alias("bin_size"),
        F.lit(0).cast("long").alias("bin_offset"),
        F.lit(top).cast("long").alias("bin_tokens"),
    )
    rest = sized.where(F.col("n") % top > 0).select(
        *ids, F.expr(f"n div {top}").alias("piece"), F.expr(f"n div {top} * {top}").alias("start"), (F.col("n") % top).alias("n_tokens")
    )
    rest = rest.withColumn("shard", F.pmod(F.xxhash64("row_key", "copy"), F.lit(shards)))

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["n_tokens", "row_key", "copy"], ascending=[False, True, True], kind="stable")
        at, offset, size, filled = pack_lengths(pdf["n_tokens"].to_numpy(), capacities)
        shard = int(pdf["shard"].iloc[0])
        out = pdf.drop(columns="shard")
        out["bin_id"] = [f"{shard}-{b}" for b in at.tolist()]
        return out.assign(bin_size=size, bin_offset=offset, bin_tokens=filled)

    packed = rest.groupBy("shard").applyInPandas(pack, full.schema)
    return full.unionByName(packed)


def assemble(docs: DataFrame, placed: DataFrame) -> DataFrame:
    """The sequences: bin_id, bin_size, bin_tokens, doc_ids, text (pieces in order, each ended by ``<|end|>``).

    ``docs`` must hold the rows that ``placed`` was made from. A bin holds at most its capacity of words.
    """
    ws = F.regexp_extract_all("text", F.lit(WORD), F.lit(0))
    rows = _numbered(docs, ws.alias("ws")).select("row_key", "copy", "ws").join(placed, ["row_key", "copy"])
    piece = F.array_join(F.slice("ws", (F.col("start") + 1).cast("int"), F.col("n_tokens").cast("int")), " ")
    rows = rows.select("bin_id", "bin_size", "bin_tokens", F.struct("bin_offset", "doc_id", piece.alias("text")).alias("p"))
    out = rows.groupBy("bin_id", "bin_size", "bin_tokens").agg(F.sort_array(F.collect_list("p")).alias("ps"))
    return out.select("bin_id", "bin_size", "bin_tokens", F.col("ps.doc_id").alias("doc_ids"), F.array_join("ps.text", " <|end|> ").alias("text"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of every row of ``documents`` and their bins; edge cases as for ``pack_documents``."""
    return pack_documents(table(spark, sf_dir, "documents")).drop("row_key", "copy")
