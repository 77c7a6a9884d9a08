"""Multi-root labelled traversal: nearest other root, root sets, evidence tiers."""

from __future__ import annotations

from collections import deque

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..plans.stage import Stage, large, semi_naive
from ..sources.schemas import USAGE_KINDS
from .graph import Graph, semantic_parent

TIERS = ("direct", "bound", "candidate")
#: A graph of up to this many hops, and hops times roots within the second bound, is solved in one grouped task
#: (both are counted first); a larger one by the distributed loops.
SMALL_HOPS, SMALL_WORK = 200_000, 50_000_000


def _is_small(hops: DataFrame, roots: DataFrame) -> bool:
    n = hops.limit(SMALL_HOPS + 1).count()
    return n <= SMALL_HOPS and n * roots.count() <= SMALL_WORK


def _one_task(hops: DataFrame, roots: DataFrame, solve, shape: str) -> DataFrame:  # noqa: ANN001
    """``solve(out, start)`` over the adjacency {from: [to]} and {id: position} of a small graph."""
    rows = hops.select(F.col("from").alias("a"), F.col("to").alias("b"), F.lit(None).cast("int").alias("p")).unionByName(
        roots.select(F.col("id").alias("a"), F.lit(None).cast("string").alias("b"), F.col("position").cast("int").alias("p"))
    )
    names = [c.split()[0] for c in shape.split(", ")]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out: dict[str, list[str]] = {}
        start: dict[str, int] = {}
        for a, b, p in zip(pdf["a"], pdf["b"], pdf["p"], strict=True):
            if b is None:
                start[a] = int(p)
            else:
                out.setdefault(a, []).append(b)
        return pd.DataFrame(solve(out, start), columns=names)

    return rows.withColumn("all", F.lit(0)).groupBy("all").applyInPandas(run, shape)


def _local_sets(out: dict[str, list[str]], start: dict[str, int]) -> list[tuple[str, int]]:
    """Root sets as bits of one integer per vertex, pushed on while they grow."""
    bits = {v: 1 << p for v, p in start.items()}
    todo, waiting = deque(bits), set(bits)
    while todo:
        v = todo.popleft()
        waiting.discard(v)
        for t in out.get(v, ()):
            merged = bits.get(t, 0) | bits[v]
            if merged != bits.get(t, 0):
                bits[t] = merged
                if t not in waiting:
                    waiting.add(t)
                    todo.append(t)
    return [(v, p) for v, b in bits.items() for p in range(b.bit_length()) if b >> p & 1]


def _local_labels(horizon: int):  # noqa: ANN202
    def solve(out: dict[str, list[str]], start: dict[str, int]) -> list[tuple[str, int, int]]:
        labels: dict[str, list[tuple[int, int]]] = {v: [(p, 0)] for v, p in start.items()}
        front = [(v, p) for v, p in start.items()]
        for d in range(1, horizon + 1):
            offered = sorted({(t, p) for v, p in front for t in out.get(v, ())})
            front = []
            for t, p in offered:
                have = labels.setdefault(t, [])
                if len(have) < 2 and all(q != p for q, _ in have):
                    have.append((p, d))
                    front.append((t, p))
            if not front:
                break
        return [(v, p, d) for v, have in labels.items() for p, d in have]

    return solve


def unique_implementations(graph: Graph, closed_world: bool) -> DataFrame:
    """(contract, implementation) proven to be the only pair: one overrider, a contract that overrides nothing,
    in a protocol with one conformer; only when nothing outside can conform."""
    e = graph.edges
    over = e.where("kind = 'overrides'")
    single = over.groupBy(F.col("target").alias("contract")).agg(F.count_distinct("source").alias("n"), F.min("source").alias("implementation")).where("n = 1").drop("n")
    single = single.join(over.select(F.col("source").alias("contract")), "contract", "left_anti")
    owner = semantic_parent(graph.nodes, e).select(F.col("id").alias("contract"), "parent")
    protocols = graph.nodes.where("kind = 'protocol'").select(F.col("id").alias("parent"))
    conformers = e.where("kind = 'conformance'").groupBy(F.col("target").alias("parent")).agg(F.count_distinct("source").alias("c")).where("c = 1").drop("c")
    out = single.join(owner, "contract").join(protocols, "parent", "left_semi").join(conformers, "parent", "left_semi").select("contract", "implementation")
    return out if closed_world else out.limit(0)


def is_closed_world(limitations: DataFrame, open_codes: tuple[str, ...] = ("public-api-not-retained", "objective-c-sources", "unindexed-sources")) -> bool:
    return limitations.where(F.col("code").isin(*open_codes)).isEmpty()


def traversal_hops(graph: Graph, dependents: bool, closed_world: bool = False, runtime: DataFrame | None = None) -> DataFrame:
    """(from, to, tier, kinds): usage edges are direct; dispatch through a contract is bound where its
    implementation is proven unique, else a candidate; runtime edges (source, target) are candidates. Of
    several ways to one target the strongest tier stays."""
    usage = graph.edges.where(F.col("kind").isin(*USAGE_KINDS))
    a, b = ("target", "source") if dependents else ("source", "target")
    direct = usage.select(F.col(a).alias("from"), F.col(b).alias("to"), F.lit(0).alias("tier"), "kind")
    over = graph.edges.where("kind = 'overrides'").select(F.col("source").alias("implementation"), F.col("target").alias("contract"))
    proven = unique_implementations(graph, closed_world).withColumn("bound", F.lit(1))
    over = large(over.join(large(proven), ["implementation", "contract"], "left"))
    calls = usage.where("kind <> 'overrides'").select(F.col("source").alias("caller"), F.col("target").alias("contract"))
    via = over.join(calls, "contract").where("caller <> implementation")
    ends = ("implementation", "caller") if dependents else ("caller", "implementation")
    dispatch = via.select(F.col(ends[0]).alias("from"), F.col(ends[1]).alias("to"), F.when(F.col("bound") == 1, 1).otherwise(2).alias("tier"), F.lit("dispatch").alias("kind"))
    hops = direct.unionByName(dispatch)
    if runtime is not None:
        hops = hops.unionByName(runtime.select(F.col(a).alias("from"), F.col(b).alias("to"), F.lit(2).alias("tier"), F.lit("runtime").alias("kind")))
    out = hops.where("from <> to").groupBy("from", "to").agg(F.min("tier").alias("tier"), F.array_join(F.sort_array(F.collect_set("kind")), ",").alias("kinds"))
    return out


def root_sets(hops: DataFrame, roots: DataFrame, tier: int, local: bool | None = None) -> DataFrame:
    """(vertex, root) pairs over hops of at most ``tier``: a closure of pairs, delta by delta."""
    e = large(Stage(hops.sparkSession, "hops").keep(hops.where(F.col("tier") <= tier).select("from", "to")))
    if local if local is not None else _is_small(e, roots):
        return _one_task(e, roots, _local_sets, "vertex string, root int")
    seed = roots.select(F.col("id").alias("vertex"), F.col("position").alias("root"))
    step = lambda new, known, k: new.join(e.withColumnRenamed("from", "vertex"), "vertex").select(F.col("to").alias("vertex"), "root").distinct()
    return semi_naive(seed, step, ["vertex", "root"], label="roots")[0]


def nearest_two(hops: DataFrame, roots: DataFrame, horizon: int, local: bool | None = None) -> DataFrame:
    """(vertex, root, distance): the two nearest distinct roots of every vertex, ties by root.

    A vertex passes on only its two labels: a third root is at least as far for all that come after it.
    """
    stage = Stage(hops.sparkSession, "labels")
    hops = large(stage.keep(hops.select("from", "to")))
    if local if local is not None else _is_small(hops, roots):
        return _one_task(hops, roots, _local_labels(horizon), "vertex string, root int, distance int")
    e = hops.select(F.col("from").alias("vertex"), "to")
    labels = large(stage.add("l", roots.select(F.col("id").alias("vertex"), F.col("position").alias("root"), F.lit(0).alias("distance"))))
    for d in range(1, horizon + 1):
        front = labels.where(F.col("distance") == d - 1)
        offered = front.join(e, "vertex").select(F.col("to").alias("vertex"), "root").distinct().join(labels.select("vertex", "root"), ["vertex", "root"], "left_anti")
        held = labels.groupBy("vertex").agg(F.count("*").alias("have"))
        rank = F.row_number().over(Window.partitionBy("vertex").orderBy("root"))
        new = offered.join(held, "vertex", "left").withColumn("k", rank).where(F.col("k") + F.coalesce("have", F.lit(0)) <= 2)
        labels = large(stage.add("l", new.select("vertex", "root", F.lit(d).alias("distance"))))
        if labels.where(F.col("distance") == d).isEmpty():
            break
    return labels


def traverse(hops: DataFrame, roots: DataFrame, max_depth: int, local: bool | None = None) -> tuple[DataFrame, bool]:
    """(id, depth, via, roots, evidence) and whether depth cut rows off; ``roots``: id, position (distinct ids).

    A vertex is reported when another root than itself reaches it: depth is the distance of the nearest such
    root, via the least predecessor one step nearer (itself measured without the vertex's own root), roots the
    positions that reach it, evidence the weakest tier needed for all of them.
    """
    stage = Stage(hops.sparkSession, "multi")
    hops = large(stage.keep(hops))
    local = _is_small(hops, roots) if local is None else local
    tiers = {r["tier"] for r in hops.select("tier").distinct().collect()}  # at most three
    own = large(roots.select(F.col("id").alias("vertex"), F.col("position").alias("own")))
    sets = large(stage.keep(root_sets(hops, roots, 2, local).join(own, "vertex", "left").where("own is null or root <> own")))
    sizes = sets.groupBy("vertex").agg(F.array_join(F.transform(F.sort_array(F.collect_set("root")), lambda r: r.cast("string")), ",").alias("roots"), F.count_distinct("root").alias("n"))
    for tier in (0, 1):
        if max(tiers, default=0) <= tier:
            sizes = sizes.withColumn(f"n{tier}", F.col("n"))
            continue
        part = root_sets(hops, roots, tier, local).join(own, "vertex", "left").where("own is null or root <> own")
        sizes = sizes.join(part.groupBy("vertex").agg(F.count_distinct("root").alias(f"n{tier}")), "vertex", "left")
    evidence = F.when(F.col("n0") == F.col("n"), "direct").when(F.col("n1") == F.col("n"), "bound").otherwise("candidate")
    labels = large(stage.keep(nearest_two(hops, roots, max_depth + 1, local)))
    near = labels.join(own, "vertex", "left").where("own is null or root <> own").groupBy("vertex", "own").agg(F.min("distance").alias("depth"))
    within = near.where(F.col("depth") <= max_depth)
    # The predecessor's distance leaves out the root that is the vertex itself.
    into = within.join(hops.select(F.col("from").alias("via"), F.col("to").alias("vertex")), "vertex")
    other = labels.select(F.col("vertex").alias("via"), "root", "distance")
    close = into.join(other, "via").where("own is null or root <> own").groupBy("vertex", "via", "depth").agg(F.min("distance").alias("d"))
    best = close.where("d = depth - 1").groupBy("vertex").agg(F.min("via").alias("via"))
    rows = sizes.join(within.select("vertex", "depth"), "vertex").join(large(best), "vertex")
    rows = rows.select(F.col("vertex").alias("id"), "depth", "via", "roots", evidence.alias("evidence"))
    cut = not sizes.select("vertex").join(rows.select(F.col("id").alias("vertex")), "vertex", "left_anti").isEmpty()
    return rows, cut
