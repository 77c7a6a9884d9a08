"""Strongly connected components, representative shortest cycles, weakest links."""

from __future__ import annotations

from collections import deque

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..plans.stage import Stage, large
from ..sources.schemas import CYCLE_KINDS


def _trim(stage: Stage, edges: DataFrame) -> DataFrame:
    """Drops edges whose source has no edge in or whose target has none out: they lie on no cycle. ``edges`` is what the
    stage wrote last, and so is the result."""
    before = stage.rows
    while True:
        inner = edges.join(large(edges.select(F.col("target").alias("source")).distinct()), "source", "left_semi")
        edges = large(stage.keep(inner.select("source", "target")))
        inner = edges.join(large(edges.select(F.col("source").alias("target")).distinct()), "target", "left_semi")
        edges = large(stage.keep(inner.select("source", "target")))
        n = stage.rows
        if n == before or n == 0:
            return edges
        before = n


def tarjan(pairs: list[tuple[str, str]]) -> list[list[str]]:
    """Strongly connected components of more than one node, each sorted; without recursion."""
    out: dict[str, list[str]] = {}
    for s, t in sorted(pairs):
        out.setdefault(s, []).append(t)
        out.setdefault(t, [])
    index: dict[str, int] = {}
    low: dict[str, int] = {}
    stack, on, found = [], set(), []
    for start in out:
        if start in index:
            continue
        index[start] = low[start] = len(index)
        stack.append(start)
        on.add(start)
        path = [(start, iter(out[start]))]
        while path:
            at, rest = path[-1]
            for nxt in rest:
                if nxt not in index:
                    index[nxt] = low[nxt] = len(index)
                    stack.append(nxt)
                    on.add(nxt)
                    path.append((nxt, iter(out[nxt])))
                    break
                if nxt in on:
                    low[at] = min(low[at], index[nxt])
            else:
                path.pop()
                if path:
                    low[path[-1][0]] = min(low[path[-1][0]], low[at])
                if low[at] == index[at]:
                    part = []
                    while not part or part[-1] != at:
                        part.append(stack.pop())
                        on.discard(part[-1])
                    if len(part) > 1:
                        found.append(sorted(part))
    return found


#: Up to this many distinct edges (their number is counted first) a graph is solved in one grouped task.
SMALL_EDGES = 200_000


def strong_components(edges: DataFrame, kinds: tuple[str, ...] | None = CYCLE_KINDS, self_loops: bool = False, small: int = SMALL_EDGES) -> DataFrame:
    """(id, component): the component is its least node; components of one node only with a self loop.

    A graph of at most ``small`` distinct edges (module, file and type graphs) goes to one task. A larger one is
    trimmed of what lies on no cycle; what is left goes to one task if it is small by then, else to a distributed loop.

    Distributed colouring: trim what lies on no cycle, give every node the greatest id that reaches it,
    take from each colour the nodes that reach its root inside the colour, remove them, repeat. A round settles
    one component per colour, so acyclic parts vanish by trimming and dense ones in a few rounds.
    """
    spark = edges.sparkSession
    stage = Stage(spark, "scc")
    e = edges if kinds is None else edges.where(F.col("kind").isin(*kinds))
    pairs = stage.keep(e.select("source", "target").distinct())
    loops = pairs.where("source = target").select(F.col("source").alias("id"), F.col("source").alias("component"))
    proper = pairs.where("source <> target")
    work = proper
    if stage.rows > small:
        work = _trim(stage, large(stage.keep(proper)))
    if stage.rows <= small:

        def solve(pdf: pd.DataFrame) -> pd.DataFrame:
            rows = [(n, c[0]) for c in tarjan(list(zip(pdf["source"], pdf["target"], strict=True))) for n in c]
            return pd.DataFrame(rows, columns=["id", "component"])

        out = work.withColumn("all", F.lit(0)).groupBy("all").applyInPandas(solve, "id string, component string")
        out = stage.keep(out)
        return out.unionByName(loops.join(out.select("id"), "id", "left_anti")) if self_loops else out
    settled = None
    while not work.isEmpty():
        nodes = work.select(F.explode(F.array("source", "target")).alias("id")).distinct()
        colour = large(stage.keep(nodes.withColumn("c", F.col("id"))))
        while True:
            pushed = work.join(colour.select(F.col("id").alias("source"), "c"), "source").groupBy(F.col("target").alias("id")).agg(F.max("c").alias("p"))
            new = stage.keep(colour.join(large(pushed), "id", "left").select("id", F.greatest("c", F.coalesce("p", "c")).alias("c"), (F.coalesce("p", "c") > F.col("c")).alias("up")))
            still = new.where("up").isEmpty()
            colour = new.select("id", "c")
            if still:
                break
        same = stage.keep(
            work.join(colour.select(F.col("id").alias("source"), F.col("c").alias("cs")), "source").join(colour.select(F.col("id").alias("target"), F.col("c").alias("ct")), "target").where("cs = ct").select("source", "target", F.col("cs").alias("c"))
        )
        found = large(stage.keep(colour.where("id = c")))
        front = found
        while True:
            back = same.join(front.select(F.col("id").alias("target"), "c"), ["target", "c"]).select(F.col("source").alias("id"), "c").distinct()
            front = large(stage.keep(back.join(found, ["id", "c"], "left_anti")))
            if front.isEmpty():
                break
            found = large(stage.keep(found.unionByName(front)))
        settled = found if settled is None else settled.unionByName(found)
        rest = work.join(found.select(F.col("id").alias("source")), "source", "left_anti").join(found.select(F.col("id").alias("target")), "target", "left_anti")
        work = _trim(stage, large(stage.keep(rest.select("source", "target"))))
    if settled is None:
        out = loops.limit(0)
    else:
        sizes = settled.groupBy("c").agg(F.min("id").alias("component"), F.count("*").alias("n")).where("n > 1")
        out = settled.join(sizes, "c").select("id", "component")
    if self_loops:
        out = out.unionByName(loops.join(out.select("id"), "id", "left_anti"))
    return out


def shortest_cycle(nodes: list[str], adjacency: dict[str, list[str]], starts: int = 32) -> list[str] | None:
    """The first mutual pair in order, else the shortest cycle by breadth-first search from the first nodes.

    Neighbours are taken by id; a later start wins only with a strictly shorter cycle.
    """
    for s in nodes:
        for t in adjacency[s]:
            if t != s and s in adjacency[t]:
                return [s, t]
    best: list[str] | None = None
    for start in nodes[:starts]:
        before: dict[str, str | None] = {start: None}
        queue, path = deque([start]), None
        while queue and path is None:
            at = queue.popleft()
            for nxt in adjacency[at]:
                if nxt == start and at != start:
                    path, k = [], at
                    while k is not None:
                        path.append(k)
                        k = before[k]
                    path.reverse()
                    break
                if nxt not in before:
                    before[nxt] = at
                    queue.append(nxt)
        if path and len(path) >= 2 and (best is None or len(path) < len(best)):
            best = path
    return best


def representative_cycles(edges: DataFrame, components: DataFrame, kinds: tuple[str, ...] = CYCLE_KINDS, starts: int = 32, small: int = 20_000) -> DataFrame:
    """component, length, path (ids joined by ' > '): one shortest cycle of each component.

    Mutual pairs are found by a self-join over all components; only components without one are searched, each
    in one grouped task. A component over ``small`` edges is not gathered: it is searched by a distributed
    breadth-first loop from its first nodes.
    """
    pairs = edges.where(F.col("kind").isin(*kinds)).select("source", "target").distinct()
    inside = pairs.join(components.select(F.col("id").alias("source"), "component"), "source").join(components.select(F.col("id").alias("target"), F.col("component").alias("ct")), "target").where("component = ct and source <> target").select("component", "source", "target")
    inside = Stage(edges.sparkSession, "cycles").keep(inside)
    back = inside.select(F.col("source").alias("target"), F.col("target").alias("source"), "component")
    mutual = inside.where("source < target").join(back, ["source", "target", "component"]).groupBy("component").agg(F.min(F.struct("source", "target")).alias("p"))
    mutual = mutual.select("component", F.lit(2).cast("long").alias("length"), F.concat_ws(" > ", "p.source", "p.target").alias("path"))
    rest = inside.join(mutual.select("component"), "component", "left_anti")
    sizes = rest.groupBy("component").agg(F.count("*").alias("n"))

    def search(pdf: pd.DataFrame) -> pd.DataFrame:
        adjacency: dict[str, list[str]] = {n: [] for n in sorted(set(pdf["source"]) | set(pdf["target"]))}
        for s, t in sorted(zip(pdf["source"], pdf["target"], strict=True)):
            adjacency[s].append(t)
        path = shortest_cycle(list(adjacency), adjacency, starts)
        rows = [(pdf["component"].iloc[0], len(path), " > ".join(path))] if path else []
        return pd.DataFrame(rows, columns=["component", "length", "path"])

    local = rest.join(sizes.where(F.col("n") <= small).select("component"), "component", "left_semi")
    searched = local.groupBy("component").applyInPandas(search, "component string, length long, path string")
    out = mutual.unionByName(searched)
    for row in sizes.where(F.col("n") > small).toLocalIterator():
        out = out.unionByName(_distributed_cycle(rest.where(F.col("component") == row["component"]), row["component"], starts))
    return out


def _distributed_cycle(inside: DataFrame, component: str, starts: int) -> DataFrame:
    """Breadth-first search from each of the first nodes at once; state (start, node), predecessors by order."""
    spark = inside.sparkSession
    stage = Stage(spark, "bigcycle")
    first = inside.select(F.col("source").alias("start")).distinct().orderBy("start").limit(starts)
    seen = stage.keep(first.select("start", F.col("start").alias("node"), F.col("start").alias("path")))
    front = seen
    while True:
        step = front.join(inside.select(F.col("source").alias("node"), F.col("target").alias("next")), "node")
        closed = step.where("next = start").agg(F.min(F.struct("start", "path")).alias("c")).first()["c"]
        if closed is not None:
            path = closed["path"]
            return spark.createDataFrame([(component, path.count(" > ") + 1, path)], "component string, length long, path string")
        new = step.join(seen.select("start", F.col("node").alias("next")), ["start", "next"], "left_anti")
        new = stage.keep(new.groupBy("start", "next").agg(F.min("path").alias("p")).select("start", F.col("next").alias("node"), F.concat_ws(" > ", "p", "next").alias("path")))
        seen = stage.keep(seen.unionByName(new))
        front = new


def weakest_links(cycles: DataFrame, edges: DataFrame, kinds: tuple[str, ...] = CYCLE_KINDS) -> DataFrame:
    """component, source, target, kind, weight: the lightest hop of each cycle; a hop is its heaviest edge
    (ties: the first kind by rank), and of equal hops the first in edge order wins."""
    from .graph import kind_rank

    nodes = cycles.select("component", F.split("path", " > ").alias("p"))
    hops = nodes.select("component", "p", F.posexplode("p").alias("i", "source"))
    hops = hops.select("component", "source", F.coalesce(F.get("p", F.col("i") + 1), F.get("p", F.lit(0))).alias("target"))
    e = edges.where(F.col("kind").isin(*kinds)).withColumn("rank", kind_rank(F.col("kind")))
    heavy = hops.join(e, ["source", "target"]).groupBy("component", "source", "target").agg(F.max_by(F.struct("kind", "weight", "rank"), F.struct("weight", -F.col("rank"))).alias("e"))
    best = F.row_number().over(Window.partitionBy("component").orderBy("e.weight", "source", "target", "e.rank"))
    return heavy.withColumn("k", best).where("k = 1").select("component", "source", "target", "e.kind", "e.weight")
