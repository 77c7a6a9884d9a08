"""Retention roots, conditional reachability and the findings that follow from it."""

from __future__ import annotations

from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import any_glob
from ..plans.stage import Stage, large, semi_naive
from ..sources.schemas import TYPE_KINDS, USAGE_KINDS
from .graph import Graph, ancestors, semantic_parent

PROTOCOLS = {"CodingKey": "coding-key", "CaseIterable": "case-iterable", "RawRepresentable": "raw-representable", "Codable": "codable", "Equatable": "equatable", "Hashable": "hashable"}


@dataclass(frozen=True)
class Retention:
    retain_public: bool = False
    retain_objc: bool = True
    retained_files: tuple[str, ...] = ()
    retained_names: tuple[str, ...] = ()
    excluded_kinds: tuple[str, ...] = ("module", "parameter", "macro", "unknown")
    test_modules: tuple[str, ...] = field(default=())


def _has(*flags: str) -> Column:
    return F.arrays_overlap("attributes", F.array(*map(F.lit, flags)))


def retention_reason(options: Retention) -> Column:
    """The first reason that applies, in fixed order. Expects attributes, accessibility, name, path,
    missing_source, external_bridge, parent_kind, parent_attributes, outside and ignored_target columns."""
    checks: list[tuple[str, Column]] = [
        ("sourceUnavailable", F.col("missing_source")),
        ("ignoreComment", _has("ignored")),
        ("userConfigured", any_glob(F.coalesce("path", F.lit("")), options.retained_files) | any_glob(F.col("name"), options.retained_names)),
        ("externalBridge", F.col("external_bridge")),
        ("compilerSynthesized", _has("implicit", "synthesized")),
        ("compileTimeReference", _has("compileTimeReference")),
        ("entryPoint", _has("main", "uiApplicationMain", "nsApplicationMain") | (F.col("path").rlike(r"(^|/)main\.swift$") & F.col("parent_kind").isNull())),
        ("xcTest", _has("xcTest")),
        ("swiftTesting", _has("swiftTest", "swiftSuite")),
        ("preview", _has("preview")),
        ("publicAPI", F.lit(options.retain_public) & F.col("accessibility").isin("public", "open")),
        ("objectiveCAccessible", F.lit(options.retain_objc) & _has("objc", "objcMembers")),
        ("interfaceBuilder", _has("ibAction", "ibOutlet", "ibDesignable", "ibInspectable", "interfaceBuilderClass")),
        ("dynamicDispatch", _has("dynamic", "dynamicCallable", "dynamicMemberLookup")),
        ("runtimeManaged", _has("nsManaged", "runtimeManaged")),
        ("entryPointMember", (F.col("name") == "main()") & F.arrays_overlap("parent_attributes", F.array(F.lit("main")))),
        ("synthesizedMember", F.arrays_overlap("parent_attributes", F.array(*map(F.lit, PROTOCOLS.values()))) & F.col("kind").isin("case", "property"))
        ,
        ("wrapperMember", F.arrays_overlap("parent_attributes", F.array(F.lit("propertyWrapper"))) & F.col("name").isin("wrappedValue", "projectedValue")),
        ("resultBuilderMember", F.arrays_overlap("parent_attributes", F.array(F.lit("resultBuilder"))) & F.col("name").startswith("build")),
        ("externalRelation", F.col("outside")),
        ("ignoredSourceReference", F.col("ignored_target")),
    ]
    return F.coalesce(*[F.when(F.coalesce(c, F.lit(False)), F.lit(r)) for r, c in checks])


def review_reasons(options: Retention) -> Column:
    """All reasons, not only the first."""
    return F.array_compact(F.array(*[F.when(_has(f), F.lit(r)) for r, f in (("objectiveCAccessible", "objc"), ("interfaceBuilder", "ibOutlet"), ("dynamicDispatch", "dynamic"), ("preview", "preview"), ("runtimeManaged", "nsManaged"))]))


def outside_relations(references: DataFrame, node_ids: DataFrame) -> DataFrame:
    """ids with an overrides or conformance reference whose target is not a node."""
    r = references.where(F.col("kind").isin("overrides", "conformance"))
    return r.join(node_ids.select(F.col("id").alias("targetUSR")), "targetUSR", "left_anti").select(F.col("sourceUSR").alias("id")).distinct()


def conformance_closure(references: DataFrame, seeds: dict[str, str]) -> DataFrame:
    """(id, flag): types that conform, directly or through protocols, to a seed protocol."""
    spark = references.sparkSession
    conf = references.where(F.col("kind").isin("conformance", "inheritance")).select(F.col("sourceUSR").alias("id"), F.col("targetUSR").alias("to")).distinct()
    seed = spark.range(1).select(F.explode(F.create_map(*[x for k, v in seeds.items() for x in (F.lit(k), F.lit(v))])).alias("id", "flag"))
    step = lambda new, known, k: new.withColumnRenamed("id", "to").join(conf, "to").select("id", "flag").distinct()
    return semi_naive(seed, step, ["id", "flag"], label="conform")[0]


def retained(graph: Graph, references: DataFrame, options: Retention = Retention(), missing_paths: DataFrame | None = None, external: DataFrame | None = None, ignored: DataFrame | None = None) -> DataFrame:
    """(id, reason) of root nodes; nodes need attributes, accessibility, location."""
    parents = semantic_parent(graph.nodes, graph.edges)
    p = graph.nodes.select(F.col("id").alias("parent"), F.col("kind").alias("parent_kind"), F.col("attributes").alias("parent_attributes"))
    flag = lambda df, name: df.select("id").distinct().withColumn(name, F.lit(True))
    n = graph.nodes.withColumn("path", F.col("location.path")).join(parents, "id", "left").join(p, "parent", "left")
    n = n.join(flag(outside_relations(references, graph.nodes), "outside"), "id", "left")
    none = F.lit(None).cast("boolean")
    n = n.join(flag(external, "external_bridge"), "id", "left") if external is not None else n.withColumn("external_bridge", none)
    n = n.join(flag(ignored, "ignored_target"), "id", "left") if ignored is not None else n.withColumn("ignored_target", none)
    n = n.join(missing_paths.select("path").distinct().withColumn("missing_source", F.lit(True)), "path", "left") if missing_paths is not None else n.withColumn("missing_source", none)
    return n.withColumn("reason", retention_reason(options)).where("reason is not null").select("id", "reason")


def inherited_roots(roots: DataFrame, parents: DataFrame) -> DataFrame:
    """Containers of roots: (id, by), the least retained member that keeps them."""
    up = ancestors(parents)
    return up.join(roots.select("id"), "id", "left_semi").groupBy(F.col("ancestor").alias("id")).agg(F.min("id").alias("by"))


#: Up to this many edges and waiting pairs (counted first) are traversed in one grouped task.
SMALL_ROWS = 300_000


def _rules_of(pdf: pd.DataFrame) -> tuple[dict, dict, dict]:
    """Edges by source, waiting pairs by requirement and by owner, of rows (what, a, b, c) as ``_traverse_local`` has."""
    out: dict[str, list[str]] = {}
    by_q: dict[str, list[tuple[str, str]]] = {}
    by_owner: dict[str, list[tuple[str, str | None]]] = {}
    for what, a, b, c in zip(pdf["what"], pdf["a"], pdf["b"], pdf["c"], strict=True):
        if what == "edge":
            out.setdefault(a, []).append(b)
        elif what == "wait":
            if b is not None:
                by_q.setdefault(b, []).append((a, c))
            by_owner.setdefault(c, []).append((a, b))
    return out, by_q, by_owner


def _spread(reached: dict[str, tuple[str | None, int]], rules: tuple[dict, dict, dict]) -> None:
    """Adds to ``reached`` all that it reaches, round by round with the least predecessor."""
    out, by_q, by_owner = rules
    front, k = list(reached), 0
    while front:
        k += 1
        found: dict[str, str] = {}

        def offer(node: str, by: str, found: dict[str, str] = found) -> None:
            if node not in reached and (node not in found or by < found[node]):
                found[node] = by

        for x in front:
            for t in out.get(x, ()):
                offer(t, x)
            for w, owner in by_q.get(x, ()):
                if owner in reached:
                    offer(w, x)
            for w, q in by_owner.get(x, ()):
                if q is None:
                    offer(w, x)
                elif q in reached:
                    offer(w, q)
        for n, by in found.items():
            reached[n] = (by, k)
        front = list(found)


def _traverse_local(pdf: pd.DataFrame) -> pd.DataFrame:
    """The rules of ``reachable`` over rows (what, a, b, c): seed (id, predecessor), edge (from, to), wait
    (w, q, owner; q null for a conditional root)."""
    seeds = pdf[pdf["what"] == "seed"]
    reached: dict[str, tuple[str | None, int]] = {a: (b, 0) for a, b in zip(seeds["a"], seeds["b"], strict=True)}
    _spread(reached, _rules_of(pdf))
    rows = [(n, by, r) for n, (by, r) in reached.items()]
    return pd.DataFrame(rows, columns=["id", "predecessor", "round"])


def _rule_rows(edges: DataFrame, pending: DataFrame, waiting: DataFrame | None) -> DataFrame:
    none = F.lit(None).cast("string")
    rows = edges.select(F.lit("edge").alias("what"), F.col("source").alias("a"), F.col("target").alias("b"), none.alias("c"))
    rows = rows.unionByName(pending.select(F.lit("wait").alias("what"), F.col("w").alias("a"), F.col("q").alias("b"), F.col("owner").alias("c")))
    return rows if waiting is None else rows.unionByName(waiting.select(F.lit("wait").alias("what"), F.col("id").alias("a"), none.alias("b"), F.col("owner").alias("c")))


def reachable(graph: Graph, roots: DataFrame, conditional: DataFrame | None = None, closed: DataFrame | None = None, small: int = SMALL_ROWS) -> DataFrame:
    """(id, predecessor, round) of all nodes that the roots reach.

    Usage edges are followed, member edges only into a deinit, overrides not from a non-requirement into a
    requirement of a protocol. A node that overrides a reached one is reached at once when it is a default (in
    an extension of the requirement's protocol) or has no owner, else once its owner is reached. A conditional
    root (id, owner) waits for its owner. The last two rules join the new rows on either side with all known
    ones. Predecessors are the least of the first round, so they are the same in every run. ``closed``: rows
    of an earlier traversal taken as reached (for counterfactuals).
    """
    stage = Stage(graph.edges.sparkSession, "reach")
    nodes, edges, pending = _rules(stage, graph)
    waiting = conditional.select("id", "owner").distinct() if conditional is not None else None
    return _closure(stage, nodes, edges, pending, waiting, roots, closed, small)


def _rules(stage: Stage, graph: Graph) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(id, kind) of nodes, plain edges and pairs that wait for an owner (w, q, owner), all stored."""
    nodes = large(stage.keep(graph.nodes.select("id", "kind")))
    parents = large(stage.keep(semantic_parent(nodes, graph.edges)))
    own = parents.join(nodes.select(F.col("id").alias("parent"), F.col("kind").alias("pk")), "parent", "left")
    requirement = large(own.where("pk = 'protocol'").select("id", F.col("parent").alias("protocol")))
    e = large(graph.edges)
    req_s = requirement.select(F.col("id").alias("source"), F.lit(True).alias("source_req"))
    req_t = requirement.select(F.col("id").alias("target"), F.lit(True).alias("target_req"), "protocol")
    plain = e.where(F.col("kind").isin(*[k for k in USAGE_KINDS if k != "overrides"])).select("source", "target")
    over = e.where("kind = 'overrides'").select("source", "target").join(req_s, "source", "left").join(req_t, "target", "left")
    forward = over.where("not (coalesce(target_req, false) and not coalesce(source_req, false))").select("source", "target")
    deinit = e.where("kind = 'member'").join(nodes.where("kind = 'deinit'").select(F.col("id").alias("target")), "target", "left_semi").select("source", "target")
    # Direct member edges tell an extension from its type: a default sits in an extension of the protocol.
    direct = e.where("kind = 'member'").groupBy(F.col("target").alias("source")).agg(F.min("source").alias("holder"))
    holder = large(direct.join(nodes.select(F.col("id").alias("holder"), F.col("kind").alias("hk")), "holder", "left"))
    owner = parents.select(F.col("id").alias("source"), F.col("parent").alias("owner"))
    witness = over.join(holder, "source", "left").join(owner, "source", "left")
    known_owner = nodes.select(F.col("id").alias("owner"), F.lit(True).alias("owner_known"))
    witness = witness.join(known_owner, "owner", "left")
    at_once = (F.coalesce(F.col("hk") == "extension", F.lit(False)) & F.col("owner").eqNullSafe(F.col("protocol"))) | ~F.coalesce("owner_known", F.lit(False))
    immediate = witness.where(at_once).select(F.col("target").alias("source"), F.col("source").alias("target"))
    pending = witness.where(~at_once).select(F.col("source").alias("w"), F.col("target").alias("q"), "owner")
    edges = large(stage.keep(plain.unionByName(forward).unionByName(deinit).unionByName(immediate).distinct()))
    return nodes, edges, large(stage.keep(pending.distinct()))


def _closure(stage: Stage, nodes: DataFrame, edges: DataFrame, pending: DataFrame, waiting: DataFrame | None, roots: DataFrame, closed: DataFrame | None, small: int) -> DataFrame:
    seed = roots.select("id", F.lit(None).cast("string").alias("predecessor"), F.lit(0).alias("round")).dropDuplicates(["id"])
    seed = seed.join(nodes.select("id"), "id", "left_semi")
    if closed is not None:
        seed = seed.unionByName(large(closed.select("id", "predecessor", F.lit(0).alias("round"))).join(seed.select("id"), "id", "left_anti"))
    if edges.limit(small + 1).count() + pending.limit(small + 1).count() <= small:
        none = F.lit(None).cast("string")
        rows = seed.select(F.lit("seed").alias("what"), F.col("id").alias("a"), F.col("predecessor").alias("b"), none.alias("c")).unionByName(_rule_rows(edges, pending, waiting))
        return large(stage.keep(rows.withColumn("all", F.lit(0)).groupBy("all").applyInPandas(_traverse_local, "id string, predecessor string, round int")))
    waiting = large(stage.keep(waiting)) if waiting is not None else None

    def step(new: DataFrame, known: DataFrame, k: int) -> DataFrame:
        n, a = new.select("id"), known.select("id")
        found = edges.join(n.withColumnRenamed("id", "source"), "source").select(F.col("target").alias("id"), F.col("source").alias("predecessor"))
        by_req = pending.join(n.withColumnRenamed("id", "q"), "q").join(a.withColumnRenamed("id", "owner"), "owner", "left_semi")
        by_owner = pending.join(n.withColumnRenamed("id", "owner"), "owner").join(a.withColumnRenamed("id", "q"), "q", "left_semi")
        for half in (by_req, by_owner):
            found = found.unionByName(half.select(F.col("w").alias("id"), F.col("q").alias("predecessor")))
        if waiting is not None:
            found = found.unionByName(waiting.join(n.withColumnRenamed("id", "owner"), "owner").select("id", F.col("owner").alias("predecessor")))
        return found.groupBy("id").agg(F.min("predecessor").alias("predecessor")).withColumn("round", F.lit(k))

    return semi_naive(seed, step, ["id"], label="reach")[0]


def unused(graph: Graph, reached: DataFrame, options: Retention = Retention()) -> DataFrame:
    """Unreached nodes worth reporting: not of excluded kinds, implicit or local, nor below an unreached type."""
    dead = graph.nodes.join(large(reached.select("id")), "id", "left_anti")
    kinds = dead.where(~F.col("kind").isin(*options.excluded_kinds) & ~F.coalesce(_has("implicit"), F.lit(False)) & ~F.col("id").startswith("local:"))
    parents = semantic_parent(graph.nodes, graph.edges)
    dead_types = kinds.where(F.col("kind").isin(*TYPE_KINDS)).select(F.col("id").alias("ancestor"))
    below = ancestors(parents).join(dead_types, "ancestor", "left_semi").select("id").distinct()
    return kinds.join(large(below), "id", "left_anti")


def test_only(graph: Graph, reached: DataFrame, production_reached: DataFrame, options: Retention) -> DataFrame:
    """Reached, but from tests alone; declarations of test modules and test marks are left out."""
    rest = reached.select("id").join(production_reached.select("id"), "id", "left_anti")
    n = graph.nodes.join(large(rest), "id", "left_semi")
    return n.where(~F.coalesce(F.col("module").isin(*options.test_modules), F.lit(False)) & ~F.coalesce(_has("xcTest", "swiftTest", "swiftSuite", "preview"), F.lit(False)))


def unused_parameters(parameters: DataFrame, reached: DataFrame, requirements: DataFrame) -> DataFrame:
    """Parameters known not to be referenced (null is no evidence) of reached functions that are no requirement."""
    p = parameters.where("isReferenced = false")
    return p.join(reached.select(F.col("id").alias("functionUSR")), "functionUSR", "left_semi").join(requirements.select(F.col("id").alias("functionUSR")), "functionUSR", "left_anti")


def assign_only(accesses: DataFrame, graph: Graph, hiding_owners: DataFrame | None = None) -> DataFrame:
    """Properties written but never read, without ambiguous access, private or internal, that override nothing
    and whose owner does not hide reads."""
    a = accesses.where("hasWrite and not hasRead and not hasAmbiguous").select(F.col("usr").alias("id"))
    n = graph.nodes.join(a, "id", "left_semi").where("kind in ('property', 'variable') and accessibility not in ('public', 'open')")
    over = graph.edges.where("kind = 'overrides'")
    n = n.join(over.select(F.col("source").alias("id")), "id", "left_anti").join(over.select(F.col("target").alias("id")), "id", "left_anti")
    if hiding_owners is not None:
        hidden = semantic_parent(graph.nodes, graph.edges).join(hiding_owners.select(F.col("id").alias("parent")), "parent", "left_semi")
        n = n.join(hidden.select("id"), "id", "left_anti")
    return n


def superfluous_ignores(graph: Graph, roots: DataFrame, units: list[tuple[str, list[str]]], conditional: DataFrame | None = None, small: int = SMALL_ROWS) -> list[str]:
    """Ignore comments (unit name, its member ids, in source order) that keep nothing alive.

    A unit is superfluous when all of its members stay reached without its own roots. Units are tried in order
    and a superfluous one stays removed for the next. Two traversals settle what the other roots reach and what
    the ignored members reach beside. A unit can only be reached through that rest: one of whose members no rule of
    the rest ends at is needed, and the others are tried over the rest alone, in one task when it is small.
    """
    spark = graph.nodes.sparkSession
    stage = Stage(spark, "ignores")
    ignored = sorted({m for _, ms in units for m in ms})
    frame = lambda ids: spark.createDataFrame([(i,) for i in sorted(ids)] or [("",)], "id string")
    nodes, edges, pending = _rules(stage, graph)
    waiting = large(stage.keep(conditional.select("id", "owner").distinct())) if conditional is not None else None
    marked = large(stage.keep(frame(ignored)))
    base = _closure(stage, nodes, edges, pending, waiting, roots.join(marked, "id", "left_anti"), None, small)
    free = {r["id"] for r in marked.join(base.select("id"), "id", "left_semi").collect()}  # bounded by the ignored members
    if all(set(ms) <= free for _, ms in units):
        return [name for name, _ in units]
    every = _closure(stage, nodes, edges, pending, waiting, marked, base, small)
    known = large(stage.keep(every.join(base.select("id", F.lit(True).alias("always")), "id", "left").select("id", F.coalesce("always", F.lit(False)).alias("always"))))
    rest = known.where("not always").select("id")
    at = lambda c: known.select(F.col("id").alias(c), F.col("always").alias(f"{c}_always"))
    inner = edges.join(rest.withColumnRenamed("id", "source"), "source", "left_semi").join(rest.withColumnRenamed("id", "target"), "target", "left_semi")
    both = large(stage.keep(pending.join(rest.withColumnRenamed("id", "w"), "w", "left_semi").join(at("q"), "q").join(at("owner"), "owner")))
    # Of a pair that waits, what base reaches is there already: the other one alone decides.
    inner = inner.select("source", "target").unionByName(both.where("q_always").select(F.col("owner").alias("source"), F.col("w").alias("target")))
    inner = inner.unionByName(both.where("owner_always and not q_always").select(F.col("q").alias("source"), F.col("w").alias("target")))
    if waiting is not None:
        inner = inner.unionByName(waiting.join(rest, "id", "left_semi").join(rest.withColumnRenamed("id", "owner"), "owner", "left_semi").select(F.col("owner").alias("source"), F.col("id").alias("target")))
    inner = large(stage.keep(inner.distinct()))
    both = large(stage.keep(both.where("not q_always and not owner_always").select("w", "q", "owner")))
    ends = inner.select(F.col("target").alias("id")).unionByName(both.select(F.col("w").alias("id"))).distinct()
    open_ = free | {r["id"] for r in marked.join(large(ends), "id", "left_semi").collect()}  # bounded by the ignored members
    tried = [(name, ms) for name, ms in units if set(ms) <= open_]
    if all(set(ms) <= free for _, ms in tried):
        return [name for name, _ in tried]
    seeds = {r["id"] for r in marked.join(rest, "id", "left_semi").collect()}  # bounded by the ignored members
    if inner.limit(small + 1).count() + both.limit(small + 1).count() <= small:

        def solve(pdf: pd.DataFrame) -> pd.DataFrame:
            rules, kept, out = _rules_of(pdf), set(seeds), []
            for k, (_, ms) in enumerate(tried):
                reached = {i: (None, 0) for i in kept - set(ms)}
                _spread(reached, rules)
                if all(m in free or m in reached for m in ms):
                    out.append(k)
                    kept -= set(ms)
            return pd.DataFrame({"k": out}, columns=["k"])

        rows = _rule_rows(inner, both, None).withColumn("all", F.lit(0)).groupBy("all").applyInPandas(solve, "k int")
        return [tried[r["k"]][0] for r in rows.orderBy("k").collect()]
    out, kept = [], set(seeds)
    for name, ms in tried:
        again = _closure(stage, rest, inner, both, None, frame(kept - set(ms)), None, small)
        still = free | {r["id"] for r in again.join(frame(ms), "id", "left_semi").select("id").collect()}
        if set(ms) <= still:
            out.append(name)
            kept -= set(ms)
    return out


def explain(reached: DataFrame, roots: DataFrame, requests: DataFrame, horizon: int | None = None) -> DataFrame:
    """id, state (retained, reachable, unreachable), step, node: for each requested id the path from its root, in order.

    With ``horizon``, a node more than so many steps from every root counts as unreachable.

    All requests climb the predecessors together, EIGHT steps in one plan, as often as the deepest of them needs; the
    breadth-first round of a node is the length of its path.
    """
    stage = Stage(reached.sparkSession, "explain")
    if horizon is not None:
        reached = reached.where(F.col("round") <= horizon)
    up = reached.select(F.col("id").alias("node"), "predecessor")
    asked = requests.select("id").distinct()
    kept = roots.select("id").distinct().withColumn("kept", F.lit(True))
    met = stage.keep(asked.join(reached.select("id", "round"), "id", "left").join(kept, "id", "left"))
    state = F.when(F.col("kept"), "retained").when(F.col("round").isNotNull(), "reachable").otherwise("unreachable")
    now = met.where("round is not null").select("id", F.lit(0).alias("back"), F.col("id").alias("node"))
    out = stage.add("path", now)
    while True:
        steps = None
        for _ in range(8):
            now = now.join(up, "node").where("predecessor is not null").select("id", (F.col("back") + 1).alias("back"), F.col("predecessor").alias("node"))
            steps = now if steps is None else steps.unionByName(now)
        out = stage.add("path", steps)
        now = stage.latest("path", out.schema).join(out.groupBy("id").agg(F.max("back").alias("back")), ["id", "back"]).where(F.col("back") % 8 == 0)
        if now.isEmpty():
            break
    length = out.groupBy("id").agg(F.max("back").alias("n"))
    path = out.join(length, "id").select("id", (F.col("n") - F.col("back")).alias("step"), "node")
    return met.select("id", state.alias("state")).join(path, "id", "left")
