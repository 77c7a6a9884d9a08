"""Reverse impact with dispatch projection, supplemental edges, affected tests and comparisons."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.stage import Stage, semi_naive
from ..sources.schemas import USAGE_KINDS
from .graph import Graph, diff_graphs, semantic_parent

RELATIONS = ("dependent", "dispatchContract", "dispatchCaller", "runtimeContract", "automaticRuntime", "observedRuntime")


def contracts_above(edges: DataFrame) -> DataFrame:
    """(id, contract): the closure of overrides above every overriding node."""
    up = edges.where("kind = 'overrides'").select(F.col("source").alias("id"), F.col("target").alias("contract")).distinct()
    hop = up.select(F.col("id").alias("contract"), F.col("contract").alias("next"))
    step = lambda new, known, k: new.join(hop, "contract").select("id", F.col("next").alias("contract")).distinct()
    return semi_naive(up, step, ["id", "contract"], label="contracts")[0]


def impact_hops(graph: Graph, supplemental: DataFrame | None = None) -> DataFrame:
    """(via, id, rank, kinds, contract): who is affected when ``via`` changes, one row per way.

    Direct dependents with all their kinds; callers of any contract that ``via`` overrides, except the
    protocol that owns the contract; supplemental dependencies (source, target, relation), where observed beats
    automatic beats declared. Kinds are sorted by name.
    """
    e = graph.edges
    usage = e.where(F.col("kind").isin(*USAGE_KINDS))
    names = F.array_join(F.sort_array(F.collect_set("kind")), ",")
    direct = usage.groupBy(F.col("target").alias("via"), F.col("source").alias("id")).agg(names.alias("kinds"), F.max(F.col("kind") == "overrides").alias("o"))
    direct = direct.select("via", "id", F.when(F.col("o"), 1).otherwise(0).alias("rank"), "kinds", F.lit(None).cast("string").alias("contract"))
    above = contracts_above(e)
    protocols = graph.nodes.where("kind = 'protocol'").select(F.col("id").alias("parent"))
    own = semantic_parent(graph.nodes, e).join(protocols, "parent", "left_semi").select(F.col("id").alias("contract"), F.col("parent").alias("caller"))
    callers = usage.where("kind <> 'overrides'").groupBy(F.col("target").alias("contract"), F.col("source").alias("caller")).agg(F.collect_set("kind").alias("ks"))
    callers = callers.join(own, ["contract", "caller"], "left_anti")
    kinds = F.array_join(F.sort_array(F.array_union("ks", F.array(F.lit("overrides")))), ",")
    dispatch = above.withColumnRenamed("id", "via").join(callers, "contract").select("via", F.col("caller").alias("id"), F.lit(2).alias("rank"), kinds.alias("kinds"), "contract")
    out = direct.unionByName(dispatch)
    if supplemental is not None:
        rank = F.array_position(F.array(*map(F.lit, RELATIONS)), F.col("relation")).cast("int") - 1
        best = supplemental.groupBy(F.col("target").alias("via"), F.col("source").alias("id")).agg(F.max(rank).alias("rank"))
        out = out.unionByName(best.select("via", "id", "rank", F.lit("").alias("kinds"), F.lit(None).cast("string").alias("contract")))
    return out.where("via <> id")


def impact(graph: Graph, changed: DataFrame, max_depth: int | None = None, supplemental: DataFrame | None = None, hops: DataFrame | None = None) -> tuple[DataFrame, bool]:
    """(id, depth, via, relation, kinds, contract) of all affected nodes, and whether depth cut any off.

    Breadth first: in each layer a node takes its least candidate by (via, relation, kinds, contract, absent
    first). Changed ids that are no nodes start nothing.
    """
    stage = Stage(graph.edges.sparkSession, "impact")
    hops = stage.keep(impact_hops(graph, supplemental) if hops is None else hops)
    seed = changed.select("id").distinct().join(graph.nodes.select("id"), "id", "left_semi")
    none = F.lit(None).cast("string")
    seed = seed.select("id", F.lit(0).alias("depth"), none.alias("via"), F.lit(-1).alias("rank"), none.alias("kinds"), none.alias("contract"))

    def step(new: DataFrame, known: DataFrame, k: int) -> DataFrame:
        met = hops.join(new.select(F.col("id").alias("via")), "via")
        # A struct orders null first, as an absent contract is.
        best = met.groupBy("id").agg(F.min(F.struct("via", "rank", "kinds", "contract")).alias("b"))
        return best.select("id", F.lit(k).alias("depth"), "b.via", "b.rank", "b.kinds", "b.contract")

    rows, cut = semi_naive(seed, step, ["id"], max_depth, "impact")
    relation = F.get(F.array(*map(F.lit, RELATIONS)), F.col("rank"))
    return rows.where("depth > 0").select("id", "depth", "via", relation.alias("relation"), "kinds", "contract"), cut


def receiver_states(graph: Graph, hops: DataFrame, changed: DataFrame, receivers: DataFrame, final_types: DataFrame, budget: int = 50_000) -> tuple[DataFrame, bool]:
    """Impact over (node, receiver): a dispatch caller whose known receivers are all other final types is left
    out. Returns (ids, precise); above the state budget the plain impact stands and ``precise`` is false.

    ``receivers``: source, target, receiver (type) per call; ``final_types``: id.
    """
    known = receivers.join(final_types.select(F.col("id").alias("receiver")), "receiver", "left")
    owner = semantic_parent(graph.nodes, graph.edges).select(F.col("id").alias("via"), F.col("parent").alias("via_type"))
    final = final_types.select(F.col("id").alias("receiver"), F.lit(True).alias("final"))
    calls = known.select("source", "target", "receiver").join(final, "receiver", "left")
    facts = calls.groupBy(F.col("source").alias("id"), F.col("target").alias("contract")).agg(F.bool_and(F.coalesce("final", F.lit(False))).alias("all_final"), F.collect_set("receiver").alias("types"))
    h = hops.join(owner, "via", "left").join(facts, ["id", "contract"], "left")
    excluded = F.coalesce(F.col("all_final"), F.lit(False)) & ~F.coalesce(F.array_contains("types", F.col("via_type")), F.lit(True))
    precise = h.where(~((F.col("rank") == 2) & excluded)).select("via", "id", "rank", "kinds", "contract")
    if precise.count() > budget * 32:
        return impact(graph, changed, hops=hops)[0], False
    rows, _ = impact(graph, changed, hops=precise)
    return (rows, True) if rows.count() <= budget else (impact(graph, changed, hops=hops)[0], False)


def xctest_classes(nodes: DataFrame, edges: DataFrame, base: str = "XCTestCase") -> DataFrame:
    """ids of classes below a test base class, by inheritance."""
    inherits = edges.where("kind = 'inheritance'").select("source", "target").distinct()
    seed = nodes.where(F.col("name") == base).select("id")
    step = lambda new, known, k: inherits.join(new.withColumnRenamed("id", "target"), "target").select(F.col("source").alias("id")).distinct()
    closure = semi_naive(seed, step, ["id"], label="xctest")[0]
    return closure.join(seed, "id", "left_anti")


def test_identity(nodes: DataFrame, edges: DataFrame, base: str = "XCTestCase") -> DataFrame:
    """(id, certain): test classes and their methods that start with ``test`` and take nothing, or marked ones;
    other marked symbols are uncertain."""
    classes = xctest_classes(nodes, edges, base)
    methods = edges.where("kind = 'member'").join(classes.withColumnRenamed("id", "source"), "source", "left_semi").select(F.col("target").alias("id"))
    methods = nodes.join(methods, "id", "left_semi").where("kind = 'method' and name rlike '^test[^(]*\\\\(\\\\)$'").select("id")
    marked = nodes.where(F.arrays_overlap("attributes", F.array(F.lit("swiftTest"), F.lit("swiftSuite")))).select("id")
    certain = classes.unionByName(methods).unionByName(marked).distinct()
    maybe = nodes.where(F.array_contains("attributes", "xcTest")).select("id").join(certain, "id", "left_anti")
    return certain.withColumn("certain", F.lit(True)).unionByName(maybe.withColumn("certain", F.lit(False)))


def lifecycle_edges(nodes: DataFrame, edges: DataFrame, tests: DataFrame) -> DataFrame:
    """Supplemental (source test, target, relation): a test depends on setUp and tearDown of its class and of
    the classes above it."""
    member = edges.where("kind = 'member'")
    of = member.join(tests.select(F.col("id").alias("target")), "target", "left_semi").select(F.col("target").alias("test"), F.col("source").alias("cls"))
    up = edges.where("kind = 'inheritance'").select(F.col("source").alias("cls"), F.col("target").alias("next")).distinct()
    seed = of.distinct()
    step = lambda new, known, k: new.join(up, "cls").select("test", F.col("next").alias("cls")).distinct()
    closure = semi_naive(seed, step, ["test", "cls"], label="lifecycle")[0]
    hooks = nodes.where("name rlike '^(setUp|tearDown|setUpWithError|tearDownWithError)\\\\('").select(F.col("id").alias("target"))
    stage = Stage(nodes.sparkSession, "hooks")
    held = stage.keep(member.join(hooks, "target", "left_semi").select(F.col("source").alias("cls"), "target").distinct())
    # (test, cls) and (cls, target) are distinct: a pair can repeat only for a target that several classes hold.
    several = held.groupBy("target").agg(F.count("*").alias("n")).where("n > 1").select("target")
    once = _pairs_of(stage, closure, held.join(several, "target", "left_anti"))
    again = _pairs_of(stage, closure, held.join(several, "target", "left_semi")).distinct()
    return once.unionByName(again).select(F.col("test").alias("source"), "target", F.lit("automaticRuntime").alias("relation"))


#: Pairs that one task forms, about.
TASK_PAIRS = 2_000_000


def _pairs_of(stage: Stage, tests: DataFrame, held: DataFrame) -> DataFrame:
    """(test, target) of (test, cls) and (cls, target). A class with t tests and h targets has t * h pairs: its tests
    are split into parts of about TASK_PAIRS pairs, the targets repeated for each part. Pairs are never shuffled."""
    held = stage.keep(held)
    n = tests.groupBy("cls").agg(F.count("*").alias("t")).join(held.groupBy("cls").agg(F.count("*").alias("h")), "cls")
    parts = stage.keep(n.select("cls", F.ceil(F.col("t") * F.col("h") / TASK_PAIRS).cast("int").alias("parts"), (F.col("t") * F.col("h")).alias("n")))
    total = parts.agg(F.sum("n")).first()[0] or 0
    # Of those there are at most (tests + targets) / root of TASK_PAIRS.
    hot = F.broadcast(parts.where("parts > 1").select("cls", "parts"))
    many = F.coalesce("parts", F.lit(1))
    a = tests.join(hot, "cls", "left").select("test", "cls", F.pmod(F.xxhash64("test"), many).cast("int").alias("part"))
    b = held.join(hot, "cls", "left").select("target", "cls", F.explode(F.sequence(F.lit(0), many - 1)).alias("part"))
    k = int(total // TASK_PAIRS) + 1
    return a.repartition(k, "cls", "part").join(b.repartition(k, "cls", "part").hint("merge"), ["cls", "part"]).select("test", "target")


def affected_tests(graph: Graph, changed: DataFrame, tests: DataFrame, supplemental: DataFrame | None = None) -> DataFrame:
    """(id, depth, certain): changed tests at depth 0 and tests the change reaches, sorted by depth and id."""
    rows, _ = impact(graph, changed, supplemental=supplemental)
    direct = changed.select("id").distinct().withColumn("depth", F.lit(0))
    both = direct.unionByName(rows.select("id", "depth")).groupBy("id").agg(F.min("depth").alias("depth"))
    return both.join(tests, "id").orderBy("depth", "id")


def test_target_membership(files: DataFrame) -> DataFrame:
    """path, target of (path, target): known only where one target owns the file."""
    return files.groupBy("path").agg(F.when(F.count_distinct("target") == 1, F.min("target")).alias("target"))


def compare_impact(before: Graph, after: Graph, changed: DataFrame, max_depth: int | None = None) -> dict[str, DataFrame]:
    """Impact in both graphs: rows with ``status`` added, removed or kept; inputs found in neither; graph diff."""
    a, _ = impact(before, changed, max_depth)
    b, _ = impact(after, changed, max_depth)
    both = a.select("id", F.col("depth").alias("before_depth")).join(b.select("id", F.col("depth").alias("after_depth")), "id", "full")
    status = F.when(F.col("before_depth").isNull(), "added").when(F.col("after_depth").isNull(), "removed").otherwise("kept")
    lost = changed.select("id").join(before.nodes.select("id"), "id", "left_anti").join(after.nodes.select("id"), "id", "left_anti")
    return {"affected": both.withColumn("status", status), "unresolved": lost} | diff_graphs(before, after)


def enum_changes(before: DataFrame, after: DataFrame, decisions: DataFrame) -> dict[str, DataFrame]:
    """``candidates``: decisions that name none of an enum's added cases; ``issues``: inventories or
    decisions that are incomplete. Inventories: enumUSR, caseUSRs, complete."""
    a = before.select("enumUSR", F.col("caseUSRs").alias("old"), F.col("complete").alias("was"))
    b = after.select("enumUSR", F.col("caseUSRs").alias("new"), F.col("complete").alias("now"))
    both = a.join(b, "enumUSR")
    added = both.where("was and now").select("enumUSR", F.array_except("new", "old").alias("added"), F.array_except("old", "new").alias("removed"))
    d = decisions.join(added.where(F.size("added") > 0), "enumUSR")
    named = F.array_union(F.coalesce("explicitCaseUSRs", F.array().cast("array<string>")), F.coalesce("guardedCaseUSRs", F.array().cast("array<string>")))
    open_ = d.withColumn("missing", F.array_except("added", named)).where(F.size("missing") > 0)
    incomplete = both.where("not was or not now").select("enumUSR", F.lit("incomplete-inventory").alias("issue"))
    partial = decisions.where("status <> 'complete'").select("enumUSR", F.lit("incomplete-decision").alias("issue"))
    return {"changes": added, "candidates": open_, "issues": incomplete.unionByName(partial).distinct()}
