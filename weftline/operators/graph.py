"""Graph construction, projection to a level, degrees, neighbourhoods."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import last_component
from ..plans.stage import Stage, large, semi_naive
from ..sources.schemas import CYCLE_KINDS, EDGE_KINDS, SOURCE_KINDS, TYPE_KINDS, USAGE_KINDS

LEVELS = ("module", "file", "type", "symbol")


def kind_rank(kind: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, EDGE_KINDS)), kind)


@dataclass(frozen=True)
class Graph:
    nodes: DataFrame
    edges: DataFrame


def merge_edges(edges: DataFrame, nodes: DataFrame | None = None, drop_self_loops: bool = False) -> DataFrame:
    """One row per (source, target, kind) with the weights summed; edges without both endpoints are dropped."""
    out = edges.groupBy("source", "target", "kind").agg(F.sum("weight").cast("long").alias("weight"))
    if drop_self_loops:
        out = out.where("source <> target")
    if nodes is not None:
        ids = nodes.select("id").distinct()
        out = out.join(ids.withColumnRenamed("id", "source"), "source", "left_semi").join(ids.withColumnRenamed("id", "target"), "target", "left_semi")
    return out.select("source", "target", "kind", "weight")


def merge_nodes(nodes: DataFrame) -> DataFrame:
    """One row per id: a type declaration before any other, then the first by ``ordinal``."""
    rank = F.struct(F.when(F.col("kind").isin(*TYPE_KINDS), 0).otherwise(1), "ordinal")
    cols = [c for c in nodes.columns if c not in ("id", "ordinal")]
    best = nodes.groupBy("id").agg(F.min_by(F.struct(*cols), rank).alias("n"))
    return best.select("id", *[F.col(f"n.{c}").alias(c) for c in cols])


def induced(graph: Graph, keep: DataFrame) -> Graph:
    """The subgraph of the nodes whose id is in ``keep``."""
    nodes = graph.nodes.join(keep.select("id").distinct(), "id", "left_semi")
    return Graph(nodes, merge_edges(graph.edges, nodes))


def successors(edges: DataFrame, node: str, kinds: tuple[str, ...] | None = None) -> DataFrame:
    e = edges.where(F.col("source") == node)
    return (e.where(F.col("kind").isin(*kinds)) if kinds else e).select("target").distinct()


def predecessors(edges: DataFrame, node: str, kinds: tuple[str, ...] | None = None) -> DataFrame:
    e = edges.where(F.col("target") == node)
    return (e.where(F.col("kind").isin(*kinds)) if kinds else e).select("source").distinct()


def degrees(nodes: DataFrame, edges: DataFrame, kinds: tuple[str, ...] | None = None) -> DataFrame:
    """id, in_degree, out_degree, total_degree: distinct neighbours without self loops.

    Parallel kinds collapse first, so both counts come from one exchange of distinct pairs each.
    """
    e = edges.where("source <> target")
    if kinds:
        e = e.where(F.col("kind").isin(*kinds))
    pairs = e.select("source", "target").distinct()
    ends = pairs.select(F.explode(F.array(F.struct(F.col("target").alias("id"), F.lit(1).alias("i"), F.lit(0).alias("o")), F.struct(F.col("source").alias("id"), F.lit(0).alias("i"), F.lit(1).alias("o")))).alias("x"))
    sums = ends.groupBy("x.id").agg(F.sum("x.i").alias("i"), F.sum("x.o").alias("o"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    return nodes.select("id").join(sums, "id", "left").select("id", zero("i").alias("in_degree"), zero("o").alias("out_degree"), zero(F.col("i") + F.col("o")).alias("total_degree"))


def top_by_degree(nodes: DataFrame, edges: DataFrame, n: int) -> DataFrame:
    """The n nodes of largest total degree (ties by id), for renderers with a cap; sorted by id."""
    return degrees(nodes, edges).orderBy(F.desc("total_degree"), "id").limit(n).orderBy("id")


def reference_locations(references: DataFrame) -> DataFrame:
    """Earliest site of each (source, target, kind)."""
    return references.groupBy("source", "target", "kind").agg(F.min("location").alias("location"))


# ---- parents and levels


def extension_targets(references: DataFrame) -> DataFrame:
    """extension -> extended type; the least target on ties."""
    return references.where("kind = 'extends'").groupBy(F.col("sourceUSR").alias("usr")).agg(F.min("targetUSR").alias("extended"))


def semantic_parent(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """id, parent: the first member-edge source; of an extension, the type it extends or else itself."""
    owner = edges.where("kind = 'member'").groupBy(F.col("target").alias("id")).agg(F.min("source").alias("owner"))
    extends = edges.where("kind = 'extends'").groupBy(F.col("source").alias("owner")).agg(F.min("target").alias("extended"))
    kinds = nodes.select(F.col("id").alias("owner"), F.col("kind").alias("owner_kind"))
    return (
        owner.join(large(kinds), "owner", "left")
        .join(large(extends), "owner", "left")
        .select("id", F.when(F.col("owner_kind") == "extension", F.coalesce("extended", "owner")).otherwise(F.col("owner")).alias("parent"))
    )


def ancestors(parents: DataFrame) -> DataFrame:
    """(id, ancestor, distance) for all ancestors of (id, parent), nearest first; cycles end at a known pair."""
    seed = parents.where("parent is not null").select("id", F.col("parent").alias("ancestor"), F.lit(1).alias("distance"))
    up = large(parents.where("parent is not null").select(F.col("id").alias("ancestor"), F.col("parent").alias("next")))

    def step(new: DataFrame, known: DataFrame, k: int) -> DataFrame:
        return new.join(up, "ancestor").groupBy("id", F.col("next").alias("ancestor")).agg((F.min("distance") + 1).alias("distance"))

    return semi_naive(seed, step, ["id", "ancestor"], label="ancestors")[0]


def type_owner(symbols: DataFrame, references: DataFrame) -> DataFrame:
    """(usr, owner): climbs parents, an extension jumps to its extended type, and the first type declaration
    ends the climb; without one, or where it is not among the symbols, the symbol itself.

    Pointer doubling: each round halves what is left to climb, and a chain in a cycle stops when no round
    changes it.
    """
    stage = Stage(symbols.sparkSession, "owner")
    ext = extension_targets(references)
    s = symbols.select("usr", "kind", "parentUSR").join(ext, "usr", "left")
    final = F.col("kind").isin(*[k for k in TYPE_KINDS if k != "extension"])
    up = s.select("usr", F.when(final, F.col("usr")).when(F.col("kind") == "extension", F.coalesce("extended", "parentUSR")).otherwise(F.col("parentUSR")).alias("to"), final.alias("is_type"))
    known = symbols.select(F.col("usr").alias("to"), F.lit(True).alias("here"))
    up = up.join(known, "to", "left").select("usr", F.when(F.col("here"), F.col("to")).alias("to"), "is_type")
    state = stage.keep(up.select("usr", F.coalesce("to", "usr").alias("to"), "is_type"))
    types = symbols.where(final).select(F.col("usr").alias("to"), F.lit(True).alias("done"))
    for _ in range(40):
        far = state.select(F.col("usr").alias("to"), F.col("to").alias("far"))
        nxt = stage.keep(state.join(far, "to", "left").select("usr", F.coalesce("far", "to").alias("to"), "is_type", (F.coalesce("far", "to") != F.col("to")).alias("moved")))
        state = nxt.select("usr", "to", "is_type")
        if nxt.where("moved").isEmpty():
            break
    return state.join(types, "to", "left").select("usr", F.when(F.col("done"), F.col("to")).otherwise(F.col("usr")).alias("owner"))


def unique_file_modules(usages: DataFrame) -> DataFrame:
    return usages.groupBy("path").agg(F.when(F.count_distinct("owningModule") == 1, F.min("owningModule")).alias("module"))


def build_graph(
    symbols: DataFrame,
    references: DataFrame,
    level: str,
    include_external: bool = False,
    drop_self_loops: bool = True,
    excluded_paths: DataFrame | None = None,
    file_modules: DataFrame | None = None,
) -> tuple[Graph, DataFrame]:
    """The graph of a level and its limitations (reason, n, examples).

    At module and file level the source node comes from the file of the reference: the path itself, or the
    module that alone owns it; a reference whose file has no single owner counts as a limitation and keeps its
    semantic source. References in excluded files are dropped there. Member edges exist at symbol level only.
    """
    if level not in LEVELS:
        raise ValueError(f"unknown level: {level}")
    s = symbols if include_external else symbols.where("not isExternal")
    if level == "module":
        ids = s.select("usr", F.col("module").alias("id"))
        nodes = s.select(F.col("module").alias("id"), F.col("module").alias("name"), F.lit("module").alias("kind"), "module", "ordinal")
    elif level == "file":
        path = F.col("location.path")
        ids = s.select("usr", path.alias("id"))
        nodes = s.select(path.alias("id"), last_component(path).alias("name"), F.lit("file").alias("kind"), "module", "ordinal")
    elif level == "type":
        owners = type_owner(s, references)
        ids = owners.select("usr", F.col("owner").alias("id"))
        nodes = s.join(owners.select(F.col("owner").alias("usr")).distinct(), "usr", "left_semi").select(F.col("usr").alias("id"), "name", "kind", "module", "ordinal")
    else:
        ids = s.select("usr", F.col("usr").alias("id"))
        nodes = s.select(F.col("usr").alias("id"), "name", "kind", "module", "ordinal")
    nodes = merge_nodes(nodes.where("id is not null"))
    refs = references
    architectural = level in ("module", "file")
    if architectural and excluded_paths is not None:
        refs = refs.withColumn("_p", F.col("location.path")).join(excluded_paths.select(F.col("path").alias("_p")), "_p", "left_anti").drop("_p")
    to = refs.join(ids.select(F.col("usr").alias("targetUSR"), F.col("id").alias("target")), "targetUSR")
    both = to.join(ids.select(F.col("usr").alias("sourceUSR"), F.col("id").alias("semantic")), "sourceUSR", "left")
    limits = None
    if level == "file":
        both = both.withColumn("source", F.coalesce(F.col("location.path"), F.col("semantic")))
        extra = both.where("source is not null").select(F.col("source").alias("id")).distinct().join(nodes, "id", "left_anti")
        nodes = nodes.unionByName(extra.select("id", last_component(F.col("id")).alias("name"), F.lit("file").alias("kind"), F.lit("").alias("module")))
    elif level == "module" and file_modules is not None:
        owner = unique_file_modules(file_modules).select(F.col("path").alias("_p"), F.col("module").alias("file_module"))
        both = both.withColumn("_p", F.col("location.path")).join(owner, "_p", "left")
        both = both.withColumn("source", F.coalesce("file_module", "semantic"))
        limits = both.where("_p is not null and file_module is null").select(F.lit("unresolved-source-module").alias("reason"), F.col("_p").alias("path"))
    else:
        both = both.withColumn("source", F.col("semantic"))
    edges = both.where("source is not null").select("source", "target", "kind", F.lit(1).cast("long").alias("weight"))
    if level == "symbol":
        member = s.where("parentUSR is not null").select(F.col("parentUSR").alias("source"), F.col("usr").alias("target"), F.lit("member").alias("kind"), F.lit(1).cast("long").alias("weight"))
        edges = edges.unionByName(member)
    if limits is None:
        limits = both.limit(0).select(F.lit("").alias("reason"), F.lit("").alias("path"))
    return Graph(nodes, merge_edges(edges, nodes, drop_self_loops)), limitation_summary(limits)


def limitation_summary(rows: DataFrame, examples: int = 10) -> DataFrame:
    """reason, n and the first paths of (reason, path); ranked before collecting, so no list grows."""
    paths = rows.groupBy("reason", "path").agg(F.count("*").alias("k"))
    ranked = paths.withColumn("r", F.row_number().over(Window.partitionBy("reason").orderBy("path")))
    first = ranked.where(F.col("r") <= examples).groupBy("reason").agg(F.sort_array(F.collect_list("path")).alias("examples"))
    return paths.groupBy("reason").agg(F.sum("k").alias("n")).join(first, "reason")


# ---- neighbourhoods


def usage_neighbourhood(nodes: DataFrame, edges: DataFrame, start: str, depth: int, limit: int, incoming: bool) -> tuple[DataFrame, bool]:
    """id, depth, kinds, vias over usage edges; kinds are those of a node's first depth.

    Levels are sorted by id; beyond ``limit`` nodes in all, a node is passed over: visited, but neither
    reported nor expanded. The limit bounds each level that is looked at.
    """
    near, far = ("target", "source") if incoming else ("source", "target")
    spark = nodes.sparkSession
    e = edges.where(F.col("kind").isin(*USAGE_KINDS)).select(F.col(near).alias("via"), F.col(far).alias("id"), "kind")
    stage = Stage(spark, "hood")
    shape = "id string, depth int, kinds array<string>, vias array<string>, shown boolean"
    known = stage.add("rows", spark.createDataFrame([(start, 0, [], [], True)], shape))
    shown, truncated = 0, False
    for level in range(1, max(1, depth) + 1):
        front = known.where((F.col("depth") == level - 1) & F.col("shown")).select(F.col("id").alias("via"))
        found = (
            e.join(front, "via").join(known.select("id"), "id", "left_anti").join(nodes.select("id"), "id", "left_semi").groupBy("id")
            .agg(F.transform(F.sort_array(F.collect_set(F.struct(kind_rank(F.col("kind")).alias("r"), "kind"))), lambda x: x["kind"]).alias("kinds"), F.sort_array(F.collect_set("via")).alias("vias"))
        )
        room = max(1, limit) - shown
        rank = F.row_number().over(Window.orderBy("id"))
        found = found.select("id", F.lit(level).alias("depth"), "kinds", "vias", (rank <= room).alias("shown"))
        known = stage.add("rows", found)
        counts = known.where(F.col("depth") == level).agg(F.count_if("shown"), F.count_if(~F.col("shown"))).first()
        shown += counts[0]
        truncated |= counts[1] > 0
        if not counts[0]:
            break
    return known.where((F.col("depth") > 0) & F.col("shown")).drop("shown"), truncated


def containment_neighbours(edges: DataFrame, node: str, limit: int) -> tuple[DataFrame, DataFrame]:
    """(members, declared in) over member edges, one row more than ``limit`` telling that there are more."""
    m = edges.where("kind = 'member'")
    take = lambda df, c: df.select(F.col(c).alias("id")).distinct().orderBy("id").limit(limit + 1)
    return take(m.where(F.col("source") == node), "target"), take(m.where(F.col("target") == node), "source")


def expand_containers(selection: DataFrame, edges: DataFrame) -> DataFrame:
    """A selection of ids with all it contains: members, extensions of a contained type, and their members."""
    member = edges.where("kind = 'member'").select(F.col("source").alias("from"), F.col("target").alias("to"))
    extension = edges.where("kind = 'extends'").select(F.col("target").alias("from"), F.col("source").alias("to"))
    down = member.unionByName(extension).distinct()
    seed = selection.select("id").distinct()
    return semi_naive(seed, lambda new, known, k: new.select(F.col("id").alias("from")).join(down, "from").select(F.col("to").alias("id")).distinct(), ["id"], label="contain")[0]


def merge_extension_variants(nodes: DataFrame, edges: DataFrame) -> Graph:
    """Extensions fold into the type they extend: its id stands for them in nodes and edges."""
    ext = edges.where("kind = 'extends'").groupBy(F.col("source").alias("id")).agg(F.min("target").alias("merged"))
    ext = ext.join(nodes.where("kind = 'extension'").select("id"), "id", "left_semi")
    swap = lambda df, c: df.join(ext.select(F.col("id").alias(c), "merged"), c, "left").withColumn(c, F.coalesce("merged", c)).drop("merged")
    kept = nodes.join(ext.select("id"), "id", "left_anti")
    return Graph(kept, merge_edges(swap(swap(edges, "source"), "target"), kept, drop_self_loops=True))


def diff_graphs(before: Graph, after: Graph) -> dict[str, DataFrame]:
    """Added and removed nodes and edges; an edge kind the other graph lacks altogether is not reported."""
    pairs = {}
    keys = ["source", "target", "kind"]
    for name, a, b in (("added", after, before), ("removed", before, after)):
        pairs[f"{name}_nodes"] = a.nodes.join(b.nodes.select("id"), "id", "left_anti")
        known = F.broadcast(b.edges.select("kind").distinct().limit(len(EDGE_KINDS)))
        pairs[f"{name}_edges"] = a.edges.join(b.edges.select(*keys), keys, "left_anti").join(known, "kind", "left_semi")
    return pairs


__all__ = ["CYCLE_KINDS", "SOURCE_KINDS", "USAGE_KINDS", "Graph", "build_graph", "merge_edges"]
