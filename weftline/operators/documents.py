"""Result documents: limitations, diagnostics, the combined check, symbol queries, scope verification, bridges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..plans.stage import large
from . import cycles, exposure, findings, layers, lookup, reach
from .graph import Graph, semantic_parent

#: What missing evidence is called, and how a count of it reads. Nothing here is ever a finding.
LIMITATIONS = {
    "empty-index": "the index holds no declarations",
    "public-api-not-retained": "%d public declarations are not kept as roots",
    "objective-c-sources": "%d sources in Objective-C are not analysed",
    "unknown-clang-module": "%d references name a module that is not known",
    "header-projection": "%d headers are not admitted",
    "interface-builder-documents": "%d interface documents could not be read",
    "index-staleness": "%d sources are newer than their index",
    "unindexed-sources": "%d sources have no index record",
    "local-function-projection": "%d local functions could not be bound",
    "missing-sources": "%d indexed sources do not exist",
    "unreadable-sources": "%d sources could not be read",
    "configured-path-filter": "%d sources are left out by configured paths",
    "configured-edge-kinds": "%d edges are left out by configured kinds",
    "symlinked-directories-outside-root": "%d linked folders lie outside the root",
    "source-discovery-exclusions": "%d folders are excluded from discovery",
    "source-discovery-git-unavailable": "tracked files are not known",
    "external-retentions": "%d declarations are kept by outside request",
    "external-retentions-objective-c": "%d outside requests name Objective-C declarations",
    "external-retentions-unmatched": "%d outside requests match nothing",
    "external-retentions-ambiguous": "%d outside requests match several declarations",
    "external-retentions-stale": "%d outside requests are older than the index",
    "bridge-dynamic": "%d bridge names are computed",
    "bridge-unattributed": "%d bridge facts have no symbol",
    "bridge-ambiguous": "%d bridge facts fit several symbols",
    "route-dynamic": "%d routes are computed",
    "route-masked": "%d route segments were masked",
}


def collect_limitations(counts: dict[str, DataFrame]) -> DataFrame:
    """(code, n, message) for each code whose table of evidence has rows; ``empty-index`` where its table has none."""
    out = None
    for code, df in counts.items():
        if code not in LIMITATIONS:
            raise ValueError(f"unknown limitation: {code}")
        n = df.agg(F.count("*").alias("n"))
        n = n.where("n = 0") if code == "empty-index" else n.where("n > 0")
        text = LIMITATIONS[code]
        message = F.format_string(text, "n") if "%d" in text else F.lit(text)
        row = n.select(F.lit(code).alias("code"), "n", message.alias("message"))
        out = row if out is None else out.unionByName(row)
    return out


def summarize_limitations(rows: DataFrame, groups: int = 128, examples: int = 3) -> DataFrame:
    """code, n, examples of (code, text): the largest codes, each with its first texts; ranked before gathering."""
    per = rows.groupBy("code", "text").agg(F.count("*").alias("k"))
    total = per.groupBy("code").agg(F.sum("k").alias("n")).orderBy(F.desc("n"), "code").limit(groups)
    rank = F.row_number().over(Window.partitionBy("code").orderBy("text"))
    first = per.withColumn("r", rank).where(F.col("r") <= examples).groupBy("code").agg(F.sort_array(F.collect_list("text")).alias("examples"))
    return total.join(first, "code")


def bridge_limitations(facts: DataFrame) -> dict[str, DataFrame]:
    """Tables for ``collect_limitations`` from bound bridge facts (channel, symbols, is_dynamic)."""
    return {
        "bridge-dynamic": facts.where("is_dynamic"),
        "bridge-unattributed": facts.where("not is_dynamic and symbols = 0"),
        "bridge-ambiguous": facts.where("not is_dynamic and symbols > 1"),
    }


def bind_bridges(facts: DataFrame, nodes: DataFrame) -> DataFrame:
    """facts (fact, path, line, name) with the symbol at their place, else the only one of that name in the
    file; ``symbols`` is how many fitted."""
    place = nodes.select(F.col("location.path").alias("path"), F.col("location.line").alias("line"), "id", "name")
    at = place.groupBy("path", "line").agg(F.count_distinct("id").alias("na"), F.min("id").alias("ia"))
    by = place.groupBy("path", "name").agg(F.count_distinct("id").alias("nb"), F.min("id").alias("ib"))
    j = facts.join(at, ["path", "line"], "left").join(by, ["path", "name"], "left")
    n = F.when(F.col("na") == 1, 1).otherwise(F.coalesce("nb", "na", F.lit(0)))
    return j.withColumn("symbols", n.cast("long")).withColumn("symbol", F.when(F.col("na") == 1, F.col("ia")).when(F.col("nb") == 1, F.col("ib"))).drop("na", "ia", "nb", "ib")


# ---- diagnostics


def _shown(kind: Column, module: Column, name: Column) -> Column:
    return F.concat(kind, F.lit(" '"), F.concat_ws(".", F.nullif(module, F.lit("")), name), F.lit("'"))


def unused_findings(dead: DataFrame) -> DataFrame:
    return findings.make_findings(dead, "unused-symbol", "warning", F.concat(_shown(F.col("kind"), F.col("module"), F.col("name")), F.lit(" is never used")), F.col("id"), F.col("location"))


def public_findings(rows: DataFrame) -> DataFrame:
    return findings.make_findings(rows, "redundant-public", "info", F.concat(_shown(F.col("kind"), F.col("module"), F.col("name")), F.lit(" need not be public")), F.col("id"), F.col("location"))


def import_findings(rows: DataFrame) -> DataFrame:
    return findings.make_findings(rows, "unused-import", "warning", F.concat(F.lit("import '"), "module", F.lit("' is not needed")), F.concat_ws(":", "path", "module"))


def cycle_findings(rows: DataFrame) -> DataFrame:
    text = F.concat(F.lit("cycle of "), F.col("length"), F.lit(": "), "path")
    return findings.make_findings(rows, "dependency-cycle", "error", text, F.col("component"))


def layer_findings(rows: DataFrame) -> DataFrame:
    text = F.concat(F.lit("'"), "from_layer", F.lit("' must not depend on '"), "to_layer", F.lit("' ("), "rule", F.lit(")"))
    out = findings.make_findings(rows, "layer-violation", "error", text, F.concat(F.col("source"), F.lit(" -> "), F.col("target"), F.lit(" ("), F.col("kind"), F.lit(")")))
    return out


def combined_check(symbol_graph: Graph, roots: DataFrame, module_edges: DataFrame, type_edges: DataFrame, module_nodes: DataFrame, layer_list: list, rules: DataFrame, baseline: DataFrame | None = None, path_column: str = "id") -> DataFrame:
    """All findings of a check: unused symbols, module and type cycles, layer violations, without baselined ones."""
    dead = unused_findings(reach.unused(symbol_graph, reach.reachable(symbol_graph, roots)))
    out = dead
    for e in (module_edges, type_edges):
        out = out.unionByName(cycle_findings(cycles.representative_cycles(e, cycles.strong_components(e))))
    assigned = module_nodes.select("id", layers.layer_of(F.col(path_column), layer_list).alias("layer"))
    out = out.unionByName(layer_findings(layers.violations(module_edges, assigned, rules)))
    return out if baseline is None else findings.suppress(out, baseline)


def describe_symbols(requests: DataFrame, graph: Graph, reached: DataFrame, roots: DataFrame) -> DataFrame:
    """Batch query document: position, subject, status, id, state, used_by, depends_on, members, declared_in (counts
    and parent); facts are joined for found requests only."""
    parents = semantic_parent(graph.nodes, graph.edges)
    r = lookup.resolve_counts(requests, graph.nodes, parents)
    r = large(r.withColumn("id", F.when(F.col("status") == "found", F.col("first"))))
    usage = graph.edges.where("kind <> 'member' and source <> target")
    wanted = large(r.where("id is not null").select("id").distinct())
    used_by = usage.select(F.col("target").alias("id"), "source").join(wanted, "id", "left_semi").groupBy("id").agg(F.count_distinct("source").alias("used_by"))
    uses = usage.select(F.col("source").alias("id"), "target").join(wanted, "id", "left_semi").groupBy("id").agg(F.count_distinct("target").alias("depends_on"))
    members = graph.edges.where("kind = 'member'").groupBy(F.col("source").alias("id")).agg(F.count("*").alias("members"))
    state = reached.select("id", F.lit("reachable").alias("_r")).join(roots.select("id", F.lit("retained").alias("_k")).distinct(), "id", "left")
    out = r
    for facts in (used_by, uses, members, parents.withColumnRenamed("parent", "declared_in"), state):
        out = out.join(large(facts), "id", "left")
    zero = lambda c: F.when(F.col("id").isNotNull(), F.coalesce(c, F.lit(0)).cast("long")).alias(c)
    kept = F.when(F.col("id").isNotNull(), F.coalesce("_k", "_r", F.lit("unreachable"))).alias("state")
    return out.select("position", "subject", "status", "id", kept, zero("used_by"), zero("depends_on"), zero("members"), "declared_in")


def verify_scope(selection: DataFrame, inventory: DataFrame) -> DataFrame:
    """selection (path, target, sha) against an inventory (path, target, sha): verified, moved (another target),
    changed (another digest) or unknown."""
    i = inventory.select("path", F.col("target").alias("_t"), F.col("sha").alias("_s"))
    j = selection.join(i, "path", "left")
    scope = F.when(F.col("_s").isNull(), "unknown").when(F.col("_s") != F.col("sha"), "changed").when(~F.col("_t").eqNullSafe(F.col("target")), "moved").otherwise("verified")
    return j.select("path", "target", scope.alias("scope"))


def module_coverage(expected: DataFrame, indexed: DataFrame) -> DataFrame:
    """path, module, coverage of (path, module) in both: expected, missing from the index, or unexpected there."""
    a, b = expected.select("path", "module", F.lit(1).alias("_e")), indexed.select("path", "module", F.lit(1).alias("_i"))
    return a.join(b, ["path", "module"], "full").select("path", "module", F.when(F.col("_i").isNull(), "missing").when(F.col("_e").isNull(), "unexpected").otherwise("expected").alias("coverage"))


__all__ = ["combined_check", "collect_limitations", "exposure"]
