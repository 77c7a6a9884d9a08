"""Redundant public declarations and unused imports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.stage import semi_naive
from .graph import Graph, ancestors, semantic_parent

IMPLICIT_MODULES = ("Swift", "_Concurrency", "_StringProcessing", "SwiftOnoneSupport")


def effectively_exposed(graph: Graph) -> DataFrame:
    """ids exposed (open or public) through their whole chain of parents."""
    exposed = graph.nodes.where("accessibility in ('open', 'public')").select("id")
    hidden = graph.nodes.where("accessibility not in ('open', 'public')").select(F.col("id").alias("ancestor"))
    below = ancestors(semantic_parent(graph.nodes, graph.edges)).join(hidden, "ancestor", "left_semi").select("id").distinct()
    return exposed.join(below, "id", "left_anti")


def redundant_public(graph: Graph, references: DataFrame, reached: DataFrame, excluded: DataFrame | None = None) -> DataFrame:
    """Exposed, reached declarations that only their own module refers to.

    At least one reference from elsewhere than itself; every source module known and its own; none forces the
    exposure: a reference outside a body from an unknown or effectively exposed source. Overriders and
    requirements of protocols are left out.
    """
    open_ = effectively_exposed(graph)
    n = graph.nodes.select("id", "module", "name", "kind", "location").join(open_, "id", "left_semi").join(reached.select("id"), "id", "left_semi")
    n = n.join(graph.edges.where("kind = 'overrides'").select(F.col("source").alias("id")), "id", "left_anti")
    protocol = graph.nodes.where("kind = 'protocol'").select(F.col("id").alias("parent"))
    requirements = semantic_parent(graph.nodes, graph.edges).join(protocol, "parent", "left_semi").select("id")
    n = n.join(requirements, "id", "left_anti")
    if excluded is not None:
        n = n.join(excluded.select("id"), "id", "left_anti")
    modules = graph.nodes.select(F.col("id").alias("sourceUSR"), F.col("module").alias("source_module"), F.lit(True).alias("known"))
    exposed = open_.select(F.col("id").alias("sourceUSR"), F.lit(True).alias("source_open"))
    r = references.where("sourceUSR <> targetUSR").join(modules, "sourceUSR", "left").join(exposed, "sourceUSR", "left")
    forcing = (F.coalesce("position", F.lit("unknown")) != "body") & (F.col("known").isNull() | F.coalesce("source_open", F.lit(False)))
    r = r.join(n.select(F.col("id").alias("targetUSR"), "module"), "targetUSR")
    facts = r.groupBy(F.col("targetUSR").alias("id")).agg(
        F.bool_and(F.coalesce(F.col("source_module") == F.col("module"), F.lit(False))).alias("own"), F.bool_or(forcing).alias("forced"), F.count("*").alias("n_references")
    )
    return n.join(facts.where("own and not forced").select("id", "n_references"), "id")


def reexport_closure(reexports: DataFrame) -> DataFrame:
    """(module, supplies): what a module passes on, through chains of (module, target); external ends included."""
    seed = reexports.select("module", F.col("target").alias("supplies")).distinct()
    hop = seed.select(F.col("module").alias("supplies"), F.col("supplies").alias("next"))
    step = lambda new, known, k: new.join(hop, "supplies").select("module", F.col("next").alias("supplies")).distinct()
    return semi_naive(seed, step, ["module", "supplies"], label="reexport")[0]


def unused_imports(imports: DataFrame, usages: DataFrame, project_modules: DataFrame, reexports: DataFrame) -> DataFrame:
    """path, module of imports that a file does not need.

    Conditional, re-exported and ignored imports, and files with unattributed references, are passed over. An
    import whose head is not referenced is reported when every referenced module is explained by another import,
    or when it is a project module that re-exports nothing outside the project and none of the unexplained.
    ``fileHasConditionalCompilation`` unknown counts as not.
    """
    i = imports.select(F.col("location.path").alias("path"), F.element_at("modulePath", 1).alias("module"), "isConditional", "isReexported", "isIgnored", "fileHasConditionalCompilation")
    heads = i.groupBy("path").agg(F.collect_set("module").alias("heads"))
    u = usages.join(heads, "path", "left")
    implicit = F.array(*map(F.lit, IMPLICIT_MODULES))
    left = F.array_except(F.array_except(F.array_except("referencedModules", F.coalesce("heads", F.array().cast("array<string>"))), implicit), F.array("owningModule"))
    u = u.select("path", "referencedModules", "hasUnattributedReferences", left.alias("unexplained"))
    # Not (x <=> true) keeps null.
    plain = i.where("not isConditional and not isReexported and not isIgnored and not (fileHasConditionalCompilation <=> true)")
    e = plain.join(u, "path").where(~F.array_contains("referencedModules", F.col("module")) & ~F.col("hasUnattributedReferences"))
    project = project_modules.select("module", F.lit(True).alias("project"))
    closure = reexport_closure(reexports)
    outside = closure.join(project_modules.select(F.col("module").alias("supplies")), "supplies", "left_anti").select("module").distinct().withColumn("external", F.lit(True))
    supplies = closure.groupBy("module").agg(F.collect_set("supplies").alias("supplies"))
    e = e.join(project, "module", "left").join(outside, "module", "left").join(supplies, "module", "left")
    passed = F.array_union(F.array("module"), F.coalesce("supplies", F.array().cast("array<string>")))
    cannot = F.coalesce("project", F.lit(False)) & F.col("external").isNull() & ~F.arrays_overlap("unexplained", passed)
    return e.where((F.size("unexplained") == 0) | cannot).select("path", "module").distinct()


def ignored_source_targets(symbols: DataFrame, references: DataFrame, ignored_files: DataFrame) -> DataFrame:
    """Symbols outside ignored files that a declaration inside one refers to."""
    inside = symbols.select("usr", F.col("location.path").alias("path")).join(ignored_files.select("path"), "path", "left_semi").select("usr")
    r = references.where(F.col("kind").isin("call", "reference", "inheritance", "conformance")).join(inside.withColumnRenamed("usr", "sourceUSR"), "sourceUSR", "left_semi")
    return r.select(F.col("targetUSR").alias("usr")).distinct().join(inside, "usr", "left_anti")
