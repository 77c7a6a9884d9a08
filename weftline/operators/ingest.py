"""Occurrences to relations: upsert, folding, as-of, nearest and range joins, evidence merges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

KIND_CODES = {"Class": "class", "Struct": "struct", "Enum": "enum", "Protocol": "protocol", "Extension": "extension", "TypeAlias": "typealias", "Function": "function", "InstanceMethod": "method", "StaticMethod": "method", "ClassMethod": "method", "Constructor": "init", "Destructor": "deinit", "InstanceProperty": "property", "Variable": "variable", "EnumConstant": "case", "Parameter": "parameter", "Macro": "macro", "Module": "module"}


def map_kind(column: str = "code"):  # noqa: ANN201
    out = F.lit("unknown")
    for code, kind in KIND_CODES.items():
        out = F.when(F.col(column) == code, kind).otherwise(out)
    return out


def dedupe_occurrences(occurrences: DataFrame) -> DataFrame:
    """One row per (unit, record, symbol, place, roles)."""
    return occurrences.dropDuplicates(["unit", "record", "usr", "path", "line", "column", "roles"])


def map_relations(occurrences: DataFrame) -> DataFrame:
    """references of occurrences (ordinal, usr, kind, is_reference, location, relations[struct(role, usr, kind)]).

    baseOf is a conformance to a protocol and an inheritance otherwise, and like extendedBy and calledBy it is
    reversed; containedBy counts only for a reference that is no call; a call keeps its receiver when there is
    just one.
    """
    r = occurrences.select("ordinal", "usr", "kind", "is_reference", "location", "receivers", F.explode("relations").alias("rel"))
    role, other = F.col("rel.role"), F.col("rel.usr")
    called = F.max(role == "calledBy").over(Window.partitionBy("ordinal"))
    r = r.withColumn("called", called)
    kind = (
        F.when(role == "baseOf", F.when(F.col("kind") == "protocol", "conformance").otherwise("inheritance"))
        .when(role == "overrideOf", "overrides")
        .when(role == "extendedBy", "extends")
        .when(role == "calledBy", "call")
        .when((role == "containedBy") & F.col("is_reference") & ~F.col("called"), "reference")
        .when(role == "specializationOf", "reference")
    )
    forward = role.isin("overrideOf", "specializationOf")
    receiver = F.when((kind == "call") & (F.size("receivers") == 1), F.element_at("receivers", 1))
    return r.withColumn("k", kind).where("k is not null").select(
        "ordinal", F.when(forward, F.col("usr")).otherwise(other).alias("sourceUSR"), F.when(forward, other).otherwise(F.col("usr")).alias("targetUSR"), F.col("k").alias("kind"), "location", receiver.alias("receiverTypeUSR")
    )


def upsert_symbols(rows: DataFrame) -> DataFrame:
    """One row per usr: a definition before a declaration, then the first; first known parent; attributes united;
    a unit-test mark on any row holds. One aggregation, no window."""
    rank = F.struct((~F.col("is_definition")).cast("int"), "ordinal")
    cols = [c for c in rows.columns if c not in ("usr", "parentUSR", "attributes", "compilerUnitTest", "is_definition", "ordinal")]
    out = rows.groupBy("usr").agg(
        F.min("ordinal").alias("ordinal"),
        F.min_by(F.struct(*cols), rank).alias("s"),
        F.min_by("parentUSR", F.when(F.col("parentUSR").isNotNull(), F.col("ordinal"))).alias("parentUSR"),
        F.sort_array(F.array_distinct(F.flatten(F.collect_set("attributes")))).alias("attributes"),
        F.bool_or("compilerUnitTest").alias("compilerUnitTest"),
    )
    return out.select("usr", "ordinal", *[F.col(f"s.{c}").alias(c) for c in cols], "parentUSR", "attributes", "compilerUnitTest")


def fold_accessors(references: DataFrame, owners: DataFrame) -> DataFrame:
    """Both ends through (accessor, owner); references that end at themselves by it go."""
    out = references
    for c in ("sourceUSR", "targetUSR"):
        out = out.join(owners.select(F.col("accessor").alias(c), "owner"), c, "left").withColumn(c, F.coalesce("owner", c)).drop("owner")
    return out.where("sourceUSR <> targetUSR")


def wrapper_facets(symbols: DataFrame) -> DataFrame:
    """(facet, usr): ``$x`` and ``_x`` beside an ``x`` of the same parent."""
    f = symbols.where("name rlike '^[$_]'").select(F.col("usr").alias("facet"), "parentUSR", F.expr("substring(name, 2)").alias("name"))
    return f.join(symbols.select("usr", "parentUSR", "name"), ["parentUSR", "name"]).select("facet", "usr")


def asof_enclosing(references: DataFrame, definitions: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    """references with the latest definition strictly before them within the same keys.

    One union and one window: rows are sorted once by place, a definition sorts after a reference at its own
    place, and the last definition is carried forward. No pairs are formed.
    """
    refs = references.withColumns({"_side": F.lit(0), "_v": F.lit(None).cast(definitions.schema[value].dataType)})
    defs = definitions.select(*keys, *order, F.lit(1).alias("_side"), F.col(value).alias("_v"))
    both = refs.unionByName(defs, allowMissingColumns=True)
    w = Window.partitionBy(*keys).orderBy(*order, "_side").rowsBetween(Window.unboundedPreceding, -1)
    return both.withColumn("enclosing", F.last("_v", ignorenulls=True).over(w)).where("_side = 0").drop("_side", "_v")


def attribute_enclosing(references: DataFrame, definitions: DataFrame) -> DataFrame:
    """Unattributed references given the case, typealias or associatedtype that encloses them."""
    got = asof_enclosing(references, definitions.withColumn("_d", F.struct("usr", "kind")), ["path", "module"], ["line", "column"], "_d")
    return got.where("enclosing.kind in ('case', 'typealias', 'associatedtype')").withColumn("sourceUSR", F.col("enclosing.usr")).drop("enclosing")


def unique_owner(rows: DataFrame, site: list[str], owner: str) -> DataFrame:
    """Sites with exactly one owner."""
    return rows.groupBy(*site).agg(F.count_distinct(owner).alias("_n"), F.min(owner).alias(owner)).where("_n = 1").drop("_n")


def file_module_usages(occurrences: DataFrame) -> DataFrame:
    """path, owningModule (unique or null), referencedModules, hasUnattributedReferences of (path, module, target_module, is_reference)."""
    return occurrences.groupBy("path").agg(
        F.when(F.count_distinct("module") == 1, F.min("module")).alias("owningModule"),
        F.sort_array(F.collect_set(F.when(F.col("is_reference"), F.col("target_module")))).alias("referencedModules"),
        (F.bool_or(F.col("is_reference") & F.col("target_module").isNull()) | (F.count_distinct("module") > 1)).alias("hasUnattributedReferences"),
    )


def merge_accesses(rows: DataFrame) -> DataFrame:
    return rows.groupBy("usr").agg(*[F.bool_or(c).alias(c) for c in ("hasRead", "hasWrite", "hasAmbiguous")])


def bind_declarations(facts: DataFrame, symbols: DataFrame) -> DataFrame:
    """facts (fact, name, path, line) with the symbol they describe: exact when (name, place) is unique on both
    sides, else the nearest line of that name in the file, the lower line on ties."""
    f1 = facts.groupBy("name", "path", "line").agg(F.count("*").alias("nf"))
    s1 = symbols.groupBy("name", "path", "line").agg(F.count("*").alias("ns"), F.min("usr").alias("exact"))
    exact = facts.join(f1, ["name", "path", "line"]).join(s1, ["name", "path", "line"], "left")
    exact = exact.withColumn("exact", F.when((F.col("nf") == 1) & (F.col("ns") == 1), F.col("exact")))
    near = nearest(exact.where("exact is null").select(*facts.columns), symbols.select("name", "path", F.col("line").alias("at"), "usr"), ["name", "path"], "line", "at", "usr")
    return exact.where("exact is not null").select(*facts.columns, F.col("exact").alias("usr")).unionByName(near.select(*facts.columns, "usr"))


#: Lines that are sorted together: a file, or whatever the keys name, may hold most of all rows.
BAND = 64


def nearest(left: DataFrame, right: DataFrame, keys: list[str], at: str, other: str, value: str) -> DataFrame:
    """Left rows with the right row of least distance in the same keys; on ties the lower one.

    Each distinct place of the left is settled once, and the rows look theirs up. The values carried from below and
    from above are found within bands of BAND lines, and what a band begins or ends without comes from one row per
    band: a hot key forms no pairs and no single sort. Both ways are running frames, the upper one over the falling
    order: Spark goes through a frame that ends at the last row anew for every row.
    """
    mark = "struct<at:int,v:string>"
    marks = right.groupBy(*keys, other).agg(F.min(value).alias(value))
    marks = marks.select(*keys, F.col(other).alias(at), F.struct(F.col(other).cast("int").alias("at"), F.col(value).cast("string").alias("v")).alias("_v"))
    band = F.floor(F.col(at) / BAND).alias("_band")
    one = left.select(*keys, at).distinct().select(*keys, at, band, F.lit(1).alias("_side"), F.lit(None).cast(mark).alias("_v"))
    both = one.unionByName(marks.select(*keys, at, band, F.lit(0).alias("_side"), "_v"))
    place = Window.partitionBy(*keys, "_band")
    so_far = lambda *order: F.last("_v", ignorenulls=True).over(place.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    got = both.withColumns({"_b": so_far(at, "_side"), "_a": so_far(F.desc(at), F.desc("_side"))}).where("_side = 1")
    ends = both.groupBy(*keys, "_band").agg(F.max("_v").alias("_hi"), F.min("_v").alias("_lo"))
    across = lambda c, order: F.last(c, ignorenulls=True).over(Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1))
    ends = ends.select(*keys, "_band", across("_hi", "_band").alias("_before"), across("_lo", F.desc("_band")).alias("_after"))
    got = got.join(ends, [*keys, "_band"]).withColumns({"_b": F.coalesce("_b", "_before"), "_a": F.coalesce("_a", "_after")})
    d_below, d_above = F.col(at) - F.col("_b.at"), F.col("_a.at") - F.col(at)
    pick = F.when(F.col("_b").isNull(), F.col("_a.v")).when(F.col("_a").isNull() | (d_below <= d_above), F.col("_b.v")).otherwise(F.col("_a.v"))
    found = got.select(*keys, at, pick.alias(value))
    names = left.columns if value in left.columns else [*left.columns, value]
    rows = left.drop(value) if value not in (*keys, at) else left
    return rows.join(found, [*keys, at], "left").select(*names)


def bind_parameter_usage(parameters: DataFrame, usage: DataFrame) -> DataFrame:
    """isReferenced from (path, line, column, used); null stays where there is no evidence."""
    p = parameters.withColumns({"path": F.col("location.path"), "line": F.col("location.line"), "column": F.col("location.column")})
    return p.join(usage.select("path", "line", "column", "used"), ["path", "line", "column"], "left").withColumn("isReferenced", F.coalesce("used", "isReferenced")).select(*parameters.columns)


def reference_positions(references: DataFrame, bodies: DataFrame) -> DataFrame:
    """references (rid, path, line, column) with position: body inside any range, signature outside all,
    unknown in a file without ranges.

    The furthest end of the ranges begun so far decides, so nested and many ranges cost one sorted pass. It is
    carried within bands of BAND lines, and between them by one row per band.
    """
    point = lambda a, b: F.struct(F.col(a).alias("line"), F.col(b).alias("column"))
    band = lambda c: F.floor(F.col(c) / BAND).alias("_band")
    marks = bodies.select("path", band("l1"), point("l1", "c1").alias("_at"), F.lit(0).alias("_side"), point("l2", "c2").alias("_r"))
    refs = references.select("*", band("line"), point("line", "column").alias("_at"), F.lit(1).alias("_side"))
    both = refs.unionByName(marks, allowMissingColumns=True)
    so_far = F.max("_r").over(Window.partitionBy("path", "_band").orderBy("_at", "_side").rowsBetween(Window.unboundedPreceding, 0))
    got = both.withColumn("_l", so_far).where("_side = 1")
    ends = both.groupBy("path", "_band").agg(F.max("_r").alias("_r"))
    every = Window.partitionBy("path")
    ends = ends.select("path", "_band", F.max("_r").over(every.orderBy("_band").rowsBetween(Window.unboundedPreceding, -1)).alias("_before"), F.max("_r").over(every).isNotNull().alias("_any"))
    reach = F.greatest("_l", "_before")
    out = got.drop("_r").join(ends, ["path", "_band"])
    position = F.when(~F.col("_any"), "unknown").when(F.coalesce(reach >= F.col("_at"), F.lit(False)), "body").otherwise("signature")
    return out.withColumn("position", position).select(*references.columns, "position")


def annotate_interface_builder(symbols: DataFrame, names: DataFrame) -> DataFrame:
    hit = names.select("name").distinct().withColumn("_hit", F.lit(True))
    return symbols.join(hit, "name", "left").withColumn("attributes", F.when(F.col("_hit"), F.array_union("attributes", F.array(F.lit("interfaceBuilderClass")))).otherwise(F.col("attributes"))).drop("_hit")


def freshness(dates: DataFrame) -> DataFrame:
    """fresh when the source is no newer than its index and did not change while it was read."""
    stable = F.col("before") == F.col("after")
    return dates.withColumn("freshness", F.when(F.col("indexed").isNull() | F.col("after").isNull(), "unknown").when(stable & (F.col("after") <= F.col("indexed")), "fresh").otherwise("stale"))


def bind_sites(facts: DataFrame, symbols: DataFrame, site: list[str]) -> DataFrame:
    """facts with usr and ``skip``: bound where one symbol stands at the site, else the reason why not."""
    at = symbols.groupBy(*site).agg(F.count("*").alias("_n"), F.min("usr").alias("usr"))
    j = facts.join(at, site, "left")
    return j.withColumn("skip", F.when(F.col("_n").isNull(), "no-symbol").when(F.col("_n") > 1, "ambiguous")).withColumn("usr", F.when(F.col("skip").isNull(), F.col("usr"))).drop("_n")
