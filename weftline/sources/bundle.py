"""Snapshot bundles (a folder of parquet tables with a manifest) and the JSON documents beside them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .schemas import TABLES, schema

VERSIONS = (1, 2)


def write_bundle(tables: dict[str, DataFrame], folder: str, version: int = 2) -> None:
    """One parquet folder per relation; symbols and references are split by module for pruned reads."""
    spark = next(iter(tables.values())).sparkSession
    for name, df in tables.items():
        cast = df.select([F.col(f.name).cast(f.dataType).alias(f.name) for f in schema(name).fields])
        writer = cast.write.mode("overwrite")
        (writer.partitionBy("module") if name == "symbols" else writer).parquet(f"{folder}/{name}")
    spark.createDataFrame([(version, sorted(tables))], "version int, tables array<string>").coalesce(1).write.mode("overwrite").json(f"{folder}/manifest")


def read_bundle(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    manifest = spark.read.schema("version int, tables array<string>").json(f"{folder}/manifest").first()
    if manifest is None or manifest["version"] not in VERSIONS:
        raise ValueError(f"unknown snapshot version in {folder}")
    return {t: spark.read.schema(schema(t)).parquet(f"{folder}/{t}") for t in manifest["tables"] if t in TABLES}


def merge_snapshots(a: dict[str, DataFrame], b: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Lists are concatenated, file dates take the minimum; symbols then go through ``ingest.upsert_symbols``."""
    out = {}
    for name in sorted(a.keys() | b.keys()):
        both = [x[name] for x in (a, b) if name in x]
        df = both[0] if len(both) == 1 else both[0].unionByName(both[1])
        if name == "file_dates":
            df = df.groupBy("path").agg(F.min("latest").alias("latest"), F.min("oldest").alias("oldest"))
        elif name == "file_module_usages":
            df = df.groupBy("path").agg(
                F.when(F.count_distinct("owningModule") == 1, F.min("owningModule")).alias("owningModule"),
                F.sort_array(F.array_distinct(F.flatten(F.collect_list("referencedModules")))).alias("referencedModules"),
                (F.bool_or("hasUnattributedReferences") | (F.count_distinct("owningModule") > 1)).alias("hasUnattributedReferences"),
            )
        elif name == "property_accesses":
            df = df.groupBy("usr").agg(*[F.bool_or(c).alias(c) for c in ("hasRead", "hasWrite", "hasAmbiguous")])
        out[name] = df
    return out


def common_headers(a: DataFrame | None, b: DataFrame | None) -> DataFrame | None:
    """Admitted headers of a merge: the intersection, unknown when either side is."""
    return None if a is None or b is None else a.intersect(b)


def read_json(spark: SparkSession, path: str, table: str) -> DataFrame:
    return spark.read.schema(schema(table)).option("multiLine", "true").json(path)


def read_baseline(spark: SparkSession, path: str) -> DataFrame:
    """One column ``fingerprint``; an unknown version is refused."""
    doc = spark.read.schema("version int, generatedBy string, fingerprints array<string>").option("multiLine", "true").json(path)
    versions = [r["version"] for r in doc.select("version").distinct().limit(3).collect()]
    if any(v != 1 for v in versions):
        raise ValueError(f"unknown baseline version: {versions}")
    return doc.select(F.explode("fingerprints").alias("fingerprint")).distinct()


def write_baseline(findings: DataFrame, path: str, generated_by: str = "weftline") -> None:
    from ..operators.findings import fingerprint

    sorted_ = findings.select(fingerprint().alias("f")).distinct().agg(F.sort_array(F.collect_list("f")).alias("fingerprints"))
    sorted_.select(F.lit(1).alias("version"), F.lit(generated_by).alias("generatedBy"), "fingerprints").coalesce(1).write.mode("overwrite").json(path)


def read_external_retentions(spark: SparkSession, path: str) -> DataFrame:
    doc = spark.read.schema("version int, retentions array<struct<symbol:struct<usr:string,qualifiedName:string>,reason:string>>").option("multiLine", "true").json(path)
    return doc.select(F.posexplode("retentions").alias("ordinal", "r")).select("ordinal", "r.symbol.usr", "r.symbol.qualifiedName", "r.reason")


def read_batch_requests(spark: SparkSession, text: str, limit: int = 1000, max_bytes: int = 1 << 20) -> DataFrame:
    """A JSON array of 1 to ``limit`` names, duplicates and order kept as ``position``."""
    import json

    if len(text.encode()) > max_bytes:
        raise ValueError("batch request is too large")
    names = json.loads(text)
    if not isinstance(names, list) or not 1 <= len(names) <= limit or not all(isinstance(n, str) for n in names):
        raise ValueError(f"batch request must be an array of 1 to {limit} names")
    return spark.createDataFrame(list(enumerate(names)), "position int, subject string")


def read_files(spark: SparkSession, folder: str, glob: str = "*", excluded_dirs: tuple[str, ...] = (".build", "DerivedData", ".git")) -> DataFrame:
    """File inventory: path, modificationTime, length, content hash; build folders are left out."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(folder)
    for d in excluded_dirs:
        files = files.where(~F.col("path").contains(f"/{d}/"))
    return files.select("path", "modificationTime", "length", F.sha2("content", 256).alias("sha"))


def changed_facts(inventory: DataFrame, cache: DataFrame) -> DataFrame:
    """Files to scan again: those whose (path, sha) the cache does not hold."""
    return inventory.join(cache.select("path", "sha"), ["path", "sha"], "left_anti")


def newest_store(stores: DataFrame) -> DataFrame:
    """Of candidate stores (path, project, recency), the newest per project; ties take the greater path."""
    return stores.groupBy("project").agg(F.max(F.struct("recency", "path")).alias("s")).select("project", "s.path", "s.recency")


HUNK = r"^@@ -\d+(?:,\d+)? \+(\d+)(?:,(\d+))? @@"


def changed_lines(diff: DataFrame) -> DataFrame:
    """Line ranges (path, first, last) of hunks in ``diff`` (file_ordinal, line_no, line); a pure deletion
    marks the line it follows."""
    from pyspark.sql.window import Window

    order = Window.partitionBy("file_ordinal").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    path = F.last(F.when(F.col("line").startswith("+++ "), F.regexp_replace(F.substring("line", 5, 4096), r"^b/|\t.*$", "")), ignorenulls=True).over(order)
    hunks = diff.withColumn("path", path).where(F.col("line").rlike(HUNK))
    start = F.regexp_extract("line", HUNK, 1).cast("int")
    n = F.regexp_extract("line", HUNK, 2)
    n = F.when(n == "", 1).otherwise(n.cast("int"))
    return hunks.where(F.col("path") != "/dev/null").select("path", start.alias("first"), (start + F.greatest(n, F.lit(1)) - 1).alias("last"))


def interface_builder_names(files: DataFrame) -> DataFrame:
    """Classes and actions named in Interface Builder documents (path, text): path, kind, name."""
    found = lambda attr, kind: files.select("path", F.lit(kind).alias("kind"), F.explode(F.regexp_extract_all("text", F.lit(attr + r'="([^"]+)"'), F.lit(1))).alias("name"))
    return found("customClass", "class").unionByName(found("selector", "action")).distinct()


def core_data_entities(spark: SparkSession, path: str) -> DataFrame:
    """Entities of data model XML: name, class, parent, is_abstract."""
    rows = spark.read.text(path, wholetext=True).select(F.explode(F.regexp_extract_all("value", F.lit(r"(?s)<entity\b([^>]*)>"), F.lit(1))).alias("a"))
    attr = lambda n: F.nullif(F.regexp_extract("a", rf'\b{n}="([^"]*)"', 1), F.lit(""))
    return rows.select(attr("name").alias("name"), attr("representedClassName").alias("class"), attr("parentEntity").alias("parent"), (attr("isAbstract") == "YES").alias("is_abstract"))
