"""Findings: identity, order, scope, baseline, thresholds and summaries."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..plans.stage import Stage

SEVERITY_RANK = {"info": 0, "warning": 1, "error": 2}
RULES = (
    "unused-symbol", "unused-import", "unused-parameter", "assign-only-property", "test-only-symbol", "redundant-public",
    "superfluous-ignore", "dependency-cycle", "layer-violation", "unassigned-layer", "metric-distance", "metric-instability",
    "unverified-test-markers", "local-function-skip",
)


def fingerprint() -> Column:
    return F.concat(F.col("ruleIdentifier"), F.lit("|"), F.coalesce("subject", "message"))


def severity_rank(column: str = "severity") -> Column:
    out = F.lit(-1)
    for name, rank in SEVERITY_RANK.items():
        out = F.when(F.col(column) == name, rank).otherwise(out)
    return out


def make_findings(rows: DataFrame, rule: str, severity: str, message: Column, subject: Column, location: Column | None = None) -> DataFrame:
    """Rows as findings of one rule; subject carries the identity."""
    if rule not in RULES:
        raise ValueError(f"unknown rule: {rule}")
    place = F.lit(None).cast("struct<path:string,line:int,column:int>") if location is None else location
    return rows.select(
        F.lit(rule).alias("ruleIdentifier"), F.lit(severity).alias("severity"), message.alias("message"), place.alias("location"), subject.alias("subject"), F.array().cast("array<string>").alias("details")
    )


def ordered(findings: DataFrame) -> DataFrame:
    """Severity falling, rule, located ones first, place, message."""
    return findings.orderBy(severity_rank().desc(), "ruleIdentifier", F.col("location").isNull(), F.col("location").asc_nulls_last(), "message")


def positions(findings: DataFrame) -> DataFrame:
    """``findings`` with ``position``, 1, 2, ... in their order, without gathering them: rows are sorted by range and
    stored, and a row's number is that in its range plus the sizes of the ranges before (one row per range)."""
    stage = Stage(findings.sparkSession, "positions")
    place = F.monotonically_increasing_id()
    rows = stage.keep(ordered(findings).withColumns({"_range": F.shiftright(place, 33), "_nth": place.bitwiseAND((1 << 33) - 1)}))
    sizes = rows.groupBy("_range").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return rows.join(sizes.select("_range", before.alias("_before")), "_range").withColumn("position", F.col("_before") + F.col("_nth") + 1).drop("_range", "_nth", "_before")


def suppress(findings: DataFrame, baseline: DataFrame) -> DataFrame:
    """Findings whose fingerprint the baseline (column ``fingerprint``) does not hold."""
    return findings.withColumn("fingerprint", fingerprint()).join(baseline.select("fingerprint").distinct(), "fingerprint", "left_anti").drop("fingerprint")


def rebase_fingerprints(baseline: DataFrame, roots: list[str]) -> DataFrame:
    """A baseline with its absolute paths below any of ``roots`` made relative, beside the given forms."""
    out = F.col("fingerprint")
    for root in sorted(roots, key=len, reverse=True):
        out = F.replace(out, F.lit(root.rstrip("/") + "/"), F.lit(""))
    return baseline.select(F.explode(F.array_distinct(F.array("fingerprint", out))).alias("fingerprint")).distinct()


def in_scope(findings: DataFrame, files: DataFrame, ranges: DataFrame | None = None) -> DataFrame:
    """Findings of changed files and, where a file has ranges, of changed lines; unlocated ones pass.

    ``files``: path; ``ranges``: path, first, last. An equi-join on the path with the range as a condition.
    """
    f = findings.withColumns({"_p": F.col("location.path"), "_l": F.col("location.line"), "_k": F.monotonically_increasing_id()})
    unlocated = f.where("_p is null")
    here = f.where("_p is not null").join(files.select(F.col("path").alias("_p")).distinct(), "_p", "left_semi")
    if ranges is not None:
        r = ranges.select(F.col("path").alias("_p"), "first", "last")
        whole = here.join(r.select("_p").distinct(), "_p", "left_anti")
        within = here.join(r, [here["_p"] == r["_p"], here["_l"] >= r["first"], here["_l"] <= r["last"]], "left_semi")
        here = whole.unionByName(within)
    return unlocated.unionByName(here.select(*f.columns)).drop("_p", "_l", "_k")


def cycles_in_scope(cycles: DataFrame, changed: DataFrame) -> DataFrame:
    """Cycles (cycle_id, component) whose component holds a changed node (id)."""
    touched = cycles.select("cycle_id", F.explode("component").alias("id")).join(changed.select("id").distinct(), "id", "left_semi").select("cycle_id").distinct()
    return cycles.join(touched, "cycle_id", "left_semi")


def summarize_files(findings: DataFrame, top: int = 200) -> DataFrame:
    """path, n, errors, warnings, infos, rules (rule=count, sorted): the files with most findings.

    Counts per (path, rule) come first, so the histogram is built from at most one row per rule.
    """
    per = findings.where("location is not null").groupBy(F.col("location.path").alias("path"), "ruleIdentifier", "severity").agg(F.count("*").alias("k"))
    count = lambda s: F.sum(F.when(F.col("severity") == s, F.col("k")).otherwise(0))
    rules = per.groupBy("path", "ruleIdentifier").agg(F.sum("k").alias("k")).groupBy("path").agg(
        F.array_join(F.sort_array(F.collect_list(F.concat("ruleIdentifier", F.lit("="), F.col("k").cast("string")))), ",").alias("rules")
    )
    sums = per.groupBy("path").agg(F.sum("k").alias("n"), count("error").alias("errors"), count("warning").alias("warnings"), count("info").alias("infos"))
    return sums.orderBy(F.desc("n"), "path").limit(top).join(rules, "path").orderBy(F.desc("n"), "path")


def bounded(df: DataFrame, order: list, limit: int) -> tuple[DataFrame, int]:
    """The first rows and how many were left out."""
    total = df.count()
    return df.orderBy(*order).limit(limit), max(0, total - limit)


def share_budget(items: DataFrame, group_order: list[str], item_order: list[str], budget: int = 200) -> DataFrame:
    """Evidence items that fit a budget shared by groups in order: a running number, then a cut.

    Only the first ``budget`` rows in order are kept before numbering, so one task never sees more.
    """
    first = items.orderBy(*group_order, *item_order).limit(budget)
    return first.withColumn("position", F.row_number().over(Window.orderBy(*group_order, *item_order)))


def site_evidence(references: DataFrame, cap: int = 5) -> DataFrame:
    """source, target, kind, total, sites (first distinct places, up to the cap), omitted."""
    sites = references.select("source", "target", "kind", "location").distinct()
    rank = F.row_number().over(Window.partitionBy("source", "target", "kind").orderBy("location"))
    shown = sites.withColumn("r", rank).where(F.col("r") <= cap).groupBy("source", "target", "kind").agg(F.sort_array(F.collect_list("location")).alias("sites"))
    total = sites.groupBy("source", "target", "kind").agg(F.count("*").alias("total"))
    return total.join(shown, ["source", "target", "kind"]).withColumn("omitted", F.col("total") - F.size("sites"))


@dataclass(frozen=True)
class Outcome:
    """0 in order, 1 findings under strict, 2 a threshold or failure; a failed threshold beats findings."""

    findings: int
    counted: int
    limit: int | None = None
    strict: bool = False

    @property
    def exit_code(self) -> int:
        if self.limit is not None and self.counted > self.limit:
            return 2
        return 1 if self.strict and self.findings else 0


def outcome(findings: DataFrame, limit: int | None = None, strict: bool = False, counted_rule: str = "unused-symbol") -> Outcome:
    n, counted = findings.agg(F.count("*"), F.count_if(F.col("ruleIdentifier") == counted_rule)).first()
    return Outcome(n, counted, limit, strict)


GENERATED = r"(?is)^\s*(?://[^\n]*|/\*.*?\*/)?[^\n]*\b(@generated|do not (?:edit|modify)|auto-?generated)\b"


def is_generated(header: Column) -> Column:
    """A generated-source marker in the first comment of a file's header."""
    first = F.regexp_extract(header, r"(?s)^\s*((?://[^\n]*\n?)+|/\*.*?\*/)", 1)
    return F.lower(first).rlike(r"@generated|do not (?:edit|modify)|auto-?generated")


def comment_command(comment: Column) -> Column:
    """(command, argument) of ``weftline:command argument`` in a comment."""
    pattern = r"weftline:([a-z][a-z:-]*)(?:\s+(.*))?"
    return F.struct(F.nullif(F.regexp_extract(comment, pattern, 1), F.lit("")).alias("command"), F.trim(F.regexp_extract(comment, pattern, 2)).alias("argument"))
