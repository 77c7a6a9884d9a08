"""Renderers as line tables: each row is (section, position keys.., line), so any size writes in parallel.

``write_lines`` sorts by section and key and writes one text file; reports that need a document (JSON, SARIF,
HTML) are built from the same ordered rows.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from urllib.parse import quote

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import printable
from ..operators.findings import ordered
from ..operators.graph import Graph, kind_rank, top_by_degree

TOOL = "weftline"
DOT_EDGE = {"inheritance": "style=solid, arrowhead=empty", "conformance": "style=dashed, arrowhead=empty", "extends": "style=dotted", "overrides": "style=dashed", "member": "style=dotted, arrowhead=none", "import": "style=bold", "retention": "style=dashed, color=gray"}
DOT_SHAPE = {"module": "box3d", "file": "note", "protocol": "ellipse", "enum": "diamond"}


def choose(column: Column, table: dict[str, str], default: str) -> Column:
    out = F.lit(default)
    for k, v in table.items():
        out = F.when(column == k, F.lit(v)).otherwise(out)
    return out


def _escape(value: Column) -> Column:
    return F.replace(F.replace(value, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))


def _quoted(value: Column) -> Column:
    return F.concat(F.lit('"'), _escape(printable(value)), F.lit('"'))


def _lines(df: DataFrame, section: int, line: Column, *keys: Column) -> DataFrame:
    padded = [k.cast("string").alias(f"k{i}") for i, k in enumerate((*keys, F.lit(""), F.lit(""), F.lit(""))[:3])]
    return df.select(F.lit(section).alias("section"), *padded, line.alias("line"))


def _fixed(graph: Graph, section: int, text: str) -> DataFrame:
    return _lines(graph.nodes.sparkSession.range(1), section, F.lit(text))


def dot_lines(graph: Graph, cluster: bool = True) -> DataFrame:
    """DOT: nodes in a cluster per module, then edges with their weight."""
    n, e = graph.nodes, graph.edges
    module = F.coalesce("module", F.lit("")) if cluster and "module" in n.columns else F.lit("")
    node = F.concat(F.lit("    "), _quoted(F.col("id")), F.lit(" [label="), _quoted(F.col("name")), F.lit(", shape="), choose(F.col("kind"), DOT_SHAPE, "box"), F.lit("];"))
    out = _fixed(graph, 0, f"digraph {TOOL} {{\n  graph [rankdir=LR];\n  node [shape=box, style=rounded, fontsize=10];\n  edge [fontsize=8];")
    out = out.unionByName(_lines(n, 1, node, module, F.lit("1"), F.col("id")))
    if cluster:
        modules = n.select(module.alias("m")).distinct().where("m <> ''")
        out = out.unionByName(_lines(modules, 1, F.concat(F.lit('  subgraph "cluster_'), _escape(F.col("m")), F.lit('" {\n    label='), _quoted(F.col("m")), F.lit(";")), F.col("m"), F.lit("0")))
        out = out.unionByName(_lines(modules, 1, F.lit("  }"), F.col("m"), F.lit("2")))
    label = F.when(F.col("weight") > 1, F.concat(F.lit(', label="'), "weight", F.lit('"'))).otherwise("")
    edge = F.concat(F.lit("  "), _quoted(F.col("source")), F.lit(" -> "), _quoted(F.col("target")), F.lit(" ["), choose(F.col("kind"), DOT_EDGE, "style=solid"), label, F.lit("];"))
    return out.unionByName(_lines(e, 2, edge, F.col("source"), F.col("target"), kind_rank(F.col("kind")))).unionByName(_fixed(graph, 3, "}"))


def mermaid_lines(graph: Graph, limit: int = 200) -> DataFrame:
    """Mermaid flow chart of the ``limit`` best connected nodes; equal lines appear once."""
    keep = top_by_degree(graph.nodes, graph.edges, limit).select("id")
    nodes = graph.nodes.join(keep, "id").withColumn("n", F.concat(F.lit("n"), F.row_number().over(Window.orderBy("id")) - 1))
    label = printable(F.replace(F.col("name"), F.lit("\n"), F.lit(" ")))
    for a, b in (("#", "#35;"), ('"', "#quot;"), ("<", "#lt;"), (">", "#gt;")):
        label = F.replace(label, F.lit(a), F.lit(b))
    shapes = {"module": ("[[", "]]"), "protocol": ("([", "])"), "enum": ("{{", "}}"), "file": ("[/", "/]")}
    left, right = (choose(F.col("kind"), {k: v[i] for k, v in shapes.items()}, "[]"[i]) for i in (0, 1))
    ids = nodes.select("id", "n")
    e = graph.edges.join(ids.select(F.col("id").alias("source"), F.col("n").alias("a")), "source").join(ids.select(F.col("id").alias("target"), F.col("n").alias("b")), "target")
    arrow = choose(F.col("kind"), {k: "-.->" for k in ("inheritance", "conformance", "extends", "overrides", "retention")} | {"member": "---"}, "-->")
    drawn = e.select(F.concat(F.lit("    "), "a", F.lit(" "), arrow, F.lit(" "), "b").alias("line"), "source", "target").groupBy("line").agg(F.min(F.struct("source", "target")).alias("k"))
    total = graph.nodes.count()
    out = _fixed(graph, 0, "flowchart LR")
    if total > limit:
        out = out.unionByName(_fixed(graph, 1, f"%% truncated: {limit} of {total} nodes, by connectivity"))
    out = out.unionByName(_lines(nodes, 2, F.concat(F.lit("    "), "n", left, F.lit('"'), label, F.lit('"'), right), F.col("id")))
    return out.unionByName(_lines(drawn, 3, F.col("line"), F.col("k.source"), F.col("k.target")))


def json_lines(graph: Graph) -> DataFrame:
    """One JSON object per node and edge, keys sorted."""
    node = F.to_json(F.struct("id", "kind", "name"))
    edge = F.to_json(F.struct("kind", "source", "target", "weight"))
    return _lines(graph.nodes, 0, node, F.col("id")).unionByName(_lines(graph.edges, 1, edge, F.col("source"), F.col("target"), kind_rank(F.col("kind"))))


def evidence_json(graph: Graph, references: DataFrame) -> DataFrame:
    """One JSON object per edge with its occurrences in order."""
    occ = references.groupBy("source", "target", "kind").agg(F.sort_array(F.collect_list("location")).alias("occurrences"))
    j = graph.edges.join(occ, ["source", "target", "kind"], "left")
    return _lines(j, 0, F.to_json(F.struct("kind", "occurrences", "source", "target", "weight")), F.col("source"), F.col("target"), kind_rank(F.col("kind")))


def write_lines(lines: DataFrame, path: str) -> None:
    """Range-sorted, then written by one task: the file is a report, the work before it is distributed."""
    lines.orderBy("section", "k0", "k1", "k2").select("line").coalesce(1).write.mode("overwrite").text(path)


def text_of(lines: DataFrame) -> str:
    return "".join(r["line"] + "\n" for r in lines.orderBy("section", "k0", "k1", "k2").select("line").toLocalIterator())


def html(graph: Graph, limit: int = 400) -> str:
    """A self-contained page with the best connected nodes and their edges."""
    keep = top_by_degree(graph.nodes, graph.edges, limit).select("id")
    nodes = [r.asDict() for r in graph.nodes.join(keep, "id").select("id", "name", "kind").orderBy("id").collect()]  # at most limit
    e = graph.edges.join(keep.withColumnRenamed("id", "source"), "source", "left_semi").join(keep.withColumnRenamed("id", "target"), "target", "left_semi")
    edges = [r.asDict() for r in e.orderBy("source", "target", "kind").limit(limit * 50).collect()]
    data = json.dumps({"nodes": nodes, "edges": edges}, sort_keys=True).replace("</", "<\\/")
    return (
        "<!doctype html><meta charset=utf-8><title>graph</title><pre id=o></pre><script type=application/json id=d>" + data + "</script>"
        "<script>const g=JSON.parse(document.getElementById('d').textContent);"
        "document.getElementById('o').textContent=g.edges.map(e=>e.source+' -> '+e.target+' ('+e.kind+' '+e.weight+')').join('\\n')</script>\n"
    )


# ---- findings


def _show(text: str) -> str:
    return "".join(f"\\u{{{ord(c):X}}}" if ord(c) < 32 or ord(c) == 127 else c for c in text.replace("\\", "\\\\"))


def _rows(findings: DataFrame) -> Iterator:
    return ordered(findings).toLocalIterator()


def _xml(s: str) -> str:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        s = s.replace(a, b)
    return s


def _gh(s: str, prop: bool = False) -> str:
    s = s.replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A")
    return s.replace(":", "%3A").replace(",", "%2C") if prop else s


def report(findings: DataFrame, form: str, limitations: tuple[str, ...] = ()) -> Iterator[str]:
    """Lines of a report in one of: text, json, xcode, checkstyle, github-actions, sarif; rows are streamed in
    order and never held together."""
    if form in ("text", "xcode"):
        n = 0
        for r in _rows(findings):
            n += 1
            at = r["location"]
            where = f"{_show(at['path'])}:{at['line']}:{at['column']}: " if at else ""
            yield f"{where}{r['severity']}: {_show(r['message'])} ({_show(r['ruleIdentifier'])})"
        yield from (f"note: {_show(x)}" for x in limitations)
        if form == "text":
            yield f"{n} finding{'' if n == 1 else 's'}"
    elif form == "github-actions":
        level = {"error": "error", "warning": "warning", "info": "notice"}
        for r in _rows(findings):
            at = r["location"]
            props = [f"file={_gh(at['path'], True)}", f"line={at['line']}", f"col={at['column']}"] if at else []
            props.append(f"title={_gh(TOOL + ' ' + r['ruleIdentifier'], True)}")
            yield f"::{level[r['severity']]} {','.join(props)}::{_gh(r['message'])}"
        yield from (f"::notice title={TOOL} limitation::{_gh(x)}" for x in limitations)
    elif form == "checkstyle":
        yield '<?xml version="1.0" encoding="utf-8"?>'
        yield '<checkstyle version="4.3">'
        path = None
        rows = findings.orderBy(F.coalesce("location.path", F.lit("")), F.col("location.line"), "ruleIdentifier", "message").toLocalIterator()
        for r in rows:
            at = r["location"]
            here = at["path"] if at else ""
            if here != path:
                if path is not None:
                    yield "  </file>"
                yield f'  <file name="{_xml(here)}">'
                path = here
            yield f'    <error line="{at["line"] if at else 0}" column="{at["column"] if at else 0}" severity="{r["severity"]}" message="{_xml(r["message"])}" source="{TOOL}.{_xml(r["ruleIdentifier"])}"/>'
        if path is not None:
            yield "  </file>"
        yield "</checkstyle>"
    elif form == "json":
        yield json.dumps({"tool": TOOL, "limitations": list(limitations)}, sort_keys=True)
        for r in _rows(findings):
            yield json.dumps(r.asDict(recursive=True), sort_keys=True)
    elif form == "sarif":
        rules = [r["ruleIdentifier"] for r in findings.select("ruleIdentifier").distinct().orderBy("ruleIdentifier").collect()]
        head = {"$schema": "https://json.schemastore.org/sarif-2.1.0.json", "version": "2.1.0"}
        driver = {"tool": {"driver": {"name": TOOL, "rules": [{"id": x} for x in rules]}}}
        if limitations:
            driver["invocations"] = [{"executionSuccessful": True, "toolExecutionNotifications": [{"level": "note", "message": {"text": x}} for x in limitations]}]
        yield json.dumps(head)[:-1] + ', "runs": [' + json.dumps(driver)[:-1] + ', "results": ['
        level, first = {"error": "error", "warning": "warning", "info": "note"}, True
        for r in _rows(findings):
            at = r["location"]
            places = [{"physicalLocation": {"artifactLocation": {"uri": quote(at["path"])}, "region": {"startLine": max(1, at["line"]), "startColumn": max(1, at["column"])}}}] if at else []
            yield ("" if first else ",") + json.dumps({"ruleId": r["ruleIdentifier"], "level": level[r["severity"]], "message": {"text": r["message"]}, "locations": places}, sort_keys=True)
            first = False
        yield "]}]}"
    else:
        raise ValueError(f"unknown report form: {form}")


def metrics_lines(metrics: DataFrame) -> DataFrame:
    """The metrics table with values rounded to two digits, worst first."""
    row = F.format_string("%s\t%d\t%d\t%.2f\t%.2f\t%.2f\t%s", "id", "ca", "ce", "instability", "abstractness", "distance", "zone")
    key = F.format_string("%d%06.3f", (F.col("zone") == "isolated").cast("int"), 100 - F.col("distance"))
    return _lines(metrics, 0, row, key, F.col("id"))


def edit_rows(findings: DataFrame) -> DataFrame:
    """Mechanical fixes as edit rows (path, line, action): unused imports and redundant public; nothing is changed."""
    f = findings.where("location is not null and ruleIdentifier in ('unused-import', 'redundant-public')")
    action = F.when(F.col("ruleIdentifier") == "unused-import", "delete-line").otherwise("remove-public")
    return f.select("location.path", "location.line", action.alias("action"), "subject").distinct()


def revision_digest(rows: DataFrame) -> DataFrame:
    """One row, ``digest``: of a table's content, whatever the order of its rows; no column, and nothing else, is sorted.

    Rows are hashed as JSON with sorted keys, gathered by the first three hex digits of the hash, each of these 4096
    groups folded in order of its hashes, and the groups in order. A row that occurs twice counts twice.
    """
    h = rows.select(F.sha2(F.to_json(F.struct(*sorted(rows.columns)), {"ignoreNullFields": "false"}), 256).alias("h"))
    per = h.groupBy("h").agg(F.count("*").alias("n")).groupBy(F.substring("h", 1, 3).alias("g"))
    folded = per.agg(F.sha2(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("h", "n"))), lambda x: F.concat(x["h"], F.lit("*"), x["n"])), ""), 256).alias("d"))
    return folded.agg(F.sha2(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("g", "d"))), lambda x: x["d"]), ""), 256).alias("digest"))


LEVELS = {"github-actions": {"error": "error", "warning": "warning", "info": "notice"}, "sarif": {"error": "error", "warning": "warning", "info": "note"}}


def _replaced(value: Column, pairs: tuple[tuple[str, str], ...]) -> Column:
    for a, b in pairs:
        value = F.replace(value, F.lit(a), F.lit(b))
    return value


def report_lines(findings: DataFrame, form: str) -> DataFrame:
    """The findings' lines of a report (text, xcode, github-actions, checkstyle, json, sarif) as a table that writes in
    parallel, with the sort keys of the form; ``report`` frames them for a terminal."""
    at, rule, message = F.col("location"), F.col("ruleIdentifier"), F.col("message")
    place = (F.coalesce(at["path"], F.lit("~")), F.lpad(F.coalesce(at["line"], F.lit(0)).cast("string"), 9, "0"), rule)
    if form in ("text", "xcode"):
        where = F.when(at.isNotNull(), F.concat(printable(at["path"]), F.lit(":"), at["line"], F.lit(":"), at["column"], F.lit(": "))).otherwise("")
        line = F.concat(where, "severity", F.lit(": "), printable(message), F.lit(" ("), printable(rule), F.lit(")"))
    elif form == "github-actions":
        plain = (("%", "%25"), ("\r", "%0D"), ("\n", "%0A"))
        prop = (*plain, (":", "%3A"), (",", "%2C"))
        where = F.when(at.isNotNull(), F.concat(F.lit("file="), _replaced(at["path"], prop), F.lit(",line="), at["line"], F.lit(",col="), at["column"], F.lit(","))).otherwise("")
        line = F.concat(F.lit("::"), choose(F.col("severity"), LEVELS[form], "notice"), F.lit(" "), where, F.lit(f"title={TOOL} "), _replaced(rule, prop), F.lit("::"), _replaced(message, plain))
    elif form == "checkstyle":
        xml = (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;"))
        line = F.format_string('    <error line="%d" column="%d" severity="%s" message="%s" source="' + TOOL + '.%s"/>', F.coalesce(at["line"], F.lit(0)), F.coalesce(at["column"], F.lit(0)), "severity", _replaced(message, xml), _replaced(rule, xml))
    elif form == "json":
        line = F.to_json(F.struct("details", "location", "message", "ruleIdentifier", "severity", "subject"))
    elif form == "sarif":
        region = F.struct(F.greatest(F.lit(1), at["column"]).alias("startColumn"), F.greatest(F.lit(1), at["line"]).alias("startLine"))
        one = F.struct(F.struct(F.struct(at["path"].alias("uri")).alias("artifactLocation"), region.alias("region")).alias("physicalLocation"))
        places = F.when(at.isNotNull(), F.array(one)).otherwise(F.array().cast("array<struct<physicalLocation:struct<artifactLocation:struct<uri:string>,region:struct<startColumn:int,startLine:int>>>>"))
        line = F.to_json(F.struct(choose(F.col("severity"), LEVELS[form], "note").alias("level"), places.alias("locations"), F.struct(message.alias("text")).alias("message"), rule.alias("ruleId")))
    else:
        raise ValueError(f"unknown report form: {form}")
    return _lines(findings, 1, line, *place)


def fact_export(facts: DataFrame, kind: str) -> DataFrame:
    """Facts of one kind (bridges, schema, routes, language-traversal) as JSON lines with sorted keys, each under its kind."""
    return facts.select(F.to_json(F.struct(F.lit(kind).alias("kind"), F.struct(*sorted(facts.columns)).alias("fact"))).alias("line"))
