"""Ingestion joins, runtime evidence, text functions, sources, sinks and streams."""

import json
import random

import pytest
from pyspark.sql import functions as F

from weftline.functions import routes, text
from weftline.functions.sql_relations import looks_like_sql, relations_of, sql_relations
from weftline.functions.value_flow import VALUES, Solver, Value, bridge_constants, solve_programs
from weftline.operators import findings, ingest, runtime
from weftline.operators.graph import Graph
from weftline.sources import bundle, sinks
from weftline.streaming import traces


def test_globs(spark):
    cases = [("Pods", "a/Pods/b.swift", True), ("Pods", "a/MyPods/b", False), ("*.swift", "x/y.swift", True), ("a/*.swift", "a/b/c.swift", False), ("a/**/c", "a/c", True), ("a/**/c", "a/b/d/c", True), ("**", "x/y", True), ("a/?", "a/b", True), ("a/?", "a/bc", False), ("**/x.y", "qx.y", False), ("/a/**", "/a/b", True), ("[a]", "[a]/b", True)]
    df = spark.createDataFrame([(i, v) for i, (_, v, _) in enumerate(cases)], "i int, v string")
    for i, (p, _, want) in enumerate(cases):
        assert df.where(f"i = {i}").select(text.glob_match(F.col("v"), p)).first()[0] is want, p
    f = text.PathFilter(include=("Sources/**",), exclude=("Sources/Gen", "Gen"), root="/repo")
    got = spark.createDataFrame([("/repo/Sources/a.swift",), ("/repo/Sources/Gen/b.swift",), ("/repo/Tests/c.swift",)], "p string").select(f.allows(F.col("p"))).collect()
    assert [r[0] for r in got] == [True, False, False]


def test_nearest_asof_and_range_against_brute_force(spark):
    r = random.Random(4)
    left = [(i, r.choice("ab"), r.randrange(60)) for i in range(80)]
    right = [(r.choice("abc"), r.randrange(60), f"v{i}") for i in range(25)]
    ls, rs = spark.createDataFrame(left, "k int, path string, line int"), spark.createDataFrame(right, "path string, at int, v string")
    got = {x["k"]: x["v"] for x in ingest.nearest(ls, rs, ["path"], "line", "at", "v").collect()}
    for k, p, line in left:
        best = min((abs(line - a), a) for q, a, _ in right if q == p)[1]
        assert got[k] == min(v for q, a, v in right if q == p and a == best)
    defs = rs.select("path", F.col("at").alias("line"), "v").dropDuplicates(["path", "line"])
    rows = {(x["path"], x["line"]): x["v"] for x in defs.collect()}
    for x in ingest.asof_enclosing(ls, defs, ["path"], ["line"], "v").collect():
        before = [a for q, a in rows if q == x["path"] and a < x["line"]]
        assert x["enclosing"] == (rows[(x["path"], max(before))] if before else None)
    bodies = [(r.choice("a"), s, 0, s + r.randrange(12), 5) for s in [r.randrange(60) for _ in range(6)]]
    refs = ls.select(F.col("k").alias("rid"), "path", "line", F.lit(3).alias("column"))
    for x in ingest.reference_positions(refs, spark.createDataFrame(bodies, "path string, l1 int, c1 int, l2 int, c2 int")).collect():
        inside = any(p == x["path"] and (l1, c1) <= (x["line"], 3) <= (l2, c2) for p, l1, c1, l2, c2 in bodies)
        assert x["position"] == ("unknown" if x["path"] == "b" else "body" if inside else "signature")


def test_occurrence_mapping(spark):
    rel = "array<struct<role:string,usr:string,kind:string>>"
    rows = [
        (1, "P", "protocol", False, "l", [], [("baseOf", "C", "class")]), (2, "B", "class", False, "l", [], [("baseOf", "C", "class")]),
        (3, "w", "method", False, "l", [], [("overrideOf", "q", "method")]), (4, "f", "function", True, "l", ["R"], [("calledBy", "g", "function"), ("containedBy", "g", "function")]),
        (5, "v", "variable", True, "l", [], [("containedBy", "g", "function")]), (6, "T", "struct", False, "l", ["R", "S"], [("extendedBy", "E", "extension")]),
    ]
    df = spark.createDataFrame(rows, f"ordinal int, usr string, kind string, is_reference boolean, location string, receivers array<string>, relations {rel}")
    got = {(r["sourceUSR"], r["targetUSR"], r["kind"], r["receiverTypeUSR"]) for r in ingest.map_relations(df).collect()}
    assert got == {("C", "P", "conformance", None), ("C", "B", "inheritance", None), ("w", "q", "overrides", None), ("g", "f", "call", "R"), ("g", "v", "reference", None), ("E", "T", "extends", None)}


def test_upsert_and_facets(spark):
    rows = [("u", 1, False, "decl", None, ["a"], None), ("u", 2, True, "def", "P", ["b"], True), ("u", 3, True, "late", "Q", ["a"], False), ("f", 4, True, "$def", "P", [], None), ("d", 5, True, "def", "P", [], None)]
    df = spark.createDataFrame(rows, "usr string, ordinal int, is_definition boolean, name string, parentUSR string, attributes array<string>, compilerUnitTest boolean")
    up = {r["usr"]: r for r in ingest.upsert_symbols(df).collect()}
    assert (up["u"]["name"], up["u"]["parentUSR"], up["u"]["attributes"], up["u"]["compilerUnitTest"]) == ("def", "P", ["a", "b"], True)
    assert {(r["facet"], r["usr"]) for r in ingest.wrapper_facets(df).collect()} == {("f", "u"), ("f", "d")}


def test_contracts(spark):
    c = spark.createDataFrame([("ok", None, "t", "m", ["s1", "s2"], "v"), ("dup", None, "t", "m", ["s"], None), ("dup", None, "t", "m", ["s"], None), ("none", None, "x", "m", ["s"], None), ("many", "t2", "t", "m", ["s"], None), ("bad", None, "t", "m", [], None), ("wait", None, "t", "m", ["s1"], None), ("mech", None, "q", "m", ["s"], None)], "id string, source string, target string, mechanism string, requiredScenarios array<string>, expectedValue string")
    t = spark.createDataFrame([("t", 1, True), ("t2", 2, True), ("q", 1, False)], "name string, n int, mechanism_ok boolean")
    o = spark.createDataFrame([("ok", "s1", "observed", "v"), ("ok", "s2", "observed", "other"), ("zz", "s", "observed", None)], "contract string, scenario string, outcome string, value string")
    status = lambda **k: {r["id"]: r["status"] for r in runtime.validate_contracts(c, t, **k).collect()}
    assert status(observations=o) == {"ok": "failed", "dup": "invalidContract", "none": "missingTarget", "many": "ambiguousSource", "bad": "invalidContract", "wait": "unobserved", "mech": "invalidMechanism"}
    assert status()["ok"] == "declared" and status(observations=o, plan_matches=False)["ok"] == "staleObservations"
    assert status(freshness=spark.createDataFrame([("t", "stale")], "name string, state string"))["ok"] == "unverifiedTarget"
    assert [r["id"] for r in runtime.unexpected_contracts(c, o).collect()] == ["zz"]


def test_runtime_lookups(spark):
    parents = spark.createDataFrame([("C", "B"), ("B", "A")], "type string, parent string")
    members = spark.createDataFrame([("A", "f", "A.f"), ("B", "f", "B.f"), ("A", "g", "A.g1"), ("A", "g", "A.g2")], "owner string, name string, id string")
    q = spark.createDataFrame([(1, "C", "f"), (2, "C", "g"), (3, "C", "h")], "lookup int, type string, name string")
    got = {r["lookup"]: (r["status"], r["target"]) for r in runtime.nearest_members(q, members, parents).collect()}
    assert got == {1: ("resolved", "B.f"), 2: ("ambiguous", None), 3: ("unresolved", None)}
    ents = spark.createDataFrame([("m", "Base", "T0", None), ("m", "Sub", "T1", "Base"), ("x", "L", "T2", "L")], "model string, name string, target string, parent string")
    fetch = spark.createDataFrame([(1, "m", "Base"), (2, "x", "L")], "fetch int, model string, entity string")
    assert {(r["fetch"], r["target"]) for r in runtime.bind_entities(ents, fetch).collect()} == {(1, "T0"), (1, "T1")}
    obs = spark.createDataFrame([("c", "t", 1, "o1"), ("c", "t", 9, "o2")], "channel string, token string, at int, observer string")
    rem = spark.createDataFrame([("c", "t", 5)], "channel string, token string, at int")
    post = spark.createDataFrame([("c", 3, "p3"), ("c", 7, "p7"), ("c", 11, "p11")], "channel string, at int, post string")
    assert {(r["observer"], r["post"]) for r in runtime.notifications(obs, post, rem).collect()} == {("o1", "p3"), ("o2", "p11")}


def test_sql_relations(spark):
    names = lambda s, **k: [n for n, _ in sql_relations(s, **k)[0]]
    assert names("SELECT * FROM a, b AS x JOIN \"s.t\".u ON 1") == ["a", "b", "s%2Et.u"]
    assert names("WITH RECURSIVE t(a) AS (SELECT 1 FROM n) SELECT * FROM t; SELECT * FROM t") == ["n", "t"]
    assert names("SELECT extract(year FROM d), trim(both from (select x from y)) FROM z WHERE a IS NOT DISTINCT FROM b") == ["y", "z"]
    assert names("UPDATE t SET a = 1") == ["t"] and names("please update the docs") == []
    assert names("GRANT SELECT ON TABLE a, b TO r") == ["a", "b"] and names("grant select on the report") == []
    assert names("Select one from the menu", strict=True) == [] and names("TRUNCATE TABLE t") == ["t"]
    assert sql_relations("SELECT * FROM {x}")[1] == 1 and sql_relations("SELECT * FROM f(1)")[1] == 1
    assert looks_like_sql("select 1") and not looks_like_sql("Select 1", strict=True) and not looks_like_sql("hello")
    got = relations_of(spark.createDataFrame([(1, "SELECT 1"), (2, None), (3, "DELETE FROM q")], "i int, sql string")).collect()
    assert sorted((r["i"], r["name"]) for r in got) == [(1, None), (2, None), (3, "q")] or {(r["i"], r["name"]) for r in got} == {(1, None), (2, None), (3, "q")}


def test_routes():
    want = {"/a/{}": None, "a": "not-rooted", "/a b": "invalid-character", "/%zz": "malformed-percent", "/%2f": "lowercase-percent-hex", "/%41": "encoded-unreserved", "/{x}": "stray-brace", "/{}{}": "multiple-parameters", "/a{**}": "catch-all-partial", "/{**}/a": "catch-all-not-last", "/a/{**}": None, "/" + "a" * 2048: "too-long"}
    assert {k: routes.validate(k) for k in want} == want
    assert routes.normalize("/%41%2f é") == "/A%2F%20%C3%A9"
    assert routes.compose([("literal", "/a/"), ("value", None), ("literal", "/b?x="), ("value", None)]) == ("/a/{}/b", None, True)
    assert routes.compose([("literal", "/a"), ("value", None)]) == (None, "/a", False)
    assert routes.base_join("rfc3986", "https://h/v1/", "/x") == ("/x", "root", None)
    assert routes.base_join("slash-join", "https://h/v1", "/x") == ("/x", "base", None)
    assert routes.base_join("concatenation", "https://h/v1", "/x") == ("/v1/x", "root", None)
    assert routes.base_join("concatenation", None, "x")[2] == "ambiguous-base-join:"


def test_value_flow(spark):
    body = lambda ins, end, k=0: [{"id": k, "instructions": ins, "end": end}]
    ident = {"id": "id", "parameters": 1, "blocks": body([[0, "param", 0]], ["return", 0])}
    main = {"id": "main", "blocks": body([[0, "const", "string", "a"], [1, "const", "string", "b"], [2, "symbol", "id"], [3, "call", 2, [0]], [4, "call", 2, [1]], [5, "concat", [3, 4]]], ["return", 5])}
    got = {(f, r): (v, k) for f, r, v, k in Solver({"functions": [main, ident]}).solve(["main"]).results()}
    assert got[("main", -1)] == ("string:ab", True) and got[("id", -1)] == ("string:a,string:b", True)
    branch = {"id": "b", "blocks": [{"id": 0, "instructions": [[0, "const", "boolean", True], [1, "const", "string", "x"], [2, "const", "string", "y"]], "end": ["branch", 0, 1, 2]}, {"id": 1, "instructions": [], "end": ["return", 1]}, {"id": 2, "instructions": [], "end": ["return", 2]}]}
    assert Solver({"functions": [branch]}).solve(["b"]).results()[0][2] == "string:x"
    loop = {"id": "l", "parameters": 1, "blocks": body([[0, "param", 0], [1, "symbol", "l"], [2, "call", 1, [0]]], ["return", 2])}
    assert Solver({"functions": [loop]}).solve(["l"]).contexts
    many = Value(frozenset(("string", str(i)) for i in range(VALUES))).join(Value(frozenset([("string", "more")])))
    assert not many.atoms and many.reasons == {"value-budget"} and not many.join(Value(frozenset([("string", "z")]))).atoms
    programs = spark.createDataFrame([("c", json.dumps({"functions": [main, ident]}), ["main"])], "component string, program string, roots array<string>")
    values = solve_programs(programs)
    sites = spark.createDataFrame([("x:1", "c", "main", -1), ("x:2", "c", "id", -1)], "location string, component string, function string, register int")
    assert [(r["location"], r["constant"]) for r in bridge_constants(values, sites).collect()] == [("x:1", "ab")]


FIND = "ruleIdentifier string, severity string, message string, location struct<path:string,line:int,column:int>, subject string, details array<string>"


def test_sinks(spark, tmp_path):
    n = spark.createDataFrame([("a", 'A "x"', "class", "M"), ("b", "B", "protocol", "")], "id string, name string, kind string, module string")
    e = spark.createDataFrame([("a", "b", "conformance", 2), ("a", "b", "inheritance", 1)], "source string, target string, kind string, weight long")
    g = Graph(n, e)
    dot = sinks.text_of(sinks.dot_lines(g))
    assert '"a" -> "b" [style=dashed, arrowhead=empty, label="2"];' in dot and 'label="A \\"x\\""' in dot and dot.endswith("}\n")
    mermaid = sinks.text_of(sinks.mermaid_lines(g)).splitlines()
    assert mermaid.count("    n0 -.-> n1") == 1 and "truncated" in sinks.text_of(sinks.mermaid_lines(g, 1))
    assert [json.loads(x)["kind"] for x in sinks.text_of(sinks.json_lines(g)).splitlines()] == ["class", "protocol", "inheritance", "conformance"]
    assert "application/json" in sinks.html(g)
    sinks.write_lines(sinks.dot_lines(g), str(tmp_path / "dot"))
    assert spark.read.text(str(tmp_path / "dot")).count() == len(dot.splitlines())
    f = spark.createDataFrame([("unused-symbol", "warning", "x <y>\nz", ("a,b.swift", 3, 0), "s", []), ("unused-import", "error", "m", None, None, [])], FIND)
    lines = {form: list(sinks.report(f, form, ("limit: x",))) for form in ("text", "json", "xcode", "checkstyle", "github-actions", "sarif")}
    assert lines["xcode"] == ["error: m (unused-import)", "a,b.swift:3:0: warning: x <y>\\u{A}z (unused-symbol)", "note: limit: x"]
    assert lines["github-actions"][1].startswith("::warning file=a%2Cb.swift,line=3,col=0,title=")
    assert any("x &lt;y&gt;" in x for x in lines["checkstyle"]) and lines["text"][-1] == "2 findings"
    sarif = json.loads("".join(lines["sarif"]))
    assert [r["level"] for r in sarif["runs"][0]["results"]] == ["error", "warning"] and sarif["runs"][0]["results"][1]["locations"][0]["physicalLocation"]["region"]["startColumn"] == 1
    assert sinks.edit_rows(f).count() == 0
    one, two = (sinks.revision_digest(x).first()["digest"] for x in (e, e.repartition(3)))
    assert one == two and len(one) == 64


def test_sources(spark, tmp_path):
    b = str(tmp_path / "bundle")
    edges = spark.createDataFrame([("a", "b", "call", 1)], "source string, target string, kind string, weight long")
    bundle.write_bundle({"edges": edges}, b)
    assert bundle.read_bundle(spark, b)["edges"].collect() == edges.collect()
    f = spark.createDataFrame([("unused-symbol", "warning", "m", None, "s", []), ("unused-symbol", "error", "m2", None, "s", [])], FIND)
    bundle.write_baseline(f, str(tmp_path / "base"))
    assert [r[0] for r in bundle.read_baseline(spark, str(tmp_path / "base")).collect()] == ["unused-symbol|s"]
    assert findings.suppress(f, bundle.read_baseline(spark, str(tmp_path / "base"))).count() == 0
    (tmp_path / "v9.json").write_text('{"version": 9, "fingerprints": []}')
    for bad in (lambda: bundle.read_baseline(spark, str(tmp_path / "v9.json")), lambda: bundle.read_batch_requests(spark, "[]"), lambda: bundle.read_batch_requests(spark, '{"a": 1}')):
        try:
            bad()
            raise AssertionError("accepted")
        except ValueError:
            pass
    assert bundle.read_batch_requests(spark, '["b", "a", "b"]').count() == 3
    diff = "+++ b/x.swift\n@@ -1,2 +3,4 @@\n+a\n@@ -9 +12 @@\n@@ -20,3 +19,0 @@\n--- a/y\n+++ /dev/null\n@@ -1 +0,0 @@".split("\n")
    d = spark.createDataFrame([(0, i, x) for i, x in enumerate(diff)], "file_ordinal int, line_no int, line string")
    assert {(r["path"], r["first"], r["last"]) for r in bundle.changed_lines(d).collect()} == {("x.swift", 3, 6), ("x.swift", 12, 12), ("x.swift", 19, 19)}
    ib = spark.createDataFrame([("m.xib", '<view customClass="Box"/><action selector="tap:"/>')], "path string, text string")
    assert {(r["kind"], r["name"]) for r in bundle.interface_builder_names(ib).collect()} == {("class", "Box"), ("action", "tap:")}
    (tmp_path / "src").mkdir()
    (tmp_path / "src" / "a.swift").write_text("let a = 1")
    files = bundle.read_files(spark, str(tmp_path / "src"), "*.swift")
    assert bundle.changed_facts(files, files).count() == 0 and files.count() == 1
    (tmp_path / "model.xml").write_text('<model><entity name="E" representedClassName="C" parentEntity="P" isAbstract="YES"><a/></entity></model>')
    assert bundle.core_data_entities(spark, str(tmp_path / "model.xml")).first().asDict() == {"name": "E", "class": "C", "parent": "P", "is_abstract": True}


def test_streams(spark, tmp_path):
    src = str(tmp_path / "in")
    rows = [("c", "o1", "register", 1), ("c", "o1", "send", 2), ("c", "o1", "remove", 3), ("c", "o2", "send", 4)]
    df = spark.createDataFrame(rows, "channel string, observer string, kind string, at long")
    df.write.parquet(src)
    out = traces.live_registrations(spark.readStream.schema(df.schema).parquet(src))
    q = out.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert [(r["observer"], r["post"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()] == [("o1", 2)]
    late: list = []
    src2 = str(tmp_path / "in2")
    for k, ts in enumerate(("2024-01-01 10:00:00", "2024-01-01 09:00:00", "2024-01-01 09:58:00")):
        spark.sql(f"select timestamp'{ts}' as ts, {k} as k").write.mode("append").parquet(src2)
        s = spark.readStream.schema("ts timestamp, k int").parquet(src2)
        traces.split_late(s, lambda ok, old, _: late.extend(r["k"] for r in old.collect()), 600, str(tmp_path / "cp2")).awaitTermination()
    assert late == [1]
    made: list = []
    files = str(tmp_path / "files")
    for sha in ("1", "1", "2"):
        spark.createDataFrame([("p", sha)], "path string, sha string").write.mode("append").parquet(files)
        traces.incremental_session(spark.readStream.schema("path string, sha string").parquet(files), lambda r, n: made.append(r.count()), str(tmp_path / "cp3")).awaitTermination()
    assert made == [1, 1]


def test_predicate_key_paths():
    from weftline.functions.predicates import key_paths

    assert key_paths("name == 'x' AND (SELF.owner.age > -3.5 OR NOT %K BETWEEN %@)", ["b.c", None]) == ["b.c", "name", "owner.age"]
    assert key_paths("TRUEPREDICATE") == [] and key_paths("a CONTAINS[cd] \"q\\\"\"") == ["a"] and key_paths("nil != YES") == []
    for bad in ("", "a", "a == ", "(a == 1", "a === 1", "ANY a == 1", "a[x] == 1", "a..b == 1", "%K == 1", "a == 1e999", "a == 1 b", "a =="):
        assert key_paths(bad) is None
    assert key_paths("NOT " * 17 + "a == 1") is None and key_paths("NOT " * 16 + "a == 1") == ["a"]
    assert key_paths(None) is None and key_paths("a == 1" + " " * 4096) is None


def test_inputs(spark):
    from weftline.sources import inputs

    c = inputs.read_config('{"include": ["Sources"], "retention": {"retain_public": true, "retained_names": ["main"]}, "limit": 3}')
    assert c.include == ("Sources",) and c.retention.retain_public and c.retention.retained_names == ("main",) and c.limit == 3
    for bad in ('{"odd": 1}', "[]", '{"include": "x"}', '{"level": "galaxy"}', '{"retention": {"odd": 1}}'):
        with pytest.raises(ValueError):
            inputs.read_config(bad)
    good = {"language": "swift", "kind": "function", "owner": "Api", "name": "get", "pathArg": 0, "defaultMethod": "GET", "pathAnchor": "root"}
    doc = lambda w, v=1: json.dumps({"format": "http-wrappers", "version": v, "wrappers": [w]})
    assert inputs.read_wrappers(spark, doc(good)).count() == 1
    for bad, v in ((good | {"odd": 1}, 1), (good | {"language": "cobol"}, 1), (good | {"pathSuffix": []}, 1), (good | {"pathSuffix": [{"x": 1}]}, 2), ({k: x for k, x in good.items() if k != "defaultMethod"}, 1), (good, 3)):
        with pytest.raises(ValueError):
            inputs.read_wrappers(spark, doc(bad, v))


def test_container_paths_of_any_depth(spark):
    from weftline.operators import lookup

    nodes = spark.createDataFrame([("m", "f()", "App"), ("b", "B", "App"), ("a", "A", "App"), ("x", "f()", "App"), ("y", "Y", "App")], "id string, name string, module string")
    parents = spark.createDataFrame([("m", "b"), ("b", "a"), ("x", "y"), ("y", "x")], "id string, parent string")
    asked = ["A.B.f", "B.f", "A.f", "App.A.B.f", "App.f", "B.A.f", "Y.f", "Z.Y.f", "App.Y.f"]
    q = spark.createDataFrame(list(enumerate(asked)), "position int, subject string")
    got = {r["subject"]: r["candidates"] for r in lookup.resolve(q, nodes, parents).collect()}
    assert got == {"A.B.f": ["m"], "B.f": ["m"], "A.f": ["m"], "App.A.B.f": ["m"], "App.f": ["m", "x"], "B.A.f": [], "Y.f": ["x"], "Z.Y.f": [], "App.Y.f": ["x"]}
