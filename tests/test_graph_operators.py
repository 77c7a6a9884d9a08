"""Graph operators against brute force on small random graphs and on worked examples."""

import random
from collections import defaultdict, deque

import pytest
from pyspark.sql import functions as F

from weftline.plans import registry
from weftline.operators import cycles, exposure, findings, graph, impact, lookup, metrics, multiroot, reach
from weftline.operators.graph import Graph

NODE = "id string, name string, kind string, module string, accessibility string, attributes array<string>, location struct<path:string,line:int,column:int>"
EDGE = "source string, target string, kind string, weight long"


def nodes(spark, ids, **kinds):
    return spark.createDataFrame([(i, i, kinds.get(i, "function"), "M", "internal", [], ("a.swift", k, 1)) for k, i in enumerate(ids)], NODE)


def edges(spark, rows):
    return spark.createDataFrame([(*r, "call", 1)[:2] + (r[2] if len(r) > 2 else "call", r[3] if len(r) > 3 else 1) for r in rows], EDGE)


def rand_edges(seed, n, m):
    r = random.Random(seed)
    return sorted({(f"n{r.randrange(n)}", f"n{r.randrange(n)}") for _ in range(m)})


def closure(pairs):
    out = defaultdict(set)
    for s, t in pairs:
        out[s].add(t)
    full = {}
    for s in list(out):
        seen, todo = set(), deque([s])
        while todo:
            for t in out[todo.popleft()] - seen:
                seen.add(t)
                todo.append(t)
        full[s] = seen
    return full


@pytest.mark.parametrize(("seed", "small"), [(1, 0), (2, 0), (4, 1000), (5, 1000)])
def test_components_are_mutual_reachability(spark, seed, small):
    pairs = rand_edges(seed, 14, 22)
    full = closure(pairs)
    want = {}
    for a in full:
        same = {b for b in full[a] if b != a and a in full.get(b, ())}
        if same:
            want[a] = min(same | {a})
    got = cycles.strong_components(edges(spark, pairs), small=small)
    assert {r["id"]: r["component"] for r in got.collect()} == want
    for r in cycles.representative_cycles(edges(spark, pairs), got).collect():
        path = r["path"].split(" > ")
        assert len(set(path)) == len(path) == r["length"] >= 2
        assert all((a, b) in pairs for a, b in zip(path, path[1:] + path[:1], strict=True))
        mutual = sorted((a, b) for a, b in pairs if a < b and (b, a) in pairs and want.get(a) == r["component"])
        assert not mutual or path == list(mutual[0])


def test_long_cycle_and_weakest_link(spark):
    e = edges(spark, [("a", "b", "call", 5), ("b", "c", "reference", 2), ("b", "c", "call", 2), ("c", "a", "call", 2), ("c", "d")])
    c = cycles.strong_components(e)
    got = cycles.representative_cycles(e, c).collect()
    assert [(r["component"], r["path"]) for r in got] == [("a", "a > b > c")]
    w = cycles.weakest_links(cycles.representative_cycles(e, c), e).first()
    assert (w["source"], w["target"], w["kind"], w["weight"]) == ("b", "c", "call", 2)
    big = cycles.representative_cycles(e, c, small=0).collect()
    assert big[0]["path"] == "a > b > c"


def test_self_loops(spark):
    e = edges(spark, [("a", "a"), ("b", "c")])
    assert cycles.strong_components(e).count() == 0
    assert [r["id"] for r in cycles.strong_components(e, self_loops=True).collect()] == ["a"]


def brute_reach(ns, es, roots, parent):
    """The rules, applied until nothing changes."""
    kind = dict(ns)
    req = {x for x, p in parent.items() if kind.get(p) == "protocol"}
    holder = {}
    for s, t, k in sorted(es):
        if k == "member":
            holder.setdefault(t, s)
    got = set(roots)
    while True:
        new = set()
        for s, t, k in es:
            if k == "member":
                if s in got and kind.get(t) == "deinit":
                    new.add(t)
                continue
            if s in got and not (k == "overrides" and t in req and s not in req):
                new.add(t)
            if k == "overrides" and t in got:
                own = parent.get(s)
                default = kind.get(holder.get(s)) == "extension" and own == parent.get(t) and t in req
                if default or own not in kind or own in got:
                    new.add(s)
        if new <= got:
            return got
        got |= new


@pytest.mark.parametrize("seed", range(3))
def test_conditional_reachability(spark, seed):
    r = random.Random(seed)
    types = [("P", "protocol"), ("C", "class"), ("D", "class"), ("X", "extension"), ("Y", "extension")]
    methods = [(f"m{i}", r.choice(["method", "method", "deinit"])) for i in range(14)]
    ns = types + methods
    es = {("X", "P", "extends")}
    for m, _ in methods:
        if r.random() < 0.9:
            es.add((r.choice("PCDXY"), m, "member"))
    for _ in range(14):
        a, b = r.sample(methods, 2)
        es.add((a[0], b[0], r.choice(["call", "overrides", "overrides"])))
    for _ in range(4):
        es.add((r.choice(methods)[0], r.choice("CD"), "reference"))
    owner = {}
    for s, t, k in sorted(es):
        if k == "member":
            owner.setdefault(t, s)
    parent = {t: "P" if s == "X" else s for t, s in owner.items()}
    roots = {m for m, _ in r.sample(methods, 2)}
    g = Graph(nodes(spark, [n for n, _ in ns], **dict(ns)), edges(spark, sorted(es)))
    start = spark.createDataFrame([(x,) for x in roots], "id string")
    rows = reach.reachable(g, start, small=0).collect()
    got = {x["id"] for x in rows}
    assert {tuple(x) for x in reach.reachable(g, start).collect()} == {tuple(x) for x in rows}
    # Usage edges into extensions: "extends" is a usage edge as well.
    assert got == brute_reach(ns, es, roots, parent)


def test_conditional_roots_wait_for_their_owner(spark):
    g = Graph(nodes(spark, ["r", "o", "w", "x"]), edges(spark, [("r", "o"), ("w", "x")]))
    one = lambda *rows: spark.createDataFrame([(i,) for i in rows], "id string")
    cond = spark.createDataFrame([("w", "o"), ("x", "gone")], "id string, owner string")
    assert {x["id"] for x in reach.reachable(g, one("r"), cond).collect()} == {"r", "o", "w", "x"}
    assert {x["id"] for x in reach.reachable(g, one("x"), cond).collect()} == {"x"}
    got = reach.reachable(g, one("r"), cond)
    told = reach.explain(got, one("r"), spark.createDataFrame([("x",), ("r",), ("nowhere",)], "id string")).orderBy("id", "step").collect()
    assert [(r["id"], r["state"], r["step"], r["node"]) for r in told] == [
        ("nowhere", "unreachable", None, None), ("r", "retained", 0, "r"), *[("x", "reachable", k, n) for k, n in enumerate(("r", "o", "w", "x"))]
    ]
    assert reach.superfluous_ignores(g, one("r", "o", "x"), [("on o", ["o"]), ("on x", ["x"])], cond) == ["on o", "on x"]
    assert reach.superfluous_ignores(g, one("r", "x"), [("on x", ["x"])]) == []


def test_retention_reasons_take_the_first(spark):
    n = spark.createDataFrame(
        [("a", "main()", "method", "M", "internal", [], ("main.swift", 1, 1)), ("T", "T", "struct", "M", "public", ["main"], ("t.swift", 1, 1)), ("k", "k", "case", "M", "public", ["ibOutlet", "ignored"], ("t.swift", 2, 1)), ("z", "z", "function", "M", "public", [], ("z.swift", 1, 1)), ("q", "q", "function", "M", "internal", [], ("q.swift", 1, 1))],
        NODE,
    )
    g = Graph(n, edges(spark, [("T", "a", "member")]))
    refs = spark.createDataFrame([("q", "external", "overrides")], "sourceUSR string, targetUSR string, kind string")
    got = {r["id"]: r["reason"] for r in reach.retained(g, refs, reach.Retention(retain_public=True)).collect()}
    assert got == {"a": "entryPointMember", "T": "entryPoint", "k": "ignoreComment", "z": "publicAPI", "q": "externalRelation"}
    assert "z" not in {r["id"] for r in reach.retained(g, refs).collect()}


def test_unused_hides_members_of_dead_types(spark):
    g = Graph(nodes(spark, ["T", "m", "f", "r"], T="class", m="method"), edges(spark, [("T", "m", "member")]))
    dead = reach.unused(g, spark.createDataFrame([("r",)], "id string"))
    assert {x["id"] for x in dead.collect()} == {"T", "f"}


@pytest.mark.parametrize("seed", range(2))
def test_impact_is_breadth_first_with_least_via(spark, seed):
    pairs = [p for p in rand_edges(seed, 20, 34) if p[0] != p[1]]
    ids = sorted({x for p in pairs for x in p})
    changed = ids[:2]
    depth, via, front = {c: 0 for c in changed}, {}, list(changed)
    while front:
        nxt = {}
        for t in front:
            for s, u in pairs:
                if u == t and s not in depth:
                    nxt[s] = min(nxt.get(s, t), t)
        for s, t in nxt.items():
            depth[s], via[s] = depth[t] + 1, t
        front = list(nxt)
    g = Graph(nodes(spark, ids), edges(spark, pairs))
    start = spark.createDataFrame([(c,) for c in changed], "id string")
    rows, cut = impact.impact(g, start)
    assert {(r["id"], r["depth"], r["via"]) for r in rows.collect()} == {(s, depth[s], t) for s, t in via.items()} and not cut
    near, cut = impact.impact(g, start, 1)
    assert {r["id"] for r in near.collect()} == {s for s in via if depth[s] == 1} and cut == any(d > 1 for d in depth.values())


def test_impact_through_a_contract(spark):
    ns = nodes(spark, ["P", "p", "w", "caller", "P2"], P="protocol", p="method", w="method")
    e = edges(spark, [("P", "p", "member"), ("w", "p", "overrides"), ("caller", "p"), ("P", "p", "call")])
    rows, _ = impact.impact(Graph(ns, e), spark.createDataFrame([("w",)], "id string"))
    got = {r["id"]: (r["relation"], r["kinds"], r["contract"]) for r in rows.collect()}
    assert got == {"caller": ("dispatchCaller", "call,overrides", "p")}
    rows, _ = impact.impact(Graph(ns, e), spark.createDataFrame([("p",)], "id string"))
    got = {r["id"]: r["relation"] for r in rows.collect()}
    assert got == {"w": "dispatchContract", "caller": "dependent", "P": "dependent"}
    extra = spark.createDataFrame([("x", "w", "runtimeContract"), ("x", "w", "observedRuntime")], "source string, target string, relation string")
    rows, _ = impact.impact(Graph(ns, e), spark.createDataFrame([("w",)], "id string"), supplemental=extra)
    assert {r["id"]: r["relation"] for r in rows.collect()}["x"] == "observedRuntime"


def test_test_identity_and_lifecycle(spark):
    ns = spark.createDataFrame([(i, n, k, "T", "internal", a, ("t", 1, 1)) for i, n, k, a in (("B", "XCTestCase", "class", []), ("A", "Base", "class", []), ("C", "Case", "class", []), ("t", "testIt()", "method", []), ("h", "helper()", "method", []), ("u", "setUp()", "method", []), ("s", "suite", "struct", ["swiftSuite"]))], NODE)
    e = edges(spark, [("A", "B", "inheritance"), ("C", "A", "inheritance"), ("C", "t", "member"), ("C", "h", "member"), ("A", "u", "member")])
    tests = impact.test_identity(ns, e)
    assert {r["id"] for r in tests.where("certain").collect()} == {"A", "C", "t", "s"}
    life = impact.lifecycle_edges(ns, e, tests.where("id = 't'"))
    assert {(r["source"], r["target"]) for r in life.collect()} == {("t", "u")}
    got = impact.affected_tests(Graph(ns, e), spark.createDataFrame([("u",)], "id string"), tests, life)
    assert [(r["id"], r["depth"]) for r in got.collect()] == [("t", 1)]


def test_multi_root_examples(spark):
    e = edges(spark, [("B", "A"), ("C", "B")])
    g = Graph(nodes(spark, ["A", "B", "C"]), e)
    roots = spark.createDataFrame([("A", 0), ("B", 1)], "id string, position int")
    rows, cut = multiroot.traverse(multiroot.traversal_hops(g, dependents=True), roots, 5)
    got = {r["id"]: (r["via"], r["depth"], r["roots"], r["evidence"]) for r in rows.collect()}
    assert got == {"B": ("A", 1, "0", "direct"), "C": ("B", 1, "0,1", "direct")} and not cut


@pytest.mark.parametrize("seed", range(2))
def test_multi_root_against_brute_force(spark, seed):
    pairs = [p for p in rand_edges(seed + 20, 16, 26) if p[0] != p[1]]
    ids = sorted({x for p in pairs for x in p})
    roots = {ids[0]: 0, ids[3]: 1, ids[5]: 2}
    dist = {}
    for v, k in roots.items():
        dist[k], todo = {v: 0}, deque([v])
        while todo:
            at = todo.popleft()
            for s, t in pairs:
                if s == at and t not in dist[k]:
                    dist[k][t] = dist[k][at] + 1
                    todo.append(t)
    want = {}
    for v in ids:
        other = [k for k in dist if v in dist[k] and roots.get(v) != k]
        if other:
            d = min(dist[k][v] for k in other)
            near = lambda u, v=v: min((dist[k][u] for k in dist if u in dist[k] and k != roots.get(v)), default=None)
            via = min(s for s, t in pairs if t == v and near(s) == d - 1)
            want[v] = (d, via, ",".join(map(str, sorted(other))))
    hops = multiroot.traversal_hops(Graph(nodes(spark, ids), edges(spark, pairs)), dependents=False)
    table = spark.createDataFrame(list(roots.items()), "id string, position int")
    for local in (True, False):
        rows, _ = multiroot.traverse(hops, table, 9, local)
        assert {r["id"]: (r["depth"], r["via"], r["roots"]) for r in rows.collect()} == want
    rows, cut = multiroot.traverse(hops, table, 1)
    assert {r["id"] for r in rows.collect()} == {v for v, (d, *_) in want.items() if d <= 1} and cut == any(d > 1 for d, *_ in want.values())


def test_evidence_tiers(spark):
    ns = nodes(spark, ["P", "p", "w", "c", "C"], P="protocol", C="class")
    e = edges(spark, [("P", "p", "member"), ("w", "p", "overrides"), ("C", "w", "member"), ("C", "P", "conformance"), ("c", "p")])
    root = spark.createDataFrame([("w", 0)], "id string, position int")
    for closed, tier in ((True, "bound"), (False, "candidate")):
        hops = multiroot.traversal_hops(Graph(ns, e), dependents=True, closed_world=closed)
        rows, _ = multiroot.traverse(hops, root, 5)
        assert {r["id"]: r["evidence"] for r in rows.collect()}["c"] == tier


def test_level_projection(spark):
    loc = ("a.swift", 1, 1)
    symbols = spark.createDataFrame(
        [(0, "T", "T", "struct", "M", loc, None, False), (1, "m", "m", "method", "M", loc, "E", False), (2, "E", "E", "extension", "M", loc, None, False), (3, "f", "f", "function", "N", ("b.swift", 1, 1), None, False), (4, "x", "x", "function", "Z", loc, None, True)],
        "ordinal long, usr string, name string, kind string, module string, location struct<path:string,line:int,column:int>, parentUSR string, isExternal boolean",
    )
    refs = spark.createDataFrame([("E", "T", "extends", loc), ("m", "f", "call", loc), ("m", "f", "call", loc), ("f", "x", "call", loc), ("f", "T", "call", ("b.swift", 2, 1)), ("T", "m", "call", loc)], "sourceUSR string, targetUSR string, kind string, location struct<path:string,line:int,column:int>")
    rows = lambda level, **k: sorted((r["source"], r["target"], r["kind"], r["weight"]) for r in graph.build_graph(symbols, refs, level, **k)[0].edges.collect())
    assert rows("type") == [("T", "f", "call", 2), ("f", "T", "call", 1)]
    assert rows("module") == [("M", "N", "call", 2), ("N", "M", "call", 1)]
    assert rows("file") == [("a.swift", "b.swift", "call", 2), ("b.swift", "a.swift", "call", 1)]
    assert ("E", "m", "member", 1) in rows("symbol")
    excluded = spark.createDataFrame([("b.swift",)], "path string")
    assert rows("file", excluded_paths=excluded) == [("a.swift", "b.swift", "call", 2)]
    owners = spark.createDataFrame([("a.swift", "M"), ("a.swift", "N"), ("b.swift", "N")], "path string, owningModule string")
    g, limits = graph.build_graph(symbols, refs, "module", file_modules=owners)
    assert limits.first()["examples"] == ["a.swift"]


def test_merge_drops_dangling_and_sums(spark):
    e = edges(spark, [("a", "b", "call", 2), ("a", "b", "call", 3), ("a", "zz"), ("a", "a", "call", 9)])
    got = graph.merge_edges(e, nodes(spark, ["a", "b"]), drop_self_loops=True).collect()
    assert [(r["source"], r["target"], r["weight"]) for r in got] == [("a", "b", 5)]


def test_neighbourhood_limit_stops_expansion(spark):
    g = Graph(nodes(spark, list("abcde")), edges(spark, [("a", "b"), ("a", "c"), ("b", "d"), ("c", "e"), ("a", "b", "reference")]))
    rows, cut = graph.usage_neighbourhood(g.nodes, g.edges, "a", 2, 2, incoming=False)
    assert {(r["id"], r["depth"], tuple(r["kinds"])) for r in rows.collect()} == {("b", 1, ("call", "reference")), ("c", 1, ("call",))} and cut
    rows, cut = graph.usage_neighbourhood(g.nodes, g.edges, "a", 3, 10, incoming=False)
    assert {r["id"] for r in rows.collect()} == set("bcde") and not cut


def test_metrics_zones(spark):
    g = Graph(nodes(spark, ["a", "b", "c", "d"]), edges(spark, [("a", "b"), ("c", "b"), ("b", "b"), ("a", "c", "member")]))
    types = spark.createDataFrame([("b", 2, 0), ("a", 2, 2)], "id string, types long, abstract_types long")
    got = {r["id"]: (r["ca"], r["ce"], r["zone"]) for r in metrics.coupling(g.nodes, g.edges, types).collect()}
    assert got == {"a": (0, 1, "useless"), "b": (2, 0, "pain"), "c": (0, 1, "main-sequence"), "d": (0, 0, "isolated")}
    assert [r["id"] for r in metrics.ordered(metrics.coupling(g.nodes, g.edges, types)).collect()][-1] == "d"


def test_resolution(spark):
    n = spark.createDataFrame([("u1", "run(a:)", "method", "M"), ("u2", "run(b:)", "method", "M"), ("u3", "Box", "class", "M"), ("u4", "u3x", "class", "N")], "id string, name string, kind string, module string")
    q = spark.createDataFrame(list(enumerate(["u3", "run", "run(b:)", "M.Box", "Box.run", "none", "none"])), "position int, subject string")
    parents = spark.createDataFrame([("u1", "u3")], "id string, parent string")
    got = {r["position"]: (r["status"], r["candidates"]) for r in lookup.resolve(q, n, parents).collect()}
    assert got == {0: ("found", ["u3"]), 1: ("ambiguous", ["u1", "u2"]), 2: ("found", ["u2"]), 3: ("found", ["u3"]), 4: ("found", ["u1"]), 5: ("notFound", []), 6: ("notFound", [])}


def test_redundant_public(spark):
    rows = [("a", "M", "public"), ("b", "M", "public"), ("c", "M", "public"), ("s", "M", "internal"), ("x", "N", "internal"), ("o", "M", "public")]
    n = spark.createDataFrame([(i, i, "function", m, acc, [], ("f", 1, 1)) for i, m, acc in rows], NODE)
    refs = spark.createDataFrame([("s", "a", "body"), ("x", "b", "body"), ("s", "c", "body"), ("o", "c", "signature"), ("a", "a", "body")], "sourceUSR string, targetUSR string, position string")
    g = Graph(n, edges(spark, []) if False else spark.createDataFrame([], EDGE))
    assert {r["id"] for r in exposure.redundant_public(g, refs, n).collect()} == {"a"}


def test_unused_imports_and_reexports(spark):
    no = [False] * 3
    imports = spark.createDataFrame([(["A"], *no, None, ("f",)), (["B"], *no, None, ("f",)), (["C"], True, False, False, None, ("f",)), (["A"], *no, None, ("g",)), (["Umb"], *no, None, ("h",))], "modulePath array<string>, isConditional boolean, isReexported boolean, isIgnored boolean, fileHasConditionalCompilation boolean, location struct<path:string>")
    usages = spark.createDataFrame([("f", "Own", ["B", "Swift"], False), ("g", "Own", [], True), ("h", "Own", ["Inner"], False)], "path string, owningModule string, referencedModules array<string>, hasUnattributedReferences boolean")
    project = spark.createDataFrame([("A",), ("B",), ("Umb",), ("Inner",)], "module string")
    reexports = spark.createDataFrame([("Umb", "Inner")], "module string, target string")
    got = {(r["path"], r["module"]) for r in exposure.unused_imports(imports, usages, project, reexports).collect()}
    assert got == {("f", "A")}


def test_enum_changes(spark):
    inv = lambda cases, ok=True: spark.createDataFrame([("E", cases, ok)], "enumUSR string, caseUSRs array<string>, complete boolean")
    d = spark.createDataFrame([("E", ["a", "b"], None, "complete", "s1"), ("E", ["a"], ["c"], "complete", "s2")], "enumUSR string, explicitCaseUSRs array<string>, guardedCaseUSRs array<string>, status string, site string")
    got = impact.enum_changes(inv(["a", "b"]), inv(["a", "b", "c"]), d)
    assert [r["site"] for r in got["candidates"].collect()] == ["s1"]
    assert impact.enum_changes(inv(["a"]), inv(["a", "b"], False), d)["issues"].count() == 1


def test_scope_and_outcome(spark):
    f = spark.createDataFrame([("unused-symbol", "error", "m1", ("a", 5, 1), "s1", []), ("unused-symbol", "error", "m2", ("a", 50, 1), "s2", []), ("unused-import", "info", "m3", None, None, []), ("unused-import", "info", "m4", ("b", 1, 1), "s4", []), ("unused-import", "info", "m5", ("c", 1, 1), "s5", [])], "ruleIdentifier string, severity string, message string, location struct<path:string,line:int,column:int>, subject string, details array<string>")
    files = spark.createDataFrame([("a",), ("b",)], "path string")
    ranges = spark.createDataFrame([("a", 1, 9)], "path string, first int, last int")
    assert {r["message"] for r in findings.in_scope(f, files, ranges).collect()} == {"m1", "m3", "m4"}
    assert findings.outcome(f, limit=1).exit_code == 2 and findings.outcome(f, limit=2, strict=True).exit_code == 1 and findings.outcome(f).exit_code == 0
    base = spark.createDataFrame([("unused-import|m3",)], "fingerprint string")
    assert "m3" not in {r["message"] for r in findings.suppress(f, base).collect()}
    assert [r["message"] for r in findings.ordered(f).collect()] == ["m1", "m2", "m4", "m5", "m3"]
    assert findings.bounded(f, ["message"], 2)[1] == 3


def test_property_access_and_parameters(spark):
    g = Graph(nodes(spark, ["p", "q", "f", "r"], p="property", q="property"), spark.createDataFrame([], EDGE))
    acc = spark.createDataFrame([("p", False, True, False), ("q", True, True, False)], "usr string, hasRead boolean, hasWrite boolean, hasAmbiguous boolean")
    assert [r["id"] for r in reach.assign_only(acc, g).collect()] == ["p"]
    par = spark.createDataFrame([("x", "f", False), ("y", "f", None), ("z", "r", False)], "usr string, functionUSR string, isReferenced boolean")
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "id string")
    assert [r["usr"] for r in reach.unused_parameters(par, ids("f", "r"), ids("r")).collect()] == ["x"]
    assert F is not None


def test_nearest_line_keeps_every_priority(spark, tmp_path):
    spark.range(1, 41).selectExpr("id AS o_orderkey", "concat('p', id) AS o_orderpriority").write.parquet(str(tmp_path / "orders.parquet"))
    spark.range(1, 6).selectExpr("id AS s_suppkey").write.parquet(str(tmp_path / "supplier.parquet"))
    got = {r["k"]: r["found"] for r in registry.QUERIES["g029_nearest_line"](spark, str(tmp_path)).collect()}
    marks = {s * 37: s for s in range(1, 6)}
    nearest = {k: min(marks, key=lambda at: (abs(7 * k - at), at)) for k in range(1, 41)}
    assert got == {k: f"{at}:{marks[at]}" for k, at in nearest.items()}
