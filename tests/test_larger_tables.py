"""What shows on larger tables: long chains, hot keys, many copies, against DuckDB and by hand."""

import glob
import os
import random
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from weftline.functions.sql_relations import relations_of, sql_relations
from weftline.operators import cycles, impact, ingest, lookup, multiroot, reach
from weftline.operators.graph import Graph
from weftline.plans import stage

LINE = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double"
PART = "p_partkey long, p_name string, p_brand string, p_type string, p_size int"


def chain(spark, to, n, size=1):
    """Parts 0 to n - 1, each followed by the next; every fiftieth is a root of ``_part_reach``."""
    spark.createDataFrame([(k, 2 * k + i, 0, i, 50.0, 1.0) for k in range(n - 1) for i in (0, 1)], LINE).selectExpr("l_orderkey", "l_partkey - l_orderkey AS l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice").write.parquet(f"{to}/lineitem.parquet")
    spark.createDataFrame([(k, f"n{k % 3}", f"b{k % 4}", "t", size) for k in range(n)], PART).write.parquet(f"{to}/part.parquet")


def against_sql(spark, sf, name):
    con = duckdb.connect()
    for t in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"create view {os.path.basename(t)[:-8]} as select * from '{t}/*.parquet'")
    df = entry.queries()[name](spark, str(sf))
    want = con.execute(entry.oracle_sql()[name])
    at = [[d[0] for d in want.description].index(c) for c in df.columns]
    rows = Counter(tuple(r) for r in df.collect())
    assert rows == Counter(tuple(r[i] for i in at) for r in want.fetchall())
    return rows


def test_explain_goes_as_far_as_its_sql(spark, tmp_path):
    chain(spark, tmp_path, 40)
    spark.range(12).selectExpr("id AS s_suppkey").write.parquet(f"{tmp_path}/supplier.parquet")
    rows = against_sql(spark, tmp_path, "g172_explain")
    assert ("p12", "reachable", 12, "p12") in rows and ("p15", "unreachable", None, None) in rows


def test_nearest_keeps_rows_without_a_line_and_runs_no_frame_to_the_end(spark):
    left = spark.createDataFrame([(k, "a", k % 300) for k in range(900)] + [(900, "a", None), (901, "b", 5)], "k int, path string, line int")
    right = spark.createDataFrame([("a", 130, "x"), ("a", 140, "y"), ("a", 7, "z")], "path string, at int, v string")
    df = ingest.nearest(left, right, ["path"], "line", "at", "v")
    by_place = {130: "x", 140: "y", 7: "z"}
    want = {k: by_place[min(by_place, key=lambda at: (abs(k % 300 - at), at))] for k in range(900)}
    assert {r["k"]: r["v"] for r in df.collect()} == want | {900: None, 901: None}
    assert "unboundedfollowing" not in df._jdf.queryExecution().toString().lower()


def test_lifecycle_pairs_are_split_and_not_shuffled(spark, monkeypatch):
    monkeypatch.setattr(impact, "TASK_PAIRS", 50, raising=False)
    tests = [f"t{i}" for i in range(40)]
    hooks = [f"h{i}" for i in range(10)]
    name = {**{t: "testA()" for t in tests}, **{h: "setUp()" for h in hooks}}
    nodes = spark.createDataFrame([(i, n) for i, n in name.items()], "id string, name string")
    # h0 stands in a class and in the one above it; member rows repeat.
    member = [("C", t) for t in tests[:30]] + [("D", t) for t in tests[30:]] + [("B", h) for h in hooks] + [("C", "h0")]
    rows = [(s, t, "member", 1) for s, t in member + member] + [("C", "B", "inheritance", 1)]
    edges = spark.createDataFrame(rows, "source string, target string, kind string, weight long")
    df = impact.lifecycle_edges(nodes, edges, nodes.where("name = 'testA()'"))
    got = [(r["source"], r["target"]) for r in df.collect()]
    assert sorted(got) == sorted((t, h) for t in tests[:30] for h in hooks)
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "RepartitionByExpression [cls" in plan and not plan.lstrip().startswith("Aggregate")


def pairs_of(spark, rows):
    return spark.createDataFrame([(s, t, "call", 1) for s, t in rows], "source string, target string, kind string, weight long")


def test_loops_never_broadcast_by_size_on_disk(spark, monkeypatch):
    monkeypatch.setattr(stage, "FEW_ROWS", 0, raising=False)
    e = spark.createDataFrame([(str(k), str(k + 1)) for k in range(5)], "id string, next string")
    plans = []

    def step(new, known, k):
        found = new.join(e, "id").select(F.col("next").alias("id")).distinct()
        plans.append(found._jdf.queryExecution().executedPlan().toString())
        return found

    rows, _ = stage.semi_naive(spark.createDataFrame([("0",)], "id string"), step, ["id"])
    assert rows.count() == 6
    assert plans and all("SortMergeJoin" in p and "BroadcastHashJoin" not in p for p in plans)


@pytest.mark.parametrize("small", [0, 300_000])
def test_superfluous_ignores_against_one_run_a_unit(spark, small):
    r = random.Random(5)
    n = [f"n{i}" for i in range(14)]
    es = sorted({(r.choice(n), r.choice(n)) for _ in range(14)})
    units = [("a", ["n1", "n2"]), ("b", ["n3"]), ("c", ["n4", "n5"]), ("d", ["n6"]), ("e", ["n7"]), ("f", ["none"])]
    roots = {"n0"} | {m for _, ms in units for m in ms}

    def reached(start):
        known = set(start) & set(n)
        while more := {t for s, t in es if s in known} - known:
            known |= more
        return known

    want, kept = [], set(roots)
    for name, ms in units:
        if set(ms) <= reached(kept - set(ms)):
            want.append(name)
            kept -= set(ms)
    nodes = spark.createDataFrame([(i, "function") for i in n], "id string, kind string")
    got = reach.superfluous_ignores(Graph(nodes, pairs_of(spark, es)), spark.createDataFrame([(i,) for i in sorted(roots)], "id string"), units, small=small)
    assert got == want and 0 < len(want) < len(units)


def test_root_sets_read_their_hops_once(spark):
    read = spark.sparkContext.accumulator(0)

    def seen(row):
        read.add(1)
        return row

    shape = "`from` string, to string, tier int"
    hops = spark.createDataFrame(spark.createDataFrame([(f"v{k}", f"v{k + 1}", 0) for k in range(6)], shape).rdd.map(seen), shape)
    roots = spark.createDataFrame([("v0", 0), ("v3", 1)], "id string, position int")
    got = {(r["vertex"], r["root"]) for r in multiroot.root_sets(hops, roots, 2, local=False).collect()}
    assert got == {(f"v{k}", 0) for k in range(7)} | {(f"v{k}", 1) for k in range(3, 7)}
    assert read.value == 6


def test_what_lies_on_cycles_is_solved_in_one_task_if_it_is_small(spark, monkeypatch):
    plans = []
    keep = stage.Stage.keep
    monkeypatch.setattr(stage.Stage, "keep", lambda self, df: (plans.append(df._jdf.queryExecution().optimizedPlan().toString()), keep(self, df))[1])
    es = [("a", "b"), ("b", "c"), ("c", "a")] + [("c", "x0")] + [(f"x{k}", f"x{k + 1}") for k in range(3)]
    got = {(r["id"], r["component"]) for r in cycles.strong_components(pairs_of(spark, es), small=4).collect()}
    assert got == {("a", "a"), ("b", "a"), ("c", "a")}
    assert any("FlatMapGroupsInPandas" in p for p in plans)


def test_names_that_many_bear_and_many_ask_for(spark, tmp_path):
    part = [(k, f"n{k % 3}" if k < 30 else f"m{k}", f"b{k % 2}", "t", 1) for k in range(60)] + [(60, "n0", "b0", "t", 1)]
    spark.createDataFrame(part, PART).write.parquet(f"{tmp_path}/part.parquet")
    spark.range(40).selectExpr("id AS s_suppkey").write.parquet(f"{tmp_path}/supplier.parquet")
    rows = against_sql(spark, tmp_path, "g060_resolve_names")
    assert {r[2] for r in rows} == {"found", "ambiguous", "notFound"}
    against_sql(spark, tmp_path, "g061_extended_type")
    q = spark.createDataFrame([(0, "n1"), (1, "n1"), (2, "p1"), (3, None), (4, "b0.n0"), (5, "nothing")], "position int, subject string")
    nodes = spark.createDataFrame([(f"p{k}", n, b) for k, n, b, _, _ in part], "id string, name string, module string")
    lists = {r["position"]: (r["status"], len(r["candidates"]), min(r["candidates"], default=None)) for r in lookup.resolve(q, nodes).collect()}
    counts = lookup.resolve_counts(q, nodes)
    assert {r["position"]: (r["status"], r["n"], r["first"]) for r in counts.collect()} == lists
    assert lists[0] == lists[1] == ("ambiguous", 10, "p1") and lists[3] == ("notFound", 0, None)


def test_sql_texts_are_dealt_to_all_cores(spark):
    texts = ["SELECT 1 FROM a, b", None, "", "DELETE FROM c.d"]
    df = relations_of(spark.createDataFrame([(k, texts[k % 4]) for k in range(40)], "k int, sql string").coalesce(1))
    assert df.rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    want = Counter((k, n, at, u) for k in range(40) for found, u in [sql_relations(texts[k % 4])] for n, at in (found or [(None, None)]))
    assert Counter((r["k"], r["name"], r["keyword"], r["unresolved"]) for r in df.collect()) == want
