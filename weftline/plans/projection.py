"""The driver's tables as graphs and facts: trade, containment, part sequence, events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators.graph import Graph


def load(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def trade_references(spark: SparkSession, sf: str) -> DataFrame:
    """One row per line item: customer nation -> supplier nation; the return flag is the kind."""
    li = load(spark, sf, "lineitem").select("l_orderkey", "l_suppkey", "l_returnflag", "l_shipdate")
    o = load(spark, sf, "orders").select("o_orderkey", "o_custkey")
    c = load(spark, sf, "customer").select("c_custkey", "c_nationkey")
    s = load(spark, sf, "supplier").select("s_suppkey", "s_nationkey")
    n = load(spark, sf, "nation").select("n_nationkey", "n_name")
    kind = F.when(F.col("l_returnflag") == "A", "call").when(F.col("l_returnflag") == "N", "reference").otherwise("conformance")
    # Fold line items to nation keys first: names join on a few hundred rows.
    keys = li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(c, F.col("o_custkey") == F.col("c_custkey")).join(s, F.col("l_suppkey") == F.col("s_suppkey"))
    folded = keys.groupBy("c_nationkey", "s_nationkey", kind.alias("kind"), F.date_trunc("year", "l_shipdate").alias("year")).agg(F.count("*").alias("weight"))
    a = n.select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("source"))
    b = n.select(F.col("n_nationkey").alias("s_nationkey"), F.col("n_name").alias("target"))
    return folded.join(a, "c_nationkey").join(b, "s_nationkey").select("source", "target", "kind", "year", "weight")


def nation_nodes(spark: SparkSession, sf: str) -> DataFrame:
    n = load(spark, sf, "nation").join(load(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    access = F.when(F.col("n_nationkey") % 3 == 0, "public").otherwise("internal")
    return n.select(
        F.col("n_name").alias("id"), F.col("n_name").alias("name"), F.when(F.col("n_nationkey") % 4 == 0, "protocol").otherwise("class").alias("kind"),
        F.col("r_name").alias("module"), access.alias("accessibility"), F.array().cast("array<string>").alias("attributes"),
        F.struct(F.concat(F.col("r_name"), F.lit("/"), F.col("n_name"), F.lit(".swift")).alias("path"), F.col("n_nationkey").alias("line"), F.lit(1).alias("column")).alias("location"),
    )


TRADE = """trade AS (
  SELECT cn.n_name AS source, sn.n_name AS target, CASE l_returnflag WHEN 'A' THEN 'call' WHEN 'N' THEN 'reference' ELSE 'conformance' END AS kind,
         date_trunc('year', l_shipdate) AS year, count(*)::BIGINT AS weight
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation cn ON c_nationkey = cn.n_nationkey
  JOIN supplier ON l_suppkey = s_suppkey JOIN nation sn ON s_nationkey = sn.n_nationkey GROUP BY ALL),
edges AS (SELECT source, target, kind, sum(weight)::BIGINT AS weight FROM trade GROUP BY ALL),
nodes AS (SELECT n_name AS id, n_nationkey AS k, r_name AS module, CASE WHEN n_nationkey % 4 = 0 THEN 'protocol' ELSE 'class' END AS kind,
                 CASE WHEN n_nationkey % 3 = 0 THEN 'public' ELSE 'internal' END AS accessibility
          FROM nation JOIN region ON n_regionkey = r_regionkey)"""

#: Pairs with over 1.6 times the mean weight: few enough edges for cycles to be interesting.
HEAVY = (
    TRADE
    + """,
pairs AS (SELECT source, target, sum(weight)::BIGINT AS weight FROM edges WHERE source <> target GROUP BY ALL),
heavy AS (SELECT source, target, weight FROM pairs, (SELECT sum(weight) AS total, count(*) AS n FROM pairs) WHERE weight * n * 10 > 16 * total)"""
)


def trade_graph(spark: SparkSession, sf: str) -> Graph:
    from ..operators.graph import merge_edges

    nodes = nation_nodes(spark, sf)
    return Graph(nodes, merge_edges(trade_references(spark, sf), nodes))


def heavy_edges(spark: SparkSession, sf: str) -> DataFrame:
    pairs = trade_graph(spark, sf).edges.where("source <> target").groupBy("source", "target").agg(F.sum("weight").alias("weight"))
    stats = pairs.agg(F.sum("weight").alias("total"), F.count("*").alias("n"))
    # One row of totals beside the pairs of nations.
    out = pairs.join(F.broadcast(stats)).where("weight * n * 10 > 16 * total")
    return out.select("source", "target", F.lit("call").alias("kind"), "weight")


def part_sequence(spark: SparkSession, sf: str, quantity: int = 49) -> DataFrame:
    """part -> next part within an order by line, from line items of at least a quantity; merged edges."""
    li = load(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity")
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    e = li.withColumn("next", F.lead("l_partkey").over(w)).where((F.col("l_quantity") >= quantity) & (F.col("next") != F.col("l_partkey")))
    return e.groupBy(F.concat(F.lit("p"), "l_partkey").alias("source"), F.concat(F.lit("p"), "next").alias("target"), F.lit("call").alias("kind")).agg(F.count("*").alias("weight"))


SEQUENCE = """seq AS (
  SELECT 'p' || l_partkey AS source, 'p' || nxt AS target, count(*)::BIGINT AS weight
  FROM (SELECT l_partkey, l_quantity, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS nxt
        FROM lineitem)
  WHERE l_quantity >= 49 AND nxt <> l_partkey GROUP BY ALL),
parts AS (SELECT 'p' || p_partkey AS id, p_partkey AS k, p_size, p_name, p_brand, p_type FROM part)"""


def part_nodes(spark: SparkSession, sf: str) -> DataFrame:
    p = load(spark, sf, "part")
    return p.select(
        F.concat(F.lit("p"), "p_partkey").alias("id"), F.col("p_name").alias("name"), F.when(F.col("p_size") == 50, "module").otherwise("function").alias("kind"),
        F.col("p_brand").alias("module"), F.lit("internal").alias("accessibility"), F.array().cast("array<string>").alias("attributes"),
        F.struct(F.col("p_type").alias("path"), F.col("p_size").alias("line"), F.lit(1).alias("column")).alias("location"), F.col("p_partkey").alias("k"), F.col("p_size").alias("size"),
    )


def part_graph(spark: SparkSession, sf: str) -> Graph:
    from .stage import Stage

    return Graph(part_nodes(spark, sf), Stage(spark, "parts").keep(part_sequence(spark, sf)))


def containment(spark: SparkSession, sf: str) -> Graph:
    """region > nation > customer as member edges; every fifth customer is an extension of its nation's first."""
    r, n, c = load(spark, sf, "region"), load(spark, sf, "nation"), load(spark, sf, "customer")
    nodes = (
        r.select(F.col("r_name").alias("id"), F.lit("module").alias("kind"))
        .unionByName(n.select(F.col("n_name").alias("id"), F.lit("class").alias("kind")))
        .unionByName(c.select(F.col("c_name").alias("id"), F.when(F.col("c_custkey") % 5 == 0, "extension").otherwise("method").alias("kind")))
    )
    one = lambda df, a, b, k: df.select(F.col(a).alias("source"), F.col(b).alias("target"), F.lit(k).alias("kind"), F.lit(1).cast("long").alias("weight"))
    nr = n.join(r, F.col("n_regionkey") == F.col("r_regionkey"))
    cn = c.join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    edges = one(nr, "r_name", "n_name", "member").unionByName(one(cn.where("c_custkey % 5 <> 0"), "n_name", "c_name", "member")).unionByName(one(cn.where("c_custkey % 5 = 0"), "c_name", "n_name", "extends"))
    # A member of the extension that precedes it.
    inner = c.where("c_custkey % 5 = 1").select(F.concat(F.col("c_name"), F.lit("@")).alias("target"), F.format_string("Customer#%09d", F.col("c_custkey") - 1).alias("source"), F.lit("member").alias("kind"), F.lit(1).cast("long").alias("weight"))
    extra = inner.select(F.col("target").alias("id"), F.lit("method").alias("kind"))
    return Graph(nodes.unionByName(extra), edges.unionByName(inner.select("source", "target", "kind", "weight")))


CONTAINMENT = """cnodes AS (
  SELECT r_name AS id, 'module' AS kind FROM region UNION ALL SELECT n_name, 'class' FROM nation
  UNION ALL SELECT c_name, CASE WHEN c_custkey % 5 = 0 THEN 'extension' ELSE 'method' END FROM customer
  UNION ALL SELECT c_name || '@', 'method' FROM customer WHERE c_custkey % 5 = 1),
cedges AS (
  SELECT r_name AS source, n_name AS target, 'member' AS kind FROM nation JOIN region ON n_regionkey = r_regionkey
  UNION ALL SELECT n_name, c_name, 'member' FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_custkey % 5 <> 0
  UNION ALL SELECT c_name, n_name, 'extends' FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_custkey % 5 = 0
  UNION ALL SELECT printf('Customer#%09d', c_custkey - 1), c_name || '@', 'member' FROM customer WHERE c_custkey % 5 = 1),
parent AS (
  SELECT m.target AS id, CASE WHEN n.kind = 'extension' THEN coalesce(x.target, m.source) ELSE m.source END AS parent
  FROM (SELECT target, min(source) AS source FROM cedges WHERE kind = 'member' GROUP BY target) m LEFT JOIN cnodes n ON n.id = m.source
  LEFT JOIN (SELECT source, min(target) AS target FROM cedges WHERE kind = 'extends' GROUP BY source) x ON x.source = m.source)"""
