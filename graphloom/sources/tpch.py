"""A graph view over the star-schema tables of a data directory; natural keys are the ids."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.plans.planner import Graph, Lazy
from graphloom.plans.schema import parse_schema
from graphloom.sources.tables import read

SCHEMA = """
node Region { regionkey: I32 @key  name: String }
node Nation { nationkey: I32 @key  name: String  regionkey: I32 }
node Customer { custkey: I64 @key  name: String  nationkey: I32  acctbal: F64  mktsegment: String }
node Supplier { suppkey: I64 @key  name: String  nationkey: I32  acctbal: F64 }
node Part { partkey: I64 @key  name: String  brand: String  kind: String  size: I32  retailprice: F64  words: [String]? }
node Order { orderkey: I64 @key  custkey: I64  status: String  totalprice: F64  orderdate: DateTime  priority: String }
node Document { docid: I64 @key  text: String?  lang: String?  source: String?  nchars: I64? }
node Vec { vecid: I64 @key  embedding: Vector(64)  label: I32 }
node User { userid: I64 @key }

edge InRegion: Nation -> Region
edge LivesIn: Customer -> Nation
edge BasedIn: Supplier -> Nation
edge Placed: Customer -> Order
edge Contains: Order -> Part { quantity: F64 }
edge Supplies: Supplier -> Part { quantity: F64 }
edge Next: Nation -> Nation
"""


def graph(spark: SparkSession, d: str) -> Graph:
    def node(table: str, key: str, **props: str) -> DataFrame:
        return read(spark, d, table).select(F.col(key).cast("bigint").alias("id"), *[F.expr(e).alias(n) for n, e in props.items()])

    def edge(table: str, src: str, dst: str) -> DataFrame:
        return read(spark, d, table).select(F.xxhash64(src, dst).alias("id"), F.col(src).cast("bigint").alias("src"), F.col(dst).cast("bigint").alias("dst"))

    def line(src: str) -> DataFrame:
        pairs = read(spark, d, "lineitem").groupBy(src, "l_partkey").agg(F.sum("l_quantity").alias("quantity"))
        return pairs.select(F.xxhash64(src, "l_partkey").alias("id"), F.col(src).alias("src"), F.col("l_partkey").alias("dst"), "quantity")

    def following() -> DataFrame:
        n = read(spark, d, "nation").select(F.col("n_nationkey").cast("bigint").alias("src"))
        both = F.explode(F.array_distinct(F.array((F.col("src") + 1) % 25, (F.col("src") * 2) % 25)))
        return n.select("src", both.alias("dst")).select(F.xxhash64("src", "dst").alias("id"), "src", "dst")

    nodes = {
        "Region": lambda: node("region", "r_regionkey", regionkey="r_regionkey", name="r_name"),
        "Nation": lambda: node("nation", "n_nationkey", nationkey="n_nationkey", name="n_name", regionkey="n_regionkey"),
        "Customer": lambda: node("customer", "c_custkey", custkey="c_custkey", name="c_name", nationkey="c_nationkey", acctbal="c_acctbal", mktsegment="c_mktsegment"),
        "Supplier": lambda: node("supplier", "s_suppkey", suppkey="s_suppkey", name="s_name", nationkey="s_nationkey", acctbal="s_acctbal"),
        "Part": lambda: node("part", "p_partkey", partkey="p_partkey", name="p_name", brand="p_brand", kind="p_type", size="p_size", retailprice="p_retailprice", words="split(p_name, ' ')"),
        "Order": lambda: node("orders", "o_orderkey", orderkey="o_orderkey", custkey="o_custkey", status="o_orderstatus", totalprice="o_totalprice", orderdate="o_orderdate", priority="o_orderpriority"),
        "Document": lambda: node("documents", "doc_id", docid="doc_id", text="text", lang="lang", source="source", nchars="n_chars"),
        "Vec": lambda: node("embeddings", "vec_id", vecid="vec_id", embedding="embedding", label="label"),
        "User": lambda: read(spark, d, "events").select(F.col("user_id").alias("id"), F.col("user_id").alias("userid")).distinct(),
    }
    edges = {
        "InRegion": lambda: edge("nation", "n_nationkey", "n_regionkey"),
        "LivesIn": lambda: edge("customer", "c_custkey", "c_nationkey"),
        "BasedIn": lambda: edge("supplier", "s_suppkey", "s_nationkey"),
        "Placed": lambda: edge("orders", "o_custkey", "o_orderkey"),
        "Contains": lambda: line("l_orderkey"),
        "Supplies": lambda: line("l_suppkey"),
        "Next": following,
    }
    def items(src: str) -> DataFrame:
        return read(spark, d, "lineitem").select(F.col(src).alias("src"), F.col("l_partkey").alias("dst"))

    loose = {"Contains": lambda: items("l_orderkey"), "Supplies": lambda: items("l_suppkey")}
    # The keys of these make their pairs unique: one nation per customer, one customer per order, grouped lines.
    return Graph(parse_schema(SCHEMA), Lazy(nodes), Lazy(edges), simple=set(edges), loose=Lazy(loose))
