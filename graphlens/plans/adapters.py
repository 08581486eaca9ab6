"""The graph over a star schema: regions, nations, customers, orders, suppliers and parts as nodes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _id(prefix: str, column: str):
    return F.concat(F.lit(prefix + ":"), F.col(column).cast("string"))


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, repo, kind, name, path, start_line, end_line, raw_code, summary, docstring, has_embedding, seq."""
    t = lambda n: table(spark, sf_dir, n)
    place = t("nation").join(F.broadcast(t("region")), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", F.col("r_name").alias("repo"), F.concat("r_name", F.lit("/"), "n_name").alias("dir"), "n_name")
    region = t("region").select(_id("r", "r_regionkey").alias("id"), F.col("r_name").alias("repo"), F.lit("repository").alias("kind"), F.col("r_name").alias("name"), F.lit(None).cast("string").alias("path"), F.col("r_regionkey").cast("long").alias("k"))
    nation = place.select(_id("n", "n_nationkey").alias("id"), "repo", F.lit("module").alias("kind"), F.col("n_name").alias("name"), F.col("dir").alias("path"), F.col("n_nationkey").cast("long").alias("k"))
    customer = t("customer").join(F.broadcast(place), F.col("c_nationkey") == F.col("n_nationkey")).select(_id("c", "c_custkey").alias("id"), "repo", F.lit("file").alias("kind"), F.col("c_name").alias("name"), F.concat("dir", F.lit("/"), "c_name").alias("path"), F.col("c_custkey").alias("k"))
    owner = t("customer").join(F.broadcast(place), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "repo", F.concat("dir", F.lit("/"), "c_name").alias("path"))
    order = t("orders").join(owner, F.col("o_custkey") == F.col("c_custkey")).select(_id("o", "o_orderkey").alias("id"), "repo", F.lit("function").alias("kind"), F.concat(F.lit("Order"), F.col("o_orderkey").cast("string")).alias("name"), "path", F.col("o_orderkey").alias("k"))
    supplier = t("supplier").join(F.broadcast(place), F.col("s_nationkey") == F.col("n_nationkey")).select(_id("s", "s_suppkey").alias("id"), "repo", F.lit("class").alias("kind"), F.col("s_name").alias("name"), F.concat("dir", F.lit("/"), "s_name").alias("path"), F.col("s_suppkey").alias("k"))
    part = t("part").join(F.broadcast(t("region")), F.pmod("p_partkey", F.lit(5)) == F.col("r_regionkey")).select(_id("p", "p_partkey").alias("id"), F.col("r_name").alias("repo"), F.lit("type").alias("kind"), F.col("p_name").alias("name"), F.concat(F.lit("parts/"), "p_brand", F.lit("/"), F.col("p_partkey").cast("string")).alias("path"), F.col("p_partkey").alias("k"))
    every = region.unionByName(nation).unionByName(customer).unionByName(order).unionByName(supplier).unionByName(part)
    start = F.pmod(F.col("k"), F.lit(500)).cast("int") + 1
    return every.select(
        "id", "repo", "kind", "name", "path", start.alias("start_line"), (start + F.pmod(F.col("k"), F.lit(40)).cast("int")).alias("end_line"),
        F.when(F.pmod(F.col("k"), F.lit(4)) != 0, F.repeat("name", F.pmod(F.col("k"), F.lit(30)).cast("int"))).alias("raw_code"), F.when(F.pmod(F.col("k"), F.lit(3)) == 0, F.col("name")).alias("summary"),
        F.when(F.pmod(F.col("k"), F.lit(5)) == 0, F.col("name")).alias("docstring"), (F.pmod(F.col("k"), F.lit(2)) == 0).alias("has_embedding"), F.col("k").alias("seq"),
    )


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """source, target, kind, weight, seq: containment down to orders, orders use suppliers, suppliers call parts, customers import suppliers."""
    t = lambda n: table(spark, sf_dir, n)
    both = lambda a, b, kind, seq: (a.alias("source"), b.alias("target"), F.lit(kind).alias("kind"), F.lit(seq).cast("long").alias("seq"))
    contains = (
        t("nation").select(*both(_id("r", "n_regionkey"), _id("n", "n_nationkey"), "contains", 0))
        .unionByName(t("customer").select(*both(_id("n", "c_nationkey"), _id("c", "c_custkey"), "contains", 0)))
        .unionByName(t("orders").select(*both(_id("c", "o_custkey"), _id("o", "o_orderkey"), "contains", 0)))
    )
    line = t("lineitem").select("l_orderkey", "l_partkey", "l_suppkey")
    uses = line.select("l_orderkey", "l_suppkey").distinct()
    out = contains.unionByName(uses.select(*both(_id("o", "l_orderkey"), _id("s", "l_suppkey"), "uses_type", 2)))
    out = out.unionByName(line.select("l_suppkey", "l_partkey").distinct().select(*both(_id("s", "l_suppkey"), _id("p", "l_partkey"), "calls", 1)))
    imports = uses.join(t("orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey")).select("o_custkey", "l_suppkey").distinct()
    return out.unionByName(imports.select(*both(_id("c", "o_custkey"), _id("s", "l_suppkey"), "imports", 1))).withColumn("weight", F.lit(1.0))


#: The same graph in DuckDB.
SQL_NODES = """
place AS (SELECT n_nationkey, n_name, r_name AS repo, r_name || '/' || n_name AS dir FROM nation JOIN region ON n_regionkey = r_regionkey),
cust AS (SELECT c_custkey, c_name, repo, dir || '/' || c_name AS path FROM customer JOIN place ON c_nationkey = n_nationkey),
raw AS (
 SELECT 'r:' || r_regionkey AS id, r_name AS repo, 'repository' AS kind, r_name AS name, NULL AS path, r_regionkey::BIGINT AS k FROM region
 UNION ALL SELECT 'n:' || n_nationkey, repo, 'module', n_name, dir, n_nationkey FROM place
 UNION ALL SELECT 'c:' || c_custkey, repo, 'file', c_name, path, c_custkey FROM cust
 UNION ALL SELECT 'o:' || o_orderkey, repo, 'function', 'Order' || o_orderkey, path, o_orderkey FROM orders JOIN cust ON o_custkey = c_custkey
 UNION ALL SELECT 's:' || s_suppkey, repo, 'class', s_name, dir || '/' || s_name, s_suppkey FROM supplier JOIN place ON s_nationkey = n_nationkey
 UNION ALL SELECT 'p:' || p_partkey, r_name, 'type', p_name, 'parts/' || p_brand || '/' || p_partkey, p_partkey FROM part JOIN region ON p_partkey % 5 = r_regionkey),
nodes AS (SELECT id, repo, kind, name, path, k % 500 + 1 AS start_line, k % 500 + 1 + k % 40 AS end_line, CASE WHEN k % 4 <> 0 THEN repeat(name, k % 30) END AS raw_code,
 CASE WHEN k % 3 = 0 THEN name END AS summary, CASE WHEN k % 5 = 0 THEN name END AS docstring, k % 2 = 0 AS has_embedding, k AS seq FROM raw)"""
SQL_EDGES = """
edges AS (
 SELECT 'r:' || n_regionkey AS source, 'n:' || n_nationkey AS target, 'contains' AS kind FROM nation
 UNION ALL SELECT 'n:' || c_nationkey, 'c:' || c_custkey, 'contains' FROM customer
 UNION ALL SELECT 'c:' || o_custkey, 'o:' || o_orderkey, 'contains' FROM orders
 UNION ALL SELECT DISTINCT 'o:' || l_orderkey, 's:' || l_suppkey, 'uses_type' FROM lineitem
 UNION ALL SELECT DISTINCT 's:' || l_suppkey, 'p:' || l_partkey, 'calls' FROM lineitem
 UNION ALL SELECT DISTINCT 'c:' || o_custkey, 's:' || l_suppkey, 'imports' FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""
SQL_GRAPH = SQL_NODES + "," + SQL_EDGES
