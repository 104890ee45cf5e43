"""How the driver tables stand in for records, features and vectors, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from knotwork.session import pieces_of, spread


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def orders(spark, d) -> DataFrame:
    return load(spark, d, "orders").select(F.col("o_custkey").alias("block"), F.col("o_orderkey").alias("rid"))


ITEM_FEATURES = {
    "supplier": ("l_suppkey", "CAST(l_suppkey AS VARCHAR)"),
    "part": ("l_partkey", "CAST(l_partkey AS VARCHAR)"),
    "flag": ("l_returnflag", "l_returnflag"),
    "year": ("year(l_shipdate)", "CAST(year(l_shipdate) AS VARCHAR)"),
}


def item_features(spark, d, *names: str) -> DataFrame:
    """Features of orders from their lines, as the long table."""
    items = load(spark, d, "lineitem")
    o = orders(spark, d)
    n = pieces_of(o.join(items, F.col("rid") == F.col("l_orderkey")))
    joined = spread(o, "rid", n=n).join(spread(items, "l_orderkey", n=n), F.col("rid") == F.col("l_orderkey"))
    structs = [F.struct(F.lit(n).alias("feature"), F.expr(f"CAST({ITEM_FEATURES[n][0]} AS STRING)").alias("value")) for n in names]
    return joined.select("block", "rid", F.explode(F.array(*structs)).alias("x")).select("block", "rid", "x.feature", "x.value").distinct()


ORDERS_SQL = "r AS (SELECT o_custkey AS block, o_orderkey AS rid FROM orders)"


def features_sql(*names: str) -> str:
    parts = [f"SELECT DISTINCT o_custkey AS block, o_orderkey AS rid, '{n}' AS feature, {ITEM_FEATURES[n][1]} AS value FROM orders JOIN lineitem ON o_orderkey = l_orderkey" for n in names]
    return f"f AS ({' UNION '.join(parts)})"


def vectors(spark, d, block: str = "label") -> DataFrame:
    return load(spark, d, "embeddings").select(F.expr(f"CAST({block} AS BIGINT)").alias("block"), F.col("vec_id").alias("rid"), F.col("embedding").cast("array<double>").alias("vec"))


VECTORS_SQL = "v AS (SELECT CAST(label AS BIGINT) AS block, vec_id AS rid, CAST(embedding AS DOUBLE[]) AS vec FROM embeddings)"
COSINE_SQL = "p AS (SELECT a.block, a.rid AS src, b.rid AS dst, list_cosine_similarity(a.vec, b.vec) AS sim FROM v a JOIN v b ON a.block = b.block AND a.rid < b.rid)"
SHARED_SQL = "s AS (SELECT a.block, a.rid AS src, b.rid AS dst, count(*) AS weight FROM f a JOIN f b ON a.block = b.block AND a.feature = b.feature AND a.value = b.value AND a.rid < b.rid GROUP BY ALL)"


def clusters_sql(edges: str = "e", records: str = "r") -> str:
    """CTEs and select that number the components of ``e(block, src, dst)`` over ``r(block, rid)``."""
    return (
        f"w AS (SELECT src AS a, dst AS b FROM {edges} UNION SELECT dst, src FROM {edges}), t AS (SELECT rid AS n, rid AS c FROM {records} UNION SELECT w.b, t.c FROM t JOIN w ON t.n = w.a), "
        f"m AS (SELECT n, min(c) AS low FROM t GROUP BY n), g AS (SELECT {records}.block AS blocking_field, {records}.rid AS unique_id, CAST(dense_rank() OVER (PARTITION BY {records}.block ORDER BY low) - 1 AS BIGINT) AS \"ClusterID\" FROM {records} JOIN m ON {records}.rid = m.n)"
    )
