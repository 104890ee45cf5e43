"""From records and edges to clusters numbered 0, 1, 2 ... by smallest member in each block."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from knotwork.operators import edges
from knotwork.operators.components import connected_components
from knotwork.session import cut


def labels(links: DataFrame) -> DataFrame:
    """``(block, rid, low)``: the smallest record of each linked record's component; ids of any type that has an order.

    A vertex is a record of a block, so an id that occurs in several blocks links none of them. Vertices are named by a
    64-bit hash for the rounds; a clash between blocks joins nothing, as a component is read within its block.
    """
    e = cut(links.select("block", "src", "dst").where("src is not null and dst is not null"))
    parts = connected_components(e.select(F.xxhash64("block", "src").alias("a"), F.xxhash64("block", "dst").alias("b")))
    nodes = e.select("block", F.col("src").alias("rid")).union(e.select("block", "dst")).distinct()
    nodes = nodes.withColumn("node", F.xxhash64("block", "rid")).join(parts, "node", "left")
    nodes = cut(nodes.select("block", "rid", F.coalesce("component", "node").alias("component")))
    low = nodes.groupBy("block", "component").agg(F.min("rid").alias("low"))
    return nodes.join(low, ["block", "component"]).select("block", "rid", "low")


def number(records: DataFrame, low: DataFrame) -> DataFrame:
    """``(blocking_field, unique_id, ClusterID)`` from each record's component; unlinked records stand alone."""
    r = records.select("block", "rid").join(low, ["block", "rid"], "left").withColumn("low", F.coalesce("low", "rid"))
    rank = F.dense_rank().over(Window.partitionBy("block").orderBy("low")) - 1
    return r.select(F.col("block").alias("blocking_field"), F.col("rid").alias("unique_id"), rank.cast("long").alias("ClusterID"))


def cluster(records: DataFrame, links: DataFrame) -> DataFrame:
    return number(records, labels(links))


def everything_together(records: DataFrame) -> DataFrame:
    return records.select(F.col("block").alias("blocking_field"), F.col("rid").alias("unique_id"), F.lit(0).cast("long").alias("ClusterID"))


def feature_clusters(records: DataFrame, shared: DataFrame, th: float = 1) -> DataFrame:
    """Linked if at least ``th`` values are shared in all."""
    return cluster(records, shared.where(F.col("weight") >= th))


def value_clusters(records: DataFrame, feats: DataFrame, th: float = 1) -> DataFrame:
    """``feature_clusters`` from the long feature table. At ``th`` of one or less any shared value links, and no pairs are made."""
    if 0 < th <= 1:
        return cluster(records, edges.shared_stars(feats))
    return feature_clusters(records, edges.shared_counts(feats), th)


def similarity_clusters(records: DataFrame, pairs: DataFrame, th: float) -> DataFrame:
    """Linked if the similarity is above ``th`` (strictly)."""
    return cluster(records, pairs.where(F.col("sim") > th))


def boosted(pairs: DataFrame, shared: DataFrame, max_energy: float) -> DataFrame:
    """Similarity plus the shared values' share of ``max_energy``, one at most."""
    s = shared.select("block", "src", "dst", F.col("weight").alias("shared"))
    more = F.least(F.coalesce("shared", F.lit(0)).cast("double"), F.lit(float(max_energy))) / float(max_energy)
    return pairs.join(s, ["block", "src", "dst"], "left").select("block", "src", "dst", (F.col("sim") + more).alias("sim"))


def spectral_boosted(pairs: DataFrame, spectral: DataFrame, most: float = 0.65, least: float = -0.25) -> DataFrame:
    """Similarity plus the spectral cosine, which adds ``most`` at most and ``least`` at least."""
    s = spectral.select("block", "src", "dst", "spectral")
    more = F.when(F.col("spectral").isNotNull(), F.greatest(F.least("spectral", F.lit(float(most))), F.lit(float(least)))).otherwise(0.0)
    return pairs.join(s, ["block", "src", "dst"], "left").select("block", "src", "dst", (F.col("sim") + more).alias("sim"))


def components_as_blocks(records: DataFrame, shared: DataFrame, th: float = 1, least: int = 5) -> DataFrame:
    """``(block, rid, part)``: records of components of ``least`` records or more, linked by ``th`` shared values; ``part`` names one."""
    low = labels(shared.where(F.col("weight") >= th)).join(records.select("block", "rid").distinct(), ["block", "rid"], "left_semi")
    parts = low.withColumn("part", F.concat_ws("/", F.col("block").cast("string"), F.col("low").cast("string")))
    return parts.join(parts.groupBy("part").agg(F.count("*").alias("n")).where(F.col("n") >= least), "part").select("block", "rid", "part")


def adaptive_threshold(pairs: DataFrame, records: DataFrame, th: float, step: float = 0.02, above: int = 400) -> DataFrame:
    """Pairs above a threshold that large blocks raise by ``step``."""
    n = records.groupBy("block").agg(F.count("*").alias("n"))
    return pairs.join(n, "block").where(F.col("sim") > F.lit(th) + F.when(F.col("n") > above, step).otherwise(0.0)).drop("n")
