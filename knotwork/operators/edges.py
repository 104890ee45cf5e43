"""Similarity graphs as edge tables ``(block, src, dst, ...)`` with ``src < dst``.

Every operator takes the long feature table ``(block, rid, feature, value)``, one row per record, feature and value. Pairs
come from an equi-join on (block, feature, value), so records that share nothing never meet.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from knotwork.session import pieces_of, spread


def _held(feats: DataFrame) -> tuple[DataFrame, int]:
    """Distinct known values, dealt by value to partitions that do not grow with the table, and their number."""
    f = feats.select("block", "rid", "feature", "value").where(F.col("value").isNotNull()).distinct()
    n = pieces_of(f)
    return spread(f, "block", "feature", "value", n=n), n


def _pairs(f: DataFrame) -> DataFrame:
    a, b = f.withColumnRenamed("rid", "src"), f.withColumnRenamed("rid", "dst")
    return a.join(b, ["block", "feature", "value"]).where("src < dst")


def shared_stars(feats: DataFrame) -> DataFrame:
    """``(block, src, dst)`` that links every holder of a value with the smallest one: the components of all pairs that share
    a value, from as many edges as there are holders."""
    f = feats.select("block", "rid", "feature", "value").where(F.col("value").isNotNull())
    keys = ["block", "feature", "value"]
    return f.join(f.groupBy(*keys).agg(F.min("rid").alias("src")), keys).where(F.col("rid") > F.col("src")).select("block", "src", F.col("rid").alias("dst"))


def shared_counts(feats: DataFrame, inverse_degree: bool = False, by_feature: bool = False) -> DataFrame:
    """Weight of a pair: number of shared values, or the sum of one over each shared value's holders.

    ``by_feature`` keeps one edge type for each feature. Missing features make no edge.
    """
    keys = ["block", "src", "dst", *(["feature"] if by_feature else [])]
    f, n = _held(feats)
    pairs = _pairs(f)
    if not inverse_degree:
        return spread(pairs.select(*keys), "block", "src", "dst", n=n).groupBy(*keys).agg(F.count("*").alias("weight"))
    degree = f.groupBy("block", "feature", "value").agg(F.count("*").alias("degree"))
    pairs = pairs.join(degree, ["block", "feature", "value"]).select(*keys, "degree")
    return spread(pairs, "block", "src", "dst", n=n).groupBy(*keys).agg(F.sum(1 / F.col("degree")).alias("weight"))


def _sets(feats: DataFrame, feature: str) -> DataFrame:
    return feats.where((F.col("feature") == feature) & F.col("value").isNotNull()).groupBy("block", "rid").agg(F.collect_set("value").alias("vals"))


def _within(sets: DataFrame, test: Column) -> DataFrame:
    a = sets.select("block", F.col("rid").alias("src"), *[F.col(c).alias(f"a_{c}") for c in sets.columns[2:]])
    b = sets.select("block", F.col("rid").alias("dst"), *[F.col(c).alias(f"b_{c}") for c in sets.columns[2:]])
    return a.join(b, "block").where(F.col("src") < F.col("dst")).where(test).select("block", "src", "dst")


def negative_disjoint(feats: DataFrame, feature: str) -> DataFrame:
    """Pairs whose sets of ``feature`` are both known and have nothing in common. Unknown is never different."""
    return _within(_sets(feats, feature), ~F.arrays_overlap("a_vals", "b_vals"))


def negative_gap(feats: DataFrame, feature: str, distance: int) -> DataFrame:
    """Pairs whose numeric ranges of ``feature`` are more than ``distance`` apart. Only the two ends of a range are compared.

    A value that is no number is unknown, and unknown is never different.
    """
    number = F.expr("try_cast(value AS BIGINT)")
    ends = feats.where((F.col("feature") == feature) & F.col("value").isNotNull()).groupBy("block", "rid").agg(F.min(number).alias("lo"), F.max(number).alias("hi")).where("lo is not null")
    return _within(ends, F.greatest(F.col("b_lo") - F.col("a_hi"), F.col("a_lo") - F.col("b_hi")) > distance)


def negative_sum(feats: DataFrame, negators: dict[str, int | None]) -> DataFrame:
    """How many of several negators speak against a pair; ``None`` means disjointness, a number the allowed gap."""
    parts = [negative_disjoint(feats, f) if d is None else negative_gap(feats, f, d) for f, d in negators.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy("block", "src", "dst").agg(F.count("*").alias("weight"))


def override(edges: DataFrame, positive: DataFrame, negative: DataFrame) -> DataFrame:
    """Edges with annotated pairs forced: positive pairs are added first, negative pairs are removed last."""
    keys = ["block", "src", "dst"]
    return edges.select(*keys).union(positive.select(*keys)).distinct().join(negative.select(*keys), keys, "left_anti")


def graph_edges(records: DataFrame, shared: DataFrame) -> DataFrame:
    """``(block, src, dst, weight)`` of a graph that has an edge in every block: one without any gets its smallest record's to itself."""
    first = records.groupBy("block").agg(F.min("rid").alias("rid")).join(shared.select("block").distinct(), "block", "left_anti")
    return shared.select("block", "src", "dst", F.col("weight").cast("double").alias("weight")).union(first.select("block", "rid", "rid", F.lit(1.0)))
