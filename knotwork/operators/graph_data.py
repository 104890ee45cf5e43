"""Records and their values as nodes and links for a graph view."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from knotwork.session import pieces_of, spread


def _indexed(feats: DataFrame, use_features: list[str]) -> DataFrame:
    group = F.coalesce(*[F.when(F.col("feature") == f, F.lit(k)) for k, f in enumerate(use_features)])
    return feats.where(F.col("value").isNotNull()).select("rid", F.trim(F.col("value").cast("string")).alias("id"), group.alias("group")).where("group is not null")


def links(feats: DataFrame, use_features: list[str]) -> DataFrame:
    """``(source, target, value)``: each record and value once, with the number of the first feature that has it."""
    return _indexed(feats, use_features).groupBy(F.col("rid").alias("source"), F.col("id").alias("target")).agg(F.min("group").alias("value"))


def nodes(records: DataFrame, feats: DataFrame, use_features: list[str]) -> DataFrame:
    """``(id, group)``: values by the feature under which the first record has them, and records as a group of their own.

    Of a record and a value with one name, the earlier record's view holds; in one record its values come before itself.
    """
    own = records.select("rid", F.col("rid").cast("string").alias("id"), F.lit(len(use_features)).alias("group"))
    every = _indexed(feats, use_features).select("rid", "id", "group").union(own).withColumn("share", F.pmod(F.hash("rid"), F.lit(64)))
    first = F.min(F.struct("rid", "group")).alias("first")
    every = spread(every, "id", "share", n=pieces_of(every)).groupBy("id", "share").agg(first).select("id", "first.*")  # a value that all records have is a row a share
    return spread(every, "id").groupBy("id").agg(first).select("id", F.col("first")["group"].alias("group"))


def record_graphs(records: DataFrame, feats: DataFrame, use_features: list[str]) -> DataFrame:
    """``(rid, nodes, links)``: each record's own graph, its values in the order of features and then of values."""
    one = _indexed(feats, use_features).distinct().groupBy("rid").agg(F.array_sort(F.collect_list(F.struct("group", "id"))).alias("found"))
    none = F.array().cast("array<struct<group:int,id:string>>")
    r = records.select("rid").join(one, "rid", "left").withColumn("found", F.coalesce("found", none))
    me = F.array(F.struct(F.col("rid").cast("string").alias("id"), F.lit(len(use_features)).alias("group")))
    values = F.transform("found", lambda x: F.struct(x["id"].alias("id"), x["group"].alias("group")))
    return r.select("rid", F.concat(values, me).alias("nodes"), F.transform("found", lambda x: F.struct(F.col("rid").alias("source"), x["id"].alias("target"), x["group"].alias("value"))).alias("links"))
