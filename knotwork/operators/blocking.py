"""Blocks, and clusters split on contradicting evidence."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from knotwork.operators.clusters import cluster, labels, number, value_clusters
from knotwork.operators.edges import shared_counts
from knotwork.operators.ranks import ordered_codes
from knotwork.session import cut


def identity_blocks(records: DataFrame) -> DataFrame:
    return records.select("block", "rid", F.col("block").cast("string").alias("new_block"))


def feature_blocks(records: DataFrame, feats: DataFrame, features: list[str], th: float = 1) -> DataFrame:
    """Block = type and number of the component over the named features."""
    c = value_clusters(records, feats.where(F.col("feature").isin(features)), th)
    return c.select(F.col("blocking_field").alias("block"), F.col("unique_id").alias("rid"), F.concat_ws("-", "blocking_field", "ClusterID").alias("new_block"))


def deblock(results: DataFrame) -> DataFrame:
    """Clusters of blocks become global codes: the rank of ``block/cluster`` as text, from 0.

    Ranks are taken over the distinct names alone, and joined back.
    """
    name = F.concat_ws("/", F.col("block").cast("string"), F.col("cluster").cast("string"))
    named = results.withColumn("name", name)
    return named.join(ordered_codes(named, "name", "code"), "name").drop("name")


def cutoff_blocks(records: DataFrame, feats: DataFrame, features: list[str], starts: list[int], cutoff: int) -> DataFrame:
    """Blocks peeled off round by round: more features, and for each a falling threshold on the last one alone.

    In every round components of at least ``cutoff`` records become blocks and leave; the last round takes all that is
    left. Blocks are numbered in the order of rounds and of their smallest record, for each type afresh.
    """
    rest, done, round_no = records.select("block", "rid"), [], 0
    for k, feature in enumerate(features):
        earlier = shared_counts(feats.where(F.col("feature").isin(features[:k]))) if k else None
        last = cut(shared_counts(feats.where(F.col("feature") == feature)))
        for th in range(starts[k], 0, -1):
            round_no += 1
            edges = last.where(F.col("weight") >= th).select("block", "src", "dst")
            if earlier is not None:
                edges = edges.union(earlier.select("block", "src", "dst")).distinct()
            alive = rest.select("block", "rid")
            edges = edges.join(alive.withColumnRenamed("rid", "src"), ["block", "src"], "left_semi").join(alive.withColumnRenamed("rid", "dst"), ["block", "dst"], "left_semi")
            low = alive.join(labels(edges.select("block", "src", "dst")), ["block", "rid"], "left").withColumn("low", F.coalesce("low", "rid"))
            final = k == len(features) - 1 and th == 1
            size = low.groupBy("block", "low").agg(F.count("*").alias("n"))
            taken = low.join(size.where(F.col("n") >= (0 if final else cutoff)), ["block", "low"]).select("block", "rid", "low", F.lit(round_no).alias("round"))
            taken = cut(taken)
            done.append(taken)
            rest = cut(rest.join(taken.select("block", "rid"), ["block", "rid"], "left_anti"))
    out = done[0]
    for d in done[1:]:
        out = out.union(d)
    number_ = F.dense_rank().over(Window.partitionBy("block").orderBy("round", "low")) - 1
    return out.select("block", "rid", F.concat_ws("-", "block", number_).alias("new_block"))


def country_blocks(records: DataFrame, feats: DataFrame, features: list[str], country: str, split_above: int = 1000) -> DataFrame:
    """Components over ``features``; those above ``split_above`` records are split by country.

    One code decides. Several: the code whose single-code members are best linked to the record (links by members, ties by
    the alphabet). None: the same over the codes of its neighbours; without any, "00".
    """
    shared = cut(shared_counts(feats.where(F.col("feature").isin(features))))
    c = cluster(records, shared).withColumnsRenamed({"blocking_field": "block", "unique_id": "rid"})
    large = c.groupBy("block", "ClusterID").agg(F.count("*").alias("n")).where(F.col("n") > split_above)
    inside = cut(c.join(large.drop("n"), ["block", "ClusterID"]))
    codes = feats.where(F.col("feature") == country).select("block", "rid", F.col("value").alias("code")).where("code is not null").distinct()
    own = inside.join(codes.groupBy("block", "rid").agg(F.count("*").alias("n_codes"), F.min("code").alias("only")), ["block", "rid"], "left").withColumn("n_codes", F.coalesce("n_codes", F.lit(0)))
    own = cut(own)
    single = own.where("n_codes = 1")
    members = single.groupBy("block", "ClusterID", F.col("only").alias("code")).agg(F.count("*").alias("members"))
    both = shared.select("block", F.col("src").alias("rid"), F.col("dst").alias("other")).union(shared.select("block", "dst", "src"))
    near = own.where("n_codes <> 1").join(both, ["block", "rid"])
    links = near.join(single.select("block", F.col("rid").alias("other"), F.col("only").alias("code")), ["block", "other"]).groupBy("block", "rid", "code").agg(F.count("*").alias("links"))
    options = own.where("n_codes > 1").join(codes, ["block", "rid"]).select("block", "rid", "ClusterID", "code")
    options = options.union(near.where("n_codes = 0").join(codes.withColumnRenamed("rid", "other"), ["block", "other"]).select("block", "rid", "ClusterID", "code").distinct())
    scored = options.join(links, ["block", "rid", "code"], "left").join(members, ["block", "ClusterID", "code"], "left")
    fit = F.coalesce(F.col("links") / F.col("members"), F.lit(0.0))
    best = scored.groupBy("block", "rid").agg(F.min_by("code", F.struct((-fit).alias("f"), "code")).alias("best"))
    at = own.join(best, ["block", "rid"], "left").select("block", "rid", F.when(F.col("n_codes") == 1, F.col("only")).otherwise(F.coalesce("best", F.lit("00"))).alias("code"))
    out = c.join(at, ["block", "rid"], "left")
    base = F.concat_ws("-", "block", "ClusterID")
    return out.select("block", "rid", F.when(F.col("code").isNotNull(), F.concat(base, F.lit("+"), F.col("code"))).otherwise(base).alias("new_block"))


def delete_negative_edges(records: DataFrame, positive: DataFrame, negative: DataFrame) -> DataFrame:
    """Clusters after every positive edge that is also negative is gone."""
    keys = ["block", "src", "dst"]
    return cluster(records, positive.select(*keys).join(negative.select(*keys), keys, "left_anti"))


def colour_component(n: int, positive: np.ndarray, negative: np.ndarray) -> np.ndarray:
    """Colours of one component: greedy over records by falling number of negative edges, equal ones in order.

    Records without a negative edge go to the colour with the highest mean positive edge to those coloured so far.
    """
    degree = (negative > 0).sum(1)
    colour = np.full(n, -1)
    for i in np.argsort(-degree, kind="stable"):
        taken = {colour[j] for j in np.flatnonzero(negative[i] > 0) if colour[j] >= 0}
        colour[i] = next(c for c in range(n + 1) if c not in taken)
    n_colours = int(colour.max()) + 1 if n else 0
    out = np.where(degree > 0, colour, -1)
    for i in np.argsort(-degree, kind="stable"):
        if degree[i] == 0:
            means = [positive[i][out == c].mean() if (out == c).any() else -np.inf for c in range(n_colours)]
            out[i] = int(np.argmax(means))
    return out


def _colour_group(pdf: pd.DataFrame) -> pd.DataFrame:
    nodes = np.unique(np.concatenate((pdf["src"], pdf["dst"])))
    i, j = np.searchsorted(nodes, pdf["src"]), np.searchsorted(nodes, pdf["dst"])
    pos, neg = np.zeros((len(nodes),) * 2), np.zeros((len(nodes),) * 2)
    for a, b in ((i, j), (j, i)):
        np.add.at(pos, (a, b), pdf["pos"].to_numpy())
        np.add.at(neg, (a, b), pdf["neg"].to_numpy())
    np.fill_diagonal(neg, 0)
    return pd.DataFrame({"block": pdf["block"].iloc[0], "rid": nodes, "low": pdf["low"].iloc[0], "colour": colour_component(len(nodes), pos, neg)})


def colour_split(records: DataFrame, positive: DataFrame, negative: DataFrame) -> DataFrame:
    """Components with a negative pair inside are coloured so that no negative pair shares a cluster; others stay.

    Only such components travel to Python, one a group (a component is bounded by its block).
    """
    low = cut(labels(positive))
    a = low.select("block", F.col("rid").alias("src"), F.col("low").alias("low"))
    b = low.select("block", F.col("rid").alias("dst"), F.col("low").alias("low_b"))
    inside = negative.select("block", "src", "dst").join(a, ["block", "src"]).join(b, ["block", "dst"]).where("low = low_b").select("block", "src", "dst", "low", F.lit(0.0).alias("pos"), F.lit(1.0).alias("neg"))
    inside = cut(inside)
    weight = F.col("weight").cast("double") if "weight" in positive.columns else F.lit(1.0)
    links = positive.withColumn("pos", weight).join(a, ["block", "src"]).join(inside.select("block", "low").distinct(), ["block", "low"], "left_semi")
    both = inside.unionByName(links.select("block", "src", "dst", "low", "pos", F.lit(0.0).alias("neg")))
    kind = positive.schema["block"].dataType.simpleString()
    coloured = both.groupBy("block", "low").applyInPandas(_colour_group, f"block {kind}, rid long, low long, colour long")
    first = coloured.groupBy("block", "low", "colour").agg(F.min("rid").alias("new_low"))
    new = coloured.join(first, ["block", "low", "colour"]).select("block", "rid", "new_low")
    merged = low.join(new, ["block", "rid"], "left").select("block", "rid", F.coalesce("new_low", "low").alias("low"))
    return number(records, merged)
