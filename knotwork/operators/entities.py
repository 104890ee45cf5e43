"""Choosing entities with enough evidence, and finishing data sets that were made from real records."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from knotwork.functions import names, text
from knotwork.operators.ranks import ordered_codes
from knotwork.operators.sampling import draw, share


def selected_entities(mentions: DataFrame, frequency: DataFrame, wanted: int = 1000, least_uris: int = 100, least_commonness: float = 1e-7, every: int = 15, seed: int = 0) -> DataFrame:
    """``(entity, name, total_uri, commonness)`` of entities that gather enough mentions ``(entity, name, day, uri)``.

    Days are taken in a drawn order and looked at ``every`` days at a time. An entity is chosen in the first look at which
    its distinct uris of each day add up to ``least_uris``, if its name is common enough; once a name is chosen, later days
    add nothing to it. The looks end with the first one that has ``wanted`` entities, or with the days. Null uris are not
    counted; of several names of an entity the earliest chosen stays, then the smallest.
    """
    luck = Window.orderBy(draw(F.col("day"), seed), "day")  # one row a day
    days = mentions.select("day").distinct().withColumn("look", F.floor((F.row_number().over(luck) - 1) / every))
    daily = mentions.groupBy("entity", "name", "day").agg(F.countDistinct("uri").alias("n"))
    looks = daily.join(days, "day").groupBy("entity", "name", "look").agg(F.sum("n").alias("n"))
    total = F.sum("n").over(Window.partitionBy("entity", "name").orderBy("look"))  # one row a look
    enough = looks.withColumn("total", total).where(F.col("total") >= least_uris).groupBy("entity", "name").agg(F.min(F.struct("look", "total")).alias("at"))
    common = names.commonness(enough, "name", frequency).where(F.col("commonness") >= least_commonness)
    enough = enough.join(common, "name").select("entity", "name", "commonness", "at.*")
    first = enough.groupBy("name").agg(F.min("look").alias("look"))
    chosen = enough.join(first, ["name", "look"]).groupBy("entity").agg(F.min(F.struct("look", "name", "total", "commonness")).alias("x")).select("entity", "x.*")
    sizes = chosen.groupBy("look").agg(F.count("*").alias("n")).withColumn("so_far", F.sum("n").over(Window.orderBy("look")))  # one row a look
    stop = sizes.where(F.col("so_far") >= wanted).agg(F.min("look").alias("stop"))
    out = chosen.crossJoin(F.broadcast(stop)).where(F.col("stop").isNull() | (F.col("look") <= F.col("stop")))  # one row
    return out.select("entity", "name", F.col("total").alias("total_uri"), "commonness")


def batched(df: DataFrame, key: str, size: int, column: str = "batch") -> DataFrame:
    """``column``: the number of the batch of ``size`` rows that a row falls into, in the order of a unique key."""
    if size < 1:
        raise ValueError("a batch holds one row at least")
    numbered = ordered_codes(df.where(F.col(key).isNotNull()), key, column).withColumn(column, F.floor(F.col(column) / size))
    return df.join(numbered, key)


def with_meta(df: DataFrame, keys: list[str], column: str = "meta") -> DataFrame:
    """``column``: a map of the named columns' texts; without names the rows are unchanged."""
    if not keys:
        return df
    pairs = [x for k in keys for x in (F.lit(k), F.col(k).cast("string"))]
    return df.withColumn(column, F.create_map(*pairs))


def postprocessed(df: DataFrame, real: str = "entity_name", pseudo: str = "pseudo_entity_name", content: str = "content") -> DataFrame:
    """The made-up name becomes the block and stands for the real one in the text; real names are numbered over all blocks (null: -1)."""
    own = df.withColumnsRenamed({real: "original_entity_name", pseudo: "blocking_field"})
    own = own.withColumn(content, text.replace_name(F.col(content), F.coalesce("original_entity_name", F.lit("")), F.col("blocking_field")))
    codes = ordered_codes(own.where("original_entity_name is not null"), "original_entity_name", "ClusterIdGlobal")
    return own.join(codes, "original_entity_name", "left").fillna(-1, ["ClusterIdGlobal"])


def drawn_entities(records: DataFrame, profiles: dict[int, float], mentions: dict[int, float], entities: int = 10, tag: str = "FAKE IDENTITY", attempts: int = 100, seed: int = 0) -> DataFrame:
    """Made-up entities from ``records(entity_name, unique_id, content)``, ids unique: ``(..., pseudo_entity_name, ground_truth)``.

    Numbers of real names and of mentions are drawn with the weights of two histograms, sorted and paired, the larger with
    the larger. Each entity takes the first of ``attempts`` draws of names (without replacement, evenly) whose records
    suffice; an entity without one is an error. A name has a weight from 1 to 10 and mentions are drawn name by name at
    these weights, a record at most once an entity: each name's records arrive one by one after exponential waits at its
    weight's rate, and the earliest are taken. ``ground_truth`` numbers an entity's real names in order.
    """
    rng, spark = np.random.default_rng(seed), records.sparkSession
    def pick(counts):
        weight = np.array(list(counts.values()), float)
        return sorted((int(x) for x in rng.choice(list(counts), entities, p=weight / weight.sum())), reverse=True)

    plan = list(zip(pick(profiles), pick(mentions), strict=True))
    counts = records.where("entity_name is not null").groupBy("entity_name").agg(F.count("*").alias("n"))
    counts = counts.join(ordered_codes(counts, "entity_name", "code"), "entity_name")
    n_names = counts.count()
    if plan[0][0] > n_names:
        raise ValueError(f"{plan[0][0]} names asked for, {n_names} found")
    rows = [(k, m, a, int(c)) for k, (p, m) in enumerate(plan) for a in range(attempts) for c in rng.choice(n_names, p, replace=False)]
    tried = spark.createDataFrame(rows, "k int, mentions int, attempt int, code long").join(counts, "code")  # as many rows as asked for
    rich = tried.groupBy("k", "mentions", "attempt").agg(F.sum("n").alias("n")).where(F.col("n") >= F.col("mentions")).groupBy("k").agg(F.min("attempt").alias("attempt"))
    rich = rich.collect()  # one row an entity
    if len(rich) < entities:
        raise ValueError(f"not enough records for {entities - len(rich)} of {entities} entities in {attempts} attempts")
    first = {r["k"]: r["attempt"] for r in rich}
    chosen = spark.createDataFrame([r for r in rows if r[2] == first[r[0]]], tried.select("k", "mentions", "attempt", "code").schema).join(counts, "code").select("k", "mentions", "entity_name")
    own = records.join(chosen, "entity_name")
    part = lambda *c: F.concat_ws(":", *[F.col(x).cast("string") for x in c])
    turn = Window.partitionBy("k", "entity_name").orderBy(draw(part("k", "unique_id"), seed), "unique_id")
    wait = -F.log(1 - share(part("k", "unique_id"), seed + 1)) / (1 + F.floor(10 * share(part("k", "entity_name"), seed + 2)))
    own = own.withColumn("__turn", F.row_number().over(turn)).where(F.col("__turn") <= F.col("mentions")).withColumn("__at", F.sum(wait).over(turn))
    own = own.withColumn("__place", F.row_number().over(Window.partitionBy("k").orderBy("__at", "unique_id"))).where(F.col("__place") <= F.col("mentions"))
    truth = (F.dense_rank().over(Window.partitionBy("k").orderBy("entity_name")) - 1).cast("long")
    return own.select(*records.columns, F.concat(F.lit(tag), F.col("k").cast("string")).alias("pseudo_entity_name"), truth.alias("ground_truth"))
