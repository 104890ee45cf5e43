"""Samples, splits and generated entities; every draw is a hash of a key and a seed, so reruns agree."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from knotwork.session import unlike


def draw(key: Column, seed: int = 0) -> Column:
    """A hexadecimal text that orders rows at random."""
    return F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")))


def share(key: Column, seed: int = 0) -> Column:
    """A number in [0, 1) from eight hexadecimal digits of the draw."""
    return F.conv(F.substring(draw(key, seed), 1, 8), 16, 10).cast("double") / float(16**8)


def stratified(df: DataFrame, stratum: list[str], key: str, total: int, seed: int = 0) -> DataFrame:
    """About ``total`` rows: from each stratum its share of the rows, rounded."""
    n, n_all, quota, rank, luck = unlike(df, "n_stratum", "n_all", "quota", "rank_in", "luck")
    sizes = df.groupBy(*stratum).agg(F.count("*").alias(n)).crossJoin(F.broadcast(df.agg(F.count("*").alias(n_all))))  # one row
    sizes = sizes.select(*stratum, n, F.floor(F.lit(total) * F.col(n) / F.col(n_all) + 0.5).alias(quota))
    # The first by their draw: only rows whose draw is small can be among them, so few are ranked. The bound leaves more than
    # the quota but for a chance below e^-40; a stratum that it leaves short is ranked as a whole.
    bound = (F.col(quota) + 40 + 10 * F.sqrt(F.col(quota))) / F.col(n)
    d = df.withColumn(luck, share(F.col(key), seed))
    enough = d.join(sizes, stratum).where(F.col(luck) <= bound).groupBy(*stratum, quota).agg(F.count("*").alias(n)).where(F.col(n) >= F.col(quota)).select(*stratum)
    sizes = sizes.join(enough.withColumn(rank, F.lit(True)), stratum, "left").withColumn(n_all, F.when(F.col(rank), bound).otherwise(2.0)).select(*stratum, quota, n_all)
    order = Window.partitionBy(*stratum).orderBy(draw(F.col(key), seed), key)
    out = d.join(sizes, stratum).where(F.col(luck) <= F.col(n_all)).withColumn(rank, F.row_number().over(order))
    return out.where(F.col(rank) <= F.col(quota)).select(*df.columns)


def without_replacement(df: DataFrame, groups: list[str], key: str, ratio: float, seed: int = 0) -> DataFrame:
    """ceil(n * ratio) rows of each group (of all rows if there is none); the ratio lies strictly between 0 and 1."""
    if not 0 < ratio < 1:
        raise ValueError("ratio must lie between 0 and 1")
    by = Window.partitionBy(*[F.col(g) for g in groups]) if groups else Window.partitionBy(F.lit(0))
    order = by.orderBy(draw(F.col(key), seed), key)
    rank, n = unlike(df, "rank_in", "n_group")
    out = df.withColumn(rank, F.row_number().over(order)).withColumn(n, F.count("*").over(by))
    return out.where(F.col(rank) <= F.ceil(F.col(n) * ratio)).select(*df.columns)


def random_births(df: DataFrame, entity: str, key: str, probability: float = 0.1, seed: int = 0, column: str = "DOB") -> DataFrame:
    """A year from 1900 to 2020 for each entity, told on about a ``probability`` of its rows and null on the others."""
    if not 0 <= probability <= 1:
        raise ValueError("probability must lie in 0 to 1")
    year = F.floor(1900 + 121 * share(F.col(entity), seed))
    return df.withColumn(column, F.when(share(F.col(key), seed + 1) < probability, year.cast("double")))


def link_subsample(records: DataFrame, ratio: float, everywhere: bool, block: str = "block", key: str = "rid", seed: int = 0) -> DataFrame:
    """ceil(n * ratio) records of all, or of each block, for clustering them again."""
    return without_replacement(records, [] if everywhere else [block], key, ratio, seed)


def split_by_profile(df: DataFrame, profile: str, valid: float = 0.2, test: float = 0.3, seed: int = 0) -> DataFrame:
    """``split``: all rows of a profile go the same way."""
    s = share(F.col(profile), seed)
    return df.withColumn("split", F.when(s < test, "test").when(s < test + valid, "valid").otherwise("train"))


def group_size_histogram(df: DataFrame, group: str) -> DataFrame:
    return df.groupBy(group).agg(F.count("*").alias("size")).groupBy("size").agg(F.count("*").alias("n_groups"))


def value_shares(df: DataFrame, col: str) -> DataFrame:
    """Each value's share of all rows, null included."""
    counts = df.groupBy(col).agg(F.count("*").alias("n"))
    return counts.withColumn("prob", F.col("n") / F.sum("n").over(Window.partitionBy()))


def generated_entities(records: DataFrame, names: list[str], profiles: list[int], mentions: list[int], seed: int = 0) -> DataFrame:
    """Synthetic entities: the larger number of profiles with the larger number of mentions; each takes real names' records.

    ``records``: (name, unique_id, content). Raises if an entity needs more names or mentions than there are.
    """
    spark = records.sparkSession
    plan = list(zip(sorted(profiles, reverse=True), sorted(mentions, reverse=True), strict=True))
    if any(m < p for p, m in plan):
        raise ValueError("an entity needs a mention for each of its profiles")
    at, rows = 0, []
    for k, (p, m) in enumerate(plan):
        if at + p > len(names):
            raise ValueError("not enough names for the profiles asked for")
        for j in range(p):
            rows.append((f"entity {k}", names[at + j], m // p + (j < m % p), j))
        at += p
    wanted = spark.createDataFrame(rows, "blocking_field string, name string, quota int, profile int")
    rank = F.row_number().over(Window.partitionBy("name").orderBy(draw(F.col("unique_id"), seed), "unique_id"))
    return records.withColumn("__rank", rank).join(F.broadcast(wanted), "name").where(F.col("__rank") <= F.col("quota")).select("blocking_field", "unique_id", "content", "name", F.concat_ws("-", "blocking_field", "profile").alias("true_profile"))
