"""Sources of records and the filters every provider offers. Only declarative plans: Catalyst pushes them into the scans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from knotwork.operators.ranks import ordered_codes
from knotwork.session import unlike

REQUIRED = ("blocking_field", "content", "unique_id", "ground_truth")


def first_per_key(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    rank = unlike(df, "rank_in")[0]
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(rank) == 1).drop(rank)


def checked(df: DataFrame, order: list[Column], ignore_missing: bool = False) -> DataFrame:
    """Records with content, one per (block, id): the first in a stated order. Missing required columns raise."""
    missing = [c for c in REQUIRED if c not in df.columns]
    if missing and not ignore_missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return first_per_key(df.where(F.col("content").isNotNull()), ["blocking_field", "unique_id"], order)


def read_csv(spark: SparkSession, path: str, ignore_missing: bool = False) -> DataFrame:
    df = spark.read.csv(path, header=True, multiLine=True, escape='"')
    return checked(df, [F.col("content")], ignore_missing)


def read_parquet(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    return df.select(*columns) if columns else df


def read_documents(spark: SparkSession, path: str, columns: dict[str, str]) -> DataFrame:
    """JSON documents with nested keys flattened: ``{"out": "a.b.c"}``."""
    return spark.read.json(path).select(*[F.col(src).alias(out) for out, src in columns.items()])


def read_folder(spark: SparkSession, path: str) -> DataFrame:
    """One folder per name and a JSON file per article, with the name from the path."""
    df = spark.read.option("recursiveFileLookup", True).option("multiLine", True).json(path)
    return df.withColumn("name", F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2))


def provide(df: DataFrame, include: list[str] | None = None, exclude: list[str] | None = None, first_names: int | None = None, order: str | None = None, min_length: int | None = None, max_length: int | None = None, block: str = "blocking_field", content: str = "content") -> DataFrame:
    """The filters of a provider: listed blocks (exclusion wins), the first blocks met, content length within bounds. None or 0 is off."""
    out = df
    if include:
        out = out.where(F.col(block).isin(include))
    if exclude:
        out = out.where(~F.col(block).isin(exclude))
    if first_names:
        if order is None:
            raise ValueError("the first names need an order column")
        met = out.groupBy(block).agg(F.min(order).alias("__met")).orderBy("__met", block).limit(first_names)
        out = out.join(met, block, "left_semi")
    if min_length:
        out = out.where(F.length(content) >= min_length)
    if max_length:
        out = out.where(F.length(content) <= max_length)
    return out


def unpivot_pairs(pairs: DataFrame, name: str, first: tuple[str, str], second: tuple[str, str]) -> DataFrame:
    """Annotated pairs as distinct records ``(blocking_field, unique_id, content)``."""
    side = lambda c: pairs.select(F.col(name).alias("blocking_field"), F.col(c[0]).alias("unique_id"), F.col(c[1]).alias("content"))
    return side(first).union(side(second)).distinct()


def overlay_truth(overrides: DataFrame, profiles: DataFrame, mentions: DataFrame) -> DataFrame:
    """Mentions whose source id belongs to an overridden profile, with the profile and its dense code as ground truth.

    ``overrides(profile_id)``, ``profiles(profile_id, source_ids array)``, ``mentions(source_id, ...)``.
    """
    kept = profiles.join(overrides, "profile_id", "left_semi")
    code = ordered_codes(kept, "profile_id", "ground_truth")
    ids = kept.select("profile_id", F.explode("source_ids").alias("source_id")).join(code, "profile_id")
    return mentions.join(ids, "source_id")


def lookup(keys: DataFrame, table: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """Each key with the first row of the table, or nulls: one join in place of batched requests."""
    return keys.join(first_per_key(table, [key], order), key, "left")


def names_within(df: DataFrame, name: str, url: str, least: int, most: int, max_names: int | None = None) -> DataFrame:
    """Records of names that have between ``least`` and ``most`` distinct urls, of at most ``max_names`` names in order."""
    one = first_per_key(df, [name, url], [F.col(url)])
    n = unlike(one, "n_name")[0]
    out = one.withColumn(n, F.count("*").over(Window.partitionBy(name))).where((F.col(n) >= least) & (F.col(n) <= most)).drop(n)
    if max_names:
        out = out.join(out.select(name).distinct().orderBy(name).limit(max_names), name, "left_semi")
    return out


def unique_titles(df: DataFrame, title: str, key: str) -> DataFrame:
    """``(title, key)`` of titles that one record alone has; rows without a title or a key are left out."""
    own = df.where(F.col(title).isNotNull()).groupBy(title).agg(F.min(key).alias(key), F.max(key).alias("__last"))
    return own.where(F.col(key) == F.col("__last")).drop("__last")
