"""Results to files and tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def save(df: DataFrame, path: str, form: str = "parquet", mode: str = "errorifexists", by: list[str] | None = None) -> str:
    if form not in ("parquet", "csv", "json", "orc"):
        raise ValueError(f"unknown format {form}")
    w = df.write.mode(mode).format(form)
    if form == "csv":
        w = w.option("header", True).option("escape", '"')
    if by:
        w = w.partitionBy(*by)
    w.save(path)
    return path


def histogram(df: DataFrame, col: str, low: float, high: float, bins: int) -> DataFrame:
    """Counts per bucket of equal width; values at the upper bound belong to the last bucket, others outside to none."""
    width = (high - low) / bins
    k = F.least(F.floor((F.col(col) - low) / width), F.lit(bins - 1)).cast("long")
    return df.where((F.col(col) >= low) & (F.col(col) <= high)).groupBy(k.alias("bucket")).agg(F.count("*").alias("n"))


def similarities(pairs: DataFrame, results: DataFrame) -> DataFrame:
    """Pairs above the diagonal with both records' clusters."""
    a = results.select(F.col("blocking_field").alias("block"), F.col("unique_id").alias("src"), F.col("ClusterID").alias("cluster_src"))
    b = results.select(F.col("blocking_field").alias("block"), F.col("unique_id").alias("dst"), F.col("ClusterID").alias("cluster_dst"))
    return pairs.join(a, ["block", "src"]).join(b, ["block", "dst"])


def to_process(records: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Records a feature cache does not hold yet."""
    return records.join(done, key, "left_anti")


def with_cached(records: DataFrame, cache: DataFrame, key: str) -> DataFrame:
    """Records with the features that a cache holds for them; the cache's row with the smallest values counts if there are several."""
    names = [c for c in cache.columns if c != key and c not in records.columns]
    one = cache.groupBy(key).agg(F.min(F.struct(*names)).alias("cached"))
    return records.join(one, key, "left").select(*records.columns, *[F.col("cached")[n].alias(n) for n in names])


def append_features(records: DataFrame, path: str, key: str, extract) -> int:
    """Extract features of records that the cache at ``path`` lacks, and append them; how many there were."""
    spark = records.sparkSession
    try:
        done = spark.read.parquet(path).select(key)
    except Exception as e:  # a cache that does not exist yet
        if "PATH_NOT_FOUND" not in str(e):
            raise
        done = None
    new = records if done is None else to_process(records, done, key)
    out = extract(new)
    n = new.count()
    if n:
        out.write.mode("append").parquet(path)
    return n
