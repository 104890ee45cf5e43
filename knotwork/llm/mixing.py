"""Mixing sources to target weights by entropy balancing.

Documents get the rates closest in entropy to one copy each that meet every source's word target: the convex dual has
one multiplier for each source, and its solution tilts a document's rate exponentially in its size, held between 0 and
the greatest number of copies. Documents of one source and size are alike, so the dual is solved on counts by (source,
size): each Newton step is one distributed aggregation, safeguarded by a bracket. Rates become whole copies by error
diffusion from the largest size to the smallest, which leaves each source's words within a small document of its target.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from knotwork.llm.common import cut, prepare, table, unlike

WEIGHTS, MOST_COPIES, STEPS, TOLERANCE = (5, 2, 1), 3, 40, 1e-6
#: Documents of one source and size that one task ranks. Larger classes are split along the rank's own order, so that the
#: ranks, and with them the copies, do not depend on it.
BUCKET = 1024


def source_targets(sizes: DataFrame, weights=WEIGHTS, most: int = MOST_COPIES) -> DataFrame:
    """``(key, source, source_size, target)`` from ``(key, source, source_size)``, one row a source.

    Sources in code point order (null last) weigh ``weights``, repeating, and share the sum of all sizes. A target stops at
    ``most`` times its source's size; the excess is shared again by weight until none is above. With sources ordered by
    size to weight, those that stop are a prefix, so running sums give the fixed point at once.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    k = F.pmod(F.row_number().over(order) - 1, F.lit(len(weights)))
    weight = F.element_at(F.array(*[F.lit(int(w)) for w in weights]), (k + 1).cast("int")).cast("long")
    s = sizes.withColumn("weight", weight)
    by_ratio = Window.orderBy((F.col("source_size") / F.col("weight")), F.col("key"))
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    s = s.withColumn("held", F.coalesce(F.sum("source_size").over(before), F.lit(0)))
    s = s.withColumn("weight_left", F.sum("weight").over(Window.partitionBy()) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
    s = s.withColumn("all_size", F.sum("source_size").over(Window.partitionBy()))
    s = s.withColumn("unit", (F.col("all_size") - most * F.col("held")) / F.col("weight_left"))
    s = s.withColumn("open", F.col("unit") * F.col("weight") < most * F.col("source_size"))
    s = s.withColumn("level", F.max(F.when(F.col("open"), F.struct(-F.col("held"), F.col("unit")))).over(Window.partitionBy())["unit"])
    top = (most * F.col("source_size")).cast("double")
    return s.select("key", "source", "source_size", F.coalesce(F.least(top, F.col("level") * F.col("weight")), top).alias("target"))


def _newton(hist: DataFrame, goals: DataFrame, most: int) -> DataFrame:
    """``(key, lam)``: the multiplier of each source. Rates are ``least(most, exp(lam * size / mean size))``."""
    state = goals.select("key", "target", "source_size", "mean", F.lit(0.0).alias("lam"), F.lit(-1e6).alias("lo"), F.lit(1e6).alias("hi"), F.lit(False).alias("done"))
    state = cut(state)
    for _ in range(STEPS):
        x = F.col("size") / F.col("mean")
        rate = F.exp(F.least(F.col("lam") * x, F.lit(50.0)))
        words = F.col("n") * F.col("size")
        step = hist.join(state.where("not done"), "key")
        step = step.groupBy("key").agg(F.sum(words * F.least(rate, F.lit(float(most)))).alias("have"), F.sum(F.when(rate < most, words * rate * x).otherwise(0.0)).alias("slope"))
        s = state.join(step, "key", "left")
        miss = F.col("target") - F.col("have")
        lo = F.when(miss > 0, F.greatest("lo", "lam")).otherwise(F.col("lo"))
        hi = F.when(miss < 0, F.least("hi", "lam")).otherwise(F.col("hi"))
        s = s.withColumn("lo", F.when(F.col("have").isNull(), F.col("lo")).otherwise(lo)).withColumn("hi", F.when(F.col("have").isNull(), F.col("hi")).otherwise(hi))
        tried = F.col("lam") + F.greatest(F.lit(-4.0), F.least(F.lit(4.0), miss / F.when(F.col("slope") > 0, F.col("slope"))))
        inside = (tried > F.col("lo")) & (tried < F.col("hi"))
        fallback = F.when((F.col("lo") > -1e6) & (F.col("hi") < 1e6), (F.col("lo") + F.col("hi")) / 2).when(F.col("lo") > -1e6, 2 * F.col("lo") + 1).otherwise(2 * F.col("hi") - 1)
        done = F.col("done") | F.col("have").isNull() | (F.abs(miss) <= TOLERANCE * F.greatest(F.col("target"), F.lit(1.0)))
        lam = F.when(done, F.col("lam")).otherwise(F.when(inside, tried).otherwise(fallback))
        state = cut(s.select("key", "target", "source_size", "mean", lam.alias("lam"), "lo", "hi", done.alias("done")))
        if state.where("not done").isEmpty():
            break
    return state.select("key", "lam")


def _round(most: int):
    def f(pdf: pd.DataFrame) -> pd.DataFrame:
        """One source's sizes, largest first: copies of all documents of a size; what is over or short goes to the next size."""
        pdf = pdf.sort_values("size", ascending=False, kind="stable")
        n, z, rate = pdf["n"].to_numpy(), pdf["size"].to_numpy(), pdf["rate"].to_numpy()
        copies, carry = np.zeros(len(pdf), np.int64), 0.0
        for i in range(len(pdf)):
            if z[i] > 0:
                want = carry + n[i] * z[i] * rate[i]
                copies[i] = min(max(int(np.floor(want / z[i] + 0.5)), 0), most * n[i])
                carry = want - copies[i] * z[i]
        return pd.DataFrame({"key": pdf["key"], "size": z, "n": n, "copies": copies})

    return f


def mix(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights=WEIGHTS, most: int = MOST_COPIES, bucket_size: int = BUCKET) -> DataFrame:
    """One row per input row: ``doc_id, size, source_size, target, taken`` and ``copies`` (0 to ``most``).

    ``size`` counts ``[^\\x20\\x09-\\x0D]+`` (null text: 0); ``taken`` is copies times size. Documents without a word are
    never taken. A null source is a source of its own, last in order. Which of several like-sized documents of a source
    get one copy more is decided by a hash of the id, so reruns agree. Repeated rows count as documents of their own. An
    empty table gives an empty result; other columns are ignored.
    """
    prepare(df.sparkSession)
    words = F.regexp_count(F.coalesce(F.col(text_col).cast("string"), F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")
    source = F.col(source_col).cast("string")
    key = F.concat(F.when(source.isNull(), F.lit("1")).otherwise(F.lit("0")), F.coalesce(source, F.lit("")))
    d = cut(df.select(F.col(id_col).cast("long").alias("doc_id"), key.alias("key"), words.alias("size")))
    hist = cut(d.groupBy("key", "size").agg(F.count("*").alias("n")))
    sums = hist.groupBy("key").agg(F.sum(F.col("n") * F.col("size")).alias("source_size"), F.sum("n").alias("docs"))
    sums = cut(sums.withColumn("source", F.when(F.col("key").startswith("0"), F.substring("key", 2, 2**31 - 1))))
    targets = cut(source_targets(sums.select("key", "source", "source_size"), weights, most).join(sums.select("key", "docs"), "key").withColumn("mean", F.greatest(F.col("source_size") / F.col("docs"), F.lit(1.0))))
    # A target at its bound needs no multiplier: every document is taken that often.
    open_goals = targets.where(F.col("target") < most * F.col("source_size") * (1 - 1e-12))
    lam = _newton(hist.where("size > 0"), open_goals, most)
    rates = hist.join(targets.drop("source"), "key").join(lam, "key", "left")
    rate = F.coalesce(F.least(F.lit(float(most)), F.exp(F.least(F.col("lam") * F.col("size") / F.col("mean"), F.lit(50.0)))), F.lit(float(most)))
    rates = rates.select("key", "size", "n", rate.alias("rate"))
    copies = rates.groupBy("key").applyInPandas(_round(most), "key string, size long, n long, copies long")
    copies = cut(copies.join(targets.select("key", "source_size", "target"), "key"))
    # Ranks within a class go by a hash of the id; a bucket is a range of hashes, so a document's rank is the number of
    # documents in the buckets before its own, and its place there. A hot class is one of many keys of every shuffle.
    place = F.xxhash64(F.lit(13), "doc_id")
    bucket = F.floor((place / float(2**64) + 0.5) * F.ceil(F.col("n") / bucket_size))
    out = cut(d.join(copies, ["key", "size"]).withColumn("place", place).withColumn("bucket", bucket))
    cell = ["key", "size", "bucket"]
    before = Window.partitionBy("key", "size").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)  # one row for each bucket
    cells = out.where(F.col("n") > bucket_size).groupBy(*cell).agg(F.count("*").alias("here")).withColumn("before", F.sum("here").over(before)).drop("here")
    out = out.join(cells, cell, "left").repartition(*cell)
    rank = F.coalesce("before", F.lit(0)) + F.row_number().over(Window.partitionBy(*cell).orderBy("place", "doc_id"))
    base, extra = F.floor(F.col("copies") / F.col("n")), F.col("copies") % F.col("n")
    out = out.withColumn("rank", rank).withColumn("copies", (base + F.when(F.col("rank") <= extra, 1).otherwise(0)).cast("long"))
    return out.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies")


def mixed(df: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """The mix itself: every row of ``df`` as often as it is taken, with its columns. Rows that repeat an id get equal copies."""
    key, copies, copy = unlike(df, "id_taken", "copies", "copy")
    taken = mix(df, id_col, **options).groupBy(F.col("doc_id").alias(key)).agg(F.max("copies").cast("int").alias(copies)).where(F.col(copies) > 0)
    out = df.join(taken, df[id_col].cast("long").eqNullSafe(F.col(key)))
    return out.withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(copies)))).select(*df.columns)


def op4_mixing(spark, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))
