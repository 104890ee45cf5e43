"""Mean vectors of records' neighbours, without a matrix of a block and without the pairs of a value's holders."""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from knotwork.operators.tiles import matrix
from knotwork.session import pieces


def _add_up(batches, keys):
    """Sums of ``n`` and ``total`` of rows with the same keys, which stand together; one group is held at a time."""
    last = None
    for b in batches:
        if not b.num_rows:
            continue
        new = np.zeros(b.num_rows - 1, bool)
        for k in keys:
            new |= pc.not_equal(b.column(k)[1:], b.column(k)[:-1]).to_numpy(zero_copy_only=False)
        at = np.concatenate(([0], np.flatnonzero(new) + 1))
        rows = pa.RecordBatch.from_arrays([b.column(k).take(pa.array(at)) for k in keys], names=keys)
        n, total = np.add.reduceat(b.column("n").to_numpy(), at), np.add.reduceat(matrix(b.column("total"))[0], at)
        if last is not None:
            if last[0].equals(rows.slice(0, 1)):
                n[0], total[0] = n[0] + last[1][0], total[0] + last[2][0]
            else:
                yield _sums(*last)
        if len(at) > 1:
            yield _sums(rows.slice(0, len(at) - 1), n[:-1], total[:-1])
        last = rows.slice(len(at) - 1), n[-1:], total[-1:]
    if last is not None:
        yield _sums(*last)


def _sums(rows: pa.RecordBatch, n: np.ndarray, total: np.ndarray) -> pa.RecordBatch:
    lists = pa.ListArray.from_arrays(np.arange(len(total) + 1, dtype=np.int32) * total.shape[1], total.ravel())
    return pa.RecordBatch.from_arrays([*rows.columns, pa.array(n), lists], names=[*rows.schema.names, "n", "total"])


def summed(rows: DataFrame, *keys: str) -> DataFrame:
    """``(*keys, n double, total array<double>)`` added up by keys: in each partition first, so a frequent key is a row a partition."""
    schema = ", ".join(f"{k} {rows.schema[k].dataType.simpleString()}" for k in keys) + ", n double, total array<double>"
    add = partial(_add_up, keys=list(keys))
    part = rows.select(*keys, F.col("n").cast("double").alias("n"), "total").dropna(subset=list(keys)).sortWithinPartitions(*keys).mapInArrow(add, schema)
    return part.repartition(pieces(rows.sparkSession), *keys).sortWithinPartitions(*keys).mapInArrow(add, schema)


def with_near(records: DataFrame, links: DataFrame, name: str = "near") -> DataFrame:
    """``records(block, rid, vec, ...)`` with the weighted mean of their neighbours' ``vec``; null without a neighbour.

    ``links``: edges ``(block, src, dst, weight)``, or the long feature table, whose shared values count as the weight. For
    the latter each value's vectors are added up once, and a record takes itself out of its values' sums.
    """
    v = records.select("block", "rid", "vec")
    with_count = lambda total, k: F.concat(total, F.array(F.lit(k)))
    if "value" in links.columns:
        f = links.select("block", "rid", "feature", "value").dropna().distinct()
        keys = ["block", "feature", "value"]
        sums = summed(f.join(v, ["block", "rid"]).select(*keys, F.lit(1).alias("n"), F.col("vec").alias("total")), *keys)
        met = f.join(sums.where("n > 1"), keys).select("block", "rid", (F.col("n") - 1).alias("n"), with_count(F.col("total"), 1.0).alias("total"))
    else:
        e = links.select("block", "src", "dst", F.col("weight").cast("double").alias("n"))
        both = e.select("block", F.col("src").alias("rid"), F.col("dst").alias("other"), "n").union(e.where("src <> dst").select("block", "dst", "src", "n"))
        near = both.join(v.withColumnRenamed("rid", "other"), ["block", "other"])
        met = near.select("block", "rid", "n", with_count(F.transform("vec", lambda x: x * F.col("n")), 0.0).alias("total"))
    sums = summed(met, "block", "rid").where("n <> 0")
    own = F.element_at("total", -1)
    mean = F.zip_with(F.slice("total", 1, F.size("total") - 1), F.col("vec"), lambda t, x: (t - own * x) / F.col("n"))
    return records.join(sums, ["block", "rid"], "left").withColumn(name, mean).drop("n", "total")
