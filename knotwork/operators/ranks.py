"""Numbers of distinct values in order, without a sort of all of them in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from knotwork.session import cut, unlike


def ordered_codes(values: DataFrame, by: str, code: str) -> DataFrame:
    """``(by, code)``: the distinct values of a column, numbered from 0 in their order.

    Range partitions are numbered apart; what stands in the partitions before is added, from one row a partition. Nulls
    come first, as one value. An empty table gives an empty result.
    """
    part, before, here = unlike(values, "part", "before", "here")
    v = cut(values.select(by).distinct().repartitionByRange(by).withColumn(part, F.spark_partition_id()))
    ahead = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)  # one row a partition
    sizes = v.groupBy(part).agg(F.count("*").alias(here)).select(part, F.coalesce(F.sum(here).over(ahead), F.lit(0)).alias(before))
    rank = F.row_number().over(Window.partitionBy(part).orderBy(by)) - 1
    return v.join(F.broadcast(sizes), part).select(by, (rank + F.col(before)).cast("long").alias(code))
