"""Online clustering: the incremental operator over a stream, with the clusters of a block as state."""

from __future__ import annotations

import pickle

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from knotwork.operators.numeric import Centroids

OUT = "blocking_field string, unique_id long, ClusterID long"


def incremental_stream(stream: DataFrame, th: float) -> DataFrame:
    """Each record of ``(block string, rid long, vec array<double>)`` joins the closest centroid of its block or opens a cluster.

    State per block: running means and counts, which grow with clusters and not with records. Records of one micro-batch
    are taken in the order of their ids.
    """
    def step(key, frames, state):
        c = Centroids()
        if state.exists:
            c.mean, c.n = pickle.loads(state.get[0])
        rows = pd.concat(list(frames)).sort_values("rid")
        out = []
        for x in rows["vec"]:
            x = np.asarray(x, float)
            k, sim = c.closest(x)
            if k < 0 or sim < th:
                k = len(c.mean)
            c.add(x, k)
            out.append(k)
        state.update((pickle.dumps((c.mean, c.n)),))
        yield pd.DataFrame({"blocking_field": key[0], "unique_id": rows["rid"].to_numpy(), "ClusterID": out})

    return stream.groupBy("block").applyInPandasWithState(step, OUT, "state binary", "append", "NoTimeout")


def event_counts(stream: DataFrame, ts: str, late: str, width: str, slide: str | None = None, *keys: str) -> DataFrame:
    """Counts in tumbling or sliding windows behind a watermark."""
    return stream.withWatermark(ts, late).groupBy(F.window(ts, width, slide), *keys).agg(F.count("*").alias("n"))
