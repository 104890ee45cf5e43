"""Connected components of an edge table, by alternating large-star and small-star rounds.

No group of edges is ever collected: each round is a partially aggregated minimum per vertex, joined back to the edges.
The minima are checkpointed before the join so that both inputs are plain shuffles and AQE may split a hub's edges.
Every partition first contracts its own edges to stars. Once a counted edge table is small enough for one task, that
same contraction ends the work; it is the same rule (smallest id reachable), so the result does not depend on the path.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from knotwork.session import cut

#: Edges that one task contracts (about 60 MB of arrays); larger tables go through the distributed rounds.
ONE_TASK = 1_000_000


def forest(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All vertices of the edges in order, and each one's smallest reachable vertex."""
    names, at = np.unique(np.concatenate((u, v)), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    root = np.arange(len(names))
    while len(a):
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while (root[root] != root).any():
            root = root[root]
        a, b = root[a], root[b]
        a, b = a[a != b], b[a != b]
    return names, names[root]


def _contract(batches, every: bool = False, most: int = 500_000):
    """Stars (vertex, root) of the edges of one partition. Beyond ``most`` held edges, what is known goes out as edges.

    ``every``: all edges are held, and roots come out too, as their own component.
    """
    held, n = [], 0

    def stars():
        names, root = forest(*(np.concatenate(x) for x in zip(*held, strict=True)))
        return (names, root) if every else (names[names != root], root[names != root])

    for b in batches:
        held.append((b.column(0).to_numpy(), b.column(1).to_numpy()))
        n += b.num_rows
        if n > most and not every:
            u, v = stars()
            held, n = [(u, v)], len(u)
            if 2 * n > most:
                yield pa.record_batch([pa.array(u), pa.array(v)], names=["u", "v"])
                held, n = [], 0
    if n:
        u, v = stars()
        yield pa.record_batch([pa.array(u), pa.array(v)], names=["u", "v"])


def _finish(batches):
    yield from _contract(batches, every=True)


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``(node, component)`` for every vertex of ``edges`` (long ids), component = smallest id reachable.

    Vertices without an edge to another vertex are not returned: the caller knows they stand alone. Null ends, self loops
    and repeated edges are ignored. An empty edge table gives an empty result.
    """
    e = edges.select(F.col(a).cast("long").alias("u"), F.col(b).cast("long").alias("v")).where("u is not null and v is not null and u <> v")
    e = cut(e.mapInArrow(_contract, "u long, v long").distinct())
    seen = None
    while True:
        mark = e.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if mark["n"] <= ONE_TASK:
            return e.coalesce(1).mapInArrow(_finish, "node long, component long")
        if seen == (mark["n"], mark["h"]):
            break
        seen = (mark["n"], mark["h"])
        both = e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = cut(both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m")))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        e = cut(large.distinct())
        down = e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        low = cut(down.groupBy("u").agg(F.min("v").alias("m")))
        hung = down.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        e = cut(hung.union(low.select("u", F.col("m").alias("v"))).distinct())
    stars = e.select(F.greatest("u", "v").alias("node"), F.least("u", "v").alias("component"))
    return stars.union(stars.select("component", "component").distinct())
