"""Training of the neighbour-mean layer: gradients of tiles are added up on executors, the two matrices stay on the driver.

Every step is one pass over all pairs of the blocks, tile by tile. What comes back is the loss, the number of pairs and a gradient of the matrices'
size, one row from each partition, added up before they reach the driver; it does not grow with the records.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from knotwork.operators.neighbours import with_near
from knotwork.operators.numeric import bisect_threshold, graph_network_clusters, layered, seeded_weights
from knotwork.operators.quality import block_metrics, report
from knotwork.operators.tiles import AT_ONCE, TILE, dealt, parts
from knotwork.session import cut

SLOPE = 0.01


def block_gradient(x: np.ndarray, adjacency: np.ndarray, truth: np.ndarray, weights: tuple[np.ndarray, np.ndarray], margin: float = 0.0) -> tuple[float, int, np.ndarray, np.ndarray]:
    """Cosine-embedding loss of all pairs of a block, their number, and the gradients of the two matrices.

    Pairs of one truth lose 1 - cosine, others what their cosine exceeds ``margin`` by; a row of zeros is similar to none.
    """
    w_self, w_near = weights
    total = adjacency.sum(1, keepdims=True)
    near = adjacency @ x / np.where(total > 0, total, 1)
    z = x @ w_self + near @ w_near
    h = np.where(z > 0, z, SLOPE * z)
    size = np.linalg.norm(h, axis=1, keepdims=True)
    unit = h / np.where(size > 0, size, 1)
    sim = unit @ unit.T
    same = truth[:, None] == truth[None, :]
    upper = np.triu(np.ones(sim.shape, bool), 1)
    loss = float(np.where(same, 1 - sim, np.maximum(sim - margin, 0))[upper].sum())
    pull = np.where(upper, np.where(same, -1.0, (sim > margin).astype(float)), 0.0)
    d_unit = (pull + pull.T) @ unit
    d_h = np.where(size > 0, (d_unit - unit * (unit * d_unit).sum(1, keepdims=True)) / np.where(size > 0, size, 1), 0)
    d_z = d_h * np.where(z > 0, 1, SLOPE)
    return loss, int(upper.sum()), x.T @ d_z, near.T @ d_z


def _activated(part, weights) -> tuple:
    x, near = part.matrix("vec")[0], part.matrix("near")[0]
    near = near if near.shape[1] else np.zeros_like(x)
    z = x @ weights[0] + near @ weights[1]
    h = np.where(z > 0, z, SLOPE * z)
    size = np.linalg.norm(h, axis=1, keepdims=True)
    return x, near, z, size, h / np.where(size > 0, size, 1)


def _back(side: tuple, d_unit: np.ndarray) -> np.ndarray:
    """The gradients of both matrices from that of one side's unit vectors (linear, so tiles add up)."""
    x, near, z, size, unit = side
    d_h = np.where(size > 0, (d_unit - unit * (unit * d_unit).sum(1, keepdims=True)) / np.where(size > 0, size, 1), 0)
    d_z = d_h * np.where(z > 0, 1, SLOPE)
    return np.concatenate([(x.T @ d_z).ravel(), (near.T @ d_z).ravel()])


def _tile_gradient(a, b, same, weights, margin):
    """``block_gradient`` of one tile, some rows at a time."""
    left = _activated(a, weights)
    right = left if same else _activated(b, weights)
    ta, tb = a.numbers("truth"), b.numbers("truth")
    da, db, loss, pairs, step = np.zeros_like(left[4]), np.zeros_like(right[4]), 0.0, 0, max(1, AT_ONCE // b.n)
    for lo in range(0, a.n, step):
        rows = slice(lo, min(a.n, lo + step))
        sim = left[4][rows] @ right[4].T
        alike = ta[rows, None] == tb
        lost, pull = np.where(alike, 1 - sim, np.maximum(sim - margin, 0)), np.where(alike, -1.0, sim > margin)
        if same:
            upper = np.arange(a.n) > np.arange(rows.start, rows.stop)[:, None]
            lost, pull, pairs = lost * upper, pull * upper, pairs + int(upper.sum())
        else:
            pairs += sim.size
        loss += float(lost.sum())
        da[rows] += pull @ right[4]
        db += pull.T @ left[4][rows]
    return loss, pairs, _back(left, da + db) if same else _back(left, da) + _back(right, db)


def _gradients(batches, weights, margin):
    loss, pairs, total = 0.0, 0, None
    for a, b, same in parts(batches):
        one = _tile_gradient(a, b, same, weights, margin)
        loss, pairs, total = loss + one[0], pairs + one[1], one[2] if total is None else total + one[2]
    if total is not None:
        k = len(total)
        yield pa.record_batch([pa.array(np.arange(k), pa.int64()), pa.array(total), pa.array(np.full(k, loss)), pa.array(np.full(k, pairs), pa.int64())], names=["at", "g", "loss", "pairs"])


def _records(df: DataFrame, *more: str) -> DataFrame:
    return df.select("block", F.col("rid").cast("long").alias("rid"), F.col("vec").cast("array<double>").alias("vec"), *[F.col(m).cast("long").alias(m) for m in more])


def train_network(records: DataFrame, edges: DataFrame, epochs: int = 30, rate: float = 0.01, margin: float = 0.0, width: int = 32, seed: int = 7) -> tuple[tuple[np.ndarray, np.ndarray], list[float]]:
    """The two matrices of the layer and the mean loss of a pair before each step (Adam), from ``records(block, rid, vec, truth)``.

    All blocks take part in every step, tile by tile (``tiles``). ``edges`` may be the long feature table. Blocks of one record have no pair; without any pair the
    matrices stay those of the seed.
    """
    first = records.select(F.size("vec")).first()
    if first is None:
        raise ValueError("no records to train on")
    inputs = first[0]
    w = np.concatenate([x.ravel() for x in seeded_weights(inputs, width, seed)])
    blocks = cut(dealt(with_near(_records(records, "truth"), edges), TILE))
    m, v, losses = np.zeros_like(w), np.zeros_like(w), []
    both = lambda flat: tuple(flat.reshape(2, inputs, width))
    for step in range(1, epochs + 1):
        parts = blocks.mapInArrow(partial(_gradients, weights=both(w), margin=margin), "at long, g double, loss double, pairs long")
        rows = parts.groupBy("at").agg(F.sum("g").alias("g"), F.sum("loss").alias("loss"), F.sum("pairs").alias("pairs")).orderBy("at").collect()  # one row for each weight
        if not rows or not rows[0]["pairs"]:
            break
        g = np.array([r["g"] for r in rows]) / rows[0]["pairs"]
        losses.append(rows[0]["loss"] / rows[0]["pairs"])
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w - rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return both(w), losses


def network_embeddings(records: DataFrame, edges: DataFrame, weights: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """``(block, rid, vec)``: what the layer makes of every record."""
    return layered(with_near(_records(records), edges), [(1.0, "near", weights, 0, 0)])


def threshold_report(records: DataFrame, edges: DataFrame, weights: tuple[np.ndarray, np.ndarray], th: float) -> DataFrame:
    """Mean metrics of the clusters at one threshold, from ``records(block, rid, vec, truth)``; one row."""
    got = graph_network_clusters(records, edges, th, weights=weights).withColumnsRenamed({"blocking_field": "block", "unique_id": "rid", "ClusterID": "cluster"})
    return report(block_metrics(got.join(records.select("block", F.col("rid").cast("long").alias("rid"), "truth"), ["block", "rid"])))


def searched_threshold(records: DataFrame, edges: DataFrame, weights: tuple[np.ndarray, np.ndarray], low: float = 0.0, high: float = 1.0, rounds: int = 8) -> float:
    """The threshold with the least score, by thirds; two jobs a round."""
    return bisect_threshold(lambda th: threshold_report(records, edges, weights, th).first()["score_to_minimise"], low, high, rounds)
