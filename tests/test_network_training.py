"""Gradients against differences, and training that tells two kinds of records apart."""

import numpy as np
import pytest


def test_gradient_equals_differences():
    from knotwork.operators.network_training import block_gradient

    rng = np.random.default_rng(3)
    x, a = rng.normal(size=(6, 4)), np.triu(rng.integers(0, 3, (6, 6)), 1).astype(float)
    a = a + a.T
    x[2] = 0
    a[2] = a[:, 2] = 0  # a record of zeros without neighbours
    truth, w = np.array([0, 0, 1, 1, 2, 2]), [rng.normal(size=(4, 3)), rng.normal(size=(4, 3))]
    _, pairs, *g = block_gradient(x, a, truth, tuple(w), 0.1)
    assert pairs == 15
    for k in range(2):
        for i in np.ndindex(4, 3):
            up, down = [m.copy() for m in w], [m.copy() for m in w]
            up[k][i] += 1e-6
            down[k][i] -= 1e-6
            want = (block_gradient(x, a, truth, tuple(up), 0.1)[0] - block_gradient(x, a, truth, tuple(down), 0.1)[0]) / 2e-6
            assert abs(g[k][i] - want) < 1e-5


def test_training_lowers_the_loss(spark):
    from knotwork.operators import network_training as nt
    from knotwork.operators.numeric import graph_network_clusters

    rng = np.random.default_rng(5)
    centre = rng.normal(size=(2, 6))
    rows = [(f"b{b}", k, (centre[k % 2] + 0.6 * rng.normal(size=6) + 1.5).tolist(), k % 2) for b in range(6) for k in range(8)] + [("alone", 1, [0.0] * 6, 0)]
    records = spark.createDataFrame(rows, "block string, rid long, vec array<double>, truth long")
    edges = spark.createDataFrame([(f"b{b}", k, k + 2, 1) for b in range(6) for k in range(6)], "block string, src long, dst long, weight long")
    weights, losses = nt.train_network(records, edges, epochs=12, rate=0.05, width=8)
    assert len(losses) == 12 and losses[-1] < 0.5 * losses[0]
    again, _ = nt.train_network(records, edges, epochs=12, rate=0.05, width=8)
    assert np.allclose(weights[0], again[0])
    th = nt.searched_threshold(records, edges, weights, rounds=3)
    best, odd = (nt.threshold_report(records, edges, weights, t).first()["score_to_minimise"] for t in (th, -1.0))
    assert best < odd
    got = graph_network_clusters(records, edges, th, weights=weights)
    assert got.count() == len(rows)
    vec = {(r["block"], r["rid"]): r["vec"] for r in nt.network_embeddings(records, edges, weights).collect()}
    assert len(vec) == len(rows) and all(len(v) == 8 for v in vec.values())
    with pytest.raises(ValueError, match="no records"):
        nt.train_network(records.limit(0), edges)
    assert nt.train_network(records.where("block = 'alone'"), edges, epochs=3)[1] == []
