"""Graph networks without a block's matrix: equal to the dense layer, over several tiles of a block."""

import numpy as np
import pytest

from knotwork.operators import edges, neighbours, numeric, tiles
from knotwork.operators import network_training as nt


@pytest.fixture(autouse=True)
def small_tiles(monkeypatch):
    monkeypatch.setattr(tiles, "TILE", 16)
    monkeypatch.setattr(nt, "TILE", 16)


def made(spark, n=60, seed=4):
    rng = np.random.default_rng(seed)
    x = {i: rng.normal(size=4) for i in range(n)}
    v = spark.createDataFrame([(i % 2, i, x[i].tolist(), i % 3) for i in x], "block long, rid long, vec array<double>, truth long")
    held = [(i % 2, i, f, str(i % m)) for i in x for f, m in (("p", 7), ("q", 25)) if i % 5]
    feats = spark.createDataFrame(held + [(0, 2, "p", None)], "block long, rid long, feature string, value string")
    return x, v, feats


def dense(x, feats, block):
    ids = [i for i in x if i % 2 == block]
    rows = {(r["rid"], r["feature"], r["value"]) for r in feats.collect() if r["value"] is not None}
    own = {i: {k[1:] for k in rows if k[0] == i} for i in ids}
    return ids, np.array([x[i] for i in ids]), np.array([[0 if i == j else len(own[i] & own[j]) for j in ids] for i in ids], float)


def test_means_from_values_and_from_edges(spark):
    x, v, feats = made(spark)
    for links in (feats, edges.graph_edges(v.where("rid < 1"), edges.shared_counts(feats))):
        got = {r["rid"]: r["near"] for r in neighbours.with_near(v, links).collect()}
        assert len(got) == len(x)
        for block in (0, 1):
            ids, vec, a = dense(x, feats, block)
            for i, row in zip(ids, a, strict=True):
                assert (got[i] is None) == (not row.any()) and (got[i] is None or np.allclose(got[i], row @ vec / row.sum()))


def test_a_values_holders_make_no_pairs(spark):
    v = spark.range(3000).selectExpr("1L as block", "id as rid", "array(1D, cast(id as double)) as vec")
    feats = v.selectExpr("block", "rid", "'f' as feature", "'x' as value")
    plan = neighbours.with_near(v, feats)._jdf.queryExecution().optimizedPlan().toString()
    assert "rid < " not in plan
    near = neighbours.with_near(v, feats).where("rid = 0").first()["near"]
    assert np.allclose(near, [1.0, sum(range(1, 3000)) / 2999])


def test_clusters_equal_the_dense_layer(spark):
    x, v, feats = made(spark)
    one = {r["unique_id"]: r["ClusterID"] for r in numeric.graph_network_clusters(v, feats, 0.8, width=8).collect()}
    two = {r["unique_id"]: r["ClusterID"] for r in numeric.hetero_network_clusters(v, feats, 0.8, ["p", "q"], mix=[0.7, 0.3], width=8).collect()}
    for block in (0, 1):
        ids, vec, a = dense(x, feats, block)
        h = numeric.sage_mean(vec, a, *numeric.seeded_weights(4, 8, 7))
        assert [one[i] for i in ids] == numeric.components_of(numeric._cosine(h, h) > 0.8)
        h = sum(s * numeric.sage_mean(vec, dense(x, feats.where(f"feature = '{f}'"), block)[2], *numeric.seeded_weights(4, 8, 7 + k)) for k, (f, s) in enumerate((("p", 0.7), ("q", 0.3))))
        assert [two[i] for i in ids] == numeric.components_of(numeric._cosine(h, h) > 0.8)


def test_training_by_tiles_equals_blocks(spark):
    x, v, feats = made(spark)
    w, losses = nt.train_network(v, feats, epochs=2, rate=0.05, width=8)
    start, loss, pairs, g = numeric.seeded_weights(4, 8, 7), 0.0, 0, 0.0
    for block in (0, 1):
        ids, vec, a = dense(x, feats, block)
        one = nt.block_gradient(vec, a, np.array([i % 3 for i in ids]), start)
        loss, pairs, g = loss + one[0], pairs + one[1], g + np.stack(one[2:])
    assert abs(losses[0] - loss / pairs) < 1e-9 and losses[1] < losses[0]
    first, _ = nt.train_network(v, feats, epochs=1, rate=0.05, width=8)
    assert np.allclose(np.stack(first), np.stack(start) - 0.05 * (g / pairs) / (np.abs(g / pairs) + 1e-8))
