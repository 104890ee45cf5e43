"""A task's share of orders and pairs stays as it is when tables grow: partitions follow what is read."""

from knotwork import session
from knotwork.operators import edges, graph_data
from knotwork.plans import carriers


def test_pieces_follow_the_files(spark, tmp_path):
    spark.range(200000).write.parquet(f"{tmp_path}/t.parquet")
    df = spark.read.parquet(f"{tmp_path}/t.parquet")
    one = session.pieces_of(df, 100000)
    assert one > 4 and session.pieces_of(df.union(df), 100000) >= 2 * one - 1 and session.pieces_of(df) == 1
    assert session.spread(df, "id").rdd.getNumPartitions() == df.rdd.getNumPartitions()
    assert session.spread(df, "id", n=9).rdd.getNumPartitions() == 9
    assert session.pieces_of(session.cut(df.repartition(7))) == 7


def test_features_edges_and_nodes_are_spread(spark, tmp_path, monkeypatch):
    orders = [(i, i % 3) for i in range(40)]
    lines = [(i, i % 7, i % 5, "R") for i in range(40)] + [(i, i % 4, i % 5, "A") for i in range(40)]
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long").write.parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame(lines, "l_orderkey long, l_suppkey long, l_partkey long, l_returnflag string").write.parquet(f"{tmp_path}/lineitem.parquet")
    plain = carriers.item_features(spark, str(tmp_path), "supplier", "part")
    want = sorted(map(tuple, edges.shared_counts(plain).collect())), sorted(map(tuple, edges.shared_counts(plain, inverse_degree=True).collect()))
    nodes = sorted(map(tuple, graph_data.nodes(carriers.orders(spark, str(tmp_path)), plain, ["supplier", "part"]).collect()))
    for m in (carriers, edges, graph_data, session):
        monkeypatch.setattr(m, "pieces_of", lambda df, each=0: 11)
    feats = carriers.item_features(spark, str(tmp_path), "supplier", "part")
    assert feats.rdd.getNumPartitions() == 11 and edges.shared_counts(feats).rdd.getNumPartitions() == 11
    assert (sorted(map(tuple, edges.shared_counts(feats).collect())), sorted(map(tuple, edges.shared_counts(feats, inverse_degree=True).collect()))) == want
    got = graph_data.nodes(carriers.orders(spark, str(tmp_path)), feats, ["supplier", "part"])
    assert got.rdd.getNumPartitions() == 11 and sorted(map(tuple, got.collect())) == nodes


def test_counts_of_terms_need_no_shuffle(spark):
    from knotwork.operators import vectors

    docs = spark.createDataFrame([("s", 1, "Red red apple"), ("s", 2, "red boat")], "block string, rid long, text string")
    terms = vectors.tokens(docs)
    plan = terms.groupBy("block", "rid", "term").count()._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1
    assert len(vectors.tfidf(terms).collect()) == 4
