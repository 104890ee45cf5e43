"""Chosen entities, drawn pairs and finished data sets on small fixtures with odd values."""

import pytest
from pyspark.sql import functions as F


def test_looks_end_with_enough_entities(spark):
    from knotwork.functions.names import token_frequency
    from knotwork.operators.entities import selected_entities
    from knotwork.operators.sampling import draw

    days = [f"2024-01-0{k}" for k in range(1, 7)]
    order = [r["d"] for r in spark.createDataFrame([(d,) for d in days], "d string").orderBy(draw(F.col("d"))).collect()]
    rows = [(1, "ann lee", d, f"u{k}") for d in order for k in range(2)]  # four after the first look of two days
    rows += [(2, "bob ray", order[4], f"v{k}") for k in range(9)]  # the third look
    rows += [(3, "cat fox", order[2], f"w{k}") for k in range(5)]  # the second one
    rows += [(4, "ann lee", order[5], f"x{k}") for k in range(9)]  # the name is taken by then
    rows += [(5, "rare name", order[0], f"y{k}") for k in range(9)] + [(6, None, order[0], "z"), (7, "cat fox", order[0], None)]
    m = spark.createDataFrame(rows, "entity long, name string, day string, uri string")
    freq = token_frequency(spark.createDataFrame([("ann lee",), ("bob ray",), ("cat fox",)], "n string"), "n")
    got = lambda wanted: sorted((r["entity"], r["total_uri"]) for r in selected_entities(m, freq, wanted, 4, 1e-9, 2).collect())
    assert got(1) == [(1, 4)]
    assert got(2) == [(1, 4), (3, 5)]
    assert got(99) == [(1, 4), (2, 9), (3, 5)]
    assert selected_entities(m.limit(0), freq).count() == 0


def test_pairs_are_two_records_of_a_block(spark):
    from knotwork.operators.quality import mean_of, repeated_acceptance, sampled_pairs

    rows = [(b, k, k % 3, k % 2) for b, n in ((0, 1), (1, 2), (2, 17), (3, 40)) for k in range(n)]
    r = spark.createDataFrame(rows, "block long, rid long, truth long, cluster long")
    p = sampled_pairs(r, 0.5, 4).toPandas()
    assert (p["src"] != p["dst"]).all()
    assert p.groupby(["run", "block"]).size().to_dict() == {(run, b): n for run in range(4) for b, n in ((1, 1), (2, 8), (3, 20))}
    assert (p["truth"] == (p["src"] % 3 == p["dst"] % 3)).all() and (p["answer"] == (p["src"] % 2 == p["dst"] % 2)).all()
    assert len({tuple(p[p["run"] == k]["src"]) for k in range(4)}) == 4
    scores = repeated_acceptance(r.withColumn("cluster", F.col("truth")), 0.5, 4).toPandas()
    assert (scores[["accuracy", "precision", "recall", "fscore"]] == 1.0).all().all()
    assert sampled_pairs(r.limit(0)).count() == 0
    m = spark.createDataFrame([(1.0, 1), (4.0, 2), (None, 50), (float("nan"), 50)], "v double, w int")
    assert mean_of(m, "v").first()[0] == 2.5 and mean_of(m, "v", "w").first()[0] == 3.0
    with pytest.raises(ValueError, match="missing columns: x"):
        mean_of(m, "v", "x")


def test_finished_data_sets(spark):
    from knotwork.functions.text import as_utf8
    from knotwork.operators.edges import graph_edges
    from knotwork.operators.entities import batched, postprocessed, with_meta

    rows = [("Zoe Ash", "TAG0", "Met zoe and Ash."), ("Al B.", "TAG1", "al B. said"), (None, "TAG1", "nobody"), ("Zoe Ash", "TAG1", None)]
    got = postprocessed(spark.createDataFrame(rows, "entity_name string, pseudo_entity_name string, content string")).collect()
    assert {(r["blocking_field"], r["content"], r["ClusterIdGlobal"]) for r in got} == {("TAG0", "Met TAG0 and TAG0.", 1), ("TAG1", "TAG1 TAG1 said", 0), ("TAG1", "nobody", -1), ("TAG1", None, 1)}
    df = spark.range(10).withColumn("part", F.lit("x"))
    assert [r["n"] for r in batched(df, "id", 4).groupBy("batch").agg(F.count("*").alias("n")).orderBy("batch").collect()] == [4, 4, 2]
    with pytest.raises(ValueError):
        batched(df, "id", 0)
    assert with_meta(df, []) is df and with_meta(df, ["id", "part"]).first()["meta"] == {"id": "0", "part": "x"}
    odd = spark.sql("select cast(x'616220ff63' as string) as t union all select 'é b' union all select null")
    assert {bytes(r[0]) if r[0] is not None else None for r in odd.select(as_utf8(F.col("t"))).collect()} == {b"abc", "é b".encode(), None}
    records = spark.createDataFrame([("p", 3), ("p", 2), ("q", 1), ("q", 2)], "block string, rid long")
    edges = graph_edges(records, spark.createDataFrame([("q", 1, 2, 5)], "block string, src long, dst long, weight long"))
    assert sorted(map(tuple, edges.collect())) == [("p", 2, 2, 1.0), ("q", 1, 2, 5.0)]


def test_drawn_entities(spark):
    from knotwork.operators.entities import drawn_entities, postprocessed

    rows = [(f"n{k:02}", f"u{k}-{i}", f"n{k:02} text") for k in range(12) for i in range(3 + k)] + [(None, "x", "y")]
    r = spark.createDataFrame(rows, "entity_name string, unique_id string, content string")
    got = drawn_entities(r, {2: 3.0, 3: 1.0}, {5: 1.0, 20: 1.0}, 6).toPandas()
    sizes = got.groupby("pseudo_entity_name").size()
    assert len(sizes) == 6 and set(sizes) <= {5, 20} and list(sizes.sort_index()) == sorted(sizes, reverse=True)
    assert not got.duplicated(["pseudo_entity_name", "unique_id"]).any()
    assert (got.groupby("pseudo_entity_name")["entity_name"].nunique() <= 3).all()
    for _, e in got.groupby("pseudo_entity_name"):
        assert dict(zip(sorted(set(e["entity_name"])), range(9))) == dict(zip(e["entity_name"], e["ground_truth"]))
    assert drawn_entities(r, {2: 3.0, 3: 1.0}, {5: 1.0, 20: 1.0}, 6).toPandas().sort_values(["pseudo_entity_name", "unique_id"]).values.tolist() == got.sort_values(["pseudo_entity_name", "unique_id"]).values.tolist()
    assert set(postprocessed(drawn_entities(r, {1: 1.0}, {3: 1.0}, 2)).toPandas()["content"]) == {"FAKE IDENTITY0 text", "FAKE IDENTITY1 text"}
    with pytest.raises(ValueError, match="not enough records"):
        drawn_entities(r, {1: 1.0}, {99: 1.0}, 2)
    with pytest.raises(ValueError, match="names asked for"):
        drawn_entities(r, {50: 1.0}, {99: 1.0}, 2)


def test_reports_side_by_side(spark):
    from knotwork.operators.quality import METRICS, transposed

    rows = spark.createDataFrame([("a", *[float(k) for k in range(9)]), ("b", *[None] * 9)], "name string, " + ", ".join(f"{m} double" for m in METRICS))
    got = {r["metric"]: (r["a"], r["b"]) for r in transposed(rows).collect()}
    assert got == {m: (float(k), None) for k, m in enumerate(METRICS)}


def test_clusters_of_a_pair_model(spark):
    from knotwork import registry
    from knotwork.operators.learning import pair_classifier

    rows = [("b", k, [10.0 * (k % 2), 1.0]) for k in range(6)] + [("c", 0, [0.0, 1.0])]
    v = spark.createDataFrame(rows, "block string, rid long, vec array<double>")
    ids = range(6)
    pairs = spark.createDataFrame([("b", i, j, int(i % 2 and j % 2)) for i in ids for j in ids if i < j], "block string, src long, dst long, label int")
    build = registry.build({"class": "pair_model", "attributes": {"model": pair_classifier(pairs, v), "th": 0.5}})
    got = {(r["blocking_field"], r["unique_id"]): r["ClusterID"] for r in build(v.select("block", "rid"), None, v).collect()}
    assert len(got) == 7 and len({got["b", k] for k in (1, 3, 5)}) == 1 and len({got["b", k] for k in (0, 1, 2, 4)}) == 4
