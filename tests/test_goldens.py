"""Known inputs and results of the operators."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from knotwork.functions import names, profiles, text
from knotwork.operators import blocking, clusters, edges, numeric, quality, sampling, vectors
from knotwork.operators.components import connected_components
from knotwork.sources import providers

PEOPLE = {0: {"PERSON": ["john", "peter", "flow"], "ORG": ["apple", "netflix", "amazon"]}, 1: {"PERSON": ["apple", "flow", "kl"], "ORG": ["apple"]}, 2: {"PERSON": ["flow"], "ORG": ["netflix", "amazon"]}}


def long_table(spark, records):
    rows = [("b", rid, f, str(v)) for rid, fs in records.items() for f, vs in fs.items() for v in vs]
    return spark.createDataFrame(rows, "block string, rid long, feature string, value string")


def weights(df, *more):
    return {tuple(r[c] for c in ("src", "dst", *more)): r["weight"] for r in df.collect()}


def test_shared_values(spark):
    f = long_table(spark, PEOPLE)
    assert weights(edges.shared_counts(f)) == {(0, 1): 2, (0, 2): 3, (1, 2): 1}
    assert weights(edges.shared_counts(f, by_feature=True), "feature") == {(0, 1, "PERSON"): 1, (0, 2, "PERSON"): 1, (1, 2, "PERSON"): 1, (0, 1, "ORG"): 1, (0, 2, "ORG"): 2}


@pytest.mark.parametrize(
    ("sets", "distance", "entries"),
    [
        ([[1992], [1993, 1994], [1995]], 1, 2), ([range(1992, 1997), [1992]], 0, 0), ([range(1992, 1997), [1994]], 0, 0), ([range(1992, 1997), [1996]], 0, 0), ([range(1992, 1997), [1999]], 0, 2),
        ([range(1992, 1995), [1995, 1996]], 0, 2), ([["FR", "GR"], ["FR"]], None, 0), ([["FR", "GR"], ["FR"], ["GR"]], None, 2), ([["FR", "GR"], ["FR"], []], None, 0),
    ],
)
def test_negative_edges(spark, sets, distance, entries):
    f = long_table(spark, {i: {"f": list(v)} for i, v in enumerate(sets)})
    got = edges.negative_disjoint(f, "f") if distance is None else edges.negative_gap(f, "f", distance)
    assert 2 * got.count() == entries


def test_cosine_boost(spark):
    v = spark.createDataFrame([("b", 0, [1.0, 0.0, 2.0]), ("b", 1, [2.0, 0.0, 0.0])], "block string, rid long, vec array<double>")
    pairs = vectors.dense_cosine(v)
    assert round(pairs.first()["sim"], 2) == 0.45
    shared = edges.shared_counts(long_table(spark, {0: {"LOC": ["Toronto", "Michigan "]}, 1: {"LOC": ["Toronto", "Michigan"]}}))
    assert round(clusters.boosted(pairs, shared, 30).first()["sim"], 2) == 0.48


QUALITY = [("Some Name", 1, 1), ("Some Name", 2, 2), ("Some Name", 2, 3), ("Some Name", 3, 1), ("Some Name", 4, 4), ("Some Name", 4, 4), ("Some Name", 4, 5), ("Some OTHER Name", 1, 1), ("Some OTHER Name", 2, 2)]


def test_quality(spark):
    j = spark.createDataFrame(QUALITY, "block string, truth int, cluster int")
    m = quality.block_metrics(j)
    a, b = m.orderBy("blocking_field").collect()
    assert tuple(a)[1:] == (0.84, 0.7, 0.76, 7, 0.2, 0.8, 2.0, 5, 4, 5.4)
    assert tuple(b)[1:] == (1.0, 1.0, 1.0, 2, 0.0, 0.0, 0.0, 2, 2, 0.0)
    assert tuple(quality.report(m).first()) == (0.92, 0.85, 0.88, 0.1, 0.4, 1.0, 3.5, 3.0, 2.7)
    flags = {r["cluster"]: (r["support"], r["is_under"], r["is_over"]) for r in quality.cluster_flags(j).where("block = 'Some Name'").collect()}
    assert flags == {1: (2, False, True), 2: (1, True, False), 3: (1, True, False), 4: (1, True, False), 5: (1, True, False)}


def test_improvements(spark):
    r = spark.createDataFrame([("a", *[1.0] * 8, 0.0), ("b", *[2.0] * 8, 3.0)], "name string, " + ", ".join(f"{m} double" for m in quality.METRICS))
    got = {(x["name"], x["metric"]): x["ratio"] for x in quality.improvements(r, "a").collect()}
    assert got["b", "oc"] == 2 and got["b", "score_to_minimise"] == float("inf") and np.isnan(got["a", "score_to_minimise"])


def test_components_and_numbers(spark):
    rng = np.random.default_rng(3)
    pairs = [(int(a), int(b)) for a, b in rng.integers(0, 300, (220, 2))] + [(1000 + k, 1001 + k) for k in range(40)]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame([*pairs, (5, 5), (None, 3)], "a long, b long")).collect()}
    low = {x: x for p in pairs for x in p}
    for _ in range(60):
        for a, b in pairs:
            low[a] = low[b] = min(low[a], low[b])
    assert got == {k: v for k, v in low.items() if any(k in p and p[0] != p[1] for p in pairs)}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0
    recs = spark.createDataFrame([("x", 3), ("x", 1), ("x", 2), ("y", 9)], "block string, rid long")
    out = clusters.cluster(recs, spark.createDataFrame([("x", 2, 3)], "block string, src long, dst long"))
    assert {r["unique_id"]: r["ClusterID"] for r in out.collect()} == {1: 0, 2: 1, 3: 1, 9: 0}


def test_annotations(spark):
    recs = spark.createDataFrame([("b", 0), ("b", 1), ("b", 2)], "block string, rid long")
    e = "block string, src long, dst long"
    every, none = spark.createDataFrame([("b", 0, 1), ("b", 0, 2), ("b", 1, 2)], e), spark.createDataFrame([], e)
    ids = lambda x: [r["ClusterID"] for r in clusters.cluster(recs, x).orderBy("unique_id").collect()]
    assert ids(edges.override(every, none, every)) == [0, 1, 2]
    assert ids(edges.override(none, every, none)) == [0, 0, 0]
    assert ids(edges.override(every, every.where("dst = 1"), every.where("dst = 2"))) == [0, 0, 1]


@pytest.mark.parametrize(
    ("pos", "neg", "colours"),
    [(np.ones((7, 7)), np.ones((7, 7)) - np.eye(7), list(range(7))), (np.ones((7, 7)), np.zeros((7, 7)), [0] * 7), (np.array([[0, 1, 2], [1, 0, 1], [2, 1, 0]]), np.array([[0, 1, 0], [1, 0, 0], [0, 0, 0]]), [0, 1, 0]), (np.ones((3, 3)), np.array([[0, 1, 1], [1, 0, 0], [1, 0, 0]]), [0, 1, 1])],
)
def test_colouring(pos, neg, colours):
    assert blocking.colour_component(len(pos), pos, neg).tolist() == colours


def test_country_and_blocks(spark):
    f = long_table(spark, {0: {"f": [1, 2, 3]}, 1: {"f": [2, 3, 4]}, 2: {"f": [11, 22, 33]}})
    recs = f.select("block", "rid").distinct()
    got = {r["rid"]: r["new_block"] for r in blocking.feature_blocks(recs, f, ["f"]).collect()}
    assert got == {0: "b-0", 1: "b-0", 2: "b-1"}
    d = blocking.deblock(spark.createDataFrame([(0, "person-0", 0), (1, "person-0", 0), (2, "person-1", 0), (3, "vessel-0", 0)], "rid int, block string, cluster int"))
    assert [r["code"] for r in d.orderBy("rid").collect()] == [0, 0, 1, 2]
    links = {0: ["a", "b", "c"], 3: ["a"], 4: ["b"], 7: ["c"], 8: ["c"], 1: ["z"], 2: ["z"], 5: ["a"]}
    codes = {1: ["UK"], 2: ["UK"], 3: ["GR"], 4: ["GR"], 5: ["GR"], 7: ["AL"], 8: ["AL"], 0: ["AL", "UK"]}
    f = long_table(spark, {k: {"f": v, "cc": codes.get(k, [])} for k, v in links.items()})
    got = {r["rid"]: r["new_block"] for r in blocking.country_blocks(f.select("block", "rid").distinct(), f, ["f"], "cc", 3).collect()}
    assert got[0].endswith("+AL") and got[3].endswith("+GR") and "+" not in got[1]


def test_cutoff_blocks(spark):
    values = [1, 1, 1, 1, 2, 2, 2, 3, 4, 5]
    f = long_table(spark, {i: {"f": [v]} for i, v in enumerate(values)})
    got = {r["rid"]: r["new_block"] for r in blocking.cutoff_blocks(f.select("block", "rid").distinct(), f, ["f"], [1], 3).collect()}
    assert len({got[i] for i in range(4)}) == 1 and len(set(got.values())) == 5


def test_incremental():
    c = numeric.Centroids()
    c.add(np.array([1, 2, 3]), 0), c.add(np.array([3, 4, 5]), 0)
    assert c.mean[0].tolist() == [2, 3, 4]
    groups = [([1, 2, 3], [2, 0, 0]), ([7, 8, 9], [10, 11, 12]), ([13, 14, 15], [16, 17, 18])]
    near, mean, x = numeric.Points(), numeric.Centroids(), np.array([5.2, 6.18, 17.9])
    for k, g in enumerate(groups):
        for p in g:
            near.add(np.array(p), k), mean.add(np.array(p), k)
    cos = lambda a, b: float(np.dot(a, b) / np.linalg.norm(a) / np.linalg.norm(b))
    best = max(((cos(x, p), -k) for k, g in enumerate(groups) for p in g))
    assert near.closest(x)[0] == -best[1] and abs(near.closest(x)[1] - best[0]) < 1e-9
    best = max((cos(x, np.mean(g, 0)), -k) for k, g in enumerate(groups))
    assert mean.closest(x)[0] == -best[1] and abs(mean.closest(x)[1] - best[0]) < 1e-9
    many, rng = numeric.Points(), np.random.default_rng(1)
    rows = rng.normal(size=(70, 5))
    for k, p in enumerate(rows):
        many.add(p, k)
    assert all(many.closest(p)[0] == k for k, p in enumerate(rows))


def test_fast_rp_is_invariant():
    a = np.array([[0, 1, 0.5], [1, 0, 0], [0.5, 0, 0]])
    p = [2, 0, 1]
    one, two = numeric.fast_rp(a, ["x", "y", "z"]), numeric.fast_rp(a[np.ix_(p, p)], ["z", "x", "y"])
    assert np.allclose(one[np.ix_(p, p)], two)


def test_profiles(spark):
    one = lambda c, **cols: spark.createDataFrame([tuple(v for v, _ in cols.values())], ", ".join(f"{k} {t}" for k, (_, t) in cols.items())).select(c).first()[0]
    births = "array<struct<min_date:string,max_date:string>>"
    days = [("1959-01-01", "1959-12-31"), ("1960-03-31", "1960-03-31"), ("1958-04-29", "1958-04-29")]
    assert one(profiles.years_of_birth(F.col("b")), b=(days, births)) == [1958, 1959, 1960]
    assert one(profiles.birth_days(F.col("b")), b=(days, births)) == ["1958-04-29", "1960-03-31"]
    odd = [("1967-01-01", "1967-31-12"), ("1968-01-01", "1968-12-31"), ("1969-01-01", "1971-01-01")]
    assert one(profiles.known_years(F.col("b")), b=(odd, births)) == ["1967", "1968", "1969", "1971"]
    a, b = (one(names.father_phonetic(F.col("n")), n=(x, "string")) for x in ("Tariq Aziz s/o Karim Yousef", "Tariq Aziz s/o Yusuf Kareem"))
    assert a == b and a
    assert one(names.name_tokens(F.col("n")), n=("Captain of René-Lévy", "string")) == ["captain", "levy", "rene"]
    assert one(names.token_pairs(F.array(F.lit("a"), F.lit("b"), F.lit("c"))), x=(1, "int")) == ["a+b", "a+c", "b+c"]
    assert profiles.organisation_alias("Acme (Best) 99") == ["99+acme", "best"]


def test_texts(spark):
    df = spark.createDataFrame([("http://a.b:80/x?q", "Here walks Dora. She hums. Nobody else came. The end.", "Mr. F meets f and Frank")], "url string, t string, n string")
    r = df.select(text.url_domain(F.col("url")), text.strip_tags(F.lit("<b>x</b> <<<<y")), text.replace_name(F.col("n"), F.lit("F"), "X"), text.times_in(F.lit("at 5:30 PM and 7pm"))).first()
    assert r[0] == ["a.b:80"] and r[1] == "x <<<<y" and r[2] == "Mr. X meets X and Frank" and r[3] == ["17:30:00", "19:00:00"]
    sel = text.selected_text(df.withColumn("name", F.lit("Dora")), ["url"], "t", "name").first()["selected"]
    assert sel == "Here walks Dora. She hums."


def test_sources_and_samples(spark):
    df = spark.createDataFrame([("A", "x", "1", 0), ("A", "y", "1", 0), ("B", None, "2", 0), ("D", "long text", "3", 1)], "blocking_field string, content string, unique_id string, ground_truth int")
    assert providers.checked(df, [F.col("content")]).count() == 2
    with pytest.raises(ValueError):
        providers.checked(df.drop("ground_truth"), [F.col("content")])
    assert providers.provide(df, include=["A", "D"], exclude=["D"]).count() == 2
    n = spark.range(9).withColumn("g", F.when(F.col("id") < 7, 0).otherwise(1))
    assert sampling.without_replacement(n, ["g"], "id", 0.5).groupBy("g").count().orderBy("g").collect() == [(0, 4), (1, 1)]
    assert sampling.without_replacement(n, [], "id", 0.5).count() == 5
    with pytest.raises(ValueError):
        sampling.without_replacement(n, [], "id", 1.0)
    with pytest.raises(ValueError):
        sampling.generated_entities(df.select(F.col("blocking_field").alias("name"), "unique_id", "content"), ["A"], [2], [3])


def test_loss():
    a, b = np.array([[1.0, 0.0], [1.0, 0.0]]), np.array([[1.0, 0.0], [-1.0, 0.0]])
    assert numeric.cosine_embedding_loss(a, b, np.array([1, -1])) == 0 and numeric.cosine_embedding_loss(a, b, np.array([1, 1])) == 2


def test_stream(spark, tmp_path):
    from knotwork.streaming.online import incremental_stream

    df = spark.createDataFrame([("b", k, [1.0, float(k % 2)]) for k in range(6)], "block string, rid long, vec array<double>")
    df.write.parquet(str(tmp_path / "in"))
    q = incremental_stream(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), 0.99).writeStream.format("memory").queryName("online").outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "ck")).start()
    q.awaitTermination(120)
    got = {r["unique_id"]: r["ClusterID"] for r in spark.table("online").collect()}
    assert got == {k: k % 2 for k in range(6)}


def test_many_clusters():
    """Forty far pairs need more clusters than thirty."""
    rng = np.random.default_rng(3)
    x = np.repeat(rng.normal(size=(40, 16)) * 100, 2, axis=0) + rng.normal(size=(80, 16)) * 0.01
    assert len(set(numeric.best_kmeans(x))) > 30


def test_components_do_not_depend_on_the_path(spark, monkeypatch):
    """Distributed rounds and the contraction in one task give the same table."""
    import random

    from knotwork.operators import components

    r = random.Random(2)
    pairs = [(r.randrange(400), r.randrange(400)) for _ in range(260)] + [(1000 + i, 1001 + i) for i in range(40)] + [(2000, 2000 + i) for i in range(50)]
    edges = spark.createDataFrame(pairs, "a long, b long").repartition(7)
    rows = lambda: sorted(map(tuple, components.connected_components(edges).collect()))
    small = rows()
    monkeypatch.setattr(components, "ONE_TASK", -1)
    assert rows() == small and (1040, 1000) in small and (2049, 2000) in small


def test_labels_are_blockwise_and_take_text_ids(spark, monkeypatch):
    """An id in two blocks joins nothing; ids may be texts; rounds and the one-task ending agree."""
    from knotwork.operators import clusters, components

    edges = spark.createDataFrame([("x", "u1", "u2"), ("y", "u2", "u3"), ("y", "u3", "u3"), ("z", "u9", "u9")], "block string, src string, dst string")
    records = spark.createDataFrame([(b, f"u{k}") for b in "xyz" for k in (1, 2, 3)], "block string, rid string")
    want = [("x", "u1", 0), ("x", "u2", 0), ("x", "u3", 1), ("y", "u1", 0), ("y", "u2", 1), ("y", "u3", 1), ("z", "u1", 0), ("z", "u2", 1), ("z", "u3", 2)]
    for bound in (components.ONE_TASK, -1):
        monkeypatch.setattr(components, "ONE_TASK", bound)
        assert sorted(map(tuple, clusters.cluster(records, edges).collect())) == want
    numbers = spark.createDataFrame([("x", 1, 2), ("y", 2, 3)], "block string, src long, dst long")
    assert sorted(map(tuple, clusters.labels(numbers).collect())) == [("x", 1, 1), ("x", 2, 1), ("y", 2, 2), ("y", 3, 2)]
    assert clusters.labels(numbers.limit(0)).count() == 0


def test_odd_values_do_not_crash(spark):
    from pyspark.sql import functions as F

    from knotwork.operators import edges, sampling, vectors
    from knotwork.sources import providers

    v = spark.createDataFrame([(1, 1, [0.0, 0.0]), (1, 2, [3.0, 4.0]), (1, 3, [6.0, 8.0])], "block long, rid long, vec array<double>")
    assert sorted((r["src"], r["dst"], round(r["sim"], 6)) for r in vectors.dense_cosine(v).collect()) == [(1, 2, 0.0), (1, 3, 0.0), (2, 3, 1.0)]
    f = spark.createDataFrame([(1, 1, "year", "1990"), (1, 2, "year", "no year"), (1, 3, "year", "2001"), (1, 4, "year", None)], "block long, rid long, feature string, value string")
    assert [(r["src"], r["dst"]) for r in edges.negative_gap(f, "year", 5).collect()] == [(1, 3)]
    names = ["quota", "n_stratum", "n_all", "rank_in", "luck", "n_group", "n_name"]
    df = spark.range(4000).select("id", (F.col("id") % 4 == 0).alias("g"), *[F.lit(7).alias(n) for n in names])
    got = sampling.stratified(df, ["g"], "id", 100, 3)
    assert got.columns == df.columns and sorted(map(tuple, got.groupBy("g").count().collect())) == [(False, 75), (True, 25)]
    first = {g: [r["id"] for r in df.where(F.col("g") == g).orderBy(sampling.draw(F.col("id"), 3)).limit(k).collect()] for g, k in ((False, 75), (True, 25))}
    assert {r["id"] for r in got.collect()} == {x for k in first.values() for x in k}
    assert sampling.without_replacement(df, ["g"], "id", 0.1).columns == df.columns
    assert providers.first_per_key(df, ["g"], [F.col("id")]).columns == df.columns and providers.names_within(df, "g", "id", 1, 5000).columns == df.columns


def test_experiment_keeps_results_without_truth(spark):
    from knotwork.registry import experiment

    records = spark.createDataFrame([(1, 1), (1, 2), (1, 3)], "block long, rid long")
    truth = spark.createDataFrame([(1, 1, "a"), (1, 2, "a")], "block long, rid long, truth string")
    row = experiment(records, None, None, truth, {"all": {"class": "production"}}).collect()[0]
    assert row["oc"] == 1.0  # the record without a truth is in the cluster of the others


def test_alias_homes(spark):
    """A known name is the home of its aliases; an unknown name with a known alias moves there; with neither there are no rows."""
    from knotwork.functions import geo

    countries = spark.createDataFrame([("Oz", "oz"), ("Utopia", "UT"), ("Erewhon", None)], "name string, code string")
    aliases = spark.createDataFrame([("Oz", ["Emerald Land", "Ozz"]), ("Land of U", ["Utopia", "No Place"]), ("Atlantis", ["Lost"]), ("Empty", None), (None, ["x"])], "name string, aliases array<string>")
    known = geo.country_rows(countries)
    assert {tuple(r) for r in geo.alias_rows(aliases, known).collect()} == {("emerald land", "oz"), ("ozz", "oz"), ("land of u", "utopia"), ("no place", "utopia")}
    divisions = spark.createDataFrame([("UT", "North"), ("oz", "North"), ("zz", "East"), ("oz", None)], "code string, name string")
    capitals = spark.createDataFrame([("oz", "Utopia"), ("ut", "Amaurot")], "code string, capital string")
    got = {r["name"]: r["country"] for r in geo.full_lookup(countries, aliases, divisions, capitals).collect()}
    assert got["utopia"] == "utopia" and got["amaurot"] == "utopia" and got["north"] == "oz" and got["ut"] == "utopia" and "east" not in got


def test_spectral_boost(spark):
    """The boost is the clipped cosine of the spectral vectors; only components of enough records get it in the combined form."""
    import numpy as np

    from knotwork import registry
    from knotwork.operators import clusters, numeric

    feats = spark.createDataFrame([(1, r, "f", v) for r, v in ((1, "a"), (2, "a"), (3, "a"), (3, "b"), (4, "b"), (5, "b"), (6, "c"), (7, "c"))], "block long, rid long, feature string, value string")
    records = spark.createDataFrame([(1, r) for r in range(1, 8)], "block long, rid long")
    got = {(r["src"], r["dst"]): r["spectral"] for r in numeric.spectral_pairs(feats, records).collect()}
    vec = numeric.spectral_vectors([(0, "a"), (1, "a"), (2, "a"), (2, "b"), (3, "b"), (4, "b"), (5, "c"), (6, "c")], 7)
    unit = vec / np.linalg.norm(vec, axis=1, keepdims=True)
    assert len(got) == 21 and all(abs(got[i + 1, j + 1] - unit[i] @ unit[j]) < 1e-6 for i in range(7) for j in range(i + 1, 7))
    pairs = spark.createDataFrame([(1, 1, 2, 0.3), (1, 6, 7, 0.3)], "block long, src long, dst long, sim double")
    inside = registry.component_spectra(records, feats, ["f"], 1, 5)
    assert {r["src"] for r in inside.collect()} | {r["dst"] for r in inside.collect()} == {1, 2, 3, 4, 5}
    sim = {r["src"]: r["sim"] for r in clusters.spectral_boosted(pairs, inside, 0.15, 0.0).collect()}
    assert sim[6] == 0.3 and 0.3 <= sim[1] <= 0.45
    assert clusters.components_as_blocks(records, spark.createDataFrame([(1, 1, 2, 1)], "block long, src long, dst long, weight long"), 1, 5).count() == 0


def test_network_takes_trained_weights(spark):
    import numpy as np

    from knotwork.operators import numeric

    records = spark.createDataFrame([(1, 1, [1.0, 0.0]), (1, 2, [0.0, 1.0]), (1, 3, [1.0, 0.1])], "block long, rid long, vec array<double>")
    edges = spark.createDataFrame([(1, 1, 2, "f", 1)], "block long, src long, dst long, feature string, weight long")
    one, none = np.eye(2), np.zeros((2, 2))
    label = lambda df: [r["ClusterID"] for r in df.orderBy("unique_id").collect()]
    assert label(numeric.graph_network_clusters(records, edges, 0.9, weights=(one, none))) == [0, 1, 0]
    assert label(numeric.graph_network_clusters(records, edges, 0.9, weights=(one, one))) == [0, 0, 1]
    assert label(numeric.hetero_network_clusters(records, edges, 0.9, ["f"], {"f": (one, none)})) == [0, 1, 0]
    assert label(numeric.hetero_network_clusters(records, edges, 0.9, ["f", "g"], {"f": (none, none), "g": (one, one)}, [0.5, 0.5])) == [0, 1, 0]


def test_phrases_against_brute_force(spark):
    import math
    import re
    from collections import Counter

    from knotwork.functions import text

    rows = [(1, "Deep water port. The deep water port of a deep water, water port; port!"), (2, "of the and"), (3, None), (4, "one two three four five six seven, two three")]
    got = {}
    for r in text.top_phrases(spark.createDataFrame(rows, "id long, body string"), "id", "body", 50).collect():
        got.setdefault(r["id"], {})[r["phrase"]] = r["score"]
    for i, body in rows:
        found = Counter()
        for part in re.split(r"[^\w\s'-]+", (body or "").lower()):
            run = []
            for w in [*part.split(), None]:
                if w is None or w in text.STOP:
                    for k in range(0, len(run), 4):
                        found[" ".join(run[k : k + 4])] += 1
                    run = []
                else:
                    run.append(w)
        inside = lambda a, b: a != b and f" {a} " in f" {b} "
        want = {t: len(t.split()) * math.log(n) + 0.75 * sum(inside(t, x) for x in found) + 0.1 * sum(inside(x, t) for x in found) for t, n in found.items()}
        assert want.keys() == got.get(i, {}).keys() and all(abs(got[i][t] - v) < 1e-5 for t, v in want.items())


def test_registries_and_contradictions(spark):
    import pytest

    from knotwork import registry
    from knotwork.operators import quality

    assert {"cosine_and_graph", "cosine_features_and_graph", "hetero_network", "hetero_network_combined", "algorithm"} <= set(registry.CLUSTERERS)
    assert registry.named(registry.SPLITTERS, "delete_negative_edges") and registry.named(registry.BLOCKERS, "country") and registry.named(registry.FEATURES, "passport")
    with pytest.raises(KeyError, match="known: csv"):
        registry.named(registry.PROVIDERS, "mongo")
    rows = spark.createDataFrame([("u", 1), ("u", 1), ("v", None)], "unique_id string, ClusterIdGlobal long")
    assert sorted(map(tuple, quality.cluster_ids(rows).collect())) == [("u", 1), ("v", None)]
    with pytest.raises(Exception, match="contradicting clusters of u"):
        quality.cluster_ids(rows.union(spark.createDataFrame([("u", 2)], rows.schema))).collect()
    with pytest.raises(ValueError, match="ClusterIdGlobal"):
        quality.cluster_ids(rows.select("unique_id"))


def test_codes_of_many_partitions(spark):
    from knotwork.operators.ranks import ordered_codes

    df = spark.range(0, 3000, 1, 9).select((F.col("id") * 7919 % 997).cast("string").alias("part"), F.col("id").alias("before"))
    want = {v: k for k, v in enumerate(sorted({str(i * 7919 % 997) for i in range(3000)}))}
    assert {r["part"]: r["code"] for r in ordered_codes(df, "part", "code").collect()} == want
    assert ordered_codes(df.limit(0), "part", "code").count() == 0


def test_stars_give_the_components_of_all_pairs(spark):
    from knotwork.operators import clusters, edges

    rows = [("b", k, "f", f"v{k % 7}") for k in range(30)] + [("b", k, "g", f"w{k // 9}") for k in range(0, 30, 4)] + [("c", 1, "f", None), ("c", 2, "f", "v1"), ("c", 3, "g", "v1")]
    f = spark.createDataFrame(rows, "block string, rid long, feature string, value string")
    records = f.select("block", "rid").distinct()
    for use in (["f"], ["g"], ["f", "g"]):
        own = f.where(F.col("feature").isin(use))
        assert sorted(clusters.value_clusters(records, own).collect()) == sorted(clusters.feature_clusters(records, edges.shared_counts(own), 1).collect())
