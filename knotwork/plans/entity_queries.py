"""Queries for chosen and made-up entities, pairs drawn for acceptance, reports side by side, and terms of features."""

from __future__ import annotations

from pyspark.sql import functions as F

from knotwork.functions import names, text
from knotwork.operators import edges, entities, learning, quality, vectors
from knotwork.plans.carriers import SHARED_SQL, features_sql, item_features, load, orders
from knotwork.plans.record_queries import FREQ, METRICS_SQL, SHARE_SQL, joined
from knotwork.session import pieces_of, spread

Q, O = {}, {}


def query(name: str, sql: str | None = None):
    def keep(f):
        Q[name] = f
        if sql:
            O[name] = sql
        return f

    return keep


@query("entities_selected", f"""WITH {FREQ}, m AS (SELECT user_id AS entity, p_name AS name, CAST(ts AS DATE) AS day, event_id AS uri FROM events JOIN part ON user_id = p_partkey),
y AS (SELECT day, (row_number() OVER (ORDER BY md5('0:' || day), day) - 1) // 3 AS look FROM (SELECT DISTINCT day FROM m)), l AS (SELECT entity, name, look, count(DISTINCT day || ':' || uri) AS n FROM m JOIN y USING (day) GROUP BY ALL),
c AS (SELECT *, sum(n) OVER (PARTITION BY entity, name ORDER BY look) AS total FROM l), e AS (SELECT entity, name, min(look) AS look, min(total) AS total FROM c WHERE total >= 20 GROUP BY ALL),
k AS (SELECT name, product(freq / (SELECT sum(freq) FROM q)::DOUBLE) AS p FROM (SELECT DISTINCT name, unnest(string_split(lower(name), ' ')) AS token FROM e) JOIN q USING (token) GROUP BY name), x AS (SELECT e.*, min(look) OVER (PARTITION BY e.name) AS lo FROM e JOIN k USING (name) WHERE p >= 1e-9),
s AS (SELECT entity, name, look, total FROM x WHERE look = lo), h AS (SELECT look, sum(count(*)) OVER (ORDER BY look) AS so FROM s GROUP BY look), z AS (SELECT min(look) AS stop FROM h WHERE so >= 5)
SELECT entity, name, CAST(total AS BIGINT) AS total_uri FROM s, z WHERE stop IS NULL OR look <= stop""")
def _(spark, d):
    part = load(spark, d, "part")
    m = load(spark, d, "events").join(part, F.col("user_id") == F.col("p_partkey")).select(F.col("user_id").alias("entity"), F.col("p_name").alias("name"), F.to_date("ts").alias("day"), F.col("event_id").alias("uri"))
    return entities.selected_entities(m, names.token_frequency(part, "p_name"), 5, 20, 1e-9, 3).drop("commonness")


@query("rows_batched", "SELECT o_orderkey, CAST((row_number() OVER (ORDER BY o_orderkey) - 1) // 64 AS BIGINT) AS batch FROM orders")
def _(spark, d):
    return entities.batched(load(spark, d, "orders").select("o_orderkey"), "o_orderkey", 64)


@query("meta_column", "SELECT p_partkey, p_brand || '/' || p_size AS found FROM part")
def _(spark, d):
    meta = entities.with_meta(load(spark, d, "part"), ["p_brand", "p_size"])
    return meta.select("p_partkey", F.concat_ws("/", F.col("meta")["p_brand"], F.col("meta")["p_size"]).alias("found"))


@query("generated_postprocessed", r"""WITH x AS (SELECT p_partkey, p_name AS content, string_split(p_name, ' ')[1] AS original_entity_name, 'ENTITY ' || (p_partkey % 10) AS blocking_field FROM part)
SELECT p_partkey, regexp_replace(content, '\b' || original_entity_name || '\b', blocking_field, 'gi') AS content, original_entity_name, blocking_field, CAST(dense_rank() OVER (ORDER BY original_entity_name) - 1 AS BIGINT) AS "ClusterIdGlobal" FROM x""")
def _(spark, d):
    pseudo = F.concat(F.lit("ENTITY "), (F.col("p_partkey") % 10).cast("string"))
    made = load(spark, d, "part").select("p_partkey", F.col("p_name").alias("content"), F.split("p_name", " ")[0].alias("entity_name"), pseudo.alias("pseudo_entity_name"))
    return entities.postprocessed(made)


@query("text_utf8", "SELECT doc_id, md5(text) AS digest FROM documents")
def _(spark, d):
    return load(spark, d, "documents").select("doc_id", F.md5(text.as_utf8(F.col("text"))).alias("digest"))


@query("quality_weighted_mean", "SELECT round(sum(o_totalprice::DOUBLE * o_custkey) / sum(o_custkey), 2) AS mean FROM orders WHERE o_orderkey % 7 > 1")
def _(spark, d):
    known = F.when(F.col("o_orderkey") % 7 == 0, F.lit(float("nan"))).when(F.col("o_orderkey") % 7 > 1, F.col("o_totalprice").cast("double"))
    return quality.mean_of(load(spark, d, "orders").select(known.alias("score"), "o_custkey"), "score", "o_custkey")


LONG_SQL = " UNION ALL ".join(f"SELECT blocking_field AS name, '{m}' AS metric, {m}::DOUBLE AS value FROM b" for m in quality.METRICS)


def _reports(spark, d):
    return quality.block_metrics(joined(spark, d)).withColumnRenamed("blocking_field", "name")


@query("quality_report_transposed", f"WITH b AS ({METRICS_SQL}), l AS ({LONG_SQL}) SELECT metric, " + ", ".join(f"max(value) FILTER (name = '{s}') AS \"{s}\"" for s in "FOP") + " FROM l GROUP BY metric")
def _(spark, d):
    return quality.transposed(_reports(spark, d), ["F", "O", "P"])


@query("quality_improvements", f"WITH b AS ({METRICS_SQL}), l AS ({LONG_SQL}) SELECT r.name AS reference, l.name, l.metric, CASE WHEN r.value = 0 AND l.value = 0 THEN 'nan'::DOUBLE WHEN r.value = 0 THEN 'inf'::DOUBLE ELSE l.value / r.value END AS ratio FROM l JOIN l r ON l.metric = r.metric")
def _(spark, d):
    return quality.improvements(_reports(spark, d).select("name", *[F.col(m).cast("double").alias(m) for m in quality.METRICS]))


PAIRS_SQL = f"""WITH r AS (SELECT o_custkey AS block, o_orderkey AS rid, o_orderstatus AS truth, o_orderkey % 3 AS cluster, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS at, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders),
w AS (SELECT block, n, unnest(range(CAST(floor(n * 0.2) AS BIGINT))) AS i FROM (SELECT DISTINCT block, n FROM r WHERE n > 1)), v AS (SELECT run, block, n, i, CAST(floor({SHARE_SQL.format(s=0, k="(block || ':' || run || ':' || i)")} * n) AS BIGINT) AS a,
CAST(floor({SHARE_SQL.format(s=1, k="(block || ':' || run || ':' || i)")} * (n - 1)) AS BIGINT) AS more FROM w, range(3) t(run)),
p AS (SELECT CAST(v.run AS INT) AS run, v.block, x.rid AS src, y.rid AS dst, x.truth = y.truth AS truth, x.cluster = y.cluster AS answer FROM v JOIN r x ON x.block = v.block AND x.at = v.a JOIN r y ON y.block = v.block AND y.at = (v.a + 1 + v.more) % v.n)"""


def _drawn(spark, d):
    return load(spark, d, "orders").select(F.col("o_custkey").alias("block"), F.col("o_orderkey").alias("rid"), F.col("o_orderstatus").alias("truth"), (F.col("o_orderkey") % 3).alias("cluster"))


@query("quality_sampled_pairs", f"{PAIRS_SQL} SELECT * FROM p")
def _(spark, d):
    return quality.sampled_pairs(_drawn(spark, d), 0.2, 3)


@query("quality_repeated_acceptance", f"{PAIRS_SQL}, c AS (SELECT run, v, count(*) AS n, sum((truth = v)::INT) AS real, sum((answer = v)::INT) AS said, sum((truth = v AND answer = v)::INT)::DOUBLE AS hit FROM p, (VALUES (true), (false)) t(v) GROUP BY ALL), f AS (SELECT *, hit / said AS p, hit / real AS r, 2 * (hit / said) * (hit / real) / (hit / said + hit / real) AS f FROM c) SELECT run, round(sum(hit) / max(n), 2) AS accuracy, round(sum(p * real) / max(n), 2) AS precision, round(sum(r * real) / max(n), 2) AS recall, round(sum(f * real) / max(n), 2) AS fscore FROM f GROUP BY run")
def _(spark, d):
    return quality.repeated_acceptance(_drawn(spark, d), 0.2, 3)


@query("edges_of_graph", f"WITH {features_sql('supplier')}, {SHARED_SQL} SELECT block, src, dst, CAST(weight AS DOUBLE) AS weight FROM s UNION ALL SELECT o_custkey, min(o_orderkey), min(o_orderkey), 1 FROM orders WHERE o_custkey NOT IN (SELECT block FROM s) GROUP BY o_custkey")
def _(spark, d):
    return edges.graph_edges(orders(spark, d), edges.shared_counts(item_features(spark, d, "supplier")))


@query("tfidf_feature_terms", "WITH t AS (SELECT o_custkey AS block, o_orderkey AS rid, unnest(['supplier-' || l_suppkey, 'part-' || l_partkey]) AS term FROM orders JOIN lineitem ON o_orderkey = l_orderkey), c AS (SELECT block, rid, term, count(*) AS tf FROM t GROUP BY ALL), f AS (SELECT term, ln((1 + (SELECT count(DISTINCT rid) FROM c)) / (1 + count(*))::DOUBLE) + 1 AS idf FROM c GROUP BY term), w AS (SELECT block, rid, term, tf * idf AS raw FROM c JOIN f USING (term)) SELECT block, rid, term, round(raw / sqrt(sum(raw * raw) OVER (PARTITION BY rid)), 6) AS w FROM w")
def _(spark, d):
    items = load(spark, d, "lineitem")
    n = pieces_of(orders(spark, d).join(items, F.col("rid") == F.col("l_orderkey")))
    lines = spread(items.select("l_orderkey", "l_suppkey", "l_partkey"), "l_orderkey", n=n).groupBy("l_orderkey").agg(F.collect_list("l_suppkey").alias("s"), F.collect_list("l_partkey").alias("p"))
    rows = spread(orders(spark, d), "rid", n=n).join(lines, F.col("rid") == F.col("l_orderkey")).select("block", "rid", text.feature_string({"SUPPLIER": F.col("s"), "PART": F.col("p")}).alias("text"))
    return vectors.tfidf(vectors.feature_tokens(rows)).withColumn("w", F.round("w", 6))


@query("text_bigrams", "WITH t AS (SELECT l_orderkey AS rid, 't' || l_partkey % 12 AS term, l_linenumber::BIGINT * 1000000000 + l_partkey AS k FROM lineitem), n AS (SELECT term, lead(term) OVER (PARTITION BY rid ORDER BY k) AS other FROM t), p AS (SELECT term, other, count(*) AS n FROM n WHERE other IS NOT NULL GROUP BY ALL), u AS (SELECT term, count(*) AS c FROM t GROUP BY term) SELECT p.term || '_' || other AS phrase, n, round((n - 5) * (SELECT count(*) FROM u) / (a.c * b.c)::DOUBLE, 12) AS score FROM p JOIN u a ON a.term = p.term JOIN u b ON b.term = other WHERE n >= 5 AND (n - 5) * (SELECT count(*) FROM u) / (a.c * b.c)::DOUBLE > 0.000001")
def _(spark, d):
    term = F.concat(F.lit("t"), (F.col("l_partkey") % 12).cast("string"))
    t = load(spark, d, "lineitem").select(F.lit(0).alias("block"), F.col("l_orderkey").alias("rid"), term.alias("term"), (F.col("l_linenumber").cast("long") * 1000000000 + F.col("l_partkey")).alias("k"))
    return vectors.bigrams(t, "k", 5, 0.000001).withColumn("score", F.round("score", 12))


@query("topics_dominant", "SELECT vec_id, coalesce(array_to_string(list_filter(range(0, len(embedding)), lambda i: embedding[i + 1]::DOUBLE >= 0.1), '|'), '') AS found FROM embeddings")
def _(spark, d):
    w = load(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("topics"))
    return learning.dominant_topics(w).select("vec_id", F.array_join(F.col("topic_ids").cast("array<string>"), "|").alias("found"))


@query("vectors_concatenated", "SELECT vec_id, CAST(len(embedding) + 1 AS BIGINT) AS size, embedding[1]::DOUBLE AS first, label::DOUBLE AS last FROM embeddings")
def _(spark, d):
    e = load(spark, d, "embeddings")
    a, b = e.select("vec_id", F.col("embedding").cast("array<double>").alias("vec")), e.select("vec_id", F.array(F.col("label").cast("double")).alias("vec"))
    return learning.concatenated(a, b, "vec_id").select("vec_id", F.size("vec").cast("long").alias("size"), F.element_at("vec", 1).alias("first"), F.element_at("vec", -1).alias("last"))


@query("entities_drawn")
def _(spark, d):
    docs = load(spark, d, "documents").select(F.col("source").alias("entity_name"), F.col("doc_id").alias("unique_id"), F.col("text").alias("content"))
    made = entities.drawn_entities(docs, {1: 2.0, 2: 1.0}, {3: 1.0, 6: 1.0}, 8)
    return entities.postprocessed(made).withColumn("content", F.md5("content"))


@query("graph_network_trained")
def _(spark, d):
    from knotwork.operators.network_training import train_network
    from knotwork.operators.numeric import graph_network_clusters
    from knotwork.plans.carriers import vectors as carried

    v = carried(spark, d, "vec_id % 40").join(load(spark, d, "embeddings").select(F.col("vec_id").alias("rid"), F.col("label").alias("truth")), "rid")
    feats = v.select("block", "rid", F.lit("near").alias("feature"), F.floor(F.element_at("vec", 1) * 10).cast("string").alias("value"))
    weights, _ = train_network(v, feats)
    return graph_network_clusters(v, feats, 0.9, weights=weights)
