"""Scoring clusterings against ground truth, for all blocks in one grouped plan."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from knotwork.operators.ranks import ordered_codes
from knotwork.operators.sampling import share


def contingency(joined: DataFrame) -> DataFrame:
    """``(block, truth, cluster, n)`` with the marginal sizes, from one row per record ``(block, truth, cluster)``. An unknown truth is one of its own."""
    cells = joined.groupBy("block", "truth", "cluster").agg(F.count("*").alias("n"))
    over = lambda *by: F.sum("n").over(Window.partitionBy(*by))
    return cells.withColumns({"n_truth": over("block", "truth"), "n_cluster": over("block", "cluster"), "n_all": over("block")})


def cluster_flags(joined: DataFrame) -> DataFrame:
    """Per cluster: ``support`` (truths touched), ``is_under`` (a touched truth continues elsewhere), ``is_over`` (more than one)."""
    c = contingency(joined)
    return c.groupBy("block", "cluster").agg(F.count("*").alias("support"), F.max(F.col("n") < F.col("n_truth")).alias("is_under"), (F.count("*") > 1).alias("is_over"))


def block_metrics(joined: DataFrame) -> DataFrame:
    """Homogeneity, completeness, V, over- and under-combination, and the score to minimise, per block.

    Rates are rounded to two places before they enter the score.
    """
    c = contingency(joined)
    share, n = F.col("n") / F.col("n_all"), F.col("n_all")
    info = F.sum(share * F.log(F.col("n") * n / (F.col("n_truth") * F.col("n_cluster"))))
    ent_t = -F.sum(share * F.log(F.col("n_truth") / n))
    ent_c = -F.sum(share * F.log(F.col("n_cluster") / n))
    e = c.groupBy("block").agg(info.alias("mi"), ent_t.alias("ht"), ent_c.alias("hc"), F.max("n_all").alias("n_records"), F.countDistinct("truth").alias("true_clusters"))
    ho = F.when(F.col("ht") < 1e-12, 1.0).otherwise(F.col("mi") / F.col("ht"))
    co = F.when(F.col("hc") < 1e-12, 1.0).otherwise(F.col("mi") / F.col("hc"))
    e = e.withColumn("ho", ho).withColumn("co", co).withColumn("v", F.when(F.col("ho") + F.col("co") > 0, 2 * F.col("ho") * F.col("co") / (F.col("ho") + F.col("co"))).otherwise(0.0))
    f = cluster_flags(joined).groupBy("block").agg(
        F.count("*").alias("created"), F.round(F.avg(F.col("is_over").cast("int")), 2).alias("oc"), F.round(F.avg(F.col("is_under").cast("int")), 2).alias("uc"), F.round(F.coalesce(F.avg(F.when(F.col("is_over"), F.col("support"))), F.lit(0.0)), 2).alias("per_oc")
    )
    m = e.join(f, "block")
    extra = F.greatest(F.col("created") - F.col("true_clusters"), F.lit(0)) / F.col("true_clusters")
    score = F.round(3.4 * F.col("uc") + 8.4 * F.col("oc") + 0.4 * F.col("per_oc") + 0.8 * extra, 2)
    return m.select(
        F.col("block").alias("blocking_field"), F.round("ho", 2).alias("homogeneity"), F.round("co", 2).alias("completeness"), F.round("v", 2).alias("v_score"), F.col("n_records").cast("long").alias("n_records"),
        "oc", "uc", F.col("per_oc").alias("profiles_per_oc"), F.col("created").cast("long").alias("clusters_created"), F.col("true_clusters").cast("long").alias("true_clusters"), score.alias("score_to_minimise"),
    )


METRICS = ("homogeneity", "completeness", "v_score", "oc", "uc", "profiles_per_oc", "clusters_created", "true_clusters", "score_to_minimise")


def report(metrics: DataFrame) -> DataFrame:
    """Means over blocks, rounded to two places."""
    return metrics.agg(*[F.round(F.avg(F.col(m).cast("double")), 2).alias(m) for m in METRICS])


def mean_of(metrics: DataFrame, column: str, weight: str | None = None) -> DataFrame:
    """The mean of a column, or its mean by weight, over rows where it is known (no null, no NaN), to two places: ``(mean)``, one row."""
    missing = [c for c in (column, weight) if c and c not in metrics.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    x, w = F.col(column).cast("double"), F.col(weight).cast("double") if weight else F.lit(1.0)
    return metrics.where(x.isNotNull() & ~F.isnan(x)).agg(F.round(F.try_divide(F.sum(x * w), F.sum(w)), 2).alias("mean"))


def transposed(reports: DataFrame, names: list[str] | None = None) -> DataFrame:
    """``(metric, <a column for each report>)`` from rows ``(name, metrics)``; without names those of all reports, sorted."""
    long = reports.select("name", *[F.col(m).cast("double").alias(m) for m in METRICS]).unpivot(["name"], list(METRICS), "metric", "value")
    return long.groupBy("metric").pivot("name", names).agg(F.first("value"))


def sampled_pairs(records: DataFrame, rate: float = 0.2, runs: int = 1, seed: int = 0) -> DataFrame:
    """``(run, block, src, dst, truth, answer)``: floor(n * rate) pairs of two records of every block, drawn anew for each run.

    ``records(block, rid, truth, cluster)``, one row for each record; blocks of one record have no pair. Records are
    numbered by range partitions and pairs drawn by number, so no block is held by a task and no pair is made in vain.
    """
    r = records.select(F.struct("block", "rid").alias("who"), "truth", "cluster")
    r = r.join(ordered_codes(r, "who", "code"), "who")
    blocks = r.groupBy("who.block").agg(F.count("*").alias("n"), F.min("code").alias("low")).where("n > 1")
    draws = blocks.withColumn("k", F.floor(F.col("n") * rate)).where("k > 0").withColumn("run", F.explode(F.sequence(F.lit(0), F.lit(runs - 1))))
    draws = draws.withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("k") - 1)))
    key = F.concat_ws(":", F.col("block").cast("string"), F.col("run").cast("string"), F.col("i").cast("string"))
    first = F.floor(share(key, seed) * F.col("n"))
    other = (first + 1 + F.floor(share(key, seed + 1) * (F.col("n") - 1))) % F.col("n")
    at = draws.select("run", (F.col("low") + first).alias("a"), (F.col("low") + other).alias("b"))
    side = lambda c: r.select(F.col("code").alias(c), F.struct("who.block", "who.rid", "truth", "cluster").alias(f"r{c}"))
    same = lambda f: F.col(f"ra.{f}").eqNullSafe(F.col(f"rb.{f}"))
    both = at.join(side("a"), "a").join(side("b"), "b")
    return both.select("run", F.col("ra.block").alias("block"), F.col("ra.rid").alias("src"), F.col("rb.rid").alias("dst"), same("truth").alias("truth"), same("cluster").alias("answer"))


def repeated_acceptance(records: DataFrame, rate: float = 0.2, runs: int = 20, seed: int = 0) -> DataFrame:
    """Acceptance scores of several draws of pairs: ``(run, accuracy, precision, recall, fscore)``, to two places."""
    count = lambda t, a: F.sum(((F.col("truth") == t) & (F.col("answer") == a)).cast("long"))
    cells = sampled_pairs(records, rate, runs, seed).groupBy("run").agg(*[count(t, a).alias(f"c{int(t)}{int(a)}") for t in (True, False) for a in (True, False)])
    zero = lambda x, y: F.coalesce(F.try_divide(x, y), F.lit(0.0))
    total, sums = F.col("c00") + F.col("c01") + F.col("c10") + F.col("c11"), {"precision": 0.0, "recall": 0.0, "fscore": 0.0}
    for v in "10":
        w = "0" if v == "1" else "1"
        hit, real = F.col(f"c{v}{v}"), F.col(f"c{v}0") + F.col(f"c{v}1")
        p, r = zero(hit, hit + F.col(f"c{w}{v}")), zero(hit, real)
        for name, x in (("precision", p), ("recall", r), ("fscore", zero(2 * p * r, p + r))):
            sums[name] = sums[name] + x * real
    return cells.select("run", F.round((F.col("c11") + F.col("c00")) / total, 2).alias("accuracy"), *[F.round(x / total, 2).alias(n) for n, x in sums.items()])


def name_checks(truth: DataFrame, results: DataFrame) -> DataFrame:
    """``(blocking_field, n_results, n_truth, state)`` of every block with results: ``same``, ``different`` or ``unknown`` to the truth."""
    n = results.groupBy("blocking_field").agg(F.count("*").alias("n_results"))
    t = truth.groupBy("blocking_field").agg(F.count("*").alias("n_truth"))
    state = F.when(F.col("n_truth").isNull(), "unknown").when(F.col("n_truth") == F.col("n_results"), "same").otherwise("different")
    return n.join(t, "blocking_field", "left").withColumn("state", state)


def cluster_ids(results: DataFrame, key: str = "unique_id", cluster: str = "ClusterIdGlobal") -> DataFrame:
    """``(key, cluster)``, one row for each record. A record with two clusters is an error, and so is a missing column."""
    missing = [c for c in (key, cluster) if c not in results.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    one = results.groupBy(key).agg(F.min(cluster).alias("lo"), F.max(cluster).alias("hi"))
    clash = F.raise_error(F.concat(F.lit("contradicting clusters of "), F.col(key).cast("string")))
    return one.select(key, F.when(F.col("lo") == F.col("hi"), F.col("lo")).when(F.col("lo").isNull(), F.col("lo")).otherwise(clash).alias(cluster))


def name_sensitivity(metrics: DataFrame, resamplings: int, ratio: float, seed: int = 0) -> DataFrame:
    """A report for each of several draws of ceil(n * ratio) blocks, from the blocks' metrics: ``(run, ...)``."""
    if not 0 < ratio < 1:
        raise ValueError("ratio must lie between 0 and 1")
    runs = metrics.crossJoin(F.broadcast(metrics.sparkSession.range(resamplings).select(F.col("id").alias("run"))))  # as many rows as asked for
    luck = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("run").cast("string"), F.col("blocking_field").cast("string")))
    by = Window.partitionBy("run")
    drawn = runs.withColumn("n_rank", F.row_number().over(by.orderBy(luck, "blocking_field"))).withColumn("n_blocks", F.count("*").over(by))
    return drawn.where(F.col("n_rank") <= F.ceil(F.col("n_blocks") * ratio)).groupBy("run").agg(*[F.round(F.avg(F.col(m).cast("double")), 2).alias(m) for m in METRICS])


def global_rates(joined: DataFrame) -> DataFrame:
    """Share of all clusters, of all blocks together, that are over- and under-combined: ``(clusters, oc, uc)``, one row."""
    f = cluster_flags(joined)
    return f.agg(F.count("*").alias("clusters"), F.round(F.avg(F.col("is_over").cast("int")), 4).alias("oc"), F.round(F.avg(F.col("is_under").cast("int")), 4).alias("uc"))


def cluster_of(results: DataFrame, records: DataFrame) -> DataFrame:
    """All records that share a cluster with the asked ones ``(blocking_field, unique_id)``: ``(..., ClusterID, asked)``."""
    asked = records.select("blocking_field", F.col("unique_id").alias("asked")).distinct()
    own = results.withColumnRenamed("unique_id", "asked").join(asked, ["blocking_field", "asked"]).select("blocking_field", "ClusterID", "asked")
    return results.join(own, ["blocking_field", "ClusterID"])


def improvements(reports: DataFrame, reference: str | None = None) -> DataFrame:
    """Ratio of every metric of each report to each reference report: long form ``(reference, name, metric, ratio)``.

    0 / 0 is NaN, x / 0 infinite.
    """
    long = reports.unpivot(["name"], list(METRICS), "metric", "value")
    ref = long.select(F.col("name").alias("reference"), "metric", F.col("value").alias("base"))
    if reference is not None:
        ref = ref.where(F.col("reference") == reference)
    x = long.join(F.broadcast(ref), "metric")  # one row for each report and metric
    ratio = F.when((F.col("base") == 0) & (F.col("value") == 0), F.lit(float("nan"))).when(F.col("base") == 0, F.lit(float("inf"))).otherwise(F.col("value") / F.when(F.col("base") != 0, F.col("base")))
    return x.select("reference", "name", "metric", ratio.alias("ratio"))


def split_counts(joined: DataFrame) -> DataFrame:
    """How many output clusters each truth is spread over, and how many truths each output cluster holds."""
    under = joined.groupBy("truth").agg(F.countDistinct("block", "cluster").alias("n")).select(F.lit("under").alias("kind"), F.col("truth").cast("string").alias("id"), F.col("n").cast("long").alias("n"))
    over = joined.groupBy("block", "cluster").agg(F.countDistinct("truth").alias("n")).select(F.lit("over").alias("kind"), F.concat_ws("-", "block", "cluster").alias("id"), F.col("n").cast("long").alias("n"))
    return under.union(over)


def acceptance(pairs: DataFrame) -> DataFrame:
    """Accuracy, and support-weighted precision, recall and F1 of yes/no answers ``(truth boolean, answer boolean)``."""
    cells = pairs.groupBy("truth", "answer").agg(F.count("*").alias("n"))
    total = cells.agg(F.sum("n").alias("all"), F.sum(F.when(F.col("truth") == F.col("answer"), F.col("n")).otherwise(0)).alias("right"))
    side = None
    for v in (True, False):
        hit = F.sum(F.when((F.col("truth") == v) & (F.col("answer") == v), F.col("n")).otherwise(0))
        said = F.sum(F.when(F.col("answer") == v, F.col("n")).otherwise(0))
        real = F.sum(F.when(F.col("truth") == v, F.col("n")).otherwise(0))
        s = cells.agg(hit.alias("hit"), said.alias("said"), real.alias("real"))
        side = s if side is None else side.union(s)
    p = F.when(F.col("said") > 0, F.col("hit") / F.col("said")).otherwise(0.0)
    r = F.when(F.col("real") > 0, F.col("hit") / F.col("real")).otherwise(0.0)
    side = side.withColumn("p", p).withColumn("r", r).withColumn("f", F.when(F.col("p") + F.col("r") > 0, 2 * F.col("p") * F.col("r") / (F.col("p") + F.col("r"))).otherwise(0.0))
    w = side.agg(*[(F.sum(F.col(c) * F.col("real")) / F.sum("real")).alias(n) for c, n in (("p", "precision"), ("r", "recall"), ("f", "f1"))])
    return total.crossJoin(w).select(F.round(F.col("right") / F.col("all"), 6).alias("accuracy"), *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")])  # one row each


def trapezoid(points: DataFrame, group: str, x: str, y: str) -> DataFrame:
    w = Window.partitionBy(group).orderBy(x)
    area = (F.col(x) - F.lag(x).over(w)) * (F.col(y) + F.lag(y).over(w)) / 2
    return points.withColumn("area", area).groupBy(group).agg(F.round(F.coalesce(F.sum("area"), F.lit(0.0)), 4).alias("auc"))
