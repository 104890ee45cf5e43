"""Operators by name, and experiments described by plain dictionaries (as read from YAML or JSON)."""

from __future__ import annotations

import argparse
import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from knotwork.functions import profiles, text
from knotwork.operators import blocking, clusters, edges, learning, numeric, quality, vectors
from knotwork.session import cut
from knotwork.sources import providers, sinks

CLUSTERERS: dict[str, Callable[..., DataFrame]] = {}


def clusterer(name: str):
    def keep(f):
        CLUSTERERS[name] = f
        return f

    return keep


@clusterer("production")
def _production(records, feats, vecs):
    return clusters.everything_together(records)


@clusterer("connected_components")
def _components(records, feats, vecs, use_features, th=1):
    return clusters.value_clusters(records, feats.where(F.col("feature").isin(use_features)), th)


@clusterer("cosine")
def _cosine(records, feats, vecs, th=0.5):
    return clusters.cluster(records, vectors.cosine_links(vecs, th))


@clusterer("cosine_and_features")
def _cosine_features(records, feats, vecs, use_features, th, max_energy=75):
    return clusters.cluster(records, vectors.cosine_links(vecs, th, feats=feats.where(F.col("feature").isin(use_features)), max_energy=max_energy))


@clusterer("incremental")
def _incremental(records, feats, vecs, th=0.5, kind="pairwise"):
    return numeric.incremental(vecs, th, kind)


@clusterer("kmeans")
def _kmeans(records, feats, vecs):
    return numeric.kmeans_clusters(vecs)


@clusterer("fast_rp")
def _fast_rp(records, feats, vecs, use_features, th=0.5, dim=128):
    return numeric.fast_rp_clusters(records, edges.shared_counts(feats.where(F.col("feature").isin(use_features)), inverse_degree=True), th, dim)


@clusterer("spectral")
def _spectral(records, feats, vecs, th=0.5):
    return numeric.spectral_clusters(feats, records, th)


@clusterer("graph_network")
def _network(records, feats, vecs, use_features, th=0.9):
    return numeric.graph_network_clusters(vecs, feats.where(F.col("feature").isin(use_features)), th)


#: Other parts of an experiment by name.
FEATURES = {
    "clean_text": text.strip_tags, "domain": text.url_domain, "meta": text.meta_value, "keyword": text.keywords_in, "times": text.times_in, "date": text.agreed_date, "persons": text.capital_runs, "profession": text.professions,
    "alias": profiles.alias_features, "primary": profiles.primary_features, "year_of_birth": profiles.years_of_birth, "known_years": profiles.known_years, "birth_day": profiles.birth_days, "country_code": profiles.country_codes,
    "passport": profiles.passport_ids, "organisation_id": profiles.organisation_ids, "organisation_alias": profiles.organisation_aliases, "address": profiles.address_tokens,
}
BLOCKERS = {"identity": blocking.identity_blocks, "feature": blocking.feature_blocks, "feature_cutoff": blocking.cutoff_blocks, "country": blocking.country_blocks}
SPLITTERS = {"delete_negative_edges": blocking.delete_negative_edges, "colour_negative_edges": blocking.colour_split}
PROVIDERS = {"csv": providers.read_csv, "parquet": providers.read_parquet, "documents": providers.read_documents, "folder": providers.read_folder}
SAVERS = {form: form for form in ("parquet", "csv", "json", "orc")}


def named(kind: dict, name: str):
    """A part by its name; an unknown name raises and tells the known ones."""
    if name not in kind:
        raise KeyError(f"no such name: {name}; known: {', '.join(sorted(kind))}")
    return kind[name]


@clusterer("cosine_and_graph")
def _cosine_graph(records, feats, vecs, use_features, th=0.5, max_energy=0.65, min_energy=-0.25):
    spectral = numeric.with_spectral(feats.where(F.col("feature").isin(use_features)), records)
    return clusters.cluster(records, vectors.cosine_links(vecs, th, spectral=spectral, most=max_energy, least=min_energy))


def component_vectors(records, feats, use_features, ftr_th=1, graph_node_th=5):
    """``(block, rid, part, spec)``: spectral vectors inside the components of shared values that are large enough."""
    own = feats.where(F.col("feature").isin(use_features))
    shared = edges.shared_stars(own).withColumn("weight", F.lit(1)) if 0 < ftr_th <= 1 else edges.shared_counts(own)
    parts = cut(clusters.components_as_blocks(records, shared, ftr_th, graph_node_th))
    inside = own.join(parts, ["block", "rid"]).select(F.col("part").alias("block"), "rid", "value")
    spec = numeric.with_spectral(inside, parts.select(F.col("part").alias("block"), "rid")).withColumnRenamed("block", "part")
    return parts.join(spec, ["part", "rid"]).select("block", "rid", "part", "spec")


def component_spectra(records, feats, use_features, ftr_th=1, graph_node_th=5):
    """Spectral cosine inside the components of shared values that are large enough."""
    inside = component_vectors(records, feats, use_features, ftr_th, graph_node_th)
    pairs = vectors.dense_cosine(inside.select(F.col("part").alias("block"), "rid", F.col("spec").alias("vec")))
    block = inside.select("part", F.col("block").alias("own")).distinct()
    return pairs.join(block, F.col("block") == F.col("part")).select(F.col("own").alias("block"), "src", "dst", F.col("sim").alias("spectral"))


@clusterer("cosine_features_and_graph")
def _cosine_features_graph(records, feats, vecs, use_features, th=0.4, ftr_th=1, ftr_max_energy=75, graph_node_th=5, max_energy=0.15, min_energy=0.0):
    spectral = component_vectors(records, feats, use_features, ftr_th, graph_node_th)
    own = feats.where(F.col("feature").isin(use_features))
    return clusters.cluster(records, vectors.cosine_links(vecs, th, feats=own, max_energy=ftr_max_energy, spectral=spectral, most=max_energy, least=min_energy))


@clusterer("hetero_network")
def _hetero(records, feats, vecs, use_features, th=0.9, weights=None):
    return numeric.hetero_network_clusters(vecs, feats.where(F.col("feature").isin(use_features)), th, use_features, weights)


@clusterer("hetero_network_combined")
def _hetero_combined(records, feats, vecs, use_features, mix, th=0.9, weights=None):
    return numeric.hetero_network_clusters(vecs, feats.where(F.col("feature").isin(use_features)), th, use_features, weights, mix)


@clusterer("algorithm")
def _algorithm(records, feats, vecs, fit_predict):
    return numeric.algorithm_clusters(vecs, fit_predict)


@clusterer("pair_model")
def _pair_model(records, feats, vecs, model, th=0.9):
    if hasattr(model, "coefficients"):
        return clusters.cluster(records, learning.classified_links(model, vecs, th))
    a, b = vecs.select("block", F.col("rid").alias("src")), vecs.select("block", F.col("rid").alias("dst"))
    pairs = a.join(b, "block").where("src < dst")
    return clusters.similarity_clusters(records, learning.classified_pairs(model, pairs, vecs), th)


def build(spec: dict) -> Callable[..., DataFrame]:
    """``{"class": name, "attributes": {...}}`` as a function of (records, features, vectors). An unknown name raises."""
    if spec["class"] not in CLUSTERERS:
        raise KeyError(f"no such clusterer: {spec['class']}; known: {', '.join(sorted(CLUSTERERS))}")
    f, attributes = CLUSTERERS[spec["class"]], spec.get("attributes", {})
    return lambda records, feats=None, vecs=None: f(records, feats, vecs, **attributes)


def experiment(records: DataFrame, feats: DataFrame | None, vecs: DataFrame | None, truth: DataFrame, specs: dict[str, dict]) -> DataFrame:
    """One report row per named clusterer. ``truth(block, rid, truth)``; results without a truth stay, with an unknown one."""
    out = None
    for name, spec in specs.items():
        got = build(spec)(records, feats, vecs).withColumnsRenamed({"blocking_field": "block", "unique_id": "rid", "ClusterID": "cluster"})
        row = quality.report(quality.block_metrics(got.join(truth, ["block", "rid"], "left"))).select(F.lit(name).alias("name"), "*")
        out = row if out is None else out.union(row)
    return out


def main(argv: list[str] | None = None) -> None:
    """``python -m knotwork.registry --records R --truth T --specs S.json --out O [--features F] [--vectors V]`` on parquet inputs."""
    p = argparse.ArgumentParser(description=main.__doc__)
    for name, needed in (("records", True), ("truth", True), ("specs", True), ("out", True), ("features", False), ("vectors", False)):
        p.add_argument(f"--{name}", required=needed)
    a = p.parse_args(argv)
    spark = SparkSession.builder.getOrCreate()
    read = lambda path: providers.read_parquet(spark, path) if path else None
    with open(a.specs) as f:
        specs = json.load(f)
    sinks.save(experiment(read(a.records), read(a.features), read(a.vectors), read(a.truth), specs), a.out)


if __name__ == "__main__":
    main()
