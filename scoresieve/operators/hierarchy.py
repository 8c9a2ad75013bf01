"""Weights through layers of metric groups."""

from __future__ import annotations

import json
from collections.abc import Mapping
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.files import LAYER, discover_layers


def edges(spark: SparkSession, weights: Mapping[str, Mapping[str, float]]) -> DataFrame:
    """``parent, child, weight`` of a mapping of clusters to weights."""
    rows = [(p, c, float(w)) for p, own in sorted(weights.items()) for c, w in sorted(own.items())]
    return spark.createDataFrame(rows, "parent string, child string, weight double")


def _tops(links: DataFrame) -> DataFrame:
    """Clusters of the highest layer."""
    layer = F.regexp_extract("parent", r"^Layer(\d+)_c\d+$", 1).cast("int")
    own = links.where(F.col("parent").rlike(r"^Layer\d+_c\d+$")).select("parent", layer.alias("layer")).distinct()
    top = own.agg(F.max("layer").alias("top"))
    return own.join(F.broadcast(top), own["layer"] == top["top"]).select("parent")


def leaf_weights(links: DataFrame) -> DataFrame:
    """``cluster, leaf, weight``: the product of weights along each path from a cluster to a metric, summed over paths.

    A child named like a cluster that has no weights of its own contributes nothing. A cycle is an error.
    """
    parents = links.select(F.col("parent").alias("p"), F.col("child").alias("c"), F.col("weight").alias("w"))
    known = links.select(F.col("parent").alias("k")).distinct()
    front = links.select(F.col("parent").alias("cluster"), F.col("child").alias("node"), "weight")
    done = None
    for _ in range(known.count()):  # no path without a cycle is longer
        marked = front.join(known, front["node"] == known["k"], "left")
        leaves = marked.where("k is null").where(~F.col("node").rlike(r"^Layer\d+_c\d+$")).select("cluster", F.col("node").alias("leaf"), "weight")
        done = leaves if done is None else done.union(leaves)
        front = marked.where("k is not null").join(parents, F.col("node") == F.col("p")).select("cluster", F.col("c").alias("node"), (F.col("weight") * F.col("w")).alias("weight"))
        front = front.groupBy("cluster", "node").agg(F.sum("weight").alias("weight"))
        if front.isEmpty():
            return done.groupBy("cluster", "leaf").agg(F.sum("weight").alias("weight"))
    raise ValueError("the weights form a cycle")


def final_leaf_weights(links: DataFrame) -> DataFrame:
    """``leaf, weight``: the mean over the clusters of the highest layer; a leaf that one of them lacks counts as 0 there."""
    tops = _tops(links)
    n = tops.count()
    own = leaf_weights(links).join(tops, F.col("cluster") == F.col("parent"), "left_semi")
    return own.groupBy("leaf").agg((F.sum("weight") / F.lit(float(max(n, 1)))).alias("weight"))


def hierarchy(links: DataFrame) -> DataFrame:
    """``layer, cluster, children``: the children of each cluster, sorted."""
    layer = F.regexp_extract("parent", r"^Layer(\d+)_c\d+$", 1).cast("int")
    return links.where(F.col("parent").rlike(r"^Layer\d+_c\d+$")).groupBy(layer.alias("layer"), F.col("parent").alias("cluster")).agg(F.array_sort(F.collect_set("child")).alias("children"))


def summary(spark: SparkSession, root: str, out: str | None = None) -> dict:
    """Hierarchy, weights by cluster and final leaf weights of a folder of layers; written as JSON where out is given."""
    weights = discover_layers(root)
    if not weights:
        raise ValueError(f"no weights below {root}")
    links = edges(spark, weights)
    tree: dict[str, dict[str, list[str]]] = {}
    for r in hierarchy(links).orderBy("layer", "cluster").collect():
        tree.setdefault(f"Layer{r['layer']}", {})[r["cluster"]] = list(r["children"])
    by_cluster: dict[str, dict[str, float]] = {}
    for r in leaf_weights(links).orderBy("cluster", "leaf").collect():
        by_cluster.setdefault(r["cluster"], {})[r["leaf"]] = r["weight"]
    data = {"hierarchy": tree, "weights_by_cluster": by_cluster, "final_leaf_weights": {r["leaf"]: r["weight"] for r in final_leaf_weights(links).orderBy("leaf").collect()}, "meta": {"root": root}}
    if out:
        Path(out).write_text(json.dumps(data, indent=2, ensure_ascii=False))
    return data


def layer_number(cluster: str) -> int:
    m = LAYER.fullmatch(cluster)
    if not m:
        raise ValueError(f"{cluster} is no Layer<n>_c<m>")
    return int(m[1])
