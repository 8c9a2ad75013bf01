"""Weighted scores: flat, and by layers of metric groups."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.expressions import double, finite, min_max, weighted_sum


def weighted(index: DataFrame, weights: Mapping[str, float], name: str = "_weighted_score") -> DataFrame:
    """Add the weighted sum of the index's columns."""
    return index.withColumn(name, weighted_sum({k: F.col(k) for k in weights}, weights))


def final_score(pool: DataFrame, weights: Mapping[str, float], scores: str = "scores", name: str = "final_score") -> DataFrame:
    """Add the weighted sum of a map's entries; missing and null ones count as 0; null where there is no map."""
    values = {k: F.coalesce(F.col(scores)[k], double(0.0)) for k in weights}
    return pool.withColumn(name, F.when(F.col(scores).isNotNull(), weighted_sum(values, weights)))


def final_score_wide(table: DataFrame, weights: Mapping[str, float], name: str = "final_score") -> DataFrame:
    """As ``final_score`` for columns; null where all of them are."""
    values = {k: F.coalesce(F.col(k).cast("double"), double(0.0)) for k in weights}
    some = F.coalesce(*(F.col(k).cast("double") for k in weights)).isNotNull() if weights else F.lit(True)
    return table.withColumn(name, F.when(some, weighted_sum(values, weights)))


def layer_sums(table: DataFrame, clusters: Mapping[str, Mapping[str, float]]) -> DataFrame:
    """Add ``<cluster>_orig``: each cluster's weighted sum of the input columns; missing ones count as 0."""
    return table.withColumns({f"{c}_orig": weighted_sum({k: F.coalesce(F.col(k).cast("double"), double(0.0)) for k in w}, w) for c, w in clusters.items()})


def layer_scores(table: DataFrame, clusters: Mapping[str, Mapping[str, float]]) -> DataFrame:
    """Add each cluster's sum as ``<cluster>_orig`` and, scaled to [0, 1] over all rows, as ``<cluster>``.

    One aggregation for all extremes, whose two numbers a cluster go into the projection as literals. Sums that are not
    finite take no part in the extremes; a cluster whose sums all agree is 0.5 everywhere.
    """
    summed = layer_sums(table, clusters)
    row = summed.agg(*(f(finite(F.col(f"{c}_orig"))).alias(f"{n}_{i}") for i, c in enumerate(clusters) for n, f in (("lo", F.min), ("hi", F.max)))).first() if clusters else {}
    new = {}
    for i, c in enumerate(clusters):
        low, high = row[f"lo_{i}"], row[f"hi_{i}"]
        new[c] = min_max(F.col(f"{c}_orig"), double(low), double(high)) if low is not None else F.lit(None).cast("double")
    return summed.withColumns(new)
