"""Correlation of metrics, and clusters of metrics."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from itertools import combinations, combinations_with_replacement

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.expressions import double, finite

METHODS = ("ward", "complete", "average", "single")


def sample_rows(table: DataFrame, n: int, seed: int = 42, line: str = "line_idx", total: int | None = None) -> DataFrame:
    """n rows without replacement, the same for the same seed; all rows if n is at least 0.9 of them. total: how many there are, if known."""
    if n >= 0.9 * (table.count() if total is None else total):
        return table
    return table.orderBy(F.xxhash64(F.col(line), F.lit(seed)), line).limit(n)


def available(table: DataFrame, wanted: Sequence[str]) -> tuple[list[str], list[str]]:
    """Wanted metrics that the table has, and those it has not; having none is an error."""
    have = [k for k in wanted if k in table.columns]
    if not have:
        raise ValueError("none of the wanted metrics exists")
    return have, [k for k in wanted if k not in table.columns]


def missing_counts(table: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``key, missing``: rows without a number."""
    rows = [F.struct(F.lit(k).alias("key"), F.count_if(F.col(k).isNull() | F.isnan(F.col(k).cast("double"))).alias("missing")) for k in keys]
    return table.agg(F.array(*rows).alias("_")).select(F.inline("_"))


def varying(table: DataFrame, keys: Sequence[str]) -> list[str]:
    """The keys with at least two different finite values; others have no correlation."""
    row = table.agg(*(f(finite(F.col(k).cast("double"))).alias(f"{n}_{i}") for i, k in enumerate(keys) for n, f in (("lo", F.min), ("hi", F.max)))).first()
    return [k for i, k in enumerate(keys) if row[f"lo_{i}"] is not None and row[f"lo_{i}"] < row[f"hi_{i}"]]


def correlations(table: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``key_a, key_b, corr`` for each pair of keys, pairwise complete, in one aggregation; null where a column is constant."""
    rows = []
    for a, b in combinations_with_replacement(keys, 2):
        x, y = finite(F.col(a).cast("double")), finite(F.col(b).cast("double"))
        both = x.isNotNull() & y.isNotNull()
        x, y = F.when(both, x), F.when(both, y)
        varies = (F.min(x) < F.max(x)) & (F.min(y) < F.max(y))  # merged deviations of a constant need not be exactly 0
        r = F.when(varies, F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y)))
        rows.append(F.struct(F.lit(a).alias("key_a"), F.lit(b).alias("key_b"), F.when(r.isNotNull(), double(1.0) if a == b else F.greatest(F.least(r, double(1.0)), double(-1.0))).alias("corr")))
    return table.agg(F.array(*rows).alias("_")).select(F.inline("_"))


def distances(corr: DataFrame, absolute: bool = False) -> DataFrame:
    """``key_a, key_b, distance``: 1 - r or 1 - |r|, at least 0; 0 for a key and itself."""
    r = F.abs("corr") if absolute else F.col("corr")
    d = F.when(F.col("key_a") == F.col("key_b"), double(0.0)).when(r.isNotNull(), F.greatest(double(1.0) - r, double(0.0)))
    return corr.select("key_a", "key_b", d.alias("distance"))


def matrix(long: DataFrame, keys: Sequence[str], value: str) -> np.ndarray:
    """A symmetric matrix on the driver: one number for each pair of metrics."""
    at = {k: i for i, k in enumerate(keys)}
    out = np.zeros((len(keys), len(keys)))
    for a, b, v in long.select("key_a", "key_b", value).collect():
        if a in at and b in at:
            out[at[a], at[b]] = out[at[b], at[a]] = np.nan if v is None else v
    return out


def linkage(distance: np.ndarray, method: str = "ward") -> np.ndarray:
    """Agglomerative merges of a distance matrix: rows of the two clusters' numbers, height and size (Lance-Williams updates).

    Cluster numbers go on from the n leaves; ties merge the pair with the smallest numbers.
    """
    if method not in METHODS:
        raise ValueError(f"method must be one of {METHODS}")
    n = len(distance)
    d = {frozenset(p): float(distance[p]) for p in combinations(range(n), 2)}
    size = dict.fromkeys(range(n), 1)
    merges = []
    for new in range(n, 2 * n - 1):
        a, b = sorted(min(d, key=lambda p: (d[p], sorted(p))))
        height = d.pop(frozenset((a, b)))
        na, nb = size.pop(a), size.pop(b)
        for c, nc in size.items():
            x, y = d.pop(frozenset((a, c))), d.pop(frozenset((b, c)))
            if method == "single":
                z = min(x, y)
            elif method == "complete":
                z = max(x, y)
            elif method == "average":
                z = (na * x + nb * y) / (na + nb)
            else:
                z = float(np.sqrt(max(0.0, ((na + nc) * x * x + (nb + nc) * y * y - nc * height * height) / (na + nb + nc))))
            d[frozenset((new, c))] = z
        size[new] = na + nb
        merges.append((a, b, height, na + nb))
    return np.array(merges, float).reshape(-1, 4)


def flat_clusters(merges: np.ndarray, n: int, most: int | None = None, height: float | None = None) -> list[int]:
    """Cluster numbers (from 1) of the n leaves: at most `most` clusters, or all merges up to a height (default: 70th percentile of heights)."""
    if most is None and height is None:
        height = float(np.percentile(merges[:, 2], 70)) if len(merges) else 0.0
    done = len(merges) - (min(most, n) - 1) if most is not None else int((merges[:, 2] <= height).sum())
    root = list(range(2 * n))

    def find(x: int) -> int:
        while root[x] != x:
            x = root[x]
        return x

    for i, (a, b, *_) in enumerate(merges[:done]):
        root[find(int(a))] = root[find(int(b))] = n + i
    names: dict[int, int] = {}
    return [names.setdefault(find(i), len(names) + 1) for i in range(n)]


def leaf_order(merges: np.ndarray, n: int) -> list[int]:
    """Leaves from left to right in the tree of merges."""
    def leaves(x: int) -> list[int]:
        return [x] if x < n else leaves(int(merges[x - n, 0])) + leaves(int(merges[x - n, 1]))

    return leaves(2 * n - 2) if n > 1 else list(range(n))


def metric_clusters(table: DataFrame, keys: Sequence[str], n: int | None = None, method: str = "ward", absolute: bool = False) -> dict[str, int]:
    """Cluster metrics by correlation; constant and empty ones are left out."""
    own = varying(table, keys)
    merges = linkage(matrix(distances(correlations(table, own), absolute), own, "distance"), method)
    return dict(zip(own, flat_clusters(merges, len(own), n), strict=True))


def within_clusters(corr: DataFrame, clusters: Mapping[str, int]) -> DataFrame:
    """``cluster, n_metrics, mean_corr``: mean over the pairs of different metrics of each cluster (null for single ones)."""
    of = corr.sparkSession.createDataFrame(sorted(clusters.items()), "key string, cluster int")
    a, b = of.select(F.col("key").alias("key_a"), "cluster"), of.select(F.col("key").alias("key_b"), F.col("cluster").alias("other"))
    pairs = corr.where("key_a <> key_b").join(F.broadcast(a), "key_a").join(F.broadcast(b), "key_b").where("cluster = other")
    means = pairs.groupBy("cluster").agg(F.avg("corr").alias("mean_corr"))
    return of.groupBy("cluster").agg(F.count(F.lit(1)).alias("n_metrics")).join(means, "cluster", "left")


def reordered(corr: DataFrame, clusters: Mapping[str, int]) -> DataFrame:
    """Data of a heat map: pairs in both directions with the places of their metrics, by cluster and then name."""
    order = [k for k, _ in sorted(clusters.items(), key=lambda x: (x[1], x[0]))]
    places = F.broadcast(corr.sparkSession.createDataFrame([(k, i) for i, k in enumerate(order)], "key string, place int"))
    both = corr.union(corr.where("key_a <> key_b").select("key_b", "key_a", "corr"))
    row, col = places.select(F.col("key").alias("key_a"), F.col("place").alias("row")), places.select(F.col("key").alias("key_b"), F.col("place").alias("col"))
    return both.join(row, "key_a").join(col, "key_b").select("row", "col", "key_a", "key_b", "corr").orderBy("row", "col")


def report(clusters: Mapping[str, int], names: Mapping[str, str] | None = None, means: Mapping[int, float | None] | None = None) -> str:
    """Clusters and their metrics as text."""
    out = []
    for c in sorted(set(clusters.values())):
        own = sorted(k for k, v in clusters.items() if v == c)
        mean = (means or {}).get(c)
        out.append(f"Cluster {c} ({len(own)} metrics" + (f", mean correlation {mean:.4f}" if mean is not None else "") + ")")
        out += [f"  {(names or {}).get(k, k)}" for k in own]
    return "\n".join(out) + "\n"
