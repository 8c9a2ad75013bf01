"""k-means over vectors, labels, and what joins them to records."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expressions import double

#: Bytes of centroids that go to every task.
MOST_CENTROIDS = 1 << 30


def _squared(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), double(0.0), lambda s, v: s + v)


def _doubles(c: str) -> Column:
    return F.transform(c, lambda x: x.cast("double"))


def _rows_of(lists: pa.Array, dim: int) -> np.ndarray:
    return lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(lists), dim)


def _closest(x: np.ndarray, centre: np.ndarray) -> np.ndarray:
    """Places of the nearest centres; products find them, and differences decide where several are as near as rounding can tell."""
    out = np.empty(len(x), np.int64)
    norm = (centre * centre).sum(1)
    step = max(1, (8 << 20) // max(1, len(centre)))
    for a in range(0, len(x), step):
        part = x[a : a + step]
        d = norm - 2 * (part @ centre.T)
        best = d.min(1)
        slack = 1e-9 * (np.abs(best) + (part * part).sum(1) + norm.max())
        out[a : a + step] = d.argmin(1)
        near = d <= (best + slack)[:, None]
        for i in np.flatnonzero(near.sum(1) > 1):
            own = np.flatnonzero(near[i])
            out[a + i] = own[((part[i] - centre[own]) ** 2).sum(1).argmin()]
    return out


def _table(centroids: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    rows = centroids.orderBy("cluster_id").select("cluster_id", "centroid").collect()
    matrix = np.array([r[1] for r in rows], np.float64)
    if matrix.nbytes > MOST_CENTROIDS:
        raise ValueError(f"{matrix.nbytes} bytes of centroids are more than MOST_CENTROIDS")
    return np.array([r[0] for r in rows], np.int64), matrix


def _sums(ids: np.ndarray, centre: np.ndarray):
    """Batches of vectors to one row for each cluster of a task: how many vectors, and their sum."""

    def run(batches):
        total, n = np.zeros_like(centre), np.zeros(len(ids), np.int64)
        for batch in batches:
            x = _rows_of(batch.column(0), centre.shape[1])
            at = _closest(x, centre)
            np.add.at(total, at, x)
            n += np.bincount(at, minlength=len(ids))
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(ids[some], pa.int64()), pa.array(n[some], pa.int64()), pa.array(list(total[some]), pa.list_(pa.float64()))], ["cluster_id", "n", "total"])

    return run


def nearest(vectors: DataFrame, centroids: DataFrame, vector: str = "vector") -> DataFrame:
    """vectors with the ``cluster_id`` of the nearest centroid (squared distance; ties to the smaller id); null where the vector is null.

    centroids: cluster_id, centroid. They are a parameter of K rows, MOST_CENTROIDS bytes at most: a matrix that goes to
    each task, which multiplies batches of vectors with it.
    """
    ids, centre = _table(centroids)
    kind = dict(centroids.dtypes)["cluster_id"]
    if not len(ids):
        return vectors.withColumn("cluster_id", F.lit(None).cast(kind))

    @F.arrow_udf("long")
    def label(column: pa.Array) -> pa.Array:
        known = column.is_valid().to_numpy(zero_copy_only=False)
        out = np.zeros(len(column), np.int64)
        if known.any():
            out[known] = ids[_closest(_rows_of(column.drop_null(), centre.shape[1]), centre)]
        return pa.array(out, pa.int64(), mask=~known)

    return vectors.withColumn("cluster_id", label(F.col(vector)).cast(kind))


def means(vectors: DataFrame, label: str = "cluster_id", vector: str = "vector") -> DataFrame:
    """``cluster_id, centroid``: the mean vector of each label, one aggregation without collecting rows."""
    places = vectors.select(F.col(label).alias("cluster_id"), F.posexplode(vector).alias("p", "v"))
    by_place = places.groupBy("cluster_id", "p").agg(F.avg(F.col("v").cast("double")).alias("m"))
    return by_place.groupBy("cluster_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("p", "m"))), lambda x: x["m"]).alias("centroid"))


def mini_batches(vectors: DataFrame, k: int, batch: int = 16_384, epochs: int = 10, seed: int = 42, starts: int = 3, tolerance: float = 1e-4, line: str = "line_idx", vector: str = "vector") -> tuple[DataFrame, DataFrame]:
    """Labels and centroids of mini-batch k-means: passes over batches of lines in order, until the centroids hardly move.

    Each batch is one job: tasks sum its vectors by nearest centroid, and a centroid becomes the mean of all vectors it
    was given so far. An epoch is a pass over all lines; it ends where the sum of the squared movements of an epoch is below
    the tolerance. The first centroids are the best of `starts` k-means++ draws from a sample of 3 k vectors (at least 1,000).
    On a cluster a batch should be a good part of the data: the number of jobs is epochs * lines / batch.
    """
    rows = vectors.where(F.col(vector).isNotNull()).select(F.col(line).cast("long").alias("line"), F.col(vector).alias("v"))
    low, high, n = rows.agg(F.min("line"), F.max("line"), F.count(F.lit(1))).first()
    spark = vectors.sparkSession
    if not n:
        return vectors.withColumn("cluster_id", F.lit(None).cast("int")), spark.createDataFrame([], "cluster_id int, centroid array<double>")
    sample = np.array([r[0] for r in rows.orderBy(F.xxhash64(F.lit(seed), "line")).limit(max(1000, 3 * k)).select("v").collect()], np.float64)
    rng = np.random.default_rng(seed)
    centre, _ = min((_spread(sample, min(k, n), rng) for _ in range(max(1, starts))), key=lambda x: x[1])
    ids, given = np.arange(len(centre)), np.zeros(len(centre))
    for _ in range(epochs):
        before = centre.copy()
        for a in range(low, high + 1, batch):
            got = rows.where((F.col("line") >= a) & (F.col("line") < a + batch)).select("v").mapInArrow(_sums(ids, centre), "cluster_id long, n long, total array<double>").toArrow()
            for i, m, total in zip(*(got.column(c).to_pylist() for c in range(3)), strict=True):
                given[i] += m
                centre[i] += (np.asarray(total) - m * centre[i]) / given[i]
        if ((centre - before) ** 2).sum() < tolerance:
            break
    centroids = spark.createDataFrame([(int(i), [float(x) for x in c]) for i, c in zip(ids, centre, strict=True)], "cluster_id int, centroid array<double>")
    return nearest(vectors, centroids, vector), centroids


def _spread(sample: np.ndarray, k: int, rng: np.random.Generator) -> tuple[np.ndarray, float]:
    """k-means++ centres of a sample, and the sum of squared distances to them."""
    at = [int(rng.integers(len(sample)))]
    d = ((sample - sample[at[0]]) ** 2).sum(1)
    while len(at) < min(k, len(sample)):
        at.append(int(rng.choice(len(sample), p=d / d.sum())) if d.sum() > 0 else int(rng.integers(len(sample))))
        d = np.minimum(d, ((sample - sample[at[-1]]) ** 2).sum(1))
    return sample[at].copy(), float(d.sum())


def lloyd_step(vectors: DataFrame, centroids: DataFrame, vector: str = "vector") -> DataFrame:
    """New centroids: the means of the vectors nearest to each old one; one without vectors stays."""
    new = means(nearest(vectors, centroids, vector), "cluster_id", vector)
    return centroids.select("cluster_id", F.col("centroid").alias("old")).join(new, "cluster_id", "left").select("cluster_id", F.coalesce("centroid", "old").alias("centroid"))


def shift(old: DataFrame, new: DataFrame) -> DataFrame:
    """``shift``: the sum of the squared movements of all centroids."""
    both = old.select("cluster_id", F.col("centroid").alias("a")).join(new.select("cluster_id", F.col("centroid").alias("b")), "cluster_id")
    return both.agg(F.coalesce(F.sum(_squared(F.col("a"), F.col("b"))), double(0.0)).alias("shift"))


def kmeans(vectors: DataFrame, k: int, epochs: int = 10, seed: int = 42, tolerance: float = 1e-4, vector: str = "vector") -> tuple[DataFrame, DataFrame]:
    """Labels (all columns and cluster_id) and centroids (cluster_id, centroid) of k-means||, at most epochs passes."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    data = vectors.withColumn("_features", array_to_vector(_doubles(vector)))
    held = data.select("_features").persist()
    try:
        model = KMeans(k=k, maxIter=epochs, seed=seed, tol=tolerance, featuresCol="_features", predictionCol="cluster_id").fit(held)
    finally:
        held.unpersist()
    rows = [(i, [float(x) for x in c]) for i, c in enumerate(model.clusterCenters())]
    centroids = vectors.sparkSession.createDataFrame(rows, "cluster_id int, centroid array<double>")
    labels = model.transform(data).drop("_features")
    return labels, centroids


def distribution(labels: DataFrame, label: str = "cluster_id") -> DataFrame:
    """``clusters, rows, largest, smallest, mean, median, std`` of cluster sizes (std of the population)."""
    sizes = sizes_of(labels, label)
    return sizes.agg(
        F.count(F.lit(1)).alias("clusters"), F.sum("n").alias("rows"), F.max("n").alias("largest"), F.min("n").alias("smallest"),
        F.avg("n").alias("mean"), F.median("n").alias("median"), F.stddev_pop("n").alias("std"),
    )


def sizes_of(labels: DataFrame, label: str = "cluster_id") -> DataFrame:
    return labels.groupBy(F.col(label).alias("cluster_id")).agg(F.count(F.lit(1)).alias("n"))


def size_histogram(labels: DataFrame, bins: int = 100, label: str = "cluster_id") -> DataFrame:
    """``bin, low, high, clusters``: how many clusters have sizes in each of at most `bins` equal ranges."""
    sizes = sizes_of(labels, label)
    low, high, n = sizes.agg(F.min("n"), F.max("n"), F.count(F.lit(1))).first()
    if not n:
        return sizes.select(F.lit(0).alias("bin"), F.col("n").cast("double").alias("low"), F.col("n").cast("double").alias("high"), F.col("n").alias("clusters")).limit(0)
    bins = max(1, min(bins, n, high - low + 1))
    width = (high - low) / bins or 1.0
    at = F.least(F.floor((F.col("n") - low) / double(width)), F.lit(bins - 1)).cast("int")
    return sizes.groupBy(at.alias("bin")).agg(F.count(F.lit(1)).alias("clusters")).select("bin", (F.col("bin") * width + low).alias("low"), ((F.col("bin") + 1) * width + low).alias("high"), "clusters")


def assign_clusters(pool: DataFrame, labels: DataFrame, line: str = "line_idx") -> DataFrame:
    """pool with the cluster_id of its line; an error if there are not as many labels as lines."""
    n, m = pool.count(), labels.count()
    if n != m:
        raise ValueError(f"{n} records, but {m} labels")
    return pool.drop("cluster_id").join(labels.select(line, "cluster_id"), line)


def merge_scores(pool: DataFrame, outputs: DataFrame, key: str = "id", scores: str = "scores", order: str | None = None) -> DataFrame:
    """pool with each record's metrics gathered into its map of scores, in place of older ones of the name; outputs: key, metric, score.

    Of several scores of a metric for one id the last by `order` (a column of outputs) counts, without one the largest.
    Null metrics and scores are left out.
    """
    value = F.col("score").cast("double")
    one = F.max_by(value, F.col(order)) if order else F.max(value)
    single = outputs.where(F.col("score").isNotNull() & F.col("metric").isNotNull()).groupBy(key, "metric").agg(one.alias("score"))
    found = single.groupBy(key).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("metric", "score")))).alias("_new"))  # an entry for each metric
    out = pool.join(found, key, "left")
    old = F.col(scores) if scores in pool.columns else F.create_map().cast("map<string,double>")
    empty = F.create_map().cast("map<string,double>")
    new = F.coalesce("_new", empty)
    return out.withColumn(scores, F.map_concat(F.map_filter(F.coalesce(old, empty), lambda k, v: ~F.map_contains_key(new, k)), new)).drop("_new")
