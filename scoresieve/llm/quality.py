"""Quality classifier: naive-Bayes-scaled n-gram indicators under a linear hinge-loss model."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .hashing import SPACES, WordHasher, mix, text_bytes
from .scratch import stored

#: Hash range of each of the three kinds of n-grams: of three bytes, of one word, of two words.
RANGE = 1 << 16
#: Those, and 48 for how much repeats.
FEATURES = 3 * RANGE + 48
#: Labelled documents to fit on, for each class: those with the smallest hashes of their ids.
TRAIN_PER_CLASS = 1500
#: Features of all of them together, four bytes each; in the order of hashes, documents beyond that are left out.
TRAIN_FEATURES = 32_000_000
ACCEPT = 0.7


@dataclass
class Model:
    ratio: np.ndarray  # log-count ratio of each feature
    weight: np.ndarray  # weight of each feature, times its ratio
    bias: float
    slope: float
    shift: float


def _ids(data: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Features of a text, with repeats."""
    found = []
    if len(data) >= 3:
        b = data.astype(np.uint32)
        tri = b[:-2] | (b[1:-1] << np.uint32(8)) | (b[2:] << np.uint32(16))
        found.append(((tri * np.uint32(0x9E3779B1)) >> np.uint32(16)).astype(np.int32))
    found.append((words >> np.uint64(48)).astype(np.int32) + RANGE)
    if len(words) > 1:
        found.append((mix(words[:-1] * np.uint64(0x9E3779B97F4A7C15) + words[1:]) >> np.uint64(48)).astype(np.int32) + 2 * RANGE)
    # How n-grams recur: the share of words that repeat the one before, of words seen before, and of pairs seen before, in tenths.
    n = len(words)
    if n > 1:
        pairs = mix(words[:-1] * np.uint64(0x9E3779B97F4A7C15) + words[1:])
        shares = (np.mean(words[1:] == words[:-1]), 1 - len(np.unique(words)) / n, 1 - len(np.unique(pairs)) / (n - 1))
        found.append(np.array([3 * RANGE + 16 * i + int(math.ceil(10 * x)) for i, x in enumerate(shares)], np.int32))
    return np.concatenate(found)


def _texts(batch: pa.RecordBatch, column: int, hasher: WordHasher):
    """The features of each row's text."""
    data, offsets = text_bytes(batch.column(column))
    for i, words in enumerate(hasher.words(batch.column(column))):
        yield _ids(data[offsets[i] : offsets[i + 1]], words)


def _features(batches):
    hasher = WordHasher(SPACES, keep_case=True)
    for batch in batches:
        for at in range(0, batch.num_rows, 64):
            part = batch.slice(at, 64)
            found = [np.unique(x) for x in _texts(part, 2, hasher)]
            offsets = np.r_[0, np.cumsum([len(x) for x in found])].astype(np.int32)
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(found).astype(np.int32)))], ["y", "h", "ids"])


def _descend(rows: list[np.ndarray], y: np.ndarray, ratio: np.ndarray, rounds: int = 15, c: float = 1.0) -> tuple[np.ndarray, float]:
    """Dual coordinate descent for the L1-loss linear SVM; each row is a unit vector of ratios, and a bias feature of 1."""
    values = [ratio[x] / max(1e-12, float(np.sqrt(np.sum(ratio[x] ** 2)))) for x in rows]
    square = np.array([float(v @ v) + 1.0 for v in values])
    alpha, w, bias = np.zeros(len(rows)), np.zeros(len(ratio)), 0.0
    order = np.random.default_rng(7)
    for _ in range(rounds):
        moved = 0.0
        for i in order.permutation(len(rows)):
            slope = y[i] * (float(w[rows[i]] @ values[i]) + bias) - 1.0
            new = min(max(alpha[i] - slope / square[i], 0.0), c)
            step = (new - alpha[i]) * y[i]
            if step:
                w[rows[i]] += step * values[i]
                bias += step
                moved = max(moved, abs(step))
                alpha[i] = new
        if moved < 1e-3:
            break
    return w, bias


def _margin(x: np.ndarray, ratio: np.ndarray, scaled: np.ndarray, bias: float) -> float:
    return float(scaled[x].sum()) / max(1e-12, float(np.sqrt(np.sum(ratio[x] ** 2)))) + bias


def _calibrated(margins: np.ndarray, y: np.ndarray, weights: np.ndarray) -> tuple[float, float]:
    """Slope and shift of a logistic curve through the margins, by Newton steps; class weights restore the classes' shares."""
    t = np.where(y > 0, 1 - 1 / (2 + (y > 0).sum()), 1 / (2 + (y < 0).sum()))
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * margins + b, -30, 30)))
        g, h = weights * (p - t), weights * p * (1 - p)
        grad = np.array([(g * margins).sum() + 1e-3 * a, g.sum()])
        hess = np.array([[(h * margins * margins).sum() + 1e-3, (h * margins).sum()], [(h * margins).sum(), h.sum() + 1e-6]])
        step = np.linalg.solve(hess, grad)
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-8:
            break
    return max(a, 0.0), b


def fitted(rows: list[np.ndarray], y: np.ndarray, share: float) -> Model:
    """Fit on rows of feature ids with classes y (1 and -1); share: of class 1 among all labelled rows."""
    if not len(y) or abs(int(y.sum())) == len(y):  # nothing to tell apart
        return Model(np.zeros(FEATURES), np.zeros(FEATURES), 0.0, 0.0, float(np.log((share + 1e-3) / (1 - share + 1e-3))))

    def counts(keep: np.ndarray) -> np.ndarray:
        out = []
        for sign in (1, -1):
            own = np.ones(FEATURES)
            for i in np.flatnonzero((y == sign) & keep):
                own[rows[i]] += 1
            out.append(own / own.sum())
        return np.log(out[0] / out[1])

    def fit(keep: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
        ratio = counts(keep)
        w, bias = _descend([rows[i] for i in np.flatnonzero(keep)], y[keep], ratio)
        return ratio, w * ratio, bias

    held = np.arange(len(y)) % 4 == 3
    if abs(int(y[~held].sum())) == (~held).sum() or not held.any():
        held = np.zeros(len(y), bool)
    part = fit(~held)
    check = held if held.any() else ~held
    margins = np.array([_margin(rows[i], *part) for i in np.flatnonzero(check)])
    true = y[check]
    weights = np.where(true > 0, share / max(1, (true > 0).sum()), (1 - share) / max(1, (true < 0).sum())) * len(true)
    slope, shift = _calibrated(margins, true, weights)
    ratio, weight, bias = fit(np.ones(len(y), bool)) if held.any() else part
    return Model(ratio, weight, bias, slope, shift)


def learned(docs: DataFrame, labels: DataFrame, trains: Column, per_class: int = TRAIN_PER_CLASS, most_features: int = TRAIN_FEATURES, label: str = "quality", id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Fit on at most per_class labelled documents of each class, and at most most_features features of theirs.

    labels: rows of id_col and label (1 or 0; others and nulls are ignored; the smaller one of an id with both).
    trains: condition on id_col for rows that may be learned from.
    """
    own = labels.where(F.col(label).isin(0, 1) & F.col(id_col).isNotNull() & trains).groupBy(id_col).agg(F.min(label).alias("y"))
    n = {r["y"]: r["count"] for r in own.groupBy("y").count().collect()}
    pick = lambda y: own.where(F.col("y") == y).orderBy(F.xxhash64(F.col(id_col)), id_col).limit(per_class)
    chosen = pick(1).union(pick(0)).withColumnRenamed(id_col, "_id")
    own = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("text")).join(F.broadcast(chosen), "_id")
    sample = own.groupBy("_id", "y").agg(F.min_by("text", F.xxhash64("text")).alias("text"))  # of rows that share an id, one text
    found = stored(sample.select(F.col("y").cast("int").alias("y"), F.xxhash64("_id").alias("h"), "text").mapInArrow(_features, "y int, h long, ids array<int>"), "labelled")
    # At most two classes' documents, so one window holds few rows.
    before = F.sum(F.size("ids")).over(Window.orderBy("h").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    within = found.select("h", before.alias("n")).where(F.col("n") <= most_features).agg(F.max("h")).first()[0]
    table = found.where(F.col("h") <= F.lit(within)).select("y", "ids").toArrow() if within is not None else found.limit(0).select("y", "ids").toArrow()
    ids = table.column("ids").combine_chunks()
    rows = [np.asarray(ids[i].values) for i in range(len(ids))]
    y = np.where(np.asarray(table.column("y")) == 1, 1, -1) if len(ids) else np.zeros(0, int)
    order = sorted(range(len(rows)), key=lambda i: (int(y[i]), len(rows[i]), rows[i][:40].tolist(), int(rows[i].sum())))  # the same however rows arrive
    return fitted([rows[i] for i in order], y[order], n.get(1, 0) / max(1, sum(n.values())))


def scores(texts: Column, model: Model) -> Column:
    """Probability of class 1 for each whole text; null counts as empty."""
    ratio2, scaled = (model.ratio**2).astype(np.float32), model.weight.astype(np.float32)
    bias, slope, shift = model.bias, model.slope, model.shift

    @F.arrow_udf("double")
    def score(column: pa.Array) -> pa.Array:
        hasher, stamp, out = WordHasher(SPACES, keep_case=True), np.zeros(FEATURES, np.int32), []
        batch = pa.RecordBatch.from_arrays([column], ["text"])
        for at in range(0, batch.num_rows, 64):
            for ids in _texts(batch.slice(at, 64), 0, hasher):
                place = np.arange(len(ids), dtype=np.int32)
                stamp[ids] = place
                ids = ids[stamp[ids] == place]  # each feature once
                norm = float(np.sqrt(ratio2[ids].sum(dtype=np.float64)))
                z = slope * (float(scaled[ids].sum(dtype=np.float64)) / max(1e-12, norm) + bias) + shift
                out.append(1 / (1 + float(np.exp(-min(max(z, -30.0), 30.0)))))
        return pa.array(out, pa.float64())

    return score(texts)


def scored(docs: DataFrame, labels: DataFrame, trains: Column, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """docs with ``quality_score`` (0 to 1) and ``quality_predicted`` (1 if the score is at least 0.7), learned from labels.

    Every text is read whole; null texts count as empty. Rows are scored one by one, so null ids, repeated rows and ties
    do no harm. Without labels of both classes every score is the share of class 1 (1/2 if there are none).
    An empty table gives no rows. Columns of the added names are replaced.
    """
    model = learned(docs, labels, trains, id_col=id_col, text_col=text_col, **options)
    out = docs.withColumn("quality_score", scores(F.col(text_col), model))
    return out.withColumn("quality_predicted", (F.col("quality_score") >= ACCEPT).cast("int"))
