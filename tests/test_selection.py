"""Tie rules, quotas, normalisation and scores against plain Python."""

import heapq
import math
import random

import pytest
from pyspark.sql import functions as F

from scoresieve.functions import expressions, weighting
from scoresieve.operators import normalize, scoring, selection
from scoresieve.sources import index


def heap_top(scores, k):
    """A bounded heap fed in line order."""
    heap = []
    for i, s in enumerate(scores):
        if len(heap) < k:
            heapq.heappush(heap, (s, i))
        elif s > heap[0][0]:
            heapq.heapreplace(heap, (s, i))
    return sorted(i for _, i in heap)


def frame(spark, scores, groups=None):
    return spark.createDataFrame([(i, s, None if groups is None else groups[i]) for i, s in enumerate(scores)], "line_idx long, score double, g string")


@pytest.mark.parametrize("seed", range(6))
def test_top_k_rules(spark, seed):
    rng = random.Random(seed)
    scores = [float(rng.randint(0, 5)) for _ in range(rng.randint(1, 60))]
    k = rng.randint(1, 70)
    t = frame(spark, scores)
    assert sorted(r["line_idx"] for r in selection.top_k_heap(t, "score", k).collect()) == heap_top(scores, k)
    want = sorted(range(len(scores)), key=lambda i: (-scores[i], i))[:k]
    assert [r["line_idx"] for r in selection.top_k(t, "score", k).collect()] == want


def file_order(rows, percent):
    keep = max(1, math.ceil(len(rows) * (percent / 100.0)))
    threshold = sorted((s for _, s in rows), reverse=True)[keep - 1]
    return [i for i, s in rows if s >= threshold][:keep]


@pytest.mark.parametrize(("seed", "percent", "block", "small"), [(1, 7, 1 << 16, 100_000), (2, 30, 4, 100_000), (3, 100, 8, 3), (4, 0.5, 2, 3), (5, 50, 4, 3)])
def test_top_percent_rules(spark, seed, percent, block, small, monkeypatch):
    monkeypatch.setattr(selection, "BLOCK", block)
    monkeypatch.setattr(selection, "SMALL_GROUP", small)
    rng = random.Random(seed)
    n = 120
    scores = [None if rng.random() < 0.05 else float("nan") if rng.random() < 0.03 else float(rng.randint(0, 9)) for _ in range(n)]
    groups = [None if rng.random() < 0.05 else rng.choice("aaab") for _ in range(n)]
    t = frame(spark, scores, groups)
    ok = [(i, s) for i, s in enumerate(scores) if s is not None and not math.isnan(s)]
    want = sorted(i for g in "ab" for i in file_order([(i, s) for i, s in ok if groups[i] == g], percent))
    assert sorted(r["line_idx"] for r in selection.top_percent(t, "score", percent, "g").collect()) == want
    assert sorted(r["line_idx"] for r in selection.top_percent(t, "score", percent).collect()) == sorted(file_order(ok, percent))
    strict = []
    for g in "ab":
        own = sorted(((i, s) for i, s in ok if groups[i] == g), key=lambda x: (-x[1], x[0]))
        strict += [i for i, _ in own[: max(1, math.ceil(len(own) * (percent / 100.0)))]]
    assert sorted(r["line_idx"] for r in selection.top_percent(t, "score", percent, "g", mode="strict").collect()) == sorted(strict)


@pytest.mark.parametrize("seed", range(3))
def test_brackets_are_narrowed(spark, seed, monkeypatch):
    """Thresholds of groups too large for one bracket."""
    monkeypatch.setattr(selection, "SMALL_GROUP", 20)
    monkeypatch.setattr(selection, "ACCURACY", 100)
    rng = random.Random(seed)
    scores = [rng.gauss(0, 1) if rng.random() < 0.7 else float(rng.randint(0, 3)) for _ in range(4000)]
    groups = [rng.choice("aaaaab") for _ in scores]
    got = {r["group"]: (r["n"], r["n_keep"], r["threshold"]) for r in selection.quotas(frame(spark, scores, groups), "score", 13, "g").collect()}
    for g in "ab":
        own = sorted((s for s, x in zip(scores, groups, strict=True) if x == g), reverse=True)
        keep = max(1, math.ceil(len(own) * 0.13))
        assert got[g] == (len(own), keep, own[keep - 1])


@pytest.mark.parametrize("seed", range(3))
def test_percentiles_between_brackets(spark, seed, monkeypatch):
    """Exact percentiles where values are too many for one task."""
    import numpy as np

    monkeypatch.setattr(normalize, "MOST_VALUES", 15)
    monkeypatch.setattr(normalize, "ONE_PASS", 0)
    monkeypatch.setattr(normalize, "ACCURACY", 100)
    rng = random.Random(seed)
    rows = [(rng.gauss(0, 1), float(rng.randint(0, 3)), rng.choice([None, float("nan"), rng.random()]), None) for _ in range(3000)]
    t = spark.createDataFrame(rows, "a double, b double, c double, d double")
    for low, high in ((0, 100), (5, 95), (33.3, 33.4)):
        got = {r["key"]: (r["lb"], r["ub"], r["n"]) for r in normalize.bounds(t, ["a", "b", "c", "d"], low, high).collect()}
        for i, key in enumerate("abc"):
            own = np.array([r[i] for r in rows if r[i] is not None and r[i] == r[i]])
            assert np.allclose(got[key][:2], np.percentile(own, [low, high]), atol=1e-12) and got[key][2] == len(own)
        assert "d" not in got


def test_columns_of_any_name(spark):
    t = frame(spark, [float(i % 7) for i in range(50)], ["a"] * 50).withColumns({x: F.lit(1) for x in ("_t", "_k", "_q", "_g", "_b", "_c", "key", "threshold", "group", "n_keep", "b", "c", "before", "rank")})
    for mode in ("file_order", "strict"):
        got = selection.top_percent(t, "score", 20, "g", mode=mode)
        assert got.columns == t.columns and got.count() == 10
    quota = selection.quotas(t, "score", 20, "g")
    assert selection.unfilled(selection.top_percent(t, "score", 20, "g").limit(4), quota, "g").collect()[0]["taken"] == 4


def test_quota_is_a_binary_product(spark):
    q = selection.quotas(frame(spark, [float(i) for i in range(100)]), "score", 7).first()
    assert (q["n_keep"], q["threshold"]) == (8, 92.0)


def test_selection_edge_cases(spark):
    t = frame(spark, [])
    assert selection.top_percent(t, "score", 10).count() == 0 and selection.top_k_heap(t, "score", 3).count() == 0
    for wrong in (0, -1, 101):
        with pytest.raises(ValueError):
            selection.quotas(t, "score", wrong)
    with pytest.raises(ValueError):
        selection.top_k(t, "score", 0)
    assert sorted(r["line_idx"] for r in selection.top_percent(frame(spark, [5.0, 5.0, 9.0]), "score", 60).collect()) == [0, 1]


def test_normalization_rules(spark):
    nan, inf = float("nan"), float("inf")
    t = spark.createDataFrame([(i, float(i), 3.0, None if i % 2 else nan) for i in range(101)] + [(200, inf, 3.0, None)], "line_idx long, a double, c double, empty double")
    limits = normalize.bounds_dict(normalize.bounds(t, ["a", "c", "empty"], 5, 95))
    assert limits == {"a": (5.0, 95.0), "c": (3.0, 3.0)}
    rows = {r["line_idx"]: r for r in normalize.normalized(t, limits, ["a", "c"], True).collect()}
    assert rows[0]["a"] == 1.0 and rows[100]["a"] == 0.0 and rows[50]["a"] == 0.5 and rows[50]["a_orig"] == 50.0
    assert rows[7]["c"] == 1.0 and rows[200]["a"] == inf
    stats = {r["key"]: r for r in normalize.clip_stats(t, limits).collect()}
    assert (stats["a"]["clipped"], stats["a"]["total"]) == (10, 101) and stats["c"]["clipped"] == 0
    m = spark.createDataFrame([(1, {"a": 50.0, "b": 2.0, "a_orig": 9.0})], "line_idx long, scores map<string,double>")
    assert normalize.normalized_map(m, {"a": (0.0, 100.0)}, (), True).first()["scores"] == {"a": 0.5, "b": 2.0, "a_orig": 50.0}
    with pytest.raises(ValueError):
        normalize.bounds(t, ["a"], 50, 50)


def test_scores(spark):
    pool = spark.createDataFrame([(0, {"a": 1.0, "b": 2.0}), (1, {"a": None}), (2, None)], "line_idx long, scores map<string,double>")
    got = [r["final_score"] for r in scoring.final_score(pool, {"a": 0.5, "b": 0.25, "x": 9.0}).orderBy("line_idx").collect()]
    assert got == [1.0, 0.0, None]
    t = spark.createDataFrame([(0, 1.0, None), (1, 3.0, 1.0), (2, float("nan"), 2.0)], "line_idx long, a double, b double")
    out = {r["line_idx"]: r for r in scoring.layer_scores(t, {"Layer1_c1": {"a": 1.0}, "Layer1_c2": {"b": 0.0}}).collect()}
    assert (out[0]["Layer1_c1"], out[1]["Layer1_c1"]) == (0.0, 1.0) and out[0]["Layer1_c2"] == 0.5
    with pytest.raises(Exception, match="no score b"):
        index.strict_vectors(pool.where("line_idx = 1"), ["b"]).collect()
    assert index.build_index(pool, ["b"]).orderBy("line_idx").collect()[1]["b"] == 0.0


def test_weights():
    assert weighting.softmax([]) == [] and abs(sum(weighting.softmax([1.0, 900.0])) - 1) < 1e-12
    assert weighting.linear([], 0.0) == []
    for method, span in (("softmax", (-5.0, 5.0)), ("linear", (0.0, 1.0))):
        w = {"a": 0.2, "b": 0.3, "c": 0.5}
        z = weighting.parameters_of(w, list(w), method, span)
        back = weighting.weights_of([z[f"z_{k}"] for k in w], method, span)
        assert all(abs(x - y) < 1e-6 for x, y in zip(back, w.values(), strict=True))
    assert weighting.parameters_of({}, ["a", "b"], "linear", (0.0, 2.0)) == {"z_a": 1.0, "z_b": 1.0}
    with pytest.raises(ValueError):
        weighting.weights_of([1.0], "other", (0.0, 1.0))
    assert weighting.good_trials(31) == 4 and weighting.good_trials(10_000) == 25
    assert weighting.signature({"a": 1.0, "b": 2.0, "x": 1.0}, ["a", "b", "c"]) == (0.25, 0.5, 0.0)


def test_plans_prune_and_push_down(spark, tmp_path):
    spark.range(1000).select(F.col("id").alias("line_idx"), *(F.rand().alias(k) for k in "abcd")).write.parquet(str(tmp_path / "i"))
    from scoresieve.plans.search import select

    plan = select(index.load_index(spark, str(tmp_path / "i")), {"a": 1.0, "c": 0.5}, 10)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan and "ReadSchema: struct<line_idx:bigint,a:double,c:double>" in plan
    assert "Exchange" not in plan
    assert expressions.all_of(["a"], F.col)
