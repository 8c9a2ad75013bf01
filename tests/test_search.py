"""Clustering of metrics, search, trials and streams."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from scoresieve.operators import metrics, trials, vectors
from scoresieve.plans import search, tpe
from scoresieve.streaming.scoring import scored_stream, start


def test_correlations_and_clusters(spark):
    rng = np.random.default_rng(0)
    x = rng.standard_normal((300, 2))
    rows = [(float(a), float(2 * a + 0.01 * b), float(b), float(-b), 1.0, None) for a, b in x]
    t = spark.createDataFrame(rows, "a double, a2 double, b double, b2 double, const double, empty double")
    keys = t.columns
    corr = {(r["key_a"], r["key_b"]): r["corr"] for r in metrics.correlations(t, keys).collect()}
    assert abs(corr["a", "b"] - np.corrcoef(x.T)[0, 1]) < 1e-9 and corr["a", "const"] is None and corr["const", "const"] is None
    assert metrics.varying(t, keys) == ["a", "a2", "b", "b2"]
    got = metrics.metric_clusters(t, keys, 2, absolute=True)
    assert got["a"] == got["a2"] != got["b"] == got["b2"] and set(got) == {"a", "a2", "b", "b2"}
    assert len(set(metrics.metric_clusters(t, keys, 4).values())) == 4
    assert {r["key"]: r["missing"] for r in metrics.missing_counts(t, ["a", "empty"]).collect()} == {"a": 0, "empty": 300}
    assert metrics.available(t, ["a", "zz"]) == (["a"], ["zz"])
    with pytest.raises(ValueError):
        metrics.available(t, ["zz"])
    pairwise = spark.createDataFrame([(1.0, 2.0), (2.0, 4.0), (3.0, None), (None, 9.0), (4.0, 8.0)], "a double, b double")
    assert abs(metrics.correlations(pairwise, ["a", "b"]).where("key_a <> key_b").first()["corr"] - 1) < 1e-12


@pytest.mark.parametrize("method", metrics.METHODS)
def test_linkage_by_hand(method):
    """Points 0, 1, 5 and 9 on a line; heights follow from the definitions."""
    p = np.array([0.0, 1.0, 5.0, 9.0])
    merges = metrics.linkage(np.abs(p[:, None] - p), method)
    assert merges[0].tolist() == [0, 1, 1, 2] and merges[-1, 3] == 4
    second = {"single": 4.0, "complete": 4.0, "average": 4.0, "ward": 4.0}[method]
    assert abs(merges[1, 2] - second) < 1e-9
    last = {"single": 4.0, "complete": 9.0, "average": 6.5, "ward": np.sqrt(2) * 6.5}[method]
    assert abs(merges[2, 2] - last) < 1e-9
    assert metrics.flat_clusters(merges, 4, 4) == [1, 2, 3, 4] and metrics.flat_clusters(merges, 4, 1) == [1] * 4
    assert sorted(metrics.leaf_order(merges, 4)) == [0, 1, 2, 3]


def test_sample_is_repeatable(spark):
    t = spark.range(1000).withColumnRenamed("id", "line_idx")
    one, two = (sorted(r[0] for r in metrics.sample_rows(t.repartition(n), 50).collect()) for n in (1, 5))
    assert one == two and len(one) == 50 and metrics.sample_rows(t, 950).count() == 1000
    assert one != sorted(r[0] for r in metrics.sample_rows(t, 50, seed=1).collect())


def test_parzen_densities():
    p = tpe.Parzen(np.array([0.2, 0.8, 0.81]), 0.0, 1.0)
    x = np.linspace(0, 1, 20_001)
    assert abs(np.trapezoid(np.exp(p.log_density(x)), x) - 1) < 1e-3
    drawn = p.draw(np.random.default_rng(0), 500)
    assert drawn.min() >= 0 and drawn.max() <= 1


def test_proposals_improve():
    names, best = ["z_a", "z_b"], []
    for joint in (False, True):
        history = []
        for i in range(60):
            p = tpe.suggest(names, history, -5.0, 5.0, np.random.default_rng([3, i]), 10, lambda n: max(1, n // 10), 100, joint)
            history.append((p, (p["z_a"] - 2) ** 2 + (p["z_b"] + 1) ** 2))
        best.append(min(v for _, v in history))
        assert min(v for _, v in history) < 0.3 and np.mean([v for _, v in history[-15:]]) < np.mean([v for _, v in history[:10]])
        again = tpe.suggest(names, history, -5.0, 5.0, np.random.default_rng([3, 60]), 10, lambda n: max(1, n // 10), 100, joint)
        assert again == tpe.suggest(names, history, -5.0, 5.0, np.random.default_rng([3, 60]), 10, lambda n: max(1, n // 10), 100, joint)


def settings(**more):
    return search.Settings(["a", "b"], 10, "linear", (0.0, 1.0), startup=4, candidates=40, **more)


@pytest.fixture
def scores(spark):
    return spark.range(200).select(F.col("id").alias("line_idx"), (F.col("id") / 200.0).alias("a"), F.lit(0.5).alias("b"))


def test_search_from_start_to_resume(spark, scores, tmp_path):
    store = f"sqlite:///{tmp_path}/s/trials.db"
    study = search.Study(store, "x")
    s = settings()
    assert search.enqueue(study, [{"a": 0.9, "b": 0.1}, {"a": 9, "b": 1}, {"a": 0.5, "b": 0.5}], s) == {"new": 2, "retry": 0, "complete": 0, "waiting": 1, "running": 0}
    assert search.inject_warmup(study, [({"a": 0.2, "b": 0.8}, 0.36), ({"a": 0.2, "b": 0.8}, 0.36)], s) == 1
    seen = []

    def loss(chosen, w):
        seen.append(chosen.count())
        return (w["a"] - 0.8) ** 2

    best = search.run(study, scores, loss, 6, s, pool=scores, out=str(tmp_path))
    assert seen == [10] * 6 and best.value < 0.05 and (tmp_path / "best_weights.json").exists()
    assert study.trials()[0].state == "COMPLETE" and abs(study.trials()[0].weights["a"] - 0.9) < 1e-6
    again = search.Study(store, "x")
    assert len(again.trials()) == 7 and search.enqueue(again, [{"a": 0.2, "b": 0.8}], s)["complete"] == 1
    assert {r["state"] for r in again.frame(spark).collect()} == {"COMPLETE"}


def test_failed_and_stuck_trials(spark, scores):
    study, s = search.Study(":memory:", "y"), settings()

    def broken(chosen, w):
        raise RuntimeError("no")

    with pytest.raises(RuntimeError):
        search.run(study, scores, broken, 3, s)
    assert [t.state for t in study.trials()] == ["FAIL"]
    w = study.trials()[0].weights
    assert search.enqueue(study, [w], s)["retry"] == 1
    study.add(state="RUNNING", params={"z_a": 0.3, "z_b": 0.7}, start=0.0)
    assert search.enqueue(study, [{"a": 0.3, "b": 0.7}], s)["retry"] == 1


def test_early_stop_of_the_loop(spark, scores):
    study = search.Study(":memory:", "z")
    search.run(study, scores, lambda chosen, w: 1.0, 20, settings(patience=3))
    assert len(study.trials()) == 4


def test_proxy_objective(spark):
    rng = np.random.default_rng(0)
    rows = [(i, float(x), int(x + 0.3 * e > 0)) for i, (x, e) in enumerate(rng.standard_normal((200, 2)))]
    data = spark.createDataFrame(rows, "line_idx long, x double, y int")
    loss = search.logistic_objective(data, ["x"], "y")
    assert loss(data, {}) < 0.4 and loss(data.where("y = 1"), {}) == 50.0


def test_running_best(spark):
    t = spark.createDataFrame([(1, "COMPLETE", 3.0), (0, "COMPLETE", 5.0), (2, "FAIL", None), (3, "COMPLETE", 4.0)], "trial_number int, state string, eval_loss double")
    assert [r["best"] for r in trials.running_best(t).orderBy("trial_number").collect()] == [5.0, 3.0, 3.0]
    assert trials.early_stop(t.limit(0), 2).first()["stopped_at"] is None


def test_kmeans_finds_separate_groups(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in rng.standard_normal(3) * 0.1 + 10 * (i % 3)]) for i in range(90)]
    labels, centroids = vectors.kmeans(spark.createDataFrame(rows, "line_idx long, vector array<double>"), 3)
    got = {r["line_idx"]: r["cluster_id"] for r in labels.collect()}
    assert len({(i % 3, c) for i, c in got.items()}) == 3
    assert vectors.shift(centroids, vectors.lloyd_step(labels.drop("cluster_id"), centroids)).first()["shift"] < 1e-6


def test_stream_of_scores(spark, tmp_path):
    spark.range(100).select(F.col("id").cast("double").alias("a"), F.lit(1.0).alias("b")).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("a double, b double").parquet(str(tmp_path / "in"))
    query = start(scored_stream(stream, {"a": (0.0, 50.0)}, {"a": 1.0}, threshold=1.0), str(tmp_path / "out"), str(tmp_path / "check"))
    query.awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 50


def test_run_writes_its_selections(spark, tmp_path):
    """Each trial's folder holds the selected records as read, best first, and the manifest; a command gives the loss."""
    import json

    from scoresieve.plans import search
    from scoresieve.sources import index, pool

    src = tmp_path / "p.jsonl"
    src.write_text("\n".join(json.dumps({"id": i, "text": f"é{i}", "meta": {"b": 1, "a": [i]}, "scores": {"a": float(i), "b": float(-i)}}, ensure_ascii=False) for i in range(30)))
    rows = pool.read_pool(spark, str(src))
    table = index.strict_vectors(rows, ["a", "b"])
    (tmp_path / "state").write_text('{"log_history": [{"eval_loss": 3.5}, {"eval_loss": 1.25}]}')
    train = search.CommandObjective(spark, f"wc -l < {{data}}/train.jsonl > {{folder}}/n && test -e {{folder}}/again && mkdir {{output}}/x && cp {tmp_path}/state {{output}}/trainer_state.json && touch {{output}}/x/model || (touch {{folder}}/again; false)", keep_data=True)
    s = search.Settings(["a", "b"], 5, "linear", (0.0, 1.0), 3)
    study = search.Study(":memory:", "t")
    search.enqueue(study, [{"a": 1.0, "b": 0.0}], s)
    best = search.run(study, table, train, 1, s, rows, str(tmp_path / "out"), validation="val.jsonl", cache=True)
    folder = tmp_path / "out" / "trials" / "trial_00000"
    got = [json.loads(x) for x in (folder / "data" / "train.jsonl").read_text().splitlines()]
    assert best.value == 1.25 and [r["id"] for r in got] == [29, 28, 27, 26, 25] and (folder / "n").read_text().strip() == "5"
    assert {k: v for k, v in got[0].items() if k != "_weighted_score"} == {"id": 29, "text": "é29", "meta": {"b": 1, "a": [29]}, "scores": {"a": 29.0, "b": -29.0}}
    assert got[0]["_weighted_score"] > got[1]["_weighted_score"]
    info = json.loads((folder / "data" / "dataset_info.json").read_text())
    assert info["train"]["file_name"] == "train.jsonl" and info["validation"]["file_name"].endswith("val.jsonl")
    assert sorted(p.name for p in (folder / "output").rglob("*")) == ["trainer_state.json"]


def test_joint_density():
    """Parameters that are good only together are found together."""
    import numpy as np

    from scoresieve.plans.tpe import Joint, suggest

    rng = np.random.default_rng(0)
    seen = rng.random((12, 2))
    joint = Joint(seen, 0.0, 1.0)
    grid = np.stack(np.meshgrid(*[np.linspace(0.005, 0.995, 100)] * 2), -1).reshape(-1, 2)
    assert abs(np.exp(joint.log_density(grid)).mean() - 1) < 0.02
    drawn = joint.draw(rng, 500)
    assert drawn.shape == (500, 2) and (drawn >= 0).all() and (drawn <= 1).all()
    history = []
    for i in range(60):
        a, b = rng.random(2)
        history.append(({"a": float(a), "b": float(b)}, abs(a + b - 1) + 0.2 * abs(a - 0.2) * (a < 0.5) + 0.2 * abs(a - 0.8) * (a >= 0.5)))
    points = [suggest(["a", "b"], history, 0.0, 1.0, np.random.default_rng(k), 5, lambda n: 12, 100, True) for k in range(20)]
    assert np.mean([abs(p["a"] + p["b"] - 1) for p in points]) < 0.2
