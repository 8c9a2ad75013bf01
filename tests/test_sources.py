"""JSON lines with all their errors, small files, command line."""

import json

import numpy as np
import pytest

from scoresieve import cli
from scoresieve.operators import hierarchy, text, vectors
from scoresieve.sources import files, index, pool

LINES = [
    '{"id": 1, "instruction": "é", "input": "", "output": "o", "scores": {"a": 1.5, "b": "x", "c": true, "d": null, "e": 3}}',
    "",
    "not json",
    '{"id": 2, "scores": [1, 2]}',
    '{"id": 3, "source": {"a": 2}}',
    '{"id": 4, "scores": {"a": NaN, "b": Infinity, "c": -1}}',
    '{"id": 5, "scores": null}',
]


@pytest.fixture
def path(tmp_path):
    file = tmp_path / "pool.jsonl"
    file.write_text("\n".join(LINES))  # no line break at the end
    return str(file)


def test_lines_keep_their_positions(spark, path):
    rows = pool.read_lines(spark, path).orderBy("line_idx").collect()
    assert [(r["line_idx"], r["raw"]) for r in rows] == list(enumerate(LINES))


def test_positions_over_splits(spark, tmp_path):
    for i in range(3):
        (tmp_path / f"p{i}.jsonl").write_text("".join(f"{i}-{j}\n" for j in range(500 * (3 - i))))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    try:
        rows = pool.read_lines(spark, str(tmp_path)).orderBy("line_idx").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert [r["raw"] for r in rows] == [f"{i}-{j}" for i in range(3) for j in range(500 * (3 - i))]
    assert [r["line_idx"] for r in rows] == list(range(3000))


def test_error_policies(spark, path):
    kept = {r["line_idx"]: r for r in pool.read_pool(spark, path, on_error="keep").collect()}
    assert sorted(kept) == [0, 2, 3, 4, 5, 6]
    assert kept[0]["scores"] == {"a": 1.5, "e": 3.0} and set(kept[0]["scores_other"]) == {"b", "c", "d"}
    assert np.isnan(kept[5]["scores"]["a"]) and kept[5]["scores"]["b"] == float("inf")
    assert not kept[3]["has_scores"] and kept[4]["source_scores"] == {"a": 2.0} and kept[0]["instruction"] == "é"
    assert sorted(r["line_idx"] for r in pool.read_pool(spark, path, on_error="drop").collect()) == [0, 3, 4, 5, 6]
    with pytest.raises(Exception, match="line 2 is not JSON"):
        pool.read_pool(spark, path).collect()
    with pytest.raises(ValueError):
        pool.read_pool(spark, path, on_error="other")


def test_scores_or_source(spark, path):
    rows = pool.read_pool(spark, path, on_error="drop")
    got = {r["line_idx"]: r["s"] for r in rows.where("line_idx in (0, 4)").select("line_idx", pool.scores_or_source().alias("s")).collect()}
    assert got == {0: {"a": 1.5, "e": 3.0}, 4: {"a": 2.0}}
    with pytest.raises(Exception, match="neither scores"):
        rows.where("line_idx = 6").select(pool.scores_or_source()).collect()
    assert pool.first_record(rows)["id"] == 1 and pool.score_keys(rows) == ["a", "e"] and pool.score_keys(rows, "b, a") == ["b", "a"]
    with pytest.raises(ValueError):
        pool.first_record(rows.limit(0))


def test_index_round_trip(spark, path, tmp_path):
    rows = pool.read_pool(spark, path, on_error="drop").where("has_scores")
    index.save_index(index.build_index(rows, ["a", "zz"]), str(tmp_path / "index"), 2)
    back = index.load_index(spark, str(tmp_path / "index"), ["zz", "a"])
    assert back.columns == ["line_idx", "zz", "a"] and back.orderBy("line_idx").first()["a"] == 1.5
    with pytest.raises(ValueError, match="no b"):
        index.load_index(spark, str(tmp_path / "index"), ["b"])
    assert [r["raw"] for r in index.fetch(pool.read_lines(spark, path), back.where("line_idx = 0")).collect()] == [LINES[0]]


def test_replace_and_write(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(5).write.parquet(path)
    pool.replaced(spark.read.parquet(path).where("id > 2"), path)
    assert spark.read.parquet(path).count() == 2
    pool.write_json_lines(spark.createDataFrame([("é", None)], "a string, b int"), str(tmp_path / "j"))
    assert spark.read.text(str(tmp_path / "j")).first()[0] == '{"a":"é","b":null}'
    assert json.loads(pool.write_manifest(str(tmp_path), "x", "x.jsonl").read_text())["x"]["file_name"] == "x.jsonl"


def test_configuration():
    raw = {"pool_jsonl": "p", "val_jsonl": "v", "run_dir": "r", "study_name": "s", "storage": "sqlite:///x", "top_k": "15", "n_trials": 3, "score_keys": "a, b", "tpe_multivariate": "false", "suggest_range": "0, 1", "nproc_per_node": 8}
    with pytest.warns(UserWarning, match="nproc_per_node"):
        c = files.search_config(raw)
    assert (c.top_k, c.score_keys, c.tpe_multivariate, c.suggest_range) == (15, ["a", "b"], False, (0.0, 1.0))
    for change in ({"score_keys": ","}, {"top_k": None}, {"suggest_range": [2, 1]}, {"suggest_range": "1"}, {"normalization_method": "x"}):
        with pytest.raises((ValueError, KeyError)):
            files.search_config({k: v for k, v in (raw | change).items() if k != "nproc_per_node"})


def test_small_files(spark, tmp_path):
    warm = tmp_path / "w.json"
    warm.write_text(json.dumps([{"weights": {"a": 1}, "eval_loss": 2}, {"weights": {}}, 5, {"weights": {"q": 1}, "eval_loss": 1}]))
    with pytest.warns(UserWarning):
        assert files.load_warmup_trials(str(warm), ["a"]) == [({"a": 1.0}, 2.0)]
    warm.write_text('[{"a": 1}, 3]')
    assert files.load_enqueued(str(warm)) == [{"a": 1.0}]
    warm.write_text("{}")
    with pytest.raises(ValueError):
        files.load_enqueued(str(warm))
    log = tmp_path / "state.json"
    log.write_text(json.dumps({"log_history": [{"eval_loss": 3.0}, {"loss": 1.0}, {"eval_loss": 2.0}, {"x": 1}]}))
    assert files.last_eval_loss(spark, str(log)) == 2.0
    assert files.score_list("a, b") == ["a", "b"] and files.score_list("a") == ["a"]
    assert files.display_names("a\tA\nb=B\nc,C") == {"a": "A", "b": "B", "c": "C"} and files.display_names('{"a": "A"}') == {"a": "A"}
    np.save(tmp_path / "v.npy", np.arange(12.0).reshape(4, 3))
    rows = files.read_array(spark, str(tmp_path / "v.npy"))
    assert [r["vector"] for r in rows.orderBy("line_idx").collect()] == np.arange(12.0).reshape(4, 3).tolist()
    files.write_array(rows, str(tmp_path / "back.npy"))
    assert (np.load(tmp_path / "back.npy") == np.arange(12.0).reshape(4, 3)).all()


def test_layers_and_summary(spark, tmp_path):
    for name, w in {"Layer1_c1": {"a": 0.5, "b": 0.5}, "Layer1_c10": {"b": 1.0}, "Layer1_c2": {"c": 1.0}, "Layer2_c1": {"Layer1_c1": 0.6, "Layer1_c10": 0.4, "Layer1_c7": 1.0}}.items():
        folder = tmp_path / name[:6] / name
        folder.mkdir(parents=True)
        (folder / "best_weights.json").write_text(json.dumps({"best_weights": w}))
    data = hierarchy.summary(spark, str(tmp_path), str(tmp_path / "out.json"))
    assert {k: round(v, 9) for k, v in data["final_leaf_weights"].items()} == {"a": 0.3, "b": 0.7}
    assert list(data["hierarchy"]["Layer1"]) == ["Layer1_c1", "Layer1_c10", "Layer1_c2"]
    with pytest.raises(ValueError, match="cycle"):
        hierarchy.leaf_weights(hierarchy.edges(spark, {"Layer1_c1": {"Layer1_c2": 1.0}, "Layer1_c2": {"Layer1_c1": 1.0}}))
    assert hierarchy.layer_number("Layer12_c3") == 12


def test_texts(spark):
    t = spark.createDataFrame([("a", None, ""), (None, None, None), ("x y z", "q", "r")], "a string, b string, c string")
    assert [r[0] for r in t.select(text.assembled(["a", "b", "c"])).collect()] == ["a", "", "x y z\nq\nr"]
    cut = text.truncated_by(t.select("a"), 2, lambda s: s.split(), " ".join, "a")
    assert [tuple(r) for r in cut.collect()] == [("a", 1, False), (None, 0, False), ("x y", 3, True)]
    out = text.embedded(t.select("a"), lambda: lambda batch: [[len(s), 1.0] for s in batch], "a")
    assert [r["vector"] for r in out.collect()] == [[1.0, 1.0], [0.0, 1.0], [5.0, 1.0]]
    one = text.embedded(t.select("a").coalesce(1), lambda: lambda batch: [[len(batch), 1.0]] * len(batch), "a", most=2)
    assert {r["vector"][0] for r in one.collect()} <= {1.0, 2.0}


RECORDS = [
    {"id": 7, "instruction": "é \\ \"q\"", "input": "", "output": None, "lang": "en", "meta": {"z": [1, 2.5, {"b": "x"}], "a": True, "é": []}, "scores": {"b": 3, "a": 1.5, "note": "4", "bad": None, "flag": True, "deep": {"k": [1]}}},
    {"scores": {"a": 3.5, "b": 8, "extra": 1e-7}, "id": "x-1", "cluster_id": 99, "final_score": "old", "n": 12345678901234567890123},
    {},
    {"id": 2.5, "scores": {}},
    {"id": 3, "scores": [1, 2], "tags": ["a", "b"]},
    {"id": 4, "scores": None, "x": "5"},
]


@pytest.fixture
def records(tmp_path):
    lines = [json.dumps(r, ensure_ascii=False) for r in RECORDS]
    file = tmp_path / "r.jsonl"
    file.write_text("\n".join([*lines[:2], "", "{broken", '{"a": 1} {"b": 2}', '{"id": 9, "scores": {"a": NaN, "b": 5}, "w": Infinity}', *lines[2:]]))
    return file


def _lines(spark, path):
    return [r["raw"] for r in pool.read_lines(spark, str(path)).orderBy("line_idx").collect()]


def _loads(line):
    try:
        return json.loads(line)
    except json.JSONDecodeError:
        return line


def test_records_keep_all_but_their_scores(spark, records, tmp_path):
    """normalize, layers, final-score, assign and sample change what they are asked to and nothing else."""
    run = lambda *a: cli.main([str(x) for x in a])
    before = [_loads(x) for x in _lines(spark, records)]
    run("normalize", "-i", records, "-o", tmp_path / "n", "--pct-range", 0, 100, "--keep-original", "--flip-keys", "b", "--batch-size", 10)
    got = [_loads(x) for x in _lines(spark, tmp_path / "n")]
    assert len(got) == len(before) and got[2:5] == before[2:5] == ["", "{broken", '{"a": 1} {"b": 2}']
    assert got[0] == before[0] | {"scores": {"b_orig": 3, "b": 1.0, "a_orig": 1.5, "a": 0.0, "note": "4", "bad": None, "flag": True, "deep": {"k": [1]}}}
    assert list(got[0]) == list(before[0]) and list(got[0]["scores"]) == ["b_orig", "b", "a_orig", "a", "note", "bad", "flag", "deep"] and isinstance(got[0]["scores"]["b_orig"], int)
    assert got[1] == before[1] | {"scores": {"a_orig": 3.5, "a": 1.0, "b_orig": 8, "b": 0.0, "extra_orig": 1e-7, "extra": 0.0}}
    assert np.isnan(got[5]["scores"]["a"]) and got[5]["w"] == float("inf") and got[5]["scores"]["b"] == 0.6
    assert got[6:] == before[6:] == RECORDS[2:]

    (tmp_path / "w" / "Layer1_c1").mkdir(parents=True)
    weights = tmp_path / "w" / "Layer1_c1" / "best_weights.json"
    weights.write_text('{"best_weights": {"b": 2.0, "a": 1.0, "gone": 5.0}}')
    run("layers", "-i", records, "-w", tmp_path / "w", "-o", tmp_path / "l", "--no_count")
    got = [_loads(x) for x in _lines(spark, tmp_path / "l")]
    kept = [r for r in before if isinstance(r, dict)]
    sums = [7.5, 19.5, None, 0.0, 0.0, 0.0, 0.0]
    assert len(got) == len(kept) == 7
    for new, old, total in zip(got, kept, sums, strict=True):
        scores = new.pop("scores")
        assert new == {k: v for k, v in old.items() if k != "scores"}
        if total is not None:
            assert scores == (old.get("scores") if isinstance(old.get("scores"), dict) else {}) | {"Layer1_c1_orig": total, "Layer1_c1": total / 19.5}

    run("final-score", "-i", records, "-w", weights, "-o", tmp_path / "f")
    got = [_loads(x) for x in _lines(spark, tmp_path / "f")]
    assert got[2:4] == ["{broken", '{"a": 1} {"b": 2}'] and len(got) == 9
    assert got[0] == before[0] | {"final_score": 7.5} and got[1] == before[1] | {"final_score": 19.5} and list(got[1]) == list(before[1])
    assert np.isnan(got[4]["scores"]["a"]) and np.isnan(got[4]["final_score"]) and got[4]["w"] == float("inf")
    assert got[5:] == [{}, RECORDS[3] | {"final_score": 0.0}, RECORDS[4], RECORDS[5]]

    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "p.jsonl").write_text(records.read_text())
    labels = [3, 1, 4, 1, 5, 9, 2, 6, 5, 3]
    np.save(tmp_path / "y.npy", np.array(labels, np.int32))
    run("assign", "--input_jsonl", tmp_path / "d", "--labels_path", tmp_path / "y.npy")  # in place
    got = [_loads(x) for x in _lines(spark, tmp_path / "d")]
    assert [r["cluster_id"] for r in got] == [3, 1, 9, 2, 6, 5, 3]
    assert got[:2] == [before[0] | {"cluster_id": 3}, before[1] | {"cluster_id": 1}] and got[3] == {"cluster_id": 2} and not list(tmp_path.glob("d.*"))
    run("final-score", "-i", tmp_path / "d", "-w", weights)
    run("sample", "-i", tmp_path / "d", "-o", tmp_path / "s", "-k", 100, "--per_cluster")
    assert [r["id"] for r in map(_loads, _lines(spark, tmp_path / "s"))] == [7, "x-1", 2.5]


def test_sampling_by_other_ids(spark, tmp_path, capsys):
    """Ids may be text, numbers or both; groups that stay below their quota are told."""
    rows = [{"cluster_id": c, "final_score": s, "i": i} for i, (c, s) in enumerate([("a", 1), ("a", 2), ("1", 5), (1, 6), (1, 7.5), (None, 9), ("a", None), (1, "8"), ("a", 2)])]
    (tmp_path / "p.jsonl").write_text("\n".join(map(json.dumps, rows)))
    cli.main(["sample", "-i", str(tmp_path / "p.jsonl"), "-o", str(tmp_path / "s"), "-k", "50", "--per_cluster"])
    got = sorted(json.loads(x)["i"] for x in _lines(spark, tmp_path / "s"))
    assert got == [1, 2, 4, 7, 8] or got == [1, 2, 4, 8] or got == [1, 2, 7, 4, 8]
    assert "n_keep" in capsys.readouterr().out


def test_plots_are_well_formed():
    from xml.dom.minidom import parseString

    from scoresieve import plots

    merges = [[0, 1, 0.2, 2], [2, 3, 0.7, 3]]
    found = [
        plots.history([(0, 3.0, 3.0), (1, 4.0, 3.0), (5, 1.5, 1.5)]), plots.history([(2, 1.0, 1.0)]), plots.history([]),
        plots.bars([("a<b", 3), ("c", 0)], "x & y"), plots.bars([], "none"), plots.bars([(i, i) for i in range(900)], "many"),
        plots.heat_map({("a", "a"): 1.0, ("a", "b&"): -0.5, ("b&", "b&"): None}, ["a", "b&"]), plots.dendrogram(merges, ["x", "y", "z"], [2, 0, 1]), plots.dendrogram([], ["x"], [0]),
    ]
    for text in found:
        assert parseString(text).documentElement.tagName == "svg"
    assert found[0].count("<circle") == 3 and found[6].count("<title>") == 3 and found[7].count("<path") == 2


def test_mini_batches(spark):
    rng = np.random.default_rng(0)
    centre = rng.normal(0, 20, (4, 5))
    x = np.concatenate([c + rng.normal(0, 0.5, (60, 5)) for c in centre])
    order = rng.permutation(len(x))
    data = spark.createDataFrame([(i, [float(v) for v in x[j]]) for i, j in enumerate(order)] + [(999, None)], "line_idx long, vector array<double>")
    labels, centroids = vectors.mini_batches(data, 4, batch=64, epochs=4)
    got = {r["line_idx"]: r["cluster_id"] for r in labels.collect()}
    assert got[999] is None and all(len({got[i] for i, j in enumerate(order) if j // 60 == k}) == 1 for k in range(4)) and len(set(got.values())) == 5
    found = np.array([r["centroid"] for r in centroids.collect()])
    assert all(np.abs(found - c).sum(1).min() < 1 for c in centre)
    empty, none = vectors.mini_batches(data.limit(0), 3)
    assert empty.count() == 0 and none.count() == 0


def test_nearest_breaks_ties_by_id(spark):
    data = spark.createDataFrame([(0, [0.0, 0.0]), (1, [1.0, 0.0]), (2, None), (3, [9.0, 9.0])], "line_idx long, vector array<double>")
    centres = spark.createDataFrame([(5, [1.0, 0.0]), (2, [-1.0, 0.0]), (9, [0.0, 1.0])], "cluster_id int, centroid array<double>")
    assert [r["cluster_id"] for r in vectors.nearest(data, centres).orderBy("line_idx").collect()] == [2, 5, None, 5]


def test_merged_scores(spark):
    """Several outputs of a metric for one id, with the settings that Spark has by itself."""
    before = spark.conf.get("spark.sql.mapKeyDedupPolicy")
    spark.conf.set("spark.sql.mapKeyDedupPolicy", "EXCEPTION")
    try:
        records = spark.createDataFrame([(1, {"old": 1.0, "m": 0.0}), (2, None)], "id long, scores map<string,double>")
        outputs = spark.createDataFrame([(1, "m", 5.0, 1), (1, "m", 3.0, 2), (1, None, 3.0, 2), (1, "k", None, 2), (3, "m", 1.0, 1)], "id long, metric string, score double, at int")
        get = lambda **o: {r["id"]: r["scores"] for r in vectors.merge_scores(records, outputs, **o).collect()}
        assert get() == {1: {"old": 1.0, "m": 5.0}, 2: {}} and get(order="at") == {1: {"old": 1.0, "m": 3.0}, 2: {}}
    finally:
        spark.conf.set("spark.sql.mapKeyDedupPolicy", before)


def test_labels_must_match(spark):
    rows = spark.range(3).withColumnRenamed("id", "line_idx")
    with pytest.raises(ValueError, match="3 records, but 2 labels"):
        vectors.assign_clusters(rows, rows.limit(2).selectExpr("line_idx", "1 AS cluster_id"))


def test_command_line(spark, tmp_path, capsys):
    src = tmp_path / "p.jsonl"
    src.write_text("\n".join(json.dumps({"id": i, "instruction": f"i{i}", "scores": {"a": float(i), "b": float(i % 7), "c": float(-i)}}) for i in range(60)))
    run = lambda *a: cli.main([str(x) for x in a])
    run("normalize", "-i", src, "-o", tmp_path / "n", "--pct-range", 0, 100, "--flip-keys", "c")
    back = [json.loads(r[0]) for r in spark.read.text(str(tmp_path / "n")).collect()]
    assert {round(r["scores"]["a"], 9) == round(r["scores"]["c"], 9) for r in back} == {True}
    run("index", "--pool_jsonl", src, "--output_index", tmp_path / "i")
    assert spark.read.parquet(str(tmp_path / "i")).columns == ["line_idx", "a", "b", "c"]
    (tmp_path / "w").mkdir()
    (tmp_path / "w" / "Layer1_c1").mkdir()
    (tmp_path / "w" / "Layer1_c1" / "best_weights.json").write_text('{"weights": {"a": 1.0}}')
    run("layers", "-i", src, "-w", tmp_path / "w", "-o", tmp_path / "l")
    assert all("Layer1_c1_orig" in json.loads(r[0])["scores"] for r in spark.read.text(str(tmp_path / "l")).collect())
    run("final-score", "-i", src, "-w", tmp_path / "w" / "Layer1_c1" / "best_weights.json", "-o", tmp_path / "f")
    run("sample", "-i", tmp_path / "f", "-o", tmp_path / "s", "-k", 10, "--global")
    chosen = [json.loads(r[0]) for r in spark.read.text(str(tmp_path / "s")).collect()]
    assert sorted(r["final_score"] for r in chosen) == [float(x) for x in range(54, 60)]
    run("metrics", "-i", src, "-o", tmp_path / "r.txt", "--n_clusters", 2, "--use_absolute_corr")
    assert "Cluster 1" in (tmp_path / "r.txt").read_text()
    assert all("<svg" in (tmp_path / f"r.txt.{kind}.svg").read_text() for kind in ("heatmap", "dendrogram"))
    np.save(tmp_path / "v.npy", np.random.default_rng(0).standard_normal((60, 4)))
    run("kmeans", "--input_path", tmp_path / "v.npy", "--output_dir", tmp_path / "k", "--opt_k", 3)
    run("assign", "--input_jsonl", src, "--labels_path", tmp_path / "k" / "labels", "--output_jsonl", tmp_path / "a")
    assert all(0 <= json.loads(r[0])["cluster_id"] < 3 for r in spark.read.text(str(tmp_path / "a")).collect())
