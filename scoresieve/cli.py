"""Command line: python -m scoresieve.cli COMMAND ... (paths may be anything that Spark reads)."""

from __future__ import annotations

import argparse
import importlib
import json
from pathlib import Path

from pyspark.sql import functions as F

from . import plots
from .operators import hierarchy, metrics, normalize, scoring, selection, text, trials, vectors
from .plans import search
from .session import session
from .sources import files, index, pool


def _normalize(a):
    """Every line is written, in order: records with new scores, blank lines and lines that are no record as they were."""
    spark = session()
    rows = pool.records(pool.read_lines(spark, a.input), a.scores_field)
    keys = a.keys or pool.every_key(rows)
    table = index.wide(rows.where("has_scores").select("scores"), keys)
    limits = normalize.bounds_dict(normalize.bounds(table, keys, *a.pct_range, a.accuracy))
    if not limits:
        raise SystemExit("no numeric scores")
    normalize.clip_stats(table, limits, a.flip_keys or ()).show(1000, False)
    entries = normalize.normalized_entries(F.col("entries"), F.col("scores"), limits, a.flip_keys or (), a.keep_original)
    fields = F.when(F.col("has_scores"), pool.put(F.col("fields"), {a.scores_field: pool.object_text(entries)})).otherwise(F.col("fields"))
    pool.write_or_replace(rows.select("line_idx", pool.rewritten(fields, F.col("raw")).alias("raw")).orderBy("line_idx"), a.output, a.input)


def _index(a):
    spark = session()
    rows = pool.read_pool(spark, a.pool_jsonl, a.score_field)
    rows = rows.withColumn("scores", pool.scores_or_source())
    index.save_index(index.build_index(rows, pool.score_keys(rows, a.score_keys)), a.output_index)


def _layers(a):
    """Records with the clusters' scores; blank lines and lines that are no record are left out."""
    spark = session()
    rows = pool.records(pool.read_lines(spark, a.input), a.scores_field).where("fields is not null")
    pool.write_or_replace(layered(rows, files.load_all_weights(a.weights), a.scores_field).orderBy("line_idx"), a.output, a.input)


def layered(rows, weights, scores_field="scores"):
    """``line_idx`` and ``raw`` of records (see ``pool.records``) with each cluster's sum and scaled sum among their scores."""
    keys = sorted({k for w in weights.values() for k in w})
    names = {k: f"score {i}" for i, k in enumerate(keys)}
    table = rows.select("line_idx", "raw", "fields", "entries", *(F.col("scores")[k].alias(names[k]) for k in keys))
    done = scoring.layer_scores(table, {f"cluster {c}": {names[k]: w for k, w in own.items()} for c, own in weights.items()})
    new = {n: pool.number_text(F.col(f"cluster {c}{end}")) for c in weights for n, end in ((f"{c}_orig", "_orig"), (c, ""))}
    none = F.array().cast("array<struct<key:string,text:string>>")
    entries = pool.put(F.coalesce("entries", none), new)
    return done.select("line_idx", pool.rewritten(pool.put(F.col("fields"), {scores_field: pool.object_text(entries)}), F.col("raw")).alias("raw"))


def _final(a):
    """Records with scores get final_score; other lines stay, blank ones are left out."""
    spark = session()
    rows = pool.records(pool.read_lines(spark, a.input), a.scores_field).where(F.trim("raw") != "")
    pool.write_or_replace(finished(rows, files.load_weights(a.weights)).orderBy("line_idx"), a.output, a.input)


def finished(rows, weights):
    """``line_idx`` and ``raw`` of records (see ``pool.records``) with the weighted sum of their scores as final_score."""
    done = scoring.final_score(rows.withColumn("scores", F.when(F.col("has_scores"), F.col("scores"))), weights)
    fields = F.when(F.col("has_scores"), pool.put(F.col("fields"), {"final_score": pool.number_text(F.col("final_score"))})).otherwise(F.col("fields"))
    return done.select("line_idx", pool.rewritten(fields, F.col("raw")).alias("raw"))


def _sample(a):
    if not 0 < a.k <= 100:
        raise SystemExit("k must be above 0 and at most 100")
    spark = session()
    lines = pool.read_lines(spark, a.input)
    # A cluster's id may be a number or text; as JSON text both are told apart.
    parsed = F.from_json("raw", f"cluster_id variant, `{a.score_field}` variant")
    rows = lines.where(F.trim("raw") != "").withColumn("_j", parsed)
    number = F.try_variant_get(F.col(f"_j.`{a.score_field}`"), "$", "double")
    rows = rows.select("line_idx", "raw", F.when(F.schema_of_variant("_j.cluster_id") != "VOID", F.to_json("_j.cluster_id")).alias("cluster_id"), number.alias("score"))
    group = "cluster_id" if a.per_cluster else None
    quota = selection.quotas(rows, "score", a.k, group)
    quota.orderBy("group").show(20, False)
    chosen = selection.top_percent(rows, "score", a.k, group, quota=quota)
    pool.write_raw(chosen.orderBy("line_idx"), a.output)
    short = selection.unfilled(chosen, quota, group).count()
    if short:
        print(f"{short} groups have fewer rows than their quota")


def _metrics(a):
    spark = session()
    rows = pool.read_pool(spark, a.input, a.scores_field, "drop").where("has_scores")
    rows = metrics.sample_rows(rows, a.sample_size, a.seed, total=a.total_lines)
    have = pool.every_key(rows)
    wanted = files.score_list(a.scores) if a.scores else have
    keys = [k for k in wanted if k in have]
    if not keys:
        raise SystemExit("none of the wanted metrics exists")
    table = index.wide(rows, keys).persist()
    try:
        clusters = metrics.metric_clusters(table, keys, a.n_clusters, a.method, a.use_absolute_corr)
        corr = metrics.correlations(table, sorted(clusters))
        corr = spark.createDataFrame(corr.collect(), corr.schema)  # a number for each pair of metrics
        means = {r["cluster"]: r["mean_corr"] for r in metrics.within_clusters(corr, clusters).collect()}
    finally:
        table.unpersist()
    report = metrics.report(clusters, files.display_names(a.score_names) if a.score_names else None, means)
    Path(a.output).write_text(report)
    print(report)
    both = not (a.plot_dendrogram or a.plot_heatmap)
    own = sorted(clusters)
    if a.plot_heatmap or both:
        places = sorted(own, key=lambda k: (clusters[k], k))
        cells = {(r["key_a"], r["key_b"]): r["corr"] for r in corr.collect()}
        Path(f"{a.output}.heatmap.svg").write_text(plots.heat_map(cells, places))
    if a.plot_dendrogram or both:
        merges = metrics.linkage(metrics.matrix(metrics.distances(corr, a.use_absolute_corr), own, "distance"), a.method)
        Path(f"{a.output}.dendrogram.svg").write_text(plots.dendrogram(merges.tolist(), own, metrics.leaf_order(merges, len(own))))


def _embed(a):
    spark = session()
    rows = pool.read_lines(spark, a.input_path)
    fields = F.from_json("raw", ", ".join(f"`{f}` string" for f in a.fields))
    rows = rows.where(F.trim("raw") != "").withColumn("_f", fields).select("line_idx", "_f.*").select("line_idx", text.assembled(a.fields).alias("text"))
    rows = text.truncated(rows, a.max_tokens)
    if a.truncate_report_path:
        text.truncation_report(rows).write.mode("overwrite").csv(a.truncate_report_path)
    module, _, name = a.model.partition(":")
    text.embedded(rows, getattr(importlib.import_module(module), name), most=a.batch_size).select("line_idx", "vector").write.mode("overwrite").parquet(a.output_path)


def _kmeans(a):
    spark = session()
    data = files.read_array(spark, a.input_path) if a.input_path.endswith(".npy") else spark.read.parquet(a.input_path)
    labels, centroids = vectors.mini_batches(data, a.opt_k, a.batch_size, a.max_epochs) if a.batch_size else vectors.kmeans(data, a.opt_k, a.max_epochs)
    labels.select("line_idx", "cluster_id").write.mode("overwrite").parquet(f"{a.output_dir}/labels")
    centroids.write.mode("overwrite").parquet(f"{a.output_dir}/centroids")
    labels = session().read.parquet(f"{a.output_dir}/labels")
    if a.npy:
        files.write_array(labels, f"{a.output_dir}/cluster_labels.npy", "line_idx", "cluster_id")
        files.write_array(centroids, f"{a.output_dir}/cluster_centroids.npy", "cluster_id", "centroid")
    sizes = vectors.sizes_of(labels).orderBy(F.desc("n"), "cluster_id").limit(2000).collect()
    Path(a.output_dir).mkdir(parents=True, exist_ok=True)
    Path(a.output_dir, "cluster_sizes.svg").write_text(plots.bars([(r["cluster_id"], r["n"]) for r in sizes], "Rows of the largest clusters" if len(sizes) == 2000 else "Rows by cluster"))
    vectors.distribution(labels).show()
    vectors.sizes_of(labels).orderBy("cluster_id").show(20)


def _assign(a):
    spark = session()
    rows = pool.read_lines(spark, a.input_jsonl)
    labels = files.read_array(spark, a.labels_path, "cluster_id").withColumn("cluster_id", F.col("cluster_id").cast("int")) if a.labels_path.endswith(".npy") else spark.read.parquet(a.labels_path)
    out = pool.records(vectors.assign_clusters(rows, labels)).join(labels.select("line_idx", "cluster_id"), "line_idx").where("fields is not null")
    added = pool.put(F.col("fields"), {"cluster_id": F.col("cluster_id").cast("string")})
    pool.write_or_replace(out.select("line_idx", pool.rewritten(added, F.col("raw")).alias("raw")).orderBy("line_idx"), a.output_jsonl, a.input_jsonl)


def _summary(a):
    hierarchy.summary(session(), a.input, a.output)


def _trials(a):
    study = search.Study(a.storage, a.study_name)
    rows = study.frame(session())
    shown = trials.completed(rows) if a.only_completed else rows
    ordered = trials.by_loss(shown, a.limit) if a.sort_by == "loss" else trials.by_number(shown, a.limit)
    ordered.select("trial_number", "state", "eval_loss", "is_warmup", "duration_seconds").show(1000, False)
    trials.statistics(shown).show()
    trials.top_weights(trials.best(rows), a.top_weights).show(100, False)
    if a.output:
        (trials.export_csv if a.output.endswith(".csv") else trials.export_json)(rows, a.output)


def _search(a):
    c = files.load_config(a.config)
    spark = session()
    rows = pool.read_pool(spark, c.pool_jsonl, c.score_field)
    rows = rows.withColumn("scores", pool.scores_or_source())
    table = index.load_index(spark, c.pool_index, c.score_keys) if c.pool_index else index.strict_vectors(rows, c.score_keys)
    s = search.Settings(c.score_keys, c.top_k, c.normalization_method, c.suggest_range, c.seed, c.n_startup_trials, c.tpe_n_ei_candidates, c.tpe_multivariate, c.tpe_gamma_percent, c.tpe_gamma_max, c.early_stop_patience, c.early_stop_delta, c.running_timeout_hours)
    study = search.Study(c.storage, c.study_name)
    if c.warmup_trials_json:
        search.inject_warmup(study, files.load_warmup_trials(c.warmup_trials_json, c.score_keys), s)
    if c.enqueue_weights_json:
        print(search.enqueue(study, files.load_enqueued(c.enqueue_weights_json), s))
    module, _, name = a.objective.partition(":")
    objective = getattr(importlib.import_module(module), name)(spark, c)
    best = search.run(study, table, objective, c.n_trials, s, rows, c.run_dir, c.max_trials_in_dir, validation=c.val_jsonl, cache=c.cache_pool_in_memory)
    print(json.dumps({"trial": best.number, "loss": best.value, "weights": best.weights}))


#: Options for buffers, counts and devices, which have no meaning here: accepted with their value, and left alone.
NO_MEANING = {"normalize": ["--batch-size"], "layers": ["--no_count", "--missing_zero"], "assign": ["--write_buf_size"], "embed": ["--tensor_parallel_size"]}


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="scoresieve", description=__doc__)
    sub = p.add_subparsers(dest="command", required=True)

    def command(name, run):
        c = sub.add_parser(name)
        c.set_defaults(run=run)
        return c.add_argument

    arg = command("search", _search)
    arg("--config", required=True)
    arg("--objective", required=True, help="module:function; called with (spark, config) it gives the objective")
    arg = command("normalize", _normalize)
    arg("-i", "--input", required=True)
    arg("-o", "--output", required=True)
    arg("--pct-range", nargs=2, type=float, required=True)
    arg("--accuracy", type=int, help="approximate percentiles, ranks off by at most 1 / accuracy of the rows")
    arg("--keys", nargs="+")
    arg("--keep-original", action="store_true")
    arg("--flip-keys", nargs="+")
    arg("--scores-field", default="scores")
    arg = command("index", _index)
    arg("--pool_jsonl", required=True)
    arg("--output_index", required=True)
    arg("--score_field", default="scores")
    arg("--score_keys", default="")
    for name, run in (("layers", _layers), ("final-score", _final)):
        arg = command(name, run)
        arg("-i", "--input", required=True)
        arg("-w", "--weights", required=True)
        arg("-o", "--output", help="the input is replaced if this is left out")
        arg("-s", "--scores-field", default="scores")
    arg = command("sample", _sample)
    arg("-i", "--input", required=True)
    arg("-o", "--output", required=True)
    arg("-k", type=float, required=True)
    how = sub.choices["sample"].add_mutually_exclusive_group(required=True)
    how.add_argument("--per_cluster", action="store_true")
    how.add_argument("--global", action="store_true", dest="all")
    arg("-s", "--score-field", default="final_score")
    arg = command("metrics", _metrics)
    arg("-i", "--input", required=True)
    arg("-o", "--output", default="cluster_results.txt")
    arg("--sample_size", type=int, default=10_000)
    arg("--total_lines", type=int, help="how many records there are, so that they are not counted")
    arg("--seed", type=int, default=42)
    arg("--n_clusters", type=int)
    arg("--method", choices=metrics.METHODS, default="ward")
    arg("--use_absolute_corr", action="store_true")
    arg("--plot_dendrogram", action="store_true", help="<output>.dendrogram.svg; both plots if none is asked for")
    arg("--plot_heatmap", action="store_true", help="<output>.heatmap.svg")
    arg("--scores")
    arg("--score_names")
    arg("-s", "--scores-field", default="scores")
    arg = command("embed", _embed)
    arg("--input_path", required=True)
    arg("--output_path", required=True)
    arg("--model", required=True, help="module:function that loads a function from texts to vectors")
    arg("--max_tokens", type=int, default=32_768)
    arg("--truncate_report_path")
    arg("--batch_size", type=int, default=16_384, help="texts that the model gets at once")
    arg("--fields", nargs="+", default=["instruction", "input", "output"])
    arg = command("kmeans", _kmeans)
    arg("--input_path", required=True)
    arg("--output_dir", default=".")
    arg("--opt_k", type=int, default=2000)
    arg("--max_epochs", type=int, default=10)
    arg("--batch_size", type=int, default=0, help="lines of a mini-batch; 0 clusters by passes over all lines")
    arg("--npy", action="store_true", help="also write .npy files, for results that fit into the driver")
    arg = command("assign", _assign)
    arg("--input_jsonl", required=True)
    arg("--labels_path", required=True)
    arg("--output_jsonl", help="the input is replaced if this is left out")
    arg = command("summary", _summary)
    arg("-i", "--input", required=True)
    arg("-o", "--output", required=True)
    arg = command("trials", _trials)
    arg("--storage", required=True)
    arg("--study_name", required=True)
    arg("-o", "--output")
    arg("--limit", type=int, default=0)
    arg("--sort_by", choices=("number", "loss"), default="number")
    arg("--only_completed", action="store_true")
    arg("--top_weights", type=int, default=5)
    for name, options in NO_MEANING.items():
        for option in options:
            sub.choices[name].add_argument(option, nargs="?", const="", help=argparse.SUPPRESS)
    return p


def main(args: list[str] | None = None) -> None:
    a = parser().parse_args(args)
    a.run(a)


if __name__ == "__main__":
    main()
