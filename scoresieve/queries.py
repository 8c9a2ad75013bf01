"""Registered queries for the selection operators, and DuckDB SQL for each that SQL can express."""

from __future__ import annotations

import json
import shutil
import tempfile
import uuid
import warnings
from collections.abc import Callable
from functools import cache
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions.expressions import double, min_max
from .functions.weighting import good_trials, linear, parameters_of, signature, softmax, weights_of
from .operators import hierarchy, metrics, normalize, scoring, selection, text, trials, vectors
from .plans import search
from .sources import files, index, pool
from .sources.pool import score_keys
from .sources.scratch import shared_dir
from .streaming import scoring as streaming

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def registered(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return put


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


LINE_KEYS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def _bounds_sql(t: str, keys: list[str], lo: float, hi: float) -> str:
    return " UNION ALL ".join(f"SELECT '{k}' AS key, quantile_cont({k}::DOUBLE, {lo / 100}) AS lb, quantile_cont({k}::DOUBLE, {hi / 100}) AS ub, count({k}) AS n FROM {t}" for k in keys)


def _unit_sql(k: str, lo: float = 5, hi: float = 95) -> str:
    return f"(least(greatest({k}, quantile_cont({k}, {lo / 100}) OVER ()), quantile_cont({k}, {hi / 100}) OVER ()) - quantile_cont({k}, {lo / 100}) OVER ()) / (quantile_cont({k}, {hi / 100}) OVER () - quantile_cont({k}, {lo / 100}) OVER ())"


# ---- normalisation


@registered(_bounds_sql("lineitem", LINE_KEYS, 5, 95))
def bounds_percentile(spark, sf_dir):
    return normalize.bounds(table(spark, sf_dir, "lineitem"), LINE_KEYS, 5, 95)


_LINE = ", ".join(["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"])
_B = "b AS (SELECT " + ", ".join(f"quantile_cont({k}, 0.05) AS {k}_lo, quantile_cont({k}, 0.95) AS {k}_hi" for k in LINE_KEYS) + " FROM lineitem)"


def _scaled_sql(k: str) -> str:
    return f"(least(greatest({k}, {k}_lo), {k}_hi) - {k}_lo) / ({k}_hi - {k}_lo)"


def _scaled(spark, sf_dir, **more):
    t = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", *LINE_KEYS)
    return normalize.normalized(t, normalize.bounds_dict(normalize.bounds(t, LINE_KEYS, 5, 95)), **more)


@registered(f"WITH {_B} SELECT {_LINE}, " + ", ".join(f"{_scaled_sql(k)} AS {k}" for k in LINE_KEYS) + " FROM lineitem, b")
def winsorize_normalize(spark, sf_dir):
    return _scaled(spark, sf_dir)


@registered(f"WITH {_B} SELECT {_LINE}, l_quantity AS l_quantity_orig, l_extendedprice AS l_extendedprice_orig, l_discount AS l_discount_orig, l_tax AS l_tax_orig, " + ", ".join(f"{'1 - ' if k == 'l_extendedprice' else ''}{_scaled_sql(k)} AS {k}" for k in LINE_KEYS) + " FROM lineitem, b")
def normalize_flip_keep_orig(spark, sf_dir):
    return _scaled(spark, sf_dir, flip=["l_extendedprice"], keep_original=True)


@registered(f"WITH {_B} " + " UNION ALL ".join(f"SELECT '{k}' AS key, any_value({k}_lo) AS lb, any_value({k}_hi) AS ub, count(*) FILTER ({k} < {k}_lo OR {k} > {k}_hi) AS clipped, count({k}) AS total, count(*) FILTER ({k} < {k}_lo OR {k} > {k}_hi)::DOUBLE / count({k}) AS rate, {str(k == 'l_tax').lower()} AS flip FROM lineitem, b" for k in LINE_KEYS))
def clip_stats(spark, sf_dir):
    t = table(spark, sf_dir, "lineitem")
    return normalize.clip_stats(t, normalize.bounds_dict(normalize.bounds(t, LINE_KEYS, 5, 95)), ["l_tax"])


@registered("SELECT event_id, 0.0::DOUBLE AS same, 1.0::DOUBLE AS flipped, 0.5::DOUBLE AS layer FROM events")
def zero_span_guard(spark, sf_dir):
    t = table(spark, sf_dir, "events").select("event_id", double(3.0).alias("c"))
    return t.select("event_id", normalize.scaled(F.col("c"), 3.0, 3.0).alias("same"), normalize.scaled(F.col("c"), 3.0, 3.0, True).alias("flipped"), min_max(F.col("c"), double(3.0), double(3.0)).alias("layer"))


@registered("SELECT 'v' AS key, quantile_cont(value, 0.01) AS lb, quantile_cont(value, 0.99) AS ub, count(*) AS n FROM events WHERE event_id % 10 NOT IN (3, 7)")
def finite_only_bounds(spark, sf_dir):
    v = F.when(F.col("event_id") % 10 == 3, double("nan")).when(F.col("event_id") % 10 == 7, double("inf")).otherwise(F.col("value"))
    return normalize.bounds(table(spark, sf_dir, "events").select(v.alias("v")), ["v"], 1, 99)


@registered("SELECT doc_id AS line_idx, coalesce(quality, 0)::DOUBLE AS quality_unit, CASE WHEN toxic IS NULL THEN NULL ELSE 1 - toxic::DOUBLE END AS toxic_unit FROM documents LEFT JOIN labels USING (doc_id)")
def normalize_map(spark, sf_dir):
    rows = _labelled(spark, sf_dir)
    out = normalize.normalized_map(rows, {"quality": (0.0, 1.0), "toxic": (0.0, 1.0)}, ["toxic"], True)
    return out.select("line_idx", F.coalesce(F.col("scores")["quality"], double(0.0)).alias("quality_unit"), F.col("scores")["toxic"].alias("toxic_unit"))


# ---- index and scores


def _labelled(spark, sf_dir) -> DataFrame:
    docs = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return index.narrow(docs.select(F.col("doc_id").alias("line_idx"), "quality", "toxic"), ["quality", "toxic"])


@registered("SELECT doc_id AS line_idx, coalesce(quality, 0)::DOUBLE AS quality, coalesce(toxic, 0)::DOUBLE AS toxic FROM documents LEFT JOIN labels USING (doc_id)")
def index_project_missing_zero(spark, sf_dir):
    return index.build_index(_labelled(spark, sf_dir), ["quality", "toxic"])


@registered("SELECT doc_id AS line_idx, quality::DOUBLE AS quality, toxic::DOUBLE AS toxic FROM labels")
def strict_vector_check(spark, sf_dir):
    t = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("line_idx"), "quality", "toxic")
    return index.strict_vectors(index.narrow(t, ["quality", "toxic"]), ["quality", "toxic"])


@registered("SELECT unnest(['quality', 'toxic']) AS key, unnest([0, 1]) AS place")
def infer_keys_first_row(spark, sf_dir):
    t = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("line_idx"), "toxic", "quality")
    keys = score_keys(index.narrow(t, ["toxic", "quality"]))
    return spark.createDataFrame(list(zip(keys, range(len(keys)), strict=True)), "key string, place int")


W = {"l_quantity": 0.5, "l_extendedprice": 0.00125, "l_discount": 2.0, "l_tax": -1.0}
_WSUM = "0.0::DOUBLE + l_quantity * 0.5::DOUBLE + l_extendedprice * 0.00125::DOUBLE + l_discount * 2.0::DOUBLE + l_tax * (-1.0)::DOUBLE"


@registered(f"SELECT {_LINE}, {_WSUM} AS _weighted_score FROM lineitem")
def weighted_score(spark, sf_dir):
    t = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", *LINE_KEYS)
    return scoring.weighted(t, W).drop(*LINE_KEYS)


@registered("SELECT doc_id AS line_idx, CASE WHEN quality IS NULL AND toxic IS NULL THEN NULL ELSE 0.0::DOUBLE + coalesce(quality, 0)::DOUBLE * 0.75::DOUBLE + coalesce(toxic, 0)::DOUBLE * (-0.25)::DOUBLE END AS final_score FROM documents LEFT JOIN labels USING (doc_id)")
def final_score(spark, sf_dir):
    rows = _labelled(spark, sf_dir).withColumn("scores", F.when(F.size("scores") > 0, F.col("scores")))
    return scoring.final_score(rows, {"quality": 0.75, "toxic": -0.25}).select("line_idx", "final_score")


_LAYERS = {"Layer1_c1": {"value": 0.7, "user_id": 0.3}, "Layer1_c2": {"user_id": 1.0, "absent": 2.0}}
_LAYER_SQL = """s AS (SELECT event_id, value, user_id, 0.0::DOUBLE + value * 0.7::DOUBLE + user_id::DOUBLE * 0.3::DOUBLE AS a, 0.0::DOUBLE + user_id::DOUBLE * 1.0::DOUBLE AS b FROM events),
m AS (SELECT min(a) AS a0, max(a) AS a1, min(b) AS b0, max(b) AS b1 FROM s)"""


def _layered(spark, sf_dir):
    t = table(spark, sf_dir, "events").select("event_id", "value", "user_id", F.lit(None).cast("double").alias("absent"))
    return scoring.layer_scores(t, _LAYERS)


@registered(f'WITH {_LAYER_SQL} SELECT event_id, a AS "Layer1_c1_orig", b AS "Layer1_c2_orig", (a - a0) / (a1 - a0) AS "Layer1_c1", (b - b0) / (b1 - b0) AS "Layer1_c2" FROM s, m')
def layer_aggregate_minmax(spark, sf_dir):
    return _layered(spark, sf_dir).drop("value", "user_id", "absent")


@registered(f"WITH {_LAYER_SQL} SELECT event_id, round(0.0::DOUBLE + (a - a0) / (a1 - a0) * 0.6::DOUBLE + (b - b0) / (b1 - b0) * 0.4::DOUBLE, 9) AS final_score FROM s, m")
def two_layer_score(spark, sf_dir):
    out = scoring.final_score_wide(_layered(spark, sf_dir), {"Layer1_c1": 0.6, "Layer1_c2": 0.4})
    return out.select("event_id", F.round("final_score", 9).alias("final_score"))


@registered("SELECT l_orderkey, l_linenumber, unnest(['l_discount', 'l_tax']) AS key, unnest([l_discount, l_tax]) AS value FROM lineitem")
def wide_to_score_map(spark, sf_dir):
    t = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_discount", "l_tax")
    return index.narrow(t, ["l_discount", "l_tax"]).select("l_orderkey", "l_linenumber", F.explode("scores").alias("key", "value"))


@registered("SELECT l_orderkey, l_linenumber, l_discount, l_tax, NULL::DOUBLE AS absent FROM lineitem")
def score_map_to_wide(spark, sf_dir):
    t = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_discount", "l_tax")
    return index.wide(index.narrow(t, ["l_discount", "l_tax"]), ["l_discount", "l_tax", "absent"])


# ---- selection


@registered("SELECT o_orderkey AS line_idx, o_totalprice AS score FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 1500")
def topk_fast(spark, sf_dir):
    t = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("line_idx"), F.col("o_totalprice").alias("score"))
    return selection.top_k(t, "score", 1500)


_ORDERS = "o AS (SELECT o_orderkey AS line_idx, o_orderstatus AS cluster_id, floor(o_totalprice / 10000) AS score FROM orders)"


def _coarse(spark, sf_dir):
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("line_idx"), F.col("o_orderstatus").alias("cluster_id"), F.floor(F.col("o_totalprice") / 10000).cast("double").alias("score"))


@registered(f"""WITH {_ORDERS}, t AS (SELECT min(score) AS t, (SELECT count(*) FROM o WHERE score > min(x.score)) AS m FROM (SELECT score FROM o ORDER BY score DESC LIMIT 1500) x),
f AS (SELECT o.* FROM o, t WHERE score >= t ORDER BY line_idx LIMIT 1500),
e AS (SELECT f.* FROM f, t WHERE score = t QUALIFY row_number() OVER (ORDER BY line_idx DESC) <= 1500 - m)
SELECT o.* FROM o, t WHERE score > t UNION ALL SELECT * FROM e""")
def topk_heap_exact(spark, sf_dir):
    return selection.top_k_heap(_coarse(spark, sf_dir), "score", 1500)


@registered("SELECT doc_id, source, n_chars FROM documents ORDER BY n_chars DESC, doc_id LIMIT 200")
def late_materialised_topk(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").withColumnRenamed("doc_id", "line_idx")
    best = selection.top_k(docs.select("line_idx", "n_chars"), "n_chars", 200)
    return index.fetch(docs.select("line_idx", "source", "n_chars"), best).withColumnRenamed("line_idx", "doc_id")


def _quota_sql(k: float, group: str = "cluster_id") -> str:
    return f"""n AS (SELECT {group} AS g, count(*) AS n, greatest(1, ceil(count(*)::DOUBLE * ({k}::DOUBLE / 100.0::DOUBLE)))::BIGINT AS n_keep FROM o GROUP BY 1),
q AS (SELECT g, n, n_keep, score AS threshold FROM (SELECT {group} AS g, score, row_number() OVER (PARTITION BY {group} ORDER BY score DESC) AS r FROM o) JOIN n USING (g) WHERE r = n_keep)"""


def _fill_sql(k: float, group: str = "cluster_id") -> str:
    return f"{_quota_sql(k, group)} SELECT line_idx, cluster_id, score FROM (SELECT o.*, n_keep, row_number() OVER (PARTITION BY g ORDER BY line_idx) AS r FROM o JOIN q ON g = {group} WHERE score >= threshold) WHERE r <= n_keep"


@registered(f"WITH {_ORDERS}, {_fill_sql(10)}")
def sample_per_cluster(spark, sf_dir):
    return selection.top_percent(_coarse(spark, sf_dir), "score", 10, "cluster_id")


@registered(f"WITH {_ORDERS}, {_fill_sql(7, "''")}")
def sample_global(spark, sf_dir):
    return selection.top_percent(_coarse(spark, sf_dir), "score", 7)


@registered(f"WITH {_ORDERS}, {_quota_sql(10)} SELECT line_idx, cluster_id, score FROM (SELECT o.*, n_keep, row_number() OVER (PARTITION BY g ORDER BY score DESC, line_idx) AS r FROM o JOIN q ON g = cluster_id) WHERE r <= n_keep")
def sample_strict(spark, sf_dir):
    return selection.top_percent(_coarse(spark, sf_dir), "score", 10, "cluster_id", mode="strict")


@registered(f"WITH o AS (SELECT event_id AS line_idx, event_type AS cluster_id, value AS score FROM events), {_quota_sql(7)} SELECT g AS \"group\", n, n_keep, threshold FROM q")
def quota_table(spark, sf_dir):
    return selection.quotas(table(spark, sf_dir, "events"), "value", 7, "event_type")


def flagship(spark, sf_dir):
    """Scores of events: winsorize, scale, weigh, and take the best tenth of each type in line order."""
    t = table(spark, sf_dir, "events").select(F.col("event_id").alias("line_idx"), "event_type", "value", F.col("user_id").cast("double").alias("user_id"))
    limits = normalize.bounds_dict(normalize.bounds(t, ["value", "user_id"], 5, 95))
    scored = scoring.weighted(normalize.normalized(t, limits), {"value": 0.75, "user_id": 0.25}, "final_score")
    return selection.top_percent(scored, "final_score", 10, "event_type").select("line_idx", "event_type", "final_score")


_EVENTS = f"o AS (SELECT event_id AS line_idx, event_type AS cluster_id, 0.0::DOUBLE + {_unit_sql('value')} * 0.75::DOUBLE + {_unit_sql('user_id::DOUBLE')} * 0.25::DOUBLE AS score FROM events)"
QUERIES["flagship"], SQL["flagship"] = flagship, f"SELECT line_idx, cluster_id AS event_type, score AS final_score FROM (WITH {_EVENTS}, {_fill_sql(10)})"


# ---- joins


@registered("SELECT doc_id AS line_idx, source, label AS cluster_id FROM documents JOIN embeddings ON doc_id = vec_id")
def assign_cluster(spark, sf_dir):
    labels = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("line_idx"), F.col("label").alias("cluster_id"))
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("line_idx"), "source")
    return vectors.assign_clusters(docs.join(labels, "line_idx", "left_semi"), labels.join(docs, "line_idx", "left_semi"))


@registered("SELECT doc_id AS id, quality::DOUBLE AS quality, toxic::DOUBLE AS toxic, ((quality IS NOT NULL)::INT + (toxic IS NOT NULL)::INT)::INT AS n FROM documents LEFT JOIN labels USING (doc_id)")
def merge_scores_by_id(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"))
    out = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), F.inline(F.array(*(F.struct(F.lit(k).alias("metric"), F.col(k).alias("score")) for k in ("quality", "toxic")))))
    return vectors.merge_scores(docs, out).select("id", F.col("scores")["quality"].alias("quality"), F.col("scores")["toxic"].alias("toxic"), F.size("scores").alias("n"))


# ---- metrics


@registered("SELECT 'quality' AS key, count(*) - count(quality) AS missing FROM documents LEFT JOIN labels USING (doc_id) UNION ALL SELECT 'n_chars', count(*) - count(n_chars) FROM documents")
def missing_counts(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return metrics.missing_counts(docs, ["quality", "n_chars"])


_PAIRS = [(a, b) for i, a in enumerate(LINE_KEYS) for b in LINE_KEYS[i:]]
_CORR = " UNION ALL ".join(f"SELECT '{a}' AS key_a, '{b}' AS key_b, round(corr({a}, {b}), 9) AS corr FROM lineitem" for a, b in _PAIRS)


@registered(_CORR)
def pearson_matrix(spark, sf_dir):
    return metrics.correlations(table(spark, sf_dir, "lineitem"), LINE_KEYS).withColumn("corr", F.round("corr", 9))


@registered(f"SELECT key_a, key_b, CASE WHEN key_a = key_b THEN 0 ELSE round(greatest(1 - abs(corr), 0), 8) END AS distance FROM ({_CORR})")
def corr_distance(spark, sf_dir):
    return metrics.distances(metrics.correlations(table(spark, sf_dir, "lineitem"), LINE_KEYS), True).withColumn("distance", F.round("distance", 8))


_OF = {"l_quantity": 1, "l_extendedprice": 1, "l_discount": 1, "l_tax": 2}


@registered(f"WITH c AS ({_CORR}) SELECT 1 AS cluster, 3::BIGINT AS n_metrics, round(avg(corr), 8) AS mean_corr FROM c WHERE key_a <> key_b AND 'l_tax' NOT IN (key_a, key_b) UNION ALL SELECT 2, 1::BIGINT, NULL")
def within_cluster_corr(spark, sf_dir):
    return metrics.within_clusters(metrics.correlations(table(spark, sf_dir, "lineitem"), LINE_KEYS), _OF).withColumn("mean_corr", F.round("mean_corr", 8))


@registered()
def metric_clusters(spark, sf_dir):
    t = text.doc_metrics(table(spark, sf_dir, "documents")).select("chars", "words", "unique_words", (F.col("doc_id") % 7).cast("double").alias("other"))
    return spark.createDataFrame(sorted(metrics.metric_clusters(t, t.columns, 2).items()), "key string, cluster int")


@registered("SELECT least(count(*), 1000) AS n, least(count(*), 1000) AS distinct_n FROM events")
def metric_sample(spark, sf_dir):
    t = metrics.sample_rows(table(spark, sf_dir, "events"), 1000, line="event_id")
    return t.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("event_id").alias("distinct_n"))


@registered(f"WITH c AS ({_CORR}), k AS (SELECT unnest(['l_discount', 'l_extendedprice', 'l_quantity', 'l_tax']) AS key, unnest([0, 1, 2, 3]) AS place), b AS (SELECT * FROM c UNION ALL SELECT key_b, key_a, corr FROM c WHERE key_a <> key_b) SELECT x.place AS \"row\", y.place AS col, key_a, key_b, corr FROM b JOIN k x ON x.key = key_a JOIN k y ON y.key = key_b")
def matrix_reorder(spark, sf_dir):
    return metrics.reordered(metrics.correlations(table(spark, sf_dir, "lineitem"), LINE_KEYS).withColumn("corr", F.round("corr", 9)), _OF)


# ---- vectors


def _vectors(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("line_idx"), F.col("embedding").alias("vector"), "label")


_MEANS = """p AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) AS i FROM embeddings),
m AS (SELECT label, i, avg(v) AS m FROM p GROUP BY 1, 2)"""


@registered()
def kmeans_labels(spark, sf_dir):
    return vectors.kmeans(_vectors(spark, sf_dir), 10)[0].select("line_idx", "cluster_id")


@registered(f"WITH {_MEANS}, d AS (SELECT vec_id, m.label, sum((v - m) * (v - m)) AS d FROM p JOIN m USING (i) GROUP BY 1, 2) SELECT vec_id AS line_idx, arg_min(label, d) AS cluster_id FROM d GROUP BY 1")
def lloyd_assign(spark, sf_dir):
    v = _vectors(spark, sf_dir)
    return vectors.nearest(v, vectors.means(v, "label")).select("line_idx", "cluster_id")


_STEP = f"""{_MEANS}, d AS (SELECT vec_id, m.label, sum((v - m) * (v - m)) AS d FROM p JOIN m USING (i) GROUP BY 1, 2),
a AS (SELECT vec_id, arg_min(label, d) AS c FROM d GROUP BY 1), n AS (SELECT c, i, avg(v) AS m FROM p JOIN a USING (vec_id) GROUP BY 1, 2)"""


@registered(f"WITH {_STEP} SELECT m.label AS cluster_id, m.i - 1 AS place, round(coalesce(n.m, m.m), 6) AS value FROM m LEFT JOIN n ON n.c = m.label AND n.i = m.i")
def lloyd_step(spark, sf_dir):
    v = _vectors(spark, sf_dir)
    new = vectors.lloyd_step(v, vectors.means(v, "label"))
    return new.select("cluster_id", F.posexplode("centroid").alias("place", "value")).withColumns({"value": F.round("value", 6), "place": F.col("place").cast("long")})


@registered(f"WITH {_STEP} SELECT round(sum((coalesce(n.m, m.m) - m.m) ** 2), 6) AS shift FROM m LEFT JOIN n ON n.c = m.label AND n.i = m.i")
def centroid_shift(spark, sf_dir):
    v = _vectors(spark, sf_dir)
    old = vectors.means(v, "label")
    return vectors.shift(old, vectors.lloyd_step(v, old)).withColumn("shift", F.round("shift", 6))


@registered("WITH s AS (SELECT count(*) AS n FROM embeddings GROUP BY label) SELECT count(*) AS clusters, sum(n)::BIGINT AS rows, max(n) AS largest, min(n) AS smallest, avg(n) AS mean, median(n) AS median, round(stddev_pop(n), 9) AS std FROM s")
def cluster_distribution(spark, sf_dir):
    return vectors.distribution(table(spark, sf_dir, "embeddings"), "label").withColumn("std", F.round("std", 9))


@registered("WITH s AS (SELECT count(*) AS n FROM embeddings GROUP BY label), r AS (SELECT min(n) AS lo, max(n) AS hi, greatest(1, least(5, count(*), max(n) - min(n) + 1)) AS k FROM s) SELECT least(floor((n - lo) / ((hi - lo) / k::DOUBLE)), k - 1)::INT AS bin, count(*) AS clusters FROM s, r GROUP BY 1")
def cluster_size_histogram(spark, sf_dir):
    return vectors.size_histogram(table(spark, sf_dir, "embeddings"), 5, "label").select("bin", "clusters")


# ---- texts


@registered("SELECT conv_id, turn, concat_ws(chr(10), nullif(role, ''), nullif(text, '')) AS text FROM conversations")
def text_assemble(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", text.assembled(["role", "text"]).alias("text"))


_TOKENS = "list_filter(string_split_regex(text, '[ \\t\\n\\x0B\\f\\r]+'), lambda x: x <> '')"


@registered(f"SELECT doc_id, len({_TOKENS})::INT AS n_tokens, len({_TOKENS}) > 100 AS truncated, md5(CASE WHEN len({_TOKENS}) > 100 THEN array_to_string({_TOKENS}[1:100], ' ') ELSE text END) AS digest FROM documents")
def text_truncate(spark, sf_dir):
    t = text.truncated(table(spark, sf_dir, "documents").select("doc_id", "text"), 100)
    return t.select("doc_id", "n_tokens", "truncated", F.md5("text").alias("digest"))


@registered(f"SELECT doc_id AS line_idx FROM documents WHERE len({_TOKENS}) > 1000")
def truncation_report(spark, sf_dir):
    t = text.truncated(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("line_idx"), "text"), 1000)
    return text.truncation_report(t)


@registered(f"SELECT doc_id, length(text)::DOUBLE AS chars, len({_TOKENS})::DOUBLE AS words, len(list_distinct({_TOKENS}))::DOUBLE AS unique_words FROM documents")
def doc_metrics(spark, sf_dir):
    return text.doc_metrics(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")


# ---- weights and trials


WEIGHTS = {"Layer2_c1": {"Layer1_c1": 0.6, "Layer1_c2": 0.4}, "Layer2_c2": {"Layer1_c2": 1.0, "Layer1_c9": 0.5}, "Layer1_c1": {"a": 0.25, "b": 0.75}, "Layer1_c2": {"b": 0.5, "c": 0.5}}
_EDGES = "e(parent, child, weight) AS (VALUES " + ", ".join(f"('{p}', '{c}', {w}::DOUBLE)" for p, own in WEIGHTS.items() for c, w in own.items()) + ")"
_PATHS = f"""WITH RECURSIVE {_EDGES}, r AS (SELECT parent AS cluster, child AS leaf, weight FROM e UNION ALL SELECT r.cluster, e.child, r.weight * e.weight FROM r JOIN e ON e.parent = r.leaf),
l AS (SELECT cluster, leaf, sum(weight) AS weight FROM r WHERE NOT regexp_full_match(leaf, 'Layer[0-9]+_c[0-9]+') GROUP BY 1, 2)"""


@registered(f"{_PATHS} SELECT cluster, leaf, round(weight, 12) AS weight FROM l")
def leaf_weights(spark, sf_dir):
    return hierarchy.leaf_weights(hierarchy.edges(spark, WEIGHTS)).withColumn("weight", F.round("weight", 12))


@registered(f"{_PATHS} SELECT leaf, round(sum(weight) / 2, 12) AS weight FROM l WHERE cluster LIKE 'Layer2%' GROUP BY leaf")
def final_leaf_weights(spark, sf_dir):
    return hierarchy.final_leaf_weights(hierarchy.edges(spark, WEIGHTS)).withColumn("weight", F.round("weight", 12))


@registered(f"WITH {_EDGES} SELECT regexp_extract(parent, '^Layer([0-9]+)_', 1)::INT AS layer, parent AS cluster, string_agg(child, ',' ORDER BY child) AS children FROM e GROUP BY 1, 2")
def weight_hierarchy(spark, sf_dir):
    return hierarchy.hierarchy(hierarchy.edges(spark, WEIGHTS)).withColumn("children", F.array_join("children", ","))


_STATE = "CASE o_orderstatus WHEN 'F' THEN 'COMPLETE' WHEN 'O' THEN 'FAIL' ELSE 'RUNNING' END"
_TRIALS = f"t AS (SELECT o_orderkey::INT AS trial_number, {_STATE} AS state, CASE WHEN o_orderkey % 50 = 0 THEN 0.0 ELSE floor(o_totalprice / 100) END::DOUBLE AS eval_loss FROM orders)"


def _history(spark, sf_dir):
    """Orders as a stand-in for trials."""
    t = table(spark, sf_dir, "orders")
    state = F.when(F.col("o_orderstatus") == "F", "COMPLETE").when(F.col("o_orderstatus") == "O", "FAIL").otherwise("RUNNING")
    loss = F.when(F.col("o_orderkey") % 50 == 0, double(0.0)).otherwise(F.floor(F.col("o_totalprice") / 100).cast("double"))
    weights = F.create_map(F.lit("a"), (F.col("o_orderkey") % 5).cast("double"), F.lit("b"), (F.col("o_custkey") % 7).cast("double"))
    return t.select(F.col("o_orderkey").cast("int").alias("trial_number"), state.alias("state"), loss.alias("eval_loss"), weights.alias("weights"), F.col("o_orderdate").alias("datetime_start"))


@registered(f"WITH {_TRIALS} SELECT trial_number, eval_loss FROM t WHERE state = 'COMPLETE' ORDER BY eval_loss, trial_number LIMIT 1")
def trial_best(spark, sf_dir):
    return trials.best(_history(spark, sf_dir)).select("trial_number", "eval_loss")


@registered(f"WITH {_TRIALS} SELECT count(*) AS total, count(*) FILTER (state = 'COMPLETE') AS completed, count(*) FILTER (state <> 'COMPLETE') AS other, min(eval_loss) FILTER (state = 'COMPLETE') AS min_loss, max(eval_loss) FILTER (state = 'COMPLETE') AS max_loss, round(avg(eval_loss) FILTER (state = 'COMPLETE'), 6) AS avg_loss FROM t")
def trial_stats(spark, sf_dir):
    return trials.statistics(_history(spark, sf_dir)).withColumn("avg_loss", F.round("avg_loss", 6))


@registered(f"WITH {_TRIALS} SELECT trial_number, eval_loss FROM t ORDER BY CASE WHEN eval_loss IS NULL OR eval_loss = 0 THEN 'infinity'::DOUBLE ELSE eval_loss END, trial_number LIMIT 100")
def trial_sorted(spark, sf_dir):
    return trials.by_loss(_history(spark, sf_dir), 100).select("trial_number", "eval_loss")


@registered("WITH w AS (SELECT o_orderkey::INT AS trial_number, unnest(['a', 'b']) AS key, unnest([o_orderkey % 5, o_custkey % 7])::DOUBLE AS weight FROM orders) SELECT trial_number, 1 AS rank, key, weight FROM w QUALIFY row_number() OVER (PARTITION BY trial_number ORDER BY weight DESC, key) = 1")
def trial_top_weights(spark, sf_dir):
    return trials.top_weights(_history(spark, sf_dir), 1)


@registered(f"WITH {_TRIALS} SELECT trial_number, state, eval_loss, (o_orderkey % 5)::DOUBLE AS weight_a, (o_custkey % 7)::DOUBLE AS weight_b FROM t JOIN orders ON o_orderkey = trial_number")
def trial_pivot(spark, sf_dir):
    return trials.pivoted(_history(spark, sf_dir)).drop("datetime_start")


@registered(f"WITH {_TRIALS} SELECT trial_number FROM t JOIN orders ON o_orderkey = trial_number WHERE state = 'RUNNING' AND o_orderdate < TIMESTAMP '1996-01-01' - INTERVAL 24 HOUR")
def zombie_trials(spark, sf_dir):
    now = F.lit("1996-01-01").cast("timestamp")
    return _history(spark, sf_dir).where(trials.zombies(now)).select("trial_number")


def _losses(spark, sf_dir):
    """The first events as completed trials."""
    return table(spark, sf_dir, "events").where("event_id < 400").select(F.col("event_id").cast("int").alias("trial_number"), F.lit("COMPLETE").alias("state"), F.col("value").alias("eval_loss"))


def _stop_sql(patience: int, delta: float) -> str:
    better = f"v < best - {delta}::DOUBLE"
    return f"""WITH RECURSIVE l AS (SELECT row_number() OVER (ORDER BY event_id) AS i, event_id::INT AS n, value AS v FROM events WHERE event_id < 400),
    s AS (SELECT 0::BIGINT AS i, 'infinity'::DOUBLE AS best, 0 AS run, NULL::INT AS stop UNION ALL
    SELECT l.i, CASE WHEN {better} THEN v ELSE best END, CASE WHEN {better} THEN 0 ELSE run + 1 END, CASE WHEN NOT ({better}) AND run + 1 >= {patience} THEN l.n END FROM s JOIN l ON l.i = s.i + 1 WHERE s.stop IS NULL)
    SELECT stop AS stopped_at, best FROM s ORDER BY i DESC LIMIT 1"""


@registered(_stop_sql(12, 0.0))
def early_stop_point(spark, sf_dir):
    return trials.early_stop(_losses(spark, sf_dir), 12, 0.0)


@registered(_stop_sql(25, 0.75))
def early_stop_delta(spark, sf_dir):
    return trials.early_stop(_losses(spark, sf_dir), 25, 0.75)


_KIND = "(o_custkey % 97) % 5"
_OLD = f"""c AS (SELECT c_custkey AS entry, (c_custkey * 7 % 111)::VARCHAR AS signature FROM customer WHERE c_custkey <= 300),
old AS (SELECT (o_custkey % 97)::VARCHAR AS signature, CASE {_KIND} WHEN 0 THEN 'COMPLETE' WHEN 1 THEN 'WAITING' WHEN 3 THEN 'FAIL' ELSE 'RUNNING' END AS state, {_KIND} = 4 AS stuck FROM orders)"""


def _signed(spark, sf_dir):
    """Customers as candidates, orders as trials of 97 signatures, a fifth of them stuck."""
    new = table(spark, sf_dir, "customer").where("c_custkey <= 300").select(F.col("c_custkey").alias("entry"), (F.col("c_custkey") * 7 % 111).cast("string").alias("signature"))
    now, kind = F.lit("2024-01-10").cast("timestamp"), F.col("o_custkey") % 97 % 5
    state = F.when(kind == 0, "COMPLETE").when(kind == 1, "WAITING").when(kind == 3, "FAIL").otherwise("RUNNING")
    old = table(spark, sf_dir, "orders").select((F.col("o_custkey") % 97).cast("string").alias("signature"), state.alias("state"), F.when(kind == 4, F.col("o_orderdate")).otherwise(now).alias("datetime_start"))
    return new, old, now


@registered(f"""WITH {_OLD}, s AS (SELECT signature, max(CASE WHEN state = 'COMPLETE' THEN 4 WHEN state = 'WAITING' THEN 3 WHEN state = 'RUNNING' AND NOT stuck THEN 2 ELSE 1 END) AS x FROM old GROUP BY 1)
SELECT entry, c.signature, CASE WHEN row_number() OVER (PARTITION BY c.signature ORDER BY entry) > 1 THEN 'duplicate' WHEN x = 4 THEN 'skip_complete' WHEN x = 3 THEN 'skip_waiting' WHEN x = 2 THEN 'skip_running' WHEN x = 1 THEN 'retry' ELSE 'new' END AS action FROM c LEFT JOIN s USING (signature)""")
def enqueue_plan(spark, sf_dir):
    return trials.enqueue_plan(*_signed(spark, sf_dir))


@registered(f"WITH {_OLD} SELECT min(entry) AS entry, signature FROM c WHERE signature NOT IN (SELECT signature FROM old WHERE state = 'COMPLETE') GROUP BY signature")
def signature_antijoin(spark, sf_dir):
    new, old, _ = _signed(spark, sf_dir)
    return trials.unseen(new, old).select("entry", "signature")


@registered(f"WITH {_OLD} SELECT status, string_agg(signature, ',' ORDER BY signature) AS signatures FROM (SELECT DISTINCT CASE WHEN stuck THEN 'ZOMBIE' ELSE state END AS status, signature FROM old) GROUP BY status")
def signatures_by_state(spark, sf_dir):
    _, old, now = _signed(spark, sf_dir)
    return trials.signatures_by_state(old, now).withColumn("signatures", F.array_join("signatures", ","))


_Z = [0.5, -1.25, 3.0, 0.0]


@registered("WITH z AS (SELECT unnest([0, 1, 2, 3]) AS i, unnest([0.5, -1.25, 3.0, 0.0])::DOUBLE AS z), e AS (SELECT i, exp(z - max(z) OVER ()) AS e FROM z) SELECT i, round(e / sum(e) OVER (), 9) AS weight FROM e")
def softmax_weights(spark, sf_dir):
    return spark.createDataFrame(list(enumerate(softmax(_Z))), "i int, weight double").withColumn("weight", F.round("weight", 9))


@registered("WITH z AS (SELECT unnest([0, 1, 2, 3]) AS i, unnest([0.5, -1.25, 3.0, 0.0])::DOUBLE + 5 + 1e-8 AS e) SELECT i, round(e / sum(e) OVER (), 9) AS weight FROM z")
def linear_weights(spark, sf_dir):
    return spark.createDataFrame(list(enumerate(linear(_Z, -5.0))), "i int, weight double").withColumn("weight", F.round("weight", 9))


@cache
def _search_settings() -> search.Settings:
    return search.Settings(["value", "user_id"], 100, "linear", (0.0, 1.0), 7, 5, 50, patience=6)


@registered()
def tpe_search(spark, sf_dir):
    """A short search whose loss is least where value has 0.8 of the weight."""
    t = table(spark, sf_dir, "events").select(F.col("event_id").alias("line_idx"), "value", F.col("user_id").cast("double").alias("user_id"))
    study = search.Study(":memory:", "demo")
    search.enqueue(study, [{"value": 0.5, "user_id": 0.5}], _search_settings())
    search.inject_warmup(study, [({"value": 0.1, "user_id": 0.9}, 0.49)], _search_settings())
    search.run(study, t, lambda chosen, w: (w["value"] - 0.8) ** 2 + 0 * chosen.count(), 8, _search_settings())
    return study.frame(spark).select("trial_number", "state", "eval_loss", "is_warmup")


@registered("WITH w AS (SELECT unnest(['a', 'b', 'unknown']) AS k, unnest([0.4, 0.6, 1.0])::DOUBLE AS w) SELECT string_agg(round(w / t, 4)::VARCHAR, ',' ORDER BY k) AS signature FROM w, (SELECT sum(w) AS t FROM w) WHERE k <> 'unknown'")
def weight_signature(spark, sf_dir):
    return spark.createDataFrame([(",".join(map(str, signature({"a": 0.4, "b": 0.6, "unknown": 1.0}, ["a", "b"]))),)], "signature string")


# ---- files: tables written as the files that the library reads, and read again


def _written(lines: DataFrame, order: str) -> str:
    """The folder of a pool that holds column raw, in order."""
    path = f"{shared_dir(lines.sparkSession)}/scoresieve/pool-{uuid.uuid4().hex}"
    pool.write_raw(lines.orderBy(order), path)
    return path


def _ids(spark, sf_dir) -> DataFrame:
    raw = F.concat(F.lit('{"id": '), F.col("doc_id"), F.lit(', "n": '), F.col("n_chars"), F.lit(', "source": "'), F.col("source"), F.lit('"}'))
    return table(spark, sf_dir, "documents").select("doc_id", "n_chars", "source", raw.alias("raw"))


_AT = "row_number() OVER (ORDER BY doc_id) - 1"
_RAW = """'{"id": ' || doc_id || ', "n": ' || n_chars || ', "source": "' || source || '"}'"""


@registered(f"SELECT {_AT} AS line_idx, doc_id::VARCHAR AS id, source AS instruction, quality::DOUBLE AS quality, toxic::DOUBLE AS toxic FROM documents LEFT JOIN labels USING (doc_id)")
def jsonl_scan(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    path = f"{shared_dir(spark)}/scoresieve/pool-{uuid.uuid4().hex}"
    pool.write_json_lines(docs.select(F.col("doc_id").alias("id"), F.col("source").alias("instruction"), F.struct("quality", "toxic").alias("scores")).orderBy("id"), path)
    return pool.read_pool(spark, path).select("line_idx", "id", "instruction", F.col("scores")["quality"].alias("quality"), F.col("scores")["toxic"].alias("toxic"))


@registered(f"SELECT line_idx, doc_id::VARCHAR AS id FROM (SELECT {_AT} AS line_idx, doc_id FROM documents) WHERE doc_id % 7 NOT IN (3, 5)")
def jsonl_tolerant_scan(spark, sf_dir):
    kind = F.col("doc_id") % 7
    lines = _ids(spark, sf_dir).withColumn("raw", F.when(kind == 3, F.substring("raw", 1, 9)).when(kind == 5, " ").otherwise(F.col("raw")))
    return pool.read_pool(spark, _written(lines, "doc_id"), on_error="drop").select("line_idx", "id")


@registered("SELECT min(doc_id) AS id, arg_min(n_chars, doc_id) AS n FROM documents WHERE doc_id > 4")
def first_record(spark, sf_dir):
    lines = _ids(spark, sf_dir).withColumn("raw", F.when(F.col("doc_id") <= 4, "").otherwise(F.col("raw")))
    found = pool.first_record(pool.read_lines(spark, _written(lines, "doc_id")))
    return spark.createDataFrame([(found["id"], found["n"])], "id long, n long")


@registered(f"SELECT {_RAW} AS value FROM documents WHERE n_chars > 500")
def raw_passthrough(spark, sf_dir):
    return spark.read.text(_written(_ids(spark, sf_dir).where("n_chars > 500"), "doc_id"))


@registered(f"SELECT {_AT} AS line_idx, {_RAW} AS raw FROM documents")
def line_positions(spark, sf_dir):
    return pool.read_lines(spark, _written(_ids(spark, sf_dir), "doc_id"))


@registered("SELECT doc_id, source FROM documents WHERE n_chars > 500")
def replaced_table(spark, sf_dir):
    path = f"{shared_dir(spark)}/scoresieve/table-{uuid.uuid4().hex}"
    _ids(spark, sf_dir).select("doc_id", "n_chars", "source").write.parquet(path)
    pool.replaced(spark.read.parquet(path).where("n_chars > 500").select("doc_id", "source"), path)
    return spark.read.parquet(path)


@registered(f"SELECT {_AT} AS line_idx, n_chars::DOUBLE AS v FROM documents")
def scores_or_source(spark, sf_dir):
    field = F.when(F.col("doc_id") % 2 == 0, "scores").otherwise("source")
    lines = _ids(spark, sf_dir).withColumn("raw", F.concat(F.lit('{"'), field, F.lit('": {"v": '), F.col("n_chars"), F.lit(', "w": "x"}}')))
    rows = pool.read_pool(spark, _written(lines, "doc_id"))
    return rows.select("line_idx", pool.scores_or_source()["v"].alias("v"))


@registered("SELECT o_orderkey AS line_idx, o_custkey::DOUBLE AS c, o_totalprice AS t FROM orders")
def index_columns(spark, sf_dir):
    path = f"{shared_dir(spark)}/scoresieve/index-{uuid.uuid4().hex}"
    own = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("line_idx"), F.col("o_totalprice").alias("t"), F.col("o_custkey").cast("double").alias("c"), F.lit(1.0).alias("x"))
    index.save_index(own, path)
    return index.load_index(spark, path, ["c", "t"])


def _records(spark, sf_dir) -> DataFrame:
    """Records with fields of all kinds and two scores; each eleventh line is none."""
    text = F.concat(F.lit('{"id": '), F.col("doc_id"), F.lit(', "lang": "'), F.col("lang"), F.lit('", "meta": {"z": [1, 2.5], "a": null}, "scores": {"q": '), F.col("n_chars"), F.lit(', "note": "5", "t": '), F.col("doc_id") % 10, F.lit("}, \"list\": [true]}"))
    lines = table(spark, sf_dir, "documents").select("doc_id", F.when(F.col("doc_id") % 11 == 10, F.concat(F.lit("{broken "), F.col("doc_id"))).otherwise(text).alias("raw"))
    return pool.records(pool.read_lines(spark, _written(lines, "doc_id")))


def _read(lines: DataFrame, more: str = "") -> DataFrame:
    """Line, what must not change, and the scores, read again; broken lines as they are."""
    schema = f"id long, lang string, meta string, list string, scores struct<q double, t double, note string{more}>, final_score double, cluster_id long"
    return lines.select("line_idx", F.when(F.col("raw").startswith("{broken"), F.col("raw")).alias("broken"), F.from_json("raw", schema).alias("j")).select("line_idx", "broken", "j.id", "j.lang", "j.meta", "j.list", "j.scores.note", "j.scores.q", "j.scores.t", "j.final_score", "j.cluster_id")


_RECORDS = f"d AS (SELECT doc_id, {_AT} AS line_idx, lang, n_chars::DOUBLE AS q, (doc_id % 10)::DOUBLE AS t, doc_id % 11 = 10 AS bad FROM documents)"
_SAME = """line_idx, CASE WHEN bad THEN '{broken ' || doc_id END AS broken, CASE WHEN NOT bad THEN doc_id END AS id, CASE WHEN NOT bad THEN lang END AS lang, CASE WHEN NOT bad THEN '{"z":[1,2.5],"a":null}' END AS meta, CASE WHEN NOT bad THEN '[true]' END AS list, CASE WHEN NOT bad THEN '5' END AS note"""


def _kept(rows: DataFrame, *more: str) -> DataFrame:
    return rows.select("line_idx", "broken", "id", "lang", "meta", "list", "note", *more)


@registered(f"""WITH {_RECORDS}, b AS (SELECT quantile_cont(q, 0.05) AS q0, quantile_cont(q, 0.95) AS q1, quantile_cont(t, 0.05) AS t0, quantile_cont(t, 0.95) AS t1 FROM d WHERE NOT bad)
SELECT {_SAME}, CASE WHEN NOT bad THEN (least(greatest(q, q0), q1) - q0) / (q1 - q0) END AS q, CASE WHEN NOT bad THEN 1 - (least(greatest(t, t0), t1) - t0) / (t1 - t0) END AS t FROM d, b""")
def normalize_record(spark, sf_dir):
    rows = _records(spark, sf_dir)
    limits = normalize.bounds_dict(normalize.bounds(index.wide(rows.where("has_scores").select("scores"), ["q", "t"]), ["q", "t"], 5, 95))
    entries = normalize.normalized_entries(F.col("entries"), F.col("scores"), limits, ["t"])
    fields = F.when(F.col("has_scores"), pool.put(F.col("fields"), {"scores": pool.object_text(entries)})).otherwise(F.col("fields"))
    return _kept(_read(rows.select("line_idx", pool.rewritten(fields, F.col("raw")).alias("raw"))), "q", "t")


@registered(f"""WITH {_RECORDS}, s AS (SELECT *, 0.0::DOUBLE + q * 0.5::DOUBLE + t * 2.0::DOUBLE AS s FROM d WHERE NOT bad), m AS (SELECT min(s) AS lo, max(s) AS hi FROM s)
SELECT {_SAME}, q, t, s AS "Layer1_c1_orig", (s - lo) / (hi - lo) AS "Layer1_c1" FROM s, m""")
def layers_record(spark, sf_dir):
    from . import cli

    lines = cli.layered(_records(spark, sf_dir).where("fields is not null"), {"Layer1_c1": {"q": 0.5, "t": 2.0}})
    both = F.from_json("raw", "scores struct<Layer1_c1_orig double, Layer1_c1 double>")
    return _kept(_read(lines), "q", "t").join(lines.select("line_idx", both["scores"]["Layer1_c1_orig"].alias("Layer1_c1_orig"), both["scores"]["Layer1_c1"].alias("Layer1_c1")), "line_idx")


@registered(f"WITH {_RECORDS} SELECT {_SAME}, CASE WHEN NOT bad THEN q END AS q, CASE WHEN NOT bad THEN 0.0::DOUBLE + q * 0.25::DOUBLE + t * (-1.5)::DOUBLE END AS final_score FROM d")
def final_score_record(spark, sf_dir):
    from . import cli

    return _kept(_read(cli.finished(_records(spark, sf_dir), {"q": 0.25, "t": -1.5, "gone": 3.0})), "q", "final_score")


@registered(f"WITH {_RECORDS} SELECT {_SAME}, q, t, doc_id % 5 AS cluster_id FROM d WHERE NOT bad")
def assign_record(spark, sf_dir):
    rows = _records(spark, sf_dir)
    labels = table(spark, sf_dir, "documents").select((F.row_number().over(Window.orderBy("doc_id")) - 1).cast("long").alias("line_idx"), (F.col("doc_id") % 5).alias("cluster_id"))
    out = vectors.assign_clusters(rows, labels).where("fields is not null")
    return _kept(_read(out.select("line_idx", pool.rewritten(pool.put(F.col("fields"), {"cluster_id": F.col("cluster_id").cast("string")}), F.col("raw")).alias("raw"))), "q", "t", "cluster_id")


def _nations(spark, sf_dir) -> list:
    return table(spark, sf_dir, "nation").orderBy("n_nationkey").collect()


def _in_file(name: str, text: str, read):
    """What read makes of a small file of the driver."""
    with tempfile.TemporaryDirectory() as folder:
        path = Path(folder, name)
        path.write_text(text)
        return read(str(path))


@registered("SELECT n_name AS key, n_nationkey + 0.5::DOUBLE AS weight FROM nation")
def weights_file(spark, sf_dir):
    text = json.dumps({"best_weights": {r["n_name"]: r["n_nationkey"] + 0.5 for r in _nations(spark, sf_dir)}, "other": 1})
    return spark.createDataFrame(list(_in_file("w.json", text, files.load_weights).items()), "key string, weight double")


@registered("SELECT 'Layer1_c' || n_regionkey AS cluster, n_name AS key, n_nationkey::DOUBLE AS weight FROM nation")
def layer_weights_folder(spark, sf_dir):
    with tempfile.TemporaryDirectory() as folder:
        for region in {r["n_regionkey"] for r in _nations(spark, sf_dir)}:
            own = {r["n_name"]: float(r["n_nationkey"]) for r in _nations(spark, sf_dir) if r["n_regionkey"] == region}
            files.save_best_weights(f"{folder}/Layer1_c{region}/best_weights.json", "s", 0.5, own, 3, 9, "linear", (0.0, 1.0))
        found = files.load_all_weights(folder)
    return spark.createDataFrame([(c, k, w) for c, own in found.items() for k, w in own.items()], "cluster string, key string, weight double")


@registered("SELECT n_name AS study, n_nationkey::DOUBLE AS best_value, n_regionkey::BIGINT AS best_trial, n_nationkey + 100::BIGINT AS total_completed_trials, n_nationkey / 4.0::DOUBLE AS weight FROM nation")
def best_weights_file(spark, sf_dir):
    rows = []
    with tempfile.TemporaryDirectory() as folder:
        for r in _nations(spark, sf_dir):
            files.save_best_weights(f"{folder}/w.json", r["n_name"], float(r["n_nationkey"]), {"a": r["n_nationkey"] / 4.0}, r["n_regionkey"], r["n_nationkey"] + 100, "softmax", (-5.0, 5.0))
            data = json.loads(Path(folder, "w.json").read_text())
            rows.append((data["study_name"], data["best_value"], data["best_trial"], data["total_completed_trials"], data["best_weights"]["a"]))
    return spark.createDataFrame(rows, "study string, best_value double, best_trial long, total_completed_trials long, weight double")


@registered("SELECT n_regionkey::DOUBLE AS a, n_nationkey::DOUBLE AS eval_loss FROM nation WHERE n_nationkey % 4 <> 1")
def warmup_file(spark, sf_dir):
    entries = [{"weights": {"a": r["n_regionkey"]}, **({} if r["n_nationkey"] % 4 == 1 else {"eval_loss": r["n_nationkey"]})} for r in _nations(spark, sf_dir)]
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        found = _in_file("t.json", json.dumps(entries), lambda p: files.load_warmup_trials(p, ["a"]))
    return spark.createDataFrame([(w["a"], loss) for w, loss in found], "a double, eval_loss double")


@registered("SELECT n_regionkey::DOUBLE AS a, n_nationkey::DOUBLE AS b FROM nation WHERE n_nationkey % 4 <> 1")
def enqueued_file(spark, sf_dir):
    entries = [3 if r["n_nationkey"] % 4 == 1 else {"a": r["n_regionkey"], "b": r["n_nationkey"]} for r in _nations(spark, sf_dir)]
    return spark.createDataFrame([(w["a"], w["b"]) for w in _in_file("t.json", json.dumps(entries), files.load_enqueued)], "a double, b double")


@registered("SELECT arg_max(value, event_id) AS loss FROM events WHERE event_id < 500 AND event_id % 3 = 0")
def last_eval_loss(spark, sf_dir):
    rows = table(spark, sf_dir, "events").where("event_id < 500").orderBy("event_id").collect()
    text = json.dumps({"log_history": [{"eval_loss": r["value"]} if r["event_id"] % 3 == 0 else {"loss": r["value"]} for r in rows]})
    return spark.createDataFrame([(_in_file("s.json", text, lambda p: files.last_eval_loss(spark, p)),)], "loss double")


@registered("SELECT n_name AS name, row_number() OVER (ORDER BY n_nationkey) - 1 AS place FROM nation")
def score_list_file(spark, sf_dir):
    text = "# names\n\n" + "\n".join(f" {r['n_name']} " for r in _nations(spark, sf_dir))
    return spark.createDataFrame([(n, i) for i, n in enumerate(_in_file("n.txt", text, files.score_list))], "name string, place long")


@registered("SELECT n_name AS key, 'shown ' || n_nationkey AS shown FROM nation")
def display_names_file(spark, sf_dir):
    marks = ["\t", "=", ","]
    text = "\n".join(f"{r['n_name']}{marks[r['n_nationkey'] % 3]}shown {r['n_nationkey']}" for r in _nations(spark, sf_dir))
    return spark.createDataFrame(list(_in_file("n.txt", text, files.display_names).items()), "key string, shown string")


@registered("SELECT row_number() OVER (ORDER BY vec_id) - 1 AS line_idx, len(embedding)::INT AS dim, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE)), 6) AS total FROM embeddings")
def array_file(spark, sf_dir):
    folder = tempfile.mkdtemp()
    files.write_array(_vectors(spark, sf_dir), f"{folder}/v.npy")
    rows = files.read_array(spark, f"{folder}/v.npy").select("line_idx", F.size("vector").alias("dim"), F.round(F.aggregate("vector", double(0.0), lambda s, x: s + x), 6).alias("total"))
    out = spark.createDataFrame(rows.collect(), rows.schema)  # as many rows as the table has vectors here
    shutil.rmtree(folder)
    return out


@registered("SELECT n_nationkey AS trial_number, CASE n_nationkey % 3 WHEN 0 THEN 'COMPLETE' WHEN 1 THEN 'FAIL' ELSE 'WAITING' END AS state, CASE WHEN n_nationkey % 3 = 0 THEN n_regionkey + 0.125::DOUBLE END AS eval_loss, n_nationkey % 2 = 0 AS is_warmup FROM nation")
def study_store(spark, sf_dir):
    study = search.Study(":memory:", "demo")
    for r in _nations(spark, sf_dir):
        done = r["n_nationkey"] % 3 == 0
        study.add(state=("COMPLETE", "FAIL", "WAITING")[r["n_nationkey"] % 3], weights={"a": 1.0}, value=r["n_regionkey"] + 0.125 if done else None, warmup=r["n_nationkey"] % 2 == 0)
    return study.frame(spark).select("trial_number", "state", "eval_loss", "is_warmup")


@registered(f"WITH {_TRIALS} SELECT trial_number, state, eval_loss, (o_orderkey % 5)::DOUBLE AS a FROM t JOIN orders ON o_orderkey = trial_number")
def trials_json(spark, sf_dir):
    path = f"{shared_dir(spark)}/scoresieve/trials-{uuid.uuid4().hex}"
    trials.export_json(_history(spark, sf_dir), path)
    return spark.read.schema("trial_number int, state string, eval_loss double, weights map<string,double>").json(path).select("trial_number", "state", "eval_loss", F.col("weights")["a"].alias("a"))


@registered(" UNION ALL ".join(f"SELECT '{k}' AS key FROM (SELECT *, 1.0 AS one, NULL::DOUBLE AS none FROM lineitem) HAVING count(DISTINCT {k}) > 1" for k in [*LINE_KEYS, "one", "none"]))
def varying_metrics(spark, sf_dir):
    t = table(spark, sf_dir, "lineitem").select(*LINE_KEYS, double(1.0).alias("one"), F.lit(None).cast("double").alias("none"))
    return spark.createDataFrame([(k,) for k in metrics.varying(t, t.columns)], "key string")


@registered("SELECT r_regionkey + 1 AS cluster, count(*) AS n, string_agg(n_name, ',' ORDER BY n_name) AS names FROM region JOIN nation ON r_regionkey = n_regionkey GROUP BY 1")
def cluster_report(spark, sf_dir):
    text = metrics.report({r["n_name"]: r["n_regionkey"] + 1 for r in _nations(spark, sf_dir)}, None, {1: 0.5})
    rows = []
    for line in text.splitlines():
        if line.startswith("Cluster"):
            rows.append((int(line.split()[1]), int(line.split("(")[1].split()[0]), []))
        else:
            rows[-1][2].append(line.strip())
    return spark.createDataFrame([(c, n, ",".join(sorted(names))) for c, n, names in rows], "cluster int, n long, names string")


@registered("WITH o AS (SELECT o_orderkey AS line_idx, CASE WHEN o_custkey % 2 = 0 THEN o_orderstatus ELSE (o_custkey % 3)::VARCHAR END AS cluster_id, floor(o_totalprice / 10000) AS score FROM orders), " + _fill_sql(12.5))
def sample_mixed_ids(spark, sf_dir):
    group = F.when(F.col("o_custkey") % 2 == 0, F.col("o_orderstatus")).otherwise((F.col("o_custkey") % 3).cast("string"))
    t = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("line_idx"), group.alias("cluster_id"), F.floor(F.col("o_totalprice") / 10000).cast("double").alias("score"))
    return selection.top_percent(t, "score", 12.5, "cluster_id")


@registered("SELECT key, least(greatest(ln(greatest(w, 1e-10)), -2.5), 5.0) AS softmax_z, least(greatest(-1 + w * 3, -1.0), 2.0) AS linear_z FROM (SELECT r_name AS key, (r_regionkey::DOUBLE * r_regionkey) / 30 AS w FROM region)")
def parameters_of_weights(spark, sf_dir):
    own = {r["r_name"]: float(r["r_regionkey"]) ** 2 / 30 for r in table(spark, sf_dir, "region").collect()}
    keys = list(own)
    first, second = parameters_of(own, keys, "softmax", (-2.5, 5.0)), parameters_of(own, keys, "linear", (-1.0, 2.0))
    return spark.createDataFrame([(k, first[f"z_{k}"], second[f"z_{k}"]) for k in keys], "key string, softmax_z double, linear_z double")


@registered("WITH z AS (SELECT n_name AS key, n_nationkey / 10.0::DOUBLE AS z FROM nation) SELECT key, round(exp(z) / sum(exp(z)) OVER (), 9) AS softmax, round((z + 1 + 1e-8) / sum(z + 1 + 1e-8) OVER (), 9) AS linear FROM z")
def weights_by_method(spark, sf_dir):
    rows = _nations(spark, sf_dir)
    z = [r["n_nationkey"] / 10.0 for r in rows]
    both = zip(rows, weights_of(z, "softmax", (-5.0, 5.0)), weights_of(z, "linear", (-1.0, 5.0)), strict=True)
    return spark.createDataFrame([(r["n_name"], round(a, 9), round(b, 9)) for r, a, b in both], "key string, softmax double, linear double")


@registered("SELECT c_custkey AS n, least(ceil(0.1::DOUBLE * c_custkey), 25)::BIGINT AS good FROM customer WHERE c_custkey <= 400")
def good_trial_counts(spark, sf_dir):
    found = table(spark, sf_dir, "customer").where("c_custkey <= 400").select("c_custkey").collect()
    return spark.createDataFrame([(r[0], good_trials(r[0])) for r in found], "n long, good long")


@registered(SQL["final_leaf_weights"])
def weight_summary_files(spark, sf_dir):
    with tempfile.TemporaryDirectory() as folder:
        for name, own in WEIGHTS.items():
            files.save_best_weights(f"{folder}/{name.split('_')[0]}/{name}/best_weights.json", name, 1.0, own, 0, 1, "linear", (0.0, 1.0))
        data = hierarchy.summary(spark, folder, f"{folder}/out.json")
    return spark.createDataFrame(list(data["final_leaf_weights"].items()), "leaf string, weight double").withColumn("weight", F.round("weight", 12))


@registered(f"WITH {_TRIALS} SELECT trial_number, state, eval_loss FROM t WHERE state = 'COMPLETE' ORDER BY trial_number LIMIT 50")
def trial_listing(spark, sf_dir):
    return trials.by_number(trials.completed(_history(spark, sf_dir)), 50).select("trial_number", "state", "eval_loss")


@registered("SELECT event_id::INT AS trial_number, value AS eval_loss, min(value) OVER (ORDER BY event_id) AS best FROM events WHERE event_id < 400")
def running_best(spark, sf_dir):
    return trials.running_best(_losses(spark, sf_dir))


@registered(f"WITH {_TRIALS} SELECT trial_number, state, eval_loss, (o_orderkey % 5)::DOUBLE AS weight_a FROM t JOIN orders ON o_orderkey = trial_number")
def trials_csv(spark, sf_dir):
    path = f"{shared_dir(spark)}/scoresieve/trials-{uuid.uuid4().hex}"
    trials.export_csv(_history(spark, sf_dir), path)
    rows = spark.read.option("header", True).csv(path)
    return rows.select(F.col("trial_number").cast("int").alias("trial_number"), "state", F.col("eval_loss").cast("double").alias("eval_loss"), F.col("weight_a").cast("double").alias("weight_a"))


@registered("SELECT key, key IN ('l_tax', 'l_discount') AS have FROM (SELECT unnest(['l_tax', 'gone', 'l_discount']) AS key)")
def available_metrics(spark, sf_dir):
    have, lack = metrics.available(table(spark, sf_dir, "lineitem"), ["l_tax", "gone", "l_discount"])
    return spark.createDataFrame([(k, True) for k in have] + [(k, False) for k in lack], "key string, have boolean")


@registered("SELECT event_id, final_score FROM (SELECT event_id, 0.0::DOUBLE + (least(greatest(value, 10.0), 90.0) - 10.0) / 80.0 * 0.75::DOUBLE + (1 - (least(greatest(user_id::DOUBLE, 5.0), 100.0) - 5.0) / 95.0) * 0.25::DOUBLE AS final_score FROM events) WHERE final_score >= 0.5")
def streamed_scores(spark, sf_dir):
    """The events as an unbounded source, scored by frozen bounds and weights and appended to a table."""
    base = f"{shared_dir(spark)}/scoresieve/stream-{uuid.uuid4().hex}"
    own = table(spark, sf_dir, "events").select("event_id", "value", F.col("user_id").cast("double").alias("user_id"))
    own.repartition(3).write.parquet(f"{base}/in")
    stream = spark.readStream.schema(own.schema).option("maxFilesPerTrigger", 1).parquet(f"{base}/in")
    scored = streaming.scored_stream(stream, {"value": (10.0, 90.0), "user_id": (5.0, 100.0)}, {"value": 0.75, "user_id": 0.25}, ["user_id"], 0.5)
    streaming.start(scored.select("event_id", "final_score"), f"{base}/out", f"{base}/checkpoint").awaitTermination()
    return spark.read.schema("event_id long, final_score double").parquet(f"{base}/out")
