"""The score index: one double column for each metric, keyed by line."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Line numbers that may be broadcast to fetch records.
BROADCAST_LINES = 1_000_000


def build_index(pool: DataFrame, keys: Sequence[str], scores: str = "scores") -> DataFrame:
    """line_idx and a column for each key; a missing key is 0."""
    return pool.select("line_idx", *(F.coalesce(F.col(scores)[key], F.lit(0.0)).cast("double").alias(key) for key in keys))


def strict_vectors(pool: DataFrame, keys: Sequence[str], scores: str = "scores") -> DataFrame:
    """As ``build_index``, but a missing key is an error that names it."""
    return pool.select("line_idx", *(F.coalesce(F.col(scores)[key], F.raise_error(F.concat(F.lit(f"line "), F.col("line_idx").cast("string"), F.lit(f" has no score {key}"))).cast("double")).alias(key) for key in keys))


def save_index(index: DataFrame, path: str, parts: int | None = None) -> None:
    """Parquet in ranges of line_idx, so that row groups are skipped when lines are fetched."""
    (index.repartitionByRange(parts, "line_idx") if parts else index.repartitionByRange("line_idx")).sortWithinPartitions("line_idx").write.mode("overwrite").parquet(path)


def load_index(spark: SparkSession, path: str, keys: Sequence[str] | None = None) -> DataFrame:
    """The index, or the columns of some keys in the order given; only those are read."""
    index = spark.read.parquet(path)
    if keys is None:
        return index
    if missing := [k for k in keys if k not in index.columns]:
        raise ValueError(f"the index has no {', '.join(missing)}; it has {', '.join(index.columns[1:])}")
    return index.select("line_idx", *keys)


def fetch(pool: DataFrame, lines: DataFrame, line_idx: str = "line_idx") -> DataFrame:
    """The records of the given lines: a semi join, broadcast while the lines are few."""
    wanted = lines.select(line_idx)
    few = wanted.limit(BROADCAST_LINES + 1).count() <= BROADCAST_LINES
    return pool.join(F.broadcast(wanted) if few else wanted, line_idx, "left_semi")


def wide(pool: DataFrame, keys: Sequence[str], scores: str = "scores") -> DataFrame:
    """A map of scores as a column for each key; missing keys are null."""
    return pool.select("*", *(F.col(scores)[key].alias(key) for key in keys)).drop(scores)


def narrow(table: DataFrame, keys: Sequence[str], scores: str = "scores") -> DataFrame:
    """Columns as a map of scores, without nulls."""
    entries = F.create_map(*(x for key in keys for x in (F.lit(key), F.col(key).cast("double"))))
    return table.withColumn(scores, F.map_filter(entries, lambda k, v: v.isNotNull())).drop(*keys)
