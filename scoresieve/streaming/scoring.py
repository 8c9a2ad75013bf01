"""Scoring of unbounded sources with frozen bounds and weights: a projection without state."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame

from ..operators.normalize import normalized
from ..operators.scoring import final_score_wide


def scored_stream(stream: DataFrame, limits: dict[str, tuple[float, float]], weights: Mapping[str, float], flip: Iterable[str] = (), threshold: float | None = None) -> DataFrame:
    """A stream (or table) of score columns, scaled and with ``final_score``; rows below the threshold are left out."""
    out = final_score_wide(normalized(stream, limits, flip), weights)
    return out if threshold is None else out.where(out["final_score"] >= threshold)


def start(stream: DataFrame, path: str, checkpoint: str, **options):
    """Append the stream to Parquet; each batch is written once."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(**(options or {"availableNow": True})).start()
