"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import dropped, stored


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x"), F.sum(F.crc32(F.concat_ws(":", "u", "v"))).alias("s")).first()
    return tuple(row)


def components(links: DataFrame, a: str = "a", b: str = "b", most_rounds: int = 60) -> DataFrame:
    """One row ``(id, component_id)`` for each id that some link joins to another; component_id is the smallest id reachable.

    links: pairs of integer ids in columns a and b; either order, repeats, self links and nulls
    do no harm (self links and links with a null end are ignored); no links give no rows.
    Each round is written to the shared folder, so a lost executor costs one round at most.
    Minima are taken by aggregation, so a hub with many links is combined before the shuffle,
    and the joins back to them are plain inner joins, which adaptive execution splits when skewed.
    """
    edges = stored(links.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), "edges")
    before = _state(edges)
    for _ in range(most_rounds):
        if not before[0]:
            break
        both = edges.union(edges.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        small = large.groupBy("u").agg(F.min("v").alias("m"))
        step = large.join(small, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(small.select("u", "m"))
        after_edges = stored(step.distinct(), "edges")
        dropped(edges)
        edges, after = after_edges, _state(after_edges)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"no components after {most_rounds} rounds")
    roots = edges.select(F.col("v").alias("id"), F.col("v").alias("component_id")).distinct()
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component_id")).union(roots)
