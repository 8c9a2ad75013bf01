"""Mixing sources to target weights by Poisson replication."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import stored, unused

#: Bytes of the table of rates that may be broadcast (names of sources, and 24 bytes each).
BROADCAST_BYTES = 8 << 20
#: Copies of a document that one task makes; those of a document with more are made in several.
BLOCK = 256
SEED = "mix-1"


def uniform(seed: str, key: Column) -> Column:
    """A number in [0, 1) that depends on seed and key alone: 48 bits of a digest."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(seed + ":"), key)), 1, 12), 16, 10).cast("long").cast("double") / F.lit(float(1 << 48))


def rates(docs: DataFrame, targets: dict[str, float] | None = None, temperature: float = 0.5, volume: float = 1.0, source_col: str = "source", text_col: str = "text") -> DataFrame:
    """``source``, ``size`` (code points, one at least for a text), ``target`` (share of the mix) and ``rate`` (mean repetitions of a document).

    targets: weights by source, which need not add up to 1 (a source not named gets none, so none of its documents);
    without them a source's weight is its size to the power temperature. volume: size of the mix as a multiple of the input.
    """
    size = F.greatest(F.length(F.coalesce(F.col(text_col), F.lit(""))), F.lit(1)).cast("long")
    sizes = docs.select(F.col(source_col).alias("source"), size.alias("size")).groupBy("source").agg(F.sum("size").alias("size"))
    if targets is None:
        weighed = sizes.withColumn("weight", F.pow(F.col("size").cast("double"), F.lit(float(temperature))))
    else:
        named = F.create_map(*(F.lit(x) for kv in targets.items() for x in kv)) if targets else F.create_map().cast("map<string,double>")
        weighed = sizes.withColumn("weight", F.coalesce(F.try_element_at(named, F.coalesce(F.col("source").cast("string"), F.lit(""))).cast("double"), F.lit(0.0)))
    weighed = stored(weighed, "sizes")  # a row for each source
    weight, everything = weighed.agg(F.coalesce(F.sum("weight"), F.lit(0.0)), F.coalesce(F.sum("size"), F.lit(0)).cast("double")).first()
    share = F.col("weight") / F.lit(weight) if weight > 0 else F.lit(0.0)
    return weighed.select("source", "size", share.alias("target"), (share * F.lit(float(volume) * everything) / F.col("size")).alias("rate"))


def _distribution(rate: float) -> tuple[int, np.ndarray]:
    """The distribution function of a Poisson variable from a first value on, below which there is next to nothing, until next to nothing is left."""
    last = int(np.ceil(rate + 12 * np.sqrt(rate) + 20))
    if rate <= 500:
        return 0, np.cumsum(np.cumprod(np.r_[np.exp(-rate), rate / np.arange(1, last + 1)]))
    # exp(-rate) would vanish: ratios to the likeliest value both ways, then scaled to a sum of 1.
    first, top = max(0, int(rate - 12 * np.sqrt(rate) - 20)), int(rate)
    down = np.cumprod(np.arange(top, first, -1) / rate)[::-1]
    up = np.cumprod(rate / np.arange(top + 1, last + 1))
    p = np.r_[down, 1.0, up]
    return first, np.cumsum(p / p.sum())


def counts_of(u: np.ndarray, rates: np.ndarray) -> np.ndarray:
    """For each number u in [0, 1) the value at which the distribution function with that mean exceeds it; the work grows with the root of a rate."""
    out = np.zeros(len(u), np.int64)
    for rate in np.unique(rates[rates > 0]):
        own = np.flatnonzero(rates == rate)
        first, cdf = _distribution(float(rate))
        out[own] = first + np.searchsorted(cdf, u[own], "right")
    return out


def _counted(u: pa.Array, rates: pa.Array) -> pa.Array:
    return pa.array(counts_of(u.to_numpy(zero_copy_only=False), rates.to_numpy(zero_copy_only=False)), pa.int64())


def mixed(docs: DataFrame, seed: str = SEED, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", **options) -> DataFrame:
    """Documents replicated at their source's rate and shuffled globally.

    A document occurs as often as the Poisson variable with its source's rate whose distribution function is
    inverted at a number hashed from seed and id, so counts are the same however the job is cut or repeated.
    Adds ``copy_no`` (from 1) and ``order_key`` (hashed from seed, id and copy); partitions hold random documents,
    sorted by that key. Columns of these names in docs are replaced; all others are kept whatever their names.

    * Null sources are one source of their own. Null ids are told apart by their text. Rows that share an id are
      repeated equally often.
    * Null and empty texts count as one code point in sizes; texts of any length go whole. An empty table gives no rows.
    * The shuffle is by a hash of document and copy, so a source with a large part of all rows is spread evenly.
      Where a rate is so high that documents may have more than BLOCK copies, each block of copies is dealt out first.
    """
    spark = docs.sparkSession
    docs = docs.drop("copy_no", "order_key")
    source, rate, count, block = unused(docs, "source_of_rate", "rate", "count", "block")
    table = rates(docs, source_col=source_col, text_col=text_col, **options).select(F.col("source").alias(source), F.col("rate").alias(rate))
    size, most = table.agg(F.coalesce(F.sum(F.coalesce(F.octet_length(F.col(source).cast("string")), F.lit(0)) + 24), F.lit(0)), F.max(rate)).first()
    ident = F.coalesce(F.col(id_col).cast("string"), F.concat(F.lit("text "), F.md5(F.coalesce(F.col(text_col), F.lit("")))))
    rows = docs.join(F.broadcast(table) if size <= BROADCAST_BYTES else table, docs[source_col].eqNullSafe(table[source])).drop(source)
    # Rates up to which a count beyond BLOCK has a chance below any 48-bit number.
    tame = (np.sqrt(BLOCK + 16) - 6) ** 2 - 20
    counted = F.arrow_udf(_counted, "long")
    repeated = lambda x: x.withColumn(count, counted(uniform(seed, ident), F.col(rate))).where(F.col(count) > 0)
    low = repeated(rows.where(F.col(rate) <= float(tame))).withColumn("copy_no", F.explode(F.sequence(F.lit(1).cast("long"), F.col(count)))).drop(rate, count)
    if most is not None and most > tame:
        high = repeated(rows.where(F.col(rate) > float(tame)))
        high = high.withColumn(block, F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col(count) - 1) / BLOCK))))
        high = high.repartition(F.xxhash64(ident, F.col(block)))
        here = F.sequence(F.col(block) * BLOCK + 1, F.least(F.col(count), (F.col(block) + 1) * BLOCK))
        low = low.unionByName(high.withColumn("copy_no", F.explode(here)).drop(rate, count, block))
    order = F.conv(F.substring(F.md5(F.concat(F.lit(seed + ":order:"), ident, F.lit(":"), F.col("copy_no").cast("string"))), 1, 15), 16, 10).cast("long")
    out = low.withColumn("order_key", order)
    return out.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "order_key").sortWithinPartitions("order_key")
