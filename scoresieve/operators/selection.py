"""Top-k and top-percent selection with exact rules for ties.

None of these sorts a whole group in one task: thresholds are bracketed by approximate percentiles until few values
are left between the ends, ties are cut by counts over blocks of lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expressions import double, unused

#: Groups up to this size are ranked over all their distinct values; larger ones over as many between the ends of a bracket.
SMALL_GROUP = 100_000
ACCURACY = 10_000
BLOCK = 1 << 16
#: Groups whose sizes, quotas and thresholds may be broadcast, about 100 bytes each.
BROADCAST_GROUPS = 500_000
#: Groups whose numbers pass through the driver, so that no later step computes them anew.
LOCAL_GROUPS = 50_000


def _ranked(table: DataFrame, score: str) -> DataFrame:
    """Rows that can be ranked: NaN counts as null, nulls are left out."""
    return table.where(F.col(score).isNotNull() & ~F.isnan(F.col(score).cast("double")))


def top_k(table: DataFrame, score: str, k: int, line: str = "line_idx") -> DataFrame:
    """The k rows of the highest scores, ties by the earlier line, in that order; all rows if there are fewer."""
    if k <= 0:
        raise ValueError("k must be positive")
    return _ranked(table, score).orderBy(F.desc(score), F.asc(line)).limit(k)


def top_k_heap(table: DataFrame, score: str, k: int, line: str = "line_idx") -> DataFrame:
    """The k rows that a bounded heap keeps which is fed in line order and replaces its least (score, line) only by higher scores.

    Closed form: with t the k-th highest score and m rows above it, the m rows, and of the rows at t among the first
    k lines with a score of t or more the last k - m.
    """
    if k <= 0:
        raise ValueError("k must be positive")
    rows = _ranked(table, score)
    best = rows.select(score).orderBy(F.desc(score)).limit(k)
    t = best.agg(F.min(score)).first()[0]
    if t is None:
        return rows.limit(0)
    above = best.where(F.col(score) > F.lit(t)).count()
    first = rows.where(F.col(score) >= F.lit(t)).orderBy(line).limit(k)
    ties = first.where(F.col(score) == F.lit(t)).orderBy(F.desc(line)).limit(k - above)
    return rows.where(F.col(score) > F.lit(t)).unionByName(ties).orderBy(F.desc(score), F.asc(line))


def quotas(table: DataFrame, score: str, percent: float, group: str | None = None) -> DataFrame:
    """``group, n, n_keep, threshold``: n_keep = max(1, ceil(n * (percent / 100))) rows of each group, threshold the n_keep-th highest score.

    The product is one of binary doubles (so 7 % of 100 are 8). Without a group its column is the constant "".
    """
    if not 0 < percent <= 100:
        raise ValueError("percent must be above 0 and at most 100")
    g = F.col(group) if group else F.lit("")
    rows = _ranked(table, score).where(g.isNotNull()).select(g.alias("group"), F.col(score).cast("double").alias("score"))
    part = percent / 100.0
    inf = double("inf")

    ends = F.array(double(max(0.0, 1 - part - 4 / ACCURACY)), double(min(1.0, 1 - part + 4 / ACCURACY)))
    state = rows.groupBy("group").agg(F.count(F.lit(1)).alias("n"), F.percentile_approx("score", ends, ACCURACY).alias("p"))
    keep = F.greatest(F.lit(1), F.ceil(F.col("n").cast("double") * double(part)).cast("long"))
    small = F.col("n") <= SMALL_GROUP
    state = _settled(state.select("group", "n", keep.alias("n_keep"), F.when(small, -inf).otherwise(F.col("p")[0]).alias("low"), F.when(small, inf).otherwise(F.col("p")[1]).alias("high")))
    groups, last = state.agg(F.count(F.lit(1)), F.max("n")).first()
    few = lambda x: F.broadcast(x) if groups <= BROADCAST_GROUPS else x
    c = F.col("score")
    # A first bracket holds some 10 of ACCURACY values of a group at most: enough but for very large groups.
    narrow = last is not None and last > SMALL_GROUP * ACCURACY / 10
    while narrow:
        within = (c >= F.col("low")) & (c <= F.col("high"))
        seen = rows.join(few(state), "group").groupBy("group", "n", "n_keep", "low", "high").agg(
            F.count_if(c > F.col("high")).alias("above"), F.count_if(within).alias("m"), F.count_if((c > F.col("low")) & (c < F.col("high"))).alias("between"),
            F.percentile_approx(F.when(within, c), F.array(*(double(i / 100) for i in range(101))), ACCURACY).alias("p"),
        )
        # The wanted rank among those within, as a place among their percentiles; the new ends are one and two beside it.
        at = F.floor((F.col("m") - (F.col("n_keep") - F.col("above"))) / F.col("m") * 100).cast("int")
        again = F.col("between") > SMALL_GROUP
        low = F.when(again & (at > 1), F.get("p", at - 1)).otherwise(F.col("low"))
        high = F.when(again & (at < 98), F.get("p", at + 2)).otherwise(F.col("high"))
        state = _settled(seen.select("group", "n", "n_keep", low.alias("low"), high.alias("high"), F.when(again, F.col("between")).alias("between")))
        most = state.agg(F.max("between")).first()[0]
        state = state.drop("between")
        narrow = most is not None and most < last
        last = most
    # Rows within the bracket are counted by value, those above it in one number.
    inside = F.when(c > F.col("high"), inf).when(c >= F.col("low"), c)
    values = rows.join(few(state), "group").select("group", "n", "n_keep", inside.alias("v")).where("v is not null").groupBy("group", "n", "n_keep", "v").agg(F.count(F.lit(1)).alias("c"))
    down = Window.partitionBy("group").orderBy(F.desc("v"))
    reached = values.withColumn("above", F.sum("c").over(down)).where("above >= n_keep")
    return _settled(reached.groupBy("group", "n", "n_keep").agg(F.max("v").alias("threshold")))


def _settled(groups: DataFrame) -> DataFrame:
    """A table of a row for each group, computed once where it has at most LOCAL_GROUPS rows."""
    rows = groups.limit(LOCAL_GROUPS + 1).collect()
    return groups if len(rows) > LOCAL_GROUPS else groups.sparkSession.createDataFrame(rows, groups.schema)


def first_lines(rows: DataFrame, group: Column, quota: DataFrame, line: str) -> DataFrame:
    """The first n_keep rows of each group by line: whole blocks of lines by their counts, and ranks within the one block that is cut.

    Columns of rows may have any names.
    """
    g, b, c, before, keep, rank = unused(rows, "g", "b", "c", "before", "n_keep", "rank")
    rows = rows.withColumns({g: group, b: F.floor(F.col(line) / BLOCK)})
    blocks = rows.groupBy(g, b).agg(F.count(F.lit(1)).alias(c))
    up = Window.partitionBy(g).orderBy(b)
    first = blocks.withColumn(before, F.sum(c).over(up) - F.col(c)).join(quota.select(F.col("group").alias(g), F.col("n_keep").alias(keep)), g).where(F.col(before) < F.col(keep))
    kept = rows.join(first, [g, b])
    whole = kept.where(F.col(before) + F.col(c) <= F.col(keep))
    cut = kept.where(F.col(before) + F.col(c) > F.col(keep)).withColumn(rank, F.row_number().over(Window.partitionBy(g, b).orderBy(line))).where(F.col(before) + F.col(rank) <= F.col(keep)).drop(rank)
    return whole.unionByName(cut).drop(g, b, c, before, keep)


def top_percent(table: DataFrame, score: str, percent: float, group: str | None = None, line: str = "line_idx", mode: str = "file_order", quota: DataFrame | None = None) -> DataFrame:
    """The best percent of each group (or of all rows): rows at or above the threshold, in line order until the quota is full.

    With ties at the threshold an early tied row can thus displace a better later one; mode="strict" takes
    the highest scores instead, ties by line. Rows without score or group are left out; no rows give none. Columns may
    have any names. quota: the table that ``quotas`` gives for the same arguments, where it is known already.
    """
    if mode not in ("file_order", "strict"):
        raise ValueError("mode must be file_order or strict")
    rows = _ranked(table, score)
    rows = rows.where(F.col(group).isNotNull()) if group else rows
    quota = quotas(table, score, percent, group) if quota is None else quota
    k, q, t = unused(rows, "key", "of_quota", "threshold")
    limits = quota.select(F.col("group").alias(q), F.col("threshold").alias(t))
    if quota.limit(BROADCAST_GROUPS + 1).count() <= BROADCAST_GROUPS:
        limits = F.broadcast(limits)
    marked = rows.withColumn(k, F.col(group) if group else F.lit("")).join(limits, F.col(k) == F.col(q)).drop(q)
    at_least = marked.where(F.col(score) >= F.col(t))
    if mode == "file_order":
        return first_lines(at_least.drop(t), F.col(k), quota, line).drop(k)
    above = at_least.where(F.col(score) > F.col(t))
    taken = above.groupBy(F.col(k).alias("group")).agg(F.count(F.lit(1)).alias("a"))
    rest = quota.join(taken, "group", "left").select("group", (F.col("n_keep") - F.coalesce("a", F.lit(0))).alias("n_keep"))
    ties = first_lines(at_least.where(F.col(score) == F.col(t)), F.col(k), rest, line)
    return above.unionByName(ties).drop(k, t)


def unfilled(chosen: DataFrame, quota: DataFrame, group: str | None = None) -> DataFrame:
    """``group, n_keep, taken`` of the groups of which fewer rows were chosen than their quota."""
    got = chosen.groupBy((F.col(group) if group else F.lit("")).alias("group")).agg(F.count(F.lit(1)).alias("taken"))
    return quota.select("group", "n_keep").join(got, "group", "left").select("group", "n_keep", F.coalesce("taken", F.lit(0)).alias("taken")).where("taken < n_keep")
