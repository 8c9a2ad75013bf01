"""Winsorizing and scaling of scores."""

from __future__ import annotations

import math
from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expressions import double, finite, is_finite
from ..sources.pool import number_text


#: Different values between two bracket ends that one task may sort, and the accuracy of the percentiles that set the ends.
MOST_VALUES = 100_000
#: Rows up to which all columns' exact percentiles are one aggregation, which keeps each different value of a column.
ONE_PASS = 1_000_000
ACCURACY = 10_000


def _bracketed(table: DataFrame, ranks: dict[str, list[int]], sizes: dict[str, int]) -> dict[str, dict[int, float]]:
    """The value of each rank (from 0) among the finite values of columns, of which there are `sizes`.

    Each rank is bracketed by approximate percentiles of what lies in its last bracket until few values are left there;
    rows below and within all brackets are counted in one pass, and the values within the last ones by value.
    """
    jobs = [(key, r) for key, rs in ranks.items() for r in rs]
    ends = {job: (-math.inf, math.inf) for job in jobs}
    below, inside = dict.fromkeys(jobs, 0), {(key, r): sizes[key] for key, r in jobs}
    wide = [job for job in jobs if inside[job] > MOST_VALUES]
    while wide:
        aggs = []
        for key, r in wide:
            c, (a, b) = finite(F.col(key).cast("double")), ends[key, r]
            share, near = (r - below[key, r]) / max(1, inside[key, r] - 1), 4 / ACCURACY
            at = F.array(double(max(0.0, share - near)), double(min(1.0, share + near)))
            aggs.append(F.percentile_approx(F.when((c >= double(a)) & (c <= double(b)), c), at, ACCURACY))
        closer = dict(zip(wide, table.agg(*(x.alias(f"p{i}") for i, x in enumerate(aggs))).first(), strict=True))
        aggs = []
        for key, r in wide:
            c, (a, b) = finite(F.col(key).cast("double")), closer[key, r]
            aggs += [F.count_if(c < double(a)), F.count_if((c > double(a)) & (c < double(b))), F.count_if((c >= double(a)) & (c <= double(b)))]
        got = table.agg(*(x.alias(f"c{i}") for i, x in enumerate(aggs))).first()
        again = []
        for i, job in enumerate(wide):
            n, between, m = got[3 * i : 3 * i + 3]
            if n <= job[1] < n + m and tuple(closer[job]) != ends[job]:  # else the last bracket has to do
                ends[job], below[job], inside[job] = tuple(closer[job]), n, m
                if between > MOST_VALUES:
                    again.append(job)
        wide = again
    pieces = sorted({(key, *ends[key, r]) for key, r in jobs}, key=str)
    rows = [F.when((c >= double(a)) & (c <= double(b)), F.struct(F.lit(i).alias("piece"), c.alias("v"))) for i, (key, a, b) in enumerate(pieces) for c in [finite(F.col(key).cast("double"))]]
    values = table.select(F.inline(F.filter(F.array(*rows), lambda x: x.isNotNull()))).groupBy("piece", "v").agg(F.count(F.lit(1)).alias("n"))
    upto = F.sum("n").over(Window.partitionBy("piece").orderBy("v"))
    wanted = F.create_map(*(x for i, piece in enumerate(pieces) for x in (F.lit(i), F.array(*(F.lit(r - below[key, r]).cast("long") for key, r in jobs if (key, *ends[key, r]) == piece)))))
    hit = values.withColumn("upto", upto).where(F.exists(wanted[F.col("piece")], lambda r: (r < F.col("upto")) & (r >= F.col("upto") - F.col("n"))))
    found = [(r["piece"], r["upto"] - r["n"], r["upto"], r["v"]) for r in hit.collect()]  # a row for each rank at most
    out: dict[str, dict[int, float]] = {key: {} for key in ranks}
    for key, r in jobs:
        i, at = pieces.index((key, *ends[key, r])), r - below[key, r]
        out[key][r] = next(v for piece, a, b, v in found if piece == i and a <= at < b)
    return out


def bounds(table: DataFrame, keys: Sequence[str], low: float, high: float, accuracy: int | None = None) -> DataFrame:
    """``key, lb, ub, n``: percentiles of the finite values of each column.

    Exact with linear interpolation between the two nearest ranks, by a few passes over the columns in which no task
    holds more than MOST_VALUES values of a column. With an accuracy they come from one pass of approximate percentiles
    (a rank is then off by at most 1 / accuracy of the rows). Columns without a finite value are left out.
    """
    if not 0 <= low < high <= 100:
        raise ValueError("percentiles must satisfy 0 <= low < high <= 100")
    if not keys:
        return table.sparkSession.createDataFrame([], "key string, lb double, ub double, n long")
    if accuracy:
        at = F.array(double(low / 100.0), double(high / 100.0))
        aggs = []
        for key in keys:
            c = finite(F.col(key).cast("double"))
            p = F.percentile_approx(c, at, accuracy)
            aggs.append(F.struct(F.lit(key).alias("key"), F.get(p, F.lit(0)).alias("lb"), F.get(p, F.lit(1)).alias("ub"), F.count(c).alias("n")))
        return table.agg(F.array(*aggs).alias("_")).select(F.inline("_")).where("n > 0")
    if table.limit(ONE_PASS + 1).count() <= ONE_PASS:
        at = F.array(double(low / 100.0), double(high / 100.0))
        cs = [(key, finite(F.col(key).cast("double"))) for key in keys]
        aggs = [F.struct(F.lit(key).alias("key"), F.get(F.percentile(c, at), F.lit(0)).alias("lb"), F.get(F.percentile(c, at), F.lit(1)).alias("ub"), F.count(c).alias("n")) for key, c in cs]
        return table.agg(F.array(*aggs).alias("_")).select(F.inline("_")).where("n > 0")
    sizes = table.agg(*(F.count(finite(F.col(key).cast("double"))).alias(f"n{i}") for i, key in enumerate(keys))).first()
    sizes = {key: n for key, n in zip(keys, sizes, strict=True) if n}
    places = {key: [p / 100.0 * (n - 1) for p in (low, high)] for key, n in sizes.items()}
    values = _bracketed(table, {key: sorted({r for x in own for r in (math.floor(x), math.ceil(x))}) for key, own in places.items()}, sizes) if places else {}

    def at(key: str, x: float) -> float:
        a, b = math.floor(x), math.ceil(x)
        lower, upper = values[key][a], values[key][b]
        return lower if lower == upper else (b - x) * lower + (x - a) * upper

    rows = [(key, *(at(key, x) for x in places[key]), n) for key, n in sizes.items()]
    return table.sparkSession.createDataFrame(rows, "key string, lb double, ub double, n long")


def bounds_dict(table: DataFrame) -> dict[str, tuple[float, float]]:
    """Bounds on the driver: two numbers for each key."""
    return {r["key"]: (r["lb"], r["ub"]) for r in table.collect()}


def scaled(c: Column, lb: float, ub: float, flip: bool = False) -> Column:
    """Clip to the bounds and scale to [0, 1]; 0 where they coincide; flip takes it from 1. Values that are not finite stay."""
    if lb == ub:
        unit = double(0.0)
    else:
        unit = (F.least(F.greatest(c, double(lb)), double(ub)) - double(lb)) / double(ub - lb)
    return F.when(is_finite(c), double(1.0) - unit if flip else unit).otherwise(c)


def normalized(table: DataFrame, limits: dict[str, tuple[float, float]], flip: Iterable[str] = (), keep_original: bool = False) -> DataFrame:
    """Columns with limits are scaled; keep_original adds the old values as ``<key>_orig``."""
    flip = set(flip)
    new = {}
    for key, (lb, ub) in limits.items():
        c = F.col(key).cast("double")
        if keep_original:
            new[f"{key}_orig"] = c
        new[key] = scaled(c, lb, ub, key in flip)
    return table.withColumns(new)


def normalized_map(pool: DataFrame, limits: dict[str, tuple[float, float]], flip: Iterable[str] = (), keep_original: bool = False, scores: str = "scores") -> DataFrame:
    """As ``normalized`` for a map of scores; keys without limits stay as they are."""
    flip = set(flip)

    def value(k, v):
        out = v
        for key, (lb, ub) in limits.items():
            out = F.when(k == key, scaled(v, lb, ub, key in flip)).otherwise(out)
        return out

    new = F.transform_values(scores, value)
    if keep_original:
        old = F.map_filter(scores, lambda k, v: k.isin(*limits)) if limits else F.create_map().cast("map<string,double>")
        old = F.transform_keys(old, lambda k, v: F.concat(k, F.lit("_orig")))
        # A key that exists under the new name gives way.
        new = F.map_concat(F.map_filter(new, lambda k, v: ~F.map_contains_key(old, k)), old)
    return pool.withColumn(scores, new)


def normalized_entries(entries: Column, numbers: Column, limits: dict[str, tuple[float, float]], flip: Iterable[str] = (), keep_original: bool = False) -> Column:
    """As ``normalized_map`` for (key, JSON text) entries of a record (see ``sources.pool.records``) and their numbers.

    Entries without limits, and values that are not finite numbers, keep their text; the text of an old value is kept as is.
    """
    if not limits:
        return entries
    flip = set(flip)
    known = F.create_map(*(x for k, (lb, ub) in limits.items() for x in (F.lit(k), F.struct(double(lb).alias("lb"), double(ub).alias("ub"), F.lit(k in flip).alias("flip")))))

    def one(e):
        own, v = known[e["key"]], numbers[e["key"]]
        unit = F.when(own["lb"] == own["ub"], double(0.0)).otherwise((F.least(F.greatest(v, own["lb"]), own["ub"]) - own["lb"]) / (own["ub"] - own["lb"]))
        new = F.struct(e["key"].alias("key"), number_text(F.when(own["flip"], double(1.0) - unit).otherwise(unit)).alias("text"))
        old = F.struct(F.concat(e["key"], F.lit("_orig")).alias("key"), e["text"].alias("text"))
        return F.when(own.isNotNull() & is_finite(v), F.array(old, new) if keep_original else F.array(new)).otherwise(F.array(e))

    if keep_original:  # an entry that exists under the new name gives way
        entries = F.filter(entries, lambda e: ~(e["key"].isin(*(f"{k}_orig" for k in limits)) & F.map_contains_key(numbers, F.regexp_replace(e["key"], "_orig$", ""))))
    return F.flatten(F.transform(entries, one))


def clip_stats(table: DataFrame, limits: dict[str, tuple[float, float]], flip: Iterable[str] = ()) -> DataFrame:
    """``key, lb, ub, clipped, total, rate, flip``: how many finite values lie beyond the bounds."""
    flip = set(flip)
    rows = []
    for key, (lb, ub) in limits.items():
        c = finite(F.col(key).cast("double"))
        clipped, total = F.count_if((c < double(lb)) | (c > double(ub))), F.count(c)
        rows.append(F.struct(F.lit(key).alias("key"), double(lb).alias("lb"), double(ub).alias("ub"), clipped.alias("clipped"), total.alias("total"), F.coalesce(F.try_divide(clipped.cast("double"), total.cast("double")), double(0.0)).alias("rate"), F.lit(key in flip).alias("flip")))
    return table.agg(F.array(*rows).alias("_")).select(F.inline("_"))
