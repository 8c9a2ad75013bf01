"""Column expressions that several operators share."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def double(x: float) -> Column:
    return F.lit(float(x))


def is_finite(c: Column) -> Column:
    """Neither null nor NaN nor infinite."""
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) != double("inf"))


def finite(c: Column) -> Column:
    """c where it is finite, else null."""
    return F.when(is_finite(c), c)


def weighted_sum(values: Mapping[str, Column], weights: Mapping[str, float]) -> Column:
    """0 + w1 * v1 + w2 * v2 ..., added from the left in the order of weights, so that sums are the same as in a loop."""
    return reduce(lambda total, key: total + values[key] * double(weights[key]), weights, double(0.0))


def min_max(c: Column, low: Column, high: Column, eps: float = 1e-9) -> Column:
    """c on a scale from low to high; 0.5 where the two are closer than eps."""
    return F.when(high - low < double(eps), double(0.5)).otherwise((c - low) / (high - low))


def numbers_only(field: str | Column) -> Column:
    """The numeric entries of a map of variants as doubles; strings, booleans, nulls and nested values are left out."""
    kind = lambda v: F.schema_of_variant(v)
    kept = F.map_filter(field, lambda k, v: kind(v).rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL)"))
    return F.transform_values(kept, lambda k, v: F.try_variant_get(v, "$", "double"))


def others_only(field: str | Column) -> Column:
    """What ``numbers_only`` leaves out, as JSON text."""
    kept = F.map_filter(field, lambda k, v: ~F.schema_of_variant(v).rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL)"))
    return F.transform_values(kept, lambda k, v: F.to_json(v))


def all_of(keys: Sequence[str], f) -> list[Column]:
    return [f(key).alias(key) for key in keys]


def unused(table: DataFrame, *names: str) -> list[str]:
    """The names, with underscores before them as far as the table has columns of those names."""
    taken, out = {c.lower() for c in table.columns}, []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out
