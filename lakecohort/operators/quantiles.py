"""Exact medians of groups of any size, by selection: no group's values stand in one buffer or go through one sort.

A first pass takes a sketch of each group's quantiles; the sketch's error is bounded, so the values at the middle ranks lie
between two of its quantiles that are a few thousandths of the group apart. A second pass counts what lies below and takes
a sketch of what lies between. A third counts the values between the bounds that remain (some hundred-thousandths of the
group) and finds the value at each middle rank from running sums. Everything is one lazy plan of partial aggregates. Rows
of large groups meet their bounds where they are, so no task gets a group's rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Quantiles of a sketch, and its accuracy: ranks are off by one in so many at most.
STEPS, ACCURACY = 1000, 10_000
#: Bounds of groups of more values are broadcast: a row for so many rows of the table at most.
LARGE = 1 << 18


def _sketch(v: Column) -> Column:
    return F.percentile_approx(v, [i / STEPS for i in range(STEPS + 1)], ACCURACY)


def _bounds(known: DataFrame, keys: list[str]) -> DataFrame:
    """keys, r0 and r1 (middle ranks in the whole group), large, lo and hi between which their values lie. known: has n, q, min, max, below (values before those of the sketch), r0, r1 and large."""
    place = lambda r: (F.col(r) - F.col("below")) / F.col("n") * STEPS
    first, last = F.floor(place("r0")).cast("int") - 2, F.ceil(place("r1") + STEPS / F.col("n")).cast("int") + 2
    lo = F.when(first <= 0, F.col("min")).otherwise(F.get("q", F.greatest(first, F.lit(0))))
    hi = F.when(last >= STEPS, F.col("max")).otherwise(F.get("q", F.least(last, F.lit(STEPS))))
    return known.filter("n > 0").select(*keys, "r0", "r1", "large", lo.alias("lo"), hi.alias("hi"))


def medians(df: DataFrame, column: str, by: Sequence[str] = (), name: str = "median") -> DataFrame:
    """by and the median (of an even number of values the mean of the middle two); nulls don't count, groups without a value are left out."""
    keys = [f"__g{i}" for i in range(len(by))] or ["__g0"]
    given = [F.col(f"`{c}`").alias(k) for c, k in zip(by, keys)] or [F.lit(0).alias("__g0")]
    values = df.select(*given, F.col(f"`{column}`").cast("double").alias("v")).filter("v is not null")
    measures = lambda v: (F.count(v).alias("n"), _sketch(v).alias("q"), F.min(v).alias("min"), F.max(v).alias("max"))
    whole = values.groupBy(*keys).agg(*measures(F.col("v")))
    ranks = whole.withColumns({"below": F.lit(0).cast("long"), "r0": F.expr("(n - 1) div 2"), "r1": F.expr("n div 2"), "large": F.col("n") > LARGE})
    first = _met(values, _bounds(ranks, keys), keys)
    inside = F.when((F.col("v") >= F.col("lo")) & (F.col("v") <= F.col("hi")), F.col("v"))
    again = first.groupBy(*keys).agg(*measures(inside), F.count_if(F.col("v") < F.col("lo")).alias("below"), *[F.max(c).alias(c) for c in ("r0", "r1", "large")])
    second = _met(values, _bounds(again, keys), keys).filter("v <= hi")
    # what lies below the bounds is one row, before the others
    counts = second.groupBy(*keys, "r0", "r1", F.when(F.col("v") >= F.col("lo"), F.col("v")).alias("v")).agg(F.count("*").alias("n"))
    upto = F.sum("n").over(Window.partitionBy(*keys).orderBy(F.asc_nulls_first("v")).rowsBetween(Window.unboundedPreceding, 0))
    at = lambda r: F.max(F.when((F.col(r) < F.col("upto")) & (F.col(r) >= F.col("upto") - F.col("n")), F.col("v")))
    found = counts.withColumn("upto", upto).groupBy(*keys).agg((0.5 * at("r0") + 0.5 * at("r1")).alias(name))
    return found.withColumnsRenamed(dict(zip(keys, by))) if by else found.drop("__g0")


def _met(values: DataFrame, bounds: DataFrame, keys: list[str]) -> DataFrame:
    """values with the bounds of their group; a null key is a key. Rows of large groups stay where they are, the others go through a join."""
    named = bounds.withColumnsRenamed({k: f"{k}_" for k in keys})
    same = reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"{k}_")) for k in keys])
    large = F.broadcast(named.filter("large"))
    rest = values.join(large, same, "left_anti").join(named.filter("not large"), same)
    return values.join(large, same).unionByName(rest).drop(*[f"{k}_" for k in keys])
