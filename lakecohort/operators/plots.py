"""Frames behind plots: densities on a grid for violins, jittered points, rates of interaction pairs. Drawing is left to others.

A density is an aggregation: different values are counted first, and each count adds its kernel to every place of a grid of
fixed size. Jitter follows from a row's key, so a point lies in the same place whenever and wherever it is worked out.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import stats

POINTS, JITTER = 64, 0.06
#: Hexadecimal digits of a digest that make one uniform number.
DIGITS = 13


def density(df: DataFrame, value: str, by: Sequence[str] = (), points: int = POINTS) -> DataFrame:
    """by, point (from 0), x and density: a Gaussian kernel of Scott's width (n^-0.2 times the standard deviation) from the least to the largest value of each group.

    Groups with one different value have no density. Rows without a value or a group are left out.
    """
    keys = [f"__g{i}" for i in range(len(by))]
    rows = df.select(*[F.col(f"`{c}`").alias(k) for c, k in zip(by, keys)], F.col(f"`{value}`").cast("double").alias("v")).dropna()
    spread = rows.groupBy(*keys).agg(F.count("v").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"), F.stddev_samp("v").alias("sd")).filter("sd > 0")
    width = spread.withColumn("h", F.col("sd") * F.pow(F.col("n"), F.lit(-0.2)))
    counts = rows.groupBy(*keys, "v").agg(F.count("*").alias("m"))
    placed = (counts.join(width, keys) if keys else counts.crossJoin(F.broadcast(width))).withColumn("point", F.explode(F.sequence(F.lit(0), F.lit(points - 1))))
    x = F.col("lo") + (F.col("hi") - F.col("lo")) * F.col("point") / (points - 1)
    kernel = F.col("m") * F.exp(-0.5 * F.pow((x - F.col("v")) / F.col("h"), F.lit(2)))
    out = placed.groupBy(*keys, "point").agg(F.first(x).alias("x"), (F.sum(kernel) / F.first(F.col("n") * F.col("h") * math.sqrt(2 * math.pi))).alias("density"))
    return out.select(*[F.col(k).alias(c) for c, k in zip(by, keys)], "point", "x", "density")


def normal(key: Column, salt: str) -> Column:
    """A standard normal number of each key: two uniform ones from its digest (Box and Muller's transform)."""
    digest = F.md5(F.concat(F.lit(f"{salt}:"), key.cast("string")))
    uniform = lambda at: (F.conv(F.substring(digest, at, DIGITS), 16, 10).cast("double") + 0.5) / 16.0**DIGITS
    return F.sqrt(-2 * F.log(uniform(1))) * F.cos(2 * math.pi * uniform(1 + DIGITS))


def points(df: DataFrame, outcome: str, predictor: str, key: str, moderator: str | None = None, width: float = JITTER) -> DataFrame:
    """key, x, y (the outcome, moved a little), outcome and, with one, moderator of rows that have them."""
    more = [F.col(moderator).alias("moderator")] if moderator else []
    y = F.col(outcome) + width * normal(F.col(key), f"{outcome}|{predictor}")
    return df.select(F.col(key).alias("key"), F.col(predictor).alias("x"), y.alias("y"), F.col(outcome).alias("outcome"), *more).dropna()


def rates(df: DataFrame, outcome: str, factor: str, moderator: str, least: int = 5) -> DataFrame:
    """factor, moderator, n, rate, low and high (95 %, Wilson) of a 0/1 outcome for each pair of values; pairs of fewer than ``least`` rows are left out."""
    rows = df.select(F.col(factor).alias("factor"), F.col(moderator).alias("moderator"), F.col(outcome).cast("double").alias("y")).dropna()
    n, p, z = F.col("n"), F.col("rate"), stats.Z
    middle, half = (p + z * z / (2 * n)) / (1 + z * z / n), z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / (1 + z * z / n)
    found = rows.groupBy("factor", "moderator").agg(F.count("*").alias("n"), F.avg("y").alias("rate")).filter(n >= least)
    return found.withColumns({"low": F.greatest(middle - half, F.lit(0.0)), "high": F.least(middle + half, F.lit(1.0))})


def frames(df: DataFrame, outcome: str, predictor: str, key: str, moderator: str | None = None, wanted: str | None = None) -> tuple[str | None, str, dict[str, DataFrame]]:
    """(kind, note, frames) of the plot that fits a predictor's scale: a violin's densities and points, or a scatter's points; with a moderator the rates of its pairs too."""
    kind, note = stats.plot_kind(predictor, wanted)
    if kind is None:
        return None, note, {}
    out = {"points": points(df, outcome, predictor, key, moderator)}
    if kind == "violin":
        out["density"] = density(df, outcome, [predictor, *([moderator] if moderator else [])])
        if moderator:
            out["rates"] = rates(df, outcome, predictor, moderator)
    return kind, note, out


def outline(found: DataFrame, by: Sequence[str]) -> DataFrame:
    """A density mirrored to a violin's outline, its widest place 0.5: by, point, x, left and right."""
    widest = found.groupBy(*by).agg(F.max("density").alias("__most")) if by else found.agg(F.max("density").alias("__most"))
    met = found.alias("a").join(widest.alias("b"), reduce(Column.__and__, [F.col(f"a.{c}") == F.col(f"b.{c}") for c in by], F.lit(True)))
    half = 0.5 * F.col("density") / F.col("__most")
    return met.select(*[F.col(f"a.{c}") for c in by], "point", "x", (-half).alias("left"), half.alias("right"))
