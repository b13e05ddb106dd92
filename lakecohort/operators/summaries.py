"""Aggregates of the cohort and catalogue queries."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import privacy, quantiles

#: Columns of so many distinct values at most are described by counts.
CATEGORIES = 5


def worst(df: DataFrame, subject: str, label: str, positive: Sequence[str]) -> DataFrame:
    """subject and outcome: 1 if any of its labels is positive."""
    return df.groupBy(subject).agg(F.coalesce(F.max(F.col(label).isin(*positive).cast("int")), F.lit(0)).alias("outcome"))


def first_value(df: DataFrame, subject: str, value: Column, order: str, name: str) -> DataFrame:
    """Per subject the first value in file order that isn't null."""
    return df.withColumn("__v", value).filter("__v is not null").groupBy(subject).agg(F.min_by("__v", order).alias(name))


def numeric_summary(df: DataFrame, column: str, *by: str) -> DataFrame:
    """mean, std, median, min, max, n_valid and n_missing, of each group or of all rows; the median is selected, so groups may be of any size."""
    c = F.col(f"`{column}`")
    names = [f"__{i}" for i in range(len(by))]
    plain = df.groupBy(*[F.col(f"`{b}`").alias(n) for b, n in zip(by, names)]).agg(
        F.avg(c).alias("mean"), F.stddev_samp(c).alias("std"), F.min(c).alias("min"), F.max(c).alias("max"), F.count(c).alias("n_valid"), F.coalesce(F.sum(c.isNull().cast("long")), F.lit(0)).alias("n_missing"),
    )
    middle = quantiles.medians(df, column, by)
    if by:
        middle = middle.select(*[F.col(f"`{b}`").alias(f"{n}m") for b, n in zip(by, names)], "median")
        out = plain.join(middle, reduce(Column.__and__, [F.col(n).eqNullSafe(F.col(f"{n}m")) for n in names]), "left")
    else:
        out = plain.join(middle, F.lit(True), "left")  # a row each
    return out.select(*[F.col(n).alias(b) for n, b in zip(names, by)], "mean", "std", "median", "min", "max", "n_valid", "n_missing")


def value_counts(df: DataFrame, column: str) -> DataFrame:
    return df.filter(F.col(column).isNotNull()).groupBy(F.col(column).cast("string").alias("value")).agg(F.count("*").alias("n"))


def describe(df: DataFrame, column: str) -> tuple[str, DataFrame]:
    """("counts" or "summary", table) by the number of distinct values."""
    few = df.select(F.count_distinct(column)).first()[0] <= CATEGORIES
    return ("counts", value_counts(df, column)) if few else ("summary", numeric_summary(df, column))


def missing(df: DataFrame, columns: Sequence[str], least: float = 0.0) -> DataFrame:
    """column, n_missing and share of columns of which more than a share is missing; one pass over the table."""
    counted = df.agg(F.count("*").alias("__n"), *[F.sum(F.col(f"`{c}`").isNull().cast("long")).alias(f"__{i}") for i, c in enumerate(columns)])
    rows = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.coalesce(F.col(f"__{i}"), F.lit(0)).alias("n_missing")) for i, c in enumerate(columns)]))
    out = counted.select("__n", rows.alias("x")).select("x.*", F.round(F.when(F.col("__n") > 0, F.col("x.n_missing") / F.col("__n")).otherwise(0.0), 6).alias("share"))
    return out.filter(F.col("share") > least) if least else out


def events(df: DataFrame, outcome: str) -> DataFrame:
    """n, events and rate; the rate of no rows is null."""
    return df.agg(F.count("*").alias("n"), F.coalesce(F.sum(outcome), F.lit(0)).cast("long").alias("events"), F.round(F.try_divide(F.sum(outcome), F.count("*")), 6).alias("rate"))


def filled(c: Column) -> Column:
    """A value other than null, the empty text and nan."""
    return F.coalesce(~F.lower(F.trim(c.cast("string"))).isin("", "nan"), F.lit(False))


def completeness(df: DataFrame, columns: Sequence[str], k: int = privacy.SMALL) -> DataFrame:
    """Rows in which any of the columns is filled, masked where few: records, populated and percent as texts."""
    any_filled = reduce(Column.__or__, [filled(F.col(f"`{c}`")) for c in columns]) if columns else F.lit(False)
    n, m = F.count("*"), F.coalesce(F.sum(any_filled.cast("long")), F.lit(0))
    row = df.agg(n.alias("n"), m.alias("m"))
    percent = F.when(F.col("m") < k, f"<{k}").otherwise(F.format_string("%.1f", F.round(100 * F.col("m") / F.col("n"), 1)))
    return row.select(privacy.mask_small(F.col("n"), k).alias("records"), privacy.mask_small(F.col("m"), k).alias("populated"), percent.alias("percent"))


def dataset_statistics(frames: dict[str, DataFrame], hidden: Sequence[str]) -> DataFrame:
    """dataset, records, columns and names of each table; counts come from the tables' metadata where the source has it."""
    parts = []
    for name, df in sorted(frames.items()):
        names = sorted(c for c in df.columns if c not in hidden)
        parts.append(df.agg(F.count("*").alias("records")).select(F.lit(name).alias("dataset"), "records", F.lit(len(names)).alias("columns"), F.lit(", ".join(names)).alias("names")))
    return reduce(DataFrame.unionByName, parts)


def overview(variables: DataFrame, statistics: DataFrame) -> DataFrame:
    """One row: variables, phi_variables, forms, datasets and records."""
    v = variables.agg(F.count("*").alias("variables"), F.coalesce(F.sum(F.col("is_phi").cast("int")), F.lit(0)).cast("long").alias("phi_variables"), F.count_distinct("form_name").alias("forms"))
    return v.crossJoin(F.broadcast(statistics.agg(F.count("*").alias("datasets"), F.coalesce(F.sum("records"), F.lit(0)).alias("records"))))


def form_counts(variables: DataFrame) -> DataFrame:
    return variables.groupBy(F.coalesce("form_name", F.lit("Unknown")).alias("form_name")).agg(F.count("*").alias("n_variables")).orderBy("form_name")


def longest_description(df: DataFrame, key: str, description: str, ordinal: str) -> DataFrame:
    """Per key the row with the longest description; the first of equal ones."""
    row = F.struct(*[F.col(f"`{c}`") for c in df.columns])
    return df.groupBy(F.col(key).alias("__k")).agg(F.max_by(row, F.struct(F.length(F.coalesce(description, F.lit(""))), -F.col(ordinal))).alias("x")).select("x.*")


def distinct_labels(df: DataFrame, labels: str) -> DataFrame:
    """Sorted labels that occur in any row, combined before the shuffle."""
    return df.select(F.explode(labels).alias("label")).groupBy("label").agg(F.count("*").alias("n"))


def codelists(df: DataFrame, name: str, code: str, descriptor: str, ordinal: str) -> DataFrame:
    """name and its map from code to descriptor; of repeated codes the last counts."""
    last = df.groupBy(name, code).agg(F.max_by(descriptor, ordinal).alias("d"))
    return last.groupBy(name).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(code, "d")))).alias("codes"))
