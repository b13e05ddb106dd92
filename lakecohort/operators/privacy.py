"""k-anonymity, l-diversity and small cells as aggregates.

Class sizes come from one aggregation on the quasi-identifiers with partial sums before the shuffle; nulls are values.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SMALL = 5


def _need(k: int, columns: list[str], what: str) -> None:
    if k < 1:
        raise ValueError(f"{what} is 1 at least")
    if not columns:
        raise ValueError("quasi-identifiers are missing")


def class_key(columns: list[str]) -> Column:
    """The values of a class joined by a pipe; a null is empty."""
    return F.concat_ws("|", *[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in columns])


def class_sizes(df: DataFrame, columns: list[str]) -> DataFrame:
    _need(1, columns, "k")
    return df.groupBy(*[F.col(f"`{c}`") for c in columns]).agg(F.count("*").alias("n"))


def k_violations(df: DataFrame, columns: list[str], k: int = SMALL) -> DataFrame:
    """class and n of each class of fewer than k rows."""
    _need(k, columns, "k")
    return class_sizes(df, columns).filter(F.col("n") < k).select(class_key(columns).alias("class"), "n")


def l_diversity(df: DataFrame, columns: list[str], sensitive: list[str], least: int = 2) -> DataFrame:
    """class, attribute and values of each class and sensitive attribute with fewer than l distinct values; a null is a value."""
    _need(least, columns, "l")
    if not sensitive:
        raise ValueError("sensitive attributes are missing")
    counts = [(F.count_distinct(F.col(f"`{s}`")) + F.max(F.col(f"`{s}`").isNull().cast("int"))).alias(f"__{i}") for i, s in enumerate(sensitive)]
    found = df.groupBy(*[F.col(f"`{c}`") for c in columns]).agg(*counts)
    rows = F.explode(F.array(*[F.struct(F.lit(s).alias("attribute"), F.col(f"__{i}").alias("values")) for i, s in enumerate(sensitive)]))
    return found.select(class_key(columns).alias("class"), rows.alias("x")).select("class", "x.attribute", "x.values").filter(F.col("values") < least)


def mask_small(n: Column, k: int = SMALL) -> Column:
    """A count as text, or <k."""
    return F.when(n >= k, n.cast("string")).otherwise(F.lit(f"<{k}"))


@dataclass(frozen=True)
class Verdict:
    blocked: bool
    reason: str = ""


def row_gate(df: DataFrame, columns: list[str], k: int = SMALL, sensitive: list[str] | None = None, least: int = 2) -> Verdict:
    """Are rows safe to show? The reason doesn't give class sizes. An empty table isn't blocked."""
    if not k_violations(df, columns, k).isEmpty():
        return Verdict(True, f"a class of {', '.join(columns)} has fewer than {k} rows")
    if sensitive and not l_diversity(df, columns, sensitive, least).isEmpty():
        return Verdict(True, f"a class of {', '.join(columns)} has fewer than {least} values of a sensitive attribute")
    return Verdict(False)


def gated(df: DataFrame, columns: list[str], k: int = SMALL, sensitive: list[str] | None = None, least: int = 2) -> DataFrame:
    """The rows, or none where the gate blocks; decided within the query, by one row that is broadcast."""
    verdict = class_sizes(df, columns).agg(F.coalesce(F.min("n") >= k, F.lit(True)).alias("__safe"))
    out = df.crossJoin(F.broadcast(verdict))
    if sensitive:
        diverse = l_diversity(df, columns, sensitive, least).agg((F.count("*") == 0).alias("__diverse"))
        out = out.crossJoin(F.broadcast(diverse)).filter("__diverse").drop("__diverse")
    return out.filter("__safe").drop("__safe")
