"""Duplicate columns, datasets, variables, and what follows from dropping them."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Fixed value: a name, perhaps an underscore, and a number.
SUFFIXED = re.compile(r"^(.+?)_?(\d+)$")
PROVENANCE = ("source_file", "_provenance", "_metadata")


@dataclass(frozen=True)
class ColumnEvent:
    dropped: str
    kept: str | None
    reason: str


def suffix_candidates(columns: list[str]) -> list[tuple[str, str]]:
    """(column, base) of columns that are named like a copy of another."""
    return [(c, m[1]) for c in columns if (m := SUFFIXED.match(c)) and m[1] in columns]


def duplicate_columns(df: DataFrame) -> list[ColumnEvent]:
    """Copies that are null throughout or equal to their base, nulls included; one pass over the table for all of them."""
    kinds, pairs = dict(df.dtypes), suffix_candidates(df.columns)
    if not pairs:
        return []
    checks = []
    for i, (c, base) in enumerate(pairs):
        x, y = F.col(f"`{c}`"), F.col(f"`{base}`")
        checks.append(F.coalesce(F.bool_and(x.isNull()), F.lit(True)).alias(f"null_{i}"))
        same = F.bool_and(x.eqNullSafe(y)) if kinds[c] == kinds[base] else F.lit(False)
        checks.append(F.coalesce(same, F.lit(True)).alias(f"same_{i}"))
    row = df.agg(*checks).first()
    out = []
    for i, (c, base) in enumerate(pairs):
        if row[f"null_{i}"]:
            out.append(ColumnEvent(c, None, "entirely null"))
        elif row[f"same_{i}"]:
            out.append(ColumnEvent(c, base, "identical"))
    return out


def drop_duplicate_columns(df: DataFrame) -> tuple[DataFrame, list[ColumnEvent]]:
    events = duplicate_columns(df)
    return df.drop(*[e.dropped for e in events]), events


def same_schema(a: DataFrame, b: DataFrame) -> bool:
    return set(a.columns) == set(b.columns)


def _content(df: DataFrame) -> DataFrame:
    """Without provenance, which differs between equal rows; untyped nulls as text, so that they compare."""
    return df.select(*[F.col(f"`{c}`").cast("string").alias(c) if t == "void" else F.col(f"`{c}`") for c, t in sorted(df.dtypes) if c not in PROVENANCE])


def is_subset(small: DataFrame, large: DataFrame) -> bool:
    """Is every row of small, by the columns that both have, in large? Nulls equal nulls."""
    shared = [c for c in _content(small).columns if c in large.columns]
    return bool(shared) and _content(small).select(*shared).subtract(_content(large).select(*shared)).isEmpty()


def union_distinct(a: DataFrame, b: DataFrame) -> DataFrame:
    """All different rows of both, by their content."""
    return _content(a).unionByName(_content(b)).distinct()


def exact_copies(df: DataFrame, text: str, ordinal: str) -> DataFrame:
    """h (a digest), n and first (the smallest ordinal) of each text that occurs more than once; combined before the shuffle."""
    return df.groupBy(F.md5(F.col(text).cast("binary")).alias("h")).agg(F.count("*").alias("n"), F.min(ordinal).alias("first")).filter("n > 1")


def resolve_duplicate(name_a: str, a: DataFrame, name_b: str, b: DataFrame) -> tuple[dict[str, DataFrame], dict]:
    """(datasets that stay, event) of two datasets that hold the same form: the larger stays (a tie: the first)."""
    if not same_schema(a, b):
        return {name_a: a, name_b: b}, {"kept": name_a, "dropped": None, "reason": "schema mismatch"}
    n_a, n_b = a.count(), b.count()
    (keep, large), (lose, small) = ((name_a, a), (name_b, b)) if n_a >= n_b else ((name_b, b), (name_a, a))
    if is_subset(small, large):
        return {keep: large}, {"kept": keep, "dropped": lose, "reason": "subset"}
    return {keep: union_distinct(large, small)}, {"kept": keep, "dropped": lose, "reason": "merged"}


def without_junk(names: list[str], junk: tuple[str, ...]) -> list[str]:
    return [n for n in names if n not in junk]


def richness(description: Column, populated: Column) -> Column:
    """What decides between definitions: populated fields, then length of the description, then its text."""
    text = F.coalesce(description, F.lit(""))
    return F.struct(populated.alias("populated"), F.length(text).alias("length"), text.alias("text"))


def richest(df: DataFrame, keys: list[Column | str], score: Column, ordinal: str) -> DataFrame:
    """The row with the highest score of each key; of equal ones the first. One aggregation, no sort of groups."""
    everything = F.struct(*[F.col(f"`{c}`") for c in df.columns])
    names = [F.col(k).alias(f"__{i}") if isinstance(k, str) else k.alias(f"__{i}") for i, k in enumerate(keys)]
    return df.groupBy(*names).agg(F.max_by(everything, F.struct(score.alias("s"), (-F.col(ordinal)).alias("o"))).alias("x")).select("x.*")


def within_form_duplicates(variables: DataFrame) -> DataFrame:
    """Of variables (form, name, description, populated, ordinal) whose names differ in case only, the richest of each form."""
    return richest(variables, ["form", F.lower("name")], richness(F.col("description"), F.col("populated")), "ordinal")


def cross_form_duplicates(variables: DataFrame) -> DataFrame:
    """Of variables with one name in several forms, the richest; kept says which stay."""
    order = Window.partitionBy("name").orderBy(F.desc("__score"), "ordinal")
    scored = variables.withColumn("__score", richness(F.col("description"), F.col("populated")))
    return scored.withColumn("kept", F.row_number().over(order) == 1).drop("__score")


def surviving_names(frames: dict[str, DataFrame]) -> set[str]:
    return {c.casefold() for df in frames.values() for c in df.columns if c not in PROVENANCE}


def dropped_names(events: list[ColumnEvent], frames: dict[str, DataFrame]) -> set[str]:
    """Names that no dataset has any more."""
    return {e.dropped.casefold() for e in events} - surviving_names(frames)


def prune_rows(df: DataFrame, key: str, dropped: DataFrame) -> DataFrame:
    """Rows whose key isn't among the names of dropped (a column name), without regard to case; rows without a key stay."""
    names = dropped.select(F.lower("name").alias("__name")).distinct()
    return df.join(names, F.lower(F.col(key)) == F.col("__name"), "left_anti")


def prune_lists(df: DataFrame, column: str, dropped: list[str]) -> DataFrame:
    """Arrays of names without the dropped ones."""
    gone = F.array(*[F.lit(d.lower()) for d in dropped]).cast("array<string>")
    return df.withColumn(column, F.filter(F.col(column), lambda x: ~F.array_contains(gone, F.lower(x)) | x.isNull()))
