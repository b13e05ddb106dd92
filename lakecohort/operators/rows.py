"""Projections, filters and orders of the governed row query."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

INTERNAL = ("source_file", "_provenance", "_source_row", "_ingestion_ts")
ISO_DATE = r"^\d{4}-\d{2}-\d{2}(?:[T ]\d{2}:\d{2}(?::\d{2}(?:\.\d+)?)?(?:Z|[+-]\d{2}:?\d{2})?)?$"
SHIFTED = "<DATE_SHIFTED>"
ROWS, MOST_ROWS = 20, 100


def visible(df: DataFrame) -> DataFrame:
    return df.drop(*INTERNAL)


def project(df: DataFrame, columns: str | Sequence[str] | None) -> DataFrame:
    """The wanted columns that exist, in the wanted order; all visible ones without a wish."""
    wanted = [c.strip() for c in columns.split(",")] if isinstance(columns, str) else list(columns or [])
    found = [c for c in wanted if c in df.columns and c not in INTERNAL]
    return df.select(*[F.col(f"`{c}`") for c in found]) if found else visible(df)


def rename_concepts(df: DataFrame, concepts: Mapping[str, str]) -> DataFrame:
    """source columns under their concept's name and _raw."""
    return df.withColumnsRenamed({source: f"{concept}_raw" for concept, source in concepts.items()})


def equal_text(c: Column, value: str) -> Column:
    """A cell's text equals a value without regard to case; a null cell reads none."""
    return F.lower(F.coalesce(c.cast("string"), F.lit("none"))) == value.lower()


def filter_equal(df: DataFrame, column: str | None, value: str | None) -> DataFrame:
    """No filter unless both are given; a column that isn't there equals the empty text only, which is no filter."""
    if not column or not value:
        return df
    return df.filter(equal_text(F.col(f"`{column}`"), value)) if column in df.columns else df.filter(F.lit(False))


def resolve(name: str, known: Sequence[str]) -> str | None:
    """The first name in order that holds the text, without regard to case."""
    return next((n for n in sorted(known) if name.lower() in n.lower()), None)


def resolve_all(name: str | None, known: Sequence[str]) -> list[str]:
    return [n for n in sorted(known) if not name or name.lower() in n.lower()]


def limited(df: DataFrame, order: str, n: int = ROWS) -> DataFrame:
    """The first rows by an order, from 1 to 100 of them."""
    return df.orderBy(order).limit(max(1, min(int(n), MOST_ROWS)))


def redact_dates(df: DataFrame) -> tuple[DataFrame, list[str]]:
    """Texts that are ISO dates hidden, and in which columns there were any."""
    texts = [c for c, t in df.dtypes if t == "string"]
    if not texts:
        return df, []
    hit = df.agg(*[F.max(F.col(f"`{c}`").rlike(ISO_DATE)).alias(c) for c in texts]).first()
    return hide_dates(df, texts), [c for c in texts if hit[c]]


def hide_dates(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.withColumns({c: F.when(F.col(f"`{c}`").rlike(ISO_DATE), SHIFTED).otherwise(F.col(f"`{c}`")) for c in columns})


def present(df: DataFrame, candidates: Sequence[str]) -> list[str]:
    return [c for c in candidates if c in df.columns]


def complete(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows without a null in the columns."""
    return df.dropna(subset=list(columns))


def is_void(df: DataFrame) -> bool:
    """No columns and no rows."""
    return not df.columns and df.isEmpty()


def ordered(df: DataFrame, first: Sequence[str], then: Sequence[str]) -> DataFrame:
    return df.select(*first, *[c for c in then if c in df.columns])


def named_rows(df: DataFrame, name: str) -> DataFrame:
    """Dictionary rows whose name is more than dashes."""
    return df.filter(F.coalesce(F.trim(F.regexp_replace(F.col(name), "^-+|-+$", "")), F.lit("")) != "")


def search_conversations(turns: DataFrame, query: str, conversation: str = "conv_id", text: str = "text") -> DataFrame:
    """Ids of conversations in which a text holds the query, without regard to case; a blank query finds all."""
    hits = turns if not query.strip() else turns.filter(F.lower(text).contains(query.strip().lower()))
    return hits.select(conversation).distinct()


def newest_first(df: DataFrame, pinned: str, updated: str) -> DataFrame:
    return df.orderBy(F.desc(pinned), F.desc(updated))


def top(df: DataFrame, score: str, n: int, *then: Column) -> DataFrame:
    """The n best rows with a score, with rank from 1."""
    best = df.filter(F.col(score) > 0).orderBy(F.desc(score), *then).limit(n)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc(score), *then)))
