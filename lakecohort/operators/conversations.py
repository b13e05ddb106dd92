"""Tables in chat messages and the age of conversations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SEPARATOR = r"^\s*\|?\s*:?-{1,}:?\s*(\|\s*:?-{1,}:?\s*)*\|?\s*$"
ROW = r"\|"


def cells(line: Column) -> Column:
    """The trimmed cells of a table line, without outer bars."""
    return F.transform(F.split(F.regexp_replace(F.trim(line), r"^\||\|$", ""), r"\|"), lambda x: F.trim(x))


def markdown_tables(messages: DataFrame, key: str, text: str) -> DataFrame:
    """key, table (number in the message), title (nearest heading above), row (from 0) and cells padded to the header's width; the header is row 0.

    Lines of a message are in one window, whose size is bounded by the message.
    """
    order = Window.partitionBy("__m").orderBy("place")
    numbered = messages.select(F.col(key), F.monotonically_increasing_id().alias("__m"), F.col(text).alias("__t"))
    lines = numbered.select(key, "__m", F.posexplode(F.split("__t", "\n")).alias("place", "line"))
    marked = lines.withColumns({
        "is_sep": F.col("line").rlike(SEPARATOR) & F.col("line").contains("-") & F.col("line").contains("|"),
        "has_bar": F.col("line").rlike(ROW),
        "heading": F.nullif(F.trim(F.regexp_extract("line", r"^#{1,6}\s+(.*)$", 1)), F.lit("")),
    })
    marked = marked.withColumns({
        "title": F.last("heading", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0)),
        "is_head": F.col("has_bar") & ~F.col("is_sep") & F.coalesce(F.lead("is_sep").over(order), F.lit(False)),
    })
    marked = marked.withColumn("run", F.sum((~F.col("has_bar") | F.col("is_head")).cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    group = Window.partitionBy("__m", "run")
    inside = marked.withColumn("headed", F.max("is_head").over(group)).filter("headed and has_bar and not is_sep")
    wide = inside.withColumns({"cells": cells(F.col("line")), "row": F.row_number().over(group.orderBy("place")) - 1})
    wide = wide.withColumn("width", F.first(F.size("cells")).over(group.orderBy("place")))
    padded = F.slice(F.concat("cells", F.array_repeat(F.lit(""), F.col("width"))), 1, F.col("width"))
    table = F.dense_rank().over(Window.partitionBy("__m").orderBy("run"))
    return wide.select(key, table.alias("table"), F.coalesce("title", F.lit("Table")).alias("title"), "row", padded.alias("cells"))
