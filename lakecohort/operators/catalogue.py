"""The variable catalogue: forms, dictionary and datasets merged, and searched."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakecohort.functions import text

from . import rows, summaries


def sections(forms: DataFrame) -> DataFrame:
    """form_name, variable, section and context; the last section that lists a variable counts."""
    each = forms.select("form_name", F.posexplode(F.map_entries("sections")).alias("ordinal", "s"))
    listed = each.select("form_name", "ordinal", F.col("s.key").alias("section"), F.col("s.value.context").alias("context"), F.explode("s.value.variables").alias("variable"))
    return listed.groupBy("form_name", "variable").agg(F.max_by(F.struct("section", "context"), "ordinal").alias("x")).select("form_name", "variable", "x.*")


def form_variables(forms: DataFrame) -> DataFrame:
    """A row for each variable of each form with its section."""
    each = forms.select("form_name", F.explode("variables").alias("variable_name", "v")).select("form_name", "variable_name", "v.description", "v.values", "v.depends_on", "v.condition")
    found = sections(forms).withColumnRenamed("variable", "variable_name")
    return each.join(found, ["form_name", "variable_name"], "left")


def broken_dependencies(variables: DataFrame) -> DataFrame:
    """Variables that depend on what their form doesn't have."""
    names = variables.select("form_name", F.col("variable_name").alias("depends_on"))
    return variables.filter("depends_on is not null").join(names, ["form_name", "depends_on"], "left_anti")


def merge(dictionary: DataFrame, forms: DataFrame, codelists: DataFrame | None = None) -> DataFrame:
    """One row a variable, by upper-case name; the dictionary's fields come first, the form's fill gaps."""
    d, f = dictionary.alias("d"), forms.alias("f")
    pick = lambda name: F.coalesce(F.nullif(F.trim(F.col(f"d.{name}")), F.lit("")), F.col(f"f.{name}")).alias(name)
    out = d.join(f, F.upper("d.variable_name") == F.upper("f.variable_name"), "full_outer").select(
        F.coalesce("d.variable_name", "f.variable_name").alias("variable_name"), pick("description"), pick("form_name"), pick("data_type"), F.when(F.col("d.variable_name").isNull(), "form").when(F.col("f.variable_name").isNull(), "dictionary").otherwise("both").alias("source")
    )
    return out if codelists is None else with_codes(out, codelists)


def with_codes(variables: DataFrame, codelists: DataFrame, name: str = "variable_name") -> DataFrame:
    """variables with coded_options, looked up by exact name."""
    return variables.join(codelists.select(F.col("name").alias(name), F.col("codes").alias("coded_options")), name, "left")


def schema_catalogue(frames: dict[str, DataFrame]) -> DataFrame:
    """dataset, variable_name and records of each visible column."""
    stats = summaries.dataset_statistics(frames, rows.INTERNAL)
    return stats.select("dataset", F.explode(F.split("names", ", ")).alias("variable_name"), "records").orderBy("dataset", "variable_name")


def with_dataset_only(catalogue: DataFrame, columns: DataFrame) -> DataFrame:
    """The catalogue and the columns that it doesn't know."""
    known = catalogue.select(F.upper("variable_name").alias("__k"))
    extra = columns.join(known, F.upper("variable_name") == F.col("__k"), "left_anti")
    return catalogue.unionByName(extra, allowMissingColumns=True)


def deidentified_names(name: Column, phi_type: Column, suggested: Column) -> Column:
    """What a variable is called after de-identification: itself, nothing, or the names that stand for it."""
    none = F.array().cast("array<string>")
    return (
        F.when(phi_type.isNull() | (phi_type == ""), F.array(name)).when(phi_type == "date", F.when(suggested.isNull(), none).otherwise(F.array(suggested)))
        .when(phi_type == "id", F.array(F.concat(name, F.lit("_PSEUDO")), F.concat(name, F.lit("_PRESENT")))).otherwise(none)
    )


def search(variables: DataFrame, query: str, limit: int = 12, name: str = "variable_name", description: str = "description", form: str = "form_name", tie: str | None = None) -> DataFrame:
    """The best variables for a query: by score, then shorter, then earlier names, then by the column tie."""
    scored = variables.withColumn("score", text.variable_score(query, F.col(name), F.col(description), F.col(form)))
    return rows.top(scored, "score", limit, F.length(name), F.col(name), *([F.col(tie)] if tie else []))


@F.pandas_udf(T.DoubleType())
def similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratcliff-Obershelp ratio, of which Spark has no form."""
    return pd.Series([SequenceMatcher(None, x or "", y or "").ratio() for x, y in zip(a, b)])


def candidates(variables: DataFrame, description: str, k: int = 3, name: str = "variable_name", described: str = "description", form: str = "form_name") -> DataFrame:
    """As search, with a fuzzy score where words don't match, and a confidence."""
    wanted = " ".join(text.words(description))
    scored = variables.withColumn("score", text.variable_score(description, F.col(name), F.col(described), F.col(form)))
    # only variables without a score go to Python
    start = F.substring(text.normalise(F.coalesce(F.col(described), F.lit(""))), 1, max(3 * len(wanted), 40))
    # of those only the ones whose letters allow the ratio
    near = scored.filter("score = 0").withColumn("__start", start).filter(text.ratio_bound(wanted, F.col("__start")) >= text.FUZZY_RATIO)
    fuzzy = near.withColumn("score", F.when(similarity(F.lit(wanted), F.col("__start")) >= text.FUZZY_RATIO, text.FUZZY_POINTS).otherwise(0)).drop("__start")
    best = rows.top(scored.filter("score > 0").unionByName(fuzzy), "score", max(1, min(k, 10)), F.length(name), F.col(name))
    first = F.max("score").over(Window.partitionBy())
    return best.withColumn("confidence", text.confidence(F.col("score"), first)).withColumn("low_confidence", F.col("confidence") < text.LOW_CONFIDENCE)


def snippets(texts: DataFrame, query: str, k: int = 5, column: str = "text", form: str = "form_name", tie: str | None = None) -> DataFrame:
    """The best snippets for a query: by score, then shorter, then by form, then by the column tie."""
    scored = texts.withColumn("score", text.snippet_score(query, F.col(column)))
    return rows.top(scored, "score", max(1, min(k, 15)), F.length(column), F.col(form), *([F.col(tie)] if tie else []))


def best_form(variables: DataFrame, query: str) -> DataFrame:
    """Variables of the form whose name fits best; the first of equal ones."""
    terms, phrase = text.query_terms(query)
    points = sum((F.when(text.has_term(text.expand("form_name"), t), 1).otherwise(0) for t in terms), F.when(text.expand("form_name").contains(phrase), 10).otherwise(0))
    chosen = variables.select("form_name").distinct().withColumn("s", points).filter("s > 0").orderBy(F.desc("s"), "form_name").limit(1).select("form_name")
    return variables.join(F.broadcast(chosen), "form_name", "left_semi")
