"""Study knowledge: which tables and columns make a cohort, compiled to one DataFrame plan."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakecohort.functions import numbers
from lakecohort.operators import rows, summaries

ANALYSIS_ORDER = ("age", "sex", "smoking", "diabetes", "alcohol_freq", "bmi", "malnutrition", "hba1c")


@dataclass(frozen=True)
class Predictor:
    """kind: numeric, binary (positive and negative labels), code (codes) or ordinal (valid values)."""

    table: str
    column: str
    kind: str = "numeric"
    positive: tuple[str, ...] = ()
    negative: tuple[str, ...] = ()
    codes: Mapping[str, int] = field(default_factory=dict)
    valid: tuple[float, ...] = ()

    def value(self) -> Column:
        c = F.col(f"`{self.column}`")
        if self.kind == "binary":
            return numbers.binary_map(c, self.positive, self.negative)
        if self.kind == "code":
            return numbers.encode(c, self.codes)
        if self.kind == "ordinal":
            return numbers.only(numbers.to_number(c), self.valid)
        if self.kind == "numeric":
            return numbers.to_number(c)
        raise ValueError(f"unknown kind of predictor {self.kind!r}")


@dataclass(frozen=True)
class Outcome:
    table: str
    column: str
    positive: tuple[str, ...]
    #: worst: only subjects with an outcome row; any_positive: others count as 0.
    aggregation: str = "worst"
    also: tuple[tuple[str, str, tuple[str, ...]], ...] = ()  # table, column, positive values


@dataclass(frozen=True)
class Cohort:
    subject: str
    base: str
    joined: tuple[str, ...]
    predictors: Mapping[str, Predictor]
    outcomes: Mapping[str, Outcome]
    #: Tables with several rows a subject, of which the first value in order counts.
    first_of: Mapping[str, str] = field(default_factory=dict)  # table -> order column
    height_range: tuple[float, float | None] = (100.0, 220.0)
    bmi_range: tuple[float, float] = (10.0, 60.0)
    malnutrition_below: float = 18.5

    def outcome(self, name: str) -> Outcome:
        if name not in self.outcomes:
            raise KeyError(f"unknown outcome {name!r}; known: {', '.join(sorted(self.outcomes))}")
        return self.outcomes[name]

    def needed(self, concepts: Sequence[str]) -> dict[str, list[str]]:
        """Tables and columns of concepts and of what derived ones are made from."""
        out: dict[str, list[str]] = {}
        derived = {"bmi": ("weight", "height", "knee_height", "age"), "malnutrition": ("weight", "height", "knee_height", "age")}
        for c in concepts:
            for name in derived.get(c, (c,)):
                if name not in self.predictors:
                    if name == "knee_height":
                        continue
                    raise KeyError(f"unknown concept {name!r}")
                p = self.predictors[name]
                if p.column not in out.setdefault(p.table, []):
                    out[p.table].append(p.column)
        return out


def outcome_rows(cohort: Cohort, frames: Mapping[str, DataFrame], name: str) -> DataFrame:
    """subject and outcome 0/1. Further tables raise an outcome; a subject in them alone is lost, as a row of the first table is needed."""
    spec, key = cohort.outcome(name), cohort.subject
    out = summaries.worst(frames[spec.table], key, spec.column, spec.positive)
    for table, column, positive in spec.also:
        more = summaries.worst(frames[table].withColumn(column, F.col(column).cast("string")), key, column, positive).withColumnRenamed("outcome", "__more")
        out = out.join(more, key, "left").select(key, F.coalesce(F.greatest("outcome", "__more"), F.lit(0)).alias("outcome"))
    return out


def build(cohort: Cohort, frames: Mapping[str, DataFrame], outcome: str, concepts: Sequence[str]) -> DataFrame:
    """subject, outcome and the concepts of each row of the cohort. Repeated subjects of joined tables give a row each."""
    key, needed = cohort.subject, cohort.needed(concepts)
    # each table is cut to its columns under the concepts' names before it is joined
    parts: dict[str, DataFrame] = {}
    for table in dict.fromkeys([cohort.base, *cohort.joined, *needed]):
        values = {n: p.value() for n, p in cohort.predictors.items() if p.table == table and p.column in needed.get(table, ())}
        if table in cohort.first_of:
            parts[table] = None
            for n, v in values.items():
                first = summaries.first_value(frames[table], key, v, cohort.first_of[table], n)
                parts[table] = first if parts[table] is None else parts[table].join(first, key, "full_outer")
        else:
            parts[table] = frames[table].select(key, *[v.alias(n) for n, v in values.items()])
    out = parts[cohort.base]
    for table, part in parts.items():
        if table != cohort.base and part is not None:
            out = out.join(part, key, "left" if table in cohort.first_of else "inner")
    out = derive(out, cohort, concepts)
    found = outcome_rows(cohort, frames, outcome)
    how = "inner" if cohort.outcome(outcome).aggregation == "worst" else "left"
    out = out.join(found, key, how).withColumn("outcome", F.coalesce("outcome", F.lit(0)))
    wanted = [c for c in ANALYSIS_ORDER if c in concepts] + [c for c in concepts if c not in ANALYSIS_ORDER]
    return rows.ordered(out, [key, "outcome"], wanted)


def derive(df: DataFrame, cohort: Cohort, concepts: Sequence[str]) -> DataFrame:
    """bmi from weight and plausible height (or knee height and age), and malnutrition from it."""
    if not {"bmi", "malnutrition"} & set(concepts):
        return df
    low, high = cohort.height_range
    measured = numbers.lower_bound(F.col("height"), low, high)
    height = numbers.height(measured, F.col("knee_height"), F.col("age")) if "knee_height" in df.columns else measured
    df = df.withColumn("bmi", numbers.in_range(numbers.bmi(F.col("weight"), height), *cohort.bmi_range))
    return df.withColumn("malnutrition", numbers.below(F.col("bmi"), cohort.malnutrition_below))


def from_mapping(config: Mapping) -> dict[str, Cohort]:
    """Cohorts by name from a parsed document: {cohorts: {name: {subject, base, joined, predictors, outcomes, ...}}}."""
    out = {}
    for name, c in config["cohorts"].items():
        predictors = {k: Predictor(**{a: tuple(b) if isinstance(b, list) else b for a, b in p.items()}) for k, p in c["predictors"].items()}
        outcomes = {k: Outcome(o["table"], o["column"], tuple(o["positive"]), o.get("aggregation", "worst"), tuple((a["table"], a["column"], tuple(a["positive"])) for a in o.get("also", []))) for k, o in c["outcomes"].items()}
        rest = {k: tuple(v) if isinstance(v, list) else v for k, v in c.items() if k not in ("predictors", "outcomes")}
        out[name] = Cohort(predictors=predictors, outcomes=outcomes, **rest)
    return out
