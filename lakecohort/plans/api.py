"""The query surface of a study: every table that leaves it has passed the row gate and text redaction."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakecohort.functions import phi
from lakecohort.operators import catalogue, privacy, rows, stats, summaries, versions
from lakecohort.plans.knowledge import Cohort, build
from lakecohort.sources import files

# Other names of outcomes.
OUTCOME_ALIASES = {"relapse": "unfavorable", "failure": "unfavorable", "unfavourable": "unfavorable", "recurrence": "unfavorable", "progression": "incident_tb", "incident": "incident_tb", "tb": "incident_tb"}
# Parts of a statement that run_sql takes, by the names of Spark's parsed plan, and functions.
PLAN = frozenset("Project Filter Aggregate Sort GlobalLimit LocalLimit Distinct UnresolvedHaving UnresolvedRelation SubqueryAlias".split())
EXPRESSIONS = frozenset(
    "UnresolvedAttribute UnresolvedStar UnresolvedAlias UnresolvedOrdinal Alias Literal And Or Not EqualTo EqualNullSafe GreaterThan GreaterThanOrEqual LessThan LessThanOrEqual In IsNull IsNotNull "
    "Like Between Add Subtract Multiply Divide UnaryMinus Cast CaseWhen UnresolvedFunction SortOrder".split()
)
FUNCTIONS = frozenset("count sum avg mean min max stddev median lower upper trim length round abs floor ceil coalesce nullif if year month between".split())


class Blocked(Exception):
    """The gate refused; the message gives no counts."""


@dataclass
class Study:
    """frames: tables by name, or functions that read them, so that a table published again is seen.

    Every frame that a tool returns has identifiers taken out of its texts. Rows are shown only where every class of the
    quasi-identifiers has k rows, among the rows that a filter leaves; a table that has none of them is one class. Without
    quasi-identifiers no rows are shown at all (ValueError). Counts and what is worked out from fewer than k rows are masked.
    Results are kept by tool, arguments and the versions of the tables that they came from.
    """

    spark: SparkSession
    frames: dict[str, DataFrame | Callable[[], DataFrame]]
    variables: DataFrame
    forms: DataFrame | None = None
    cohorts: dict[str, Cohort] = field(default_factory=dict)
    quasi: tuple[str, ...] = ()
    sensitive: tuple[str, ...] = ()
    k: int = privacy.SMALL
    results: versions.Results = field(default_factory=versions.Results, repr=False)
    _versions: versions.Versions = field(default_factory=versions.Versions, repr=False)

    def _frame(self, name: str) -> DataFrame:
        found = self.frames[name]
        return found if isinstance(found, DataFrame) else found()

    def _kept(self, tool: str, args: tuple, tables: dict[str, DataFrame], make: Callable[[], object]):
        said = tuple((n, self._versions.of(n, df)) for n, df in sorted(tables.items()))
        return self.results.get((tool, args, said, self.k, self.quasi, self.sensitive), make)

    def _known(self, tool: str, args: tuple, make: Callable[[], DataFrame]) -> DataFrame:
        """A frame made of the variables, redacted."""
        return self._kept(tool, args, {"_variables": self.variables}, lambda: _redacted(make()))

    def _guard(self, df: DataFrame) -> DataFrame:
        if not self.quasi:
            raise ValueError("quasi-identifiers are missing")
        if present := rows.present(df, self.quasi):
            if (v := privacy.row_gate(df, present, self.k, rows.present(df, self.sensitive))).blocked:
                raise Blocked(v.reason)
        elif 0 < df.limit(self.k).count() < self.k:
            raise Blocked(f"there are fewer than {self.k} rows")
        return df

    def search_variables(self, query: str) -> DataFrame:
        return self._known("search_variables", (query,), lambda: catalogue.search(self.variables, query))

    def find_variable_candidates(self, description: str, k: int = 3) -> DataFrame:
        return self._known("find_variable_candidates", (description, k), lambda: catalogue.candidates(self.variables, description, k))

    def get_variable_details(self, name: str) -> DataFrame:
        return self._known("get_variable_details", (name.upper(),), lambda: self.variables.filter(F.upper("variable_name") == name.upper()))

    def list_forms(self) -> DataFrame:
        return self._known("list_forms", (), lambda: summaries.form_counts(self.variables))

    def get_form_variables(self, form: str) -> DataFrame:
        return self._known("get_form_variables", (form,), lambda: catalogue.best_form(self.variables, form))

    def query_dataset(self, dataset: str, columns: str = "", filter_column: str = "", filter_value: str = "", limit: int = rows.ROWS, order: str | None = None) -> DataFrame:
        """Rows of a table: filtered, gated over all that the filter leaves, then limited, with dates hidden."""
        name = rows.resolve(dataset, list(self.frames))
        if name is None:
            raise KeyError(f"unknown dataset {dataset!r}")
        table = self._frame(name)

        def make() -> DataFrame:
            found = self._guard(rows.filter_equal(table, filter_column, filter_value))
            file_order = "_provenance.row_index" if "_provenance" in found.columns else found.columns[0]
            return _redacted(rows.project(rows.limited(found, order or file_order, limit), columns))

        return self._kept("query_dataset", (columns, filter_column, filter_value, limit, order), {name: table}, make)

    def get_dataset_stats(self, dataset: str | None = None) -> DataFrame:
        """Counts of small tables are masked."""
        found = {n: self._frame(n) for n in rows.resolve_all(dataset, list(self.frames))}
        return self._kept("get_dataset_stats", (), found, lambda: summaries.dataset_statistics(found, rows.INTERNAL).withColumn("records", privacy.mask_small(F.col("records"), self.k)))

    def get_study_overview(self) -> DataFrame:
        found = {n: self._frame(n) for n in self.frames}
        return self._kept("get_study_overview", (), found | {"_variables": self.variables}, lambda: summaries.overview(self.variables, summaries.dataset_statistics(found, rows.INTERNAL)))

    def run_sql(self, query: str) -> DataFrame:
        """A single SELECT over the views df_<table>, of allowed parts and functions only; texts of the result are redacted.

        What Spark's parser makes of the statement is checked, so nothing runs before it is taken. Each table that it reads
        has to pass the gate as a whole, and so have the rows that its filters leave, unless it adds them up: then the
        results of groups of fewer than k rows are null.
        """
        views = {files.view_name(n).lower(): n for n in self.frames}
        try:
            plan = self.spark._jsparkSession.sessionState().sqlParser().parsePlan(query)
        except Exception:
            raise PermissionError("a single SELECT is allowed") from None
        used = _relations(plan)
        if not used or not used <= set(views):
            raise PermissionError("only tables of the study can be read")
        tables = {views[v]: self._frame(views[v]) for v in used}

        def make() -> DataFrame:
            for df in tables.values():
                self._guard(df)
            files.expose({n: rows.visible(df) for n, df in tables.items()})
            sized, adds = _sized(self.spark, plan)
            if not adds:
                self._guard(_frame_of(self.spark, _source(plan)))
                return _redacted(self.spark.sql(query))
            df = _frame_of(self.spark, sized)
            large = F.col(GROUP_SIZE) >= self.k
            return _redacted(df.select(*[F.when(large, F.col(f"`{c}`")).alias(c) if i in adds else F.col(f"`{c}`") for i, c in enumerate(df.columns[:-1])]))

        return self._kept("run_sql", (query,), tables, make)

    def cross_reference_variables(self, name: str, limit: int = 20) -> tuple[DataFrame, DataFrame]:
        """(definitions, completeness by table) of variables whose name holds the text."""
        found = {n: self._frame(n) for n in self.frames}

        def make() -> tuple[DataFrame, DataFrame]:
            definitions = self.variables.filter(F.upper("variable_name").contains(name.upper())).orderBy("variable_name", "form_name").limit(limit)
            out = self.spark.createDataFrame([], "dataset string, records string, populated string, percent string")
            for n, df in sorted(found.items()):
                if hit := [c for c in rows.visible(df).columns if name.upper() in c.upper()]:
                    out = out.unionByName(summaries.completeness(df, hit, self.k).select(F.lit(n).alias("dataset"), "*"))
            return _redacted(definitions), out

        return self._kept("cross_reference_variables", (name, limit), found | {"_variables": self.variables}, make)

    def run_study_analysis(self, cohort: str, outcome: str, predictors: Sequence[str], moderator: str | None = None) -> dict:
        """Descriptives, fits and caveats of a cohort; with few events descriptives only. Counts under k are masked."""
        spec, found = self.cohorts[cohort], {n: self._frame(n) for n in self.frames}
        outcome = outcome if outcome in spec.outcomes else OUTCOME_ALIASES.get(outcome.lower(), outcome)
        return self._kept("run_study_analysis", (cohort, outcome, tuple(predictors), moderator), found, lambda: self._analysis(spec, found, cohort, outcome, predictors, moderator))

    def _analysis(self, spec: Cohort, found: dict[str, DataFrame], cohort: str, outcome: str, predictors: Sequence[str], moderator: str | None) -> dict:
        df = build(spec, found, outcome, predictors).cache()
        try:
            counts = summaries.events(df, "outcome").first()
            gaps = [r["column"] for r in summaries.missing(df, predictors, stats.MISSING).collect()]
            out = {"n": counts["n"], "events": counts["events"], "rate": counts["rate"], "caveats": stats.caveats(counts["events"], gaps), "descriptive": {p: self._described(df, p) for p in predictors}}
            if counts["events"] >= stats.RARE:
                out["univariate"] = stats.univariate(df, "outcome", predictors)
                fit = stats.backward(df, "outcome", predictors)
                out["multivariate"] = None if fit is None else {"table": fit.table(), "aic": fit.aic, "bic": fit.bic, "pseudo_r2": fit.mcfadden, "n": fit.n}
                if moderator:
                    out["interaction"] = [stats.interaction(df, "outcome", p, moderator) for p in predictors if p != moderator]
            out["underpowered"] = stats.underpowered(counts["events"], len(predictors))
            if min(counts["events"], counts["n"] - counts["events"]) < self.k:
                out |= {"events": f"<{self.k}", "rate": None, "caveats": stats.caveats(0, gaps)[1:]}
            out["report"] = narrative(cohort, outcome, out)
            return out
        finally:
            df.unpersist()

    def _described(self, df: DataFrame, predictor: str) -> list[dict]:
        """Values of fewer than k rows are masked; so are summaries of so few."""
        kind, table = summaries.describe(df, predictor)
        found = [r.asDict() for r in table.collect()]
        if kind == "counts":
            return [r | {"n": r["n"] if r["n"] >= self.k else f"<{self.k}"} for r in found]
        return [r if r["n_valid"] >= self.k else {c: None for c in r} | {"n_valid": f"<{self.k}"} for r in found]

    def search_pdf_context(self, query: str, k: int = 5) -> DataFrame:
        """Snippets of forms with injected instructions and identifiers taken out."""
        found = catalogue.snippets(files.flatten_forms(self.forms), query, k)
        return found.withColumn("text", phi.sanitise(phi.redact("text")))


#: The column that says how many rows a result was worked out from.
GROUP_SIZE = "__group_size"
ADDING = frozenset("count sum avg mean min max stddev median".split())


def _adds(expression) -> bool:
    """Does an expression hold an aggregate?"""
    if expression.getClass().getSimpleName() == "UnresolvedFunction" and expression.nameParts().apply(0).lower() in ADDING:
        return True
    children = expression.children()
    return any(_adds(children.apply(i)) for i in range(children.length()))


def _outputs(plan) -> list[bool] | None:
    """Of a projection or aggregation: which of its columns are aggregates; None if it only projects."""
    kind = plan.getClass().getSimpleName()
    if kind not in ("Project", "Aggregate"):
        return None
    columns = plan.aggregateExpressions() if kind == "Aggregate" else plan.projectList()
    found = [_adds(columns.apply(i)) for i in range(columns.length())]
    return found if kind == "Aggregate" or any(found) else None


def _sized(spark: SparkSession, plan):
    """(the plan with how many rows each result comes from as last column, places of aggregates); (the plan, none) if it adds nothing up.

    Aggregates stand in the outermost selection only.
    """
    kind, found = plan.getClass().getSimpleName(), _outputs(plan)
    if found is not None:
        if _inner(plan):
            raise PermissionError("a result can't be added up again")
        size = spark._jsparkSession.sessionState().sqlParser().parseExpression(f"count(1) AS {GROUP_SIZE}")
        logical = spark._jvm.org.apache.spark.sql.catalyst.plans.logical
        more = lambda columns: getattr(columns, "$colon$plus")(size)
        if kind == "Project":
            return logical.Project(more(plan.projectList()), plan.child()), {i for i, x in enumerate(found) if x}
        return logical.Aggregate(plan.groupingExpressions(), more(plan.aggregateExpressions()), plan.child(), plan.hint()), {i for i, x in enumerate(found) if x}
    if kind in ("Sort", "GlobalLimit", "LocalLimit", "UnresolvedHaving", "Distinct") and plan.children().length() == 1:
        below, adds = _sized(spark, plan.children().apply(0))
        if adds:
            if kind == "Distinct":
                raise PermissionError("a result can't be added up again")
            return plan.withNewChildren(getattr(plan.children().take(0), "$colon$plus")(below)), adds
    elif _inner(plan):
        raise PermissionError("a result can't be added up again")
    return plan, set()


def _inner(plan) -> bool:
    """Does anything below the plan add up or group?"""
    children = plan.children()
    below = [children.apply(i) for i in range(children.length())]
    return any(_outputs(x) is not None or _inner(x) for x in below)


def _source(plan):
    """What the outermost selection takes its rows from: the relation with its filters."""
    while plan.getClass().getSimpleName() not in ("Filter", "UnresolvedRelation", "SubqueryAlias") and plan.children().length() == 1:
        plan = plan.children().apply(0)
    return plan


def _frame_of(spark: SparkSession, plan) -> DataFrame:
    return DataFrame(spark._jvm.org.apache.spark.sql.classic.Dataset.ofRows(spark._jsparkSession, plan), spark)


def _redacted(df: DataFrame) -> DataFrame:
    """Dates hidden and identifiers taken out of every text."""
    hidden = rows.hide_dates(df, [c for c, t in df.dtypes if t == "string"])
    return phi.redact_leaves(hidden)


def _relations(plan) -> set[str]:
    """The views that a parsed plan reads; PermissionError if any part of it isn't allowed."""
    kind = plan.getClass().getSimpleName()
    if kind not in PLAN:
        raise PermissionError(f"{kind} is not allowed")
    expressions = plan.expressions()
    for i in range(expressions.length()):
        _check(expressions.apply(i))
    if kind == "UnresolvedRelation":
        parts = plan.multipartIdentifier()
        if parts.length() != 1:
            raise PermissionError("only tables of the study can be read")
        return {parts.apply(0).lower()}
    children = plan.children()
    return set().union(*(_relations(children.apply(i)) for i in range(children.length())))


def _check(expression) -> None:
    kind = expression.getClass().getSimpleName().rstrip("$")
    if kind not in EXPRESSIONS:
        raise PermissionError(f"{kind} is not allowed")
    if kind == "UnresolvedFunction":
        name = expression.nameParts()
        if name.length() != 1 or name.apply(0).lower() not in FUNCTIONS:
            raise PermissionError(f"function {name.mkString('.')} is not allowed")
    children = expression.children()
    for i in range(children.length()):
        _check(children.apply(i))


def narrative(cohort: str, outcome: str, result: dict) -> str:
    """The result as Markdown: head, descriptives, fits and interactions, each where the result has it."""
    parts = [_head(cohort, outcome, result), _descriptive(result.get("descriptive") or {}), _fits(result.get("univariate") or []), _model(result.get("multivariate")), _interactions(result.get("interaction") or [])]
    return "\n\n".join(p for p in parts if p)


def _table(head: Sequence[str], rows_: Sequence[Sequence[object]]) -> str:
    line = lambda cells: "| " + " | ".join("-" if c is None else str(c) for c in cells) + " |"
    return "\n".join([line(head), "|" + "-|" * len(head), *map(line, rows_)])


def _number(x: float | None, shape: str = ".2f") -> str | None:
    return None if x is None else format(x, shape)


def _head(cohort: str, outcome: str, result: dict) -> str:
    rate = "-" if result["rate"] is None else f"{result['rate']:.1%}"
    lines = [f"## {cohort}: {outcome}", "", f"{result['n']} rows, {result['events']} events ({rate})", *(f"- {c}" for c in result["caveats"])]
    return "\n".join(lines)


def _descriptive(found: dict[str, list[dict]]) -> str:
    """Means of measures, counts of categories."""
    out = []
    for name, rows_ in found.items():
        for r in rows_:
            said = (r["value"], r["n"]) if "value" in r else (f"mean {_number(r['mean']) or '-'}, median {_number(r['median']) or '-'}", r["n_valid"])
            out.append((name, *said))
    return _table(("variable", "value", "n"), out) if out else ""


def _fits(found: list[dict]) -> str:
    interval = lambda f: None if f["coef"] is None else f"{f['ci_low']:.2f}-{f['ci_high']:.2f}"
    return _table(("variable", "n", "OR", "95 % CI", "p"), [(f["variable"], f["n"], _number(f["odds_ratio"]), interval(f), _number(f["p_value"], ".3g")) for f in found]) if found else ""


def _model(found: dict | None) -> str:
    """The model that is left after elimination; which predictors are significant in it."""
    if found is None:
        return ""
    table = _table(("variable", "adjusted OR", "95 % CI", "p"), [(f["variable"], _number(f["odds_ratio"]), f"{f['ci_low']:.2f}-{f['ci_high']:.2f}", _number(f["p_value"], ".3g")) for f in found["table"] if f["variable"] != "intercept"])
    named = ", ".join(f["variable"] for f in found["table"] if f["significant"] and f["variable"] != "intercept")
    return f"{table}\n\nn {found['n']}, AIC {found['aic']:.1f}, BIC {found['bic']:.1f}, pseudo R2 {found['pseudo_r2']:.3f}. " + (f"Significant: {named}." if named else "No predictor is significant.")


def _interactions(found: list[dict]) -> str:
    lines = []
    for f in found:
        if f["p_interaction"] is None:
            lines.append(f"- {f['factor']} by {f['moderator']}: could not be fitted")
        else:
            lines.append(f"- {f['factor']} by {f['moderator']}: OR {f['or_interaction']:.2f}, p {f['p_interaction']:.3g}" + (" (the effect differs)" if f["p_interaction"] < stats.ALPHA else ""))
    return "\n".join(lines)
