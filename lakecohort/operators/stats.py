"""Logistic regression from sums over counted patterns: each Newton step is one aggregation for all models, whatever the number of rows.

Perfect separation, constant predictors and fits that don't converge are failures (None), never numbers.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEAST_ROWS, LEAST_INTERACTION, ALPHA = 20, 30, 0.05
RARE, SEVERE, LOW, MISSING = 5, 10, 30, 0.10
STEPS, SLOPE, ERROR = 50, 15.0, 1000.0
Z = 1.959963984540054
CATEGORICAL, CONTINUOUS = {"diabetes", "smoking", "sex"}, {"bmi", "alcohol_freq", "age", "hba1c"}


@dataclass(frozen=True)
class Fit:
    names: tuple[str, ...]
    coefficients: tuple[float, ...]
    errors: tuple[float, ...]
    log_likelihood: float
    null_log_likelihood: float
    n: int

    @property
    def p_values(self) -> tuple[float, ...]:
        return tuple(math.erfc(abs(b / s) / math.sqrt(2)) for b, s in zip(self.coefficients, self.errors))

    @property
    def aic(self) -> float:
        return -2 * self.log_likelihood + 2 * len(self.names)

    @property
    def bic(self) -> float:
        return -2 * self.log_likelihood + len(self.names) * math.log(self.n)

    @property
    def mcfadden(self) -> float:
        return 1 - self.log_likelihood / self.null_log_likelihood

    def table(self) -> list[dict]:
        out = []
        for name, b, s, p in zip(self.names, self.coefficients, self.errors, self.p_values):
            ratio = math.exp(b) if b < 700 else math.nan
            out.append({"variable": name, "coef": b, "std_error": s, "odds_ratio": ratio, "ci_low": math.exp(min(b - Z * s, 700)), "ci_high": math.exp(min(b + Z * s, 700)), "p_value": p, "significant": p < ALPHA})
        return out


def patterns(df: DataFrame, outcome: str, predictors: Sequence[str]) -> DataFrame:
    """The design in short: each different row of y, x0, x1, ... and how often (n) it occurs. NaN counts as missing.

    One pass over the source; where predictors have few values the result is small, whatever the number of rows, and all
    that follows reads it alone. It is kept for the session until released.
    """
    number = lambda c: F.when(~F.isnan(F.col(f"`{c}`").cast("double")), F.col(f"`{c}`").cast("double"))
    rows = df.select(number(outcome).alias("y"), *[number(p).alias(f"x{i}") for i, p in enumerate(predictors)]).filter("y is not null")
    return rows.groupBy(*rows.columns).agg(F.count("*").alias("n")).cache()


class Model:
    """A model while it is fitted: predictors by their place in the patterns, standardised within for steady steps."""

    def __init__(self, names: Sequence[str], columns: Sequence[Column]):
        self.names, self.columns, self.fit, self.open = tuple(names), list(columns), None, True
        # rows count where the outcome and all predictors of this model are there
        self.rows = F.when(reduce(Column.__and__, [c.isNotNull() for c in columns]), F.col("n")) if columns else F.col("n")

    def means(self) -> list[Column]:
        return [F.sum(self.rows), F.sum(self.rows * F.col("y")), *[F.sum(self.rows * c) / F.sum(self.rows) for c in self.columns]]

    def begin(self, found: Sequence) -> None:
        self.n, self.events, self.mean = int(found[0] or 0), found[1] or 0.0, [x or 0.0 for x in found[2:]]
        self.open = bool(self.n) and self.events not in (0.0, float(self.n))

    def spreads(self) -> list[Column]:
        return [F.sqrt(F.sum(self.rows * (c - m) * (c - m)) / F.sum(self.rows)) for c, m in zip(self.columns, self.mean)]

    def scale(self, found: Sequence) -> None:
        self.spread = np.array(found, float)
        self.open = not (self.spread == 0).any()
        self.beta, self.before = np.zeros(len(self.columns) + 1), -math.inf
        self.beta[0] = math.log(self.events / (self.n - self.events))

    def step(self, found: Sequence) -> None:
        k = len(self.beta)
        gradient, hessian = np.array(found[1 : k + 1], float), np.zeros((k, k))
        hessian[np.triu_indices(k)] = found[k + 1 :]
        hessian += np.triu(hessian, 1).T
        if not self.open:
            return
        try:
            covariance = np.linalg.inv(hessian)
        except np.linalg.LinAlgError:
            self.open = False
            return
        if abs(found[0] - self.before) <= 1e-10 * (abs(found[0]) + 1e-10):
            self.open, self.fit = False, self._fit(found[0], covariance)
            return
        self.before, self.beta = found[0], self.beta + covariance @ gradient

    def _fit(self, log_likelihood: float, covariance: np.ndarray) -> Fit | None:
        mean, spread, beta = np.array(self.mean), self.spread, self.beta
        slopes = beta[1:] / spread
        back = np.eye(len(beta))
        back[0, 1:] = -mean / spread
        back[1:, 1:] = np.diag(1 / spread)
        errors = np.sqrt(np.diag(back @ covariance @ back.T))
        if not np.isfinite(errors).all() or (np.abs(beta[1:]) > SLOPE).any() or (errors[1:] * spread > ERROR).any():
            return None
        rate = self.events / self.n
        null = self.n * (rate * math.log(rate) + (1 - rate) * math.log(1 - rate))
        return Fit(("intercept", *self.names), (float(beta[0] - (slopes * mean).sum()), *map(float, slopes)), tuple(map(float, errors)), float(log_likelihood), null, self.n)


def _ask(table: DataFrame, models: Sequence[Model], what: str, then: str) -> None:
    """One aggregation with the sums of all models; each gets its own."""
    parts = [getattr(m, what)() for m in models]
    row = table.agg(*[c.alias(f"{i}_{j}") for i, part in enumerate(parts) for j, c in enumerate(part)]).first()
    at = 0
    for m, part in zip(models, parts):
        getattr(m, then)(row[at : at + len(part)])
        at += len(part)


def _step(table: DataFrame, models: Sequence[Model]) -> None:
    """One Newton step of all models: log-likelihood, gradient and upper half of the curvature of each in one aggregation."""
    scaled, eta, sums = [], [], []
    for i, m in enumerate(models):
        scaled += [m.rows.alias(f"n{i}"), *[((c - float(m.mean[j])) / float(m.spread[j])).alias(f"z{i}_{j + 1}") for j, c in enumerate(m.columns)]]
        z = [F.lit(1.0), *[F.col(f"z{i}_{j + 1}") for j in range(len(m.columns))]]
        eta.append(reduce(Column.__add__, [float(b) * c for b, c in zip(m.beta, z)]).alias(f"e{i}"))
        n, e, p, y = F.col(f"n{i}"), F.col(f"e{i}"), F.col(f"p{i}"), F.col("y")
        # log(1 + exp(e)) without overflow
        sums.append([F.sum(n * (y * e - F.greatest(e, F.lit(0.0)) - F.log1p(F.exp(-F.abs(e))))), *[F.sum(n * (y - p) * c) for c in z], *[F.sum(n * p * (1 - p) * z[j] * z[k]) for j in range(len(z)) for k in range(j, len(z))]])
    chances = {f"p{i}": 1 / (1 + F.exp(-F.col(f"e{i}"))) for i in range(len(models))}
    rows = table.select("*", *scaled).select("*", *eta).withColumns(chances)
    row = rows.agg(*[c.alias(f"{i}_{j}") for i, part in enumerate(sums) for j, c in enumerate(part)]).first()
    at = 0
    for m, part in zip(models, sums):
        m.step(row[at : at + len(part)])
        at += len(part)


def fits(table: DataFrame, models: Sequence[Model], least: int = 0) -> list[Fit | None]:
    """Maximum likelihood with an intercept of all models at once: each Newton step is one aggregation over the patterns. Models of fewer than ``least`` rows aren't fitted."""
    if models:
        _ask(table, models, "means", "begin")
    active = [m for m in models if m.open and m.n >= least]
    if active:
        _ask(table, active, "spreads", "scale")
    active = [m for m in active if m.open]
    for _ in range(STEPS):
        if not any(m.open for m in active):
            break
        _step(table, active)
    return [m.fit for m in models]


def _model(names: Sequence[str], predictors: Sequence[str]) -> Model:
    return Model(names, [F.col(f"x{list(predictors).index(p)}") for p in names])


def logit(df: DataFrame, outcome: str, predictors: Sequence[str]) -> Fit | None:
    """Maximum likelihood with an intercept over rows without nulls."""
    table = patterns(df, outcome, predictors)
    try:
        return fits(table, [_model(predictors, predictors)])[0]
    finally:
        table.unpersist()


def univariate(df: DataFrame, outcome: str, predictors: Sequence[str]) -> list[dict]:
    """One fit a predictor, all at once; too few rows, one class or a failed fit give nulls."""
    table = patterns(df, outcome, predictors)
    try:
        models = [_model([p], predictors) for p in predictors]
        found = fits(table, models, LEAST_ROWS)
    finally:
        table.unpersist()
    none = {k: None for k in ("coef", "std_error", "odds_ratio", "ci_low", "ci_high", "p_value")} | {"significant": False}
    return [{"variable": p, "n": m.n} | (none if fit is None else {k: v for k, v in fit.table()[1].items() if k != "variable"}) for p, m, fit in zip(predictors, models, found)]


def backward(df: DataFrame, outcome: str, predictors: Sequence[str], alpha: float = ALPHA) -> Fit | None:
    """Drop the least significant predictor until all are, or one is left. Rows are chosen anew for each model; after a failure the last good model counts.

    The source is read once: every model of the way is fitted from its patterns.
    """
    left, best = list(predictors), None
    if not left:
        return None
    table = patterns(df, outcome, predictors)
    try:
        kinds = table.agg(*[F.count_distinct(f"x{i}") for i in range(len(left))]).first()
        left = [p for p, n in zip(left, kinds) if n > 1]
        while left:
            fit = fits(table, [_model(left, predictors)])[0]
            if fit is None:
                break
            best = fit
            worst = max(range(len(left)), key=lambda i: fit.p_values[i + 1])
            if len(left) == 1 or fit.p_values[worst + 1] <= alpha:
                break
            left.pop(worst)
    finally:
        table.unpersist()
    return best


def interaction(df: DataFrame, outcome: str, factor: str, moderator: str) -> dict:
    """p values of both and of their product, and the product's odds ratio."""
    table = patterns(df, outcome, [factor, moderator])
    try:
        fit = fits(table, [Model([factor, moderator, "interaction"], [F.col("x0"), F.col("x1"), F.col("x0") * F.col("x1")])], LEAST_INTERACTION)[0]
    finally:
        table.unpersist()
    if fit is None:
        return {"factor": factor, "moderator": moderator, "p_factor": None, "p_moderator": None, "p_interaction": None, "or_interaction": None}
    p = fit.p_values
    return {"factor": factor, "moderator": moderator, "p_factor": p[1], "p_moderator": p[2], "p_interaction": p[3], "or_interaction": fit.table()[3]["odds_ratio"]}


def binary_logit(df: DataFrame, outcome: str, predictor: str) -> DataFrame:
    """The fit of a 0/1 predictor in closed form, from its four cells; nulls where a cell is empty."""
    y, x = F.col(outcome), F.col(predictor)
    cell = lambda a, b: F.sum(((x == a) & (y == b)).cast("long")).cast("double")
    t = df.filter(y.isNotNull() & x.isNotNull()).agg(cell(1, 1).alias("a"), cell(1, 0).alias("b"), cell(0, 1).alias("c"), cell(0, 0).alias("d"))
    whole = (F.col("a") > 0) & (F.col("b") > 0) & (F.col("c") > 0) & (F.col("d") > 0)
    b = F.when(whole, F.log(F.col("a") * F.col("d") / (F.col("b") * F.col("c"))))
    s = F.when(whole, F.sqrt(1 / F.col("a") + 1 / F.col("b") + 1 / F.col("c") + 1 / F.col("d")))
    return t.select(F.round(b, 6).alias("coef"), F.round(s, 6).alias("std_error"), F.round(F.exp(b), 6).alias("odds_ratio"), F.round(F.exp(b - Z * s), 6).alias("ci_low"), F.round(F.exp(b + Z * s), 6).alias("ci_high"))


def caveats(events: int, missing: Sequence[str]) -> list[str]:
    out = []
    if events < SEVERE:
        out.append(f"only {events} events: estimates are not reliable")
    elif events < LOW:
        out.append(f"{events} events: low power")
    return out + [f"{c}: more than {MISSING:.0%} missing" for c in missing]


def underpowered(events: int, variables: int = 6) -> bool:
    return events < SEVERE or events / max(1, variables) < 5


def plot_kind(predictor: str, wanted: str | None = None) -> tuple[str | None, str]:
    """(violin, scatter or None; a note where the wish doesn't fit the scale)."""
    fits = "violin" if predictor in CATEGORICAL else "scatter" if predictor in CONTINUOUS else None
    return fits, f"{predictor} is shown as {fits}" if fits and wanted and wanted != fits else ""


def plot_data(df: DataFrame, outcome: str, predictor: str, seed: int = 7) -> DataFrame:
    """Points with the outcome jittered for display."""
    return df.select(F.col(predictor).alias("x"), (F.col(outcome) + 0.05 * F.randn(seed)).alias("y"), F.col(outcome).alias("outcome")).dropna()
