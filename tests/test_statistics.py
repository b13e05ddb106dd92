"""Medians by selection, and fits from counted patterns against plain versions."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lakecohort.operators import quantiles, stats, summaries


@pytest.mark.parametrize("kind", ["even", "ties", "wide", "two"])
def test_medians_of_large_groups(spark, kind):
    made = {
        "even": "id * 1.5", "ties": "pmod(xxhash64(id), 5)", "wide": "pow(10, pmod(xxhash64(id), 600) - 300) * (1 + id / 1e6)", "two": "if(id % 2 = 0, 5, 6)",
    }[kind]
    df = spark.range(60_000).selectExpr("if(id % 10 < 7, 'big', if(id % 10 = 7, null, 'x')) AS g", f"if(id % 13 = 0, null, cast({made} AS double)) AS v")
    want = {r["g"]: r["m"] for r in df.groupBy("g").agg(F.median("v").alias("m")).collect()}
    got = {r["g"]: r["median"] for r in quantiles.medians(df, "v", ["g"]).collect()}
    assert got == pytest.approx(want, rel=1e-15)
    assert quantiles.medians(df, "v").first()["median"] == pytest.approx(df.agg(F.median("v")).first()[0], rel=1e-15)


def test_medians_of_small_groups(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("a", None), ("b", None), ("c", math.nan), ("c", 1.0), ("c", 2.0), (None, 7.0)], "`the key` string, v double")
    got = {r[0]: r[1] for r in quantiles.medians(df, "v", ["the key"]).collect()}
    assert got == {"a": 1.5, "c": 2.0, None: 7.0}
    found = {r["the key"]: r.asDict() for r in summaries.numeric_summary(df, "v", "the key").collect()}
    assert found["b"]["median"] is None and found["b"]["n_missing"] == 1 and found["a"] | {"the key": 0} == {"the key": 0, "mean": 1.5, "std": pytest.approx(0.5**0.5), "median": 1.5, "min": 1.0, "max": 2.0, "n_valid": 2, "n_missing": 1}
    empty = summaries.numeric_summary(df.limit(0), "v").first()
    assert empty["median"] is None and empty["n_valid"] == 0
    assert "median(" not in summaries.numeric_summary(df, "v", "the key")._jdf.queryExecution().optimizedPlan().toString()


def test_rows_of_large_groups_are_not_moved(spark):
    store, gateway = spark.sparkContext._jsc.sc().statusStore(), spark.sparkContext._gateway
    stages = lambda: store.stageList(None, False, False, gateway.new_array(gateway.jvm.double, 0), gateway.jvm.java.util.ArrayList())
    moved = lambda: (lambda x: sum(x.apply(i).shuffleWriteRecords() for i in range(x.size())))(stages())
    df = spark.range(600_030).selectExpr("CASE WHEN id >= 600000 THEN 'few' WHEN id % 2 = 0 THEN 'even' END AS g", "cast(id % 50 AS double) AS v")
    before = moved()
    got = {r["g"]: r["median"] for r in quantiles.medians(df, "v", ["g"]).collect()}
    assert got == {"even": 24.0, None: 25.0, "few": 14.5}
    assert moved() - before < 60_000


def plain_logit(x, y):
    """Newton's method over all rows; coefficients, errors, log-likelihood."""
    x = np.column_stack([np.ones(len(y)), *x])
    b = np.zeros(x.shape[1])
    for _ in range(60):
        p = 1 / (1 + np.exp(-x @ b))
        cov = np.linalg.inv(x.T @ (x * (p * (1 - p))[:, None]))
        b = b + cov @ (x.T @ (y - p))
    p = 1 / (1 + np.exp(-x @ b))
    return b, np.sqrt(np.diag(cov)), float((y * np.log(p) + (1 - y) * np.log(1 - p)).sum())


@pytest.fixture(scope="module")
def people(spark):
    rng = np.random.default_rng(2)
    n = 2000
    a, b, c = rng.integers(0, 2, n), rng.normal(1e4, 3, n).round(1), rng.integers(0, 5, n)
    y = (rng.random(n) < 1 / (1 + np.exp(-(0.8 * a + 0.4 * (b - 1e4) - 1)))).astype(int)
    rows = [(int(w), None if i % 17 == 0 else int(x), float("nan") if i % 23 == 0 else float(v), int(z), 1) for i, (w, x, v, z) in enumerate(zip(y, a, b, c))]
    return spark.createDataFrame(rows, "y int, a int, `b b` double, c int, one int").cache()


def test_fits_against_all_rows(people):
    rows = [r for r in people.collect() if r["a"] is not None and not math.isnan(r["b b"])]
    y, a, b = (np.array([r[k] for r in rows], float) for k in ("y", "a", "b b"))
    fit = stats.logit(people, "y", ["a", "b b"])
    want = plain_logit([a, b - 1e4], y)
    assert fit.n == len(rows) and fit.coefficients[1:] == pytest.approx(want[0][1:], rel=1e-6) and fit.errors[1:] == pytest.approx(want[1][1:], rel=1e-6) and fit.log_likelihood == pytest.approx(want[2], rel=1e-9)
    product = stats.interaction(people, "y", "a", "c")
    rows = [r for r in people.collect() if r["a"] is not None]
    y, a, c = (np.array([r[k] for r in rows], float) for k in ("y", "a", "c"))
    again = plain_logit([a, c, a * c], y)
    assert product["or_interaction"] == pytest.approx(math.exp(again[0][3]), rel=1e-4)


def test_models_share_their_steps(spark, people, monkeypatch):
    asked = []
    ask, step = stats._ask, stats._step
    monkeypatch.setattr(stats, "_ask", lambda table, models, what, then: (asked.append((what, len(models))), ask(table, models, what, then)))
    monkeypatch.setattr(stats, "_step", lambda table, models: (asked.append(("step", len(models))), step(table, models)))
    found = stats.univariate(people, "y", ["a", "b b", "c", "one"])
    assert [f["n"] for f in found] == [people.filter("a is not null").count(), people.filter("not isnan(`b b`)").count(), 2000, 2000]
    assert found[3]["coef"] is None and all(f["coef"] is not None for f in found[:3])
    assert asked[0] == ("means", 4) and asked[1] == ("spreads", 4) and set(asked[2:]) == {("step", 3)} and len(asked) <= 12  # not one job a model and step
    alone = stats.logit(people, "y", ["c"])
    assert found[2]["coef"] == pytest.approx(alone.coefficients[1], rel=1e-9)


def test_the_source_is_read_once(spark, people):
    seen = spark.sparkContext.accumulator(0)
    source = people.select("y", "a", "c").mapInPandas(lambda it: (seen.add(len(x)) or x for x in it), "y int, a int, c int")
    assert stats.backward(source, "y", ["a", "c"]) is not None
    assert seen.value == 2000
