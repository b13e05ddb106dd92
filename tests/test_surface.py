"""The study surface: masks, gates, redaction everywhere, and results that go by the tables' versions."""

import pytest
from pyspark.sql import functions as F

from lakecohort.operators import versions
from lakecohort.plans import api

PHONE, MAIL = "+91 9876543210", "a.b@c.org"


@pytest.fixture
def study(spark):
    people = spark.createDataFrame([("f" if i < 6 else "m", i, 10.0 * i, f"S{i}") for i in range(12)], "SEX string, AGE int, X double, SUBJID string")
    variables = spark.createDataFrame([("AGE", f"Age, call {PHONE}", f"Form {MAIL}", False), ("SEX", None, None, False)], "variable_name string, description string, form_name string, is_phi boolean")
    return api.Study(spark, {"t": people, "plain": people.select("X").limit(3)}, variables, quasi=("SEX",))


def test_small_groups_are_masked(study):
    got = {r["SEX"]: tuple(r) for r in study.run_sql("SELECT SEX, count(*) AS n, max(X) AS x FROM df_t WHERE AGE > 3 GROUP BY SEX ORDER BY SEX").collect()}
    assert got == {"f": ("f", None, None), "m": ("m", 6, 110.0)}
    assert study.run_sql("SELECT AGE, sum(X) AS x FROM df_t GROUP BY AGE").filter("x is not null").count() == 0
    assert study.run_sql("SELECT count(*) AS n FROM df_t WHERE AGE = 1").first()["n"] is None
    assert study.run_sql("SELECT 1 + max(X) AS n, 7 AS c FROM df_t").first() == (111.0, 7)
    assert study.run_sql("SELECT SEX, count(*) AS n FROM df_t GROUP BY SEX HAVING count(*) > 5 ORDER BY n DESC LIMIT 1").count() == 1
    for q in ("SELECT max(n) FROM (SELECT SEX, count(*) AS n FROM df_t GROUP BY SEX)", "SELECT * FROM (SELECT AGE, count(*) AS n FROM df_t GROUP BY AGE)", "SELECT DISTINCT count(*) FROM df_t GROUP BY AGE"):
        with pytest.raises(PermissionError):
            study.run_sql(q)


def test_rows_that_a_filter_leaves_are_gated(study):
    assert study.run_sql("SELECT AGE FROM df_t WHERE X >= 0").count() == 12
    for q in ("SELECT SUBJID FROM df_t WHERE AGE = 3", "SELECT a.AGE FROM (SELECT * FROM df_t WHERE AGE < 8) a", "SELECT X FROM df_plain"):
        with pytest.raises(api.Blocked):
            study.run_sql(q)
    with pytest.raises(api.Blocked):
        study.query_dataset("plain")


def test_definitions_are_redacted(study):
    frames = [study.search_variables("age"), study.find_variable_candidates("age"), study.get_variable_details("AGE"), study.list_forms(), study.cross_reference_variables("AGE")[0]]
    for df in frames:
        assert df.count() and not any("9876543210" in str(r) or MAIL in str(r) for r in df.collect())


def test_a_republished_table_gives_new_results_and_an_equal_one_hits(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = lambda n: spark.range(n).select(F.lit("f").alias("SEX"), F.col("id").alias("AGE"))
    rows(10).write.parquet(path)
    study = api.Study(spark, {"t": lambda: spark.read.parquet(path)}, rows(1).select(F.lit("AGE").alias("variable_name"), F.lit("d").alias("description"), F.lit("f").alias("form_name"), F.lit(False).alias("is_phi")), quasi=("SEX",))
    count = lambda: study.run_sql("SELECT count(*) AS n FROM df_t").first()["n"]
    assert (count(), count(), study.results.hits, study.results.misses) == (10, 10, 1, 1)
    rows(12).write.mode("overwrite").parquet(path)
    assert (count(), study.results.misses) == (12, 2)
    rows(10).repartition(3).write.mode("overwrite").parquet(path)
    assert (count(), study.results.misses) == (10, 2) and study.results.hits == 2
    assert study.get_dataset_stats().first()["records"] == "10" and study.query_dataset("t", limit=3).count() == 3
    misses = study.results.misses
    assert study.get_dataset_stats().first()["records"] == "10" and study.query_dataset("t", limit=3).count() == 3 and study.results.misses == misses


def test_the_oldest_result_goes(spark):
    kept = versions.Results(2)
    frames = [spark.range(i + 1) for i in range(3)]
    made = [kept.get(i, lambda i=i: frames[i]) for i in range(3)]
    assert list(kept.kept) == [1, 2] and not made[0].is_cached and made[2].is_cached
    kept.get(1, lambda: None)
    kept.get(3, lambda: (frames[0], "x"))
    assert list(kept.kept) == [1, 3] and frames[0].is_cached
    kept.clear()
    assert not frames[0].is_cached


def test_reports_have_their_parts():
    fit = {"variable": "age", "coef": 0.5, "std_error": 0.1, "odds_ratio": 1.65, "ci_low": 1.2, "ci_high": 2.2, "p_value": 0.01, "significant": True}
    result = {
        "n": 50, "events": 9, "rate": 0.18, "caveats": ["few"], "descriptive": {"sex": [{"value": "1", "n": "<5"}], "age": [{"mean": 40.0, "median": None, "n_valid": 50}]}, "univariate": [{"n": 50} | fit, {"n": 3} | dict.fromkeys(fit) | {"variable": "x"}],
        "multivariate": {"table": [fit | {"variable": "intercept"}, fit], "aic": 10.0, "bic": 12.0, "pseudo_r2": 0.2, "n": 50}, "interaction": [{"factor": "age", "moderator": "sex", "p_factor": 0.1, "p_moderator": 0.1, "p_interaction": 0.01, "or_interaction": 2.0}, {"factor": "x", "moderator": "sex", "p_interaction": None}],
    }
    text = api.narrative("A", "death", result)
    for part in ("## A: death", "50 rows, 9 events (18.0%)", "- few", "| sex | 1 | <5 |", "mean 40.00, median -", "| age | 50 | 1.65 | 1.20-2.20 | 0.01 |", "| x | 3 | - | - | - |", "Significant: age.", "AIC 10.0", "OR 2.00, p 0.01 (the effect differs)", "could not be fitted"):
        assert part in text, part
    assert api.narrative("A", "death", {"n": 1, "events": "<5", "rate": None, "caveats": []}) == "## A: death\n\n1 rows, <5 events (-)"
