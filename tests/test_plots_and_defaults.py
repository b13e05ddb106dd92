"""Plot frames against plain versions, and what the default rules do to a study's columns."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lakecohort.operators import deid, plots

KEY = bytes(range(32))


def test_densities(spark):
    rng = np.random.default_rng(1)
    values = rng.normal(5, 2, 300).round(1)
    df = spark.createDataFrame([("a", float(v)) for v in values] + [("one", 3.0)] * 4 + [("a", None), (None, 1.0)], "g string, v double")
    got = sorted((r["point"], r["x"], r["density"]) for r in plots.density(df, "v", ["g"]).collect())
    h = values.std(ddof=1) * len(values) ** -0.2
    grid = np.linspace(values.min(), values.max(), plots.POINTS)
    want = [np.exp(-0.5 * ((x - values) / h) ** 2).sum() / (len(values) * h * math.sqrt(2 * math.pi)) for x in grid]
    assert [g[0] for g in got] == list(range(64)) and np.allclose([g[1] for g in got], grid) and np.allclose([g[2] for g in got], want)
    shape = plots.outline(plots.density(df, "v", ["g"]), ["g"])
    assert shape.agg(F.max("right")).first()[0] == pytest.approx(0.5) and shape.filter("left + right <> 0").count() == 0


def test_points_stay_where_they_are(spark):
    df = spark.range(4000).selectExpr("id", "cast(id % 2 as int) AS y", "cast(id % 3 as int) AS sex", "id % 5 AS m")
    one = {r["key"]: r["y"] for r in plots.points(df, "y", "sex", "id").collect()}
    assert one == {r["key"]: r["y"] for r in plots.points(df.repartition(7), "y", "sex", "id", "m").collect()}
    moved = np.array([v - k % 2 for k, v in one.items()])
    assert abs(moved.mean()) < 0.005 and abs(moved.std() - plots.JITTER) < 0.003 and len(set(moved)) > 3990
    kind, note, frames = plots.frames(df, "y", "sex", "id", "m", "scatter")
    assert kind == "violin" and note and set(frames) == {"points", "density", "rates"} and frames["rates"].count() == 15
    assert plots.frames(df, "y", "other", "id") == (None, "", {})


def test_rates_leave_small_pairs_out(spark):
    df = spark.createDataFrame([("a", 1, 1)] * 6 + [("a", 1, 0)] * 2 + [("b", 1, 1)] * 4, "f string, m int, y int")
    (r,) = plots.rates(df, "y", "f", "m").collect()
    assert (r["factor"], r["n"], r["rate"]) == ("a", 8, 0.75) and r["low"] == pytest.approx(0.4093, abs=1e-3) and r["high"] == pytest.approx(0.9285, abs=1e-3)


@pytest.mark.parametrize("column, kind", [
    ("SUBJID", "id"), ("IS_FID2", "id"), ("specimen_no", "id"), ("Hospital_Code", "id"), ("IC_BIRTHDAT", "drop"), ("dob", "drop"), ("First_Name", "drop"), ("CLIN_NAME", "drop"), ("TC_INITIALS", "drop"), ("HH_ADDRESS", "drop"),
    ("phone_no", "drop"), ("eMail", "drop"), ("aadhaar", "drop"), ("device_serial", "keep"), ("device-id", "drop"), ("IC_RELIG", "drop"), ("entered_by", "drop"), ("FA_DTHDAT", "drop"), ("VISCOMMENT", "drop"), ("Nurse_Initials", "drop"),
    ("IS_AGE", "cap"), ("age", "cap"), ("IC_MARISTAT", "generalize"), ("IS_CONTACTS", "suppress"), ("IS_VISDAT", "date"), ("SCR_DT", "date"), ("xraydate", "date"), ("HBA1C", "keep"), ("CC_WEIGHT", "keep"), ("IS_SEX", "keep"), ("BLD_TIM", "keep"), ("IS_VISIT", "keep"),
])
def test_default_rules(column, kind):
    assert deid.action(column, deid.Rules.defaults()).kind == kind


def test_defaults_scrub_a_table(spark):
    df = spark.createDataFrame([("7", "Ann", "2020-01-02", 95, "widowed", "free text")], "SUBJID string, PATIENT_NAME string, VISDAT string, IS_AGE int, MARISTAT string, REMARKS string")
    row = deid.scrub(df, deid.Rules.defaults(), KEY).first()
    assert set(row.asDict()) == {"SUBJID", "VISDAT", "IS_AGE", "MARISTAT", deid.MARKER}
    assert row["SUBJID"].startswith("SUBJ_") and row["VISDAT"] != "2020-01-02" and row["IS_AGE"] == "90+" and row["MARISTAT"] == "Other"
    assert deid.Rules.defaults(orphan_threshold=3).orphan_threshold == 3
