"""One-pass ingest, generations and table versions."""

import json
from dataclasses import replace

import pytest

from lakecohort.operators import deid, versions
from lakecohort.sources import generations, runs

KEY = bytes(range(32))
RULES = deid.Rules(dates=("DAT$",), ids=(("^SUBJID$", "SUBJ"),), drop=("NAME",), orphan_threshold=2)


def put(folder, name, *lines):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("\n".join(lines) + "\n")


@pytest.fixture
def place(tmp_path):
    put(tmp_path / "in", "visits.csv", "SUBJID,VISDAT,NAME,KG,KG_2,OK,NOTE", "1,2020-01-02,Ann,50.5,50.5,true,007", " ,2020-01-03,Bob,,,false,x", "2,bad,Eve,70,70,true,", ",,,1,1,,")
    put(tmp_path / "in", "labs.csv", "SUBJID,HB", "1,10", "2,11", "2,11")
    return tmp_path


def test_nothing_is_lost(spark, place):
    got = runs.ingest(spark, str(place / "in"), str(place / "out"), RULES, KEY, study="s")
    assert got["code"] == 0 and got["published"] == ["labs", "visits"]
    store = generations.Folder(spark, str(place / "out"))
    rows = {r["_provenance"]["row_index"]: r for r in store.table("visits").collect()}
    assert set(rows) == {0, 2} and rows[0]["KG"] == 50.5 and rows[0]["OK"] is True and rows[0]["NOTE"] == "007" and rows[2]["NOTE"] is None
    assert "NAME" not in rows[0] and "KG_2" not in rows[0] and rows[0]["SUBJID"].startswith("SUBJ_") and rows[0]["_provenance"]["source_file"] == "visits.csv"
    held = spark.read.parquet(store.generation().quarantine + "/visits").collect()
    assert {(r["row_index"], r["NAME"], r["KG"]) for r in held} == {(1, "Bob", None), (3, None, "1")}
    told = store.manifest()
    assert told["tables"]["visits"] | {"fingerprint": 0} == {"rows": 2, "read": 4, "quarantined": 2, "fingerprint": 0}
    assert {(e["dataset"], e["scope"], e["field"], e["events"]) for e in told["audit"]} == {
        ("visits", "phi-scrub-id", "SUBJID", 2), ("visits", "phi-scrub-date", "VISDAT", 1), ("visits", "phi-scrub-date-unparsed", "VISDAT", 1), ("visits", "phi-scrub-drop", "NAME", 2), ("labs", "phi-scrub-id", "SUBJID", 3),
    }
    assert set(told["inputs"]) == {"visits.csv", "labs.csv"} and KEY.hex() not in json.dumps(told) and "staged" not in generations.names(spark, store.generation().path)
    assert runs.ingest(spark, str(place / "in"), str(place / "out"), RULES, KEY, study="s")["skipped"]


def test_a_table_in_parts_is_one_table(spark, place):
    for k, rows in enumerate((("3,2020-01-02", "1,x"), (",2020-01-03",), ("2,2020-01-04", "5,2020-01-05"))):
        put(place / "more", "labs.csv", "SUBJID,HB", "1,10")
        put(place / "more" / "visits.csv", f"part-0000{k}.csv", "SUBJID,VISDAT", *rows)
    got = runs.ingest(spark, str(place / "more"), str(place / "out"), RULES, KEY)
    assert got["code"] == 0 and got["published"] == ["labs", "visits"]
    store = generations.Folder(spark, str(place / "out"))
    assert {r["row_index"] for r in store.table("visits").select("_provenance.*").collect()} == {0, 1, 3, 4}
    assert [(r["row_index"], r["source_file"]) for r in spark.read.parquet(store.generation().quarantine + "/visits").collect()] == [(2, "visits.csv")]
    told = store.manifest()
    assert set(told["inputs"]) == {"labs.csv", *(f"visits.csv/part-0000{k}.csv" for k in range(3))} and told["tables"]["visits"]["read"] == 5
    assert runs.ingest(spark, str(place / "more"), str(place / "out"), RULES, KEY)["skipped"]
    put(place / "more" / "visits.csv", "part-00001.csv", "SUBJID,VISDAT", "7,2020-01-03")
    assert not runs.ingest(spark, str(place / "more"), str(place / "out"), RULES, KEY)["skipped"]


def test_a_failure_leaves_the_generation_whole(spark, place, monkeypatch):
    first = runs.ingest(spark, str(place / "in"), str(place / "out"), RULES, KEY)
    store = generations.Folder(spark, str(place / "out"))
    written = runs.publishable

    def second_fails(df, rules, key, study, path):
        if path.endswith("visits"):
            raise RuntimeError("a row that must not be told")
        return written(df, rules, key, study, path)

    put(place / "in", "labs.csv", "SUBJID,HB", "9,12")
    monkeypatch.setattr(runs, "publishable", second_fails)
    failed = runs.ingest(spark, str(place / "in"), str(place / "out"), RULES, KEY)
    assert (failed["code"], failed["failed"], failed["error"], failed["published"]) == (1, "scrub", "RuntimeError", [])
    assert store.current() == first["generation"] and store.table("labs").count() == 3 and store.published() == [first["generation"]]
    monkeypatch.undo()
    second = runs.ingest(spark, str(place / "in"), str(place / "out"), RULES, KEY)
    assert store.table("labs").count() == 1 and store.published() == [first["generation"], second["generation"]]
    store.restore(first["generation"])
    assert store.table("labs").count() == 3
    assert store.prune(1) == [] and len(store.published()) == 2  # the current one stays, and the last
    store.restore(second["generation"])
    assert store.prune(1) == [first["generation"]]


def test_too_many_orphans_are_quarantined_and_fail(spark, place):
    got = runs.ingest(spark, str(place / "in"), str(place / "out"), replace(RULES, orphan_threshold=1), KEY)
    assert got["failed"] == "quarantine" and "2 rows" in got["error"]
    kept = generations.names(spark, str(place / "out" / "quarantine"))
    assert len(kept) == 1 and spark.read.parquet(str(place / "out" / "quarantine" / kept[0] / "visits")).count() == 2
    assert generations.Folder(spark, str(place / "out")).current() is None


def test_deleted_inputs_go_and_drills_find_damage(spark, place):
    runs.ingest(spark, str(place / "in"), str(place / "out"), RULES, KEY)
    (place / "in" / "labs.csv").unlink()
    runs.ingest(spark, str(place / "in"), str(place / "out"), RULES, KEY)
    store = generations.Folder(spark, str(place / "out"))
    assert set(store.manifest()["tables"]) == {"visits"} and not store.has("labs")
    old = store.generation(store.published()[0])
    assert old.drill() == {"labs": True, "visits": True}
    next((place / "out" / "generations" / old.name / "tables" / "labs").glob("part-*")).unlink()
    assert old.drill()["labs"] is False
    with pytest.raises(ValueError, match="labs"):
        store.restore(old.name)
    with store.lock(), pytest.raises(RuntimeError), store.lock():
        pass


def test_header_only_and_merged_datasets(spark, tmp_path):
    put(tmp_path / "in", "a.csv", "SUBJID,X", "1,1", "2,2", "3,3")
    put(tmp_path / "in", "b.csv", "SUBJID,X", "3,3", "4,4", "4,4")
    put(tmp_path / "in", "empty.csv", "SUBJID,Y")
    got = runs.ingest(spark, str(tmp_path / "in"), str(tmp_path / "out"), RULES, KEY, pairs=[("a", "b")])
    assert got["published"] == ["a", "empty"], got
    store = generations.Folder(spark, str(tmp_path / "out"))
    assert sorted((r["X"], r["_provenance"]["source_file"], r["_provenance"]["row_index"]) for r in store.table("a").collect()) == [(1, "a.csv", 0), (2, "a.csv", 1), (3, "a.csv", 2), (4, "b.csv", 1)]
    assert store.table("empty").count() == 0 and "Y" in store.table("empty").columns
    assert {"kept": "a", "dropped": "b", "reason": "merged"} in store.manifest()["cleaning"]


def test_plans_read_each_input_once(spark, place):
    from lakecohort.sources import files

    df = dict(files.texts(spark, str(place / "in" / "visits.csv")))["visits"]
    staged = runs.stage(df, "visits.csv", RULES, str(place / "staged"))
    assert (staged.read, staged.orphans) == (4, 2) and staged.kinds["KG"] == "double" and staged.kinds["OK"] == "boolean" and staged.kinds["NOTE"] == "string"
    plan = staged.rows(spark)._jdf.queryExecution().executedPlan().toString().replace("FileScan", "Scan")
    assert "Scan csv" not in plan and "Scan parquet" in plan


def test_kinds_are_what_the_casts_say(spark):
    from pyspark.sql import functions as F

    from lakecohort.functions import numbers

    texts = (
        "1.5| 5 |5\x7f|\x7f5.5|1e3|1d|1D|1f|0x1p3|0X1P-2f|0x.8p1|0x1.p1|0x1|NaN| nan|-NaN|+nan|NaNd|inf|-Infinity|INFINITY|Infinityf|+5|-0|00|5.|.5|-.5|+.5e-3D|5e|1e5f|1e400|..5|5..|1_0|1,5|1-2|- 1|1 2|\u0665|\u20035|5\u2003|5\u0085|\x0b5|5\n|5.\n|"
        "9223372036854775807|9223372036854775808|-9223372036854775808|00000000000000000000000012|11111111111111111111|t|yes| Y|TRUE|Yes\t|\x7ftrue\x00|tru|n|No|1|0 |\u0130nf|+|-|.|e| |\t||2020-01-02|007"
    ).split("|")
    df = spark.createDataFrame([(v,) for v in [*texts, None]], "v string")
    for kind in runs.KINDS:
        found = df.select("v", F.col("v").try_cast(kind).cast("string").alias("cast"), numbers.as_kind(F.col("v"), kind).cast("string").alias("made")).collect()
        assert [(r["v"], r["cast"]) for r in found] == [(r["v"], r["made"]) for r in found]
        assert sum(r["made"] is not None for r in found) > 5
    bits = sum((F.when(F.col("v").try_cast(kind).isNotNull(), 2**i).otherwise(0) for i, kind in enumerate(runs.KINDS)), F.lit(0))
    told = df.select("v", F.when(F.col("v").isNotNull(), bits).alias("cast"), numbers.kinds(F.col("v")).alias("told")).collect()
    assert [(r["v"], r["cast"]) for r in told] == [(r["v"], r["told"]) for r in told]
    assert {r["told"] for r in told} == {None, 0, 1, 2, 3, 4, 7}


def test_staging_texts_takes_little_longer_than_writing_them(spark, tmp_path):
    import time

    from pyspark.sql import functions as F

    df = spark.range(0, 40000, 1, 2).select(*[F.concat(F.lit("2020-01-02 n"), F.col("id").cast("string")).alias(c) for c in ("SUBJID", *"abcdefghij")])
    df.write.parquet(str(tmp_path / "warm"))
    began = time.time()
    df.write.parquet(str(tmp_path / "plain"))
    plain = time.time() - began
    began = time.time()
    assert set(runs.stage(df, "texts.csv", RULES, str(tmp_path / "staged")).kinds.values()) == {"string"}
    assert time.time() - began < 4 * plain + 3  # an exception a cell and kind would take 10 seconds and more


def test_fingerprints(spark):
    rows = [(1, "a", 0.5, [1, 2], {"x": 1, "y": 2}), (2, None, None, None, None), (2, None, None, None, None)]
    kind = "i int, s string, d double, a array<int>, m map<string,int>"
    df = spark.createDataFrame(rows, kind)
    same = versions.fingerprint(df)
    assert versions.fingerprint(spark.createDataFrame(rows[::-1], kind).repartition(3)) == same
    for other in (rows[:2], rows + rows[1:2], [(1, "a", 0.5, [2, 1], {"x": 1, "y": 2}), *rows[1:]], [(1, None, 0.5, [1, 2], {"x": 1, "y": 2}), (2, "a", None, None, None), rows[2]]):
        assert versions.fingerprint(spark.createDataFrame(other, kind)) != same
    assert versions.fingerprint(df.withColumnRenamed("s", "t")) != same
    assert versions.fingerprint(df.limit(0)) == versions.fingerprint(df.limit(0).repartition(2))


def plain_strips(rows):
    out, strip, before = [], 0, True
    for at, v in sorted(rows):
        empty = not (v or "").strip()
        if not empty:
            strip += before
            out.append((at, v, strip))
        before = empty
    return out


@pytest.mark.parametrize("gap", [1, 3])
def test_strips_over_many_blocks(spark, gap, monkeypatch):
    import random

    from lakecohort.sources import files

    monkeypatch.setattr(files, "FAN", 64)
    random.seed(4)
    rows = [(gap * i, random.choice(["x", "y", "", " ", None]) if not 300 < i < 900 else ("z" if i < 600 else None)) for i in range(1300)]
    got = files.strips(spark.createDataFrame(rows, "row_index long, v string").repartition(5)).collect()
    assert sorted(map(tuple, got)) == plain_strips(rows)
    for n in (0, 1):
        few = spark.createDataFrame(rows[:n] + [(5, None)] * n, "row_index long, v string")
        assert files.strips(few).count() == len(plain_strips(rows[:n]))


def test_tables_of_a_sheet_as_the_plain_splitter(spark):
    from lakecohort.sources import files

    sheet = [["a", "b", None, "c"], ["1", "2", None, "3"], [None, None, None, "4"], [None, " ", "", None], ["ignore below", None, None, "q"], ["z", None, None, "r"], ["9", None, None, "8"], [None] * 4, ["h", "h", None, None]]
    plain = files.promote(spark, files.split_sheet(sheet), "s", "d.xlsx")
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(sheet)], "row_index int, c1 string, c2 string, c3 string, c4 string")
    got = files.promoted(df, "s", "d.xlsx")
    assert [(f, n, d.columns, sorted(map(tuple, d.collect()), key=repr)) for f, n, d in got] == [(f, n, d.columns, sorted(map(tuple, d.collect()), key=repr)) for f, n, d in plain]
    assert files.promoted(df.limit(0), "s", "d.xlsx") == []
