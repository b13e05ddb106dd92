"""Workbooks as a data source: ranges of rows, shared and inline texts, gaps, and a run over one."""

import zipfile

import pytest

from lakecohort.operators import deid
from lakecohort.sources import files, generations, runs, workbooks

MAIN, REL = workbooks.MAIN[1:-1], workbooks.LINK[1:-3]


def book(path, rows, dimension=True, name="Visits"):
    shared = sorted({v for r in rows for v in r if v and not v.isdigit()})
    letters = "ABCDEFGH"
    body = ""
    for i, r in enumerate(rows, 1):
        cells = ""
        for k, v in enumerate(r):
            if v is not None:
                cells += f'<c r="{letters[k]}{i}"><v>{v}</v></c>' if v.isdigit() else f'<c r="{letters[k]}{i}" t="s"><v>{shared.index(v)}</v></c>'
        body += f'<row r="{i}">{cells}</row>'
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{MAIN}" xmlns:r="{REL}"><sheets><sheet name="{name}" r:id="r1"/><sheet name="Empty" r:id="r2"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="x"><Relationship Id="r1" Target="worksheets/sheet1.xml"/><Relationship Id="r2" Target="/xl/worksheets/sheet2.xml"/></Relationships>')
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet xmlns="{MAIN}">' + (f'<dimension ref="A1:C{len(rows) - 3}"/>' if dimension else "") + f"<sheetData>{body}</sheetData></worksheet>")
        z.writestr("xl/worksheets/sheet2.xml", f'<worksheet xmlns="{MAIN}"><sheetData/></worksheet>')
        z.writestr("xl/sharedStrings.xml", f'<sst xmlns="{MAIN}">' + "".join(f"<si><r><t>{s[:1]}</t></r><r><t>{s[1:]}</t></r></si>" for s in shared) + "</sst>")


@pytest.mark.parametrize("dimension", [True, False])
def test_ranges_of_rows(spark, tmp_path, dimension):
    path = str(tmp_path / "b.xlsx")
    body = [[str(i), None if i % 3 == 0 else f"t{i % 7}", None if i % 2 else "x"] for i in range(1, 1001)]
    book(path, [["id", "note", "note"], *body], dimension)
    ((sheet, df),) = files.read_xlsx(spark, path, 100)  # the empty sheet is left out
    assert sheet == "Visits" and df.columns == ["id", "note", "note_1"]
    assert [list(r) for r in df.collect()] == body  # in order, none twice, none lost, though the dimension is short
    assert df.rdd.getNumPartitions() == (10 if dimension else 1)
    one = spark.read.format("workbook").schema("a string, b string").option("sheet", "Visits").load(path)
    assert one.columns == ["a", "b"] and one.count() == 1000
    with pytest.raises(Exception, match="no sheet"):
        spark.read.format("workbook").option("sheet", "None").load(path).count()
    assert files.xlsx_sheets(path)[0][1][1] == ["1", "t1"]


def test_a_run_over_a_workbook(spark, tmp_path, monkeypatch):
    (tmp_path / "in").mkdir()
    book(str(tmp_path / "in" / "w.xlsx"), [["SUBJID", "X"], *[[str(i) if i % 10 else None, "v"] for i in range(1, 201)]])
    monkeypatch.setattr(files.read_xlsx, "__defaults__", (50,))
    got = runs.ingest(spark, str(tmp_path / "in"), str(tmp_path / "out"), deid.Rules(ids=(("^SUBJID$", "SUBJ"),), orphan_threshold=50), bytes(32))
    assert got["published"] == ["w"], got
    rows = generations.Folder(spark, str(tmp_path / "out")).table("w").collect()
    assert sorted(r["_provenance"]["row_index"] for r in rows) == [i - 1 for i in range(1, 201) if i % 10]
