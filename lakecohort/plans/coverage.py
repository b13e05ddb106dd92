"""More registered queries: files written and read again, scalar functions, catalogue rules and the study surface, each with its SQL."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from dataclasses import replace
from functools import reduce
from xml.sax.saxutils import escape

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakecohort.functions import dates, keyed, numbers, phi, text
from lakecohort.operators import catalogue, dedup, deid, plots, rows, stats
from lakecohort.plans import api
from lakecohort.plans.registry import _SQL as _QUERY_SQL
from lakecohort.plans.registry import TEST_KEY, query, read
from lakecohort.sources import files, generations, runs, sinks, workbooks

TABLES = "benchmark conversations customer documents embeddings events labels lineitem nation orders pages part region supplier".split()


def folder(spark: SparkSession) -> str:
    """A new place in the shared folder; a temporary one only on one machine."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        shared = f"file://{tempfile.mkdtemp(prefix='lakecohort-')}"
    return f"{shared}/files-{uuid.uuid4().hex}"


def local(path: str) -> str:
    return path.removeprefix("file://").removeprefix("file:")


def named(spark: SparkSession, found: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(found, schema)


# ---- sources


@query("src1_discover", " UNION ALL ".join(f"SELECT '{t}.parquet' AS name, count(*) AS n FROM {t}" for t in TABLES))
def src1_discover(spark, sf):
    """SRC1: the files of a folder by suffix, each read."""
    found = [spark.read.parquet(path).agg(F.lit(path.rsplit("/", 1)[-1]).alias("name"), F.count("*").alias("n")) for path in files.discover_all(spark, sf, (".parquet",), folders=True)]
    return reduce(DataFrame.unionByName, found)


@query("src2_csv", "SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'NA' WHEN c_custkey % 3 = 2 THEN c_name END AS mark, c_acctbal FROM customer")
def src2_csv(spark, sf):
    """SRC2: only the empty text is missing; kinds are inferred."""
    path = folder(spark)
    mark = F.when(F.col("c_custkey") % 3 == 0, "NA").when(F.col("c_custkey") % 3 == 2, F.col("c_name"))
    read(spark, sf, "customer").select("c_custkey", mark.alias("mark"), "c_acctbal").write.option("header", True).csv(path)
    return files.read_csv(spark, path).select(F.col("c_custkey").cast("long").alias("c_custkey"), "mark", "c_acctbal")


def _event_lines(spark, sf, broken: bool) -> DataFrame:
    line = F.to_json(F.struct("event_id", "event_type", "value"))
    e = read(spark, sf, "events")
    return e.select(F.when(F.col("event_id") % 5 == 0, F.concat(F.lit('{"event_id": '), F.substring(F.col("event_type"), 1, 3))).otherwise(line).alias("value")) if broken else e.select(line.alias("value"))


@query("src3_workbook", "SELECT c_custkey, CAST(c_custkey AS VARCHAR) AS key, c_name AS name, c_mktsegment AS segment FROM customer")
def src3_workbook(spark, sf):
    """SRC3: workbooks written from a table, one a task, and read as ranges of rows."""
    path = local(folder(spark))

    def write(batches):
        task = TaskContext.get().partitionId()
        os.makedirs(path, exist_ok=True)
        book = f"{path}/{task}.xlsx"
        with zipfile.ZipFile(book, "w", zipfile.ZIP_DEFLATED) as z:
            z.writestr("xl/workbook.xml", f'<workbook xmlns="{workbooks.MAIN[1:-1]}" xmlns:r="{workbooks.LINK[1:-3]}"><sheets><sheet name="S" r:id="a"/></sheets></workbook>')
            z.writestr("xl/_rels/workbook.xml.rels", '<Relationships><Relationship Id="a" Target="worksheets/sheet1.xml"/></Relationships>')
            cell = lambda v: f'<c t="inlineStr"><is><t>{escape(str(v))}</t></is></c>'
            with z.open("xl/worksheets/sheet1.xml", "w") as f:
                f.write(f'<worksheet xmlns="{workbooks.MAIN[1:-1]}"><sheetData><row>{"".join(map(cell, ("key", "name", "segment")))}</row>'.encode())
                for b in batches:
                    for row in zip(*(c.to_pylist() for c in b.columns)):
                        f.write(f"<row>{''.join(map(cell, row))}</row>".encode())
                f.write(b"</sheetData></worksheet>")
        yield pa.RecordBatch.from_pydict({"book": [book]})

    c = read(spark, sf, "customer").select("c_custkey", "c_name", "c_mktsegment").repartition(3, "c_custkey")
    books = [r["book"] for r in c.mapInArrow(write, "book string").collect()]  # a path a task
    found = reduce(DataFrame.unionByName, [df for b in sorted(set(books)) for _, df in files.read_xlsx(spark, b, 400)])
    return found.select(F.col("key").cast("long").alias("c_custkey"), "key", "name", "segment")


@query("src4_jsonl_lenient", "SELECT event_id, event_type, value FROM events WHERE event_id % 5 <> 0")
def src4_jsonl_lenient(spark, sf):
    """SRC4: malformed lines are skipped."""
    path = folder(spark)
    _event_lines(spark, sf, True).write.text(path)
    return files.read_jsonl(spark, path, schema="event_id long, event_type string, value double")


@query("src5_jsonl_strict", "SELECT event_id, event_type, value FROM events")
def src5_jsonl_strict(spark, sf):
    """SRC5: every line must hold an object."""
    path = folder(spark)
    _event_lines(spark, sf, False).write.text(path)
    return files.read_jsonl(spark, path, strict=True, schema="event_id long, event_type string, value double")


@query("src6_bad_lines", """SELECT CASE WHEN event_id % 5 <> 0 THEN event_id END AS event_id, CASE WHEN event_id % 5 = 0 THEN '{"event_id": ' || substr(event_type, 1, 3) END AS bad FROM events""")
def src6_bad_lines(spark, sf):
    """SRC6: each line parsed, or as it stands where it is no object."""
    parsed = files.parse_lines(_event_lines(spark, sf, True), "value", "event_id long, event_type string, value double")
    return parsed.select("parsed.event_id", "bad")


def _forms(spark, sf) -> DataFrame:
    """A form a nation (a bounded table), written as documents and read again."""
    path = folder(spark)
    for r in read(spark, sf, "nation").collect():
        variables = {f"V{r['n_nationkey']}": {"description": f"key of {r['n_name']}", "condition": "if known"}, f"R{r['n_regionkey']}": {"description": "region", "depends_on": "NONE"}}
        form = {"form_name": r["n_name"], "summary": f"about {r['n_name']}", "sections": {"main": {"context": "c", "variables": [f"V{r['n_nationkey']}"]}}, "variables": variables}
        sinks.write_document(f"{local(path)}/{r['n_name']}_variables.json", form)
    return files.read_forms(spark, path)


@query("src7_forms", "SELECT n_name AS form_name, 'V' || n_nationkey AS variable_name, 'key of ' || n_name AS description, 'main' AS section FROM nation UNION ALL SELECT n_name, 'R' || n_regionkey, 'region', NULL FROM nation")
def src7_forms(spark, sf):
    """SRC7, SNK2: form documents and their variables with sections."""
    return catalogue.form_variables(_forms(spark, sf)).select("form_name", "variable_name", "description", "section")


@query("src16_snippets", "SELECT n_name AS form_name, NULL AS variable, 'about ' || n_name AS text FROM nation UNION ALL SELECT n_name, 'V' || n_nationkey, 'key of ' || n_name || '  Condition: if known' FROM nation UNION ALL SELECT n_name, 'R' || n_regionkey, 'region' FROM nation")
def src16_snippets(spark, sf):
    """SRC16: forms flattened into texts."""
    return files.flatten_forms(_forms(spark, sf))


@query("jn13_form_dependencies", "SELECT n_name AS form_name, 'R' || n_regionkey AS variable_name FROM nation")
def jn13_form_dependencies(spark, sf):
    """JN13 through form documents."""
    return catalogue.broken_dependencies(catalogue.form_variables(_forms(spark, sf))).select("form_name", "variable_name")


@query("src9_promoted_tables", "SELECT '' AS folder, 'sheet_table_1' AS name, CAST(r_regionkey AS VARCHAR) AS a, r_name AS b FROM region UNION ALL SELECT 'extras', 'sheet_table_2', '1', '2'")
def src9_promoted_tables(spark, sf):
    """SRC8, SRC9: a sheet split at empty rows; from the marker on tables are extras."""
    body = read(spark, sf, "region").select((F.col("r_regionkey") + 1).alias("row_index"), F.col("r_regionkey").cast("string").alias("c1"), F.col("r_name").alias("c2"))
    frame = named(spark, [(0, "a", "b"), (10**6, None, " "), (10**6 + 1, "IGNORE BELOW", None), (10**6 + 2, "a", "b"), (10**6 + 3, "1", "2")], "row_index long, c1 string, c2 string")
    made = [df.select(F.lit(f).alias("folder"), F.lit(n).alias("name"), "a", "b") for f, n, df in files.promoted(frame.unionByName(body), "sheet", "x.xlsx")]
    return made[0].unionByName(made[1])


@query("src10_unique_names", """
WITH h AS (SELECT n_nationkey, CASE WHEN n_regionkey = 3 THEN 'Unnamed' ELSE 'r' || n_regionkey END AS name FROM nation)
SELECT n_nationkey, name || CASE WHEN k = 1 THEN '' ELSE '_' || (k - 1) END AS name FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY n_nationkey) AS k FROM h)""")
def src10_unique_names(spark, sf):
    """SRC10: repeated and missing header names; a header is a row of names."""
    header = read(spark, sf, "nation").orderBy("n_nationkey").select("n_nationkey", F.when(F.col("n_regionkey") != 3, F.concat(F.lit("r"), "n_regionkey")).otherwise(F.when(F.col("n_nationkey") % 2 == 0, " ")).alias("name")).collect()
    return named(spark, list(zip([r["n_nationkey"] for r in header], files.unique_names([r["name"] for r in header]))), "n_nationkey long, name string")


@query("src15_named_frames", "SELECT c_custkey, c_name FROM customer")
def src15_named_frames(spark, sf):
    """SRC15: tables as views df_<stem>."""
    (view,) = files.expose({"study customer": read(spark, sf, "customer")})
    return spark.table(view).select("c_custkey", "c_name")


# ---- sinks


@query("snk1_staged_json", "SELECT o_orderkey, o_orderstatus FROM orders")
def snk1_staged_json(spark, sf):
    """SNK1, SNK3: JSON lines replaced as a whole."""
    path, o = folder(spark), read(spark, sf, "orders").select("o_orderkey", "o_orderstatus")
    sinks.write_staged(o.filter("o_orderkey < 0"), path)
    sinks.write_staged(o, path)
    return files.read_jsonl(spark, path, strict=True, schema="o_orderkey long, o_orderstatus string")


@query("snk5_csv_result", "SELECT n_nationkey, n_name FROM nation")
def snk5_csv_result(spark, sf):
    path = folder(spark)
    sinks.write_csv(read(spark, sf, "nation").select("n_nationkey", "n_name"), path)
    return files.read_csv(spark, path, "n_nationkey int, n_name string")


@query("snk6_publish", "SELECT r_regionkey, true AS published, false AS empty_published FROM region")
def snk6_publish(spark, sf):
    """SNK6: a staged folder moves into place over an older one; one that isn't there doesn't."""
    path = folder(spark)
    for part in ("staging", "target"):
        read(spark, sf, "region").select("r_regionkey").filter("r_regionkey >= 0" if part == "staging" else "r_regionkey = 1").write.parquet(f"{path}/{part}")
    none, done = sinks.publish(spark, f"{path}/none", f"{path}/target"), sinks.publish(spark, f"{path}/staging", f"{path}/target")
    return spark.read.parquet(f"{path}/target").select("r_regionkey", F.lit(done).alias("published"), F.lit(none).alias("empty_published"))


@query("snk7_events", "SELECT event_id, 'seen [REDACTED] ' || event_type AS note FROM events")
def snk7_events(spark, sf):
    """SNK7, PHI10: appended in two parts with identifiers masked."""
    path, e = folder(spark), read(spark, sf, "events")
    made = e.select("event_id", F.concat(F.lit("seen 123-45-6789 "), "event_type").alias("note"))
    for part in (0, 1):
        sinks.append_events(made.filter(F.col("event_id") % 2 == part), path, ["note"])
    return files.read_jsonl(spark, path, strict=True, schema="event_id long, note string")


@query("gov1_fresh", "SELECT true AS same, false AS newer_version, false AS missing_output, false AS changed_input")
def gov1_fresh(spark, sf):
    """GOV1, GOV2: inputs, version and outputs decide whether a step is fresh."""
    inputs = sinks.digests(spark, f"{sf}/nation.parquet")
    manifest = {"version": "1", "inputs": {r["name"]: r["sha256"] for r in inputs.select("name", "sha256").collect()}}
    other = sinks.digests(spark, f"{sf}/region.parquet")
    answers = (sinks.is_fresh(manifest, inputs, "1", []), sinks.is_fresh(manifest, inputs, "2", []), sinks.is_fresh(manifest, inputs, "1", ["/nowhere/x"]), sinks.is_fresh(manifest, other, "1", []))
    return named(spark, [answers], "same boolean, newer_version boolean, missing_output boolean, changed_input boolean")


# ---- projections and names


@query("prj2_rename", "SELECT c_custkey, c_acctbal AS balance_raw FROM customer")
def prj2_rename(spark, sf):
    return rows.rename_concepts(read(spark, sf, "customer").select("c_custkey", "c_acctbal"), {"balance": "c_acctbal", "other": "none"})


@query("prj4_resolver", "SELECT p.p_partkey, min(n.n_name) AS found FROM part p LEFT JOIN nation n ON contains(lower(n.n_name), lower(substr(p.p_name, 1, 2))) GROUP BY 1")
def prj4_resolver(spark, sf):
    """PRJ4: the first name in order that holds the text literally; datasets are called as nations are, texts come from parts."""
    known = [r["n_name"] for r in read(spark, sf, "nation").select("n_name").collect()]
    parts = read(spark, sf, "part").select("p_partkey", F.substring("p_name", 1, 2).alias("wanted"))
    wanted = [r["wanted"] for r in parts.select("wanted").distinct().limit(26**2 * 4).collect()]  # two letters
    found = named(spark, [(w, rows.resolve(w, known)) for w in wanted], "wanted string, found string")
    return parts.join(F.broadcast(found), "wanted").select("p_partkey", "found")


@query("prj5_resolve_all", "SELECT r_name AS region, n_name AS found FROM region JOIN nation ON contains(lower(n_name), lower(substr(r_name, 1, 1)))")
def prj5_resolve_all(spark, sf):
    """PRJ5: all names that hold the text."""
    known = [r["n_name"] for r in read(spark, sf, "nation").select("n_name").collect()]
    return named(spark, [(r["r_name"], n) for r in read(spark, sf, "region").collect() for n in rows.resolve_all(r["r_name"][:1], known)], "region string, found string")


@query("prj9_membership", "SELECT p_partkey, CASE WHEN p_size IN (1, 2, 5) THEN p_size END AS size FROM part")
def prj9_membership(spark, sf):
    return read(spark, sf, "part").select("p_partkey", numbers.only(F.col("p_size"), [1, 2, 5]).alias("size"))


@query("prj11_present", "SELECT unnest(['c_name', 'c_acctbal']) AS name, false AS void")
def prj11_present(spark, sf):
    """PRJ11, PRJ13."""
    c = read(spark, sf, "customer")
    return named(spark, [(n, rows.is_void(c)) for n in rows.present(c, ["c_name", "none", "c_acctbal"])], "name string, void boolean")


# ---- scalar functions


@query("scl2_scrub_number", "SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN CAST(o_custkey AS DOUBLE) WHEN 2 THEN 1500.0 END AS v FROM orders")
def scl2_scrub_number(spark, sf):
    o = read(spark, sf, "orders")
    k = F.col("o_orderkey") % 4
    raw = F.when(k == 0, F.col("o_custkey").cast("string")).when(k == 1, F.concat(F.col("o_custkey").cast("string"), F.lit("d"))).when(k == 2, " 1.5e3 ").otherwise("NaN")
    return o.select("o_orderkey", raw.alias("raw")).select("o_orderkey", numbers.scrub_number(F.col("raw"), T.StringType()).alias("v"))


@query("scl8_date_like", "SELECT o_orderkey, o_orderkey % 4 < 3 AS is_date FROM orders")
def scl8_date_like(spark, sf):
    o, d = read(spark, sf, "orders"), F.col("o_orderdate")
    k = F.col("o_orderkey") % 4
    raw = F.when(k == 0, F.date_format(d, "yyyy-MM-dd")).when(k == 1, F.date_format(d, "M/d/yy")).when(k == 2, F.date_format(d, "yyyy-MM-dd'T'HH:mm:ss'Z'")).otherwise(F.date_format(d, "d.M.yyyy"))
    return o.select("o_orderkey", dates.looks_like_date(raw).alias("is_date"))


@query("scl10_abbreviations", "SELECT n_nationkey, 'hhc ' || replace(lower(n_name), '_', ' ') || ' cxr household contact chest x ray' AS t FROM nation")
def scl10_abbreviations(spark, sf):
    return read(spark, sf, "nation").select("n_nationkey", text.expand(F.concat(F.lit("HHC "), "n_name", F.lit("-CXR"))).alias("t"))


@query("scl11_variants", "SELECT n_nationkey, n_nationkey % 4 <> 3 AS has FROM nation")
def scl11_variants(spark, sf):
    """SCL11: a term under its other names."""
    n = read(spark, sf, "nation")
    raw = F.element_at(F.array(*map(F.lit, ("hhc visit", "a household", "hh size", "home"))), (F.col("n_nationkey") % 4 + 1).cast("int"))
    return n.select("n_nationkey", text.has_term(raw, "household").alias("has"))


@query("scl15_form_id", "SELECT n_nationkey, CASE WHEN n_nationkey % 2 = 0 THEN n_name ELSE '' END AS id FROM nation")
def scl15_form_id(spark, sf):
    raw = F.when(F.col("n_nationkey") % 2 == 0, F.concat("n_name", F.lit("  Form v2.pdf"))).otherwise(F.concat("n_name", F.lit(".pdf")))
    return read(spark, sf, "nation").select("n_nationkey", text.form_id(raw).alias("id"))


@query("scl16_labels", "SELECT c_custkey, CASE c_nationkey % 3 WHEN 1 THEN 'Male' WHEN 0 THEN 'Female' ELSE 'Unknown' END AS sex FROM customer")
def scl16_labels(spark, sf):
    return read(spark, sf, "customer").select("c_custkey", numbers.sex_label(F.col("c_nationkey") % 3).alias("sex"))


@query("scl17_odds_ratio", "SELECT c_custkey, round(exp(c_acctbal / 10000), 6) AS small, c_acctbal > ln(1.7976931348623157e308) AS overflows FROM customer")
def scl17_odds_ratio(spark, sf):
    c = read(spark, sf, "customer")
    return c.select("c_custkey", F.round(numbers.odds_ratio(F.col("c_acctbal") / 10000), 6).alias("small"), F.isnan(numbers.odds_ratio(F.col("c_acctbal"))).alias("overflows"))


@query("scl20_markers", "SELECT n_nationkey, n_name || '   done' AS t FROM nation")
def scl20_markers(spark, sf):
    return read(spark, sf, "nation").select("n_nationkey", text.strip_markers(F.concat("n_name", F.lit(" [[x 1]] /data/a_b/c.json done "))).alias("t"))


@query("scl21_sources", "SELECT n_nationkey, ['a', n_name] AS sources FROM nation")
def scl21_sources(spark, sf):
    raw = F.concat(F.lit('{"dataset": "a", "form_name" : "'), "n_name", F.lit('", "x": [{"dataset":"a"}]}'))
    return read(spark, sf, "nation").select("n_nationkey", text.quoted_sources(raw).alias("sources"))


@query("scl22_deidentified_names", "SELECT n_nationkey, CASE n_nationkey % 4 WHEN 0 THEN [n_name] WHEN 1 THEN CASE WHEN n_nationkey % 8 = 1 THEN ['N1'] ELSE [] END WHEN 2 THEN [n_name || '_PSEUDO', n_name || '_PRESENT'] ELSE [] END AS names FROM nation")
def scl22_deidentified_names(spark, sf):
    k = F.col("n_nationkey") % 4
    kind = F.when(k == 0, "").when(k == 1, "date").when(k == 2, "id").otherwise("free text")
    suggested = F.when(F.col("n_nationkey") % 8 == 1, "N1")
    return read(spark, sf, "nation").select("n_nationkey", catalogue.deidentified_names(F.col("n_name"), kind, suggested).alias("names"))


@query("scl23_relative_age", """
WITH e AS (SELECT event_id, CASE WHEN event_id % 50 = 0 THEN NULL ELSE CAST(epoch(TIMESTAMP '2024-01-03 00:00:00') - floor(epoch(ts)) AS BIGINT) END AS s FROM events)
SELECT event_id, CASE WHEN s IS NULL THEN '' WHEN s < 60 THEN 'just now' WHEN s < 3600 THEN s // 60 || 'm ago' WHEN s < 86400 THEN s // 3600 || 'h ago' ELSE s // 86400 || 'd ago' END AS age FROM e""")
def scl23_relative_age(spark, sf):
    ts = F.when(F.col("event_id") % 50 != 0, F.col("ts"))
    return read(spark, sf, "events").select("event_id", text.relative_age(ts, F.lit("2024-01-03 00:00:00").cast("timestamp")).alias("age"))


# ---- de-identification and gates


@query("dei3_birthdate", "SELECT o_orderkey, CAST(NULL AS VARCHAR) AS BIRTHDAT FROM orders")
def dei3_birthdate(spark, sf):
    """DEI3: under safe harbour a date of birth is dropped."""
    o = read(spark, sf, "orders").select("o_orderkey", F.col("o_custkey").cast("string").alias("SUBJID"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("BIRTHDAT"))
    out = deid.scrub(o, deid.Rules(birthdate=("BIRTH",), dates=("DAT$",)), TEST_KEY)
    return out.select("o_orderkey", F.lit(None if "BIRTHDAT" not in out.columns else "kept").cast("string").alias("BIRTHDAT"))


@query("dei3_birthdate_limited", _QUERY_SQL["dei8_date_shift"].replace("AS shifted", "AS BIRTHDAT"))
def dei3_birthdate_limited(spark, sf):
    """DEI3: in a limited data set a date of birth moves with the subject's other dates."""
    o = read(spark, sf, "orders").select("o_orderkey", F.col("o_custkey").cast("string").alias("SUBJID"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("BIRTHDAT"))
    rules = deid.Rules(birthdate=("BIRTH",), posture=deid.LIMITED, authority="board 7")
    return deid.scrub(o, rules, TEST_KEY).select("o_orderkey", "BIRTHDAT")


@query("dei13_key", _QUERY_SQL["dei9_pseudonyms"].replace("SELECT c_custkey,", "SELECT c_custkey, true AS made, true AS refused,"))
def dei13_key(spark, sf):
    """DEI13: pseudonyms by a key that is read from its owner's file; one that others can read is refused, a new one is made once."""
    home = tempfile.mkdtemp(prefix="lakecohort-")
    path, refused = os.path.join(home, "key"), False
    with os.fdopen(os.open(path, os.O_WRONLY | os.O_CREAT, 0o600), "w") as f:
        f.write(TEST_KEY.hex())
    key = deid.load_key(path)
    os.chmod(path, 0o644)
    try:
        deid.load_key(path)
    except PermissionError:
        refused = True
    new = os.path.join(home, "new")
    made = deid.load_key(new, create=True) == deid.load_key(new) != key
    c = keyed.with_key(read(spark, sf, "customer"), key)
    return c.select("c_custkey", F.lit(made).alias("made"), F.lit(refused).alias("refused"), keyed.pseudonym(F.col("c_custkey"), "SUBJ").alias("subject"), keyed.pseudonym(F.col("c_custkey"), "FAM").alias("family"))


@query("phi10_mask", "SELECT c_custkey, 'id [REDACTED], ' || repeat('x', 470) AS t FROM customer")
def phi10_mask(spark, sf):
    """PHI10: cut, then every hit as one mark."""
    raw = F.concat(F.lit("id 123-45-6789, "), F.repeat(F.lit("x"), 470), F.repeat(F.lit("y"), 14))
    return read(spark, sf, "customer").select("c_custkey", F.regexp_replace(phi.mask_event(raw), "y+$", "").alias("t"))


@query("phi11_return_gate", f"SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN '{phi.REFUSAL}' ELSE c_mktsegment END AS t FROM customer")
def phi11_return_gate(spark, sf):
    raw = F.when(F.col("c_custkey") % 2 == 0, F.concat("c_mktsegment", F.lit(" a.b@c.org"))).otherwise(F.col("c_mktsegment"))
    return read(spark, sf, "customer").select("c_custkey", phi.gated_text(raw).alias("t"))


@query("phi16_redact_leaves", "SELECT c_custkey AS k, ['<EMAIL>', c_mktsegment] AS a, '<IP>' AS b FROM customer")
def phi16_redact_leaves(spark, sf):
    """PHI16: texts within arrays, structs and maps."""
    c = read(spark, sf, "customer")
    nested = F.struct(F.array(F.concat(F.lit("u"), F.col("c_custkey").cast("string"), F.lit("@x.org")), F.col("c_mktsegment")).alias("a"), F.create_map(F.lit("b"), F.lit("10.1.2.3")).alias("m"))
    return phi.redact_leaves(c.select(F.col("c_custkey").alias("k"), nested.alias("n"))).select("k", "n.a", F.col("n.m")["b"].alias("b"))


@query("phi17_assert_clean", "SELECT c_custkey, c_mktsegment FROM customer")
def phi17_assert_clean(spark, sf):
    return phi.assert_clean(read(spark, sf, "customer").select("c_custkey", "c_mktsegment"), "c_mktsegment")


# ---- duplicates, orders, statistics, surface


@query("set2_same_schema", "SELECT true AS same, false AS other")
def set2_same_schema(spark, sf):
    a, b = read(spark, sf, "nation"), read(spark, sf, "region")
    return named(spark, [(dedup.same_schema(a, a.select(*reversed(a.columns))), dedup.same_schema(a, b))], "same boolean, other boolean")


@query("set4_junk", "SELECT n_name AS dataset, count(*) AS records FROM nation JOIN customer ON c_nationkey = n_nationkey WHERE n_name NOT IN ('FRANCE', 'CHINA') GROUP BY 1")
def set4_junk(spark, sf):
    """SET4: datasets (a nation's customers each) without the junk ones."""
    kept = dedup.without_junk([r["n_name"] for r in read(spark, sf, "nation").select("n_name").collect()], ("FRANCE", "CHINA", "none"))
    c = read(spark, sf, "customer").join(read(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return c.filter(F.col("n_name").isin(kept)).groupBy(F.col("n_name").alias("dataset")).agg(F.count("*").alias("records"))


@query("set9_surviving_names", "SELECT unnest(['n_nationkey', 'n_name', 'n_regionkey', 'r_regionkey', 'r_name']) AS name, 'gone' AS dropped")
def set9_surviving_names(spark, sf):
    """SET9, JN10: names that any table still has, and dropped ones that none has."""
    frames = {"n": read(spark, sf, "nation").withColumn("_provenance", F.lit(1)), "r": read(spark, sf, "region")}
    events = [dedup.ColumnEvent("GONE", None, "entirely null"), dedup.ColumnEvent("N_Name", None, "entirely null")]
    (gone,) = dedup.dropped_names(events, frames)
    return named(spark, [(n, gone) for n in sorted(dedup.surviving_names(frames))], "name string, dropped string")


def _parts(spark, sf) -> DataFrame:
    return read(spark, sf, "part").select(F.concat(F.lit("V_"), F.col("p_partkey").cast("string")).alias("variable_name"), F.col("p_name").alias("description"), F.col("p_type").alias("form_name"), (F.col("p_partkey") % 3 == 0).alias("is_phi"))


@query("srt4_best_form", "SELECT 'V_' || p_partkey AS variable_name, p_type AS form_name FROM part WHERE p_type = (SELECT min(p_type) FROM part WHERE lower(p_type) LIKE '%economy%')")
def srt4_best_form(spark, sf):
    """SRT4, API5."""
    return catalogue.best_form(_parts(spark, sf), "economy").select("variable_name", "form_name")


def _study(spark, sf) -> api.Study:
    return api.Study(spark, {"customer": read(spark, sf, "customer")}, _parts(spark, sf), quasi=("c_mktsegment",))


@query("api3_variable_details", "SELECT 'V_' || p_partkey AS variable_name, p_name AS description FROM part WHERE p_partkey = 12")
def api3_variable_details(spark, sf):
    return _study(spark, sf).get_variable_details("v_12").select("variable_name", "description")


@query("api6_query_dataset", "SELECT c_custkey, c_mktsegment FROM customer WHERE c_mktsegment = 'BUILDING' ORDER BY c_custkey LIMIT 7")
def api6_query_dataset(spark, sf):
    """API6: its limit is the feature."""
    return _study(spark, sf).query_dataset("CUSTOM", "c_custkey, c_mktsegment", "c_mktsegment", "building", 7)


@query("api9_run_sql", "SELECT c_mktsegment AS segment, count(*) AS n, round(avg(c_acctbal), 4) AS mean FROM customer WHERE c_acctbal > 0 GROUP BY 1")
def api9_run_sql(spark, sf):
    """API9: a checked statement in place of code."""
    return _study(spark, sf).run_sql("SELECT c_mktsegment AS segment, count(*) AS n, round(avg(c_acctbal), 4) AS mean FROM df_customer WHERE c_acctbal > 0 GROUP BY c_mktsegment")


@query("api10_cross_reference", "SELECT variable_name, description FROM (SELECT 'V_' || p_partkey AS variable_name, p_name AS description, p_type FROM part) WHERE contains(variable_name, 'V_1') ORDER BY variable_name, p_type LIMIT 20")
def api10_cross_reference(spark, sf):
    """API10, LIM2: the cap on definitions is the feature."""
    return _study(spark, sf).cross_reference_variables("v_1")[0].select("variable_name", "description")


@query("api10_completeness", "SELECT 'customer' AS dataset, CAST(count(*) AS VARCHAR) AS records, CAST(count(*) AS VARCHAR) AS populated, '100.0' AS percent FROM customer")
def api10_completeness(spark, sf):
    return _study(spark, sf).cross_reference_variables("c_acct")[1]


_EVENTS = "WITH e AS (SELECT c_nationkey AS nation, sum((c_acctbal < 0)::INT)::BIGINT AS n FROM customer GROUP BY 1)"


def _events_by_nation(spark, sf):
    return read(spark, sf, "customer").groupBy(F.col("c_nationkey").alias("nation")).agg(F.sum((F.col("c_acctbal") < 0).cast("long")).alias("n")).collect()  # 25 rows


@query("st7_caveats", f"{_EVENTS} SELECT nation, n, CASE WHEN n < {stats.LOW} THEN 2 ELSE 1 END AS notes, n < {stats.SEVERE} AS severe FROM e")
def st7_caveats(spark, sf):
    """ST7: notes by each nation's events, and one for each column with gaps."""
    found = [(r["nation"], r["n"], stats.caveats(r["n"], ["a"])) for r in _events_by_nation(spark, sf)]
    return named(spark, [(k, n, len(c), "not reliable" in c[0]) for k, n, c in found], "nation long, n long, notes int, severe boolean")


@query("st13_underpowered", f"{_EVENTS} SELECT nation, n < {stats.SEVERE} OR n / 6.0 < 5 AS six, n < {stats.SEVERE} OR n < 5 AS none FROM e")
def st13_underpowered(spark, sf):
    """ST13: of each nation's events."""
    return named(spark, [(r["nation"], stats.underpowered(r["n"]), stats.underpowered(r["n"], 0)) for r in _events_by_nation(spark, sf)], "nation long, six boolean, none boolean")


@query("st14_plot_routing", """
WITH p AS (SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN 'sex' WHEN 1 THEN 'bmi' WHEN 2 THEN 'other' ELSE 'age' END AS predictor, CASE WHEN p_partkey % 2 = 0 THEN 'scatter' END AS wanted FROM part)
SELECT p_partkey, predictor, CASE predictor WHEN 'sex' THEN 'violin' WHEN 'other' THEN NULL ELSE 'scatter' END AS kind, predictor = 'sex' AND wanted IS NOT NULL AS noted FROM p""")
def st14_plot_routing(spark, sf):
    """ST14: the plot that fits a predictor's scale, and a note where another was wanted."""
    predictor = F.element_at(F.array(*map(F.lit, ("sex", "bmi", "other", "age"))), (F.col("p_size") % 4 + 1).cast("int"))
    p = read(spark, sf, "part").select("p_partkey", predictor.alias("predictor"), F.when(F.col("p_partkey") % 2 == 0, "scatter").alias("wanted"))
    asked = p.select("predictor", "wanted").distinct().collect()  # eight rows
    routes = named(spark, [(r["predictor"], r["wanted"], *(lambda k, note: (k, bool(note)))(*stats.plot_kind(r["predictor"], r["wanted"]))) for r in asked], "q string, w string, kind string, noted boolean")
    return p.join(F.broadcast(routes), (F.col("predictor") == F.col("q")) & F.col("wanted").eqNullSafe(F.col("w"))).select("p_partkey", "predictor", "kind", "noted")


@query("st10_plot_points", "SELECT quality AS x, toxic AS outcome, true AS near FROM labels WHERE quality IS NOT NULL AND toxic IS NOT NULL")
def st10_plot_points(spark, sf):
    """ST10: points near their outcome."""
    points = stats.plot_data(read(spark, sf, "labels"), "toxic", "quality")
    return points.select("x", "outcome", (F.abs(F.col("y") - F.col("outcome")) < 0.5).alias("near"))


@query("st10_violin_density", """
WITH s AS (SELECT lang, count(n_chars) AS n, min(n_chars) AS lo, max(n_chars) AS hi, stddev_samp(n_chars) * count(n_chars) ** -0.2 AS h FROM documents WHERE lang IS NOT NULL GROUP BY 1 HAVING stddev_samp(n_chars) > 0),
g AS (SELECT *, unnest(range(64)) AS point FROM s), p AS (SELECT *, lo + (hi - lo) * point / 63 AS x FROM g)
SELECT p.lang, CAST(point AS INTEGER) AS point, round(x, 6) AS x, round(1000 * sum(exp(-0.5 * ((x - n_chars) / h) ** 2)) / any_value(n * h * sqrt(2 * pi())), 6) AS density FROM p JOIN documents d ON d.lang = p.lang WHERE n_chars IS NOT NULL GROUP BY 1, 2, 3""")
def st10_violin_density(spark, sf):
    """ST10: kernel densities on a grid, by aggregation."""
    found = plots.density(read(spark, sf, "documents"), "n_chars", ["lang"])
    return found.select("lang", "point", F.round("x", 6).alias("x"), F.round(1000 * F.col("density"), 6).alias("density"))


_U = "(CAST('0x' || substr(md5('toxic|quality:' || doc_id), {at}, 13) AS BIGINT) + 0.5::DOUBLE) / 16.0::DOUBLE ** 13"


@query("st10_jittered_points", f"SELECT doc_id AS key, quality AS x, round(toxic + {plots.JITTER} * sqrt(-2 * ln({_U.format(at=1)})) * cos(2 * pi() * ({_U.format(at=14)})), 6) AS y, toxic AS outcome FROM labels WHERE quality IS NOT NULL AND toxic IS NOT NULL AND doc_id IS NOT NULL")
def st10_jittered_points(spark, sf):
    """ST10: points moved by what their key says, the same in every run."""
    return plots.points(read(spark, sf, "labels"), "toxic", "quality", "doc_id").withColumn("y", F.round("y", 6))


_Z2 = stats.Z**2


@query("st10_interaction_rates", f"""
WITH r AS (SELECT d.lang AS factor, l.quality AS moderator, count(*) AS n, avg(l.toxic) AS p FROM labels l JOIN documents d USING (doc_id) WHERE l.toxic IS NOT NULL AND l.quality IS NOT NULL AND d.lang IS NOT NULL GROUP BY 1, 2 HAVING count(*) >= 5),
w AS (SELECT *, (p + {_Z2} / (2 * n)) / (1 + {_Z2} / n) AS middle, {stats.Z} * sqrt(p * (1 - p) / n + {_Z2} / (4 * n * n)) / (1 + {_Z2} / n) AS half FROM r)
SELECT factor, moderator, n, round(p, 6) AS rate, round(greatest(middle - half, 0), 6) AS low, round(least(middle + half, 1), 6) AS high FROM w""")
def st10_interaction_rates(spark, sf):
    """ST10: rates of the pairs of two predictors."""
    rows_ = read(spark, sf, "labels").join(read(spark, sf, "documents").select("doc_id", "lang"), "doc_id")
    return plots.rates(rows_, "toxic", "lang", "quality").withColumns({c: F.round(c, 6) for c in ("rate", "low", "high")})


@query("scl19_small_talk", "SELECT conv_id, turn, turn % 4 <> 3 AS small FROM conversations")
def scl19_small_talk(spark, sf):
    """SCL19: greetings and what is too short."""
    k = F.col("turn") % 4
    said = F.when(k == 0, " Thank you!! ").when(k == 1, "ok").when(k == 2, "Hello, 1").otherwise(F.concat(F.lit("which forms hold "), "text"))
    return read(spark, sf, "conversations").select("conv_id", "turn", text.is_small_talk(said).alias("small"))


@query("gov9_ingest", "SELECT c_custkey % 100 AS k, CAST(c_nationkey AS VARCHAR) AS nation, 0 AS code, true AS skipped_again, 1 AS broken_code FROM customer")
def gov9_ingest(spark, sf):
    """GOV1, GOV8, GOV9, DEI11: files read, cleaned, scrubbed and published; the same run again is skipped, one without subjects fails."""
    path = local(folder(spark))
    rules, c = deid.Rules(drop=("NAME",), ids=(("^SUBJID$", "SUBJ"),)), read(spark, sf, "customer")
    made = c.select(F.col("c_custkey").alias("SUBJID"), (F.col("c_custkey") % 100).alias("K"), F.col("c_name").alias("NAME"), F.concat(F.lit("n"), F.col("c_nationkey").cast("string")).alias("NATION"), F.concat(F.lit("n"), F.col("c_nationkey").cast("string")).alias("NATION_2"))
    _handed_over(made, f"{path}/in/visits.csv")
    _handed_over(made.withColumn("SUBJID", F.lit(None).cast("string")), f"{path}/bad/visits.csv")
    first, again = (runs.ingest(spark, f"{path}/in", f"{path}/out", rules, TEST_KEY) for _ in range(2))
    broken = runs.ingest(spark, f"{path}/bad", f"{path}/none", rules, TEST_KEY)
    out = runs.table(spark, f"{path}/out", "visits")
    assert set(out.columns) == {"SUBJID", "K", "NATION", deid.MARKER, "_provenance"}
    return out.select(F.col("K").cast("long").alias("k"), F.substring("NATION", 2, 9).alias("nation"), F.lit(first["code"]).alias("code"), F.lit(again["skipped"]).alias("skipped_again"), F.lit(broken["code"]).alias("broken_code"))


@query("gov9_ingest_ledger", """
WITH o AS (SELECT *, row_number() OVER (ORDER BY o_orderkey) - 1 AS place FROM orders), g AS (SELECT * FROM o WHERE o_orderkey % 11 <> 0)
SELECT 'published visits' AS part, CAST(o_orderkey AS VARCHAR) AS name, place AS n FROM g
UNION ALL SELECT 'quarantined visits', CAST(o_orderkey AS VARCHAR), place FROM o WHERE o_orderkey % 11 = 0
UNION ALL SELECT 'published labs', CAST(c_custkey AS VARCHAR), row_number() OVER (ORDER BY c_custkey) - 1 FROM customer
UNION ALL SELECT 'manifest visits', unnest(['read', 'quarantined', 'rows']), unnest([(SELECT count(*) FROM o), (SELECT count(*) FROM o WHERE o_orderkey % 11 = 0), (SELECT count(*) FROM g)])
UNION ALL SELECT 'manifest labs', unnest(['read', 'quarantined', 'rows']), unnest([(SELECT count(*) FROM customer), 0, (SELECT count(*) FROM customer)])
UNION ALL SELECT 'audit visits', unnest(['phi-scrub-id SUBJID', 'phi-scrub-date VISDAT', 'phi-scrub-cap PRICE', 'phi-scrub-drop CLERK']), unnest([(SELECT count(*) FROM g), (SELECT count(*) FROM g), (SELECT count(*) FROM g WHERE o_totalprice > 300000), (SELECT count(*) FROM g)])
UNION ALL SELECT 'audit labs', 'phi-scrub-id SUBJID', count(*) FROM customer
UNION ALL SELECT 'cleaning', unnest(['visits KEY_2 identical', 'visits NOTE2 entirely null', 'labs_old subset', 'scratch junk']), 1
UNION ALL SELECT 'generations', unnest(['whole', 'skipped again', 'after a failure', 'without labs']), unnest([2, 1, 2, 1])""")
def gov9_ingest_ledger(spark, sf):
    """DEI10, DEI12, SNK4, SET3, SET4, SET5, GOV1, GOV2, GOV5, SNK6 within GOV9: several tables in one run, each read by one plan; what is published, quarantined, counted and said of it.

    Then the same again (skipped), one whose orphans are too many (the first generation stays whole) and one of fewer files (their tables go).
    """
    path = local(folder(spark))
    rules = deid.Rules(drop=("CLERK",), dates=("DAT$",), cap=(("PRICE", 300000, "300000+"),), ids=(("^SUBJID$", "SUBJ"),), orphan_threshold=10**12)
    o, c = read(spark, sf, "orders"), read(spark, sf, "customer")
    visits = o.orderBy("o_orderkey").select(
        F.when(F.col("o_orderkey") % 11 != 0, F.col("o_custkey")).alias("SUBJID"), F.col("o_orderkey").alias("KEY"), F.col("o_orderkey").alias("KEY_2"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("VISDAT"),
        F.col("o_totalprice").cast("double").alias("PRICE"), F.lit("x").alias("CLERK"), F.lit("n").alias("NOTE"), F.lit(None).cast("string").alias("NOTE2"),
    )
    labs = c.orderBy("c_custkey").select(F.col("c_custkey").alias("SUBJID"), F.col("c_acctbal").cast("double").alias("HB"), F.col("c_custkey").alias("AT"))
    for name, df in (("visits", visits), ("labs", labs), ("labs_old", labs.filter("AT % 3 = 0")), ("scratch", labs.limit(3))):
        _handed_over(df, f"{path}/in/{name}.csv")
    _handed_over(visits, f"{path}/fewer/visits.csv")
    run = lambda source, r=rules: runs.ingest(spark, source, f"{path}/out", r, TEST_KEY, pairs=[("labs", "labs_old")], junk=("scratch",))
    first = run(f"{path}/in")
    assert first["code"] == 0, first
    store = generations.Folder(spark, f"{path}/out")
    made, again, failed = store.generation(), run(f"{path}/in"), run(f"{path}/in", replace(rules, orphan_threshold=0))
    after = sum(store.generation().drill().values())
    assert failed["failed"] == "quarantine" and "allowed" in failed["error"]
    told = made.manifest()
    rows = [(f"manifest {t}", k, v[k]) for t, v in told["tables"].items() for k in ("read", "quarantined", "rows")]
    rows += [(f"audit {e['dataset']}", f"{e['scope']} {e['field']}", e["events"]) for e in told["audit"]]
    rows += [("cleaning", " ".join(filter(None, (e.get("dataset") or e.get("dropped"), e.get("column"), e["reason"]))), 1) for e in told["cleaning"]]
    rows += [("generations", "whole", sum(made.drill().values())), ("generations", "skipped again", int(again["skipped"])), ("generations", "after a failure", after)]
    assert run(f"{path}/fewer")["code"] == 0
    rows.append(("generations", "without labs", len(store.manifest()["tables"])))
    assert not store.has("labs") and store.published()[0] == made.name
    out = named(spark, rows, "part string, name string, n long")
    published = [made.table(t).select(F.lit(f"published {t}").alias("part"), F.col(k).cast("string").alias("name"), F.col("_provenance.row_index").alias("n")) for t, k in (("visits", "KEY"), ("labs", "AT"))]
    held = spark.read.parquet(f"{made.quarantine}/visits").select(F.lit("quarantined visits").alias("part"), F.col("KEY").alias("name"), F.col("row_index").alias("n"))
    return out.unionByName(published[0]).unionByName(published[1]).unionByName(held)


def _handed_over(df: DataFrame, path: str) -> None:
    """A table as a CSV folder of this name, a part for each task."""
    df.write.option("header", True).csv(path)


@query("gov5_snapshots", "SELECT n_nationkey FROM nation")
def gov5_snapshots(spark, sf):
    """GOV5: a table changed after it was saved, and restored."""
    path, n = folder(spark), read(spark, sf, "nation").select("n_nationkey")
    n.write.parquet(f"{path}/t")
    runs.save_snapshot(spark, f"{path}/t", f"{path}/store", "one")
    sinks.write_staged(n.filter("n_nationkey = 0"), f"{path}/t", "parquet")
    runs.restore_snapshot(spark, f"{path}/store", "one", f"{path}/t")
    return spark.read.parquet(f"{path}/t")
