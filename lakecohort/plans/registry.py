"""The registered queries and the SQL they are compared with.

Names begin with the operator that they cover. The key below is for tests only: SQL has to show it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakecohort.functions import dates, keyed, numbers, phi, text
from lakecohort.operators import catalogue, conversations, dedup, deid, privacy, rows, stats, summaries
from lakecohort.plans import knowledge
from lakecohort.sources import files, sinks

TEST_KEY = bytes(range(32))
_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        _QUERIES[name] = f
        if sql:
            _SQL[name] = sql
        return f

    return add


def _all() -> None:
    from lakecohort.plans import coverage  # noqa: F401  registers its queries


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _all()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _all()
    return dict(_SQL)


def read(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _hmac(message: str) -> str:
    """HMAC-SHA256 of a text expression in DuckDB."""
    inner, outer = (p.hex() for p in keyed.pads(TEST_KEY))
    return f"sha256(unhex('{outer}') || unhex(sha256(unhex('{inner}') || encode({message}))))"


def _pseudonym(value: str, label: str) -> str:
    return f"'{label}_' || substr({_hmac(f"'{label}:' || {value}")}, 1, 12)"


def _offset(value: str) -> str:
    return f"(('0x' || substr({_hmac(value)}, 1, 8))::BIGINT % 61 - 30)"


# ---- sources and sinks


@query("src4_events_json", "SELECT event_id, json_extract_string(props, '$.' || k) AS value, k AS name FROM (SELECT event_id, props, unnest(json_keys(props)) AS k FROM events)")
def src4_events_json(spark, sf):
    """SRC4-6: JSON text parsed without a fixed schema."""
    lines = files.parse_lines(read(spark, sf, "events").select("event_id", "props"), "props", "map<string,string>")
    return lines.select("event_id", F.explode("parsed").alias("name", "value"))


@query("src8_strips", """
WITH t AS (SELECT c_custkey AS row_index, CASE WHEN c_custkey % 7 <> 0 THEN c_name END AS v FROM customer),
g AS (SELECT *, sum(CASE WHEN v IS NULL THEN 1 ELSE 0 END) OVER (ORDER BY row_index) AS gap FROM t)
SELECT row_index, v, CAST(dense_rank() OVER (ORDER BY gap) AS INTEGER) AS strip FROM g WHERE v IS NOT NULL""")
def src8_strips(spark, sf):
    """SRC8: strips of one sheet that empty rows part (a sheet is bounded)."""
    sheet = read(spark, sf, "customer").select(F.col("c_custkey").alias("row_index"), F.when(F.col("c_custkey") % 7 != 0, F.col("c_name")).alias("v"))
    return files.strips(sheet)


@query("src12_label_descriptions", """
WITH l AS (SELECT o_orderkey AS k, ['STATUS: order is ' || o_orderstatus, 'PRIORITY: ' || o_orderpriority, 'not a label', 'PRICE: ' || CAST(CAST(o_totalprice AS BIGINT) AS VARCHAR) || ' in all'] AS a FROM orders WHERE o_orderkey % 2 = 0)
SELECT k, unnest(['STATUS', 'PRIORITY', 'PRICE']) AS variable, unnest(['order is ' || o_orderstatus, o_orderpriority, CAST(CAST(floor(o_totalprice) AS BIGINT) AS VARCHAR) || ' in all']) AS description
FROM (SELECT o_orderkey AS k, * FROM orders WHERE o_orderkey % 2 = 0)""")
def src12_label_descriptions(spark, sf):
    """SRC12: LABEL: description lines of texts with three labels at least; odd orders have two."""
    o = read(spark, sf, "orders")
    price = F.concat(F.lit("PRICE: "), F.floor("o_totalprice").cast("string"), F.lit(" in all"))
    lines = F.concat_ws("\n", F.concat(F.lit("STATUS: order is "), "o_orderstatus"), F.concat(F.lit("PRIORITY: "), "o_orderpriority"), F.lit("not a label"), F.when(F.col("o_orderkey") % 2 == 0, price), F.lit("STATUS: a second time"))
    return files.label_descriptions(o.select(F.col("o_orderkey").alias("k"), lines.alias("t")), "k", "t")


@query("src13_tier_merge", """
SELECT coalesce(a.p_partkey, b.p_partkey) AS variable, coalesce(nullif(trim(a.d), ''), b.d) AS description
FROM (SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN '' ELSE p_name END AS d FROM part WHERE p_partkey % 2 = 0) a
FULL JOIN (SELECT p_partkey, p_type AS d FROM part WHERE p_partkey % 5 <> 0) b ON a.p_partkey = b.p_partkey""")
def src13_tier_merge(spark, sf):
    """SRC13: one source's fields first, the other's fill gaps."""
    p = read(spark, sf, "part")
    a = p.filter("p_partkey % 2 = 0").select(F.col("p_partkey").alias("variable"), F.when(F.col("p_partkey") % 3 == 0, "").otherwise(F.col("p_name")).alias("description"))
    b = p.filter("p_partkey % 5 <> 0").select(F.col("p_partkey").alias("variable"), F.col("p_type").alias("description"))
    return files.merge_tiers(a, b, ["description"])


@query("src17_schema_catalogue", "SELECT 'customer' AS dataset, unnest(['c_acctbal','c_custkey','c_mktsegment','c_name','c_nationkey']) AS variable_name, (SELECT count(*) FROM customer) AS records UNION ALL SELECT 'region', unnest(['r_name','r_regionkey']), (SELECT count(*) FROM region)")
def src17_schema_catalogue(spark, sf):
    return catalogue.schema_catalogue({n: read(spark, sf, n) for n in ("customer", "region")})


@query("snk4_provenance", "SELECT c_custkey, 'customer.csv' AS source_file, 'sheet1' AS sheet_name, c_custkey AS row_index FROM customer")
def snk4_provenance(spark, sf):
    made = sinks.with_provenance(read(spark, sf, "customer"), "customer.csv", "sheet1", "study", at="2024-01-01T00:00:00+00:00", order="c_custkey")
    return made.select("c_custkey", "source_file", "_provenance.sheet_name", "_provenance.row_index")


@query("agg21_file_digests")
def agg21_file_digests(spark, sf):
    """AGG21, SCL18: digests where the files are read; DuckDB's views hide the files."""
    return sinks.digests(spark, f"{sf}/nation.parquet")


# ---- projections, filters and orders


@query("prj1_query_dataset", "SELECT c_custkey, c_name, c_mktsegment FROM customer WHERE lower(c_mktsegment) = 'building' ORDER BY c_custkey LIMIT 20")
def prj1_query_dataset(spark, sf):
    """PRJ1, PRJ3, LIM1: the governed row query; its limit is the feature."""
    found = rows.filter_equal(read(spark, sf, "customer"), "c_mktsegment", "Building")
    return rows.project(rows.limited(found, "c_custkey"), "c_custkey, c_name, unknown, c_mktsegment")


@query("prj3_null_text", "SELECT doc_id FROM (SELECT d.doc_id, l.quality FROM documents d LEFT JOIN labels l USING (doc_id)) WHERE lower(coalesce(CAST(quality AS VARCHAR), 'none')) = 'none'")
def prj3_null_text(spark, sf):
    joined = read(spark, sf, "documents").select("doc_id").join(read(spark, sf, "labels").select("doc_id", "quality"), "doc_id", "left")
    return rows.filter_equal(joined, "quality", "None").select("doc_id")


@query("prj6_complete_rows", "SELECT d.doc_id, l.quality, l.toxic FROM documents d JOIN labels l USING (doc_id) WHERE l.quality IS NOT NULL AND l.toxic IS NOT NULL")
def prj6_complete_rows(spark, sf):
    joined = read(spark, sf, "documents").select("doc_id").join(read(spark, sf, "labels"), "doc_id", "left")
    return rows.complete(joined, ["quality", "toxic"])


@query("prj10_hidden_dates", "SELECT o_orderkey, '<DATE_SHIFTED>' AS d, o_orderpriority AS p FROM orders")
def prj10_hidden_dates(spark, sf):
    o = read(spark, sf, "orders").select("o_orderkey", dates.as_stored(F.col("o_orderdate")).alias("d"), F.col("o_orderpriority").alias("p"))
    return rows.hide_dates(o, ["d", "p"])


@query("prj14_conversation_search", "SELECT DISTINCT conv_id FROM conversations WHERE contains(lower(text), 'the')")
def prj14_conversation_search(spark, sf):
    return rows.search_conversations(read(spark, sf, "conversations"), " The ")


@query("prj15_named_rows", "SELECT p_partkey FROM part WHERE p_partkey % 4 <> 0")
def prj15_named_rows(spark, sf):
    named = F.when(F.col("p_partkey") % 4 == 0, F.when(F.col("p_partkey") % 8 == 0, "-----")).otherwise(F.col("p_name"))
    return rows.named_rows(read(spark, sf, "part").select("p_partkey", named.alias("n")), "n").select("p_partkey")


@query("win2_event_buckets", """
SELECT event_id, CASE WHEN d <= 0 THEN 'today' WHEN d = 1 THEN 'yesterday' WHEN d <= 7 THEN 'last7' WHEN d <= 30 THEN 'last30' ELSE 'older' END AS bucket
FROM (SELECT event_id, date_diff('day', CAST(ts AS DATE), (SELECT max(CAST(ts AS DATE)) FROM events)) AS d FROM events)""")
def win2_event_buckets(spark, sf):
    e = read(spark, sf, "events")
    now = e.agg(F.max(F.col("ts").cast("date")).alias("now"))
    return e.crossJoin(F.broadcast(now)).select("event_id", dates.bucket(F.col("ts"), F.col("now")).alias("bucket"))


@query("win3_age_bins", "SELECT p_partkey, CASE WHEN p_size > 0 AND p_size <= 25 THEN '(0, 25]' WHEN p_size > 25 AND p_size <= 45 THEN '(25, 45]' WHEN p_size > 45 AND p_size <= 100 THEN '(45, 100]' END AS bin FROM part")
def win3_age_bins(spark, sf):
    return read(spark, sf, "part").select("p_partkey", numbers.age_bin(F.col("p_size")).alias("bin"))


@query("srt5_newest_first", "SELECT conv_id, max(turn) AS last_turn, bool_or(role = 'system') AS pinned FROM conversations GROUP BY conv_id")
def srt5_newest_first(spark, sf):
    grouped = read(spark, sf, "conversations").groupBy("conv_id").agg(F.max("turn").alias("last_turn"), F.bool_or(F.col("role") == "system").alias("pinned"))
    return rows.newest_first(grouped, "pinned", "last_turn")


# ---- joins and the cohort

_COHORT = knowledge.Cohort(
    subject="subject",
    base="screening",
    joined=("baseline",),
    predictors={
        "age": knowledge.Predictor("screening", "age"),
        "sex": knowledge.Predictor("screening", "sex", "code", codes={"MALE": 1, "FEMALE": 0}),
        "smoking": knowledge.Predictor("baseline", "smoking", "binary", positive=("BUILDING", "MACHINERY"), negative=("FURNITURE", "HOUSEHOLD")),
        "weight": knowledge.Predictor("baseline", "weight"),
        "height": knowledge.Predictor("baseline", "height"),
        "hba1c": knowledge.Predictor("lab", "value"),
    },
    outcomes={"late": knowledge.Outcome("orders", "status", ("F",), "worst"), "priced": knowledge.Outcome("big", "status", ("F",), "any_positive", (("orders", "priority", ("1-URGENT",)),))},
    first_of={"lab": "row_index"},
)


def _frames(spark, sf) -> dict[str, DataFrame]:
    c, o = read(spark, sf, "customer"), read(spark, sf, "orders")
    subject = F.col("c_custkey").alias("subject")
    n = F.col("c_nationkey")
    return {
        "screening": c.select(subject, (n + 18).alias("age"), F.when(F.col("c_custkey") % 2 == 0, " Male").otherwise("female").alias("sex")),
        "baseline": c.select(subject, F.col("c_mktsegment").alias("smoking"), (40 + n * 2).cast("string").alias("weight"), F.when(F.col("c_custkey") % 10 != 0, (90 + n * 4)).alias("height")),
        "lab": o.select(F.col("o_custkey").alias("subject"), F.col("o_orderkey").alias("row_index"), F.when(F.col("o_orderkey") % 3 != 0, F.col("o_totalprice")).alias("value")),
        "orders": o.select(F.col("o_custkey").alias("subject"), F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority")),
        "big": o.filter("o_totalprice > 200000").select(F.col("o_custkey").alias("subject"), F.col("o_orderstatus").alias("status")),
    }


_BMI = "CASE WHEN b.height BETWEEN 100 AND 220 AND b.weight / power(b.height / 100.0, 2) BETWEEN 10 AND 60 THEN b.weight / power(b.height / 100.0, 2) END"
_COHORT_SQL = f"""
WITH b AS (SELECT c_custkey AS subject, c_nationkey + 18 AS age, CASE WHEN c_custkey % 2 = 0 THEN 1 ELSE 0 END AS sex, 40 + 2 * c_nationkey AS weight,
  CASE WHEN c_custkey % 10 <> 0 THEN 90 + 4 * c_nationkey END AS height,
  CASE WHEN c_mktsegment IN ('BUILDING', 'MACHINERY') THEN 1.0 WHEN c_mktsegment IN ('FURNITURE', 'HOUSEHOLD') THEN 0.0 END AS smoking FROM customer),
lab AS (SELECT o_custkey AS subject, arg_min(o_totalprice, o_orderkey) AS hba1c FROM orders WHERE o_orderkey % 3 <> 0 GROUP BY 1),
o AS (SELECT o_custkey AS subject, max(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) AS outcome FROM orders GROUP BY 1)
SELECT b.subject, o.outcome, CAST(b.age AS DOUBLE) AS age, b.sex, CAST(b.smoking AS DOUBLE) AS smoking, round({_BMI}, 6) AS bmi,
  CAST(CASE WHEN {_BMI} IS NOT NULL THEN CASE WHEN {_BMI} < 18.5 THEN 1 ELSE 0 END END AS DOUBLE) AS malnutrition, lab.hba1c
FROM b JOIN o USING (subject) LEFT JOIN lab USING (subject)"""


@query("jn4_cohort_outcome", _COHORT_SQL)
def jn4_cohort_outcome(spark, sf):
    """JN1, JN2, JN4, JN12, AGG1, AGG2, SCL1, SCL3-6, PRJ2, PRJ7-9, PRJ12: a cohort compiled to one plan."""
    built = knowledge.build(_COHORT, _frames(spark, sf), "late", ["age", "sex", "smoking", "bmi", "malnutrition", "hba1c"])
    return built.withColumn("bmi", F.round("bmi", 6))


@query("jn3_outcome_sources", """
WITH p AS (SELECT o_custkey AS subject, max(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) AS a FROM orders WHERE o_totalprice > 200000 GROUP BY 1),
m AS (SELECT o_custkey AS subject, max(CASE WHEN o_orderpriority = '1-URGENT' THEN 1 ELSE 0 END) AS b FROM orders GROUP BY 1)
SELECT c.c_custkey AS subject, coalesce(greatest(p.a, m.b), 0) AS outcome, CAST(c.c_nationkey + 18 AS DOUBLE) AS age
FROM customer c LEFT JOIN (p JOIN m USING (subject)) ON c.c_custkey = subject""")
def jn3_outcome_sources(spark, sf):
    """JN3, AGG3: a second source raises the outcome; subjects in it alone count as 0."""
    return knowledge.build(_COHORT, _frames(spark, sf), "priced", ["age"])


@query("jn5_subset", "SELECT true AS subset, false AS superset")
def jn5_subset(spark, sf):
    o = read(spark, sf, "orders")
    urgent = o.filter("o_orderpriority = '1-URGENT'")
    return spark.range(1).select(F.lit(dedup.is_subset(urgent, o)).alias("subset"), F.lit(dedup.is_subset(o, urgent)).alias("superset"))


@query("jn6_catalogue_merge", """
SELECT coalesce(d.n, f.n) AS variable_name, coalesce(nullif(trim(d.descr), ''), f.descr) AS description, coalesce(nullif(trim(d.form), ''), f.form) AS form_name,
  CASE WHEN d.n IS NULL THEN 'form' WHEN f.n IS NULL THEN 'dictionary' ELSE 'both' END AS source
FROM (SELECT 'V_' || p_partkey AS n, CASE WHEN p_partkey % 3 = 0 THEN ' ' ELSE p_name END AS descr, p_brand AS form FROM part WHERE p_partkey % 2 = 0) d
FULL JOIN (SELECT 'v_' || p_partkey AS n, p_type AS descr, 'f' AS form FROM part WHERE p_partkey % 5 <> 0) f ON upper(d.n) = upper(f.n)""")
def jn6_catalogue_merge(spark, sf):
    p = read(spark, sf, "part")
    kind = F.lit("text").alias("data_type")
    d = p.filter("p_partkey % 2 = 0").select(F.concat(F.lit("V_"), "p_partkey").alias("variable_name"), F.when(F.col("p_partkey") % 3 == 0, " ").otherwise(F.col("p_name")).alias("description"), F.col("p_brand").alias("form_name"), kind)
    f = p.filter("p_partkey % 5 <> 0").select(F.concat(F.lit("v_"), "p_partkey").alias("variable_name"), F.col("p_type").alias("description"), F.lit("f").alias("form_name"), kind)
    return catalogue.merge(d, f).drop("data_type")


@query("jn7_codelist_lookup", """
WITH c AS (SELECT o_orderstatus AS name, o_orderpriority AS code, arg_max(o_orderkey, o_orderkey) AS d FROM orders GROUP BY 1, 2)
SELECT o.o_orderkey, c.d AS descriptor FROM orders o JOIN c ON c.name = o.o_orderstatus AND c.code = o.o_orderpriority""")
def jn7_codelist_lookup(spark, sf):
    """JN7, AGG20: code lists as maps, looked up through a join on their name."""
    o = read(spark, sf, "orders")
    lists = summaries.codelists(o, "o_orderstatus", "o_orderpriority", "o_orderkey", "o_orderkey").withColumnRenamed("o_orderstatus", "name")
    coded = catalogue.with_codes(o.withColumnRenamed("o_orderstatus", "variable_name"), lists)
    return coded.select("o_orderkey", F.col("coded_options")[F.col("o_orderpriority")].alias("descriptor"))


@query("jn8_last_section", "SELECT 'f' || r AS form_name, 'v' || k AS variable, 's' || max(b) AS section FROM (SELECT c_nationkey % 5 AS r, c_custkey % 10 AS k, c_custkey % 3 AS b FROM customer) GROUP BY r, k")
def jn8_last_section(spark, sf):
    c = read(spark, sf, "customer").select((F.col("c_nationkey") % 5).alias("r"), (F.col("c_custkey") % 10).alias("k"), (F.col("c_custkey") % 3).alias("b")).distinct()
    s = c.groupBy("r", "b").agg(F.collect_set(F.concat(F.lit("v"), "k")).alias("variables"))
    entry_ = F.struct(F.concat(F.lit("s"), "b").alias("key"), F.struct(F.lit("").alias("context"), "variables").alias("value"))
    forms = s.groupBy(F.concat(F.lit("f"), "r").alias("form_name")).agg(F.map_from_entries(F.array_sort(F.collect_list(entry_))).alias("sections"))
    return catalogue.sections(forms).select("form_name", "variable", "section")


@query("jn9_prune_rows", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_partkey % 10 <> 0 OR l_linenumber = 1")
def jn9_prune_rows(spark, sf):
    """JN9, JN10: rows of dropped keys go, rows without a key stay."""
    gone = read(spark, sf, "part").filter("p_partkey % 10 = 0").select(F.concat(F.lit("P"), "p_partkey").alias("name"))
    lines = read(spark, sf, "lineitem").withColumn("key", F.when(F.col("l_linenumber") != 1, F.concat(F.lit("p"), "l_partkey")))
    return dedup.prune_rows(lines, "key", gone).select("l_orderkey", "l_linenumber")


@query("jn11_dataset_only", "SELECT p_name AS variable_name, 'catalogue' AS origin FROM part UNION ALL SELECT 'extra_' || s_suppkey, 'dataset' FROM supplier")
def jn11_dataset_only(spark, sf):
    known = read(spark, sf, "part").select(F.col("p_name").alias("variable_name"), F.lit("catalogue").alias("origin"))
    extra = read(spark, sf, "supplier").select(F.concat(F.lit("extra_"), "s_suppkey").alias("variable_name"), F.lit("dataset").alias("origin"))
    return catalogue.with_dataset_only(known, extra.unionByName(known.select(F.upper("variable_name").alias("variable_name"), F.lit("dataset").alias("origin"))))


@query("jn13_broken_dependencies", "SELECT p_brand AS form_name, 'V' || p_partkey AS variable_name, 'V' || (p_partkey + 1) AS depends_on FROM part p WHERE NOT EXISTS (SELECT 1 FROM part q WHERE q.p_brand = p.p_brand AND q.p_partkey = p.p_partkey + 1)")
def jn13_broken_dependencies(spark, sf):
    v = read(spark, sf, "part").select(F.col("p_brand").alias("form_name"), F.concat(F.lit("V"), "p_partkey").alias("variable_name"), F.concat(F.lit("V"), F.col("p_partkey") + 1).alias("depends_on"))
    return catalogue.broken_dependencies(v)


# ---- aggregates and privacy


@query("agg4_numeric_summary", """
SELECT l_returnflag, round(avg(l_quantity), 6) AS mean, round(stddev_samp(l_quantity), 6) AS std, median(l_quantity) AS median, min(l_quantity) AS min, max(l_quantity) AS max,
  count(l_quantity) AS n_valid, 0::BIGINT AS n_missing FROM lineitem GROUP BY 1""")
def agg4_numeric_summary(spark, sf):
    out = summaries.numeric_summary(read(spark, sf, "lineitem"), "l_quantity", "l_returnflag")
    return out.withColumns({"mean": F.round("mean", 6), "std": F.round("std", 6)})


@query("agg5_value_counts", "SELECT o_orderstatus AS value, count(*) AS n FROM orders WHERE o_orderstatus IS NOT NULL GROUP BY 1")
def agg5_value_counts(spark, sf):
    return summaries.describe(read(spark, sf, "orders"), "o_orderstatus")[1]


@query("agg6_missingness", """
WITH j AS (SELECT l.quality, l.toxic, d.lang FROM documents d LEFT JOIN labels l USING (doc_id))
SELECT c AS column, n_missing, round(n_missing / n, 6) AS share FROM (SELECT unnest(['quality', 'toxic', 'lang']) AS c, unnest([sum((quality IS NULL)::INT), sum((toxic IS NULL)::INT), sum((lang IS NULL)::INT)])::BIGINT AS n_missing, count(*) AS n FROM j)""")
def agg6_missingness(spark, sf):
    j = read(spark, sf, "documents").select("doc_id", "lang").join(read(spark, sf, "labels"), "doc_id", "left")
    return summaries.missing(j, ["quality", "toxic", "lang"])


@query("agg7_event_rate", "SELECT count(*) AS n, sum(toxic)::BIGINT AS events, round(sum(toxic) / count(*), 6) AS rate FROM labels")
def agg7_event_rate(spark, sf):
    return summaries.events(read(spark, sf, "labels"), "toxic")


@query("agg8_class_sizes", "SELECT c_nationkey, c_mktsegment, count(*) AS n FROM customer GROUP BY 1, 2")
def agg8_class_sizes(spark, sf):
    return privacy.class_sizes(read(spark, sf, "customer"), ["c_nationkey", "c_mktsegment"])


@query("agg8_violations", "SELECT CAST(s_nationkey AS VARCHAR) || '|' AS class, count(*) AS n FROM supplier GROUP BY s_nationkey HAVING count(*) < 5")
def agg8_violations(spark, sf):
    return privacy.k_violations(read(spark, sf, "supplier").withColumn("nothing", F.lit(None).cast("string")), ["s_nationkey", "nothing"])


@query("agg9_l_diversity", """
SELECT CAST(c_nationkey AS VARCHAR) || '|' || c_mktsegment AS class, 'status' AS attribute, count(DISTINCT status) + max((status IS NULL)::INT) AS values
FROM (SELECT c_nationkey, c_mktsegment, CASE WHEN o_orderstatus <> 'P' THEN o_orderstatus END AS status FROM customer JOIN orders ON c_custkey = o_custkey)
GROUP BY c_nationkey, c_mktsegment HAVING count(DISTINCT status) + max((status IS NULL)::INT) < 4""")
def agg9_l_diversity(spark, sf):
    j = read(spark, sf, "customer").join(read(spark, sf, "orders"), F.col("c_custkey") == F.col("o_custkey")).withColumn("status", F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus")))
    return privacy.l_diversity(j, ["c_nationkey", "c_mktsegment"], ["status"], 4)


@query("agg10_small_cells", "SELECT s_nationkey, CASE WHEN count(*) >= 5 THEN CAST(count(*) AS VARCHAR) ELSE '<5' END AS n FROM supplier GROUP BY 1")
def agg10_small_cells(spark, sf):
    return privacy.class_sizes(read(spark, sf, "supplier"), ["s_nationkey"]).select("s_nationkey", privacy.mask_small(F.col("n")).alias("n"))


@query("phi15_gated_rows", "SELECT c_custkey, c_nationkey FROM customer WHERE (SELECT min(n) >= 5 FROM (SELECT count(*) AS n FROM customer GROUP BY c_nationkey))")
def phi15_gated_rows(spark, sf):
    return privacy.gated(read(spark, sf, "customer"), ["c_nationkey"]).select("c_custkey", "c_nationkey")


@query("phi15_blocked_rows", "SELECT s_suppkey FROM supplier WHERE (SELECT min(n) >= 5 FROM (SELECT count(*) AS n FROM supplier GROUP BY s_nationkey))")
def phi15_blocked_rows(spark, sf):
    return privacy.gated(read(spark, sf, "supplier"), ["s_nationkey"]).select("s_suppkey")


@query("agg11_dataset_statistics", "SELECT 'nation' AS dataset, count(*) AS records, 3 AS columns, 'n_name, n_nationkey, n_regionkey' AS names FROM nation UNION ALL SELECT 'orders', count(*), 6, 'o_custkey, o_orderdate, o_orderkey, o_orderpriority, o_orderstatus, o_totalprice' FROM orders")
def agg11_dataset_statistics(spark, sf):
    return summaries.dataset_statistics({n: read(spark, sf, n) for n in ("orders", "nation")}, rows.INTERNAL)


@query("agg12_overview", "SELECT (SELECT count(*) FROM part) AS variables, (SELECT count(*) FROM part WHERE p_size > 25) AS phi_variables, (SELECT count(DISTINCT p_brand) FROM part) AS forms, 2::BIGINT AS datasets, (SELECT count(*) FROM nation) + (SELECT count(*) FROM region) AS records")
def agg12_overview(spark, sf):
    v = read(spark, sf, "part").select(F.col("p_brand").alias("form_name"), (F.col("p_size") > 25).alias("is_phi"))
    return summaries.overview(v, summaries.dataset_statistics({n: read(spark, sf, n) for n in ("nation", "region")}, ()))


@query("agg13_completeness", "SELECT CAST(count(*) AS VARCHAR) AS records, CAST(count(quality) AS VARCHAR) AS populated, printf('%.1f', round(100.0 * count(quality) / count(*), 1)) AS percent FROM documents LEFT JOIN labels USING (doc_id)")
def agg13_completeness(spark, sf):
    j = read(spark, sf, "documents").select("doc_id").join(read(spark, sf, "labels"), "doc_id", "left")
    return summaries.completeness(j, ["quality", "toxic"])


@query("agg14_form_counts", "SELECT coalesce(b, 'Unknown') AS form_name, count(*) AS n_variables FROM (SELECT CASE WHEN p_size > 5 THEN p_brand END AS b FROM part) GROUP BY 1")
def agg14_form_counts(spark, sf):
    return summaries.form_counts(read(spark, sf, "part").select(F.when(F.col("p_size") > 5, F.col("p_brand")).alias("form_name")))


@query("agg17_richest", """
SELECT doc_id, lang, source FROM (SELECT *, row_number() OVER (PARTITION BY lang, source ORDER BY n_chars DESC, text DESC, doc_id) AS r FROM (SELECT doc_id, lang, source, text, length(text) AS n_chars FROM documents)) WHERE r = 1""")
def agg17_richest(spark, sf):
    """AGG17: the richest definition of each key by one aggregation."""
    d = read(spark, sf, "documents").select("doc_id", "lang", "source", "text")
    return dedup.richest(d, ["lang", "source"], dedup.richness(F.col("text"), F.lit(1)), "doc_id").select("doc_id", "lang", "source")


@query("agg18_longest", "SELECT p_partkey, p_brand FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY length(p_name) DESC, p_partkey) AS r FROM part) WHERE r = 1")
def agg18_longest(spark, sf):
    return summaries.longest_description(read(spark, sf, "part"), "p_brand", "p_name", "p_partkey").select("p_partkey", "p_brand")


# ---- sets and duplicates


@query("set1_union_distinct", "SELECT DISTINCT o_custkey, o_orderstatus FROM orders")
def set1_union_distinct(spark, sf):
    o = read(spark, sf, "orders").select("o_custkey", "o_orderstatus")
    return dedup.union_distinct(o.filter("o_orderstatus <> 'F'"), o.filter("o_orderstatus <> 'O'"))


@query("set3_resolve_duplicate", "SELECT o_orderkey FROM orders WHERE o_orderkey % 3 <> 0 OR o_orderkey % 2 = 0")
def set3_resolve_duplicate(spark, sf):
    o = read(spark, sf, "orders").select("o_orderkey")
    kept, _ = dedup.resolve_duplicate("a", o.filter("o_orderkey % 3 <> 0"), "b", o.filter("o_orderkey % 2 = 0"))
    return kept["a"]


@query("set5_duplicate_columns", "SELECT * FROM (VALUES ('l_tax_2', 'l_tax', 'identical'), ('l_discount3', NULL, 'entirely null')) AS t(dropped, kept, reason)")
def set5_duplicate_columns(spark, sf):
    """SET5: copies found in one pass; l_quantity_1 differs and stays."""
    lines = read(spark, sf, "lineitem").withColumns({"l_tax_2": F.col("l_tax"), "l_quantity_1": F.col("l_quantity") + 1, "l_discount3": F.lit(None).cast("double")})
    found = [(e.dropped, e.kept, e.reason) for e in dedup.duplicate_columns(lines)]
    return spark.createDataFrame(found, "dropped string, kept string, reason string")


@query("set6_within_form", "SELECT p_partkey AS ordinal FROM (SELECT *, row_number() OVER (PARTITION BY p_brand, p_size ORDER BY length(p_name) DESC, p_name DESC, p_partkey) AS r FROM part) WHERE r = 1")
def set6_within_form(spark, sf):
    name = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("var"), "p_size")).otherwise(F.concat(F.lit("VAR"), "p_size"))
    v = read(spark, sf, "part").select(F.col("p_brand").alias("form"), name.alias("name"), F.col("p_name").alias("description"), F.lit(1).alias("populated"), F.col("p_partkey").alias("ordinal"))
    return dedup.within_form_duplicates(v).select("ordinal")


@query("set7_cross_form", "SELECT p_partkey AS ordinal, row_number() OVER (PARTITION BY p_size ORDER BY p_retailprice > 1000 DESC, length(p_name) DESC, p_name DESC, p_partkey) = 1 AS kept FROM part")
def set7_cross_form(spark, sf):
    v = read(spark, sf, "part").select(F.concat(F.lit("v"), "p_size").alias("name"), F.col("p_name").alias("description"), (F.col("p_retailprice") > 1000).cast("int").alias("populated"), F.col("p_partkey").alias("ordinal"))
    return dedup.cross_form_duplicates(v).select("ordinal", "kept")


@query("set8_prune_lists", "SELECT o_custkey, list_sort(list(DISTINCT o_orderpriority)) AS variables FROM orders WHERE o_orderpriority <> '1-URGENT' GROUP BY 1")
def set8_prune_lists(spark, sf):
    o = read(spark, sf, "orders").groupBy("o_custkey").agg(F.array_sort(F.collect_set("o_orderpriority")).alias("variables"))
    return dedup.prune_lists(o, "variables", ["1-urgent"]).filter(F.size("variables") > 0)


# ---- scalars


@query("scl1_to_number", "SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 THEN CAST(p_size AS DOUBLE) WHEN p_partkey % 4 = 1 THEN p_retailprice END AS v FROM part")
def scl1_to_number(spark, sf):
    """SCL1, SCL2: '12d' and '90+' are no numbers."""
    k = F.col("p_partkey") % 4
    raw = F.when(k == 0, F.concat(F.lit(" "), "p_size")).when(k == 1, F.col("p_retailprice").cast("string")).when(k == 2, F.concat("p_size", F.lit("d"))).otherwise("90+")
    return read(spark, sf, "part").select("p_partkey", numbers.to_number(raw).alias("v"))


@query("scl7_date_layouts", "SELECT o_orderkey, CAST(o_orderdate AS DATE) AS iso, CAST(o_orderdate AS DATE) AS stamp, CAST(o_orderdate AS DATE) AS mdy, CAST(o_orderdate AS DATE) AS dmy, CAST(NULL AS DATE) AS bad FROM orders")
def scl7_date_layouts(spark, sf):
    t = F.col("o_orderdate")
    o = read(spark, sf, "orders").select("o_orderkey", F.date_format(t, "yyyy-MM-dd").alias("iso"), F.concat(F.date_format(t, "yyyy-MM-dd"), F.lit("T10:15:00")).alias("stamp"), F.date_format(t, "M/d/yyyy").alias("mdy"), F.date_format(t, "d/M/yyyy").alias("dmy"), F.lit("2020-02-31").alias("bad"))
    return o.select("o_orderkey", *[dates.parse(c, c == "dmy").alias(c) for c in ("iso", "stamp", "mdy", "dmy", "bad")])


@query("scl9_normalise", "SELECT p_partkey, trim(regexp_replace(lower(p_name), '[^a-z0-9]+', ' ', 'g')) AS n FROM part")
def scl9_normalise(spark, sf):
    return read(spark, sf, "part").select("p_partkey", text.normalise("p_name").alias("n"))


@query("scl14_markdown_tables", "SELECT conv_id, 1 AS table, 'Result ' || conv_id AS title, 0 AS row, ['turn', 'role', 'x'] AS cells FROM (SELECT DISTINCT conv_id FROM conversations) UNION ALL SELECT DISTINCT conv_id, 1, 'Result ' || conv_id, 1, [CAST(conv_id AS VARCHAR), 'a', ''] FROM conversations")
def scl14_markdown_tables(spark, sf):
    c = read(spark, sf, "conversations").select("conv_id").distinct()
    message = F.concat(F.lit("## Result "), "conv_id", F.lit("\ntext\n\n| turn | role | x |\n|---|:--:|---|\n| "), "conv_id", F.lit(" | a |\nend"))
    return conversations.markdown_tables(c.select("conv_id", message.alias("t")), "conv_id", "t")


@query("srt1_variable_search", """
WITH t AS (SELECT p_partkey, trim(regexp_replace(lower(p_name), '[^a-z0-9]+', ' ', 'g')) AS n, trim(regexp_replace(lower(p_type), '[^a-z0-9]+', ' ', 'g')) AS d, trim(regexp_replace(lower(p_brand), '[^a-z0-9]+', ' ', 'g')) AS f, p_name FROM part),
s AS (SELECT *, 50 * (n = 'small ring')::INT + 18 * contains(n, 'small ring')::INT + 22 * contains(d, 'small ring')::INT + 8 * contains(f, 'small ring')::INT
 + 16 * (contains(n || ' ' || d, 'small') AND contains(n || ' ' || d, 'ring'))::INT + 12 * (contains(d, 'small') AND contains(d, 'ring'))::INT
 + 8 * contains(n, 'small')::INT + 10 * contains(d, 'small')::INT + 3 * contains(f, 'small')::INT + 8 * contains(n, 'ring')::INT + 10 * contains(d, 'ring')::INT + 3 * contains(f, 'ring')::INT AS score FROM t)
SELECT p_partkey, CAST(score AS INTEGER) AS score, CAST(row_number() OVER (ORDER BY score DESC, length(p_name), p_name, p_partkey) AS INTEGER) AS rank FROM s WHERE score > 0 QUALIFY rank <= 12""")
def srt1_variable_search(spark, sf):
    """SCL9-13, SRT1, SRT2: the best twelve are the feature."""
    found = catalogue.search(read(spark, sf, "part"), "the Small rings", name="p_name", description="p_type", form="p_brand", tie="p_partkey")
    return found.select("p_partkey", "score", "rank")


@query("scl13_fuzzy_candidates")
def scl13_fuzzy_candidates(spark, sf):
    """SCL13b, SCL13c: DuckDB has no Ratcliff-Obershelp ratio."""
    found = catalogue.candidates(read(spark, sf, "part"), "econmy", 5, "p_name", "p_type", "p_brand")
    return found.select("p_partkey", "score", "rank", "confidence", "low_confidence")


@query("srt3_snippet_search", """
WITH t AS (SELECT doc_id, source, text, lower(text) AS x FROM documents),
c AS (SELECT *, (length(x) - length(replace(x, 'tion', ''))) // 4 AS a, (length(x) - length(replace(x, 'heon', ''))) // 4 AS b FROM t),
s AS (SELECT doc_id, source, text, 25 * contains(x, 'tion heon')::INT + 10 * (a > 0 AND b > 0)::INT + CASE WHEN a > 0 THEN 4 + least(a - 1, 6) ELSE 0 END + CASE WHEN b > 0 THEN 4 + least(b - 1, 6) ELSE 0 END AS score FROM c)
SELECT doc_id, CAST(score AS INTEGER) AS score FROM s WHERE score > 0 ORDER BY score DESC, length(text), source, doc_id LIMIT 5""")
def srt3_snippet_search(spark, sf):
    return catalogue.snippets(read(spark, sf, "documents"), "tion heon", 5, form="source", tie="doc_id").select("doc_id", "score")


# ---- de-identification

_RULES = deid.Rules(
    subject_ids=("custkey",),
    keep=("^o_orderkey$",),
    drop=("^o_clerk$",),
    cap=(("^o_totalprice$", 300000, "300000+"),),
    generalize=(("^o_orderstatus$", {"f": "closed", "o": "open"}),),
    suppress=(("^o_lines$", 5),),
    dates=("date$",),
    ids=(("custkey$", "SUBJ"),),
)


def _scrubbed_orders(spark, sf) -> DataFrame:
    o = read(spark, sf, "orders")
    return o.select("o_orderkey", F.when(F.col("o_orderkey") % 11 != 0, F.col("o_custkey")).alias("o_custkey"), F.lit("x").alias("o_clerk"), F.floor("o_totalprice").alias("o_totalprice"), "o_orderstatus", (F.col("o_orderkey") % 9).cast("int").alias("o_lines"), F.col("o_orderdate"))


@query("dei9_pseudonyms", f"SELECT c_custkey, {_pseudonym('CAST(c_custkey AS VARCHAR)', 'SUBJ')} AS subject, {_pseudonym('CAST(c_custkey AS VARCHAR)', 'FAM')} AS family FROM customer")
def dei9_pseudonyms(spark, sf):
    """DEI9: one value has other names in other domains."""
    c = keyed.with_key(read(spark, sf, "customer"), TEST_KEY)
    return c.select("c_custkey", keyed.pseudonym(F.col("c_custkey"), "SUBJ").alias("subject"), keyed.pseudonym(F.col("c_custkey"), "FAM").alias("family"))


@query("dei8_date_shift", f"SELECT o_orderkey, strftime(CAST(o_orderdate AS DATE) + CAST({_offset('CAST(o_custkey AS VARCHAR)')} AS INTEGER), '%Y-%m-%d') AS shifted FROM orders")
def dei8_date_shift(spark, sf):
    o = keyed.with_key(read(spark, sf, "orders"), TEST_KEY)
    return o.select("o_orderkey", dates.shift(dates.as_stored(F.col("o_orderdate")), keyed.offset(F.col("o_custkey"))).alias("shifted"))


@query("dei8_intervals", "SELECT o_custkey, date_diff('day', min(CAST(o_orderdate AS DATE)), max(CAST(o_orderdate AS DATE))) AS days FROM orders GROUP BY 1")
def dei8_intervals(spark, sf):
    """DEI8: shifts keep the days between a subject's dates."""
    o = keyed.with_key(read(spark, sf, "orders"), TEST_KEY)
    moved = F.date_add(F.col("o_orderdate").cast("date"), keyed.offset(F.col("o_custkey")))
    return o.groupBy("o_custkey").agg(F.datediff(F.max(moved), F.min(moved)).cast("long").alias("days"))


@query("dei5_cap", "SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity > 40 THEN '40+' ELSE CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) END AS q FROM lineitem")
def dei5_cap(spark, sf):
    return read(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", deid.cap(F.col("l_quantity").cast("long"), 40, "40+").alias("q"))


@query("dei6_generalize", "SELECT c_custkey, CASE c_mktsegment WHEN 'BUILDING' THEN 'trade' WHEN 'MACHINERY' THEN 'trade' ELSE c_mktsegment END AS segment FROM customer")
def dei6_generalize(spark, sf):
    return read(spark, sf, "customer").select("c_custkey", deid.generalize(F.col("c_mktsegment"), {"building": "trade", "Machinery ": "trade"}).alias("segment"))


@query("dei6_suppress", "SELECT p_partkey, least(p_size, 5) AS p_size FROM part")
def dei6_suppress(spark, sf):
    return read(spark, sf, "part").select("p_partkey", deid.suppress(F.col("p_size"), 5, "int").alias("p_size"))


@query("dei0_scrub", f"""
SELECT o_orderkey, {_pseudonym('CAST(o_custkey AS VARCHAR)', 'SUBJ')} AS o_custkey, CASE WHEN floor(o_totalprice) > 300000 THEN '300000+' ELSE CAST(CAST(floor(o_totalprice) AS BIGINT) AS VARCHAR) END AS o_totalprice,
 CASE o_orderstatus WHEN 'F' THEN 'closed' WHEN 'O' THEN 'open' ELSE o_orderstatus END AS o_orderstatus, CAST(least(o_orderkey % 9, 5) AS INTEGER) AS o_lines,
 strftime(CAST(o_orderdate AS DATE) + CAST({_offset('CAST(o_custkey AS VARCHAR)')} AS INTEGER), '%Y-%m-%d') AS o_orderdate, 'v2' AS _phi_scrubbed
FROM orders WHERE o_orderkey % 11 <> 0""")
def dei0_scrub(spark, sf):
    """DEI0-DEI9, DEI11: all rules compiled into one projection, rows without a subject split off."""
    good, _ = deid.quarantine(_scrubbed_orders(spark, sf), _RULES)
    return deid.scrub(good, _RULES, TEST_KEY)


@query("dei10_quarantine", "SELECT o_orderkey FROM orders WHERE o_orderkey % 11 = 0")
def dei10_quarantine(spark, sf):
    return deid.quarantine(_scrubbed_orders(spark, sf), _RULES)[1].select("o_orderkey")


@query("agg15_audit_counts", """
WITH o AS (SELECT * FROM orders WHERE o_orderkey % 11 <> 0)
SELECT * FROM (SELECT 'phi-scrub-drop' AS scope, 'o_clerk' AS field, count(*) AS events FROM o
UNION ALL SELECT 'phi-scrub-cap', 'o_totalprice', count(*) FROM o WHERE floor(o_totalprice) > 300000
UNION ALL SELECT 'phi-scrub-generalize', 'o_orderstatus', count(*) FROM o WHERE o_orderstatus IN ('F', 'O')
UNION ALL SELECT 'phi-scrub-suppress', 'o_lines', count(*) FROM o WHERE o_orderkey % 9 > 5
UNION ALL SELECT 'phi-scrub-date', 'o_orderdate', count(*) FROM o
UNION ALL SELECT 'phi-scrub-id', 'o_custkey', count(*) FROM o) WHERE events > 0""")
def agg15_audit_counts(spark, sf):
    good, _ = deid.quarantine(_scrubbed_orders(spark, sf), _RULES)
    return deid.audit_counts(good, _RULES, TEST_KEY)


@query("agg16_orphans", "SELECT count(*) AS orphans FROM orders WHERE o_orderkey % 11 = 0")
def agg16_orphans(spark, sf):
    return deid.quarantine(_scrubbed_orders(spark, sf), _RULES)[1].agg(F.count("*").alias("orphans"))


# ---- text gates

#: What Unicode takes for parts of words.
_W = r"\p{L}\p{M}\p{Nd}\p{Pc}"


def _re2(label: str, pattern: str) -> str:
    """A pattern for DuckDB, which has no lookaround and boundaries of ASCII only: what stands at its edges is spelt out."""
    before, after, digit = rf"(?:^|[^{_W}])", rf"(?:$|[^{_W}])", r"\p{Nd}"
    if label == "EMAIL":
        return rf"(?:{before}[A-Za-z0-9_][A-Za-z0-9._%+-]*|[{_W}][.%+-][A-Za-z0-9._%+-]*)@[A-Za-z0-9.-]+\.[A-Za-z]{{2,}}{after}"
    if label == "URL":
        return rf"(?i){before}https?://[^\s/$.?#].[^\s]*"
    folds = "(?i)" if pattern.startswith("(?i)") else ""
    pattern = pattern.removeprefix("(?i)").replace(r"\b(\d{6})\b", r"\d{6}" + after).replace(r"(?<!\d)", r"(?:^|[^\d])").replace(r"(?!\d)", r"(?:$|[^\d])")
    if pattern.startswith(r"\b"):
        pattern = before + pattern[2:]
    if pattern.endswith(r"\b"):
        pattern = pattern[:-2] + after
    return folds + pattern.replace(r"\d", digit)


_FINDINGS = "SELECT doc_id, list_sort(list_filter([" + ", ".join(f"CASE WHEN regexp_matches(t, '{_re2(k, p)}') THEN '{k}' END" for k, p in phi.BLOCKING.items()) + r"], lambda x: x IS NOT NULL)) AS findings FROM (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\p{Z}\x{0b}\x{85}]', ' ', 'g') AS t FROM documents)"
_COUNTS = f"SELECT label, count(*) AS n FROM (SELECT unnest(findings) AS label FROM ({_FINDINGS})) GROUP BY 1"


@query("phi1_findings", _FINDINGS)
@query("phi1_findings_all", _FINDINGS)
def phi1_findings_all(spark, sf):
    """PHI1: all patterns on all documents."""
    return read(spark, sf, "documents").select("doc_id", phi.labels(F.coalesce("text", F.lit("")), phi.BLOCKING).alias("findings"))


@query("phi4_gate")
def phi4_gate(spark, sf):
    """PHI1-6: the whole gate; lookbehind has no form in DuckDB."""
    return read(spark, sf, "documents").select("doc_id", phi.gate("text").alias("g")).select("doc_id", "g.blocked", "g.findings", "g.warnings")


@query("agg19_label_counts", _COUNTS)
@query("agg19_label_counts_all", _COUNTS)
def agg19_label_counts_all(spark, sf):
    """AGG19: over all documents and patterns."""
    return summaries.distinct_labels(phi1_findings_all(spark, sf), "findings")


@query("phi7_redact")
def phi7_redact(spark, sf):
    """PHI3, PHI7, PHI16: labels and keyed tags in place of identifiers."""
    return keyed.with_key(read(spark, sf, "conversations"), TEST_KEY).select("conv_id", "turn", phi.redact("text", subjects=True).alias("text"))


@query("phi8_log_redaction")
def phi8_log_redaction(spark, sf):
    """PHI8-10."""
    return read(spark, sf, "documents").select("doc_id", phi.redact_log(F.col("text")).alias("text"))


def _sanitised() -> str:
    t = "coalesce(text, '')"
    for p in phi.INJECTION:
        t = f"regexp_replace({t}, '{p}', '{phi.INJECTED}', 'g')"
    return f"SELECT conv_id, turn, CASE WHEN t = '' THEN '' ELSE '[UNTRUSTED chat BEGIN]' || chr(10) || t || chr(10) || '[UNTRUSTED chat END]' END AS text FROM (SELECT conv_id, turn, {t} AS t FROM conversations)"


@query("phi13_sanitise", _sanitised())
@query("phi13_sanitise_all", _sanitised())
def phi13_sanitise_all(spark, sf):
    """PHI13: every turn as it is."""
    return read(spark, sf, "conversations").select("conv_id", "turn", phi.sanitise("text", "chat").alias("text"))


# ---- statistics


@query("st2_binary_logit", """
WITH t AS (SELECT sum((quality = 1 AND toxic = 1)::INT)::DOUBLE a, sum((quality = 1 AND toxic = 0)::INT)::DOUBLE b, sum((quality = 0 AND toxic = 1)::INT)::DOUBLE c, sum((quality = 0 AND toxic = 0)::INT)::DOUBLE d FROM labels),
u AS (SELECT ln(a * d / (b * c)) AS k, sqrt(1 / a + 1 / b + 1 / c + 1 / d) AS s FROM t)
SELECT round(k, 6) AS coef, round(s, 6) AS std_error, round(exp(k), 6) AS odds_ratio, round(exp(k - 1.959963984540054 * s), 6) AS ci_low, round(exp(k + 1.959963984540054 * s), 6) AS ci_high FROM u""")
def st2_binary_logit(spark, sf):
    return stats.binary_logit(read(spark, sf, "labels"), "toxic", "quality")


def _labelled(spark, sf) -> DataFrame:
    d = read(spark, sf, "documents").select("doc_id", (F.col("n_chars") / 1000).alias("thousands"), (F.col("doc_id") % 7).alias("noise"))
    return read(spark, sf, "labels").join(d, "doc_id")


@query("st1_univariate")
def st1_univariate(spark, sf):
    """ST1, ST2: Newton steps of one aggregation each; tests hold it against closed forms."""
    found = stats.univariate(_labelled(spark, sf), "toxic", ["quality", "thousands", "noise"])
    names = ["variable", "n", "coef", "std_error", "odds_ratio", "ci_low", "ci_high", "p_value", "significant"]
    return spark.createDataFrame([tuple(f[k] for k in names) for f in found], "variable string, n long, coef double, std_error double, odds_ratio double, ci_low double, ci_high double, p_value double, significant boolean")


@query("st3_backward")
def st3_backward(spark, sf):
    """ST3, ST4."""
    fit = stats.backward(_labelled(spark, sf), "toxic", ["quality", "thousands", "noise"])
    found = [] if fit is None else [(t["variable"], t["coef"], t["p_value"], fit.aic, fit.bic, fit.mcfadden) for t in fit.table()]
    return spark.createDataFrame(found, "variable string, coef double, p_value double, aic double, bic double, pseudo_r2 double")


@query("st5_interaction")
def st5_interaction(spark, sf):
    r = stats.interaction(_labelled(spark, sf), "toxic", "quality", "thousands")
    return spark.createDataFrame([tuple(r.values())], "factor string, moderator string, p_factor double, p_moderator double, p_interaction double, or_interaction double")


@query("st6_descriptive", "SELECT lang, round(avg(n_chars), 6) AS mean, round(median(n_chars), 6) AS median, count(n_chars) AS n_valid FROM documents GROUP BY 1")
def st6_descriptive(spark, sf):
    return summaries.numeric_summary(read(spark, sf, "documents"), "n_chars", "lang").select("lang", F.round("mean", 6).alias("mean"), F.round("median", 6).alias("median"), "n_valid")


@query("jn5_exact_duplicates", "SELECT md5(text) AS h, count(*) AS n, min(doc_id) AS first_id FROM documents GROUP BY text HAVING count(*) > 1")
def jn5_exact_duplicates(spark, sf):
    """SET1 on texts: groups by digest, combined before the shuffle."""
    return dedup.exact_copies(read(spark, sf, "documents"), "text", "doc_id").select("h", "n", F.col("first").alias("first_id"))
