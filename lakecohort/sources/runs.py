"""An ingest run: one at a time, step by step, published whole; and snapshots of single tables."""

from __future__ import annotations

import fcntl
import hashlib
import json
import uuid
from collections.abc import Callable, Mapping, Sequence
from contextlib import contextmanager
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakecohort.functions import numbers
from lakecohort.operators import dedup, deid, versions
from lakecohort.sources import files, generations, sinks

#: Versions of what a run writes; a change makes it new.
ARTIFACTS = {"published_table": "2.0.0", "manifest": "1.0.0"}
#: Kinds that a column of texts can turn out to have, first match wins; dates stay texts, which the rules read.
KINDS = ("bigint", "double", "boolean")


@contextmanager
def lock(path: str):
    """One run at a time: the lock goes with the process that holds it."""
    with open(path, "a") as f:
        try:
            fcntl.flock(f, fcntl.LOCK_EX | fcntl.LOCK_NB)
        except BlockingIOError:
            raise RuntimeError(f"another run holds {path}") from None
        yield


def run_steps(steps: Sequence[tuple[str, Callable[[], object]]], told: list[str] | None = None) -> tuple[int, str | None]:
    """(0, None), or (1, the step that failed): by an exception, by False or by a result with errors. Later steps don't run.

    told gets what went wrong: the text of this library's own errors, of others their kind only, as they may quote rows.
    """
    told = [] if told is None else told
    for name, step in steps:
        try:
            found = step()
        except Exception as e:
            told.append(f"{type(e).__name__}: {e}" if type(e) in (ValueError, OSError, FileNotFoundError) else type(e).__name__)
            return 1, name
        if found is False or isinstance(found, Mapping) and found.get("errors"):
            told.append("; ".join(map(str, found["errors"])) if found else name)
            return 1, name
    return 0, None


def _copy(spark: SparkSession, source: str, target: str) -> None:
    path, conf = spark._jvm.org.apache.hadoop.fs.Path, spark._jsc.hadoopConfiguration()
    a, b = path(source), path(target)
    if not spark._jvm.org.apache.hadoop.fs.FileUtil.copy(a.getFileSystem(conf), a, b.getFileSystem(conf), b, False, conf):
        raise OSError(f"{source} can't be copied to {target}")


def save_snapshot(spark: SparkSession, table: str, store: str, name: str) -> str:
    """A copy of a table's folder under a name; an older one of the name is replaced whole."""
    staging, target = f"{store}/.{name}-{uuid.uuid4().hex}", f"{store}/{name}"
    _copy(spark, table, staging)
    if not sinks.publish(spark, staging, target):
        raise OSError(f"nothing to save in {table}")
    return target


def restore_snapshot(spark: SparkSession, store: str, name: str, table: str) -> None:
    """The snapshot in place of the table; if that fails the table stays as it was."""
    staging = f"{table.rstrip('/')}.restore-{uuid.uuid4().hex}"
    _copy(spark, f"{store}/{name}", staging)
    if not sinks.publish(spark, staging, table):
        raise OSError(f"{name} can't be restored")


def version(rules: deid.Rules, key: bytes, pairs: Sequence[tuple[str, str]] = (), junk: Sequence[str] = ()) -> str:
    """What published tables depend on beside their files: rules, key (its digest only), cleaning and the versions of what is written."""
    said = json.dumps([asdict(rules), hashlib.sha256(key).hexdigest(), deid.VERSION, ARTIFACTS, sorted(pairs), sorted(junk)], sort_keys=True, default=str)
    return hashlib.sha256(said.encode()).hexdigest()[:16]


def ingest(spark: SparkSession, folder: str, target: str, rules: deid.Rules, key: bytes, study: str = "study", pairs: Sequence[tuple[str, str]] = (), junk: Sequence[str] = ()) -> dict:
    """Read the tables of a folder, clean, scrub and publish them together as a new generation under target.

    A table is a file, or a CSV folder whose parts follow each other by name: no task reads more than a part of it.

    Each file is read by one plan, which stages its rows, those without a subject apart, and meanwhile observes what the
    later steps have to know: rows, orphans, the columns' kinds and which columns are copies. The staged rows are numbered as
    they lie in the file. A second plan a table scrubs and writes, and observes audit events, rows and a fingerprint.
    pairs: datasets that hold the same form; the smaller one goes, or its rows join the larger. junk: names that are left out.

    Rows without a subject are written to ``quarantine/<generation>`` as they are, even if there are too many and the run fails.
    Nothing is published until all tables are written: then the pointer is swapped (see generations). A run whose inputs and
    version are those of the current generation is skipped. Result: code (0 or 1), failed (step), error, published (names),
    skipped, generation.
    """
    spark_folder = generations.Folder(spark, target)
    with spark_folder.lock():
        inputs = {r["name"]: {"bytes": r["bytes"], "sha256": r["sha256"]} for r in sinks.digests(spark, folder, files.parted(spark, folder)).select("name", "bytes", "sha256").collect()}
        now = version(rules, key, pairs, junk)
        before = spark_folder.manifest()
        if before and before["inputs"] == inputs and before["version"] == now and all(spark_folder.has(n) for n in before["tables"]):
            return {"code": 0, "failed": None, "error": None, "published": [], "skipped": True, "generation": before["generation"]}
        made = spark_folder.new()
        staged: dict[str, Staged] = {}
        frames: dict[str, DataFrame] = {}
        manifest: dict = {"generation": made.name, "study": study, "version": now, "inputs": inputs, "key_fingerprint": hashlib.sha256(key).hexdigest(), "artifacts": ARTIFACTS, "posture": rules.posture, "tables": {}, "audit": [], "cleaning": []}

        def read() -> None:
            for path in files.discover_all(spark, folder, folders=files.PARTED):
                for n, df in files.texts(spark, path):
                    if n in staged:
                        raise ValueError(f"two inputs are called {n}")
                    if n not in junk:
                        staged[n] = stage(df, path.rsplit("/", 1)[-1], rules, f"{made.path}/staged/{n}")
                    else:
                        manifest["cleaning"].append({"dataset": n, "reason": "junk"})

        def quarantine() -> dict:
            over = []
            for n, s in staged.items():
                if s.orphans:
                    s.orphan_rows(spark).write.parquet(f"{made.quarantine}/{n}")
                if s.orphans > rules.orphan_threshold:
                    over.append(f"{n}: {s.orphans} rows without a subject id; {rules.orphan_threshold} are allowed")
            return {"errors": over}

        def clean() -> None:
            for n, s in staged.items():
                frames[n] = s.rows(spark)
                manifest["cleaning"] += [{"dataset": n, "column": e.dropped, "kept": e.kept, "reason": e.reason} for e in s.copies]
            for a, b in pairs:
                if a in frames and b in frames:
                    resolve(frames, a, b, manifest["cleaning"])

        def write() -> None:
            for n, df in frames.items():
                manifest["tables"][n], events = publishable(df, rules, key, study, f"{made.path}/tables/{n}")
                manifest["tables"][n] |= {"read": staged[n].read, "quarantined": staged[n].orphans}
                manifest["audit"] += [{"dataset": n, **e} for e in events]

        def publish() -> None:
            generations.delete(spark, f"{made.path}/staged")
            made.publish(manifest)

        told: list[str] = []
        code, failed = run_steps([("read", read), ("quarantine", quarantine), ("clean", clean), ("scrub", write), ("publish", publish)], told)
        if code:
            made.discard()
        return {"code": code, "failed": failed, "error": told[0] if told else None, "published": [] if code else sorted(frames), "skipped": False, "generation": None if code else made.name}


@dataclass(frozen=True)
class Staged:
    """A file's rows as texts in a staged table: __orphan (partition), __file, __block and __row say where a row lies."""

    path: str
    source_file: str
    columns: tuple[str, ...]
    kinds: Mapping[str, str]
    copies: tuple[dedup.ColumnEvent, ...]
    read: int
    orphans: int

    def _table(self, spark: SparkSession) -> DataFrame:
        schema = T.StructType([*(T.StructField(c, T.StringType()) for c in self.columns), T.StructField("__file", T.StringType()), T.StructField("__block", T.LongType()), T.StructField("__row", T.LongType()), T.StructField("__orphan", T.BooleanType())])
        return spark.read.schema(schema).parquet(self.path) if self.read else spark.createDataFrame([], schema)

    def numbered(self, spark: SparkSession) -> DataFrame:
        """All rows with __source and __at, the place in the table: a block's rows follow each other, and blocks are counted."""
        table = self._table(spark)
        blocks = table.groupBy("__file", "__block").agg(F.count("*").alias("__n"), F.min("__row").alias("__first"))  # as many rows as the table has blocks
        before = F.coalesce(F.sum("__n").over(Window.orderBy("__file", "__block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        bases = blocks.select("__file", "__block", (before - F.col("__first")).alias("__base"))
        out = table.join(F.broadcast(bases), ["__file", "__block"]).withColumn("__at", F.col("__row") + F.col("__base")).withColumn("__source", F.lit(self.source_file))
        return out.drop("__file", "__block", "__row", "__base")

    def orphan_rows(self, spark: SparkSession) -> DataFrame:
        return self.numbered(spark).filter("__orphan").drop("__orphan").withColumnsRenamed({"__source": "source_file", "__at": "row_index"})

    def rows(self, spark: SparkSession) -> DataFrame:
        """Rows with a subject, in the columns' kinds and without copies."""
        gone = {e.dropped for e in self.copies}
        kept = [F.col(f"`{c}`").cast(self.kinds[c]).alias(c) for c in self.columns if c not in gone]
        return self.numbered(spark).filter("not __orphan").select(*kept, "__source", "__at")


def stage(df: DataFrame, source_file: str, rules: deid.Rules, path: str) -> Staged:
    """Write a table of texts once and learn from it what later steps need."""
    columns = df.columns
    place = (F.col("_metadata.file_path"), F.col("_metadata.file_block_start")) if files.has_blocks(df) else (F.lit(""), F.spark_partition_id().cast("long"))
    orphan = deid.subject(columns, rules) == ""
    cells = [F.col(f"`{c}`") for c in columns]
    flags = [F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(F.col("__orphan").cast("long")), F.lit(0)).alias("orphans")]
    for i, c in enumerate(cells):
        flags.append(F.collect_set(numbers.kinds(c)).alias(f"kinds{i}"))  # eight at most
    pairs = dedup.suffix_candidates(columns)
    for i, (c, base) in enumerate(pairs):
        flags += [F.coalesce(F.bool_and(F.col(f"`{c}`").isNull()), F.lit(True)).alias(f"null{i}"), F.coalesce(F.bool_and(F.col(f"`{c}`").eqNullSafe(F.col(f"`{base}`"))), F.lit(True)).alias(f"same{i}")]
    seen = Observation()
    marked = df.select(*cells, place[0].alias("__file"), place[1].alias("__block"), F.monotonically_increasing_id().alias("__row"), orphan.alias("__orphan"))
    marked.observe(seen, *flags).write.partitionBy("__orphan").parquet(path)
    got = seen.get
    kinds = {c: next((k for j, k in enumerate(KINDS) if got[f"kinds{i}"] and all(x >> j & 1 for x in got[f"kinds{i}"])), "string") for i, c in enumerate(columns)}
    copies = [dedup.ColumnEvent(c, None if got[f"null{i}"] else base, "entirely null" if got[f"null{i}"] else "identical") for i, (c, base) in enumerate(pairs) if got[f"null{i}"] or got[f"same{i}"]]
    return Staged(path, source_file, tuple(columns), kinds, tuple(copies), got["rows"], got["orphans"])


def resolve(frames: dict[str, DataFrame], a: str, b: str, events: list[dict]) -> None:
    """Of two datasets of one form the larger stays (a tie: the first); rows that only the other has join it, once each."""
    plain = {n: frames[n].drop("__source", "__at") for n in (a, b)}
    kept, event = dedup.resolve_duplicate(a, plain[a], b, plain[b])
    if event["reason"] == "merged":
        both = frames[event["kept"]].unionByName(frames[event["dropped"]])
        content = [c for c in both.columns if c not in ("__source", "__at")]
        frames[event["kept"]] = both.groupBy(*content).agg(F.min(F.struct("__source", "__at")).alias("__p")).select(*content, "__p.*")
    if event["dropped"]:
        del frames[event["dropped"]]
    events.append(event)


def publishable(df: DataFrame, rules: deid.Rules, key: bytes, study: str, path: str) -> tuple[dict, list[dict]]:
    """Scrub and write one table with provenance; (rows and fingerprint, audit events), observed while it is written."""
    audit, seen = Observation(), Observation()
    scrubbed, names = deid.scrub_observed(df, rules, key, audit)
    made = F.struct(F.col("__source").alias("source_file"), F.col("__at").alias("row_index"), F.lit(study).alias("study_name"), F.lit(ARTIFACTS["published_table"]).alias("pipeline_version"))
    out = scrubbed.withColumn("_provenance", made).drop("__source", "__at")
    out.observe(seen, *versions.sums([c for c in out.columns if c != "_provenance"])).write.parquet(path)
    events = [{"scope": scope, "field": field, "events": n} for (scope, field), n in zip(names, audit.get.values())] if names else []
    return {"rows": seen.get["rows"], "fingerprint": versions.text(seen.get)}, [e for e in events if e["events"]]


def table(spark: SparkSession, target: str, name: str) -> DataFrame:
    """A table of the current generation."""
    return generations.Folder(spark, target).table(name)
