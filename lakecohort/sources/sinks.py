"""Writers: staged and published tables, JSON documents, provenance, lineage, telemetry."""

from __future__ import annotations

import json
import os
import tempfile
import uuid
from collections.abc import Sequence
from datetime import UTC, datetime
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakecohort.functions import phi


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def _replace(spark: SparkSession, source: str, target: str) -> bool:
    """Rename source to target; what was there moves aside first and comes back if that fails."""
    fs, goal = _fs(spark, target)
    aside = _fs(spark, f"{target.rstrip('/')}.old-{uuid.uuid4().hex}")[1]
    old = fs.exists(goal)
    if old and not fs.rename(goal, aside):
        return False
    if not fs.rename(_fs(spark, source)[1], goal):
        if old:
            fs.rename(aside, goal)
        return False
    if old:
        fs.delete(aside, True)
    return True


def write_staged(df: DataFrame, path: str, kind: str = "json") -> None:
    """Write beside the target, then rename: the target is the old table or the whole new one, and missing only between two renames."""
    spark, staging = df.sparkSession, f"{path.rstrip('/')}.staging-{uuid.uuid4().hex}"
    df.write.format(kind).save(staging)
    if not _replace(spark, staging, path):
        raise OSError(f"{staging} can't be renamed to {path}")


def publish(spark: SparkSession, staging: str, target: str) -> bool:
    """Move a staged folder into place; an empty one isn't published."""
    fs, source = _fs(spark, staging)
    return fs.exists(source) and bool(fs.listStatus(source)) and _replace(spark, staging, target)


def write_document(path: str, payload: object) -> None:
    """A JSON document on the driver's disk, by a temporary file beside it."""
    folder = os.path.dirname(os.path.abspath(path))
    os.makedirs(folder, exist_ok=True)
    handle, name = tempfile.mkstemp(dir=folder)
    with os.fdopen(handle, "w", encoding="utf-8") as f:
        json.dump(payload, f, indent=2, ensure_ascii=False)
        f.flush()
        os.fsync(f.fileno())
    os.replace(name, path)


def write_csv(df: DataFrame, path: str) -> None:
    """A small result as one CSV file with a header."""
    df.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def with_provenance(df: DataFrame, source_file: str, sheet: str, study: str, version: str = "1", at: str | None = None, order: str | None = None) -> DataFrame:
    """Rows with source_file and a _provenance struct. order: a column that numbers the rows of the file; without it rows are numbered as read."""
    at = at or datetime.now(UTC).isoformat()
    if order is None:
        # ids grow within a partition; how many rows come before it follows from the counts, one a partition
        df = df.withColumn("__id", F.monotonically_increasing_id())
        part = F.shiftright("__id", 33).alias("__part")
        before, at_part = 0, []
        for r in df.groupBy(part).agg(F.count("*").alias("n")).orderBy("__part").collect():
            at_part.append((r["__part"], before))
            before += r["n"]
        bases = df.sparkSession.createDataFrame(at_part, "__part long, __base long")
        df = df.withColumn("__part", F.shiftright("__id", 33)).join(F.broadcast(bases), "__part").withColumn("__row", F.col("__base") + F.col("__id").bitwiseAND(F.lit((1 << 33) - 1))).drop("__id", "__part", "__base")
        order = "__row"
    made = F.struct(
        F.lit(source_file).alias("source_file"), F.lit(sheet).alias("sheet_name"), F.col(order).cast("long").alias("row_index"), F.lit(study).alias("study_name"),
        F.lit(at).alias("extraction_utc"), F.lit(version).alias("pipeline_version"), F.lit("spark").alias("extraction_engine"),
    )
    out = df.withColumn("source_file", F.lit(source_file)).withColumn("_provenance", made)
    return out.drop("__row") if order == "__row" else out


def metadata_row(df: DataFrame, source_file: str) -> DataFrame:
    """What stands for a file with a header and no rows: its columns, as nulls and by name, under row index -1."""
    info = F.struct(F.lit("column_structure").alias("type"), F.array(*map(F.lit, df.columns)).alias("columns"), F.lit("file has no rows").alias("note"))
    empty = [F.lit(None).cast(t).alias(c) for c, t in df.dtypes]
    return df.sparkSession.range(1).select(*empty, F.lit(source_file).alias("source_file"), F.lit(-1).cast("long").alias("row_index"), info.alias("_metadata"))


def digests(spark: SparkSession, path: str, parted: Sequence[str] = ()) -> DataFrame:
    """name, bytes, modified and sha256 of files, computed where they are read. parted: names of folders whose parts count too, as folder/part."""
    files, at = spark.read.format("binaryFile").load([path, *(f"{path.rstrip('/')}/{p}" for p in parted)]), F.split("path", "/")
    last, above = F.element_at(at, -1), F.element_at(at, -2)
    name = F.when(above.isin(*parted), F.concat_ws("/", above, last)).otherwise(last) if parted else last
    return files.select(name.alias("name"), F.col("length").alias("bytes"), F.col("modificationTime").alias("modified"), F.sha2("content", 256).alias("sha256"))


def lineage(inputs: DataFrame, outputs: DataFrame, counts: dict[str, int], study: str, key_fingerprint: str = "") -> dict:
    """A manifest of what was read and written."""
    rows = lambda df: [r.asDict() for r in df.select("name", "bytes", "sha256").orderBy("name").collect()]
    return {"study": study, "generated_utc": datetime.now(UTC).isoformat(), "inputs": rows(inputs), "outputs": rows(outputs), "counts": counts, "key_fingerprint": key_fingerprint}


def is_fresh(manifest: dict, inputs: DataFrame, version: str, required: list[str]) -> bool:
    """Are inputs, in both directions, and the version those of the manifest, and the outputs there?"""
    now = {r["name"]: r["sha256"] for r in inputs.select("name", "sha256").collect()}
    return manifest.get("version") == version and manifest.get("inputs") == now and all(Path(p).exists() for p in required)


def append_events(df: DataFrame, path: str, texts: list[str]) -> None:
    """Append events as JSON lines with masked texts."""
    df.withColumns({c: phi.mask_event(c) for c in texts}).write.mode("append").json(path)


def guard(path: str, zones: list[str]) -> str:
    """The real path, if it lies in one of the zones."""
    real = os.path.realpath(path)
    if not any(os.path.commonpath([real, os.path.realpath(z)]) == os.path.realpath(z) for z in zones):
        raise PermissionError(f"{path} is outside the allowed folders")
    return real
