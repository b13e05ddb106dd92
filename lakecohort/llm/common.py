"""Helpers that the operators share: shared-folder tables, Arrow slices and table reads."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: Bounds on one Arrow batch for the Python workers: rows, and bytes that end a batch once it has reached them.
BATCH_ROWS = 256
BATCH_BYTES = 4 << 20
#: A key is hot if it holds more than one in SPREAD of the rows, so at most SPREAD keys are, and more than FEW rows: dealing
#: out fewer costs a plan of joins and saves nothing.
SPREAD, FEW = 1024, 256
#: Spark's setting that deletes the shuffle files of what has run; else they stay until the driver collects its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def once(spark: SparkSession):
    """Frames that are made and run within are run once: their shuffle files go as soon as they have run.

    Not for frames that operators return: those may be run again.
    """
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEANUP, before)


def tuned(spark: SparkSession) -> SparkSession:
    """Small Arrow batches, so that a batch of long texts fits in a Python worker.

    These are settings of the session and stay: the frames that the operators return are run after they have returned.
    """
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return spark


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The cluster's spark.checkpoint.dir. Only a session on one machine may do without and gets a temporary folder (tests)."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = f"file://{tempfile.mkdtemp(prefix='lakecohort-')}"
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


class Workspace:
    """Tables written in the shared folder. They cut lineage and outlive executors.

    A frame that an operator returns may read them until it has been written; sweep deletes them then.
    """

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.root = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
        self.count = 0
        _open.append(self.root)

    def table(self, df: DataFrame, **sums: Column) -> DataFrame:
        """Write df and read it back. Its rows, and sums by their names, are observed meanwhile (seen), which spares jobs that count."""
        self.count += 1
        path = f"{self.root}/{self.count}"
        observed = Observation()
        with once(self.spark):
            df.observe(observed, F.count(F.lit(1)).alias("rows"), *(c.alias(k) for k, c in sums.items())).write.option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._workspace_path, out._seen = path, observed.get
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Delete tables that nothing reads any more."""
        delete(self.spark, *(t._workspace_path for t in tables))


#: Folders of workspaces that sweep hasn't deleted.
_open: list[str] = []


def delete(spark: SparkSession, *paths: str) -> None:
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for p in paths:
        path = jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(conf).delete(path, True)


def sweep(spark: SparkSession, *keep: Workspace) -> None:
    """Delete all workspaces but these. Frames that operators have returned before can't be read after."""
    kept = {w.root for w in keep}
    delete(spark, *(p for p in _open if p not in kept))
    _open[:] = [p for p in _open if p in kept]


def hot_keys(counts: DataFrame, key: str, total: int | None = None) -> DataFrame | None:
    """(key, salts) of the hot keys of (key, n), SPREAD rows at most; None if there are none. total: of n, if that is known."""
    with once(counts.sparkSession):
        total = (counts.agg(F.sum("n")).first()[0] or 0) if total is None else total
        if total <= FEW:
            return None
        hot = counts.filter((F.col("n") * SPREAD > total) & (F.col("n") > FEW)).select(key, F.ceil(F.col("n") * SPREAD / F.lit(total)).cast("int").alias("salts"))
        # as Arrow, since a list of rows would go through Python workers of its own
        found = hot.toArrow()
    return counts.sparkSession.createDataFrame(found, hot.schema) if found.num_rows else None


def count(df: DataFrame) -> int:
    with once(df.sparkSession):
        return df.count()


def empty(df: DataFrame) -> bool:
    with once(df.sparkSession):
        return df.isEmpty()


def seen(table: DataFrame, name: str = "rows") -> int:
    """What was observed while a workspace's table was written."""
    return table._seen[name] or 0


def spread_join(rows: DataFrame, table: DataFrame, key: str, by: str, hot: DataFrame | None, how: str = "inner") -> DataFrame:
    """rows.join(table, key) of a table with one row a key: the rows of a hot key are dealt out by the column ``by``, the table's row goes to each place."""
    if hot is None:
        return rows.join(table, key, how)
    salts = F.coalesce("salts", F.lit(1))
    left = rows.join(F.broadcast(hot), key, "left").withColumn("salt", F.pmod(F.xxhash64(by), salts.cast("long")).cast("int")).drop("salts")
    right = table.join(F.broadcast(hot), key, "left").withColumn("salt", F.explode(F.sequence(F.lit(0), salts - 1))).drop("salts")
    return left.join(right, [key, "salt"], how).drop("salt")


def positional(df: DataFrame) -> DataFrame:
    """df with columns 0, 1, ...: Arrow functions take columns by name, and names may clash."""
    return df.toDF(*map(str, range(len(df.columns))))


def held_out(doc_id: str, modulus: int) -> F.Column:
    """True where crc32(id as text) mod modulus is 2; false for a null id."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % modulus == 2, F.lit(False))


def strings(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    """One string array without nulls (null: empty)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.fill_null("") if column.null_count else column


def byte_slices(column: pa.Array, limit: int):
    """(first row, rows past the last) of runs of rows that hold about limit bytes of text, one row at least."""
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    n = len(column)
    if not n:
        return
    offsets = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)[column.offset : column.offset + n + 1]
    at = 0
    while at < n:
        end = int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1
        end = min(max(end, at + 1), n)
        yield at, end
        at = end


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string array without nulls, and each row's offsets in them."""
    wide = pa.types.is_large_string(column.type)
    n = len(column)
    if not n or column.buffers()[2] is None:
        return np.empty(0, np.uint8), np.zeros(n + 1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    return np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]
