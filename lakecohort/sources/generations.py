"""Sets of tables that are published, verified and taken back together.

A target folder (of any Hadoop file system) holds ``generations/<name>`` with ``tables/<table>`` and ``manifest.json``, and
``_current``, a pointer to one of them. The pointer is replaced in one rename, so a reader sees all tables of one generation or
of the next, and a run that fails leaves what was there. A table that no input has any more isn't in the next generation.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Sequence
from contextlib import contextmanager
from dataclasses import dataclass
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession

from lakecohort.operators import versions

POINTER, MANIFEST = "_current", "manifest.json"


def _place(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _place(spark, path)
    return fs.exists(p)


def delete(spark: SparkSession, path: str) -> None:
    fs, p = _place(spark, path)
    fs.delete(p, True)


def names(spark: SparkSession, path: str) -> list[str]:
    """What lies in a folder; nothing, if there is none."""
    fs, p = _place(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []


def get_text(spark: SparkSession, path: str) -> str | None:
    fs, p = _place(spark, path)
    if not fs.exists(p):
        return None
    stream = fs.open(p)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def put_text(spark: SparkSession, path: str, text: str) -> None:
    """Write beside the path, then rename over it in one step."""
    beside = f"{path}.{uuid.uuid4().hex}"
    fs, p = _place(spark, beside)
    stream = fs.create(p, True)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()
    hadoop, gateway = spark._jvm.org.apache.hadoop.fs, spark.sparkContext._gateway
    kind = getattr(hadoop, "Options$Rename")
    how = gateway.new_array(kind, 1)
    how[0] = kind.OVERWRITE
    hadoop.FileContext.getFileContext(fs.getUri(), spark._jsc.hadoopConfiguration()).rename(fs.makeQualified(p), fs.makeQualified(hadoop.Path(path)), how)


@dataclass(frozen=True)
class Generation:
    folder: Folder
    name: str

    @property
    def path(self) -> str:
        return f"{self.folder.path}/generations/{self.name}"

    @property
    def quarantine(self) -> str:
        return f"{self.folder.path}/quarantine/{self.name}"

    def manifest(self) -> dict | None:
        text = get_text(self.folder.spark, f"{self.path}/{MANIFEST}")
        return None if text is None else json.loads(text)

    def table(self, name: str) -> DataFrame:
        return self.folder.spark.read.parquet(f"{self.path}/tables/{name}")

    def publish(self, manifest: dict) -> None:
        """Write the manifest, then point to this generation."""
        manifest |= {"generated_utc": datetime.now(UTC).isoformat()}
        put_text(self.folder.spark, f"{self.path}/{MANIFEST}", json.dumps(manifest, indent=1, sort_keys=True))
        self.folder.point(self.name)

    def drill(self) -> dict[str, bool]:
        """Would a restore give what was published? Each table's rows are read and held against the manifest."""
        told = self.manifest()
        if told is None:
            raise ValueError(f"{self.name} has no manifest")
        out = {}
        for name, was in told["tables"].items():
            try:
                df = self.table(name).drop("_provenance")
                out[name] = versions.text(df.agg(*versions.sums(df.columns)).first().asDict()) == was["fingerprint"]
            except Exception:  # files are missing or can't be read
                out[name] = False
        return out

    def discard(self) -> None:
        """Delete a generation that wasn't published; its quarantine stays."""
        if self.folder.current() != self.name:
            delete(self.folder.spark, self.path)


class Folder:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def new(self) -> Generation:
        return Generation(self, f"{datetime.now(UTC):%Y%m%dT%H%M%S%f}-{uuid.uuid4().hex[:6]}")

    def current(self) -> str | None:
        text = get_text(self.spark, f"{self.path}/{POINTER}")
        return None if text is None else json.loads(text)["generation"]

    def generation(self, name: str | None = None) -> Generation:
        """A generation by name; without one the current."""
        found = name or self.current()
        if found is None:
            raise ValueError(f"nothing has been published in {self.path}")
        return Generation(self, found)

    def manifest(self) -> dict | None:
        return self.generation().manifest() if self.current() else None

    def table(self, name: str) -> DataFrame:
        return self.generation().table(name)

    def has(self, table: str) -> bool:
        return exists(self.spark, f"{self.generation().path}/tables/{table}")

    def point(self, name: str) -> None:
        put_text(self.spark, f"{self.path}/{POINTER}", json.dumps({"generation": name}))

    def published(self) -> list[str]:
        """Generations with a manifest, oldest first."""
        return [n for n in names(self.spark, f"{self.path}/generations") if exists(self.spark, f"{self.path}/generations/{n}/{MANIFEST}")]

    def restore(self, name: str) -> None:
        """Point to an earlier generation, once the drill has found all its tables whole."""
        bad = [t for t, whole in self.generation(name).drill().items() if not whole]
        if bad:
            raise ValueError(f"{name} can't be restored: {', '.join(sorted(bad))}")
        self.point(name)

    def prune(self, keep: int = 2) -> Sequence[str]:
        """Delete all but the last generations; the current one always stays. Their quarantines stay."""
        now = self.current()
        gone = [n for n in self.published()[: -keep or None] if n != now]
        for n in gone:
            delete(self.spark, f"{self.path}/generations/{n}")
        return gone

    @contextmanager
    def lock(self, patience: float = 12 * 3600):
        """One run at a time, by a file that only one can create; one left by a run that died counts for so many seconds."""
        fs, p = _place(self.spark, f"{self.path}/_lock")
        fs.mkdirs(p.getParent())
        if fs.exists(p) and time.time() - fs.getFileStatus(p).getModificationTime() / 1000 > patience:
            fs.delete(p, False)
        try:
            fs.create(p, False).close()
        except Exception:
            raise RuntimeError(f"another run holds {self.path}/_lock") from None
        try:
            yield
        finally:
            fs.delete(p, False)
