"""A table's version from its rows: an order-free fingerprint, and a memory of results that goes by it."""

from __future__ import annotations

import hashlib
import threading
from collections import OrderedDict
from collections.abc import Callable, Hashable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Results that a study keeps.
KEPT = 256


def sums(columns: Sequence[str]) -> list[Column]:
    """Aggregates that say which rows a table has, how often each, in whatever order: their number, and sum and xor of two hashes.

    Columns count in the order of their names. They are plain aggregates, so they can be observed while a table is written.
    """
    cells = [F.col(f"`{c}`") for c in sorted(columns)]
    # names and nulls take part, so that a value isn't like one of a neighbouring column
    parts = [x for c, cell in zip(sorted(columns), cells) for x in (F.lit(c), cell.isNull(), cell)]
    one, two = F.xxhash64(*parts), F.xxhash64(F.lit("again"), *parts)
    return [
        F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(one.cast("decimal(38,0)")), F.lit(0)).cast("string").alias("sum"), F.coalesce(F.sum(two.cast("decimal(38,0)")), F.lit(0)).cast("string").alias("sum2"),
        F.coalesce(F.bit_xor(one), F.lit(0)).alias("xor"), F.coalesce(F.bit_xor(two), F.lit(0)).alias("xor2"),
    ]


def text(found: Mapping) -> str:
    """The fingerprint of what sums gave."""
    return hashlib.sha256("|".join(str(found[k]) for k in ("rows", "sum", "sum2", "xor", "xor2")).encode()).hexdigest()[:32]


def hashable(df: DataFrame) -> DataFrame:
    """df with maps as arrays of entries in order, which can be hashed."""
    return df.select(*[F.array_sort(F.map_entries(F.col(f"`{c}`"))).alias(c) if t.startswith("map<") else F.col(f"`{c}`") for c, t in df.dtypes])


def fingerprint(df: DataFrame) -> str:
    """The same for equal rows in any order and partitioning, another after any change; one aggregation with map-side sums.

    The schema takes part. Maps count by their entries, whatever their order.
    """
    plain = hashable(df)
    found = plain.agg(*sums(plain.columns)).first().asDict()
    return hashlib.sha256((text(found) + repr(sorted(df.dtypes))).encode()).hexdigest()[:32]


class Versions:
    """Fingerprints of tables, worked out again only where a table's files may have changed."""

    def __init__(self):
        self.known: dict[str, tuple[Hashable, DataFrame, str]] = {}

    def of(self, name: str, df: DataFrame) -> str:
        now = stamp(df)
        was = self.known.get(name)
        if was is not None and was[0] == now and (was[1] is df or now[0]):
            return was[2]
        found = fingerprint(df)
        self.known[name] = (now, df, found)
        return found


def stamp(df: DataFrame) -> tuple:
    """(files, plan): the files below a table as they are now, with size and time of change, and the hash of what is done with them."""
    spark = df.sparkSession
    path, conf, out = spark._jvm.org.apache.hadoop.fs.Path, spark._jsc.hadoopConfiguration(), []
    for f in sorted(df.inputFiles()):
        p = path(f)
        try:
            s = p.getFileSystem(conf).getFileStatus(p)
            out.append((f, s.getLen(), s.getModificationTime()))
        except Exception:  # the file has gone
            out.append((f, -1, -1))
    return tuple(out), df.semanticHash()


class Results:
    """The last results, by tool, arguments and the versions of the tables they came from. The oldest used goes first and is unpersisted."""

    def __init__(self, size: int = KEPT):
        self.size, self.kept, self.lock = size, OrderedDict(), threading.Lock()
        self.hits = self.misses = 0

    def get(self, key: Hashable, make: Callable[[], object]):
        with self.lock:
            if key in self.kept:
                self.kept.move_to_end(key)
                self.hits += 1
                return self.kept[key]
        made = make()
        if isinstance(made, DataFrame):
            made = made.cache()
        elif isinstance(made, tuple):
            made = tuple(x.cache() if isinstance(x, DataFrame) else x for x in made)
        with self.lock:
            self.misses += 1
            self.kept[key] = made
            while len(self.kept) > self.size:
                _release(self.kept.popitem(last=False)[1])
        return made

    def clear(self) -> None:
        with self.lock:
            for x in self.kept.values():
                _release(x)
            self.kept.clear()


def _release(x: object) -> None:
    for part in x if isinstance(x, tuple) else (x,):
        if isinstance(part, DataFrame):
            part.unpersist()
