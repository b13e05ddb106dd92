"""Removal of repeated passages, wherever they lie: runs of ``RUN`` words that an earlier place holds word by word.

Words are those of textkit, so neither line breaks nor case matter. Each run of RUN words has a fingerprint, the smallest
hash of the SEED-word sequences in it (winnowing): equal runs have equal fingerprints, and neighbouring runs mostly share
theirs. Fingerprints that occur at one place only rule out nearly all runs; the hashes of the other runs meet by a join.
Of equal runs the first (by document, then by place) stays; the words of the others are cut out. Runs of one document only
are left alone where that is asked for.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, neardup, textkit

RUN, SEED = 50, 32
NONE = np.uint64(2**64 - 1)


def hashes(w: textkit.Words, size: int) -> np.ndarray:
    """Of each word the hash of the size words from it on; NONE where its text has fewer."""
    n = len(w.hashes)
    up, down = textkit._tables(n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(w.hashes * up[:n], out=sums[1:])
    out = np.full(n, NONE, np.uint64)
    at = np.flatnonzero(np.arange(n) + size <= w.first[1:][w.row])
    out[at] = textkit.mix((sums[at + size] - sums[at]) * down[at]) & ~np.uint64(1)  # never NONE
    return out


def _over(x: np.ndarray, f) -> np.ndarray:
    """f (minimum or maximum) of every RUN - SEED + 1 = 19 neighbours."""
    for step in (1, 2, 4, 8, 3):
        x = f(x[:-step], x[step:])
    return x


def fingerprints(w: textkit.Words) -> tuple[np.ndarray, np.ndarray]:
    """(words at which a run begins, the runs' fingerprints)."""
    if len(w.hashes) < RUN:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    least = _over(hashes(w, SEED), np.minimum)
    at = np.flatnonzero(np.arange(len(least)) + RUN <= w.first[1:][w.row[: len(least)]])
    return at, least[at]


def seeds(w: textkit.Words) -> np.ndarray:
    """The fingerprints, one for each place that one is taken from."""
    at, least = fingerprints(w)
    if not len(at):
        return least
    wanted, span = np.zeros(len(w.hashes) + 2 * (RUN - SEED), np.uint64), RUN - SEED
    wanted[at + span] = least  # a run that begins here; none: 0, below every hash
    chosen = _over(wanted[: len(w.hashes) + span], np.maximum)
    every = hashes(w, SEED)
    return every[(every == chosen) & (every != NONE)]


def _slices(column: pa.Array):
    column = common.strings(column)
    for a, b in common.byte_slices(column, textkit.SLICE_BYTES):
        yield a, textkit.words(*common.text_buffer(column.slice(a, b - a)))


def repeated(docs: DataFrame, work: common.Workspace, within: bool = True) -> DataFrame:
    """(row, starts, run_firsts) of the rows (row: struct of d and h, and text) with runs to cut: the words at which they begin, and the documents that keep them.

    within: cut runs that only one document repeats, too.
    """

    def some(batches):
        for b in batches:
            for _, w in _slices(b.column(0)):
                names, n = np.unique(seeds(w), return_counts=True)
                for at in range(0, len(names), 1 << 16):
                    yield pa.RecordBatch.from_arrays([pa.array(names[at : at + (1 << 16)].view(np.int64)), pa.array(n[at : at + (1 << 16)])], ["seed", "n"])

    # one row of each key: rows that are one document have the same runs at the same places
    found = docs.select("text").mapInArrow(some, "seed long, n long").groupBy("seed").agg(F.sum("n").alias("n")).filter("n > 1")
    found = work.table(found.select("seed"))
    again = neardup.Prefilter(found, "seed", common.seen(found))
    source = docs.select(F.col("row.d").alias("d"), F.col("row.h").alias("h"), "text")
    schema = source.select("d", "h", F.lit(0).alias("p"), F.lit(0).cast("long").alias("run")).schema

    def runs(batches):
        for b in batches:
            for first, w in _slices(b.column(2)):
                at, least = fingerprints(w)
                at = at[again.passes(least.view(np.int64))]
                if not len(at):
                    continue
                names = hashes(w, RUN)[at].view(np.int64)
                row, place = w.row[at], (at - w.first[w.row[at]]).astype(np.int32)
                for k in range(0, len(at), 1 << 16):
                    owner = pa.array(first + row[k : k + (1 << 16)])
                    yield pa.RecordBatch.from_arrays([b.column(0).take(owner), b.column(1).take(owner), pa.array(place[k : k + (1 << 16)]), pa.array(names[k : k + (1 << 16)])], ["d", "h", "p", "run"])

    place = F.struct(F.col("d").isNull().alias("n"), "d", "h", "p").alias("place")
    every = work.table(source.mapInArrow(runs, schema).select("run", place))
    again.drop()
    apart = lambda x: x if within else F.struct(f"{x}.n", f"{x}.d", f"{x}.h")
    several = ~F.min(apart("place")).eqNullSafe(F.max(apart("place")))
    stays = work.table(every.groupBy("run").agg(F.min("place").alias("stays"), several.alias("several"), F.count("*").alias("n")).filter("several"), n=F.sum("n"))
    hot = common.hot_keys(stays, "run", common.seen(stays, "n"))
    cut = common.spread_join(every, stays.select("run", "stays"), "run", "place", hot).filter(~F.col("place").eqNullSafe(F.col("stays")))
    return cut.groupBy(F.struct("place.d", "place.h").alias("row")).agg(F.sort_array(F.collect_set("place.p")).alias("starts"), F.collect_set("stays.d").alias("run_firsts"))


def covered(starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First word, and word past the last, of the stretches that sorted runs cover."""
    if not len(starts):
        return starts, starts
    new = np.flatnonzero(np.diff(starts) > RUN) + 1
    return starts[np.concatenate(([0], new))], starts[np.concatenate((new - 1, [len(starts) - 1]))] + RUN


def without(text: str, starts: np.ndarray) -> str:
    """The text without the words of the runs and what follows each up to the next word that stays."""
    data = np.frombuffer(text.encode("utf-8"), np.uint8)
    # slices of the buffer keep characters whole, as words begin and end at ASCII blanks
    full = ~textkit.BLANK[data]
    begins = np.flatnonzero(full & ~np.concatenate(([False], full[:-1])))
    begins, parts, at = np.append(begins, len(data)), [], 0
    for a, b in zip(*covered(starts)):
        parts.append(data[at : begins[a]].tobytes())
        at = begins[b]
    return b"".join([*parts, data[at:].tobytes()]).decode("utf-8")


def cut(text: str, starts: str) -> F.Column:
    """A struct of the text without the runs (as it is where there are none) and of how many words the runs cover.

    Declared nondeterministic, so that a filter on it isn't pushed below and the texts go to Python once.
    """

    @F.arrow_udf("struct<text: string, words: long>")
    def cutting(text: pa.Array, starts: pa.Array) -> pa.Array:
        runs = [None if s is None else np.array(s) for s in starts.to_pylist()]
        texts = [t if s is None or t is None else without(t, s) for t, s in zip(text.to_pylist(), runs)]
        words = [0 if s is None else int(np.subtract(*covered(s)[::-1]).sum()) for s in runs]
        return pa.StructArray.from_arrays([pa.array(texts, pa.string()), pa.array(words, pa.int64())], ["text", "words"])

    return cutting.asNondeterministic()(text, starts)
