"""Near-duplicate search that the document and the paragraph operators share.

A unit is a text with a set of word shingles. Units with one set form a class, known by a 128-bit digest of the set, so
copies are never expanded into pairs. Classes are banded by MinHash; a class goes through three rounds of candidates:

1. each class of a bucket with the bucket's smallest class,
2. in buckets that still hold several components, each class with one class that the bucket draws by a hash,
3. in what is left, all pairs of different components that signatures allow, verified where they are found.

The first two make as many pairs as a bucket has classes, and leave little of a group of near copies to the third; a link
between components that share a bucket is always found in the end. Candidates are compared by batches of signature positions:
a pair is dropped once the posterior probability of the wanted similarity falls below the miss probability, and what is
left is verified on the full sets.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, textkit

#: Bits of a prefilter for each of its hashes, and at most: 32 MB. A full prefilter lets more rows through to the join, never fewer.
BITS_EACH, MOST_BITS, PROBES = 16, 1 << 28, 3
#: Classes of one cell of a large bucket, and bytes of their sets.
CELL, CELL_BYTES = 512, 16 << 20
#: Rounds in which a bucket draws a class.
DRAWS = 1


@dataclass(frozen=True)
class Banding:
    """bands of rows signature positions: at similarity s a pair is missed with probability (1 - s**rows)**bands."""

    bands: int = 32
    rows: int = 4
    percent: int = 75
    #: Probability at which a pair of the wanted similarity may be pruned by its signature.
    miss: float = 1e-6
    batch: int = 16

    @property
    def size(self) -> int:
        return self.bands * self.rows

    def coefficients(self) -> np.ndarray:
        return np.random.default_rng(77).integers(1, 2**63, self.size, dtype=np.uint64) | np.uint64(1)

    def floors(self) -> list[tuple[int, int]]:
        """(positions compared, matches needed): with a uniform prior, P(similarity >= t | m of n) = P(Binomial(n + 1, t) <= m)."""
        t, out = self.percent / 100, []
        for n in range(self.batch, self.size + 1, self.batch):
            total, m = 0.0, -1
            while total < self.miss:
                m += 1
                total += math.comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)
            out.append((n, m))
        return out


def signatures(sets: list[np.ndarray], coefficients: np.ndarray) -> np.ndarray:
    """A row for each set, which must not be empty: its smallest value of each hash function."""
    if not sets:
        return np.empty((0, len(coefficients)), np.uint32)
    out = np.empty((len(sets), len(coefficients)), np.uint32)
    hashes = np.concatenate(sets)
    starts = np.cumsum([0, *map(len, sets[:-1])])
    for k, c in enumerate(coefficients):
        out[:, k] = np.minimum.reduceat(hashes * c >> np.uint64(32), starts)
    return out


def band_keys(sigs: np.ndarray, banding: Banding) -> np.ndarray:
    """A row of keys for each signature."""
    keys = textkit.combine(sigs.astype(np.uint64).reshape(len(sigs), banding.bands, banding.rows))
    return textkit.mix(keys + np.arange(1, banding.bands + 1, dtype=np.uint64)).view(np.int64)


class Prefilter:
    """A Bloom filter of 64-bit hashes. It spares most rows without a partner the way to a join; the join decides."""

    def __init__(self, hashes: DataFrame, column: str, count: int | None = None):
        """count: how many hashes there are, if that is known."""
        count = common.count(hashes) if count is None else count
        bits = min(MOST_BITS, 1 << max(16, (BITS_EACH * count).bit_length()))
        at = [F.expr(f"(({column} & {bits - 1}L) + {j} * shiftrightunsigned({column}, 32)) & {bits - 1}L") for j in range(PROBES)]
        with common.once(hashes.sparkSession):
            words = hashes.select(F.explode(F.array(at)).alias("bit")).groupBy(F.expr("cast(bit >> 6 as int)").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(bit & 63 as int))")).alias("set"))
            found = words.toArrow()  # bits / 64 rows at most
        bitmap = np.zeros(bits // 64, np.uint64)
        bitmap[found["word"].to_numpy()] = found["set"].to_numpy().view(np.uint64)
        self.bits, self.bitmap = bits, hashes.sparkSession.sparkContext.broadcast(bitmap)

    def passes(self, hashes: np.ndarray) -> np.ndarray:
        h, bitmap, mask = hashes.view(np.uint64), self.bitmap.value, np.uint64(self.bits - 1)
        out, alive = np.zeros(len(h), bool), np.arange(len(h))
        for j in range(PROBES):
            x = h[alive]
            at = (x & mask) + np.uint64(j) * (x >> np.uint64(32)) & mask
            alive = alive[(bitmap[at >> np.uint64(6)] >> (at & np.uint64(63)) & np.uint64(1)).astype(bool)]
        out[alive] = True
        return out

    def drop(self) -> None:
        """Free the bitmap once nothing that uses it will run any more."""
        self.bitmap.destroy()

    def column(self, hashes: F.Column) -> F.Column:
        """True where the hash may be in the bitmap; only the hashes go to Python."""

        @F.arrow_udf("boolean")
        def passing(h: pa.Array) -> pa.Array:
            return pa.array(self.passes(h.to_numpy(zero_copy_only=False)))

        return passing(hashes)


def _sets(column: pa.Array):
    """The sets of the texts, in lists of a bounded number of bytes."""
    column = common.strings(column)
    for a, b in common.byte_slices(column, textkit.SLICE_BYTES):
        yield textkit.shingle_sets(textkit.words(*common.text_buffer(column.slice(a, b - a))))


def digest(items: np.ndarray) -> bytes:
    return blake2b(items.tobytes(), digest_size=16).digest()


def sketches(units: DataFrame, keys: list[str], text: str, banding: Banding | None) -> DataFrame:
    """keys, n_shingles, digest and bands (null without a banding); digest and bands are null for an empty set."""
    source = units.select(*[F.col(f"`{k}`") for k in keys], F.col(text).alias("__text"))
    nothing = F.lit(None)
    schema = units.select(*[F.col(f"`{k}`") for k in keys], F.lit(0).cast("long").alias("n_shingles"), nothing.cast("binary").alias("digest"), nothing.cast("array<long>").alias("bands")).schema

    def run(batches):
        a = banding.coefficients() if banding else None
        for b in batches:
            n, digests, bands = [], [], []
            for sets in _sets(b.column(b.num_columns - 1)):
                n += map(len, sets)
                digests += [digest(s) if len(s) else None for s in sets]
                if banding:
                    keys = iter(band_keys(signatures([s for s in sets if len(s)], a), banding))
                    bands += [next(keys) if len(s) else None for s in sets]
                else:
                    bands += [None] * len(sets)
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(b.num_columns - 1)), pa.array(n, pa.int64()), pa.array(digests, pa.binary()), pa.array(bands, pa.list_(pa.int64()))], schema.fieldNames())

    return common.positional(source).mapInArrow(run, schema)


def full_batch(sets: list[np.ndarray], coefficients: np.ndarray) -> pa.RecordBatch:
    """digest, signature, set and the set's bytes of sets, which must not be empty."""
    kept = [map(digest, sets), [x.tobytes() for x in signatures(sets, coefficients)], [s.tobytes() for s in sets]]
    return pa.RecordBatch.from_arrays([*(pa.array(c, pa.binary()) for c in kept), pa.array([s.nbytes for s in sets], pa.int64())], ["digest", "sig", "items", "size"])


FULL = "digest binary, sig binary, items binary, size long"


def whole_texts(texts: DataFrame, banding: Banding):
    """For link: the full sets of texts (hash of a key, text) by a prefilter of the keys that are wanted."""

    def full(wanted: Prefilter) -> DataFrame:
        def run(batches):
            a = banding.coefficients()
            for b in batches:
                chosen = b.column(1).take(pa.array(np.flatnonzero(wanted.passes(b.column(0).to_numpy()))))
                for sets in _sets(chosen):
                    yield full_batch([s for s in sets if len(s)], a)

        return texts.mapInArrow(run, FULL)

    return full


def _banded(classes: DataFrame, shared: Prefilter) -> DataFrame:
    """(digest, key) of the bands that another class may have."""

    def run(batches):
        for b in batches:
            bands = b.column(1)
            keys = bands.flatten().to_numpy()
            at = np.flatnonzero(shared.passes(keys))
            owner = np.repeat(np.arange(b.num_rows), bands.value_lengths().to_numpy())[at]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(owner)), pa.array(keys[at])], ["digest", "key"])

    return classes.select("digest", "bands").mapInArrow(run, "digest binary, key long")


def similar(sig_a: np.ndarray, sig_b: np.ndarray, floors: list[tuple[int, int]]) -> np.ndarray:
    """Matches of each pair of rows of two matrices, -1 where a batch of positions has ruled the pair out."""
    matches, alive, at = np.zeros(len(sig_a), np.int64), np.arange(len(sig_a)), 0
    for n, need in floors:
        matches[alive] += (sig_a[alive, at:n] == sig_b[alive, at:n]).sum(axis=1)
        lost = matches[alive] < need
        matches[alive[lost]] = -1
        alive, at = alive[~lost], n
        if not len(alive):
            break
    return matches


def verified(pairs: DataFrame, full: DataFrame, banding: Banding) -> DataFrame:
    """The pairs (a, b) of a table, each there once, whose sets reach the similarity: first by their signatures, then exactly.

    A class may be a of most pairs, but b of few (a bucket each).
    """
    left, right = (full.select(F.col("digest").alias(x), F.col("sig").alias(f"sig_{x}"), F.col("items").alias(f"items_{x}")) for x in "ab")
    hot = common.hot_keys(pairs.groupBy("a").agg(F.count("*").alias("n")), "a", common.seen(pairs))
    both = common.spread_join(pairs.select("a", "b").join(right, "b"), left, "a", "b", hot).select("a", "b", "sig_a", "sig_b", "items_a", "items_b")

    def run(batches):
        floors = banding.floors()
        for b in batches:
            if not b.num_rows:
                continue
            sig = [np.frombuffer(b"".join(b.column(i).to_pylist()), np.uint32).reshape(b.num_rows, -1) for i in (2, 3)]
            keep = []
            for i in np.flatnonzero(similar(*sig, floors) >= 0).tolist():
                x, y = (np.frombuffer(b.column(c)[i].as_py(), np.uint64) for c in (4, 5))
                if shares(x, y, banding.percent):
                    keep.append(i)
            keep = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0).take(keep), b.column(1).take(keep)], ["a", "b"])

    return both.mapInArrow(run, "a binary, b binary")


def components(edges: DataFrame, work: common.Workspace) -> DataFrame:
    """(digest, root) of each end of an edge, root being the smallest digest that it reaches.

    Large and small stars in turn until nothing changes; every step joins on the node, and the edges of a hub are dealt out.
    """
    edges, kept = work.table(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()), None
    while common.seen(edges):
        if kept is not None:
            work.drop(kept)
        kept = edges
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        hot = common.hot_keys(both.groupBy("u").agg(F.count("*").alias("n")), "u", 2 * common.seen(edges))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = common.spread_join(both, low, "u", "v", hot).filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        edges = work.table(small.select("e.u", "e.v").filter("u != v").distinct())
        # stars: each node has one edge, and no root has one
        ends = edges.select(F.col("u").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(edges.select("v", F.lit(0), F.lit(1)))
        if common.empty(ends.groupBy("x").agg(F.sum("up").alias("up"), F.max("down").alias("down")).filter("up + down > 1")):
            work.drop(kept)
            return edges.select(F.col("u").alias("digest"), F.col("v").alias("root")).union(edges.select(F.col("v").alias("digest"), F.col("v").alias("root")).distinct())
    return edges.select(F.col("u").alias("digest"), F.col("v").alias("root"))


def _more(roots: DataFrame, edges: DataFrame, work: common.Workspace) -> DataFrame:
    """components with a table of new edges: what is known already is one star a component, which needs few steps; without new edges nothing changes."""
    if not common.seen(edges):
        return roots
    stars = roots.filter("digest != root").select(F.col("digest").alias("a"), F.col("root").alias("b"))
    return components(stars.union(edges.select("a", "b")), work)


def _mixed(members: DataFrame, roots: DataFrame, hot: DataFrame | None) -> DataFrame:
    """Members, with their roots, of the buckets of more than two classes that hold several components."""
    named = members.filter("n > 2").select("key", "n", "digest").join(roots, "digest", "left").withColumn("root", F.coalesce("root", "digest"))
    mixed = named.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low != high").select("key")
    return common.spread_join(named, mixed, "key", "digest", hot)


def _drawn(mixed: DataFrame, seed: int, hot: DataFrame | None) -> DataFrame:
    """(a, b): each class b with the one that its bucket draws, where that is of another component."""
    drawn = mixed.groupBy("key").agg(F.min(F.struct(F.xxhash64("digest", "key", F.lit(seed)), "digest", "root")).alias("x")).select("key", F.col("x.digest").alias("lead"), F.col("x.root").alias("lead_root"))
    pairs = common.spread_join(mixed, drawn, "key", "digest", hot).filter("root != lead_root")
    return pairs.select(F.col("lead").alias("a"), F.col("digest").alias("b")).distinct()


def _cells(mixed: DataFrame, full: DataFrame, hot: DataFrame | None, *columns: str) -> DataFrame:
    """key, i, j and a list of (block, digest, root, columns): cells of each bucket that between them hold every pair of different components.

    The members of a bucket's largest component are blocks of their own and meet only the others' blocks, so a large group
    with few others beside it costs few copies. Blocks of the largest component have negative numbers. Blocks are so many
    that each has about CELL classes and CELL_BYTES of their sets at most.
    """
    held = mixed.select("key", "digest", "root")
    held = held.join(full.select("digest", "size"), "digest") if "items" in columns else held.withColumn("size", F.lit(0).cast("long"))
    sizes = held.groupBy("key", "root").agg(F.count("*").alias("n"), F.sum("size").alias("size"))
    largest = sizes.groupBy("key").agg(F.max(F.struct("n", "root", "size")).alias("x"), F.sum("n").alias("all"), F.sum("size").alias("all_size"))
    blocks = lambda n, size: F.ceil(F.greatest(n / CELL, size / CELL_BYTES)).cast("int")
    largest = largest.select("key", F.col("x.root").alias("main"), blocks(F.col("x.n"), F.col("x.size")).alias("main_blocks"), blocks(F.col("all") - F.col("x.n"), F.col("all_size") - F.col("x.size")).alias("blocks"))
    at = lambda blocks: F.pmod(F.xxhash64("digest"), blocks.cast("long")).cast("int")
    own = F.when(F.col("root") == F.col("main"), -1 - at(F.col("main_blocks"))).otherwise(at(F.col("blocks")))
    meets = F.when(F.col("block") < 0, F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.sequence(-F.col("main_blocks"), F.col("blocks") - 1))
    dealt = common.spread_join(mixed.select("key", "digest", "root"), largest, "key", "digest", hot).withColumn("block", own).select("key", "digest", "root", "block", F.explode(meets).alias("other"))
    return (
        dealt.join(full.select("digest", *columns), "digest")
        .groupBy("key", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))
        .agg(F.collect_list(F.struct("block", "digest", "root", *columns)).alias("x"))
        .select("key", "i", "j", "x")
    )


def _binary(column: pa.Array, width: int) -> np.ndarray:
    """Values of one width as rows of bytes."""
    data = np.frombuffer(column.buffers()[2], np.uint8)
    start = np.frombuffer(column.buffers()[1], np.int32)[column.offset]
    return data[start : start + width * len(column)].reshape(-1, width)


def _survivors(b: pa.RecordBatch, banding: Banding):
    """Of each cell of a batch: its key, positions x and y of the pairs that signatures allow, the most similar first, and the batch's list columns.

    A pair is seen in the cell of the first band that it shares and in no other.
    """
    floors, lists = banding.floors(), b.column(3)
    bounds = np.concatenate(([0], np.cumsum(lists.value_lengths().to_numpy())))
    fields = lists.flatten().flatten()
    blocks = fields[0].to_numpy()
    roots = np.unique(np.ascontiguousarray(_binary(fields[2], 16)).view(np.uint64), axis=0, return_inverse=True)[1].ravel()
    sigs = np.ascontiguousarray(_binary(fields[3], 4 * banding.size)).view(np.uint32)
    for key, i, j, start, stop in zip(*(b.column(c).to_pylist() for c in range(3)), bounds, bounds[1:]):
        block = blocks[start:stop]
        left, right = start + np.flatnonzero(block == i), start + np.flatnonzero(block == j)
        found = []
        for row in np.array_split(left, -(-len(left) * len(right) // 65536) or 1):
            x, y = np.nonzero(roots[row][:, None] != roots[right][None, :])
            x, y = row[x], right[y]
            if i == j:
                x, y = x[x < y], y[x < y]
            matches = similar(sigs[x], sigs[y], floors)
            alive = matches >= 0
            x, y = x[alive], y[alive]
            first = (sigs[x] == sigs[y]).reshape(-1, banding.bands, banding.rows).all(axis=2).argmax(axis=1)
            keys = textkit.combine(np.take_along_axis(sigs[x].reshape(-1, banding.bands, banding.rows), first[:, None, None], 1)[:, 0].astype(np.uint64))
            own = textkit.mix(keys + (first + 1).astype(np.uint64)).view(np.int64) == key
            found.append(np.stack((x[own], y[own], matches[alive][own])))
        x, y, matches = np.concatenate(found, axis=1)
        order = np.argsort(-matches, kind="stable")
        yield key, x[order], y[order], fields, roots


def _involved(cells: DataFrame, banding: Banding) -> DataFrame:
    """(key, digest) of the classes with a candidate of another component in a cell."""

    def run(batches):
        for b in batches:
            for key, x, y, fields, _ in _survivors(b, banding) if b.num_rows else ():
                at = np.unique(np.concatenate((x, y)))
                if len(at):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), key)), fields[1].take(pa.array(at))], ["key", "digest"])

    return cells.mapInArrow(run, "key long, digest binary").distinct()


def shares(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """Do two sorted sets reach the similarity?"""
    if 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
        return False
    place = np.searchsorted(y, x)
    place[place == len(y)] = 0
    both = int((y[place] == x).sum())
    return 100 * both >= percent * (len(x) + len(y) - both)


def _linked(cells: DataFrame, banding: Banding) -> DataFrame:
    """Links (a, b) between components of a cell, verified on the full sets; a pair that others have joined in the cell isn't looked at."""

    def run(batches):
        for b in batches:
            for _, x, y, fields, roots in _survivors(b, banding) if b.num_rows else ():
                above: dict[int, int] = {}

                def top(r):
                    while (p := above.get(r, r)) != r:
                        above[r] = above.get(p, p)
                        r = p
                    return r

                out = []
                for i, j in zip(x.tolist(), y.tolist()):
                    p, q = top(int(roots[i])), top(int(roots[j]))
                    if p != q and shares(np.frombuffer(fields[4][i].as_buffer(), np.uint64), np.frombuffer(fields[4][j].as_buffer(), np.uint64), banding.percent):
                        above[p] = q
                        out.append((i, j))
                if out:
                    yield pa.RecordBatch.from_arrays([fields[1].take(pa.array([o[k] for o in out])) for k in (0, 1)], ["a", "b"])

    return cells.mapInArrow(run, "a binary, b binary").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def link(classes: DataFrame, count: int, full_sets, banding: Banding, work: common.Workspace) -> DataFrame:
    """(digest, root) of every class with a link to another.

    classes: digest, bands and key, a 64-bit hash of one unit that has the set; count: how many there are; full_sets makes the sets of the units whose
    keys pass a prefilter again, as sets of classes that share no bucket need never be kept. Joins by the key of a bucket
    deal out large buckets.
    """
    keys = classes.select(F.explode("bands").alias("key")).groupBy("key").agg(F.count("*").alias("n"))
    shared = work.table(keys.filter("n > 1"), n=F.sum("n"))
    if not common.seen(shared):
        return classes.select("digest", F.col("digest").alias("root")).limit(0)
    hot = common.hot_keys(shared, "key", common.seen(shared, "n"))
    filled = Prefilter(shared, "key", common.seen(shared))
    joined = work.table(common.spread_join(_banded(classes, filled), shared, "key", "digest", hot))
    filled.drop()
    leads = joined.groupBy("key").agg(F.min("digest").alias("lead"))
    members = work.table(common.spread_join(joined, leads, "key", "digest", hot))
    work.drop(joined)
    linkable = members.select("digest").distinct()
    wanted = Prefilter(classes.select("digest", F.col("key").alias("h")).join(linkable, "digest", "left_semi"), "h", min(count, common.seen(members)))
    full = work.table(full_sets(wanted).join(linkable, "digest", "left_semi").dropDuplicates(["digest"]))
    wanted.drop()

    pairs = work.table(members.filter("digest != lead").select(F.col("lead").alias("a"), F.col("digest").alias("b")).distinct())
    roots = components(verified(pairs, full, banding), work)
    # a pair of the first round has its smaller digest as a
    seen = pairs.select(F.col("a").alias("x"), F.col("b").alias("y"))
    mixed = work.table(_mixed(members, roots, hot))
    for seed in range(DRAWS if common.seen(mixed) else 0):
        drawn = work.table(_drawn(mixed, seed, hot).join(seen, (F.least("a", "b") == F.col("x")) & (F.greatest("a", "b") == F.col("y")), "left_anti"))
        found = work.table(verified(drawn, full, banding)) if common.seen(drawn) else drawn
        if common.seen(found):
            # a bucket of one component never holds several again
            roots, before = _more(roots, found, work), mixed
            mixed = work.table(_mixed(before, roots, hot))
            work.drop(before)
        work.drop(drawn)
    if common.seen(mixed):
        chosen = work.table(mixed.join(_involved(_cells(mixed, full, hot, "sig"), banding), ["key", "digest"], "left_semi"))
        if common.seen(chosen):
            roots = _more(roots, work.table(_linked(_cells(chosen, full, hot, "sig", "items"), banding)), work)
        work.drop(chosen)
    found = work.table(roots)
    work.drop(shared, members, full, pairs, mixed)
    return found
