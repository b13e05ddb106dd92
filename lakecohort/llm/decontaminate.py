"""Benchmark decontamination with a BM25 index of test items and block-max WAND.

Index entries are the parts of test items: a question (up to the first line break, or the whole) and an answer (the
rest), long parts cut further. Every training document is cut in overlapping windows of words, and each window is a
query. Impacts are BM25 weights as shares of what an entry scores against itself, so one threshold fits entries of any
length. A window is skipped if the largest impacts of its terms don't reach the threshold; then blocks of entries are
skipped by the terms' largest impacts in the block; what remains is scored in full. All entries above the threshold are
retrieved and verified: the share of the entry's word 5-grams that the window holds. A document is contaminated by an
item if the parts found of one of the item's rows hold half of that row's 5-grams at least.

Words are runs of letters, digits and bytes above 127, A-Z lower-cased, so punctuation and case don't hide a passage.

Defined results: an item of fewer words than five is found where all its words follow one another; items without words or id can't match; documents without words are clean; rows with one doc_id are
judged each on its own; items in many rows with one id count as one item if any of them is found.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common, textkit

K1, B = 1.2, 0.75
#: Words of half a window; windows overlap by half, so an entry of this length lies whole in one of them.
HALF = 128
GRAM = 5
#: Words of a question or answer that is searched by itself; a shorter one stays with the other.
SHORTEST = 12
BLOCK = 32
THRESHOLD = 0.5
OVERLAP = 0.6
#: Bytes of test items in one index. A larger benchmark is searched in several passes, with the statistics of the whole.
INDEX_BYTES = 16 << 20
#: (term, block) pairs or postings that are scored at once.
HELD = 1 << 20


def _grams(hashes: np.ndarray) -> np.ndarray:
    """Sorted distinct hashes of word 5-grams; of fewer words, of all of them."""
    if not len(hashes):
        return np.empty(0, np.uint64)
    return np.unique(_sequences(hashes, min(GRAM, len(hashes))))


def _sequences(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hashes of the size words from each word on."""
    return textkit.combine(np.stack([hashes[j : len(hashes) - size + 1 + j] for j in range(size)], axis=-1))


def _hashed(text: str) -> np.ndarray:
    data = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
    return textkit.words(data, np.array([0, len(data)]), textkit.PUNCTUATION).hashes


@dataclass
class Index:
    items: np.ndarray  # of each entry, the number of its row of the benchmark
    ids: list  # item ids by number of the row
    grams: list[np.ndarray]
    sizes: list[int]  # words of each entry's grams
    vocabulary: np.ndarray
    top: np.ndarray  # largest impact of each term
    term_at: np.ndarray  # of each term, its first (term, block) pair; one more at the end
    pair_block: np.ndarray
    pair_top: np.ndarray
    pair_at: np.ndarray  # of each pair, its first posting; one more at the end
    entry: np.ndarray
    impact: np.ndarray


def entries(text: str) -> list[np.ndarray]:
    """The words' hashes of an item's entries."""
    question, _, answer = text.strip().partition("\n")
    sides = [_hashed(question), _hashed(answer)]
    if min(map(len, sides)) < SHORTEST:
        sides = [np.concatenate(sides)]
    return [piece for h in sides for piece in np.array_split(h, max(1, -(-len(h) // HALF))) if len(piece)]


@dataclass
class Statistics:
    """Of all entries of the benchmark: how many, their words, and in how many each term is (sorted terms)."""

    count: int
    words: int
    terms: np.ndarray
    df: np.ndarray


def build(rows: list[tuple[object, str]], whole: Statistics | None = None) -> Index | None:
    """The index of (item id, text); None if no item has a word. whole: of the whole benchmark, where rows are a part of it."""
    ids, items, parts = [], [], []
    for key, text in rows:
        if key is None or not text:
            continue
        ids.append(key)
        for piece in entries(text):
            items.append(len(ids) - 1)
            parts.append(piece)
    if not parts:
        return None
    vocabulary, term = np.unique(np.concatenate(parts), return_inverse=True)
    lengths = np.array([len(p) for p in parts])
    entry = np.repeat(np.arange(len(parts)), lengths)
    posting, tf = np.unique(term.astype(np.int64) * len(parts) + entry, return_counts=True)
    term, entry = posting // len(parts), posting % len(parts)
    whole = whole or Statistics(len(parts), int(lengths.sum()), vocabulary, np.bincount(term, minlength=len(vocabulary)))
    df = whole.df[np.searchsorted(whole.terms, vocabulary)]
    idf = np.log1p((whole.count - df + 0.5) / (df + 0.5))
    weight = idf[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * lengths[entry] * whole.count / whole.words))
    impact = weight / np.bincount(entry, weight, len(parts))[entry]
    pair, pair_at = np.unique(term * len(parts) + entry // BLOCK, return_index=True)
    pair_term, pair_block = pair // len(parts), pair % len(parts)
    return Index(
        items=np.array(items), ids=ids, grams=[_grams(p) for p in parts], sizes=[min(GRAM, len(p)) for p in parts], vocabulary=vocabulary,
        top=np.maximum.reduceat(impact, np.searchsorted(term, np.arange(len(vocabulary)))),
        term_at=np.searchsorted(pair_term, np.arange(len(vocabulary) + 1)),
        pair_block=pair_block, pair_top=np.maximum.reduceat(impact, pair_at), pair_at=np.append(pair_at, len(impact)), entry=entry, impact=impact,
    )


def _ranges(starts: np.ndarray, stops: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of the ranges, and which range each is of."""
    n = stops - starts
    owner = np.repeat(np.arange(len(n)), n)
    return np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n) + starts[owner], owner


def _chunks(sizes: np.ndarray, limit: int):
    """Ranges of numbers whose sizes add up to about limit, one number at least."""
    ends, at = np.cumsum(sizes), 0
    while at < len(sizes):
        stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + limit, "right")))
        yield at, stop
        at = stop


def retrieve(index: Index, window: np.ndarray, term: np.ndarray, threshold: float) -> list[tuple[int, int, float]]:
    """(window, entry, score) above the threshold; (window, term) are distinct and in order of windows. Windows are taken so many at a time that HELD (term, block) pairs are held."""
    if not len(window):
        return []
    first = np.flatnonzero(np.concatenate(([True], window[1:] != window[:-1])))
    able = np.add.reduceat(index.top[term], first) >= threshold
    alive = np.repeat(able, np.diff(np.append(first, len(window))))
    window, term, out = window[alive], term[alive], []
    first = np.flatnonzero(np.concatenate((np.ones(min(1, len(window)), bool), window[1:] != window[:-1])))
    if not len(first):
        return out
    bounds = np.append(first, len(window))
    for a, b in _chunks(np.add.reduceat(index.term_at[term + 1] - index.term_at[term], first), HELD):
        some = slice(bounds[a], bounds[b])
        out += _scored(index, window[some], term[some], threshold)
    return out


def _scored(index: Index, window: np.ndarray, term: np.ndarray, threshold: float) -> list[tuple[int, int, float]]:
    names, local = np.unique(window, return_inverse=True)
    # blocks of entries, by the terms' largest impacts there
    blocks = int(index.pair_block.max()) + 1
    pairs, owner = _ranges(index.term_at[term], index.term_at[term + 1])
    cells, cell = np.unique(local[owner] * blocks + index.pair_block[pairs], return_inverse=True)
    able = np.bincount(cell, index.pair_top[pairs], len(cells)) >= threshold
    alive = able[cell]
    pairs, cells = pairs[alive], cells[able]
    cell = (np.cumsum(able) - 1)[cell[alive]]
    order = np.argsort(cell, kind="stable")
    pairs, cell = pairs[order], cell[order]
    starts, out = np.searchsorted(cell, np.arange(len(cells) + 1)), []
    if not len(pairs):
        return out
    for a, b in _chunks(np.add.reduceat(index.pair_at[pairs + 1] - index.pair_at[pairs], starts[:-1]), HELD):
        some = slice(starts[a], starts[b])
        postings, owner = _ranges(index.pair_at[pairs[some]], index.pair_at[pairs[some] + 1])
        score = np.bincount((cell[some][owner] - a) * BLOCK + index.entry[postings] % BLOCK, index.impact[postings], (b - a) * BLOCK)
        out += [(int(names[cells[a + k // BLOCK] // blocks]), int(cells[a + k // BLOCK] % blocks * BLOCK + k % BLOCK), float(score[k])) for k in np.flatnonzero(score >= threshold)]
    return out


def search(index: Index, column: pa.Array, threshold: float = THRESHOLD, overlap: float = OVERLAP) -> list[list[tuple[object, float, float]]]:
    """Of each text (item id, share of the item's 5-grams found, best BM25 share) of the items that contaminate it."""
    column, out = common.strings(column), []
    gram_total = np.bincount(index.items, [len(g) for g in index.grams], len(index.ids))
    for a, b in common.byte_slices(column, textkit.SLICE_BYTES):
        w = textkit.words(*common.text_buffer(column.slice(a, b - a)), textkit.PUNCTUATION)
        n = w.first[1:] - w.first[:-1]
        halves = np.maximum(1, -(-n // HALF))
        base = np.cumsum(halves) - halves  # number of each text's first window
        term = np.searchsorted(index.vocabulary, w.hashes)
        known = term < len(index.vocabulary)
        known[known] = index.vocabulary[term[known]] == w.hashes[known]
        at, term = np.flatnonzero(known), term[known]
        row = w.row[at]
        half = (at - w.first[row]) // HALF
        later = half > 0
        keys = np.sort(np.concatenate(((base[row] + half) << 32 | term, (base[row[later]] + half[later] - 1) << 32 | term[later])))
        keys = keys[np.concatenate((np.ones(min(1, len(keys)), bool), keys[1:] != keys[:-1]))]
        runs = {k: _sequences(w.hashes, k) if len(w.hashes) >= k else w.hashes[:0] for k in {GRAM, *index.sizes}}
        found: list[dict[int, list[float]]] = [{} for _ in range(b - a)]  # by entry: share of its 5-grams, score
        last, grams = -1, {}
        for window, entry, score in retrieve(index, keys >> 32, keys & 0xFFFFFFFF, threshold):
            r = int(np.searchsorted(base, window, "right")) - 1
            if window != last:
                start, last = w.first[r] + (window - base[r]) * HALF, window
                stop = min(start + 2 * HALF, w.first[r + 1])
                grams = {}
            wanted, size = index.grams[entry], index.sizes[entry]
            if size not in grams:
                grams[size] = np.sort(runs[size][start : max(start, stop - size + 1)])
            place = np.searchsorted(grams[size], wanted)
            place[place == len(grams[size])] = 0
            share = (grams[size][place] == wanted).mean() if len(grams[size]) else 0.0
            if share >= overlap:
                best = found[r].setdefault(entry, [0.0, 0.0])
                found[r][entry] = [max(best[0], float(share)), max(best[1], score)]
        for hits in found:
            items: dict[int, list[float]] = {}
            for entry, (share, score) in hits.items():
                x = items.setdefault(int(index.items[entry]), [0.0, 0.0])
                x[0] += share * len(index.grams[entry])
                x[1] = max(x[1], score)
            best: dict[object, list[float]] = {}  # by item id, of its rows that are found
            for i, (grams, score) in sorted(items.items()):
                if 2 * grams >= gram_total[i]:
                    x = best.setdefault(index.ids[i], [0.0, 0.0])
                    best[index.ids[i]] = [max(x[0], float(grams / gram_total[i])), max(x[1], score)]
            out.append([(key, share, score) for key, (share, score) in best.items()])
    return out


def term_counts(items: DataFrame) -> DataFrame:
    """part, term and df (entries of the part's items with the term) of items (part, text); a row with a null term counts entries (df) and their words."""

    def run(batches):
        for b in batches:
            for part, text in zip(b.column(0).to_pylist(), b.column(1)):
                found = entries(text.as_py())
                if found:
                    terms, df = np.unique(np.concatenate([np.unique(e) for e in found]), return_counts=True)
                    n = len(terms) + 1
                    yield pa.RecordBatch.from_arrays([pa.array([part] * n, pa.int64()), pa.array([None, *terms.view(np.int64).tolist()], pa.int64()), pa.array([len(found), *df.tolist()], pa.int64()), pa.array([sum(map(len, found))] + [0] * (n - 1), pa.int64())], ["part", "term", "df", "words"])

    return items.mapInArrow(run, "part long, term long, df long, words long").groupBy("part", "term").agg(F.sum("df").alias("df"), F.sum("words").alias("words"))


def find(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", index_bytes: int = INDEX_BYTES) -> DataFrame:
    """docs with leaks (in place of a column of that name), an array of (item_id, overlap, score) of the items found in the text."""
    items = benchmark.select(F.col(item_id).alias("item_id"), F.col(item_text).alias("text")).filter("item_id is not null and text is not null")
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    passes = max(1, -(-size // index_bytes))
    hits = T.ArrayType(T.StructType([T.StructField("item_id", items.schema["item_id"].dataType), T.StructField("overlap", T.DoubleType()), T.StructField("score", T.DoubleType())]))
    out, work = docs.withColumn("leaks", F.array().cast(hits)), common.Workspace(docs.sparkSession, "decontaminate")
    # dealt by the whole row, so that an item with most rows is no larger than others; leaks of one item meet below
    items = items.withColumn("part", F.pmod(F.xxhash64("item_id", "text"), F.lit(passes)))
    if passes > 1:
        counts = work.table(term_counts(items.select("part", "text")))
        count, words = counts.filter("term is null").agg(F.sum("df"), F.sum("words")).first()
        every = counts.filter("term is not null").groupBy("term").agg(F.sum("df").alias("df"))
    for k in range(passes):
        index = build(sorted((tuple(r) for r in items.filter(F.col("part") == k).select("item_id", "text").collect()), key=repr), _whole(counts, every, k, count, words) if passes > 1 else None)
        if index is None:
            continue
        out = _search(out if k == 0 else work.table(out), docs.sparkSession.sparkContext.broadcast(index), text)
    return out


def _whole(counts: DataFrame, every: DataFrame, part: int, count: int, words: int) -> Statistics:
    """The whole benchmark's statistics of the terms of one part, which are bounded as its bytes are."""
    found = counts.filter((F.col("part") == part) & F.col("term").isNotNull()).select("term").join(every, "term").toArrow()
    terms = found["term"].to_numpy().view(np.uint64)
    order = np.argsort(terms)
    return Statistics(count, words, terms[order], found["df"].to_numpy()[order])


def _merged(old: list[dict], new: list[tuple[object, float, float]]) -> list[dict]:
    """Leaks of earlier passes and of this one, one of each item."""
    best = {x["item_id"]: x for x in old}
    for i, o, s in new:
        x = best.get(i)
        best[i] = {"item_id": i, "overlap": max(o, x["overlap"]) if x else o, "score": max(s, x["score"]) if x else s}
    return list(best.values())


def _search(docs: DataFrame, index, text: str) -> DataFrame:
    at, leaks = docs.columns.index(text), docs.columns.index("leaks")
    names = docs.columns

    def run(batches):
        for b in batches:
            kind = b.column(leaks).type
            found = search(index.value, b.column(at)) if b.num_rows else []
            merged = [_merged(old, new) if new else old for old, new in zip(b.column(leaks).to_pylist(), found)]
            columns = [pa.array(merged, kind) if i == leaks else b.column(i) for i in range(b.num_columns)]
            yield pa.RecordBatch.from_arrays(columns, names)

    return docs.mapInArrow(run, docs.schema)


def clean(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The documents that hold no test item."""
    named = docs.withColumnsRenamed({"leaks": "leaks of the input"})
    return find(named, benchmark, **options).filter(F.size("leaks") == 0).drop("leaks").withColumnsRenamed({"leaks of the input": "leaks"})


def op4_decontaminate(spark, sf_dir: str) -> DataFrame:
    common.tuned(spark)
    docs = common.read(spark, sf_dir, "documents").select("doc_id", "text")
    found = find(docs, common.read(spark, sf_dir, "benchmark"))
    return found.select("doc_id", (F.size("leaks") > 0).alias("contaminated"), F.transform("leaks", lambda x: x["item_id"]).alias("item_ids"), F.coalesce(F.array_max(F.transform("leaks", lambda x: x["overlap"])), F.lit(0.0)).alias("overlap"), F.coalesce(F.array_max(F.transform("leaks", lambda x: x["score"])), F.lit(0.0)).alias("score"))
