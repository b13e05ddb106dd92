"""Language-model scoring by prediction by partial matching over bytes.

A text becomes its words with A-Z lower-cased, one space between words and an end symbol. The training documents' byte
contexts of up to ``ORDER`` bytes form a trie: for each context, how often each byte followed. A byte is coded in the
longest context that the trie has; if it wasn't seen there an escape is coded (method D: half a count of each distinct
byte seen goes to it) and the next shorter context codes it, without the bytes that the longer one has ruled out; below
the empty context all 256 values are alike. The score of a document is the sum of log10 probabilities, pretrained: it
doesn't learn from the text that it scores.

All training bytes are counted and every context codes, whatever the size of the corpus. The score of a byte follows from
itself and the ORDER bytes before it, its key. Keys that occurred in training get theirs from the counts of their context;
other keys, which only held-out documents have, climb the shorter contexts by joins on the context. Keys that make up at
least one in ``SHARE`` of the bytes, at most SHARE of them, are broadcast with their scores and looked up where the text
is; the others are joined. So are word counts for the base score: only words that make up at least 1/FREQUENT of the
training words are broadcast. SHARE and FREQUENT decide where a key meets its score, not what the score is.

Words are known by 64-bit hashes. Defined results: null and empty texts are a single end; rows with one doc_id are
scored each on its own; a null doc_id is training data; without any training document all counts are 0.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common, textkit

ORDER = 5
SHARE = 1 << 22
FREQUENT = 1 << 18
#: Distinct entries that a task gathers before it hands them on.
HELD = 1_500_000
END, SPACE = 0x0A, 0x20
#: Stands for the end of a text among words.
END_WORD = np.uint64(0)
CONTEXT, WORD = 0, 1


def mask(n: int) -> np.uint64:
    return np.uint64((1 << 8 * n) - 1)


def stream(w: textkit.Words) -> tuple[np.ndarray, np.ndarray]:
    """The coded bytes, each with the ORDER bytes before it in one integer (the byte lowest), and the text each is of."""
    n = len(w.first) - 1
    lengths = w.ends - w.starts
    sizes = np.maximum(np.bincount(w.row, lengths + 1, n).astype(np.int64), 1)
    base = np.cumsum(sizes + ORDER) - (sizes + ORDER)
    before = np.cumsum(lengths + 1) - (lengths + 1)
    in_row = before - (before[np.minimum(w.first[:-1], max(len(before) - 1, 0))] if len(before) else np.zeros(n, np.int64))[w.row]
    place = base[w.row] + ORDER + in_row
    out = np.full(int((sizes + ORDER).sum()), SPACE, np.uint8)
    if len(lengths):
        within = np.arange(int(lengths.sum())) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        out[np.repeat(place, lengths) + within] = w.data[np.repeat(w.starts, lengths) + within]
    out[(base[:, None] + np.arange(ORDER)).ravel()] = END
    out[base + ORDER + sizes - 1] = END
    keys = out.astype(np.uint64)
    for j in range(1, ORDER + 1):
        keys[j:] |= out[:-j].astype(np.uint64) << np.uint64(8 * j)
    coded = np.ones(len(out), bool)
    coded[(base[:, None] + np.arange(ORDER)).ravel()] = False
    return keys[coded], np.repeat(np.arange(n), sizes)


def _slices(column: pa.Array):
    """(first row, words) of slices of a column of texts."""
    column = common.strings(column)
    for a, b in common.byte_slices(column, textkit.SLICE_BYTES):
        yield a, textkit.words(*common.text_buffer(column.slice(a, b - a)))


def summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(keys):
        return keys, counts
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    at = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    return keys[at], np.add.reduceat(counts, at)


def distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    keys = np.sort(keys)
    at = np.flatnonzero(np.concatenate((np.ones(min(1, len(keys)), bool), keys[1:] != keys[:-1])))
    return keys[at], np.diff(np.append(at, len(keys)))


def counted(texts: DataFrame) -> DataFrame:
    """kind, key and n: context bytes of the highest order and words of all texts (one column), summed."""

    def run(batches):
        held: dict[int, list] = {CONTEXT: [], WORD: []}

        def emit(kind, keys, counts):
            for at in range(0, len(keys), 1 << 16):
                k = keys[at : at + (1 << 16)]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(k), kind, np.int32)), pa.array(k.view(np.int64)), pa.array(counts[at : at + (1 << 16)])], ["kind", "key", "n"])

        def gather(kind, most):
            parts = held[kind]
            if sum(len(k) for k, _ in parts) > most:
                merged = summed(np.concatenate([k for k, _ in parts]), np.concatenate([c for _, c in parts])) if parts else (np.empty(0, np.uint64), np.empty(0, np.int64))
                held[kind] = [merged]
                if len(merged[0]) > most // 2:
                    held[kind] = []
                    yield from emit(kind, *merged)

        for b in batches:
            for _, w in _slices(b.column(0)):
                held[CONTEXT].append(distinct(stream(w)[0]))
                held[WORD].append(distinct(np.concatenate((w.hashes, np.full(len(w.first) - 1, END_WORD)))))
            for kind in held:
                yield from gather(kind, HELD)
        for kind in held:
            yield from gather(kind, -1)

    return texts.mapInArrow(run, "kind int, key long, n long").groupBy("kind", "key").agg(F.sum("n").alias("n"))


class Trie:
    """The scores of key_scores in one process, for tests. Contexts by order, sorted; of each the totals T and kinds u, and the same of its parent without its own bytes."""

    def __init__(self, pairs: list[tuple[np.ndarray, np.ndarray]]):
        """pairs: of each order, sorted keys (context and byte) and counts."""
        self.pairs, self.contexts = pairs, []
        for d, (keys, counts) in enumerate(pairs):
            context, at = np.unique(keys >> np.uint64(8), return_index=True)
            total = np.add.reduceat(counts, at).astype(float) if len(at) else np.empty(0)
            kinds = np.diff(np.append(at, len(keys))).astype(float)
            left_total, left_kinds = np.zeros(len(context)), np.zeros(len(context))
            if d and len(context):
                parents, _, parent_total, parent_kinds, *_ = self.contexts[d - 1]
                own = pairs[d - 1][1][np.searchsorted(pairs[d - 1][0], keys & mask(d))]
                parent = np.searchsorted(parents, context & mask(d - 1)) if d > 1 else np.zeros(len(context), np.int64)
                left_total = parent_total[parent] - np.add.reduceat(own, at)
                left_kinds = parent_kinds[parent] - kinds
            self.contexts.append((context, at, total, kinds, left_total, left_kinds))

    def score(self, keys: np.ndarray) -> np.ndarray:
        """log10 probability of each key's byte after the bytes before it."""
        out = np.zeros(len(keys))
        todo = np.arange(len(keys))
        total, kinds = np.full(len(keys), -1.0), np.zeros(len(keys))  # of the context that codes next, -1: none yet
        for d in range(len(self.pairs) - 1, -1, -1):
            names, counts = self.pairs[d]
            contexts, _, all_total, all_kinds, left_total, left_kinds = self.contexts[d]
            if not len(names):
                continue
            k = keys[todo] & mask(d + 1)
            context = k >> np.uint64(8)
            c = np.minimum(np.searchsorted(contexts, context), len(contexts) - 1)
            there = contexts[c] == context
            fresh = there & (total[todo] < 0)
            total[todo[fresh]], kinds[todo[fresh]] = all_total[c[fresh]], all_kinds[c[fresh]]
            p = np.minimum(np.searchsorted(names, k), len(names) - 1)
            seen = names[p] == k
            room = 2 * total[todo]
            hit = todo[seen]
            out[hit] += np.log10((2 * counts[p[seen]] - 1) / room[seen])
            # escape: certain where the context has nothing left
            miss = there & ~seen & (kinds[todo] > 0)
            out[todo[miss]] += np.log10(kinds[todo[miss]] / room[miss])
            total[todo[there]], kinds[todo[there]] = left_total[c[there]], left_kinds[c[there]]
            todo = todo[~seen]
        out[todo] -= math.log10(max(1, 256 - len(self.pairs[0][0])))
        return out


def _by_row(rows: np.ndarray, names: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (row, name) and how often each occurs."""
    order = np.lexsort((names, rows))
    r, h = rows[order], names[order]
    new = np.flatnonzero(np.concatenate((np.ones(min(1, len(r)), bool), (r[1:] != r[:-1]) | (h[1:] != h[:-1]))))
    return r[new], h[new], np.diff(np.append(new, len(r))).astype(np.int32)


def contexts(level: DataFrame) -> DataFrame:
    """context, seen (how often each byte followed: 256 entries at most) and total, from the counts of keys."""
    byte = F.col("key").bitwiseAND(F.lit(255)).cast("int")
    return level.groupBy(F.shiftright("key", 8).alias("context")).agg(F.map_from_entries(F.collect_list(F.struct(byte, "n"))).alias("seen"), F.sum("n").alias("total"))


def key_scores(train: DataFrame, other: DataFrame, work: common.Workspace, order: int = ORDER) -> DataFrame:
    """key, n (how often it occurs) and s (log10 probability) of the keys of training (train: key, n) and of the other texts."""
    level = work.table(contexts(train))
    hits = level.select("context", "total", F.explode("seen").alias("byte", "n")).select(F.shiftleft("context", 8).bitwiseOR(F.col("byte").cast("long")).alias("key"), "n", F.log10((2 * F.col("n") - 1) / (2 * F.col("total"))).alias("s"))
    # out: bytes that a longer context has ruled out; each longer context's bytes are also seen in the shorter ones
    state = other.join(train.select("key"), "key", "left_anti").select("key", "n", F.lit(0.0).alias("s"), F.array().cast("array<int>").alias("out"), F.lit(False).alias("done"))
    counts = train
    for d in range(order, -1, -1):
        if d < order:
            counts = work.table(counts.groupBy(F.col("key").bitwiseAND(F.lit(int(mask(d + 1)))).alias("key")).agg(F.sum("n").alias("n")))
            level = contexts(counts)
        level = F.broadcast(level) if d < 2 else level  # 256 contexts at most
        at = F.shiftright(F.col("key").bitwiseAND(F.lit(int(mask(d + 1)))), 8)
        both = state.withColumn("context", at).join(level, "context", "left")
        byte = F.col("key").bitwiseAND(F.lit(255)).cast("int")
        both = both.withColumn("left", F.map_filter("seen", lambda k, v: ~F.array_contains("out", k))).withColumn("c", F.try_element_at("left", byte))
        both = both.withColumn("room", 2.0 * F.aggregate(F.map_values("left"), F.lit(0).cast("long"), lambda x, v: x + v))
        # nothing is coded where training lacks the context or where it has nothing left
        coded = ~F.col("done") & F.coalesce(F.col("room") > 0, F.lit(False))
        step = F.when(coded & F.col("c").isNotNull(), F.log10((2 * F.col("c") - 1) / F.col("room"))).when(coded, F.log10(F.size("left") / F.col("room"))).otherwise(0.0)
        state = both.select("key", "n", (F.col("s") + step).alias("s"), F.when(F.col("done") | F.col("seen").isNull(), F.col("out")).otherwise(F.map_keys("seen")).alias("out"), (F.col("done") | (coded & F.col("c").isNotNull())).alias("done"))
    last = F.log10(F.greatest(F.lit(1), 256 - F.size("out")).cast("double"))
    return hits.union(state.select("key", "n", F.when(F.col("done"), F.col("s")).otherwise(F.col("s") - last).alias("s")))


def score(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", held_out: F.Column | None = None, share: int = SHARE) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of each row; training rows aren't held out."""
    spark = docs.sparkSession
    work = common.Workspace(spark, "ppm")
    held_out = F.lit(False) if held_out is None else held_out
    source = docs.select(F.col(doc_id).alias("doc_id"), held_out.alias("held_out"), F.col(text).alias("text"))
    counts = work.table(counted(source.filter("not held_out").select("text")))
    words = counts.filter(F.col("kind") == WORD).select(F.col("key").alias("h"), F.col("n").alias("c"))
    train, kinds = words.agg(F.sum("c"), F.count("*")).first()
    train = train or 0
    frequent = words.filter(F.col("c") * FREQUENT >= train).toArrow()  # FREQUENT rows at most
    names, often = frequent["h"].to_numpy().view(np.uint64), frequent["c"].to_numpy()
    at = np.argsort(names)
    keys = counts.filter(F.col("kind") == CONTEXT).select("key", "n")
    other = counted(source.filter("coalesce(held_out, true)").select("text")).filter(F.col("kind") == CONTEXT).select("key", "n")
    scored = work.table(key_scores(keys, other, work))
    size = scored.agg(F.sum("n")).first()[0] or 0
    often_seen = F.col("n") * share >= size
    near_keys = scored.filter(often_seen).select("key", "s").toArrow()  # share rows at most
    known_keys, known_scores = near_keys["key"].to_numpy().view(np.uint64), near_keys["s"].to_numpy()
    by = np.argsort(known_keys)
    model = spark.sparkContext.broadcast((known_keys[by], known_scores[by], names[at], often[at]))
    far_values = words.select(F.lit(WORD).alias("kind"), "h", F.col("c").cast("double").alias("c")).union(scored.filter(~often_seen).select(F.lit(CONTEXT), "key", "s"))
    kind = source.schema["doc_id"].dataType
    schema = T.StructType([T.StructField("row", T.LongType()), T.StructField("doc_id", kind), *T._parse_datatype_string("held_out boolean, n_tokens long, score double, sum double, known long, kind int, h long, tf int").fields])

    def run(batches):
        known_keys, known_scores, names, often = model.value
        logs = np.log10(often + 1.0)
        number = TaskContext.get().partitionId() << 40
        for b in batches:
            for first, w in _slices(b.column(2)):
                n = len(w.first) - 1
                keys, owner = stream(w)
                each, inverse = np.unique(keys, return_inverse=True)
                place = np.minimum(np.searchsorted(known_keys, each), max(len(known_keys) - 1, 0))
                there = known_keys[place] == each if len(known_keys) else np.zeros(len(each), bool)
                values = np.where(there, known_scores[place], 0.0) if len(known_keys) else np.zeros(len(each))
                scores = np.bincount(owner, values[inverse], n)
                hashes = np.concatenate((w.hashes, np.full(n, END_WORD)))
                rows = np.concatenate((w.row, np.arange(n)))
                at = np.minimum(np.searchsorted(names, hashes), max(len(names) - 1, 0))
                near = names[at] == hashes if len(names) else np.zeros(len(hashes), bool)
                sums = np.bincount(rows[near], logs[at[near]], n) if len(names) else np.zeros(n)
                known = np.bincount(rows[near], minlength=n)
                tokens = np.bincount(rows, minlength=n)
                ids = number + np.arange(n)
                number += n
                # the other keys and words go to where their scores and counts are
                far, apart = np.flatnonzero(~near), np.flatnonzero(~there[inverse])
                parts = [(kind, *_by_row(r, h)) for kind, r, h in ((WORD, rows[far], hashes[far]), (CONTEXT, owner[apart], keys[apart]))]
                # a row of each document, of no word: dealt out by its number
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids), b.column(0).slice(first, n), b.column(1).slice(first, n), pa.array(tokens), pa.array(scores), pa.array(sums), pa.array(known), pa.array(np.full(n, WORD, np.int32)), pa.array(textkit.mix(ids.astype(np.uint64)).view(np.int64)), pa.array(np.zeros(n, np.int32))],
                    schema.fieldNames(),
                )
                for code, r, h, tf in parts:
                    for at in range(0, len(r), 1 << 16):
                        some = slice(at, at + (1 << 16))
                        k = len(r[some])
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(ids[r[some]]), pa.nulls(k, b.column(0).type), pa.nulls(k, pa.bool_()), pa.nulls(k, pa.int64()), pa.nulls(k, pa.float64()), pa.nulls(k, pa.float64()), pa.nulls(k, pa.int64()), pa.array(np.full(k, code, np.int32)), pa.array(h[some].view(np.int64)), pa.array(tf[some])],
                            schema.fieldNames(),
                        )

    found = source.mapInArrow(run, schema).join(far_values, ["kind", "h"], "left")
    c, tf, word = F.coalesce("c", F.lit(0.0)), F.col("tf"), F.col("kind") == WORD
    whole = found.groupBy("row").agg(
        *[F.max(x).alias(x) for x in ("doc_id", "held_out", "n_tokens")],
        (F.max("score") + F.sum(F.when(~word, tf * c).otherwise(0.0))).alias("score"),
        (F.max("sum") + F.sum(F.when(word, tf * F.log10(c + 1.0)).otherwise(0.0))).alias("sum"),
        (F.max("known") + F.sum(F.when(word & (c > 0), tf).otherwise(0))).alias("n_known"),
    )
    least = math.log10(train + kinds + 1)
    return whole.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(train).cast("long").alias("train_tokens"), (F.col("sum") - F.col("n_tokens") * least).alias("base_score"), "score")


def op5_lm_score(spark, sf_dir: str) -> DataFrame:
    docs = common.read(common.tuned(spark), sf_dir, "documents")
    return score(docs, held_out=common.held_out("doc_id", 7))
