"""Packing whole documents by patterns fitted to the length histogram.

A document that fits in a sequence stays whole; longer ones are cut into full sequences and a rest. Only the histogram of
piece lengths goes to the driver (as many bins as a sequence has tokens). There

* every pattern of two or three lengths of the histogram that fills a sequence is enumerated,
* repeat counts are fitted to the histogram by non-negative least squares, in which long lengths weigh more, as what is left
  of them is hard to place. Patterns enter in blocks that share no length, those with the largest gradient first; after
  each block the counts of all patterns so far are fitted again (projected gradient steps, sped up) and those at zero leave,
  so few patterns carry the fit,
* counts are rounded down, never past what the histogram has, and
* the residual histogram is packed by best fit, longest first, whole bins at a time.

Pieces meet their slot by their rank among pieces of one length, from counts by task and length, so that no task sees more
than its own pieces.

Defined results: a null or empty text is the single end token; rows with one doc_id are separate documents; an empty table
gives no rows; columns beside id and text are not read.
"""

from __future__ import annotations

import json
import os
import unicodedata
import zlib
from array import array
from collections.abc import Mapping

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import bestfit, bpe_count, common, packing

LENGTH = 2048
END_ID = 0
#: Blocks of patterns, steps of each fit, and the power of a length that weighs its residual.
BLOCKS, STEPS, WEIGHT = 12, 300, 1.5
#: Words whose ids a worker remembers; when full it starts again.
CACHE, LONGEST = 500_000, 48
#: What ends a piece; neither it nor a character with such first bytes is printable.
MARK = "\U0010ffff"
PIECES = "piece int, start long, length int, ids_crc32 long, part int, rank long"


class WordIds(dict):
    """A mapping from a word without white space to its ids, as unsigned 32-bit integers in native (little-endian) order.

    Vocabularies of the word-end kind drop white space, so the ids of a text are those of its words. Their merges are given
    to tiktoken as ranks: a mark ends each piece and merges first of all with the piece's last byte. As a token is made of
    tokens of lower ranks only, bytes and pairs lead to the same merges; tests compare ids. Words with a special token's
    string and words with characters that aren't printable (unassigned ones are letters to newer libraries only, private
    ones may look like the mark) go to the tokenizers library.
    """

    def __init__(self, path: str):
        super().__init__()
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.path, self.tokenizer = path, None
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, end = spec["model"]["vocab"], spec["model"]["end_of_word_suffix"]
        symbols = bpe_count.byte_symbols()
        byte, mark = {c: i for i, c in enumerate(symbols)}, MARK.encode()
        known = [(bytes([i]), vocab[c]) for i, c in enumerate(symbols)]
        known += [(mark[:k], 0) for k in range(2, len(mark) + 1)] + [(bytes([i]) + mark, vocab[c + end]) for i, c in enumerate(symbols)]
        for pair in spec["model"]["merges"]:
            token = "".join(pair.split(" ") if isinstance(pair, str) else pair)
            known.append((bytes(byte[c] for c in token.removesuffix(end)) + mark * token.endswith(end), vocab[token]))
        ranks: dict[bytes, int] = {}
        for data, _ in known:
            ranks.setdefault(data, len(ranks))
        ids = dict(reversed(known))  # the first of equal ones counts
        self.ids = np.array([ids[data] for data in ranks], "<u4")
        self.ends = np.array([data.endswith(mark) for data in ranks])
        self.ranks_of = tiktoken.Encoding("words", pat_str=f"[^{MARK}]+{MARK}", mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.pieces = regex.compile(next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")).findall
        self.hint = spec["added_tokens"][0]["content"][:2]

    def exact(self, text: str) -> list[int]:
        """The library's ids."""
        if self.tokenizer is None:
            from tokenizers import Tokenizer

            self.tokenizer = Tokenizer.from_file(self.path)
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def parts(self, word: str) -> list[str] | None:
        """The pieces of a word; None for the library."""
        if self.hint in word or len(word) > LONGEST:
            return None
        if word.isascii():
            plain = word.lower()
            return [plain] if plain.isalpha() else self.pieces(plain)
        if not word.isprintable():
            return None
        plain = unicodedata.normalize("NFC", word)
        # character by character, as the library does; that differs from a whole text's lower case for a final sigma only
        return self.pieces("".join(c.lower() for c in plain) if "\u03a3" in plain else plain.lower())

    def learn(self, words: list[str]) -> None:
        """The ids of new words, all at once."""
        pieces, counts, known = [], [], []
        for word in words:
            if (parts := self.parts(word)) is not None:
                pieces += parts
                counts.append(len(parts))
                known.append(word)
        ranks = np.array(self.ranks_of(MARK.join([*pieces, ""])), np.int64)
        past = np.append(0, np.flatnonzero(self.ends[ranks]) + 1)
        data, at = self.ids[ranks].tobytes(), 0
        for word, end in zip(known, (4 * past[np.cumsum(counts, dtype=np.int64)]).tolist()):
            self[word] = data[at:end]
            at = end

    def __missing__(self, word: str) -> bytes:
        """Long and odd words, which aren't kept."""
        return array("I", self.exact(word)).tobytes()

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        words = list(filter(None, regex.split(r"\p{White_Space}+", text))) if bpe_count.ODD.search(text) else text.split()
        if len(self) > CACHE:
            self.clear()
        found = list(map(self.get, words))
        if None in found:
            self.learn(list({w for w, ids in zip(words, found) if ids is None}))
            found = map(self.__getitem__, words)
        return b"".join(found)


_known: dict[str, WordIds] = {}


def word_ids(name: str) -> WordIds:
    """One for each worker process; name: what public_tokenizers.path takes."""
    if name not in _known:
        _known[name] = WordIds(public_tokenizers.path(name))
    return _known[name]


def patterns(lengths: np.ndarray, limit: int) -> np.ndarray:
    """All (a, b, c), a <= b <= c, of these lengths that add up to limit; a is 0 in pairs."""
    there = np.zeros(limit + 1, bool)
    there[lengths] = True
    there[[0, limit]] = False
    out = []
    for a in np.flatnonzero(there[: limit // 3 + 1]) if limit >= 3 else []:
        b = np.arange(a, (limit - a) // 2 + 1)
        b = b[there[b] & there[limit - a - b]]
        out.append(np.stack([np.full(len(b), a), b, limit - a - b], 1))
    b = np.arange(1, limit // 2 + 1)
    b = b[there[b] & there[limit - b]]
    out.append(np.stack([np.zeros(len(b), int), b, limit - b], 1))
    return np.concatenate(out)


def _used(chosen: np.ndarray, counts: np.ndarray, limit: int) -> np.ndarray:
    """Pieces of each length in so many of the patterns."""
    used = np.bincount(chosen.ravel(), np.repeat(counts, 3), limit + 1)
    used[0] = 0
    return used


def _refit(chosen: np.ndarray, counts: np.ndarray, histogram: np.ndarray, weights: np.ndarray, steps: int) -> np.ndarray:
    """Non-negative counts that bring the weighted squares of what is left down, from these counts on."""
    limit = len(histogram) - 1
    curve = np.bincount(chosen.ravel(), minlength=limit + 1) * weights
    curve[0] = 0
    step = 1 / curve[chosen].sum(1)
    ahead, momentum = counts, 1.0
    for _ in range(steps):
        gradient = ((histogram - _used(chosen, ahead, limit)) * weights)[chosen].sum(1)
        new = np.maximum(ahead + step * gradient, 0)
        faster = (1 + (1 + 4 * momentum**2) ** 0.5) / 2
        ahead = np.maximum(new + (momentum - 1) / faster * (new - counts), 0)
        counts, momentum = new, faster
    return counts


def fit(histogram: np.ndarray, limit: int, blocks: int = BLOCKS, steps: int = STEPS, weight: float = WEIGHT) -> tuple[np.ndarray, np.ndarray]:
    """Patterns and their repeat counts, by non-negative least squares against a histogram (index: length, 0 to limit)."""
    known = patterns(np.flatnonzero(histogram), limit)
    weights = (np.arange(limit + 1) / limit) ** weight
    chosen, counts = np.zeros((0, 3), int), np.zeros(0)
    for _ in range(blocks):
        left = (histogram - _used(chosen, counts, limit)) * weights
        gradient = left[known].sum(1)  # weights[0] is 0
        taken, block = np.zeros(limit + 1, bool), []
        for i in np.argsort(-gradient, kind="stable")[: 10 * limit]:
            if gradient[i] <= 1e-9:
                break
            a, b, c = known[i]
            if not (taken[a] or taken[b] or taken[c]):
                taken[b] = taken[c] = True
                taken[a] = a > 0
                block.append(i)
        if not block:
            break
        chosen, place = np.unique(np.concatenate([chosen, known[block]]), axis=0, return_inverse=True)
        counts = _refit(chosen, np.bincount(place.ravel(), np.concatenate([counts, np.zeros(len(block))])), histogram, weights, steps)
        chosen, counts = chosen[counts > 1e-6], counts[counts > 1e-6]
    return chosen, counts


def rounded(chosen: np.ndarray, counts: np.ndarray, histogram: np.ndarray) -> tuple[list[tuple[int, list[int]]], np.ndarray]:
    """Patterns (number of packs, lengths) with whole counts that the histogram has, and the residual histogram."""
    left, out = histogram.copy(), []
    for i in np.argsort(-counts, kind="stable"):
        lengths = [int(x) for x in chosen[i] if x]
        n = min(int(counts[i]), *(int(left[x]) // lengths.count(x) for x in lengths))
        if n > 0:
            for x in lengths:
                left[x] -= n
            out.append((n, lengths))
    return out, left


def best_fit(histogram: np.ndarray, limit: int) -> list[tuple[int, list[int]]]:
    """Patterns of all pieces, longest first, each into the fullest open pack that has room; a bin at a time."""
    tree, rooms, done = bestfit.CapacityTree(limit), {}, []

    def put(n: int, lengths: list[int], room: int) -> None:
        if not room:
            done.append((n, lengths))
            return
        if room not in rooms:
            rooms[room] = []
            tree.add(room, 1)
        rooms[room].append((n, lengths))

    for length in range(limit, 0, -1):
        left = int(histogram[length])
        while left:
            room = tree.at_least(length)
            if room is None:
                each = limit // length
                if left >= each:
                    put(left // each, [length] * each, limit - each * length)
                    left %= each
                else:
                    put(1, [length] * left, limit - left * length)
                    left = 0
                continue
            n, lengths = rooms[room].pop()
            if not rooms[room]:
                del rooms[room]
                tree.add(room, -1)
            took = min(n, left)
            if n > took:
                put(n - took, lengths, room)
            put(took, [*lengths, length], room - length)
            left -= took
    return done + [x for v in rooms.values() for x in v]


def plan(histogram: Mapping[int, int], limit: int = LENGTH) -> list[tuple[int, list[int]]]:
    """Patterns (number of packs, lengths in a pack) that hold every piece once."""
    counts = np.zeros(limit + 1, np.int64)
    for length, n in histogram.items():
        counts[length] = n
    full = [(int(counts[limit]), [limit])] if counts[limit] else []
    counts[limit] = 0
    fitted, left = rounded(*fit(counts, limit), counts)
    return full + fitted + best_fit(left, limit)


def cut(docs: DataFrame, doc_id: str, text: str, tokenizer: str, limit: int, end_id: int) -> DataFrame:
    """Pieces with their task and their rank in it among pieces of one length."""
    source = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    schema = T.StructType([source.schema["doc_id"], *T._parse_datatype_string(PIECES).fields])

    def run(batches):
        encode = word_ids(tokenizer).encode
        end = np.array([end_id], "<u4").tobytes()
        part, seen = TaskContext.get().partitionId(), [0] * (limit + 1)
        for b in batches:
            owner, rows = [], []
            for i, t in enumerate(b.column(1)):
                ids = encode(t.as_py()) + end
                for piece, start in enumerate(range(0, len(ids) // 4, limit)):
                    own = ids[4 * start : 4 * (start + limit)]
                    owner.append(i)
                    rows.append((piece, start, len(own) // 4, zlib.crc32(own), part, seen[len(own) // 4]))
                    seen[len(own) // 4] += 1
            columns = zip(*rows) if rows else [[]] * 6
            kinds = (pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(owner, pa.int64())), *(pa.array(c, k) for c, k in zip(columns, kinds))], schema.fieldNames())
        word_ids(tokenizer).clear()  # the worker serves other stages after this one

    return source.mapInArrow(run, schema)


def pack(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", tokenizer: str = "word_bpe_49k.json", limit: int = LENGTH, end_id: int = END_ID) -> DataFrame:
    """One row a piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    spark = docs.sparkSession
    pieces = common.Workspace(spark, "patterns").table(cut(docs, doc_id, text, tokenizer, limit, end_id))
    counts = pieces.groupBy("part", "length").agg(F.count("*").alias("n"))
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # limit rows at most
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    names = ["slot_length", "lo", "hi", "first_sequence", "offset"]
    found = list(zip(*packing.slots(plan(histogram, limit)))) or [()] * len(names)
    # as Arrow, since a list of rows would go through Python workers of its own
    places = spark.createDataFrame(pa.table({n: pa.array(c, pa.int32() if n == "slot_length" else pa.int64()) for n, c in zip(names, found)}))
    ranked = pieces.join(bases, ["part", "length"]).withColumn("rank", F.col("rank") + F.col("base"))
    # the slots are bounded by the bins of the histogram and the patterns of the fit
    placed = ranked.join(F.broadcast(places), (F.col("length") == F.col("slot_length")) & (F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi")))
    return placed.select("doc_id", "piece", "start", F.col("length").cast("long").alias("length"), "ids_crc32", (F.col("first_sequence") + F.col("rank") - F.col("lo")).alias("sequence_id"), "offset")


def op11_pattern_packing(spark, sf_dir: str) -> DataFrame:
    return pack(common.read(common.tuned(spark), sf_dir, "documents"))
