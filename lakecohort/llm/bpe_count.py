"""Token counts by byte-pair merging over a heap and a linked list.

The count of a word is its initial symbols less its merges; no token identifier is made. The rules are read from a
public tokenizer file of the word-end kind (NFC, white space collapsed, lower case, a splitting pattern, byte level).

Defined results: a null text counts as empty and has 0 tokens; the strings of special tokens inside a text are one
token each, as the library takes them; equal ranks merge from the left.
"""

from __future__ import annotations

import heapq
import json
import re
import unicodedata

import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

OVER = 2048
#: Words whose counts a worker remembers; when full it starts again, so memory is bounded.
CACHE = 400_000
SHIFT, NONE = 32, -1
#: Separators that Python takes for white space and Unicode's White_Space doesn't.
ODD = re.compile(r"[\x1c-\x1f]")


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class Counter(dict):
    """A mapping from a word without white space to its number of tokens; missing words are worked out."""

    def __init__(self, path: str):
        super().__init__()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.end = model["end_of_word_suffix"] or ""
        self.pieces: dict[str, int] = {}
        vocab = model["vocab"]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        # symbols are numbers while they merge; a pair of them is one number
        self.ranks = {vocab[a] << SHIFT | vocab[b]: i for i, (a, b) in enumerate(pairs)}
        self.made = [vocab[a + b] for a, b in pairs]
        symbols = byte_symbols()
        self.inner, self.last = [vocab[s] for s in symbols], [vocab[s + self.end] for s in symbols]
        self.pattern = regex.compile(next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split"))
        self.special = regex.compile("|".join(regex.escape(t["content"]) for t in sorted(spec["added_tokens"], key=lambda t: -len(t["content"]))))
        self.hint = spec["added_tokens"][0]["content"][:2]

    def merge(self, piece: str) -> int:
        """Tokens of one piece of the splitting pattern."""
        if (known := self.pieces.get(piece)) is not None:
            return known
        data = piece.encode("utf-8", "replace")
        n = count = len(data)
        if not n:
            return 0
        parts = [self.inner[b] for b in data[:-1]]
        parts.append(self.last[data[-1]])
        rank, made = self.ranks.get, self.made
        left, right = list(range(-1, n - 1)), list(range(1, n + 1))
        at = [rank(a << SHIFT | b, NONE) for a, b in zip(parts, parts[1:])]  # the rank of each pair by its left symbol
        at.append(NONE)
        heap = [r * n + i for i, r in enumerate(at) if r != NONE]
        heapq.heapify(heap)
        while heap:
            r, i = divmod(heapq.heappop(heap), n)
            if at[i] != r:
                continue  # one of the two has been merged since
            j = right[i]
            k = right[i] = right[j]
            parts[i], at[j] = made[r], NONE
            count -= 1
            at[i] = NONE
            if k < n:
                left[k] = i
                if (r := rank(parts[i] << SHIFT | parts[k], NONE)) != NONE:
                    at[i] = r
                    heapq.heappush(heap, r * n + i)
            if (h := left[i]) >= 0:
                at[h] = r = rank(parts[h] << SHIFT | parts[i], NONE)
                if r != NONE:
                    heapq.heappush(heap, r * n + h)
        if n <= 64:
            if len(self.pieces) >= CACHE:
                self.pieces.clear()
            self.pieces[piece] = count
        return count

    def __missing__(self, word: str) -> int:
        plain = word.lower() if word.isascii() else "".join(c.lower() for c in unicodedata.normalize("NFC", word))
        n = sum(map(self.merge, self.pattern.findall(plain)))
        if len(word) <= 64:
            if len(self) >= CACHE:
                self.clear()
            self[word] = n
        return n

    def _plain(self, text: str) -> int:
        chunks = regex.split(r"\p{White_Space}+", text) if ODD.search(text) else text.split()
        return sum(map(self.__getitem__, chunks))

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        if self.hint in text:
            found = self.special.findall(text)
            return len(found) + sum(map(self._plain, self.special.split(text))) if found else self._plain(text)
        return self._plain(text)


_counters: dict[str, Counter] = {}


def counter(path: str) -> Counter:
    """One for each worker process."""
    if path not in _counters:
        _counters[path] = Counter(path)
    return _counters[path]


def count_tokens(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", tokenizer: str = "word_bpe_49k.json", over: int = OVER) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit of each row. tokenizer: a name that public_tokenizers.path takes."""
    source = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes"), F.col(text).alias("text"))
    schema = source.select("doc_id", "n_bytes", F.lit(0).cast("long").alias("n_tokens")).schema

    def run(batches):
        count = counter(public_tokenizers.path(tokenizer)).count
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([count(t.as_py()) for t in b.column(2)], pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    return source.mapInArrow(run, schema).withColumn("over_limit", F.col("n_tokens") > over)


def op3_token_counts(spark, sf_dir: str) -> DataFrame:
    return count_tokens(common.read(common.tuned(spark), sf_dir, "documents"))
