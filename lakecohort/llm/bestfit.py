"""Packed id matrices by best-fit-decreasing packing.

Each task packs its documents in shards of a bounded number of tokens. Within a shard pieces go longest first into the
fullest row that has room; a segment tree over capacities finds it. Overlong documents are split without loss. A row of
the matrix holds ``limit`` ids (little-endian unsigned integers of 16 bits, or 32 where the vocabulary needs them); past
the last segment it is filled with the end id. Cumulative segment lengths say where segments lie, positions restart at
each of ``position_resets``.

Defined results: a null or empty text is the single end id; rows with one doc_id are separate documents; rows come in
no set order, each under a sequence_id of its own.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common, tokens

LENGTH = 2048
#: Tokens that a task holds before it packs them.
SHARD_TOKENS = 4_000_000
END = "<|endoftext|>"


class CapacityTree:
    """A segment tree over capacities 0..limit: which is the smallest at least x that some open row has?"""

    def __init__(self, limit: int):
        self.width = 1 << limit.bit_length()
        self.counts = [0] * (2 * self.width)

    def add(self, capacity: int, by: int) -> None:
        i = capacity + self.width
        while i:
            self.counts[i] += by
            i >>= 1

    def at_least(self, x: int) -> int | None:
        i = x + self.width
        if self.counts[i]:
            return x
        while i > 1:
            if not i & 1 and self.counts[i + 1]:
                i += 1
                while i < self.width:
                    i = 2 * i if self.counts[2 * i] else 2 * i + 1
                return i - self.width
            i >>= 1
        return None


def best_fit_decreasing(lengths: list[int], limit: int) -> list[list[int]]:
    """Rows of indices of lengths. Equal lengths keep their order; of rows with equal room the last opened is taken."""
    tree, open_rows, rows = CapacityTree(limit), {}, []
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        room = tree.at_least(lengths[i])
        if room is None:
            row, room = len(rows), limit
            rows.append([])
        else:
            row = open_rows[room].pop()
            tree.add(room, -1)
        rows[row].append(i)
        if left := room - lengths[i]:
            open_rows.setdefault(left, []).append(row)
            tree.add(left, 1)
    return rows


def token_matrix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", tokenizer: str = "byte_bpe_50k.json", limit: int = LENGTH, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """One row a packed sequence: sequence_id, doc_ids, doc_starts (a segment's first id in its document), cu_seqlens, position_resets, ids."""
    source = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    kind = source.schema["doc_id"].dataType
    schema = T.StructType([T.StructField("sequence_id", T.LongType()), T.StructField("doc_ids", T.ArrayType(kind)), *T._parse_datatype_string("doc_starts array<long>, cu_seqlens array<int>, position_resets array<int>, ids binary").fields])

    width = "<u2" if tokens.encoder(tokenizer).size <= 1 << 16 else "<u4"
    end_id = tokens.encoder(tokenizer).library().token_to_id(END)

    def run(batches):
        enc = tokens.encoder(tokenizer)
        end = np.array([end_id], width)
        sequence, pieces, held, id_type = TaskContext.get().partitionId() << 33, [], 0, None

        def flush():
            nonlocal sequence, pieces, held
            rows = best_fit_decreasing([len(p[2]) for p in pieces], limit)
            for at in range(0, len(rows), 256):
                out = []
                for row in rows[at : at + 256]:
                    segments = [pieces[i] for i in row]
                    ids = np.full(limit, end_id, width)
                    bounds = np.cumsum([0, *(len(s[2]) for s in segments)])
                    ids[: bounds[-1]] = np.concatenate([s[2] for s in segments])
                    out.append((sequence, [s[0] for s in segments], [s[1] for s in segments], bounds.tolist(), bounds[:-1].tolist(), ids.tobytes()))
                    sequence += 1
                types = (pa.int64(), pa.list_(id_type), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], schema.fieldNames())
            pieces, held = [], 0

        for b in batches:
            id_type = b.column(0).type
            for key, t in zip(b.column(0), b.column(1)):
                ids = np.concatenate((np.frombuffer(enc.encode(t.as_py()), "<u4").astype(width), end))
                key = key.as_py()
                pieces += [(key, at, ids[at : at + limit]) for at in range(0, len(ids), limit)]
                held += len(ids)
                if held >= shard_tokens:
                    yield from flush()
        if pieces:
            yield from flush()
        tokens.release()

    return source.mapInArrow(run, schema)


def position_ids(cu_seqlens: list[int], limit: int = LENGTH) -> np.ndarray:
    """Positions of a row: each segment, and the fill after the last, counts from 0."""
    out = np.arange(limit)
    for a, b in zip(cu_seqlens, [*cu_seqlens[1:], limit]):
        out[a:b] -= a
    return out


def matrix(rows: list[bytes], limit: int = LENGTH, width: str = "<u2") -> np.ndarray:
    """The ids of rows as one matrix."""
    return np.frombuffer(b"".join(rows), width).reshape(-1, limit)


def write(docs: DataFrame, path: str, **options) -> None:
    """Write the matrix with its segments as Parquet, in a folder that all executors reach."""
    token_matrix(docs, **options).write.parquet(path)


def op7_token_matrix(spark, sf_dir: str) -> DataFrame:
    return token_matrix(common.read(common.tuned(spark), sf_dir, "documents"))
