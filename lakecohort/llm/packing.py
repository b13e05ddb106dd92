"""Packing documents into sequences by their length histogram.

Documents are cut into full sequences and a rest. Of all pieces only the histogram of their lengths goes to the driver
(as many bins as a sequence has tokens). There lengths are placed longest first, each into the shortest open pack that
has room, whole bins at a time: what is kept is a pattern (the lengths of a pack) and how many packs have it. Pieces
meet their slot again by their rank among pieces of one length: ranks come from counts by task and length, so that no
task sees more than its own pieces.

Defined results: a null or empty text is the single end token; rows with one doc_id are separate documents; an empty
table gives no rows.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Mapping

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common, tokens

LENGTH = 2048
END_ID = 1
PIECES = "start long, length int, ids_crc32 long, doc_tokens long, part int, rank long"


def plan(histogram: Mapping[int, int], limit: int = LENGTH) -> list[tuple[int, list[int]]]:
    """Patterns (number of packs, lengths in a pack). Each step ends a bin or a pattern, so there are few more than bins."""
    rooms: dict[int, list[tuple[int, list[int]]]] = {}
    heap: list[int] = []  # of rooms, the largest first
    done: list[tuple[int, list[int]]] = []

    def put(count: int, lengths: list[int], room: int) -> None:
        if not room:
            done.append((count, lengths))
            return
        if room not in rooms:
            rooms[room] = []
            heapq.heappush(heap, -room)
        rooms[room].append((count, lengths))

    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            if not heap or -heap[0] < length:
                each = limit // length
                if left >= each:
                    put(left // each, [length] * each, limit - each * length)
                    left %= each
                else:
                    put(1, [length] * left, limit - left * length)
                    left = 0
                continue
            room = -heap[0]
            count, lengths = rooms[room].pop()
            if not rooms[room]:
                del rooms[room]
                heapq.heappop(heap)
            took = min(count, left)
            if count > took:
                put(count - took, lengths, room)
            put(took, [*lengths, length], room - length)
            left -= took
    return done + [x for v in rooms.values() for x in v]


def slots(patterns: list[tuple[int, list[int]]]) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, rank past the last, first sequence, offset) of each place in each pattern."""
    out, ranks, sequence = [], {}, 0
    for count, lengths in patterns:
        offset = 0
        for length in lengths:
            lo = ranks.get(length, 0)
            out.append((length, lo, lo + count, sequence, offset))
            ranks[length] = lo + count
            offset += length
        sequence += count
    return out


def cut(docs: DataFrame, doc_id: str, text: str, tokenizer: str, limit: int) -> DataFrame:
    """Pieces with their task and their rank in it among pieces of one length."""
    source = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    schema = T.StructType([source.schema["doc_id"], *T._parse_datatype_string(PIECES).fields])

    def run(batches):
        encode = tokens.encoder(tokenizer).encode
        end = np.array([END_ID], "<u4").tobytes()
        part, seen = TaskContext.get().partitionId(), [0] * (limit + 1)
        for b in batches:
            owner, rows = [], []
            for i, t in enumerate(b.column(1)):
                ids = encode(t.as_py()) + end
                n = len(ids) // 4
                for at in range(0, n, limit):
                    size = min(limit, n - at)
                    owner.append(i)
                    rows.append((at, size, zlib.crc32(ids[4 * at : 4 * (at + size)]), n, part, seen[size]))
                    seen[size] += 1
            columns = zip(*rows) if rows else [[]] * 6
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(owner, pa.int64())), *(pa.array(c, k) for c, k in zip(columns, kinds))], schema.fieldNames())
        tokens.release()

    return source.mapInArrow(run, schema)


def pack(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", tokenizer: str = "byte_bpe_50k.json", limit: int = LENGTH) -> DataFrame:
    """One row a piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    spark = docs.sparkSession
    pieces = common.Workspace(spark, "packing").table(cut(docs, doc_id, text, tokenizer, limit))
    counts = pieces.groupBy("part", "length").agg(F.count("*").alias("n"))
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # limit rows at most
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    names = ["slot_length", "lo", "hi", "first_sequence", "offset"]
    found = list(zip(*slots(plan(histogram, limit)))) or [()] * len(names)
    # as Arrow, since a list of rows would go through Python workers of its own
    places = spark.createDataFrame(pa.table({n: pa.array(c, pa.int32() if n == "slot_length" else pa.int64()) for n, c in zip(names, found)}))
    ranked = pieces.join(bases, ["part", "length"]).withColumn("rank", F.col("rank") + F.col("base"))
    # the slots are bounded by the bins of the histogram
    placed = ranked.join(F.broadcast(places), (F.col("length") == F.col("slot_length")) & (F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi")))
    return placed.select("doc_id", "start", F.col("length").cast("long").alias("length"), "ids_crc32", "doc_tokens", (F.col("first_sequence") + F.col("rank") - F.col("lo")).alias("sequence_id"), "offset")


def op10_packing(spark, sf_dir: str) -> DataFrame:
    return pack(common.read(common.tuned(spark), sf_dir, "documents"))
