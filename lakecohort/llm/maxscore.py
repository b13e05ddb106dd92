"""Exact top-k inner-product search with MaxScore.

Components are quantised to integers. The terms of a query are its dimensions; the postings of a term are the vectors
whose component has the query's sign there, and its bound is the largest product in the shard. With the threshold of the
k-th best score so far, terms whose bounds together can't reach it are non-essential. The postings of essential terms
are traversed for partial scores; the other terms are probed, largest bounds first, for vectors that can still compete.
Ties at the threshold are kept until the end, so results are exact.

Vectors are dealt into shards and queries into blocks of bounded size; each pair of them is one task's work, and the best
of the shards are merged by a window that keeps k rows a query from each task.

Defined results: vectors that are null, empty or hold a null or non-finite component take no part, nor do queries without
an id; vectors of different lengths never meet; in repeated rows each row is a query and a candidate of its own, and only
the query's own row is left out.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

#: Vectors in a shard, queries in a block.
SHARD, QUERIES = 8192, 8192
#: Dimensions that are probed at once.
PROBE = 8
SCALE = 256


def quantised(vectors: DataFrame, vec_id: str, embedding: str, scale: int) -> DataFrame:
    """vec_id, d (length) and v (whole numbers) of the vectors that take part."""
    finite = F.forall(embedding, lambda x: x.isNotNull() & (F.abs(x.cast("double")) < float("inf")) & ~F.isnan(x.cast("double")))
    return vectors.filter(F.col(embedding).isNotNull() & (F.size(embedding) > 0)).filter(finite).select(
        F.col(vec_id).cast("long").alias("vec_id"), F.size(embedding).alias("d"), F.transform(embedding, lambda x: F.floor(x.cast("double") * scale).cast("long")).alias("v")
    )


def exact_type(a: np.ndarray, b: np.ndarray) -> type:
    """The fastest number type in which inner products of the rows are exact."""
    most = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[1]
    return np.float32 if most < 2**24 else np.float64 if most < 2**53 else np.int64


def search(queries: np.ndarray, own: np.ndarray, vectors: np.ndarray, ids: np.ndarray, rows: np.ndarray, k: int):
    """(query, position, score) of each query's k best vectors but its own row (own, rows: row numbers)."""
    kind = exact_type(queries, vectors)
    columns = np.ascontiguousarray(vectors.T).astype(kind)
    high, low = vectors.max(axis=0), vectors.min(axis=0)
    for i, q in enumerate(queries):
        bound = np.maximum(np.maximum(q * high, q * low), 0)
        order = np.argsort(-bound, kind="stable")
        bound, terms = bound[order], q[order].astype(kind)
        rest = np.append(np.cumsum(bound[::-1])[::-1], 0)  # most that the terms from each on can add
        others = rows != own[i]
        # a first threshold from vectors that are strong in the leading term
        lead = columns[order[0]] * terms[0]
        n = min(len(lead), 8 * k + 1)
        first = np.argpartition(-lead, n - 1)[:n]
        first = first[others[first]]
        scores = terms @ columns[np.ix_(order, first)]
        threshold = -np.inf if len(scores) < k else np.partition(scores, -k)[-k]
        # essential: all but the longest tail that can't reach the threshold by itself
        essential = int(np.argmax(rest < threshold)) if rest[-1] < threshold else len(q)
        essential = max(1, essential)
        in_postings = columns[order[0]] * terms[0] > 0
        partial = np.zeros(len(ids), kind)
        for at in range(0, essential, PROBE):
            to = min(at + PROBE, essential)
            part = columns[order[at:to]]
            partial += terms[at:to] @ part
            if threshold > rest[essential]:
                for j in range(at, to):
                    if in_postings.all():
                        break
                    in_postings |= part[j - at] * terms[j] > 0
        alive = others & (partial + rest[essential] >= threshold)
        if threshold > rest[essential]:
            alive &= in_postings
        alive = np.flatnonzero(alive)
        partial, at = partial[alive], essential
        while at < len(q) and len(alive):
            to = min(at + PROBE, len(q))
            partial = partial + terms[at:to] @ columns[np.ix_(order[at:to], alive)]
            keep = partial + rest[to] >= threshold
            alive, partial, at = alive[keep], partial[keep], to
        best = np.lexsort((ids[alive], -partial))[:k]
        for j in best:
            yield i, alive[j], int(partial[j])


def top_k(vectors: DataFrame, is_query: F.Column, k: int = 5, vec_id: str = "vec_id", embedding: str = "embedding", scale: int = SCALE, shard: int = SHARD, block: int = QUERIES) -> DataFrame:
    """query_id, rank, vec_id and score. is_query: which rows are queries, by columns vec_id."""
    work = common.Workspace(vectors.sparkSession, "maxscore")
    table = work.table(quantised(vectors, vec_id, embedding, scale).withColumn("row", F.monotonically_increasing_id()))
    asked = table.filter(is_query & F.col("vec_id").isNotNull())
    shards = max(1, -(-table.count() // shard))
    blocks = max(1, -(-asked.count() // block))
    dealt = F.xxhash64("row")
    left = asked.select("row", "vec_id", "d", "v", F.pmod(dealt, F.lit(blocks)).cast("int").alias("block"), F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"))
    right = table.filter("vec_id is not null").select("row", "vec_id", "d", "v", F.pmod(dealt, F.lit(shards)).cast("int").alias("shard"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))

    def cell(key, q: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(q) and len(c):
            ids, rows = c["vec_id"].to_numpy(), c["row"].to_numpy()
            q_ids, q_rows = q["vec_id"].to_numpy(), q["row"].to_numpy()
            found = search(np.stack(q["v"].to_numpy()), q_rows, np.stack(c["v"].to_numpy()), ids, rows, k)
            out = [(q_rows[i], q_ids[i], ids[j], s) for i, j, s in found]
        return pd.DataFrame(out, columns=["row", "query_id", "vec_id", "score"]).astype("int64")

    keys = ["shard", "block", "d"]
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(cell, "row long, query_id long, vec_id long, score long")
    best = Window.partitionBy("row").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op2_topk_search(spark, sf_dir: str) -> DataFrame:
    return top_k(common.read(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)
