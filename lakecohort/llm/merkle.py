"""A manifest of a dataset as Merkle trees: a root over one tree a source, with a proof for each row.

A row's leaf is a digest of its fields. Within a source leaves stand in order of doc_id and are parted into blocks of 4096.
A block is a whole subtree, so executors work it out alone: an in-process DuckDB runs the level queries (``string_agg`` in
order, then ``sha256``) over the Arrow table of a few blocks at a time. Spark gives each leaf its place, joins blocks' roots
into the upper levels, one aggregation a level, and hands each block the siblings on the way to the root (its outer proof).
A second pass of the block queries proves every leaf against them and folds changed rows up again.

Places come from range partitions: rows are sorted within each, and what lies before a partition follows from one count a
partition and source. So a source that holds most rows is spread over many tasks, and no task holds more than a few blocks.

Defined results: the inputs of the leaf are text as it is; a null field is ``-``. Rows with one doc_id are ordered by their
leaves, a null doc_id comes first; equal rows have equal digests. The null source is the first one, apart from the empty
name. A lone leaf is its source's root, a lone source's root is the root; without any sibling the proof is the digest of the
empty text. An empty table gives no rows. Columns that aren't named are not read.
"""

from __future__ import annotations

from collections.abc import Sequence

import duckdb
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

FAN = 16
#: Levels within a block.
DEEP = 3
BLOCK = FAN**DEEP
#: Rows that a task hands to one query, and then some: whole blocks.
ROWS = 2 * BLOCK
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
DIGEST = 64
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def told(c: Column) -> Column:
    """A field as it enters the leaf: byte count, colon and value, or a hyphen."""
    text = c.cast("string")
    return F.when(c.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def tampered(doc_id: Column) -> Column:
    """Rows whose text is changed to see that it shows."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def leaves(docs: DataFrame, doc_id: str = "doc_id", source: str = "source", fields: Sequence[str] = FIELDS, text: str = "text") -> DataFrame:
    """tree, doc_id, leaf and changed (the leaf after tampering, null without). tree: the source as text that sorts as it should, the null one first."""
    named = {f: F.col(f"`{f}`") for f in fields}
    leaf = lambda f: F.sha2(F.concat(*map(told, f.values())), 256)
    other = leaf(named | {text: F.translate(F.col(f"`{text}`"), UPPER, LOWER)})
    key = F.col(f"`{source}`").cast("string")
    tree = F.when(key.isNull(), "0").otherwise(F.concat(F.lit("1"), key))
    return docs.select(tree.alias("tree"), F.col(f"`{doc_id}`").alias("doc_id"), leaf(named).alias("leaf"), F.when(tampered(F.col(f"`{doc_id}`")), other).alias("changed"))


def placed(work: common.Workspace, rows: DataFrame, order: Sequence[str]) -> DataFrame:
    """rows with pos (the place within the tree, from 0) and n (rows of the tree). The order begins with the tree."""
    tied = rows.withColumn("tie", F.monotonically_increasing_id())  # equal rows can lie in several partitions
    ranged = tied.repartitionByRange(*order, "tie").sortWithinPartitions(*order, "tie").drop("tie")
    known = work.table(ranged.withColumn("part", F.spark_partition_id()).withColumn("row", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))))
    counts = known.groupBy("tree", "part").agg(F.count("*").alias("here"), F.min("row").alias("first"))
    tree = Window.partitionBy("tree")
    before = F.coalesce(F.sum("here").over(tree.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    bases = work.table(counts.select("tree", "part", (before - F.col("first")).alias("base"), F.sum("here").over(tree).alias("n")))  # a row a partition and tree
    return known.join(bases, ["tree", "part"]).withColumn("pos", F.col("row") + F.col("base")).drop("part", "row", "base")


def climb(work: common.Workspace, nodes: DataFrame) -> DataFrame:
    """tree, pos, path (of left and right: siblings beside it, level by level) and top from nodes (tree, n, pos, node) of trees of n nodes.

    Levels are built upwards, then paths come down from parent to at most 16 children, so no key has more rows than that.
    """
    most = nodes.agg(F.max("n")).first()[0] or 0  # one number
    levels, runs, size = [nodes], [], 1
    while most > size:
        members = F.array_sort(F.collect_list(F.struct("pos", "node")))
        run = F.concat_ws("", F.transform(members, lambda x: x["node"]))
        runs.append(work.table(levels[-1].filter(F.col("n") > size).groupBy("tree", "n", F.expr(f"pos div {FAN}").alias("up")).agg(run.alias("run"))))
        levels.append(runs[-1].select("tree", "n", F.col("up").alias("pos"), F.sha2("run", 256).alias("node")))
        size *= FAN
    none = F.array().cast("array<struct<left: string, right: string>>")
    paths = levels[-1].select("tree", "pos", none.alias("path"), F.col("node").alias("top"))
    for level, run in zip(reversed(levels[:-1]), reversed(runs)):
        size //= FAN
        above = paths.join(run.select("tree", F.col("up").alias("pos"), "run"), ["tree", "pos"]).withColumnRenamed("pos", "up")
        own = level.withColumn("up", F.expr(f"pos div {FAN}")).join(above, ["tree", "up"], "left")
        inside = (F.col("pos") % FAN) * DIGEST
        beside = F.struct(F.col("run").substr(F.lit(1), inside.cast("int")).alias("left"), F.col("run").substr((inside + DIGEST + 1).cast("int"), F.lit(FAN * DIGEST)).alias("right"))
        ended = F.col("run").isNull()
        paths = work.table(own.select("tree", "pos", F.when(ended, none).otherwise(F.concat(F.array(beside), "path")).alias("path"), F.when(ended, F.col("node")).otherwise(F.col("top")).alias("top")))
    return paths


_engine: list[duckdb.DuckDBPyConnection] = []


def engine() -> duckdb.DuckDBPyConnection:
    """One for each worker process; it keeps no table."""
    if not _engine:
        _engine.append(duckdb.connect(config={"threads": 1, "memory_limit": "512MB", "temp_directory": ""}))
    return _engine[0]


def runs_sql() -> str:
    """Runs of each level within blocks: r1 of leaves, r2 of their digests, ..."""
    parts, node, size = [], "leaf", 1
    for k in range(1, DEEP + 1):
        below = "leaves" if k == 1 else f"r{k - 1}"
        parts.append(f"r{k} AS (SELECT tree, n, pos // {FAN} AS pos, string_agg({node}, '' ORDER BY pos) AS run FROM {below} WHERE n > {size} GROUP BY tree, n, pos // {FAN})")
        node, size = "sha256(run)", size * FAN
    return ", ".join(parts)


def roots_sql() -> str:
    """tree, n, pos (of the block) and node (its root)."""
    ends = [f"SELECT tree, n, pos, {'leaf' if k == 0 else 'sha256(run)'} AS node FROM {'leaves' if k == 0 else f'r{k}'} WHERE n <= {FAN**k}" + (f" AND n > {FAN ** (k - 1)}" if k else "") for k in range(DEEP)]
    return f"WITH {runs_sql()} {' UNION ALL '.join(ends)} UNION ALL SELECT tree, n, pos, sha256(run) FROM r{DEEP}"


def proofs_sql(outer: int) -> str:
    """Each leaf proved and folded: through its block, then along at most ``outer`` levels above it. Rows with pos < 0 hold what lies above their block."""
    fold, steps, text = "coalesce(l.changed, l.leaf)", [], []
    for k in range(1, DEEP + 1):
        place = f"{DIGEST} * (l.pos // {FAN ** (k - 1)} % {FAN})"
        left, right = f"substr(r{k}.run, 1, {place})", f"substr(r{k}.run, {place} + {DIGEST + 1})"
        steps.append(f"f{k} AS (SELECT p.* REPLACE (CASE WHEN run{k} IS NULL THEN fold ELSE sha256(left{k} || fold || right{k}) END AS fold) FROM f{k - 1} p)")
        text.append((f"r{k}.run AS run{k}, {left} AS left{k}, {right} AS right{k}", f"LEFT JOIN r{k} ON r{k}.tree = l.tree AND r{k}.pos = l.pos // {FAN**k}"))
    last = DEEP
    for k in range(1, outer + 1):
        steps.append(f"f{last + 1} AS (SELECT p.* REPLACE (CASE WHEN len(path) < {k} THEN fold ELSE sha256(path[{k}].left || fold || path[{k}].right) END AS fold) FROM f{last} p)")
        last += 1
    inner = " || ".join(f"coalesce(left{k} || right{k}, '')" for k in range(1, DEEP + 1))
    return (
        f"WITH leaves AS (SELECT * FROM rows WHERE pos >= 0), above AS (SELECT tree, block, path, subroot, root FROM rows WHERE pos < 0), {runs_sql()}, "
        f"f0 AS (SELECT l.doc_id, l.leaf, a.path, a.subroot, a.root, {fold} AS fold, {', '.join(t[0] for t in text)} "
        f"FROM leaves l JOIN above a ON a.tree = l.tree AND a.block = l.block {' '.join(t[1] for t in text)}), {', '.join(steps)} "
        f"SELECT doc_id, leaf, subroot, root, sha256({inner} || coalesce(list_aggregate(list_transform(path, lambda x: x.left || x.right), 'string_agg', ''), '')) AS proof_sha256, "
        f"fold AS folded_root, fold = root AS verified FROM f{last}"
    )


def by_block(rows: DataFrame, table: str, sql: str, schema: str) -> DataFrame:
    """The query over whole blocks (rows of one tree and block), a few at a time."""
    dealt = rows.repartition("tree", "block").sortWithinPartitions("tree", "block", "pos")
    names = [c.split(" ")[0] for c in schema.split(", ")]

    def run(batches):
        def ask(held: pa.Table):
            con = engine()
            con.register(table, held)
            out = con.sql(sql).to_arrow_table()
            con.unregister(table)
            return out.select(names).to_batches()

        held = None
        for b in batches:
            held = pa.Table.from_batches([b]) if held is None else pa.concat_tables([held, pa.Table.from_batches([b])])
            if held.num_rows >= ROWS:
                tree, block = held.column("tree"), held.column("block")
                end = held.num_rows - 1
                last = (tree[end], block[end])
                while end and (tree[end - 1], block[end - 1]) == last:
                    end -= 1
                if end:
                    yield from ask(held.slice(0, end).combine_chunks())
                    held = held.slice(end)
        if held is not None and held.num_rows:
            yield from ask(held.combine_chunks())

    return dealt.mapInArrow(run, schema)


def manifest(docs: DataFrame, doc_id: str = "doc_id", source: str = "source", fields: Sequence[str] = FIELDS, text: str = "text") -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root and verified of each row."""
    work = common.Workspace(docs.sparkSession, "merkle")
    known = placed(work, work.table(leaves(docs, doc_id, source, fields, text)), ["tree", "doc_id", "leaf"]).withColumn("block", F.expr(f"pos div {BLOCK}"))
    above, deepest = outer(work, known)
    rows = known.select("tree", "block", "pos", "n", "doc_id", "leaf", "changed").unionByName(above.withColumn("pos", F.lit(-1).cast("long")), allowMissingColumns=True)
    kind = docs.schema[doc_id].dataType.simpleString()
    return by_block(rows, "rows", proofs_sql(deepest), f"doc_id {kind}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean")


def outer(work: common.Workspace, known: DataFrame) -> tuple[DataFrame, int]:
    """tree, block, path, subroot and root of each block, and the longest path."""
    blocks = work.table(by_block(known.select("tree", "block", "pos", "n", "leaf"), "leaves", roots_sql(), "tree string, n long, pos long, node string"))
    size = F.expr(f"(n + {BLOCK - 1}) div {BLOCK}")
    inside = climb(work, blocks.withColumn("n", size))
    # the tops of the sources are the leaves of one more tree
    tops = inside.filter("pos = 0").select(F.lit("").alias("tree"), F.col("tree").alias("name"), F.col("top").alias("node"))
    ranked = placed(work, tops, ["tree", "name"])
    ways = climb(work, ranked.select("tree", "n", "pos", "node"))
    sources = ranked.select("name", "pos").join(ways, "pos").select(F.col("name").alias("tree"), F.col("path").alias("upper"), F.col("top").alias("root"))
    hot = common.hot_keys(inside.groupBy("tree").agg(F.count("*").alias("n")), "tree")
    joined = common.spread_join(inside, sources, "tree", "pos", hot)
    above = work.table(joined.select("tree", F.col("pos").alias("block"), F.concat("path", "upper").alias("path"), F.col("top").alias("subroot"), "root"))
    return above, above.agg(F.max(F.size("path"))).first()[0] or 0


def roots(docs: DataFrame, doc_id: str = "doc_id", source: str = "source", fields: Sequence[str] = FIELDS, text: str = "text") -> DataFrame:
    """The manifest without proofs: source, subroot and root."""
    work = common.Workspace(docs.sparkSession, "merkle")
    known = placed(work, work.table(leaves(docs, doc_id, source, fields, text).drop("changed")), ["tree", "doc_id", "leaf"]).withColumn("block", F.expr(f"pos div {BLOCK}"))
    above, _ = outer(work, known)
    return above.filter("block = 0").select(F.expr("if(tree = '0', null, substring(tree, 2))").alias("source"), "subroot", "root")


def op12_merkle_manifest(spark, sf_dir: str) -> DataFrame:
    return manifest(common.read(spark, sf_dir, "documents"))
