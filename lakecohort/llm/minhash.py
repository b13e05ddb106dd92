"""MinHash near-duplicate removal of documents with sequential Bayesian verification.

Documents whose sets of 5-word shingles have a Jaccard similarity of 0.75 or more are linked; of each component the
document with the smallest id stays. See neardup for candidates and verification.

Defined results: a document without words (null, empty or blank text) is linked with nothing and stays; rows with one
doc_id each have a row in the result and count as one document for component ids; a null doc_id is never the id of a
component that has another, its rows stay if they are linked with nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, neardup

BANDING = neardup.Banding(bands=32, rows=4)


def decide(docs: DataFrame, doc_id: str, text: str, banding: neardup.Banding, work: common.Workspace) -> DataFrame:
    """doc_id, h (hash of the text), n_shingles, component_id and kept of each row."""
    source = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(text).alias("h"), F.col(text).alias("text"))
    drawn = work.table(neardup.sketches(source, ["doc_id", "h"], "text", banding))
    classes = work.table(drawn.filter("digest is not null").groupBy("digest").agg(F.min("doc_id").alias("doc_id"), F.max("bands").alias("bands"), F.count("*").alias("n")), n=F.sum("n"))
    texts = source.select(F.xxhash64("doc_id").alias("key"), "text")
    roots = neardup.link(classes.select("digest", "bands", F.xxhash64("doc_id").alias("key")), common.seen(classes), neardup.whole_texts(texts, banding), banding, work)
    # classes that are alone keep their id; the others and the rows of one text are dealt out where a root or a text is hot
    linked = work.table(classes.select("digest", "doc_id").join(roots, "digest"))
    firsts = linked.groupBy("root").agg(F.min("doc_id").alias("component_id"), F.count("*").alias("n"))
    met = common.spread_join(linked, firsts.drop("n"), "root", "digest", common.hot_keys(firsts.select("root", "n"), "root", common.seen(linked)))
    ids = classes.select("digest", F.col("doc_id").alias("first")).join(met.select("digest", "component_id"), "digest", "left").select("digest", F.coalesce("component_id", "first").alias("component_id"))
    hot = common.hot_keys(classes.select("digest", "n"), "digest", common.seen(classes, "n"))
    out = common.spread_join(drawn.select("doc_id", "h", "n_shingles", "digest").withColumn("place", F.monotonically_increasing_id()), ids, "digest", "place", hot, "left")
    return out.select("doc_id", "h", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id")).withColumn("kept", F.col("component_id").eqNullSafe(F.col("doc_id")))


def deduplicate(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", banding: neardup.Banding = BANDING) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of each row."""
    return decide(docs, doc_id, text, banding, common.Workspace(docs.sparkSession, "minhash")).drop("h")


def keep_first(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", banding: neardup.Banding = BANDING) -> DataFrame:
    """docs with one row of each component: of the smallest id, and of its rows the smallest by all columns.

    Only rows that a prefilter can't clear go through a join; the other texts stay where they are.
    """
    work = common.Workspace(docs.sparkSession, "minhash")
    decided = work.table(decide(docs, doc_id, text, banding, work), gone=F.count_if(~F.col("kept")))
    gone = decided.filter("not kept").select("doc_id", "h")
    lost = neardup.Prefilter(gone.select(F.xxhash64("doc_id", "h").alias("x")), "x", common.seen(decided, "gone"))
    # the row in one column, so that no name can clash
    named = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), F.col(doc_id).alias("id"), F.xxhash64(text).alias("h"))
    named = named.withColumn("maybe", lost.column(F.xxhash64("id", "h")))
    gone = gone.distinct().select(F.col("doc_id").alias("gone_id"), F.col("h").alias("gone_h"))
    checked = named.filter("maybe").join(gone, F.col("id").eqNullSafe(F.col("gone_id")) & (F.col("h") == F.col("gone_h")), "left_anti")
    out = named.filter("not maybe").unionByName(checked)
    twice = work.table(decided.filter("kept and doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1").select("doc_id"))
    if not common.seen(twice):
        return out.select("doc.*")
    again = neardup.Prefilter(twice.select(F.xxhash64("doc_id").alias("x")), "x", common.seen(twice))
    out = out.withColumn("again", again.column(F.xxhash64("id")))
    first = out.filter("again").groupBy("id").agg(F.min("doc").alias("doc"))
    return out.filter("not again").select("doc").unionByName(first.select("doc")).select("doc.*")


def op8_minhash_dedup(spark, sf_dir: str) -> DataFrame:
    return deduplicate(common.read(common.tuned(spark), sf_dir, "documents"))
