"""How filters act on one another: every order of five filters is replayed over all documents.

Each document becomes its source, a mask of the filters that it fails and its labels. Documents are crossed with the 120
orders (a broadcast table of fixed size); the first filter of an order that a document fails removes it there; the five
steps are exploded and added up by source, order and step. Sums are made where the rows are, so what crosses the network
is one row a source, order, step and task, whatever the number of documents.

Filters: A under 50 words, B few distinct words, C many capitals, D a symbol, E a text that a smaller doc_id has. Words are
parted by ASCII white space.

Defined results: a null text counts as empty; texts are compared whole, null and empty ones are alike; rows with one doc_id
are documents of their own and no copies of each other; a document without doc_id has no smaller one and makes no other a
copy. Of several labels of a document one with 1 is enough; one without labels is neither good nor toxic. A null source is
the part with the empty name. No documents: no rows. Other columns are not read.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

FILTERS = "ABCDE"
MIN_WORDS = 50
#: Distinct words and capitals in hundredths of words and of code points.
DISTINCT, CAPITALS = 65, 5
SYMBOLS = r"[#$%&*|]"
COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")


def own_failures(text: Column) -> list[Column]:
    """Does a text fail A, B, C, D?"""
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    capitals = F.length(F.regexp_replace(text, "[^A-Z]+", ""))
    return [
        F.size(words) < MIN_WORDS,
        100 * F.size(F.array_distinct(words)) < DISTINCT * F.size(words),
        100 * capitals > CAPITALS * F.length(text),
        text.rlike(SYMBOLS),
    ]


def failures(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """doc_id, part and mask (bit k: fails filter k) of each document; written once, since copies need a second look."""
    plain = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(source).cast("string"), F.lit("")).alias("part"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    own = sum((F.when(fails, 1 << k).otherwise(0) for k, fails in enumerate(own_failures(F.col("text")))), F.lit(0))
    known = common.Workspace(docs.sparkSession, "audit").table(plain.select("doc_id", "part", own.cast("int").alias("mask"), F.unhex(F.sha2("text", 256)).alias("digest")))
    texts = known.groupBy("digest").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).filter("n > 1")
    copies = common.hot_keys(texts.select("digest", "n"), "digest", known.count())
    met = common.spread_join(known.withColumn("place", F.monotonically_increasing_id()), texts.drop("n"), "digest", "place", copies, "left")
    later = F.coalesce(F.col("doc_id") > F.col("first"), F.lit(False))
    return met.select("doc_id", "part", F.col("mask").bitwiseOR(F.when(later, 1 << FILTERS.index("E")).otherwise(0)).alias("mask"))


def labelled(masks: DataFrame, labels: DataFrame) -> DataFrame:
    """part, mask, good and toxic (0 or 1)."""
    one = lambda c: F.max(F.when(F.col(c) == 1, 1).otherwise(0)).alias(c)
    known = labels.groupBy("doc_id").agg(one("quality"), one("toxic"))
    return masks.join(known, "doc_id", "left").select("part", "mask", F.coalesce("quality", F.lit(0)).alias("good"), F.coalesce("toxic", F.lit(0)).alias("toxic"))


def orders(spark) -> DataFrame:
    """filter_order and the bits of its filters, first to last: 120 rows."""
    rows = spark.range(1).select(F.explode(F.array(*[F.lit("".join(p)) for p in permutations(FILTERS)])).alias("filter_order"))
    bit = F.array(*[F.lit(1 << k) for k in range(len(FILTERS))])
    bits = [F.element_at(bit, F.position(letter, F.lit(FILTERS))) for letter in (F.substring("filter_order", k, 1) for k in range(1, len(FILTERS) + 1))]
    return rows.select("filter_order", F.array(*bits).alias("bits"))


def replay(flags: DataFrame) -> DataFrame:
    """part, filter_order, step and counts from part, mask, good and toxic of each document."""
    steps = len(FILTERS)
    crossed = flags.crossJoin(F.broadcast(orders(flags.sparkSession)))
    first = F.coalesce(*[F.when(F.col("mask").bitwiseAND(F.col("bits")[k]) != 0, k + 1) for k in range(steps)], F.lit(steps + 1))
    each = crossed.withColumn("first", first).select("part", "filter_order", "first", "mask", "good", "toxic", F.posexplode("bits").alias("at", "bit"))
    step = F.col("at") + 1
    here, fails = F.col("first") == step, F.col("mask").bitwiseAND(F.col("bit")) != 0
    when = {
        "kept": F.col("first") > step, "removed": here, "redundant": fails & (F.col("first") < step), "unique_fails": F.col("mask") == F.col("bit"),
        "good_lost": here & (F.col("good") == 1), "toxic_lost": here & (F.col("toxic") == 1),
    }
    return each.groupBy("part", "filter_order", step.cast("int").alias("step")).agg(*[F.sum(F.when(when[c], F.lit(1)).otherwise(F.lit(0)).cast("long")).alias(c) for c in COUNTS])


def audit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """One row a part, filter_order and step, with shapley: what its filter removes in that part over all orders."""
    known = labels.select("doc_id", "quality", "toxic")
    counts = replay(labelled(failures(docs, doc_id, text, source), known)).withColumn("filter", F.expr("substring(filter_order, step, 1)"))
    # 120 rows a part and filter
    return counts.withColumn("shapley", F.sum("removed").over(Window.partitionBy("part", "filter"))).select("part", "filter_order", "step", *COUNTS, "shapley")


def op13_filter_audit(spark, sf_dir: str) -> DataFrame:
    common.tuned(spark)
    return audit(common.read(spark, sf_dir, "documents"), common.read(spark, sf_dir, "labels"))
