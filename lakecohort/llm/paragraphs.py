"""Substring removal by paragraph MinHash banding, then of repeated runs of words.

A paragraph is a line of a text. Paragraphs of at least ``min_words`` words are units of the near-duplicate search: their
classes are banded, colliding ones joined, verified by exact Jaccard similarity of 5-word shingles and clustered by
components. Of each component the first paragraph (by document, then by place) stays; the others are cut out, in every
document and within one.

In what is left, passages are looked for whatever the lines: of a run of ``passages.RUN`` words that occurs more than
once only the first stays, so a passage inside longer lines, over several lines or with other line breaks goes too.

A document keeps its other lines as they are. Where a removed line's neighbours meet they are joined by one line feed.
With ``within=False`` what only one document repeats stays: then just repetition across documents is removed.

Defined results: null and empty texts come back as they are; rows with one doc_id are told apart by the hash of their
texts, and rows with one doc_id and one text are one document; a row with a null doc_id comes last in the order that
decides which paragraph stays.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common, neardup, passages, textkit

#: (1 - 0.75**3)**16 is 0.00016: the share of pairs at the threshold that no band brings together.
BANDING = neardup.Banding(bands=16, rows=3)
MIN_WORDS = 20


def lines(column: pa.Array, min_words: int):
    """Of slices of a column of texts, the lines of so many words: (words, which of its rows the lines are, each line's text, each line's place in its text)."""
    column = common.strings(column)
    for a, b in common.byte_slices(column, textkit.SLICE_BYTES):
        data, offsets = common.text_buffer(column.slice(a, b - a))
        if not len(data):
            continue
        breaks = np.flatnonzero(data == 0x0A) + 1
        bounds = np.unique(np.concatenate((offsets, breaks)))
        w = textkit.words(data, bounds)
        long = np.flatnonzero(np.diff(w.first) >= min_words)
        owner = np.searchsorted(offsets, bounds[long], "right") - 1
        place = np.searchsorted(breaks, bounds[long], "right") - np.searchsorted(breaks, offsets[owner], "right")
        yield w, long, a + owner, place.astype(np.int32)


def line_keys(rows: np.ndarray, place: np.ndarray) -> np.ndarray:
    """A hash of each line from its row's hash and its place."""
    return textkit.mix(rows.view(np.uint64) + (place.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)).view(np.int64)


def sketches(rows: DataFrame, min_words: int, banding: neardup.Banding | None) -> DataFrame:
    """unit (n: d is null, d, h, p, and key: its hash), digest and bands (null without a banding) of the lines of rows (d, h, text)."""
    source = rows.select("d", "h", F.xxhash64("d", "h").alias("key"), "text")
    schema = T.StructType([source.schema["d"], *T._parse_datatype_string("h long, p int, key long, digest binary, bands array<long>").fields])

    def run(batches):
        c = banding.coefficients() if banding else None
        for b in batches:
            keys = b.column(2).to_numpy()
            for w, long, owner, place in lines(b.column(3), min_words):
                if not len(long):
                    continue
                sets = textkit.shingle_sets(w, rows=long)
                bands = list(neardup.band_keys(neardup.signatures(sets, c), banding)) if banding else [None] * len(sets)
                at = pa.array(owner)
                yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at), pa.array(place), pa.array(line_keys(keys[owner], place)), pa.array(map(neardup.digest, sets), pa.binary()), pa.array(bands, pa.list_(pa.int64()))], schema.fieldNames())

    return source.mapInArrow(run, schema).select(F.struct(F.col("d").isNull().alias("n"), "d", "h", "p", "key").alias("unit"), "digest", "bands")


def full_lines(rows: DataFrame, min_words: int, banding: neardup.Banding):
    """For neardup.link: the full sets of lines whose keys are wanted."""
    source = rows.select(F.xxhash64("d", "h").alias("key"), "text")

    def full(wanted: neardup.Prefilter) -> DataFrame:
        def run(batches):
            c = banding.coefficients()
            for b in batches:
                keys = b.column(0).to_numpy()
                for w, long, owner, place in lines(b.column(1), min_words):
                    chosen = long[wanted.passes(line_keys(keys[owner], place))]
                    yield neardup.full_batch(textkit.shingle_sets(w, rows=chosen), c)

        return source.mapInArrow(run, neardup.FULL)

    return full


def row_key(doc_id: str, text: str) -> F.Column:
    return F.struct(F.col(doc_id).alias("d"), F.xxhash64(text).alias("h"))


def repeated(docs: DataFrame, work: common.Workspace, doc_id: str, text: str, min_words: int, banding: neardup.Banding, within: bool) -> DataFrame:
    """(row, places, line_firsts) of the lines to cut, and the documents that keep them."""
    source = docs.select(F.col(doc_id).alias("d"), F.xxhash64(text).alias("h"), F.col(text).alias("text"))
    drawn = sketches(source, min_words, banding)
    classes = work.table(drawn.groupBy("digest").agg(F.min("unit").alias("unit"), F.max("unit").alias("last"), F.max("bands").alias("bands"), F.count("*").alias("n")), n=F.sum("n"))
    roots = neardup.link(classes.select("digest", "bands", "unit.key"), common.seen(classes), full_lines(source, min_words, banding), banding, work)
    linked = classes.select("digest", "unit", "last").join(roots, "digest", "left").withColumn("root", F.coalesce("root", "digest"))
    apart = lambda x: x if within else F.struct(f"{x}.n", f"{x}.d", f"{x}.h")
    stays = linked.groupBy("root").agg(F.min("unit").alias("stays"), (~F.min(apart("unit")).eqNullSafe(F.max(apart("last")))).alias("several")).filter("several")
    kept = work.table(linked.join(stays, "root").select("digest", "stays"))
    # which lines there are is worked out again: that costs less than keeping their signatures
    hot = common.hot_keys(classes, "digest", common.seen(classes, "n"))
    cut = common.spread_join(sketches(source, min_words, None).select("unit", "digest"), kept, "digest", "unit", hot).filter("unit != stays")
    return cut.groupBy(F.struct("unit.d", "unit.h").alias("row")).agg(F.sort_array(F.collect_set("unit.p")).alias("places"), F.collect_set("stays.d").alias("line_firsts"))


def remove(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS, banding: neardup.Banding = BANDING, within: bool = True) -> DataFrame:
    """docs with the text after the cuts, and removed_places (lines; null: none), removed_words (in lines and in passages) and first_ids.

    first_ids: sorted ids of the documents that keep what was cut (the id itself, if it is in the same document).
    within: cut what only one document repeats, too.
    """
    work = common.Workspace(docs.sparkSession, "paragraphs")
    # the row in one column, so that no name can clash
    named = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), row_key(doc_id, text).alias("row"))
    rest, joined = marked(named, work.table(repeated(docs, work, doc_id, text, min_words, banding, within)), "places", "line_firsts")
    by_line = work.table(cut_lines(rest.unionByName(joined), text))
    runs = work.table(passages.repeated(by_line.select("row", "text"), work, within))
    rest, joined = marked(by_line, runs, "starts", "run_firsts")
    whole = rest.select("*", F.col("text").alias("cut_text"), F.col("words").alias("cut_words"))
    cut = joined.withColumn("made", passages.cut("text", "starts")).select("*", F.col("made.text").alias("cut_text"), (F.col("words") + F.col("made.words")).alias("cut_words")).drop("made")
    return result(whole.unionByName(cut), docs.columns, text)


def marked(named: DataFrame, cuts: DataFrame, column: str, firsts: str) -> tuple[DataFrame, DataFrame]:
    """named with the two columns of the table cuts of the same row (null: none): rows that a prefilter clears, and the others, which go through the join."""
    touched = neardup.Prefilter(cuts.select(F.xxhash64("row").alias("h")), "h", common.seen(cuts))
    named = named.withColumn("cut", touched.column(F.xxhash64("row")))
    # compared field by field, as doc_id may be null; a merge join parts the prefilter's stage from what follows, so that
    # a task needs one Python worker, not one for each step
    cuts = cuts.select(F.col("row").alias("cut_row"), column, firsts).hint("merge")
    joined = named.filter("cut").join(cuts, F.col("row").eqNullSafe(F.col("cut_row")), "left").drop("cut_row")
    rest = named.filter("not cut").select("*", *[F.lit(None).cast(cuts.schema[c].dataType).alias(c) for c in (column, firsts)])
    return rest.drop("cut"), joined.drop("cut")


def cut_lines(docs: DataFrame, text: str) -> DataFrame:
    """doc, row, the text after the cuts at places, places, firsts and how many words went."""
    whole = F.col("doc").getField(text)
    # what stays are the slices between cut lines, so the work follows the text's lines; lines are bound once, as x
    before, after = F.concat(F.array(F.lit(-1)), "places"), lambda x: F.concat("places", F.array(F.size(x)))
    between = lambda x, ends, begin, k: F.slice(x, begin + 2, ends[k] - begin - 1)
    kept = lambda x: F.transform(F.array(after(x)), lambda ends: F.flatten(F.transform(before, lambda begin, k: between(x, ends, begin, k))))[0]
    lost = lambda x: F.transform("places", lambda k: x[k])
    made = F.transform(F.array(F.split(whole, "\n")), lambda x: F.struct(F.array_join(kept(x), "\n").alias("kept"), F.array_join(lost(x), " ").alias("lost")))[0]
    docs = docs.withColumn("made", F.when(F.col("places").isNotNull(), made))
    words = F.size(F.filter(F.split("made.lost", r"[ \t\n\x0B\f\r]+"), lambda w: w != ""))
    none = F.col("places").isNull()
    return docs.select("doc", "row", F.when(none, whole).otherwise(F.col("made.kept")).alias("text"), "places", "line_firsts", F.when(none, 0).otherwise(words).cast("long").alias("words"))


def result(docs: DataFrame, columns: list[str], text: str) -> DataFrame:
    """The columns of doc with the text after all cuts, and removed_places, removed_words and first_ids in place of columns of these names."""
    made = docs.select("doc", "places", "cut_text", "cut_words", *(F.coalesce(c, F.array().cast(docs.schema[c].dataType)).alias(c) for c in ("line_firsts", "run_firsts")))
    names = ("removed_places", "removed_words", "first_ids")
    return made.select(
        *[(F.col("cut_text") if c == text else F.col("doc").getField(c)).alias(c) for c in columns if c not in names],
        F.col("places").alias("removed_places"),
        F.col("cut_words").alias("removed_words"),
        F.sort_array(F.array_union("line_firsts", "run_firsts")).alias("first_ids"),
    )


def op6_substring_dedup(spark, sf_dir: str) -> DataFrame:
    """doc_id, removed (was anything cut), first_ids (documents that keep it), removed_words and the text after the cuts."""
    docs = common.read(common.tuned(spark), sf_dir, "documents").select("doc_id", "text")
    found = remove(docs, within=False)
    return found.select("doc_id", (F.col("removed_words") > 0).alias("removed"), "first_ids", "removed_words", "text")
