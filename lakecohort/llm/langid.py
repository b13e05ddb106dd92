"""Language identification by compression.

Each language has a raw-content zstandard dictionary, made from a bounded sample of labelled texts. A text goes,
in blocks that together hold all of it, through one compressor a language; the language with the smallest total
wins. Sizes that lie close together leave the text undecided: it is rejected, with its best guess kept.

Defined results: a text that is null or has no letter is ``und`` with score 0 and rejected; equal sizes go to the
language with the larger sample, then to the first by name; with no labelled text at all everything is ``und``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import regex
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Bound on the fitting sample: so many texts a language, and so many characters of each, from a place that the text's
#: hash sets. Many short pieces keep a passage that a language's texts quote from filling its dictionary.
SAMPLE_TEXTS = 1024
SAMPLE_CHARS = 160
#: Bytes of text that are compressed at once. Short blocks keep the dictionary in use throughout long texts.
BLOCK = 2048
LEVEL = 3
#: A text is rejected if the smallest size is ahead by less than this share of the text, or by no byte.
MARGIN = 0.002
UNDETERMINED = "und"
#: A letter by its Unicode category; number characters such as ½ or Ⅷ are none.
LETTER = regex.compile(r"\p{L}")


def sample(docs: DataFrame, text: str = "text", lang: str = "lang", texts: int = SAMPLE_TEXTS) -> dict[str, list[str]]:
    """At most ``texts`` labelled texts a language: of each hash bucket of a language the text with the smallest hash.

    The aggregation is combined before the shuffle, so a language that holds most rows costs no more than others.
    """
    h = F.xxhash64(F.col(text))
    rows = (
        docs.filter(F.col(text).isNotNull() & F.col(lang).isNotNull() & F.col(text).rlike(r"\p{L}"))
        .select(F.col(lang).alias("lang"), F.substring(F.col(text), (F.pmod(h, F.greatest(F.length(text) - SAMPLE_CHARS, F.lit(1)))).cast("int") + 1, F.lit(SAMPLE_CHARS)).alias("text"), h.alias("h"), F.pmod(h, F.lit(texts)).alias("bucket"))
        .groupBy("lang", "bucket")
        .agg(F.min(F.struct("h", "text")).alias("x"))
        .select("lang", "bucket", F.col("x.text").alias("text"))
        .collect()
    )
    out: dict[str, list[str]] = {}
    for r in sorted(rows, key=lambda r: (r["lang"], r["bucket"])):
        out.setdefault(r["lang"], []).append(r["text"])
    return out


class Classifier:
    def __init__(self, samples: dict[str, list[str]]):
        self.langs = sorted(samples, key=lambda k: (-sum(map(len, samples[k])), k))
        self.dictionaries = [" ".join(samples[k]).lower().encode() for k in self.langs]
        self._compressors = None

    def __getstate__(self):
        return self.__dict__ | {"_compressors": None}

    def compressors(self):
        if self._compressors is None:
            self._compressors = []
            for d in self.dictionaries:
                z = zstandard.ZstdCompressionDict(d, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
                z.precompute_compress(level=LEVEL)
                self._compressors.append(zstandard.ZstdCompressor(dict_data=z, write_checksum=False, write_content_size=False, write_dict_id=False))
        return self._compressors

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """(language, score from 0 to 1, rejected)."""
        if not text or not self.langs or not LETTER.search(text):
            return UNDETERMINED, 0.0, True
        data = text.lower().encode("utf-8", "replace")
        blocks = [data[i : i + BLOCK] for i in range(0, len(data), BLOCK)]
        sizes = np.array([sum(len(c.compress(b)) for b in blocks) for c in self.compressors()], float)
        best = int(sizes.argmin())
        score = float(1 / np.exp2(sizes[best] - sizes).sum())
        ahead = float(np.delete(sizes, best).min() - sizes[best]) if len(sizes) > 1 else float(len(data))
        return self.langs[best], score, ahead < max(1.0, MARGIN * len(data))


def cleaned(samples: dict[str, list[str]], rounds: int = 2) -> dict[str, list[str]]:
    """The sample without texts whose label a model of the other half denies: labels can be wrong. No language loses all of its texts."""
    for _ in range(rounds):
        halves = [{k: v[i::2] or v for k, v in samples.items()} for i in (0, 1)]
        models = [Classifier(h) for h in halves]
        kept = {k: [t for i, t in enumerate(v) if models[1 - i % 2].predict(t)[0] == k] for k, v in samples.items()}
        samples = {k: v or samples[k] for k, v in kept.items()}
    return samples


def fit(docs: DataFrame, text: str = "text", lang: str = "lang") -> Classifier:
    return Classifier(cleaned(sample(docs, text, lang)))


def identify(docs: DataFrame, model: Classifier, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` (all, if None) with lang_pred, lang_score and lang_rejected, which replace columns of these names. The model's size is bounded by the sample."""
    made = ("lang_pred", "lang_score", "lang_rejected")
    keep = [c for c in (docs.columns if keep is None else keep) if c not in made]
    source = docs.select(*[F.col(f"`{c}`") for c in keep], F.col(text).alias("__text"))
    schema = docs.select(*[F.col(f"`{c}`") for c in keep], F.lit("").alias("lang_pred"), F.lit(0.0).alias("lang_score"), F.lit(False).alias("lang_rejected")).schema

    def run(batches):
        for b in batches:
            found = [model.predict(t.as_py()) for t in b.column(b.num_columns - 1)]
            columns = [b.column(i) for i in range(b.num_columns - 1)]
            columns += [pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64()), pa.array([x[2] for x in found], pa.bool_())]
            yield pa.RecordBatch.from_arrays(columns, schema.fieldNames())

    return common.positional(source).mapInArrow(run, schema)


def op1_language_id(spark, sf_dir: str) -> DataFrame:
    docs = common.read(common.tuned(spark), sf_dir, "documents").select("doc_id", "text", "lang")
    model = fit(docs.filter(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 != 2))
    found = identify(docs, model, keep=["doc_id"])
    return found.select("doc_id", common.held_out("doc_id", 4).alias("held_out"), "lang_pred", F.col("lang_score").alias("score"), F.col("lang_rejected").alias("rejected"))
