"""De-identification and text gates on streams: the scrub has no state, so the batch projection serves as it is."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from lakecohort.functions import phi
from lakecohort.operators import deid


def read(spark: SparkSession, path: str, schema: T.StructType, kind: str = "parquet", files_per_batch: int = 100) -> DataFrame:
    return spark.readStream.format(kind).schema(schema).option("maxFilesPerTrigger", files_per_batch).load(path)


def scrub(stream: DataFrame, rules: deid.Rules, key: bytes, target: str, quarantine: str, checkpoint: str) -> StreamingQuery:
    """Write scrubbed rows to target and rows without a subject id to quarantine, each batch as a whole."""

    def write(batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        good, orphans = deid.quarantine(batch, rules)
        # a batch that runs again replaces what it wrote
        deid.scrub(good, rules, key).write.mode("overwrite").parquet(f"{target}/batch={number}")
        orphans.write.mode("overwrite").parquet(f"{quarantine}/batch={number}")
        batch.unpersist()

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def gate_counts(stream: DataFrame, text: str, at: str, window: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Texts and blocked texts by time window; rows that come later than the watermark are left out."""
    hit = phi.blocked(F.coalesce(F.col(text), F.lit("")))
    return stream.withWatermark(at, late).groupBy(F.window(at, window)).agg(F.count("*").alias("texts"), F.sum(hit.cast("long")).alias("blocked"))
