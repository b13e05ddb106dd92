"""Session settings that the operators rely on."""

from __future__ import annotations

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
    # long hex literals could be key material
    "spark.sql.redaction.string.regex": "0x[0-9A-Fa-f]{64,}",
}


def session(master: str = "local[*]", **settings: str) -> SparkSession:
    builder = SparkSession.builder.master(master).appName("lakecohort")
    for k, v in (SETTINGS | settings).items():
        builder = builder.config(k, v)
    return builder.getOrCreate()
