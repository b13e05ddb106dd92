"""HMAC-SHA256 from built-in functions, with the key in a one-row table and never in the plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

INNER, OUTER = "__inner_pad", "__outer_pad"
TAG_DIGITS = 12
JITTER_DAYS = 30


def pads(key: bytes) -> tuple[bytes, bytes]:
    """The key XORed with the two pads of HMAC, 64 bytes each."""
    if len(key) > 64:
        raise ValueError("a key has 64 bytes at most")
    block = key.ljust(64, b"\0")
    return bytes(b ^ 0x36 for b in block), bytes(b ^ 0x5C for b in block)


def with_key(df: DataFrame, key: bytes) -> DataFrame:
    """df with the two pads as columns, from one broadcast row: literals would print in plans and logs."""
    row = df.sparkSession.createDataFrame([tuple(map(bytearray, pads(key)))], f"{INNER} binary, {OUTER} binary")
    return df.crossJoin(F.broadcast(row))


def hmac(message: Column) -> Column:
    """Hexadecimal digest of a text, on a table that has gone through with_key."""
    inner = F.sha2(F.concat(F.col(INNER), F.encode(message, "UTF-8")), 256)
    return F.sha2(F.concat(F.col(OUTER), F.unhex(inner)), 256)


def pseudonym(value: Column, label: str) -> Column:
    """label_ and 12 digits; the label keeps the names of one domain from those of another. Blank stays as it is."""
    value = value.cast("string")
    made = F.concat(F.lit(f"{label}_"), F.substring(hmac(F.concat(F.lit(f"{label}:"), value)), 1, TAG_DIGITS))
    return F.when(value.isNull() | (F.trim(value) == ""), value).otherwise(made)


def offset(subject: Column, days: int = JITTER_DAYS) -> Column:
    """A number of days from -days to days that is the same for all dates of a subject."""
    return (F.conv(F.substring(hmac(subject.cast("string")), 1, 8), 16, 10).cast("long") % (2 * days + 1) - days).cast("int")
