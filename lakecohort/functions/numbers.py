"""Numeric coercion, recoding and derived clinical variables as columns."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

NUMERIC = r"^[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?$"
FLAGS = ("t", "true", "y", "yes", "1", "f", "false", "n", "no", "0")
# what Spark's casts of texts trim; for doubles, all but the last
_BLANKS, _DECIMALS, _HEX = r"[\x00-\x20\x7F]*+", r"(?:[0-9]++\.?[0-9]*+|\.[0-9]++)(?:[eE][+-]?[0-9]++)?[fFdD]?", r"0[xX][0-9a-fA-F]*+\.?[0-9a-fA-F]*+[pP][+-]?[0-9]++[fFdD]?"
#: Every text that Spark casts to the kind looks like this, and hardly any other.
LOOKS = {
    "bigint": rf"{_BLANKS}[+-]?0*+[0-9]{{0,19}}+(?<=[0-9]){_BLANKS}",
    "double": rf"[\x00-\x20]*+[+-]?(?:{_DECIMALS}|{_HEX}|(?i:nan|inf|infinity))[\x00-\x20]*+",
    "boolean": rf"{_BLANKS}(?i:{'|'.join(FLAGS)}){_BLANKS}",
}
#: Numbers that need no cast to tell what they are.
PLAIN = r"^[+-]?+[0-9]{1,18}+(?:\.[0-9]*+)?+\z"
# Height from knee height and age, in centimetres and years.
KNEE, AGE, BASE = 2.02, -0.04, 64.19


def _key(c: Column) -> Column:
    return F.lower(F.trim(c.cast("string")))


def to_number(c: Column) -> Column:
    """A number or null; text such as '12d' that Java reads as a number is null."""
    text = F.trim(c.cast("string"))
    return F.when(text.rlike(NUMERIC), text.try_cast("double"))


def as_kind(c: Column, kind: str) -> Column:
    """What try_cast makes of a text: a bigint, double or boolean, or null.

    A cast that fails makes an exception, which costs more than the rest of a row; so only what looks like the kind is cast.
    """
    return F.when(c.rlike(f"^{LOOKS[kind]}$"), c.try_cast(kind))


def kinds(c: Column) -> Column:
    """Which kinds a text can be cast to, as a sum of 1 (bigint), 2 (double) and 4 (boolean); null for null. Most texts take one or two patterns."""
    number = F.when(c.contains("."), 2).when(c.isin("0", "1"), 7).otherwise(3)
    odd = sum((F.when(as_kind(c, kind).isNotNull(), 2**i).otherwise(0) for i, kind in enumerate(LOOKS)), F.lit(0))
    return F.when(c.rlike(PLAIN), number).when(c.isin(*FLAGS), 4).when(c.rlike(f"^(?:{'|'.join(LOOKS.values())})$"), odd).when(c.isNotNull(), 0)


def scrub_number(c: Column, kind: T.DataType) -> Column:
    """As to_number, with booleans null."""
    return F.lit(None).cast("double") if isinstance(kind, T.BooleanType) else to_number(c)


def binary_map(c: Column, positive: Sequence[str], negative: Sequence[str]) -> Column:
    """1.0, 0.0 or null by trimmed lower-case label; a label in both is positive."""
    return F.when(_key(c).isin([x.lower() for x in positive]), 1.0).when(_key(c).isin([x.lower() for x in negative]), 0.0)


def encode(c: Column, codes: Mapping[str, int]) -> Column:
    """The code of a trimmed lower-case label, or null."""
    return F.create_map(*[F.lit(x) for k, v in codes.items() for x in (k.lower(), v)])[_key(c)]


def lower_bound(c: Column, low: float, high: float | None = None) -> Column:
    """Values of at least low; of high at most, too, where it is given."""
    return F.when((c >= low) if high is None else c.between(low, high), c)


def in_range(c: Column, low: float, high: float) -> Column:
    return F.when(c.between(low, high), c)


def only(c: Column, valid: Sequence) -> Column:
    return F.when(c.isin(list(valid)), c)


def height(measured: Column, knee: Column, age: Column) -> Column:
    """Measured height, or an estimate from knee height and age."""
    return F.coalesce(measured, KNEE * knee + AGE * age + BASE)


def bmi(weight: Column, height_cm: Column) -> Column:
    return weight / F.pow(height_cm / 100, 2)


def below(c: Column, threshold: float) -> Column:
    """1.0 below the threshold, 0.0 else, null for null."""
    return F.when(c.isNotNull(), (c < threshold).cast("double"))


def age_bin(c: Column, edges: Sequence[float] = (0, 25, 45, 100)) -> Column:
    """Right-closed bins; null outside."""
    out = None
    for lo, hi in zip(edges, edges[1:]):
        hit, label = (c > lo) & (c <= hi), f"({lo}, {hi}]"
        out = F.when(hit, label) if out is None else out.when(hit, label)
    return out


def sex_label(c: Column) -> Column:
    return F.when(c == 1, "Male").when(c == 0, "Female").otherwise("Unknown")


def odds_ratio(c: Column) -> Column:
    """exp of a coefficient; NaN where it isn't finite."""
    ratio = F.exp(c)
    return F.when(ratio < float("inf"), ratio).otherwise(F.lit(float("nan")))
