"""De-identification compiled into one projection.

Rules match field names, so each column has one action for the whole table. It is found once, on the driver, and the scrub
is a single ``select`` that fuses with the scan; it holds on streams as well. Order of precedence, first match wins: keep,
birthdate, drop, cap, generalize, suppress, date, id.
"""

from __future__ import annotations

import os
import re
import secrets
from collections.abc import Mapping
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakecohort.functions import dates, keyed, numbers

MARKER, VERSION = "_phi_scrubbed", "v2"
SAFE_HARBOR, LIMITED = "safe_harbor", "limited_dataset"
ORDER = ("keep", "birthdate", "drop", "cap", "generalize", "suppress", "date", "id")


#: Words of column names by what they say, for the default rules.
WORDS = {
    "birth": "birth brth dob bday",
    "person": "first[-_]?name last[-_]?name middle[-_]?name given[-_]?name surname father mother spouse guardian next[-_]?of[-_]?kin patient[-_]?name subject[-_]?name",
    "place": "village city town district taluk ward locality state province addr residence postal zip pin_?code gps latitude longitude",
    "contact": "phone mobile fax e[-_]?mail website homepage ip[-_]?addr user[-_]?agent",
    "state_id": "ssn social_?security aadhaa?r passport voter ration[-_]?card mrn medical_?record",
    "social": "relig caste tribe mother_?tongue educ literacy school occup profession income salary wage",
    "free_text": "comment remark note$ explain",
    "image": "photo fingerprint biometric voiceprint dicom",
    "staff": "interviewer assessor examiner nurse physician clinician doctor staff investigator coordinator monitor auditor technician",
    "numbered": "account bank insurance policy beneficiary certificate licen[cs]e registration vehicle chassis device serial session transaction tracking cookie login user unique",
    "entry": "created modified updated entered verified uploaded imported exported locked",
}
#: Broader values of marital status.
MARITAL = {"married": "Married", "married/living together": "Married", "living together": "Married", "single": "Single", "never married": "Single", "unmarried": "Single", "widowed": "Other", "divorced": "Other", "separated": "Other", "separated/divorced": "Other"}


@dataclass(frozen=True)
class Rules:
    """Patterns are searched in column names without regard to case."""

    subject_ids: tuple[str, ...] = ("SUBJID",)
    keep: tuple[str, ...] = ()
    birthdate: tuple[str, ...] = ()
    drop: tuple[str, ...] = ()
    cap: tuple[tuple[str, float, str], ...] = ()  # pattern, threshold, label
    generalize: tuple[tuple[str, Mapping[str, str]], ...] = ()  # pattern, mapping
    suppress: tuple[tuple[str, int], ...] = ()  # pattern, threshold
    dates: tuple[str, ...] = ()
    day_first: tuple[str, ...] = ()
    ids: tuple[tuple[str, str], ...] = ()  # pattern, label
    posture: str = SAFE_HARBOR
    authority: str = ""
    jitter_days: int = keyed.JITTER_DAYS
    orphan_threshold: int = 10

    def __post_init__(self):
        if self.posture not in (SAFE_HARBOR, LIMITED):
            raise ValueError(f"unknown posture {self.posture!r}")
        if self.posture == LIMITED and not self.authority.strip():
            raise ValueError("limited_dataset needs a note of its authority")
        if self.jitter_days < 1:
            raise ValueError("jitter_days is 1 at least")
        patterns = [*self.keep, *self.birthdate, *self.drop, *self.dates, *self.day_first, *(x[0] for part in (self.cap, self.generalize, self.suppress, self.ids) for x in part)]
        for p in patterns:
            if not p:
                raise ValueError("a rule has no pattern")
            re.compile(p)
        if any(not label for _, label in self.ids) or any(not x[2] for x in self.cap):
            raise ValueError("a rule has no label")
        if any(not m for _, m in self.generalize):
            raise ValueError("a rule has no mapping")

    @classmethod
    def defaults(cls, **changes) -> Rules:
        """Rules for a study that has none of its own yet, by the kinds of identifiers that safe harbour names.

        Patterns are made of words (see WORDS below) and hold for any study's column names; a study adds its own and keeps
        what they take too much of.
        """
        number, name = r"[-_]?(?:id|num|no|number|code|card)", r"[-_]?(?:name|id|initials?)"
        any_of = lambda words: f"(?:{'|'.join(words.split())})"
        made = {
            "subject_ids": ("SUBJID", "FID"),
            "keep": ("_TIME?$", "VISIT$", "(?:^|_)SEX$", "_LABID_?(?:OK|ND)$"),
            "birthdate": (any_of(WORDS["birth"]),),
            "drop": (
                *[any_of(WORDS[k]) for k in ("person", "place", "contact", "state_id", "social", "free_text", "image")], any_of(WORDS["staff"]) + name, r"(?:^|[-_])(?:INIT(?:IAL)?S?|SIGN(?:ATURE)?)\d*$",
                any_of(WORDS["numbered"]) + number, any_of(WORDS["entry"]) + r"[-_]?(?:by|at|on|date|time|timestamp)", r"(?:DTH|DEATH)[-_]?(?:DAT|DATE|PLACE)", r"[-_]NAME$",
            ),
            "cap": ((r"(?:^|[-_])AGE$", 89, "90+"),),
            "generalize": ((r"MARI(?:T|STAT)", MARITAL),),
            "suppress": ((r"contacts?(?:[-_]?(?:total|count))?$", 5),),
            "dates": (r"DAT\d*$", r"_DT$", r"DATE\d*$"),
            "ids": (
                (r"(?:^|_)SUBJID$", "SUBJ"), (any_of("patient subject participant") + number, "SUBJ"), (r"(?:^|_)FID\d*$", "FAM"), (any_of("family household") + number, "FAM"),
                (any_of("screen scrn enrol enroll") + number, "SCRN"), (any_of("facility center centre site clinic hospital") + number, "FAC"), (any_of("specimen sample accession lab") + number, "LAB"),
            ),
        }
        return cls(**made | changes)

    @classmethod
    def from_mapping(cls, config: Mapping) -> Rules:
        """Rules from a parsed configuration with the names of the fields; lists become tuples."""
        unknown = set(config) - set(cls.__dataclass_fields__)
        if unknown:
            raise ValueError(f"unknown settings: {', '.join(sorted(unknown))}")
        frozen = {k: tuple(tuple(x) if isinstance(x, list) else x for x in v) if isinstance(v, list) else v for k, v in config.items()}
        return cls(**frozen)


@dataclass
class Action:
    column: str
    kind: str
    arguments: tuple = ()
    found: Column | None = field(default=None, repr=False)


def _hit(pattern: str, name: str) -> bool:
    return re.search(pattern, name, re.I) is not None


def action(name: str, rules: Rules) -> Action:
    """What happens to a column of this name."""
    if name.startswith("__") or name == MARKER or any(_hit(p, name) for p in rules.keep):
        return Action(name, "keep")
    day_first = any(_hit(p, name) for p in rules.day_first)
    if any(_hit(p, name) for p in rules.birthdate):
        return Action(name, "drop") if rules.posture == SAFE_HARBOR else Action(name, "date", (day_first,))
    if any(_hit(p, name) for p in rules.drop):
        return Action(name, "drop")
    for kind, part in (("cap", rules.cap), ("generalize", rules.generalize), ("suppress", rules.suppress)):
        for pattern, *arguments in part:
            if _hit(pattern, name):
                return Action(name, kind, tuple(arguments))
    if any(_hit(p, name) for p in rules.dates):
        return Action(name, "date", (day_first,))
    for pattern, label in rules.ids:
        if _hit(pattern, name):
            return Action(name, "id", (label,))
    return Action(name, "keep")


def subject(columns: list[str], rules: Rules) -> Column:
    """The first id that isn't blank: columns of the names in order, then columns that end in such a name."""
    names = [c for want in rules.subject_ids for c in columns if c.upper() == want.upper()]
    names += [c for want in rules.subject_ids for c in columns if c not in names and c.upper().endswith(f"_{want.upper()}")]
    found = [F.nullif(F.trim(F.col(f"`{c}`").cast("string")), F.lit("")) for c in names]
    return F.coalesce(*found, F.lit("")) if found else F.lit("")


def cap(c: Column, threshold: float, label: str) -> Column:
    """Numbers above the threshold become the label; the column becomes text."""
    return F.when(numbers.to_number(c) > threshold, label).otherwise(c.cast("string"))


def generalize(c: Column, mapping: Mapping[str, str]) -> Column:
    """The broader value of a trimmed lower-case text; unknown values stay."""
    known = F.create_map(*[F.lit(x) for k, v in mapping.items() for x in (k.strip().lower(), v)])
    return F.coalesce(known[F.lower(F.trim(c.cast("string")))], c.cast("string"))


def suppress(c: Column, threshold: int, kind: str) -> Column:
    """Numbers above the threshold become the threshold."""
    return F.when(numbers.to_number(c) > threshold, F.lit(threshold).cast(kind)).otherwise(c)


def date_text(c: Column, kind: str) -> Column:
    return c if kind == "string" else dates.as_stored(c) if kind.startswith("timestamp") else c.cast("string")


def _dated(df: DataFrame, rules: Rules) -> DataFrame:
    """df with the date of each cell that a date rule covers, in a projection of its own: it is used several times."""
    found = {}
    for i, (name, kind) in enumerate(df.dtypes):
        if name != MARKER and (a := action(name, rules)).kind == "date":
            found[f"__date{i}"] = dates.parse(date_text(F.col(f"`{name}`"), kind), *a.arguments)
    return df.select("*", *[c.alias(k) for k, c in found.items()])


def _changes(df: DataFrame, rules: Rules, moved: Column) -> tuple[list[Column], list[tuple[str, str, Column]]]:
    """The columns after all rules, and (scope, field, whether it happened) of what rules do; over what _dated gives."""
    kinds = dict(df.dtypes)
    already = F.coalesce(F.col(MARKER) == VERSION, F.lit(False)) if MARKER in df.columns else F.lit(False)
    out, events = [], []
    event = lambda scope, name, changed: events.append((f"phi-scrub-{scope}", name, F.coalesce(changed & ~already, F.lit(False))))
    for i, name in enumerate(df.columns):
        if name == MARKER:
            continue
        c, kind, a = F.col(f"`{name}`"), kinds[name], action(name, rules)
        new = c
        if a.kind == "drop":
            event("drop", name, F.lit(True))
            continue
        if a.kind == "cap":
            new = cap(c, *a.arguments)
            event("cap", name, numbers.to_number(c) > a.arguments[0])
        elif a.kind == "generalize":
            new = generalize(c, *a.arguments)
            event("generalize", name, ~new.eqNullSafe(c.cast("string")))
        elif a.kind == "suppress":
            new = suppress(c, *a.arguments, kind)
            event("suppress", name, numbers.to_number(c) > a.arguments[0])
        elif a.kind == "date":
            text, date = date_text(c, kind), F.col(f"__date{i}")
            new, parsed = dates.shift_parsed(text, F.date_add(date, moved.cast("int")), *a.arguments), date.isNotNull()
            event("date", name, parsed)
            event("date-unparsed", name, ~parsed & ~F.coalesce(F.trim(text) == "", F.lit(True)))
        elif a.kind == "id":
            new = keyed.pseudonym(c, *a.arguments)
            event("id", name, F.trim(c.cast("string")) != "")
        if a.kind != "keep":
            new = F.when(already, date_text(c, kind) if a.kind == "date" else c if a.kind == "suppress" else c.cast("string")).otherwise(new)
        out.append(new.alias(name))
    return out, events


def _moved(df: DataFrame, rules: Rules, key: bytes) -> DataFrame:
    """df with the key, dates and __moved, the days by which the row's subject moves: worked out once a row."""
    known = keyed.with_key(_dated(df, rules), key).withColumn("__subject", subject(df.columns, rules))
    return known.withColumn("__moved", keyed.offset(F.col("__subject"), rules.jitter_days))


def scrub(df: DataFrame, rules: Rules, key: bytes) -> DataFrame:
    """Rows after all rules, with the marker; rows that have the marker already pass.

    Columns that are dropped are gone; rows without a subject id are still here: split them with quarantine.
    """
    out, _ = _changes(df, rules, F.col("__moved"))
    keyed_df = _moved(df, rules, key)
    return keyed_df.select(*out, F.lit(VERSION).alias(MARKER))


def scrub_observed(df: DataFrame, rules: Rules, key: bytes, observation) -> tuple[DataFrame, list[tuple[str, str]]]:
    """scrub, with what audit_counts gives observed while its rows go by; (frame, scope and field of each metric in order)."""
    out, events = _changes(df, rules, F.col("__moved"))
    keyed_df = _moved(df, rules, key)
    if events:
        keyed_df = keyed_df.observe(observation, *[F.coalesce(F.sum(flag.cast("long")), F.lit(0)).alias(str(i)) for i, (_, _, flag) in enumerate(events)])
    return keyed_df.select(*out, F.lit(VERSION).alias(MARKER)), [(scope, name) for scope, name, _ in events]


def audit_counts(df: DataFrame, rules: Rules, key: bytes) -> DataFrame:
    """scope, field and events of a scrub; what never happened has no row. Flags are added up, so nothing is hashed or shifted; key is for symmetry."""
    _, events = _changes(df, rules, F.lit(0))
    if not events:
        return df.sparkSession.createDataFrame([], "scope string, field string, events long")
    sums = _dated(df, rules).agg(*[F.coalesce(F.sum(flag.cast("long")), F.lit(0)).alias(str(i)) for i, (_, _, flag) in enumerate(events)])
    each = F.array(*[F.struct(F.lit(scope).alias("scope"), F.lit(field).alias("field"), F.col(str(i)).alias("events")) for i, (scope, field, _) in enumerate(events)])
    return sums.select(F.inline(each)).filter("events > 0")


def quarantine(df: DataFrame, rules: Rules) -> tuple[DataFrame, DataFrame]:
    """(rows with a subject id, rows without)."""
    orphan = subject(df.columns, rules) == ""
    return df.filter(~orphan), df.filter(orphan)


def check_orphans(df: DataFrame, rules: Rules) -> int:
    """How many rows have no subject id; too many are an error."""
    n = quarantine(df, rules)[1].count()
    if n > rules.orphan_threshold:
        raise ValueError(f"{n} rows without a subject id; {rules.orphan_threshold} are allowed")
    return n


def load_key(path: str, create: bool = False) -> bytes:
    """A key of 64 hexadecimal digits from a file that only its owner can read."""
    p = Path(path)
    if create:
        handle = os.open(p, os.O_WRONLY | os.O_CREAT | os.O_EXCL, 0o600)
        with os.fdopen(handle, "w") as f:
            f.write(secrets.token_hex(32))
    if p.stat().st_mode & 0o077:
        raise PermissionError(f"{p} must have mode 0600")
    text = p.read_text().strip()
    if not re.fullmatch(r"[0-9a-fA-F]{64}", text):
        raise ValueError(f"{p} must hold 64 hexadecimal digits")
    return bytes.fromhex(text)
