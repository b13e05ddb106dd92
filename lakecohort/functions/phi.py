"""Patterns of protected health information and what is done with text that matches: findings, gates and redaction.

Everything is a column expression over Java regular expressions, so scans stay in the JVM.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import keyed

# Identifiers that block a text.
BLOCKING = {
    "AADHAAR": r"\b\d{4}[\s\-\.]?\d{4}[\s\-\.]?\d{4}\b",
    "PAN": r"\b[A-Z]{5}\d{4}[A-Z]\b",
    "INDIAN_VOTER_ID": r"\b[A-Z]{3}\d{7}\b",
    "INDIAN_DL": r"\b[A-Z]{2}\d{2}\s?\d{4}\d{7}\b",
    "INDIAN_PASSPORT": r"\b[A-Z]\d{7}\b",
    "INDIAN_PHONE": r"(?<!\d)(?:\+91[\s-]?)?[6-9]\d{9}(?!\d)",
    "EMAIL": r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b",
    "URL": r"(?i)\bhttps?://[^\s/$.?#].[^\s]*\b",
    "INDIAN_PIN": r"(?i:pin\s*(?:code)?|postal\s*code|zip)\s*[:=\-]?\s*\b(\d{6})\b",
    "SSN": r"\b\d{3}-\d{2}-\d{4}\b",
    "MRN": r"(?i)\bMRN[-:]?\s*\d{6,10}\b",
    "IP": r"\b(?:\d{1,3}\.){3}\d{1,3}\b",
    "DATE_ISO": r"\b(?:19|20)\d{2}-(?:0[1-9]|1[0-2])-(?:0[1-9]|[12]\d|3[01])(?:[ T]\d{2}:\d{2}(?::\d{2})?)?\b",
    "PERSON_NAME_PREFIX": r"\b(?:Mr|Mrs|Ms|Dr|Prof)\.?\s+[A-Z][a-z]+(?:\s+[A-Z][a-z]+){0,2}\b",
}
# Shapes that are noted but don't block.
WARNING = {
    "NUMERIC_ID_SHORT": r"\b\d{6,7}\b",
    "DATE_MDY": r"\b\d{1,2}/\d{1,2}/\d{2,4}\b",
    "PERSON_NAME_GENERIC": r"\b[A-Z][a-z]{2,15}\s+[A-Z][a-z]{2,15}\b",
}
# Subject ids.
SUBJECT = (r"\bSUBJ[-_]?\d+\b", r"\bSC\d{4,}\b", r"\bFID\d*\b")
# Shapes of service keys.
SERVICE_KEYS = (r"sk-ant-[A-Za-z]+\d*-[A-Za-z0-9_\-]{20,}", r"sk-(?:proj-)?[A-Za-z0-9]{40,}", r"nvapi-[A-Za-z0-9_\-]{30,}", r"AIza[A-Za-z0-9_\-]{35}")
# Phrases that try to instruct a reader of untrusted text.
INJECTION = (
    r"(?i)ignore\s+(?:all\s+)?(?:previous|prior|above|earlier)\s+(?:instructions?|prompts?|rules?|constraints?|directives?)",
    r"(?i)disregard\s+(?:all\s+|the\s+)?(?:previous|prior|above|earlier|foregoing|instructions?)",
    r"(?i)forget\s+(?:everything|all|your\s+(?:instructions?|training|rules?))",
    r"(?i)you\s+are\s+now\s+(?:a|an|in|the)\b",
    r"(?i)new\s+(?:instructions?|role|system\s*prompt|directives?)\s*[:=]",
    r"(?i)(?:^|\n)\s*(?:system|assistant|admin|user)\s*[:=]\s",
    r"(?i)(?:act|pretend|roleplay)\s+as\s+(?:a|an|the)\b",
    r"(?i)developer\s*mode|dev\s*mode\s+enabled",
    r"(?i)\bjailbreak(?:ing)?\b|\bDAN\b",
    r"(?i)override\s+(?:your|all|previous)\s+(?:instructions?|safety|rules?)",
)
# Clinical phrases that look like names, and the words that such phrases are made of.
CLINICAL_PHRASES = (
    "bacteriologic relapse", "bact. relapse", "clinical relapse", "bacteriologic failure", "bact. failure", "clinical failure", "treatment completed",
    "treatment success", "treatment failure", "loss to follow up", "lost to follow up", "cured", "cure declared", "normal delivery", "preterm delivery",
    "spontaneous abortion", "definite case", "probable case", "possible case", "not tb", "not a case", "not applicable", "yes, current smoker",
    "yes, former smoker", "no, never", "never smoker", "don't know", "sample not collected", "specimen rejected", "insufficient volume", "not available",
    "not done", "not reported", "not known",
)
CLINICAL_WORDS = (
    "tb", "tuberculosis", "mdr", "xdr", "ziehl", "neelsen", "smear", "culture", "liquid", "solid", "lowenstein", "jensen", "isoniazid", "rifampicin",
    "pyrazinamide", "ethambutol", "streptomycin", "positive", "negative", "pending", "reactive", "nonreactive", "normal", "abnormal", "definite", "probable",
    "possible", "treatment", "completed", "cured", "failure", "relapse", "cavitary", "cavity", "lesion", "bilateral", "unilateral", "apical", "basal",
    "minimal", "moderate", "advanced", "contamination", "contaminated", "invalid", "indeterminate", "rejected", "insufficient",
)
# Notes of a death, with the spellings that occur.
_PATIENT = r"(?:pat[ie]{0,2}[aie]?nt|paitent|ptient|pt|participant|subject)"
_EXPIRED = r"exp(?:i(?:re?|er)|ri)(?:d|ed)?"
DEATH_NOTES = (
    rf"(?i)^(?:.*\s)?(?:{_PATIENT}\s+)?{_EXPIRED}\s*$",
    rf"(?i)^(?:.*\s)?(?:{_PATIENT}\s+)?{_EXPIRED}\s+on\b",
    r"(?i)^(?:.*\s)?(?:died|death)\s*(?:on|at|in|due)?\b",
    rf"(?i)(?:dots|card|handover|transfer)\b.*\b{_EXPIRED}",
    rf"(?i)^\s*{_EXPIRED}\s*$",
)
REDACTED, INJECTED = "[REDACTED]", "[INJECTION-REDACTED]"
REFUSAL = "[BLOCKED: the text holds protected health information]"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _let(c: Column, f) -> Column:
    """f of a column that is worked out once, however often f uses it."""
    return F.get(F.transform(F.array(c), f), F.lit(0))


def _unicode(pattern: str) -> str:
    """Digits, white space and word boundaries of all scripts."""
    return "(?U)" + pattern


#: What a text must hold for a pattern to match; all patterns but these and names of persons need a digit.
_NEEDED = {"EMAIL": "@", "URL": "://"}
_DIGITLESS = ("PERSON_NAME_PREFIX", "PERSON_NAME_GENERIC")


def labels(c: Column | str, patterns: dict[str, str]) -> Column:
    """Sorted labels of the patterns that a text matches; empty for null. Patterns that need a digit are tried on texts with one."""
    c = _col(c)
    hit = lambda k: F.when(c.rlike(_unicode(patterns[k])), k)
    numbered = [hit(k) for k in patterns if k not in _NEEDED and k not in _DIGITLESS]
    others = [F.when(c.contains(_NEEDED[k]), hit(k)) if k in _NEEDED else hit(k) for k in patterns if k in _NEEDED or k in _DIGITLESS]
    none = F.array().cast("array<string>")
    found = F.concat(F.when(c.rlike(r"\p{Nd}"), F.array(*numbered)).otherwise(none) if numbered else none, F.array(*others) if others else none)
    return F.array_sort(F.filter(found, lambda x: x.isNotNull()))


def is_clinical_phrase(c: Column | str) -> Column:
    """A phrase of the list as it is written there, but for case and outer white space, or two or more clinical words."""
    text = F.lower(F.regexp_replace(_col(c), r"^\s+|\s+$", ""))
    words = F.split(text, r"\s+")
    return F.coalesce(text.isin(*CLINICAL_PHRASES) | ((F.size(words) >= 2) & F.forall(words, lambda w: w.isin(*CLINICAL_WORDS))), F.lit(False))


def is_death_note(c: Column | str) -> Column:
    text = F.trim(_col(c))
    # what all notes hold, as their patterns try every place of a long text
    return F.coalesce(text.rlike("(?i)exp(?:i|ri)|died|death") & reduce(Column.__or__, [text.rlike(p) for p in DEATH_NOTES]), F.lit(False))


def looks_like_name(c: Column | str, lexicon: list[str]) -> Column:
    """Two to four words of which one at least is in a lexicon of names, and no clinical phrase."""
    words = F.split(F.lower(F.trim(F.regexp_replace(_col(c), r"\s+", " "))), " ")
    known = F.arrays_overlap(words, F.array(*map(F.lit, lexicon))) if lexicon else F.lit(False)
    return F.coalesce(F.size(words).between(2, 4) & known & ~is_clinical_phrase(c), F.lit(False))


def warnings(c: Column | str, lexicon: list[str] | None = None) -> Column:
    """Labels that are noted; none for a text that is a clinical phrase or death note as a whole. With a lexicon, capitalised pairs count only as names."""
    c = _col(c)
    found = labels(c, WARNING)
    if lexicon is not None:
        named = F.exists(F.regexp_extract_all(c, F.lit(WARNING["PERSON_NAME_GENERIC"]), 0), lambda x: looks_like_name(x, lexicon))
        found = F.when(named, found).otherwise(F.array_remove(found, "PERSON_NAME_GENERIC"))
    return F.when(is_clinical_phrase(c) | is_death_note(c), F.array().cast("array<string>")).otherwise(F.coalesce(found, F.array().cast("array<string>")))


def blocked(c: Column | str) -> Column:
    return F.size(labels(c, BLOCKING)) > 0


def gate(c: Column | str, lexicon: list[str] | None = None) -> Column:
    """struct(blocked, findings, warnings)."""
    return _let(labels(c, BLOCKING), lambda f: F.struct((F.size(f) > 0).alias("blocked"), f.alias("findings"), warnings(c, lexicon).alias("warnings")))


def gated_text(c: Column | str) -> Column:
    """The text, or a refusal where it is blocked."""
    return F.when(blocked(c), REFUSAL).otherwise(_col(c))


def _tag_subjects(c: Column, pattern: str) -> Column:
    """Subject ids replaced by a keyed tag, on a table that has gone through with_key."""

    def tagged(text: Column) -> Column:
        tags = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda x: F.concat(F.lit("<SUBJ_"), F.substring(keyed.hmac(x), 1, 8), F.lit(">")))
        return F.when(text.rlike(pattern), F.array_join(F.transform(F.split(text, pattern), lambda p, i: F.concat(p, F.coalesce(F.get(tags, i), F.lit("")))), "")).otherwise(text)

    return _let(c, tagged)


def redact(c: Column | str, subjects: bool = False) -> Column:
    """Blocking, then noted shapes as <LABEL>; subject ids by keyed tags (needs with_key) or as <SUBJ>."""
    c = _col(c)
    for label, pattern in (BLOCKING | WARNING).items():
        c = F.regexp_replace(c, _unicode(pattern), f"<{label}>")
    for pattern in SUBJECT:
        c = _tag_subjects(c, pattern) if subjects else F.regexp_replace(c, pattern, "<SUBJ>")
    return c


def redact_log(c: Column | str) -> Column:
    """For log lines: subjects, service keys, then all other shapes."""
    c = _col(c)
    for pattern in SUBJECT:
        c = F.regexp_replace(c, pattern, "<SUBJ>")
    for pattern in SERVICE_KEYS:
        c = F.regexp_replace(c, pattern, "<API_KEY>")
    for label, pattern in (BLOCKING | WARNING).items():
        c = F.regexp_replace(c, _unicode(pattern), f"<{label}>")
    return c


def mask_event(c: Column | str, limit: int = 500) -> Column:
    """Cut to a length, then every hit as one mark."""
    c = F.substring(_col(c), 1, limit)
    for pattern in (*SUBJECT, *SERVICE_KEYS, *BLOCKING.values(), *WARNING.values()):
        c = F.regexp_replace(c, _unicode(pattern), REDACTED)
    return c


def sanitise(c: Column | str, label: str = "untrusted document") -> Column:
    """Untrusted text without instructing phrases, between marks; empty for null or empty."""
    label = "".join(x for x in label if x.isalnum() or x in " _.-")[:64]
    text = F.coalesce(_col(c), F.lit(""))
    for pattern in INJECTION:
        text = F.regexp_replace(text, pattern, INJECTED)
    return F.when(text == "", "").otherwise(F.concat(F.lit(f"[UNTRUSTED {label} BEGIN]\n"), text, F.lit(f"\n[UNTRUSTED {label} END]")))


def traceback_tail(text: str, lines: int = 12) -> str:
    """The last lines of a traceback with long quoted literals left out."""
    import re

    return re.sub(r"(['\"])(?:(?!\1).){40,}\1", r"\1...\1", "\n".join(text.splitlines()[-lines:]))


def redact_leaves(df: DataFrame) -> DataFrame:
    """Every text in every column, however nested, redacted; names and map keys stay."""

    def leaf(c: Column, kind: T.DataType) -> Column:
        if isinstance(kind, T.StringType):
            return redact(c)
        if isinstance(kind, T.ArrayType):
            return F.transform(c, lambda x: leaf(x, kind.elementType))
        if isinstance(kind, T.MapType):
            return F.transform_values(c, lambda k, v: leaf(v, kind.valueType))
        if isinstance(kind, T.StructType):
            return F.when(c.isNotNull(), F.struct(*[leaf(c[f.name], f.dataType).alias(f.name) for f in kind.fields]))
        return c

    return df.select(*[leaf(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in df.schema.fields])


def assert_clean(df: DataFrame, *columns: str) -> DataFrame:
    """df, after one look that no text of these columns is blocked."""
    hit = reduce(Column.__or__, [blocked(F.col(f"`{c}`")) for c in columns])
    if not df.filter(hit).isEmpty():
        raise ValueError("protected health information is left after redaction")
    return df
