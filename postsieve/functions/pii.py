"""Redaction of personal data with a log of positions, as Column expressions."""

from __future__ import annotations

import secrets

from pyspark.sql import Column
from pyspark.sql import functions as F

from postsieve.settings import VERSIONS

# The patterns of addresses and of Italian phone numbers, and the levels that redact each.
EMAIL = r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b"
PHONE = r"\b(\+39\s?)?((0\d{1,4}[\s\-]?\d{4,8})|([3]\d{2}[\s\-]?\d{6,7}))\b"
LEVELS = {"none": (), "minimal": ("email",), "standard": ("email", "phone"), "aggressive": ("email", "phone")}

#: What every match holds; a text without it is not searched.
HINTS = {EMAIL: "@"}

SPANS = "array<struct<start:int,end:int,text:string>>"


def _has(text: Column, pattern: str) -> Column:
    found = text.rlike(pattern)
    return F.contains(text, F.lit(HINTS[pattern])) & found if pattern in HINTS else found


def spans(text: Column, pattern: str) -> Column:
    """All matches with positions: lengths of what lies between matches and of the matches, added up."""
    found, gaps = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    zero = F.struct(F.lit(0).alias("at"), F.array().cast(SPANS).alias("out"))

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["gap"])
        end = start + F.length(x["hit"])
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(F.struct(start.alias("start"), end.alias("end"), x["hit"].alias("text")))).alias("out"))

    pairs = F.filter(F.arrays_zip(gaps.alias("gap"), found.alias("hit")), lambda x: x["hit"].isNotNull())
    return F.when(_has(text, pattern), F.aggregate(pairs, zero, step, lambda acc: acc["out"])).otherwise(F.array().cast(SPANS))


def redacted(text: Column, pattern: str, kind: str) -> Column:
    """The text with the i-th match replaced by ``[KIND_i]``."""
    gaps = F.split(text, pattern, -1)
    filled = F.transform(gaps, lambda g, i: F.when(i == 0, g).otherwise(F.concat(F.lit(f"[{kind.upper()}_"), i.cast("string"), F.lit("]"), g)))
    return F.when(_has(text, pattern), F.array_join(filled, "")).otherwise(text)


def salted_hash(value: Column, salt: str = "") -> Column:
    return F.concat(F.lit("sha256-"), F.sha2(F.concat(F.lit(salt), value).cast("binary"), 256))


def hash_matches(value: Column, hashed: Column, salt: str = "") -> Column:
    return salted_hash(value, salt) == hashed


def new_salt(size: int = 32) -> str:
    """A random salt of ``size`` bytes in hexadecimal; drawn on the driver, to be passed on as a parameter."""
    return secrets.token_hex(size)


def log_entries(text: Column, pattern: str, kind: str, level: str = "standard", salt: str = "") -> Column:
    """The log of what ``redacted`` replaces; positions are those in ``text``."""
    return F.transform(
        spans(text, pattern),
        lambda s, i: F.struct(
            F.lit(kind).alias("type"), F.array(s["start"], s["end"]).alias("position"), salted_hash(s["text"], salt).alias("original_hash"),
            F.concat(F.lit(f"[{kind.upper()}_"), (i + 1).cast("string"), F.lit("]")).alias("placeholder"),
            F.lit(VERSIONS["pii_redaction_version"]).alias("pii_redaction_version"), F.lit(level).alias("pii_redaction_level"),
        ),
    )
