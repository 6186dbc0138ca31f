"""Canonicalisation and redaction of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postsieve.functions import pii, text


def canonicalise(df: DataFrame, source: str, into: str = "canonical_text", signatures: bool = True, audit: bool = True) -> DataFrame:
    """Adds the canonical text and, with ``audit``, the removed sections in the order of the steps.

    Spans refer to the text as it is before the step that removes them.
    """
    c = F.coalesce(F.col(source), F.lit(""))
    steps = df.withColumn("__blank", text.normal_whitespace(c)).withColumn("__undisclaimed", text.without_disclaimer(F.col("__blank")))
    steps = steps.withColumn("__unsigned", text.without_signature(F.col("__undisclaimed")) if signatures else F.col("__undisclaimed"))
    out = steps.withColumn(into, text.strip(F.lower(text.without_replies(F.col("__unsigned")))))
    if audit:
        cut = [text.disclaimer_section(F.col("__blank"))] + [text.signature_section(F.col("__undisclaimed"))] * signatures + [text.reply_sections(F.col("__unsigned"))]
        out = out.withColumn("removed_sections", F.concat(*cut))
    return out.drop("__blank", "__undisclaimed", "__unsigned")


def redact(df: DataFrame, source: str, into: str, level: str = "standard", salt: str = "") -> DataFrame:
    """Adds the redacted text, ``pii_redaction_log`` and ``pii_redacted``. Phone positions refer to the text without addresses."""
    kinds = pii.LEVELS[level]
    out = df.withColumn("__t0", F.coalesce(F.col(source), F.lit("")))
    logs = []
    for i, kind in enumerate(kinds):
        pattern = {"email": pii.EMAIL, "phone": pii.PHONE}[kind]
        logs.append(pii.log_entries(F.col(f"__t{i}"), pattern, kind, level, salt))
        out = out.withColumn(f"__t{i + 1}", pii.redacted(F.col(f"__t{i}"), pattern, kind))
    empty = F.array().cast("array<struct<type:string,position:array<int>,original_hash:string,placeholder:string,pii_redaction_version:string,pii_redaction_level:string>>")
    out = out.withColumn("pii_redaction_log", F.concat(empty, *logs)).withColumn(into, F.col(f"__t{len(kinds)}"))
    return out.withColumn("pii_redacted", F.lit(bool(kinds))).drop(*(f"__t{i}" for i in range(len(kinds) + 1)))
