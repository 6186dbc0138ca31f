"""Canonical text as Column expressions: line endings, blanks, disclaimers, signatures, replies, HTML."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The line patterns that end or mark a part of a mail (matched from the start of a stripped line, any case).
SIGNATURE_STARTS = (
    r"--+\s*$",
    r"___+\s*$",
    r"(Cordiali saluti|Distinti saluti|Saluti|Best regards|Regards|Grazie)",
    r"Sent from my (iPhone|iPad|Android|Samsung|Huawei)",
    r"Inviato da",
)
QUOTED_LINES = (
    r">",
    r"\|+\s",
    r"On .+ wrote:",
    r"Il .+ ha scritto:",
    r"-+\s*Original Message\s*-+",
    r"-+\s*Messaggio originale\s*-+",
)
DISCLAIMER = r"\n_{10,}.*$"
URL = r"https?://[^\s]+"

SECTIONS = "array<struct<type:string,span_start:int,span_end:int,content:string>>"
_SIGNATURE_LINE = "(?iU)^(" + "|".join(SIGNATURE_STARTS) + ")"
_QUOTED_LINE = "(?idU)^(" + "|".join(QUOTED_LINES) + ")"
#: From the first line that starts a signature to the end of the text; no signature pattern spans lines.
_SIGNATURE = r"(?isU)(^|\n)[^\S\n]*(" + "|".join(p.replace(r"\s*$", r"[^\S\n]*(?=\n|\z)") for p in SIGNATURE_STARTS) + r").*\z"


def strip(c: Column) -> Column:
    """Without white space at both ends; all of Unicode's, where ``trim`` knows the space alone."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+\z", "")


def line_feeds(c: Column) -> Column:
    return F.regexp_replace(c, r"\r\n?", "\n")


def collapse_newlines(c: Column, most: int = 2) -> Column:
    return F.regexp_replace(c, r"\n{%d,}" % (most + 1), "\n" * most)


def normal_whitespace(c: Column) -> Column:
    """Line ends trimmed, inner runs of blanks and tabs to one blank, indents kept, at most one empty line in a row."""
    trimmed = F.regexp_replace(line_feeds(c), r"(?U)[^\S\n]+(?=\n|\z)", "")
    return collapse_newlines(F.regexp_replace(trimmed, r"([^ \t\n])[ \t]+", "$1 "))


def replace_urls(c: Column, replacement: str = "[URL]") -> Column:
    return F.regexp_replace(c, r"(?U)" + URL, replacement.replace("\\", r"\\").replace("$", r"\$"))


def without_disclaimer(c: Column) -> Column:
    return F.regexp_replace(c, "(?is)" + DISCLAIMER, "")


def without_signature(c: Column) -> Column:
    return F.regexp_replace(c, _SIGNATURE, "")


def _lines(c: Column) -> Column:
    return F.split(c, "\n", -1)


def is_quoted(line: Column) -> Column:
    return strip(line).rlike(_QUOTED_LINE)


def without_replies(c: Column) -> Column:
    """Quoted and header lines go, each for itself."""
    return F.array_join(F.filter(_lines(c), lambda x: ~is_quoted(x)), "\n")


def canonical(c: Column, signatures: bool = True) -> Column:
    """The whole order: blanks, disclaimer, signature, replies, lower case, strip. Null stays null, empty stays empty."""
    t = without_disclaimer(normal_whitespace(c))
    if signatures:
        t = without_signature(t)
    return strip(F.lower(without_replies(t)))


def _cut(before: Column, after: Column, kind: str) -> Column:
    """The audit entry of a part that was cut off the end: nothing if both are equal."""
    entry = F.struct(F.lit(kind).alias("type"), F.length(after).alias("span_start"), F.length(before).alias("span_end"), F.substring(before, F.length(after) + 1, F.length(before)).alias("content"))
    return F.when(before != after, F.array(entry)).otherwise(F.array().cast(SECTIONS)).cast(SECTIONS)


def disclaimer_section(before: Column) -> Column:
    return _cut(before, without_disclaimer(before), "disclaimer")


def signature_section(before: Column) -> Column:
    """The span starts at the signature's line, after the line feed that goes with it."""
    return F.transform(
        _cut(before, without_signature(before), "signature"),
        lambda s: F.when(s["content"].startswith("\n"), F.struct(s["type"].alias("type"), (s["span_start"] + 1).alias("span_start"), s["span_end"].alias("span_end"), F.substring(s["content"], 2, F.length(s["content"])).alias("content"))).otherwise(s),
    ).cast(SECTIONS)


def reply_sections(before: Column) -> Column:
    """Blocks of quoted lines. Blank lines don't close a block; a span is as long as the block's quoted lines joined."""
    entry = "struct<type:string,span_start:int,span_end:int,content:string>"
    start = F.struct(F.lit(0).alias("at"), F.lit(None).cast(entry).alias("open"), F.array().cast(SECTIONS).alias("done"))

    def closed(acc: Column) -> Column:
        return F.when(acc["open"].isNull(), acc["done"]).otherwise(F.concat(acc["done"], F.array(acc["open"])))

    def step(acc: Column, line: Column) -> Column:
        quoted, blank = is_quoted(line), strip(line) == ""
        mark = F.when(strip(line).rlike(r"^[>|]"), F.lit("quote"))
        content = F.when(acc["open"].isNull(), line).otherwise(F.concat(acc["open"]["content"], F.lit("\n"), line))
        first = F.coalesce(acc["open"]["span_start"], acc["at"])
        grown = F.struct(F.when(mark.isNotNull() | (acc["open"]["type"] == "quote"), F.lit("quote")).otherwise(F.lit("reply_header")).alias("type"), first.alias("span_start"), (first + F.length(content)).alias("span_end"), content.alias("content"))
        return F.struct(
            (acc["at"] + F.length(line) + 1).alias("at"),
            F.when(quoted, grown).when(blank, acc["open"]).cast(entry).alias("open"),
            F.when(quoted | blank, acc["done"]).otherwise(closed(acc)).cast(SECTIONS).alias("done"),
        )

    return F.aggregate(_lines(before), start, step, closed)


# Character references that are decoded without Python; "&amp;" comes last.
ENTITIES = {"&nbsp;": " ", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&apos;": "'", "&euro;": "€", "&egrave;": "è", "&eacute;": "é", "&agrave;": "à", "&ograve;": "ò", "&ugrave;": "ù", "&igrave;": "ì", "&amp;": "&"}


def strip_html(c: Column) -> Column:
    """Scripts, styles and tags dropped, common character references decoded, white space collapsed."""
    t = F.regexp_replace(c, r"(?is)<script[^>]*>.*?</script>", "")
    t = F.regexp_replace(F.regexp_replace(t, r"(?is)<style[^>]*>.*?</style>", ""), r"<[^>]+>", "")
    for name, char in ENTITIES.items():
        t = F.replace(t, F.lit(name), F.lit(char))
    return strip(F.regexp_replace(t, r"(?U)\s+", " "))


def clean_html(c: Column) -> Column:
    """Tracking pixels dropped and mail links unwrapped."""
    t = F.regexp_replace(c, r"""(?i)<img[^>]*src=['"][^'"]*tracking[^'"]*['"][^>]*>""", "")
    return F.regexp_replace(t, r"""(?i)<a[^>]*href=['"]mailto:[^'"]*['"][^>]*>(.*?)</a>""", "$1")
