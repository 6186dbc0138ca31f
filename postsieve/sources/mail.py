"""Raw mails: files to parsed documents."""

from __future__ import annotations

import html as html_references
from collections.abc import Iterator
from email import message_from_bytes, policy
from email.utils import parsedate_to_datetime
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from postsieve.functions import text
from postsieve.operators.canonical import canonicalise, redact
from postsieve.session import ship
from postsieve.settings import DEFAULT, VERSIONS, Settings

PARSED = (
    "headers map<string,string>, date timestamp, parts array<struct<content_type:string,attachment:boolean,filename:string,content_id:string,size_bytes:int,text:string>>,"
    " multipart boolean, encoding string, error string"
)


def scan(spark: SparkSession, path: str, recursive: bool = True, s: Settings = DEFAULT) -> tuple[DataFrame, DataFrame]:
    """(path, content) of the ``.eml`` files below a path, and (path, size, reason) of files that are too large or no ``.eml``, whose content is never read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower())
    mails = files.option("pathGlobFilter", "*.{eml,EML}").load(path).filter(F.col("length") <= s.max_email_bytes).select("path", "content")
    reason = F.when(~F.lower("path").endswith(".eml"), "not_eml").when(F.col("length") > s.max_email_bytes, "too_large")
    every = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(path)
    return mails, every.select("path", F.col("length").alias("size"), reason.alias("reason")).filter("reason is not null")


def strict_text(part) -> str:
    """A part's text by its charset if that holds throughout, else by the charset that its bytes suggest, else as UTF-8 with replacements."""
    payload = part.get_payload(decode=True)
    if payload is None:
        return ""
    if charset := part.get_content_charset():
        try:
            return payload.decode(charset)
        except (UnicodeDecodeError, LookupError):
            pass
    from charset_normalizer import from_bytes

    best = from_bytes(payload).best()
    return str(best) if best else payload.decode("utf-8", errors="replace")


def _decoded(part) -> str | None:
    payload = part.get_payload(decode=True)
    if payload is None:
        return None
    charset = part.get_content_charset() or "utf-8"
    try:
        return payload.decode(charset, errors="replace")
    except LookupError:
        from charset_normalizer import from_bytes

        best = from_bytes(payload).best()
        return str(best) if best else payload.decode("utf-8", errors="replace")


def parse_bytes(content: bytes) -> dict:
    """One mail as the columns of ``PARSED``; what cannot be read is null, and ``error`` says why."""
    out = dict.fromkeys(("headers", "date", "parts", "multipart", "encoding", "error"))
    try:
        mail = message_from_bytes(content or b"", policy=policy.compat32)
        out["headers"] = {k: str(mail[k]) for k in ("From", "To", "Cc", "Subject", "Message-ID", "In-Reply-To", "References") if mail[k] is not None}
        try:
            when = parsedate_to_datetime(mail["Date"]) if mail["Date"] else None
            out["date"] = pd.Timestamp(when).tz_localize("UTC") if when and when.tzinfo is None else when and pd.Timestamp(when).tz_convert("UTC")
        except (TypeError, ValueError):
            pass
        out["multipart"] = mail.is_multipart()
        out["parts"] = []
        for part in mail.walk():
            if part.is_multipart():
                continue
            disposition, filename = str(part.get("Content-Disposition", "")), part.get_filename()
            kind, payload = part.get_content_type(), part.get_payload(decode=False)
            try:
                body = _decoded(part) if kind in ("text/plain", "text/html") and "attachment" not in disposition else None
            except Exception:  # a part that can't be decoded is skipped, the mail isn't
                body = None
            out["parts"].append({
                "content_type": kind, "attachment": "attachment" in disposition or bool(filename), "filename": filename, "content_id": part.get("Content-ID"),
                "size_bytes": len(str(payload).encode("utf-8", "replace")) if payload else 0, "text": body,
            })
        out["encoding"] = _encoding(mail)
    except Exception as e:  # any malformed mail is a row with an error, never a failed task
        out["error"] = f"{type(e).__name__}: {e}"
    return out


def _encoding(mail) -> str:
    if charset := mail.get_content_charset():
        return charset
    if payload := mail.get_payload(decode=True):
        from charset_normalizer import from_bytes

        if best := from_bytes(payload).best():
            return best.encoding
    return "utf-8"


class _Text(HTMLParser):
    BLOCKS = frozenset("p div br tr li ul ol h1 h2 h3 h4 h5 h6 table blockquote section article header footer".split())

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out, self.skip = [], 0

    def handle_starttag(self, tag, attrs):
        self.skip += tag in ("script", "style")
        if tag in self.BLOCKS:
            self.out.append("\n")

    def handle_endtag(self, tag):
        self.skip -= tag in ("script", "style") and self.skip > 0
        if tag in self.BLOCKS:
            self.out.append("\n")

    def handle_data(self, data):
        if not self.skip:
            self.out.append(data)


def html_text(markup: str) -> str:
    """Readable text of HTML: block elements break lines; scripts, styles, links' targets and images go."""
    reader = _Text()
    reader.feed(markup or "")
    reader.close()
    lines = (" ".join(x.split()) for x in "".join(reader.out).split("\n"))
    return "\n".join(x for x in lines if x)


def _parse(content: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([parse_bytes(c) for c in content])


def parsed(files: DataFrame) -> DataFrame:
    """Adds the struct ``mail`` to (path, content). Parsing runs in Python a batch at a time; all that follows is native."""
    ship(files.sparkSession)
    names = [f.split()[0] for f in files.columns]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.concat([b.reset_index(drop=True), _parse(b["content"])], axis=1)

    types = ", ".join(f"`{n}` {t}" for n, t in files.dtypes)
    flat = files.mapInPandas(run, f"{types}, {PARSED}")
    return flat.select(*names, F.struct("headers", "date", "parts", "multipart", "encoding", "error").alias("mail"))


def _addresses(c: Column) -> Column:
    return F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), ","), text.strip), lambda x: x != "")


@F.pandas_udf(StringType())
def html_to_text(markup: pd.Series) -> pd.Series:
    return markup.map(lambda x: None if x is None else html_text(x))


@F.pandas_udf(StringType())
def unescape(c: pd.Series) -> pd.Series:
    """All character references, where ``functions.text.strip_html`` knows the common ones."""
    return c.map(lambda x: None if x is None else html_references.unescape(x))


def ingest(files: DataFrame, level: str = "standard", salt: str = "", store_html: bool = False, stamp: Column | None = None, s: Settings = DEFAULT) -> DataFrame:
    """(path, content) to documents: id, headers, bodies, canonical and redacted text, attachments, audit logs, versions.

    The id hashes the content alone, so that the same mail always has the same one; with ``stamp`` (a
    timestamp as text) it is mixed in. The body is the plain parts joined, else the text of the first
    HTML part. success is false where parsing failed.
    """
    rows = parsed(files)
    h, parts = F.col("mail.headers"), F.coalesce(F.col("mail.parts"), F.array().cast("array<struct<content_type:string,attachment:boolean,filename:string,content_id:string,size_bytes:int,text:string>>"))
    of = lambda kind: F.transform(F.filter(parts, lambda p: (p["content_type"] == kind) & p["text"].isNotNull()), lambda p: p["text"])
    get = lambda name: F.try_element_at(h, F.lit(name))
    raw = F.concat(F.col("content"), F.encode(stamp, "UTF-8")) if stamp is not None else F.col("content")
    docs = rows.select(
        "path", F.concat(F.lit("eml-"), F.substring(F.sha2(raw, 256), 1, 32)).alias("document_id"), F.col("mail.error").isNull().alias("success"), F.col("mail.error").alias("error"),
        F.struct(
            F.coalesce(get("From"), F.lit("")).alias("from_address"), _addresses(get("To")).alias("to_addresses"), _addresses(get("Cc")).alias("cc_addresses"), F.coalesce(get("Subject"), F.lit("")).alias("subject"),
            F.col("mail.date").alias("date"), get("Message-ID").alias("message_id"), get("In-Reply-To").alias("in_reply_to"), F.filter(F.split(F.coalesce(get("References"), F.lit("")), r"\s+"), lambda x: x != "").alias("references"),
        ).alias("headers"),
        F.array_join(of("text/plain"), "").alias("body_text"), F.get(of("text/html"), F.lit(0)).alias("body_html"),
        F.when(F.col("mail.multipart"), F.slice(F.transform(F.filter(parts, lambda p: p["attachment"]), lambda p: F.struct(p["filename"].alias("filename"), p["content_type"].alias("content_type"), p["size_bytes"].alias("size_bytes"), p["content_id"].alias("content_id"))), 1, s.max_attachments)).alias("attachments"),
        F.coalesce(F.col("mail.encoding"), F.lit("utf-8")).alias("encoding_detected"), F.length("content").alias("raw_size_bytes"),
    )
    chosen = docs.withColumn("__body", F.when(F.col("body_text") != "", F.col("body_text")).otherwise(F.coalesce(html_to_text("body_html"), F.lit(""))))
    clean = redact(canonicalise(chosen, "__body", "__canonical"), "__canonical", "canonical_text", level, salt).drop("__body", "__canonical")
    versions = VERSIONS | {"pii_redaction_level": level}
    out = clean.withColumn("pipeline_version", F.struct(*(F.lit(v).alias(k) for k, v in versions.items())))
    return out if store_html else out.withColumn("body_html", F.lit(None).cast("string"))


def version_name() -> str:
    return "Pipeline-{dictionary_version}-{model_version}-{tool_calling_version}".format(**VERSIONS)
