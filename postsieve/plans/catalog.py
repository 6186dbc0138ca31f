"""Named queries over the given tables, each with SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postsieve.functions import signals, terms, text
from postsieve.operators import candidates, canonical, classify, dictionary, entities, evaluate, relevance
from postsieve.plans import oracle as o
from postsieve.plans import triage
from postsieve.plans import views as v
from postsieve.settings import DEFAULT
from postsieve.sources import lists, mail
from postsieve.sources.tables import load

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def emails(spark: SparkSession, sf_dir: str) -> DataFrame:
    return v.over(spark, sf_dir, v.EMAILS)


def canon(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mails with the canonical body."""
    return emails(spark, sf_dir).withColumn("body", text.canonical(F.col("body")))


MAILS = f"WITH emails AS ({v.EMAILS}) "
CANON = f"WITH {o.emails_cte(v.EMAILS)} "
_NOW = datetime(2024, 1, 31)


# Raw mails

#: A raw mail for each document: plain text, text with an attachment, or HTML.
_HEADERS = """'Message-ID: <m' || CAST(doc_id AS STRING) || '@example.org>' || chr(13) || chr(10) || 'From: Anna Neri <anna.neri@business.com>' || chr(13) || chr(10) || 'To: uno@example.org, due@example.org' || chr(13) || chr(10)
  || 'Subject: Pratica ' || CAST(doc_id AS STRING) || chr(13) || chr(10) || 'Date: Mon, 01 Jan 2024 10:00:00 +0100' || chr(13) || chr(10) || CASE WHEN doc_id % 2 = 0 THEN 'References: <a@example.org> <b@example.org>' || chr(13) || chr(10) ELSE '' END || 'MIME-Version: 1.0' || chr(13) || chr(10)"""
_PLAIN = "'Content-Type: text/plain; charset=utf-8' || chr(13) || chr(10) || 'Content-Transfer-Encoding: 8bit' || chr(13) || chr(10) || chr(13) || chr(10) || coalesce(text, '')"
_HTML = "'<p>Pratica ' || CAST(doc_id AS STRING) || '</p><ul><li>uno &amp; due</li><li>tre</li></ul><style>p { }</style>'"
_RAW_MAIL = f"""SELECT doc_id, text, {_HEADERS} || CASE doc_id % 3 WHEN 0 THEN {_PLAIN}
  WHEN 1 THEN 'Content-Type: multipart/mixed; boundary=xxyyzz' || chr(13) || chr(10) || chr(13) || chr(10) || '--xxyyzz' || chr(13) || chr(10) || {_PLAIN} || chr(13) || chr(10) || '--xxyyzz' || chr(13) || chr(10)
    || 'Content-Type: application/pdf' || chr(13) || chr(10) || 'Content-Disposition: attachment; filename="nota.pdf"' || chr(13) || chr(10) || 'Content-Transfer-Encoding: base64' || chr(13) || chr(10) || chr(13) || chr(10) || 'JVBERg==' || chr(13) || chr(10) || '--xxyyzz--' || chr(13) || chr(10)
  ELSE 'Content-Type: text/html; charset=utf-8' || chr(13) || chr(10) || chr(13) || chr(10) || {_HTML} END AS raw FROM documents """
_MAIL_BODY = "CASE WHEN doc_id % 3 < 2 AND coalesce(text, '') <> '' THEN text WHEN doc_id % 3 < 2 THEN '' ELSE 'Pratica ' || CAST(doc_id AS STRING) || chr(10) || 'uno & due' || chr(10) || 'tre' END"


@query(f"""WITH raw AS ({_RAW_MAIL}), b AS (SELECT *, {o.canonical(_MAIL_BODY)} AS body FROM raw), e AS (SELECT *, {o.redacted('body', o.EMAIL, 'EMAIL')} AS t FROM b)
SELECT 'eml-' || substring(sha256(raw), 1, 32) AS document_id, true AS success, 'Anna Neri <anna.neri@business.com>' AS from_address, 'uno@example.org|due@example.org' AS to_addresses, 'Pratica ' || CAST(doc_id AS VARCHAR) AS subject, '<m' || CAST(doc_id AS VARCHAR) || '@example.org>' AS message_id,
  CAST(CASE WHEN doc_id % 2 = 0 THEN 2 ELSE 0 END AS BIGINT) AS n_references, CASE WHEN doc_id % 3 = 1 THEN 'nota.pdf:application/pdf' ELSE '' END AS attachments, CASE WHEN doc_id % 3 = 1 THEN 'utf-8' ELSE 'utf-8' END AS encoding, CAST(strlen(raw) AS BIGINT) AS raw_size_bytes,
  md5(CASE WHEN doc_id % 3 < 2 THEN coalesce(text, '') ELSE '' END) AS body_digest, md5(CASE WHEN doc_id % 3 = 2 THEN {_HTML} ELSE '' END) AS html_digest, md5({o.redacted('t', o.PHONE, 'PHONE')}) AS canonical_digest FROM e""")
def mail_ingest(spark, d):
    raw = v.over(spark, d, _RAW_MAIL).select(F.col("doc_id").cast("string").alias("path"), F.encode("raw", "UTF-8").alias("content"))
    out = mail.ingest(raw, store_html=True)
    digest = lambda c: F.md5(F.encode(F.coalesce(F.col(c), F.lit("")), "UTF-8"))
    listed = F.transform(F.coalesce("attachments", F.array().cast("array<struct<filename:string,content_type:string,size_bytes:int,content_id:string>>")), lambda a: F.concat_ws(":", a["filename"], a["content_type"]))
    return out.select(
        "document_id", "success", "headers.from_address", F.array_join("headers.to_addresses", "|").alias("to_addresses"), "headers.subject", "headers.message_id", F.size("headers.references").cast("long").alias("n_references"), F.array_join(listed, "|").alias("attachments"),
        F.col("encoding_detected").alias("encoding"), F.col("raw_size_bytes").cast("long").alias("raw_size_bytes"), digest("body_text").alias("body_digest"), digest("body_html").alias("html_digest"), digest("canonical_text").alias("canonical_digest"),
    )


# Canonical text and redaction


@query(MAILS + "SELECT * FROM emails")
def emails_view(spark, d):
    return emails(spark, d)


@query(MAILS + f"SELECT doc_id, {o.whitespace('body')} AS text FROM emails")
def canon_whitespace(spark, d):
    return emails(spark, d).select("doc_id", text.normal_whitespace(F.col("body")).alias("text"))


@query(MAILS + f", w AS (SELECT doc_id, {o.whitespace('body')} AS b FROM emails) SELECT doc_id, {o.disclaimer('b')} AS text, length(b) - length({o.disclaimer('b')}) AS removed FROM w")
def canon_disclaimer(spark, d):
    w = emails(spark, d).select("doc_id", text.normal_whitespace(F.col("body")).alias("b"))
    cut = F.get(text.disclaimer_section(F.col("b")), F.lit(0))
    return w.select("doc_id", text.without_disclaimer(F.col("b")).alias("text"), F.coalesce(cut["span_end"] - cut["span_start"], F.lit(0)).cast("long").alias("removed"))


@query(MAILS + f", w AS (SELECT doc_id, {o.disclaimer(o.whitespace('body'))} AS b FROM emails), c AS (SELECT doc_id, b, {o.signature('b')} AS t FROM w) SELECT doc_id, t AS text, CASE WHEN t <> b THEN CAST(length(t) + CASE WHEN substring(b, length(t) + 1, 1) = chr(10) THEN 1 ELSE 0 END AS BIGINT) ELSE -1 END AS span_start FROM c")
def canon_signature(spark, d):
    w = emails(spark, d).select("doc_id", text.without_disclaimer(text.normal_whitespace(F.col("body"))).alias("b"))
    return w.select("doc_id", text.without_signature(F.col("b")).alias("text"), F.coalesce(F.get(text.signature_section(F.col("b")), F.lit(0))["span_start"], F.lit(-1)).cast("long").alias("span_start"))


@query(MAILS + f", u AS (SELECT doc_id, {o.unsigned('body')} AS b FROM emails) SELECT doc_id, {o.replies('b')} AS text FROM u")
def canon_reply(spark, d):
    return emails(spark, d).select("doc_id", text.without_replies(text.without_signature(text.without_disclaimer(text.normal_whitespace(F.col("body"))))).alias("text"))


@query(MAILS + f""", u AS (SELECT doc_id, string_split({o.unsigned('body')}, chr(10)) AS ls FROM emails),
l AS (SELECT doc_id, i, ls[i] AS line, coalesce(list_sum(list_transform(ls[1:i - 1], lambda x: length(x) + 1)), 0) AS pos, regexp_matches({o.strip('ls[i]')}, {o.QUOTED}) AS q, {o.strip('ls[i]')} = '' AS blank FROM u, unnest(range(1, len(ls) + 1)) AS r(i)),
g AS (SELECT *, sum(CASE WHEN NOT q AND NOT blank THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS block FROM l)
SELECT doc_id, CASE WHEN bool_or(regexp_matches({o.strip('line')}, '^[>|]')) THEN 'quote' ELSE 'reply_header' END AS type, CAST(min(pos) AS BIGINT) AS span_start, CAST(min(pos) + length(string_agg(line, chr(10) ORDER BY i)) AS BIGINT) AS span_end, string_agg(line, chr(10) ORDER BY i) AS content
FROM g WHERE q GROUP BY doc_id, block""")
def reply_sections(spark, d):
    u = emails(spark, d).select("doc_id", text.without_signature(text.without_disclaimer(text.normal_whitespace(F.col("body")))).alias("b"))
    found = u.select("doc_id", F.explode(text.reply_sections(F.col("b"))).alias("s")).select("doc_id", "s.*")
    return found.withColumns({c: F.col(c).cast("long") for c in ("span_start", "span_end")})


@query(CANON + "SELECT doc_id, body AS canonical_text FROM canon")
def canon_full(spark, d):
    return canonical.canonicalise(emails(spark, d), "body").select("doc_id", "canonical_text")


@query("SELECT page_id, regexp_replace('vedi ' || url || ' e ' || url || '/x?y=1 oggi', 'https?://[^\\s]+', '[URL]', 'g') AS text FROM pages")
def url_replace(spark, d):
    page = load(spark, d, "pages")
    return page.select("page_id", text.replace_urls(F.concat(F.lit("vedi "), F.col("url"), F.lit(" e "), F.col("url"), F.lit("/x?y=1 oggi"))).alias("text"))


def _unescape_sql(x: str) -> str:
    for name, char in text.ENTITIES.items():
        x = f"replace({x}, {o.quoted(name)}, {o.quoted(char)})"
    return x


_TAGLESS = "regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script[^>]*>.*?</script>', '', 'g'), '(?is)<style[^>]*>.*?</style>', '', 'g'), '<[^>]+>', '', 'g')"


@query(f"""SELECT page_id, {o.strip(f"regexp_replace({_unescape_sql(_TAGLESS)}, '\\s+', ' ', 'g')")} AS text FROM pages""")
def html_strip(spark, d):
    return load(spark, d, "pages").select("page_id", text.strip_html(F.col("html")).alias("text"))


_MARKUP = """'<p><IMG alt="x" src="https://t.example.org/tracking/' || CAST(page_id AS STRING) || '.gif"><a class="m" href="mailto:a@b.it">scrivi <b>qui</b></a></p>' || html"""


@query(f"""SELECT page_id, regexp_replace(regexp_replace({_MARKUP}, '(?i)<img[^>]*src=[''"][^''"]*tracking[^''"]*[''"][^>]*>', '', 'g'), '(?i)<a[^>]*href=[''"]mailto:[^''"]*[''"][^>]*>(.*?)</a>', '\\1', 'g') AS html FROM pages""")
def html_clean(spark, d):
    return load(spark, d, "pages").select("page_id", F.expr(_MARKUP).alias("h")).select("page_id", text.clean_html(F.col("h")).alias("html"))


@query(CANON + f"SELECT doc_id, {o.redacted('body', o.EMAIL, 'EMAIL')} AS text, CAST(len(regexp_extract_all(body, {o.EMAIL})) AS BIGINT) AS n FROM canon")
def pii_email(spark, d):
    out = canonical.redact(canon(spark, d), "body", "text", level="minimal")
    return out.select("doc_id", "text", F.size("pii_redaction_log").cast("long").alias("n"))


@query(CANON + f", m AS (SELECT doc_id, {o.redacted('body', o.EMAIL, 'EMAIL')} AS t FROM canon) SELECT doc_id, {o.redacted('t', o.PHONE, 'PHONE')} AS text FROM m")
def pii_phone(spark, d):
    return canonical.redact(canon(spark, d), "body", "text").select("doc_id", "text")


def _log_sql(kind: str, table: str, x: str, pattern: str) -> str:
    return f"""SELECT doc_id, '{kind}' AS type, s AS start, s + length(hit) AS "end", 'sha256-' || sha256('sale' || hit) AS original_hash, '[{kind.upper()}_' || CAST(i AS VARCHAR) || ']' AS placeholder FROM ({o.spans(table, x, pattern)})"""


@query(CANON + f", m AS (SELECT doc_id, {o.redacted('body', o.EMAIL, 'EMAIL')} AS t FROM canon) {_log_sql('email', 'canon', 'body', o.EMAIL)} UNION ALL {_log_sql('phone', 'm', 't', o.PHONE)}")
def pii_hash_log(spark, d):
    rows = canonical.redact(canon(spark, d), "body", "text", salt="sale").select("doc_id", F.explode_outer("pii_redaction_log").alias("e")).filter("e is not null")  # an inner explode would infer a filter on the log's size, and run it twice
    return rows.select("doc_id", "e.type", F.get("e.position", F.lit(0)).cast("long").alias("start"), F.get("e.position", F.lit(1)).cast("long").alias("end"), "e.original_hash", "e.placeholder")


# Candidates


@query(CANON + f"SELECT doc_id, CAST(len(t) AS BIGINT) AS n_tokens, md5(array_to_string(t, ' ')) AS digest FROM (SELECT doc_id, {o.tokens('body')} AS t FROM canon)")
def tokens(spark, d):
    t = canon(spark, d).select("doc_id", terms.tokens(F.col("body")).alias("t"))
    return t.select("doc_id", F.size("t").cast("long").alias("n_tokens"), F.md5(F.array_join("t", " ").cast("binary")).alias("digest"))


@query(CANON + ", t AS (SELECT doc_id, " + o.tokens("body") + " AS t FROM canon) " + " UNION ALL ".join(f"SELECT doc_id, {n} AS n, CAST(len(g) AS BIGINT) AS size, md5(array_to_string(g, '|')) AS digest FROM (SELECT doc_id, {o.ngrams('t', n)} AS g FROM t)" for n in (1, 2, 3)))
def ngrams(spark, d):
    t = canon(spark, d).select("doc_id", terms.tokens(F.col("body")).alias("t"))
    rows = t.select("doc_id", F.explode(F.array(*(F.struct(F.lit(n).alias("n"), terms.ngrams(F.col("t"), n).alias("g")) for n in (1, 2, 3)))).alias("x"))
    return rows.select("doc_id", "x.n", F.size("x.g").cast("long").alias("size"), F.md5(F.array_join("x.g", "|").cast("binary")).alias("digest"))


def _summary(rows: DataFrame) -> DataFrame:
    return rows.groupBy("doc_id", "source", "ngram_size").agg(F.count(F.lit(1)).alias("n_terms"), F.sum("count").cast("long").alias("n_occurrences"), F.min("candidate_id").alias("first_id"), F.max("candidate_id").alias("last_id"), F.min("term").alias("first_term"))


_SUMMARY = "SELECT doc_id, source, ngram_size, count(*) AS n_terms, CAST(sum(count) AS BIGINT) AS n_occurrences, min(candidate_id) AS first_id, max(candidate_id) AS last_id, min(term) AS first_term FROM {} GROUP BY doc_id, source, ngram_size"
_RAW = CANON + f", raw AS ({o.raw_candidates('canon')})"


@query(_RAW + _SUMMARY.format("raw"))
def candidates_raw(spark, d):
    return _summary(candidates.build(canon(spark, d)))


@query(_RAW + f", f AS (SELECT * FROM raw WHERE {o.kept()})" + _SUMMARY.format("f"))
def candidates_filtered(spark, d):
    return _summary(candidates.filtered(candidates.build(canon(spark, d))))


@query(_RAW + f", f AS (SELECT *, {o.SCORE} AS score FROM raw WHERE {o.kept()}) SELECT doc_id, count(*) AS n, round(sum(score), 6) AS total, round(max(score), 9) AS best FROM f GROUP BY doc_id")
def candidates_scored(spark, d):
    rows = candidates.scored(candidates.filtered(candidates.build(canon(spark, d))))
    return rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("composite_score"), 6).alias("total"), F.round(F.max("composite_score"), 9).alias("best"))


@query(_RAW + f", c AS (SELECT doc_id, count(*) AS n_raw, count_if({o.kept()}) AS n_filtered FROM raw GROUP BY doc_id) SELECT canon.doc_id, CAST(len({o.tokens('subject')}) AS BIGINT) AS n_subject_tokens, CAST(len({o.tokens('body')}) AS BIGINT) AS n_body_tokens, coalesce(n_raw, 0) AS n_raw, CAST(coalesce(n_filtered, 0) AS BIGINT) AS n_filtered FROM canon LEFT JOIN c ON c.doc_id = canon.doc_id")
def candidate_stats(spark, d):
    return candidates.stats(canon(spark, d))


_ORDER = "ORDER BY round(score, 12) DESC, source DESC, count DESC, term"
_SCORED = f", f AS (SELECT *, {o.SCORE} AS score FROM raw WHERE {o.kept()}), k AS (SELECT *, row_number() OVER (PARTITION BY doc_id {_ORDER}) AS rank FROM f)"


@query(_RAW + _SCORED + " SELECT doc_id, CAST(count(*) AS BIGINT) AS n, string_agg(candidate_id || ':' || source || ':' || CAST(count AS VARCHAR), ',' ORDER BY rank) AS listed FROM k WHERE rank <= 100 GROUP BY doc_id")
def prompt_candidates(spark, d):
    rows = candidates.ranked(candidates.scored(candidates.filtered(candidates.build(canon(spark, d))))).filter("rank <= 100")
    item = F.struct("rank", F.concat_ws(":", "candidate_id", "source", F.col("count").cast("string")).alias("x"))
    return rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.array_join(F.transform(F.array_sort(F.collect_list(item)), lambda x: x["x"]), ",").alias("listed"))


@query()
def candidates_relevant(spark, d):
    rows = candidates.best(canon(spark, d), embedded=relevance.scorer().of_words, positive=True)
    return rows.select("doc_id", "rank", "source", "term", "embedding_score", F.round("composite_score", 9).alias("composite_score"))


_STATUS = f"""
SELECT c.doc_id, c.subject, c.body, c.from_address, CASE WHEN lower(trim(c.from_address)) IN ({', '.join(o.quoted(x) for x in lists.DEFAULT.known_emails)}) THEN 'exact'
  WHEN split_part(lower(trim(c.from_address)), '@', 2) IN ({', '.join(o.quoted(x) for x in lists.DEFAULT.known_domains)}) THEN 'domain' ELSE 'none' END AS crm_match, {o.text_signal('c.body')} AS signal FROM canon c
"""
_TOLD = f""", s AS ({_STATUS}), told AS (SELECT *, CASE WHEN crm_match <> 'none' OR signal = 'existing' THEN 'existing' ELSE 'new' END AS value,
  CASE WHEN crm_match = 'exact' THEN 1.0 WHEN crm_match = 'domain' THEN 0.7 WHEN signal = 'existing' THEN 0.5 WHEN signal = 'new' THEN 0.6 ELSE 0.8 END AS confidence,
  CASE WHEN crm_match = 'exact' THEN 'crm_exact_match' WHEN crm_match = 'domain' THEN 'crm_domain_match' WHEN signal IS NOT NULL THEN 'text_signal' ELSE 'no_crm_no_signal' END AS source FROM s)"""
_NEGATIVE = "doc_id % 4 = 2"
_PRIORITY = _TOLD + f", p AS (SELECT doc_id, value, confidence, {o.priority_score('(lower(subject || chr(32) || body))', _NEGATIVE, chr(39).join(['value = ', 'new', '']))} AS raw_score FROM told)"


def _triaged(spark, d) -> DataFrame:
    mails = canon(spark, d).withColumns({"sentiment": F.when(F.col("doc_id") % 4 == 2, "negative").otherwise("neutral"), "vip": F.lit(False)})
    return classify.triage(mails, lists.known_emails(spark), lists.known_domains(spark))


@query(_RAW + _SCORED + _PRIORITY + f" SELECT k.doc_id, k.rank, k.term, k.source, k.count, round(k.score, 6) AS score, {o.bucket('p.raw_score')} AS priority FROM k JOIN p ON p.doc_id = k.doc_id WHERE k.rank <= 10")
def triage_topk(spark, d):
    urgent = _triaged(spark, d).withColumn("urgency", F.col("priority.value"))
    top = candidates.best(urgent, 10, keep=("urgency",))
    return top.select("doc_id", F.col("rank").cast("long").alias("rank"), "term", "source", "count", F.round("composite_score", 6).alias("score"), F.col("urgency").alias("priority"))


# Status, deadlines, priority


@query(CANON + f" SELECT doc_id, crm_match FROM ({_STATUS})")
def crm_lookup(spark, d):
    return classify.known_senders(canon(spark, d), lists.known_emails(spark), lists.known_domains(spark)).select("doc_id", "crm_match")


@query(CANON + f" SELECT doc_id, {o.text_signal('body')} AS signal FROM canon")
def text_signals(spark, d):
    return canon(spark, d).select("doc_id", signals.text_signal(F.col("body")).alias("signal"))


@query(CANON + _TOLD + " SELECT doc_id, value, CAST(confidence AS DOUBLE) AS confidence, source FROM told")
def customer_status(spark, d):
    return _triaged(spark, d).select("doc_id", "customer_status.*")


@query(CANON + f" SELECT doc_id, {o.boost('body')} AS boost FROM canon")
def deadline(spark, d):
    return canon(spark, d).select("doc_id", signals.deadline_boost(F.col("body")).alias("boost"))


@query(CANON + _PRIORITY + f" SELECT doc_id, CAST(raw_score AS DOUBLE) AS raw_score, {o.bucket('raw_score')} AS value FROM p")
def priority(spark, d):
    return _triaged(spark, d).select("doc_id", "priority.raw_score", "priority.value")


# Model output


def _outputs(spark, d) -> DataFrame:
    return v.over(spark, d, v.OUTPUTS)


def _offered(spark, d) -> DataFrame:
    return v.over(spark, d, v.OFFERED)


def _validated(spark, d) -> DataFrame:
    return classify.validate(_outputs(spark, d), _offered(spark, d))


#: Topics and keywords of readable outputs, with their places; then the faults of each stage.
_PARSED = f"""WITH outputs AS ({v.OUTPUTS}), offered AS ({v.OFFERED}),
j AS (SELECT doc_id, CASE WHEN json_valid(json) THEN CAST(json AS JSON) END AS j FROM outputs),
t AS (SELECT doc_id, i - 1 AS topic, j -> ('$.topics[' || CAST(i - 1 AS VARCHAR) || ']') AS t FROM j, unnest(range(1, CAST(json_array_length(j, '$.topics') AS BIGINT) + 1)) AS r(i) WHERE j IS NOT NULL),
tt AS (SELECT doc_id, topic, t ->> '$.label_id' AS label_id, t ->> '$.confidence' AS confidence, CAST(json_array_length(t, '$.evidence') AS INT) AS n_evidence, t FROM t),
k AS (SELECT doc_id, topic, label_id, i - 1 AS keyword, t ->> ('$.keywords_in_text[' || CAST(i - 1 AS VARCHAR) || '].candidate_id') AS candidate_id, t ->> ('$.keywords_in_text[' || CAST(i - 1 AS VARCHAR) || '].lemma') AS lemma,
  CAST(t ->> ('$.keywords_in_text[' || CAST(i - 1 AS VARCHAR) || '].count') AS INT) AS count FROM tt, unnest(range(1, CAST(json_array_length(t, '$.keywords_in_text') AS BIGINT) + 1)) AS r(i)),
bad_schema AS (SELECT doc_id, count(*) AS n FROM (
  SELECT doc_id FROM j WHERE j IS NULL
  UNION ALL SELECT doc_id FROM j WHERE j IS NOT NULL AND (j -> '$.sentiment') IS NULL
  UNION ALL SELECT doc_id FROM j WHERE j IS NOT NULL AND (j ->> '$.customer_status.source') IS NULL
  UNION ALL SELECT doc_id FROM j WHERE (j ->> '$.sentiment.value') NOT IN ('positive', 'neutral', 'negative')
  UNION ALL SELECT doc_id FROM tt WHERE label_id NOT IN ({', '.join(map(o.quoted, classify.TOPICS))})
  UNION ALL SELECT doc_id FROM tt WHERE TRY_CAST(confidence AS DOUBLE) IS NULL OR NOT TRY_CAST(confidence AS DOUBLE) BETWEEN 0 AND 1) GROUP BY doc_id),
bad_rules AS (SELECT k.doc_id, count(*) AS n FROM k LEFT JOIN offered f ON f.doc_id = k.doc_id AND f.candidate_id = k.candidate_id WHERE f.doc_id IS NULL AND k.doc_id NOT IN (SELECT doc_id FROM bad_schema) GROUP BY k.doc_id),
first_t AS (SELECT *, row_number() OVER (PARTITION BY doc_id, label_id ORDER BY topic) AS r FROM tt WHERE doc_id NOT IN (SELECT doc_id FROM bad_schema)),
first_k AS (SELECT k.*, row_number() OVER (PARTITION BY k.doc_id, k.topic, k.candidate_id ORDER BY keyword) AS rk FROM k JOIN first_t f ON f.doc_id = k.doc_id AND f.topic = k.topic AND f.r = 1),
warned AS (SELECT doc_id, count(*) AS n FROM (SELECT doc_id FROM first_t WHERE CAST(confidence AS DOUBLE) < 0.2 UNION ALL SELECT doc_id FROM first_t WHERE r > 1 UNION ALL SELECT doc_id FROM first_k WHERE rk > 1) GROUP BY doc_id),
good_t AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY topic) - 1 AS topic, topic AS place, label_id, CAST(confidence AS DOUBLE) AS confidence, n_evidence FROM first_t WHERE r = 1 AND doc_id NOT IN (SELECT doc_id FROM bad_rules)),
good_k AS (SELECT g.doc_id, g.topic, g.label_id, g.confidence, g.n_evidence, row_number() OVER (PARTITION BY g.doc_id, g.topic ORDER BY keyword) - 1 AS keyword, candidate_id, lemma, count FROM first_k f JOIN good_t g ON g.doc_id = f.doc_id AND g.place = f.topic WHERE rk = 1)
"""


@query(f"WITH outputs AS ({v.OUTPUTS}) SELECT doc_id, json FROM outputs")
def llm_outputs(spark, d):
    return _outputs(spark, d)


@query(_PARSED + """SELECT j.doc_id, CAST(coalesce(s.n, r.n, 0) AS BIGINT) AS n_errors, CAST(coalesce(w.n, 0) AS BIGINT) AS n_warnings, coalesce(s.n, r.n, 0) = 0 AS valid, s.n IS NULL AND r.n IS NOT NULL AS should_retry
FROM j LEFT JOIN bad_schema s ON s.doc_id = j.doc_id LEFT JOIN bad_rules r ON r.doc_id = j.doc_id LEFT JOIN warned w ON w.doc_id = j.doc_id""")
def llm_validate(spark, d):
    return _validated(spark, d).select("doc_id", F.size("errors").cast("long").alias("n_errors"), F.size("warnings").cast("long").alias("n_warnings"), "valid", "should_retry")


@query(_PARSED + "SELECT doc_id, CAST(topic AS INT) AS topic, label_id, confidence, CAST(n_evidence AS INT) AS n_evidence, CAST(keyword AS INT) AS keyword, candidate_id, lemma, count FROM good_k")
def llm_dedup(spark, d):
    return classify.exploded_keywords(_validated(spark, d))


_INDEX = ", ix AS (SELECT doc_id, lemma, count(DISTINCT label_id) AS n, string_agg(DISTINCT label_id, ',' ORDER BY label_id) AS labels FROM good_k GROUP BY doc_id, lemma)"


@query(_PARSED + _INDEX + " SELECT doc_id, lemma, labels FROM ix")
def collision_index(spark, d):
    ix = classify.collision_index(classify.exploded_keywords(_validated(spark, d)))
    return ix.select("doc_id", "lemma", F.array_join("labels", ",").alias("labels"))


def _adjusted(spark, d) -> DataFrame:
    k = classify.exploded_keywords(_validated(spark, d))
    return classify.adjusted_confidence(k, _offered(spark, d), classify.collision_index(k))


_ADJUSTED = _INDEX + """, parts AS (SELECT g.doc_id, g.topic, g.label_id, g.confidence, g.n_evidence, avg(coalesce(f.composite_score, 0)) AS kw, avg(1.0 / ix.n) AS coll
  FROM good_k g LEFT JOIN offered f ON f.doc_id = g.doc_id AND f.candidate_id = g.candidate_id JOIN ix ON ix.doc_id = g.doc_id AND ix.lemma = g.lemma GROUP BY g.doc_id, g.topic, g.label_id, g.confidence, g.n_evidence),
adj AS (SELECT doc_id, CAST(topic AS INT) AS topic, label_id, confidence, 0.3 * confidence + 0.4 * kw + 0.2 * least(n_evidence / 2.0, 1.0) + 0.1 * coll AS adjusted FROM parts)"""


@query(_PARSED + _ADJUSTED + " SELECT doc_id, topic, label_id, confidence, CAST(round(adjusted, 9) AS DOUBLE) AS confidence_adjusted FROM adj")
def confidence_adjusted(spark, d):
    return _adjusted(spark, d).select("doc_id", "topic", "label_id", "confidence", F.round("confidence_adjusted", 9).alias("confidence_adjusted"))


@query(_PARSED + _ADJUSTED + " SELECT doc_id, topic, label_id FROM adj WHERE adjusted >= 0.3")
def topic_filter(spark, d):
    return classify.confident(_adjusted(spark, d)).select("doc_id", "topic", "label_id")


@query()
def classify_offline(spark, d):
    out = triage.classified(canon(spark, d))
    labels = F.transform("topics", lambda t: F.concat_ws(":", t["label_id"], F.round(t["confidence_adjusted"], 6).cast("string")))
    return out.select("doc_id", F.array_join(labels, ",").alias("topics"), F.col("sentiment.value").alias("sentiment"), F.col("priority.value").alias("priority"), F.col("customer_status.value").alias("customer_status"), "valid", F.size("errors").alias("n_errors"))


# Dictionary


def _observations(spark, d) -> DataFrame:
    words = candidates.filtered(candidates.build(canon(spark, d), replace(DEFAULT, max_ngram=1)))
    return v.over(spark, d, v.OBSERVED, words=words.select("doc_id", "term", "count"))


_OBS = CANON + f", words AS (SELECT doc_id, term, count FROM ({o.raw_candidates('canon', (1,))}) WHERE {o.kept()}), obs AS ({v.OBSERVED})"
_STATS = _OBS + ", st AS (SELECT label_id, lemma, count(DISTINCT message_id) AS doc_freq, CAST(sum(count) AS BIGINT) AS total_count, coalesce(avg(CASE WHEN embedding_score > 0 THEN embedding_score END), 0) AS emb, string_agg(DISTINCT term, ',' ORDER BY term) AS surface_forms FROM obs GROUP BY label_id, lemma)"


@query(_STATS + " SELECT label_id, lemma, doc_freq, total_count, round(emb, 9) AS avg_embedding_score, surface_forms FROM st")
def kw_stats(spark, d):
    st = dictionary.keyword_stats(_observations(spark, d))
    return st.select("label_id", "lemma", "doc_freq", "total_count", F.round("avg_embedding_score", 9).alias("avg_embedding_score"), F.array_join("surface_forms", ",").alias("surface_forms"))


@query(_STATS + " SELECT lemma, string_agg(label_id, ',' ORDER BY label_id) AS labels FROM st GROUP BY lemma HAVING count(*) > 2")
def collisions(spark, d):
    found = dictionary.collisions(dictionary.keyword_stats(_observations(spark, d)))
    return found.select("lemma", F.array_join("labels", ",").alias("labels"))


_PROMOTED = _STATS + """, n AS (SELECT *, count(*) OVER (PARTITION BY lemma) AS n_labels FROM st), dec AS (SELECT *, CASE WHEN total_count < 5 THEN 'low_count' WHEN n_labels > 2 THEN 'high_collision'
  WHEN doc_freq >= 3 AND emb >= 0.35 AND n_labels <= 1 THEN 'regex' WHEN doc_freq >= 2 AND emb >= 0.25 THEN 'ner' ELSE 'insufficient_evidence' END AS r FROM n),
promoted AS (SELECT label_id, lemma, doc_freq, surface_forms, n_labels, CASE r WHEN 'low_count' THEN 'rejected' WHEN 'regex' THEN 'regex_active' WHEN 'ner' THEN 'ner_active' ELSE 'quarantined' END AS decision, CASE WHEN r NOT IN ('regex', 'ner') THEN r END AS reason FROM dec
  UNION ALL SELECT label_id, lemma, doc_freq, surface_forms, n_labels, 'ner_active', NULL FROM dec WHERE r = 'regex')"""


def _promoted(spark, d) -> DataFrame:
    return dictionary.promote(dictionary.keyword_stats(_observations(spark, d)))


@query(_PROMOTED + " SELECT label_id, lemma, n_labels, decision, reason FROM promoted")
def promote(spark, d):
    return _promoted(spark, d).select("label_id", "lemma", F.col("n_labels").cast("long").alias("n_labels"), "decision", "reason")


@query(_PROMOTED + r""" SELECT label_id, lemma, '(?i)\b(' || replace(surface_forms, ',', '|') || ')\b' AS regex_pattern FROM promoted WHERE decision = 'regex_active'""")
def safe_regex(spark, d):
    return _promoted(spark, d).filter("decision = 'regex_active'").select("label_id", "lemma", "regex_pattern")


@query(_STATS + " SELECT lemma, label_id AS winner, round(emb, 9) AS score FROM (SELECT *, count(*) OVER (PARTITION BY lemma) AS n, row_number() OVER (PARTITION BY lemma ORDER BY emb DESC, label_id) AS r FROM st) WHERE n > 1 AND r = 1")
def collision_resolve(spark, d):
    return dictionary.resolve_by_score(dictionary.keyword_stats(_observations(spark, d))).select("lemma", "winner", F.round("avg_embedding_score", 9).alias("score"))


def _lexicon(spark, d) -> DataFrame:
    """Promoted entries; those of longer lemmas were added in later versions."""
    return _promoted(spark, d).withColumn("dict_version_added", (F.length("lemma") % 3 + 1).cast("int"))


@query(_PROMOTED + " SELECT CAST(2 AS INT) AS version, count_if(decision = 'regex_active') AS regex_entries, count_if(decision = 'ner_active') AS ner_entries FROM promoted WHERE decision LIKE '%active' AND length(lemma) % 3 + 1 <= 2".replace("count_if(", "count(*) FILTER (WHERE "))
def lexicon_freeze(spark, d):
    return dictionary.frozen(_lexicon(spark, d), 2)


@query(_PROMOTED + " SELECT label_id, lemma, surface_forms FROM promoted WHERE decision = 'ner_active' AND length(lemma) % 3 + 1 <= 2")
def active_lexicon(spark, d):
    return dictionary.active(_lexicon(spark, d), 2, "ner").select("label_id", "lemma", F.array_join("surface_forms", ",").alias("surface_forms"))


@query(_OBS + " SELECT message_id, label_id, lemma, term, count, observed_at FROM obs WHERE observed_at >= TIMESTAMP '2024-01-21 00:00:00' AND label_id = 'DOCUMENTI'")
def recent_observations(spark, d):
    rows = _observations(spark, d).withColumn("obs_id", F.concat_ws("|", F.col("message_id").cast("string"), "label_id", "lemma"))
    return dictionary.recent(rows, _NOW, 10, "DOCUMENTI", None).select("message_id", "label_id", "lemma", "term", "count", "observed_at")


@query(_OBS + " SELECT label_id, count(*) AS n, CAST(count(*) FILTER (WHERE message_id % 5 = 0) AS BIGINT) AS promoted FROM obs GROUP BY label_id")
def mark_promoted(spark, d):
    rows = _observations(spark, d).withColumn("obs_id", F.sha1(F.concat_ws("|", F.col("message_id").cast("string"), "label_id", "lemma", "term").cast("binary"))).withColumn("promoted_to_active", F.lit(False))
    marked = dictionary.mark_promoted(rows, rows.filter("message_id % 5 = 0").select("obs_id"))
    return marked.groupBy("label_id").agg(F.count(F.lit(1)).alias("n"), F.count_if("promoted_to_active").alias("promoted"))


# Entities

_LEXICON = [("A", "servizio", ["servizio", "servizi"]), ("A", "cliente", ["cliente", "numero cliente"]), ("A", "the", ["the", "of the", "and"]), ("B", "rimborso", ["rimborso"]), ("B", "contatto", ["primo contatto", "contatto"]), ("B", "le", ["le", "la"])]
_PATTERNS = [("A", "cliente", r"\b(cliente|clienti)\b"), ("A", "cifre", r"[0-9]{4,}"), ("A", "rotto", "(?P<aperto"), ("B", "giorni", r"entro [0-9]+ giorni")]


def _texts(spark, d) -> DataFrame:
    return canon(spark, d).select("doc_id", F.when(F.col("doc_id") % 2 == 0, "A").otherwise("B").alias("label_id"), F.col("body").alias("text"))


def _gazetteer(spark) -> DataFrame:
    return spark.createDataFrame(_LEXICON, "label_id string, lemma string, surface_forms array<string>")


_FORMS = " UNION ALL ".join(f"SELECT '{a}' AS label_id, '{b}' AS lemma, '{f}' AS form" for a, b, fs in _LEXICON for f in fs)
_GAZETTEER = CANON + f""", forms AS ({_FORMS}), hits AS (SELECT c.doc_id, f.lemma AS label, f.form, c.body, CAST(i AS BIGINT) AS i FROM canon c JOIN forms f ON f.label_id = CASE WHEN c.doc_id % 2 = 0 THEN 'A' ELSE 'B' END, unnest(range(1, len(string_split(c.body, f.form)))) AS r(i)),
spans AS (SELECT doc_id, label, form, body, CAST(list_sum(list_transform(string_split(body, form)[1:i], lambda g: length(g))) + (i - 1) * length(form) AS BIGINT) AS start FROM hits),
alone AS (SELECT DISTINCT doc_id, label, start, start + length(form) AS "end" FROM spans WHERE NOT regexp_matches(CASE WHEN start > 0 THEN substring(body, start, 1) ELSE '' END, '[\\p{{L}}\\p{{N}}]') AND NOT regexp_matches(substring(body, start + length(form) + 1, 1), '[\\p{{L}}\\p{{N}}]'))"""


@query(_GAZETTEER + ' SELECT doc_id, label, CAST(count(*) AS BIGINT) AS n, CAST(min(start) AS BIGINT) AS first_start, CAST(sum("end") AS BIGINT) AS ends FROM alone GROUP BY doc_id, label')
def entities_lexicon(spark, d):
    hits = entities.by_lexicon(_texts(spark, d), _gazetteer(spark))
    return hits.groupBy("doc_id", "label").agg(F.count(F.lit(1)).alias("n"), F.min("start").cast("long").alias("first_start"), F.sum("end").cast("long").alias("ends"))


def _regex_sql(label: str, lemma: str, pattern: str) -> str:
    return f"SELECT doc_id, '{lemma}' AS label, CAST(count(*) AS BIGINT) AS n, CAST(min(s) AS BIGINT) AS first_start, CAST(sum(s + length(hit)) AS BIGINT) AS ends FROM ({o.spans(f'{label}_texts', 'body', o.quoted(pattern))}) GROUP BY doc_id"


@query(CANON + ", A_texts AS (SELECT * FROM canon WHERE doc_id % 2 = 0), B_texts AS (SELECT * FROM canon WHERE doc_id % 2 = 1) " + " UNION ALL ".join(_regex_sql(*p) for p in _PATTERNS if p[1] not in ("rotto",)))
def entities_regex(spark, d):
    lexicon = spark.createDataFrame(_PATTERNS, "label_id string, lemma string, regex_pattern string")
    hits = entities.by_regex(_texts(spark, d), lexicon)
    return hits.groupBy("doc_id", "label").agg(F.count(F.lit(1)).alias("n"), F.min("start").cast("long").alias("first_start"), F.sum("end").cast("long").alias("ends"))


_TRIED = [(lemma, pattern) for _, lemma, pattern in _PATTERNS]


@query(CANON + " " + " UNION ALL ".join(f"SELECT doc_id, '{n}' AS name, CAST(len(m) AS BIGINT) AS n, coalesce(m[1], '') AS first_match FROM (SELECT doc_id, {'regexp_extract_all(body, ' + o.quoted(p) + ')' if n != 'rotto' else '[]::VARCHAR[]'} AS m FROM canon)" for n, p in _TRIED))
def pattern_test(spark, d):
    texts = canon(spark, d).select("doc_id", F.col("body").alias("text"))
    found = dictionary.pattern_matches(texts, spark.createDataFrame(_TRIED, "name string, pattern string"))
    return found.select("doc_id", "name", F.size("matches").cast("long").alias("n"), F.coalesce(F.get("matches", F.lit(0)), F.lit("")).alias("first_match"))


#: Overlapping spans by id: starts three apart, lengths and sources by modulo.
SPANS = """SELECT d.doc_id, CAST(w.i * 3 + d.doc_id % 3 AS INT) AS start, CAST(w.i * 3 + d.doc_id % 3 + 2 + (d.doc_id * 5 + w.i * 7) % 9 AS INT) AS "end", 't' || CAST(w.i AS STRING) AS text, 'l' || CAST(w.i % 3 AS STRING) AS label,
CASE (d.doc_id + w.i * 2) % 3 WHEN 0 THEN 'regex' WHEN 1 THEN 'lexicon' ELSE 'ner' END AS source, CAST(50 + (d.doc_id + w.i) % 50 AS DOUBLE) / 100 AS confidence
FROM documents d CROSS JOIN (SELECT 0 AS i UNION ALL SELECT 1 UNION ALL SELECT 2 UNION ALL SELECT 3 UNION ALL SELECT 4 UNION ALL SELECT 5 UNION ALL SELECT 6 UNION ALL SELECT 7) w"""
_MERGE = f"""WITH RECURSIVE e AS (SELECT *, CASE source WHEN 'regex' THEN 1 WHEN 'lexicon' THEN 2 ELSE 3 END AS pr FROM ({SPANS})),
o AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY start, "end" DESC, pr, confidence DESC, label, text) AS k FROM e),
f AS (
  SELECT doc_id, k, start, "end", pr, confidence, text AS last_text, CAST('' AS VARCHAR) AS done FROM o WHERE k = 1
  UNION ALL
  SELECT f.doc_id, n.k, CASE WHEN pick THEN n.start ELSE f.start END, CASE WHEN pick THEN n."end" ELSE f."end" END, CASE WHEN pick THEN n.pr ELSE f.pr END, CASE WHEN pick THEN n.confidence ELSE f.confidence END,
    CASE WHEN pick THEN n.text ELSE f.last_text END, CASE WHEN apart THEN f.done || f.last_text || ':' || CAST(f.start AS VARCHAR) || ':' || CAST(f."end" AS VARCHAR) || ',' ELSE f.done END
  FROM f JOIN o n ON n.doc_id = f.doc_id AND n.k = f.k + 1,
  LATERAL (SELECT n."end" <= f.start OR f."end" <= n.start AS apart) a,
  LATERAL (SELECT apart OR n.pr < f.pr OR (n.pr = f.pr AND (n."end" - n.start > f."end" - f.start OR (n."end" - n.start = f."end" - f.start AND n.confidence > f.confidence))) AS pick) b)
SELECT doc_id, done || last_text || ':' || CAST(start AS VARCHAR) || ':' || CAST("end" AS VARCHAR) AS kept FROM f WHERE k = 8"""


@query(_MERGE)
def entities_merge(spark, d):
    rows = v.over(spark, d, SPANS.replace('"end"', "`end`"))
    return entities.merged(rows).select("doc_id", F.array_join(F.transform("entities", lambda e: F.concat_ws(":", e["text"], e["start"].cast("string"), e["end"].cast("string"))), ",").alias("kept"))


# Evaluation

_TRUTH = "SELECT doc_id, 'quality' AS label_id FROM labels WHERE quality = 1 UNION ALL SELECT doc_id, 'toxic' FROM labels WHERE toxic = 1"
_GUESS = "SELECT l.doc_id, 'quality' AS label_id FROM labels l JOIN documents d ON d.doc_id = l.doc_id WHERE d.n_chars > 500 UNION ALL SELECT l.doc_id, 'toxic' FROM labels l WHERE l.doc_id % 9 = 0"
_COUNTS = f"WITH t AS ({_TRUTH}), p AS ({_GUESS}), c AS (SELECT coalesce(t.label_id, p.label_id) AS label_id, count(*) FILTER (WHERE t.doc_id IS NOT NULL AND p.doc_id IS NOT NULL) AS tp, count(*) FILTER (WHERE t.doc_id IS NULL) AS fp, count(*) FILTER (WHERE p.doc_id IS NULL) AS fn FROM t FULL JOIN p ON t.doc_id = p.doc_id AND t.label_id = p.label_id GROUP BY 1)"


def _sides(spark, d) -> tuple[DataFrame, DataFrame]:
    return v.over(spark, d, _TRUTH), v.over(spark, d, _GUESS)


@query(_COUNTS + " SELECT label_id, tp, fp, fn, round(tp / (tp + fp), 9) AS precision, round(tp / (tp + fn), 9) AS recall, round(2 * tp / (2 * tp + fp + fn), 9) AS f1 FROM c")
def eval_labels(spark, d):
    out = evaluate.label_scores(evaluate.label_counts(*_sides(spark, d)))
    return out.select("label_id", "tp", "fp", "fn", *(F.round(c, 9).alias(c) for c in ("precision", "recall", "f1")))


@query(_COUNTS + " SELECT round(2 * sum(tp) / (2 * sum(tp) + sum(fp) + sum(fn)), 9) AS micro_f1, round(sum(2 * tp / (2 * tp + fp + fn)) / 2, 9) AS macro_f1, round(sum(fp + fn) / ((SELECT count(*) FROM labels) * 2), 9) AS hamming_loss FROM c")
def eval_topics(spark, d):
    n = load(spark, d, "labels").count()
    out = evaluate.topics(*_sides(spark, d), n, 2)
    return out.select(*(F.round(c, 9).alias(c) for c in out.columns))


_PAIRS = CANON + _PRIORITY + f", y AS (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'low' WHEN 1 THEN 'medium' WHEN 2 THEN 'high' ELSE 'urgent' END AS y_true, {o.bucket('raw_score')} AS y_pred FROM p)"
_RANK = "CASE {} WHEN 'low' THEN 0 WHEN 'medium' THEN 1 WHEN 'high' THEN 2 ELSE 3 END"


def _priority_pairs(spark, d) -> DataFrame:
    names = F.array(*map(F.lit, signals.PRIORITIES))
    return _triaged(spark, d).select(F.get(names, (F.col("doc_id") % 4).cast("int")).alias("y_true"), F.col("priority.value").alias("y_pred"))


@query(_PAIRS + f""", r AS (SELECT {_RANK.format('y_true')} AS t, {_RANK.format('y_pred')} AS p FROM y), n AS (SELECT count(*) AS n, sum(abs(t - p)) / 3.0 AS seen, avg(CAST(t = p AS INT)) AS exact_match, avg(CAST(abs(t - p) <= 1 AS INT)) AS off_by_one, avg(CAST(t - p >= 2 AS INT)) AS under_triage_rate, avg(CAST(p - t >= 2 AS INT)) AS over_triage_rate FROM r),
x AS (SELECT sum(abs(a.t - b.p) * a.n * b.n) / 3.0 AS e FROM (SELECT t, count(*) AS n FROM r GROUP BY t) a, (SELECT p, count(*) AS n FROM r GROUP BY p) b)
SELECT round(1 - seen / (e / n), 9) AS kappa, round(exact_match, 9) AS exact_match, round(off_by_one, 9) AS off_by_one, round(under_triage_rate, 9) AS under_triage_rate, round(over_triage_rate, 9) AS over_triage_rate FROM n, x""")
def eval_priority(spark, d):
    out = evaluate.priority(_priority_pairs(spark, d))
    return out.select(*(F.round(c, 9).alias(c) for c in out.columns))


@query(_PAIRS + " SELECT y_true, " + ", ".join(f"count(*) FILTER (WHERE y_pred = '{p}') AS {p}" for p in signals.PRIORITIES) + " FROM y GROUP BY y_true")
def priority_confusion(spark, d):
    return evaluate.confusion_matrix(_priority_pairs(spark, d), signals.PRIORITIES)


_SENTIMENT = "SELECT CASE doc_id % 3 WHEN 0 THEN 'positive' WHEN 1 THEN 'neutral' ELSE 'negative' END AS y_true, CASE WHEN n_chars % 4 = 0 THEN 'negative' WHEN doc_id % 3 = 0 THEN 'positive' ELSE 'neutral' END AS y_pred FROM documents "


@query(f"WITH y AS ({_SENTIMENT}), c AS (SELECT v, 2.0 * sum(tp) / sum(n) AS f1 FROM (SELECT y_true AS v, sum(CAST(y_true = y_pred AS INT)) AS tp, count(*) AS n FROM y GROUP BY y_true UNION ALL SELECT y_pred, 0, count(*) FROM y GROUP BY y_pred) GROUP BY v) SELECT round((SELECT avg(CAST(y_true = y_pred AS INT)) FROM y), 9) AS accuracy, round(avg(f1), 9) AS f1_macro FROM c")
def eval_sentiment(spark, d):
    out = evaluate.single_label(v.over(spark, d, _SENTIMENT), signals.SENTIMENTS)
    return out.select(*(F.round(c, 9).alias(c) for c in out.columns))


@query(CANON + _TOLD + " SELECT value, count(*) AS n, round(avg(CAST(confidence AS DOUBLE)), 9) AS mean_confidence, round(quantile_cont(CAST(confidence AS DOUBLE), 0.5), 9) AS median_confidence, round(quantile_cont(CAST(confidence AS DOUBLE), 0.25), 9) AS confidence_p25, round(quantile_cont(CAST(confidence AS DOUBLE), 0.75), 9) AS confidence_p75, round(count(*) / (SELECT count(*) FROM told), 9) AS share, count(*) FILTER (WHERE doc_id % 5 = 0 AND value = 'new') AS false_new, round(count(*) FILTER (WHERE doc_id % 5 = 0 AND value = 'new') / count(*), 9) AS false_new_rate FROM told GROUP BY value")
def eval_status(spark, d):
    rows = _triaged(spark, d).select("customer_status.*", F.when(F.col("doc_id") % 5 == 0, "existing").otherwise("new").alias("status_true"))
    out = evaluate.customer_status(rows)
    rounded = ("mean_confidence", "median_confidence", "confidence_p25", "confidence_p75", "share", "false_new_rate")
    return out.select("value", "n", "false_new", *(F.round(c, 9).alias(c) for c in rounded))


_HEALTH = """, lx AS (SELECT * FROM promoted), bl AS (SELECT lemma, count(DISTINCT label_id) AS n FROM lx GROUP BY lemma)"""


@query(_PROMOTED + _HEALTH + " SELECT count(*) AS entries, count(*) FILTER (WHERE decision LIKE '%active') AS active_keywords, count(*) FILTER (WHERE decision = 'quarantined') AS quarantined_keywords, quantile_cont(doc_freq, 0.25) AS doc_freq_p25, quantile_cont(doc_freq, 0.5) AS doc_freq_p50, quantile_cont(doc_freq, 0.75) AS doc_freq_p75, (SELECT count(*) FROM bl WHERE n > 1) AS multi_label_keywords, round((SELECT avg(CAST(n > 1 AS INT)) FROM bl), 9) AS collision_rate FROM lx")
def dict_health(spark, d):
    out = evaluate.dictionary_health(_lexicon(spark, d))
    return out.withColumn("collision_rate", F.round("collision_rate", 9))


@query(_PROMOTED + " SELECT count(*) FILTER (WHERE decision = 'rejected') AS rejected, count(*) FILTER (WHERE decision = 'quarantined') AS quarantined, label_id, count(*) FILTER (WHERE decision LIKE '%active') AS active FROM promoted GROUP BY label_id")
def dict_size_by_label(spark, d):
    return _promoted(spark, d).groupBy("label_id").agg(F.count_if(F.col("decision") == "rejected").alias("rejected"), F.count_if(F.col("decision") == "quarantined").alias("quarantined"), F.count_if(F.col("decision").endswith("active")).alias("active"))


@query(_PROMOTED + ", act AS (SELECT * FROM promoted WHERE decision LIKE '%active'), o AS (SELECT * FROM act WHERE length(lemma) % 3 < 2), w AS (SELECT * FROM act WHERE length(lemma) % 3 > 0) SELECT count(*) FILTER (WHERE o.lemma IS NULL) AS added, count(*) FILTER (WHERE w.lemma IS NULL) AS removed, round(count(*) FILTER (WHERE o.lemma IS NULL OR w.lemma IS NULL) / count(w.lemma), 9) AS churn_rate FROM o FULL JOIN w ON o.label_id = w.label_id AND o.lemma = w.lemma AND o.decision = w.decision")
def dict_churn(spark, d):
    active = _lexicon(spark, d).filter("status = 'active'")
    out = evaluate.churn(active.filter("length(lemma) % 3 < 2"), active.filter("length(lemma) % 3 > 0"))
    return out.withColumn("churn_rate", F.round("churn_rate", 9))


_CHI = _OBS + ", c AS (SELECT label_id, count(*) FILTER (WHERE observed_at >= TIMESTAMP '2024-01-16 00:00:00') AS a, count(*) FILTER (WHERE observed_at < TIMESTAMP '2024-01-16 00:00:00') AS b FROM obs GROUP BY label_id), s AS (SELECT sum(a) AS ta, sum(b) AS tb FROM c), e AS (SELECT a, b, (a + b) * ta / (ta + tb) AS ea, (a + b) * tb / (ta + tb) AS eb FROM c, s)"


# What a chi-square variable of 1 to 10 degrees of freedom exceeds with a chance of a twentieth.
_CRITICAL = (3.841459, 5.991465, 7.814728, 9.487729, 11.070498, 12.591587, 14.06714, 15.507313, 16.918978, 18.307038)


@query(_CHI + f", r AS (SELECT round(coalesce(sum((a - ea) * (a - ea) / nullif(ea, 0) + (b - eb) * (b - eb) / nullif(eb, 0)), 0), 6) AS chi2, count(*) - 1 AS dof FROM e) SELECT chi2, dof, chi2 > CASE dof {' '.join(f'WHEN {k + 1} THEN {x}' for k, x in enumerate(_CRITICAL))} END AS drift_detected FROM r")
def drift_chi2(spark, d):
    obs = _observations(spark, d)
    late = F.col("observed_at") >= F.lit("2024-01-16 00:00:00").cast("timestamp_ntz")
    return evaluate.chi_square(obs.filter(late), obs.filter(~late)).select(F.round("chi2", 6).alias("chi2"), "dof", "drift_detected")


_LEXICONS = ", act AS (SELECT * FROM promoted WHERE decision LIKE '%active'), o AS (SELECT * FROM act WHERE length(lemma) % 3 < 2), w AS (SELECT * FROM act WHERE length(lemma) % 3 > 0), ch AS (SELECT count(*) FILTER (WHERE o.lemma IS NULL OR w.lemma IS NULL) / count(w.lemma) AS c FROM o FULL JOIN w ON o.label_id = w.label_id AND o.lemma = w.lemma AND o.decision = w.decision)"


@query(_PROMOTED + _HEALTH + _LEXICONS + f""", outputs AS ({v.OUTPUTS}), m AS (SELECT avg(CASE WHEN json_valid(json) THEN 0.0 ELSE 1.0 END) AS e FROM outputs), r AS (
  SELECT 'collision_rate' AS metric, avg(CAST(n > 1 AS INT)) AS value, 0.15 AS most, 'ambiguous' AS alert FROM bl UNION ALL SELECT 'churn_rate', c, 0.3, 'unstable' FROM ch
  UNION ALL SELECT 'promotion_rate', avg(CAST(decision LIKE '%active' AS INT)), 0.5, 'too_lax' FROM promoted UNION ALL SELECT 'validation_error_rate', e, 0.05, 'invalid_output' FROM m
  UNION ALL SELECT 'unknown_topic_rate', avg(CAST({v.label_of('doc_id')} = 'UNKNOWN_TOPIC' AS INT)), 0.2, 'unknown_topics' FROM outputs UNION ALL SELECT 'under_triage_rate', avg(CAST(doc_id % 4 = 3 AS INT)), 0.1, 'under_triage' FROM outputs)
SELECT metric, round(value, 9) AS value, alert FROM r WHERE value > most UNION ALL SELECT metric, round(value, 9), 'too_strict' FROM r WHERE metric = 'promotion_rate' AND value < 0.02""")
def alerts(spark, d):
    lexicon = _lexicon(spark, d)
    active = lexicon.filter("status = 'active'")
    rate = lexicon.agg(F.avg((F.col("status") == "active").cast("double")).alias("promotion_rate"))
    broken = F.get_json_object("json", "$.dictionary_version").isNull()
    model = _outputs(spark, d).agg(
        F.avg(broken.cast("double")).alias("validation_error_rate"), F.avg((F.expr(v.label_of("doc_id")) == "UNKNOWN_TOPIC").cast("double")).alias("unknown_topic_rate"), F.avg((F.col("doc_id") % 4 == 3).cast("double")).alias("under_triage_rate"),
    )
    health = evaluate.dictionary_health(lexicon).join(rate).join(evaluate.churn(active.filter("length(lemma) % 3 < 2"), active.filter("length(lemma) % 3 > 0"))).join(model)
    return evaluate.alerts(health).withColumn("value", F.round("value", 9))


@query(_PROMOTED + " SELECT DISTINCT label_id, lemma, doc_freq FROM promoted WHERE decision = 'quarantined' AND doc_freq > 10")
def quarantine_queue(spark, d):
    return evaluate.quarantine_queue(_lexicon(spark, d)).select("label_id", "lemma", "doc_freq")


_RUN_A, _RUN_B = (f"SELECT doc_id, {v.label_of('doc_id')} AS l1, {v.label_of(f'doc_id + CASE WHEN doc_id % 7 = 0 THEN {i} ELSE 2 END')} AS l2 FROM documents " for i in (2, 4))


@query(f"WITH a AS ({_RUN_A}), b AS ({_RUN_B}) SELECT count(*) AS documents, round(avg(CAST(a.l1 = b.l1 AND a.l2 = b.l2 AS INT)), 9) AS topic_agreement FROM a JOIN b ON a.doc_id = b.doc_id")
def backtest_agreement(spark, d):
    a, b = (v.over(spark, d, s) for s in (_RUN_A, _RUN_B))
    out = evaluate.agreement(a.select("doc_id", F.array("l1", "l2")), b.select("doc_id", F.array("l2", "l1")))
    return out.withColumn("topic_agreement", F.round("topic_agreement", 9))


@query(_PARSED + " SELECT doc_id, label_id, CASE WHEN confidence < 0.3 THEN 'low_confidence' ELSE 'confident_unknown' END AS reason FROM good_t WHERE confidence < 0.3 OR (label_id = 'UNKNOWN_TOPIC' AND confidence > 0.6)")
def review_queue(spark, d):
    topics = classify.exploded_keywords(_validated(spark, d)).select("doc_id", "topic", "label_id", "confidence").distinct()
    return evaluate.review_queue(topics)
