"""Pieces of DuckDB SQL that say what the Column expressions do."""

from __future__ import annotations

from postsieve.functions.signals import EXISTING_CUSTOMER, GENERIC, HIGH_TERMS, IMMEDIATE, NEAR_TERM, NEW_CUSTOMER, URGENT_TERMS
from postsieve.functions.terms import BLACKLIST, STOP_WORDS


def quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"


def whitespace(x: str) -> str:
    t = f"regexp_replace({x}, '\\r\\n?', chr(10), 'g')"
    t = f"regexp_replace({t}, '[ \\t\\f\\v]+(\\n|$)', '\\1', 'g')"
    t = f"regexp_replace({t}, '([^ \\t\\n])[ \\t]+', '\\1 ', 'g')"
    return f"regexp_replace({t}, '\\n{{3,}}', chr(10) || chr(10), 'g')"


def disclaimer(x: str) -> str:
    return f"regexp_replace({x}, '(?s)\\n_{{10,}}.*$', '')"


def signature(x: str) -> str:
    starts = "--+[ \\t]*(\\n.*)?|___+[ \\t]*(\\n.*)?|(Cordiali saluti|Distinti saluti|Saluti|Best regards|Regards|Grazie).*|Sent from my (iPhone|iPad|Android|Samsung|Huawei).*|Inviato da.*"
    return f"regexp_replace({x}, '(?is)(^|\\n)[ \\t]*({starts})$', '')"


QUOTED = "'(?i)^(>|\\|+\\s|On .+ wrote:|Il .+ ha scritto:|-+\\s*Original Message\\s*-+|-+\\s*Messaggio originale\\s*-+)'"


def replies(x: str) -> str:
    return f"array_to_string(list_filter(string_split({x}, chr(10)), lambda l: NOT regexp_matches({strip('l')}, {QUOTED})), chr(10))"


def unsigned(x: str) -> str:
    return signature(disclaimer(whitespace(x)))


def canonical(x: str) -> str:
    return strip(f"lower({replies(unsigned(x))})")


EMAIL = r"'\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b'"
PHONE = r"'\b(\+39\s?)?((0\d{1,4}[\s\-]?\d{4,8})|([3]\d{2}[\s\-]?\d{6,7}))\b'"


def redacted(x: str, pattern: str, kind: str) -> str:
    gaps = f"regexp_split_to_array({x}, {pattern})"
    return f"CASE WHEN regexp_matches({x}, {pattern}) THEN array_to_string(list_transform({gaps}, lambda g, i: CASE WHEN i = 1 THEN g ELSE '[{kind}_' || CAST(i - 1 AS VARCHAR) || ']' || g END), '') ELSE {x} END"


def spans(table: str, x: str, pattern: str) -> str:
    """doc_id, i (from 1), start, "end", hit of all matches."""
    return f"""
    SELECT doc_id, i, CAST(list_sum(list_transform(gaps[1:i], lambda g: length(g))) + coalesce(list_sum(list_transform(hits[1:i - 1], lambda h: length(h))), 0) AS BIGINT) AS s, hits[i] AS hit
    FROM (SELECT doc_id, regexp_split_to_array({x}, {pattern}) AS gaps, regexp_extract_all({x}, {pattern}) AS hits FROM {table}) q, unnest(range(1, len(hits) + 1)) AS u(i)
    """


TOKEN = "'[a-zàèéìòù]+(?:''[a-zàèéìòù]+)?|\\d+'"


def tokens(x: str) -> str:
    return f"regexp_extract_all(lower({x}), {TOKEN})"


def ngrams(t: str, n: int) -> str:
    return f"list_transform(range(1, len({t}) - {n} + 2), lambda i: array_to_string({t}[i:i + {n - 1}], ' '))"


def emails_cte(emails: str) -> str:
    """emails, and canon(doc_id, from_address, subject, body) with the canonical body."""
    return f"emails AS ({emails}), canon AS (SELECT doc_id, from_address, subject, {canonical('body')} AS body FROM emails)"


def raw_candidates(table: str, sizes: tuple[int, ...] = (1, 2, 3)) -> str:
    parts = " UNION ALL ".join(
        f"SELECT doc_id, '{source}' AS source, {n} AS n, unnest({ngrams('t', n)}) AS term FROM (SELECT doc_id, {tokens(source)} AS t FROM {table})" for source in ("subject", "body") for n in sizes
    )
    return f"SELECT doc_id, source, term, CAST(count(*) AS INT) AS count, min(n) AS ngram_size, substring(sha1(source || '|' || term), 1, 12) AS candidate_id FROM ({parts}) WHERE length(term) >= 3 GROUP BY ALL".replace("GROUP BY ALL", "GROUP BY doc_id, source, term")


def kept(term: str = "term") -> str:
    words = ", ".join(quoted(w) for w in STOP_WORDS)
    bad = "|".join(f"(?:{p})" for p in BLACKLIST)
    return f"{term} NOT IN ({words}) AND NOT regexp_matches({term}, '(?i){bad}')"


SCORE = "0.3 * ln(1 + count) / 5.0 + CASE WHEN source = 'subject' THEN 0.2 ELSE 0 END"


def hits(x: str, patterns: tuple[str, ...]) -> str:
    return "(" + " + ".join(f"CAST(regexp_matches({x}, {quoted('(?i)' + p)}) AS INT)" for p in patterns) + ")"


def text_signal(x: str) -> str:
    old, new = hits(x, EXISTING_CUSTOMER), hits(x, NEW_CUSTOMER)
    return f"CASE WHEN {old} > {new} THEN 'existing' WHEN {new} > {old} THEN 'new' END"


def boost(x: str) -> str:
    return f"CASE WHEN {hits(x, IMMEDIATE)} > 0 THEN 3 WHEN {hits(x, NEAR_TERM)} > 0 THEN 2 WHEN {hits(x, GENERIC)} > 0 THEN 1 ELSE 0 END"


def contained(x: str, terms: tuple[str, ...]) -> str:
    return "(" + " + ".join(f"CAST(contains({x}, {quoted(t)}) AS INT)" for t in terms) + ")"


def priority_score(text: str, negative: str, new: str) -> str:
    return f"({contained(text, URGENT_TERMS)} * 3.0 + {contained(text, HIGH_TERMS)} * 1.5 + CASE WHEN {negative} THEN 2.0 ELSE 0 END + CASE WHEN {new} THEN 1.0 ELSE 0 END + 2.0 * {boost(text)})"


def bucket(score: str) -> str:
    return f"CASE WHEN {score} >= 7 THEN 'urgent' WHEN {score} >= 4 THEN 'high' WHEN {score} >= 2 THEN 'medium' ELSE 'low' END"
