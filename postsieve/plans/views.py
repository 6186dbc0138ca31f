"""Mails, model outputs and observations derived from the given tables, in SQL that Spark and DuckDB read alike."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession

from postsieve.sources.tables import load

#: One mail per document; the sender is one of the first hundred customers.
EMAILS = """
SELECT d.doc_id,
  CASE WHEN d.doc_id % 10 = 0 THEN 'Mario.Rossi@example.com'
       WHEN d.doc_id % 10 = 1 THEN 'utente' || CAST(d.doc_id % 7 AS STRING) || '@cliente.it'
       WHEN d.doc_id % 10 = 2 THEN ''
       ELSE lower(replace(coalesce(c.c_name, 'ignoto'), '#', '.')) || '@' || lower(coalesce(c.c_mktsegment, 'posta')) || '.example.org' END AS from_address,
  CASE WHEN d.doc_id % 5 = 0 THEN 'URGENTE: problema con la fattura numero ' || CAST(d.doc_id AS STRING)
       WHEN d.doc_id % 5 = 1 THEN 'Re: richiesta di assistenza'
       WHEN d.doc_id % 5 = 2 THEN ''
       ELSE substring(coalesce(d.text, ''), 1, 40) END AS subject,
  'Buongiorno,' || chr(13) || chr(10) || chr(13) || chr(10) || coalesce(d.text, '') || chr(10)
  || CASE WHEN d.doc_id % 3 = 0 THEN '    sono un vostro   cliente, il numero cliente resta; entro 3 giorni serve   il rimborso.  ' || chr(10) ELSE '' END
  || CASE WHEN d.doc_id % 4 = 1 THEN 'Scrivere a anna.neri@business.com o a info+prova@posta.example.org, tel 3331234567 oppure 02 12345678.' || chr(10)
          WHEN d.doc_id % 4 = 2 THEN 'On Monday Anna wrote:' || chr(10) || '> vorrei maggiori informazioni' || chr(10) || chr(10) || '> grazie mille' || chr(10) || 'il testo continua qui' || chr(10)
            || '--- Messaggio originale ---' || chr(10) || 'ultima riga' || chr(10)
          ELSE '' END
  || CASE WHEN d.doc_id % 7 = 5 THEN 'Sono interessato ai vostri servizi, primo contatto. Scadenza: 2024-03-01' || chr(10) ELSE '' END
  || CASE WHEN d.doc_id % 6 = 1 THEN chr(10) || '  Cordiali saluti,' || chr(10) || 'Anna Neri' || chr(10) || 'Ufficio acquisti' || chr(10) ELSE '' END
  || CASE WHEN d.doc_id % 7 = 3 THEN chr(10) || '____________' || chr(10) || 'Questo messaggio resta riservato.' || chr(10) ELSE '' END AS body
FROM documents d LEFT JOIN customer c ON c.c_custkey = d.doc_id % 100
"""

#: Words that each mail offers as candidates, and under which topic a model would put them.
OFFERED = """
SELECT d.doc_id, w.i, w.lemma, w.lemma AS term, substring(sha1('body|' || w.lemma), 1, 12) AS candidate_id,
  CAST((d.doc_id * 7 + w.i * 13) % 100 AS DOUBLE) / 100 AS embedding_score,
  CAST((d.doc_id * 11 + w.i * 29) % 100 AS DOUBLE) / 100 AS composite_score,
  1 + (d.doc_id + w.i) % 4 AS n
FROM documents d CROSS JOIN (
  SELECT 0 AS i, 'fattura' AS lemma UNION ALL SELECT 1, 'problema' UNION ALL SELECT 2, 'contratto' UNION ALL SELECT 3, 'garanzia'
  UNION ALL SELECT 4, 'spedizione' UNION ALL SELECT 5, 'rimborso') w
"""

_LABEL = """CASE ({}) % 10 WHEN 0 THEN 'FATTURAZIONE' WHEN 1 THEN 'ASSISTENZA_TECNICA' WHEN 2 THEN 'RECLAMO' WHEN 3 THEN 'INFO_COMMERCIALI' WHEN 4 THEN 'DOCUMENTI'
  WHEN 5 THEN 'APPUNTAMENTO' WHEN 6 THEN 'CONTRATTO' WHEN 7 THEN 'GARANZIA' WHEN 8 THEN 'SPEDIZIONE' ELSE 'UNKNOWN_TOPIC' END"""


def label_of(expression: str) -> str:
    return _LABEL.format(expression)


def _keyword(lemma: str, cid: str | None = None) -> str:
    found = f"substring(sha1('body|{lemma}'), 1, 12)" if cid is None else f"'{cid}'"
    return f"""'{{"candidate_id":"' || {found} || '","lemma":"{lemma}","count":' || CAST(1 + d.doc_id % 3 AS STRING) || '}}'"""


def _topic(label: str, confidence: str, keywords: str, evidence: str = """'{"quote":"come da testo"}'""") -> str:
    return f"""'{{"label_id":"' || {label} || '","confidence":' || {confidence} || ',"keywords_in_text":[' || {keywords} || '],"evidence":[' || {evidence} || ']}}'"""


_SURE = "CAST(CAST(20 + (d.doc_id * 17) % 80 AS DOUBLE) / 100 AS STRING)"
_A, _B = label_of("d.doc_id"), label_of("d.doc_id + 3")
_GOOD = f"""{_topic(_A, _SURE, _keyword('fattura') + " || ',' || " + _keyword('problema'))} || ',' || {_topic(_B, "'0.5'", _keyword('fattura'), "'{\"quote\":\"uno\"},{\"quote\":\"due\"}'")}"""
_SIX = " || ',' || ".join(_topic(label_of(f"d.doc_id + {i}"), "'0.4'", _keyword("contratto")) for i in range(6))

#: A model's output for each document, with a fault by its id: broken JSON, a missing field, an unknown candidate, an
#: unknown label, a topic twice, a keyword twice, six topics, low confidence, a wrong type, an unknown value, a missing source.
OUTPUTS = f"""
SELECT d.doc_id, CASE WHEN d.doc_id % 12 = 0 THEN '{{"dictionary_version":1,"topics":[' ELSE
  '{{"dictionary_version":1,"topics":[' || CASE d.doc_id % 12
    WHEN 2 THEN {_topic(_A, _SURE, _keyword('inventato', 'ffffffffffff'))}
    WHEN 3 THEN {_topic("'ALTRO'", _SURE, _keyword('fattura'))}
    WHEN 4 THEN {_GOOD} || ',' || {_topic(_A, "'0.9'", _keyword('garanzia'))}
    WHEN 5 THEN {_topic(_A, _SURE, _keyword('fattura') + " || ',' || " + _keyword('fattura') + " || ',' || " + _keyword('rimborso'))}
    WHEN 6 THEN {_SIX}
    WHEN 7 THEN {_topic(_A, "'0.1'", _keyword('spedizione'))}
    WHEN 8 THEN {_topic(_A, "'\"alta\"'", _keyword('fattura'))}
    ELSE {_GOOD} END || ']'
  || CASE WHEN d.doc_id % 12 = 1 THEN '' ELSE ',"sentiment":{{"value":"' || CASE WHEN d.doc_id % 12 = 9 THEN 'angry' WHEN d.doc_id % 4 = 2 THEN 'negative' WHEN d.doc_id % 4 = 3 THEN 'positive' ELSE 'neutral' END || '","confidence":0.8}}' END
  || ',"priority":{{"value":"' || CASE d.doc_id % 4 WHEN 0 THEN 'low' WHEN 1 THEN 'medium' WHEN 2 THEN 'high' ELSE 'urgent' END || '","confidence":0.6,"signals":[]}}'
  || ',"customer_status":{{"value":"new","confidence":0.5' || CASE WHEN d.doc_id % 12 = 10 THEN '' ELSE ',"source":"text_signal"' END || '}}}}' END AS json
FROM documents d
"""

#: Keyword observations from ``words`` (doc_id, term, count: the single words that each whole mail offers as candidates): lemmas are six-letter stems, labels go by length
#: and document, and the time is that of an event, or of the first one where a document has none.
OBSERVED = f"""
SELECT w.doc_id AS message_id, {label_of("length(w.term) + CASE WHEN w.doc_id % 19 = 0 THEN 3 ELSE 0 END")} AS label_id, substring(w.term, 1, 6) AS lemma, w.term, w.count,
  CAST((length(w.term) * 13 + w.count * 7) % 64 AS DOUBLE) / 64 AS embedding_score, coalesce(e.ts, (SELECT min(ts) FROM events )) AS observed_at
FROM words w LEFT JOIN events e ON e.event_id = w.doc_id * 9 + 3
"""

TABLES = ("documents", "customer", "conversations", "pages", "events", "labels")


def over(spark: SparkSession, sf_dir: str, sql: str, tables: tuple[str, ...] = TABLES, **given: DataFrame) -> DataFrame:
    """A query over the folder's tables and ``given`` ones, under view names of the folder's own, so that calls on other folders don't collide."""
    mark = hashlib.md5(sf_dir.encode()).hexdigest()[:10]
    for t, rows in given.items():
        rows.createOrReplaceTempView(f"postsieve_{mark}_{t}")
        sql = sql.replace(f"FROM {t} ", f"FROM postsieve_{mark}_{t} ").replace(f"JOIN {t} ", f"JOIN postsieve_{mark}_{t} ")
    for t in tables:
        if f"FROM {t} " in sql or f"JOIN {t} " in sql:
            load(spark, sf_dir, t).createOrReplaceTempView(f"postsieve_{mark}_{t}")
            sql = sql.replace(f"FROM {t} ", f"FROM postsieve_{mark}_{t} ").replace(f"JOIN {t} ", f"JOIN postsieve_{mark}_{t} ")
    return spark.sql(sql)
