"""Settings with their defaults; a frozen value that every operator takes as an argument."""

from __future__ import annotations

import re
from collections.abc import Mapping
from dataclasses import dataclass, fields, replace


@dataclass(frozen=True)
class Settings:
    max_email_bytes: int = 25 * 1024 * 1024
    max_attachments: int = 50
    pii_level: str = "standard"
    pii_salt: str = ""
    min_term_length: int = 3
    max_ngram: int = 3
    weight_count: float = 0.3
    weight_embedding: float = 0.5
    weight_subject: float = 0.2
    prompt_candidates: int = 100
    prompt_body: int = 8000
    # Known senders.
    known_domains: tuple[str, ...] = ("company.com", "cliente.it")
    known_emails: tuple[str, ...] = ("mario.rossi@example.com", "giulia.bianchi@company.it", "paolo.verdi@cliente.it", "anna.neri@business.com", "francesco.bruno@test.it")
    crm_enabled: bool = True
    urgent_weight: float = 3.0
    high_weight: float = 1.5
    negative_weight: float = 2.0
    new_customer_weight: float = 1.0
    deadline_weight: float = 2.0
    vip_weight: float = 2.5
    urgent_from: float = 7.0
    high_from: float = 4.0
    medium_from: float = 2.0
    confidence_llm: float = 0.3
    confidence_keywords: float = 0.4
    confidence_evidence: float = 0.2
    confidence_collision: float = 0.1
    topic_threshold: float = 0.3
    regex_min_docs: int = 3
    regex_min_score: float = 0.35
    ner_min_docs: int = 2
    ner_min_score: float = 0.25
    max_labels: int = 2
    min_total: int = 5


DEFAULT = Settings()


def configured(given: Mapping[str, str], base: Settings = DEFAULT) -> Settings:
    """Settings with the given values, by name in any case (``POSTSIEVE_MAX_NGRAM``, ``postsieve.max_ngram``, ``max_ngram``); others are ignored.

    Texts become the type that the setting has; lists are separated by commas. ``os.environ`` and a session's configuration will do.
    """
    found = {}
    for name, text in given.items():
        key = re.sub(r"^postsieve[._]", "", name.lower())
        if key in (known := {f.name: getattr(base, f.name) for f in fields(base)}):
            kind = type(known[key])
            if kind is bool:
                found[key] = text.strip().lower() in ("1", "true", "yes", "on")
            elif kind is tuple:
                found[key] = tuple(x.strip() for x in text.split(",") if x.strip())
            else:
                found[key] = kind(text)
    return replace(base, **found)

#: One registry of the versions that a result depends on.
VERSIONS = {
    "dictionary_version": 1, "model_version": "offline-rules-1.0.0", "parser_version": "parser-1.0.0", "stoplist_version": "stop-it-1.0.0",
    "ner_model_version": "none", "schema_version": "schema-1.0.0", "tool_calling_version": "tool-1.0.0",
    "canonicalization_version": "canon-1.2.0", "pii_redaction_version": "pii-redact-1.0.0", "pii_redaction_level": "standard",
}
