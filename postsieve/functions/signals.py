"""Rule-based signals: customer status, deadlines, priority."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postsieve.settings import DEFAULT, Settings

# Signal patterns and term lists.
EXISTING_CUSTOMER = (
    r"\b(ho già|già|abbiamo già)\b.*\b(contratto|account|servizio|abbonamento)\b",
    r"\b(cliente|abbonato)\b.*\b(dal|da|esistente)\b",
    r"\bvostro cliente\b",
    r"\bmio.*\b(contratto|account|codice cliente)\b",
    r"\bnumero cliente\b",
    r"\bcodice fiscale.*\bregistrato\b",
    r"\b(ho|abbiamo)\b.*\b(servizio|abbonamento|contratto)\b.*\battivo\b",
)
NEW_CUSTOMER = (
    r"\bprimo contatto\b",
    r"\bvorrei diventare cliente\b",
    r"\bprima volta\b.*\b(scrivo|contatto)\b",
    r"\bnon sono ancora cliente\b",
    r"\bnuovo cliente\b",
    r"\binteressato ai vostri servizi\b",
    r"\bmaggiori informazioni\b",
    r"\bvorrei aprire\b.*\b(account|contratto)\b",
    r"\bpotenziale cliente\b",
)
URGENT_TERMS = (
    "urgente", "urgenza", "immediato", "immediatamente", "bloccante", "bloccato", "fermo", "disdetta", "disdire", "rimborso",
    "reclamo", "critico", "grave", "sla", "scaduto", "avvocato", "legale", "diffida", "danni",
)
HIGH_TERMS = (
    "problema", "errore", "guasto", "non funziona", "funzionante", "assistenza", "supporto", "aiuto", "necessario", "necessaria",
    "importante", "urgenza",
)
IMMEDIATE = (
    r"\bentro oggi\b",
    r"\bentro domani\b",
    r"\bentro stasera\b",
    r"\bal più presto\b",
)
NEAR_TERM = (
    r"\bentro\s+\d{1,2}\s+giorni\b",
    r"\bentro.*questa settimana\b",
    r"\bscadenza\s*:\s*\d{4}-\d{2}-\d{2}\b",
    r"\bentro il\s+\d{1,2}[/\-]\d{1,2}\b",
)
GENERIC = (
    r"\bscadenza\b",
    r"\btermine\b.*\b(ultimo|finale)\b",
    r"\btempo\b.*\b(limitato|scaduto)\b",
)
SENTIMENTS = ("positive", "neutral", "negative")
PRIORITIES = ("low", "medium", "high", "urgent")
STATUSES = ("new", "existing", "unknown")

FLAGS = "(?iudU)"  # any case, all letters, "." stops at line feeds only


def _total(flags: list[Column]) -> Column:
    return sum((f.cast("int") for f in flags), F.lit(0))


def matches(text: Column, patterns: tuple[str, ...]) -> list[Column]:
    return [text.rlike(FLAGS + p) for p in patterns]


def text_signal(text: Column) -> Column:
    """``existing`` or ``new``, whichever has more matching patterns; null on a tie."""
    old, new = _total(matches(text, EXISTING_CUSTOMER)), _total(matches(text, NEW_CUSTOMER))
    return F.when(old > new, F.lit("existing")).when(new > old, F.lit("new"))


def address(sender: Column) -> Column:
    """The bare address of ``Name <a@b>``, lower case; null if blank."""
    bare = F.lower(F.trim(F.coalesce(F.nullif(F.regexp_extract(sender, r"<([^<>]*)>\s*$", 1), F.lit("")), sender)))
    return F.nullif(bare, F.lit(""))


def domain(sender: Column) -> Column:
    """What follows the first ``@``."""
    return F.get(F.split(address(sender), "@"), F.lit(1))


def customer_status(df: DataFrame, exact: Column, by_domain: Column, text: Column, enabled: bool = True) -> DataFrame:
    """Adds customer_status, struct<value, confidence, source>: known address, known domain, text signal, else new.

    Signals stand in a column of their own, so that each pattern runs once a row.
    """
    def told(value: str, confidence: float, source: str) -> Column:
        return F.struct(F.lit(value).alias("value"), F.lit(confidence).alias("confidence"), F.lit(source).alias("source"))

    if not enabled:
        return df.withColumn("customer_status", told("unknown", 0.5, "crm_disabled"))
    counted = df.withColumns({"__old": _total(matches(text, EXISTING_CUSTOMER)), "__new": _total(matches(text, NEW_CUSTOMER))})
    old, new = F.col("__old"), F.col("__new")
    status = (
        F.when(exact, told("existing", 1.0, "crm_exact_match")).when(by_domain, told("existing", 0.7, "crm_domain_match"))
        .when(old > new, told("existing", 0.5, "text_signal")).when(new > old, told("new", 0.6, "text_signal"))
        .otherwise(told("new", 0.8, "no_crm_no_signal"))
    )
    return counted.withColumn("customer_status", status).drop("__old", "__new")


def deadline_boost(text: Column) -> Column:
    """3 for today or tomorrow, 2 within days, 1 for any other mention, 0 for none."""
    any_of = lambda p: _total(matches(text, p)) > 0
    return F.when(any_of(IMMEDIATE), 3).when(any_of(NEAR_TERM), 2).when(any_of(GENERIC), 1).otherwise(0)


def deadline_patterns(text: Column) -> Column:
    """The patterns that matched; of the generic ones the first alone, and only if no other did."""
    strong = F.filter(F.array(*(F.when(m, F.lit(f"(?i){p}")) for m, p in zip(matches(text, IMMEDIATE + NEAR_TERM), IMMEDIATE + NEAR_TERM, strict=True))), lambda x: x.isNotNull())
    weak = F.slice(F.filter(F.array(*(F.when(m, F.lit(f"(?i){p}")) for m, p in zip(matches(text, GENERIC), GENERIC, strict=True))), lambda x: x.isNotNull()), 1, 1)
    return F.when(F.size(strong) > 0, strong).otherwise(weak)


def priority(df: DataFrame, subject: Column, body: Column, sentiment: Column, status: Column, vip: Column, s: Settings = DEFAULT) -> DataFrame:
    """Adds priority, struct<value, confidence, raw_score, signals>, from terms (each once, as substrings), sentiment, status, deadline and VIP flag.

    Each step is a column of its own, so that no term is looked for twice.
    """
    out = df.withColumn("__text", F.lower(F.concat_ws(" ", F.coalesce(subject, F.lit("")), F.coalesce(body, F.lit("")))))
    count = lambda terms: _total([F.contains("__text", F.lit(t)) for t in terms])
    out = out.withColumns({
        "__urgent": count(URGENT_TERMS), "__high": count(HIGH_TERMS), "__boost": deadline_boost(F.col("__text")),
        "__negative": F.coalesce(sentiment == "negative", F.lit(False)), "__new": F.coalesce(status == "new", F.lit(False)), "__vip": F.coalesce(vip, F.lit(False)),
    })
    weights = (("__urgent", s.urgent_weight), ("__high", s.high_weight), ("__negative", s.negative_weight), ("__new", s.new_customer_weight), ("__boost", s.deadline_weight), ("__vip", s.vip_weight))
    out = out.withColumn("__score", sum((F.col(c).cast("int") * w for c, w in weights), F.lit(0.0)))
    score = F.col("__score")
    signals = F.filter(
        F.array(
            F.when(F.col("__urgent") > 0, F.concat(F.lit("urgent_keywords:"), F.col("__urgent").cast("string"))), F.when(F.col("__high") > 0, F.concat(F.lit("high_keywords:"), F.col("__high").cast("string"))),
            F.when(F.col("__negative"), F.lit("negative_sentiment")), F.when(F.col("__new"), F.lit("new_customer")), F.when(F.col("__boost") > 0, F.lit("deadline_mentioned")), F.when(F.col("__vip"), F.lit("vip_customer")),
        ),
        lambda x: x.isNotNull(),
    )
    value = F.when(score >= s.urgent_from, "urgent").when(score >= s.high_from, "high").when(score >= s.medium_from, "medium").otherwise("low")
    sure = F.when(score >= s.urgent_from, 0.95).when(score >= s.high_from, 0.85).when(score >= s.medium_from, 0.75).otherwise(0.7)
    told = F.struct(value.alias("value"), sure.alias("confidence"), score.alias("raw_score"), signals.alias("signals"))
    return out.withColumn("priority", told).drop("__text", "__score", *(c for c, _ in weights))
