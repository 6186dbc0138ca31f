"""Secret scans with multipart credential linking; DataFrame functions only.

Strong kinds (reported wherever they stand):

* ``assign``: a keyword, an assignment sign and a value of six characters or more;
* ``access``: an access identifier ``AKIA...`` of 20 characters or more;
* ``hex``: a run of 24 or more lower-case hexadecimal digits.

Weak kinds are ordinary-looking strings by themselves:

* ``wkey``: 40 characters of the base-64 alphabet, standing alone, with a digit, an upper- and a lower-case letter
  (assignment signs, quotes, full stops and the like may stand next to them; ``-`` and ``_`` only if they don't join them to more);
* ``endp``: the address of a service: ``http(s)://host...``, or ``host:port`` with a name of DNS lengths, an IPv4 or a bracketed IPv6 address and a
  port of two to five digits.

A weak span is reported only if a complementary part stands within ``scope`` characters: a
``wkey`` near an ``access`` span or an ``endp``, an ``endp`` near an ``access`` span or a ``wkey``. The link is an interval join, run as a sweep in position order over
the parts of one text: each part sees the end of the last complementary part before it and the
start of the first after it, so that no pairs are made however many parts a text holds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import id_text, written

#: The patterns and least lengths of the strong kinds. A run of capitals, or of
#: hexadecimal digits, that is too short holds no longer match, so the least length may stand in the pattern;
#: a short ``assign`` match does use up its characters, so its length is tested afterwards.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
ASSIGN_LEAST = 6
#: Patterns of the weak kinds.
WKEY = r"(?<![A-Za-z0-9+/]|[A-Za-z0-9+/][_-])[A-Za-z0-9+/]{40}(?![A-Za-z0-9+/]|[_-]+[A-Za-z0-9+/])"
_NAME = r"(?:[A-Za-z0-9_-]{1,63}\.){0,126}[A-Za-z][A-Za-z0-9_-]{0,62}"
ENDP = (
    r"https?://[A-Za-z0-9.-]+(?::[0-9]{2,5})?(?:/[A-Za-z0-9._~/-]*)?"
    rf"|(?<![A-Za-z0-9_.-])(?:{_NAME}|[0-9]{{1,3}}(?:\.[0-9]{{1,3}}){{3}}|\[[0-9A-Fa-f:.]{{2,45}}\]):[0-9]{{2,5}}(?!:?[A-Za-z0-9_@])"
)
#: Holds in every text that ENDP matches in.
ENDP_GATE = r"https?://|[A-Za-z0-9_\]-]:[0-9]{2}"

SCOPE = 200
KINDS = ("assign", "access", "hex", "wkey", "endp")
#: Numbers that are added up one after the other.
BLOCK = 64
SPANS = "array<struct<start:int,rank:int,end:int>>"


def _let(value: Column, use) -> Column:
    """``use`` of a value that is worked out once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _running(values: Column, levels: int = 2) -> Column:
    """Running sums of an array of numbers: within blocks of ``BLOCK``, whose own sums are added up likewise. Time and space grow with the array."""
    if not levels:
        none = F.array().cast("array<int>")
        return F.aggregate(values, none, lambda a, x: F.concat(a, F.array(F.coalesce(F.try_element_at(a, F.lit(-1)), F.lit(0)) + x)))

    def summed(v: Column) -> Column:
        firsts = F.when(F.size(v) > 0, F.sequence(F.lit(0), F.size(v) - 1, F.lit(BLOCK))).otherwise(F.array().cast("array<int>"))
        # By place, as slice() copies the whole array each time.
        block = lambda at: F.transform(F.sequence(at, F.least(at + (BLOCK - 1), F.size(v) - 1)), lambda i: F.get(v, i))
        return _let(F.transform(firsts, lambda at: _running(block(at), 0)), joined)

    def joined(rows: Column) -> Column:
        tops = _running(F.transform(rows, lambda r: F.element_at(r, -1)), levels - 1)
        return _let(tops, lambda t: F.flatten(F.transform(rows, lambda r, i: F.transform(r, lambda x: x + F.coalesce(F.get(t, i - 1), F.lit(0))))))

    return _let(values, summed)


def _spans(kind: str, pattern: str, gate: str, kept=None) -> Column:
    """Sorted spans of all matches in ``t``, in code points: lengths of what lies between matches and of the matches, added up."""
    found = F.regexp_extract_all("t", F.lit(pattern), F.lit(0))
    keep = F.transform(found, lambda x: F.lit(True)) if kept is None else kept(found)
    steps = F.arrays_zip(F.transform(F.split("t", pattern, -1), F.length).alias("gap"), F.transform(found, F.length).alias("len"), keep.alias("keep"))

    def placed(steps: Column) -> Column:
        ends = _running(F.transform(steps, lambda x: x["gap"] + x["len"]))
        span = lambda x, end: F.struct((end - x["len"]).alias("start"), F.lit(KINDS.index(kind)).alias("rank"), end.alias("end"), x["keep"].alias("keep"))
        return F.transform(F.filter(F.zip_with(steps, ends, span), lambda x: x["keep"]), lambda x: F.struct(x["start"], x["rank"], x["end"]))

    spans = _let(F.filter(steps, lambda x: x["len"].isNotNull()), placed)
    return F.when(F.expr(gate) if isinstance(gate, str) else gate, spans).otherwise(F.array().cast(SPANS)).cast(SPANS).alias(kind)


def _joined(spans: Column) -> Column:
    """``kind:start:end`` by start, then kind."""
    kinds = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(F.array_sort(spans), lambda x: F.concat_ws(":", F.get(kinds, x["rank"]), x["start"], x["end"])), ",")


def find_parts(docs: DataFrame) -> DataFrame:
    """doc_id, h (hash of the text) and an array of spans for each kind; one row per input row."""
    texts = id_text(docs).select("doc_id", F.coalesce("text", F.lit("")).alias("t"))
    gated = texts.withColumns({
        "has_assign": F.col("t").rlike("(?i)(password|passwd|secret|token|api_?key)[\"']?\\x20*[:=]"),
        "has_access": F.col("t").rlike(ACCESS), "has_hex": F.col("t").rlike(HEX), "has_endp": F.col("t").rlike(ENDP_GATE),
    })
    long_enough = lambda found: F.transform(F.regexp_extract_all("t", F.lit(ASSIGN), F.lit(2)), lambda x: F.length(x) >= ASSIGN_LEAST)
    mixed = lambda found: F.transform(found, lambda x: x.rlike("[0-9]") & x.rlike("[A-Z]") & x.rlike("[a-z]"))
    return gated.select(
        "doc_id", F.xxhash64("t").alias("h"),
        _spans("assign", ASSIGN, "has_assign", long_enough), _spans("access", ACCESS, "has_access"), _spans("hex", HEX, "has_hex"),
        _spans("wkey", WKEY, "has_access or has_endp", mixed), _spans("endp", ENDP, "has_endp"),
    )


def link_parts(rows: DataFrame, scope: int = SCOPE) -> DataFrame:
    """doc_id, h and the weak spans with a complementary part within ``scope`` characters."""
    some = rows.filter(((F.size("wkey") > 0) & (F.size("access") + F.size("endp") > 0)) | ((F.size("endp") > 0) & (F.size("access") > 0)))
    parts = some.select("doc_id", "h", F.explode(F.concat("access", "wkey", "endp")).alias("p")).distinct().select("doc_id", "h", "p.*")
    text = Window.partitionBy("doc_id", "h").orderBy("start", "rank", "end")
    before, after = text.rowsBetween(Window.unboundedPreceding, -1), text.rowsBetween(1, Window.unboundedFollowing)

    def near(kind: str) -> Column:
        of = F.col("rank") == KINDS.index(kind)
        left, right = F.max(F.when(of, F.col("end"))).over(before), F.min(F.when(of, F.col("start"))).over(after)
        return F.coalesce(F.col("start") - left <= scope, F.lit(False)) | F.coalesce(right - F.col("end") <= scope, F.lit(False))

    seen = parts.withColumns({"by_access": near("access"), "by_wkey": near("wkey"), "by_endp": near("endp")})
    linked = seen.filter(
        ((F.col("rank") == KINDS.index("wkey")) & (F.col("by_access") | F.col("by_endp"))) | ((F.col("rank") == KINDS.index("endp")) & (F.col("by_access") | F.col("by_wkey")))
    )
    return linked.groupBy("doc_id", "h").agg(F.collect_list(F.struct("start", "rank", "end")).alias("weak"))


def scan_secrets(docs: DataFrame, scope: int = SCOPE) -> DataFrame:
    """One row per input row: doc_id, n_assign, n_access, n_hex, base_sha256, spans.

    ``spans`` lists strong spans and linked weak ones as ``kind:start:end`` by start, then kind, in
    code points, end exclusive; ``base_sha256`` digests the list of strong spans alone. Null or empty
    text has no spans (the digest is that of the empty string). Rows with a null doc_id are scanned
    like others, each text for itself; repeated rows give equal rows. No rows in, no rows out.
    """
    rows = written(find_parts(docs))
    linked = link_parts(rows, scope).select(F.col("doc_id").alias("l_id"), F.col("h").alias("l_h"), "weak")
    joined = rows.join(linked, F.col("doc_id").eqNullSafe(F.col("l_id")) & (F.col("h") == F.col("l_h")), "left")
    base = F.concat("assign", "access", "hex")
    return joined.select(
        "doc_id", *(F.size(k).cast("long").alias(f"n_{k}") for k in KINDS[:3]),
        F.sha2(_joined(base).cast("binary"), 256).alias("base_sha256"),
        _joined(F.concat(base, F.coalesce("weak", F.array().cast(SPANS)))).alias("spans"),
    )
