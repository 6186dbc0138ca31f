import random
import re

import pytest
from pyspark.sql import functions as F

from postsieve.functions import pii, terms, text
from postsieve.operators.canonical import canonicalise, redact

QUOTED = [r"^>+\s", r"^\|+\s", r"^On .+ wrote:", r"^Il .+ ha scritto:", r"^-+\s*Original Message\s*-+", r"^-+\s*Messaggio originale\s*-+"]


def quoted(line):
    s = line.strip()
    return s.startswith(">") or any(re.match(p, s, re.I) for p in QUOTED)


def blocks(t):
    """Blocks of quoted lines by plain iteration: (type, start, end, content)."""
    out, now, start, at = [], [], 0, 0
    for line in t.split("\n"):
        if quoted(line):
            if not now:
                start = at
            now.append(line)
        elif line.strip() and now:
            out.append((now, start))
            now = []
        at += len(line) + 1
    if now:
        out.append((now, start))
    joined = [("quote" if any(x.strip().startswith((">", "|")) for x in ls) else "reply_header", s, "\n".join(ls)) for ls, s in out]
    return [(k, s, s + len(c), c) for k, s, c in joined]


def test_whitespace(column):
    got = column(text.normal_whitespace, "a  \r\nb\t\tc\rd", "  keep   indent\t x \n\n\n\nnext", "a \n \n \nb", "x \ny", "", None)
    assert got == ["a\nb c\nd", "  keep indent x\n\nnext", "a\n\nb", "x\ny", "", None]


def test_disclaimer(column):
    assert column(text.without_disclaimer, "a\n__________ x\ny", "a\n_________\nb", "__________\nx") == ["a", "a\n_________\nb", "__________\nx"]


@pytest.mark.parametrize(
    "given, want",
    [
        ("ciao\n--\nMario", "ciao"), ("ciao\n-- \nMario", "ciao"), ("a\n--x\nb", "a\n--x\nb"), ("a\n___\nb", "a"), ("a\n  cordiali SALUTI,\nb", "a"), ("Grazie per tutto\nresto", ""),
        ("a\nsent from my iPhone", "a"), ("a\nInviato da Outlook\nb", "a"), ("a\ndistinti saluti\n--\nb", "a"), ("un saluti interno", "un saluti interno"), ("", ""),
    ],
)
def test_signature(column, given, want):
    assert column(text.without_signature, given) == [want]


def test_sections_reproduce_content(spark):
    body = "Ciao\n\nOn Monday Anna wrote:\n> uno\n\n> due\ntesto\n> tre\nfine\nCordiali saluti\nAnna\n__________\nriservato"
    row = canonicalise(spark.createDataFrame([(body,)], "body string"), "body").first()
    assert row.canonical_text == "ciao\n\n\ntesto\nfine"
    assert [s.type for s in row.removed_sections] == ["disclaimer", "signature", "quote", "quote"]
    step = text_steps(body)
    for s, of in zip(row.removed_sections, step, strict=True):
        if s.type != "quote":
            assert of[s.span_start : s.span_end] == s.content


def text_steps(body):
    undisclaimed = body.split("\n__________")[0]
    unsigned = undisclaimed.split("\nCordiali")[0]
    return [body, undisclaimed, unsigned, unsigned]


def test_reply_blocks_equal_plain_iteration(column):
    rng = random.Random(5)
    lines = ["> a", ">", "| b", "", "  ", "testo", "On x wrote:", "Il 3 ha scritto: y", "--- Original Message ---", " > c", "|x"]
    texts = ["\n".join(rng.choice(lines) for _ in range(rng.randrange(12))) for _ in range(200)]
    got = column(text.reply_sections, *texts)
    assert [[tuple(s) for s in x] for x in got] == [blocks(t) for t in texts]
    assert column(text.without_replies, *texts) == ["\n".join(x for x in t.split("\n") if not quoted(x)) for t in texts]


def test_canonical_is_repeatable(column):
    texts = ["Ciao   MONDO \r\n\r\n\r\n\r\nÈ  ora", None, ""]
    assert column(text.canonical, *texts) == column(text.canonical, *texts) == ["ciao mondo\n\nè ora", None, ""]


def test_html(column):
    got = column(text.strip_html, "<p>Ciao &amp; <b>mondo</b></p><script>x<y</script>\n<style>p{}</style> fine&nbsp;qui", "", None)
    assert got == ["Ciao & mondo fine qui", "", None]
    assert column(text.clean_html, "<img a='1' src='http://x/tracking.gif'>t<a href='mailto:a@b.it'>scrivi</a>") == ["tscrivi"]
    assert column(text.replace_urls, "vedi https://a.it/x?y e http://b", "niente") == ["vedi [URL] e [URL]", "niente"]
    assert column(lambda c: text.collapse_newlines(c, 1), "a\n\n\nb") == ["a\nb"]


EMAIL, PHONE = re.compile(pii.EMAIL), re.compile(pii.PHONE)


def test_redaction_positions(spark):
    body = "scrivi a a.b@c.it o a.b@c.it, tel 3331234567 o +39 06 12345678; ordine 0123456."
    row = redact(spark.createDataFrame([(body,)], "t string"), "t", "out", salt="s").first()
    emails = [m.span() for m in EMAIL.finditer(body)]
    mid = row.out
    assert mid == "scrivi a [EMAIL_1] o [EMAIL_2], tel [PHONE_1] o +39 [PHONE_2]; ordine [PHONE_3]."
    assert [tuple(e.position) for e in row.pii_redaction_log if e.type == "email"] == emails
    between = body.replace("a.b@c.it", "[EMAIL_1]", 1).replace("a.b@c.it", "[EMAIL_2]")
    assert [tuple(e.position) for e in row.pii_redaction_log if e.type == "phone"] == [m.span() for m in PHONE.finditer(between)]
    first, second = [e.original_hash for e in row.pii_redaction_log if e.type == "email"]
    assert first == second and first.startswith("sha256-") and len(first) == 71


@pytest.mark.parametrize("level, want", [("none", "a@b.it 3331234567"), ("minimal", "[EMAIL_1] 3331234567"), ("standard", "[EMAIL_1] [PHONE_1]"), ("aggressive", "[EMAIL_1] [PHONE_1]")])
def test_levels(spark, level, want):
    row = redact(spark.createDataFrame([("a@b.it 3331234567",), (None,)], "t string"), "t", "out", level).collect()
    assert row[0].out == want and row[1].out == "" and row[1].pii_redaction_log == []


def test_salt_changes_hash(column):
    a, b = column(lambda c: pii.salted_hash(c, "x"), "v")[0], column(lambda c: pii.salted_hash(c, "y"), "v")[0]
    assert a != b


def test_tokens_and_ngrams(column):
    assert column(terms.tokens, "L'Azienda non può, 12 città-x") == [["l'azienda", "non", "può", "12", "città", "x"]]
    two = lambda c: terms.ngrams(terms.tokens(c), 2)
    assert column(two, "uno due tre", "uno", "") == [["uno due", "due tre"], [], []]
    assert column(lambda c: terms.ngrams(terms.tokens(c), 0), "uno") == [[]]
    assert len(terms.STOP_WORDS) == 253 and {"dello", "perche", "nostra", "lunedi"} <= set(terms.STOP_WORDS)


def test_blacklist(column):
    assert column(terms.blacklisted, "re: x", "123", "12/03-1.2", "fattura", "fwd:", "r2") == [True, True, True, False, True, False]


def test_ids(spark):
    import hashlib

    row = spark.range(1).select(terms.stable_id(F.lit("body"), F.lit("fattura")).alias("x")).first()
    assert row.x == hashlib.sha1(b"body|fattura").hexdigest()[:12]
