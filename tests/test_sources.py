import json

from pyspark.sql import functions as F

from postsieve.sources import lists, mail
from postsieve.streaming import ingest as stream

MAILS = {
    "plain": b"From: Anna <anna@example.com>\r\nTo: a@x.it, b@x.it,\r\nCc: c@x.it\r\nSubject: Prova\r\nDate: Mon, 12 Feb 2024 10:00:00 +0100\r\nMessage-ID: <1@x>\r\nReferences: <a@x> <b@x>\r\nContent-Type: text/plain; charset=utf-8\r\n\r\nCiao  MONDO,\r\nscrivi a x@y.it o 3331234567.\r\n\r\nCordiali saluti\r\nAnna\r\n",
    "multi": b"From: x@y.it\r\nSubject: M\r\nMIME-Version: 1.0\r\nContent-Type: multipart/mixed; boundary=B\r\n\r\n--B\r\nContent-Type: multipart/alternative; boundary=C\r\n\r\n--C\r\nContent-Type: text/plain\r\n\r\nTesto semplice.\r\n--C\r\nContent-Type: text/html\r\n\r\n<p>Testo <b>html</b></p>\r\n--C--\r\n--B\r\nContent-Type: application/pdf\r\nContent-Disposition: attachment; filename=\"report.pdf\"\r\nContent-Transfer-Encoding: base64\r\n\r\nAAAA\r\n--B--\r\n",
    "html": b"From: x@y.it\r\nContent-Type: text/html\r\n\r\n<html><style>p{}</style><body><h1>Welcome</h1><p>Caff&egrave; &amp; <a href='http://z'>link</a></p><script>no()</script></body></html>",
    "latin": "From: x@y.it\r\nContent-Type: text/plain; charset=iso-8859-1\r\n\r\nCafé naïve".encode("latin-1"),
    "unknown_charset": b"From: x@y.it\r\nContent-Type: text/plain; charset=x-none\r\n\r\nabc",
    "malformed": b"questa non e una mail\nsenza intestazioni",
    "bodyless": b"From: x@y.it\r\n\r\n",
    "bad_date": b"From: x@y.it\r\nDate: ieri\r\n\r\ntesto",
}


def files(tmp_path):
    (tmp_path / "sub").mkdir()
    for i, (name, content) in enumerate(MAILS.items()):
        (tmp_path / ("sub" if i % 2 else ".") / f"{name}.eml").write_bytes(content)
    (tmp_path / "note.txt").write_text("no")
    return str(tmp_path)


def by_name(df):
    return {r.path.rsplit("/", 1)[1].removesuffix(".eml"): r for r in df.collect()}


def test_ingest(spark, tmp_path):
    good, large = mail.scan(spark, files(tmp_path))
    assert [(r.path.rsplit("/", 1)[1], r.size, r.reason) for r in large.collect()] == [("note.txt", 2, "not_eml")] and good.count() == len(MAILS)
    got = by_name(mail.ingest(good))
    plain = got["plain"]
    assert plain.canonical_text == "ciao mondo,\nscrivi a [EMAIL_1] o [PHONE_1]." and plain.success
    assert plain.headers.to_addresses == ["a@x.it", "b@x.it"] and plain.headers.references == ["<a@x>", "<b@x>"] and plain.headers.date.isoformat() == "2024-02-12T09:00:00"
    assert [s.type for s in plain.removed_sections] == ["signature"] and len(plain.pii_redaction_log) == 2 and plain.document_id.startswith("eml-") and len(plain.document_id) == 36
    multi = got["multi"]
    assert multi.body_text.strip() == "Testo semplice." and [a.filename for a in multi.attachments] == ["report.pdf"] and multi.body_html is None
    assert got["html"].canonical_text == "welcome\ncaffè & link" and "no()" not in got["html"].canonical_text
    assert got["latin"].canonical_text == "café naïve" and got["unknown_charset"].canonical_text == "abc"
    assert got["malformed"].headers.from_address == "" and got["malformed"].canonical_text.startswith("questa non")
    assert got["bodyless"].canonical_text == "" and got["bad_date"].headers.date is None
    again = by_name(mail.ingest(good))
    assert all(got[k].document_id == again[k].document_id for k in got)
    stamped = by_name(mail.ingest(good, stamp=F.lit("2024-01-01T00:00:00")))
    assert stamped["plain"].document_id != plain.document_id


def test_strict_text():
    from email import message_from_bytes, policy

    part = lambda head, body: message_from_bytes(b"Content-Type: text/plain" + head + b"\r\n\r\n" + body, policy=policy.compat32)
    assert mail.strict_text(part(b"; charset=iso-8859-1", "è".encode("latin-1"))) == "è" and mail.strict_text(part(b"; charset=utf-8", "però".encode())) == "però"
    assert mail.strict_text(part(b"; charset=x-none", b"abc")) == "abc" and mail.strict_text(part(b"", b"")) == "" and "\ufffd" not in mail.strict_text(part(b"; charset=ascii", "perché così".encode()))


def test_empty_and_broken_bytes():
    """Spark's file sources skip files of no bytes; the parser takes them."""
    assert mail.parse_bytes(b"")["error"] is None and mail.parse_bytes(b"\xff\xfe\x00")["error"] is None


def test_limits(spark, tmp_path):
    from postsieve.settings import Settings

    good, large = mail.scan(spark, files(tmp_path), s=Settings(max_email_bytes=100))
    assert {r.reason for r in large.collect()} == {"too_large", "not_eml"} and good.count() + large.count() == len(MAILS) + 1
    flat, _ = mail.scan(spark, str(tmp_path), recursive=False)
    assert 0 < flat.count() < len(MAILS)


def test_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for name, content in MAILS.items():
        (tmp_path / "in" / f"{name}.eml").write_bytes(content)
    q = stream.write(stream.documents(spark, f"{tmp_path}/in"), f"{tmp_path}/out", f"{tmp_path}/ck")
    q.awaitTermination(120)
    assert spark.read.parquet(f"{tmp_path}/out").count() == len(MAILS)
    (tmp_path / "in" / "late.eml").write_bytes(MAILS["plain"] + b"x")
    stream.write(stream.documents(spark, f"{tmp_path}/in"), f"{tmp_path}/out", f"{tmp_path}/ck").awaitTermination(120)
    assert spark.read.parquet(f"{tmp_path}/out").count() == len(MAILS) + 1


def test_lists_and_sinks(spark, tmp_path):
    (tmp_path / "known.txt").write_text("# remark\n Mario@X.it \n\nnote\nanna@y.it\n")
    assert sorted(r.value for r in lists.known_emails(spark, f"{tmp_path}/known.txt").collect()) == ["anna@y.it", "mario@x.it"]
    lists.add_known_email(spark, " New@Z.it", f"{tmp_path}/list")
    lists.add_known_email(spark, "b@z.it", f"{tmp_path}/list")
    assert lists.known_emails(spark, f"{tmp_path}/list").count() == 2
    assert sorted(r.value for r in lists.known_domains(spark).collect()) == ["cliente.it", "company.com"]
    rows = spark.range(5).selectExpr("id", "named_struct('x', id) as s")
    lists.write_results(rows, f"{tmp_path}/lines")
    assert spark.read.json(f"{tmp_path}/lines").count() == 5
    lists.write_results(rows.coalesce(1), f"{tmp_path}/all.json")
    text = "".join(r.value for r in spark.read.text(f"{tmp_path}/all.json").collect())
    assert len(json.loads(text)) == 5
    lists.write_results(rows.repartition(3), f"{tmp_path}/parts.json")
    parts = [json.loads(f.read_text()) for f in (tmp_path / "parts.json").glob("part-*")]
    assert sorted(x["id"] for p in parts for x in p) == list(range(5))
    lists.write_results(rows.filter("id < 0").coalesce(1), f"{tmp_path}/none.json")
    assert [json.loads(f.read_text()) for f in (tmp_path / "none.json").glob("part-*")] == [[]]


def test_json_documents_and_candidates(spark, tmp_path):
    (tmp_path / "d.jsonl").write_text('{"document_id":"a","headers":{"subject":"s","to_addresses":["x@y.it"]},"canonical_text":"t","extra":1}\n{broken\n')
    got = {r.document_id: r for r in lists.read_documents(spark, f"{tmp_path}/d.jsonl").collect()}
    assert got["a"].headers.to_addresses == ["x@y.it"] and got["a"].canonical_text == "t" and got["a"]._corrupt is None and got[None]._corrupt == "{broken"
    (tmp_path / "c.jsonl").write_text('{"document_id":"a","candidates":[{"candidate_id":"c1","term":"x","count":2},{"candidate_id":"c2","term":"y","composite_score":0.5}]}\n{"document_id":"b"}\n')
    rows = sorted((r.document_id, r.candidate_id, r["count"], r.composite_score) for r in lists.read_candidates(spark, f"{tmp_path}/c.jsonl").collect())
    assert rows == [("a", "c1", 2, None), ("a", "c2", None, 0.5)]


def test_settings_from_texts():
    from dataclasses import replace

    from postsieve.settings import DEFAULT, configured

    got = configured({"POSTSIEVE_MAX_NGRAM": "2", "postsieve.known_domains": "a.it, b.it", "crm_enabled": "no", "weight_count": "0.5", "HOME": "/x"})
    assert got == replace(DEFAULT, max_ngram=2, known_domains=("a.it", "b.it"), crm_enabled=False, weight_count=0.5)
    assert lists.crm_available() and not lists.crm_available(s=got) and not lists.crm_available(s=replace(DEFAULT, known_domains=()))


def test_shared_folder_is_required_on_a_cluster():
    from types import SimpleNamespace

    import pytest

    from postsieve.session import work_dir

    session = lambda master, top: SimpleNamespace(conf=SimpleNamespace(get=lambda k, d: top or d), sparkContext=SimpleNamespace(master=master))
    assert work_dir(session("spark://h:7077", "hdfs://x/")).startswith("hdfs://x/postsieve/") and work_dir(session("local[4]", None)) and work_dir(session("local", None))
    for master in ("spark://h:7077", "yarn", "local-cluster[2,1,1024]", "k8s://x"):
        with pytest.raises(RuntimeError):
            work_dir(session(master, None))


def test_tables(spark):
    lists.create_tables(spark)
    assert spark.table("lexicon_entries").count() == 0
    lists.drop_tables(spark)
    assert not spark.catalog.tableExists("lexicon_entries")


def test_version_name():
    assert mail.version_name().startswith("Pipeline-1-")
