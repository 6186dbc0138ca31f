import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from conftest_llm import prose
from postsieve.llm import packing, shards
from postsieve.llm.queries import tokenizer_path
from postsieve.llm.tokens import Encoder, frequent_lengths, token_counts

BYTE, WORD = tokenizer_path("byte_bpe_50k.json"), tokenizer_path("word_bpe_49k.json")
TEXTS = [
    "", None, " ", "a", " a", "a ", "ab cd", "ab  cd", "a   b", "a\nb", "a \nb", "a\n b", "a\n\n\nb", "tab\tx", "it's we'll O'Neil's 'quoted'", "x'S", "1234 12a b2", "è già così, più!", "Straße ÄÖ", "日本語 text", "a b", "a\x1cb", "²³ ½ ª",
    "é combining", "İstanbul ΣΑΣ", "<|endoftext|>", "x<|endoftext|>y <|startoftext|>", "*** $$$ end...", "emoji 😀 here", "\r\nline\r\n", "W" * 3000, "word " * 5000, "a,b;c", "ﬁ ligature", "\x00 nul",
]


@pytest.mark.parametrize("path", [BYTE, WORD])
def test_encoder_equals_library(path):
    enc, lib = Encoder(path), Tokenizer.from_file(path)
    rng = random.Random(6)
    alphabet = [*"abXYZ àéñß019 '.,;!?-_$*#\n\t", "  ", " \n", "'s", "'ll", "’", " "]
    texts = [t or "" for t in TEXTS] + ["".join(rng.choice(alphabet) for _ in range(rng.randrange(40))) for _ in range(600)] + [prose(rng, 50) for _ in range(20)]
    rng.shuffle(texts)
    for group in (texts, texts[::-1], *([t] for t in texts)):
        for t in group:
            want = lib.encode(t, add_special_tokens=False).ids
            assert np.frombuffer(enc.text_ids(t), "<u4").tolist() == want, repr(t)
            assert enc.count(t) == len(want), repr(t)


@pytest.mark.parametrize("path", [BYTE, WORD])
def test_ordinary_texts_take_the_table(path):
    """Apostrophes, quotes, runs of blanks and empty lines don't send a text to the library whole."""
    enc, lib = Encoder(path), Tokenizer.from_file(path)
    enc.whole = None
    for t in ("it's  l'eau\n\n\n“così”\t\tfine…\r\n", " a  b ", "naïve — Straße’s 日本語 ΣΑΣ", "x\u200b y"):
        assert np.frombuffer(enc.text_ids(t), "<u4").tolist() == lib.encode(t, add_special_tokens=False).ids


@pytest.mark.parametrize("path", [BYTE, WORD])
def test_every_code_point_is_cut_as_the_library_does(path):
    enc, lib = Encoder(path), Tokenizer.from_file(path)
    texts = ["".join(f"a{chr(c)}1 {chr(c)}{chr(c)} b{chr(c)}\n" for c in range(at, at + 64) if not 0xD800 <= c < 0xE000) for at in range(0, 0x30000, 64)]
    for t, want in zip(texts, lib.encode_batch(texts, add_special_tokens=False), strict=True):
        assert np.frombuffer(enc.text_ids(t), "<u4").tolist() == want.ids, hex(ord(t[1]))


def thue_morse(n, letters):
    """Two words of n letters, each other's complement, that polynomial hashes modulo a power of two don't tell apart."""
    signs = [bin(i).count("1") % 2 for i in range(n)]
    return tuple("".join(letters[s ^ flip] for s in signs) for flip in (0, 1))


def test_complementary_words_are_told_apart(docs):
    lib, low = Tokenizer.from_file(BYTE), Tokenizer.from_file(WORD)
    texts = [w for n in (1024, 2048, 4096) for pair in ("ab", "eq") for w in thue_morse(n, pair)]
    got = {r.doc_id: r.n_tokens for r in token_counts(docs(list(enumerate(texts))), BYTE).collect()}
    assert got == {i: len(lib.encode(t, add_special_tokens=False).ids) for i, t in enumerate(texts)}
    crc = {(r.doc_id, r.piece): r.ids_crc32 for r in packing.pack(docs(list(enumerate(texts))), WORD).collect()}
    ids = {i: np.array([*low.encode(t, add_special_tokens=False).ids, 0], "<u4") for i, t in enumerate(texts)}
    assert crc == {(i, k // 2048): zlib.crc32(x[k : k + 2048].tobytes()) for i, x in ids.items() for k in range(0, len(x), 2048)}


def test_small_caches_change_nothing(monkeypatch):
    from postsieve.llm import tokens

    for name in ("CACHED", "CACHED_CHARS"):
        monkeypatch.setattr(tokens, name, 3)
    monkeypatch.setattr(tokens, "AT_ONCE", 50)
    rng = random.Random(2)
    enc, lib = Encoder(BYTE), Tokenizer.from_file(BYTE)
    texts = [prose(rng, 20) for _ in range(30)]
    assert list(map(enc.count, texts)) == [len(lib.encode(t, add_special_tokens=False).ids) for t in texts]


def test_ids_are_cached_up_to_a_bound_of_their_own(monkeypatch):
    from postsieve.llm import tokens

    monkeypatch.setattr(tokens, "CACHED_IDS", 100)
    enc, lib = Encoder(WORD), Tokenizer.from_file(WORD)
    for k in range(40):
        text = " ".join(f"a{chr(97 + i)}{chr(97 + k % 26)}" for i in range(20))
        assert np.frombuffer(enc.text_ids(text), "<u4").tolist() == lib.encode(text, add_special_tokens=False).ids and len(enc.ids) <= 120


def test_workers_keep_no_ids(docs):
    kept = {}

    def look(batches):
        import pyarrow as pa

        from postsieve.llm.tokens import encoder

        for _ in batches:
            yield pa.record_batch({"n": pa.array([len(encoder(WORD).ids)], pa.int64())})

    for _ in range(2):
        rows = docs([(i, prose(random.Random(i), 50)) for i in range(20)]).coalesce(1)
        packing.token_pieces(rows, WORD).collect()
        kept = {r.n for r in rows.select("doc_id").mapInArrow(look, "n long").collect()}
    assert kept == {0}


def test_counts(docs):
    rows = list(enumerate(TEXTS)) + [(None, "ab cd"), (6, "ab cd")]
    lib = Tokenizer.from_file(BYTE)
    got = token_counts(docs(rows), BYTE, limit=100).collect()
    want = [(i, len((t or "").encode()), n := len(lib.encode(t or "", add_special_tokens=False).ids), n > 100) for i, t in rows]
    assert [tuple(r) for r in got] == want
    assert token_counts(docs([]).filter("false"), BYTE).count() == 0


def test_frequent_table_is_bounded(docs):
    rng = random.Random(1)
    rows = docs([(i, prose(rng, 30)) for i in range(30)])
    table = frequent_lengths(rows, BYTE, sample=20, entries=15)
    enc = Encoder(BYTE)
    texts = [r.text for r in rows.collect()]
    assert len(table) == 15 and set(table) <= {p for t in texts for p in enc.pieces(t)}
    enc.table = table
    assert list(map(enc.count, texts)) == [len(enc.whole(t)) // 4 for t in texts]


# Packing


def best_bins(lengths, capacity):
    """The least number of bins by search; for a handful of pieces."""
    lengths = sorted(lengths, reverse=True)
    best = len(lengths)

    def go(i, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if i == len(lengths):
            best = len(bins)
            return
        for k in range(len(bins)):
            if bins[k] + lengths[i] <= capacity and bins[k] not in bins[:k]:
                go(i + 1, bins[:k] + [bins[k] + lengths[i]] + bins[k + 1 :])
        go(i + 1, [*bins, lengths[i]])

    go(0, [])
    return best


def test_bounds_and_best_fit():
    rng = random.Random(5)
    for _ in range(150):
        lengths = np.array(sorted((rng.randrange(1, 21) for _ in range(rng.randrange(1, 9))), reverse=True))
        bound = packing.lower_bound(np.bincount(lengths, minlength=21), 20)
        bins, offsets, n = packing.best_fit(lengths, 20)
        least = best_bins(lengths.tolist(), 20)
        assert bound <= least <= n
        for k in range(n):
            at = np.argsort(offsets[bins == k])
            size = lengths[bins == k][at]
            assert size.sum() <= 20 and offsets[bins == k][at].tolist() == (np.cumsum(size) - size).tolist()


def check_packing(rows, got, capacity):
    lib = Tokenizer.from_file(WORD)
    streams = {i: lib.encode(t or "", add_special_tokens=False).ids + [0] for i, t in rows}
    seen = {i: 0 for i in streams}
    bins = {}
    for r in sorted(got, key=lambda r: (r.doc_id, r.piece)):
        part = streams[r.doc_id][r.start : r.start + r.length]
        assert r.start == seen[r.doc_id] == r.piece * capacity and len(part) == r.length and zlib.crc32(np.array(part, "<u4").tobytes()) == r.ids_crc32
        assert r.length == capacity or r.start + r.length == len(streams[r.doc_id])
        seen[r.doc_id] += r.length
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert seen == {i: len(x) for i, x in streams.items()}
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(bins), packing.lower_bound(np.bincount([r.length for r in got], minlength=capacity + 1), capacity)


def test_pack(docs):
    rng = random.Random(7)
    rows = [(i, prose(rng, rng.randrange(1, 60))) for i in range(300)] + [(900, None), (901, ""), (902, prose(rng, 900)), (903, "W" * 4000)]
    bins, bound = check_packing(rows, packing.pack(docs(rows), WORD, capacity=128).collect(), 128)
    assert bins <= bound + 1


def test_pack_exchanges(docs):
    """Many small partitions: their loose bins meet until the count is certified or all have met."""
    rng = random.Random(8)
    rows = [(i, prose(rng, rng.randrange(1, 40))) for i in range(400)]
    got = packing.pack(docs(rows), WORD, capacity=128, part_pieces=20, fan=3).collect()
    bins, bound = check_packing(rows, got, 128)
    alone = packing.pack(docs(rows), WORD, capacity=128, part_pieces=20, fan=1000).collect()
    assert bins <= bound + 3 and len({r.sequence_id for r in alone}) >= bound


def test_pack_is_the_same_however_rows_lie(docs):
    """Other partitions and orders of the rows, with many equal ones: the same sequences, with their bound."""
    rng = random.Random(9)
    rows = [(i, prose(rng, rng.randrange(1, 40))) for i in range(300)] + [(7, "sempre uguale")] * 700 + [(None, None)] * 300
    results = []
    for n in (1, 3, 5):
        rng.shuffle(rows)
        got = packing.pack(docs(rows).repartition(n), WORD, capacity=128, part_pieces=100, fan=3).collect()
        results.append(sorted(tuple(r) for r in got if r.doc_id is not None) + sorted(tuple(r)[1:] for r in got if r.doc_id is None))
        bound = packing.lower_bound(np.bincount([r.length for r in got], minlength=129), 128)
        assert len(got) == len(rows) and {(r.sequences, r.least_sequences) for r in got} == {(len({r.sequence_id for r in got}), bound)}
    assert results[0] == results[1] == results[2] and got[0].sequences - bound <= 1


def test_pack_repeats(docs):
    rows = [(1, "uno due")] * 3 + [(None, "uno due"), (None, None)]
    got = packing.pack(docs(rows), WORD).collect()
    assert len(got) == 5 and len({(r.sequence_id, r.offset) for r in got}) == 5
    assert packing.pack(docs([]).filter("false"), WORD).count() == 0


# Shards


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5, 17, 64, 1000])
def test_permutation(n):
    x = np.arange(n)
    p = shards.permute(x, n, 11)
    assert sorted(p.tolist()) == x.tolist() and shards.permute(p, n, 11, inverse=True).tolist() == x.tolist()
    assert n < 64 or (p != shards.permute(x, n, 12)).any()


def test_round_trip(spark, docs, tmp_path):
    rng = random.Random(3)
    rows = [(i, prose(rng, rng.randrange(1, 80))) for i in range(200)] + [(900, None), (901, ""), (None, "nulla"), (5, "ripetuto"), (902, prose(rng, 3000))]
    docs(rows).coalesce(3).write.parquet(f"{tmp_path}/in")
    table = spark.read.parquet(f"{tmp_path}/in")
    out = f"file://{tmp_path}/shards"
    path = tokenizer_path("byte_bpe_50k.tiktoken")
    got = sorted(shards.materialise(table, path, out, key=5, sequence=32, per_shard=16).collect(), key=lambda r: r.sequence)
    n = len(got)
    assert [r.sequence for r in got] == list(range(n)) and sorted(r.slot for r in got) == list(range(n)) and all(r.shard == r.slot // 16 for r in got)
    assert [r.slot for r in got] == shards.permute(np.arange(n), n, 5).tolist()
    read = list(shards.read_slots(out, 0, n, sequence=32, per_shard=16))
    stream = [x for r in got for x in read[r.slot][: r.n_ids].tolist()]
    enc = shards._encoding(path)
    assert stream == [x for r in table.orderBy("_metadata.file_path", "_metadata.row_index").collect() for x in [*enc.encode_ordinary(r.text or ""), 50256]]
    assert all(zlib.crc32(read[r.slot][: r.n_ids].astype("<u2").tobytes()) == r.ids_crc32 for r in got)
    part = list(shards.read_slots(out, 5, 40, sequence=32, per_shard=16))
    assert np.array_equal(np.array(part), np.array(read[5:40]))
    again = shards.materialise(table, path, f"file://{tmp_path}/again", key=5, sequence=32, per_shard=16)
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, got))
    assert not [f for f in (tmp_path / "shards").iterdir() if f.name.startswith(".") and not f.name.endswith(".crc")]


def test_shards_do_not_depend_on_the_scan(spark, docs, tmp_path):
    """Other splits of the same files, and any order of rows that come from no file, give equal shards."""
    rng = random.Random(4)
    rows = [(i, prose(rng, rng.randrange(1, 80))) for i in range(400)] + [(None, "nulla"), (None, None), (5, "ripetuto"), (5, "ripetuto")]
    path = tokenizer_path("byte_bpe_50k.tiktoken")
    docs(rows).repartition(5).write.option("parquet.block.size", 4096).parquet(f"{tmp_path}/in")
    run = lambda table, name: sorted(map(tuple, shards.materialise(table, path, f"file://{tmp_path}/{name}", key=5, sequence=32, per_shard=16).collect()))
    read = lambda name: [f.read_bytes() for f in sorted((tmp_path / name).glob("shard-*"))]
    whole = run(spark.read.parquet(f"{tmp_path}/in"), "a")
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "6000")
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        table = spark.read.parquet(f"{tmp_path}/in")
        assert table.rdd.getNumPartitions() > 5 and run(table, "b") == whole and read("b") == read("a")
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    rng.shuffle(rows)
    mixed = run(spark.read.parquet(f"{tmp_path}/in").repartition(3), "c")
    assert mixed == run(docs(rows).repartition(2), "d") and read("c") == read("d") and len(mixed) == len(whole)


def test_ids_that_do_not_fit_are_refused(docs, tmp_path):
    with pytest.raises(ValueError):
        shards.materialise(docs([(1, "a")]), tokenizer_path("byte_bpe_50k.tiktoken"), f"file://{tmp_path}/x", width=1)


def test_no_rows_no_shards(docs, tmp_path):
    assert shards.materialise(docs([]).filter("false"), tokenizer_path("byte_bpe_50k.tiktoken"), f"file://{tmp_path}/none").count() == 0
