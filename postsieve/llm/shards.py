"""Training-order materialisation of token ids in binary shards.

The ids of all documents, an end id after each, are one stream in the order of the input's files and
the rows in them; it is cut into sequences of ``sequence`` ids, numbered from 0 to N-1. A first pass counts the ids of
each segment (rows of one file that a task reads in a row), whose running sums tell where each segment
stands in the stream; a sequence that two segments share is made of both's parts. So sequences don't depend on how a scan is split. A keyed Feistel permutation over the next power of four, walked along its
cycles until it falls below N, gives each its global slot: no table of the order exists anywhere,
and any slot's place can be computed alone. Sequences are then range-partitioned by slot (the
splitters are known: slots are dense) and each task writes its shards one after the other.

A shard is a plain file of little-endian ids: slot s lies in shard s // per_shard at byte
(s % per_shard) * stride, so a reader resumes anywhere by seeking. Files are written under a
temporary name and moved, so a task that runs again after a lost executor leaves the same files.

An input whose rows don't come straight from files is sorted by doc_id and text hash and written first.
"""

from __future__ import annotations

import base64
import uuid
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import id_text, work_dir, written

SEQUENCE, PER_SHARD, ROUNDS = 1024, 4096, 6
ROWS = "slot long, shard long, sequence long, first_doc long, last_doc long, n_ids int, ids_crc32 long"


@lru_cache(maxsize=1)
def _encoding(path: str):
    """The tokenizer of a ``.tiktoken`` file."""
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("file", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def permute(index: np.ndarray, n: int, key: int, inverse: bool = False) -> np.ndarray:
    """Places of ``index`` in a keyed permutation of 0..n-1."""
    half = max(1, ((max(n, 2) - 1).bit_length() + 1) // 2)
    mask = np.uint64((1 << half) - 1)
    keys = [np.uint64(zlib.crc32(f"{key}:{r}".encode()) * 0x9E3779B97F4A7C15 & (1 << 64) - 1) for r in range(ROUNDS)]

    def turn(x: np.ndarray, k: np.uint64) -> np.ndarray:
        x = (x + k) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
        return (x ^ (x >> np.uint64(32))) & mask

    def once(x: np.ndarray) -> np.ndarray:
        left, right = x >> np.uint64(half), x & mask
        if inverse:
            for k in reversed(keys):
                left, right = right ^ turn(left, k), left
        else:
            for k in keys:
                left, right = right, left ^ turn(right, k)
        return left << np.uint64(half) | right

    out = once(np.asarray(index, np.uint64))
    while len(far := np.flatnonzero(out >= n)):
        out[far] = once(out[far])
    return out.astype(np.int64)


def _segments(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[tuple[tuple[str, int], int, int | None, list[int]]]:
    """((file, first row), row, doc_id, ids) of a task's rows; a new segment starts with each file, and where rows don't ascend."""
    enc = _encoding(path)
    key, last = ("", 0), -1
    for b in batches:
        for file, row, i, text in zip(*(b.column(c).to_pylist() for c in ("file", "row", "doc_id", "text")), strict=True):
            if file != key[0] or row <= last:
                key = (file, row)
            last = row
            yield key, row, i, enc.encode_ordinary(text or "")


def _addressed(docs: DataFrame) -> DataFrame:
    """doc_id, text and each row's file and number in it; fails if the rows don't come from files that tell."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))
    id_text(docs)
    return rows


def _sorted(docs: DataFrame) -> DataFrame:
    """The rows written in the order of doc_id and text, so that files and rows in them stand in that order."""
    keys = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text").asc()]
    return written(id_text(docs).repartitionByRange(*keys).sortWithinPartitions(*keys, "text"))


def _counted(rows: DataFrame, path: str) -> dict[tuple[str, int], tuple[int, int]] | None:
    """For each segment where it starts in the stream and its ids; None if segments of a file overlap. The driver receives a row for each segment."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[tuple[str, int], list[int]] = {}
        for key, row, _, ids in _segments(batches, path):
            of = seen.setdefault(key, [row, 0])
            of[0], of[1] = row, of[1] + len(ids) + 1
        columns = list(zip(*((f, first, last, n) for (f, first), (last, n) in seen.items()), strict=True)) or [()] * 4
        yield pa.record_batch({c: pa.array(x, k) for c, x, k in zip(("file", "first", "last", "n"), columns, (pa.string(), pa.int64(), pa.int64(), pa.int64()), strict=True)})

    found = sorted(tuple(r) for r in rows.mapInArrow(count, "file string, first long, last long, n long").collect())
    if any(a[0] == b[0] and a[2] >= b[1] for a, b in zip(found, found[1:], strict=False)):
        return None
    ends = np.cumsum([0, *(n for *_, n in found)]).tolist()
    return {(f, first): (at, n) for (f, first, _, n), at in zip(found, ends, strict=False)}


def materialise(docs: DataFrame, path: str, out: str, key: int = 0, end_id: int = 50256, sequence: int = SEQUENCE, per_shard: int = PER_SHARD, width: int = 2) -> DataFrame:
    """Writes the shards to the folder ``out`` (any address that pyarrow's file systems know) and returns one row per sequence.

    Columns: slot, shard, sequence (its number in input order), first_doc, last_doc, n_ids, ids_crc32
    (of the ids before padding). Ids take ``width`` bytes (ValueError if the vocabulary has wider ones); the last sequence of all
    is padded with ``end_id`` to the stride. Null and empty texts contribute an end id; null doc_ids are
    passed through; repeated rows are written each. No rows in: no shards, no rows out. If a second reading meets other
    rows than the first, the run fails.
    """
    if max(_encoding(path).max_token_value, end_id) >= 1 << 8 * width:
        raise ValueError(f"ids of {path} don't fit into {width} bytes")
    spark = docs.sparkSession
    try:
        rows = _addressed(docs)
        segments = _counted(rows, path)
    except AnalysisException:
        segments = None
    if segments is None:
        rows = _addressed(_sorted(docs))
        segments = _counted(rows, path)
    total = sum(n for _, n in segments.values())
    sequences = -(-total // sequence)
    shared = spark.sparkContext.broadcast(segments)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []  # (sequence, place in it, first doc, last doc, ids)
        now, at, end = None, 0, 0
        part, size, first, last = [], 0, None, None  # what is gathered for the sequence of the next id

        def cut() -> None:
            nonlocal part, size
            if size:
                start = at - size
                held.append((start // sequence, start % sequence, first, last, b"".join(part)))
            part, size = [], 0

        def check() -> None:
            if at != end:
                raise RuntimeError(f"the second reading of {now} met other rows than the first")

        for segment, _, doc, ids in _segments(batches, path):
            if segment != now:
                cut()
                check()
                if segment not in shared.value:
                    raise RuntimeError(f"the first reading did not meet {segment}")
                now, (at, n) = segment, shared.value[segment]
                end = at + n
            ids.append(end_id)
            raw, taken = np.array(array("I", ids)).astype(f"<u{width}").tobytes(), 0
            while taken < len(ids):
                if not size:
                    first = doc
                n = min(len(ids) - taken, sequence - at % sequence)
                part.append(raw[taken * width : (taken + n) * width])
                size, at, taken, last = size + n, at + n, taken + n, doc
                if at % sequence == 0:
                    cut()
            if len(held) >= 1024:
                yield _placed(held, sequences, key)
                held.clear()
        cut()
        check()
        if held:
            yield _placed(held, sequences, key)

    placed = rows.mapInArrow(place, "slot long, sequence long, place int, first_doc long, last_doc long, ids binary")
    shards = max(1, -(-sequences // per_shard))
    tasks = min(shards, int(spark.conf.get("spark.sql.shuffle.partitions")))
    ranged = placed.repartitionById(tasks, _range(per_shard, tasks, shards)).sortWithinPartitions("slot", "place")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs as files

        fs, top = files.FileSystem.from_uri(out)
        fs.create_dir(top, recursive=True)
        pad = np.full(sequence, end_id, f"<u{width}").tobytes()
        now, sink, name = None, None, ""
        told: list[tuple] = []

        def close() -> None:
            if sink is not None:
                sink.close()
                fs.move(name, f"{top}/{shard_name(now)}")

        for slot, parts in groupby(_rows(batches), key=lambda r: r[0]):
            if slot // per_shard != now:
                close()
                now = slot // per_shard
                name = f"{top}/.{shard_name(now)}.{uuid.uuid4().hex}"
                sink = fs.open_output_stream(name)
            parts = list(parts)
            ids = b"".join(p[5] for p in parts)
            sink.write(ids + pad[len(ids) :])
            told.append((slot, now, parts[0][1], parts[0][3], parts[-1][4], len(ids) // width, zlib.crc32(ids)))
            if len(told) == 4096:
                yield _told(told)
                told.clear()
        close()
        if told:
            yield _told(told)

    return written(ranged.mapInArrow(write, ROWS))


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for b in batches:
        yield from zip(*(c.to_pylist() for c in b.columns), strict=True)


def _told(rows: list[tuple]) -> pa.RecordBatch:
    fields = [f.split() for f in ROWS.split(", ")]
    return pa.record_batch({n: pa.array(c, pa.int32() if k == "int" else pa.int64()) for (n, k), c in zip(fields, zip(*rows, strict=True), strict=True)})


def _range(per_shard: int, tasks: int, shards: int) -> Column:
    return F.expr(f"int((slot div {per_shard}) * {tasks} div {shards})")


def _placed(held: list[tuple], sequences: int, key: int) -> pa.RecordBatch:
    index, at, first, last, ids = zip(*held, strict=True)
    index = np.array(index, np.int64)
    return pa.record_batch({
        "slot": pa.array(permute(index, sequences, key)), "sequence": pa.array(index), "place": pa.array(at, pa.int32()), "first_doc": pa.array(first, pa.int64()), "last_doc": pa.array(last, pa.int64()),
        "ids": pa.array(ids, pa.binary()),
    })


def shard_name(shard: int) -> str:
    return f"shard-{shard:08d}.bin"


def read_slots(out: str, start: int, stop: int, sequence: int = SEQUENCE, per_shard: int = PER_SHARD, width: int = 2) -> Iterator[np.ndarray]:
    """The sequences of slots start..stop-1 in training order, read by seeking into the shards."""
    from pyarrow import fs as files

    fs, top = files.FileSystem.from_uri(out)
    stride = sequence * width
    while start < stop:
        shard, row = divmod(start, per_shard)
        n = min(stop - start, per_shard - row)
        with fs.open_input_file(f"{top}/{shard_name(shard)}") as f:
            f.seek(row * stride)
            data = f.read(n * stride)
        yield from np.frombuffer(data, f"<u{width}").reshape(n, sequence)
        start += n


def default_folder(docs: DataFrame) -> str:
    """A new folder beside the checkpoints, as an address."""
    path = work_dir(docs.sparkSession)
    return path if "://" in path or path.startswith("file:") else f"file://{path}"
