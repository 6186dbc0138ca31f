"""Best-fit packing of token pieces into sequences, with certified bin counts.

Documents are tokenised where they are read; only lengths travel. Pieces are dealt by a hash of what they hold into
partitions of a bounded number of pieces, each packed by best-fit decreasing. Dual feasible
functions give a lower bound on the bins that a set of lengths needs: a partition whose count
equals its bound is certified. While the whole count is above the bound of all pieces together,
partitions exchange: each gives up its emptiest bins (more of them the wider its gap) and closes the others, the bins
given up by neighbouring partitions meet in one group, and best-fit decreasing runs again on their
pieces; a group that does not improve keeps its old bins. Each round merges ``fan`` partitions, so
rounds grow with the logarithm of the partitions and what travels shrinks with each. If a gap is left when all have met, the
emptiest bins of all are packed once more in ever larger groups of bounded size.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_text, written
from .tokens import encoder

CAPACITY = 2048
#: Pieces in a partition, partitions that meet in an exchange, bins that a partition gives up at least.
PART_PIECES, FAN, LOOSE = 20_000, 8, 4
#: Copies of one row that are dealt together at most; the emptiest bins of all that meet at the end, in turn, where a gap is left.
COPIES, WIDER = 256, (256, 1024, 4096)

KEYS = ("doc_id", "piece", "start", "length", "ids_crc32")
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
PACKED = PIECES + ", part long, sequence_id long, offset long, open boolean"


def token_pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = 0) -> DataFrame:
    """The pieces of each row's ids (its tokens, then ``end_id``), cut only beyond ``capacity``."""
    end = np.array([end_id], "<u4").tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, step = encoder(path), 4 * capacity
        for b in batches:
            doc, piece, length, crc = [], [], [], []
            for i, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True):
                ids = enc.text_ids(text or "") + end
                for k in range(0, len(ids), step):
                    part = ids[k : k + step]
                    doc.append(i)
                    piece.append(k // step)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
            n = pa.array(piece, pa.int32())
            yield pa.record_batch({"doc_id": pa.array(doc, pa.int64()), "piece": n, "start": pa.array(np.array(piece, np.int64) * capacity), "length": pa.array(length, pa.int64()), "ids_crc32": pa.array(crc, pa.int64())})
        enc.ids.clear()  # the worker stays while later stages need the executor's memory

    return id_text(docs).mapInArrow(cut, PIECES)


def lower_bound(counts: np.ndarray, capacity: int) -> int:
    """A certified least number of bins for ``counts[x]`` pieces of length x, by two families of dual feasible functions.

    For each t up to half the capacity: lengths above capacity - t count as full bins, those below t
    as nothing, others as they are. For each k up to 12: a length x counts (k+1)x/capacity rounded
    down, over k, of a bin, or exactly its share if that is whole.
    """
    x = np.arange(capacity + 1)
    size = counts * x
    below, above = np.concatenate(([0], np.cumsum(size))), np.concatenate(([0], np.cumsum(counts)))
    total = counts.sum()
    best = 0
    for t in range(capacity // 2 + 1):
        full = total - above[capacity - t + 1]
        rest = below[capacity - t + 1] - below[t]
        best = max(best, int(full + -(-rest // capacity)))
    for k in range(1, 13):
        units = np.where((k + 1) * x % capacity == 0, x * k, ((k + 1) * x // capacity) * capacity)  # in bins of k * capacity
        best = max(best, int(-(-(counts * units).sum() // (k * capacity))))
    return best


def best_fit(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Bin and offset of each piece, given in decreasing order, and the number of bins."""
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    open_bins: dict[int, list[int]] = {}
    rooms, n = 0, 0  # bit r of rooms: some bin has r places left
    for i, length in enumerate(lengths.tolist()):
        fits = rooms >> length
        if fits:
            room = length + (fits & -fits).bit_length() - 1
            same = open_bins[room]
            k = same.pop()
            if not same:
                rooms &= ~(1 << room)
        else:
            room, k = capacity, n
            n += 1
        bins[i], offsets[i] = k, capacity - room
        if left := room - length:
            open_bins.setdefault(left, []).append(k)
            rooms |= 1 << left
    return bins, offsets, n


def _pack(t: pa.Table, capacity: int, level: int) -> pa.Table:
    """Packs a group's pieces (``copies`` of each), or keeps their present bins unless fewer are found; ``open`` marks the emptiest bins, more of them the wider the gap to the group's bound."""
    if level:
        old = t.column("sequence_id").to_numpy()
    else:
        t = t.take(pa.array(np.repeat(np.arange(t.num_rows), t.column("copies").to_numpy()))).drop_columns(["copies"])
        old = np.arange(t.num_rows)
    order = t.select([*KEYS]).append_column("at", pa.array(np.arange(t.num_rows))).sort_by([("length", "descending"), *((k, "ascending") for k in KEYS if k != "length"), ("at", "ascending")]).column("at")
    t, old = t.take(order), old[order.to_numpy()]
    lengths = t.column("length").to_numpy()
    bins, offsets, n = best_fit(lengths, capacity)
    names, was = np.unique(old, return_inverse=True)
    if level and n >= len(names):
        bins, offsets, n = was, t.column("offset").to_numpy(), len(names)
    else:
        names = (level << 56 | t.column("part")[0].as_py() << 24) + np.arange(n)
    load = np.bincount(bins, weights=lengths, minlength=n)
    gap = n - lower_bound(np.bincount(lengths, minlength=capacity + 1), capacity)
    emptiest = np.lexsort((names, load))[: LOOSE + 4 * gap]
    loose = np.zeros(n, bool)
    loose[emptiest[load[emptiest] < capacity]] = True
    out = t.select([*KEYS, "part"])
    for name, values in (("sequence_id", names[bins]), ("offset", offsets), ("open", loose[bins])):
        out = out.append_column(name, pa.array(values))
    return out


def _packer(capacity: int, level: int) -> Callable[[pa.Table], pa.Table]:
    return lambda t: _pack(t, capacity, level)


def _bound(rows: DataFrame, capacity: int) -> int:
    """Gathers a histogram of at most ``capacity`` lengths."""
    counts = np.zeros(capacity + 1, np.int64)
    for r in rows.groupBy("length").count().collect():
        counts[r[0]] = r[1]
    return lower_bound(counts, capacity)


def _bins(packed: DataFrame) -> int:
    return packed.filter("offset = 0").count()


def pack(docs: DataFrame, path: str, capacity: int = CAPACITY, part_pieces: int = PART_PIECES, fan: int = FAN) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset, sequences, least_sequences.

    ``sequences`` is the number of all sequences and ``least_sequences`` a certified bound that no packing can go below: equal
    ones prove that there is no better. A null text counts as empty: one piece that holds the end id. Rows with a null doc_id and
    repeated rows are packed each for itself. Pieces are dealt and ordered by what they hold alone, so equal inputs give equal
    packings however they are partitioned. No rows in, no rows out.
    """
    pieces = written(token_pieces(docs, path, capacity))
    total, bound = pieces.count(), _bound(pieces, capacity)
    parts = max(1, -(-total // part_pieces))
    # Equal rows, however many, are counted, and dealt in chunks of up to COPIES; they become rows again where they are packed.
    equal = pieces.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("n")).select(*KEYS, "n", F.explode(F.expr(f"sequence(0, (n - 1) div {COPIES})")).alias("chunk"))
    dealt = equal.select(
        *KEYS, F.least(F.lit(COPIES), F.col("n") - F.col("chunk") * COPIES).alias("copies"),
        F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32", "chunk"), F.lit(parts)).alias("part"),
    )
    packed = written(dealt.groupBy("part").applyInArrow(_packer(capacity, 0), PACKED))
    closed, level = [], 0
    while parts > 1 and sum(_bins(c) for c in closed) + _bins(packed) > bound:
        level, parts = level + 1, -(-parts // fan)
        closed.append(packed.filter("not open"))
        again = packed.filter("open").withColumn("part", F.floor(F.col("part") / fan))
        packed = written(again.groupBy("part").applyInArrow(_packer(capacity, level), PACKED))
    packed = reduce(DataFrame.unionByName, closed, packed)
    bins = _bins(packed)
    for most in WIDER:
        if bins <= bound:
            break
        level += 1
        given, again = _reopened(packed, capacity, level, most)
        if (won := given.count() - _bins(again)) > 0:
            packed, bins = packed.join(given, "sequence_id", "left_anti").unionByName(again), bins - won
    return packed.drop("part", "open").withColumns({"sequences": F.lit(bins).cast("long"), "least_sequences": F.lit(bound).cast("long")})


def _reopened(packed: DataFrame, capacity: int, level: int, most: int) -> tuple[DataFrame, DataFrame]:
    """The names of the ``most`` emptiest bins of all, and their pieces packed anew in one group of bounded size."""
    loads = written(packed.groupBy("sequence_id").agg(F.sum("length").alias("load")).filter(F.col("load") < capacity))
    upto, seen = -1, 0
    for r in sorted(loads.groupBy("load").count().collect()):  # at most ``capacity`` rows
        if seen + r[1] > most:
            break
        upto, seen = r.load, seen + r[1]
    given = written(loads.filter(F.col("load") <= upto).select("sequence_id"))
    pieces = packed.join(F.broadcast(given), "sequence_id").withColumn("part", F.lit(0).cast("long"))
    return given, written(pieces.groupBy("part").applyInArrow(_packer(capacity, level), PACKED))
