"""Benchmark decontamination by SimHash windows.

Documents are cut into overlapping windows about the size of the benchmark items (a few window
sizes in geometric steps, strides of a sixth). A window's 128-bit SimHash takes the majority of the
hash bits of its words of four bytes or more; sums over runs of 1, 2, 4, ... words make those of any window. The fingerprints
are looked up in a multi-index: eight 16-bit blocks, each with all values within three flips of an
item's block. Two fingerprints at most ``RADIUS`` = 31 apart differ by three or less in some block,
so no pair within the radius is missed. Candidates are aligned with the item and verified by the
exact weighted similarity of word shingles (a shingle weighs its words' bytes).

Windows alone don't see all passages: a window that is shifted or holds foreign, repeated words may lie
outside the radius, and words that don't count leave no print. So documents and items are paired by
shingles first. A passage that is similar enough lacks less than a share of 1 - ``similarity`` of the
item's weight; it shares one of any shingles that weigh more than that, and of each item the rarest
such ones are looked up at every word. Documents without any can't match and are passed over. In the
others windows are searched, and pairs that no window shows in full are swept over all passages.

The benchmark goes to all workers in parts of at most ``PART_ITEMS`` items and ``PART_BYTES`` bytes
of text, one pass over the documents each; documents never shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_bytes
from .shingles import hashed_words, mixed, rolled

BITS, BLOCKS, FLIPS = 128, 8, 3
RADIUS = BLOCKS * (FLIPS + 1) - 1
#: Ratio of neighbouring window sizes, strides in a window, bytes of a word that counts, words handled at once.
STEP, STRIDES, COUNTED, AT_ONCE = 1.2, 6, 4, 16_384
PART_ITEMS, PART_BYTES = 4096, 16 << 20

MATCHES = "doc_id long, item_id long, start_word long, n_words long, distance int, similarity double"

_SALT = np.uint64(0x7F4A7C159E3779B9)
_BALL = np.array([sum(1 << i for i in c) for n in range(FLIPS + 1) for c in combinations(range(16), n)], np.uint16)


def _bits(h: np.ndarray) -> np.ndarray:
    """The 128 feature bits of each word hash."""
    return np.unpackbits(np.stack((h, mixed(h ^ _SALT)), axis=1).view(np.uint8), axis=1)


def simhash(h: np.ndarray, counted: np.ndarray) -> np.ndarray:
    """The fingerprint of one word sequence, as two 64-bit integers."""
    return np.packbits(_bits(h[counted]).sum(axis=0, dtype=np.int64) > np.count_nonzero(counted) // 2).view(np.uint64)


def _shingled(h: np.ndarray, sizes: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles in order and their weights; fewer words than ``words`` are one shingle."""
    k = min(words, len(h))
    sums = np.concatenate(([0], np.cumsum(sizes)))
    return rolled(h, k), sums[k:] - sums[:-k]


class Item:
    def __init__(self, item_id: int | None, h: np.ndarray, sizes: np.ndarray, shingle: int):
        self.id, self.n = item_id, len(h)
        self.print = simhash(h, sizes >= COUNTED)
        self.run, weights = _shingled(h, sizes, shingle)
        self.set, first = np.unique(self.run, return_index=True)
        self.weight, self.first = weights[first], first
        self.total = int(self.weight.sum())


class Index:
    """Items by window size, with a table for each block of the fingerprint: bit i of an entry stands for the i-th item of a group of 64."""

    def __init__(self, items: list[tuple[int | None, bytes]], shingle: int, similarity: float = 0.8):
        self.shingle = shingle
        hashed = hashed_words(raw for _, raw in items)
        made = [Item(i, h, sizes, shingle) for (i, _), (h, sizes) in zip(items, hashed, strict=True) if len(h)]
        by: dict[int, list[Item]] = {}
        for item in made:
            size = max(1, round(STEP ** round(np.log(item.n) / np.log(STEP))))
            by.setdefault(size, []).append(item)
        self.groups = []
        for size, same in sorted(by.items()):
            for at in range(0, len(same), 64):
                group = same[at : at + 64]
                tables = np.zeros((BLOCKS, 65536), np.uint64)
                for i, item in enumerate(group):
                    for b, value in enumerate(item.print.view(np.uint16)):
                        tables[b, _BALL ^ value] |= np.uint64(1 << i)
                self.groups.append((size, group, np.array([x.print for x in group]), tables))
        self.longest, self.widest = max((x.n for x in made), default=0), max(by, default=0)
        self.items = made
        self.anchors = [self._anchored(k, similarity) for k in sorted({min(shingle, x.n) for x in made})]

    def _anchored(self, k: int, similarity: float) -> tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """For items with shingles of k words: k, looked-up shingles in order, a bit map of their upper bits, where each one's items start, and these."""
        own = [(i, x) for i, x in enumerate(self.items) if min(self.shingle, x.n) == k]
        values, common = np.unique(np.concatenate([x.set for _, x in own]), return_counts=True)
        picked, owners = [], []
        for i, x in own:
            order = np.lexsort((x.set, common[np.searchsorted(values, x.set)]))
            enough = np.cumsum(x.weight[order]) > (1 - similarity) * x.total * (1 + 1e-9)
            picked.append(x.set[order[: int(np.argmax(enough)) + 1 if enough.any() else None]])
            owners.append(np.full(len(picked[-1]), i))
        shingles, owner = np.concatenate(picked), np.concatenate(owners)
        order = np.lexsort((owner, shingles))
        keys, starts = np.unique(shingles[order], return_index=True)
        bits = min(24, max(16, (16 * len(keys)).bit_length()))
        seen = np.zeros(1 << bits, bool)
        seen[keys >> np.uint64(64 - bits)] = True
        return k, keys, seen, np.append(starts, len(order)), owner[order]

    def pairs(self, texts: list[np.ndarray]) -> dict[int, list[Item]]:
        """For each text (by its place) the items that a passage of it may be similar enough to."""
        h, ends = np.concatenate(texts), np.cumsum([len(x) for x in texts])
        out: dict[int, set[int]] = {}
        for k, keys, seen, bounds, owner in self.anchors:
            if len(h) < k:
                continue
            run = rolled(h, k)
            at = np.flatnonzero(seen[run >> np.uint64(64 - len(seen).bit_length() + 1)])
            key = np.minimum(np.searchsorted(keys, run[at]), len(keys) - 1)
            text = np.searchsorted(ends, at, side="right")
            hit = (keys[key] == run[at]) & (at + k <= ends[text])
            for t, x in np.unique(np.stack((text[hit], key[hit]), axis=1), axis=0).tolist():
                out.setdefault(t, set()).update(owner[bounds[x] : bounds[x + 1]].tolist())
        return {t: [self.items[i] for i in sorted(found)] for t, found in sorted(out.items())}

    def search(self, h: np.ndarray, counted: np.ndarray, offset: np.ndarray, left: np.ndarray) -> Iterator[tuple[int, int, Item, int]]:
        """(start, end, item, distance) of windows within the radius. offset, left: words of the same document before and from each place."""
        features = _bits(h)
        features[~counted] = 0
        runs = [features if self.widest < 256 else features.astype(np.uint32)]  # runs[k]: sums over 2^k words from each place
        while 2 << len(runs) - 1 <= min(self.widest, len(h)):
            k = 1 << len(runs) - 1
            runs.append(runs[-1][:-k] + runs[-1][k:])
        place = np.concatenate(([0], np.cumsum(counted)))
        done = None
        for size, group, item_prints, tables in self.groups:
            if done != size:
                stride, done = max(1, size // STRIDES), size
                starts = np.flatnonzero((left >= size) & ((offset % stride == 0) | (left == size)))
                sums, at = np.zeros((len(starts), BITS), runs[0].dtype), starts
                for k in range(size.bit_length()):
                    if size >> k & 1 and len(starts):
                        sums += np.take(runs[k], at, axis=0)
                        at = at + (1 << k)
                half = ((place[starts + size] - place[starts]) >> 1).astype(sums.dtype)
                prints = np.packbits(sums > half[:, None], axis=1).view(np.uint64)
                ends = starts + size
                short = np.flatnonzero((offset == 0) & (left < size) & (left * 10 >= size * 6))  # documents that are shorter than the window
                if len(short):
                    starts, ends = np.concatenate((starts, short)), np.concatenate((ends, short + left[short]))
                    prints = np.concatenate((prints, [simhash(h[a : a + left[a]], counted[a : a + left[a]]) for a in short]))
                blocks = prints.view(np.uint16).T.astype(np.intp)
            near = np.take(tables[0], blocks[0])
            for b in range(1, BLOCKS):
                near |= np.take(tables[b], blocks[b])
            some = np.flatnonzero(near)
            row, i = np.nonzero(np.unpackbits(near[some].view(np.uint8).reshape(-1, 8), axis=1, count=len(group), bitorder="little"))
            row = some[row]
            far = np.bitwise_count(prints[row] ^ item_prints[i]).sum(axis=1, dtype=np.int64)
            for k in np.flatnonzero(far <= RADIUS).tolist():
                yield int(starts[row[k]]), int(ends[row[k]]), group[i[k]], int(far[k])

    def verify(self, h: np.ndarray, sizes: np.ndarray, start: int, end: int, item: Item) -> tuple[float, int, int]:
        """The best weighted similarity of the item and a passage about the window, and the passage's place.

        Tried are the passage from the first to the last shared shingle and the item-sized one on the
        diagonal that most shared shingles lie on.
        """
        slack = item.n // 2 + self.shingle
        lo, hi = max(0, start - slack), min(len(h), end + slack)
        if hi - lo < min(self.shingle, item.n):
            return 0.0, lo, hi
        k = min(self.shingle, item.n)
        sums = np.concatenate(([0], np.cumsum(sizes[lo:hi])))
        run, weights = rolled(h[lo:hi], k), sums[k:] - sums[:-k]
        at = np.minimum(np.searchsorted(item.set, run), len(item.set) - 1)
        hit = np.flatnonzero(item.set[at] == run)
        if not len(hit):
            return 0.0, lo, hi
        lines, votes = np.unique(hit - item.first[at[hit]], return_counts=True)
        line = int(lines[np.argmax(votes)])
        best = (0.0, lo, hi)
        for a, b in ((int(hit[0]), int(hit[-1]) + 1), (max(0, line), min(len(run), max(1, line + item.n - k + 1)))):
            if a < b:
                mine, first = np.unique(run[a:b], return_index=True)
                own = weights[a:b][first]
                both = own[np.isin(mine, item.set, assume_unique=True)].sum()
                best = max(best, (float(both / (own.sum() + item.total - both)), lo + a, lo + b + k - 1), key=lambda x: x[0])
        return best

    def best(self, h: np.ndarray, sizes: np.ndarray, item: Item, similarity: float) -> tuple[float, int, int]:
        """The greatest similarity of the item and any passage, and the passage's place (a verbatim one, else the first); 0 below ``similarity``.

        A best passage starts and ends with shared shingles. The shortest one's first shingle stands in it but
        once, which bounds the passages tried to the item's shingles times the text's words.
        """
        k = min(self.shingle, item.n)
        run, weights = _shingled(h, sizes, k)
        code = np.minimum(np.searchsorted(item.set, run), len(item.set) - 1)
        shared = item.set[code] == run
        hit = np.flatnonzero(shared)
        if item.weight[np.unique(code[hit])].sum() < similarity * item.total:
            return 0.0, 0, 0
        for a in hit[run[hit] == item.run[0]].tolist():
            if np.array_equal(run[a : a + len(item.run)], item.run):
                return 1.0, a, a + item.n
        _, label = np.unique(run, return_inverse=True)
        label, weight, is_shared = label.tolist(), weights.tolist(), shared.tolist()
        found, rest, seen = (0.0, 0, 0), 0, set()
        left: dict[int, int] = {}  # start: weight of the item's shingles from there on
        for a in hit[::-1].tolist():
            if label[a] not in seen:
                seen.add(label[a])
                rest += weight[a]
            left[a] = rest
        for a in hit.tolist():
            if left[a] < similarity * item.total:
                break
            seen, own, both = set(), 0, 0
            for b in range(a, len(label)):
                if b > a and label[b] == label[a]:
                    break
                if label[b] not in seen:
                    seen.add(label[b])
                    own += weight[b]
                    both += weight[b] * is_shared[b]
                    if own * similarity > item.total * (1 + 1e-9):
                        break
                    if is_shared[b] and (score := both / (own + item.total - both)) > found[0]:
                        found = score, a, b + k
        return found if found[0] >= similarity else (0.0, 0, 0)


def _scan(raws: list[bytes | None], index: Index, similarity: float) -> Iterator[tuple[int, Item, int, int, int, float]]:
    """(row, item, start, words, distance, similarity): the best match of each row and item."""
    best: dict[tuple[int, int], tuple] = {}
    pending: list[tuple[int, int, np.ndarray, np.ndarray]] = []  # row, first word, hashes, sizes
    texts: list[tuple[int, np.ndarray, np.ndarray]] = []  # row, hashes, sizes
    likely: dict[int, dict[int, Item]] = {}  # the items that a row is paired with

    def keep(row: int, score: float, start: int, n: int, d: int, item: Item) -> None:
        got = (-score, start, n, d, item)
        if (key := (row, id(item))) not in best or got[:4] < best[key][:4]:
            best[key] = got

    def flush() -> None:
        lengths = [len(part) for _, _, part, _ in pending]
        if not sum(lengths) or not index.groups:
            return
        h, sizes = np.concatenate([x for _, _, x, _ in pending]), np.concatenate([x for *_, x in pending])
        ends = np.cumsum(lengths)
        offset = np.arange(len(h)) - np.repeat(ends - lengths, lengths)
        left = np.repeat(lengths, lengths) - offset
        for start, end, item, d in index.search(h, sizes >= COUNTED, offset, left):
            p = int(np.searchsorted(ends, start, side="right"))
            row, at = pending[p][:2]
            if id(item) not in likely[row]:
                continue
            base = int(ends[p]) - lengths[p]
            score, a, b = index.verify(h[base : ends[p]], sizes[base : ends[p]], start - base, end - base, item)
            if score >= similarity:
                keep(row, score, at + a, b - a, d, item)

    def paired() -> None:
        found = index.pairs([h for _, h, _ in texts]) if texts else {}
        held, lap = 0, 2 * index.longest + 2 * index.shingle
        for t, items in found.items():
            row, h, sizes = texts[t]
            likely[row] = {id(x): x for x in items}
            for at in range(0, len(h), AT_ONCE):
                part = slice(at, at + AT_ONCE + lap)  # a cut passage lies whole in the part before
                pending.append((row, at, h[part], sizes[part]))
                held += len(h[part])
                if held >= AT_ONCE:
                    flush()
                    pending.clear()
                    held = 0
        flush()
        pending.clear()
        for t, items in found.items():
            row, h, sizes = texts[t]
            for item in items:
                if best.get((row, id(item)), (0.0,))[0] > -1:
                    score, a, b = index.best(h, sizes, item, similarity)
                    if score:
                        own = simhash(h[a:b], sizes[a:b] >= COUNTED)
                        keep(row, score, a, b - a, int(np.bitwise_count(own ^ item.print).sum()), item)
        texts.clear()
        likely.clear()

    words = 0
    for row, (h, sizes) in enumerate(hashed_words(raws)):
        texts.append((row, h, sizes))
        words += len(h)
        if words >= AT_ONCE:
            paired()
            words = 0
    paired()
    for (row, _), (score, start, n, d, item) in sorted(best.items(), key=lambda x: (x[0][0], x[1][1], -1 if x[1][4].id is None else x[1][4].id)):
        yield row, item, start, n, d, -score


def decontaminate(docs: DataFrame, benchmark: DataFrame, words: int = 5, similarity: float = 0.8) -> DataFrame:
    """One row per document row and benchmark item whose passage it holds: doc_id, item_id, start_word, n_words, distance, similarity.

    Words are runs between blanks with A-Z in lower case. A match is a passage whose weighted Jaccard
    similarity of distinct ``words``-word shingles with the item is at least ``similarity``, and every
    row and item with such a passage is told, with the best one. ``distance`` is that of the fingerprints of the item and
    of the window that showed the passage, or of the passage itself where no window did; only the latter may exceed ``RADIUS``. Items of fewer words than ``words`` are one
    shingle: they match as they stand. Null or blank texts and items match nothing. Equal items are
    told each. Null ids are passed through; repeated rows are told each.
    """
    spark = docs.sparkSession
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").cast("binary").alias("raw")).filter("raw is not null")
    size = items.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.length("raw")), F.lit(0))).first()
    parts = max(1, -(-size[0] // (PART_ITEMS // 2)), -(-size[1] // (PART_BYTES // 2)))
    found = []
    for p in range(parts):
        rows = items.filter(F.pmod(F.xxhash64("item_id", "raw"), F.lit(parts)) == p).orderBy("item_id", "raw")
        found.append(_matches(docs, spark.sparkContext.broadcast([(r[0], bytes(r[1])) for r in rows.collect()]), words, similarity))
    return reduce(DataFrame.unionAll, found)


def _matches(docs: DataFrame, shared, words: int, similarity: float) -> DataFrame:
    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(shared.value, words, similarity)
        for b in batches:
            ids = b.column("doc_id").to_pylist()
            got = [(ids[row], item.id, start, n, d, s) for row, item, start, n, d, s in _scan(b.column("raw").to_pylist(), index, similarity)]
            columns = list(zip(*got, strict=True)) if got else [[]] * 6
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.float64())
            yield pa.record_batch({f.split()[0]: pa.array(c, k) for f, c, k in zip(MATCHES.split(", "), columns, kinds, strict=True)})

    return id_bytes(docs).mapInArrow(match, MATCHES)
