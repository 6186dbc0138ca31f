"""Near-duplicate detection from bottom-k sketches of one hash function.

1. Each document's distinct word shingles are hashed; its sketch is the ``K`` least hashes. Equal
   sets become one class, so copies are never compared.
2. Inverted lists. Two sets with Jaccard similarity of ``percent`` or more share, but for a chance
   of about 1e-5, ``LEAST_SHARE`` of the values of the longer sketch. By the prefix principle it is
   enough to index, of each sketch, its rarest ``size - least + 1`` values: lists of passages that
   many documents share stay out unless a document mostly consists of such passages.
3. In each list the member whose values are the most common (the likely original of a group of
   copies) is the hub. Members are compared with their hubs: the pair passes a bound on the shared
   values from 256-bit maps, then the estimate from the sketch of the union, then the exact
   similarity of the full sets. What links joins one component.
4. A linked pair of two components has a hub in common. Of the members of hubs of several components, the
   prefix principle on the full sets finds those that may be linked with another component at all: of each set, its shingles ordered from the
   rarest, only so many are looked up that a linked set must share one. Shingles of passages that
   many documents share come last in that order, so such documents drop out. The rest of a hub's members is dealt into blocks of
   bounded size, those of one great component into blocks of their own, and every two blocks meet in a task that
   compares full sets exactly and returns the links that join components. Blocks of the same component don't meet. What remains
   quadratic, in units of blocks, is a crowd of sets of one origin that share nearly enough with each other and still aren't linked.
5. Full sets are computed again from the texts of the documents concerned.

Nothing is capped. Values, hubs, shingles and classes that hold a great share of the rows are joined as ``skew`` says.
The only thing that the driver gathers is a bit map of at most 2^``MAP_BITS`` bits that tells which
documents' sets are needed; wrong hits cost work, never results. Where more documents are needed than it can tell apart, texts are
joined with their ids instead.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import id_bytes, written
from .components import components
from .shingles import hashed_words, shingle_set
from .skew import join_keyed, join_wide

K = 64
#: Shares of a sketch that a linked pair has in common at least (4.4 and 4 standard deviations below 0.8 for K = 64).
LEAST_SHARE, LEAST_ESTIMATE = 0.575, 0.6
#: Members and shingles of a block, and columns of a task's matrix at once.
BLOCK, BLOCK_SHINGLES, COLUMNS = 256, 100_000, 8192
#: Bits (as a power of two) of the map of needed documents, for each of which it has ``SPARSE`` bits; bits of a chunk of it.
MAP_BITS, SPARSE, CHUNK = 27, 16, 32768
MAPS = ["m0", "m1", "m2", "m3"]


def signatures(docs: DataFrame, words: int, k: int = K) -> DataFrame:
    """doc_id, n (set size), key (128-bit digest of the set; null if empty), sketch and its 256-bit map; one row per input row."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, key, sketch, maps = [], [], [], np.zeros((b.num_rows, 4), np.int64)
            for i, (h, _) in enumerate(hashed_words(b.column("raw").to_pylist())):
                s = shingle_set(h, words)
                n.append(len(s))
                key.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                low = s[:k]
                sketch.append(low.view(np.int64))
                bits = np.zeros(256, np.uint8)
                bits[(low & np.uint64(255)).astype(np.int64)] = 1
                maps[i] = np.packbits(bits, bitorder="little").view("<i8")
            ends = np.cumsum([0, *map(len, sketch)])
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([*sketch, np.empty(0, np.int64)])))
            yield pa.record_batch({"doc_id": b.column("doc_id"), "n": pa.array(n, pa.int64()), "key": pa.array(key, pa.binary()), "sketch": lists, **{m: pa.array(maps[:, j].copy()) for j, m in enumerate(MAPS)}})

    return id_bytes(docs).mapInArrow(sign, "doc_id long, n long, key binary, sketch array<long>, " + ", ".join(f"{m} long" for m in MAPS))


def _least(size: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(size * LEAST_SHARE))


def inverted_lists(classes: DataFrame, k: int = K) -> DataFrame:
    """value, node, n, maps, score: of each class the rarest values that it shares with others, as many as the prefix principle asks for."""
    postings = classes.select("node", F.explode("sketch").alias("value"))
    shared = written(postings.groupBy("value").agg(F.count(F.lit(1)).alias("rows")).filter("rows > 1").withColumn("df", F.col("rows")))
    total = classes.agg(F.coalesce(F.sum(F.size("sketch")), F.lit(0))).first()[0]
    found = join_keyed(postings, shared, "value", "rows", total)
    own, rare = Window.partitionBy("node"), Window.partitionBy("node").orderBy("df", "value")
    ranked = found.select("node", "value", F.row_number().over(rare).alias("rank"), F.count(F.lit(1)).over(own).alias("of"), F.avg("df").over(own).alias("score"))
    joined = ranked.join(classes.select("node", "n", *MAPS), "node")
    return joined.filter(F.col("rank") <= F.col("of") - _least(F.least(F.col("n"), F.lit(k))) + 1).select("value", "node", "n", "score", *MAPS)


def _may_link(a: str, b: str, percent: int, k: int) -> Column:
    """Bounds that every linked pair meets: set sizes, and the shared values as far as the bit maps tell."""
    col = lambda side, name: F.col(f"{side}{name}")
    sizes = F.least(col(a, "n"), col(b, "n")) * 100 >= F.greatest(col(a, "n"), col(b, "n")) * percent
    both = sum((F.bit_count(col(a, m).bitwiseAND(col(b, m))) for m in MAPS), F.lit(0))
    own = sum((F.bit_count(col(a, m)) for m in MAPS), F.lit(0))
    sketch = lambda side: F.least(col(side, "n"), F.lit(k))
    return sizes & (both + sketch(a) - own >= _least(F.greatest(sketch(a), sketch(b))))


def _estimated(pairs: DataFrame, classes: DataFrame, total: int) -> DataFrame:
    """Pairs (a, b) whose similarity, estimated from the bottom-k of the union, is not clearly too small."""
    sketches = classes.select("node", "sketch")
    joined = join_wide(pairs.join(sketches.toDF("a", "sa"), "a"), sketches.toDF("b", "sb"), "b", "a", total)

    def estimate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("sa"), batch.column("sb"), strict=True):
                x, y = x.values.to_numpy().view(np.uint64), y.values.to_numpy().view(np.uint64)
                values, counts = np.unique(np.concatenate((x, y)), return_counts=True)
                keep.append(np.mean(counts[: max(len(x), len(y))] == 2) >= LEAST_ESTIMATE)
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return joined.select("a", "b", "sa", "sb").mapInArrow(estimate, "a long, b long")


def _needed_sets(docs: DataFrame, ids: DataFrame, words: int) -> DataFrame:
    """node, s: the full sets of (at least) the documents in ``ids`` (node, each once), computed again from their texts."""
    rows = id_bytes(docs).filter("doc_id is not null")
    bits = max(20, (SPARSE * ids.count()).bit_length())
    shared = None
    if bits <= MAP_BITS:
        place = lambda c: F.pmod(F.xxhash64(c), F.lit(1 << bits))
        chunks = ids.select(place("node").alias("at")).groupBy(F.expr(f"int(at div {CHUNK})").alias("c")).agg(F.bitmap_construct_agg(F.col("at") % CHUNK).alias("bits")).collect()
        bitmap = np.zeros((1 << bits) // 8, np.uint8)
        for r in chunks:
            bitmap[r.c * CHUNK // 8 : (r.c + 1) * CHUNK // 8] = np.frombuffer(r.bits, np.uint8)
        shared = docs.sparkSession.sparkContext.broadcast(bitmap)
        rows = rows.withColumn("at", place("doc_id"))
    else:
        rows = rows.join(ids.select(F.col("node").alias("doc_id")), "doc_id", "left_semi")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if shared is not None:
                at = b.column("at").to_numpy()
                b = b.filter(pa.array((shared.value[at >> 3] >> (at & 7) & 1).astype(bool)))
            if b.num_rows:
                made = [shingle_set(h, words).view(np.int64) for h, _ in hashed_words(b.column("raw").to_pylist())]
                lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, made)]), pa.int32()), pa.array(np.concatenate(made)))
                yield pa.record_batch({"node": b.column("doc_id"), "s": lists})

    return rows.mapInArrow(sets, "node long, s array<long>")


def _verified(pairs: DataFrame, docs: DataFrame, words: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets have the similarity."""
    total = pairs.count()
    sets = written(_needed_sets(docs, pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), words))
    # A document's set stands under its id; a row that repeats an id has another one, or an equal one.
    joined = join_wide(join_wide(pairs, sets.toDF("a", "sa"), "a", "b", total), sets.toDF("b", "sb"), "b", "a", total)
    common = joined.select("a", "b", F.size("sa").alias("x"), F.size("sb").alias("y"), F.size(F.array_intersect("sa", "sb")).alias("c"))
    return common.filter(F.col("c") * 100 >= (F.col("x") + F.col("y") - F.col("c")) * percent).select("a", "b").distinct()


def candidates(apart: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """node: those of ``apart`` (node, n, label; a row for each node) that may be linked with one of another label, and all that are.

    Shingles are ordered by the number of sets that hold them. Of two linked sets, the longer shares one of its first
    n - ceil(t n) + 1 with the first m - ceil(2t / (1 + t) m) + 1 of the shorter one, where t = percent / 100.
    """
    postings = sets.select("node", "n", "label", F.explode("s").alias("value"))
    shared = written(postings.groupBy("value").agg(F.count(F.lit(1)).alias("rows")).filter("rows > 1"))
    told = shared.select("value", "rows", F.col("rows").alias("df"))
    found = join_keyed(postings, told, "value", "rows", apart.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0])
    own, rare = Window.partitionBy("node"), Window.partitionBy("node").orderBy("df", "value")
    placed = found.select("node", "n", "label", "value", (F.col("n") - F.count(F.lit(1)).over(own) + F.row_number().over(rare)).alias("place"))  # shingles of no other set come first
    longer = F.expr(f"place <= n - (({percent} * n + 99) div 100) + 1")
    shorter = F.expr(f"place <= n - ((2 * {percent} * n + {99 + percent}) div {100 + percent}) + 1")
    entries = written(placed.filter(longer).select("value", "node", "label", shorter.alias("short")))
    all_, short = ({f"{end}{name}": f(F.when(F.col("short") | F.lit(name == "_all"), F.col("label"))) for end, f in (("lo", F.min), ("hi", F.max))} for name in ("_all", "_short"))
    lists = entries.groupBy("value").agg(F.count(F.lit(1)).alias("rows"), *(c.alias(k) for k, c in (all_ | short).items())).filter("lo_all <> hi_all and lo_short is not null")
    met = join_keyed(entries, written(lists), "value", "rows", entries.count())
    # As the longer set of a pair: some short prefix has another label; as the shorter one: some prefix has.
    return met.filter("lo_short <> label or hi_short <> label or (short and (lo_all <> label or hi_all <> label))").select("node").distinct()


def _blocks(members: DataFrame) -> DataFrame:
    """hub, i, j, node, label: the members of each hub of several components, for every two blocks that must meet.

    A component with a block's worth of members has blocks of its own (``pure``); the others share some.
    """
    groups = members.groupBy("hub", "label").agg(F.count(F.lit(1)).alias("m"), F.sum("n").alias("size"))
    parts = written(groups.withColumn("parts", F.ceil(F.greatest(F.col("m") / BLOCK, F.col("size") / BLOCK_SHINGLES)).cast("int")))
    small = F.col("parts") == 1
    pools = F.ceil(F.greatest(F.sum(F.when(small, F.col("m"))) / BLOCK, F.sum(F.when(small, F.col("size"))) / BLOCK_SHINGLES)).cast("int")
    several = written(parts.groupBy("hub").agg(F.count(F.lit(1)).alias("rows"), pools.alias("pools")).filter("rows > 1"))
    of = F.struct("hub", "label").alias("of")
    known = written(join_keyed(parts, several, "hub", "rows", parts.count()).select(of, "m", "parts", "pools"))
    dealt = join_keyed(members.select("hub", "node", "label", of), known, "of", "m", members.count())
    pure = F.when(F.col("parts") > 1, F.col("label"))
    own, shared = F.xxhash64("label", F.pmod(F.xxhash64("node"), F.col("parts"))), F.xxhash64(F.lit("pool"), F.pmod(F.xxhash64("label"), F.col("pools")))
    dealt = written(dealt.select("hub", "node", "label", pure.alias("pure"), F.when(F.col("parts") > 1, own).otherwise(shared).alias("block")))
    blocks = dealt.select("hub", "block", "pure").distinct()
    x, y = blocks.alias("x"), blocks.alias("y")
    meet = (F.col("x.hub") == F.col("y.hub")) & (F.col("x.block") <= F.col("y.block")) & ~F.coalesce(F.col("x.pure") == F.col("y.pure"), F.lit(False))
    tasks = x.join(y, meet).select(F.col("x.hub").alias("hub"), F.col("x.block").alias("i"), F.col("y.block").alias("j"))
    sides = tasks.select("hub", "i", "j", F.explode(F.array_distinct(F.array("i", "j"))).alias("block"))
    return dealt.drop("pure").join(sides, ["hub", "block"]).select("hub", "i", "j", "node", "label")


def _joins(t: pa.Table, percent: int) -> pa.Table:
    """Label pairs (a, b) that the links among a task's members join, no more than make a forest."""
    labels = t.column("label").to_numpy()
    s = t.column("s").combine_chunks()
    sizes = np.diff(s.offsets.to_numpy())
    values, owner = s.flatten().to_numpy(), np.repeat(np.arange(len(sizes)), sizes)
    _, column, counts = np.unique(values, return_inverse=True, return_counts=True)
    again = counts[column] > 1
    _, column = np.unique(column[again], return_inverse=True)
    owner = owner[again]
    order = np.argsort(column, kind="stable")
    column, owner = column[order], owner[order]
    common = np.zeros((len(sizes), len(sizes)), np.float32)  # counts below 2^24 are exact
    for lo in range(0, int(column[-1]) + 1 if len(column) else 0, COLUMNS):
        a, b = np.searchsorted(column, (lo, lo + COLUMNS))
        x = np.zeros((len(sizes), COLUMNS), np.float32)
        x[owner[a:b], column[a:b] - lo] = 1
        common += x @ x.T
    total = sizes[:, None] + sizes[None, :]
    linked = (common * 100 >= (total - common) * percent) & (labels[:, None] < labels[None, :])
    parent: dict[int, int] = {}
    out = []
    for p, q in set(zip(*(labels[k].tolist() for k in np.nonzero(linked | linked.T)), strict=True)):
        a, b = _root(parent, p), _root(parent, q)
        if a != b:
            parent[max(a, b)] = min(a, b)
            out.append((p, q))
    return pa.table({"a": pa.array([x for x, _ in out], pa.int64()), "b": pa.array([x for _, x in out], pa.int64())})


def _root(parent: dict[int, int], x: int) -> int:
    while x in parent:
        x = parent[x]
    return x


def near_dedup(docs: DataFrame, words: int = 5, percent: int = 80, k: int = K) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id, kept.

    Words are runs between blanks with A-Z in lower case; documents link if 100 * intersection >=
    percent * union of their sets of ``words``-word shingles (all words as one if there are fewer).
    Null or blank texts have an empty set and link with nothing, not even with each other.
    component_id is the least id that a row's set is connected with; kept tells whether it is the
    row's own. Rows with a null id do not link: their component_id is null and they are kept. Rows
    that repeat an id are treated each by its text. No rows in, no rows out.
    """
    signed = written(signatures(docs, words, k))
    whole = ["key", "n", "sketch", *MAPS]
    classes = written(signed.filter("n > 0 and doc_id is not null").groupBy(*whole).agg(F.min("doc_id").alias("node"), F.count(F.lit(1)).alias("copies")))
    lists = written(inverted_lists(classes, k))

    # Each member against its lists' hubs.
    hub = F.max(F.struct("score", (-F.col("node")).alias("minus"), "n", *MAPS)).alias("h")
    found = lists.groupBy("value").agg(hub, F.count(F.lit(1)).alias("rows")).filter("rows > 1")
    hubs = written(found.select("value", "rows", (-F.col("h.minus")).alias("hub"), *(F.col(f"h.{c}").alias(f"hub_{c}") for c in ("n", *MAPS))))
    under = join_keyed(lists, hubs, "value", "rows", lists.count())
    members = written(under.select("node", "hub", "n", _may_link("", "hub_", percent, k).alias("may")).distinct())
    first = members.filter("may and node <> hub").select(F.col("node").alias("a"), F.col("hub").alias("b"))
    linked = _verified(written(_estimated(first, classes, first.count())), docs, words, percent)
    joint = written(components(linked))

    # What is still apart under one hub: only members that may be linked with another component meet.
    labelled = written(members.join(joint, "node", "left").select("hub", "node", "n", F.coalesce("label", "node").alias("label")))
    several = labelled.groupBy("hub").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.count(F.lit(1)).alias("rows")).filter("lo <> hi").select("hub", "rows")
    under_several = written(join_keyed(labelled, written(several), "hub", "rows", labelled.count()))
    apart = written(under_several.select("node", "n", "label").distinct())
    sets = written(_needed_sets(docs, apart.select("node"), words).join(apart, "node"))
    may = written(candidates(apart, sets, percent))
    tasks = _blocks(written(under_several.join(may, "node")))
    between = tasks.join(sets.select("node", "s"), "node").groupBy("hub", "i", "j").applyInArrow(lambda t: _joins(t, percent), "a long, b long")
    merged = components(between).toDF("of", "top")

    # From classes back to rows.
    named = classes.select("key", "node", "copies").join(joint, "node", "left").withColumn("label", F.coalesce("label", "node"))
    named = named.join(merged, F.col("label") == F.col("of"), "left").select("key", "copies", "node", F.coalesce("top", "label").alias("component_id"))
    told = written(named.filter("copies > 1 or component_id <> node").select("key", "copies", "component_id"))
    rows = signed.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.col("key")).alias("key"))
    joined = join_keyed(rows, told, "key", "copies", signed.count(), "left")
    component = F.coalesce("component_id", "doc_id")
    return joined.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))
