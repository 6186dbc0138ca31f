"""Quality scores by regularised quadratic discriminant analysis.

Each text gives a fixed vector of statistics (lengths, shares of character classes, repetition),
transformed by logarithms and logits. Class means and covariances come from sufficient statistics
summed over all labelled rows. Each covariance is shrunk towards the pooled one and towards a
multiple of the identity; its Cholesky factor is computed once and broadcast. A score is the
posterior probability of label 1 from the difference of Mahalanobis log densities.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import id_bytes, written

#: Shrinkage towards the pooled covariance, then towards the identity.
POOL, RIDGE = 0.2, 0.05

_CLASS = np.full(256, 7, np.int64)  # other symbols
_CLASS[list(b" ")], _CLASS[list(b"\t\n\v\f\r")] = 0, 1
_CLASS[list(b"abcdefghijklmnopqrstuvwxyz")], _CLASS[list(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ")] = 2, 3
_CLASS[list(b"0123456789")], _CLASS[list(b".,;:!?'\"-()")] = 4, 5
_CLASS[128:] = 6
WIDTH = 21


def statistics(raw: bytes | None) -> list[float]:
    """The untransformed statistics of a text; of an empty or null one, zeros."""
    if not raw:
        return [0.0] * WIDTH
    n = len(raw)
    share = np.bincount(_CLASS[np.frombuffer(raw, np.uint8)], minlength=8) / n
    words = raw.split()
    lines = raw.split(b"\n")
    k = max(1, len(words))
    seen = Counter(words)
    sizes = np.fromiter(map(len, words), np.float64, len(words)) if words else np.zeros(1)
    top = max(seen.values(), default=0)
    repeats = sum(a == b for a, b in zip(words, words[1:], strict=False))
    ends = raw.count(b".") + raw.count(b"!") + raw.count(b"?")
    once = sum(v == 1 for v in seen.values())
    capital = sum(w[:1].isupper() for w in words)
    return [
        n, len(words), len(lines), float(sizes.mean()), float(sizes.std()), n / len(lines),
        share[1], share[2], share[3], share[4], share[5], share[6], share[7],
        len(seen) / k, once / k, top / k, repeats / k, len(set(lines)) / len(lines), min(1.0, ends / k), capital / k, min(1.0, sizes.max() / 50),
    ]


def transform(x: np.ndarray) -> np.ndarray:
    """Logarithms of the first six columns, logits (with 0.005 added on both sides) of the shares."""
    out = np.empty_like(x)
    out[:, :6] = np.log1p(x[:, :6])
    r = np.clip(x[:, 6:], 0, 1)
    out[:, 6:] = np.log((r + 0.005) / (1 - r + 0.005))
    return out


def features(docs: DataFrame) -> DataFrame:
    """doc_id and the transformed vector of each row's whole text."""

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = transform(np.array([statistics(r) for r in b.column("raw").to_pylist()], np.float64))
                yield pa.record_batch({"doc_id": b.column("doc_id"), "x": pa.FixedSizeListArray.from_arrays(x.ravel(), WIDTH).cast(pa.list_(pa.float64()))})

    return id_bytes(docs).mapInArrow(measure, "doc_id long, x array<double>")


def _matrix(column: pa.Array) -> np.ndarray:
    return np.array(column.to_pylist(), np.float64).reshape(-1, WIDTH)


def fit(rows: DataFrame, pool: float = POOL, ridge: float = RIDGE) -> dict:
    """A model from rows of ``x`` and ``label`` (0 or 1; rows with other labels are left out).

    Every row counts. Each task sums counts, vectors and outer products per class; the driver gathers
    two classes' sums. With one class alone its posterior is 1; without labels all scores are 0.5.
    """
    size = 1 + WIDTH + WIDTH * WIDTH

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, size))
        for b in batches:
            x, y = _matrix(b.column("x")), b.column("label").to_numpy(zero_copy_only=False)
            for c in (0, 1):
                z = x[y == c]
                total[c] += np.concatenate(([len(z)], z.sum(axis=0), (z.T @ z).ravel()))
        yield pa.record_batch({"c": pa.array(np.repeat([0, 1], size)), "k": pa.array(np.tile(np.arange(size), 2)), "v": pa.array(total.ravel())})

    labelled = rows.select("x", F.col("label").cast("int").alias("label")).filter("label in (0, 1)")
    total = np.zeros((2, size))
    for r in labelled.mapInArrow(sums, "c long, k long, v double").groupBy("c", "k").agg(F.sum("v").alias("v")).collect():
        total[r.c, r.k] = r.v
    n = total[:, 0]
    if not n.all():
        return {"constant": float(n[1] > 0) if n.any() else 0.5}
    mean = total[:, 1 : 1 + WIDTH] / n[:, None]
    scatter = [total[c, 1 + WIDTH :].reshape(WIDTH, WIDTH) - n[c] * np.outer(mean[c], mean[c]) for c in (0, 1)]
    pooled = (scatter[0] + scatter[1]) / n.sum()
    scale = np.sqrt(np.maximum(np.diag(pooled), 1e-9))
    out = {"scale": scale, "prior": float(np.log(n[1] / n[0])), "classes": []}
    for c in (0, 1):
        s = ((1 - pool) * scatter[c] / n[c] + pool * pooled) / np.outer(scale, scale)
        s = (1 - ridge) * s + ridge * max(np.trace(s) / WIDTH, 1e-3) * np.eye(WIDTH)
        factor = np.linalg.cholesky(s)
        out["classes"].append((mean[c] / scale, np.linalg.inv(factor), float(np.log(np.diag(factor)).sum())))
    return out


def posterior(model: dict, x: np.ndarray) -> np.ndarray:
    if "constant" in model:
        return np.full(len(x), model["constant"])
    z = x / model["scale"]
    density = [-0.5 * np.square((z - m) @ inverse.T).sum(axis=1) - log_det for m, inverse, log_det in model["classes"]]
    return 1 / (1 + np.exp(-np.clip(density[1] - density[0] + model["prior"], -700, 700)))


def score(vectors: DataFrame, model: dict) -> DataFrame:
    """doc_id, score and predicted (1 from 0.5) of rows from ``features``."""
    shared = vectors.sparkSession.sparkContext.broadcast(model)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            p = posterior(shared.value, _matrix(b.column("x")))
            yield pa.record_batch({"doc_id": b.column("doc_id"), "score": pa.array(p), "predicted": pa.array((p >= 0.5).astype(np.int32))})

    return vectors.mapInArrow(apply, "doc_id long, score double, predicted int")


def quality(docs: DataFrame, labels: DataFrame, learn: Column, label: str = "quality") -> DataFrame:
    """One row per input row: doc_id, score, predicted.

    Learns from the labels of rows where ``learn`` (on doc_id) holds. Null labels and labels without a
    document teach nothing; a document that is labelled twice counts twice. Null and empty texts have
    zero statistics and a score like others; a null doc_id is passed through.
    """
    vectors = written(features(docs))
    marks = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).alias("label")).filter("doc_id is not null and label is not null").filter(learn)
    return score(vectors, fit(vectors.filter(learn).join(marks, "doc_id")))
