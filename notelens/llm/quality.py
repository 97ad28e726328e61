"""Operator 3: document quality by a regularised quadratic discriminant.

Each text becomes a vector of transformed statistics (log lengths, log odds of
character classes, repetition of words and lines). Every class has its own mean
and a covariance shrunk towards the pooled one and towards a multiple of the
identity; its Cholesky factor is computed once and kept in the model, and a score
is the logistic of the difference of the two log densities (from Mahalanobis
distances) and the log prior odds.

The model is fitted on at most ``max_rows`` labelled rows, chosen by a hash of
their id, never from the held-out fold; all other work covers every row. The
chosen ids are broadcast (bounded by ``max_rows``), so no text is shuffled.

Nulls count as empty texts, which get a score like any other. Without labels, or
with one class only, every score is the smoothed share of class 1. A null label
does not count; a repeated label of one document counts once; repeated documents
are scored each. The outputs replace kept columns of the same name.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from notelens.llm.tables import held_out, map_rows, slices

#: Labelled rows that a model is fitted on, at most.
MAX_LABELLED_ROWS = 20_000
#: Shares of the pooled covariance and of the scaled identity in a class's covariance.
POOLED, SPHERE = 0.1, 0.01
#: From this score on a document counts as good.
THRESHOLD = 0.3

_CLASSES = [b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b".,;:?'", b"!", b"|<>{}[]\\/=_", b"*#$%&@^~+", b" \t\r\n"]
_BYTES = np.zeros((256, len(_CLASSES)))
for _k, _chars in enumerate(_CLASSES):
    _BYTES[list(_chars), _k] = 1.0


def statistics(text: str | None) -> list[float]:
    """Transformed statistics of one whole text."""
    raw = (text or "").encode()
    n = len(raw)
    counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    shares = (counts @ _BYTES + 0.5) / (n + 1.0)
    words = raw.split()
    lines = raw.split(b"\n")
    total, lengths = len(words), np.fromiter(map(len, words), np.int64, len(words))
    spread = len(set(words))
    p = counts[counts > 0] / max(n, 1)
    again = sum(a == b for a, b in zip(words, words[1:]))
    return [
        *np.log(shares / np.maximum(1.0 - shares, 1e-9)),
        np.log1p(n),
        np.log((spread + 1.0) / (total + 1.0) ** 0.75),
        np.log((again + 0.5) / (total + 1.0)),
        np.log1p(lengths.mean() if total else 0.0),
        np.log1p(lengths.std() if total else 0.0),
        float(-(p * np.log(p)).sum()),
        np.log((len(set(lines)) + 0.5) / (len(lines) + 1.0)),
        np.log1p(max(map(len, lines))),
    ]


@dataclass
class Discriminant:
    """Means, inverse Cholesky factors and log determinants of the two classes; ``constant`` where there are not two."""

    centre: np.ndarray | None = None
    scale: np.ndarray | None = None
    means: np.ndarray | None = None
    whiten: np.ndarray | None = None
    log_det: np.ndarray | None = None
    log_prior: float = 0.0
    constant: float | None = None

    @classmethod
    def fit(cls, x: np.ndarray, label: np.ndarray) -> Discriminant:
        counts = np.bincount(label, minlength=2)[:2]
        if counts.min() < 2:
            return cls(constant=float((counts[1] + 1) / (counts.sum() + 2)))
        centre, scale = x.mean(0), np.maximum(x.std(0), 1e-6)
        z = (x - centre) / scale
        parts = [z[label == c] for c in (0, 1)]
        means = np.stack([p.mean(0) for p in parts])
        covs = [np.cov(p, rowvar=False, bias=True) for p in parts]
        pooled = sum(n * c for n, c in zip(counts, covs)) / counts.sum()
        whiten, log_det = [], []
        for cov in covs:
            mixed = (1 - POOLED - SPHERE) * cov + POOLED * pooled + SPHERE * np.trace(pooled) / len(centre) * np.eye(len(centre))
            factor = np.linalg.cholesky(mixed)
            whiten.append(np.linalg.inv(factor))
            log_det.append(2 * np.log(np.diag(factor)).sum())
        return cls(centre, scale, means, np.stack(whiten), np.array(log_det), float(np.log(counts[1] / counts[0])))

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(x), self.constant)
        z = (x - self.centre) / self.scale
        density = [-0.5 * (((z - self.means[c]) @ self.whiten[c].T) ** 2).sum(1) - 0.5 * self.log_det[c] for c in (0, 1)]
        odds = np.clip(density[1] - density[0] + self.log_prior, -700, 700)
        return 1 / (1 + np.exp(-odds))


def _matrix(texts: list) -> np.ndarray:
    return np.array([statistics(t) for t in texts]).reshape(len(texts), -1)


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", max_rows: int = MAX_LABELLED_ROWS) -> Discriminant:
    """Fit on the labelled documents outside the held-out fold: at most ``max_rows`` labels, those of the smallest hashes.

    Of the rows with one id one text counts, the one with the least hash, so that repeated ids do not get past the bound.
    """
    chosen = (labels.filter(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out())
              .select("doc_id", F.col(label).cast("int").alias("label")).distinct()
              .orderBy(F.xxhash64("doc_id"), "doc_id", "label").limit(max_rows))
    one = F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("row")
    rows = (docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "label").agg(one)
            .select("doc_id", "label", "row.text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            x = _matrix(part.column(2).to_pylist())
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(list(x), pa.list_(pa.float64()))],
                                             ["doc_id", "label", "x"])

    fields = [T.StructField("doc_id", T.LongType()), T.StructField("label", T.IntegerType()),
              T.StructField("x", T.ArrayType(T.DoubleType()))]
    found = sorted(map(tuple, map_rows(rows, run, fields).collect()))  # at most ``max_rows`` short vectors
    return Discriminant.fit(np.array([r[2] for r in found] or [[0.0]]), np.array([r[1] for r in found], int))


def score(docs: DataFrame, model: Discriminant, keep: Sequence[str] = ("doc_id",), text: str = "text") -> DataFrame:
    """The kept columns and ``score``, the probability of class 1, of every row."""
    names = [n for n in keep if n != "score"]
    at = names.index(text) if text in names else len(names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            x = model.score(_matrix(part.column(at).to_pylist())) if part.num_rows else []
            yield pa.RecordBatch.from_arrays([*part.columns[:len(names)], pa.array(x, pa.float64())], [*names, "score"])

    wanted = docs.select(*names) if text in names else docs.select(*names, text)
    return map_rows(wanted, run, [docs.schema[n] for n in names] + [T.StructField("score", T.DoubleType())])
