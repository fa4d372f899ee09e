"""Quality classifier: regularised quadratic discriminant analysis.

Transformed statistics of whole texts; a covariance per class, shrunk towards the
pooled one and towards its own mean variance; scores from the difference of the
classes' log densities, computed from Cholesky factors that are made once.

Defined results: a null text is an empty one; without usable labels of both classes
every score is the share of label 1 (0.5 without labels).  A document with several rows in
labels counts once for each of them, so contradicting rows count for both classes.  doc_id
is cast to a long, and an id that is no number is an error.  An empty table gives an empty
result; repeated rows are scored each; very long texts are read whole; further
columns are not read (keep_good returns them as they are).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .moments import matrix, rows, summed
from .shared import pieces, written
from .statistics import NAMES, document_statistics
from .text import buffers

WIDTH = len(NAMES)
POOLED, RIDGE = 0.5, 0.05


class Discriminant:
    """Gaussians of two classes with shrunken covariances and cached Cholesky factors."""

    def __init__(self, sums: dict[int, np.ndarray], pooled: float = POOLED, ridge: float = RIDGE):
        n = {k: sums[k][0] if k in sums else 0.0 for k in (0, 1)}
        self.prior = n[1] / (n[0] + n[1]) if n[0] + n[1] else 0.5
        self.ready = min(n.values()) >= 2
        if not self.ready:
            return
        mean, cov = {}, {}
        for k in (0, 1):
            mean[k] = sums[k][1 : WIDTH + 1] / n[k]
            cov[k] = sums[k][WIDTH + 1 :].reshape(WIDTH, WIDTH) / n[k] - np.outer(mean[k], mean[k])
        both = (n[0] * cov[0] + n[1] * cov[1]) / (n[0] + n[1])
        self.scale = np.sqrt(np.maximum(np.diag(both), 1e-6))
        self.mean, self.inverse, self.log_det = {}, {}, {}
        for k in (0, 1):
            c = ((1 - pooled) * cov[k] + pooled * both) / np.outer(self.scale, self.scale)
            c = (1 - ridge) * c + ridge * np.eye(WIDTH) * max(np.trace(c) / WIDTH, 1e-3)
            factor = np.linalg.cholesky(c)
            self.inverse[k] = np.linalg.inv(factor)
            self.log_det[k] = 2 * np.log(np.diag(factor)).sum()
            self.mean[k] = mean[k] / self.scale

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        z = x / self.scale
        part = {k: -0.5 * (((z - self.mean[k]) @ self.inverse[k].T) ** 2).sum(axis=1) - 0.5 * self.log_det[k] for k in (0, 1)}
        return part[1] - part[0] + np.log(self.prior / (1 - self.prior))

    def scores(self, x: np.ndarray) -> np.ndarray:
        if not self.ready:
            return np.full(len(x), self.prior)
        return 1 / (1 + np.exp(-np.clip(self.log_odds(x), -40, 40)))


def _measure(batches):
    for batch in pieces(batches):
        yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), rows(document_statistics(*buffers(batch.column("text"))))], ["doc_id", "x"])


def _class_sums(batch):
    x, y = matrix(batch.column("x"), WIDTH), batch.column("y").to_numpy(zero_copy_only=False)
    return {k: np.concatenate([[len(z)], z.sum(axis=0), (z.T @ z).reshape(-1)]) for k in (0, 1) if len(z := x[y == k])}


def held_out(doc_id: Column, mod: int, rest: int) -> Column:
    """Whether crc32(doc_id as text) mod `mod` is `rest`; a null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % mod == rest, F.lit(False))


def fit(features: DataFrame, labels: DataFrame, label: str, mod: int, rest: int) -> Discriminant:
    """Trained on all labelled rows that are not held out."""
    y = labels.select("doc_id", F.col(label).cast("int").alias("y")).filter("y in (0, 1)").filter(~held_out(F.col("doc_id"), mod, rest))
    return Discriminant(summed(features.join(y, "doc_id"), _class_sums, 1 + WIDTH + WIDTH * WIDTH))


def score_quality(docs: DataFrame, labels: DataFrame, mod: int = 5, rest: int = 0) -> DataFrame:
    """(doc_id, score) for every row of docs."""
    features = written(docs.select("doc_id", "text").mapInArrow(_measure, "doc_id long, x array<float>"), "statistics")
    model = docs.sparkSession.sparkContext.broadcast(fit(features, labels, "quality", mod, rest))

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(model.value.scores(matrix(batch.column("x"), WIDTH)))], ["doc_id", "score"])

    return features.mapInArrow(run, "doc_id long, score double")


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, mod: int = 5, rest: int = 0) -> DataFrame:
    """docs, with all their columns, without those that score below the threshold.

    Texts aren't shuffled: statistics are made of all of them to train on those with a
    label, and again where the texts lie to filter them.
    """
    # written: else a small table of labels would put two Python workers side by side in each task
    features = written(docs.select("doc_id", "text").mapInArrow(_measure, "doc_id long, x array<float>"), "statistics")
    model = docs.sparkSession.sparkContext.broadcast(fit(features, labels, "quality", mod, rest))

    def run(batches):
        for batch in pieces(batches):
            scores = model.value.scores(document_statistics(*buffers(batch.column("text"))))
            yield batch.filter(pa.array(scores >= threshold))

    return docs.mapInArrow(run, docs.schema)
