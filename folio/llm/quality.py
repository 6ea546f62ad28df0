"""Quality classifier: regularised quadratic discriminant over transformed document statistics.

Both classes' covariances are shrunk towards the pooled one and a scaled unit
matrix.  A score is the logistic function of the difference of the classes'
log densities (squared Mahalanobis distances and log determinants, both from
Cholesky factors that are computed once) and of the class frequencies.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folio.llm import textscan as ts
from folio.llm.common import written

FEATURES = ("words", "upper", "signs", "digits", "word_length", "echo", "distinct", "bare", "ended", "line_words", "sentences")
#: Weight of the pooled covariance and of the unit matrix in a class's own.
POOLED, UNIT = 0.10, 0.05
THRESHOLD = 0.3

_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_LETTER = _UPPER.copy()
_LETTER[97:123] = True
_LETTER[0xC0:] = True  # the first byte of any character outside ASCII counts as a letter
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_BLANK = np.zeros(256, bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True
_SIGN = np.zeros(256, bool)
_SIGN[:128] = ~(_LETTER | _DIGIT | _BLANK)[:128]
_STOP = np.zeros(256, bool)
_STOP[[ord(c) for c in ".!?"]] = True


def _odds(part: np.ndarray, whole: np.ndarray) -> np.ndarray:
    return np.log((part + 0.5) / (np.maximum(whole - part, 0) + 0.5) + 1e-3)


def features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A row of FEATURES for each text of a slice; an empty text has the row that zero counts give."""
    n = len(offsets) - 1

    def per_text(mask: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(mask)])
        return (total[offsets[1:]] - total[offsets[:-1]]).astype(float)

    w = ts.words(data, offsets, ts.SPACE_WORDS, False)
    words = np.diff(w.first).astype(float)
    doc = np.repeat(np.arange(n), np.diff(w.first))

    def per_word(mask: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(mask)])
        return (total[w.first[1:]] - total[w.first[:-1]]).astype(float)

    second = np.zeros(len(data), bool)
    second[1:] = data[:-1] == 0xC3
    upper = per_text(_UPPER[data] | (second & (data >= 0x80) & (data <= 0x9E)))
    letters, digits, signs = per_text(_LETTER[data]), per_text(_DIGIT[data]), per_text(_SIGN[data])
    full = letters + digits + signs
    lines = per_text(data == 10) + 1
    echo = np.zeros(len(w.hash), bool)
    echo[1:] = (w.hash[1:] == w.hash[:-1]) & (doc[1:] == doc[:-1])
    order = np.lexsort((w.hash, doc))
    fresh = np.ones(len(order), bool)
    fresh[1:] = (w.hash[order][1:] != w.hash[order][:-1]) | (doc[order][1:] != doc[order][:-1])
    distinct = np.bincount(doc[order][fresh], minlength=n).astype(float)
    some = np.concatenate([[0], np.cumsum((_LETTER | _DIGIT)[data])])
    bare = per_word(some[w.end] == some[w.start])
    last = data[w.end - 1] if len(w.end) else np.zeros(0, np.uint8)
    ended = per_word(_SIGN[last])
    sentences = per_word(_STOP[last])
    columns = [
        np.log1p(words),
        _odds(upper, letters),
        _odds(signs, full),
        _odds(digits, full),
        np.log((full + 1) / (words + 1)),
        _odds(per_word(echo), words),
        np.log1p(distinct) - 0.85 * np.log1p(words),
        _odds(bare, words),
        _odds(ended, words),
        np.log((words + 1) / lines),
        _odds(sentences, words),
    ]
    return np.stack(columns, axis=1)


def _featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for s in ts.slices(batch.column(1)):
            x = features(s.data, s.offsets)
            flat = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * len(FEATURES)), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(s.lo, s.hi - s.lo), flat], ["doc_id", "x"])


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy().reshape(len(column), len(FEATURES))


def _moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each class of this task's rows: count, sums and sums of products."""
    d = len(FEATURES)
    total = np.zeros((2, 1 + d + d * d))
    for batch in batches:
        y, x = batch.column(0).to_numpy(), _matrix(batch.column(1))
        for k in (0, 1):
            own = x[y == k]
            total[k] += np.concatenate([[len(own)], own.sum(axis=0), (own.T @ own).ravel()])
    yield pa.RecordBatch.from_arrays([pa.array([0, 1], pa.int32()), pa.array(list(total), pa.list_(pa.float64()))], ["y", "moments"])


class Discriminant(NamedTuple):
    """mean, inverse Cholesky factor and log determinant of each class, and log frequency ratio of class 1 to class 0."""

    mean: np.ndarray
    whiten: np.ndarray
    logdet: np.ndarray
    prior: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of class 1."""
        density = [-0.5 * (((x - m) @ w.T) ** 2).sum(axis=1) - 0.5 * d for m, w, d in zip(self.mean, self.whiten, self.logdet, strict=True)]
        return 1 / (1 + np.exp(-np.clip(density[1] - density[0] + self.prior, -500, 500)))


def fit(moments: np.ndarray, pooled: float = POOLED, unit: float = UNIT) -> Discriminant | None:
    """The model from both classes' moments; None unless each class has rows."""
    d = len(FEATURES)
    n, sums, products = moments[:, 0], moments[:, 1 : 1 + d], moments[:, 1 + d :].reshape(2, d, d)
    if (n < 1).any():
        return None
    mean = sums / n[:, None]
    scatter = products - n[:, None, None] * mean[:, :, None] * mean[:, None, :]
    common = scatter.sum(axis=0) / n.sum()
    whiten, logdet = [], []
    for k in (0, 1):
        own = (1 - pooled - unit) * scatter[k] / n[k] + pooled * common
        own += (unit * np.trace(own) / d + 1e-6) * np.eye(d)
        factor = np.linalg.cholesky(own)
        whiten.append(np.linalg.inv(factor))
        logdet.append(2 * np.log(np.diag(factor)).sum())
    return Discriminant(mean, np.stack(whiten), np.array(logdet), float(np.log(n[1] / n[0])))


def _scored(model: Discriminant | None):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = model.score(_matrix(batch.column(1))) if model else np.full(batch.num_rows, 0.5)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(p)], ["doc_id", "score"])

    return score


def held_out(doc_id: Column) -> Column:
    """The fold that labels are never learned from; rows without an id belong to it."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5, F.lit(0)) == 0


def quality_scores(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per row of docs: doc_id, held_out, score, predicted, and the columns to carry.

    Learned from labels (doc_id, quality) of documents outside the held-out
    fold, all of them; labels other than 0 and 1, and those without a document,
    are ignored.  A null text is empty, and empty texts get the score of zero
    counts.  Rows that repeat a doc_id are scored each; their labels count for
    each.  Where a class has no rows, every score is 0.5.
    """
    row = F.struct("doc_id", *carry)
    kind = docs.select(row.alias("row")).schema["row"].dataType.simpleString()
    table = written(docs.select(row.alias("row"), "text").mapInArrow(_featured, f"row {kind}, x array<double>"), "features")
    known = labels.select("doc_id", F.col("quality").cast("int").alias("y")).where("y in (0, 1)").where(~held_out(F.col("doc_id")))
    partial = table.select(F.col("row.doc_id").alias("doc_id"), "x").join(known, "doc_id").select("y", "x").mapInArrow(_moments, "y int, moments array<double>")
    totals = partial.select("y", F.posexplode("moments").alias("at", "part")).groupBy("y", "at").agg(F.sum("part").alias("total"))
    sums = np.zeros((2, 1 + len(FEATURES) + len(FEATURES) ** 2))
    for r in totals.collect():  # 266 numbers, whatever the number of tasks
        sums[r.y, r["at"]] = r.total
    scored = table.mapInArrow(_scored(fit(sums)), f"row {kind}, score double")
    return scored.select("row.doc_id", held_out(F.col("row.doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), *(F.col(f"row.{c}").alias(c) for c in carry))
