"""Vector code compression: product quantisation in whole numbers, with the same codes on every machine.

Components become integers, so means and distances are exact.  The nearest entry
is screened by a float32 matrix product whose rounding error is bounded from
above; every entry whose interval reaches the best one's is evaluated again in
int64, and ties go to the lowest index.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folio.llm.common import attach, written

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: Largest whole component: squared distances of vectors of up to 8,192 components then fit 64 bits.
LARGEST = 1 << 24
#: Vectors that are screened in one matrix product.
BLOCK_ROWS = 2048
#: Unit roundoff of float32 and of float64.
_U32, _U64 = 2.0**-24, 2.0**-53


def screened(x: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row and index of every entry that may be nearest to a row of x, by row and index.

    |x - c|^2 differs from |c|^2 - 2 x.c by a term that all entries share.  A
    float32 sum of d products, in any order, with both factors rounded, is off
    by gamma |x| |c| at most, gamma = m u / (1 - m u), m = d + 2 (Cauchy-Schwarz
    bounds the sum of the products' sizes); the float64 steps after it by a few
    units of what they add up.
    """
    m = (x.shape[1] + 2) * _U32
    gamma = m / (1 - m)
    product = (x.astype(np.float32) @ entries.astype(np.float32).T).astype(np.float64)
    own, norm = np.sqrt((x * x).sum(axis=1, dtype=np.float64)), (entries * entries).sum(axis=1, dtype=np.float64)
    size = own[:, None] * np.sqrt(norm)[None, :]
    value = norm[None, :] - 2 * product
    half = (2 * gamma * (1 + 1e-6)) * size + (8 * _U64) * (norm[None, :] + 4 * size)
    return np.nonzero(value - half <= (value + half).min(axis=1)[:, None])


def nearest(x: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the nearest entry for each row of x (int64), ties to the lowest, and the squared distance."""
    index, error = np.zeros(len(x), np.int64), np.zeros(len(x), np.int64)
    if not x.shape[1]:
        return index, error
    for lo in range(0, len(x), BLOCK_ROWS):
        block = x[lo : lo + BLOCK_ROWS]
        row, entry = screened(block, entries)
        exact = ((block[row] - entries[entry]) ** 2).sum(axis=1)
        best = np.minimum.reduceat(exact, np.searchsorted(row, np.arange(len(block))))
        hit = np.flatnonzero(exact == best[row])
        _, first = np.unique(row[hit], return_index=True)
        index[lo : lo + len(block)], error[lo : lo + len(block)] = entry[hit[first]], best
    return index, error


def _whole(scale: int):
    """Rows (vec_id, label, vector of doubles): those without null or non-finite components, as whole numbers."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(2)
            batch = batch.filter(lists.is_valid())
            lists = batch.column(2)
            offsets = lists.offsets.to_numpy().astype(np.int64)
            raw = lists.values.to_numpy(zero_copy_only=False)[offsets[0] : offsets[-1]] if len(lists) else np.zeros(0)
            offsets = offsets - offsets[0] if len(lists) else offsets
            odd = np.concatenate([[0], np.cumsum(~np.isfinite(raw))])  # a null is a nan here
            good = np.flatnonzero(odd[offsets[1:]] == odd[offsets[:-1]])
            with np.errstate(invalid="ignore", over="ignore"):
                value = np.floor(raw * scale)
            far = np.concatenate([[0], np.cumsum(~(np.abs(value) <= LARGEST))])
            value = np.where(np.abs(value) <= LARGEST, value, 0).astype(np.int32)
            vectors = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(value))
            large = pa.array(far[offsets[1:]] > far[offsets[:-1]])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), vectors, large], ["vec_id", "label", "vec", "large"]).take(pa.array(good))

    return whole


def _matrix(lists: pa.Array) -> np.ndarray:
    return lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(lists), -1)


def _sums(book):
    """For each part and entry: how many parts of this task's vectors it is nearest to, and their sum."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        entries = book.value
        parts, many, d = entries.shape
        count, total = np.zeros((parts, many), np.int64), np.zeros((parts, many, d), np.int64)
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch.column(0)).reshape(batch.num_rows, parts, d)
                for p in range(parts):
                    index, _ = nearest(x[:, p], entries[p])
                    count[p] += np.bincount(index, minlength=many)
                    np.add.at(total[p], index, x[:, p])
        part, entry = np.nonzero(count)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(part) + 1, dtype=np.int32) * d), pa.array(total[part, entry].ravel()))
        yield pa.RecordBatch.from_arrays([pa.array(part, pa.int64()), pa.array(entry, pa.int64()), pa.array(count[part, entry]), lists], ["part", "entry", "n", "total"])

    return sums


def _codes(book):
    def codes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        entries = book.value
        parts, _, d = entries.shape
        for batch in batches:
            x = _matrix(batch.column(2)).reshape(batch.num_rows, parts, d) if batch.num_rows else np.zeros((0, parts, d), np.int64)
            found = [nearest(x[:, p], entries[p]) for p in range(parts)]
            code = np.stack([index for index, _ in found], axis=1).astype(np.uint8)
            error = sum((e for _, e in found), np.zeros(len(x), np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([c.tobytes().hex() for c in code], pa.string()), pa.array(error)], ["vec_id", "label", "code", "error"])

    return codes


def whole_vectors(rows: DataFrame, scale: int = SCALE, parts: int = PARTS) -> DataFrame:
    """vec_id, label, vec (array of int) of the rows that are kept, written.

    Rows whose vector is null, or holds a null or non-finite component, go.  Of
    the others all must have one length, a multiple of `parts`, and no component
    beyond LARGEST / scale: a ValueError says so, since codes and errors would
    mean nothing else.
    """
    source = rows.select("vec_id", "label", F.col("embedding").cast("array<double>").alias("embedding"))
    kinds = T.StructType([source.schema["vec_id"], source.schema["label"], T.StructField("vec", T.ArrayType(T.IntegerType())), T.StructField("large", T.BooleanType())])
    kept = written(source.mapInArrow(_whole(scale), kinds), "vectors")
    low, high, large = kept.agg(F.min(F.size("vec")), F.max(F.size("vec")), F.max("large")).first()
    if low != high or (low or 0) % parts:
        raise ValueError(f"vectors have {low} to {high} components; one length, a multiple of {parts}, is needed")
    if large:
        raise ValueError(f"a component is beyond {LARGEST / scale:g}")
    return kept.drop("large")


def trained(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> np.ndarray:
    """Codebooks (part, entry, component) of the vectors of whole_vectors().

    They start as the parts of the smallest vec_ids (null ids last, one id's
    vectors by their components); with fewer vectors they have fewer entries.
    Each round sums the parts of all vectors by their nearest entry inside
    tasks, so that a few numbers for each entry are shuffled and reach the
    driver, `entries` times a vector's length in all.
    """
    first = vectors.orderBy(F.col("vec_id").asc_nulls_last(), "vec").limit(entries).select("vec").collect()
    if not first:
        return np.zeros((parts, 0, 0), np.int64)
    book = np.array([r.vec for r in first], np.int64).reshape(len(first), parts, -1).transpose(1, 0, 2).copy()
    for _ in range(rounds if book.shape[2] else 0):
        sent = vectors.sparkSession.sparkContext.broadcast(book)
        sums = vectors.select("vec").mapInArrow(_sums(sent), "part long, entry long, n long, total array<long>")
        means = sums.groupBy("part", "entry").agg(F.sum("n").alias("n"), F.array(*(F.sum(F.col("total")[i]) for i in range(book.shape[2]))).alias("total")).collect()
        book = book.copy()
        for r in means:
            book[r.part, r.entry] = np.array(r.total, np.int64) // r.n  # goes down
        sent.unpersist()
    return book


def codebooks_sha256(book: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, book.ravel().tolist())).encode()).hexdigest()


def encoded(vectors: DataFrame, book: np.ndarray) -> DataFrame:
    """vec_id, label, code, error, label_error of each of the vectors: code has two hex digits for each part, label_error
    is the sum of errors over equal labels, null ones together.  A label may hold any share of the rows."""
    if not book.size and not book.shape[1]:
        return vectors.select("vec_id", "label", F.lit("").alias("code"), F.lit(0).cast("long").alias("error"), F.lit(0).cast("long").alias("label_error"))
    kinds = T.StructType([vectors.schema["vec_id"], vectors.schema["label"], T.StructField("code", T.StringType()), T.StructField("error", T.LongType())])
    found = written(vectors.mapInArrow(_codes(vectors.sparkSession.sparkContext.broadcast(book)), kinds), "codes")
    found = found.withColumn("of", F.struct("label"))  # a null label equals itself within a struct
    labels = written(found.groupBy("of").agg(F.sum("error").alias("label_error"), F.count(F.lit(1)).alias("n")), "labels")
    spread = F.xxhash64("vec_id", "code", "error")
    return attach(found, labels, ["of"], spread, "n").select("vec_id", "label", "code", "error", "label_error")


def vector_codes(rows: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> DataFrame:
    """vec_id, label, code, error, label_error, codebooks_sha256 for each row of rows (vec_id, embedding, label) that is kept.

    See whole_vectors() for the rows that go, and trained() for ties, repeated
    and null ids, which are rows each.  Of an empty table nothing is left.
    Further columns are ignored.  At most 256 entries.
    """
    vectors = whole_vectors(rows, scale, parts)
    book = trained(vectors, parts, entries, rounds)
    return encoded(vectors, book).withColumn("codebooks_sha256", F.lit(codebooks_sha256(book)))
