"""Vector code compression: product codes by weighted Lloyd rounds over distinct parts.

Vectors become integers, floor(scale * x), and are cut into equal consecutive parts.
Equal parts of one position are one row with a weight, so a part that a third of all
vectors share is worked on once. A round assigns each distinct part to the nearest
entry of its position's codebook and sums parts by entry in the tasks; the sums are
added up in Spark, and only codebooks (``parts * entries`` rows) pass through the
driver. The final codes and errors are joined back to the vectors by the parts.

All arithmetic is in whole numbers. Tasks multiply in doubles where every sum is
below 2^53, and so exact, and subtract in 64 bits elsewhere.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gondola.llm.runtime import releasing, written

#: Components are held at this size either way, so that errors fit in 64 bits.
LARGEST = 1 << 26
_BLOCK = 4096
Codebooks = list[np.ndarray]  # of each position: entries x components

_CUT = "row long, vec_id long, label string, position int, part binary"


def whole(column: str, scale: float) -> Column:
    """floor(scale * x) of each component, held at LARGEST either way; null for a null
    vector and for one that holds a null or non-finite component."""
    x = F.transform(F.col(column), lambda c: F.floor(F.least(F.greatest(c.cast("double") * scale, F.lit(-float(LARGEST))), F.lit(float(LARGEST)))).cast("int"))
    bad = F.exists(F.col(column), lambda c: c.isNull() | F.isnan(c.cast("double")) | (F.abs(c.cast("double")) == float("inf")))
    return F.when(F.col(column).isNotNull() & ~bad, x)


def limits(size: int, parts: int) -> list[int]:
    """Where parts of a vector of ``size`` components begin and end."""
    return [size * i // parts for i in range(parts + 1)]


def nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each row's nearest entry (of equals the first), and the squared distance."""
    entry, error = np.zeros(len(x), np.int64), np.zeros(len(x), np.int64)
    top = max(int(np.abs(x).max(initial=0)), int(np.abs(book).max(initial=0)))
    small = x.shape[1] * 4 * top * top < 1 << 53
    square = (book.astype(float) ** 2).sum(1)
    for at in range(0, len(x), _BLOCK):
        part = x[at : at + _BLOCK]
        if small:
            rows = part.astype(float)
            found = square - 2 * (rows @ book.T.astype(float))
            best = found.argmin(1)
            error[at : at + _BLOCK] = (found[np.arange(len(part)), best] + (rows**2).sum(1)).astype(np.int64)
        else:
            found = np.empty((len(part), len(book)), np.int64)
            for k, e in enumerate(book):
                found[:, k] = ((part - e) ** 2).sum(1)
            best = found.argmin(1)
            error[at : at + _BLOCK] = found[np.arange(len(part)), best]
        entry[at : at + _BLOCK] = best
    return entry, error


def _grouped(batch: pa.RecordBatch, books: Codebooks) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(position, its rows, their parts) of a batch of distinct parts."""
    position = batch["position"].to_numpy()
    parts = batch["part"].to_pylist()
    for p, book in enumerate(books):
        at = np.flatnonzero(position == p)
        if len(at):
            yield p, at, np.frombuffer(b"".join([parts[i] for i in at.tolist()]), "<i4").reshape(len(at), book.shape[1]).astype(np.int64)


def _sums(batches: Iterator[pa.RecordBatch], books: Codebooks) -> Iterator[pa.RecordBatch]:
    """A task's weights and weighted sums by entry: at most a row for each entry."""
    total = [np.zeros(b.shape, np.int64) for b in books]
    count = [np.zeros(len(b), np.int64) for b in books]
    for batch in batches:
        weight = batch["weight"].to_numpy()
        for p, at, x in _grouped(batch, books):
            entry, w = nearest(x, books[p])[0], weight[at]
            np.add.at(total[p], entry, x * w[:, None])
            np.add.at(count[p], entry, w)
    for p, (t, c) in enumerate(zip(total, count, strict=True)):
        used = np.flatnonzero(c)
        if len(used):
            yield pa.record_batch([pa.array(np.full(len(used), p, np.int32)), pa.array(used.astype(np.int32)), pa.array(c[used]), pa.array(list(t[used]), pa.list_(pa.int64()))], ["position", "entry", "weight", "total"])


def _coded(batches: Iterator[pa.RecordBatch], books: Codebooks) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        entry, error = np.zeros(batch.num_rows, np.int32), np.zeros(batch.num_rows, np.int64)
        for p, at, x in _grouped(batch, books):
            entry[at], error[at] = nearest(x, books[p])
        yield pa.record_batch([batch["position"], batch["part"], pa.array(entry), pa.array(error)], ["position", "part", "entry", "error"])


def _cut(batches: Iterator[pa.RecordBatch], cuts: list[int]) -> Iterator[pa.RecordBatch]:
    """A row for each vector and position, the part as little-endian 32-bit integers."""
    for batch in batches:
        n = batch.num_rows
        values = batch["v"].flatten().to_numpy(zero_copy_only=False).astype("<i4").reshape(n, cuts[-1])
        for p, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
            part = np.ascontiguousarray(values[:, a:b])
            yield pa.record_batch([batch["row"], batch["vec_id"], batch["label"], pa.array(np.full(n, p, np.int32)), pa.array([r.tobytes() for r in part], pa.binary())], ["row", "vec_id", "label", "position", "part"])


def fit_codebooks(distinct: DataFrame, start: Codebooks, rounds: int) -> Codebooks:
    """``rounds`` of Lloyd over weighted distinct parts (position, part, weight). An
    entry becomes floor(sum / count) of its parts; unused entries stay."""
    books = [b.copy() for b in start]
    for _ in range(rounds):
        sums = distinct.mapInArrow(releasing(partial(_sums, books=books)), "position int, entry int, weight long, total array<long>")
        wide = max((b.shape[1] for b in books), default=0)
        added = sums.groupBy("position", "entry").agg(F.sum("weight").alias("weight"), *[F.sum(F.get("total", F.lit(i))).alias(f"t{i}") for i in range(wide)])
        new = [b.copy() for b in books]
        for r in added.collect():  # a row for each entry at most
            new[r["position"]][r["entry"]] = np.array([r[f"t{i}"] for i in range(books[r["position"]].shape[1])], np.int64) // r["weight"]
        books = new
    return books


def digest(books: Codebooks) -> str:
    text = ",".join(str(x) for b in books for x in b.reshape(-1).tolist())
    return hashlib.sha256(text.encode()).hexdigest()


def compress(vectors: DataFrame, parts: int = 4, entries: int = 256, rounds: int = 4, scale: float = 1024.0, key: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """One row for each usable vector: the key, code (two hex digits for each part),
    error (squared distance to its codes), label_error (error summed over the rows of
    its label, nulls together) and codebooks_sha256.

    Vectors that are null or hold null or non-finite components give no row, nor do
    those of another length than the vector of the smallest key. Codebooks start as
    the parts of the ``entries`` vectors with the smallest keys (all, if fewer), a
    null key last, equal keys by components; every repeated row counts and gives a row
    of its own. Components beyond 2^26 after scaling count as 2^26. A length that
    ``parts`` doesn't divide is cut at the nearest components below. Other columns are
    not passed on. No usable vector gives no rows.
    """
    if not 0 < entries <= 256:
        raise ValueError("a code has two hex digits: from 1 to 256 entries")
    usable = vectors.select(F.col(key).alias("vec_id"), F.col(label).cast("string").alias("label"), whole(vector, scale).alias("v")).where("v is not null and size(v) > 0")
    first = [r["v"] for r in usable.orderBy(F.asc_nulls_last("vec_id"), "v").limit(entries).collect()]
    size = len(first[0]) if first else parts
    if first and any(len(v) != size for v in first):
        first = [r["v"] for r in usable.where(F.size("v") == size).orderBy(F.asc_nulls_last("vec_id"), "v").limit(entries).collect()]
    cuts = limits(size, parts)
    start = [np.array([v[a:b] for v in first], np.int64).reshape(len(first), b - a) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]

    numbered = usable.where(F.size("v") == size).withColumn("row", F.monotonically_increasing_id())
    cut = written(numbered.select("row", "vec_id", "label", "v").mapInArrow(releasing(partial(_cut, cuts=cuts)), _CUT), "parts")
    distinct = written(cut.groupBy("position", "part").agg(F.count("*").alias("weight")), "distinct-parts")
    books = fit_codebooks(distinct, start, rounds)

    codes = written(distinct.mapInArrow(releasing(partial(_coded, books=books)), "position int, part binary, entry int, error long"), "codes")
    joined = cut.join(codes, ["position", "part"])  # a part that very many share is split by Spark's skew join
    digits = F.concat(*[F.lower(F.lpad(F.hex(F.max(F.when(F.col("position") == p, F.col("entry")))), 2, "0")) for p in range(parts)])
    coded = written(joined.groupBy("row", "vec_id", "label").agg(digits.alias("code"), F.sum("error").alias("error")), "coded")
    by_label = coded.groupBy(F.col("label").alias("_label")).agg(F.sum("error").alias("label_error"))
    both = coded.join(by_label, F.col("label").eqNullSafe(F.col("_label")))
    return both.select(F.col("vec_id").alias(key), "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))
