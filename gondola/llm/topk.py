"""Exact top-k inner products by a pivot-distance index.

Every vector is keyed by its nearest pivot and its distance from it; the vectors of
a pivot, or of a band of its distances where they are many, are a cell, and a cell
of more vectors than a block is split by hash. In a block the vectors are sorted by
their distance and cut into annuli, each with its limits and its largest norm.

By the triangle inequality a vector x of a pivot p scores at most
(|q|^2 + |x|^2 - (d(q,p) - d(x,p))^2) / 2. A query first searches its own cell, which
bounds its k-th score from below, and then only the cells that can still reach that
bound. In a block it takes the annuli outwards from its own distance, the highest
limit first; each k-th best score raises the bound, and it stops where no annulus
left can reach it. Pivots and bands come from a bounded sample; all vectors are
indexed, and the result is exact whatever the sample.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Accumulator
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gondola.llm.runtime import written

_NONE, _LAST = np.int64(-(1 << 62)), np.iinfo(np.int64).max


def quantised(column: str, scale: float = 64.0) -> Column:
    """floor(scale * x) of every component, x as a double."""
    return F.transform(F.col(column), lambda x: F.floor(x.cast("double") * scale))


def usable(column: str) -> Column:
    """Not null, and no null or non-finite component."""
    bad = F.exists(F.col(column), lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    return F.col(column).isNotNull() & ~bad


class Pivots:
    """Pivots, and each one's limits between annuli."""

    def __init__(self, points: np.ndarray, limits: list[np.ndarray]) -> None:
        self.points = points.astype(np.float64)
        self.limits = limits
        self.squares = (self.points**2).sum(1)

    def distances(self, x: np.ndarray) -> np.ndarray:
        square = (x**2).sum(1)[:, None] + self.squares - 2 * x @ self.points.T
        return np.sqrt(np.maximum(square, 0))

    def place(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Nearest pivot, distance, annulus."""
        d = self.distances(x)
        nearest = d.argmin(1)
        d = d[np.arange(len(x)), nearest]
        annulus = np.array([np.searchsorted(self.limits[p], v, side="right") for p, v in zip(nearest, d, strict=True)], np.int32)
        return nearest.astype(np.int32), d, annulus

    @classmethod
    def fit(cls, sample: np.ndarray, n_pivots: int, per_annulus: float) -> Pivots:
        """Farthest-first pivots, moved to the means of what is nearest to them."""
        chosen = [0]
        near = ((sample - sample[0]) ** 2).sum(1)
        for _ in range(min(n_pivots, len(sample)) - 1):
            chosen.append(int(near.argmax()))
            near = np.minimum(near, ((sample - sample[chosen[-1]]) ** 2).sum(1))
        points = sample[chosen].astype(np.float64)
        for _ in range(5):
            own = cls(points, []).distances(sample).argmin(1)
            points = np.array([sample[own == p].mean(0) if (own == p).any() else points[p] for p in range(len(points))])
        out = cls(points, [])
        d = out.distances(sample)
        own = d.argmin(1)
        for p in range(len(points)):
            mine = d[own == p, p]
            n = max(1, round(len(mine) / max(per_annulus, 1)))
            out.limits.append(np.unique(np.quantile(mine, np.arange(1, n) / n)) if len(mine) and n > 1 else np.empty(0))
        return out


def _matrix(rows, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(rows), "<i8").reshape(-1, dim) if len(rows) else np.empty((0, dim), np.int64)


def most(whole: np.ndarray, gap: np.ndarray, d: np.ndarray) -> np.ndarray:
    """The highest score by the triangle inequality, of the sum of both squared norms
    and the least difference of the distances; with room for their rounding."""
    gap = np.maximum(gap - 1e-6 * (1 + np.sqrt(whole) + d), 0)
    return (whole - gap**2) / 2 + 1e-6 * (1 + whole)


class Block:
    """Vectors of one pivot, sorted by their distance from it and cut into annuli."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, d: np.ndarray, per_annulus: int) -> None:
        order = np.lexsort((ids, d))
        self.ids, self.vectors, d = ids[order], vectors[order], d[order]
        self.first = np.arange(0, len(ids), per_annulus)
        self.last = np.minimum(self.first + per_annulus, len(ids))
        self.low, self.high = d[self.first], d[self.last - 1]
        self.squares = np.maximum.reduceat((self.vectors.astype(np.float64) ** 2).sum(1), self.first)
        self.top = float(np.abs(self.vectors).max(initial=0))

    def limits(self, d: np.ndarray, square: np.ndarray) -> np.ndarray:
        """Of each query (its distance from the pivot, its squared norm) and annulus:
        no vector there scores more."""
        gap = np.maximum(np.maximum(self.low - d[:, None], d[:, None] - self.high), 0)
        return most(square[:, None] + self.squares, gap, d[:, None])

    def scores(self, annulus: int, queries: np.ndarray) -> np.ndarray:
        vectors = self.vectors[self.first[annulus] : self.last[annulus]]
        # float64 products are exact while no sum can pass 2^53
        if self.top * float(np.abs(queries).max(initial=0)) * queries.shape[1] < 2**53:
            return (queries.astype(float) @ vectors.T.astype(float)).astype(np.int64)
        return queries @ vectors.T


def search_block(block: Block, ids: np.ndarray, queries: np.ndarray, d: np.ndarray, bound: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(query's place, vec_id, score) of each query's k best of the block that reach
    its bound, ties to the smaller id; and how many products were made.

    Annuli are taken outwards from the query's own distance, the most promising
    first; each k-th best score raises the bound, and a query is done when no
    annulus left can reach it.
    """
    n = len(ids)
    limits = block.limits(d, (queries.astype(np.float64) ** 2).sum(1))
    turn = np.argsort(-limits, axis=1, kind="stable")
    limits = np.take_along_axis(limits, turn, 1)
    best, found = np.full((n, k), _NONE), np.full((n, k), _LAST)
    bound, products = bound.copy(), 0
    alive = np.arange(n)
    for step in range(turn.shape[1]):
        alive = alive[limits[alive, step] >= bound[alive]]
        if not len(alive):
            break
        for annulus in np.unique(turn[alive, step]).tolist():
            mine = alive[turn[alive, step] == annulus]
            here = block.ids[block.first[annulus] : block.last[annulus]]
            new = block.scores(annulus, queries[mine])
            products += new.size
            new = np.where((here == ids[mine, None]) | (new < bound[mine, None]), _NONE, new)
            some = np.flatnonzero((new > _NONE).any(1))
            mine, new = mine[some], new[some]
            if not len(mine):
                continue
            score = np.concatenate([best[mine], new], 1)
            name = np.concatenate([found[mine], np.broadcast_to(here, new.shape)], 1)
            keep = np.lexsort((name, -score), axis=1)[:, :k]
            best[mine], found[mine] = np.take_along_axis(score, keep, 1), np.take_along_axis(name, keep, 1)
            bound[mine] = np.maximum(bound[mine], best[mine, k - 1])
    at, place = np.nonzero(best > _NONE)
    return at, found[at, place], best[at, place], products


def top_k(
    vectors: DataFrame,
    is_query: Column,
    k: int = 20,
    sample_rows: int = 4096,
    per_block: int = 2048,
    per_chunk: int = 2048,
    per_annulus: int = 64,
    products: Accumulator | None = None,
) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k highest inner products with
    the vectors of all other ids, ties to the smaller vec_id; all of them if fewer.

    ``vectors``: vec_id (long) and v (array of long). Rows with a null id or vector
    take no part, repeated rows count once, shorter vectors are filled up with
    zeros. Distinct vectors under one id are all candidates, none of them for a
    query of that id. No usable rows or no queries: an empty result. Other columns
    take no part. Pivots are fitted on ``sample_rows`` rows at most. ``products``,
    if given, counts the inner products that were computed.
    """
    spark = vectors.sparkSession
    clean = vectors.where("vec_id is not null and v is not null").select(F.col("vec_id").cast("long").alias("vec_id"), "v", is_query.alias("q")).distinct()
    total, dim = clean.agg(F.count("*"), F.max(F.size("v"))).first()
    dim = max(1, dim or 1)
    schema = "query_id long, rank int, vec_id long, score long"
    if not total:
        return spark.createDataFrame([], schema)
    fit = clean.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample_rows).select("v").toPandas()
    sample = np.array([list(x) + [0] * (dim - len(x)) for x in fit.v], np.float64).reshape(len(fit), dim)
    n_pivots = max(1, min(64, math.isqrt(total) // 4))
    pivots = Pivots.fit(sample, n_pivots, per_block * len(sample) / total)

    def key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [np.array(x, "<i8") for x in batch["v"].to_pylist()]
            x = np.zeros((len(rows), dim), "<i8")
            for i, r in enumerate(rows):
                x[i, : len(r)] = r
            pivot, d, annulus = pivots.place(x.astype(np.float64))
            square = (x.astype(np.float64) ** 2).sum(1)
            yield pa.record_batch([batch["vec_id"], batch["q"], pa.array([r.tobytes() for r in x], pa.binary()), pa.array(pivot), pa.array(d), pa.array(annulus), pa.array(square)], ["vec_id", "q", "v", "pivot", "d", "annulus", "square"])

    keyed = written(clean.mapInArrow(key, "vec_id long, q boolean, v binary, pivot int, d double, annulus int, square double"), "pivot-keys")
    # cells (a pivot's vectors, or a band of its distances) of more vectors than a block are split by hash
    stats = keyed.groupBy("pivot", "annulus").agg(F.count("*").alias("n"), F.min("d").alias("low"), F.max("d").alias("high"), F.max("square").alias("square"))
    cells = written(stats.withColumn("subs", F.ceil(F.col("n") / per_block).cast("int")), "cells")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    block_key = ["pivot", "annulus", "sub", "chunk"]
    asks = "vec_id long, v binary, bound long, pivot int, annulus int, d double"

    def search(rows: pa.Table, asked: pa.Table) -> pa.Table:
        names = ["query_id", "vec_id", "score"]
        if not rows.num_rows or not asked.num_rows:
            return pa.Table.from_arrays([pa.array([], pa.int64())] * 3, names=names)
        block = Block(rows["vec_id"].to_numpy(), _matrix(rows["v"].to_pylist(), dim), rows["d"].to_numpy(), per_annulus)
        ids = asked["vec_id"].to_numpy()
        at, found, score, made = search_block(block, ids, _matrix(asked["v"].to_pylist(), dim), asked["d"].to_numpy(), asked["bound"].to_numpy(), k)
        if products is not None:
            products.add(made)
        return pa.Table.from_arrays([pa.array(ids[at]), pa.array(found), pa.array(score)], names=names)

    def probe(asked: DataFrame) -> DataFrame:
        """``asked`` (as in ``asks``), against all blocks of the cell it names. Cells that
        nobody asks stay where they are; the others go out once for ``per_chunk`` queries."""
        wanted = asked.groupBy("pivot", "annulus").agg(F.ceil(F.count("*") / per_chunk).cast("int").alias("chunks"))
        tiles = wanted.join(cells.select("pivot", "annulus", "subs"), ["pivot", "annulus"])
        sub = F.pmod(F.xxhash64(F.lit(1), "vec_id", "v"), F.col("subs")).cast("int")
        chunk = F.pmod(F.xxhash64("vec_id"), F.col("chunks")).cast("int")
        left = keyed.join(tiles, ["pivot", "annulus"]).select("pivot", "annulus", sub.alias("sub"), F.explode(F.expr("sequence(0, chunks - 1)")).alias("chunk"), "vec_id", "v", "d")
        right = asked.join(tiles, ["pivot", "annulus"]).select("pivot", "annulus", F.explode(F.expr("sequence(0, subs - 1)")).alias("sub"), chunk.alias("chunk"), "vec_id", "v", "bound", "d")
        right = right.select(*[F.col(c).alias(c) for c in right.columns])
        return left.groupBy(*block_key).cogroup(right.groupBy(*block_key)).applyInArrow(search, "query_id long, vec_id long, score long")

    # first the query's own cell, which bounds its k-th score from below
    queries = keyed.where("q")
    home = written(probe(queries.select("vec_id", "v", F.lit(int(_NONE)).alias("bound"), "pivot", "annulus", "d")), "home")
    kth = home.withColumn("r", F.row_number().over(order)).where(F.col("r") == k).select(F.col("query_id").alias("vec_id"), F.col("score").alias("bound"))
    known = cells.orderBy("pivot", "annulus").toPandas()  # a row for each cell: no more than the sample has rows

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pivot, annulus, low, high, widest = (known[c].to_numpy() for c in ("pivot", "annulus", "low", "high", "square"))
        for batch in batches:
            x = _matrix(batch["v"].to_pylist(), dim).astype(np.float64)
            d = pivots.distances(x)[:, pivot]
            limit = most((x**2).sum(1)[:, None] + widest, np.maximum(np.maximum(low - d, d - high), 0), d)
            own = (batch["pivot"].to_numpy()[:, None] == pivot) & (batch["annulus"].to_numpy()[:, None] == annulus)
            row, cell = np.nonzero((limit >= batch["bound"].to_numpy()[:, None]) & ~own)
            part = batch.take(pa.array(row))
            yield pa.record_batch([part["vec_id"], part["v"], part["bound"], pa.array(pivot[cell]), pa.array(annulus[cell]), pa.array(d[row, cell])], ["vec_id", "v", "bound", "pivot", "annulus", "d"])

    bounded = queries.join(kth, "vec_id", "left").select("vec_id", "v", F.coalesce("bound", F.lit(int(_NONE))).alias("bound"), "pivot", "annulus")
    asked = written(bounded.mapInArrow(expand, asks), "asked")
    every = home.unionByName(probe(asked))
    return every.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
