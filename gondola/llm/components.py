"""Connected components by randomised contraction.

Each round gives every node the smallest member of its closed neighbourhood in
an order drawn anew, replaces the edges' ends by those members, and drops edges
within one member. A constant share of the nodes goes each round, whatever the
shape of the graph, so the rounds grow with the logarithm of its size. Every
step is a join or a pre-aggregated minimum; a node of very many edges is never
gathered in one place.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gondola.llm.runtime import drop_written, releasing, written


#: Edges that a task thins at once: a bound on its memory.
THINNED = 1 << 18


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The task's edges without those whose ends its earlier edges connect."""
    root: dict = {}

    def find(x):
        while (up := root.get(x, x)) != x:
            root[x] = x = root.get(up, up)
        return x

    for batch in batches:
        kept = []
        for i, (a, b) in enumerate(zip(batch["src"].to_pylist(), batch["dst"].to_pylist(), strict=True)):
            a, b = find(a), find(b)
            if a != b:
                root[a] = b
                kept.append(i)
        yield batch.take(pa.array(kept, pa.int64()))


def thinned(edges: DataFrame) -> DataFrame:
    """Fewer of a written table's ``edges`` (src, dst, none null) with the same components:
    each task keeps a forest of its share. Where many tables have found the same
    near group, most of their edges say nothing new."""
    tasks = max(4, -(-edges.count() // THINNED))
    return edges.repartition(tasks).mapInArrow(releasing(_forest), edges.schema)


def components(edges: DataFrame) -> DataFrame:
    """``edges`` (src, dst: long or binary) to (node, root), equal roots for a component.

    Nodes without edges are not listed; loops, repeated edges and edges in both
    directions do no harm; edges with a null end are left out. Which member is
    the root is arbitrary but fixed.
    """
    flat = edges.where("src is not null and dst is not null and src <> dst")
    left = written(flat.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct(), "edges")
    labels: DataFrame | None = None
    turn = 0
    while not left.isEmpty():
        order = lambda c, turn=turn: F.struct(F.xxhash64(F.lit(turn), c).alias("h"), F.col(c).alias("v"))
        both = left.select(F.col("src").alias("node"), F.col("dst").alias("to")).unionByName(left.select(F.col("dst").alias("node"), F.col("src").alias("to")))
        near = both.groupBy("node").agg(F.min(order("to")).alias("m"))
        roots = written(near.select("node", F.least("m", order("node")).getField("v").alias("root")), "roots")
        if labels is None:
            next_labels = roots
        else:
            step = roots.select(F.col("node").alias("root"), F.col("root").alias("_to"))
            next_labels = written(labels.join(step, "root", "left").select("node", F.coalesce("_to", "root").alias("root")), "labels")
            drop_written(labels)
        a = roots.select(F.col("node").alias("src"), F.col("root").alias("a"))
        b = roots.select(F.col("node").alias("dst"), F.col("root").alias("b"))
        moved = left.join(a, "src").join(b, "dst").where("a <> b")
        next_left = written(moved.select(F.least("a", "b").alias("src"), F.greatest("a", "b").alias("dst")).distinct(), "edges")
        drop_written(left)
        if labels is not None:
            drop_written(roots)
        left, labels, turn = next_left, next_labels, turn + 1
    if labels is None:
        labels = left.select(F.col("src").alias("node"), F.col("dst").alias("root"))
    return labels
