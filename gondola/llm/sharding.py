"""Proportional stratified interleaving.

Rows of each source are put in a seeded random order and ranked; a row's place
in the whole is its fractional rank ``(2 * rank + 1) / (2 * n_source)``. Cut
into runs of equal length, the ordered rows give shards that each hold every
source in its share of the whole.

No task ever holds a source: ranks are counted within (source, hash bucket)
and within buckets of the fractional rank, and the buckets' offsets come from
their counts. With about sqrt(rows) buckets both the rows of a bucket and the
table of offsets stay near sqrt(rows).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def order_key(seed: int, *columns: str) -> Column:
    """The seeded random order: MD5 of seed and key, as 32 hex digits."""
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("~")) for c in columns]
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *parts))


def interleave_shards(
    df: DataFrame,
    n_shards: int,
    source: str = "source",
    key: str = "doc_id",
    seed: int = 7,
) -> DataFrame:
    """``df`` with ``shard`` (0 to n_shards - 1) and ``slot`` (gapless from 0).

    Shard sizes differ by one row at most, and a source's rows in a shard differ
    from its exact share by less than two. Null sources form a stratum of their
    own, null keys are ordered like any other. Repeated rows are all placed;
    rows equal in every column are interchangeable. An empty table gives an
    empty table. Columns called shard or slot in ``df`` are replaced; all others
    are kept whatever their names.
    """
    if n_shards < 1:
        raise ValueError("n_shards must be positive")
    df = df.drop("shard", "slot")
    names = df.columns
    total = df.count()
    buckets = max(1, math.isqrt(total))
    rows = df.select(
        F.struct(*[F.col(f"`{c}`") for c in names]).alias("_row"),
        F.col(f"`{source}`").alias("_src"),
        order_key(seed, f"`{key}`").alias("_h"),
    ).withColumns(
        {
            # ties of the key (repeated or null keys) fall by the whole row
            "_tie": F.xxhash64(*[F.col("_row").getField(c) for c, kind in df.dtypes if "map<" not in kind and kind != "variant"]),
            "_b": F.floor(F.conv(F.substring("_h", 1, 8), 16, 10).cast("long") * F.lit(buckets) / F.lit(1 << 32)).cast("int"),
        }
    )
    null_src = F.col("_src").isNull().cast("int").alias("_null")
    rows = rows.select("_row", "_h", "_tie", "_b", null_src, F.coalesce(F.col("_src").cast("string"), F.lit("")).alias("_s"))

    # offsets of (source, hash bucket), from pre-aggregated counts
    group = ["_null", "_s"]
    counts = rows.groupBy(*group, "_b").agg(F.count("*").alias("_c"))
    run = Window.partitionBy(*group).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(
        *group,
        "_b",
        F.coalesce(F.sum("_c").over(run), F.lit(0)).alias("_before"),
        F.sum("_c").over(Window.partitionBy(*group)).alias("_n"),
    )
    inner = Window.partitionBy(*group, "_b").orderBy("_h", "_tie")
    ranked = (
        rows.withColumn("_r", F.row_number().over(inner) - 1)
        .join(offsets, [*group, "_b"])
        .withColumn("_rank", F.col("_before") + F.col("_r"))
    )
    twice = F.col("_rank") * 2 + 1
    ranked = ranked.select(
        "_row", *group, "_rank",
        (twice / (F.col("_n") * 2)).alias("_f"),
        F.expr(f"(2 * _rank + 1) * {buckets}L div (2 * _n)").cast("long").alias("_q"),
    )

    # how many ranks of each source fall in each bucket of the fractional rank:
    # a closed form, one row for each bucket or each rank, whichever are fewer
    sizes = counts.groupBy(*group).agg(F.sum("_c").alias("_n"))
    steps = sizes.withColumn("_k", F.explode(F.expr(f"sequence(0L, least(_n, {buckets}L) - 1)")))
    first = f"((2 * _n * (_k) + {buckets}L - 1) div (2 * {buckets}L))"
    after = f"((2 * _n * (_k + 1) + {buckets}L - 1) div (2 * {buckets}L))"
    per_step = steps.select(
        F.expr(f"case when _n <= {buckets} then (2 * _k + 1) * {buckets}L div (2 * _n) else _k end").alias("_q"),
        F.expr(f"case when _n <= {buckets} then 1L else {after} - {first} end").alias("_c"),
    )
    filled = per_step.groupBy("_q").agg(F.sum("_c").alias("_c"))
    along = Window.orderBy("_q").rowsBetween(Window.unboundedPreceding, -1)
    starts = filled.select("_q", F.coalesce(F.sum("_c").over(along), F.lit(0)).alias("_start"))

    place = Window.partitionBy("_q").orderBy("_f", *group, "_rank")
    n = max(1, total)
    placed = (
        ranked.withColumn("_p", F.row_number().over(place) - 1)
        .join(starts, "_q")
        .withColumn("_pos", F.col("_start") + F.col("_p"))
        .withColumn("shard", F.expr(f"_pos * {n_shards}L div {n}L").cast("int"))
        .withColumn("slot", F.expr(f"_pos - (shard * {n}L + {n_shards - 1}L) div {n_shards}L").cast("long"))
    )
    return placed.select(*[F.col("_row").getField(c).alias(c) for c in names], "shard", "slot")
