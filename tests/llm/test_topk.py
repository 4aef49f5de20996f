import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from gondola.llm import queries, topk


def brute(vectors, queries_, k):
    out = {}
    for q in queries_:
        scored = sorted(((-int(np.dot(vectors[q], v)), i) for i, v in vectors.items() if i != q))[:k]
        out[q] = [(i, -s) for s, i in scored]
    return out


def as_lists(rows):
    out = {}
    for r in sorted(rows, key=lambda r: (r["query_id"], r["rank"])):
        assert r["rank"] == len(out.setdefault(r["query_id"], [])) + 1
        out[r["query_id"]].append((r["vec_id"], r["score"]))
    return out


def test_query(spark, sf_dir, rows_of):
    rows = rows_of(queries.table(spark, sf_dir, "embeddings"))
    ok = {r["vec_id"]: [math.floor(64 * float(x)) for x in r["embedding"]] for r in rows if r["embedding"] and all(x is not None and math.isfinite(x) for x in r["embedding"])}
    found = as_lists(rows_of(queries.op3_pivot_top_k(spark, sf_dir)))
    assert found == brute(ok, [i for i in ok if i % 20 == 0], 20)


@pytest.mark.parametrize("n,dim,k,block", [(400, 4, 5, 16), (400, 3, 30, 64), (12, 2, 20, 8)])
def test_small_blocks_and_ties(spark, rows_of, n, dim, k, block):
    rng = np.random.default_rng(n + dim)
    vectors = {i: [int(x) for x in rng.integers(-3, 4, dim)] for i in range(n)}
    vectors |= {n + i: [1] * dim for i in range(n // 3)}  # a third are equal
    df = spark.createDataFrame(list(vectors.items()), "vec_id long, v array<long>").repartition(3)
    found = as_lists(rows_of(topk.top_k(df.unionByName(df.limit(5)), F.col("vec_id") % 5 == 0, k, 100, block, 16)))
    assert found == brute(vectors, [i for i in vectors if i % 5 == 0], k)


def test_odd_rows(spark, rows_of):
    nan = float("nan")
    df = spark.createDataFrame([(0, [1.0, 2.0]), (20, None), (1, [nan, 1.0]), (2, [None, 1.0]), (None, [1.0, 1.0]), (3, [float("inf"), 0.0]), (4, [0.5, -0.51])], "vec_id long, embedding array<double>")
    clean = df.where(topk.usable("embedding")).select("vec_id", topk.quantised("embedding").alias("v"))
    found = rows_of(topk.top_k(clean, F.col("vec_id") % 20 == 0))
    assert [(r["query_id"], r["vec_id"], r["score"]) for r in found] == [(0, 4, 64 * 32 + 128 * math.floor(-0.51 * 64))]
    assert rows_of(topk.top_k(clean.limit(0), F.lit(True))) == []
    assert rows_of(topk.top_k(clean, F.lit(False))) == []


def test_clustered_vectors_are_pruned(spark, rows_of):
    rng = np.random.default_rng(9)
    middle = rng.integers(-300, 301, (12, 8))
    vectors = {i: (middle[i % 12] * (1 + i % 7) + rng.integers(-3, 4, 8)).tolist() for i in range(3000)}
    df = spark.createDataFrame(list(vectors.items()), "vec_id long, v array<long>").repartition(3)
    made = spark.sparkContext.accumulator(0)
    asked = [i for i in vectors if i % 20 == 0]
    found = as_lists(rows_of(topk.top_k(df, F.col("vec_id") % 20 == 0, 10, products=made)))
    assert found == brute(vectors, asked, 10)
    assert 0 < made.value < 0.5 * len(asked) * len(vectors)


def test_block_stops_at_its_bound():
    vectors = np.array([[i, 0] for i in range(1000)])
    block = topk.Block(np.arange(1000), vectors, np.abs(np.arange(1000) - 10.0), 10)
    at, found, score, made = topk.search_block(block, np.array([5000]), np.array([[999, 0]]), np.array([989.0]), np.array([-(1 << 62)]), 3)
    assert at.tolist() == [0, 0, 0] and found.tolist() == [999, 998, 997] and score.tolist() == [999 * 999, 999 * 998, 999 * 997]
    assert made <= 50


def test_other_columns_and_equal_ids(spark, rows_of):
    df = spark.createDataFrame([(0, [1, 0], 1.0, 7), (0, [0, 2], 2.0, 7), (1, [3, 1], 1.0, 8), (1, [3, 1], 1.0, 8), (2, [1, 1], 0.0, 9)], "vec_id long, v array<long>, d double, pivot int")
    found = as_lists(rows_of(topk.top_k(df, F.col("vec_id") == 0, 3)))
    assert found == {0: [(1, 3), (1, 2), (2, 2)]}
