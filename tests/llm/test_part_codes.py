import hashlib
import math

import numpy as np
import pytest

from gondola.llm import part_codes, queries


def brute(rows, parts=4, entries=256, rounds=4, scale=1024):
    """rows: (vec_id, vector, label), in plain whole-number loops."""
    kept = [(i, [math.floor(scale * float(x)) for x in v], y) for i, v, y in rows if v and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    if not kept:
        return []
    size = len(kept[0][1])
    kept = [r for r in kept if len(r[1]) == size]
    cuts = [size * i // parts for i in range(parts + 1)]
    split = [[tuple(v[a:b]) for a, b in zip(cuts, cuts[1:])] for _, v, _ in kept]
    books = [[s[p] for s in split[:entries]] for p in range(parts)]

    def near(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, e)), k) for k, e in enumerate(book))

    for _ in range(rounds):
        for p in range(parts):
            mine = {}
            for s in split:
                mine.setdefault(near(s[p], books[p])[1], []).append(s[p])
            books[p] = [tuple(sum(c) // len(mine[k]) for c in zip(*mine[k])) if k in mine else e for k, e in enumerate(books[p])]
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    out, sums = [], {}
    for (i, _, y), s in zip(kept, split):
        found = [near(x, b) for x, b in zip(s, books)]
        error = sum(d for d, _ in found)
        sums[y] = sums.get(y, 0) + error
        out.append((i, "".join(f"{k:02x}" for _, k in found), error, y))
    return sorted(str((i, code, error, sums[y], sha)) for i, code, error, y in out)


def flat(out):
    return sorted(str((r["vec_id"], r["code"], r["error"], r["label_error"], r["codebooks_sha256"])) for r in out)


def test_query_on_some_rows(spark, sf_dir, rows_of, tmp_path):
    """The query's parameters by plain loops; the whole table is compared in SQL."""
    some = queries.table(spark, sf_dir, "embeddings").where("vec_id < 300")
    some.write.parquet(f"{tmp_path}/embeddings.parquet")
    rows = [(r["vec_id"], r["embedding"], r["label"]) for r in rows_of(some)]
    assert flat(rows_of(queries.op12_part_codes(spark, str(tmp_path)))) == brute(rows)


@pytest.mark.parametrize("size,parts,entries,scale", [(8, 4, 16, 1024), (6, 4, 5, 3), (3, 4, 4, 10), (8, 2, 40, 1e9)])
def test_copies_ties_and_negative_parts(spark, rows_of, size, parts, entries, scale):
    rng = np.random.default_rng(size + entries)
    rows = [(i % 150, [float(x) / 2 for x in rng.integers(-3, 4, size)], int(i % 3) if i % 7 else None) for i in range(200)]
    rows += [(500 + i, [0.25] * size, 1) for i in range(100)] + [(None, [1.0] * size, None)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(4)
    made = rows_of(part_codes.compress(df, parts, entries, 3, scale))
    if scale * 1.5 < part_codes.LARGEST:
        assert flat(made) == brute(rows, parts, entries, 3, scale)
    assert len(made) == len(rows)


def test_far_components_in_64_bits(spark, rows_of):
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.integers(-60_000, 60_001, 64)], i % 2) for i in range(40)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    assert flat(rows_of(part_codes.compress(df, 4, 8, 4, 1024))) == brute(rows, 4, 8, 4, 1024)


def test_odd_rows(spark, rows_of):
    nan, inf = float("nan"), float("inf")
    rows = [(5, [1.0, 2.0, 3.0, 4.0], None), (1, None, 1), (2, [nan] * 4, 1), (3, [None, 1.0, 1.0, 1.0], 1), (4, [1.0, inf, 0.0, 0.0], 1), (7, [1.0], 1), (6, [0.5, -0.51, 0.0, 0.0], None), (8, [], 2), (9, [0.1] * 4, 2)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").selectExpr("*", "'x' as code", "'y' as part", "1 as row")
    out = rows_of(part_codes.compress(df))
    assert flat(out) == brute(rows) and {r["vec_id"] for r in out} == {5, 6, 9}
    assert all(r["error"] == 0 for r in out)
    assert rows_of(part_codes.compress(df.limit(0))) == [] and rows_of(part_codes.compress(df.where("vec_id < 5"))) == []
