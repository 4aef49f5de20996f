import re
from fractions import Fraction

import numpy as np
import pytest
import xxhash

from gondola.llm import queries, simhash


def fingerprint(text, k=3):
    lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(nodes, linked):
    """Each node's smallest key; nodes: (key, value)."""
    root = list(range(len(nodes)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(nodes)):
        for b in range(a):
            if linked(nodes[a][1], nodes[b][1]):
                root[find(a)] = find(b)
    best = {}
    for i, (key, _) in enumerate(nodes):
        if key is not None:
            best[find(i)] = min(key, best.get(find(i), key))
    return [best.get(find(i)) for i in range(len(nodes))]


def expected(docs):
    nodes = [(i, fingerprint(t)) for i, t in docs]
    found = components(nodes, lambda a, b: (a ^ b).bit_count() <= 2)
    return sorted((str(i), f"{f:016x}", str(c)) for (i, f), c in zip(nodes, found, strict=True))


def test_query(spark, sf_dir, rows_of):
    docs = [(r["doc_id"], r["text"]) for r in rows_of(queries.table(spark, sf_dir, "documents"))]
    out = rows_of(queries.op8_simhash_components(spark, sf_dir))
    assert sorted((str(r["doc_id"]), r["fingerprint"], str(r["component_id"])) for r in out) == expected(docs)


def test_odd_rows(spark, odd, none, rows_of):
    docs = [(r["doc_id"], r["text"]) for r in rows_of(odd)] + [(900, "a\x0bb\x1cc d É"), (901, "A b\x1cC d é")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    out = rows_of(simhash.near_duplicates(df))
    assert sorted((str(r["doc_id"]), f"{r['fp'] & (1 << 64) - 1:016x}", str(r["component_id"])) for r in out) == expected(docs)
    assert rows_of(simhash.near_duplicates(none)) == []


@pytest.mark.parametrize("radius,cap", [(2, 4096), (2, 8), (1, 4)])
def test_dense_fingerprints_in_small_buckets(spark, rows_of, radius, cap):
    rng = np.random.default_rng(7)
    near = [1 << int(b) for b in rng.integers(0, 64, 60)] + [3 << int(b) for b in range(0, 60, 5)] + [0]
    fps = sorted({x if x < 1 << 63 else x - (1 << 64) for x in [*near, *(int(x) for x in rng.integers(0, 1 << 62, 40))]})
    df = spark.createDataFrame([(x,) for x in fps], "fp long")
    edges = [(r["src"], r["dst"]) for r in rows_of(simhash.near_edges(df, radius, cap))]
    assert all(((a ^ b) & (1 << 64) - 1).bit_count() <= radius for a, b in edges)
    linked = set(edges) | {(b, a) for a, b in edges}
    nodes = [(i, x) for i, x in enumerate(fps)]
    assert components(nodes, lambda a, b: (a, b) in linked) == components(nodes, lambda a, b: ((a ^ b) & (1 << 64) - 1).bit_count() <= radius)


def test_masks_cover_the_radius():
    for free, radius in (((1 << 64) - 1, 2), ((1 << 28) - 1, 4)):
        rng, tables = np.random.default_rng(1), simhash.masks(free, radius)
        assert len(tables) == 2 ** (radius + 1) - 1
        for _ in range(500):
            differ = sum(1 << int(b) for b in rng.choice(free.bit_length(), radius, replace=False))
            assert any(not m & differ for m in tables)


def edited(words, n, rng):
    out = list(words)
    for i in rng.choice(len(out), n, replace=False).tolist():
        out[i] += "q"
    return " ".join(out)


def test_wide_links_are_all_pairs_in_the_radius(spark, rows_of):
    rng = np.random.default_rng(3)
    docs = []
    for g in range(12):
        words = [f"w{g}x{x}" for x in rng.integers(0, 400, 150)]
        docs += [(len(docs) + i, edited(words, int(n), rng)) for i, n in enumerate(rng.integers(0, 9, 9))]
    docs += [(None, docs[0][1]), (500, None), (501, ""), (502, "one"), (502, "one")]
    fps = [int.from_bytes(simhash.wide_fingerprint((t or "").encode())) for _, t in docs]
    want = components([(i, f) for (i, _), f in zip(docs, fps, strict=True)], lambda a, b: (a ^ b).bit_count() <= 27)
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    out = rows_of(simhash.similar_documents(df))
    assert sorted((str(r["doc_id"]), str(r["component_id"])) for r in out) == sorted((str(i), str(c)) for (i, _), c in zip(docs, want, strict=True))
    assert simhash.wide_edges(df.selectExpr("encode(text, 'UTF-8') fp").limit(0), 27, per_cell=10).count() == 0
    kept = rows_of(simhash.keep_one(df))
    assert sorted(r["doc_id"] for r in kept) == sorted({c for c in want if c is not None})


def test_copies_are_found_and_others_left(spark, rows_of):
    rng = np.random.default_rng(9)
    docs = []
    for g in range(60):  # one word in 150 changed: similarity 0.93
        words = [f"w{x}" for x in rng.integers(0, 3000, 150)]
        docs += [(2 * g, " ".join(words)), (2 * g + 1, edited(words, 1, rng))]
    kept = rows_of(simhash.keep_one(spark.createDataFrame(docs, "doc_id long, text string")))
    assert sorted(r["doc_id"] for r in kept) == list(range(0, 120, 2))


def test_wide_fingerprints_count_a_shingle_once():
    rng = np.random.default_rng(11)
    line, far = " ".join(f"l{x}" for x in range(15)), []
    for _ in range(20):  # a line repeated, else different: set similarity below 0.1
        a, b = ((f"{line} " * 20 + " ".join(f"w{x}" for x in rng.integers(0, 10**6, 100))).encode() for _ in range(2))
        x, y = (int.from_bytes(simhash.wide_fingerprint(t)) for t in (a, b))
        far.append((x ^ y).bit_count())
    assert min(far) > 27


def test_a_repeated_line_deletes_no_documents(spark, rows_of):
    line = " ".join(f"l{x}" for x in range(15))
    docs = [(i, f"{line} " * 20 + " ".join(f"d{i}x{x}" for x in range(100))) for i in range(12)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert len(rows_of(simhash.keep_one(df))) == len(rows_of(simhash.keep_one(df, similarity=Fraction(4, 5)))) == 12


def test_thinned_edges_have_the_same_components(spark, rows_of, monkeypatch):
    from gondola.llm import components as c
    from gondola.llm.runtime import written

    rng = np.random.default_rng(12)
    pairs = [(int(a), int(b)) for a, b in rng.integers(0, 60, (3000, 2))] + [(1000 + int(a), 1000 + int(b)) for a, b in rng.integers(0, 400, (150, 2))]
    edges = written(spark.createDataFrame(pairs, "src long, dst long"), "edges-test")
    monkeypatch.setattr(c, "THINNED", 500)
    thin = written(c.thinned(edges), "thin-test")
    assert thin.count() < 800 and {tuple(r.values()) for r in rows_of(thin)} <= set(pairs)

    def classes(df):
        out = {}
        for r in rows_of(c.components(df)):
            out.setdefault(r["root"], set()).add(r["node"])
        return sorted(map(sorted, out.values()))

    assert classes(thin) == classes(edges)
    assert rows_of(c.thinned(edges.limit(0))) == []
