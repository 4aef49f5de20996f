import zlib

import numpy as np
import pytest

from gondola.llm import queries, token_store

tokenizers = pytest.importorskip("tokenizers")


def expected(docs):
    library = tokenizers.Tokenizer.from_file(queries.tokenizer_path())
    out, start = [], 0
    for i, t in sorted(docs, key=lambda x: x[0]):
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 2]
        out.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def flat(rows):
    return sorted((r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) for r in rows)


def test_query(spark, sf_dir, rows_of):
    docs = [(r["doc_id"], r["text"]) for r in rows_of(queries.table(spark, sf_dir, "documents"))]
    assert flat(rows_of(queries.op10_token_files(spark, sf_dir))) == expected(docs)


def test_odd_rows_and_small_shards(odd, none, rows_of):
    for size in (100, 1 << 20):
        out = rows_of(token_store.read_tokens(token_store.write_tokens(odd, queries.tokenizer_path(), shard_tokens=size)))
        docs = [(-1 if r["doc_id"] is None else r["doc_id"], r["text"]) for r in rows_of(odd)]
        want = expected(docs)
        assert sorted((-1 if r["doc_id"] is None else r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in out) == sorted((i, n, c) for i, _, n, c in want)
        at = 0
        for r in sorted(out, key=lambda r: r["start"]):
            assert r["start"] == at
            at += r["n_tokens"]
    assert rows_of(token_store.read_tokens(token_store.write_tokens(none, queries.tokenizer_path()))) == []


def test_perfect_hash_and_keyed_access():
    rng = np.random.default_rng(4)
    keys = np.unique(rng.integers(-(1 << 62), 1 << 62, 5000))
    index = token_store.PerfectHash.build(keys)
    assert sorted(index.slots(keys).tolist()) == list(range(len(keys)))
    docs = [np.arange(i % 7, dtype="<u2") + i % 100 for i in range(len(keys))]
    sizes = np.array([len(d) for d in docs])
    shard = token_store.Shard(token_store.pack_shard(keys.tolist(), sizes, b"".join(d.tobytes() for d in docs), 2))
    assert all(np.array_equal(shard.get(int(k))[0], d) for k, d in zip(keys[:300], docs, strict=False))
    others = np.setdiff1d(rng.integers(-(1 << 62), 1 << 62, 5000), keys)
    assert (shard.rows(others)[1] > 0).mean() < 0.001
    with pytest.raises(ValueError):
        token_store.Shard(b"x" * 100)
