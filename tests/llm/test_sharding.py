import zlib
from collections import Counter

from gondola.llm import queries, sharding


def test_query(spark, sf_dir, rows_of):
    docs = {r["doc_id"]: r for r in rows_of(queries.table(spark, sf_dir, "documents"))}
    out = rows_of(queries.op1_stratified_shards(spark, sf_dir))
    assert sorted(r["doc_id"] for r in out) == sorted(docs)
    for r in out:
        text = (docs[r["doc_id"]]["text"] or "").encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(text) + 1, zlib.crc32(text), "rows", None)
    shards = Counter(r["shard"] for r in out)
    assert set(shards) == set(range(16)) and max(shards.values()) - min(shards.values()) <= 1
    for s, n in shards.items():
        assert sorted(r["slot"] for r in out if r["shard"] == s) == list(range(n))


def test_every_shard_matches_the_mixture(spark, rows_of):
    rows = [(i, "hot" if i % 3 == 0 else f"s{i % 7}", i * 2) for i in range(1000)]
    out = rows_of(sharding.interleave_shards(spark.createDataFrame(rows, "doc_id long, source string, shard long"), 8))
    sizes, by = Counter(r["source"] for r in out), Counter((r["source"], r["shard"]) for r in out)
    assert all(abs(by[s, k] - n / 8) < 2 for s, n in sizes.items() for k in range(8))


def test_places_follow_the_fractional_rank(spark, rows_of):
    rows = [(i, "ab"[i % 5 == 0]) for i in range(200)]
    out = rows_of(sharding.interleave_shards(spark.createDataFrame(rows, "doc_id long, source string"), 1, seed=3))
    place = {r["doc_id"]: r["slot"] for r in out}
    key = {i: __import__("hashlib").md5(f"3:{i}".encode()).hexdigest() for i, _ in rows}
    expected = []
    for s in "ab":
        own = sorted((i for i, x in rows if x == s), key=key.get)
        expected += [((2 * r + 1) / (2 * len(own)), s, r, i) for r, i in enumerate(own)]
    assert [i for *_, i in sorted(expected)] == sorted(place, key=place.get)


def test_odd_rows(odd, none, rows_of):
    out = rows_of(sharding.interleave_shards(odd, 5))
    assert len(out) == odd.count() and set(out[0]) == {*odd.columns, "shard", "slot"}
    assert max(Counter(r["shard"] for r in out).values()) - min(Counter(r["shard"] for r in out).values()) <= 1
    assert rows_of(sharding.interleave_shards(none, 5)) == []
    assert sorted(map(str, rows_of(sharding.interleave_shards(odd.repartition(7), 5)))) == sorted(map(str, out))
