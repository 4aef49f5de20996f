import hashlib
import re

from gondola.llm import decontam, queries


def words(text):
    lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)


def brute(docs, items, size=13):
    windows = {}
    for name, text in items:
        w = words(text)
        n = min(size, len(w))
        for i in range(len(w) - n + 1 if w else 0):
            windows.setdefault(tuple(w[i : i + n]), set()).add(name)
    sizes = {len(w) for w in windows}
    out = []
    for doc_id, text in docs:
        w, hit, found = words(text), set(), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                if names := windows.get(tuple(w[i : i + n])):
                    hit.update(range(i, i + n))
                    found |= names
        out.append((str(doc_id), len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out)


def test_query(spark, sf_dir, rows_of):
    docs = [(r["doc_id"], r["text"]) for r in rows_of(queries.table(spark, sf_dir, "documents"))]
    items = [(str(r["item_id"]), r["text"]) for r in rows_of(queries.table(spark, sf_dir, "benchmark"))]
    out = rows_of(queries.op7_decontamination(spark, sf_dir))
    assert sorted((str(r["doc_id"]), r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) for r in out) == brute(docs, items)
    assert any(r["contaminated"] for r in out)


def fixture(spark):
    filler = " ".join(f"w{i}" for i in range(40))
    passage = "a b c d e f g h i j k l m n o p"
    docs = [(1, passage), (2, f"{filler} {passage} {filler}"), (3, "A-B c; d"), (4, None), (None, "x y z"), (5, ""), (6, passage[:20]), (6, passage[:20]), (7, "x x x y z " * 30), (8, "a b x d")]
    items = [("i1", passage), ("i2", "x y z"), ("i2", "x y z"), ("i3", None), ("i4", "?!"), (None, "c d")]
    return docs, items, spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id string, text string")


def flat(found):
    return sorted((str(r["doc_id"]), r["n_words"], r["n_hit"], r["n_items"], hashlib.sha256(",".join(r["item_ids"]).encode()).hexdigest(), r["contaminated"]) for r in found)


def test_odd_rows_and_blocks(spark, none, odd, rows_of):
    docs, items, d, i = fixture(spark)
    expected = brute(docs, [("null" if n is None else n, t) for n, t in items])
    index = decontam.build_index(d.repartition(3))
    assert flat(rows_of(decontam.contamination(decontam.search(index, i)))) == expected
    assert flat(rows_of(decontam.contamination(decontam.search(index, i, block_bytes=16)))) == expected
    assert all(r["n_hit"] == 0 for r in rows_of(decontam.contamination(decontam.search(index, i.limit(0)))))
    assert rows_of(decontam.search(decontam.build_index(none), i)) == []
    assert len(rows_of(decontam.search(decontam.build_index(odd), i))) == odd.count()


def test_proximity(spark, rows_of):
    docs = [(1, "alpha x x beta y gamma"), (2, "alpha x x x x x x x beta gamma"), (3, "gamma beta alpha"), (4, "alpha beta")]
    index = decontam.build_index(spark.createDataFrame(docs, "doc_id long, text string"))
    found = rows_of(decontam.search(index, spark.createDataFrame([("q", "alpha beta gamma")], "item_id string, text string"), slop=5))
    assert sorted(r["doc_id"] for r in found if r["item_ids"]) == [1, 3]


def test_equal_segments_keep_their_rows(spark, rows_of):
    docs, items, d, i = fixture(spark)
    expected = sorted(2 * brute(docs, [("null" if n is None else n, t) for n, t in items]))
    twice = spark.createDataFrame(spark.sparkContext.parallelize(docs + docs, 2), d.schema)
    index = decontam.build_index(twice)
    assert index.count() == 2
    for block_bytes in (16, decontam.BLOCK_BYTES):
        assert flat(rows_of(decontam.contamination(decontam.search(index, i, block_bytes=block_bytes)))) == expected
