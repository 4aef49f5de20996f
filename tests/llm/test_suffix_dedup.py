import hashlib
import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from gondola.llm import queries, suffix_dedup
from gondola.llm.runtime import store_table


def brute(docs, length=50):
    first = {}
    for i, t in docs:
        t, key = (t or "").encode(), float("inf") if i is None else i
        for at in range(len(t) - length + 1):
            s = t[at : at + length]
            first[s] = min(key, first.get(s, key))
    out = []
    for i, t in docs:
        t, key = (t or "").encode(), float("inf") if i is None else i
        gone = np.zeros(len(t) + 1, bool)
        for at in range(len(t) - length + 1):
            if first[t[at : at + length]] < key:
                gone[at : at + length] = True
        spans = int((gone[:-1] & ~np.r_[False, gone[:-2]]).sum()) if t else 0
        kept = bytes(b for b, g in zip(t, gone.tolist(), strict=False) if not g)
        out.append((str(i), len(t), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def test_query(spark, sf_dir, rows_of):
    docs = [(r["doc_id"], r["text"]) for r in rows_of(queries.table(spark, sf_dir, "documents"))]
    out = rows_of(queries.op9_repeated_passages(spark, sf_dir))
    assert sorted((str(r["doc_id"]), r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in out) == brute(docs)


def flat(out):
    return sorted((str(r["doc_id"]), r["n_bytes"], r["n_removed"], r["n_spans"], hashlib.sha256(r["kept"]).hexdigest()) for r in out)


@pytest.mark.parametrize("length", [50, 8])
def test_odd_rows(odd, none, rows_of, length):
    docs = [(r["doc_id"], r["text"]) for r in rows_of(odd)]
    assert flat(rows_of(suffix_dedup.remove_repeats(odd.withColumnRenamed("n_chars", "kept"), length))) == brute(docs, length)
    assert rows_of(suffix_dedup.remove_repeats(none, length)) == []


def test_overlaps_and_small_segments(spark, rows_of, monkeypatch):
    rng = random.Random(2)
    pieces = ["".join(rng.choice("ab ") for _ in range(n)) for n in (20, 49, 50, 51, 75, 120, 300)]
    docs = [(i, "".join(rng.choice(pieces) + rng.choice(["", "x", "yz"]) for _ in range(rng.randint(0, 5)))) for i in range(80)]
    docs += [(200 + i, "ab" * 60) for i in range(5)] + [(300, "a" * 500), (301, "a" * 49), (302, "a" * 50), (303, "a" * 51)]
    monkeypatch.setattr(suffix_dedup, "SEGMENT_BYTES", 2000)
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    assert flat(rows_of(suffix_dedup.remove_repeats(df))) == brute(docs)


def test_sort_block_ranks_equal_starts():
    texts, ids = [b"abcabcab", b"bcabcxxx"], np.array([5, 3])
    first, limits = suffix_dedup.sort_block(texts, ids, 5)
    assert limits.tolist() == [0, 4, 8] and first.tolist() == [5, 3, 5, 5, 3, 3, 3, 3]


@pytest.mark.parametrize("bucket_bytes", [512, 1 << 17])
def test_frequent_strings_do_not_deal(spark, rows_of, monkeypatch, bucket_bytes):
    rng = random.Random(bucket_bytes)
    word = lambda n: "".join(rng.choice("abcdefghij") for _ in range(n))
    phrase, passage = word(29), word(90)
    docs = [(i, word(rng.randint(0, 120)) + rng.choice([phrase, passage, passage[20:], phrase + passage]) + word(rng.randint(0, 120))) for i in range(300)]
    monkeypatch.setattr(suffix_dedup, "SEGMENT_BYTES", 20_000)
    monkeypatch.setattr(suffix_dedup, "BUCKET_BYTES", bucket_bytes)
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    assert flat(rows_of(suffix_dedup.remove_repeats(df))) == brute(docs)


def test_a_common_phrase_fills_no_bucket(spark, rows_of, monkeypatch):
    rng = random.Random(4)
    word = lambda n: "".join(rng.choice("abcdefghij") for _ in range(n))
    phrase = word(29)
    docs = [(i, word(80) + phrase + word(80)) for i in range(4000)]
    made = {}

    def kept(df, name):
        made[name] = written(df, name)
        return made[name]

    written = suffix_dedup.written
    monkeypatch.setattr(suffix_dedup, "written", kept)
    monkeypatch.setattr(suffix_dedup, "BUCKET_BYTES", 1 << 14)
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    assert all(r["n_removed"] == 0 for r in rows_of(suffix_dedup.remove_repeats(df)))
    sizes = {}
    for r in rows_of(made["sorted-runs"]):
        sizes[r["bucket"]] = sizes.get(r["bucket"], 0) + len(r["bits"])
    assert sum(sizes.values()) > 10_000 and max(sizes.values()) < 0.1 * sum(sizes.values())


def test_cut_characters_go_whole_and_genuine_ones_stay(spark, rows_of):
    """By a plain loop over characters: one stays if all its bytes do, U+FFFD too."""
    rng = random.Random(8)
    prose = lambda n: "".join(rng.choice(["a", "é", "€", "\ufffd", " ", "😀"]) for _ in range(n))
    bits = [prose(n) for n in (30, 45, 80)]
    # the same continuation bytes after other first bytes, so that cuts fall inside characters
    docs = [(i, prose(5) + rng.choice(bits) + rng.choice("éĩũ") + rng.choice(bits) + prose(5)) for i in range(60)] + [(99, None), (100, ""), (101, "\ufffd")]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    seen, whole = {}, {r["doc_id"]: r for r in rows_of(suffix_dedup.remove_repeats(df, 50, whole_characters=True))}
    plain = {r["doc_id"]: r for r in rows_of(suffix_dedup.remove_repeats(df, 50))}
    cut = 0
    for i, t in docs:
        raw = (t or "").encode()
        gone = np.zeros(len(raw) + 1, bool)
        for at in range(len(raw) - 49):
            if seen.get(raw[at : at + 50], i) < i:
                gone[at : at + 50] = True
        for at in range(len(raw) - 49):
            seen.setdefault(raw[at : at + 50], i)
        out, at = b"", 0
        for c in t or "":
            size = len(c.encode())
            some = gone[at : at + size]
            cut += bool(some.any() and not some.all())
            out += b"" if some.any() else c.encode()
            at += size
        assert bytes(whole[i]["kept"]) == out and out.decode() is not None
        assert [whole[i][c] for c in ("n_bytes", "n_removed", "n_spans")] == [plain[i][c] for c in ("n_bytes", "n_removed", "n_spans")]
    assert cut


def most_bytes(run):
    """What is held at most during the call, beside what was before."""
    tracemalloc.start()
    try:
        run()
        return tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()


def test_a_bucket_takes_few_bytes_for_each_of_its_own():
    rng = np.random.default_rng(1)
    texts = [bytes(x) for x in rng.integers(97, 101, (500, 4000), dtype=np.uint8)]
    held = most_bytes(lambda: suffix_dedup.sort_block(texts, np.arange(len(texts)), 50))
    assert held < 50 * sum(map(len, texts))  # the strings themselves take 50 for each suffix


def test_a_segment_takes_few_bytes_for_each_of_its_own(tmp_path):
    rng = np.random.default_rng(2)
    texts = [bytes(x).decode() for x in rng.integers(97, 101, (1000, 4000), dtype=np.uint8)] + [None, "", "é" * 60]
    table = pa.table({"doc_id": pa.array(range(len(texts)), pa.int64()), "text": pa.array(texts)})
    store_table(path := f"file://{tmp_path}/segment", table)

    def steps():
        s = suffix_dedup.Segment(path, "doc_id", "text", 50)
        found, _, place = s.sample_names(4)
        start, count, _ = s.runs(s.candidates(np.ones(len(found), bool), place), np.empty(0, np.uint64), 4)
        gone = np.zeros(len(s.bytes), bool)
        gone[start] = True
        s.cut_characters(gone)

    assert most_bytes(steps) < 30 * sum(len(t or "") for t in texts)


def test_strings_of_one_name_are_told_apart(monkeypatch):
    rng = random.Random(6)
    texts = ["".join(rng.choice("ab") for _ in range(40)).encode() for _ in range(60)]
    ids = np.array([rng.randint(0, 99) for _ in texts])
    monkeypatch.setattr(suffix_dedup, "window_hashes", lambda a, n: np.zeros(len(a), np.uint64))
    first, _ = suffix_dedup.sort_block(texts, ids, 12)
    least = {}
    for t, i in zip(texts, ids.tolist(), strict=True):
        for at in range(len(t) - 11):
            least[t[at : at + 12]] = min(i, least.get(t[at : at + 12], i))
    assert first.tolist() == [least[t[at : at + 12]] for t in texts for at in range(len(t) - 11)]


def test_blocks_change_nothing(tmp_path, monkeypatch):
    """Blocks so small that documents, runs, classes and characters go over their ends."""
    rng = random.Random(7)
    bits = ["".join(rng.choice("abé€😀") for _ in range(n)) for n in (9, 30, 70)]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 4))) for _ in range(60)] + [None, ""]
    table = pa.table({"doc_id": pa.array(range(len(texts)), pa.int64()), "text": pa.array(texts)})
    store_table(path := f"file://{tmp_path}/segment", table)

    def steps():
        s = suffix_dedup.Segment(path, "doc_id", "text", 20)
        found, bucket, place = s.sample_names(3)
        wanted = s.candidates(np.arange(len(found)) % 5 == 0, place)
        hot = suffix_dedup.hot_keys(np.unique(s.hashes[s.hashes < suffix_dedup.DEALS])[::3], 3)
        start, count, least = s.runs(wanted, np.sort(hot), 3)
        part, _, ids, of = s.texts(start, count)
        first, limits = suffix_dedup.sort_block(part, ids, 20)
        gone = s.gone(start, count, limits[:-1][of], first < np.repeat(ids, np.diff(limits)), s.ids[s.doc(start)] > ids[of])
        return [s.samples, wanted, start, count, least, first, gone, s.cut_characters(gone), s.of_docs(gone)]

    whole = steps()
    assert all(x.any() for x in whole)
    for block in (1, 7, 64):
        monkeypatch.setattr(suffix_dedup, "BLOCK", block)
        assert all(np.array_equal(x, y) for x, y in zip(whole, steps(), strict=True))


@pytest.mark.parametrize("n", [8, 20, 50])
def test_hashes_at_the_end_of_the_last_block(monkeypatch, n):
    rng = np.random.default_rng(n)
    text = rng.integers(0, 256, 200, dtype=np.uint8)
    for block in (1 << 18, 64):
        monkeypatch.setattr(suffix_dedup, "BLOCK", block)
        for size in range(200):
            found = suffix_dedup.window_hashes(text[:size], n)
            assert len(found) == size
            assert all(found[at] == suffix_dedup.window_hashes(text[at : at + n], n)[0] for at in range(0, size - n + 1, 31))
