import hashlib
import random

import numpy as np
import pytest

from gondola.llm import queries, repeated_windows, suffix_dedup


def brute(docs, length=50):
    words = [(t or "").encode().split() for _, t in docs]
    keys = [float("inf") if i is None else i for i, _ in docs]
    first = {}
    for k, w in zip(keys, words, strict=True):
        for at in range(len(w) - length + 1):
            s = tuple(w[at : at + length])
            first[s] = min(k, first.get(s, k))
    out = []
    for (i, _), k, w in zip(docs, keys, words, strict=True):
        gone = [False] * len(w)
        for at in range(len(w) - length + 1):
            if first[tuple(w[at : at + length])] < k:
                gone[at : at + length] = [True] * length
        kept = b" ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out.append((str(i), len(w), sum(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def flat(out):
    return sorted((str(r["doc_id"]), r["n_words"], r["n_removed"], hashlib.sha256(r["kept"].encode()).hexdigest()) for r in out)


def test_query(spark, sf_dir, rows_of):
    docs = [(r["doc_id"], r["text"]) for r in rows_of(queries.table(spark, sf_dir, "documents"))]
    out = rows_of(queries.op13_repeated_windows(spark, sf_dir))
    expected = brute(docs)
    assert sorted((str(r["doc_id"]), r["n_words"], r["n_removed"], r["kept_sha256"]) for r in out) == expected
    assert any(r[2] for r in expected)


@pytest.mark.parametrize("length", [50, 7, 1])
def test_odd_rows(odd, none, rows_of, length):
    docs = [(r["doc_id"], r["text"]) for r in rows_of(odd)]
    out = rows_of(repeated_windows.remove_repeated_windows(odd.withColumnRenamed("n_chars", "kept"), length))
    assert flat(out) == brute(docs, length) and set(out[0]) == {"doc_id", "text", "lang", "source", "n_words", "n_removed", "kept"}
    assert rows_of(repeated_windows.remove_repeated_windows(none, length)) == []


@pytest.mark.parametrize("hot", [0, 2000, 1 << 30])
def test_overlaps_hot_names_and_small_segments(spark, rows_of, monkeypatch, hot):
    rng = random.Random(2)
    prose = lambda n: " ".join(rng.choice("abc") + rng.choice("xyz") for _ in range(n))
    pieces = [prose(n) for n in (12, 49, 50, 51, 75, 120, 300)]
    docs = [(i, " ".join(rng.choice([*pieces, prose(9)]) + rng.choice(["", " one", "\t\ntwo  three"]) for _ in range(rng.randint(0, 5)))) for i in range(80)]
    docs += [(200 + i, "ab cd " * 60) for i in range(5)] + [(300, "a " * 500), (301, "a " * 49), (302, "a\x0b" * 50), (303, "a b " * 51), (7, pieces[4]), (None, pieces[5])]
    monkeypatch.setattr(suffix_dedup, "SEGMENT_BYTES", 2000)
    monkeypatch.setattr(repeated_windows, "HOT_BYTES", hot)
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    assert flat(rows_of(repeated_windows.remove_repeated_windows(df))) == brute(docs)


def test_a_phrase_in_all_documents_fills_no_bucket(spark, rows_of, monkeypatch):
    """A line that stands in all documents, each time between other words: its strings
    are told apart window by window, and no bucket gets them."""
    rng = random.Random(4)
    prose = lambda n: " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))
    line = prose(30)
    docs = [(i, f"{prose(60)} {line} {prose(60)}") for i in range(600)]
    made = {}

    def kept(df, name):
        made[name] = written(df, name)
        return made[name]

    written = repeated_windows.written
    monkeypatch.setattr(repeated_windows, "written", kept)
    monkeypatch.setattr(repeated_windows, "HOT_BYTES", 20_000)
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    assert all(r["n_removed"] == 0 for r in rows_of(repeated_windows.remove_repeated_windows(df)))
    hot = {r["name"] for r in rows_of(made["hot-names"])}
    sizes = {}
    for r in rows_of(made["strings"]):
        if r["name"] not in hot:
            sizes[r["name"]] = sizes.get(r["name"], 0) + len(r["packed"])
    assert hot and max(sizes.values(), default=0) <= 20_000


def test_ranks_are_exact():
    rng = np.random.default_rng(3)
    number = rng.integers(0, 2, 300)
    for length in (1, 2, 3, 7, 8):
        rank = repeated_windows.rank_windows(number, length)[: 300 - length + 1].tolist()
        windows = [tuple(number[i : i + length].tolist()) for i in range(300 - length + 1)]
        assert [rank[a] < rank[b] for a in range(0, 200, 7) for b in range(200)] == [windows[a] < windows[b] for a in range(0, 200, 7) for b in range(200)]
