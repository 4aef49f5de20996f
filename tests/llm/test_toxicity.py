import zlib

import numpy as np

from gondola.llm import queries, toxicity


def test_folding():
    assert toxicity.fold("W0RTHLEЅS, wоrth​less!") == [b"worthless", b"worthless"]
    assert toxicity.fold(None) == toxicity.fold("") == []


def test_exceptions_and_length():
    lexicon = toxicity.Lexicon({b" vile ": 2.0, b" scum": 1.0}, [b" vile weather "])
    a = lexicon.automaton()
    assert toxicity.strength(toxicity.fold("such vile scumbags"), a)[1] == 2
    assert toxicity.strength(toxicity.fold("such vile weather"), a) == (0.0, 0)
    short, long = (toxicity.strength(toxicity.fold("vile " + "word " * n), a)[0] for n in (5, 5000))
    assert short > long > 0


def test_query_separates_held_out_labels(spark, rows_of):
    sf_dir = "/root/testdata/sf0.01"
    out = {r["doc_id"]: r for r in rows_of(queries.op2_toxicity(spark, sf_dir))}
    labels = {r["doc_id"]: r["toxic"] for r in rows_of(queries.table(spark, sf_dir, "labels"))}
    assert len(out) == queries.table(spark, sf_dir, "documents").count()
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for i, r in out.items())
    held = [(out[i]["score"], y) for i, y in labels.items() if out[i]["held_out"]]
    pos, neg = (np.array([s for s, y in held if y == k]) for k in (1, 0))
    assert (pos[:, None] > neg).mean() > 0.9
    assert (neg >= 0.7).mean() < 0.02


def test_odd_rows(spark, odd, none, rows_of):
    labels = spark.createDataFrame([(1, 1), (2, 0), (None, 1), (3, None), (6, 1)], "doc_id long, toxic int")
    lexicon = toxicity.fit_lexicon(odd, labels)
    out = rows_of(toxicity.score_toxicity(odd.withColumnRenamed("n_chars", "score"), lexicon))
    assert len(out) == odd.count() and all(0 <= r["score"] <= 1 for r in out)
    assert rows_of(toxicity.score_toxicity(none, lexicon)) == []
    assert toxicity.fit_lexicon(none, labels).entries == {}
    assert toxicity.fit_lexicon(odd, labels.limit(0)).entries == {}


def naive(words, lexicon):
    """Every pattern at every word, by plain loops."""
    line, at, total, n = " " + " ".join(w.decode() for w in words) + " ", 1, 0.0, 0
    exempt = set()
    for phrase in lexicon.exceptions:
        for i in range(len(line)):
            if line.startswith(phrase.decode(), i):
                exempt.update(i + j for j, c in enumerate(phrase.decode()[:-1]) if c == " ")
    for word in words:
        weights = [v for p, v in lexicon.entries.items() if line.startswith(p.decode(), at - 1)]
        if weights and at - 1 not in exempt:
            total, n = total + max(weights), n + (max(weights) >= 1)
        at += len(word) + 1
    return total / (len(words) + 50), n


def test_strength_against_plain_loops():
    rng = np.random.default_rng(8)
    syllables = ["ba", "bab", "du", "dud", "o"]
    word = lambda: "".join(rng.choice(syllables, rng.integers(1, 4))).encode()
    for _ in range(200):
        entries = {b" %s%s" % (word(), rng.choice([b"", b" "])): float(rng.uniform(0.01, 4)) for _ in range(12)}
        exceptions = [b" %s " % b" ".join(word() for _ in range(rng.integers(1, 3))) for _ in range(6)]
        lexicon, words = toxicity.Lexicon(entries, exceptions), [word() for _ in range(rng.integers(1, 40))]
        found, expected = toxicity.strength(words, lexicon.automaton()), naive(words, lexicon)
        assert abs(found[0] - expected[0]) < 1e-12 and found[1] == expected[1]


def test_exceptions_are_fitted(spark):
    rng = np.random.default_rng(9)
    filler = lambda n: " ".join(f"w{x}" for x in rng.integers(0, 400, n))
    texts = [(i, f"{filler(40)} vilescum{i % 7} {filler(20)} vilescum{i % 5}", 1) for i in range(40)]
    texts += [(100 + i, f"{filler(60)} vilesculpture {filler(20)}" if i % 3 == 0 else filler(60), 0) for i in range(120)]
    lexicon = toxicity.fit_lexicon(spark.createDataFrame([x[:2] for x in texts], "doc_id long, text string"), spark.createDataFrame([(i, y) for i, _, y in texts], "doc_id long, toxic int"))
    assert b" vilesculpture " in lexicon.exceptions and lexicon.left_out == 0
    a = lexicon.automaton()
    assert toxicity.strength(toxicity.fold("a vilesculpture here"), a)[1] == 0 and toxicity.strength(toxicity.fold("a vilescum9 here"), a)[1] == 1
