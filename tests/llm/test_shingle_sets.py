import re
from fractions import Fraction

import numpy as np
import pytest

import corpus_pipeline
from gondola.llm import shingle_sets, simhash


def grams(text, k=5):
    words = re.sub("[A-Z]", lambda m: m[0].lower(), text or "").split()
    return {tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))} if words else set()


def similarity(a, b):
    return Fraction(len(a & b), len(a | b)) if a | b else Fraction(1)


def smallest(docs):
    """The ids that stay, by comparing all pairs."""
    sets, root = [grams(t) for _, t in docs], list(range(len(docs)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(docs)):
        for b in range(a):
            if similarity(sets[a], sets[b]) >= Fraction(4, 5):
                root[find(a)] = find(b)
    best = {}
    for n, (i, _) in enumerate(docs):
        best[find(n)] = min(i, best.get(find(n), i))
    return sorted(best.values())


def stage(spark, docs, rows_of):
    frame = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in docs], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    return sorted(r["doc_id"] for r in rows_of(corpus_pipeline.drop_near_copies(spark, frame, "")))


def test_pairs_around_the_threshold(spark, rows_of):
    rng = np.random.default_rng(3)
    docs, seen = [], []
    for g in range(150):  # changed ends: similarities of 0.70 to 0.90
        words = [f"w{g}x{x}" for x in range(int(rng.integers(60, 160)))]
        n = len(words)
        cut = round(n * rng.uniform(0.05, 0.18))
        docs += [(2 * g, " ".join(words)), (2 * g + 1, " ".join(words[: n - cut] + [f"v{g}x{x}" for x in range(cut)]))]
        seen.append(similarity(grams(docs[-1][1]), grams(docs[-2][1])))
    assert sum(0.8 <= x < 0.85 for x in seen) > 10 and sum(0.7 <= x < 0.8 for x in seen) > 10
    assert stage(spark, docs, rows_of) == sorted([2 * g for g in range(150)] + [2 * g + 1 for g in range(150) if seen[g] < Fraction(4, 5)])


@pytest.mark.parametrize(("block", "star_from"), [(512, 4096), (7, 20)])
def test_hot_groups_and_chains(spark, rows_of, monkeypatch, block, star_from):
    exact = shingle_sets.exact_links
    monkeypatch.setattr(simhash, "exact_links", lambda *a: exact(*a, block=block, star_from=star_from))
    rng = np.random.default_rng(4)
    line, base = [f"l{x}" for x in range(30)], [f"b{x}" for x in range(120)]
    docs = [(1000 + i, " ".join(line + [f"d{i}x{x}" for x in range(20)])) for i in range(60)]  # a common line, else different
    for i in range(60):  # edited copies of one text, some of them only over others
        words = list(base)
        for at in rng.choice(120, int(rng.integers(0, 5)), replace=False).tolist():
            words[at] = f"e{i}x{at}"
        docs.append((2000 + i, " ".join(words)))
    chain = [f"c{x}" for x in range(160)]
    docs += [(3000 + i, " ".join(chain[6 * i : 6 * i + 100])) for i in range(10)]
    docs += [(1, None), (2, ""), (3, " \n"), (4, "one two"), (5, "One  TWO"), (6, "one two three"), (6, "one two three")]
    assert stage(spark, docs, rows_of) == smallest(docs)


def test_no_rows(spark, none, rows_of):
    assert rows_of(corpus_pipeline.drop_near_copies(spark, none, "")) == []
