import random
import re

import pytest

from gondola.llm import divergence, queries

TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(docs, least=30, smoothing=5, top=50):
    """docs: (lang, source, text), by comparing every pair over every term."""
    groups, seen, total = {}, {}, {}
    for lang, source, text in docs:
        lang, mine = lang or "", TERM.findall((text or "").translate(LOWER))
        group = groups.setdefault(lang, {}).setdefault(source or "", {})
        for t in mine:
            group[t] = group.get(t, 0) + 1
            total.setdefault(lang, {})[t] = total.get(lang, {}).get(t, 0) + 1
        for t in set(mine):
            seen.setdefault(lang, {})[t] = seen.get(lang, {}).get(t, 0) + 1
    out = []
    for lang, mine in groups.items():
        kept = [t for t, n in seen.get(lang, {}).items() if n >= least]

        def rates(counts):
            size = sum(counts.get(t, 0) for t in kept) + smoothing * len(kept)
            return {t: 1 + 10**9 * (counts.get(t, 0) + smoothing) // size for t in kept}

        q = rates(total.get(lang, {}))
        p = {s: rates(c) for s, c in mine.items()}
        for s in mine:
            pair = [(-sum(abs(p[s][t] - p[o][t]) for t in kept), o.encode()) for o in mine if o != s]
            term = [(q[t] - p[s][t], t.encode()) for t in kept if mine[s].get(t, 0) and p[s][t] > q[t]]
            for part, rows in (("pair", sorted(pair)), ("term", sorted(term)[:top])):
                out += [(lang, s, part, i.decode(), -v, k) for k, (v, i) in enumerate(rows, 1)]
    return sorted(out)


def flat(rows):
    return sorted(tuple(r[c] for c in ("lang", "source", "part", "item", "value", "rank")) for r in rows)


def test_query(spark, sf_dir, rows_of):
    docs = [(r["lang"], r["source"], r["text"]) for r in rows_of(queries.table(spark, sf_dir, "documents"))]
    assert flat(rows_of(queries.op11_source_divergence(spark, sf_dir))) == brute(docs)


@pytest.mark.parametrize("least,smoothing,top,held", [(1, 5, 3, 1 << 18), (2, 1, 50, 8), (10**6, 5, 50, 8)])
def test_odd_rows(odd, none, rows_of, monkeypatch, least, smoothing, top, held):
    monkeypatch.setattr(divergence, "HELD", held)
    docs = [(r["lang"], r["source"], r["text"]) for r in rows_of(odd)]
    out = rows_of(divergence.audit(odd.selectExpr("*", "1 as term", "2 as n", "'x' as item"), least, smoothing, top))
    assert flat(out) == brute(docs, least, smoothing, top) and any(r["part"] == "pair" for r in out)
    assert rows_of(divergence.audit(none, least, smoothing, top)) == []


def test_sources_of_all_sizes(spark, rows_of):
    """Rates above and below each other's baseline, sources without terms, ties."""
    rng = random.Random(6)
    words = [f"w{chr(97 + i)}{chr(97 + j)}" for i in range(8) for j in range(8)] + ["é", "Ünï", "ß"]
    docs = [("en", f"s{s}", " ".join(rng.choices(words, k=rng.randint(1, 4 ** (s % 5 + 1))))) for s in range(9) for _ in range(6)]
    docs += [("en", "none", "123 _ 4"), ("en", None, None), ("fr", "alone", "un deux"), ("fr", "other", ""), ("xx", "y", "a b")] + [("en", "twin1", "wab wab wac"), ("en", "twin2", "wab wab wac")]
    df = spark.createDataFrame(docs, "lang string, source string, text string").repartition(5)
    assert flat(rows_of(divergence.audit(df, 3))) == brute(docs, 3)
