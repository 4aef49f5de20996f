"""Toxicity by a weighted lexicon.

Texts are folded (case, homoglyphs, digits and signs that stand for letters), matched against the lexicon by one Aho-Corasick automaton, and scored
by the summed weights of the matches outside exception phrases, normalised by
length. The lexicon (whole words and word beginnings, with log odds ratios of their
rates as weights), the exception phrases (words that begin like an entry, and pairs
of words, of clean texts) and the scale are fitted on labelled rows.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gondola.llm.runtime import WORDS, drop_written, releasing, written

# Characters that pass for Latin letters, and what they pass for.
HOMOGLYPHS = {
    "а": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "ѐ": "e", "ё": "e", "һ": "h", "і": "i", "ї": "i",
    "ј": "j", "к": "k", "ӏ": "l", "м": "m", "н": "h", "о": "o", "р": "p", "ԛ": "q", "г": "r", "ѕ": "s",
    "т": "t", "у": "y", "ѵ": "v", "ԝ": "w", "х": "x", "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i",
    "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ω": "w", "ı": "i", "ɡ": "g",
    "ɑ": "a", "ℓ": "l",
}
# Digits and signs written for letters.
SUBSTITUTES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s"}
# Invisible characters set inside words.
INVISIBLE = "­​‌‍⁠﻿"


def _fold_table() -> dict[int, str | None]:
    table: dict[int, str | None] = {}
    for c in range(0x2000, 0x2070):  # general punctuation
        table[c] = " "
    for c in range(0xFF21, 0xFF3B):  # full width letters
        table[c] = table[c + 32] = chr(c - 0xFF21 + 97)
    table |= {ord(k): v for k, v in (HOMOGLYPHS | SUBSTITUTES).items()}
    table |= {ord(k): v for k, v in ((k.upper(), v) for k, v in HOMOGLYPHS.items()) if len(chr(ord(k))) == 1 and k != v.upper()}
    return table | {ord(c): None for c in INVISIBLE}


FOLD = _fold_table()


def fold(text: str | None) -> list[bytes]:
    """The folded words of a text, as UTF-8; none for null."""
    if not text:
        return []
    return text.lower().translate(FOLD).encode("utf-8", "replace").translate(WORDS).split()


@dataclass
class Lexicon:
    """entries: (" word " or " beginning", weight); exceptions: " word " or " two words ".

    Entries of a weight below 1 are faint: too rare to be sure of, they tell apart texts
    that have no others, and are not counted as matches. ``left_out`` counts what would
    have been entries or exceptions but for the limit, ``faint_left_out`` faint entries.
    """

    entries: dict[bytes, float] = field(default_factory=dict)
    exceptions: list[bytes] = field(default_factory=list)
    slope: float = 1.0
    offset: float = -4.0
    left_out: int = 0
    faint_left_out: int = 0

    def automaton(self) -> ahocorasick.Automaton:
        """Patterns with (length, weight, places of the words that they exempt)."""
        out = ahocorasick.Automaton()
        for pattern, weight in self.entries.items():
            out.add_word(pattern.decode("latin-1"), (len(pattern), weight, ()))
        for phrase in self.exceptions:
            exempt = tuple(i for i, c in enumerate(phrase[:-1]) if c == 32)
            out.add_word(phrase.decode("latin-1"), (len(phrase), self.entries.get(phrase, 0.0), exempt))
        if len(out):
            out.make_automaton()
        return out


def strength(words: list[bytes], automaton: ahocorasick.Automaton) -> tuple[float, int]:
    """Summed weights for each word (50 words are added to every text), and the number
    of matches."""
    if not words or not len(automaton):
        return 0.0, 0
    line = b" %s " % b" ".join(words)
    best: dict[int, float] = {}  # of entries that begin at one word, the strongest
    free: set[int] = set()
    for end, (length, weight, exempt) in automaton.iter(line.decode("latin-1")):
        start = end - length + 1
        free.update(start + i for i in exempt)
        if weight:
            best[start] = max(weight, best.get(start, 0.0))
    kept = [w for start, w in best.items() if start not in free]
    return sum(kept) / (len(words) + 50), sum(w >= 1 for w in kept)


def _features(words: list[bytes]) -> Counter:
    times = Counter(words)
    out = Counter({b" %s " % w: n for w, n in times.items() if len(w) <= LONGEST_WORD})
    for word, n in times.items():
        text = word.decode("utf-8", "replace")
        for size in range(3, min(LONGEST_BEGINNING + 1, len(text))):
            out[b" " + text[:size].encode()] += n
    return out


#: Parameters: bytes of an entry that is a word, letters of one that is a beginning.
LONGEST_WORD, LONGEST_BEGINNING = 64, 7
#: How often a feature counts in one text at most, so that no text speaks for many.
PER_TEXT = 4


def _count(batches: Iterator[pa.RecordBatch], features) -> Iterator[pa.RecordBatch]:
    """Per batch: each feature with its occurrences in toxic and other texts, and the
    texts of either kind that have it. The empty feature counts words."""
    for batch in (b.slice(at, 1024) for b in batches for at in range(0, b.num_rows, 1024)):
        seen, texts = (Counter(), Counter()), (Counter(), Counter())
        for text, toxic in zip(batch["text"].to_pylist(), batch["toxic"].to_pylist(), strict=True):
            side, words = 0 if toxic else 1, fold(text)
            found = features(words)
            texts[side].update(found.keys())
            seen[side].update({k: min(n, PER_TEXT) for k, n in found.items()})
            seen[side][b""] += len(words)
        keys = list(seen[0].keys() | seen[1].keys())
        yield pa.record_batch([pa.array(keys, pa.binary()), *[pa.array([x[k] for k in keys], pa.int64()) for x in (*seen, *texts)]], ["feature", "pos", "neg", "pos_texts", "neg_texts"])


def _contexts(words: list[bytes], starts: tuple[bytes, ...], whole: set[bytes]) -> Counter:
    """Each word that an entry matches, and it with its neighbours."""
    out = Counter()
    for i, w in enumerate(words):
        if w in whole or w.startswith(starts):
            out[b" %s " % w] += 1
            if i:
                out[b" %s %s " % (words[i - 1], w)] += 1
            if i + 1 < len(words):
                out[b" %s %s " % (w, words[i + 1])] += 1
    return out


def _words_that_begin(words: list[bytes], beginnings: set[bytes]) -> Counter:
    """Each word with one of the beginnings (" " and its letters)."""
    out = Counter()
    for word, n in Counter(words).items():
        text = word.decode("utf-8", "replace")
        if any(b" " + text[:size].encode() in beginnings for size in range(3, min(LONGEST_BEGINNING + 1, len(text)))):
            out[b" %s " % word] = n
    return out


#: Harmless words that a beginning may be excused at most.
EXCUSED = 2


def _excused(harmless: list, candidates: dict[bytes, tuple[int, int]]) -> dict[bytes, tuple[int, int]]:
    """Occurrences (toxic, other) of the beginnings that have one or two harmless words,
    without those words."""
    found: dict[bytes, list] = {}
    for r in harmless:
        text = bytes(r.feature)[1:-1].decode("utf-8", "replace")
        for size in range(3, min(LONGEST_BEGINNING + 1, len(text))):
            found.setdefault(b" " + text[:size].encode(), []).append(r)
    return {k: (max(0, p - sum(r.pos for r in found[k])), max(0, n - sum(r.neg for r in found[k]))) for k, (p, n) in candidates.items() if 0 < len(found.get(k, ())) <= EXCUSED}


def _choose(rows: list[tuple[bytes, float]], limit: int) -> tuple[dict[bytes, float], int]:
    """The surest features first; of two beginnings of which one begins the other, and
    of a beginning and its words, what is surer alone; but a beginning may follow its
    words. Also how many were left out for the limit."""
    chosen: dict[bytes, float] = {}
    starts: list[bytes] = []
    left_out = 0
    for feature, odds in rows:
        word = feature.endswith(b" ")
        if feature.startswith(tuple(starts)) or not word and any(x.startswith(feature) for x in starts):
            continue
        if len(chosen) == limit:
            left_out += 1
            continue
        chosen[feature] = odds
        if not word:
            starts.append(feature)
    return chosen, left_out


def _scale(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Logistic regression of y on x with a small ridge, by Newton steps."""
    design = np.c_[x, np.ones(len(x))]
    beta, ridge = np.zeros(2), np.diag([1e-3, 1e-3]) * max(1.0, len(x) / 100)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -30, 30)))
        grad = design.T @ (y - p) - ridge @ beta
        step = np.linalg.solve((design * (p * (1 - p))[:, None]).T @ design + ridge, grad)
        beta += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return float(max(beta[0], 1e-6)), float(beta[1])


def _place(x: np.ndarray | float) -> np.ndarray | float:
    return np.log(np.asarray(x) + 0.005)


def fit_lexicon(docs: DataFrame, labels: DataFrame, fit_rows: int = 20_000, limit: int = 4096, least: float = 2.0, support: int = 3) -> Lexicon:
    """Fit on at most ``fit_rows`` labelled documents (those with the smallest
    hashes of doc_id). ``labels``: doc_id and toxic, already cut to the rows
    that may be learned from; null labels and null ids are left out, and of
    several labels for one id the largest counts. With no labelled toxic or no
    other rows the lexicon is empty and every score is low.

    An entry stands in ``support`` toxic texts at least, and the log odds ratio of its rates
    less its standard error is ``least`` at least; rates have a prior of half an occurrence.
    The ``limit`` surest are entries, and of those in two toxic texts or short of ``least``
    as many are faint entries, with a fiftieth of their weight. A beginning is judged
    without its harmless words, if they are one or two. An exception stands in two clean texts at least
    and in four times as many as toxic ones; the ``limit`` most frequent are taken.
    """
    chosen = (
        labels.where("doc_id is not null and toxic is not null")
        .groupBy("doc_id")
        .agg(F.max("toxic").alias("toxic"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(fit_rows)
    )
    # at most fit_rows ids: the bound that lets them be broadcast
    sample = written(docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("text", (F.col("toxic") > 0).alias("toxic")).dropDuplicates(), "toxicity-fit")
    out = Lexicon()
    if {r.toxic for r in sample.select("toxic").distinct().collect()} != {True, False}:
        drop_written(sample)
        return out
    schema = "feature binary, pos long, neg long, pos_texts long, neg_texts long"

    def counted(features):
        found = sample.mapInArrow(releasing(lambda it: _count(it, features)), schema)
        return found.groupBy("feature").agg(*[F.sum(c).alias(c) for c in ("pos", "neg", "pos_texts", "neg_texts")])

    counts = written(counted(_features).where("pos_texts >= 2 or feature = X''"), "toxicity-counts")
    size = counts.where("feature = X''").first()
    odds = F.log((F.col("pos") + 0.5) / (size.pos + 1)) - F.log((F.col("neg") + 0.5) / (size.neg + 1))
    sure = odds - F.sqrt(1 / (F.col("pos") + 0.5) + 1 / (F.col("neg") + 0.5))
    ranked = counts.where("feature <> X''").select("feature", odds.alias("odds"), sure.alias("sure"), ((sure >= least) & (F.col("pos_texts") >= support)).alias("strong"))

    def first(strong: bool) -> tuple[list[tuple[bytes, float, float]], int]:
        some = ranked.where(F.col("strong") == strong).where("odds > 0")
        rows = some.orderBy(F.desc("sure"), F.desc(F.length("feature")), "feature").limit(8 * limit).collect()
        return [(bytes(r.feature), r.odds, r.sure) for r in rows], max(0, some.count() - 8 * limit)

    def odds_of(p: int, n: int) -> tuple[float, float]:
        value = math.log((p + 0.5) / (size.pos + 1)) - math.log((n + 0.5) / (size.neg + 1))
        return value, value - math.sqrt(1 / (p + 0.5) + 1 / (n + 0.5))

    strong, out.left_out = first(True)
    weak, out.faint_left_out = first(False)
    # a beginning that one or two harmless words keep below the bar is judged without
    # them: they become exceptions
    word_of = F.substring(F.col("feature"), F.length("feature"), F.lit(1)) == F.lit(b" ")
    open_ = {bytes(r.feature): (r.pos, r.neg) for r in counts.where((F.col("pos_texts") >= support) & ~word_of & (F.col("feature") != F.lit(b""))).join(ranked.where("not strong").select("feature"), "feature").orderBy(F.desc("pos"), "feature").limit(8 * limit).collect() if odds_of(r.pos, 0)[1] >= least}
    if open_:
        known = set(open_)
        own = counted(lambda words: _words_that_begin(words, known)).where("neg_texts >= 2 and neg_texts >= 4 * pos_texts and feature <> X''")
        for k, (p, n) in _excused(own.orderBy(F.desc("neg_texts"), "feature").limit(8 * limit).collect(), open_).items():
            value, sure_ = odds_of(p, n)
            if sure_ >= least and 2 * p > open_[k][0]:
                strong.append((k, value, sure_))
    strong.sort(key=lambda r: (-r[2], -len(r[0]), r[0]))
    out.entries, more = _choose([r[:2] for r in strong], limit)
    chosen, faint_more = _choose([r[:2] for r in weak if r[0] not in out.entries], limit)
    out.left_out, out.faint_left_out = out.left_out + more, out.faint_left_out + faint_more
    faint = {f: min(w / 50, 0.5) for f, w in chosen.items()}
    if out.entries:
        whole = {k.strip() for k in out.entries if k.endswith(b" ")}
        starts = tuple(k.strip() for k in out.entries if not k.endswith(b" "))
        harmless = written(counted(lambda words: _contexts(words, starts, whole)).where("neg_texts >= 2 and neg_texts >= 4 * pos_texts and feature <> X''"), "toxicity-exceptions")
        out.exceptions = [bytes(r.feature) for r in harmless.orderBy(F.desc("neg_texts"), "feature").limit(limit).collect()]
        out.left_out += max(0, harmless.count() - limit)
        drop_written(harmless)
    out.entries = faint | out.entries

    def strengths(batches):
        automaton = out.automaton()
        for batch in batches:
            x = [strength(fold(t), automaton)[0] for t in batch["text"].to_pylist()]
            yield pa.record_batch([pa.array(x, pa.float64()), batch["toxic"].cast(pa.float64())], ["x", "y"])

    scaled = sample.mapInArrow(releasing(strengths), "x double, y double").limit(fit_rows).toPandas()
    out.slope, out.offset = _scale(_place(scaled.x.to_numpy()), scaled.y.to_numpy())
    drop_written(sample, counts)
    return out


def score_toxicity(docs: DataFrame, lexicon: Lexicon, threshold: float = 0.7) -> DataFrame:
    """``docs`` with score (0 to 1), matches and predicted (1 from the threshold).

    Null and empty texts have no matches and get the score of a clean text.
    Rows are scored one by one: ties, repeated rows and other columns don't
    matter; columns of ``docs`` called like the three new ones are replaced.
    """
    docs = docs.drop("score", "n_matches", "predicted")
    schema = docs.select("*", F.lit(0.0).alias("score"), F.lit(0).alias("n_matches"), F.lit(0).alias("predicted")).schema
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = lexicon.automaton()
        for batch in batches:
            x = [strength(fold(t), automaton) for t in batch.column(at).to_pylist()]
            z = lexicon.slope * _place(np.array([v for v, _ in x], float)) + lexicon.offset
            score = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
            added = [pa.array(score, pa.float64()), pa.array([n for _, n in x], pa.int32()), pa.array((score >= threshold).astype(np.int32))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *added], names=[*batch.schema.names, "score", "n_matches", "predicted"])

    return docs.mapInArrow(releasing(run), schema)


def learnable(column: str = "doc_id"):
    """Rows whose labels may be learned from; the others are held out."""
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % 3 != 1, F.lit(True))
