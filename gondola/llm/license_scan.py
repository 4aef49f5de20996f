"""Fuzzy search for short licence notices.

A notice that occurs with at most e edits leaves one of any e + 1 pieces of it
untouched (pigeonhole). All pieces of all notices are sought at once by an
Aho-Corasick automaton over the normalised text; where one is found, the regex
library's bounded-error matching verifies the notice around it and gives the
span and its edits. An exact occurrence contains every piece, so it is found
and then checked word by word.

An edited notice must begin and end with words of the text, hold the words that tell
its licence from others unedited, and not overlap an exact notice of another label.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gondola.llm.runtime import WORDS, utf8

# Label and notice, as words apart by one space.
BASE_NOTICES = (
    ("mit", "mit license"),
    ("apache", "apache license"),
    ("gpl", "general public license"),
)
# Further notices that the search knows.
NOTICES = (
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy"),
    ("apache", "licensed under the apache license version 2 0"),
    ("gpl", "gnu general public license version 3"),
    ("lgpl", "gnu lesser general public license"),
    ("agpl", "gnu affero general public license"),
    ("bsd", "redistribution and use in source and binary forms"),
    ("bsd", "3 clause bsd license"),
    ("mpl", "mozilla public license"),
    ("isc", "permission to use copy modify and or distribute this software"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-sa", "licensed under cc by sa 4 0"),
    ("cc-by", "creative commons attribution 4 0 international license"),
)


# Words that tell notices apart, which are never edited.
TELLING = frozenset("mit apache gnu lesser affero bsd mozilla nc sa attribution version 0 2 3 4 copy modify binary unencumbered".split())


@dataclass(frozen=True)
class Notice:
    label: str
    words: str
    base: bool
    edits: int

    @property
    def telling(self) -> frozenset[str]:
        return TELLING.intersection(self.words.split())

    @property
    def pieces(self) -> list[tuple[int, str]]:
        """edits + 1 pieces of near equal length, with their offsets."""
        n = len(self.words)
        cuts = [n * i // (self.edits + 1) for i in range(self.edits + 2)]
        return [(a, self.words[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


def notices(per_edit: int = 11, most: int = 4) -> list[Notice]:
    """All notices; one edit allowed for each ``per_edit`` characters."""
    known = [(label, words, True) for label, words in BASE_NOTICES] + [(label, words, False) for label, words in NOTICES]
    return [Notice(label, words, base, min(most, max(1, len(words) // per_edit))) for label, words, base in known]


class Scanner:
    def __init__(self, known: list[Notice]) -> None:
        self.known = known
        self.seeds = ahocorasick.Automaton()
        for i, notice in enumerate(known):
            for offset, piece in notice.pieces:
                self.seeds.add_word(piece, [*self.seeds.get(piece, []), (i, offset, len(piece))])
        self.seeds.make_automaton()
        # between borders of words, which edits can't move
        self.patterns = [regex.compile(rf"(?b)(?<![^ ])(?:{regex.escape(x.words)}){{e<={x.edits}}}(?![^ ])") for x in known]

    def spans(self, line: str) -> list[tuple[int, int, int, int, bool]]:
        """(notice, start, end, edits, whole words) in a normalised line."""
        out: dict[tuple[int, int], tuple[int, int, int, int, bool]] = {}
        looked: dict[int, int] = {}  # by notice: where the last fuzzy look ended
        for end, owners in self.seeds.iter(line):
            for i, offset, length in owners:
                notice = self.known[i]
                at = end + 1 - length - offset
                stop = at + len(notice.words)
                if at >= 0 and line.startswith(notice.words, at):
                    whole = (at == 0 or line[at - 1] == " ") and (stop == len(line) or line[stop] == " ")
                    out[i, at] = (i, at, stop, 0, whole)
                    continue
                low = line.rfind(" ", 0, max(0, at - notice.edits)) + 1  # whole words of the text
                high = line.find(" ", min(len(line), stop + notice.edits))
                low, high = max(low, looked.get(i, 0)), high if high >= 0 else len(line)
                if high - low < len(notice.words) - notice.edits:
                    continue
                if m := self.patterns[i].search(line, low, high):
                    edits = sum(m.fuzzy_counts)
                    if edits and notice.telling.issubset(m[0].split(" ")):
                        out.setdefault((i, m.start()), (i, m.start(), m.end(), edits, False))
                        looked[i] = m.end()
        return sorted(self._apart(list(out.values())), key=lambda x: (x[1], x[0]))

    def _apart(self, found: list[tuple[int, int, int, int, bool]]) -> list[tuple[int, int, int, int, bool]]:
        """Without edited notices that overlap an exact one of another label."""
        exact = sorted((start, end, self.known[i].label) for i, start, end, edits, whole in found if whole and not edits)
        starts, most = [x[0] for x in exact], max((end - start for start, end, _ in exact), default=0)

        def over(i: int, start: int, end: int) -> bool:
            near = exact[bisect_left(starts, start - most) : bisect_left(starts, end)]
            return any(stop > start and label != self.known[i].label for _, stop, label in near)

        return [x for x in found if not x[3] or not over(*x[:3])]


SPANS = "array<struct<label:string,notice:string,start_word:long,n_words:long,edits:int,base:boolean>>"


def scan_notices(docs: DataFrame, known: list[Notice] | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_words, spans): every place of a notice in each whole text.

    A span gives label, notice, first word (from 0), words touched, edits, and
    whether it is a base phrase's words exactly. Null and empty texts have no
    words and no spans; every row gives one row, repeated and null keys included;
    other columns are ignored.
    """
    known = known or notices()
    schema = docs.select(F.col(key), F.lit(0).cast("long").alias("n_words"), F.lit(None).cast(SPANS).alias("spans")).schema
    kinds = pa.list_(pa.struct([("label", pa.string()), ("notice", pa.string()), ("start_word", pa.int64()), ("n_words", pa.int64()), ("edits", pa.int32()), ("base", pa.bool_())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(known)
        for batch in batches:
            sizes, found = [], []
            for raw in utf8(batch.column(1)):
                words = raw.translate(WORDS).split() if raw else []
                line = b" ".join(words).decode("latin-1")  # a character for each byte
                sizes.append(len(words))
                spans, at, passed = [], 0, 0
                for i, start, end, edits, whole in scanner.spans(line):
                    passed += line.count(" ", at, start)
                    at = start
                    notice = known[i]
                    if edits or whole:
                        spans.append({"label": notice.label, "notice": notice.words, "start_word": passed, "n_words": line.count(" ", start, end) + 1, "edits": edits, "base": notice.base and whole})
                found.append(spans)
            yield pa.record_batch([batch.column(0), pa.array(sizes, pa.int64()), pa.array(found, kinds)], [key, "n_words", "spans"])

    return docs.select(key, text).mapInArrow(run, schema)


def labelled(scanned: DataFrame) -> DataFrame:
    """``scanned`` with n_base, first_word, last_word, base_labels, labels, score.

    score: the best span's share of untouched characters, 0 where there is none.
    """
    base = F.filter("spans", lambda s: s["base"])
    starts = F.transform(base, lambda s: s["start_word"])
    names = lambda spans: F.concat_ws(",", F.array_sort(F.array_distinct(F.transform(spans, lambda s: s["label"]))))
    best = F.array_max(F.transform("spans", lambda s: 1 - s["edits"] / F.length(s["notice"])))
    return scanned.withColumns(
        {
            "n_base": F.size(base).cast("long"),
            "first_word": F.array_min(starts),
            "last_word": F.array_max(starts),
            "base_labels": names(base),
            "labels": names(F.col("spans")),
            "score": F.coalesce(best, F.lit(0.0)).cast("double"),
        }
    )
