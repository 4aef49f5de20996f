"""Byte-pair encoding by backtracking, and decoding by an offset table.

The merges of a word are found without replaying them. An Aho-Corasick
automaton lists the tokens that occur in the word; from the left the longest is
taken that is compatible with the token before it, and a dead end takes back the
last token for its next shorter one. Two tokens are compatible if encoding their
joined text would give just these two, which depends on them alone and is kept in
a table; the sequence whose neighbours are all compatible is unique and is what
the merges give. Each place of a word is tried once, so the time is linear.
"""

from __future__ import annotations

import hashlib
import json
import os
import struct
import unicodedata
from collections.abc import Callable, Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gondola.llm.runtime import releasing

#: Stands for the end of a word inside the automaton: not a byte-level character.
_END = "￿"


def byte_characters() -> list[str]:
    """The printable character that stands for each byte in the vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class Chunks:
    """Cuts a text as the tokenizer file's normalizer and pre-tokenizer do.

    ``chunks`` are the pieces between white space, ``words`` what the model sees
    of one chunk. No word crosses white space, so a chunk can be looked up whole.
    """

    def __init__(self, spec: dict) -> None:
        kinds = [x["type"] for x in spec["normalizer"]["normalizers"]]
        split, level = spec["pre_tokenizer"]["pretokenizers"]
        if kinds != ["NFC", "Replace", "Lowercase"] or split["type"] != "Split" or level["type"] != "ByteLevel":
            raise ValueError("not a word-end BPE file")
        self.word = regex.compile(split["pattern"]["Regex"])
        self.space = regex.compile(r"\p{White_Space}+")
        self.pattern = split["pattern"]["Regex"]
        self.letters = r"[\p{L}]+" in self.pattern  # a piece of letters is one word
        self.assigned: set[str] = set()  # characters that this Python's Unicode tables know
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.mark = os.path.commonprefix([*self.special])
        self.specials = regex.compile("|".join(map(regex.escape, self.special)) or r"(?!)")

    def chunks(self, text: str) -> list[str]:
        if any(c in text for c in "\x1c\x1d\x1e\x1f"):  # space to str.split, not to Unicode
            return [x for x in self.space.split(text) if x]
        return text.split()

    def words(self, chunk: str) -> list[str]:
        if chunk.isascii():
            text = chunk.lower()
            return [text] if self.letters and text.isalpha() else self.word.findall(text)
        if not self.assigned.issuperset(chunk):
            known = {c for c in chunk if unicodedata.category(c) != "Cn"}
            self.assigned |= known
            if not known.issuperset(chunk):
                return self._words_of_newer(chunk)
        text = unicodedata.normalize("NFC", chunk)
        # letter by letter, so without the final form of sigma
        return self.word.findall(text.replace("Σ", "σ").lower())

    def _words_of_newer(self, chunk: str) -> list[str]:
        """Of characters that this Python's Unicode tables don't know: what they are is
        for the tables of the tokenizers library to say."""
        from tokenizers import Regex, normalizers, pre_tokenizers

        text = normalizers.Sequence([normalizers.NFC(), normalizers.Lowercase()]).normalize_str(chunk)
        return [x for x, _ in pre_tokenizers.Split(Regex(self.pattern), "removed", invert=True).pre_tokenize_str(text)]

    def parts(self, chunk: str) -> Iterator[tuple[int | None, list[str]]]:
        """(id, []) of special tokens in the chunk, (None, words) of the rest."""
        if self.mark not in chunk:
            yield None, self.words(chunk)
            return
        at = 0
        for m in self.specials.finditer(chunk):
            yield None, self.words(chunk[at : m.start()])
            yield self.special[m[0]], []
            at = m.end()
        yield None, self.words(chunk[at:])


class Known(dict):
    """What ``make`` gives for a string, kept for up to ``limit`` short ones."""

    def __init__(self, make: Callable[[str], bytes], limit: int) -> None:
        self.make, self.limit = make, limit

    def __missing__(self, key: str) -> bytes:
        made = self.make(key)
        if len(key) <= 64:
            if len(self) >= self.limit:
                self.clear()
            self[key] = made
        return made


class Pieces:
    """Ids of texts by their pieces between white space: each new piece is cut into
    words, and each new word goes to ``word``. ``code`` is an id's struct format."""

    def __init__(self, cut: Chunks, word: Callable[[str], list[int]], code: str, cache: int) -> None:
        self.cut, self.code = cut, code
        self.words = Known(lambda w: self.packed(word(w)), cache)
        self.pieces = Known(self._piece, cache)

    def packed(self, ids: list[int]) -> bytes:
        return struct.pack(f"<{len(ids)}{self.code}", *ids)

    def _piece(self, piece: str) -> bytes:
        words = self.words
        if self.cut.mark not in piece:
            return b"".join([words[w] for w in self.cut.words(piece)])
        return b"".join([b"".join([words[w] for w in found]) if special is None else self.packed([special]) for special, found in self.cut.parts(piece)])

    def encode(self, text: str | None) -> bytes:
        return b"".join(map(self.pieces.__getitem__, self.cut.chunks(text))) if text else b""


def byte_line(word: str, byte: list[str]) -> str:
    """A word as the vocabulary writes it, a printable character for each byte."""
    return word if word.isascii() and word.isprintable() else "".join([byte[b] for b in word.encode()])


class Bpe:
    """An encoder and decoder for a tokenizers file of BPE with word ends."""

    def __init__(self, path: str, cache: int = 300_000) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        suffix = model["end_of_word_suffix"]
        self.cut = Chunks(spec)
        self.byte = byte_characters()
        vocab: dict[str, int] = model["vocab"]
        size = max([*vocab.values(), *self.cut.special.values()]) + 1
        self.merged: dict[tuple[int, int], int] = {}
        self.rank = list(range(size))
        self.halves = [(i, i) for i in range(size)]
        for rank, merge in enumerate(model["merges"]):
            a, b = merge.split(" ") if isinstance(merge, str) else merge
            pair, token = (vocab[a], vocab[b]), vocab[a + b]
            self.merged[pair] = token
            self.halves[token] = pair
            if token != len(vocab) - len(model["merges"]) + rank:
                raise ValueError("token ids don't follow the order of the merges")
        self.fits: dict[tuple[int, int], bool] = {}  # the pair-compatibility table
        self.tokens = ahocorasick.Automaton()
        for text, token in vocab.items():
            if self._stands(token):
                inner = text[: -len(suffix)] + _END if text.endswith(suffix) and len(text) > len(suffix) else text
                self.tokens.add_word(inner, (len(inner), token))
        self.tokens.make_automaton()
        # the offset table: every token's text, a space after it, end to end
        names = [b""] * size
        for text, token in [*vocab.items(), *self.cut.special.items()]:
            names[token] = text.encode()
        self.texts = np.frombuffer(b"".join(n + b" " for n in names), np.uint8)
        self.offsets = np.r_[0, np.cumsum([len(n) + 1 for n in names])]
        self.pieces = Pieces(self.cut, self.word, "I", cache)

    def _compatible(self, a: int, b: int, limit: int) -> bool:
        """No merge across the border of a and b is due before ``limit`` and before
        the merges that made the parts next to the border."""
        merged, halves = self.merged, self.halves
        while True:
            joined = merged.get((a, b))
            if joined is not None and joined < limit:
                return False
            # undo the later of the two merges next to the border
            if a > b:
                limit, (_, last) = a, halves[a]
                if last != a:
                    a = last
                    continue
                limit = b + 1
                first = halves[b][0]
                if first == b:
                    return True
                b = first
            else:
                limit, (first, _) = b + 1, halves[b]
                if first != b:
                    b = first
                    continue
                limit = a
                last = halves[a][1]
                if last == a:
                    return True
                a = last

    def _stands(self, token: int) -> bool:
        """The merges give this token for its own text."""
        a, b = self.halves[token]
        return a == token or (self._stands_cached(a) and self._stands_cached(b) and self._compatible(a, b, token))

    def _stands_cached(self, token: int, known: dict[int, bool] | None = None) -> bool:
        known = self.__dict__.setdefault("_known", {})
        if token not in known:
            known[token] = self._stands(token)
        return known[token]

    def word(self, word: str) -> list[int]:
        """The ids of one word of the pre-tokenizer."""
        line = byte_line(word, self.byte) + _END
        n, fits = len(line), self.fits
        starts: list[list[tuple[int, int]]] = [[] for _ in range(n)]
        for end, (length, token) in self.tokens.iter(line):
            starts[end + 1 - length].append((length, token))  # shorter ones first
        out: list[int] = []
        at, ends = 0, []
        while at < n:
            options = starts[at]
            while options:
                length, token = options.pop()  # the longest not yet tried here
                if out:
                    pair = (out[-1], token)
                    ok = fits.get(pair)
                    if ok is None:
                        if len(fits) > 2_000_000:
                            fits.clear()
                        ok = fits[pair] = self._compatible(*pair, len(self.halves))
                    if not ok:
                        continue
                out.append(token)
                ends.append(at)
                at += length
                break
            else:
                if not out:
                    raise ValueError(f"no encoding of {word!r}")
                out.pop()
                at = ends.pop()
        return out

    def encode(self, text: str | None) -> bytes:
        """The ids of a text (null: none), as little-endian 32-bit words."""
        return self.pieces.encode(text)

    def decode(self, ids: bytes) -> bytes:
        """The UTF-8 text of little-endian ids: the tokens' texts, apart by spaces."""
        out = []
        tokens = np.frombuffer(ids, "<u4").astype(np.int64)
        for at in range(0, len(tokens), 1 << 18):  # bounds the gather's memory
            part = tokens[at : at + (1 << 18)]
            first, size = self.offsets[part], self.offsets[part + 1] - self.offsets[part]
            place = np.cumsum(size)
            out.append(self.texts[np.repeat(first - (place - size), size) + np.arange(place[-1])].tobytes())
        return b"".join(out)[:-1]


@lru_cache(maxsize=2)
def load(path: str) -> Bpe:
    """One encoder for each Python worker."""
    return Bpe(path)


def encode_documents(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with ids_sha256, decoded_sha256, n_tokens and ids (array of int).

    Null and empty texts have no tokens. Every row gives one row; other columns
    are kept, but for ones called like the four new ones, which are replaced.
    ``path`` is the tokenizer file, which all executors must have.
    """
    new = ["n_tokens", "ids", "ids_sha256", "decoded_sha256"]
    docs = docs.drop(*new)
    kinds = {"n_tokens": "long", "ids": "array<int>", "ids_sha256": "string", "decoded_sha256": "string"}
    schema = docs.select("*", *[F.lit(None).cast(kinds[c]).alias(c) for c in new]).schema
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for batch in batches:
            for start in range(0, batch.num_rows, 256):  # the ids are larger than the texts
                part = batch.slice(start, 256)
                coded = [bpe.encode(t) for t in part.column(at).to_pylist()]
                sizes = np.array([len(x) // 4 for x in coded], np.int64)
                ids = pa.array(np.frombuffer(b"".join(coded), "<u4").astype(np.int32))
                lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(sizes)].astype(np.int32)), ids)
                added = [pa.array(sizes), lists, pa.array([hashlib.sha256(x).hexdigest() for x in coded]), pa.array([hashlib.sha256(bpe.decode(x)).hexdigest() for x in coded])]
                yield pa.RecordBatch.from_arrays([*part.columns, *added], names=[*part.schema.names, *new])

    return docs.mapInArrow(releasing(run), schema)
