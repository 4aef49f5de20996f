"""Benchmark decontamination with a distributed positional inverted index.

:func:`build_index` stores the token postings of the corpus in segment files in
the shared folder: a segment has whole documents, its own vocabulary and, term by
term, the positions of each term. :func:`search` takes benchmark texts against
it. For each phrase a segment starts from the term with the shortest posting
list, shifts every further list by its term's offset and intersects, rarest
first; what remains are the exact places. Proximity search keeps the places of
the rarest term near which all other terms occur.

Only the names of files travel between tasks. A task holds one segment and one
block of the benchmark at a time, so memory depends on neither table's size;
segments are independent, so a search needs no shuffle of postings, and a lost
task is simply run again.
"""

from __future__ import annotations

import itertools
import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gondola.llm.runtime import new_path, open_table, releasing, spread, store_table, tokens, utf8, written

#: Text bytes of a segment, and of a block of the benchmark.
SEGMENT_BYTES = 4 << 20
BLOCK_BYTES = 4 << 20


def _segment(ids: list[int | None], places: list[np.ndarray], lengths: list[int], terms: dict[bytes, int]) -> pa.Table:
    seen = np.concatenate([np.empty(0, np.int32), *places])
    order = np.argsort(seen, kind="stable").astype(np.int32)  # positions, term by term
    sizes = np.bincount(seen, minlength=1)[list(terms.values())] if len(seen) else np.empty(0, np.int64)
    known = np.array([x if x is not None else 0 for x in ids], np.int64)
    missing = np.array([x is None for x in ids], bool)
    parts = {
        "doc_ids": known.tobytes(),
        "null_ids": np.packbits(missing).tobytes(),
        "lengths": np.array(lengths, np.int32).tobytes(),
        "terms": b" ".join(terms),
        "sizes": sizes.astype(np.int32).tobytes(),
        "gaps": np.diff(order, prepend=np.int32(0)).tobytes(),
    }
    return pa.table({k: pa.array([v], pa.large_binary()) for k, v in parts.items()})


def _index(batches: Iterator[pa.RecordBatch], out: str) -> Iterator[pa.RecordBatch]:
    ids: list[int | None] = []
    places: list[np.ndarray] = []  # words as the place where their term was first seen
    lengths: list[int] = []
    terms: dict[bytes, int] = {}
    size = n = 0

    def flush() -> pa.RecordBatch:
        path = f"{out}/{uuid.uuid4().hex}.arrow"  # not of the content: segments may be equal
        store_table(path, _segment(ids, places, lengths, terms))
        return pa.record_batch([pa.array([path]), pa.array([len(ids)], pa.int64()), pa.array([size], pa.int64())], ["segment", "n_docs", "size"])

    for batch in batches:
        for at in range(0, batch.num_rows, 256):  # few texts at a time as objects
            part = batch.slice(at, 256)
            for doc_id, text in zip(part.column(0).to_pylist(), utf8(part.column(1)), strict=True):
                more = len(text or b"") + 16
                if ids and size + more > SEGMENT_BYTES:
                    yield flush()
                    ids, places, lengths, terms, size, n = [], [], [], {}, 0, 0
                before = n
                for found in tokens(text):
                    places.append(np.fromiter(map(terms.setdefault, found, itertools.count(n)), np.int32, len(found)))
                    n += len(found)
                ids.append(doc_id)
                lengths.append(n - before)
                size += more
    if ids:
        yield flush()


def build_index(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The list of segments (segment: path, n_docs, size), written in the shared folder
    like the segments.

    Every row of ``docs`` is in one segment, whatever its key: null and repeated
    keys and null or empty texts included. A document longer than a segment's
    size has a segment to itself. Keys are integers; other columns are ignored.
    Files of a task that was lost are not in the list.
    """
    out = new_path(docs.sparkSession, "postings")
    return written(docs.select(F.col(key).cast("long"), text).mapInArrow(releasing(lambda it: _index(it, out)), "segment string, n_docs long, size long"), "segment-list")


class Segment:
    """A segment file, opened."""

    def __init__(self, path: str) -> None:
        table = open_table(path)
        row = {c: table[c][0].as_buffer() for c in table.column_names}
        self.lengths = np.frombuffer(row["lengths"], np.int32)
        known = np.frombuffer(row["doc_ids"], np.int64)
        missing = np.unpackbits(np.frombuffer(row["null_ids"], np.uint8), count=len(known)).astype(bool)
        self.doc_ids = pa.array(known, mask=missing)
        self.starts = np.r_[0, np.cumsum(self.lengths, dtype=np.int64)]
        self.terms = dict(zip(row["terms"].to_pybytes().split(), itertools.count()))
        self.ends = np.cumsum(np.frombuffer(row["sizes"], np.int32), dtype=np.int64)
        self.begins = np.r_[0, self.ends[:-1]]
        self.positions = np.cumsum(np.frombuffer(row["gaps"], np.int32), dtype=np.int32)

    def postings(self, term: int) -> np.ndarray:
        return self.positions[self.begins[term] : self.ends[term]]

    def doc_of(self, position: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.starts, position, side="right") - 1

    def ids(self, words: list[bytes]) -> np.ndarray:
        return np.array([self.terms.get(w, -1) for w in words], np.int64)

    def phrase(self, ids: np.ndarray) -> np.ndarray:
        """Where the terms stand one after the other within a document."""
        rare = np.argsort(self.ends[ids] - self.begins[ids], kind="stable").tolist()
        at = self.postings(ids[rare[0]]) - rare[0]
        for offset in rare[1:]:
            if not len(at):
                return at
            other = self.postings(ids[offset])
            place = np.searchsorted(other, at + offset)
            place[place == len(other)] = 0
            at = at[other[place] == at + offset]
        at = at[at >= 0]
        if len(at):
            at = at[at + len(ids) <= self.starts[self.doc_of(at) + 1]]
        return at

    def near(self, ids: np.ndarray, slop: int) -> np.ndarray:
        """Places of the rarest term with each other term within slop words, in
        the same document."""
        distinct = np.unique(ids)
        rare = distinct[np.argsort(self.ends[distinct] - self.begins[distinct], kind="stable")]
        at = self.postings(rare[0])
        for term in rare[1:].tolist():
            if not len(at):
                break
            other, doc = self.postings(term), self.doc_of(at)
            low = np.maximum(at - slop, self.starts[doc])
            high = np.minimum(at + slop, self.starts[doc + 1] - 1)
            at = at[np.searchsorted(other, low, "left") < np.searchsorted(other, high, "right")]
        return at


def _blocks(batches: Iterator[pa.RecordBatch], out: str, size: int, block_bytes: int) -> Iterator[pa.RecordBatch]:
    """Benchmark items as block files of lines. An item larger than a block is cut
    so that each of its windows is whole in one of the lines."""
    names: list[str] = []
    lines: list[bytes] = []
    held = 0

    def flush() -> pa.RecordBatch:
        path = f"{out}/{uuid.uuid4().hex}.arrow"
        store_table(path, pa.table({"name": pa.array(names), "line": pa.array(lines, pa.large_binary())}))
        return pa.record_batch([pa.array([path])], ["block"])

    for batch in batches:
        for nth in range(batch.num_rows):
            name, text = batch.column(0)[nth].as_py(), batch.column(1)[nth].as_py()
            words, step = [w for part in tokens(text) for w in part], max(1, block_bytes // 8)
            for at in range(0, max(1, len(words) - size + 1) if words else 0, step):
                line = b" ".join(words[at : at + step + size - 1])
                if held + len(line) + len(name) > block_bytes and names:
                    yield flush()
                    names, lines, held = [], [], 0
                names.append(name)
                lines.append(line)
                held += len(line) + len(name)
    if names:
        yield flush()


@lru_cache(maxsize=1)
def _block(path: str) -> list[tuple[str, list[bytes]]]:
    table = open_table(path)
    return [(name, line.split()) for name, line in zip(table["name"].to_pylist(), table["line"].to_pylist(), strict=True)]


def _search(batches: Iterator[pa.RecordBatch], blocks: list[str], size: int, slop: int | None, names: list[str]) -> Iterator[pa.RecordBatch]:
    for path in (p for batch in batches for p in batch.column(0).to_pylist()):
        segment = Segment(path)
        edge = np.zeros(segment.starts[-1] + 1, np.int32)
        hits: dict[int, set[str]] = {}
        for block in blocks:
            for name, words in _block(block):
                ids = segment.ids(words)
                n = min(size, len(ids))
                absent = np.r_[0, np.cumsum(ids < 0)]
                for at in np.flatnonzero(absent[n:] == absent[:-n]).tolist():
                    places, long = (segment.phrase(ids[at : at + n]), n) if slop is None else (segment.near(ids[at : at + n], slop), 1)
                    if len(places):
                        np.add.at(edge, places, 1)
                        np.add.at(edge, places + long, -1)
                        for doc in np.unique(segment.doc_of(places)).tolist():
                            hits.setdefault(doc, set()).add(name)
        covered = np.flatnonzero(np.cumsum(edge[:-1]) > 0)
        doc, n_docs = segment.doc_of(covered), len(segment.doc_ids)
        limits = np.searchsorted(doc, np.arange(n_docs + 1)).astype(np.int32)
        columns = [
            pa.array([path] * n_docs, pa.string()),
            pa.array(np.arange(n_docs, dtype=np.int32)),
            segment.doc_ids,
            pa.array(segment.lengths.astype(np.int64)),
            pa.ListArray.from_arrays(pa.array(limits), pa.array((covered - segment.starts[doc]).astype(np.int32))),
            pa.array([sorted(hits.get(d, ())) for d in range(n_docs)], pa.list_(pa.string())),
        ]
        whole = pa.record_batch(columns, names)
        for at in range(0, n_docs, 10_000):
            yield whole.slice(at, 10_000)


def search(index: DataFrame, benchmark: DataFrame, size: int = 13, slop: int | None = None, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Per indexed document: doc_id, n_words, hit_words (the places of words inside
    matches), item_ids (strings, sorted, of the items that match), segment, ord.

    A window is ``size`` words of an item in a row; shorter items are one window,
    items without words none. ``slop`` None: exact phrases. Else proximity: the
    rarest word of a window counts where all others occur at most slop words away.
    Null item ids are called "null"; repeated items count once. An empty benchmark
    gives no hits, an empty index no rows. Each segment meets the benchmark's
    block files (``block_bytes`` each) one after the other in one task, so the
    benchmark may have any size and no result is put together later.
    """
    spark: SparkSession = index.sparkSession
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("name"), F.col("text").cast("binary").alias("text")).distinct()
    total = items.agg(F.sum(F.length("text") + F.length("name"))).first()[0] or 0
    out = new_path(spark, "benchmark")
    dealt = items.repartition(-(-total // block_bytes) or 1)
    stored = written(dealt.mapInArrow(lambda it: _blocks(it, out, size, block_bytes), "block string"), "block-list")
    blocks = [r.block for r in stored.orderBy("block").collect()]  # a name for each few megabytes of benchmark
    schema = "segment string, ord int, doc_id long, n_words long, hit_words array<int>, item_ids array<string>"
    names = [x.split()[0] for x in schema.split(", ")]
    found = spread(index.select("segment")).mapInArrow(releasing(lambda it: _search(it, blocks, size, slop, names)), schema)
    return found.select("doc_id", "n_words", "hit_words", "item_ids", "segment", "ord")


def contamination(found: DataFrame, share: int = 20) -> DataFrame:
    """``found`` with n_hit, n_items and contaminated: any hit, and at least one
    word in ``share`` hit."""
    n_hit = F.size("hit_words").cast("long")
    return found.withColumns({"n_hit": n_hit, "n_items": F.size("item_ids").cast("long"), "contaminated": (n_hit > 0) & (n_hit * share >= F.col("n_words"))})
