"""Removal of repeated word windows by super-k-mer partitioning.

A word goes if it lies in a window of ``length`` words whose sequence also starts in
a document with a smaller id. Windows are found a bucket at a time:

1. Texts are stored in segment files in the shared folder; a task reads one segment.
2. A window's minimiser is the least hash of the m-word strings inside it; equal
   windows have equal minimisers. Neighbouring windows that share one are a
   super-k-mer. Each segment sends the names of its minimisers with their smallest
   and largest document; only names that stand in several documents go on.
3. A super-k-mer of such a name travels as one packed string of words, once for each
   segment; Spark aggregates equal strings of all segments to one row before any
   bucket sees them. A name whose distinct strings are more than HOT_BYTES goes
   another way: its windows become rows of their own, which Spark aggregates by a
   128-bit hash of the window. So what a bucket sorts is bounded whatever repeats.
4. A bucket numbers its words and ranks all windows exactly by doubling: pairs of
   ranks of w words are sorted to ranks of 2 w words, up to ``length``. Each class of
   equal windows gets its smallest document.
5. The answers go back by the strings' 128-bit names to the segments that hold them.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gondola.llm.runtime import new_path, open_table, release, releasing, spread, utf8, written
from gondola.llm.suffix_dedup import _store_segments, sliding_min, window_hashes

#: What a bucket of packed strings should hold, and from how much one name has a way of its own.
BUCKET_BYTES = 8 << 20
HOT_BYTES = 4 << 20
_ROWS = 4096
_LAST = np.iinfo(np.int64).max
NEW = ["n_words", "n_removed", "kept"]

_MARKS = "segment long, name long, lo long, hi long"
_RUNS = "segment long, key binary, name long, packed binary, lo long, hi long, at binary"
_REPLY = pa.schema([("key", pa.binary()), ("offset", pa.int32()), ("firsts", pa.binary()), ("times", pa.binary())])
_REPLIES = "key binary, offset int, firsts binary, times binary"


def minimiser_words(length: int) -> int:
    """Words of the strings whose least hash names a window: a third of the window."""
    return max(1, length // 3)


class Words:
    """A segment's texts as one list of words. Null texts have none."""

    def __init__(self, path: str, key: str, text: str) -> None:
        self.table = open_table(path)
        self.words: list[bytes] = []
        counts = []
        for t in utf8(self.table[text]):
            mine = (t or b"").split()
            self.words += mine
            counts.append(len(mine))
        self.counts = np.array(counts, np.int64)
        self.starts = np.r_[0, np.cumsum(self.counts)]
        self.ids = np.array([_LAST if i is None else i for i in self.table[key].to_pylist()], np.int64)
        self.doc = np.repeat(np.arange(len(counts), dtype=np.int32), self.counts)

    def runs(self, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """First window, number of windows, and minimiser of each super-k-mer."""
        known: dict[bytes, int] = {}
        number = np.fromiter((known.setdefault(w, len(known)) for w in self.words), np.int64, len(self.words))
        named = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in known), np.uint64, len(known))
        left = self.starts[1:][self.doc] - np.arange(len(self.words))
        at = np.flatnonzero(left >= length)
        if not len(at):
            return at, at, np.empty(0, np.int64)
        m = minimiser_words(length)
        least = sliding_min(window_hashes(named[number], m), length - m + 1)[at].view(np.int64)
        new = np.r_[True, (at[1:] != at[:-1] + 1) | (least[1:] != least[:-1]) | (self.doc[at[1:]] != self.doc[at[:-1]])]
        first = np.flatnonzero(new)
        return at[first], np.diff(np.r_[first, len(at)]), least[first]

    def packed(self, start: int, count: int, length: int) -> bytes:
        return b" ".join(self.words[start : start + count + length - 1])


def _marks(number: int, s: Words, length: int) -> pa.RecordBatch:
    """The segment's minimisers with the smallest and the largest document of each."""
    start, _, name = s.runs(length)
    order = np.argsort(name, kind="stable")
    name, ids = name[order], s.ids[s.doc[start[order]]]
    first = np.flatnonzero(np.r_[True, name[1:] != name[:-1]][: len(name)])
    lo, hi = (f.reduceat(ids, first) if len(first) else ids for f in (np.minimum, np.maximum))
    return pa.record_batch([pa.array(np.full(len(first), number, np.int64)), pa.array(name[first]), pa.array(lo), pa.array(hi)], ["segment", "name", "lo", "hi"])


def _packed_runs(number: int, s: Words, names: np.ndarray, length: int) -> Iterator[pa.RecordBatch]:
    """Each distinct packed string of the given minimisers, where its super-k-mers start."""
    start, count, name = s.runs(length)
    mine = np.flatnonzero(np.isin(name, names))
    known: dict[bytes, list[int]] = {}
    for i in mine.tolist():
        known.setdefault(s.packed(int(start[i]), int(count[i]), length), []).append(i)
    found = list(known.items())
    for a in range(0, len(found), _ROWS):
        part = found[a : a + _ROWS]
        ids = [s.ids[s.doc[start[at]]] for _, at in part]
        columns = [
            pa.array([number] * len(part), pa.int64()), pa.array([xxhash.xxh3_128_digest(p) for p, _ in part], pa.binary()), pa.array([int(name[at[0]]) for _, at in part], pa.int64()),
            pa.array([p for p, _ in part], pa.binary()), pa.array([int(x.min()) for x in ids], pa.int64()), pa.array([int(x.max()) for x in ids], pa.int64()),
            pa.array([start[at].astype(np.int32).tobytes() for _, at in part], pa.binary()),
        ]
        yield pa.record_batch(columns, ["segment", "key", "name", "packed", "lo", "hi", "at"])


def rank_windows(number: np.ndarray, length: int) -> np.ndarray:
    """Exact rank of the ``length`` numbers from each position, by doubling; positions
    nearer to the end than that get any rank."""
    rank, width = number.astype(np.int64), 1
    while width < length:
        step = min(width, length - width)
        next_ = np.zeros_like(rank)
        next_[: len(rank) - step] = rank[step:]
        pair = rank * (int(next_.max(initial=0)) + 1) + next_
        rank = np.unique(pair, return_inverse=True)[1].reshape(-1)
        width += step
    return rank


def first_documents(packed: list[bytes], lo: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """For every window of distinct packed strings, in order, the smallest document
    that has it; and the strings' limits in that list."""
    known: dict[bytes, int] = {}
    numbers, counts = [], []
    for p in packed:
        mine = p.split(b" ")
        counts.append(len(mine))
        numbers.extend(known.setdefault(w, len(known)) for w in mine)
    counts = np.array(counts, np.int64)
    windows = counts - length + 1
    limits = np.r_[0, np.cumsum(windows)]
    at = np.repeat(np.r_[0, np.cumsum(counts)][:-1] - limits[:-1], windows) + np.arange(limits[-1])
    rank = rank_windows(np.array(numbers, np.int64), length)[at]
    order = np.argsort(rank, kind="stable")
    ranked, owner = rank[order], np.repeat(lo, windows)[order]
    first = np.flatnonzero(np.r_[True, ranked[1:] != ranked[:-1]][: len(ranked)])
    out = np.empty(len(rank), np.int64)
    out[order] = np.repeat(np.minimum.reduceat(owner, first) if len(first) else owner, np.diff(np.r_[first, len(rank)]))
    return out, limits


def _sort_bucket(table: pa.Table, length: int) -> pa.Table:
    """The documents of a bucket's windows, as runs of equal ones. A string of one
    document whose windows start nowhere earlier needs no answer."""
    lo, hi = (table[c].to_numpy() for c in ("lo", "hi"))
    firsts, limits = first_documents(table["packed"].to_pylist(), lo, length)
    keys, rows = table["key"].to_pylist(), []
    for i, (a, b) in enumerate(zip(limits[:-1].tolist(), limits[1:].tolist(), strict=True)):
        mine = firsts[a:b]
        if lo[i] == hi[i] and (mine == lo[i]).all():
            continue
        new = np.flatnonzero(np.r_[True, mine[1:] != mine[:-1]])
        rows.append((keys[i], 0, mine[new].tobytes(), np.diff(np.r_[new, b - a]).astype(np.int32).tobytes()))
    release()
    return pa.Table.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(_REPLY)], schema=_REPLY)


def _windows(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """Packed strings as single windows, each named by 128 bits."""
    for batch in batches:
        for key, packed, lo, hi in zip(*(batch[c].to_pylist() for c in ("key", "packed", "lo", "hi")), strict=True):
            words = packed.split(b" ")
            n = len(words) - length + 1
            names = [xxhash.xxh3_128_digest(b" ".join(words[i : i + length])) for i in range(n)]
            yield pa.record_batch([pa.array([key] * n, pa.binary()), pa.array(range(n), pa.int32()), pa.array(names, pa.binary()), pa.array([lo] * n, pa.int64()), pa.array([hi] * n, pa.int64())], ["key", "offset", "window", "lo", "hi"])


def _hot_replies(strings: DataFrame, hot: DataFrame, length: int) -> DataFrame:
    """The same answers for names with very many strings: by window, without a bucket."""
    rows = strings.join(hot, "name", "left_semi").select("key", "packed", "lo", "hi")
    rows = written(rows.mapInArrow(releasing(lambda it: _windows(it, length)), "key binary, offset int, window binary, lo long, hi long"), "hot-windows")
    firsts = rows.groupBy("window").agg(F.min("lo").alias("first"), F.max("hi").alias("last")).where("first < last")
    answer = rows.join(firsts, "window").select("key", "offset", "first")
    little = lambda c, hexes: F.unhex(F.concat(*[F.substring(F.lpad(F.hex(c), hexes, "0"), i, 2) for i in range(hexes - 1, 0, -2)]))
    return answer.select("key", "offset", little(F.col("first"), 16).alias("firsts"), F.unhex(F.lit("01000000")).alias("times"))


def _cleaned(s: Words, replies: list[dict], names: list[str], length: int) -> pa.Table:
    """The segment's rows with the words that stay."""
    edge = np.zeros(len(s.words) + 1, np.int64)
    for r in replies:
        first = np.repeat(np.frombuffer(r["firsts"], np.int64), np.frombuffer(r["times"], np.int32))
        for start in np.frombuffer(r["at"], np.int32).tolist():
            goes = np.flatnonzero(first < s.ids[s.doc[start]]) + (start + r["offset"])
            edge[goes] += 1
            edge[goes + length] -= 1
    gone = np.cumsum(edge[:-1]) > 0
    total = np.r_[0, np.cumsum(gone)]
    removed = total[s.starts[1:]] - total[s.starts[:-1]]
    stays = (~gone).tolist()
    kept = []
    for a, b, n in zip(s.starts[:-1].tolist(), s.starts[1:].tolist(), removed.tolist(), strict=True):
        kept.append(b" ".join(compress(s.words[a:b], stays[a:b]) if n else s.words[a:b]))
    added = [pa.array(s.counts), pa.array(removed, pa.int64()), pa.array(kept, pa.binary()).view(pa.string())]
    return pa.Table.from_arrays([*s.table.columns, *added], names=[*names, *NEW])


def remove_repeated_windows(docs: DataFrame, length: int = 50, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with n_words, n_removed and kept (the words left, one space between).

    Words are what stands between ASCII white space, compared byte by byte; null and
    empty texts have none. All windows are judged on the input; one that repeats
    within one document, or within rows of one key, stays. A null key comes after all
    others; null keys count as one document. Texts of fewer than ``length`` words are
    kept whole. Every row gives one row; other columns are passed on, but for ones
    called like the three new ones, which are replaced. An empty table gives an empty
    result. A task holds one segment (4 MB, or one longer text) or one bucket.
    """
    if length < 1:
        raise ValueError("length must be positive")
    spark, docs = docs.sparkSession, docs.drop(*NEW)
    kinds = {"n_words": "long", "n_removed": "long", "kept": "string"}
    schema = docs.select("*", *[F.lit(None).cast(kinds[c]).alias(c) for c in NEW]).schema
    out, text_at, names = new_path(spark, "segments"), docs.columns.index(text), docs.columns

    def stored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId() << 24  # the attempt that counts numbers its own files
        for n, row in enumerate(_store_segments(batches, out, text_at)):
            yield pa.record_batch([pa.array([task + n], pa.int64()), row["segment"]], ["segment", "path"])

    def marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for n, path in zip(batch["segment"].to_pylist(), batch["path"].to_pylist(), strict=True):
                yield _marks(n, Words(path, key, text), length)

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for n, path, mine in zip(batch["segment"].to_pylist(), batch["path"].to_pylist(), batch["names"], strict=True):
                yield from _packed_runs(n, Words(path, key, text), mine.values.to_numpy(zero_copy_only=False), length)

    def cleaned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, replies in zip(batch["path"].to_pylist(), batch["replies"], strict=True):
                yield from _cleaned(Words(path, key, text), replies.as_py() or [], names, length).to_batches()

    segments = written(docs.mapInArrow(releasing(stored), "segment long, path string"), "segment-list")
    found = written(spread(segments).mapInArrow(releasing(marks), _MARKS), "minimisers")
    several = found.groupBy("name").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).where("lo < hi").select("name")
    asked = found.select("segment", "name").join(several, "name").groupBy("segment").agg(F.collect_list("name").alias("names"))
    runs = written(segments.join(asked, "segment").mapInArrow(releasing(packed), _RUNS), "super-k-mers")
    strings = written(runs.groupBy("name", "key", "packed").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")), "strings")

    sizes = strings.groupBy("name").agg(F.sum(F.octet_length("packed")).alias("size"))
    hot = written(sizes.where(F.col("size") > HOT_BYTES).select("name"), "hot-names")
    total = strings.agg(F.sum(F.octet_length("packed"))).first()[0] or 0
    buckets = max(4 * int(spark.conf.get("spark.sql.shuffle.partitions")), total // BUCKET_BYTES)
    cold = strings.join(hot, "name", "left_anti").select(F.pmod("name", F.lit(buckets)).alias("bucket"), "key", "packed", "lo", "hi")
    replies = cold.groupBy("bucket").applyInArrow(lambda t: _sort_bucket(t, length), _REPLIES)
    if not hot.isEmpty():
        replies = replies.unionByName(_hot_replies(strings, hot, length))
    replies = written(replies, "replies")
    back = runs.select("segment", "key", "at").join(replies, "key").groupBy("segment").agg(F.collect_list(F.struct("at", "offset", "firsts", "times")).alias("replies"))
    return segments.join(back, "segment", "left").select("path", "replies").mapInArrow(releasing(cleaned), schema)
