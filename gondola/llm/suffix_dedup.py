"""Removal of repeated passages by blockwise suffix sorting with a difference cover.

A byte goes if it lies in a string of ``length`` bytes that also starts in a
document with a smaller id. Finding these strings is sorting all suffixes to that
depth, which is done a block at a time:

1. Texts are stored in segment files in the shared folder. Only hashes, strings
   that are known to repeat, and bits travel between tasks, never the corpus.
2. The cover sample: of a document's positions those whose remainder by v is in a
   difference cover D. For any two positions some shift below v brings both into
   the sample, so two equal strings of ``length`` bytes always contain equal
   sample strings of ``length - v + 1`` bytes. The samples' hashes are grouped bucket
   by bucket, which tells those that stand in one document only from those that stand
   in several: one bit for each, not a rank. A suffix can tie with one of another
   document to the full depth only if one of the sample strings inside it is of the
   second kind; the others need no comparison.
3. The suffixes left are cut into runs of neighbours that share their least hash
   of a sample-length string. Equal suffixes have that hash in common, so it deals
   them to buckets; each bucket is sorted to the full depth by itself, and every
   class of equal suffixes gets its smallest document. Only a quarter of the
   hashes deal, and of these not the frequent ones that would fill a bucket:
   segments count what they hold REPEATED times or more, which is summed while the
   samples are grouped. A suffix without a dealing hash is dealt by its own. What
   one string can bring to a bucket is so bounded by BUCKET_BYTES, total /
   HOT_NAMES occurrences, or fewer than REPEATED in each segment. A segment sends
   each distinct run once; a task holds one segment or one bucket.

Beside its texts, a task holds one hash for each byte of a segment, or two words for
each suffix of a bucket; all that is wider is made a block of positions at a time.
"""

from __future__ import annotations

import os
import sys
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import compute, fs
from pyarrow import ipc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gondola.llm.runtime import new_path, release, releasing, written

# Difference covers by modulus; differences of members give all remainders.
COVERS = {
    3: (0, 1),
    7: (1, 2, 4),
    13: (0, 1, 3, 9),
    21: (3, 6, 7, 12, 14),
    31: (1, 5, 11, 24, 25, 27),
}
SEGMENT_BYTES = 4 << 20
SEGMENT_DOCS = 50_000
#: What a bucket should hold: sample hashes, and bytes of runs.
BUCKET_SAMPLES = 400_000
BUCKET_BYTES = 8 << 20
#: Strings that may be told apart as frequent: a bound on what tasks are sent.
HOT_NAMES = 1 << 18
#: Hashes below this deal (a quarter of them); times in a segment from which one is counted.
DEALS = 1 << 62
REPEATED = 4
#: Positions that are worked on at once.
BLOCK = 1 << 18
_LAST = np.iinfo(np.int64).max
_NO_HASH = np.iinfo(np.uint64).max


def modulus(length: int) -> int:
    """The largest cover that leaves samples of two fifths of the length."""
    fit = [v for v in COVERS if length - v + 1 >= 2 * length / 5]
    if not fit:
        raise ValueError("length must be 4 at least")
    return max(fit)


def blocks(n: int) -> Iterator[tuple[int, int]]:
    """Limits of blocks of 0 to n."""
    return ((at, min(at + BLOCK, n)) for at in range(0, n, BLOCK))


def whole_blocks(begins: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
    """Limits of blocks that end where something begins, and the beginnings in each,
    counted from the block's own."""
    lo = 0
    while lo < len(begins):
        hi = lo + BLOCK
        hi = hi + int(begins[hi:].argmax()) if begins[hi:].any() else len(begins)
        yield lo, hi, np.flatnonzero(begins[lo:hi])
        lo = hi


def window_hashes(a: np.ndarray, n: int) -> np.ndarray:
    """A 64-bit hash of the n bytes from each position (fewer at the end: any value).
    Made a block at a time, which bounds the memory beside the result."""
    out = np.empty(len(a), np.uint64)
    for at, end in blocks(len(a)):
        out[at:end] = _block_hashes(a[at : end + n - 1], n)[: end - at]
    return out


def _block_hashes(a: np.ndarray, n: int) -> np.ndarray:
    parts, power = [], np.uint64(0x9E3779B97F4A7C15)
    h, width, need = a.astype(np.uint64), 1, n
    h += np.uint64(1)
    out, out_power = None, np.uint64(1)
    with np.errstate(over="ignore"):
        while need:
            if need & 1:  # lengths joined from the short end: this part follows what is there
                if out is None:
                    out, taken = h.copy(), width
                else:
                    shifted = np.zeros_like(out)
                    shifted[: max(0, len(h) - taken)] = h[taken:]
                    out *= power
                    out += shifted
                    taken += width
            need >>= 1
            if need:
                follow = h[width:].copy()
                h *= power
                h[: len(follow)] += follow
                power, width = power * power, 2 * width
        out ^= out >> np.uint64(29)
        out *= np.uint64(0xBF58476D1CE4E5B9)
        out ^= out >> np.uint64(32)
    return out


def sliding_min(h: np.ndarray, n: int) -> np.ndarray:
    """The least of the n values from each position (positions near the end: of fewer)."""
    m, width = h.copy(), 1
    while 2 * width <= n:
        np.minimum(m[:-width], m[width:], out=m[:-width])
        width *= 2
    if width < n:
        step = n - width
        np.minimum(m[:-step], m[step:], out=m[:-step])
    return m


def spread(flags: np.ndarray, n: int) -> np.ndarray:
    """The flags, each set for the n - 1 positions after it too; in place."""
    width = 1
    while 2 * width <= n:
        flags[width:] |= flags[:-width]
        width *= 2
    if width < n:
        step = n - width
        flags[step:] |= flags[:-step]
    return flags


class Segment:
    """A segment's texts end to end, and what the steps derive from them again."""

    def __init__(self, path: str, key: str, text: str, length: int) -> None:
        system, inner = fs.FileSystem.from_uri(path)
        with system.open_input_stream(inner) as f:
            self.table = ipc.open_file(pa.BufferReader(f.read())).read_all()
        texts = self.table[text].combine_chunks()
        texts = texts.chunk(0) if isinstance(texts, pa.ChunkedArray) else texts
        raw = [t or b"" for t in texts.cast(pa.large_binary()).to_pylist()]
        self.length, self.v = length, modulus(length)
        self.blob = b"".join(raw)
        self.bytes = np.frombuffer(self.blob, np.uint8)
        self.sizes = np.array([len(t) for t in raw], np.int64)
        self.starts = np.r_[0, np.cumsum(self.sizes)]
        ids = self.table[key].to_pylist()
        self.ids = np.array([_LAST if i is None else i for i in ids], np.int64)
        self.short = length - self.v + 1
        self.hashes = window_hashes(self.bytes, self.short)
        inside = np.zeros(self.v, bool)
        inside[list(COVERS[self.v])] = True
        fit, found = self.fit(self.short), [np.empty(0, np.int64)]
        for lo, hi in blocks(len(self.bytes)):
            begin = np.repeat(self.starts[:-1], np.diff(np.clip(self.starts, lo, hi)))
            found.append(lo + np.flatnonzero(inside[(np.arange(lo, hi) - begin) % self.v] & fit[lo:hi]))
        self.samples = np.concatenate(found)

    def fit(self, n: int) -> np.ndarray:
        """Whether n bytes of its document start at each position."""
        some = self.sizes > 0
        edge = np.zeros(len(self.bytes) + 1, np.int8)
        edge[np.maximum(self.starts[1:] - (n - 1), self.starts[:-1])[some]] += 1
        edge[self.starts[1:][some]] -= 1
        return np.cumsum(edge[:-1], dtype=np.int8) == 0

    def doc(self, at: np.ndarray) -> np.ndarray:
        """The document of each of the positions."""
        return np.searchsorted(self.starts[1:], at, side="right")

    def of_docs(self, flags: np.ndarray) -> np.ndarray:
        """How many flags of positions are set in each document."""
        out = np.zeros(len(self.sizes), np.int64)
        for lo, hi in blocks(len(flags)):
            so_far = np.r_[0, np.cumsum(flags[lo:hi])]
            out += np.diff(so_far[np.clip(self.starts, lo, hi) - lo])
        return out

    def gone(self, start: np.ndarray, count: np.ndarray, begin: np.ndarray, flags: np.ndarray, later: np.ndarray) -> np.ndarray:
        """The bytes that go: the ``length`` bytes of each suffix of the runs (start and
        number) that has its flag, from where its run's begin, or whose run is later."""
        out, ends, x = np.zeros(len(self.bytes), bool), np.cumsum(count), 0
        while x < len(start):
            y = max(x + 1, int(np.searchsorted(ends, (ends[x - 1] if x else 0) + BLOCK, side="right")))
            some = count[x:y]
            nth = np.arange(some.sum()) - np.repeat(np.cumsum(some) - some, some)
            out[np.repeat(start[x:y], some) + nth] = flags[np.repeat(begin[x:y], some) + nth] | np.repeat(later[x:y], some)
            x = y
        return spread(out, self.length)

    def cut_characters(self, gone: np.ndarray) -> np.ndarray:
        """The bytes of all characters of which a byte is gone."""
        begins = (self.bytes & 0xC0) != 0x80
        begins[self.starts[:-1][self.sizes > 0]] = True
        out = np.empty(len(gone), bool)
        for lo, hi, first in whole_blocks(begins):
            out[lo:hi] = np.repeat(np.logical_or.reduceat(gone[lo:hi], first), np.diff(np.r_[first, hi - lo]))
        return out

    def sample_names(self, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct sample hashes by bucket, each one's bucket; place of each sample."""
        names, place = np.unique(self.hashes[self.samples], return_inverse=True)
        bucket = ((names >> np.uint64(32)) % np.uint64(buckets)).astype(np.int32)
        order = np.argsort(bucket, kind="stable")
        back = np.empty(len(order), np.int64)
        back[order] = np.arange(len(order))
        return names[order], bucket[order], back[place]

    def candidates(self, shared: np.ndarray, place: np.ndarray) -> np.ndarray:
        """Whether the ``length`` bytes from each position hold a shared sample string."""
        near = np.zeros(len(self.bytes), bool)
        near[self.samples[shared[place]]] = True
        # what this sets in an earlier document doesn't fit there
        return spread(near[::-1], self.v)[::-1] & self.fit(self.length)

    def repeated(self, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Hashes that deal and stand several times in the segment, by bucket; the
        bucket and the number of each."""
        names, count = np.unique(self.hashes[self.hashes < DEALS], return_counts=True)
        names, count = names[count >= REPEATED], count[count >= REPEATED]
        bucket = ((names >> np.uint64(32)) % np.uint64(buckets)).astype(np.int32)
        order = np.argsort(bucket, kind="stable")
        return names[order], bucket[order], count[order]

    def dealing(self, lo: int, hi: int, hot: np.ndarray, low: np.ndarray, buckets: int) -> np.ndarray:
        """The hashes of a block, but those that don't deal or are among ``hot`` (sorted
        keys; ``low``: whether a lower quarter of a hash is among theirs)."""
        out = np.where(self.hashes[lo:hi] < DEALS, self.hashes[lo:hi], _NO_HASH)
        if len(hot):
            at = np.flatnonzero(low[(out & np.uint64(0xFFFF)).astype(np.int64)])
            out[at[np.isin(hot_keys(out[at], buckets), hot)]] = _NO_HASH
        return out

    def runs(self, wanted: np.ndarray, hot: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start, number of suffixes and least dealing hash of each run of the wanted
        positions; a suffix without one has its own hash."""
        low = np.zeros(1 << 16, bool)
        low[(hot & np.uint64(0xFFFF)).astype(np.int64)] = True
        starts, firsts, names, n = [np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0, np.uint64)], 0
        last, last_name = -2, _NO_HASH
        for lo, hi in blocks(len(wanted)):
            at = np.flatnonzero(wanted[lo:hi])
            if not len(at):
                continue
            least = sliding_min(self.dealing(lo, min(hi + self.v - 1, len(wanted)), hot, low, buckets), self.v)[at]
            alone = least == _NO_HASH
            if alone.any():
                least[alone] = window_hashes(self.bytes[lo : hi + self.length - 1], self.length)[at[alone]]
            at += lo
            first = np.flatnonzero(np.r_[at[0] != last + 1 or least[0] != last_name, (at[1:] != at[:-1] + 1) | (least[1:] != least[:-1])])
            starts.append(at[first])
            firsts.append(first + n)
            names.append(least[first])
            n, last, last_name = n + len(at), at[-1], least[-1]
        return np.concatenate(starts), np.diff(np.r_[np.concatenate(firsts), n]), np.concatenate(names)

    def texts(self, start: np.ndarray, count: np.ndarray) -> tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray]:
        """Distinct texts of the runs, each one's first run and smallest id; for each
        run the place of its text."""
        known: dict[bytes, int] = {}
        blob, more = self.blob, self.length - 1
        place = np.fromiter((known.setdefault(blob[s : s + c + more], len(known)) for s, c in zip(start.tolist(), count.tolist(), strict=True)), np.int64, len(start))
        least = np.full(len(known), _LAST, np.int64)
        np.minimum.at(least, place, self.ids[self.doc(start)])
        first = np.full(len(known), len(start), np.int64)
        np.minimum.at(first, place, np.arange(len(start)))
        return list(known), first, least, place


def _bits(x: np.ndarray) -> bytes:
    return np.packbits(x).tobytes()


def _unbits(raw: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(raw, np.uint8), count=n).astype(bool)


def _cuts(bucket: np.ndarray) -> list[tuple[int, int, int]]:
    """(bucket, from, to) of sorted buckets."""
    if not len(bucket):
        return []
    first = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
    return list(zip(bucket[first].tolist(), first.tolist(), [*first[1:].tolist(), len(bucket)], strict=True))


def sort_block(texts: list[bytes], ids: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """For every suffix of ``length`` bytes or more of distinct texts, in order of the
    texts: the smallest id of a text that has its first ``length`` bytes. Also the
    texts' limits in that list."""
    counts = np.array([len(t) - length + 1 for t in texts], np.int64)
    limits = np.r_[0, np.cumsum(counts)]
    blob = np.frombuffer(b"".join(texts), np.uint8)
    begin = np.r_[0, np.cumsum([len(t) for t in texts])][:-1]
    at = np.repeat((begin - limits[:-1]).astype(np.int32), counts)
    at += np.arange(limits[-1], dtype=np.int32)
    head = min(length, 8)
    word, name = np.zeros(len(at), np.uint64), np.empty(len(at), np.uint64)
    for lo, hi in blocks(len(blob)):
        x, y = np.searchsorted(at, (lo, hi))
        here = at[x:y] - lo
        name[x:y] = window_hashes(blob[lo : hi + length - 1], length)[here]
        for i in range(head):  # the first bytes as a number
            word[x:y] |= blob[lo + i :][here].astype(np.uint64) << np.uint64(56 - 8 * i)
    # by the first word, ties by a name of the whole: equal strings become neighbours
    order = np.lexsort((name, word))
    new = np.ones(len(order), bool)
    for lo, hi in blocks(max(len(order) - 1, 0)):
        mine = order[lo : hi + 1]
        new[lo + 1 : hi + 1] = (np.diff(word[mine]) != 0) | (np.diff(name[mine]) != 0)
    del word, name
    clash = _unlike(blob, at[order], ~new, length)
    if clash.any():  # two strings of one word and name: those of its places by all bytes
        first = np.flatnonzero(np.r_[new, True])
        for i in np.unique(np.searchsorted(first, np.flatnonzero(clash), side="right")).tolist():
            x, y = first[i - 1], first[i]
            order[x:y] = sorted(order[x:y].tolist(), key=lambda i: blob[at[i] : at[i] + length].tobytes())
        clash = _unlike(blob, at[order], ~new, length)
    new |= clash
    del at, clash
    out = np.repeat(ids, counts)
    for lo, hi, first in whole_blocks(new):
        mine = order[lo:hi]
        out[mine] = np.repeat(np.minimum.reduceat(out[mine], first), np.diff(np.r_[first, hi - lo]))
    return out, limits


def _unlike(blob: np.ndarray, at: np.ndarray, asked: np.ndarray, length: int, block: int = 1 << 15) -> np.ndarray:
    """Which of the places asked for hold other ``length`` bytes than the place before."""
    out = np.zeros(len(at), bool)
    asked = np.flatnonzero(asked)
    strings = np.lib.stride_tricks.sliding_window_view(blob, length) if len(asked) else blob
    for lo in range(0, len(asked), block):
        mine = asked[lo : lo + block]
        out[mine] = (strings[at[mine]] != strings[at[mine - 1]]).any(1)
    return out


def _firsts(ranked: np.ndarray) -> np.ndarray:
    """Where each value of a sorted array starts."""
    return np.flatnonzero(np.r_[True, ranked[1:] != ranked[:-1]][: len(ranked)])


def hot_keys(names: np.ndarray, buckets: int) -> np.ndarray:
    """What is known of a hash after counting: its bucket and its lower half."""
    return ((names >> np.uint64(32)) % np.uint64(buckets) << np.uint64(32)) | (names & np.uint64(0xFFFFFFFF))


def hot_of(bucket: int, names: bytes) -> np.ndarray:
    return np.uint64(bucket << 32) | np.frombuffer(names, np.uint32).astype(np.uint64)


_REPLY = pa.schema([("segment", pa.string()), ("kind", pa.int32()), ("bucket", pa.int32()), ("bits", pa.binary())])
REPLY = "segment string, kind int, bucket int, bits binary"


def _rank_samples(table: pa.Table, many: int) -> pa.Table:
    """A bucket of sample hashes: which stand in several documents (kind 1, by
    segment); and which hashes occur ``many`` times or more (kind 3, of no segment)."""
    raw, several = table["names"].to_pylist(), table["several"].to_pylist()
    sizes = [len(x) // 4 for x in raw]
    names = np.frombuffer(b"".join(raw), np.uint32)
    shared = np.concatenate([_unbits(x, n) for x, n in zip(several, sizes, strict=True)])
    order = np.argsort(names, kind="stable")
    ranked = names[order]
    first = _firsts(ranked)
    count = np.diff(np.r_[first, len(ranked)])
    some = np.logical_or.reduceat(shared[order], first) | (count > 1)
    out = np.empty(len(names), bool)
    out[order] = np.repeat(some, count)
    parts = np.split(out, np.cumsum(sizes)[:-1])
    replies = pa.Table.from_arrays([table["segment"], pa.array([1] * len(raw), pa.int32()), table["bucket"], pa.array([_bits(x) for x in parts], pa.binary())], schema=_REPLY)
    often, times = (np.frombuffer(b"".join(table[c].to_pylist()), np.uint32) for c in ("often", "times"))
    order = np.argsort(often, kind="stable")
    often = often[order]
    first = _firsts(often)
    hot = often[first][np.add.reduceat(times[order].astype(np.int64), first) >= many]
    if not len(hot):
        return replies
    own = pa.Table.from_arrays([pa.nulls(1, pa.string()), pa.array([3], pa.int32()), table["bucket"].slice(0, 1), pa.array([hot.tobytes()], pa.binary())], schema=_REPLY)
    return pa.concat_tables([replies, own])


def _sort_bucket(table: pa.Table, length: int) -> pa.Table:
    """A bucket of runs: which suffixes start in a document before their own."""
    known: dict[bytes, int] = {}
    rows = []
    for blob, sizes, ids in zip(table["blob"].to_pylist(), table["sizes"].to_pylist(), table["ids"].to_pylist(), strict=True):
        ends = np.cumsum(np.frombuffer(sizes, np.int32)).tolist()
        place = [known.setdefault(blob[a:b], len(known)) for a, b in zip([0, *ends[:-1]], ends, strict=True)]
        rows.append((np.array(place), np.frombuffer(ids, np.int64)))
    least = np.full(len(known), _LAST, np.int64)
    for place, ids in rows:
        np.minimum.at(least, place, ids)
    first, limits = sort_block(list(known), least, length)
    bits = []
    for place, ids in rows:
        count = limits[place + 1] - limits[place]
        ends = np.cumsum(count)
        at = np.repeat(limits[place] - (ends - count), count) + np.arange(ends[-1])
        bits.append(_bits(first[at] < np.repeat(ids, count)))
    return pa.Table.from_arrays([table["segment"], pa.array([2] * len(bits), pa.int32()), table["bucket"], pa.array(bits, pa.binary())], schema=_REPLY)


def _store_segments(batches: Iterator[pa.RecordBatch], out: str, text_at: int) -> Iterator[pa.RecordBatch]:
    held: list[pa.RecordBatch] = []
    size = docs = 0

    def flush() -> pa.RecordBatch:
        path = f"{out}/{uuid.uuid4().hex}.arrow"
        system, inner = fs.FileSystem.from_uri(path)
        system.create_dir(os.path.dirname(inner), recursive=True)
        table = pa.Table.from_batches(held).combine_chunks()
        with system.open_output_stream(inner) as sink, ipc.new_file(sink, table.schema, options=ipc.IpcWriteOptions(compression="zstd")) as f:
            f.write_table(table)
        return pa.record_batch([pa.array([path]), pa.array([size], pa.int64())], ["segment", "size"])

    for batch in batches:
        lengths = compute.fill_null(compute.binary_length(batch.column(text_at)), 0).to_numpy(zero_copy_only=False)
        at = 0
        while at < batch.num_rows:
            n = max(1, int(np.searchsorted(np.cumsum(lengths[at:]), SEGMENT_BYTES - size, side="right")))
            n = min(n, SEGMENT_DOCS - docs, batch.num_rows - at)
            held.append(batch.slice(at, n))
            size, docs, at = size + int(lengths[at : at + n].sum()), docs + n, at + n
            if at < batch.num_rows or size >= SEGMENT_BYTES or docs >= SEGMENT_DOCS:
                yield flush()
                held, size, docs = [], 0, 0
    if held:
        yield flush()


def remove_repeats(docs: DataFrame, length: int = 50, key: str = "doc_id", text: str = "text", whole_characters: bool = False) -> DataFrame:
    """``docs`` with n_bytes, n_removed, n_spans and kept (binary: the bytes left).

    Texts are taken as UTF-8 bytes, null as empty. All strings are judged on the
    input; a passage repeated within one document, or within rows of one key,
    stays. A null key comes after all others; null keys count as one document.
    Texts shorter than ``length`` are kept whole. Every row gives one row; other
    columns are passed on, but for ones called like the four new ones, which are
    replaced. An empty table gives an empty result. With ``whole_characters`` a UTF-8
    character of which a byte goes is left out of ``kept`` altogether; the counts stay
    those of the bytes.
    """
    spark = docs.sparkSession
    new = ["n_bytes", "n_removed", "n_spans", "kept"]
    docs = docs.drop(*new)
    kinds = {"n_bytes": "long", "n_removed": "long", "n_spans": "long", "kept": "binary"}
    schema = docs.select("*", *[F.lit(None).cast(kinds[c]).alias(c) for c in new]).schema
    out, text_at, names = new_path(spark, "segments"), docs.columns.index(text), docs.columns
    segments = written(docs.mapInArrow(releasing(lambda it: _store_segments(it, out, text_at)), "segment string, size long"), "segment-list")
    total = segments.agg(F.sum("size")).first()[0] or 0
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    v = modulus(length)
    n_names = max(4 * parts, total * len(COVERS[v]) // v // BUCKET_SAMPLES)
    n_runs = max(4 * parts, total // BUCKET_BYTES)
    # occurrences of a string whose runs (up to length + v bytes each) would fill a bucket
    many = max(1, BUCKET_BYTES // (length + v), total // HOT_NAMES)

    def sampled(path: str) -> pa.RecordBatch:
        s = Segment(path, key, text, length)
        often, hot_bucket, times = s.repeated(n_names)
        found, bucket, place = s.sample_names(n_names)
        ids = s.ids[s.doc(s.samples)]
        del s
        low, high = np.full(len(found), _LAST, np.int64), np.full(len(found), np.iinfo(np.int64).min)
        np.minimum.at(low, place, ids)
        np.maximum.at(high, place, ids)
        several = low < high
        del ids, low, high, place
        buckets = np.union1d(bucket, hot_bucket)
        cut = [np.searchsorted(b, buckets, side=side).tolist() for b in (bucket, hot_bucket) for side in ("left", "right")]
        short, often, times = (x.astype(np.uint32) for x in (found, often, times))
        made = [(short[x:y].tobytes(), _bits(several[x:y]), often[u:w].tobytes(), times[u:w].tobytes()) for x, y, u, w in zip(*cut, strict=True)]
        names, flags, often, times = (pa.array([m[i] for m in made], pa.binary()) for i in range(4))
        return pa.record_batch([pa.array([path] * len(made), pa.string()), pa.array(buckets, pa.int32()), names, flags, often, times], ["segment", "bucket", "names", "several", "often", "times"])

    def samples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch["segment"].to_pylist():
                yield sampled(path)  # one segment is held at a time
                release()

    def opened(rows: pa.Table):
        """A segment's candidates, from its path and the replies so far."""
        path = rows["segment"][0].as_py()
        s = Segment(path, key, text, length)
        found, bucket, place = s.sample_names(n_names)
        shared = np.zeros(len(found), bool)
        replies = [dict(), dict(), dict()]
        for kind, b, raw in zip(rows["kind"].to_pylist(), rows["bucket"].to_pylist(), rows["bits"].to_pylist(), strict=True):
            replies[kind][b] = raw
        for b, x, y in _cuts(bucket):
            shared[x:y] = _unbits(replies[1][b], y - x)
        wanted = s.candidates(shared, place)
        del found, bucket, place, shared
        start, count, least = s.runs(wanted, hot, n_names)
        s.hashes = s.samples = None  # not needed any more
        release()
        texts, first, ids, of = s.texts(start, count)
        deal = (least[first] % np.uint64(n_runs)).astype(np.int32)
        order = np.argsort(deal, kind="stable")
        return path, s, start, count, texts, ids, of, deal, order, replies[2]

    def runs(rows: pa.Table) -> pa.Table:
        path, _, _, _, texts, ids, _, deal, order, _ = opened(rows)
        made = []
        for b, x, y in _cuts(deal[order]):
            mine = order[x:y]
            part = [texts[i] for i in mine.tolist()]
            made.append({"segment": path, "bucket": b, "blob": b"".join(part), "sizes": np.array([len(t) for t in part], np.int32).tobytes(), "ids": ids[mine].tobytes()})
        release()
        return pa.Table.from_pylist(made, schema=pa.schema([("segment", pa.string()), ("bucket", pa.int32()), ("blob", pa.binary()), ("sizes", pa.binary()), ("ids", pa.binary())]))

    def cleaned(rows: pa.Table) -> pa.Table:
        path, s, start, count, texts, ids, of, deal, order, replies = opened(rows)
        n = np.array([len(t) - length + 1 for t in texts], np.int64)
        # flags of all suffixes of the texts, in this order; where each text's begin
        flags = [_unbits(replies[b], int(n[order[x:y]].sum())) for b, x, y in _cuts(deal[order])]
        flags = np.concatenate([np.empty(0, bool), *flags])
        begin = np.empty(len(texts), np.int64)
        begin[order] = np.cumsum(n[order]) - n[order]
        del texts, replies
        begin, later = begin[of], s.ids[s.doc(start)] > ids[of]
        gone = s.gone(start, count, begin, flags, later)
        removed = s.of_docs(gone)
        opens = gone & ~np.r_[False, gone[:-1]][: len(gone)]
        inner = s.starts[:-1][s.sizes > 0]
        opens[inner] = gone[inner]  # a run ends with its document
        spans = s.of_docs(opens)
        del opens, flags
        left = s.sizes - removed
        if whole_characters and gone.any():
            gone = s.cut_characters(gone)
            left = s.sizes - s.of_docs(gone)
        kept = s.bytes[~gone].tobytes()
        ends = np.cumsum(left).tolist()
        parts = [kept[x:y] for x, y in zip([0, *ends[:-1]], ends, strict=True)]
        release()
        added = [pa.array(s.sizes), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(parts, pa.binary())]
        return pa.Table.from_arrays([*s.table.columns, *added], names=[*names, *new])

    dealt = segments.repartition(parts).mapInArrow(releasing(samples), "segment string, bucket int, names binary, several binary, often binary, times binary")
    every = segments.select("segment", F.lit(0).alias("kind"), F.lit(-1).alias("bucket"), F.lit(None).cast("binary").alias("bits"))
    answers = written(dealt.groupBy("bucket").applyInArrow(lambda t: _rank_samples(t, many), REPLY), "sample-ranks")
    ranked = answers.where("kind = 1")
    # at most HOT_NAMES: no more strings can occur total / HOT_NAMES times
    frequent = [hot_of(r.bucket, r.bits) for r in answers.where("kind = 3").select("bucket", "bits").collect()]
    hot = np.unique(np.concatenate(frequent)) if frequent else np.empty(0, np.uint64)
    cut = every.unionByName(ranked).groupBy("segment").applyInArrow(runs, "segment string, bucket int, blob binary, sizes binary, ids binary")
    sorted_ = written(cut.groupBy("bucket").applyInArrow(lambda t: _sort_bucket(t, length), REPLY), "sorted-runs")
    return every.unionByName(ranked).unionByName(sorted_).groupBy("segment").applyInArrow(cleaned, schema)
