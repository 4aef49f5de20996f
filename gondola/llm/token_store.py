"""Token ids in binary shard files with a minimal perfect hash index.

A shard file holds whole documents in key order: the raw ids (16 bits where the
vocabulary allows, else 32), each document's offset, and an index. The index is
a minimal perfect hash of the shard's keys (levels of bit maps: a key that is
alone at its place of a level is settled there, the others go on to the next)
and for each of its slots a fingerprint of the key, its first document and the
number of documents of that key. A lookup is a few probes whatever the shard's
size; the fingerprint refuses keys that aren't there.

Shards are cut from range partitions, so the files in the manifest's order
hold all documents in ascending key order.
"""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gondola.llm.bpe import Chunks, Pieces, byte_characters, byte_line
from gondola.llm.runtime import new_path, releasing, spread, written

MAGIC = b"GNDLTOK1"
_HEAD = struct.Struct("<8s7Q")
SHARD_TOKENS = 8 << 20
#: Text bytes of a range partition at most, on average.
PARTITION_BYTES = 128 << 20


def _mix(keys: np.ndarray, seed: int) -> np.ndarray:
    """A 64-bit finaliser (multiply and shift) of keys under a seed."""
    x = keys.astype(np.uint64) + np.uint64((seed * 0x9E3779B97F4A7C15 + 0x2545F4914F6CDD1D) & (1 << 64) - 1)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def fingerprint(keys: np.ndarray) -> np.ndarray:
    return (_mix(keys, 999) >> np.uint64(32)).astype(np.uint32)


class PerfectHash:
    """A minimal perfect hash: distinct keys to 0 .. n - 1."""

    def __init__(self, levels: list[np.ndarray]) -> None:
        self.levels = levels  # bit maps, as 64-bit words
        counts = np.bitwise_count(np.concatenate(levels)) if levels else np.empty(0, np.uint8)
        self.before = np.r_[0, np.cumsum(counts, dtype=np.int64)]
        self.base = np.r_[0, np.cumsum([len(x) for x in levels], dtype=np.int64)]

    @classmethod
    def build(cls, keys: np.ndarray, room: float = 2.0) -> PerfectHash:
        levels, left = [], np.asarray(keys, np.int64)
        while len(left):
            words = int(len(left) * room) // 64 + 1
            place = (_mix(left, len(levels)) % np.uint64(words * 64)).astype(np.int64)
            count = np.bincount(place, minlength=words * 64)
            levels.append(np.packbits(count == 1, bitorder="little").view("<u8").copy())
            left = left[count[place] > 1]
            if len(levels) > 200:
                raise ValueError("keys are not distinct")
        return cls(levels)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each key; -1 for keys that no level settles."""
        keys = np.asarray(keys, np.int64)
        out, open_ = np.full(len(keys), -1, np.int64), np.arange(len(keys))
        for n, bits in enumerate(self.levels):
            place = (_mix(keys[open_], n) % np.uint64(len(bits) * 64)).astype(np.int64)
            word, bit = place >> 6, (place & 63).astype(np.uint64)
            hit = (bits[word] >> bit & np.uint64(1)).astype(bool)
            below = bits[word] & ((np.uint64(1) << bit) - np.uint64(1))
            rank = self.before[self.base[n] + word] + np.bitwise_count(below)
            out[open_[hit]] = rank[hit]
            open_ = open_[~hit]
        return out


def _section(x: np.ndarray | bytes) -> bytes:
    raw = x if isinstance(x, bytes) else x.tobytes()
    return struct.pack("<Q", len(raw)) + raw


def pack_shard(keys: list[int | None], sizes: np.ndarray, payload: bytes, width: int) -> bytes:
    """The bytes of a shard file. Documents of a null key are stored, but no lookup
    leads to them; those of a repeated key stand together under one slot."""
    known = np.array([k for k in keys if k is not None], np.int64)
    null = len(keys) - len(known)  # nulls come first
    distinct, first, count = np.unique(known, return_index=True, return_counts=True)
    index = PerfectHash.build(distinct)
    slot = index.slots(distinct)
    table = np.zeros(len(distinct), [("fingerprint", "<u4"), ("count", "<u4"), ("row", "<u8")])
    table["fingerprint"][slot] = fingerprint(distinct)
    table["count"][slot], table["row"][slot] = count, first + null
    offsets = np.r_[0, np.cumsum(sizes, dtype=np.int64)].astype("<u8")
    parts = [known.astype("<i8"), offsets, np.array([len(x) for x in index.levels], "<u8"), *index.levels, table]
    head = _HEAD.pack(MAGIC, 1, width, len(keys), null, len(distinct), len(index.levels), len(payload))
    return head + b"".join(map(_section, parts)) + payload


class Shard:
    """A shard file, opened: ids of documents by key in constant time."""

    def __init__(self, raw: bytes) -> None:
        magic, version, width, self.n_docs, self.null, self.n_keys, n_levels, size = _HEAD.unpack_from(raw)
        if magic != MAGIC or version != 1:
            raise ValueError("not a shard file")
        at, parts = _HEAD.size, []
        for _ in range(4 + n_levels):
            (n,) = struct.unpack_from("<Q", raw, at)
            parts.append(memoryview(raw)[at + 8 : at + 8 + n])
            at += 8 + n
        self.keys = np.frombuffer(parts[0], "<i8")
        self.offsets = np.frombuffer(parts[1], "<u8").astype(np.int64)
        self.index = PerfectHash([np.frombuffer(x, "<u8") for x in parts[3 : 3 + n_levels]])
        self.table = np.frombuffer(parts[3 + n_levels], [("fingerprint", "<u4"), ("count", "<u4"), ("row", "<u8")])
        self.ids = np.frombuffer(memoryview(raw)[at : at + size], "<u2" if width == 2 else "<u4")

    def rows(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First document and number of documents of each key; 0 documents if absent."""
        slot = self.index.slots(keys)
        found = slot >= 0
        if len(self.table):
            found &= self.table["fingerprint"][np.maximum(slot, 0)] == fingerprint(np.asarray(keys, np.int64))
        slot = np.where(found, slot, 0)
        if not len(self.table):
            return np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
        return self.table["row"][slot].astype(np.int64), np.where(found, self.table["count"][slot], 0).astype(np.int64)

    def document(self, row: int) -> np.ndarray:
        return self.ids[self.offsets[row] : self.offsets[row + 1]]

    def get(self, key: int) -> list[np.ndarray]:
        """The ids of the documents of a key."""
        first, count = self.rows(np.array([key]))
        return [self.document(r) for r in range(int(first[0]), int(first[0] + count[0]))]


class LibraryEncoder:
    """The tokenizers library's model, asked once for each distinct word.

    For files whose pre-tokenizer never crosses white space (checked by
    ``bpe.Chunks``) the pieces between spaces are looked up whole; a new piece is cut
    into the lower-cased words that the model sees, and only new words are encoded.
    """

    def __init__(self, path: str, cache: int = 600_000) -> None:
        import json

        from tokenizers import Tokenizer

        library, byte = Tokenizer.from_file(path), byte_characters()
        self.width = 2 if library.get_vocab_size(with_added_tokens=True) <= 1 << 16 else 4
        model = library.model
        with open(path, encoding="utf-8") as f:
            cut = Chunks(json.load(f))
        self.pieces = Pieces(cut, lambda w: [t.id for t in model.tokenize(byte_line(w, byte))], "H" if self.width == 2 else "I", cache)

    def encode(self, texts: list[str | None], end_id: int) -> list[bytes]:
        """The ids of each text with the end id, ``width`` bytes each."""
        end = self.pieces.packed([end_id])
        return [self.pieces.encode(t) + end for t in texts]


@lru_cache(maxsize=2)
def _encoder(path: str) -> LibraryEncoder:
    return LibraryEncoder(path)


def _store(path: str, raw: bytes) -> None:
    system, inner = fs.FileSystem.from_uri(path)
    system.create_dir(os.path.dirname(inner), recursive=True)
    with system.open_output_stream(inner) as f:
        f.write(raw)


def open_shard(path: str) -> Shard:
    system, inner = fs.FileSystem.from_uri(path)
    with system.open_input_stream(inner) as f:
        return Shard(f.read())


MANIFEST = "part int, seq int, path string, n_docs long, n_tokens long, first_key long, last_key long"


def write_tokens(docs: DataFrame, path: str, end_id: int = 2, out: str | None = None, key: str = "doc_id", text: str = "text", shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """Encode whole texts and write shard files; returns the manifest (written too).

    Null and empty texts are the end id alone. Documents of a null key come first.
    Repeated keys are all stored; one key's many rows may span shards. An empty
    table gives no files and an empty manifest; columns besides key and text are
    ignored, whatever their names. A lost task writes its files anew under new
    names; the manifest lists those of the attempt that counted.
    """
    out = out or new_path(docs.sparkSession, "token-shards")
    names = [x.split()[0] for x in MANIFEST.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, task = _encoder(path), TaskContext.get()
        keys: list[int | None] = []
        payload: list[bytes] = []
        size, seq = 0, 0

        def flush() -> pa.RecordBatch:
            sizes = np.array([len(x) // encoder.width for x in payload], np.int64)
            name = f"{out}/{task.partitionId():06d}-{seq:05d}-{task.taskAttemptId()}.tok"
            _store(name, pack_shard(keys, sizes, b"".join(payload), encoder.width))
            row = [task.partitionId(), seq, name, len(keys), int(sizes.sum()), next((k for k in keys if k is not None), None), keys[-1]]
            return pa.RecordBatch.from_pylist([dict(zip(names, row, strict=True))], schema=kinds)

        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                for k, ids in zip(part.column(0).to_pylist(), encoder.encode(part.column(1).to_pylist(), end_id), strict=True):
                    keys.append(k)
                    payload.append(ids)
                    size += len(ids) // encoder.width
                    if size >= shard_tokens:
                        yield flush()
                        keys, payload, size, seq = [], [], 0, seq + 1
        if keys:
            yield flush()

    kinds = pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("path", pa.string()), ("n_docs", pa.int64()), ("n_tokens", pa.int64()), ("first_key", pa.int64()), ("last_key", pa.int64())])
    # partitions of bounded size, whatever the size of the whole
    total = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // PARTITION_BYTES))
    # the text's hash spreads the rows of one hot key over partitions
    rows = docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"), F.xxhash64(text).alias("tie"))
    dealt = rows.repartitionByRange(parts, "key", "tie").sortWithinPartitions("key", "tie")
    return written(dealt.select("key", "text").mapInArrow(releasing(run), MANIFEST), "token-manifest")


def read_tokens(manifest: DataFrame, key: str = "doc_id") -> DataFrame:
    """Every document by keyed access: (key, start, n_tokens, ids_crc32).

    start counts the ids of all documents before it; ids_crc32 is over the ids as
    little-endian 32-bit integers. Documents of a null key are read by place.
    """
    before = Window.orderBy("part", "seq").rowsBetween(Window.unboundedPreceding, -1)
    # one row for each shard file, not for each document
    shards = manifest.select("path", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).alias("base"))
    names = [key, "start", "n_tokens", "ids_crc32"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                shard = open_shard(path)
                distinct = np.unique(shard.keys)
                first, count = shard.rows(distinct)
                if (count == 0).any() or count.sum() + shard.null != shard.n_docs:
                    raise ValueError(f"{path}: the index misses documents")
                rows = np.concatenate([np.arange(shard.null), np.repeat(first - (np.cumsum(count) - count), count) + np.arange(count.sum())])
                keys = [None] * shard.null + np.repeat(distinct, count).tolist()
                crc = [zlib.crc32(shard.document(r).astype("<u4").tobytes()) for r in rows.tolist()]
                sizes = (shard.offsets[1:] - shard.offsets[:-1])[rows]
                yield pa.record_batch([pa.array(keys, pa.int64()), pa.array(base + shard.offsets[:-1][rows]), pa.array(sizes), pa.array(crc, pa.int64())], names)

    return spread(shards).mapInArrow(run, f"{key} long, start long, n_tokens long, ids_crc32 long")
