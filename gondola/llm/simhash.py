"""SimHash near-duplicates by covering locality-sensitive hashing.

Every bit position gets a nonzero vector of radius + 1 binary digits; each of the
2^(radius + 1) - 1 nonzero vectors v is a table whose mask keeps the positions
with an odd inner product with v. Of any two fingerprints at most ``radius`` bits
apart, the vectors of the differing positions span less than the whole space,
so some v is orthogonal to all of them: that table's mask keeps none of the
differing bits, and the two collide there with certainty.

Buckets of up to ``cap`` fingerprints are compared in full and give the edges
of a spanning forest, never all pairs. Larger buckets are split again by the same
masks laid over the bits that their key leaves free, which keeps the guarantee,
until all buckets are small: distinct fingerprints that agree in all but f bits
are 2^f at most.

A similarity of 0.8 is a radius of about 15 % of the bits, for which one set of
masks would be far too large. :func:`similar_documents` takes wide fingerprints in
blocks: of a pair within ``blocks * (block_radius + 1) - 1`` bits some block
differs in ``block_radius`` bits at most, so the masks of that block collide.
:func:`similar_sets` takes these tables for candidates and compares the sets.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gondola.llm.components import components, thinned
from gondola.llm.runtime import LOWER, drop_written, release, releasing, utf8, written
from gondola.llm.shingle_sets import digests, exact_links, few_texts, set_id

BITS = 64
_BYTE_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.int64)
_BYTE_AT = np.arange(8, dtype=np.int64) * 256


def fingerprint(text: bytes | None, k: int = 3, seed: int = 42) -> bytes:
    """Eight bytes, most significant first: the majority bits of the XXH64 of all
    k-word shingles. Null or wordless texts: zero; fewer words: one shingle."""
    words = text.translate(LOWER).split() if text else []
    if not words:
        return bytes(8)
    line, digest = b" ".join(words), xxhash.xxh64_digest
    if len(words) <= k:
        return digest(line, seed)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = [0, *(ends[: -k] + 1).tolist()]
    hashes = b"".join([digest(line[a:b], seed) for a, b in zip(starts, ends[k - 1 :].tolist(), strict=True)])
    counts = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 1 << 22):
        bytes_ = np.frombuffer(hashes[at : at + (1 << 22)], np.uint8).reshape(-1, 8)
        tally = np.bincount((bytes_ + _BYTE_AT).ravel(), minlength=2048).reshape(8, 256)
        counts += (tally @ _BYTE_BITS).ravel()
    return np.packbits(2 * counts > len(hashes) // 8).tobytes()


def fingerprints(docs: DataFrame, k: int = 3, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, fp): the fingerprint of each row as a signed long."""
    schema = docs.select(F.col(key), F.lit(0).cast("long").alias("fp")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = b"".join([fingerprint(t, k) for t in utf8(batch.column(1))])
            yield pa.record_batch([batch.column(0), pa.array(np.frombuffer(made, ">i8").astype(np.int64))], [key, "fp"])

    return docs.select(key, text).mapInArrow(releasing(run), schema)


def masks(free: int, radius: int) -> list[int]:
    """The tables' masks over the bits of ``free``; 2^(radius + 1) - 1 of them."""
    space = 1 << (radius + 1)
    positions = [i for i in range(BITS) if free >> i & 1]
    vectors = {p: 1 + n % (space - 1) for n, p in enumerate(positions)}
    return [sum(1 << p for p, m in vectors.items() if (m & v).bit_count() & 1) for v in range(1, space)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def _forest(fps: np.ndarray, radius: int) -> tuple[list[int], list[int]]:
    """Edges (places in ``fps``, a row of 64-bit words each) of a spanning forest of
    the fingerprints within the radius."""
    left, src, dst = np.arange(len(fps)), [], []
    while len(left):
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            at = queue.pop()
            near = np.bitwise_count(fps[left] ^ fps[at]).sum(1) <= radius
            found = left[near].tolist()
            src += [int(at)] * len(found)
            dst += found
            queue += found
            left = left[~near]
    return src, dst


def _bucket_edges(batches: Iterator[pa.RecordBatch], radius: int) -> Iterator[pa.RecordBatch]:
    """From rows sorted by bucket (mask, key): each bucket's forest."""
    kept: list[np.ndarray] = [np.empty(0, np.int64) for _ in range(3)]

    def edges(cols: list[np.ndarray]) -> pa.RecordBatch:
        mask, key, fp = cols
        cut = np.flatnonzero((mask[1:] != mask[:-1]) | (key[1:] != key[:-1])) + 1
        src, dst = [], []
        for group in np.split(fp, cut):
            a, b = _forest(group[:, None], radius)
            src += group[a].tolist()
            dst += group[b].tolist()
        return pa.record_batch([pa.array(src, pa.int64()), pa.array(dst, pa.int64())], ["src", "dst"])

    for batch in batches:
        cols = [np.concatenate([old, batch.column(i).to_numpy()]) for i, old in enumerate(kept)]
        if not len(cols[0]):
            continue
        last = np.flatnonzero((cols[0] != cols[0][-1]) | (cols[1] != cols[1][-1]))
        cut = last[-1] + 1 if len(last) else 0
        kept = [c[cut:] for c in cols]
        if cut:
            yield edges([c[:cut] for c in cols])
    if len(kept[0]):
        yield edges(kept)


def near_edges(fps: DataFrame, radius: int, cap: int = 4096) -> DataFrame:
    """Edges (src, dst) between distinct fingerprints ``fps`` (fp: long) whose
    components are those of the graph of all pairs at most ``radius`` bits apart."""
    spark = fps.sparkSession
    close = f"bit_count(src ^ dst) <= {radius}"
    found: list[DataFrame] = []
    full = (1 << BITS) - 1
    level = {0: masks(full, radius)}  # a bucket's mask to the masks that split it
    rows = fps.select(F.lit(0).cast("long").alias("mask"), "fp")
    while True:
        if len(level) == 1:
            (tables,) = level.values()
            split = rows.withColumn("table", F.explode(F.array(*[F.lit(_signed(m)) for m in tables])))
        else:  # at most (2^(radius + 1) - 1)^2 rows: bounded by the radius alone
            pairs = [(_signed(a), _signed(b)) for a, tables in level.items() for b in tables]
            split = rows.join(F.broadcast(spark.createDataFrame(pairs, "mask long, table long")), "mask")
        split = split.select(F.col("table").alias("mask"), F.col("fp").bitwiseAND(F.col("table")).alias("key"), "fp")
        if len(level) > 1:  # some mask may come of several
            split = split.distinct()
        sizes = written(split.groupBy("mask", "key").agg(F.count("*").alias("n"), F.min("fp").alias("src"), F.max("fp").alias("dst")).where("n > 1"), "buckets")
        found.append(sizes.where("n = 2").where(close).select("src", "dst"))
        kept = split.join(sizes.where("n > 2").select("mask", "key", "n"), ["mask", "key"])
        small = kept.where(F.col("n") <= cap).select("mask", "key", "fp")
        parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
        dealt = small.repartition(parts, "mask", "key").sortWithinPartitions("mask", "key")
        found.append(dealt.mapInArrow(lambda it: _bucket_edges(it, radius), "src long, dst long"))
        if sizes.where(F.col("n") > cap).isEmpty():
            break
        rows = written(kept.where(F.col("n") > cap).select("mask", "fp"), "large-buckets")
        used = {r.mask & full for r in rows.select("mask").distinct().collect()}  # masks of this level: bounded by the radius
        level = {m: [m | x for x in masks(full & ~m, radius)] for m in used}
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def near_duplicates(docs: DataFrame, k: int = 3, radius: int = 2, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Each row's key with ``fp`` and ``component_id``, the smallest key reachable
    over links of at most ``radius`` bits.

    Texts without words share the fingerprint zero and are linked like any other.
    Equal texts have equal fingerprints, so copies are one node. Null keys take
    part; they give a component_id only where no other key is reachable (then
    null). Repeated rows are all returned. Empty tables give an empty result;
    other columns are ignored.
    """
    rows = written(fingerprints(docs, k, key, text), "fingerprints")
    nodes = written(rows.groupBy("fp").agg(F.min(key).alias("first")), "nodes")
    edges = near_edges(nodes.select("fp"), radius)
    return rows.join(_named(nodes, edges), "fp").select(key, "fp", "component_id")


def _named(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(fp, component_id, root) of all ``nodes`` (fp, first)."""
    roots = components(edges).select(F.col("node").alias("fp"), "root")
    linked = written(nodes.join(roots, "fp"), "linked")
    least = written(linked.groupBy("root").agg(F.min("first").alias("component_id")), "least")
    moved = linked.join(least, "root").select("fp", "component_id", "root")
    alone = nodes.join(roots.select("fp"), "fp", "left_anti").select("fp", F.col("first").alias("component_id"), F.col("fp").alias("root"))
    return written(moved.unionByName(alone), "named")


WORDS_WIDE = 3  # 64-bit words of a wide fingerprint


def wide_fingerprint(text: bytes | None, k: int = 5, block_bits: int = 28) -> bytes:
    """Six blocks of ``block_bits`` majority bits in 32 bits each. The bits are
    those of the XXH3-128 of the distinct k-word shingles and of a mix of its halves."""
    return majority(digests(text, k), block_bits)


def majority(pairs: np.ndarray, block_bits: int = 28) -> bytes:
    """The wide fingerprint of a set of digests."""
    counts = np.zeros(64 * WORDS_WIDE, np.int64)
    at_byte = np.arange(8 * WORDS_WIDE, dtype=np.int32) * 256
    for at in range(0, len(pairs), 1 << 16):
        pair = pairs[at : at + (1 << 16)]
        mixed = (pair[:, 0] ^ (pair[:, 1] >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15) + pair[:, 1] * np.uint64(0xBF58476D1CE4E5B9)
        rows = np.c_[pair, mixed ^ (mixed >> np.uint64(32))].view(np.uint8)
        tally = np.bincount((rows + at_byte).ravel(), minlength=len(at_byte) * 256).reshape(-1, 256)
        counts += (tally @ _BYTE_BITS).ravel()
    bits = np.packbits(2 * counts > len(pairs)).view("<u4") & np.uint32((1 << block_bits) - 1)
    return bits.tobytes()


def _cell_edges(fps: np.ndarray, keys: np.ndarray, radius: int, more_keys: list[Callable[[np.ndarray], np.ndarray]] = (), cap: int = 256, split_from: int = 1 << 15) -> tuple[np.ndarray, np.ndarray]:
    """Forest edges (places in ``fps``) of every bucket of equal keys. Buckets of up to
    ``cap`` are first looked through for links, all of them at once, a shift at a
    time; buckets of ``split_from`` or more are split again by ``more_keys``."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    size = np.diff(np.r_[first, len(keys)])
    bucket = np.repeat(np.arange(len(first)), size)
    after = np.repeat(first + size, size) - np.arange(len(keys)) - 1
    hit = size > cap
    after[hit[bucket]] = 0
    at, step = np.flatnonzero(after >= 1), 1
    while len(at):
        near = np.bitwise_count(fps[order[at]] ^ fps[order[at + step]]).sum(1) <= radius
        hit[bucket[at[near]]] = True
        step += 1
        at = at[after[at] >= step]
    src, dst = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    for b in np.flatnonzero(hit).tolist():
        mine = order[first[b] : first[b] + size[b]]
        if len(mine) < split_from or not more_keys:
            a, c = np.array(_forest(fps[mine], radius), np.int64).reshape(2, -1)
            src.append(mine[a])
            dst.append(mine[c])
            continue
        for key in more_keys:
            a, c = _cell_edges(fps[mine], key(fps[mine]), radius)
            src.append(mine[a])
            dst.append(mine[c])
    return np.concatenate(src), np.concatenate(dst)


def wide_edges(fps: DataFrame, radius: int, block_bits: int = 28, block_radius: int = 4, per_cell: int = 500_000, certain: bool = True, ids: bool = False) -> DataFrame:
    """Edges (src, dst) between distinct wide fingerprints ``fps`` (fp: binary). The
    components are those of the graph of all pairs at most ``radius`` bits apart.

    A table of a block's mask is cut by its keys' hash into cells of about
    ``per_cell`` fingerprints; a cell's fingerprints come packed to one task. With ``ids``,
    fp holds eight more bytes, the node's id, and src and dst are ids (long). With
    ``certain`` false the radius may pass what the blocks guarantee: farther pairs are
    then found where they collide.
    """
    blocks = 2 * WORDS_WIDE
    if certain and radius >= blocks * (block_radius + 1):
        raise ValueError("the blocks don't cover this radius")
    tables = [(j, m) for j in range(blocks) for m in masks((1 << block_bits) - 1, block_radius)]
    parts = max(1, -(-fps.count() // per_cell))
    width = WORDS_WIDE + ids

    def keys_of(x: np.ndarray, table: int) -> np.ndarray:
        j, mask = tables[table]
        return x.view("<u4")[:, j] & np.uint32(mask)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[bytes] = []

        def flush() -> Iterator[pa.RecordBatch]:
            x = np.frombuffer(b"".join(held), "<u8").reshape(-1, width)
            for t in range(len(tables)):
                part = (keys_of(x, t).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)) % np.uint64(parts)
                cells, blobs = [], []
                for p in np.unique(part).tolist():
                    cells.append(t * parts + p)
                    blobs.append(x[part == p].tobytes())
                yield pa.record_batch([pa.array(cells, pa.int32()), pa.array(blobs, pa.binary())], ["cell", "blob"])

        for batch in batches:
            held += batch.column(0).to_pylist()
            if len(held) >= 100_000:
                yield from flush()
                held = []
        if held:
            yield from flush()

    kind = "long" if ids else "binary"

    def pair_up(cell: pa.Table) -> pa.Table:
        x = np.frombuffer(b"".join(cell["blob"].to_pylist()), "<u8").reshape(-1, width)
        table = cell["cell"][0].as_py() // parts
        fp = np.ascontiguousarray(x[:, :WORDS_WIDE])
        others = [lambda y, t=t: keys_of(y, t) for t in range(len(tables)) if tables[t][0] != tables[table][0]]
        a, b = _cell_edges(fp, keys_of(fp, table), radius, others)
        release()
        if ids:
            return pa.table([pa.array(x[y, WORDS_WIDE].view(np.int64)) for y in (a, b)], names=["src", "dst"])
        flat = [pa.FixedSizeBinaryArray.from_buffers(pa.binary(8 * WORDS_WIDE), len(y), [None, pa.py_buffer(fp[y].tobytes())]) for y in (a, b)]
        return pa.table([y.cast(pa.binary()) for y in flat], names=["src", "dst"])

    dealt = fps.select("fp").mapInArrow(releasing(deal), "cell int, blob binary")
    return dealt.groupBy("cell").applyInArrow(pair_up, f"src {kind}, dst {kind}")


def similar_documents(docs: DataFrame, k: int = 5, radius: int = 27, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Like :func:`near_duplicates`, for the similarity of k-word shingle sets: links
    are wide fingerprints (168 bits) at most ``radius`` bits apart.

    Two sets of like size with Jaccard similarity s differ in
    ``168 * acos(2 s / (1 + s)) / pi`` bits on average: 25 at 0.8. Returns each row's
    key with ``text_hash`` (of its whole text), ``component_id`` and ``root``, equal for a component;
    nulls, empty texts, repeated rows and empty tables as there.
    """
    hashed = docs.select(F.col(key), F.col(text), F.xxhash64(text).alias("text_hash"))
    schema = hashed.select(key, "text_hash", F.lit(None).cast("binary").alias("fp")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [wide_fingerprint(t, k) for t in utf8(batch.column(1))]
            yield pa.record_batch([batch.column(0), batch.column(2), pa.array(made, pa.binary())], [key, "text_hash", "fp"])

    rows = written(hashed.mapInArrow(releasing(run), schema), "wide-fingerprints")
    nodes = written(rows.groupBy("fp").agg(F.min(key).alias("first")), "nodes")
    return rows.join(_named(nodes, wide_edges(nodes, radius)), "fp").select(key, "text_hash", "component_id", "root")


#: Bits that candidates may differ in: sets of similarity 0.8 differ in 25 of 168 on
#: average, with a standard deviation of 5.
CANDIDATE_BITS = 40


def similar_sets(docs: DataFrame, k: int, similarity: Fraction, key: str = "doc_id", text: str = "text", bits: int = CANDIDATE_BITS) -> DataFrame:
    """Like :func:`similar_documents`, but links are pairs of shingle sets of Jaccard
    similarity ``similarity`` or more: the covering tables group the candidates, and
    their sets are compared exactly (``shingle_sets``).

    Pairs up to 29 bits apart are candidates for certain; farther ones, up to ``bits``,
    where one of 186 masks agrees. At a similarity of just 0.8 that misses about one pair
    in a thousand for the tables, and one in a thousand for the radius.
    """
    hashed = docs.select(F.col(key), F.col(text).alias("text"), F.xxhash64(text).alias("text_hash"))
    schema = hashed.select(key, "text_hash", F.lit(0).cast("long").alias("id"), F.lit(None).cast("binary").alias("fp")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, part in few_texts(batches, 1):
            made = [digests(t, k) for t in part]
            ids = np.array([set_id(x) for x in made], np.int64)
            yield pa.record_batch([batch.column(0), batch.column(2), pa.array(ids), pa.array([majority(x) + i.tobytes() for x, i in zip(made, ids, strict=True)], pa.binary())], schema.names)

    rows = written(hashed.mapInArrow(releasing(run), schema), "wide-fingerprints")
    nodes = written(rows.groupBy("id").agg(F.min(key).alias("first"), F.min("text_hash").alias("text_hash"), F.any_value("fp").alias("fp")), "nodes")
    near = written(wide_edges(nodes, bits, certain=False, ids=True).distinct(), "candidates")
    groups = components(thinned(near))
    members = nodes.join(groups.select(F.col("node").alias("id"), F.col("root").alias("comp")), "id").select("id", "comp", "text_hash", F.substring("fp", 1, 8 * WORDS_WIDE).alias("fp"))
    links = exact_links(members, hashed.select("text_hash", "text"), k, similarity, bits)
    found = written(rows.withColumnRenamed("fp", "_").withColumnRenamed("id", "fp").join(_named(nodes.select(F.col("id").alias("fp"), "first"), links), "fp").select(key, "text_hash", "component_id", "root"), "similar")
    drop_written(rows, nodes, near, groups, links)
    return found


def keep_one(docs: DataFrame, k: int = 5, radius: int = 27, key: str = "doc_id", text: str = "text", similarity: Fraction | None = None) -> DataFrame:
    """``docs`` without near copies: of each component of :func:`similar_documents`
    the row with the smallest key; of rows of that key the one with the smallest text hash, once.
    With ``similarity``, those of :func:`similar_sets`; ``radius`` then counts for nothing."""
    found = similar_documents(docs, k, radius, key, text) if similarity is None else similar_sets(docs, k, similarity, key, text)
    mine = found.where(F.col(key).eqNullSafe(F.col("component_id")))
    keep = written(mine.groupBy("root").agg(F.min(F.struct(F.col("text_hash").alias("h"), F.col(key).alias("id"))).alias("m"), F.count("*").alias("n")).select("m.h", "m.id", "n"), "kept")
    kept = docs.join(keep.select("h", "id"), F.col(key).eqNullSafe(F.col("id")) & (F.xxhash64(text) == F.col("h")), "left_semi")
    if keep.where("n > 1").isEmpty():
        return kept
    return kept.withColumn("_h", F.xxhash64(text)).dropDuplicates([key, "_h"]).drop("_h")
