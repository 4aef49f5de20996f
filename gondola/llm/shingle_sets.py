"""Exact Jaccard similarity of shingle sets, within groups of likely candidates.

The covering tables of ``simhash`` name candidates; here their sets are compared.
A group's sets meet in blocks of bounded size, two blocks at a time in a task, and
only links leave it. In a group of very many sets all are first compared with one
near its middle; what is linked by then is not compared again, so that only the
others meet blocks of the rest.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gondola.llm.components import components
from gondola.llm.runtime import LOWER, drop_written, releasing, utf8, written


def digests(text: bytes | None, k: int = 5) -> np.ndarray:
    """The distinct XXH3-128 of all k-word shingles, sorted: rows of two 64-bit words.
    Null or wordless texts: none; fewer words: one shingle."""
    words = text.translate(LOWER).split() if text else []
    if not words:
        return np.empty((0, 2), np.uint64)
    line, digest = b" ".join(words), xxhash.xxh3_128_digest
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = [0, *(ends[: max(0, len(words) - k)] + 1).tolist()]
    found = {digest(line[a:b]) for a, b in zip(starts, ends[min(k, len(words)) - 1 :].tolist(), strict=True)}
    return np.frombuffer(b"".join(sorted(found)), "<u8").reshape(-1, 2)


def set_id(found: np.ndarray) -> int:
    """A set's name: a hash of all its digests, as a signed long."""
    return int(np.array([xxhash.xxh3_64_intdigest(found.tobytes())], np.uint64).view(np.int64)[0])


def few_texts(batches: Iterator[pa.RecordBatch], at: int) -> Iterator[tuple[pa.RecordBatch, list[bytes | None]]]:
    for batch in batches:
        for start in range(0, batch.num_rows, 512):  # few texts at a time as objects
            part = batch.slice(start, 512)
            yield part, utf8(part.column(at))


def _sets(texts: DataFrame, k: int) -> DataFrame:
    """(id, tokens): each text's set, as sorted 64-bit words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, part in few_texts(batches, 0):
            made = [digests(t, k) for t in part]
            yield pa.record_batch([pa.array([set_id(x) for x in made], pa.int64()), pa.array([np.unique(x[:, 0]).tobytes() for x in made], pa.binary())], ["id", "tokens"])

    return texts.select("text").mapInArrow(releasing(run), "id long, tokens binary")


def similar(a: np.ndarray, b: np.ndarray, s: Fraction) -> bool:
    p, q = s.numerator, s.denominator
    if min(len(a), len(b)) * q < max(len(a), len(b)) * p:
        return False
    return len(np.intersect1d(a, b, assume_unique=True)) * (p + q) >= (len(a) + len(b)) * p


def _links(table: pa.Table, s: Fraction, radius: int) -> pa.Table:
    """Links between sets of one group (and of two blocks of it) that are not linked yet."""
    out: list[tuple[int, int]] = []
    comp, ids, known, side = (table[c].to_numpy() for c in ("comp", "id", "known", "side"))
    fps = np.frombuffer(b"".join(table["fp"].to_pylist()), "<u8").reshape(len(ids), -1)
    order = np.argsort(comp, kind="stable")
    raw = table["tokens"]
    for rows in np.split(order, np.flatnonzero(np.diff(comp[order])) + 1):
        root: dict[int, int] = {}

        def find(x: int) -> int:
            while (up := root.get(x, x)) != x:
                root[x] = x = root.get(up, up)
            return x

        opened: dict[int, np.ndarray] = {}

        def tokens(i: int) -> np.ndarray:
            if i not in opened:
                opened[i] = np.frombuffer(raw[i].as_buffer(), "<i8")
            return opened[i]

        two, f, label = side[rows].max() > 0, fps[rows], known[rows]
        for n in range(len(rows)):
            rest = np.flatnonzero(side[rows] > 0) if two else np.arange(n + 1, len(rows))
            if two and side[rows[n]] > 0:
                continue
            far = np.bitwise_count(f[rest] ^ f[n]).sum(1)
            near = np.flatnonzero((far <= radius) & (label[rest] != label[n]))
            for m in rest[near[np.argsort(far[near], kind="stable")]].tolist():
                a, b = find(int(label[n])), find(int(label[m]))
                if a != b and similar(tokens(rows[n]), tokens(rows[m]), s):
                    root[a] = b
                    out.append((int(ids[rows[n]]), int(ids[rows[m]])))
    return pa.table({"src": pa.array([a for a, _ in out], pa.int64()), "dst": pa.array([b for _, b in out], pa.int64())})


def _stars(held: DataFrame, big: DataFrame, s: Fraction) -> DataFrame:
    """Links of the sets of ``big`` groups with one set near the group's middle: of all
    the one nearest to the majority of 63 fingerprints."""
    rows = held.join(big.select("comp", "m"), "comp")
    some = rows.withColumn("r", F.row_number().over(Window.partitionBy("comp").orderBy(F.xxhash64("id"), "id"))).where("r <= 63").select("comp", "fp")

    def middle(table: pa.Table) -> pa.Table:
        bits = np.unpackbits(np.frombuffer(b"".join(table["fp"].to_pylist()), np.uint8).reshape(table.num_rows, -1), axis=1)
        return pa.table({"comp": table["comp"][:1], "mid": pa.array([np.packbits(2 * bits.sum(0) > table.num_rows).tobytes()], pa.binary())})

    mids = written(some.groupBy("comp").applyInArrow(middle, "comp long, mid binary"), "middles")
    salt = F.pmod(F.xxhash64("id"), F.ceil(F.col("m") / 8192)).cast("int")
    salts = big.select("comp", F.explode(F.expr("sequence(0, cast(ceil(m / 8192) as int) - 1)")).alias("salt"))

    def distances(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (np.frombuffer(b"".join(batch[c].to_pylist()), np.uint8).reshape(batch.num_rows, -1) for c in ("fp", "mid"))
            yield pa.record_batch([batch["comp"], batch["id"], pa.array(np.bitwise_count(a ^ b).sum(1).astype(np.int32))], ["comp", "id", "far"])

    beside = rows.select("comp", "id", "fp", salt.alias("salt")).join(mids.join(salts, "comp"), ["comp", "salt"]).select("comp", "id", "fp", "mid")
    centre = beside.mapInArrow(distances, "comp long, id long, far int").groupBy("comp").agg(F.min(F.struct("far", "id")).getField("id").alias("root"))
    roots = written(rows.join(centre, "comp").where("id = root").select("comp", "root", F.col("tokens").alias("other")), "centres")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = [i for i in range(batch.num_rows) if similar(*(np.frombuffer(batch[c][i].as_buffer(), "<i8") for c in ("tokens", "other")), s)]
            yield batch.select(["id", "root"]).take(pa.array(ok, pa.int64()))

    pairs = rows.withColumn("salt", salt).join(roots.join(salts, "comp"), ["comp", "salt"]).where("id <> root").select("id", "root", "tokens", "other")
    out = written(pairs.mapInArrow(compare, "id long, root long").select(F.col("id").alias("src"), F.col("root").alias("dst")), "stars")
    drop_written(mids, roots)
    return out


def exact_links(members: DataFrame, texts: DataFrame, k: int, s: Fraction, radius: int, block: int = 512, block_tokens: int = 1 << 19, star_from: int = 4096) -> DataFrame:
    """Edges (src, dst) whose components are those of the graph of all pairs of sets of
    one group, at most ``radius`` fingerprint bits apart, of Jaccard similarity ``s`` or more.

    ``members``: id, comp (the group), text_hash, fp; ``texts``: text_hash, text. A block
    holds ``block`` sets and ``block_tokens`` shingles or so. Groups of more than
    ``star_from`` sets are first compared with their middle.
    """
    needed = texts.join(members.select("text_hash").distinct(), "text_hash", "left_semi")
    held = written(members.join(_sets(needed, k).dropDuplicates(["id"]), "id").select("comp", "id", "fp", "tokens"), "sets")
    sizes = written(held.groupBy("comp").agg(F.count("*").alias("m")), "groups")
    big = sizes.where(F.col("m") > star_from)
    stars, roots = None, None
    labels = held.select("comp", "id", F.col("id").alias("known"))
    if not big.isEmpty():
        stars = _stars(held, big, s)
        roots = components(stars)
        labels = held.select("comp", "id").join(roots.select(F.col("node").alias("id"), "root"), "id", "left").select("comp", "id", F.coalesce("root", "id").alias("known"))
    # a linked part of a block's size or more has blocks of its own, which don't meet each other
    parts = labels.groupBy("comp", "known").agg(F.count("*").alias("c")).select("comp", "known", F.when(F.col("c") >= block, F.col("known")).alias("kind"))
    open_ = parts.groupBy("comp").agg(F.count("*").alias("parts")).where("parts > 1").select("comp")
    rows = written(held.join(labels, ["comp", "id"]).join(parts.join(open_, "comp"), ["comp", "known"]).withColumn("kind", F.coalesce(F.col("kind").cast("string"), F.lit(""))), "labelled-sets")
    counts = rows.groupBy("comp", "kind").agg(F.greatest(F.ceil(F.count("*") / block), F.ceil(F.sum(F.octet_length("tokens")) / (8 * block_tokens)), F.lit(1)).cast("int").alias("nb"))
    counts = written(counts, "blocks")
    blocks = counts.select("comp", F.explode(F.expr("transform(sequence(0, nb - 1), i -> concat(kind, ':', i))")).alias("b"), "kind")
    a, b = (blocks.select("comp", F.col("b").alias(x), F.col("kind").alias(f"{x}_kind")) for x in ("x", "y"))
    met = a.join(b, "comp").where("x <= y and (x_kind <> y_kind or x_kind = '')").select("comp", "x", "y")  # pairs of blocks
    placed = rows.join(counts, ["comp", "kind"]).withColumn("b", F.concat("kind", F.lit(":"), F.pmod(F.xxhash64("id"), F.col("nb"))))
    cols = ["comp", "id", "fp", "tokens", "known"]
    left = placed.join(met.withColumnRenamed("x", "b"), ["comp", "b"]).select(*cols, F.col("b").alias("x"), "y", F.lit(0).alias("side"))
    right = placed.join(met.where("x <> y").withColumnRenamed("y", "b"), ["comp", "b"]).select(*cols, "x", F.col("b").alias("y"), F.lit(1).alias("side"))
    # groups of one block, most of all, are dealt many to a task
    few = max(1, -(-rows.count() // (8 * block)))
    alone = counts.groupBy("comp").agg(F.sum("nb").alias("nb")).where("nb = 1").select("comp", F.pmod(F.xxhash64("comp"), F.lit(few)).alias("pack"))
    dealt = left.unionByName(right).join(alone, "comp", "left")
    key = F.when(F.col("pack").isNotNull(), F.concat(F.lit("p"), "pack")).otherwise(F.concat_ws("|", "comp", "x", "y")).alias("task")
    found = dealt.select(key, *cols, "side").groupBy("task").applyInArrow(lambda t: _links(t, s, radius), "src long, dst long")
    links = written(found if stars is None else found.unionByName(stars), "links")
    drop_written(held, sizes, rows, counts, stars, roots)
    return links
