"""Source divergence audit: how far the term rates of a language's sources lie apart.

The index has a posting list for each kept term of a language: the sources that use
it and how often. With smoothing, a term that a source lacks still has a rate, which
depends on the source alone; so two sources that shared no term at all would differ
by V times the difference f of these two rates. Each pair of sources starts from that
baseline, and postings only correct it:

- A term of one source, alone, moves that source's rate by a step d above its own
  baseline. Against a source whose baseline lies e higher, that changes the distance
  by d - 2 min(d, max(e, 0)). Steps are counted by size and summed running along
  their sorted values, once for all other sources, so no term is met with every
  source.
- A term that both have changes it once more, where the two single corrections don't
  add up; posting lists emit these joint corrections, nonzero ones only, and Spark adds
  them up by pair in the tasks before they travel.

Rates are whole numbers, floor(rate_scale * p) + 1, and all sums are exact. The words
are counted in tasks; everything after is DataFrame code.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gondola.llm.runtime import releasing, utf8, written

RATE_SCALE = 1_000_000_000
#: Distinct (language, source, term) that a task counts before it sends them on.
HELD = 1 << 18
_PIECE = 1 << 20
#: For bytes.translate: A-Z lower-cased; a-z and 0x80 up stand; the rest spaces.
LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))

_COUNTS = "lang string, source string, term string, n long, docs long"


def _terms(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a text, a list for each _PIECE bytes or so."""
    line, at = text.translate(LETTERS), 0
    while at < len(line):
        end = line.find(b" ", at + _PIECE) if len(line) - at > _PIECE else -1
        end = end if end >= 0 else len(line)
        yield line[at:end].split()
        at = end


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Occurrences and documents of each term by language and source, as far as the
    task has read; a row without a term for each language and source."""
    held: dict[tuple[bytes, bytes], tuple[Counter, Counter]] = {}
    seen: set[tuple[bytes, bytes]] = set()

    def flush() -> Iterator[pa.RecordBatch]:
        for (lang, source), (n, docs) in held.items():
            new = (lang, source) not in seen
            seen.add((lang, source))
            terms = list(n) + [None] * new
            if terms:
                size = len(terms)
                text = [pa.array(x, pa.binary()).view(pa.string()) for x in ([lang] * size, [source] * size, terms)]
                yield pa.record_batch([*text, pa.array([*n.values(), *[0] * new], pa.int64()), pa.array([*(docs[t] for t in n), *[0] * new], pa.int64())], ["lang", "source", "term", "n", "docs"])
        held.clear()

    size = 0
    for batch in batches:
        for lang, source, text in zip(*(utf8(batch[c]) for c in ("lang", "source", "text")), strict=True):
            n, docs = held.setdefault((lang or b"", source or b""), (Counter(), Counter()))
            size -= len(n)
            mine: set[bytes] = set()
            for piece in _terms(text or b""):
                n.update(piece)
                mine.update(piece)
            docs.update(mine)
            size += len(n)
            if size >= HELD:
                yield from flush()
                size = 0
    yield from flush()


def postings(docs: DataFrame, least_docs: int) -> DataFrame:
    """(lang, term, total, sources: array of (source, n)) of each term in at least
    ``least_docs`` documents of its language; and a row without a term for each
    language, which names all its sources."""
    counted = docs.select("lang", "source", "text").mapInArrow(releasing(_count), _COUNTS)
    by_source = counted.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    lists = by_source.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("total"), F.collect_list(F.struct("source", "n")).alias("sources"))
    return lists.where(F.col("term").isNull() | (F.col("docs") >= least_docs)).select("lang", "term", "total", "sources")


def rate(count: Column, size: Column, smoothing: int) -> Column:
    """1 + floor(RATE_SCALE * (count + smoothing) / size), in whole numbers."""
    part = F.lit(RATE_SCALE).cast("decimal(10,0)") * (count + smoothing).cast("decimal(20,0)")
    return F.try_divide(part - part % size.cast("decimal(20,0)"), size.cast("decimal(20,0)")).cast("long") + 1


def audit(docs: DataFrame, least_docs: int = 30, smoothing: int = 5, top: int = 50) -> DataFrame:
    """Rows (lang, source, part, item, value, rank): for part ``pair`` every other source
    of the language and the sum of |p - q| over the kept terms, for part ``term`` the
    ``top`` terms that the source has and uses more than its language does, with p - q.

    A language keeps the terms (letters and bytes from 0x80 up, A-Z lower-cased) that
    stand in at least ``least_docs`` of its documents. Null and empty texts, languages
    and sources count as ''; sources without terms are compared too. Equal values
    are ranked by the item's UTF-8 bytes. Repeated rows count each; doc_id and other
    columns don't matter. A language of one source has no pairs; an empty table
    gives no rows. ``smoothing`` must be positive.
    """
    if smoothing < 1:
        raise ValueError("smoothing must be positive")
    index = written(postings(docs, least_docs), "postings")
    terms = index.where("term is not null")
    points = terms.select("lang", "term", "total", F.explode("sources").alias("x")).select("lang", "term", "total", "x.source", "x.n")

    # of each language and each source: sizes, and the rate of a term that is not there
    langs = index.groupBy("lang").agg(F.count("term").alias("v"), F.coalesce(F.sum("total"), F.lit(0)).alias("n"))
    langs = langs.select("lang", "v", (F.col("n") + smoothing * F.col("v")).alias("lang_size"))
    named = index.where("term is null").select("lang", F.explode("sources").alias("x")).select("lang", "x.source")
    used = points.groupBy("lang", "source").agg(F.sum("n").alias("n"), F.count("*").alias("terms"))
    sizes = named.join(used, ["lang", "source"], "left").na.fill(0, ["n", "terms"]).join(langs, "lang")
    size = F.col("n") + smoothing * F.col("v")
    none = F.when(F.col("v") > 0, rate(F.lit(0), F.col("size"), smoothing)).otherwise(0)
    sources = written(sizes.withColumn("size", size).withColumn("zero", none).select("lang", "source", "v", "terms", "size", "lang_size", "zero"), "sources")
    rated = points.join(sources, ["lang", "source"])
    rated = written(rated.select("lang", "source", "term", "zero", rate(F.col("n"), F.col("size"), smoothing).alias("p"), rate(F.col("total"), F.col("lang_size"), smoothing).alias("q")), "rates")

    # every ordered pair of a language's sources with its baseline: the result's rows
    others = sources.groupBy("lang").agg(F.collect_list(F.struct("source", "zero")).alias("others"))
    grid = sources.join(others, "lang").select("lang", "source", "v", "terms", "zero", F.explode("others").alias("o")).where("o.source <> source")
    grid = grid.select("lang", "source", F.col("o.source").alias("item"), "v", "terms", (F.col("o.zero") - F.col("zero")).alias("e"))
    base = grid.select("lang", "source", "item", (F.col("v") * F.abs("e")).alias("value"))

    # single corrections: steps by size, with the other sources' differences among them
    steps = rated.groupBy("lang", "source", (F.col("p") - F.col("zero")).alias("x")).agg(F.count("*").alias("k"))
    marks = steps.select("lang", "source", "x", "k", F.lit(None).cast("string").alias("item"), F.lit(0).cast("long").alias("terms"))
    marks = marks.unionByName(grid.select("lang", "source", F.greatest("e", F.lit(0)).alias("x"), F.lit(0).cast("long").alias("k"), "item", "terms"))
    up_to = Window.partitionBy("lang", "source").orderBy("x").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    below = marks.withColumn("sum", F.sum(F.col("k") * F.col("x")).over(up_to)).withColumn("many", F.sum("k").over(up_to)).where("item is not null")
    least = F.col("sum") + F.col("x") * (F.col("terms") - F.col("many"))  # sum of min(step, x)
    all_steps = steps.groupBy("lang", "source").agg(F.sum(F.col("k") * F.col("x")).alias("steps"))
    single = below.select("lang", "source", "item", (-2 * least).alias("value")).unionByName(grid.join(all_steps, ["lang", "source"]).select("lang", "source", "item", F.col("steps").alias("value")))

    # joint corrections of the terms that both have, nonzero ones only
    lists = rated.groupBy("lang", "term").agg(F.sort_array(F.collect_list(F.struct("source", "p", "zero"))).alias("x"))
    met = lists.where(F.size("x") > 1).select("lang", "x", F.posexplode("x").alias("i", "a"))
    met = met.select("lang", "a", F.explode(F.slice("x", F.col("i") + 2, F.size("x"))).alias("b"))  # a row for each pair, never a list of pairs
    gap = lambda x, y: F.abs(F.col(x) - F.col(y))
    met = met.select("lang", F.col("a.source").alias("source"), F.col("b.source").alias("item"), (gap("a.p", "b.p") - gap("a.p", "b.zero") - gap("b.p", "a.zero") + gap("a.zero", "b.zero")).alias("value"))
    joint = met.where("value <> 0").groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))

    # one-sided values count for a pair in both its orders
    turned = lambda df: df.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "value")
    every = base.unionByName(single).unionByName(turned(single)).unionByName(joint).unionByName(turned(joint))
    pairs = every.groupBy("lang", "source", "item").agg(F.sum("value").alias("value")).withColumn("part", F.lit("pair"))
    over = rated.where("p > q").select("lang", "source", F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"), F.lit("term").alias("part"))
    place = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    ranked = [pairs.withColumn("rank", place), over.withColumn("rank", place).where(F.col("rank") <= top)]
    columns = ["lang", "source", "part", "item", "value", "rank"]
    return ranked[0].select(*columns).unionByName(ranked[1].select(*columns))
