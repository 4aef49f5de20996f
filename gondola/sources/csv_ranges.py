"""CSV files with quoted line ends, read in parallel.

Spark splits a text file into ranges of whole lines, but a line may begin inside a
quoted cell, and only the lines before it tell. A first pass finds for each range
what either beginning would lead to: where the range would end, inside or outside a
cell, and the piece of a record that reaches over each of its borders. Ranges'
answers are composed along the file by windows over one row for each range; then
every range knows its beginning, and a second pass cuts its lines into records from
the first true record end. Records over borders are put together from the pieces.

Records end at line feeds, with or without a carriage return before. A quote opens a
cell only as its first character; elsewhere in an open cell it is text.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, islice, pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gondola.sources.paths import new_path

#: Ranges whose beginnings are sent to all tasks; of more, lines are dealt by range.
SENT_RANGES = 100_000
#: Characters of a piece that the first pass hands on; longer ones are read again where they are needed.
PIECE = 1 << 20
_BOM = "﻿"
# A cell from its start; and lines after which none is open, from outside and from inside one.
_CELL = r'(?:[^",][^,]*|"(?:[^"]|"")*"(?:[^",][^,]*)?)?'
_CLOSED = (rf"\A{_CELL}(?:,{_CELL})*\z", rf'\A(?:[^"]|"")*"(?:[^",][^,]*)?(?:,{_CELL})*\z')
_SURVEY = pa.schema([
    ("file", pa.string()), ("start", pa.int64()), ("length", pa.int64()), ("out_end", pa.int32()), ("in_end", pa.int32()), ("out_none", pa.bool_()), ("in_cut", pa.bool_()),
    ("out_tail", pa.string()), ("in_head", pa.string()), ("in_tail", pa.string()), ("out_tail_long", pa.bool_()), ("in_head_long", pa.bool_()), ("in_tail_long", pa.bool_()),
])
_SURVEYED = "file string, start long, length long, out_end int, in_end int, out_none boolean, in_cut boolean, out_tail string, in_head string, in_tail string, out_tail_long boolean, in_head_long boolean, in_tail_long boolean"


def open_after(line: str, inside: bool) -> bool:
    """Whether a quoted cell is open at the line's end, from whether one is at its start."""
    if '"' not in line:
        return inside
    at = 0
    while True:
        if not inside:  # at a cell's start
            if line[at : at + 1] != '"':
                at = line.find(',"', at) + 1
                if not at:
                    return False
            at += 1
        close = line.find('"', at)
        while close >= 0 and line[close + 1 : close + 2] == '"':
            close = line.find('"', close + 2)
        if close < 0:
            return True
        at, inside = line.find(",", close) + 1, False
        if not at:
            return False


def _after(lines: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """``open_after`` of each line, from outside and from inside a cell."""
    out, inside = np.zeros(len(lines), bool), np.ones(len(lines), bool)
    at = np.flatnonzero(pc.match_substring(lines, '"').to_numpy(zero_copy_only=False))
    if len(at):
        quoted = lines.take(pa.array(at)).cast(pa.binary())
        out[at], inside[at] = (~pc.match_substring_regex(quoted, closed).to_numpy(zero_copy_only=False) for closed in _CLOSED)
    return out, inside


def _states(out: np.ndarray, inside: np.ndarray, begin: bool) -> np.ndarray:
    """Whether a cell is open after each of the lines that follow each other, from
    whether one is at the first one's start: the last fixed end, as ``_begun`` has it."""
    flips = np.cumsum(out & ~inside)
    fixed = np.maximum.accumulate(np.where(out == inside, np.arange(len(out)), -1))
    known = fixed >= 0
    return np.where(known, out[fixed], begin) ^ ((flips - np.where(known, flips[fixed], 0)) % 2 == 1)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, pa.Array, bool]]:
    """(file, start, length), lines, and whether it's the range's last piece; a range's
    lines follow each other, over batches too."""
    held: tuple | None = None
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        files, starts, lines = (batch[i] for i in (0, 1, 3))
        lines.validate(full=True)  # text that isn't UTF-8 is an error
        same = pc.and_(pc.equal(files[1:], files[:-1]), pc.equal(starts[1:], starts[:-1])).to_numpy(zero_copy_only=False)
        borders = [0, *(np.flatnonzero(~same.astype(bool)) + 1).tolist(), n]
        for begin, end in pairwise(borders):
            key = tuple(batch[i][begin].as_py() for i in range(batch.num_columns) if i != 3)
            if held is not None and held[:2] != key[:2]:
                yield held, lines[:0], True
            held = key
            yield key, lines[begin:end], False
    if held is not None:
        yield held, pa.array([], pa.string()), True


class _Cutter:
    """Cuts a range's lines into records, from one beginning. With a ``limit`` only what
    reaches over the range's borders is made, and of that as many characters held; more
    of it is only marked as long."""

    def __init__(self, inside: bool, limit: int | None = None) -> None:
        self.inside, self.limit = inside, limit
        self.cut = not inside  # whether the first true record end is behind
        self.ended, self.head, self.head_long = False, None, False
        self.pending: list[pa.Array] = []
        self.size, self.long = 0, False

    def add(self, lines: pa.Array, after: tuple[np.ndarray, np.ndarray]) -> list[pa.Array]:
        """The records that the lines end, of those that began in this range."""
        if not len(lines):
            return []
        states, begin, records = _states(*after, self.inside), 0, []
        ends = np.flatnonzero(~states)
        if len(ends):
            if self.inside:  # ends what is pending
                begin = int(ends[0]) + 1
                self._hold(lines[:begin])
                if self.cut:
                    records += [] if self.limit is not None else [pa.array([self._text()], lines.type)]
                else:
                    self.head, self.head_long, self.cut = self._text(), self.long, True
                self.pending, self.size, self.long, ends = [], 0, False, ends[1:]
            if len(ends) and self.limit is None:
                records.append(_joined(lines, begin, ends))
            begin, self.ended = int(ends[-1]) + 1 if len(ends) else begin, True
        self.inside = bool(states[-1])
        self._hold(lines[begin:])
        return records

    def _hold(self, lines: pa.Array) -> None:
        if self.long or not len(lines):
            return
        if self.limit is not None:
            self.size += pc.sum(pc.utf8_length(lines)).as_py() + len(lines)
            self.long = self.size > self.limit
        self.pending = [] if self.long else [*self.pending, lines]

    def _text(self) -> str | None:
        return None if self.long else "\n".join(x for lines in self.pending for x in lines.to_pylist())

    def tail(self) -> str | None:
        """What the range begins and doesn't end."""
        return self._text() if self.inside else None


def _joined(lines: pa.Array, begin: int, ends: np.ndarray) -> pa.Array:
    """The records from line ``begin`` on, each up to one of the lines ``ends``."""
    if len(ends) == ends[-1] + 1 - begin:
        return lines[begin : begin + len(ends)]
    return pc.binary_join(pa.ListArray.from_arrays(pa.array([begin, *(ends + 1).tolist()], pa.int32()), lines), pa.scalar("\n", lines.type))


def _first(start: int, lines: pa.Array, begun: bool) -> pa.Array:
    """The lines without a file's byte order mark."""
    if start or begun or not len(lines) or not lines[0].as_py().startswith(_BOM):
        return lines
    return pa.concat_arrays([pa.array([lines[0].as_py().removeprefix(_BOM)], lines.type), lines[1:]])


def _survey(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[pa.RecordBatch]:
    """A row for each range: what either beginning leads to."""
    cutters: list[_Cutter] = []
    for key, lines, last in _blocks(batches):
        lines = _first(key[1], lines, bool(cutters))
        cutters, after = cutters or [_Cutter(False, limit), _Cutter(True, limit)], _after(lines)
        for c in cutters:
            c.add(lines, after)
        if last:
            out, in_ = cutters
            row = [*key, int(out.inside), int(in_.inside), not out.ended, in_.cut, out.tail(), in_.head, in_.tail(), out.long, in_.head_long, in_.long]
            yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, _SURVEY, strict=True)], schema=_SURVEY)
            cutters = []


def _records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The whole records of each range, without a file's first one."""
    cutter, skip = None, 0
    for (_, start, _, inside), lines, last in _blocks(batches):
        lines = _first(start, lines, cutter is not None)
        if cutter is None:
            cutter, skip = _Cutter(bool(inside)), int(start == 0)
        for made in cutter.add(lines, _after(lines)):
            made, skip = made[skip:], 0
            if len(made):
                yield pa.record_batch([made], ["record"])
        if last:
            cutter = None


def _long_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pieces of some ranges, whatever their length."""
    cutter = None
    for (file, start, _, inside), lines, last in _blocks(batches):
        lines = _first(start, lines, cutter is not None)
        cutter = cutter or _Cutter(bool(inside))
        cutter.add(lines, _after(lines))
        if last:
            tail = (cutter.tail(), 1 if cutter.cut else 0)
            found = [(t, at) for t, at in ((cutter.head, 0), tail) if t is not None]
            yield pa.record_batch([pa.array([file] * len(found), pa.string()), pa.array([start] * len(found), pa.int64()), pa.array([at for _, at in found], pa.int32()), pa.array([t for t, _ in found], pa.string())], ["file", "start", "at", "text"])
            cutter = None


def _lines(spark: SparkSession, path: str) -> DataFrame:
    meta = lambda c: F.col(f"_metadata.{c}")
    return spark.read.text(path, lineSep="\n").select(meta("file_path").alias("file"), meta("file_block_start").alias("start"), meta("file_block_length").alias("length"), "value")


def _dealt(lines: DataFrame, ranges: DataFrame, how: str) -> DataFrame:
    """The lines with what is known of their ranges, each range's lines in order."""
    on = ["file", "start"]
    if ranges.count() <= SENT_RANGES:
        return lines.join(F.broadcast(ranges), on, how)
    return lines.withColumn("_n", F.monotonically_increasing_id()).join(ranges, on, how).repartition(*on).sortWithinPartitions(*on, "_n").drop("_n")


def _begun(ranges: DataFrame) -> DataFrame:
    """The ranges with ``inside``: 1 where one begins inside a quoted cell. A range maps
    either beginning to an end: to one end, whatever the beginning (``fixed``), or it
    keeps or flips it. So a beginning is the last fixed end before it, flipped as often
    as ranges since then flip."""
    before = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    flips = F.when((F.col("out_end") == 1) & (F.col("in_end") == 0), 1).otherwise(0)
    seen = ranges.withColumn("_flips", F.coalesce(F.sum(flips).over(before), F.lit(0)))
    fixed = F.when(F.col("out_end") == F.col("in_end"), F.struct(F.col("out_end").alias("end"), F.col("_flips").alias("flips")))
    last = F.last(fixed, ignorenulls=True).over(before)
    return seen.withColumn("_last", last).withColumn("inside", F.when(F.col("_last").isNull(), F.col("_flips") % 2).otherwise((F.col("_last.end") + F.col("_flips") - F.col("_last.flips")) % 2).cast("int")).drop("_last", "_flips")


def _over_borders(begun: DataFrame, lines: DataFrame) -> DataFrame:
    """The records that reach over the borders of ranges, without a file's first one."""
    inside = F.col("inside") == 1

    def piece(name: str, at: int, where: Column) -> Column:
        there = where & (F.col(name).isNotNull() | F.col(f"{name}_long"))
        return F.when(there, F.struct(F.lit(at).alias("at"), F.col(name).alias("text"), F.col(f"{name}_long").alias("long")))

    # the end of what ranges before began; a range that is inside throughout; a beginning
    parts = F.array(piece("in_head", 0, inside & F.col("in_cut")), piece("in_tail", 0, inside & ~F.col("in_cut")), piece("in_tail", 1, inside & F.col("in_cut")), piece("out_tail", 1, ~inside))
    pieces = begun.select("file", "start", "inside", F.explode(F.array_compact(parts)).alias("p")).select("file", "start", "inside", "p.*")
    again = pieces.where("long").select("file", "start", "inside").distinct()
    short = pieces.select("file", "start", "at", "text")
    if not again.isEmpty():
        read = _dealt(lines, again, "inner").select("file", "start", "length", "value", "inside")
        short = pieces.join(again, ["file", "start"], "left_anti").select("file", "start", "at", "text").unionByName(read.mapInArrow(_long_pieces, "file string, start long, at int, text string"))
    order = Window.partitionBy("file").orderBy("start", "at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = short.withColumn("nth", F.sum("at").over(order)).groupBy("file", "nth").agg(F.sort_array(F.collect_list(F.struct("start", "at", "text"))).alias("x"), F.min("start").alias("start"))
    headers = begun.where("start = 0 and out_none").select("file", "start")
    record = F.array_join(F.col("x.text"), "\n")
    return whole.join(headers, ["file", "start"], "left_anti").select(record.alias("record"))


def header(spark: SparkSession, path: str) -> list[str]:
    """The column names: the cells of the first file's first record."""
    files = sorted(spark.read.text(path).inputFiles())
    if not files:
        return []
    n = 64
    while True:
        lines = [r.value for r in spark.read.text(files[0], lineSep="\n").head(n)]
        lines = [lines[0].removeprefix(_BOM), *lines[1:]] if lines else lines
        ends = accumulate(lines, lambda inside, line: open_after(line, inside), initial=False)
        record = next(("\n".join(lines[: i + 1]) for i, inside in enumerate(islice(ends, 1, None)) if not inside), None)
        if record is not None or len(lines) < n:
            record = "\n".join(lines) if record is None else record
            break
        n *= 8
    import csv
    import io

    return next(csv.reader(io.StringIO(record.removesuffix("\r"))), [])


def parsed(records: DataFrame, names: list[str]) -> DataFrame:
    """The records' cells as text columns; of equal names the last, as dictionaries have
    it. Records without quotes and line ends are split at commas, others parsed, once:
    taken out of ``from_csv`` itself, each cell would parse its record anew."""
    record, last = F.col("record"), {name: i for i, name in enumerate(names)}
    odd = record.rlike('["\\r\\n\\x00]')
    cells = F.from_csv(record, ", ".join(f"c{i} string" for i in range(len(names))), {"quote": '"', "escape": '"', "multiLine": "true", "maxCharsPerColumn": "-1"})
    both = records.withColumn("_odd", odd).select(F.when(F.col("_odd"), cells).alias("_parsed"), F.when(~F.col("_odd"), F.split(record, ",")).alias("_split"))
    return both.select(*[F.coalesce(F.col(f"_parsed.c{i}"), F.nullif(F.get("_split", F.lit(i)), F.lit(""))).alias(name) for name, i in last.items()])


def read_ranges(spark: SparkSession, path: str) -> DataFrame:
    """The file's (or the folder's files') columns as text. The first record of each
    file is its header; the first file's names hold. Blank lines are no rows, short
    rows are filled up with nulls, cells beyond the header are left out. A cell that is
    still open at the file's end goes to its end, but for a last line end. Rows come in
    no particular order."""
    names = header(spark, path)
    if not names:
        return spark.createDataFrame([], "_none string").drop("_none")
    lines = _lines(spark, path)
    kept, limit = new_path(spark, "csv-ranges"), PIECE
    lines.mapInArrow(lambda it: _survey(it, limit), _SURVEYED).repartition("file").write.parquet(kept)  # few files
    ranges = spark.read.schema(_SURVEYED).parquet(kept)
    begun = _begun(ranges)
    starts = begun.select("file", "start", F.col("length").alias("_length"), "inside")
    # the same ranges must come again: if the reader cut the file otherwise, stop
    same = F.when(F.col("_length") == F.col("length"), F.col("inside")).otherwise(F.raise_error(F.lit("the file's ranges changed between two passes; read it again")).cast("int"))
    known = _dealt(lines, starts, "left")
    cut = known.select("file", "start", "length", "value", same.alias("inside")).mapInArrow(_records, "record string")
    record = F.col("record")
    bare = F.when(record.endswith("\r"), record.substr(F.lit(1), F.length(record) - 1)).otherwise(record)
    return parsed(cut.unionByName(_over_borders(begun, lines)).select(bare.alias("record")).where("record <> ''"), names)
