"""CSV files of scraped prices to the typed table.

All values are read as text, cleaned, and cast by the column's type. A row goes to
quarantine if a number is too large for its column; every other value that can't be
read is null, as in an empty cell.
"""

from __future__ import annotations

import datetime as dt
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gondola.schema import ALERTS, LOADED, PRICING, RUNS, SHELF
from gondola.sources.csv_ranges import read_ranges
from gondola.sources.versions import RUNNING, VersionedTable, numbered

# Texts that stand for no value (case matters).
NO_VALUE = ("", "nan", "NaN", "None", "NULL", "#N/A", "N/A")
# Fixed value: how a number may be written.
NUMBER = r"^[+-]?(\d+(_\d+)*\.?(\d+(_\d+)*)?|\.\d+(_\d+)*)([eE][+-]?\d+)?$"


# Fixed value: how a date is usually written.
DATE = r"\A[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}\z"


def _bare(c: Column) -> Column:
    """Without white space around it."""
    # a pattern's end may also stand before a last line end of these, which is no white space
    odd = c.endswith("\x85") | c.endswith("\u2028") | c.endswith("\u2029")
    return F.when(odd, F.regexp_replace(c, r"^\s+|\s+$", "")).otherwise(F.btrim(c, F.lit(" \t\n\x0b\f\r")))


def _digits(text: Column) -> Column:
    return F.replace(text, F.lit("_"), F.lit(""))


def _number_value(exact: Column, number: Column, kind: T.DataType) -> Column:
    """The number in the column's type, null if it is too large. What surely is isn't
    cast: a cast that fails costs as much as a hundred others."""
    if isinstance(kind, T.DecimalType):
        most = 10 ** (kind.precision - kind.scale)
        return F.coalesce(F.when(F.abs(exact) < most, exact.try_cast(kind)), F.when(F.abs(number) < 2.0 * most, number.try_cast(kind)))
    return F.when(F.abs(number) < 2.0**32, F.round(number).try_cast(kind))


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """The file's columns as text. Cells may hold quotes, commas and line ends; a
    byte order mark is skipped and short rows are filled up with nulls. A file is read
    by as many tasks as it has ranges."""
    return read_ranges(spark, path)


def _marked(raw: DataFrame) -> tuple[DataFrame, list[Column]]:
    """The raw rows with ``_bad``, and the table's columns over them. Each step of a cell
    is a column of its own, so that what several expressions ask of it is computed once:

    text: null where it stands for no value. number: as a double; null for anything
    else, infinity and NaN included; exact: as a decimal. A date as it is usually written
    is put together from its numbers, for a parser's errors cost more than the dates;
    other texts go through it.
    """
    there = set(raw.columns)
    held = {target: (F.col(f"`{source}`"), kind) for source, target, kind in LOADED if source in there}
    dates = [t for t, (_, kind) in held.items() if isinstance(kind, T.DateType)]
    numbers = [t for t, (_, kind) in held.items() if not isinstance(kind, T.StringType | T.DateType)]
    decimals = [t for t in numbers if isinstance(held[t][1], T.DecimalType)]
    name = "_{} of {}".format
    of = lambda step, t: F.col(f"`{name(step, t)}`")
    rows = raw.withColumns({name("bare", t): _bare(c) for t, (c, _) in held.items()})
    rows = rows.withColumns({name("text", t): F.when(~of("bare", t).isin(*NO_VALUE), of("bare", t)) for t in held})
    rows = rows.withColumns(
        {name("number", t): F.when(of("text", t).rlike(NUMBER), _digits(of("text", t)).try_cast("double")) for t in numbers} | {name("usual", t): of("text", t).rlike(DATE) for t in dates}
    )
    rows = rows.withColumns(
        {name("exact", t): F.when(of("number", t).isNotNull(), _digits(of("text", t)).try_cast(T.DecimalType(38, 12))) for t in decimals}
        | {name("month", t): F.when(of("usual", t), F.substring_index(F.substring(of("text", t), 6, 5), "-", 1).cast("int")) for t in dates}
        | {name("day", t): F.when(of("usual", t), F.substring_index(of("text", t), "-", -1).cast("int")) for t in dates}
    )
    rows = rows.withColumns(
        {name("value", t): _number_value(of("exact", t) if t in decimals else F.lit(None), of("number", t), held[t][1]) for t in numbers}
        | {name("first", t): F.when(of("month", t).between(1, 12), F.make_date(F.substring(of("text", t), 1, 4).cast("int"), of("month", t), F.lit(1))) for t in dates}
    )
    bad = F.lit(False)
    for t in numbers:
        bad = bad | (of("number", t).isNotNull() & of("value", t).isNull())
    usual = {t: F.when(of("day", t).between(1, F.day(F.last_day(of("first", t)))), F.date_add(of("first", t), of("day", t) - 1)) for t in dates}
    rows = rows.withColumns({name("value", t): F.when(of("usual", t), usual[t]).otherwise(F.try_to_date(of("text", t), "yyyy-M-d")) for t in dates} | {"_bad": bad})
    value = {t: of("value" if t in dates or t in numbers else "text", t) for t in held}
    return rows, [value.get(t, F.lit(None)).cast(kind).alias(t) for _, t, kind in LOADED]


def clean(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows of the table without id and created_at, quarantined raw rows). Unknown
    columns are ignored, missing ones null."""
    marked, columns = _marked(raw)
    return marked.where(~F.col("_bad")).select(*columns), marked.where("_bad").select(*[F.col(f"`{c}`") for c in raw.columns])


# What a column holds where an insert doesn't name it.
DEFAULTS: dict[str, dict[str, Callable[[], Column]]] = {
    "pricing": {"created_at": F.current_timestamp},
    "shelf": {"created_at": F.current_timestamp},
    "runs": {
        "id": F.uuid, "status": lambda: F.lit("running"), "rows_inserted": lambda: F.lit(0), "rows_updated": lambda: F.lit(0),
        "errors": F.array, "started_at": F.current_timestamp,
    },
    "alerts": {"id": F.uuid, "severity": lambda: F.lit("warning"), "context": F.create_map, "sent_email": lambda: F.lit(False), "created_at": F.current_timestamp},
}
_SCHEMAS = {"pricing": PRICING, "shelf": SHELF, "runs": RUNS, "alerts": ALERTS}


def with_defaults(rows: DataFrame, table: str = "pricing") -> DataFrame:
    """The rows as an insert into ``table`` (a key of DEFAULTS) would store them:
    columns that they lack hold their default, else null; those they have stand as
    they are, nulls too. A row without a value that the table demands is an error;
    the ids of pricing and shelf come from the load, not from here."""
    given, out = set(rows.columns), []
    for field in _SCHEMAS[table].fields:
        default = DEFAULTS[table].get(field.name)
        if field.name in given:
            value = F.col(field.name)
        elif default is None and not field.nullable:
            raise ValueError(f"{table}.{field.name} has no default")
        else:
            value = default() if default else F.lit(None)
        value = value.cast(field.dataType)
        if not field.nullable:
            value = F.coalesce(value, F.raise_error(F.lit(f"{table}.{field.name} is null")).cast(field.dataType))
        out.append(value.alias(field.name))
    return rows.select(*out)


@dataclass(frozen=True)
class LoadReport:
    run_id: str
    status: str
    total: int
    inserted: int
    errors: int
    seconds: float


def stage(raw: DataFrame, path: str) -> None:
    """Parse and clean once: good rows as the table has them in one folder of ``path``,
    the others as they were read in another. Columns are numbered, for the names of both
    may be the same but for case."""
    marked, columns = _marked(raw)
    spark = raw.sparkSession
    good = [c.alias(f"good_{i}") for i, c in enumerate(c for c, f in zip(columns, LOADED, strict=True) if f in _stored(raw))]
    bad = [F.when(F.col("_bad"), F.col(f"`{c}`")).alias(f"bad_{i}") for i, c in enumerate(raw.columns)]
    kept = {k: spark.conf.get(k) for k in _STAGING}
    for k, v in _STAGING.items():
        spark.conf.set(k, v)
    try:
        marked.select(*good, *bad, "_bad").write.mode("overwrite").partitionBy("_bad").parquet(path)
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)


# Two files for a task, in the order of its rows (with as many files as this they would be
# sorted); and methods of a size that the JVM compiles, however many columns there are.
_STAGING = {"spark.sql.maxConcurrentOutputFileWriters": "3", "spark.sql.codegen.hugeMethodLimit": "8000"}


def _stored(raw: DataFrame) -> list[tuple[str, str, T.DataType]]:
    """Of LOADED what a load of these rows writes: the columns they have. Files without a
    column are read as nulls, and dozens of columns of nulls cost more to write than
    the others."""
    return [f for f in LOADED if f[0] in raw.columns] or LOADED[:1]  # a file has a column


def _staged(spark: SparkSession, path: str, bad: bool, raw: DataFrame) -> DataFrame:
    """The rows of one kind, without a file if there are none."""
    fields = [(c, T.StringType()) for c in raw.columns] if bad else [(target, kind) for _, target, kind in _stored(raw)]
    names = {f"{'bad' if bad else 'good'}_{i}": c for i, (c, _) in enumerate(fields)}
    schema = T.StructType([*[T.StructField(n, kind) for n, (_, kind) in zip(names, fields, strict=True)], T.StructField("_bad", T.BooleanType())])
    return spark.read.schema(schema).parquet(path).where(F.col("_bad") == bad).select(*[F.col(n).alias(c) for n, c in names.items()])


def load(spark: SparkSession, path: str, table: str, truncate: bool = False, name: str = "csv_load", run_id: str | None = None, dead_after: dt.timedelta = dt.timedelta(hours=12)) -> LoadReport:
    """Append the file's rows to the table at the path ``table`` (or, with ``truncate``,
    put them in place of all others), and put aside those that it can't hold.

    The rows, the quarantine and the run's end ("success", or "partial" with rows put
    aside) become visible in one step; a load that stops anywhere before leaves the
    table as it was and its run "running". Loading again with the same ``run_id`` takes
    such a run up; a run that is done is not loaded twice. Runs of others that are open
    longer than ``dead_after`` are closed as "failed" and can't be finished any more.
    Ids are 1..n without a gap over all loads, from 1 again after a truncate.
    """
    clock = time.monotonic()
    target, run_id = VersionedTable(spark, table), run_id or str(uuid.uuid4())
    run = target.begin(run_id, name, dead_after)
    if run.status == RUNNING:
        raw, staged = read_csv(spark, path), target.staged(run_id)
        stage(raw, staged)
        rows, inserted = numbered(_staged(spark, staged, False, raw))
        with_defaults(rows).select("id", *[t for _, t, _ in _stored(raw)], "created_at").write.mode("overwrite").parquet(target.data(run_id))
        bad = _staged(spark, staged, True, raw)
        errors = bad.count()
        if errors:
            bad.write.mode("overwrite").parquet(target.quarantine(run_id))
        run = target.finish(run_id, inserted, errors, truncate)
        target.delete(staged)
    return LoadReport(run_id, run.status, run.rows + run.errors, run.rows, run.errors, time.monotonic() - clock)


def append(rows: DataFrame, path: str, table: str = "pricing", truncate: bool = False, name: str = "append", run_id: str | None = None, dead_after: dt.timedelta = dt.timedelta(hours=12)) -> LoadReport:
    """Load rows that are already typed (a table that Spark read, a feed without CSV) into
    the ``table`` (pricing or shelf) at ``path``, visible in one step like ``load``'s. Columns
    that the table lacks are ignored, an id is given anew, a value that the table can't
    hold is an error."""
    clock = time.monotonic()
    spark, schema = rows.sparkSession, _SCHEMAS[table]
    target, run_id = VersionedTable(spark, path), run_id or str(uuid.uuid4())
    run = target.begin(run_id, name, dead_after)
    if run.status == RUNNING:
        fields = [f for f in schema.fields if f.name in rows.columns and f.name != "id"]
        rows.select(*[F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in fields]).write.mode("overwrite").parquet(target.staged(run_id))
        placed, inserted = numbered(spark.read.schema(T.StructType(fields)).parquet(target.staged(run_id)))
        with_defaults(placed, table).write.mode("overwrite").parquet(target.data(run_id))
        run = target.finish(run_id, inserted, 0, truncate)
        target.delete(target.staged(run_id))
    return LoadReport(run_id, run.status, run.rows, run.rows, 0, time.monotonic() - clock)


def read_prices(spark: SparkSession, table: str, version: int | None = None) -> DataFrame:
    """The table's rows, as the newest load (or that of ``version``) left it."""
    return VersionedTable(spark, table).read(PRICING, version)


def read_shelf(spark: SparkSession, table: str, version: int | None = None) -> DataFrame:
    return VersionedTable(spark, table).read(SHELF, version)


def run_log(spark: SparkSession, table: str) -> DataFrame:
    """One row for each run, as it stands."""
    return VersionedTable(spark, table).log()


def quarantined(spark: SparkSession, table: str) -> DataFrame | None:
    """The raw rows that loads put aside, with their run; None if there are none."""
    return VersionedTable(spark, table).quarantined()
