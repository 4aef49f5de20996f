"""Tables whose loads become visible in one step.

A table is a folder: ``data/run=<id>`` and ``quarantine/run=<id>`` hold the rows of each
load, ``versions/<number>.json`` the run log as it stood after each change of it, newest
last. Rows count only once a version names their run: a load writes its files under
its own id and then publishes by one rename that fails if the number is taken, so
readers see all of a load or nothing, and two loads at once are one after the other.

Rows are stored with their place in their run, from 1; the version gives each run its
first id. So ids are 1..n without a gap over all loads, whichever load came first.
The run log is as long as there were loads; it is all that the driver holds.
"""

from __future__ import annotations

import datetime as dt
import json
import uuid
from dataclasses import asdict, dataclass, replace

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gondola.schema import RUNS

# How a run can stand.
RUNNING, SUCCESS, PARTIAL, FAILED = "running", "success", "partial", "failed"
_DONE = (SUCCESS, PARTIAL)
#: Files of a load whose offsets are sent to all tasks; a load of more is joined by shuffle.
SENT_FILES = 200_000


class RunClosed(Exception):
    """The run was closed, or finished, by another."""


@dataclass(frozen=True)
class Run:
    id: str
    name: str
    status: str
    rows: int = 0
    errors: int = 0
    first_id: int = 1
    visible: bool = False
    started: float = 0.0
    finished: float | None = None


def _now() -> float:
    return dt.datetime.now(dt.UTC).timestamp()


class VersionedTable:
    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._conf = spark._jsc.hadoopConfiguration()
        self._fs = self._path(self.path).getFileSystem(self._conf)
        self._rename = jvm.org.apache.hadoop.fs.FileContext

    def data(self, run: str) -> str:
        return f"{self.path}/data/run={run}"

    def quarantine(self, run: str) -> str:
        return f"{self.path}/quarantine/run={run}"

    def staged(self, run: str) -> str:
        return f"{self.path}/staged/{run}"

    def delete(self, path: str) -> None:
        self._fs.delete(self._path(path), True)

    def children(self, path: str) -> dict[str, float]:
        """What lies in a folder, with the time of its last change; nothing if there is none."""
        folder = self._path(path)
        found = self._fs.listStatus(folder) if self._fs.exists(folder) else []
        return {s.getPath().getName(): s.getModificationTime() / 1000 for s in found}

    def rename(self, source: str, target: str) -> None:
        """An error (FileAlreadyExists) if the target is there."""
        source_path = self._path(source)
        none = self.spark.sparkContext._gateway.new_array(self.spark._jvm.org.apache.hadoop.fs.Options.Rename, 0)
        self._rename.getFileContext(source_path.toUri() if source_path.toUri().getScheme() else self._fs.getUri(), self._conf).rename(source_path, self._path(target), none)

    def numbers(self) -> list[int]:
        return sorted(int(n[:-5]) for n in self.children(f"{self.path}/versions") if n.endswith(".json") and n[:-5].isdigit())

    def _file(self, number: int) -> str:
        return f"{self.path}/versions/{number:012d}.json"

    def runs(self, number: int | None = None) -> tuple[int, list[Run]]:
        """The newest version's number and its run log (or those of version ``number``)."""
        numbers = self.numbers()
        number = number if number is not None else numbers[-1] if numbers else 0
        if not number:
            return 0, []
        stream = self._fs.open(self._path(self._file(number)))
        try:
            text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return number, [Run(**r) for r in json.loads(text)]

    def _publish(self, number: int, runs: list[Run]) -> bool:
        """Whether the version is now there; not, if another took its number before."""
        draft = self._path(f"{self.path}/versions/.draft-{uuid.uuid4().hex}")
        out = self._fs.create(draft, True)
        out.write(bytearray(json.dumps([asdict(r) for r in runs]).encode()))
        out.close()
        try:
            self.rename(draft.toString(), self._file(number))
        except Py4JJavaError as e:
            self.delete(draft.toString())
            if "FileAlreadyExists" in str(e.java_exception):
                return False
            raise
        return True

    def _change(self, change) -> list[Run]:
        """Publish what ``change`` makes of the newest run log, again if another was faster."""
        while True:
            number, runs = self.runs()
            new = change(runs)
            if new == runs or self._publish(number + 1, new):
                return new

    def begin(self, run: str, name: str, dead_after: dt.timedelta) -> Run:
        """Open the run, or take it up again where its loader died. A run that is done
        comes back as it ended. Runs of others open longer than ``dead_after`` are closed."""
        now = _now()

        def change(runs: list[Run]) -> list[Run]:
            if any(r.id == run and r.status in _DONE for r in runs):
                return runs
            closed = [replace(r, status=FAILED, finished=now) if r.status == RUNNING and r.id != run and now - r.started >= dead_after.total_seconds() else r for r in runs if r.id != run]
            return [*closed, Run(run, name, RUNNING, started=now)]

        return next(r for r in self._change(change) if r.id == run)

    def finish(self, run: str, rows: int, errors: int, truncate: bool = False) -> Run:
        """Make the run's rows visible; with ``truncate``, none but them, from id 1."""

        def change(runs: list[Run]) -> list[Run]:
            mine = next((r for r in runs if r.id == run), None)
            if mine is None or mine.status != RUNNING:
                raise RunClosed(f"run {run} is {mine.status if mine else 'unknown'}")
            rest = [replace(r, visible=r.visible and not truncate) for r in runs if r.id != run]
            first = 1 + max((r.first_id + r.rows - 1 for r in rest if r.visible), default=0)
            return [*rest, replace(mine, status=PARTIAL if errors else SUCCESS, rows=rows, errors=errors, first_id=first, visible=True, finished=_now())]

        return next(r for r in self._change(change) if r.id == run)

    def log(self) -> DataFrame:
        """The run log as a table."""
        at = lambda t: None if t is None else dt.datetime.fromtimestamp(t, dt.UTC)
        return self.spark.createDataFrame([(r.id, r.name, r.status, r.rows, 0, [], at(r.started), at(r.finished)) for r in self.runs()[1]], RUNS)

    def read(self, schema: T.StructType, number: int | None = None, key: str = "id", copies: dict[str, str] | None = None) -> DataFrame:
        """The visible rows (of version ``number``, or the newest), ``key`` as over all runs.
        Runs named in ``copies`` are read from the folders there, which hold the same rows."""
        runs = [r for r in self.runs(number)[1] if r.visible and r.rows]
        if not runs:
            return self.spark.createDataFrame([], schema)
        wide = T.StructType([*schema.fields, T.StructField("run", T.StringType())])
        copied = [r for r in runs if r.id in (copies or {})]
        parts = [self.stored([r.id for r in runs if r not in copied], wide)] if len(copied) < len(runs) else []
        parts += [self.spark.read.schema(wide).option("basePath", copies[copied[0].id].rpartition("/")[0]).parquet(*[copies[r.id] for r in copied])] if copied else []
        stored = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
        if len(runs) == 1:
            before = F.lit(runs[0].first_id - 1)
        else:  # a constant for each load; the files' folder says which
            before = F.element_at(F.create_map(*[F.lit(x) for r in runs for x in (r.id, r.first_id - 1)]), F.col("run"))
        return stored.withColumn(key, (F.col(key) + before).cast(schema[key].dataType)).select(*schema.fieldNames())

    def stored(self, runs: list[str], schema: T.StructType) -> DataFrame:
        """The runs' rows as they lie in their files, whatever a version shows."""
        if not runs:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).option("basePath", f"{self.path}/data").parquet(*[self.data(r) for r in runs])

    def quarantined(self) -> DataFrame | None:
        """Rows that finished runs (truncated ones too) put aside; None if there are none."""
        runs = [r for r in self.runs()[1] if r.status in _DONE and r.errors]
        return self.spark.read.option("basePath", f"{self.path}/quarantine").option("mergeSchema", "true").parquet(*[self.quarantine(r.id) for r in runs]) if runs else None

    def vacuum(self) -> None:
        """Delete the files of runs that the newest version doesn't show and that aren't open."""
        runs = {r.id: r for r in self.runs()[1]}
        for kind in ("data", "staged"):
            folder = self._path(f"{self.path}/{kind}")
            for s in self._fs.listStatus(folder) if self._fs.exists(folder) else []:
                run = runs.get(s.getPath().getName().removeprefix("run="))
                if run is None or run.status == FAILED or run.status in _DONE and (kind == "staged" or not run.visible):
                    self.delete(s.getPath().toString())


def numbered(rows: DataFrame, key: str = "id") -> tuple[DataFrame, int]:
    """Rows read from Parquet with ``key``: 1..n in the order of files and of the rows in
    them; and n. One pass counts rows by file (from the footers), a running sum over the
    files gives each its offset, and a row's place in its file does the rest: whatever
    split or attempt of a task reads a row, it gets the same number."""
    file = F.col("_metadata.file_path")
    counts = rows.groupBy(file.alias("_file")).agg(F.count("*").alias("_n"))
    order = Window.orderBy("_file").rowsBetween(Window.unboundedPreceding, -1)  # a row for each file
    offsets = counts.select("_file", "_n", F.coalesce(F.sum("_n").over(order), F.lit(0)).alias("_before")).collect()
    total = sum(r["_n"] for r in offsets)
    known = rows.sparkSession.createDataFrame([(r["_file"], r["_before"]) for r in offsets], "_file string, _before long")
    known = F.broadcast(known) if len(offsets) <= SENT_FILES else known
    placed = rows.select("*", file.alias("_file"), F.col("_metadata.row_index").alias("_at")).join(known, "_file")
    return placed.withColumn(key, F.col("_before") + F.col("_at") + 1).drop("_file", "_at", "_before"), total
