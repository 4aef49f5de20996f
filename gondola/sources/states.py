"""Partial aggregates of a versioned table, kept up by its loads.

A load never changes, so its share of an aggregate is computed once: ``refresh`` writes a
folder ``views/<name>/run=<id>`` for each load that lacks one, from that load's files
alone. Readers take the partial rows of the loads that a version shows; a load not yet
refreshed is aggregated as it is read. So results are those of a full scan at any
time, a truncate drops the shares of what it hides, and older versions stay readable.

``compact`` folds the shares of all loads into ``views/<name>/fold=<version>``. A fold
counts for the loads that its version showed, and only where all of them still show.
Folders appear by one rename that fails if another was first: what a stopped or a
second refresh leaves is never read.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gondola.sources.versions import VersionedTable

#: Drafts older than this were left by a refresh that died.
DEAD_DRAFT_S = 24 * 3600
MERGES: dict[str, Callable[[str], Column]] = {"sum": F.sum, "min": F.min, "max": F.max}


@dataclass(frozen=True)
class State:
    """A mergeable aggregate by ``keys`` of the ``schema``'s rows: ``aggregates`` gives its
    columns over rows, ``merges`` says how partial values of each merge. A group may
    have several partial rows; who reads them merges in the step that groups by
    what it asks. ``prepare`` makes of the rows what is aggregated; a state with a ``layout``
    is written in ranges of these columns and sorted by them."""

    name: str
    schema: T.StructType
    keys: tuple[str, ...]
    merges: dict[str, str]
    aggregates: Callable[[], dict[str, Column]]
    prepare: Callable[[DataFrame], DataFrame] = lambda rows: rows
    layout: tuple[str, ...] = ()

    def of(self, rows: DataFrame) -> DataFrame:
        columns = self.aggregates()
        # sums of decimals keep one type, however often they are merged
        return _widened(self.prepare(rows).groupBy(*self.keys).agg(*[columns[c].alias(c) for c in self.merges]))

    def merged(self, partial: DataFrame) -> DataFrame:
        return _widened(partial.groupBy(*self.keys).agg(*[MERGES[how](c).alias(c) for c, how in self.merges.items()]))


def _widened(df: DataFrame) -> DataFrame:
    kinds = {f.name: f.dataType for f in df.schema.fields}
    wide = {c: T.DecimalType(38, k.scale) for c, k in kinds.items() if isinstance(k, T.DecimalType)}
    return df.select(*[F.col(c).cast(wide[c]).alias(c) if c in wide else F.col(c) for c in kinds])


class Kept:
    """The state of one table."""

    def __init__(self, table: VersionedTable, state: State) -> None:
        self.table, self.state = table, state
        self.path = f"{table.path}/views/{state.name}"

    def _published(self, frame: DataFrame, name: str) -> None:
        draft = f"{self.path}/.draft-{uuid.uuid4().hex}"
        layout = self.state.layout
        (frame.repartitionByRange(*layout).sortWithinPartitions(*layout) if layout else frame).write.parquet(draft)
        try:
            self.table.rename(draft, f"{self.path}/{name}")
        except Py4JJavaError as e:
            self.table.delete(draft)
            if "FileAlreadyExists" not in str(e.java_exception):
                raise  # else another wrote the same rows before

    def _names(self, kind: str) -> set[str]:
        return {n.removeprefix(f"{kind}=") for n in self.table.children(self.path) if n.startswith(f"{kind}=")}

    def _shown(self, number: int | None) -> tuple[int, list[str]]:
        number, runs = self.table.runs(number)
        return number, [r.id for r in runs if r.visible and r.rows]

    def _fold(self, shown: set[str]) -> tuple[str | None, set[str]]:
        """The fold over most of the loads, and over none but them."""
        folds = {f: set(self._shown(int(f))[1]) for f in self._names("fold")}
        fit = {f: ids for f, ids in folds.items() if ids and ids <= shown}
        best = max(fit, key=lambda f: (len(fit[f]), f), default=None)
        return best, fit.get(best, set())

    def refresh(self) -> int:
        """Compute the share of each shown load that has none; how many there were."""
        shown = self._shown(None)[1]
        done = self._names("run") | self._fold(set(shown))[1]
        todo = [run for run in shown if run not in done]
        for run in todo:
            self._published(self.state.of(self.table.stored([run], self.state.schema)), f"run={run}")
        return len(todo)

    def compact(self) -> None:
        """One fold in place of all loads' shares, for tables of many loads."""
        number, shown = self._shown(None)
        if shown and self._fold(set(shown))[1] != set(shown):
            self._published(self.state.merged(self.rows(number)), f"fold={number}")

    def rows(self, number: int | None = None) -> DataFrame:
        """The partial rows of the newest version, or of ``number``."""
        shown = self._shown(number)[1]
        fold, folded = self._fold(set(shown))
        done = self._names("run")
        paths = [f"{self.path}/fold={fold}"] if fold else []
        paths += [f"{self.path}/run={run}" for run in shown if run in done and run not in folded]
        late = [run for run in shown if run not in done and run not in folded]
        spark = self.table.spark
        partial = self.state.of(self.table.stored(late, self.state.schema))
        if not paths:
            return partial
        # the partition column of the folders' names must not join the rows
        kept = spark.read.schema(partial.schema).parquet(*paths)
        return kept.unionByName(partial) if late else kept

    def vacuum(self) -> None:
        """Delete shares that the newest version doesn't need; an older version that
        needs one reads its loads' files instead."""
        shown = set(self._shown(None)[1])
        fold, folded = self._fold(shown)
        for run in self._names("run"):
            if run not in shown or run in folded:
                self.table.delete(f"{self.path}/run={run}")
        for other in self._names("fold") - {fold}:
            self.table.delete(f"{self.path}/fold={other}")
        for name, changed in self.table.children(self.path).items():
            if name.startswith(".draft-") and time.time() - changed > DEAD_DRAFT_S:
                self.table.delete(f"{self.path}/{name}")
