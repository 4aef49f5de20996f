"""Copies of a table's loads in an order that its questions' filters can use.

Each load's rows are written once more, range-sorted by the leading columns and split
into many small row groups: a filter on the leading columns skips files' row groups by
their least and largest value, one on a code skips them by Bloom filter. A copy is found
by its load's name and published by one rename, like a state's share; a load without a
copy is read from its own files, so results never lag.
"""

from __future__ import annotations

import math
import time
import uuid
from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from gondola.schema import PRICING, SHELF
from gondola.sources.states import DEAD_DRAFT_S
from gondola.sources.versions import Run, VersionedTable


@dataclass(frozen=True)
class Layout:
    """``order`` leads the sort, the id settles ties, so that a value that a third of
    the rows hold is split over files too. ``codes`` get Bloom filters, for about as many
    distinct values as a row group has rows."""

    name: str
    schema: T.StructType
    order: tuple[str, ...]
    codes: tuple[str, ...]
    file_rows: int = 2_000_000
    group_rows: int = 100_000
    key: str = "id"


#: Questions on prices ask by brand, feed and date, and for single articles.
PRICES = Layout("brand_feed_date", PRICING, ("marca", "scraper", "fecha_corrida"), ("style_color", "franchise_competitor", "silueta"))
SEARCHES = Layout("channel_term", SHELF, ("canal", "search_term", "marca"), ("search_term",))


class Clustered:
    """The copies of one table in one layout."""

    def __init__(self, table: VersionedTable, layout: Layout) -> None:
        self.table, self.layout = table, layout
        self.path = f"{table.path}/clustered/{layout.name}"

    def _done(self) -> set[str]:
        return {n.removeprefix("run=") for n in self.table.children(self.path) if n.startswith("run=")}

    def _write(self, run: Run, path: str) -> None:
        lay = self.layout
        order = [*lay.order, lay.key]
        # the rows are counted by the load, so the number of files needs no pass
        ranges = self.table.stored([run.id], lay.schema).repartitionByRange(math.ceil(run.rows / lay.file_rows), *order)
        out = ranges.sortWithinPartitions(*order).write.option("parquet.block.row.count.limit", lay.group_rows)
        for code in lay.codes:
            out = out.option(f"parquet.bloom.filter.enabled#{code}", "true").option(f"parquet.bloom.filter.expected.ndv#{code}", lay.group_rows)
        out.parquet(path)

    def refresh(self) -> int:
        """Copy each shown load that has no copy; how many there were. A copy that stopped
        half way leaves only a draft, which ``vacuum`` deletes."""
        done = self._done()
        todo = [r for r in self.table.runs()[1] if r.visible and r.rows and r.id not in done]
        for run in todo:
            draft = f"{self.path}/.draft-{uuid.uuid4().hex}"
            self._write(run, draft)
            try:
                self.table.rename(draft, f"{self.path}/run={run.id}")
            except Py4JJavaError as e:
                self.table.delete(draft)
                if "FileAlreadyExists" not in str(e.java_exception):
                    raise  # else another copied the same rows before
        return len(todo)

    def rows(self, number: int | None = None) -> DataFrame:
        """The same rows as ``VersionedTable.read`` of that version gives, ids too; no rows
        from a table without loads."""
        return self.table.read(self.layout.schema, number, self.layout.key, {run: f"{self.path}/run={run}" for run in self._done()})

    def vacuum(self) -> None:
        """Delete copies of loads that the newest version doesn't show, and dead drafts."""
        shown = {r.id for r in self.table.runs()[1] if r.visible}
        for run in self._done() - shown:
            self.table.delete(f"{self.path}/run={run}")
        for name, changed in self.table.children(self.path).items():
            if name.startswith(".draft-") and time.time() - changed > DEAD_DRAFT_S:
                self.table.delete(f"{self.path}/{name}")


def rows_scanned(answer: DataFrame) -> int:
    """The rows that the files' scans hand to an answer that is one stage of filters and
    projections, after row groups are skipped; runs it."""
    plan = answer._jdf.queryExecution().executedPlan()
    answer.collect()
    leaves = plan.collectLeaves()
    return sum(leaves.apply(i).metrics().apply("numOutputRows").value() for i in range(leaves.length()))
